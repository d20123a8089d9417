"""File sources: render trees, tickets, indexes, PNG text chunks, tag dumps, notes, model files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import exists, written

TICKET = """profile string, file string, seed long, wall_s double, forge_infotext string, experiment_id string,
effective_settings struct<prompt:string, negative_prompt:string, checkpoint:string, size:string, sampler:string, scheduler:string, steps:long, cfg_scale:double>, _corrupt_record string"""


def _parts(path):
    return F.split(path, "/")


def renders(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """Files exactly two levels under root: character, name, file, stem, mtime, length; contents stay unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(f"{root}/*/*/").select("path", "modificationTime", "length")
    p = _parts(F.col("path"))
    file = F.element_at(p, -1)
    return files.select(F.element_at(p, -3).alias("character"), F.element_at(p, -2).alias("name"), file.alias("file"), F.regexp_replace(file, r"\.[^.]*$", "").alias("stem"), F.unix_timestamp("modificationTime").alias("mtime"), "length", "path")


def tickets(spark: SparkSession, root: str) -> DataFrame:
    """One JSON ticket a render; malformed ones are skipped."""
    read = spark.read.schema(TICKET).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(f"{root}/*/*/")
    p = _parts(F.col("_metadata.file_path"))
    own = read.select("*", F.element_at(p, -3).alias("character"), F.element_at(p, -2).alias("name"), F.regexp_replace(F.element_at(p, -1), r"\.json$", "").alias("stem"))
    return own.where("_corrupt_record is null and not endswith(stem, '.meta')").drop("_corrupt_record")


def library_index(spark: SparkSession, path: str) -> DataFrame:
    """{"items": {key: row}} to one row a key; an unreadable file is an empty index."""
    item = "items map<string, struct<rating:int, favorite:boolean, tags:array<string>, folders:array<string>, title:string, phash:string>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", item)["items"].alias("items"))
    rows = whole.select(F.explode("items").alias("key", "x"))
    return rows.select("key", F.coalesce("x.rating", F.lit(0)).alias("rating"), F.coalesce("x.favorite", F.lit(False)).alias("favorite"), F.coalesce("x.tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("x.folders", F.array().cast("array<string>")).alias("folders"), "x.title", "x.phash")


def png_chunks(content: bytes) -> list[tuple[str, str]]:
    """Keyword and text of the text chunks of a PNG; nothing for other files or broken chunks."""
    found, at = [], 8
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        return found
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        data = content[at + 8 : at + 8 + size]
        at += size + 12
        key, _, rest = data.partition(b"\0")
        if kind == b"tEXt":
            found.append((key.decode("latin-1"), rest.decode("latin-1")))
        elif kind == b"zTXt" and rest[:1] == b"\0":
            try:
                found.append((key.decode("latin-1"), zlib.decompress(rest[1:]).decode("latin-1")))
            except zlib.error:
                pass
        elif kind == b"iTXt" and rest[:1] in (b"\0", b"\1"):
            # flag and method, then language, translated keyword and text, the latter two after a null byte each
            text = rest[2:].split(b"\0", 2)[-1]
            try:
                text = zlib.decompress(text) if rest[:1] == b"\1" else text
            except zlib.error:
                continue
            found.append((key.decode("latin-1"), text.decode("utf-8", "replace")))
        elif kind == b"IEND":
            break
    return found


def png_metadata(spark: SparkSession, glob: str) -> DataFrame:
    """path, readable (is a PNG), dialect (infotext, graph or null) and its text; an empty chunk counts as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column("content").to_pylist()
            texts = [dict(reversed(png_chunks(c or b""))) for c in contents]
            yield pa.RecordBatch.from_pydict({
                "path": batch.column("path"), "readable": pa.array([(c or b"")[:8] == b"\x89PNG\r\n\x1a\n" for c in contents]),
                "parameters": pa.array([t.get("parameters") or None for t in texts], pa.string()), "graph": pa.array([t.get("prompt") or None for t in texts], pa.string()),
            })

    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    found = files.mapInArrow(run, "path string, readable boolean, parameters string, graph string")
    return found.select("path", "readable", F.when(F.col("parameters").isNotNull(), "infotext").when(F.col("graph").isNotNull(), "graph").alias("dialect"), F.coalesce("parameters", "graph").alias("text"))


def sidecar_fallback(files: DataFrame, sidecars: DataFrame, suffix: str = ".meta.json") -> DataFrame:
    """Each file (path, file) with its sidecar's text (file, path, text): by stem before the first dot, by full name, by the same stem anywhere."""
    stem = lambda c: F.split_part(c, F.lit("."), F.lit(1))
    side = sidecars.select(F.regexp_replace("file", suffix.replace(".", r"\.") + "$", "").alias("base"), F.col("path").alias("side_path"), F.col("text").alias("side_text"))
    tier = F.when(F.col("base") == stem(F.col("file")), F.when(F.regexp_extract("path", "^(.*)/", 1) == F.regexp_extract("side_path", "^(.*)/", 1), 1).otherwise(3)).otherwise(2)
    found = files.join(side.hint("merge"), stem(F.col("file")) == stem(F.col("base")), "left").withColumn("tier", tier)
    first = Window.partitionBy("path").orderBy(F.asc_nulls_last("tier"), "side_path")
    return found.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("path", "file", F.col("side_text").alias("text"))


def tag_dump(spark: SparkSession, path: str) -> DataFrame:
    """CSV of tag, category, count, "alias,alias": short or empty rows out, bad counts 0, the first of a tag wins."""
    raw = spark.read.schema("tag string, category string, cnt string, aliases string").option("escape", '"').csv(path).withColumn("line", F.monotonically_increasing_id())
    own = raw.where("tag <> '' and cnt is not null").select("line", "tag", F.lower("tag").alias("low"), F.expr("try_cast(category as int)").alias("category"), F.coalesce(F.expr("try_cast(cnt as bigint)"), F.lit(0)).alias("cnt"), F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), ","), lambda a: F.lower(F.trim(a))), lambda a: a != "").alias("aliases"))
    first = F.row_number().over(Window.partitionBy("low").orderBy("line"))
    return own.withColumn("rn", first).where("rn = 1").drop("rn")


def alias_table(dump: DataFrame) -> DataFrame:
    """alias -> tag, the first row of an alias wins."""
    flat = dump.select("line", "tag", F.explode("aliases").alias("alias"))
    return flat.groupBy("alias").agg(F.min_by("tag", "line").alias("tag"))


def notes(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files with their modification time, newest first."""
    own = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.element_at(_parts(F.col("_metadata.file_path")), -1), r"\.md$", "").alias("id"), F.col("value").alias("text"), F.unix_timestamp("_metadata.file_modification_time").alias("mtime"))
    return own.orderBy(F.desc("mtime"), "id")


def models(spark: SparkSession, root: str, cache: DataFrame) -> DataFrame:
    """Model files under root with their cached enrichment; hidden files and caches out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.safetensors").load(root).select("path", "length")
    inner = F.regexp_replace("path", ".*" + root.rstrip("/").replace(".", r"\.") + "/", "")
    own = files.select(inner.alias("rel"), (F.col("length") / 1e6).alias("size_mb")).where(~F.col("rel").rlike(r"(^|/)\.cache|(^|/)\._"))
    folder = F.when(F.contains("rel", F.lit("/")), F.split_part("rel", F.lit("/"), F.lit(1))).otherwise("(root)")
    own = own.select(F.regexp_replace(F.element_at(F.split("rel", "/"), -1), r"\.safetensors$", "").alias("name"), folder.alias("folder"), "size_mb")
    return own.join(cache.hint("merge"), "name", "left").withColumn("enriched", F.col("url").isNotNull())


def write_tickets(tickets: DataFrame, path: str) -> int:
    """Write JSON tickets (character, profile, file, ...) by character and profile, each file once, and return how many were new.

    A ticket that is there already stays as it is; of several new ones for a file the first
    seed counts.  The new ones are written apart first, so that the reading is over when they are added.
    """
    keys, spark = ["character", "profile", "file"], tickets.sparkSession
    one = tickets.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("seed")))).where("_rn = 1").drop("_rn") if "seed" in tickets.columns else tickets.dropDuplicates(keys)
    if exists(spark, path):
        there = spark.read.schema("file string, character string, profile string").json(path).select(*keys).distinct()
        one = one.join(there.hint("merge"), keys, "left_anti")
    new = written(one.select(tickets.columns), "tickets")
    n = new.count()
    if n:
        new.write.partitionBy("character", "profile").mode("append").json(path)
    return n


def styles(spark: SparkSession, path: str) -> DataFrame:
    """(nth, name, prompt, negative_prompt) of a JSON list of prompt styles; an unreadable file has none."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<struct<name:string, prompt:string, negative_prompt:string>>").alias("x"))
    return whole.select(F.posexplode("x").alias("nth", "s")).select("nth", "s.name", "s.prompt", "s.negative_prompt")


def experiments(spark: SparkSession, root: str) -> DataFrame:
    """One row a folder with a readable experiment.json, newest first: folder, mtime and the file's text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "experiment.json").load(f"{root}/*/")
    own = files.select(F.element_at(_parts(F.col("path")), -2).alias("folder"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("content").cast("string").alias("manifest"))
    return own.where("try_parse_json(manifest) is not null").orderBy(F.desc("mtime"), "folder")
