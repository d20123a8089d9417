"""Adapter views: the driver's tables seen as tickets, an index, hashes, pixels, tags, notes.

Each view exists twice: as a DataFrame here and as a common table expression for the SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..shared import small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a table's rows by a key where it has fewer splits than there are cores, so that later work on them isn't left to a few."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prompts; negative prompts are the benchmark's items in turn."""
    docs, bench = spread(table(spark, sf_dir, "documents"), "doc_id"), table(spark, sf_dir, "benchmark")
    comma = lambda c: F.regexp_replace(c, r"[^\p{L}0-9]+", ", ")
    negative = bench.select(F.col("item_id").alias("slot"), comma(F.col("text")).alias("negative_prompt"))
    own = docs.select("doc_id", F.col("lang").alias("character"), F.col("source").alias("profile"), comma(F.col("text")).alias("prompt"), F.col("n_chars").alias("mtime"))
    return own.withColumn("slot", F.col("doc_id") % max(1, bench.count())).join(small(negative), "slot", "left").drop("slot")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a token: doc_id, character, profile, polarity, pos, raw, tag."""
    own = tickets(spark, sf_dir)
    sides = F.explode(F.array(*[F.struct(F.lit(p).alias("polarity"), t.stats_tokens(F.coalesce(c, F.lit(""))).alias("raws")) for p, c in (("positive", F.col("prompt")), ("negative", F.col("negative_prompt")))])).alias("side")
    flat = own.select("doc_id", "character", "profile", sides).select("doc_id", "character", "profile", "side.polarity", F.posexplode("side.raws").alias("pos", "raw"))
    return flat.withColumn("tag", t.stats_tag(F.col("raw")))


def library_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return labels.select(
        "doc_id", F.when(F.col("quality") == 1, 4).otherwise(2).alias("rating"), (F.col("toxic") == 1).alias("favorite"),
        F.array(F.concat(F.lit("f"), (F.col("doc_id") % 5).cast("string"))).alias("folders"),
    )


def embedding_hash(vec: Column) -> Column:
    """64 bits: each element against the median of elements 2 to 64, most significant first."""
    median = F.element_at(F.sort_array(F.slice(vec, 2, 63)), 32)
    # bound once, by a transform of one element: named inside the lambda it would be sorted again for each element
    bits = lambda m: F.aggregate(vec, F.lit(0).cast("long"), lambda h, x: F.shiftleft(h, 1).bitwiseOR(F.when(x > m, 1).otherwise(0).cast("long")))
    return F.get(F.transform(F.array(median), bits), F.lit(0))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", embedding_hash(F.col("embedding")).alias("h"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 images: img, label, y, x, r, g, b."""
    flat = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), "label", F.posexplode("embedding").alias("k", "v"))
    r = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("v").cast("double") + 1) / 2))
    flat = flat.select("img", "label", F.floor(F.col("k") / 8).cast("int").alias("y"), (F.col("k") % 8).alias("x"), r.alias("r"))
    return flat.select("*", (F.col("r") * F.col("r")).alias("g"), (1 - F.col("r")).alias("b"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = F.filter(F.split(F.col("text"), "[ \n]+"), lambda w: w != "")
    return docs.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), "doc_id", F.array_join(F.slice(words, 1, 5), " ").alias("title"), F.col("text").alias("body"),
        F.array("lang", "source").alias("tags"), F.array(F.col("source"), F.concat(F.lit("doc-"), ((F.col("doc_id") * 7) % 200).cast("string"))).alias("links"), F.col("n_chars").alias("mtime"),
    )


def tag_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents as a tag table: tag, category, cnt, alias."""
    words = spread(table(spark, sf_dir, "documents"), "doc_id").select(F.explode(F.split(F.lower(F.regexp_replace("text", r"[^\p{L}0-9]+", " ")), " ")).alias("tag")).where("tag <> ''")
    return words.groupBy("tag").agg(F.count("*").alias("cnt")).select("tag", (F.length("tag") % 6).alias("category"), "cnt", F.reverse("tag").alias("alias"))


SQL = {
    "tickets": r"""tickets AS (SELECT d.doc_id, d.lang AS character, d.source AS profile, regexp_replace(d.text, '[^\p{L}0-9]+', ', ', 'g') AS prompt,
  regexp_replace(b.text, '[^\p{L}0-9]+', ', ', 'g') AS negative_prompt, d.n_chars AS mtime
  FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))""",
    "tokens": r"""raws AS (SELECT doc_id, character, profile, 'positive' AS polarity, list_filter(list_transform(string_split(coalesce(prompt, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM tickets
  UNION ALL SELECT doc_id, character, profile, 'negative', list_filter(list_transform(string_split(coalesce(negative_prompt, ''), ','), lambda x: trim(x)), lambda x: x <> '') FROM tickets),
flat AS (SELECT doc_id, character, profile, polarity, unnest(range(len(l))) AS pos, unnest(l) AS raw FROM raws),
tokens AS (SELECT *, replace(trim(regexp_replace(lower(trim(split_part(regexp_replace(raw, '[()]+', '', 'g'), ':', 1))), '[\s-]+', ' ', 'g')), ' ', '_') AS tag FROM flat)""",
    "library_index": """library_index AS (SELECT doc_id, CASE WHEN quality = 1 THEN 4 ELSE 2 END AS rating, toxic = 1 AS favorite, ['f' || (doc_id % 5)] AS folders FROM labels)""",
    "hashes": """hashes AS (SELECT vec_id, list_reduce(list_transform(embedding, lambda x: CASE WHEN x > list_sort(embedding[2:64])[32] THEN '1' ELSE '0' END), lambda a, b: a || b) AS bits FROM embeddings)""",
    "pixels": """spread AS (SELECT vec_id AS img, label, unnest(range(64)) AS k, unnest(embedding) AS v FROM embeddings),
pix AS (SELECT img, label, k // 8 AS y, k % 8 AS x, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (v::DOUBLE + 1) / 2)) AS r FROM spread),
pixels AS (SELECT *, r * r AS g, 1 - r AS b FROM pix)""",
    "notes": """notes AS (SELECT 'doc-' || doc_id AS id, doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda w: w <> '')[1:5], ' ') AS title, text AS body,
  [lang, source] AS tags, [source, 'doc-' || ((doc_id * 7) % 200)] AS links, n_chars AS mtime FROM documents)""",
    "tag_dump": r"""tag_dump AS (SELECT tag, length(tag) % 6 AS category, count(*) AS cnt, reverse(tag) AS alias FROM (SELECT unnest(string_split(lower(regexp_replace(text, '[^\p{L}0-9]+', ' ', 'g')), ' ')) AS tag FROM documents) WHERE tag <> '' GROUP BY tag)""",
}
NEEDS = {"tokens": ["tickets"]}


def cte(names: list[str]) -> str:
    order: list[str] = []
    for n in names:
        for x in [*NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return "WITH " + ",\n".join(SQL[n] for n in order) + "\n" if order else ""
