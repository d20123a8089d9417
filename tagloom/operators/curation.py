"""Changes to a library: guarded saves, renames, folders, deletion with all that hangs on it, dataset exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..shared import written
from .snapshots import newest

#: Folders at most, and characters of a folder's name.
FOLDERS, FOLDER_NAME = 50, 30
KEY = "^[a-z0-9][a-z0-9_-]*$"


def file_reason(file: Column) -> Column:
    """Why a render's file name is refused, or null: it must be a .png name without a folder in it."""
    return F.when(file.isNull() | (file == ""), "no name").when(F.contains(file, F.lit("/")) | F.contains(file, F.lit("\\")), "folder in the name").when(~F.endswith(file, F.lit(".png")), "no png").when(F.contains(file, F.lit("..")), "dots in the name")


def key_reason(key: Column) -> Column:
    """Why a character's or profile's key is refused, or null."""
    return F.when(key.isNull() | (key == ""), "no key").when(~key.rlike(KEY), "characters that keys don't have")


# --- profiles --------------------------------------------------------------------------


def guarded_save(current: DataFrame, incoming: DataFrame, stamp: str) -> tuple[DataFrame, DataFrame]:
    """Profiles after saving incoming (character, name, body, variant_of) over current (the same and locked), and what was done (character, name, saved_as, action).

    The lock counts as it is in current.  A locked profile stays and the saved one becomes the
    variant name_stamp, with _2, _3, ... where that is taken; it keeps the variant_of it has,
    else points to the name.  An unlocked one is overwritten, a new one is created.  Several
    saves of one locked profile make a variant each; of an unlocked one the largest body stays.
    """
    keys = ["character", "name"]
    held = current.select(*keys, F.coalesce("locked", F.lit(False)).alias("_locked"))
    own = incoming.select(*keys, "body", "variant_of").join(held.hint("merge"), keys, "left")
    plain = own.where("not coalesce(_locked, false)").groupBy(*keys, "_locked").agg(F.max(F.struct("body", "variant_of")).alias("x"))
    plain = plain.select(*keys, "x.body", "x.variant_of", F.when(F.col("_locked").isNull(), "created").otherwise("overwritten").alias("action"))
    base = F.concat_ws("_", "name", F.lit(stamp))
    variants = own.where("_locked").select("character", "name", base.alias("_base"), "body", F.coalesce("variant_of", "name").alias("variant_of"))
    # names base and base_k that are taken: the free numbers are dealt in order
    number = F.when(F.col("name") == F.col("_base"), 1).otherwise(F.try_to_number(F.nullif(F.regexp_extract("name", r"_([0-9]{1,9})\z", 1), F.lit("")), F.lit("999999999")).cast("int"))
    stems = variants.select("character", "_base").distinct()
    taken = current.select("character", "name").join(stems.hint("merge"), "character").where((F.col("name") == F.col("_base")) | F.startswith("name", F.concat("_base", F.lit("_"))))
    taken = taken.select("character", "_base", number.alias("k")).where("k is not null").groupBy("character", "_base").agg(F.collect_set("k").alias("_taken"))
    nth = F.row_number().over(Window.partitionBy("character", "_base").orderBy("body"))
    dealt = variants.withColumn("_nth", nth).join(taken.hint("merge"), ["character", "_base"], "left").withColumn("_taken", F.coalesce("_taken", F.array().cast("array<int>")))
    free = F.filter(F.sequence(F.lit(1), F.col("_nth") + F.size("_taken")), lambda k: ~F.array_contains("_taken", k))
    k = F.get(free, F.col("_nth") - 1)
    dealt = dealt.withColumn("saved_as", F.when(k == 1, F.col("_base")).otherwise(F.concat_ws("_", "_base", k.cast("string"))))
    kept = current.join(plain.select(*keys).hint("merge"), keys, "left_anti").select(*keys, "body", "variant_of", "locked")
    after = kept.unionByName(plain.select(*keys, "body", "variant_of", F.lit(False).alias("locked"))).unionByName(dealt.select("character", F.col("saved_as").alias("name"), "body", "variant_of", F.lit(False).alias("locked")))
    return after, plain.select(*keys, F.col("name").alias("saved_as"), "action").unionByName(dealt.select(*keys, "saved_as", F.lit("variant").alias("action")))


def rename_profiles(profiles: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves (character, name, new_name) with a reason where they are refused: bad or same name, no such profile, locked, name taken or asked for twice."""
    have = profiles.select("character", "name", F.coalesce("locked", F.lit(False)).alias("_locked"), F.lit(True).alias("_there"))
    there = profiles.select("character", F.col("name").alias("new_name"), F.lit(True).alias("_taken"))
    twice = F.count("*").over(Window.partitionBy("character", "new_name"))
    own = moves.withColumn("_twice", twice).join(have.hint("merge"), ["character", "name"], "left").join(there.hint("merge"), ["character", "new_name"], "left")
    reason = (
        F.when(key_reason(F.col("new_name")).isNotNull(), "bad name").when(F.col("new_name") == F.col("name"), "same name").when(F.col("_there").isNull(), "no such profile")
        .when(F.col("_locked"), "locked").when(F.col("_taken") | (F.col("_twice") > 1), "name taken")
    )
    return own.select("character", "name", "new_name", reason.alias("reason"))


def rekeyed(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """Rows (character, name, ...) of renamed profiles under their new name; refused moves change nothing."""
    good = moves.where("reason is null").select("character", "name", "new_name")
    return rows.join(good.hint("merge"), ["character", "name"], "left").withColumns({"renamed": F.col("new_name").isNotNull(), "name": F.coalesce("new_name", "name")}).drop("new_name")


# --- folders ---------------------------------------------------------------------------


def folder_changes(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes (nth, action, folder, new_name) with a reason where they are refused.

    create: the name is new and there are fewer than FOLDERS; rename: the folder is there and
    the new name isn't; delete: the folder is there.  Names have 1 to FOLDER_NAME characters
    and no slashes.  Changes are judged against the registry as it was, creations in order of
    nth up to the most.
    """
    known = registry.select("folder").distinct()
    there = known.withColumn("_there", F.lit(True))
    target = known.select(F.col("folder").alias("new_name"), F.lit(True).alias("_target"))
    bad = lambda c: F.coalesce(F.trim(c) == "", F.lit(True)) | (F.length(F.trim(c)) > FOLDER_NAME) | F.contains(c, F.lit("/")) | F.contains(c, F.lit("\\"))
    own = changes.withColumns({"folder": F.trim("folder"), "new_name": F.trim("new_name")}).join(there.hint("merge"), "folder", "left").join(target.hint("merge"), "new_name", "left")
    first = F.row_number().over(Window.partitionBy("action", "folder").orderBy("nth"))
    own = own.withColumn("_first", first)
    fresh = own.where((F.col("action") == "create") & ~bad(F.col("folder")) & F.col("_there").isNull() & (F.col("_first") == 1))
    room = fresh.orderBy("nth", "folder").limit(max(0, FOLDERS - known.count())).select("nth", "folder", F.lit(True).alias("_room"))
    own = own.join(room.hint("merge"), ["nth", "folder"], "left")
    act = lambda a: F.col("action") == a
    reason = (
        F.when(bad(F.col("folder")) | act("rename") & bad(F.col("new_name")), "bad name")
        .when(act("create") & (F.col("_there").isNotNull() | (F.col("_first") > 1)), "already there").when(act("create") & F.col("_room").isNull(), "too many folders")
        .when(~act("create") & F.col("_there").isNull(), "not found").when(act("rename") & F.col("_target").isNotNull() & (F.col("new_name") != F.col("folder")), "already there")
    )
    return own.select("nth", "action", "folder", "new_name", reason.alias("reason"))


def apply_folders(index: DataFrame, judged: DataFrame) -> DataFrame:
    """The index (with an array folders) after renames and deletions, and whether a row was touched; order and other folders stay."""
    good = judged.where("reason is null and action in ('rename', 'delete')")
    most = good.agg(F.map_from_entries(F.collect_list(F.struct("folder", F.struct("action", "new_name")))).alias("m")).first()["m"] or {}  # at most FOLDERS entries
    if not most:
        return index.withColumn("touched", F.lit(False))
    names = F.create_map(*[F.lit(x) for f, change in most.items() for x in (f, change["new_name"] if change["action"] == "rename" else "")])
    moved = F.filter(F.transform("folders", lambda f: F.coalesce(F.try_element_at(names, f), f)), lambda f: f != "")
    return index.withColumns({"touched": F.arrays_overlap("folders", F.array(*[F.lit(f) for f in most])), "folders": F.array_distinct(moved)})


# --- deletion --------------------------------------------------------------------------


def delete_cascade(gone: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is left of renders, tickets, sidecars, index and thumbs when the renders gone (character, name, file) go.

    The keys are written once, with all the forms they take: renders by their three parts,
    tickets and sidecars by character, name and stem, the index by its key, thumbnails by the
    md5 of it.  Each table keeps its columns and loses what hangs on a key, by an anti join.
    """
    key = F.concat_ws("/", "character", "name", "file")
    forms = gone.select("character", "name", "file").distinct().select("*", F.regexp_replace("file", r"\.[^.]*$", "").alias("stem"), key.alias("key"), F.concat(F.md5(key.cast("binary")), F.lit(".jpg")).alias("thumb"))
    forms = written(forms, "deleted-keys")
    by = {"renders": ["character", "name", "file"], "tickets": ["character", "name", "stem"], "sidecars": ["character", "name", "stem"], "index": ["key"], "thumbs": ["thumb"]}
    return {name: rows.join(forms.select(*by[name]).distinct().hint("merge"), by[name], "left_anti").select(rows.columns) for name, rows in tables.items()}


# --- export ----------------------------------------------------------------------------


def captioned(renders: DataFrame, mode: str) -> DataFrame:
    """Adds caption and fallback to renders (machine_tags, prompt): machine tags, else the prompt, which counts as a fallback if it isn't empty; or the prompt; or none."""
    if mode not in ("prompt", "wd14", "none"):
        raise ValueError("a caption is prompt, wd14 or none")
    tags = F.nullif(F.array_join(F.coalesce("machine_tags", F.array().cast("array<string>")), ", "), F.lit("")) if mode == "wd14" else F.lit(None).cast("string")
    prompt = F.coalesce("prompt", F.lit(""))
    caption = F.lit(None).cast("string") if mode == "none" else t.caption(F.coalesce(tags, prompt))
    return renders.withColumns({"caption": caption, "fallback": F.lit(mode == "wd14") & tags.isNull() & (prompt != "")})


def placed(renders: DataFrame, there: DataFrame) -> DataFrame:
    """Adds dest to renders (character, file, length): the file's name, or character_file where a file of another length has it.

    there (file, length) is what the folder holds.  Renders take their places in order of key:
    the first of a name that isn't in the folder sets its length.
    """
    held = there.select("file", F.col("length").alias("_held")).distinct()
    first = renders.groupBy("file").agg(F.min_by("length", "key").alias("_first"))
    own = renders.join(held.hint("merge"), "file", "left").join(first.hint("merge"), "file")
    return own.withColumn("dest", F.when(F.coalesce("_held", "_first") == F.col("length"), F.col("file")).otherwise(F.concat_ws("_", "character", "file"))).drop("_held", "_first")


def export_dataset(renders: DataFrame, root: str, name: str, mode: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """Write chosen renders (key, character, file, length, machine_tags, prompt) as data set `name`; its receipt and the items of the receipt.

    What the data set holds (dest, key, length, caption) goes to root/name/held/n, merged with
    what was exported before; the receipt's items (key, file, fallback), one row a render, to
    items/n, and last the receipt (dataset, caption, exported, wd14_fallbacks) to receipts/n,
    which makes the export valid.  A run that changes nothing writes nothing and returns the
    receipt that is there.
    """
    if not re.match(KEY, name):
        raise ValueError("a data set's name has small letters, digits, _ and -")
    spark, at = renders.sparkSession, f"{root}/{name}"
    before = newest(spark, f"{at}/receipts")
    schema = "dest string, key string, length long, caption string"
    old = spark.read.parquet(f"{at}/held/{before}") if before >= 0 else spark.createDataFrame([], schema)
    own = written(placed(captioned(renders, mode), old.select(F.col("dest").alias("file"), "length")), "export")
    new = own.groupBy("dest").agg(F.max(F.struct("key", F.col("length").cast("long").alias("length"), "caption")).alias("x")).select("dest", "x.key", "x.length", "x.caption")
    held = written(old.join(new.select("dest").hint("merge"), "dest", "left_anti").select("dest", "key", "length", "caption").unionByName(new), "export-held")
    items = own.select("key", F.col("dest").alias("file"), "fallback")
    receipt = own.agg(F.lit(name).alias("dataset"), F.lit(mode).alias("caption"), F.count("*").alias("exported"), F.count_if("fallback").alias("wd14_fallbacks"))
    same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    read = lambda n: (spark.read.parquet(f"{at}/receipts/{n}"), spark.read.parquet(f"{at}/items/{n}"))
    if before >= 0 and same(held, old) and same(receipt, read(before)[0]) and same(items, read(before)[1]):
        return read(before)
    for part, rows in (("held", held), ("items", items), ("receipts", receipt)):
        rows.write.mode("overwrite").parquet(f"{at}/{part}/{before + 1}")
    return read(before + 1)
