"""The render library: view, filter, page, folders and curation updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_TAGS, MAX_TITLE = 20, 80


def view(renders: DataFrame, index: DataFrame) -> DataFrame:
    """Renders with their curation row; defaults where there is none."""
    joined = renders.join(index.hint("merge"), "doc_id", "left")
    return joined.withColumns({"rating": F.coalesce("rating", F.lit(0)), "favorite": F.coalesce("favorite", F.lit(False)), "folders": F.coalesce("folders", F.array().cast("array<string>"))})


def with_tickets(renders: DataFrame, tickets: DataFrame) -> DataFrame:
    """Renders (character, name, stem) with the ticket of the same folder and stem, if there is one."""
    return renders.join(tickets.hint("merge"), ["character", "name", "stem"], "left")


def matching(rows: DataFrame, character=None, profile=None, min_rating=None, favorites=False, folder=None, tag=None) -> DataFrame:
    """Conjunctive filter; an unset parameter doesn't filter."""
    for column, value in (("character", character), ("profile", profile)):
        rows = rows.where(F.col(column) == value) if value else rows
    rows = rows.where(F.col("rating") >= min_rating) if min_rating else rows
    rows = rows.where("favorite") if favorites else rows
    rows = rows.where(F.array_contains("folders", folder)) if folder else rows
    if not tag:
        return rows
    # the user's own tags, and the machine's where the view has them
    known = F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in ("tags", "machine_tags") if c in rows.columns))
    return rows.where(F.exists(known, lambda t: F.lower(t) == tag.lower()))


def page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(F.desc("favorite"), F.desc("rating"), F.desc("mtime"), "doc_id").offset(offset).limit(limit)


def upsert(index: DataFrame, delta: DataFrame, columns: list[str]) -> DataFrame:
    """Full outer merge by doc_id; a field the delta leaves null keeps its value."""
    new = delta.select("doc_id", *(F.col(c).alias(f"new_{c}") for c in columns))
    return index.join(new.hint("merge"), "doc_id", "full_outer").select("doc_id", *(F.coalesce(f"new_{c}", c).alias(c) for c in columns))


def checked_update(updates: DataFrame) -> DataFrame:
    """Updates with their validity: rating null or 0 to 5; tags trimmed and cut; title cut."""
    tags = F.slice(F.filter(F.transform("tags", lambda t: F.trim(t)), lambda t: t != ""), 1, MAX_TAGS)
    ok = F.col("rating").isNull() | F.col("rating").between(0, 5)
    return updates.withColumns({"valid": ok, "tags": tags, "title": F.substr("title", F.lit(1), F.lit(MAX_TITLE))})


def folder_counts(registry: DataFrame, members: DataFrame) -> DataFrame:
    """Every folder of either side with its number of members."""
    counts = members.select(F.explode("folders").alias("folder")).groupBy("folder").agg(F.count("*").alias("items"))
    return registry.distinct().join(counts.hint("merge"), "folder", "full_outer").select("folder", F.coalesce("items", F.lit(0).cast("long")).alias("items"))


def rename_folder(index: DataFrame, old: str, new: str) -> DataFrame:
    moved = F.array_distinct(F.transform("folders", lambda f: F.when(f == old, F.lit(new)).otherwise(f)))
    return index.withColumns({"touched": F.array_contains("folders", old), "folders": moved})


def slug_suffix(rows: DataFrame, slug: Column, order: str) -> DataFrame:
    """Equal slugs get -1, -2, ... in order; the first stays bare."""
    own = rows.withColumn("slug", slug)
    n = F.row_number().over(Window.partitionBy("slug").orderBy(order)) - 1
    return own.withColumn("n", n).withColumn("id", F.when(F.col("n") == 0, F.col("slug")).otherwise(F.concat_ws("-", "slug", "n"))).drop("n")
