"""Tag statistics over prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import QUALITY_GRAMMAR, stats_tag
from ..shared import looked_up, small, written


def tag_counts(tokens: DataFrame) -> DataFrame:
    """Counts by polarity, for each character and overall (character null) in one pass."""
    # equal raw tokens are counted first and written, as the conditions on tags would else be worked out below the counting, for every token
    raws = written(tokens.groupBy("polarity", "character", "raw").agg(F.count("*").alias("n")), "raw-tokens")
    kept = raws.withColumn("tag", stats_tag(F.col("raw"))).where((F.col("tag") != "") & ~F.col("tag").rlike(QUALITY_GRAMMAR) & ~F.startswith("tag", F.lit("<lora")))
    sets = kept.groupingSets([("polarity", "character", "tag"), ("polarity", "tag")], "polarity", "character", "tag")
    return sets.agg(F.grouping("character").cast("int").alias("overall"), F.sum("n").alias("cnt"))


def top_tags(counts: DataFrame, own: dict[str, int], overall: dict[str, int]) -> DataFrame:
    """The most frequent tags of each scope; ties by tag."""
    limit = F.lit(0)
    for p in own:
        limit = F.when(F.col("polarity") == p, F.when(F.col("overall") == 1, overall[p]).otherwise(own[p])).otherwise(limit)
    scope = Window.partitionBy("polarity", "overall", "character").orderBy(F.desc("cnt"), "tag")
    # the literal bound lets each task keep its best rows only, before the shuffle
    most = max(*own.values(), *overall.values())
    return counts.withColumn("rank", F.row_number().over(scope)).where(F.col("rank") <= most).where(F.col("rank") <= limit)


def total_renders(tickets: DataFrame, **filters: str) -> DataFrame:
    """One row: renders under the filters (column=value; empty values don't filter)."""
    for column, value in filters.items():
        tickets = tickets.where(F.col(column) == value) if value else tickets
    return tickets.agg(F.count("*").alias("total_renders"))


def character_counts(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy("character").agg(F.count("*").alias("renders"), F.count_distinct("profile").alias("profiles"))


#: Frequent tags whose pairs are counted in a square of numbers.
DENSE = 2_048


def _pair_counts(tags: list[str]):
    """Counts of pairs of the given sorted tags over a task's prompts (an array `tags`), as products of their 0/1 rows."""

    def count(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known, total = pa.array(tags, pa.string()), np.zeros((len(tags), len(tags)), dtype=np.int64)
        for batch in batches:
            lists = batch.column("tags")
            at = pc.index_in(lists.flatten(), value_set=known)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            held = at.is_valid().to_numpy(zero_copy_only=False)
            row, tag = row[held], at.drop_null().to_numpy(zero_copy_only=False)
            for low in range(0, len(lists), 2_048):
                own = (row >= low) & (row < low + 2_048)
                ones = np.zeros((min(2_048, len(lists) - low), len(tags)), dtype=np.float32)
                ones[row[own] - low, tag[own]] = 1
                total += (ones.T @ ones).astype(np.int64)
        a, b = np.nonzero(np.triu(total, 1))
        for low in range(0, len(a), 65_536):
            i, j = a[low : low + 65_536], b[low : low + 65_536]
            yield pa.RecordBatch.from_arrays([known.take(pa.array(i)), known.take(pa.array(j)), pa.array(total[i, j])], ["tag_a", "tag_b", "n"])

    return count


def cooccurrence(prompts: DataFrame, key: str, least: int, dense: int = DENSE) -> DataFrame:
    """Pairs of distinct tags of one prompt (key, an array `tags`) with the number of prompts, from `least` on.

    A pair is no more frequent than its rarer tag, so tags below `least` go first.  Up to `dense`
    tags are left as a rule: tasks add up their prompts' pairs as products of 0/1 rows, and only
    these sums are shuffled.  With more, a prompt gives a row for each left tag with those after it,
    and no row holds a prompt's pairs.
    """
    own = prompts.select(key, F.array_distinct("tags").alias("tags"))
    # the outer form, as the plain one gets a condition on the array, which makes it once more
    tags = own.select(key, F.explode_outer("tags").alias("tag")).where("tag is not null")
    often = written(tags.groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("tag"), "frequent-tags")
    known = [r.tag for r in often.limit(dense + 1).collect()]
    if len(known) <= dense:
        sums = own.select("tags").mapInArrow(_pair_counts(sorted(known)), "tag_a string, tag_b string, n long")
        return sums.groupBy("tag_a", "tag_b").agg(F.sum("n").alias("prompts")).where(F.col("prompts") >= least)
    kept = tags.join(small(often, 20_000), "tag", "left_semi").groupBy(key).agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    left = kept.select(F.posexplode("tags").alias("k", "tag_a"), "tags").select("tag_a", F.slice("tags", F.col("k") + 2, F.size("tags")).alias("after"))
    pairs = left.select("tag_a", F.explode("after").alias("tag_b"))
    return pairs.groupBy("tag_a", "tag_b").agg(F.count("*").alias("prompts")).where(F.col("prompts") >= least)


def consolidate(renders: DataFrame, share: float) -> DataFrame:
    """Stable core: tags of at least `share` of a character's renders (character, doc_id, an array `tags`); renders without a tag don't count."""
    own = renders.select("character", F.filter(F.array_distinct("tags"), lambda x: x != "").alias("tags")).where(F.size("tags") > 0)
    totals = own.groupBy("character").agg(F.count("*").alias("renders"))
    counts = own.select("character", F.explode("tags").alias("tag")).groupBy("character", "tag").agg(F.count("*").alias("docs"))
    return looked_up(counts, totals, "character", "tag", "inner").where(F.col("docs") >= share * F.col("renders")).select("character", "tag", "docs", "renders")


def variations(renders: DataFrame, core: DataFrame) -> DataFrame:
    """(character, doc_id, line): what each render has beside its character's core, in its own order; one without any has an empty line.

    A core has at most 1 / share times as many tags as a render, so a character's is one array.
    """
    cores = core.groupBy("character").agg(F.collect_set("tag").alias("core"))
    own = looked_up(renders, cores, "character", "doc_id")
    rest = F.filter(F.array_distinct("tags"), lambda x: (x != "") & ~F.array_contains(F.coalesce("core", F.array().cast("array<string>")), x))
    return own.select("character", "doc_id", F.array_join(rest, ", ").alias("line"))
