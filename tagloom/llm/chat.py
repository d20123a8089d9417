"""Chat formatting: collapse cumulative snapshots, then render.

Loggers often write a conversation anew after each turn.  Each turn gets a rolling hash of
the prefix that ends there; a conversation whose whole hash is an inner prefix of another
is a snapshot and goes by an anti-join, equal conversations leave the smallest conv_id.
The rest is rendered.  DataFrame functions only.

The prefix hash is sum(position * h(role, text)) mod p in four lanes, a sum that splits:
turns are summed in blocks of BLOCK turn numbers and blocks' totals are carried over, so
one conversation with a large share of all rows spreads over many tasks.

Defined results: rows without conv_id belong to no conversation and are left out; turns
sort by turn (null first), role, text; repeated equal rows count once; null role or text
reads as empty; conversations with equal turns leave the smallest conv_id; very long texts
are hashed and rendered whole; other columns are ignored, whatever their names; an empty
table gives an empty table.  Each conversation is rendered in parts of PART turns, one row
each, so that no row grows with a conversation; `part=None` gives one row a conversation.
Turns of equal number (null among them) of one conversation are sorted in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK = 512
PART = 256
PRIME = 2_147_483_647
LANES = 4
KEY = ["pos", *(f"w{k}" for k in range(LANES))]


def _mod(x: Column) -> Column:
    return F.pmod(x, F.lit(PRIME))


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text, pos (from 1), n_turns and the lanes w0.. of the prefix that ends with each turn."""
    rows = conversations.where("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))))
    order = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    same = F.lag("role").over(order).eqNullSafe(F.col("role")) & F.lag("text").over(order).eqNullSafe(F.col("text")) & F.lag("turn").over(order).eqNullSafe(F.col("turn")) & (F.row_number().over(order) > 1)
    rows = rows.withColumn("again", same).where("not again").drop("again")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.col("text")), 256)
    rows = rows.withColumn("digest", digest)
    for k in range(LANES):
        rows = rows.withColumn(f"h{k}", _mod(F.conv(F.substring("digest", 1 + 12 * k, 12), 16, 10).cast("long")))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("rn", F.row_number().over(order).cast("long"))
    sums = {f"s{k}": _mod(F.sum(f"h{k}").over(upto)) for k in range(LANES)} | {f"t{k}": _mod(F.sum(_mod(F.col("rn") * F.col(f"h{k}"))).over(upto)) for k in range(LANES)}
    rows = written(rows.withColumns(sums).drop("digest", *(f"h{k}" for k in range(LANES))), "turns")

    blocks = rows.groupBy("conv_id", "block").agg(F.max("rn").alias("n"), *(F.max_by(c, "rn").alias(c) for c in sums))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    blocks = blocks.withColumn("n_turns", F.sum("n").over(Window.partitionBy("conv_id")))
    for k in range(LANES):
        own = _mod(_mod(F.col("offset") * F.col(f"s{k}")) + F.col(f"t{k}"))
        blocks = blocks.withColumn(f"own{k}", own)
    carried = [_mod(F.coalesce(F.sum(f"own{k}").over(before), F.lit(0))).alias(f"carry{k}") for k in range(LANES)]
    blocks = blocks.select("conv_id", "block", "offset", "n_turns", *carried)

    joined = rows.join(blocks.hint("merge"), ["conv_id", "block"])
    lanes = [_mod(F.col(f"carry{k}") + _mod(F.col("offset") * F.col(f"s{k}")) + F.col(f"t{k}")).alias(f"w{k}") for k in range(LANES)]
    return joined.select("conv_id", "role", "text", (F.col("offset") + F.col("rn")).alias("pos"), "n_turns", *lanes)


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that no other one continues."""
    ends = prefixes.where("pos = n_turns").groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = prefixes.where("pos < n_turns").select(*KEY).distinct()
    return ends.join(inner.hint("merge"), KEY, "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_copies")


def render(prefixes: DataFrame, kept: DataFrame, part: int | None = PART) -> DataFrame:
    """Template text of the kept conversations; turns in order, `part` turns a row, or all in one."""
    turns = prefixes.select("conv_id", "pos", "role", "text").join(kept.hint("merge"), "conv_id")
    line = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n"))
    groups = turns.groupBy("conv_id", "n_turns", "n_copies", (F.floor((F.col("pos") - 1) / part).cast("long") if part else F.lit(0).cast("long")).alias("part"))
    lines = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return groups.agg(F.concat_ws("", F.transform(lines, lambda x: x["line"])).alias("rendered"))


def collapse_and_render(conversations: DataFrame, part: int | None = PART) -> DataFrame:
    """conv_id, n_turns, n_copies, part, rendered of every maximal conversation."""
    prefixes = written(prefix_hashes(conversations), "prefixes")
    return render(prefixes, maximal(prefixes), part)


ORACLE = r"""
WITH rows AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    md5(string_agg(md5(length(role)::VARCHAR || ':' || role || text), '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS h
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
ends AS (SELECT pos, h, min(conv_id) AS conv_id, count(*) AS n_copies FROM turns WHERE pos = n_turns GROUP BY pos, h),
kept AS (SELECT conv_id, pos AS n_turns, n_copies FROM ends e WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.pos < t.n_turns AND t.pos = e.pos AND t.h = e.h))
SELECT t.conv_id, k.n_turns, k.n_copies, (t.pos - 1) // 256 AS part, string_agg('<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10), '' ORDER BY t.pos) AS rendered
FROM turns t JOIN kept k ON k.conv_id = t.conv_id GROUP BY ALL
"""
