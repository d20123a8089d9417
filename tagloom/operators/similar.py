"""Perceptual hashes: Hamming joins, nearest neighbours, greedy duplicate groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written

BITS = 64


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(h: Column, threshold: int) -> Column:
    """Keys of which hashes within the threshold share one at least: all choices of two out of threshold + 2 blocks of nearly equal width.

    A differing bit spoils one block, so two blocks agree; two make a key long enough that
    chance keeps buckets small.
    """
    n = threshold + 2
    width, extra = divmod(BITS, n)
    blocks, at = [], 0
    for k in range(n):
        w = width + (k < extra)
        blocks.append((F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << w) - 1 if w < 63 else -1)), w))
        at += w
    pairs = [(i, j) for i in range(n) for j in range(i)]
    return F.array(*[F.struct(F.lit(k).alias("band"), F.shiftleft(blocks[i][0], blocks[j][1]).bitwiseOR(blocks[j][0]).alias("bits")) for k, (i, j) in enumerate(pairs)])


def _votes(batches):
    """(key, h) of batches of (key, distinct tags): of each of the first 64 bits of their digests, what most tags have."""
    import hashlib

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        # a condition on the tags in Spark would make them once more
        batch = batch.filter(pc.greater(pc.list_value_length(batch.column("tags")), 0))
        lists = batch.column("tags")
        codes = lists.flatten().dictionary_encode()
        digests = b"".join(hashlib.md5(tag.encode()).digest()[:8] for tag in codes.dictionary.to_pylist())
        bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1)
        at = codes.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        most = [2 * bits[at[a:b]].sum(axis=0, dtype=np.int64) > b - a for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        h = np.packbits(np.array(most, dtype=bool).reshape(-1, BITS), axis=1).view(">i8").ravel().astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(h)], ["key", "h"])


def simhash(tagged: DataFrame) -> DataFrame:
    """(key, h): 64-bit simhash of each row's distinct tags (key long, an array `tags`); rows without tags have none.  Written, as every use would hash the texts again."""
    return written(tagged.select("key", "tags").mapInArrow(_votes, "key long, h long"), "simhashes")


def classes(keyed: DataFrame) -> DataFrame:
    """(h, rep, members): equal hashes are one class, so a hot hash is one row in the joins below."""
    return keyed.where("key is not null and h is not null").groupBy("h").agg(F.min("key").alias("rep"), F.count("*").alias("members"))


def near_pairs(reps: DataFrame, threshold: int) -> DataFrame:
    """(a, b, distance): pairs of classes (h, rep) within the threshold, by banded equi joins; loses none."""
    banded = reps.select("rep", "h", F.explode(bands(F.col("h"), threshold)).alias("x")).select("rep", "h", "x.band", "x.bits")
    left, right = banded.alias("l"), banded.alias("r").hint("merge")
    pairs = left.join(right, (F.col("l.band") == F.col("r.band")) & (F.col("l.bits") == F.col("r.bits")) & (F.col("l.rep") < F.col("r.rep")))
    d = distance(F.col("l.h"), F.col("r.h"))
    return pairs.where(d <= threshold).select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"), d.alias("distance")).distinct()


def nearest(keyed: DataFrame, probe: int, threshold: int, n: int) -> DataFrame:
    """The n nearest keys to one probe, itself excluded; distance, then key."""
    one = keyed.where(F.col("key") == probe).select(F.col("h").alias("probe")).limit(1)
    d = distance(F.col("h"), F.col("probe"))
    return keyed.where(F.col("key") != probe).join(F.broadcast(one)).where(d <= threshold).select("key", d.alias("distance")).orderBy("distance", "key").limit(n)


def greedy_groups(pairs: DataFrame) -> DataFrame:
    """(member, leader): in key order, a key leads unless an earlier leader is near, whose smallest it joins.

    Rounds over the pair table: undecided keys without a smaller undecided neighbour lead,
    their neighbours follow; each round's tables are written, to cut lineage.
    """
    edges = written(pairs.select("a", "b"), "groups")
    undecided = written(edges.select(F.col("a").alias("k")).union(edges.select(F.col("b").alias("k"))).distinct(), "groups")
    leaders = undecided.limit(0)
    while not undecided.isEmpty():
        live = edges.join(undecided.withColumnRenamed("k", "a").hint("merge"), "a", "left_semi").join(undecided.withColumnRenamed("k", "b").hint("merge"), "b", "left_semi")
        blocked = live.select(F.col("b").alias("k")).distinct()
        new = written(undecided.join(blocked.hint("merge"), "k", "left_anti"), "groups")
        followers = edges.join(new.withColumnRenamed("k", "a").hint("merge"), "a", "left_semi").select(F.col("b").alias("k"))
        leaders = written(leaders.union(new), "groups")
        undecided = written(undecided.join(new.hint("merge"), "k", "left_anti").join(followers.hint("merge"), "k", "left_anti"), "groups")
    heads = leaders.withColumnRenamed("k", "a")
    joined = edges.join(heads.hint("merge"), "a", "left_semi").join(leaders.withColumnRenamed("k", "b").hint("merge"), "b", "left_anti")
    members = joined.groupBy(F.col("b").alias("member")).agg(F.min("a").alias("leader"))
    return members.unionByName(members.select(F.col("leader").alias("member"), "leader").distinct())
