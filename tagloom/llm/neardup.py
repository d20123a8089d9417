"""MinHash near-duplicate groups.

Universal hash minima of word shingles, banded into buckets; every bucket is a star around
its smallest member, and the stars' connected components are candidate groups that hold
every pair of documents sharing a bucket.  Inside a group, pairs are checked by signature
and then exactly on full shingle sets; the links found give the final components.

A document that has joined a cluster is compared with no other member of it, and tasks give
one row for each merged document: they hold sets, signatures and cluster numbers, never pairs.

Skew: documents with equal sets are one class from the start (a hot group of copies costs
one row); buckets are pre-aggregated.  Groups beyond BLOCK_SHINGLES are dealt to blocks by
hash.  First each block is compared in itself, then the clusters' first documents across
blocks, and then only what is still open: documents outside a group's largest cluster, with
the whole group, each pair of blocks in one task.  Texts of one large cluster thus travel
once; many different texts in one large group still cost the square of their blocks.

Defined results: a document without words (or null, or empty) has 0 shingles and its own
component; equal ids are one document; rows with a null doc_id link nothing, have a null
component and stay; very long texts are read whole; other columns are ignored; an empty table
gives an empty table; every row gives one row.  A link at the threshold t is missed with
probability (1 - t^ROWS)^bands, which the number of bands holds under MISSED: 24 at 0.85, 35
at 0.80.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, texts, written
from .components import components
from .words import U64, binary_column, grams, hash_words, mix, whole

WORDS = 5
ROWS, MISSED = 5, 1e-6
#: Links need 100 * intersection >= percent * union.
PERCENT = 85
#: A pair isn't checked exactly if its similarity, estimated from 120 minima or more, is so far under the threshold: more than five standard deviations.
MARGIN = 0.23
BLOCK_SHINGLES = 60_000

_rng = np.random.default_rng(85_2024)
_A = _rng.integers(0, 2**63, 120, dtype=np.uint64) * U64(2) + U64(1)
_B = _rng.integers(0, 2**63, 120, dtype=np.uint64)


def n_bands(percent: int) -> int:
    return math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** ROWS)))


def functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of n hash functions; fewer are the beginning of more."""
    if n <= 120:
        return _A[:n], _B[:n]
    more = np.random.default_rng(80_2024).integers(0, 2**63, (n - 120, 2), dtype=np.uint64)
    return np.concatenate([_A, more[:, 0] * U64(2) + U64(1)]), np.concatenate([_B, more[:, 1]])


def shingle_set(h: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Sorted distinct shingles of a document's word hashes; fewer than k words make one."""
    if not len(h):
        return h
    return np.unique(grams(h, k)) if len(h) >= k else np.array([whole(h)], np.uint64)


def minima(s: np.ndarray, n: int = 120) -> np.ndarray:
    """Strongly universal multiply-add-shift minima of a non-empty set, by hash function."""
    x, least, (a, b) = s >> U64(32), None, functions(n)
    for at in range(0, len(x), 2048):
        y = ((a[:, None] * x[None, at : at + 2048] + b[:, None]) >> U64(32)).min(1)
        least = y if least is None else np.minimum(least, y)
    return least.astype(np.uint32)


def band_keys(m: np.ndarray) -> np.ndarray:
    m = m.reshape(-1, ROWS)
    x = np.arange(1, len(m) + 1, dtype=np.uint64)
    for k in range(ROWS):
        x = mix(x * U64(0xD6E8FEB86659FD93) + m[:, k].astype(np.uint64))
    return x.view(np.int64)


def shingle_sets(batch: list[bytes]) -> list[np.ndarray]:
    data, offsets = binary_column(pa.array([t.lower() for t in batch], pa.large_binary()))  # bytes.lower() changes A-Z only
    h, at = hash_words(data, offsets)
    return [shingle_set(h[a:b]) for a, b in zip(at[:-1], at[1:])]


def sketch(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits, null if empty) and band keys of every document."""
    n = ROWS * n_bands(percent)

    def work(batch: list[bytes]) -> dict:
        sets = shingle_sets(batch)
        return {
            "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "set_key": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
            "bands": pa.array([band_keys(minima(s, n)) if len(s) else [] for s in sets], pa.list_(pa.int64())),
        }

    return map_texts(docs, work, "n_shingles long, set_key binary, bands array<bigint>")


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(node, component) of documents that share a bucket with another, by stars around buckets' smallest ids."""
    members = classes.select("rep", F.explode("bands").alias("bucket"))
    stars = members.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").select("bucket", "hub")
    # written, so that a hot bucket's partition of the join can be split
    return components(members.join(written(stars, "stars").hint("merge"), "bucket").select(F.col("hub").alias("a"), F.col("rep").alias("b")))


def _shared(own: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of one sorted set with others."""
    at = np.cumsum([0, *(len(s) for s in sets)])
    flat = np.concatenate(sets)
    k = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    return np.add.reduceat((own[k] == flat).astype(np.int64), at[:-1])


class Clusters:
    """Members of one task with their sets and clusters; links merge clusters."""

    def __init__(self, sets: list[np.ndarray], labels: list, percent: int):
        self.sets, self.percent = sets, percent
        self.size = np.array([len(s) for s in sets])
        self.signatures = np.stack([minima(s) for s in sets])
        number: dict = {}
        self.root = np.array([number.setdefault(x, len(number)) for x in labels])

    def join(self, x: int, others: np.ndarray) -> None:
        """Merge x's cluster with those of the others that are near, most similar first."""
        others = others[100 * np.minimum(self.size[others], self.size[x]) >= self.percent * np.maximum(self.size[others], self.size[x])]
        if not len(others):
            return
        same = np.concatenate([(self.signatures[others[k : k + 2048]] == self.signatures[x]).mean(1) for k in range(0, len(others), 2048)])
        order = np.argsort(-same, kind="stable")
        near = others[order[same[order] >= self.percent / 100 - MARGIN]]
        step = 1
        while len(near):
            # few at a time first: the most similar one often joins the cluster of all
            part, near = near[:step], near[step:]
            step = min(4 * step, max(1, 2_000_000 // int(self.size[x] + 1)))
            n = _shared(self.sets[x], [self.sets[j] for j in part])
            for j in part[100 * n >= self.percent * (self.size[x] + self.size[part] - n)].tolist():
                if self.root[j] != self.root[x]:
                    self.root[self.root == self.root[j]] = self.root[x]
            near = near[self.root[near] != self.root[x]]


def links(sets: list[np.ndarray], labels: list, left: np.ndarray | None = None, percent: int = PERCENT) -> list[tuple]:
    """(label, smallest label of its cluster) after all links between documents; with `left`, only those between the left ones and the others."""
    c = Clusters(sets, labels, percent)
    right = None if left is None else np.flatnonzero(~left)
    for x in (range(len(sets)) if left is None else np.flatnonzero(left).tolist()):
        pool = np.arange(x) if right is None else right
        pool = pool[c.root[pool] != c.root[x]]
        firsts = pool[np.unique(c.root[pool], return_index=True)[1]]
        c.join(x, firsts)  # one of each cluster
        if len(firsts) < len(pool):
            pool = np.setdiff1d(pool, firsts, assume_unique=True)
            c.join(x, pool[c.root[pool] != c.root[x]])
    least: dict = {}
    for r, x in zip(c.root.tolist(), labels):
        least[r] = min(least.get(r, x), x)
    return [(x, least[r]) for x, r in dict(zip(labels, c.root.tolist())).items() if least[r] != x]


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal keys of sorted batches, as one table each."""
    parts: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        values = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        at = 0
        for k in range(1, len(values) + 1):
            if k == len(values) or values[k] != values[at]:
                if parts and values[at] != last:
                    yield last, pa.Table.from_batches(parts)
                    parts = []
                parts.append(batch.slice(at, k - at))
                last, at = values[at], k
    if parts:
        yield last, pa.Table.from_batches(parts)


def compare(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): labels and the smallest label that they are linked to, of rows (text, component, label, block, i, j).

    Rows are compared inside block i where i = j, else between the blocks i and j.
    """
    keys = ["component", "i", "j"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), group in by_key(batches, keys):
            left = None if i == j else np.array(group.column("block").to_pylist()) == i
            if group.num_rows > 1:
                found = links(shingle_sets(group.column("text").to_pylist()), group.column("label").to_pylist(), left, percent)
                kind = group.schema.field("label").type
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], kind), "b": pa.array([x for _, x in found], kind)})

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("text", "label", "block", *keys).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, f"a {kind}, b {kind}")


def _blocks(shingles) -> Column:
    return F.greatest(F.lit(1), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _dealt(blocks, seed: int) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(seed)), F.col(blocks)).cast("int")


def _relabelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows whose label is replaced by the label that it was linked to, if any."""
    new = found.select(F.col("a").alias("label"), F.col("b").alias("new"))
    return rows.join(new.hint("merge"), "label", "left").withColumn("label", F.coalesce("new", "label")).drop("new")


def verified_links(docs: DataFrame, groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links on full sets inside candidate groups (node, component, n_shingles), enough of them to join what is linked."""
    sizes = groups.groupBy("component").agg(_blocks(F.sum("n_shingles")).alias("blocks"))
    placed = groups.join(written(sizes, "sizes").hint("merge"), "component")
    placed = placed.withColumn("block", _dealt("blocks", 0)).withColumn("label", F.col("node"))
    members = written(texts(docs).join(placed.hint("merge"), F.col("doc_id") == F.col("node")), "members")
    inside = lambda rows: rows.withColumns({"i": F.col("block"), "j": F.col("block")})
    found = written(compare(inside(members), percent), "links")
    large = members.where("blocks > 1").select("node", "text", "component")
    if large.isEmpty():
        return found
    # each document of a large group is in one block, so its label there is known without further rounds
    labels = _relabelled(placed.where("blocks > 1").select("node", "component", "n_shingles", "label"), found)

    # the first documents of all clusters
    firsts = labels.where("node = label").drop("label")
    few = firsts.groupBy("component").agg(_blocks(F.sum("n_shingles")).alias("few"))
    firsts = firsts.select("node", "component").join(written(few, "sizes").hint("merge"), "component").withColumn("block", _dealt("few", 1)).drop("component")
    across = written(compare(inside(large.join(firsts.hint("merge"), "node").withColumn("label", F.col("node"))), percent), "links")

    # documents outside a group's largest cluster, with all others
    labels = written(_relabelled(labels, across), "labels")
    clusters = labels.groupBy("component", "label").agg(F.sum("n_shingles").alias("total"))
    main = clusters.groupBy("component").agg(F.max(F.struct("total", "label")).alias("most"), F.sum("total").alias("total"), F.count("*").alias("n")).where("n > 1")
    main = main.select("component", F.col("most.label").alias("main"), _blocks(F.col("most.total")).alias("inner"), _blocks(F.col("total") - F.col("most.total")).alias("outer"))
    open_ = labels.select("node", "component", "label").join(written(main, "open").hint("merge"), "component")
    is_main = F.col("label") == F.col("main")
    open_ = open_.withColumn("block", F.when(is_main, _dealt("inner", 2)).otherwise(F.col("inner") + _dealt("outer", 2)))
    # a document of the largest cluster meets the outer blocks, any other one all blocks
    other = F.explode(F.sequence(F.when(is_main, F.col("inner")).otherwise(0), F.col("inner") + F.col("outer") - 1))
    pairs = large.join(open_.drop("component").hint("merge"), "node").withColumn("other", other)
    pairs = pairs.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    return found.unionByName(across).unionByName(written(compare(pairs, percent), "links"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; links from a similarity of percent on."""
    sketches = written(sketch(docs, percent), "sketches")
    known = sketches.where("set_key is not null and doc_id is not null")
    first = known.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("first"))
    classes = written(first.select("set_key", F.col("first.doc_id").alias("rep"), "first.n_shingles", "first.bands"), "classes")
    groups = candidate_groups(classes)
    sized = groups.join(classes.groupBy(F.col("rep").alias("node")).agg(F.max("n_shingles").alias("n_shingles")).hint("merge"), "node")
    groups = written(sized, "groups")
    found = components(verified_links(docs, groups, percent))
    labels = classes.select("set_key", "rep").join(found.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
    labels = labels.select("set_key", F.coalesce("component", "rep").alias("component"))
    result = sketches.select("doc_id", "n_shingles", "set_key").join(labels.hint("merge"), "set_key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return result.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
