"""Benchmark decontamination by CGK embedding and bit sampling.

The CGK random walk copies a word sequence step by step and moves on to the next word
when a random bit of (word, step) says so; sequences a few edits apart fall back into step,
so edit distance becomes Hamming distance.  Keys made of a few sampled steps of several
walks are looked up for every item-sized window; what collides is verified by the exact
word-level edit distance of the whole item to the text around the window.

Items are matched with at most len(item) // EDIT_SHARE edits, on words of ASCII-lower-cased
text with ASCII punctuation as space.  Each edit costs a window one word of the item at
most, so windows with fewer benchmark words, or fewer rare ones, than every match needs
are skipped, which loses nothing.  WALKS and SAMPLES are set for a recall above
0.95 at the largest distance (see tests); exact copies always collide.

The benchmark is a query set.  It is read in blocks of at most about BLOCK items and
BLOCK_BYTES bytes; with more than one, each block is a pass over the documents of its own,
whose result is written before the next block is broadcast, so a worker holds one block.

Defined results: null texts and items, and items without words, match nothing; equal items
with the same id count once; repeated documents are judged each; very long texts are read
whole; other columns are ignored or kept as they are, whatever their names; an empty table of
documents gives an empty table, an empty benchmark no match.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import map_texts, unused, written
from .words import U64, binary_column, hash_words, mix

EDIT_SHARE = 5
WALKS, SAMPLES, PICKS = 6, 8, 4
COMMON = 0.02
SIEVE_BITS = 20
_SIEVE = U64((1 << SIEVE_BITS) - 1)
BLOCK, BLOCK_BYTES = 5_000, 8 << 20
GROWTH = 1.25
_SPACED = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_PAD = U64(0x5BD1E9955BD1E995)


def words_of(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return hash_words(*binary_column(pa.array([t.lower().translate(_SPACED) for t in batch], pa.large_binary())))


def _lengths(n: int) -> int:
    """The class of an item's length: the window that stands for it, at most its length."""
    low = 1
    while int(low * GROWTH) + 1 <= n:
        low = int(low * GROWTH) + 1
    return low


def _picks(low: int) -> np.ndarray:
    """Sampled steps by walk and sample; the walk covers `low` words in about twice as many steps."""
    rng = np.random.default_rng(low)
    steps = max(1, int(1.8 * low))
    return np.sort(rng.integers(0, steps, (WALKS, SAMPLES, PICKS)), axis=2)


def step_bits(h: np.ndarray, walk: int) -> np.ndarray:
    """A walk's own hash of every word, whose bits decide its steps; one more entry pads."""
    return mix(np.append(h, _PAD) ^ U64(walk + 1))


def walk_keys(own: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: int, walk: int) -> np.ndarray:
    """Keys of the windows [starts, ends) of at most `low` words by one walk: shape (SAMPLES, len(starts))."""
    picks = _picks(low)[walk]
    wanted = {int(s) for s in picks.ravel()}
    at, seen, pad = starts.copy(), {}, len(own) - 1
    for step in range(max(wanted) + 1):
        symbol = own[np.where(at < ends, at, pad)]
        if step in wanted:
            seen[step] = symbol
        at = at + ((symbol >> U64(step % 64)) & U64(1)).view(np.int64)
    out = np.empty((SAMPLES, len(starts)), np.uint64)
    for sample in range(SAMPLES):
        key = np.full(len(starts), U64(low << 16 | walk << 8 | sample))
        for s in picks[sample]:
            key = mix(key * U64(0xD6E8FEB86659FD93) + seen[int(s)])
        out[sample] = key
    return out


@dataclass
class Items:
    """A block of the benchmark, ready for look-ups."""

    ids: list[list]  # of the items with these words
    words: list[np.ndarray]
    vocabulary: np.ndarray
    rare: np.ndarray  # of the vocabulary: in less than COMMON of all items
    classes: list[tuple]  # window length, least words of the vocabulary, least rare ones, sieve of keys, sorted keys, their items


def prepare(rows: list[tuple]) -> Items:
    h, at = words_of([t for _, t in rows])
    words = [h[a:b] for a, b in zip(at[:-1], at[1:])]
    same: dict[bytes, list[int]] = {}  # items of equal words are looked up and compared once
    for k, w in enumerate(words):
        if len(w):
            same.setdefault(w.tobytes(), []).append(k)
    ids, words = [[rows[k][0] for k in ks] for ks in same.values()], [words[ks[0]] for ks in same.values()]
    vocabulary, n_items = np.unique(np.concatenate([np.unique(w) for w in words]), return_counts=True) if words else (np.zeros(0, np.uint64),) * 2
    rare = n_items <= max(1, COMMON * len(words))
    # items that need many rare words are looked up apart from those that need few
    by_class: dict[tuple, list[int]] = {}
    for k, w in enumerate(words):
        low = _lengths(len(w))
        need = int(rare[np.searchsorted(vocabulary, w[:low])].sum()) - len(w) // EDIT_SHARE
        by_class.setdefault((low, 4 * need >= low), []).append(k)
    classes = []
    for (low, _), members in sorted(by_class.items()):
        flat = np.concatenate([words[k] for k in members])
        starts = np.concatenate([[0], np.cumsum([len(words[k]) for k in members])[:-1]])
        keys = np.concatenate([walk_keys(step_bits(flat, walk), starts, starts + low, low, walk) for walk in range(WALKS)])
        order = np.argsort(keys.ravel(), kind="stable")
        sorted_keys = keys.ravel()[order]
        sieve = np.zeros(1 << SIEVE_BITS, bool)
        sieve[(sorted_keys & _SIEVE).astype(np.int64)] = True
        least = low - max(len(words[k]) // EDIT_SHARE for k in members)
        least_rare = min(int(rare[np.searchsorted(vocabulary, words[k][:low])].sum()) - len(words[k]) // EDIT_SHARE for k in members)
        classes.append((low, least, least_rare, sieve, sorted_keys, np.array(members)[order % len(members)]))
    return Items(ids, words, vocabulary, rare, classes)


def edit_distance_inside(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of item to any part of text, and the end of the first such part (bit-parallel)."""
    n, at = len(item), {}
    for k, w in enumerate(item.tolist()):
        at[w] = at.get(w, 0) | 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, end = n, 0
    for j, w in enumerate(text.tolist()):
        eq = at.get(w, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        hp, hm = minus | ~(d | plus) & full, plus & d
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp, hm = hp << 1 & full, hm << 1 & full
        plus, minus = hm | ~(d | hp) & full, hp & d
        if score < best:
            best, end = score, j + 1
    return best, end


def matches(batch: list[bytes], items: Items) -> list[list[dict]]:
    """For each text, its items with the least distance and the words where the match ends."""
    h, at = words_of(batch)
    found: list[dict] = [{} for _ in batch]
    if not len(h) or not len(items.ids):
        return [[] for _ in batch]
    at_vocabulary = np.minimum(np.searchsorted(items.vocabulary, h), len(items.vocabulary) - 1)
    is_known = items.vocabulary[at_vocabulary] == h
    known = np.concatenate([[0], np.cumsum(is_known)])
    rare = np.concatenate([[0], np.cumsum(is_known & items.rare[at_vocabulary])])
    doc = np.repeat(np.arange(len(batch)), np.diff(at))
    end_of = at[1:][doc]
    windows = []
    for low, least, least_rare, *_ in items.classes:
        ends = np.minimum(np.arange(len(h)) + low, end_of)
        starts = np.flatnonzero((known[ends] - known[:-1] >= least) & (rare[ends] - rare[:-1] >= least_rare))
        windows.append((starts, ends[starts]))
    hits = set()
    for walk in range(WALKS):
        own = step_bits(h, walk)
        for (starts, ends), (low, _, _, sieve, keys, owners) in zip(windows, items.classes):
            for part in range(0, len(starts), 20_000):
                got = walk_keys(own, starts[part : part + 20_000], ends[part : part + 20_000], low, walk)
                row, col = np.nonzero(sieve[(got & _SIEVE).astype(np.int64)])
                wanted = got[row, col]
                for c, key, k in zip(col.tolist(), wanted, np.searchsorted(keys, wanted)):
                    while k < len(keys) and keys[k] == key:
                        hits.add((int(starts[part + c]), int(owners[k])))
                        k += 1
    places: dict[tuple[int, int], list[int]] = {}
    for start, item in hits:
        places.setdefault((int(doc[start]), item), []).append(start)
    for (d, item), starts in places.items():
        w = items.words[item]
        most = len(w) // EDIT_SHARE
        parts: list[list[int]] = []  # the words around each place; what overlaps is compared once
        for start in sorted(starts):
            a, b = max(int(at[d]), start - most), min(int(at[d + 1]), start + len(w) + 2 * most)
            if parts and a <= parts[-1][1]:
                parts[-1][1] = max(b, parts[-1][1])
            else:
                parts.append([a, b])
        for a, b in parts:
            distance, end = edit_distance_inside(w, h[a:b])
            if distance <= most:
                one = (distance, a + end - int(at[d]))
                found[d][item] = min(one, found[d].get(item, one))
    return [[{"item": i, "distance": v[0], "end_word": v[1], "item_words": len(items.words[k])} for k, v in sorted(f.items()) for i in items.ids[k]] for f in found]


def _named(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", F.col("text").cast("binary").alias("text")).where("item_id is not null and text is not null")


def item_blocks(benchmark: DataFrame) -> tuple[int, Iterator[list[tuple]]]:
    """How many blocks the benchmark has, and their items (id, text), collected one block at a time; of equal texts the smallest id."""
    rows = _named(benchmark).groupBy("text").agg(F.min("item_id").alias("item_id"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("bytes")).first()
    n = max(1, -(-size.n // BLOCK), -(-size.bytes // BLOCK_BYTES))
    blocks = (rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows for k in range(n))
    return n, (sorted((r.item_id, bytes(r.text)) for r in block.collect()) for block in blocks)


def find_hits(docs: DataFrame, benchmark: DataFrame, items: list[tuple], name: str, *more: str, keep_text: bool = False) -> DataFrame:
    """Every document with an array `name` of its items among these."""
    kind = benchmark.schema["item_id"].dataType
    block = docs.sparkSession.sparkContext.broadcast(prepare(items))
    own = pa.struct([("item", to_arrow_type(kind)), ("distance", pa.int32()), ("end_word", pa.int64()), ("item_words", pa.int32())])

    def work(batch: list[bytes]) -> dict:
        return {name: pa.array(matches(batch, block.value), pa.list_(own))}

    schema = f"`{name}` array<struct<item:{kind.simpleString()},distance:int,end_word:bigint,item_words:int>>"
    return map_texts(docs, work, schema, *more, keep_text=keep_text)


def _each_block(benchmark: DataFrame, step: Callable[[list[tuple]], DataFrame], name: str) -> Iterator[DataFrame]:
    n, blocks = item_blocks(benchmark)
    for items in blocks:
        yield step(items) if n == 1 else written(step(items), name)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item_words, distance, end_word): every document and item that it holds.

    Items of equal text and different ids are looked up once, by a digest of the text; their ids
    are joined to the hits.
    """
    named = _named(benchmark).distinct()
    if named.count() > named.select("text").distinct().count():
        keyed = named.withColumn("_key", F.sha2("text", 256))
        hits = leaks(docs, keyed.select(F.col("_key").alias("item_id"), "text").distinct())
        return hits.withColumnRenamed("item_id", "_key").join(keyed.select("item_id", "_key").hint("merge"), "_key").select(hits.columns)
    hit = F.explode("hits").alias("hit")
    found = _each_block(benchmark, lambda items: find_hits(docs, benchmark, items, "hits").select("doc_id", hit), "leaks")
    return reduce(DataFrame.unionByName, found).select(
        "doc_id", F.col("hit.item").alias("item_id"), F.col("hit.item_words").alias("n_item_words"), F.col("hit.distance").alias("distance"), F.col("hit.end_word").alias("end_word")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns; each block reads what the one before it left."""
    own, others = unused("hits", docs.columns), [c for c in docs.columns if c not in ("doc_id", "text")]
    left = [docs]

    def step(items: list[tuple]) -> DataFrame:
        found = find_hits(left[-1], benchmark, items, own, *others, keep_text=True).where(F.size(own) == 0)
        return found.select(*[F.col("text").cast("string").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])

    for kept in _each_block(benchmark, step, "clean"):
        left.append(kept)
    return left[-1]
