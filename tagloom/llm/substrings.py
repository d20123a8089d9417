"""Substring dedup by repeated-phrase automata.

A word goes if some window of WINDOW consecutive words that covers it also starts earlier,
in a document with a smaller id or in the same one.

1.  Every window holds a minimizer, its smallest-hashed phrase of PHRASE words; equal
    windows have equal minimizers.  Phrases that occur once rule out their windows, so
    only minimizers are shuffled, about one for seven words.
2.  Every document is cut to pieces: runs of windows whose phrases recur and have one
    owner, the smallest document with the phrase.  All places of a window have the same
    owner, so owners can be judged apart; the rest of a text can't match any automaton.
3.  Equal pieces collapse to one row.  For each shard of owners, windows that are there
    twice or more, compared word by word, are the confirmed passages.  They are compiled
    into Aho-Corasick automata of at most PATTERNS windows each, over one character a
    word, and the shard's pieces stream through them.  The hits are the occurrences: of
    each pattern the first place stays, and every other place found is removed.  Pieces'
    hits then go back to all of their copies.

Phrase hashes only decide which text goes to which shard; a collision costs work, never a
result.  Skew: counts are pre-aggregated; distinct pieces of an owner with more than
SHARD_WORDS words are cut to runs of windows with one minimizer, which collapse, are dealt
out by that phrase, and stream through automata in the same way; those of a phrase with more
than SHARD_WORDS words are cut to single windows, dealt out by their own hash.  A piece is
joined with each of its distinct parts once, so joins have no more rows than the text has words.

Defined results: a null text has no words; a null doc_id neither removes nor loses words;
doc_id may be of any type that Spark orders, and of either sign; rows with equal id and
text are the same document; different texts with one id rank their windows by start alone, so
that of two equal windows the one with the smaller start is earlier and of equal starts
neither is; a very long text is cut to many pieces; other columns are
ignored, whatever their names; an empty table gives an empty table; every row gives one row.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts, written
from .words import binary_column, grams, hash_words

WINDOW = 20
PHRASE = 8
SPAN = WINDOW - PHRASE + 1
#: Longest piece in windows, words of one shard, and windows of one automaton (about 1.6 KB each).
PIECE_WINDOWS = 400
SHARD_WORDS = 100_000
PATTERNS = 50_000
#: Owners up to this number are broadcast (8 bytes each); more are joined by a salted key.
BROADCAST_OWNERS, SALTS = 200_000, 64


def minimizers(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase hashes of a word sequence, and the position of each window's minimizer (the first of equals)."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = grams(h, PHRASE)
    least, at = g[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, SPAN):
        less = g[k : k + n] < least
        np.copyto(least, g[k : k + n], where=less)
        np.copyto(at, k, where=less)
    return g, at + np.arange(n)


def windows_of(at: np.ndarray) -> np.ndarray:
    """First words of all windows inside one of the sequences that `at` bounds."""
    n = int(at[-1])
    end = np.repeat(at[1:], np.diff(at))
    return np.flatnonzero(np.arange(n) + WINDOW <= end)


def _hashed(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return hash_words(*binary_column(part.column("text")))


def phrases(docs: DataFrame) -> DataFrame:
    """(h, doc_id, pos): minimizers of all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, at = _hashed(part)
                g, m = minimizers(h)
                m = np.unique(m[windows_of(at)]) if len(m) else m
                doc = np.searchsorted(at, m, "right") - 1
                yield pa.RecordBatch.from_pydict({"h": pa.array(g[m].view(np.int64)), "doc_id": part.column("doc_id").take(pa.array(doc)), "pos": pa.array((m - at[doc]).astype(np.int32))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).where("doc_id is not null").mapInArrow(run, f"h long, doc_id {kind}, pos int")


def _cut(m: np.ndarray, pos: np.ndarray, owners: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(owner, first window, number of windows) of a document's pieces; m has its windows' minimizers."""
    if not len(m):
        return
    owner, recurs = np.zeros(int(m[-1]) + 1, np.int64), np.zeros(int(m[-1]) + 1, bool)
    inside = pos < len(owner)
    owner[pos[inside]], recurs[pos[inside]] = owners[inside], True
    own, has = owner[m], recurs[m]
    edges = np.flatnonzero((np.diff(own) != 0) | (has[1:] != has[:-1])) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(own)]):
        if has[a]:
            for s in range(a, b, PIECE_WINDOWS):
                yield int(own[a]), s, min(PIECE_WINDOWS, b - s)


def cut_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, whole_sha256, pieces and, where there are any, text: all documents with what may recur in them."""
    seeds = phrases(docs)
    # written, so that both sides of the join are shuffles and a hot phrase's partition can be split
    recurring = written(seeds.groupBy("h").agg(F.count("*").alias("n"), F.xxhash64(F.min("doc_id")).alias("owner")).where("n > 1").select("h", "owner"), "recurring")
    found = seeds.join(recurring.hint("merge"), "h").groupBy("doc_id").agg(F.collect_list("pos").alias("pos"), F.collect_list("owner").alias("owners"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, at = _hashed(part)
                m = minimizers(h)[1]
                lists = {}
                for c in ("pos", "owners"):
                    column = part.column(c).fill_null([])
                    lists[c] = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    cuts = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)
                every, shas, kept = [], [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    a, b = int(cuts[k]), int(cuts[k + 1])
                    last = max(int(at[k]), int(at[k + 1]) - WINDOW + 1)
                    own = m[int(at[k]) : last] - at[k]
                    pieces = [{"owner": o, "start": s, "n": n} for o, s, n in _cut(own, lists["pos"][a:b], lists["owners"][a:b])] if b > a else []
                    every.append(pieces)
                    shas.append(None if pieces else hashlib.sha256(b" ".join((text or b"").split())).hexdigest())
                    kept.append(text if pieces else None)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"),
                    "n_words": pa.array(np.diff(at)),
                    "whole_sha256": pa.array(shas, pa.string()),
                    "text": pa.array(kept, pa.binary()),
                    "pieces": pa.array(every, pa.list_(pa.struct([("owner", pa.int64()), ("start", pa.int64()), ("n", pa.int64())]))),
                })

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, whole_sha256 string, text binary, pieces array<struct<owner:bigint,start:bigint,n:bigint>>"
    return texts(docs).join(found.hint("merge"), "doc_id", "left").mapInArrow(run, schema)


def cut_pieces(cut: DataFrame) -> DataFrame:
    """(id, owner, doc_id, text_key, start, n, words) of every piece; id is a digest of owner and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows: dict[str, list] = {k: [] for k in ("id", "owner", "doc_id", "text_key", "start", "n", "words")}
                for doc_id, text, pieces in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "pieces"))):
                    words, key = text.split(), xxhash.xxh3_64_intdigest(text) >> 1
                    for p in pieces:
                        own = b" ".join(words[p["start"] : p["start"] + p["n"] + WINDOW - 1])
                        for k, v in zip(rows, (xxhash.xxh3_128_digest(p["owner"].to_bytes(8, "little", signed=True) + own), p["owner"], doc_id, key, p["start"], p["n"], own)):
                            rows[k].append(v)
                yield pa.RecordBatch.from_pydict({"id": pa.array(rows["id"], pa.binary()), "owner": pa.array(rows["owner"], pa.int64()), "doc_id": pa.array(rows["doc_id"], part.schema.field("doc_id").type), "text_key": pa.array(rows["text_key"], pa.int64()), "start": pa.array(rows["start"], pa.int64()), "n": pa.array(rows["n"], pa.int64()), "words": pa.array(rows["words"], pa.binary())})

    kind = cut.schema["doc_id"].dataType.simpleString()
    return cut.where("size(pieces) > 0").select("doc_id", "text", "pieces").mapInArrow(run, f"id binary, owner long, doc_id {kind}, text_key long, start long, n long, words binary")


def cut_parts(distinct: DataFrame, single: bool) -> DataFrame:
    """(id, shard, piece, at, n, doc_id, start, copies, words) of parts of distinct pieces: runs of windows with one minimizer, or single windows.

    A piece has one row for equal parts, with their places `at`; start is the first one's. id is a digest of a part's words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                h, bounds = hash_words(*binary_column(part.column("words")))
                g, m = minimizers(h)
                rows: dict[str, list] = {k: [] for k in ("id", "shard", "piece", "at", "n", "doc_id", "start", "copies", "words")}
                for k, (piece, doc_id, start, copies, text) in enumerate(zip(*(part.column(c).to_pylist() for c in ("id", "doc_id", "start", "copies", "words")))):
                    words = text.split(b" ")
                    least = g[m[int(bounds[k]) : int(bounds[k + 1]) - WINDOW + 1]]
                    edges = range(len(least) + 1) if single else [0, *(np.flatnonzero(least[1:] != least[:-1]) + 1).tolist(), len(least)]
                    places: dict[bytes, list[int]] = {}
                    for a, b in zip(edges, edges[1:]):
                        places.setdefault(b" ".join(words[a : b + WINDOW - 1]), []).append(a)
                    for own, at in places.items():
                        digest = xxhash.xxh3_128_digest(own)
                        shard = int.from_bytes(digest[:8], "little", signed=True) if single else int(least[at[0]].view(np.int64))
                        for c, v in zip(rows, (digest, shard, piece, at, own.count(b" ") - WINDOW + 2, doc_id, start + at[0], copies * len(at), own)):
                            rows[c].append(v)
                kinds = {"id": pa.binary(), "piece": pa.binary(), "at": pa.list_(pa.int64()), "doc_id": part.schema.field("doc_id").type, "words": pa.binary()}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()})

    kind = distinct.schema["doc_id"].dataType.simpleString()
    return distinct.select("id", "doc_id", "start", "copies", "words").mapInArrow(run, f"id binary, shard long, piece binary, at array<long>, n long, doc_id {kind}, start long, copies long, words binary")


def _spell(pieces: list[bytes]) -> tuple[str, np.ndarray]:
    """All pieces as one string of a character a word, each after a character that is no word, and where they start."""
    split = [p.split(b" ") for p in pieces]
    # surrogates are left out, and 0 is no word
    number = {w: chr(k if k < 0xD800 else k + 0x800) for k, w in enumerate(dict.fromkeys(w for p in split for w in p), 1)}
    starts = np.cumsum([1, *(len(p) + 1 for p in split)])[:-1]
    return "".join("\0" + "".join(map(number.__getitem__, p)) for p in split), starts


def confirm(text: str, starts: list[int], ends: list[int], copies: list[int]) -> list[str]:
    """Windows, word by word, that are in the pieces twice or more, copies counted."""
    counts: Counter = Counter()
    for a, b, n in zip(starts, ends, copies):
        windows = [text[i : i + WINDOW] for i in range(a, b - WINDOW + 1)]
        counts.update(windows)
        if n > 1:
            counts.update(windows)
    return [w for w, n in counts.items() if n > 1]


def locate(text: str, passages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(passage, place) of every occurrence of the passages in the text, by automata of at most PATTERNS of them."""
    found = [np.zeros((0, 2), np.int64)]
    for k in range(0, len(passages), PATTERNS):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, passage in enumerate(passages[k : k + PATTERNS], k):
            automaton.add_word(passage, number)
        automaton.make_automaton()
        hits = np.fromiter(chain.from_iterable(automaton.iter(text)), np.int64).reshape(-1, 2)
        found.append(np.stack([hits[:, 1], hits[:, 0] - WINDOW + 1], 1))
    return tuple(np.concatenate(found).T)


def _runs(flags: np.ndarray, starts: np.ndarray) -> list[list[dict]]:
    """By piece, half-open ranges of true flags, counted from the piece's start."""
    out: list[list[dict]] = [[] for _ in starts]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    piece = np.searchsorted(starts, edge[::2], "right") - 1
    for k, a, b in zip(piece.tolist(), (edge[::2] - starts[piece]).tolist(), (edge[1::2] - starts[piece]).tolist()):
        out[k].append({"a": a, "b": b})
    return out


def judge_shard(pieces: list[tuple[bytes, int, object, int]]) -> tuple[list[list[dict]], list[list[dict]]]:
    """Of pieces (words, copies, doc_id and start of the first copy): windows located, and of them those that are not the first, as ranges."""
    text, starts = _spell([p[0] for p in pieces])
    ends = [*(starts[1:] - 1).tolist(), len(text)]
    passage, place = locate(text, confirm(text, starts.tolist(), ends, [p[1] for p in pieces]))
    piece = np.searchsorted(starts, place, "right") - 1
    number = {d: k for k, d in enumerate(sorted({p[2] for p in pieces}))}
    doc = np.array([number[p[2]] for p in pieces])[piece]
    start = np.array([p[3] for p in pieces])[piece] + place - starts[piece]
    order = np.lexsort((start, doc, passage))
    new = np.concatenate([[True], np.diff(passage[order]) != 0])[: len(order)]
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    later = (doc[order] != doc[lead]) | (start[order] != start[lead])
    located, gone = np.zeros(len(text), bool), np.zeros(len(text), bool)
    located[place] = True
    gone[place[order[later]]] = True
    return _runs(located, starts), _runs(gone, starts)


_RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def judge_pieces(distinct: DataFrame) -> DataFrame:
    """(id, doc_id, start, located, gone): of each distinct piece its first copy's place, its located windows, and those which that copy loses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            located, gone = judge_shard([(r[1], r[2], r[3], r[4]) for r in rows])
            return pa.RecordBatch.from_pydict({
                "id": pa.array([r[0] for r in rows], pa.binary()), "doc_id": pa.array([r[3] for r in rows], kind), "start": pa.array([r[4] for r in rows], pa.int64()),
                "located": pa.array(located, _RANGES), "gone": pa.array(gone, _RANGES),
            })

        last = kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for shard, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "id", "words", "copies", "doc_id", "start"))):
                if held > SHARD_WORDS and shard != last:
                    yield flush()
                    rows, held = [], 0
                rows.append(tuple(row))
                held += row[1].count(b" ") + 1
                last = shard
        if rows:
            yield flush()

    kind = distinct.schema["doc_id"].dataType.simpleString()
    dealt = distinct.repartition("shard").sortWithinPartitions("shard")
    ranges = "array<struct<a:bigint,b:bigint>>"
    return dealt.mapInArrow(run, f"id binary, doc_id {kind}, start long, located {ranges}, gone {ranges}")


def _split(distinct: DataFrame, large: DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
    """Distinct pieces of shards that are small enough, and of large ones."""
    if few:
        return distinct.join(F.broadcast(large), "shard", "left_anti"), distinct.join(F.broadcast(large), "shard", "left_semi")
    salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    own = distinct.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return tuple(own.join(salted, ["shard", "salt"], how).drop("salt") for how in ("left_anti", "left_semi"))


def _distinct(pieces: DataFrame, copies: Column) -> DataFrame:
    """Equal pieces as one row, with the place of the first."""
    first = F.min(F.struct("doc_id", "start")).alias("first")
    found = pieces.groupBy("id").agg(first, copies.alias("copies"), *(F.any_value(c).alias(c) for c in ("shard", "n", "words")))
    return found.select("id", "shard", "first.doc_id", "first.start", "copies", "n", "words")


def _moved(ranges: Column, by: Column) -> Column:
    return F.transform(ranges, lambda r: F.struct((r["a"] + by).alias("a"), (r["b"] + by).alias("b")))


def judge(distinct: DataFrame, single: bool = False) -> DataFrame:
    """What judge_pieces finds in distinct pieces (a written table); those of large shards are judged by way of their parts."""
    large = distinct.groupBy("shard").agg(F.sum(F.col("n") + WINDOW).alias("words")).where(F.col("words") > SHARD_WORDS).select("shard")
    large = written(large, "large")
    if not (found := large.count()):
        return judge_pieces(distinct)
    small, big = _split(distinct, large, found <= BROADCAST_OWNERS)
    parts = cut_parts(big, single)
    own = _distinct(parts, F.sum("copies"))
    judged = judge_pieces(own.where("copies > 1")) if single else judge(written(own, "parts"), single=True)
    judged = judged.where("size(located) > 0").select("id", F.struct("doc_id", "start").alias("first"), "located", "gone")
    back = parts.select("id", "piece", "at", F.struct("doc_id", "start").alias("own")).join(judged.hint("merge"), "id")
    every = F.flatten(F.transform("at", lambda j: _moved(F.col("located"), j)))
    # the first of equal parts may hold first windows; all others lose what was located in them
    others = F.flatten(F.transform(F.slice("at", 2, F.size("at")), lambda j: _moved(F.col("located"), j)))
    lost = F.when(F.col("own") == F.col("first"), F.concat(_moved(F.col("gone"), F.col("at")[0]), others)).otherwise(every)
    # under names of their own: an alias `located` beside it would be taken for the column
    hits = back.select(F.col("piece").alias("id"), every.alias("hits"), lost.alias("lost"))
    gathered = hits.groupBy("id").agg(F.flatten(F.collect_list("hits")).alias("located"), F.flatten(F.collect_list("lost")).alias("gone"))
    none = F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)")
    big = big.select("id", "doc_id", "start").join(gathered.hint("merge"), "id", "left").withColumns({c: F.coalesce(c, none) for c in ("located", "gone")})
    return judge_pieces(small).unionByName(big)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    cut = written(cut_documents(docs), "cut")
    pieces = cut_pieces(cut)
    distinct = written(_distinct(pieces.withColumnRenamed("owner", "shard"), F.count("*")), "pieces")
    judged = written(judge(distinct), "judged")
    first = judged.select("id", F.struct("doc_id", "start").alias("first"), "located", "gone")
    copies = pieces.select("id", "doc_id", "text_key", "start").join(first.hint("merge"), "id")
    is_first = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.start") == F.col("start"))
    gone = _moved(F.when(is_first, F.col("gone")).otherwise(F.col("located")), F.col("start"))
    ranges = copies.select("doc_id", "text_key", gone.alias("gone")).where("size(gone) > 0").groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("gone")).alias("gone"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas = [], []
            for text, ranges, keys in zip(*(batch.column(c).to_pylist() for c in ("text", "gone", "keys"))):
                words = np.array(text.split(), object)
                keep = np.ones(len(words), bool)
                own = xxhash.xxh3_64_intdigest(text) >> 1
                for rs, key in zip(ranges or (), keys or ()):
                    if key == own:
                        for r in rs:
                            keep[r["a"] : r["b"] + WINDOW - 1] = False
                removed.append(int(len(words) - keep.sum()))
                shas.append(hashlib.sha256(b" ".join(words[keep])).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": shas})

    by_doc = ranges.groupBy("doc_id").agg(F.collect_list("gone").alias("gone"), F.collect_list("text_key").alias("keys"))
    touched = cut.where("size(pieces) > 0").select("doc_id", "n_words", "text").join(by_doc.hint("merge"), "doc_id", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    done = touched.mapInArrow(finish, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
    rest = cut.where("size(pieces) = 0").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("whole_sha256").alias("kept_sha256"))
    return done.unionByName(rest)
