"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text.  Windows of
whole texts tell little apart here, as toxic text is mostly ordinary words; so the toxic
dictionary is trained on what toxic rows have more often than ordinary rows: their words
and word beginnings that are significant by log-likelihood ratio (the STRINGS strongest at a
false discovery rate of FALSE_RATE, and all at SURE_RATE), in the order of the texts.  It is
used in front of the ordinary one, so common text costs the same in both.  A window of text
that the toxic side packs better is closer to toxic text; a document's score is a logistic
function of how much and how often its windows are, with weights and thresholds calibrated
on the training rows.

Training uses labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most
TOXIC_ROWS and ORDINARY_ROWS of them (smallest hashes of the id) with texts of at most
TRAIN_BYTES; weights restore the labels' shares.  Tasks count strings, cut samples and
measure features; the driver gets at most MOST counts, SAMPLES samples and one row of
features for each training row.  Scoring reads every whole text.

Defined results: a null text is empty and gets the score of a text without any gain; with
fewer than five different texts of either kind every score is the share of toxic labels (0
without labels); of repeated ids in labels the toxic one counts; equal texts count once in
training and get equal scores; a very long text is scored whole, window by window; other
columns are ignored; an empty table gives an empty table; every row gives one row.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, slices, texts, written

TOXIC_ROWS, ORDINARY_ROWS, TRAIN_BYTES = 3_000, 6_000, 65_536
SIZE, STEP = 64, 52
STRATEGY, SEARCH, LEAST_MATCH = zstandard.STRATEGY_GREEDY, 5, 6
ORDINARY_BYTES, TOXIC_BYTES = 2_048, 2_048
#: Training samples for either dictionary: windows of ordinary text, or TOGETHER strings of a toxic one.
SAMPLES, TOGETHER = 60_000, 4
#: Strings that mark toxic text: so many at a false discovery rate of FALSE_RATE, all at SURE_RATE, of the MOST strongest.
STRINGS, FALSE_RATE, SURE_RATE, MOST = 64, 0.01, 1e-9, 4_096
PREFIXES = range(5, 13)
#: Gains in bytes from which windows are counted.
GAINS = range(1, 7)
#: What ends the header of a trained dictionary: zstandard's three first offsets.
_HEADER_END = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: list
    scale: list
    weights: list
    prior: float


def plain(text: bytes) -> bytes:
    """ASCII lower case, single spaces, a space at both ends."""
    return b" " + b" ".join(text.lower().split()) + b" "


class Packer:
    def __init__(self, ordinary: bytes, toxic: bytes):
        raw = zstandard.DICT_TYPE_RAWCONTENT
        # tables wide enough that no dictionary position is overwritten, and a search that sees all candidates
        params = zstandard.ZstdCompressionParameters(window_log=13, hash_log=16, chain_log=14, search_log=SEARCH, min_match=LEAST_MATCH, strategy=STRATEGY, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.packers = []
        for content in (ordinary, toxic + ordinary):  # ordinary text at equal offsets in both
            d = zstandard.ZstdCompressionDict(content, dict_type=raw)
            d.precompute_compress(compression_params=params)
            self.packers.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def features(self, text: bytes) -> list[float]:
        """What the toxic side saves: most, mean of the three most, mean, and how many windows save how much."""
        x, (ordinary, toxic) = plain(text), self.packers
        gain = np.array([len(ordinary(w)) - len(toxic(w)) for w in (x[i : i + SIZE] for i in range(0, max(1, len(x) - SIZE + STEP), STEP))], float)
        top = np.sort(gain)[::-1]
        counts = [int((gain >= g).sum()) for g in GAINS]
        return [top[0], top[:3].mean(), gain.mean(), math.log(len(gain)), *(n / len(gain) for n in counts), *(math.log1p(n) for n in counts)]


def _g2(a: int, b: int, na: int, nb: int) -> float:
    p, out = (a + b) / (na + nb), 0.0
    for seen, total in ((a, na), (b, nb)):
        for o, e in ((seen, total * p), (total - seen, total * (1 - p))):
            out += 2 * o * math.log(o / e) if o else 0.0
    return out


def _strings(text: bytes) -> set[bytes]:
    words = {*text.split()}
    return {b" " + w[:n] for w in words for n in PREFIXES if len(w) >= n} | {b" " + w + b" " for w in words}


def _own_strings(text: bytes, marks: set[bytes]) -> list[bytes]:
    """The words of a text that are marks or begin with one, in order: the mark itself."""
    out = []
    for w in text.split():
        forms = (b" " + w + b" ", *(b" " + w[:n] for n in reversed(PREFIXES) if len(w) >= n))
        out += [f for f in forms if f in marks][:1]
    return out


def significant(counts: list[tuple[bytes, int, int]], n_toxic: int, n_ordinary: int, n_tested: int) -> set[bytes]:
    """The strings (string, toxic rows, ordinary rows) that pass Benjamini and Hochberg's bound."""
    ranked = sorted(((_g2(a, b, n_toxic, n_ordinary), s) for s, a, b in counts), reverse=True)
    passed = lambda rate: max((k for k, (g, _) in enumerate(ranked, 1) if 0.5 * math.erfc(math.sqrt(g / 2)) <= rate * k / n_tested), default=0)
    return {s for _, s in ranked[: max(min(passed(FALSE_RATE), STRINGS), passed(SURE_RATE))]}


def dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a dictionary trained by zstandard; of too few samples, the most frequent ones, last."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=LEAST_MATCH).as_bytes().split(_HEADER_END, 1)[-1]
    except zstandard.ZstdError:
        return b"".join(sorted(dict.fromkeys(sorted(samples)), key=Counter(samples).__getitem__))[-size:]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, share: float) -> tuple[list, list, list]:
    """Means, scales and weights of a logistic function; rows weigh so that a `share` of them is toxic."""
    sample = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-3] * (len(w) - 1) + [0])
    for _ in range(40):  # Newton steps
        p = _sigmoid(z @ w)
        h = (z * (sample * p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w))
        w -= np.linalg.solve(h, z.T @ (sample * (p - y)) + ridge @ w)
    return mean.tolist(), scale.tolist(), w.tolist()


def score(batch: list[bytes], model: Model) -> np.ndarray:
    if not model.weights:
        return np.full(len(batch), model.prior)
    packer = Packer(model.ordinary, model.toxic)
    x = (np.array([packer.features(t) for t in batch]) - model.mean) / model.scale
    return _sigmoid((x * model.weights[:-1]).sum(1) + model.weights[-1])  # row by row: a batch's size changes no score


def _map(rows: DataFrame, work: Callable[[Iterator[tuple[bytes, int]]], Iterator[dict]], schema: str) -> DataFrame:
    """Rows made from the (text, toxic) of a task's training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (p for batch in batches for part in slices(batch) for p in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()))
        for columns in work(pairs):
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, schema)


def _count_strings(rows: Iterator[tuple[bytes, int]]) -> Iterator[dict]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for text, toxic in rows:
        counts[toxic].update(_strings(plain(text)))
        if len(counts[0]) + len(counts[1]) > 500_000:
            yield from _counted(counts)
            counts = (Counter(), Counter())
    yield from _counted(counts)


def _counted(counts: tuple[Counter, Counter]) -> Iterator[dict]:
    for toxic in (0, 1):
        n = list(counts[toxic].values())
        yield {"string": pa.array(list(counts[toxic]), pa.binary()), "a": pa.array(n if toxic else [0] * len(n), pa.int64()), "b": pa.array([0] * len(n) if toxic else n, pa.int64())}


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(text, toxic) of the training rows, different texts only, and the toxic share of all usable labels."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    usable = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    counts = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    pick = lambda v, n: usable.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    # at most TOXIC_ROWS + ORDINARY_ROWS ids: small enough to broadcast, whatever the corpus
    picked = F.broadcast(pick(1, TOXIC_ROWS).unionByName(pick(0, ORDINARY_ROWS)))
    rows = texts(docs).where(F.length("text") <= TRAIN_BYTES).join(picked, "doc_id").select("text", "toxic").dropDuplicates()
    return written(rows, "training"), counts.get(1, 0) / total if total else 0.0


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows, share = training_rows(docs, labels)
    # small and read several times: spread evenly
    rows = rows.repartition(max(8, rows.sparkSession.sparkContext.defaultParallelism), F.xxhash64("text"))
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if min(n.get(0, 0), n.get(1, 0)) < 5:
        return Model(b"", b"", [], [], [], share)
    counts = _map(rows, _count_strings, "string binary, a long, b long").groupBy("string").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a >= 2")
    counts = written(counts, "strings")
    # more often in toxic rows, the most significant differences of rates
    surplus = F.col("a") / n[1] - F.col("b") / n[0]
    rates = (F.col("a") + F.col("b")) / (n[1] + n[0])
    by_chi = counts.where(surplus > 0).orderBy(F.desc(surplus * surplus / (rates * (1 - rates) + 1e-12)), "string").limit(MOST)
    marks = significant([(bytes(r.string), r.a, r.b) for r in by_chi.collect()], n[1], n[0], max(1, counts.count()))

    def windows(pairs: Iterator[tuple[bytes, int]]) -> Iterator[dict]:
        for text, toxic in pairs:
            x = plain(text)
            if toxic:
                own = _own_strings(x, marks)
                made = [b"".join(own[i : i + TOGETHER]).replace(b"  ", b" ") for i in range(0, len(own), TOGETHER)]
            else:
                made = [x[i : i + SIZE] for i in range(0, len(x), SIZE)]
            key = xxhash.xxh3_64_intdigest(text) >> 1
            yield {"sample": pa.array(made, pa.binary()), "toxic": pa.array([toxic] * len(made), pa.int32()), "key": pa.array([key] * len(made), pa.int64()), "pos": pa.array(range(len(made)), pa.int32())}

    samples = written(_map(rows, windows, "sample binary, toxic int, key long, pos int"), "samples")
    # whole texts in an order of their own: training takes frequent strings from all over its samples, so equal ones must not lie together
    some = lambda v: [bytes(r.sample) for r in samples.where(F.col("toxic") == v).orderBy("key", "pos").limit(SAMPLES).collect()]
    ordinary, toxic = dictionary(some(0), ORDINARY_BYTES, 24), dictionary(some(1), TOXIC_BYTES, 16)

    def measure(pairs: Iterator[tuple[bytes, int]]) -> Iterator[dict]:
        packer = Packer(ordinary, toxic)
        for text, label in pairs:
            yield {"x": pa.array([packer.features(text)], pa.list_(pa.float64())), "toxic": pa.array([label], pa.int32())}

    measured = _map(rows, measure, "x array<double>, toxic int").collect()
    measured.sort(key=lambda r: (r.toxic, r.x))  # sums in a fixed order
    return Model(ordinary, toxic, *calibrate(np.array([r.x for r in measured]), np.array([float(r.toxic) for r in measured]), share), share)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels)

    def work(batch: list[bytes]) -> dict:
        s = score(batch, model)
        return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= 0.5).astype(np.int32), pa.int32())}

    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return map_texts(docs, work, "score double, predicted int").select("doc_id", held.alias("held_out"), "score", "predicted")


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
