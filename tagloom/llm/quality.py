"""Quality rules: compression bands over whole documents and fixed chunks.

zstandard ratios (bytes / compressed bytes) lie in a narrow band for natural text of a
given length.  Above it a text repeats itself; below it the text is random.  Limits
therefore go by length; the least ones lie a little under the lowest ratios of natural
documents of 50 or more words in sf0.1 and check_s (1.34, 1.35, 1.43, 1.57 and from 1 KB on 1.69 and
more; chunks 1.88), and over those of random base62 words of 2 to 4 letters (at most 1.42
under 1 KB and 1.50 above; longer words give less).  A document also fails if many of its
chunks leave the chunk band, which finds a repetitive or random part inside a long, otherwise
good text.  Chunks are judged from one chunk of text on, and cover all of it: the last one
ends where the text ends.

`fit_bands` narrows the limits of whole documents to what documents labelled as good have:
the outer thousandths of their ratios in each length class, with a margin, wherever a class
has LEAST_GOOD of them; elsewhere, and without labels, the limits above hold.  All good documents
count: ratios are counted in steps of 1 / STEP, and a limit is the outermost ratio of the step
that holds its rank.

Defined results: a null text counts as empty; texts under the first band's length are
not judged by ratio; every input row gives one output row, in any order; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts
from .words import SPACE, binary_column, grams, hash_words

LEVEL = 3
#: from this many bytes on: least and greatest ratio of a whole document.
BANDS = ((256, 1.30, 3.3), (384, 1.33, 3.3), (512, 1.40, 3.3), (768, 1.50, 3.3), (1024, 1.60, 4.5), (2048, 1.60, 4.5), (4096, 1.60, 6.0), (16384, 1.60, 8.0))
CHUNK = 2048
#: least and greatest ratio of one chunk, and the share of chunks that may lie outside.
CHUNK_BAND = (1.70, 6.0)
CHUNK_SHARE = 0.3
MIN_WORDS = 50
#: Good documents that a class needs for limits of its own; margins below and above; outer parts in thousandths; counted steps of a ratio, and from where they are one (above all limits).
LEAST_GOOD, MARGINS, OUTER, STEP, TOP = 200, (0.95, 1.02), 1, 10_000, 10.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, doc_ratio double, chunk_outside double, reason string"
)


def _dup_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            if line in seen:
                n += 1
            else:
                seen.add(line)
    return n


def _repeat_words(h: np.ndarray) -> int:
    g = grams(h, 3)
    if len(g) < 2:
        return 0
    order = np.argsort(g, kind="stable")
    same = np.diff(g[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[k : k + len(g)] |= twice
    return int(covered.sum())


def band(n_bytes: int, bands: tuple = BANDS) -> tuple[float, float] | None:
    fits = [b for b in bands if n_bytes >= b[0]]
    return fits[-1][1:] if fits else None


def judge(text: bytes, packer: zstandard.ZstdCompressor, bands: tuple = BANDS) -> tuple[float | None, float | None, str | None]:
    """Whole-document ratio, share of chunks outside their band, and the reason to reject, if any."""
    limits = band(len(text), bands)
    if limits is None:
        return None, None, None
    ratio = len(text) / len(packer.compress(text))
    outside = None
    if len(text) >= CHUNK:
        chunks = [text[i : i + CHUNK] for i in (*range(0, len(text) - CHUNK, CHUNK), len(text) - CHUNK)]
        sizes = CHUNK / np.array([len(packer.compress(c)) for c in chunks])
        outside = float(((sizes < CHUNK_BAND[0]) | (sizes > CHUNK_BAND[1])).mean())
    if ratio > limits[1]:
        return ratio, outside, "repetitive"
    if ratio < limits[0]:
        return ratio, outside, "incompressible"
    if outside is not None and outside > CHUNK_SHARE:
        return ratio, outside, "chunks"
    return ratio, outside, None


def measure(batch: list[bytes], bands: tuple = BANDS) -> dict:
    packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
    data, offsets = binary_column(pa.array(batch, pa.large_binary()))
    h, at = hash_words(data, offsets)
    n_words = np.diff(at)
    # sums by document over prefix counts of bytes
    points = np.concatenate([[0], np.cumsum(~SPACE[data] & ((data & 0xC0) != 0x80))])[offsets]
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])[offsets]
    repeat = np.array([_repeat_words(h[a:b]) for a, b in zip(at[:-1], at[1:])], np.int64)
    failed = (n_words < MIN_WORDS) | (100 * repeat > 50 * n_words)
    verdicts = [judge(t, packer, bands) for t in batch]
    return {
        "n_words": n_words,
        "word_chars": np.diff(points),
        "n_symbols": np.diff(symbols),
        "n_dup_lines": np.array([_dup_lines(t) for t in batch], np.int64),
        "n_repeat_words": repeat,
        "base_failed": failed,
        "kept": np.array([not f and v[2] is None for f, v in zip(failed, verdicts)], bool),
        "doc_ratio": pa.array([v[0] for v in verdicts], pa.float64()),
        "chunk_outside": pa.array([v[1] for v in verdicts], pa.float64()),
        "reason": pa.array(["base" if f else v[2] for f, v in zip(failed, verdicts)], pa.string()),
    }


def fit_bands(docs: DataFrame, labels: DataFrame) -> tuple:
    """BANDS with limits narrowed to the good documents of labels (doc_id, quality); of repeated labels the worst counts."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))

    def work(batch: list[bytes]) -> dict:
        m = measure(batch)
        return {"failed": pa.array(m["base_failed"], pa.bool_()), "start": pa.array([max((b[0] for b in BANDS if len(t) >= b[0]), default=None) for t in batch], pa.int64()), "ratio": m["doc_ratio"]}

    # every text is measured where it is, so that three numbers a document are shuffled and no text
    own = map_texts(docs.select("doc_id", "text"), work, "failed boolean, start long, ratio double").where("not failed and start is not null")
    own = own.join(known.where("quality = 1").select("doc_id").hint("merge"), "doc_id").select("start", F.least("ratio", F.lit(TOP)).alias("ratio"))
    steps = own.groupBy("start", F.floor(F.col("ratio") * STEP).alias("step")).agg(F.count("*").alias("n"), F.min("ratio").alias("least"), F.max("ratio").alias("most"))
    # at most TOP * STEP steps a class
    order = Window.partitionBy("start").orderBy("step")
    ranked = steps.select("*", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy("start")).alias("total"))
    rank = lambda k: F.greatest(F.lit(1), F.ceil(F.col("total") * k / 1000))
    holds = lambda k: (F.col("upto") >= rank(k)) & (F.col("upto") - F.col("n") < rank(k))
    limits = ranked.groupBy("start").agg(F.max("total").alias("n"), F.max(F.when(holds(OUTER), F.col("least"))).alias("low"), F.max(F.when(holds(1000 - OUTER), F.col("most"))).alias("high"))
    found = {r.start: (r.low, r.high) for r in limits.where(F.col("n") >= LEAST_GOOD).collect()}  # one row a class
    return tuple((at, max(low, found[at][0] * MARGINS[0]), min(high, found[at][1] * MARGINS[1])) if at in found else (at, low, high) for at, low, high in BANDS)


def compression_bands(docs: DataFrame, *more: str, bands: tuple = BANDS) -> DataFrame:
    """Counts, verdict and ratios of every document, by one pass over the texts without a shuffle."""
    return map_texts(docs, lambda batch: measure(batch, bands), SCHEMA, *more)
