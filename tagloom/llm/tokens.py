"""Token counts by a two-tier lookup on the map side.

Tokens never cross the tokenizer's own pre-tokens, so a text's count is the sum of its
pre-tokens' lengths.  Tier one is a hash table of frequent pre-tokens' lengths: every task
counts the pre-tokens of its frequent white-space pieces and sends the SUMMARY most frequent
ones; of the sums the TIER_ONE largest (of at most KEY_BYTES bytes, about 2 MB) are broadcast.
Tier two is each Python worker's own cache; what both lack is encoded by the library's model.
No pre-token of a text is shuffled: the summaries are at most SUMMARY rows of some 20 bytes
for each input split.

Pre-tokens come from the library's own normaliser and pre-tokenizer, called for many
white-space pieces at once: each distinct piece of a batch is split once, and pieces' counts
are added up text by text.  Tokenizers that don't drop white space between pre-tokens are
split text by text.

Defined results: a null or empty text has 0 tokens; special strings inside a text count as
the library counts them (one token each); rows with a null doc_id are kept; repeated rows
give repeated rows; very long texts are read whole, in batches of bounded size; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, slices, texts

TIER_ONE = 32_768
SUMMARY = 4_096
KEY_BYTES = 48
CACHE = 400_000
LIMIT = 2_048
#: Pieces split in one call of the library.
TOGETHER = 20_000


class Splitter:
    """The library's normaliser, pre-tokenizer and model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        self.firsts = {c for x in self.special for c in (x[0], x[0].lower(), x[0].upper())}
        probe = [x for part in ("one", "two,", "three") for x in self.words(part)]
        self.by_piece = self.words("one  two,\n three") == probe

    def normalise(self, text: str) -> str:
        return self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text

    def words(self, text: str) -> list[str]:
        normal = self.normalise(text)
        return [w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(normal)] if self.tok.pre_tokenizer else [normal]

    def is_special(self, text: str) -> bool:
        if self.firsts.isdisjoint(text):
            return False
        return any(x in text or x in self.normalise(text) for x in self.special)

    def whole(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def length(self, word: str) -> int:
        return len(self.tok.model.tokenize(word))

    def split(self, pieces: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
        """(numbers of pieces, their pre-tokens), for some pieces at a time; none of them holds a special string."""
        for k in range(0, len(pieces), TOGETHER):
            part = pieces[k : k + TOGETHER]
            # a piece with odd white space inside would shift the others
            alone = [i for i, p in enumerate(part) if not p.isascii() and p.split() != [p] or p.isascii() and not p.isprintable()]
            rest = [i for i in range(len(part)) if i not in set(alone)] if alone else range(len(part))
            normal = self.normalise(" ".join(part[i] for i in rest))
            cuts = np.cumsum([0, *(len(x) + 1 for x in normal.split(" "))])
            if len(cuts) != len(rest) + 1:
                alone, rest = list(range(len(part))), range(0)
            if len(rest):
                found = self.tok.pre_tokenizer.pre_tokenize_str(normal)
                at = np.fromiter((s for _, (s, _) in found), np.int64, len(found))
                yield k + np.asarray(rest)[np.searchsorted(cuts, at, "right") - 1], [w for w, _ in found]
            for i in alone:
                own = self.words(part[i])
                yield np.full(len(own), k + i), own


class Words(dict):
    """Tier one with the worker's own cache of pre-tokens behind it; a miss is encoded by the library's model."""

    def __init__(self, first: dict[str, int], length: Callable[[str], int]):
        super().__init__(first)
        self.first, self.length = first, length

    def __missing__(self, word: str) -> int:
        n = self.length(word)
        if len(word) <= KEY_BYTES:
            if len(self) >= CACHE + len(self.first):
                self.clear()
                self.update(self.first)
            self[word] = n
        return n


class Lengths:
    """A worker's counts of texts, with a cache of white-space pieces made of pre-tokens."""

    def __init__(self, path: str, first: dict[str, int]):
        self.splitter = Splitter(path)
        self.words = Words(first, self.splitter.length)
        self.pieces: dict[bytes, int] = {}

    def _learn(self, missing: list[bytes]) -> dict[bytes, int]:
        texts = [p.decode("utf-8", "replace") for p in missing]
        odd = {k for k, t in enumerate(texts) if self.splitter.is_special(t)}
        new = {missing[k]: self.splitter.whole(texts[k]) for k in odd}
        plain = [k for k in range(len(texts)) if k not in odd] if odd else range(len(texts))
        total = np.zeros(len(plain), np.int64)
        for number, words in self.splitter.split([texts[k] for k in plain] if odd else texts):
            total += np.bincount(number, list(map(self.words.__getitem__, words)), len(total)).astype(np.int64)
        return new | dict(zip((missing[k] for k in plain), total.tolist()))

    def counts(self, batch: list[bytes]) -> list[int]:
        if not self.splitter.by_piece:
            decoded = [t.decode("utf-8", "replace") for t in batch]
            return [self.splitter.whole(t) if self.splitter.is_special(t) else sum(map(self.words.__getitem__, self.splitter.words(t))) for t in decoded]
        split = [t.split() for t in batch]
        if len(self.pieces) >= CACHE:
            self.pieces.clear()
        known = self.pieces
        new = self._learn([p for p in set().union(*split) if p not in known])
        known.update(new)
        counts = [sum(map(known.__getitem__, t)) for t in split]
        for p in new:
            if len(p) > KEY_BYTES:
                del known[p]
        return counts


_worker: dict[str, Lengths] = {}


def lengths_of(path: str, key: str, tier_one) -> Lengths:
    """The worker's own table; it outlives a task, and a new broadcast replaces it."""
    if key not in _worker:
        _worker.clear()
        _worker[key] = Lengths(path, tier_one.value)
    return _worker[key]


def frequent_words(docs: DataFrame, path: str) -> DataFrame:
    """word, n of the TIER_ONE most frequent pre-tokens: each task's largest counts, added up."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, pieces = Splitter(path), Counter()
        for batch in batches:
            for part in slices(batch):
                for text in part.column("text").to_pylist():
                    pieces.update((text.split() if splitter.by_piece else (text,)) if text else ())
                if len(pieces) > 64 * SUMMARY:
                    pieces = Counter(dict(pieces.most_common(16 * SUMMARY)))
        # rare pieces change no ranking of words, so only frequent ones are split
        top, counts = dict(pieces.most_common(16 * SUMMARY)), Counter()
        n = list(top.values())
        for number, words in splitter.split([p.decode("utf-8", "replace") for p in top]):
            for k, word in zip(number.tolist(), words):
                counts[word] += n[k]
        found = [(w, n) for w, n in counts.most_common(SUMMARY) if len(w) <= KEY_BYTES]
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in found], pa.string()), "n": pa.array([n for _, n in found], pa.int64())})

    found = texts(docs).select("text").mapInArrow(summarise, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(TIER_ONE)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, *more: str) -> DataFrame:
    """n_bytes, n_tokens and over_limit of every document; tokenizer is the path of a .json file."""
    splitter = Splitter(tokenizer)
    words = [r.word for r in frequent_words(docs, tokenizer).select("word").collect()]  # at most TIER_ONE rows
    tier_one = docs.sparkSession.sparkContext.broadcast({w: splitter.length(w) for w in words})
    key = uuid.uuid4().hex

    def count(batch: list[bytes]) -> dict:
        n = lengths_of(tokenizer, key, tier_one).counts(batch)
        return {"n_bytes": pa.array([len(t) for t in batch], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())}

    return map_texts(docs, count, "n_bytes long, n_tokens long, over_limit boolean", *more)
