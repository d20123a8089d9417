"""Secret scans: known shapes, and a token-efficiency test for random strings.

A byte-pair vocabulary spends few tokens on words and many on random characters.  Every
white-space piece of MIN_LENGTH or more key-like characters is encoded with a tiktoken
vocabulary; fewer than MAX_RATIO characters a token mark it as random, with or without
digits in it.  Known digests and identifiers (hex digests of usual lengths, UUIDs, dates and
numbers, addresses, and of links the scheme, host, path and names of parameters) are excluded
first; they stay spans only where a base pattern finds them.  Links' user-info and the values
of their queries and fragments are tested like other text.

Defined results: a null or empty text has no spans; offsets are code points, ends exclusive;
spans of the method never overlap base spans; base spans of different kinds may overlap, and
of equal starts the kind listed first comes first; every row gives one row, repeated rows
too; a very long text is read whole, in time in proportion to its length; other columns are
ignored (redaction keeps them, whatever their names); an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, unused

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYLIKE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MIN_LENGTH = 20
PIECE = re.compile(r"\S{%d,}" % MIN_LENGTH)
MAX_RATIO = 2.1
#: digests (md5, sha1, sha224, sha256, sha384, sha512), UUIDs, numbers.
KNOWN = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_=-]+")
#: Of links: scheme, user-info (group 1), host and path; names of parameters; mail addresses that are no user-info before a host.
LINK = re.compile(r"""(?:[A-Za-z][A-Za-z0-9+.-]*://([^\s/?#@:"'<>]*(?::[^\s?#@"'<>]*)?@)?|(?<![A-Za-z0-9@./-])www\.)[^\s?#"'<>|\\^`{},;()\[\]]*""")
NAME = re.compile(r"[?&;#][A-Za-z0-9_.-]+=")
ADDRESS = re.compile(r"(?:\bmailto:|(?<![A-Za-z0-9._%+:/=-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")

_coders: dict = {}


def coder(path: str, pattern: str):
    if path not in _coders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _coders[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _coders[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the three fixed patterns."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def without_links(piece: str) -> str:
    """The piece with links' known parts and addresses blanked, at equal offsets."""

    def blank(m: re.Match) -> str:
        if m.re is LINK and m[1]:
            return " " * (m.start(1) - m.start()) + m[1] + " " * (m.end() - m.end(1))
        return " " * len(m[0])

    if "://" in piece or "www." in piece:
        piece = NAME.sub(blank, LINK.sub(blank, piece))
    return ADDRESS.sub(blank, piece) if "@" in piece else piece


def random_parts(piece: str, enc) -> list[tuple[int, int]]:
    """Key-like runs of a white-space piece that take too many tokens."""
    runs = KEYLIKE.finditer(without_links(piece))
    return [m.span() for m in runs if not KNOWN.fullmatch(m[0]) and len(m[0]) < MAX_RATIO * len(enc.encode_ordinary(m[0]))]


def random_spans(text: str, base: list[tuple[int, int, int]], enc) -> list[tuple[int, int, int]]:
    """Random strings that no base span touches, by one pass over the text."""
    taken: list[list[int]] = []  # base spans, merged and sorted
    for a, b, _ in base:
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    found, seen, k = [], {}, 0
    for m in PIECE.finditer(text):
        if m[0] not in seen:
            seen[m[0]] = random_parts(m[0], enc)
        for a, b in seen[m[0]]:
            a, b = a + m.start(), b + m.start()
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if k == len(taken) or taken[k][0] >= b:
                found.append((a, b, 3))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame, ranks: str, pattern: str, *more: str) -> DataFrame:
    """Spans of secrets in every whole text; ranks is the path of a .tiktoken file, pattern its split rule."""

    def scan(batch: list[bytes]) -> dict:
        enc = coder(ranks, pattern)
        base, every = [], []
        for t in batch:
            text = t.decode("utf-8", "replace")
            b = base_spans(text)
            base.append(b)
            every.append(sorted(b + random_spans(text, b, enc), key=lambda s: (s[0], s[2])))
        n = lambda k: pa.array([sum(s[2] == k for s in b) for b in base], pa.int64())
        return {
            "n_assign": n(0),
            "n_access": n(1),
            "n_hex": n(2),
            "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base],
            "spans": pa.array([joined(s) for s in every], pa.string()),
        }

    return map_texts(docs, scan, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", *more)


def redact_secrets(docs: DataFrame, ranks: str, pattern: str, mark: str = "[secret]") -> DataFrame:
    """The documents with every secret's span replaced by a mark; all columns and rows stay, n_chars follows the text."""

    def clean(batch: list[bytes]) -> dict:
        enc, out = coder(ranks, pattern), []
        for t in batch:
            text = t.decode("utf-8", "replace")
            base = base_spans(text)
            parts, at = [], 0
            for a, b, _ in sorted(base + random_spans(text, base, enc)):
                if a >= at:
                    parts += [text[at:a], mark]
                at = max(at, b)
            out.append("".join([*parts, text[at:]]) if parts else None)
        return {own: pa.array(out, pa.string())}

    own = unused("clean", docs.columns)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    done = map_texts(docs, clean, f"{own} string", *others, keep_text=True)
    changed = {"text": F.coalesce(own, F.col("text").cast("string")), "n_chars": F.when(F.col(own).isNotNull(), F.length(own)).otherwise(F.col("n_chars")) if "n_chars" in others else None}
    return done.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])
