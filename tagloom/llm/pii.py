"""Personal data: fixed patterns, and weakly supervised spans that they miss.

Candidates are the spans of the four base patterns, what comes near them (numbers that break
a rule) and forms that no base pattern knows: addresses written with "at" and "dot", IPv6,
cards in other groupings or beside other numbers, national phone numbers.  Five labelers vote
on each, for, against or not at all: the strict form, a gazetteer (top-level domains,
calling codes, card issuers, special networks), words before it, its borders, and base spans
of other kinds close by.  Votes are counted over the whole corpus, at most 486 patterns a kind;
expectation-maximisation on those counts estimates each labeler's reliability and the
probability of each pattern, without any labels.  These probabilities train the final span
classifier, a logistic regression for each kind over votes, shape and hashed words around,
on the TRAIN candidates with the smallest hashes.  A candidate outside all base spans is
added where both its votes and the classifier give ADD_FROM.  Base spans always stay.

Two passes read the documents; only vote counts and the training candidates reach the
driver.  Defined results: a null or empty text has no spans; offsets are code points, ends
exclusive; spans are listed by kind, then start; added spans overlap neither base spans nor
each other; every row gives one row, repeated rows too; very long texts are read whole, in
time in proportion to their length; other columns stay behind (redaction keeps them); a
corpus without candidates adds nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, slices, texts, unused, written

KINDS = ("email", "ip", "card", "phone")
#: Candidates that train the classifier at most, and the probability from which it adds a span.
TRAIN, ADD_FROM = 20_000, 0.8
#: Buckets of hashed words, and features of one kind: votes, digits, shapes, words.
WORDS = 1_024
WIDTH = 15 + 32 + 64 + WORDS
LABELERS = 5

# Gazetteers and context words.
TOP_LEVEL = set("com org net edu gov mil int info biz io dev app name de fr es uk us it nl eu ch at be pl se no dk fi pt ie ru jp cn in br mx ar ca au nz".split())
CALLING_1 = {"1", "7"}
CALLING_2 = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
CALLING_3 = set("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())  # first two digits of three
ISSUERS = (  # from and to as prefixes, numbers of digits
    ("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("6011", "6011", (16, 19)), ("644", "659", (16, 19)),
    ("300", "305", (14,)), ("36", "36", (14,)), ("38", "39", (14,)), ("3528", "3589", (16, 19)), ("62", "62", (16, 17, 18, 19)), ("50", "50", (16, 19)), ("56", "58", (16, 19)),
)
FOR = {
    "email": set("mail email e-mail mailto courriel correo contact kontakt contacto reach write schreib address adresse".split()),
    "ip": set("ip ipv4 ipv6 host server client login address adresse logged connection router".split()),
    "card": set("card cards visa mastercard amex karte kreditkarte carte tarjeta credit debit payment paid cc".split()),
    "phone": set("phone tel tél telephone téléphone telefon teléfono telefono call mobile cell fax whatsapp sms handy ruf appelez llame".split()),
}
AGAINST = set("version v release section chapter isbn issn doi hash sha md5 sha1 sha256 id order invoice serial sku part ref no nr article page pages build commit row total price usd eur date year".split())

# --- base patterns ---------------------------------------------------------------------

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def luhn(number: str) -> bool:
    back = [int(c) for c in reversed(number)]
    return (sum(back[::2]) + sum(sum(divmod(2 * x, 10)) for x in back[1::2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The pattern's matches, from each @ outwards: no run of letters is read twice."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = floor + len(text[floor:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        floor = at + 1
        if m:
            found.append((start, m.end()))
            floor = m.end()
        at = text.find("@", at + 1)
    return found


def card_like(s: str) -> bool:
    n = len(s) - s.count(" ") - s.count("-")
    return 13 <= n <= 19 and luhn(digits(s))


def octets(s: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in s.split("."))


def matched(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind number, start, end) of the base spans, by kind and start, and of the matches that break a rule."""
    good, bad = [(0, a, b) for a, b in emails(text)], []
    for kind, pattern, holds in ((1, IP, octets), (2, CARD, card_like), (3, PHONE, lambda s: 9 <= len(digits(s)) <= 15)):
        for m in pattern.finditer(text):
            (good if holds(m[0]) else bad).append((kind, m.start(), m.end()))
    return good, bad


# --- candidates ------------------------------------------------------------------------

WRITTEN_AT = re.compile(r"\(at\)|\[at\]|\{at\}|<at>|(?<=[ \t])at(?=[ \t])", re.I)
DOT = r"(?:[ \t]{0,2}(?:\(dot\)|\[dot\]|\{dot\}|<dot>)[ \t]{0,2}|[ \t]{1,2}dot[ \t]{1,2}|\.)"
WRITTEN_DOMAIN = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}", re.I)
BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}[ \t]{0,2}\Z")
AFTER_AT = re.compile(r"[ \t]{0,2}")
HEX_GROUPS = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]{6,45}(?![0-9A-Za-z:])")
WIDE = re.compile(r"(?<![0-9])[0-9](?:[ .\-/\u00a0\u2009\u202f]{0,2}[0-9])++")
GROUP = re.compile(r"[0-9]+")
NATIONAL = re.compile(r"(?<![0-9A-Za-z.+\-/(])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ ./-]{0,2}[0-9]{2,5}){1,4}(?![0-9A-Za-z]|[.\-/][0-9])")
AREA = re.compile(r"(?:\+[0-9]{1,3} ?)?\([0-9]{3}\)[ -]?[0-9]{3}[ .-][0-9]{4}")
DATE = re.compile(r"[0-9]{4}([./-])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\2[0-9]{4}|(?:19|20)[0-9]{2} ?[-/] ?(?:19|20)[0-9]{2}")


def candidates(text: str, good: list, bad: list) -> list[tuple[int, int, int, bool]]:
    """(kind number, start, end, whether it is a base span) of all that labelers vote on."""
    found = [(*s, True) for s in good]
    for m in WRITTEN_AT.finditer(text):
        head = BEFORE_AT.search(text[max(0, m.start() - 66) : m.start()])
        tail = WRITTEN_DOMAIN.match(text, AFTER_AT.match(text, m.end()).end()) if head else None
        if tail:
            found.append((0, max(0, m.start() - 66) + head.start(), tail.end(), False))
    if text.count(":") > 1:
        for m in HEX_GROUPS.finditer(text):
            try:
                ipaddress.IPv6Address(m[0])
            except ValueError:
                continue
            found.append((1, m.start(), m.end(), False))
    found += [(k, a, b, False) for k, a, b in bad if k == 1 and b - a <= 64]
    led = []  # numbers after a plus that run into other digits: their beginnings
    for _, a, b in (x for x in bad if x[0] == 3):
        n = 0
        for g in GROUP.finditer(text, a, min(b, a + 64)):
            n += g.end() - g.start()
            if n <= 15:
                led.append((3, a, g.end(), False))
    for m in WIDE.finditer(text):
        if 13 <= m.end() - m.start() <= 400:
            groups = [(g.start() + m.start(), g.end() + m.start()) for g in GROUP.finditer(m[0])]
            for i in range(len(groups)):
                n = 0
                for j in range(i, min(i + 6, len(groups))):
                    n += groups[j][1] - groups[j][0]
                    if 13 <= n <= 19:
                        found.append((2, groups[i][0], groups[j][1], False))
    found += [c for c in led if len(digits(text[c[1] : c[2]])) >= 9]
    heads, reach = [c[1] for c in led], [c[2] for c in led]
    for m in NATIONAL.finditer(text):
        k = bisect_left(heads, m.start())
        if 7 <= len(digits(m[0])) <= 12 and not (k and max(reach[max(0, k - 15) : k]) > m.start()):
            found.append((3, m.start(), m.end(), False))
    starts, ends = [], []  # base spans, merged
    for a, b in sorted((a, b) for _, a, b in good):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    free = [c for c in found if c[3] or not (k := bisect_left(starts, c[2])) or ends[k - 1] <= c[1]]
    return sorted(set(free), key=lambda c: (c[1], c[2], c[0], c[3]))


# --- labelers --------------------------------------------------------------------------


def _strict(kind: str, s: str, number: str, base: bool) -> int:
    if base:
        return 1
    if kind == "email":
        return 1 if re.search(r"[(\[{<]at[)\]}>]", s, re.I) else 0
    if kind == "ip":
        return 1 if ":" in s else -1
    if kind == "card":
        return 1 if luhn(number) else -1
    return -1 if DATE.fullmatch(s) else 1 if AREA.fullmatch(s) else 0


def _gazetteer(kind: str, s: str, number: str) -> int:
    if kind == "email":
        return 1 if re.split(r"[^a-z0-9-]+", s.lower().rstrip(")]}> "))[-1] in TOP_LEVEL else -1
    if kind == "ip":
        try:
            at = ipaddress.ip_address(s)
        except ValueError:
            return -1
        return -1 if at.is_unspecified or at.is_reserved or at.is_multicast else 0 if at.is_private else 1
    if kind == "card":
        return 1 if any(a <= number[: len(a)] <= b and len(number) in sizes for a, b, sizes in ISSUERS) else -1
    code = number if s[0] == "+" else number[2:] if number.startswith("00") else None
    if code is None:
        return 1 if s[0] == "(" or number[0] == "0" else 0
    return 1 if code[:1] in CALLING_1 or code[:2] in CALLING_2 or code[:2] in CALLING_3 else -1


def _context(kind: str, before: list[str]) -> int:
    if any(w in FOR[kind] for w in before):
        return 1
    return -1 if any(w in AGAINST for w in before) else 0


def _borders(left: str, right: str) -> int:
    if left.isalnum() or left in tuple("_#=/@&$€£") or right.isalnum() or right in tuple("_=/@%$€£"):
        return -1
    return 1 if (not left or left.isspace() or left in "(<[\"',;:|") and (not right or right.isspace() or right in ")>]\"',;.:!?|") else 0


def _near(k: int, found: list) -> int:
    """A base span of another kind within 80 characters, among three candidates on either side."""
    kind, a, b, _ = found[k]
    for step in (-1, 1):
        j = k + step
        while 0 <= j < len(found) and abs(j - k) <= 3:
            if found[j][0] != kind and found[j][3] and max(found[j][1] - b, a - found[j][2]) <= 80:
                return 1
            j += step
    return -1


WORD = re.compile(r"[^\W_][\w-]*")
SHAPE = re.compile(r"[0-9]+|[A-Za-z]+|\s+")


def _bucket(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=4).digest(), "little")


def judged(text: str, found: list) -> Iterator[tuple[tuple[int, ...], list[int]]]:
    """Votes of the labelers on each candidate, and its features."""
    for k, (kind, a, b, base) in enumerate(found):
        name, s = KINDS[kind], text[a:b]
        number = digits(s)
        before = [w.lower() for w in WORD.findall(text, max(0, a - 48), a)][-4:]
        after = [w.lower() for w in WORD.findall(text, b, b + 24)][:2]
        votes = (_strict(name, s, number, base), _gazetteer(name, s, number), _context(name, before), _borders(text[a - 1 : a], text[b : b + 1]), _near(k, found))
        shape = SHAPE.sub(lambda m: "9" if m[0][0].isdigit() else " " if m[0].isspace() else "a", s[:80])
        words = [f"{i}<{w}" for i, w in enumerate(reversed(before))] + [f">{w}" for w in after]
        features = [3 * i + v + 1 for i, v in enumerate(votes)] + [15 + min(31, len(number)), 47 + _bucket(shape) % 64] + [111 + _bucket(w) % WORDS for w in words]
        yield votes, [kind * WIDTH + f for f in features]


# --- reliabilities and classifier ------------------------------------------------------

#: Votes (against, for) on false and on true spans that count as seen before any is, by labeler.
BELIEFS = np.array([[[20.0, 1.0], [4.0, 4.0], [6.0, 2.0], [4.0, 6.0], [8.0, 2.0]], [[1.0, 20.0], [2.0, 8.0], [1.0, 8.0], [1.0, 8.0], [6.0, 4.0]]])
#: False and true spans that count as seen before any is, outside and within the base spans.
SHARES = np.array([[3.0, 1.0], [1.0, 20.0]])


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 500) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, ...], float]]:
    """Expectation-maximisation over counted patterns (base or not, votes...) of one kind.

    Gives the shares of true spans outside and within the base spans, P(vote | class, voted) as
    an array [class, labeler, against or for], and the probability of each pattern.  Not voting
    is no evidence.
    """
    patterns = sorted(counts)
    every = np.array(patterns, int).reshape(-1, LABELERS + 1)
    group, votes, n = every[:, 0], every[:, 1:], np.array([counts[p] for p in patterns], float)
    shares, table = SHARES[:, 1] / SHARES.sum(axis=1), BELIEFS / BELIEFS.sum(axis=2, keepdims=True)
    posterior = np.full(len(n), 0.5)
    for _ in range(rounds):
        said = np.where(votes == 0, 0, np.log(table[:, np.arange(LABELERS), np.maximum(votes, 0)])).sum(axis=2)
        odds = said[1] - said[0] + np.log(shares / (1 - shares))[group]
        new = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        moved, posterior = np.abs(new - posterior).max(initial=0), new
        weight = np.stack([n * (1 - posterior), n * posterior])
        held = SHARES + np.stack([np.bincount(group, w, 2) for w in weight], axis=1)
        shares = held[:, 1] / held.sum(axis=1)
        table = BELIEFS + np.array([[[(w * (votes[:, j] == v)).sum() for v in (-1, 1)] for j in range(LABELERS)] for w in weight])
        table = table / table.sum(axis=2, keepdims=True)
        if moved < 1e-9:
            break
    return shares, table, dict(zip(patterns, posterior.tolist()))


def believed(shares: np.ndarray, table: np.ndarray) -> dict[tuple[int, ...], float]:
    """The probability of every possible pattern, those that no text of the corpus has among them."""
    out = {}
    for base, *votes in product((0, 1), *[(-1, 0, 1)] * LABELERS):
        odds = np.log(shares[base] / (1 - shares[base])) + sum(np.log(table[1, j, max(v, 0)] / table[0, j, max(v, 0)]) for j, v in enumerate(votes) if v)
        out[(base, *votes)] = float(1 / (1 + np.exp(-odds)))
    return out


def train(rows: list[tuple[list[int], float]], rounds: int = 400, penalty: float = 0.5) -> np.ndarray:
    """Weights of logistic regressions, one for each kind as features don't meet, on probabilities as labels."""
    weights = np.zeros(len(KINDS) * WIDTH)
    if rows:
        flat, ends = np.concatenate([np.array(f) for f, _ in rows]), np.cumsum([0] + [len(f) for f, _ in rows])
        y, sizes, speed = np.array([p for _, p in rows]), np.diff(ends), np.full(len(weights), 1e-9)
        for _ in range(rounds):
            error = 1 / (1 + np.exp(-np.clip(np.add.reduceat(weights[flat], ends[:-1]), -30, 30))) - y
            slope = np.bincount(flat, np.repeat(error, sizes), len(weights)) + penalty * weights
            speed += slope * slope
            weights -= 0.3 * slope / np.sqrt(speed)
    return weights


class Model:
    """What the corpus taught: weights of the classifier and probabilities of vote patterns."""

    def __init__(self, weights: np.ndarray, patterns: list[dict], tables: list[tuple[np.ndarray, np.ndarray]]):
        self.weights, self.patterns, self.tables = weights, patterns, tables

    def added(self, text: str, found: list) -> list[tuple[int, int, int]]:
        """Candidates outside the base spans that the classifier takes, the likeliest first where they overlap."""
        if all(c[3] for c in found):
            return []
        likely = []
        for c, (votes, features) in zip(found, judged(text, found)):
            if not c[3] and self.patterns[c[0]].get((0, *votes), 0) >= ADD_FROM:
                p = 1 / (1 + float(np.exp(-np.clip(self.weights[features].sum(), -30, 30))))
                if p >= ADD_FROM:
                    likely.append((-p, c[1], c[2], c[0]))
        kept: list[tuple[int, int, int]] = []
        starts, ends = [], []
        for _, a, b, kind in sorted(likely):
            k = bisect_left(starts, a)
            if (k == 0 or ends[k - 1] <= a) and (k == len(starts) or starts[k] >= b):
                starts.insert(k, a)
                ends.insert(k, b)
                kept.append((kind, a, b))
        return kept


def coded(pattern: tuple[int, ...]) -> int:
    return sum((v + 1) * 3**i for i, v in enumerate(pattern))


def learn(docs: DataFrame) -> Model:
    """Votes of the whole corpus are counted and their reliabilities estimated; then the classifier is trained."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                kinds, votes_, features_, order = [], [], [], []
                for raw in part.column("text").to_pylist():
                    text = (raw or b"").decode("utf-8", "replace")
                    found = candidates(text, *matched(text))
                    for c, (votes, features) in zip(found, judged(text, found)):
                        kinds.append(c[0])
                        votes_.append(coded((int(c[3]), *votes)))
                        features_.append(features)
                        order.append(_bucket(f"{c}{text[max(0, c[1] - 48) : c[2] + 24]}"))
                yield pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.int32()), "votes": pa.array(votes_, pa.int32()), "features": pa.array(features_, pa.list_(pa.int32())), "place": pa.array(order, pa.int64())})

    seen = written(texts(docs).mapInArrow(run, "kind int, votes int, features array<int>, place long"), "pii-candidates")
    pattern = {coded(p): p for p in product((0, 1), *[(-1, 0, 1)] * LABELERS)}
    counts: list[dict] = [{} for _ in KINDS]
    for kind, votes, n in seen.groupBy("kind", "votes").count().collect():
        counts[kind][pattern[votes]] = n
    found = [reliabilities(c) for c in counts]
    sample = seen.orderBy("place", "kind", "votes", "features").limit(TRAIN).collect()
    weights = train([(r["features"], found[r["kind"]][2][pattern[r["votes"]]]) for r in sample])
    return Model(weights, [believed(*f[:2]) for f in found], [f[:2] for f in found])


def spans_of(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans of a text, each by kind and start."""
    good, bad = matched(text)
    return good, sorted(model.added(text, candidates(text, good, bad)))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, model: Model | None = None, *more: str) -> DataFrame:
    """Spans of personal data in every whole text; the model is learnt from the documents unless given."""
    model = model or learn(docs)

    def scan(batch: list[bytes]) -> dict:
        both = [spans_of(t.decode("utf-8", "replace"), model) for t in batch]
        n = lambda k: pa.array([sum(s[0] == k for s in base) for base, _ in both], pa.int64())
        return {f"n_{name}": n(k) for k, name in enumerate(KINDS)} | {
            "base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in both],
            "spans": pa.array([joined(sorted(base + new)) for base, new in both], pa.string()),
            "n_added": pa.array([len(new) for _, new in both], pa.int64()),
        }

    return map_texts(docs, scan, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", *more)


def redact_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; all rows and columns stay, null texts stay null."""
    model = model or learn(docs)
    own = unused("clean", docs.columns)

    def clean(batch: list[bytes]) -> dict:
        out = []
        for t in batch:
            text = t.decode("utf-8", "replace")
            base, new = spans_of(text, model)
            parts, at = [], 0
            for a, b, k in sorted((a, b, k) for k, a, b in base + new):
                if a >= at:
                    parts += [text[at:a], f"[{KINDS[k]}]"]
                at = max(at, b)
            out.append("".join([*parts, text[at:]]) if parts else None)
        return {own: pa.array(out, pa.string())}

    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    done = map_texts(docs, clean, f"{own} string", *others, keep_text=True)
    return done.select(*[F.coalesce(own, F.col("text").cast("string")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
