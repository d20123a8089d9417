"""Personal data: base spans against the plain patterns, added spans against planted ones, reliabilities against known ones."""

import hashlib
import random
import re

import numpy as np
import pytest

from tagloom.llm import pii, queries

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, s):
    d = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    """(counts, digest, spans) of the base spans by the patterns as they are written."""
    spans = [(k, *m.span()) for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m[0])]
    line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return [sum(s[0] == k for s in spans) for k in BASE], hashlib.sha256(line.encode()).hexdigest(), spans


rng = random.Random(3)
PIECES = ["@", "a@b.c", "x.y@z", ".com", "1.2.3.4", "256.1.1.1", ".", "4111 1111 1111 1111", "4111-1111-1111-1111", "5500000000000004", " ", "-", "+", "+49 30 1234567", "+1 (555) 010-9999", "7", "12", "é", "(", ")", "  ", "a", "%", "\n", "0000000000000", "+1", "漢"]
ODD = [
    None, "", " ", "@", "@@a.b", "a@b", "a@b.", "a@b.c.", "a@b.c@d.e", "a@b..c", "é@b.c", "1.2.3", "1.2.3.4.5", "1.2.3.4.5.6.7.8", "01.002.3.255", "1.2.3.9999999999",
    "4111111111111111 2024", "4111 1111 1111 1111\n5500 0000 0000 0004", "٤111111111111111", "+1-800-555-0199.", "++1 22222222", "+1 222 333 4444 +1 222 333 4444", "+12", "+1 (", "+1" + "(" * 500,
    "a" * 4_000 + "@", "@".join(["a"] * 3_000), "1" * 4_000, "1." * 20_000, "1 " * 20_000, "+1" * 5_000, "a@" * 5_000 + "b.c",
]
FUZZ = ["".join(rng.choices(PIECES, k=rng.randint(1, 14))) for _ in range(600)]


def spans(row):
    return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in row["spans"].split(",") if x)]


def test_base_spans_equal_the_patterns(spark, docs):
    texts = ODD + FUZZ
    rows = pii.find_pii(docs(texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counts, digest, want = brute(texts[r["doc_id"]])
        assert ([r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]], r["base_sha256"]) == (counts, digest), texts[r["doc_id"]]
        every = spans(r)
        assert [s for s in every if s in want] == want and len(every) == len(want) + r["n_added"]
        assert every == sorted(every, key=lambda s: (list(BASE).index(s[0]), s[1], s[2]))
        added = [s for s in every if s not in want]
        assert all(b <= c or d <= a for _, a, b in added for s, c, d in every if (s, c, d) != (_, a, b) and ((s, c, d) in want or (s, c, d) in added))


def test_whole_table_equals_the_patterns(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op11_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert ([r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]], r["base_sha256"]) == brute(texts[r["doc_id"]])[:2]


PROSE = "the lamp stands near a window and light falls on old paper while rain goes by outside the quiet house".split()


def prose(n):
    return " ".join(rng.choices(PROSE, k=n))


def luhn_number(prefix, n):
    body = prefix + "".join(rng.choices("0123456789", k=n - len(prefix) - 1))
    return next(body + str(c) for c in range(10) if pii.luhn(body + str(c)))


def planted():
    """(text, added spans expected, by kind) of hidden personal data, and of look-alikes without any."""
    out = []
    for i in range(60):
        card = luhn_number("4", 16)
        grouped = " ".join(card[k : k + 4] for k in range(0, 16, 4))
        hidden = [
            ("email", f"jo.doe{i} [at] mail{i}.example.com"), ("email", f"user{i} (at) host (dot) example (dot) org"), ("ip", f"2001:db8:{i:x}::8a2e:370:7334"), ("card", grouped.replace(" ", ".")),
            ("phone", f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"),
        ]
        words = {"email": "mail", "ip": "host", "card": "visa card", "phone": "phone"}
        for kind, s in hidden:
            before = f"{prose(6)} {words[kind]} "
            out.append((before + s + " " + prose(4), {(kind, len(before), len(before) + len(s))}))
        out.append((f"{prose(5)} {i}.doe@mail.example.com {prose(3)} 10.1.{i}.7 {prose(3)} +1 (555) 010-{1000 + i} {prose(2)} {grouped} {prose(3)}", set()))
    clean = [
        "version 1.2.{i} of {p}", "{p} on 2024-0{d}-1{d} and 1{d}/0{d}/2023", "{p} order 83{i}20481 {p}", "we met at noon. {p}", "look at this.{p}", "{p} 10:2{d}:30 {p}", "page 1{i} of 2{i}", "isbn 978-3-16-14841{d}-0 {p}",
        "{p} {r} {p}", "pi is 3.14159{i} {p}", "{p} ratio 16:9:4 {p}", "1999-2004 {p}", "{p} 1,000,{i} euro", "sha1 {h} {p}",
    ]
    for i in range(60):
        bad = luhn_number("4", 16)
        bad = bad[:-1] + str((int(bad[-1]) + 1 + i % 9) % 10)
        for c in clean:
            out.append((c.format(p=prose(4), i=100 + i, d=i % 9 + 1, r=bad, h="%040x" % rng.getrandbits(160)), set()))
    return out


def test_hidden_spans_are_added_and_look_alikes_are_not(spark, docs):
    rows = planted()
    got = {r["doc_id"]: r for r in pii.find_pii(docs([t for t, _ in rows])).collect()}
    hit = wrong = want = 0
    for k, (text, expected) in enumerate(rows):
        added = {s for s in spans(got[k]) if s not in brute(text)[2]}
        want, hit, wrong = want + len(expected), hit + len(expected & added), wrong + len(added - expected)
    assert hit >= 0.9 * want and wrong <= 0.01 * len(rows), (hit, want, wrong)


def test_expectation_maximisation_finds_reliabilities():
    """Votes drawn with known accuracies and no labels: the estimates and the pattern probabilities come close."""
    draw = np.random.default_rng(2)
    right = np.array([0.95, 0.8, 0.85, 0.7, 0.75])
    truth = draw.random(20_000) < 0.3
    votes = np.where(draw.random((20_000, 5)) < 0.8, np.where((draw.random((20_000, 5)) < right) == truth[:, None], 1, -1), 0)
    counts: dict = {}
    for v in votes.tolist():
        counts[(0, *v)] = counts.get((0, *v), 0) + 1
    shares, table, posterior = pii.reliabilities(counts)
    assert abs(shares[0] - 0.3) < 0.02
    assert np.abs(table[1, :, 1] - right).max() < 0.04 and np.abs(table[0, :, 0] - right).max() < 0.04
    p = np.array([posterior[(0, *v)] for v in votes.tolist()])
    known = np.log(0.3 / 0.7) + (votes * np.log(right / (1 - right))).sum(axis=1)  # the best that the true accuracies allow
    assert ((p > 0.5) == truth).mean() > ((known > 0) == truth).mean() - 0.005
    assert abs(p[p > 0.8].mean() - truth[p > 0.8].mean()) < 0.02
    every = pii.believed(shares, table)
    assert len(every) == 2 * 3**5 and max(abs(every[k] - v) for k, v in posterior.items()) < 1e-6
    assert pii.reliabilities({})[2] == {}


def test_a_model_serves_other_texts(spark, docs):
    """Learnt from texts with base spans only, it finds what such texts never show."""
    known = [f"{prose(4)} mail {i}.doe@mail.example.com {prose(3)} host 10.1.{i}.7 {prose(3)} phone +1 (555) 010-{1000 + i} card {luhn_number('4', 16)} {prose(3)}" for i in range(80)]
    model = pii.learn(docs(known))
    rows = planted()
    got = {r["doc_id"]: r for r in pii.find_pii(docs([t for t, _ in rows]), model).collect()}
    hit, want, wrong = 0, 0, 0
    for k, (text, expected) in enumerate(rows):
        added = {s for s in spans(got[k]) if s not in brute(text)[2]}
        hit, want, wrong = hit + len(added & expected), want + len(expected), wrong + len(added - expected)
    assert hit >= 0.5 * want and wrong <= 0.01 * len(rows), (hit, want, wrong)


def test_classifier_learns_probabilities_as_labels():
    rows = [([0, 20], 0.95)] * 300 + [([1, 20], 0.1)] * 300
    w = pii.train(rows)
    sure = lambda f: 1 / (1 + np.exp(-w[f].sum()))
    assert abs(sure([0, 20]) - 0.95) < 0.05 and abs(sure([1, 20]) - 0.1) < 0.05
    assert not pii.train([]).any()


@pytest.mark.parametrize("texts", [[], [None, "", None]])
def test_nothing_to_find(spark, docs, texts):
    rows = pii.find_pii(docs(texts)).collect()
    assert len(rows) == len(texts) and all(r["spans"] == "" and r["n_added"] == 0 for r in rows)


def test_redaction_keeps_rows_and_columns(spark):
    table = spark.createDataFrame([(1, "mail a@b.de now", "x"), (1, "mail a@b.de now", "x"), (2, None, "y"), (3, "plain", None)], "doc_id long, text string, clean string")
    out = pii.redact_pii(table)
    assert out.columns == table.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, "mail [email] now", "x")] * 2 + [(2, None, "y"), (3, "plain", None)], key=repr)


def test_long_texts_take_time_in_proportion(spark):
    import time

    model = pii.Model(np.zeros(len(pii.KINDS) * pii.WIDTH), [{}] * 4, [])
    for unit in ("a@", "1 ", "1.", "+1 ", "(1", "at ", ":1", "1234567890123456 ", "a.b at c.d "):
        text = unit * (400_000 // len(unit))
        began = time.time()
        pii.spans_of(text, model)
        assert time.time() - began < 20, unit
