"""Near-duplicates, substrings, components, url filters and the pipeline against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from tagloom.llm import chat, components, neardup, queries, substrings, urls

import oracle

rng = random.Random(11)
WORDS = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8))) for _ in range(500)]


def passage(n):
    return rng.choices(WORDS, k=n)


def corpus():
    """Copies, near copies around the threshold, shared passages, short, empty, null and repeated texts."""
    base, shared, texts = passage(150), passage(35), []
    for k in range(40):
        own = list(base)
        for _ in range(k % 6):
            own[rng.randrange(len(own))] = rng.choice(WORDS)
        texts.append(" ".join(own))
    texts += [" ".join(base)] * 5 + [" ".join(base).upper()]
    texts += [" ".join(passage(rng.randint(1, 80)) + shared + passage(rng.randint(1, 80))) for _ in range(25)]
    texts += [None, "", "  \n", "one", "one", "One two three four", "one two three four", "a b c d e", " ".join(["spin"] * 90), " ".join(passage(30) * 3), " ".join(passage(9_000))]
    return texts + [" ".join(passage(60)) for _ in range(20)]


TEXTS = corpus()


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def near_truth(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and sets[j] and 100 * n >= 85 * (len(a) + len(sets[j]) - n):
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    return {k: (len(s), find(parent, k), find(parent, k) == k) for k, s in enumerate(sets)}


@pytest.mark.parametrize("block", [neardup.BLOCK_SHINGLES, 700])
def test_near_duplicates(spark, docs, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", block)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs(TEXTS)).collect()}
    assert got == near_truth(TEXTS)


def test_near_duplicates_edges(spark, docs):
    df = docs(["a b c d e f", "a b c d e f"])
    twice = df.unionByName(df).unionByName(df.selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars", "kept").limit(1))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in neardup.near_duplicates(twice).collect())
    assert got == [(False, 0, 0, True)] * 2 + [(False, 1, 0, False)] * 2 + [(True, 0, None, True)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_pipeline_drops_near_copies_from_80_percent(spark, docs):
    base = [f"w{k}" for k in range(150)]
    near = list(base)
    for k in (30, 70, 110):
        near[k] = "other"
    far = list(base)
    for k in (20, 50, 80, 110):
        far[k] = "another"
    texts = [" ".join(base), " ".join(near), " ".join(far)]  # 131 of 161 shingles are shared: 0.81; 126 of 166: 0.76
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(texts), "").collect()) == [0, 2]
    assert all(r.kept for r in neardup.near_duplicates(docs(texts)).collect())
    for percent in (80, 85):
        assert (1 - (percent / 100) ** neardup.ROWS) ** neardup.n_bands(percent) < neardup.MISSED


def test_links_span_all_clusters():
    import numpy as np

    base = [np.unique(np.array(rng.choices(range(10**6), k=200), np.uint64)) for _ in range(3)]
    sets = []
    for k in range(90):
        own = base[k % 3].copy()
        own[rng.sample(range(len(own)), k % 20)] = rng.sample(range(10**6, 10**7), k % 20)
        sets.append(np.unique(own))
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))

    def groups(pairs):
        parent = list(range(90))
        for a, b in pairs:
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
        return [find(parent, k) for k in range(90)]

    true = [(i, j) for i in range(90) for j in range(i) if near(sets[i], sets[j])]
    found = neardup.links(sets, list(range(90)))
    assert len(found) <= 89 and groups(found) == groups(true)
    left = np.arange(90) < 40
    found = neardup.links(sets, list(range(90)), left)
    assert groups(found) == groups([(i, j) for i, j in true if left[i] != left[j]])
    labels = [k % 3 for k in range(90)]  # all clusters known before
    assert neardup.links(sets, labels) == []
    assert neardup.links([*sets, sets[0]], [*labels, 7]) == [(7, 0)]


def repeats_truth(texts):
    seen, out = set(), {}
    for k, t in enumerate(texts):
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for i in range(len(w) - 19):
            x = tuple(w[i : i + 20])
            if x in seen:
                keep[i : i + 20] = [False] * 20
            seen.add(x)
        left = [a for a, b in zip(w, keep) if b]
        out[k] = (len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest())
    return out


@pytest.mark.parametrize("shard, owners", [(substrings.SHARD_WORDS, 1000), (200, 1000), (200, 0)])
def test_remove_repeats(spark, docs, monkeypatch, shard, owners):
    monkeypatch.setattr(substrings, "SHARD_WORDS", shard)
    monkeypatch.setattr(substrings, "BROADCAST_OWNERS", owners)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs(TEXTS)).collect()}
    assert got == repeats_truth(TEXTS)


def joined_rows(spark, after):
    """Rows that inner joins on `id` made in the executions from number `after` on, and the next one's number."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, total = store.executionsList(), 0
    for run in (runs.apply(k) for k in range(runs.size())):
        if run.executionId() >= after:
            nodes, values = store.planGraph(run.executionId()).allNodes(), store.executionMetrics(run.executionId())
            for node in (nodes.apply(k) for k in range(nodes.size())):
                if "Join" in node.name() and "[id#" in node.desc() and "Inner" in node.desc():
                    metrics = node.metrics()
                    rows = [values.get(m.accumulatorId()) for m in (metrics.apply(k) for k in range(metrics.size())) if m.name() == "number of output rows"]
                    total += sum(int(r.get().replace(",", "")) for r in rows if r.isDefined())
    return total, max([after, *(runs.apply(k).executionId() + 1 for k in range(runs.size()))])


def test_a_passage_in_many_texts_is_joined_by_its_parts(spark, docs, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_WORDS", 200)
    common, pair = passage(80), ["left", "right"] * 40
    for shared in (common, pair):
        many = [" ".join(passage(15) + shared + passage(15)) for _ in range(30)]
        before = joined_rows(spark, 0)[1]
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs(many)).collect()}
        assert got == repeats_truth(many)
        rows = joined_rows(spark, before)[0]
        assert 30 <= rows < 30 * 61 / 2  # 61 windows of each text recur


def test_remove_repeats_edges(spark, docs):
    text = " ".join(passage(40))
    df = docs([text, text])
    more = df.unionByName(df).unionByName(df.selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars", "kept").limit(1))
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in substrings.remove_repeats(more).collect()))
    assert got == [(False, 0, 0)] * 2 + [(False, 1, 40)] * 2 + [(True, 0, 0)]
    assert substrings.remove_repeats(df.limit(0)).count() == 0
    for ids in ([-3, -2, 5], ["-3", "-20", "b"]):  # strings sort as text: "-20" is the first
        same = spark.createDataFrame([(d, text) for d in ids], "doc_id string, text string" if ids[2] == "b" else "doc_id long, text string")
        assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(same).collect()} == {d: 0 if d == min(ids) else 40 for d in ids}


def test_hits_of_the_automata_decide(monkeypatch):
    own, shared = passage(30), passage(25)
    pieces = [(" ".join(w).encode(), n, d, 0) for w, n, d in ((own + shared, 1, 4), (shared, 2, 2), (passage(40), 1, 1), (own, 1, 9))]
    located, gone = substrings.judge_shard(pieces)
    assert located == [[{"a": 0, "b": 11}, {"a": 30, "b": 36}], [{"a": 0, "b": 6}], [], [{"a": 0, "b": 11}]]
    assert gone == [[{"a": 30, "b": 36}], [], [], [{"a": 0, "b": 11}]]
    monkeypatch.setattr(substrings, "PATTERNS", 3)
    assert substrings.judge_shard(pieces) == (located, gone)
    monkeypatch.setattr(substrings, "locate", lambda text, passages: tuple(substrings.np.zeros((2, 0), int)))
    assert substrings.judge_shard(pieces) == ([[]] * 4, [[]] * 4)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (300, 300), (None, 5), (160, 100)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 161)} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGES = [
    (0, "http://shop.example.com/de/1", "<html>"), (1, "https://alias.example.net/x#top", '<link rel="canonical" href="http://shop.example.com/de/1#a">'),
    (2, "https://second.example.net/y", "<META http-equiv='refresh' content='0; url=https://alias.example.net/x'>"), (3, "https://good.example.org/p", '<link href="/es/9" rel=canonical>'),
    (4, "https://good.example.org/es/9", ""), (5, "HTTP://WWW.Example.COM/fr/2?q=/de/", '<link rel="canonical" href="http://shop.example.com/de/1">'), (6, None, None), (7, "nonsense", "<html>"),
    (8, "https://plain.example.net", '<link rel="stylesheet" href="http://shop.example.com/de/1">'), (9, "http://evilexample.org/es/1", ""), (10, "http://example.org/en/12", ""), (1, "https://alias.example.net/x#top", None),
    (11, "https://a.net/u://v?x#y", '<link rel="canonical" href="//second.example.net/y">'),
    (20, "http://rel.example.com/de/2", '<meta http-equiv="refresh" content="0; url=../en/9">'), (21, "HTTP://REL.example.com/en/9", ""), (22, "http://rel.example.com/en/deep/er", '<link rel="canonical" href="./../../de/./5">'),
    (23, "http://rel.example.com/q", "<link rel='alternate canonical' href='?a=1&amp;b=2'>"), (24, "http://rel.example.com/q?a=1&b=2", '<link href="de/1" rel="canonical">'), (25, "http://rel.example.com", '<link rel=canonical href="de/7">'),
    (26, "http://rel.example.com/#top", ""), (27, "http://rel.example.com/m", '<link rel="canonical" href="mailto:a@b.example.com">'), (28, "http://rel.example.com/n", '<link rel="canonical" href="#de">'), (29, "http://rel.example.com/x/..", ""),
    (30, "http://rel.example.com/en/none", '<link rel="non-canonical" href="/de/1">'), (31, "http://rel.example.com/de/../y", '<link rel="canonical" href="/z/.">'), (32, "http://rel.example.com/z/", ""), (33, "", "<link rel=canonical href=/de/1>"),
]


CANON = '<link rel="canonical" href="https://x.com/de/1">'
MORE_PAGES = [
    (40, "https://hidden.example.net/", f"<!-- {CANON} -->"), (41, "https://scripted.example.net/", f"<script>var a = '{CANON}'</script><style>{CANON}</style>"), (42, "https://www.x.com:443/de/2", None), (43, "http://p.example.net:80/a", None),
    (44, "http://q.example.net/b", '<link rel=canonical href="http://p.example.net/a">'), (45, "http://p.example.net/a", "<!-- x --> " + CANON), (46, "https://based.example.net/z/", '<base href="https://x.com/de/"><link rel="canonical" href="9">'), (47, "https://open.example.net/", f"a <!-- {CANON}"),
    (48, "https://y.org:443/es/", None), (49, "https://based.example.net/y/", '<!-- <base href="https://x.com/de/"> --><base href="/de/"><link rel="canonical" href="9">'), (50, "https://odd.example.net/", '<base href="mailto:x"><link rel="canonical" href="//x.com/de/1">'), (51, "http://late.example.net/", "<p>" * 200_000 + CANON),
]


def test_hidden_links_ports_and_bases(spark):
    df = spark.createDataFrame(MORE_PAGES, "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(df).collect()}
    assert {k for k, v in got.items() if v[1] == "block"} == {42, 43, 44, 45, 46, 50, 51} and all(v[0] is None for v in got.values())
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", MORE_PAGES)
    oracle.same(urls.judge_urls(df), con, urls.ORACLE)


def test_url_filters(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'clash' as verdict", "'clash' as node")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df).collect()}
    assert got[1] == ("alias.example.net", "/x", None, "block") and got[2][3] == "block" and got[11] == ("a.net", "/u://v", None, "block")
    assert got[3] == ("good.example.org", "/p", "org/", "allow") and got[4][2:] == ("example.org/es/", "block")
    assert got[5] == ("www.example.com", "/fr/2", "com/fr/", "allow") and got[6] == ("", "", None, "allow") == got[7]
    assert got[8] == ("plain.example.net", "", None, "allow") and got[9][2:] == ("org/", "allow") and got[10][2:] == ("example.org/en/1", "block")
    verdicts = {k: got[k][3] for k in range(20, 33)}
    assert [k for k, v in verdicts.items() if v == "block"] == [20, 21, 22, 23, 24, 25, 26, 29, 31, 32]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    oracle.same(urls.judge_urls(df), con, urls.ORACLE)
    assert urls.judge_urls(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, sf_dir, name):
    oracle.same(queries.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), queries.ORACLE[name])
    assert chat is not None


def test_op4_and_op9_on_the_small_table(spark, sf_dir):
    import pyarrow.parquet as pq

    texts = [r["text"] for r in sorted(pq.read_table(f"{sf_dir}/documents.parquet").to_pylist(), key=lambda r: r["doc_id"])]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op4_minhash_near_dedup(spark, sf_dir).collect()}
    assert got == near_truth(texts)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op9_substring_dedup(spark, sf_dir).collect()}
    assert got == repeats_truth(texts)


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, left = docs.columns, Counter()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        left[name] = docs.count()
    assert 0 < left["secret scans"] == left["benchmark decontamination"] <= left["minhash near-dedup"] <= left["quality rules"] < 200
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert out.keys() == texts.keys()
    assert all(out[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items() if "▁" not in t)
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(b in t for t in texts.values() for b in bench)
    groups = defaultdict(list)
    for k, t in texts.items():
        groups[t].append(k)
    assert max(map(len, groups.values())) == 1


def test_pipeline_stages_with_odd_rows(spark, docs, sf_dir):
    odd = docs([None, "", " ".join(passage(400)), " ".join(passage(400)) + " token = abcdef0123456789"]).withColumns({c: __import__("pyspark").sql.functions.lit(1) for c in ("hits", "clean", "node", "component", "__x")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, sf_dir)
    rows = {r.doc_id: r for r in odd.collect()}
    assert odd.columns[-5:] == ["hits", "clean", "node", "component", "__x"] and all(r.hits == 1 for r in rows.values())
    none = docs(["x"]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf_dir)
        assert none.count() == 0
    assert rows.keys() == {2, 3} and rows[3].text.endswith("[secret]") and rows[3].n_chars == len(rows[3].text) and rows[2]["__x"] == 1
