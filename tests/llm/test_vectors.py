"""Whitening and centroid clustering against brute force, on odd tables as on plain ones."""

import hashlib

import numpy as np
import oracle
import pytest

from tagloom.llm import clusters, queries, whitening

SCHEMA = "vec_id long, embedding array<float>, cluster string, x int"
rng = np.random.default_rng(5)


def vectors(spark, rows, parts=5):
    """An embeddings table of several partitions with extra columns whose names clash."""
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], "c", 1) for k, v in rows], SCHEMA).repartition(parts)


def odd(d):
    return [(900, None), (901, []), (902, [None] * d), (903, [float("nan")] + [0.0] * (d - 1)), (904, [float("inf")] * d), (905, [1.0] * (d + 1)), (906, [1e30] * d)]


# --- whitening -------------------------------------------------------------------------


@pytest.mark.parametrize(
    "x",
    [
        np.floor(rng.normal(size=(700, 24)) * 9), rng.integers(0, 3, (60, 7)).astype(float), np.zeros((9, 4)) + 2, np.repeat(rng.integers(0, 9, (3, 6)), 30, 0).astype(float),
        rng.integers(0, 4, (90, 2)) @ rng.integers(0, 5, (2, 12)).astype(float), rng.normal(size=(200, 8)) * 10.0 ** np.arange(-4, 4), np.vstack([np.eye(5), -np.eye(5)]), np.arange(6.0)[:, None],
    ],
)
@pytest.mark.parametrize("step", [1, 64])
def test_rank_one_updates_give_the_spectrum_of_the_scatter(x, step):
    s = whitening.Spectrum(x.shape[1])
    for at in range(0, len(x), step):
        s.add_all(x[at : at + step])
    gap = x - x.mean(axis=0)
    scatter = gap.T @ gap
    assert np.abs((s.basis * s.values) @ s.basis.T - scatter).max() <= 1e-11 * max(1, np.abs(scatter).max())
    assert np.abs(s.basis.T @ s.basis - np.eye(x.shape[1])).max() < 1e-12
    assert np.allclose(s.mean, x.mean(axis=0)) and s.n == len(x)


def test_secular_roots_are_eigenvalues():
    for k in (2, 3, 20):
        d, w = np.sort(rng.normal(size=k)), rng.random(k) ** 4 + 1e-9
        roots, _ = whitening.secular_roots(d, w)
        assert np.allclose(roots, np.linalg.eigvalsh(np.diag(d) + np.outer(np.sqrt(w), np.sqrt(w))), atol=1e-12)


def whitened_truth(rows, components):
    x = [(k, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for k, v in rows]
    n, d = len(x), len(x[0][1])
    sums = [sum(v[j] for _, v in x) for j in range(d)]
    gap = np.array([[n * v[j] - sums[j] for j in range(d)] for _, v in x], object)
    y = gap.astype(float) / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    m = min(components, d)
    return {k: (int((g * g).sum()), (r @ q[:, :m]) / np.sqrt(e[:m])) for (k, _), g, r in zip(x, gap, y)}, e[:m] / e.sum(), n


@pytest.mark.parametrize("d", [3, 40])
def test_whitening_equals_brute_force(spark, d):
    scale = np.linspace(1, 3, d)
    rows = [(k, (rng.normal(size=d) * scale).astype(np.float32)) for k in range(400)] + [(400 + k, np.full(d, 0.25)) for k in range(60)]
    got = whitening.whiten(vectors(spark, rows + odd(d)), 8).collect()
    want, explained, n = whitened_truth(rows, 8)
    m = min(8, d)
    assert len(got) == len(rows) * m and {r["vec_id"] for r in got} == set(want)
    sign = {}
    for r in got:
        deviation, white = want[r["vec_id"]]
        k = r["component"] - 1
        s = sign.setdefault(k, np.sign(r["whitened"] * white[k]))
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"] * s - white[k]) < 1e-8 and abs(r["explained"] - explained[k]) < 1e-10
        assert r["identity_error"] < 1e-9


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors(spark, []).limit(0)).collect() == []
    assert whitening.whiten(vectors(spark, odd(3)[:5])).collect() == []
    equal = whitening.whiten(vectors(spark, [(k // 2, [0.5, 0.25]) for k in range(6)])).collect()
    assert len(equal) == 12 and all(r["whitened"] == 0 and r["deviation"] == 0 and r["explained"] == 0 and r["identity_error"] == 0 for r in equal)
    flat = whitening.whiten(vectors(spark, [(k, [k, 2 * k, 1]) for k in range(20)])).collect()
    assert {r["component"] for r in flat} == {1, 2, 3} and all(r["whitened"] == 0 for r in flat if r["component"] > 1)
    assert abs(sum(r["whitened"] ** 2 for r in flat if r["component"] == 1) / 20 - 1) < 1e-9 and flat[0]["identity_error"] < 1e-9


def test_lengths_the_most_frequent_stays(spark):
    rows = [(k, rng.normal(size=4)) for k in range(9)] + [(20 + k, rng.normal(size=6)) for k in range(4)]
    assert {r["vec_id"] for r in whitening.whiten(vectors(spark, rows)).collect()} == set(range(9))


def test_whitening_whole_table(spark, sf_dir):
    got = queries.op12_embedding_whitening(spark, sf_dir)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    want, explained, n = whitened_truth([(r["vec_id"], r["embedding"]) for r in table], 32)
    rows = got.collect()
    assert len(rows) == 32 * n
    for k in (0, 31):
        pairs = np.array([(r["whitened"], want[r["vec_id"]][1][k]) for r in rows if r["component"] == k + 1])
        assert np.abs(np.abs(pairs[:, 0]) - np.abs(pairs[:, 1])).max() < 1e-7


# --- clustering ------------------------------------------------------------------------


def clustered_truth(rows, d, n, rounds):
    x = [(k, [int(np.floor(1024 * float(np.float32(c)))) for c in v]) for k, v in rows]
    order = sorted(x, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:n]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(centroids)), key=lambda k: (far(v, centroids[k]), k))
    for _ in range(rounds):
        of = [nearest(v) for _, v in x]
        for k in range(len(centroids)):
            own = [v for (_, v), c in zip(x, of) if c == k]
            if own:
                centroids[k] = [sum(v[j] for v in own) // len(own) for j in range(d)]
    out = [(i, nearest(v), far(v, centroids[nearest(v)])) for i, v in x]
    inertia = [sum(f for _, c, f in out if c == k) for k in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, c, f, inertia[c], sum(inertia), digest[c]) for i, c, f in out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("chunk", [7, clusters.CHUNK])
def test_clusters_equal_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(clusters, "CHUNK", chunk)
    d = 6
    rows = [(k, np.round(rng.normal(size=d), 1)) for k in range(150)] + [(200 + k, np.full(d, 0.5)) for k in range(70)] + [(270 + k // 3, [k % 2] * d) for k in range(12)]
    got = clusters.cluster(vectors(spark, rows + odd(d)), d, 5, 4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert found(got) == clustered_truth(rows, d, 5, 4)


def test_few_equal_and_far_vectors(spark):
    few = [(1, [0.1, 0.2]), (2, [0.1, 0.2])]
    assert found(clusters.cluster(vectors(spark, few), 2)) == clustered_truth(few, 2, 8, 10)
    assert found(clusters.cluster(vectors(spark, []).limit(0), 2)) == []
    far = [(1, [2.0**40, 0]), (2, [-(2.0**40), 1]), (3, [2.0**40, 2.0**17]), (4, [3.0, 3.0])]
    want = [(i, c, f if f < 2**63 else None) for i, c, f, *_ in clustered_truth(far, 2, 2, 10)]
    assert [r[:3] for r in found(clusters.cluster(vectors(spark, far), 2, 2))] == want
    nulls = spark.createDataFrame([(None, [1.0, 2.0], "c", 1), (5, [1.0, 2.5], "c", 1)], SCHEMA)
    assert [r["vec_id"] for r in clusters.cluster(nulls, 2, 1).orderBy("vec_id").collect()] == [None, 5]


def test_dictionaries_lose_nothing_and_join_copies():
    x = rng.integers(-50, 50, (400, 8))
    x[:250] = x[0]
    for rows in (x, x[:250], x[:1], x[:, :3]):
        back = np.empty_like(rows)
        for first, entries, codes in clusters.dictionaries(rows):
            back[:, first : first + entries.shape[1]] = entries[codes]
        assert (back == rows).all()
    assert [(f, e.shape) for f, e, _ in clusters.dictionaries(x[:250])] == [(0, (1, 8))]


def test_clusters_equal_their_sql(spark, sf_dir):
    oracle.same(queries.op13_centroid_clustering(spark, sf_dir), oracle.connect(sf_dir), clusters.ORACLE)
