"""Centroid clustering of integer vectors over subvector dictionaries.

Vectors are dealt to chunks of at most CHUNK rows as they are read.  A chunk is encoded
once: each dimension gets the dictionary of its distinct values, and neighbouring blocks of
dimensions are joined to one dictionary of distinct subvectors wherever that makes a round
cheaper (copies end up as one entry of all dimensions).  Encoding loses nothing.  Encoded chunks are
written to the shared folder and are all that the rounds read.  A round computes the
exact distance of every dictionary entry to every centroid once, sums those partial
distances by code to choose a vector's centroid, and sums entries by their number of uses;
only the sums for each centroid and dimension are shuffled, one row a task at most.  A
dictionary belongs to its chunk, as in columnar files: its size is bounded, no vector is
shuffled by a key, and frequent vectors need no other treatment.  All arithmetic is on
integers, in 64 bits where a bound shows that they suffice and on Python integers otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

CHUNK = 16_384
ROUNDS = 10
CENTROIDS = 8
SCALE = 1024
#: Scaled components from here on aren't all whole numbers of their own as doubles.
LARGEST = 2**53


def usable(vector: Column, scale: int) -> Column:
    """Neither null nor with entries that are null, not finite or at least 2^53 once scaled."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST / scale))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def quantised(vector: Column, scale: int, shift: int = 0) -> Column:
    """floor(scale * x) + shift of every entry, as long."""
    return F.transform(vector, lambda x: (F.floor(x.cast("double") * scale) + shift).cast("long"))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as one array."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


# --- dictionaries ----------------------------------------------------------------------


def dictionaries(x: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks (first dimension, distinct subvectors, code of each row) that cover all dimensions of x."""
    open_, closed = [], []
    for j in range(x.shape[1]):
        values, codes = np.unique(x[:, j], return_inverse=True)
        open_.append((j, values[:, None], codes))
    while open_:
        merged, k = [], 0
        while k < len(open_):
            a = open_[k]
            b = open_[k + 1] if k + 1 < len(open_) else None
            if b is None or a[1].shape[1] != b[1].shape[1] or a[0] + a[1].shape[1] != b[0]:
                closed.append(a)
                k += 1
                continue
            m, w = len(b[1]), a[1].shape[1]
            pairs, codes = np.unique(a[2] * m + b[2], return_inverse=True)
            if len(pairs) * 2 * w <= (len(a[1]) + m) * w + len(x):  # entries to measure against rows to look up
                merged.append((a[0], np.hstack([a[1][pairs // m], b[1][pairs % m]]), codes))
            else:
                closed += [a, b]
            k += 2
        open_ = merged
    return sorted(closed, key=lambda block: block[0])


def _packed(ids: list, id_type: pa.DataType, x: np.ndarray) -> pa.RecordBatch:
    blocks = dictionaries(x)
    codes = np.stack([c for _, _, c in blocks]).astype("<u2")
    return pa.RecordBatch.from_pydict({
        "ids": pa.array([ids], pa.list_(id_type)), "firsts": pa.array([[b[0] for b in blocks]], pa.list_(pa.int32())), "sizes": pa.array([[len(b[1]) for b in blocks]], pa.list_(pa.int32())),
        "entries": pa.array([np.concatenate([b[1].ravel() for b in blocks])], pa.list_(pa.int64())), "codes": pa.array([codes.tobytes()], pa.binary()),
    })


def encode(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, x array of long of one length) as dictionary-encoded chunks of at most CHUNK rows."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, kind = [], [], None
        for batch in batches:
            kind, x, at = batch.column("vec_id").type, matrix(batch.column("x")), 0
            own = batch.column("vec_id").to_pylist()
            while at < len(x):
                stop = at + CHUNK - len(ids)
                ids += own[at:stop]
                parts.append(x[at:stop])
                at = min(stop, len(x))
                if len(ids) == CHUNK:
                    yield _packed(ids, kind, np.concatenate(parts))
                    ids, parts = [], []
        if ids:
            yield _packed(ids, kind, np.concatenate(parts))

    return vectors.select("vec_id", "x").mapInArrow(run, f"ids array<{id_type}>, firsts array<int>, sizes array<int>, entries array<long>, codes binary")


def _unpacked(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[pa.Array, list]]:
    for k in range(batch.num_rows):
        ids = batch.column("ids")[k].values
        firsts, sizes, entries = (batch.column(c)[k].values.to_numpy() for c in ("firsts", "sizes", "entries"))
        codes = np.frombuffer(batch.column("codes")[k].as_buffer(), "<u2").reshape(len(firsts), len(ids))
        blocks, at = [], 0
        for j, (first, size) in enumerate(zip(firsts, sizes)):
            width = (firsts[j + 1] if j + 1 < len(firsts) else dimensions) - first
            blocks.append((int(first), entries[at : at + size * width].reshape(size, width), codes[j].astype(np.int64)))
            at += size * width
        yield ids, blocks


# --- rounds ----------------------------------------------------------------------------


def _nearest(blocks: list, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its squared distance, exactly; the smaller number wins a tie."""
    top = max([int(np.abs(centroids).max()), *(int(np.abs(e).max()) for _, e, _ in blocks)])
    kind = np.int64 if centroids.shape[1] * (2 * top) ** 2 < 2**63 else object
    centroids, total = centroids.astype(kind), 0
    for first, entries, codes in blocks:
        gap = entries.astype(kind)[:, None, :] - centroids[None, :, first : first + entries.shape[1]]
        total = total + (gap * gap).sum(axis=2)[codes]
    best = total.argmin(axis=1)
    return best, total[np.arange(len(best)), best]


def _sums(encoded: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """Sums by (centroid, dimension) over the vectors nearest to it; dimension -1 has their number."""
    n, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, d + 1), object)
        for batch in batches:
            for ids, blocks in _unpacked(batch, d):
                best, _ = _nearest(blocks, centroids)
                total[:, d] += np.bincount(best, minlength=n).astype(object)
                for first, entries, codes in blocks:
                    uses = np.bincount(best * len(entries) + codes, minlength=n * len(entries)).reshape(n, len(entries))
                    kind = np.int64 if int(np.abs(entries).max()) * len(ids) < 2**63 else object
                    total[:, first : first + entries.shape[1]] += (uses.astype(kind) @ entries.astype(kind)).astype(object)
        used = [(k, j) for k in range(n) if total[k, d] for j in range(-1, d)]
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array([k for k, _ in used], pa.int32()), "dimension": pa.array([j for _, j in used], pa.int32()),
            "total": pa.array([Decimal(int(total[k, j])) for k, j in used], pa.decimal128(38, 0)),
        })

    partial = encoded.mapInArrow(run, "cluster int, dimension int, total decimal(38,0)")
    return {(r[0], r[1]): int(r[2]) for r in partial.groupBy("cluster", "dimension").agg(F.sum("total")).collect()}


def _moved(centroids: np.ndarray, sums: dict[tuple[int, int], int]) -> np.ndarray:
    rows = [[sums[k, j] // sums[k, -1] for j in range(centroids.shape[1])] if (k, -1) in sums else list(row) for k, row in enumerate(centroids)]
    return np.array(rows, np.int64)


def _assigned(encoded: DataFrame, centroids: np.ndarray, id_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, blocks in _unpacked(batch, centroids.shape[1]):
                best, distance = _nearest(blocks, centroids)
                fits = [int(x) if x < 2**63 else None for x in distance]
                yield pa.RecordBatch.from_pydict({"vec_id": ids, "cluster": pa.array(best, pa.int32()), "distance": pa.array(fits, pa.int64())})

    return encoded.mapInArrow(run, f"vec_id {id_type}, cluster int, distance long")


def cluster(embeddings: DataFrame, dimensions: int = 64, clusters: int = CENTROIDS, rounds: int = ROUNDS, seed: str = "3:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    The first centroids are the vectors with the smallest sha256 of seed and vec_id.  A round
    moves each centroid to the floor of its vectors' mean; one without vectors stays.  Vectors
    that are null, of another length, or hold entries that are null, not finite or of 2^43 and
    more are left out.  Repeated rows are vectors of their own; among equal vec_ids and for
    null ones, which come last, the smaller vector comes first.  Fewer vectors than centroids
    give fewer centroids, an empty table an empty result.  A distance beyond a long is null and in
    no inertia.  Other columns stay behind.
    """
    vector = F.col("embedding")
    kept = embeddings.where((F.size(vector) == dimensions) & usable(vector, SCALE)).select("vec_id", quantised(vector, SCALE).alias("x"))
    id_type = kept.schema["vec_id"].dataType.simpleString()
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    centroids = np.array([r[0] for r in kept.orderBy(order, "x").select("x").limit(clusters).collect()], np.int64).reshape(-1, dimensions)
    encoded = written(encode(kept), "encoded-vectors")
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(centroids, _sums(encoded, centroids))
    assigned = written(_assigned(encoded, centroids, id_type), "assigned-vectors")
    inertia = {r[0]: int(r[1]) if r[1] is not None else None for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    whole = sum(x for x in inertia.values() if x is not None)
    digest = {k: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for k, c in enumerate(centroids.tolist())}
    of = lambda values, kind: F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("cluster")).cast(kind) if values else F.lit(None).cast(kind)
    return assigned.select("vec_id", "cluster", "distance", of(inertia, "long").alias("cluster_inertia"), F.lit(whole).cast("long").alias("inertia"), of(digest, "string").alias("centroid_sha256"))


def _oracle() -> str:
    steps = [f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
e AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS d, unnest(q) AS x FROM v),
s AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, q FROM v ORDER BY k LIMIT {CENTROIDS}),
c0 AS MATERIALIZED (SELECT k, unnest(range(64)) AS d, unnest(q) AS x FROM s)"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""g{r} AS (SELECT vec_id, k, sum((e.x - c.x) * (e.x - c.x)) AS far FROM e JOIN c{r} c USING (d) GROUP BY vec_id, k),
a{r} AS MATERIALIZED (SELECT vec_id, arg_min(k, far * {CENTROIDS} + k) AS k, min(far) AS far FROM g{r} GROUP BY vec_id)""")
        if r < ROUNDS:
            steps.append(f"""t{r} AS (SELECT k, d, sum(x) AS total, count(*) AS n FROM e JOIN a{r} USING (vec_id) GROUP BY k, d),
c{r + 1} AS MATERIALIZED (SELECT k, d, CAST(coalesce((total - ((total % n) + n) % n) // n, c.x) AS BIGINT) AS x FROM c{r} c LEFT JOIN t{r} USING (k, d))""")
    last = ROUNDS
    return ",\n".join(steps) + f""",
h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS digest FROM c{last} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(far AS BIGINT) AS distance, CAST(sum(far) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(far) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256 FROM a{last} JOIN h USING (k)"""


ORACLE = _oracle()
