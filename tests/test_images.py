"""Hashes of image files and resampling against loops over pixels."""

import math
import random
import struct
import zlib

import pytest

from tagloom.operators import resample

rng = random.Random(4)


def png(rows, kind=2):
    """A PNG of rows of pixels (tuples of bytes); kind 0 is grey, 2 colour, 6 colour with transparency."""

    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, kind, 0, 0, 0)
    body = b"".join(b"\0" + b"".join(bytes(p) for p in r) for r in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def kernel(u):
    return 1.0 if u == 0 else 0.0 if abs(u) >= 3 else 3 * math.sin(math.pi * u) * math.sin(math.pi * u / 3) / (math.pi * u) ** 2


def shrunk(line, wanted, whole=True):
    n, out = len(line), []
    scale = n / wanted
    for t in range(wanted):
        w = [kernel((s + 0.5 - (t + 0.5) * scale) / max(1, scale)) for s in range(n)]
        total = sum(w)
        if whole:
            value = sum(round(x / total * 2**22) * v for x, v in zip(w, line)) + 2**21 >> 22
            out.append(min(255, max(0, value)))
        else:
            out.append(sum(x * v for x, v in zip(w, line)) / total)
    return out


def turned(rows):
    return [list(r) for r in zip(*rows)]


def hash_of(luma):
    a = turned([shrunk(r, 32) for r in luma])
    a = turned([shrunk(r, 32) for r in a])
    c = lambda k, n: math.sqrt((1 if k == 0 else 2) / 32) * math.cos((2 * n + 1) * k * math.pi / 64)
    f = [round(sum(a[y][x] * c(ky, y) * c(kx, x) for y in range(32) for x in range(32)), 6) for ky in range(8) for kx in range(8)]
    mid = sorted(f[1:])[31]
    return sum((v > mid) << (63 - i) for i, v in enumerate(f))


def scene(h, w, kind):
    fx, fy, ph = rng.uniform(0.05, 0.5), rng.uniform(0.05, 0.5), rng.uniform(0, 6)
    v = lambda y, x, c: int(127 + 80 * math.sin(fx * x + fy * y + ph + c) + rng.randrange(40))
    n = {0: 1, 2: 3, 6: 4}[kind]
    return [[tuple(v(y, x, c) for c in range(n)) for x in range(w)] for y in range(h)]


def luma(p):
    return p[0] if len(p) == 1 else (19595 * p[0] + 38470 * p[1] + 7471 * p[2] + 0x8000) >> 16


def test_hashes_of_png_files(spark, tmp_path):
    want = {}
    for k, (h, w, kind) in enumerate([(40, 64, 2), (64, 33, 0), (20, 25, 2), (32, 32, 6), (1, 50, 2), (90, 70, 2)]):
        rows = scene(h, w, kind)
        (tmp_path / f"{k}.png").write_bytes(png(rows, kind))
        want[f"{k}.png"] = (h, w, hash_of([[luma(p) for p in r] for r in rows]))
    (tmp_path / "broken.png").write_bytes(png(scene(9, 9, 2))[:40])
    (tmp_path / "text.png").write_bytes(b"no picture")
    got = {r.path.rsplit("/", 1)[1]: (r.height, r.width, None if r.h is None else r.h % 2**64) for r in resample.phash(spark, f"file:{tmp_path}/*.png").collect()}
    assert got == want | {"broken.png": (None, None, None), "text.png": (None, None, None)}


def test_near_copies_have_near_hashes(spark, tmp_path):
    rows = scene(48, 48, 2)
    brighter = [[tuple(min(255, c + 6) for c in p) for p in r] for r in rows]
    for name, x in (("a", rows), ("b", brighter), ("c", scene(48, 48, 2))):
        (tmp_path / f"{name}.png").write_bytes(png(x))
    h = {r.path[-5]: r.h for r in resample.phash(spark, f"file:{tmp_path}/*.png").collect()}
    gap = lambda x, y: bin((h[x] ^ h[y]) % 2**64).count("1")
    assert gap("a", "b") <= 6 < gap("a", "c")


@pytest.mark.parametrize("target", [(4, 9), (12, 3), (7, 5), (1, 1), (20, 20)])
def test_resize_equals_loops(spark, tmp_path, target):
    rows = scene(7, 5, 2)
    (tmp_path / "x.png").write_bytes(png(rows))
    pixels = resample.image_pixels(spark, f"file:{tmp_path}/x.png")
    first = {(r.y, r.x): (r.r, r.g, r.b) for r in pixels.collect()}
    assert first == {(y, x): tuple(c / 255 for c in rows[y][x]) for y in range(7) for x in range(5)}
    wanted = pixels.select("img").distinct().selectExpr("img", f"{target[0]} AS height", f"{target[1]} AS width")
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in resample.resize(pixels, wanted).collect()}
    assert len(got) == target[0] * target[1]
    for c in range(3):
        plane = [shrunk([p[c] / 255 for p in r], target[1], False) for r in rows]
        plane = turned([shrunk(r, target[0], False) for r in turned(plane)])
        assert all(abs(got[y, x][c] - plane[y][x]) < 1e-9 for y in range(target[0]) for x in range(target[1]))
    rounded = resample.resize(pixels, wanted, levels=255).collect()
    assert all(0 <= v <= 1 and abs(v * 255 - round(v * 255)) < 1e-9 for r in rounded for v in (r.r, r.g, r.b))


def test_pairs_of_different_sizes(spark):
    flat = [(img, y, x, v, v, v) for img, h, w, v in ((1, 4, 4, 0.5), (2, 2, 3, 0.5), (3, 4, 4, 0.25)) for y in range(h) for x in range(w)]
    pixels = spark.createDataFrame(flat, "img long, y int, x int, r double, g double, b double")
    pairs = spark.createDataFrame([(2, 1), (3, 1), (1, 2)], "img long, img0 long")
    rows = resample.paired(pixels, pairs).collect()
    assert sorted((r.img, r.img0) for r in rows) == [(1, 2)] * 16 + [(2, 1)] * 6 + [(3, 1)] * 16
    assert all(abs(r.r0 - 0.5) < 1e-12 for r in rows)


def test_lookups_deal_frequent_keys(spark):
    """With more keys than are broadcast, rows of a frequent key go to several tasks and meet their key once."""
    from pyspark.sql import functions as F

    from tagloom import shared

    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3900, "hot").otherwise(F.col("id").cast("string")).alias("style"))
    known = spark.createDataFrame([("hot", 1)] + [(str(k), k) for k in range(3900, 3950)], "style string, v int")
    for most in (100, 10):
        got = shared.looked_up(rows, known, "style", "doc_id", most=most)
        assert (got.count(), got.where("v = 1").count(), got.where("v is null").count(), got.columns) == (4000, 3900, 50, ["style", "doc_id", "v"])
    salts = rows.where("style = 'hot'").select(F.pmod(F.xxhash64("doc_id"), F.lit(shared.SALTS))).distinct().count()
    assert salts == shared.SALTS
