"""Resampling of pixel rows to other sizes, and perceptual hashes by cosine transforms."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lobes of the Lanczos kernel; side of the picture that is hashed, and of the corner of its transform that is kept.
LOBES, SIDE, CORNER = 3, 32, 8


def lanczos(u: Column) -> Column:
    angle = F.lit(math.pi) * u
    return F.when(u == 0, 1.0).when(F.abs(u) >= LOBES, 0.0).otherwise(LOBES * F.sin(angle) * F.sin(angle / LOBES) / (angle * angle))


def _along(rows: DataFrame, axis: str, had: str, wanted: str, keep: list[str], channels: tuple[str, ...], levels: int | None) -> DataFrame:
    """One pass: each pixel goes to the target positions its weight reaches, and a target is the weighted mean of what came."""
    scale = F.col(had) / F.col(wanted)
    reach = LOBES * F.greatest(scale, F.lit(1.0))
    first = F.greatest(F.lit(0), F.ceil((F.col(axis) + 0.5 - reach) / scale - 0.5).cast("int"))
    last = F.least(F.col(wanted) - 1, F.floor((F.col(axis) + 0.5 + reach) / scale - 0.5).cast("int"))
    sent = rows.withColumns({"_first": first, "_last": last}).where("_first <= _last").withColumn("_at", F.explode(F.sequence("_first", "_last")))
    sent = sent.withColumn("_weight", lanczos((F.col(axis) + 0.5 - (F.col("_at") + 0.5) * scale) / F.greatest(scale, F.lit(1.0))))
    mean = lambda c: F.sum(F.col("_weight") * F.col(c)) / F.sum("_weight")
    held = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.floor(v * levels + 0.5) / levels)) if levels else v
    return sent.groupBy(*keep, F.col("_at").alias(axis)).agg(*(held(mean(c)).alias(c) for c in channels))


def sizes(pixels: DataFrame) -> DataFrame:
    """(img, height, width) of pixel rows."""
    return pixels.groupBy("img").agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"))


def resize(pixels: DataFrame, targets: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), levels: int | None = None) -> DataFrame:
    """Pixel rows (img, y, x, channels in 0..1) at the sizes of targets (img, height, width), which may be several for an image.

    Separable Lanczos interpolation, widened when an image shrinks: weights follow from
    positions, so each of the two passes is one explode and one grouped sum without a join.
    With levels (255 for bytes) values are rounded and clamped after each pass.
    """
    had = sizes(pixels).withColumnsRenamed({"height": "_h", "width": "_w"})
    plan = targets.select("img", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width")).distinct().join(had.hint("merge"), "img")
    rows = pixels.select("img", "y", "x", *channels).join(plan.hint("merge"), "img")
    rows = _along(rows, "x", "_w", "width", ["img", "height", "width", "_h", "y"], channels, levels)
    return _along(rows, "y", "_h", "height", ["img", "height", "width", "x"], channels, levels)


def paired(pixels: DataFrame, pairs: DataFrame, levels: int | None = None) -> DataFrame:
    """Pixels of each image of pairs (img, img0) beside those of its baseline, as r0, g0, b0, resampled where sizes differ.

    A baseline is resampled once for each size it is compared at.
    """
    size = sizes(pixels)
    own = pairs.join(size.hint("merge"), "img").join(size.withColumnsRenamed({"img": "img0", "height": "_h0", "width": "_w0"}).hint("merge"), "img0")
    wanted = own.where("height <> _h0 or width <> _w0").select(F.col("img0").alias("img"), "height", "width").distinct()
    equal = own.where("height = _h0 and width = _w0").select(F.col("img0").alias("img"), "height", "width").distinct()
    plain = pixels.select("img", "y", "x", "r", "g", "b").join(equal.hint("merge"), "img")
    base = plain.unionByName(resize(pixels, wanted, levels=levels).select(plain.columns)).withColumnsRenamed({"img": "img0", "r": "r0", "g": "g0", "b": "b0"})
    rows = pixels.join(own.select("img", "img0", "height", "width").hint("merge"), "img")
    return rows.join(base.hint("merge"), ["img0", "height", "width", "y", "x"]).drop("height", "width")


# --- cosine transforms -----------------------------------------------------------------


def cosines(spark: SparkSession, n: int, keep: int) -> DataFrame:
    """The first rows of the orthonormal DCT-II of n points as a table (k, at, c); n * keep rows, for broadcasting."""
    k, at = F.floor(F.col("id") / n).cast("int").alias("k"), (F.col("id") % n).cast("int").alias("at")
    own = spark.range(n * keep).select(k, at)
    c = F.sqrt(F.when(F.col("k") == 0, 1.0).otherwise(2.0) / n) * F.cos((2 * F.col("at") + 1) * F.col("k") * F.lit(math.pi) / (2 * n))
    return own.withColumn("c", c)


def transform(pixels: DataFrame, n: int, keep: int = CORNER) -> DataFrame:
    """(img, ky, kx, coefficient) of n x n pictures (img, y, x, v): the low corner of their two-dimensional DCT."""
    table = F.broadcast(cosines(pixels.sparkSession, n, keep))
    down = table.withColumnsRenamed({"k": "ky", "at": "y"})
    across = table.withColumnsRenamed({"k": "kx", "at": "x"})
    rows = pixels.join(across, "x").groupBy("img", "y", "kx").agg(F.sum(F.col("v") * F.col("c")).alias("v"))
    return rows.join(down, "y").groupBy("img", "ky", "kx").agg(F.sum(F.col("v") * F.col("c")).alias("coefficient"))


def bits(coefficients: DataFrame) -> DataFrame:
    """(img, h): a bit for each coefficient above the median of all but the first, row by row, the first as the highest bit."""
    rows = coefficients.groupBy("img").agg(F.array_sort(F.collect_list(F.struct("ky", "kx", "coefficient"))).alias("all"))
    values = rows.select("img", F.transform("all", lambda x: x["coefficient"]).alias("all"))
    rest = lambda a: F.sort_array(F.slice(a, 2, F.size(a) - 1))
    middle = F.transform(F.array(rest(F.col("all"))), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)
    held = values.select("img", F.explode(F.transform(middle, lambda m: F.struct(m.alias("m"), F.col("all").alias("all")))).alias("x"))
    return held.select("img", F.aggregate("x.all", F.lit(0).cast("long"), lambda h, v: F.shiftleft(h, 1).bitwiseOR(F.when(v > F.col("x.m"), 1).otherwise(0).cast("long"))).alias("h"))


# --- image files -----------------------------------------------------------------------


def _coefficients(n: int, wanted: int) -> np.ndarray:
    """Fixed-point Lanczos weights, wanted x n."""
    scale = n / wanted
    widen = max(scale, 1.0)
    u = (np.arange(n)[None, :] + 0.5 - (np.arange(wanted)[:, None] + 0.5) * scale) / widen
    w = np.where(np.abs(u) < LOBES, np.sinc(u) * np.sinc(u / LOBES), 0)
    return np.round(w / w.sum(axis=1, keepdims=True) * (1 << 22)).astype(np.int64)


def _squeezed(a: np.ndarray, wanted: int) -> np.ndarray:
    return np.clip((a.astype(np.int64) @ _coefficients(a.shape[1], wanted).T + (1 << 21)) >> 22, 0, 255)


def picture_hash(luma: np.ndarray) -> int:
    """64-bit hash of a picture's bytes of luma, as a signed long."""
    small = _squeezed(_squeezed(luma, SIDE).T, SIDE).T.astype(float)
    k, at = np.arange(SIDE)[:, None], np.arange(SIDE)[None, :]
    m = np.sqrt(np.where(k == 0, 1.0, 2.0) / SIDE) * np.cos((2 * at + 1) * k * np.pi / (2 * SIDE))
    low = np.round((m @ small @ m.T)[:CORNER, :CORNER].ravel(), 6)  # rounding noise is no signal
    value = int("".join("1" if x > np.median(low[1:]) else "0" for x in low), 2)
    return value - (1 << 64) if value >> 63 else value


def phash(spark: SparkSession, glob: str) -> DataFrame:
    """(path, height, width, h) of image files, decoded by Spark's image source; h is null for what is no image.

    Luma is 19595 R + 38470 G + 7471 B in 65536ths, transparency is ignored; a picture is
    shrunk to 32 x 32 in fixed point, and the low 8 x 8 coefficients of its DCT give the bits.
    """
    rows = spark.read.format("image").option("dropInvalid", False).load(glob).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for height, width, channels, data in zip(*(batch.column(c).to_pylist() for c in ("height", "width", "nChannels", "data"))):
                if not data or height <= 0:
                    out.append(None)
                    continue
                a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.int64)
                luma = a[..., 0] if channels == 1 else (19595 * a[..., 2] + 38470 * a[..., 1] + 7471 * a[..., 0] + 0x8000) >> 16
                out.append(picture_hash(luma))
            good = pa.array([x is not None for x in out])
            side = lambda c: pa.compute.if_else(good, batch.column(c), pa.scalar(None, pa.int32()))
            yield pa.RecordBatch.from_pydict({"path": batch.column("origin"), "height": side("height"), "width": side("width"), "h": pa.array(out, pa.int64())})

    return rows.mapInArrow(run, "path string, height int, width int, h long")


def image_pixels(spark: SparkSession, glob: str) -> DataFrame:
    """Pixel rows (img, y, x, r, g, b in 0..1) of image files; img is the path."""
    rows = spark.read.format("image").option("dropInvalid", True).load(glob).select("image.*")
    at = F.posexplode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)).alias("_k", "_n")
    flat = rows.select(F.col("origin").alias("img"), "width", "nChannels", "data", at)
    byte = lambda c: F.conv(F.hex(F.substring(F.col("data"), F.col("_k") * F.col("nChannels") + F.when(F.col("nChannels") == 1, 1).otherwise(c), F.lit(1))), 16, 10).cast("double") / 255
    return flat.select("img", F.floor(F.col("_k") / F.col("width")).cast("int").alias("y"), (F.col("_k") % F.col("width")).cast("int").alias("x"), byte(3).alias("r"), byte(2).alias("g"), byte(1).alias("b"))

