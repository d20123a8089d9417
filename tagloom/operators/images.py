"""Image metrics on pixel rows (img, y, x, r, g, b in 0..1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS, KAPPA = 216 / 24389, 24389 / 27
# Linear sRGB to XYZ rows, and the D65 white point.
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def _linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def _lab_f(v: Column) -> Column:
    return F.when(v > EPS, F.cbrt(v)).otherwise((KAPPA * v + 16) / 116)


def with_lab(pixels: DataFrame) -> DataFrame:
    """Adds CIELAB columns lab_l, lab_a, lab_b."""
    own = pixels.withColumns({f"lin_{c}": _linear(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c)))) for c in "rgb"})
    f = {f"f{k}": _lab_f((row[0] * F.col("lin_r") + row[1] * F.col("lin_g") + row[2] * F.col("lin_b")) / WHITE[k]) for k, row in enumerate(XYZ)}
    own = own.withColumns(f)
    lab = {"lab_l": 116 * F.col("f1") - 16, "lab_a": 500 * (F.col("f0") - F.col("f1")), "lab_b": 200 * (F.col("f1") - F.col("f2"))}
    return own.withColumns(lab).drop("lin_r", "lin_g", "lin_b", "f0", "f1", "f2")


def drift(pairs: DataFrame) -> DataFrame:
    """Per image of joined pixels (img, y, x, r g b, and the baseline's r0 g0 b0 with Lab of both):
    mean and 95th percentile of the absolute difference, similarity, changed share, and Lab shifts in the dilated mask."""
    diff = F.array(*[F.abs(F.col(c) - F.col(f"{c}0")) for c in "rgb"])
    own = pairs.withColumn("most", F.array_max(diff)).withColumn("mean", F.aggregate(diff, F.lit(0.0), lambda a, b: a + b) / 3)
    own = own.withColumn("changed", (F.col("most") > 8 / 255).cast("int"))
    row = Window.partitionBy("img", "y").orderBy("x").rowsBetween(-3, 3)
    own = own.withColumn("wide", F.max("changed").over(row))
    own = own.withColumn("mask", F.max("wide").over(Window.partitionBy("img", "x").orderBy("y").rowsBetween(-3, 3)))
    c1, c2 = 0.01**2, 0.03**2
    ssim = [
        ((2 * F.avg(c) * F.avg(f"{c}0") + c1) * (2 * F.covar_pop(c, f"{c}0") + c2))
        / ((F.pow(F.avg(c), F.lit(2)) + F.pow(F.avg(f"{c}0"), F.lit(2)) + c1) * (F.var_pop(c) + F.var_pop(f"{c}0") + c2))
        for c in "rgb"
    ]
    de = F.sqrt(F.pow(F.col("lab_l") - F.col("lab_l0"), F.lit(2)) + F.pow(F.col("lab_a") - F.col("lab_a0"), F.lit(2)) + F.pow(F.col("lab_b") - F.col("lab_b0"), F.lit(2)))
    masked = lambda v: F.when(F.col("mask") == 1, v)
    zero = lambda v: F.coalesce(F.round(v, 2), F.lit(0.0))
    return own.groupBy("img").agg(
        F.round(F.avg("mean"), 4).alias("mean_abs"), F.round(F.percentile("mean", F.lit(0.95)), 4).alias("p95"), F.round((ssim[0] + ssim[1] + ssim[2]) / 3, 4).alias("ssim"),
        F.round(F.avg(F.col("changed").cast("double")), 4).alias("changed"), zero(F.avg(masked(de))).alias("de_mean"), zero(F.percentile(masked(de), F.lit(0.95))).alias("de_p95"),
        zero(F.avg(masked(F.col("lab_l") - F.col("lab_l0")))).alias("dl"), zero(F.avg(masked(F.col("lab_a") - F.col("lab_a0")))).alias("da"), zero(F.avg(masked(F.col("lab_b") - F.col("lab_b0")))).alias("db"),
    )


# Weights of red, green and blue in the luma.
LUMA = (0.299, 0.587, 0.114)


def texture_energy(pixels: DataFrame) -> DataFrame:
    """Mean absolute 4-neighbour Laplacian of the luma over interior pixels."""
    grey = pixels.select("img", "y", "x", sum((w * F.col(c) for w, c in zip(LUMA[1:], "gb")), LUMA[0] * F.col("r")).alias("v"))
    across, down = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    own = grey.withColumns({"l": F.lag("v").over(across), "r": F.lead("v").over(across), "u": F.lag("v").over(down), "d": F.lead("v").over(down)})
    inside = own.where("l is not null and r is not null and u is not null and d is not null")
    return inside.groupBy("img").agg(F.avg(F.abs(F.col("l") + F.col("r") + F.col("u") + F.col("d") - 4 * F.col("v"))).alias("texture"))


def inset(x0: Column, x1: Column, size: int, share: float = 0.15) -> tuple[Column, Column]:
    """A box's side shrunk by a share at both ends and clamped to the image."""
    d = ((x1 - x0) * F.lit(share)).cast("int")
    return F.greatest(F.lit(0), x0 + d), F.least(F.lit(size), x1 - d)


def region_stats(lab: DataFrame, boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Mean Lab and texture of the pixels in each image's inset box (img, x0, y0, x1, y1); a box without interior pixels has no texture."""
    (x0, x1), (y0, y1) = inset(F.col("x0"), F.col("x1"), width), inset(F.col("y0"), F.col("y1"), height)
    inside = lab.join(boxes.hint("merge"), "img").where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    means = inside.groupBy("img").agg(F.count("*").alias("pixels"), F.avg("lab_l").alias("l"), F.avg("lab_a").alias("a"), F.avg("lab_b").alias("b"))
    return means.join(texture_energy(inside).hint("merge"), "img", "left")
