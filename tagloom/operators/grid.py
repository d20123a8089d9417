"""Render plans: parameters of each render after overrides, inheritance and styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..shared import looked_up

MOST_UNITS = 3
#: What a plan takes where neither an override nor the profile says anything.
BASE = {"seed": -1, "steps": 24, "cfg_scale": 6.0, "distilled_cfg_scale": 3.0, "sampler": "Euler a", "scheduler": "Karras", "width": 768, "height": 1024, "checkpoint": "YOUR_CHECKPOINT.safetensors", "negative_prompt": ""}
HIRES = {"scale": 2.0, "upscaler": "RealESRGAN_x4plus_anime_6B", "steps": 10, "denoise": 0.45, "cfg": 4.5}
TAB = {"confidence": 0.3, "denoise": 0.4, "padding": 32}


def render_plans(rows: DataFrame, styles: DataFrame, images: DataFrame) -> DataFrame:
    """One plan a render, with all that a generator is told.

    rows: doc_id, override (prompt, seed, steps, cfg_scale), base, loras, hires, detailer
    (strip_lora_from_prompt, tabs), units and style; styles as for apply_styles, images as for
    control_units.  An override comes before the profile, the profile before the defaults.
    hires is null unless enabled; every enabled tab is there, its prompt its own, else the
    prompt without loras (with them if stripping is off, as null, which leaves it to the
    generator); units are those that are enabled, have a model and an image that is there, the
    first MOST_UNITS.  The style wraps the prompt last.
    """
    over = {"prompt", "seed", "steps", "cfg_scale"}
    pick = lambda name: F.coalesce(*([F.col(f"override.{name}")] if name in over else []), F.col(f"base.{name}"), *([F.lit(BASE[name])] if name in BASE else []))
    own = rows.withColumn("prompt", t.merge_loras(F.coalesce(pick("prompt"), F.lit("")), F.col("loras"))).withColumns({name: pick(name) for name in BASE})
    hires = F.struct(*(F.coalesce(F.col(f"hires.{name}"), F.lit(default)).alias(name) for name, default in HIRES.items()))
    bare = F.when(F.coalesce("detailer.strip_lora_from_prompt", F.lit(True)), t.strip_loras(F.col("prompt")))
    tab = lambda b: lambda x: F.struct(
        x["model"].alias("model"), *(F.coalesce(x[name], F.lit(default)).alias(name) for name, default in TAB.items()),
        F.coalesce(F.nullif(x["prompt_override"], F.lit("")), b).alias("prompt"), F.nullif(x["negative_override"], F.lit("")).alias("negative"),
    )
    on = F.filter(F.coalesce("detailer.tabs", F.array().cast(rows.schema["detailer"].dataType["tabs"].dataType)), lambda x: F.coalesce(x["enabled"], F.lit(False)))
    # the bare prompt is bound once for all tabs
    tabs = F.get(F.transform(F.array(F.coalesce(bare, F.lit("\0"))), lambda b: F.transform(on, tab(F.nullif(b, F.lit("\0"))))), F.lit(0))
    own = own.withColumns({"hires": F.when(F.col("hires.enabled"), hires), "tabs": tabs})
    styled = apply_styles(own.select("doc_id", "prompt", "negative_prompt", "style"), styles).select("doc_id", F.col("prompt").alias("_prompt"), F.col("negative").alias("_negative"))
    units = control_units(rows, images).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "unit"))), lambda x: x["unit"]).alias("_units"))
    out = own.join(styled.hint("merge"), "doc_id").join(units.hint("merge"), "doc_id", "left")
    no_units = F.array().cast(rows.schema["units"].dataType)
    return out.select("doc_id", F.col("_prompt").alias("prompt"), F.col("_negative").alias("negative_prompt"), *(c for c in BASE if c != "negative_prompt"), "hires", "tabs", F.coalesce("_units", no_units).alias("units"))


def batch(profiles: DataFrame, lines: Column, mode: str, most: int = 64) -> DataFrame:
    """A row for each of the first `most` lines of each profile (doc_id, prompt, seed): doc_id, line, seed, prompt.

    Seeds are fixed, random (-1), or count up from a seed that isn't negative.  A line follows
    the prompt on a new line if that holds a lora, else after a comma; an empty line leaves the
    prompt as it is.
    """
    own = profiles.select("doc_id", F.col("prompt").alias("_base"), F.coalesce("seed", F.lit(-1)).cast("long").alias("_seed"), F.posexplode(F.slice(lines, 1, most)).alias("line", "_raw"))
    seed = {"fixed": F.col("_seed"), "random": F.lit(-1).cast("long"), "increment": F.when(F.col("_seed") >= 0, F.col("_seed") + F.col("line")).otherwise(F.lit(-1).cast("long"))}[mode]
    by = F.when(F.contains("_base", F.lit("<lora:")), "\n").otherwise(", ")
    full = F.when(F.col("_raw") == "", F.col("_base")).otherwise(F.concat(F.regexp_replace("_base", r"\s+\z", ""), by, F.regexp_replace("_raw", r"^\s+|\s+\z", "")))
    return own.select("doc_id", "line", seed.alias("seed"), full.alias("prompt"))


def control_units(rows: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, pos, unit) of enabled control units with a model whose image file, by its base name, is among images (file); at most MOST_UNITS a render."""
    own = rows.select("doc_id", F.posexplode("units").alias("pos", "unit")).where("unit.enabled and coalesce(unit.model, 'None') <> 'None'")
    own = own.withColumn("file", F.element_at(F.split("unit.image_file", "/"), -1))
    own = looked_up(own, images.select("file").distinct(), "file", "doc_id", "left_semi").drop("file")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return own.withColumn("nth", nth).where(F.col("nth") <= MOST_UNITS).drop("nth")


def apply_styles(rows: DataFrame, styles: DataFrame) -> DataFrame:
    """Prompts (doc_id, prompt, negative_prompt, style) wrapped by their style (nth, name, prompt, negative_prompt).

    Of styles with one name the first whose prompt has {prompt} counts; a missing style
    changes nothing; a style's negative comes first.
    """
    known = styles.where("contains(prompt, '{prompt}')").groupBy("name").agg(F.min(F.struct("nth", "prompt", "negative_prompt")).alias("s"))
    known = known.select(F.col("name").alias("style"), F.col("s.prompt").alias("template"), F.coalesce("s.negative_prompt", F.lit("")).alias("extra"))
    own = looked_up(rows, known, "style", "doc_id")
    both = F.concat_ws(", ", F.nullif("extra", F.lit("")), F.nullif("negative_prompt", F.lit("")))
    return own.select("doc_id", "style", F.when(F.col("template").isNotNull(), F.replace("template", F.lit("{prompt}"), F.col("prompt"))).otherwise(F.col("prompt")).alias("prompt"), F.when(F.col("template").isNotNull(), both).otherwise(F.col("negative_prompt")).alias("negative"))


def paths(schema: T.StructType, prefix: str = "") -> set[str]:
    """All settable leaf paths of a profile schema; an array stands for each of its elements as `a[]`."""
    found: set[str] = set()
    for f in schema.fields:
        kind, at = f.dataType, prefix + f.name
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            found |= paths(kind.elementType, at + "[].")
        elif isinstance(kind, T.StructType):
            found |= paths(kind, at + ".")
        else:
            found.add(at)
    return found


def normal_path(path: str) -> str:
    """`a[0].b` and `a.0.b` are one path."""
    return ".".join(p for p in path.replace("[", ".").replace("]", "").split(".") if p)


def overlay(rows: DataFrame, path: str, value: Column) -> DataFrame:
    """Set one path of a typed profile; a path that the schema doesn't have is refused when the plan is made."""
    parts = normal_path(path).split(".")
    known = ".".join("[]" if p.isdigit() else p for p in parts).replace(".[]", "[]")
    if known not in paths(rows.schema):
        raise ValueError(f"no such path: {path}")

    def put(column: Column, rest: list[str]) -> Column:
        if not rest:
            return value
        if rest[0].isdigit():
            return F.transform(column, lambda x, i: F.when(i == int(rest[0]), put(x, rest[1:])).otherwise(x))
        return column.withField(rest[0], put(column[rest[0]], rest[1:]))

    return rows.withColumn(parts[0], put(F.col(parts[0]), parts[1:]))
