"""Experiment cells as VARIANT: paths into profiles, membership of a chosen cell, and applying it."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variant_path(path: Column) -> Column:
    """`a[0].b` and `a.0.b` as a path of variants; a part of digits is a place in a list, quotes in names make the path null."""
    parts = F.split(F.regexp_replace(F.trim(path), r"\[(\d+)\]", ".$1"), r"\.")
    way = F.concat(F.lit("$"), F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("["), p, F.lit("]"))).otherwise(F.concat(F.lit("['"), p, F.lit("']")))), ""))
    return F.when(~F.contains(path, F.lit("'")) & (F.trim(path) != ""), way)


def resolved(profile: Column, path: Column) -> Column:
    """The value at a path of a profile (VARIANT); null where it leads nowhere or to a null."""
    value = F.try_variant_get(profile, variant_path(path), "variant")
    return F.when(~F.is_variant_null(value), value)


def canonical(cell: Column) -> Column:
    """One text for equal cells, whatever the order of their keys; a cell is a string or an object."""
    return F.to_json(cell)


def unresolved_axes(profiles: DataFrame, axes: DataFrame) -> DataFrame:
    """(id, path) of axes (id, path) that would change nothing: profiles (id, profile) have no value there."""
    own = axes.join(profiles.hint("merge"), "id", "left")
    return own.where(resolved(F.col("profile"), F.col("path")).isNull()).select("id", "path")


def chosen(choices: DataFrame, results: DataFrame) -> DataFrame:
    """Choices (run, cell) whose cell is one of their run's results (run, cell), cells being VARIANT."""
    key = lambda df: df.withColumn("_key", canonical(F.col("cell")))
    known = key(results).select("run", "_key").distinct()
    return key(choices).join(known.hint("merge"), ["run", "_key"], "left_semi").drop("_key")


def _set(profile: str, cell: str) -> str:
    """A profile's JSON with the paths of an object cell set; other cells change nothing."""
    out, values = json.loads(profile), json.loads(cell)
    for path, value in values.items() if isinstance(values, dict) else ():
        *way, last = path.replace("[", ".").replace("]", "").split(".")
        at = out
        for part in way:
            at = at[int(part)] if isinstance(at, list) else at.setdefault(part, {})
        if isinstance(at, list):
            at[int(last)] = value
        else:
            at[last] = value
    return json.dumps(out, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def apply_cells(profiles: DataFrame, runs: DataFrame, results: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles (id, locked, profile as JSON text) after choices (run, cell), and the refused choices (run, reason).

    A run (run, id, status) must be done, the cell one of its results, the profile there and
    unlocked, and each path of the cell must lead to a value; runs give one choice each, and
    of several for one profile the largest run counts.
    """
    fits = chosen(choices, results).select("run").distinct().withColumn("_fits", F.lit(True))
    own = choices.join(runs.hint("merge"), "run", "left").join(fits.hint("merge"), "run", "left").join(profiles.hint("merge"), "id", "left")
    way = F.when(F.schema_of_variant("cell").startswith("OBJECT"), F.map_keys(F.from_json(F.to_json("cell"), "map<string,string>"))).otherwise(F.array().cast("array<string>"))
    own = own.withColumns({"_paths": way, "_v": F.try_parse_json("profile")})
    lost = F.exists("_paths", lambda p: resolved(F.col("_v"), p).isNull())
    reason = (
        F.when(F.coalesce("status", F.lit("")) != "done", "run not finished").when(F.col("_fits").isNull(), "cell is no result of the run").when(F.col("profile").isNull(), "no such profile")
        .when(F.col("locked"), "profile is locked").when(lost, "a path leads nowhere")
    )
    judged = own.withColumn("reason", reason)
    last = judged.where("reason is null").groupBy("id").agg(F.max_by(F.to_json("cell"), "run").alias("_cell"))

    @F.pandas_udf("string")
    def put(profile: pd.Series, cell: pd.Series) -> pd.Series:
        return pd.Series([p if c is None else _set(p, c) for p, c in zip(profile, cell)], dtype=object)

    new = profiles.join(last.hint("merge"), "id", "left").withColumn("profile", F.when(F.col("_cell").isNotNull(), put("profile", "_cell")).otherwise(F.col("profile"))).drop("_cell")
    return new, judged.where("reason is not null").select("run", "reason")
