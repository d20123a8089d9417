"""Render profiles: names of other programs' settings, and ratios that are left to shared pins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Node graphs' names and the names that profiles use.
SAMPLERS = {
    "euler_ancestral": "Euler a", "euler": "Euler", "euler_ancestral_cfg_pp": "Euler a CFG++", "dpmpp_2m": "DPM++ 2M", "dpmpp_sde": "DPM++ SDE", "dpmpp_2m_sde": "DPM++ 2M SDE",
    "dpmpp_3m_sde": "DPM++ 3M SDE", "dpmpp_2s_ancestral": "DPM++ 2s a RF", "dpmpp_2m_cfg_pp": "DPM++ 2M CFG++", "ddim": "DDIM", "uni_pc": "UniPC", "lcm": "LCM", "heun": "Heun", "dpm_2": "DPM2",
    "lms": "LMS", "res_multistep": "Res Multistep", "restart": "Restart",
}
SCHEDULERS = {
    "karras": "Karras", "exponential": "Exponential", "sgm_uniform": "SGM Uniform", "simple": "Simple", "ddim_uniform": "DDIM Uniform", "beta": "Beta", "linear_quadratic": "Linear Quadratic",
    "kl_optimal": "KL Optimal", "normal": "Automatic",
}
# By part of a profile, its open fields, their names among the pins and their last defaults.
RATIOS = {
    "base": (("steps", "steps", 24), ("cfg_scale", "cfg_scale", 6.0), ("distilled_cfg_scale", "distilled_cfg_scale", 3.0)),
    "hires": (("scale", "hr_scale", 2.0), ("steps", "hr_steps", 10), ("denoise", "hr_denoise", 0.45), ("cfg", "hr_cfg", 4.5)),
    "tabs": (("confidence", "confidence", 0.3), ("denoise", "denoise", 0.4), ("padding", "padding", 32)),
}


def known_name(key: Column, names: dict[str, str]) -> Column:
    """The profile's name of a key; unknown keys stay as they are."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key), key)


def inherit(profiles: DataFrame, pins: dict) -> DataFrame:
    """Null ratios of base, hires and each of the tabs take the shared pin, else the default; a missing hires part stays missing."""

    def filled(part: Column, name: str) -> Column:
        for field, pin, default in RATIOS[name]:
            part = part.withField(field, F.coalesce(part[field], F.lit(pins[pin] if pins.get(pin) is not None else default)))
        return part

    return profiles.withColumns({
        "base": filled(F.col("base"), "base"), "hires": F.when(F.col("hires").isNotNull(), filled(F.col("hires"), "hires")), "tabs": F.transform("tabs", lambda t: filled(t, "tabs")),
    })


def model_ref(ref: Column) -> Column:
    """struct(kind, id) of a reference to a model: digits alone are a model, `modelVersionId=` a version, `/models/` a model; else kind is reject."""
    bare = F.trim(F.coalesce(ref, F.lit("")))
    part = lambda pattern: F.nullif(F.regexp_extract(bare, pattern, 1), F.lit(""))
    digits, version, model = part("^([0-9]+)$"), part("[?&]modelVersionId=([0-9]+)"), part("/models/([0-9]+)")
    kind = F.when(digits.isNotNull(), "model").when(version.isNotNull(), "version").when(model.isNotNull(), "model").otherwise("reject")
    return F.struct(kind.alias("kind"), F.coalesce(digits, version, model).alias("id"))


# Names of metrics and the groups they belong to.
METRICS = {"face": "face", "lab": "face", "texture_energy": "face", "drift": "drift", "lab_drift": "drift", "deltae": "drift", "ssim_vs_baseline": "drift"}


def metric_groups(names: Column) -> Column:
    """struct(groups, unknown) of an array of metric names: groups distinct in order, both of them for null or no names; unknown is the first name that is none."""
    known = F.create_map(*[F.lit(x) for kv in METRICS.items() for x in kv])
    both = F.array(F.lit("face"), F.lit("drift"))
    groups = F.array_distinct(F.transform(names, lambda n: F.try_element_at(known, n)))
    unknown = F.get(F.filter(names, lambda n: F.try_element_at(known, n).isNull()), F.lit(0))
    return F.struct(F.when(unknown.isNull(), F.when(names.isNull() | (F.size(names) == 0), both).otherwise(groups)).alias("groups"), unknown.alias("unknown"))


def pass_counts(results: DataFrame, errors: int = 10) -> tuple[DataFrame, DataFrame]:
    """Counts (ok, skipped, failed, no_match, total) of an enrichment pass (key, status, error), and the first errors (key, error) by key."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = results.agg(n("ok"), n("skipped"), n("failed"), n("no_match"), F.count("*").alias("total"))
    return counts, results.where("status = 'failed'").select("key", F.substr("error", F.lit(1), F.lit(80)).alias("error")).orderBy("key").limit(errors)
