"""Normalise a prompt corpus to one lane, with a receipt of what changed.

A prompt is an array of segments, a segment an array of tokens, each beside its tag, which is
normalised once; every rule is an array expression, so a corpus takes one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, name_form, spaceless

# Fixed values of the lane.
SCAFFOLD = ("score_9", "score_8_up", "score_7_up", "score_6_up")
SOURCE, LORA, WEIGHT = "source_cartoon", "YOUR_STYLE_LORA", 0.8
PEOPLE = ("1girl", "2girls", "3girls", "4girls", "5girls", "6+girls", "1boy", "2boys", "3boys", "4boys", "5boys", "6+boys", "solo", "multiple_girls", "multiple_boys", "duo_focus")
SEVERAL = tuple(p for p in PEOPLE if p not in ("1girl", "1boy", "solo"))
NO_WEIGHT = ("masterpiece", "best quality", "high quality", "high resolution", "very aesthetic", "absurdres", "newest", "professional", "official art", "finely detailed", "extremely detailed", "worst quality", "normal quality", "lowres", "junk of quality")
TAIL = ("score_1_up", "score_2_up", "score_3_up", "score_4_up", "score_5_up")
NO_COUNT = r"^\d*\s*(woman|women|man|men|people|person|female|male)$"
INLINE = r"<(?:lora|lyco):([^:>]+):([^>]*)>"


def tag(token: Column) -> Column:
    """Brackets and weights off, lower case, blanks and hyphens to a space; underscores stay."""
    plain = F.split_part(F.regexp_replace(token, "[()]+", ""), F.lit(":"), F.lit(1))
    return F.trim(F.regexp_replace(F.lower(F.trim(plain)), r"(?U)[\s-]+", " "))


def _closed(g: Column) -> Column:
    """The spaceless form of a tag, which has no other separators than single spaces and underscores and is in lower case."""
    return F.replace(F.replace(g, F.lit(" "), F.lit("")), F.lit("_"), F.lit(""))


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _flat(c: str) -> Column:
    return F.flatten(F.col(c))


def _keep(c: str, test) -> Column:
    return F.transform(F.col(c), lambda seg: F.filter(seg, test))


def _into_first(c: Column, at: Column, new: Column) -> Column:
    first = F.element_at(c, 1)
    return F.concat(F.array(F.concat(F.slice(first, F.lit(1), at), new, F.slice(first, at + 1, F.size(first)))), F.slice(c, F.lit(2), F.size(c)))


def translate(prompts: DataFrame, style_lora: str = LORA, denied: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, prompt, loras and changes (op, target, apply) of prompts (doc_id, prompt, loras)."""
    empty = F.array().cast("array<string>")
    own = prompts.select("doc_id", F.coalesce("prompt", F.lit("")).alias("text"), F.coalesce("loras", F.array().cast("array<struct<name:string,weight:double>>")).alias("given"))
    segs = F.transform(F.split("text", r"\s*BREAK\s*"), lambda s: F.filter(F.transform(F.split(s, ","), lambda t: F.trim(t)), lambda t: t != ""))
    names, weights = (F.regexp_extract_all("text", F.lit(INLINE), F.lit(k)) for k in (1, 2))
    inline = F.transform(F.arrays_zip(names.alias("n"), weights.alias("w")), lambda x: F.struct(x["n"].alias("name"), F.coalesce(x["w"].try_cast("double"), F.lit(WEIGHT)).alias("weight")))
    own = own.withColumn("segs", segs).withColumn("all", F.filter(F.concat(inline, "given"), lambda x: F.coalesce(name_form(x["name"]), F.lit("")) != ""))

    # inline loras leave the prompt
    is_inline = lambda t: F.startswith(t, F.lit("<")) & t.rlike(f"^{INLINE}$")
    own = own.withColumn("loose", F.filter(_flat("segs"), is_inline)).withColumn("segs", _keep("segs", lambda t: ~is_inline(t)))
    # a token t with its tag g
    own = own.withColumn("segs", F.transform("segs", lambda seg: F.transform(seg, lambda t: F.struct(t.alias("t"), tag(t).alias("g")))))
    # quality tokens carry no weight on the lane
    is_quality = lambda x: _closed(x["g"]).isin(*[w.replace(" ", "") for w in NO_WEIGHT])
    own = own.withColumn("removed", F.transform(F.filter(_flat("segs"), is_quality), lambda x: x["t"])).withColumn("segs", _keep("segs", lambda x: ~is_quality(x)))
    # scaffold and source
    put = lambda t: F.struct(t.alias("t"), t.alias("g"))
    own = own.withColumn("tags", F.transform(_flat("segs"), lambda x: x["g"])).withColumn("scored", F.array_contains("tags", "score_9"))
    own = own.withColumn("scaffold", F.when(F.col("scored"), empty).otherwise(F.array_except(_words([*SCAFFOLD, SOURCE]), F.col("tags"))))
    is_anime = lambda x: x["g"] == "source_anime"
    has_source = lambda seg: F.exists(seg, lambda x: x["g"] == SOURCE)
    swapped = F.transform(F.col("segs"), lambda seg: F.when(has_source(seg), F.filter(seg, lambda x: ~is_anime(x))).otherwise(F.transform(seg, lambda x: F.when(is_anime(x), put(F.lit(SOURCE))).otherwise(x))))
    own = own.withColumn("n_swapped", F.when(F.col("scored"), F.aggregate(F.col("segs"), F.lit(0), lambda a, seg: a + F.when(has_source(seg), 0).otherwise(F.size(F.filter(seg, is_anime))))).otherwise(0))
    own = own.withColumn("n_dropped", F.when(F.col("scored"), F.aggregate(F.col("segs"), F.lit(0), lambda a, seg: a + F.when(has_source(seg), F.size(F.filter(seg, is_anime))).otherwise(0))).otherwise(0))
    own = own.withColumn("segs", F.when(F.col("scored"), swapped).otherwise(_into_first(F.col("segs"), F.lit(0), F.transform("scaffold", put))))
    is_head = lambda g: F.startswith(g, F.lit("score_")) | F.startswith(g, F.lit("source_"))
    # the first token beside the scaffold, or the end
    place = lambda first: let(F.array_position(F.transform(first, lambda x: ~is_head(x["g"])), True).cast("int"), lambda k: F.when(k > 0, k - 1).otherwise(F.size(first)))
    own = own.withColumn("no_source", ~F.exists("segs", has_source))
    own = own.withColumn("segs", F.when(F.col("no_source"), _into_first(F.col("segs"), let(F.element_at("segs", 1), place), F.array(put(F.lit(SOURCE))))).otherwise(F.col("segs")))
    # counts of people, after the last scaffold token of the whole prompt
    own = own.withColumn("tags", F.transform(_flat("segs"), lambda x: x["g"])).withColumn("found", F.filter("tags", lambda g: g.isin(*PEOPLE)))
    last = F.array_max(F.transform("tags", lambda g, i: F.when(is_head(g), i + 1).otherwise(0)))
    at = F.least(F.coalesce(last, F.lit(0)), F.size(F.element_at("segs", 1)))
    own = own.withColumn("segs", F.when(F.size("found") == 0, _into_first(F.col("segs"), at, F.transform(_words(["solo", "1girl"]), put))).otherwise(F.col("segs")))
    # loras: the style lora first at its weight, denied ones out
    deny = _words([d.replace(" ", "") for d in denied]) if denied else empty
    bare = lambda x: F.regexp_replace(name_form(x["name"]), r"\.safetensors$", "")
    is_style = lambda x: bare(x) == F.trim(F.regexp_replace(F.lower(F.lit(style_lora)), r"[\s_-]+", " "))
    is_denied = lambda x: F.array_contains(deny, spaceless(bare(x)))
    own = own.withColumn("kept", F.filter("all", lambda x: ~is_style(x) & ~is_denied(x)))
    style = F.array(F.struct(F.lit(style_lora).alias("name"), F.lit(WEIGHT).alias("weight")))
    own = own.withColumn("carriers", empty)
    if denied:
        carries = lambda x: F.array_contains(deny, _closed(x["g"]))
        own = own.withColumn("carriers", F.transform(F.filter(_flat("segs"), carries), lambda x: x["t"])).withColumn("segs", _keep("segs", lambda x: ~carries(x)))

    def change(op: str, target: Column, when: Column, apply: bool = True) -> Column:
        return F.when(when, F.struct(F.lit(op).alias("op"), target.alias("target"), F.lit(apply).alias("apply")))

    tail = F.array_sort(F.array_intersect("tags", _words(TAIL)))
    own = own.withColumn("wrong", F.transform(F.filter(_flat("segs"), lambda x: x["g"].rlike(NO_COUNT)), lambda x: x["t"]))
    some = lambda c: F.size(c) > 0
    changes = F.filter(
        F.array(
            change("strip", F.array_join("loose", ", "), some("loose")), change("strip", F.array_join("removed", ", "), some("removed")), change("add", F.array_join("scaffold", ", "), some("scaffold")),
            change("normalize", F.lit(f"source_anime -> {SOURCE}"), F.col("n_swapped") > 0), change("strip", F.lit("source_anime"), F.col("n_dropped") > 0), change("add", F.lit(SOURCE), F.col("no_source")),
            change("flag", F.array_join(tail, ", "), F.col("scored") & some(tail), False), change("add", F.lit("1girl, solo"), F.size("found") == 0),
            change("flag", F.lit("solo alongside multiple-character tags"), F.array_contains("found", "solo") & F.arrays_overlap("found", _words(SEVERAL)), False), change("flag", F.array_join("wrong", ", "), some("wrong"), False),
            change("add", F.lit(f"lora {style_lora} @ {WEIGHT}"), ~F.exists("all", is_style)), change("normalize", F.lit(f"lora {style_lora} weight"), F.exists("all", lambda x: is_style(x) & (F.abs(x["weight"] - WEIGHT) > 1e-9))),
            change("keep", F.concat(F.size("kept").cast("string"), F.lit(" lora(s)")), some("kept")), change("strip", F.array_join("carriers", ", "), some("carriers")),
        ),
        lambda x: x.isNotNull(),
    )
    prompt = F.array_join(F.transform("segs", lambda seg: F.array_join(F.transform(seg, lambda x: x["t"]), ", ")), "\nBREAK\n")
    return own.select("doc_id", prompt.alias("prompt"), F.concat(style, "kept").alias("loras"), changes.alias("changes"))
