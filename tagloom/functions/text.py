"""Column expressions for prompt text: normalisers, tokenisers, inline tokens, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """A value bound once: named inside a lambda, an expression is worked out again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs(rows: Column, key) -> Column:
    """A sorted array cut into arrays of neighbours with an equal key, each element looked at twice."""
    begins = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (key(F.get(s, i - 1)) != key(x)), i)), lambda i: i.isNotNull())
    cut = lambda s: let(begins(s), lambda at: F.transform(at, lambda a, k: F.slice(s, a + 1, F.coalesce(F.get(at, k + 1), F.size(s)) - a)))
    return let(rows, cut)


QUALITY_GRAMMAR = "^(score_[0-9](_up)?|source_[0-9a-z_]+)$"
# Fixed value: the inline form of a lora with its weight.
LORA = "<lora:([^:>]+):([^>]*)>"


def base_form(raw: Column) -> Column:
    """Brackets and weight off, lower case, blanks and hyphens to one space."""
    plain = F.split_part(F.regexp_replace(raw, "[()]+", ""), F.lit(":"), F.lit(1))
    return F.trim(F.regexp_replace(F.lower(F.trim(plain)), r"(?U)[\s-]+", " "))


def stats_tag(raw: Column) -> Column:
    return F.replace(base_form(raw), F.lit(" "), F.lit("_"))


def name_form(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(raw)), r"(?U)[\s_-]+", " "))


def spaceless(raw: Column) -> Column:
    return F.regexp_replace(F.lower(raw), r"(?U)[\s_-]+", "")


def query_form(raw: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(raw)), r"(?U)\s+", "_"), F.lit("_"))


def stats_tokens(prompt: Column) -> Column:
    """BREAK segments, then commas; blank tokens out."""
    return F.filter(F.transform(F.split(F.regexp_replace(prompt, r"\s*BREAK\s*", ","), ","), lambda t: F.trim(t)), lambda t: t != "")


def lint_tokens(prompt: Column) -> Column:
    """BREAK segments, lines, commas; blank tokens out."""
    return F.filter(F.transform(F.split(F.regexp_replace(prompt, r"\s*BREAK\s*|\n", ","), ","), lambda t: F.trim(t)), lambda t: t != "")


def tidy(prompt: Column) -> Column:
    """A prompt without the comma that is left at its end or at the end of a part before a BREAK, and without white space at its ends.

    Parts begin at each BREAK of a new line; a part loses one comma, with the white space around it.
    """
    parts = F.split(prompt, r"\n\s*(?=BREAK)")
    bare = lambda x: F.regexp_replace(x, r"\s+\z", "")
    ended = lambda x: F.when(F.endswith(bare(x), F.lit(",")), F.substr(bare(x), F.lit(1), F.length(bare(x)) - 1)).otherwise(x)
    return F.regexp_replace(F.array_join(F.transform(parts, ended), "\n"), r"^\s+|\s+\z", "")


def _without_tokens(prompt: Column) -> Column:
    """Inline lora tokens out, with the commas they leave behind."""
    return tidy(F.regexp_replace(prompt, r"\s*<(lora|lyco):[^>]*>\s*", " "))


def strip_loras(prompt: Column) -> Column:
    """A prompt without its inline loras."""
    return F.regexp_replace(F.regexp_replace(_without_tokens(prompt), r",+\z", ""), r"\s+\z", "")


def merge_loras(prompt: Column, loras: Column) -> Column:
    """A prompt whose loras are all at its end, one a line: its own in order, then new ones of `loras` (array of name, weight), whose weights win."""
    none = F.expr("cast(array() as array<struct<name:string,weight:string>>)")
    own = F.arrays_zip(F.regexp_extract_all(prompt, F.lit(LORA), F.lit(1)).alias("name"), F.regexp_extract_all(prompt, F.lit(LORA), F.lit(2)).alias("weight"))
    given = F.transform(loras, lambda x: F.struct(F.trim(x["name"]).alias("name"), F.coalesce(x["weight"].cast("string"), F.lit("0.8")).alias("weight")))
    given = F.filter(given, lambda x: x["name"].isNotNull() & (x["name"] != ""))
    # names keep the order of their first place, of several weights the last one counts
    put = lambda done, x: F.when(F.exists(done, lambda d: d["name"] == x["name"]), F.transform(done, lambda d: F.when(d["name"] == x["name"], x).otherwise(d))).otherwise(F.concat(done, F.array(x)))
    every = F.aggregate(F.concat(own.cast("array<struct<name:string,weight:string>>"), F.coalesce(given, none)), none, put)
    tail = F.array_join(F.transform(every, lambda x: F.concat(F.lit("<lora:"), x["name"], F.lit(":"), x["weight"], F.lit(">"))), ",\n")
    bare = _without_tokens(prompt)
    return F.when(tail == "", bare).when(bare == "", tail).otherwise(F.concat(bare, F.lit("\n"), tail))


def caption(prompt: Column) -> Column:
    """A training caption: loras out, BREAK and newlines as commas, at most 2000 characters."""
    bare = F.regexp_replace(F.regexp_replace(prompt, LORA, ""), r"\s*BREAK\s*|\n", ", ")
    return F.substr(F.btrim(F.regexp_replace(bare, r"(\s*,\s*)+", ", "), F.lit(" ,")), F.lit(1), F.lit(2000))


def slug(raw: Column, most: int = 60, fallback: str = "note") -> Column:
    cut = F.btrim(F.regexp_replace(F.lower(raw), "[^a-z0-9_-]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.substr(cut, F.lit(1), F.lit(most)), F.lit("")), F.lit(fallback))


def lane(prompt: Column) -> Column:
    low = F.lower(prompt)
    return F.when(low.rlike("score_9|source_cartoon|source_anime"), "pony").when(low.rlike("masterpiece|best quality|masterwork|best_quality"), "illustrious")


def settings_map(text: Column) -> Column:
    """`key: value, key: "quoted, value"` to a map; the last duplicate wins.

    The text is cut at its commas; a part that leaves a quote open takes the following parts
    with it, and a part without a colon belongs to no key.
    """
    quotes = lambda s: F.length(F.regexp_replace(s, r'\\.|[^"\\]', ""))
    closed = lambda done: quotes(F.element_at(done, -1)) % 2 == 0
    glue = lambda done, part: F.when((F.size(done) > 0) & ~closed(done), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat_ws(",", F.element_at(done, -1), part)))).otherwise(F.concat(done, F.array(part)))
    parts = F.aggregate(F.split(text, ","), F.array().cast("array<string>"), glue)
    entry = lambda p: F.struct(F.trim(F.regexp_extract(p, r"^\s*([A-Za-z0-9 _-]+):", 1)).alias("k"), F.trim(F.regexp_replace(p, "^[^:]*:", "")).alias("v"))
    plain = lambda v: F.when(v.startswith('"') & v.endswith('"') & (F.length(v) > 1), F.replace(F.replace(F.substr(v, F.lit(2), F.length(v) - 2), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))).otherwise(v)
    entries = F.transform(F.filter(F.transform(parts, entry), lambda e: e["k"] != ""), lambda e: F.struct(e["k"].alias("k"), plain(e["v"]).alias("v")))
    last = F.filter(entries, lambda e, i: F.array_position(F.reverse(F.transform(entries, lambda x: x["k"])), e["k"]) == F.size(entries) - i)
    return F.map_from_entries(last)
