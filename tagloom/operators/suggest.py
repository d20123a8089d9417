"""Tag suggestions for a batch of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import small, written

#: Characters by which tags are looked up.
KEY = 5


def _parts(text: Column, sizes) -> Column:
    """Substrings of the given lengths; of a shorter text the whole."""
    return F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1)), lambda k: F.substr(text, k, F.lit(n))) for n in sizes]))  # noqa: B023


def _every(sizes) -> Column:
    """Distinct substrings of a tag and of its aliases."""
    return F.array_distinct(F.concat(_parts(F.col("tag"), sizes), F.flatten(F.transform("aliases", lambda a: _parts(a, sizes)))))


def collapsed(dump: DataFrame) -> DataFrame:
    """(tag, cnt, aliases) of tags (tag, cnt, alias): one row a tag, with its largest count and all aliases."""
    return dump.where("tag is not null").groupBy("tag").agg(F.max("cnt").alias("cnt"), F.collect_set("alias").alias("aliases"))


def _first(found: DataFrame, n: int) -> DataFrame:
    """The best n of each query; tasks keep their own best n before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy("tier", F.desc("cnt"), "tag"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n)


def suggest(dump: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """(q, rank, tag, tier): the n best tags (tag, cnt, alias) for each query.

    Tiers: 1 the tag itself, 2 its alias, 3 prefix, 4 inside the tag, 5 inside the alias. Tags
    that begin with a query, or are its alias, come first; only queries that find less than n
    of them are looked up inside tags and aliases, as a later tier can't push out an earlier
    one. Both are equi joins on at most KEY characters, after which the whole query is compared.
    A tag that is there twice counts once, with its largest count and all of its aliases.
    """
    return _suggest(written(collapsed(dump), "tags"), written(asked.where("q <> ''").select("q").distinct(), "asked"), n)


def _suggest(dump: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    q = F.col("q")
    early = F.when(F.col("tag") == q, 1).when(F.array_contains("aliases", q), 2).when(F.startswith("tag", q), 3)
    late = F.when(F.contains("tag", q), 4).when(F.exists("aliases", lambda a: F.contains(a, q)), 5)
    begins = F.array_distinct(F.concat(F.array(*[F.substr("tag", F.lit(1), F.lit(k)) for k in range(1, KEY + 1)]), F.transform("aliases", lambda a: F.substr(a, F.lit(1), F.lit(KEY)))))
    keyed = asked.select("q", F.substr("q", F.lit(1), F.lit(KEY)).alias("key"))
    found = dump.select("*", F.explode(begins).alias("key")).join(keyed.hint("merge"), "key").withColumn("tier", early).where("tier is not null")
    first = written(_first(found.select("q", "tag", "cnt", "tier"), n), "suggested")
    had = first.groupBy("q").agg(F.count("*").alias("had"))
    rest = written(asked.join(had.hint("merge"), "q", "left").where(f"coalesce(had, 0) < {n}").select("q"), "rest")
    # queries shorter than a key are substrings themselves; few are left of them, as most begin n tags, and at most KEY - 1 lengths
    sizes = sorted(r[0] for r in rest.where(F.length("q") < KEY).select(F.length("q")).distinct().collect())
    brief = dump.select("*", F.explode(_every(sizes)).alias("q")).join(small(rest.where(F.length("q") < KEY), 200_000), "q") if sizes else dump.select("*", F.lit("").alias("q")).limit(0)
    # queries of several words go by the characters around their first underscore, which fewer tags have
    at = F.greatest(F.lit(1), F.least(F.instr("q", "_") - 2, F.length("q") - KEY + 1))
    keyed = rest.where(F.length("q") >= KEY).select("q", F.substr("q", at, F.lit(KEY)).alias("key"))
    whole = dump.select("*", F.explode(_every([KEY])).alias("key")).join(keyed.hint("merge"), "key")
    inside = brief.select("q", "tag", "cnt", "aliases").unionByName(whole.select("q", "tag", "cnt", "aliases"))
    inside = _first(inside.where(early.isNull()).withColumn("tier", late).where("tier is not null").select("q", "tag", "cnt", "tier"), n)
    return _first(first.drop("rank").unionByName(inside.drop("rank")), n).select("q", "rank", "tag", "tier")


def back_off(queries: DataFrame) -> DataFrame:
    """Queries' columns with (part, depth): a query's shorter forms, cut at underscores, the longest first."""
    parts = F.split("q", "_")
    forms = F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "_"))
    return queries.where("instr(q, '_') > 0").select("*", F.posexplode(forms).alias("depth", "part"))


def suggest_all(dump: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """`suggest`, filled up to n for queries of several words: tier 6, tags that go on from the longest shorter form with anything new."""
    tags, asked = written(collapsed(dump), "tags"), written(asked.where("q <> ''").select("q").distinct(), "asked")
    first = written(_suggest(tags, asked, n), "first")
    had = first.groupBy("q").agg(F.count("*").alias("had"), F.collect_set("tag").alias("seen"))  # at most n tags each
    short = asked.where("instr(q, '_') > 0").join(had.hint("merge"), "q", "left").where(f"coalesce(had, 0) < {n}")
    forms = back_off(short)
    starts = tags.where("instr(tag, '_') > 0").select("tag", "cnt", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("tag", "_")) - 1), lambda k: F.array_join(F.slice(F.split("tag", "_"), F.lit(1), k), "_"))).alias("part"))
    # a query has seen less than n tags, so the n it may still take are among a form's first 2 n
    nth = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("cnt"), "tag"))
    starts = written(starts.withColumn("nth", nth).where(F.col("nth") <= 2 * n).drop("nth"), "starts")
    new = forms.join(small(starts, 100_000), "part").where("not array_contains(coalesce(seen, array()), tag)")
    best = new.withColumn("longest", F.min("depth").over(Window.partitionBy("q"))).where("depth = longest")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cnt"), "tag")) + F.coalesce("had", F.lit(0))
    more = best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= n)
    return first.unionByName(more.select("q", "rank", "tag", F.lit(6).alias("tier")))
