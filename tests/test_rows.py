"""Jobs on prompts that look at one row a document: no tokens in shuffles, results as by the plain way."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom import catalog
from tagloom.functions import text as t
from tagloom.operators import lint


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def prompts(spark):
    rng = random.Random(5)
    words = ["sky", "Sky", "(sky:1.2)", "red hair", "blue-hair", "dress", "long dress", " ", "", "grin", "smiling", "deep water", "water fall", "clear water", "\n", "\nBREAK\n", "é", "x BREAK y"]
    rows = [(k, ",".join(rng.choice(words) for _ in range(rng.randrange(40)))) for k in range(60)] + [(60, None), (61, "BREAK"), (62, "a,,a\n\na\nBREAK\nBREAK\na BREAK "), (63, "a,a")]
    return spark.createDataFrame(rows, "doc_id long, prompt string").localCheckpoint()


def by_hand(spark, prompt, most):
    """Python's way: segments, lines, tokens; of each norm the first stays and the next go."""
    import re

    if prompt is None:
        return None
    base = lambda raw: re.sub(r"[\s-]+", " ", re.sub("[()]+", "", raw).split(":")[0].strip(" ").lower()).strip(" ")
    seen, gone, parts = {}, 0, []
    for part in re.split(r"\s*BREAK\s*", prompt):
        lines = []
        for line in part.split("\n"):
            kept = []
            for raw in (x.strip() for x in line.split(",")):
                if raw:
                    seen[base(raw)] = n = seen.get(base(raw), 0) + 1
                    gone += 1 < n <= most + 1
                    kept += [] if 1 < n <= most + 1 else [raw]
            lines += [", ".join(kept) + ","] if kept else []
        parts.append("\n".join(lines))
    return re.sub(r"\s+\Z", "", re.sub(r",+\Z", "", re.sub(r"\n?BREAK\s*\Z", "", "\nBREAK\n".join(parts)))) if gone else prompt


@pytest.mark.parametrize("most", [1, 2])
def test_repeats_go_without_a_shuffle(spark, prompts, most):
    df = lint.apply_repeats(prompts, most)
    assert not any(x in physical(df) for x in ("Exchange", "Sort ", "Window"))
    assert {r.doc_id: r.prompt for r in df.collect()} == {r.doc_id: by_hand(spark, r.prompt, most) for r in prompts.collect()}


def test_removals_equal_repeats(spark, prompts):
    tokens = prompts.select("doc_id", F.explode(lint.placed(F.col("prompt"))).alias("x")).select("doc_id", t.base_form(F.col("x.raw")).alias("norm"))
    cuts = tokens.groupBy("doc_id", "norm").agg(F.least(F.lit(2), F.count("*") - 1).alias("budget"))
    got = lint.apply_removals(prompts, cuts.union(spark.createDataFrame([(0, "not there", 5)], cuts.schema)))
    want = {r.doc_id: r.prompt for r in lint.apply_repeats(prompts, 2).collect()}
    assert {k: v for k, v in ((r.doc_id, r.prompt) for r in got.collect()) if k} == {k: v for k, v in want.items() if k}
    assert "Generate" not in plan(lint.apply_removals(prompts, cuts.localCheckpoint()))


def test_findings_of_sheets_without_a_shuffle(spark, prompts):
    own = prompts.select("doc_id", lint.sheet(F.col("prompt")).alias("sheet"))
    tokens = prompts.select("doc_id", F.posexplode(t.lint_tokens(F.col("prompt"))).alias("pos", "raw")).withColumn("norm", t.base_form(F.col("raw")))
    df = lint.findings(own, own)
    assert "Exchange" not in physical(df)
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(df) == rows(lint.findings(tokens, tokens)) and {r.kind for r in df.collect()} == set(lint.KINDS)
    assert rows(lint.report(own, own, ["sky"])) == rows(lint.report(tokens, tokens, ["sky"]))


def test_lint_queries_shuffle_no_tokens(spark, sf_dir):
    for name in ("lint_duplicates", "lint_overlap", "lint_repeats", "lint_colors", "lint_subsumed", "lint_findings", "lint_apply"):
        found = physical(catalog.queries()[name](spark, sf_dir))
        assert "HashAggregate" not in found and "Window" not in found


def test_lane_normalises_each_token_once(spark, prompts):
    from tagloom.operators import lane

    df = lane.translate(prompts.withColumn("loras", F.lit(None).cast("array<struct<name:string,weight:double>>")), denied=("red hair",))
    assert plan(df).count("[()]+") == 1
    assert {r.doc_id: r.prompt for r in df.collect()}[63] == "score_9, score_8_up, score_7_up, score_6_up, source_cartoon, solo, 1girl, a, a"


def test_pairs_by_products_equal_pairs_by_rows(spark):
    from tagloom.operators import stats

    rng = random.Random(2)
    rows = [(k, [rng.choice("abcdéfg") for _ in range(rng.randrange(7))] + [f"own{k}"]) for k in range(5_000)] + [(5_000, None), (5_001, []), (5_002, ["a", None, "b"])]
    df = spark.createDataFrame(rows, "id int, tags array<string>")
    both = [{(r.tag_a, r.tag_b): r.prompts for r in stats.cooccurrence(df, "id", 100, dense).collect()} for dense in (7, 0)]
    want = {}
    for _, tags in rows:
        for a in set(tags or ()) - {None}:
            for b in set(tags) - {None}:
                if a < b and len(a + b) == 2:
                    want[a, b] = want.get((a, b), 0) + 1
    assert both[0] == both[1] == {k: n for k, n in want.items() if n >= 100}
    assert "PythonMapInArrow" in plan(stats.cooccurrence(df, "id", 100)) or "MapInArrow" in plan(stats.cooccurrence(df, "id", 100))
    assert stats.cooccurrence(df, "id", 10_000).count() == 0


def test_simhash_counts_votes_of_tags(spark):
    import hashlib

    from tagloom.operators import similar

    rows = [(k, [f"tag{j}" for j in range(k, 3 * k)]) for k in range(1, 40)] + [(40, []), (41, None), (42, ["é"])]
    got = {r.key: r.h & (1 << 64) - 1 for r in similar.simhash(spark.createDataFrame(rows, "key long, tags array<string>").repartition(3)).collect()}
    want = {}
    for k, tags in rows:
        digests = [int(hashlib.md5(x.encode()).hexdigest()[:16], 16) for x in tags or []]
        if digests:
            want[k] = sum(1 << b for b in range(64) if 2 * sum(d >> b & 1 for d in digests) > len(digests))
    assert got == want


def test_hash_classes_read_texts_once(spark, sf_dir):
    for name in ("hash_classes", "dup_groups", "near_dup_pairs"):
        assert "documents" not in "".join(catalog.queries()[name](spark, sf_dir).inputFiles())


def test_tags_are_counted_raw_before_they_are_normalised(spark, sf_dir):
    df = catalog.queries()["tag_stats"](spark, sf_dir)
    assert "documents" not in "".join(df.inputFiles()) and "raw-tokens" in "".join(df.inputFiles())
