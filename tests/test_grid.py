import pytest
from pyspark.sql import functions as F

from tagloom.operators import grid, suggest


def test_overlay_sets_typed_paths(spark):
    df = spark.createDataFrame([((24, 6.0), [("face", 0.3), ("hand", 0.4)])], "base struct<steps:int,cfg:double>, tabs array<struct<model:string,confidence:double>>")
    one = grid.overlay(grid.overlay(df, "base.steps", F.lit(30)), "tabs[1].confidence", F.lit(0.9)).first()
    assert one.base.steps == 30 and [t.confidence for t in one.tabs] == [0.3, 0.9]
    assert grid.normal_path("a[0].b") == grid.normal_path("a.0.b") == "a.0.b"
    for path in ("base.nothing", "tabs[0]", "base", "tabs.confidence"):
        with pytest.raises(ValueError):
            grid.overlay(df, path, F.lit(1))


def test_back_off(spark):
    df = spark.createDataFrame([("green_ball_gown",), ("plain",)], "q string")
    assert [(r.depth, r.part) for r in suggest.back_off(df).orderBy("depth").collect()] == [(0, "green_ball"), (1, "green")]


def test_batches(spark):
    rows = spark.createDataFrame([(1, "a cat ", 7, ["x", "", " y "]), (2, "<lora:q:1>", -1, ["z"]), (3, "p", None, [])], "doc_id int, prompt string, seed long, lines array<string>")
    got = {m: sorted(map(tuple, grid.batch(rows, F.col("lines"), m).collect())) for m in ("fixed", "random", "increment")}
    assert got["increment"] == [(1, 0, 7, "a cat, x"), (1, 1, 8, "a cat "), (1, 2, 9, "a cat, y"), (2, 0, -1, "<lora:q:1>\nz")]
    assert [r[2] for r in got["fixed"]] == [7, 7, 7, -1] and {r[2] for r in got["random"]} == {-1}
    assert grid.batch(rows.limit(1), F.array_repeat(F.lit("l"), 90), "fixed").count() == 64


def test_plans_with_every_part_missing(spark):
    schema = """doc_id int, override struct<prompt:string,seed:long,steps:int,cfg_scale:double>, base struct<prompt:string,negative_prompt:string,checkpoint:string,sampler:string,scheduler:string,width:int,height:int,steps:int,cfg_scale:double,distilled_cfg_scale:double,seed:long>,
    loras array<struct<name:string,weight:double>>, hires struct<enabled:boolean,upscaler:string,scale:double,steps:int,denoise:double,cfg:double>, detailer struct<strip_lora_from_prompt:boolean,tabs:array<struct<enabled:boolean,model:string,prompt_override:string,negative_override:string,confidence:double,denoise:double,padding:int>>>,
    units array<struct<enabled:boolean,model:string,image_file:string>>, style string"""
    tab = (True, "face.pt", "", None, None, None, 8)
    rows = spark.createDataFrame([(1, None, None, None, None, None, None, None), (2, ("over <lora:x:1>", 5, None, 9.0), ("p", "n", "c", None, None, None, None, 12, 4.0, None, 3), [], (True, "u", None, None, None, None), (False, [tab, (False, "off", None, None, None, None, None)]), [], "s")], schema)
    styles, images = spark.createDataFrame([(0, "s", "[{prompt}]", "bad")], "nth int, name string, prompt string, negative_prompt string"), spark.createDataFrame([], "file string")
    got = {r.doc_id: r for r in grid.render_plans(rows, styles, images).collect()}
    assert (got[1].prompt, got[1].seed, got[1].steps, got[1].cfg_scale, got[1].sampler, got[1].width, got[1].hires, got[1].tabs, got[1].units) == ("", -1, 24, 6.0, "Euler a", 768, None, [], [])
    assert (got[2].prompt, got[2].negative_prompt, got[2].seed, got[2].steps, got[2].cfg_scale, got[2].checkpoint) == ("[over\n<lora:x:1>]", "bad, n", 5, 12, 9.0, "c")
    assert tuple(got[2].hires) == (2.0, "u", 10, 0.45, 4.5) and [tuple(t) for t in got[2].tabs] == [("face.pt", 0.3, 0.4, 8, None, None)]


def test_references_and_metrics(spark):
    from tagloom.operators import profiles

    refs = {" 12 ": ("model", "12"), "https://h/models/7?modelVersionId=9": ("version", "9"), "h/models/7/x": ("model", "7"), "h/posts/7": ("reject", None), "": ("reject", None), None: ("reject", None)}
    df = spark.createDataFrame([(k,) for k in refs], "ref string").select("ref", profiles.model_ref(F.col("ref")).alias("x"))
    assert {r.ref: tuple(r.x) for r in df.collect()} == refs
    names = [(None,), ([],), (["lab", "deltae", "face"],), (["drift", "odd", "worse"],)]
    got = [tuple(r.x) for r in spark.createDataFrame(names, "n array<string>").select(profiles.metric_groups(F.col("n")).alias("x")).collect()]
    assert got == [(["face", "drift"], None), (["face", "drift"], None), (["face", "drift"], None), (None, "odd")]
    counts, errors = profiles.pass_counts(spark.createDataFrame([(k, "failed" if k % 2 else "ok", "e" * 90) for k in range(30)], "key int, status string, error string"))
    assert tuple(counts.first()) == (15, 0, 15, 0, 30) and [(r.key, len(r.error)) for r in errors.collect()] == [(k, 80) for k in range(1, 21, 2)]
