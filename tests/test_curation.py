"""Curation with guards, cells as VARIANT, cascades and exports, on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from tagloom.operators import cells, curation


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_guarded_save(spark):
    schema = "character string, name string, body string, variant_of string, locked boolean"
    current = spark.createDataFrame([("m", "a", "old", None, True), ("m", "a_t", "x", None, False), ("m", "a_t_3", "x", None, None), ("m", "b", "old", None, None), ("m", "a_t_old", "x", None, False)], schema)
    incoming = spark.createDataFrame([("m", "a", "1", None), ("m", "a", "2", "first"), ("m", "a", "3", None), ("m", "b", "new", None), ("m", "b", "newer", None), ("m", "c", "own", "z")], "character string, name string, body string, variant_of string")
    after, done = curation.guarded_save(current, incoming, "t")
    assert rows(done) == sorted([("m", "a", "a_t_2", "variant"), ("m", "a", "a_t_4", "variant"), ("m", "a", "a_t_5", "variant"), ("m", "b", "b", "overwritten"), ("m", "c", "c", "created")], key=repr)
    got = {r.name: (r.body, r.variant_of, r.locked) for r in after.collect()}
    assert got["a"] == ("old", None, True) and got["b"] == ("newer", None, False) and got["c"] == ("own", "z", False)
    assert got["a_t_2"] == ("1", "a", False) and got["a_t_4"] == ("2", "first", False) and got["a_t_5"] == ("3", "a", False) and after.count() == 9
    assert rows(curation.guarded_save(current, incoming.limit(0), "t")[1]) == []


def test_renames(spark):
    profiles = spark.createDataFrame([("m", "a", False), ("m", "b", True), ("m", "c", None), ("n", "a", False)], "character string, name string, locked boolean")
    moves = spark.createDataFrame([("m", "a", "new"), ("m", "b", "x"), ("m", "c", "a"), ("n", "a", "a"), ("n", "lost", "y"), ("m", "c", "Bad!"), ("m", "c", "new")], "character string, name string, new_name string")
    judged = curation.rename_profiles(profiles, moves)
    assert rows(judged) == sorted([("m", "a", "new", "name taken"), ("m", "b", "x", "locked"), ("m", "c", "a", "name taken"), ("n", "a", "a", "same name"), ("n", "lost", "y", "no such profile"), ("m", "c", "Bad!", "bad name"), ("m", "c", "new", "name taken")], key=repr)
    judged = curation.rename_profiles(profiles, moves.limit(1))
    index = spark.createDataFrame([("m", "a", 1), ("m", "ab", 2), ("n", "a", 3)], "character string, name string, rating int")
    assert rows(curation.rekeyed(index, judged).select("character", "name", "rating", "renamed")) == [("m", "ab", 2, False), ("m", "new", 1, True), ("n", "a", 3, False)]


def test_folders(spark):
    registry = spark.createDataFrame([(f"f{k}",) for k in range(48)], "folder string")
    asked = [(1, "create", "new", None), (2, "create", "f1", None), (3, "create", "a/b", None), (4, "create", "new", None), (5, "create", " second ", None), (6, "create", "third", None), (7, "rename", "f1", "one"), (8, "rename", "f2", "f3"), (9, "rename", "lost", "x"), (10, "delete", "f4", None), (11, "delete", "lost", None), (12, "rename", "f5", ""), (13, "create", "x" * 31, None)]
    judged = curation.folder_changes(registry, spark.createDataFrame(asked, "nth int, action string, folder string, new_name string"))
    why = {r.nth: r.reason for r in judged.collect()}
    assert why == {1: None, 2: "already there", 3: "bad name", 4: "already there", 5: None, 6: "too many folders", 7: None, 8: "already there", 9: "not found", 10: None, 11: "not found", 12: "bad name", 13: "bad name"}
    index = spark.createDataFrame([(1, ["f1", "f4", "f9"]), (2, ["f9"]), (3, [])], "id int, folders array<string>")
    assert rows(curation.apply_folders(index, judged).select("id", "folders", "touched")) == [(1, ["one", "f9"], True), (2, ["f9"], False), (3, [], False)]


def test_cascade(spark):
    renders = spark.createDataFrame([("m", "a", "1.png", "1", 7), ("m", "a", "2.png", "2", 8), ("m", "b", "1.png", "1", 9)], "character string, name string, file string, stem string, size int")
    key = F.concat_ws("/", "character", "name", "file")
    tables = {"renders": renders.drop("stem"), "tickets": renders.drop("file"), "sidecars": renders.drop("file").limit(0), "index": renders.select(key.alias("key"), F.lit(3).alias("rating")), "thumbs": renders.select(F.concat(F.md5(key.cast("binary")), F.lit(".jpg")).alias("thumb"))}
    gone = spark.createDataFrame([("m", "a", "1.png"), ("m", "a", "1.png"), ("x", "y", "z.png")], "character string, name string, file string")
    left = curation.delete_cascade(gone, tables)
    assert {k: v.count() for k, v in left.items()} == {"renders": 2, "tickets": 2, "sidecars": 0, "index": 2, "thumbs": 2}
    assert rows(left["index"]) == [("m/a/2.png", 3), ("m/b/1.png", 3)] and left["renders"].columns == tables["renders"].columns


def test_export_is_idempotent_and_names_by_length(spark, tmp_path):
    schema = "key string, character string, file string, length long, machine_tags array<string>, prompt string"
    renders = spark.createDataFrame([("m/a/1.png", "m", "1.png", 10, ["x", "y"], "p"), ("n/a/1.png", "n", "1.png", 20, [], "a <lora:q:1>,\nBREAK b,"), ("n/b/1.png", "n", "1.png", 10, None, ""), ("m/a/2.png", "m", "2.png", 5, None, None)], schema)
    root = str(tmp_path)
    receipt, items = curation.export_dataset(renders, root, "set", "wd14")
    assert rows(receipt) == [("set", "wd14", 4, 1)]
    assert rows(items) == [("m/a/1.png", "1.png", False), ("m/a/2.png", "2.png", False), ("n/a/1.png", "n_1.png", True), ("n/b/1.png", "1.png", False)]
    held = lambda n: {r.dest: (r.key, r.caption) for r in spark.read.parquet(f"{root}/set/held/{n}").collect()}
    assert held(0) == {"1.png": ("n/b/1.png", ""), "n_1.png": ("n/a/1.png", "a, b"), "2.png": ("m/a/2.png", "")}
    seen = sorted(str(p) for p in tmp_path.rglob("*"))
    again, _ = curation.export_dataset(renders, root, "set", "wd14")
    assert rows(again) == rows(receipt) and sorted(str(p) for p in tmp_path.rglob("*")) == seen
    more = spark.createDataFrame([("z/a/2.png", "z", "2.png", 6, ["t"], "p")], schema)
    receipt, items = curation.export_dataset(more, root, "set", "wd14")
    assert rows(receipt) == [("set", "wd14", 1, 0)] and rows(items) == [("z/a/2.png", "z_2.png", False)]
    assert set(held(1)) == {"1.png", "n_1.png", "2.png", "z_2.png"} and held(1)["z_2.png"] == ("z/a/2.png", "t")
    for bad in ("Bad", "", "a b"):
        with pytest.raises(ValueError):
            curation.export_dataset(more, root, bad)
    with pytest.raises(ValueError):
        curation.captioned(more, "all")


PROFILE = {"base": {"steps": 24, "sampler": None}, "tabs": [{"denoise": 0.4}, {"denoise": 0.5}]}


def test_paths_and_axes(spark):
    paths = {"tabs[0].denoise": "0.4", "tabs.1.denoise": "0.5", "base.steps": "24", "base.sampler": None, "tabs[2].denoise": None, "base.x": None, "": None, "base.'x": None, "base": json.dumps(PROFILE["base"], separators=(",", ":"), sort_keys=True)}
    df = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "id int, path string").withColumn("profile", F.parse_json(F.lit(json.dumps(PROFILE))))
    got = {r.path: r.v for r in df.select("path", F.to_json(cells.resolved(F.col("profile"), F.col("path"))).alias("v")).collect()}
    assert {k: v and json.loads(v) for k, v in got.items()} == {k: v and json.loads(v) for k, v in paths.items()}
    lost = cells.unresolved_axes(df.select("id", "profile"), df.select("id", "path"))
    assert {r.path for r in lost.collect()} == {p for p, v in paths.items() if v is None}


def test_cells_apply_with_every_guard(spark):
    profiles = spark.createDataFrame([("p", False, json.dumps(PROFILE)), ("l", True, json.dumps(PROFILE))], "id string, locked boolean, profile string")
    runs = spark.createDataFrame([(1, "p", "done"), (2, "p", "open"), (3, "l", "done"), (4, "p", "done"), (5, "lost", "done"), (6, "p", "done")], "run int, id string, status string")
    v = lambda df: df.withColumn("cell", F.parse_json("cell"))
    cell = '{"base.steps":30,"tabs[1].denoise":0.9}'
    results = v(spark.createDataFrame([(k, cell) for k in (1, 2, 3, 5)] + [(6, '{"base.lost":1}'), (1, '"baseline"')], "run int, cell string"))
    choices = v(spark.createDataFrame([(1, '{ "tabs[1].denoise": 0.90, "base.steps": 30 }'), (2, cell), (3, cell), (4, cell), (5, cell), (6, '{"base.lost":1}')], "run int, cell string"))
    after, refused = cells.apply_cells(profiles, runs, results, choices)
    got = {r.id: json.loads(r.profile) for r in after.collect()}
    assert got == {"p": {"base": {"steps": 30, "sampler": None}, "tabs": [{"denoise": 0.4}, {"denoise": 0.9}]}, "l": PROFILE}
    assert {r.run: r.reason for r in refused.collect()} == {2: "run not finished", 3: "profile is locked", 4: "cell is no result of the run", 5: "no such profile", 6: "a path leads nowhere"}
    assert cells.chosen(v(spark.createDataFrame([(1, '"baseline"'), (2, '"baseline"')], "run int, cell string")), results).count() == 1
