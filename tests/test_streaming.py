import datetime

import pytest
from pyspark.sql import functions as F

from tagloom import catalog
from tagloom.operators import snapshots
from tagloom.streaming import jobs, states


def test_ingest_reads_everything_once(spark, sf_dir):
    got = catalog.queries()["stream_ingest"](spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert got.count() == events.count() and got.exceptAll(events).isEmpty()


def test_upsert_keeps_other_fields(spark, sf_dir):
    got = catalog.queries()["stream_upsert"](spark, sf_dir)
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    want = docs.select("doc_id", F.length("text").cast("long").alias("n_chars")).join(labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", "quality", "n_chars")
    assert sorted(map(tuple, got.select("doc_id", "quality", "n_chars").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_upsert_goes_on_after_a_restart(spark, tmp_path):
    rows = lambda rs: spark.createDataFrame(rs, "doc_id long, score long, at long")
    index = spark.createDataFrame([(1, 5, "a"), (2, None, "b")], "doc_id long, score long, name string")
    stream = lambda: spark.readStream.schema(rows([]).schema).parquet(f"{tmp_path}/in")
    run = lambda: {tuple(r) for r in jobs.upsert(spark, stream(), index, ["score"], f"{tmp_path}/cp", "at", 4).select("doc_id", "score", "name").collect()}
    rows([(2, 7, 1), (2, 6, 2), (11, 1, 1), (1, None, 9)]).write.parquet(f"{tmp_path}/in")
    assert run() == {(1, 5, "a"), (2, 6, "b"), (11, 1, None)}
    rows([(12, 3, 1)]).write.mode("append").parquet(f"{tmp_path}/in")
    want = {(1, 5, "a"), (2, 6, "b"), (11, 1, None), (12, 3, None)}
    for _ in range(2):  # the second time without anything new
        assert run() == want


def files(root):
    return {str(p.relative_to(root)): (p.stat().st_mtime_ns, p.stat().st_size) for p in root.rglob("*.parquet")}


def test_snapshots_rewrite_only_touched_buckets(spark, tmp_path):
    root, schema = f"{tmp_path}/t", "doc_id long, x long, y string"
    snapshots.create(spark.createDataFrame([(k, k, "a") for k in range(200)], schema), root, "doc_id", 8)
    before = files(tmp_path / "t" / "data")
    delta = spark.createDataFrame([(3, 30, None), (999, 1, "new")], schema)
    touched = {r[0] for r in delta.select(snapshots.bucket("doc_id", 8)).collect()}
    snapshots.upsert(delta, root, schema, "doc_id", ["x", "y"], 1, 8)
    after = files(tmp_path / "t" / "data")
    assert {k: v for k, v in after.items() if k in before} == before
    assert {k.split("/")[1] for k in after if k.startswith("version=1")} == {f"bucket={b}" for b in touched}
    assert snapshots.manifest(spark, root) == {b: int(b in touched) for b in range(8)}
    got = {r.doc_id: (r.x, r.y) for r in snapshots.read(spark, root, schema).collect()}
    assert got == {k: (k, "a") for k in range(200)} | {3: (30, "a"), 999: (1, "new")}
    snapshots.upsert(delta.limit(0), root, schema, "doc_id", ["x", "y"], 2, 8)
    assert snapshots.newest(spark, f"{root}/manifests") == 1


def test_a_crash_before_the_pointer_leaves_the_old_table(spark, tmp_path, monkeypatch):
    root, schema = f"{tmp_path}/t", "doc_id long, x long"
    snapshots.create(spark.createDataFrame([(k, 0) for k in range(50)], schema), root, "doc_id", 4)
    delta = spark.createDataFrame([(k, 1) for k in range(10)], schema)
    with monkeypatch.context() as m:
        m.setattr(snapshots, "_pointed", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            snapshots.upsert(delta, root, schema, "doc_id", ["x"], 1, 4)
    read = lambda: sorted(tuple(r) for r in snapshots.read(spark, root, schema).collect())
    assert read() == [(k, 0) for k in range(50)]
    for _ in range(2):  # the same batch again, and once more after it was complete
        snapshots.upsert(delta, root, schema, "doc_id", ["x"], 1, 4)
        assert read() == [(k, int(k < 10)) for k in range(50)]


def test_ingest_takes_a_key_once_and_counts(spark, tmp_path):
    rows = lambda rs: spark.createDataFrame(rs, "id long, x long")

    def run():
        out, counts = jobs.ingest(spark, f"{tmp_path}/in", rows([]).schema, ["id"], f"{tmp_path}/out", f"{tmp_path}/cp")
        assert (counts["last"] is None) == (counts["batches"] == 0)
        return sorted(r.id for r in out.collect()), counts["processed"], counts["rejected"]

    rows([(1, 1), (1, 2), (2, 1), (None, 4)]).write.parquet(f"{tmp_path}/in")
    assert run() == ([1, 2], 3, 1)
    rows([(2, 5), (3, 1)]).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == ([1, 2, 3], 2, 0)
    assert run() == ([1, 2, 3], 0, 0)


def test_quiet_stream_equals_the_batch_form_over_restarts(spark, tmp_path):
    at = lambda k: datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=k)
    parts = [[("a", at(0)), ("a", at(5)), ("b", at(3)), ("c", None)], [("a", at(14)), ("a", at(40)), ("b", at(13))], [("d", at(1)), ("b", at(2)), ("a", at(41))]]
    schema = "key string, ts timestamp"

    def go(events, quiet, wait):
        spark.createDataFrame(events, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = states.quiet_sessions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "key", "ts", 10_000, quiet)
        states.to_table(out, f"{tmp_path}/out", f"{tmp_path}/cp", wait)
        return {(r.key, r["first"].timestamp(), r["last"].timestamp(), r.writes) for r in spark.read.parquet(f"{tmp_path}/out").select("key", F.col("first").cast("timestamp"), F.col("last").cast("timestamp"), "writes").collect()}

    row = lambda key, a, b, n: (key, at(a).timestamp(), at(b).timestamp(), n)
    assert go(parts[0], 600_000, 0) == set()  # ends long before its timers
    closed = {row("a", 0, 14, 3), row("b", 3, 3, 1)}
    assert go(parts[1], 600_000, 0) == closed
    closed |= {row("a", 40, 41, 2), row("b", 2, 2, 1), row("d", 1, 1, 1)}
    got = go(parts[2], 1_000, 1_000)  # a's and b's timers are set anew, d's is its first
    assert got == closed | {row("b", 13, 13, 1)}
    assert go([("a", at(100))], 1_000, 1_000) == got | {row("a", 100, 100, 1)}


def test_log_tail_keeps_sixty_lines_over_restarts(spark, tmp_path):
    schema, sent = "job string, no long, line string", {"a": [], "b": []}
    for part in range(3):
        new = [("a", 50 * part + k, f"line {k} Step {50 * part + k}" if k % 7 == 0 else f"other {k}") for k in range(50)] + ([("b", part, "no progress" if part < 2 else "paso  12, step x")])
        for job, _, line in new:
            sent[job].append(line)
        spark.createDataFrame(new, schema).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        states.to_table(states.log_tails(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp")
        newest = {r.job: r.x for r in spark.read.parquet(f"{tmp_path}/out").groupBy("job").agg(F.max_by(F.struct("seen", "step", "tail"), "seen").alias("x")).collect()}
        assert newest["a"].tail.split("\n") == sent["a"][-60:] and newest["a"].step == 50 * part + 49 and newest["a"].seen == len(sent["a"])
        assert newest["b"].tail.split("\n") == sent["b"] and newest["b"].step == (12 if part == 2 else None)


def test_lifecycle_table(spark, sf_dir):
    got = [r for r in catalog.queries()["lifecycle"](spark, sf_dir).collect()]
    assert len(got) == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    by_id = {}
    for r in got:
        by_id.setdefault(r.id, []).append(r)
    for rows in by_id.values():
        state = "new"
        for r in sorted(rows, key=lambda r: (r.ts, r.action)):
            ok, state = jobs.step(state, r.action)
            assert (r.accepted, r.state) == (ok, state)


def test_proposals_are_kept_over_restarts(spark, tmp_path):
    schema = "id string, ts timestamp, action string, proposal string"
    at = lambda k: datetime.datetime(2024, 1, 1, 0, 0, k)
    for events in ([("a", at(0), "create", None), ("a", at(1), "propose", "first"), ("b", at(0), "propose", "early")], [("a", at(2), "propose", "second"), ("a", at(3), "accept", None), ("b", at(1), "create", None), ("b", at(2), "propose", None)]):
        spark.createDataFrame(events, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = jobs.lifecycle(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.id, r.ts.second, r.accepted, r.state, r.proposal) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 0, True, "open", None), ("a", 1, True, "proposed", "first"), ("a", 2, False, "proposed", "first"), ("a", 3, True, "accepted", "first"), ("b", 0, False, "new", None), ("b", 1, True, "open", None), ("b", 2, False, "open", None)]


def test_steps():
    state, seen = "new", []
    for action in ("create", "propose", "propose", "accept", "accept"):
        ok, state = jobs.step(state, action)
        seen.append((ok, state))
    assert seen == [(True, "open"), (True, "proposed"), (False, "proposed"), (True, "accepted"), (False, "accepted")]


def test_quiet_period_stream_drops_only_the_open_tail(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    jobs.quiet(stream, "user_id", "ts", "10 minutes", "0 seconds").select("user_id", F.col("session_window.start").alias("first"), "writes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    streamed = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = {tuple(r) for r in catalog.queries()["quiet_sessions"](spark, sf_dir).select("user_id", F.col("first").cast("timestamp"), "writes").collect()}
    assert streamed <= batch and len(batch) - len(streamed) <= 5
