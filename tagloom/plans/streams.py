"""Queries that run a stream over a table to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs, states
from .registry import query
from .views import table


def source(sf_dir: str, name: str) -> str:
    """A table as a stream's path: a pattern, as a stream takes no single file."""
    return f"{sf_dir}/{name}.parque[t]"


@query("SELECT * FROM events")
def stream_ingest(spark, sf_dir):
    """All events, read by a stream and written once."""
    at = jobs.shared(spark)
    schema = table(spark, sf_dir, "events").schema
    return jobs.ingest(spark, source(sf_dir, "events"), schema, ["event_id"], f"{at}/table", f"{at}/checkpoint")[0]


@query("SELECT count(doc_id) AS processed, count(*) - count(doc_id) AS rejected FROM labels")
def ingest_counters(spark, sf_dir):
    """What an ingest of labels counted while it ran."""
    at = jobs.shared(spark)
    schema = table(spark, sf_dir, "labels").schema
    _, counts = jobs.ingest(spark, source(sf_dir, "labels"), schema, ["doc_id"], f"{at}/table", f"{at}/checkpoint")
    return spark.createDataFrame([(counts["processed"], counts["rejected"])], "processed long, rejected long")


@query("SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, l.quality, length(d.text) AS n_chars FROM labels l FULL JOIN documents d ON d.doc_id = l.doc_id")
def stream_upsert(spark, sf_dir):
    """Labels as an index, with a computed length for each document streamed in."""
    at = jobs.shared(spark)
    index = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"), F.lit(None).cast("long").alias("n_chars"))
    docs = table(spark, sf_dir, "documents")
    stream = spark.readStream.schema(docs.schema).parquet(source(sf_dir, "documents")).select("doc_id", F.length("text").cast("long").alias("n_chars"))
    return jobs.upsert(spark, stream, index, ["n_chars"], f"{at}/checkpoint")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 10 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM o) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS writes FROM s GROUP BY user_id, n""")
def quiet_stream(spark, sf_dir):
    """Quiet periods of users found by a stream; timers close those that are open at its end."""
    at = jobs.shared(spark)
    schema = table(spark, sf_dir, "events").schema
    out = states.quiet_sessions(spark.readStream.schema(schema).parquet(source(sf_dir, "events")), "user_id", "ts", 600_000, 2_000)
    states.to_table(out, f"{at}/out", f"{at}/checkpoint", 2_000)
    return spark.read.schema(out.schema).parquet(f"{at}/out")


LINE = "text || ' step ' || length(text)"


@query(f"""WITH l AS (SELECT conv_id, turn, {LINE} AS line, length(text) AS step, count(*) OVER (PARTITION BY conv_id) AS seen, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, {LINE} DESC NULLS FIRST) AS back FROM conversations WHERE conv_id IS NOT NULL)
SELECT conv_id AS job, max(seen) AS seen, max(CASE WHEN back = 1 THEN step END) AS step, md5(string_agg(coalesce(line, ''), chr(10) ORDER BY back DESC)) AS tail FROM l WHERE back <= 60 GROUP BY conv_id""")
def log_tail(spark, sf_dir):
    """Conversations as logs of jobs: the latest step and the last 60 lines, kept in a stream's state."""
    at = jobs.shared(spark)
    own = spark.readStream.schema(table(spark, sf_dir, "conversations").schema).parquet(source(sf_dir, "conversations"))
    line = F.concat("text", F.lit(" step "), F.length("text").cast("string"))
    out = states.log_tails(own.where("conv_id is not null").select(F.col("conv_id").alias("job"), F.col("turn").cast("long").alias("no"), line.alias("line")))
    states.to_table(out, f"{at}/out", f"{at}/checkpoint")
    rows = spark.read.schema(out.schema).parquet(f"{at}/out")
    newest = rows.groupBy("job").agg(F.max_by(F.struct("seen", "step", "tail"), "seen").alias("x"))
    return newest.select("job", "x.seen", "x.step", F.md5(F.col("x.tail").cast("binary")).alias("tail"))


@query("""WITH RECURSIVE own AS (SELECT user_id AS id, ts, props, CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'propose' WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'decline' ELSE 'view' END AS action FROM events),
numbered AS (SELECT *, CASE WHEN action = 'propose' AND trim(coalesce(props, '')) = '' THEN 'blank' ELSE action END AS judged, row_number() OVER (PARTITION BY id ORDER BY ts, action, props) AS rn FROM own),
moves(state, action, after) AS (VALUES ('new', 'create', 'open'), ('open', 'propose', 'proposed'), ('proposed', 'accept', 'accepted'), ('proposed', 'decline', 'declined')),
walk AS (SELECT n.id, n.rn, n.ts, n.action, m.after IS NOT NULL AS accepted, coalesce(m.after, 'new') AS state, CAST(NULL AS VARCHAR) AS proposal FROM numbered n LEFT JOIN moves m ON m.state = 'new' AND m.action = n.judged WHERE n.rn = 1
  UNION ALL SELECT n.id, n.rn, n.ts, n.action, m.after IS NOT NULL, coalesce(m.after, w.state), CASE WHEN m.after = 'proposed' THEN n.props ELSE w.proposal END FROM walk w JOIN numbered n ON n.id = w.id AND n.rn = w.rn + 1 LEFT JOIN moves m ON m.state = w.state AND m.action = n.judged)
SELECT id, ts, action, accepted, state, proposal FROM walk""")
def lifecycle(spark, sf_dir):
    """Users' events as request actions, judged by a stateful stream."""
    at = jobs.shared(spark)
    schema = table(spark, sf_dir, "events").schema
    action = F.create_map(*[F.lit(x) for p in (("signup", "create"), ("click", "propose"), ("purchase", "accept"), ("error", "decline")) for x in p])
    events = spark.readStream.schema(schema).parquet(source(sf_dir, "events")).select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.try_element_at(action, F.col("event_type")), F.lit("view")).alias("action"), F.col("props").alias("proposal"))
    out = jobs.lifecycle(events)
    out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")
