"""Structured Streaming jobs: watching, upserts, quiet periods, request lifecycles."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import snapshots
from ..shared import shared_folder
from .states import with_rocks

MOVES = {("new", "create"): "open", ("open", "propose"): "proposed", ("proposed", "accept"): "accepted", ("proposed", "decline"): "declined"}


def shared(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a stream over all that is there, batch by batch, and stop; a restart goes on from the checkpoint."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Counters(StreamingQueryListener):
    """Sums of what a query's batches observed under a name, and when the last batch ran; nothing is read again for them."""

    def __init__(self, name: str):
        self.name, self.totals, self.last, self.batches = name, {}, None, 0
        self.query, self.ended = None, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is None:
            return
        self.batches, self.last = self.batches + 1, event.progress.timestamp
        for key, value in seen.asDict().items():
            self.totals[key] = self.totals.get(key, 0) + (value or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.query is None or str(event.id) == self.query:
            self.ended.set()


def ingest(spark: SparkSession, source: str, schema, keys: list[str], target: str, checkpoint: str) -> tuple[DataFrame, dict]:
    """Append what is new since the last run to a table, one row a key, and count: (table, counts of this run).

    Keys that were seen are in the stream's state store, so a batch reads no earlier rows; the
    file sink and the checkpoint make restarts idempotent.  Rows with a null key are rejected.
    Counts are processed, rejected, batches and last, the time of the last batch; they are
    observed on the way.
    """
    null = F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 1
    name = f"ingest-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(source).observe(name, F.count_if(~null).alias("processed"), F.count_if(null).alias("rejected"))
    counters = Counters(name)
    spark.streams.addListener(counters)
    try:

        def run() -> None:
            query = stream.where(~null).dropDuplicates(keys).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            counters.query = str(query.id)
            query.awaitTermination()
            counters.ended.wait(60)  # events arrive on another thread

        with_rocks(spark, run)
    finally:
        spark.streams.removeListener(counters)
    counts = {"processed": 0, "rejected": 0} | counters.totals | {"batches": counters.batches, "last": counters.last}
    return spark.read.schema(schema).parquet(target), counts


def upsert(spark: SparkSession, stream: DataFrame, index: DataFrame, columns: list[str], checkpoint: str, order: str | None = None, buckets: int = snapshots.BUCKETS) -> DataFrame:
    """Merge computed fields into an index without touching others; a batch rewrites only the buckets that hold its keys.

    The index is kept in buckets under the checkpoint (see snapshots); batch n makes version
    n + 1, so a restart goes on where the last run ended and a batch seen twice gives the same
    version.  Of several values for a key in one batch the one with the largest `order` wins
    (without it, the largest value); a null leaves the field as it was.
    """
    root = f"{checkpoint}/snapshots"
    if snapshots.newest(spark, f"{root}/manifests") < 0:
        snapshots.create(index, root, "doc_id", buckets)

    def work(batch: DataFrame, number: int) -> None:
        value = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(order or c).alias("at"), F.col(c).alias("value"))))["value"]
        new = batch.groupBy("doc_id").agg(*(value(c).alias(c) for c in columns))
        snapshots.upsert(new, root, index.schema, "doc_id", columns, number + 1, buckets)

    drain(stream, work, checkpoint)
    return snapshots.read(spark, root, index.schema)


def quiet(stream: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Keys that had no write for `gap`, once the watermark has passed them."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("writes"))


def step(state: str, action: str) -> tuple[bool, str]:
    """Whether a request in `state` accepts the action, and its state afterwards."""
    new = MOVES.get((state, action))
    return new is not None, new or state


def lifecycle(events: DataFrame) -> DataFrame:
    """(id, ts, action, accepted, state, proposal) of request events (id, ts, action, proposal); an id's state and proposal are kept between batches.

    An accepted `propose` stores its proposal, which later rows of the id show; one without a
    text is refused, and what is refused changes nothing.
    """
    kind = events.schema["id"].dataType.simpleString()

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, held = state.get if state.exists else ("new", None)
        # one id's events of one micro-batch, which may come in several Arrow batches
        own = pd.concat([part[["ts", "action", "proposal"]] for part in parts]).sort_values(["ts", "action", "proposal"])
        out = []
        for ts, action, proposal in own.itertuples(index=False):
            blank = action == "propose" and not (isinstance(proposal, str) and proposal.strip())
            accepted, now = (False, now) if blank else step(now, action)
            held = proposal if accepted and action == "propose" else held
            out.append((key[0], ts, action, accepted, now, held))
        state.update((now, held))
        yield pd.DataFrame(out, columns=["id", "ts", "action", "accepted", "state", "proposal"])

    schema = f"id {kind}, ts timestamp, action string, accepted boolean, state string, proposal string"
    return events.groupBy("id").applyInPandasWithState(advance, schema, "state string, proposal string", "append", GroupStateTimeout.NoTimeout)
