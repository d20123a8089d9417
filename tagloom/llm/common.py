"""What several operators share: table access, the shared folder, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores added until none of the columns has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the named columns and text as UTF-8 bytes; other columns stay behind."""
    return docs.select("doc_id", *more, F.col("text").cast("binary").alias("text"))


def map_texts(docs: DataFrame, work: Callable[[list], dict], schema: str, *more: str, keep_text: bool = False) -> DataFrame:
    """Apply work(list of whole texts as bytes, null as empty) to each Arrow batch; it returns the new columns.

    doc_id and the columns `more` stay; so does text, as bytes, with keep_text.
    """
    more = (*more, "text") if keep_text else more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                new = work([x or b"" for x in part.column("text").to_pylist()])
                kept = {"doc_id": part.column("doc_id")} | {c: part.column(c) for c in more}
                yield pa.RecordBatch.from_pydict(kept | {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in new.items()})

    ids = docs.schema["doc_id"].dataType.simpleString()
    own = [f"doc_id {ids}"] + [f"`{c}` {'binary' if c == 'text' else docs.schema[c].dataType.simpleString()}" for c in more]
    return texts(docs, *(c for c in more if c != "text")).mapInArrow(run, ", ".join([*own, schema]))


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about `most` bytes of text, so that memory does not follow text lengths."""
    at, size = 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_pylist()
    for k, n in enumerate(lengths):
        if size and size + n > most:
            yield batch.slice(at, k - at)
            at, size = k, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)
