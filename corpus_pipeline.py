"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns the
columns of documents; the last returns token ids instead.  ORACLE_SQL is None, as SQL
can't express zstandard, MinHash or SentencePiece; tests hold it against brute force.  An
empty table of documents passes every stage and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import contamination, neardup, pieces, quality, secrets
from tagloom.llm.common import map_texts, table, unused, written
from tagloom.llm.queries import split_pattern, tokenizer_path

#: Similarity, in hundredths, from which documents are near duplicates here; op4's contract has its own.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the compression bands, fitted on good documents, reject.

    Null and empty texts have too few words and go; equal rows share their verdict; long texts
    are read whole.  All columns of docs stay as they are, whatever their names.
    """
    own, others = unused("kept", docs.columns), [c for c in docs.columns if c not in ("doc_id", "text")]
    bands = quality.fit_bands(docs, table(spark, sf_dir, "labels"))

    def work(batch: list[bytes]) -> dict:
        return {own: quality.measure(batch, bands)["kept"]}

    kept = map_texts(docs, work, f"{own} boolean", *others, keep_text=True).where(F.col(own))
    return kept.select(*[F.col("text").cast("string").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the document with the smallest id of each near-duplicate group.

    Documents without an id or without words stay; rows with equal ids go or stay together.
    """
    gone = neardup.near_duplicates(docs.select("doc_id", "text"), NEAR_PERCENT).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts hold none."""
    return contamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; all rows stay, null texts stay null, n_chars follows a changed text."""
    return secrets.redact_secrets(docs, tokenizer_path("byte_bpe_50k.tiktoken"), split_pattern())


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids, of the decoded text and of the pieces' spans.

    A null or empty text has the end id only; every row gives one row; other columns stay behind.
    """
    return pieces.round_trip(docs, tokenizer_path("piece_bpe_32k.model"), keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("sentencepiece encoding", tokenise),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
