"""Corpus pipeline: language ID, line dedup, near-duplicate removal, mixing, SentencePiece ids.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is written as
Parquet that the next one reads. All but the last return the columns of docs, extra ones included.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import language, line_dedup, mixing, near_dedup, pieces, storage
from loomline.llm.queries import MIX_WEIGHTS, mix_levels, vocabulary

#: A document stays if its first language makes up this share of it.
LEAST_SHARE = 0.35
#: Of the tokens that reach the mixing stage, the percentage that its budget is.
BUDGET_PERCENT = 90
#: Rows of an Arrow batch: documents are long, and executors and their Python workers hold several batches at once.
ARROW_ROWS = 512


def short_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


@short_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (or text), and those without a main language. A row counts by itself:
    repeated rows and rows without doc_id stay or go by their text. An empty table gives an empty one."""
    found = language.identify(docs)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select("row.*")


@short_batches
def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that ten documents or more hold; n_chars is that of what is left. Every row is a document of
    its own, no row goes; a null text becomes an empty one."""
    found = line_dedup.dedup_lines(docs).select("row.*", F.col("kept").alias("_kept_text"))
    new = {"text": F.col("_kept_text"), "n_chars": F.length("_kept_text").cast("long")}
    return found.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


@short_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group of near duplicates (five words, similarity 0.8). Rows
    of one doc_id are one document; rows without one stay."""
    gone = near_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(storage.materialize(gone, "gone"), "doc_id", "left_anti").select(docs.columns)


@short_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each leaf's token prefix, in one epoch; the one in which the budget ends stays whole. Rows without
    tokens (null, empty or blank texts) go; null names are a node of their own; rows of one doc_id have one place in the
    order, so that repeated rows stay or go together, but for the place where a budget ends."""
    return mixing.mix(docs, mix_levels(), MIX_WEIGHTS, budget_percent=BUDGET_PERCENT, max_epochs=1).select("row.*")


@short_batches
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids of a sampled segmentation, and whether they decode to the text; a row for each row, a null text as
    an empty one. Rows of one doc_id and text have equal ids."""
    return pieces.encode_decode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("language", identify_language),
    ("lines", drop_common_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: The mixture model, the signatures and the sampled segmentation have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table goes once the next one is written. The session's size of Arrow batches
    is as it was when all are."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for name, stage in STAGES:
            path = storage.new_path(spark, f"stage-{name}")
            docs = storage.write(stage(spark, docs, sf_dir), path)
            if before is not None:
                storage.drop(spark, before)
            before = path
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batches)
    return docs
