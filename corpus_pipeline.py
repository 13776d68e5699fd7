"""A corpus from documents: quality, repeated lines, near-duplicates, benchmark leaks, packed sequences.

Each stage takes what its predecessor kept, written as Parquet, and works on all of it. All stages but the last return
the columns of documents.

Defined cases, in every stage but the last: rows without doc_id pass where a stage decides by doc_id, and are scored by
the classifier like any other; null and empty texts are scored as empty and near-duplicates of one another; texts of any
length are taken whole; a doc_id that repeats is judged by all its rows, but by the near-duplicate stage each row by its own
text: of equal ids in one class of texts it keeps the row of the least hash over all columns, so that ties don't depend on
partitions; an empty table gives an empty one; extra columns are kept whatever their names. n_chars, if there is such a column, follows a text that a stage changes. The last
stage returns pieces for every row, and leaves other columns out.

A stage sets the session's limit on bytes of an Arrow batch to ``ARROW_BYTES`` and on rows of a batch of the Parquet reader to
``READ_ROWS``, as the JVM and Python of an executor hold several at once; they stay set, since the caller runs the stage's
last step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.llm import decontaminate, line_dedup, near_dedup, packing, quality
from vacancia.llm.common import flag_pages, flag_place, flagged, written
from vacancia.llm.ngram_join import FLAG_BITS

ARROW_BYTES = 1 << 20
READ_ROWS = 1024
PARTS = 100_000  # of texts, whose ids a Python worker keeps in packing


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, scores 0.3 or more."""
    p = quality.Params()
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), p)
    scored = quality.score(docs, model, p.threshold, tuple(docs.columns))
    return scored.where(F.col(scored.columns[-1]) == 1).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their later repeated runs of lines; those left without any text go."""
    done = line_dedup.remove_repeats(docs)
    removed = F.col(done.columns[-1])
    done = done.where((removed == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(removed > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 of their five-word shingles or more) one row, of the smallest doc_id."""
    return near_dedup.distinct_texts(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no run of a benchmark item, under its own or other numbers, names and units."""
    leaks = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    leaks = written(leaks, "leaks")
    # Rows that flags of fixed size show to be free don't move.
    pages = written(flag_pages(leaks, flag_place(F.col("doc_id"), FLAG_BITS)), "leak-flags")
    kept = flagged(docs, pages, True, FLAG_BITS).join(leaks, "doc_id", "left_anti").select(*docs.columns)
    return flagged(docs, pages, False, FLAG_BITS).unionByName(kept)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, each with its sequence and offset."""
    return packing.pack(docs, most=PARTS)


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` with Arrow batches of ``ARROW_BYTES`` or little more, and ``READ_ROWS`` rows a batch read."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality", in_small_batches(keep_quality)),
    ("line dedup", in_small_batches(drop_repeated_lines)),
    ("near-duplicates", in_small_batches(drop_near_duplicates)),
    ("decontamination", in_small_batches(drop_leaks)),
    ("packing", in_small_batches(pack)),
]

#: XXH64 fingerprints, a trained model and token ids are beyond DuckDB's SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
