"""The opN_<name> queries: each runs its operator over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.llm import decontaminate, jpeg, line_dedup, ngram_join, packing, periodic, phrases, pst, quality, simhash, substring_dedup, token_rollup, warc
from vacancia.llm.common import new_folder, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_lm_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.score(_table(spark, sf_dir, "documents"))


def op3_decontaminate_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_packing_large_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).drop("url")


def op7_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.features(jpeg.store(_table(spark, sf_dir, "documents")))


def op8_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_substring_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after twelve batches, three replays and a restart: all documents come, a tenth of them goes, comes back
    revised to other texts in nine parts, and one part is revised once more."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    number = F.crc32(F.col("doc_id").cast("string"))
    some = written(docs.where(number % 10 == 0), "revised-documents")
    gone = some.select("doc_id", F.lit(None).cast("string").alias("text"), "source", "lang")
    revised = {f"batch-{k}": some.where(number % 90 == 10 * (k - 3)).withColumn("text", F.concat("text", F.lit(f" revised in {k}"))) for k in range(3, 12)}
    revised["batch-12"] = revised["batch-10"].withColumn("text", F.concat("text", F.lit(" and again")))
    folder = new_folder(spark, "token-rollup")
    rollup = token_rollup.Rollup(spark, folder)
    rollup.commit("batch-1", _changes(docs, "insert", 1))
    rollup.commit("batch-2", _changes(gone, "delete", 2))
    for seq, (batch, part) in enumerate(revised.items(), 3):
        rollup.commit(batch, _changes(part, "revise", seq))
    rollup = token_rollup.Rollup(spark, folder)
    rollup.commit("batch-2", _changes(gone, "delete", 2))
    for batch in ("batch-10", "batch-3"):
        rollup.commit(batch, _changes(revised[batch], "revise", int(batch[6:])))
    return rollup.totals()


def op11_ngram_heavy_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find(periodic.with_repeats(_table(spark, sf_dir, "documents"))))


def op13_phrase_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def _changes(docs: DataFrame, change: str, seq: int) -> DataFrame:
    return docs.select("doc_id", F.lit(change).alias("change"), F.lit(seq).alias("seq"), "text", "source", "lang")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_nbsvm": op1_quality_nbsvm,
    "op2_lm_suffix_tree": op2_lm_suffix_tree,
    "op3_decontaminate_templates": op3_decontaminate_templates,
    "op4_packing_large_items": op4_packing_large_items,
    "op5_line_winnowing": op5_line_winnowing,
    "op6_warc_capture_index": op6_warc_capture_index,
    "op7_media_jpeg": op7_media_jpeg,
    "op8_simhash_neardup": op8_simhash_neardup,
    "op9_substring_recompression": op9_substring_recompression,
    "op10_token_rollup": op10_token_rollup,
    "op11_ngram_heavy_light": op11_ngram_heavy_light,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_phrase_growth": op13_phrase_growth,
}

ORACLE_SQL: dict[str, str] = {"op5_line_winnowing": line_dedup.ORACLE_SQL, "op11_ngram_heavy_light": ngram_join.ORACLE_SQL, "op13_phrase_growth": phrases.ORACLE_SQL}
