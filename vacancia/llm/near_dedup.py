"""One row of each group of near-duplicates: SimHash for most pairs, exact sets for every decision, all pairs found.

A text is the set of its runs of five words without case; a shorter text is one of them. Texts of equal sets are a class.
Classes whose SimHash fingerprints (over these sets) differ in at most two bits are found by ``simhash.links``; that is
most of each group of copies, but a pair of similarity 0.8 may differ in more bits. So these pairs are first links beside
those of ``ngram_join.links``, which then holds against one another whatever is not connected yet. Every link is decided
by the sets, and no link is missed; no group is gathered in one task.

Defined cases: null and empty texts have the empty set and are near-duplicates of one another. Rows with a null doc_id are
all kept. A doc_id that repeats is no near-duplicate by itself: each of its rows belongs to the group of its own text, and a
group is represented by its smallest doc_id, one row of it: of several with that doc_id in one class the one of the least
hash over all columns. Texts of any length are taken whole; an empty table gives an empty one; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import flag_pages, flag_place, flagged, fresh, join_counted, slices, utf8, written
from vacancia.llm.ngram_join import FLAG_BITS, classes_of, links, ngram_ranks, ngrams, rooted, set_class, with_keys
from vacancia.llm.simhash import links as simhash_links


def close_classes(classes: DataFrame) -> DataFrame:
    """src and dst: classes of one fingerprint, each with the least of them, and the least ones of fingerprints that
    ``simhash.links`` finds close."""
    least = written(classes.groupBy("fingerprint").agg(F.min("class").alias("low"), F.count("*").alias("n")), "fingerprints")
    same = join_counted(classes.select("class", "fingerprint"), least, "fingerprint", classes.count(), 0).where("class <> low").select(F.col("low").alias("src"), F.col("class").alias("dst"))
    near = simhash_links(least.select("fingerprint"))
    ends = [least.select(F.col("fingerprint").alias(end), F.col("low").alias(f"{end}_class")) for end in ("src", "dst")]
    both = near.join(ends[0], "src").join(ends[1], "dst").select(F.col("src_class").alias("src"), F.col("dst_class").alias("dst"))
    return same.unionByName(both)


def with_class(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the class of each row's text as ``name``."""
    fields = docs.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            classes = [set_class(ngrams(utf8(t))) or b"" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(classes, pa.binary())], [*(f.name for f in fields), name])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{name}` binary"]))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``docs`` without near-duplicates but one."""
    known = docs.where("doc_id is not null")
    rows = written(with_keys(known, ngram_ranks(known), True), "near-keys")
    own = F.coalesce("class", F.lit(b""))
    classes = written(classes_of(rows), "near-classes")
    found = rooted(classes.select("class", "digest", "doc_id"), links(known, classes, close_classes(classes)))
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", F.col("digest").alias("class"))).alias("one")).select("one.*")
    empty = rows.where("class is null").groupBy().agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").select("doc_id", F.lit(b"").alias("class"))
    kept = written(first.unionByName(empty), "near-kept")

    # Most ids stand once and are kept: their rows don't move.
    marked = rows.select("doc_id", own.alias("class")).join(kept.withColumn("kept", F.lit(True)), ["doc_id", "class"], "left")
    touched = marked.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("kept").alias("n_kept")).where("n > 1 or n_kept = 0")
    pages = written(flag_pages(touched, flag_place(F.col("doc_id"), FLAG_BITS)), "near-flags")
    name, row = fresh("class", docs.columns), fresh("row", docs.columns)
    handled = with_class(flagged(known, pages, True, FLAG_BITS), name).join(kept.withColumnRenamed("class", name), ["doc_id", name], "left_semi")
    handled = handled.select(F.col("doc_id").alias("id"), F.col(name).alias("of"), F.struct(*docs.columns).alias(row))
    one = handled.groupBy("id", "of").agg(F.min_by(row, F.xxhash64(*[F.col(row)[c] for c in docs.columns])).alias(row)).select(f"{row}.*")
    return flagged(known, pages, False, FLAG_BITS).unionByName(one).unionByName(docs.where("doc_id is null"))
