"""Delta-maintained token counts: additive totals by source, language and tokenizer version, fed by signed changes.

A change says what happened to one document in one batch: ``insert``, ``delete`` or ``revise`` (a new text, source or
language). A batch of changes is resolved to its last change a document, compared with what those documents counted for
before, and turned into signed deltas: +1 document and its tokens where it counts from now on, -1 and what it counted
where it no longer does. The totals after a batch are those after the batch before plus its deltas, a row a group. What
documents counted for before comes from the last ledger, written every ``ledger_every`` batches, and the changes since. A
commit reads these, but flags of the batch's ids, of a fixed size, leave out the others' rows before anything moves; a
ledger is written for all documents.

Commits are idempotent. Batches are numbered as they first come, and stand in a commit log in the shared folder, which
a new driver reads. A batch is written to a folder of its own, and counts once its row is in the log; what a failed
attempt leaves behind is never read. Committing a name again with the same changes does nothing. With other changes it
takes its old place: it and all later batches are worked out again from their kept changes, and enter the log together.
One driver commits at a time.

Defined cases: inserting a document that counts already, or revising one that doesn't, sets it; deleting one that
doesn't count changes nothing. A null text counts no tokens, an empty one none either. Texts of any length are taken
whole. Changes without doc_id are left out. Repeated changes count once; ties of ``seq`` are settled by the greater
change kind, then by hashes of text, source and language. A null source or language is a group of its own. Totals that
come to no documents are left out. A batch without changes keeps its number; before any commit totals and ledger are
empty. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.llm.common import flag_pages, flag_place, flagged, new_folder, slices, written
from vacancia.llm.tokens import KEPT, default_path, encoder

FLAG_BITS = 26
GROUP = ["source", "lang", "tokenizer"]
LOG = "version long, number long, batch string, folder string, ledger boolean"
TOTALS = "source string, lang string, tokenizer string, documents long, tokens long"
WORDS = "words-1"
BYTE_BPE = "byte_bpe_50k-1"


def count_words(texts: list[str]) -> np.ndarray:
    return np.fromiter((len(t.encode("utf-8", "surrogatepass").split()) for t in texts), dtype=np.int64, count=len(texts))


def byte_bpe(path: str | None = None) -> Callable[[list[str]], np.ndarray]:
    path = path or default_path()
    return lambda texts: encoder(path).encode(texts)[1]


def default_counters() -> dict[str, Callable[[list[str]], np.ndarray]]:
    """Counters by tokenizer version. A revised tokenizer gets a new version, and so rows of its own."""
    return {WORDS: count_words, BYTE_BPE: byte_bpe()}


def counted(changes: DataFrame, counters: Mapping[str, Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """``changes`` (doc_id, change, seq, text, source, lang) with ``tokens``, counts by tokenizer version, and ``digest``
    instead of the text."""
    fields = ["doc_id", "change", "seq", "source", "lang", "digest"]
    told_apart = [c for name in ("text", "source", "lang") for c in (F.col(name), F.col(name).isNull())]  # xxhash64 skips nulls
    rows = changes.withColumn("digest", F.xxhash64(*told_apart)).select(*fields, "text")
    kinds = ", ".join(f"`{f}` {rows.schema[f].dataType.simpleString()}" for f in fields)
    names = list(counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20, keeps=KEPT):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = np.stack([count(texts) for count in counters.values()], axis=1).astype(np.int64)
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(names))
            tokens = pa.MapArray.from_arrays(offsets, pa.array(names * len(texts), pa.string()), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in fields), tokens], [*fields, "tokens"])

    return rows.mapInArrow(run, f"{kinds}, tokens map<string, long>")


@dataclass(frozen=True)
class Batch:
    """A row of the commit log."""

    version: int
    number: int
    batch: str
    folder: str
    ledger: bool


class Rollup:
    """The totals and ledgers under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None, counters: Mapping[str, Callable[[list[str]], np.ndarray]] | None = None, ledger_every: int = 8):
        self.spark, self.folder, self.ledger_every = spark, folder or new_folder(spark, "token-rollup"), ledger_every
        self.counters = dict(counters or default_counters())
        self.batches: dict[int, Batch] = {} if folder is None else self._logged()

    def _logged(self) -> dict[int, Batch]:
        """The committed batches by number, each as its latest version has it: as many rows as commits."""
        try:
            rows = self.spark.read.schema(LOG).parquet(f"{self.folder}/commits").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        return {r.number: Batch(*r) for r in sorted(rows, key=lambda r: r.version)}

    def _read(self, number: int, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.batches[number].folder}/{part}")

    def _before(self, number: int, docs: DataFrame | None) -> DataFrame | None:
        """What documents (those of ``docs``, or all) count for before a batch; None if nothing is committed by then."""
        earlier = [n for n in sorted(self.batches) if n < number]
        if not earlier:
            return None
        base = max((n for n in earlier if self.batches[n].ledger), default=0)
        fields = ["doc_id", "source", "lang", "tokens"]
        parts = [self._read(base, "ledger").select(*fields, F.lit(base).alias("number"), F.lit(True).alias("counts"))] if base else []
        parts += [self._read(n, "changes").select(*fields, F.lit(n).alias("number"), (F.col("change") != "delete").alias("counts")) for n in earlier if n > base]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        if docs is not None:
            pages = written(flag_pages(docs, flag_place(F.col("doc_id"), FLAG_BITS)), "batch-flags")
            rows = flagged(rows, pages, True, FLAG_BITS).join(docs.select("doc_id"), "doc_id", "left_semi")
        last = rows.groupBy("doc_id").agg(F.max_by(F.struct("source", "lang", "tokens", "counts"), "number").alias("last"))
        return last.where("last.counts").select("doc_id", "last.source", "last.lang", "last.tokens")

    def _work_out(self, number: int, batch: str, changes: DataFrame, folder: str, version: int) -> None:
        """Deltas, totals and, where it is due, the ledger after a batch, whose ``changes`` are written."""
        fields = ["doc_id", "source", "lang", "tokens"]
        deltas = changes.where("change <> 'delete'").select(*fields, F.lit(1).alias("sign"))
        before = self._before(number, changes)
        if before is not None:
            deltas = deltas.unionByName(before.select(*fields, F.lit(-1).alias("sign")))
        at = f"{self.folder}/{folder}"
        deltas.write.mode("overwrite").parquet(f"{at}/deltas")
        each = self.spark.read.schema(deltas.schema).parquet(f"{at}/deltas").select("source", "lang", "sign", F.explode("tokens").alias("tokenizer", "n"))
        sums = each.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * F.col("n")).alias("tokens"))
        earlier = max((n for n in self.batches if n < number), default=None)
        if earlier is not None:
            sums = sums.unionByName(self._read(earlier, "totals")).groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        sums.where("documents <> 0 or tokens <> 0").write.mode("overwrite").parquet(f"{at}/totals")  # a row a group
        ledger = number % self.ledger_every == 0
        self.batches[number] = Batch(version, number, batch, folder, False)
        if ledger:
            self._before(number + 1, None).write.mode("overwrite").parquet(f"{at}/ledger")
            self.batches[number] = Batch(version, number, batch, folder, True)

    def commit(self, batch: str, changes: DataFrame) -> None:
        """``changes``: doc_id, change, seq, text, source and lang. Committing a batch again with other changes replaces it."""
        wanted = changes.where(F.col("doc_id").isNotNull()).select("doc_id", "change", "seq", "text", F.col("source").cast("string"), F.col("lang").cast("string"))
        order = F.struct("seq", "change", "digest")
        last = counted(wanted, self.counters).groupBy("doc_id").agg(F.max_by(F.struct("change", "source", "lang", "digest", "tokens"), order).alias("last")).select("doc_id", "last.*")
        number = next((b.number for b in self.batches.values() if b.batch == batch), max(self.batches, default=0) + 1)
        version = max((b.version for b in self.batches.values()), default=0) + 1
        folder = new_folder(self.spark, "batch").rpartition("/")[2]
        last.write.parquet(f"{self.folder}/{folder}/changes")
        resolved = self.spark.read.schema(last.schema).parquet(f"{self.folder}/{folder}/changes")
        kept = dict(self.batches)
        try:
            if number in kept and self._same(resolved, self._read(number, "changes")):
                return
            self._work_out(number, batch, resolved, folder, version)
            for later in sorted(n for n in kept if n > number):
                again = self._read(later, "changes")
                folder = new_folder(self.spark, "batch").rpartition("/")[2]
                again.write.parquet(f"{self.folder}/{folder}/changes")
                self._work_out(later, kept[later].batch, self.spark.read.schema(again.schema).parquet(f"{self.folder}/{folder}/changes"), folder, version)
            rows = [(b.version, b.number, b.batch, b.folder, b.ledger) for b in self.batches.values() if b.version == version]
            self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")  # one file: all or nothing
        except BaseException:
            self.batches = kept
            raise

    @staticmethod
    def _same(a: DataFrame, b: DataFrame) -> bool:
        """Whether two tables of resolved changes, a row a document, have the same rows."""
        fields = ["change", "source", "lang", "digest"]
        sides = [df.select("doc_id", F.struct(*fields, F.to_json("tokens").alias("tokens")).alias(side)) for df, side in ((a, "x"), (b, "y"))]
        return sides[0].join(sides[1], "doc_id", "full").where(~F.col("x").eqNullSafe(F.col("y"))).isEmpty()

    def ledger(self) -> DataFrame:
        """What each document counts for at present."""
        found = self._before(max(self.batches, default=0) + 1, None)
        return found if found is not None else self.spark.createDataFrame([], "doc_id long, source string, lang string, tokens map<string, long>")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents and tokens."""
        if not self.batches:
            return self.spark.createDataFrame([], TOTALS)
        return self._read(max(self.batches), "totals").select("source", "lang", "tokenizer", "documents", "tokens").where("documents <> 0")
