"""Near-duplicates by Jaccard similarity of word shingles: MinHash bands for candidates, exact sets for the decision.

A text is the set of its runs of ``WORDS`` words (without case); a shorter text is one shingle. Texts with equal sets
are one class. Two sets of similarity 0.8 agree in all ``ROWS`` hashes of one of ``BANDS`` bands but with probability
(1 - 0.8 ** 5) ** 30 = 7e-6, greater similarities less often. In each band every class is linked to the smallest one
with its key, and components of these links hold every pair that a band found. A pair is a link if its exact sets reach
the threshold, and what is linked over others is one component too.

Links to the smallest class are checked first, pair by pair over all tasks. Where they alone connect a component of
candidates, as they do for copies with small changes however many, it is one component of near-duplicates. The sets of
the other components meet: taken by size, those that share none of the first ``n - 0.8 n + 1`` hashes can't be similar
enough, and pairs that are connected already aren't compared.

Defined cases: null and empty texts have the empty set and are linked with one another. Rows with a null doc_id are
left out. Texts of any length are taken whole, an empty table gives an empty result. Rows that repeat a doc_id are classed by their own texts; a doc_id may have several components.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import U64, mix, slices, utf8, written
from vacancia.llm.simhash import components

WORDS = 5
SIMILAR = (4, 5)  # the least similarity as a fraction
BANDS, ROWS = 30, 5
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64)) | U64(1)
_SALTS = mix(np.arange(1001, BANDS * ROWS + 1001, dtype=U64))


def shingles(text: bytes, width: int = WORDS) -> np.ndarray:
    """XXH64 of each distinct shingle, ascending."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=U64)
    digest = xxhash.xxh64_intdigest
    flat = b" ".join(words)
    if len(words) <= width:
        return np.array([digest(flat)], dtype=U64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(size + 1) - size - 1
    ends = (starts + size)[width - 1 :]
    return np.unique(np.fromiter((digest(flat[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=False)), dtype=U64, count=len(ends)))


def set_hash(found: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(found.tobytes(), 7), dtype=U64).view(np.int64))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A key of each set (none is empty) in each band."""
    flat = np.concatenate(sets)
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    starts = np.cumsum(size) - size
    keys = np.zeros((len(sets), BANDS), dtype=U64)
    for k, (factor, salt) in enumerate(zip(_FACTORS, _SALTS, strict=True)):
        band = k // ROWS
        keys[:, band] = mix(keys[:, band] * U64(0x9FB21C651E98DF25) + np.minimum.reduceat((flat ^ salt) * factor, starts))
    return keys


def classed(docs: DataFrame) -> DataFrame:
    """doc_id, the hash of its set, and the set's band keys (none for an empty set)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sets = [shingles(utf8(t)) for t in batch.column("text").to_pylist()]
            keys: list = [None] * len(sets)
            full = [i for i, s in enumerate(sets) if len(s)]
            if full:
                for i, row in zip(full, band_keys([sets[i] for i in full]).view(np.int64), strict=True):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([set_hash(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "class", "keys"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, class long, keys array<long>")


def connected(sets: list[np.ndarray], similar: tuple[int, int] = SIMILAR, known: np.ndarray | None = None) -> np.ndarray:
    """For each set a label; equal for those that links of at least the similarity connect. Sets of one ``known`` label are
    connected already."""
    above, below = similar
    label = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1]
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    holders: dict[int, array] = defaultdict(lambda: array("q"))
    for i in np.argsort(size, kind="stable").tolist():
        mine, n = sets[i], int(size[i])
        prefix = mine[: n - -(-above * n // below) + 1].tolist()
        failed: set[int] = set()
        for s in prefix:
            for_s = np.array(holders.get(s, ()), dtype=np.int64)
            while len(for_s := for_s[label[for_s] != label[i]]):
                j = int(for_s[-1])
                for_s = for_s[:-1]
                if j in failed or below * size[j] < above * n:
                    continue
                other = sets[j]
                at = np.minimum(np.searchsorted(mine, other), n - 1)
                shared = int((mine[at] == other).sum())
                if below * shared >= above * (n + len(other) - shared):
                    label[label == label[j]] = label[i]
                else:
                    failed.add(j)
        for s in prefix:
            holders[s].append(i)
    return label


def shingle_sets(docs: DataFrame, first: DataFrame) -> DataFrame:
    """class, doc_id and set (packed hashes) of the classes of ``first``, each read from its first document's text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sets = [shingles(utf8(t)) for t in batch.column("text").to_pylist()]
            known = batch.column("class").to_pylist()
            # Rows that repeat a doc_id with another text belong to another class.
            mine = [i for i, s in enumerate(sets) if set_hash(s) == known[i]]
            yield pa.RecordBatch.from_arrays([batch.column("class").take(pa.array(mine, pa.int64())), batch.column("doc_id").take(pa.array(mine, pa.int64())), pa.array([sets[i].tobytes() for i in mine], pa.binary())], ["class", "doc_id", "set"])

    read = docs.select("doc_id", "text").join(first, "doc_id").mapInArrow(run, f"class long, doc_id {kind}, set binary")
    return written(read.groupBy("class").agg(F.min(F.struct("doc_id", "set")).alias("one")).select("class", "one.*"), "shingle-sets")


def are_similar(a: bytes, b: bytes) -> bool:
    """Whether two sets of packed hashes reach the similarity."""
    above, below = SIMILAR
    x, y = np.frombuffer(a, dtype=U64), np.frombuffer(b, dtype=U64)
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return below * shared >= above * (len(x) + len(y) - shared)


def similar_pairs(edges: DataFrame, sets: DataFrame, test: Callable[[bytes, bytes], bool] = are_similar) -> DataFrame:
    """Those of ``edges`` (src, dst) whose sets pass the test. A src that many edges share is joined by broadcast:
    a hundred sets of a megabyte at most."""
    total = edges.count()
    counted = sets.join(edges.groupBy(F.col("src").alias("class")).agg(F.count("*").alias("n")), "class").select(F.col("class").alias("src"), F.col("set").alias("a"), "n")
    hot = (F.col("n") >= F.lit(max(total // 100, 2))) & (F.octet_length("a") <= 1 << 20)
    pairs = edges.join(sets.select(F.col("class").alias("dst"), F.col("set").alias("b")), "dst")
    marked = pairs.join(F.broadcast(counted.where(hot).drop("n")), "src", "left")
    rest = marked.where("a is null").drop("a").join(counted.where(~hot).drop("n"), "src")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "b"):
            pairs = zip(batch.column("a"), batch.column("b"), strict=True)
            at = pa.array([i for i, (a, b) in enumerate(pairs) if test(a.as_py(), b.as_py())], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("src").take(at), batch.column("dst").take(at)], ["src", "dst"])

    columns, kind = ["src", "dst", "a", "b"], edges.schema["src"].dataType.simpleString()
    return marked.where("a is not null").select(*columns).unionByName(rest.select(*columns)).mapInArrow(run, f"src {kind}, dst {kind}")


def kept_ids(docs: DataFrame) -> DataFrame:
    """doc_id of the first row of each component of near-duplicates."""
    rows = written(classed(docs), "shingle-classes")
    classes = rows.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    entries = classes.select("class", F.posexplode("keys").alias("band", "key"))
    least = entries.groupBy("band", "key").agg(F.min("class").alias("low"), F.count("*").alias("n")).where("n > 1")
    edges = entries.join(least.drop("n"), ["band", "key"]).where("class <> low").select(F.col("low").alias("src"), F.col("class").alias("dst")).distinct()
    edges = written(edges, "candidate-pairs")

    def labelled(links: DataFrame, name: str) -> DataFrame:
        found = components(links).select(F.col("node").alias("class"), F.col("root").alias(name))
        return found.unionByName(found.select(F.col(name).alias("class"), name)).distinct()

    first = written(rows.groupBy("class").agg(F.min("doc_id").alias("doc_id")), "class-documents")
    found = written(labelled(edges, "root"), "candidate-components")
    sets = shingle_sets(docs, first.join(found, "class", "left_semi"))
    near = written(labelled(written(similar_pairs(edges, sets), "similar-pairs"), "near"), "similar-components")
    # Most components of candidates are one component of near-duplicates by these pairs alone. Of the others the sets meet.
    both = found.join(near, "class", "left").withColumn("near", F.coalesce("near", "class"))
    split = both.groupBy("root").agg((F.min("near") != F.max("near")).alias("split"))
    sorted_out = found.join(split.where("not split").select("root"), "root").join(first, "class").groupBy("root").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    members = sets.join(both, "class").join(split.where("split").select("root"), "root").select("root", "near", "doc_id", "set")
    kind = docs.schema["doc_id"].dataType

    def decide(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(v.as_py(), dtype=U64) for v in group.column("set")]
        label = connected(sets, known=group.column("near").to_numpy()).tolist()
        lowest: dict = {}
        for i, k in zip(group.column("doc_id").to_pylist(), label, strict=True):
            lowest[k] = min(i, lowest.get(k, i))
        return pa.table([pa.array(list(lowest.values()), group.schema.field("doc_id").type)], names=["doc_id"])

    checked = members.groupBy("root").applyInArrow(decide, f"doc_id {kind.simpleString()}")
    alone = first.join(found, "class", "left_anti").select("doc_id")
    return alone.unionByName(sorted_out).unionByName(checked).distinct()
