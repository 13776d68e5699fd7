"""Best-fit packing by large-item matching: documents' token pieces into sequences of a fixed capacity.

Pieces are token ids of whole documents, cut only where they exceed the capacity; a cut document's first piece is
the shorter one. Pieces above a third of the capacity share a sequence in twos at most: from the largest on, each is
matched with the largest other one that fits. Smaller pieces then go, largest first, into the fullest sequence that
has room, a new one if none has.

Only the histogram of lengths reaches the driver (as many rows as the capacity), and the plan made from it: patterns
of lengths with how many sequences follow each. A piece finds its place by its rank among the pieces of its length:
its rank within its part of the written table, plus what earlier parts hold of that length. No task sees more than a
part, whatever lengths repeat.

Defined cases: a null text counts as empty, whose only piece is the end id. Repeated rows are packed one for one. Texts of
any length are taken whole. Among pieces of one length the order of the written table decides, which no length or gap
depends on.
Columns beside doc_id and text are left out, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacancia.llm.common import ranges, slices, written
from vacancia.llm.tokens import KEPT, PARTS, default_path, encoder

CAPACITY = 1024
END = 2


@dataclass
class Pattern:
    """``bins`` sequences of like content: how many pieces of each length, in the order in which they lie."""

    bins: int
    items: list[tuple[int, int]] = field(default_factory=list)

    @property
    def filled(self) -> int:
        return sum(length * n for length, n in self.items)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold every piece. Work and size depend on the capacity, not on how many pieces there are."""
    left = {length: n for length, n in histogram.items() if n}
    found: list[Pattern] = []
    large = [length for length in sorted(left, reverse=True) if 3 * length > capacity]
    for a in large:
        while left[a]:
            partner = next((b for b in large if b <= a and a + b <= capacity and left[b] >= (2 if a == b else 1)), None)
            if partner is None:
                found.append(Pattern(left[a], [(a, 1)]))
                left[a] = 0
            elif partner == a:
                found.append(Pattern(left[a] // 2, [(a, 2)]))
                left[a] %= 2
            else:
                n = min(left[a], left[partner])
                found.append(Pattern(n, [(a, 1), (partner, 1)]))
                left[a] -= n
                left[partner] -= n
    open_: dict[int, list[Pattern]] = {}
    for p in found:
        open_.setdefault(capacity - p.filled, []).append(p)
    for s in (length for length in sorted(left, reverse=True) if 3 * length <= capacity):
        n = left[s]
        for gap in sorted(g for g in open_ if g >= s):
            if not n:
                break
            each, stay = gap // s, []
            for p in open_.pop(gap):
                whole = min(p.bins, n // each)
                rest = n - whole * each if whole < p.bins and n - whole * each < each else 0
                moved = [(whole, each), (1, rest)] if rest else [(whole, each)]
                for bins, count in moved:
                    if bins:
                        open_.setdefault(gap - count * s, []).append(Pattern(bins, [*p.items, (s, count)]))
                        n -= bins * count
                        p.bins -= bins
                if p.bins:
                    stay.append(p)
            if stay:
                open_.setdefault(gap, []).extend(stay)
        each = capacity // s
        for bins, count in ((n // each, each), (1, n % each)):
            if bins and count:
                open_.setdefault(capacity - count * s, []).append(Pattern(bins, [(s, count)]))
    return [p for patterns in open_.values() for p in patterns if p.bins]


@dataclass(frozen=True)
class Places:
    """For each length in turn, segments of ranks: where one begins, its first sequence, pieces a sequence, offset."""

    key: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length.astype(np.int64) << 44) + rank
        at = np.searchsorted(self.key, key, side="right") - 1
        inside = key - self.key[at]
        return self.sequence[at] + inside // self.each[at], self.offset[at] + inside % self.each[at] * length


def places(patterns: list[Pattern]) -> Places:
    rows, taken, sequence = [], {}, 0
    for p in patterns:
        offset = 0
        for length, n in p.items:
            rows.append(((length << 44) + taken.get(length, 0), sequence, n, offset))
            taken[length] = taken.get(length, 0) + n * p.bins
            offset += n * length
        sequence += p.bins
    return Places(*np.array(sorted(rows), dtype=np.int64).reshape(-1, 4).T)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, most: int = PARTS) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, its place by ``part`` and ``nth`` of its length.

    ``with_ids`` adds the ids themselves, as little-endian unsigned 32-bit numbers. A Python worker keeps the ids of ``most``
    parts of texts, which costs memory and saves time.
    """
    path = path or default_path()
    key = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        encode = encoder(path, most).encode
        for batch in slices(batches, "text", 1 << 20, keeps=KEPT):
            ids, each = encode([t or "" for t in batch.column("text").to_pylist()])
            stop = np.cumsum(each + 1)
            ids = np.insert(ids, np.cumsum(each), end).astype("<u4")
            total = each + 1
            count = -(-total // capacity)
            row = np.repeat(np.arange(len(total)), count)
            piece = ranges(np.zeros(len(count)), count)
            first = total - (count - 1) * capacity
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            at = (stop - total)[row] + start
            data = ids.tobytes()
            cells = [data[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            grouped = length[order]
            begins = np.searchsorted(grouped, grouped)
            nth = np.empty(len(length), dtype=np.int64)
            nth[order] = seen[grouped] + np.arange(len(grouped)) - begins
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(c) for c in cells], pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(nth), *[pa.array(cells, pa.binary())] * with_ids],
                names,
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut``, a written table of pieces, with sequence_id and offset instead of part and nth."""
    spark = cut.sparkSession
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-offsets")
    histogram = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    shared = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    ranked = cut.join(offsets.select("part", "length", "before"), ["part", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    kept = [c for c in cut.columns if c not in ("part", "nth")]
    kinds = ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shared.value.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy()) if batch.num_rows else (np.zeros(0, dtype=np.int64),) * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return ranked.select(*kept, "rank").mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, most: int = PARTS) -> DataFrame:
    """Each piece of each document with its sequence and its offset there."""
    return place(written(pieces(docs, path, capacity, end, with_ids, most), "pieces"), capacity)
