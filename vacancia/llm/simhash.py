"""SimHash near-duplicates: fingerprints, bit-sliced comparison within blocks, components over shared tables.

Fingerprints that differ in at most two bits agree in six of eight bytes, whichever they are, so each distinct
fingerprint enters 28 tables by the 48 bits that a table compares; no pair can be missed. Within a block (one key
of one table) at most 65,536 distinct fingerprints are possible, however the data are skewed. Blocks lie one after
the other as bit planes: plane k holds bit k of every fingerprint of many blocks, one lane each. Comparing lane i
with lane i + d for all lanes at once is an exclusive-or of each plane with itself shifted by d; a carry-save
counter adds the differing planes up, and the rest of the planes is skipped once every lane exceeds the radius.
Each block yields one link a member at most (to the smallest fingerprint that it reaches within the block), never
all its pairs. Components come from star contraction, within parts and then over all links, each round written to the shared folder.

Defined cases: null and empty texts have fingerprint zero and are linked like any other. Rows are returned one for
one; a repeated row gets the same values. A null doc_id takes part, but a component is named by the smallest doc_id
that isn't null (null if none is). Ties don't arise: a component is named by its least id. Texts of any length are
taken whole. An empty table gives an empty result. Columns beside doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import ONE_TASK, U64, join_counted, slices, utf8, written

TABLES = tuple(itertools.combinations(range(8), 2))  # the two bytes that a table leaves out
ROUNDS = 60


def fingerprint(text: bytes) -> int:
    return int(fingerprints([text])[0])


def fingerprints(texts: list[bytes], width: int = 3) -> np.ndarray:
    """SimHash of each text: XXH64 (seed 42) of its shingles; a bit is 1 if set in over half of them."""
    out = np.zeros(len(texts), dtype=U64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        if len(words) <= width:
            h = [digest(b" ".join(words), 42)]
        else:
            flat = b" ".join(words)
            size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            starts = np.cumsum(size + 1) - size - 1
            ends = (starts + size)[width - 1 :].tolist()
            h = [digest(flat[a:b], 42) for a, b in zip(starts.tolist(), ends, strict=False)]
        bits = np.zeros(64, dtype=np.int64)
        values = np.array(h, dtype=">u8").view(np.uint8).reshape(-1, 8)
        for a in range(0, len(values), 4096):
            bits += np.unpackbits(values[a : a + 4096], axis=1).sum(0, dtype=np.int64)
        out[i] = int.from_bytes(np.packbits(2 * bits > len(values)).tobytes(), "big")
    return out


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (as a long) of each row; one narrow pass over whole texts."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = fingerprints([utf8(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, fingerprint long")


def keep_bits(value: F.Column, dropped: tuple[int, int]) -> F.Column:
    """``value`` without two of its bytes."""
    mask = (1 << 64) - 1
    for byte in dropped:
        mask &= ~(0xFF << (8 * byte))
    return value.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _planes(values: np.ndarray) -> list[int]:
    """Bit planes of ``values`` that aren't constant, each as one integer whose bit i belongs to lane i."""
    varies = int(np.bitwise_or.reduce(values ^ values[0])) if len(values) else 0
    planes = []
    for k in range(64):
        if varies >> k & 1:
            lane = ((values >> U64(k)) & U64(1)).astype(np.uint8)
            planes.append(int.from_bytes(np.packbits(lane, bitorder="little").tobytes(), "little"))
    return planes


def _lanes(x: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes(n // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[:n])


def close_lanes(values: np.ndarray, block: np.ndarray, radius: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of lanes of one block that differ in at most ``radius`` (up to 3) bits. Lanes are sorted by block."""
    n = len(values)
    planes = _planes(values)
    size = np.bincount(block)
    a, b = [], []
    for d in range(1, int(size.max(initial=1))):
        same = np.zeros(n, dtype=np.uint8)
        same[: n - d] = block[d:] == block[: n - d]
        active = int.from_bytes(np.packbits(same, bitorder="little").tobytes(), "little")
        ones = twos = over = 0
        alive = active
        for plane in planes:
            differs = (plane ^ (plane >> d)) & alive
            carry = ones & differs
            ones ^= differs
            over |= twos & carry
            twos ^= carry
            exceeded = over | (twos if radius < 2 else twos & ones if radius < 3 else 0) | (ones if radius < 1 else 0)
            alive = active & ~exceeded
            if not alive:
                break
        if alive:
            i = _lanes(alive, n)
            a.append(i)
            b.append(i + d)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _smallest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n lanes the first lane that it reaches over the links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def links(fingerprints_: DataFrame, partitions: int | None = None) -> DataFrame:
    """Links src < dst between distinct fingerprints; as many as connect what the radius connects."""
    spark = fingerprints_.sparkSession
    entries = F.array(*[F.struct(F.lit(t).cast("int").alias("t"), keep_bits(F.col("fingerprint"), drop).alias("key")) for t, drop in enumerate(TABLES)])
    exploded = fingerprints_.select("fingerprint", F.explode(entries).alias("e")).select("e.t", "e.key", "fingerprint")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = exploded.repartition(n, "key", "t").sortWithinPartitions("key", "t", "fingerprint")

    def of(values: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        src, dst = [], []
        size = np.bincount(block)
        for small in (True, False):
            chosen = np.flatnonzero((size > 1) & ((size <= 16) == small))
            groups = [np.isin(block, chosen)] if small else [block == k for k in chosen]
            for mask in groups:
                v = values[mask]
                if not len(v):
                    continue
                a, b = close_lanes(v, np.unique(block[mask], return_inverse=True)[1])
                first = _smallest_reached(len(v), a, b)
                at = np.flatnonzero(first != np.arange(len(v)))
                src.append(v[first[at]])
                dst.append(v[at])
        none = np.zeros(0, dtype=U64)
        return (np.concatenate(src), np.concatenate(dst)) if src else (none, none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 3), dtype=np.int64)  # a block that the next batch may continue: 65,536 rows at most

        def out(rows: np.ndarray) -> pa.RecordBatch:
            new = np.any(np.diff(rows[:, :2], axis=0, prepend=rows[:1, :2]) != 0, axis=1)
            src, dst = of(rows[:, 2].copy().view(U64), np.cumsum(new))
            return pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], ["src", "dst"])

        for batch in batches:
            got = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("t", "key", "fingerprint")], axis=1)
            rows = np.concatenate([rest, got])
            if not len(rows):
                continue
            new = np.flatnonzero(np.any(np.diff(rows[:, :2], axis=0) != 0, axis=1))
            cut = int(new[-1]) + 1 if len(new) else 0
            rest = rows[cut:]
            if cut:
                yield out(rows[:cut])
        if len(rest):
            yield out(rest)

    return dealt.mapInArrow(run, "src long, dst long").distinct()


def contracted(links_: DataFrame, most: int = ONE_TASK) -> DataFrame:
    """Links u, v within each partition, ``most`` at a time, as a star around each component's smallest node."""
    kind = links_.schema["u"].dataType.simpleString()

    def star(rows: pa.Table) -> pa.RecordBatch:
        ends = pa.chunked_array([*rows.column("u").chunks, *rows.column("v").chunks]).combine_chunks().dictionary_encode()
        order = pc.array_sort_indices(ends.dictionary).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        ends = rank[ends.indices.to_numpy()], ends.dictionary.take(pa.array(order))
        root = _smallest_reached(len(order), ends[0][: len(rows)], ends[0][len(rows) :])
        at = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([ends[1].take(pa.array(at)), ends[1].take(pa.array(root[at]))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= most:
                yield star(pa.Table.from_batches(held))
                held = []
        if sum(b.num_rows for b in held):
            yield star(pa.Table.from_batches(held))

    return links_.mapInArrow(run, f"u {kind}, v {kind}")


def components(edges: DataFrame, rounds: int = ROUNDS, most: int = ONE_TASK) -> DataFrame:
    """node and root (its component's smallest node) of every node that has a link, by star contraction.

    Links that one task takes (``most``) are contracted by it. More of them are first contracted in parts of that size;
    then a large-star round links each node's larger neighbours to the smallest node around it, a small-star round its
    smaller ones. Both keep components, and what stays unchanged is a star around each root.
    """
    current = written(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(), "links")
    named = lambda links_: links_.select(F.col("u").alias("node"), F.col("v").alias("root"))
    total = current.count()
    if not total:
        return named(current)
    if total <= most:
        return named(written(contracted(current.coalesce(1), most + 1), "components"))
    current = written(contracted(current.repartition(-(-total // most), "v"), most), "links")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(current)
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")).select("u", F.least("u", "low").alias("low"), "n")
        large = join_counted(both, low, "u", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n"))
        small = join_counted(large, low, "u", before[0])
        small = small.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v"))).distinct()
        current = written(small, "links")
        after = mark(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return named(current)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = written(with_fingerprints(docs), "fingerprints")
    classes = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "fingerprint-classes")
    found = components(links(classes.select("fingerprint")))
    named = classes.join(found, classes.fingerprint == found.node, "left").select(F.coalesce("root", "fingerprint").alias("root"), "fingerprint", "first", F.col("n").alias("rows"))
    named = written(named, "named-classes")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    table = join_counted(named, least, "root", named.count()).select("fingerprint", "component_id", F.col("rows").alias("n"))
    return join_counted(prints, table, "fingerprint", prints.count()).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
