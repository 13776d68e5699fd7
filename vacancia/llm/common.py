"""What several operators share: first places of keys, flags of ids, words and their hashes, segments of flat arrays.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``. ``bytes.split()`` splits at exactly those
bytes and ``bytes.lower()`` changes A-Z only, so both are used as they are.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.sources.shared import new_folder, written

__all__ = ["HOT", "U64", "WordHashes", "behind_first", "bit_flags", "fresh", "give_back", "join_counted", "kept", "mix", "new_folder", "ranges", "signed", "slices", "utf8", "with_spans", "written"]

U64 = np.uint64


HOT = 1000
ONE_TASK = 1 << 20


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores behind it as long as a column is called so already, whatever its case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def behind_first(rows: DataFrame, key: list[str], place: list[str], carried: tuple[str, ...] = ()) -> DataFrame:
    """Those of ``rows``, a written table, that stand behind the first place of their key, with the struct ``first``.

    First places come from an aggregation that Spark combines before it shuffles. Keys that hold a thousandth of the
    rows or more are a thousand at most: their rows are joined by broadcast and don't move. The others are shuffled.
    """
    first = rows.groupBy(*key).agg(F.min(F.struct(*place, *carried)).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = written(first, "first-places")
    hot = F.col("n") >= F.lit(max(rows.count() // HOT, 2))
    marked = rows.join(F.broadcast(first.where(hot).drop("n")), key, "left")
    rest = marked.where("first is null").drop("first").join(first.where(~hot).drop("n"), key)
    return marked.where("first is not null").unionByName(rest).where(F.struct(*place) > F.struct(*[F.col(f"first.{c}").alias(c) for c in place]))


def join_counted(rows: DataFrame, table: DataFrame, key: str, total: int, one_task: int = ONE_TASK) -> DataFrame:
    """``rows`` joined with ``table``, which has each key once and with ``n``, how many of the ``total`` rows have it.

    Keys that hold a thousandth of the rows or more are a thousand at most and joined by broadcast; their rows don't move.
    Up to ``one_task`` rows, which one task takes easily whatever their keys, this would only make the plan longer.
    """
    if total <= one_task:
        return rows.join(table.drop("n"), key)
    hot = F.col("n") >= F.lit(max(total // HOT, 2))
    mark = fresh("hot", [*rows.columns, *table.columns])
    marked = rows.join(F.broadcast(table.where(hot).drop("n").withColumn(mark, F.lit(True))), key, "left")
    rest = marked.where(F.col(mark).isNull()).select(*rows.columns).join(table.where(~hot).drop("n"), key)
    return marked.where(mark).drop(mark).unionByName(rest)


def flag_pages(rows: DataFrame, at: Column) -> DataFrame:
    """Flags set at the places that ``at`` names from 0, in pages of 32,768: page and set, a bitmap of 4096 bytes."""
    at = at.cast("long") + 1
    return rows.where(at.isNotNull()).groupBy(F.bitmap_bucket_number(at).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("set"))


def bit_flags(rows: DataFrame, at: Column, bits: int) -> np.ndarray:
    """2**bits flags, eight a byte and the lowest bit first, set at the places that ``at`` names from 0. Tasks set the
    bits; the driver gets the flags only, of one size however many rows there are."""
    flags = np.zeros(max(1, (1 << bits) >> 15) << 12, dtype=np.uint8)
    for row in flag_pages(rows, at).collect():  # 2**bits / 32,768 rows at most
        flags[(row["page"] - 1) << 12 : row["page"] << 12] = np.frombuffer(row["set"], dtype=np.uint8)
    return flags


def flag_place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(1 << bits))


def flagged(docs: DataFrame, pages: DataFrame, wanted: bool, bits: int, on: str = "doc_id") -> DataFrame:
    """Rows whose ``on`` falls on a set flag of ``pages``, as all do that set one, or the others. Nothing moves: the
    pages are broadcast, 2**bits / 8 bytes at most, and Spark reads the bit, so that no second Python worker is needed."""
    page, set_ = fresh("page", docs.columns), fresh("set", docs.columns)
    at = flag_place(F.col(on), bits) + 1
    bit = F.bitmap_bit_position(at)
    joined = docs.withColumn(page, F.bitmap_bucket_number(at)).join(F.broadcast(pages.select(F.col("page").alias(page), F.col("set").alias(set_))), page, "left")
    byte = F.conv(F.hex(F.substr(F.col(set_), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    test = F.col(on).isNotNull() & F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    return joined.where(test if wanted else ~test).select(*docs.columns)


def with_spans(docs: DataFrame, spans: DataFrame, name: str, bits: int = 26) -> DataFrame:
    """``docs`` with column ``name``: the spans (text_hash, begin, end) of its doc_id, by text hash; null without any.

    Rows that flags of fixed size show to have no span don't move; the others are joined with their spans.
    """
    by_text = spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    by_id = by_text.groupBy("doc_id").agg(F.collect_list(F.struct("text_hash", "spans")).alias(name))
    pages = written(flag_pages(spans.where("doc_id is not null"), flag_place(F.col("doc_id"), bits)), "flags")
    free = flagged(docs, pages, False, bits).withColumn(name, F.lit(None).cast(by_id.schema[name].dataType))
    return free.unionByName(flagged(docs, pages, True, bits).join(by_id, "doc_id", "left").select(*free.columns))


class WordHashes(dict):
    """XXH64 of each word. Holds at most ``most`` words, then starts anew."""

    def __init__(self, seed: int = 0, most: int = 400_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


_KEPT: dict[str, object] = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def kept(name: str, make: Callable):
    """What kernels keep in a Python worker between their tasks, until one that doesn't name it takes rows there."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def give_back(keeps: str | None = None) -> None:
    """Lets go of what is kept, but ``keeps``, and gives free memory back: Spark's workers live on between stages, beside
    an executor that needs it."""
    for name in [k for k in _KEPT if k != keeps]:
        del _KEPT[name]
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20, keeps: str | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of ``column``; a longer text is a batch of its own. Of what is kept in
    this worker only ``keeps`` stays."""
    give_back(keeps)
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
        batch = sizes = part = None
        give_back(keeps)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0]+1, ...`` for each segment in turn."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lengths), lengths)


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as Spark's long."""
    return pa.array(np.ascontiguousarray(x, dtype=U64).view(np.int64))
