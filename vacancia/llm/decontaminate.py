"""Benchmark decontamination by template canonicalisation: passages of benchmark items, re-parameterised or not.

Words lose outer punctuation and case; numbers, units and names become typed placeholders (a name is a capitalised
word, not all in capitals, that doesn't begin a sentence; names in a row are one). Windows of ``width`` such symbols with enough literal
words are templates. A window with fewer is keyed by its words as they are and, so that it is found with other values too, is
made wider until it has enough. Slots are numbered by first use within a window, and template and numbering make up the join
key, so that equal keys have slots that correspond one to one.

Benchmark and documents meet in a hash join on that key, which finds every item that has the window, at each of its
places. Before the join a bitmap of fixed size, filled from all of the benchmark's keys, drops documents' windows that
can't match; it never drops one that can. Each item is judged by its own windows, size and slots: matches of a document
on one diagonal of one item must agree on what each slot of the item became there; those that contradict earlier ones
are dropped. A document is contaminated where consistent windows of one item cover ``run`` symbols without a break, or
the whole of an item shorter than that. Items shorter than a window are one window of their own length, so that every
item with any word has a key.

Defined cases: null and empty texts hold no windows, on either side; texts of any length are taken whole. Null item_ids never match. Rows with a null
doc_id are neither reported nor removed. Rows that repeat a doc_id are judged by all their texts together and removed
together. Columns beside doc_id and text (item_id and text) are left alone, whatever their names. Without benchmark
items, or without documents, nothing is contaminated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import U64, bit_flags, mix, slices, utf8

WIDTH = 8
RUN = 12
LITERALS = 5
BITS = 24
# Words that count as units of measure or money, and words that count as numbers.
UNITS = frozenset(
    b"mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce ounces pound pounds lb lbs "
    b"ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    b"mph kmh kph dollar dollars cent cents euro euros usd eur gbp percent degree degrees celsius fahrenheit watt watts volt volts joule joules".split()
)
NUMBER_WORDS = frozenset(b"zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
LITERAL, NUMBER, UNIT, NAME = range(4)
_PLACEHOLDER = mix(np.arange(101, 105, dtype=U64))
_NUMBER = re.compile(rb"[$+-]?(?:\xe2\x82\xac|\xc2\xa3)?[0-9][0-9.,:/^*]*(?:%|st|nd|rd|th)?").fullmatch
_OUTER = b" !\"#&'()*,-./:;<=>?@[\\]^_`{|}~"


class Lexicon:
    """What each raw word is, kept for at most ``most`` words."""

    def __init__(self, most: int = 500_000):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.columns = [np.zeros(1 << 12, dtype=d) for d in (U64, np.int8, bool, bool)]  # hash, kind, capital, ends a sentence

    def of(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """Hash (0: nothing but punctuation), kind, capital and sentence end of each word."""
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > self.most and self.known:
            self._clear()
            new = set(words)
        for w in new:
            k = len(self.known)
            if k == len(self.columns[0]):
                self.columns = [np.concatenate([c, np.zeros_like(c)]) for c in self.columns]
            bare = w.strip(_OUTER)
            low = bare.lower()
            kind = NUMBER if _NUMBER(bare) or low in NUMBER_WORDS else UNIT if low in UNITS else LITERAL
            capital = len(bare) > 1 and not bare.isupper() and (bare[:1].isupper() or (bare[:1] == b"\xc3" and 0x80 <= bare[1] <= 0x9E))
            self.known[w] = k
            for c, value in zip(self.columns, (max(xxhash.xxh64_intdigest(low), 1) if bare else 0, kind, capital, w.rstrip(b"\"')]}")[-1:] in (b".", b"!", b"?", b":", b"|")), strict=True):
                c[k] = value
        at = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        return tuple(c[at] for c in self.columns)


@dataclass
class Symbols:
    """Canonical symbols of texts that lie one after the other: code, kind, the word's own hash and the text's row."""

    code: np.ndarray
    kind: np.ndarray
    value: np.ndarray
    row: np.ndarray


def canonical(texts: list[bytes], lexicon: Lexicon) -> Symbols:
    words = [t.split() for t in texts]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    row = np.repeat(np.arange(len(words)), sizes)
    value, kind, capital, ends = lexicon.of([w for ws in words for w in ws])
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, dtype=bool)
    starts = first | np.concatenate([[True], ends[:-1]]) if len(row) else first
    kind = np.where((kind == LITERAL) & capital & ~starts, NAME, kind).astype(np.int64)
    kept = value != 0
    value, kind, row, starts = value[kept], kind[kept], row[kept], starts[kept]
    if len(row):
        again = (kind == NAME) & np.concatenate([[False], (kind[:-1] == NAME) & (row[1:] == row[:-1])])
        value, kind, row = value[~again], kind[~again], row[~again]
    return Symbols(np.where(kind == LITERAL, mix(value), _PLACEHOLDER[kind]), kind, value, row)


def templates(s: Symbols, width: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows within one text that have enough literal words, and their templates' hashes."""
    n = len(s.code) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    h, many = np.zeros(n, dtype=U64), np.zeros(n, dtype=np.int64)
    for k in range(width):
        h = h * U64(0x9FB21C651E98DF25) + s.code[k : k + n]
        many += s.kind[k : k + n] == LITERAL
    starts = np.flatnonzero((s.row[:n] == s.row[width - 1 :]) & (many >= min(literals, width)))
    return starts, mix(h[starts] + U64(width))


def windows(s: Symbols, width: int, literals: int, wider: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, hashes and widths of the windows at every place of a text: templates where ``width`` symbols hold enough
    literal words, else the words themselves, and a template as wide as it takes where the text has enough of them."""
    starts, hashes = templates(s, width, literals)
    n = len(s.code) - width + 1
    if n <= 0:
        return starts, hashes, np.zeros(0, dtype=np.int64)
    rest = s.row[:n] == s.row[width - 1 :]
    rest[starts] = False
    poor = np.flatnonzero(rest)
    exact, words = np.zeros(len(poor), dtype=U64), mix(s.value + s.kind.astype(U64))
    for k in range(width):
        exact = exact * U64(0x9FB21C651E98DF25) + words[poor + k]
    found = [(starts, hashes, np.full(len(starts), width)), (poor, mix(exact + U64(1 << 32) + U64(width)), np.full(len(poor), width))]
    if wider and len(poor):
        places = np.flatnonzero(s.kind == LITERAL)
        last = np.searchsorted(places, poor) + literals - 1
        poor, last = poor[last < len(places)], places[last[last < len(places)]]
        poor, last = poor[s.row[poor] == s.row[last]], last[s.row[poor] == s.row[last]]
        # The same polynomial as in templates(), from sums of codes over powers of the (odd) base.
        base, one = 0x9FB21C651E98DF25, np.ones(1, dtype=U64)
        power, inverse = (np.cumprod(np.concatenate([one, np.full(len(s.code), x, dtype=U64)])) for x in (base, pow(base, -1, 1 << 64)))
        sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(s.code * inverse[:-1], dtype=U64)])
        size = last - poor + 1
        found.append((poor, mix((sums[last + 1] - sums[poor]) * power[last] + size.astype(U64)), size))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def keyed(s: Symbols, starts: np.ndarray, hashes: np.ndarray, width: int | np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """Join keys (template and numbering of the slots), and each window's slot values."""
    keys, slots = hashes.copy(), []
    for i, (a, w) in enumerate(zip(starts.tolist(), np.broadcast_to(width, len(starts)).tolist(), strict=True)):
        at = np.flatnonzero(s.kind[a : a + w]) + a
        values = s.value[at].view(np.int64).tolist()
        slots.append(values)
        if values:
            seen: dict[tuple[int, int], int] = {}
            numbering = [seen.setdefault((k, v), len(seen)) for k, v in zip(s.kind[at].tolist(), values, strict=True)]
            keys[i] = mix(keys[i : i + 1] + U64(xxhash.xxh64_intdigest(bytes(x % 256 for x in numbering) if len(seen) < 256 else str(numbering))))[0]
    return keys, slots


WINDOWS = "template long, key long, place int, slots array<long>"


def _batch(name: str, ids: pa.Array, s: Symbols, width: np.ndarray, starts: np.ndarray, hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    keys, slots = keyed(s, starts, hashes, width)
    rows = s.row[starts]
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(rows)), pa.array(hashes.view(np.int64)), pa.array(keys.view(np.int64)), pa.array((starts - begin[rows]).astype(np.int32)), pa.array(slots, pa.list_(pa.int64())), pa.array(width.astype(np.int32)), pa.array(size[rows].astype(np.int32))],
        [name, "template", "key", "place", "slots", "width", "size"],
    )


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH, literals: int = LITERALS) -> DataFrame:
    """Every template window of every item; an item shorter than ``width`` is one window."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for batch in slices(batches, "text", 1 << 20):
            s = canonical([utf8(t) for t in batch.column("text").to_pylist()], lexicon)
            size = np.bincount(s.row, minlength=batch.num_rows)
            begin = np.cumsum(size) - size
            for w in range(1, width + 1):
                starts, hashes, wide = windows(s, w, literals, w == width)
                chosen = np.ones(len(starts), dtype=bool) if w == width else size[s.row[starts]] == w
                if chosen.any():
                    yield _batch("item_id", batch.column("item_id"), s, wide[chosen], starts[chosen], hashes[chosen], begin, size)

    return benchmark.where("item_id is not null").select("item_id", "text").mapInArrow(run, f"item_id {kind}, {WINDOWS}, width int, size int")


def bitmap(windows: DataFrame, bits: int = BITS) -> np.ndarray:
    """2**bits flags, set for the leading bits of every template: of one size, whatever the benchmark's."""
    return bit_flags(windows.select("template"), F.shiftrightunsigned("template", 64 - bits), bits)


def document_windows(docs: DataFrame, flags: np.ndarray, widths: list[int], literals: int = LITERALS, bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """Documents' windows whose template may be one of the benchmark's."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, flags = Lexicon(), shared.value
        for batch in slices(batches, "text", 1 << 19):
            s = canonical([utf8(t) for t in batch.column("text").to_pylist()], lexicon)
            size = np.bincount(s.row, minlength=batch.num_rows)
            begin = np.cumsum(size) - size
            for w in widths:
                starts, hashes, wide = windows(s, w, literals, w == width)
                bit = (hashes >> U64(64 - bits)).astype(np.int64)
                chosen = (flags[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 != 0
                if chosen.any():
                    yield _batch("doc_id", batch.column("doc_id"), s, wide[chosen], starts[chosen], hashes[chosen], begin, size)

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {WINDOWS}, width int, size int")


def judged(pairs: list[dict], run: int) -> list[tuple]:
    """item_id, windows, covered symbols and whether re-parameterised, of each item that a document holds a run of."""
    diagonals: dict[tuple, list[dict]] = {}
    for p in sorted(pairs, key=lambda p: (p["place"], p["width"])):
        diagonals.setdefault((p["item_id"], p["place"] - p["item_place"]), []).append(p)
    good = []
    for (item, _), found in diagonals.items():
        became: dict[int, int] = {}
        for p in found:
            slots = list(zip(p["item_slots"], p["slots"], strict=True))
            if all(became.get(a, b) == b for a, b in slots):
                became.update(slots)
                good.append((p["place"], p["place"] + p["width"], item, p["size"], any(a != b for a, b in slots)))
    out: dict = {}
    good.sort(key=lambda g: (g[2], *g[:2]))
    i = 0
    while i < len(good):
        begin, end, item, size, changed = good[i]
        j = i + 1
        while j < len(good) and good[j][2] == item and good[j][0] <= end:
            end, changed, j = max(end, good[j][1]), changed or good[j][4], j + 1
        if end - begin >= min(run, size):
            windows, most, any_changed = out.get(item, (0, 0, False))
            out[item] = windows + j - i, max(most, end - begin), any_changed or changed
        i = j
    return [(item, *x) for item, x in sorted(out.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, run: int = RUN, literals: int = LITERALS, bits: int = BITS) -> DataFrame:
    """doc_id, item_id, n_windows, n_symbols and reparameterised of each benchmark item that a document holds a run of."""
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    items = benchmark_windows(benchmark, width, literals)
    widths = sorted(r["width"] for r in items.select(F.least("width", F.lit(width)).alias("width")).distinct().collect())  # ``width`` values at most
    every = items.select("key", "width", "item_id", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"), "size").distinct()
    found = document_windows(docs, bitmap(items, bits), widths, literals, bits, width).drop("size", "template").join(every, ["key", "width"])
    names = ["doc_id", "item_id", "n_windows", "n_symbols", "reparameterised"]

    def judge(group: pa.Table) -> pa.Table:
        ids = group.column("doc_id")
        rows = judged(group.drop_columns(["doc_id", "key"]).to_pylist(), run)
        columns = list(zip(*rows, strict=True)) or [()] * 4
        types = (group.schema.field("item_id").type, pa.int64(), pa.int64(), pa.bool_())
        return pa.table([ids.take(pa.array([0] * len(rows), pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return found.groupBy("doc_id", "item_id").applyInArrow(judge, f"doc_id {doc_kind}, item_id {item_kind}, n_windows long, n_symbols long, reparameterised boolean")
