"""Substring dedup by recompression: words that a smaller document already has in a window of 13 are removed.

Words get 64-bit names. Turns then rename: runs of one name become a run symbol, named by what is repeated and how
often, and pairs ``ab`` with ``a`` in one half of the alphabet and ``b`` in the other (a bit of the name decides) become
a pair symbol. Every decision looks at neighbouring symbols only, so equal substrings get equal symbols but for a few at
their ends. What a name stands for is settled globally, in two rounds of Spark:

1. Symbols are renamed until they span ``LONG`` words or more, and then stay as they are. All places of such a symbol
   meet under its name, length and a second hash of its words; all but those of the smallest document repeat it. So
   long repeats are found by a row a symbol. The same pass counts the names of short symbols.
2. Windows that no long repeat covers are filed under a run or pair symbol after one turn: the symbol's context, the
   span of words that fixes it, lies within the window, so that equal windows always meet under one name. Names that
   round 1 counted as frequent are no candidates, and a window without any other is filed under its own words. Under a
   name windows are told apart by a 56-bit hash of their own beside the 64-bit name. Of equal windows all but those of
   the smallest document are repeats; those that a batch of one task can tell already travel as spans.

The document that is smallest for a window is never covered by a long repeat there, so round 2 misses none. Name groups
are read as a sorted stream in bounded pieces; a name that spans pieces keeps its distinct windows in sorted runs, which
are merged as they double. Frequent names being excluded, a group stays below a share of an eighth of a partition's.

Defined cases: a null text has no words, as has an empty one. Rows with a null doc_id are returned whole and never count
as a smaller document. Rows that repeat a doc_id never count as smaller for each other; spans find their row by doc_id
and the text's hash. Texts of any length are taken whole. doc_id is an integer. An empty table gives an empty result.
Columns beside doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import U64, WordHashes, behind_first, mix, ranges, slices, utf8, with_spans, written

WINDOW = 13
LONG = 32
TURNS = 18
HASH_BYTES = 7
PIECE = 30_000
_LOW = U64((1 << (8 * HASH_BYTES)) - 1)
_BASE = 0x9FB21C651E98DF25


def _pair_name(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    return mix(mix(a) + b * U64(0x9E3779B97F4A7C15) + U64(turn))


def _run_name(name: np.ndarray, count: np.ndarray) -> np.ndarray:
    return mix(name * U64(0xD6E8FEB86659FD93) + count.astype(U64))


def _left_half(name: np.ndarray, turn: int) -> np.ndarray:
    return (mix(name + U64(turn)) >> U64(63)) == 0


def long_symbols(words: np.ndarray, doc: np.ndarray, long: int = LONG, turns: int = TURNS) -> tuple[np.ndarray, ...]:
    """Name, start and end of the symbols of ``long`` words or more, over documents that lie one after the other."""
    i = np.arange(len(words), dtype=np.int64)
    name, start, end, doc = words, i, i + 1, doc
    for turn in range(1, turns + 1):
        if not len(name):
            break
        done = end - start >= long
        if done.all():
            break
        same = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1]) & ~done[1:]
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        last = np.concatenate([first[1:], [len(name)]]) - 1
        count = last - first + 1
        name, start, end, doc = np.where(count > 1, _run_name(name[first], count), name[first]), start[first], end[last], doc[first]
        open_ = end - start < long
        left = _left_half(name, turn)
        joins = np.concatenate([left[:-1] & ~left[1:] & open_[:-1] & open_[1:] & (doc[1:] == doc[:-1]), [False]])
        at = np.flatnonzero(~np.concatenate([[False], joins[:-1]]))
        pair, nxt = joins[at], np.minimum(at + 1, len(name) - 1)
        name, start, end, doc = np.where(pair, _pair_name(name[at], name[nxt], turn), name[at]), start[at], np.where(pair, end[nxt], end[at]), doc[at]
    found = np.flatnonzero(end - start >= long)
    return name[found], start[found], end[found]


def span_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words of each span that doesn't depend on where it lies, independent of symbols' names."""
    one = np.ones(1, dtype=U64)
    power, inverse = (np.cumprod(np.concatenate([one, np.full(len(words), x, dtype=U64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(mix(words ^ U64(0x5BF03635)) * inverse[:-1], dtype=U64)])
    return mix((sums[end] - sums[start]) * power[end])


def short_symbols(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Name, start, end and context (from, to) of the symbols after one turn of runs and pairs."""
    i = np.arange(len(words), dtype=np.int64)
    return _pairs(*_runs(words, i, i + 1, i, i + 1, doc), 1)[:5]


def _runs(name: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Names maximal runs. A run's extent is fixed by the symbols on both sides of it."""
    new = np.concatenate([[True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(name)]]) - 1
    count = last - first + 1
    named = np.where(count > 1, _run_name(name[first], count), name[first])
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(name) - 1)
    left = np.where((first > 0) & (doc[before] == doc[first]), low[before], low[first])
    right = np.where((last < len(name) - 1) & (doc[after] == doc[last]), high[after], high[last])
    # At a document's edge nothing stands beside the run: its context reaches beyond, so that no window holds it.
    edge_left = (first == 0) | (doc[before] != doc[first])
    edge_right = (last == len(name) - 1) | (doc[after] != doc[last])
    return named, start[first], end[last], np.where(edge_left, low[first] - 1, left), np.where(edge_right, high[last] + 1, right), doc[first]


def _pairs(name: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, turn: int) -> tuple[np.ndarray, ...]:
    """Joins each symbol of the left half with a following one of the right half."""
    left = _left_half(name, turn)
    inner = doc[1:] == doc[:-1]
    joins = np.concatenate([left[:-1] & ~left[1:] & inner, [False]])
    joined = np.concatenate([[False], joins[:-1]])
    at = np.flatnonzero(~joined)
    pair = joins[at]
    nxt, prev = np.minimum(at + 1, len(name) - 1), np.maximum(at - 1, 0)
    has_next = np.concatenate([inner, [False]])[at]
    has_prev = np.concatenate([[False], inner])[at]
    named = np.where(pair, _pair_name(name[at], name[nxt], turn), name[at])
    # An unjoined left symbol depends on its right neighbour, an unjoined right symbol on its left one.
    looks_right, looks_left = left[at] | pair, ~left[at]
    new_low = np.where(looks_left, np.where(has_prev, np.minimum(low[at], low[prev]), low[at] - 1), low[at])
    new_high = np.where(looks_right, np.where(has_next, np.maximum(high[at], high[nxt]), high[at] + 1), high[at])
    new_low = np.where(pair, np.minimum(new_low, low[nxt]), new_low)
    return named, start[at], np.where(pair, end[nxt], end[at]), new_low, new_high, doc[at]


def windows(words: np.ndarray, doc: np.ndarray, width: int = WINDOW, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows within one document, the name that each is filed under, and its own hash."""
    n = len(words) - width + 1
    if n <= 0:
        none = np.zeros(0, dtype=U64)
        return np.zeros(0, dtype=np.int64), none, none
    hashed = np.zeros(n, dtype=U64)
    spread = mix(words)
    for k in range(width):
        hashed = hashed * U64(_BASE) + spread[k : k + n]
    hashed = mix(hashed)
    name, start, end, low, high = short_symbols(words, doc)
    fits = high - low <= width
    if frequent is not None and len(frequent):
        at = np.minimum(np.searchsorted(frequent, name), len(frequent) - 1)
        fits &= frequent[at] != name
    spread_name = mix(name)
    score = ((end - start > 1).astype(U64) << U64(56)) | (~spread_name >> U64(8))
    order = np.lexsort((-start, score))  # ascending; of equal symbols the first is last, and so wins
    order = order[fits[order]]
    best = np.full(n, -1, dtype=np.int64)
    rank = np.arange(len(order), dtype=np.int64)
    from_, to = np.maximum(high[order] - width, 0), np.minimum(low[order], n - 1)
    for t in range(width):
        at = from_ + t
        ok = at <= to
        candidate = np.full(n, -1, dtype=np.int64)
        candidate[at[ok]] = rank[ok]
        np.maximum(best, candidate, out=best)
    filed = np.where(best >= 0, spread_name[order[np.maximum(best, 0)]] if len(order) else U64(0), hashed ^ U64(0xA5A5A5A5A5A5A5A5))
    starts = np.flatnonzero(doc[:n] == doc[width - 1 :])
    return starts, filed[starts], (hashed & _LOW)[starts]


def _packed(hashes: np.ndarray) -> np.ndarray:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].copy()


def _unpacked(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // HASH_BYTES, 8), dtype=np.uint8)
    out[:, :HASH_BYTES] = data.reshape(-1, HASH_BYTES)
    return out.reshape(-1).view("<u8").astype(U64)


class Words:
    """The words of a batch's texts, one after the other: names, row of each, first word of each row, text hashes."""

    def __init__(self, batch: pa.RecordBatch, hashes: WordHashes):
        texts = [utf8(t) for t in batch.column("text").to_pylist()]
        split = [t.split() for t in texts]
        self.size = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        self.name = hashes.of([w for ws in split for w in ws])
        self.row = np.repeat(np.arange(len(split)), self.size)
        self.begin = np.cumsum(self.size) - self.size
        self.text_hash = np.array([xxhash.xxh32_intdigest(t) for t in texts], dtype=np.int64)
        self.doc_id = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)

    def place(self, at: np.ndarray) -> np.ndarray:
        """The text's hash and the number of the word within the text, as one number."""
        row = self.row[at]
        return (self.text_hash[row] << 32) | (at - self.begin[row])


def _spans(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch of consecutive ``at`` of one row."""
    if not len(at):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]))
    return first, np.concatenate([first[1:], [len(at)]]) - 1


def named(docs: DataFrame, partitions: int, long: int = LONG) -> DataFrame:
    """Round 1's rows: of long symbols name, check, length, doc_id and place; of short ones, with null doc_id, a name and
    how often a batch has it if that is often; and under check 1 how many a batch has in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in slices(batches, "text", 1 << 20):
            w = Words(batch, cache)
            if not len(w.name):
                continue
            name, start, end = long_symbols(w.name, w.row, long)
            short = short_symbols(w.name, w.row)[0]
            often, count = np.unique(short, return_counts=True)
            many = count >= max(16, len(short) // (8 * partitions))
            often, count = np.append(often[many], U64(0)), np.append(count[many], len(short))
            k = len(often)
            none = np.zeros(k, dtype=np.int64)
            check = none.copy()
            check[-1] = 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([name, often]).view(np.int64)), pa.array(np.concatenate([span_hashes(w.name, start, end).view(np.int64), check])), pa.array(np.concatenate([end - start, count])),
                    pa.array(np.concatenate([w.doc_id[w.row[start]], none]), mask=np.concatenate([np.zeros(len(name), dtype=bool), np.ones(k, dtype=bool)])), pa.array(np.concatenate([w.place(start), none])),
                ],
                ["name", "check", "length", "doc_id", "place"],
            )

    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(run, "name long, check long, length long, doc_id long, place long")
    return written(rows, "named-symbols")


def frequent_names(rows: DataFrame, partitions: int) -> np.ndarray:
    """Sorted names of short symbols that hold an eighth of a partition's share or more: 8 names a partition at most."""
    counts = rows.where("doc_id is null")
    total = counts.where("check = 1").agg(F.sum("length")).first()[0] or 0
    found = counts.where("check = 0").groupBy("name").agg(F.sum("length").alias("n")).where(F.col("n") >= max(total // (8 * partitions), 16))
    return np.sort(found.select("name").toPandas()["name"].to_numpy(dtype=np.int64).view(U64))


def long_repeats(rows: DataFrame) -> DataFrame:
    """Spans of long symbols that a smaller document has too: doc_id, text_hash, begin, end."""
    later = behind_first(rows.where("doc_id is not null"), ["name", "check", "length"], ["doc_id"])
    begin = F.col("place").bitwiseAND(0xFFFFFFFF)
    return later.select("doc_id", F.shiftrightunsigned("place", 32).alias("text_hash"), begin.cast("int").alias("begin"), (begin + F.col("length")).cast("int").alias("end"))


def filed_windows(docs: DataFrame, frequent: Broadcast, width: int = WINDOW) -> DataFrame:
    """Round 2's rows. ``docs``: doc_id, text and found, the spans of long repeats. Consecutive windows filed under one
    name: name, doc_id, place (text hash and first start), packed hashes. Windows that a smaller document of the batch
    has are spans already: then ``known`` is how many words they cover, and there are no hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in slices(batches, "text", 1 << 20):
            w = Words(batch, cache)
            starts, filed, hashed = windows(w.name, w.row, width, frequent.value)
            covered = np.zeros(len(w.name), dtype=bool)
            for i, found in enumerate(batch.column("found").to_pylist()):
                for f in found or ():
                    if f["text_hash"] == w.text_hash[i]:
                        for s in f["spans"]:
                            covered[w.begin[i] + s["begin"] : w.begin[i] + s["end"] - width + 1] = True
            stay = ~covered[starts]
            starts, filed, hashed = starts[stay], filed[stay], hashed[stay]
            if not len(starts):
                continue
            doc = w.doc_id[w.row[starts]]
            order = np.lexsort((doc, hashed, filed))
            f, h, d = filed[order], hashed[order], doc[order]
            new = np.concatenate([[True], (f[1:] != f[:-1]) | (h[1:] != h[:-1])])
            known = np.zeros(len(starts), dtype=bool)
            known[order] = d > d[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            told = starts[known]
            first, last = _spans(w.row[told], told)
            told_at, told_words = told[first], told[last] - told[first] + width
            starts, filed, hashed = starts[~known], filed[~known], hashed[~known]
            row = w.row[starts]
            new = np.concatenate([[True], (filed[1:] != filed[:-1]) | (starts[1:] != starts[:-1] + 1) | (row[1:] != row[:-1])])
            head = np.flatnonzero(new)
            at = np.concatenate([starts[head], told_at])
            offsets = np.concatenate([head, np.full(len(told_at) + 1, len(starts))]).astype(np.int32) * HASH_BYTES
            payload = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(_packed(hashed).tobytes())])
            name = np.concatenate([filed[head], mix(w.place(told_at).view(U64))])
            words = np.concatenate([np.zeros(len(head), dtype=np.int64), told_words])
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(w.doc_id[w.row[at]]), pa.array(w.place(at)), pa.array(words.astype(np.int32)), payload], ["name", "doc_id", "place", "known", "hashes"])

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", "found").mapInArrow(run, "name long, doc_id long, place long, known int, hashes binary")


class Seen:
    """The least document of each window hash so far, in sorted runs that are merged as they double."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def least(self, hashed: np.ndarray, doc: np.ndarray) -> np.ndarray:
        out = doc.copy()
        for known, owner in self.runs:
            at = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
            out = np.where(known[at] == hashed, np.minimum(out, owner[at]), out)
        return out

    def add(self, hashed: np.ndarray, doc: np.ndarray) -> None:
        """Sorted, distinct hashes."""
        self.runs.append((hashed, doc))
        while len(self.runs) > 1 and 2 * len(self.runs[-1][0]) > len(self.runs[-2][0]):
            (b, e), (a, d) = self.runs.pop(), self.runs.pop()
            hashed, doc = np.concatenate([a, b]), np.concatenate([d, e])
            order = np.lexsort((doc, hashed))
            new = np.concatenate([[True], hashed[order][1:] != hashed[order][:-1]])
            self.runs.append((hashed[order][new], doc[order][new]))


def repeated_spans(filed: DataFrame, width: int = WINDOW, partitions: int | None = None, piece: int = PIECE) -> DataFrame:
    """Spans of words covered by windows that a smaller document has: doc_id, text_hash, begin, end."""
    n = partitions or int(filed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = filed.repartition(n, "name").sortWithinPartitions("name", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        seen_name, seen = None, Seen()

        def out(table: pa.Table, continued: bool) -> pa.RecordBatch:
            """Judges whole name groups, and the part so far of a last one that goes on."""
            nonlocal seen_name, seen
            name, doc, place, known = (table.column(c).to_numpy() for c in ("name", "doc_id", "place", "known"))
            column = table.column("hashes").combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            count = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // HASH_BYTES
            h = _unpacked(np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8))
            g = np.repeat(np.cumsum(np.concatenate([[0], (name[1:] != name[:-1])])), count)
            d = np.repeat(doc, count)
            order = np.lexsort((d, h, g))
            new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])]) if len(order) else np.zeros(0, dtype=bool)
            least = np.empty_like(d)
            least[order] = d[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            if seen_name is not None and seen_name == name[0]:
                mine = g == 0
                least[mine] = seen.least(h[mine], least[mine])
            elif seen_name is not None:
                seen_name, seen = None, Seen()
            if continued:
                seen_name = name[-1]
                tail = order[new & (g[order] == g[-1] if len(g) else new)]
                if len(tail):
                    seen.add(h[tail], least[tail])
            row = np.repeat(np.arange(len(count)), count)
            start = (place & 0xFFFFFFFF)[row] + ranges(np.zeros(len(count)), count)
            at = np.flatnonzero(d > least)
            first, last = _spans(row[at], start[at])
            told = np.flatnonzero(known)
            owner = np.concatenate([row[at][first], told])
            begin = np.concatenate([start[at][first], (place & 0xFFFFFFFF)[told]])
            end = np.concatenate([start[at][last] + width, (place & 0xFFFFFFFF)[told] + known[told]])
            return pa.RecordBatch.from_arrays(
                [pa.array(doc[owner]), pa.array((place[owner] >> 32) & 0xFFFFFFFF), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))],
                ["doc_id", "text_hash", "begin", "end"],
            )

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < piece:
                continue
            table = pa.Table.from_batches(held)
            name = table.column("name").to_numpy()
            cuts = np.flatnonzero(name[1:] != name[:-1])
            cut = int(cuts[-1]) + 1 if len(cuts) else 0
            if cut:
                yield out(table.slice(0, cut), False)
                table = table.slice(cut)
            if table.num_rows >= piece:  # one name alone
                yield out(table, True)
                table = table.slice(table.num_rows)
            held, rows = table.to_batches(), table.num_rows
        if rows:
            yield out(pa.Table.from_batches(held), False)

    return dealt.mapInArrow(run, "doc_id long, text_hash long, begin int, end int")


def kept(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """How many words ``text`` has, how many the spans cover, and SHA-256 of the rest joined by single spaces."""
    words = text.split()
    if not spans:
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    stay = np.cumsum(edge[:-1]) == 0
    left = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
    return len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()


def remove_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row. doc_id is an integer."""
    spark, narrow = docs.sparkSession, docs.select("doc_id", "text")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = named(narrow, partitions, max(LONG, width))
    frequent = spark.sparkContext.broadcast(frequent_names(rows, partitions))
    long = written(long_repeats(rows), "long-repeats")
    short = written(repeated_spans(filed_windows(with_spans(narrow, long, "found"), frequent, width), width), "repeats")
    return _without(with_spans(narrow, long.unionByName(short), "found"), docs.schema["doc_id"].dataType.simpleString())


def _without(joined: DataFrame, key: str) -> DataFrame:
    """Removes each text's spans; the text's own hash picks among rows that repeat a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                data = utf8(text)
                mine = xxhash.xxh32_intdigest(data) if found else 0
                rows.append(kept(data, [(s["begin"], s["end"]) for f in found or () if f["text_hash"] == mine for s in f["spans"]]))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, f"doc_id {key}, n_words long, n_removed long, kept_sha256 string")
