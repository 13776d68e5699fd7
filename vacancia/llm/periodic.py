"""Periodic runs of words: big-integer bit planes compared with themselves at a lag.

The words of a text are numbered; plane k holds bit k of every word's number, one lane a word. A plane XORed with
itself shifted by a lag has a one wherever the two words differ in that bit, so the OR over all planes marks the words
that differ from the one a lag later. A run of period q and ``length`` words is a stretch of ``length - q`` zeros there.
Stretches of at least that many zeros are what is left when the zeros are ANDed with themselves, shifted by 1, 2, 4, ...:
each remaining lane begins such a stretch. A lag is given up as soon as no lane is left, mostly after a few planes.

Lags below ``LAG`` are all tried. A run of a longer period repeats, a period later, each stretch of ``WINDOW`` words that
lies in all of it but its last period, and ``3 * LAG`` words always hold such a stretch that begins at a multiple of
``STEP``. So longer lags are tried if one of these stretches stands again so far behind it. Stretches inside a run of a
period of at most ``SHORT`` words need not be asked: they can't fill three periods of another run, because two runs that
share as many words as their periods together are one run (and WINDOW - STEP >= 2 * SHORT). No run is missed at any length.

A stretch whose smallest period is q is found at the lags q, 2q, ... with the same ends; lags are tried in ascending
order and the first finder's is the smallest period.

Defined cases: null and empty texts have no words and no runs. Rows are returned one for one; repeated rows get the same
values, a null doc_id stays null. Texts of any length are taken whole. Ties don't arise: a run is a place and a period.
An empty table gives an empty result. Columns beside doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import U64, mix, slices, utf8

LEAST_WORDS, LEAST_PERIODS = 6, 4  # what a run has at least
LAG, WINDOW, STEP, SHORT = 64, 96, 48, 24
FIRST_PLANES = 4
PAIRS = 1 << 20  # places compared at once


def planes(ids: np.ndarray) -> list[int]:
    """Plane k as an integer whose bit i is bit k of the i-th id."""
    bits = max(1, int(ids.max()).bit_length())
    packed = np.packbits(((ids[None, :] >> np.arange(bits)[:, None]) & 1).astype(np.uint8), axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in packed]


def _long_enough(zeros: int, need: int) -> int:
    """The lanes at which at least ``need`` lanes of ``zeros`` in a row begin."""
    have = 1
    while have < need and zeros:
        step = min(have, need - have)
        zeros &= zeros >> step
        have += step
    return zeros


def _stretches(lanes: int) -> Iterator[tuple[int, int]]:
    """First lane and number of lanes of each stretch of ones."""
    at = 0
    while lanes:
        gap = (lanes & -lanes).bit_length() - 1
        lanes >>= gap
        size = (~lanes & (lanes + 1)).bit_length() - 1
        yield at + gap, size
        lanes >>= size
        at += gap + size


def _at_lag(sliced: list[int], n: int, lag: int) -> Iterator[tuple[int, int]]:
    """Start and length of each stretch of words that has ``lag`` as a period and is as long as a run must be."""
    need = max(LEAST_WORDS, LEAST_PERIODS * lag) - lag
    every = (1 << (n - lag)) - 1
    differ = 0
    for plane in sliced[:FIRST_PLANES]:
        differ |= plane ^ (plane >> lag)
    left = _long_enough((differ & every) ^ every, need)
    if left and len(sliced) > FIRST_PLANES:
        for plane in sliced[FIRST_PLANES:]:
            differ |= plane ^ (plane >> lag)
        left = _long_enough((differ & every) ^ every, need)
    for start, size in _stretches(left):
        yield start, size - 1 + need + lag


def _window_hashes(ids: np.ndarray) -> np.ndarray:
    """A hash of the WINDOW ids from each place on."""
    one = mix(ids.astype(U64) + U64(1))
    whole, have = one, 1
    while have < WINDOW:
        step = min(have, WINDOW - have)
        whole = mix(whole[: len(whole) - step] * U64(0x9FB21C651E98DF25) + whole[step:])
        have += step
    return whole


def _longer_lags(ids: np.ndarray, short_runs: list[tuple[int, int]]) -> np.ndarray:
    """Lags from LAG on, ascending, at which some asked window stands again."""
    most = len(ids) // LEAST_PERIODS
    if most < LAG:
        return np.zeros(0, dtype=np.int64)
    hashes = _window_hashes(ids)
    asked = np.zeros(len(hashes), dtype=bool)
    asked[::STEP] = True
    for start, length in short_runs:
        asked[start : max(start, start + length - WINDOW + 1)] = False
    asked = np.flatnonzero(asked)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first, last = np.searchsorted(ranked, hashes[asked], "left"), np.searchsorted(ranked, hashes[asked], "right")
    found = np.zeros(most + 1, dtype=bool)
    several = np.flatnonzero(last - first > 1)
    part = np.cumsum((last - first)[several]) // PAIRS
    for k in np.unique(part):
        rows = several[part == k]
        size = (last - first)[rows]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1])) + np.repeat(first[rows] - (ends - size), size)
        lags = order[at] - np.repeat(asked[rows], size)
        found[lags[(lags >= LAG) & (lags <= most)]] = True
    return np.flatnonzero(found)


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(words)
    if n < LEAST_WORDS:
        return []
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    sliced = planes(ids)
    found: dict[tuple[int, int], int] = {}

    def try_lags(lags) -> None:
        for lag in lags:
            for place in _at_lag(sliced, n, lag):
                found.setdefault(place, lag)

    try_lags(range(1, min(LAG - 1, n // LEAST_PERIODS, n - LEAST_WORDS + 1) + 1))
    try_lags(_longer_lags(ids, [place for place, period in found.items() if period <= SHORT]).tolist())
    return sorted(((start, length, period) for (start, length), period in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those behind the first period of a run."""
    if not runs:
        return words
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period) and text: the words that are kept, one space apart."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes, runs, texts = [], [], []
            for text in batch.column("text").to_pylist():
                words = utf8(text).split()
                found = runs_of(words)
                sizes.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(b" ".join(collapsed(words, found)).decode("utf-8", "surrogatepass"))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")


def longest(runs: Column) -> Column:
    """The run of the greatest length, of these the first by start, then period; null without any."""
    least = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(least.isNotNull(), F.struct(least["start"].alias("start"), (-least["shorter"]).alias("length"), least["period"].alias("period")))


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document by its id's checksum h repeats some of its words to its end: words from
    a = g % n on become the words from a on by turns of 1 + (n - a) / (3 + g % 8), with g = h / 10. A null doc_id has no h."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    parts = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    parts = parts.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    parts = parts.withColumn("turn", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    a, turn, old = F.col("a"), F.col("turn"), F.col("words")
    new = F.transform(old, lambda w, i: F.when(i < a, w).otherwise(F.get(old, (a + (i - a) % turn).cast("int"))))
    return parts.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(new, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """What ``find`` returns, as counts, the longest run, and checksums of all runs and of the kept words."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), longest(F.col("runs")).alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent, "runs_sha256", "collapsed_sha256", "n_words")
