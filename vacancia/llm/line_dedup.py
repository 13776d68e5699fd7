"""Line dedup by winnowing: runs of lines that stand earlier already are removed, their first occurrence stays.

The lines of a document that aren't blank are hashed (128 bits). Of every ``run`` consecutive lines (a window) the least
hash is a fingerprint, the last of equal ones, lines of ``long_bytes`` bytes or more before others; neighbouring windows
mostly share it. Long lines are fingerprints in any case. So equal runs of ``run`` lines or more, and equal long lines,
always share a fingerprint. Only fingerprints move: each position brings the hashes of the ``run - 1`` lines before and
after it, which is as far as its windows reach.

Positions join on the fingerprint. Each is held against the fingerprint's first place (the smallest doc_id, or
earlier in the document) and the match is extended both ways, line by line; the next fingerprint of a longer run carries
on from there. A match of ``run`` lines or more is a later repeated run and goes, a shorter one only if the fingerprint is
a long line, and then that line alone. A window that differs from the lines at the first place may still stand at
another earlier place: such windows join once more, among themselves, on all their lines.

Defined cases: blank lines take no part and stay. A null text stays null and has no lines; an empty text has one
blank line. Rows with a null doc_id are returned whole and never count as earlier. Of rows that repeat a doc_id, equal
texts stand at the same place (neither repeats the other), others are ordered by a hash of the text. Texts of any
length are taken whole. An empty table gives an empty result. All columns of the input are returned, whatever their
names; n_lines and n_removed get underscores behind them where the input has such a column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import U64, behind_first, fresh, slices, utf8, with_spans, written

RUN = 3
LONG_BYTES = 40
PLACE = ["doc_id", "line", "text_hash"]


def fingerprints(hashes: np.ndarray, row: np.ndarray, long: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Places of all fingerprints, and by which windows each was picked: bit k for the one that begins k lines before."""
    picked = np.zeros(len(hashes), dtype=np.int64)
    n = len(hashes) - run + 1
    if n > 0:
        rank = (hashes >> U64(1)) | ((~long).astype(U64) << U64(63))
        pick, least = np.zeros(n, dtype=np.int64), rank[:n].copy()
        for k in range(1, run):
            better = rank[k : k + n] <= least
            pick[better], least[better] = k, rank[k : k + n][better]
        starts = np.flatnonzero(row[:n] == row[run - 1 :])
        np.bitwise_or.at(picked, starts + pick[starts], 1 << pick[starts])
    at = np.flatnonzero((picked > 0) | long)
    return at, picked[at]


def _sides(run: int) -> list[tuple[str, int]]:
    """Names of the lines around a fingerprint and how far off they are."""
    return [(f"{side}{k}", sign * k) for side, sign in (("before", -1), ("after", 1)) for k in range(1, run)]


def positions(docs: DataFrame, run: int = RUN, long_bytes: int = LONG_BYTES) -> DataFrame:
    """Every fingerprint's place: its hash in two parts, doc_id, line (among those not blank), text hash, by which windows
    it was picked, whether it is long, and the hashes of the lines around it."""
    key = docs.schema["doc_id"].dataType.simpleString()
    digest, sides = xxhash.xxh3_128_digest, _sides(run)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            texts = [utf8(t) for t in batch.column("text").to_pylist()]
            lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
            sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
            flat = [x for xs in lines for x in xs]
            if not flat:
                continue
            parts = np.frombuffer(b"".join(map(digest, flat)), dtype=">u8").astype(U64).reshape(-1, 2)
            hashes = parts[:, 1].copy()
            row = np.repeat(np.arange(len(lines)), sizes)
            long = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat)) >= long_bytes
            at, picked = fingerprints(hashes, row, long, run)
            begin = (np.cumsum(sizes) - sizes)[row[at]]
            end = begin + sizes[row[at]]
            around = []
            for _, off in sides:
                there = (at + off >= begin) & (at + off < end)
                around.append(pa.array(hashes[np.where(there, at + off, 0)].view(np.int64), mask=~there))
            text_hash = np.array([xxhash.xxh64_intdigest(t) for t in texts], dtype=U64)[row[at]]
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(c[at].view(np.int64)) for c in (hashes, parts[:, 0].copy())), batch.column("doc_id").take(pa.array(row[at])), pa.array((at - begin).astype(np.int32)),
                    pa.array(text_hash.view(np.int64)), pa.array(picked.astype(np.int32)), pa.array(long[at]), *around,
                ],
                ["low", "high", "doc_id", "line", "text_hash", "picked", "long", *(name for name, _ in sides)],
            )

    kinds = f"low long, high long, doc_id {key}, line int, text_hash long, picked int, long boolean, " + ", ".join(f"{name} long" for name, _ in sides)
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(rows, kinds)


def repeated_lines(docs: DataFrame, run: int = RUN, long_bytes: int = LONG_BYTES) -> DataFrame:
    """Spans of repeated lines: doc_id, text_hash, begin and end among the lines that aren't blank."""
    found = written(positions(docs, run, long_bytes), "line-fingerprints")
    names = tuple(name for name, _ in _sides(run))
    later = behind_first(found, ["low", "high"], PLACE, names)

    def reach(side: str):
        out = F.lit(run - 1)
        for k in range(run - 1, 0, -1):
            out = F.when(F.col(f"{side}{k}") == F.col(f"first.{side}{k}"), out).otherwise(k - 1)
        return out

    matched = later.withColumns({"left": reach("before"), "right": reach("after")})
    whole = F.col("left") + F.col("right") + 1 >= run
    matched = written(matched.withColumn("whole", whole).drop("first"), "line-matches")
    begin = F.when(F.col("whole"), F.col("line") - F.col("left")).otherwise(F.col("line")).alias("begin")
    end = (F.when(F.col("whole"), F.col("line") + F.col("right")).otherwise(F.col("line")) + 1).alias("end")
    spans = matched.where("whole or long").select("doc_id", "text_hash", begin, end)
    # Windows that picked the position but reach beyond the match: each with its other lines, in order.
    windows = []
    for k in range(run):
        others = [f"before{i}" for i in range(k, 0, -1)] + [f"after{i}" for i in range(1, run - k)]
        open_ = (F.col("picked").bitwiseAND(1 << k) != 0) & ((F.col("left") < k) | (F.col("right") < run - 1 - k))
        windows.append(F.when(open_, F.struct(F.lit(k).alias("k"), *[F.col(c).alias(f"other{i}") for i, c in enumerate(others)])))
    others = ["k", *(f"other{i}" for i in range(run - 1))]
    rest = matched.select("low", "high", *PLACE, F.explode(F.array_compact(F.array(*windows))).alias("w")).select("low", "high", *PLACE, "w.*")
    again = behind_first(written(rest, "line-windows"), ["low", "high", *others], PLACE)
    return spans.unionByName(again.select("doc_id", "text_hash", (F.col("line") - F.col("k")).alias("begin"), (F.col("line") - F.col("k") + run).alias("end")))


def without(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """``text`` without the lines of ``spans``, which count lines that aren't blank, and how many those are."""
    lines = text.split(b"\n")
    full = np.flatnonzero(np.fromiter((bool(x.strip()) for x in lines), dtype=bool, count=len(lines)))
    gone = np.zeros(len(lines), dtype=bool)
    for begin, end in spans:
        gone[full[begin:end]] = True
    return b"\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g), int(gone.sum())


def remove_repeats(docs: DataFrame, run: int = RUN, long_bytes: int = LONG_BYTES) -> DataFrame:
    """All columns of ``docs``, text without its later repeated runs, and n_lines and n_removed.

    Documents that flags of fixed size show to have no span don't move; the others are joined with their spans.
    """
    spans = written(repeated_lines(docs, run, long_bytes), "line-spans")
    name = fresh("found", docs.columns)
    joined = with_spans(docs, spans, name)
    kept = docs.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    counts = [fresh(c, docs.columns) for c in ("n_lines", "n_removed")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, n_lines, n_removed = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column(name).to_pylist(), strict=True):
                removed = 0
                n_lines.append(0 if text is None else text.count("\n") + 1)
                if found:
                    data = utf8(text)
                    mine = xxhash.xxh64_intdigest(data)
                    spans = [(s["begin"], s["end"]) for f in found if f["text_hash"] % (1 << 64) == mine for s in f["spans"]]
                    if spans:
                        data, removed = without(data, spans)
                        text = data.decode("utf-8", "surrogatepass")
                texts.append(text)
                n_removed.append(removed)
            columns = [pa.array(texts, batch.schema.field("text").type) if f.name == "text" else batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], [*(f.name for f in kept), *counts])

    return joined.mapInArrow(rows, f"{schema}, {counts[0]} long, {counts[1]} long")


ORACLE_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents
), full_lines AS (
    SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n
    FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), windows AS (
    SELECT doc_id, i, n, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY n)
), judged AS (
    SELECT doc_id, i, n, c IS NOT NULL AND row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, n) > 1 AS later,
        strlen(a) >= 40 AND row_number() OVER (PARTITION BY a ORDER BY doc_id, n) > 1 AS again FROM windows
), covered AS (
    SELECT doc_id, i, again OR later OR coalesce(lag(later, 1) OVER w, false) OR coalesce(lag(later, 2) OVER w, false) AS gone FROM judged WINDOW w AS (PARTITION BY doc_id ORDER BY n)
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.gone) AS n_removed,
    sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE NOT coalesce(c.gone, false)), '')) AS kept_sha256
FROM lines l LEFT JOIN covered c USING (doc_id, i) GROUP BY l.doc_id
"""
