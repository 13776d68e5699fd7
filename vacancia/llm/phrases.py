"""Phrases of words that stand together more often than apart, by contiguous pattern growth.

Texts are cut at punctuation and line ends into pieces, pieces into words. Frequent patterns grow from prefixes: the
words that are frequent are counted first, then the pairs of such words, and each frequent pair is the prefix of a task's
work. Its projection is the list of what stands behind it, wherever it occurs, sorted; an occurrence is a row in it, and
the occurrences of a longer prefix are a range of these rows. So a prefix is extended by a word at a time, depth first,
by cutting its range where the next word changes and leaving out ranges with too few occurrences. Nothing that is not
frequent is extended, since no phrase is more frequent than a part of it.

Counts are exact. Each map task counts equal windows of words before they move. Flags of fixed size tell which words and
pairs may be frequent; they only leave out what can't be. A pair that holds a thousandth of all pairs or more (a thousand
at most do) is dealt by whole windows instead, and its extensions' counts are added up afterwards. Words travel as 64-bit
hashes of language and word; all words are looked through for two of one hash, and if there are any, hashes are salted anew.

A phrase is cut in two where that makes its score least: ``SCALE * a // (l + r)`` with its own count a and those of
both parts. A phrase goes if a longer one around it has ``COVERED`` of its count or more. Sums and products are decimals,
exact beyond 64 bits.

Defined cases: null and empty texts have no words; a null lang is ``und``; doc_id doesn't matter, repeated rows count
each time they stand; texts of any length are taken whole. Ties in rank are settled by count, then by the phrase's bytes.
An empty table gives an empty result. Columns beside lang and text are left out, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import HOT, U64, WordHashes, bit_flags, join_counted, mix, slices, utf8, written
from vacancia.operators.numbering import numbered

LEAST, LONGEST, TOP = 30, 4, 2000
SCALE, COVERED = 2_000_000, (80, 100)
FLAG_BITS = 26
WORDS_HELD, PLACES_HELD, ROWS_HELD = 200_000, 1 << 20, 1 << 20  # what a task holds at once
LANGS_HELD = 32

#: Bytes between pieces, and between words.
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
_IDS = ["w1", "w2", "w3", "w4"]


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case; a line end after each piece."""
    plain = text.lower().translate(_BREAKS).replace(b"\n", b" \n ")
    return [*filter(None, plain.split(b" ")), b"\n"]


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word and its count n, of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            rows = [(lang, word, n) for lang, found in held.items() for word, n in found.items() if word != b"\n"]
            held.clear()
            langs, words, n = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([w.decode("utf-8", "surrogatepass") for w in words], pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

        for batch in slices(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held[lang].update(tokens(utf8(text)))
            if sum(map(len, held.values())) > WORDS_HELD:
                yield out()
        yield out()

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(0x9FB21C651E98DF25) + b)


def _set_in(flags: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & U64((1 << FLAG_BITS) - 1)
    return (flags[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1


def _flag_of(key: Column) -> Column:
    return key.bitwiseAND((1 << FLAG_BITS) - 1)


def _word_rows(batches: Iterator[pa.RecordBatch], salt: str, frequent: np.ndarray) -> Iterator[np.ndarray]:
    """The ids of the words of many texts one after the other, 0 for a piece's end and for words without a flag; four 0 last."""
    hashes: dict[str, WordHashes] = {}
    held, places = [], 0
    for batch in slices(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if lang not in hashes:
                if len(hashes) >= LANGS_HELD:
                    hashes.clear()
                hashes[lang] = WordHashes(xxhash.xxh64_intdigest(utf8(lang + salt), 42), WORDS_HELD)
            hashes[lang][b"\n"] = 0
            held.append(hashes[lang].of(tokens(utf8(text))))
            places += len(held[-1])
            if places >= PLACES_HELD:
                yield _cleared(held, frequent)
                held, places = [], 0
    if held:
        yield _cleared(held, frequent)


def _cleared(held: list[np.ndarray], frequent: np.ndarray) -> np.ndarray:
    ids = np.concatenate([*held, np.zeros(LONGEST, dtype=U64)])
    ids[~_set_in(frequent, ids)] = 0
    return ids


def pair_counts(docs: DataFrame, salt: str, frequent: np.ndarray) -> DataFrame:
    """key, a hash of two words that stand together, and its count n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in _word_rows(batches, salt, frequent):
            both = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
            keys, n = np.unique(_pair(ids[both], ids[both + 1]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

    return docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def windows(docs: DataFrame, salt: str, frequent: np.ndarray, pairs: np.ndarray, hot: np.ndarray) -> DataFrame:
    """w1 to w4: a pair that may be frequent and what follows it as far as its pairs may be, else 0; their count n in a part
    of the input; and whether the first pair is one of ``hot``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in _word_rows(batches, salt, frequent):
            both = (ids[:-1] != 0) & (ids[1:] != 0)
            at = np.flatnonzero(both)
            keys = _pair(ids[at], ids[at + 1])
            both[at] = _set_in(pairs, keys)
            keys, at = keys[both[at]], np.flatnonzero(both)
            rows, further = [ids[at], ids[at + 1]], np.ones(len(at), dtype=bool)
            for k in range(1, LONGEST - 1):
                further &= both[np.minimum(at + k, len(both) - 1)]
                rows.append(np.where(further, ids[np.minimum(at + k + 1, len(ids) - 1)], U64(0)))
            whole = _pair(_pair(keys, rows[2]), rows[3])
            order = np.argsort(whole, kind="stable")
            rows = [r[order] for r in rows]
            new = np.ones(len(order), dtype=bool)
            new[1:] = np.any([r[1:] != r[:-1] for r in rows], axis=0)
            first = np.flatnonzero(new)
            n = np.diff(first, append=len(order))
            columns = [pa.array(r[first].view(np.int64)) for r in rows]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(np.isin(keys[order][first], hot))], [*_IDS, "n", "hot"])

    return docs.mapInArrow(run, "w1 long, w2 long, w3 long, w4 long, n long, hot boolean")


def _cuts(changed: np.ndarray, a: int, b: int) -> np.ndarray:
    """The first row of each range of a..b whose rows don't change."""
    return np.concatenate([[a], np.flatnonzero(changed[a + 1 : b]) + a + 1]) if b > a else np.zeros(0, dtype=np.int64)


def grown(rows: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted ``rows`` of ids: a row, size and count of each prefix of two words or more that has ``least`` occurrences."""
    changed = np.ones(rows.shape, dtype=bool)
    changed[1:] = rows[1:] != rows[:-1]
    total = np.concatenate([[0], np.cumsum(n)])
    found: list[tuple[np.ndarray, int, np.ndarray]] = []

    def extend(a: int, b: int, size: int, by: np.ndarray) -> None:
        starts = _cuts(by, a, b)
        ends = np.append(starts[1:], b)
        counts = total[ends] - total[starts]
        kept = (counts >= least) & (rows[starts, size - 1] != 0)
        if not kept.any():
            return
        found.append((starts[kept], size, counts[kept]))
        if size < LONGEST:
            for s, e in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True):
                extend(s, e, size + 1, changed[:, size])

    extend(0, len(rows), 2, changed[:, 0] | changed[:, 1])
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    return np.concatenate([f[0] for f in found]), np.repeat([f[1] for f in found], [len(f[0]) for f in found]), np.concatenate([f[2] for f in found])


def frequent_phrases(found: DataFrame, least: int, partitions: int) -> DataFrame:
    """w1 to w4 (0 behind the phrase's end), size and count n of each phrase of two words or more with ``least`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(rows: np.ndarray, whole: bool) -> pa.RecordBatch:
            at, size, n = [], [], []
            for hot in (0, 1):
                mine = np.flatnonzero(rows[:, 5] == hot)
                got = grown(rows[mine, :4], rows[mine, 4], least if whole and not hot else 1)
                at.append(mine[got[0]])
                size.append(got[1])
                n.append(got[2])
            at, size, n = (np.concatenate(x) for x in (at, size, n))
            ids = np.where(np.arange(LONGEST)[None, :] < size[:, None], rows[at, :4], 0)
            return pa.RecordBatch.from_arrays([*[pa.array(ids[:, k]) for k in range(LONGEST)], pa.array(size, pa.int32()), pa.array(n, pa.int64())], [*_IDS, "size", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(c).cast(pa.int64()).to_numpy() for c in (*_IDS, "n", "hot")], axis=1))
            if sum(map(len, held)) < ROWS_HELD // 4:
                continue
            rows = np.concatenate(held)
            new = np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1]))
            cut = int(new[-1]) + 1 if len(new) else 0
            if not cut and len(rows) >= ROWS_HELD:  # a prefix with more rows than a task holds is counted in parts
                yield out(rows, False)
                held = []
                continue
            if cut:
                yield out(rows[:cut], True)
            held = [rows[cut:]]
        if held and len(rows := np.concatenate(held)):
            # The last prefix may have gone out in part before: its extensions are counted whatever their number.
            first = np.flatnonzero((rows[:, 0] == rows[0, 0]) & (rows[:, 1] == rows[0, 1]))
            cut = int(first[-1]) + 1
            yield out(rows[:cut], False)
            if cut < len(rows):
                yield out(rows[cut:], True)

    dealt = found.repartition(partitions, F.when(F.col("hot"), F.xxhash64(*_IDS)).otherwise(F.xxhash64("w1", "w2"))).sortWithinPartitions(*_IDS)
    parts = dealt.mapInArrow(run, "w1 long, w2 long, w3 long, w4 long, size int, n long")
    return parts.groupBy(*_IDS, "size").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows``, a written table, joined with ``table``, which has each key once; keys of many rows by broadcast."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n"))
    return join_counted(rows, table.join(counted, key), key, rows.count(), 0)


def _part(first: int, last: Column | int) -> Column:
    """The words of a phrase from place ``first`` to before ``last``, as an array of four ids."""
    return F.array(*[F.when(F.lit(k) < last, F.col(_IDS[first + k])).otherwise(0) if first + k < LONGEST else F.lit(0).cast("long") for k in range(LONGEST)])


def with_ids(words: DataFrame, salt: str) -> DataFrame:
    return words.select(F.xxhash64(F.concat("lang", F.lit(salt)), "word").alias("id"), "lang", "word", "n")


def clash(named: DataFrame) -> bool:
    """Whether two words have one id, or one has that of a piece's end."""
    return not named.groupBy("id").count().where("count > 1 or id = 0").isEmpty()


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n and score of each language's ``top`` phrases."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = written(word_counts(texts), "word-counts")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    salt = ""
    while clash(named := with_ids(words, salt)):
        salt += "+"
    named = written(named.where(F.col("n") >= least), "frequent-words")
    frequent = bit_flags(named, _flag_of(F.col("id")), FLAG_BITS)
    pairs = pair_counts(texts, salt, frequent)
    # What isn't frequent only counts for the total; frequent pairs alone are kept.
    kept = written(pairs.where(F.col("n") >= least), "frequent-pairs")
    flags = bit_flags(kept, _flag_of(F.col("key")), FLAG_BITS)
    total = kept.agg(F.sum("n")).first()[0] or 0
    hot = np.array([r.key for r in kept.where(F.col("n") >= max(total // HOT, least)).select("key").collect()], dtype=np.int64).view(U64)
    found = written(frequent_phrases(windows(texts, salt, frequent, flags, hot), least, partitions), "frequent-phrases")

    ids = F.array(*_IDS)
    singles = named.select(F.array(F.col("id"), *[F.lit(0).cast("long")] * (LONGEST - 1)).alias("part"), F.col("n").alias("count"))
    counts = singles.unionByName(found.select(ids.alias("part"), F.col("n").alias("count")))
    cuts = F.array(*[F.struct(F.lit(k).alias("k"), _part(0, k).alias("left"), _part(k, F.col("size") - k).alias("right")) for k in range(1, LONGEST)])
    cut = found.select(ids.alias("ids"), "size", F.col("n").alias("a"), F.explode(F.filter(cuts, lambda c: c["k"] < F.col("size"))).alias("c"))
    parts = cut.select("ids", "size", "a", "c.k", F.explode(F.array(F.struct(F.lit(True).alias("is_left"), F.col("c.left").alias("part")), F.struct(F.lit(False).alias("is_left"), F.col("c.right").alias("part")))).alias("p"))
    parts = written(parts.select("ids", "size", "a", "k", "p.is_left", "p.part"), "phrase-parts")
    of_cut = _looked_up(parts, counts, "part").groupBy("ids", "size", "a", "k").agg(F.max(F.when(F.col("is_left"), F.col("count"))).alias("l"), F.max(F.when(~F.col("is_left"), F.col("count"))).alias("r"))
    exact = F.expr(f"(cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = of_cut.withColumn("score", exact).groupBy("ids", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    above, below = COVERED
    inner = [(a, b) for a in range(LONGEST) for b in range(a + 2, LONGEST + 1) if b - a < LONGEST]
    inside = F.filter(F.array(*[F.struct(F.lit(b - a).alias("size"), F.lit(b).alias("to"), _part(a, b - a).alias("ids")) for a, b in inner]), lambda s: (s["to"] <= F.col("size")) & (s["size"] < F.col("size")))
    around = found.where("size > 2").select("n", F.explode(inside).alias("s")).groupBy(F.col("s.ids").alias("ids")).agg(F.max("n").alias("longer"))
    left = scored.join(around, "ids", "left").where(F.expr(f"longer is null or cast({below} as decimal(10,0)) * longer < cast({above} as decimal(10,0)) * a"))
    left = written(left.select("ids", "size", "a", "best"), "kept-phrases")

    spelt = written(left.select("ids", F.posexplode(F.expr("slice(ids, 1, size)")).alias("place", "id")), "phrase-words")
    spelt = _looked_up(spelt, named.select("id", "lang", "word"), "id").groupBy("ids").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("place", "word"))).alias("words"))  # four words at most
    phrases = left.join(spelt, "ids").select("lang", F.array_join("words.word", " ").alias("phrase"), "a", "best.l", "best.r", "best.score")
    ranked = numbered(phrases, [F.desc("score"), F.desc("a"), "phrase"], "rank", ["lang"]).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded WHERE len(w) > 0),
grams AS (
  SELECT lang, m, w[i:i + m - 1] AS words FROM placed, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(w)),
counted AS (SELECT lang, m, array_to_string(words, ' ') AS phrase, any_value(words) AS words, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, cast(sum(f) AS BIGINT) AS n FROM counted WHERE m = 1 GROUP BY lang),
candidates AS (SELECT * FROM counted WHERE m >= 2 AND f >= {LEAST}),
cuts AS (
  SELECT c.lang, c.phrase, c.m, c.f AS a, k, array_to_string(c.words[1:k], ' ') AS lp, array_to_string(c.words[k + 1:], ' ') AS rp
  FROM candidates c, (SELECT unnest([1, 2, 3]) AS k) WHERE k < c.m),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.m, a, k, x.f AS l, y.f AS r,
    cast((cast({SCALE} AS HUGEINT) * a) // (cast(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts JOIN counted x ON x.lang = cuts.lang AND x.phrase = cuts.lp JOIN counted y ON y.lang = cuts.lang AND y.phrase = cuts.rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(words[s:s + z - 1], ' ') AS phrase, max(f) AS longer
  FROM candidates, (SELECT unnest([1, 2, 3]) AS s), (SELECT unnest([2, 3]) AS z) WHERE z < m AND s + z - 1 <= m GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase)
  WHERE longer IS NULL OR {COVERED[1]}::HUGEINT * longer < {COVERED[0]}::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= {TOP}
"""
