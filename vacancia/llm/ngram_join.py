"""Jaccard join of word n-gram sets: subsets of small sets, inverted lists for large ones, components of all links.

A text is the set of its runs of ``WORDS`` words without case; a shorter text is one n-gram. Texts of equal sets are a
class, and only classes are joined; they travel by number. N-grams have one order everywhere: by hash, those that many
texts hold last. Two sets of the similarity share one of the first n - t + 1 n-grams of both, and two of the first
n - t + 2 (n its size, t the shared n-grams that a set of n needs at least), if t is 2 or more. So

- large sets scan inverted lists: a row for each of their first n - t + 1 n-grams meets the rows of all sets with it;
- small sets meet small sets in lists of subsets: a row for each two of their first n - t + 2 n-grams.

Sets below the boundary are small. It is where the rows of subsets below and the rows scanned above are fewest in all,
from the lengths of the lists. A list only says that two sets may be similar, and only for its first common n-gram: what
stands behind it bounds what they can share. The exact sets decide.

Only components are asked for, so no list is written out in pairs. First each set is held against the set of its list
that meets most others. What that connects is known; then sets of one list that are in different components still are
held against one another, all of them, long lists in salted blocks. No link between components is missed. Most pairs that
aren't similar are told apart by parities: a bit a slot of hashes, so that sets differ in no more bits than n-grams.

Defined cases: a null or empty text, or one without words, has no n-grams and links with nothing, equal texts neither. Rows
with a null doc_id aren't joined: their component_id is null. Rows that repeat a doc_id count by their own texts; rows are
returned one for one. Texts of any length are taken whole. Ties don't arise: a component has the name of its smallest
doc_id. An empty table gives an empty result. Columns beside doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import HOT, U64, bit_flags, flag_pages, flag_place, flagged, give_back, join_counted, mix, ranges, slices, utf8, written
from vacancia.llm.jaccard import SIMILAR, WORDS, are_similar, similar_pairs
from vacancia.llm.simhash import components

FLAG_BITS, COUNT_BITS = 26, 40
FREQUENT, RANK_BITS = 1 << 22, 24  # at most so many n-grams have a rank, by so many bits
COUNTED = 1 << 19  # n-grams that a task counts at once
SIZES = 4096  # sets of that size or more are never small
CHUNK, LONG = 1 << 18, 64  # bytes of a text that are hashed at once, and of a word that is hashed by its place in it
BLOCK = 1000  # sets of a list that are held against another so many by one task

_FACTOR = U64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(CHUNK + 1, _FACTOR, dtype=U64))
_INVERSE = np.cumprod(np.full(CHUNK + 1, U64(pow(int(_FACTOR), -1, 1 << 64)), dtype=U64))
_BYTES = mix(np.arange(1, 257, dtype=U64))
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False


def _by_place(text: bytes) -> np.ndarray:
    """The hash of each word of a text of ``CHUNK`` bytes at most: a polynomial over its bytes, from sums over the text; of a
    word beyond ``LONG`` bytes its XXH64."""
    at = np.frombuffer(text, dtype=np.uint8)
    inside = np.zeros(len(at) + 2, dtype=bool)
    inside[1:-1] = _IN_WORD[at]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    sums = np.zeros(len(at) + 1, dtype=U64)
    np.cumsum(_BYTES[at] * _POWERS[: len(at)], out=sums[1:])
    found = mix((sums[last] - sums[first]) * _INVERSE[first] + (last - first).astype(U64))
    for k in np.flatnonzero(last - first > LONG).tolist():
        found[k] = xxhash.xxh64_intdigest(text[first[k] : last[k]])
    return found


def word_hashes(text: bytes) -> np.ndarray:
    """The hash of each word without case, whatever stands around it."""
    text = text.lower()
    if len(text) <= CHUNK:
        return _by_place(text)
    words = text.split()
    found = np.empty(len(words), dtype=U64)
    for k in range(0, len(words), CHUNK // (LONG + 1)):
        part = words[k : k + CHUNK // (LONG + 1)]
        found[k : k + len(part)] = _by_place(b" ".join(w if len(w) <= LONG else b"?" for w in part))
        for i, w in enumerate(part, k):
            if len(w) > LONG:
                found[i] = xxhash.xxh64_intdigest(w)
    return found


def runs_of_words(text: bytes, width: int = WORDS) -> np.ndarray:
    """The hash of each n-gram in turn."""
    found = word_hashes(text)
    if not len(found):
        return found
    size = min(width, len(found))
    whole = found[: len(found) - size + 1].copy()
    for k in range(1, size):
        whole *= U64(0x9FB21C651E98DF25)
        whole += found[k : len(found) - size + 1 + k]
    return mix(whole + U64(size))


def ngrams(text: bytes) -> np.ndarray:
    """Hashes of the distinct n-grams, ascending."""
    found = np.sort(runs_of_words(text))
    return found[np.append(True, found[1:] != found[:-1])] if len(found) else found


def ngram_ranks(docs: DataFrame) -> np.ndarray:
    """For each of 2**RANK_BITS last bits of hashes the logarithm of how often an n-gram with them stands in those parts of the
    input that repeat it; 0 for n-grams that no part repeats, and below the least logarithm that ``FREQUENT`` n-grams or fewer
    reach. Only the order of n-grams follows from it, and that is the same everywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64))
            return pa.RecordBatch.from_arrays([pa.array(keys[n > 1].view(np.int64)), pa.array(n[n > 1])], ["key", "n"])

        for batch in slices(batches, "text", 1 << 20):
            for text in batch.column("text").to_pylist():
                held.append(runs_of_words(utf8(text)))
                size += len(held[-1])
                if size >= COUNTED:
                    yield out()
                    held, size = [], 0
        yield out()

    counted = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counted = written(counted.select("key", F.floor(F.log2("n")).cast("int").alias("rank")), "ngram-counts")
    by_rank = {r["rank"]: r["count"] for r in counted.groupBy("rank").count().collect()}  # a row a power of two
    least, kept = 64, 0
    while least > 1 and kept + by_rank.get(least - 1, 0) <= FREQUENT:
        least -= 1
        kept += by_rank.get(least, 0)
    slot = F.col("key").bitwiseAND((1 << RANK_BITS) - 1).cast("int").alias("slot")
    rows = counted.where(F.col("rank") >= least).groupBy(slot).agg(F.max("rank").alias("rank")).toArrow()  # FREQUENT rows at most
    ranks = np.zeros(1 << RANK_BITS, dtype=np.int8)
    ranks[rows.column("slot").to_numpy()] = rows.column("rank").to_numpy()
    rows = None
    give_back()
    return ranks


def needed(n: int) -> int:
    """What a set of ``n`` n-grams shares at least with a similar one."""
    above, below = SIMILAR
    return -(-above * n // below)


def only_equals(n: int) -> bool:
    """Whether a set of ``n`` n-grams is similar to its equals only: even one more n-gram is too many."""
    above, below = SIMILAR
    return below * n < above * (n + 1)


def set_class(found: np.ndarray) -> bytes | None:
    """128 bits that tell a set from others; None for an empty set."""
    return xxhash.xxh128_digest(found.tobytes()) if len(found) else None


def majority(found: np.ndarray) -> int:
    """The SimHash fingerprint of a set: a bit is 1 if it is set in over half of the hashes."""
    bits = np.zeros(64, dtype=np.int64)
    values = found.astype(">u8").view(np.uint8).reshape(-1, 8)
    for a in range(0, len(values), 4096):
        bits += np.unpackbits(values[a : a + 4096], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(values)).tobytes(), "big", signed=True)


def parities(found: np.ndarray) -> bytes:
    """A set's size (four bytes) and for each slot of last bits, as many as a power of two of at least its size and 64,
    whether it holds an odd number of the set's hashes."""
    slots = 1 << max(6, (len(found) - 1).bit_length())
    odd = np.bincount((found & U64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return len(found).to_bytes(4, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def few_differ(a: bytes, b: bytes) -> bool:
    """Whether sets may be similar by their parities: of n-grams that only one of them has each changes one slot."""
    above, below = SIMILAR
    (n, x, k), (m, y, j) = ((int.from_bytes(v[:4], "little"), int.from_bytes(v[4:], "little"), 8 * (len(v) - 4)) for v in (a, b))
    if k < j:
        x, y, k, j = y, x, j, k
    while k > j:  # of half as many slots
        k //= 2
        x = (x >> k) ^ (x & ((1 << k) - 1))
    return (above + below) * (x ^ y).bit_count() <= (below - above) * (n + m)


def with_keys(docs: DataFrame, ranks: np.ndarray, fingerprints: bool = False) -> DataFrame:
    """doc_id, class (null for an empty set), n (the set's size), parities and keys, its first n-grams in the order of all; with
    ``fingerprints`` also the set's SimHash fingerprint. A set that only its equals can be similar to has no keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    last, none = U64((1 << RANK_BITS) - 1), np.zeros(0, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            classes, sizes, odd, keys, prints = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = ngrams(utf8(text))
                n = len(found)
                classes.append(set_class(found))
                sizes.append(n)
                odd.append(parities(found) if n else None)
                if fingerprints:
                    prints.append(majority(found))
                if only_equals(n):
                    keys.append(none)
                    continue
                keys.append(found[np.argsort(ranks[(found & last).astype(np.int64)], kind="stable")[: n - needed(n) + 2]].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([none, *keys])))
            columns = [batch.column("doc_id"), pa.array(classes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(odd, pa.binary()), listed]
            more = [pa.array(prints, pa.int64())] if fingerprints else []
            yield pa.RecordBatch.from_arrays([*columns, *more], ["doc_id", "class", "n", "parities", "keys", "fingerprint"][: len(columns) + len(more)])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, class binary, n long, parities binary, keys array<long>" + ", fingerprint long" * fingerprints)


def classes_of(rows: DataFrame) -> DataFrame:
    """class (a number), digest (128 bits of the set), doc_id (the smallest), copies, n, parities, keys and fingerprint, if
    there is one, of the classes of ``rows``. Numbers are fixed once this is written."""
    same = [F.first(c).alias(c) for c in ("n", "parities", "keys", "fingerprint") if c in rows.columns]
    found = rows.where("doc_id is not null and class is not null").groupBy(F.col("class").alias("digest"))
    return found.agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *same).withColumn("class", F.monotonically_increasing_id())


def single_entries(classes: DataFrame, twice: np.ndarray) -> DataFrame:
    """list, class, n and at: a row for each of a set's first n - t + 1 n-grams, its place from 0. Rows of lists without one
    of the flags ``twice`` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            size = np.maximum(pc.list_value_length(keys).to_numpy(zero_copy_only=False).astype(np.int64) - 1, 0)
            flat, starts = keys.flatten().to_numpy(), np.cumsum(size + 1) - size - 1
            at = ranges(np.zeros(len(size), dtype=np.int64), size)
            lists, row = flat[np.repeat(starts, size) + at], np.repeat(np.arange(len(size)), size)
            bit = lists & ((1 << FLAG_BITS) - 1)
            kept = np.flatnonzero((twice[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
            picked = pa.array(row[kept])
            yield pa.RecordBatch.from_arrays([pa.array(lists[kept]), batch.column("class").take(picked), batch.column("n").take(picked), pa.array(at[kept].astype(np.int32))], ["list", "class", "n", "at"])

    return classes.select("class", "n", "keys").mapInArrow(run, "list long, class long, n long, at int")


def shared(entries: DataFrame) -> DataFrame:
    """list, its length m and whether it can tell similar sets, of those lists of ``entries`` (list, n, at) that have several;
    a written table. A list tells if an entry of it is early: of two similar sets the smaller has its first common n-gram
    early, since what it shares with one of its own size at least must still follow. Lists of two entries are left out, if
    their sets can't be similar with it as the first that they share."""
    above, below = SIMILAR
    n, rest = F.col("n"), F.col("n") - F.col("at")
    early = (above + below) * rest >= 2 * above * n
    two = (below * F.min(n) >= above * F.max(n)) & ((above + below) * F.min(rest) >= above * F.sum(n))
    counted = entries.groupBy("list").agg(F.count("*").alias("m"), (F.count_if(early) > 0).alias("tells"), two.alias("two"))
    return written(counted.where("m > 2 or (m = 2 and two)").drop("two"), "list-lengths")


def _by_list(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` joined on list with ``table``, which has each list's length m; the longest lists by broadcast."""
    hot = F.col("m") >= F.lit(max(rows.count() // HOT, 2))
    marked = rows.join(F.broadcast(table.where(hot)), "list", "left")
    rest = marked.where("m is null").select(*rows.columns).join(table.where(~hot), "list")
    return marked.where("m is not null").unionByName(rest)


def boundary(lists: DataFrame) -> int:
    """The size from which sets are large: subsets of the sets below and rows scanned by the others are fewest in all."""
    of_class = lists.groupBy("class", "n").agg(F.sum(F.col("m") - 1).alias("scanned"))
    rows = of_class.groupBy(F.least("n", F.lit(SIZES)).alias("n")).agg(F.count("*").alias("sets"), F.sum("scanned").alias("scanned")).orderBy("n").collect()
    left = sum(r.scanned for r in rows)
    best, least = 0, left
    for r in rows:
        first = r.n - needed(r.n) + 2
        left += r.sets * (first * (first - 1) // 2) - r.scanned
        if r.n < SIZES and left < least:
            best, least = r.n + 1, left
    return best


def _may_link(a: str, b: str) -> str:
    """Whether two entries of one list can be of similar sets and this can be their first common list."""
    above, below = SIMILAR
    return (
        f"{below} * least({a}.n, {b}.n) >= {above} * greatest({a}.n, {b}.n)"
        f" and {above + below} * least({a}.n - {a}.at, {b}.n - {b}.at) >= {above} * ({a}.n + {b}.n)"
        f" and ({a}.subset or not ({a}.small and {b}.small))"
    )


def inverted_lists(classes: DataFrame) -> DataFrame:
    """list, class, n, at, m, tells, small and subset: lists of single n-grams, and of two for small sets. The last bit of a
    list tells these apart; lists that agree in all others are one list, which only adds pairs that the sets decide."""
    own = classes.where(F.size("keys") > 0)
    # Flags need fewer bits of an n-gram; some more let lists of one entry pass, about one in a thousand of 2**30 lists.
    one = own.select(F.explode(F.expr("slice(keys, 1, size(keys) - 1)")).alias("list")).select(F.col("list").bitwiseAND((1 << COUNT_BITS) - 1).alias("list"))
    several = one.groupBy("list").agg(F.count("*").alias("m")).where("m > 1")
    entries = written(single_entries(own, bit_flags(several, F.col("list").bitwiseAND((1 << FLAG_BITS) - 1), FLAG_BITS)), "list-entries")
    lists = written(_by_list(entries, shared(entries)), "lists")
    small = boundary(lists)
    lists = lists.withColumns({"list": F.shiftleft("list", 1), "small": F.col("n") < small, "subset": F.lit(False)})
    if not small:
        return lists
    some = own.where(F.col("n") < small).join(lists.where("small").select("class").distinct(), "class")
    first = some.select("class", "n", "keys", F.posexplode("keys").alias("i", "one"))
    second = first.select("class", "n", "one", F.posexplode("keys").alias("j", "two"), "i").where("j > i")
    # The bound on what two sets share counts from the first of two common n-grams' place on, here one before the second's.
    pairs = second.select(F.xxhash64("one", "two").alias("list"), "class", "n", (F.col("j") - 1).alias("at"))
    pairs = written(pairs, "pair-entries")
    return lists.unionByName(_by_list(pairs, shared(pairs)).withColumns({"list": F.shiftleft("list", 1).bitwiseOR(F.lit(1)), "small": F.lit(True), "subset": F.lit(True)}))


def _prints(found: np.ndarray) -> bytes:
    """The first 16 bits of each hash, ascending: two sets share no more of them than hashes."""
    return (found >> U64(48)).astype(np.uint16).tobytes()


def _common(a: bytes, b: bytes) -> tuple[int, int, int]:
    """How many first bits two packed arrays share, repeats as often as both have them, and the arrays' lengths."""
    x, y = (np.frombuffer(v, dtype=np.uint16).astype(np.int64) for v in (a, b))
    numbered = [(v << 32) + np.arange(len(v)) - np.searchsorted(v, v) for v in (x, y)]
    return len(np.intersect1d(*numbered, assume_unique=True)), len(x), len(y)


def may_be_similar(a: bytes, b: bytes) -> bool:
    """Whether sets of such first bits may be of similar sets."""
    above, below = SIMILAR
    shared_, x, y = _common(a, b)
    return below * shared_ >= above * (x + y - shared_)


def may_follow(a: bytes, b: bytes) -> bool:
    """Whether sets may be similar by their first n-grams: the size (four bytes), then the first bits of each. Common n-grams
    stand among the first of both, or behind the first of that set whose first ones end sooner."""
    above, below = SIMILAR
    n, m = (int.from_bytes(v[:4], "little") for v in (a, b))
    shared_, x, y = _common(a[4:], b[4:])
    return (above + below) * (shared_ + max(n - x, m - y)) >= above * (n + m)


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, packed: Callable[[np.ndarray], bytes]) -> DataFrame:
    """class and set (as ``packed``) of the classes of ``wanted``, from the text of the first document of each."""
    first = written(_of_classes(classes.select("class", "digest", "doc_id"), wanted), "set-documents")
    pages = written(flag_pages(first, flag_place(F.col("doc_id"), FLAG_BITS)), "set-flags")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sets = [ngrams(utf8(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([packed(s) for s in sets], pa.binary())], ["digest", "set"])

    read = flagged(docs.select("doc_id", "text"), pages, True, FLAG_BITS).select("text").mapInArrow(run, "digest binary, set binary")
    return written(read.join(first.select("digest", "class"), "digest").dropDuplicates(["digest"]).select("class", "set"), "ngram-sets")


def _of_classes(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of ``rows`` whose class is in ``wanted``; rows that flags of fixed size leave out don't move."""
    pages = flag_pages(wanted, flag_place(F.col("class"), FLAG_BITS))
    return flagged(rows, pages, True, FLAG_BITS, "class").join(wanted, "class", "left_semi")


def verified(edges: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of ``edges`` (src, dst; a written table) whose sets are similar: by parities, then by 16 bits of each n-gram,
    which tell most others apart, and last by the hashes."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("class")).distinct()
    odd = written(_of_classes(classes.select("class", F.col("parities").alias("set")), ends), "end-parities")
    edges = written(similar_pairs(edges, odd, few_differ), "possible-pairs")
    for packed, test in ((_prints, may_be_similar), (np.ndarray.tobytes, are_similar)):
        ends = edges.select(F.explode(F.array("src", "dst")).alias("class")).distinct()
        edges = written(similar_pairs(edges, _sets(docs, classes, ends, packed), test), "similar-pairs")
    return edges


def rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with root: their class's component, the class itself without a link."""
    found = components(links)
    return rows.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))


def links(docs: DataFrame, classes: DataFrame, likely: DataFrame | None = None) -> DataFrame:
    """src and dst: similar pairs of classes that connect all that are linked. Pairs of ``likely``, if given, are looked at
    first."""
    lists = written(inverted_lists(classes), "all-lists")
    weight = lists.groupBy("class").agg(F.sum(F.col("m") - 1).alias("meets"))
    lists = lists.where("tells").drop("tells")
    told = lists.join(weight, "class")
    centre = told.groupBy("list").agg(F.max(F.struct("meets", "class", "n", "at", "small", "subset")).alias("c"), F.count("*").alias("m"))
    near = _by_list(lists.drop("m"), centre)
    star = near.select(F.struct("class", "n", "at", "small", "subset").alias("a"), "c").where("a.class <> c.class").where(_may_link("a", "c"))
    star = star.select(F.col("c.class").alias("src"), F.col("a.class").alias("dst"))
    star = written((star if likely is None else star.unionByName(likely)).distinct(), "star-links")
    first = verified(star, docs, classes)

    rows = written(rooted(lists.drop("m"), first), "rooted-lists")
    open_ = rows.groupBy("list").agg(F.count("*").alias("m"), (F.min("root") != F.max("root")).alias("open")).where("open")
    rows = _by_list(rows, open_.select("list", "m"))
    rows = written(rows.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")), "open-lists")
    a = rows.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).alias("a")
    b = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("b")
    test = f"a.list = b.list and a.block = b.block and a.class < b.class and a.root <> b.root and {_may_link('a', 'b')}"
    pairs = written(a.join(b, F.expr(test)).select(F.col("a.class").alias("one"), F.col("b.class").alias("two")).distinct(), "open-pairs")
    degree = pairs.select(F.explode(F.array("one", "two")).alias("class")).groupBy("class").agg(F.count("*").alias("d"))
    both = pairs.join(degree.select(F.col("class").alias("one"), F.col("d").alias("d1")), "one").join(degree.select(F.col("class").alias("two"), F.col("d").alias("d2")), "two")
    most = F.col("d1") >= F.col("d2")
    both = written(both.select(F.when(most, F.col("one")).otherwise(F.col("two")).alias("src"), F.when(most, F.col("two")).otherwise(F.col("one")).alias("dst")), "directed-pairs")
    return first.unionByName(verified(both, docs, classes))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles (the set's size) and component_id (the smallest doc_id that links reach) of every row."""
    known = docs.where("doc_id is not null")
    rows = written(with_keys(docs, ngram_ranks(docs)), "ngram-keys")
    classes = written(classes_of(rows), "ngram-classes")
    named = written(rooted(classes.select("class", "digest", "doc_id", "copies"), links(known, classes)), "rooted-classes")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    table = join_counted(named.select("digest", "copies", "root"), least, "root", named.count(), 0).select(F.col("digest").alias("class"), F.col("copies").alias("n"), "component_id")
    linked = rows.where("doc_id is not null and class is not null").select("doc_id", F.col("n").alias("n_shingles"), "class")
    linked = join_counted(linked, table, "class", rows.count(), 0).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("doc_id is null or class is null").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).alias("component_id"))
    return linked.unionByName(alone)


ORACLE_SQL = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')))) END AS s
  FROM worded),
classes AS (SELECT s, min(doc_id) AS id, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
members AS (SELECT id, n, unnest(s) AS g FROM classes),
shared AS (
  SELECT a.id AS x, b.id AS y FROM members a JOIN members b ON a.g = b.g AND a.id < b.id AND {SIMILAR[1]} * least(a.n, b.n) >= {SIMILAR[0]} * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING {SIMILAR[1]} * count(*) >= {SIMILAR[0]} * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM shared UNION SELECT y, x FROM shared),
reached AS (SELECT id, id AS other FROM classes UNION SELECT r.id, l.y FROM reached r JOIN links l ON l.x = r.other),
named AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)
SELECT sets.doc_id, cast(len(sets.s) AS BIGINT) AS n_shingles, CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE named.component_id END AS component_id
FROM sets LEFT JOIN classes USING (s) LEFT JOIN named USING (id)
"""
