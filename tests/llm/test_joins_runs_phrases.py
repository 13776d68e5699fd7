"""Jaccard joins, periodic runs and phrases against brute force; labels and ledgers in odd states; rows of one id."""

import hashlib
import itertools
import random
import re
import zlib

import corpus_pipeline as pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import frame
from vacancia.llm import near_dedup, ngram_join, periodic, phrases, quality, simhash, token_rollup

SF = "/root/testdata/sf0.001"
LONG = "many words of one long text " * 3000


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())


# --- n-gram Jaccard join


def ngram_set(text, width=5):
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def joined(texts):
    """Smallest index that links reach, by all pairs."""
    sets, root = [ngram_set(t) for t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    return [(len(s), r) for s, r in zip(sets, root, strict=True)]


def copies(seed, groups=10):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    out = []
    for g in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([8, 14, 25, 60, 150]))] + passage * (g % 2)
        for changes in (0, 0, 1, 1, 2, 3, 5, 9):
            text = list(base)
            for _ in range(changes):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            out.append(" ".join(text[rnd.randrange(3) :]))
    return out


@pytest.mark.parametrize("block", [1000, 4])
def test_join_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = [*copies(3), "", None, " \n", "a b", "A  b", "a b c", "a b c d e f g h i", "a b c d e f g h i j", LONG, LONG, LONG + "end"]
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    texts = [texts[k] for k in order]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(frame(spark, texts)).collect()}
    want = joined(texts)
    assert got == dict(enumerate(want))
    assert len({r for _, r in want}) < len({t for t in texts if words(t)})


@pytest.mark.parametrize("x", [0, 40, 4000])
def test_any_boundary_gives_the_same_links(spark, monkeypatch, x):
    monkeypatch.setattr(ngram_join, "boundary", lambda lists: x)
    texts = copies(8, 4) if x > 100 else copies(8)
    texts = [" ".join(t.split()[:30]) for t in texts]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(frame(spark, texts)).collect()}
    assert got == dict(enumerate(joined(texts)))


@pytest.mark.parametrize("x", [0, 10])
def test_sets_of_four_meet_sets_of_five(spark, monkeypatch, x):
    monkeypatch.setattr(ngram_join, "boundary", lambda lists: x)
    texts = ["a b c d e f g h", "a b c d e f g h i", "A b c d e f g h x", "k l m n o p q", "k l m n o p q r", "q r s t u v w x y", "r s t u v w x y"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(frame(spark, texts)).collect()}
    assert got == dict(enumerate(joined(texts)))
    assert [got[k][1] for k in (1, 2, 4, 6)] == [0, 0, 4, 5]
    kept = near_dedup.distinct_texts(frame(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5]


def test_sets_that_only_equals_are_similar_to():
    for n in range(1, 200):
        larger = ngram_join.SIMILAR[1] * n >= ngram_join.SIMILAR[0] * (n + 1)
        assert ngram_join.only_equals(n) == (not larger)
    assert [n for n in range(1, 9) if ngram_join.only_equals(n)] == [1, 2, 3]


def test_boundary_weighs_subsets_and_lists(spark):
    rows = [(k, bytes([c]), n, 0, m) for k, (c, n, m) in enumerate([(1, 5, 50), (2, 5, 50), (3, 100, 3), (4, 100, 3), (5, 5000, 900)])]
    lists = spark.createDataFrame(rows, "list long, class binary, n long, at int, m long")
    assert ngram_join.boundary(lists) == 6
    assert ngram_join.boundary(lists.where("n > 50")) == 0


def test_lists_hold_numbers_of_classes(spark):
    texts = copies(5, 4)
    docs = frame(spark, texts)
    rows = ngram_join.with_keys(docs, ngram_join.ngram_ranks(docs))
    classes = ngram_join.written(ngram_join.classes_of(rows), "classes")
    assert {r["class"] for r in classes.collect()} and classes.select("class").distinct().count() == classes.count() == len({frozenset(ngram_set(t)) for t in texts})
    lists = ngram_join.inverted_lists(classes)
    assert not [f.name for f in lists.schema if f.dataType.simpleString() == "binary"]
    assert {f.dataType.simpleString() for f in ngram_join.links(docs, classes).schema} == {"bigint"}


def test_join_of_odd_rows(spark):
    same = "one two three four five six seven"
    rows = frame(spark, [same, same, "other words", same, None], [7, None, 7, 3, None])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(rows).collect()), key=repr)
    assert got == sorted([(7, 3, 3), (None, 3, None), (7, 1, 7), (3, 3, 3), (None, 0, None)], key=repr)
    assert ngram_join.join(rows.limit(0)).count() == 0


def test_parities_and_lists_of_two_never_tell_similar_sets_apart(spark):
    rnd = random.Random(6)
    similar = apart = 0
    rows, kept = [], set()
    for k in range(1500):
        size = rnd.choice([1, 3, 4, 5, 9, 60, 63, 64, 65, 130, 700])
        a = {rnd.getrandbits(64) for _ in range(size)}
        b = set(rnd.sample(sorted(a), rnd.randint(max(1, size * 3 // 4), size))) | {rnd.getrandbits(64) for _ in range(rnd.randint(0, 1 + size // 5))}
        x, y = (ngram_join.np.array(sorted(s), dtype=ngram_join.U64) for s in (a, b))
        if ngram_join.are_similar(x.tobytes(), y.tobytes()):
            assert ngram_join.few_differ(ngram_join.parities(x), ngram_join.parities(y))
            assert ngram_join.few_differ(ngram_join.parities(y), ngram_join.parities(x))
            first = min(a & b)
            rows += [(k, len(v), sorted(v).index(first)) for v in (a, b)]
            kept.add(k)
            similar += 1
        c = ngram_join.np.array(sorted({rnd.getrandbits(64) for _ in range(size)}), dtype=ngram_join.U64)
        apart += size > 60 and not ngram_join.few_differ(ngram_join.parities(x), ngram_join.parities(c))
    assert similar > 500 and apart > 600
    rows += [(-1, 100, 0), (-1, 79, 0), (-2, 100, 12), (-2, 100, 0), (-3, 100, 0)]
    lists = ngram_join.shared(spark.createDataFrame(rows, "list long, n long, at int"))
    assert {r.list for r in lists.collect()} == kept


def test_prints_never_tell_similar_sets_apart():
    rnd = random.Random(2)
    for _ in range(200):
        a = {rnd.getrandbits(64) for _ in range(rnd.randint(1, 60))}
        b = set(list(a)[rnd.randrange(4) :]) | {rnd.getrandbits(64) for _ in range(rnd.randrange(6))} or {1}
        x, y = (ngram_join.np.array(sorted(s), dtype=ngram_join.U64) for s in (a, b))
        if ngram_join.are_similar(x.tobytes(), y.tobytes()):
            assert ngram_join.may_be_similar(ngram_join._prints(x), ngram_join._prints(y))
            first = [len(v).to_bytes(4, "little") + ngram_join._prints(v[: len(v) - ngram_join.needed(len(v)) + 2]) for v in (x, y)]
            assert ngram_join.may_follow(*first)


@pytest.mark.parametrize("most", [1 << 20, 5])
def test_components_of_chains(spark, most):
    edges = [(i, i + 1) for i in range(40) if i % 10] + [(100, 90), (90, 100), (5, 5)]
    got = {(r.node, r.root) for r in simhash.components(spark.createDataFrame(edges, "src long, dst long").repartition(3), most=most).collect()}
    assert got == {(i, i - (i - 1) % 10) for i in range(1, 41) if (i - 1) % 10} | {(100, 90)}


# --- periodic runs


def runs_by_hand(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_every_period(seed):
    rnd = random.Random(seed)
    for t in range(250):
        w = [b"%d" % rnd.randrange(rnd.choice([1, 2, 3, 60])) for _ in range(rnd.randint(200, 700) if t % 20 == 0 else rnd.randint(0, 50))]
        for _ in range(rnd.randint(0, 3)):
            at, p = rnd.randint(0, len(w)), rnd.choice([1, 2, 5, 24, 25, 63, 64, 65, 96, 97, 130])
            unit = [b"%d" % rnd.randrange(rnd.choice([2, 40])) for _ in range(p)]
            if p > 30 and rnd.random() < 0.4:
                unit = [b"a"] * (p - 2) + unit[:2]
            w[at:at] = (unit * 7)[: rnd.randint(3 * p, 7 * p)]
        assert periodic.runs_of(w) == runs_by_hand(w)


def test_runs_of_a_table(spark):
    texts = [" ".join(f"w{i % 7}" for i in range(n)) for n in (0, 5, 28, 41)] + ["x " * 9 + "y z", "a b " * 5 + "c " * 8, "one\ttwo\nthree " * 40, "", None, LONG, "Ü ü Ü ü Ü ü Ü ü"] + [f"word{i} more{i % 3} and some other words" for i in range(120)]
    ids = [*range(len(texts) - 1), None]
    got = periodic.digests(periodic.find(periodic.with_repeats(frame(spark, texts, ids)))).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(by_id) == len(texts)
    for i, text in zip(ids, texts, strict=True):
        w, h = words(text), zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs = runs_by_hand(w) if n < 2000 else periodic.runs_of(w)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        r = by_id[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
    assert periodic.find(frame(spark, texts).limit(0)).count() == 0


# --- phrases


def phrase_rows(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n long").repartition(3)


@pytest.mark.parametrize("rows_held", [1 << 20, 8])
def test_phrases_against_sql(spark, monkeypatch, rows_held):
    monkeypatch.setattr(phrases, "ROWS_HELD", rows_held)
    monkeypatch.setattr(phrases, "PLACES_HELD", 500)
    rnd = random.Random(4)
    usual = ["New York", "in order to", "of the", "red green blue sky", "a", "b", "Ünder", "the", "e\x1cf", "tab\tbed", "x"]
    rows = [("".join(rnd.choice(usual) + rnd.choice([" ", " ", " ", "  ", ". ", "\n", ",", "; "]) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "en", "de", None])) for _ in range(400)]
    rows += [("", "en"), (None, "de"), ("...", "fr"), ("the " * 4000, "en"), ("the the the the", "und")] + [("odd one out", "")] * 31
    docs = phrase_rows(spark, rows)
    got = sorted(tuple(r) for r in phrases.collocations(docs).collect())
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert got == sorted(con.execute(phrases.ORACLE_SQL).fetchall())
    assert {r[0] for r in got} >= {"en", "und", ""} and any(r[2].count(" ") == 3 for r in got)


def test_top_and_empty_tables(spark):
    docs = phrase_rows(spark, [("p q r. s t", "en")] * 40)
    assert [(r["rank"], r.phrase) for r in phrases.collocations(docs, 30, 1).collect()] == [(1, "p q r")]
    assert phrases.collocations(docs, 41).count() == 0
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_salted_hashes_give_the_same(spark, monkeypatch):
    docs = phrase_rows(spark, [("p q r. s t u", "en")] * 40)
    want = sorted(map(tuple, phrases.collocations(docs).collect()))
    tried = []
    monkeypatch.setattr(phrases, "clash", lambda named: tried.append(named) or len(tried) < 3)
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == want and len(tried) == 3


# --- labels without documents, ledgers with nulls, rows of one id


def labelled(spark, n_labels):
    docs = spark.createDataFrame([(i, ("good fine text " if i % 2 else "bad poor junk ") + f"w{i}") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(n_labels)], "doc_id long, quality int")
    return docs, labels


@pytest.mark.parametrize("p", [quality.Params(fit_rows=3), quality.Params(label_rows=20), quality.Params(fit_features=3), quality.Params(fit_features=0)])
def test_labels_without_documents(spark, p):
    docs, labels = labelled(spark, 20_000)
    scored = {r.doc_id: r.score for r in quality.classify(docs, labels, p).collect()}
    assert sum(scored[i] > scored[i - 1] for i in range(1, 100, 2)) == 50


def test_nulls_change_places(spark):
    rollup = token_rollup.Rollup(spark, counters={"words": token_rollup.count_words})
    schema = "doc_id long, change string, seq int, text string, source string, lang string"
    commit = lambda name, *rows: rollup.commit(name, spark.createDataFrame(rows, schema))
    totals = lambda: {(r.source, r.lang): (r.documents, r.tokens) for r in rollup.totals().collect()}
    commit("b1", (1, "insert", 1, "a b", "x", None), (2, "insert", 1, None, None, "t"))
    assert totals() == {("x", None): (1, 2), (None, "t"): (1, 0)}
    commit("b2", (1, "revise", 2, "a b c", None, "x"))
    commit("b1", (1, "insert", 1, "a b", None, "x"), (2, "insert", 1, "t", None, None))
    assert totals() == {(None, "x"): (1, 3), (None, None): (1, 1)}
    before = rollup.batches
    commit("b1", (2, "insert", 1, "t", None, None), (1, "insert", 1, "a b", None, "x"))
    assert rollup.batches == before


def test_one_id_with_two_texts_keeps_both(spark):
    first, second = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, first), (1, second), (1, second), (2, first + " end"), (3, second), (4, "alone"), (4, "alone"), (5, None), (6, ""), (None, first)]
    docs = spark.createDataFrame([(i, t, "c", "r") for i, t in rows], "doc_id long, text string, class string, row string").repartition(3)
    kept = pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, first), (1, second), (4, "alone"), (5, None), (None, first)], key=repr)
    assert near_dedup.distinct_texts(docs.select("doc_id", F.col("text"))).count() == 5
