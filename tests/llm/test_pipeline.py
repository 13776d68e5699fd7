"""The pipeline's stages on a small corpus, and what each decides."""

import itertools
import random

import corpus_pipeline as pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vacancia.llm import packing, tokens
from vacancia.llm.common import slices

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.columns
    kept = [docs.count()]
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == before
        kept.append(docs.count())
    assert kept[0] > kept[-1] > kept[0] / 2 and kept == sorted(kept, reverse=True)
    packed = pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == kept[-1]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [d.doc_id for d in docs.collect() if any(i in d.text for i in items)]


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    place = ["doc_id", "piece", "start", "length", "ids_crc32"]
    want, got = docs.select(*place, "sequence_id").collect(), pipeline.run(spark, SF).select(*place, "sequence_id").collect()
    assert sorted(r[:5] for r in got) == sorted(r[:5] for r in want)
    assert len({r.sequence_id for r in got}) == len({r.sequence_id for r in want})


@pytest.mark.parametrize("nth", range(5))
def test_stages_take_odd_rows(spark, nth):
    """Nulls, empty and long texts, repeated rows, clashing columns, and no rows at all."""
    name, stage = pipeline.STAGES[nth]
    long = "many words of one long text " * 3000
    rows = [(None, None), (None, "a b c"), (1, ""), (2, None), (3, long), (3, long), (4, "one of two"), (4, "two of two"), (5, "x\n\n \n")]
    docs = spark.createDataFrame([(i, t, None, None, None if t is None else len(t), "p", 1, "r", 2, "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, predicted string, score int, found string, n_removed int, row string").repartition(2)
    done = stage(spark, docs, SF)
    kept = done.collect()
    assert stage(spark, docs.limit(0), SF).count() == 0
    if nth < 4:
        assert done.columns == docs.columns
        assert {(r.predicted, r.score, r.found, r.n_removed, r.row) for r in kept} <= {("p", 1, "r", 2, "k")}
        assert {(r.doc_id, r.text) for r in kept} <= set(rows) | {(4, None)} and (name == "quality" or {r.doc_id for r in kept} >= {None, 3, 4})
    else:
        assert {r.doc_id for r in kept} == {None, 1, 2, 3, 4, 5}


def test_near_duplicates_against_all_pairs(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(120)]
        texts.append(base)
        for changes in (1, 1, 2, 4, 9):
            base = list(rnd.choice(texts[-3:]) if rnd.random() < 0.3 else base)
            at = rnd.randrange(100)
            base[at : at + changes] = [rnd.choice(words) for _ in range(changes)]
            texts.append(base)
    texts = [" ".join(t) for t in texts] + [texts[0] and " ".join(texts[0]).upper(), "", None, "a b", "a b", "a c"]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    docs = spark.createDataFrame([(i, texts[k]) for i, k in enumerate(order)] + [(None, "a b")], "doc_id long, text string").repartition(3)

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    sets = [shingles(texts[k]) for k in order]
    root = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    got = [r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert got.count(None) == 1 and sorted(i for i in got if i is not None) == sorted(set(root))
    assert len(set(root)) < len({frozenset(s) for s in sets})


def test_a_kernel_lets_go_of_what_others_keep():
    rows = [pa.RecordBatch.from_pydict({"text": ["a b", None]})]
    first = tokens.encoder(tokens.default_path())
    assert sum(b.num_rows for b in slices(iter(rows), "text", keeps=tokens.KEPT)) == 2
    assert tokens.encoder(tokens.default_path()) is first
    assert sum(b.num_rows for b in slices(iter(rows), "text")) == 2
    assert tokens.encoder(tokens.default_path()) is not first


def test_stages_bound_arrow_batches(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for _, stage in pipeline.STAGES[2:]:
        stage(spark, docs, SF)
        wide = spark.range(0, 8000, 1, 1).selectExpr("repeat('x', 2000) AS text")
        sizes = wide.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        assert max(r.n for r in sizes.collect()) < 4000
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_batches_are_small(spark):
    """A column of a batch has less than two megabytes here; a batch read from Parquet has 1024 rows at most."""
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    _, stage = pipeline.STAGES[-1]
    stage(spark, docs, SF)
    wide = spark.range(0, 8000, 1, 1).selectExpr("repeat('x', 2000) AS text")
    sizes = wide.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.column(0).nbytes]}) for b in batches), "n long")
    assert max(r.n for r in sizes.collect()) < 1 << 21
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 1024
    for name in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        spark.conf.unset(name)


def test_packing_with_few_kept_parts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    place = ["doc_id", "piece", "start", "length", "ids_crc32"]
    few, many = (sorted(packing.pack(docs, most=n).select(*place).collect()) for n in (50, tokens.PARTS))
    assert few == many and few
    assert tokens.encoder(tokens.default_path(), 50).most == 50
