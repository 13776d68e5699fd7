"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes log-count ratios.

Training: the class log-count ratio ``r`` of every hashed n-gram comes from one distributed count over the
labelled rows that are learned from; a bounded sample of those rows is fitted on the driver by dual coordinate
descent (Hsieh et al. 2008) on the vectors ``r * indicator``, and its margins are calibrated to a probability on
rows held back from the fit (Platt). Scoring is one pass over whole texts with a weight vector of fixed size, with
no shuffle.

Bounds, all documented parameters: ``label_rows`` labelled rows a class of documents in the table, of which ``fit_rows`` a class are fitted, with
``fit_features`` distinct n-grams in all, but one row a class at least; ``2**bits`` weights. Labels without their document don't count. Rows are taken by the smallest hash of their id, so a choice doesn't depend on partitions.

Defined cases: texts of any length are taken whole; a null text counts as empty; an empty text gets the calibrated score of the bias alone. A null
doc_id is never learned from; of repeated documents one is fitted, the one of fewest n-grams. Of repeated label rows of one document the smallest quality counts; null ids or
qualities are ignored. Without labels of both classes every score is the share of class 1 among the labels (0.5
without any). Extra columns of the inputs are left alone, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import U64, WordHashes, fresh, give_back, mix, slices, utf8, written

PIECES = re.compile(rb"[a-z\x80-\xff]+|[0-9]+|[^\x00-\x20a-z0-9\x80-\xff]+").findall


@dataclass(frozen=True)
class Params:
    bits: int = 18
    label_rows: int = 20_000
    fit_rows: int = 2_500
    fit_features: int = 40_000_000
    alpha: float = 1.0
    beta: float = 0.25
    c: float = 1.0
    epochs: int = 15
    threshold: float = 0.3


def indicators(texts: list[bytes], hashes: WordHashes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed uni- and bigrams of each text: all columns, text after text, and how many each text has."""
    words = [PIECES(t.lower()) for t in texts]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    h = hashes.of([w for ws in words for w in ws])
    row = np.repeat(np.arange(len(texts), dtype=U64), sizes)
    same = row[1:] == row[:-1]
    pairs = mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])[same]
    key = np.concatenate([(row << U64(bits)) | (mix(h) >> U64(64 - bits)), (row[1:][same] << U64(bits)) | (pairs >> U64(64 - bits))])
    key = np.unique(key)
    counts = np.bincount((key >> U64(bits)).astype(np.int64), minlength=len(texts))
    return (key & U64((1 << bits) - 1)).astype(np.int32), counts


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [utf8(t) for t in batch.column("text").to_pylist()]


def held_out(doc_id: Column, folds: int) -> Column:
    """True for the rows kept from learning: remainder 0 of the id's CRC-32, or no id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))


def training_labels(docs: DataFrame, labels: DataFrame, p: Params, folds: int) -> DataFrame:
    """At most ``label_rows`` rows a class of documents that are there: doc_id, quality, and order, the id's hash."""
    one = (
        labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"), folds))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .join(docs.select("doc_id"), "doc_id", "left_semi")
        .withColumn("order", F.xxhash64("doc_id"))
    )
    one = written(one, "labelled")
    parts = [one.where(F.col("quality") == k).orderBy("order", "doc_id").limit(p.label_rows) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    scale: np.ndarray
    bias: float
    a: float
    b: float
    bits: int

    def scores(self, texts: list[bytes], hashes: WordHashes) -> np.ndarray:
        columns, counts = indicators(texts, hashes, self.bits)
        row = np.repeat(np.arange(len(texts)), counts)
        total = np.bincount(row, weights=self.weights[columns], minlength=len(texts))
        norm = np.sqrt(np.bincount(row, weights=self.scale[columns] ** 2, minlength=len(texts)))
        margin = total / np.where(norm > 0, norm, 1.0) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(self.a * margin + self.b, -500, 500)))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, dim: int, epochs: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear SVM with costs ``cost``, by coordinate descent on its dual."""
    w, bias = np.zeros(dim), 0.0
    alpha = np.zeros(len(rows))
    q = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            c, v = rows[i]
            g = y[i] * (float(w[c] @ v) + bias) - 1.0
            new = min(max(alpha[i] - g / q[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[c] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, bias


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """``a`` and ``b`` of the logistic curve over margins, by Newton's method with a small ridge."""
    positive, negative = weight[y > 0].sum(), weight[y <= 0].sum()
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        z = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, s = weight * (z - target), weight * z * (1 - z)
        grad = np.array([d @ margin + 1e-3 * (a - 1), d.sum() + 1e-6 * b])
        hess = np.array([[s @ margin**2 + 1e-3, s @ margin], [s @ margin, s.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def train(docs: DataFrame, labels: DataFrame, p: Params = Params(), folds: int = 5) -> Model:
    spark = docs.sparkSession
    chosen = training_labels(docs, labels, p, folds)
    # At most 2 * label_rows rows of two numbers, by training_labels' limits: broadcast, so that no text is shuffled.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    dim, bits = 1 << p.bits, p.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, seen, hashes = np.zeros((2, dim)), [0, 0], WordHashes()
        for batch in slices(batches, "text", 1 << 20):
            quality = batch.column("quality").to_numpy()
            columns, counts = indicators(_texts(batch), hashes, bits)
            each = np.repeat(quality, counts)
            for k in (0, 1):
                totals[k] += np.bincount(columns[each == k], minlength=dim)
                seen[k] += int((quality == k).sum())
        used = np.flatnonzero(totals.sum(0))
        feature = np.concatenate([[-1], used]).astype(np.int32)
        columns = [np.concatenate([[seen[k]], totals[k][used]]).astype(np.int64) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(feature), *map(pa.array, columns)], ["feature", "n0", "n1"])

    # One row a weight at most: its size does not depend on the input.
    sums = rows.mapInArrow(count, "feature int, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    totals = np.zeros((2, dim))
    kept = sums[sums.feature >= 0]
    for k in (0, 1):
        totals[k, kept.feature.to_numpy(dtype=np.int64)] = kept[f"n{k}"].to_numpy(dtype=float)
    seen = [int(sums.loc[sums.feature < 0, f"n{k}"].sum()) for k in (0, 1)]
    if not all(seen):
        share = seen[1] / sum(seen) if sum(seen) else 0.5
        odds = 500.0 if share >= 1 else -500.0 if share <= 0 else float(np.log(share / (1 - share)))
        return Model(np.zeros(dim), np.zeros(dim), 0.0, 0.0, odds, bits)
    smooth = totals + p.alpha
    ratio = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text", 1 << 20):
            columns, counts = indicators(_texts(batch), hashes, bits)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            cells = [columns[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("order"), pa.array(counts), pa.array(cells, pa.binary())], ["quality", "order", "features", "columns"])

    few = F.broadcast(
        chosen.where("quality = 0").orderBy("order", "doc_id").limit(p.fit_rows).unionByName(chosen.where("quality = 1").orderBy("order", "doc_id").limit(p.fit_rows))
    )
    sample = docs.select("doc_id", "text").join(few, "doc_id").mapInArrow(gather, "quality int, order long, features long, columns binary")
    # One row a document; then, in the order of their hashes, rows while their n-grams are ``fit_features`` at most.
    sample = written(sample.groupBy("order", "quality").agg(F.min(F.struct("features", "columns")).alias("one")).select("order", "quality", "one.*"), "fit-rows")
    sizes = sample.select("order", "quality", "features").orderBy("order", "quality").toPandas()  # 2 * fit_rows rows at most
    taken = sizes[sizes.features.cumsum() <= p.fit_features]
    last = taken.order.max()
    # A class that has no row by then takes part with its smallest.
    lone = [int(of.order[of.features.idxmin()]) for k, of in sizes.groupby("quality") if k not in set(taken.quality)]
    within = F.col("order") <= F.lit(int(last) if last == last else None).cast("long")
    sample = sample.where(F.coalesce(within, F.lit(False)) | F.col("order").isin(lone)).toPandas().sort_values(["order", "quality"], kind="stable")
    y = np.where(sample.quality.to_numpy() == 1, 1.0, -1.0)
    vectors = []
    for cell in sample["columns"]:
        c = np.frombuffer(cell, dtype=np.int32)
        v = ratio[c]
        norm = float(np.sqrt(v @ v))
        vectors.append((c, v / norm if norm else v))
    share = np.array([seen[0] / max((y < 0).sum(), 1), seen[1] / max((y > 0).sum(), 1)])
    weight = np.where(y > 0, share[1], share[0])
    weight = weight / weight.mean()
    back = np.arange(len(y)) % 4 == 0
    if len(set(y[~back])) < 2 or len(set(y[back])) < 2:
        back = np.zeros(len(y), dtype=bool)

    def fitted(chosen_rows: np.ndarray) -> tuple[np.ndarray, float]:
        at = np.flatnonzero(chosen_rows)
        w, bias = dual_coordinate_descent([vectors[i] for i in at], y[at], p.c * weight[at], dim, p.epochs)
        mean = np.abs(w).sum() / max(int((w != 0).sum()), 1)
        return (1 - p.beta) * mean + p.beta * w, p.beta * bias

    def margins(w: np.ndarray, bias: float, at: np.ndarray) -> np.ndarray:
        return np.array([float(w[vectors[i][0]] @ vectors[i][1]) + bias for i in at])

    w, bias = fitted(~back)
    at = np.flatnonzero(back if back.any() else ~back)
    a, b = platt(margins(w, bias, at), y[at], weight[at])
    return Model(w * ratio, ratio, bias, a, b, bits)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` with score and predicted, one row a row, in one narrow pass. Kept columns of these
    names stay; the new ones then have underscores behind theirs."""
    give_back()  # what the fit took in the driver
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name in keep]
    names = [fresh(c, keep) for c in ("score", "predicted")]
    source = docs.select(*[F.col(k) for k in dict.fromkeys((*keep, "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text", 1 << 20):
            s = shared.value.scores(_texts(batch), hashes)
            columns = [batch.column(f.name) for f in fields] + [pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in fields), *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return source.mapInArrow(run, f"{kinds}, {names[0]} double, {names[1]} int")


def classify(docs: DataFrame, labels: DataFrame, p: Params = Params(), folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs, train(docs, labels, p, folds), p.threshold)
    return scored.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", "predicted")
