"""Language-model scores from a probabilistic suffix tree over words.

Contexts are the last 0 to ``depth`` words. A context becomes a state if it was seen ``min_count`` times in training,
its own suffix is a state, and a divergence test holds: over its training occurrences, the log-likelihood under its
next-word distribution (each occurrence left out of its own estimate) must exceed that under its suffix's
distribution by ``min_gain`` nats. Log-likelihoods of n-grams are rounded to 1/256 nat each before they are summed, so
that the test doesn't depend on how documents are dealt. Distributions are smoothed towards the suffix's: (c(s,w) + mu * p(w|suffix)) /
(c(s) + mu), down to the root's (c(w) + 0.1) / (N + 0.1 * (V + 1)). A word is scored in its longest suffix state.

Nothing of the model is gathered in one place. Documents are dealt into chunks of about ``chunk_bytes``. Each chunk
asks for the global counts of its own distinct n-grams, each once; a second round adds the test's sums over all
chunks by context; then the chunk scores its documents. Requests go to targets by n-gram hash, not by context, so a
frequent context meets in no single task, and an n-gram arrives at most once a chunk.

Defined cases: a null text counts as empty and scores its end token alone; texts of any length are taken whole. A null doc_id is held out. Repeated rows
count and score as often as they stand there. An empty table gives an empty result. Without any training document
every token is unknown, V and N are 0. Columns beside doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import U64, WordHashes, mix, slices, utf8

END = U64(0x5851F42D4C957F2D)
UNIT = 256  # of the test's sums, a nat
_HASHES = WordHashes(most=300_000)  # kept between the tasks of a Python worker


@dataclass(frozen=True)
class Params:
    depth: int = 2
    min_count: int = 4
    min_gain: float = 3.0
    mu: float = 2.0
    alpha: float = 0.1
    folds: int = 10
    chunk_bytes: int = 10 << 20


def held_out(doc_id: Column, folds: int) -> Column:
    """True for remainder 0 of the id's CRC-32, or no id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))


def _bundled(texts: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return zstandard.ZstdCompressor(1).compress(len(texts).to_bytes(8, "little") + sizes.tobytes() + b"".join(texts))


def _unbundled(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    stop = 8 + 8 * n + np.cumsum(np.frombuffer(raw, dtype=np.int64, count=n, offset=8))
    return [raw[a:b] for a, b in zip([8 + 8 * n, *stop[:-1].tolist()], stop.tolist(), strict=False)]


class Chunk:
    """The tokens of some documents and their distinct n-grams of each order up to ``order``."""

    def __init__(self, table: pa.Table, order: int, indexed: bool = True):
        end, parts, sizes = np.array([END], dtype=U64), [], []
        for cell in table.column("texts"):  # words of one text at a time: a chunk's words take many times its bytes
            for text in _unbundled(cell.as_py()):
                words = text.lower().split()
                sizes.append(len(words) + 1)
                parts += [_HASHES.of(words), end]
        token = np.concatenate(parts) if parts else np.zeros(0, dtype=U64)
        del parts
        self.sizes = np.array(sizes, dtype=np.int64)
        ends = np.cumsum(self.sizes)
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), self.sizes)
        place = np.arange(len(token)) - np.repeat(ends - self.sizes, self.sizes)
        train = ~np.array([h for cell in table.column("held_out").to_pylist() for h in cell], dtype=bool)
        weight = train[self.doc]
        # Of order k + 1: distinct keys, how often each stands in training, and, if ``indexed``, a position of each and
        # the index by position (-1 where no n-gram ends).
        self.keys, self.first, self.index, self.count = [], [], [], []
        code = token
        for k in range(order):
            if k:
                code = np.concatenate([code[:1], mix(code[:-1] * U64(0x9E3779B97F4A7C15) + U64(k)) + token[1:]])
            at = np.flatnonzero(place >= k)
            own = code[at] & ~U64(1)  # the last bit is left to a mark
            if indexed:
                keys, inverse = np.unique(own, return_inverse=True)
                index = np.full(len(token), -1, dtype=np.int32)
                index[at] = inverse
                first = np.empty(len(keys) if k else 0, dtype=np.int64)
                if k:
                    first[inverse] = at
                self.first.append(first)
                self.index.append(index)
                self.count.append(np.bincount(inverse, weights=weight[at], minlength=len(keys)))
            else:
                marked = np.sort(own | (~weight[at]).astype(U64))
                starts = np.flatnonzero(np.diff(marked >> U64(1), prepend=~U64(0)))
                keys = marked[starts] & ~U64(1)
                count = np.add.reduceat((marked & U64(1)) == 0, starts, dtype=np.int64) if len(starts) else np.zeros(0)
                self.count.append(count)
            self.keys.append(keys)

    def context(self, k: int) -> np.ndarray:
        """For each distinct n-gram of order k + 1 (k > 0), the index of its context among those of order k."""
        return self.index[k - 1][self.first[k] - 1]

    def suffix(self, k: int) -> np.ndarray:
        return self.index[k - 1][self.first[k]]


def _packed(values: np.ndarray) -> bytes:
    """Unsigned values byte by byte, low bytes first, as many as the greatest one takes, compressed."""
    used = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :used].T)
    return bytes([used]) + zstandard.ZstdCompressor(1).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    width, raw = data[0], zstandard.ZstdDecompressor().decompress(data[1:])
    out = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(width, -1).T
    return out.reshape(-1).view("<u8").astype(U64)


def _width(kind: int) -> int:
    """Bytes of a key beside its target: whole 64-bit hashes for words, 40 bits for longer n-grams and contexts.

    Targets grow with the data, so that 40 bits within one hold as sparsely as before at every size.
    """
    return 8 if kind == 0 else 5


def _amounts(amounts: np.ndarray) -> bytes:
    """Whole numbers, negative ones (of a test) too: small ones of either sign take few bytes."""
    x = amounts.astype(np.int64)
    return _packed(((x << 1) ^ (x >> 63)).view(U64))


def _from_amounts(data: bytes) -> np.ndarray:
    x = _unpacked(data)
    return (x >> U64(1)).view(np.int64) ^ -(x & U64(1)).view(np.int64)


MESSAGE = "target int, chunk int, kind int, keys binary, amounts binary"
ANSWER = "chunk int, target int, kind int, sums binary, total long, different long"


def cut(keys: np.ndarray, kind: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """What is sent of sorted keys, and where each of the 2**bits targets begins: a target is a key's leading bits."""
    begin = np.searchsorted(keys >> U64(64 - bits), np.arange((1 << bits) + 1).astype(U64))
    return keys if _width(kind) == 8 else (keys << U64(bits)) >> U64(24), begin


def requests(chunk: int, kind: int, keys: np.ndarray, amounts: np.ndarray, bits: int) -> pa.RecordBatch:
    sent, begin = cut(keys, kind, bits)
    rows = [(_packed(np.diff(sent[a:b], prepend=U64(0))), _amounts(amounts[a:b])) for a, b in zip(begin[:-1], begin[1:], strict=True)]
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int32()), pa.array([chunk] * n, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
        ["target", "chunk", "kind", "keys", "amounts"],
    )


def answers(group: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    """Sums over all chunks for every key that they sent to one target, in the order in which each sent it; of a test's
    sums only whether they exceed ``least``. Sums are whole numbers, so that they don't depend on the chunks."""
    kinds = group.column("kind").to_numpy()
    for kind in np.unique(kinds):
        part = group.filter(pa.array(kinds == kind))
        sent = [np.cumsum(_unpacked(x), dtype=U64) for x in part.column("keys").to_pylist()]
        cuts = np.cumsum([0, *map(len, sent)])
        keys, inverse = np.unique(np.concatenate(sent), return_inverse=True)
        sums = np.zeros(len(keys), dtype=np.int64)
        for a, x in zip(cuts[:-1], part.column("amounts").to_pylist(), strict=True):
            amounts = _from_amounts(x)
            np.add.at(sums, inverse[a : a + len(amounts)], amounts)
        back = sums[inverse]
        cells = [np.packbits(x > least).tobytes() if kind >= 100 else _packed(x.astype(U64)) for x in (back[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))]
        n = len(sent)
        yield pa.RecordBatch.from_arrays(
            [part.column("chunk").combine_chunks(), part.column("target").combine_chunks(), pa.array([int(kind)] * n, pa.int32()), pa.array(cells, pa.binary()), pa.array([int(sums.sum())] * n, pa.int64()), pa.array([int((sums > 0).sum())] * n, pa.int64())],
            ["chunk", "target", "kind", "sums", "total", "different"],
        )


class Model:
    """What a chunk was answered: global counts of its n-grams, and N and V."""

    def __init__(self, chunk: Chunk, table: pa.Table, p: Params):
        self.chunk = chunk
        self.cells: dict[int, list] = {}
        kinds = table.column("kind").to_numpy()
        for kind in np.unique(kinds):
            part = table.filter(pa.array(kinds == kind)).sort_by("target")
            self.cells[int(kind)] = [part.column(c).to_pylist() for c in ("sums", "total", "different")]
        self.n, self.v = (sum(self.cells[0][i]) if 0 in self.cells else 0 for i in (1, 2))
        self.counts = [np.concatenate([_unpacked(x) for x in self.cells[k][0]]).astype(np.float64) for k in range(p.depth + 1)]
        root = (self.counts[0] + p.alpha) / (self.n + p.alpha * (self.v + 1))
        self.root = root
        self.p = [root]
        for k in range(1, p.depth + 1):
            seen = self.counts[k - 1][chunk.context(k)]
            self.p.append((self.counts[k] + p.mu * self.p[k - 1][chunk.suffix(k)]) / (seen + p.mu))


def candidates(counts: np.ndarray, k: int, p: Params) -> np.ndarray:
    return np.flatnonzero(counts[k] >= p.min_count) if k < len(counts) else np.zeros(0, dtype=np.int64)


def gains(model: Model, p: Params) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each context length k: candidate contexts' indices and this chunk's part of each one's test, in units."""
    c = model.chunk
    for k in range(1, p.depth + 1):
        context, suffix = c.context(k), c.suffix(k)
        own = np.flatnonzero(c.count[k] > 0)
        lower = model.p[k - 1][suffix[own]]
        seen = model.counts[k - 1][context[own]]
        left_out = (model.counts[k][own] - 1 + p.mu * lower) / (seen - 1 + p.mu)
        units = np.rint(UNIT * np.log(left_out / lower))  # the same in every chunk, so that sums don't depend on chunks
        gain = np.bincount(context[own], weights=c.count[k][own] * units, minlength=len(c.keys[k - 1]))
        chosen = candidates(model.counts, k - 1, p)
        yield k, chosen, gain[chosen]


def scores(model: Model, states: list[np.ndarray], p: Params) -> tuple[np.ndarray, ...]:
    """Tokens, known tokens, base score and score of each document. ``states[k]``: contexts of k + 1 words that are states."""
    c, docs = model.chunk, len(model.chunk.sizes)
    known = np.bincount(c.doc, weights=model.counts[0][c.index[0]] > 0, minlength=docs)
    base = np.log10(model.root)[c.index[0]]
    best = base.copy()
    live = np.ones(len(best), dtype=bool)
    for k in range(1, p.depth + 1):
        before = np.concatenate([[-1], c.index[k - 1][:-1]])
        at = np.flatnonzero(live & (c.index[k] >= 0))
        at = at[states[k - 1][before[at]]]
        best[at] = np.log10(model.p[k])[c.index[k][at]]
        live = np.zeros(len(best), dtype=bool)
        live[at] = True
    return c.sizes, known.astype(np.int64), np.bincount(c.doc, weights=base, minlength=docs), np.bincount(c.doc, weights=best, minlength=docs)


def score(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    key = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // p.chunk_bytes))
    bits = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chunks).bit_length()
    orders = p.depth + 1
    chunk = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(chunks)).cast("int")
    narrow = docs.select(chunk.alias("chunk"), "doc_id", "text", held_out(F.col("doc_id"), p.folds).alias("held_out"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            to = batch.column("chunk").to_numpy()
            texts = [utf8(t) for t in batch.column("text").to_pylist()]
            order = np.argsort(to, kind="stable")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(to[order])) + 1, [len(order)]])
            offsets, at = pa.array(cuts.astype(np.int32)), pa.array(order)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(to[order][cuts[:-1]], pa.int32()),
                    *(pa.ListArray.from_arrays(offsets, batch.column(c).take(at)) for c in ("doc_id", "held_out")),
                    pa.array([_bundled([texts[i] for i in order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                ],
                ["chunk", "doc_id", "held_out", "texts"],
            )

    dealt = narrow.mapInArrow(bundle, f"chunk int, doc_id array<{key}>, held_out array<boolean>, texts binary")

    def ask(table: pa.Table) -> pa.Table:
        name = table.column("chunk")[0].as_py()
        c = Chunk(table, orders, indexed=False)
        return pa.Table.from_batches([requests(name, k, c.keys[k], c.count[k], bits) for k in range(orders)])

    def answer(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(answers(table, int(p.min_gain * UNIT))))

    def test(table: pa.Table, got: pa.Table) -> pa.Table:
        name = table.column("chunk")[0].as_py()
        model = Model(Chunk(table, orders), got, p)
        return pa.Table.from_batches([requests(name, 100 + k, model.chunk.keys[k - 1][chosen], gain, bits) for k, chosen, gain in gains(model, p)])

    def finish(table: pa.Table, got: pa.Table) -> pa.Table:
        model = Model(Chunk(table, orders), got, p)
        states = []
        for k in range(1, orders):
            chosen = candidates(model.counts, k - 1, p)
            keys = model.chunk.keys[k - 1][chosen]
            begin = cut(keys, 100 + k, bits)[1]
            flags = [np.unpackbits(np.frombuffer(cell, dtype=np.uint8))[:n] for cell, n in zip(model.cells[100 + k][0], np.diff(begin).tolist(), strict=True)]
            state = np.zeros(len(model.chunk.keys[k - 1]), dtype=bool)
            state[chosen] = np.concatenate(flags) == 1
            states.append(state)
        tokens, known, base, best = scores(model, states, p)
        flat = lambda name: pc.list_flatten(table.column(name))
        return pa.table(
            {"doc_id": flat("doc_id"), "held_out": flat("held_out"), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(tokens), int(model.n)), pa.int64()), "base_score": pa.array(base), "score": pa.array(best)}
        )

    counted = dealt.groupBy("chunk").applyInArrow(ask, MESSAGE).groupBy("target").applyInArrow(answer, ANSWER)
    tested = dealt.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(test, MESSAGE).groupBy("target").applyInArrow(answer, ANSWER)
    both = counted.unionByName(tested)
    return dealt.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(finish, f"doc_id {key}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
