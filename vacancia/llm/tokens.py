"""Token ids of whole texts by a public tokenizer, with the ids of text between single spaces kept.

A byte-level BPE with the usual expression splits a text before it merges, and always at a space between two other
characters. So the ids of a text without white space after a space are those of its space-separated parts, each with its
space in front. Other texts, and those that hold a special token's string, are encoded in one piece; so are all texts
where the tokenizer's file names another way of splitting.

Parts are told apart by Arrow, so that a batch looks each distinct one up once. At most ``most`` parts are kept; when
they are too many, those met in one batch only go, and of the others the rarer half if that isn't enough.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vacancia.llm.common import kept, ranges

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
_SPACES = re.compile(r" \s").search
PARTS = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def splits_at_spaces(tokenizer) -> bool:
    """Whether the tokenizer is a byte-level one that splits by the usual expression and changes no text before."""
    spec = json.loads(tokenizer.to_str())
    pre = spec.get("pre_tokenizer") or {}
    return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and spec.get("normalizer") is None


class Encoder:
    """Ids of texts, by the ids of their parts."""

    def __init__(self, path: str, most: int = PARTS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.by_parts = splits_at_spaces(self.tokenizer)
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that begin with a space
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.most = most
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.begin, self.length, self.met = (np.zeros(1 << 16, dtype=np.int64) for _ in range(3))
        self.used = 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        """Keeps the parts that were met in several batches, at most half of ``most``."""
        met = self.met[: len(self.known)]
        least = 2
        if (met >= least).sum() > self.most // 2:
            least = int(np.partition(met, len(met) - self.most // 2)[len(met) - self.most // 2]) + 1
        kept = np.flatnonzero(met >= least)
        names = list(self.known)
        self.known = {names[k]: i for i, k in enumerate(kept.tolist())}
        lengths = self.length[kept]
        ids = self.flat[ranges(self.begin[kept], lengths)]
        self.used = len(ids)
        self.flat[: self.used] = ids
        self.begin[: len(kept)], self.length[: len(kept)], self.met[: len(kept)] = np.cumsum(lengths) - lengths, lengths, met[kept] // 2 + 1

    def _after_space(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts with a space in front, part after part, and how many each has. Many are encoded as one text: each
        begins at an id that begins with a space, and no other id does."""
        together = ["".join(" " + p for p in parts[a : a + 200]) for a in range(0, len(parts), 200)]
        ids = np.fromiter(chain.from_iterable(self._ids(together)), dtype=np.uint32)
        return ids, np.diff(np.append(np.flatnonzero(self.spaced[ids]), len(ids)))

    def _learn(self, names: list[str], first: bool) -> None:
        """Keeps the ids of new parts; ``first``: those without a space in front, whose names have one instead."""
        for at in range(0, len(names), 20_000):
            some = names[at : at + 20_000]
            if first or "" in some:
                each = self._ids([x[1:] if first else " " + x for x in some])
                lengths = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
                ids = np.fromiter(chain.from_iterable(each), dtype=np.uint32, count=int(lengths.sum()))
            else:
                ids, lengths = self._after_space(some)
            n, k = len(ids), len(self.known)
            while self.used + n > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while k + len(some) > len(self.begin):
                self.begin, self.length, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length, self.met))
            self.flat[self.used : self.used + n] = ids
            self.begin[k : k + len(some)] = self.used + np.cumsum(lengths) - lengths
            self.length[k : k + len(some)] = lengths
            self.met[k : k + len(some)] = 0
            self.known.update(zip(some, range(k, k + len(some)), strict=True))
            self.used += n

    def _places(self, names: list[str], first: bool = False) -> np.ndarray:
        """Where the distinct ``names`` stand among the known parts; learns the new ones."""
        new = [n for n in names if n not in self.known]
        if "" in new:
            new.remove("")
            self._learn([""], first)
        if new:
            self._learn(new, first)
        return np.fromiter(map(self.known.__getitem__, names), dtype=np.int64, count=len(names))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and how many each text has."""
        whole = [i for i, t in enumerate(texts) if not self.by_parts or _SPACES(t) or any(s in t for s in self.special)]
        apart = set(whole)
        plain = [i for i, t in enumerate(texts) if t and i not in apart]
        sizes = np.zeros(len(texts), dtype=np.int64)
        index = np.zeros(0, dtype=np.int64)
        if plain:
            if len(self.known) > self.most:
                self._forget()
            parts = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
            count = np.diff(parts.offsets.to_numpy())
            first = np.cumsum(count) - count
            coded = parts.flatten().dictionary_encode()
            inner = coded.dictionary.to_pylist()
            code = coded.indices.to_numpy().astype(np.int64)
            # A text's first part has no space in front of it; it is kept under a name that no part can have.
            heads = list(dict.fromkeys(inner[k] for k in code[first].tolist()))
            head = dict(zip(heads, self._places([" " + h for h in heads], True).tolist(), strict=True))
            begins = np.fromiter((head[inner[k]] for k in code[first].tolist()), dtype=np.int64, count=len(plain))
            places = self._places(inner)
            index = places[code]
            index[first] = begins
            self.met[places] += 1
            sizes[plain] = count
        lengths = self.length[index]
        ids = self.flat[ranges(self.begin[index], lengths)]
        each = np.bincount(np.repeat(np.arange(len(texts)), sizes), weights=lengths, minlength=len(texts)).astype(np.int64)
        if not whole:
            return ids, each
        cut = np.split(ids, np.cumsum(each)[:-1])
        for i, found in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
            cut[i] = np.array(found, dtype=np.uint32)
            each[i] = len(found)
        return np.concatenate(cut), each


KEPT = "encoders"


def encoder(path: str, most: int = PARTS) -> Encoder:
    """One encoder a Python worker and size, kept between tasks whose kernels name ``KEPT``."""
    encoders = kept(KEPT, dict)
    if (path, most) not in encoders:
        encoders[path, most] = Encoder(path, most)
    return encoders[path, most]
