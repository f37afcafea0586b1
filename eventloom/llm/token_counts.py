"""Operator 7: token counts by rank-synchronous array merging.

A byte-level BPE vocabulary is applied to batches of distinct pre-tokens held as one
ragged numpy array. In each round every sequence merges all (left to right, not
overlapping) occurrences of its own lowest-ranked pair at once; sequences without a
mergeable pair leave the batch, and their surviving symbols are counted. Merging all
occurrences of the lowest-ranked pair equals merging them one after another, because a
merge can only make pairs of a higher rank.

Defined cases: null text counts as empty (0 bytes, 0 tokens); an empty table gives an empty
one; texts of any length are counted whole, piece by piece; special strings in a text are
one token each, as the vocabulary file's library treats them by default; equal ranks don't
occur; repeated rows are counted each; further columns of the input are dropped. Files of
another kind (see ``byte_level``) are an error.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .frames import mapped
from .pretokens import Pretokens
from .textops import utf8

_NONE = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabulary files.

    Printable Latin-1 bytes stand for themselves; the others get code points from 256 on.
    """
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


def byte_level(spec: dict) -> dict:
    """The file's content, if it is the plain byte-level kind that the cut and the merges here stand for."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        spec.get("normalizer") is None
        and cut.get("type") == "ByteLevel"
        and not cut.get("add_prefix_space", True)
        and cut.get("use_regex", True)
        and model.get("type", "BPE") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        and not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip"))
    )
    if not plain:
        raise ValueError("not a plain byte-level BPE file: another normaliser, pre-tokeniser, model or special-token flag")
    return spec


class MergeTable:
    """Ranks of pairs of symbols, looked up for whole arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = byte_level(json.load(f))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.byte = np.array([vocab[s] for s in byte_symbols()], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def count(self, tokens: list[str]) -> list[int]:
        """Symbols that survive of each pre-token."""
        raw = [t.encode() for t in tokens]
        length = np.array([len(r) for r in raw], np.int64)
        out = length.copy()
        live = np.flatnonzero(length > 1)
        if not len(live):
            return out.tolist()
        sym = self.byte[np.frombuffer(b"".join([raw[i] for i in live]), np.uint8)]
        size = length[live]
        row = np.repeat(np.arange(len(live)), size)
        rank = np.full(len(sym), _NONE)
        inner = np.flatnonzero(row[:-1] == row[1:])
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        while len(sym):
            begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            size = np.diff(np.r_[begin, len(row)])
            least = np.minimum.reduceat(rank, begin)
            out[live[row[begin]]] = size
            going = np.repeat(least < _NONE, size)
            if not going.all():
                sym, row, rank = sym[going], row[going], rank[going]
                size, least = size[least < _NONE], least[least < _NONE]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            fresh = np.r_[True, np.diff(hit) != 1]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]  # of aaa, the first two
            sym[hit] = self.merged[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            moved = hit - np.arange(len(hit))  # one symbol less for each merge before
            sym, row, rank = sym[keep], row[keep], rank[keep]
            near = np.r_[moved, moved[moved > 0] - 1]
            rank[near] = _NONE
            near = near[near + 1 < len(row)]
            near = near[row[near] == row[near + 1]]
            rank[near] = self.ranks(sym[near], sym[near + 1])
        return out.tolist()


@lru_cache(maxsize=2)
def _counter(path: str) -> Pretokens:
    table = MergeTable(path)

    def solve(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.array(table.count(tokens), np.int64), np.ones(len(tokens), np.int64)

    return Pretokens(dict.fromkeys(table.special, 1), solve)


def token_counts(docs: DataFrame, path: str, limit: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    One narrow pass: nothing is shuffled, a worker holds one batch and its bounded cache.
    """

    def run(batch: pa.RecordBatch):
        column = batch.column(1)
        _, offsets = utf8(column)
        n = np.zeros(batch.num_rows, np.int64)
        for lo, hi, values, bounds in _counter(path).chunks(column):
            if len(bounds) == 1:  # part of a long text
                n[lo] += values.sum()
            else:
                n[lo:hi] += np.diff(np.r_[0, np.cumsum(values)][bounds])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pc.greater(pa.array(n), limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(docs[key].alias("key"), docs[text].alias("text")), run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
