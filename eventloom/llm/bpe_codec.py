"""Operator 8: byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are pre-split at safe boundaries, places where a match of the pattern begins and
no white space comes before, so memory and the library's recursion stay bounded and the ids
are those of the whole text. A run of white space of ``RUN`` characters or more, on which
the library's expression would recurse, is cut to its matches here and each is encoded by
itself. Ids and decoded bytes of a text go into running digests piece by piece. Decoding
joins raw token bytes, so tokens that hold parts of a character come back exactly.

Defined cases: null text counts as empty (no ids, empty bytes); an empty table gives an
empty one; texts of any length are encoded whole; special strings are ordinary text;
repeated rows are encoded each, ties don't arise; further columns are dropped.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .frames import mapped
from .pretokens import PIECE, safe_cuts
from .textops import chunked, utf8

#: White-space characters in a row from which on a run is cut here.
RUN = 4096
_RUN = regex.compile(r"\s{%d,}" % RUN)


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[tuple[str, bool]]:
    """Stretches of a text in order, and whether each is one match to be encoded as it is."""
    for lo, hi in safe_cuts(text) if len(text) > PIECE else ((0, len(text)),):
        at, part = 0, text[lo:hi]
        for run in _RUN.finditer(part):
            a, b = run.span()
            if b < len(part):
                b -= 1  # the last white space of a run stands apart, or joins what follows
            yield part[at:a], False
            yield part[a:b], True
            at = b
        yield part[at:], False


def encode_pieces(text: str | None, path: str, pattern: str) -> Iterator[list[int]]:
    """The ids of a text, in order, in lists of bounded length."""
    enc = encoding(path, pattern)
    for piece, whole in pieces(text or ""):
        if piece:
            yield enc._encode_single_piece(piece) if whole else enc.encode_ordinary(piece)


def encode(text: str | None, path: str, pattern: str) -> list[int]:
    return [i for ids in encode_pieces(text, path, pattern) for i in ids]


def decode(ids: list[int], path: str, pattern: str) -> bytes:
    return encoding(path, pattern).decode_bytes(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 (and ids as an array) of every row; no shuffle."""

    def run(batch: pa.RecordBatch):
        column = batch.column(1)
        _, offsets = utf8(column)
        for lo, hi in chunked(offsets):
            count, of_ids, of_bytes, kept = [], [], [], []
            for t in column.slice(lo, hi - lo).to_pylist():
                n, id_digest, byte_digest, own = 0, sha256(), sha256(), []
                for ids in encode_pieces(t, path, pattern):
                    n += len(ids)
                    raw = np.array(ids, "<u4")
                    id_digest.update(raw)
                    byte_digest.update(decode(ids, path, pattern))
                    if with_ids:
                        own.append(raw.astype(np.int32))
                count.append(n)
                of_ids.append(id_digest.hexdigest())
                of_bytes.append(byte_digest.hexdigest())
                if with_ids:
                    kept.append(np.concatenate(own) if own else np.zeros(0, np.int32))
            out = [batch.column(0).slice(lo, hi - lo), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return mapped(docs.select(docs[key].alias("key"), docs[text].alias("text")), run, schema).withColumnRenamed("key", key)
