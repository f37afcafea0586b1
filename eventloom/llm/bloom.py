"""A Bloom filter of bounded size over a column of ids, built in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import mix

#: log2 of the bits: 16 bits an id, from 512 kB to 8 MB. Beyond half a million ids the filter lets
#: more and more through that it need not, but never holds back what it must let pass.
LEAST_BITS, MOST_BITS = 22, 26
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _places(ids: np.ndarray, log_bits: int) -> list[np.ndarray]:
    return [mix(ids.astype(np.uint64) ^ np.uint64(s)) >> np.uint64(64 - log_bits) for s in _SEEDS]


def bloom(ids: DataFrame, column: str) -> np.ndarray:
    """Bits of the filter; at most 2**MOST_BITS / 64 words reach the driver. ``ids`` is read twice."""
    import pyarrow as pa

    from .frames import mapped

    log_bits = min(max((16 * ids.count()).bit_length(), LEAST_BITS), MOST_BITS)

    def run(batch: pa.RecordBatch):
        bits = np.unique(np.concatenate(_places(batch.column(0).to_numpy(zero_copy_only=False), log_bits)))
        word, bit = bits // np.uint64(64), bits % np.uint64(64)
        own, first = np.unique(word, return_index=True)
        value = np.bitwise_or.reduceat(np.uint64(1) << bit, first) if len(own) else bit
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(value.view(np.int64))], ["word", "bits"])

    words = mapped(ids.select(column), run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << log_bits - 6, np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return out


def may_hold(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.ones(len(ids), bool)
    for p in _places(ids, len(bits).bit_length() + 5):
        out &= (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out
