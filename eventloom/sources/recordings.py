"""Recording files: NPY arrays, block-wise channel files, event rows and folders, messages, log text.

Binary files are cut into ranges of rows that tasks read each by itself (see ``records``),
so a file of any size is read by many tasks. Text goes through Spark's own reader. Partial
rows and blocks are errors.
"""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.scalar import natural_key, parse_log
from eventloom.sources.records import files, filesystem, opened, ranged, written

# NPY arrays


def npy_header(raw: bytes) -> tuple[np.dtype, bool, tuple[int, ...], int]:
    """dtype, Fortran order, shape and offset of the data of an NPY file, version 1 to 3."""
    if raw[:6] != b"\x93NUMPY":
        raise ValueError("not an NPY file")
    wide = raw[6] > 1
    (n,) = struct.unpack_from("<I" if wide else "<H", raw, 8)
    at = 12 if wide else 10
    head = ast.literal_eval(raw[at : at + n].decode("utf-8" if raw[6] == 3 else "latin-1").strip())
    return np.dtype(head["descr"]), head["fortran_order"], tuple(head["shape"]), at + n


def npy_bytes(x: np.ndarray) -> bytes:
    head = repr({"descr": np.lib.format.dtype_to_descr(x.dtype), "fortran_order": False, "shape": x.shape}).encode()
    pad = -(10 + len(head) + 1) % 64
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head) + pad + 1) + head + b" " * pad + b"\n" + np.ascontiguousarray(x).tobytes()


def npy_array(raw: bytes) -> np.ndarray:
    dtype, fortran, shape, at = npy_header(raw)
    n = int(np.prod(shape, dtype=np.int64)) if shape else 1
    return np.frombuffer(raw, dtype, n, at).reshape(shape, order="F" if fortran else "C")


def _npy_head(f) -> tuple[np.dtype, bool, tuple[int, ...], int]:
    f.seek(0)
    return npy_header(f.read(1 << 16))


def _npy_rows(f, lo: int, hi: int) -> np.ndarray:
    """Rows lo to hi of an array; one in column order is gathered column by column."""
    dtype, fortran, shape, at = _npy_head(f)
    n, rest = (shape[0], tuple(shape[1:])) if shape else (1, ())
    width = int(np.prod(rest, dtype=np.int64))
    if not fortran or len(shape) < 2:
        f.seek(at + lo * width * dtype.itemsize)
        return np.frombuffer(f.read((hi - lo) * width * dtype.itemsize), dtype).reshape(hi - lo, width)
    out = np.empty((hi - lo, width), dtype)
    for k in range(width):
        f.seek(at + (k * n + lo) * dtype.itemsize)
        out[:, k] = np.frombuffer(f.read((hi - lo) * dtype.itemsize), dtype)
    return out if len(rest) < 2 else out.reshape(hi - lo, *rest[::-1]).transpose(0, *range(len(rest), 0, -1)).reshape(hi - lo, width)


def _npy_shape(f, path: str, length: int) -> tuple[int, int]:
    dtype, _, shape, at = _npy_head(f)
    n, size = (shape[0] if shape else 1), int(np.prod(shape[1:], dtype=np.int64)) * dtype.itemsize
    if length != at + n * size:
        raise ValueError(f"{path} doesn't hold its array")
    return n, size


def read_npy(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    """file, row (place in the first dimension) and values (the row's numbers) of NPY files."""

    def read(f, path: str, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        for a in range(lo, hi, 1 << 14):
            x = _npy_rows(f, a, min(a + (1 << 14), hi)).astype(np.float64)
            edge = pa.array(np.arange(0, x.size + 1, max(x.shape[1], 1)) if x.shape[1] else np.zeros(len(x) + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(x)), pa.array(np.arange(a, a + len(x))), pa.ListArray.from_arrays(edge, pa.array(x.ravel()))], ["file", "row", "values"])

    return ranged(files(spark, path, pattern), _npy_shape, read, "file string, row long, values array<double>")


def write_npy(df: DataFrame, folder: str, column: str) -> DataFrame:
    """An array column to NPY files, one a partition; returns file and n."""

    def encode(held: list[pa.RecordBatch]) -> bytes:
        return npy_bytes(np.concatenate([np.stack(b.column(0).to_numpy(zero_copy_only=False)) for b in held]).astype("<f8"))

    return written(df.select(column), folder, ".npy", encode)


# block-wise channel files: 1024 samples a block, big-endian

BLOCK_SAMPLES, BLOCK_BYTES, HEADER_BYTES, BLOCK_HEAD = 1024, 2070, 1024, 12


def _whole(what: str, size: int):
    def shape(f, path: str, length: int) -> tuple[int, int]:
        n, rest = divmod(length - HEADER_BYTES, size)
        if rest or n < 0:
            raise ValueError(f"{path} doesn't hold whole {what}")
        return n, size

    return shape


def read_continuous(spark: SparkSession, path: str, microvolts: float = 0.195) -> DataFrame:
    """file, timestamp of the block and its samples in microvolts."""

    def read(f, path: str, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        for a in range(lo, hi, 256):
            b = min(a + 256, hi)
            f.seek(HEADER_BYTES + a * BLOCK_BYTES)
            body = np.frombuffer(f.read((b - a) * BLOCK_BYTES), np.uint8).reshape(b - a, BLOCK_BYTES)
            stamp = np.ascontiguousarray(body[:, :8]).view("<i8").ravel()
            x = np.ascontiguousarray(body[:, BLOCK_HEAD : BLOCK_HEAD + 2 * BLOCK_SAMPLES]).view(">i2").astype(np.float64) * microvolts
            yield pa.RecordBatch.from_arrays([pa.array([path] * (b - a)), pa.array(stamp), pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * BLOCK_SAMPLES, pa.int32()), pa.array(x.ravel()))], ["file", "timestamp", "samples"])

    return ranged(files(spark, path, "*.continuous"), _whole("blocks", BLOCK_BYTES), read, "file string, timestamp long, samples array<double>")


def write_continuous(df: DataFrame, folder: str) -> DataFrame:
    """Blocks (timestamp, samples: 1024 16-bit integers) to channel files, one a partition."""

    def encode(held: list[pa.RecordBatch]) -> bytes:
        out = [bytes(HEADER_BYTES)]
        for b in held:
            for stamp, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(x) != BLOCK_SAMPLES:
                    raise ValueError(f"a block has {len(x)} samples")
                out.append(struct.pack("<qHH", stamp, BLOCK_SAMPLES, 0) + np.array(x, ">i2").tobytes() + bytes(BLOCK_BYTES - BLOCK_HEAD - 2 * BLOCK_SAMPLES))
        return b"".join(out)

    return written(df.select("timestamp", "samples"), folder, ".continuous", encode)


# digital and network events

EVENT = np.dtype([("timestamp", "<i8"), ("place", "<i2"), ("type", "u1"), ("processor", "u1"), ("state", "u1"), ("channel", "u1"), ("recording", "<u2")])
EVENT_SCHEMA = "file string, t double, timestamp long, type string, channel int, channel_name string, rising boolean, message string"


def _events(path: str, stamp: np.ndarray, start: int, fs: float, kind: str, channel: np.ndarray, rising: np.ndarray, message: list[str | None], names: list[str]) -> pa.RecordBatch:
    stamp = stamp.astype(np.int64) - start
    known = [names[c - 1] if 0 < c <= len(names) else None for c in channel.tolist()]
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(stamp), pa.string()), pa.array(stamp / fs), pa.array(stamp), pa.array([kind] * len(stamp), pa.string()), pa.array(channel, pa.int32()), pa.array(known, pa.string()), pa.array(rising, pa.bool_()), pa.array(message, pa.string())],
        ["file", "t", "timestamp", "type", "channel", "channel_name", "rising", "message"],
    )


def read_event_rows(spark: SparkSession, path: str, names: list[str] = (), start: int = 0, fs: float = 30000.0, pattern: str = "*.events") -> DataFrame:
    """Digital events in rows of 16 bytes after a header; channels count from 1. Message files are left out."""

    def read(f, path: str, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        for a in range(lo, hi, 1 << 16):
            b = min(a + (1 << 16), hi)
            f.seek(HEADER_BYTES + a * EVENT.itemsize)
            x = np.frombuffer(f.read((b - a) * EVENT.itemsize), EVENT)
            yield _events(path, x["timestamp"], start, fs, "Dig", x["channel"].astype(np.int32) + 1, x["state"] > 0, [None] * len(x), list(names))

    found = files(spark, path, pattern).where(~F.col("path").endswith("messages.events"))
    return ranged(found, _whole("events", EVENT.itemsize), read, EVENT_SCHEMA)


def write_event_rows(df: DataFrame, folder: str) -> DataFrame:
    """timestamp, channel (from 1) and rising to files of 16-byte rows, one a partition."""

    def encode(held: list[pa.RecordBatch]) -> bytes:
        x = np.zeros(sum(b.num_rows for b in held), EVENT)
        stamp, channel, rising = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(3))
        x["timestamp"], x["channel"], x["state"] = stamp, channel - 1, rising
        return bytes(HEADER_BYTES) + x.tobytes()

    return written(df.select("timestamp", "channel", "rising"), folder, ".events", encode)


def read_event_folders(spark: SparkSession, path: str, names: list[str] = (), start: int = 0, fs: float = 30000.0) -> DataFrame:
    """Events of folders with ``sample_numbers.npy``: network events where ``text.npy`` stands beside it, else digital ones of ``states.npy``, whose sign is the direction."""

    def read(f, path: str, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        folder = path[: path.rindex("/")]
        fs_, at = filesystem(folder)
        network = fs_.get_file_info(f"{at}/text.npy").is_file
        with opened(f"{folder}/{'text' if network else 'states'}.npy") as other:
            for a in range(lo, hi, 1 << 16):
                b = min(a + (1 << 16), hi)
                stamp, x = _npy_rows(f, a, b)[:, 0], _npy_rows(other, a, b)[:, 0]
                if network:
                    text = [v.decode() if isinstance(v, bytes) else v for v in x.tolist()]
                    yield _events(path, stamp, start, fs, "Net", np.zeros(len(x), np.int32), np.ones(len(x), bool), text, [])
                else:
                    yield _events(path, stamp, start, fs, "Dig", np.abs(x).astype(np.int32), x > 0, [None] * len(x), list(names))

    return ranged(files(spark, path, "sample_numbers.npy"), _npy_shape, read, EVENT_SCHEMA)


def read_messages(spark: SparkSession, path: str, fs: float = 30000.0) -> DataFrame:
    """Network events of ``messages.events`` texts: lines ``number, message``, of which the second gives the start and those from the fourth on are events."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "messages.events").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.expr(r"regexp_extract_all(value, '(?m)^(\\d+), (.+?)$', 0)").alias("lines"))
    number = lambda c: F.regexp_extract(c, r"^(\d+), ", 1).cast("long")
    rows = lines.select("file", number(F.col("lines")[1]).alias("start"), F.posexplode("lines").alias("k", "line")).where("k >= 3")
    stamp: Column = number(F.col("line")) - F.col("start")
    return rows.select("file", (stamp / F.lit(fs)).alias("t"), stamp.alias("timestamp"), F.lit("Net").alias("type"), F.lit(0).alias("channel"), F.lit(None).cast("string").alias("channel_name"), F.lit(True).alias("rising"), F.regexp_extract("line", r"^\d+, (.+?)$", 1).alias("message"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """ticks, name, type, value and message of log lines."""
    lines = spark.read.text(path)
    return lines.select(*[c.alias(n) for n, c in parse_log(F.col("value")).items()])


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files under a path in natural order: path, name, length and time of change."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "modificationTime", "length")
    return f.withColumn("name", F.element_at(F.split("path", "/"), -1)).orderBy(natural_key(F.col("path")))


def save_table(df: DataFrame, name: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).saveAsTable(name)


def load_evolved(spark: SparkSession, paths: list[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Tables of older and newer schema together: missing columns are null, or take a default."""
    out = None
    for p in paths:
        df = spark.read.parquet(p)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.na.fill(defaults) if defaults else out
