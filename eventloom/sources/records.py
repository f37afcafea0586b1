"""Self-describing record files: a prefix, a textual type, then rows of fixed width.

The first eight bytes are a mark, a version and the header's length; the header is a type
text, padded with zeros. A type is ``name:(comment)length code bytes``, where the code is a
letter of a number's kind or a list of types in parentheses, and the comment names parts
(``x,y``), values of an enumeration (``Idle:0,Walk:1``) or bits (``(flags)Seen:1,Held:2``).

Reading takes two passes: tasks read the headers and cut files into ranges of whole rows,
then ranges are dealt over the cluster and each is read by itself, so neither a file's size
nor their number bounds the job. Writing makes one file a partition, renamed when whole.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Mark, version and the kinds' codes.
MARK, VERSION = b"\x02BIN", (1, 0)
KINDS = {"b4": T.BooleanType(), "c1": T.StringType(), "i1": T.ByteType(), "u1": T.ShortType(), "i2": T.ShortType(), "u2": T.IntegerType(), "i4": T.IntegerType(), "u4": T.LongType(), "i8": T.LongType(), "u8": T.DecimalType(20, 0), "f4": T.FloatType(), "f8": T.DoubleType()}
#: Parts that stay one array.
VECTORS = (("x", "y"), ("x", "y", "z"))
#: Bytes of a range that one task reads.
RANGE = 32 << 20


@dataclass
class Type:
    """A number or text, an array of them, or a structure of parts."""

    name: str = ""
    kind: str = ""
    length: int = 1
    mode: str = ""  # enum, flags, or like (values that stay numbers)
    names: dict[int, str] = field(default_factory=dict)
    parts: list[Type] = field(default_factory=list)

    @property
    def size(self) -> int:
        return sum(p.size for p in self.parts) if self.parts else self.length * int(self.kind[1])


_NAME, _LENGTH, _KIND = re.compile(r"(?:([A-Za-z_]\w*):?)?"), re.compile(r"\d+"), re.compile(r"[buicf]\d+")
_CONSTANT = re.compile(r"([A-Za-z_]\w*)(?::(-?\d+))?")


def _closing(s: str, at: int) -> int:
    depth = 0
    for i in range(at, len(s)):
        depth += (s[i] == "(") - (s[i] == ")")
        if not depth:
            return i
    raise ValueError("a parenthesis is open")


def _item(s: str, at: int) -> tuple[Type, int]:
    m = _NAME.match(s, at)
    out, at, comment = Type(m.group(1) or ""), m.end(), None
    if s[at : at + 1] == "(":
        end = _closing(s, at)
        comment, at = s[at + 1 : end], end + 1
    m = _LENGTH.match(s, at)
    if m is None:
        raise ValueError(f"a length is missing at {s[at:]!r}")
    length, at = int(m.group()), m.end()
    if s[at : at + 1] == "(":
        at += 1
        while True:
            part, at = _item(s, at)
            out.parts.append(part)
            if s[at : at + 1] == ")":
                break
            if s[at : at + 1] != ",":
                raise ValueError(f"unexpected {s[at:]!r}")
            at += 1
        m = _LENGTH.match(s, at + 1)
        if m is None:
            raise ValueError("a structure's bytes are missing")
        at = m.end()
    else:
        m = _KIND.match(s, at)
        if m is None or m.group() not in KINDS:
            raise ValueError(f"unknown kind at {s[at:]!r}")
        out.kind, out.length, at = m.group(), length, m.end()
    if comment is not None:
        flags = comment.startswith("(flags)")
        constants = _CONSTANT.findall(comment.removeprefix("(flags)"))
        if not constants:
            raise ValueError(f"invalid comment {comment!r}")
        if constants[0][1]:
            out.names = {int(v): n for n, v in constants}
            out.mode = "flags" if flags else "enum" if int(constants[0][1]) == 0 else "like"
        else:
            if out.parts and len(out.parts) != 1 or len(constants) != length:
                raise ValueError(f"comment {comment!r} doesn't fit")
            one = out.parts[0] if out.parts else Type(kind=out.kind)
            out.parts, out.kind, out.length = [replace(one, name=n) for n, _ in constants], "", 1
    elif out.parts and length != 1:
        raise ValueError("an array of structures needs names")
    return out, at


def parse_type(text: str) -> Type:
    out, at = _item(text, 0)
    if at != len(text):
        raise ValueError(f"unexpected {text[at:]!r}")
    return out


def _capital(name: str) -> str:
    return name[:1].upper() + name[1:]


def leaves(t: Type, flat_vectors: bool = False) -> list[Type]:
    """Columns of a type: names of parts are joined to their structure's, each with a capital."""
    t = replace(t, name=_capital(t.name))
    kinds = {p.kind for p in t.parts}
    if not flat_vectors and tuple(p.name for p in t.parts) in VECTORS and kinds == {"f4"} and all(p.length == 1 for p in t.parts):
        return [replace(t, kind="f4", length=len(t.parts), parts=[])]
    if not t.parts:
        return [t]
    return [replace(p, name=t.name + p.name if p.name else "_") for part in t.parts for p in leaves(part, flat_vectors)]


def layout(columns: list[Type]) -> np.dtype:
    def one(t: Type) -> tuple:
        if t.kind == "c1":
            return (t.name, f"S{t.length}")
        kind = "<i4" if t.kind == "b4" else f"<{t.kind}"
        return (t.name, kind, (t.length,)) if t.length > 1 else (t.name, kind)

    return np.dtype([one(t) for t in columns])


def schema(columns: list[Type]) -> T.StructType:
    out = T.StructType()
    for t in columns:
        kind = T.StringType() if t.mode in ("enum", "flags") else KINDS[t.kind]
        out.add(t.name, T.ArrayType(kind) if t.length > 1 and t.kind != "c1" else kind)
    return out


def decoded(t: Type, x: np.ndarray) -> pa.Array:
    """A column's values; a value that an enumeration lacks is an error."""
    if t.kind == "c1":
        return pa.array([v.replace(b"\0", b"").decode() for v in x.tolist()], pa.string())
    flat = x.ravel()
    if t.mode == "enum":
        own, place = np.unique(flat, return_inverse=True)
        unknown = [v for v in own.tolist() if v not in t.names]
        if unknown:
            raise ValueError(f"undecodable values {unknown} of {t.name}")
        values = pa.array([t.names[v] for v in own.tolist()], pa.string()).take(pa.array(place.ravel()))
    elif t.mode == "flags":
        own, place = np.unique(flat, return_inverse=True)
        values = pa.array(["_".join(n for bit, n in t.names.items() if v & bit) for v in own.tolist()], pa.string()).take(pa.array(place.ravel()))
    elif t.kind == "b4":
        values = pa.array(flat != 0)
    else:
        kind = {"u1": pa.int16(), "u2": pa.int32(), "u4": pa.int64(), "u8": pa.decimal128(20, 0)}.get(t.kind)
        values = pa.array(flat).cast(kind) if kind is not None else pa.array(flat)
    return values if t.length == 1 else pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, t.length), pa.int32()), values)


def encoded(t: Type, column: pa.Array) -> np.ndarray:
    """The reverse. Texts are cut to their length; nulls aren't stored and are an error."""
    if column.null_count:
        raise ValueError(f"null in {t.name}")
    if t.kind == "c1":
        return np.array([v.encode()[: t.length] for v in column.to_pylist()], f"S{t.length}")
    flat = column.flatten() if t.length > 1 else column
    if t.mode == "enum":
        back = {n: v for v, n in t.names.items()}
        values = [back[n] for n in flat.to_pylist()]
    elif t.mode == "flags":
        back = {n: v for v, n in t.names.items()}
        values = [sum(back[n] for n in text.split("_") if n) for text in flat.to_pylist()]
    else:
        values = flat.to_numpy(zero_copy_only=False) if t.kind != "u8" else [int(v) for v in flat.to_pylist()]
    x = np.array(values, "<i4" if t.kind == "b4" else f"<{t.kind}")
    return x.reshape(-1, t.length) if t.length > 1 else x


def header(text: str) -> bytes:
    """Prefix and type text, filled up to a power of two."""
    raw = text.encode() + b"\n"
    size = 1 << (len(raw) + 7).bit_length()
    return MARK + bytes(VERSION) + struct.pack("<H", size - 8) + raw.ljust(size - 8, b"\0")


def read_header(f) -> tuple[str, int]:
    """Type text and offset of the rows."""
    head = f.read(8)
    if head[:4] != MARK:
        raise ValueError("not a record file")
    if tuple(head[4:6]) != VERSION:
        raise ValueError(f"unsupported version {head[4]}.{head[5]}")
    (n,) = struct.unpack("<H", head[6:8])
    return f.read(n).rstrip(b"\0").decode().strip(), n + 8


# files, ranges and folders


def opened(path: str):
    """A file of any store that pyarrow knows, to be read from any place."""
    fs, at = filesystem(path)
    return fs.open_input_file(at)


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path if ":/" in path else f"file://{path}"))


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path and length of files; their content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length")


def ranges(found: DataFrame, shape: Callable[[object, str, int], tuple[int, int]]) -> DataFrame:
    """path, first and last row of ranges of about ``RANGE`` bytes; shape gives a file's rows and a row's bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(path) as f:
                    n, size = shape(f, path, length)
                lo = np.arange(0, n, max(1, RANGE // max(size, 1)))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(lo), pa.string()), pa.array(lo), pa.array(np.r_[lo[1:], n][: len(lo)])], ["path", "lo", "hi"])

    spark = found.sparkSession
    return found.mapInArrow(cut, "path string, lo long, hi long").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "lo")


def ranged(found: DataFrame, shape: Callable, read: Callable[[object, str, int, int], Iterator[pa.RecordBatch]], out) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened(path) as f:
                    yield from read(f, path, lo, hi)

    return ranges(found, shape).mapInArrow(run, out)


def written(df: DataFrame, folder: str, suffix: str, encode: Callable[[list[pa.RecordBatch]], bytes]) -> DataFrame:
    """One file a partition that has rows; returns file and n. A file appears under its name only when whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        fs, at = filesystem(folder)
        name = f"part-{TaskContext.get().partitionId():06d}{suffix}"
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(own := f"{at}/.{name}.{uuid.uuid4().hex}") as f:
            f.write(encode(held))
        fs.move(own, f"{at}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sum(b.num_rows for b in held)])], ["file", "n"])

    return df.mapInArrow(run, "file string, n long")


def read_records(spark: SparkSession, path: str, flat_vectors: bool = False, pattern: str = "*.bin") -> DataFrame:
    """Rows of all record files under a path, which share one type; adds the column ``file``. A partial row is an error."""
    found = files(spark, path, pattern)
    first = found.first()
    if first is None:
        raise ValueError(f"no file under {path}")
    with opened(first["path"]) as f:
        columns = leaves(parse_type(read_header(f)[0]), flat_vectors)
    dtype = layout(columns)

    def shape(f, path: str, length: int) -> tuple[int, int]:
        text, at = read_header(f)
        if layout(leaves(parse_type(text), flat_vectors)) != dtype:
            raise ValueError(f"{path} has another type")
        if (length - at) % dtype.itemsize:
            raise ValueError(f"{path} doesn't hold whole rows")
        return (length - at) // dtype.itemsize, dtype.itemsize

    def read(f, path: str, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        _, at = read_header(f)
        for a in range(lo, hi, 1 << 16):
            b = min(a + (1 << 16), hi)
            f.seek(at + a * dtype.itemsize)
            x = np.frombuffer(f.read((b - a) * dtype.itemsize), dtype)
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(x)), *(decoded(t, x[t.name]) for t in columns)], ["file", *(t.name for t in columns)])

    return ranged(found, shape, read, T.StructType([T.StructField("file", T.StringType()), *schema(columns).fields]))


def write_records(df: DataFrame, folder: str, text: str) -> DataFrame:
    """Rows to record files of a type, whose leaves name the columns; nulls are an error. Returns file and n."""
    columns = leaves(parse_type(text))
    dtype = layout(columns)

    def encode(held: list[pa.RecordBatch]) -> bytes:
        rows = pa.Table.from_batches(held).combine_chunks()
        x = np.zeros(rows.num_rows, dtype)
        for t in columns:
            x[t.name] = encoded(t, rows.column(t.name).combine_chunks() if isinstance(rows.column(t.name), pa.ChunkedArray) else rows.column(t.name))
        return header(text) + x.tobytes()

    return written(df.select(*[t.name for t in columns]), folder, ".bin", encode)
