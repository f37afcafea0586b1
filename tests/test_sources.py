import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from eventloom.sources import recordings as R
from eventloom.sources import records as T

TYPE = "1(time:1i8,pose:1(pos:(x,y,z)3f4,state:(Idle:0,Walk:1)1i4)16,seen:1b4,held:((flags)Left:1,Right:2)1u1,gaze:(x,y)2f4,name:6c1,level:2f8)59"


def test_type_grammar():
    t = T.parse_type(TYPE)
    own = T.leaves(t)
    assert [f.name for f in own] == ["Time", "PosePos", "PoseState", "Seen", "Held", "Gaze", "Name", "Level"]
    assert t.size == T.layout(own).itemsize == 8 + 16 + 4 + 1 + 8 + 6 + 16
    assert T.schema(own).simpleString() == "struct<Time:bigint,PosePos:array<float>,PoseState:string,Seen:boolean,Held:string,Gaze:array<float>,Name:string,Level:array<double>>"
    assert [f.name for f in T.leaves(t, True)][1:5] == ["PosePosX", "PosePosY", "PosePosZ", "PoseState"]
    assert [f.name for f in T.leaves(T.parse_type("1(eye:(left,right)2(1(a:1i4,b:1i4)8)16)16"))] == ["EyeLeftA", "EyeLeftB", "EyeRightA", "EyeRightB"]
    like = T.leaves(T.parse_type("1(k:(One:1,Two:2)1i4)4"))[0]
    assert like.mode == "like" and T.schema([like]).simpleString() == "struct<K:int>"
    for bad in ("a", "a:1zz4", "1(b:1i4", "1(b:1i4))4", ":i4", "(x,y)3f4", "3(1(a:1i4)4)12"):
        with pytest.raises(ValueError):
            T.parse_type(bad)


def test_record_files_round_trip(spark, tmp_path):
    rows = [(k, [float(k), k + 0.5, -float(k)], "Walk" if k % 2 else "Idle", k % 3 == 0, ["", "Left", "Right", "Left_Right"][k % 4], [0.25, float(k)], "näm"[: k % 4], [k / 7, 1.0]) for k in range(100)]
    frame = spark.createDataFrame(rows, T.schema(T.leaves(T.parse_type(TYPE)))).repartition(3)
    n = T.write_records(frame, f"file://{tmp_path}/r", TYPE).collect()
    assert sum(r.n for r in n) == 100
    raw = (tmp_path / "r" / n[0].file).read_bytes()
    size = 8 + struct.unpack_from("<H", raw, 6)[0]
    assert raw[:6] == bytes([2, 66, 73, 78, 1, 0]) and size & size - 1 == 0 and raw[8:size].rstrip(b"\0") == TYPE.encode() + b"\n" and len(raw) == size + n[0].n * 59
    got = sorted(tuple(r)[1:] for r in T.read_records(spark, f"file://{tmp_path}/r").collect())
    assert got == rows
    (tmp_path / "p.bin").write_bytes(raw + b"\1")
    with pytest.raises(Exception, match="whole rows"):
        T.read_records(spark, f"file://{tmp_path}/p.bin").collect()
    head = T.header("1(a:(x:0,y:5)1i4)4")
    (tmp_path / "bad.bin").write_bytes(head + struct.pack("<i", 6))
    with pytest.raises(Exception, match="undecodable"):
        T.read_records(spark, f"file://{tmp_path}/bad.bin").collect()
    (tmp_path / "none.bin").write_bytes(head)
    assert T.read_records(spark, f"file://{tmp_path}/none.bin").count() == 0


def test_ranges_of_large_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "RANGE", 100)
    text = "1(a:1i4)4"
    (tmp_path / "a.bin").write_bytes(T.header(text) + np.arange(1000, dtype="<i4").tobytes())
    assert sorted(r.A for r in T.read_records(spark, f"file://{tmp_path}").collect()) == list(range(1000))


def test_events_of_rows_folders_and_messages(spark, tmp_path):
    stamp, channel, state = [100, 130, 190], [0, 2, 0], [1, 1, 0]
    raw = b"".join(struct.pack("<qhBBBBH", s, 0, 3, 1, v, c, 0) for s, c, v in zip(stamp, channel, state, strict=True))
    (tmp_path / "all.events").write_bytes(bytes(1024) + raw)
    (tmp_path / "messages.events").write_text("0, Software time\n100, start time: 100@30000Hz\n100, Processor\n160, hello there\n220, trial 2, left\n")
    got = sorted(tuple(r)[1:] for r in R.read_event_rows(spark, f"file://{tmp_path}", ["ttl", "x", "pulse"], 100, 10.0).collect())
    assert got == [(0.0, 0, "Dig", 1, "ttl", True, None), (3.0, 30, "Dig", 3, "pulse", True, None), (9.0, 90, "Dig", 1, "ttl", False, None)]
    assert [tuple(r)[1:] for r in R.read_messages(spark, f"file://{tmp_path}", 10.0).collect()] == [(6.0, 60, "Net", 0, None, True, "hello there"), (12.0, 120, "Net", 0, None, True, "trial 2, left")]
    (tmp_path / "bad.events").write_bytes(bytes(1024) + raw[:-1])
    with pytest.raises(Exception, match="whole events"):
        R.read_event_rows(spark, f"file://{tmp_path}", pattern="bad.events").collect()
    for name, other in (("TTL", ("states", np.array([1, -3, 2], "<i2"))), ("net", ("text", np.array([b"go", b"stop", b""])))):
        (tmp_path / name).mkdir()
        np.save(tmp_path / name / "sample_numbers.npy", np.array([5, 7, 9]))
        np.save(tmp_path / name / f"{other[0]}.npy", other[1])
    got = sorted(tuple(r)[2:] for r in R.read_event_folders(spark, f"file://{tmp_path}", ["a", "b", "c"]).collect())
    assert got == [(5, "Dig", 1, "a", True, None), (5, "Net", 0, None, True, "go"), (7, "Dig", 3, "c", False, None), (7, "Net", 0, None, True, "stop"), (9, "Dig", 2, "b", True, None), (9, "Net", 0, None, True, "")]


@settings(max_examples=60, deadline=None)
@given(hnp.arrays(st.sampled_from(["<f8", "<i4", ">i2", "|u1", "|S3"]), hnp.array_shapes(max_dims=3, max_side=4)), st.booleans())
def test_npy(x, fortran):
    import io

    raw = io.BytesIO()
    np.save(raw, np.asfortranarray(x) if fortran else x)
    assert (R.npy_array(raw.getvalue()) == x).all() or x.dtype.kind == "f"
    back = np.load(io.BytesIO(R.npy_bytes(x)))
    assert back.dtype == x.dtype and back.tobytes() == x.tobytes()


def test_npy_and_continuous_tables(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6).reshape(3, 2))
    assert sorted((r.row, r["values"]) for r in R.read_npy(spark, f"file://{tmp_path}").collect()) == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]
    block = lambda k: struct.pack("<qHH", 1000 + k * 1024, 1024, 0) + (np.arange(1024) + k).astype(">i2").tobytes() + bytes(10)
    (tmp_path / "ch1.continuous").write_bytes(bytes(1024) + block(0) + block(1))
    rows = sorted(R.read_continuous(spark, f"file://{tmp_path}", 2.0).collect(), key=lambda r: r.timestamp)
    assert [r.timestamp for r in rows] == [1000, 2024] and rows[1].samples[:2] == [2.0, 4.0] and len(rows[0].samples) == 1024
    (tmp_path / "ch2.continuous").write_bytes(bytes(1024) + block(0) + b"part")
    with pytest.raises(Exception, match="whole blocks"):
        R.read_continuous(spark, f"file://{tmp_path}").collect()


@pytest.mark.parametrize("fortran", [False, True])
def test_npy_ranges(spark, tmp_path, monkeypatch, fortran):
    monkeypatch.setattr(T, "RANGE", 64)
    x = np.arange(120.0).reshape(20, 3, 2)
    np.save(tmp_path / "a.npy", np.asfortranarray(x) if fortran else x)
    rows = sorted((r.row, r["values"]) for r in R.read_npy(spark, f"file://{tmp_path}").collect())
    assert rows == [(i, x[i].ravel().tolist()) for i in range(20)]


def test_log_listing_and_evolution(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/Log.txt").write_text("[12] speed (Double) = 3.5\n[13] hello there\nrubbish\n")
    rows = R.read_log(spark, f"file://{tmp_path}/log").collect()
    assert [tuple(r) for r in rows] == [(12, "speed", "Double", "3.5", None), (13, None, None, None, "hello there"), (None, None, None, None, "")]
    for n in (10, 2, 1):
        (tmp_path / f"x{n}.dat").write_bytes(b"1")
    assert [r.name for r in R.listing(spark, f"file://{tmp_path}", "*.dat").collect()] == ["x1.dat", "x2.dat", "x10.dat"]
    spark.range(2).write.parquet(f"{tmp_path}/old")
    spark.range(2).selectExpr("id", "id * 2 as more").write.parquet(f"{tmp_path}/new")
    got = R.load_evolved(spark, [f"{tmp_path}/old", f"{tmp_path}/new"], {"more": -1})
    assert sorted(tuple(r) for r in got.collect()) == [(0, -1), (0, 0), (1, -1), (1, 2)]
