import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import bpe_codec, pretokens, token_counts, token_files

from .common import docs_frame

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


def texts():
    rng = random.Random(2)
    parts = ["don't", "I'LL we'll", " été", "　x", "naïve\n\n  a", "<|endoftext|>", "🙂🙂", "١٢٣ 45", "\x00\x1c", "aaaaaaaaaaaaaaaaaaaaab", "'s'", "\t", "  "]
    out = [None, "", " ", "'", "a" * 5000, "<|endoftext|>", "x<|endoftext|> y", "word " * 900_000]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(120)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def test_cut_is_the_patterns():
    assert pretokens.PATTERN == P.PATTERN
    find = regex.compile(P.PATTERN).findall
    for t in texts()[1:7] + texts()[8:]:
        at = pretokens.starts(np.frombuffer(t.encode("utf-32-le"), np.uint32), np.array([0, len(t)])).tolist()
        assert [t[a:b] for a, b in zip(at, [*at[1:], len(t)], strict=False)] == find(t)


def settled(c):
    """Whether both editions of Unicode class a character alike."""
    return (pretokens._classes()[ord(c)] in (1, 2)) == bool(regex.match(r"[\p{L}\p{N}]", c))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" '\n\tstremvlld1é²٣!-aZ　"), st.characters(codec="utf-8").filter(settled)), max_size=12), max_size=4))
def test_cut_keeps_texts_apart(parts):
    find = regex.compile(P.PATTERN).finditer
    whole, bounds = "".join(parts), np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
    got = pretokens.starts(np.frombuffer(whole.encode("utf-32-le"), np.uint32), bounds).tolist()
    assert got == [int(b) + m.start() for b, p in zip(bounds, parts, strict=False) for m in find(p)]


def test_counts_are_the_librarys(spark, library):
    docs = list(enumerate(texts()))
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in docs}
    rows = token_counts.token_counts(docs_frame(spark, docs), JSON, 1024).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == want
    assert all(r.n_bytes == len((docs[r.doc_id][1] or "").encode()) and r.over_limit == (r.n_tokens > 1024) for r in rows)


def test_counts_of_repeated_rows_and_no_rows(spark):
    rows = token_counts.token_counts(docs_frame(spark, [(1, "a b"), (1, "a b"), (None, "a b")]), JSON, 1).collect()
    assert [r.n_tokens for r in rows] == [2, 2, 2] and all(r.over_limit for r in rows)
    assert token_counts.token_counts(docs_frame(spark, [(1, "a")]).where("doc_id > 5"), JSON, 1).count() == 0


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(pretokens, "KEPT", 50)
    table = token_counts.MergeTable(JSON)
    t = pretokens.Pretokens({}, lambda new: (np.array(table.count(new)), np.ones(len(new), np.int64)))
    for k in range(20):
        for _ in t.chunks(pa.array([f"word{i + 40 * k}" for i in range(40)])):
            pass
        assert len(t.number) <= 50 + 200


def test_codec_round_trip(spark):
    enc = bpe_codec.encoding(RANKS, P.PATTERN)
    docs = list(enumerate(texts()))
    for r in bpe_codec.encode_documents(docs_frame(spark, docs), RANKS, P.PATTERN, with_ids=True).collect():
        t = docs[r.doc_id][1] or ""
        ids = enc.encode_ordinary(t)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == sha256(t.encode()).hexdigest()


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def test_pretokens_that_fool_polynomial_hashes(spark, library, tmp_path):
    """Thue-Morse strings and their complements collide under any polynomial modulo a power of two."""
    both = [x for n in (1024, 2048, 4096, 8192) for x in (thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba")))]
    docs = list(enumerate([" ".join(both), *both]))
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in docs}
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs_frame(spark, docs), JSON, 1).collect()}
    assert got == {i: len(x) for i, x in want.items()}
    folder = f"file://{tmp_path}/tm"
    rows = token_files.read_shards(token_files.write_shards(docs_frame(spark, docs), folder, JSON, 2), folder).collect()
    assert {r.doc_id: r.ids_crc32 for r in rows} == {i: zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for i, x in want.items()}


def test_letters_are_those_of_the_library(spark, library):
    """Characters that newer editions of Unicode add are no letters to an older library."""
    docs = list(enumerate("".join(f"a{chr(c)}b {chr(c)}1" for c in range(lo, lo + 256)) for lo in (0x80, 0x10700, 0x16100, 0x2EB00, 0x31300)))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs_frame(spark, docs), JSON, 1).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in docs}


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        token_counts.MergeTable(P.path("word_bpe_49k.json"))


def test_cuts_are_at_matches():
    find = regex.compile(P.PATTERN).findall
    for t in ("alpha beta  gamma\n delta 12 3. " * 50, "don't we'll 'tis " * 80, "été... naïve!!  ça \t\n x" * 60, " \n\n" * 90 + "x" + "  " * 90):
        cut = [t[a:b] for a, b in pretokens.safe_cuts(t, 40)]
        assert "".join(cut) == t and [x for c in cut for x in find(c)] == find(t)
    assert len(list(pretokens.safe_cuts("alpha beta " * 50, 40))) > 5


def test_codec_of_long_stretches(spark):
    enc = bpe_codec.encoding(RANKS, P.PATTERN)
    million = 1_000_000
    docs = [(0, "x" + " " * million + "y"), (1, "\n" * million), (2, " \t" * 5000 + "\nword " + "　" * 6000 + "z"), (3, "." * million), (4, "é" * million), (5, "漢字、" * 700_000), (6, "a b\n" * 1_300_000), (7, "🙂 x" * 500_000)]
    find = regex.compile(P.PATTERN).finditer
    for r in bpe_codec.encode_documents(docs_frame(spark, docs), RANKS, P.PATTERN, with_ids=True).collect():
        t, known, want = docs[r.doc_id][1], {}, []
        for m in find(t):  # each match separately
            x = m.group()
            if x not in known:
                known[x] = enc._encode_single_piece(x)
            want += known[x]
        assert r.ids == want and r.decoded_sha256 == sha256(t.encode()).hexdigest()


def test_files_round_trip(spark, library, tmp_path):
    docs = [(i * 3 - 50, t) for i, t in enumerate(texts())]
    random.Random(1).shuffle(docs)
    docs += [(None, "null id"), docs[0]]
    folder = f"file://{tmp_path}/ids"
    manifest = token_files.write_shards(docs_frame(spark, docs), folder, JSON, 2, shard_ids=2000)
    got = token_files.read_shards(manifest, folder).collect()
    assert len(got) == len(docs)
    by_text = {}
    for i, t in docs:
        by_text.setdefault(i, []).append(zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()))
    for i, want in by_text.items():
        assert sorted(r.ids_crc32 for r in got if r.doc_id == i) == sorted(want)
    rows = sorted(got, key=lambda r: r.start)
    assert [r.start for r in rows] == np.r_[0, np.cumsum([r.n_tokens for r in rows])[:-1]].tolist()
    ids = [r.doc_id for r in rows]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    third = token_files.read_document(spark, manifest, folder, 3)
    assert zlib.crc32(third.astype("<u4").tobytes()) == rows[3].ids_crc32
    assert token_files.read_shards(token_files.write_shards(docs_frame(spark, [(1, "a")]).where("doc_id > 5"), f"{folder}-none", JSON, 2), folder).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=1500), st.integers(0, 10**6))
def test_elias_fano(steps, base):
    v = np.cumsum(np.array(steps, np.int64)) + base
    e = token_files.EliasFano.from_bytes(token_files.EliasFano.of(v).to_bytes())
    assert e.values().tolist() == v.tolist()
    assert [e.select(i) for i in range(0, len(v), 37)] == v[::37].tolist()
    for a, b in ((0, 0), (0, 1), (len(v) // 3, len(v)), (len(v) // 2, len(v) // 2 + 5)):
        assert e.slice(a, b).tolist() == v[a:b].tolist()
