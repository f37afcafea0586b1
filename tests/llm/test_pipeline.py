import random

import public_tokenizers
import pytest

import __spark_entry__ as entry
from eventloom.llm import bpe_codec, queries

from .test_decontaminate import brute as brute_hits
from .test_secret_scan import base
from .test_set_sketch import brute as brute_groups

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(11)
    plain = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    items = [(i, text(15)) for i in range(4)]
    docs, labels = [], []
    for i in range(160):
        t, y = text(rng.randint(30, 60)), int(i % 4 == 0)
        if y:
            t += " vile awful nasty vile"
        if i % 10 == 1:
            t += " " + items[i % 4][1]
        if i % 10 == 3:
            t += " password: hunter2222"
        docs.append((i, t))
        labels.append((i, y))
    docs += [(500 + i, docs[i][1]) for i in range(0, 60, 5)] + [(600, None), (601, ""), (None, text(20))]
    full = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, docs, items, labels


def test_run_equals_brute_force(spark, folder):
    at, docs, items, _ = folder
    kept = [(i, t) for i, t in docs if "vile" not in (t or "")]
    least = -(1 << 63)
    group = {i: ok for i, _, _, ok in brute_groups([(least if i is None else i, t) for i, t in kept], pipeline.SHINGLE, pipeline.SHARE)}
    kept = [(i, t) for i, t in kept if group[least if i is None else i]]
    hit = brute_hits(kept, items, pipeline.WINDOW)
    kept = [(i, t) for i, t in kept if not hit[i][1]]
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    want = {}
    for i, t in kept:
        for a, _, b, _ in reversed(base(t)):
            t = t[:a] + "[REDACTED]" + t[b:]
        want[i] = bpe_codec.encode(t, path, pattern)
    got = {r.doc_id: list(r.ids) for r in pipeline.run(spark, at).collect()}
    assert got == want and 40 < len(got) < 120


def test_stages_return_documents_and_take_odd_tables(spark, folder):
    at, *_ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    odd = docs.selectExpr("*", "'a' as key", "1 as found", "2 as predicted", "3 as row", "4 as n_hit", "5 as _id")
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, at).columns == docs.columns, name
        out = stage(spark, odd, at)
        assert out.columns == odd.columns and out.count() > 0, name
        assert stage(spark, docs.where("doc_id > 10000"), at).count() == 0, name
    assert pipeline.STAGES[-1][1](spark, docs.where("doc_id > 10000"), at).count() == 0


def test_every_operator_has_one_query():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)
