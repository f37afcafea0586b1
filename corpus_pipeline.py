"""The corpus pipeline: five operators over the documents table, each stage written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. run() applies them in order to the whole table, with Parquet in
the shared folder between stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe_codec, decontaminate, secret_scan, set_sketch, toxicity
from eventloom.llm.frames import fresh_path, table

#: Words of a shingle and percent of similarity at which documents are near-duplicates.
SHINGLE, SHARE = 5, 80
#: Words of a benchmark window.
WINDOW = 10


def _rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is among ids; null ids match."""
    wanted = ids.select(F.col("doc_id").alias("__kept_id"))
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["__kept_id"]), "left_semi")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the segment search doesn't predict toxic."""
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), keep=tuple(docs.columns))
    return scored.where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of least id. Rows of one id are one document."""
    groups = set_sketch.near_duplicates(docs, shingle=SHINGLE, share=SHARE)
    return _rows(docs, groups.where("kept").select("doc_id").distinct())


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), length=WINDOW, keep=tuple(docs.columns))
    return found.where("n_hit = 0").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret's span replaced by a mask and n_chars set anew."""
    found = secret_scan.scan(docs, keep=tuple(docs.columns))
    clean = secret_scan.redact("row.text", "found")
    changed = {"text": F.when(F.col("row.text").isNotNull(), clean), "n_chars": F.when(F.size("found") > 0, F.length(clean).cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and of decoded bytes, and the ids."""
    return bpe_codec.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("bpe_encoding", encode),
]

#: The stages' learned scores and tokens have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = fresh_path(spark, f"pipeline-{i}-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
