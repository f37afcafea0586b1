"""Registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, centroid_clusters, decontaminate, embedding_dedup, language_id, personal_data, secret_scan, set_sketch, substring_dedup, token_counts, token_files, toxicity, vector_codes
from .frames import fresh_path, table

BYTE_BPE = "byte_bpe_50k.json"
BYTE_BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
TOKEN_LIMIT = 1024
END_ID = 2


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), length=10))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=20))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_set_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_sketch.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, share=80)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("passages")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), TOKEN_LIMIT)


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE_RANKS), public_tokenizers.PATTERN)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    manifest = token_files.write_shards(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(BYTE_BPE), END_ID)
    return token_files.read_shards(manifest, folder)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(*vector_codes.compress(table(spark, sf_dir, "embeddings")))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.find(table(spark, sf_dir, "documents")))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.digest(*centroid_clusters.cluster(table(spark, sf_dir, "embeddings")))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id, w, least(len(w), 10) AS size FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL)
  WHERE len(w) > 0
), iw AS (
  SELECT DISTINCT item_id, size, array_to_string(w[s : s + size - 1], ' ') AS win
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM i)
), dw AS (
  SELECT doc_id, s, size, array_to_string(w[s : s + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM i) WHERE len(w) >= size)
), hit AS (
  SELECT doc_id, item_id, s, dw.size FROM dw JOIN iw USING (size, win)
), hw AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM (SELECT DISTINCT doc_id, s, size FROM hit)) GROUP BY doc_id
), hi AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) >= 0.95
), reach(node, to_) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT node, b FROM reach JOIN link ON to_ = a
)
SELECT v.vec_id, CAST((SELECT count(*) FROM link WHERE a = v.vec_id) AS BIGINT) AS n_links, min(to_) AS component_id, v.vec_id = min(to_) AS kept
FROM v JOIN reach ON v.vec_id = node GROUP BY v.vec_id
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, hash(s) AS s FROM (
    SELECT doc_id, array_to_string(w[i : i + 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0))
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(node, to_) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT node, b FROM reach JOIN edge ON to_ = a
)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(to_) AS component_id, w.doc_id = min(to_) AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN reach ON w.doc_id = node GROUP BY w.doc_id
"""

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, s, md5(array_to_string(w[s : s + 19], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)
), again AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM again
), word AS (
  SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(v, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


#: Usable vectors as floored integers: rows numbered, components as a list.
_INTEGERS = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor({scale} * x) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) {length} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""
#: Floored mean of integers s over n of them.
_FLOORED = "CAST((sum({0}) - ((sum({0}) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"


def _op11_sql(rounds: int = 2) -> str:
    """Rounds written out: b0, b1, ... are the codebooks, a0, a1, ... the assignments by them."""
    out = [_INTEGERS.format(scale=256, length="> 0 AND len(embedding) % 16 = 0")]
    out.append("p AS MATERIALIZED (SELECT rid, g, x[g * (len(x) // 16) + 1 : (g + 1) * (len(x) // 16)] AS y FROM v, (SELECT unnest(range(16)) AS g))")
    out.append("b0 AS MATERIALIZED (SELECT g, rid - 1 AS e, y AS c FROM p WHERE rid <= 64)")
    for r in range(rounds + 1):
        out.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, g, min_by(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT rid, g, e, CAST(list_sum(list_transform(range(1, len(y) + 1), lambda i: (y[i] - c[i]) * (y[i] - c[i]))) AS BIGINT) AS d FROM p JOIN b{r} USING (g)) GROUP BY rid, g
)""")
        if r < rounds:
            out.append(f"""b{r + 1} AS MATERIALIZED (
  SELECT g, e, coalesce(m, c) AS c FROM b{r} LEFT JOIN (
    SELECT g, e, list(m ORDER BY i) AS m FROM (SELECT g, e, i, {_FLOORED.format("z")} AS m FROM (SELECT g, e, unnest(y) AS z, unnest(range(len(y))) AS i FROM p JOIN a{r} USING (rid, g)) GROUP BY g, e, i) GROUP BY g, e
  ) USING (g, e)
)""")
    return ",\n".join(out) + f"""
, coded AS (
  SELECT rid, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY g) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY g, e)) FROM b{rounds}) AS codebooks_sha256
FROM v JOIN coded USING (rid)
"""


def _op13_sql(rounds: int = 10) -> str:
    """Rounds written out: c0, c1, ... are the centroids, a0, a1, ... the assignments by them."""
    out = [_INTEGERS.format(scale=1024, length="= 64")]
    out.append("c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, x) - 1 AS k, x AS c FROM v QUALIFY k < 8)")
    for r in range(rounds + 1):
        out.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, min_by(k, (d, k)) AS k, min(d) AS d FROM (
    SELECT rid, k, CAST(list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) AS d FROM v, c{r}) GROUP BY rid
)""")
        if r < rounds:
            out.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT k, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
    SELECT k, list(m ORDER BY i) AS m FROM (SELECT k, i, {_FLOORED.format("z")} AS m FROM (SELECT k, unnest(x) AS z, unnest(range(64)) AS i FROM v JOIN a{r} USING (rid)) GROUP BY k, i) GROUP BY k
  ) USING (k)
)""")
    return ",\n".join(out) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (rid) JOIN c{rounds} USING (k)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_substring_dedup, op3_embedding_dedup, op4_language_id, op5_set_sketch, op6_toxicity, op7_token_counts, op8_bpe_codec, op9_secret_scan, op10_token_files, op11_vector_codes, op12_personal_data, op13_centroid_clusters)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op3_embedding_dedup": OP3_SQL, "op5_set_sketch": OP5_SQL, "op11_vector_codes": _op11_sql(), "op13_centroid_clusters": _op13_sql()}
