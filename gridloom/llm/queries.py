"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, licenses, nn_descent, packing, passages, quality, secrets, simhash, spelling, token_counts, toxicity, va_search, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nn_descent.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base spans, the digest of the base spans and all spans; owners are the sources."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(base, s -> s.kind = {k}))").cast("long").alias(f"n_{kind}") for k, kind in enumerate(secrets.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("found")).alias("spans"), "n_live", "n_copied", secrets.told(F.col("held")).alias("held"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return va_search.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: crc32 is linear: a hash is the xor of what each byte leaves behind with the bytes that follow it taken as zero, and of a constant for the length.
OP13_SQL = """
WITH RECURSIVE b AS (
  SELECT i AS byte, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) AS r(i)
), raw AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), occ AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM raw GROUP BY 1, 2
), msg AS (
  SELECT row_number() OVER () AS id, w, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS h FROM occ
), k(k, byte, v) AS (
  SELECT 0, byte, v FROM b UNION ALL SELECT k.k + 1, k.byte, xor(k.v >> 8, b.v) FROM k JOIN b ON b.byte = k.v & 255 WHERE k.k < (SELECT max(length(h)) // 2 FROM msg)
), z(len, v) AS (
  SELECT 0, 4294967295 UNION ALL SELECT z.len + 1, xor(z.v >> 8, b.v) FROM z JOIN b ON b.byte = z.v & 255 WHERE z.len < (SELECT max(length(h)) // 2 FROM msg)
), bytes AS (
  SELECT id, w, n, length(h) // 2 AS len, p, CAST('0x' || substr(h, 2 * p + 1, 2) AS BIGINT) AS byte FROM (SELECT *, unnest(range(length(h) // 2)) AS p FROM msg)
), hashed AS (
  SELECT any_value(w) AS w, any_value(n) AS n, xor(xor(bit_xor(k.v), any_value(z.v)), 4294967295) AS h FROM bytes JOIN k ON k.byte = bytes.byte AND k.k = len - 1 - p JOIN z ON z.len = bytes.len GROUP BY id
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3
), gone AS (
  SELECT word, left(word, i) AS head, substr(word, i + 2) AS tail FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT x.word, y.word AS other FROM gone AS x JOIN gone AS y ON y.head = x.head AND y.tail = x.tail AND y.word <> x.word
  UNION SELECT g.word, w.word FROM gone AS g JOIN words AS w ON w.word = g.head || g.tail
  UNION SELECT w.word, g.word FROM gone AS g JOIN words AS w ON w.word = g.head || g.tail
), best AS (
  SELECT near.word, count(*) AS n_near, arg_min(o.word, (-o.n, o.word)) AS other, max(o.n) AS other_n FROM near JOIN words AS o ON o.word = near.other GROUP BY 1
), form AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM words AS w LEFT JOIN best ON best.word = w.word
), up(word, root) AS (
  SELECT word, form FROM form WHERE form IS NOT NULL UNION ALL SELECT up.word, f.form FROM up JOIN form AS f ON f.word = up.root WHERE f.form IS NOT NULL
), ends AS (
  SELECT up.word, up.root FROM up JOIN form AS f ON f.word = up.root WHERE f.form IS NULL
)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM form AS f LEFT JOIN ends ON ends.word = f.word
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_secrets": op2_secrets,
    "op3_neighbours": op3_neighbours,
    "op4_token_counts": op4_token_counts,
    "op5_packing": op5_packing,
    "op6_passages": op6_passages,
    "op7_quality": op7_quality,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_simhash": op9_simhash,
    "op10_licenses": op10_licenses,
    "op11_whitening": op11_whitening,
    "op12_toxicity": op12_toxicity,
    "op13_spelling": op13_spelling,
}
ORACLES: dict[str, str] = {"op8_exact_top_k": OP8_SQL, "op13_spelling": OP13_SQL}
