"""Queries over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .license_scan import scan_licenses

    found = scan_licenses(_table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    best = F.coalesce(F.array_max(F.transform("spans", lambda x: x["coverage"])), F.lit(0.0))
    return found.select("doc_id", "n_licenses", "licenses", spans.alias("spans"), best.alias("coverage"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_search import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar_documents

    return similar_documents(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest, find_spans

    return digest(find_spans(_table(spark, sf_dir, "documents")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), with_text=False)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_topk_search, op3_ngram_join, op4_toxicity, op5_embedding_dedup, op6_pii, op7_bpe, op8_packing, op9_sharding, op10_language_id)}


#: The ten nearest codes of each asked vector by brute force.
TOPK_SQL = """
WITH size AS (
  SELECT len(embedding) AS d FROM embeddings WHERE len(embedding) > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1
), codes AS (
  SELECT DISTINCT vec_id AS id, list_transform(embedding, lambda x: x > 0) AS code
  FROM embeddings, size
  WHERE vec_id IS NOT NULL AND len(embedding) = d AND list_count(embedding) = d AND NOT list_contains(list_transform(embedding, lambda x: isnan(x)), true)
), pairs AS (
  SELECT q.id AS query_id, c.id AS vec_id, list_sum(list_transform(list_zip(q.code, c.code), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS distance
  FROM codes q JOIN codes c ON q.id <> c.id WHERE q.id % 20 = 0
), nearest AS (
  SELECT query_id, vec_id, min(distance) AS distance FROM pairs GROUP BY 1, 2
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, CAST(distance AS INTEGER) AS distance FROM nearest
)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""


#: All pairs that share a shingle, and reachability by links.
NGRAM_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), sized AS (
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY s) ELSE doc_id END AS rep FROM sets
), shingles AS (
  SELECT doc_id, unnest(s) AS g FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM sized
  UNION
  SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node
), low AS (
  SELECT node, min(root) AS component_id FROM reach GROUP BY 1
)
SELECT doc_id, n AS n_shingles, component_id, rep FROM sized JOIN low ON node = doc_id
"""

#: All pairs by cosine, and reachability by links.
EMBEDDING_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE list_count(embedding) = len(embedding) AND NOT list_contains(list_transform(embedding, lambda x: isfinite(x)), false) AND list_contains(list_transform(embedding, lambda x: x <> 0), true)
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= 0.9e0 END
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
  UNION
  SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node
), low AS (
  SELECT node, min(root) AS component_id FROM reach GROUP BY 1
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, component_id = vec_id AS kept FROM embeddings JOIN low ON node = vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_topk_search": TOPK_SQL, "op3_ngram_join": NGRAM_SQL, "op5_embedding_dedup": EMBEDDING_SQL}
