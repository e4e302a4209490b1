import os

import duckdb
import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline
from glyspark.llm import langid, ngram_join, packing, pii, queries, toxicity

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


def test_stages_against_their_operators(spark, tmp_path):
    """Each stage, by plain joins of its operator's own results."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r.doc_id: r for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k == 0:
            ok = {r.doc_id for r in langid.identify(docs).collect() if r.lang_pred != "und" and r.score >= langid.REJECT}
            want = {i: r for i, r in want.items() if i in ok}
        elif k == 1:
            labels = spark.read.parquet(f"{DATA}/labels.parquet")
            bad = {r.doc_id for r in toxicity.score_documents(docs, labels).collect() if r.predicted}
            want = {i: r for i, r in want.items() if i not in bad}
        elif k == 2:
            groups = {r.component_id for r in ngram_join.similar_documents(docs).collect()}
            want = {i: r for i, r in want.items() if i in groups}
        elif k == 3:
            assert {r.doc_id for r in out.collect()} == set(want)
            assert not any(pii.base_spans(r.text)[0] for r in out.collect())
        if k < 3:
            assert out.columns == docs.columns and {r.doc_id: r for r in out.collect()} == want
        last, docs = docs, out
    assert sorted(tuple(r) for r in docs.select("doc_id", "piece", "length", "ids_crc32").collect()) == sorted(tuple(r) for r in packing.pieces(last, packing.default_path("byte_bpe_50k.json")).select("doc_id", "piece", "length", "ids_crc32").collect())


def test_run(spark):
    got = corpus_pipeline.run(spark, DATA)
    assert got.count() > 0 and set(got.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    got = queries.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == cols
    assert got[cols].sort_values(cols).values.tolist() == want[cols].sort_values(cols).values.tolist()
