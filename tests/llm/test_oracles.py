"""Queries of this subpackage against their SQL."""

import duckdb
import pytest

from lodestar.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    made = QUERIES[name](spark, DIR)
    found = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(made.columns)
    assert sorted(map(tuple, made.select(*columns).collect())) == sorted(found.fetchall())


def test_pipeline(spark):
    """Each stage's effect, and the columns that it hands on."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = corpus_pipeline.drop_toxic(spark, docs, DIR)
    assert clean.columns == docs.columns and 0.7 * len(before) < clean.count() < len(before)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        made = stage(spark, clean, DIR)
        assert made.columns == docs.columns, name
        ids = [r["doc_id"] for r in made.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= set(before)
    packed = corpus_pipeline.run(spark, DIR)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(packed.columns) and packed.count() > 0
