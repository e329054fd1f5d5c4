"""Every query of the library against the same in DuckDB SQL; those without SQL must run."""

import pytest
from conftest import same
from folioforge.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, data):
    if name in ORACLES:
        same(QUERIES[name], ORACLES[name], spark, duck, data)
    else:
        assert QUERIES[name](spark, data).count() >= 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_titles_without_tags_stay_in_the_result(spark, data):
    rows = QUERIES["strip_tag_prefix"](spark, data).collect()
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert sorted(r.id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    plain = {r.doc_id: r.h for r in docs.where("doc_id % 3 = 1").selectExpr("doc_id", "sha2(text, 256) AS h").collect()}
    assert plain and {r.id: r.hash for r in rows if r.id in plain} == plain
