import os
import subprocess
import sys

import duckdb
import pytest

import corpus_pipeline
from jouleframe.llm.common import ROOT, table
from jouleframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for given in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {given} AS SELECT * FROM '{SF}/{given}.parquet'")
    got = QUERIES[name](spark, SF)
    rows = con.sql(ORACLES[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(rows.fetchall(), key=key) == sorted((tuple(r[c] for c in names) for r in got.collect()), key=key)


def test_entry_imports_without_a_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=ROOT, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, docs, SF), "stage")
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and after <= before, name
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == before and len(before) > 50
