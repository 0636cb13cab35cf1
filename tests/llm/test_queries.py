"""The registered queries over the smallest tables: against DuckDB where there is SQL, else against brute force."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__
from strandwise.llm import queries

from .. import test_oracle as oracle
from . import test_pii, test_simhash, test_suffixdedup, test_suffixtree

SF = oracle.SF
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def test_one_query_for_each_operator():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries() and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in oracle.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert oracle.rows(got.columns, got.collect()) == oracle.rows(names, want.fetchall())


def test_op3(spark, docs):
    got = queries.op3_suffix_tree_lm(spark, SF).collect()
    brute = test_suffixtree.Brute(docs)
    rows = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got), key=str)
    test_suffixtree.same(rows, sorted((brute.row(*d) for d in docs), key=str))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op4(spark, docs):
    got = queries.op4_simhash_dedup(spark, SF).collect()
    prints = {i: test_simhash.brute_print(t) for i, t in docs}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == test_simhash.brute_components(list(prints.items()))


def test_op5(spark, docs):
    got = {r.doc_id: r for r in queries.op5_pii_bootstrap(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        base = test_pii.brute(text)
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(b[0] == k for b in base) for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, line.split(","))) <= set(got[i].spans.split(","))


def test_op8_on_held_out_rows(spark):
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    held = [r for r in queries.op8_quality_qda(spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.9 * len(held)


def test_op9(spark, docs):
    got = queries.op9_suffix_dedup(spark, SF).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == test_suffixdedup.brute(docs)
