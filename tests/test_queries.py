"""Every registered query of the core beside its SQL, on the smallest tables."""

import glob
import math
import os
from datetime import datetime

import pytest
from conftest import DATA

import __spark_entry__ as entry_module
from staylens.operators import bm25
from staylens.plans import registry

duckdb = pytest.importorskip("duckdb")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v.replace(tzinfo=None)) if isinstance(v, datetime) else str(v)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_its_sql(spark, tables, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted("|".join(plain(r[c]) for c in columns) for r in df.collect())
    rel = tables.sql(registry.ORACLE[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted("|".join(plain(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["bm25_topk", "field_weighted_bm25", "bm25_stored", "bm25_group_rollup", "pool_three", "three_systems"])
def test_scores_of_all_pairs_stay_in_the_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(bm25, "score", None)
    assert registry.QUERIES[name](spark, DATA).count()


@pytest.mark.parametrize("name", ["bm25_topk", "field_weighted_bm25", "bm25_stored", "bm25_group_rollup"])
def test_every_query_is_asked(spark, tables, name):
    got = {r["query"] for r in registry.QUERIES[name](spark, DATA).select("query").distinct().collect()}
    terms = "select unnest(tokens) from documents"
    asked = tables.sql(f"select distinct query_id from (select query_id, unnest(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}_]+')) as t from queries) where t <> '' and t in ({terms})").fetchall()
    assert len(got) > 1 and got == {r[0] for r in asked}


def test_hybrid_search_answers_every_query(spark, tables):
    got = {r[0] for r in registry.QUERIES["hybrid_search"](spark, DATA).select("query").distinct().collect()}
    assert got == {r[0] for r in tables.sql("select query_id from queries").fetchall()}


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[:3] == ["query", "rank", "source_hotel_id"]
    df.collect()


def test_registries_agree():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
