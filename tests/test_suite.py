"""Registered queries against their SQL at the smallest scale; ROWMILL_ALL=1 runs every query."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tools.check import TABLES, normal

SOME = ["config_run", "agg_list", "agg_mode", "enrich_lookup_merge", "norm_robust", "reshape_pivot", "validate_unique", "sample_stratified",
        "sample_time_based", "profile_fields", "classify_category", "noise_labels", "src_json_envelope", "store_update",
        "doc_shred_items", "join_nest_children", "stream_rowwise", "renew_versioned"]
NAMES = list(entry.queries()) if os.environ.get("ROWMILL_ALL") else SOME


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    found = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    order = sorted(df.columns)
    assert sorted(columns) == order
    mine = sorted((tuple(normal(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(normal(r[columns.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert mine == theirs


def test_every_query_is_registered_with_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
