"""Every query with SQL gives what DuckDB gives; plans hold no nested loops but the intended ones."""

import os
import re
from collections import Counter

import duckdb
import pytest

from runweave.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    result = duck.sql(catalog.oracle_sql()[name])
    assert sorted(result.columns) == columns
    places = [result.columns.index(c) for c in columns]
    theirs = sorted(repr(tuple(row[i] for i in places)) for row in result.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - catalog.oracle_sql().keys()))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["resample_last", "interpolate_linear", "lagged_correlation", "pairwise_mse_and_separation"])
def test_bands_are_equi_joins(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_every_place_is_standardised(spark):
    got = {(r.run_id, r.pos) for r in catalog.queries()["standardise_every_place"](spark, SF).collect()}
    runs = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert got == {(r.vec_id, pos) for r in runs for pos in range(len(r.embedding))}


def test_every_word_is_counted(spark):
    words = Counter(w for r in spark.read.parquet(f"{SF}/conversations.parquet").collect() for w in re.findall("[a-z]+", (r.text or "").lower()))
    got = {r.word: r.calls for r in catalog.queries()["tool_calls_every_word"](spark, SF).collect()}
    assert got == words
    assert min(got.values()) <= 20


@pytest.mark.parametrize("name", ["interpolated_loss", "trajectory_losses"])
def test_repeated_targets_count_as_in_sql(spark, tmp_path, name):
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 11 <> 0 THEN value END AS value, CASE WHEN event_id % 29 <> 0 THEN user_id END AS user_id) FROM '{SF}/events.parquet', range(6) r(i) WHERE i <= event_id % 6) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    ours = catalog.queries()[name](spark, str(tmp_path))
    theirs = con.sql(f"SELECT {', '.join(ours.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, ours.collect()))) == sorted(map(repr, theirs))
