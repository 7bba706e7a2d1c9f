"""Every registered catalogue query against its SQL, and the errors and edges of its parts."""

import math

import duckdb
import pytest

from mediaspan.operators import cluster, dedup, dynamic, facets, headers, library, metadata, mutations, names, nearest, pixels, prompts, reviews, scalars, vectors  # noqa: F401
from mediaspan.plans import rules
from mediaspan.plans.catalog import Library
from mediaspan.plans.components import connected_components
from mediaspan.plans.predicates import Params, conjuncts, type_mask
from mediaspan.sources import files
from mediaspan.streaming import snapshots, sync  # noqa: F401
from mediaspan.plans.registry import ORACLES, QUERIES
from mediaspan.plans.workspace import Workspace

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
        return None
    return f"{float(v):.5f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


def rows_of(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False, name=None)) if len(df) else []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    mine, want = QUERIES[name](spark, FOLDER).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(want.columns)
    assert sorted(map(repr, rows_of(mine))) == sorted(map(repr, rows_of(want)))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0


def test_components(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 9), (5, 5), (None, 1), (7, 3), (20, 21), (21, 22), (22, 23), (23, 24)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, "a", "b", Workspace(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 8, 9: 8, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}


def test_labels_of_a_small_graph_are_one_file(spark):
    """Also if shuffles have many partitions that are not made fewer."""
    edges = spark.range(200).selectExpr("id a", "id - id % 4 b").localCheckpoint()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        labels = connected_components(edges, "a", "b", Workspace(spark, "few-files"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.node, r.component) for r in labels.collect()} == {(i, i - i % 4) for i in range(200)}
    assert len(labels.inputFiles()) == 1


def test_inactive_parameters_add_no_predicate():
    assert conjuncts(Params()) == []
    assert type_mask(7) is None and type_mask(15) is None and type_mask(0) is None


def test_limits_follow_the_ladder():
    assert [vectors.text_limit(t) for t in (0.3, 0.23, 0.2, 0.1)] == [30, 40, 50, 200]
    assert vectors.text_limit(0.3, 5) == 5 and vectors.image_limit(0.3) == 12 and vectors.text_floor(0) == 0.2


@pytest.mark.parametrize("bad", [{"field": "colour", "operator": "is"}, {"field": "name", "operator": "gt", "value": "x"}])
def test_unknown_rules_fail(spark, bad):
    with pytest.raises(ValueError):
        rules.apply(Library(spark, FOLDER), [bad])


def test_a_dynamic_set_needs_a_rule(spark):
    with pytest.raises(ValueError):
        rules.apply(Library(spark, FOLDER), [])


def test_visible_plan_has_no_cartesian_product(spark):
    plan = QUERIES["A2_total_count_sum"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
