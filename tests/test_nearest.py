"""The index of approximate neighbours against the exact graph and search."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mediaspan.operators import cluster, nearest
from mediaspan.operators.vectors import ranked
from mediaspan.plans.workspace import Workspace

SCHEMA = "node long, owner long, embedding array<float>"


def grouped_vectors(groups, each, size, seed, spread=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    x = np.repeat(centres, each, axis=0) + spread * rng.normal(size=(groups * each, size))
    return [(i, i, [float(v) for v in row / np.linalg.norm(row)]) for i, row in enumerate(x)]


def pairs(df):
    return {(r.a, r.b) for r in df.collect()}


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(nearest, "CELL", 20)
    monkeypatch.setattr(nearest, "BLOCK", 15)


def test_the_index_finds_nine_tenths_of_the_exact_graph(spark, small_cells):
    vectors = spark.createDataFrame(grouped_vectors(12, 40, 48, 17), SCHEMA)
    work = Workspace(spark, "test")
    exact, fast = (pairs(nearest.neighbour_graph(vectors, work, mode, 0.5, 30)) for mode in ("exact", "fast"))
    assert len(exact & fast) >= 0.9 * len(exact) and fast
    report = nearest.parity(*(nearest.neighbour_graph(vectors, Workspace(spark, "p"), m, 0.5, 30) for m in ("exact", "fast")))
    assert report.agg(F.avg("jaccard")).first()[0] >= 0.9


def test_probes_rise_with_the_share_wanted(spark, small_cells):
    vectors = nearest.usable(spark.createDataFrame(grouped_vectors(1, 400, 16, 3, 5.0), SCHEMA))
    few, many = (nearest.fit(vectors, 400, 10, recall).probes for recall in (0.3, 0.99))
    assert 1 <= few < many <= 20


def test_fast_graph_keeps_the_same_file_ban(spark, small_cells):
    rows = [(i, i // 3, e) for i, _, e in grouped_vectors(4, 16, 32, 5)]
    found = pairs(nearest.neighbour_graph(spark.createDataFrame(rows, SCHEMA), Workspace(spark, "ban"), "fast", 0.55, 20))
    assert found and all(a // 3 != b // 3 for a, b in found)


def test_one_cell_is_exact(spark):
    vectors = spark.createDataFrame(grouped_vectors(6, 20, 32, 11), SCHEMA)
    work = Workspace(spark, "one")
    exact, fast = (nearest.neighbour_graph(vectors, work, mode, 0.6, 7).select("a", "b", F.round("weight", 5)).collect() for mode in ("exact", "fast"))
    assert [r[:2] for r in sorted(exact)] == [r[:2] for r in sorted(fast)]
    assert np.allclose([r[2] for r in sorted(exact)], [r[2] for r in sorted(fast)], atol=1e-4)


def test_mode_and_number_choose_the_graph(spark, monkeypatch):
    built = []
    monkeypatch.setattr(nearest, "neighbours", lambda *a: built.append("exact"))
    monkeypatch.setattr(nearest, "fast_neighbours", lambda *a: built.append("fast"))
    vectors = spark.createDataFrame(grouped_vectors(2, 5, 8, 1), SCHEMA)
    monkeypatch.setattr(cluster, "EXACT_BELOW", 11)
    nearest.neighbour_graph(vectors, None)
    monkeypatch.setattr(cluster, "EXACT_BELOW", 10)
    for mode in ("auto", "exact", "fast"):
        nearest.neighbour_graph(vectors, None, mode)
    assert built == ["exact", "fast", "exact", "fast"]
    with pytest.raises(ValueError, match="unknown"):
        nearest.neighbour_graph(vectors, None, "other")


def test_odd_vectors_are_left_out(spark, small_cells):
    rows = grouped_vectors(3, 30, 8, 2)
    odd = [(900, 900, None), (901, 901, []), (902, 902, [0.0] * 8), (903, 903, [float("nan")] * 8), (904, 904, [1.0] * 5), (905, 905, [None] * 8), (906, 906, [float("inf")] * 8)]
    work = Workspace(spark, "odd")
    found = pairs(nearest.neighbour_graph(spark.createDataFrame(rows + odd, SCHEMA), work, "fast", 0.5, 10))
    assert found and max(max(p) for p in found) < 900
    assert nearest.neighbour_graph(spark.createDataFrame([], SCHEMA), Workspace(spark, "none"), "fast").count() == 0


def test_fast_search_scores_exactly(spark, small_cells):
    rows = spark.createDataFrame([(i, e) for i, _, e in grouped_vectors(12, 40, 48, 23)], "file_id long, embedding array<float>")
    queries = rows.where("file_id % 20 = 0")
    exact = {(r.query_id, r.file_id): r for r in ranked(queries, rows, 0.3, 25).collect()}
    fast = {(r.query_id, r.file_id): r for r in nearest.ranked_auto(queries, rows, Workspace(spark, "search"), "fast", 0.3, 25).collect()}
    assert len(exact.keys() & fast.keys()) >= 0.9 * len(exact)
    assert all(abs(fast[key].score - exact[key].score) < 1e-6 for key in exact.keys() & fast.keys())
    assert all(q != f for q, f in fast) and max(r["rank"] for r in fast.values()) <= 25
    assert nearest.ranked_auto(queries, rows, Workspace(spark, "auto"), "auto", 0.3, 25).count() == len(exact)


def test_a_query_is_sent_once_to_a_part_with_all_its_cells(spark):
    rows = spark.createDataFrame(grouped_vectors(6, 10, 8, 4), SCHEMA)
    index = nearest.Index(np.eye(8)[:6], 5)
    sent = nearest._placed(rows, index, 2, False).collect()
    assert len(sent) == 120 and all(c % 2 == r.part for r in sent for c in r.cells) and sum(len(r.cells) for r in sent) == 60 * 5
    assert nearest._placed(rows, index, 2, True).count() == 60


def group(nodes, owners, vectors, cells):
    return pa.table({"node": pa.array(nodes, pa.int64()), "owner": pa.array(owners, pa.int64()), "embedding": pa.array(list(vectors), pa.list_(pa.float32())), "cells": pa.array(cells, pa.list_(pa.int32()))})


def test_a_group_equals_brute_force(monkeypatch):
    rng = np.random.default_rng(8)
    y = np.repeat(rng.normal(size=(60, 4)), 3, axis=0).round(1)  # every vector three times
    nodes, owners = [*rng.permutation(170).tolist(), *[None] * 4, *[5] * 6], rng.integers(0, 40, 180).tolist()
    home = rng.integers(0, 9, 180)
    x, asked = y[::5], [2**60 + n // 2 for n in range(36)]  # every query id twice
    asked[7], visits = None, [rng.permutation(12)[: 1 + n % 5].tolist() for n in range(36)]
    mine = rng.integers(0, 40, 36).tolist()
    units = [v / np.linalg.norm(v.astype(np.float32).astype(float), axis=1, keepdims=True) for v in (x, y)]
    scores = np.clip(units[0].astype(float) @ units[1].T, -1, 1)
    want = {}
    for i, a in enumerate(asked):
        if a is not None:
            want.setdefault(a, []).extend(round(float(scores[i, j]), 5) for j in range(180) if home[j] in visits[i] and owners[j] != mine[i] and scores[i, j] > 0.21)
    monkeypatch.setattr(nearest, "STRIP", 7)
    monkeypatch.setattr(nearest, "PIECE", 5)
    monkeypatch.setattr(nearest, "HELD", 20)
    q, r = group(asked, mine, x, visits), group(nodes, owners, y, [[c] for c in home])
    for k in (1, 6, 500):
        found = {}
        for row in nearest._meet(k, 0.21)(q, r).to_pylist():
            found.setdefault(row["a"], []).append(row)
        for a, scored in want.items():
            got = sorted((round(row["score"], 5) for row in found.get(a, [])), reverse=True)
            assert np.allclose(got[:k], sorted(scored, reverse=True)[:k], atol=2e-5), (k, a)
        assert None not in found and (k < 500 or any(row["b"] is None for rows in found.values() for row in rows))
    assert nearest._meet(3, 0.2)(q.slice(0, 0), r).num_rows == nearest._meet(3, 0.2)(q, r.slice(0, 0)).num_rows == 0


def test_equal_scores_go_by_id_in_pieces_of_a_cell(monkeypatch):
    monkeypatch.setattr(nearest, "PIECE", 10)
    nodes = np.random.default_rng(1).permutation(100)
    r = group(nodes, nodes, np.tile([3.0, 4.0], (100, 1)), [[int(n % 3)] for n in nodes])
    found = nearest._meet(2, 0.5)(group([-1, -2], [-1, 0], [[6.0, 8.0]] * 2, [[2, 0, 1], [0, 2]]), r).to_pylist()
    assert sorted((row["a"], row["b"]) for row in found) == [(-2, 2), (-2, 3), (-1, 0), (-1, 1)]


def test_a_repeated_query_gets_no_more_rows():
    x = np.random.default_rng(5).normal(size=(300, 8))
    r = group(range(300), range(300), x, [[0]] * 300)
    found = nearest._meet(5, -1.0)(group([7] * 200, [7] * 200, [x[7]] * 200, [[0]] * 200), r).to_pylist()
    best = int((x @ x[7] / np.linalg.norm(x, axis=1) - 1e9 * (np.arange(300) == 7)).argmax())
    assert [(row["a"], row["b"]) for row in found] == [(7, best)] * 5


def test_a_group_holds_little_beside_its_result():
    rng = np.random.default_rng(2)
    x, ids = rng.normal(size=(4000, 16)), np.arange(4000)
    q, r = group(ids, ids, x, [[0, 1, 2, 3]] * 4000), group(ids, ids, x, [[int(n % 4)] for n in ids])
    tracemalloc.start()
    found = nearest._meet(200, -1.0)(q, r)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 800_000 and max(b.num_rows for b in found.to_batches()) <= nearest.STRIP * 200
    assert peak < 80e6  # a copy of the pairs sorted at once takes more


def test_a_part_without_queries_is_empty(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL", 20)
    monkeypatch.setattr(nearest, "BLOCK", 15)
    rows = spark.createDataFrame(grouped_vectors(8, 20, 24, 31, 0.05), SCHEMA)
    found = nearest.probed(rows.where("node = 3"), rows, 5, 0.5, Workspace(spark, "few"))
    assert sorted(r.a for r in found.collect()) == [3] * 5
    assert nearest.probed(rows.where("node < 0"), rows, 5, 0.5, Workspace(spark, "nobody")).count() == 0


def test_cities_at_one_place_are_one_home(spark, monkeypatch):
    from mediaspan.operators import metadata

    homes, edges = [], metadata.edges
    monkeypatch.setattr(metadata, "edges", lambda n: homes.append(n) or edges(n))
    cities = spark.range(1, 401).select(F.col("id").alias("city"), (F.col("id") % 4 * 10.0).alias("lat"), F.lit(5.0).alias("lon"))
    points = spark.createDataFrame([(1.0, 5.0), (29.0, 5.0)], "lat double, lon double")
    found = {(r.lat, r.city) for r in metadata.nearest(points, cities).collect()}
    assert found == {(1.0, 4), (29.0, 3)} and homes == [4]
