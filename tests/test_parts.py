"""Parts of the library against brute force, edges and errors, and the order of sorted queries."""

import math
import random
import struct

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from mediaspan.functions import colour
from mediaspan.operators import cluster, dedup, library, metadata, mutations, pixels, vectors
from mediaspan.plans.catalog import Library
from mediaspan.plans.numbering import numbered
from mediaspan.plans.registry import ORACLES, QUERIES
from mediaspan.plans.workspace import Workspace
from mediaspan.sources import files
from mediaspan.streaming.sync import ChangeLog
from tests_tables import FOLDER, connected

SORTED = sorted(n for n in ORACLES if n.startswith(("O1_", "O6_", "O7_", "O9_", "A9_", "J22_")))


@pytest.mark.parametrize("name", SORTED)
def test_sorted_queries_keep_the_order_of_their_sql(spark, name):
    got, want = [tuple(r) for r in QUERIES[name](spark, FOLDER).collect()], connected().sql(ORACLES[name]).fetchall()
    assert got == want


@pytest.mark.parametrize("name", ["W1_file_position", "C2_J13_W4_knn_graph", "J14_same_file_ban", "V3_V4_scores", "J12_near_hash_links", "J16_nearest_city", "M1_M2_upsert", "D9_delete_candidates"])
def test_plans_have_no_cross_join(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and ("NestedLoop" not in plan or name == "W1_file_position")


def spark_hash(node, n):
    first = xxhash.xxh64(struct.pack("<q", node), seed=42).intdigest()
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64(struct.pack("<i", n), seed=first).intdigest()))[0]


def propagate_brute(edges, rounds, seeds):
    label = {a: seeds.get(a, a) for a, _, _ in edges}
    for n in range(1, rounds + 1):
        moved, after = False, dict(label)
        for node in label:
            votes = {}
            for a, b, w in edges:
                if a == node:
                    votes[label[b]] = votes.get(label[b], 0) + w
            best = min(votes, key=lambda x: (-round(votes[x], 9), x))
            moved |= best != label[node] and node not in seeds
            if node not in seeds and spark_hash(node, n) % 2 == 0:
                after[node] = best
        label = after
        if not moved:
            break
    return label


@pytest.mark.parametrize("seeds", [{}, {0: -5, 7: -6, 13: -6}])
def test_whispers_equal_a_plain_loop(spark, seeds):
    rng = random.Random(4)
    links = {(a, b): rng.choice((0.25, 0.5, 0.81)) for a in range(18) for b in range(a) if a // 6 == b // 6 and rng.random() < 0.8 or rng.random() < 0.03}
    edges = [(a, b, w) for (x, y), w in links.items() for a, b in ((x, y), (y, x))]
    df = spark.createDataFrame(edges, "a long, b long, weight double")
    known = spark.createDataFrame(list(seeds.items()), "node long, label long") if seeds else None
    got = {r.node: r.label for r in cluster.propagate(df, Workspace(spark, "t"), 20, known).collect()}
    assert got == propagate_brute(edges, 20, seeds)


def test_assignment_prefers_known_persons_and_numbers_new_ones(spark):
    labels = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 20), (5, 20), (6, 30), (7, 40), (8, 40)], "node long, label long")
    known = spark.createDataFrame([(2, 77), (3, 70)], "node long, person_id long")
    got = {r.node: (r.person_id, r.person_name) for r in cluster.assignments(labels, known, 5, Workspace(spark, "t")).collect()}
    assert got == {1: (70, None), 4: (None, "Person 5"), 5: (None, "Person 5"), 7: (None, "Person 6"), 8: (None, "Person 6")}


@pytest.mark.parametrize("tile", [1024, 7])
def test_tiles_change_nothing_and_one_file_never_meets_itself(spark, monkeypatch, tile):
    monkeypatch.setattr(cluster, "TILE", tile)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    owner = [i // 2 for i in range(60)]
    rows = [(i, owner[i], v.tolist()) for i, v in enumerate(x)] + [(99, 99, None)]
    got = cluster.neighbours(spark.createDataFrame(rows, "node long, owner long, embedding array<double>"), Workspace(spark, "t"), 0.65, 5).collect()
    want = set()
    for i in range(60):
        near = sorted((1 - x[i] @ x[j], j) for j in range(60) if owner[i] != owner[j] and 1 - x[i] @ x[j] < 0.65)
        want |= {(i, j) for _, j in near[:5]}
    assert {(r.a, r.b) for r in got} == want
    same = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0])], "node long, owner long, embedding array<double>")
    assert cluster.neighbours(same, Workspace(spark, "t")).count() == 0 and cluster.neighbours(same.limit(0), Workspace(spark, "t")).count() == 0


def test_graph_strategy():
    assert [cluster.graph_strategy(n) for n in (7999, 8000)] == ["exact", "fast"] and cluster.graph_strategy(1, "fast") == "fast"
    with pytest.raises(ValueError):
        cluster.graph_strategy(1, "other")


@pytest.mark.parametrize("distance", [6, 8, 12])
def test_near_pairs_lose_none(spark, distance):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(12)]
    hashes = base + [b ^ sum(1 << k for k in rng.sample(range(64), d)) for b in base for d in (1, 6, 8, 9, 12, 13)] + base[:3]
    signed = [struct.unpack("<q", struct.pack("<Q", h))[0] for h in hashes]
    rows = spark.createDataFrame(list(enumerate(signed)), "file_id long, phash long")
    got = {r.node: r.component for r in dedup.near_components(rows, distance, Workspace(spark, "near")).collect()}
    linked = {(i, j) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if bin(hashes[i] ^ hashes[j]).count("1") <= distance}

    def groups(pairs):
        of = {i: i for i in range(len(hashes))}
        for _ in range(len(hashes)):
            for a, b in pairs:
                of[a] = of[b] = min(of[a], of[b])
        return of

    want = groups(linked)
    assert got == {i: want[i] for pair in linked for i in pair}


def test_a_dense_group_of_hashes_gives_stars(spark):
    """All of 2,016 hashes lie within four bits of each other: rows put out grow with the hashes, not with their two million pairs."""
    bits = [(1 << i) | (1 << j) for i in range(64) for j in range(i)]
    rows = [(n, struct.unpack("<q", struct.pack("<Q", h))[0]) for n, h in enumerate(bits)]
    work = Workspace(spark, "dense")
    found = dedup.near_components(spark.createDataFrame(rows, "file_id long, phash long"), 8, work).collect()
    assert {r.component for r in found} == {0} and len(found) == len(rows)
    assert spark.read.parquet(work.path("star")).count() <= 70 * len(rows)


def test_hashes_meet_in_groups_of_bounded_size(spark, monkeypatch):
    """Many values of a band, and one with more hashes than a group takes: 48 rows a hash and blocks, the same links as all pairs give."""
    monkeypatch.setattr(dedup, "GROUP", 40)
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    hashes = sorted({b ^ sum(1 << k for k in rng.sample(range(64), d)) for b in base for d in (0, 5, 11, 13)} | {rng.getrandbits(20) << 44 for _ in range(100)})
    rows = spark.createDataFrame([(n, struct.unpack("<q", struct.pack("<Q", h))[0]) for n, h in enumerate(hashes)], "file_id long, phash long")
    limits = [(low, 8, 1 if n < 5 else 0) for n, low in enumerate(range(0, 64, 8))]
    assert dedup.band_limits(len(hashes), 12) == limits
    sent = dedup.meetings(rows, limits, Workspace(spark, "met")).groupBy("band", "u", "i", "v", "j").count()
    assert sent.agg({"count": "max"}).first()[0] <= 4 * 40 and sent.where("i > 0 or j > 0").count()
    label = list(range(len(hashes)))
    for i, h in enumerate(hashes):
        for j in range(i):
            if (h ^ hashes[j]).bit_count() <= 12 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if v == high else v for v in label]
    want = {n: v for n, v in enumerate(label) if label.count(v) > 1}
    assert {r.node: r.component for r in dedup.near_components(rows, 12, Workspace(spark, "bounded")).collect()} == want


def test_ramp_and_flat_texts_have_their_hashes(spark, tmp_path):
    texts = ["".join(chr(200 - i % 9 * 5) for i in range(72)), "a" * 500, "".join(chr(200 - i // 40 % 9 * 5) for i in range(72 * 40)), "ab" * 20_000, "", None]
    spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.file_id - 1: r.phash for r in dedup.phashes(Library(spark, f"file://{tmp_path}")).collect()}
    assert got == {0: -1, 1: 0, 2: -1, 3: 0, 4: 0, 5: 0}


def test_numbers_are_consecutive(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("k"))
    got = numbered(rows, ["k"], 11, "n", Workspace(spark, "t")).collect()
    assert {r.n - 11 == r.k for r in got} == {True} and numbered(rows.limit(0), ["k"], 1, "n", Workspace(spark, "t")).count() == 0


def test_only_settable_columns_are_set(spark):
    df = spark.createDataFrame([(1, 0)], "id long, rating int")
    with pytest.raises(ValueError):
        mutations.set_columns(df, spark.createDataFrame([(1, "x")], "id long, name string"))
    with pytest.raises(ValueError):
        mutations.add_to_collections(df, df, list(range(11)))


def test_user_comments(spark):
    cases = [(b"", None), (b"ASCII\0\0\0 hi \0\0", "hi"), (b"\0" * 8 + b"x", "x"), (b"UNICODE\0" + "﻿hé".encode("utf-16-le"), "hé"), (b"UNICODE\0" + b"\xfe\xff" + "hé\0z".encode("utf-16-be"), "hé"), (b"JIS\0\0\0\0\0ok", "ok"), (b"plain text", "plain text"), (b"short", "short"), (b"ASCII\0\0\0", "ASCII"), (None, None)]
    got = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c binary").select("i", metadata.user_comment(F.col("c")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: t for i, (_, t) in enumerate(cases)}


def test_clip_queries(spark):
    cases = {"bird": "a photo of a bird", " insect ": "a photo of an insect", "The cat": "a photo of The cat", "one two three four": "one two three four", "猫": "猫", "a photo of x": "a photo of x", "": ""}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", metadata.clip_query(F.col("t")).alias("q")).collect()
    assert {r.t: r.q for r in got} == cases


def test_folders_are_walked_without_hidden_ones(spark, tmp_path):
    for name in ("a.jpg", "sub/b.cr2", ".hidden/c.jpg", "sub/.d.jpg", "sub/deep/e.mp4"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    walked = files.walk(spark, str(tmp_path)).select("name", library.file_type(F.col("name")).alias("kind")).collect()
    assert {(r.name, r.kind) for r in walked} == {("a.jpg", 1), ("b.cr2", 3), ("e.mp4", 2)}
    assert [r.name for r in files.listing(spark, str(tmp_path)).collect()] == ["a.jpg"]
    (tmp_path / "g.csv").write_text('lat,lon,name,admin1,cc\n1.5,2.5,"Town, East",A,XX\n')
    assert tuple(files.gazetteer(spark, str(tmp_path / "g.csv")).first()) == (1.5, 2.5, "Town, East", "A", "XX")


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log")
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    rows = spark.sql("select * from values (1L, timestamp'2024-01-01', 5L, 'a', 1d), (2L, timestamp'2024-01-02', 5L, 'b', 2d), (3L, timestamp'2024-01-02', null, 'c', 3d) t(event_id, ts, user_id, event_type, value)").select(*[c.split()[0] for c in schema.split(", ")])
    for _ in range(2):
        log.write(rows, 0)
    log.write(rows.where("event_id = 1"), 1)
    assert [(r.file_id, r.event_id, r.event_type, r.n) for r in log.state().collect()] == [(5, 2, "b", 3)]


def test_searches_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (21, [0.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [1.0]), (5, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "file_id long, embedding array<float>")
    got = vectors.ranked(df.where("file_id in (1, 21)"), df).collect()
    assert [(r.query_id, r.file_id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2, 1), (1, 5, 2)]
    assert math.isclose(got[0].score, 1 / math.hypot(1, 0.1), rel_tol=1e-6) and vectors.ranked(df.limit(0), df).count() == 0


def test_changes_of_colour(spark):
    rgb = tuple(F.col(c) for c in "rgb")
    rows = spark.createDataFrame([(0, 0, 0), (255, 255, 255), (128, 128, 128), (250, 10, 90)], "r int, g int, b int")
    look = lambda change: [tuple(r) for r in rows.select(*change).collect()]
    plain = [tuple(r) for r in rows.collect()]
    assert look(colour.adjust(rgb)) == plain and look(colour.tones(rgb, 0, 0)) == plain and look(colour.fade(rgb, 0)) == plain
    assert look(colour.adjust(rgb, brightness=-500)) == [(0, 0, 0)] * 4
    assert all(r == g == b for r, g, b in look(colour.adjust(rgb, saturation=0)))
    assert look(colour.invert(colour.invert(rgb))) == plain
    assert look(colour.sepia(rgb))[:2] == [(0, 0, 0), (255, 255, 238)]
    assert look(colour.fade(rgb, 100))[0] == (70, 70, 70) and look(colour.tones(rgb, -100, 100))[:2] == [(89, 89, 89), (166, 166, 166)]


def test_a_dark_channel_counts_as_one(spark, monkeypatch):
    dark = spark.createDataFrame([(1, 0, 0, 6, 0), (1, 1, 0, 6, 1)], "file_id long, at int, r int, g int, b int")
    monkeypatch.setattr(pixels, "pixels", lambda lib: dark)
    assert [tuple(r) for r in pixels.gray_world(None).collect()] == [(1, 2.16667, 0.36111, 2.16667)]


def test_keepers_of_large_groups(spark):
    lib = Library(spark, FOLDER)
    want = {}
    for r in dedup.keepers(lib).collect():
        want.setdefault(r["hash"], []).append((r.score, r.is_keep))
    assert want and all(sorted(v) == [(i + 1, i + 1 == len(v)) for i in range(len(v))] for v in want.values())


def test_tiles_measure_near_pairs_exactly_and_hold_few(spark, monkeypatch):
    """Tables of one direction and little spread: crowded rows, equal vectors, and products too close for single precision."""
    monkeypatch.setattr(cluster, "HELD", 500)
    rng = np.random.default_rng(8)
    x = np.concatenate([np.ones((300, 8)) + 1e-4 * rng.normal(size=(300, 8)), np.ones((40, 8))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    tiles = pd.DataFrame({"node": range(340), "owner": [i // 2 for i in range(340)], "embedding": list(x), "tile": 0, "p": 0, "q": 0})
    got = cluster._tile_pair(0.65, 3)(tiles)
    assert len(got) == 340 * 3
    score = lambda a, b: 1 - np.clip(x[a] @ x[b], -1, 1)
    for a, near in got.groupby("a"):
        want = sorted(score(a, b) for b in range(340) if a // 2 != b // 2)[:3]
        assert np.allclose(sorted(near.d), want, atol=1e-14)
    two = tiles.assign(tile=[i % 2 for i in range(340)], q=1)
    crossed = cluster._tile_pair(0.65, 3)(two)
    assert len(crossed) == 340 * 3 and all(a % 2 != b % 2 and a // 2 != b // 2 for a, b in zip(crossed.a, crossed.b, strict=True))
    assert len(cluster._tile_pair(0.65, 3)(tiles.assign(embedding=list(x * 1e30)))) == 340 * 3  # too long for single precision


@pytest.mark.parametrize("name", ["M8_has_tags", "X35_face_crop"])
def test_order_lines_are_dealt_by_their_number(spark, monkeypatch, name):
    """Tasks grow in number, not in rows; results are the SQL's."""
    from mediaspan.plans import catalog
    from mediaspan.plans.registry import ORACLES
    from tests_tables import connected

    monkeypatch.setattr(catalog, "ROWS_A_TASK", 900)
    assert Library(spark, FOLDER).deals() == 7
    got = QUERIES[name](spark, FOLDER)
    assert ", 7), REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(connected().sql(ORACLES[name]).limit(1 << 30).fetchall())
