"""Neighbour graphs of face vectors and their clusters."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaspan.operators.vectors import _COS, dot
from mediaspan.plans.catalog import Library
from mediaspan.plans.numbering import numbered
from mediaspan.plans.registry import query
from mediaspan.plans.workspace import Workspace

DISTANCE, NEIGHBOURS, TILE, STRIP = 0.65, 80, 16_384, 256
#: Pairs that are measured at a time, and that a task holds before it keeps the k best of each vector.
PIECE, HELD = 65_536, 4_000_000
#: Below so many faces the graph is exact by default.
EXACT_BELOW = 8000


def graph_strategy(n: int, mode: str = "auto") -> str:
    """exact or fast: as asked for, else by the number of faces."""
    if mode not in ("auto", "exact", "fast"):
        raise ValueError(f"unknown graph mode {mode}")
    return mode if mode != "auto" else "exact" if n < EXACT_BELOW else "fast"


def _tile_pair(distance: float, k: int):
    def best(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each a its k pairs of least distance, equal ones by b."""
        order = np.lexsort((b, d, a))
        a, b, d = a[order], b[order], d[order]
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
        place = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
        return a[place < k], b[place < k], d[place < k]

    def single(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Both in single precision, with how far a product of them may lie from the exact one; in double precision if they are too large for that."""
        norms = [np.sqrt((v * v).sum(axis=1)).max(initial=0.0) for v in (x, y)]
        if not all(n < 1e15 for n in norms):
            return x, y, np.inf
        return x.astype(np.float32), y.astype(np.float32), (x.shape[1] + 8) * 2.0**-23 * norms[0] * norms[1] + 1e-9

    def promising(s: np.ndarray, slack: float, apart: Callable[[], np.ndarray]) -> np.ndarray:
        """Flat places of the scores that may be within the distance and among the k best of their row or their column."""
        floor = 1 - distance - slack if distance <= 2 else -np.inf
        hits = s > floor
        crowded = [hits.sum(axis=1) > 4 * k, hits.sum(axis=0) > 4 * k]
        if not any(c.any() for c in crowded) or not np.isfinite(slack):
            return np.flatnonzero(hits)
        s = np.where(hits & apart(), s, -np.inf)
        wanted = [np.where(c, 0.0, floor) for c in crowded]
        wanted[0][crowded[0]] = np.partition(s[crowded[0]], -k, axis=1)[:, -k] - 2 * slack
        wanted[1][crowded[1]] = np.partition(s[:, crowded[1]], -k, axis=0)[-k] - 2 * slack
        return np.flatnonzero((s > floor) & ((s >= wanted[0][:, None]) | (s >= wanted[1][None, :])))

    def near(tiles: pd.DataFrame) -> pd.DataFrame:
        """Of each vector of two tiles (or one) its k nearest in the other, a strip of rows at a time.

        Products in single precision choose the pairs that may count, with room
        for their error; these are measured in double precision.
        """
        one = tiles.p.iloc[0] == tiles.q.iloc[0]
        left, right = (tiles[tiles.tile == t] for t in (tiles.p.iloc[0], tiles.q.iloc[0]))
        a, b = (t.node.to_numpy() for t in (left, right))
        x, y = (np.stack(t.embedding.to_numpy()).astype(np.float64) if len(t) else np.zeros((0, 1)) for t in (left, right))
        mine, theirs, found, held = left.owner.to_numpy(), right.owner.to_numpy(), [], 0
        if not len(x) or not len(y):  # a tile of few vectors may be empty
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "d": np.zeros(0)})
        fx, fy, slack = single(x, y)
        for low in range(0, len(a), STRIP):
            apart = lambda low=low: mine[low : low + STRIP, None] != theirs[None, :]
            places = promising(fx[low : low + STRIP] @ fy.T, slack, apart)
            i, j = np.divmod(places, len(b))
            i += low
            d = np.concatenate([1 - np.clip(np.einsum("ij,ij->i", x[i[n : n + PIECE]], y[j[n : n + PIECE]]), -1, 1) for n in range(0, max(len(i), 1), PIECE)])
            keep = (d < distance) & (mine[i] != theirs[j])
            i, j, d = i[keep], j[keep], d[keep]
            # Within a tile every pair comes in both orders; of two tiles both sides get theirs at once.
            found += [best(a[i], b[j], d)] if one else [best(a[i], b[j], d), best(b[j], a[i], d)]
            held += len(d)
            if held > HELD:
                found = [best(*(np.concatenate(c) for c in zip(*found, strict=True)))]
                held = 0
        whole = best(*(np.concatenate(c) for c in zip(*found, strict=True)))
        return pd.DataFrame(dict(zip("abd", whole, strict=True)))

    return near


def neighbours(vectors: DataFrame, work: Workspace, distance: float = DISTANCE, k: int = NEIGHBOURS) -> DataFrame:
    """(a, b, weight) of the k nearest within the distance; weight (1 - d) squared. vectors: node, owner, embedding.

    Nodes of one owner (faces of one file) are never neighbours. Vectors are
    dealt to tiles and every two tiles meet in one group of at most about
    2 x TILE vectors, which puts forward k a vector; no pairs beyond are made,
    and a task keeps k a vector of all its tiles before they are shuffled.
    Null vectors are left out. Vectors are taken to be of one length.
    """
    known = vectors.where("embedding is not null and size(embedding) > 0")
    n = known.count()
    # Smaller tiles if there would be less than some eight pairs of them for a core.
    tiles = max(1, -(-n // TILE), min(-(-n // 1024), math.isqrt(16 * work.spark.sparkContext.defaultParallelism)))
    dealt = known.select("node", "owner", "embedding", F.pmod(F.xxhash64("node"), F.lit(tiles)).cast("int").alias("tile"))
    others = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other")
    paired = dealt.select("*", others).select("node", "owner", "embedding", "tile", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"))
    near = paired.groupBy("p", "q").applyInPandas(_tile_pair(distance, k), "a long, b long, d double")
    best = Window.partitionBy("a").orderBy("d", "b")
    kept = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    return work.table(kept.select("a", "b", F.pow(1 - F.col("d"), F.lit(2)).alias("weight")), "neighbours")


def faces(lib: Library, per_file: int = 1) -> DataFrame:
    """The library's vectors as faces, so many a file."""
    return lib.embeds.select(F.col("file_id").alias("node"), F.floor(F.col("file_id") / per_file).alias("owner"), "embedding")


def _graph_of(lib: Library, per_file: int = 1) -> DataFrame:
    return neighbours(faces(lib, per_file), Workspace(lib.spark, "graph"))


_GRAPH = f""", d as (select x.file_id a, y.file_id b, 1 - greatest(least({_COS.format('x.embedding', 'y.embedding')}, 1), -1) d from v_embeds x join v_embeds y on x.file_id <> y.file_id),
g as (select a, b, (1 - d) * (1 - d) weight from (select *, row_number() over (partition by a order by d, b) r from d where d < {DISTANCE}) where r <= {NEIGHBOURS}) """


@query("C2_J13_W4_knn_graph", _GRAPH + "select a, b, round(weight, 6) weight from g")
def graph(lib: Library) -> DataFrame:
    return _graph_of(lib).select("a", "b", F.round("weight", 6).alias("weight"))


@query("J14_same_file_ban", _GRAPH.replace("on x.file_id <> y.file_id", "on x.file_id // 3 <> y.file_id // 3") + "select a, b, round(weight, 6) weight from g")
def banned_graph(lib: Library) -> DataFrame:
    """Three faces a file, which never meet each other."""
    return _graph_of(lib, 3).select("a", "b", F.round("weight", 6).alias("weight"))


def propagate(edges: DataFrame, work: Workspace, rounds: int = 20, seed_labels: DataFrame | None = None) -> DataFrame:
    """(node, label): every round each node takes the label of greatest weight around it, the smallest of equal ones.

    All nodes move together and the parity of a hash of node and round decides
    who may, so two nodes do not swap labels forever. Nodes in seed_labels
    (node, label) keep theirs.
    """
    edges = work.table(edges, "graph")
    nodes = edges.select(F.col("a").alias("node")).distinct()
    start = nodes.withColumn("label", F.col("node")).withColumn("fixed", F.lit(False))
    if seed_labels is not None:
        start = nodes.join(seed_labels.withColumnRenamed("label", "known"), "node", "left").select("node", F.coalesce("known", "node").alias("label"), F.col("known").isNotNull().alias("fixed"))
    labels = work.table(start, "labels-0")
    for n in range(1, rounds + 1):
        votes = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a", "label").agg(F.round(F.sum("weight"), 9).alias("w"))
        top = votes.groupBy("a").agg(F.max_by("label", F.struct("w", (-F.col("label")).alias("less"))).alias("best")).withColumnRenamed("a", "node")
        may = (F.pmod(F.xxhash64("node", F.lit(n)), F.lit(2)) == 0) & ~F.col("fixed")
        after = labels.join(top, "node").select("node", F.when(may, F.col("best")).otherwise(F.col("label")).alias("label"), "fixed", (F.col("label") != F.col("best")).alias("moved"))
        after = work.table(after, f"labels-{n}")
        work.drop(f"labels-{n - 1}")
        labels = after.drop("moved")
        if not after.where("moved and not fixed").limit(1).count():
            break
    return labels.select("node", "label")


@query("C4_clusters")
def clusters(lib: Library) -> DataFrame:
    labels = propagate(_graph_of(lib), Workspace(lib.spark, "clusters"))
    return labels.groupBy("label").agg(F.count("*").alias("n"), F.min("node").alias("first_file"))


def assignments(labels: DataFrame, known: DataFrame, next_number: int, work: Workspace, min_size: int = 2) -> DataFrame:
    """(node, person_id, person_name) of the nodes that have no person yet, in clusters of min_size nodes or more.

    labels: node, label; known: node, person_id. A cluster with known persons
    gives the least of them; a new one gets the next free "Person N", in the
    order of labels. Known assignments are never overwritten.
    """
    rows = labels.join(known, "node", "left")
    groups = work.table(rows.groupBy("label").agg(F.count("*").alias("n"), F.min("person_id").alias("person_id")).where(F.col("n") >= min_size), "groups")
    fresh = numbered(groups.where("person_id is null").select("label"), ["label"], next_number, "number", work)
    named = fresh.select("label", F.concat(F.lit("Person "), F.col("number").cast("string")).alias("person_name"))
    open_nodes = rows.where("person_id is null").select("node", "label")
    return open_nodes.join(groups.select("label", "person_id"), "label").join(named, "label", "left").select("node", "person_id", "person_name")


@query("C3_C5_assignment")
def assigned(lib: Library) -> DataFrame:
    """Every tenth face has a person already; the others follow their clusters."""
    work = Workspace(lib.spark, "persons")
    known = lib.embeds.where("file_id % 10 = 0").select(F.col("file_id").alias("node"), (F.col("label") + 1).cast("long").alias("person_id"))
    # Labels of persons lie below those of nodes, which are not negative.
    seeds = known.select("node", (-F.col("person_id")).alias("label"))
    labels = propagate(_graph_of(lib), work, seed_labels=seeds)
    number = lib.persons.agg(F.max(F.regexp_extract("name", "([0-9]+)$", 1).try_cast("long"))).first()[0] or 0
    return assignments(work.table(labels, "labels"), known, number + 1, work)


@query("A28_A29_U6_graph_overlap", _GRAPH + ", t as (select a, list_sort(list(b)) f from (select *, row_number() over (partition by a order by weight desc, b) r from g) where r <= 5 group by a), u as (select a, list_sort(list(b)) f from g group by a) select t.a, round(len(list_intersect(t.f, u.f)) / cast(len(list_distinct(list_concat(t.f, u.f))) as double), 6) jaccard from t join u using (a)")
def overlap(lib: Library) -> DataFrame:
    """Jaccard of each node's five best neighbours with all its neighbours."""
    n = _graph_of(lib)
    best = n.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("weight"), "b"))).where("r <= 5").groupBy("a").agg(F.collect_set("b").alias("t"))
    every = n.groupBy("a").agg(F.collect_set("b").alias("u"))
    return best.join(every, "a").select("a", F.round(F.size(F.array_intersect("t", "u")) / F.size(F.array_union("t", "u")), 6).alias("jaccard"))
