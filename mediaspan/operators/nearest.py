"""Approximate neighbours: an index of cells over all vectors, probed and scored exactly.

Centres of cells are fitted on a bounded sample by spherical k-means. Every
vector lies in the cell of its nearest centre; a query visits the cells of its
nearest few centres, as many as found the wanted share of true neighbours on
the sample. Blocks of queries meet parts of cells, a strip of queries and a
cell at a time in matrix products; a query is sent once to a part, with its
cells there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaspan.operators.cluster import DISTANCE, NEIGHBOURS, faces, graph_strategy, neighbours
from mediaspan.operators.vectors import MOST, PREFILTER, image_search, queries_of, ranked, search
from mediaspan.plans.catalog import Library
from mediaspan.plans.registry import query
from mediaspan.plans.workspace import Workspace

#: Vectors that the centres are fitted on, and sampled queries that the number of probes is set by.
SAMPLE, TRIALS = 20_000, 512
#: Vectors of a cell on average, until there are MOST_CELLS.
CELL, MOST_CELLS = 512, 4096
#: Vectors of one kind that meet in one task on average, queries and rows multiplied at a time, and pairs held before the best are kept.
BLOCK, STRIP, PIECE, HELD = 16_384, 256, 4096, 262_144
#: Queries whose visits are worked out at a time.
VISITS = 2048
#: Share of the sample's true neighbours that the probes have to find.
RECALL = 0.97
#: Candidates kept for each neighbour asked for, before same owners and far ones go.
CANDIDATES = 3
#: A search over at least so many vectors may take the index.
SEARCH_FROM = 8000


@dataclass(frozen=True)
class Index:
    """Centres of cells, a unit vector a row, and how many cells a query visits."""

    centres: np.ndarray
    probes: int

    def nearest(self, vectors: np.ndarray, most: int | None = None) -> np.ndarray:
        """The cells that each unit vector visits (or so many), nearest first."""
        most = self.probes if most is None else most
        found = np.empty((len(vectors), most), np.int32)
        for low in range(0, len(vectors), STRIP):
            near = -(vectors[low : low + STRIP] @ self.centres.T)
            found[low : low + STRIP] = np.argsort(near, axis=1, kind="stable")[:, :most]
        return found


def units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def unit_rows(vectors: pd.Series) -> np.ndarray:
    return units(np.stack(vectors.to_numpy()))


def usable(vectors: DataFrame) -> DataFrame:
    """Vectors of finite numbers with a norm; the others have no direction."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0))


def fit(vectors: DataFrame, n: int, k: int, recall: float = RECALL) -> Index:
    """An index for n usable vectors (node, embedding) and k neighbours, from at most SAMPLE of them.

    The sample is drawn by a hash of the node, so a run that starts again
    draws the same. With one cell the index is exact.
    """
    drawn = vectors if n <= SAMPLE else vectors.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int((1 << 30) * 0.9 * SAMPLE / n))
    found = drawn.select("node", "embedding").limit(SAMPLE).toPandas().sort_values("node")
    cells = max(1, min(MOST_CELLS, n // CELL, len(found) // 4))
    if cells == 1:
        size = len(found.embedding.iloc[0]) if len(found) else 1
        return Index(np.zeros((1, size)), 1)
    x = unit_rows(found.embedding)
    rng = np.random.default_rng(7)
    centres = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(12):
        own = np.concatenate([np.argmax(x[low : low + STRIP] @ centres.T, axis=1) for low in range(0, len(x), STRIP)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    own = Index(centres, 1).nearest(x)[:, 0]
    trials = rng.choice(len(x), min(TRIALS, len(x)), replace=False)
    wanted = max(1, min(len(x) - 1, round(k * len(x) / n)))
    scores = x[trials] @ x.T
    scores[np.arange(len(trials)), trials] = -2
    true = np.argpartition(-scores, wanted - 1, axis=1)[:, :wanted]
    place = np.argsort(np.argsort(-(x[trials] @ centres.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, own[true], axis=1).ravel())
    return Index(centres, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1)


def _placed(vectors: DataFrame, index: Index, parts: int, own: bool) -> DataFrame:
    """vectors (node, owner, embedding), one row a part, with the cells in that part: the own cell alone, or all that the vector visits. Those of another length than the index's are left out."""

    def run(given: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in given:
            if own and len(frame):
                cells = index.nearest(unit_rows(frame.embedding), 1)
                yield frame.assign(cells=pd.Series(list(cells), frame.index, dtype=object), part=cells[:, 0] % np.int32(parts))
                continue
            for low in range(0, len(frame), VISITS):
                some = frame[low : low + VISITS]
                found = index.nearest(unit_rows(some.embedding))
                for part in range(parts):
                    inside = found % parts == part
                    here = inside.any(axis=1)
                    if here.any():
                        cells = [row[mask] for row, mask in zip(found[here], inside[here], strict=True)]
                        yield some[here].assign(cells=pd.Series(cells, some.index[here], dtype=object), part=np.int32(part))

    of_length = vectors.where(F.size("embedding") == index.centres.shape[1])
    kind = of_length.schema["embedding"].dataType.simpleString()
    return of_length.mapInPandas(run, f"node long, owner long, embedding {kind}, cells array<int>, part int")


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, one list after the other, and the length of each."""
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(whole).to_numpy(zero_copy_only=False)


def _meet(k: int, floor: float):
    def best(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each a its k best, equal ones by b, and their places from 0."""
        order = np.lexsort((b, -score, a))
        a, b, score = a[order], b[order], score[order]
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
        place = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
        kept = place < k
        return a[kept], b[kept], score[kept], place[kept]

    def near(q: pa.Table, r: pa.Table) -> pa.Table:
        """Of each query its best CANDIDATES x k among the rows of each cell that it visits, without its own owner's and those under the floor; k of them over all cells here.

        Strips of queries are done one after the other, each with pieces of the
        cells' rows, so beside the vectors and the result no more than one
        strip's scores are held. The result comes in a batch a strip, as the
        other side holds a batch whole.
        """
        schema = pa.schema({"a": pa.int64(), "b": pa.int64(), "score": pa.float64()})
        q = q.filter(pc.is_valid(q["node"]))
        if not len(q) or not len(r):
            return schema.empty_table()
        # Rows lie by cell and id; places among the sorted ids stand for them, null ones last.
        by_id = pc.sort_indices(r["node"])
        there, by_id = r["node"].combine_chunks().take(by_id), by_id.to_numpy()
        cell = _lists(r["cells"])[0][by_id]
        homes = np.argsort(cell, kind="stable").astype(np.int32)
        names, edges = np.unique(cell[homes], return_index=True)
        edges = np.append(edges, len(homes))
        y, owners = _lists(r["embedding"])[0].reshape(len(r), -1)[by_id[homes]], r["owner"].to_numpy()[by_id[homes]]
        visited, n_visits = _lists(q["cells"])
        # Queries of one nearest cell lie together, and of one id.
        asking = np.lexsort((q["node"].to_numpy(), visited[np.cumsum(n_visits) - n_visits]))
        line = np.empty(len(q), np.int64)
        line[asking] = np.arange(len(q))
        visitor = np.repeat(line, n_visits)
        order = np.lexsort((visited, visitor // STRIP))
        visited, visitor = visited[order], visitor[order]
        x, here, mine = _lists(q["embedding"])[0].reshape(len(q), -1)[asking], q["node"].to_numpy()[asking], q["owner"].to_numpy()[asking]
        done = []
        for low in range(0, len(x), STRIP):
            own, some = units(x[low : low + STRIP]), slice(*np.searchsorted(visitor // STRIP, (low // STRIP, low // STRIP + 1)))
            ids, who = np.unique(here[low : low + STRIP], return_inverse=True)
            least = np.full(len(ids), np.nextafter(floor, np.inf))
            found, held = [], 0
            for name in np.unique(visited[some]):
                at = np.searchsorted(names, name)
                if at == len(names) or names[at] != name:
                    continue
                lines = visitor[some][slice(*np.searchsorted(visited[some], (name, name + 1)))] - low
                for first in range(edges[at], edges[at + 1], PIECE):
                    rows = slice(first, min(first + PIECE, edges[at + 1]))
                    scores = own[lines] @ units(y[rows]).T
                    np.clip(scores, -1, 1, out=scores)
                    scores[mine[low + lines, None] == owners[None, rows]] = -np.inf
                    hits = scores >= least[who[lines], None]
                    crowded = np.flatnonzero(hits.sum(axis=1) > CANDIDATES * k)
                    if len(crowded):
                        s, most = np.where(hits[crowded], scores[crowded], -np.inf), CANDIDATES * k
                        edge = np.partition(s, -most, axis=1)[:, [-most]]
                        above, equal = s > edge, s == edge
                        hits[crowded] = above | equal & (equal.cumsum(axis=1) <= most - above.sum(axis=1, keepdims=True))
                    i, j = np.nonzero(hits)
                    found.append((who[lines[i]], homes[rows][j], scores[i, j]))
                    held += len(i)
                    if held > HELD:
                        a, b, score, place = best(*(np.concatenate(c) for c in zip(*found, strict=True)))
                        least[a[place == k - 1]] = score[place == k - 1]
                        found, held = [(a, b, score)], 0
            if found:
                a, b, score, _ = best(*(np.concatenate(c) for c in zip(*found, strict=True)))
                done.append(pa.record_batch([pa.array(ids[a]), there.take(pa.array(b)), pa.array(score)], schema=schema))
        return pa.Table.from_batches(done, schema)

    return near


def probed(queries: DataFrame, rows: DataFrame, k: int, floor: float, work: Workspace, recall: float = RECALL) -> DataFrame:
    """(a, b, score): for every query node its k best rows by cosine above the floor among the cells that it visits.

    Both tables have node, owner and embedding; rows of a query's owner are not
    its neighbours. All usable rows of the length that most have are in the
    index. Cells are dealt to parts of about BLOCK rows, and a query is sent once
    to each part that it visits, with the cells that it visits there; a part's
    rows go once to each block of about BLOCK queries. So copies grow with
    parts, not with cells.
    """
    rows = work.table(usable(rows).select("node", "owner", "embedding"), "rows")
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return work.spark.createDataFrame([], "a long, b long, score double")
    rows = rows.where(F.size("embedding") == sizes["size"])
    index = fit(rows, sizes["count"], k, recall)
    groups = max(1, -(-sizes["count"] // BLOCK))
    askers = usable(queries).select("node", "owner", "embedding")
    blocks = max(1, -(-askers.count() // BLOCK))
    block = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    held, visits = work.table(_placed(rows, index, groups, True), "held"), _placed(askers, index, groups, False)
    counts = {r["part"]: r["count"] for r in held.groupBy("part").count().collect()}  # a number a part
    # A part that much more than BLOCK rows fill, as copies do, is dealt to several.
    slices = F.element_at(F.array(*[F.lit(-(-counts.get(part, 1) // (2 * BLOCK))) for part in range(groups)]), F.col("part") + 1)
    own, all_of = F.pmod(F.xxhash64("node", F.lit("slice")), slices).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice")
    columns, keys = ["node", "owner", "embedding", "cells", "part"], ["part", "slice", "block"]
    sides = [df.select(*columns, a).select("*", b) for df, a, b in ((visits, block, all_of), (held, own, every))]
    pairs = sides[0].groupBy(*keys).cogroup(sides[1].groupBy(*keys)).applyInArrow(_meet(k, floor), "a long, b long, score double")
    best = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def fast_neighbours(vectors: DataFrame, work: Workspace, distance: float = DISTANCE, k: int = NEIGHBOURS) -> DataFrame:
    """The graph of cluster.neighbours, found by the index."""
    found = probed(vectors, vectors, k, 1 - distance, work)
    return work.table(found.select("a", "b", F.pow("score", F.lit(2)).alias("weight")), "fast-neighbours")


def neighbour_graph(vectors: DataFrame, work: Workspace, mode: str = "auto", distance: float = DISTANCE, k: int = NEIGHBOURS) -> DataFrame:
    """The exact graph or the one by the index, as asked for or by the number of vectors."""
    n = usable(vectors).count() if mode == "auto" else 0
    build = neighbours if graph_strategy(n, mode) == "exact" else fast_neighbours
    return build(vectors, work, distance, k)


def ranked_auto(queries: DataFrame, rows: DataFrame, work: Workspace, mode: str = "auto", prefilter: float = PREFILTER, most: int = MOST) -> DataFrame:
    """vectors.ranked, by the index from SEARCH_FROM rows on or if asked for. queries and rows: file_id, embedding.

    The index puts forward CANDIDATES x most rows a query and cell, scored exactly.
    """
    if mode == "exact" or (mode == "auto" and rows.count() < SEARCH_FROM):
        return ranked(queries, rows, prefilter, most)
    a, b = (df.select(F.col("file_id").alias("node"), F.col("file_id").alias("owner"), "embedding") for df in (queries, rows))
    found = probed(a, b, most, prefilter, work).select(F.col("a").alias("query_id"), F.col("b").alias("file_id"), "score")
    each = Window.partitionBy("query_id")
    return found.withColumn("rank", F.row_number().over(each.orderBy(F.desc("score"), "file_id"))).withColumn("top", F.max("score").over(each))


def parity(exact: DataFrame, other: DataFrame) -> DataFrame:
    """(node, n_exact, n_other, n_both, jaccard) of every node with neighbours in either graph."""
    sides = [df.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias(name)) for df, name in ((exact, "x"), (other, "y"))]
    met = sides[0].join(sides[1], "node", "full")
    x, y = (F.coalesce(c, F.array().cast("array<bigint>")) for c in ("x", "y"))
    both = F.size(F.array_intersect(x, y))
    return met.select("node", F.size(x).alias("n_exact"), F.size(y).alias("n_other"), both.alias("n_both"), (both / F.size(F.array_union(x, y))).alias("jaccard"))


@query("J15_C1_fast_graph")
def fast_graph(lib: Library) -> DataFrame:
    """Neighbours of every vector by the index, whatever their number."""
    return neighbour_graph(faces(lib), Workspace(lib.spark, "fast-graph"), "fast").select("a", "b", F.round("weight", 6).alias("weight"))


@query("J15_fast_same_file_ban")
def fast_banned(lib: Library) -> DataFrame:
    return neighbour_graph(faces(lib, 3), Workspace(lib.spark, "fast-banned"), "fast").select("a", "b", F.round("weight", 6).alias("weight"))


@query("A28_fast_graph_parity")
def fast_parity(lib: Library) -> DataFrame:
    """The graph by the index against the exact one: means over nodes, and edges found."""
    work = Workspace(lib.spark, "parity")
    found = parity(neighbour_graph(faces(lib), work, "exact"), neighbour_graph(faces(lib), work, "fast"))
    return found.agg(F.count("*").alias("nodes"), F.avg("jaccard").alias("mean_jaccard"), F.sum("n_exact").alias("edges_exact"), F.sum("n_other").alias("edges_fast"), (F.sum("n_both") / F.sum("n_exact")).alias("recall"))


@query("V9_fast_text_search")
def fast_text_search(lib: Library) -> DataFrame:
    found = ranked_auto(queries_of(lib), lib.embeds, Workspace(lib.spark, "fast-search"), "fast")
    return search(found, 0.19).select("query_id", "file_id", F.round("score", 6).alias("score"))


@query("V9_fast_image_search")
def fast_image_search(lib: Library) -> DataFrame:
    found = ranked_auto(queries_of(lib), lib.embeds, Workspace(lib.spark, "fast-images"), "fast")
    return image_search(found, 0.19).select("query_id", "file_id", F.round("score", 6).alias("score"))
