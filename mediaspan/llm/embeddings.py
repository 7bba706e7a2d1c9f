"""Near-duplicate embeddings: spherical k-means cells and blocked cosine products.

Centroids are fitted on a bounded sample. A vector belongs to the cell of its
nearest centroid and also visits every higher cell that could hold a vector
within the wanted cosine: its distance from the bisecting plane is at most that
of the farthest partner, so no link is lost at any size. Cells are cut into
blocks of bounded size and blocks are compared two at a time by a matrix
product in double precision; the first visitors of a cell come along where its
members meet themselves. A block pair returns counts and a spanning star of each
group it links, never its pairs. Vectors travel in the precision of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from mediaspan.plans.components import connected_components
from mediaspan.plans.workspace import Workspace

#: Vectors that centroids are fitted on at most, vectors of one label aimed at in a cell, vectors of a block.
SAMPLE, CELL, BLOCK = 20_000, 4096, 4096
#: Centroids at most, so that neither the driver nor a task holds more; larger tables have larger cells of more blocks.
MOST_CELLS = 4096
#: Products held at a time.
PRODUCTS = 1 << 22


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _chunks(rows: int, centers: int) -> Iterator[slice]:
    step = max(1, PRODUCTS // max(centers, 1))
    for low in range(0, rows, step):
        yield slice(low, low + step)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows; an empty cell takes the row that fits its own worst."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        cell, best = np.empty(len(x), dtype=np.int64), np.empty(len(x))
        for part in _chunks(len(x), len(centers)):
            sims = x[part] @ centers.T
            cell[part], best[part] = sims.argmax(axis=1), sims.max(axis=1)
        total = np.zeros_like(centers)
        np.add.at(total, cell, x)
        empty = np.flatnonzero(np.einsum("ij,ij->i", total, total) < 1e-12)
        total[empty] = x[np.argsort(best)[: len(empty)]]
        centers = _unit(total)
    return centers


def _matrix(values: pd.Series, dim: int) -> np.ndarray:
    """Rows of packed components as doubles."""
    raw = values.to_numpy()
    if not len(raw):
        return np.zeros((0, dim))
    return np.frombuffer(b"".join(raw), dtype=f"<f{len(raw[0]) // dim}").reshape(len(raw), dim).astype("<f8")


def _assign(centers_of, cosine: float) -> Callable:
    """(label, dim, cell, visit, vec_id, copies, v): home cells, then visits."""
    reach = np.sqrt(2 - 2 * cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            for dim, part in rows.groupby("dim"):
                centers = centers_of.value.get(int(dim))
                if centers is None:
                    centers = np.eye(1, int(dim))
                for chunk in _chunks(len(part), len(centers)):
                    some = part.iloc[chunk]
                    x = _unit(_matrix(some["v"], int(dim)))
                    sims = x @ centers.T
                    home = sims.argmax(axis=1)
                    own = sims[np.arange(len(x)), home]
                    apart = np.sqrt(np.maximum(2 - 2 * (centers[home] @ centers.T), 0))
                    near = (own[:, None] - sims <= reach * apart + 1e-9) & (np.arange(len(centers)) > home[:, None])
                    row, cell = np.nonzero(near)
                    at = np.concatenate([np.arange(len(x)), row])
                    out = some.iloc[at][["label", "dim", "vec_id", "copies", "v"]].copy()
                    out.insert(2, "cell", np.concatenate([home, cell]))
                    out.insert(3, "visit", np.repeat([False, True], [len(x), len(row)]))
                    yield pa.RecordBatch.from_pandas(out, preserve_index=False, schema=_CELLS)

    return run


_CELLS = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("cell", pa.int32()), ("visit", pa.bool_()), ("vec_id", pa.int64()), ("copies", pa.int64()), ("v", pa.binary())])


def _linked(a: pd.DataFrame, b: pd.DataFrame | None, dim: int, cosine: float) -> np.ndarray:
    """Which rows of a link with which of b, or with the others of a."""
    raw_a = _matrix(a["v"], dim)
    raw_b = raw_a if b is None else _matrix(b["v"], dim)
    xa, xb = _unit(raw_a), _unit(raw_b)
    link = np.empty((len(xa), len(xb)), dtype=bool)
    for part in _chunks(len(xa), len(xb)):
        sims = xa[part] @ xb.T
        for i, j in zip(*np.nonzero(np.abs(sims - cosine) < 1e-9), strict=True):
            p, q = raw_a[part.start + i], raw_b[j]
            sims[i, j] = p @ q / (np.sqrt(p @ p) * np.sqrt(q @ q))
        link[part] = sims >= cosine
    if b is None:
        np.fill_diagonal(link, False)
    return link


def _compare(a: pd.DataFrame, b: pd.DataFrame | None, dim: int, cosine: float) -> pd.DataFrame:
    """(vec_id, n_links, low): links of a with b, or within a; low is the smallest id of the group linked here."""
    link = _linked(a, b, dim, cosine)
    rows, cols = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
    link = link[np.ix_(rows, cols)]
    ia, ca = a["vec_id"].to_numpy()[rows], a["copies"].to_numpy()[rows]
    ib, cb = ((a if b is None else b)[c].to_numpy()[cols] for c in ("vec_id", "copies"))
    na, nb = np.zeros(len(rows), dtype=np.int64), np.zeros(len(cols), dtype=np.int64)
    parts = list(_chunks(len(rows), len(cols)))
    for part in parts:
        na[part] = link[part] @ cb
        nb += link[part].T @ ca[part]
    la, lb, top = ia.copy(), ib.copy(), np.iinfo(np.int64).max
    changed = bool(len(rows))
    while changed:
        before = la.sum(dtype=object), lb.sum(dtype=object)
        for part in parts:
            la[part] = np.minimum(la[part], np.where(link[part], lb[None, :], top).min(axis=1))
            lb = np.minimum(lb, np.where(link[part], la[part][:, None], top).min(axis=0))
        changed = before != (la.sum(dtype=object), lb.sum(dtype=object))
    found = pd.DataFrame({"vec_id": ia, "n_links": na, "low": la})
    return found if b is None else pd.concat([found, pd.DataFrame({"vec_id": ib, "n_links": nb, "low": lb})])


def _meet(cosine: float) -> Callable:
    """One block with itself and with its cell's first visitors, or two blocks."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, dim = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1], int(key[1])
        found = [pd.DataFrame({"vec_id": [], "n_links": [], "low": []}, dtype="int64")]
        if key[3] == key[4]:
            found.append(_compare(a, None, dim, cosine))
        if len(a) and len(b):
            found.append(_compare(a, b, dim, cosine))
        return pd.concat(found)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components as bytes. Doubles are divided by their largest first, so that no product overflows; floats need not be."""
    for batch in batches:
        for low in range(0, batch.num_rows, 1000):
            part = batch.slice(low, 1000)
            column = part.column("e")
            size = np.diff(column.offsets.to_numpy())
            values = column.flatten().to_numpy(zero_copy_only=False)
            if values.itemsize == 8:
                values = values / np.repeat(np.maximum.reduceat(np.abs(values), np.cumsum(size) - size), size)
            values = values + values.dtype.type(0)
            ends = np.concatenate([[0], np.cumsum(size)]) * values.itemsize
            v = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(values.tobytes())])
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(size, pa.int32()), part.column("vec_id"), v], ["label", "dim", "vec_id", "v"])


def near_vectors(spark: SparkSession, vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors are compared if their labels are equal and not null and they have as
    many components. One that is null, empty, zero or holds a null or non-finite
    component links with nothing and is kept. Equal vectors of a label are
    compared once and counted as often as they occur. Repeated rows of an id
    count as links of each other. Other columns are ignored.
    """
    work = Workspace(spark, "vectors")
    v = F.col("e")
    kind = "float" if isinstance(getattr(vectors.schema[embedding].dataType, "elementType", None), FloatType) else "double"
    plain = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast(f"array<{kind}>").alias("e"))
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    # Equal vectors are known by a digest of 256 bits, so that ids can be met again without the vectors.
    ready = plain.where(usable).mapInArrow(_packed, "label string, dim int, vec_id long, v binary").withColumn("digest", F.unhex(F.sha2("v", 256)))
    same = ["label", "dim", "digest"]
    distinct = work.table(ready.groupBy(*same).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("v").alias("v")), "distinct")
    by_label = distinct.groupBy("label", "dim").agg(F.count("*").alias("c"))
    n, most = by_label.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0))).first()
    share = max(1, -(-n // SAMPLE))
    sample = distinct.where(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0).select("dim", "v").toPandas()
    k = min(max(1, -(-most // CELL)), MOST_CELLS)
    centers = {int(d): spherical_kmeans(_unit(_matrix(part["v"], int(d))), k) for d, part in sample.groupby("dim")}
    cells = work.table(distinct.drop("digest").mapInArrow(_assign(spark.sparkContext.broadcast(centers), cosine), "label string, dim int, cell int, visit boolean, vec_id long, copies long, v binary"), "cells")

    size = cells.groupBy("label", "dim", "cell").agg(F.count_if(~F.col("visit")).alias("m"), F.count_if(F.col("visit")).alias("q"))
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int")
    dealt = cells.join(size, ["label", "dim", "cell"]).withColumns({"nm": blocks("m"), "nq": blocks("q")})
    mine = F.pmod(F.xxhash64("vec_id"), F.when(F.col("visit"), F.col("nq")).otherwise(F.col("nm"))).cast("int")
    dealt = dealt.withColumn("k", mine)
    # Members meet the members of every block; visitors (numbered after them, but for the first block of them) meet every member block.
    every = F.sequence(F.lit(0), F.col("nm") - 1)
    place = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    among = F.transform(every, lambda j: place(F.least(j, F.col("k")), F.greatest(j, F.col("k")), (j < F.col("k")).cast("int")))
    guests = F.when(F.col("nq") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.col("nq") - 1, F.lit(1))), lambda j: place(F.col("k"), F.col("nm") + j, F.lit(0)))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    visits = F.transform(every, lambda i: place(i, F.when(F.col("k") == 0, i).otherwise(F.col("nm") + F.col("k")), F.lit(1)))
    met = dealt.withColumn("p", F.explode(F.when(F.col("visit"), visits).otherwise(F.concat(among, guests))))
    pairs = met.select("label", "dim", "cell", "p.i", "p.j", "p.side", "vec_id", "copies", "v")
    found = work.table(pairs.groupBy("label", "dim", "cell", "i", "j").applyInPandas(_meet(cosine), "vec_id long, n_links long, low long"), "found")
    links = found.groupBy("vec_id").agg(F.sum("n_links").alias("n"))
    components = connected_components(found, "vec_id", "low", work)
    work.drop("cells")

    known = distinct.join(links, "vec_id", "left").join(components.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    rows = known.select(*same, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    good = ready.select(*same, "vec_id").join(rows, same).select("vec_id", "n_links", "component_id")
    bad = plain.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
