"""MinHash near-duplicate groups with tensored banding.

Two small collections of short minhash groups are drawn; every pair of a group
of the first and one of the second is a table key. 10 groups of 2 and 12 of 3
give 120 tables of 5 hashes from 56 minhashes instead of 600. A pair of
Jaccard 0.8 is missed by all tables with a probability of 2e-4, one of 0.85
with 2e-5.

Steps: shingle sets of whole texts; equal sets collapse to their smallest id;
table keys shared by several sets; one leader each key (the set that shares most
keys); each set checks its likeliest leader exactly; components; then every
other pair that shares a key and lies in different components is checked
exactly, so no candidate link is lost. Nothing is collected, no bucket is
gathered into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspan.llm import textbytes as tb
from mediaspan.plans.components import connected_components
from mediaspan.plans.workspace import Workspace

LEFT, RIGHT = (10, 2), (12, 3)
N_HASHES = LEFT[0] * LEFT[1] + RIGHT[0] * RIGHT[1]
#: Ids above this count are joined by a shuffle instead of a broadcast (16 bytes each).
BROADCAST_IDS = 1_000_000

#: Components of this many sets are compared in blocks of so many.
BIG, BLOCK = 16, 256
#: Rows of one key that meet in one task are about so many on each side.
KEY_BLOCK = 1024

_rng = np.random.default_rng(20240901)
_XOR = _rng.integers(0, 2**63, N_HASHES, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the rows, and the offsets of the rows in them."""
    w = tb.words(data, at, tb.SPACED)
    h = w.hashes()
    g = tb.grams(h, size)
    parts, ends = [], [0]
    for r in range(len(at) - 1):
        a, b = int(w.first[r]), int(w.first[r + 1])
        if b - a >= size:
            one = np.unique(g[a : b - size + 1])
        elif b > a:
            one = tb.grams(h[a:b], b - a)
        else:
            one = np.zeros(0, np.uint64)
        parts.append(one)
        ends.append(ends[-1] + len(one))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(ends)


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for low, high, data, at in tb.slices(batch.column(1)):
                sets, ends = shingle_sets(data, at, size)
                n = np.diff(ends)
                full = n > 0
                starts = ends[:-1][full]
                sig = np.zeros((high - low, N_HASHES), dtype=np.uint32)
                bits = np.zeros((high - low, 64), dtype=np.uint8)
                same = np.zeros((2, high - low), dtype=np.uint64)
                if full.any():
                    for j in range(N_HASHES):
                        least = np.minimum.reduceat((sets ^ _XOR[j]) * _MUL[j], starts)
                        sig[full, j] = least >> np.uint64(32)
                        bits[full, j] = (tb.mix(least) & np.uint64(1)).astype(np.uint8)
                        if j < 8:
                            bits[full, N_HASHES + j] = (tb.mix(least) >> np.uint64(1) & np.uint64(1)).astype(np.uint8)
                    for k, salt in enumerate((1, 2)):
                        same[k, full] = np.add.reduceat(tb.mix(sets + np.uint64(salt)), starts)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, high - low), pa.array(n.astype(np.int64)), pa.array(same[0].view(np.int64)), pa.array(same[1].view(np.int64)), pa.array(np.packbits(bits, axis=1).view(np.int64).ravel()), tb.binary_rows(sig)],
                    ["id", "n", "h1", "h2", "bits", "sig"],
                )

    return run


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key) for every table."""
    for batch in batches:
        for low in range(0, batch.num_rows, 1000):
            part = batch.slice(low, 1000)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint32).reshape(-1, N_HASHES).astype(np.uint64)
            cut = LEFT[0] * LEFT[1]
            sides = []
            for (count, width), cols in ((LEFT, sig[:, :cut]), (RIGHT, sig[:, cut:])):
                groups = cols.reshape(-1, count, width)
                total = np.full(groups.shape[:2], 7, dtype=np.uint64)
                for k in range(width):
                    total = tb.mix(total * np.uint64(31) + groups[:, :, k])
                sides.append(total)
            which = np.arange(LEFT[0] * RIGHT[0], dtype=np.uint64).reshape(1, LEFT[0], RIGHT[0])
            keys = tb.mix(sides[0][:, :, None] + tb.mix(sides[1][:, None, :] + which * np.uint64(0x9E3779B97F4A7C15)))
            ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), LEFT[0] * RIGHT[0])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.reshape(-1).view(np.int64))], ["id", "key"])


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, at in tb.slices(batch.column(1)):
                sets, ends = shingle_sets(data, at, size)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), lists], ["id", "shingles"])

    return run


def _sets_of(ids: DataFrame, docs: DataFrame, size: int, work: Workspace, name: str) -> DataFrame:
    """(id, shingles) of the documents with these ids."""
    ids = work.table(ids.distinct(), f"{name}-ids")
    small = ids.count() <= BROADCAST_IDS
    chosen = docs.join(F.broadcast(ids) if small else ids, "id", "left_semi")
    return work.table(chosen.mapInArrow(_sets(size), "id long, shingles array<long>"), f"{name}-sets")


def _checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(left, "a").join(right, "b").withColumn("both", both)
    return met.where(F.col("both") * 100 >= F.lit(percent) * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


def _cross_links(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """A spanning star of every group of linked sets of a block pair; intersections are products of membership matrices."""
        sides = [pdf[pdf["side"] == k] for k in (0, 1)]
        if not all(map(len, sides)):
            return pd.DataFrame({"a": [], "b": []})
        sizes = [side["shingles"].map(len).to_numpy() for side in sides]
        flat = [np.concatenate(side["shingles"].to_numpy()) for side in sides]
        shared = np.intersect1d(*flat)
        both = np.zeros((len(sides[0]), len(sides[1])), dtype=np.float32)
        places = []
        for f, n in zip(flat, sizes, strict=True):
            at = np.minimum(np.searchsorted(shared, f), max(len(shared) - 1, 0))
            ok = shared[at] == f if len(shared) else np.zeros(len(f), bool)
            places.append((np.repeat(np.arange(len(n)), n)[ok], at[ok]))
        for low in range(0, len(shared), 4096):
            m = []
            for (row, at), n in zip(places, sizes, strict=True):
                here = (at >= low) & (at < low + 4096)
                block = np.zeros((len(n), 4096), dtype=np.float32)
                block[row[here], at[here] - low] = 1
                m.append(block)
            both += m[0] @ m[1].T
        both = both.astype(np.int64)
        link = both * (100 + percent) >= percent * (sizes[0][:, None] + sizes[1][None, :])
        rows, cols = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
        link, top = link[np.ix_(rows, cols)], np.iinfo(np.int64).max
        ids = sides[0]["id"].to_numpy()[rows], sides[1]["id"].to_numpy()[cols]
        low = ids[0].copy(), ids[1].copy()
        while len(rows):
            a = np.minimum(low[0], np.where(link, low[1][None, :], top).min(axis=1))
            b = np.minimum(low[1], np.where(link, a[:, None], top).min(axis=0))
            if (a == low[0]).all() and (b == low[1]).all():
                break
            low = a, b
        return pd.DataFrame({"a": np.concatenate(ids), "b": np.concatenate(low)})

    return run


def minhash_groups(spark: SparkSession, documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row with an id.

    Words lie between ASCII white space, A-Z lower-cased; a set holds the
    distinct runs of `shingle` words, or the whole sequence if it is shorter.
    Documents link if 100 * |both| >= percent * |either|. Null, empty or blank
    texts have an empty set and link with nothing: each is its own component
    and kept. Repeated rows of an id stay, with the same component. Rows
    without an id are left out. Other columns are ignored.
    """
    work = Workspace(spark, "minhash")
    docs = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    signed = work.table(docs.mapInArrow(_sign(shingle), "id long, n long, h1 long, h2 long, bits long, sig binary"), "signed")
    same = signed.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.min_by(F.struct("bits", "sig"), "id").alias("s"))
    reps = work.table(same.select("rep", "h1", "h2", "n", "s.bits", "s.sig"), "reps")

    rows = reps.select(F.col("rep").alias("id"), "sig").mapInArrow(_tables, "id long, key long")
    shared = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    keyed = work.table(rows.join(shared, "key"), "keyed")

    popular = keyed.groupBy("id").agg(F.sum(F.col("m") - 1).alias("met"))
    ranked = keyed.join(popular, "id")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("less"))).alias("top")).select("key", (-F.col("top.less")).alias("b"))
    sigs = reps.select(F.col("rep").alias("id"), "n", "bits")
    led = keyed.join(leaders, "key").where("id <> b").groupBy("id", "b").agg(F.count("*").alias("tables"))
    led = _alike(led.withColumnRenamed("id", "a"), sigs, percent)
    led = work.table(led.select("a", "b"), "led")
    sets = _sets_of(led.select(F.col("a").alias("id")).union(led.select("b")), docs, shingle, work, "first")
    links = work.table(_checked(led, sets, percent), "first-links")
    work.drop("first-sets", "led")
    labels = connected_components(links, "a", "b", work, "cc1")

    # What is left: pairs that share a key and lie in different components.
    full = keyed.join(labels.withColumnRenamed("node", "id"), "id", "left").join(sigs, "id").select("key", "id", "n", "bits", F.coalesce("component", "id").alias("c"))
    full = work.table(full, "labelled")
    open_keys = full.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("sharers")).where("c0 <> c1").select("key", "sharers")
    sizes = labels.groupBy("component").agg(F.count("*").alias("members")).where(F.col("members") >= BIG)
    marked = work.table(full.join(open_keys, "key").join(sizes.withColumnRenamed("component", "c"), "c", "left"), "marked")
    work.drop("labelled")
    # Outsiders that share a key with a large component meet it, and one another, in blocks, which return links only.
    inside = marked.where("members is not null").groupBy("key", "c").agg(F.max("members").alias("m")).withColumnRenamed("c", "group")
    met = marked.join(inside, "key").where((F.col("c") != F.col("group")) & (F.col("members").isNull() | (F.col("c") < F.col("group"))))
    guests = work.table(met.groupBy("group", "id").agg(F.max("m").alias("m")), "guests")
    small = marked.join(inside.select("key").distinct(), "key", "left_anti")
    # A key that many sets share is dealt to block pairs, so that no task holds it whole.
    n_blocks = F.ceil(F.col("sharers") / KEY_BLOCK).cast("int")
    small = small.select("key", "id", "n", "bits", "c", F.pmod(F.xxhash64("id"), n_blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("other"))
    x = small.select("key", F.col("own").alias("i"), F.col("other").alias("j"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"), F.col("c").alias("ca"))
    y = small.select("key", F.col("other").alias("i"), F.col("own").alias("j"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"), F.col("c").alias("cb"))
    may = (F.col("ca") < F.col("cb")) & _near("na", "nb", "ba", "bb", percent)
    met = x.join(y, [x["key"] == y["key"], x["i"] == y["i"], x["j"] == y["j"], may])
    rest = work.table(met.groupBy("a", "b").agg(F.count("*").alias("tables")).select("a", "b"), "rest")
    invited = guests.groupBy("group").agg(F.count("*").alias("q"), (F.max("m") + F.count("*")).alias("m"))
    hosts = labels.join(invited, F.col("component") == F.col("group")).select("group", F.col("node").alias("id"), "m", "q")
    hosts = work.table(hosts.union(guests.select("group", "id").join(invited, "group").select("group", "id", "m", "q")), "hosts")
    wanted = rest.select(F.col("a").alias("id")).union(rest.select("b")).union(guests.select("id")).union(hosts.select("id"))
    sets = _sets_of(wanted, docs, shingle, work, "second")
    guests = guests.drop("m").join(invited, "group").join(sets, "id").withColumn("side", F.lit(1))
    dealt = hosts.join(sets, "id").withColumn("side", F.lit(0)).unionByName(guests.select("group", "id", "m", "q", "shingles", "side"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, blocks("m")).otherwise(blocks("q"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, blocks("q")).otherwise(blocks("m")) - 1))
    dealt = dealt.withColumn("mine", mine).withColumn("other", others)
    host = F.col("side") == 0
    dealt = dealt.select("group", F.when(host, F.col("mine")).otherwise(F.col("other")).alias("i"), F.when(host, F.col("other")).otherwise(F.col("mine")).alias("j"), "side", "id", "shingles")
    crossed = dealt.groupBy("group", "i", "j").applyInPandas(_cross_links(percent), "a long, b long")
    more = work.table(_checked(rest, sets, percent).union(crossed), "second-links")
    # New links join whole components, so only their labels need joining.
    joined = more.join(labels.select(F.col("node").alias("a"), F.col("component").alias("la")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("component").alias("lb")), "b", "left")
    bridges = joined.select(F.coalesce("la", "a").alias("x"), F.coalesce("lb", "b").alias("y")).distinct()
    merged = connected_components(bridges, "x", "y", work, "cc2")
    every = labels.join(merged.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    fresh = merged.join(labels, "node", "left_anti")
    final = work.table(every.union(fresh.select("node", "component")), "components")
    work.drop("keyed", "marked", "rest", "hosts", "guests", "second-sets")

    found = signed.select("id", "n", "h1", "h2").join(reps.select("h1", "h2", "n", "rep"), ["h1", "h2", "n"], "left")
    found = found.join(final.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _near(na: str, nb: str, ba: str, bb: str, percent: int):
    """Sizes and sketches allow the similarity.

    A bit of each of 64 minhash bits agrees with probability (1 + J) / 2; at
    J = 0.8 more than 20 of 64 differ with a probability below 1e-6.
    """
    sizes = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    return sizes & (F.bit_count(F.col(ba).bitwiseXOR(F.col(bb))) <= _most_bits(percent))


def _most_bits(percent: int) -> int:
    mean = 64 * (1 - percent / 100) / 2
    return int(mean + 6 * (mean * (1 - mean / 64)) ** 0.5)


def _alike(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow a link, with the number of differing bits."""
    left = sigs.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = sigs.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    met = pairs.join(left, "a").join(right, "b").where(_near("na", "nb", "ba", "bb", percent))
    return met.withColumn("far", F.bit_count(F.col("ba").bitwiseXOR(F.col("bb"))))
