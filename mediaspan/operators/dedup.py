"""Exact and perceptual duplicates."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from mediaspan.plans.catalog import Library
from mediaspan.plans.components import connected_components
from mediaspan.plans.numbering import numbered
from mediaspan.plans.registry import query, register
from mediaspan.plans.workspace import Workspace

register("A17_duplicate_sizes", lambda lib: lib.hashes.groupBy("file_size").agg(F.count("*").alias("n")).where("n > 1 and file_size > 0"), "select file_size, count(*) n from v_hashes where file_size > 0 group by 1 having count(*) > 1")


def exact_groups(lib: Library) -> DataFrame:
    g = lib.hashes.groupBy("hash", "file_size").agg(F.count("*").alias("n")).where("n > 1")
    return g.withColumn("total_size", F.col("n") * F.col("file_size"))


_GROUPS = "select hash, file_size, count(*) n, count(*) * file_size total_size from v_hashes group by 1, 2 having count(*) > 1"
register("A18_D2_exact_groups", exact_groups, _GROUPS)
register("A19_overview", lambda lib: exact_groups(lib).agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"), F.coalesce(F.sum((F.col("n") - 1) * F.col("file_size")), F.lit(0)).alias("extra_size")), f"select count(*) groups, cast(coalesce(sum(n - 1), 0) as bigint) extra, cast(coalesce(sum((n - 1) * file_size), 0) as bigint) extra_size from ({_GROUPS})")
register("O6_D7_group_page", lambda lib: exact_groups(lib).orderBy(F.desc("total_size"), "hash").limit(20).select("hash", "total_size"), f"select hash, total_size from ({_GROUPS}) order by total_size desc, hash limit 20")


@query(
    "W3_O8_D8_keep",
    f""", g as ({_GROUPS}), m as (select h.hash, h.file_id, a.taken_date, a.created_at from v_hashes h join g using (hash, file_size) left join v_files a on a.id = h.file_id)
    select hash, file_id, count(*) over (partition by hash) - row_number() over w + 1 score, row_number() over w = 1 is_keep from m window w as (partition by hash order by coalesce(taken_date, 0) > 0 desc, created_at nulls first, file_id)""",
)
def keepers(lib: Library) -> DataFrame:
    """Members of exact groups ranked: with a taken date first, then oldest, then lowest id; the first is kept.

    Members are numbered in one order over all groups, so a group of any size is spread over tasks.
    """
    m = lib.hashes.join(exact_groups(lib).select("hash", "file_size"), ["hash", "file_size"]).join(lib.files.select(F.col("id").alias("file_id"), "taken_date", "created_at"), "file_id", "left")
    order = ["hash", "undated", "age", "file_id"]
    members = m.select("hash", (F.coalesce("taken_date", F.lit(0)) <= 0).alias("undated"), F.coalesce("created_at", F.lit(-(2**63))).alias("age"), "file_id")
    placed = numbered(members, order, 0, "place", Workspace(lib.spark, "keep"))
    groups = placed.groupBy("hash").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    return placed.join(groups, "hash").select("hash", "file_id", (F.col("n") - F.col("place") + F.col("first")).cast("long").alias("score"), (F.col("place") == F.col("first")).alias("is_keep"))


def delete_candidates(lib: Library) -> DataFrame:
    """Members of exact groups but for each one's first. Firsts combine before the shuffle, so a large group is no burden."""
    m = lib.hashes.join(exact_groups(lib).select("hash", "file_size"), ["hash", "file_size"]).join(lib.files.select(F.col("id").alias("file_id"), "taken_date", "created_at"), "file_id", "left")
    undated, age = (F.coalesce("taken_date", F.lit(0)) <= 0).alias("undated"), F.coalesce("created_at", F.lit(-(2**63))).alias("age")
    first = m.groupBy("hash").agg(F.min(F.struct(undated, age, "file_id"))["file_id"].alias("first"))
    return m.join(first, "hash").where("file_id <> first").select("file_id").distinct()


register("D9_delete_candidates", delete_candidates, f", g as ({_GROUPS}), m as (select h.hash, h.file_id, row_number() over (partition by h.hash order by coalesce(taken_date, 0) > 0 desc, created_at nulls first, h.file_id) r from v_hashes h join g using (hash, file_size) left join v_files a on a.id = h.file_id) select file_id from m where r > 1")


@query("O7_group_items", f", g as ({_GROUPS}), m as (select h.hash, h.file_id, row_number() over (partition by h.hash order by coalesce(taken_date, 0) > 0 desc, created_at nulls first, h.file_id) r, count(*) over (partition by h.hash) n from v_hashes h join g using (hash, file_size) left join v_files a on a.id = h.file_id) select hash, file_id, n - r + 1 score, r = 1 is_keep from m order by hash, is_keep desc, score desc")
def group_items(lib: Library) -> DataFrame:
    """The members of every group: the kept one first, then by falling score."""
    return keepers(lib).orderBy("hash", F.desc("is_keep"), F.desc("score"))


@query("U5_group_ids", f", g as ({_GROUPS}) select distinct hash from v_hashes join g using (hash, file_size) where file_id in (select id from v_visible)")
def touched_groups(lib: Library) -> DataFrame:
    """The groups with a member in scope, each once: a scoped rebuild replaces these."""
    scope = lib.visible(lib.base).select(F.col("id").alias("file_id"))
    return lib.hashes.join(exact_groups(lib).select("hash", "file_size"), ["hash", "file_size"]).join(scope, "file_id", "left_semi").select("hash").distinct()


CELLS = 72
#: Bits that perceptual hashes may differ in, by strictness.
STRICTNESS = (6, 8, 12)
#: Hashes of a group's side at most; rows and columns that are compared at a time.
GROUP, STRIP, PIECE = 16_384, 16, 8192


@F.pandas_udf(LongType())
def dhash(texts: pd.Series) -> pd.Series:
    """The difference hash of texts in UTF-8; null is empty. Code points of a cell are added up by one call."""

    def one(text: bytes | None) -> int:
        codes = np.frombuffer((text or b"").decode("utf-8", "replace").ljust(CELLS).encode("utf-32-le"), "<u4")
        edges = np.arange(CELLS + 1) * len(codes) // CELLS
        grid = (np.add.reduceat(codes, edges[:-1], dtype=np.int64) // np.diff(edges)).reshape(8, 9)
        return int(np.packbits(grid[:, :-1] > grid[:, 1:], bitorder="little").view("<i8")[0])

    return pd.Series([one(t) for t in texts], dtype="int64")


def phashes(lib: Library) -> DataFrame:
    """A 64-bit difference hash of the whole text, resized to 9 by 8: bit (y*8+x) is left > right.

    A cell is the mean code point of one of 72 equal stretches, rounded down; shorter texts are padded with blanks.
    """
    return lib.table("documents").select((F.col("doc_id") + 1).alias("file_id"), dhash(F.col("text").cast("binary")).alias("phash"), F.col("n_chars").alias("size"))


_PHASH = """, t as (select doc_id + 1 file_id, list_transform(string_split(rpad(coalesce(text, ''), cast(greatest(72, length(coalesce(text, ''))) as int), ' '), ''), lambda c: unicode(c)) codes, n_chars size from documents),
c as (select file_id, size, list_transform(range(72), lambda c: list_sum(codes[c * len(codes) // 72 + 1 : (c + 1) * len(codes) // 72]) // ((c + 1) * len(codes) // 72 - c * len(codes) // 72)) cells from t),
p as (select file_id, size, list_transform(range(64), lambda i: case when cells[i // 8 * 9 + i % 8 + 1] > cells[i // 8 * 9 + i % 8 + 2] then 1 else 0 end) bits from c) """


def masks(width: int, turned: int) -> list[int]:
    """Every way to turn at most so many of the bits of a band."""
    found = [0]
    for n in range(1, turned + 1):
        found += [sum(1 << b for b in bits) for bits in combinations(range(width), n)]
    return found


def band_limits(n: int, distance: int) -> list[tuple[int, int, int]]:
    """(shift, width, limit) of the bands that cut a hash, for so many hashes.

    With m bands whose limits come to distance - m + 1, hashes within the
    distance differ in some band by no more than its limit, else they would
    differ by at least one bit more. Bands are as wide as to leave about GROUP
    hashes a value; below GROUP hashes all are one group.
    """
    bands = 1 if n <= GROUP else next((m for m in range(8, 4, -1) if n >> 64 // m <= GROUP), 4)
    bands = min(bands, distance + 1)
    spare, cuts = distance - bands + 1, [64 * k // bands for k in range(bands + 1)]
    if bands == 1:
        return [(0, 0, 0)]
    return [(low, high - low, spare // bands + (k < spare % bands)) for k, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False))]


def meetings(distinct: DataFrame, limits: list[tuple[int, int, int]], work: Workspace) -> DataFrame:
    """distinct (file_id, phash) in every group where it is compared: by two values of a band that are within its limit, and a block of each.

    Values of more than GROUP hashes are dealt to blocks, so a group is never
    larger than about two of these. left says on which side of it a hash is;
    null is both.
    """
    pieces = [F.struct(F.lit(k).cast("long").alias("band"), F.call_function("shiftrightunsigned", F.col("phash"), F.lit(low)).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for k, (low, width, _) in enumerate(limits)]
    rows = distinct.select("file_id", "phash", F.explode(F.array(*pieces)).alias("p")).select("file_id", "phash", "p.*")
    sizes = work.table(rows.groupBy("band", "value").agg(F.ceil(F.count("*") / GROUP).alias("blocks")), "sizes")
    own = rows.join(F.broadcast(sizes), ["band", "value"]).withColumn("block", F.pmod(F.xxhash64("file_id"), F.col("blocks"))).drop("blocks")
    turns = F.element_at(F.array(*[F.array(*[F.lit(m).cast("long") for m in masks(width, limit)]) for _, width, limit in limits]), (F.col("band") + 1).cast("int"))
    near = own.withColumn("other", F.explode(F.transform(turns, lambda m: F.col("value").bitwiseXOR(m))))
    near = near.join(F.broadcast(sizes.withColumnRenamed("value", "other")), ["band", "other"])
    near = near.withColumn("there", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    here, there = F.struct("value", "block"), F.struct(F.col("other").alias("value"), F.col("there").alias("block"))
    near = near.withColumn("left", F.when(here != there, here < there)).withColumns({"x": F.least(here, there), "y": F.greatest(here, there)})
    return near.select("band", F.col("x.value").alias("u"), F.col("x.block").alias("i"), F.col("y.value").alias("v"), F.col("y.block").alias("j"), "left", "file_id", "phash")


def _forest(distance: int):
    def join(met: pd.DataFrame) -> pd.DataFrame:
        """Pairs within the distance that join what earlier pairs of the group have not, a strip of rows at a time."""
        one = met.left.isna().all()
        left, right = (met, met) if one else (met[met.left == True], met[met.left == False])  # noqa: E712
        a, b = (side.file_id.to_numpy() for side in (left, right))
        x, y = (side.phash.to_numpy(dtype=np.int64).view(np.uint64) for side in (left, right))
        nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        at, to = places[: len(a)], places[len(a) :]
        label, found = np.arange(len(nodes)), []

        def link(i: np.ndarray, j: np.ndarray) -> None:
            for p, q in zip(at[i], to[j], strict=True):
                low, high = sorted((label[p], label[q]))
                if low != high:
                    label[label == high] = low
                    found.append((nodes[p], nodes[q]))

        bits, counts = np.empty((STRIP, PIECE), np.uint64), np.empty((STRIP, PIECE), np.uint8)
        for s in range(0, len(x), STRIP):
            for t in range(0, len(y), PIECE):
                p, q = x[s : s + STRIP], y[t : t + PIECE]
                here = counts[: len(p), : len(q)]
                np.bitwise_count(np.bitwise_xor(p[:, None], q[None, :], out=bits[: len(p), : len(q)]), out=here)
                if here.min() > distance:
                    continue
                hits = here <= distance
                # Of each row its first partner, then of each column, until all that meet are joined.
                apart = lambda s=s, t=t, h=hits: h & (label[at[s : s + STRIP]][:, None] != label[to[t : t + PIECE]][None, :])
                while (todo := apart()).any():
                    i = np.flatnonzero(todo.any(axis=1))
                    link(s + i, t + todo[i].argmax(axis=1))
                    todo = apart()
                    j = np.flatnonzero(todo.any(axis=0))
                    link(s + todo[:, j].argmax(axis=0), t + j)
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])

    return join


def near_components(hashes: DataFrame, distance: int, work: Workspace) -> DataFrame:
    """(node, component) of the files whose hashes lie within a Hamming distance of another's, transitively.

    Equal hashes collapse first, so a hash that many files share is compared
    once. Hashes that are alike in a band meet in groups of bounded size, which
    compare all their pairs and put out those that join two components of the
    group: no link is left out, and a dense group gives no more rows than it has
    hashes.
    """
    distinct = work.table(hashes.groupBy("phash").agg(F.min("file_id").alias("file_id")), "distinct-hashes")
    met = meetings(distinct, band_limits(distinct.count(), distance), work)
    star = work.table(met.groupBy("band", "u", "i", "v", "j").applyInPandas(_forest(distance), "a long, b long").distinct(), "star")
    twins = hashes.join(distinct.withColumnRenamed("file_id", "a"), "phash").where("file_id > a").select("a", F.col("file_id").alias("b"))
    return connected_components(star.unionByName(twins), "a", "b", work, "near")


def similar_groups(lib: Library, distance: int = 8) -> DataFrame:
    """(group_id, file_id): files that differ by few bits, transitively; those of exact groups are left out."""
    exact = lib.hashes.join(exact_groups(lib).select("hash", "file_size"), ["hash", "file_size"]).select("file_id")
    work = Workspace(lib.spark, "similar")
    # Hashes are written before they meet others, so that texts are not shuffled.
    rest = work.table(work.table(phashes(lib), "hashed").join(exact, "file_id", "left_anti"), "phashes")
    labels = near_components(rest.select("file_id", "phash"), distance, work)
    return labels.select(F.col("component").alias("group_id"), F.col("node").alias("file_id"))


_NEAR = "(select a.file_id a, b.file_id b from r a join r b on a.file_id < b.file_id and list_sum(list_transform(range(64), lambda i: case when a.bits[i + 1] <> b.bits[i + 1] then 1 else 0 end)) <= 8)"
_REST = _PHASH + f", g as ({_GROUPS}), r as (select * from p where file_id not in (select file_id from v_hashes join g using (hash, file_size)))"
_LINKS = _REST + f", e as materialized {_NEAR}"
register("X13_dhash", lambda lib: phashes(lib).select("file_id", F.bit_count("phash").cast("long").alias("ones")), _PHASH + "select file_id, cast(list_sum(bits) as bigint) ones from p")
register("J12_near_hash_links", lambda lib: _reached(lib), _LINKS + " select distinct x file_id from (select a x from e union all select b from e)")


def _reached(lib: Library) -> DataFrame:
    """Files with a near hash other than their own."""
    return similar_groups(lib).select("file_id")


_NEAR_AT = _NEAR.replace("<= 8", "<= {0}")
_STATS = _REST + f""", e as materialized (select a, b from {_NEAR_AT} union all select b, a from {_NEAR_AT}),
w as (with recursive reach(x, y) as (select a, a from e union select r.x, e.b from reach r join e on r.y = e.a) select x, min(y) g from reach group by x)
select g group_id, count(*) n, max(size) largest, cast(sum(size) as bigint) total_size from w join p on p.file_id = w.x group by g"""


def similar_stats(lib: Library, distance: int) -> DataFrame:
    members = similar_groups(lib, distance).join(lib.table("documents").select((F.col("doc_id") + 1).alias("file_id"), F.col("n_chars").alias("size")), "file_id")
    return members.groupBy("group_id").agg(F.count("*").alias("n"), F.max("size").alias("largest"), F.sum("size").alias("total_size"))


for _level, _bits in enumerate(STRICTNESS):
    register("D4_D5_A20_similar_groups" if _level == 1 else f"D6_similar_groups_strictness{_level}", lambda lib, d=_bits: similar_stats(lib, d), _STATS.format(_bits))


@query("D1_hash_refresh", "select doc_id + 1 file_id, case when doc_id % 5 = 0 then 'new' when doc_id % 3 = 0 then 'changed' end state, sha256(coalesce(text, '')) hash from documents where doc_id % 5 = 0 or doc_id % 3 = 0")
def hash_refresh(lib: Library) -> DataFrame:
    """Files to hash anew: those without a stored hash, or whose stored time of change is another."""
    docs = lib.table("documents")
    stored = docs.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("stored_mtime"))
    return changed_rows(docs.withColumn("mtime", F.lit(0)), stored, "doc_id").select((F.col("doc_id") + 1).alias("file_id"), "state", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


def changed_rows(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """rows (key, mtime, ...) that are not in stored (key, stored_mtime), or there with another time, with their state."""
    joined = rows.join(stored, key, "left")
    state = F.when(F.col("stored_mtime").isNull(), "new").when(F.col("stored_mtime") != F.col("mtime"), "changed")
    return joined.withColumn("state", state).where("state is not null").drop("stored_mtime")


@query("D3_phash_refresh", _PHASH + "select file_id, cast(list_sum(bits) as bigint) ones from p where (file_id - 1) % 4 = 0 and file_id in (select id from v_files where file_type in (1, 3))")
def phash_refresh(lib: Library) -> DataFrame:
    """Perceptual hashes of images and raw files whose stored hash is missing."""
    pictures = lib.files.where("file_type in (1, 3)").select(F.col("id").alias("file_id"))
    stored = lib.table("documents").where("doc_id % 4 <> 0").select((F.col("doc_id") + 1).alias("file_id"))
    due = phashes(lib).join(pictures, "file_id", "left_semi").join(stored, "file_id", "left_anti")
    return due.select("file_id", F.bit_count("phash").cast("long").alias("ones"))


register("J10_hashes_files", lambda lib: lib.hashes.join(lib.files.select(F.col("id").alias("file_id"), "name"), "file_id").select("file_id", "hash", "name"), "select file_id, hash, name from v_hashes join v_files on id = file_id")
register("J11_U2_not_exact", lambda lib: lib.hashes.join(exact_groups(lib).select("hash", "file_size"), ["hash", "file_size"], "left_anti").select("file_id"), f", g as ({_GROUPS}) select file_id from v_hashes where (hash, file_size) not in (select (hash, file_size) from g)")
register("X14_content_hash", lambda lib: lib.table("documents").select("doc_id", F.sha2("text", 256).alias("hash")), "select doc_id, sha256(text) hash from documents")
