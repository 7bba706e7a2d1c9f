"""Joins of large rows on keys that may be hot: bounded broadcasts beside sort-merge joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspan.plans.workspace import Workspace

#: Bits of the map of hashed keys: 8 MB, however many keys there are.
KEY_BITS = 1 << 26
#: A key is hot if it holds at least one in so many of the counted rows; so there are never more hot keys than this.
HOT_SHARE = 1000


def fresh(columns: list[str], name: str) -> str:
    """A column name that is not among columns, compared as Spark compares names."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def key_marks(keys: DataFrame, key: str, work: Workspace, name: str) -> DataFrame:
    """A written map of the hashes of a column of keys: at most 2048 rows of 4 KB. Null keys mark nothing."""
    at = keys.where(F.col(key).isNotNull()).select((F.pmod(F.xxhash64(key), F.lit(KEY_BITS)) + 1).alias("at"))
    return work.table(at.groupBy(F.bitmap_bucket_number("at").alias("map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")), name)


def by_marks(rows: DataFrame, key: Column, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose hashed key is marked, all others), without a shuffle of the rows.

    Rows of other keys with an equal hash are among the marked, so an exact join
    has to follow there; none of the others holds a marked key. Null keys are
    among the others. The map is broadcast, which its fixed size allows. At more
    keys than bits all rows are marked, which costs the shuffle but no row.
    """
    names = rows.columns
    at, where, bits = (fresh(names, x) for x in ("at", "map", "bits"))
    maps = marks.select(F.col("map").alias(where), F.col("bits").alias(bits))
    placed = rows.withColumn(at, F.when(key.isNotNull(), F.pmod(F.xxhash64(key), F.lit(KEY_BITS)) + 1))
    placed = placed.withColumn(where, F.bitmap_bucket_number(F.col(at))).join(F.broadcast(maps), where, "left")
    place = F.bitmap_bit_position(F.col(at))
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    return placed.where(marked).select(*names), placed.where(~marked).select(*names)


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str]) -> DataFrame:
    """rows joined with counted, a written table of one row a key with n, the number of rows of the key.

    Hot keys, of which there are at most HOT_SHARE, are broadcast; the others
    meet in a sort-merge join at every size. rows is read twice: it should be
    a written table.
    """
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE >= total
    often, seldom = counted.where(hot), counted.where(~hot)
    few = rows.join(F.broadcast(often), on)
    rest = rows.join(F.broadcast(often.select(*on)), on, "left_anti").join(seldom.hint("merge"), on)
    return few.unionByName(rest)
