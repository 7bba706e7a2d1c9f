"""Colour lattices: read from the lines of cube files, met by pixels cell by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keywords of the format and the sizes it allows.
SIZE, LOW, HIGH, TITLE = "LUT_3D_SIZE", "DOMAIN_MIN", "DOMAIN_MAX", "TITLE"
LEAST, MOST = 2, 128


def _triple(words: Column, first: int) -> Column:
    """Three numbers from a place in the words on, or null."""
    values = [F.try_element_at(words, F.lit(first + i)).try_cast("double") for i in range(3)]
    return F.when(values[0].isNotNull() & values[1].isNotNull() & values[2].isNotNull(), F.array(*values))


def lattices(texts: DataFrame) -> DataFrame:
    """(lut, title, size, at, r, g, b) of cube files (lut, text): the points in order, red fastest, each channel from 0 to 1.

    Values are measured by the domain that stands before them; points before
    the size by that before the size. A later size starts anew. Files with a
    size out of 2 to 128 or too few points have no rows; points beyond the
    last are left out. Blank lines, comments and what is no number are skipped.
    """
    lines = texts.select("lut", F.posexplode(F.split("text", "\r?\n")).alias("line", "raw")).withColumn("raw", F.trim(F.regexp_replace("raw", r"\s+", " ")))
    told = lines.where("raw <> '' and not startswith(raw, '#')").withColumn("words", F.split("raw", " "))
    is_title, is_size = F.col("raw").startswith(TITLE), F.col("raw").startswith(SIZE)
    is_low, is_high = F.col("raw").startswith(LOW), F.col("raw").startswith(HIGH)
    size = F.when(is_size, F.coalesce(F.try_element_at("words", F.lit(2)).try_cast("int"), F.lit(0)))
    name = F.when(is_title, F.coalesce(F.nullif(F.regexp_extract("raw", '"(.*)"', 1), F.lit("")), F.trim(F.substring("raw", len(TITLE) + 1, 1000))))
    point = F.when(~(is_title | is_size | is_low | is_high), _triple(F.col("words"), 1))
    marked = told.select("lut", "line", name.alias("title"), size.alias("size"), F.when(is_low, _triple(F.col("words"), 2)).alias("low"), F.when(is_high, _triple(F.col("words"), 2)).alias("high"), point.alias("point"))
    upto, whole = Window.partitionBy("lut").orderBy("line"), Window.partitionBy("lut")
    seen = marked.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.array(*[F.lit(v)] * 3)) for c, v in (("low", 0.0), ("high", 1.0))})
    sized = seen.withColumns({
        "last_size": F.max(F.when(F.col("size") > 0, F.struct("line", "size", "low", "high"))).over(whole),
        "sizes": F.count(F.when(F.col("size") > 0, 1)).over(whole),
        "title": F.max_by("title", F.when(F.col("title").isNotNull(), F.col("line"))).over(whole),
    })
    before = F.col("line") < F.col("last_size.line")
    points = sized.where("point is not null").where(~before | (F.col("sizes") == 1))
    low, high = (F.when(before, F.col(f"last_size.{c}")).otherwise(F.col(c)) for c in ("low", "high"))

    def channel(i: int) -> Column:
        v, a, b = F.col("point")[i], low[i], high[i]
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.abs(b - a) < 1e-8, v).otherwise(F.try_divide(v - a, b - a))))

    n = F.col("last_size.size")
    placed = points.select("lut", "title", n.alias("size"), (F.row_number().over(upto) - 1).alias("at"), F.count("*").over(whole).alias("n"), *[channel(i).alias(c) for i, c in enumerate("rgb")])
    need = F.col("size") * F.col("size") * F.col("size")
    return placed.where(F.col("size").between(LEAST, MOST)).where((F.col("n") >= need) & (F.col("at") < need)).drop("n")


def cells(points: DataFrame) -> DataFrame:
    """(lut, size, cell, corners): every cell between eight points; corners[4 * b + 2 * g + r] is a struct of r, g and b."""
    n = F.col("size")
    x, y, z = F.col("at") % n, F.floor(F.col("at") / n) % n, F.floor(F.col("at") / (n * n))
    shift = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("corner")
    near = points.select("lut", "size", x.alias("x"), y.alias("y"), z.alias("z"), F.struct("r", "g", "b").alias("v"), shift)
    base = [F.col(c) - F.floor(F.col("corner") / step) % 2 for c, step in (("x", 1), ("y", 2), ("z", 4))]
    inside = [(c >= 0) & (c < n - 1) for c in base]
    cell = ((base[2] * n + base[1]) * n + base[0]).cast("long").alias("cell")
    kept = near.where(inside[0] & inside[1] & inside[2]).select("lut", "size", cell, "corner", "v")
    return kept.groupBy("lut", "size", "cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("corner", "v"))), lambda c: c["v"]).alias("corners"))


def sampled(pixels: DataFrame, points: DataFrame) -> DataFrame:
    """pixels (lut, r, g, b from 0 to 1, and more) with new r, g and b between the eight points around each.

    Pixels and cells meet in one equi-join, so a lattice is never copied to
    every task. Pixels of a file without a lattice are left out.
    """
    sizes = points.select("lut", "size").distinct()
    n = F.col("size") - 1
    at = {c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) * n for c in "rgb"}
    sized = pixels.join(sizes, "lut")
    floors = {f"{c}0": F.least(F.floor(at[c]), n - 1) for c in "rgb"}
    shares = {f"{c}d": at[c] - F.least(F.floor(at[c]), n - 1) for c in "rgb"}
    cell = ((F.col("b0") * F.col("size") + F.col("g0")) * F.col("size") + F.col("r0")).cast("long")
    placed = sized.withColumns(floors | shares).withColumn("cell", cell).drop("size")
    met = placed.join(cells(points).drop("size"), ["lut", "cell"])
    between = lambda a, b, d: a * (1.0 - F.col(d)) + b * F.col(d)

    def channel(c: str) -> Column:
        v = [F.col("corners")[i][c] for i in range(8)]
        along = [between(v[2 * i], v[2 * i + 1], "rd") for i in range(4)]
        flat = [between(along[2 * i], along[2 * i + 1], "gd") for i in range(2)]
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), between(flat[0], flat[1], "bd")))

    return met.select(*[c for c in pixels.columns if c not in "rgb"], *[channel(c).alias(c) for c in "rgb"])
