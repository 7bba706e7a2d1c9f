"""Histograms and statistics of pixels.

The registered queries take each vector of `embeddings` as a picture of eight
lines: the channels are the components at three offsets, scaled to 0 to 255.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaspan.functions import colour, lattice
from mediaspan.plans.catalog import Library
from mediaspan.plans.registry import query, register

# Weights of the luma of Rec. 709.
LUMA = (0.2126, 0.7152, 0.0722)
SIDE = 8


def pixels(lib: Library) -> DataFrame:
    """(file_id, at, r, g, b)."""
    e, n = F.col("embedding"), F.size("embedding")
    channel = lambda at, shift: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.element_at(e, ((at + shift) % n + 1).cast("int")).cast("double") + 1) * 127.5))).cast("int")
    spread = lib.embeds.where(n > 0).select("file_id", "embedding", F.explode(F.sequence(F.lit(0), n - 1)).alias("at"))
    return spread.select("file_id", "at", *[channel(F.col("at"), shift).alias(c) for c, shift in (("r", 0), ("g", 7), ("b", 13))])


_PIXELS = """, i as (select file_id, embedding e, unnest(range(len(embedding))) as pos from v_embeds),
px as (select file_id, pos, cast(greatest(0, least(255, floor((cast(e[pos % 64 + 1] as double) + 1) * 127.5))) as int) r, cast(greatest(0, least(255, floor((cast(e[(pos + 7) % 64 + 1] as double) + 1) * 127.5))) as int) g, cast(greatest(0, least(255, floor((cast(e[(pos + 13) % 64 + 1] as double) + 1) * 127.5))) as int) b from i),
h as (select file_id, cast(floor(0.2126::double * r + 0.7152::double * g + 0.0722::double * b + 0.5) as int) bin, count(*) n from px group by 1, 2) """


def luma() -> Column:
    return LUMA[0] * F.col("r") + LUMA[1] * F.col("g") + LUMA[2] * F.col("b")


def histogram(px: DataFrame) -> DataFrame:
    """(file_id, bin, n): pixels by luma rounded to 0 to 255."""
    return px.groupBy("file_id", F.floor(luma() + 0.5).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def percentile_bins(bins: DataFrame, shares: dict[str, float]) -> DataFrame:
    """For each file and share the first bin up to which at least that share of the pixels lies."""
    one = Window.partitionBy("file_id")
    run = bins.withColumn("upto", F.sum("n").over(one.orderBy("bin"))).withColumn("total", F.sum("n").over(one))
    return run.groupBy("file_id").agg(*[F.min(F.when(F.col("upto") >= F.col("total") * s, F.col("bin"))).alias(name) for name, s in shares.items()])


@query("A30_luma_histogram", _PIXELS + "select file_id, bin, n from h")
def luma_histogram(lib: Library) -> DataFrame:
    return histogram(pixels(lib))


_RUN = _PIXELS + ", u as (select *, sum(n) over (partition by file_id order by bin) upto, sum(n) over (partition by file_id) total from h) "


@query("A31_histogram_percentiles", _RUN + "select file_id, min(bin) filter (where upto >= total * 0.01) p1, min(bin) filter (where upto >= total * 0.5) p50, min(bin) filter (where upto >= total * 0.99) p99 from u group by 1")
def percentiles(lib: Library) -> DataFrame:
    return percentile_bins(histogram(pixels(lib)), {"p1": 0.01, "p50": 0.5, "p99": 0.99})


@query("A33_channel_quantiles", _PIXELS + ", l as (select file_id, list_sort(list(r)) v from px group by 1) select file_id, (v[len(v) // 2 + 1] + v[(len(v) + 1) // 2]) / 2.0::double median, v[cast(floor((len(v) - 1) * 0.16::double + 0.5) as int) + 1] p16, v[cast(floor((len(v) - 1) * 0.84::double + 0.5) as int) + 1] p84 from l")
def quantiles(lib: Library) -> DataFrame:
    """Median as the mean of the middle two, and the nearest ranks of 16 and 84 in a hundred; a picture's pixels are one row's."""
    lists = pixels(lib).groupBy("file_id").agg(F.sort_array(F.collect_list("r")).alias("v"))
    n = F.size("v")
    rank = lambda s: F.element_at("v", (F.floor((n - 1) * s + 0.5) + 1).cast("int"))
    middle = (F.element_at("v", (F.floor(n / 2) + 1).cast("int")) + F.element_at("v", (F.floor((n + 1) / 2)).cast("int"))) / 2
    return lists.select("file_id", middle.cast("double").alias("median"), rank(0.16).alias("p16"), rank(0.84).alias("p84"))


@query("A34_laplacian_variance", _PIXELS + f", l as (select file_id, pos // {SIDE} y, pos % {SIDE} x, g v from px) select c.file_id, round(var_pop(n.v + s.v + w.v + e.v - 4 * c.v), 4) sharpness from l c join l n on n.file_id = c.file_id and n.x = c.x and n.y = c.y - 1 join l s on s.file_id = c.file_id and s.x = c.x and s.y = c.y + 1 join l w on w.file_id = c.file_id and w.y = c.y and w.x = c.x - 1 join l e on e.file_id = c.file_id and e.y = c.y and e.x = c.x + 1 group by 1")
def sharpness(lib: Library) -> DataFrame:
    """The variance of the Laplacian of inner pixels. Every pixel sends its value to its neighbours, so one grouping replaces four joins."""
    x, y = F.col("at") % SIDE, F.floor(F.col("at") / SIDE)
    to = lambda dx, dy, k: F.struct((x + dx).cast("int").alias("x"), (y + dy).cast("int").alias("y"), (F.col("g") * k).alias("v"))
    sent = pixels(lib).select("file_id", F.explode(F.array(to(0, 0, -4), to(0, 1, 1), to(0, -1, 1), to(1, 0, 1), to(-1, 0, 1))).alias("p"))
    inner = sent.groupBy("file_id", "p.x", "p.y").agg(F.sum("p.v").alias("v"), F.count("*").alias("n")).where("n = 5")
    return inner.groupBy("file_id").agg(F.round(F.var_pop("v"), 4).alias("sharpness"))


@query("A32_auto_preset_stats", _RUN + f", p as (select file_id, min(bin) filter (where upto >= total * 0.01) p1, min(bin) filter (where upto >= total * 0.99) p99 from u group by 1), m as (select file_id, round(avg({LUMA[0]}::double * r + {LUMA[1]}::double * g + {LUMA[2]}::double * b), 4) mean_luma, round(avg(case when greatest(r, g, b) > 0 then (greatest(r, g, b) - least(r, g, b)) / cast(greatest(r, g, b) as double) else 0 end), 4) saturation from px group by 1) select file_id, p1, p99, mean_luma, saturation from m join p using (file_id)")
def preset_stats(lib: Library) -> DataFrame:
    px = pixels(lib)
    high, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    means = px.groupBy("file_id").agg(F.round(F.avg(luma()), 4).alias("mean_luma"), F.round(F.avg(F.when(high > 0, (high - low) / high).otherwise(0.0)), 4).alias("saturation"))
    return means.join(percentile_bins(histogram(px), {"p1": 0.01, "p99": 0.99}), "file_id")


@query("X22_gray_world", _PIXELS + ", m as (select file_id, avg(r) r, avg(g) g, avg(b) b from px group by 1) select file_id, round((r + g + b) / 3 / greatest(r, 1), 5) scale_r, round((r + g + b) / 3 / greatest(g, 1), 5) scale_g, round((r + g + b) / 3 / greatest(b, 1), 5) scale_b from m")
def gray_world(lib: Library) -> DataFrame:
    """What makes the means of all channels equal; a mean divides as 1 at least."""
    means = pixels(lib).groupBy("file_id").agg(*[F.avg(c).alias(c) for c in "rgb"])
    gray = (F.col("r") + F.col("g") + F.col("b")) / 3
    return means.select("file_id", *[F.round(gray / F.greatest(F.col(c), F.lit(1.0)), 5).alias(f"scale_{c}") for c in "rgb"])


def recoloured(lib: Library, change: Callable[[colour.Channels], colour.Channels]) -> DataFrame:
    """(file_id, pos, r, g, b) after a change of colour."""
    after = change((F.col("r"), F.col("g"), F.col("b")))
    return pixels(lib).select("file_id", F.col("at").alias("pos"), *[x.alias(c) for c, x in zip("rgb", after, strict=True)])


_BYTE = "cast(floor(greatest(0::double, least(255::double, {0})) + 0.5::double) as int)"
_CHANNELS = ", ".join(_BYTE.format("luma + ({0} - luma) * 1.4::double").replace("{0}", c) + f" {c}" for c in "rgb")
_SPREAD = f"{colour.contrast_factor(20.0)!r}::double"
register(
    "X27_adjust",
    lambda lib: recoloured(lib, lambda rgb: colour.adjust(rgb, 12, 20.0, 140.0)),
    _PIXELS + ", c as (select file_id, pos, " + ", ".join(f"{_SPREAD} * ({c} * 1.12::double - 128::double) + 128::double {c}" for c in "rgb") + f" from px), l as (select *, 0.299::double * r + 0.587::double * g + 0.114::double * b luma from c) select file_id, pos, {_CHANNELS} from l",
)
register("X27_grayscale", lambda lib: recoloured(lib, colour.grayscale), _PIXELS + "select file_id, pos, l r, l g, l b from (select file_id, pos, cast((2126 * r + 7152 * g + 722 * b) // 10000 as int) l from px)")
register("X27_invert", lambda lib: recoloured(lib, colour.invert), _PIXELS + "select file_id, pos, 255 - r r, 255 - g g, 255 - b b from px")
register(
    "X27_sepia",
    lambda lib: recoloured(lib, colour.sepia),
    _PIXELS + "select file_id, pos, " + ", ".join(f"cast(floor(least({x}::double * r + {y}::double * g + {z}::double * b, 255::double)) as int) {c}" for c, (x, y, z) in zip("rgb", colour.SEPIA, strict=True)) + " from px",
)
_SHARE = ", ".join(f"cast({c} as double) / 255::double {c}" for c in "rgb")
_MOVED = ", ".join(_BYTE.format(f"greatest(0::double, least(1::double, {c} + move)) * 255::double") + f" {c}" for c in "rgb")
register(
    "X36_highlights_shadows",
    lambda lib: recoloured(lib, lambda rgb: colour.tones(rgb, -40.0, 60.0)),
    _PIXELS + f", s as (select file_id, pos, {_SHARE} from px), l as (select *, greatest(0::double, least(1::double, 0.299::double * r + 0.587::double * g + 0.114::double * b)) y from s), d as (select *, 0.6::double * 0.35::double * ((1 - y) * sqrt(1 - y)) + -0.4::double * 0.35::double * (y * sqrt(y)) move from l) select file_id, pos, {_MOVED} from d",
)
register("X28_fade", lambda lib: recoloured(lib, lambda rgb: colour.fade(rgb, 40.0)), _PIXELS + "select file_id, pos, " + ", ".join(_BYTE.format(f"{c} * (1::double - 0.4::double * 0.55::double) + 128::double * (0.4::double * 0.55::double)") + f" {c}" for c in "rgb") + " from px")


_PLACE = f"(pos % {SIDE})", f"(pos // {SIDE})"


def _place() -> tuple[Column, Column]:
    return F.col("at") % SIDE, F.floor(F.col("at") / SIDE)


register(
    "X28_vignette",
    lambda lib: recoloured(lib, lambda rgb: colour.vignette(rgb, *_place(), SIDE, SIDE, 70.0)),
    _PIXELS + f", v as (select *, 1 - 0.7::double * pow(sqrt(({_PLACE[0]} - 3.5::double) * ({_PLACE[0]} - 3.5::double) + ({_PLACE[1]} - 3.5::double) * ({_PLACE[1]} - 3.5::double)) / sqrt(24.5::double), 1.8::double) light from px) select file_id, pos, " + ", ".join(_BYTE.format(f"{c} * light") + f" {c}" for c in "rgb") + " from v",
)
register(
    "X28_grain",
    lambda lib: recoloured(lib, lambda rgb: colour.grain(rgb, *_place(), 45.0)),
    _PIXELS + f", n1 as (select *, (({_PLACE[0]} * 374761393) % 4294967296 + ({_PLACE[1]} * 668265263) % 4294967296) % 4294967296 n from px), n2 as (select * exclude (n), (xor(n, n >> 13) * 1274126177) % 4294967296 n from n1), n3 as (select *, (cast(xor(n, n >> 16) as double) / 4294967296::double - 0.5::double) * 2 * (0.45::double * 28) move from n2) select file_id, pos, " + ", ".join(_BYTE.format(f"{c} + move") + f" {c}" for c in "rgb") + " from n3",
)


# ---- lattices


def cube_texts(lib: Library) -> DataFrame:
    """(lut, text): every vector as the text of a cube file of 4 x 4 x 4 points, its components the values."""
    e, n = F.col("embedding"), F.size("embedding")
    value = lambda i, shift: F.format_string("%.6f", F.element_at(e, ((i + shift) % n + 1).cast("int")).cast("double"))
    points = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat_ws(" ", value(i, 0), value(i, 7), value(i, 13)))
    text = F.concat(F.lit('# made\nTITLE "of '), F.col("file_id").cast("string"), F.lit('"\nLUT_3D_SIZE 4\nDOMAIN_MIN -0.5 -0.5 -0.5\r\n\nDOMAIN_MAX 0.5 0.5 0.5\n'), F.array_join(points, "\n"), F.lit("\n"))
    return lib.embeds.where(n == 64).select(F.col("file_id").alias("lut"), text.alias("text"))


_POINTS = _PIXELS + ", pt as (select file_id, pos, " + ", ".join(f"greatest(0::double, least(1::double, (cast(printf('%.6f', cast(e[(pos + {shift}) % 64 + 1] as double)) as double) + 0.5::double) / 1::double)) {c}" for c, shift in (("r", 0), ("g", 7), ("b", 13))) + " from i where len(e) = 64) "


@query("S20_cube_lattice", _POINTS + "select file_id lut, 'of ' || file_id title, 4 size, cast(pos as int) as \"at\", round(r, 8) r, round(g, 8) g, round(b, 8) b from pt")
def cube_lattice(lib: Library) -> DataFrame:
    """Points of all cube files, read from their lines."""
    return lattice.lattices(cube_texts(lib)).select("lut", "title", "size", "at", *[F.round(c, 8).alias(c) for c in "rgb"])


_CORNER = lambda c, x, y, z: f"l{c}[((b0 + {z}) * 4 + g0 + {y}) * 4 + r0 + {x} + 1]"


def _trilinear(c: str) -> str:
    along = lambda y, z: f"({_CORNER(c, 0, y, z)} * (1 - rd) + {_CORNER(c, 1, y, z)} * rd)"
    flat = lambda z: f"({along(0, z)} * (1 - gd) + {along(1, z)} * gd)"
    return f"cast(floor(greatest(0::double, least(1::double, {flat(0)} * (1 - bd) + {flat(1)} * bd)) * 255::double + 0.5::double) as int) {c}"


@query(
    "X26_lattice_sample",
    _POINTS + ", la as (select file_id, " + ", ".join(f"list({c} order by pos) l{c}" for c in "rgb") + " from pt group by 1), f as (select px.file_id, px.pos, " + ", ".join(f"{c} / 255::double * 3 {c}f" for c in "rgb") + " from px), c as (select *, " + ", ".join(f"cast(least(floor({c}f), 2) as int) {c}0, {c}f - least(floor({c}f), 2) {c}d" for c in "rgb") + " from f) select file_id, pos, " + ", ".join(map(_trilinear, "rgb")) + " from c join la using (file_id)",
)
def lattice_sample(lib: Library) -> DataFrame:
    """Every picture's pixels through the lattice of its own cube file."""
    px = pixels(lib).select(F.col("file_id").alias("lut"), F.col("at").alias("pos"), *[(F.col(c) / 255.0).alias(c) for c in "rgb"])
    after = lattice.sampled(px, lattice.lattices(cube_texts(lib)))
    return after.select(F.col("lut").alias("file_id"), "pos", *[F.floor(F.col(c) * 255.0 + 0.5).cast("int").alias(c) for c in "rgb"])


# ---- colours of one picture mapped to another's


def lab_pixels(lib: Library) -> DataFrame:
    """pixels with l, a and b."""
    lab = colour.to_lab((F.col("r"), F.col("g"), F.col("b")))
    return pixels(lib).select("file_id", "at", "r", "g", "b", *[x.alias(f"lab_{c}") for c, x in zip("lab", lab, strict=True)])


def lab_quantiles(px: DataFrame) -> DataFrame:
    """(file_id, n, q_l, q_a, q_b): median, p16 and p84 of each channel; a picture's values are one row's."""
    n = F.col("n")
    rank = lambda v, s: F.element_at(v, (F.floor((n - 1) * s + 0.5) + 1).cast("int"))
    middle = lambda v: (F.element_at(v, (F.floor(n / 2) + 1).cast("int")) + F.element_at(v, F.floor((n + 1) / 2).cast("int"))) / 2
    lists = px.groupBy("file_id").agg(F.count("*").alias("n"), *[F.sort_array(F.collect_list(f"lab_{c}")).alias(f"v_{c}") for c in "lab"])
    return lists.select("file_id", "n", *[F.struct(middle(f"v_{c}").alias("median"), rank(f"v_{c}", 0.16).alias("p16"), rank(f"v_{c}", 0.84).alias("p84")).alias(f"q_{c}") for c in "lab"])


_LINEAR = "case when {0} / 255::double <= 0.04045 then {0} / 255::double / 12.92::double else pow(({0} / 255::double + 0.055::double) / 1.055::double, 2.4::double) end"
_CURVE = "case when {0} > 216::double / 24389 then cbrt({0}) else {0} / (3 * 36::double / 841) + 4::double / 29 end"
_SUM = lambda row, names: "(" + " + ".join(f"{n} * {v!r}::double" for n, v in zip(names, row, strict=True)) + ")"
_LAB = _PIXELS + ", x1 as (select file_id, pos, r, g, b, " + ", ".join(f"{_LINEAR.format(c)} {c}l" for c in "rgb") + " from px), x2 as (select *, " + ", ".join(f"{_CURVE.format(_SUM(row, ('rl', 'gl', 'bl')) + f' / {white!r}::double')} f{c}" for c, row, white in zip("xyz", colour.TO_XYZ, colour.WHITE, strict=True)) + " from x1), lab as (select file_id, pos, r, g, b, greatest(0::double, least(255::double, (116 * fy - 16) * 255 / 100)) l, greatest(0::double, least(255::double, 500 * (fx - fy) + 128)) a, greatest(0::double, least(255::double, 200 * (fy - fz) + 128)) bb from x2) "
register("X23_lab", lambda lib: lab_pixels(lib).select("file_id", F.col("at").alias("pos"), *[F.round(f"lab_{c}", 5).alias(c) for c in "lab"]), _LAB + "select file_id, pos, round(l, 5) l, round(a, 5) a, round(bb, 5) b from lab")
register("X23_lab_and_back", lambda lib: recoloured(lib, lambda rgb: colour.rounded(colour.from_lab(colour.to_lab(rgb)))), _PIXELS + "select file_id, pos, r, g, b from px")

_STRENGTHS = (0.6, 0.8, 0.8)
_Q = "select file_id, " + ", ".join(f"(v{c}[len(v{c}) // 2 + 1] + v{c}[(len(v{c}) + 1) // 2]) / 2 m{c}, v{c}[cast(floor((len(v{c}) - 1) * 0.16::double + 0.5) as int) + 1] lo{c}, v{c}[cast(floor((len(v{c}) - 1) * 0.84::double + 0.5) as int) + 1] hi{c}" for c in ("l", "a", "bb")) + " from (select file_id, " + ", ".join(f"list_sort(list({c})) v{c}" for c in ("l", "a", "bb")) + " from lab group by 1)"


def _moved(c: str, limit: int, part: float) -> str:
    width = f"greatest(0.84::double, least(1.18::double, ((o.hi{c} - o.lo{c}) + 0.000001::double) / ((q.hi{c} - q.lo{c}) + 0.000001::double)))"
    shift = f"greatest(-{limit}::double, least({limit}::double, o.m{c} - q.m{c}))"
    return f"greatest(0::double, least(255::double, {c} * (1 - {part}::double) + (({c} - q.m{c}) * {width} + q.m{c} + {shift}) * {part}::double)) {c}"


_CUBE = "case when {0} > 6::double / 29 then {0} * {0} * {0} else 3 * 36::double / 841 * ({0} - 4::double / 29) end"
_SHOWN = "greatest(0::double, least(255::double, 255 * case when {0} <= 0.0031308 then 12.92::double * greatest({0}, 0) else 1.055::double * pow(least({0}, 1), 1 / 2.4::double) - 0.055::double end))"
_MATCHED = (
    _LAB + f", q as ({_Q}), ref as (select label, min(file_id) other from v_embeds where embedding is not null group by 1), mv as (select lab.file_id, pos, r, g, b as b_old, " + ", ".join(_moved(c, limit, part) for c, limit, part in (("l", 16, 0.6), ("a", 20, 0.8), ("bb", 20, 0.8)))
    + " from lab join v_embeds v on v.file_id = lab.file_id join ref on ref.label = v.label join q on q.file_id = lab.file_id join q o on o.file_id = ref.other), "
    + "ff as (select *, (l * 100 / 255 + 16) / 116 fy from mv), f3 as (select *, fy + (a - 128) / 500 fx, fy - (bb - 128) / 200 fz from ff), xyz as (select *, " + ", ".join(f"({_CUBE.format('f' + c)}) * {white!r}::double {c}" for c, white in zip("xyz", colour.WHITE, strict=True))
    + " from f3), li as (select *, " + ", ".join(f"{_SUM(row, ('x', 'y', 'z'))} l{c}" for c, row in zip("rgb", colour.FROM_XYZ, strict=True)) + " from xyz), sh as (select file_id, pos, r as ro, g as go, b_old as bo, " + ", ".join(f"{_SHOWN.format('l' + c)} {c}n" for c in "rgb")
    + " from li), pr as (select *, 0.299::double * ro + 0.587::double * go + 0.114::double * bo gray from sh), pp as (select *, greatest(greatest(0::double, least(1::double, (gray - 190) / 35)) * 0.7::double, greatest(0::double, least(1::double, (70 - gray) / 35)) * 0.5::double) part from pr), "
    + "pn as (select file_id, pos, gray, " + ", ".join(f"{c}n * (1 - part) + {c}o * part {c}p" for c in "rgb") + " from pp), tn as (select *, 1 - 0.4::double + 0.4::double * greatest(0.6::double, least(1.8::double, gray / greatest(0.299::double * rp + 0.587::double * gp + 0.114::double * bp, 1))) factor from pn) "
)
_FINAL = ", ".join(_BYTE.format(f"{c}p * factor") + f" {c}" for c in "rgb")


@query("X24_X25_colour_match", _MATCHED + f"select file_id, pos, {_FINAL} from tn")
def colour_match(lib: Library) -> DataFrame:
    """Every picture's colours brought towards the first picture of its label, light and dark parts protected, its tone kept.

    The other picture's quantiles are three small structs a picture, met by an
    equi-join. Pictures of fewer pixels than LEAST_PIXELS stay as they are.
    """
    px = lab_pixels(lib)
    q = lab_quantiles(px)
    labels = lib.embeds.where("embedding is not null").select("file_id", "label")
    first = labels.groupBy("label").agg(F.min("file_id").alias("other"))
    others = q.select(F.col("file_id").alias("other"), F.col("n").alias("other_n"), *[F.col(f"q_{c}").alias(f"o_{c}") for c in "lab"])
    maps = labels.join(first, "label").join(others, "other").join(q, "file_id").where((F.col("n") >= colour.LEAST_PIXELS) & (F.col("other_n") >= colour.LEAST_PIXELS))
    met = px.join(maps.drop("label", "other", "n", "other_n"), "file_id", "left")
    old = tuple(F.col(c).cast("double") for c in "rgb")
    lab = colour.matched(tuple(F.col(f"lab_{c}") for c in "lab"), [F.col(f"q_{c}") for c in "lab"], [F.col(f"o_{c}") for c in "lab"], _STRENGTHS)
    staged = met.select("file_id", "at", "r", "g", "b", *[x.alias(f"new_{c}") for c, x in zip("lab", lab, strict=True)])
    shown = colour.from_lab(tuple(F.col(f"new_{c}") for c in "lab"))
    staged = staged.select("file_id", "at", "r", "g", "b", *[x.alias(f"to_{c}") for c, x in zip("rgb", shown, strict=True)])
    kept = colour.protected(tuple(F.col(f"to_{c}") for c in "rgb"), old, 0.7, 0.5)
    after = colour.rounded(colour.toned(kept, old, 0.4))
    return staged.select("file_id", F.col("at").alias("pos"), *[F.coalesce(x, F.col(c)).alias(c) for c, x in zip("rgb", after, strict=True)])


# ---- the editor: light, blur, hue, saturation, in this order


def blurred(px: DataFrame, sigma: float) -> DataFrame:
    """(file_id, x, y, r, g, b) blurred by a Gaussian, first along y, then along x, rounded at the end.

    Every pixel sends its weighed value to those around it; what lies outside
    of the picture has no part. Two groupings of a few rows a pixel, of which
    partial sums meet before the shuffle.
    """
    for axis in ("y", "x"):
        sent = F.explode(F.array(*[F.struct((F.col(axis) - d).alias("to"), F.lit(w).alias("w")) for d, w in colour.taps(sigma).items()])).alias("s")
        kept = [c for c in ("file_id", "x", "y") if c != axis]
        sums = px.select(*kept, sent, "r", "g", "b").groupBy(*kept, F.col("s.to").alias(axis)).agg(F.sum("s.w").alias("w"), *[F.sum(F.col(c) * F.col("s.w")).alias(c) for c in "rgb"])
        inside = px.select("file_id", "x", "y").distinct()
        px = sums.join(inside, ["file_id", "x", "y"], "left_semi").select("file_id", "x", "y", *[(F.col(c) / F.col("w")).alias(c) for c in "rgb"])
    return px.select("file_id", "x", "y", *[x.alias(c) for c, x in zip("rgb", colour.rounded(tuple(F.col(c) for c in "rgb")), strict=True)])


_CUT = "cast(floor(greatest(0::double, least(255::double, {0}))) as int)"
_WEIGHTS = ", ".join(f"({d}, {w!r}::double)" for d, w in colour.taps(0.9).items())
_EDITED = (
    _PIXELS + f", li as (select file_id, pos % {SIDE} x, pos // {SIDE} y, " + ", ".join(_CUT.format(f"({c} * 1.15::double - 128) * 0.8::double + 128") + f" {c}" for c in "rgb") + f" from px), k(d, w) as (values {_WEIGHTS}), "
    + "b1 as (select t.file_id, t.x, t.y, " + ", ".join(f"sum(o.{c} * w) / sum(w) {c}" for c in "rgb") + " from li t join li o on o.file_id = t.file_id and o.x = t.x join k on o.y = t.y + d group by 1, 2, 3), "
    + "b2 as (select t.file_id, t.x, t.y, " + ", ".join(f"cast(floor(greatest(0::double, least(255::double, sum(o.{c} * w) / sum(w))) + 0.5::double) as int) {c}" for c in "rgb") + " from b1 t join b1 o on o.file_id = t.file_id and o.y = t.y join k on o.x = t.x + d group by 1, 2, 3), "
    + "hu as (select file_id, x, y, " + ", ".join(_CUT.format(" + ".join(f"{m!r}::double * {n}" for m, n in zip(row, "rgb", strict=True))) + f" {c}" for c, row in zip("rgb", colour.hue_matrix(40), strict=True)) + " from b2), lu as (select *, 0.299::double * r + 0.587::double * g + 0.114::double * b gray from hu) "
)


@query("X37_editor", _EDITED + "select file_id, x, y, " + ", ".join(_CUT.format(f"gray + 1.3::double * ({c} - gray)") + f" {c}" for c in "rgb") + " from lu")
def editor(lib: Library) -> DataFrame:
    """Brightness and contrast, blur, hue and then saturation, since a blur or a change of hue comes before it."""
    lit = colour.edited((F.col("r"), F.col("g"), F.col("b")), 15, -20.0)
    px = pixels(lib).select("file_id", (F.col("at") % SIDE).cast("long").alias("x"), F.floor(F.col("at") / SIDE).cast("long").alias("y"), *[x.alias(c) for c, x in zip("rgb", lit, strict=True)])
    turned = colour.hue((F.col("r"), F.col("g"), F.col("b")), 40)
    px = blurred(px, 0.9).select("file_id", "x", "y", *[x.alias(c) for c, x in zip("rgb", turned, strict=True)])
    last = colour.edited((F.col("r"), F.col("g"), F.col("b")), saturation=1.3)
    return px.select("file_id", "x", "y", *[x.alias(c) for c, x in zip("rgb", last, strict=True)])


register(
    "X37_editor_fused",
    lambda lib: recoloured(lib, lambda rgb: colour.edited(rgb, -10, 30.0, 0.5)),
    _PIXELS + ", m as (select file_id, pos, " + ", ".join(f"({c} * 0.9::double - 128) * 1.3::double + 128 {c}" for c in "rgb") + " from px), l as (select *, 0.299::double * r + 0.587::double * g + 0.114::double * b gray from m) select file_id, pos, " + ", ".join(_CUT.format(f"gray + 0.5::double * ({c} - gray)") + f" {c}" for c in "rgb") + " from l",
)
