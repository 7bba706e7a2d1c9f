"""Texts, boxes and places that belong to files: lens makers, comments, names for caches, faces, cities."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspan.plans.catalog import Library
from mediaspan.plans.registry import query, register
from mediaspan.plans.workspace import Workspace

# How lens models tell their maker, tested in this order.
LENS_RULES = [
    ("starts", "CANON", "Canon"),
    ("starts", "CN-E", "Canon"),
    ("starts", "TS-E", "Canon"),
    ("starts", "MP-E", "Canon"),
    ("starts", "RF-S", "Canon"),
    ("starts", "RF", "Canon"),
    ("starts", "EF-S", "Canon"),
    ("starts", "EF-M", "Canon"),
    ("starts", "EF", "Canon"),
    ("holds", "NIKKOR", "Nikon"),
    ("starts", "SONY", "Sony"),
    ("starts", "SEL", "Sony"),
    ("starts", "FE ", "Sony"),
    ("starts", "E ", "Sony"),
    ("starts", "E PZ ", "Sony"),
    ("starts", "FUJINON", "Fujifilm"),
    ("starts", "XF", "Fujifilm"),
    ("starts", "XC", "Fujifilm"),
    ("starts", "GF", "Fujifilm"),
    ("starts", "LUMIX", "Panasonic"),
    ("starts", "LEICA DG", "Panasonic"),
    ("starts", "LEICA D", "Panasonic"),
    ("starts", "LEICA", "Leica"),
    ("starts", "TAMRON", "Tamron"),
    ("holds", " DI III-A", "Tamron"),
    ("holds", " DI III", "Tamron"),
    ("holds", " DI II", "Tamron"),
    ("holds", " DI ", "Tamron"),
    ("starts", "SIGMA", "Sigma"),
    ("starts", "TOKINA", "Tokina"),
    ("starts", "AT-X", "Tokina"),
    ("starts", "SAMYANG", "Samyang"),
    ("starts", "ROKINON", "Samyang"),
    ("starts", "VOIGTLANDER", "Voigtlander"),
    ("starts", "TTARTISAN", "TTArtisan"),
    ("starts", "7ARTISANS", "7Artisans"),
    ("starts", "VILTROX", "Viltrox"),
]


def lens_make(model: Column) -> Column:
    """The maker by the first rule that fits the model, upper-cased with single blanks; else null."""
    plain = F.trim(F.regexp_replace(F.upper(model), r"\s+", " "))
    found = F.lit(None).cast("string")
    for how, needle, make in reversed(LENS_RULES):
        found = F.when(plain.startswith(needle) if how == "starts" else plain.contains(needle), make).otherwise(found)
    return found


_MODELS = ["rf 24-70", " ef-s\t18mm", "AF-S NIKKOR 50mm", "E 35mm", "leica dg 25", "Leica M 50", "28-75mm F/2.8 Di III VXD", "Sigma 35", "unknown glass", ""]
_LENS_SQL = "case " + " ".join(f"when {'starts_with' if how == 'starts' else 'contains'}(m, '{needle}') then '{make}'" for how, needle, make in LENS_RULES) + " end"
register(
    "P7_lens_make",
    lambda lib: lib.files.select("id", lens_make(F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("id") % len(_MODELS) + 1).cast("int"))).alias("make")),
    f"select id, {_LENS_SQL} make from (select id, trim(regexp_replace(upper([{', '.join(repr(m) for m in _MODELS)}][id % {len(_MODELS)} + 1]), '\\s+', ' ', 'g')) m from v_files)".replace("\\t", "\t"),
)


@query("P6_raw_overlay", "select id, coalesce(e_make, 'RAWCO') make, coalesce(e_lens_model, 'RAWLENS') lens_model, case when coalesce(taken_date, modified_at) = modified_at and id % 3 = 0 then created_at else coalesce(taken_date, modified_at) end taken_date from v_files where file_type = 3")
def raw_overlay(lib: Library) -> DataFrame:
    """Fields of a raw file that are missing come from its own metadata; the date only where it is the time of change that stood in."""
    raw = lib.files.where("file_type = 3")
    own = raw.select("id", F.lit("RAWCO").alias("make"), F.lit("RAWLENS").alias("lens_model"), F.when(F.col("id") % 3 == 0, F.col("created_at")).alias("stamp"))
    taken = F.coalesce("taken_date", "modified_at")
    dated = F.when((taken == F.col("modified_at")) & F.col("stamp").isNotNull(), F.col("stamp")).otherwise(taken)
    return raw.join(own, "id").select("id", F.coalesce("e_make", "make").alias("make"), F.coalesce("e_lens_model", "lens_model").alias("lens_model"), dated.alias("taken_date"))


def fnv1a64(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as 16 hex digits, in halves of 32 bits, so that no product overflows."""
    octets = F.filter(F.split(F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "$1 "), " "), lambda x: x != "")
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    mask = F.lit(0xFFFFFFFF).cast("long")

    def step(h: Column, octet: Column) -> Column:
        # The prime is 2**40 + 435: the low half times 2**40 lands in the high half, shifted by eight.
        lo = h["lo"].bitwiseXOR(F.conv(octet, 16, 10).cast("long"))
        low = lo * 435
        high = h["hi"] * 435 + F.shiftright(low, 32) + F.shiftleft(lo, 8)
        return F.struct(high.bitwiseAND(mask).alias("hi"), low.bitwiseAND(mask).alias("lo"))

    shown = lambda h: F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0")))
    return F.aggregate(octets, start, step, shown)


register(
    "X33_fnv1a",
    lambda lib: lib.base.select("id", fnv1a64(F.col("file_path")).alias("hash")),
    "select id, lower(lpad(printf('%x', cast(h // 4294967296 as bigint)), 8, '0') || lpad(printf('%x', cast(h % 4294967296 as bigint)), 8, '0')) hash from (select id, list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(range(0, length(x), 2), lambda i: cast(('0x' || substr(x, i + 1, 2)) as uhugeint))), lambda a, b: (xor(a, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint) h from (select id, hex(encode(file_path)) x from v_base))",
)


def user_comment(content: Column) -> Column:
    """The text of an EXIF user comment: eight bytes of charset, then the body; null if nothing is left.

    UTF-16 takes its order from a mark, else from where the zero bytes lie; it ends at a zero character.
    """
    head, body = F.hex(F.substring(content, 1, 8)), F.substring(content, F.lit(9), F.octet_length(content))
    trimmed = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\x00+$", "")), F.lit(""))
    plain = lambda c: trimmed(F.decode(c, "UTF-8"))
    pairs = F.filter(F.split(F.regexp_replace(F.hex(body), "(....)", "$1 "), " "), lambda x: F.length(x) == 4)
    zeros = lambda at: F.size(F.filter(pairs, lambda x: F.substring(x, at, 2) == "00"))
    mark = F.substring(F.hex(body), 1, 4)
    big = F.when(mark == "FEFF", True).when(mark == "FFFE", False).otherwise(zeros(3) >= zeros(1))
    units = F.when(mark.isin("FEFF", "FFFE"), F.slice(pairs, F.lit(2), F.greatest(F.size(pairs) - 1, F.lit(0)))).otherwise(pairs)
    end = F.array_position(units, F.lit("0000"))
    used = F.unhex(F.array_join(F.when(end > 0, F.slice(units, F.lit(1), (end - 1).cast("int"))).otherwise(units), ""))
    wide = F.nullif(F.trim(F.when(big, F.decode(used, "UTF-16BE")).otherwise(F.decode(used, "UTF-16LE"))), F.lit(""))
    known = F.when(head.startswith("4153434949") | (head == "0" * 16) | head.startswith("4A4953"), plain(body)).when(head.startswith("554E49434F4445"), wide)
    return F.coalesce(F.when(F.octet_length(content) >= 8, known), plain(content))


@query("X30_user_comment", "select id, case id % 5 when 4 then name else nullif(trim(name), '') end comment from v_files")
def comments(lib: Library) -> DataFrame:
    """Names written as comments in every charset, as they are read back."""
    k, name = F.col("id") % 5, F.col("name")
    head = lambda h: F.unhex(F.lit(h))
    made = (
        F.when(k == 0, F.concat(head("4153434949000000"), F.encode(name, "UTF-8"), head("0000")))
        .when(k == 1, F.concat(head("554E49434F444500"), head("FFFE"), F.encode(name, "UTF-16LE"), head("0000")))
        .when(k == 2, F.concat(head("554E49434F444500"), head("FEFF"), F.encode(name, "UTF-16BE")))
        .when(k == 3, F.concat(head("4A49530000000000"), F.encode(F.concat(F.lit(" "), name), "UTF-8")))
        .otherwise(F.encode(name, "UTF-8"))
    )
    return lib.files.select("id", user_comment(made).alias("comment"))


def clip_query(text: Column) -> Column:
    """A short Latin label as "a photo of a label"; longer or other texts as they are, trimmed."""
    t = F.trim(F.coalesce(text, F.lit("")))
    low, words = F.lower(t), F.size(F.split(t, r"\s+"))
    described = low.rlike("^(?:a photo of|a close |an image of|a picture of)")
    simple = t.rlike(r"^[A-Za-z0-9\s'-]+$") & (words <= 3) & (F.length(t) <= 32)
    article = F.when(low.rlike("^(?:a|an|the) "), "").when(low.rlike("^[aeiou]"), "an ").otherwise("a ")
    return F.when(described | ~simple, t).otherwise(F.concat(F.lit("a photo of "), article, t))


def labels(lib: Library) -> DataFrame:
    """(label): names that a search begins with, whole: of tags, persons, folders and parts, some with an article or described."""
    part = lib.table("part")
    kinds = [lib.tags.select("name"), lib.persons.select("name"), lib.folders.select("name"), part.select("p_name"), part.select(F.concat(F.lit("the "), "p_name")), part.select(F.concat(F.lit("a photo of "), "p_type")), part.select(F.concat_ws(" ", "p_name", "p_type", "p_brand"))]
    found = kinds[0]
    for kind in kinds[1:]:
        found = found.union(kind)
    return found.toDF("label").distinct()


register(
    "X19_clip_query",
    lambda lib: labels(lib).select("label", clip_query(F.col("label")).alias("prompt")),
    "select label, case when regexp_matches(lower(t), '^(a photo of|a close |an image of|a picture of)') or not (regexp_full_match(t, '[A-Za-z0-9\\s''-]+') and len(regexp_split_to_array(t, '\\s+')) <= 3 and length(t) <= 32) then t else 'a photo of ' || case when regexp_matches(lower(t), '^(a|an|the) ') then '' when regexp_matches(lower(t), '^[aeiou]') then 'an ' else 'a ' end || t end prompt from (select *, trim(label, ' ') t from (select name as label from v_tags union select name from v_persons union select name from v_folders union select p_name from part union select 'the ' || p_name from part union select 'a photo of ' || p_type from part union select p_name || ' ' || p_type || ' ' || p_brand from part))",
)


# ---- faces

MIN_CONFIDENCE, MIN_SHARPNESS, MAX_OVERLAP, EXPANSION = 0.65, 200.0, 0.4, 0.2


def boxes(lib: Library) -> DataFrame:
    """Detections of the order lines: (file_id, box, x, y, w, h, confidence, blur)."""
    li = lib.table("lineitem")
    return li.select(
        (F.col("l_orderkey") + 1).alias("file_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("box"), (F.col("l_partkey") % 60).cast("double").alias("x"), (F.col("l_suppkey") % 40).cast("double").alias("y"),
        (F.col("l_quantity") + 10).cast("double").alias("w"), (F.col("l_linenumber") * 4 + 20).cast("double").alias("h"), (F.col("l_partkey") % 97 / 97.0).alias("confidence"), (F.col("l_extendedprice") % 400).alias("blur"),
    )


_BOXES = ", x as (select l_orderkey + 1 file_id, l_partkey * 10 + l_linenumber box, cast(l_partkey % 60 as double) x, cast(l_suppkey % 40 as double) y, cast(l_quantity + 10 as double) w, cast(l_linenumber * 4 + 20 as double) h, l_partkey % 97 / 97.0::double confidence, l_extendedprice % 400 blur from lineitem) "


def overlapping(a: Column, b: Column) -> Column:
    """Whether two boxes share more of their union than MAX_OVERLAP."""
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    inner = F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))
    return inner > MAX_OVERLAP * (a["w"] * a["h"] + b["w"] * b["h"] - inner)


def suppress(found: DataFrame) -> DataFrame:
    """(file_id, box) of the boxes that no surer kept box of their file overlaps; the smaller number is the surer of equal ones, then the smaller x, y, w and h.

    A file's boxes are one row's array, the surest first, and are taken in that order.
    """
    one = F.struct((-F.col("confidence")).alias("order"), "box", "x", "y", "w", "h")
    files = found.groupBy("file_id").agg(F.array_sort(F.collect_list(one)).alias("boxes"))
    none = F.slice("boxes", 1, 0)
    kept = F.aggregate("boxes", none, lambda kept, b: F.when(F.exists(kept, lambda k: overlapping(k, b)), kept).otherwise(F.concat(kept, F.array(b))))
    return files.select("file_id", F.explode(kept).alias("b")).select("file_id", "b.box")


register("C7_face_quality", lambda lib: boxes(lib).where((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("blur") >= MIN_SHARPNESS)).select("file_id", "box"), _BOXES + f"select file_id, box from x where confidence >= {MIN_CONFIDENCE} and blur >= {MIN_SHARPNESS}")
_SURE = "select distinct file_id, box, x, y, w, h, confidence from x where confidence >= 0.65"
_CLASH = f"greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)"


@query(
    "C6_suppression",
    _BOXES + f""", s as ({_SURE}), o as (select *, row_number() over (partition by file_id order by confidence desc, box, x, y, w, h) r from s),
    c as (select a.file_id, a.r, list(b.r) before from o a join o b on a.file_id = b.file_id and b.r < a.r and {_CLASH} > {MAX_OVERLAP} * (a.w * a.h + b.w * b.h - {_CLASH}) group by 1, 2),
    k as (with recursive go(file_id, r, kept) as (select file_id, 0::bigint, []::bigint[] from (select distinct file_id from o)
        union all select go.file_id, go.r + 1, case when coalesce(len(list_intersect(c.before, go.kept)), 0) = 0 then list_append(go.kept, go.r + 1) else go.kept end from go join o on o.file_id = go.file_id and o.r = go.r + 1 left join c on c.file_id = go.file_id and c.r = go.r + 1) select file_id, unnest(arg_max(kept, r)) r from go group by 1)
    select o.file_id, o.box from o join k using (file_id, r)""",
)
def suppressed(lib: Library) -> DataFrame:
    """Overlapping detections of a file leave the surest."""
    sure = boxes(lib).where(F.col("confidence") >= MIN_CONFIDENCE).select("file_id", "box", "x", "y", "w", "h", "confidence").distinct()
    return suppress(sure)


def turned_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, orientation: Column) -> Column:
    """struct(x, y, w, h) of a box in the picture as it is shown: orientations 3, 6 and 8 turn it."""
    turned = lambda *c: F.struct(*[v.cast("double").alias(n) for v, n in zip(c, "xywh", strict=True)])
    return F.when(orientation == 6, turned(height - y - h, x, h, w)).when(orientation == 8, turned(y, width - x - w, h, w)).when(orientation == 3, turned(width - x - w, height - y - h, w, h)).otherwise(turned(x, y, w, h))


def crop(box: Column, width: Column, height: Column) -> Column:
    """struct(x, y, w, h) in whole pixels: a fifth more on every side, within the picture."""
    x, y = F.floor(F.greatest(box["x"] - box["w"] * EXPANSION, F.lit(0.0))), F.floor(F.greatest(box["y"] - box["h"] * EXPANSION, F.lit(0.0)))
    within = lambda size, whole, at: F.floor(F.least(size * (1 + 2 * EXPANSION), F.greatest(whole - at, F.lit(0)).cast("double")))
    return F.struct(x.alias("x"), y.alias("y"), within(box["w"], width, x).alias("w"), within(box["h"], height, y).alias("h"))


@query(
    "X35_face_crop",
    _BOXES + """, f as (select x.*, a.width, a.height, [1, 3, 6, 8][file_id % 4 + 1] o from x join v_files a on a.id = file_id),
    t as (select file_id, box, o, case when o in (6, 8) then height else width end pw, case when o in (6, 8) then width else height end ph,
    case o when 6 then height - y - h when 8 then y when 3 then width - x - w else x end tx, case o when 6 then x when 8 then width - x - w when 3 then height - y - h else y end ty, case when o in (6, 8) then h else w end tw, case when o in (6, 8) then w else h end th from f),
    c as (select *, cast(floor(greatest(tx - tw * 0.2::double, 0)) as bigint) cx, cast(floor(greatest(ty - th * 0.2::double, 0)) as bigint) cy from t)
    select distinct file_id, box, cx, cy, cast(floor(least(tw * (1 + 2 * 0.2::double), greatest(pw - cx, 0))) as bigint) cw, cast(floor(least(th * (1 + 2 * 0.2::double), greatest(ph - cy, 0))) as bigint) ch from c""",
)
def crops(lib: Library) -> DataFrame:
    o = F.element_at(F.array(*map(F.lit, (1, 3, 6, 8))), (F.col("file_id") % 4 + 1).cast("int"))
    # Both sides are dealt once by file, to as many tasks as there are rows for; equal crops of a file meet where they lie.
    parts = lib.deals()
    sized = lib.files.select(F.col("id").alias("file_id"), "width", "height").repartition(parts, "file_id")
    f = boxes(lib).repartition(parts, "file_id").join(sized, "file_id").withColumn("o", o)
    t = f.withColumn("t", turned_box(*[F.col(c) for c in ("x", "y", "w", "h", "width", "height", "o")]))
    across = F.col("o").isin(6, 8)
    c = t.withColumn("c", crop(F.col("t"), F.when(across, F.col("height")).otherwise(F.col("width")), F.when(across, F.col("width")).otherwise(F.col("height"))))
    return c.select("file_id", "box", *[F.col(f"c.{n}").alias(f"c{n}") for n in "xywh"]).distinct()


# ---- places

#: Cities that a cube of the first round holds on average; each later round has edges GROWTH times as long, up to the whole globe.
PER_CUBE, GROWTH, WHOLE = 4, 4.0, 4.0


def edges(cities: int) -> list[float]:
    """Edges of the cubes, round by round, for so many cities on the unit sphere."""
    found = [min(WHOLE, math.sqrt(4 * math.pi * PER_CUBE / max(cities, 1)))]
    while found[-1] < WHOLE:
        found.append(min(WHOLE, found[-1] * GROWTH))
    return found


def unit_xyz(lat: Column, lon: Column) -> list[Column]:
    a, o = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)]


def nearest(points: DataFrame, cities: DataFrame) -> DataFrame:
    """(lat, lon, city): the city (city, lat, lon) nearest to each distinct point; of equal ones the smallest.

    Points look into the 27 cubes around them. What is nearer there than one
    edge is nearest of all; the others, written in between, try larger cubes.
    Joins are on cubes, so neither side has to fit in memory. The first cubes
    are so small that they hold a few cities on average.
    """
    work = Workspace(points.sparkSession, "nearest")
    known = points.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)").distinct()
    at = lambda df: df.withColumns(dict(zip(("x", "y", "z"), unit_xyz(F.col("lat"), F.col("lon")), strict=True)))
    # Cities at one place are equally near, so the smallest stands for them: a crowded place is one row.
    places = cities.groupBy("lat", "lon").agg(F.min("city").alias("city"))
    homes = work.table(at(places).select("city", *[F.col(c).alias(f"c{c}") for c in "xyz"]), "homes")
    left, found = work.table(at(known), "left-0"), []
    steps = F.array(*[F.lit(s) for s in (-1, 0, 1)])
    for n_round, edge in enumerate(edges(homes.count()), 1):
        cube = lambda p, e=edge: [F.floor(F.col(f"{p}{c}") / e) for c in "xyz"]
        looks = left.select("lat", "lon", "x", "y", "z", *[c.alias(f"k{n}") for n, c in zip("xyz", cube(""), strict=True)])
        for n in "xyz":
            looks = looks.withColumn("s", F.explode(steps)).withColumn(f"k{n}", F.col(f"k{n}") + F.col("s")).drop("s")
        housed = homes.select("city", "cx", "cy", "cz", *[c.alias(f"k{n}") for n, c in zip("xyz", cube("c"), strict=True)])
        square = sum(((F.col(c) - F.col(f"c{c}")) ** 2 for c in "xyz"), F.lit(0.0))
        best = looks.join(housed, ["kx", "ky", "kz"]).withColumn("d", F.round(square, 12)).groupBy("lat", "lon").agg(F.min(F.struct("d", "city")).alias("m"))
        near = work.table(best.where(F.col("m.d") < edge * edge).select("lat", "lon", F.col("m.city").alias("city")), f"near-{n_round}")
        found.append(near)
        left = work.table(left.join(near.select("lat", "lon"), ["lat", "lon"], "left_anti"), f"left-{n_round}")
        work.drop(f"left-{n_round - 1}")
        if not left.limit(1).count():
            break
    return reduce(DataFrame.unionByName, found)


@query("J16_nearest_city", """, c as (select s_suppkey city, cast(s_suppkey % 31 as double) * 5.5 - 83 lat, cast(s_suppkey % 37 as double) * 9.5 - 171 lon from supplier),
u as (select city, cos(radians(lat)) * cos(radians(lon)) x, cos(radians(lat)) * sin(radians(lon)) y, sin(radians(lat)) z from c), g as (select distinct gps_latitude lat, gps_longitude lon from v_files where gps_latitude is not null),
p as (select lat, lon, cos(radians(lat)) * cos(radians(lon)) x, cos(radians(lat)) * sin(radians(lon)) y, sin(radians(lat)) z from g)
select p.lat, p.lon, arg_min(city, (round(pow(p.x - u.x, 2) + pow(p.y - u.y, 2) + pow(p.z - u.z, 2), 12), city)) city from p, u group by 1, 2""")
def geocoded(lib: Library) -> DataFrame:
    cities = lib.table("supplier").select(F.col("s_suppkey").alias("city"), ((F.col("s_suppkey") % 31).cast("double") * 5.5 - 83).alias("lat"), ((F.col("s_suppkey") % 37).cast("double") * 9.5 - 171).alias("lon"))
    return nearest(lib.files.select(F.col("gps_latitude").alias("lat"), F.col("gps_longitude").alias("lon")), cities)
