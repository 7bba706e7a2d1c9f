"""Scans, filters, sorts, pages, positions and timelines of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaspan.plans.catalog import Library
from mediaspan.plans.predicates import DATE_COLUMNS, Params, day, search
from mediaspan.plans.registry import query, register

DAY = "strftime(make_timestamp({0} * 1000000), '%Y-%m-%d')"
NEW_YEAR_1995, NEW_YEAR_1996 = 788918400, 820454400

# Standard filters: (query, parameters, the same condition over v_visible).
FILTERS = [
    ("F1_F2_always_on", Params(), "true"),
    ("F3_name_contains", Params(name="img_12"), "translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%img_12%'"),
    ("F4_type_mask_video_live", Params(type_mask=10), "file_type = 2 or live_photo_type in (1, 3, 4)"),
    ("F4_type_mask_all", Params(type_mask=15), "true"),
    ("F5_subtree", Params(subtree="/lib/ASIA"), "folder_path = '/lib/ASIA' or lower(folder_path) like '/lib/asia/%'"),
    ("F6_exact_folder", Params(folder="/lib/ASIA/NATION_12/BUILDING"), "folder_path = '/lib/ASIA/NATION_12/BUILDING'"),
    ("F7_date_range", Params(start=NEW_YEAR_1995, end=NEW_YEAR_1996), f"cast(make_timestamp(taken_date * 1000000) as date) >= date '1995-01-01' and cast(make_timestamp(taken_date * 1000000) as date) < date '1996-01-01'"),
    ("F7_date_range_modified", Params(start=NEW_YEAR_1995, end=NEW_YEAR_1996, calendar_sort=4), "cast(make_timestamp(modified_at * 1000000) as date) >= date '1995-01-01' and cast(make_timestamp(modified_at * 1000000) as date) < date '1996-01-01'"),
    ("F8_on_this_day", Params(start=-1, end=-1, today="07-04"), "strftime(make_timestamp(taken_date * 1000000), '%m-%d') = '07-04'"),
    ("F9_camera", Params(make="canon", model="M3"), "upper(e_make) = 'CANON' and e_model = 'M3'"),
    ("F10_lens", Params(lens_make="tamron"), "upper(e_lens_make) = 'TAMRON'"),
    ("F11_location", Params(admin1="N12", place="HOUSEHOLD"), "geo_admin1 = 'N12' and geo_name = 'HOUSEHOLD'"),
    ("F12_gps_box_antimeridian", Params(box=(-10, 10, 170, -170)), "gps_latitude between -10 and 10 and (gps_longitude >= 170 or gps_longitude <= -170)"),
    ("F12_gps_box", Params(box=(-45, 45, -30, 60)), "gps_latitude between -45 and 45 and gps_longitude between -30 and 60"),
    ("F13_favorite", Params(favorite=True), "is_favorite"),
    ("F14_unrated", Params(rating=0), "coalesce(rating, 0) = 0"),
    ("F14_rating", Params(rating=4), "rating = 4"),
    ("F15_tag", Params(tag_id=12), "id in (select file_id from v_file_tags where tag_id = 12)"),
    ("F16_person", Params(person_id=3), "id in (select file_id from v_faces where person_id = 3)"),
    ("F_combined", Params(type_mask=1, rating=4, make="nikon", tag_id=12, subtree="/lib/EUROPE"), "file_type = 1 and rating = 4 and upper(e_make) = 'NIKON' and id in (select file_id from v_file_tags where tag_id = 12) and lower(folder_path) like '/lib/europe/%'"),
]
for _name, _params, _sql in FILTERS:
    register(_name, lambda lib, p=_params: search(lib, p).select("id", "name", "size"), f"select id, name, size from v_visible where {_sql}")


@query("S1_library_scan", "select id, folder_id, album_id, folder_path, album_name, name, size, has_thumbnail, has_embedding from v_base")
def library_scan(lib: Library) -> DataFrame:
    return lib.base.select("id", "folder_id", "album_id", "folder_path", "album_name", "name", "size", "has_thumbnail", "has_embedding")


def count_and_size(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))


_COUNT = "select count(*) n, cast(coalesce(sum(size), 0) as bigint) total_size from "
register("S2_count_scan", lambda lib: count_and_size(lib.base), _COUNT + "v_base")
register("A1_query_count_sum", lambda lib: count_and_size(search(lib, Params(person_id=3))), _COUNT + "v_visible where id in (select file_id from v_faces where person_id = 3)")
register("A2_total_count_sum", lambda lib: count_and_size(lib.visible(lib.base)), _COUNT + "v_visible")
register("A35_library_info", lambda lib: count_and_size(lib.files), _COUNT + "v_files")


@query(
    "S5_folder_tree",
    """select distinct a.path, len(string_split(a.path, '/')) - 1 depth from (select array_to_string(list_slice(string_split(path, '/'), 1, n), '/') path
    from v_folders, unnest(range(2, len(string_split(path, '/')) + 1)) t(n)) a""",
)
def folder_tree(lib: Library) -> DataFrame:
    """Every folder and ancestor, each once, with its depth."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    paths = lib.folders.select(F.explode(above).alias("path")).distinct()
    return paths.select("path", (F.size(F.split("path", "/")) - 1).cast("long").alias("depth"))


@query(
    "S6_folder_file_counter",
    """select folder_id, count(*) filter (where file_type in (1, 3)) images, cast(coalesce(sum(size) filter (where file_type in (1, 3)), 0) as bigint) image_bytes,
    count(*) filter (where file_type = 2) videos, cast(coalesce(sum(size) filter (where file_type = 2), 0) as bigint) video_bytes from v_files group by folder_id""",
)
def folder_counter(lib: Library) -> DataFrame:
    """Raw files count as images."""
    image, video = F.col("file_type").isin(1, 3), F.col("file_type") == 2
    sized = lambda c: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0))
    return lib.files.groupBy("folder_id").agg(F.count_if(image).alias("images"), sized(image).alias("image_bytes"), F.count_if(video).alias("videos"), sized(video).alias("video_bytes"))


# File name extensions by type (1 image, 2 video, 3 raw).
_TYPES = {
    1: "jpg jpeg png gif bmp tif tiff webp avif heic heif hif jxl psd exr hdr rgbe tga dds qoi jp2 j2k j2c jpc jpf jpx dpx".split(),
    2: "mpg mpeg mp4 mkv avi mov webm flv wmv 3gp m4v hevc asf mts m2ts mod tod ts".split(),
    3: "cr2 cr3 crw nef nrw arw srf sr2 raf rw2 orf pef dng srw rwl mrw 3fr mos iiq x3f dcr kdc erf mef raw mdc".split(),
}


def extension(name) -> F.Column:
    """What follows the last dot, lower-cased; null without one or in a name that only begins with it."""
    return F.when(name.rlike(r"[^/]\.[^./]+$"), F.lower(F.substring_index(name, ".", -1)))


def file_stem(name) -> F.Column:
    """The name without its extension."""
    return F.when(name.rlike(r"[^/]\.[^./]*$"), F.regexp_replace(name, r"\.[^./]*$", "")).otherwise(name)


def file_type(name) -> F.Column:
    """1 image, 2 video, 3 raw, null for anything else."""
    ext = extension(name)
    return F.when(ext.isin(_TYPES[1]), 1).when(ext.isin(_TYPES[2]), 2).when(ext.isin(_TYPES[3]), 3)


#: Names with every extension there is: those of the files, each second one with another.
_SAMPLE = [*_TYPES[1], *_TYPES[2], *_TYPES[3], "txt", "JPG", "Cr2", ""]
_NAMED = f"(select id, case when id % 2 = 0 then name else 'a.b_' || id || '.' || [{', '.join(repr(x) for x in _SAMPLE)}][id % {len(_SAMPLE)} + 1] end as name from v_files)"


def _named(lib: Library) -> DataFrame:
    other = F.concat(F.lit("a.b_"), F.col("id").cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, _SAMPLE)), (F.col("id") % len(_SAMPLE) + 1).cast("int")))
    return lib.files.select("id", F.when(F.col("id") % 2 == 0, F.col("name")).otherwise(other).alias("name"))


def _in(kind: int) -> str:
    return "(" + ", ".join(f"'{x}'" for x in _TYPES[kind]) + ")"


_EXT = "lower(regexp_extract(name, '[^/]\\.([^./]+)$', 1))"
register("S8_file_type_classifier", lambda lib: _named(lib).select("id", file_type(F.col("name")).alias("kind")), f"select id, case when {_EXT} in {_in(1)} then 1 when {_EXT} in {_in(2)} then 2 when {_EXT} in {_in(3)} then 3 end kind from {_NAMED}")
register("X16_name_parts", lambda lib: _named(lib).select("id", file_stem(F.col("name")).alias("stem"), F.coalesce(extension(F.col("name")), F.lit("")).alias("ext")), f"select id, regexp_replace(name, '\\.[^./]*$', '') stem, {_EXT} ext from {_NAMED}")
register("S7_hidden_entries", lambda lib: lib.files.where(~F.col("name").startswith(".")).agg(F.count("*").alias("n")), "select count(*) n from v_files where not starts_with(name, '.')")
register("S11_folders_for_search", lambda lib: lib.folders.select("album_id", "path", "id").orderBy("album_id", "path"), "select album_id, path, id from v_folders")
register("S12_album_list", lambda lib: lib.albums.orderBy("display_order_id"), "select * from v_albums")
register("S13_batch_by_ids", lambda lib: lib.files.join(lib.persons.select("id"), "id", "left_semi").select("id", "name"), "select id, name from v_files where id in (select id from v_persons)")
register("S14_point_lookup", lambda lib: lib.files.where((F.col("folder_id") == 1011) | (F.col("id") == 7)).select("id", "folder_id", "name"), "select id, folder_id, name from v_files where folder_id = 1011 or id = 7")
register("S15_embedding_by_id", lambda lib: lib.embeds.where("file_id = 7").select("file_id", F.posexplode("embedding").alias("pos", "x")).select("file_id", F.col("pos").cast("long"), F.round(F.col("x").cast("double"), 6).alias("x")), "select file_id, cast(unnest(range(len(embedding))) as bigint) pos, round(cast(unnest(embedding) as double), 6) x from v_embeds where file_id = 7")
register("S16_slim_face_scan", lambda lib: lib.faces.select("file_id", F.coalesce("person_id", F.lit(0)).alias("person_id")), "select file_id, coalesce(person_id, 0) person_id from v_faces")
register("S17_unprocessed_images", lambda lib: lib.files.where("file_type = 1 and coalesce(has_faces, 0) = 0 and width is not null and height is not null").select("id").orderBy("id"), "select id from v_files where file_type = 1 and coalesce(has_faces, 0) = 0")
register("S23_exists_by_path", lambda lib: lib.base.where("file_path = '/lib/ASIA/NATION_12/BUILDING/IMG_1.PNG'").limit(1).agg((F.count("*") > 0).alias("found")), "select count(*) > 0 found from v_base where file_path = '/lib/ASIA/NATION_12/BUILDING/IMG_1.PNG'")
register("P3_file_path", lambda lib: lib.base.select("id", "file_path"), "select id, file_path from v_base")
_turned = "(rotate in (90, 270) and file_type <> 3)"
register("P4_oriented_size", lambda lib: lib.files.select("id", F.expr(f"if({_turned}, height, width)").alias("w"), F.expr(f"if({_turned}, width, height)").alias("h")), f"select id, case when {_turned} then height else width end w, case when {_turned} then width else height end h from v_files")
register("P5_taken_fallback", lambda lib: lib.files.select("id", F.coalesce("taken_date", "modified_at").alias("taken")), "select id, coalesce(taken_date, modified_at) taken from v_files")


def storage_size(c) -> F.Column:
    """Bytes as text in units of 1024: whole bytes and kilobytes, two places beyond; empty for null or less than nothing."""
    c = c.cast("double")
    shown = F.format_string("%.0f B", F.round(c))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        places = 2 if power > 1 else 0
        shown = F.when(c >= 1024.0**power, F.format_string(f"%.{places}f {unit}", F.round(c / 1024.0**power, places))).otherwise(shown)
    return F.when(c.isNull() | (c < 0), "").otherwise(shown)


_BYTES = "(select id, case id % 5 when 0 then size % 1024 when 1 then size when 2 then size * 1000 when 3 then size * 1000000 else size // 100 end as b from v_files)"
_SHOWN = "case when b >= 1099511627776 then format('{:.2f} TB', round(b / 1099511627776.0::double, 2)) when b >= 1073741824 then format('{:.2f} GB', round(b / 1073741824.0::double, 2)) when b >= 1048576 then format('{:.2f} MB', round(b / 1048576.0::double, 2)) when b >= 1024 then format('{:.0f} KB', round(b / 1024.0::double)) else b || ' B' end"
register("P9_storage_size", lambda lib: lib.files.select("id", storage_size(F.expr("case id % 5 when 0 then size % 1024 when 1 then size when 2 then size * 1000 when 3 then size * 1000000 else size div 100 end")).alias("shown")), f"select id, {_SHOWN} shown from {_BYTES}")


@query(
    "P11_paired_video",
    """, pair as (select i.id, min(v.id) vid from v_base i join v_base v on i.content_id = v.content_id and i.album_id = v.album_id and i.live_photo_type = 1 and v.live_photo_type = 2 group by i.id)
    select b.id, case b.live_photo_type when 1 then v.file_path when 4 then b.file_path end video from v_base b left join pair p using (id) left join v_base v on v.id = p.vid""",
)
def paired_video(lib: Library) -> DataFrame:
    b = lib.base
    video = b.where("live_photo_type = 2").groupBy("content_id", "album_id").agg(F.min_by("file_path", "id").alias("path"))
    joined = b.join(video, ["content_id", "album_id"], "left")
    return joined.select("id", F.when(F.col("live_photo_type") == 1, F.col("path")).when(F.col("live_photo_type") == 4, F.col("file_path")).alias("video"))


# ---- sorts, pages, positions

SORTS = [["taken_date"], ["created_at"], ["modified_at"], ["name_key"], ["size"], ["width", "height"], ["duration"], ["rating"]]


def natural_key(c) -> F.Column:
    """Every run of digits padded to ten, so that names sort by their numbers."""
    runs = F.regexp_extract_all(c, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(r, F.greatest(F.lit(10), F.length(r)), F.lit("0"))).otherwise(r)), "")


def ordering(code: int, descending: bool = False) -> list[F.Column]:
    """Sort columns of a code, the id last in the same direction; 8 is a seeded shuffle, 9 and others the id or the taken date."""
    if code == 8:
        return [F.md5(F.concat(F.col("id").cast("string"), F.lit(":42"))), F.col("id")]
    if code == 9:
        return [F.col("id").asc()]
    columns = [*(SORTS[code] if code < len(SORTS) else SORTS[0]), "id"]
    return [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in columns]


_NATURAL = "list_aggregate(list_transform(regexp_extract_all(name, '[0-9]+|[^0-9]+'), lambda r: case when regexp_matches(r, '^[0-9]') then lpad(r, cast(greatest(10, length(r)) as int), '0') else r end), 'string_agg', '')"
for _code, _cols in enumerate(SORTS):
    _sorted = ", ".join(f"{c} desc nulls last" for c in [*_cols, "id"])
    register(
        f"O1_O3_page_sort{_code}",
        lambda lib, code=_code: search(lib, Params()).withColumn("name_key", natural_key(F.col("name"))).orderBy(*ordering(code, True)).offset(20).limit(50).select("id"),
        f"select id from (select *, {_NATURAL} name_key from v_visible) order by {_sorted} limit 50 offset 20",
    )
register("O1_sort8_shuffle", lambda lib: search(lib, Params()).orderBy(*ordering(8)).limit(50).select("id"), "select id from v_visible order by md5(id || ':42'), id limit 50")
register("O10_natural_key", lambda lib: lib.files.select("id", natural_key(F.col("name")).alias("name_key")), f"select id, {_NATURAL} name_key from v_files")
register("O12_auto_cover", lambda lib: lib.visible(lib.base).where("has_thumbnail = 1 and taken_date is not null").groupBy("album_id").agg(F.min_by("id", F.struct("taken_date", "id")).alias("cover")), "select album_id, arg_min(id, (taken_date, id)) cover from v_visible where has_thumbnail = 1 and taken_date is not null group by album_id")
register("O11_best_face", lambda lib: lib.faces.where("person_id is not null").groupBy("person_id").agg(F.max(F.struct((F.col("w") * F.col("h")).alias("area"), (-F.col("file_id")).alias("less"))).alias("best")).select("person_id", F.col("best.area").alias("area"), (-F.col("best.less")).alias("face_file")), "select person_id, max(w * h) area, arg_max(file_id, (w * h, -file_id)) face_file from v_faces where person_id is not null group by 1")


@query("W1_file_position", "select pos from (select id, row_number() over (order by taken_date desc nulls last, id desc) - 1 pos from v_visible) where id = 101")
def file_position(lib: Library, file_id: int = 101) -> DataFrame:
    """The place of a file by taken date, newest first: files that sort before it are counted, nothing is sorted."""
    rows = search(lib, Params()).select("id", "taken_date")
    me = rows.where(F.col("id") == file_id).select(F.col("id").alias("i"), F.col("taken_date").alias("t"))
    before = (F.col("taken_date") > F.col("t")) | (F.col("taken_date").isNotNull() & F.col("t").isNull()) | (F.col("taken_date").eqNullSafe(F.col("t")) & (F.col("id") > F.col("i")))
    # The one row is broadcast; ids are unique, so the limit drops none.
    return rows.join(F.broadcast(me.limit(1)), before | (F.col("id") == F.col("i"))).groupBy("i").agg((F.count("*") - 1).alias("pos")).select("pos")


@query(
    "W2_timeline",
    f"""select cast(year(make_timestamp(taken_date * 1000000)) as int) y, cast(month(make_timestamp(taken_date * 1000000)) as int) m, {DAY.format('taken_date')} d, min(pos) pos
    from (select *, row_number() over (order by taken_date desc nulls last, id) - 1 pos from v_visible) where taken_date is not null group by 1, 2, 3""",
)
def timeline(lib: Library) -> DataFrame:
    """The first position of every day, newest first: counts by day and a running sum over the days."""
    days = search(lib, Params()).where("taken_date is not null").groupBy(day("taken_date").alias("on")).agg(F.count("*").alias("n"))
    before = Window.orderBy(F.col("on").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return days.select(F.year("on").alias("y"), F.month("on").alias("m"), F.date_format("on", "yyyy-MM-dd").alias("d"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("pos"))


# ---- joins

register("J1_left_joins", lambda lib: lib.base.groupBy("album_name").agg(F.count("*").alias("n")), "select album_name, count(*) n from v_base group by 1")
register("J2_files_tags", lambda lib: lib.files.join(lib.file_tags, F.col("id") == F.col("file_id")).groupBy("tag_id").agg(F.count("*").alias("n")), "select tag_id, count(*) n from v_files join v_file_tags on id = file_id group by 1")
register("J3_files_faces", lambda lib: lib.files.join(lib.faces.where("person_id is not null"), F.col("id") == F.col("file_id")).groupBy("person_id").agg(F.countDistinct("id").alias("n")), "select person_id, count(distinct id) n from v_files join v_faces on id = file_id where person_id is not null group by 1")
register("J4_excluded_folders", lambda lib: lib.hidden_folders, "select f.id folder_id from v_folders f where exists (select 1 from v_folders e where e.album_id = f.album_id and e.is_excluded_from_search and (f.path = e.path or starts_with(f.path, e.path || '/')))")


@query("J5_folder_flags", "select id, is_favorite, (select count(*) from v_files a where a.folder_id = f.id) n_files, exists (select 1 from v_folders e where e.album_id = f.album_id and e.is_excluded_from_search and (f.path = e.path or starts_with(f.path, e.path || '/'))) hidden from v_folders f")
def folder_flags(lib: Library) -> DataFrame:
    n = lib.files.groupBy(F.col("folder_id").alias("id")).agg(F.count("*").alias("n_files"))
    hidden = lib.hidden_folders.select(F.col("folder_id").alias("id"), F.lit(True).alias("hidden"))
    return lib.folders.select("id", "is_favorite").join(n, "id", "left").join(hidden, "id", "left").fillna(0, ["n_files"]).fillna(False, ["hidden"])


register("J7_collection_members", lambda lib: lib.visible(lib.base).join(lib.collections.where("collection_id = 2"), F.col("id") == F.col("file_id")).select("id", "added_at"), "select id, added_at from v_visible join v_collections on id = file_id where collection_id = 2")


def _first_wins(pairs: DataFrame) -> DataFrame:
    """Each image takes its first video and each video its first image, independently."""
    images = pairs.groupBy(F.col("image").alias("id")).agg(F.min("video").alias("paired"))
    videos = pairs.groupBy(F.col("video").alias("id")).agg(F.min("image").alias("paired"))
    return images.unionByName(videos)


def content_pairs(lib: Library) -> DataFrame:
    b = lib.base.where("content_id is not null").select("id", "content_id", "album_id", "live_photo_type")
    i = b.where("live_photo_type = 1").select("content_id", "album_id", F.col("id").alias("image"))
    v = b.where("live_photo_type = 2").select("content_id", "album_id", F.col("id").alias("video"))
    return i.join(v, ["content_id", "album_id"]).select("image", "video")


_CONTENT = "select i.id image, v.id video from v_base i join v_base v on i.content_id = v.content_id and i.album_id = v.album_id and i.live_photo_type = 1 and v.live_photo_type = 2"
_WINS = "select image id, min(video) paired from p group by 1 union all select video, min(image) from p group by 1"
register("J8_pair_by_content", content_pairs, _CONTENT)
register("W5_first_wins", lambda lib: _first_wins(content_pairs(lib)), f", p as ({_CONTENT}) {_WINS}")


_STEMS = ", s as (select id, folder_id, file_type, case when file_type = 2 then 'IMG_' || ((id - 1) // 8 * 8) || '.mp4' else name end as name from v_files), t as (select *, regexp_replace(name, '\\.[^./]*$', '') stem from s), p as (select i.id image, v.id video from t i join t v on i.folder_id = v.folder_id and i.stem = v.stem and i.file_type in (1, 3) and v.file_type = 2) "


@query("J9_pair_by_stem", _STEMS + _WINS)
def stem_pairs(lib: Library) -> DataFrame:
    """Pairing by folder and stem. The videos are renamed here to the stem of an image of their eight, as a camera names both."""
    renamed = F.when(F.col("file_type") == 2, F.concat(F.lit("IMG_"), (F.floor((F.col("id") - 1) / 8) * 8).cast("string"), F.lit(".mp4"))).otherwise(F.col("name"))
    s = lib.files.select("id", "folder_id", "file_type", file_stem(renamed).alias("stem"))
    i = s.where("file_type in (1, 3)").select("folder_id", "stem", F.col("id").alias("image"))
    v = s.where("file_type = 2").select("folder_id", "stem", F.col("id").alias("video"))
    return _first_wins(i.join(v, ["folder_id", "stem"]).select("image", "video"))


register("J17_face_names", lambda lib: lib.faces.join(lib.persons.withColumnRenamed("id", "person_id"), "person_id", "left").groupBy("name").agg(F.count("*").alias("n")), "select name, count(*) n from v_faces left join v_persons on person_id = id group by 1")
register("J22_tags_of_file", lambda lib: lib.file_tags.join(lib.tags, F.col("tag_id") == F.col("id")).select("file_id", "name").orderBy("file_id", "name"), "select file_id, name from v_file_tags join v_tags on tag_id = id order by file_id, name")
register("J19_id_set", lambda lib: lib.file_tags.join(lib.files.where("rating = 4").select(F.col("id").alias("file_id")), "file_id", "left_semi").groupBy("tag_id").agg(F.count("*").alias("n")), "select tag_id, count(*) n from v_file_tags where file_id in (select id from v_files where rating = 4) group by 1")


def with_doubles(lib: Library) -> DataFrame:
    """(id, folder_id, name, album_id) of the files as an old library has them: some names twice or three times in a folder, some missing."""
    f = lib.base.select("id", "folder_id", "name", "album_id")
    again = [f.where(F.col("id") % m == 0).withColumn("id", F.col("id") + by) for m, by in ((7, 10**7), (21, 2 * 10**7))]
    every = f.unionByName(again[0]).unionByName(again[1])
    return every.withColumn("name", F.when(F.col("id") % 50 != 3, F.col("name")))


def losers(rows: DataFrame) -> DataFrame:
    """(old_id, new_id): of rows (id, folder_id, name) with one folder and name the greatest id wins; a null name is a name like others.

    Winners combine before the shuffle, and each loser meets one of them.
    """
    key = ["folder_id", "name"]
    winners = rows.groupBy(*key).agg(F.max("id").alias("new_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = [rows[k].eqNullSafe(winners[k]) for k in key]
    return rows.join(winners, same).where("id <> new_id").select(F.col("id").alias("old_id"), "new_id")


DOUBLES = ", f0 as (select id, folder_id, name, album_id from v_base), f1 as (select * from f0 union all select id + 10000000, folder_id, name, album_id from f0 where id % 7 = 0 union all select id + 20000000, folder_id, name, album_id from f0 where id % 21 = 0), f as (select id, folder_id, case when id % 50 <> 3 then name end as name, album_id from f1), w as (select id old_id, max(id) over (partition by folder_id, name) new_id, album_id from f) "
register("J21_remap_losers", lambda lib: losers(with_doubles(lib)), DOUBLES + "select old_id, new_id from w where old_id <> new_id")


register("U1_scope_intersection", lambda lib: lib.hashes.join(lib.visible(lib.base).select(F.col("id").alias("file_id")), "file_id", "left_semi").select("file_id", "hash"), "select file_id, hash from v_hashes where file_id in (select id from v_visible)")
register("U4_deleted_rows", lambda lib: lib.files.join(lib.thumbs.select(F.col("file_id").alias("id")), "id", "left_anti").select("id"), "select id from v_files where id not in (select file_id from v_thumbs)")
register("U3_distinct_first", lambda lib: lib.faces.where("person_id is not null").groupBy("person_id").agg(F.min("file_id").alias("first_file")), "select person_id, min(file_id) first_file from v_faces where person_id is not null group by 1")


@query("F18_F7_calendar_floor", f"select id from v_visible where {DATE_COLUMNS[0]} is not null and {DATE_COLUMNS[0]} >= 86400")
def dated(lib: Library) -> DataFrame:
    return search(lib, Params()).where("taken_date is not null and taken_date >= 86400").select("id")


@query("F19_folder_search", "select distinct f.album_id, f.path from v_folders f where exists (select 1 from v_folders m where m.album_id = f.album_id and contains(lower(m.name), 'in') and (m.path = f.path or starts_with(m.path, f.path || '/')))")
def folder_search(lib: Library) -> DataFrame:
    """Folders whose name holds the text, and the ancestors that lead to them."""
    hits = lib.folders.where(F.lower("name").contains("in"))
    parts = F.split("path", "/")
    above = hits.select("album_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path")).distinct()
    return lib.folders.join(above, ["album_id", "path"], "left_semi").select("album_id", "path").distinct()


def walked(lib: Library, root: str) -> DataFrame:
    """Files at any depth under a folder, without hidden files and without what lies in hidden folders, in the order of paths."""
    below = lib.base.where(F.col("file_path").startswith(f"{root}/"))
    inner = F.substring("file_path", F.lit(len(root) + 1), F.length("file_path"))
    return below.where(~inner.contains("/.")).orderBy("file_path")


def listed_in(lib: Library, folder: str, code: int, descending: bool) -> DataFrame:
    """Files directly in a folder, in one of the library's orders."""
    return lib.base.where((F.col("folder_path") == folder) & ~F.col("name").startswith(".")).orderBy(*ordering(code, descending))


register("S3_walk_library", lambda lib: walked(lib, "/lib/ASIA").select("file_path", "file_type", "size"), "select file_path, file_type, size from v_base where starts_with(file_path, '/lib/ASIA/') and not contains(substr(file_path, 10), '/.') order by file_path")
register("S4_list_folder", lambda lib: listed_in(lib, "/lib/ASIA/NATION_12/BUILDING", 4, True).select("name", "file_type", "size"), "select name, file_type, size from v_base where folder_path = '/lib/ASIA/NATION_12/BUILDING' and not starts_with(name, '.') order by size desc, id desc")
