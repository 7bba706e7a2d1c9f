"""Facets: calendar, cameras, lenses, places, heatmap, tags, people, ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspan.operators.library import DAY
from mediaspan.plans.catalog import Library
from mediaspan.plans.predicates import Params, search
from mediaspan.plans.registry import query, register


def calendar(lib: Library) -> DataFrame:
    dated = search(lib, Params()).where("taken_date >= 86400")
    return dated.groupBy(F.date_format(F.timestamp_seconds("taken_date"), "yyyy-MM-dd").alias("d")).agg(F.count("*").alias("n"))


_CALENDAR = f"select {DAY.format('taken_date')} d, count(*) n from v_visible where taken_date >= 86400 group by 1"
register("A3_calendar_days", lambda lib: calendar(lib).orderBy("d"), _CALENDAR)


@query("A4_calendar_nest", f"select substr(d, 1, 4) y, substr(d, 6, 2) m, string_agg(d || ':' || n, ',' order by d) per_day from ({_CALENDAR}) group by 1, 2")
def calendar_nest(lib: Library) -> DataFrame:
    days = calendar(lib).groupBy(F.substring("d", 1, 4).alias("y"), F.substring("d", 6, 2).alias("m"))
    return days.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "d", F.col("n").cast("string")))), ",").alias("per_day"))


def nested(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """(label, total, inner values by count then label), two levels of grouping."""
    counts = df.where(F.col(outer).isNotNull() & (F.trim(outer) != "")).groupBy(F.upper(outer).alias("label"), F.col(inner).alias("inner")).agg(F.count("*").alias("n"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "inner"))), lambda s: F.concat_ws(":", s["inner"], (-s["less"]).cast("string")))
    return counts.groupBy("label").agg(F.sum("n").alias("total"), F.array_join(packed, ",").alias("models"))


def _nested_sql(outer: str, inner: str) -> str:
    return f"select label, cast(sum(n) as bigint) total, string_agg(i || ':' || n, ',' order by n desc, i) models from (select upper({outer}) as label, {inner} i, count(*) n from v_files where trim({outer}) <> '' group by 1, 2) group by label"


register("A5_camera_facet", lambda lib: nested(lib.files, "e_make", "e_model"), _nested_sql("e_make", "e_model"))
register("A6_lens_facet", lambda lib: nested(lib.files, "e_lens_make", "e_lens_model"), _nested_sql("e_lens_make", "e_lens_model"))
register("A7_location_facet", lambda lib: nested(lib.files.withColumn("place", F.concat_ws("/", "geo_cc", "geo_admin1")).where("geo_cc is not null"), "place", "geo_name"), _nested_sql("(geo_cc || '/' || geo_admin1)", "geo_name"))
for _code, _order in enumerate(("label", "label desc", "total, label", "total desc, label")):
    register(
        f"A9_facet_sort{_code}",
        lambda lib, code=_code: nested(lib.files, "e_make", "e_model").orderBy(*([F.col("label").asc()], [F.col("label").desc()], [F.col("total").asc(), F.col("label").asc()], [F.col("total").desc(), F.col("label").asc()])[code]).select("label", "total"),
        f"select label, total from ({_nested_sql('e_make', 'e_model')}) order by {_order}",
    )


def _mean(degrees: F.Column) -> F.Column:
    """The mean in millionths of a degree, halves up: whole numbers are added, so it is the same in any order."""
    total = F.sum(F.round((degrees + 360) * 10000000).cast("long"))
    return (F.floor((2 * total + 10 * F.count("*")) / (20 * F.count("*")).cast("decimal(20,0)")).cast("long") - 360000000) / 1000000.0


@query("A8_gps_heatmap", "select round(gps_latitude, 2) cell_lat, round(gps_longitude, 2) cell_lon, (cast(2 * sum(cast(round((gps_latitude + 360) * 10000000) as bigint)) + 10 * count(*) as bigint) // (20 * count(*)) - 360000000) / 1000000::double lat, (cast(2 * sum(cast(round((gps_longitude + 360) * 10000000) as bigint)) + 10 * count(*) as bigint) // (20 * count(*)) - 360000000) / 1000000::double lon, count(*) n from v_files where gps_latitude is not null and gps_longitude is not null group by 1, 2")
def heatmap(lib: Library) -> DataFrame:
    """Files by cells of a hundredth of a degree, with the mean place of each."""
    lat, lon = F.col("gps_latitude"), F.col("gps_longitude")
    cells = lib.files.where(lat.isNotNull() & lon.isNotNull()).groupBy(F.round(lat, 2).alias("cell_lat"), F.round(lon, 2).alias("cell_lon"))
    return cells.agg(_mean(lat).alias("lat"), _mean(lon).alias("lon"), F.count("*").alias("n"))


def _counted(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents with the number of their children, zero included; children combine before the join."""
    n = children.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"))
    return parents.join(n, "id", "left").fillna(0, ["n"]).select("id", "name", "n")


register("A10_J18_tag_usage", lambda lib: _counted(lib.tags, lib.file_tags.join(lib.files.select(F.col("id").alias("file_id")), "file_id", "left_semi"), "tag_id").orderBy(F.desc("n"), "name"), "select t.id, name, (select count(*) from v_file_tags ft join v_files a on a.id = ft.file_id where ft.tag_id = t.id) n from v_tags t")
register("A11_tags_in_selection", lambda lib: lib.file_tags.join(search(lib, Params(rating=4)).select(F.col("id").alias("file_id")), "file_id", "left_semi").groupBy("tag_id").agg(F.count("*").alias("n")), "select tag_id, count(*) n from v_file_tags where file_id in (select id from v_visible where rating = 4) group by 1")
register("A12_person_faces", lambda lib: _counted(lib.persons, lib.faces, "person_id"), "select p.id, name, count(f.file_id) n from v_persons p left join v_faces f on f.person_id = p.id group by 1, 2")


@query("A13_face_stats", "select count(*) filter (where file_type = 1) total, count(*) filter (where file_type = 1 and has_faces > 0) processed, count(*) filter (where file_type = 1 and has_faces = 0) unprocessed, (select count(*) from v_faces) faces from v_files")
def face_stats(lib: Library) -> DataFrame:
    image, seen = F.col("file_type") == 1, F.coalesce("has_faces", F.lit(0)) > 0
    files = lib.files.agg(F.count_if(image).alias("total"), F.count_if(image & seen).alias("processed"), F.count_if(image & ~seen).alias("unprocessed"))
    return files.join(lib.faces.agg(F.count("*").alias("faces")))


register("A14_folder_thumbnails", lambda lib: lib.base.where("has_thumbnail = 1").groupBy("folder_id").agg(F.count("*").alias("n")), "select folder_id, count(*) n from v_base where has_thumbnail = 1 group by 1")
register("A15_album_recount", lambda lib: lib.shown(lib.base).groupBy("album_id").agg(F.count("*").alias("n"), F.least(F.count("*"), F.count_if(F.col("has_embedding") == 1)).alias("indexed")), "select album_id, count(*) n, least(count(*), count(*) filter (where has_embedding = 1)) indexed from v_shown group by 1")
register("A16_favorite_folders", lambda lib: _counted(lib.folders.where("is_favorite").select("id", "name"), lib.files, "folder_id"), "select id, name, (select count(*) from v_files a where a.folder_id = f.id) n from v_folders f where is_favorite")


@query("A21_rating_buckets", "select count(*) filter (where is_favorite) favorites, count(*) filter (where coalesce(rating, 0) = 0) r0, count(*) filter (where rating = 1) r1, count(*) filter (where rating = 2) r2, count(*) filter (where rating = 3) r3, count(*) filter (where rating = 4) r4, count(*) filter (where rating = 5) r5 from v_visible")
def rating_buckets(lib: Library) -> DataFrame:
    return search(lib, Params()).agg(F.count_if(F.coalesce("is_favorite", F.lit(False))).alias("favorites"), *[F.count_if(F.coalesce("rating", F.lit(0)) == r).alias(f"r{r}") for r in range(6)])


@query("A22_collections", "select collection_id, count(*) n, cast(sum(size) as bigint) total_size from v_files join v_collections on id = file_id where coalesce(live_photo_type, 0) <> 2 group by 1")
def collection_counts(lib: Library) -> DataFrame:
    members = lib.files.where(F.coalesce("live_photo_type", F.lit(0)) != 2).join(lib.collections, F.col("id") == F.col("file_id"))
    return members.groupBy("collection_id").agg(F.count("*").alias("n"), F.sum("size").alias("total_size"))


register("O9_collection_order", lambda lib: lib.collections.orderBy("collection_id", F.desc("added_at"), F.desc("file_id")).select("collection_id", "file_id"), "select collection_id, file_id from v_collections order by collection_id, added_at desc, file_id desc")
register("A26_next_person", lambda lib: lib.persons.agg((F.max(F.regexp_extract("name", "([0-9]+)$", 1).try_cast("long")) + 1).alias("next_number")), "select max(try_cast(regexp_extract(name, '([0-9]+)$', 1) as bigint)) + 1 next_number from v_persons")
register("A25_cluster_sizes", lambda lib: lib.faces.where("person_id is not null").groupBy("person_id").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files")), "select person_id, count(*) n, count(distinct file_id) files from v_faces where person_id is not null group by 1")
