"""The media library as lazy views over the given tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper and lower letters that compare alike: ASCII only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of order lines that a task takes where partitions are dealt by their number.
ROWS_A_TASK = 500_000
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def fold(c: Column) -> Column:
    """Case-folded in ASCII."""
    return F.translate(c, UPPER, LOWER)


class Library:
    """Views of one library; nothing runs until a result is asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def deals(self) -> int:
        """Partitions to deal order lines to, so that a task takes about as many at any size. Counts them, which reads the files' footers."""
        return max(1, -(-self.table("lineitem").count() // ROWS_A_TASK))

    @cached_property
    def albums(self) -> DataFrame:
        return self.table("region").select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.col("r_name").alias("name"), F.concat(F.lit("/lib/"), "r_name").alias("path"), (F.lit(5) - F.col("r_regionkey")).cast("long").alias("display_order_id"))

    @cached_property
    def folders(self) -> DataFrame:
        n = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        path = F.concat(F.lit("/lib/"), "r_name", F.lit("/"), "n_name")
        key = F.col("n_nationkey")
        base = [(F.col("n_regionkey") + 1).cast("long").alias("album_id")]
        top = n.select((1000 + key * 10).cast("long").alias("id"), *base, F.col("n_name").alias("name"), path.alias("path"), (key % 5 == 0).alias("is_favorite"), (key % 7 == 0).alias("is_excluded_from_search"))
        seg = n.select("*", F.posexplode(F.array(*map(F.lit, SEGMENTS))).alias("k", "segment"))
        below = seg.select((1001 + key * 10 + F.col("k")).cast("long").alias("id"), *base, F.col("segment").alias("name"), F.concat(path, F.lit("/"), "segment").alias("path"), F.lit(False).alias("is_favorite"), ((key == 3) & (F.col("k") == 1)).alias("is_excluded_from_search"))
        return top.unionByName(below)

    @cached_property
    def files(self) -> DataFrame:
        o = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        k, cust = F.col("o_orderkey"), F.col("o_custkey")
        day = F.unix_timestamp("o_orderdate")
        segment = F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment")) - 1
        m = k % 8
        kind = F.when(m == 6, 2).when(m == 7, 3).otherwise(1)
        located = k % 5 != 0
        make = F.element_at(F.array(F.lit("Canon"), F.lit("CANON"), F.lit("NIKON"), F.lit("sony"), F.lit(None).cast("string")), (cust % 5 + 1).cast("int"))
        return o.select(
            (k + 1).alias("id"),
            (1001 + F.col("c_nationkey") * 10 + segment).cast("long").alias("folder_id"),
            F.concat(F.lit("IMG_"), k.cast("string"), F.when(m == 6, ".mp4").when(m == 7, ".cr2").when(m == 1, ".PNG").otherwise(".jpg")).alias("name"),
            F.round(F.col("o_totalprice") * 100).cast("long").alias("size"),
            kind.alias("file_type"),
            (day + k % 86400).alias("created_at"),
            (day + 86400 * (k % 30)).alias("modified_at"),
            F.when(k % 11 != 0, day + (k * 37) % 86400).alias("taken_date"),
            (640 + (k * 7) % 4000).alias("width"),
            (480 + (k * 13) % 4000).alias("height"),
            F.when(m == 6, (k * 3) % 600).otherwise(0).alias("duration"),
            F.when(k % 13 != 0, F.col("o_orderstatus") == "F").alias("is_favorite"),
            (F.substring("o_orderpriority", 1, 1).cast("int") % 5).alias("rating"),
            make.alias("e_make"),
            F.when(make.isNotNull(), F.concat(F.lit("M"), (cust % 13).cast("string"))).alias("e_model"),
            F.when(make.isNotNull() & (cust % 3 > 0), F.when(cust % 3 == 1, "Sigma").otherwise("TAMRON")).alias("e_lens_make"),
            F.when(make.isNotNull() & (cust % 3 > 0), F.concat(F.lit("L"), (cust % 7).cast("string"))).alias("e_lens_model"),
            F.when(located, (cust % 60).cast("double") * 3 - 90 + (k % 7).cast("double") * 0.0007).alias("gps_latitude"),
            F.when(located, ((k * 131) % 36).cast("double") * 10 - 180 + (k % 5).cast("double") * 0.0007).alias("gps_longitude"),
            F.when(located, F.concat(F.lit("C"), (F.col("c_nationkey") % 4).cast("string"))).alias("geo_cc"),
            F.when(located, F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("geo_admin1"),
            F.when(located, F.col("c_mktsegment")).alias("geo_name"),
            F.when(k % 17 == 0, 1).when(k % 17 == 1, 2).when(k % 17 == 2, 3).otherwise(0).alias("live_photo_type"),
            F.when(k % 17 < 2, F.concat(F.lit("C"), F.floor(k / 17).cast("string"))).alias("content_id"),
            (k % 3).cast("int").alias("has_faces"),
            F.element_at(F.array(*map(F.lit, (0, 90, 180, 270))), (k % 4 + 1).cast("int")).alias("rotate"),
            ((k % 2) * 1000).alias("last_scan_time"),
        )

    @cached_property
    def thumbs(self) -> DataFrame:
        """Files with a thumbnail: those whose id is not divisible by 4."""
        return self.table("orders").select((F.col("o_orderkey") + 1).alias("file_id")).where("file_id % 4 <> 0")

    @cached_property
    def tags(self) -> DataFrame:
        return self.table("part").select(F.expr("substring(p_brand, 7)").cast("long").alias("id"), F.col("p_brand").alias("name")).distinct()

    @cached_property
    def file_tags(self) -> DataFrame:
        li = self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        return li.select((F.col("l_orderkey") + 1).alias("file_id"), F.expr("substring(p_brand, 7)").cast("long").alias("tag_id")).distinct()

    @cached_property
    def persons(self) -> DataFrame:
        return self.table("supplier").select((F.col("s_suppkey") + 1).alias("id"), F.col("s_name").alias("name"))

    @cached_property
    def faces(self) -> DataFrame:
        return self.table("lineitem").select((F.col("l_orderkey") + 1).alias("file_id"), F.when(F.col("l_linenumber") != 7, F.col("l_suppkey") + 1).alias("person_id"), F.col("l_quantity").alias("w"), F.col("l_linenumber").cast("double").alias("h"))

    @cached_property
    def collections(self) -> DataFrame:
        """(collection_id, file_id, added_at): files whose id leaves 1 to 5 modulo 50."""
        f = self.files.select(F.col("id").alias("file_id"), F.col("created_at").alias("added_at"))
        return f.where((F.col("file_id") % 50).between(1, 5)).select((F.col("file_id") % 50).alias("collection_id"), "file_id", "added_at")

    @cached_property
    def hashes(self) -> DataFrame:
        return self.table("documents").select((F.col("doc_id") + 1).alias("file_id"), F.md5("text").alias("hash"), F.col("n_chars").alias("file_size"))

    @cached_property
    def embeds(self) -> DataFrame:
        return self.table("embeddings").select((F.col("vec_id") + 1).alias("file_id"), "embedding", "label")

    @cached_property
    def hidden_folders(self) -> DataFrame:
        """(folder_id) of folders that are, or lie below, an excluded folder of the same album.

        Ancestor paths are exploded and met by an equi-join instead of a prefix scan.
        """
        parts = F.split("path", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        paths = self.folders.select("id", "album_id", F.explode(above).alias("path"))
        out = self.folders.where("is_excluded_from_search").select("album_id", "path")
        return paths.join(out, ["album_id", "path"]).select(F.col("id").alias("folder_id")).distinct()

    @cached_property
    def base(self) -> DataFrame:
        """Files with folder, album, has_thumbnail and has_embedding."""
        f = self.folders.select(F.col("id").alias("folder_id"), "album_id", F.col("path").alias("folder_path"), F.col("name").alias("folder_name"))
        a = self.albums.select(F.col("id").alias("album_id"), F.col("name").alias("album_name"))
        t = self.thumbs.select(F.col("file_id").alias("id"), F.lit(1).alias("has_thumbnail"))
        e = self.embeds.select(F.col("file_id").alias("id"), F.lit(1).alias("has_embedding")).distinct()
        joined = self.files.join(f, "folder_id", "left").join(a, "album_id", "left").join(t, "id", "left").join(e, "id", "left")
        return joined.fillna(0, ["has_thumbnail", "has_embedding"]).withColumn("file_path", F.concat_ws("/", "folder_path", "name"))

    def visible(self, df: DataFrame) -> DataFrame:
        """Without live companions and without files of hidden folders."""
        return self.shown(df.where(F.coalesce("live_photo_type", F.lit(0)) != 2))

    def shown(self, df: DataFrame) -> DataFrame:
        """Without files of hidden folders."""
        return df.join(self.hidden_folders, "folder_id", "left_anti")


PRELUDE = """
with v_albums as (select cast(r_regionkey + 1 as bigint) id, r_name as name, '/lib/' || r_name as path, cast(5 - r_regionkey as bigint) display_order_id from region),
v_seg as (select unnest([0, 1, 2, 3, 4]) k, unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) segment),
v_folders as (
    select cast(1000 + n_nationkey * 10 as bigint) id, cast(n_regionkey + 1 as bigint) album_id, n_name as name, '/lib/' || r_name || '/' || n_name as path, n_nationkey % 5 = 0 is_favorite, n_nationkey % 7 = 0 is_excluded_from_search
    from nation join region on n_regionkey = r_regionkey
    union all
    select cast(1001 + n_nationkey * 10 + k as bigint), cast(n_regionkey + 1 as bigint), segment, '/lib/' || r_name || '/' || n_name || '/' || segment, false, n_nationkey = 3 and k = 1
    from nation join region on n_regionkey = r_regionkey cross join v_seg),
v_files as (
    select o_orderkey + 1 id, cast(1001 + c_nationkey * 10 + k as bigint) folder_id,
        'IMG_' || o_orderkey || case o_orderkey % 8 when 6 then '.mp4' when 7 then '.cr2' when 1 then '.PNG' else '.jpg' end as name,
        cast(round(o_totalprice * 100) as bigint) size, case o_orderkey % 8 when 6 then 2 when 7 then 3 else 1 end file_type,
        cast(epoch(o_orderdate) as bigint) + o_orderkey % 86400 created_at, cast(epoch(o_orderdate) as bigint) + 86400 * (o_orderkey % 30) modified_at,
        case when o_orderkey % 11 <> 0 then cast(epoch(o_orderdate) as bigint) + (o_orderkey * 37) % 86400 end taken_date,
        640 + (o_orderkey * 7) % 4000 width, 480 + (o_orderkey * 13) % 4000 height, case o_orderkey % 8 when 6 then (o_orderkey * 3) % 600 else 0 end duration,
        case when o_orderkey % 13 <> 0 then o_orderstatus = 'F' end is_favorite, cast(substr(o_orderpriority, 1, 1) as int) % 5 rating,
        case o_custkey % 5 when 0 then 'Canon' when 1 then 'CANON' when 2 then 'NIKON' when 3 then 'sony' end e_make,
        case when o_custkey % 5 <> 4 then 'M' || (o_custkey % 13) end e_model,
        case when o_custkey % 5 <> 4 then case o_custkey % 3 when 1 then 'Sigma' when 2 then 'TAMRON' end end e_lens_make,
        case when o_custkey % 5 <> 4 and o_custkey % 3 > 0 then 'L' || (o_custkey % 7) end e_lens_model,
        case when o_orderkey % 5 <> 0 then cast(o_custkey % 60 as double) * 3 - 90 + cast(o_orderkey % 7 as double) * cast(0.0007 as double) end gps_latitude,
        case when o_orderkey % 5 <> 0 then cast((o_orderkey * 131) % 36 as double) * 10 - 180 + cast(o_orderkey % 5 as double) * cast(0.0007 as double) end gps_longitude,
        case when o_orderkey % 5 <> 0 then 'C' || (c_nationkey % 4) end geo_cc, case when o_orderkey % 5 <> 0 then 'N' || c_nationkey end geo_admin1, case when o_orderkey % 5 <> 0 then c_mktsegment end geo_name,
        case o_orderkey % 17 when 0 then 1 when 1 then 2 when 2 then 3 else 0 end live_photo_type,
        case when o_orderkey % 17 < 2 then 'C' || (o_orderkey // 17) end content_id, cast(o_orderkey % 3 as int) has_faces,
        cast(90 * (o_orderkey % 4) as int) rotate, (o_orderkey % 2) * 1000 last_scan_time
    from orders join customer on o_custkey = c_custkey join v_seg on segment = c_mktsegment),
v_thumbs as (select o_orderkey + 1 file_id from orders where (o_orderkey + 1) % 4 <> 0),
v_tags as (select distinct cast(substr(p_brand, 7) as bigint) id, p_brand as name from part),
v_file_tags as (select distinct l_orderkey + 1 file_id, cast(substr(p_brand, 7) as bigint) tag_id from lineitem join part on l_partkey = p_partkey),
v_persons as (select s_suppkey + 1 id, s_name as name from supplier),
v_faces as (select l_orderkey + 1 file_id, case when l_linenumber <> 7 then l_suppkey + 1 end person_id, l_quantity w, cast(l_linenumber as double) h from lineitem),
v_collections as (select id % 50 collection_id, id file_id, created_at added_at from v_files where id % 50 between 1 and 5),
v_hashes as (select doc_id + 1 file_id, md5(text) hash, n_chars file_size from documents),
v_embeds as (select vec_id + 1 file_id, embedding, label from embeddings),
v_base as (
    select a.*, f.album_id, f.path folder_path, f.name folder_name, al.name album_name,
        cast(exists (select 1 from v_thumbs t where t.file_id = a.id) as int) has_thumbnail, cast(exists (select 1 from v_embeds e where e.file_id = a.id) as int) has_embedding,
        f.path || '/' || a.name file_path
    from v_files a left join v_folders f on f.id = a.folder_id left join v_albums al on al.id = f.album_id),
v_shown as (select * from v_base b where not exists (select 1 from v_folders e where e.album_id = b.album_id and e.is_excluded_from_search and (b.folder_path = e.path or starts_with(b.folder_path, e.path || '/')))),
v_visible as (select * from v_shown where coalesce(live_photo_type, 0) <> 2)
"""
