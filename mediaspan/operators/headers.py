"""What headers of files tell: EXIF directories and damaged ones, and motion photos by their XMP packet.

The registered queries write such headers from the library's files and read
them back; the bytes are columns, so the work is a scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaspan.functions import exif, xmp
from mediaspan.plans.catalog import Library
from mediaspan.plans.registry import query


def _put(value: Column, size: int, little: Column) -> Column:
    """A whole number, not negative, as so many bytes. It is told byte by byte, so give a column or a literal."""
    v = value.cast("long")
    byte = lambda i: F.shiftright(v, 8 * i).bitwiseAND(F.lit(255))
    swapped = reduce(lambda x, y: x + y, (F.shiftleft(byte(i), 8 * (size - 1 - i)) for i in range(size)))
    bytes_of = lambda c: F.unhex(F.lpad(F.hex(c), 2 * size, "0"))
    return F.when(little, bytes_of(swapped)).otherwise(bytes_of(v))


def _text(value: Column) -> Column:
    return F.concat(F.encode(value, "UTF-8"), F.unhex(F.lit("00")))


def _directory(df: DataFrame, name: str, entries: list[tuple[int, int, Column, Column, Column]], start: Column, little: Column) -> DataFrame:
    """df with the bytes of a directory at an offset, and `{name}_end` where it ends: entries (tag, kind, n, value bytes, their number); what is longer than four bytes follows.

    Numbers and offsets are columns of their own, so that each is made once.
    """
    at = [f"{name}_at{i}" for i in range(len(entries) + 1)]
    df = df.withColumns({f"{name}_n{i}": n for i, (_, _, n, _, _) in enumerate(entries)} | {f"{name}_size{i}": size for i, (*_, size) in enumerate(entries)} | {at[0]: start + 2 + 12 * len(entries) + 4})
    long = [F.col(f"{name}_size{i}") > 4 for i in range(len(entries))]
    for i in range(len(entries)):
        df = df.withColumn(at[i + 1], F.col(at[i]) + F.when(long[i], F.col(f"{name}_size{i}")).otherwise(0))
    head, body = [_put(F.lit(len(entries)), 2, little)], []
    for i, (tag, kind, _, value, _) in enumerate(entries):
        inline = F.substring(F.concat(value, F.unhex(F.lit("00000000"))), 1, 4)
        head.append(F.concat(_put(F.lit(tag), 2, little), _put(F.lit(kind), 2, little), _put(F.col(f"{name}_n{i}"), 4, little), F.when(long[i], _put(F.col(at[i]), 4, little)).otherwise(inline)))
        body.append(F.when(long[i], value).otherwise(F.unhex(F.lit(""))))
    made = {name: F.concat(*head, F.unhex(F.lit("00000000")), *body), f"{name}_end": F.col(at[-1])}
    return df.withColumns(made).drop(*at, *(f"{name}_{kind}{i}" for kind in ("n", "size") for i in range(len(entries))))


def _sizes(entries: list[tuple[int, int, Column, Column, Column]]) -> Column:
    """How long a directory of these entries is."""
    return reduce(lambda x, y: x + y, (F.when(size > 4, size).otherwise(0) for *_, size in entries), F.lit(2 + 12 * len(entries) + 4))


def exif_headers(lib: Library) -> DataFrame:
    """(id, content): a header of every file, little-endian for odd ids; every tenth is cut off within its first directory.

    Rows are dealt to all tasks first: a header costs much more than the row
    that it comes from, and a small table is one split.
    """
    little = F.col("id") % 2 == 1
    text = lambda tag, column: (tag, 2, F.octet_length(column) + 1, _text(F.col(column)), F.octet_length(column) + 1)
    known = lambda c: F.coalesce(F.col(c), F.lit(" "))
    ref = lambda column, minus, plus: F.when(F.col(column) < 0, minus).otherwise(plus)
    hundredths = lambda column: F.round(F.abs(F.col(column)) * 360000).cast("long")
    f = lib.files.repartition("id").select(
        "id", "name", F.date_format(F.timestamp_seconds("created_at"), "yyyy:MM:dd HH:mm:ss").alias("taken"), *[known(c).alias(c) for c in ("e_make", "e_model", "e_lens_make", "e_lens_model")],
        ref("gps_latitude", "S", "N").alias("lat_ref"), ref("gps_longitude", "W", "E").alias("lon_ref"), hundredths("gps_latitude").alias("lat"), hundredths("gps_longitude").alias("lon"), (F.col("id") % 8 + 1).alias("turned"),
    )
    parts = {f"{c}{i}": part.cast("long") for c in ("lat", "lon") for i, part in enumerate((F.floor(F.col(c) / 360000), F.floor(F.col(c) % 360000 / 6000), F.col(c) % 6000))}
    angle = lambda c: F.coalesce(F.concat(*[_put(x, 4, little) for i, under in enumerate((1, 1, 100)) for x in (F.col(f"{c}{i}"), F.lit(under))]), F.unhex(F.lit("00" * 24)))
    place = [text(1, "lat_ref"), (2, 5, F.lit(3), angle("lat"), F.lit(24)), text(3, "lon_ref"), (4, 5, F.lit(3), angle("lon"), F.lit(24))]
    detail = [text(exif.ORIGINAL, "taken"), text(exif.LENS_MAKE, "e_lens_make"), text(exif.LENS_MODEL, "e_lens_model")]
    pointer = lambda tag, at: (tag, 4, F.lit(1), _put(F.col(at), 4, little), F.lit(4))
    main = [text(exif.MAKE, "e_make"), text(exif.MODEL, "e_model"), (exif.ORIENTATION, 3, F.lit(1), _put(F.col("turned"), 2, little), F.lit(2)), text(exif.SOFTWARE, "name"), pointer(exif.EXIF_AT, "main_size"), pointer(exif.GPS_AT, "detail_end")]
    sized = f.withColumns(parts).withColumn("main_size", F.lit(8) + _sizes(main))
    sized = _directory(sized, "detail", detail, F.col("main_size"), little)
    sized = _directory(sized, "place", place, F.col("detail_end"), little)
    sized = _directory(sized, "main", main, F.lit(8), little)
    mark = F.when(little, F.unhex(F.lit(exif.LITTLE_MARK))).otherwise(F.unhex(F.lit(exif.BIG_MARK)))
    whole = sized.select("id", F.concat(F.unhex(F.lit("FFD8FFE1")), F.encode(F.lit("Exif"), "UTF-8"), F.unhex(F.lit("0000")), mark, _put(F.lit(8), 4, little), "main", "detail", "place").alias("content"))
    return whole.select("id", F.when(F.col("id") % 10 == 0, F.substring("content", 1, 25)).otherwise(F.col("content")).alias("content"))


_ANGLE = "round(case when {t} is not null then (case when {c} < 0 then -1 else 1 end) * ({t} // 360000 + ({t} % 360000) // 6000 / 60.0::double + {t} % 6000 / 100.0::double / 3600.0::double) end, 7)"


@query(
    "P8_exif_directories",
    ", f as (select *, id % 10 = 0 cut, cast(round(abs(gps_latitude) * 360000) as bigint) la, cast(round(abs(gps_longitude) * 360000) as bigint) lo from v_files) "
    "select id, case when not cut then e_make end as make, case when not cut then e_model end as model, case when not cut then name end as software, case when not cut then cast(id % 8 + 1 as int) end as orientation, case when not cut then strftime(to_timestamp(created_at), '%Y:%m:%d %H:%M:%S') end as taken, case when not cut then e_lens_make end as lens_make, case when not cut then e_lens_model end as lens_model, "
    + ", ".join(f"case when not cut then {_ANGLE.format(t=t, c=c)} end as {name}" for t, c, name in (("la", "gps_latitude", "latitude"), ("lo", "gps_longitude", "longitude"))) + " from f",
)
def exif_directories(lib: Library) -> DataFrame:
    """Fields of written headers as they are read back; what is cut off is null."""
    read = exif_headers(lib).select("id", F.inline(F.array(exif.fields(F.col("content")))))  # evaluated once for all its columns
    return read.select("id", "make", "model", "software", "orientation", F.col("date_time_original").alias("taken"), "lens_make", "lens_model", F.round("latitude", 7).alias("latitude"), F.round("longitude", 7).alias("longitude"))


@query(
    "P8_exif_scan",
    ", f as (select *, id % 10 = 0 cut from v_files) select id, case when not cut then e_make end as make, case when not cut then e_model end as model, case when not cut then name end as software, case when not cut then strftime(to_timestamp(created_at), '%Y:%m:%d %H:%M:%S') end as taken, case when not cut then e_lens_make end as lens_make, case when not cut then e_lens_model end as lens_model, cast(id % 7 as int) turned from f",
)
def exif_scan(lib: Library) -> DataFrame:
    """The same without their directories: the count of entries is overwritten, and an entry of the maker follows the end."""
    content = F.col("content")
    broken = F.concat(F.substring(content, 1, 18), F.unhex(F.lit("FFFF")), F.substring(content, F.lit(21), F.octet_length(content)))
    little = F.col("id") % 2 == 1
    own = F.concat(_put(F.lit(exif.MAKER_ORIENTATION), 2, little), _put(F.lit(3), 2, little), _put(F.lit(1), 4, little), F.substring(F.concat(_put(F.col("id") % 7, 2, little), F.unhex(F.lit("0000"))), 1, 4))
    read = exif_headers(lib).select("id", F.concat(broken, F.unhex(F.lit("00")), own).alias("content")).select("id", F.inline(F.array(exif.scanned(F.col("content")))))
    return read.select("id", "make", "model", "software", F.col("date_time_original").alias("taken"), "lens_make", "lens_model", F.col("maker_orientation").alias("turned"))


def xmp_headers(lib: Library) -> DataFrame:
    """(id, content): every file with a packet of one of eight forms between other bytes."""
    m, size, name = F.col("id") % 8, F.col("size").cast("string"), F.regexp_replace("name", "[^A-Za-z0-9.]", "")
    item = lambda kind, *more: F.concat(F.lit(f'<rdf:li rdf:parseType="Resource"><Container:Item Item:Mime="image/jpeg" Item:Semantic="{kind}"'), *more, F.lit("/></rdf:li>"))
    length = lambda c: F.concat(F.lit(' Item:Length="'), c, F.lit('" Item:Padding="8"'))
    listed = lambda *items: F.concat(F.lit("<Container:Directory><rdf:Seq>"), *items, F.lit("</rdf:Seq></Container:Directory>"))
    flag = F.lit("<GCamera:MotionPhoto>1</GCamera:MotionPhoto>")
    body = (
        F.when(m == 0, F.concat(flag, F.lit("<GCamera:MotionPhotoOffset> "), size, F.lit("\n</GCamera:MotionPhotoOffset>")))
        .when(m == 1, F.concat(F.lit("<rdf:Description GCamera:MotionPhoto='1' GCamera:MotionPhotoOffset='"), size, F.lit("' />")))
        .when(m == 2, F.concat(flag, listed(item("Primary", length(size)), item("MotionPhoto", length(F.length(name).cast("string"))))))
        .when(m == 3, F.concat(flag, listed(item("Primary"), item("MotionPhoto")), item("Primary", length(F.lit("5")))))
        .when(m == 4, F.concat(flag, listed(item("Primary", length(size)))))
        .when(m == 5, F.concat(F.lit("<dc:title>"), name, F.lit("</dc:title>")))
        .when(m == 6, F.concat(flag, F.lit("<GCamera:OtherMotionPhotoOffset>1</GCamera:OtherMotionPhotoOffset><broken <GCamera:MotionPhotoOffset>x</GCamera:MotionPhotoOffset><A:MotionPhotoOffset>"), size, F.lit("</A:MotionPhotoOffset>")))
        .otherwise(flag)
    )
    end = F.when(m == 7, F.lit("")).otherwise(F.lit(xmp.ENDS))
    text = F.concat(F.lit("<x:xmpmeta xmlns:x='adobe:ns:meta/'><rdf:RDF>"), body, F.lit("</rdf:RDF>"), end)
    return lib.files.select("id", F.concat(F.unhex(F.lit("FFD8FFE100FF3C783A")), F.encode(text, "UTF-8"), F.unhex(F.lit("FFDA00FF"))).alias("content"))


@query(
    "X32_motion_photos",
    "select id, case when id % 8 in (0, 1, 2, 6) then size when id % 8 = 3 then 0 end video_offset, case when id % 8 = 2 then length(regexp_replace(name, '[^A-Za-z0-9.]', '', 'g')) end video_length, id % 8 in (0, 1, 2, 3, 6) moving from v_files",
)
def motion_photos(lib: Library) -> DataFrame:
    """Where the video of a motion photo begins, by its packet's element, attribute or directory."""
    read = xmp_headers(lib).select("id", F.explode(F.array(xmp.motion(F.col("content")))).alias("x"))
    return read.select("id", "x.video_offset", "x.video_length", F.col("x").isNotNull().alias("moving"))
