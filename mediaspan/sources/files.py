"""Folders of files and delimited gazetteers as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspan.operators.library import extension, file_type
from mediaspan.plans.catalog import Library
from mediaspan.plans.registry import query, register
from mediaspan.plans.workspace import Workspace

GAZETTEER = "lat double, lon double, name string, admin1 string, cc string"


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def walk(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, size, modified_at) of all files below a folder; hidden files and folders are not entered, contents not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    below = F.regexp_replace("path", "^.*?" + _literal(folder.split("://", 1)[-1].rstrip("/")), "")
    shown = found.select("path", name_of(F.col("path")).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), below.alias("below"))
    return shown.where(~F.col("below").rlike(r"/\.")).drop("below")


def listing(spark: SparkSession, folder: str, sort: str = "name", descending: bool = False) -> DataFrame:
    """The files of one folder, not of those below it, in the order of a column of `walk`; equal ones have no order."""
    found = spark.read.format("binaryFile").load(folder).select("path", name_of(F.col("path")).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
    key = F.lower(sort) if sort == "name" else F.col(sort)
    return found.where(~F.col("name").startswith(".")).orderBy(key.desc() if descending else key)


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Places of a CSV file with a header (lat, lon, name, admin1, cc); malformed rows fail the read."""
    return spark.read.schema(GAZETTEER).option("header", "true").option("escape", '"').option("mode", "FAILFAST").csv(path)


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


# First bytes of formats, in hexadecimal, in the order of the tests.
_SIGNATURES = [("FFD8FF", "JPG"), ("89504E470D0A1A0A", "PNG"), ("474946383761", "GIF"), ("474946383961", "GIF"), ("424D", "BMP")]
_LATER = [("FF0A", "JXL"), ("0000000C4A584C200D0A870A", "JXL"), ("1A45DFA3", "MKV"), ("464C56", "FLV"), ("3026B2758E66CF11A6D900AA0062CE6C", "ASF")]
# Brands of two formats.
_HEIC, _AVIF = ("heic", "heix", "hevc", "hevx", "mif1", "msf1", "heif"), ("avif", "avis")


def format_label(content: Column, kind: Column) -> Column:
    """The format that the first bytes tell, else null; kind 3 makes a TIFF header RAW."""
    head = F.hex(F.substring(content, 1, 16))
    brand = F.lower(F.decode(F.substring(content, 9, 4), "ISO-8859-1"))
    label = F.lit(None).cast("string")
    tests = [(head.startswith(sign), F.lit(name)) for sign, name in _SIGNATURES]
    tests += [(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), F.lit("WEBP")), (head.startswith("52494646") & (F.substring(head, 17, 6) == "415649"), F.lit("AVI"))]
    tests += [(head.startswith("49492A00") | head.startswith("4D4D002A"), F.when(kind == 3, "RAW").otherwise("TIFF"))]
    tests += [(head.startswith(sign), F.lit(name)) for sign, name in _LATER]
    box = (F.length(content) >= 12) & (F.substring(head, 9, 8) == "66747970")
    tests += [(box & brand.startswith("3gp"), F.lit("3GP")), (box & brand.isin("qt  ", "qt"), F.lit("MOV")), (box & brand.isin(*_HEIC), F.lit("HEIC")), (box & brand.isin(*_AVIF), F.lit("AVIF")), (box, F.lit("MP4"))]
    for test, name in reversed(tests):
        label = F.when(test, name).otherwise(label)
    return label


# Labels that go by another name.
_ALIASES = {"JPEG": "JPG", "JPE": "JPG", "JFIF": "JPG", "TIF": "TIFF", "MPG": "MPEG", "M4V": "MP4"}


def extension_label(name: Column) -> Column:
    """The label of an extension, where the bytes tell none."""
    shown = F.upper(extension(name))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in _ALIASES.items() for x in pair])[shown], shown)


#: Headers that the files take in turn in the registered query, and what they are.
_HEADS = ["FFD8FFE000104A46", "89504E470D0A1A0A0000", "474946383961", "424D0000", "524946460000000057454250", "524946460000000041564920", "49492A0008000000", "4D4D002A00000008", "FF0A", "1A45DFA3", "000000186674797071742020", "00000018667479706D696631", "000000186674797061766966", "0000001866747970336770", "000000186674797069736F6D", "00"]
_LABELS = ["JPG", "PNG", "GIF", "BMP", "WEBP", "AVI", "TIFF", "TIFF", "JXL", "MKV", "MOV", "HEIC", "AVIF", "MP4", "MP4", None]


@query("S9_format_label", f"select id, coalesce(case when id % 16 in (6, 7) and file_type = 3 then 'RAW' when id % 16 = 13 then null else [{', '.join(repr(x) if x else 'null' for x in _LABELS)}][id % 16 + 1] end, case upper(regexp_extract(name, '\\.([^.]*)$', 1)) when 'JPEG' then 'JPG' else upper(regexp_extract(name, '\\.([^.]*)$', 1)) end) label from v_files")
def sniffed(lib: Library) -> DataFrame:
    """The label by content; a file of less than twelve bytes has no brand, and one without any sign takes its extension's."""
    head = F.unhex(F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("id") % 16 + 1).cast("int")))
    return lib.files.select("id", F.coalesce(format_label(head, F.col("file_type")), extension_label(F.col("name"))).alias("label"))


@query("S3_directory_walk")
def tables_walk(lib: Library) -> DataFrame:
    """The tables of the folder as files, with what their names say."""
    return walk(lib.spark, lib.folder).select("name", "size", file_type(F.col("name")).alias("kind"))


register("S4_folder_listing", lambda lib: listing(lib.spark, lib.folder, "size", True).select("name", "size"))


@query("S10_gazetteer", "select round(n_nationkey * 13 % 170 - 85.5::double, 4) lat, round(n_nationkey * 29 % 350 - 174.25::double, 4) lon, n_name || ', \"old\"' as name, r_name admin1, 'C' || n_nationkey cc from nation join region on r_regionkey = n_regionkey")
def gazetteer_read(lib: Library) -> DataFrame:
    """Nations as places, written as CSV with quotes and commas and read back by the gazetteer source."""
    key = F.col("n_nationkey")
    places = lib.table("nation").join(lib.table("region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.round(key * 13 % 170 - 85.5, 4).alias("lat"), F.round(key * 29 % 350 - 174.25, 4).alias("lon"), F.concat("n_name", F.lit(', "old"')).alias("name"), F.col("r_name").alias("admin1"), F.concat(F.lit("C"), key.cast("string")).alias("cc"))
    path = Workspace(lib.spark, "gazetteer").path("places")
    places.write.option("header", "true").option("escape", '"').csv(path)
    return gazetteer(lib.spark, path)
