"""Names ordered by sound: Han characters are read as pinyin before digits are padded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspan.operators.library import natural_key
from mediaspan.plans.catalog import Library
from mediaspan.plans.registry import query

# The blocks of Han characters that have readings, and the rule of the Unicode library that Spark brings along.
HAN = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)]
READING = "Han-Latin; Latin-ASCII; Lower"


def readings(spark: SparkSession) -> DataFrame:
    """(letter, sound) of every Han character with a reading, without its tone: some 28,000 rows, whatever the data.

    A character of several readings has its commonest.
    """
    letters = [chr(c) for low, high in HAN for c in range(low, high + 1)]
    rule = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance(READING)
    sounds = rule.transliterate("|".join(letters)).split("|")
    return spark.createDataFrame([(a, b.strip()) for a, b in zip(letters, sounds, strict=True) if b.strip().isascii() and b.strip()], "letter string, sound string")


def has_han(name: Column) -> Column:
    return name.rlike("[㐀-䶿一-鿿豈-﫿]")


def sound_keys(names: DataFrame) -> DataFrame:
    """(name, name_key) of every distinct name in names (name): Han characters by their sound, runs of digits padded to ten.

    Names without Han characters are keyed in place. The others are cut into
    letters, which meet the table of readings by a broadcast of its fixed
    size, and are put together again, a name a row. A null name has no key.
    """
    distinct = names.select("name").distinct()
    plain = distinct.where(F.col("name").isNull() | ~has_han(F.col("name"))).select("name", natural_key(F.col("name")).alias("name_key"))
    letters = distinct.where(has_han(F.col("name"))).select("name", F.posexplode(F.split("name", "")).alias("at", "letter"))
    read = letters.join(F.broadcast(readings(names.sparkSession)), "letter", "left")
    whole = F.array_sort(F.collect_list(F.struct("at", F.coalesce("sound", "letter").alias("s"))))
    spoken = read.groupBy("name").agg(F.array_join(F.transform(whole, lambda x: x["s"]), "").alias("spoken"))
    return plain.unionByName(spoken.select("name", natural_key(F.col("spoken")).alias("name_key")))


def spoken_files(lib: Library) -> DataFrame:
    """(id, name): the library's files, two of three with Han characters among digits and letters."""
    m = F.col("id") % 3
    made = F.when(m == 0, F.regexp_replace("name", "^IMG_", "图片")).when(m == 1, F.regexp_replace("name", "^IMG_(\\d)", "北京$1文")).otherwise(F.col("name"))
    return lib.files.select("id", made.alias("name"))


_SPOKEN = ", n as (select id, name, case id % 3 when 0 then replace(name, 'IMG_', '图片') when 1 then regexp_replace(name, '^IMG_([0-9])', '北京\\1文') else name end shown, case id % 3 when 0 then replace(name, 'IMG_', 'tupian') when 1 then regexp_replace(name, '^IMG_([0-9])', 'beijing\\1wen') else name end spoken from v_files), k as (select id, shown as name, list_aggregate(list_transform(regexp_extract_all(spoken, '[0-9]+|[^0-9]+'), lambda r: case when regexp_matches(r, '^[0-9]') then lpad(r, cast(greatest(10, length(r)) as int), '0') else r end), 'string_agg', '') name_key from n) "


@query("X1_pinyin_keys", _SPOKEN + "select id, name, name_key from k")
def pinyin_keys(lib: Library) -> DataFrame:
    files = spoken_files(lib)
    return files.join(sound_keys(files), "name").select("id", "name", "name_key")


@query("O10_pinyin_page", _SPOKEN + "select id, name from k order by name_key, id limit 50 offset 7000")
def pinyin_page(lib: Library) -> DataFrame:
    """A page of files in the order of their sound."""
    files = spoken_files(lib)
    return files.join(sound_keys(files), "name").orderBy("name_key", "id").offset(7000).limit(50).select("id", "name")
