"""Names by sound, collections, doubles and walks."""

import math
import random

from mediaspan.operators import library, metadata, mutations, names


def keys(spark, *given):
    rows = spark.createDataFrame([(n,) for n in given], "name string")
    return {r["name"]: r.name_key for r in names.sound_keys(rows).collect()}


def test_han_digits_and_letters(spark):
    given = ["图片2.jpg", "图片10.jpg", "中文", "Page_2", "北京 2008 a", "x中1", "ａ１", None, "", "图片2.jpg", "〇", "鼠" * 200]
    got = keys(spark, *given)
    assert got["图片2.jpg"] == "tupian0000000002.jpg" < got["图片10.jpg"] == "tupian0000000010.jpg"
    assert got["中文"] == "zhongwen" and got["北京 2008 a"] == "beijing 0000002008 a" and got["x中1"] == "xzhong0000000001"
    assert got["Page_2"] == "Page_0000000002" and got["ａ１"] == "ａ１" and got[None] is None and got[""] == "" and got["鼠" * 200] == "shu" * 200
    assert len(got) == len(set(given))


def test_every_common_character_has_one_plain_reading(spark):
    rows = names.readings(spark).collect()
    assert 20000 < len(rows) < 30000 and len({r.letter for r in rows}) == len(rows)
    assert all(r.sound.isascii() and r.sound.isalpha() and r.sound.islower() for r in rows if "一" <= r.letter <= "龥")


def test_doubles_give_way_to_the_greatest_id(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (5, 1, "a"), (3, 1, "a"), (4, 2, "a"), (6, 1, None), (7, 1, None), (8, None, "b")], "id long, folder_id long, name string")
    assert {(r.old_id, r.new_id) for r in library.losers(rows).collect()} == {(1, 5), (3, 5), (6, 7)}
    covers = spark.createDataFrame([(1, 3), (2, 4), (3, None)], "album_id long, cover long")
    left, moved = mutations.migrated(rows, covers)
    assert {r.id for r in left.collect()} == {5, 4, 7, 8} and {(r.album_id, r.cover) for r in moved.collect()} == {(1, 5), (2, 4), (3, None)}


def test_collections_empty_and_go(spark):
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "collection_id long, file_id long")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert mutations.cleared(members, 1).count() == 1 and mutations.cleared(members, 9).count() == 3
    left, rows = mutations.deleted(ids, members, [2, 9])
    assert {r.id for r in left.collect()} == {1, 3} and rows.count() == 2


def test_nearest_city_of_every_point(spark):
    rnd = random.Random(4)
    cities = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(40)] + [(100 + i, 48 + i / 1000, 2.0) for i in range(60)] + [(300, 48.0, 2.0), (301, 90.0, 0.0)]
    points = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(60)] + [(48.0301, 2.0001), (90.0, 77.0), (-90.0, 0.0), (0.0, 180.0), (0.0, -180.0), (48.0, 2.0), (48.0, 2.0), (None, 1.0), (float("nan"), 1.0)]

    def xyz(lat, lon):
        a, o = math.radians(lat), math.radians(lon)
        return math.cos(a) * math.cos(o), math.cos(a) * math.sin(o), math.sin(a)

    def nearest(p):
        return min((round(sum((u - v) ** 2 for u, v in zip(xyz(*p), xyz(*c[1:]), strict=True)), 12), c[0]) for c in cities)[1]

    towns = spark.createDataFrame(cities, "city long, lat double, lon double")
    got = {(r.lat, r.lon): r.city for r in metadata.nearest(spark.createDataFrame(points, "lat double, lon double"), towns).collect()}
    assert got == {p: nearest(p) for p in set(points[:-2])}
    assert metadata.nearest(spark.createDataFrame(points, "lat double, lon double"), towns.limit(0)).count() == 0
    assert metadata.edges(10**6)[0] < 0.01 and metadata.edges(1)[-1] == metadata.WHOLE
