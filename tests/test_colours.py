"""Lattices of cube files, mapping of colours, places and noise, and reviewed groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaspan.functions import colour, lattice
from mediaspan.operators import reviews


def points(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "lut long, text string")
    found = lattice.lattices(rows).orderBy("lut", "at").collect()
    return [[(r.r, r.g, r.b) for r in found if r.lut == i] for i in range(len(texts))], found


def cube(size, values, head=""):
    return f"{head}LUT_3D_SIZE {size}\n" + "\n".join(" ".join(map(str, v)) for v in values)


IDENTITY = [(r / 2, g / 2, b / 2) for b in range(3) for g in range(3) for r in range(3)]


def test_lines_of_cube_files(spark):
    eight = [(i / 10, 0, 1) for i in range(8)]
    domain = "DOMAIN_MIN -1 -1 -1\nDOMAIN_MAX 1 1 1\n"
    texts = [
        '# c\n\nTITLE "a \\"b"\n' + cube(2, eight) + "\n9 9 9\nnonsense\n1 2",
        cube(2, [(-1, 0, 5)] * 8, domain),
        "\n".join(" ".join(map(str, v)) for v in eight) + "\nLUT_3D_SIZE 2\n",
        cube(2, eight[:7]),
        cube(1, eight),
        cube(129, eight),
        cube("x", eight),
        cube(2, [(0.25, 0.25, 0.25)] * 8, "DOMAIN_MIN 0 0 0\nDOMAIN_MAX 0 1 1\n"),
        cube(2, eight) + "\n" + cube(2, [(1, 1, 1)] * 8),
        None,
        "",
    ]
    got, rows = points(spark, *texts)
    assert got[0] == [(i / 10, 0.0, 1.0) for i in range(8)] and rows[0].size == 2
    assert got[1] == [(0.0, 0.5, 1.0)] * 8 and got[2] == got[0]
    assert got[3] == got[4] == got[5] == got[6] == got[9] == got[10] == []
    assert got[7] == [(0.25, 0.25, 0.25)] * 8 and got[8] == [(1.0, 1.0, 1.0)] * 8


def test_an_identity_lattice_leaves_pixels_as_they_are(spark):
    lut = lattice.lattices(spark.createDataFrame([(1, cube(3, IDENTITY))], "lut long, text string"))
    px = spark.createDataFrame([(1, i, r, g, b) for i, (r, g, b) in enumerate([(0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0.3, 0.55, 0.9), (0.5, 1.0, 0.25), (-1.0, 2.0, 0.5)])] + [(2, 9, 0.1, 0.1, 0.1)], "lut long, pos int, r double, g double, b double")
    got = {r.pos: (r.r, r.g, r.b) for r in lattice.sampled(px, lut).collect()}
    assert set(got) == set(range(5))
    for r in px.where("lut = 1").collect():
        assert np.allclose(got[r.pos], np.clip([r.r, r.g, r.b], 0, 1))


def test_points_lie_red_first(spark):
    only_red = [(1.0 if i % 2 else 0.0, 0.0, 0.0) for i in range(8)]
    lut = lattice.lattices(spark.createDataFrame([(1, cube(2, only_red))], "lut long, text string"))
    px = spark.createDataFrame([(1, 0, 0.25, 1.0, 1.0), (1, 1, 1.0, 0.0, 0.0)], "lut long, pos int, r double, g double, b double")
    assert {r.pos: r.r for r in lattice.sampled(px, lut).collect()} == {0: 0.25, 1: 1.0}


def channels(spark, rgb, change):
    out = change(tuple(F.col(c) for c in "rgb"))
    row = spark.createDataFrame([rgb], "r double, g double, b double").select(*[c.alias(n) for n, c in zip("rgb", out, strict=True)]).first()
    return tuple(row)


@pytest.mark.parametrize("rgb", [(0.0, 0.0, 0.0), (255.0, 255.0, 255.0), (12.0, 200.0, 77.0), (255.0, 0.0, 3.0)])
def test_lab_and_back(spark, rgb):
    assert np.allclose(channels(spark, rgb, lambda c: colour.from_lab(colour.to_lab(c))), rgb, atol=0.6)
    if rgb[0] == rgb[1] == rgb[2]:
        assert np.allclose(channels(spark, rgb, colour.to_lab)[1:], (128, 128), atol=0.1)


def test_light_and_dark_are_protected_and_tone_is_bounded(spark):
    lit = lambda *v: tuple(map(F.lit, map(float, v)))
    assert channels(spark, (250.0, 250.0, 250.0), lambda c: colour.protected(lit(0, 0, 0), c, 1.0, 0.0)) == (250, 250, 250)
    assert channels(spark, (10.0, 10.0, 10.0), lambda c: colour.protected(lit(90, 90, 90), c, 0.0, 1.0)) == (10, 10, 10)
    assert channels(spark, (120.0, 120.0, 120.0), lambda c: colour.protected(lit(9, 9, 9), c, 1.0, 1.0)) == (9, 9, 9)
    assert np.allclose(channels(spark, (200.0, 200.0, 200.0), lambda c: colour.toned(lit(10, 10, 10), c, 1.0)), (18, 18, 18))
    assert np.allclose(channels(spark, (0.0, 0.0, 0.0), lambda c: colour.toned(lit(100, 50, 0), c, 1.0)), (60, 30, 0))


def test_shift_and_width_of_the_mapping_are_bounded(spark):
    q = lambda m, a, b: F.struct(F.lit(float(m)).alias("median"), F.lit(float(a)).alias("p16"), F.lit(float(b)).alias("p84"))
    far = lambda c: colour.matched(c, [q(100, 90, 110)] * 3, [q(200, 0, 255)] * 3, (1.0, 1.0, 0.0))
    assert np.allclose(channels(spark, (110.0, 110.0, 110.0), far), (110 + 16 + 1.8, 110 + 20 + 1.8, 110))


def test_noise_is_that_of_the_place(spark):
    def plain(x, y):
        n = (x * 374761393 + y * 668265263) % 2**32
        n = ((n ^ n >> 13) * 1274126177) % 2**32
        return (n ^ n >> 16) / 2**32

    at = spark.createDataFrame([(0, 0), (1, 0), (7, 3), (4000, 65535), (2**31, 2**31)], "x long, y long")
    for r in at.select("x", "y", colour.noise(F.col("x"), F.col("y")).alias("n")).collect():
        assert r.n == plain(r.x, r.y)


def test_the_corners_of_a_vignette_are_darkest(spark):
    px = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    got = {(r.x, r.y): r.v for r in px.select("x", "y", colour.vignette((F.lit(200),) * 3, F.col("x"), F.col("y"), 8, 8, 100.0)[0].alias("v")).collect()}
    assert got[0, 0] == got[7, 7] == 0 and got[3, 3] == got[4, 4] == max(got.values())


# ---- reviewed groups


def review(spark, choices, files=(1, 2, 3)):
    members = spark.createDataFrame([("h", 10, f, len(files) - i, i == 0) for i, f in enumerate(files)] + [("other", 5, 8, 2, True), ("other", 5, 9, 1, False)], "hash string, file_size long, file_id long, score long, is_keep boolean")
    made = spark.createDataFrame([("h", 10, *c) for c in choices] + [("gone", 1, 1, 1)], "hash string, file_size long, file_id long, at long")
    items = reviews.reviewed_items(members, made)
    return {r.file_id for r in items.where("is_keep and hash = 'h'").collect()}, items.where("hash = 'h'").first().reviewed, items


def test_choices_outlive_a_rebuild_while_their_file_is_there(spark):
    assert review(spark, [])[:2] == ({1}, False)
    assert review(spark, [(2, 5)])[:2] == ({2}, True)
    assert review(spark, [(2, 5), (3, 6), (1, 4)])[:2] == ({3}, True)
    assert review(spark, [(2, 5), (0, 6)])[:2] == (set(), True)
    assert review(spark, [(2, 5)], (3, 1))[:2] == ({3}, False)
    assert review(spark, [(2, 5)], (7, 2, 5))[:2] == ({2}, True)


def test_lists_by_review_and_order(spark):
    items = review(spark, [(2, 5)])[2]
    show = lambda *a: [r.hash for r in reviews.listed(items, *a).collect()]
    assert show() == ["h", "other"] == show("all", "count_desc") and show("all", "size_asc") == ["other", "h"] == show("all", "count_asc")
    assert show("reviewed") == ["h"] and show("unreviewed", "count_asc") == ["other"]
    with pytest.raises(ValueError, match="unknown"):
        reviews.listed(items, "some")
