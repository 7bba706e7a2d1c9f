"""Prompts, EXIF and XMP out of texts and bytes: formats, orders, damage."""

import struct

import pytest
from pyspark.sql import functions as F

from mediaspan.functions import exif, xmp
from mediaspan.operators import prompts
from mediaspan.plans.workspace import Workspace


def prompt_of(spark, *cases):
    rows = spark.createDataFrame(list(enumerate(cases)), "file_id long, chunks map<string,string>")
    return [r.prompt for r in prompts.prompts(rows, Workspace(spark, "prompts")).orderBy("file_id").collect()]


GRAPH = '{"3": {"class_type": "CLIPTextEncode", "inputs": {"text": "a calm lake under a red sky", "clip": ["4", 0]}}, "6": {"class_type": "CLIPTextEncode", "inputs": {"text": "blurry, low quality"}}, "7": {"class_type": "Other", "inputs": {"text": "blurry, low"}}}'


def test_formats_in_order_of_preference(spark):
    got = prompt_of(
        spark,
        {"parameters": "a cat, masterpiece\nNegative prompt: bad hands\nSteps: 20", "prompt": "other, text"},
        {"Parameters": "green hills\nSteps: 20"},
        {"parameters": "DSC_0001", "Comment": '{"prompt": " one girl, uniform ", "steps": 28}'},
        {"Comment": '{"steps": 28, "uc": "x"}'},
        {"Description": "soft light, film grain"},
        {"Description": "OLYMPUS", "sd-metadata": '{"image": {"prompt": "deep forest"}, "prompt": 5}'},
        {"prompt": "short"},
        {"workflow": GRAPH},
        {"prompt": GRAPH, "Comment": " "},
        {"Software": "paint.net"},
        {},
        None,
        {"parameters": None, "Prompt": "x"},
    )
    both = "a calm lake under a red sky\n---\nblurry, low quality"
    assert got == ["a cat, masterpiece", "green hills", "one girl, uniform", '{"steps": 28, "uc": "x"}', "soft light, film grain", "deep forest", "short", both, both, None, None, None, "x"]


def test_graphs_of_any_shape(spark, monkeypatch):
    deep = "[" * 9 + '{"text": "a text that is long enough to count"}' + "]" * 9
    cases = [{"workflow": x} for x in (deep, "{broken", "[]", "[1, null, \"x\"]", '{"class_type": 5, "inputs": []}', '{"a": {"inputs": {"text": "tiny"}, "class_type": "TextEncode"}}')]
    same = '{"b": {"class_type": "CLIPText", "inputs": {"text": "second one"}}, "a": {"class_type": "CLIPText", "inputs": {"text": "the first!"}}, "c": {"class_type": "CLIPText", "inputs": {"text": "the first!"}}}'
    assert prompt_of(spark, *cases, {"workflow": same}) == ["a text that is long enough to count", None, None, None, None, None, "the first!\n---\nsecond one"]
    monkeypatch.setattr(prompts, "DEEPEST", 6)
    assert prompt_of(spark, {"workflow": deep}, {"workflow": GRAPH})[0] is None


def test_long_prompts_are_cut_off(spark):
    (got,) = prompt_of(spark, {"prompt": "ä, " * 3000})
    assert len(got) == prompts.MOST and got.endswith("…")


# ---- EXIF


def tiff(little, entries, before=b"", at=8):
    """entries: (tag, kind, n, value bytes)."""
    order = "<" if little else ">"
    head, body, place = struct.pack(order + "H", len(entries)), b"", at + 2 + 12 * len(entries) + 4
    for tag, kind, n, value in entries:
        inline = value.ljust(4, b"\0") if len(value) <= 4 else struct.pack(order + "I", place + len(body))
        head += struct.pack(order + "HHI", tag, kind, n) + inline
        body += value if len(value) > 4 else b""
    return before + (b"II*\0" if little else b"MM\0*") + struct.pack(order + "I", at) + b"\0" * (at - 8) + head + b"\0" * 4 + body


def read_all(spark, contents, how=exif.fields):
    rows = spark.createDataFrame(list(enumerate(contents)), "n int, content binary")
    found = rows.select("n", F.explode(F.array(how(F.col("content")))).alias("x")).collect()
    return [r.x for r in sorted(found, key=lambda r: r.n)]


def read(spark, content, how=exif.fields):
    return read_all(spark, [content], how)[0]


@pytest.mark.parametrize("little", [True, False])
def test_directories_in_both_byte_orders(spark, little):
    order = "<" if little else ">"
    whole = tiff(little, [(exif.MAKE, 2, 6, b"Canon\0"), (exif.MODEL, 2, 3, b"M5\0"), (exif.ORIENTATION, 3, 1, struct.pack(order + "H", 6)), (exif.DATE_TIME, 2, 4, b"\xff\xfeX\0")], b"\xff\xd8\xff\xe1Exif\0\0", 20)
    got = read(spark, whole)
    assert (got.make, got.model, got.orientation, got.date_time, got.lens_make, got.latitude) == ("Canon", "M5", 6, None, None, None)


def test_damaged_directories_give_null(spark):
    whole = tiff(True, [(exif.MAKE, 2, 300, b"C" * 299 + b"\0"), (exif.MODEL, 2, 6, b"EOS R\0")])
    sizes = [*range(0, 60), *range(60, len(whole), 40), len(whole)]
    for size, got in zip(sizes, read_all(spark, [whole[:size] for size in sizes]), strict=True):
        assert (got is None) == (size < 4) and (got is None or (got.make is None) == (size < 338) and (got.model is None) == (size < len(whole)))
    wild = b"II*\0" + struct.pack("<I", 0xFFFFFFFF)
    others = [None, b"plain bytes", wild, tiff(True, [(exif.EXIF_AT, 4, 1, struct.pack("<I", 0xFFFFFF00))]), tiff(True, [(exif.GPS_AT, 4, 1, struct.pack("<I", 8))]), b"II*\0\x08\0\0\0\xff\xff" + b"\x0f\x01\x02\0"]
    got = read_all(spark, others)
    assert got[:2] == [None, None] and all(set(x) == {None} for x in got[2:])


@pytest.mark.parametrize("little", [True, False])
def test_the_scan_finds_entries_wherever_they_lie(spark, little):
    order = "<" if little else ">"
    entry = lambda tag, kind, n, value: struct.pack(order + "HHI", tag, kind, n) + value
    base = b"II*\0" if little else b"MM\0*"
    far = struct.pack(order + "I", 100)
    body = b"junk" + base + b"j" + entry(exif.MAKE, 2, 6, struct.pack(order + "I", 9999)) + entry(exif.MAKE, 2, 6, far) + entry(exif.MAKE, 2, 6, struct.pack(order + "I", 4)) + entry(exif.MODEL, 2, 4, b"R5\x20\0") + entry(0x2000, 3, 1, struct.pack(order + "H", 8) + b"\0\0") + b"?"
    whole = body.ljust(104, b"\0") + b"Canon\0"
    got, *none = read_all(spark, [whole, body[10:], None], exif.scanned)
    assert (got.make, got.model, got.maker_orientation, got.software) == ("Canon", "R5", 8, None) and none == [None, None]


# ---- XMP


def test_numbers_in_elements_and_attributes(spark):
    cases = {
        "<G:MotionPhotoOffset> 42\n</G:MotionPhotoOffset>": "42",
        "<rdf:Description a='1' G:MotionPhotoOffset=\"84\" />": "84",
        "<G:OtherMotionPhotoOffset>126</G:OtherMotionPhotoOffset>": None,
        "<MotionPhotoOffset>x</MotionPhotoOffset><b MotionPhotoOffset='-1'><c MotionPhotoOffset='7'>": "7",
        "< <<>> <MotionPhotoOffset": None,
        "<MotionPhotoOffset/>5": None,
    }
    assert read_all(spark, [c.encode() for c in cases], lambda c: xmp.unsigned_value(c.cast("string"), "MotionPhotoOffset")) == list(cases.values())


def packet(body):
    return b"\xff\xd8" + f"<x:xmpmeta>{body}</x:xmpmeta>".encode() + b"\xff\xda"


def test_motion_photos(spark):
    item = '<C:Item I:Semantic="{}" {}/>'
    listed = lambda *items: packet('<a MotionPhoto="1"/><C:Directory>' + "".join(items) + "</C:Directory>" + item.format("Video", 'Length="1"'))
    cases = [
        (packet("<G:MotionPhoto>1</G:MotionPhoto><G:MotionPhotoOffset>42</G:MotionPhotoOffset>"), (42, None)),
        (listed(item.format("Primary", 'I:Length="900" I:Padding="8"'), item.format("MotionPhoto", 'I:Length="77"')), (900, 77)),
        (listed(item.format("Primary", ""), item.format("Video", 'I:Length="x"')), (0, None)),
        (listed(item.format("Primary", 'I:Length="900"')), None),
        (packet("<G:Offset>1</G:Offset>"), None),
        (b"<x:xmpmeta> MotionPhoto \xff\xff</x:xmpmeta>", None),
        (b"<x:xmpmeta> MotionPhoto", None),
        (b"", None),
        (None, None),
        (packet("<MotionPhoto " * 20000), None),
    ]
    found = read_all(spark, [c for c, _ in cases], xmp.motion)
    assert [None if x is None else (x.video_offset, x.video_length) for x in found] == [want for _, want in cases]


def test_headers_are_dealt_to_all_tasks(spark):
    from mediaspan.operators.headers import exif_headers
    from mediaspan.plans.catalog import Library

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = exif_headers(Library(spark, "/root/testdata/sf0.001")).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(made) == 4 and sum(r["count"] for r in made) == 1500
