"""Motion photos told by the XMP packet in a file's bytes, in expressions that survive broken XML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaspan.functions.exif import let

# The marks around a packet, and what names and semantics contain.
BEGINS, ENDS = "<x:xmpmeta", "</x:xmpmeta>"
FLAG, OFFSET = "MotionPhoto", "MotionPhotoOffset"


def packet(content: Column) -> Column:
    """The XMP packet of a file; null without both marks or if it is no UTF-8."""
    shown = F.decode(content, "ISO-8859-1")
    start = F.locate(BEGINS, shown)
    rest = F.substring(content, start, F.octet_length(content))
    end = F.locate(ENDS, F.decode(rest, "ISO-8859-1"))
    whole = F.substring(rest, F.lit(1), end + len(ENDS) - 1)
    return F.when((start > 0) & (end > 0), F.try_validate_utf8(whole.cast("string")))


def _unsigned(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^\s*([0-9]+)\s*$", 1), F.lit(""))


def _name(tag: Column) -> Column:
    """A tag's name with its prefix."""
    return F.regexp_extract(tag, r"^</?([^\s/>]+)", 1)


def _attributes(tag: Column) -> Column:
    """array<struct<name, value>> of a tag."""
    pairs = F.regexp_extract_all(tag, F.lit(r"[^\s=<>\"'/]+\s{0,9}=\s{0,9}(?:\"[^\"]*\"|'[^']*')"), F.lit(0))
    value = lambda p: F.regexp_extract(p, r"""(?s)=\s*["'](.*)["']$""", 1)
    return F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^([^\s=]+)", 1).alias("name"), value(p).alias("value")))


def unsigned_value(xmp: Column, tag: str) -> Column:
    """The first unsigned number under a local name, be it an element's text or an attribute; null if there is none."""
    # Every opening tag with the text up to the next one.
    pieces = F.regexp_extract_all(xmp, F.lit(r"<[^<>/!?][^<>]*>[^<]*"), F.lit(0))
    local = lambda name: F.element_at(F.split(name, ":"), -1)

    def found(piece: Column) -> Column:
        opening = F.regexp_extract(piece, r"^<[^<>]*>", 0)
        own = F.transform(F.filter(_attributes(opening), lambda a: local(a["name"]) == tag), lambda a: _unsigned(a["value"]))
        text = F.when((local(_name(opening)) == tag) & ~opening.rlike(r"/>$"), _unsigned(F.regexp_extract(piece, r"(?s)>([^<]*)$", 1)))
        return F.coalesce(F.try_element_at(F.filter(own, lambda v: v.isNotNull()), F.lit(1)), text)

    return F.try_element_at(F.filter(F.transform(pieces, found), lambda v: v.isNotNull()), F.lit(1))


def directory_items(xmp: Column) -> Column:
    """array<struct<semantic, length, padding>> of the items within the container's directory, in order."""
    tags = F.regexp_extract_all(xmp, F.lit(r"<[^<>!?][^<>]*>"), F.lit(0))
    kind = "array<struct<semantic:string,length:bigint,padding:bigint>>"

    def item(tag: Column) -> Column:
        found = _attributes(tag)
        last = lambda word, but: F.try_element_at(F.filter(found, lambda a: a["name"].contains(word) & ~but(a["name"])), F.lit(-1))["value"]
        none, semantic = (lambda n: F.lit(False)), (lambda n: n.contains("Semantic"))
        whole = lambda v: F.when(v.rlike(r"^\+?[0-9]+$"), v.try_cast("bigint"))
        return F.struct(F.coalesce(last("Semantic", none), F.lit("")).alias("semantic"), whole(last("Length", semantic)).alias("length"), whole(last("Padding", lambda n: semantic(n) | n.contains("Length"))).alias("padding"))

    def step(a: Column, tag: Column) -> Column:
        closing, name = tag.startswith("</"), _name(tag)
        inside = F.when(name.contains("Directory"), ~closing).otherwise(a["inside"])
        more = inside & name.contains("Item") & ~closing
        return F.struct(inside.alias("inside"), F.when(more, F.concat(a["items"], F.array(item(tag)).cast(kind))).otherwise(a["items"]).alias("items"))

    return F.aggregate(tags, F.struct(F.lit(False).alias("inside"), F.array().cast(kind).alias("items")), step, lambda a: a["items"])


def motion(content: Column) -> Column:
    """struct<video_offset, video_length> of a motion photo; null if the file is none.

    An offset of its own counts first. Else the directory's last item of a
    video stands after the last item of an image; a length that isn't told is
    null, and the offset 0 if the image's isn't.
    """
    kind = "struct<video_offset:bigint,video_length:bigint>"

    def of_items(items: Column) -> Column:
        still = lambda i: i["semantic"].contains("Image") | i["semantic"].contains("Primary")
        moving = lambda i: ~still(i) & (i["semantic"].contains("Motion") | i["semantic"].contains("Video"))
        image, video = (F.try_element_at(F.filter(items, test), F.lit(-1)) for test in (still, moving))
        return F.when(video.isNotNull(), F.struct(F.coalesce(image["length"], F.lit(0)).alias("video_offset"), video["length"].alias("video_length")).cast(kind))

    def of_packet(xmp: Column) -> Column:
        own = unsigned_value(xmp, OFFSET)
        told = F.struct(own.try_cast("bigint").alias("video_offset"), F.lit(None).cast("bigint").alias("video_length")).cast(kind)
        return F.when(xmp.contains(FLAG), F.when(own.isNull(), let(directory_items(xmp), of_items)).otherwise(F.when(own.try_cast("bigint").isNotNull(), told)))

    return let(packet(content), of_packet)
