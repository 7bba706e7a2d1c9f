"""Fields of EXIF read from bytes by expressions: the walk of TIFF directories, and a scan for headers that are damaged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Byte-order marks, tags, sizes of the kinds of values, and the tags that the scan looks for.
LITTLE_MARK, BIG_MARK = "49492A00", "4D4D002A"
MAKE, MODEL, ORIENTATION, SOFTWARE, DATE_TIME, ORIGINAL, LENS_MAKE, LENS_MODEL, CONTENT_ID, MAKER_ORIENTATION = 0x010F, 0x0110, 0x0112, 0x0131, 0x0132, 0x9003, 0xA433, 0xA434, 0x0011, 0x2000
EXIF_AT, GPS_AT = 0x8769, 0x8825
LATITUDE_REF, LATITUDE, LONGITUDE_REF, LONGITUDE = 1, 2, 3, 4
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
SCANNED = {"make": MAKE, "model": MODEL, "date_time_original": ORIGINAL, "date_time": DATE_TIME, "software": SOFTWARE, "lens_model": LENS_MODEL, "lens_make": LENS_MAKE, "content_id": CONTENT_ID}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def piece(content: Column, at: Column, size: Column) -> Column:
    """So many bytes at an offset from 0; null if they aren't all there."""
    return F.when((at >= 0) & (size >= 0) & (at + size <= F.octet_length(content)), F.substring(content, (at + 1).cast("int"), size.cast("int")))


def ordered(digits: Column, size: int, little: Column, at: int = 0) -> Column:
    """The unsigned number of so many bytes, from a byte on, of hexadecimal digits."""
    pick = lambda i, n: F.substring(digits, 2 * (at + i) + 1, 2 * n)
    turned = F.concat(*[pick(i, 1) for i in reversed(range(size))])
    return F.conv(F.when(little, turned).otherwise(pick(0, size)), 16, 10).cast("long")


def digits_of(content: Column, at: Column, size: int) -> Column:
    """Hexadecimal digits of so many bytes at an offset from 0, which is not negative; fewer if they aren't all there. The offset is looked at once."""
    return F.hex(F.substring(content, F.least(at + 1, F.lit(2**31 - 1)).cast("int"), F.lit(size)))


def number(content: Column, at: Column, size: int, little: Column) -> Column:
    """The unsigned number of so many bytes at an offset from 0; null if the bytes aren't all there."""
    return let(digits_of(content, at, size), lambda h: F.when(F.length(h) == 2 * size, ordered(h, size, little)))


def tiff_base(content: Column) -> Column:
    """Where the first byte-order mark lies, from 0; null if there is none."""
    shown = F.decode(content, "ISO-8859-1")
    places = [F.nullif(F.locate(m, shown), F.lit(0)) for m in ("II*\0", "MM\0*")]
    return F.least(*places) - 1


def directory(content: Column, base: Column, at: Column, little: Column) -> Column:
    """array<struct<tag, kind, n, at>> of the directory at an offset from the base: `at` is where a value's bytes lie from the base.

    A directory whose entries are not all there has those that are; one that isn't there at all is null.
    """
    sizes = F.create_map(*[F.lit(x) for pair in SIZES.items() for x in pair])

    def listed(start: Column) -> Column:
        room = F.floor((F.octet_length(content) - start - 2) / 12)

        def entry(i: Column) -> Column:
            place = start + 2 + 12 * i.cast("long")

            def told(h: Column) -> Column:
                head = F.struct(ordered(h, 2, little).alias("tag"), ordered(h, 2, little, 2).alias("kind"), ordered(h, 4, little, 4).alias("n"))

                def placed(e: Column) -> Column:
                    size = F.coalesce(F.try_element_at(sizes, e["kind"].cast("int")), F.lit(1)) * e["n"]
                    value_at = F.when(size <= 4, place + 8 - base).otherwise(ordered(h, 4, little, 8))
                    return F.struct(e["tag"].alias("tag"), e["kind"].alias("kind"), e["n"].alias("n"), value_at.alias("at"))

                return let(head, placed)

            return let(digits_of(content, place, 12), told)

        used = lambda count: F.least(count, room).cast("int")
        return let(used(number(content, start, 2, little)), lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), entry)))

    return let(base + at, listed)


def entry_of(entries: Column, tag: int) -> Column:
    """The first entry of a tag, or null."""
    return F.try_element_at(F.filter(entries, lambda e: e["tag"] == tag), F.lit(1))


def _printable(shown: Column) -> Column:
    """Bytes, a character each, as trimmed text; null if nothing is left or one is neither visible ASCII nor white space."""
    trimmed = F.btrim(shown, F.lit(" \t\n\x0b\f\r\0"))
    return let(trimmed, lambda text: F.when((text != "") & ~text.rlike(r"[^\x21-\x7E\s]"), text))


def text_of(content: Column, base: Column, entry: Column) -> Column:
    """An entry's text up to its first zero; null if its bytes aren't all there."""
    first = lambda at: F.substring_index(F.decode(piece(content, at, entry["n"]), "ISO-8859-1"), "\0", 1)
    return F.when(entry["kind"] == 2, let(base + entry["at"], lambda at: _printable(first(at))))


def whole_of(content: Column, base: Column, entry: Column, little: Column) -> Column:
    """An entry's first whole number."""
    at = base + entry["at"]
    return F.when(entry["kind"] == 3, number(content, at, 2, little)).when(entry["kind"] == 4, number(content, at, 4, little))


def ratios_of(content: Column, base: Column, entry: Column, little: Column) -> Column:
    """An entry's ratios as doubles; one over nothing is null."""
    at = base + entry["at"]

    def ratio(i: Column) -> Column:
        both = F.struct(*[number(content, at + 8 * i + shift, 4, little).alias(name) for shift, name in ((0, "over"), (4, "under"))])
        return let(both, lambda b: F.when(b["under"] != 0, b["over"] / b["under"]))

    n = F.least(entry["n"], F.lit(64)).cast("int")  # no tag of interest has more than three
    return F.when((entry["kind"] == 5) & (n > 0), F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: ratio(i.cast("long") - 1)))


def degrees(parts: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds as one number, negative in the south and west; null unless there are three."""
    part = lambda i: F.element_at(parts, i)
    plain = part(1) + part(2) / 60 + part(3) / 3600
    return F.when(F.size(parts) == 3, F.when(ref.isin("S", "W"), -plain).otherwise(plain))


def fields(content: Column) -> Column:
    """struct of what the directories of a TIFF header hold, wherever it lies in the bytes; null without a header."""
    return let(content, _fields)  # a bound value is not copied out of its row at every look


def _fields(content: Column) -> Column:
    def walked(base: Column, little: Column, main: Column) -> Column:
        below = lambda tag: let(whole_of(content, base, entry_of(main, tag), little), lambda at: F.when(at.isNotNull(), directory(content, base, at, little)))

        def told(inner: Column) -> Column:
            detail, place = inner["detail"], inner["place"]
            text = lambda entries, tag: let(entry_of(entries, tag), lambda e: text_of(content, base, e))
            angle = lambda tag, ref: degrees(let(entry_of(place, tag), lambda e: ratios_of(content, base, e, little)), text(place, ref))
            return F.struct(
                text(main, MAKE).alias("make"),
                text(main, MODEL).alias("model"),
                text(main, SOFTWARE).alias("software"),
                text(main, DATE_TIME).alias("date_time"),
                let(entry_of(main, ORIENTATION), lambda e: whole_of(content, base, e, little)).cast("int").alias("orientation"),
                text(detail, ORIGINAL).alias("date_time_original"),
                text(detail, LENS_MAKE).alias("lens_make"),
                text(detail, LENS_MODEL).alias("lens_model"),
                angle(LATITUDE, LATITUDE_REF).alias("latitude"),
                angle(LONGITUDE, LONGITUDE_REF).alias("longitude"),
            )

        return let(F.struct(below(EXIF_AT).alias("detail"), below(GPS_AT).alias("place")), told)

    def from_base(base: Column) -> Column:
        little = F.substring(content, (base + 1).cast("int"), F.lit(2)) == F.lit(bytearray(b"II"))
        main = lambda known: let(directory(content, base, number(content, base + 4, 4, known), known), lambda entries: walked(base, known, entries))
        return F.when(base.isNotNull(), let(little, main))

    return let(tiff_base(content), from_base)


def scanned(content: Column) -> Column:
    """struct of texts found without directories: wherever twelve bytes look like an entry of a known tag.

    The first entry of a tag with a printable text of 2 to 255 bytes counts.
    Values of up to four bytes lie in the entry, others at their offset from
    the byte-order mark. maker_orientation is the number of its own tag.
    """
    return let(content, _scanned)


def _scanned(content: Column) -> Column:
    both = lambda tag: (f"\\x{tag & 255:02x}\\x{tag >> 8:02x}", f"\\x{tag >> 8:02x}\\x{tag & 255:02x}")
    pairs = [both(t) for t in SCANNED.values()]
    small, large = ("|".join(p[i] for p in pairs) for i in (0, 1))
    own = both(MAKER_ORIENTATION)
    pattern = rf"(?s)(?=((?:(?:{small})\x02\x00|(?:{large})\x00\x02|{own[0]}\x03\x00|{own[1]}\x00\x03).{{8}}))"
    found = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(pattern), F.lit(1))
    entries = F.transform(F.filter(found, lambda e: F.length(e) == 12), lambda e: F.encode(e, "ISO-8859-1"))

    def read(base: Column) -> Column:
        def opened(e: Column) -> Column:
            little = F.substring(e, 4, 1) == F.lit(bytearray(b"\0"))

            def value(head: Column) -> Column:
                size = head["n"] - 1
                inside = F.when(head["n"] <= 4, piece(e, F.lit(8), size)).otherwise(piece(content, base + head["offset"], size))
                text = F.when((head["n"] > 1) & (head["n"] < 256), _printable(F.decode(inside, "ISO-8859-1")))
                turned = F.when(head["n"] > 0, number(e, F.lit(8), 2, little)).cast("int")
                return F.struct(head["tag"].alias("tag"), F.when(head["tag"] != MAKER_ORIENTATION, text).alias("text"), F.when(head["tag"] == MAKER_ORIENTATION, turned).alias("turned"))

            head = lambda h: F.struct(ordered(h, 2, little).alias("tag"), ordered(h, 4, little, 4).alias("n"), ordered(h, 4, little, 8).alias("offset"))
            return let(let(F.hex(e), head), value)

        def first(opened_all: Column) -> Column:
            text = lambda tag: F.try_element_at(F.filter(opened_all, lambda x: (x["tag"] == tag) & x["text"].isNotNull()), F.lit(1))["text"]
            turned = F.try_element_at(F.filter(opened_all, lambda x: x["turned"].isNotNull()), F.lit(1))["turned"]
            return F.struct(*[text(tag).alias(name) for name, tag in SCANNED.items()], turned.alias("maker_orientation"))

        return F.when(base.isNotNull(), let(F.transform(entries, opened), first))

    return let(tiff_base(content), read)
