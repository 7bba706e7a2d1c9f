"""Substring dedup by hashing lines, sentences or paragraphs.

A text is cut into units at its separators. Units are normalised (A-Z
lower-cased, white space collapsed, ends trimmed) and the digests of all that
are not blank grouped over the whole table; the earliest unit of a digest by
(document, place) is its first. Later ones are removed where successive ones
come to at least `min_run_words` words, so a passage that was set into another
line goes and a short phrase that many texts share stays. Offsets count
characters of the original text.

Digests combine before the shuffle. Occurrences of hot digests, at most a
thousand, meet a broadcast of their first places, all others a sort-merge join.
Texts of which nothing goes are not shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediaspan.llm.keyed import by_marks, join_counted, key_marks
from mediaspan.plans.workspace import Workspace

#: A unit ends at a newline, or at one of these, whose blank counts as the separator.
LINES = ("\n",)
SENTENCES = ("\n", ". ", "! ", "? ")
#: Characters of scripts written without blanks; each counts as a word.
UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿]")
#: A word of more characters counts once for each so many.
LONG_WORD = 20
MIN_RUN_WORDS = 20
_ROWS = 50_000
_SPANS = "array<struct<first:long,last:long,unit:long>>"
_UNIT = pa.schema([("doc_id", pa.int64()), ("body", pa.int64()), ("at", pa.int32()), ("unit", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("words", pa.int32()), ("digest", pa.binary())])


def _parted(text: str, ends: tuple[str, ...]) -> list[str]:
    """The units of a text; each but the last is followed by one character of separator."""
    for end in ends:
        text = text.replace(end, end[:-1] + "\n")
    return text.split("\n")


def _weight(unit: str, parts: list[bytes], norm: bytes) -> int:
    """Words of a unit: those between blanks, characters of unspaced scripts, or twentieths of a long word."""
    if unit.isascii():
        return max(len(parts), len(norm) // LONG_WORD)
    return max(len(parts), len(UNSPACED.findall(unit)), len(norm.decode()) // LONG_WORD)


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _UNIT, strict=True)]


def _units(ends: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each unit that is not blank: its number among these and among all, its characters, words and digest."""
        rows: list[tuple] = []
        for batch in batches:
            ids, bodies, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for r in range(batch.num_rows):
                at = start = 0
                for number, unit in enumerate(_parted(texts[r].as_py(), ends)):
                    parts = unit.encode().lower().split()
                    if parts:
                        norm = b" ".join(parts)
                        rows.append((ids[r], bodies[r], at, number, start, start + len(unit), _weight(unit, parts, norm), hashlib.md5(norm).digest()))
                        at += 1
                        if len(rows) >= _ROWS:
                            yield pa.RecordBatch.from_arrays(_columns(rows), schema=_UNIT)
                            rows = []
                    start += len(unit) + 1
        if rows:
            yield pa.RecordBatch.from_arrays(_columns(rows), schema=_UNIT)

    return run


def _without(text: str, spans: list[dict]) -> str:
    """The units that stay, each but the first after its separator."""
    out, at = [], 0
    for s in spans:
        if at < s["first"]:
            out.append(text[at : s["first"] - 1])
        at = s["last"]
    whole = "".join(out) + text[at:]
    return whole[1:] if spans[0]["first"] == 0 else whole


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [_without(text, spans) if spans else text for text, spans in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), batch.column(2), batch.column(3)], ["doc_id", "text", "n_units", "removed"])


def drop_repeated_units(spark: SparkSession, documents: DataFrame, doc_id: str = "doc_id", text: str = "text", ends: tuple[str, ...] = SENTENCES, min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    """(doc_id, text, n_units, removed) for every row with an id.

    Later units go where a run of them, blank units aside, comes to
    min_run_words words (0: all of them go). A unit that goes takes the separator
    before it along, or the one after it if nothing is left before; blank units
    stay. removed lists (first, last + 1, unit) in characters and units of the
    original text. Null text has no units and stays null; an empty one has one
    blank unit. Of rows that share an id and differ in text the order is that of
    a hash of the text; rows alike in both count as one and lose the same units.
    Other columns are ignored.
    """
    work = Workspace(spark, "lines")
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text")).where("doc_id is not null")
    units = work.table(docs.where("text is not null").mapInArrow(_units(ends), "doc_id long, body long, at int, unit int, first int, last int, words int, digest binary"), "units")
    rank = F.struct("doc_id", "body", "at")
    repeated = work.table(units.groupBy("digest").agg(F.min(rank).alias("start"), F.count("*").alias("n")).where("n > 1"), "repeated")
    late = join_counted(units, repeated, ["digest"]).where(F.col("start") != rank).select("doc_id", "body", "at", "unit", "first", "last", "words")
    # Everything of a document lies in one partition from here on.
    once = late.repartition("doc_id", "body").dropDuplicates(["doc_id", "body", "at"])
    runs = once.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy("doc_id", "body").orderBy("at")))
    spans = runs.groupBy("doc_id", "body", "run").agg(F.sum("words").alias("words"), F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("first", "last", "unit")])).alias("spans"))
    gone = spans.where(F.col("words") >= min_run_words).groupBy("doc_id", "body").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("removed"))
    gone = work.table(gone, "gone")
    work.drop("units", "repeated")

    parted = F.col("text")
    for end in ends:
        parted = F.replace(parted, F.lit(end), F.lit(end[:-1] + "\n"))
    n_units = F.coalesce(F.length(parted) - F.length(F.translate(parted, "\n", "")) + 1, F.lit(0)).cast("long").alias("n_units")
    changed, same = by_marks(docs, F.col("doc_id"), key_marks(gone, "doc_id", work, "marks"))
    none = F.array().cast(_SPANS)
    joined = changed.join(gone.hint("merge"), ["doc_id", "body"], "left").select("doc_id", "text", n_units, F.coalesce("removed", none).alias("removed"))
    cut = joined.mapInArrow(_cut, f"doc_id long, text string, n_units long, removed {_SPANS}")
    return cut.unionByName(same.select("doc_id", "text", n_units, none.alias("removed")))
