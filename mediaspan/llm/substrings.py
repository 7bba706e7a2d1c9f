"""Repeated substrings of whole texts, by sampled suffixes.

A difference cover is a set of sampled offsets such that any two equal strings
have a sample at the same place in both. By offset modulo three, every byte
takes part in sorts of triples and names; here the sample is chosen by content
instead: of all k-grams of a window of `length` bytes the least hash is
sampled, so equal windows sample the same place, at one sample in about 40
bytes. A sampled suffix is named by its k-gram; equal names are told apart by
the name of the context that all windows of the sample cover; windows of
contexts that share only the k-gram are merged by comparing every window of
the context. Strings count as equal if two hashes of 64 bits are: that of their
k-gram and that of the context or window.

Copies of whole texts are set aside first. Long texts are sampled in pieces
that overlap, so length has no bound. No name's group meets in one task unless
it is small: minima combine before the shuffle, hot names and contexts (a
thousand at most) meet broadcasts, and the contexts of a frequent name are
dealt to salted groups, each of which puts forward only its first occurrence of
a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspan.llm import textbytes as tb
from mediaspan.llm.keyed import by_marks, join_counted, key_marks
from mediaspan.plans.workspace import Workspace

GRAM = 24
#: Names with more contexts than this are dealt to groups of about this many.
FREQUENT = 64
#: Windows of a text that are sampled at a time.
PIECE = 1 << 20
_SPANS = "array<struct<first:long,last:long>>"
_LOW = np.uint64((1 << 24) - 1)


def _sampled(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, sample, first window, last window, name, context) of each sample of the rows."""
    n, span = len(data) - length + 1, length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none, none
    sums = tb.prefix_sums(data, tb.BASES[0])
    place = np.arange(len(data) - GRAM + 1)
    grams = tb.range_hash(sums, place, place + GRAM, tb.BASES[0])
    # The least hash of each window, the leftmost of equal ones: place fills the low bits.
    least = (grams & ~_LOW) | place.astype(np.uint64)
    done = 1
    while done * 2 <= span:
        least = np.minimum(least[: len(least) - done], least[done:])
        done *= 2
    least = np.minimum(least[:n], least[span - done : span - done + n])
    sample = (least & _LOW).astype(np.int64)
    row = np.searchsorted(at, np.arange(n), side="right") - 1
    whole = np.arange(n) + length <= at[row + 1]
    change = np.ones(n, dtype=bool)
    change[1:] = (sample[1:] != sample[:-1]) | (row[1:] != row[:-1]) | ~whole[:-1]
    first = np.flatnonzero(change & whole)
    ends = np.ones(n, dtype=bool)
    ends[:-1] = change[1:] | ~whole[1:]
    last = np.flatnonzero(ends & whole)
    s = sample[first]
    shape = ((s - first).astype(np.uint64) << np.uint64(8)) | (last - first).astype(np.uint64)
    context = tb.mix(tb.range_hash(sums, first, last + length, tb.BASES[0]) + shape)
    return row[first], s, first, last, grams[s].view(np.int64), context.view(np.int64)


def pieces(data: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bytes before, bytes, offsets) of a slice; a single long row comes in pieces that overlap by all but one byte of a window.

    Every window lies in one piece. One whose sample reaches over the cut has
    two contexts there, which are then compared window by window.
    """
    if len(at) > 2 or len(data) <= PIECE + length:
        yield 0, data, at
        return
    for start in range(0, len(data) - length + 1, PIECE):
        part = data[start : start + PIECE + length - 1]
        yield start, part, np.array([0, len(part)])


def _samples(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for low, _, data, at in tb.slices(batch.column(1)):
                for before, part, offsets in pieces(data, at, length):
                    row, _, first, last, name, context = _sampled(part, offsets, length)
                    base = offsets[row] - before
                    yield pa.RecordBatch.from_arrays([pa.array(ids[low + row]), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32)), pa.array(name), pa.array(context)], ["id", "first", "last", "name", "context"])

    return run


def _contexts(length: int):
    """The bytes of the listed contexts of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, lists = batch.column(1).cast(pa.binary()), batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for r, (one, spans) in enumerate(zip(ids, lists, strict=True)):
                text = texts[r].as_py()
                column = lambda key, kind: pa.array([s[key] for s in spans], kind)  # noqa: E731, B023
                bodies = pa.array([text[s["first"] : s["last"] + length] for s in spans], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(spans), pa.int64()), column("first", pa.int32()), column("name", pa.int64()), column("salt", pa.int32()), column("hot", pa.bool_()), bodies], ["id", "first", "name", "salt", "hot", "body"])

    return run


def _later(length: int):
    """Of rows sorted by name and salt, whose groups stay together: (id, first, last) runs of windows that
    occur earlier in the group; and, of names in several groups, the group's first occurrence of each window."""

    def ranges(rows: pa.Table) -> pa.RecordBatch:
        ids, first = rows.column("id").to_numpy(), rows.column("first").to_numpy().astype(np.int64)
        bodies = rows.column("body").to_pylist()
        sizes = np.array([len(b) for b in bodies])
        sums = tb.prefix_sums(np.frombuffer(b"".join(bodies), np.uint8), tb.BASES[0])
        count = sizes - length + 1
        row = np.repeat(np.arange(len(sizes)), count)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = (np.cumsum(sizes) - sizes)[row] + inner
        window = tb.range_hash(sums, start, start + length, tb.BASES[0])
        doc, place, hot, name = ids[row], first[row] + inner, rows.column("hot").to_numpy()[row], rows.column("name").to_numpy()[row]
        order = np.lexsort((place, doc, window, name))
        window, doc, place, hot, name = window[order], doc[order], place[order], hot[order], name[order]
        again = np.concatenate([[False], (window[1:] == window[:-1]) & (name[1:] == name[:-1])])
        open_ = ~again & hot
        open_doc, open_place, open_window, open_name = doc[open_], place[open_], window[open_].view(np.int64), name[open_]
        doc, place = doc[again], place[again]
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)])) if len(doc) else np.zeros(0, int)
        tail = np.concatenate([cut[1:] - 1, [len(doc) - 1]]) if len(doc) else cut
        columns = [
            pa.array(np.concatenate([doc[cut], open_doc])),
            pa.array(np.concatenate([place[cut], open_place]).astype(np.int32)),
            pa.array(np.concatenate([place[tail], open_place]).astype(np.int32)),
            pa.concat_arrays([pa.nulls(len(cut), pa.int64()), pa.array(open_window)]),
            pa.concat_arrays([pa.nulls(len(cut), pa.int64()), pa.array(open_name)]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["id", "first", "last", "window", "name"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < 20_000:
                continue
            rows = pa.Table.from_batches(held)
            names, salts = rows.column("name").to_numpy(), rows.column("salt").to_numpy()
            whole = int(np.flatnonzero((names != names[-1]) | (salts != salts[-1])).max(initial=-1)) + 1
            if whole:
                yield ranges(rows.slice(0, whole))
            held, n = rows.slice(whole).to_batches(), rows.num_rows - whole
        if n:
            yield ranges(pa.Table.from_batches(held))

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bytes without the runs of windows, and the removed spans."""
        for batch in batches:
            texts, copies, runs = batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            kept, spans, sizes = [], [], []
            for r, (copy, own) in enumerate(zip(copies, runs, strict=True)):
                text = texts[r].as_py() or b""
                n = len(text)
                merged: list[list[int]] = []
                for s in [{"first": 0, "last": n - length}] if copy and n >= length else sorted(own or [], key=lambda s: s["first"]):
                    if merged and s["first"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["last"] + length)
                    else:
                        merged.append([s["first"], s["last"] + length])
                edges = [0, *(x for span in merged for x in span), n]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"first": a, "last": b} for a, b in merged])
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))], ["doc_id", "kept", "n_bytes", "removed"])

    return run


def drop_repeated_substrings(spark: SparkSession, documents: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """(doc_id, kept, n_bytes, removed) of every row with an id; kept is what is left of the UTF-8 bytes.

    Removed is each byte covered by a string of `length` bytes that also starts
    earlier (in a smaller id, or before in the same text); strings never cross
    documents and are judged on the input. Null is empty. Ids are taken to be
    unique; rows that share one are cut alike. Other columns are ignored.
    """
    work = Workspace(spark, "substrings")
    docs = documents.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("id is not null")
    digests = work.table(docs.select("id", F.unhex(F.sha2("text", 256)).alias("digest")), "digests")
    firsts = work.table(digests.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1"), "firsts")
    copies = work.table(join_counted(digests, firsts, ["digest"]).where("id <> first_id").select("id"), "copies")
    # Texts are not shuffled to leave the copies out: the few rows that share a hashed id with one are joined.
    marked, unmarked = by_marks(docs, F.col("id"), key_marks(copies, "id", work, "copy-marks"))
    single = unmarked.unionByName(marked.join(copies.hint("merge"), "id", "left_anti"))

    samples = work.table(single.mapInArrow(_samples(length), "id long, first int, last int, name long, context long"), "samples")
    names = work.table(samples.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "names")
    shared = work.table(join_counted(samples, names, ["name"]).drop("n"), "shared")
    work.drop("samples", "digests", "names")
    place = F.struct("id", "first")
    earliest = shared.groupBy("name", "context").agg(F.min(place).alias("start"), F.count("*").alias("n"), F.min_by("last", place).alias("last"))
    earliest = work.table(earliest, "earliest")
    repeated = work.table(earliest.where("n > 1").select("name", "context", "start", "n"), "contexts")
    late = join_counted(shared, repeated, ["name", "context"]).where((F.col("id") != F.col("start.id")) | (F.col("first") != F.col("start.first"))).select("id", "first", "last")
    late = work.table(late, "late")

    # Names with several contexts: windows of different contexts may still be equal.
    several = work.table(earliest.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "several")
    hot = F.col("n") > FREQUENT
    salt = F.when(hot, F.pmod(F.xxhash64("start.id", "start.first"), F.ceil(F.col("n") / FREQUENT))).otherwise(0).cast("int")
    mixed = join_counted(earliest.drop("n"), several, ["name"]).select(F.col("start.id").alias("id"), F.col("start.first").alias("first"), "last", "name", salt.alias("salt"), hot.alias("hot"))
    listed = work.table(mixed.groupBy("id").agg(F.collect_list(F.struct("first", "last", "name", "salt", "hot")).alias("spans")), "listed")
    marked, _ = by_marks(docs, F.col("id"), key_marks(listed, "id", work, "listed-marks"))
    bodies = marked.join(listed.hint("merge"), "id").select("id", "text", "spans").mapInArrow(_contexts(length), "id long, first int, name long, salt int, hot boolean, body binary")
    compared = bodies.repartition("name", "salt").sortWithinPartitions("name", "salt").mapInArrow(_later(length), "id long, first int, last int, window long, name long")
    compared = work.table(compared, "compared")
    # Each group of a frequent name has put forward its first of each window: the least of these is the first of all.
    windows = compared.where("window is not null")
    known = work.table(windows.groupBy("name", "window").agg(F.min(place).alias("start"), F.count("*").alias("n")).where("n > 1"), "known")
    many = join_counted(windows, known, ["name", "window"]).where((F.col("id") != F.col("start.id")) | (F.col("first") != F.col("start.first")))
    found = late.unionByName(compared.where("window is null").drop("window", "name")).unionByName(many.select("id", "first", "last"))
    marks = found.withColumn("copy", F.lit(False)).unionByName(copies.select("id", F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), F.lit(True).alias("copy")))
    spans = F.collect_list(F.when(~F.col("copy"), F.struct("first", "last")))
    marks = work.table(marks.groupBy("id").agg(F.max("copy").alias("copy"), spans.alias("runs")), "runs")
    work.drop("shared", "earliest", "listed", "compared", "late", "contexts", "known", "several")
    changed, same = by_marks(docs, F.col("id"), key_marks(marks, "id", work, "marks"))
    cut = changed.join(marks.hint("merge"), "id", "left").select("id", "text", "copy", "runs").mapInArrow(_cut(length), f"doc_id long, kept binary, n_bytes long, removed {_SPANS}")
    return cut.unionByName(same.select(F.col("id").alias("doc_id"), F.encode("text", "UTF-8").alias("kept"), F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast(_SPANS).alias("removed")))
