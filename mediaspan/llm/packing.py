"""Packing of tokenised documents into training sequences by best-fit decreasing.

Overlong documents are first cut into full windows. The rest is placed longest
first, each piece into the tightest open window that holds it; a segment tree
indexed by remaining capacity finds that window. Pieces of one length are
interchangeable, so the placement runs on the histogram of lengths (at most
`capacity` rows, whatever the corpus) and yields runs: "the next n pieces of
length l go to sequences s, s+1, ..., k each". The pieces themselves never
meet: each finds its run by its length and its rank within that length, and
the ranks are counted in salted groups.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediaspan.llm.tokens import encoder
from mediaspan.plans.workspace import Workspace

#: Groups into which the pieces of one length are dealt for ranking.
SALTS = 1024


class OpenWindows:
    """How many windows are open at each remaining capacity, in a segment tree."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.ids: list[deque] = [deque() for _ in range(capacity + 1)]

    def put(self, room: int, first: int, last: int) -> None:
        """Windows first .. last-1 have this much room."""
        if first < last:
            self.ids[room].append((first, last))
            self._count(room, last - first)

    def take(self, room: int, most: int) -> tuple[int, int]:
        """At most so many windows with this room, off the front."""
        first, last = self.ids[room].popleft()
        if last - first > most:
            self.ids[room].appendleft((first + most, last))
            last = first + most
        self._count(room, first - last)
        return first, last

    def tightest(self, size: int) -> int | None:
        """The least room of an open window that holds the size."""
        node = size + self.leaves
        while not self.open[node]:
            while node % 2:  # a right child: its parent has nothing further right
                node //= 2
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.leaves

    def _count(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.open[node] += change
            node //= 2


def place(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces a sequence, first offset, first sequence), sorted."""
    windows, made, runs = OpenWindows(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            room = windows.tightest(length)
            if room is None:
                need = -(-(count - rank) // (capacity // length))
                windows.put(capacity, made, made + need)
                made, room = made + need, capacity
            each = min(room // length, count - rank)
            first, last = windows.take(room, (count - rank) // each)
            runs.append((length, rank, each, capacity - room, first))
            windows.put(room - each * length, first, last)
            rank += each * (last - first)
    return sorted(runs)


def token_pieces(documents: DataFrame, doc_id: str, text: str, tokenizer: str, end_id: int | None, capacity: int, keep_ids: bool = False) -> DataFrame:
    """One row per piece: a document's ids cut every `capacity` ids, with their CRC-32 and on demand the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for row in range(batch.num_rows):
                found = encode(batch.column(1)[row].as_py() or "")
                if end_id is not None:
                    found.append(end_id)
                tokens = np.array(found, dtype="<u4")
                for start in range(0, len(tokens), capacity):
                    piece = tokens[start : start + capacity]
                    for column, value in zip(out, (ids[row], start, len(piece), zlib.crc32(piece), len(tokens), piece.astype(np.int32) if keep_ids else None), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out[:5]] + ([pa.array(out[5], pa.list_(pa.int32()))] if keep_ids else []), names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def pack(spark: SparkSession, documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = 1, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    A null or empty text is a document of the end id alone (without an end id
    it has no piece). Repeated rows and ids are packed as often as they occur.
    An empty table gives no rows. Other columns of the input are ignored.
    """
    work = Workspace(spark, "pack")
    pieces = work.table(token_pieces(documents, doc_id, text, tokenizer, end_id, capacity, keep_ids), "pieces")
    lengths = pieces.select("doc_id", "start", "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)))
    counts = work.table(lengths.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(place(histogram, capacity), dtype=np.int64).reshape(-1, 5)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start")
    ranked = salted.join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(order) - 1).drop("before", "salt")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema)
    return ranked.mapInArrow(_find_runs(spark.sparkContext.broadcast(runs)), f"{schema}, sequence_id long, offset long").drop("rank")


def _find_runs(runs) -> Callable:
    """The run that holds a rank of a length gives sequence and offset; runs are bounded by the capacity squared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, each, offset, sequence = runs.value.T
        keys = length << 44 | first
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, size << 44 | rank, side="right") - 1
            past = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sequence[at] + past // each[at]), pa.array(offset[at] + past % each[at] * size)],
                [*batch.schema.names, "sequence_id", "offset"],
            )

    return run


def sequences(packed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, doc_ids, offsets): the padded ids of each sequence, from pack(keep_ids=True).

    A sequence is padded to the capacity unless it holds a power of two of ids.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "ids")))
    whole = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    used = F.size("ids")
    pad = F.when(F.bit_count(used.cast("long")) == 1, F.lit(0)).otherwise(F.lit(capacity) - used)
    return whole.select("sequence_id", ids.alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets")).withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id), pad)))
