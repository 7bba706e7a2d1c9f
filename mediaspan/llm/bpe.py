"""Byte-pair encoding by a priority queue of merges, and decoding.

A word is a doubly linked list of symbols, at first its bytes. Every pair of
neighbours that the vocabulary can merge lies in a heap by rank and place. The
least is taken, its right symbol leaves the list, and the pairs on both sides
enter the heap; an entry whose pair has changed since is stale and skipped.
Words that occur again are not merged again within a Python worker.
"""

from __future__ import annotations

import heapq
import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from mediaspan.llm.tokens import vocabulary

# The split of byte-level vocabularies into words.
SPLIT = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\p{White_Space}\p{L}\p{N}]++|\p{White_Space}++$|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}++")
#: A word starts at such a blank, whatever stands around it.
_CUT = regex.compile(r"(?<=\P{White_Space}) ")
_LITTLE = array("I", [1]).tobytes() == b"\x01\x00\x00\x00"
#: Characters that are split at a time, at least.
SLICE = 1 << 19
#: Words whose ids a worker remembers, and the longest of them.
MEMORY, LONGEST = 1 << 17, 64
#: Bytes of ids or texts in one batch of results.
BATCH = 1 << 23


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the strings of a vocabulary: visible Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(own))
    return {chr(b): b for b in own} | {chr(0x100 + n): b for n, b in enumerate(others)}


class Vocabulary(dict):
    """Strings and merges of one vocabulary file; as a dict it remembers the packed ids of words.

    When it holds MEMORY words it starts anew, and words that occur again are taken over.
    """

    def __init__(self, path: str):
        found = json.loads(Path(path).read_text(encoding="utf-8"))
        ids, letters = found["model"]["vocab"], byte_letters()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in found["model"]["merges"]]
        self.ranks = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [ids[a + b] for a, b in pairs]
        self.of_byte = [ids[letter] for letter, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.older: dict[str, bytes] = {}
        self.added = {t["content"]: t["id"] for t in found.get("added_tokens", [])}
        self.bytes = {i: bytes(letters[c] for c in s) if all(c in letters for c in s) else s.encode() for s, i in ids.items()} | {i: s.encode() for s, i in self.added.items()}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        n = len(word)
        ids = [self.of_byte[b] for b in word]
        get, merged, width = self.ranks.get, self.merged, n.bit_length()
        heap = [rank << width | at for at in range(n - 1) if (rank := get(ids[at] << 32 | ids[at + 1])) is not None]
        if not heap:
            return ids
        heapq.heapify(heap)
        ids.append(-1)  # the end, which merges with nothing
        before, after, mask = list(range(-1, n)), list(range(1, n + 2)), (1 << width) - 1
        while heap:
            top = heapq.heappop(heap)
            rank, at = top >> width, top & mask
            here, right = ids[at], after[at]
            if here < 0 or get(here << 32 | ids[right]) != rank:
                continue
            ids[at], ids[right] = merged[rank], -1
            here = ids[at]
            after[at] = right = after[right]
            before[right] = at
            if (rank := get(here << 32 | ids[right])) is not None:
                heapq.heappush(heap, rank << width | at)
            left = before[at]
            if left >= 0 and (rank := get(ids[left] << 32 | here)) is not None:
                heapq.heappush(heap, rank << width | left)
        return [i for i in ids if i >= 0]

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            packed = pack(self.merge(word.encode()))
        if len(word) <= LONGEST:
            if len(self) >= MEMORY:
                self.older = dict(self)
                self.clear()
            self[word] = packed
        return packed

    def encode(self, text: str, special_tokens: bool) -> bytes:
        """Packed ids of a text."""
        parts: list[bytes] = []
        start = 0
        for found in self.special.finditer(text) if special_tokens and self.special else ():
            self._ordinary(text, start, found.start(), parts)
            parts.append(pack([self.added[found[0]]]))
            start = found.end()
        self._ordinary(text, start, len(text), parts)
        return b"".join(parts)

    def _ordinary(self, text: str, start: int, end: int, parts: list[bytes]) -> None:
        while start < end:
            cut = _CUT.search(text, start + SLICE, end) if end - start > SLICE else None
            stop = cut.start() if cut else end
            parts.append(b"".join(map(self.__getitem__, SPLIT.findall(text[start:stop]))))
            start = stop

    def decode(self, ids: list[int]) -> str:
        """The strings of the ids, joined; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes() if _LITTLE else b"".join(i.to_bytes(4, "little") for i in ids)


@lru_cache(maxsize=2)
def _load(path: str) -> Vocabulary:
    return Vocabulary(path)


def load(name: str) -> Vocabulary:
    """The vocabulary of a name among the installed files, or of a path; once a Python worker."""
    return _load(name if os.path.isabs(name) else vocabulary(name))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (.., large value) as batches of about BATCH bytes."""
    kept, held = [], 0
    for row in rows:
        kept.append(row)
        held += len(row[-1])
        if held >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)
            kept, held = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)


def encode(documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", special_tokens: bool = True) -> DataFrame:
    """(doc_id, ids): the ids of every whole text, packed as little-endian unsigned 32-bit integers.

    tokenizer is a .json file of a byte-level vocabulary. With special_tokens
    the string of an added token in a text becomes its id, as the library of
    that file has it; else it is ordinary text. A null or empty text has no
    ids. Every row is encoded, repeated ids as often as they occur, and null
    ids too; an empty table gives none. Other columns are ignored. Texts are
    split SLICE characters at a time; the longest word, which only a text
    without blanks makes long, takes some 100 bytes of memory a byte.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = load(tokenizer)
        rows = ((i.as_py(), known.encode(t.as_py() or "", special_tokens)) for batch in batches for i, t in zip(batch.column(0), batch.column(1), strict=True))
        yield from _batches(rows, pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())]))

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, ids, text): the text of every row of ids, packed or an array of integers.

    The strings of added tokens are kept. Null or no ids give the empty text.
    An id outside the vocabulary, or a packed value that is no multiple of four
    bytes, is an error.
    """
    packed = isinstance(encoded.schema[ids].dataType, BinaryType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = load(tokenizer)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i, value in zip(batch.column(0), batch.column(1), strict=True):
                    value = value.as_py()
                    if not packed:
                        value = None if value is None else pack(value)
                    yield i.as_py(), value, known.decode(unpack(value or b""))

        yield from _batches(rows(), pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())]))

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, ids binary, text string")


def unpack(value: bytes) -> list[int]:
    """The ids of a packed value."""
    return memoryview(value).cast("I").tolist() if _LITTLE else [int.from_bytes(value[p : p + 4], "little") for p in range(0, len(value), 4)]


def ids_array(rows: DataFrame, column: str = "ids") -> DataFrame:
    """rows with packed ids as an array of integers."""
    four = F.regexp_extract_all(F.hex(column), F.lit("(..)(..)(..)(..)"), F.lit(0))
    value = lambda h: F.conv(F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)), 16, 10).cast("int")
    return rows.withColumn(column, F.transform(four, value))
