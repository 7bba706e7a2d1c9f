"""Benchmark decontamination by winnowing.

Both sides keep, of every window of successive k-gram hashes, the least one. A
span of `window` equal words therefore keeps the same k-gram on both sides. Kept
hashes of the documents are joined with those of the benchmark, and every match
is extended word by word to all spans of `window` equal words around it. Items
shorter than the window are one span each and matched by one hash of the whole.

The benchmark is read in blocks of at most `block_words` words (about 40 bytes a
word); one block at a time is indexed and broadcast, whatever its whole size.
Its windows are held once each, with the items they occur in, so a k-gram that
is frequent on both sides costs a look-up a place and no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspan.llm import textbytes as tb
from mediaspan.plans.workspace import Workspace

BLOCK_WORDS = 2_000_000


def _winnow(h: np.ndarray, first: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word position) of the kept k-grams of all rows; h: word hashes, first: rows' offsets."""
    g = tb.grams(h, k)
    span = window - k + 1
    n = len(g) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least, at = g[:n].copy(), np.arange(n)
    for j in range(1, span):
        lower = g[j : j + n] <= least  # the rightmost of equal ones
        least[lower] = g[j : j + n][lower]
        at[lower] = np.flatnonzero(lower) + j
    row = np.searchsorted(first, np.arange(n), side="right") - 1
    inside = np.arange(n) + window <= first[row + 1]
    kept = np.unique(at[inside])
    return g[kept], kept


def _grouped(keys: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, where each one's items begin, items): items once a key. keys: a row of words a key."""
    order = np.lexsort((items, *keys.T[::-1]))
    keys, items = keys[order], items[order]
    new_key = np.ones(len(keys), dtype=bool)
    new_key[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    fresh = new_key.copy()
    fresh[1:] |= items[1:] != items[:-1]
    keys, items, new_key = keys[fresh], items[fresh], new_key[fresh]
    begins = np.flatnonzero(new_key)
    return keys[begins], np.append(begins, len(keys)), items


def _windows(h: np.ndarray, h2: np.ndarray, size: int, place: np.ndarray) -> np.ndarray:
    """Two hashes a run of size words that begins at a place."""
    out = np.empty((len(place), 2), dtype=np.uint64)
    for column, words in enumerate((h, h2)):
        total = np.zeros(len(place), dtype=np.uint64)
        for j in range(size):
            total += words[place + j] * tb.powers(0xA0761D6478BD642F, size + 1)[j + 1]
        out[:, column] = tb.mix(total)
    return out


def _around(place: np.ndarray, first: np.ndarray, k: int, window: int) -> np.ndarray:
    """Begins of the windows, each inside its row, that hold a k-gram at one of the places."""
    row = np.searchsorted(first, place, side="right") - 1
    starts = place[:, None] - np.arange(window - k + 1)
    inside = (starts >= first[row][:, None]) & (starts + window <= first[row + 1][:, None])
    return np.unique(starts[inside])


class Index:
    """Fingerprints and windows of a block of items. Words of all items lie one after the other."""

    def __init__(self, rows: list[tuple], k: int, window: int):
        texts = [(i, t) for i, t in rows if t is not None]
        self.items, self.k, self.window = [str(i) for i, _ in texts], k, window
        data = np.frombuffer("".join(t for _, t in texts).encode(), dtype=np.uint8)
        at = np.cumsum([0, *(len(t.encode()) for _, t in texts)])
        w = tb.words(data, at, tb.ALNUM)
        h, h2 = w.hashes(), w.hashes(1)
        prints, where = _winnow(h, w.first, k, window)
        self.prints = np.unique(prints)
        starts = _around(where, w.first, k, window)
        owner = np.searchsorted(w.first, starts, side="right") - 1
        self.spans = {window: _grouped(_windows(h, h2, window, starts), owner)}
        sizes = np.diff(w.first)
        for size in sorted({int(s) for s in sizes if 0 < s < window}):
            mine = np.flatnonzero(sizes == size)
            self.spans[size] = _grouped(_windows(h, h2, size, w.first[mine]), mine)


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each wanted key its place among the sorted distinct keys, or -1."""
    if not len(keys) or not len(wanted):
        return np.full(len(wanted), -1)
    low, high = (np.searchsorted(keys[:, 0], wanted[:, 0], side=s) for s in ("left", "right"))
    place = np.full(len(wanted), -1)
    # Keys with one first hash are few: step through them until the second hash fits.
    for step in range(int((high - low).max(initial=0))):
        at = np.minimum(low + step, len(keys) - 1)
        place = np.where((low + step < high) & (keys[at, 1] == wanted[:, 1]), at, place)
    return place


def _hits(w: tb.Words, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word start, length) of every occurrence of a window of an item, and (row, item) pairs, each once."""
    h, h2 = w.hashes(), w.hashes(1)
    none = np.zeros(0, np.int64)
    starts, lengths, rows, items = [none], [none], [none], [none]
    for size, (keys, begins, owners) in index.spans.items():
        if size == index.window:
            keep, where = _winnow(h, w.first, index.k, size)
            place = _around(where[np.isin(keep, index.prints)], w.first, index.k, size)
        else:
            place = np.arange(len(h) - size + 1)
            place = place[place + size <= w.first[np.searchsorted(w.first, place, side="right")]] if len(place) else place
        key = _found(keys, _windows(h, h2, size, place))
        place, key = place[key >= 0], key[key >= 0]
        starts.append(place)
        lengths.append(np.full(len(place), size))
        # Each key once a row, then its items: no more than the rows' own lists before they are made distinct.
        pairs = np.unique(np.stack([w.row[place], key], axis=1), axis=0) if len(place) else np.zeros((0, 2), np.int64)
        n = begins[pairs[:, 1] + 1] - begins[pairs[:, 1]]
        rows.append(np.repeat(pairs[:, 0], n))
        items.append(owners[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[pairs[:, 1]], n)])
    pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(items)], axis=1), axis=0)
    return np.concatenate(starts), np.concatenate(lengths), pairs[:, 0], pairs[:, 1]


def _match(index_of, text_at: int, names: list[str]) -> Callable:
    """Adds n_words, hit spans (first word, last word + 1) and items to the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of.value
        for batch in batches:
            for low, high, data, at in tb.slices(batch.column(text_at)):
                w = tb.words(data, at, tb.ALNUM)
                starts, lengths, rows, items = _hits(w, index)
                spans: list[list] = [[] for _ in range(high - low)]
                found: list[list] = [[] for _ in range(high - low)]
                if len(starts):
                    edge = np.zeros(len(w.start) + 1, dtype=np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + lengths, -1)
                    hit = np.cumsum(edge[:-1]) > 0
                    change = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
                    # runs that touch across rows are cut where a row begins
                    cuts = w.first[1:-1]
                    cuts = cuts[(cuts > 0) & (cuts < len(hit))]
                    cuts = cuts[hit[cuts] & hit[cuts - 1]]
                    a, b = np.sort(np.concatenate([change[::2], cuts])), np.sort(np.concatenate([change[1::2], cuts]))
                    for x, y in zip(a.tolist(), b.tolist(), strict=True):
                        r = w.row[x]
                        spans[r].append({"first": x - int(w.first[r]), "last": y - int(w.first[r])})
                    for r, i in zip(rows.tolist(), items.tolist(), strict=True):
                        found[r].append(index.items[i])
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.diff(w.first)), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(found, pa.list_(pa.string()))],
                    [*names, "n_words", "spans", "items"],
                )

    return run


def blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size (an item is at least one block's part), one at a time; at least one block."""
    rows, words, any_ = [], 0, False
    for r in benchmark.select(item_id, text).toLocalIterator():
        rows.append((r[0], r[1]))
        words += len(r[1] or "") // 2 + 1
        if words >= block_words:
            yield rows
            rows, words, any_ = [], 0, True
    if rows or not any_:
        yield rows


_HITS = "n_words long, spans array<struct<first:long,last:long>>, items array<string>"


def _joined_spans(spans: str) -> Column:
    """Sorted spans with those that touch or overlap made one."""
    return F.aggregate(
        spans,
        F.array().cast("array<struct<first:long,last:long>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["last"] >= x["first"]),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], x["last"]).alias("last")))),
        ).otherwise(F.concat(done, F.array(x))),
    )


def benchmark_hits(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, spans, items): words covered by any occurrence of an item's window, and those items.

    A row per document row with the words of its whole text, whatever its id
    (null and repeated ids too); null text has no words. An empty benchmark hits
    nothing. Items without words are ignored; repeated items count under each of
    their ids. Other columns are ignored. A benchmark of several blocks takes a
    written, numbered copy of the documents and a pass over it a block.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    todo = blocks(benchmark, item_id, item_text, block_words)
    rows, after = next(todo), next(todo, None)
    if after is None:
        index = spark.sparkContext.broadcast(Index(rows, k, window))
        return docs.mapInArrow(_match(index, 1, ["doc_id", "text"]), f"doc_id {kind}, text string, {_HITS}").drop("text")
    work = Workspace(spark, "benchmark")
    numbered = work.table(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "documents")
    passes: list[DataFrame] = []
    while rows is not None:
        index = spark.sparkContext.broadcast(Index(rows, k, window))
        found = numbered.mapInArrow(_match(index, 2, ["row", "doc_id", "text"]), f"row long, doc_id {kind}, text string, {_HITS}").drop("text")
        # The first pass writes every row, the others those with hits.
        passes.append(work.table(found.where(F.size("items") > 0) if passes else found, f"pass-{len(passes)}"))
        index.destroy()
        rows, after = after, next(todo, None)
    hits = passes[0].where(F.size("items") > 0)
    for one in passes[1:]:
        hits = hits.unionByName(one)
    gathered = hits.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("i"))
    every = passes[0].join(gathered.hint("merge"), "row", "left")
    return every.select("doc_id", "n_words", F.coalesce(_joined_spans("s"), "spans").alias("spans"), F.coalesce("i", "items").alias("items"))


def without_benchmark(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents in which no window of any item occurs, all columns kept.

    Rows without a text or an id stay, as do repeated ones. Each block of the
    benchmark takes one pass over what the earlier ones left, written between.
    """
    left, names, work, done = documents, documents.columns, Workspace(spark, "clean"), 0
    todo = blocks(benchmark, item_id, item_text, block_words)
    rows, after = next(todo), next(todo, None)
    while rows is not None:
        index = spark.sparkContext.broadcast(Index(rows, k, window))
        inner = [f"c{i}" for i in range(len(names))]
        schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(inner, left.schema, strict=True))
        matched = left.toDF(*inner).mapInArrow(_match(index, names.index(text), inner), f"{schema}, {_HITS}")
        left = matched.where(F.size("items") == 0).select(*[F.col(i).alias(n) for i, n in zip(inner, names, strict=True)])
        if after is not None:
            left, done = work.table(left, f"pass-{done}"), done + 1
        rows, after = after, next(todo, None)
    return left
