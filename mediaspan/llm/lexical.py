"""Ranked lexical search by MaxScore with bounds of term pairs.

Documents become forward rows: their number of words and the occurrences of
the searched terms. Runs of forward rows are shards, each an inverted index of
a bounded number of postings in one task; no list of a frequent term is ever
held or shuffled whole. A first pass over the shards makes the pair lists: for
neighbours in the order of an item's weights, how many documents hold both,
their greatest joint impact and the ten best. A joint bound is never above the
sum of the two terms' own, and it is the group bound that the search adds up:
groups of the least bounds that together stay below the tenth best score open
no document, the others' documents are completed from the greatest remaining
bound down, and one that can't reach the tenth best any more is dropped. The
tenth best joint impact of the pair lists is where every shard starts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mediaspan.plans.workspace import Workspace

#: Terms of items that are searched for at a time; what a task has broadcast grows with it alone.
BLOCK_TERMS = 1 << 19
#: Postings of one shard; the forward row that crosses it is still taken in.
SHARD_POSTINGS = 1 << 21
#: Bytes of a text whose words are counted at a time, at least.
SLICE_BYTES = 1 << 21
#: Partial sums of one pair list that meet before the last.
SALTS = 64

# What a term is, once A-Z is lower-cased.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = re.compile(_TERM.encode())
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_FORWARD = "doc_id long, n long, terms array<int>, tfs array<int>"


def term_counts(data: bytes, known: dict[bytes, int]) -> tuple[int, Counter]:
    """The number of terms of a text, and the occurrences of the known ones by their numbers."""
    n, found, start = 0, Counter(), 0
    while start < len(data):
        cut = _GAP.search(data, start + SLICE_BYTES) if len(data) - start > SLICE_BYTES else None
        stop = cut.start() if cut else len(data)
        words = _WORD.findall(data[start:stop].lower())
        n += len(words)
        found.update(map(known.get, words))
        start = stop
    found.pop(None, None)
    return n, found


def forward_rows(documents: DataFrame, known, doc_id: str, text: str) -> DataFrame:
    """A row per document with terms: its length and the numbers and counts of the known terms; known is a broadcast dict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, ends, terms, tfs = [], [], [0], [], []
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                n, found = term_counts(value.as_py() or b"", known.value)
                if n:
                    ids.append(i)
                    lengths.append(n)
                    terms.extend(found.keys())
                    tfs.extend(found.values())
                    ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            columns = [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64())] + [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, _FORWARD)


@dataclass
class Shard:
    """An inverted index: postings of term t are docs[first[t]:first[t + 1]], ascending, with their impacts."""

    ids: np.ndarray
    first: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.first[term], self.first[term + 1])
        return self.docs[at], self.impacts[at]


def shards(batches: Iterator[pa.RecordBatch], weights: np.ndarray, n_docs: int, n_terms: int) -> Iterator[Shard]:
    """Forward rows as indexes of about SHARD_POSTINGS postings."""

    def index(parts: list[tuple]) -> Shard:
        ids, lengths, sizes, terms, tfs = (np.concatenate(c) for c in zip(*parts, strict=True))
        docs = np.repeat(np.arange(len(ids), dtype=np.int64), sizes)
        m = 10 + (90 * lengths * n_docs) // n_terms
        order = np.argsort(terms, kind="stable")
        terms, docs, tfs = terms[order], docs[order], tfs[order].astype(np.int64)
        impacts = weights[terms] * ((1000000000 * tfs) // (1000 * tfs + 8 * m[docs]))
        return Shard(ids, np.searchsorted(terms, np.arange(len(weights) + 1)), docs, impacts)

    parts, held = [], 0
    for whole in batches:
        for start in range(0, whole.num_rows, 1024):
            batch = whole.slice(start, 1024)
            lists = [batch.column(c) for c in ("terms", "tfs")]
            ids = batch.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
            sizes = np.diff(lists[0].offsets.to_numpy())
            parts.append((ids, batch.column("n").to_numpy(), sizes, *(x.flatten().to_numpy() for x in lists)))
            held += int(sizes.sum())
            if held >= SHARD_POSTINGS:
                yield index(parts)
                parts, held = [], 0
    if parts:
        yield index(parts)


@dataclass
class Item:
    """An item's terms in groups of two, or one, least bound first; start is a score that k documents reach."""

    item_id: object
    groups: list[tuple[int, ...]]
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    start: int = 0


def grouped(item_id: object, terms: list[int], weights: np.ndarray) -> Item:
    """Neighbours in the order of weights make a pair; an odd last one stands alone. Terms without weight add nothing and are left out."""
    order = sorted((t for t in terms if weights[t] > 0), key=lambda t: (weights[t], t))
    return Item(item_id, [tuple(order[i : i + 2]) for i in range(0, len(order), 2)])


def _pair_lists(lists, n_docs: int, n_terms: int, k: int) -> Callable:
    """For every pair (a, b), and every term as (a, -1): its documents and their k greatest impacts, of the rows of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        groups, weights = lists.value
        counts, best = np.zeros(len(groups), np.int64), np.zeros((len(groups), k), np.int64)
        for shard in shards(batches, weights, n_docs, n_terms):
            for g, (a, b) in enumerate(groups):
                docs, impacts = shard.list_of(a)
                if b >= 0 and len(docs):
                    others, more = shard.list_of(b)
                    if len(others) < len(docs):
                        docs, impacts, others, more = others, more, docs, impacts
                    at = np.minimum(np.searchsorted(others, docs), max(len(others) - 1, 0))
                    both = others[at] == docs if len(others) else np.zeros(len(docs), bool)
                    impacts = impacts[both] + more[at[both]]
                if len(impacts):
                    counts[g] += len(impacts)
                    top = np.partition(impacts, -k)[-k:] if len(impacts) > k else impacts
                    best[g] = np.sort(np.concatenate([best[g], top]))[: -k - 1 : -1]
        seen = np.flatnonzero(counts)
        a, b = (np.array([groups[g][i] for g in seen], np.int32) for i in (0, 1))
        salt = np.full(len(seen), TaskContext.get().partitionId() % SALTS, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(salt), pa.array(counts[seen]), pa.array(list(best[seen]), pa.list_(pa.int64()))], ["a", "b", "salt", "n", "best"])

    return run


def best_of(shard: Shard, item: Item, k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best of a shard's documents and those found before (scores, ids), best first, of equal scores the smaller id first."""
    threshold = max(item.start, scores[k - 1] if len(scores) == k else 0)
    sums = np.concatenate([[0], np.cumsum(item.bounds)])
    idle = int(np.searchsorted(sums[1:], threshold))  # so many groups together stay below the threshold
    score = np.zeros(len(shard.ids), np.int64)
    for group in item.groups[idle:]:
        for term in group:
            docs, impacts = shard.list_of(term)
            score[docs] += impacts
    kept = np.flatnonzero(score)

    def add(docs: np.ndarray, group: tuple[int, ...], to: np.ndarray) -> None:
        for term in group:
            held, impacts = shard.list_of(term)
            if len(held):
                at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
                to += np.where(held[at] == docs, impacts[at], 0)

    if len(kept) > k and idle:
        likely = kept[np.argpartition(-score[kept], k)[:k]]
        whole = score[likely]
        for group in item.groups[:idle]:
            add(likely, group, whole)
        threshold = max(threshold, int(whole.min()))
    have = score[kept]
    for g in range(idle, -1, -1):
        alive = have + sums[g] >= threshold
        kept, have = kept[alive], have[alive]
        if g and len(kept):
            add(kept, item.groups[g - 1], have)
    scores, ids = np.concatenate([scores, have]), np.concatenate([ids, shard.ids[kept]])
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _search(wanted, n_docs: int, n_terms: int, k: int, id_type) -> Callable:
    """The k best of the rows of one task for every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = wanted.value
        none = np.zeros(0, np.int64)
        found = [(none, none)] * len(items)
        for shard in shards(batches, weights, n_docs, n_terms):
            found = [best_of(shard, item, k, *have) for item, have in zip(items, found, strict=True)]
        for low in range(0, len(found), 4096):
            part = range(low, min(low + 4096, len(found)))
            sizes = [len(found[i][0]) for i in part]
            names = [items[i].item_id for i, size in zip(part, sizes, strict=True) for _ in range(size)]
            scores, ids = (np.concatenate([found[i][c] for i in part]) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(names, id_type), pa.array(ids, mask=ids == np.iinfo(np.int64).max), pa.array(scores)], ["item_id", "doc_id", "score"])

    return run


def _document_counts(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["term", "df"])

    return run


def search(spark: SparkSession, documents: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for every item its k best documents with a score above 0, ranked from 1.

    Rows of one item id are one item with the terms of all its texts, each
    once; null is an id like others. An item without terms finds nothing. Every
    row of documents is a document of its own, also if its id occurs again; a
    document without an id is found under a null id, after equal scores. A null
    text has no terms. Equal scores are ranked by id. Tables without rows give
    none. Other columns of both tables are ignored.

    Items are taken in blocks of about BLOCK_TERMS terms, each a pass over the
    documents; a block's terms, weights and pair bounds are all that the driver
    holds or broadcasts.
    """
    lowered = F.translate(F.col(item_text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = items.select(F.col(item_id).alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit(_TERM), F.lit(0)))).alias("term")).distinct()
    work = Workspace(spark, "lexical")
    terms = work.table(terms, "terms")
    blocks = -(-terms.count() // BLOCK_TERMS)
    schema = f"item_id {items.schema[item_id].dataType.simpleString()}, doc_id long, score long"
    found = None
    for block in range(blocks):
        rows = terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        part = work.table(_block(spark, documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), rows, k, schema, work, block), f"found-{block}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(spark: SparkSession, documents: DataFrame, terms: DataFrame, k: int, schema: str, work: Workspace, block: int) -> DataFrame:
    of_item: dict[object, list[int]] = {}
    known: dict[bytes, int] = {}
    for row in terms.collect():
        of_item.setdefault(row["item_id"], []).append(known.setdefault(row["term"].encode(), len(known)))
    share = spark.sparkContext.broadcast
    forward = work.table(forward_rows(documents, share(known), "doc_id", "text"), f"forward-{block}")
    totals = forward.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = totals["docs"], totals["terms"] or 0
    counted = forward.select("terms").mapInArrow(_document_counts(len(known)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weights = np.zeros(len(known), np.int64)
    for row in counted.collect():
        weights[row["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["df"] + 1)))
    wanted = [item for i, ts in of_item.items() if (item := grouped(i, ts, weights)).groups]
    groups = sorted({(g[0], g[1]) for item in wanted for g in item.groups if len(g) == 2} | {(t, -1) for item in wanted for g in item.groups for t in g})
    part = forward.mapInArrow(_pair_lists(share((groups, weights)), n_docs, n_terms, k), "a int, b int, salt int, n long, best array<long>")
    top = F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, k).alias("best")
    lists = part.groupBy("a", "b", "salt").agg(F.sum("n").alias("n"), top).groupBy("a", "b").agg(F.sum("n").alias("n"), top)
    best = {(r["a"], r["b"]): r["best"] for r in work.table(lists, f"pairs-{block}").select("a", "b", "best").toLocalIterator()}
    for item in wanted:
        alone = {t: best.get((t, -1), [0])[0] for g in item.groups for t in g}
        bound = {g: max(*(alone[t] for t in g), best.get(g, [0])[0] if len(g) == 2 else 0) for g in item.groups}
        item.groups.sort(key=lambda g: (bound[g], g))
        item.bounds = np.array([bound[g] for g in item.groups], np.int64)
        item.start = max(best[key][k - 1] if key in best else 0 for g in item.groups for key in (g, *((t, -1) for t in g)))
    id_type = to_arrow_type(spark.createDataFrame([], schema).schema["item_id"].dataType)
    return forward.mapInArrow(_search(share((wanted, weights)), n_docs, n_terms, k, id_type), schema)
