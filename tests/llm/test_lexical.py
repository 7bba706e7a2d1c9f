"""Ranked search against brute force, over shards and blocks of any size."""

import collections
import math
import random
import re

import pytest

from mediaspan.llm import lexical
from mediaspan.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [t.translate({i: i + 32 for i in range(65, 91)}) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """docs: (doc_id, text); items: (item_id, text)."""
    held = [(i, ts) for i, t in docs if (ts := terms_of(t))]
    n_docs, total = len(held), sum(len(ts) for _, ts in held)
    counts = [collections.Counter(ts) for _, ts in held]
    df = collections.Counter(t for c in counts for t in c)
    wanted = collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms_of(t))
    out = []
    for item, ts in wanted.items():
        scores = []
        for (i, words), c in zip(held, counts, strict=True):
            m = 10 + (90 * len(words) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **options):
    rows = lexical.search(spark, docs, items, **options).collect()
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in rows), key=repr)


def made(seed, n=300, words=40):
    rnd = random.Random(seed)
    pool = [f"t{i}" for i in range(words)]
    text = lambda most: " ".join(rnd.choices(pool, [1 / (i + 1) for i in range(words)], k=rnd.randint(0, most)))
    return [(i, text(60)) for i in range(n)], [(i, text(12)) for i in range(25)]


@pytest.mark.parametrize("postings,terms", [(1 << 21, 1 << 19), (50, 1 << 19), (300, 40)])
def test_shards_and_blocks(spark, monkeypatch, postings, terms):
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", terms)
    docs, items = made(postings + terms)
    schema = "id long, text string"
    got = found(spark, spark.createDataFrame(docs, schema).withColumnRenamed("id", "doc_id"), spark.createDataFrame(items, schema).withColumnRenamed("id", "item_id"))
    assert got == brute(docs, items)


def test_shards_of_one_task_share_their_threshold():
    """best_of over many small shards equals a plain ranking."""
    import numpy as np

    rnd = np.random.default_rng(3)
    weights = np.arange(12, 0, -1) * 100
    item = lexical.grouped("i", list(range(12)), weights)
    dense = rnd.integers(0, 2, (400, 12)) * rnd.integers(1, 50, (400, 12))
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    item.bounds = np.array([max(dense[:, list(g)].sum(axis=1)) for g in item.groups])
    order = np.argsort(item.bounds, kind="stable")
    item.groups, item.bounds = [item.groups[g] for g in order], item.bounds[order]
    for low in range(0, 400, 23):
        part = dense[low : low + 23]
        lists = [np.flatnonzero(part[:, t]) for t in range(12)]
        shard = lexical.Shard(np.arange(low, low + len(part)), np.cumsum([0] + [len(x) for x in lists]), np.concatenate(lists), np.concatenate([part[x, t] for t, x in enumerate(lists)]))
        found = lexical.best_of(shard, item, 10, *found)
    whole = dense.sum(axis=1)
    best = np.lexsort((np.arange(400), -whole))[:10]
    assert list(found[1]) == list(best) and list(found[0]) == list(whole[best])


def test_odd_rows_ties_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SLICE_BYTES", 20)
    docs = [(1, "Alpha beta"), (2, "alpha BETA"), (3, None), (4, ""), (5, " .,;"), (2, "alpha beta"), (None, "alpha beta"), (7, "ß Straße ALPHA"), (8, "gamma " * 5000 + "alpha"), (9, "x" * 5000)] + [(100 + i, "tie word") for i in range(15)]
    items = [(1, "alpha beta gamma"), (2, None), (3, "..."), (4, "tie"), (5, "absent"), (1, "straße"), (None, "alpha alpha"), (6, "x" * 5000)]
    d = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in docs], "doc_id long, text string, score long, rank int, item_id string")
    q = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id int, terms int")
    assert found(spark, d, q) == brute(docs, items)
    assert found(spark, d.limit(0), q) == [] and found(spark, d, q.limit(0)) == []
    assert lexical.search(spark, d, q.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_string_ids_of_items(spark):
    docs, items = made(7, 50)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(f"item {i}", t) for i, t in items], "item_id string, text string")
    assert found(spark, d, q, k=3) == brute(docs, [(f"item {i}", t) for i, t in items], 3)


def test_joint_bounds_are_tighter(spark):
    """Two terms that never meet are bounded by the greater one, not by the sum."""
    docs = [(i, "red filler" if i % 2 else "blue filler") for i in range(40)]
    work = lexical.Workspace(spark, "bounds")
    terms = spark.createDataFrame([(1, "red"), (1, "blue")], "item_id long, term string")
    rows = lexical._block(spark, spark.createDataFrame(docs, "doc_id long, text string"), terms, 10, "item_id long, doc_id long, score long", work, 0)
    assert rows.count()
    lists = {(r.a, r.b): r for r in spark.read.parquet(work.path("pairs-0")).collect()}
    assert {key[1] for key in lists} == {-1} and all(r.n == 20 for r in lists.values())


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rows = queries()["op12_lexical"](spark, FOLDER).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in rows), key=repr) == brute(docs, items)
