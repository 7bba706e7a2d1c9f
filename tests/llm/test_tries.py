"""The trie of conversations against brute force, with containers and shards of any size."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from mediaspan.llm import tries
from mediaspan.llm.queries import queries, with_shared_heads

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def in_order(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            convs[c].append((turn is not None, turn or 0, key, role, text))
    return {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    return out


def brute(convs):
    members = collections.defaultdict(list)
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    words = {p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p in members}
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * words[p]
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)


def built(spark, rows, schema=SCHEMA, shared=False):
    convs = tries.sequences(tries.turns(spark.createDataFrame(rows, schema)))
    return rows_of(tries.prefix_trie(spark, with_shared_heads(convs) if shared else convs))


def made(seed, n=120):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rnd.randint(0, 9) if c % 7 else 6):
            same = c % 3 == 0 and turn < 4
            rows.append((c * 3 - 50, turn, ("user", "assistant")[turn % 2], f"shared turn {turn}" if same else f"{'w ' * rnd.randint(0, 3)}{rnd.randint(0, 2)}"))
    rows += [(1000 + c, turn, "user", f"copy {turn}") for c in range(40) for turn in range(3)]
    return rows + [(2000 + c, turn, "user", f"chain {turn}") for c in range(25) for turn in range(c)]


@pytest.mark.parametrize("container,few,piece", [(1 << 17, 256, 1 << 14), (20, 0, 7), (60, 3, 1)])
def test_bursts_shards_and_pieces(spark, monkeypatch, container, few, piece):
    monkeypatch.setattr(tries, "CONTAINER", container)
    monkeypatch.setattr(tries, "FEW", few)
    monkeypatch.setattr(tries, "PIECE", piece)
    rows = made(container)
    assert built(spark, rows) == brute(in_order(rows))


def test_shared_heads(spark):
    rows = made(5) + [(c, turn, "user", f"{c} {turn}") for c in range(300, 345) for turn in range(c % 6)]
    assert built(spark, rows, shared=True) == brute(rebuilt(in_order(rows)))


def test_odd_rows_ties_and_clashing_columns(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, "", ""), (1, 5, "b", "x"), (1, 5, "a", "x"), (2, 0, "user", "first"), (2, 0, "user", "first"), (None, 0, "user", "lost"), (-3, 9, "user", "ß  \t\n y"), (-4, 9, "user", "ß  \t\n y"), (7, 0, "a", "bc"), (8, 0, "ab", "c"), (9, 0, "user", "w " * 200000)]
    wide = [(*r, 1, 2, "k", [1]) for r in rows]
    assert built(spark, wide, SCHEMA + ", depth int, n int, path string, ids array<int>") == brute(in_order(rows))
    assert built(spark, [], SCHEMA) == []


def test_one_very_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(tries, "CONTAINER", 50)
    rows = [(1, t, "user", f"t{t}") for t in range(3000)] + [(2, t, "user", f"t{t}") for t in range(1500)]
    found = built(spark, rows)
    assert len(found) == 3001 and found[-1][1] <= 3000
    assert {r[1]: r[3] for r in found} == {d: 2 if d <= 1500 else 1 for d in range(3001)}


def test_conversations_without_turns(spark):
    convs = spark.createDataFrame([(4, [], []), (2, [], []), (3, [b"a"], [5])], "conv_id long, ids array<binary>, words array<long>")
    ends = hashlib.sha256(b"2,4").hexdigest()
    assert rows_of(tries.prefix_trie(spark, convs)) == sorted([(2, 0, None, 3, 1, 1, 0, ends), (3, 1, 2, 1, 0, 1, 0, hashlib.sha256(b"3").hexdigest())], key=repr)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries()["op11_trie"](spark, FOLDER)) == brute(rebuilt(in_order(rows)))
