"""The prefix trie of conversations as a burst trie.

Equal conversations first become one sequence of turn ids that stands for all
of them. All sequences start in one container under the root. A container with
too many turns bursts by the next turn id: each id becomes a trie head, and
the rest of its sequences a container under that head. What is left are
containers of bounded size; they are dealt to shards, sorted by their ids and
swept into nodes, one container after the other. The sums of a subtree go up
from the containers to the heads above them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspan.llm.keyed import join_counted
from mediaspan.plans.workspace import Workspace

#: A container bursts if it has more turns than CONTAINER and more sequences than FEW.
CONTAINER, FEW = 1 << 17, 256
#: Turns of one shard on average.
SHARD = 1 << 20
#: Conversations whose ids make one piece of a member list.
PIECE = 1 << 14
#: Nodes in one batch of results.
BATCH = 1 << 14

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, turn_id binary, ending long, head boolean"


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, turn_id, words) of every row with a conversation id.

    A turn id is half of a SHA-256 of role and text, where null is empty; its
    words are the runs without ASCII blanks of its text.
    """
    who, what = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, what), 256)
    words = F.regexp_count(what, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.substring(F.unhex(digest), 1, 16).alias("turn_id"), words.alias("words"))


def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, ids, words): the turns of each conversation in order, null first; equal numbers by turn id.

    Repeated rows are turns of their own. A conversation is one row of 32 bytes a turn; its texts never meet.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", "turn_id", "words"))).alias("t")
    return rows.groupBy("conv_id").agg(ordered).select("conv_id", F.col("t.turn_id").alias("ids"), F.col("t.words").alias("words"))


def member_hashes(convs: DataFrame, groups: DataFrame) -> DataFrame:
    """(first_conv, sha256): the hash of the ascending, comma-joined ids of each group of equal conversations.

    Ids are sorted over all tasks and joined in pieces; a hash then runs over
    the pieces of its group, so no group is ever held whole.
    """
    alone = groups.where("n = 1").select("first_conv", F.sha2(F.col("first_conv").cast("string"), 256).alias("sha256"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, out = None, [], []
        for batch in batches:
            for g, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (g != group or len(ids) == PIECE):
                    out.append((group, ids[0], ",".join(map(str, ids))))
                    ids = []
                group = g
                ids.append(c)
            if len(out) >= 64:
                yield _table(out, pieces)
                out = []
        yield _table(out + ([(group, ids[0], ",".join(map(str, ids)))] if ids else []), pieces)

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, running, out = None, None, []
        for batch in batches:
            for g, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if running is not None and g == group:
                    running.update(b",")
                else:
                    if running is not None:
                        out.append((group, running.hexdigest()))
                    group, running = g, hashlib.sha256()
                running.update(piece.as_py().encode())
            yield _table(out, hashes)
            out = []
        yield _table([(group, running.hexdigest())] if running is not None else [], hashes)

    pieces = pa.schema([("first_conv", pa.int64()), ("first_id", pa.int64()), ("ids", pa.string())])
    hashes = pa.schema([("first_conv", pa.int64()), ("sha256", pa.string())])
    many = join_counted(convs.select("conv_id", "sequence"), groups.where("n > 1"), ["sequence"]).select("first_conv", "conv_id")
    dealt = many.repartitionByRange("first_conv", "conv_id").sortWithinPartitions("first_conv", "conv_id").mapInArrow(join, "first_conv long, first_id long, ids string")
    return alone.unionByName(dealt.repartition("first_conv").sortWithinPartitions("first_conv", "first_id").select("first_conv", "ids").mapInArrow(hash_all, "first_conv long, sha256 string"))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def nodes_of(depth: int, rows: list[tuple]) -> Iterator[tuple]:
    """The nodes of one container, its head first: rows are (ids, words, first_conv, convs) in the order of ids, equal up to the depth."""
    parent, level, words, n, least, ending, turn = [-1], [depth], [0], [0], [None], [None], [None]
    path, before = [0], None
    for ids, sizes, first_conv, convs in rows:
        same = depth
        if before is not None:
            most = min(len(ids), len(before))
            while same < most and ids[same] == before[same]:
                same += 1
        del path[same - depth + 1 :]
        for at in range(same, len(ids)):
            parent.append(path[-1])
            level.append(at + 1)
            words.append(sizes[at])
            turn.append(ids[at])
            n.append(0)
            least.append(None)
            ending.append(None)
            path.append(len(parent) - 1)
        here, before = path[-1], ids
        n[here] += convs
        ending[here] = first_conv
        least[here] = first_conv
    children, leaves, saved = [0] * len(n), [0] * len(n), [0] * len(n)
    for at in range(len(n) - 1, -1, -1):
        leaves[at] = leaves[at] or 1
        saved[at] += (n[at] - 1) * words[at]
        up = parent[at]
        if up >= 0:
            n[up] += n[at]
            children[up] += 1
            leaves[up] += leaves[at]
            saved[up] += saved[at]
            least[up] = least[at] if least[up] is None else min(least[up], least[at])
    for at in range(len(n)):
        yield least[at], level[at], least[parent[at]] if at else None, n[at], children[at], leaves[at], saved[at], turn[at], ending[at], at == 0


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted sequences, one container after the other, to their nodes."""
    schema = pa.schema([(name, {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[kind]) for name, kind in (c.split() for c in _NODE.split(", "))])

    def containers() -> Iterator[tuple[int, list[tuple]]]:
        path, rows = None, []
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for at, *row in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                    if rows and at != path:
                        yield len(path) - 1, rows
                        rows = []
                    path = at
                    rows.append(tuple(row))
        if rows:
            yield len(path) - 1, rows

    out = []
    for depth, rows in containers():
        for node in nodes_of(depth, rows):
            out.append(node)
            if len(out) == BATCH:
                yield _table(out, schema)
                out = []
    yield _table(out, schema)


def prefix_trie(spark: SparkSession, convs: DataFrame) -> DataFrame:
    """Every node of the trie of the sequences (conv_id, ids, words), as sequences() makes them.

    conv_id, depth: the smallest member and the depth, which tell nodes apart;
    parent_conv_id: the parent's conv_id, null for the root; n_convs: members;
    n_children; n_leaves: childless nodes of the subtree, the node itself
    included; saved_tokens: over the subtree, the words of each node's last
    turn once for every member but one; ends_sha256: the hash of the ids of the
    members that end here; turn_id: the last turn.

    Conversation ids are taken to be unique and not null. A conversation
    without turns is a member of the root. No conversations give no nodes.
    Bursts go one turn deeper a round, as long as a container is too large.
    """
    work = Workspace(spark, "trie")
    whole = F.sha2(F.array_join(F.transform("ids", F.hex), ""), 256)
    convs = work.table(convs.select("conv_id", "ids", "words", whole.alias("sequence")), "conversations")
    groups = work.table(convs.groupBy("sequence").agg(F.min("conv_id").alias("first_conv"), F.count("*").alias("n")), "groups")
    distinct = convs.drop("sequence").join(groups.select(F.col("first_conv").alias("conv_id"), F.col("n").alias("convs")), "conv_id").withColumnRenamed("conv_id", "first_conv")
    distinct = work.table(distinct, "distinct")

    def measured(rows, depth: int) -> DataFrame:
        ends = F.min(F.when(F.size("ids") == depth, F.col("first_conv")))
        return rows.agg(F.min("first_conv").alias("conv_id"), F.sum("convs").alias("n_convs"), F.count("*").alias("n"), F.sum(F.size("ids") - depth).alias("turns"), F.min(F.col("words")[depth - 1] if depth else F.lit(0).cast("long")).alias("words"), ends.alias("ending"))

    large = (F.col("turns") > CONTAINER) & (F.col("n") > FEW)
    root = measured(distinct.groupBy(), 0).where("n > 0").select(F.array("conv_id").alias("path"), F.lit(None).cast("binary").alias("turn_id"), "n_convs", "turns", "words", "ending", large.alias("large"))
    heads = [work.table(root, "heads-0")]
    first = heads[0].first()
    label = F.array(F.lit(first["path"][0] if first else 0).cast("long"))
    active = distinct.withColumn("path", label)
    still = bool(first and first["large"])
    containers = [] if still else [active]
    while still:
        depth = len(heads)
        step = active.where(F.size("ids") >= depth).withColumn("turn_id", F.col("ids")[depth - 1])
        met = work.table(measured(step.groupBy("path", "turn_id"), depth).withColumn("large", large), f"met-{depth}")
        heads.append(met.select(F.concat("path", F.array("conv_id")).alias("path"), "turn_id", "n_convs", "turns", "words", "ending", "large"))
        moved = join_counted(step, met.select("path", "turn_id", "conv_id", "large", "n"), ["path", "turn_id"])
        moved = work.table(moved.select(F.concat("path", F.array("conv_id")).alias("path"), "first_conv", "convs", "ids", "words", "large"), f"suffixes-{depth}")
        containers.append(moved.where("not large").drop("large"))
        active = moved.where("large").drop("large")
        still = bool(met.where("large").limit(1).count())

    shards = max(spark.sparkContext.defaultParallelism, -(-((first["turns"] if first else 0) or 0) // SHARD))
    dealt = _union(containers).select("path", "ids", "words", "first_conv", "convs").repartition(shards, "path").sortWithinPartitions("path", "ids")
    swept = work.table(dealt.mapInArrow(_sweep, _NODE), "swept")

    depth = (F.size("path") - 1).cast("long")
    heads = _union(heads).select("path", F.element_at("path", -1).alias("conv_id"), depth.alias("depth"), F.when(F.size("path") > 1, F.try_element_at("path", F.lit(-2))).alias("parent_conv_id"), "turn_id", "n_convs", "words", "ending")
    below = swept.where("head").select("conv_id", "depth", "n_children", "n_leaves", "saved_tokens")
    known = heads.join(below, ["conv_id", "depth"], "left").withColumn("saved", F.coalesce("saved_tokens", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words"))
    up = known.select(F.posexplode("path").alias("depth", "conv_id"), F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), "saved")
    sums = up.groupBy("conv_id", F.col("depth").cast("long").alias("depth")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    born = heads.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("born"))
    upper = known.drop("n_leaves", "saved_tokens").join(sums, ["conv_id", "depth"]).join(born, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", "born", F.lit(0)))

    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "turn_id", "ending"]
    nodes = work.table(upper.select(*names).unionByName(swept.where("not head").select(*names)), "nodes")
    ends = member_hashes(convs, groups).select(F.col("first_conv").alias("ending"), F.col("sha256").alias("ends_sha256"))
    ended = nodes.where("ending is not null").join(ends, "ending").drop("ending")
    others = nodes.where("ending is null").drop("ending").withColumn("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
    return ended.unionByName(others)


def _union(tables: list[DataFrame]) -> DataFrame:
    found = tables[0]
    for t in tables[1:]:
        found = found.unionByName(t)
    return found
