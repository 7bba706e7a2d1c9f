"""Snapshot-diff sync: each kind of change, late and repeated batches, folding."""

import pytest
from pyspark.sql import functions as F

from mediaspan.plans.workspace import Workspace, written
from mediaspan.streaming.snapshots import LISTING, SnapshotSync
from mediaspan.streaming.sync import EVENT, ChangeLog


def listing(spark, folder, scan, files, modified=None, present=True):
    """files: (name, inode, modified_at)."""
    rows = [(folder, scan, modified or scan, present, None, None, None, None)]
    rows += [(folder, scan, None, None, name, inode, 10, at) for name, inode, at in files]
    return spark.createDataFrame(rows, LISTING)


@pytest.fixture
def sync(spark):
    return SnapshotSync(spark, Workspace(spark, "test-sync").root)


def state(sync):
    return {r.name: (r.born_name, r.born_scan, r.inode, r.status) for r in sync.state().collect()}


FIRST = [("a.jpg", 1, 5), ("b.jpg", 2, 5), ("c.jpg", 3, 5), ("d.jpg", None, 5), ("e.jpg", 6, 5), (".hidden.jpg", 7, 5), ("note.txt", 8, 5)]


def test_every_kind_of_change(spark, sync):
    sync.apply(listing(spark, 1, 10, FIRST), 0)
    assert set(state(sync)) == {"a.jpg", "b.jpg", "c.jpg", "d.jpg", "e.jpg"}
    then = [("a.jpg", 1, 5), ("bb.jpg", 2, 9), ("c.jpg", 3, 6), ("dd.jpg", None, 5), ("e.jpg", 60, 5), ("new.png", 0, 5)]
    sync.apply(listing(spark, 1, 11, then), 1)
    assert state(sync) == {
        "a.jpg": ("a.jpg", 10, 1, "new"),
        "bb.jpg": ("b.jpg", 10, 2, "renamed"),
        "c.jpg": ("c.jpg", 10, 3, "updated"),
        "dd.jpg": ("dd.jpg", 11, None, "new"),
        "e.jpg": ("e.jpg", 10, 60, "updated"),
        "new.png": ("new.png", 11, None, "new"),
    }
    assert {r.status: r.n for r in sync.counts().collect()} == {"new": 7, "renamed": 1, "updated": 2, "deleted": 1}


def test_two_files_swap_names_and_one_overwrites_another(spark, sync):
    sync.apply(listing(spark, 1, 1, [("a.jpg", 1, 5), ("b.jpg", 2, 5), ("c.jpg", 3, 5), ("d.jpg", 4, 5)]), 0)
    sync.apply(listing(spark, 1, 2, [("a.jpg", 2, 5), ("b.jpg", 1, 5), ("d.jpg", 3, 5)]), 1)
    assert state(sync) == {"a.jpg": ("b.jpg", 1, 2, "renamed"), "b.jpg": ("a.jpg", 1, 1, "renamed"), "d.jpg": ("c.jpg", 1, 3, "renamed")}


def test_hard_links_are_matched_one_to_one(spark, sync):
    sync.apply(listing(spark, 1, 1, [("a.jpg", 1, 5), ("b.jpg", 1, 5)]), 0)
    sync.apply(listing(spark, 1, 2, [("a.jpg", 1, 5), ("x.jpg", 1, 5), ("y.jpg", 1, 5)]), 1)
    assert state(sync) == {"a.jpg": ("a.jpg", 1, 1, "new"), "x.jpg": ("b.jpg", 1, 1, "renamed"), "y.jpg": ("y.jpg", 2, 1, "new")}


def test_a_name_that_is_no_media_any_more_keeps_its_record(spark, sync):
    sync.apply(listing(spark, 1, 1, [("a.jpg", 1, 5), ("b.jpg", 2, 5)]), 0)
    sync.apply(listing(spark, 1, 2, [("a.txt", 1, 5)]), 1)
    assert set(state(sync)) == {"a.jpg"}


def test_unchanged_folders_are_not_looked_at_and_missing_ones_go(spark, sync):
    sync.apply(listing(spark, 1, 1, FIRST).unionByName(listing(spark, 2, 1, FIRST)), 0)
    sync.apply(listing(spark, 1, 2, [], modified=1).unionByName(listing(spark, 2, 2, [], present=False)), 1)
    assert {r.folder_id for r in sync.state().collect()} == {1} and len(state(sync)) == 5
    sync.apply(listing(spark, 2, 3, [("a.jpg", 1, 5)]), 2)
    assert {(r.folder_id, r.born_scan) for r in sync.state().collect()} == {(1, 1), (2, 3)}


@pytest.mark.parametrize("fold", [False, True])
def test_late_repeated_and_folded_batches(spark, sync, fold):
    batches = [listing(spark, 1, 1, FIRST), listing(spark, 1, 3, [("z.jpg", 1, 5)]), listing(spark, 1, 2, [("late.jpg", 1, 5)]), listing(spark, 9, 4, FIRST)]
    for number, batch in enumerate(batches):
        sync.apply(batch, number)
        if fold:
            sync.compact()
            assert len(written(spark, f"{sync.root}/files", "batch")) == 0 and len(written(spark, f"{sync.root}/files-folded", "batch")) == 1
        sync.apply(batch, number)
    found = {(r.folder_id, r.name) for r in sync.state().collect()}
    assert found == {(1, "z.jpg"), *((9, n) for n, *_ in FIRST if n.endswith("jpg") and n[0] != ".")}
    assert {r.status: r.n for r in sync.counts().collect()} == {"new": 10, "renamed": 1, "deleted": 4}


def test_odd_rows(spark, sync):
    rows = [(None, 1, 1, True, None, None, None, None), (1, None, 1, True, None, None, None, None), (3, 1, None, None, "lost.jpg", 1, 1, 1), (2, 1, None, None, None, None, None, None), (2, 1, None, None, "a.jpg", None, None, None), (2, 1, None, None, "a.jpg", 4, 1, 1)]
    sync.apply(spark.createDataFrame(rows, LISTING), 0)
    assert state(sync) == {"a.jpg": ("a.jpg", 1, 4, "new")}
    sync.apply(spark.createDataFrame([], LISTING), 1)
    assert state(sync) == {"a.jpg": ("a.jpg", 1, 4, "new")}
    assert SnapshotSync(spark, Workspace(spark, "empty").root).state().count() == 0


def test_change_log_folds_its_batches(spark):
    log = ChangeLog(spark, Workspace(spark, "test-log").root)
    rows = spark.createDataFrame([(i, i % 3) for i in range(20)], "event_id long, user_id long")
    rows = rows.select("event_id", F.timestamp_seconds("event_id").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    assert [f.simpleString() for f in spark.createDataFrame([], EVENT).schema] == [f.simpleString() for f in rows.schema]
    assert log.state().count() == 0
    for number in range(4):
        log.write(rows.where(F.col("event_id") % 4 == number), number)
    before = sorted(log.state().collect())
    log.compact()
    assert sorted(log.state().collect()) == before and written(spark, f"{log.root}/changes", "batch") == []
    log.write(rows.limit(0), 4)
    log.compact()
    assert sorted(log.state().collect()) == before


@pytest.mark.parametrize("name", ["K1_snapshot_sync", "K1_sync_changes"])
def test_new_inodes_that_others_could_have_had(spark, name):
    """Orders come twice, five million keys apart, as far as a replaced file's inode moves."""
    from mediaspan.plans.catalog import Library
    from mediaspan.plans.registry import ORACLES
    from mediaspan.streaming import snapshots
    from tests_tables import FOLDER, connected

    class Twice(Library):
        def table(self, table):
            rows = super().table(table)
            return rows.unionByName(rows.withColumn("o_orderkey", F.col("o_orderkey") + 5000000)) if table == "orders" else rows

    con = connected()
    con.sql("set timezone = 'UTC'")
    con.sql(f"create or replace view orders as select * from '{FOLDER}/orders.parquet' union all select * replace (o_orderkey + 5000000 as o_orderkey) from '{FOLDER}/orders.parquet'")
    want = con.sql(ORACLES[name]).limit(1 << 30).fetchall()
    build = snapshots.snapshot_state if name == "K1_snapshot_sync" else snapshots.sync_changes
    key = lambda row: tuple(str(v) for v in row)
    assert sorted(map(tuple, build(Twice(spark, FOLDER)).collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", ["K1_snapshot_sync", "K1_sync_changes"])
def test_batches_that_lie_in_several_files(spark, name):
    """A session may limit the rows of a file; a batch then is more than one, and its headers lie in one of them only."""
    from mediaspan.plans.registry import ORACLES, QUERIES
    from tests_tables import FOLDER, connected

    con = connected()
    con.sql("set timezone = 'UTC'")
    want = con.sql(ORACLES[name]).limit(1 << 30).fetchall()
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "500")
    try:
        found = QUERIES[name](spark, FOLDER).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    key = lambda row: tuple(str(v) for v in row)
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
