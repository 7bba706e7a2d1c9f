"""Incremental sync: a stream of change events keeps the latest state of every file.

Each micro-batch is reduced to the latest event of a file and written under its
batch number, so a batch that is run again replaces itself. The state is the
latest event over all batches; `compact` folds them into the newest one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspan.plans.catalog import Library
from mediaspan.plans.registry import query
from mediaspan.plans.workspace import Workspace, remove, written

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
_STATE = "file_id long, at timestamp, event_id long, event_type string, value double, n long"


def latest(events: DataFrame) -> DataFrame:
    """(file_id, at, event_id, event_type, value, n): each file's latest event by time and id, and how many there are. Null files are left out."""
    best = F.max_by(F.struct("ts", "event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("e")
    found = events.where("user_id is not null").groupBy(F.col("user_id").alias("file_id")).agg(best, F.count("*").alias("n"))
    return found.select("file_id", F.col("e.ts").alias("at"), "e.event_id", "e.event_type", "e.value", "n")


class ChangeLog:
    """The batches of one sync, in a folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, batch: DataFrame, number: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{self.root}/changes/batch={number}")

    def state(self) -> DataFrame:
        """Latest over all batches; their counts add up."""
        folds = written(self.spark, f"{self.root}/folded", "upto")
        batches = [n for n in written(self.spark, f"{self.root}/changes", "batch") if not folds or n > folds[-1]]
        paths = [f"{self.root}/changes/batch={n}" for n in batches] + [f"{self.root}/folded/upto={n}" for n in folds[-1:]]
        rows = self.spark.read.schema(_STATE).parquet(*paths) if paths else self.spark.createDataFrame([], _STATE)
        best = F.max_by(F.struct("at", "event_id", "event_type", "value"), F.struct("at", "event_id")).alias("e")
        return rows.groupBy("file_id").agg(best, F.sum("n").alias("n")).select("file_id", "e.at", "e.event_id", "e.event_type", "e.value", "n")

    def compact(self) -> None:
        """Fold the complete batches into one table, which counts once its mark is there; then delete what it replaces.

        Called between runs of the stream: a batch that is folded must not come again.
        """
        done = written(self.spark, f"{self.root}/changes", "batch")
        if len(done) > 1:
            self.state().write.mode("overwrite").parquet(f"{self.root}/folded/upto={done[-1]}")
            self._clear()

    def _clear(self) -> None:
        folds = written(self.spark, f"{self.root}/folded", "upto")
        for upto in folds[:-1]:
            remove(self.spark, f"{self.root}/folded/upto={upto}")
        for number in written(self.spark, f"{self.root}/changes", "batch"):
            if folds and number <= folds[-1]:
                remove(self.spark, f"{self.root}/changes/batch={number}")

    def run(self, stream: DataFrame) -> None:
        """Take in all that the stream holds now; a later run goes on where this one ended."""
        started = stream.writeStream.foreachBatch(self.write).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
        started.awaitTermination()


def event_stream(lib: Library, per_batch: int = 1) -> DataFrame:
    """The events table as a stream of its files."""
    return lib.spark.readStream.schema(EVENT).option("pathGlobFilter", "events*").option("maxFilesPerTrigger", per_batch).parquet(lib.folder)


@query("K1_incremental_sync", "select user_id file_id, arg_max(event_id, (ts, event_id)) event_id, arg_max(event_type, (ts, event_id)) event_type, round(arg_max(value, (ts, event_id)), 6) as value, count(*) n from events where user_id is not null group by 1")
def incremental_sync(lib: Library) -> DataFrame:
    log = ChangeLog(lib.spark, Workspace(lib.spark, "sync").root)
    log.run(event_stream(lib))
    return log.state().select("file_id", "event_id", "event_type", F.round("value", 6).alias("value"), "n")


@query("K1_hourly_activity", "select event_type, date_trunc('hour', ts) as hour, count(*) n from events where ts is not null group by 1, 2")
def hourly(lib: Library) -> DataFrame:
    """Counts by type and hour, kept up by a windowed aggregation with a watermark for late events."""
    root = Workspace(lib.spark, "hourly").root
    counts = event_stream(lib).withWatermark("ts", "1 day").groupBy("event_type", F.window("ts", "1 hour")).agg(F.count("*").alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        batch.select("event_type", F.col("window.start").alias("hour"), "n", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{root}/counts/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = lib.spark.read.schema("event_type string, hour timestamp, n long, batch int").option("recursiveFileLookup", "true").parquet(f"{root}/counts")
    return rows.groupBy("event_type", "hour").agg(F.max_by("n", "batch").alias("n"))
