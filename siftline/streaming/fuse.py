"""Micro-batch fusion (R1-R7): the fold of the batch form over a stream of messages or observations.

Every batch reads what the batch before it wrote under its own number and writes
its own, so a batch that is run again after a failure starts from the same state
and gives the same rows. Rows that may still be overtaken wait for the next
batch; late rows are folded like all others, none is dropped. A batch writes only
the incidents it changed; :meth:`FusionSink.incidents` takes the last form of each.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from siftline.operators.fusion import CARRIED, assign, incidents
from siftline.operators.observe import Observed, counters


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)  # any file system that Spark has
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(path)


def ready(rows: DataFrame, hold_back_seconds: int, now: datetime | None = None, key: str = "raw_id", at: str = "moment") -> tuple[DataFrame, DataFrame]:
    """Rows to release and rows to hold.

    The horizon is the later of ``now`` and the newest time, less the hold-back. Only
    the contiguous prefix by ``key`` is released: from the first row on that is
    younger than the horizon, all wait, so a mark never jumps over one.
    """
    newest = rows.agg(F.greatest(F.max(at), F.lit(now).cast("timestamp")).alias("newest"))
    timed = rows.crossJoin(F.broadcast(newest))
    young = F.col(at) > F.col("newest") - F.make_dt_interval(secs=F.lit(float(hold_back_seconds)))
    stop = timed.agg(F.min(F.when(young, F.col(key))).alias("stop"))
    marked = rows.crossJoin(F.broadcast(stop)).withColumn("go", F.col("stop").isNull() | (F.col(key) < F.col("stop")))
    return marked.where("go").drop("go", "stop"), marked.where("NOT coalesce(go, false)").drop("go", "stop")


def progress(provenance: DataFrame, stored: DataFrame | None = None, key: str = "raw_id") -> DataFrame:
    """R2: one row ``mark``: the last id done, never before the last one that provenance shows."""
    marks = provenance.select(F.col(key).alias("mark"))
    marks = marks if stored is None else marks.unionByName(stored.select("mark"))
    return marks.agg(F.coalesce(F.max("mark"), F.lit(0)).cast("long").alias("mark"))


class FusionSink:
    """``foreachBatch`` target with ``held``, ``mark``, ``assigned``, ``members``, ``open`` and ``changed`` under ``path/<name>/batch=N``.

    ``prepare`` turns released rows into observations where the stream has messages,
    whose counts (F16) are then under ``summary``;
    ``key`` and ``at`` are then the names of a message's id and time.
    """

    def __init__(self, path: str, hold_back_seconds: int = 30, prepare: Callable[[DataFrame], DataFrame | Observed] | None = None, key: str = "raw_id", at: str = "moment"):
        self.path, self.hold_back, self.prepare, self.key, self.at = path.rstrip("/"), hold_back_seconds, prepare, key, at

    def _last(self, spark: SparkSession, name: str, batch: int) -> DataFrame | None:
        return _read(spark, f"{self.path}/{name}/batch={batch}") if batch >= 0 else None

    def _write(self, rows: DataFrame, name: str, batch: int) -> DataFrame:
        path = f"{self.path}/{name}/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        held = self._last(spark, "held", batch - 1)
        # written first: the batch is read once, not once for each use
        rows = self._write(rows if held is None else rows.unionByName(held), "taken", batch)
        go, wait = ready(rows, self.hold_back, key=self.key, at=self.at)
        self._write(wait, "held", batch)
        self._fold(spark, go, batch)

    def _fold(self, spark: SparkSession, go: DataFrame, batch: int) -> None:
        self._write(progress(go, self._last(spark, "mark", batch - 1), self.key), "mark", batch)
        rows = go if self.prepare is None else self.prepare(go)
        if isinstance(rows, Observed):
            wait = self._last(spark, "held", batch)
            self._write(counters(rows, go.limit(0) if wait is None else wait), "summary", batch)
            rows = rows.observations
        stored, before = self._last(spark, "open", batch - 1), self._last(spark, "members", batch - 1)
        assigned = self._write(assign(rows, stored, keep_open=True), "assigned", batch)
        names = [c.split()[0] for c in CARRIED.split(", ")] + ["id", "part", "new"]
        fresh = assigned.where("id IS NOT NULL").select(names)
        members = fresh if before is None else fresh.unionByName(before.select(names))
        touched = fresh.select("zone_id", "id").distinct()
        self._write(incidents(members.join(touched, ["zone_id", "id"], "left_semi")), "changed", batch)
        left = assigned.where("open IS NOT NULL").select("zone_id", "open")
        kept = self._write(members.join(left.select("zone_id", F.col("open.id").alias("id")), ["zone_id", "id"], "left_semi"), "members", batch)
        paths = kept.groupBy("zone_id").agg(F.any_value("zone_path").alias("zone_path"))
        self._write(left.join(paths, "zone_id").select("zone_id", "zone_path", "open"), "open", batch)

    def incidents(self, spark: SparkSession) -> DataFrame | None:
        """The last form of every incident."""
        changed = _read(spark, f"{self.path}/changed")
        if changed is None:
            return None
        columns = [c for c in changed.columns if c != "batch"]
        return changed.groupBy("zone_id", "id").agg(F.max_by(F.struct(*columns), "batch").alias("last")).select("last.*")

    def finish(self, spark: SparkSession, batch: int) -> DataFrame | None:
        """Fold what is still held after ``batch`` and return all incidents."""
        held = self._last(spark, "held", batch)
        if held is not None:
            self._fold(spark, held, batch + 1)
        return self.incidents(spark)


def run(stream: DataFrame, path: str, hold_back_seconds: int = 30, available_now: bool = True, sink: FusionSink | None = None) -> StreamingQuery:
    """Fuse a stream; offsets (R2) live in the checkpoint."""
    writer = stream.writeStream.foreachBatch(sink or FusionSink(path, hold_back_seconds)).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="20 seconds")).start()


def changed(marker: DataFrame, before: DataFrame | None) -> bool:
    """Whether a snapshot's marker (newest message, number of active incidents) differs from the last one sent."""
    return before is None or not marker.exceptAll(before).isEmpty()
