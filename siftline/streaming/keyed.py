"""Keyed streams with timers (R1, R3, R5, R6, F10, A34, A35): one state a zone, one ledger a line of alerts.

:class:`ZoneFusion` holds what is open in one zone and the rows that may still be
overtaken. A timer in event time releases rows in order of time and id and drops
every incident that nothing can reach any more, so a zone that falls silent
leaves nothing behind. The rules are those of the batch form; the rows that come
out are assigned rows (:func:`siftline.operators.fusion.incidents` makes
incidents of them) and, where an incident ends by itself, one row that says so.

The operator gets the time as a number, not as the watermark's column: Spark
drops late rows only where it sees that column. So late rows arrive, and are
placed against what is open (R6).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

from siftline.operators.fusion import CARRIED, Open, event_id, place_row, typed_rows
from siftline.operators.linking import closure, paths

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"

#: What a row of a zone's state keeps, and what comes out for it.
_ROW = "raw_id bigint, source_key string, tier string, at bigint, signal string, threat string, severity int, level string, lat double, lon double, direction_deg int, target_count int, massive boolean, voice string, stamp string, clear boolean, own_id string"
_FIELDS = [c.split()[0] for c in _ROW.split(", ")]
ASSIGNED = f"zone_id string, {_ROW.rsplit(', ', 3)[0]}, id string, part string, new boolean"
_OUT = [c.split()[0] for c in ASSIGNED.split(", ")]


def with_state_store(spark: SparkSession) -> None:
    """Keyed state needs the store that can hold several variables a key."""
    spark.conf.set(STORE, ROCKS)


def _plain(value):
    return None if value is None or value != value else getattr(value, "item", lambda: value)()


class ZoneFusion(StatefulProcessor):
    """F1-F4, F10 for one zone: ``held`` rows by time, ``open`` incidents, and the time of the next timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _ROW)
        self.open = handle.getValueState("open", "incidents string")  # JSON: a list of incidents in order of creation
        self.next = handle.getValueState("next", "at bigint")

    def _live(self) -> list[Open]:
        stored = self.open.get() if self.open.exists() else None
        return [Open(**{**one, "voices": set(one["voices"])}) for one in json.loads(stored[0])] if stored else []

    def _walk(self, zone: str, rows: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        """Place rows in order, close what is over by the watermark, and set the timer for what comes next."""
        live, out = self._live(), []
        for row in sorted(rows, key=lambda r: (r[3], r[0])):
            given = dict(zip(_FIELDS, row, strict=True))
            out += self._over(zone, live, row[3])
            for found in place_row(live, given["at"], given["own_id"], given["clear"], given["threat"], given["severity"], given["voice"], given["stamp"]):
                out.append((zone, *row[: len(_FIELDS) - 3], *found))
        out += self._over(zone, live, watermark * 1000 + 1)
        if live:
            self.open.update((json.dumps([{**one.__dict__, "voices": sorted(one.voices)} for one in live]),))
        else:
            self.open.clear()
        if out:
            yield pd.DataFrame(out, columns=_OUT)

    @staticmethod
    def _over(zone: str, live: list[Open], at: int) -> list[tuple]:
        """Incidents that nothing at ``at`` or later can reach; those that no all-clear ended get a row ``expire``."""
        gone = [one for one in live if not one.lasts(at)]
        live[:] = [one for one in live if one.lasts(at)]
        blank = dict.fromkeys(_OUT)
        return [tuple({**blank, "zone_id": zone, "at": one.ends(), "threat": one.threat, "id": one.id, "part": "expire", "new": False}.values()) for one in gone if one.closed is None]

    def _wake(self, times: list[int]) -> None:
        """One timer a zone, at the earliest time (microseconds) at which something is due."""
        before = self.next.get()[0] if self.next.exists() else None
        after = min(times) // 1000 + 1 if times else None
        if after == before:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if after is None:
            self.next.clear()
        else:
            self.handle.registerTimer(after)
            self.next.update((after,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        late, waiting = [], []
        for frame in rows:
            for row in frame[_FIELDS].itertuples(index=False, name=None):
                row = tuple(map(_plain, row))
                (late if row[3] <= watermark * 1000 else waiting).append(row)
        if waiting:
            self.held.appendList(waiting)
        if late:
            yield from self._walk(key[0], late, watermark)
        self._wake([row[3] for row in self.held.get()] + [one.ends() for one in self._live()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        self.next.clear()  # the timer that rang is gone
        held = [tuple(row) for row in self.held.get()]
        due = [row for row in held if row[3] <= watermark * 1000]
        wait = [row for row in held if row[3] > watermark * 1000]
        yield from self._walk(key[0], due, watermark)
        if wait:
            self.held.put(wait)
        else:
            self.held.clear()
        self._wake([row[3] for row in wait] + [one.ends() for one in self._live()])

    def close(self) -> None:
        pass


def fused_stream(observations: DataFrame, zones: DataFrame, hold_back: str = "30 seconds") -> DataFrame:
    """Assigned rows of a stream of observations, with ``expire`` rows for incidents that end by themselves.

    ``zones`` is the gazetteer (a table), over which all-clears are dealt to the zones
    below. Rows wait for ``hold_back`` behind the newest time of the stream and are
    then placed in order; older ones are placed at once. Null threats count as
    ``unknown``; a row without a time is never due and goes.
    """
    with_state_store(observations.sparkSession)
    rows = typed_rows(observations.withWatermark("moment", hold_back)).where("moment IS NOT NULL")
    below = closure(zones).select("zone_id", F.col("ancestor_id").alias("above"))
    reports = rows.where("NOT clear")
    clears = rows.where("clear").withColumnRenamed("zone_id", "above").join(below, "above").drop("above")
    dealt = reports.unionByName(clears, allowMissingColumns=True).withColumn("own_id", event_id(F.col("zone_id"), F.col("threat"), F.col("moment")))
    keyed = dealt.select("zone_id", *[F.col(c).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in _ROW.split(", "))])
    return keyed.groupBy("zone_id").transformWithStateInPandas(ZoneFusion(), ASSIGNED, "Append", "EventTime")


class BatchCounts(StreamingQueryListener):
    """F16 while a stream runs: what its batches observed, by name of the observation and number of the batch."""

    def __init__(self):
        self.seen: dict[str, dict[int, dict]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.seen.setdefault(name, {})[event.progress.batchId] = row.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def counted(rows: DataFrame, name: str = "messages") -> DataFrame:
    """F16: a stream of parsed messages or observations that is counted as it passes, for :class:`BatchCounts`."""
    dropped = F.count_if(F.col("drop_reason").isNotNull()).alias("irrelevant") if "drop_reason" in rows.columns else F.lit(0).cast("long").alias("irrelevant")
    return rows.observe(name, F.count(F.lit(1)).alias("scanned"), dropped)


def assigned_rows(log: DataFrame, zones: DataFrame) -> DataFrame:
    """The batch form's assigned rows of what :func:`fused_stream` has written, for ``incidents`` and ``contributions``."""
    rows = log.where("part <> 'expire'").withColumn("moment", F.timestamp_micros("at")).join(paths(zones), "zone_id")
    return rows.select(*[F.col(c.split()[0]) for c in CARRIED.split(", ")], "id", "part", "new")


def closings(log: DataFrame) -> DataFrame:
    """``id, zone_id, closed_at`` of incidents that ended by themselves."""
    return log.where("part = 'expire'").select("id", "zone_id", F.timestamp_micros("at").alias("closed_at"))


class Ledger(StatefulProcessor):
    """When a line first went to a recipient; the entry goes ``life`` seconds later, by a timer."""

    def __init__(self, quiet: int, life: int):
        self.quiet, self.life = quiet, life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.began = handle.getValueState("began", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = before = self.began.get()[0] if self.began.exists() else None
        out = []
        for at in sorted(int(at) for frame in rows for at in frame["at"]):
            if before is None or at - before >= self.life * 1_000_000:
                before = at
                out.append((*key, at, True))
            else:  # a late row, older than the entry, was sent under it already
                out.append((*key, at, at - before >= self.quiet * 1_000_000))
        if before != stored:
            if stored is not None:
                self.handle.deleteTimer(self._over(stored))
            self.began.update((before,))
            self.handle.registerTimer(self._over(before))
        yield pd.DataFrame(out, columns=["recipient", "line", "at", "sent"])

    def _over(self, began: int) -> int:
        return began // 1000 + self.life * 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.began.clear()
        return iter(())

    def close(self) -> None:
        pass


def sent_lines(lines: DataFrame, minutes: int = 30, hours: int = 24, delay: str = "15 minutes") -> DataFrame:
    """Lines of a stream (``recipient, line, moment``) with ``at`` (microseconds) and whether each is ``sent``.

    A line is not sent again within ``minutes`` of the first send of its ledger entry,
    which lives for ``hours``; with ``minutes`` as long as ``hours`` it is sent once
    an entry. A row that comes again unchanged within ``delay`` is dropped before it
    reaches the ledger. State is one entry a recipient and line, and gone after
    ``hours`` of event time; null recipients or lines are keys like others.
    """
    with_state_store(lines.sparkSession)
    fresh = lines.withWatermark("moment", delay).dropDuplicatesWithinWatermark(["recipient", "line", "moment"])
    keyed = fresh.select("recipient", "line", F.unix_micros("moment").alias("at")).where("at IS NOT NULL")
    return keyed.groupBy("recipient", "line").transformWithStateInPandas(Ledger(minutes * 60, hours * 3600), "recipient string, line string, at bigint, sent boolean", "Append", "EventTime")
