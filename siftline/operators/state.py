"""Snapshot, roll-up, history and analytics over an incident table.

Incidents have ``id, zone_id, zone_path, threat, signal, severity, first_seen,
last_seen, resolved_at, source_count, confidence``; zones have ``zone_id,
parent_id, level, name, lat, lon, population``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import scoring as S


def recent(incidents: DataFrame, zones: DataFrame, since: Column, until: Column | None = None, limit: int = 400) -> DataFrame:
    """A1: the newest ``limit`` incidents seen since a time, with the names of zone and parent."""
    rows = incidents.where(F.col("last_seen") >= since)
    if until is not None:
        rows = rows.where(F.col("first_seen") < until)
    top = rows.orderBy(F.desc("last_seen"), "id").limit(limit)
    own = zones.select("zone_id", "parent_id", "level", F.col("name").alias("zone_name"))
    up = zones.select(F.col("zone_id").alias("parent_id"), F.col("name").alias("parent_name"))
    return top.join(own, "zone_id").join(up, "parent_id", "left")


def snapshot(incidents: DataFrame, now: Column, active_hours: float = 6, resolved_minutes: float = 30, limit: int | None = None) -> DataFrame:
    """A2: open incidents and, per zone and threat, the newest of those cleared lately."""
    rows = incidents.where((S.seconds(now, F.col("last_seen")) <= active_hours * 3600) & (F.col("first_seen") <= now))
    if limit is not None:
        rows = rows.orderBy(F.desc("last_seen"), "id").limit(limit)
    rows = rows.withColumn("status", S.status(F.col("resolved_at"), F.col("last_seen"), now))
    newest = Window.partitionBy("zone_id", "threat").orderBy(F.desc("resolved_at"), "id")
    cleared = (
        rows.where(F.col("resolved_at").isNotNull() & (S.seconds(now, F.col("resolved_at")) <= resolved_minutes * 60))
        .withColumn("rn", F.row_number().over(newest))
        .where("rn = 1")
        .drop("rn")
    )
    return rows.where("resolved_at IS NULL AND status <> 'resolved'").unionByName(cleared)


def zone_rollup(incidents: DataFrame, zones: DataFrame, now: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Incidents lifted to all zones on their paths; the heaviest (severity times fade) sets colour and fade.

    ``keys`` (such as a time slot) are grouped by as well. Ties of weight go to the
    latest ``last_seen``, then to the largest id.
    """
    level = zones.select("zone_id", "level", "name").withColumnRenamed("zone_id", "zone")
    lifted = incidents.withColumn("zone", F.explode("zone_path")).join(level, "zone")
    fade = S.fade(F.col("last_seen"), now, F.col("level"), F.col("threat"))
    lifted = lifted.withColumn("fade", fade).withColumn("own", F.col("zone") == F.col("zone_id"))
    weight = F.struct((F.col("severity") * F.col("fade")).alias("w"), "last_seen", "id")
    best = F.struct("severity", "fade")
    own = F.when(F.col("own"), weight)
    return (
        lifted.groupBy(*keys, "zone", "level", "name")
        .agg(
            F.count(F.lit(1)).alias("active"),
            F.count_if("own").alias("own"),
            F.max("severity").alias("max_severity"),
            F.max("last_seen").alias("last_active"),
            F.max_by(best, weight).alias("best"),
            F.max_by(best, own).alias("best_own"),
        )
        .select(
            *keys,
            "zone",
            "level",
            "name",
            "active",
            "own",
            "max_severity",
            F.col("best.severity").alias("severity"),
            F.round("best.fade", 3).alias("fade"),
            F.coalesce("best_own.severity", F.lit(0)).alias("own_severity"),
            F.coalesce(F.round("best_own.fade", 3), F.lit(1.0)).alias("own_fade"),
            "last_active",
        )
    )


def open_at(incidents: DataFrame, now: Column, close_after: int = S.CLOSE_AFTER_SECONDS) -> DataFrame:
    """A22 for one moment: started, not cleared by then, idle no longer than ``close_after``."""
    alive = F.col("resolved_at").isNull() | (F.col("resolved_at") > now)
    return incidents.where((F.col("first_seen") <= now) & alive & (S.seconds(now, F.col("last_seen")) <= close_after))


def freshness(incidents: DataFrame, messages: DataFrame, now: Column, stale_seconds: int = 900) -> DataFrame:
    """A5: age of the data, lag of the pipeline behind the messages, and whether it is stale. One row."""
    seen = incidents.agg(F.max("last_seen").alias("newest_event"))
    posted = messages.agg(F.max("posted_at").alias("newest_message"))
    return seen.crossJoin(posted).select(
        "newest_event",
        "newest_message",
        S.seconds(now, F.col("newest_event")).alias("data_age"),
        S.seconds(F.col("newest_message"), F.col("newest_event")).alias("pipeline_lag"),
        (S.seconds(now, F.col("newest_event")) > stale_seconds).alias("stale"),
    )


def local_day(moment: Column, hours: int = 3) -> Column:
    return F.to_date(moment + F.expr(f"INTERVAL {hours} HOURS"))


def day_archive(incidents: DataFrame, sources: DataFrame, least_sources: int = 5, hours: int = 3) -> DataFrame:
    """A10: local days with enough sources: incidents, confirmed ones, sources, density against the peak day."""
    per_event = sources.groupBy(F.col("event_id").alias("id")).agg(F.collect_set("source_key").alias("keys"))
    # distinct sources of a day come from the bridge rows, not from sets gathered per day
    day = incidents.withColumn("day", local_day(F.col("first_seen"), hours))
    counts = day.groupBy("day").agg(
        F.count(F.lit(1)).alias("events"), F.max("severity").alias("max_severity"), F.count_if(F.col("source_count") > 1).alias("confirmed")
    )
    voices = day.select("id", "day").join(per_event, "id").select("day", F.explode("keys").alias("key")).groupBy("day").agg(F.count_distinct("key").alias("sources"))
    rows = counts.join(voices, "day").where(F.col("sources") >= least_sources)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("density", F.round(F.col("events") / F.max("events").over(everything), 3))


def source_analytics(sources: DataFrame, incidents: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """Per source its contributions, firsts, confirmed share and the upper median of its lag behind the first report.

    Every contribution to an incident of several sources has a lag. With
    ``messages`` (``source_key``), sources that never contributed are listed too,
    and all with their number of messages.
    """
    multi = incidents.select(F.col("id").alias("event_id"), "source_count", "first_seen")
    rows = sources.join(multi, "event_id")
    rows = rows.withColumn("lag", F.when(F.col("source_count") > 1, S.seconds(F.col("contributed_at"), F.col("first_seen"))))
    ordered = Window.partitionBy("source_key").orderBy("lag", "raw_message_id")
    lags = rows.where("lag IS NOT NULL").withColumn("rn", F.row_number().over(ordered) - 1)
    sizes = lags.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))
    median = lags.join(sizes, "source_key").where("rn = floor(n / 2)").select("source_key", F.col("lag").alias("median_lag"))
    base = rows.groupBy("source_key", "tier").agg(
        F.count(F.lit(1)).alias("contributions"),
        F.count_if(F.col("role") == "first").alias("firsts"),
        F.count_if(F.col("role") == "confirm").alias("confirms"),
        F.round(F.avg((F.col("source_count") > 1).cast("double")), 4).alias("confirmed_share"),
        F.min("contributed_at").alias("since"),
        F.max("contributed_at").alias("until"),
    )
    base = base.join(median, "source_key", "left")
    if messages is None:
        return base
    totals = messages.groupBy("source_key").agg(F.count(F.lit(1)).alias("messages"))
    return totals.join(base, "source_key", "full").fillna(0, ["messages", "contributions", "firsts", "confirms"])


def zone_analytics(incidents: DataFrame, now: Column, hours: int = 168, limit: int = 25) -> DataFrame:
    """Busiest zones of the last ``hours``."""
    rows = incidents.where((S.seconds(now, F.col("first_seen")) <= hours * 3600) & (F.col("first_seen") <= now))
    return (
        rows.groupBy("zone_id")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.max("severity").alias("max_severity"),
            F.round(F.avg("confidence"), 6).alias("avg_confidence"),
            F.round(F.avg(S.seconds(F.col("last_seen"), F.col("first_seen"))), 3).alias("avg_duration"),
        )
        .orderBy(F.desc("events"), "zone_id")
        .limit(limit)
    )


def histogram(incidents: DataFrame, kind: str, tz_offset_hours: int = 0) -> DataFrame:
    """Incidents by hour of the day or by threat."""
    key = F.hour(F.col("first_seen") + F.expr(f"INTERVAL {tz_offset_hours} HOURS")) if kind == "hour" else F.col("threat")
    return incidents.groupBy(key.alias(kind)).agg(F.count(F.lit(1)).alias("events"))


def region_digest(incidents: DataFrame, hours: int = 3) -> DataFrame:
    """Per root zone its incidents, local days, last report, and counts by signal."""
    root = incidents.withColumn("root", F.element_at("zone_path", -1))
    return root.groupBy("root").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct(local_day(F.col("first_seen"), hours)).alias("days"),
        F.max("last_seen").alias("last_seen"),
        *[F.count_if(F.col("signal") == s).alias(s) for s in ("impact", "detection", "danger", "alarm", "allclear")],
    )


def digest_counts(incidents: DataFrame, hours: int = 3) -> DataFrame:
    """Per root zone the number of its incidents by threat, by the zone below it, and by local hour: ``root, kind, value, events``."""
    root = incidents.withColumn("root", F.element_at("zone_path", -1))
    below = F.when(F.size("zone_path") > 1, F.element_at("zone_path", -2))
    hour = F.hour(F.col("first_seen") + F.expr(f"INTERVAL {hours} HOURS"))
    kinds = {"threat": F.col("threat"), "zone": below, "hour": F.lpad(hour.cast("string"), 2, "0")}
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()]))
    return root.select("root", entries.alias("e")).where("e.value IS NOT NULL").groupBy("root", "e.kind", "e.value").agg(F.count(F.lit(1)).alias("events"))


def newest_of_root(incidents: DataFrame, n: int = 6) -> DataFrame:
    """The newest ``n`` incidents of each root zone."""
    order = Window.partitionBy("root").orderBy(F.desc("last_seen"), "id")
    return (
        incidents.withColumn("root", F.element_at("zone_path", -1))
        .withColumn("rn", F.row_number().over(order))
        .where(F.col("rn") <= n)
        .select("root", "rn", "id", "last_seen")
    )


def busiest_window(incidents: DataFrame, hours: int = 3, least: int = 12, share: float = 0.35) -> DataFrame:
    """Per root the six-hour circular window with most incidents, the earliest of equals; null below the limits."""
    per_hour = (
        incidents.withColumn("root", F.element_at("zone_path", -1))
        .groupBy("root", F.hour(F.col("first_seen") + F.expr(f"INTERVAL {hours} HOURS")).alias("h"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    starts = per_hour.select("root", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.pmod(F.col("h") - k, F.lit(24)))).alias("start"))
    sums = starts.groupBy("root", "start").agg(F.sum("n").alias("events"))
    totals = per_hour.groupBy("root").agg(F.sum("n").alias("total"))
    # earliest of equals: a smaller start must win, and a start without incidents of its own can be the earliest
    best = sums.groupBy("root").agg(F.max(F.struct("events", (-F.col("start")).alias("neg"))).alias("b"))
    enough = (F.col("total") >= least) & (F.col("b.events") >= share * F.col("total"))
    return best.join(totals, "root").select("root", F.when(enough, -F.col("b.neg")).alias("start"), F.col("b.events").alias("events"), "total")


def ring_neighbours(zones: DataFrame, level: str = "region", n: int = 6) -> DataFrame:
    """The next ``n`` names in sorted order, wrapping."""
    names = zones.where(F.col("level") == level).select("zone_id", "name")
    order = Window.orderBy("name", "zone_id")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = names.withColumn("i", F.row_number().over(order) - 1).withColumn("m", F.count(F.lit(1)).over(everything))
    steps = ranked.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n)))).where("step < m").withColumn("j", (F.col("i") + F.col("step")) % F.col("m"))
    other = ranked.select(F.col("i").alias("j"), F.col("zone_id").alias("neighbour"))
    return steps.join(other, "j").select("zone_id", "step", "neighbour")


def open_per_root(incidents: DataFrame, limit: int = 6) -> DataFrame:
    """Roots with most open incidents."""
    return (
        incidents.groupBy(F.element_at("zone_path", -1).alias("root"))
        .agg(F.count(F.lit(1)).alias("open"))
        .orderBy(F.desc("open"), "root")
        .limit(limit)
    )


def open_listing(incidents: DataFrame, n: int = 10) -> DataFrame:
    """Per root the zones with open incidents, most severe and newest first (``place``), ``n`` at most."""
    rows = incidents.withColumn("root", F.element_at("zone_path", -1)).groupBy("root", "zone_id")
    zones = rows.agg(F.count(F.lit(1)).alias("open"), F.max("severity").alias("max_severity"), F.max("last_seen").alias("last_seen"))
    order = Window.partitionBy("root").orderBy(F.desc("max_severity"), F.desc("last_seen"), "zone_id")
    return zones.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def severity_bands(incidents: DataFrame, edges: tuple[int, ...] = (1, 4, 6, 8, 11)) -> DataFrame:
    """Incidents per half-open severity band, in one row."""
    bands = zip(edges, edges[1:], strict=False)
    return incidents.agg(*[F.count_if((F.col("severity") >= a) & (F.col("severity") < b)).alias(f"band_{a}_{b}") for a, b in bands])


def day_window(incidents: DataFrame, day: str, hours: int = 3) -> DataFrame:
    """Incidents that began on a local day."""
    return incidents.where(local_day(F.col("first_seen"), hours) == F.lit(day).cast("date"))


def hours_window(incidents: DataFrame, now: Column, hours: float = 24) -> DataFrame:
    """Incidents seen in the last ``hours``."""
    return incidents.where((F.col("first_seen") <= now) & (S.seconds(now, F.col("last_seen")) <= hours * 3600))


def zone_meta(incidents: DataFrame, zones: DataFrame) -> DataFrame:
    """Level, name and place of every zone on the path of an incident."""
    used = incidents.select(F.explode("zone_path").alias("zone_id")).distinct()
    return used.join(zones, "zone_id").select("zone_id", "level", "name", "lat", "lon")


def top_confirmed(incidents: DataFrame, limit: int = 10) -> DataFrame:
    """Incidents with most sources, then most confidence."""
    return incidents.orderBy(F.desc("source_count"), F.desc("confidence"), "id").limit(limit)


def slots_over(incidents: DataFrame, minutes: int = 15) -> DataFrame:
    """The time grid over a table of incidents, from the first that was seen to the last, both aligned up."""
    step = minutes * 60
    aligned = lambda at: F.timestamp_seconds(F.ceil(F.unix_micros(at) / F.lit(1_000_000 * step)) * step)
    span = incidents.agg(aligned(F.min("first_seen")).alias("a"), aligned(F.max("last_seen")).alias("b"))
    return span.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {minutes} MINUTES"))).alias("slot"))


def slots(spark, start: str, end: str, minutes: int = 15) -> DataFrame:
    """The time grid, aligned up."""
    step = minutes * 60
    first = F.timestamp_seconds(F.ceil(F.unix_timestamp(F.lit(start).cast("timestamp")) / step) * step)
    grid = F.sequence(first, F.lit(end).cast("timestamp"), F.expr(f"INTERVAL {minutes} MINUTES"))
    return spark.range(1).select(F.explode(grid).alias("slot"))


def at_slots(incidents: DataFrame, start: str, end: str, minutes: int = 15, close_after: int = S.CLOSE_AFTER_SECONDS) -> DataFrame:
    """Incidents alive at each slot. Each incident makes its own slots; there is no join over time."""
    step = minutes * 60
    low = F.greatest(F.col("first_seen"), F.lit(start).cast("timestamp"))
    alive = F.timestamp_micros(F.unix_micros("last_seen") + F.lit(close_after * 1_000_000))
    high = F.least(alive, F.lit(end).cast("timestamp"))
    first = F.ceil(F.unix_micros(low) / F.lit(step * 1_000_000)) * step
    last = F.floor(F.unix_micros(high) / F.lit(step * 1_000_000)) * step
    rows = incidents.withColumn("s", first).withColumn("e", last).where("s <= e")
    rows = rows.withColumn("slot", F.explode(F.transform(F.sequence("s", "e", F.lit(step)), F.timestamp_seconds)))
    return rows.where(F.col("resolved_at").isNull() | (F.col("resolved_at") > F.col("slot"))).drop("s", "e")


def slot_load(incidents: DataFrame, grid: DataFrame, minutes: int = 15) -> DataFrame:
    """Per slot the incidents whose span meets the ``minutes`` before it; empty slots stay."""
    step = minutes * 60
    first = F.ceil(F.unix_micros("first_seen") / F.lit(step * 1_000_000)) * step
    # overlaps (t - step, t]: first_seen <= t and last_seen > t - step
    last = F.ceil((F.unix_micros("last_seen") + F.lit(step * 1_000_000)) / F.lit(step * 1_000_000)) * step - step
    spread = incidents.select("severity", F.explode(F.sequence(first, last, F.lit(step))).alias("at"))
    per_slot = spread.groupBy(F.timestamp_seconds("at").alias("slot")).agg(F.count(F.lit(1)).alias("events"), F.max("severity").alias("max_severity"))
    return grid.join(per_slot, "slot", "left").select("slot", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("max_severity", F.lit(0)).alias("max_severity"))


def successors(points: DataFrame, least_minutes: float = 2, most_minutes: float = 50, most_km: float = 160) -> DataFrame:
    """Links from a sighting to its only possible successor.

    ``points`` are sightings of one kind of target (``id, zone_id, first_seen, lat,
    lon``). Both sides are put into buckets of the longest gap and into cells of the
    longest way, so the join is an equi-join on neighbouring buckets and cells. Cells
    are bands of latitude and, in each band, as many degrees of longitude as the way
    takes at the band's end nearer to the pole.
    """
    width = int(most_minutes * 60)
    bucket = F.floor(F.unix_micros("first_seen") / F.lit(width * 1_000_000))
    tall = most_km / 111.0
    band = F.floor(F.col("lat") / tall)

    def column_of(row: Column) -> Column:
        """Cell in a band, for the longitude of the point; the pair's mean latitude lies within a band of either."""
        edge = F.least(F.greatest(F.abs(row), F.abs(row + 1)) + 1, F.lit(89.0 / tall)) * tall
        return F.floor(F.col("lon") / (F.lit(tall) / F.cos(F.radians(edge))))

    shifts = [(t, y, x) for t in (0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1)]
    spots = F.array(*[F.struct((bucket + t).alias("bucket"), (band + y).alias("band"), (column_of(band + y) + x).alias("col")) for t, y, x in shifts])
    a = points.select(*[F.col(c).alias(f"a_{c}") for c in ("id", "zone_id", "first_seen", "lat", "lon")], F.explode(spots).alias("at")).select("*", "at.*").drop("at")
    b = points.select(*[F.col(c).alias(f"b_{c}") for c in ("id", "zone_id", "first_seen", "lat", "lon")], bucket.alias("bucket"), band.alias("band"), column_of(band).alias("col"))
    gap = S.seconds(F.col("b_first_seen"), F.col("a_first_seen")) / 60
    far = S.km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    pairs = a.join(b, ["bucket", "band", "col"]).withColumn("gap", gap).withColumn("km", far)
    ok = F.col("gap").between(least_minutes, most_minutes) & (F.col("a_zone_id") != F.col("b_zone_id"))
    ok = ok & (F.col("km") > 5) & (F.col("km") < F.least(F.lit(float(most_km)), F.lit(10) + F.col("gap") * 3.5))
    return (
        pairs.where(ok)
        .groupBy(F.col("a_id").alias("source"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("b_id").alias("successor"), F.min("b_first_seen").alias("ended"))
        .where("n = 1")
        .drop("n")
    )


def visible_trails(trails: DataFrame, now: Column, minutes: int = 60) -> DataFrame:
    """Trails that ended lately."""
    return trails.where((F.col("ended") <= now) & (S.seconds(now, F.col("ended")) < minutes * 60))


def zone_feed(incidents: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked zone (``zone``, ``region``) its own incidents or, without any, those of its region, flagged."""
    lifted = incidents.select("id", F.explode("zone_path").alias("at"))
    own = asked.join(lifted, F.col("zone") == F.col("at")).select("zone", "id", F.lit(False).alias("from_region"))
    bare = asked.join(own.select("zone").distinct(), "zone", "left_anti").where("region IS NOT NULL AND region <> zone")
    return own.unionByName(bare.join(lifted, F.col("region") == F.col("at")).select("zone", "id", F.lit(True).alias("from_region")))


def quiet_verdict(incidents: DataFrame, zones: DataFrame, now: Column) -> DataFrame:
    """Zones all of whose open incidents are past their fade window: minutes of silence and whether anything was sighted."""
    rows = incidents.join(zones.select("zone_id", "level"), "zone_id")
    past = S.seconds(now, F.col("last_seen")) >= S.fade_window(F.col("level"), F.col("threat"))
    return (
        rows.groupBy("zone_id")
        .agg(F.bool_and(past).alias("quiet"), F.max("last_seen").alias("last"), F.bool_or(F.col("signal").isin(*S.SIGHTINGS)).alias("sighted"))
        .where("quiet")
        .select("zone_id", F.floor(S.seconds(now, F.col("last")) / 60).alias("minutes"), "sighted")
        .where("minutes >= 1")
    )


def feed_filter(incidents: DataFrame, zones: DataFrame, bbox: tuple[float, float, float, float], levels: tuple[str, ...], threats: tuple[str, ...]) -> DataFrame:
    """Incidents in a box (south, west, north, east) of some levels and threats."""
    rows = incidents.join(zones.select("zone_id", "level", "lat", "lon"), "zone_id")
    inside = F.col("lat").between(bbox[0], bbox[2]) & F.col("lon").between(bbox[1], bbox[3])
    return rows.where(inside & F.col("level").isin(*levels) & F.col("threat").isin(*threats))


def quiet_count(incidents: DataFrame, zones: DataFrame, level: str = "region") -> DataFrame:
    """Zones of a level without incident, in one row."""
    lit = incidents.select(F.explode("zone_path").alias("zone_id")).distinct()
    return zones.where(F.col("level") == level).join(lit, "zone_id", "left_anti").agg(F.count(F.lit(1)).alias("quiet"))


def point_layer(incidents: DataFrame, zones: DataFrame, now: Column) -> DataFrame:
    """Incidents that are points (sightings below region level) with freshness and visibility."""
    rows = incidents.join(zones.select("zone_id", "level", "lat", "lon"), "zone_id")
    rows = rows.where(F.col("signal").isin(*S.SIGHTINGS) & (F.col("level") != "region"))
    fresh = S.fade(F.col("last_seen"), now, F.lit("district"), F.col("threat"))
    kind = F.when(F.col("signal") == "impact", "impact").otherwise(F.col("threat"))
    return rows.select("id", "lat", "lon", kind.alias("kind"), F.round(fresh, 6).alias("freshness"), (fresh > S.FADE_FLOOR).alias("visible"))
