"""Registered state, history and analytics queries (A1-A31) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import scoring as S
from siftline.operators import state
from siftline.plans import views as V

NOW, T0, T1 = V.NOW_SQL, "2024-01-10 00:07:00", "2024-01-11 00:00:00"
_FADE = S.fade_sql("last_seen", NOW, "z.level", "threat")
_DAYS = 3 * 86400  # the views are sparse, so "open" is three days here


def _open(s, d):
    return state.open_at(V.incidents(s, d), V.now(), _DAYS)


_OPEN = f"open AS (SELECT * FROM incidents WHERE first_seen <= {NOW} AND (resolved_at IS NULL OR resolved_at > {NOW}) AND epoch_us({NOW}) - epoch_us(last_seen) <= {_DAYS * 1_000_000})"
_I, _IZ = f"WITH {V.INCIDENTS}", f"WITH {V.INCIDENTS}, {V.ZONES}"
_IO, _IZO = f"{_I}, {_OPEN}", f"{_IZ}, {_OPEN}"
_ROLL = """SELECT {keys}zone, level, name, count(*) AS active, count(*) FILTER (own) AS own, max(severity) AS max_severity,
  arg_max(severity, (w, last_seen, id)) AS severity, round(arg_max(fade, (w, last_seen, id)), 3) AS fade,
  coalesce(arg_max(severity, (w, last_seen, id)) FILTER (own), 0) AS own_severity, coalesce(round(arg_max(fade, (w, last_seen, id)) FILTER (own), 3), 1.0) AS own_fade,
  max(last_seen) AS last_active FROM weighed GROUP BY {keys}zone, level, name"""


def _rollup_sql(source: str, now: str, keys: str = "") -> str:
    fade = S.fade_sql("last_seen", now, "z.level", "threat")
    return f""", lifted AS (SELECT *, unnest(zone_path) AS zone FROM {source}), faded AS (
  SELECT l.*, z.level, z.name, {fade} AS fade, zone = l.zone_id AS own FROM lifted l JOIN zones z ON z.zone_id = zone
), weighed AS (SELECT *, severity * fade AS w FROM faded) {_ROLL.format(keys=keys)}"""


def _texts(s, d):
    """Messages of the sources of the incidents, every fortieth event being one of a source that never contributes."""
    silent = F.when(F.col("event_id") % 40 == 7, F.lit("silent")).otherwise(F.concat(F.lit("s"), F.col("event_id") % 20))
    return V.read(s, d, "events").select(silent.alias("source_key"))


def _slots(s, d):
    return state.at_slots(V.incidents(s, d), T0, T1)


_GRID = f"grid AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-10 00:15:00', TIMESTAMP '{T1}', INTERVAL 15 MINUTE)) AS slot)"
_SLOTS = f"""{_GRID}, at_slots AS (SELECT i.*, slot FROM incidents i JOIN grid ON first_seen <= slot AND (resolved_at IS NULL OR resolved_at > slot)
  AND epoch_us(slot) - epoch_us(last_seen) <= {S.CLOSE_AFTER_SECONDS * 1_000_000})"""


def _points(s, d):
    z = V.zones(s, d).select("zone_id", "level", "lat", "lon")
    rows = V.incidents(s, d).join(z, "zone_id")
    return rows.where((F.col("threat") == "uav") & F.col("signal").isin(*S.SIGHTINGS) & (F.col("level") != "region"))


_TRAILS = f"""points AS (SELECT i.id, i.zone_id, first_seen, lat, lon FROM incidents i JOIN zones z USING (zone_id) WHERE threat = 'uav' AND signal IN ('detection', 'intercept', 'impact') AND level <> 'region'),
pairs AS (SELECT a.id AS source, b.id AS successor, b.first_seen AS ended, (epoch_us(b.first_seen) - epoch_us(a.first_seen)) / 60e6 AS gap, {S.km_sql("a.lat", "a.lon", "b.lat", "b.lon")} AS km
  FROM points a JOIN points b ON a.zone_id <> b.zone_id AND b.first_seen > a.first_seen AND b.first_seen < a.first_seen + INTERVAL 51 MINUTE),
trails AS (SELECT source, min(successor) AS successor, min(ended) AS ended FROM pairs WHERE gap BETWEEN 2 AND 50 AND km > 5 AND km < least(160.0, 10 + gap * 3.5) GROUP BY source HAVING count(*) = 1)"""


def _asked(s, d):
    return V.zones(s, d).where("level = 'district'").select(F.col("zone_id").alias("zone"), F.col("parent_id").alias("region"))


QUERIES = {
    "a01_recent_events": lambda s, d: state.recent(V.incidents(s, d), V.zones(s, d), F.lit("2024-01-15").cast("timestamp"), V.now()).select(
        "id", "zone_id", "zone_name", "parent_name", "level", "severity", "last_seen"
    ),
    "a02_snapshot": lambda s, d: state.snapshot(V.incidents(s, d), V.now(), 72, 4320).select("id", "zone_id", "threat", "status", "last_seen"),
    "a03_fade_weight": lambda s, d: V.incidents(s, d)
    .join(V.zones(s, d).select("zone_id", "level"), "zone_id")
    .select(
        "id",
        F.round(S.fade_window(F.col("level"), F.col("threat")), 3).alias("window_s"),
        F.round(S.fade(F.col("first_seen"), F.col("last_seen"), F.col("level"), F.col("threat")), 9).alias("fade"),
    ),
    "a04_zone_rollup": lambda s, d: state.zone_rollup(_open(s, d), V.zones(s, d), V.now()),
    "a05_freshness": lambda s, d: state.freshness(V.incidents(s, d), V.messages(s, d), V.now()),
    "a10_day_archive": lambda s, d: state.day_archive(V.incidents(s, d), V.event_sources(s, d)),
    "a11_day_window": lambda s, d: state.day_window(V.incidents(s, d), "2024-01-12").select("id", "first_seen"),
    "a11_hours_window": lambda s, d: state.hours_window(V.incidents(s, d), V.now(), 72).select("id", "last_seen"),
    "a12_zone_meta": lambda s, d: state.zone_meta(_open(s, d), V.zones(s, d)).select("zone_id", "level", "name"),
    "a13_source_analytics": lambda s, d: state.source_analytics(V.event_sources(s, d), V.incidents(s, d), _texts(s, d)),
    "a14_zone_analytics": lambda s, d: state.zone_analytics(V.incidents(s, d), V.now()),
    "a15_hour_histogram": lambda s, d: state.histogram(V.incidents(s, d), "hour"),
    "a15_threat_histogram": lambda s, d: state.histogram(V.incidents(s, d), "threat"),
    "a16_region_digest": lambda s, d: state.region_digest(V.incidents(s, d)),
    "a16_digest_counts": lambda s, d: state.digest_counts(V.incidents(s, d)),
    "a16_newest_of_region": lambda s, d: state.newest_of_root(V.incidents(s, d)),
    "a17_busiest_window": lambda s, d: state.busiest_window(V.incidents(s, d), share=0.2),
    "a18_ring_neighbours": lambda s, d: state.ring_neighbours(V.zones(s, d), "district"),
    "a19_open_per_region": lambda s, d: state.open_per_root(_open(s, d)),
    "a19_open_zones": lambda s, d: state.open_listing(_open(s, d)),
    "a20_severity_bands": lambda s, d: state.severity_bands(V.incidents(s, d)),
    "a21_time_grid": lambda s, d: state.slots_over(V.incidents(s, d)),
    "a22_as_of_snapshot": lambda s, d: _slots(s, d).select("slot", "id"),
    "a23_rollup_by_slot": lambda s, d: state.zone_rollup(_slots(s, d), V.zones(s, d), F.col("slot"), ("slot",)),
    "a24_slot_load": lambda s, d: state.slot_load(V.incidents(s, d), state.slots(s, T0, T1)),
    "a25_successors": lambda s, d: state.successors(_points(s, d)),
    "a26_visible_trails": lambda s, d: state.visible_trails(state.successors(_points(s, d)), V.now(), 4320),
    "a27_zone_feed": lambda s, d: state.zone_feed(_open(s, d).where("severity > 2"), _asked(s, d)),
    "a28_quiet_verdict": lambda s, d: state.quiet_verdict(_open(s, d), V.zones(s, d), V.now()),
    "a29_feed_filter": lambda s, d: state.feed_filter(V.incidents(s, d), V.zones(s, d), (42.0, 22.0, 46.0, 40.0), ("place",), ("uav", "rocket")).select("id", "zone_id"),
    "a30_quiet_zones": lambda s, d: state.quiet_count(_open(s, d), V.zones(s, d), "place"),
    "a31_point_layer": lambda s, d: state.point_layer(_open(s, d), V.zones(s, d), V.now()),
    "a42_top_confirmed": lambda s, d: state.top_confirmed(V.incidents(s, d)).select("id", "source_count", "confidence"),
}

ORACLE = {
    "a01_recent_events": f"""{_IZ}, top AS (SELECT * FROM incidents WHERE last_seen >= TIMESTAMP '2024-01-15' AND first_seen < {NOW} ORDER BY last_seen DESC, id LIMIT 400)
SELECT id, t.zone_id, z.name AS zone_name, p.name AS parent_name, z.level, severity, last_seen FROM top t JOIN zones z USING (zone_id) LEFT JOIN zones p ON p.zone_id = z.parent_id""",
    "a02_snapshot": f"""{_I}, seen AS (SELECT *, CASE WHEN resolved_at IS NOT NULL OR epoch_us({NOW}) - epoch_us(last_seen) > 10800000000 THEN 'resolved' WHEN epoch_us({NOW}) - epoch_us(last_seen) > 2700000000 THEN 'fading' ELSE 'active' END AS status
  FROM incidents WHERE epoch_us({NOW}) - epoch_us(last_seen) <= 72 * 3600000000::BIGINT AND first_seen <= {NOW}),
cleared AS (SELECT *, row_number() OVER (PARTITION BY zone_id, threat ORDER BY resolved_at DESC, id) AS rn FROM seen WHERE resolved_at IS NOT NULL AND epoch_us({NOW}) - epoch_us(resolved_at) <= 4320 * 60000000::BIGINT)
SELECT id, zone_id, threat, status, last_seen FROM seen WHERE resolved_at IS NULL AND status <> 'resolved' UNION ALL SELECT id, zone_id, threat, status, last_seen FROM cleared WHERE rn = 1""",
    "a03_fade_weight": f"""{_IZ} SELECT id, round(greatest(480.0::DOUBLE, (CASE z.level WHEN 'place' THEN 1200.0::DOUBLE WHEN 'region' THEN 9900.0 ELSE 2100.0 END) * (CASE threat WHEN 'rocket' THEN 0.2 WHEN 'aviation' THEN 0.3 ELSE 1.0 END)), 3) AS window_s,
  round({S.fade_sql("first_seen", "last_seen", "z.level", "threat")}, 9) AS fade FROM incidents JOIN zones z USING (zone_id)""",
    "a04_zone_rollup": _IZO + _rollup_sql("open", NOW),
    "a05_freshness": f"""WITH {V.INCIDENTS}, {V.MESSAGES} SELECT e AS newest_event, m AS newest_message, (epoch_us({NOW}) - epoch_us(e)) / 1e6 AS data_age, (epoch_us(m) - epoch_us(e)) / 1e6 AS pipeline_lag,
  (epoch_us({NOW}) - epoch_us(e)) / 1e6 > 900 AS stale FROM (SELECT max(last_seen) AS e FROM incidents), (SELECT max(posted_at) AS m FROM messages)""",
    "a10_day_archive": f"""WITH {V.INCIDENTS}, {V.EVENT_SOURCES.replace(V.SESSIONS + ", ", "")}, days AS (SELECT *, (first_seen + INTERVAL 3 HOUR)::DATE AS day FROM incidents),
counts AS (SELECT day, count(*) AS events, max(severity) AS max_severity, count(*) FILTER (source_count > 1) AS confirmed FROM days GROUP BY day),
voices AS (SELECT day, count(DISTINCT source_key) AS sources FROM days JOIN event_sources ON event_id = id GROUP BY day)
SELECT day, events, max_severity, confirmed, sources, round(events / max(events) OVER (), 3) AS density FROM counts JOIN voices USING (day) WHERE sources >= 5""",
    "a11_day_window": f"{_I} SELECT id, first_seen FROM incidents WHERE (first_seen + INTERVAL 3 HOUR)::DATE = DATE '2024-01-12'",
    "a11_hours_window": f"{_I} SELECT id, last_seen FROM incidents WHERE first_seen <= {NOW} AND epoch_us({NOW}) - epoch_us(last_seen) <= 72 * 3600000000::BIGINT",
    "a12_zone_meta": f"{_IZO} SELECT DISTINCT z.zone_id, level, name FROM (SELECT unnest(zone_path) AS zone_id FROM open) JOIN zones z USING (zone_id)",
    "a13_source_analytics": f"""WITH {V.INCIDENTS}, {V.EVENT_SOURCES.replace(V.SESSIONS + ", ", "")}, joined AS (
  SELECT s.*, source_count, CASE WHEN source_count > 1 THEN (epoch_us(contributed_at) - epoch_us(first_seen)) / 1e6 END AS lag FROM event_sources s JOIN incidents ON id = event_id)
SELECT source_key, coalesce(messages, 0) AS messages, tier, coalesce(contributions, 0) AS contributions, coalesce(firsts, 0) AS firsts, coalesce(confirms, 0) AS confirms, confirmed_share, since, until, median_lag
FROM (SELECT CASE WHEN event_id % 40 = 7 THEN 'silent' ELSE 's' || (event_id % 20) END AS source_key, count(*) AS messages FROM events GROUP BY 1) FULL JOIN (
SELECT source_key, tier, count(*) AS contributions, count(*) FILTER (role = 'first') AS firsts, count(*) FILTER (role = 'confirm') AS confirms,
  round(avg(CASE WHEN source_count > 1 THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS confirmed_share, min(contributed_at) AS since, max(contributed_at) AS until,
  list_sort(list(lag) FILTER (lag IS NOT NULL))[1 + len(list(lag) FILTER (lag IS NOT NULL)) // 2] AS median_lag FROM joined GROUP BY source_key, tier) USING (source_key)""",
    "a14_zone_analytics": f"""{_I} SELECT zone_id, count(*) AS events, max(severity) AS max_severity, round(avg(confidence), 6) AS avg_confidence, round(avg((epoch_us(last_seen) - epoch_us(first_seen)) / 1e6), 3) AS avg_duration
  FROM incidents WHERE first_seen <= {NOW} AND epoch_us({NOW}) - epoch_us(first_seen) <= 168 * 3600000000::BIGINT GROUP BY zone_id ORDER BY events DESC, zone_id LIMIT 25""",
    "a15_hour_histogram": f"{_I} SELECT hour(first_seen)::INT AS hour, count(*) AS events FROM incidents GROUP BY 1",
    "a15_threat_histogram": f"{_I} SELECT threat, count(*) AS events FROM incidents GROUP BY 1",
    "a16_region_digest": f"""{_I} SELECT zone_path[-1] AS root, count(*) AS events, count(DISTINCT (first_seen + INTERVAL 3 HOUR)::DATE) AS days, max(last_seen) AS last_seen,
  {", ".join(f"count(*) FILTER (signal = '{x}') AS {x}" for x in ("impact", "detection", "danger", "alarm", "allclear"))} FROM incidents GROUP BY 1""",
    "a16_digest_counts": f"""{_I}, root AS (SELECT zone_path[-1] AS root, threat, zone_path[-2] AS zone, lpad(hour(first_seen + INTERVAL 3 HOUR)::VARCHAR, 2, '0') AS hour FROM incidents)
SELECT root, 'threat' AS kind, threat AS value, count(*) AS events FROM root GROUP BY 1, 2, 3 UNION ALL SELECT root, 'zone', zone, count(*) FROM root GROUP BY 1, 2, 3 UNION ALL SELECT root, 'hour', hour, count(*) FROM root GROUP BY 1, 2, 3""",
    "a16_newest_of_region": f"{_I} SELECT * FROM (SELECT zone_path[-1] AS root, (row_number() OVER (PARTITION BY zone_path[-1] ORDER BY last_seen DESC, id))::INT AS rn, id, last_seen FROM incidents) WHERE rn <= 6",
    "a17_busiest_window": f"""{_I}, hours AS (SELECT zone_path[-1] AS root, hour(first_seen + INTERVAL 3 HOUR)::INT AS h, count(*) AS n FROM incidents GROUP BY 1, 2),
sums AS (SELECT root, (h - k + 24) % 24 AS start, sum(n)::BIGINT AS events FROM hours, (SELECT unnest(range(6))::INT AS k) GROUP BY 1, 2), best AS (SELECT root, start, events, row_number() OVER (PARTITION BY root ORDER BY events DESC, start) AS rn FROM sums)
SELECT root, CASE WHEN total >= 12 AND events >= 0.2 * total THEN start END::INT AS start, events, total FROM best JOIN (SELECT root, sum(n)::BIGINT AS total FROM hours GROUP BY root) USING (root) WHERE rn = 1""",
    "a18_ring_neighbours": f"""WITH {V.ZONES}, ranked AS (SELECT zone_id, row_number() OVER (ORDER BY name, zone_id) - 1 AS i, count(*) OVER () AS m FROM zones WHERE level = 'district')
SELECT a.zone_id, step, b.zone_id AS neighbour FROM ranked a, (SELECT unnest(range(1, 7))::INT AS step), ranked b WHERE step < a.m AND b.i = (a.i + step) % a.m""",
    "a19_open_per_region": f"{_IO} SELECT zone_path[-1] AS root, count(*) AS open FROM open GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6",
    "a19_open_zones": f"""{_IO}, g AS (SELECT zone_path[-1] AS root, zone_id, count(*) AS open, max(severity) AS max_severity, max(last_seen) AS last_seen FROM open GROUP BY 1, 2)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY root ORDER BY max_severity DESC, last_seen DESC, zone_id))::INT AS place FROM g) WHERE place <= 10""",
    "a20_severity_bands": f"{_I} SELECT {', '.join(f'count(*) FILTER (severity >= {a} AND severity < {b}) AS band_{a}_{b}' for a, b in ((1, 4), (4, 6), (6, 8), (8, 11)))} FROM incidents",
    "a21_time_grid": f"""{_I} SELECT unnest(generate_series(make_timestamp((ceil(min(epoch_us(first_seen)) / 9e8) * 900000000)::BIGINT), make_timestamp((ceil(max(epoch_us(last_seen)) / 9e8) * 900000000)::BIGINT), INTERVAL 15 MINUTE)) AS slot FROM incidents""",
    "a22_as_of_snapshot": f"{_I}, {_SLOTS} SELECT slot, id FROM at_slots",
    "a23_rollup_by_slot": f"{_IZ}, {_SLOTS}" + _rollup_sql("at_slots", "slot", "slot, "),
    "a24_slot_load": f"""{_I}, {_GRID} SELECT slot, count(id) AS events, coalesce(max(severity), 0) AS max_severity FROM grid LEFT JOIN incidents ON first_seen <= slot AND last_seen > slot - INTERVAL 15 MINUTE GROUP BY slot""",
    "a25_successors": f"{_IZ}, {_TRAILS} SELECT source, successor, ended FROM trails",
    "a26_visible_trails": f"{_IZ}, {_TRAILS} SELECT source, successor, ended FROM trails WHERE ended <= {NOW} AND epoch_us({NOW}) - epoch_us(ended) < 4320 * 60000000::BIGINT",
    "a27_zone_feed": f"""{_IZO}, asked AS (SELECT zone_id AS zone, parent_id AS region FROM zones WHERE level = 'district'), lifted AS (SELECT id, unnest(zone_path) AS spot FROM open WHERE severity > 2), own AS (SELECT zone, id FROM asked JOIN lifted ON zone = spot)
SELECT zone, id, false AS from_region FROM own UNION ALL SELECT zone, id, true FROM asked JOIN lifted ON region = spot WHERE zone NOT IN (SELECT zone FROM own)""",
    "a28_quiet_verdict": f"""{_IZO}, judged AS (SELECT o.*, (epoch_us({NOW}) - epoch_us(last_seen)) / 1e6 >= greatest(480.0::DOUBLE, (CASE z.level WHEN 'place' THEN 1200.0::DOUBLE WHEN 'region' THEN 9900.0 ELSE 2100.0 END) * (CASE threat WHEN 'rocket' THEN 0.2 WHEN 'aviation' THEN 0.3 ELSE 1.0 END)) AS past FROM open o JOIN zones z USING (zone_id))
SELECT zone_id, minutes, sighted FROM (SELECT zone_id, bool_and(past) AS quiet, floor((epoch_us({NOW}) - epoch_us(max(last_seen))) / 60e6)::BIGINT AS minutes, bool_or(signal IN ('detection', 'intercept', 'impact')) AS sighted FROM judged GROUP BY zone_id) WHERE quiet AND minutes >= 1""",
    "a29_feed_filter": f"{_IZ} SELECT id, zone_id FROM incidents JOIN zones USING (zone_id) WHERE lat BETWEEN 42 AND 46 AND lon BETWEEN 22 AND 40 AND level = 'place' AND threat IN ('uav', 'rocket')",
    "a30_quiet_zones": f"{_IZO} SELECT count(*) AS quiet FROM zones WHERE level = 'place' AND zone_id NOT IN (SELECT unnest(zone_path) FROM open)",
    "a31_point_layer": f"""{_IZO} SELECT id, lat, lon, CASE WHEN signal = 'impact' THEN 'impact' ELSE threat END AS kind, round(f, 6) AS freshness, f > 0.12 AS visible
  FROM (SELECT o.*, lat, lon, {S.fade_sql("last_seen", NOW, "'district'", "threat")} AS f FROM open o JOIN zones z USING (zone_id) WHERE signal IN ('detection', 'intercept', 'impact') AND level <> 'region')""",
    "a42_top_confirmed": f"{_I} SELECT id, source_count, confidence FROM incidents ORDER BY source_count DESC, confidence DESC, id LIMIT 10",
}
