"""Registered fusion queries (F). The fold itself has no SQL; its parts do."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import scoring as S
from siftline.operators import fusion
from siftline.plans import views as V
from siftline.sources.scratch import materialize


def _fused(s, d):
    return fusion.fuse(V.observations(s, d))


def _plain(s, d):
    """Reports without all-clears and unknown threats, by region: what SQL can follow, one threat at a time."""
    rows = V.observations(s, d).where("threat <> 'unknown'")
    return rows.withColumn("zone_id", F.element_at("zone_path", 3)).withColumn("zone_path", F.array("zone_id")).withColumn("level", F.lit("region"))


def _flat_incidents(fused):
    return fused.drop("contributions", "zone_path", "lat", "lon", "direction_deg", "target_count")


#: The same walk in SQL: every report knows the one before it of its zone and threat.
_WALK = f"""WITH RECURSIVE {V.OBSERVATIONS}, reports AS (
  SELECT raw_id, source_key, tier, moment, epoch_us(moment) AS us, signal, threat, severity, zone_path[3] AS zone_id,
    row_number() OVER (PARTITION BY zone_path[3], threat ORDER BY moment, raw_id) AS n FROM observations WHERE threat <> 'unknown'
), walk AS (
  SELECT zone_id, threat, n, raw_id, raw_id AS opener, us AS seen, [source_key] AS voices, true AS fresh FROM reports WHERE n = 1
  UNION ALL
  SELECT r.zone_id, r.threat, r.n, r.raw_id, CASE WHEN r.us - w.seen <= 900000000 THEN w.opener ELSE r.raw_id END,
    CASE WHEN r.us - w.seen <= 900000000 AND list_contains(w.voices, r.source_key) THEN w.seen ELSE r.us END,
    CASE WHEN r.us - w.seen > 900000000 THEN [r.source_key] WHEN list_contains(w.voices, r.source_key) THEN w.voices ELSE list_append(w.voices, r.source_key) END,
    r.us - w.seen > 900000000 OR NOT list_contains(w.voices, r.source_key)
  FROM walk w JOIN reports r ON r.zone_id = w.zone_id AND r.threat = w.threat AND r.n = w.n + 1
), assigned AS (
  SELECT r.*, w.opener, w.fresh, substr(sha1(r.zone_id || '|' || r.threat || '|' || strftime(o.moment, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o.us % 1000000 <> 0 THEN strftime(o.moment, '.%f') ELSE '' END || '+00:00'), 1, 16) AS id
  FROM walk w JOIN reports r ON r.raw_id = w.raw_id JOIN reports o ON o.raw_id = w.opener
)"""


_I = f"WITH {V.INCIDENTS}"
QUERIES = {
    "f01_fused_events": lambda s, d: _fused(s, d).drop("contributions", "zone_path"),
    "f01_fused_reports": lambda s, d: _flat_incidents(fusion.fuse(_plain(s, d))),
    "f06_contributions": lambda s, d: fusion.contributions(fusion.assign(V.observations(s, d))),
    "f06_report_roles": lambda s, d: fusion.contributions(fusion.assign(_plain(s, d))),
    "f07_confidence": lambda s, d: V.incidents(s, d).select("id", "confidence"),
    "f08_event_ids": lambda s, d: V.observations(s, d).select("raw_id", fusion.event_id(F.col("zone_id"), F.col("threat"), F.col("moment")).alias("id")),
    "f09_status": lambda s, d: V.incidents(s, d).select("id", S.status(F.col("resolved_at"), F.col("last_seen"), V.now()).alias("status")),
    "f11_accuracy": lambda s, d: V.zones(s, d).select("zone_id", S.accuracy(F.col("level")).alias("accuracy_m")),
    "f12_destination_downgrade": lambda s, d: _downgraded(V.observations(s, d)),
    "f14_upsert": lambda s, d: fusion.upsert(*_flat(s, d)),
    "f16_summary": lambda s, d: fusion.summary(_fused(s, d)),
    "f00_sessionize": lambda s, d: V.sessions(s, d).select("raw_id", "session"),
}


def _downgraded(rows):
    signal, severity = fusion.destination_only(F.col("signal"), F.col("severity"), F.col("raw_id") % 2 == 0)
    return rows.select("raw_id", signal.alias("signal"), severity.alias("severity"))


def _flat(s, d):
    """What is stored and what is fresh, of incidents that are made once."""
    columns = ("id", "first_seen", "last_seen", "severity", "source_count", "confidence", "massive", "resolved_at", "threat")
    rows = materialize(V.incidents(s, d).withColumn("massive", F.col("severity") > 3).select(*columns), "upsert-incidents")
    late = rows.where("severity > 1").withColumn("last_seen", F.col("last_seen") + F.expr("INTERVAL 1 MINUTE")).withColumn("resolved_at", F.lit(None).cast("timestamp"))
    return rows.where("severity < 5"), late


ORACLE = {
    "f07_confidence": f"{_I} SELECT id, confidence FROM incidents",
    "f01_fused_reports": f"""{_WALK} SELECT id, zone_id, threat, arg_max(signal, (severity, CASE signal WHEN 'impact' THEN 3 WHEN 'intercept' THEN 2 WHEN 'detection' THEN 1 ELSE 0 END, -us, -raw_id)) AS signal,
  max(severity) AS severity, min(moment) AS first_seen, max(CASE WHEN fresh THEN moment END) AS last_seen, NULL::TIMESTAMP AS resolved_at, 40000 AS accuracy_m, false AS massive,
  count(DISTINCT source_key)::INT AS source_count, count(DISTINCT source_key)::INT AS voices,
  round(1 - pow(0.28, count(*) FILTER (fresh AND tier = 'official')) * pow(0.45, count(*) FILTER (fresh AND tier = 'federal')) * pow(0.6, count(*) FILTER (fresh AND tier = 'regional')) * pow(0.75, count(*) FILTER (fresh AND tier = 'mixed')) + 1e-9, 3) AS confidence
  FROM assigned GROUP BY id, zone_id, threat""",
    "f06_report_roles": f"""{_WALK} SELECT id, raw_id, source_key, moment AS "at", CASE WHEN raw_id = opener THEN 'first' WHEN row_number() OVER (PARTITION BY id, source_key ORDER BY moment, raw_id) = 1 THEN 'confirm' ELSE 'repeat' END AS role FROM assigned""",
    "f08_event_ids": f"WITH {V.OBSERVATIONS} SELECT raw_id, substr(sha1(zone_id || '|' || threat || '|' || strftime(moment, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(moment) % 1000000 <> 0 THEN strftime(moment, '.%f') ELSE '' END || '+00:00'), 1, 16) AS id FROM observations",
    "f09_status": f"""{_I} SELECT id, CASE WHEN resolved_at IS NOT NULL OR epoch_us({V.NOW_SQL}) - epoch_us(last_seen) > 10800000000 THEN 'resolved' WHEN epoch_us({V.NOW_SQL}) - epoch_us(last_seen) > 2700000000 THEN 'fading' ELSE 'active' END AS status FROM incidents""",
    "f11_accuracy": f"WITH {V.ZONES} SELECT zone_id, CASE level WHEN 'place' THEN 4000 WHEN 'region' THEN 40000 ELSE 12000 END AS accuracy_m FROM zones",
    "f12_destination_downgrade": f"WITH {V.OBSERVATIONS} SELECT raw_id, CASE WHEN raw_id % 2 = 0 AND severity > 5 THEN 'danger' ELSE signal END AS signal, CASE WHEN raw_id % 2 = 0 AND severity > 5 THEN 5 ELSE severity END AS severity FROM observations",
    "f14_upsert": f"""{_I}, both_ AS (SELECT id, first_seen, last_seen, severity, source_count, confidence, severity > 3 AS massive, resolved_at, threat FROM incidents WHERE severity < 5
  UNION ALL SELECT id, first_seen, last_seen + INTERVAL 1 MINUTE, severity, source_count, confidence, severity > 3, NULL, threat FROM incidents WHERE severity > 1)
SELECT id, min(first_seen) AS first_seen, max(last_seen) AS last_seen, max(severity) AS severity, max(source_count) AS source_count, max(confidence) AS confidence, bool_or(massive) AS massive, max(resolved_at) AS resolved_at, any_value(threat) AS threat FROM both_ GROUP BY id""",
    "f00_sessionize": f"WITH {V.SESSIONS} SELECT raw_id, session::BIGINT AS session FROM sessions",
}
