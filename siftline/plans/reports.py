"""Registered queries from messages to incidents (T9-T20, F13, F15, F16, R1) over alerts made of the driver's orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import parsing
from siftline.operators import fusion, linking, observe
from siftline.plans import views as V
from siftline.streaming import fuse as stream

#: Texts of the view by order key; {c} is the customer's zone, {n} its nation and {o} the nation behind that.
FORMS = (
    "Drone detected, {c}",
    "Rocket danger: {n}",
    "Join our channel, drone alarm in {n}",
    "All clear for drones in {n}",
    "Aircraft sighted",
    "Drones detected near {c} heading for {o}",
    "Unconfirmed explosion of a missile in {n}",
    "The situation is calm, no threats in {n}",
    "Swarm of drones in the sky over {c}",
)


#: Pieces of texts in which every rule of the default book can be met, alone and beside others.
PIECES = (
    "explosion heard", "a drone detected", "rocket launch", "all clear", "airport restrictions", "restrictions lifted", "debris found", "debris fell", "no damage", "please subscribe to us", "our channel will move",
    "list of stations", "what to do if it comes", "two killed people", "writes the times", "a plane crash", "over the past night", "no changes", "supplies of weapons", "far overseas", "across the border", "in their territory",
    "in our region", "according to the agency", "the president", "unconfirmed", "expect detections", "possible to be intercepted", "shot down", "a fire", "activity", "7 drones", "a swarm", "heading for Alpha", "be careful",
    "official warning", "over the strait", "situation is calm", "sea drone", "bridge", "false alarm", "danger", "threat", "moving", "until the all clear", "missile sighted", "guided bomb", "after the attack", "write to @us",
)


def ruled(s, d):
    """Texts of three pieces each by order key; every eighth is as long as an article."""
    k, n = F.col("o_orderkey"), len(PIECES)
    piece = lambda at: F.element_at(F.array(*[F.lit(p) for p in PIECES]), (at % n + 1).cast("int"))
    parts = [piece(k), piece(F.floor(k / 5)), piece(F.floor(k / 31)), F.when(k % 8 == 0, F.repeat(F.lit("and so it goes on "), 20)).otherwise("")]
    return V.read(s, d, "orders").select(k.alias("message_id"), F.concat_ws(", ", *parts).alias("text"))


def _hit(pattern: str, column: str = "clean") -> str:
    return f"regexp_matches({column}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def _pick(rules, column: int, other: str) -> str:
    value = lambda x: str(x) if isinstance(x, int) else f"'{x}'"
    return "CASE " + " ".join(f"WHEN {_hit(r[1])} THEN {value(r[column])}" for r in rules) + f" ELSE {other} END"


def _ruled_sql(book: parsing.RuleBook) -> str:
    """The parse of :func:`ruled` step by step, from the same book."""
    n, pieces = len(PIECES), "['" + "', '".join(PIECES) + "']"
    given = f"""given AS (SELECT o_orderkey AS message_id, concat_ws(', ', p[o_orderkey % {n} + 1], p[o_orderkey // 5 % {n} + 1], p[o_orderkey // 31 % {n} + 1], CASE WHEN o_orderkey % 8 = 0 THEN repeat('and so it goes on ', 20) ELSE '' END) AS text
  FROM orders, (SELECT {pieces} AS p))"""
    body = f"""bodies AS (SELECT message_id, CASE WHEN {_hit(book.footer, 'lower(text)')} OR (length(trim(text)) <= 100 AND contains(text, '{book.brand}')) THEN '' ELSE trim(text) END AS body FROM given),
cleaned AS (SELECT *, regexp_replace(lower(body), '{book.instruction}', ' ', 'g') AS clean FROM bodies)"""
    named = f"named AS (SELECT *, {_pick([(t, p) for t, p in book.threats], 0, chr(39) + 'unknown' + chr(39))} AS threat0 FROM cleaned)"
    weak = lambda c, other: f"CASE WHEN threat0 <> 'unknown' THEN {_pick(book.weak_signals, c, other)} ELSE {other} END"
    first = f"first AS (SELECT *, {_pick(book.signals, 0, weak(0, chr(39) + 'unknown' + chr(39)))} AS label0, {_pick(book.signals, 2, weak(2, '1'))} AS level0 FROM named)"
    opened = f"label0 = 'infra' AND {_hit(book.opened)}"
    paired = f"""paired AS (SELECT *, CASE WHEN {opened} THEN 'allclear' ELSE label0 END AS label1, CASE WHEN {opened} THEN 0 ELSE level0 END AS level1,
  CASE WHEN label0 = 'infra' AND threat0 = 'unknown' THEN CASE WHEN {_hit(book.air_infra)} THEN 'airport' ELSE 'infra' END ELSE threat0 END AS threat FROM first)"""
    evidence = " OR ".join([_hit(book.moving), _hit(book.coming), _hit(book.counted), _hit(book.crowd), f"length(clean) <= {parsing.TELEGRAM_CHARS}"])
    found = f"""evident AS (SELECT *, label1 = 'unknown' AND (threat <> 'unknown' OR {_hit(book.counted)}) AND NOT {_hit(book.third_country)} AND ({evidence}) AS holds, {_hit(book.coming)} AS comes FROM paired),
found AS (SELECT *, CASE WHEN holds AND comes THEN 'danger' WHEN holds THEN 'detection' ELSE label1 END AS label2, CASE WHEN holds AND comes THEN 5 WHEN holds THEN 8 ELSE level1 END AS level2 FROM evident)"""
    doubt = lambda c, other: "CASE " + " ".join(f"WHEN label2 = '{r[0]}' AND {_hit(book.unconfirmed)} THEN " + (f"'{r[1]}'" if c == 1 else str(r[2])) for r in book.doubted) + f" ELSE {other} END"
    doubted = f"doubted AS (SELECT *, {doubt(1, 'label2')} AS label3, {doubt(2, 'level2')} AS level3, regexp_replace(clean, '{book.anticipation}', ' ', 'g') AS rest FROM found)"
    ahead = lambda c, other: "CASE " + " ".join(f"WHEN label3 = '{r[0]}' AND {_hit(book.anticipation)} AND NOT {_hit(r[1], 'rest')} THEN " + (f"'{r[2]}'" if c == 2 else str(r[3])) for r in book.expected) + f" ELSE {other} END"
    final = f"final AS (SELECT *, {ahead(2, 'label3')} AS signal, {ahead(3, 'level3')} AS level, regexp_replace(clean, '{book.debris}', ' ', 'g') AS undug, ({_hit(book.foreign)} OR ({_hit(book.ambiguous)} AND {_hit(book.foreign_context)})) AND NOT {_hit(book.own_side)} AS other_side FROM doubted)"
    strikes = "|".join(r[1] for r in (*book.signals, *book.weak_signals) if r[0] == "impact")
    drops = [f"WHEN body = '' THEN 'empty' WHEN signal IN ('impact', 'detection') AND ({_hit(book.debris_found)} OR ({_hit(book.debris_fell)} AND {_hit(book.no_harm)})) AND NOT {_hit(strikes, 'undug')} THEN 'aftermath'"]
    listed = lambda labels: "('" + "', '".join(labels) + "')"
    for rule in book.drops:
        tests = [f"({' OR '.join([*([_hit(rule.pattern)] if rule.pattern else []), *(['other_side'] if rule.foreign else [])])})"]
        tests += [f"signal IN {listed(rule.only)}"] if rule.only else []
        tests += [f"signal NOT IN {listed(rule.never)}"] if rule.never else []
        tests += ["threat = 'unknown'"] if rule.unnamed else []
        tests += [f"length(clean) > {rule.longer}"] if rule.longer else []
        drops.append(f"WHEN {' AND '.join(tests)} THEN '{rule.name}'")
    drops.append("WHEN signal = 'unknown' THEN 'unnamed' WHEN signal = 'caution' THEN 'caution'")
    count = f"list_max(list_filter(list_transform(regexp_extract_all(clean, '{book.counted}', 1), lambda x: x::INT), lambda x: x > 0 AND x <= 200))"
    top = "CASE WHEN level <= 3 THEN 3 WHEN level <= 5 THEN 5 WHEN level <= 7 THEN 7 ELSE 10 END"
    boost = f"(CASE WHEN {_hit(book.official, 'lower(body)')} THEN 1 ELSE 0 END + CASE WHEN coalesce({count} >= 5, false) OR {_hit(book.crowd)} THEN 1 ELSE 0 END)"
    return f"WITH {given}, {body}, {named}, {first}, {paired}, {found}, {doubted}, {final} SELECT message_id, CASE {' '.join(drops)} END AS drop_reason, signal, threat, least(level + {boost}, greatest(level, {top}))::INT AS severity FROM final"


def _name(column: str):
    return F.translate(column, "_#", "  ")


def messages(s, d):
    customer, nation = V.read(s, d, "customer"), V.read(s, d, "nation")
    other = nation.select(F.pmod(F.col("n_nationkey") + 24, F.lit(25)).alias("before"), F.col("n_name").alias("o_name"))
    rows = V.read(s, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(other, F.col("n_nationkey") == F.col("before"))
    kind, text = F.col("o_orderkey") % len(FORMS), None
    for k, form in enumerate(FORMS):
        made = F.lit(form)
        for mark, column in (("{c}", "c_name"), ("{n}", "n_name"), ("{o}", "o_name")):
            made = F.replace(made, F.lit(mark), _name(column)) if mark in form else made
        text = F.when(kind == k, made) if text is None else text.when(kind == k, made)
    return rows.select(
        F.col("o_orderkey").alias("message_id"),
        F.concat(F.lit("s"), F.col("o_custkey") % 20).alias("source_key"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("o_orderkey") * 7 % 600_000).alias("posted_at"),
        text.alias("text"),
    )


def sources(s, d):
    """Twenty sources, each at home in a region; the last five are at home nowhere."""
    region = V.read(s, d, "region")
    rows = V.read(s, d, "customer").select((F.col("c_custkey") % 20).alias("k")).distinct()
    return rows.join(region, (F.col("k") % 5 == F.col("r_regionkey")) & (F.col("k") < 15), "left").select(
        F.concat(F.lit("s"), "k").alias("source_key"),
        F.element_at(F.array(*[F.lit(t) for t in V.TIERS]), (F.col("k") % 4 + 1).cast("int")).alias("tier"),
        F.lit(None).cast("string").alias("network"),
        F.col("r_name").alias("region"),
    )


def _zones(s, d):
    return V.zones(s, d).withColumn("name", _name("name"))


def _seen(s, d):
    zones = _zones(s, d)
    return observe.observe(messages(s, d), zones, linking.name_index(zones), sources(s, d))


def _ready(s, d):
    """R1 on the observations: what a hold-back of a day leaves for later, by the contiguous prefix of ids."""
    return stream.ready(V.observations(s, d), 86_400)[1].select("raw_id")


def _merged(s, d):
    """incidents of the first half of the month, met again by those of all but its first ten days."""
    rows = V.observations(s, d)
    return fusion.merged(fusion.fuse(rows.where("moment < '2024-01-16'")), fusion.fuse(rows.where("moment >= '2024-01-10'"))).select("id", "severity", F.size("contributions").alias("n"), "source_count")


QUERIES = {
    "t11_ruled_messages": lambda s, d: parsing.parsed(ruled(s, d)).select("message_id", "drop_reason", "signal", "threat", F.col("severity").cast("int").alias("severity")),
    "t09_parsed_reports": lambda s, d: parsing.parsed(messages(s, d)).select("message_id", "drop_reason", "signal", "threat", "severity", "massive"),
    "t20_report_phrases": lambda s, d: parsing.parsed(messages(s, d)).select("message_id", F.array_join("phrases", "|").alias("phrases")),
    "f13_observations": lambda s, d: _seen(s, d).observations.select("raw_id", "source_key", "tier", "moment", "signal", "threat", "severity", "massive", "zone_id", F.array_join("zone_path", ">").alias("path"), "level"),
    "f16_counters": lambda s, d: observe.counters(_seen(s, d)),
    "f13_fused_messages": lambda s, d: fusion.fuse(_seen(s, d).observations).drop("contributions", "zone_path"),
    "f15_merged_incidents": _merged,
    "r01_held_back": _ready,
    "r02_progress": lambda s, d: stream.progress(V.event_sources(s, d).select(F.col("raw_message_id").alias("raw_id"))),
}
_CASE = "CASE k " + " ".join("WHEN {0} THEN {1}".format(k, "'" + form.replace("{c}", "' || c || '").replace("{n}", "' || n || '").replace("{o}", "' || o || '") + "'") for k, form in enumerate(FORMS)) + " END"
_MADE = f"""made AS (
  SELECT o_orderkey AS message_id, o_orderkey % {len(FORMS)} AS k, 's' || (o_custkey % 20) AS source_key, o_custkey % 20 AS source, make_timestamp((1704067200 + o_orderkey * 7 % 600000) * 1000000) AS posted_at,
    c_custkey, a.n_nationkey, a.n_regionkey, b.n_nationkey AS other, b.n_regionkey AS other_region, replace(c_name, '#', ' ') AS c, replace(a.n_name, '_', ' ') AS n, replace(b.n_name, '_', ' ') AS o
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON b.n_nationkey = (a.n_nationkey + 1) % 25
), given AS (SELECT *, {_CASE} AS text FROM made),
meant AS (SELECT *, CASE k WHEN 2 THEN 'promotion' WHEN 7 THEN 'quiet' END AS drop_reason,
  CASE k WHEN 0 THEN 'detection' WHEN 1 THEN 'danger' WHEN 2 THEN 'alarm' WHEN 3 THEN 'allclear' WHEN 4 THEN 'detection' WHEN 5 THEN 'detection' WHEN 6 THEN 'alarm' WHEN 7 THEN 'danger' ELSE 'detection' END AS signal,
  CASE k WHEN 0 THEN 'uav' WHEN 1 THEN 'rocket' WHEN 2 THEN 'uav' WHEN 3 THEN 'uav' WHEN 4 THEN 'aviation' WHEN 5 THEN 'uav' WHEN 6 THEN 'rocket' WHEN 7 THEN 'unknown' ELSE 'uav' END AS threat,
  (CASE k WHEN 0 THEN 8 WHEN 1 THEN 5 WHEN 2 THEN 7 WHEN 3 THEN 0 WHEN 4 THEN 8 WHEN 5 THEN 8 WHEN 6 THEN 7 WHEN 7 THEN 5 ELSE 9 END)::INT AS severity, k = 8 AS massive FROM given)"""
_OBS = f"""{_MADE}, fanned AS (
  SELECT *, 'c' || c_custkey AS zone_id, 'c' || c_custkey || '>n' || n_nationkey || '>r' || n_regionkey AS path, 'place' AS level, false AS going, false AS home FROM meant WHERE k IN (0, 5, 8)
  UNION ALL SELECT *, 'n' || n_nationkey, 'n' || n_nationkey || '>r' || n_regionkey, 'district', false, false FROM meant WHERE k IN (1, 3, 6)
  UNION ALL SELECT *, 'n' || other, 'n' || other || '>r' || other_region, 'district', true, false FROM meant WHERE k = 5
  UNION ALL SELECT *, 'r' || (source % 5), 'r' || (source % 5), 'region', false, true FROM meant WHERE k = 4 AND source < 15
)"""
ORACLE = {
    "t11_ruled_messages": _ruled_sql(parsing.RuleBook()),
    "t09_parsed_reports": f"WITH {_MADE} SELECT message_id, drop_reason, signal, threat, severity, massive FROM meant",
    "t20_report_phrases": f"WITH {_MADE} SELECT message_id, replace(replace(text, ', ', '|'), ': ', '|') AS phrases FROM given",
    "f13_observations": f"""WITH {_OBS} SELECT message_id AS raw_id, source_key, ['official', 'federal', 'regional', 'mixed'][1 + source % 4] AS tier, posted_at AS moment,
  CASE WHEN going THEN 'danger' ELSE signal END AS signal, threat, CASE WHEN going THEN 5 ELSE severity END::INT AS severity, massive, zone_id, path, level FROM fanned""",
    "f16_counters": f"""WITH {_OBS} SELECT (SELECT count(*) FROM meant) AS scanned, (SELECT count(*) FROM meant WHERE drop_reason IS NOT NULL) AS irrelevant, (SELECT count(*) FROM meant WHERE k = 4 AND source >= 15) AS unplaced,
  (SELECT count(*) FROM meant WHERE k = 4 AND source < 15) AS by_source, (SELECT count(*) FROM fanned) AS observations""",
    "r01_held_back": f"WITH {V.OBSERVATIONS} SELECT raw_id FROM observations WHERE raw_id >= (SELECT min(raw_id) FROM observations WHERE moment > (SELECT max(moment) FROM observations) - INTERVAL 1 DAY)",
    "r02_progress": f"WITH {V.EVENT_SOURCES} SELECT coalesce(max(raw_message_id), 0)::BIGINT AS mark FROM event_sources",
}
