"""Routes, alerts, subscriptions, retention and corpus reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.scoring import km, seconds
from siftline.sources.scratch import dealt, materialize

#: Default rule: what says that a message describes a way.
ROUTE_MARKER = r"heading for|towards|then to|via|route|-> ?|flew past"
#: Recipients that are told together.
BLOCK = 1000
#: Cells into which all pairs of incidents and recipients are dealt, and recipients of a zone in one of them.
CELLS = 256
STRIP = 256 * BLOCK
_POINT = "struct<lat:double,lon:double,name:string>"


def route(points: Column, most_points: int = 6, most_leg: float = 120, least_total: float = 5, sinuosity: float = 1.6) -> Column:
    """The route of an ordered array of points, or null if it is none.

    Hops under 1 km are skipped, at most ``most_points`` points are taken; legs,
    total and directness have limits. Points without coordinates do not count.
    """
    points = F.filter(points.cast(f"array<{_POINT}>"), lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    gap = lambda a, b: km(a["lat"], a["lon"], b["lat"], b["lon"])

    def add(kept: Column, p: Column) -> Column:
        near = (F.size(kept) > 0) & (gap(F.element_at(kept, -1), p) < 1)
        full = F.size(kept) >= most_points
        return F.when(full | F.coalesce(near, F.lit(False)), kept).otherwise(F.array_append(kept, p))

    def checked(kept: Column) -> Column:
        n = F.size(kept)
        legs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: gap(F.element_at(kept, i), F.element_at(kept, i + 1)))
        total = F.aggregate(legs, F.lit(0.0), lambda s, x: s + x)
        direct = gap(kept[0], F.element_at(kept, -1))
        good = ~F.exists(legs, lambda x: x > most_leg) & (total >= least_total) & (direct >= least_total) & (total <= direct * sinuosity)
        return F.when(n >= 2, F.when(good, kept))

    return F.aggregate(points, F.array().cast(f"array<{_POINT}>"), add, checked)


def message_routes(parsed: DataFrame, zones: DataFrame, marker: str = ROUTE_MARKER) -> DataFrame:
    """Routes of messages: ``raw_message_id, source_key, posted_at, threat, severity, points``, null points where there is none.

    ``parsed`` are parsed messages, ``zones`` their linked zones (``message_id, pos,
    start, name, level, lat, lon``). Only relevant messages whose text has a route
    marker and that clear nothing make routes; regions are directions, not points.
    """
    wanted = parsed.where(F.col("drop_reason").isNull() & ~F.col("signal").isin("allclear", "retracted") & F.lower("text").rlike(marker))
    spots = zones.where("level <> 'region'").groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("pos", "start", "lat", "lon", "name"))).alias("spots"))
    points = F.transform("spots", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), p["name"].alias("name")))
    made = wanted.join(spots, "message_id", "left").withColumn("points", route(F.coalesce(points, F.array().cast(f"array<{_POINT}>"))))
    return made.select(F.col("message_id").alias("raw_message_id"), "source_key", "posted_at", "threat", "severity", "points")


def backfill_routes(stored: DataFrame, made: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Stored routes with those of the messages of the last ``days`` made anew; older ones stay."""
    return upsert_routes(stored, made.where(seconds(now, F.col("posted_at")) <= days * 86_400).select(*stored.columns))


def upsert_routes(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """One route a message, the last write wins; a fresh null route deletes."""
    both = stored.withColumn("turn", F.lit(0)).unionByName(fresh.withColumn("turn", F.lit(1)))
    last = both.groupBy("raw_message_id").agg(F.max_by(F.struct(*[c for c in stored.columns if c != "raw_message_id"]), "turn").alias("r"))
    return last.select("raw_message_id", "r.*").where("points IS NOT NULL")


def route_dedupe(routes: DataFrame, limit: int = 400) -> DataFrame:
    """Equal routes of one threat are one row, with the newest time and the highest severity."""
    return (
        routes.groupBy(F.to_json("points").alias("points"), "threat")
        .agg(F.max("posted_at").alias("posted_at"), F.max("severity").alias("severity"))
        .orderBy(F.desc("posted_at"), "points", "threat")
        .limit(limit)
    )


def latest_flag(messages: DataFrame, closed: str, opened: str, now: Column, newest: int = 30, hours: float = 12) -> DataFrame:
    """Per source the newest message that says closed or open, among its ``newest`` and before the first one that is too old."""
    order = Window.partitionBy("source_key").orderBy(F.desc("posted_at"), F.desc("message_id"))
    rows = messages.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= newest)
    rows = rows.withColumn("stale", F.max(seconds(now, F.col("posted_at")) > hours * 3600).over(order))
    state = F.when(F.col("text").rlike(closed), "closed").when(F.col("text").rlike(opened), "open")
    rows = rows.withColumn("state", state).where("NOT stale AND state IS NOT NULL")
    return rows.groupBy("source_key").agg(F.min_by(F.struct("state", "posted_at"), "rn").alias("r")).select("source_key", "r.state", "r.posted_at")


def _packed(subscriptions: DataFrame) -> tuple[DataFrame, Column]:
    """Recipients in arrays of about BLOCK at most, by a ``zone`` that they watch, ``part`` and all their ``watches``; and the part of a ``recipient``."""
    lists = subscriptions.groupBy("recipient").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("zones")))).alias("watches"))
    watched = lists.select("recipient", "watches", F.explode("watches").alias("zone"))
    most = watched.groupBy("zone").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1)).alias("n")).first().n
    part = F.pmod(F.xxhash64("recipient"), F.lit(-(-most // BLOCK))).alias("part")
    return materialize(watched.groupBy("zone", part, "watches").agg(F.collect_list("recipient").alias("recipients")), "watches"), part


def _asked(incidents: DataFrame) -> DataFrame:
    return incidents.withColumn("zone", F.explode(F.array_distinct("zone_path")))


def _reach(incidents: DataFrame, packed: DataFrame) -> DataFrame:
    """``slices`` of the incidents and ``strips`` of the recipients of each ``zone``.

    Together they are the cells of the zone, as many of CELLS as its pairs are of all,
    whatever the tables' size; either side is copied for its cells. So what is
    shuffled grows like the tables and not like the pairs. As a task holds the pairs
    of one incident in a cell at once, a strip has about STRIP recipients at most.
    """
    asks = _asked(incidents).groupBy("zone").agg(F.count(F.lit(1)).alias("m"))
    parts = packed.groupBy("zone").agg(F.sum(F.size("recipients")).alias("n"), F.count_distinct("part").alias("parts"))
    reach = asks.join(parts, "zone").withColumn("pairs", F.col("m").cast("double") * F.col("n"))
    total = reach.agg(F.coalesce(F.sum("pairs"), F.lit(1.0)).alias("n")).first().n
    reach = reach.withColumn("cells", F.ceil(F.col("pairs") * CELLS / total))
    reach = reach.withColumn("strips", F.least("parts", F.greatest(F.ceil(F.col("n") / STRIP), F.floor(F.sqrt(F.col("cells") * F.col("n") / F.col("m"))))))
    return reach.select("zone", "strips", F.ceil(F.col("cells") / F.col("strips")).alias("slices"))


def _first() -> Column:
    """Whether ``zone`` is the first of the path that is watched: there a recipient is told, once."""
    return F.try_element_at(F.array_intersect("zone_path", "watches"), F.lit(1)) == F.col("zone")


def _met(incidents: DataFrame, packed: DataFrame, reach: DataFrame, key: str) -> DataFrame:
    """Incidents with the arrays of those that watch their path, by cells; ``key`` tells incidents apart. Pairs are made from these last and not shuffled."""
    until = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = _asked(incidents).join(reach, "zone").withColumn("slice", F.pmod(F.xxhash64(key), "slices")).withColumn("strip", until("strips")).drop("slices", "strips")
    packs = packed.join(reach, "zone").withColumn("strip", F.pmod("part", "strips")).withColumn("slice", until("slices")).drop("slices", "strips")
    return dealt(asked, "zone", "slice", "strip").join(packs.hint("merge"), ["zone", "slice", "strip"]).where(_first()).drop("slice", "strip")


def watching(incidents: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Incidents (all columns) with each ``recipient`` that watches a zone on their path.

    Both sides are exploded and joined on zone, so no recipient is compared with
    all incidents; an incident comes once a recipient, however many of its zones
    are watched. ``incidents`` are read twice.
    """
    packed, _ = _packed(subscriptions)
    return _met(incidents, packed, _reach(incidents, packed), "id").select("id", F.explode("recipients").alias("recipient"), *[c for c in incidents.columns if c != "id"])


def alerts(incidents: DataFrame, subscriptions: DataFrame, ledger: DataFrame | None = None, now: Column | None = None, expiry_hours: int = 24) -> DataFrame:
    """One alert per recipient and incident, unless the ledger has it: ``id`` while it is open, ``id:clear`` once it is resolved.

    Entries of the ledger (``alert, at``) name a ``recipient`` or, where an alert was
    published to all who watch a zone, that ``zone``; the ledger has either column or
    both. They count for ``expiry_hours`` before ``now``; without ``now`` they all
    count. Recipients meet the incidents by alert and part; parts without an entry
    of the alert are told as a whole.
    """
    key = F.when(F.col("resolved_at").isNotNull(), F.concat("id", F.lit(":clear"))).otherwise(F.col("id"))
    rows = incidents.select(key.alias("alert"), "zone_path")
    packed, part = _packed(subscriptions)
    reach = _reach(rows, packed)
    if ledger is None:
        return _met(rows, packed, reach, "alert").select(F.explode("recipients").alias("recipient"), "alert")
    sent = ledger if now is None else expired(ledger, now, expiry_hours)
    sent = sent.select("alert", *[F.col(c) if c in sent.columns else F.lit(None).cast("string").alias(c) for c in ("recipient", "zone")])
    rows = rows.join(sent.where("zone IS NOT NULL").groupBy("alert").agg(F.collect_set("zone").alias("published")), "alert", "left")
    open_ = ~F.coalesce(F.arrays_overlap("published", "watches"), F.lit(False))
    sent = sent.where("recipient IS NOT NULL").groupBy("alert", part).agg(F.collect_set("recipient").alias("sent"))
    named = rows.join(sent.groupBy("alert").agg(F.collect_set("part").alias("named")), "alert", "left")
    whole = _met(named, packed, reach, "alert").where("named IS NULL OR NOT array_contains(named, part)").withColumn("left", F.col("recipients"))
    rest = _asked(rows.join(sent, "alert")).join(packed, ["zone", "part"]).where(_first()).withColumn("left", F.array_except("recipients", "sent"))
    return whole.where(open_).select("left", "alert").union(rest.where(open_).select("left", "alert")).select(F.explode("left").alias("recipient"), "alert")


def expired(ledger: DataFrame, now: Column, expiry_hours: int = 24) -> DataFrame:
    """Ledger entries that still count."""
    return ledger.where(seconds(now, F.col("at")) < expiry_hours * 3600)


def journal(actions: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Rows to append to the activity journal (``recipient, action, detail, at``): those that it does not have.

    A journal is only ever appended to; rows are told apart by all their columns, so
    a batch that is written again adds nothing.
    """
    rows = actions.select("recipient", "action", "detail", "at").distinct()
    return rows if stored is None else rows.join(stored.select("recipient", "action", "detail", "at"), ["recipient", "action", "detail", "at"], "left_anti")


def suppressed(lines: DataFrame, minutes: int = 30, expiry_hours: int = 24) -> DataFrame:
    """Whether a line is sent: not within ``minutes`` of the first send of the ledger row that it falls into.

    ``lines`` has ``recipient, line, at``. A ledger row lives ``expiry_hours`` from its
    first send, so rows are told apart by days from the recipient's first send of
    the line; each line is taken to the start of its row.
    """
    key = F.sha1("line")
    first = F.min("at").over(Window.partitionBy("recipient", "key"))
    rows = lines.withColumn("key", key).withColumn("epoch", F.floor(seconds(F.col("at"), first) / (expiry_hours * 3600)))
    began = Window.partitionBy("recipient", "key", "epoch")
    order = began.orderBy("at", "line")
    rows = rows.withColumn("began", F.min("at").over(began)).withColumn("n", F.row_number().over(order))
    return rows.withColumn("sent", (F.col("n") == 1) | (seconds(F.col("at"), F.col("began")) >= minutes * 60)).drop("n", "key", "epoch", "began")


def subscriptions_latest(changes: DataFrame, most_zones: int = 64) -> DataFrame:
    """The last write of each recipient; deletions go, zone lists are cut at ``most_zones`` as the service does."""
    last = changes.groupBy("recipient").agg(F.max_by(F.struct("zones", "active"), F.struct("at", "change_id")).alias("s"))
    return last.where("s.active").select("recipient", F.slice("s.zones", 1, most_zones).alias("zones"))


def add_zone(zones: Column, zone: Column, most: int = 12) -> Column:
    """A zone added to a watch list of at most ``most``."""
    return F.when(F.array_contains(zones, zone) | (F.size(zones) >= most), zones).otherwise(F.array_append(zones, zone))


def retention_report(messages: DataFrame, provenance: DataFrame, cutoff: Column) -> DataFrame:
    """Messages in all and older than the cutoff, provenance rows affected, oldest message; one row."""
    old = messages.where(F.col("posted_at") < cutoff)
    affected = provenance.join(old.select(F.col("message_id").alias("raw_message_id")), "raw_message_id", "left_semi").agg(F.count(F.lit(1)).alias("affected"))
    totals = messages.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("posted_at") < cutoff).alias("older"), F.min("posted_at").alias("oldest"))
    return totals.crossJoin(affected)


def purge(messages: DataFrame, cutoff: Column, days: int, provenance: DataFrame | None = None, routes: DataFrame | None = None) -> DataFrame | tuple[DataFrame, DataFrame, DataFrame]:
    """Messages that stay, and the provenance and routes of those, where given; incidents are not touched. Fewer than seven days are refused."""
    if days < 7:
        raise ValueError("retention must be at least 7 days")
    kept = messages.where(F.col("posted_at") >= cutoff)
    if provenance is None or routes is None:
        return kept
    gone = messages.where(F.col("posted_at") < cutoff).select(F.col("message_id").alias("raw_message_id"))
    return kept, provenance.join(gone, "raw_message_id", "left_anti"), routes.join(gone, "raw_message_id", "left_anti")


def profile(messages: DataFrame) -> DataFrame:
    """Size, lengths and shares of a corpus, in one row."""
    n = F.length("text")
    return messages.agg(
        F.count(F.lit(1)).alias("texts"),
        F.median(n).alias("median_length"),
        F.max(n).alias("max_length"),
        F.median(F.size(F.split("text", "\n"))).alias("median_lines"),
        F.round(F.avg(F.col("text").rlike("[0-9]").cast("double")), 6).alias("with_digit"),
        F.round(F.avg(F.col("text").rlike("!").cast("double")), 6).alias("with_bang"),
    )


def top_words(messages: DataFrame, least: int = 4, limit: int = 20) -> DataFrame:
    """Most frequent ASCII words of at least ``least`` letters."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[a-z]{{{least},}}"), 0))
    return messages.select(words.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(limit)


def repeated_first_lines(messages: DataFrame, limit: int = 20) -> DataFrame:
    """First lines that several messages have."""
    first = F.substring_index("text", "\n", 1)
    return messages.groupBy(first.alias("line")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "line").limit(limit)


def lexicon(messages: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Share of each source's messages that match each pattern."""
    return messages.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col("text").rlike(p).cast("double")), 6).alias(k) for k, p in patterns.items()])


def spread_texts(messages: DataFrame) -> DataFrame:
    """Texts seen in two or more sources, by digest, with their spread in sources and time."""
    return (
        messages.groupBy(F.md5("text").alias("text_md5"))
        .agg(F.count_distinct("source_key").alias("sources"), F.count(F.lit(1)).alias("posts"), F.min("posted_at").alias("first"), F.max("posted_at").alias("last"))
        .where("sources >= 2")
        .select("text_md5", "sources", "posts", seconds(F.col("last"), F.col("first")).alias("spread_s"))
    )


def mentions(messages: DataFrame, pattern: str, known: DataFrame | None = None) -> DataFrame:
    """What a pattern captures, lower-cased and counted, without known names."""
    found = messages.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), 1)).alias("name"))
    out = found.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return out if known is None else out.join(known, "name", "left_anti")


def candidates(messages: DataFrame, alert: str, noise: str, sample: int = 40, least: int = 5) -> DataFrame:
    """Sources judged by their newest ``sample`` messages: enough texts, many alerts, little noise."""
    order = Window.partitionBy("source_key").orderBy(F.desc("posted_at"), "message_id")
    rows = messages.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= sample)
    share = lambda p: F.round(F.avg(F.col("text").rlike(p).cast("double")), 6)
    out = rows.groupBy("source_key").agg(F.count(F.lit(1)).alias("texts"), share(alert).alias("alert_share"), share(noise).alias("noise_share"))
    return out.withColumn("suitable", (F.col("texts") >= least) & (F.col("alert_share") >= 0.5) & (F.col("noise_share") <= 0.2))
