"""Messages to observations (F13): parse, link, guard, fall back to the source's home, fan out.

Messages have ``message_id, source_key, posted_at, text``; sources ``source_key,
tier, network, region``; zones and the name index are those of the linker. One
plan does the whole table, and a micro-batch is just a smaller table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import parsing
from siftline.functions.parsing import RuleBook
from siftline.operators import linking
from siftline.operators.fusion import destination_only
from siftline.operators.linking import LinkRules
from siftline.sources.scratch import dealt, materialize

#: Fixed values.
DEFAULT_TIER = "mixed"
URGENT = 5
#: Messages from which on a text goes to the tasks, so that none of them gets all that repeat it.
OFTEN = 10_000


@dataclass(frozen=True)
class Observed:
    """What a table of messages gives: parsed messages, the zones of each ``case`` of them, those of each message, and the observations."""

    parsed: DataFrame
    placed: DataFrame
    zones: DataFrame
    observations: DataFrame


def split_phrases(phrases: DataFrame, book: RuleBook) -> tuple[DataFrame, DataFrame]:
    """Phrases (``message_id, pos, phrase``) of what is observed, and of where it goes."""
    parts = F.split("phrase", "(?i)" + book.coming, 2)
    trimmed = lambda p: F.regexp_replace(p, r"^[\s,—-]+|[\s,—-]+$", "")
    observed = phrases.withColumn("phrase", trimmed(parts[0])).where("phrase <> ''")
    targets = phrases.where(F.size(parts) > 1).withColumn("phrase", trimmed(F.try_element_at(parts, F.lit(2)))).where("phrase <> ''")
    return observed, targets


def _linked(views: dict[str, DataFrame], zones: DataFrame, index: DataFrame, home: DataFrame, rules: LinkRules, groups: DataFrame | None) -> DataFrame:
    """Zones of several views of the messages' phrases, by ``view``, in one run of the linker: a view of a message is a message of its own.

    Its id is that of the message, a digest of 16 bytes, with the name of the view behind it.
    """
    of = lambda view: F.concat("message_id", F.encode(view, "UTF-8"))
    tagged = lambda rows, view: rows.withColumn("message_id", of(F.lit(view)))
    phrases = reduce(DataFrame.unionByName, [tagged(rows, view) for view, rows in views.items()])
    homes = home.withColumn("view", F.explode(F.array(*[F.lit(v) for v in views])))
    homes = homes.select(of(F.col("view")).alias("message_id"), "home_zone")
    found = linking.resolve(phrases, zones, index, homes, rules)
    if groups is not None:
        found = linking.with_groups(materialize(found, "observe-named"), phrases, groups, zones, homes)
    found = materialize(found, "observe-linked")
    tag = F.col("message_id")
    return found.withColumns({"view": F.decode(F.substring(tag, 17, 2**31 - 1), "UTF-8"), "message_id": F.substring(tag, 1, 16)})


def parsed_once(messages: DataFrame, book: RuleBook) -> DataFrame:
    """The parse of each distinct text, met again by the messages that have it; ``heard`` is a digest of its phrases and urgency, null for those dropped."""
    text = F.coalesce("text", F.lit(""))
    texts = dealt(messages.groupBy(text.alias("text")).agg(F.count(F.lit(1)).alias("n")), "text")
    heard = F.when(F.col("drop_reason").isNull(), linking.case_key(F.col("phrases"), F.col("severity") > URGENT))
    parse = materialize(parsing.parsed(texts, book).withColumn("heard", heard), "observe-texts")
    found = [c for c in parse.columns if c not in ("text", "n")]
    named = lambda rows, name: rows.select(F.col("text").alias(name), F.struct(*found).alias(f"by_{name}"))
    # what is met already is dealt by its id, which meets at most a text that is not looked at
    rows = messages.drop(*found).withColumn("often", text).join(F.broadcast(named(parse.where(F.col("n") >= OFTEN), "often")), "often", "left")
    rows = rows.withColumn("seldom", F.when(F.col("by_often").isNull(), text).otherwise(F.col("message_id").cast("string")))
    rows = rows.join(named(parse.where(F.col("n") < OFTEN), "seldom"), "seldom", "left").withColumn("parse", F.coalesce("by_often", "by_seldom"))
    return rows.drop("often", "by_often", "seldom", "by_seldom").select("*", "parse.*").drop("parse")


def observe(messages: DataFrame, zones: DataFrame, index: DataFrame, sources: DataFrame, book: RuleBook | None = None, rules: LinkRules | None = None, groups: DataFrame | None = None) -> Observed:
    """one observation for each zone that a relevant message reports on; names of ``groups`` (G12) stand for their members.

    A message with more than MOST_ZONES zones is a catalogue and dropped; one
    without any gets its source's home region. Of an urgent message, zones that only
    its movement leads to get a danger instead of its signal (F12). All that depends
    on a message's phrases, home and urgency is found once for each ``case`` of these.
    """
    book, rules = book or RuleBook(), rules or LinkRules()
    homes = linking.home_of(sources, zones)
    known = materialize(sources.select("source_key", "tier", "network").join(homes, "source_key", "left"), "observe-sources")
    urgency = (F.col("severity") > URGENT).alias("urgent")
    case = F.when(F.col("heard").isNotNull(), linking.case_key(F.col("heard"), F.col("home_zone")))
    parsed = materialize(parsed_once(messages, book).join(known, "source_key", "left").withColumn("case", case).drop("heard"), "observe-parsed")
    relevant = parsed.where("drop_reason IS NULL")
    cases = materialize(relevant.select("case", "phrases", "home_zone", urgency).distinct(), "observe-cases").withColumnRenamed("case", "message_id")
    phrases = cases.select("message_id", F.posexplode("phrases").alias("pos", "phrase"))
    home = cases.where("home_zone IS NOT NULL").select("message_id", "home_zone")
    urgent = cases.where("urgent").select("message_id", F.posexplode("phrases").alias("pos", "phrase"))
    observed, targets = split_phrases(urgent, book)
    # texts without a movement have no targets, so their zones need no second look
    observed = observed.join(targets.select("message_id").distinct(), "message_id", "left_semi")
    every = _linked({"all": phrases, "observed": observed, "targets": targets}, zones, index, home, rules, groups)
    linked = linking.drop_covered(every.where("view = 'all'"), zones).select("message_id", "zone_id", "level", "lat", "lon", F.lit("text").alias("by"))
    per_message = linked.groupBy("message_id").agg(F.count(F.lit(1)).alias("n_zones"))
    found = linked.join(per_message.where(F.col("n_zones") <= linking.MOST_ZONES).select("message_id"), "message_id", "left_semi")
    region = zones.select(F.col("zone_id").alias("home_zone"), F.col("zone_id"), "level", "lat", "lon")
    at_home = home.join(per_message, "message_id", "left_anti").join(region, "home_zone").select("message_id", "zone_id", "level", "lat", "lon", F.lit("source").alias("by"))
    placed = found.unionByName(at_home)
    going = linking.destinations(every.where("view = 'targets'"), every.where("view = 'observed'"))
    known_of = placed.join(going.withColumn("going", F.lit(True)), ["message_id", "zone_id"], "left").join(linking.paths(zones), "zone_id").withColumnRenamed("message_id", "case")
    placed = placed.withColumnRenamed("message_id", "case")
    rows = relevant.join(materialize(known_of, "observe-placed"), "case")
    signal, severity = destination_only(F.col("signal"), F.col("severity"), F.coalesce("going", F.lit(False)))
    observations = rows.select(
        F.col("message_id").alias("raw_id"), "source_key", "network", F.coalesce("tier", F.lit(DEFAULT_TIER)).alias("tier"), F.col("posted_at").alias("moment"),
        signal.alias("signal"), "threat", severity.cast("int").alias("severity"), F.col("direction_deg").cast("int").alias("direction_deg"),
        F.col("target_count").cast("int").alias("target_count"), "massive", "body", "zone_id", "zone_path", "level", "lat", "lon",
    )
    return Observed(parsed, placed, relevant.select("message_id", "case").join(placed, "case").drop("case"), observations)


def counters(seen: Observed, held: DataFrame | None = None) -> DataFrame:
    """F16: one row with messages scanned, irrelevant, catalogues and without a place, those placed by their source, and observations; with ``held`` also those that wait."""
    flags = seen.placed.groupBy("case").agg(F.min("by").alias("by"), F.count(F.lit(1)).alias("zones"))
    relevant = F.col("drop_reason").isNull()
    rows = seen.parsed.groupBy("case", relevant.alias("relevant")).agg(F.count(F.lit(1)).alias("n")).join(flags, "case", "left")
    total = lambda n: F.coalesce(F.sum(n), F.lit(0))
    count = lambda c: total(F.when(c, F.col("n")))
    counted = rows.agg(
        total("n").alias("scanned"),
        count(~F.col("relevant")).alias("irrelevant"),
        count(F.col("relevant") & F.col("zones").isNull()).alias("unplaced"),
        count(F.col("relevant") & (F.col("by") == "source")).alias("by_source"),
        total(F.col("zones") * F.col("n")).alias("observations"),
    )
    return counted if held is None else counted.crossJoin(F.broadcast(held.agg(F.count(F.lit(1)).alias("held"))))  # one row each


def preparation(zones: DataFrame, index: DataFrame, sources: DataFrame, book: RuleBook | None = None, rules: LinkRules | None = None, groups: DataFrame | None = None):
    """For :class:`siftline.streaming.fuse.FusionSink`: a batch of messages to what it gives."""

    def prepare(messages: DataFrame) -> Observed:
        return observe(messages, zones, index, sources, book, rules, groups)

    return prepare
