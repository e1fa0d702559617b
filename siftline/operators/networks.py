"""Repost networks and provenance.

Messages have ``message_id, source_key, posted_at, text``; provenance rows have
``event_id, raw_message_id, source_key, role, contributed_at, text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.scoring import seconds
from siftline.functions.text import strip_footer
from siftline.sources.scratch import materialize

#: Fixed values.
LEAST_LENGTH = 25
WINDOW_SECONDS = 600
LEAST_SHARED = 5
REPOST_LENGTH = 120
SHOWN_LENGTH = 220
#: Posts of one text in one window from which on they are met in parts, and the number of parts.
CROWD = 1_000
PARTS = 16


def text_key(text: Column) -> Column:
    """Letters, digits and single spaces, lower-cased."""
    plain = F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}\s]", "")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def repost_key(text: Column, least: int = REPOST_LENGTH) -> Column:
    """Digest of a text without white space; null for short ones."""
    squeezed = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""))
    return F.when(F.length(squeezed) >= least, F.substring(F.sha1(squeezed), 1, 16))


def keyed(messages: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """Messages long enough to tell a copy from chance, with a digest of their key."""
    key = text_key(F.col("text"))
    return messages.select("message_id", "source_key", "posted_at", F.when(F.length(key) >= least, F.md5(key)).alias("key")).where("key IS NOT NULL")


def _shared_keys(rows: DataFrame) -> DataFrame:
    """Keys that several sources have: the only rows a pair can be made of."""
    return rows.groupBy("key").agg(F.min("source_key").alias("low"), F.max("source_key").alias("high")).where("low <> high").select("key")


def pairs(messages: DataFrame, window_seconds: int = WINDOW_SECONDS, least: int = LEAST_LENGTH) -> DataFrame:
    """How often two sources post the same text within the window.

    Posts of one source, text and time are one row with a count, and texts of a
    single source are left out, before rows meet by text and time bucket. A busy
    bucket is dealt over PARTS tasks, the other side of it repeated. What is
    returned has been written once, so what comes next does not read the messages
    again.
    """
    rows = keyed(messages, least).groupBy("key", "source_key", "posted_at").agg(F.count(F.lit(1)).alias("n"))
    rows = materialize(rows, "network-posts")
    rows = rows.join(_shared_keys(rows), "key", "left_semi")
    bucket = F.floor(F.unix_micros("posted_at") / F.lit(window_seconds * 1_000_000))
    part = F.pmod(F.xxhash64("source_key", "posted_at"), F.lit(PARTS)).cast("int")
    # the bucket of one side and its two neighbours; the larger bucket key of a pair is met once
    a = rows.select("key", F.col("source_key").alias("a"), F.col("posted_at").alias("at_a"), F.col("n").alias("n_a"), part.alias("part"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    b = rows.select("key", F.col("source_key").alias("b"), F.col("posted_at").alias("at_b"), F.col("n").alias("n_b"), bucket.alias("bucket"))
    crowded = rows.groupBy("key", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > CROWD).select("key", "bucket", F.lit(True).alias("crowded"))
    a = a.join(crowded, ["key", "bucket"], "left").withColumn("part", F.when(F.col("crowded"), F.col("part")).otherwise(F.lit(0))).drop("crowded")
    parts = F.when(F.col("crowded"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    b = b.join(crowded, ["key", "bucket"], "left").withColumn("part", F.explode(parts)).drop("crowded")
    met = a.join(b, ["key", "bucket", "part"]).where((F.col("a") < F.col("b")) & (F.abs(seconds(F.col("at_a"), F.col("at_b"))) <= window_seconds))
    return materialize(met.groupBy("a", "b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("shared")), "network-pairs")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``source_key, root`` by propagation of the smallest name along edges and through known roots."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "component-edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")), "components")
    for _ in range(rounds):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        hop = labels.select(F.col("node").alias("root"), F.col("root").alias("over"))
        new = labels.join(seen, F.col("node") == F.col("a")).join(hop, "root", "left")
        new = new.select("node", F.least("root", "near", F.coalesce("over", "root")).alias("root"), F.col("root").alias("was"))
        new = materialize(new, "components")
        if new.where("root <> was").isEmpty():
            return new.select(F.col("node").alias("source_key"), "root")
        labels = new.drop("was")
    raise ValueError(f"no fixed point in {rounds} rounds")


def networks(pair_counts: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """Sources with their network (``net:`` and its smallest member) and its strength, the sum of its shared texts."""
    strong = pair_counts.where(F.col("shared") >= least_shared)
    strong = materialize(strong, "network-strong")
    named = components(strong).select("source_key", F.concat(F.lit("net:"), "root").alias("network"))
    weight = strong.join(named, F.col("a") == F.col("source_key")).groupBy("network").agg(F.sum("shared").alias("strength"))
    return named.join(weight, "network").select("source_key", "network", "strength")


def resolved_networks(measured: DataFrame, configured: DataFrame) -> DataFrame:
    """Measured network of a source, else the configured one."""
    return measured.select("source_key", F.col("network").alias("m")).join(configured.select("source_key", F.col("network").alias("c")), "source_key", "full").select(
        "source_key", F.coalesce("m", "c").alias("network")
    )


def walk(rows: DataFrame, sources: DataFrame, repost_length: int = REPOST_LENGTH, shown: int = SHOWN_LENGTH) -> DataFrame:
    """Contributions of each event in time order: first of their source, copies of a text or a network, counted.

    ``sources`` has ``source_key, network``. Texts are compared without their
    footers. Repeats are dropped, but still claim their text and network. ``text`` is
    shown on one line, cut to ``shown`` characters.
    """
    rows = rows.join(sources.select("source_key", "network"), "source_key", "left").withColumn("body", strip_footer(F.col("text")))
    rows = rows.withColumn("stamp", repost_key(F.col("body"), repost_length))
    rows = rows.withColumn("text", F.substring(F.trim(F.regexp_replace("body", r"(?U)\s+", " ")), 1, shown))
    order = ("contributed_at", "raw_message_id")
    said = F.first_value("source_key").over(Window.partitionBy("event_id", "stamp").orderBy(*order))
    owner = F.first_value("source_key").over(Window.partitionBy("event_id", "network").orderBy(*order))
    marked = rows.withColumn("repost", F.col("stamp").isNotNull() & (said != F.col("source_key")))
    marked = marked.withColumn("clone", F.col("network").isNotNull() & (owner != F.col("source_key"))).where("role <> 'repeat'")
    place = F.row_number().over(Window.partitionBy("event_id", "source_key").orderBy(*order))
    marked = marked.withColumn("first_from_source", place == 1)
    return marked.withColumn("counted", F.col("first_from_source") & ~F.col("repost") & ~F.col("clone")).select(
        "event_id", "raw_message_id", "source_key", "role", "contributed_at", "first_from_source", "repost", "clone", "counted", "text"
    )


def independent(walked: DataFrame) -> DataFrame:
    """Independent voices of each event."""
    return walked.groupBy("event_id").agg(F.count_if("counted").alias("voices"))


def source_listing(walked: DataFrame) -> DataFrame:
    """The contributions of each event, newest first (``place``), with the event's number of independent voices (``total``)."""
    event = Window.partitionBy("event_id")
    place = F.row_number().over(event.orderBy(F.desc("contributed_at"), F.desc("raw_message_id")))
    return walked.withColumn("total", F.sum(F.col("counted").cast("long")).over(event)).withColumn("place", place)


def message_link(base: str, username: Column, message_id: Column) -> Column:
    """Link of a message; null without user name or id."""
    return F.concat(F.lit(base.rstrip("/") + "/"), username, F.lit("/"), message_id.cast("string"))


def lead_lag(messages: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """Per pair of sources, in the time both were posting: shared texts, who posts first, median lag, share within 3 minutes.

    A source counts a text once, at its first post in the common time.
    ``share_of_smaller`` is that of the shared texts among the texts, in the common
    time, of the source that has fewer there.
    """
    rows = materialize(keyed(messages, least).groupBy("source_key", "key", "posted_at").agg(F.count(F.lit(1)).alias("n")), "lead-posts")
    span = messages.groupBy("source_key").agg(F.min("posted_at").alias("since"), F.max("posted_at").alias("until"))
    shared = rows.join(_shared_keys(rows), "key", "left_semi").join(span, "source_key")
    pairs_of = shared.select("key", "source_key", "since", "until").distinct()
    a, b = (pairs_of.select("key", *[F.col(c).alias(f"{c}_{n}") for c in ("source_key", "since", "until")]) for n in "ab")
    couples = a.join(b, "key").where("source_key_a < source_key_b")
    couples = couples.select("key", F.col("source_key_a").alias("a"), F.col("source_key_b").alias("b"), F.greatest("since_a", "since_b").alias("low"), F.least("until_a", "until_b").alias("high")).where("low <= high")

    def first(side: str) -> DataFrame:
        posts = rows.select("key", F.col("source_key").alias(side), "posted_at")
        inside = couples.join(posts, ["key", side]).where(F.col("posted_at").between(F.col("low"), F.col("high")))
        return inside.groupBy("key", "a", "b").agg(F.min("posted_at").alias(f"at_{side}"))

    met = first("a").join(first("b"), ["key", "a", "b"])
    lag = F.abs(seconds(F.col("at_a"), F.col("at_b")))
    report = met.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("shared"),
        F.count_if(F.col("at_a") < F.col("at_b")).alias("a_first"),
        F.median(lag).alias("median_lag"),
        F.round(F.avg((lag <= 180).cast("double")), 4).alias("within_3_min"),
    )
    # how many texts each of a pair has in their common time; pairs are few against texts
    common = couples.select("a", "b", "low", "high").distinct()
    sides = common.select("a", "b", "low", "high", F.explode(F.array("a", "b")).alias("source_key"))
    own = sides.join(rows.select("source_key", "key", "posted_at"), "source_key").where(F.col("posted_at").between(F.col("low"), F.col("high")))
    sizes = own.groupBy("a", "b", "source_key").agg(F.count_distinct("key").alias("texts")).groupBy("a", "b").agg(F.min("texts").alias("smaller"))
    return report.join(sizes, ["a", "b"]).select("a", "b", "shared", "a_first", "median_lag", "within_3_min", F.round(F.col("shared") / F.col("smaller"), 4).alias("share_of_smaller"))
