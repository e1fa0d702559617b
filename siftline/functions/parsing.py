"""The parse of messages (T9-T20) from a book of rules.

All rules are data: patterns with labels, sets of signals and lengths in a
:class:`RuleBook`. The default is a small English set; a deployment passes its
own. Everything is column expressions: a message is parsed in one pass over the
table, without a shuffle, and rows that don't report anything keep the name of
the rule that dropped them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.functions.scoring import boosted

#: Kinds of signal that weaker evidence can talk about.
WEAK = ("unknown", "caution", "infra")
RETOLD = (*WEAK, "impact", "intercept")
RECAPPED = (*RETOLD, "detection")
ROUTINE = (*WEAK, "danger", "detection")
#: Characters up to which a text is a telegram, and from which on an article.
TELEGRAM_CHARS = 200
ARTICLE_CHARS = 320


@dataclass(frozen=True)
class DropRule:
    """A text goes if ``pattern`` is found (or, with ``foreign``, the text is about the other side) and all conditions hold."""

    name: str
    pattern: str | None
    only: tuple[str, ...] = ()
    never: tuple[str, ...] = ()
    unnamed: bool = False
    longer: int = 0
    foreign: bool = False


@dataclass(frozen=True)
class RuleBook:
    """Patterns in lower case, tried in the order given."""

    signals: tuple[tuple[str, str, int], ...] = (
        ("allclear", r"all clear|alarm (?:is )?lifted|threat is over", 0),
        ("retracted", r"false alarm|not confirmed|drill|exercise", 0),
        ("impact", r"explosion|impact|direct hit", 9),
        ("intercept", r"intercepted|shot down", 8),
        ("alarm", r"alarm|siren|take cover|launch(?:es)?", 7),
        ("danger", r"danger", 5),
        ("detection", r"detected|sighted", 8),
        ("caution", r"be careful|safety measures|attention", 3),
        ("infra", r"airport|bridge|traffic (?:is )?(?:closed|open)|restrictions", 2),
        ("danger", r"threat", 5),
    )
    #: Only beside a named threat.
    weak_signals: tuple[tuple[str, str, int], ...] = (("impact", r"debris|fire|damaged|attacked", 9), ("detection", r"in the sky|activity|sounds of", 8))
    threats: tuple[tuple[str, str], ...] = (("rocket", r"rocket|missile"), ("kab", r"guided bomb"), ("bek", r"unmanned boat|sea drone"), ("aviation", r"aircraft|aviation"), ("uav", r"drone|uav"))
    footer: str = T.FOOTER
    brand: str = "@"
    instruction: str = r"until the all clear|when the alarm sounds"
    official: str = r"emergency service|official warning"
    opened: str = r"restrictions (?:are )?lifted|open again|reopened"
    air_infra: str = r"airport"
    third_country: str = r"strait|third country"
    moving: str = r"towards|heading for|from the (?:north|south|east|west)|flying|moving|passed"
    counted: str = T.COUNT
    crowd: str = T.CROWD
    coming: str = r"towards|heading for|in the direction of|on course for"
    unconfirmed: str = r"unconfirmed|checking|rumou?r"
    #: What an unconfirmed signal becomes.
    doubted: tuple[tuple[str, str, int], ...] = (("impact", "alarm", 7), ("intercept", "alarm", 7))
    anticipation: str = r"(?:expect|prepare for|possible) (?:to be )?(?:detected|detections?|intercepted|interceptions?)"
    #: What an expected signal becomes if nothing of it (the pattern) is left besides the expectation.
    expected: tuple[tuple[str, str, str, int], ...] = (("detection", r"detect|sighted", "danger", 5), ("intercept", r"intercept|shot down", "alarm", 7))
    debris_found: str = r"debris (?:was |were )?found|found debris"
    debris_fell: str = r"debris fell"
    no_harm: str = r"no (?:damage|casualties|consequences)"
    debris: str = r"debris"
    own_side: str = r"our region|our district"
    foreign: str = r"abroad|overseas"
    ambiguous: str = r"across the border"
    foreign_context: str = r"their territory|neighbouring country"
    news: str = r"according to the (?:ministry|agency)|president|reported earlier"
    aftermath: str = r"consequences of|after the attack"
    drops: tuple[DropRule, ...] = (
        DropRule("promotion", r"subscribe to|join our channel"),
        DropRule("notice", r"our channel (?:is|will)|we are moving to"),
        DropRule("directory", r"radio frequencies|list of stations"),
        DropRule("guide", r"what to do (?:if|in case)|how to behave"),
        DropRule("casualties", r"(?:killed|injured) (?:people|persons)|footage shows", never=("alarm", "allclear")),
        DropRule("media", r"writes the (?:times|post)|newspaper"),
        DropRule("accident", r"plane crash|air accident"),
        DropRule("recap", r"over the past (?:day|night)|last night", only=RECAPPED),
        DropRule("quiet", r"no (?:threats|changes)|situation is calm", only=ROUTINE, unnamed=True),
        DropRule("military", r"armament|supplies of weapons", only=ROUTINE),
        DropRule("foreign", None, only=RETOLD, foreign=True),
        DropRule("news", r"according to the (?:ministry|agency)|president|reported earlier", only=WEAK),
        DropRule("article", r"according to the (?:ministry|agency)|president|reported earlier|consequences of|after the attack", never=("alarm",), longer=ARTICLE_CHARS, foreign=True),
    )
    level_field: str = r"(?m)^\W*level\s*:.*$"


def _first(text: Column, rules: list[tuple[str, Column]], default: Column) -> Column:
    out = None
    for pattern, value in rules:
        out = F.when(text.rlike(pattern), value) if out is None else out.when(text.rlike(pattern), value)
    return default if out is None else out.otherwise(default)


def classified(text: Column, named: Column, book: RuleBook) -> Column:
    """``label`` and ``level`` of the first rule found; weak rules only where a threat is ``named``."""
    pair = lambda rule: F.struct(F.lit(rule[0]).alias("label"), F.lit(rule[2]).alias("level"))
    none = F.struct(F.lit("unknown").alias("label"), F.lit(1).alias("level"))
    weak = _first(text, [(r[1], pair(r)) for r in book.weak_signals], none)
    return _first(text, [(r[1], pair(r)) for r in book.signals], F.when(named, weak).otherwise(none))


def foreign_side(text: Column, book: RuleBook) -> Column:
    """T12."""
    return T.two_sided(text, book.foreign, book.ambiguous, book.foreign_context, book.own_side)


def with_infra(text: Column, signal: Column, threat: Column, book: RuleBook) -> tuple[Column, Column]:
    """The pair of signal and threat; infrastructure that opens again is an all-clear, and without a named threat it is its own kind."""
    infra = signal["label"] == "infra"
    clear = F.struct(F.lit("allclear").alias("label"), F.lit(0).alias("level"))
    own = F.when(text.rlike(book.air_infra), "airport").otherwise("infra")
    return F.when(infra & text.rlike(book.opened), clear).otherwise(signal), F.when(infra & (threat == "unknown"), own).otherwise(threat)


def with_fallback(text: Column, signal: Column, threat: Column, book: RuleBook) -> Column:
    """A named threat or a count in motion, in number or in a telegram is a detection; on its way to a place it is a danger there."""
    counted = text.rlike(book.counted)
    evidence = text.rlike(book.moving) | text.rlike(book.coming) | counted | text.rlike(book.crowd) | (F.length(text) <= TELEGRAM_CHARS)
    holds = (signal["label"] == "unknown") & ((threat != "unknown") | counted) & ~text.rlike(book.third_country) & evidence
    pair = lambda label, level: F.struct(F.lit(label).alias("label"), F.lit(level).alias("level"))
    return F.when(holds & text.rlike(book.coming), pair("danger", 5)).when(holds, pair("detection", 8)).otherwise(signal)


def with_downgrades(text: Column, signal: Column, book: RuleBook) -> Column:
    """What is unconfirmed, and then what is only expected."""
    pair = lambda label, level: F.struct(F.lit(label).alias("label"), F.lit(level).alias("level"))
    out = signal
    for label, less, level in book.doubted:
        out = F.when((signal["label"] == label) & text.rlike(book.unconfirmed), pair(less, level)).otherwise(out)
    rest = F.regexp_replace(text, book.anticipation, " ")
    doubted = out
    for label, pattern, less, level in book.expected:
        hit = (doubted["label"] == label) & text.rlike(book.anticipation) & ~rest.rlike(pattern)
        out = F.when(hit, pair(less, level)).otherwise(out)
    return out


def drop_reason(text: Column, label: Column, threat: Column, foreign: Column, book: RuleBook) -> Column:
    """Name of the first rule that drops a text, null for those that stay."""
    strikes = "|".join(r[1] for r in (*book.signals, *book.weak_signals) if r[0] == "impact")
    rest = F.regexp_replace(text, book.debris, " ")
    old = text.rlike(book.debris_found) | (text.rlike(book.debris_fell) & text.rlike(book.no_harm))
    rules = [("aftermath", label.isin("impact", "detection") & old & ~rest.rlike(strikes))]
    for rule in book.drops:
        hit = F.lit(False) if rule.pattern is None else text.rlike(rule.pattern)
        hit = hit | foreign if rule.foreign else hit
        if rule.only:
            hit = hit & label.isin(*rule.only)
        if rule.never:
            hit = hit & ~label.isin(*rule.never)
        if rule.unnamed:
            hit = hit & (threat == "unknown")
        if rule.longer:
            hit = hit & (F.length(text) > rule.longer)
        rules.append((rule.name, hit))
    return T.first_drop_reason([*rules, ("unnamed", label == "unknown"), ("caution", label == "caution")])


def phrases(body: Column, book: RuleBook) -> Column:
    """Without "level" fields, split by lines and then by marks, ends of sentences and dashes."""
    trimmed = lambda p: F.regexp_replace(p, "^[\\s.!?•—-]+|[\\s.!?•—​-]+$", "")
    lines = F.transform(F.split(F.regexp_replace(body, "(?i)" + book.level_field, " "), r"[\n;]+"), trimmed)
    chunks = F.flatten(F.transform(lines, lambda line: F.split(line, r"[,;:·]|(?<=[a-zа-яё])\.\s+| - | — ")))
    return F.filter(F.transform(chunks, trimmed), lambda p: (F.length(p) >= 3) & (F.length(p) <= 120))


def parsed(messages: DataFrame, book: RuleBook | None = None) -> DataFrame:
    """``messages`` (``text``) with the parse of each.

    Adds ``body``, ``drop_reason`` (null for reports), ``signal``, ``threat``,
    ``severity``, ``official``, ``direction_deg``, ``target_count``, ``massive`` and
    ``phrases``. Empty and null texts are dropped as ``empty``.
    """
    book = book or RuleBook()
    body = F.coalesce(T.strip_footer(F.col("text"), book.footer, book.brand), F.lit(""))
    out = messages.withColumn("body", body).withColumn("clean", F.regexp_replace(F.lower("body"), book.instruction, " "))
    clean, label = F.col("clean"), F.col("found.label")
    out = out.withColumn("threat", T.threat(clean, book.threats))
    out = out.withColumn("found", classified(clean, F.col("threat") != "unknown", book))
    signal, threat = with_infra(clean, F.col("found"), F.col("threat"), book)
    out = out.withColumns({"found": signal, "threat": threat})
    out = out.withColumn("found", with_fallback(clean, F.col("found"), F.col("threat"), book))
    out = out.withColumn("found", with_downgrades(clean, F.col("found"), book))
    reason = drop_reason(clean, label, F.col("threat"), foreign_side(clean, book), book)
    out = out.withColumns(
        {
            "drop_reason": F.when(F.col("body") == "", F.lit("empty")).otherwise(reason),
            "official": F.lower("body").rlike(book.official),
            "direction_deg": T.direction(clean),
            "target_count": T.count_of(clean, book.counted),
            "massive": T.crowd(clean, book.crowd),
            "phrases": phrases(F.col("body"), book),
        }
    )
    many = F.coalesce(F.col("target_count") >= 5, F.lit(False)) | F.col("massive")
    out = out.withColumns({"signal": label, "severity": boosted(F.col("found.level"), F.col("official"), many)})
    return out.drop("clean", "found")
