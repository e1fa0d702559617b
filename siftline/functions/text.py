"""Text columns (T1-T29), built from rule tables.

Rules are data: ordered lists of (label, pattern, severity), word lists and
replacement lists that callers pass. The defaults below are a small English set;
``rules_from`` reads others from a table. Patterns keep to syntax that Java,
Python and RE2 read alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.scoring import boosted

#: Default rule tables.
UNIT_WORDS = ("district", "region", "county", "city", "town", "village", "municipality")
ABBREVIATIONS = (("distr", "district"), ("reg", "region"), ("mun", "municipality"), ("st", "saint"))
ENDINGS = ("ingly", "ations", "ation", "ings", "ness", "ing", "ers", "ies", "ed", "er", "es", "ly", "s")
SIGNAL_RULES = (("allclear", r"all clear|lifted|resolved", 0), ("impact", r"explosion|impact|hit", 9), ("intercept", r"intercept|shot down", 8), ("detection", r"detected|sighted|seen", 8), ("alarm", r"alarm|siren", 7), ("danger", r"danger|threat|warning", 5))
THREAT_RULES = (("airport", r"airport"), ("infra", r"bridge|power plant|pipeline"), ("rocket", r"rocket|missile"), ("uav", r"drone|uav"), ("aviation", r"aircraft|aviation"))
DIRECTIONS = {"north-east": 45, "south-east": 135, "south-west": 225, "north-west": 315, "north": 0, "east": 90, "south": 180, "west": 270}
COUNT = r"([0-9]{1,3}) (?:drones|uavs|targets|rockets|missiles|units)"
CROWD = r"massive|swarm|group of"
FOOTER = r"subscribe|follow us|send (?:us )?(?:your )?news"
MOTION = r" (?:towards|heading for|in the direction of) "
#: Rules that fit one expression.
MOST_RULES = 1000
_ZERO_WIDTH = "​‌‍⁠﻿"
#: Cyrillic letters in Latin.
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
LATIN = "a b v g d e zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" ")


def rules_from(table: DataFrame) -> list[tuple]:
    """Ordered rules of a small table (``place, label, pattern, severity``); a table that is no rule table is refused."""
    rows = table.orderBy("place").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules make no rule table")
    return [(r["label"], r["pattern"], r["severity"]) for r in rows]


def norm_key(text: Column) -> Column:
    """Lower case, yo and e folded, zero-width to space, punctuation but the hyphen gone, single spaces."""
    folded = F.translate(F.lower(text), "ёэ" + _ZERO_WIDTH, "ее" + " " * len(_ZERO_WIDTH))
    plain = F.regexp_replace(folded, r"(?U)[^\w\s-]", "")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def strip_unit(text: Column, units: tuple[str, ...] = UNIT_WORDS) -> Column:
    """The key without words for kinds of place."""
    gone = F.regexp_replace(norm_key(text), rf"(?<![\w-])(?:{'|'.join(units)})(?![\w-])", "")
    return F.trim(F.regexp_replace(gone, r"\s+", " "))


def expand_units(text: Column, table: tuple[tuple[str, str], ...] = ABBREVIATIONS) -> Column:
    """Abbreviations written out; single letters only with a dot and before a capital."""
    for short, full in table:
        pattern = rf"(?<!\w){short}\.\s*(?=[A-ZА-ЯЁ])" if len(short) == 1 else rf"(?i)(?<!\w){short}(?:\.|(?!\w))\s*"
        text = F.regexp_replace(text, pattern, full + " ")
    return F.trim(text)


def transliterate(text: Column) -> Column:
    """Cyrillic letters in Latin; single letters at once, the others one by one."""
    text = F.lower(text)
    for letter, latin in zip(CYRILLIC, LATIN, strict=True):
        if len(latin) > 1:
            text = F.replace(text, F.lit(letter), F.lit(latin))
    single = [(c, x) for c, x in zip(CYRILLIC, LATIN, strict=True) if len(x) == 1]
    dropped = "".join(c for c, x in zip(CYRILLIC, LATIN, strict=True) if not x)
    return F.translate(text, "ё" + "".join(c for c, _ in single) + dropped, "e" + "".join(x for _, x in single))


#: Latin spellings of Cyrillic sounds, longest first, and endings of names of units.
DIGRAPHS = (("shch", "щ"), ("yo", "ё"), ("zh", "ж"), ("kh", "х"), ("ts", "ц"), ("ch", "ч"), ("sh", "ш"), ("yu", "ю"), ("ya", "я"))
LETTERS = ("abcdefghijklmnopqrstuvwxyz", "абкдефгхижклмнопкрстуввхйз")
SUFFIXES = (("skiy$", "ский"), ("sky$", "ский"), ("skaya$", "ская"), ("skoe$", "ское"), ("iy$", "ий"), ("yy$", "ый"))


def to_cyrillic(text: Column) -> Column:
    """Latin words in Cyrillic, each with a capital: endings first, then digraphs, then letters."""

    def word(w: Column) -> Column:
        for pattern, ending in SUFFIXES:
            w = F.regexp_replace(w, pattern, ending)
        for latin, letter in DIGRAPHS:
            w = F.replace(w, F.lit(latin), F.lit(letter))
        return F.initcap(F.translate(w, *LETTERS))

    return F.array_join(F.transform(F.split(F.lower(text), " "), word), " ")


def slug(text: Column) -> Column:
    """T4: transliterated words joined by underscores."""
    return F.regexp_replace(F.regexp_replace(transliterate(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def stem(word: Column, endings: tuple[str, ...] = ENDINGS) -> Column:
    """T5: a word without its longest listed ending, at least three letters left."""
    return F.regexp_replace(word, rf"^(.{{3,}}?)(?:{'|'.join(endings)})$", "$1")


def stem_key(key: Column, endings: tuple[str, ...] = ENDINGS) -> Column:
    return F.array_join(F.transform(F.split(key, " "), lambda w: stem(w, endings)), " ")


def gender(word: Column, feminine: tuple[str, ...] = ("a", "я", "а"), neuter: tuple[str, ...] = ("о", "е")) -> Column:
    """Grammatical gender by ending; empty if unknown."""
    out = F.when(reduce(lambda x, y: x | y, [word.endswith(e) for e in feminine]), "f")
    out = out.when(reduce(lambda x, y: x | y, [word.endswith(e) for e in neuter]), "n")
    return out.when(word.rlike("[a-zа-яё]$"), "m").otherwise("")


def name_variants(name: Column) -> Column:
    """Key, key without unit words, hyphens as spaces; three letters or more."""
    key, bare = norm_key(name), strip_unit(name)
    made = F.array(key, bare, F.replace(key, F.lit("-"), F.lit(" ")), F.replace(bare, F.lit("-"), F.lit(" ")))
    return F.array_distinct(F.filter(made, lambda v: F.length(v) >= 3))


def strip_footer(text: Column, strong: str = FOOTER, brand: str = "@", limit: int = 100) -> Column:
    """The text without lines that match a footer, or are short and match a brand."""
    keep = lambda line: ~(line.rlike(f"(?i){strong}") | ((F.length(F.trim(line)) <= limit) & line.rlike(brand)))
    return F.trim(F.array_join(F.filter(F.split(text, "\n"), keep), "\n"))


def first_match(text: Column, rules, default):
    """The label of the first rule that matches; one wide CASE, so no rule leaves the JVM."""
    out = None
    for rule in rules:
        hit = F.lower(text).rlike(rule[1])
        out = F.when(hit, F.lit(rule[0])) if out is None else out.when(hit, F.lit(rule[0]))
    return out.otherwise(F.lit(default))


def signal(text: Column, rules=SIGNAL_RULES) -> Column:
    return first_match(text, rules, "unknown")


def severity(text: Column, rules=SIGNAL_RULES) -> Column:
    return first_match(text, [(r[2], r[1]) for r in rules], 1)


def threat(text: Column, rules=THREAT_RULES) -> Column:
    return first_match(text, rules, "unknown")


def first_drop_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first drop rule (a boolean column each) that holds; null keeps the message."""
    return F.coalesce(*[F.when(condition, F.lit(name)) for name, condition in rules])


def two_sided(text: Column, strong: str, ambiguous: str, context: str, veto: str) -> Column:
    """A strong marker, or an ambiguous one with context, unless vetoed."""
    low = F.lower(text)
    return (low.rlike(strong) | (low.rlike(ambiguous) & low.rlike(context))) & ~low.rlike(veto)


def downgraded(text: Column, label: Column, level: Column, unconfirmed: str = "unconfirmed|rumou?r", anticipation: str = "expected|possible") -> tuple[Column, Column]:
    """Unconfirmed reports are alarms at 7 at most; mere anticipation, with nothing left besides it, is danger at 5 at most."""
    low = F.lower(text)
    hot = label.isin("impact", "intercept", "detection")
    rest = signal(F.regexp_replace(low, anticipation, " "))
    doubt, ahead = low.rlike(unconfirmed) & hot, low.rlike(anticipation) & (rest == "unknown")
    return (
        F.when(doubt, "alarm").when(ahead, "danger").otherwise(label),
        F.when(doubt, F.least(level, F.lit(7))).when(ahead, F.least(level, F.lit(5))).otherwise(level),
    )


def fallback_signal(label: Column, kind: Column, count: Column, degrees: Column, moving: Column) -> Column:
    """An unnamed signal with a threat or count: on its way is danger, otherwise with any detail a detection."""
    known = (kind != "unknown") | count.isNotNull()
    return F.when((label == "unknown") & known & moving, "danger").when((label == "unknown") & known & (count.isNotNull() | degrees.isNotNull()), "detection").otherwise(label)


def infra_pair(text: Column, label: Column, kind: Column, opened: str = "open(?:ed|s)?|restored", closed: str = "clos(?:ed|es)|suspend") -> tuple[Column, Column]:
    """Infrastructure that opens again is an all-clear of its own kind."""
    low, infra = F.lower(text), kind.isin("airport", "infra")
    return F.when(infra & low.rlike(opened), "allclear").when(infra & low.rlike(closed) & (label == "unknown"), "danger").otherwise(label), kind


def direction(text: Column) -> Column:
    """Degrees of the first compass word."""
    word = F.regexp_extract(F.lower(text), "(" + "|".join(DIRECTIONS) + ")", 1)
    return F.element_at(F.create_map(*[F.lit(x) for pair in DIRECTIONS.items() for x in pair]), F.nullif(word, F.lit("")))


def count_of(text: Column, pattern: str = COUNT, most: int = 200) -> Column:
    """The largest number captured, in (0, ``most``]."""
    numbers = F.transform(F.regexp_extract_all(F.lower(text), F.lit(pattern), 1), lambda x: x.cast("int"))
    return F.array_max(F.filter(numbers, lambda x: (x > 0) & (x <= most)))


def crowd(text: Column, pattern: str = CROWD) -> Column:
    """T18."""
    return F.lower(text).rlike(pattern)


def phrases(text: Column, least: int = 3, most: int = 120) -> Column:
    """Pieces of a text between line ends, commas, colons and sentence ends, of ``least`` to ``most`` characters."""
    parts = F.transform(F.split(text, r"[\n;,:]|[.!?](?:\s|$)| - "), lambda p: F.trim(p))
    return F.filter(parts, lambda p: (F.length(p) >= least) & (F.length(p) <= most))


def split_direction(phrase: Column, motion: str = MOTION) -> Column:
    """What stands before a motion phrase and what after it."""
    parts = F.split(phrase, motion, 2)
    return F.struct(parts[0].alias("observed"), F.when(F.size(parts) > 1, parts[1]).alias("target"))


def latin_form(text: Column) -> Column:
    """Lower-case ASCII letters, digits and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " +", " "))


def best_alternate(names: DataFrame) -> DataFrame:
    """Per ``id`` the alternate nearest to ``ascii_name`` by edit distance, ties by ``place``."""
    score = F.levenshtein(latin_form(F.col("ascii_name")), latin_form(F.col("alternate")))
    return names.withColumn("score", score).groupBy("id").agg(F.min_by(F.struct("alternate", "score"), F.struct("score", "place")).alias("b")).select("id", "b.alternate", "b.score")


def replaced(name: Column, overrides: dict[str, str], rules: list[tuple[str, str]]) -> Column:
    """An override, else ordered replacements."""
    out = reduce(lambda text, rule: F.regexp_replace(text, rule[0], rule[1]), rules, name)
    if not overrides:
        return out
    table = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])
    return F.coalesce(F.element_at(table, name), out)


def best_by_key(lookup: DataFrame, queries: DataFrame) -> DataFrame:
    """Least score per key, then per query the least over its key variants with their penalty."""
    best = lookup.groupBy("key").agg(F.min_by(F.struct("name", "priority"), F.struct("priority", "name")).alias("b"))
    met = queries.join(best, "key").withColumn("score", F.col("b.priority") + F.col("penalty"))
    return met.groupBy("query").agg(F.min_by(F.struct(F.col("b.name").alias("name"), "score"), F.struct("score", "b.name")).alias("r")).select("query", "r.name", "r.score")


def same_place(left: Column, right: Column) -> Column:
    """T29."""
    return strip_unit(left) == strip_unit(right)


def parsed(messages: DataFrame) -> DataFrame:
    """The parse of a message table: footer, labels, count, direction, boost, phrases."""
    body = messages.withColumn("body", strip_footer(F.col("text")))
    b = F.col("body")
    labels = body.withColumns({"signal": signal(b), "base": severity(b), "threat": threat(b), "target_count": count_of(b), "direction_deg": direction(b), "massive": crowd(b)})
    many = F.coalesce(F.col("target_count") >= 5, F.lit(False)) | F.col("massive")
    return labels.withColumn("severity", boosted(F.col("base"), F.lit(False), many)).withColumn("phrases", phrases(b)).drop("base")
