"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Every text is scanned for three base patterns and for long mixed tokens. The
value of each candidate is hashed; a corpus-wide aggregate counts the distinct
repositories and owners of every hash. A value that several owners or many
repositories share is a copied example; a value that one owner has in few
repositories and that looks random is taken for a live credential. Base spans are always reported; a long mixed token adds a span
of kind ``token`` only where ownership makes it a live credential.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import dealt_join, materialize


@dataclass(frozen=True)
class Pattern:
    """``regex`` with ASCII classes only; ``value`` is its group that is the secret, of ``least`` characters or more."""

    kind: str
    regex: str
    value: int
    least: int


#: Fixed values, in the order in which spans with the same start are listed.
BASE = (
    Pattern(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    Pattern("access", r"AKIA[A-Z0-9]+", 0, 16),
    Pattern("hex", r"[0-9a-f]{32,}", 0, 32),
)
ADDED = Pattern("token", r"[A-Za-z0-9+/_-]{20,}", 0, 20)
PATTERNS = (*BASE, ADDED)

#: Words that mark a value as a placeholder.
PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|dummy|xxxx|12345678|abcdefgh|your[_-]"

#: Matches of a text that are placed together.
FOLD = 64

_SPAN = "struct<start:int,rank:int,stop:int,hash:bigint,random:boolean>"


def looks_random(value: Column) -> Column:
    """At least 16 characters, 8 of them different, with a digit and a letter, and no placeholder word."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER) & (different >= 8)


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")


def spans_of(text: Column, rank: int, pattern: Pattern) -> Column:
    """Leftmost non-overlapping matches with their places in code points.

    A match starts after all pieces and matches before it, so places are running
    sums over the split text; nothing is searched again from the start.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern.regex), 0)
    pieces = F.slice(F.split(text, pattern.regex, -1), F.lit(1), F.size(matches))

    def found(gap: Column, match: Column) -> Column:
        value = F.regexp_extract(match, pattern.regex, pattern.value) if pattern.value else match
        keep = F.length(value) >= pattern.least
        if pattern is ADDED:
            keep = keep & _mixed(value)
        return F.struct(
            F.length(gap).alias("gap"),
            F.length(match).alias("size"),
            keep.alias("keep"),
            F.xxhash64(value).alias("hash"),
            looks_random(value).alias("random"),
        )

    sized = F.zip_with(pieces, matches, found)
    # places are running sums; they are taken in two steps, over FOLD matches and over the groups of FOLD, as appending copies
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / FOLD).cast("int")), lambda g: F.slice(sized, g * FOLD + 1, F.lit(FOLD)))
    length = lambda g: F.aggregate(g, F.lit(0), lambda n, m: n + m["gap"] + m["size"])
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(F.transform(groups, length), begin, lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts")))["starts"]
    none = F.array().cast(f"array<{_SPAN}>")
    return F.when(text.rlike(pattern.regex), F.flatten(F.zip_with(starts, groups, lambda at, g: _placed(at, g, rank)))).otherwise(none)


def _placed(at: Column, group: Column, rank: int) -> Column:
    """Spans of the matches of one group that are kept, the first of which begins its gap at ``at``."""

    def step(state: Column, match: Column) -> Column:
        start = state["at"] + match["gap"]
        span = F.struct(
            start.alias("start"),
            F.lit(rank).alias("rank"),
            (start + match["size"]).alias("stop"),
            match["hash"].alias("hash"),
            match["random"].alias("random"),
        ).cast(_SPAN)
        return F.struct(
            (start + match["size"]).alias("at"),
            F.when(match["keep"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(group, F.struct(at.alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans")), step)["spans"]


def _text_of(spans: Column, kinds: tuple[str, ...]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each hash of ``candidates`` (``hash``, ``repo``, ``owner``).

    Counts are taken in three steps of partial aggregates, so that a value in a
    third of all rows sends one row from each task, and no set is gathered.
    """
    return (
        candidates.groupBy("hash", "owner", "repo")
        .agg(F.count(F.lit(1)).alias("uses"))
        .groupBy("hash", "owner")
        .agg(F.count(F.lit(1)).alias("repos"), F.sum("uses").alias("uses"))
        .groupBy("hash")
        .agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("uses").alias("n_uses"))
    )


def scan(
    docs: DataFrame,
    repo: Column,
    owner: Column,
    example_owners: int = 3,
    example_repos: int = 4,
    live_owners: int = 1,
) -> DataFrame:
    """Secrets of each row of ``docs`` (``doc_id``, ``text``).

    Returns one row per row: ``doc_id``, counts by kind (``n_assign``,
    ``n_access``, ``n_hex``, ``n_token``), ``n_live`` and ``n_example`` spans by
    the ownership verdict, ``base_sha256`` over the base spans and ``spans``, all
    spans. A span is ``kind:start:end`` in code points, end exclusive; spans are
    in order of start, then kind as listed, joined by commas.

    A hash with ``example_owners`` or more owners, or ``example_repos`` or more
    repositories, is an example; of the others, one with at most ``live_owners``
    owners that looks random is live. Null text counts as empty
    and gives no spans; null repositories and owners count as one each; equal
    rows each get a row; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast(f"array<{_SPAN}>")
    base = F.flatten(F.array(*[spans_of(F.col("__text"), rank, p) for rank, p in enumerate(BASE)]))
    clear = lambda s: ~F.exists("base", lambda b: (s["start"] < b["stop"]) & (b["start"] < s["stop"]))
    scanned = materialize(
        docs.select("doc_id", text.alias("__text"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"))
        .withColumn("base", F.array_sort(base))
        .withColumn("added", spans_of(F.col("__text"), len(BASE), ADDED))
        .select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "repo",
            "owner",
            "base",
            F.when(F.size("added") > 0, F.filter("added", clear)).otherwise(none).alias("added"),
        ),
        "secret-spans",
    )
    candidates = scanned.select("row", "repo", "owner", F.explode(F.concat("base", "added")).alias("span")).withColumn("hash", F.col("span.hash"))
    example = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)
    verdicts = ownership(candidates).select("hash", "n_owners", example.alias("example"))
    live = ~F.col("example") & (F.col("n_owners") <= live_owners) & F.col("span.random")
    judged = (
        dealt_join(candidates, verdicts, ["hash"], "row")
        .select("row", "span", live.alias("live"), "example")
        .groupBy("row")
        .agg(
            F.count_if("live").alias("n_live"),
            F.count_if("example").alias("n_example"),
            F.sort_array(F.collect_list(F.when(F.col("live") & (F.col("span.rank") == len(BASE)), F.col("span")))).alias("owned"),
        )
        .withColumnRenamed("row", "judged_row")
    )
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    kinds = tuple(p.kind for p in PATTERNS)
    owned = F.coalesce("owned", none)
    return scanned.join(judged, F.col("row") == F.col("judged_row"), "left").select(
        "doc_id",
        *[count(rank).alias(f"n_{p.kind}") for rank, p in enumerate(BASE)],
        F.size(owned).cast("long").alias("n_token"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
        F.sha2(_text_of(F.col("base"), kinds), 256).alias("base_sha256"),
        _text_of(F.array_sort(F.concat("base", owned)), kinds).alias("spans"),
    )
