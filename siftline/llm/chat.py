"""Chat formatting with a grammar round trip.

The grammar has two productions::

    assistant turn   <s>TEXT</s>
    any other turn   [INST]ROLE\nTEXT[/INST]

Text that the parser would read differently, or that holds a control string,
gets one backslash after the first character of every control string, also of
those that already have backslashes there; reading takes one away again. Turns
whose plain form comes back identical, stay plain; the others are escaped and
compared again, up to ROUNDS times, and a turn that does not come back by then is
an error. The formatted conversation is parsed by the same deterministic grammar
and everything the query reports is read from that parse.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings that must never stand bare in a text.
CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

#: Escapes that are tried; with any set of control strings the first one is enough, unless one contains a backslash.
ROUNDS = 3

_PIECE = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>"
_TURN = "struct<role:string,text:string>"


def _by_first(controls: tuple[str, ...], slash: str) -> str:
    """Zero-width place after the first character of a control string, or its slash there."""
    firsts: dict[str, list[str]] = {}
    for control in controls:
        firsts.setdefault(control[0], []).append(re.escape(control[1:]))
    return "|".join(rf"(?<={re.escape(first)}){slash}(?=\\*(?:{'|'.join(tails)}))" for first, tails in firsts.items())


def has_control(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    return text.rlike("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in controls))


def escape(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    return F.regexp_replace(text, _by_first(controls, ""), r"\\")


def unescape(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    return F.regexp_replace(text, _by_first(controls, r"\\"), "")


def _role_out(role: Column) -> Column:
    for plain, coded in (("%", "%25"), ("\n", "%0A"), ("[", "%5B"), ("<", "%3C")):
        role = F.replace(role, F.lit(plain), F.lit(coded))
    return role


def _role_in(role: Column) -> Column:
    for plain, coded in (("<", "%3C"), ("[", "%5B"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(coded), F.lit(plain))
    return role


def render(role: Column, text: Column) -> Column:
    """One turn in the grammar; ``text`` is already escaped."""
    return F.when(role == "assistant", F.concat(F.lit("<s>"), text, F.lit("</s>"))).otherwise(
        F.concat(F.lit("[INST]"), _role_out(role), F.lit("\n"), text, F.lit("[/INST]"))
    )


def parse(formatted: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    """Turns of a formatted conversation, null where the grammar does not cover all of it."""
    pieces = F.regexp_extract_all(formatted, F.lit(_PIECE), 0)

    def turn(piece: Column) -> Column:
        reply = piece.startswith("<s>")
        inside = F.when(reply, F.substr(piece, F.lit(4), F.length(piece) - 7)).otherwise(F.substr(piece, F.lit(7), F.length(piece) - 13))
        head = F.substring_index(inside, "\n", 1)
        text = F.when(reply, inside).otherwise(F.substr(inside, F.length(head) + 2))
        role = F.when(reply, F.lit("assistant")).otherwise(_role_in(head))
        bare = text.rlike("|".join(map(re.escape, controls)))
        return F.struct(role.alias("role"), F.when(~bare, unescape(text, controls)).alias("text")).cast(_TURN)

    turns = F.transform(pieces, turn)
    covered = (F.array_join(pieces, "") == formatted) & ~F.exists(turns, lambda t: t["text"].isNull())
    return F.when(covered, turns)


def _until_identical(controls: tuple[str, ...]) -> Column:
    """A turn (``role``, ``text``) in the first form whose parse gives the turn back; bare control strings are always escaped."""
    role, text = F.col("role"), F.col("text")
    wanted = F.array(F.struct("role", "text").cast(_TURN))
    none = F.array().cast(f"array<{_TURN}>")
    shown = None
    for n in range(ROUNDS + 1):
        form = text
        for _ in range(n):
            form = escape(form, controls)
        turn = render(role, form)
        identical = F.coalesce(parse(turn, controls), none) == wanted
        identical = identical if n else ~has_control(text, controls) & identical
        shown = F.when(identical, turn) if shown is None else shown.when(identical, turn)
    return shown.otherwise(F.raise_error(F.concat(F.lit("no escape brings this text back: "), F.substring(text, 1, 200))))


def format_conversations(rows: DataFrame, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """One row per ``conv_id`` of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``).

    Returns ``conv_id``, ``formatted``, ``turns`` (array of role and text, parsed
    from ``formatted``), ``loss_text`` (assistant texts, parsed) and
    ``round_trip``, which says that the parse equals the source. Turns are in
    order of turn, then role, then text; null turns come first; rows repeated in
    the source stay repeated. Null role and null text count as empty; null
    ``conv_id`` is one conversation. No rows give no rows; other columns are
    ignored. A conversation is one row of the result, so its text has to fit a
    row; that is the only thing gathered per key.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("shown", _until_identical(controls))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "shown")))
    together = turns.groupBy("conv_id").agg(ordered.alias("rows"))
    formatted = together.select(
        "conv_id",
        F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")).cast(_TURN)).alias("source_turns"),
        F.array_join(F.transform("rows", lambda r: r["shown"]), "").alias("formatted"),
    ).withColumn("turns", parse(F.col("formatted"), controls))
    return formatted.select(
        "conv_id",
        "formatted",
        "turns",
        F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "").alias("loss_text"),
        F.coalesce(F.col("turns") == F.col("source_turns"), F.lit(False)).alias("round_trip"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader recovers from :func:`format_conversations`, as counts and digests."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )


ORACLE = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\[\\*/?INST\]|<\\*/?s>|<\\*<SYS>>|<\\*</SYS>>|<\\*\|(?:im_start|im_end|endoftext)\|>'))
    + CASE WHEN role = 'assistant' THEN 7 ELSE 14 + length(role) END AS shown FROM given
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(shown)::BIGINT AS formatted_chars, true AS round_trip
FROM sized GROUP BY conv_id
"""
