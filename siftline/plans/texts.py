"""Registered text queries (T) over documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import scoring as S
from siftline.functions import text as T
from siftline.operators import networks
from siftline.plans import views as V

#: Rules in words of the generated corpus, so that they match something.
SIGNALS = (("allclear", "the end|fin del", 0), ("impact", "thatshly|ciónga", 9), ("detection", "ening|mente", 8), ("danger", "the|que|der", 5))
THREATS = (("rocket", "@mail"), ("uav", "akia"), ("aviation", "license"))


def _docs(s, d):
    return V.read(s, d, "documents").select("doc_id", "text", "lang")


def _case(rules, column: str, place: int) -> str:
    value = lambda r: f"'{r[0]}'" if place == 0 else str(r[2])
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({column}), '{r[1]}') THEN {value(r)}" for r in rules)


def _hedged(s, d):
    body = F.when(F.col("raw_id") % 4 == 0, "unconfirmed explosion").when(F.col("raw_id") % 4 == 1, "possible").otherwise("explosion seen")
    return V.observations(s, d).withColumn("body", body)


#: Letters that are spelt the same way there and back.
_ROUND = ("abvgdezklmnoprstuf", "абвгдезклмнопрстуф")
_SPELT = "word"
for _pattern, _ending in T.SUFFIXES:
    _SPELT = f"regexp_replace({_SPELT}, '{_pattern}', '{_ending}')"
for _latin, _letter in T.DIGRAPHS:
    _SPELT = f"replace({_SPELT}, '{_latin}', '{_letter}')"
_SPELT = "translate({}, '{}', '{}')".format(_SPELT, *T.LETTERS)
_STEM = "|".join(T.ENDINGS)
_NAMES = "names AS (SELECT p_partkey AS id, p_name AS ascii_name, unnest(['old ' || p_name, upper(p_name), p_brand]) AS alternate, unnest([0, 1, 2]) AS place FROM part)"


def _names(s, d):
    options = F.posexplode(F.array(F.concat(F.lit("old "), "p_name"), F.upper("p_name"), "p_brand")).alias("place", "alternate")
    return V.read(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("ascii_name"), options)


QUERIES = {
    "t01_norm_key": lambda s, d: _docs(s, d).select("doc_id", F.md5(T.norm_key(F.col("text"))).alias("key")),
    "t02_strip_unit": lambda s, d: V.zones(s, d).select("zone_id", T.strip_unit(F.concat("name", F.lit(" District"))).alias("bare")),
    "t03_expand_units": lambda s, d: V.zones(s, d).select("zone_id", T.expand_units(F.concat(F.lit("reg. "), "name")).alias("full")),
    "t04_slugs": lambda s, d: V.read(s, d, "part").select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug")),
    "t05_stems": lambda s, d: _docs(s, d).select("doc_id", F.md5(T.stem_key(F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0), " "))).alias("stems")),
    "t07_name_variants": lambda s, d: V.zones(s, d).select("zone_id", F.array_join(F.sort_array(T.name_variants(F.concat("name", F.lit("-District")))), ",").alias("variants")),
    "t08_strip_footer": lambda s, d: _docs(s, d).select("doc_id", F.length(T.strip_footer(F.col("text"), "licensed|license")).alias("left_chars")),
    "t09_signal": lambda s, d: _docs(s, d).select("doc_id", T.signal(F.col("text"), SIGNALS).alias("signal"), T.severity(F.col("text"), SIGNALS).alias("severity")),
    "t10_threat": lambda s, d: _docs(s, d).select("doc_id", T.threat(F.col("text"), THREATS).alias("threat")),
    "t11_drop_reason": lambda s, d: _docs(s, d)
    .select("doc_id", T.first_drop_reason([("short", F.length("text") < 400), ("mail", F.col("text").rlike("@mail")), ("shout", F.col("text").rlike("!!"))]).alias("reason"))
    .where("reason IS NOT NULL"),
    "t12_two_sided": lambda s, d: _docs(s, d).select("doc_id", T.two_sided(F.col("text"), "akia", "@mail", "the|que", "license").alias("foreign")),
    "t16_direction": lambda s, d: V.read(s, d, "orders").select("o_orderkey", T.direction(F.concat(F.lit("moving "), F.element_at(F.array(*[F.lit(w) for w in T.DIRECTIONS]), (F.col("o_orderkey") % 8 + 1).cast("int")))).alias("deg")),
    "t17_counts": lambda s, d: _docs(s, d).select("doc_id", T.count_of(F.col("text"), "([0-9]{1,3})\\.").alias("most")),
    "t18_crowd": lambda s, d: _docs(s, d).select("doc_id", T.crowd(F.col("text"), "%%%|!!").alias("massive")),
    "t19_boost": lambda s, d: V.observations(s, d).select("raw_id", S.boosted(F.col("severity"), F.col("tier") == "official", F.col("raw_id") % 3 == 0).alias("severity")),
    "t20_phrases": lambda s, d: _docs(s, d).select("doc_id", F.size(T.phrases(F.col("text"))).alias("n")),
    "t21_observed_target": lambda s, d: V.zones(s, d).select("zone_id", T.split_direction(F.concat(F.lit("seen near "), "name", F.lit(" heading for "), "zone_id")).alias("p")).select("zone_id", "p.observed", "p.target"),
    "t22_repost_keys": lambda s, d: _docs(s, d).select("doc_id", networks.repost_key(F.col("text")).alias("key")),
    "t23_network_keys": lambda s, d: _docs(s, d).select("doc_id", F.md5(networks.text_key(F.col("text"))).alias("key")),
    "t24_best_alternate": lambda s, d: T.best_alternate(_names(s, d)),
    "t25_replaced_names": lambda s, d: V.read(s, d, "part").select("p_partkey", T.replaced(F.col("p_name"), {"small ring": "Ring"}, [("^red ", "crimson "), ("bolt$", "screw")]).alias("name")),
    "t26_best_by_key": lambda s, d: T.best_by_key(
        V.read(s, d, "part").select(F.col("p_name").alias("key"), F.col("p_brand").alias("name"), F.col("p_size").alias("priority")),
        V.read(s, d, "part").select(F.col("p_type").alias("query"), F.col("p_name").alias("key"), (F.col("p_partkey") % 5).alias("penalty")),
    ),
    "t06_gender": lambda s, d: V.read(s, d, "part").select("p_partkey", T.gender(F.element_at(F.split("p_name", " "), -1)).alias("gender")),
    "t13_downgrades": lambda s, d: _hedged(s, d).select("raw_id", *[c.alias(n) for c, n in zip(T.downgraded(F.col("body"), F.col("signal"), F.col("severity")), ("label", "level"), strict=True)]),
    "t14_fallback_signal": lambda s, d: _hedged(s, d).select("raw_id", T.fallback_signal(F.lit("unknown"), F.col("threat"), F.when(F.col("raw_id") % 3 == 0, F.lit(2)), F.lit(None).cast("int"), F.col("raw_id") % 5 == 0).alias("label")),
    "t15_infra_pairs": lambda s, d: _hedged(s, d).select("raw_id", T.infra_pair(F.when(F.col("raw_id") % 2 == 0, "airport opened").otherwise("bridge closed"), F.lit("unknown"), F.when(F.col("raw_id") % 3 == 0, "airport").otherwise("uav"))[0].alias("label")),
    "t27_transliteration": lambda s, d: V.read(s, d, "part").select("p_partkey", T.transliterate(F.translate("p_name", *_ROUND)).alias("latin"), T.to_cyrillic(F.concat("p_name", F.lit("skiy"))).alias("cyrillic")),
    "t28_tidy_names": lambda s, d: V.read(s, d, "part").select("p_partkey", T.replaced(F.col("p_brand"), {}, [("^Brand", ""), ("#([0-9])$", "#0$1")]).alias("tidy")),
    "t29_same_place": lambda s, d: V.read(s, d, "part").select(
        "p_partkey", T.same_place(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper("p_name"), F.lit(" City"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("district "), "p_name")).otherwise(F.concat("p_name", F.lit(" two")))).alias("same")
    ),
}
_DIR = "['" + "', '".join(T.DIRECTIONS) + "']"
_DEG = "[" + ", ".join(map(str, T.DIRECTIONS.values())) + "]"
_SQUEEZED = r"lower(regexp_replace(text, '\s+', '', 'g'))"
ORACLE = {
    "t01_norm_key": r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(translate(lower(text), 'ёэ', 'ее'), '[^\p{L}\p{N}\p{M}_\s-]', '', 'g'), '\s+', ' ', 'g'))) AS key FROM documents",
    "t02_strip_unit": f"WITH {V.ZONES} SELECT zone_id, lower(replace(name, '#', '')) AS bare FROM zones",
    "t03_expand_units": f"WITH {V.ZONES} SELECT zone_id, 'region ' || name AS full FROM zones",
    "t04_slugs": "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part",
    "t05_stems": f"SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda w: regexp_replace(w, '^(.{{3,}}?)(?:{_STEM})$', '\\1')), ' ')) AS stems FROM documents",
    "t07_name_variants": f"WITH {V.ZONES} SELECT zone_id, array_to_string(list_sort(list_distinct([lower(replace(name, '#', '')) || '-district', lower(replace(name, '#', '')) || ' district'])), ',') AS variants FROM zones",
    "t08_strip_footer": "SELECT doc_id, length(trim(array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT (regexp_matches(lower(l), 'licensed|license') OR (length(trim(l)) <= 100 AND contains(l, '@')))), chr(10)))) AS left_chars FROM documents",
    "t09_signal": f"SELECT doc_id, {_case(SIGNALS, 'text', 0)} ELSE 'unknown' END AS signal, {_case(SIGNALS, 'text', 2)} ELSE 1 END AS severity FROM documents",
    "t10_threat": f"SELECT doc_id, {_case(THREATS, 'text', 0)} ELSE 'unknown' END AS threat FROM documents",
    "t11_drop_reason": "SELECT * FROM (SELECT doc_id, CASE WHEN length(text) < 400 THEN 'short' WHEN contains(text, '@mail') THEN 'mail' WHEN contains(text, '!!') THEN 'shout' END AS reason FROM documents) WHERE reason IS NOT NULL",
    "t12_two_sided": "SELECT doc_id, (regexp_matches(lower(text), 'akia') OR (regexp_matches(lower(text), '@mail') AND regexp_matches(lower(text), 'the|que'))) AND NOT regexp_matches(lower(text), 'license') AS foreign FROM documents",
    "t16_direction": f"SELECT o_orderkey, {_DEG}[1 + o_orderkey % 8] AS deg FROM orders",
    "t17_counts": r"SELECT doc_id, list_max(list_filter(list_transform(regexp_extract_all(lower(text), '([0-9]{1,3})\.', 1), lambda x: x::INT), lambda x: x > 0 AND x <= 200)) AS most FROM documents",
    "t18_crowd": "SELECT doc_id, regexp_matches(lower(text), '%%%|!!') AS massive FROM documents",
    "t19_boost": f"""WITH {V.OBSERVATIONS}, o AS (SELECT *, CASE WHEN severity <= 3 THEN 3 WHEN severity <= 5 THEN 5 WHEN severity <= 7 THEN 7 ELSE 10 END AS top, CASE WHEN tier = 'official' THEN 1 ELSE 0 END AS a, CASE WHEN raw_id % 3 = 0 THEN 1 ELSE 0 END AS b FROM observations)
SELECT raw_id, least(severity + a + b, top) AS severity FROM o""",
    "t20_phrases": r"SELECT doc_id, len(list_filter(list_transform(string_split_regex(text, '[\n;,:]|[.!?](?:\s|$)| - '), lambda p: trim(p)), lambda p: length(p) BETWEEN 3 AND 120)) AS n FROM documents",
    "t21_observed_target": f"WITH {V.ZONES} SELECT zone_id, 'seen near ' || name AS observed, zone_id AS target FROM zones",
    "t22_repost_keys": f"SELECT doc_id, CASE WHEN length({_SQUEEZED}) >= 120 THEN substr(sha1({_SQUEEZED}), 1, 16) END AS key FROM documents",
    "t23_network_keys": r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g'))) AS key FROM documents",
    "t24_best_alternate": f"""WITH {_NAMES}, scored AS (SELECT *, levenshtein(trim(regexp_replace(lower(ascii_name), '[^a-z0-9]+', ' ', 'g')), trim(regexp_replace(lower(alternate), '[^a-z0-9]+', ' ', 'g'))) AS score FROM names)
SELECT id, arg_min(alternate, (score, place)) AS alternate, min(score)::INT AS score FROM scored GROUP BY id""",
    "t25_replaced_names": "SELECT p_partkey, CASE WHEN p_name = 'small ring' THEN 'Ring' ELSE regexp_replace(regexp_replace(p_name, '^red ', 'crimson '), 'bolt$', 'screw') END AS name FROM part",
    "t26_best_by_key": """WITH best AS (SELECT p_name AS key, min(p_size) AS priority, arg_min(p_brand, (p_size, p_brand)) AS name FROM part GROUP BY 1)
SELECT p_type AS query, arg_min(name, (priority + p_partkey % 5, name)) AS name, min(priority + p_partkey % 5)::BIGINT AS score FROM part JOIN best ON p_name = key GROUP BY 1""",
    "t06_gender": "SELECT p_partkey, CASE WHEN right(p_name, 1) = 'a' THEN 'f' WHEN regexp_matches(p_name, '[a-z]$') THEN 'm' ELSE '' END AS gender FROM part",
    "t13_downgrades": f"""WITH {V.OBSERVATIONS} SELECT raw_id, CASE WHEN raw_id % 4 = 0 AND signal IN ('impact', 'detection') THEN 'alarm' WHEN raw_id % 4 = 1 THEN 'danger' ELSE signal END AS label,
  CASE WHEN raw_id % 4 = 0 AND signal IN ('impact', 'detection') THEN least(severity, 7) WHEN raw_id % 4 = 1 THEN least(severity, 5) ELSE severity END AS level FROM observations""",
    "t14_fallback_signal": f"WITH {V.OBSERVATIONS} SELECT raw_id, CASE WHEN (threat <> 'unknown' OR raw_id % 3 = 0) AND raw_id % 5 = 0 THEN 'danger' WHEN raw_id % 3 = 0 THEN 'detection' ELSE 'unknown' END AS label FROM observations",
    "t15_infra_pairs": f"WITH {V.OBSERVATIONS} SELECT raw_id, CASE WHEN raw_id % 3 = 0 THEN CASE WHEN raw_id % 2 = 0 THEN 'allclear' ELSE 'danger' END ELSE 'unknown' END AS label FROM observations",
    "t27_transliteration": f"""WITH w AS (SELECT p_partkey, p_name, unnest(string_split(lower(p_name || 'skiy'), ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS k FROM part),
c AS (SELECT p_partkey, p_name, k, {_SPELT} AS word FROM w)
SELECT p_partkey, lower(p_name) AS latin, string_agg(upper(left(word, 1)) || substr(word, 2), ' ' ORDER BY k) AS cyrillic FROM c GROUP BY p_partkey, p_name""",
    "t28_tidy_names": "SELECT p_partkey, regexp_replace(regexp_replace(p_brand, '^Brand', ''), '#([0-9])$', '#0\\1') AS tidy FROM part",
    "t29_same_place": "SELECT p_partkey, p_partkey % 3 <> 2 AS same FROM part",
}
