"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws the key ``-ln(u) / weight`` with ``u`` from a digest of its
id, so reruns agree. A source's budget of words first buys complete epochs of
the whole source; what is left goes to the documents with the smallest keys,
found by a prefix sum of sizes in key order, and the document on the border
gives only the words still missing.

The prefix sum is taken in two levels. Keys are mapped to ranges of about
``rows_per_range`` rows within each source; a small table of range sums gives
each range its offset, and only the rows of one range are ordered together. A
source with a third of all rows is thus many ranges, never one task. The ranges
are even whatever the weights: a key of weight w is at most x with the chance
1 - exp(-w x), so the share of a source's keys below x follows from how often
each weight, rounded to half powers of two, occurs in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import materialize, n_words

_U_BITS = 52
#: Half powers of two either way that weights are told apart by, for the ranges only.
WEIGHT_STEPS = 40


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that only depends on ``key`` and ``seed``."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")))
    high = F.conv(F.substring(digest, 1, _U_BITS // 4), 16, 10).cast("long")
    return (high.cast("double") + F.lit(0.5)) / F.lit(float(2**_U_BITS))


def symbol_quality(text: Column) -> Column:
    """Quality weight from structure alone: 1 for plain text, down to 0.1 where markup symbols abound."""
    share = F.regexp_count(text, F.lit(r"[%#$&*|!]")) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(4.0) * share), F.lit(1.0))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Share the sum of ``source_size`` among the rows of ``sizes`` by weight.

    ``sizes`` has a row for each source: ``source``, ``source_size``. Weights repeat
    in the order of sources (code points, null last). No target exceeds ``cap``
    times its source; the excess is shared anew by weight until none is above.
    That end point is found at once: with sources in ascending order of cap per
    weight, those before some place are capped and the rest share in proportion.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = (
        sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
        .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("fits", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level")))
        .withColumn("level", F.min("fits").over(everything)["level"])
    )
    return ranked.select("source", "source_size", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    cap: float = 3.0,
    seed: int = 17,
    quality: Column | None = None,
    rows_per_range: int = 2000,
) -> DataFrame:
    """How many words the mix takes of each row of ``docs`` (``doc_id``, ``text``, ``source``).

    Returns ``doc_id, source, size, source_size, target, taken``. ``quality`` is a
    positive weight, by default :func:`symbol_quality`; null counts as 1. Null and
    empty texts have size 0 and give 0 words; null ids and null sources are
    ordinary values; equal rows get equal keys and are ordered arbitrarily among
    themselves; an empty table gives an empty result. Other columns are ignored.
    """
    text, weight = F.col("text"), symbol_quality(F.col("text")) if quality is None else F.coalesce(quality, F.lit(1.0))
    sized = materialize(
        docs.select(
            "doc_id",
            "source",
            n_words(text).alias("size"),
            (-F.ln(uniform(F.col("doc_id"), seed)) / weight).alias("key"),
            weight.cast("double").alias("weight"),
        ),
        "mix-sizes",
    )
    step = F.least(F.greatest(F.round(F.log2(F.greatest("weight", F.lit(1e-12))) * 2), F.lit(-WEIGHT_STEPS)), F.lit(WEIGHT_STEPS)).cast("int")
    per_weight = sized.groupBy("source", step.alias("step")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    # at most 2 WEIGHT_STEPS + 1 entries a source
    per_source = per_weight.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum("rows").alias("rows"), F.sort_array(F.collect_list(F.struct("step", "rows"))).alias("steps")
    )
    targets = source_targets(per_source.select("source", "source_size"), weights, cap)
    plan = (
        targets.alias("t")
        .join(per_source.select(F.col("source").alias("s"), "rows", "steps"), F.col("t.source").eqNullSafe(F.col("s")))
        .select(
            F.col("t.source").alias("plan_source"),
            "source_size",
            "target",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("epochs"),
            F.ceil(F.col("rows") / F.lit(rows_per_range)).alias("ranges"),
            F.transform("steps", lambda s: F.struct(F.pow(F.lit(2.0), s["step"] / 2).alias("weight"), (s["rows"] / F.col("rows")).alias("share"))).alias("steps"),
        )
        .withColumn("rest", F.greatest(F.floor(F.col("target") - F.col("epochs") * F.col("source_size")), F.lit(0)))
    )
    above = F.aggregate("steps", F.lit(0.0), lambda total, s: total + s["share"] * F.exp(-F.col("key") * s["weight"]))
    # rounded down to steps far wider than the error of a sum, so that the order of ranges is that of keys
    place = F.greatest(F.least(F.floor((F.lit(1.0) - F.round(above, 12)) * F.col("ranges")), F.col("ranges") - 1), F.lit(0).cast("long"))
    ranged = sized.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).withColumn("range", place)
    offsets = (
        ranged.groupBy("plan_source", "range")
        .agg(F.sum("size").alias("range_size"))
        .withColumn(
            "offset",
            F.coalesce(
                F.sum("range_size").over(Window.partitionBy("plan_source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .select(F.col("plan_source").alias("offset_source"), F.col("range").alias("offset_range"), "offset")
    )
    within = Window.partitionBy("plan_source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    prefix = F.col("offset") + F.coalesce(F.col("in_range"), F.lit(0))
    return (
        ranged.withColumn("in_range", F.sum("size").over(within))
        .join(offsets, F.col("plan_source").eqNullSafe(F.col("offset_source")) & (F.col("range") == F.col("offset_range")))
        .withColumn("part", F.least(F.col("size"), F.greatest(F.col("rest") - prefix, F.lit(0))))
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"),
        )
    )


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':17'), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / coalesce(greatest(0.1, 1.0 - 4.0 * (len(regexp_extract_all(text, '[%#$&*|!]')) / greatest(length(text), 1))), 1.0) AS key
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 3.0::DOUBLE * source_size AS most,
    [5.0::DOUBLE, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::INT] AS weight
  FROM src
), levels AS (
  SELECT *, most / weight AS ratio,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), plan AS (
  SELECT source, source_size, least(most, weight * (SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio)) AS target FROM levels
), epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM plan
), placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.epochs,
    greatest(floor(p.target - p.epochs * p.source_size)::BIGINT, 0) AS rest,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prefix
  FROM sized s JOIN epochs p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(rest - prefix, 0)))::BIGINT AS taken FROM placed
"""
