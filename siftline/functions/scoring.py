"""Fixed weights of the fusion model and the columns made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
TIER_WEIGHT = {"official": 0.72, "federal": 0.55, "regional": 0.4, "mixed": 0.25}
DEFAULT_WEIGHT = 0.25
ACCURACY_M = {"place": 4_000, "district": 12_000, "region": 40_000}
DEFAULT_ACCURACY_M = 12_000
FADE_MINUTES = {"place": 20, "district": 35, "region": 165}
THREAT_SPEED = {"rocket": 0.2, "aviation": 0.3, "kab": 0.4, "uav": 1.0, "fpv": 1.0, "bek": 2.0}
FADE_FLOOR = 0.12
FADE_LEAST_MINUTES = 8
FADE_AFTER_SECONDS = 45 * 60
CLOSE_AFTER_SECONDS = 3 * 3600
SEVERITY_BANDS = (3, 5, 7, 10)
SIGHTINGS = ("detection", "intercept", "impact")


def pick(key: Column, table: dict, default) -> Column:
    """Value of ``key`` in a small fixed table."""
    out = None
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)) if out is None else out.when(key == name, F.lit(value))
    return out.otherwise(F.lit(default))


def seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def noisy_or(counts: dict[str, Column]) -> Column:
    """1 - product of (1 - weight) over independent voices, by the number of voices of each tier, to 3 decimals."""
    miss = None
    for tier, count in counts.items():
        factor = F.pow(F.lit(round(1 - TIER_WEIGHT.get(tier, DEFAULT_WEIGHT), 4)), count)
        miss = factor if miss is None else miss * factor
    return F.round(F.lit(1) - miss + F.lit(1e-9), 3)


def accuracy(level: Column) -> Column:
    return pick(level, ACCURACY_M, DEFAULT_ACCURACY_M)


def fade_window(level: Column, threat: Column) -> Column:
    """Seconds in which a target leaves a zone of this level."""
    base = pick(level, {k: v * 60.0 for k, v in FADE_MINUTES.items()}, FADE_MINUTES["district"] * 60.0)
    return F.greatest(F.lit(FADE_LEAST_MINUTES * 60.0), base * pick(threat, THREAT_SPEED, 1.0))


def fade(last_seen: Column, now: Column, level: Column, threat: Column) -> Column:
    """1 when just seen, falling with the square root of age to a floor."""
    age = seconds(now, last_seen)
    share = F.least(F.lit(1.0), age / fade_window(level, threat))
    return F.when(age <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(FADE_FLOOR), F.lit(1.0) - F.sqrt(share)))


def status(resolved_at: Column, last_seen: Column, now: Column) -> Column:
    idle = seconds(now, last_seen)
    closed = resolved_at.isNotNull() | (idle > CLOSE_AFTER_SECONDS)
    return F.when(closed, "resolved").when(idle > FADE_AFTER_SECONDS, "fading").otherwise("active")


def band_ceiling(severity: Column) -> Column:
    out = None
    for top in SEVERITY_BANDS:
        out = F.when(severity <= top, F.lit(top)) if out is None else out.when(severity <= top, F.lit(top))
    return out.otherwise(F.lit(SEVERITY_BANDS[-1]))


def boosted(severity: Column, official: Column, crowd: Column) -> Column:
    """One step up for an official source, one for a crowd, never above the band."""
    top = band_ceiling(severity)
    one = F.when(official, F.least(severity + 1, top)).otherwise(severity)
    return F.when(crowd, F.least(one + 1, top)).otherwise(one)


def km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance at 111 km a degree."""
    dx = (lon2 - lon1) * 111.0 * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(dx * dx + (lat2 - lat1) * 111.0 * (lat2 - lat1) * 111.0)


#: The same in SQL, for the oracle.
def fade_sql(last_seen: str, now: str, level: str, threat: str) -> str:
    age = f"((epoch_us({now}) - epoch_us({last_seen})) / 1e6)"
    base = f"(CASE {level} WHEN 'place' THEN 1200.0 WHEN 'region' THEN 9900.0 ELSE 2100.0 END)"
    speed = f"(CASE {threat} WHEN 'rocket' THEN 0.2 WHEN 'aviation' THEN 0.3 WHEN 'kab' THEN 0.4 WHEN 'bek' THEN 2.0 ELSE 1.0 END)"
    return f"(CASE WHEN {age} <= 0 THEN 1.0::DOUBLE ELSE greatest(0.12::DOUBLE, 1.0 - sqrt(least(1.0::DOUBLE, {age} / greatest(480.0::DOUBLE, {base}::DOUBLE * {speed})))) END)"


def km_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    dx = f"(({lon2} - {lon1}) * 111.0 * cos(radians(({lat1} + {lat2}) / 2)))"
    return f"sqrt({dx} * {dx} + ({lat2} - {lat1}) * 111.0 * ({lat2} - {lat1}) * 111.0)"
