"""Rating expressions as Columns: scales, titles, shrinkage, Elo steps. All stay in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rating system.
K_FACTOR, DEFAULT_ELO, ELO_SCALE = 32.0, 1200.0, 400.0
DISPLAY_MEAN, DISPLAY_SD, DISPLAY_MAX = 1500.0, 400.0, 3500.0
STRENGTH_SIGMA, STRENGTH_FLOOR_Z, STRENGTH_FLOOR = 6.0, -2.0, 0.7
#: Least rating of each title, highest first; below all of them: Beginner.
TITLES = [
    (2600, "SGM"), (2500, "GM"), (2400, "IM"), (2300, "FM"), (2200, "CM"),
    (2000, "Expert"), (1800, "Advanced"), (1600, "Intermediate"), (1400, "Novice"),
]
BEGINNER = "Beginner"


def fixed_round(c: Column, places: int) -> Column:
    """Half away from zero on the scaled binary value, as SQL engines without decimal text do."""
    return F.round(c) if places == 0 else F.round(c * 10.0**places) / 10.0**places


def to_int(c: Column) -> Column:
    """Nearest integer, halves to even."""
    return F.rint(c).cast("int")


def usable(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def clamp(c: Column, low: float, high: float) -> Column:
    """Null becomes low: least and greatest skip nulls."""
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def title(rating: Column) -> Column:
    out = F.when(rating >= TITLES[0][0], TITLES[0][1])
    for least, name in TITLES[1:]:
        out = out.when(rating >= least, name)
    return out.otherwise(BEGINNER)


def title_rank(rating: Column) -> Column:
    """1 for the highest title to 10; null for a null rating."""
    out = F.when(rating.isNull(), F.lit(None).cast("int"))
    for i, (least, _) in enumerate(TITLES):
        out = out.when(rating >= least, i + 1)
    return out.otherwise(len(TITLES) + 1)


def lower_title(a: Column, b: Column) -> Column:
    """The lower of two players' titles; an unknown player's is the lowest."""
    last = F.lit(len(TITLES) + 1)
    names = F.array(*[F.lit(name) for _, name in TITLES], F.lit(BEGINNER))
    return F.element_at(names, F.greatest(F.coalesce(title_rank(a), last), F.coalesce(title_rank(b), last)))


def shrunk(raw: Column, n: Column, anchor: float | Column | None, prior: float) -> Column:
    """Mean of n results of raw and `prior` results of the anchor; raw itself without an anchor or a prior."""
    if anchor is None or prior <= 0:
        return raw
    anchor = anchor if isinstance(anchor, Column) else F.lit(float(anchor))
    weighted = (n.cast("double") * raw + F.lit(float(prior)) * anchor) / F.nullif(n.cast("double") + F.lit(float(prior)), F.lit(0.0))
    return F.when(anchor.isNull(), raw).otherwise(weighted)


def zscore_chess(x: Column, mean: Column, sd: Column, places: int = 0) -> Column:
    """Population z-score on the display scale; the mean's place for an unknown or zero deviation."""
    scaled = clamp(fixed_round(F.lit(DISPLAY_MEAN) + (x.cast("double") - mean) / F.nullif(sd, F.lit(0.0)) * DISPLAY_SD, places), 0.0, DISPLAY_MAX)
    return F.when(sd.isNull() | (sd <= 0), F.lit(DISPLAY_MEAN)).otherwise(scaled)


def doubled_scale(x: Column, factor: float = 2.0) -> Column:
    """Fixed-factor display scale, to one decimal, halves to even."""
    return F.bround(clamp(clamp(x, -1000.0, 10000.0) * factor, 0.0, DISPLAY_MAX), 1)


def expected_score(own: Column, other: Column) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), F.least(F.greatest((other - own) / ELO_SCALE, F.lit(-10.0)), F.lit(10.0))))


def strength_scale(field_mean: Column) -> Column:
    """Damping of a step in a weak field: 1 at or above the mean, falling in proportion to 0.7 at two deviations below."""
    z = (field_mean - DEFAULT_ELO) / STRENGTH_SIGMA
    part = F.lit(STRENGTH_FLOOR) + (1.0 - STRENGTH_FLOOR) * (z - STRENGTH_FLOOR_Z) / -STRENGTH_FLOOR_Z
    return F.when(~usable(z) | (z >= 0), F.lit(1.0)).when(z <= STRENGTH_FLOOR_Z, F.lit(STRENGTH_FLOOR)).otherwise(part)


def elo_step(rating: Column, percentage: Column, field_mean: Column, scale: Column) -> Column:
    return rating + K_FACTOR * scale * (percentage / 100.0 - expected_score(rating, field_mean))


def pair_id(a: Column, b: Column, sep: str = "-") -> Column:
    """Two ids in text order; null if either is."""
    return F.when(a < b, F.concat(a, F.lit(sep), b)).otherwise(F.concat(b, F.lit(sep), a))


def pair_name(a: Column, b: Column, name_a: Column, name_b: Column) -> Column:
    return F.when(a <= b, F.concat(name_a, F.lit(" - "), name_b)).otherwise(F.concat(name_b, F.lit(" - "), name_a))


def mean_skill_z(metrics: list[tuple[Column, Column, Column]]) -> Column:
    """Mean of z-scores of (value, mean, deviation); null if any is null or has no deviation."""
    parts = [(x - mean) / F.nullif(sd, F.lit(0.0)) for x, mean, sd in metrics]
    return sum(parts[1:], parts[0]) / float(len(parts))


def rounded_mean(c: str | Column, places: int) -> Column:
    """Mean, first to nine places, so that the order of summing can't tip a half."""
    return fixed_round(fixed_round(F.avg(c), 9), places)
