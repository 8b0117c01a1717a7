"""The disclosure game: binding constraint, best response, coaching, populations and hash-drawn numbers.

The game's formulas are column expressions over any grid of parameters; ``generate``
plays it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import ARCHETYPES, COACHABILITY, HORIZON_DAYS, POPULATION


def constraint_at(days: Column, base: Column, dose: Column, horizon: float = HORIZON_DAYS) -> Column:
    """How binding the constraint is so many days before disclosure (0 without a date)."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(horizon), days.cast("double")))
    return F.when(days.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + dose * (1 - t / horizon))))


def best_response(theta: Column, c: Column, kappa: Column, delta: Column, adoption: Column) -> Column:
    """``struct(disclose, register, theta_held)`` of a speaker who holds ``theta`` under constraint ``c``."""
    d = kappa / (kappa + F.greatest(c, F.lit(1e-9)))
    held = theta * (1 - d)
    num = kappa * held
    den = num + 2 * delta * adoption
    register = F.when(den <= 1e-12, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), num / F.greatest(den, F.lit(1e-12)))))
    nothing = theta <= 1e-9
    return F.struct(
        F.when(nothing, F.lit(1.0)).otherwise(d).alias("disclose"),
        F.when(nothing, F.lit(0.0)).otherwise(register).alias("register"),
        F.when(nothing, F.lit(0.0)).otherwise(held).alias("theta_held"),
    )


def suppressed(value: Column, feature: str, adapted: Column, skill: Column) -> Column:
    return F.when(adapted, value * (1 - skill * COACHABILITY[feature])).otherwise(value)


def register_label(register: Column) -> Column:
    return F.when(register > 0.66, "hedged").when(register > 0.33, "mixed").otherwise("refusal")


def resolve_population(mix: dict[str, float] | None) -> dict[str, float]:
    """Weights that add up to one; unknown archetypes and non-positive totals are errors."""
    own = dict(mix or POPULATION)
    if unknown := sorted(set(own) - set(ARCHETYPES)):
        raise ValueError(f"unknown archetypes: {unknown}; known: {sorted(ARCHETYPES)}")
    total = sum(own.values())
    if total <= 0:
        raise ValueError("population weights must add up to more than zero")
    return {k: v / total for k, v in own.items()}


def parse_mix(text: Column) -> Column:
    """``a=0.6,b=0.4`` as ``map<string,double>``."""
    return F.transform_values(F.str_to_map(text, F.lit(","), F.lit("=")), lambda _, v: F.trim(v).cast("double"))


def allocate(mix: DataFrame, n: int) -> DataFrame:
    """Largest-remainder allocation of ``n`` seats over ``mix(ord, name, weight)``: adds ``seats``."""
    every = Window.partitionBy(F.lit(0))  # a handful of archetypes
    share = F.col("weight") / F.sum("weight").over(every) * n
    floored = mix.withColumn("_share", F.round(share, 9)).withColumn("_floor", F.floor("_share"))
    rest = floored.withColumn("_left", F.lit(n) - F.sum("_floor").over(every)).withColumn(
        "_place", F.row_number().over(every.orderBy(F.desc(F.round(F.col("_share") - F.col("_floor"), 9)), "ord"))
    )
    return rest.select(*mix.columns, (F.col("_floor") + (F.col("_place") <= F.col("_left")).cast("int")).cast("int").alias("seats"))


def uniform(*parts: Column | str | int) -> Column:
    """A draw in (0, 1) that is a hash of its coordinates."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    h = F.conv(F.substring(F.md5(F.concat_ws("-", *[c.cast("string") for c in cols])), 1, 12), 16, 10).cast("double")
    return (h + 0.5) / F.lit(float(1 << 48))


def normal(*parts: Column | str | int) -> Column:
    """A standard normal draw (Box-Muller over two hashes)."""
    return F.sqrt(-2 * F.log(uniform(*parts, "u"))) * F.cos(2 * 3.141592653589793 * uniform(*parts, "v"))


def _gamma_like(shape: float, scale: Column, *parts: Column | str | int) -> Column:
    """Gamma draw by the Wilson-Hilferty cube of a normal draw (distribution, not stream, is what matters)."""
    k = 1 / (9 * shape)
    return scale * shape * F.pow(F.greatest(F.lit(0.0), 1 - k + normal(*parts) * k**0.5), 3)


def outcome_class(move: Column, edge: float = 2.5) -> Column:
    return F.when(move < -edge, "miss").when(move > edge, "beat").when(move.isNotNull(), "inline")
