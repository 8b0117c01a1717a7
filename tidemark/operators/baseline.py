"""Confound removal, shrunken per-speaker baselines and multivariate anomalies.

Models are moments: every fit is one or two grouped aggregates, so a speaker of
any size is summed map-side first.  Only the inverse of a speaker's covariance
(p x p) needs numpy, on one row for each speaker.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RIDGE = 1e-6
# First-version composite.
V0_WEIGHTS = {
    "specificity_avoidance": 0.30, "hedging": 0.25, "topic_deflection": 0.20, "pronoun_distancing": 0.15, "confidence_language": 0.10,
}
V0_FLOOR = 0.12


# ------------------------------------------------------------- confounds


def keys_of(speaker: str | list[str]) -> list[str]:
    return [speaker] if isinstance(speaker, str) else list(speaker)


def _with_aggregate(df: DataFrame, aggregates: list[Column], world: list[str]) -> DataFrame:
    """``df`` plus aggregates over the table (one row, broadcast) or over each world."""
    if not world:
        return df.crossJoin(F.broadcast(df.agg(*aggregates)))
    return df.join(df.groupBy(*world).agg(*aggregates), world)


def standardised(df: DataFrame, columns: dict[str, Column], floor: float = 1e-6, world: list[str] | None = None) -> DataFrame:
    """``df`` plus centred and scaled columns: one scalar aggregate (of each world) joined back, no global window."""
    shape = [*[F.avg(c).alias(f"_m_{n}") for n, c in columns.items()], *[F.stddev_pop(c).alias(f"_s_{n}") for n, c in columns.items()]]
    z = [((c - F.col(f"_m_{n}")) / F.greatest(F.col(f"_s_{n}"), F.lit(floor))).alias(n) for n, c in columns.items()]
    return _with_aggregate(df, shape, world or []).select(*df.columns, *z)


def confound_sums(features: list[str]) -> list[Column]:
    """Sums of the normal equations over centred regressors ``x1`` and ``x2``."""
    return [
        F.count("*").alias("n"),
        F.sum(F.col("x1") * F.col("x1")).alias("a"),
        F.sum(F.col("x1") * F.col("x2")).alias("b"),
        F.sum(F.col("x2") * F.col("x2")).alias("d"),
        *[F.sum(F.col(f)).alias(f"y_{f}") for f in features],
        *[F.sum(F.col("x1") * F.col(f)).alias(f"p_{f}") for f in features],
        *[F.sum(F.col("x2") * F.col(f)).alias(f"q_{f}") for f in features],
    ]


def confound_fit(sums: DataFrame, features: list[str], world: list[str] | None = None) -> DataFrame:
    """Coefficients ``b0_f, b1_f, b2_f`` and ``mean_f`` from the sums, one row (of each world)."""
    a, d, b = F.col("a") + RIDGE, F.col("d") + RIDGE, F.col("b")
    det = a * d - b * b
    return sums.select(
        *(world or []),
        *[(F.col(f"y_{f}") / (F.col("n") + RIDGE)).alias(f"b0_{f}") for f in features],
        *[((d * F.col(f"p_{f}") - b * F.col(f"q_{f}")) / det).alias(f"b1_{f}") for f in features],
        *[((a * F.col(f"q_{f}") - b * F.col(f"p_{f}")) / det).alias(f"b2_{f}") for f in features],
        *[(F.col(f"y_{f}") / F.col("n")).alias(f"mean_{f}") for f in features],
    )


def log_words(words: str = "words") -> Column:
    return F.log(F.greatest(F.col(words), F.lit(1)))


def residualise(df: DataFrame, features: list[str], words: str = "words", t: str = "t", world: list[str] | None = None) -> DataFrame:
    """Remove length and time from each feature: ridge regression on [1, z(log words), z(t)], residual plus mean.

    The regressors are centred, so the normal equations fall into a scalar and a
    2 x 2 block that is solved in closed form from sums (of each world).
    """
    world = world or []
    design = standardised(df, {"x1": log_words(words), "x2": F.col(t)}, world=world)
    sums = (design.groupBy(*world) if world else design).agg(*confound_sums(features))
    beta = confound_fit(sums, features, world)
    resid = [
        (
            F.col(f) - (F.col(f"b0_{f}") + F.col(f"b1_{f}") * F.col("x1") + F.col(f"b2_{f}") * F.col("x2")) + F.col(f"mean_{f}")
        ).alias(f"resid_{f}")
        for f in features
    ]
    joined = design.join(beta, world) if world else design.crossJoin(F.broadcast(beta))
    return joined.select(*df.columns, *resid)


def variance_explained(residuals: DataFrame, features: list[str]) -> DataFrame:
    """Share of each feature's variance that the confounds explain, one row for each feature."""
    shares = [
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.var_pop(f"resid_{f}") / F.greatest(F.var_pop(f), F.lit(1e-9)))).alias(f)
        for f in features
    ]
    return residuals.agg(*shares).select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("explained")) for f in features])).alias("s")
    ).select("s.*")


# ------------------------------------------------------- first version (v0)


def v0_baseline(scored: DataFrame, speaker: str, features: list[str], is_baseline: Column) -> DataFrame:
    """Mean and floored sample deviation of each feature, four decimals; speakers with two baseline rows at least."""
    return (
        scored.where(is_baseline)
        .groupBy(speaker)
        .agg(
            F.count("*").alias("n_base"),
            # A hair above the mean: exact ties then round up whatever the order of the sum.
            *[F.round(F.avg(f) + 1e-9, 4).alias(f"mean_{f}") for f in features],
            *[F.round(F.greatest(F.stddev_samp(f), F.lit(V0_FLOOR)), 4).alias(f"sd_{f}") for f in features],
        )
        .where("n_base >= 2")
    )


def v0_divergence(scored: DataFrame, speaker: str, features: dict[str, float], is_baseline: Column) -> DataFrame:
    """Constrained rows against their speaker's v0 baseline: z (three decimals) and weighted composite."""
    base = v0_baseline(scored, speaker, list(features), is_baseline)
    z = {f: F.round((F.col(f) - F.col(f"mean_{f}")) / F.col(f"sd_{f}"), 3) for f in features}
    composite = reduce(lambda x, y: x + y, (F.lit(w) * z[f] for f, w in features.items()))
    return scored.where(~is_baseline).join(base, speaker).select(
        *scored.columns, *[c.alias(f"z_{f}") for f, c in z.items()], F.round(composite, 3).alias("composite")
    )


# -------------------------------------------------------------- baselines


def speaker_moments(rows: DataFrame, speaker: str | list[str], features: list[str], min_n: int = 2) -> DataFrame:
    """Per speaker: n, means, sample variances, and the Ledoit-Wolf pieces, in two grouped aggregates.

    ``S`` is the covariance with divisor n; ``q`` is the sum over rows of the
    squared norm squared of the centred row.
    """
    keys = keys_of(speaker)
    first = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(f).alias(f"m_{f}") for f in features]).where(F.col("n") >= min_n)
    centred = rows.join(first, keys).select(*keys, "n", *[f"m_{f}" for f in features], *[(F.col(f) - F.col(f"m_{f}")).alias(f"c_{f}") for f in features])
    norm = reduce(lambda x, y: x + y, (F.col(f"c_{f}") * F.col(f"c_{f}") for f in features))
    pairs = list(combinations_with_replacement(features, 2))
    return centred.groupBy(*keys, "n", *[f"m_{f}" for f in features]).agg(
        *[F.avg(F.col(f"c_{a}") * F.col(f"c_{b}")).alias(f"s_{a}_{b}") for a, b in pairs], F.sum(norm * norm).alias("q")
    )


def shrink_intensity(n: Column, p: int, trace: Column, square: Column, q: Column) -> Column:
    """Ledoit-Wolf intensity from the trace and squared Frobenius norm of S and the fourth-moment sum q."""
    mu = trace / p
    delta = (square - 2 * mu * trace + p * mu * mu) / p
    beta = (q / n - square) / (p * n)
    return F.when(beta <= 0, F.lit(0.0)).otherwise(F.least(beta, delta) / F.greatest(delta, F.lit(1e-300)))


def covariances(moments: DataFrame, speaker: str | list[str], features: list[str]) -> DataFrame:
    """Shrunken covariance of each speaker as ``cov_<a>_<b>`` plus ``intensity``.

    Under three rows: the diagonal of the variances (divisor n, at least 1e-3), intensity 1.
    """
    p = len(features)
    key = lambda a, b: f"s_{a}_{b}" if features.index(a) <= features.index(b) else f"s_{b}_{a}"
    trace = reduce(lambda x, y: x + y, (F.col(key(f, f)) for f in features))
    square = reduce(lambda x, y: x + y, (F.col(key(a, b)) * F.col(key(a, b)) for a in features for b in features))
    base = moments.withColumn("_trace", trace).withColumn("_s", shrink_intensity(F.col("n"), p, trace, square, F.col("q")))
    few = F.col("n") < 3
    out = []
    for a, b in combinations_with_replacement(features, 2):
        s = F.col(key(a, b))
        full = (1 - F.col("_s")) * s + (F.col("_s") * F.col("_trace") / p + 1e-4 if a == b else F.lit(0.0))
        out.append(F.when(few, F.greatest(s, F.lit(1e-3)) if a == b else F.lit(0.0)).otherwise(full).alias(f"cov_{a}_{b}"))
    return base.select(*keys_of(speaker), "n", *[f"m_{f}" for f in features], *[f"s_{f}_{f}" for f in features], *out, F.when(few, F.lit(1.0)).otherwise(F.col("_s")).alias("intensity"))


def shrunken_means(cov: DataFrame, speaker: str | list[str], features: list[str]) -> DataFrame:
    """Empirical-Bayes means: one weight for each speaker between its own mean and the mean of speaker means (of its world)."""
    unbiased = lambda f: F.col(f"s_{f}_{f}") * F.col("n") / (F.col("n") - 1)
    pop = [
        *[F.avg(f"m_{f}").alias(f"pop_{f}") for f in features],
        *[F.coalesce(F.var_samp(f"m_{f}"), F.lit(1.0)).alias(f"between_{f}") for f in features],
        *[F.avg(unbiased(f)).alias(f"within_{f}") for f in features],
    ]
    joined = _with_aggregate(cov, pop, keys_of(speaker)[:-1])
    each = []
    for f in features:
        noise = F.col(f"within_{f}") / F.col("n")
        tau = F.greatest(F.col(f"between_{f}") - noise, F.lit(1e-6))
        each.append(tau / (tau + noise))
    weight = reduce(lambda x, y: x + y, each) / len(features)
    held = joined.withColumn("weight", F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight)))
    return held.select(
        *[c for c in cov.columns if not c.startswith("s_")],
        *[(F.col("weight") * F.col(f"m_{f}") + (1 - F.col("weight")) * F.col(f"pop_{f}")).alias(f"mean_{f}") for f in features],
        "weight",
        F.round(1 - F.col("weight"), 3).alias("mean_shrinkage"),
    )


def fit_baselines(rows: DataFrame, speaker: str | list[str], features: list[str], min_n: int = 2) -> DataFrame:
    """One row for each speaker: shrunken mean, covariance, and (row-major) precision and its Cholesky factor.

    The p x p inverses run in numpy, stacked, on the already aggregated rows; for
    two features they are column expressions.
    """
    means = shrunken_means(covariances(speaker_moments(rows, speaker, features, min_n), speaker, features), speaker, features)
    p = len(features)
    if p == 2:
        a, b, d = (F.col(f"cov_{x}_{y}") for x, y in combinations_with_replacement(features, 2))
        det = a * d - b * b
        top = F.sqrt(d / det)
        zero = F.lit(0.0)
        return means.select(
            "*",
            F.array(d / det, -b / det, -b / det, a / det).alias("precision"),
            F.array(top, zero, -b / det / top, F.sqrt(a / det - b * b / det / det / (d / det))).alias("factor"),
            F.array(F.sqrt(a), F.sqrt(d)).alias("deviation"),
        )

    def invert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            c = np.zeros((len(frame), p, p))
            for i, j in combinations_with_replacement(range(p), 2):
                c[:, i, j] = c[:, j, i] = frame[f"cov_{features[i]}_{features[j]}"].to_numpy(float)
            inverse = np.linalg.pinv(c)
            try:
                lower = np.linalg.cholesky(inverse)
            except np.linalg.LinAlgError:  # of one of them: factor each by itself
                lower = np.full_like(inverse, np.nan)
                for i, m in enumerate(inverse):
                    if np.linalg.eigvalsh(m)[0] > 0:
                        lower[i] = np.linalg.cholesky(m)
            deviation = np.sqrt(np.diagonal(c, axis1=1, axis2=2))
            yield frame.assign(precision=list(inverse.reshape(-1, p * p)), factor=list(lower.reshape(-1, p * p)), deviation=list(deviation))

    extra = "precision array<double>, factor array<double>, deviation array<double>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in means.schema.fields) + ", " + extra
    return means.mapInPandas(invert, schema)


# ---------------------------------------------------------------- anomaly


def _terms(xs: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, xs)


def erfc(x: Column, points: int = 64) -> Column:
    """Complementary error function of ``x >= 0``: the mean of exp(-(x / sin)^2) over a quarter turn (Craig's form).

    The integrand is smooth and periodic, so the midpoint rule converges faster than any power.
    """
    sines = F.array(*[F.lit(float(np.sin((i + 0.5) * np.pi / 2 / points) ** 2)) for i in range(points)])
    return F.aggregate(sines, F.lit(0.0), lambda s, q: s + F.exp(-x * x / q)) / points


def chi2_tail(d2: Column, k: int) -> Column:
    """Upper tail of the chi-squared distribution: by steps of two from exp(-h) (even k) or erfc(sqrt(h)) (odd k), h = d2/2."""
    h = d2 / 2
    if k % 2 == 0:
        term, total = F.lit(1.0), F.lit(1.0)
        for i in range(1, k // 2):
            term = term * h / i
            total = total + term
        return F.exp(-h) * total
    total = erfc(F.sqrt(h))
    for i in range(1, (k - 1) // 2 + 1):
        total = total + F.pow(h, i - 0.5) * F.exp(-h) / math.gamma(i + 0.5)
    return total


def anomalies(rows: DataFrame, baselines: DataFrame, speaker: str | list[str], features: list[str], direction: tuple[float, ...] | None = None) -> DataFrame:
    """Rows of speakers with a baseline: Mahalanobis distance, tail, percentile, z, attribution, dominant feature,
    and the signed projection on ``direction``.

    Attribution are the shares of the whitened squares in feature order.
    """
    p = len(features)
    at = lambda m, i, j: F.element_at(m, i * p + j + 1)
    keys = keys_of(speaker)
    joined = rows.join(baselines.select(*keys, *[f"mean_{f}" for f in features], "precision", "factor", "deviation"), keys)
    d = joined.select(*rows.columns, *[(F.col(f) - F.col(f"mean_{f}")).alias(f"_d{i}") for i, f in enumerate(features)], "precision", "factor", "deviation")
    ds = [F.col(f"_d{i}") for i in range(p)]
    d2 = _terms([ds[i] * at(F.col("precision"), i, j) * ds[j] for i in range(p) for j in range(p)])
    white = [_terms([at(F.col("factor"), j, i) * ds[j] for j in range(p)]) for i in range(p)]
    scored = d.withColumn("d2", F.greatest(d2, F.lit(0.0))).withColumns({f"_w{i}": w * w for i, w in enumerate(white)})
    total = _terms([F.col(f"_w{i}") for i in range(p)])
    # Without a Cholesky factor the diagonal of the precision decides.
    plain = [ds[i] * ds[i] * at(F.col("precision"), i, i) for i in range(p)]
    usable = ~F.isnan(total)
    shares = [
        F.when(usable, F.when(total > 0, F.col(f"_w{i}") / total).otherwise(F.lit(0.0))).otherwise(
            F.when(_terms(plain) > 0, plain[i] / _terms(plain)).otherwise(F.lit(0.0))
        )
        for i in range(p)
    ]
    out = scored.select(
        *rows.columns,
        "d2",
        F.sqrt("d2").alias("mahalanobis"),
        chi2_tail(F.col("d2"), p).alias("p_chi2"),
        *[(ds[i] / F.greatest(F.element_at("deviation", i + 1), F.lit(1e-6))).alias(f"z_{f}") for i, f in enumerate(features)],
        *[s.alias(f"attribution_{f}") for s, f in zip(shares, features, strict=True)],
        *([_projection(ds, direction, at, p).alias("projection")] if direction else []),
    )
    array = F.array(*[F.col(f"attribution_{f}") for f in features])
    named = F.array(*[F.lit(f) for f in features])
    out = out.withColumn("dominant_feature", F.element_at(named, F.array_position(array, F.array_max(array)).cast("int")))
    return out.withColumn("percentile", 100 * (1 - F.col("p_chi2")))


def _projection(ds: list[Column], v: tuple[float, ...], at, p: int) -> Column:
    pv = [_terms([at(F.col("precision"), i, j) * F.lit(v[j]) for j in range(p)]) for i in range(p)]
    length = _terms([F.lit(v[i]) * pv[i] for i in range(p)])
    return F.when(length > 0, _terms([ds[i] * pv[i] for i in range(p)]) / F.sqrt(length)).otherwise(F.lit(0.0))


def representative(rows: DataFrame, baselines: DataFrame, speaker: str, features: list[str], order: str, means: list[str] | None = None) -> DataFrame:
    """The row of each speaker that is closest to its baseline mean in units of its deviations.

    ``means`` names the baseline's features where they differ from the rows' (raw
    scores against means in residual space).
    """
    named = means or features
    joined = rows.join(baselines.select(speaker, *[f"mean_{f}" for f in named], "deviation"), speaker)
    scale = [F.greatest(F.element_at("deviation", i + 1), F.lit(1e-6)) for i in range(len(named))]
    distance = _terms([F.pow((F.col(f) - F.col(f"mean_{m}")) / d, 2) for f, m, d in zip(features, named, scale, strict=True)])
    return joined.groupBy(speaker).agg(F.min_by(order, F.struct(F.round(distance, 9), F.col(order))).alias(order), F.round(F.min(distance), 4).alias("distance"))
