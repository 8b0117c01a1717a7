"""Studies over measured or simulated windows: power, ablation, gradients, flags, posteriors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .validate import auc, average_ranks, block_correlations, permutation_test


def binned_mean(df: DataFrame, x: str, y: str, edges: tuple[float, ...]) -> DataFrame:
    """Mean of ``y`` in half-open bins of ``x``; empty bins stay, values outside all bins drop out."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, lo double, hi double")
    place = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        place = F.when((F.col(x) >= edges[i]) & (F.col(x) < edges[i + 1]), i).otherwise(place)
    sums = df.groupBy(place.alias("bin")).agg(F.count(y).alias("n"), F.avg(y).alias("mean"))
    return bins.join(F.broadcast(sums), "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), "mean")


def within_speaker_rho(df: DataFrame, speaker: str, x: str, y: str, min_n: int = 3) -> DataFrame:
    """Spearman correlation inside each speaker with enough rows and variation in both columns."""
    ranked = average_ranks(average_ranks(df.select(speaker, x, y), x, "_rx", [speaker]), y, "_ry", [speaker])
    return (
        ranked.groupBy(speaker)
        .agg(F.count("*").alias("n"), F.stddev_pop(x).alias("_sx"), F.stddev_pop(y).alias("_sy"), F.corr("_rx", "_ry").alias("rho"))
        .where((F.col("n") >= min_n) & (F.col("_sx") > 1e-9) & (F.col("_sy") > 1e-9))
        .select(speaker, "n", "rho")
    )


def dose_response(df: DataFrame, speaker: str, row_id: str, x: str, days: str, n_perm: int = 4000, seed: int = 11, min_rows: int = 10) -> DataFrame:
    """Correlation of ``x`` with nearness: the median within speakers (one-sided) and the pooled one (two-sided).

    Both are tested against shuffles of the days inside each speaker.  Speakers
    take part in the median with three rows and variation in both columns.
    Under ``min_rows`` rows, or without variation of the days, the status is
    ``insufficient_variation``.  Correlations come from sums by (replicate,
    speaker), so no replicate is ever one task's list.
    """
    held = df.where(F.col(x).isNotNull() & F.col(days).isNotNull()).withColumn("_near", -F.col(days))
    enough = within_speaker_rho(held, speaker, x, "_near")
    shape = held.agg(F.count("*").alias("n"), F.coalesce(F.stddev_pop(days), F.lit(0.0)).alias("_sd"))
    observed = enough.agg(F.median("rho").alias("observed"), F.count("*").alias("n_speakers"), F.avg((F.col("rho") > 1e-12).cast("double")).alias("share_positive"))
    own = held.join(enough.select(speaker), speaker, "left_semi")
    ranked = average_ranks(average_ranks(own, x, "_rx", [speaker]), "_near", "_ry", [speaker]).select(speaker, row_id, "_rx", "_ry")
    null = block_correlations(ranked, "_rx", "_ry", row_id, n_perm, [speaker], seed).groupBy("_perm").agg(F.median("rho").alias("s"))
    within = (
        null.crossJoin(F.broadcast(observed))
        .groupBy("observed", "n_speakers", "share_positive")
        .agg(((F.count_if(F.col("s") >= F.col("observed") - 1e-12) + 1) / (F.count("*") + 1)).cast("double").alias("p_within"), F.count("*").alias("n_perm"))
    )
    pooled = permutation_test(held, x, "_near", row_id, n_perm, speaker).select(F.col("observed").alias("rho_pooled"), F.col("p_value").alias("p_pooled"))
    status = F.when((F.col("n") < min_rows) | (F.col("_sd") < 1e-9), "insufficient_variation").otherwise("ok")
    return shape.crossJoin(F.broadcast(pooled)).crossJoin(F.broadcast(within)).withColumn("status", status).drop("_sd")


def flag_rates(df: DataFrame, group: str, score: str, threshold: float, truth: Column) -> DataFrame:
    """Share flagged by group, of rows that hold something and rows that do not."""
    hit = (F.col(score) >= threshold).cast("double")
    return df.groupBy(group).agg(
        F.count("*").alias("n"), F.avg(hit).alias("flag_rate"), F.avg(F.when(truth, hit)).alias("true_rate"), F.avg(F.when(~truth, hit)).alias("false_rate")
    )


def matched_budget(df: DataFrame, a: str, b: str, budget: float, truth: Column) -> DataFrame:
    """Two scores at thresholds that raise the same share of alarms: precision and recall of each."""
    cut = df.agg(F.percentile(a, F.lit(1 - budget)).alias("_a"), F.percentile(b, F.lit(1 - budget)).alias("_b"))
    out = []
    for name, s, t in (("a", a, "_a"), ("b", b, "_b")):
        hit = F.col(s) >= F.col(t)
        out += [
            F.count_if(hit).alias(f"alarms_{name}"),
            F.try_divide(F.count_if(hit & truth).cast("double"), F.count_if(hit)).alias(f"precision_{name}"),
            F.try_divide(F.count_if(hit & truth).cast("double"), F.count_if(truth)).alias(f"recall_{name}"),
        ]
    return df.crossJoin(F.broadcast(cut)).agg(*out)


def subsamples(speakers: DataFrame, speaker: str, sizes: tuple[int, ...], draws: int, seed: int = 3) -> DataFrame:
    """``(size, draw, speaker)``: speakers drawn without replacement, the same under any partitioning."""
    spark = speakers.sparkSession
    grid = spark.createDataFrame([(k,) for k in sizes], "size int").crossJoin(spark.range(draws).withColumnRenamed("id", "draw"))
    order = Window.partitionBy("size", "draw").orderBy(F.md5(F.concat_ws("-", F.col("size"), F.col("draw"), F.col(speaker).cast("string"), F.lit(str(seed)))), speaker)
    return speakers.select(speaker).distinct().crossJoin(F.broadcast(grid)).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= F.col("size")).select("size", "draw", speaker)


def power_curve(
    df: DataFrame, speaker: str, row_id: str, score: str, label: str, sizes: tuple[int, ...], draws: int, n_perm: int = 1200, seed: int = 3, min_rows: int = 6
) -> DataFrame:
    """AUC over subsampled speakers: mean, 10 and 90 % points, median p of the blocked permutation test, and power at 0.05.

    Draws with under ``min_rows`` rows or with one class are left out.  All draws
    of all sizes are tested in one plan.
    """
    picked = subsamples(df.select(speaker).distinct(), speaker, sizes, draws, seed)
    rows = picked.join(df.select(speaker, row_id, score, F.col(label).cast("double").alias("_y")), speaker)
    key = ["size", "draw"]
    classes = rows.groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct("_y").alias("_k")).where((F.col("n") >= min_rows) & (F.col("_k") > 1))
    rows = rows.join(classes.select(*key, "n"), key)
    each = auc(rows.withColumn("_l", F.col("_y").cast("int")), score, "_l", key).select(*key, "auc")
    tested = permutation_test(rows, score, "_y", row_id, n_perm, speaker, groups=key).select(*key, "p_value")
    return (
        each.join(tested, key)
        .join(classes, key)
        .groupBy("size")
        .agg(
            F.count("*").alias("draws"),
            F.median("n").cast("int").alias("median_n"),
            F.avg("auc").alias("auc_mean"),
            F.percentile("auc", F.lit(0.1)).alias("auc_q10"),
            F.percentile("auc", F.lit(0.9)).alias("auc_q90"),
            F.median("p_value").alias("median_p"),
            F.avg((F.col("p_value") < 0.05).cast("double")).alias("power"),
        )
    )


def speakers_needed(curve: DataFrame, target: float = 0.8) -> DataFrame:
    """Speakers for the target power from a line of power on the root of the size."""
    x = F.sqrt(F.col("size"))
    fit = curve.agg(
        F.count("*").alias("points"), F.max("power").alias("top"), F.regr_slope("power", x).alias("slope"), F.regr_intercept("power", x).alias("intercept")
    )
    status = (
        F.when(F.col("points") < 3, "insufficient_points").when(F.col("top") < 0.02, "no_power").when(F.coalesce("slope", F.lit(0.0)) <= 0, "power_not_increasing").otherwise("ok")
    )
    return fit.withColumn("status", status).withColumn(
        "needed", F.when(F.col("status") == "ok", F.ceil(F.pow((target - F.col("intercept")) / F.col("slope"), 2)).cast("long"))
    )


def nearest(reference: DataFrame, features: list[str], observed: dict[str, float], k: int, row_id: str) -> DataFrame:
    """The ``k`` reference rows nearest to the observed point in scaled space, with Epanechnikov weights."""
    scale = reference.agg(*[F.greatest(F.stddev_pop(f), F.lit(1e-9)).alias(f"_s_{f}") for f in features])
    d2 = F.lit(0.0)
    for f in features:
        d2 = d2 + F.pow((F.col(f) - F.lit(float(observed.get(f, 0.0)))) / F.col(f"_s_{f}"), 2)
    kept = reference.crossJoin(F.broadcast(scale)).withColumn("d", F.sqrt(d2)).drop(*[f"_s_{f}" for f in features]).orderBy("d", row_id).limit(k)
    h = kept.agg(F.max("d").alias("_h"))
    weight = F.greatest(F.lit(1e-9), 1 - F.pow(F.col("d") / F.when(F.col("_h") > 1e-9, F.col("_h")).otherwise(1.0), 2))
    weighted = kept.crossJoin(F.broadcast(h)).withColumn("w", weight).drop("_h")
    return weighted.crossJoin(F.broadcast(weighted.agg(F.sum("w").alias("_t")))).withColumn("w", F.col("w") / F.col("_t")).drop("_t")


def weighted_quantiles(df: DataFrame, value: str, weight: str, order: str, at: tuple[float, ...]) -> DataFrame:
    """Quantiles by linear interpolation on the cumulative weight (``df`` is the bounded set of nearest rows)."""
    every = Window.partitionBy(F.lit(0))
    c = F.sum(weight).over(every.orderBy(value, order).rowsBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(every)
    steps = df.select(F.col(value).alias("v"), c.alias("c"), F.col(order).alias("o"))
    before = steps.withColumn("v0", F.lag("v").over(every.orderBy("c", "v", "o"))).withColumn("c0", F.lag("c").over(every.orderBy("c", "v", "o")))
    out = []
    for q in at:
        value_at = F.when(F.col("c0").isNull(), F.col("v")).otherwise(
            F.col("v0") + (F.col("v") - F.col("v0")) * (q - F.col("c0")) / F.greatest(F.col("c") - F.col("c0"), F.lit(1e-300))
        )
        # The first step that reaches q; beyond the last step, its value.
        out.append(F.coalesce(F.min_by(value_at, F.when(F.col("c") >= q, F.struct("c", "v", "o"))), F.max("v")).alias(f"q{round(q * 100)}"))
    return before.agg(*out)


def histogram(df: DataFrame, value: str, bins: int, lo: float, hi: float) -> DataFrame:
    """Equal-width histogram over ``[lo, hi]``, the last bin closed, values outside dropped, empty bins kept."""
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (hi - lo) / bins
    place = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).between(lo, hi)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    joined = spine.join(F.broadcast(counts), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = joined.agg(F.greatest(F.sum("n"), F.lit(1)).alias("_t"))
    return joined.crossJoin(F.broadcast(total)).select("bin", (lo + F.col("bin") * width).alias("lo"), (lo + (F.col("bin") + 1) * width).alias("hi"), "n", (F.col("n") / F.col("_t")).alias("p"))


def ladder_delta(ladder: DataFrame, order: str, value: str) -> DataFrame:
    """Change of a value against the previous rung (a ladder has a handful of rungs)."""
    return ladder.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(F.lit(0)).orderBy(order)))


def verdict(retained: Column) -> Column:
    return F.when(retained > 1.15, "gains").when(retained >= 0.80, "holds").when(retained >= 0.55, "degrades").otherwise("collapses")
