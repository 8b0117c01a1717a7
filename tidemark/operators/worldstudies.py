"""Studies over many synthetic worlds at once: every world is scored by itself, all in one plan.

Results are keyed by ``grid`` (the point of the parameter grid); replicates
(``rep``) are summarised over.  Correlations with fewer rows than asked for, or
without variation, are null and left out of means.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import COACHABILITY, EVASION, FEATURES, FLAG_AT, MATERIAL_MOVE
from . import baseline as B
from . import scoring as P
from . import validate as S
from .lexical import Lexicon
from .lineage import cut
from .studies import verdict

WORLD = ["grid", "rep"]
_NORM = sum(w * w for w in EVASION) ** 0.5


def weighted(columns: Sequence[str], weights: Sequence[float], shown=F.col) -> Column:
    total = F.lit(0.0)
    for c, w in zip(columns, weights, strict=True):
        total = total + shown(c) * F.lit(float(w))
    return total


def score_worlds(statements: DataFrame, truth: Sequence[str] = (), lexicon: Lexicon | None = None) -> DataFrame:
    """Constrained statements of all worlds: ``evasion``, ``absolute`` (standardised over the world), ``z_<feature>`` and ``truth`` columns."""
    m = P.measure(statements, lexicon, WORLD)
    absolute = weighted(P.RESIDUALS, [w / _NORM for w in EVASION])
    z = B.standardised(m.rows.select(*WORLD, "id", absolute.alias("absolute_raw")), {"absolute": F.col("absolute_raw")}, 1e-9, WORLD)
    found = m.anomalies.select(*WORLD, "id", "speaker", "evasion", "mahalanobis", *[F.col(f"z_resid_{f}").alias(f"z_{f}") for f in FEATURES])
    hidden = statements.where("window = 'constrained'").select(*WORLD, "id", *truth)
    return cut(found.join(z.select(*WORLD, "id", "absolute", "absolute_raw"), [*WORLD, "id"]).join(hidden, [*WORLD, "id"]))


def rho(df: DataFrame, x: str, y: str, groups: list[str], out: str = "rho", min_n: int = 6) -> DataFrame:
    """``(*groups, out)``: Spearman correlation, null under ``min_n`` rows or without variation."""
    made = S.spearman(df, x, y, groups, 0)
    flat = df.groupBy(*groups).agg(F.stddev_pop(x).alias("_sx"), F.stddev_pop(y).alias("_sy"))
    some = (F.col("n") >= min_n) & (F.col("_sx") >= 1e-12) & (F.col("_sy") >= 1e-12)
    return made.join(flat, groups).select(*groups, F.when(some, F.col("rho")).alias(out))


def _large(scored: DataFrame, least: int = 8) -> DataFrame:
    """The worlds with enough scored windows."""
    return scored.groupBy(*WORLD).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*WORLD)


def _both_classes(auc: DataFrame) -> DataFrame:
    return auc.where("n_pos > 0 and n_neg > 0").select(*WORLD, "auc")


def adoption_sweep(scored: DataFrame) -> DataFrame:
    """By grid: correlation with what is held, area for material moves, register of those who hold something."""
    own = scored.join(_large(scored), WORLD, "left_semi").withColumn("y", (F.abs("outcome_move_pct") >= MATERIAL_MOVE).cast("int"))
    each = (
        rho(own, "evasion", "theta_held", WORLD)
        .join(_both_classes(S.auc(own, "evasion", "y", WORLD)), WORLD, "left")
        .join(own.groupBy(*WORLD).agg(F.avg(F.when(F.col("theta_held") > 1e-6, F.col("register"))).alias("register"), F.avg("theta_held").alias("held")), WORLD)
    )
    r4 = lambda c, name: F.round(c, 4).alias(name)
    return each.groupBy("grid").agg(
        r4(F.avg("rho"), "rho_held"), r4(F.stddev_pop("rho"), "rho_held_sd"), r4(F.avg("auc"), "auc_move"), r4(F.avg("register"), "mean_register"), r4(F.avg("held"), "mean_theta_held"), F.count("*").alias("n_reps")
    )


def feature_survival(scored: DataFrame, naive: int = 0, adapted: int = 1) -> DataFrame:
    """What each feature keeps of its correlation with held information between two grid points, most retained first (null as 0)."""
    own = scored.join(_large(scored), WORLD, "left_semi")
    long = own.select(*WORLD, "theta_held", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"z_{f}").alias("z")) for f in FEATURES])).alias("x")).select(*WORLD, "theta_held", "x.*")
    each = rho(long, "z", "theta_held", [*WORLD, "feature"])
    at = lambda g: F.avg(F.when(F.col("grid") == g, F.abs("rho")))
    both = each.groupBy("feature").agg(at(naive).alias("rho_naive"), at(adapted).alias("rho_adapted"))
    kept = F.when(F.col("rho_naive") > 1e-6, F.col("rho_adapted") / F.col("rho_naive"))
    coached = F.create_map(*[F.lit(x) for k, v in COACHABILITY.items() for x in (k, v)])
    return (
        both.withColumn("_kept", kept)
        .select(
            "feature",
            coached[F.col("feature")].alias("coachability"),
            F.round("rho_naive", 4).alias("rho_naive"),
            F.round("rho_adapted", 4).alias("rho_adapted"),
            F.round("_kept", 4).alias("retained"),
            F.when(F.col("_kept").isNotNull(), verdict(F.col("_kept"))).alias("verdict"),
        )
        .orderBy(F.desc(F.coalesce("retained", F.lit(0.0))), "feature")
    )


def archetype_rates(scored: DataFrame, threshold: float = FLAG_AT) -> DataFrame:
    """By grid and archetype: how many are flagged against themselves and against everybody, most flagged first."""
    holds = F.col("theta_held") > 1e-9
    rate = lambda c: F.round(F.avg((F.col(c) >= threshold).cast("double")), 4)
    made = scored.groupBy("grid", "archetype").agg(
        F.count("*").alias("n_windows"),
        F.max(holds).alias("withholds"),
        F.round(F.avg(holds.cast("double")), 3).alias("frac_withholding"),
        F.round(F.avg("evasion"), 4).alias("mean_divergence"),
        rate("evasion").alias("flag_rate_relative"),
        rate("absolute").alias("flag_rate_absolute"),
    )
    false = lambda c: F.when(~F.col("withholds"), F.col(c))
    made = made.withColumn("false_positive_relative", false("flag_rate_relative")).withColumn("false_positive_absolute", false("flag_rate_absolute"))
    return made.orderBy("grid", F.desc("flag_rate_relative"), "archetype")


def archetype_summary(rates: DataFrame) -> DataFrame:
    """By grid: false and true positive rates as unweighted means over archetypes."""
    mean = lambda c: F.round(F.avg(c), 4)
    out = rates.groupBy("grid").agg(
        mean("false_positive_relative").alias("false_positive_relative"),
        mean("false_positive_absolute").alias("false_positive_absolute"),
        mean(F.when(F.col("withholds"), F.col("flag_rate_relative"))).alias("true_positive_relative"),
    )
    return out.withColumn("advantage", F.round(F.col("false_positive_absolute") - F.col("false_positive_relative"), 4))


def matched_alarms(scored: DataFrame, threshold: float = FLAG_AT) -> DataFrame:
    """By grid: both scores at thresholds that raise as many alarms as the relative one does at ``threshold``."""
    budget = scored.groupBy("grid").agg(F.avg((F.col("evasion") >= threshold).cast("double")).alias("budget"))
    # The quantile 1 - budget, interpolated: budgets differ by grid, so it is taken from the ranks.
    joined = scored.join(budget, "grid")
    cuts = budget
    for name in ("evasion", "absolute"):
        order = Window.partitionBy("grid").orderBy(name, "rep", "id")
        placed = joined.select("grid", "budget", F.col(name).alias("v"), (F.row_number().over(order) - 1).alias("i"), F.count("*").over(Window.partitionBy("grid")).alias("n"))
        at = (1 - F.col("budget")) * (F.col("n") - 1)
        low, high = F.max(F.when(F.col("i") == F.floor(at), F.col("v"))), F.max(F.when(F.col("i") == F.ceil(at), F.col("v")))
        part = F.max(at - F.floor(at))
        found = placed.groupBy("grid").agg((low + (high - low) * part).alias(f"t_{name}"))
        cuts = cuts.join(found, "grid")
    inside = (F.col("budget") > 0) & (F.col("budget") < 1)
    cuts = cuts.select("grid", "budget", *[F.when(inside, F.col(f"t_{n}")).otherwise(F.lit(threshold)).alias(f"t_{n}") for n in ("evasion", "absolute")])
    marked = scored.join(cuts, "grid")
    holds = F.col("theta_held") > 1e-9
    rate = lambda c, who: F.round(F.avg(F.when(who, (F.col(c) >= F.col(f"t_{c}")).cast("double"))), 4)
    return marked.groupBy("grid").agg(
        F.round(F.max("budget"), 4).alias("alarm_budget"),
        F.round(F.max("t_evasion"), 3).alias("threshold_relative"),
        F.round(F.max("t_absolute"), 3).alias("threshold_absolute"),
        rate("evasion", ~holds).alias("false_positive_relative"),
        rate("absolute", ~holds).alias("false_positive_absolute"),
        rate("evasion", holds).alias("true_positive_relative"),
        rate("absolute", holds).alias("true_positive_absolute"),
        F.count("*").alias("n_windows"),
    )


def design_grid(scored: DataFrame, n_perm: int = 1500, seed: int = 1040) -> DataFrame:
    """By grid: correlation of speakers' mean evasion with what they hold, and the power of a one-sided permutation test."""
    own = scored.join(_large(scored), WORLD, "left_semi")
    speakers = own.groupBy(*WORLD, "speaker").agg(F.avg("evasion").alias("e"), F.avg("theta_held").alias("h"))
    usable = speakers.groupBy(*WORLD).agg(F.count("*").alias("_n"), F.stddev_pop("e").alias("_se"), F.stddev_pop("h").alias("_sh")).where("_n >= 5 and _se >= 1e-9 and _sh >= 1e-9")
    kept = speakers.join(usable.select(*WORLD), WORLD, "left_semi")
    tested = S.permutation_test(kept, "e", "h", "speaker", n_perm, seed=seed, one_sided=True, groups=WORLD)
    return tested.groupBy("grid").agg(
        F.round(F.avg("observed"), 4).alias("rho_held"),
        F.round(F.median("p_value"), 4).alias("median_p"),
        F.round(F.avg((F.col("p_value") < 0.05).cast("double")), 3).alias("power_at_05"),
        F.count("*").alias("n_reps"),
    )


def scenario_summary(scored: DataFrame) -> DataFrame:
    """By grid: windows, share flagged, and the median over worlds of the correlation with what is held."""
    each = rho(scored, "evasion", "theta_held", WORLD).groupBy("grid").agg(F.round(F.median("rho"), 4).alias("median_rho"))
    shape = scored.groupBy("grid").agg(F.count("*").alias("n"), F.round(F.avg((F.col("evasion") >= FLAG_AT).cast("double")), 4).alias("flag_rate"))
    return shape.join(each, "grid")


# ------------------------------------------------------- planted effects


def recovery(scored: DataFrame) -> DataFrame:
    """By grid (planted effect): area for material moves over replicates."""
    own = scored.withColumn("y", (F.abs("outcome_move_pct") >= MATERIAL_MOVE).cast("int"))
    each = _both_classes(S.auc(own, "evasion", "y", WORLD))
    r4 = lambda c, name: F.round(c, 4).alias(name)
    return each.groupBy("grid").agg(r4(F.avg("auc"), "auc_mean"), r4(F.stddev_pop("auc"), "auc_sd"), r4(F.min("auc"), "auc_lo"), r4(F.max("auc"), "auc_hi"), F.count("*").alias("n_reps"))


def heterogeneity(scored: DataFrame) -> DataFrame:
    """By grid: correlation of the absolute and of the relative score with the planted effect."""
    own = scored.join(_large(scored), WORLD, "left_semi")
    each = rho(own, "absolute_raw", "true_effect", WORLD, "a", 3).join(rho(own, "evasion", "true_effect", WORLD, "r", 3), WORLD).where("a is not null and r is not null")
    r4 = lambda c, name: F.round(c, 4).alias(name)
    return each.groupBy("grid").agg(r4(F.avg("a"), "rho_absolute"), r4(F.avg("r"), "rho_baseline_relative"), r4(F.avg(F.col("r") - F.col("a")), "advantage"), F.count("*").alias("n_reps"))


def recovery_ranking(scored: DataFrame) -> DataFrame:
    """By world: Spearman between speakers' mean score and their planted effect."""
    speakers = scored.groupBy(*WORLD, "speaker").agg(F.avg("evasion").alias("e"), F.max("true_effect").alias("t"))
    n = speakers.groupBy(*WORLD).agg(F.count("*").alias("n_speakers"))
    return n.join(rho(speakers, "e", "t", WORLD, "r", 3), WORLD).select("grid", "rep", "n_speakers", F.round("r", 4).alias("spearman_recovered_vs_true"))


# --------------------------------------------------------------- ablation

RUNGS = ("absolute", "baseline_naive", "confounds", "shrinkage", "mahalanobis", "surprisal", "signed")


def ablation(statements: DataFrame, n_perm: int = 4000, lexicon: Lexicon | None = None) -> DataFrame:
    """The ladder of seven scores on one corpus: area, change, and the blocked permutation p of each rung.

    Surprisal takes part from rung six, confounds are removed from rung three.
    Constrained statements with a known move take part; speakers without a
    baseline score zero from rung two on (on rung one there is no baseline).
    """
    five = P.LEXICAL
    w5 = [EVASION[FEATURES.index(f)] for f in five]
    norm5, sum5 = sum(w * w for w in w5) ** 0.5, sum(w5)
    m = P.measure(statements, lexicon)
    outcomes = statements.select("id", "outcome_move_pct").where("outcome_move_pct is not null")
    rows = m.rows.where("window = 'constrained'").join(outcomes, "id").select("id", "speaker", *FEATURES, *P.RESIDUALS, (F.abs("outcome_move_pct") >= MATERIAL_MOVE).cast("int").alias("y"))
    resid5 = [f"resid_{f}" for f in five]

    def naive(columns: list[str]) -> DataFrame:
        base = m.rows.where("window = 'baseline'").groupBy("speaker").agg(
            F.count("*").alias("_n"), *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.greatest(F.stddev_samp(c), F.lit(0.12)).alias(f"_s_{c}") for c in columns]
        )
        z = weighted(columns, [w / sum5 for w in w5], lambda c: F.abs((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")))
        return rows.join(base.where("_n >= 2"), "speaker", "left").select("id", F.coalesce(z, F.lit(0.0)).alias("score"))

    base5 = B.fit_baselines(m.rows.where("window = 'baseline'"), "speaker", resid5)
    five_scored = B.anomalies(rows.select("id", "speaker", *resid5), base5, "speaker", resid5)
    zs = [f"z_{c}" for c in resid5]
    whole = m.anomalies.select("id", "mahalanobis", "evasion")
    zero = lambda found: rows.select("id").join(found, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
    ladder = {
        "absolute": rows.select("id", weighted(five, [w / norm5 for w in w5]).alias("score")),
        "baseline_naive": naive(five),
        "confounds": naive(resid5),
        "shrinkage": zero(five_scored.select("id", weighted(zs, [w / sum5 for w in w5], lambda c: F.abs(F.col(c))).alias("score"))),
        "mahalanobis": zero(five_scored.select("id", F.col("mahalanobis").alias("score"))),
        "surprisal": zero(whole.select("id", F.col("mahalanobis").alias("score"))),
        "signed": zero(whole.select("id", F.col("evasion").alias("score"))),
    }
    every = None
    for i, name in enumerate(RUNGS):
        one = ladder[name].select(F.lit(i).alias("rung"), F.lit(name).alias("level"), "id", "score")
        every = one if every is None else every.unionByName(one)
    scored = cut(every.join(rows.select("id", "speaker", "y"), "id"))
    key = ["rung", "level"]
    tested = S.permutation_test(scored.withColumn("yd", F.col("y").cast("double")), "score", "yd", "id", n_perm, "speaker", groups=key).select(*key, "p_value")
    areas = S.auc(scored, "score", "y", key).select(*key, (F.col("n_pos") + F.col("n_neg")).alias("n"), "auc")
    ladder_order = Window.partitionBy(F.lit(0)).orderBy("rung")  # seven rows
    return areas.join(tested, key).select(*key, F.round("auc", 4).alias("auc"), F.round(F.col("auc") - F.lag("auc").over(ladder_order), 4).alias("delta"), F.round("p_value", 6).alias("p_value"), "n")


# -------------------------------------------------------------- posterior


def reference_table(scored: DataFrame) -> DataFrame:
    """Simulated windows as a reference: features' z, evasion, held information and move, with the spread of each feature."""
    columns = [f"z_{f}" for f in FEATURES]
    named = scored.select(F.concat_ws("/", "grid", "rep", "id").alias("ref_id"), *columns, "evasion", "theta_held", F.col("outcome_move_pct").alias("move"))
    spread = named.agg(F.count("*").alias("_n"), *[F.greatest(F.stddev_pop(c), F.lit(1e-6)).alias(f"_s_{c}") for c in columns])
    return cut(named.crossJoin(F.broadcast(spread)))


def neighbours(observed: DataFrame, reference: DataFrame, row_id: str = "id", keep: float = 0.02, least: int = 40) -> DataFrame:
    """``(id, ref_id, d, w, theta_held, move)``: of every observed window the nearest reference rows with Epanechnikov weights.

    The reference is a simulated table of a chosen size and is broadcast; the
    observed windows stay where they are.  Missing features count as zero.
    """
    columns = [f"z_{f}" for f in FEATURES]
    own = observed.select(F.col(row_id).alias("id"), *[F.coalesce(c, F.lit(0.0)).alias(f"_o_{c}") for c in columns])
    d2 = F.lit(0.0)
    for c in columns:
        d2 = d2 + F.pow((F.col(c) - F.col(f"_o_{c}")) / F.col(f"_s_{c}"), 2)
    pairs = own.crossJoin(F.broadcast(reference)).select("id", "ref_id", "theta_held", "move", F.sqrt(d2).alias("d"), F.greatest(F.lit(least), F.floor(F.col("_n") * keep)).alias("_k"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("d", "ref_id"))
    kept = pairs.withColumn("_p", place).where(F.col("_p") <= F.col("_k"))
    own_rows = Window.partitionBy("id")
    h = F.max("d").over(own_rows)
    raw = F.greatest(F.lit(1e-9), 1 - F.pow(F.col("d") / F.when(h > 1e-9, h).otherwise(1.0), 2))
    weighted_rows = kept.withColumn("_w", raw)
    return weighted_rows.withColumn("w", F.col("_w") / F.sum("_w").over(own_rows)).select("id", "ref_id", "d", "w", "theta_held", "move")


def _quantiles(near: DataFrame, value: str, at: tuple[float, ...], prefix: str) -> DataFrame:
    """Weighted quantiles of each observed window by linear interpolation on the cumulative weight, null values left out."""
    rows = near.where(F.col(value).isNotNull())
    order = Window.partitionBy("id").orderBy(value, "ref_id")
    c = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(Window.partitionBy("id"))
    steps = rows.select("id", F.col(value).alias("v"), "ref_id", c.alias("c"))
    again = Window.partitionBy("id").orderBy("v", "ref_id")
    steps = steps.withColumn("v0", F.lag("v").over(again)).withColumn("c0", F.lag("c").over(again))
    out = []
    for q in at:
        here = F.when(F.col("c0").isNull(), F.col("v")).otherwise(F.col("v0") + (F.col("v") - F.col("v0")) * (q - F.col("c0")) / F.greatest(F.col("c") - F.col("c0"), F.lit(1e-300)))
        out.append(F.coalesce(F.min_by(here, F.when(F.col("c") >= q, F.struct("c", "v", "ref_id"))), F.max("v")).alias(f"{prefix}_q{round(q * 100)}"))
    return steps.groupBy("id").agg(*out)


def posterior(near: DataFrame, material: float = MATERIAL_MOVE) -> DataFrame:
    """By observed window: held information and move given the nearest simulated windows."""
    moved = F.col("move").isNotNull()
    shape = near.groupBy("id").agg(
        F.count("*").alias("n_matched"),
        F.round(F.avg("d"), 4).alias("match_quality"),
        F.round(F.sum(F.col("w") * F.col("theta_held")), 4).alias("theta_mean"),
        F.round(F.sum(F.when(F.col("theta_held") <= 1e-6, F.col("w")).otherwise(0.0)), 4).alias("p_nothing_withheld"),
        F.round(F.sum(F.when(moved & (F.abs("move") >= material), F.col("w")).when(moved, 0.0)), 4).alias("p_material_move"),
    )
    return shape.join(_quantiles(near, "theta_held", (0.1, 0.5, 0.9), "theta"), "id").join(_quantiles(near, "move", (0.1, 0.5, 0.9), "move"), "id", "left")


def posterior_histogram(near: DataFrame, reference: DataFrame, bins: int = 12) -> DataFrame:
    """By observed window: histogram of held information over the nearest rows, the last bin closed, empty bins kept."""
    top = reference.agg(F.greatest(F.lit(0.35), F.max("theta_held")).alias("_hi"))
    placed = near.crossJoin(F.broadcast(top)).withColumn("bin", F.least(F.floor(F.col("theta_held") / F.col("_hi") * bins), F.lit(bins - 1)).cast("int"))
    counted = placed.groupBy("id", "_hi", "bin").agg(F.count("*").alias("n"))
    spine = placed.select("id", "_hi").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = spine.join(counted, ["id", "_hi", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.greatest(F.sum("n").over(Window.partitionBy("id")), F.lit(1))
    edge = lambda k: F.round(F.col("_hi") * k / bins, 3)
    return full.select("id", "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"), F.round(F.col("n") / total, 4).alias("p"))
