"""The disclosure game and studies over simulated worlds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.banks import NAMES, ORGANISATIONS
from ..functions.fixed import CONTROLLED, PRESETS
from ..operators import game as G
from ..operators import generate as N
from ..operators import studies
from ..operators import worldstudies as W
from ..operators.lineage import cut
from .registry import Registry

REGISTRY = Registry()
_GRID = """g as (select t.theta, d.days, a.adoption from (select unnest([0.0::double, 0.2::double, 0.5::double, 0.9::double]) as theta) t,
  (select unnest([0, 5, 15, 30, 45]) as days) d, (select unnest([0.0::double, 0.5::double, 1.0::double]) as adoption) a),
cc as (select *, greatest(0, least(1, 0.15::double + 0.85::double * (1 - greatest(0, least(30, days)) / 30.0::double))) as c from g),
br as (select *, case when theta <= 1e-9 then 1.0 else 0.6::double / (0.6::double + greatest(c, 1e-9)) end as disclose from cc),
hd as (select *, case when theta <= 1e-9 then 0.0 else theta * (1 - disclose) end as held from br),
rg as (select *, case when theta <= 1e-9 then 0.0 when 0.6::double * held + 0.9::double * adoption <= 1e-12 then 1.0 else greatest(0, least(1, 0.6::double * held / (0.6::double * held + 0.9::double * adoption))) end as register from hd)"""


@REGISTRY.query(
    f"""with {_GRID} select theta, cast(days as integer) as days, adoption, round(c, 6) as c, round(disclose, 6)::double as disclose, round(held, 6)::double as theta_held, round(register, 6)::double as register,
    case when register > 0.66 then 'hedged' when register > 0.33 then 'mixed' else 'refusal' end as label,
    round(case when adoption > 0.5 then register * (1 - 0.75::double * 0.85::double) else register end, 6)::double as hedge from rg"""
)
def q_game_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = lambda values, name, kind: spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    grid = axis((0.0, 0.2, 0.5, 0.9), "theta", "double").crossJoin(axis((0, 5, 15, 30, 45), "days", "int")).crossJoin(axis((0.0, 0.5, 1.0), "adoption", "double"))
    c = grid.withColumn("c", G.constraint_at(F.col("days"), F.lit(0.15), F.lit(0.85)))
    r = c.withColumn("r", G.best_response(F.col("theta"), F.col("c"), F.lit(0.6), F.lit(0.45), F.col("adoption")))
    return r.select(
        "theta",
        "days",
        "adoption",
        F.round("c", 6).alias("c"),
        *[F.round(f"r.{x}", 6).alias(x) for x in ("disclose", "theta_held", "register")],
        G.register_label(F.col("r.register")).alias("label"),
        F.round(G.suppressed(F.col("r.register"), "hedging", F.col("adoption") > 0.5, F.lit(0.75)), 6).alias("hedge"),
    )


@REGISTRY.query(
    """select * from (values ('naive_executive', 6), ('coached_executive', 2), ('legally_muzzled', 2), ('genuinely_uncertain', 2), ('career_official', 1), ('null', 1)) t(name, seats)"""
)
def q_archetype_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = [(i, name, float(w)) for i, (name, w) in enumerate(G.resolve_population(None).items())]
    return G.allocate(spark.createDataFrame(mix, "ord int, name string, weight double"), 14).select("name", "seats")


@REGISTRY.query("select * from (values ('a=0.6,b=0.4', 'a', 0.6::double), ('a=0.6,b=0.4', 'b', 0.4::double), ('x=1', 'x', 1.0::double)) t(mix, name, weight)")
def q_mix_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixes = spark.createDataFrame([("a=0.6,b=0.4",), ("x=1",)], "mix string")
    return mixes.select("mix", F.explode(G.parse_mix(F.col("mix"))).alias("name", "weight"))


@REGISTRY.query(
    """select r as retained, case when r > 1.15 then 'gains' when r >= 0.80 then 'holds' when r >= 0.55 then 'degrades' else 'collapses' end as verdict,
    r - lag(r) over (order by r) as delta from (select unnest([0.0::double, 0.5::double, 0.55::double, 0.75::double, 0.8::double, 1.0::double, 1.25::double]) as r)"""
)
def q_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rungs = spark.createDataFrame([(x,) for x in (0.0, 0.5, 0.55, 0.75, 0.8, 1.0, 1.25)], "retained double")
    return studies.ladder_delta(rungs.withColumn("verdict", studies.verdict(F.col("retained"))), "retained", "retained")


_GAME_TRUTH = ("archetype", "theta_held", "register", "days_to_disclosure", "outcome_move_pct")
_PLANTED_TRUTH = ("true_effect", "outcome_move_pct")
_PERMUTATIONS = 200


def _scored(spark: SparkSession, n_reps: int, grid: list[dict] | None = None, seed: int = 0) -> DataFrame:
    """Constrained windows of simulated worlds, scored world by world."""
    return W.score_worlds(cut(N.simulate(spark, n_reps, grid, seed=seed)), _GAME_TRUTH)


def _planted(spark: SparkSession, n_reps: int, grid: list[dict] | None = None, seed: int = 5) -> DataFrame:
    table = N.worlds(spark, n_reps, grid, CONTROLLED, seed)
    return W.score_worlds(cut(N.controlled_corpus(table)), _PLANTED_TRUTH)


def _named(found: DataFrame, grid: list[dict], kinds: str) -> DataFrame:
    """Grid values in place of grid numbers."""
    names = [k.split()[0] for k in kinds.split(", ")]
    points = found.sparkSession.createDataFrame([(i, *[g[n] for n in names]) for i, g in enumerate(grid)], f"grid int, {kinds}")
    return points.join(found, "grid").drop("grid")


@REGISTRY.query()
def q_simulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of four worlds of the disclosure game, with their hidden truth."""
    return N.simulate(spark, 4)


@REGISTRY.query()
def q_synthetic_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.synthetic_corpus(spark)[0]


def _draw(*parts: str) -> str:
    key = " || '-' || ".join(parts)
    return f"((('0x' || substr(md5({key}), 1, 12))::bigint::double + 0.5) / 281474976710656.0::double)"


_WHO = ("'20260902-0'", "cast(i as varchar)")
_NORMAL = f"(sqrt(-2 * ln({_draw(*_WHO, chr(39) + 'strength-u' + chr(39))})) * cos(2 * 3.141592653589793::double * {_draw(*_WHO, chr(39) + 'strength-v' + chr(39))}))"
_K = "(1 / (9 * 2.2::double))"
_GAMMA = f"(0.16::double * 2.2::double * pow(greatest(0.0::double, 1 - {_K} + {_NORMAL} * sqrt({_K})), 3))"


@REGISTRY.query(
    f"""with r as (select unnest(range(15)) as i)
    select cast(0 as integer) as grid, cast(0 as integer) as rep, list_extract([{", ".join(repr(x) for x in NAMES)}], cast(i % 15 + 1 as integer)) || '_' || i as speaker,
    list_extract([{", ".join(repr(x) for x in ORGANISATIONS)}], cast(i % 7 + 1 as integer)) as org, {_draw(*_WHO, "'null'")} < 0.30 as null_speaker,
    round(case when {_draw(*_WHO, "'null'")} < 0.30 then 0.0 else least({_GAMMA}, 0.85) end, 3)::double as true_signal_strength,
    cast(4 + floor({_draw(*_WHO, "'nb'")} * 5) as integer) as n_baseline, cast(2 + floor({_draw(*_WHO, "'nc'")} * 3) as integer) as n_constrained from r"""
)
def q_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.synthetic_corpus(spark)[1]


@REGISTRY.query()
def q_controlled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.controlled_corpus(N.worlds(spark, 2, [{"effect": 0.0}, {"effect": 0.6}], CONTROLLED, 5))


_ADOPTION = [{"adoption": x} for x in (0.0, 0.25, 0.5, 0.75, 1.0)]


@REGISTRY.query()
def q_adoption_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the signal survives as more speakers know that they are read."""
    return _named(W.adoption_sweep(_scored(spark, 4, _ADOPTION, 700)), _ADOPTION, "adoption double")


@REGISTRY.query()
def q_feature_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each feature keeps of its correlation with held information when everyone is coached."""
    return W.feature_survival(_scored(spark, 5, [{"adoption": 0.0}, {"adoption": 1.0}], 810))


@REGISTRY.query()
def q_dose_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.binned_mean(_scored(spark, 6, seed=920), "days_to_disclosure", "evasion", (0, 5, 10, 15, 20, 25, 30))


@REGISTRY.query()
def q_archetype_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.archetype_rates(_scored(spark, 6, seed=1300)).drop("grid")


@REGISTRY.query()
def q_archetype_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates as means over archetypes, next to both scores at the same number of alarms."""
    scored = _scored(spark, 6, seed=1300)
    matched = W.matched_alarms(scored)
    return W.archetype_summary(W.archetype_rates(scored)).join(matched.select("grid", *[F.col(c).alias(f"matched_{c}") for c in matched.columns if c != "grid"]), "grid").drop("grid")


_PRESETS = [{"scenario": name, "population": mix or {}, **params} for name, (mix, params) in PRESETS.items()]


def _preset_grid() -> list[dict]:
    return [{k: v for k, v in g.items() if k not in ("scenario", "population")} | ({"population": g["population"]} if g["population"] else {}) for g in _PRESETS]


@REGISTRY.query()
def q_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every preset: windows, share flagged, median correlation over worlds, and the rates of its archetypes."""
    scored = _scored(spark, 3, _preset_grid(), 2000)
    found = W.scenario_summary(scored).join(W.archetype_summary(W.archetype_rates(scored)), "grid")
    return _named(found, _PRESETS, "scenario string")


_DESIGN = [{"n_speakers": k, "baseline_n": b} for k in (8, 14, 22) for b in (3, 6)]


@REGISTRY.query()
def q_design_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power over the number of speakers and the depth of their baselines."""
    return _named(W.design_grid(_scored(spark, 3, _DESIGN, 1040), _PERMUTATIONS), _DESIGN, "n_speakers int, baseline_n int")


@REGISTRY.query()
def q_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder from raw scores to the signed projection, on the synthetic corpus."""
    return W.ablation(cut(N.synthetic_corpus(spark)[0]), _PERMUTATIONS)


_EFFECTS = [{"effect": x} for x in (0.0, 0.1, 0.2, 0.3, 0.45, 0.6)]


@REGISTRY.query()
def q_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area for material moves at known effects; at zero it has to be chance."""
    return _named(W.recovery(_planted(spark, 4, _EFFECTS)), _EFFECTS, "effect double")


_SPREADS = [{"heterogeneity": x} for x in (0.0, 0.25, 0.5, 0.75, 1.0, 1.3)]


@REGISTRY.query()
def q_heterogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute against relative scores as speakers grow more different."""
    return _named(W.heterogeneity(_planted(spark, 4, _SPREADS, 900)), _SPREADS, "heterogeneity double")


@REGISTRY.query()
def q_recovery_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.recovery_ranking(_planted(spark, 6, None, 400)).drop("grid")


def _near(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    reference = W.reference_table(_scored(spark, 8, seed=2200))
    observed = _scored(spark, 1, seed=77)
    return cut(W.neighbours(observed, reference)), reference


@REGISTRY.query()
def q_posterior_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held information and move of every window of a fresh world, given a simulated reference."""
    return W.posterior(_near(spark)[0])


@REGISTRY.query()
def q_posterior_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.posterior_histogram(*_near(spark))
