"""The whole measurement: statements -> features -> confounds -> baselines -> anomalies -> records.

Every step takes and gives a DataFrame keyed by ``(*world, id)``; ``world`` is
empty for a corpus and names the replicate or grid columns of simulated ones, so
that any number of worlds is scored in one plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import EVASION, FEATURES, HANDPICKED, MATERIAL_MOVE
from . import baseline as B
from . import langmodel as L
from . import lexical as X
from . import learn
from . import validate as S
from .lineage import cut

RESIDUALS = [f"resid_{f}" for f in FEATURES]
LEXICAL = [f for f in FEATURES if f != "surprisal_z"]


def significant(x: Column, digits: int = 6) -> Column:
    """Rounded to so many significant digits."""
    return F.format_string(f"%.{digits}g", x).cast("double")


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def features(statements: DataFrame, lexicon: X.Lexicon | None = None, world: Sequence[str] = ()) -> DataFrame:
    return _features(statements, lexicon, world)[0]


def _features(statements: DataFrame, lexicon: X.Lexicon | None, world: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The speakers' baseline entropies second; first ``*world, id, speaker, window``, the six features, ``words``, ``concrete_per_100w``, counts of markers, time index ``t`` and the surprisal record."""
    keys = [*world, "id"]
    scored = X.lexical_scores(statements.select(*keys, "speaker", "window", "date", "text"), lexicon=lexicon, markers=True).withColumn("t", X.time_index(F.col("date"))).drop("text", "date")
    surprise, entropy = L.surprisal_and_entropy(statements, world=world)
    return scored.join(surprise.drop("speaker", "window"), keys), entropy


@dataclass
class Measured:
    """A scored corpus: features of all statements with residuals, the speakers' baselines, anomalies of constrained statements."""

    rows: DataFrame
    baselines: DataFrame
    anomalies: DataFrame
    world: tuple[str, ...] = ()
    entropy: DataFrame | None = None


def measure(statements: DataFrame, lexicon: X.Lexicon | None = None, world: Sequence[str] = ()) -> Measured:
    """Confounds are removed before baselines are fitted; baselines see baseline statements only.

    Feature rows hold no text and are cut once, since fits and scores read them
    several times.
    """
    world = tuple(world)
    found, entropy = _features(statements, lexicon, world)
    rows = B.residualise(cut(found), list(FEATURES), world=list(world))
    who = [*world, "speaker"]
    base = cut(B.fit_baselines(rows.where("window = 'baseline'"), who, RESIDUALS))
    found = B.anomalies(rows.where("window = 'constrained'"), base, who, RESIDUALS, EVASION).withColumnRenamed("projection", "evasion")
    return Measured(rows, base, found, world, entropy)


def named(columns: dict[str, Column]) -> Column:
    return F.create_map(*[x for name, c in columns.items() for x in (F.lit(name), c)])


def evidence_record(text: Column, lexicon: X.Lexicon | None = None) -> Column:
    """The phrases and markers behind each lexical dimension."""
    lx = lexicon or X.Lexicon()
    return named(
        {
            "hedging": X.evidence(text, lx.hedges),
            "specificity_avoidance": X.marker_evidence(text),
            "pronoun_distancing": X.evidence(text, lx.impersonal),
            "topic_deflection": X.evidence(text, lx.deflectors),
            "confidence_language": X.evidence(text, lx.confidence),
        }
    )


SURPRISAL_RECORD = ("insufficient", "n_tokens", "cross_entropy", "baseline_ce", "surprisal_z", "kl", "jsd", "novel_rate")


def records(statements: DataFrame, measured: Measured, lexicon: X.Lexicon | None = None) -> DataFrame:
    """One record for each constrained statement of a speaker with a baseline, most evasive first (ties by id).

    Twenty columns of the statement's own, eight of its anomaly, and the evasion
    score.  ``statements`` may lack descriptive columns, which then take defaults.
    """

    def own(name: str, default: str | None = "", kind: str = "string") -> Column:
        return F.col(name) if name in statements.columns else F.lit(default).cast(kind)

    b = measured.baselines.select(
        "speaker",
        F.col("n").cast("int").alias("baseline_n"),
        "mean_shrinkage",
        F.round("intensity", 3).alias("cov_shrinkage"),
        named({f: F.round(f"mean_resid_{f}", 4) for f in FEATURES}).alias("baseline_mean"),
    )
    described = statements.where("window = 'constrained'").select(
        "id",
        own("org").alias("org"),
        own("domain", "corporate").alias("domain"),
        own("event").alias("event"),
        own("event_type").alias("event_type"),
        "date",
        own("days_to_disclosure", None, "int").alias("days_to_disclosure"),
        own("synthetic", "false", "boolean").alias("synthetic"),
        evidence_record(F.coalesce(F.col("text"), F.lit("")), lexicon).alias("evidence"),
        own("outcome_move_pct", None, "double").alias("outcome_move_pct"),
        own("outcome", None).alias("outcome"),
        "text",
    )
    scored = measured.anomalies.select(
        "id",
        "speaker",
        named({f: F.round(f, 4) for f in FEATURES}).alias("scores"),
        named({f: F.round(f"resid_{f}", 4) for f in FEATURES}).alias("resid"),
        F.struct(*SURPRISAL_RECORD).alias("surprisal"),
        F.round("d2", 4).alias("d2"),
        F.round("mahalanobis", 4).alias("mahalanobis"),
        significant(F.col("p_chi2")).alias("p_chi2"),
        F.round("percentile", 2).alias("percentile"),
        named({f: F.round(f"z_resid_{f}", 4) for f in FEATURES}).alias("marginal_z"),
        named({f: F.round(f"attribution_resid_{f}", 4) for f in FEATURES}).alias("attribution"),
        F.replace("dominant_feature", F.lit("resid_"), F.lit("")).alias("dominant_feature"),
        F.lit(len(FEATURES)).alias("k"),
        F.round("evasion", 4).alias("evasion"),
    )
    joined = scored.join(described, "id").join(b, "speaker")
    order = (
        "id", "speaker", "org", "domain", "event", "event_type", "date", "days_to_disclosure", "synthetic", "scores", "resid", "baseline_mean",
        "baseline_n", "mean_shrinkage", "cov_shrinkage", "evidence", "surprisal", "outcome_move_pct", "outcome", "text",
        "d2", "mahalanobis", "p_chi2", "percentile", "marginal_z", "attribution", "dominant_feature", "k", "evasion",
    )
    return joined.select(*order).orderBy(F.desc("evasion"), "id")


def top_records(found: DataFrame, n: int = 8) -> DataFrame:
    """The most evasive statements."""
    return found.orderBy(F.desc("evasion"), "id").limit(n)


def baseline_view(statements: DataFrame, measured: Measured, lexicon: X.Lexicon | None = None) -> DataFrame:
    """``(speaker, statements)``: each speaker's baseline statements by date, with the text of one of them.

    The representative is the statement whose *raw* scores are closest to the
    speaker's mean in residual space, in units of its deviations.  Only its text is
    joined; of all others the phrases found in them move, so a speaker's row holds
    metadata and one text.
    """
    lx = lexicon or X.Lexicon()
    rows = measured.rows.where("window = 'baseline'").join(measured.baselines.select("speaker"), "speaker", "left_semi")
    chosen = L.small(B.representative(rows, measured.baselines, "speaker", list(FEATURES), "id", RESIDUALS).select("speaker", F.col("id").alias("rep")))
    base, text = statements.where("window = 'baseline'"), F.coalesce(F.col("text"), F.lit(""))
    told = base.join(L.small(chosen.select(F.col("rep").alias("id"))), "id").select(F.col("id").alias("rep"), F.col("text").alias("_told"))
    phrases = {"_h": lx.hedges, "_p": lx.impersonal, "_d": lx.deflectors, "_c": lx.confidence}
    described = base.select("id", "date", *[X.evidence(text, p).alias(name) for name, p in phrases.items()])
    markers = X.marker_strings(F.col("numeric"), F.col("period"), F.col("words"))
    evidence = named({"hedging": F.col("_h"), "specificity_avoidance": markers, "pronoun_distancing": F.col("_p"), "topic_deflection": F.col("_d"), "confidence_language": F.col("_c")})
    item = F.struct(
        "date",
        "id",
        "words",
        named({f: F.round(f, 4) for f in FEATURES}).alias("scores"),
        evidence.alias("evidence"),
        (F.col("id") == F.col("rep")).alias("representative"),
        F.when(F.col("id") == F.col("rep"), F.col("_told")).alias("text"),
    )
    by_date = lambda a, b: F.when(a["date"] < b["date"], -1).when(a["date"] > b["date"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)
    wanted = rows.select("speaker", "id", "words", "numeric", "period", *FEATURES).join(chosen.join(L.small(told), "rep"), "speaker")
    gathered = wanted.join(described, "id").select("speaker", item.alias("s"))
    return gathered.groupBy("speaker").agg(F.array_sort(F.collect_list("s"), by_date).alias("statements"))


# ---------------------------------------------------------------- validation


def with_outcomes(measured: Measured, outcomes: DataFrame) -> DataFrame:
    """Anomalies of constrained statements with a known move, as differences from the baseline mean: ``outcomes(id, outcome_move_pct)``."""
    means = measured.baselines.select("speaker", *[F.col(f"mean_resid_{f}").alias(f"_m_{f}") for f in FEATURES])
    known = measured.anomalies.join(outcomes.where("outcome_move_pct is not null"), "id").join(means, "speaker")
    return known.select(
        "id",
        "speaker",
        *RESIDUALS,
        F.round("evasion", 4).alias("evasion"),
        F.round("mahalanobis", 4).alias("mahalanobis"),
        *[(F.round(f"resid_{f}", 4) - F.round(f"_m_{f}", 4)).alias(f"x_{f}") for f in FEATURES],
        F.abs("outcome_move_pct").alias("move"),
        (F.abs("outcome_move_pct") >= MATERIAL_MOVE).cast("int").alias("material"),
    )


def learn_direction(scored: DataFrame, measured: Measured) -> tuple[dict, DataFrame]:
    """``(report, scored plus p_material_oof and directional)``; without a model directional is the Mahalanobis distance."""
    xs = [f"x_{f}" for f in FEATURES]
    report, oof = learn.fit_and_validate(scored, "id", "speaker", "material", xs)
    if report["status"] != "ok":
        return report, scored.withColumn("p_material_oof", F.lit(None).cast("double")).withColumn("directional", F.col("mahalanobis"))
    hand = scored.withColumn("_h", learn.handpicked(scored, xs, list(HANDPICKED)))
    report["auc_handpicked_weights"] = S.auc(hand, "_h", "material").first()["auc"]
    projected = B.anomalies(scored.select("id", "speaker", *RESIDUALS), measured.baselines, "speaker", RESIDUALS, tuple(report["direction"]))
    out = scored.join(projected.select("id", F.round("projection", 4).alias("directional")), "id")
    return report, out.join(oof.select("id", F.round("p", 4).alias("p_material_oof")), "id", "left")


def validation_block(scored: DataFrame, n_perm: int = 20_000, n_boot: int = 10_000) -> DataFrame:
    """One row: blocked permutation tests of three scores against the move, an interval, areas and the base rate.

    Under six scored statements the status is ``insufficient_data`` and the rest null.
    """
    out = scored.agg(F.count("*").alias("n"), F.round(F.avg("material"), 3).alias("base_rate_material"))
    for name in ("evasion", "mahalanobis", "directional"):
        t = S.permutation_test(scored, name, "move", "id", n_perm, "speaker")
        out = out.crossJoin(F.broadcast(t.select(F.round("observed", 4).alias(f"rho_{name}"), F.col("p_value").alias(f"p_{name}"), F.round("null_sd", 4).alias(f"null_sd_{name}"))))
    ci = S.bootstrap_ci(scored, "evasion", "move", "id", n_boot)
    out = out.crossJoin(F.broadcast(ci.select(F.round("lo", 4).alias("ci_lo"), F.round("hi", 4).alias("ci_hi"))))
    for name in ("evasion", "mahalanobis"):
        out = out.crossJoin(F.broadcast(S.auc(scored, name, "material").select(F.round("auc", 4).alias(f"auc_{name}"))))
    status = F.when(F.col("n") < 6, "insufficient_data").otherwise("ok")
    return out.select(status.alias("status"), F.lit(MATERIAL_MOVE).alias("material_at"), *out.columns)


# -------------------------------------------------- one text, every speaker


def probe(texts: DataFrame, statements: DataFrame, measured: Measured, lexicon: X.Lexicon | None = None) -> DataFrame:
    """Each of a few given texts ``(text_id, text)`` as if every speaker had said it: features, residuals, anomaly, evasion.

    Length is the text's own, time the corpus mean.  Texts under the token floor
    have surprisal zero.
    """
    rows = measured.rows
    shape = rows.agg(F.avg(B.log_words()).alias("_m"), F.greatest(F.stddev_pop(B.log_words()), F.lit(1e-6)).alias("_s"))
    design = B.standardised(rows, {"x1": B.log_words(), "x2": F.col("t")})
    beta = B.confound_fit(design.agg(*B.confound_sums(list(FEATURES))), list(FEATURES))
    own = measured.entropy if measured.entropy is not None else L.baseline_entropy_table(statements)
    lexical = X.lexical_scores(texts, lexicon=lexicon)
    against = L.against_all_speakers(texts, statements).join(own, "speaker")
    enough = F.col("n_tokens") >= L.MIN_TOKENS
    z = F.when(enough, F.round((F.col("cross_entropy") - F.col("baseline_ce")) / F.greatest(F.col("baseline_ce_sd"), F.lit(L.MIN_SD)), 4)).otherwise(0.0)
    grid = lexical.drop("text").join(against.withColumn("surprisal_z", z), "text_id").crossJoin(F.broadcast(shape)).crossJoin(F.broadcast(beta))
    x1 = (B.log_words() - F.col("_m")) / F.col("_s")
    resid = [(F.col(f) - (F.col(f"b0_{f}") + F.col(f"b1_{f}") * x1) + F.col(f"mean_{f}")).alias(f"resid_{f}") for f in FEATURES]
    scored = grid.select("text_id", "speaker", "words", "n_tokens", "cross_entropy", "novel_rate", *FEATURES, *resid)
    found = B.anomalies(scored, measured.baselines, "speaker", RESIDUALS, EVASION)
    return found.withColumnRenamed("projection", "evasion").withColumn("dominant_feature", F.replace("dominant_feature", F.lit("resid_"), F.lit("")))
