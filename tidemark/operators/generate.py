"""Synthetic speakers who write: sentences composed from banks, corpora with a planted effect, and the disclosure game.

Every draw is a hash of its coordinates ``(seed, grid, rep, speaker, statement,
name)``, so a corpus of any number of worlds is one projection, identical under
any partitioning.  ``worlds`` is a small table with one row for each replicate
of each grid point; whatever varies over the grid is a column of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import banks
from ..functions.fixed import ARCHETYPES, EXPRESSION, GAME, STYLE_MIDDLE, STYLE_SPAN
from .game import _gamma_like, best_response, constraint_at, normal, outcome_class, resolve_population, suppressed, uniform

WORLD = ("grid", "rep")
STYLES = tuple(STYLE_MIDDLE)


# ---------------------------------------------------------------- composer


def _pick(bank: tuple[str, ...], draw: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in bank]), (F.floor(draw * len(bank)) + 1).cast("int"))


def _numbered(sentence: Column, at: list[Column | str]) -> Column:
    """Numbers in place of the braces."""
    ranges = {"a": (80, 910), "b": (3, 75), "c": (10, 450)}
    for name, (low, width) in ranges.items():
        sentence = F.replace(sentence, F.lit("{" + name + "}"), (low + F.floor(uniform(*at, name) * width)).cast("string"))
    return F.replace(sentence, F.lit("{d}"), F.format_string("%.1f", 0.4 + 3.4 * uniform(*at, "d")))


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def compose(at: list[Column], hedge: Column, deflect: Column, confident: Column, distant: Column, refuse: Column, n_sentences: Column) -> Column:
    """A statement whose surface follows the propensities: an opener, ``n_sentences`` details, a closer."""
    vague_first = uniform(*at, "opener") < hedge
    opener = F.when(vague_first, _pick(banks.OPENERS_VAGUE, uniform(*at, "o"))).otherwise(_pick(banks.OPENERS_DIRECT, uniform(*at, "o")))
    vague_last = uniform(*at, "closer") < hedge
    closer = F.when(vague_last, _pick(banks.CLOSERS_VAGUE, uniform(*at, "c"))).otherwise(_pick(banks.CLOSERS_DIRECT, uniform(*at, "c")))

    def sentence(i: Column) -> Column:
        own = [*at, i]
        u, which = uniform(*own, "kind"), uniform(*own, "which")
        plain = F.when(uniform(*own, "bank") > 0.35, _pick(banks.DETAIL_DIRECT, which)).otherwise(_pick(banks.OWNERSHIP_FIRST, which))
        return (
            F.when(u < refuse, _pick(banks.REFUSE, which))
            .when(u < refuse + deflect, _pick(banks.DEFLECT, which))
            .when(u < refuse + deflect + confident, _pick(banks.CONFIDENT, which))
            .when(uniform(*own, "distant") < distant, _pick(banks.OWNERSHIP_DISTANT, which))
            .when(uniform(*own, "hedge") < hedge, _pick(banks.DETAIL_VAGUE, which))
            .otherwise(_numbered(plain, own))
        )

    details = F.transform(F.sequence(F.lit(1), n_sentences), sentence)
    return F.concat_ws(" ", _numbered(opener, [*at, "first"]), F.array_join(details, " "), _numbered(closer, [*at, "last"]))


def _length(at: list[Column], low: int = 7, width: int = 5) -> Column:
    return (low + F.floor(uniform(*at, "length") * width)).cast("int")


# ------------------------------------------------------------------ worlds


def worlds(spark: SparkSession, n_reps: int, grid: list[dict] | None = None, defaults: dict | None = None, seed: int = 0) -> DataFrame:
    """``(grid, rep, seed, *parameters)``: every replicate of every grid point, parameters as columns of doubles."""
    base = dict(GAME if defaults is None else defaults)
    points = [base | {k: v for k, v in (g or {}).items() if k != "population"} for g in (grid or [{}])]
    names = sorted({k for p in points for k in p})
    rows = [(i, str(seed), *[float(p[k]) for k in names]) for i, p in enumerate(points)]
    table = spark.createDataFrame(rows, "grid int, seed string, " + ", ".join(f"{k} double" for k in names))
    return table.crossJoin(spark.range(n_reps).select(F.col("id").cast("int").alias("rep")))


def _roster(table: DataFrame) -> DataFrame:
    speaker = F.explode(F.sequence(F.lit(0), F.col("n_speakers").cast("int") - 1)).alias("i")
    return table.select("*", speaker)


def _statements(speakers: DataFrame, baseline_n: Column, constrained_n: Column) -> DataFrame:
    return speakers.withColumn("j", F.explode(F.sequence(F.lit(0), (baseline_n + constrained_n).cast("int") - 1))).withColumn("held_window", F.col("j") >= baseline_n)


def _identified(rows: DataFrame, n_base: Column) -> list[Column]:
    constrained = F.col("held_window")
    k = F.when(constrained, F.col("j") - n_base.cast("int")).otherwise(F.col("j")).cast("int")
    event = lambda names: _pick_by(names, k)
    month = F.lpad(((k % 12) + 1).cast("string"), 2, "0")
    return [
        "grid",
        "rep",
        F.concat_ws("-", "i", F.concat(F.when(constrained, "c").otherwise("b"), k.cast("string"))).alias("id"),
        F.concat(_pick_by(banks.NAMES, F.col("i")), F.lit("_"), F.col("i").cast("string")).alias("speaker"),
        _pick_by(banks.ORGANISATIONS, F.col("i")).alias("org"),
        F.lit("corporate").alias("domain"),
        F.when(constrained, event(banks.CONSTRAINED_EVENTS)).otherwise(event(banks.BASELINE_EVENTS)).alias("event_type"),
        F.to_date(F.when(constrained, F.concat(F.lit("2025-"), month, F.lit("-10"))).otherwise(F.concat(F.lit("2024-"), month, F.lit("-15")))).alias("date"),
        F.when(constrained, "constrained").otherwise("baseline").alias("window"),
        F.lit(True).alias("synthetic"),
    ]


def _pick_by(names: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), (k % len(names) + 1).cast("int"))


def _signed_move(held: Column, beta: Column | float, noise: Column | float, tilt: float, at: list[Column], shock: Column | None) -> Column:
    move = held * beta * (0.5 + 0.8 * uniform(*at, "beta")) + noise * normal(*at, "move")
    if shock is not None:
        move = move + F.when(uniform(*at, "shock") < shock, 11.0 * normal(*at, "size")).otherwise(0.0)
    down = uniform(*at, "sign") < 0.5 + tilt * (held > 0.18).cast("int")
    return F.round(F.when(down, -1).otherwise(1) * F.abs(move), 1)


def style(who: list[Column], heterogeneity: Column, bias: dict[str, Column] | None = None) -> list[Column]:
    """A speaker's own register when nothing is at stake."""
    b = bias or {}
    middle = lambda s: F.lit(STYLE_MIDDLE[s]) + b.get(s, F.lit(0.0))
    return [F.greatest(F.lit(0.02), F.least(F.lit(0.88), middle(s) + heterogeneity * STYLE_SPAN[s] * normal(*who, s))).alias(s) for s in STYLES]


def _spoken(at: list[Column], shift: dict[str, Column], constrained: Column, refuse: Column, sentences: Column) -> Column:
    """The text of a statement: the style drifts in baselines and is shifted (with noise) in constrained windows."""
    drift, noise = 0.05 * normal(*at, "drift"), 0.05 * normal(*at, "noise")
    part = {"evasive": 1.0, "deflect": 0.5, "confident": 0.5, "distant": 1.0}
    say = {s: _unit(F.col(s) + F.when(constrained, shift[s] + noise).otherwise(drift * part[s])) for s in STYLES}
    return compose(at, say["evasive"], say["deflect"], say["confident"], say["distant"], F.when(constrained, refuse).otherwise(0.0), sentences)


# ----------------------------------------------------------------- corpora


def controlled_corpus(table: DataFrame) -> DataFrame:
    """Worlds with a known shift of every constrained statement: ``effect`` of the grid, or drawn by speaker where it is null (NaN).

    Result: statements with ``true_effect`` and ``outcome_move_pct``.
    """
    who = [F.col("seed"), F.col("rep"), F.col("i")]
    drawn = 0.7 * uniform(*who, "effect")
    speakers = _roster(table).select("*", *style(who, F.col("heterogeneity")), F.when(F.isnan("effect"), drawn).otherwise(F.col("effect")).alias("true_effect"))
    rows = _statements(speakers, F.col("baseline_n"), F.col("constrained_n"))
    at = [*who, F.col("j")]
    shifted = rows.withColumn("_shift", F.when(F.col("held_window"), F.col("true_effect") * (0.6 + 0.8 * uniform(*at, "shift"))).otherwise(0.0))
    shift = {s: F.col("_shift") * w for s, w in EXPRESSION.items()}
    move = _signed_move(F.col("_shift"), 11.0, 5.0, 0.2, at, None)
    return shifted.select(
        *_identified(shifted, F.col("baseline_n")),
        F.when(F.col("held_window"), (6 + F.floor(uniform(*at, "days") * 18)).cast("int")).alias("days_to_disclosure"),
        "true_effect",
        F.when(F.col("held_window"), move).alias("outcome_move_pct"),
        _spoken(at, shift, F.col("held_window"), F.lit(0.0), _length(at)).alias("text"),
    )


def synthetic_corpus(spark: SparkSession, n_speakers: int = 15, seed: int = 20260902, n_reps: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(statements, manifest)``: speakers with styles of their own, three in ten of whom leak nothing.

    The manifest is the ground truth: who is a null speaker, the true strength,
    and how many statements of each kind there are.
    """
    table = worlds(spark, n_reps, defaults={"n_speakers": n_speakers}, seed=seed)
    who = [F.col("seed"), F.col("rep"), F.col("i")]

    def beta(a: float, b: float, name: str) -> Column:
        x, y = _gamma_like(a, F.lit(1.0), *who, name, "x"), _gamma_like(b, F.lit(1.0), *who, name, "y")
        return x / F.greatest(x + y, F.lit(1e-9))

    own = {"evasive": (2.0, 5.0, 0.03, 0.75), "deflect": (1.6, 8.0, 0.01, 0.35), "confident": (1.5, 9.0, 0.01, 0.30), "distant": (2.0, 7.0, 0.02, 0.55)}
    styles = [F.greatest(F.lit(lo), F.least(F.lit(hi), beta(a, b, s))).alias(s) for s, (a, b, lo, hi) in own.items()]
    null = uniform(*who, "null") < 0.30
    strength = F.when(null, F.lit(0.0)).otherwise(F.least(_gamma_like(2.2, F.lit(0.16), *who, "strength"), F.lit(0.85)))
    speakers = _roster(table).select(
        "*", *styles, null.alias("null_speaker"), strength.alias("strength"), (4 + F.floor(uniform(*who, "nb") * 5)).cast("int").alias("n_baseline"), (2 + F.floor(uniform(*who, "nc") * 3)).cast("int").alias("n_constrained")
    )
    rows = _statements(speakers, F.col("n_baseline"), F.col("n_constrained"))
    at = [*who, F.col("j")]
    shifted = rows.withColumn("_shift", F.when(F.col("held_window"), F.col("strength") * (0.6 + 0.8 * uniform(*at, "shift"))).otherwise(0.0))
    shift = {s: F.col("_shift") * w for s, w in EXPRESSION.items()}
    move = _signed_move(F.col("_shift"), 16.0, 4.2, 0.22, at, F.lit(0.20))
    statements = shifted.select(
        *_identified(shifted, F.col("n_baseline")),
        F.when(F.col("held_window"), (6 + F.floor(uniform(*at, "days") * 18)).cast("int")).alias("days_to_disclosure"),
        F.when(F.col("held_window"), move).alias("outcome_move_pct"),
        F.when(F.col("held_window"), outcome_class(move)).alias("outcome"),
        _spoken(at, shift, F.col("held_window"), F.lit(0.0), _length(at, 6, 6)).alias("text"),
    )
    name = F.concat(_pick_by(banks.NAMES, F.col("i")), F.lit("_"), F.col("i").cast("string"))
    manifest = speakers.select("grid", "rep", name.alias("speaker"), _pick_by(banks.ORGANISATIONS, F.col("i")).alias("org"), "null_speaker", F.round("strength", 3).alias("true_signal_strength"), "n_baseline", "n_constrained")
    return statements, manifest


def seats(mix: dict[str, float], n: int) -> list[tuple[str, int, int]]:
    """``(archetype, from, upto)`` by largest remainder over a resolved population."""
    share = {k: round(w * n, 9) for k, w in mix.items()}
    count = {k: int(s) for k, s in share.items()}
    by_rest = sorted(mix, key=lambda k: (-round(share[k] - count[k], 9), list(mix).index(k)))
    for k in by_rest[: n - sum(count.values())]:
        count[k] += 1
    out, at = [], 0
    for k in mix:
        out.append((k, at, at + count[k]))
        at += count[k]
    return out


def simulate(spark: SparkSession, n_reps: int = 1, grid: list[dict] | None = None, population: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """Play the disclosure game in every world and write down what is said, with the hidden truth beside it.

    A grid point may change any game parameter and the ``population``.  Held
    information shows in two channels: what is papered over is lexical and can be
    coached; what cannot be said shows as missing numbers, and as refusals the
    lower the register.  Truth columns are for evaluation only.
    """
    grid = grid or [{}]
    table = worlds(spark, n_reps, grid, seed=seed)
    placed = []
    for i, point in enumerate(grid):
        n = int((GAME | point)["n_speakers"])
        placed += [(i, *s) for s in seats(resolve_population(point.get("population", population)), n)]
    places = spark.createDataFrame(placed, "grid int, archetype string, _from int, _upto int")
    # The roster is shuffled in every world: a speaker's seat is the rank of its hash.
    order = Window.partitionBy("grid", "rep").orderBy(uniform(F.col("seed"), F.col("rep"), F.col("i"), "seat"), "i")
    seated = _roster(table).withColumn("_seat", F.row_number().over(order) - 1)
    seated = seated.join(F.broadcast(places), "grid").where((F.col("_seat") >= F.col("_from")) & (F.col("_seat") < F.col("_upto")))  # a few seats for each grid point
    a = F.col("archetype")
    of = lambda values: F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])[a]
    changed = sorted({k for _, _, o, _ in ARCHETYPES.values() for k in o})
    for k in changed:
        seated = seated.withColumn(k, F.coalesce(of({name: (float(o[k]) if k in o else None) for name, (_, _, o, _) in ARCHETYPES.items()}).cast("double"), F.col(k)))
    who = [F.col("seed"), F.col("rep"), F.col("i")]
    bias = {s: of({name: float(b.get(s, 0.0)) for name, (_, b, _, _) in ARCHETYPES.items()}) for s in STYLES}
    multiplier, always = of({k: float(m) for k, (m, *_) in ARCHETYPES.items()}), of({k: bool(w) for k, (*_, w) in ARCHETYPES.items()})
    theta = F.when(uniform(*who, "null") < F.col("p_null"), F.lit(0.0)).otherwise(_unit(_gamma_like(2.2, F.col("theta_scale") / 2.2, *who, "theta")))
    speakers = seated.select(
        "*", *style(who, F.col("heterogeneity"), bias), (always | (uniform(*who, "adopt") < F.col("adoption"))).alias("adapted"), (theta * multiplier).alias("theta")
    )
    rows = _statements(speakers, F.col("baseline_n"), F.col("constrained_n"))
    at = [*who, F.col("j")]
    constrained, skill, adapted = F.col("held_window"), F.col("coaching_skill"), F.col("adapted")
    days = F.when(constrained, (2 + F.floor(uniform(*at, "days") * 26)).cast("int"))
    bound = F.when(constrained, constraint_at(F.col("days_to_disclosure"), F.col("constraint_base"), F.col("dose_response"))).otherwise(0.0)
    played = rows.withColumn("days_to_disclosure", days).withColumn("constraint", bound)
    played = played.withColumn("_r", best_response(F.col("theta"), F.col("constraint"), F.col("kappa"), F.col("delta"), F.col("adoption")))
    truth = played.withColumn("theta_held", F.when(constrained, F.col("_r.theta_held")).otherwise(0.0)).withColumn("register", F.when(constrained, F.col("_r.register")).otherwise(0.0))
    held, papered = F.col("theta_held"), F.col("theta_held") * F.col("register")
    hedge = suppressed(papered, "hedging", adapted, skill)
    vague = suppressed(held * F.col("constraint") * 0.90, "specificity_avoidance", adapted, skill)
    shift = {
        "evasive": F.greatest(hedge, vague),
        "deflect": suppressed(papered * EXPRESSION["deflect"], "topic_deflection", adapted, skill),
        "confident": suppressed(papered * EXPRESSION["confident"], "confidence_language", adapted, skill),
        "distant": suppressed(papered * EXPRESSION["distant"], "pronoun_distancing", adapted, skill),
    }
    refuse = F.greatest(F.lit(0.0), F.least(F.lit(0.6), held * (1 - F.col("register")) * 0.85))
    move = _signed_move(held, F.col("outcome_beta"), F.col("outcome_noise"), 0.22, at, F.col("p_shock"))
    return truth.select(
        *_identified(truth, F.col("baseline_n")),
        "days_to_disclosure",
        "theta",
        "theta_held",
        "register",
        "constraint",
        "adapted",
        "archetype",
        F.when(constrained, move).alias("outcome_move_pct"),
        F.when(constrained, outcome_class(move)).alias("outcome"),
        _spoken(at, shift, constrained, refuse, _length(at)).alias("text"),
    )

