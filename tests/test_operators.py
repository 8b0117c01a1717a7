"""Properties of single operators, on small inputs with known answers."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import baseline as B
from tidemark.operators import calendar as C
from tidemark.operators import game as G
from tidemark.operators import generate as N
from tidemark.operators import langmodel as L
from tidemark.operators import learn, studies
from tidemark.operators import lexical as X
from tidemark.operators import validate as S
from tidemark.sources import corpus
from tidemark.sources import html as H
from tidemark.streaming import baselines as stream

D = datetime.date


@pytest.mark.parametrize(
    ("day", "window", "event", "days"),
    [
        (D(2026, 9, 3), "baseline", D(2026, 9, 15), 12),
        (D(2026, 9, 10), "constrained", D(2026, 9, 15), 5),
        (D(2019, 5, 1), "out_of_coverage", None, None),
        (D(2030, 1, 1), "out_of_coverage", None, None),
        (D(2026, 12, 9), "out_of_coverage", None, None),
        (D(2024, 2, 1), "constrained", D(2024, 1, 30), -2),
        (None, "out_of_coverage", None, None),
    ],
)
def test_labels(spark, day, window, event, days):
    facts = spark.createDataFrame([(day,)], "d date")
    row = C.label_windows(facts, "d", C.meetings(spark)).first()
    assert (row["window"], row["next_event"], row["days_to_event"]) == (window, event, days)


def test_windows_start_on_saturday_and_never_overlap(spark):
    rows = sorted((r["start"], r["end"]) for r in C.constrained_windows(C.meetings(spark)).collect())
    assert all(a.weekday() == 5 for a, _ in rows)
    assert all(e < s for (_, e), (s, _) in zip(rows, rows[1:]))


def test_calendar_share(spark):
    row = C.calendar_share(C.meetings(spark), "2024-01-01", "2026-12-31").first()
    assert (row["n_constrained"], row["n_days"]) == (311, 1095)


def test_lexical_order(spark):
    direct = "We grew revenue 12% to $4.2 billion in Q3. We will ship in March. I own that number."
    evasive = "I think, broadly speaking, it's fair to say the company, at this point, is kind of, perhaps, focused on the bigger picture over time."
    rows = X.lexical_scores(spark.createDataFrame([(1, direct), (2, evasive), (3, None)], "id int, text string")).orderBy("id").collect()
    assert rows[0]["hedging"] < rows[1]["hedging"]
    assert rows[0]["specificity_avoidance"] < rows[1]["specificity_avoidance"]
    for r in rows:
        assert all(0 <= r[c] <= 1 for c in ("hedging", "specificity_avoidance", "pronoun_distancing", "topic_deflection", "confidence_language"))


def test_surprisal(spark):
    same = " ".join(["the quarter was good and we shipped the product on time to our users"] * 4)
    odd = " ".join(["zebra quantum lattice dissolves beneath marble horizons of violet thunder"] * 5)
    rows = [(i, "a", "baseline", same) for i in range(4)] + [(9, "a", "constrained", same), (10, "a", "constrained", odd), (11, "a", "constrained", "short")]
    got = {r["id"]: r for r in L.surprisal(spark.createDataFrame(rows, "id int, speaker string, window string, text string")).collect()}
    assert got[10]["surprisal_z"] > got[9]["surprisal_z"] + 1
    assert got[10]["novel_rate"] > 0.9 and got[9]["novel_rate"] == 0
    assert got[11]["insufficient"] and got[11]["surprisal_z"] == 0


def test_ledoit_wolf_and_mahalanobis(spark):
    rng = np.random.default_rng(1)
    x = rng.multivariate_normal([0, 0], [[1, 0.9], [0.9, 1]], 400)
    rows = [(i, "s", float(a), float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, speaker string, a double, b double")
    base = B.fit_baselines(df, "speaker", ["a", "b"])
    at = spark.createDataFrame([(1, "s", 2.0, 2.0), (2, "s", 2.0, -2.0)], df.schema)
    got = {r["id"]: r for r in B.anomalies(at, base, "speaker", ["a", "b"], (1.0, 1.0)).collect()}
    assert got[2]["mahalanobis"] > 2 * got[1]["mahalanobis"]  # against the correlation is further than along it
    assert got[1]["projection"] > 1 and abs(got[2]["projection"]) < 0.5
    for r in got.values():
        assert math.isclose(r["attribution_a"] + r["attribution_b"], 1, abs_tol=1e-9)
    # numpy's form of the same shrinkage
    centred = x - x.mean(axis=0)
    s = centred.T @ centred / len(x)
    mu = np.trace(s) / 2
    delta = ((s - mu * np.eye(2)) ** 2).sum() / 2
    beta = ((centred**2).T @ (centred**2) / len(x) - s**2).sum() / (2 * len(x))
    shrink = min(beta, delta) / delta
    cov = B.covariances(B.speaker_moments(df, "speaker", ["a", "b"]), "speaker", ["a", "b"]).first()
    assert math.isclose(cov["intensity"], shrink, rel_tol=1e-6)


def test_few_rows_are_invertible(spark):
    for n in (2, 3, 4):
        df = spark.createDataFrame([(i, "s", float(i), float(i * i)) for i in range(n)], "id int, speaker string, a double, b double")
        p = B.fit_baselines(df, "speaker", ["a", "b"]).first()["precision"]
        assert all(math.isfinite(v) for v in p)


def test_chi2_closed_form(spark):
    d2 = 7.3
    got = spark.range(1).select(B.chi2_tail(F.lit(d2), 6).alias("p")).first()["p"]
    h = d2 / 2
    assert math.isclose(got, math.exp(-h) * (1 + h + h * h / 2), rel_tol=1e-12)


def test_residualise_removes_length_and_time(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(w), float(t), float(0.3 * math.log(w) + 0.1 * t + rng.normal(0, 0.01))) for i, (w, t) in enumerate(zip(rng.integers(50, 900, 220), rng.uniform(0, 9, 220)))]
    df = spark.createDataFrame(rows, "id int, words int, t double, y double")
    res = B.residualise(df, ["y"])
    assert B.variance_explained(res, ["y"]).first()["explained"] > 0.95
    assert abs(res.select(F.corr("resid_y", F.log("words"))).first()[0]) < 1e-6


@pytest.mark.parametrize(("labels", "auc"), [((0, 0, 1, 1), 1.0), ((1, 1, 0, 0), 0.0), ((0, 1, 0, 1), 0.75), ((1, 1, 1, 1), 0.5)])
def test_auc(spark, labels, auc):
    df = spark.createDataFrame(list(zip((1.0, 2.0, 3.0, 4.0), labels)), "s double, y int")
    assert S.auc(df, "s", "y").first()["auc"] == auc


def test_calibration(spark):
    good = [(0.05, 0)] * 48 + [(0.05, 1)] * 2 + [(0.95, 1)] * 48 + [(0.95, 0)] * 2
    bad = [(0.95, 0)] * 50 + [(0.05, 1)] * 50
    ece = [S.calibration_error(spark.createDataFrame(r, "p double, y int"), "p", "y").first()["ece"] for r in (good, bad)]
    assert ece[0] < 0.05 < 0.8 < ece[1]


def test_permutation(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        level = rng.normal() * 3
        rows += [(g * 8 + i, g, float(level + rng.normal()), float(level + rng.normal())) for i in range(8)]
    df = spark.createDataFrame(rows, "id int, g int, x double, y double")
    free = S.permutation_test(df, "x", "y", "id", 150).first()
    blocked = S.permutation_test(df, "x", "y", "id", 150, "g").first()
    assert free["p_value"] <= 1 / 151 + 1e-9 and free["p_value"] > 0
    assert blocked["p_value"] > free["p_value"]  # between-group level is not evidence inside groups
    again = S.permutation_test(df.repartition(7), "x", "y", "id", 150).first()
    assert math.isclose(again["null_mean"], free["null_mean"], abs_tol=1e-9)


def test_game(spark):
    p = F.lit
    row = spark.range(1).select(
        G.constraint_at(p(None).cast("int"), p(0.15), p(0.85)).alias("none"),
        G.constraint_at(p(0), p(0.15), p(0.85)).alias("near"),
        G.constraint_at(p(60), p(0.15), p(0.85)).alias("far"),
        G.best_response(p(0.0), p(0.5), p(0.6), p(0.45), p(0.0)).alias("nothing"),
        G.best_response(p(0.5), p(0.5), p(0.6), p(0.45), p(1.0)).alias("read"),
        G.best_response(p(0.5), p(0.5), p(0.6), p(0.45), p(0.0)).alias("unread"),
    ).first()
    assert (row["none"], row["near"]) == (0.0, 1.0) and math.isclose(row["far"], 0.15)
    assert row["nothing"]["theta_held"] == 0 and row["unread"]["register"] == 1.0 and row["read"]["register"] < 1
    with pytest.raises(ValueError, match="unknown"):
        G.resolve_population({"martian": 1.0})
    with pytest.raises(ValueError):
        G.resolve_population({"null": 0.0})


def test_simulated_worlds(spark):
    world = N.simulate(spark, 3)
    assert world.count() == 3 * 14 * 9
    assert world.exceptAll(N.simulate(spark, 3).repartition(5)).isEmpty()
    honest = N.simulate(spark, 2, population={"null": 1.0})
    assert honest.agg(F.max("theta_held")).first()[0] == 0


def test_logistic(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=60) > 0).astype(float)
    w, b = learn.newton_logistic(x, y, 1.0)
    q = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.allclose(w + x.T @ (q - y), 0, atol=1e-6) and abs((q - y).sum()) < 1e-6
    rows = [(i, i % 6, float(t), float(a), float(c)) for i, (t, (a, c)) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "id int, g int, y double, a double, b double").repartition(3)
    oof = learn.grouped_cv(df, "id", "g", "y", ["a", "b"]).collect()
    g = np.arange(60) % 6
    for r in oof:
        model = learn.fit_scaled(x[g != r["grp"]], y[g != r["grp"]], r["c"])
        assert r["p"] == pytest.approx(float(learn.predicted(model, x[[r["id"]]])[0]), abs=1e-6)
    assert len(oof) == 60 * len(learn.C_GRID)
    report = learn.cv_report(spark.createDataFrame(oof))
    assert report.agg(F.min("auc")).first()[0] > 0.9


def test_leave_one_out(spark):
    rows = [(i, i % 4, float(i % 3), float((i * 7) % 5)) for i in range(24)]
    df = spark.createDataFrame(rows, "id int, g int, y double, x double")
    mean = {r["id"]: r["m"] for r in learn.leave_one_out_mean(df, "y", "m", ["g"]).collect()}
    for i, g, _, _ in rows:
        assert mean[i] == pytest.approx(np.mean([y for j, h, y, _ in rows if h == g and j != i]))
    fit = lambda x, y: np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]), y, rcond=None)[0]
    predict = lambda m, x: x @ m[:-1] + m[-1]
    got = {r["id"]: r["predicted"] for r in learn.leave_one_out_predict(df, "id", "id", ["x"], "y", fit, predict).collect()}
    x, y = np.array([[r[3]] for r in rows]), np.array([r[2] for r in rows])
    for i in range(24):
        own = np.arange(24) != i
        assert got[i] == pytest.approx(float(predict(fit(x[own], y[own]), x[[i]])[0]))


def test_html_body_and_title(spark):
    page = '<html><head><title> A   title\n</title></head><nav>menu</nav><div class="x">skip</div><div class="col col-xs-12 y"><p>One&nbsp;two &mdash; three</p><script>no()</script></div>'
    row = spark.createDataFrame([(page,)], "h string").select(H.strip_html(F.col("h")).alias("t"), H.title(F.col("h")).alias("n"), H.title(F.lit("<p>")).alias("none")).first()
    assert (row["t"], row["n"], row["none"]) == ("One two — three", "A title", "Speech")


def test_corpus_round_trip(spark, tmp_path):
    one = '{"speaker": "A. B", "date": "2024-01-25", "window": "baseline", "text": "x"}'
    (tmp_path / "first-id.json").write_text(one)
    (tmp_path / "second.json").write_text(one.replace('"speaker"', '"id": "own", "speaker"'))
    (tmp_path / "broken.json").write_text("{not json")
    got = corpus.load_corpus(spark, str(tmp_path))
    assert {r["id"] for r in got.collect()} == {"first-id", "own"}
    assert corpus.load_corpus(spark, str(tmp_path), with_corrupt=True).count() == 3
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "broken.json").write_text("{not json")
    with pytest.raises(ValueError):
        corpus.load_corpus(spark, str(empty))
    corpus.export_document(spark.createDataFrame([(1, float("nan"), 2)], "id int, x double, _hidden int"), str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"id":1}']


def test_streaming_baselines(spark, tmp_path):
    rows = [(i % 3, float(i), float(i * i % 7)) for i in range(40)]
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    df = spark.createDataFrame(rows, "speaker int, a double, b double")
    df.repartition(4).write.parquet(src)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    stream.maintain(source, "speaker", ["a", "b"], state, str(tmp_path / "ck")).awaitTermination(120)
    total = stream.merged(spark.read.parquet(state), "speaker")
    got = {r["speaker"]: r for r in stream.baseline_of(total, "speaker", ["a", "b"]).collect()}
    want = {r["speaker"]: r for r in df.groupBy("speaker").agg(F.count("*").alias("n"), F.avg("a").alias("m"), F.stddev_samp("b").alias("s")).collect()}
    for k, w in want.items():
        assert got[k]["n"] == w["n"] and math.isclose(got[k]["mean_a"], w["m"]) and math.isclose(got[k]["sd_b"], w["s"])


def test_speakers_needed_branches(spark):
    def status(points):
        return studies.speakers_needed(spark.createDataFrame(points, "size int, power double")).first()["status"]

    assert status([(4, 0.1), (8, 0.2)]) == "insufficient_points"
    assert status([(4, 0.0), (8, 0.01), (9, 0.0)]) == "no_power"
    assert status([(4, 0.3), (8, 0.2), (9, 0.1)]) == "power_not_increasing"
    assert status([(4, 0.1), (9, 0.3), (16, 0.5)]) == "ok"


def test_surprise_is_the_same_for_broadcast_and_joined_words(spark):
    """Frequent pairs of speaker and word are looked up, rare ones joined; rows of the same keys are one statement."""
    rows = [(i, f"s{i % 3}", "constrained" if i % 5 == 0 else "baseline", " ".join(f"w{'abcdefghij'[(i * j) % 10]}" for j in range(i % 7 + 1))) for i in range(40)]
    rows += [(3, "s0", "baseline", "wa later wa"), (90, "alone", "baseline", "wa"), (91, None, "baseline", "wa wb"), (92, "s1", "constrained", None)]
    st = spark.createDataFrame(rows, "id int, speaker string, window string, text string")
    speakers = L.speaker_totals(st)
    found = [{tuple(r[:3]): tuple(r[3:]) for r in L.statement_surprise(st, speakers, head=h).collect()} for h in (1, 20, 1 << 18)]
    assert found[0].keys() == found[1].keys() == found[2].keys()
    assert len(found[0]) == 40 and ("s0", 3, "baseline") in found[0]
    assert found[0][("s0", 3, "baseline")][0] == 4 + 3
    for k, v in found[0].items():
        assert v == pytest.approx(found[1][k], abs=1e-12) and v == pytest.approx(found[2][k], abs=1e-12)


def test_blocks_are_shuffled_where_they_lie(spark, monkeypatch):
    """The same sums as from rows shuffled in every replicate, also for blocks too large for one task; no replicate of rows is exchanged."""
    rows = [(i, None if i == 7 else f"s{i % 4}", float((i * 37) % 101), float((i * i) % 53)) for i in range(200)] + [(300, "one", 3.0, 4.0)]
    df = spark.createDataFrame(rows, "id long, speaker string, a double, b double")
    want = S.permuted(df, ["a"], "b", "id", 12, ["speaker"], 7).groupBy("_perm", "speaker").agg(F.sum(F.col("a") * F.col("shuffled")).alias("xy"), F.count("*").alias("n"))
    want = {(r["_perm"], r["speaker"]): (r["n"], r["xy"]) for r in want.collect()}
    for most in (1 << 16, 0):
        monkeypatch.setattr(S, "_BLOCK_ROWS", most)
        got = {(r["_perm"], r["speaker"]): (r["n"], r["xy"] + r["n"] * r["mx"] * r["my"]) for r in S.block_products(df, "a", "b", "id", 12, ["speaker"], 7).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
