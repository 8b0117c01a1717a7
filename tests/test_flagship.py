"""The flagship against plain numpy, worlds against single worlds, and properties of the studies."""

import json
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.fixed import CONTROLLED, EVASION, FEATURES
from tidemark.operators import baseline as B
from tidemark.operators import generate as N
from tidemark.operators import lexical as X
from tidemark.operators import scoring as P
from tidemark.operators import validate as S
from tidemark.operators import worldstudies as W
from tidemark.operators.lineage import cut
from tidemark.plans.flagship_queries import described, q_runtime_model
from tidemark.sources import corpus

from .conftest import SF


def ledoit_wolf(x):
    n, p = x.shape
    if n < 3:
        return np.diag(np.maximum(x.var(axis=0), 1e-3))
    c = x - x.mean(axis=0)
    s = c.T @ c / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = (((c**2).sum(axis=1) ** 2).sum() / n - (s**2).sum()) / (p * n)
    shrink = 0.0 if beta <= 0 else min(beta, delta) / delta
    return (1 - shrink) * s + (shrink * mu + 1e-4) * np.eye(p)


@pytest.fixture(scope="module")
def measured(spark, sf):
    st = described(spark, sf)
    return st, P.measure(st, X.PROXY)


def slow(rows):
    """Residuals, baselines and scores of one world by definition."""
    y = np.array([[r[f] for f in FEATURES] for r in rows])
    lw, t = np.log([max(r["words"], 1) for r in rows]), np.array([r["t"] for r in rows])
    x = np.column_stack([np.ones(len(rows)), *[(v - v.mean()) / max(v.std(), 1e-6) for v in (lw, t)]])
    beta = np.linalg.solve(x.T @ x + 1e-6 * np.eye(3), x.T @ y)
    resid = y - x @ beta + y.mean(axis=0)
    by = {}
    for i, r in enumerate(rows):
        if r["window"] == "baseline":
            by.setdefault(r["speaker"], []).append(resid[i])
    by = {s: np.array(v) for s, v in by.items() if len(v) >= 2}
    means = np.array([v.mean(axis=0) for v in by.values()])
    pop, between = means.mean(axis=0), means.var(axis=0, ddof=1) if len(means) > 1 else np.ones(len(FEATURES))
    within = np.mean([v.var(axis=0, ddof=1) for v in by.values()], axis=0)
    base = {}
    for s, v in by.items():
        noise = within / len(v)
        tau = np.maximum(between - noise, 1e-6)
        w = np.clip(np.mean(tau / (tau + noise)), 0, 1)
        base[s] = (w * v.mean(axis=0) + (1 - w) * pop, np.linalg.pinv(ledoit_wolf(v)))
    out = {}
    direction = np.array(EVASION)
    for i, r in enumerate(rows):
        if r["window"] == "constrained" and r["speaker"] in base:
            mean, precision = base[r["speaker"]]
            d = resid[i] - mean
            d2 = d @ precision @ d
            h = d2 / 2
            out[r["id"]] = (math.sqrt(d2), math.exp(-h) * (1 + h + h * h / 2), d @ precision @ direction / math.sqrt(direction @ precision @ direction))
    return out


def test_six_features_against_numpy(measured):
    _, m = measured
    want = slow(m.rows.collect())
    got = {r["id"]: (r["mahalanobis"], r["p_chi2"], r["evasion"]) for r in m.anomalies.collect()}
    assert got.keys() == want.keys() and len(got) > 10
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-6, abs=1e-9)


def test_records(measured):
    st, m = measured
    found = P.records(st, m, X.PROXY).collect()
    assert len(found[0]) == 29
    assert [r["evasion"] for r in found] == sorted((r["evasion"] for r in found), reverse=True)
    r = found[0]
    assert set(r["scores"]) == set(FEATURES) and r["k"] == 6 and abs(sum(r["attribution"].values()) - 1) < 1e-3
    assert float(f"{r['p_chi2']:.6g}") == r["p_chi2"] and r["outcome"] in ("miss", "beat", "inline")
    assert [x["id"] for x in P.top_records(P.records(st, m, X.PROXY)).collect()] == [x["id"] for x in found[:8]]


def test_baseline_view(measured):
    st, m = measured
    for r in P.baseline_view(st, m, X.PROXY).collect():
        dates = [(x["date"], x["id"]) for x in r["statements"]]
        assert dates == sorted(dates)
        assert [x["text"] is not None for x in r["statements"]] == [x["representative"] for x in r["statements"]] and sum(x["representative"] for x in r["statements"]) == 1


def test_probe_of_an_own_statement(measured):
    """A statement put in as a pasted text gets its own features and, but for time, its own residual."""
    st, m = measured
    one = m.anomalies.where("not insufficient").orderBy("id").first()
    text = st.where(F.col("id") == one["id"]).select(F.lit(1).alias("text_id"), "text")
    got = P.probe(text, st, m, X.PROXY).where(F.col("speaker") == one["speaker"]).first()
    for f in FEATURES:
        assert got[f] == pytest.approx(one[f], abs=2e-3), f
    assert got["cross_entropy"] == pytest.approx(one["cross_entropy"], abs=2e-4)


def test_learned_direction_and_block(spark, measured):
    st, m = measured
    scored = cut(P.with_outcomes(m, st.select("id", "outcome_move_pct")))
    report, out = P.learn_direction(scored, m)
    assert report["status"] == "ok" and report["n"] == scored.count() and np.linalg.norm(report["direction"]) == pytest.approx(1)
    block = P.validation_block(cut(out), 50, 50).first()
    assert block["status"] == "ok" and block["n"] == report["n"] and 0 < block["p_evasion"] <= 1 and block["ci_lo"] <= block["ci_hi"]
    few, same = P.learn_direction(scored.limit(4), m)
    assert few["status"] == "insufficient_data" and all(r["directional"] == r["mahalanobis"] for r in same.collect())


def test_worlds_are_scored_one_by_one(spark):
    table = N.worlds(spark, 2, [{"effect": 0.0}, {"effect": 0.6}], CONTROLLED, 5)
    st = cut(N.controlled_corpus(table))
    m = P.measure(st, None, W.WORLD)
    rows = m.rows.collect()
    got = {(r["grid"], r["rep"], r["id"]): r["evasion"] for r in m.anomalies.collect()}
    assert len(got) == 4 * 14 * 3
    for g in (0, 1):
        for rep in (0, 1):
            want = slow([r for r in rows if (r["grid"], r["rep"]) == (g, rep)])
            for k, v in want.items():
                assert got[(g, rep, k)] == pytest.approx(v[2], rel=1e-5, abs=1e-6)
    alone = P.measure(st.where("grid = 1 and rep = 1"), None)
    for r in alone.anomalies.collect():
        assert got[(1, 1, r["id"])] == pytest.approx(r["evasion"], rel=1e-6)


def test_planted_effects_are_measured(spark):
    """An effect that all speakers share goes with the time trend (constrained statements are a year later); differences between speakers stay."""
    st = cut(N.controlled_corpus(N.worlds(spark, 6, None, CONTROLLED, 400)))
    scores = X.lexical_scores(st).groupBy("window").agg(F.avg("hedging").alias("h"), F.avg("specificity_avoidance").alias("s")).collect()
    raw = {r["window"]: r for r in scores}
    assert raw["constrained"]["h"] > raw["baseline"]["h"] + 0.1 and raw["constrained"]["s"] > raw["baseline"]["s"] + 0.05
    ranked = W.recovery_ranking(W.score_worlds(st, ("true_effect", "outcome_move_pct"))).collect()
    assert len(ranked) == 6 and np.mean([r["spearman_recovered_vs_true"] for r in ranked]) > 0.2


def test_the_game_writes_what_it_holds(spark):
    st = cut(N.simulate(spark, 3, [{"adoption": 0.0}, {"adoption": 1.0}], seed=9))
    assert st.count() == 2 * 3 * 14 * 9 and st.where("window = 'baseline' and theta_held <> 0").isEmpty()
    assert st.select("grid", "rep", "id").distinct().count() == st.count()
    seats = {r["archetype"]: r["n"] for r in st.where("grid = 0 and rep = 0").groupBy("archetype").agg(F.countDistinct("speaker").alias("n")).collect()}
    assert seats["naive_executive"] == 6 and sum(seats.values()) == 14
    again = {r["id"]: r["text"] for r in N.simulate(spark, 3, [{"adoption": 0.0}], seed=9).where("rep = 1").repartition(3).collect()}
    assert again == {r["id"]: r["text"] for r in st.where("grid = 0 and rep = 1").collect()}
    reg = {r["grid"]: r["r"] for r in st.where("theta_held > 1e-6").groupBy("grid").agg(F.avg("register").alias("r")).collect()}
    assert reg[1] < reg[0]  # the more read they are, the more they refuse
    with pytest.raises(ValueError):
        N.simulate(spark, 1, [{"population": {"nobody": 1.0}}])


def test_neighbours_and_posterior(spark):
    scored = W.score_worlds(cut(N.simulate(spark, 3, seed=3)), ("archetype", "theta_held", "register", "days_to_disclosure", "outcome_move_pct"))
    ref = W.reference_table(scored)
    near = cut(W.neighbours(scored.where("rep = 0"), ref))
    rows = ref.collect()
    z = np.array([[r[f"z_{f}"] for f in FEATURES] for r in rows])
    scale = np.maximum(z.std(axis=0), 1e-6)
    one = scored.where("rep = 0").orderBy("id").first()
    d = np.linalg.norm((z - np.array([one[f"z_{f}"] for f in FEATURES])) / scale, axis=1)
    got = near.where(F.col("id") == one["id"]).collect()
    assert len(got) == 40 and sorted(r["d"] for r in got) == pytest.approx(np.sort(d)[:40], abs=1e-9)
    assert sum(r["w"] for r in got) == pytest.approx(1)
    post = W.posterior(near).where(F.col("id") == one["id"]).first()
    assert post["theta_mean"] == pytest.approx(sum(r["w"] * r["theta_held"] for r in got), abs=1e-4) and post["theta_q10"] <= post["theta_q50"] <= post["theta_q90"]
    bins = W.posterior_histogram(near, ref).where(F.col("id") == one["id"]).collect()
    assert len(bins) == 12 and sum(r["p"] for r in bins) == pytest.approx(1, abs=1e-3)


def test_chi_squared_tails(spark):
    # Known upper tails: k = 1 at 3.841, k = 3 at 7.815, k = 5 at 11.070, k = 4 at 9.488 are all 0.05.
    for k, x in ((1, 3.841458820694124), (3, 7.814727903251179), (5, 11.070497693516351), (4, 9.487729036781154)):
        got = spark.range(1).select(B.chi2_tail(F.lit(x), k).alias("p"), B.chi2_tail(F.lit(0.0), k).alias("one")).first()
        assert got["p"] == pytest.approx(0.05, abs=1e-9) and got["one"] == pytest.approx(1)


def test_documents_and_studies_on_disk(spark, tmp_path):
    df = spark.sql("select 1 as a, named_struct('x', double('nan'), '_y', 2, 'z', array(named_struct('_k', 1, 'v', double('nan')))) as s, map('_m', 1.0d, 'n', double('nan')) as m, 3 as _hidden")
    corpus.export_document(df, str(tmp_path / "doc"))
    assert spark.read.text(str(tmp_path / "doc")).first()[0] == '{"a":1,"s":{"z":[{}]},"m":{"n":null}}'
    corpus.save_study(spark.range(3), str(tmp_path / "studies"), "one", 'A "first" study')
    corpus.save_study(spark.range(2), str(tmp_path / "studies"), "two")
    got = [(r["name"], r["title"], r["n_rows"]) for r in corpus.study_index(spark, str(tmp_path / "studies")).collect()]
    assert got == [("one", 'A "first" study', 3), ("two", "", 2)]


def test_pages_are_fetched_by_the_executors(spark):
    import http.server
    import threading

    from tidemark.sources.fetch import fetch

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            found = self.path.startswith("/page")
            self.send_response(200 if found else 404)
            self.end_headers()
            self.wfile.write(("\ufeff<title>" + self.path + "</title>" + self.headers["User-Agent"]).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    got = {r["url"]: r for r in fetch(spark, [f"{at}/page{i}" for i in range(20)] + [f"{at}/none", "http://127.0.0.1:1/x"], agent="tester").collect()}
    server.shutdown()
    assert len(got) == 22 and got[f"{at}/page7"]["html"] == "<title>/page7</title>tester" and got[f"{at}/page7"]["error"] is None
    assert got[f"{at}/none"]["html"] is None and "404" in got[f"{at}/none"]["error"] and got["http://127.0.0.1:1/x"]["error"]


def test_nulls_have_no_rank(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, None, 4.0), (3, 3.0, None), (4, 2.0, 1.0), (5, 9.0, 9.0), (6, 4.0, 2.0)], "id int, x double, y double")
    ranks = {r["id"]: r["r"] for r in S.average_ranks(df, "x", "r").collect()}
    assert ranks == {1: 1.0, 2: None, 3: 3.0, 4: 2.0, 5: 5.0, 6: 4.0}
    assert S.spearman(df, "x", "y").first()["n"] == 4


def test_runtime_model_holds_every_word(measured):
    """The counts of all words of every modelled speaker and of all statements, in one document or dealt over several."""
    st, m = measured
    everyone, own, n = Counter(), {}, Counter()
    for r in st.select("speaker", "window", "text").collect():
        words = re.findall("[a-z']+", (r["text"] or "").lower())
        everyone.update(words)
        if r["window"] == "baseline":
            n[r["speaker"]] += 1
            own.setdefault(r["speaker"], Counter()).update(words)
    want = {("background", "all"): everyone} | {("language_model", s): c for s, c in own.items() if n[s] >= 2 and c}
    for model, most in ((q_runtime_model(st.sparkSession, SF), 1 << 16), (corpus.runtime_model(st, m, X.PROXY, words=1000), 1000)):
        got, pieces = {}, Counter()
        for r in model.where("part in ('background', 'language_model')").collect():
            value, key = json.loads(r["value"]), (r["part"], r["name"])
            assert not value["truncated"] and not value["words"].keys() & got.get(key, {}).keys() and len(value["words"]) < 1.2 * most
            assert (value["total"], value["vocabulary"], value["pieces"]) == (sum(want[key].values()), len(want[key]), -(-len(want[key]) // most))
            got.setdefault(key, {}).update(value["words"])
            pieces[key] += 1
        assert got == want and all(pieces[k] == -(-len(want[k]) // most) for k in want)
