"""Steps that were too dear on large tables: what they move and read, and that results stay."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import langmodel as L
from tidemark.operators import lexical as X
from tidemark.operators import scoring as P
from tidemark.operators import validate as S

TEXTS = ["", None, "It's  12,5% of\tQ3's", "\u212aelvin \u0130stanbul \u00c4rger na\u00efve", "''quoted'' MAY 2024may", "\u65e5\u672c x\u00a0y\u2019s", "first quarter 5m 7 bps 1st"]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_words_are_those_of_the_pattern(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    for i, text, want in rows.select("id", "text", L.tokens(F.coalesce("text", F.lit(""))).alias("w")).collect():
        assert [x.decode() for x in L._split(text.encode() if text is not None else None)] == want, i


def test_words_are_summed_before_they_move(spark):
    st = spark.createDataFrame(
        [(1, "a", "baseline", "x x y"), (2, "a", "constrained", "x z"), (3, "b", "baseline", None), (4, "b", "baseline", "Y'"), (5, None, "baseline", "x")],
        "id int, speaker string, window string, text string",
    )
    got = {(r["speaker"], r["word"]): (r["c_s"], r["c_all"]) for r in L.word_counts(st).collect()}
    assert got == {("a", "x"): (2, 3), ("a", "y"): (1, 1), ("a", "z"): (None, 1), ("b", "y'"): (1, 1), (None, "x"): (1, 1)}
    assert {tuple(r) for r in L.speaker_totals(st).collect()} == {("b", 1)}
    made = plan(L.word_counts(st))
    assert "regexp_extract_all" not in made and "Generate" not in made


def test_small_tallies_pass_on_what_they_hold(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(L, "_TALLIED", 1)
    batches = [pa.RecordBatch.from_pydict({"speaker": ["a", "b"], "base": [True, False], "text": ["x y x", "x"]}) for _ in range(3)]
    found = list(L._tallied(1, ["speaker", "word", "s", "n"])(iter(batches)))
    rows = [r for b in found for r in b.to_pylist()]
    assert len(rows) == 9 and sum(r["n"] for r in rows) == 12 and sum(r["s"] for r in rows) == 9


def test_markers_match_as_their_patterns(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "text string")
    plain = [F.regexp_count("text", F.lit("(?i)" + p)) for p in (X.fixed.NUMERIC_PATTERN, X.fixed.PERIOD_PATTERN)]
    for r in rows.select(X.numeric_markers(F.col("text")), X.period_markers(F.col("text")), *plain).collect():
        assert (r[0], r[1]) == (r[2], r[3])


def test_hits_of_phrases_beyond_ascii(spark):
    rows = spark.createDataFrame([("caf\u00e9 caf\u00e9 cafe",)], "text string")
    assert rows.select(X.phrase_hits(F.col("text"), ["caf\u00e9"])).first()[0] == 2


def test_baseline_view_moves_no_texts_but_the_representatives(spark, sf):
    from tidemark.plans.flagship_queries import _measured

    st, m = _measured(spark, sf)
    view = P.baseline_view(st, m, X.PROXY)
    made = view._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"regexp_count|split\(", made), "markers and words are those of the feature rows"
    texts = {r["id"]: r["text"] for r in st.select("id", "text").collect()}
    for r in view.collect():
        own = [s for s in r["statements"] if s["representative"]]
        assert len(own) == 1 and own[0]["text"] == texts[own[0]["id"]]
        assert all(s["text"] is None for s in r["statements"] if not s["representative"])
    wanted = P.evidence_record(F.coalesce(F.col("text"), F.lit("")), X.PROXY)
    want = {r["id"]: r["e"] for r in st.select("id", wanted.alias("e")).collect()}
    assert all(s["evidence"] == want[s["id"]] for r in view.collect() for s in r["statements"])


@pytest.mark.parametrize("share, pairs", [(1 << 15, 1 << 21), (16, 64), (7, 1)])
def test_whole_shuffles_are_those_of_permuted(spark, monkeypatch, share, pairs):
    """In any cut into parts and packets; rows do not move in each replicate."""
    monkeypatch.setattr(S, "_SHARE", share)
    monkeypatch.setattr(S, "_PAIRS", pairs)
    df = spark.range(0, 150).select((F.col("id") * 7 + 3).alias("id"), (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") * 11 % 13).cast("double").alias("y"))
    ranked = S.average_ranks(S.average_ranks(df, "x", "_rx"), "y", "_ry").select("id", "_rx", "_ry")
    want = {r[0]: r[1] for r in S.permuted(ranked, ["_rx"], "_ry", "id", 9).groupBy("_perm").agg(F.corr("_rx", "shuffled")).collect()}
    null = S._whole_null(ranked.repartition(5), "id", 9, 7)
    assert {r["_perm"]: r["s"] for r in null.collect()} == pytest.approx(want, abs=1e-12) and len(want) == 9


def test_whole_permutations_move_packets(spark):
    df = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    assert "shuffled" not in plan(S.permutation_test(df, "x", "y", "id", 20))
    assert S.permutation_test(df.where("id < 0"), "x", "y", "id", 20).collect() == []
    assert S.permutation_test(df.where("id < 1"), "x", "y", "id", 20).collect() == []


def resampled(rows, n_boot):
    """The interval by its definition."""
    rows = sorted(rows)
    rank = lambda v: (lambda u: (np.cumsum(u[2]) - (u[2] - 1) / 2)[u[1]])(np.unique(v, return_inverse=True, return_counts=True))
    found = []
    for rep in range(n_boot):
        drawn = [rows[int(hashlib.md5(f"{rep}-{i}-7".encode()).hexdigest()[:8], 16) % len(rows)] for i in range(len(rows))]
        x, y = rank([r[1] for r in drawn]), rank([r[2] for r in drawn])
        found.append(0.0 if x.std() * y.std() < 1e-12 else np.corrcoef(x, y)[0, 1])
    return np.quantile(found, [0.025, 0.975])


_SIDES = [("id * 37 % 101", "id * 11 % 13"), ("id * 89 % 307 / 7", "if(id % 3 = 0, 1, id * 53 % 211)"), ("id % 2", "if(id % 10 = 0, double('NaN'), -id)"), ("1", "id")]


@pytest.mark.parametrize("places, pairs, x, y", [(1 << 16, 1 << 21, *_SIDES[1]), (16, 64, *_SIDES[0]), (7, 1, *_SIDES[0]), (16, 64, *_SIDES[1]), (16, 64, *_SIDES[2]), (50, 1 << 10, *_SIDES[3])])
def test_resampled_ranks_in_any_cut(spark, monkeypatch, places, pairs, x, y):
    """Parts, packets and ties across them do not change the interval; a pair with a null takes no part."""
    monkeypatch.setattr(S, "_PLACES", places)
    monkeypatch.setattr(S, "_PAIRS", pairs)
    df = spark.range(150).selectExpr("id * 7 + 3 as id", f"cast({x} as double) as x", f"cast({y} as double) as y")
    want = resampled([tuple(np.nan_to_num(r, nan=1e9)) for r in df.collect()], 12)
    got = S.bootstrap_ci(df.unionByName(spark.sql("select 5L as id, cast(null as double) as x, 1d as y")).repartition(5), "x", "y", "id", 12).first()
    assert [got["lo"], got["hi"]] == pytest.approx(want, abs=1e-9) and got["n_boot"] == 12


def test_resampled_rows_do_not_move_in_each_replicate(spark):
    df = spark.range(400).selectExpr("id", "cast(id * 37 % 101 as double) as x", "cast(id % 13 as double) as y")
    made = S.bootstrap_ci(df, "x", "y", "id", 20)
    assert "md5" not in plan(made) and "Window" not in plan(made)
    assert made.first()["n_boot"] == 20
    none = S.bootstrap_ci(df.where("id < 0"), "x", "y", "id", 20).first()
    assert (none["lo"], none["hi"], none["n_boot"]) == (None, None, 0)
    assert tuple(S.bootstrap_ci(df.where("id < 1"), "x", "y", "id", 20).first()) == (0.0, 0.0, 20)


def test_rows_drawn_more_often_than_a_byte_holds():
    for counts in (np.array([[3, 255]]), np.array([[3, 256]])):
        assert (S._wide(S._narrow(counts), 1, 2) == counts).all()
