"""Resampling queries against a definition in plain Python, over all constrained events."""

import hashlib

import numpy as np
import pytest

import __spark_entry__ as entry
from tidemark.plans.validation_queries import _constrained


@pytest.fixture(scope="module")
def sf():
    """The least of the driver's tables that has speakers of 25 and above."""
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def events(spark, sf):
    found = sorted((r["id"], r["speaker"], r["value"], r["k"]) for r in _constrained(spark, sf).collect())
    assert any(r[1] >= 25 for r in found)
    return found


def rankdata(x):
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def digest(rep, x):
    return hashlib.md5(f"{rep}-{x}-7".encode()).hexdigest()


def rho(x, y):
    return np.corrcoef(rankdata(x), rankdata(y))[0, 1]


@pytest.mark.parametrize("name, block", [("q_permutation", False), ("q_permutation_blocked", True)])
def test_permutation(spark, sf, events, name, block):
    ids, speakers = [r[0] for r in events], [r[1] if block else 0 for r in events]
    x, y = rankdata([r[2] for r in events]), rankdata([r[3] for r in events])
    members = {}
    for i, s in enumerate(speakers):
        members.setdefault(s, []).append(i)
    null = []
    for rep in range(200):
        z = np.empty(len(y))
        for own in members.values():
            z[own] = y[sorted(own, key=lambda i: (digest(rep, ids[i]), ids[i]))]
        null.append(np.corrcoef(x, z)[0, 1])
    seen = np.corrcoef(x, y)[0, 1]
    p = (sum(abs(s) >= abs(seen) - 1e-12 for s in null) + 1) / 201
    got = entry.queries()[name](spark, sf).first()
    assert got["n_perm"] == 200
    assert [got[c] for c in ("observed", "p_value", "null_mean", "null_sd")] == pytest.approx([seen, p, np.mean(null), np.std(null)], abs=2e-6)


def test_bootstrap(spark, sf, events):
    n, x, y = len(events), np.array([r[2] for r in events]), np.array([r[3] for r in events])
    found = []
    for rep in range(100):
        drawn = [int(digest(rep, i)[:8], 16) % n for i in range(n)]
        found.append(rho(x[drawn], y[drawn]))
    got = entry.queries()["q_bootstrap_ci"](spark, sf).first()
    assert [got["lo"], got["hi"]] == pytest.approx(np.quantile(found, [0.025, 0.975]), abs=2e-6)
