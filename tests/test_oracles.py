"""Every query with a SQL equivalent gives the same rows in DuckDB."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

#: Checked for rows by the driver; their operators are tested in ``test_flagship``.
SLOW = {
    "q_adoption_sweep", "q_archetype_rates", "q_archetype_summary", "q_design_grid", "q_dose_predicted", "q_feature_survival", "q_heterogeneity",
    "q_material_probability", "q_model_report", "q_posterior_histogram", "q_posterior_windows", "q_recovery", "q_recovery_ranking", "q_scenarios", "q_top_evasive", "q_validation_block",
}
NAMES = sorted(n for n in entry.queries() if n.startswith("q_") and n not in SLOW)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def shown(x):
    if isinstance(x, float):
        return None if math.isnan(x) else f"{x:.4f}".replace("-0.0000", "0.0000")
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)[:10]
    return None if x is None else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(r[i]) or "" for i in order) for r in data)


def close(a, b):
    if a == b:
        return True
    try:
        return abs(float(a) - float(b)) <= 1.01e-4 * max(1.0, abs(float(a)))
    except ValueError:
        return False


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, sf, name):
    frame = entry.queries()[name](spark, sf)
    mine = rows(frame.columns, frame.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert mine
        return
    result = duck.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    theirs = rows(columns, result.fetchall())
    assert len(mine) == len(theirs)
    assert all(close(x, y) for a, b in zip(mine, theirs, strict=True) for x, y in zip(a, b, strict=True))


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0
    assert frame.columns[:2] == ["id", "speaker"] and frame.columns[-1] == "evasion" and len(frame.columns) == 29
