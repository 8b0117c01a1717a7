"""L2 logistic regression with leave-one-speaker-out validation, and handpicked directions.

The penalised likelihood is convex and small (a handful of features).  All folds
and all values of C are fitted together: in every Newton step one pass over the
rows adds up, for each model, the gradient and the Hessian of the rows that do
not belong to its held-out speaker.  The table is never copied for a fold, no
task holds more than one Arrow batch of it, and the driver holds the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validate import auc

C_GRID = (0.03, 0.1, 0.3, 1.0)


def newton_logistic(x: np.ndarray, y: np.ndarray, c: float, steps: int = 100) -> tuple[np.ndarray, float]:
    """Minimises ``|w|^2 / 2 + C * sum(loss)``; the intercept is not penalised."""
    n, p = x.shape
    z = np.column_stack([x, np.ones(n)])
    w = np.zeros(p + 1)
    penalty = np.diag([1.0] * p + [0.0])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = penalty @ w + c * z.T @ (q - y)
        hessian = penalty + c * (z * np.maximum(q * (1 - q), 1e-9)[:, None]).T @ z + 1e-9 * np.eye(p + 1)
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-10:
            break
    return w[:p], float(w[p])


def fit_scaled(x: np.ndarray, y: np.ndarray, c: float) -> dict:
    """Scale to unit variance (divisor n), fit, and keep what prediction needs."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    w, b = newton_logistic((x - mean) / scale, y, c)
    return {"weight": w, "intercept": b, "mean": mean, "scale": scale}


def predicted(model: dict, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-((x - model["mean"]) / model["scale"] @ model["weight"] + model["intercept"])))


def direction(model: dict) -> np.ndarray:
    """Unit vector of the weights in unscaled units."""
    v = model["weight"] / model["scale"]
    size = np.linalg.norm(v)
    return v / size if size > 0 else v


def _sums_job(features: list[str], models: list[tuple[float, object]], weights: np.ndarray, mean: np.ndarray, scale: np.ndarray):
    """Adds up each model's gradient and Hessian over the rows outside its held-out group."""
    p = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(models), (p + 1) * (p + 2)))
        for batch in batches:
            groups = np.array(batch.column(0).to_pylist(), dtype=object)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            x = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(p)], axis=1)
            for k, (_, held) in enumerate(models):
                own = groups != held
                z = np.column_stack([(x[own] - mean[k]) / scale[k], np.ones(int(own.sum()))])
                q = 1 / (1 + np.exp(-np.clip(z @ weights[k], -30, 30)))
                total[k, : p + 1] += z.T @ (q - y[own])
                total[k, p + 1 :] += ((z * np.maximum(q * (1 - q), 1e-9)[:, None]).T @ z).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(list(range(len(models))), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["model", "s"])

    return run


def _fitted(rows: DataFrame, group: str, label: str, features: list[str], models: list[tuple[float, object]], steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(weights, mean, scale, usable)`` of each model ``(C, held-out group)``; ``None`` holds nobody out."""
    p = len(features)
    per = rows.groupBy(group).agg(
        F.count("*").alias("n"), F.sum(label).alias("y"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(features)], *[F.sum(F.col(f) * F.col(f)).alias(f"q{i}") for i, f in enumerate(features)]
    ).collect()  # one row for each speaker, as many as there are folds
    parts = {r[group]: np.array([r["n"], r["y"], *[r[f"s{i}"] for i in range(p)], *[r[f"q{i}"] for i in range(p)]], dtype=float) for r in per}
    every = sum(parts.values(), np.zeros(2 + 2 * p))
    left = np.stack([every - parts.get(held, 0) for _, held in models])
    n = np.maximum(left[:, :1], 1)
    mean = left[:, 2 : 2 + p] / n
    scale = np.sqrt(np.maximum(left[:, 2 + p :] / n - mean * mean, 0))
    scale = np.where(scale > 1e-12, scale, 1.0)
    usable = (left[:, 1] > 0) & (left[:, 1] < left[:, 0])
    weights = np.zeros((len(models), p + 1))
    penalty = np.diag([1.0] * p + [0.0])
    c = np.array([x for x, _ in models])
    live = usable.copy()
    for _ in range(steps):
        if not live.any():
            break
        at = np.nonzero(live)[0]
        job = _sums_job(features, [models[k] for k in at], weights[at], mean[at], scale[at])
        summed = rows.select(group, label, *features).mapInArrow(job, "model int, s array<double>")
        summed = summed.select("model", F.posexplode("s").alias("i", "v")).groupBy("model", "i").agg(F.sum("v").alias("v")).collect()
        total = np.zeros((len(at), (p + 1) * (p + 2)))
        for r in summed:
            total[r["model"], r["i"]] = r["v"]
        for j, k in enumerate(at):
            gradient = penalty @ weights[k] + c[k] * total[j, : p + 1]
            hessian = penalty + c[k] * total[j, p + 1 :].reshape(p + 1, p + 1) + 1e-9 * np.eye(p + 1)
            step = np.linalg.solve(hessian, gradient)
            weights[k] -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            live[k] = np.abs(step).max() >= 1e-9
    return weights, mean, scale, usable


def _linear(weights: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and shift in unscaled units, one row for each model."""
    w = weights[:, :-1] / scale
    return w, weights[:, -1] - (w * mean).sum(axis=1)


def grouped_cv(rows: DataFrame, row_id: str, group: str, label: str, features: list[str], c_grid: tuple[float, ...] = C_GRID) -> DataFrame:
    """Out-of-fold probabilities ``(c, id, grp, label, p)``: each group is predicted by a model of all others.

    A fold whose training rows have one class only gives no rows.
    """
    slim = rows.select(F.col(row_id).alias("id"), F.col(group).alias("grp"), F.col(label).cast("double").alias("label"), *features)
    groups = sorted(r["grp"] for r in slim.select("grp").distinct().collect())  # the folds
    models = [(float(c), g) for c in c_grid for g in groups]
    weights, mean, scale, usable = _fitted(slim, "grp", "label", features, models)
    w, b = _linear(weights, mean, scale)
    kind = slim.schema["grp"].dataType.simpleString()
    fitted = [(c, g, w[k].tolist(), float(b[k])) for k, (c, g) in enumerate(models) if usable[k]]
    table = rows.sparkSession.createDataFrame(fitted, f"c double, grp {kind}, _w array<double>, _b double")
    total = F.col("_b")
    for i, f in enumerate(features):
        total = total + F.element_at("_w", i + 1) * F.col(f)
    return slim.join(table, "grp").select("c", "id", "grp", "label", (1 / (1 + F.exp(-total))).alias("p"))


def fit_and_validate(rows: DataFrame, row_id: str, group: str, label: str, features: list[str], c_grid: tuple[float, ...] = C_GRID) -> tuple[dict, DataFrame | None]:
    """``(report, out-of-fold rows (id, p))``: C chosen by the out-of-fold AUC (first of equals), refitted on all rows.

    Status ``insufficient_data`` under six rows or with one class, ``cv_failed``
    where no C gives four predictions of both classes.
    """
    slim = rows.select(row_id, group, F.col(label).cast("double").alias("_label"), *features)
    shape = slim.agg(F.count("*").alias("n"), F.coalesce(F.sum("_label"), F.lit(0.0)).alias("y"), F.countDistinct(group).alias("folds")).first()
    n, positive = shape["n"], int(shape["y"])
    if n < 6 or positive in (0, n):
        return {"status": "insufficient_data", "n": n, "n_positive": positive}, None
    oof = grouped_cv(slim, row_id, group, "_label", features, c_grid)
    found = {r["c"]: r for r in cv_report(oof).collect()}
    best = None
    for c in c_grid:
        r = found.get(float(c))
        if r is not None and r["n"] >= 4 and 0 < r["positive"] < r["n"] and (best is None or r["auc"] > best["auc"]):
            best = r
    if best is None:
        return {"status": "cv_failed", "n": n}, None
    weights, mean, scale, _ = _fitted(slim, group, "_label", features, [(best["c"], None)])
    w, b = _linear(weights, mean, scale)
    model = {"weight": weights[0, :-1], "intercept": float(weights[0, -1]), "mean": mean[0], "scale": scale[0]}
    in_sample = auc(slim.withColumn("_s", handpicked(slim, features, w[0].tolist()) + float(b[0])), "_s", "_label").first()["auc"]
    report = {
        "status": "ok", "n": n, "n_positive": positive, "n_folds": shape["folds"], "c": best["c"], "auc_in_sample": in_sample, "auc_out_of_fold": best["auc"],
        "overfit_gap": in_sample - best["auc"], "brier": best["brier"], "model": model, "direction": direction(model).tolist(),
    }
    return report, oof.where(F.col("c") == best["c"]).select("id", "p")


def leave_one_out_mean(rows: DataFrame, value: str, out: str, groups: list[str]) -> DataFrame:
    """``rows`` plus the mean of ``value`` over the other rows of the group (null for a row alone): totals minus the row."""
    total = rows.groupBy(*groups).agg(F.sum(value).alias("_t"), F.count(value).alias("_n"))
    own = F.col(value).isNotNull().cast("int")
    rest = F.try_divide(F.col("_t") - F.coalesce(F.col(value), F.lit(0)), F.col("_n") - own)
    return rows.join(total, groups).withColumn(out, rest).drop("_t", "_n")


def leave_one_out_predict(rows: DataFrame, row_id: str, fold: str, features: list[str], label: str, fit, predict) -> DataFrame:
    """``(id, predicted)``: for each fold of a *bounded* table, ``fit(x, y)`` on the other rows and ``predict(model, x)`` on its own.

    For any fitting function; each fold is one task that reads the whole table,
    so it is meant for tables of measured windows, not for corpora.  Sums that
    can be taken apart need no such copy (``leave_one_out_mean``, ``grouped_cv``).
    """
    slim = rows.select(F.col(row_id).alias("id"), F.col(fold).alias("fold"), F.col(label).cast("double").alias("label"), *features)
    work = slim.select("id", F.col("fold").alias("of"), "label", *features).crossJoin(F.broadcast(slim.select("fold").distinct()))
    kind = slim.schema["id"].dataType.simpleString()

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        own = frame["of"] == frame["fold"]
        train, test = frame[~own], frame[own]
        if train.empty:
            return pd.DataFrame({"id": test["id"], "predicted": np.nan})
        model = fit(train[features].to_numpy(float), train["label"].to_numpy(float))
        return pd.DataFrame({"id": test["id"], "predicted": np.asarray(predict(model, test[features].to_numpy(float)), dtype=float)})

    return work.groupBy("fold").applyInPandas(one, f"id {kind}, predicted double")


def cv_report(oof: DataFrame) -> DataFrame:
    """AUC, Brier score and log loss of the out-of-fold probabilities for each C (the best is the first of equals)."""
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("p")))
    rest = oof.groupBy("c").agg(
        F.count("*").alias("n"),
        F.sum("label").cast("long").alias("positive"),
        F.avg(F.pow(F.col("p") - F.col("label"), 2)).alias("brier"),
        (-F.avg(F.col("label") * F.log(q) + (1 - F.col("label")) * F.log(1 - q))).alias("log_loss"),
    )
    return auc(oof, "p", "label", ["c"]).select("c", "auc").join(rest, "c").select("c", "n", "positive", "auc", "brier", "log_loss")


def handpicked(rows: DataFrame, features: list[str], weights: list[float]) -> Column:
    """A fixed linear score."""
    total = F.lit(0.0)
    for f, w in zip(features, weights, strict=True):
        total = total + F.col(f) * F.lit(w)
    return total
