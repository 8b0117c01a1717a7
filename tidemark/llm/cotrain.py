"""Quality classifier by co-training two views of a page.

*Text view*: which kinds of characters follow each other, how often words
repeat and how long they are.  *Metadata view*: language, source, length and
the layout (lines, their length and repetition, shares of capitals, symbols,
digits).  Each view has its own logistic model, calibrated on labelled rows
that take no part in training.  In every round both models score *all* other
documents; the distinct ones that a view is most sure of are handed to the
*other* view's training pool, in the proportion of the classes.  At the end a
logistic combination of the calibrated views scores every document.

Bounds: at most ``LABELLED`` labelled rows are fitted on (those with the least
hashes of their id), and each round adds at most ``PER_ROUND`` pseudo-labelled
documents (and ``SHARE_PER_ROUND`` of all) to a view, chosen among all documents.  Models are fitted in one task (at most about 60 MB of features);
the driver sees ids and a few kilobytes of weights.  Scoring holds one slice of
an Arrow batch a task.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import least_hashes, written

LABELLED = 6000
PER_ROUND, SHARE_PER_ROUND = 480, 0.08
ROUNDS = 3
SURE = 0.97
SURE_ODDS = float(np.log(SURE / (1 - SURE)))
THRESHOLD = 0.5
_ROWS = 512
_CLASSES = 37
_TEXT_STATS = 5
TEXT_SIZE = _CLASSES * _CLASSES + _TEXT_STATS
_LANGS, _SOURCES, _LAYOUT = 16, 32, 9
META_SIZE = _LANGS + _SOURCES + _LAYOUT


def _byte_classes() -> np.ndarray:
    of = np.full(256, 7, dtype=np.int16)
    of[0x80:] = 36
    of[ord("\n")] = 1
    for chars, c in ((" \t\r\x0b\x0c", 0), ("0123456789", 2), ("!", 3), ("|", 4), ("#$%&*", 5), (".,;:", 6)):
        for ch in chars:
            of[ord(ch)] = c
    for i in range(26):
        of[ord("a") + i] = 10 + i
        of[ord("A") + i] = 8 if chr(ord("A") + i) in "AEIOU" else 9
    return of


_OF = _byte_classes()


def text_view(text: bytes) -> np.ndarray:
    out = np.zeros(TEXT_SIZE, dtype=np.float32)
    if len(text) > 1:
        c = _OF[np.frombuffer(text, dtype=np.uint8)]
        pairs = c[:-1] * _CLASSES + c[1:]
        out[: _CLASSES * _CLASSES] = np.sqrt(np.bincount(pairs, minlength=_CLASSES * _CLASSES) / len(pairs))
    words = text.lower().split()
    if words:
        n = len(words)
        distinct = set(words)
        out[-5:] = (
            len(distinct) / n,
            sum(map(eq, words, words[1:])) / n,
            np.log1p(sum(map(len, words)) / n) / 3,
            np.sqrt(len(distinct)) / n,
            min(n, 50) / 50,
        )
    return out


def meta_view(text: bytes, lang: str | None, source: str | None) -> np.ndarray:
    out = np.zeros(META_SIZE, dtype=np.float32)
    out[zlib.crc32((lang or "").encode()) % _LANGS] = 1
    out[_LANGS + zlib.crc32((source or "").encode()) % _SOURCES] = 1
    n = max(len(text), 1)
    c = np.bincount(_OF[np.frombuffer(text, dtype=np.uint8)], minlength=_CLASSES) / n if text else np.zeros(_CLASSES)
    lines = text.split(b"\n")
    out[-_LAYOUT:] = (
        np.log1p(len(text)) / 10,
        np.log1p(len(lines)) / 5,
        np.log1p(n / len(lines)) / 8,
        1 - len(set(lines)) / len(lines),
        4 * (c[8] + c[9]),
        10 * (c[5] + c[7]),
        10 * c[2],
        10 * (c[3] + c[4]),
        c[36],
    )
    return out


class Logistic:
    """Ridge-penalised logistic regression on standardised columns, full-batch Adam, with a calibrated output."""

    def __init__(self, size: int, l2: float = 1e-3) -> None:
        self.weight, self.bias, self.l2 = np.zeros(size, dtype=np.float32), 0.0, l2
        self.mean = self.scale = None
        self.slope, self.shift = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 150) -> None:
        if self.mean is None:
            self.mean = x.mean(axis=0)
            self.scale = 1 / np.maximum(x.std(axis=0), 0.02)
        z = x - self.mean
        z *= self.scale
        m, v = np.zeros(len(self.weight) + 1), np.zeros(len(self.weight) + 1)
        for t in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weight + self.bias, -30, 30)))
            error = (p - y) / len(y)
            g = np.concatenate([z.T @ error + self.l2 * self.weight, [error.sum()]])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            self.weight = (self.weight - step[:-1]).astype(np.float32)
            self.bias -= float(step[-1])

    def raw(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.zeros(len(x))
        # Summed row by row, so that a row's value does not depend on its batch.
        return np.clip(((x - self.mean) * (self.scale * self.weight)).sum(axis=1, dtype=np.float64) + self.bias, -30, 30)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Slope and shift of the log odds by held-out rows (Platt scaling)."""
        slope, self.shift = newton(self.raw(x)[:, None], y, np.array([1.0, 0.0])).tolist()
        self.slope = max(slope, 0.0)

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log odds."""
        return np.clip(self.slope * self.raw(x) + self.shift, -30, 30)


def newton(x: np.ndarray, y: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Logistic weights of the columns and a shift, by Newton steps with a ridge towards ``prior``, halved until the loss falls."""
    x = np.column_stack([x, np.ones(len(x))])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * ((w - prior) ** 2).sum())

    w, now = prior.copy(), loss(prior)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (p - y) + (w - prior))
        while np.abs(step).max() >= 1e-8 and not loss(w - step) < now:
            step = step / 2
        if np.abs(step).max() < 1e-8:
            break
        w, now = w - step, loss(w - step)
    return w


class Views:
    """Both view models and the weights that combine them."""

    def __init__(self, text_size: int = TEXT_SIZE, meta_size: int = META_SIZE) -> None:
        self.models = (Logistic(text_size), Logistic(meta_size))
        self.weights = np.zeros(3)
        #: Share of good rows among the labelled ones.
        self.share = 0.5

    def fit(self, labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, pools: list[tuple[np.ndarray, np.ndarray]], first: bool) -> None:
        """Fit both views on four fifths of the labelled rows and their pools; the last fifth calibrates and combines."""
        cut = max(1, len(y) * 4 // 5)
        held = slice(cut, None) if cut < len(y) else slice(None)
        self.share = float(np.clip(y.mean(), 0.02, 0.98))
        for model, own, (more, marks) in zip(self.models, labelled, pools, strict=True):
            model.fit(np.concatenate([own[:cut], more]), np.concatenate([y[:cut], marks]), 150 if first else 50)
            model.calibrate(own[held], y[held])
        logits = np.stack([m.logit(v[held]) for m, v in zip(self.models, labelled, strict=True)], axis=1)
        self.weights = newton(logits, y[held], np.array([0.5, 0.5, 0.0]))
        self.weights[:2] = np.maximum(self.weights[:2], 0)

    def quotas(self, free: int, per_round: int) -> dict[bool, int]:
        room = min(per_round, max(1, int(SHARE_PER_ROUND * free)))
        return {True: max(1, int(room * self.share)), False: max(1, int(room * (1 - self.share)))}

    def logits(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Combined, text and metadata log odds, as three rows."""
        lt, lm = (m.logit(v) for m, v in zip(self.models, (text, meta), strict=True))
        return np.stack([self.weights[0] * lt + self.weights[1] * lm + self.weights[2], lt, lm])


def co_train(
    text: np.ndarray, meta: np.ndarray, labels: np.ndarray, free_text: np.ndarray, free_meta: np.ndarray, rounds: int = ROUNDS, per_round: int = PER_ROUND, order: np.ndarray | None = None
) -> Views:
    """What ``train`` does with tables, on arrays in memory; ``order`` breaks ties between the free rows."""
    views = Views(text.shape[1], meta.shape[1])
    free, ranks = (free_text, free_meta), np.arange(len(free_text)) if order is None else order
    pools = [([v[:0]], [labels[:0]]) for v in (text, meta)]
    left = [np.ones(len(free_text), dtype=bool) for _ in range(2)]
    for turn in range(rounds + 1):
        views.fit((text, meta), labels, [(np.concatenate(x), np.concatenate(m)) for x, m in pools], turn == 0)
        if turn == rounds:
            break
        for a, b in ((0, 1), (1, 0)):
            odds = views.models[a].raw(free[a])
            for good, quota in views.quotas(len(free_text), per_round).items():
                sure = np.nonzero(left[a] & ((odds if good else -odds) >= SURE_ODDS))[0]
                taken = sure[np.lexsort((ranks[sure], -np.abs(odds[sure])))[:quota]]
                pools[b][0].append(free[b][taken])
                pools[b][1].append(np.full(len(taken), float(good)))
                left[a][taken] = False
    return views


def _features_job(extra: list[str]):
    """``(extra..., text, lang, source)`` -> ``(extra..., t, m)``: both views of every row, as bytes of 32-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            k = len(extra)
            rows = list(zip(*(batch.column(k + i).to_pylist() for i in range(3)), strict=True))
            views = [pa.array([text_view(t or b"").tobytes() for t, _, _ in rows], pa.binary()), pa.array([meta_view(t or b"", a, s).tobytes() for t, a, s in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), *views], names=[*extra, "t", "m"])

    return run


def _fit_job(before: Views | None):
    """All training rows ``(pool, label, t, m)`` in one task -> the fitted views, pickled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pools, marks, text, meta = [], [], [], []
        for batch in batches:
            pools += batch.column(0).to_pylist()
            marks += batch.column(1).to_pylist()
            text += [np.frombuffer(x, dtype=np.float32) for x in batch.column(2).to_pylist()]
            meta += [np.frombuffer(x, dtype=np.float32) for x in batch.column(3).to_pylist()]
        views = before or Views()
        pool, y = np.array(pools, dtype=int), np.array(marks, dtype=float)
        rows = [np.nonzero(pool == k)[0] for k in (2, 0, 1)]
        if len(rows[0]):
            stacked = lambda v, at: np.stack([v[i] for i in at]) if len(at) else np.zeros((0, len(v[0])), dtype=np.float32)
            labelled = (stacked(text, rows[0]), stacked(meta, rows[0]))
            views.fit(labelled, y[rows[0]], [(stacked(text, rows[1]), y[rows[1]]), (stacked(meta, rows[2]), y[rows[2]])], before is None)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(views)], pa.binary())], names=["views"])

    return run


def _sure_job(shared):
    """``(key, text, lang, source)`` -> ``(key, view, good, odds)`` wherever a view is sure of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = shared.value
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            keys = batch.column(0).to_numpy()
            rows = list(zip(*(batch.column(1 + i).to_pylist() for i in range(3)), strict=True))
            found = [np.stack([text_view(t or b"") for t, _, _ in rows]), np.stack([meta_view(t or b"", a, s) for t, a, s in rows])]
            for view, (model, x) in enumerate(zip(views.models, found, strict=True)):
                odds = model.raw(x)
                at = np.nonzero(np.abs(odds) >= SURE_ODDS)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at]), pa.array(np.full(len(at), view, dtype=np.int32)), pa.array(odds[at] > 0), pa.array(np.abs(odds[at]))],
                    names=["key", "view", "good", "odds"],
                )

    return run


def _pages(docs: DataFrame, text: str, lang: str, source: str) -> list:
    def named(c: str):
        return F.col(f"`{c}`").cast("string") if c in docs.columns else F.lit(None).cast("string")

    return [F.col(f"`{text}`").cast("binary").alias("__text"), named(lang).alias("__lang"), named(source).alias("__source")]


def page_key(text: str, lang: str, source: str) -> Column:
    """Equal for documents that both views see alike."""
    return F.xxhash64(F.coalesce(text, F.lit(b"")), F.coalesce(lang, F.lit("")), F.coalesce(source, F.lit("")))


def rank(key: Column) -> Column:
    """Breaks ties between documents a view is equally sure of."""
    return F.xxhash64(F.lit("rank"), key)


def _drawn(sure: DataFrame, quotas: dict[bool, int]) -> list[tuple[int, int, int]]:
    """Of each view and class the documents it is most sure of, up to the quota: ``(key, view, good)``."""
    out = None
    for view in (0, 1):
        for good, quota in quotas.items():
            own = sure.where((F.col("view") == view) & (F.col("good") == good)).orderBy(F.desc("odds"), rank(F.col("key")), "key").limit(quota)
            out = own if out is None else out.unionByName(own)
    return [(r["key"], r["view"], int(r["good"])) for r in out.collect()]


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    lang: str = "lang",
    source: str = "source",
    labelled: int = LABELLED,
    rounds: int = ROUNDS,
    per_round: int = PER_ROUND,
) -> Views:
    """Fit both views over rounds of exchanged pseudo-labels.

    Rows without an id or label are no labelled rows; they and all documents
    outside the labelled sample can be pseudo-labelled.  Documents that both
    views see alike are drawn once.  Without any labelled row every document
    scores 0.5, and with one class only the combination follows it.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{label}`").cast("int").alias("__label")).where("__id is not null and __label is not null")
    known = known.groupBy("__id").agg(F.max("__label").alias("__label"))
    ids = docs.select(F.col(f"`{doc_id}`").alias("__id")).where("__id is not null").distinct()
    chosen = written(least_hashes(ids.join(known, "__id"), "__id", labelled), "quality-labels")  # bounded: broadcast below
    pages = docs.select(F.col(f"`{doc_id}`").alias("__id"), *_pages(docs, text, lang, source)).withColumn("key", page_key("__text", "__lang", "__source"))
    kept = ["key", "pool", "label", "order"]
    features = "key long, pool int, label int, order long, t binary, m binary"
    sample = pages.join(F.broadcast(chosen), "__id").select("key", F.lit(2).alias("pool"), F.col("__label").alias("label"), F.xxhash64("__id", F.lit("order")).alias("order"), "__text", "__lang", "__source")
    pools = [written(sample.mapInArrow(_features_job(kept), features), "quality-rows")]
    free = pages.join(F.broadcast(chosen.select("__id")), "__id", "left_anti").select("key", "__text", "__lang", "__source")
    n_free = free.select("key").distinct().count()
    views, taken = None, []
    for turn in range(rounds + 1):
        every = pools[0]
        for pool in pools[1:]:
            every = every.unionByName(pool)
        # In a fixed order, whatever the partitioning: the last fifth of the labelled rows calibrates.
        rows = every.repartition(1).sortWithinPartitions("pool", "order", "key", "label").select("pool", "label", "t", "m")
        found = rows.mapInArrow(_fit_job(views), "views binary").first()
        views = pickle.loads(found["views"]) if found else Views()
        if turn == rounds or views.models[0].mean is None:
            return views
        shared = spark.sparkContext.broadcast(views)
        sure = free.mapInArrow(_sure_job(shared), "key long, view int, good boolean, odds double").groupBy("key", "view", "good").agg(F.max("odds").alias("odds"))
        if taken:
            sure = sure.join(F.broadcast(spark.createDataFrame([x[:2] for x in taken], "key long, view int")), ["key", "view"], "left_anti")
        drawn = _drawn(written(sure, "quality-sure"), views.quotas(n_free, per_round))
        shared.destroy()
        if not drawn:
            return views
        taken += drawn
        # What one view is sure of teaches the other.
        marks = spark.createDataFrame([(k, 1 - v, g) for k, v, g in drawn], "key long, pool int, label int")
        texts = free.join(F.broadcast(marks.select("key").distinct()), "key", "left_semi").dropDuplicates(["key"])
        pools.append(written(texts.join(F.broadcast(marks), "key").select("key", "pool", "label", rank(F.col("key")).alias("order"), "__text", "__lang", "__source").mapInArrow(_features_job(kept), features), "quality-rows"))
    raise AssertionError("unreachable")


def score(docs: DataFrame, model: Views, text: str = "text", lang: str = "lang", source: str = "source", keep_text: bool = False, prefix: str = "") -> DataFrame:
    """``docs`` (without the text unless ``keep_text``) plus ``quality_score``, ``text_score``, ``meta_score`` (0 to 1).

    Null texts are empty, missing metadata columns are unknown; clashing
    columns are replaced; repeated rows stay; texts of any length are read
    whole; an empty table gives an empty result.
    """
    names = [f"{prefix}quality_score", f"{prefix}text_score", f"{prefix}meta_score"]
    keep = [c for c in docs.columns if c.lower() not in names and (keep_text or c != text)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = shared.value
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            k = batch.num_columns - 3
            rows = list(zip(*(batch.column(k + i).to_pylist() for i in range(3)), strict=True))
            z = views.logits(np.stack([text_view(t or b"") for t, _, _ in rows]), np.stack([meta_view(t or b"", a, s) for t, a, s in rows]))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), *(pa.array(x) for x in p)], names=[*keep, *names])

    kept = [F.col(f"`{c}`") for c in keep]
    schema = docs.select(*kept).schema
    for name in names:
        schema = schema.add(name, T.DoubleType())
    return docs.select(*kept, *_pages(docs, text, lang, source)).mapInArrow(run, schema)
