"""Toxicity by weak supervision.

1. Voters.  Fixed insults and patterns, and a lexicon learned from the labelled
   training rows: words and word beginnings that almost only toxic texts hold,
   dealt to ``LEXICON_VOTERS`` voters by hash.  A voter says toxic, not toxic
   or nothing.  Fitting rows are dealt to two halves and voted on by the lexicon
   of the other half, so that no voter has seen the row it votes on.
2. A generative label model over all voters' votes on the fitting sample: EM
   estimates each voter's accuracy for both classes and the class balance;
   residual correlations between voters, given the posterior, shrink the votes
   of voters that repeat each other.
3. A linear classifier on hashed words and word beginnings, and on the votes,
   is trained on the posterior labels and scores every document.  Its scores are
   calibrated by rows that the classifier fitted for them has not seen (two
   halves, each scored by the other's classifier).

Labels are read only from rows outside the held-out fold, at most
``SAMPLE_ROWS`` of them (the documented bound of the fit); language, source and
id are never inputs.  The model is a few MB whatever the corpus; a task holds
one Arrow batch and a memo of at most ``MEMO`` words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import least_hashes, written

FOLDS, HELD_OUT = 4, 2
SAMPLE_ROWS = 16_000
BUCKETS = 1 << 15
LEXICON_SIZE = 2048
LEXICON_VOTERS = 16
MIN_TOXIC_DOCS = 4
MIN_SHARE = 0.95
THRESHOLD = 0.3
MEMO = 1 << 17
PREFIXES = (4, 5, 6)
# Insults that one voter each looks for.
INSULTS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
_PLAIN = bytes.maketrans(_MARKS, b" " * len(_MARKS))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_PLAIN).split()


def features_of(word: bytes) -> list[bytes]:
    """A word and its beginnings, in characters."""
    shown = word.decode("utf-8", "replace")
    return [b"w:" + word, *[b"p:" + shown[:n].encode() for n in PREFIXES if len(shown) > n]]


def bucket(feature: bytes) -> int:
    return zlib.crc32(feature) % BUCKETS


class Voters:
    """Votes of one text: 1 toxic, 0 nothing, -1 not toxic."""

    def __init__(self, lexicon: list[bytes]) -> None:
        self.lexicon = {f: len(INSULTS) + zlib.crc32(b"voter" + f) % LEXICON_VOTERS for f in lexicon}
        self.insult = {w.encode(): i for i, w in enumerate(INSULTS)}
        self.first_pattern = len(INSULTS) + LEXICON_VOTERS
        self.size = self.first_pattern + 3

    def of_word(self, word: bytes) -> list[int]:
        """The voters that a word sets off."""
        found = [self.insult[word]] if word in self.insult else []
        found += [self.lexicon[f] for f in features_of(word) if f in self.lexicon]
        return found

    def vote(self, hits: Counter[int], n_words: int) -> np.ndarray:
        votes = np.zeros(self.size, dtype=np.int8)
        votes[list(hits)] = 1
        total = sum(hits.values())
        at = self.first_pattern
        votes[at] = 1 if total >= 2 else -1 if total == 0 else 0  # several hits; none at all
        votes[at + 1] = 1 if total and total >= 0.02 * n_words else 0  # dense hits
        votes[at + 2] = 1 if len(hits) >= 2 else -1 if total == 0 and n_words >= 20 else 0  # hits of several voters
        return votes


# ------------------------------------------------------------ label model


def label_model(votes: np.ndarray, prior: float, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row, and the correlation weight of each voter.

    ``votes`` is rows x voters in {-1, 0, 1}; saying nothing is a vote of its
    own kind, so coverage is modelled as well.
    """
    kinds = [(votes == v).astype(np.float64) for v in (-1, 0, 1)]
    toxic_votes = (votes == 1).sum(axis=1)
    posterior = np.clip(0.02 + 0.49 * np.minimum(toxic_votes, 2), 0.02, 0.98)
    weights = np.ones(votes.shape[1])
    balance = prior
    for step in range(rounds):
        tables = []
        for w in (posterior, 1 - posterior):
            total = w.sum()
            tables.append([(w @ k + 0.5) / (total + 1.5) for k in kinds])
        logit = np.log(balance / (1 - balance)) + sum(
            k @ (weights * (np.log(t1) - np.log(t0))) for k, t1, t0 in zip(kinds, *tables, strict=True)
        )
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        # The class balance is known from the labels to within a factor of two.
        balance = float(np.clip(new.mean(), prior / 2, min(0.9, prior * 2)))
        if step % 10 == 9:
            means = [sum(v * t for v, t in zip((-1, 0, 1), table, strict=True)) for table in tables]
            rest = votes - (posterior[:, None] * means[0] + (1 - posterior[:, None]) * means[1])
            deviation = rest.std(axis=0)
            live = deviation > 1e-9
            scaled = np.where(live, rest / np.where(live, deviation, 1), 0)
            correlation = np.abs(scaled.T @ scaled) / len(votes)
            np.fill_diagonal(correlation, 0)
            weights = 1 / (1 + np.where(correlation > 0.1, correlation, 0).sum(axis=1))
        if np.abs(new - posterior).max() < 1e-6 and step >= 10:
            posterior = new
            break
        posterior = new
    return posterior, weights


# -------------------------------------------------------------- classifier


def values_of(ids: np.ndarray) -> np.ndarray:
    """Values of a row's features: words share their weight, so that length says little; votes count in full."""
    words = ids < BUCKETS
    return np.where(words, 1 / np.sqrt(max(int(words.sum()), 1)), 1.0)


def fit_linear(rows: list[np.ndarray], labels: np.ndarray, size: int, epochs: int = 12, l2: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows by AdaGrad over soft labels."""
    rng = np.random.default_rng(5)
    values = [values_of(ids) for ids in rows]
    weight, seen, bias, bias_seen = np.zeros(size), np.full(size, 1e-6), 0.0, 1e-6
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, x = rows[i], values[i]
            z = np.clip(weight[ids] @ x + bias, -30, 30)
            error = 1 / (1 + np.exp(-z)) - labels[i]
            g = error * x + l2 * weight[ids]
            seen[ids] += g * g
            weight[ids] -= 0.3 * g / np.sqrt(seen[ids])
            bias_seen += error * error
            bias -= 0.3 * error / np.sqrt(bias_seen)
    return weight, bias


class Toxicity:
    """Scores texts: hashed linear classifier over words, word beginnings and votes."""

    def __init__(self, lexicon: list[bytes], weight: np.ndarray, bias: float, calibration: tuple[float, float] = (1.0, 0.0)) -> None:
        self.voters, self.weight, self.bias, self.calibration = Voters(lexicon), weight, bias, calibration
        self.memo: dict[bytes, tuple[list[int], list[int]]] = {}

    def _word(self, word: bytes) -> tuple[list[int], list[int]]:
        got = self.memo.get(word)
        if got is None:
            got = ([bucket(f) for f in features_of(word)], self.voters.of_word(word))
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = got
        return got

    def row(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """``(feature ids, votes)`` of a text."""
        words = words_of(text)
        ids: set[int] = set()
        hits: Counter[int] = Counter()
        counts = Counter(words)
        for word, n in counts.items():
            buckets, voters = self._word(word)
            ids.update(buckets)
            for v in voters:
                hits[v] += n
        votes = self.voters.vote(hits, len(words))
        votes_at = BUCKETS + np.nonzero(votes)[0] * 2 + (votes[votes != 0] > 0)
        return np.concatenate([np.fromiter(ids, dtype=np.int64, count=len(ids)), votes_at.astype(np.int64)]), votes

    def logit(self, ids: np.ndarray) -> float:
        return float(self.weight[ids] @ values_of(ids) + self.bias)

    def score(self, text: str | None) -> float:
        a, b = self.calibration
        return float(1 / (1 + np.exp(-np.clip(a * self.logit(self.row(text)[0]) + b, -30, 30))))


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """Whether crc32 of the id as text falls in the held-out fold (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def _platt(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with a small ridge, halved until the loss falls."""
    x = np.stack([logits, np.ones_like(logits)], axis=1)
    prior = np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - labels * z).sum() + 5e-4 * ((w - prior) ** 2).sum())

    w, now = prior, loss(prior)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + 1e-3 * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        while np.abs(step).max() >= 1e-8 and not loss(w - step) < now:
            step = step / 2
        if np.abs(step).max() < 1e-8:
            break
        w, now = w - step, loss(w - step)
    return float(max(w[0], 1e-3)), float(w[1])


HALVES = 2


def _lexicon(sample: DataFrame) -> list[bytes]:
    """Words and beginnings that at least ``MIN_SHARE`` of their (several) labelled documents are toxic for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every: Counter[bytes] = Counter()
            toxic: Counter[bytes] = Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {f for w in set(words_of(text)) for f in features_of(w)}
                every.update(found)
                if label:
                    toxic.update(found)
            names = list(every)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array([toxic[f] for f in names], pa.int64()), pa.array([every[f] for f in names], pa.int64())],
                names=["feature", "toxic", "n"],
            )

    counted = sample.mapInArrow(run, "feature binary, toxic long, n long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    best = (
        counted.where((F.col("toxic") >= MIN_TOXIC_DOCS) & (F.col("toxic") >= MIN_SHARE * F.col("n")))
        .orderBy(F.desc("toxic"), "feature")
        .limit(LEXICON_SIZE)
    )
    return [bytes(r["feature"]) for r in best.select("feature").collect()]


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Toxicity:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out fold (least hashes of the id)."""
    known = labels.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{label}`").cast("int").alias("__label")).where(
        F.col("__id").isNotNull() & F.col("__label").isNotNull() & ~held_out(F.col("__id"))
    )
    chosen = least_hashes(known.groupBy("__id").agg(F.max("__label").alias("__label")), "__id", sample_rows)
    sample = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "__id")
    half = F.pmod(F.xxhash64(F.lit("half"), F.coalesce("text", F.lit(""))), F.lit(HALVES)).cast("int")
    sample = written(sample.select("__id", "text", "__label", half.alias("half")), "toxicity-sample")
    lexicon = _lexicon(sample.select("text", "__label"))
    others = [_lexicon(sample.where(F.col("half") != h).select("text", "__label")) for h in range(HALVES)]
    shared = docs.sparkSession.sparkContext.broadcast(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Toxicity(x, np.zeros(1), 0.0) for x in shared.value]
        for batch in batches:
            rows = [readers[h].row(t) for t, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([ids.astype("<i4").tobytes() for ids, _ in rows], pa.binary()),
                    pa.array([v.tobytes() for _, v in rows], pa.binary()),
                    batch.column(3),
                ],
                names=["order", "ids", "votes", "label"],
            )

    # In a fixed order, whatever the partitioning: the fit visits rows by position.
    order = F.xxhash64(F.lit("order"), "__id", F.coalesce("text", F.lit("")))
    marked = sample.select(order.alias("order"), "text", "half", "__label").mapInArrow(run, "order long, ids binary, votes binary, label int")
    got = marked.orderBy("order", "ids").select("ids", "votes", "label").toArrow()
    shared.destroy()
    size = BUCKETS + 2 * Voters(lexicon).size
    if not got.num_rows:
        return Toxicity(lexicon, np.zeros(size), 0.0)
    rows = [np.frombuffer(b, dtype="<i4").astype(np.int64) for b in got.column(0).to_pylist()]
    votes = np.stack([np.frombuffer(b, dtype=np.int8) for b in got.column(1).to_pylist()])
    truth = got.column(2).to_numpy().astype(float)
    prior = float(np.clip(truth.mean(), 0.005, 0.9))
    posterior, _ = label_model(votes, prior)
    unseen = np.zeros(len(rows))
    for own in (np.arange(len(rows)) % 2 == 0, np.arange(len(rows)) % 2 == 1):  # the order is that of a hash
        if own.all() or not own.any():
            break
        weight, bias = fit_linear([r for r, o in zip(rows, own, strict=True) if not o], posterior[~own], size)
        half = Toxicity(lexicon, weight, bias)
        unseen[own] = [half.logit(r) for r, o in zip(rows, own, strict=True) if o]
    weight, bias = fit_linear(rows, posterior, size)
    return Toxicity(lexicon, weight, bias, _platt(unseen, truth))


def score(docs: DataFrame, model: Toxicity, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the text, plus ``score`` (0 to 1) and ``predicted``.

    Null and empty texts are scored by the votes of an empty text; clashing
    columns are replaced; repeated rows stay; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c != text and c.lower() not in ("score", "predicted")]
    shared = spark.sparkContext.broadcast((list(model.voters.lexicon), model.weight, model.bias, model.calibration))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Toxicity(*shared.value)
        for batch in batches:
            scores = np.array([reader.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))],
                names=[*keep, "score", "predicted"],
            )

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("score", T.DoubleType()).add("predicted", T.IntegerType())
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)
