"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's words over all documents.
2. A distributed randomised SVD of the benchmark's TF-IDF passages: tasks add up
   their share of ``A'A`` times a thin matrix, the driver only orthonormalises.
   Both are fitted once for the whole benchmark.
3. Every document is read as overlapping windows of words; each window is
   projected into the latent space and compared by cosine with every passage of
   the benchmark (the stated query set, in blocks of ``BLOCK_ITEMS`` items).
   Items longer than ``PASSAGE_WORDS`` are searched by their passages of that
   many words, so that a window can resemble them.
4. Candidates are checked in place: the longest common subsequence of words
   with the item, and with the item's ending (its answer), over the best
   stretch of the document near the window.

Broadcast: the vectors of the benchmark's words and one block's passages, whose
number the block bounds, whatever the corpus.  A task holds one Arrow batch and one chunk of
windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ITEMS = 2048
RANK = 96
OVERSAMPLE = 16
STEP = 16  # words of half a window
MIN_COSINE = 0.3
PASSAGE_WORDS = 48
PARTS = 8  # tasks that add up the passages, each with one matrix of words x (RANK + OVERSAMPLE)
MIN_IDF = 1.5  # commoner words do not take part in the search (the checks use all words)
MIN_LCS = 0.6
SURE_LCS = 0.8
MIN_ANSWER = 0.5
ANSWER_WORDS = 8
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
_PLAIN = bytes.maketrans(_MARKS, b" " * len(_MARKS))
_CHUNK_WORDS = 1 << 17


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII marks."""
    return (text or "").lower().encode().translate(_PLAIN).split()


def lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bits."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for w in b:
        hit = free & places.get(w, 0)
        if hit:
            free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def best_match(item: list[bytes], words: list[bytes], at: int) -> tuple[float, float]:
    """``(lcs, answer)`` shares of the best stretch of ``words`` near the window that starts at ``at``."""
    n = len(item)
    lo, hi = max(0, at - n), min(len(words), at + 2 * STEP + n)
    # No subsequence is longer than the number of the item's words that occur at all.
    if sum(map(set(words[lo:hi]).__contains__, item)) < MIN_LCS * n or lcs(item, words[lo:hi]) < MIN_LCS * n:
        return 0.0, 0.0
    answer = item[-ANSWER_WORDS:]
    best = (0.0, 0.0)
    for start in range(lo, max(lo + 1, hi - n // 2), max(1, n // 6)):
        stretch = words[start : start + n + n // 4 + 2]
        best = max(best, (lcs(item, stretch) / n, lcs(answer, stretch) / len(answer)))
    return best


def leaked(share: float, answer: float) -> bool:
    return share >= SURE_LCS or (share >= MIN_LCS and answer >= MIN_ANSWER)


# ---------------------------------------------------------------- fitting


def document_frequencies(docs: DataFrame, text: str, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many documents each word of ``vocabulary`` occurs, and how many documents there are."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        known = frozenset(of)
        counts: Counter[int] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update([of[w] for w in known.intersection(words_of(t))])
                counts[-1] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    summed = docs.select(F.col(f"`{text}`")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(summed.column(0).to_pylist(), summed.column(1).to_pylist(), strict=True))
    out = np.zeros(len(vocabulary))
    for w, n in found.items():
        if w >= 0:
            out[w] = n
    return out, found.get(-1, 0)


def _summed_over(passages: DataFrame, vocabulary, idf: np.ndarray, thin: np.ndarray, inner: bool) -> np.ndarray:
    """``A'A thin`` (or ``thin'A'A thin``) over the TF-IDF passages, each task's share summed on the driver."""
    shared = passages.sparkSession.sparkContext.broadcast((vocabulary, idf, thin))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, weight, matrix = shared.value
        width = matrix.shape[1]
        total = np.zeros((width if inner else len(of), width))
        for batch in batches:
            for t in batch.column(0).to_pylist():
                ids, tf = np.unique([of[w] for w in words_of(t) if w in of], return_counts=True)
                if not len(ids):
                    continue
                ids = ids.astype(np.int64)
                row = tf * weight[ids]
                size = np.linalg.norm(row)
                if size:
                    row = row / size
                    thin_row = row @ matrix[ids]
                    if inner:
                        total += np.outer(thin_row, thin_row)
                    else:
                        total[ids] += np.outer(row, thin_row)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = passages.coalesce(PARTS).mapInArrow(run, "part binary").toArrow().column(0).to_pylist()
    shape = (thin.shape[1], thin.shape[1]) if inner else (len(vocabulary), thin.shape[1])
    return sum((np.frombuffer(p).reshape(shape) for p in parts), np.zeros(shape))


def randomised_svd(passages: DataFrame, vocabulary: dict[bytes, int], idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors (words x rank) of the TF-IDF passages, by two power steps."""
    rank = max(1, min(rank, len(vocabulary)))
    width = min(len(vocabulary), rank + OVERSAMPLE)
    thin = np.random.default_rng(11).standard_normal((len(vocabulary), width))
    for _ in range(2):
        thin, _ = np.linalg.qr(_summed_over(passages, vocabulary, idf, thin, inner=False))
    values, vectors = np.linalg.eigh(_summed_over(passages, vocabulary, idf, thin, inner=True))
    return thin @ vectors[:, np.argsort(-values)[:rank]]


# ----------------------------------------------------------------- search

#: Words of one stretch for which it is found which items could occur there at all.
STRETCH = 128


def possible_items(ids: np.ndarray, lengths: np.ndarray, items: list[np.ndarray], n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """``(possible, first)``: whether enough words of an item occur around each stretch of each document to be leaked there.

    ``ids`` are the documents' words one after the other (negative: not in the
    benchmark).  No common subsequence is longer than the number of the item's
    words that occur at all, so nothing that ``best_match`` would accept is
    ruled out.  Stretches of document ``d`` are the rows from ``first[d]`` on.
    """
    longest = max(map(len, items))
    before, after = longest, 2 * STEP + longest
    n_stretches = -(-lengths // STRETCH)
    first = np.cumsum(n_stretches) - n_stretches
    known = np.nonzero(ids >= 0)[0]
    starts = np.cumsum(lengths) - lengths
    doc = np.searchsorted(starts, known, side="right") - 1
    place = known - starts[doc]
    low, high = np.maximum(0, -(-(place - after - STRETCH + 1) // STRETCH)), np.minimum(n_stretches[doc] - 1, (place + before) // STRETCH)
    total = int(n_stretches.sum())
    flat = np.concatenate(items)
    edges = np.cumsum([0, *map(len, items[:-1])])
    least = MIN_LCS * np.array(list(map(len, items)))
    out = np.zeros((total, len(items)), dtype=bool)
    part = max(1, (1 << 23) // max(len(flat), n_words))
    for a in range(0, total, part):
        b = min(total, a + part)
        there = np.zeros((b - a, n_words), dtype=bool)
        lo, hi = np.maximum(first[doc] + low, a), np.minimum(first[doc] + high, b - 1)
        live = np.nonzero(lo <= hi)[0]
        for k in range(int((hi - lo)[live].max(initial=-1)) + 1):
            live = live[lo[live] + k <= hi[live]]
            there[lo[live] + k - a, ids[known[live]]] = True
        out[a:b] = np.add.reduceat(there[:, flat], edges, axis=1, dtype=np.int32) >= least
    return out, first


def _search_job(shared, keep: int, names: list[str]):
    leak_type = pa.list_(pa.struct([("item_id", pa.int64()), ("lcs", pa.float64()), ("answer", pa.float64()), ("cosine", pa.float64())]))

    def search(words_by_doc: list[list[bytes]], model) -> list[list[dict]]:
        of, vectors, informative, items, latent, item_of, item_ids = model
        found: list[dict[int, tuple]] = [{} for _ in words_by_doc]
        ids = np.concatenate([np.fromiter(map(of.get, ws, repeat(-1)), dtype=np.int32, count=len(ws)) for ws in words_by_doc])
        lengths = np.fromiter(map(len, words_by_doc), dtype=np.int64, count=len(words_by_doc))
        blocks_of = -(-lengths // STEP)
        first_block, first_word = np.cumsum(blocks_of) - blocks_of, np.cumsum(lengths) - lengths
        n_blocks = int(blocks_of.sum())
        used = np.nonzero(ids >= 0)[0]
        used = used[informative[ids[used]]]
        if not len(used):
            return [[] for _ in words_by_doc]
        doc = np.searchsorted(first_word, used, side="right") - 1
        block = first_block[doc] + (used - first_word[doc]) // STEP
        count = np.bincount(block, minlength=n_blocks + 1)
        edges = np.nonzero(np.diff(block, prepend=-1))[0]
        sums = np.zeros((n_blocks + 1, vectors.shape[1]), dtype=np.float32)
        sums[block[edges]] = np.add.reduceat(vectors[ids[used]], edges, axis=0)
        # A window is a block and the next one of the same document.
        last = np.zeros(n_blocks + 1, dtype=bool)
        last[first_block[blocks_of > 0] + blocks_of[blocks_of > 0] - 1] = True
        follows = ~last[:-1]
        windows = sums[:-1] + sums[1:] * follows[:, None]
        words_in = count[:-1] + count[1:] * follows
        live = np.nonzero(words_in >= 2)[0]
        possible, first_stretch = possible_items(ids, lengths, [np.array([of[w] for w in ws]) for ws in items], len(of))
        for at in range(0, len(live), 4096):
            part = live[at : at + 4096]
            w = windows[part]
            size = np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)
            dots = w @ latent.T
            rows, columns = np.nonzero(dots >= MIN_COSINE * size)
            docs_of = np.searchsorted(first_block, part[rows], side="right") - 1
            stretch = first_stretch[docs_of] + (part[rows] - first_block[docs_of]) * STEP // STRETCH
            can = possible[stretch, item_of[columns]]
            rows, columns = rows[can], columns[can]
            docs_of = np.searchsorted(first_block, part[rows], side="right") - 1
            places = (part[rows] - first_block[docs_of]) * STEP
            cosines = dots[rows, columns] / size[rows, 0]
            for d, place, item, cosine in zip(docs_of.tolist(), places.tolist(), item_of[columns].tolist(), cosines.tolist(), strict=True):
                if leaked(*found[d].get(item, (0.0, 0.0, 0.0))[:2]):
                    continue
                share, answer = best_match(items[item], words_by_doc[d], place)
                if leaked(share, answer):
                    found[d][item] = (share, answer, cosine)
        return [
            [{"item_id": item_ids[k], "lcs": v[0], "answer": v[1], "cosine": v[2]} for k, v in sorted(f.items())] for f in found
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            leaks: list[list[dict]] = []
            group: list[list[bytes]] = []
            held = 0
            for t in batch.column(batch.num_columns - 1).to_pylist():
                group.append(words_of(t))
                held += len(group[-1])
                if held >= _CHUNK_WORDS:
                    leaks += search(group, model)
                    group, held = [], 0
            if group:
                leaks += search(group, model)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(keep)), pa.array(leaks, leak_type)], names=names)

    return run


_LEAKS = T.ArrayType(
    T.StructType([T.StructField("item_id", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("lcs", "answer", "cosine")]])
)


def _with_leaks(rows: DataFrame) -> T.StructType:
    return rows.drop("__text").schema.add("leaks", _LEAKS)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_items: int = BLOCK_ITEMS,
    keep_text: bool = False,
) -> DataFrame:
    """``docs`` (without the text unless ``keep_text``) with ``leaks``: the benchmark items each text holds.

    Null and empty texts, and items without words, match nothing; repeated rows
    stay repeated; an empty benchmark gives empty lists; an empty table an
    empty result.  A column of ``docs`` named like the result is replaced.
    """
    spark = docs.sparkSession
    held = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    held = held.where(F.col("text").isNotNull())
    blocks = max(1, -(-held.count() // block_items))
    columns = [c for c in docs.columns if c.lower() != "leaks" and (keep_text or c != text)]
    result = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").alias("__text"))
    empty = "cast(array() as array<struct<item_id:bigint,lcs:double,answer:double,cosine:double>>)"
    result = result.withColumn("leaks", F.expr(empty))
    everything = [(r["item_id"], words_of(r["text"])) for r in held.select("item_id", "text").collect()]  # the query set
    everything = sorted((i, ws) for i, ws in everything if ws)
    if not everything:
        return result.drop("__text")
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in everything for w in ws}))}
    df, n = document_frequencies(docs, text, vocabulary)
    idf = np.maximum(np.log((n + 1) / (df + 1)), 1e-3)
    vectors = (idf[:, None] * randomised_svd(held.select("text"), vocabulary, idf)).astype(np.float32)
    informative = idf >= MIN_IDF
    passages: list[tuple[int, list[int]]] = []
    for k, (_, ws) in enumerate(everything):
        ids = [vocabulary[w] for w in ws]
        parts = max(1, -(-len(ids) // PASSAGE_WORDS))
        for part in np.array_split(np.array(ids), parts):
            if not informative[part].any():  # of common words only: searched by all of them
                informative[part] = True
            passages.append((k, part.tolist()))
    for b in range(blocks):
        own = [k for k in range(len(everything)) if k % blocks == b]
        place = {k: i for i, k in enumerate(own)}
        parts = [(place[k], [w for w in part if informative[w]]) for k, part in passages if k in place]
        if not parts:
            continue
        latent = np.stack([vectors[part].sum(axis=0) for _, part in parts])
        latent = (latent / np.maximum(np.linalg.norm(latent, axis=1), 1e-12)[:, None]).astype(np.float32)
        item_of = np.array([i for i, _ in parts], dtype=np.int64)
        model = (vocabulary, vectors, informative, [everything[k][1] for k in own], latent, item_of, [everything[k][0] for k in own])
        shared = spark.sparkContext.broadcast(model)
        kept = result.select(*[F.col(f"`{c}`") for c in columns], F.col("leaks").alias("__before"), "__text")
        if blocks == 1:
            kept = kept.drop("__before")
            return kept.mapInArrow(_search_job(shared, len(columns), [*columns, "leaks"]), _with_leaks(kept))
        # More blocks read the text again: it is carried along.
        carried = kept.select(*columns, "__before", F.col("__text").alias("__carried"), "__text")
        job = _search_job(shared, len(columns) + 2, [*columns, "__before", "__carried", "leaks"])
        result = carried.mapInArrow(job, _with_leaks(carried)).select(
            *[F.col(f"`{c}`") for c in columns], F.concat("__before", "leaks").alias("leaks"), F.col("__carried").alias("__text")
        )
    return result.drop("__text")
