"""Per-speaker Dirichlet-smoothed unigram language models, surprisal and divergences.

Counts, not tokens, move: tokens are summed to ``(speaker, word)`` before the
first shuffle, and meet their background counts there.  A statement lies in one
row, so its own counts need no shuffle.  Pairs of speaker and word that make up
at least ``1 / HEAD`` of all tokens are at most ``HEAD`` pairs and are broadcast;
only the other words of a statement meet their probabilities in an equi-join, in
which no key is hot for that reason, and come back as one list a statement.

``world`` names leading columns (a simulated replicate, a grid point): each world
has its own background and speakers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import ALPHA, MIN_SD, MIN_TOKENS
from .lineage import cut

#: A pair of speaker and word is broadcast if it makes up at least one in so many tokens (so there are at most so many).
HEAD = 1 << 18


#: A task holds so many counts of words, then passes them on; statements whose words are measured at once.
_TALLIED, _AT_ONCE = 1 << 19, 512
#: Bytes of words as they are in lower case, blanks for all others.
_PLAIN = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz'" else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))


def _split(text: bytes | None) -> list[bytes]:
    """The words that :func:`tokens` finds in UTF-8; two letters beyond ASCII have a lower case within it."""
    if not text:
        return []
    if not text.isascii():
        text = text.replace(b"\xe2\x84\xaa", b"k").replace(b"\xc4\xb0", b"i ")
    return text.translate(_PLAIN).split()


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def term_counts(statements: DataFrame, keys: Sequence[str] = ("id", "speaker", "window"), text: str = "text") -> DataFrame:
    """``(*keys, word, c)``."""
    words = statements.select(*keys, F.explode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("word"))
    return words.groupBy(*keys, "word").agg(F.count("*").alias("c"))


def background(terms: DataFrame, world: Sequence[str] = ()) -> DataFrame:
    """``(*world, word, c_bg)`` over all statements, both windows."""
    return terms.groupBy(*world, "word").agg(F.sum("c").alias("c_bg"))


def modelled_speakers(statements: DataFrame, world: Sequence[str] = (), min_statements: int = 2) -> DataFrame:
    """``(*world, speaker)`` with enough baseline statements, whether or not these hold any token."""
    base = statements.where("window = 'baseline'").groupBy(*world, "speaker").agg(F.count("*").alias("_n"))
    return base.where(F.col("_n") >= min_statements).select(*world, "speaker")


def speaker_counts(terms: DataFrame, speakers: DataFrame, world: Sequence[str] = ()) -> DataFrame:
    """``(*world, speaker, word, c_s)`` over baseline statements of the modelled speakers."""
    base = terms.where("window = 'baseline'").groupBy(*world, "speaker", "word").agg(F.sum("c").alias("c_s"))
    return base.join(small(speakers), [*world, "speaker"], "left_semi")


def models_and_background(statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(speaker, word, c_s)`` of modelled speakers and ``(word, c_bg)``, from one count of each speaker's words."""
    used = cut(word_counts(statements))
    models = used.where("c_s is not null").join(small(modelled_speakers(statements)), "speaker", "left_semi").select("speaker", "word", "c_s")
    return models, used.groupBy("word").agg(F.sum("c_all").alias("c_bg"))


def background_probability() -> Column:
    return (F.coalesce("c_bg", F.lit(0)) + 0.5) / (F.col("n_bg") + 0.5 * F.col("v_bg") + 1)


def _tallied(n_who: int, names: list[str]):
    """Batches of ``(*who, base, text)`` -> uses of each word in baseline statements and in all, summed over a task's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple[Counter, Counter]] = {}
        kinds: list[pa.DataType] = []

        def passed() -> Iterator[pa.RecordBatch]:
            for who, (base, other) in found.items():
                words = list(base.keys() | other.keys())
                c_s = np.fromiter(map(base.get, words, repeat(0)), dtype=np.int64, count=len(words))
                c_all = c_s + np.fromiter(map(other.get, words, repeat(0)), dtype=np.int64, count=len(words))
                same = [pa.repeat(pa.scalar(w, kind), len(words)) for w, kind in zip(who, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(words, pa.binary()).cast(pa.string()), pa.array(c_s), pa.array(c_all)], names=names)
            found.clear()

        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(n_who)]
            who = zip(*[batch.column(i).to_pylist() for i in range(n_who)], strict=True)
            for w, base, text in zip(who, batch.column(n_who).to_pylist(), _bytes(batch.column(n_who + 1)), strict=True):
                found.setdefault(w, (Counter(), Counter()))[0 if base else 1].update(_split(text))
            if sum(len(base) + len(other) for base, other in found.values()) > _TALLIED:
                yield from passed()
        yield from passed()

    return run


def word_counts(statements: DataFrame, world: Sequence[str] = (), text: str = "text") -> DataFrame:
    """``(*world, speaker, word, c_s, c_all)``: uses in baseline statements (null if none) and in all, dealt by word.

    A task sums its words before they move, so a frequent word is a row for each task and speaker.
    """
    who = [*world, "speaker"]
    given = _given(statements, who)
    narrow = statements.select(*who, (F.col("window") == "baseline").alias("_base"), F.col(text).alias("_text"))
    found = narrow.mapInArrow(_tallied(len(who), [*who, "word", "_s", "_all"]), f"{given}, word string, _s long, _all long")
    return found.repartition(*world, "word").groupBy(*who, "word").agg(F.nullif(F.sum("_s"), F.lit(0)).alias("c_s"), F.sum("_all").alias("c_all"))


def _given(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema.fields)


def small(df: DataFrame, most: int = 1 << 17) -> DataFrame:
    """``df`` cut and, if it has at most ``most`` rows, marked for broadcasting: a table by speaker is not shuffled against."""
    held = cut(df)
    return F.broadcast(held) if held.count() <= most else held


def speaker_totals(statements: DataFrame, world: Sequence[str] = (), text: str = "text", min_statements: int = 2, used: DataFrame | None = None) -> DataFrame:
    """``(*world, speaker, n_s)`` of modelled speakers: tokens of their baseline statements; ``used``: their :func:`word_counts`, if at hand."""
    who = [*world, "speaker"]
    used = word_counts(statements, world, text) if used is None else used
    sums = used.groupBy(*who).agg(F.sum("c_s").alias("n_s"))
    own = modelled_speakers(statements.where(F.col("speaker").isNotNull()), world, min_statements)
    return own.join(small(sums), who, "left").withColumn("n_s", F.coalesce("n_s", F.lit(0)))


def _known(statements: DataFrame, world: Sequence[str], text: str) -> DataFrame:
    """:func:`word_counts` plus the uses by all speakers, ``c_bg``, and one row marked ``_first`` for each word; cut."""
    same = Window.partitionBy(*world, "word")
    used = word_counts(statements, world, text)
    # A word has one row for each speaker; one window of one order serves both.
    return cut(used.select("*", F.sum("c_all").over(same).alias("c_bg"), F.col("speaker").eqNullSafe(F.min("speaker").over(same)).alias("_first")))


def probabilities(
    statements: DataFrame, speakers: DataFrame, alpha: float = ALPHA, world: Sequence[str] = (), text: str = "text", used: DataFrame | None = None
) -> DataFrame:
    """``(*world, speaker, word, c_all, novel, p)`` of every word that a modelled speaker uses; ``speakers`` has ``n_s``, ``used`` is :func:`_known`."""
    every = _known(statements, world, text) if used is None else used
    sums = [F.sum("c_all").alias("n_bg"), F.count_if("_first").alias("v_bg")]
    known = every.join(speakers, [*world, "speaker"])
    known = known.join(small(every.groupBy(*world).agg(*sums)), list(world)) if world else known.crossJoin(F.broadcast(every.agg(*sums)))  # one row
    p = (F.coalesce("c_s", F.lit(0)) + alpha * background_probability()) / (F.col("n_s") + alpha)
    return known.select(*world, "speaker", "word", "c_all", F.col("c_s").isNull().alias("novel"), p.alias("p"))


def _dealt(shared, n_keys: int, n_who: int, names: list[str]):
    """Batches of ``(*keys, text)`` -> counts and probabilities of frequent pairs, words and counts of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, p, novel = shared.value
        for batch in batches:
            who = zip(*[batch.column(i).to_pylist() for i in range(n_who)], strict=True)
            own: list[tuple] = []
            for w, text in zip(who, _bytes(batch.column(n_keys)), strict=True):
                counts = Counter(_split(text))
                at = np.fromiter(map(places.get(w, {}).get, counts, repeat(-1)), dtype=np.int64, count=len(counts))
                c = np.fromiter(counts.values(), dtype=np.int32, count=len(counts))
                held = at >= 0
                rest = b" ".join(compress(counts, (~held).tolist())).decode()
                own.append((int(c[held & novel[at]].sum()), c[held].tobytes(), p[at[held]].tobytes(), rest, c[~held]))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.list_(pa.int32()))
            made = [pa.array([x[i] for x in own], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], *made], names=names)

    return run


def _surprised(n_keys: int, names: list[str]):
    """Batches of ``(*keys, novel, c, p, rare_novel, rare_c, rare_p)`` -> the measures of each statement with tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _AT_ONCE):
                batch = whole.slice(first, _AT_ONCE)
                novel, c, p, rare_novel, rare_c, rare_p = (batch.column(n_keys + i) for i in range(6))
                row, c, p = _flat(c, p, rare_c, rare_p)
                total = lambda x: np.bincount(row, weights=x, minlength=batch.num_rows)  # noqa: B023, E731
                n = total(c)
                kept = np.flatnonzero(n)
                q, pp = c / n[row], p / total(p)[row]
                m = (q + pp) / 2
                jsd = total(q * np.log2(q / m)) / 2 + total(pp * np.log2(pp / m)) / 2
                new = novel.to_numpy(zero_copy_only=False) + rare_novel.fill_null(0).to_numpy(zero_copy_only=False)
                made = [-total(c * np.log2(p))[kept] / n[kept], total(q * np.log2(q / pp))[kept], jsd[kept], new[kept] / n[kept]]
                keys = [batch.column(i).take(pa.array(kept)) for i in range(n_keys)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(n[kept].astype(np.int64)), *[pa.array(x) for x in made]], names=names)

    return run


def _flat(c: pa.Array, p: pa.Array, rare_c: pa.Array, rare_p: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, count and probability of every word of a batch; frequent words lie in bytes, rare ones in lists (null: none)."""
    often = np.array([len(x) // 8 for x in p.to_pylist()], dtype=np.int64)
    rare = rare_c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.arange(len(often))
    flat = lambda kind, inside, lists: np.concatenate((np.frombuffer(b"".join(inside.to_pylist()), dtype=kind), lists.flatten().to_numpy(zero_copy_only=False))).astype(float)
    return np.concatenate((np.repeat(rows, often), np.repeat(rows, rare))), flat(np.int32, c, rare_c), flat(float, p, rare_p)


def statement_surprise(
    statements: DataFrame,
    speakers: DataFrame,
    alpha: float = ALPHA,
    world: Sequence[str] = (),
    text: str = "text",
    head: int = HEAD,
    used: DataFrame | None = None,
) -> DataFrame:
    """One row for each statement with tokens of a modelled speaker: their number, cross-entropy, KL, JSD (bits) and novel rate.

    Rows of the same keys are one statement.
    """
    who = [*world, "speaker"]
    keys = [*who, "id", "window"]
    given = _given(statements, keys)
    known = probabilities(statements, speakers, alpha, world, text, used)
    total = known.agg(F.coalesce(F.sum("c_all"), F.lit(0))).first()[0]
    least = max(1, -(-total // head))
    often = known.where(F.col("c_all") >= least).select(*who, "word", "p", "novel").toArrow()
    places: dict[tuple, dict[str, int]] = {}
    for i, (word, *w) in enumerate(zip(often["word"].to_pylist(), *[often[x].to_pylist() for x in who], strict=True)):
        places.setdefault(tuple(w), {})[word.encode()] = i
    # One more, for the place -1 of words that are not there.
    shared = statements.sparkSession.sparkContext.broadcast((places, often["p"].to_numpy(), np.append(often["novel"].to_numpy().astype(bool), False)))
    plain = statements.select(*keys, F.col(text).alias("_text"))
    if not statements.groupBy(*keys).count().where("count > 1").isEmpty():
        plain = plain.groupBy(*keys).agg(F.array_join(F.collect_list("_text"), " ").alias("_text"))
    names = [*keys, "_novel", "_c", "_p", "_rare", "_rare_c"]
    dealt = plain.mapInArrow(_dealt(shared, len(keys), len(who), names), f"{given}, _novel long, _c binary, _p binary, _rare string, _rare_c array<int>")
    held = cut(dealt.withColumn("_row", F.monotonically_increasing_id()))
    pairs = F.explode(F.arrays_zip(F.split("_rare", " ").alias("w"), F.col("_rare_c").alias("c")))
    asked = held.where("_rare <> ''").select("_row", *who, pairs.alias("x")).select("_row", *who, F.col("x.w").alias("word"), F.col("x.c").alias("c"))
    met = asked.join(known.where(F.col("c_all") < least).drop("c_all"), [*who, "word"])
    rare = met.groupBy("_row").agg(F.sum(F.when(F.col("novel"), F.col("c")).otherwise(0)).alias("_rn"), F.collect_list("c").alias("_rc"), F.collect_list("p").alias("_rp"))
    joined = held.drop("_rare", "_rare_c").join(speakers, who, "left_semi").join(rare, "_row", "left").select(*keys, "_novel", "_c", "_p", "_rn", "_rc", "_rp")
    measures = ["n_tokens", "ce", "kl", "jsd", "novel"]
    return joined.mapInArrow(_surprised(len(keys), [*keys, *measures]), f"{given}, n_tokens long, ce double, kl double, jsd double, novel double")


def baseline_entropy(surprise: DataFrame, world: Sequence[str] = ()) -> DataFrame:
    """Mean and sample deviation of the speaker's own baseline cross-entropies (deviation 0 for one statement)."""
    return surprise.where("window = 'baseline'").groupBy(*world, "speaker").agg(
        F.avg("ce").alias("baseline_ce"), F.coalesce(F.stddev_samp("ce"), F.lit(0.0)).alias("baseline_ce_sd")
    )


def _each(statements: DataFrame, world: Sequence[str], text: str, alpha: float) -> DataFrame:
    """One row for each statement of a modelled speaker with its measures; no tokens: cross-entropy zero."""
    keys = [*world, "id", "speaker", "window"]
    used = _known(statements, world, text)
    speakers = small(speaker_totals(statements, world, text, used=used))
    # One narrow row for each statement, read twice.
    found = cut(statement_surprise(statements, speakers, alpha, world, text, used=used))
    return statements.select(*keys).join(speakers, [*world, "speaker"], "left_semi").join(found, keys, "left").withColumn("ce", F.coalesce("ce", F.lit(0.0)))


def baseline_entropy_table(statements: DataFrame, text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """``(speaker, baseline_ce, baseline_ce_sd)`` of every modelled speaker."""
    return baseline_entropy(_each(statements, (), text, alpha))


def surprisal(statements: DataFrame, text: str = "text", alpha: float = ALPHA, min_tokens: int = MIN_TOKENS, world: Sequence[str] = ()) -> DataFrame:
    """The measures of :func:`surprisal_and_entropy`."""
    return surprisal_and_entropy(statements, text, alpha, min_tokens, world)[0]


def surprisal_and_entropy(
    statements: DataFrame, text: str = "text", alpha: float = ALPHA, min_tokens: int = MIN_TOKENS, world: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """The speakers' baseline entropies second; first ``*world, id, speaker, window, n_tokens, cross_entropy, baseline_ce, surprisal_z, kl, jsd, novel_rate, insufficient``.

    Statements of speakers without a model, or under ``min_tokens`` tokens, get z
    zero and are flagged; a statement without tokens has cross-entropy zero in
    its speaker's baseline.
    """
    keys = [*world, "id", "speaker", "window"]
    each = _each(statements, world, text, alpha)
    entropy = small(baseline_entropy(each, world))
    joined = each.join(entropy, [*world, "speaker"], "left")
    short = F.coalesce("n_tokens", F.lit(0)) < min_tokens
    z = (F.col("ce") - F.col("baseline_ce")) / F.greatest(F.col("baseline_ce_sd"), F.lit(MIN_SD))
    scored = joined.select(
        *world,
        "id",
        "n_tokens",
        F.when(~short, F.round("ce", 4)).alias("cross_entropy"),
        F.when(~short, F.round("baseline_ce", 4)).alias("baseline_ce"),
        F.when(~short, F.round(z, 4)).alias("surprisal_z"),
        F.when(~short, F.round("kl", 4)).alias("kl"),
        F.when(~short, F.round("jsd", 4)).alias("jsd"),
        F.when(~short, F.round("novel", 4)).alias("novel_rate"),
    )
    measured = statements.select(*keys).join(scored, [*world, "id"], "left").select(
        *keys,
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        "cross_entropy",
        "baseline_ce",
        F.coalesce("surprisal_z", F.lit(0.0)).alias("surprisal_z"),
        "kl",
        "jsd",
        "novel_rate",
        F.col("cross_entropy").isNull().alias("insufficient"),
    )
    return measured, entropy


def against_all_speakers(texts: DataFrame, statements: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Cross-entropy of each of a few given texts under every speaker's model ("same words, different people").

    ``texts(text_id, text)`` is the stated query set: only its words are looked
    up, so the models are filtered by them before anything is joined.
    """
    used = cut(word_counts(statements))
    totals = small(speaker_totals(statements, used=used))
    asked = F.broadcast(term_counts(texts, ("text_id",)))
    words = F.broadcast(asked.select("word").distinct())
    own = used.where("c_s is not null").join(words, "word", "left_semi").drop("c_all")
    shape = used.agg(F.sum("c_all").alias("n_bg"), F.count_distinct("word").alias("v_bg"))
    common = used.join(words, "word", "left_semi").groupBy("word").agg(F.sum("c_all").alias("c_bg"))
    grid = totals.crossJoin(asked).crossJoin(F.broadcast(shape))
    return (
        grid.join(own, ["speaker", "word"], "left")
        .join(F.broadcast(common), "word", "left")
        .withColumn("p", (F.coalesce("c_s", F.lit(0)) + alpha * background_probability()) / (F.col("n_s") + alpha))
        .groupBy("text_id", "speaker")
        .agg(
            F.sum("c").alias("n_tokens"),
            F.round(-F.sum(F.col("c") * F.log2("p")) / F.sum("c"), 4).alias("cross_entropy"),
            F.round(F.sum(F.when(F.col("c_s").isNull(), F.col("c")).otherwise(0)) / F.sum("c"), 4).alias("novel_rate"),
        )
    )


def top_vocabulary(models: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent words of each speaker (ties alphabetical)."""
    order = Window.partitionBy("speaker").orderBy(F.desc("c_s"), "word")
    return models.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
