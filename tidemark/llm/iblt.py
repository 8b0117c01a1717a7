"""Document fingerprints as invertible Bloom lookup sketches, native expressions only.

A text is a set of hashed passages (paragraphs, long ones cut after sentence
marks).  A sketch puts each passage digest into three cells, one in each third;
a cell is ``(count, xor of digests, xor of check hashes)``.  Two sketches
subtract cell by cell; a cell with count 1 or -1 whose digest matches its check
is *pure* and gives a digest that only one side has, which is then taken out of
its other cells.  Peeling goes third by third, so a digest is never counted
twice.  Pairs whose cells do not all come to nothing are tried again with a
larger sketch that has room for every passage of both sides.

Cells are rows, dealt by document once; every sketch, subtraction and peeling
step of every try groups by document and cell and so needs no further exchange.
A document's cells lie in one task (they are as many as its passages); nothing
is gathered over documents.  Tasks are sized by the passages they hold, and
cells are grouped by a structure: for plain columns each of the nested
aggregations of a task would claim a page of memory (64 MB) beforehand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Cells of the printed sketch and of the first try.
CELLS = 60
#: Peeling steps of one try, each over one third of the cells.
STEPS = 9
MAX_TRIES = 8
#: A passage runs inside one paragraph (line) for at least so many characters, up to a sentence mark.
PASSAGE_CHARS = 100
_PASSAGE = rf"[^\n]{{1,{PASSAGE_CHARS}}}[^\n.!?]*[.!?]?"
#: Rows of one range of ids, about; quantiles that cut the ids into segments of ranges.
RANGE_ROWS = 1024
QUANTILES = 256
#: Passage digests, of a text, its edited version and the next one, whose cells are dealt to one task, about.
TASK_DIGESTS = 200_000


def digests(text: Column) -> Column:
    """The distinct passage digests of a text, ascending."""
    passages = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PASSAGE), F.lit(0))
    return F.sort_array(F.array_distinct(F.transform(passages, lambda x: F.xxhash64(x))))


def _check(digest: Column) -> Column:
    return F.xxhash64(F.lit("check"), digest)


def _cell(i: Column, digest: Column, third: Column) -> Column:
    """The cell of a digest in the ``i``-th third: 20 of its bits, modulo the third."""
    part = F.call_function("shiftrightunsigned", digest, (i * 20).cast("int")).bitwiseAND(F.lit(0xFFFFF).cast("long"))
    return (F.pmod(part, third) + i * third).cast("int")


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add up entries cell by cell; cells that come to nothing go (markers, below zero, stay).

    The first key, by which rows are dealt, is grouped by as it is, the others as one structure.
    """
    inner = [*keys[1:], "c"]
    return (
        rows.groupBy(keys[0], F.struct(*inner).alias("__cell"))
        .agg(F.sum("n").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("k").alias("k"))
        .select(keys[0], *[F.col("__cell")[x].alias(x) for x in inner], "n", "d", "k")
        .where("c < 0 or n <> 0 or d <> 0 or k <> 0")
    )


def sketches(sides: DataFrame, keys: list[str]) -> DataFrame:
    """``sides(*keys, third, digests)`` -> sparse sketches ``(*keys, third, c, n, d, k)``."""
    each = sides.select(*keys, "third", F.explode("digests").alias("d"))
    entries = each.select(*keys, "third", "d", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i"))
    return _summed(
        entries.select(
            *keys,
            "third",
            _cell(F.col("i"), F.col("d"), F.col("third").cast("long")).alias("c"),
            F.lit(1).cast("long").alias("n"),
            "d",
            _check(F.col("d")).alias("k"),
        ),
        [*keys, "third"],
    )


def peeled(cells: DataFrame, keys: list[str], steps: int = STEPS) -> DataFrame:
    """Subtracted sketches -> ``(*keys, only_a, only_b, stuck)``: digests only one side has, cells left over."""
    third, c, n, d, k, i = F.col("third").cast("long"), *(F.col(x) for x in ("c", "n", "d", "k", "i"))
    stays, marks = F.lit(-9), F.lit(-1)
    for step in range(steps):
        t = step % 3
        pure = (c >= t * third) & (c < (t + 1) * third) & (F.abs(n) == 1) & (k == _check(d))
        # A pure cell turns into what its digest takes out of the other two thirds, and a marker that counts it.
        into = F.when(pure, F.array(*[F.lit(x) for x in range(3) if x != t], marks)).otherwise(F.array(stays))
        rows = cells.select(*keys, "third", "c", "n", "d", "k", F.explode(into).alias("i"))
        moved = rows.select(
            *keys,
            "third",
            F.when(i == stays, c).when(i == marks, F.when(n > 0, F.lit(-1)).otherwise(F.lit(-2))).otherwise(_cell(i, d, third)).alias("c"),
            F.when(i == stays, n).when(i == marks, F.lit(1)).otherwise(-n).cast("long").alias("n"),
            F.when(i == marks, F.lit(0)).otherwise(d).cast("long").alias("d"),
            F.when(i == marks, F.lit(0)).otherwise(k).cast("long").alias("k"),
        )
        cells = _summed(moved, [*keys, "third"])
        # Observing the cells left also ends the generated-code stage: one compiled unit of all steps
        # would be too large for the JIT compiler's memory.
        cells = cells.observe(f"cells_{uuid.uuid4().hex}", F.count(F.lit(1)).alias("left"))
    return cells.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("c") == -1, F.col("n"))), F.lit(0)).alias("only_a"),
        F.coalesce(F.sum(F.when(F.col("c") == -2, F.col("n"))), F.lit(0)).alias("only_b"),
        F.count_if(F.col("c") >= 0).alias("stuck"),
    )


def differences(pairs: DataFrame, key: str, cells: int = CELLS, steps: int = STEPS) -> DataFrame:
    """``pairs(key, pair, a, b)`` of digest arrays -> ``(key, pair, only_a, only_b)``.

    Pairs whose arrays are equal have no row.  The first try takes ``cells``
    cells; pairs that do not peel are tried again with room for all their
    digests, then with twice that, and so on; an error is raised when
    ``MAX_TRIES`` were not enough (odds beyond any practical concern).
    """
    keys = [key, "pair"]
    todo = pairs.where(F.col("a") != F.col("b")).withColumn("third", F.lit(cells // 3))
    done: list[DataFrame] = []
    for attempt in range(MAX_TRIES):
        sides = todo.select(
            *keys,
            "third",
            F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("a").alias("digests")), F.struct(F.lit(-1).alias("sign"), F.col("b").alias("digests")))).alias("s"),
        ).select(*keys, "third", "s.sign", "s.digests")
        both = sketches(sides, [*keys, "sign"])
        subtracted = _summed(both.withColumn("n", F.col("n") * F.col("sign")), [*keys, "third"])
        tried = written(peeled(subtracted, keys, steps), "peeled")
        done.append(tried.where("stuck = 0").select(*keys, "only_a", "only_b"))
        failed = tried.where("stuck > 0").select(*keys)
        if failed.isEmpty():
            break
        room = F.size("a") + F.size("b") + F.lit(8)
        # Joined by the key alone, the digests stay in the tasks they were dealt to.
        again = failed.groupBy(key).agg(F.collect_set("pair").alias("__again"))
        todo = todo.join(again, key).where(F.array_contains("__again", F.col("pair"))).drop("__again").withColumn("third", (room * F.lit(2**attempt)).cast("int"))
    else:
        raise RuntimeError("sketches did not peel")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _printed(side: str) -> Column:
    """Aggregate: the fingerprint as text, ``cell.count.digest.check`` of each used cell in hexadecimal."""
    cells = F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("c", "n", "d", "k"))))
    return F.array_join(
        F.transform(cells, lambda c: F.concat_ws(".", F.hex(c["c"]), F.hex(c["n"]), F.hex(c["d"]), F.hex(F.shiftrightunsigned(c["k"], 32)))),
        ",",
    )


# ------------------------------------------------------- successors by id


def successors(ids: DataFrame, per_range: int = RANGE_ROWS) -> DataFrame:
    """Distinct ``(id)`` -> ``(id, next_id)`` without sorting all ids in one task (the last has none).

    Ids fall into equal ranges; inside a range a window finds the next id, the
    last of a range takes the first of the next non-empty range, found the same
    way among the far fewer range minima.
    """
    shape = ids.agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    n = shape["n"]
    if n <= per_range:  # a bounded number of rows in this one task
        return ids.select("id", F.lead("id").over(Window.partitionBy(F.lit(0)).orderBy("id")).alias("next_id"))
    width = -(-(shape["hi"] - shape["lo"] + 1) * per_range // n)
    placed = ids.select("id", F.floor((F.col("id") - F.lit(shape["lo"])) / F.lit(width)).alias("range"))
    firsts = written(placed.groupBy("range").agg(F.min("id").alias("id")), "firsts")
    bridges = firsts.join(successors(firsts.select("id"), per_range), "id").select("range", F.col("next_id").alias("after"))
    inner = placed.select("id", "range", F.lead("id").over(Window.partitionBy("range").orderBy("id")).alias("within"))
    return inner.join(bridges, "range", "left").select("id", F.coalesce("within", "after").alias("next_id"))


def ranged(rows: DataFrame, n: int, per_range: int = RANGE_ROWS) -> DataFrame:
    """``rows(doc_id, text)`` plus ``range``, ascending with ``(doc_id, hash of text)``, nulls first.

    Quantiles of the ids cut segments of equal numbers of rows, each of which is
    cut into equal widths.  An id that spans several quantiles is cut by the
    hash of its texts, and so are rows without an id.
    """
    segments = max(1, min(QUANTILES, -(-n // per_range)))
    steps = [i / segments for i in range(segments + 1)]
    shape = rows.agg(F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.percentile_approx("doc_id", steps, 20 * QUANTILES).alias("q")).first()
    cuts, nulls = shape["q"] or [0, 0], shape["nulls"]
    width = max(1, -(-(n - nulls) // (segments * per_range)))  # ranges of a segment
    missing = max(1, -(-nulls // per_range))
    q = F.array(*[F.lit(x).cast("long") for x in cuts])
    unit = (F.xxhash64("text").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)

    def sliced(part: Column, ranges: Column) -> Column:
        return F.least(F.floor(part * ranges), ranges.cast("long") - 1)

    i, j = F.col("__i"), F.col("__j")  # quantiles at most the id, and below it
    low, high = (F.element_at(q, F.greatest(F.least(x, F.lit(len(cuts))), F.lit(1))).cast("double") for x in (i, i + 1))
    share = F.greatest(F.least((F.col("doc_id").cast("double") - low) / F.greatest(high - low, F.lit(1.0)), F.lit(1.0)), F.lit(0.0))
    spread = (j + 1) * width + sliced(unit, (i - j - 1) * width)
    usual = i * width + sliced(share, F.lit(width))
    placed = F.when(F.col("doc_id").isNull(), sliced(unit, F.lit(missing)) - missing).when(i - j >= 2, spread).otherwise(usual)
    counted = rows.withColumn("__i", F.size(F.filter(q, lambda x: x <= F.col("doc_id")))).withColumn("__j", F.size(F.filter(q, lambda x: x < F.col("doc_id"))))
    return counted.withColumn("range", placed.cast("long")).drop("__i", "__j")


def _edited(text: Column, following: Column) -> Column:
    cut = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(following, F.lit(1), cut))


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited version, and their likeness.

    The edited text has its last ``floor(n/2)`` code points replaced by the
    first as many (or all) of the next document by ascending id; the document
    after the last is the first.  Likeness is shared passages over all passages
    of both sides, 1 for two texts without passages.  Null texts are empty.
    Rows with the same id follow each other by the hash of their text, rows
    with a null id come first, ordered the same way.  A table of one row
    follows itself; an empty table gives an empty result; further columns are
    ignored.  Ids are whole numbers, or text that reads as one.  Rows are dealt
    to ranges of about ``RANGE_ROWS`` rows by quantiles of the id, and by the
    hash of the text where many rows share an id or have none.
    """
    own = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    n = own.count()
    placed = ranged(own, n)
    order = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc())
    ordered = placed.select(
        "doc_id", "range", "text", F.row_number().over(order).alias("rank"), F.lead("text").over(order).alias("following")
    )

    def measured(rows: DataFrame, more: list[Column]) -> DataFrame:
        edit = _edited(F.col("text"), F.col("following"))
        return rows.withColumn("edited", edit).select(
            "doc_id",
            F.length("text").cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            digests(F.col("text")).alias("own"),
            digests(F.col("edited")).alias("edit"),
            digests(F.col("following")).alias("next"),
            *more,
        )

    last = F.col("following").isNull()
    # Only the first and the last row of a range keep their text.
    first_pass = written(
        measured(
            ordered,
            [
                "range",
                last.alias("is_last"),
                (F.col("rank") == 1).alias("is_first"),
                F.when(last | (F.col("rank") == 1), F.col("text")).alias("text"),
            ],
        ),
        "edits",
    )
    ranges = written(first_pass.where("is_first").select(F.col("range").alias("id")), "ranges")
    least = ranges.agg(F.min("id")).first()[0]
    after = successors(ranges).select(F.col("id").alias("range"), F.coalesce("next_id", F.lit(least)).alias("next_range"))
    firsts = first_pass.where("is_first").select(F.col("range").alias("next_range"), F.col("text").alias("following"))
    ends = first_pass.where("is_last").select("doc_id", "range", "text").join(after, "range").join(firsts, "next_range")
    columns = ["doc_id", "n_chars", "edited_sha256", "own", "edit", "next"]
    every = first_pass.where("not is_last").select(*columns).unionByName(measured(ends.select("doc_id", "text", "following"), []))
    held = F.size("own") + F.size("edit") + F.size("next")
    base = written(every.withColumn("row", F.monotonically_increasing_id()).withColumn("held", held), "digests")

    n_digests = base.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_digests // TASK_DIGESTS))
    dealt = base.repartition(tasks, "row")
    pairs = dealt.select(
        "row",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("pair"), F.col("own").alias("a"), F.col("edit").alias("b")),
                F.struct(F.lit(1).alias("pair"), F.col("own").alias("a"), F.col("next").alias("b")),
            )
        ).alias("p"),
    ).select("row", "p.*")
    found = differences(pairs, "row").groupBy("row").agg(
        *[F.max(F.when(F.col("pair") == p, F.col("only_a") + F.col("only_b"))).alias(f"apart{p}") for p in (0, 1)]
    )
    shown = dealt.select(
        "row",
        F.explode(
            F.array(
                F.struct(F.lit("own").alias("side"), F.col("own").alias("digests")),
                F.struct(F.lit("edit").alias("side"), F.col("edit").alias("digests")),
            )
        ).alias("s"),
    ).select("row", "s.side", "s.digests", F.lit(CELLS // 3).alias("third"))
    prints = sketches(shown, ["row", "side"]).groupBy("row").agg(_printed("own").alias("p_own"), _printed("edit").alias("p_edit"))

    def near(apart: str, other: str) -> Column:
        total = (F.size("own") + F.size(other) + F.coalesce(apart, F.lit(0))) / F.lit(2.0)
        return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.coalesce(apart, F.lit(0)) / total)

    def shown_as(name: str, side: str) -> Column:
        return F.concat_ws(":", F.size(side).cast("string"), F.coalesce(name, F.lit("")))

    return (
        dealt.join(prints, "row", "left")
        .join(found, "row", "left")
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            shown_as("p_own", "own").alias("fingerprint"),
            shown_as("p_edit", "edit").alias("edited_fingerprint"),
            near("apart0", "edit").alias("near_edited"),
            near("apart1", "next").alias("near_next"),
            F.size("own").cast("long").alias("n_passages"),
        )
    )
