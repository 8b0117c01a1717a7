import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, cotrain, ctw, latent_leaks, tails, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


# -------------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def vocabulary():
    with open(VOCABULARY, "rb") as f:
        return bpe.Vocabulary(f.read())


def hard_texts():
    rng = random.Random(1)
    low = [chr(c) for c in range(1, 0x250)]
    wide = ["a", " ", "\n", "1", "!", "é", " ", "中", "😀", " ", "Ⅷ", "'s", "​", "ﬁ", "٣", "̀"]
    texts = ["", "<|endoftext|>a<|endoftext|>", "a" * 3000, " " * 50, "\x1c\x1d a\x85b\xa0c", "it's we'll I'D", "\r\n\r\n x"]
    texts += ["".join(rng.choice(low) for _ in range(80)) for _ in range(200)]
    texts += ["".join(rng.choice(wide) for _ in range(60)) for _ in range(200)]
    return texts + [f"a{c}b {c}{c} 1{c} {c}a" for c in low]


def test_bpe_matches_the_library(frame, docs):
    own = Tokenizer.from_file(VOCABULARY)
    own.no_truncation()
    own.no_padding()
    texts = [t for t in hard_texts() if "\x00" not in t] + [r["text"] for r in docs.select("text").collect()]
    got = {r["doc_id"]: r for r in bpe.encode(frame(texts), VOCABULARY, with_ids=True).collect()}
    for i, (t, e) in enumerate(zip(texts, own.encode_batch(texts, add_special_tokens=False))):
        r = got[i]
        assert np.frombuffer(r["ids"], "<u4").tolist() == e.ids, repr(t)
        assert r["n_tokens"] == len(e.ids) and r["ids_sha256"] == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()
        assert r["decoded"] == own.decode(e.ids, skip_special_tokens=False) == t


def test_bpe_edges(spark, frame):
    empty = hashlib.sha256(b"").hexdigest()
    r = bpe.encode(frame([(1, None)]), VOCABULARY).first()
    assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (0, empty, empty)
    assert bpe.encode(frame([]), VOCABULARY).count() == 0
    df = spark.createDataFrame([(1, "a b", 9, "x")], "doc_id int, text string, N_tokens int, other string")
    assert bpe.encode(df, VOCABULARY).columns == ["doc_id", "other", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_own_merges_equal_the_fast_ones(vocabulary):
    rng = random.Random(2)
    for _ in range(300):
        piece = "".join(rng.choice("theandoinr éß1!") for _ in range(rng.randrange(1, 40))).encode()
        assert vocabulary.merged(piece) == vocabulary.piece(piece)


def test_lexicon_is_exact_and_shares_suffixes(vocabulary):
    words = {f"{a}{b}{c}".encode(): [i] for i, (a, b, c) in enumerate((a, b, c) for a in "pqrs" for b in ("", "a", "é") for c in ("ing", "ed", "s"))}
    data = np.frombuffer(bpe.compile_lexicon(words), "<i4")
    lexicon = bpe.Lexicon(data)
    at = lexicon.find([*words, b"", b"p", b"ping!", b"zing"])
    assert [lexicon.output(i).tolist() for i in at[: len(words)]] == list(words.values()) and (at[-4:] == -1).all()
    assert len(lexicon.final) < sum(map(len, words)) / 4  # far fewer states than a trie's
    assert (bpe.Lexicon(np.frombuffer(bpe.compile_lexicon({}), "<i4")).find([b"a"]) == -1).all()


# ---------------------------------------------------------- language model


def test_base_score_and_folds(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    train = [(d, t) for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    counts = Counter(w for _, t in train for w in t.encode().lower().split())
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    for r in ctw.language_scores(docs, frequent=300).collect():
        words = dict(rows)[r["doc_id"]].encode().lower().split()
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((len(train) + 1) / (n + v + 1))
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words) + 1, sum(w in counts for w in words) + 1, n)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert r["score"] < 0


def slow_ctw(train, text, shape):
    """The weighted prediction of each bit by the definition, over the same contexts."""

    def path(data, i):
        near = [int(ctw._NEAR_CLASS[data[i - 1]]) if i else 0]
        far = [int(ctw._FAR_CLASS[data[i - j]]) if i - j >= 0 else 0 for j in range(2, ctw.DEPTH + 1)]
        out = [(), (near[0],), (near[0], far[0]), (near[0], far[0], far[1])]
        code = near[0] * 1024 + far[0] * 32 + far[1]
        known = set(zip(shape.depths.tolist(), shape.codes.tolist()))
        for d in range(4, ctw.DEPTH + 1):
            code = code * 32 + far[d - 2]
            if (d, code) not in known:
                break
            out.append((*out[-1], far[d - 2]))
        return out

    counts, alone, children = {}, {}, {}
    for t in train:
        data = t + b"\xff"
        for i, byte in enumerate(data):
            contexts = path(data, i)
            for k in range(8):
                prefix, bit = (k, byte >> (8 - k)), byte >> (7 - k) & 1
                for c in contexts:
                    counts.setdefault((c, prefix), [0, 0])[bit] += 1
                alone.setdefault((contexts[-1], prefix), [0, 0])[bit] += 1
                for a, b in zip(contexts, contexts[1:]):
                    children.setdefault((a, prefix), set()).add(b)
    inner_base = {c for c, _ in children if len(c) >= 3}

    def block(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi) if z + o else 0.0

    def weighted(c, prefix):
        own = block(*counts.get((c, prefix), (0, 0)))
        if len(c) >= 3 and c not in inner_base:
            return own, 1.0
        below = sum(weighted(b, prefix)[0] for b in children.get((c, prefix), ()))
        if len(c) >= 3:
            below += block(*alone.get((c, prefix), (0, 0)))
        total = math.log(0.5) + np.logaddexp(own, below)
        return total, math.exp(math.log(0.5) + own - total)

    def kt(z, o):
        return (o + 0.5) / (z + o + 1)

    logp = 0.0
    data = text + b"\xff"
    for i, byte in enumerate(data):
        contexts = path(data, i)
        for k in range(8):
            prefix, bit = (k, byte >> (8 - k)), byte >> (7 - k) & 1
            last = contexts[-1]
            while len(contexts) > 1 and (contexts[-1], prefix) not in counts:
                contexts = contexts[:-1]
            p = None
            for c in reversed(contexts):
                own = kt(*counts.get((c, prefix), (0, 0)))
                stop = weighted(c, prefix)[1]
                if p is None:
                    rest = alone.get((c, prefix), (0, 0)) if len(c) >= 3 and c in inner_base else (0, 0)
                    p = stop * own + (1 - stop) * (kt(*rest) if sum(rest) else own)
                else:
                    p = stop * own + (1 - stop) * p
            contexts = path(data, i)
            assert contexts[-1] == last
            logp += math.log10(p if bit else 1 - p)
    return logp


def test_context_tree_against_the_definition():
    train = [b"the cat sat on the mat. the cat sat.", b"the hat and the cat", b"a man, a plan", "café".encode()]
    found = Counter()
    for o in ctw._count_contexts(iter([__import__("pyarrow").RecordBatch.from_arrays([__import__("pyarrow").array(train * 4)], names=["t"])])):
        for d, c, n in zip(*(o.column(i).to_pylist() for i in range(3))):
            found[(d, c)] += n
    top = sorted(found, key=lambda x: (-found[x], x))[:12]
    shape = ctw.Shape(np.array([d for d, _ in top]), np.array([c for _, c in top], dtype=np.int64))
    assert len(shape.codes) >= 6
    cells, n = np.unique(np.concatenate([ctw.cells_of([t], shape)[0] for t in train]), return_counts=True)
    model = ctw.fit(cells, n, shape)
    texts = [b"the cat", b"a plan the", b"", b"zq", b"the mat sat on the cat."]
    got = model.score(texts)
    for t, s in zip(texts, got):
        assert math.isclose(s, slow_ctw(train, t, shape), rel_tol=2e-3, abs_tol=0.02), t
    assert np.allclose(got, [model.score([t])[0] for t in texts])
    assert np.allclose((10.0 ** model.table.astype(float)).sum(axis=1), 1, atol=0.01)


def test_scores_do_not_depend_on_partitions_or_batches(spark, docs):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = []
    try:
        for parts, batch in ((1, 10000), (7, 50)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
            found.append({r["doc_id"]: r["score"] for r in ctw.language_scores(docs.repartition(parts)).collect()})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found[0].keys() == found[1].keys() and all(math.isclose(found[0][d], found[1][d], rel_tol=1e-9) for d in found[0])


def test_every_context_is_found(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [bytes(rng.choice(list(b"ab c\n"), 300).tolist()) for _ in range(5)]
    data, base, far, at, _ = ctw.contexts_of(texts)
    codes, levels = {}, base.astype(np.int64)
    for d in range(4, ctw.DEPTH + 1):
        levels = levels * ctw.FAR + far[at - d]
        codes[d] = levels
    depths = np.concatenate([np.full(len(np.unique(c)), d) for d, c in codes.items()])
    every = np.concatenate([np.unique(c) for c in codes.values()])
    keep = rng.random(len(every)) < 0.7
    shape = ctw.Shape(depths[keep], every[keep])
    known = {(int(d), int(c)): ctw.BASE + i for i, (d, c) in enumerate(zip(shape.depths, shape.codes))}
    assert set(known) <= set(zip(depths[keep].tolist(), every[keep].tolist()))
    got = shape.rows(base, far, at)
    for i in range(len(at)):
        want = int(base[i])
        for d in range(4, ctw.DEPTH + 1):
            if (d, int(codes[d][i])) not in known:
                break
            want = known[(d, int(codes[d][i]))]
        assert got[i] == want
    for i, (d, c) in enumerate(zip(shape.depths.tolist(), shape.codes.tolist())):
        assert shape.parents[i] == (c // ctw.FAR if d == 4 else known[(d - 1, c // ctw.FAR)] - ctw.BASE)


def test_contexts_are_chosen_over_all_training_text(spark, frame, monkeypatch):
    """The most frequent contexts and their cells, whatever the chunks, their threshold and the number of documents."""
    rng = np.random.default_rng(8)
    texts = [rng.choice(list(b"abcd \n"), 400, p=[0.3, 0.25, 0.2, 0.1, 0.1, 0.05]).astype(np.uint8).tobytes() for _ in range(60)]
    counts = Counter()
    for t in texts:
        _, base, far, at, _ = ctw.contexts_of([t])
        codes = base.astype(np.int64)
        for d in range(4, ctw.DEPTH + 1):
            codes = codes * ctw.FAR + far[at - d]
            counts.update((d, c) for c in codes.tolist())
    rows = 500
    best = sorted((x for x in counts if counts[x] >= ctw.LEAST), key=lambda x: (-counts[x], x))[:rows]
    shape = ctw.Shape(np.array([d for d, _ in best]), np.array([c for _, c in best]))
    cells, n = np.unique(np.concatenate([ctw.cells_of([t], shape)[0] for t in texts]), return_counts=True)
    train = frame([t.decode() for t in texts]).select(F.col("text").cast("binary").alias("text")).repartition(3)
    for size, rate in ((1 << 23, ctw.RATE), (900, 1 / 300), (900, 1 / 50)):
        monkeypatch.setattr(ctw, "CHUNK_BYTES", size)
        monkeypatch.setattr(ctw.candidates, "__defaults__", (ctw.DEEP_ROWS, 1200, rate))
        got, table = ctw.counted(train, rows)
        assert sorted(zip(got.depths.tolist(), got.codes.tolist())) == sorted(best)
        assert dict(zip(table["cell"].to_pylist(), table["n"].to_pylist())) == dict(zip(cells.tolist(), n.tolist()))


def test_sums_of_contexts_and_cells_move_as_arrays(spark, frame, monkeypatch):
    """Few rows leave a task, with the sums of all that was counted."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = [bytes(np.random.default_rng(i).choice(list(b"abc d\n"), 700).tolist()) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])
    monkeypatch.setattr(ctw, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(ctw, "HELD_KEYS", 20_000)
    want = Counter()
    for b in ctw._count_contexts(iter([batch]), 1 / 500):
        for d, c, n, least in zip(*(x.to_pylist() for x in b.columns)):
            want[(c << 4) + d] += complex(n, least - 1)
    got, packets = {}, list(ctw._packed_contexts(iter([batch]), 1 / 500))
    assert max(Counter(x for b in packets for x in b["bucket"].to_pylist()).values()) <= 3
    for bucket in range(1 << ctw.BUCKET_BITS):
        own = [b.filter(pc.equal(b["bucket"], bucket)) for b in packets]
        if sum(map(len, own)):
            sums = ctw._bucket_sums(pa.Table.from_batches(own))
            got |= {k: complex(n, less) for k, n, less in zip(*(sums[c].to_pylist() for c in ("key", "n", "less")))}
    assert got == dict(want)


def test_every_context_of_the_training_text_is_in_the_model(spark, frame, monkeypatch):
    """Scores are those of the tree of all contexts, however few of them are known to all tasks."""
    rng = np.random.default_rng(11)
    words = ["the", "cat", "Sat", "on", "a", "mat", "wherever", "12", "caf\u00e9", "it", "was\n", "\u4e2d"]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 40))).tolist())) for i in range(120)] + [(None, "the cat"), (500, None), (501, "zq!")]
    rows += [(600 + i, "only here: one-off text that occurs just twice") for i in range(2)]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [(t or "").encode() for i, t in rows if not held(i)]
    _, base, far, at, _ = ctw.contexts_of(train)
    codes, every = base.astype(np.int64), []
    for d in range(4, ctw.DEPTH + 1):
        codes = codes * ctw.FAR + far[at - d]
        every.append(np.unique(codes))
    whole = ctw.Shape(np.repeat(np.arange(4, ctw.DEPTH + 1), [len(x) for x in every]), np.concatenate(every))
    assert len(whole.codes) == sum(map(len, every))
    cells, n = np.unique(ctw.cells_of(train, whole)[0], return_counts=True)
    want = sorted(zip([str(i) for i, _ in rows], ctw.fit(cells, n, whole).score([(t or "").encode() for _, t in rows])))
    docs = frame(rows)
    for known, bucket, sent in ((ctw.DEEP_ROWS, tails.BUCKET, tails.SENT), (60, 500, 700)):
        monkeypatch.setattr(ctw.counted, "__defaults__", (known,))
        monkeypatch.setattr(tails, "BUCKET", bucket)
        monkeypatch.setattr(tails, "SENT", sent)
        got = sorted((str(r["doc_id"]), r["score"]) for r in ctw.language_scores(docs.repartition(3)).collect())
        for (i, x), (j, y) in zip(want, got, strict=True):
            assert i == j and math.isclose(x, y, rel_tol=2e-3, abs_tol=0.02), (i, x, y, known)


def test_language_scores_edges(frame):
    assert ctw.language_scores(frame([])).count() == 0
    got = {r["doc_id"]: r for r in ctw.language_scores(frame([(1, None), (2, ""), (None, "a b"), (4, "a a"), (4, "a a")])).collect()}
    assert got[1]["n_tokens"] == 1 and got[4]["n_tokens"] == 3
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    only = ctw.language_scores(frame([(i, "x y") for i in held])).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in only)


# ------------------------------------------------------------------- leaks


def test_leaks_verbatim_paraphrased_and_clean(spark, docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    texts = {r["item_id"]: r["text"] for r in items.collect()}
    rng = random.Random(3)
    filler = [w for r in docs.limit(40).collect() for w in r["text"].split()]
    rows, want = [], set()
    for i, (item, text) in enumerate(sorted(texts.items())):
        pad = lambda: " ".join(rng.choice(filler) for _ in range(150))  # noqa: E731, B023
        words = text.split()
        changed = [w if rng.random() > 0.2 else rng.choice(filler) for w in words]
        rows += [(3 * i, f"{pad()} {text.upper()} {pad()}"), (3 * i + 1, f"{pad()}\n{' '.join(changed)} {pad()}"), (3 * i + 2, pad())]
        want |= {(3 * i, item), (3 * i + 1, item)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = latent_leaks.find_leaks(df, items).select("doc_id", F.explode("leaks.item_id").alias("item"))
    got = {(r["doc_id"], r["item"]) for r in found.collect()}
    verbatim = {w for w in want if w[0] % 3 == 0}
    assert verbatim <= got
    assert len(got & want) >= 0.9 * len(want)
    assert not {g for g in got if g[0] % 3 == 2}
    blocks = latent_leaks.find_leaks(df, items, block_items=15).select("doc_id", F.explode("leaks.item_id").alias("item"))
    assert verbatim <= {(r["doc_id"], r["item"]) for r in blocks.collect()}


def test_leaks_against_brute_force(docs):
    items = docs.sparkSession.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    benchmark = [(r["item_id"], latent_leaks.words_of(r["text"])) for r in items.collect()]
    want = set()
    for r in docs.collect():
        words = latent_leaks.words_of(r["text"])
        for item, own in benchmark:
            if len(own) >= 8 and any(
                latent_leaks.leaked(*latent_leaks.best_match(own, words, at)) for at in range(0, len(words), latent_leaks.STEP)
            ):
                want.add((r["doc_id"], item))
    found = latent_leaks.find_leaks(docs, items).select("doc_id", F.explode("leaks.item_id").alias("item"))
    got = {(r["doc_id"], r["item"]) for r in found.collect()}
    assert len(got & want) >= 0.9 * len(want) and {g for g in got if len(dict(benchmark)[g[1]]) >= 8} <= want


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def test_hard_paraphrases_against_an_independent_definition(spark):
    """Every stretch of every text is compared by a plain subsequence, without the product's search or checks."""
    rng = random.Random(12)
    words = [f"v{i}" for i in range(900)]
    items = [(i, [rng.choice(words) for _ in range(rng.randrange(15, 60))]) for i in range(25)]
    rows = []
    for i, own in items:
        for share in (0.0, 0.15, 0.25, 0.35, 0.5):  # words replaced, moved in by extra ones
            changed = [w if rng.random() > share else rng.choice(words) for w in own]
            if share:
                for _ in range(3):
                    changed.insert(rng.randrange(len(changed)), rng.choice(words))
            pad = lambda: [rng.choice(words) for _ in range(rng.randrange(0, 200))]
            rows.append((len(rows), " ".join(pad() + changed + pad())))
    want = set()
    for d, text in rows:
        ws = text.split()
        for i, own in items:
            n, answer = len(own), own[-8:]
            for at in range(0, max(1, len(ws) - n // 2), max(1, n // 6)):
                part = ws[at : at + n + n // 4 + 2]
                if len(set(part) & set(own)) >= 0.5 * len(set(own)):
                    share = plain_lcs(own, part) / n
                    if share >= 0.8 or (share >= 0.6 and plain_lcs(answer, part) / len(answer) >= 0.5):
                        want.add((d, i))
                        break
    df = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id long, text string")
    found = {}
    for block in (2048, 7):
        out = latent_leaks.find_leaks(df, benchmark, block_items=block).select("doc_id", F.explode("leaks.item_id").alias("item"))
        found[block] = {(r["doc_id"], r["item"]) for r in out.collect()}
    assert found[2048] == found[7]  # the fit does not depend on the blocks
    assert len(want) >= 60 and len(found[7] & want) >= 0.95 * len(want) and len(found[7] - want) <= 0.05 * len(want)


def test_long_items_are_found(spark):
    rng = random.Random(13)
    words = [f"v{i}" for i in range(3000)]
    own = [rng.choice(words) for _ in range(700)]
    rows = [(1, " ".join(own)), (2, " ".join(rng.choice(words) for _ in range(700))), (3, " ".join(rng.choice(words) for _ in range(300)) + " " + " ".join(own))]
    found = latent_leaks.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(5, " ".join(own))], "item_id long, text string"))
    assert {r["doc_id"] for r in found.where(F.size("leaks") > 0).collect()} == {1, 3}


def test_nothing_possible_is_ruled_out():
    rng = random.Random(14)
    for _ in range(20):
        n_words = 60
        items = [np.array([rng.randrange(n_words) for _ in range(rng.randrange(5, 90))]) for _ in range(8)]
        docs = [[rng.randrange(-40, n_words) for _ in range(rng.randrange(1, 900))] for _ in range(4)]
        ids = np.concatenate([np.array([max(x, -1) for x in d]) for d in docs])
        possible, first = latent_leaks.possible_items(ids, np.array([len(d) for d in docs]), items, n_words)
        for d, ws in enumerate(docs):
            for at in range(0, len(ws), latent_leaks.STEP):
                for k, item in enumerate(items):
                    if latent_leaks.best_match(list(item), ws, at)[0] > 0:
                        assert possible[first[d] + at // latent_leaks.STRETCH, k]


def test_leaks_edges(spark, frame):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (3, "")], "item_id int, text string")
    text = "zero one two three four five six seven eight nine ten eleven"
    got = {r["doc_id"]: r["leaks"] for r in latent_leaks.find_leaks(frame([(1, text), (2, None), (3, ""), (4, "other words only here")]), items, keep_text=True).collect()}
    assert [x["item_id"] for x in got[1]] == [1] and got[2] == got[3] == got[4] == []
    assert latent_leaks.find_leaks(frame([]), items).count() == 0
    assert latent_leaks.find_leaks(frame([(1, text)]), items.limit(0)).first()["leaks"] == []


def test_lcs():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice(b"abcd") for _ in range(rng.randrange(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert latent_leaks.lcs(a, b) == table[-1][-1]


# ---------------------------------------------------------------- toxicity


@pytest.fixture(scope="module")
def larger(spark):
    at = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")


def test_toxicity_of_planted_insults(spark, frame):
    rng = random.Random(7)
    plain = ["the", "river", "runs", "over", "stones", "and", "grass", "while", "birds", "sing"]
    rows, marks = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(30)]
        bad = i % 9 == 0
        if bad:
            words[5] = rng.choice(["idiot", "moron", "scum", "grumbleton", "grumblefax"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    docs, labels = frame(rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert auc([r["score"] for r in got], [r["toxic"] for r in got]) > 0.99
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)
    hit = [r["predicted"] == r["toxic"] for r in got]
    assert sum(hit) >= 0.95 * len(hit)


def test_toxicity_never_sees_held_out_labels(spark, frame):
    rows = [(i, f"{'idiot' if i % 5 == 0 else 'fine'} word{i % 11} text") for i in range(120)]
    labels = [(i, int(i % 5 == 0)) for i in range(120)]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    scores = []
    for given in (labels, flipped):
        docs = frame(rows)
        model = toxicity.train(docs, spark.createDataFrame(given, "doc_id long, toxic int"))
        scores.append([r["score"] for r in toxicity.score(docs, model).orderBy("doc_id").collect()])
    assert scores[0] == scores[1]


def test_toxicity_does_not_depend_on_partitions(larger):
    docs, labels = larger
    found = []
    for parts in (1, 7):
        model = toxicity.train(docs.repartition(parts), labels)
        found.append({r["doc_id"]: r["score"] for r in toxicity.score(docs.select("doc_id", "text"), model).collect()})
    assert found[0].keys() == found[1].keys() and all(math.isclose(found[0][d], found[1][d], abs_tol=1e-9) for d in found[0])


def test_toxicity_scores_against_plain_python(larger):
    """Words, beginnings and votes read from each text anew, without the product's classes."""
    docs, labels = larger
    model = toxicity.train(docs, labels)
    a, b = model.calibration
    lexicon = set(model.voters.lexicon)
    marks = {chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()}
    n_voters = 10 + 16 + 3

    def plain(text):
        words = "".join(" " if c in marks else c for c in (text or "").lower()).encode().split()
        ids, hits = set(), Counter()
        for w in words:
            shown = w.decode("utf-8", "replace")
            names = [b"w:" + w] + [b"p:" + shown[:n].encode() for n in (4, 5, 6) if len(shown) > n]
            ids |= {zlib.crc32(f) % 32768 for f in names}
            if w.decode("utf-8", "replace") in toxicity.INSULTS:
                hits[toxicity.INSULTS.index(w.decode())] += 1
            for f in names:
                if f in lexicon:
                    hits[10 + zlib.crc32(b"voter" + f) % 16] += 1
        total, votes = sum(hits.values()), {v: 1 for v in hits}
        votes[26] = 1 if total >= 2 else -1 if not total else 0
        votes[27] = int(bool(total) and total >= 0.02 * len(words))
        votes[28] = 1 if len(hits) >= 2 else -1 if not total and len(words) >= 20 else 0
        z = sum(model.weight[i] for i in ids) / math.sqrt(max(len(ids), 1)) + model.bias
        z += sum(model.weight[32768 + 2 * v + (x > 0)] for v, x in votes.items() if x)
        assert max(votes) < n_voters
        return 1 / (1 + math.exp(-min(30, max(-30, a * z + b))))

    for r in toxicity.score(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert math.isclose(r["score"], plain(r["text"]), abs_tol=1e-9) and r["predicted"] == (r["score"] >= 0.3)


def test_toxicity_edges(spark, frame):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(frame([(1, "a")]), none)
    got = toxicity.score(frame([(1, None), (2, ""), (None, "b"), (4, "x " * 5000)]), model).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(frame([]), model).count() == 0


def test_label_model_finds_the_better_voters():
    rng = np.random.default_rng(8)
    truth = rng.random(3000) < 0.15
    votes = np.zeros((3000, 6), dtype=np.int8)
    for j, right in enumerate((0.95, 0.9, 0.85, 0.85, 0.6, 0.55)):
        says = np.where(rng.random(3000) < right, truth, ~truth)
        votes[:, j] = np.where(rng.random(3000) < 0.8, np.where(says, 1, -1), 0)
    posterior, weights = toxicity.label_model(votes, 0.15)
    assert ((posterior > 0.5) == truth).mean() > 0.95
    doubled, w = toxicity.label_model(np.column_stack([votes, votes[:, 5], votes[:, 5]]), 0.15)
    assert w[5] < 0.6 < weights[5]  # copies of one voter count less each


# ----------------------------------------------------------------- quality


def test_quality_on_labels(larger):
    docs, labels = larger
    model = cotrain.train(docs, labels, labelled=250)
    got = cotrain.score(docs, model).join(labels, "doc_id").select("quality_score", "quality").collect()
    assert auc([r[0] for r in got], [r[1] for r in got]) > 0.95
    kept = [r[0] >= cotrain.THRESHOLD for r in got if r[1] == 1]
    assert sum(kept) >= 0.97 * len(kept)


def test_quality_edges(spark, frame):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = cotrain.train(frame([(1, "a")]), none)
    got = cotrain.score(frame([(1, None), (2, "")]), model).collect()
    assert all(r["quality_score"] == 0.5 for r in got)
    one = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    model = cotrain.train(frame([(1, "good text"), (2, "fine text"), (3, "x")]), one)
    assert cotrain.score(frame([(1, "good text")]), model, keep_text=True).first()["quality_score"] > 0.5
    assert cotrain.score(frame([]), model).count() == 0
    assert cotrain.score(spark.createDataFrame([(1, "no metadata")], "doc_id int, text string"), model).count() == 1


def test_views_exchange_pseudo_labels():
    rng = np.random.default_rng(9)

    def views(n):
        y = (rng.random(n) < 0.5).astype(float)
        return y, *(np.column_stack([2 * (y - 0.5) + rng.normal(0, 0.6, n), rng.normal(size=(n, 3))]).astype(np.float32) for _ in range(2))

    y, a, b = views(12)
    _, fa, fb = views(600)
    ty, ta, tb = views(800)
    error = {}
    for rounds in (0, 4):
        z = cotrain.co_train(a, b, y, fa, fb, rounds).logits(ta, tb)[0]
        error[rounds] = ((z > 0) != (ty > 0.5)).mean()
    assert error[4] <= error[0] + 0.01 and error[4] < 0.12


def test_training_equals_the_version_in_memory(larger):
    docs, labels = larger
    pages = docs.withColumn("key", cotrain.page_key(F.col("text").cast("binary"), F.col("lang"), F.col("source")))
    rows = pages.join(labels.select("doc_id", "quality"), "doc_id", "left").withColumn("at", F.xxhash64("doc_id", F.lit("order"))).orderBy("at").collect()
    views = lambda some: (np.stack([cotrain.text_view(r["text"].encode()) for r in some]), np.stack([cotrain.meta_view(r["text"].encode(), r["lang"], r["source"]) for r in some]))
    known, free = [r for r in rows if r["quality"] is not None], {}
    for r in rows:
        if r["quality"] is None:
            free.setdefault(r["key"], r)
    spark = docs.sparkSession
    ranks = spark.createDataFrame([(k,) for k in free], "key long").select("key", cotrain.rank(F.col("key")).alias("r")).collect()
    order = {r["key"]: r["r"] for r in ranks}
    right = cotrain.co_train(*views(known), np.array([float(r["quality"]) for r in known]), *views(list(free.values())), rounds=1, per_round=60, order=np.array([order[k] for k in free]))
    for parts in (1, 7):
        got = cotrain.train(docs.repartition(parts), labels, rounds=1, per_round=60)
        assert np.allclose(got.weights, right.weights, atol=1e-3)
        for x, y in zip(got.models, right.models):
            assert np.allclose(x.weight, y.weight, atol=1e-3) and abs(x.slope - y.slope) < 1e-3


def test_quality_replaces_clashing_columns_and_reads_long_texts(spark):
    df = spark.createDataFrame([(1, "plain words here " * 60000, "x", 7.0), (1, "plain words here " * 60000, "x", 7.0)], "doc_id long, text string, lang string, Quality_Score double")
    got = cotrain.score(df, cotrain.Views())
    assert got.columns == ["doc_id", "lang", "quality_score", "text_score", "meta_score"] and got.count() == 2
