import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm.store import table

from .test_lines_secrets_pii_prints import slow_dedup
from .test_similar import by_jaccard


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, sf).write.parquet(path)
        result = spark.read.parquet(path)
        out.append((name, docs, result))
        docs = result
    return {name: (before, after) for name, before, after in out}


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    assert list(stages) == ["quality", "line_dedup", "simhash", "decontaminate", "bpe"]
    for name, (_, after) in stages.items():
        if name != "bpe":
            assert tuple(after.columns) == corpus_pipeline.COLUMNS


def test_lines_against_brute_force(stages):
    before, after = stages["line_dedup"]
    assert rows(after) == {d: t for d, _, _, t in slow_dedup(list(rows(before).items()))}


def test_one_of_each_group_stays(stages):
    before, after = stages["simhash"]
    assert rows(after).keys() == {d for d, c in by_jaccard(list(rows(before).items())) if d == c}


def test_leaks_and_low_quality_go(stages, labels):
    before, after = stages["decontaminate"]
    assert rows(after).keys() < rows(before).keys()
    kept = rows(stages["quality"][1]).keys()
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    assert len(good & kept) >= 0.95 * len(good) and len(bad & kept) <= 0.2 * len(bad)


def test_tokens(stages):
    before, after = stages["bpe"]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = rows(before)
    for r in after.collect():
        assert r["n_tokens"] == len(own.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_run_gives_the_same(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"]: r["ids_sha256"] for r in got.collect()} == {r["doc_id"]: r["ids_sha256"] for r in stages["bpe"][1].collect()}


ODD = [
    (None, "no id but a text of several words here", None, None, None),
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \n\t", None, "b", 3),
    (7, "the same words again and again, the same words", "en", "a", 46),
    (7, "the same words again and again, the same words", "en", "a", 46),
    (9, "long " * 60000, "en", "c", 300000),
    (10, "the same words again and again, the same words", "de", "c", 46),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with odd documents, their labels and an empty benchmark."""
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(7, 1), (9, 1), (10, 1), (None, 0), (2, None)], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_clashing_columns(spark, odd, name, stage):
    docs = table(spark, odd, "documents")
    extra = docs.selectExpr("*", "'x' as quality_score", "1 as kept_text", "2 as n_tokens", "3 as component_id", "array(4) as leaks", "5 as key")
    got = stage(spark, extra, odd).collect()
    ids = sorted((r["doc_id"] for r in got), key=str)
    if name == "simhash":  # blank ones are copies, 10 is a copy of 7, both rows of 7 are one document
        assert ids == [1, 7, 7, 9, None]
    else:
        assert ids == sorted((r[0] for r in ODD), key=str)
    if name == "bpe":
        assert {r["doc_id"]: r["n_tokens"] for r in got}[1] == 0
    else:
        assert tuple(got[0].asDict()) == corpus_pipeline.COLUMNS
        assert {r["doc_id"]: len(r["text"] or "") for r in got}[9] == 300000


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_empty_tables(spark, odd, name, stage):
    assert stage(spark, table(spark, odd, "documents").limit(0), odd).count() == 0
