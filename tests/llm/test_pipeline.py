from pathlib import Path

import pytest

import corpus_pipeline
from warraq.llm import minhash_dedup, mixing, pipeline, toxicity
from warraq.llm.common import stored, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_stages_one_after_the_other(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert out.columns == columns
        texts[name] = {r.doc_id: r.text for r in out.collect()}
        docs = out
    first = table(spark, SF, "documents")
    lexicon = toxicity.learn(first, table(spark, SF, "labels"))
    clean = {r.doc_id for r in toxicity.assess(first, lexicon).where("predicted = 0").collect()}
    assert set(texts["toxicity"]) == clean
    assert set(texts["line dedup"]) <= clean
    assert set(texts["source mixing"]) == set(texts["minhash near-dedup"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(texts["source mixing"])
    # Other partitions cut pieces elsewhere; whose ids they are stays.
    total = lambda df: sorted(map(tuple, df.groupBy("doc_id").agg({"length": "sum"}).collect()))
    assert total(corpus_pipeline.run(spark, SF)) == total(pieces)


def test_one_of_each_class_stays(spark):
    docs = table(spark, SF, "documents")
    kept = {r.doc_id for r in pipeline.keep_one_of_each_class(spark, docs, SF).collect()}
    assert kept == {r.class_id for r in minhash_dedup.near_duplicates(docs).collect()}


def test_sequences_follow_the_mix(spark):
    # Texts of a window or more, so that a first piece is a sequence at once; those at the end of the mix are longest.
    rows = [(i, "word " * (2100 if i < 130 else 2100 + 20 * i), "en", "a" if i < 64 else "hot", 1) for i in range(260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = [r.doc_id for r in mixing.mix(docs).orderBy("position").collect()]
    mixed = stored(pipeline.mix_sources(spark, docs, SF), "mixed")
    assert len(mixed.inputFiles()) > 1
    first = pipeline.pack_sequences(spark, mixed, SF).where("start = 0").orderBy("sequence_id")
    assert [r.doc_id for r in first.collect()] == want


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, removed string, `row` int, position int, key int"
BLOCK = "\n".join(f"line number {i} is a passage that repeats" for i in range(10))
ROWS = [
    (1, f"{BLOCK}\nfirst"), (2, f"second\n{BLOCK}"), (2, f"second\n{BLOCK}"), (3, BLOCK), (4, None), (4, None), (5, ""), (None, "no id here"), (None, None),
    (6, "you fucking idiot, you stupid moron " * 5), (7, "word " * 100_000), (8, "plain text that nobody else has"), (8, "another text under that id"), (9, "plain text that nobody else has"),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, None, None if (i or 0) % 2 else "s", 0, 9.0, "x", 1, 2, 3) for i, t in ROWS], SCHEMA)


def test_stages_on_odd_rows(spark, odd):
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    of = dict(corpus_pipeline.STAGES)
    assert rows(of["toxicity"](spark, odd, SF)) == sorted((r for r in ROWS if r[0] != 6), key=str)
    left = [(i, "second" if i == 2 else t) for i, t in ROWS if i != 3]
    assert rows(of["line dedup"](spark, odd, SF)) == sorted(left, key=str)
    one = of["minhash near-dedup"](spark, odd, SF)
    assert one.columns == list(pipeline.COLUMNS)
    assert rows(one) == sorted([(1, ROWS[0][1]), (4, None), (None, "no id here"), (None, None), (6, ROWS[9][1]), (7, ROWS[10][1]), (8, "another text under that id")], key=str)
    assert rows(of["source mixing"](spark, odd, SF)) == sorted(ROWS, key=str)
    assert sorted(((r.doc_id, r.length) for r in of["packing"](spark, odd, SF).where("doc_tokens = 1").collect()), key=str) == sorted([(4, 1), (4, 1), (5, 1), (None, 1)], key=str)


def test_stages_on_an_empty_table(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0
