import random

from pyspark.sql import functions as F

from warraq.functions.text import tokens
from warraq.operators import records, rules, spans


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_tokens_are_lossless_with_code_point_offsets(spark):
    text = "😀 كتَب `y = 1` a@b.cd #وسم @من 3.14% www.x.yz, نَعم…\n"
    got = tokens(docs(spark, text)).orderBy("idx").collect()
    assert "".join(r.piece for r in got) == text
    assert all(text[r.start : r.stop] == r.piece for r in got)
    kinds = {r.piece: r.kind for r in got}
    assert (kinds["`y = 1`"], kinds["a@b.cd"], kinds["#وسم"], kinds["3.14%"], kinds["كتَب"]) == ("code", "email", "hashtag", "number", "arabic")


def test_null_and_empty_texts_have_no_tokens(spark):
    assert tokens(docs(spark, None, "")).count() == 0


def test_overlap_filter_equals_brute_force(spark):
    rng = random.Random(3)
    make = lambda n: [(rng.randrange(5), s := rng.randrange(900), s + rng.randrange(1, 300)) for _ in range(n)]
    a, b = make(60), make(20)
    frame = lambda x: spark.createDataFrame(x, "doc_id long, start long, stop long")
    got = sorted(tuple(r) for r in spans.drop_overlapping(frame(a), frame(b)).collect())
    assert got == sorted(x for x in a if not any(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for y in b))


def test_touching_spans_do_not_overlap(spark):
    frame = lambda x: spark.createDataFrame(x, "doc_id long, start long, stop long")
    assert spans.drop_overlapping(frame([(1, 0, 5)]), frame([(1, 5, 9)])).count() == 1


def test_rules_fire_on_runs_not_tokens(spark):
    hits = rules.literal_hits(docs(spark, "#الى الىـ والى (انشاء الله) انشاء  الله"), rules.rule_table(spark))
    assert sorted((r.start, r.rule_id, r.suggestion) for r in hits.collect()) == [(1, "HAMZA_TO", "إلى"), (10, "HAMZA_TO", "وإلى"), (16, "GOD_WILLING", "إن شاء الله")]


def test_every_rule_fires_on_its_pattern_and_not_on_its_suggestion(spark):
    table = rules.rule_table(spark)
    rows = rules.surfaces()
    bad = {(r.doc_id, r.rule_id) for r in rules.literal_hits(docs(spark, *(r[0] for r in rows)), table).collect()}
    assert all((i, r[2]) in bad for i, r in enumerate(rows))
    good = {(r.doc_id, r.rule_id) for r in rules.literal_hits(docs(spark, *(r[3] for r in rows)), table).collect()}
    assert not any((i, r[2]) in good for i, r in enumerate(rows))


def test_resolution_prefers_priority_then_length(spark):
    rows = [(1, 0, 5, "A", "x", 10, 0.9, "error"), (1, 3, 9, "B", "x", 20, 0.1, "hint"), (1, 9, 12, "C", None, 0, 0.5, "hint"), (1, 8, 12, "D", "y", 0, 0.5, "hint")]
    frame = spark.createDataFrame(rows, "doc_id long, start long, stop long, rule_id string, suggestion string, priority int, confidence double, severity string")
    assert sorted(r.rule_id for r in spans.resolve(frame).collect()) == ["B", "C"]


def test_empty_evaluation_is_perfect(spark):
    none = spark.createDataFrame([], "doc_id long, start long, stop long, category string")
    row = records.evaluate(none, none).first()
    assert (row.precision, row.recall) == (1.0, 1.0)


def test_retry_waits(spark):
    got = spark.range(0, 12, 1, 1).select(records.retry_after(F.col("id")).alias("w")).collect()
    assert [r.w for r in got] == [min(300_000, 1000 * 2**k) for k in range(12)]
