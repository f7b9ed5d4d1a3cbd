import re

from pyspark.sql import functions as F

from warraq.operators import morphology, pattern_rules, senses, style
from warraq.operators.pattern_rules import PatternRule, sequence


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_found_equals_finditer(spark):
    texts = ["", None, "aXbXXc", "XX", "no", "😀X😀 XX\nX", "abX" * 50]
    got = {(r.doc_id, r.start, r.stop, r.surface) for r in pattern_rules.found(docs(spark, *texts), {"R": "X+"}).collect()}
    assert got == {(i, m.start(), m.end(), m[0]) for i, t in enumerate(texts) for m in re.finditer("X+", t or "")}


def test_context_exception_and_blocks(spark):
    rules = [PatternRule("A", r"(\d+) kg", "$1 kilo"), PatternRule("B", "cat", "dog", before="the +"), PatternRule("C", "cat", "dog", after=" sat"), PatternRule("D", "fast", "quick", exception="not", scope="sentence"), PatternRule("E", sequence("in", "the", "big", "house", optional=("big",)))]
    d = docs(spark, "12 kg and 7 kg net", "the cat sat, a cat ran", "not so fast. very fast", "in  the house, in the big house")
    got = {(r.doc_id, r.rule_id, r.start, r.suggestion) for r in pattern_rules.matches(d, rules, [("W", "7 kg net", "A")]).collect()}
    assert got == {(0, "A", 0, "12 kilo"), (1, "B", 4, "dog"), (1, "C", 4, "dog"), (2, "D", 18, "quick"), (3, "E", 0, ""), (3, "E", 15, "")}


def words(spark, *texts):
    return style.sentence_words(docs(spark, *texts), morphology.lexemes(spark))


def test_contradictions(spark):
    w = words(spark, "يكتب الطالب ولا يكتب", "يكتب الطالب ثم لا يكتب", "يكتب الطالب. لا يكتب", "لا يكتب الطالب", "يكتب " + "في " * 9 + "لا يكتب", "", None)
    assert [(r.doc_id, r.start, r.stop) for r in style.contradictions(w).collect()] == [(0, 12, 20)]


def test_dense_sentence_needs_all_of_it(spark):
    dense = " ".join(["تحقيق وتنفيذ"] * 12)
    w = words(spark, dense, "تحقيق وتنفيذ", dense.replace("وتنفيذ", "يكتب"))
    assert [(r.doc_id, r.start, r.stop, r.words) for r in style.dense_sentences(w).collect()] == [(0, 0, 48, 24)]


def test_chips_rank(spark):
    tone = spark.createDataFrame([(1, "persuasive", 0.0)], "doc_id long, tone string, dialect_signal double")
    assert [r.target for r in style.chips(tone).orderBy("rank").collect()] == ["formal", "academic", "casual", "persuasive"]


def test_context_changes_the_reading(spark):
    s = senses.scored(words(spark, "درس الطالب", "في درس", "هذا درس جديد"), morphology.lexemes(spark))
    got = {r.doc_id: r.pos for r in senses.chosen(s).where("form = 'درس'").collect()}
    assert got == {0: "verb", 1: "noun", 2: "noun"}
    assert s.groupBy("doc_id", "idx").agg(F.abs(F.sum("prob") - 1).alias("x")).where("x > 0.001").count() == 0


def test_tone_shift_needs_a_steady_document(spark):
    formal, friendly = "نرجو وفقا رسميا التكرم", "شكرا صديقي شكرا صديقي شكرا"
    w = words(spark, f"{formal}. {formal}. {formal}. {friendly}.", f"{formal}. {friendly}.", f"{friendly}. {friendly}. {formal}.", "", None)
    assert [(r.doc_id, r.start) for r in style.tone_shifts(w).collect()] == [(0, 72)]
