import re

from warraq.operators import morphology, syntax


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_template_regex_takes_the_root():
    assert re.match(morphology.template_regex("مفعول").replace(r"\z", r"\Z"), "مكتوب").groups() == ("ك", "ت", "ب")
    assert not re.match(morphology.template_regex("فاعل").replace(r"\z", r"\Z"), "كتاب")


def test_forms_of_a_feminine_noun(spark):
    made = {r.form: r.number for r in morphology.forms(morphology.lexemes(spark)).where("lemma = 'طالبة'").collect()}
    assert made["الطالبتان"] == "dual" and made["الطالبات"] == "plural" and made["بالطالبة"] == "singular"


def test_unknown_words_have_no_analysis(spark):
    words = spark.createDataFrame([("ظ",), ("",), ("مكتوب",)], "form string")
    got = morphology.analyses(words, morphology.lexemes(spark)).where("rank = 1").collect()
    assert [(r.form, r.root, r.pattern, r.confidence) for r in got] == [("مكتوب", "كتب", "مفعول", 0.81)]


def test_checks_and_barriers(spark):
    d = docs(spark, "هذا المدرسة", "هذا، المدرسة", "هذا 15 المدرسة", "لم يكتبون", "لم يكتبوا", "", None)
    rels = syntax.relations(syntax.pairs(syntax.parsed(d, morphology.lexemes(spark))))
    got = {(r.doc_id, r.rule_id, r.start, r.stop, r.suggestion) for r in syntax.checks(rels).collect()}
    assert got == {(0, "SYNTAX_DEMONSTRATIVE_AGREEMENT", 0, 11, "هذه المدرسة"), (2, "SYNTAX_DEMONSTRATIVE_AGREEMENT", 0, 14, "هذه المدرسة"), (3, "SYNTAX_FIVE_VERBS", 3, 9, "يكتبوا")}
