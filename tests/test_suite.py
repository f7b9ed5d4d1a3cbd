import pytest

from warraq.operators import analytics, rules, seed_suite, spelling, wordpiece
from warraq.plans import catalogue


def test_kth_target_is_kth_occurrence(spark):
    case = [(1, "a.b a.b axb a.b", [("R", "a.b"), ("Q", "axb"), ("R", "a.b")]), (2, "", [])]
    cases = spark.createDataFrame(case, "doc_id long, text string, expected array<struct<rule_id: string, target: string>>")
    assert {(r.rule_id, r.start, r.stop) for r in seed_suite.labels(cases).collect()} == {("R", 0, 3), ("R", 4, 7), ("Q", 8, 11)}
    with pytest.raises(Exception, match="target not found"):
        seed_suite.labels(spark.createDataFrame([(1, "a", [("R", "a"), ("R", "a")])], cases.schema)).collect()


def test_scores(spark):
    kind = "doc_id long, rule_id string, start long, stop long"
    one = lambda *r: spark.createDataFrame(list(r), kind)
    words = spark.createDataFrame([(500,)], "words long")
    r = seed_suite.evaluate(one((1, "A", 0, 1), (1, "B", 2, 3)), one((1, "A", 0, 1), (1, "A", 0, 1), (1, "C", 2, 3)), words).first()
    assert (r.tp, r.fp, r.fn, r.p, r.r, r.fp_per_1000) == (1, 1, 1, 0.5, 0.5, 2.0)
    none = seed_suite.evaluate(one(), one(), words).first()
    assert (none.tp, none.p, none.r, none.f05) == (0, 1.0, 1.0, 1.0)


def test_verified_only_if_silent_on_good(spark):
    c = spark.createDataFrame([("لاكن", "لكن", "قال لاكن"), ("لا", "لا لا", "قال لا"), ("كن", "x", "لاكن")], "bad string, good string, example string")
    assert [r.verified for r in seed_suite.verified(c).collect()] == [True, False, False]


def test_rule_packs(spark, tmp_path):
    line = '{"id": "%s", "category": "punctuation", "pattern": "%s"}\n'
    (tmp_path / "ok.jsonl").write_text(line % ("A", "x") + line % ("B", "y"))
    (tmp_path / "twice.jsonl").write_text(line % ("A", "x") * 2)
    (tmp_path / "bad.jsonl").write_text(line % ("a b", "x"))
    assert {(r.id, r.confidence, r.priority, r.autofix) for r in rules.read_rules(spark, str(tmp_path / "ok.jsonl")).collect()} == {("A", 0.98, 70, False), ("B", 0.98, 70, False)}
    for name, error in (("twice", "id occurs twice"), ("bad", "not sound")):
        with pytest.raises(Exception, match=error):
            rules.read_rules(spark, str(tmp_path / f"{name}.jsonl")).collect()


def test_shares_equal_popping():
    for left in range(20):
        for right in range(20):
            for room in range(3, 25):
                a, b = left, right
                while a + b > room:
                    a, b = (a, b - 1) if b > a else (a - 1, b)
                assert wordpiece.shares(left, right, room) == (a, b)


def test_word_pieces(spark):
    vocabulary = [*wordpiece.SPECIAL, "كتاب", "ك", "##ت", "a", "."]
    rows = spark.createDataFrame([(1, "كتاب. كت", "a b"), (2, None, ""), (3, "كق", None)], "doc_id long, x string, y string")
    got = {r.doc_id: (r.ids, r.mask, r.types) for r in wordpiece.encode(rows, vocabulary, "x", "y", 12).collect()}
    assert got[1] == ([2, 4, 8, 5, 6, 3, 7, 1, 3, 0, 0, 0], [1] * 9 + [0] * 3, [0] * 6 + [1] * 3 + [0] * 3)
    assert got[2][0] == [2, 3] + [0] * 10 and got[3][0][:3] == [2, 1, 3]


def test_decisions(spark):
    s = spark.createDataFrame([("مدرسه", "مدرسة", 0.18, 50, -0.1, 1), ("كتب", "كتاب", 1.0, 9, 2.5, 1), ("قلم", "علم", 1.0, 9, 2.53, 1), ("قلم", "قلب", 1.0, 8, 2.55, 2), ("گلم", "قلم", 1.0, 9, 2.5, 1)], "form string, candidate string, distance double, frequency long, score double, rank int")
    sure = spark.createDataFrame([("كتب", 0.98), ("مدرسة", 0.98)], "form string, confidence double")
    assert {r.form: r.reason for r in spelling.decisions(s, sure).collect()} == {"مدرسه": "corrected", "كتب": "known_form", "قلم": "ambiguous", "گلم": "dialect_letter"}


def test_tone_balance(spark):
    s = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, "a", 3.0)], "doc_id long, tone string, score double")
    assert {r.doc_id: r.balance for r in analytics.tone_balance(s).collect()} == {1: 100.0, 2: 0.0}


def test_sums_of_squares_beyond_64_bits(spark, tmp_path):
    texts = ["a" * 4000, "ab cd", "a" * 5000, None, "", "1"]
    spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.feature: (r.n, r.s, r.q) for r in catalogue.profile_merge(spark, str(tmp_path)).collect()}
    sizes = [4000 * 10**6, 2 * 10**6, 5000 * 10**6]
    assert got == {"word_length": (3, sum(sizes), sum(x * x for x in sizes))} | dict.fromkeys(("number_share", "mark_share", "comma_share"), (3, 0, 0))
    assert sum(x * x for x in sizes) >= 1 << 63
    small = analytics.fitted(spark.createDataFrame([("a", 1, 2, 3)], "feature string, n long, s long, q long").selectExpr("feature", "n", "cast(s as decimal(38,0)) as s", "cast(q as decimal(38,0)) as q"))
    assert [t for _, t in small.dtypes] == ["string", "bigint", "bigint", "bigint"] and small.collect() == [("a", 1, 2, 3)]
