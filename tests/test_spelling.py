import random

from warraq.operators import morphology, spelling


def test_costs():
    assert spelling.distance("احمد", "أحمد") == spelling.CONFUSION
    assert spelling.distance("مدرسة", "مدرسه") == spelling.CONFUSION
    assert spelling.distance("ضلام", "ظلام") == spelling.distance("فلم", "قلم") == spelling.distance("صرب", "ضرب") == spelling.NEARNESS
    assert spelling.distance("كتاب", "كتتاب") == spelling.distance("رر", "ر") == spelling.DOUBLED
    assert spelling.distance("آمن", "من") == 1.0 and spelling.distance("قرآن", "قرن") == spelling.HAMZA
    assert spelling.distance("كتاب", "كتبا") == spelling.SWAP
    assert spelling.distance("سماء", "سما") == spelling.HAMZA
    assert spelling.distance("", "اب") == 2.0


def test_distance_is_symmetric_and_zero_for_equal():
    rng = random.Random(0)
    for _ in range(100):
        a, b = ("".join(rng.choice("ابتة") for _ in range(rng.randrange(6))) for _ in range(2))
        assert spelling.distance(a, a) == 0 and abs(spelling.distance(a, b) - spelling.distance(b, a)) < 1e-9


def test_suggestions_equal_brute_force(spark):
    common = ["المدرسة", "الكتاب", "السيارة", "المعلم"]
    rows = [(i, " ".join(common)) for i in range(5)] + [(9, "المدرسه الكتب السيارات زرافة")]
    got = {(r.form, r.candidate): r.distance for r in spelling.suggestions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {(a, b): d for a in rows[-1][1].split() for b in common if (d := spelling.distance(a, b)) <= 1.05}
    assert got == want


def test_repeated_misspellings_are_checked_at_any_size(spark):
    rows = [(i, "المدرسة الكتاب") for i in range(50)] + [(60, "المدرصة الكتااب المعلم"), (61, "المعللم المعللم المعللم")]
    few = spark.createDataFrame(rows, "doc_id long, text string")
    many = spark.createDataFrame([(100 * k + i, t) for k in range(20) for i, t in rows], "doc_id long, text string")
    got = [sorted(map(tuple, spelling.suggestions(x, morphology.lexemes(spark)).select("form", "candidate", "distance", "score", "rank").collect())) for x in (few, many)]
    assert got[0] == got[1]
    # The commoner form is the wrong one; the lexicon decides.
    assert {("المدرصة", "المدرسة"), ("الكتااب", "الكتاب"), ("المعللم", "المعلم")} <= {r[:2] for r in got[0]}
    assert not {"المدرسة", "الكتاب", "المعلم"} & {r[0] for r in got[0]}
