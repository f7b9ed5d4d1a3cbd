from pathlib import Path

import pytest

from warraq.functions.resources import VARIANTS
from warraq.operators import analytics, document_rules, sentences
from warraq.operators.sentences import split_sentences
from warraq.plans import catalogue
from warraq.sources.corpus import read_cases

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "text, bodies",
    [
        ("", []), (" \n ", []), ("One. Two!", ["One", " Two"]), ("Pi is 3.14. Yes", ["Pi is 3.14", " Yes"]), ("بلغ ٣٫١٤ و٣.١٤. تم", ["بلغ ٣٫١٤ و٣.١٤", " تم"]),
        ("1. First\n2. Second", ["1. First", "2. Second"]), ("12. Item here. End", ["12. Item here", " End"]), ("أ. بند أول. تم", ["أ. بند أول", " تم"]),
        ("قابلت د. سامي. شكرا", ["قابلت د. سامي", " شكرا"]), ("See Prof. X, e.g. here.", ["See Prof. X, e", "g. here"]), ("What?!» he said…", ["What", " he said"]), ("a\n\nb", ["a", "b"]),
    ],
)
def test_sentence_bodies(text, bodies):
    assert [text[a:b] for a, b, _ in split_sentences(text)] == bodies


def test_terminators_take_runs_and_closers():
    assert [t for _, _, t in split_sentences('He said "no!!" Go; stop؛ ok')] == ['!!"', "؛", ""]


def test_sentence_table(spark):
    rows = sentences.sentences(spark.createDataFrame([(1, "😀 One. Two"), (2, None)], "doc_id long, text string")).orderBy("sent").collect()
    assert [(r.start, r.stop, r.body) for r in rows] == [(0, 5, "😀 One"), (6, 10, " Two")]


def test_long_sentence(spark):
    docs = spark.createDataFrame([(1, "word " * 51 + "."), (2, "word " * 50 + ".")], "doc_id long, text string")
    assert [(r.doc_id, r.start, r.stop, r.words) for r in sentences.long_sentences(docs).collect()] == [(1, 0, 40, 51)]


def test_correct_keeps_offsets(spark):
    docs = spark.createDataFrame([(1, "😀abcdef"), (2, "same")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 5, 6, ""), (1, 1, 3, "XYZ")], "doc_id long, start long, stop long, suggestion string")
    assert dict(map(tuple, document_rules.correct(docs, edits).collect())) == {1: "😀XYZcdf", 2: "same"}


def test_merged_moments_equal_direct(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b", "f", i * i) for i in range(50)], "doc_id long, author string, feature string, value long")
    parts = analytics.moments(rows, "author")
    assert [tuple(r) for r in analytics.merged(parts).collect()] == [tuple(r) for r in analytics.moments(rows).collect()]


def test_gold_cases(spark, tmp_path):
    one = '{"schema_version": 1, "id": "%s", "text": "x", "domain": "social", "split": "dev", "dialect": "msa", "annotations": []}\n'
    (tmp_path / "good.jsonl").write_text(one % "a" + "\n" + one % "b")
    (tmp_path / "twice.jsonl").write_text(one % "a" + one % "a")
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    assert read_cases(spark, str(tmp_path / "good.jsonl")).count() == 2
    for name in ("twice", "bad"):
        with pytest.raises(Exception, match="id occurs twice|MALFORMED|Malformed"):
            read_cases(spark, str(tmp_path / f"{name}.jsonl")).collect()


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_token_bucket_equals_replay(spark):
    got = {r.event_id: r.allowed for r in catalogue.QUERIES["token_bucket"](spark, SF).collect()}
    level, last = {}, {}
    for e in spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id", "event_id", "unix_millis(cast(ts as timestamp)) ms").orderBy("ms", "event_id").collect():
        now = min(5.0, level.get(e.user_id, 5.0) + (e.ms - last.get(e.user_id, e.ms)) / 1000 * 0.001)
        assert got[e.event_id] == (now >= 1)
        level[e.user_id], last[e.user_id] = now - (now >= 1), e.ms


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_tracker_equals_whole_document(spark):
    import re

    from warraq.functions.text import LETTERS, MARKS, WORD
    from warraq.sources.corpus import arabic

    groups = {form: g for g, form in VARIANTS}
    chunks = {}
    for r in arabic(spark, SF).orderBy("doc_id").collect():
        chunks.setdefault(r.doc_id // 10, []).append(r.text)
    want = []
    for conv, texts in chunks.items():
        first, before = {}, 0
        for text in texts:
            for m in re.finditer(f"[{LETTERS}](?:[{WORD}]*[{LETTERS}{MARKS}])?", text):
                if (g := groups.get(m[0])) and first.setdefault(g, m[0]) != m[0]:
                    want.append((conv, g, before + m.start(), m[0]))
            before += len(text)
    got = [(r.conv_id, r.grp, r.start, r.piece) for r in catalogue.QUERIES["consistency_tracker"](spark, SF).collect()]
    assert len(got) > 5 and sorted(got) == sorted(want)
