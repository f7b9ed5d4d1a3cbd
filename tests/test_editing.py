import io
import random
import zipfile
import zlib

import pytest

from warraq.functions.resources import RULES, SENTENCES
from warraq.operators import checks, conversion, editing, rewriting, rules, spans
from warraq.sources import imports


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_replay_equals_python(spark):
    rng = random.Random(1)
    rows, edits, want = [], [], {}
    for d in range(40):
        text = "".join(rng.choice("ab😀\n ") for _ in range(rng.randrange(30)))
        rows.append((d, text if d else None))
        text = text if d else ""
        for v in range(rng.randrange(5)):
            a = rng.randrange(len(text) + 1)
            b = rng.randrange(a, len(text) + 1)
            put = rng.choice(["", "X", "😀😀", None])
            whole = rng.random() < 0.2
            edits.append((d, v, None if whole else a, None if whole else b, put))
            text = (put or "") if whole else text[:a] + (put or "") + text[b:]
        want[d] = text
    rng.shuffle(edits)
    e = spark.createDataFrame(edits, "doc_id long, version int, start long, stop long, text string")
    assert {r.doc_id: r.text for r in editing.replay(docs(spark, rows), e).collect()} == want


def test_recheck_equals_a_full_pass(spark):
    rng = random.Random(2)
    old, new = [], []
    for d in range(150):
        parts = [rng.choice(SENTENCES) for _ in range(rng.randrange(1, 9))]
        text = rng.choice([" ", "\n", " "]).join(parts)
        a = rng.randrange(len(text))
        b = min(len(text), a + rng.randrange(12))
        put = rng.choice(["", " ", ". ", "\n", " الى ", rng.choice(RULES)[1], "كلمة كلمة", "3.", "!?", "```"])
        old.append((d, text))
        new.append((d, text[:a] + put + text[b:]))
    old += [(900, None), (901, "هذة المدرسه")]
    new += [(900, "هذة"), (901, "هذة المدرسه"), (902, "الى"), (903, None)]
    o, n = docs(spark, old), docs(spark, new)

    def check(d):
        found = rules.literal_hits(d, rules.rule_table(spark)).select("doc_id", "rule_id", "start", "stop")
        return found.unionByName(checks.all_checks(d).select("doc_id", "rule_id", "start", "stop"))

    rows = lambda f: sorted((r.doc_id, r.rule_id, r.start, r.stop) for r in f.select("doc_id", "rule_id", "start", "stop").collect())
    got, want = rows(editing.recheck(o, n, check(o), check)), rows(check(n))
    assert got == want and len(want) > 300


def test_word_before_a_last_blank_is_one_hit(spark):
    hits = rules.literal_hits(docs(spark, [(1, "الى "), (2, "الى"), (3, "انشاء الله ")]), rules.rule_table(spark)).collect()
    assert sorted((h.doc_id, h.start, h.stop) for h in hits) == [(1, 0, 3), (2, 0, 3), (3, 0, 10)]


def test_windows_are_small():
    old = " ".join(["A sentence here."] * 100)
    a, was, now = editing.edited_window(old, old[:800] + "XY" + old[801:])
    assert now - was == 1 and was - a < 80


def test_budget_and_variants():
    three = rewriting.variants("شكرا " * 10, "formal")
    assert [v["changes"] for v in three] == [3, 6, 9] and all(0.62 <= v["confidence"] <= 0.97 and v["meaning"] >= 0.72 for v in three)
    assert rewriting.variants(" \n", "concise") == [] == rewriting.variants(None, "formal")
    assert [v["text"] for v in rewriting.variants("كان كان الجو حسنا", "concise")] == ["كان الجو حسنا"]
    with pytest.raises(ValueError):
        rewriting.variants("x", "formal", 4)


def test_desire_wins_over_its_word(spark):
    d = docs(spark, [(1, "شو بدك تعمل"), (2, "بدك، تعمل"), (3, ""), (4, None)])
    got = {(r.doc_id, r.start, r.stop, r.suggestion) for r in spans.resolve(conversion.to_standard(d)).collect()}
    assert got == {(1, 0, 2, "ماذا"), (1, 3, 11, "تريد أن تعمل"), (2, 0, 3, "تريد")}


def test_import_of_files(spark, tmp_path):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{imports.W[1:-1]}"><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>سلام</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(box.getvalue())
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4\nstream\n" + zlib.compress(rb"BT (Hi \(you\)) Tj [(a) -20 (b)] TJ ET") + b"\nendstream\n")
    (tmp_path / "c.txt").write_bytes(b"\xef\xbb\xbftext")
    (tmp_path / "d.md").write_text("# T\n- **b** and [l](u)")
    (tmp_path / "e.docx").write_bytes(b"no archive")
    (tmp_path / "f.txt").write_bytes(b"")
    got = {r.title: (r.text, r.error) for r in imports.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a": ("One\ttwo\nسلام", None), "b": ("Hi (you)ab", None), "c": ("text", None), "d": ("T\nb and l", None), "e": (None, "BadZipFile")}
