import random
import time
from pathlib import Path

import pytest

from warraq.engine import Engine, own_words
from warraq.functions.scan import tokens_of
from warraq.operators import backends, evaluation, phrases, privacy, rules, spans, templates, voice
from warraq.operators.sentences import split_sentences
from warraq.sources import generator, packs, sinks


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize(
    "text, want",
    [
        ("", []), (" \t\n", [("whitespace", " \t\n")]), ("3.14 ٣٫١٤ ١٢٬٣٤٥ 15% ٢٠٪", [("number", x) for x in ("3.14", "٣٫١٤", "١٢٬٣٤٥", "15%", "٢٠٪")]),
        ("زوروا https://www.example.org/help.", [("arabic", "زوروا"), ("url", "https://www.example.org/help"), ("punctuation", ".")]),
        ("www.x.yz،؟! ok", [("url", "www.x.yz"), ("punctuation", "،"), ("punctuation", "؟"), ("punctuation", "!"), ("latin", "ok")]),
        ("a.b+tag@mail.example.com", [("email", "a.b+tag@mail.example.com")]), ("#وسم_1 @من", [("hashtag", "#وسم_1"), ("mention", "@من")]),
        ("`x = 1` ```a\nb``` `open", [("code", "`x = 1`"), ("code", "```a\nb```"), ("symbol", "`"), ("latin", "open")]),
        ("كَتَبَ جمـــيل مـ", [("arabic", "كَتَبَ"), ("arabic", "جمـــيل"), ("arabic", "م"), ("symbol", "ـ")]), ("café rock'n'roll well-known", [("latin", "café"), ("latin", "rock'n'roll"), ("latin", "well-known")]),
        ("نعم...؟! (حسنا)", [("arabic", "نعم"), ("punctuation", "...؟!"), ("symbol", "("), ("arabic", "حسنا"), ("symbol", ")")]), ("😀 x", [("symbol", "😀"), ("whitespace", " "), ("latin", "x")]),
        ("+964 770-123", [("number", "+964"), ("number", "770"), ("number", "-123")]), ("‏اب‎", [("symbol", "‏"), ("arabic", "اب"), ("symbol", "‎")]), ("ﻻ", [("symbol", "ﻻ")]),
    ],
)
def test_golden_tokens(text, want):
    got = list(tokens_of(text))
    assert "".join(p for p, *_ in got) == text and all(text[a:b] == p for p, a, b, _ in got)
    assert [(k, p) for p, _, _, k in got if k != "whitespace" or not p.isascii() or not want or want[0][0] == "whitespace"] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("A (e.g. this) b.", [("A (e", "."), ("g. this) b", ".")]), ("قال ق.م. ثم", [("قال ق", "."), ("م. ثم", "")]), ("انتهى (د. سامي).", [("انتهى (د. سامي)", ".")]), ("x..” y", [("x.", ".”"), (" y", "")]), ("xy..” z", [("xy", "..”"), (" z", "")]),
        ("123. a\n1234. b", [("123. a", "\n"), ("1234", "."), (" b", "")]), ("ب. واحد\n  ج. اثنان", [("ب. واحد", "\n"), ("  ج. اثنان", "")]), ("!1. x", [("1. x", "")]), ("Dr..x", [("Dr.", "."), ("x", "")]), ("a؛b…c", [("a", "؛"), ("b", "…"), ("c", "")]),
    ],
)
def test_golden_sentences(text, want):
    assert [(text[a:b], end) for a, b, end in split_sentences(text)] == want


def test_many_matches_resolve_in_time():
    rng = random.Random(1)
    some = [(a := rng.randrange(60_000), a + rng.randrange(1, 12)) for _ in range(20_000)]
    start = time.process_time()
    got = list(spans.kept(some))
    assert time.process_time() - start < 2
    few, held = some[:1500], []
    for n, (a, b) in enumerate(few):
        if not any(a < y and x < b for x, y in held):
            held.append((a, b))
            assert n in got
    assert len([n for n in got if n < 1500]) == len(held)


def test_literals_of_any_length(spark):
    more = spark.createDataFrame([("على الرغم من أن", 4, "LONG", "مع أن", "style", "hint", 0.7, 1, False, "all"), ("على", 1, "ON", None, "style", "hint", 0.7, 1, False, "all")], rules.SCHEMA)
    got = rules.literal_hits(docs(spark, "وقف على الرغم من أن على  الرغم من أن", None, ""), more).collect()
    assert sorted((r.start, r.stop, r.rule_id) for r in got) == [(4, 7, "ON"), (4, 19, "LONG"), (20, 23, "ON")]


def test_engine_layers_and_filters(spark):
    d = docs(spark, "ذهبت الى الى السوق , وقال هذة المدرسه.", "اكتب الى a@b.cd الى www.x.yz/الى.", None)
    names = lambda e: {(r.doc_id, r.rule_id) for r in e.check(d).collect()}
    scan = ("rules", "checks", "sentences", "consistency")
    assert {(0, "HAMZA_TO"), (0, "THIS_FEM"), (0, "SCHOOL_TAA"), (0, "PUNCT_SPACE_BEFORE"), (1, "HAMZA_TO")} <= names(Engine(spark, layers=scan))
    assert names(Engine(spark, layers=scan, categories=("punctuation",))) == {(0, "PUNCT_SPACE_BEFORE")}
    assert not {r for _, r in names(Engine(spark, layers=scan, disabled_rules=("HAMZA_TO",)))} & {"HAMZA_TO"}
    assert not {r for _, r in names(Engine(spark, layers=scan, words=("هذة",)))} & {"THIS_FEM"}
    inside = lambda guard: [r.start for r in Engine(spark, layers=("rules",), guard_private=guard).check(d).where("doc_id = 1").collect()]
    assert sorted(inside(False)) == [5, 16, 29] and sorted(inside(True)) == [5, 16]
    everything = Engine(spark)
    some = everything.with_options(layers=("rules", "syntax", "dialect"))
    both = everything.found(d)
    assert set(both.columns) == {"doc_id", "layer", "rule_id", "category", "severity", "start", "stop", "suggestion", "confidence", "priority", "autofix"}
    assert {(0, "HAMZA_TO")} <= {(r.doc_id, r.rule_id) for r in some.check(d).collect()}
    assert dict(map(tuple, Engine(spark, layers=scan).correct(d).collect()))[0].startswith("ذهبت إلى إلى السوق")
    su = spark.createDataFrame([(0, "document", "")], "doc_id long, kind string, value string")
    assert {r.doc_id for r in Engine(spark, layers=scan).check(d, su).collect()} == {1}
    with pytest.raises(ValueError, match="unknown layers"):
        Engine(spark, layers=("magic",))


def test_own_words():
    assert own_words(" كتاب, كتاب،كِتاب;\n\n قلم ؛") == ("كتاب", "قلم")
    with pytest.raises(ValueError, match="more than"):
        own_words("\n".join(map(str, range(501))))


PRIVATE = "Write a.b@c.de, or www.x.yz/1234567890). Call +964.770 123-4567 or 12345678901234567890; x1234567 no. ☎٠٧٧٠١٢٣٤٥٦٧!"


def test_private_spans_and_masks(spark):
    got = [(k, PRIVATE[a:b]) for k, a, b in privacy.private(PRIVATE)]
    assert got == [("email", "a.b@c.de"), ("url", "www.x.yz/1234567890"), ("phone", "+964.770 123-4567"), ("phone", "٠٧٧٠١٢٣٤٥٦٧")]
    masked, noted = privacy.mask("" + PRIVATE)
    assert len(masked) == len(PRIVATE) + 1 and not any(p in masked for _, p in got) and len({s for *_, s in noted}) == 4 and "" not in {s for *_, s in noted}
    pairs = [(o, s) for *_, o, s in noted]
    assert privacy.restore(masked, pairs) == "" + PRIVATE and privacy.restore(masked.replace("Call", "Please call"), pairs) == "" + PRIVATE.replace("Call", "Please call")
    rng = random.Random(4)
    alphabet = ["a@b.cd ", "www.q.r/", "x", " ", "12345678", "+", "-", "", "٣٣٣٣٣٣٣", ".", "é"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(60)] + [None, ""]
    frame = docs(spark, *texts)
    rows = privacy.masked(frame)
    assert {r.doc_id: r.text for r in privacy.restored(rows).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert all(len(r.text) == len(texts[r.doc_id] or "") for r in rows.collect())
    assert privacy.logged(docs(spark, PRIVATE)).first().text.startswith("Write [REDACTED_EMAIL], or [REDACTED_URL]). Call [REDACTED_PHONE] or")
    with pytest.raises(ValueError, match="private spans"):
        privacy.mask("a@b.cd " * 4097)


def test_evaluation_units(spark):
    gold = [(1, 0, 3, "spelling", ["x"]), (2, 0, 3, "spelling", ["x"]), (3, 0, 3, "spelling", ["x"]), (4, 0, 3, "spelling", ["x"]), (5, 0, 3, "spelling", ["x"]), (6, 0, 3, "style", [])]
    found = [(1, 0, 3, "spelling", ["x"]), (2, 0, 3, "grammar", ["x"]), (3, 1, 3, "spelling", ["x"]), (5, 0, 3, "spelling", ["y", "x"]), (6, 0, 3, "style", []), (7, 5, 6, "style", None), (1, 0, 3, "spelling", ["x"])]
    cases = spark.createDataFrame([(i, 10) for i in range(1, 9)], "doc_id long, words long")
    frame = lambda rows, c: spark.createDataFrame(rows, f"doc_id long, start long, stop long, category string, {c} array<string>")
    got = {r.scope: r for r in evaluation.report(cases, frame(gold, "accepted"), frame(found, "replacements"), ("all", "mechanical", "style", "neural")).collect()}
    a = got["all"]
    assert (a.tp, a.fp, a.fn, a.cases, a.words) == (3, 3, 3, 8, 80) and (a.precision, a.recall) == (0.5, 0.5) and a.mrr == 0.75 and a.exact == 0.5 and a.fp_per_1000 == 37.5
    assert (a.correction_precision, a.sentence_precision, a.sentence_recall) == (0.5, round(5 / 6, 6), round(5 / 6, 6))
    assert (got["style"].tp, got["style"].fp, got["mechanical"].tp) == (1, 1, 2)
    n = got["neural"]
    assert (n.tp, n.fp, n.fn, n.precision, n.recall, n.f05, n.mrr, n.exact) == (0, 0, 0, 1.0, 1.0, 1.0, 1.0, 1.0)
    wrong = evaluation.report(cases, frame([(1, 0, 3, "spelling", ["x"])], "accepted"), frame([(1, 0, 3, "spelling", ["q"])], "replacements")).first()
    assert (wrong.tp, wrong.correction_precision, wrong.correction_recall, wrong.mrr) == (1, 0.0, 0.0, 0.0)


def test_reviewers(spark):
    rows = [("a", 1, 0, 3, "spelling", ["x"]), ("b", 1, 0, 3, "spelling", ["y", "x"]), ("a", 2, 0, 3, "style", []), ("b", 2, 0, 3, "style", []), ("a", 3, 0, 3, "style", ["z"]), ("b", 3, 0, 3, "style", ["w"]), ("a", 4, 1, 2, "style", [])]
    cases = spark.createDataFrame([(i,) for i in range(1, 7)], "doc_id long")
    r = evaluation.agreement(cases, spark.createDataFrame(rows, "annotator string, doc_id long, start long, stop long, category string, accepted array<string>"), "a", "b").first()
    assert (r.n, r.span_f1, r.correction_agreement, r.exact_agreement) == (6, round(6 / 7, 6), round(2 / 3, 6), 0.5)
    assert r.kappa == round((5 / 6 - 0.5) / 0.5, 6)


VOICES = ["ذهب الطالب إلى المدرسة، ثم عاد! هل كتب الدرس؟ نعم كتبه في البيت 12 مرة.", "قال المعلم: إن الوقت ضيق، لكن العمل كثير. كَتَبَ جمـيل www ٣٤", "", None, "one word"]


def test_forty_features_and_profiles(spark):
    n, sentences, f = voice.features(VOICES[0])
    assert len(voice.NAMES) == 40 and (n, sentences) == (14, 3) and f["sentence_length_mean"] == 14 / 3 and f["question_share"] == f["exclamation_share"] == 1 / 3
    assert f["connector_ثم"] == f["funcword_في"] == 1000 / 14 and f["connector_rate"] == 1 / 3 and f["arabic_comma_share"] == 1 and f["arabic_digit_share"] == 0 and f["type_token_ratio"] == 1
    g = voice.features(VOICES[1])[2]
    assert g["latin_share"] == 1 / 11 and g["arabic_digit_share"] == 1 and g["diacritics_density"] == 3 / 38 and g["tatweel_rate"] == 1 / 38
    rows = voice.fingerprints(spark.createDataFrame([(i, f"a{i % 2}", t) for i, t in enumerate(VOICES * 4)], "doc_id long, who string, text string"), "who")
    assert rows.count() == 40 * 20
    direct = voice.sums(rows, "who")
    halves = voice.sums(rows.where("doc_id < 9"), "who").unionByName(voice.sums(rows.where("doc_id >= 9"), "who"))
    assert sorted(map(tuple, voice.merged(halves, "who").collect())) == sorted(map(tuple, direct.collect()))
    profile = voice.profiles(direct)
    assert not profile.where("reliable").count()
    near = {r.doc_id: r for r in voice.drift(rows, profile, "who").collect()}
    assert 0 <= near[0].drift < near[2].drift < 1 and abs(near[0].drift + near[0].alignment - 1) < 1e-8 and len(near[0].most.split(",")) == 3


def test_templates(spark):
    rows = spark.createDataFrame([(1, {"title": "خطة", "date": " ", "attendees": "فريق"}), (2, None)], "k int, values map<string,string>")
    got = templates.render(rows, "meeting_summary").orderBy("k").collect()
    assert got[0].letter.startswith("# خطة\nالتاريخ: [التاريخ]\nالحضور: فريق\n\n## القرارات\n[القرارات]") and got[0].missing == ["date", "decisions", "actions"]
    assert "الحضور" not in got[1].letter and got[1].missing == ["title", "date", "decisions", "actions"]
    for name, (tones, _) in templates.TEMPLATES.items():
        assert templates.render(rows.where("k = 2"), name, tones[-1]).first().letter.count("[") == sum(templates.fields(name).values())
    with pytest.raises(ValueError, match="no tone"):
        templates.render(rows, "meeting_summary", "creative")
    bad = spark.createDataFrame([({"oops": "1"},), ({"title": "x" * 2001},)], "values map<string,string>")
    for n, why in ((0, "unknown fields"), (1, "too long")):
        with pytest.raises(Exception, match=why):
            templates.render(spark.createDataFrame(bad.collect()[n : n + 1], bad.schema), "meeting_summary").collect()


def test_rule_packs_and_resources(spark, tmp_path):
    (tmp_path / "b.yaml").write_text("- {id: TWO, category: style, severity: hint, pattern: كما أن, suggestion: وأن}\n")
    (tmp_path / "a.yaml").write_text("- {id: ONE, category: spelling, pattern: لاكن, suggestion: لكن, prefixes: [و]}\n")
    pack = packs.read_rule_pack(spark, str(tmp_path))
    assert sorted((r.id, r.pattern, r.priority, r.autofix) for r in pack.collect()) == [("ONE", "لاكن", 80, True), ("ONE", "ولاكن", 80, True), ("TWO", "كما أن", 20, False)]
    hits = rules.literal_hits(docs(spark, "ولاكن كما أن"), packs.surfaces_of(pack)).collect()
    assert sorted((r.rule_id, r.suggestion) for r in hits) == [("ONE", "ولكن"), ("TWO", "وأن")]
    (tmp_path / "c.yaml").write_text("- {id: ONE, category: style, pattern: x}\n")
    with pytest.raises(ValueError, match="occurs twice"):
        packs.read_rule_pack(spark, str(tmp_path))
    (tmp_path / "forms.json").write_text('[{"form": "شو", "dialect": "levantine", "weight": 1}]')
    assert packs.read_resource(spark, "dialects", str(tmp_path)).collect()[0] == ("شو", "levantine", 1.0)
    (tmp_path / "forms.json").write_text('[{"form": "شو", "dialect": "levantine", "weight": 9}]')
    with pytest.raises(ValueError, match="not in"):
        packs.read_resource(spark, "dialects", str(tmp_path))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\nb", None), (2, "ج", 3)], "k int, text string, n int")
    sinks.write_report(rows, str(tmp_path / "report"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "report")).collect()) == ['{"k":1,"text":"a\\nb","n":null}', '{"k":2,"text":"ج","n":3}']
    sinks.write_lines(rows, str(tmp_path / "lines"))
    assert spark.read.schema(rows.schema).json(str(tmp_path / "lines")).orderBy("k").collect() == rows.collect()
    sinks.write_texts(rows, str(tmp_path / "texts"), "k")
    (file,) = Path(tmp_path / "texts" / "k=1").glob("part-*")
    assert file.read_text().rstrip("\x00") == "a\nb"
    draft = spark.createDataFrame([("R2", "style", "b", None), ("R1", "spelling", "a", "c")], "id string, category string, pattern string, suggestion string")
    (tmp_path / "rules").mkdir()
    for _ in range(2):
        sinks.write_rules(draft, f"file://{tmp_path}/rules/draft.yaml")
    assert [r.id for r in packs.read_rule_pack(spark, str(tmp_path / "rules")).orderBy("id").collect()] == ["R1", "R2"]
    store = spark.createDataFrame([("a", 1, "x", False), ("b", 1, "y", False)], "id string, at int, v string, deleted boolean")
    changes = spark.createDataFrame([("a", 2, "z", False), ("b", 3, None, True), ("c", 1, "w", None)], store.schema)
    assert sorted((r.id, r.v) for r in sinks.put(store, changes, "id", "at").collect()) == [("a", "z"), ("c", "w")]
    out = spark.createDataFrame([(1, 50, 9), (2, 10, 9), (3, 10, 1), (4, 99, 0)], "id int, due_ms long, created_ms long")
    assert [r.id for r in sinks.due(out, 60, 2).collect()] == [3, 2]


def test_phrases_allow_marks_blanks_and_conjunctions(spark):
    got = phrases.matches(docs(spark, "ومِنْ  أجل هذا، من أجلك. فجدا", None), profiles=()).collect()
    assert [(r.rule_id, r.start, r.stop, r.suggestion) for r in got] == [("WORDY_FOR", 0, 10, "ولأجل"), ("WORDY_VERY", 25, 29, None)]
    with pytest.raises(ValueError, match="word"):
        phrases.tolerant(" ")
    got = phrases.in_sentences(docs(spark, "نلتقي\nهنا. نلتقي  غدا")).collect()
    assert [(r.rule_id, r.start, r.suggestion) for r in got] == [("REDUNDANT_MEET", 11, "نجتمع غدا")]


def test_generated_labels_point_at_their_errors(spark):
    rows = generator.generate(spark, 300).collect()
    assert len({r.text for r in rows}) == 300 and sum(r.category is None for r in rows) == 75
    wrong = {(p[1], p[2], p[3]) for p in generator.PATTERNS}
    assert all((r.text[r.start : r.stop], r.accepted[0], r.category) in wrong for r in rows if r.category)
    hits = rules.literal_hits(spark.createDataFrame([(r.id, r.text) for r in rows], "doc_id long, text string"), rules.rule_table(spark)).where("category = 'spelling'").collect()
    assert {(h.doc_id, h.start, h.stop) for h in hits} == {(r.id, r.start, r.stop) for r in rows if r.category == "spelling"}


def test_backends(spark):
    class Missing(backends.Weighted):
        def available(self):
            return False

    with pytest.raises(ValueError, match="available"):
        backends.first_available([Missing({}, name="x")])
    rows = spark.createDataFrame([(1, "a", {"f": 9.0}), (1, "b", {"f": 0.0}), (2, "c", {"f": 1.0}), (2, "d", {"f": 1.0}), (3, "e", None)], "k int, c string, features map<string,double>")
    got = {r.k: (r.c, r.accepted) for r in backends.decided(backends.scored(rows, backends.first_available([Missing({}), backends.Weighted({"f": 1.0})])), "k", "c").collect()}
    assert got == {1: ("a", True), 2: ("c", False), 3: ("e", True)}
