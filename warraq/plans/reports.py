"""Registered queries of the engine, private spans, evaluation reports, voices and templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.engine import Engine
from warraq.operators import analytics, backends, conversion, evaluation, morphology, phrases, privacy, rules, spans, syntax, templates, voice
from warraq.plans import duck as D
from warraq.plans import grammar_sql as G
from warraq.plans.registry import SPAN, docs, long, query
from warraq.sources import generator
from warraq.sources.corpus import arabic, grammar, table
from warraq.streaming import stateful

#: Private spans in SQL: addresses and e-mails by cutting texts into matches and single characters, phone numbers by trying
#: each digit that may begin one with each number of digits, the longest first.
_URL = rf"(?i:https?://|ftp://|www\.)[^{D.BLANK}<>\[\]{{}}\"'`]+"
_EMAIL = r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_PHONE = f"^\\+?[{D.DIGIT}](?:[{D.BLANK}().\\-]?[{D.DIGIT}]){{"


def _cut(name: str, pattern: str, kind: str) -> str:
    p = D.quoted(f"{pattern}|(?s:.)")
    end = "length(regexp_replace(p, '[.,\\x{060C}\\x{061B}\\x{061F}!?:;)\\x{BB}\\]}>]+\\z', ''))" if kind == "url" else "length(p)"
    return (
        f"{name}0 AS (SELECT doc_id, regexp_extract_all(text, {p}) AS ps FROM ar), {name}1 AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM {name}0), "
        f"{name}2 AS (SELECT *, (sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) - length(p))::BIGINT AS start FROM {name}1), "
        f"{name} AS (SELECT doc_id, '{kind}' AS kind, start, (start + {end})::BIGINT AS stop FROM {name}2 WHERE length(p) > 1)"
    )


_WORD = "\\p{L}\\p{N}_@"
_PRIVATE = (
    D.arabic(), _cut("pu", _URL, "url"), _cut("pe", _EMAIL, "email"),
    "pc0 AS (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM ar)",
    f"pc AS (SELECT doc_id, i, substr(text, i, 40) AS rest FROM pc0 WHERE regexp_matches(substr(text, i, 1), '[+{D.DIGIT}]') AND NOT regexp_matches(substr(text, i - 1, CASE WHEN i = 1 THEN 0 ELSE 1 END), '[{_WORD}]'))",
    "pm AS (SELECT doc_id, i, list_filter([" + ", ".join(f"(SELECT CASE WHEN m <> '' AND NOT regexp_matches(substr(rest, length(m) + 1, 1), '[{_WORD}]') THEN length(m) ELSE 0 END FROM (SELECT regexp_extract(rest, '{_PHONE}{k}}}') AS m))" for k in range(14, 5, -1)) + "], lambda n: n > 0) AS ns FROM pc)",
    "pp AS (SELECT doc_id, 'phone' AS kind, (i - 1)::BIGINT AS start, (i - 1 + ns[1])::BIGINT AS stop FROM pm WHERE len(ns) > 0)",
    "pa AS (SELECT doc_id, list({'a': start, 'b': stop, 'r': kind} ORDER BY start, start - stop, kind) AS ms FROM (SELECT * FROM pu UNION ALL SELECT * FROM pe UNION ALL SELECT * FROM pp) GROUP BY doc_id)",
    "pk AS (SELECT doc_id, list_reduce(list_transform(ms, lambda m: [m]), lambda acc, x: CASE WHEN len(acc) > 0 AND acc[-1].b > x[1].a THEN acc ELSE list_concat(acc, x) END, CAST([] AS STRUCT(a BIGINT, b BIGINT, r VARCHAR)[])) AS kept FROM pa)",
    "ps AS (SELECT doc_id, m.r AS kind, m.a AS start, m.b AS stop FROM (SELECT doc_id, unnest(kept) AS m FROM pk))",
)


@query(D.sql(*_PRIVATE, "SELECT doc_id, kind, start, stop FROM ps"))
def private_spans(spark, sf):
    """Addresses, e-mails and phone numbers that do not overlap."""
    return privacy.spans(arabic(spark, sf)).select("doc_id", "kind", *long(*SPAN))


@query(D.sql(*_PRIVATE, D.hits(), "SELECT h.doc_id, rule_id, h.start, h.stop FROM h WHERE NOT EXISTS (SELECT 1 FROM ps WHERE ps.doc_id = h.doc_id AND ps.start < h.stop AND h.start < ps.stop)"))
def unmasked_matches(spark, sf):
    ar = arabic(spark, sf)
    return privacy.outside(rules.literal_hits(ar, rules.rule_table(spark)), ar).select("doc_id", "rule_id", *long(*SPAN))


@query(D.sql(*_PRIVATE, "pn AS (SELECT doc_id, count(*) AS n, sum(stop - start) AS hidden FROM ps GROUP BY doc_id)", "SELECT doc_id, length(text)::BIGINT AS n_chars, coalesce(n, 0)::BIGINT AS n_masks, coalesce(hidden, 0)::BIGINT AS hidden, md5(text) AS restored_md5 FROM ar LEFT JOIN pn USING (doc_id)"))
def masked_texts(spark, sf):
    """Masks of the same length, and the texts that come back from them."""
    m = privacy.masked(arabic(spark, sf))
    hidden = F.aggregate("masks", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    per = m.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.size("masks").cast("long").alias("n_masks"), hidden.alias("hidden"), "text", "masks")
    back = privacy.restored(m).select("doc_id", F.md5("text").alias("restored_md5"))
    return per.drop("text", "masks").join(back, "doc_id")


def _labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases with their Arabic words, resolved matches as gold, and all matches of five documents of seven as predictions."""
    ar = arabic(spark, sf)
    hits = rules.literal_hits(ar, rules.rule_table(spark)).select("doc_id", *SPAN, "rule_id", "category", "suggestion").join(ar.select("doc_id"), "doc_id")
    kept = spans.resolve(rules.literal_hits(ar, rules.rule_table(spark))).join(hits.select("doc_id", *SPAN, "rule_id", "category"), ["doc_id", *SPAN, "rule_id"])
    empty = F.array().cast("array<string>")
    gold = kept.select("doc_id", *SPAN, "category", F.when(F.col("doc_id") % 2 == 0, F.array("suggestion")).otherwise(empty).alias("accepted"))
    k = F.col("doc_id") % 4
    found = hits.where("doc_id % 7 > 1").select("doc_id", *SPAN, "category", F.when(k == 0, F.array("suggestion")).when(k == 2, F.array(F.lit("x"), "suggestion")).otherwise(F.array(F.lit("x"))).alias("replacements"))
    from warraq.functions.scan import rows_of, tokens_of

    cases = rows_of(ar, lambda text: ((sum(k == "arabic" for *_, k in tokens_of(text)),),), "words long")
    return cases, gold, found


_SCOPED = "(VALUES ('all'), ('mechanical'), ('style'), ('dialect'))"
_IN = "(scope = 'all' OR scope = category OR (scope = 'mechanical' AND category IN ('spelling', 'grammar', 'punctuation')))"
_RATE = lambda p, tp, fp, fn: f"round(CASE WHEN {tp} + {fp} = 0 THEN 1 ELSE {tp} / ({tp} + {fp}) END, 6)::DOUBLE AS {p}precision, round(CASE WHEN {tp} + {fn} = 0 THEN 1 ELSE {tp} / ({tp} + {fn}) END, 6)::DOUBLE AS {p}recall, round(CASE WHEN {tp} + {fp} + {fn} = 0 THEN 1 WHEN {tp} = 0 THEN 0 ELSE 1.25 * ({tp} / ({tp} + {fp})) * ({tp} / ({tp} + {fn})) / (0.25 * ({tp} / ({tp} + {fp})) + ({tp} / ({tp} + {fn}))) END, 6)::DOUBLE AS {p}f05"
_GOLD = "g AS (SELECT DISTINCT r.doc_id, r.start, r.stop, h.category, CASE WHEN r.doc_id % 2 = 0 THEN [h.suggestion] ELSE []::VARCHAR[] END AS accepted FROM r JOIN h ON h.doc_id = r.doc_id AND h.start = r.start AND h.stop = r.stop AND h.rule_id = r.rule_id)"


@query(D.sql(
    D.arabic(), D.hits(), D.resolved(), D.tokens("ar"), _GOLD,
    "p AS (SELECT DISTINCT doc_id, start, stop, category, CASE doc_id % 4 WHEN 0 THEN [suggestion] WHEN 2 THEN ['x', suggestion] ELSE ['x'] END AS replacements FROM h WHERE doc_id % 7 > 1)",
    "b AS (SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, coalesce(g.category, p.category) AS category, g.doc_id IS NOT NULL AS g, p.doc_id IS NOT NULL AS p, accepted, replacements FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.start = p.start AND g.stop = p.stop AND g.category = p.category)",
    f"s AS (SELECT * FROM b JOIN {_SCOPED} v(scope) ON {_IN})",
    "m AS (SELECT *, g AND p AS hit, g AND p AND len(accepted) > 0 AS ranked, list_min(list_filter(list_transform(accepted, lambda a: coalesce(list_position(replacements, a), 0)), lambda x: x > 0)) AS rank FROM s)",
    "d AS (SELECT scope, doc_id, count(*) FILTER (hit) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (hit AND (len(accepted) = 0 OR rank IS NOT NULL)) AS ok, count(*) FILTER (ranked) AS ranked, sum(CASE WHEN ranked THEN coalesce(1 / rank, 0) ELSE 0 END) AS rr FROM m GROUP BY ALL)",
    "c AS (SELECT count(*) AS cases, (SELECT count(*) FROM t WHERE kind = 'arabic') AS words FROM ar)",
    f"x AS (SELECT v.scope, coalesce(sum(tp), 0) AS tp, coalesce(sum(fp), 0) AS fp, coalesce(sum(fn), 0) AS fn, coalesce(sum(ok), 0) AS ok, coalesce(sum(ranked), 0) AS ranked, sum(rr) AS rr, count(*) FILTER (tp + fn > 0 AND tp + fp > 0) AS dt, count(*) FILTER (tp + fn = 0 AND fp > 0) AS df, count(*) FILTER (tp + fp = 0 AND fn > 0) AS dn, count(*) FILTER (fp + fn > 0) AS inexact FROM {_SCOPED} v(scope) LEFT JOIN d ON d.scope = v.scope GROUP BY v.scope)",
    f"SELECT scope, cases::BIGINT AS cases, words::BIGINT AS words, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, {_RATE('', 'tp', 'fp', 'fn')}, {_RATE('correction_', 'ok', '(fp + tp - ok)', '(fn + tp - ok)')}, {_RATE('sentence_', 'dt', 'df', 'dn')}, round((cases - inexact) / cases, 6)::DOUBLE AS exact, round(CASE WHEN ranked = 0 THEN 1 ELSE rr / ranked END, 6)::DOUBLE AS mrr, round(fp * 1000 / words, 6)::DOUBLE AS fp_per_1000 FROM x, c",
))
def evaluation_report(spark, sf):
    return evaluation.report(*_labelled(spark, sf), scopes=("all", "mechanical", "style", "dialect"))


@query(D.sql(
    D.arabic(), D.hits(), D.resolved(), _GOLD, "b AS (SELECT DISTINCT doc_id, start, stop, category, CASE WHEN doc_id % 3 = 0 THEN [suggestion] WHEN doc_id % 3 = 1 THEN ['y', suggestion] ELSE ['y'] END AS accepted FROM h WHERE doc_id % 5 > 0)",
    "j AS (SELECT coalesce(g.doc_id, b.doc_id) AS doc_id, g.accepted AS x, b.accepted AS y FROM g FULL JOIN b ON g.doc_id = b.doc_id AND g.start = b.start AND g.stop = b.stop AND g.category = b.category)",
    "d AS (SELECT doc_id, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS tp, count(*) FILTER (x IS NULL) AS fp, count(*) FILTER (y IS NULL) AS fn, count(*) FILTER (list_has_any(x, y) OR (len(x) = 0 AND len(y) = 0)) AS same, count(*) FILTER (x = y) AS equal, count(x) AS nx, count(y) AS ny FROM j GROUP BY doc_id)",
    "k AS (SELECT coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(same, 0) AS same, coalesce(equal = nx AND equal = ny, true) AS exact, coalesce(nx > 0, false) AS a, coalesce(ny > 0, false) AS b FROM ar LEFT JOIN d USING (doc_id))",
    "s AS (SELECT count(*)::BIGINT AS n, count(*) FILTER (a = b) / count(*) AS o, count(*) FILTER (a) / count(*) AS pa, count(*) FILTER (b) / count(*) AS pb, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(same) AS same, count(*) FILTER (exact) AS exact FROM k)",
    "e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS e FROM s)",
    "SELECT n, round(o, 6)::DOUBLE AS observed, round(CASE WHEN abs(e - 1) < 1e-9 THEN CASE WHEN abs(o - 1) < 1e-9 THEN 1 ELSE 0 END ELSE (o - e) / (1 - e) END, 6)::DOUBLE AS kappa, round(2 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS span_f1, round(CASE WHEN tp = 0 THEN 1 ELSE same / tp END, 6)::DOUBLE AS correction_agreement, round(exact / n, 6)::DOUBLE AS exact_agreement FROM e",
))
def reviewer_agreement(spark, sf):
    cases, gold, _ = _labelled(spark, sf)
    k = F.col("doc_id") % 3
    ar = arabic(spark, sf)
    hits = rules.literal_hits(ar, rules.rule_table(spark)).where("doc_id % 5 > 0")
    second = hits.select(F.lit("b").alias("annotator"), "doc_id", *SPAN, "category", F.when(k == 0, F.array("suggestion")).when(k == 1, F.array(F.lit("y"), "suggestion")).otherwise(F.array(F.lit("y"))).alias("accepted"))
    reviews = gold.select(F.lit("a").alias("annotator"), "doc_id", *SPAN, "category", "accepted").unionByName(second)
    return evaluation.agreement(cases, reviews, "a", "b")


_LINKS, _FUNCTIONS = ("و", "ف", "ثم", "لكن", "بل", "كما", "حيث", "اذ", "لذلك", "غير"), ("في", "من", "على", "الى", "عن", "ان", "قد", "لقد", "هذا", "هذه", "ذلك", "التي", "الذي", "كان", "ليس")
_list = lambda words: ", ".join(map(D.quoted, words))
_div = lambda a, b: f"coalesce({a} / nullif({b}, 0), 0)::DOUBLE"
_COUNTED = "".join(f", coalesce(sum(n) FILTER (form = {D.quoted(w)}), 0) AS w{k}" for k, w in enumerate((*_LINKS, *_FUNCTIONS)))
_VALUES = {
    "sentence_length_mean": "coalesce(mean, 0)", "sentence_length_std": "coalesce(std, 0)", "word_length_mean": _div("letters", "na"), "type_token_ratio": _div("types", "na"), "hapax_ratio": _div("hapax", "na"),
    "diacritics_density": _div("marks", "letters"), "tatweel_rate": _div("strokes", "letters"), "punctuation_rate": _div("punct", "words"), "arabic_comma_share": f"CASE WHEN words > 0 THEN {_div('ac', 'ac + lc')} ELSE 0 END",
    "question_share": _div("questions", "k"), "exclamation_share": _div("cries", "k"), "connector_rate": f"CASE WHEN na > 0 THEN {_div('links', 'k')} ELSE 0 END", "function_word_rate": _div("functions * 1000", "na"),
    "latin_share": _div("latin", "words"), "arabic_digit_share": f"CASE WHEN words > 0 THEN {_div('ad', 'ad + wd')} ELSE 0 END",
} | {f"{'connector' if k < 10 else 'funcword'}_{w}": _div(f"w{k} * 1000", "na") for k, w in enumerate((*_LINKS, *_FUNCTIONS))}
_VOICE = (
    D.arabic(), D.tokens("ar"), D.sentences("ar"),
    "vw AS (SELECT * FROM t WHERE kind IN ('arabic', 'latin', 'hashtag', 'mention'))",
    "vn AS (SELECT vw.doc_id, sp.sent, count(*) AS n FROM vw ASOF JOIN sp ON vw.doc_id = sp.doc_id AND vw.start >= sp.start WHERE vw.start < sp.stop GROUP BY ALL)",
    "vl AS (SELECT doc_id, avg(n) AS mean, stddev_pop(n) AS std FROM vn WHERE n > 1 GROUP BY doc_id)",
    "vs AS (SELECT sp.doc_id, count(*) AS k, count(*) FILTER (regexp_matches(x, '[?\\x{061F}]')) AS questions, count(*) FILTER (regexp_matches(x, '[!\\x{FE57}]')) AS cries FROM (SELECT sp.doc_id, substr(ar.text, sp.start + 1, sp.stop - sp.start + 3) AS x FROM sp JOIN ar ON ar.doc_id = sp.doc_id) sp GROUP BY sp.doc_id)",
    f"va AS (SELECT doc_id, piece, {D.normalize('piece', 'lookup')} AS form, regexp_replace(piece, '[{D.MARKS}{D.STROKE}]', '', 'g') AS bare FROM t WHERE kind = 'arabic')",
    f"vb AS (SELECT doc_id, count(*) AS na, sum(length(bare)) AS letters, sum(len(regexp_extract_all(piece, '[{D.MARKS}]'))) AS marks, sum(len(regexp_extract_all(piece, '{D.STROKE}'))) AS strokes FROM va GROUP BY doc_id)",
    "vf AS (SELECT doc_id, form, count(*) AS n FROM va GROUP BY ALL)",
    f"vg AS (SELECT doc_id, count(*) AS types, count(*) FILTER (n = 1) AS hapax, coalesce(sum(n) FILTER (form IN ({_list(_LINKS)})), 0) AS links, coalesce(sum(n) FILTER (form IN ({_list(_FUNCTIONS)})), 0) AS functions{_COUNTED} FROM vf GROUP BY doc_id)",
    "vd AS (SELECT doc_id, count(*) AS words, count(*) FILTER (kind <> 'arabic' AND regexp_matches(piece, '\\A[\\x00-\\x7F]*\\z')) AS latin FROM vw GROUP BY doc_id)",
    "ve AS (SELECT doc_id, source, len(regexp_extract_all(text, '[،,؛;:.!؟?…«»\"''()\\-—]')) AS punct, len(regexp_extract_all(text, '،')) AS ac, len(regexp_extract_all(text, ',')) AS lc, len(regexp_extract_all(text, '[٠-٩]')) AS ad, len(regexp_extract_all(text, '[0-9]')) AS wd FROM ar)",
    "vx AS (SELECT ve.doc_id, source, coalesce(words, 0) AS words, coalesce(k, 0) AS sentences, unnest([" + ", ".join(f"{{'f': {D.quoted(f)}, 'v': ({v})::DOUBLE}}" for f, v in _VALUES.items()) + "]) AS fv FROM ve LEFT JOIN vd USING (doc_id) LEFT JOIN vs USING (doc_id) LEFT JOIN vl USING (doc_id) LEFT JOIN vb USING (doc_id) LEFT JOIN vg USING (doc_id))",
    "v AS (SELECT doc_id, source, words::BIGINT AS words, sentences::BIGINT AS sentences, fv.f AS feature, round(coalesce(fv.v, 0) * 1e6)::BIGINT AS value FROM vx)",
)


@query(D.sql(*_VOICE, "SELECT doc_id, words, sentences, feature, value FROM v"))
def voice_fingerprint(spark, sf):
    return voice.fingerprints(arabic(spark, sf))


def _learned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = voice.fingerprints(arabic(spark, sf), "source")
    return rows, voice.profiles(voice.sums(rows, "source"))


_PROFILES = "vp AS (SELECT source, feature, count(*)::BIGINT AS n, sum(words)::BIGINT AS words, sum(value)::DOUBLE / 1e6 / count(*) AS mean, CASE WHEN count(*) > 1 THEN sqrt(greatest(0.0::DOUBLE, sum(value::HUGEINT * value)::DOUBLE / 1e12 - (sum(value)::DOUBLE / 1e6) * (sum(value)::DOUBLE / 1e6) / count(*)) / (count(*) - 1)) ELSE 0.0 END AS std FROM v WHERE words > 0 GROUP BY ALL)"


@query(D.sql(*_VOICE, _PROFILES, "SELECT source, feature, n, words, round(mean, 5)::DOUBLE AS mean, round(std, 4)::DOUBLE AS std, n >= 3 AND words >= 300 AS reliable FROM vp"))
def voice_profiles(spark, sf):
    p = _learned(spark, sf)[1]
    return p.select("source", "feature", "n", "words", F.round("mean", 5).alias("mean"), F.round("std", 4).alias("std"), "reliable")


_WEIGHT = "CASE feature WHEN 'sentence_length_mean' THEN 3.0 WHEN 'sentence_length_std' THEN 2.0 WHEN 'word_length_mean' THEN 1.5 WHEN 'type_token_ratio' THEN 2.0 WHEN 'hapax_ratio' THEN 1.0 WHEN 'diacritics_density' THEN 1.5 WHEN 'tatweel_rate' THEN 0.5 WHEN 'punctuation_rate' THEN 1.5 WHEN 'arabic_comma_share' THEN 1.0 WHEN 'question_share' THEN 1.0 WHEN 'exclamation_share' THEN 1.0 WHEN 'connector_rate' THEN 2.5 WHEN 'function_word_rate' THEN 2.0 WHEN 'latin_share' THEN 1.0 WHEN 'arabic_digit_share' THEN 0.5 ELSE CASE WHEN starts_with(feature, 'connector_') THEN 0.4 ELSE 0.25 END END::DOUBLE"


@query(D.sql(*_VOICE, _PROFILES, f"vz AS (SELECT doc_id, v.words, {_WEIGHT.replace('feature', 'v.feature')} AS weight, abs(value / 1e6 - mean) / greatest(std, abs(mean) * 0.1, 0.02) AS z, n >= 3 AND vp.words >= 300 AS ok FROM v JOIN vp USING (source, feature))", "SELECT doc_id, round(sum(z / (z + 2) * weight) / sum(weight), 4)::DOUBLE AS drift, bool_and(ok) AND max(words) >= 30 AS reliable FROM vz GROUP BY doc_id"))
def voice_report(spark, sf):
    """Drift of each document from the profile of its source, weighted over forty features."""
    return voice.drift(*_learned(spark, sf), "source").select("doc_id", F.round("drift", 4).alias("drift"), "reliable")


def _engine_sql() -> str:
    from warraq.operators.checks import CHECKS

    parts = [D.check_parts(n) for n in CHECKS if n not in ("repeated_words",)]
    repeated = D.check_parts("repeated_words")[1]
    built = " UNION ALL ".join(f"SELECT doc_id, start, stop, rule_id, suggestion FROM ({b})" for b in [repeated, *(b for _, b in parts)])
    windows = D.check_parts("repeated_words")[0].removeprefix(D.tokens("ar") + ", ")
    variants = D.lexicon("vl", "grp, form", D.R.VARIANTS)
    every = (
        "m0 AS (SELECT doc_id, start, stop, rule_id, suggestion, category, priority, confidence, severity FROM h UNION ALL "
        f"SELECT doc_id, start, stop, rule_id, suggestion, CASE WHEN starts_with(rule_id, 'AGREEMENT') THEN 'grammar' WHEN starts_with(rule_id, 'PUNCT') THEN 'punctuation' WHEN starts_with(rule_id, 'DIALECT') THEN 'dialect' ELSE 'style' END, 0, 0.8, 'warning' FROM ({built}) UNION ALL "
        "SELECT doc_id, start, least(stop, start + 40), 'STYLE_LONG_SENTENCE', NULL, 'style', 0, 0.72, 'hint' FROM ht WHERE words > 50 UNION ALL "
        "SELECT doc_id, start, stop, 'CONSISTENCY_VARIANT_' || upper(grp), preferred, 'consistency', 88, 0.9, 'hint' FROM vs0 WHERE piece <> preferred)"
    )
    kept = "m AS (SELECT m0.* FROM m0 JOIN ar USING (doc_id) WHERE category IN ('spelling', 'grammar', 'punctuation', 'style', 'consistency') AND category <> 'grammar' AND rule_id <> 'HAMZA_TO' AND " + f"regexp_replace(substr(text, start + 1, stop - start), '[{D.MARKS}{D.STROKE}]', '', 'g') <> 'لاكن' AND NOT EXISTS (SELECT 1 FROM ps WHERE ps.doc_id = m0.doc_id AND ps.start < m0.stop AND m0.start < ps.stop))"
    return D.sql(
        *_PRIVATE, D.tokens("ar"), D.sentences("ar"), D.heat(), D.hits(), windows, *[a for a, _ in parts], variants,
        f"vs0 AS (SELECT doc_id, grp, start, stop, piece, first(piece) OVER (PARTITION BY doc_id, grp ORDER BY start) AS preferred FROM t JOIN vl ON form = {D.normalize('piece', 'lookup')} WHERE kind = 'arabic')",
        every, kept, D.resolved("m"), "SELECT rule_id, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs, sum(start)::BIGINT AS starts FROM r GROUP BY ALL",
    )


@query(_engine_sql())
def engine_check(spark, sf):
    """Four layers of the engine with enabled and disabled categories, a disabled rule, an own word and guarded private spans."""
    engine = Engine(spark, layers=("rules", "checks", "sentences", "consistency"), categories=("spelling", "grammar", "punctuation", "style", "consistency"), disabled_categories=("grammar",), disabled_rules=("HAMZA_TO",), words=("لاكن",))
    return engine.check(arabic(spark, sf)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"), F.sum("start").cast("long").alias("starts"))


@query("""SELECT c_custkey, 'professional_email' AS template, 'مرحبًا ' || coalesce(nullif(trim(c_name), ''), '[اسم المستلم]') || '،' || chr(10) || chr(10) || 'الموضوع: ' || coalesce(nullif(trim(c_mktsegment), ''), '[موضوع الرسالة]') || chr(10) || chr(10) || '[السياق]' || chr(10) || chr(10) || 'أرجو ' || '[الإجراء المطلوب]'
|| CASE WHEN c_custkey % 2 = 0 THEN ' وأرجو إتمام ذلك بحلول ' || c_custkey::VARCHAR ELSE '' END || '.' || chr(10) || chr(10) || 'شكرًا لوقتكم، وأتطلع إلى ردكم.' || chr(10) || chr(10) || 'مع التقدير،' || chr(10) || '[اسم المرسل]' AS letter, 'context,request,sender' AS missing FROM customer
UNION ALL SELECT c_custkey, 'meeting_summary', '# ' || trim(c_name) || chr(10) || 'التاريخ: [التاريخ]' || chr(10) || 'الحضور: ' || trim(c_mktsegment) || chr(10) || chr(10) || '## القرارات' || chr(10) || '[القرارات]' || chr(10) || chr(10) || '## الإجراءات' || chr(10) || '[الإجراء — المسؤول — الموعد]', 'date,decisions,actions' FROM customer""")
def template_documents(spark, sf):
    c = table(spark, sf, "customer")
    none = F.lit(None).cast("string")
    mail = c.select("c_custkey", F.create_map(F.lit("recipient"), "c_name", F.lit("subject"), "c_mktsegment", F.lit("deadline"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise(none), F.lit("context"), F.lit("  ")).alias("values"))
    meeting = c.select("c_custkey", F.create_map(F.lit("title"), "c_name", F.lit("attendees"), "c_mktsegment").alias("values"))
    made = lambda rows, name: templates.render(rows, name, templates.TEMPLATES[name][0][0]).select("c_custkey", F.lit(name).alias("template"), "letter", F.array_join("missing", ",").alias("missing"))
    return made(mail, "professional_email").unionByName(made(meeting, "meeting_summary"))


_PHRASES = (("WORDY_FOR", "من", "أجل", "", "لأجل"), ("WORDY_MAY", "من", "الممكن", "أن", "قد"), ("REDUNDANT_EFFORT", "بجد", "واجتهاد", "", "بجد"), ("WORDY_VERY", "جدا", "", "", ""))


@query(D.sql(
    D.arabic(), D.pieces(D.RUN, "ar", "u"), D.lexicon("pl", "rule_id, p1, p2, p3, suggestion", _PHRASES),
    f"pw AS (SELECT doc_id, start, stop, regexp_replace(piece, '[{D.MARKS}]', '', 'g') AS w1, " + ", ".join(f"lead(piece, {2 * k - 1}) OVER x AS g{k}, regexp_replace(lead(piece, {2 * k}) OVER x, '[{D.MARKS}]', '', 'g') AS w{k + 1}, lead(stop, {2 * k}) OVER x AS s{k + 1}" for k in (1, 2)) + " FROM u WINDOW x AS (PARTITION BY doc_id ORDER BY idx))",
    f"SELECT doc_id, rule_id, start, CASE WHEN p2 = '' THEN stop WHEN p3 = '' THEN s2 ELSE s3 END::BIGINT AS stop, CASE WHEN suggestion <> '' THEN CASE WHEN w1 = p1 THEN '' ELSE left(w1, 1) END || suggestion END AS suggestion FROM pw JOIN pl ON (w1 = p1 OR w1 = 'و' || p1 OR w1 = 'ف' || p1) WHERE (p2 = '' OR (w2 = p2 AND regexp_matches(g1, '\\A[{D.BLANK}]+\\z'))) AND (p3 = '' OR (w3 = p3 AND regexp_matches(g2, '\\A[{D.BLANK}]+\\z')))",
))
def style_phrases(spark, sf):
    """Phrases for formal writers."""
    return phrases.matches(arabic(spark, sf), profiles=("formal",)).select("doc_id", "rule_id", *long(*SPAN), "suggestion")


@query(D.sql(
    D.arabic(), D.sentences("ar"),
    *(f"rs{k} AS (SELECT doc_id, sent, start AS base, regexp_extract_all(body, '{p}|(?s:.)') AS ps FROM sp WHERE regexp_matches(body, '{p}'))" for k, p in enumerate(("ارتفع\\s+إلى\\s+\\S+\\s+خلال", "نلتقي\\s+(?:هنا|غدا)", "نهائي\\s+ولا\\s+رجعة"))),
    "se AS (" + " UNION ALL ".join(f"SELECT '{n}' AS rule_id, doc_id, sent, base, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM rs{k}" for k, n in enumerate(("REDUNDANT_RISE", "REDUNDANT_MEET", "CONTRADICTION_FINAL"))) + ")",
    "sf AS (SELECT *, (base + sum(length(p)) OVER (PARTITION BY rule_id, doc_id, sent ORDER BY i) - length(p))::BIGINT AS start FROM se)",
    "SELECT doc_id, rule_id, start, (start + length(p))::BIGINT AS stop, CASE rule_id WHEN 'REDUNDANT_RISE' THEN regexp_replace(p, 'ارتفع\\s+إلى\\s+(\\S+)\\s+خلال', 'بلغ \\1 خلال') WHEN 'REDUNDANT_MEET' THEN regexp_replace(p, 'نلتقي\\s+', 'نجتمع ') END AS suggestion FROM sf WHERE length(p) > 1",
))
def redundant_phrases(spark, sf):
    return phrases.in_sentences(arabic(spark, sf)).select("doc_id", "rule_id", *long(*SPAN), "suggestion")


_ROWS = ", ".join("(" + ", ".join(map(D.quoted, (k, *p))) + ")" for k, p in enumerate(generator.PATTERNS))
_at = lambda values, e: "[" + ", ".join(map(D.quoted, values)) + f"][{e} % {len(values)} + 1]"


@query(D.sql(
    f"gp(k, frame, bad, good, category) AS (VALUES {_ROWS})", f"g0 AS (SELECT range AS id, {_at(generator.DOMAINS, 'range')} AS domain, {_at(generator.DIALECTS, '(range // 7)')} AS dialect, {_at(generator.OPENINGS, '(range // 3)')} AS opening, range % 4 = 3 AS clean, (range // 5) % 7 AS k FROM range(5000))",
    "g1 AS (SELECT *, opening || replace(frame, '%', CASE WHEN clean THEN good ELSE bad END) || ' [' || id::VARCHAR || ']' AS text, (length(opening) + strpos(frame, '%') - 1)::BIGINT AS place FROM g0 JOIN gp USING (k))",
    "SELECT id::BIGINT AS id, text, domain, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END AS split, dialect, CASE WHEN NOT clean THEN category END AS category, CASE WHEN NOT clean THEN place END AS start, CASE WHEN NOT clean THEN place + length(bad) END::BIGINT AS stop, CASE WHEN NOT clean THEN good END AS accepted FROM (SELECT *, CAST('0x' || left(sha256(text), 8) AS BIGINT) % 100 AS b FROM g1)",
))
def generated_corpus(spark, sf):
    """Five thousand labelled cases, as many as the corpus of that kind has."""
    return generator.generate(spark, 5000).withColumn("accepted", F.element_at("accepted", 1))


@query("WITH c AS (SELECT user_id, event_type, count(*)::DOUBLE AS n, max(value) AS top FROM events GROUP BY ALL), s AS (SELECT *, 0.5::DOUBLE + n * 0.9::DOUBLE + coalesce(top, 0) * 0.01::DOUBLE AS score FROM c), e AS (SELECT *, exp((score - max(score) OVER w) / 0.82) AS e FROM s WINDOW w AS (PARTITION BY user_id)), p AS (SELECT *, e / sum(e) OVER (PARTITION BY user_id) AS prob FROM e), r AS (SELECT *, row_number() OVER x AS nth, prob - coalesce(lead(prob) OVER x, 0) AS gap FROM p WINDOW x AS (PARTITION BY user_id ORDER BY score DESC, event_type)) SELECT user_id, event_type, round(prob, 6)::DOUBLE AS prob, round(gap, 6)::DOUBLE AS margin, prob >= 0.985 AND gap >= 0.7 AS accepted FROM r WHERE nth = 1")
def backend_decisions(spark, sf):
    """Kinds of events of a user stand for candidates of a word; a backend of weights ranks them."""
    rows = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("n"), F.coalesce(F.max("value"), F.lit(0.0)).alias("top"))
    rows = rows.select("user_id", "event_type", F.create_map(F.lit("n"), "n", F.lit("top"), "top", F.lit("unknown"), F.lit(3.0)).alias("features"))
    return backends.decided(backends.scored(rows, backends.first_available([backends.Weighted({"n": 0.9, "top": 0.01}, 0.5)])), "user_id", "event_type")


@query(D.sql(G.corpus(), G.relations(), G.endings()[0], f"es AS ({G.endings()[1]})", "kd AS (SELECT doc_id, dependent, max(conf) AS conf FROM rel GROUP BY ALL)", "SELECT es.doc_id, 'DIACRITICS_CASE' AS rule_id, w2.start, w2.stop, marked AS suggestion, conf AS confidence FROM es JOIN w2 ON w2.doc_id = es.doc_id AND w2.idx = es.idx JOIN kd ON kd.doc_id = es.doc_id AND kd.dependent = es.idx WHERE conf >= 0.55 AND marked <> es.piece"))
def diacritic_suggestions(spark, sf):
    words = syntax.parsed(grammar(spark, sf), morphology.lexemes(spark))
    return conversion.mark_suggestions(words, syntax.cases(syntax.relations(syntax.pairs(words)))).select("doc_id", "rule_id", *long(*SPAN), "suggestion", "confidence")


@query(D.sql(G.forms(), "SELECT form, lemma, gender, preposition, confidence FROM fm WHERE lemma = 'طالب' AND pos = 'noun' AND number = 'plural' UNION ALL SELECT lemma, lemma, NULL, root, NULL FROM (VALUES " + ", ".join(f"({D.quoted(r[0])}, {D.quoted(r[1])})" for r in D.R.LEXEMES) + ") x(lemma, root) WHERE root = 'كتب'"))
def lemma_forms(spark, sf):
    """Plural forms of a noun, and the lexemes of a root."""
    lex = morphology.lexemes(spark)
    none = lambda kind: F.lit(None).cast(kind)
    root = morphology.by_root(lex, "كتب").select(F.col("lemma").alias("form"), "lemma", none("string").alias("gender"), F.col("root").alias("preposition"), none("double").alias("confidence"))
    return morphology.forms_of(lex, "طالب", "noun", number="plural").select("form", "lemma", "gender", "preposition", "confidence").unionByName(root)


@query(D.readability("f2 AS (SELECT 1)").removesuffix("f2 AS (SELECT 1)").rstrip() + ", " + D.sql(
    D.heat(), "lg AS (SELECT doc_id, max(words) AS longest FROM ht GROUP BY doc_id)", "vo AS (SELECT doc_id, count(*) AS types, count(*) FILTER (n = 1) AS hapax FROM (SELECT doc_id, form, count(*) AS n FROM w GROUP BY ALL) GROUP BY doc_id)",
    "vc AS (SELECT documents.doc_id, f.words, coalesce(types, 0)::BIGINT AS types, coalesce(hapax, 0)::BIGINT AS hapax, avg_chars, avg_words, clarity, coalesce(longest, 0)::BIGINT AS longest, (1 + len(regexp_extract_all(coalesce(text, ''), '[،؛:]')))::BIGINT AS clauses FROM documents JOIN f USING (doc_id) LEFT JOIN lg USING (doc_id) LEFT JOIN vo USING (doc_id))",
    "vq AS (SELECT *, CASE WHEN words = 0 THEN 0 ELSE least(100.0::DOUBLE, greatest(0.0::DOUBLE, (100 - clarity) * 0.62::DOUBLE + greatest(0.0::DOUBLE, avg_words - 12) * 1.25::DOUBLE + greatest(0, clauses - 1) * 7.0::DOUBLE)) END::DOUBLE AS cx FROM vc)",
    "SELECT doc_id, words, types, round(coalesce(types / nullif(words, 0), 0), 6)::DOUBLE AS ttr, round(coalesce(hapax / nullif(types, 0), 0), 6)::DOUBLE AS hapax_ratio, avg_chars, longest, clauses, round(cx, 4)::DOUBLE AS complexity, CASE WHEN cx < 22 THEN 'simple' WHEN cx < 45 THEN 'moderate' WHEN cx < 68 THEN 'advanced' ELSE 'complex' END AS band FROM vq",
).removeprefix("WITH "))
def vocabulary_report(spark, sf):
    return analytics.vocabulary_report(docs(spark, sf))


@query("WITH e AS (SELECT user_id AS doc, (epoch_us(ts) // 1000)::BIGINT AS ms, event_id AS seq FROM events), a AS (SELECT doc, quantile_disc(ms, 0.5) AS ms FROM e WHERE doc % 3 > 0 GROUP BY doc) SELECT e.doc, e.ms, e.seq FROM e LEFT JOIN a USING (doc) WHERE a.ms IS NULL OR (e.ms, e.seq) > (a.ms, 500)")
def journal_source(spark, sf):
    """Events as a stream of journal records, for two users of three from a cursor on."""
    e = table(spark, sf, "events")
    of = lambda x: x.select(F.col("user_id").alias("doc"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_id").alias("seq"))
    after = of(e).where("doc % 3 > 0").groupBy("doc").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ms)").cast("long").alias("ms")).withColumn("seq", F.lit(500).cast("long"))
    return stateful.played(stateful.journal(of(stateful.stream_of(e, f"{sf}/event[s].parquet")), after))
