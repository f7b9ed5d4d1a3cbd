"""Registered queries of grammar, style, rewriting and rules with patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from warraq.functions import resources as R
from warraq.functions.text import WORD, normalize, tokens
from warraq.operators import analytics, conversion, editing, morphology, pattern_rules, records, rewriting, rules, seed_suite, senses, serving, spans, spelling, style, syntax, wordpiece
from warraq.plans import duck as D
from warraq.plans import grammar_sql as G
from warraq.plans.registry import SPAN, docs, long, query
from warraq.sources.corpus import arabic, grammar, table
from warraq.streaming import stateful

ANALYSIS = ("form", "lemma", "root", "pattern", "pos", "gender", "number", "definite", "preposition", "tense")


@query(D.sql(G.forms(), f"SELECT {', '.join(ANALYSIS)}, frequency::BIGINT AS frequency, confidence FROM fm"))
def morphology_forms(spark, sf):
    return morphology.forms(morphology.lexemes(spark)).select(*ANALYSIS, *long("frequency"), "confidence")


def _words(spark, sf):
    return tokens(grammar(spark, sf)).where("kind = 'arabic'").select(normalize(F.col("piece"), "lookup").alias("form")).distinct()


@query(D.sql(G.corpus(), D.tokens("ar"), G.analyses(f"SELECT DISTINCT {D.normalize('piece', 'lookup')} AS form FROM t WHERE kind = 'arabic'"), f"SELECT {', '.join(ANALYSIS)}, frequency, confidence, origin, rank, margin FROM an"))
def morphology_analyses(spark, sf):
    return morphology.analyses(_words(spark, sf), morphology.lexemes(spark)).select(*ANALYSIS, *long("frequency"), "confidence", "origin", "rank", "margin")


def _relations(spark, sf):
    return syntax.relations(syntax.pairs(syntax.parsed(grammar(spark, sf), morphology.lexemes(spark))))


@query(D.sql(G.corpus(), G.relations(), "SELECT doc_id, relation, head, dependent, conf AS confidence FROM rel"))
def syntax_relations(spark, sf):
    return _relations(spark, sf).select("doc_id", "relation", "head", "dependent", "confidence")


@query(D.sql(G.corpus(), G.relations(), "m AS (SELECT doc_id, dependent, max({'c': conf, 'r': relation, 'h': head}) AS m FROM rel GROUP BY ALL)", "SELECT doc_id, dependent, m.r AS relation, m.h AS head, m.c AS confidence, CASE m.r WHEN 'DEMONSTRATIVE' THEN 'follows' WHEN 'NAAT' THEN 'follows' WHEN 'IDAFA' THEN 'genitive' WHEN 'PREPOSITION_OBJECT' THEN 'genitive' WHEN 'JUSSIVE_VERB' THEN 'jussive' WHEN 'SUBJECT' THEN 'nominative' ELSE 'subjunctive' END AS \"case\" FROM m"))
def token_cases(spark, sf):
    return syntax.cases(_relations(spark, sf))


@query(D.sql(G.corpus(), G.relations(), G.checks()))
def syntax_checks(spark, sf):
    return syntax.checks(_relations(spark, sf)).select("doc_id", "rule_id", *long(*SPAN), "suggestion")


def _active() -> list[pattern_rules.PatternRule]:
    return pattern_rules.rules(("formal", "academic"))


@query(D.sql(G.corpus(), *G.pattern_rules(), "SELECT doc_id, rule_id, start, stop, suggestion FROM pr3"))
def pattern_rule_matches(spark, sf):
    return pattern_rules.matches(grammar(spark, sf), _active()).select("doc_id", "rule_id", *long(*SPAN), "suggestion")


def _sentence_words(spark, sf):
    return style.sentence_words(grammar(spark, sf), morphology.lexemes(spark))


@query(D.sql(G.corpus(), G.relations(), G.light_verbs()))
def light_verbs(spark, sf):
    return style.light_verbs(syntax.pairs(syntax.parsed(grammar(spark, sf), morphology.lexemes(spark)))).select("doc_id", "rule_id", *long(*SPAN), "suggestion", "confidence")


@query(D.sql(G.corpus(), G.sentence_words(), G.dense_sentences(6, 1, 1)))
def dense_sentences(spark, sf):
    """With lower thresholds than the defaults, as the sentences of the corpus are short."""
    return style.dense_sentences(_sentence_words(spark, sf), 6, 1, 1).select("doc_id", "rule_id", *long(*SPAN), "words", "nouns", "links")


@query(D.sql(G.corpus(), G.sentence_words(), G.contradictions()))
def contradictions(spark, sf):
    return style.contradictions(_sentence_words(spark, sf)).select("doc_id", "rule_id", *long(*SPAN), "lemma", "confidence")


@query(D.sql(D.arabic(), D.hits(), "SELECT h.doc_id, rule_id, start, stop, substr(text, start + 1, stop - start) AS source, CASE category WHEN 'spelling' THEN 'correctness' WHEN 'style' THEN 'clarity' WHEN 'dialect' THEN 'register' END AS why, CASE WHEN category = 'spelling' THEN 'safe_autofix' ELSE 'review_required' END AS decision FROM h JOIN ar USING (doc_id)"))
def explained_matches(spark, sf):
    ar = arabic(spark, sf)
    return style.explanations(rules.literal_hits(ar, rules.rule_table(spark)), ar).select("doc_id", "rule_id", *long(*SPAN), "source", "why", "decision")


@query(D.sql(D.arabic(), D.hits(), "SELECT doc_id, rule_id, start, stop, CASE WHEN category = 'style' AND doc_id % 3 > 0 THEN CASE WHEN doc_id % 5 >= 2 THEN 'voice:divergent' ELSE 'voice:aligned' END END AS tag, (priority + CASE WHEN category = 'style' AND doc_id % 3 > 0 THEN CASE WHEN doc_id % 5 >= 2 THEN 1 ELSE -1 END ELSE 0 END)::INT AS priority FROM h"))
def personalized_matches(spark, sf):
    ar = arabic(spark, sf)
    far = ar.select("doc_id", (F.col("doc_id") % 5 / 4).alias("drift"), (F.col("doc_id") % 3 > 0).alias("reliable"))
    return style.personalized(rules.literal_hits(ar, rules.rule_table(spark)), far).select("doc_id", "rule_id", *long(*SPAN), "tag", "priority")


@query("""WITH t AS (SELECT doc_id, ['neutral', 'formal', 'conversational', 'persuasive', 'objective'][doc_id % 5 + 1] AS tone, (doc_id % 7)::DOUBLE / 6 AS sig FROM documents),
c AS (SELECT doc_id, unnest(['academic', 'formal', 'casual', 'persuasive']) AS target, unnest([CASE WHEN tone IN ('conversational', 'neutral') THEN 0.92 ELSE 0.70 END, greatest(0.68, least(0.98, 0.72 + sig * 0.24)), CASE WHEN tone IN ('formal', 'objective') THEN 0.82 ELSE 0.64 END, CASE WHEN tone = 'persuasive' THEN 0.55 ELSE 0.86 END]::DOUBLE[]) AS rel FROM t),
r AS (SELECT doc_id, target, round(rel, 6)::DOUBLE AS relevance FROM c) SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY relevance DESC, target) AS rank FROM r""")
def suggestion_chips(spark, sf):
    names = F.array(*map(F.lit, ("neutral", "formal", "conversational", "persuasive", "objective")))
    tone = docs(spark, sf).select("doc_id", F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")).alias("tone"), (F.col("doc_id") % 7 / 6).alias("dialect_signal"))
    return style.chips(tone)


@query(D.sql(G.corpus(), G.sentence_words(), G.senses(), "k AS (SELECT *, row_number() OVER x AS rank, round(prob - lead(prob) OVER x, 5)::DOUBLE AS margin FROM sn WINDOW x AS (PARTITION BY doc_id, idx ORDER BY prob DESC, pos, lemma))", "SELECT doc_id, idx, form, pos, lemma, prob, margin, prob >= 0.78 AND margin >= 0.18 AS accepted FROM k WHERE rank = 1"))
def sense_selection(spark, sf):
    return senses.chosen(senses.scored(_sentence_words(spark, sf), morphology.lexemes(spark))).select("doc_id", *long("idx"), "form", "pos", "lemma", "prob", "margin", "accepted")


@query(D.sql(G.corpus(), G.sentence_words(), G.senses("true"), "SELECT doc_id, idx, string_agg(DISTINCT pos || ':' || lemma, '|' ORDER BY pos || ':' || lemma) AS labels, CASE WHEN max(prob) >= 0.7 THEN max({'p': prob, 'l': pos || ':' || lemma}).l END AS selected FROM sn GROUP BY doc_id, idx"))
def student_examples(spark, sf):
    """At a lower certainty than the default, which no reading of the corpus reaches."""
    return senses.student_rows(senses.scored(_sentence_words(spark, sf), morphology.lexemes(spark), every=True), 0.7).select("doc_id", *long("idx"), "labels", "selected")


@query(D.sql(D.arabic(), D.tokens("ar"), G.conversions(), D.resolved("cv"), "SELECT DISTINCT r.doc_id, r.rule_id, r.start, r.stop, suggestion FROM r JOIN cv USING (doc_id, rule_id, start, stop)"))
def standard_forms(spark, sf):
    return spans.resolve(conversion.to_standard(arabic(spark, sf))).select("doc_id", "rule_id", *long(*SPAN), "suggestion")


@query(D.sql(G.corpus(), G.relations(), *G.endings()))
def case_endings(spark, sf):
    words = syntax.parsed(grammar(spark, sf), morphology.lexemes(spark))
    cases = conversion.settled(syntax.cases(syntax.relations(syntax.pairs(words))))
    return conversion.marked(words, cases).select("doc_id", *long("idx"), "piece", "case", "marked")


@query(D.sql(G.corpus(), G.relations(), "a AS (SELECT doc_id, avg(coalesce(sure, 0)) AS w, count(*)::BIGINT AS words FROM w2 GROUP BY doc_id)", "b AS (SELECT doc_id, avg(conf) AS r, count(*)::BIGINT AS relations FROM rel GROUP BY doc_id)", "SELECT doc_id, words, coalesce(relations, 0) AS relations, round(w * 0.72 + coalesce(r, w) * 0.28, 5)::DOUBLE AS confidence FROM a LEFT JOIN b USING (doc_id)"))
def parse_confidence(spark, sf):
    words = syntax.parsed(grammar(spark, sf), morphology.lexemes(spark))
    return syntax.parse_confidence(words, syntax.relations(syntax.pairs(words)))


_EDITS = """ed AS (SELECT doc_id, 1 AS version, doc_id % 10 AS a, doc_id % 10 + 3 AS b, 'XY' AS put FROM ar UNION ALL SELECT doc_id, 2, 0, 0, '😀' FROM ar
UNION ALL SELECT doc_id, 3, CASE WHEN doc_id % 7 > 0 THEN 5 END, 6, CASE WHEN doc_id % 7 > 0 THEN '' ELSE 'new' END FROM ar),
st AS (SELECT doc_id, text, 0 AS version FROM ar UNION ALL SELECT st.doc_id, CASE WHEN a IS NULL THEN put ELSE substr(text, 1, a) || put || substr(text, b + 1) END, ed.version FROM st JOIN ed ON ed.doc_id = st.doc_id AND ed.version = st.version + 1)"""


@query("WITH RECURSIVE" + D.sql(G.corpus(), _EDITS, "SELECT doc_id, text, version FROM st WHERE version = 3").removeprefix("WITH"))
def edit_replay(spark, sf):
    g = grammar(spark, sf)
    edit = lambda v, a, b, put: g.select("doc_id", F.lit(v).alias("version"), a.cast("long").alias("start"), b.cast("long").alias("stop"), put.alias("text"))
    k, some = F.col("doc_id") % 10, F.col("doc_id") % 7 > 0
    edits = edit(3, F.when(some, 5), F.lit(6), F.when(some, "").otherwise("new")).unionByName(edit(1, k, k + 3, F.lit("XY"))).unionByName(edit(2, F.lit(0), F.lit(0), F.lit("😀")))
    return editing.replay(g, edits)


_EDITED = "concat(left(text, (20 + doc_id % 60)::INT), ' الى هذة ', substr(text, (24 + doc_id % 60)::INT))"


@query(D.sql(D.arabic().replace(" ar AS ", " was AS "), f"ar AS (SELECT doc_id, lang, source, {_EDITED} AS text FROM was)", D.hits(), "SELECT doc_id, rule_id, start, stop, suggestion FROM h"))
def incremental_check(spark, sf):
    """One edit to every text, checked about the edit alone; the oracle checks the whole new texts."""
    old = arabic(spark, sf)
    at = (F.col("doc_id") % 60).cast("int")
    new = old.withColumn("text", F.concat(F.substring("text", F.lit(1), at + 20), F.lit(" الى هذة "), F.substring("text", at + 24, F.char_length("text"))))
    check = lambda d: rules.literal_hits(d, rules.rule_table(spark)).select("doc_id", "rule_id", *long(*SPAN), "suggestion")
    return editing.recheck(old, new, check(old), check).select("doc_id", "rule_id", *long(*SPAN), "suggestion")


@query()
def rewrite_budgeted(spark, sf):
    """Tested against examples and properties: the budget is spent in order."""
    return rewriting.rewrite(arabic(spark, sf), "academic").drop("log")


@query("SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n, coalesce(length(text), 0) <= 50000 AS accepted FROM documents")
def served_texts(spark, sf):
    return serving.sized(docs(spark, sf))


_BARE_RULES = tuple((r[0], r[1], r[3], r[4]) for r in R.RULES)


@query(D.sql(D.lexicon("b", "id, pattern, category, severity", _BARE_RULES), "SELECT id, pattern, category, severity, CASE category WHEN 'spelling' THEN 0.99 ELSE 0.72 END::DOUBLE AS confidence, CASE category WHEN 'spelling' THEN 80 WHEN 'style' THEN 20 ELSE 30 END AS priority, category = 'spelling' AND severity = 'error' AS autofix, 'all' AS profile, NULL::VARCHAR AS suggestion FROM b"))
def canonical_rules(spark, sf):
    """The packaged rules stripped of what has a default."""
    bare = spark.createDataFrame([(i, c, s, p, None, None, None, None, None) for i, p, c, s in _BARE_RULES], rules.RULE_ROW)
    return rules.canonical(bare)


#: Rules whose first occurrence is labelled.
_LABELLED = tuple((r[0], r[1]) for r in R.RULES if r[0] not in ("ADDITION_ONE", "ACHIEVEMENT"))


@query(D.sql(
    D.arabic(), D.hits(), D.tokens("ar"), D.lexicon("lb", "rule_id, target", _LABELLED), "x AS (SELECT doc_id, rule_id, strpos(text, target) - 1 AS start, strpos(text, target) - 1 + length(target) AS stop FROM ar, lb WHERE contains(text, target))",
    "f AS (SELECT x.doc_id IS NOT NULL AS e, a.doc_id IS NOT NULL AS a FROM x FULL JOIN (SELECT DISTINCT doc_id, rule_id, start, stop FROM h) a USING (doc_id, rule_id, start, stop))",
    "n AS (SELECT count(*) FILTER (e AND a) AS tp, count(*) FILTER (a AND NOT e) AS fp, count(*) FILTER (e AND NOT a) AS fn, (SELECT count(*) FROM t WHERE kind = 'arabic') AS words FROM f)", "m AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM n)",
    "SELECT tp, fp, fn, words, round(p, 6)::DOUBLE AS p, round(r, 6)::DOUBLE AS r, round(1.25 * p * r / (0.25 * p + r), 6)::DOUBLE AS f05, round(fp * 1000 / words, 6)::DOUBLE AS fp_per_1000 FROM m",
))
def seed_evaluation(spark, sf):
    """First occurrences of the rules' patterns as labels, against what the rules find."""
    ar = arabic(spark, sf)
    expected = F.filter(F.array(*(F.struct(F.lit(r).alias("rule_id"), F.lit(p).alias("target")) for r, p in _LABELLED)), lambda x: F.contains(F.col("text"), x["target"]))
    words = tokens(ar).where("kind = 'arabic'").agg(F.count(F.lit(1)).alias("words"))
    return seed_suite.evaluate(seed_suite.labels(ar.select("doc_id", "text", expected.alias("expected"))), rules.literal_hits(ar, rules.rule_table(spark)), words)


@query(D.distilled().replace("SELECT bad, good, support, example,", f"SELECT bad, good, support, regexp_matches(example, '(?:\\A|[^{WORD}])' || bad || '(?:\\z|[^{WORD}])') AND NOT regexp_matches(replace(example, bad, good), '(?:\\A|[^{WORD}])' || bad || '(?:\\z|[^{WORD}])') AS verified,"))
def verified_rules(spark, sf):
    ar = arabic(spark, sf).select("text")
    fixed = F.col("text")
    for bad, good in D.FIXES:
        fixed = F.replace(fixed, F.lit(bad), F.lit(good))
    found = records.distilled(ar.select(F.col("text").alias("original"), fixed.alias("corrected")).where("original <> corrected"))
    return seed_suite.verified(found).select("bad", "good", "support", "verified", "rule_id")


@query()
def wordpiece_ids(spark, sf):
    """Pairs of a grammar text and an Arabic one, by a vocabulary of single letters and lemmas."""
    letters = [chr(c) for c in range(0x621, 0x64B)]
    vocabulary = [*wordpiece.SPECIAL, *letters, *(f"##{x}" for x in letters), *dict.fromkeys(r[0] for r in R.LEXEMES)]
    both = grammar(spark, sf).select("doc_id", F.col("text").alias("a")).join(arabic(spark, sf).select("doc_id", F.col("text").alias("b")), "doc_id")
    return wordpiece.encode(both, vocabulary, "a", "b").select("doc_id", F.array_join("ids", " ").alias("ids"), F.aggregate("mask", F.lit(0), lambda x, y: x + y).alias("n"), F.aggregate("types", F.lit(0), lambda x, y: x + y).alias("second"))


_SENT = "sum(((kind = 'punctuation' AND regexp_matches(piece, '[.!?؟؛…]')) OR (kind = 'whitespace' AND contains(piece, chr(10))))::INT) OVER (PARTITION BY doc_id ORDER BY idx) AS sent"


@query(D.readability("f2 AS (SELECT 1)").removesuffix("f2 AS (SELECT 1)").rstrip() + ", " + D.sql(
    f"ts AS (SELECT doc_id, kind, {_SENT} FROM t)", "sl AS (SELECT doc_id, sent, count(*) AS n FROM ts WHERE kind IN ('arabic', 'latin') GROUP BY ALL)", "sk AS (SELECT doc_id, count(*) AS k, sum(n) AS total FROM sl GROUP BY ALL)",
    "sv AS (SELECT doc_id, CASE WHEN any_value(k) > 1 THEN least(1.0, sum(abs(n * k - total))::DOUBLE / any_value(k * greatest(total, k))) ELSE 0 END::DOUBLE AS variety FROM sl JOIN sk USING (doc_id) GROUP BY doc_id)",
    "vt AS (SELECT doc_id, round(count(DISTINCT form) / count(*), 6) AS ttr FROM w GROUP BY doc_id)",
    "SELECT doc_id, round(least(100, greatest(0, clarity * 0.52::DOUBLE + least(15.0::DOUBLE, len(regexp_extract_all(text, '[?؟]')) * 3.0::DOUBLE) + least(12.0::DOUBLE, len(regexp_extract_all(text, 'لذلك|لأن|مثال|النتيجة')) * 2.0::DOUBLE) + coalesce(variety, 0) * 14.0::DOUBLE + least(7.0::DOUBLE, coalesce(ttr, 0) * 10.0::DOUBLE))), 4)::DOUBLE AS engagement, round(coalesce(variety, 0), 6)::DOUBLE AS variety FROM documents JOIN f USING (doc_id) LEFT JOIN vt USING (doc_id) LEFT JOIN sv USING (doc_id)",
).removeprefix("WITH "))
def engagement(spark, sf):
    return analytics.engagement(docs(spark, sf))


@query("WITH s AS (SELECT user_id AS doc_id, event_type AS tone, count(*)::DOUBLE AS score FROM events GROUP BY ALL), p AS (SELECT *, score / sum(score) OVER (PARTITION BY doc_id) AS p FROM s), h AS (SELECT doc_id, -sum(p * log2(p)) AS h, count(*) AS n, max({'s': score, 't': tone}).t AS dominant FROM p GROUP BY doc_id) SELECT doc_id, dominant, round(CASE WHEN n > 1 THEN least(100, greatest(0, h / log2(n) * 100)) ELSE 0 END, 4)::DOUBLE AS balance FROM h")
def tone_balance(spark, sf):
    """Kinds of events of a user stand for tones of a document."""
    s = table(spark, sf, "events").groupBy(F.col("user_id").alias("doc_id"), F.col("event_type").alias("tone")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    return analytics.tone_balance(s)


@query()
def spell_decisions(spark, sf):
    """The corpus of spell_suggestions, where some texts lack a letter."""
    ar = arabic(spark, sf)
    slip = F.concat(F.substring("text", F.lit(1), (F.col("doc_id") % 40 + 3).cast("int")), F.substring("text", (F.col("doc_id") % 40 + 5).cast("int"), F.char_length("text")))
    s = spelling.suggestions(ar.withColumn("text", F.when(F.col("doc_id") % 50 == 0, slip).otherwise(F.col("text"))), morphology.lexemes(spark))
    forms = s.select("form").union(s.select("candidate")).distinct()
    return spelling.decisions(s, morphology.analyses(forms, morphology.lexemes(spark)).select("form", "confidence"))


@query(D.sql(G.corpus(), G.sentence_words(), G.tone_shifts(0.36, 0.3)))
def tone_shifts(spark, sf):
    """At a lower certainty and share than the defaults, as the sentences of the corpus are short."""
    return style.tone_shifts(_sentence_words(spark, sf), least=0.36, share=0.3).select("doc_id", "rule_id", *long(*SPAN), "confidence")


@query(D.fingerprint(D.PROFILE, "SELECT source, feature, n, round(mean, 6) AS mean, round(std, 6) AS std FROM pr"))
def voice_stream(spark, sf):
    """The documents as a stream of samples; the same result as author_profile."""
    d = stateful.stream_of(docs(spark, sf), f"{sf}/document[s].parquet")
    return stateful.learn_voices(d, stateful.shared(spark), "source").select("source", "feature", "n", analytics.six(F.col("mean")).alias("mean"), analytics.six(F.col("std")).alias("std"))
