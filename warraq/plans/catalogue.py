"""The registered queries of the text engine and their DuckDB oracles.

Queries on driver tables take whole tables; those that need Arabic build it from the sentences of
``resources`` by arithmetic on doc_id, in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.engine import Engine
from warraq.functions import resources as R
from warraq.functions.text import HTML_STEPS, html_text, normalize, respace, tokens
from warraq.operators import analytics as A
from warraq.operators import checks, document_rules, morphology, records, rules, sentences, serving, spans, spelling
from warraq.plans import duck as D
from warraq.plans.registry import ORACLES, QUERIES, ROWS_ONLY, SPAN, docs, long, query  # noqa: F401
from warraq.sources.corpus import arabic, arabic_of, table
from warraq.streaming import stateful

@query(D.sql(D.tokens(), "SELECT lang, kind, count(*)::BIGINT AS n FROM t GROUP BY ALL"))
def token_kind_counts(spark, sf):
    return tokens(docs(spark, sf), "lang").groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(D.sql(D.tokens(), "SELECT doc_id, idx, start, stop, kind FROM t"))
def token_offsets(spark, sf):
    return tokens(docs(spark, sf)).select("doc_id", *long("idx", *SPAN), "kind")


@query(D.sql(D.arabic(), D.tokens("ar"), "SELECT doc_id, idx, start, stop, kind, piece FROM t"))
def token_offsets_arabic(spark, sf):
    return tokens(arabic(spark, sf)).select("doc_id", *long("idx", *SPAN), "kind", "piece")


@query(D.sql(D.arabic(), "SELECT doc_id, " + ", ".join(f"md5({D.normalize('text', m)}) AS {m}" for m in ("strict", "lookup", "search", "aggressive")) + ", md5(" + D.respace("text") + ") AS respaced FROM ar"))
def normalize_modes(spark, sf):
    t = F.col("text")
    return arabic(spark, sf).select("doc_id", *[F.md5(normalize(t, m)).alias(m) for m in ("strict", "lookup", "search", "aggressive")], F.md5(respace(t)).alias("respaced"))


def _check(name: str) -> None:
    def run(spark, sf):
        return checks.all_checks(arabic(spark, sf), (name,)).select("doc_id", "rule_id", *long(*SPAN), "suggestion")

    run.__name__ = name
    query(D.check(name))(run)


for _name in checks.CHECKS:
    _check(_name)


@query(D.sql(D.arabic(), D.hits(), "SELECT doc_id, start, stop, rule_id, suggestion FROM h"))
def literal_rules_hits(spark, sf):
    return rules.literal_hits(arabic(spark, sf), rules.rule_table(spark)).select("doc_id", *long(*SPAN), "rule_id", "suggestion")


@query(D.sql(D.arabic(), D.hits("profile IN ('all', 'formal')"), "SELECT rule_id, category, count(*)::BIGINT AS n FROM h GROUP BY ALL"))
def profile_filtered_rules(spark, sf):
    return rules.literal_hits(arabic(spark, sf), rules.rule_table(spark, ("formal",))).groupBy("rule_id", "category").agg(F.count(F.lit(1)).alias("n"))


@query(D.sql(D.arabic(), D.hits(), D.resolved(), "SELECT rule_id, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs, sum(start)::BIGINT AS starts FROM r GROUP BY ALL"))
def literal_rules_resolved(spark, sf):
    kept = spans.resolve(rules.literal_hits(arabic(spark, sf), rules.rule_table(spark)))
    return kept.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"), F.sum("start").cast("long").alias("starts"))


@query(D.sql(D.arabic(), D.hits(), D.tokens("ar"), "SELECT doc_id, rule_id, start, stop FROM h WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = h.doc_id AND t.kind = 'arabic' AND length(t.piece) >= 6 AND t.start < h.stop AND h.start < t.stop)"))
def overlap_filter(spark, sf):
    ar = arabic(spark, sf)
    return spans.drop_overlapping(rules.literal_hits(ar, rules.rule_table(spark)), tokens(ar).where("kind = 'arabic' and char_length(piece) >= 6")).select("doc_id", "rule_id", *long(*SPAN))


@query(D.sql(D.tokens(), "SELECT doc_id, kind, start, CASE WHEN kind = 'url' THEN start + length(regexp_replace(piece, '[.,،؛؟!?:;)»\\]}>]+\\z', '')) ELSE stop END::BIGINT AS stop FROM t WHERE kind IN ('url', 'email')"))
def pii_spans(spark, sf):
    return records.private_spans(docs(spark, sf)).select("doc_id", "kind", *long(*SPAN))


def _redact(col: str) -> str:
    for kind, pattern in records.REDACTIONS.items():
        col = f"regexp_replace({col}, {D.quoted(pattern)}, '[REDACTED_{kind}]', 'g')"
    return col


@query(f"SELECT doc_id, {_redact('text')} AS text FROM documents")
def redacted_text(spark, sf):
    return records.redacted(docs(spark, sf))


@query(D.readability("SELECT lang, count(*)::BIGINT AS docs, sum(words)::BIGINT AS words, sum(round(clarity * 1000000)::BIGINT)::BIGINT AS clarity_sum, count(*) FILTER (band = 'clear')::BIGINT AS clear FROM f JOIN documents USING (doc_id) GROUP BY lang"))
def readability_by_lang(spark, sf):
    r = A.readability(docs(spark, sf), "lang")
    return r.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("words").alias("words"), F.sum(F.round(F.col("clarity") * 1000000).cast("long")).alias("clarity_sum"), F.count(F.when(F.col("band") == "clear", 1)).alias("clear"))


@query(D.readability("SELECT doc_id, words, sentences, avg_words, avg_chars, long_ratio, repeated_ratio, clarity, band FROM f"))
def readability(spark, sf):
    return A.readability(docs(spark, sf))


@query(D.sql(D.tokens(), D.words(), "y AS (SELECT doc_id, form, count(*) AS n FROM w GROUP BY ALL)", "SELECT doc_id, sum(n)::BIGINT AS tokens, count(*)::BIGINT AS types, count(*) FILTER (n = 1)::BIGINT AS hapax, round(count(*) / sum(n), 6)::DOUBLE AS ttr, round(count(*) FILTER (n = 1) / count(*), 6)::DOUBLE AS hapax_ratio FROM y GROUP BY doc_id"))
def vocabulary_richness(spark, sf):
    return A.vocabulary(docs(spark, sf))


@query(D.sql(D.tokens(), D.words(), "n AS (SELECT doc_id, count(*) AS words FROM w GROUP BY doc_id)", "SELECT doc_id, length(text)::BIGINT AS characters, len(regexp_extract_all(text, '[^\\n]+'))::BIGINT AS paragraphs, len(regexp_extract_all(text, '[?؟]'))::BIGINT AS questions, coalesce(words, 0)::BIGINT AS words, ceil(coalesce(words, 0) * 60 / 180)::BIGINT AS reading_s, ceil(coalesce(words, 0) * 60 / 130)::BIGINT AS speaking_s FROM documents LEFT JOIN n USING (doc_id)"))
def document_analytics(spark, sf):
    return A.document_analytics(docs(spark, sf))


@query(D.fingerprint("SELECT * FROM p"))
def fingerprint(spark, sf):
    return A.fingerprint(docs(spark, sf), "source")


def _profiles(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = A.features(A.fingerprint(docs(spark, sf), "source"), "source")
    return rows, A.profile(A.moments(rows, "source"))


@query(D.fingerprint(D.PROFILE, "SELECT source, feature, n, round(mean, 6) AS mean, round(std, 6) AS std FROM pr"))
def author_profile(spark, sf):
    return _profiles(spark, sf)[1].select("source", "feature", "n", A.six(F.col("mean")).alias("mean"), A.six(F.col("std")).alias("std"))


@query(D.fingerprint(D.PROFILE, "SELECT feature, sum(n)::BIGINT AS n, sum(s)::BIGINT AS s, sum(q)::BIGINT AS q FROM pr GROUP BY feature"))
def profile_merge(spark, sf):
    rows = A.features(A.fingerprint(docs(spark, sf), "source"), "source")
    return A.fitted(A.merged(A.moments(rows, "source")))


@query(D.fingerprint(D.PROFILE, "SELECT doc_id, round(avg(z / (z + 2)), 4) AS drift, count(*)::BIGINT AS features FROM (SELECT doc_id, abs(value / 1e6 - mean) / greatest(std, abs(mean) * 0.1, 0.02) AS z FROM v JOIN pr USING (source, feature)) GROUP BY doc_id"))
def voice_drift(spark, sf):
    rows, profiles = _profiles(spark, sf)
    return A.drift(rows, profiles, "source").withColumn("drift", F.round("drift", 4))


@query(D.sql(D.arabic(), D.tokens("ar"), D.lexicon("l", "form, dialect, weight", R.DIALECT_FORMS), f"SELECT doc_id, start, stop, form, dialect, weight::DOUBLE AS weight FROM t JOIN l ON form = {D.normalize('piece', 'lookup')} WHERE kind = 'arabic'"))
def dialect_hits(spark, sf):
    return A.dialect_hits(arabic(spark, sf)).select("doc_id", *long(*SPAN), "form", "dialect", "weight")


@query(D.dialects())
def dialect_identify(spark, sf):
    return A.dialects(arabic(spark, sf))


@query(D.sql(D.arabic(), D.tokens("ar"), D.lexicon("l", "tone, form, weight", R.TONE_WORDS), f"SELECT doc_id, tone, round(sum(round(weight * 1000)::BIGINT) / 1000 + 0.18, 6)::DOUBLE AS score, count(*)::BIGINT AS hits FROM t JOIN l ON form = {D.normalize('piece', 'lookup')} WHERE kind = 'arabic' GROUP BY doc_id, tone"))
def tone_lexical(spark, sf):
    return A.tones(arabic(spark, sf))


@query(D.sql(D.arabic(), D.tokens("ar"), D.lexicon("l", "grp, form", R.VARIANTS), f"s AS (SELECT doc_id, grp, start, stop, piece, first(piece) OVER (PARTITION BY doc_id, grp ORDER BY start) AS preferred FROM t JOIN l ON form = {D.normalize('piece', 'lookup')} WHERE kind = 'arabic')", "SELECT * FROM s WHERE piece <> preferred"))
def variant_consistency(spark, sf):
    return A.variant_consistency(arabic(spark, sf)).select("doc_id", "grp", *long(*SPAN), "piece", "preferred")


@query(D.sql(D.arabic(), D.tokens("ar"), "s AS (SELECT *, CASE WHEN regexp_matches(piece, '[0-9]') AND regexp_matches(piece, '[٠-٩]') THEN 'mixed' WHEN regexp_matches(piece, '[0-9]') THEN 'western' ELSE 'arabic_indic' END AS style FROM t WHERE kind = 'number')", "q AS (SELECT doc_id, start, stop, piece, style, first_value(nullif(style, 'mixed') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY start) AS preferred FROM s)", "SELECT * FROM q WHERE style = 'mixed' OR style <> preferred"))
def numeral_consistency(spark, sf):
    return A.numeral_consistency(arabic(spark, sf)).select("doc_id", *long(*SPAN), "piece", "style", "preferred")


@query(D.sql(D.arabic(), D.tokens("ar"), f"f AS (SELECT DISTINCT {D.normalize('piece', 'lookup')} AS form FROM t WHERE kind = 'arabic')", "k AS (SELECT DISTINCT form, unnest(list_append(list_transform(range(1, length(form) + 1), lambda i: substr(form, 1, i - 1) || substr(form, i + 1)), form)) AS key FROM f WHERE length(form) >= 4)", "SELECT DISTINCT a.form AS left_form, b.form AS right_form FROM k a JOIN k b USING (key) WHERE a.form < b.form"))
def edit_candidates(spark, sf):
    return A.spelling_neighbours(arabic(spark, sf))


def _found(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Resolved rule matches as gold; all matches of documents whose id is no multiple of seven as predictions."""
    ar = arabic(spark, sf)
    hits = rules.literal_hits(ar, rules.rule_table(spark)).join(ar.select("doc_id", "lang", "source"), "doc_id")
    gold = spans.resolve(hits).join(hits.select("doc_id", "start", "stop", "rule_id", "category", "lang", "source"), ["doc_id", "start", "stop", "rule_id"])
    return gold, hits.where("doc_id % 7 <> 0")


_EVAL = (D.arabic(), D.hits(), D.resolved(), "g AS (SELECT DISTINCT r.doc_id, r.start, r.stop, category FROM r JOIN h USING (doc_id, start, stop, rule_id))", "p AS (SELECT DISTINCT doc_id, start, stop, category FROM h WHERE doc_id % 7 <> 0)", "b AS (SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, g.doc_id IS NOT NULL AS in_g, p.doc_id IS NOT NULL AS in_p FROM g FULL JOIN p USING (doc_id, start, stop, category))")
_COUNTS = "count(*) FILTER (in_g AND in_p)::BIGINT AS tp, count(*) FILTER (NOT in_g)::BIGINT AS fp, count(*) FILTER (NOT in_p)::BIGINT AS fn"
_RATES = "round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN 0.25 * pr + re = 0 THEN 0 ELSE 1.25 * pr * re / (0.25 * pr + re) END, 6)::DOUBLE AS f05"
_PR = "CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END::DOUBLE AS pr, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END::DOUBLE AS re"


@query(D.sql(*_EVAL, f"c AS (SELECT {_COUNTS} FROM b)", f"d AS (SELECT *, {_PR} FROM c)", f"SELECT tp, fp, fn, {_RATES} FROM d"))
def eval_counts(spark, sf):
    return records.evaluate(*_found(spark, sf))


@query(D.sql(*_EVAL, f"c AS (SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, {_COUNTS} FROM b JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source)))", f"d AS (SELECT *, {_PR} FROM c)", f"SELECT lang, source, tp, fp, fn, {_RATES} FROM d"))
def eval_slices(spark, sf):
    return records.evaluate(*_found(spark, sf), "lang", "source")


@query("WITH s AS (SELECT lang, count(*)::BIGINT AS n, count(*) FILTER (quality = 1 - toxic) AS same, sum(quality) AS a1, sum(1 - toxic) AS b1 FROM labels JOIN documents USING (doc_id) GROUP BY lang), e AS (SELECT *, same / n AS o, (a1 / n) * (b1 / n) + (1 - a1 / n) * (1 - b1 / n) AS e FROM s) SELECT lang, n, round(o, 6)::DOUBLE AS observed, round(CASE WHEN abs(e - 1) < 1e-9 THEN CASE WHEN abs(o - 1) < 1e-9 THEN 1 ELSE 0 END ELSE (o - e) / (1 - e) END, 6)::DOUBLE AS kappa FROM e")
def annotator_kappa(spark, sf):
    pairs = table(spark, sf, "labels").join(docs(spark, sf).select("doc_id", "lang"), "doc_id").select("lang", F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return records.kappa(pairs, "lang")


@query(D.distilled())
def distill_candidates(spark, sf):
    ar = arabic(spark, sf).select("text")
    fixed = F.col("text")
    for bad, good in D.FIXES:
        fixed = F.replace(fixed, F.lit(bad), F.lit(good))
    return records.distilled(ar.select(F.col("text").alias("original"), fixed.alias("corrected")).where("original <> corrected")).select("bad", "good", "support", "example", "rule_id")


@query("WITH b AS (SELECT doc_id, CAST('0x' || left(sha256(text), 8) AS BIGINT) % 100 AS b FROM documents) SELECT doc_id, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END AS split FROM b")
def student_split(spark, sf):
    return docs(spark, sf).select("doc_id", records.split_of(F.col("text")).alias("split"))


def _concise(col: str) -> str:
    for a, b in R.CONCISE:
        col = f"replace({col}, '{a}', '{b}')"
    return col


@query(D.sql(D.arabic(), f"SELECT doc_id, {_concise('text')} AS text, (length(text) - length({_concise('text')}))::BIGINT AS saved FROM ar"))
def rewrite_concise_unbudgeted(spark, sf):
    t = F.col("text")
    for a, b in R.CONCISE:
        t = F.replace(t, F.lit(a), F.lit(b))
    return arabic(spark, sf).select("doc_id", t.alias("text"), (F.char_length("text") - F.char_length(t)).cast("long").alias("saved"))


@query("SELECT c_custkey, 'السلام عليكم ' || coalesce(nullif(trim(c_name), ''), '[name]') || '، القسم: ' || coalesce(nullif(trim(c_mktsegment), ''), '[segment]') || '.' AS letter FROM customer")
def template_render(spark, sf):
    field = lambda c, name: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(f"[{name}]"))
    return table(spark, sf, "customer").select("c_custkey", F.format_string("السلام عليكم %s، القسم: %s.", field("c_name", "name"), field("c_mktsegment", "segment")).alias("letter"))


@query("""WITH j AS (SELECT user_id AS doc, (epoch_us(ts) // 1000)::BIGINT AS ms, event_id AS seq, CASE WHEN event_id % 50 = 0 THEN 'snapshot' ELSE 'update' END AS kind FROM events),
p AS (SELECT doc, min(ms) AS ms, 0::BIGINT AS seq FROM j WHERE doc % 3 <> 0 GROUP BY doc),
s AS (SELECT doc, max((ms, seq)) AS snap FROM j WHERE kind = 'snapshot' GROUP BY doc),
b AS (SELECT d.doc, snap IS NOT NULL AND (p.ms IS NULL OR (p.ms, p.seq) < snap) AS from_snapshot, snap, p.ms AS pms, p.seq AS pseq FROM (SELECT DISTINCT doc FROM j) d LEFT JOIN s USING (doc) LEFT JOIN p USING (doc)),
t AS (SELECT doc, ms, seq, kind, from_snapshot, row_number() OVER (PARTITION BY doc ORDER BY ms, seq) AS rank FROM j JOIN b USING (doc) WHERE CASE WHEN from_snapshot THEN (ms, seq) >= snap WHEN pms IS NULL THEN true ELSE (ms, seq) > (pms, pseq) END)
SELECT doc, ms, seq, kind, from_snapshot, rank FROM t WHERE rank <= 20""")
def journal_recover(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    j = table(spark, sf, "events").select(F.col("user_id").alias("doc"), ms.alias("ms"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 50 == 0, "snapshot").otherwise("update").alias("kind"))
    peer = j.where("doc % 3 <> 0").groupBy("doc").agg(F.min("ms").alias("ms")).withColumn("seq", F.lit(0).cast("long"))
    return records.recover(j, peer, page=20)


@query("SELECT event_id, (event_id % 12)::BIGINT AS attempts, least(300000, 1000 * (2 ** (event_id % 12)))::BIGINT AS wait_ms, (epoch_us(ts) // 1000 + least(300000, 1000 * (2 ** (event_id % 12))))::BIGINT AS due_ms FROM events")
def outbox_backoff(spark, sf):
    wait = records.retry_after(F.col("event_id") % 12)
    return table(spark, sf, "events").select("event_id", (F.col("event_id") % 12).alias("attempts"), wait.alias("wait_ms"), (F.unix_millis(F.col("ts").cast("timestamp")) + wait).alias("due_ms"))


def _html(col: str) -> str:
    for pattern, to in HTML_STEPS:
        col = f"regexp_replace({col}, {D.quoted(pattern)}, {D.quoted(to.replace('$1', chr(92) + '1'))}, 'g')"
    return f"trim({col})"


@query(f"SELECT page_id, md5({_html('html')}) AS text_md5, length({_html('html')})::BIGINT AS n_chars FROM pages")
def html_to_text(spark, sf):
    text = html_text(F.col("html"))
    return table(spark, sf, "pages").select("page_id", text.alias("text")).select("page_id", F.md5("text").alias("text_md5"), F.char_length("text").cast("long").alias("n_chars"))


@query("WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY ALL) SELECT *, (n - lag(n) OVER w)::BIGINT AS n_delta, (users - lag(users) OVER w)::BIGINT AS users_delta FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)")
def analytics_trend(spark, sf):
    daily = table(spark, sf, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
    return records.trend(daily, "event_type", "day", "n", "users")


@query("WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(qv, lambda x: x::DOUBLE)), 6) AS score FROM embeddings, q) SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s ORDER BY score DESC, vec_id LIMIT 10")
def cosine_rank(spark, sf):
    e = table(spark, sf, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    top = e.crossJoin(F.broadcast(one)).select("vec_id", A.six(records.cosine(F.col("embedding"), F.col("q"))).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)
    return top.withColumn("rank", F.row_number().over(A.Window.orderBy(F.desc("score"), "vec_id")).cast("long"))


@query(D.check_pipeline())
def check_pipeline(spark, sf):
    """Rules and built-in checks of every document, resolved against each other in one pass and counted."""
    kept = Engine(spark, layers=("rules", "checks"), guard_private=False).check(arabic(spark, sf))
    return kept.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start").cast("long").alias("starts"))


@query(D.sql(D.sentences(), "SELECT doc_id, sent, start, stop, terminator FROM sp"))
def sentence_spans(spark, sf):
    return sentences.sentences(docs(spark, sf)).select("doc_id", *long("sent", *SPAN), "terminator")


@query(D.sql(D.tokens(), D.sentences(), D.heat(), "SELECT doc_id, sent, start, stop, words, round(c, 6) AS complexity, round(100 - c * 0.72::DOUBLE, 6) AS clarity, CASE WHEN c < 28 THEN 'cool' WHEN c < 52 THEN 'balanced' WHEN c < 72 THEN 'warm' ELSE 'hot' END AS heat FROM ht"))
def sentence_heatmap(spark, sf):
    return sentences.heatmap(docs(spark, sf)).withColumns({c: F.col(c).cast("long") for c in ("sent", *SPAN)})


@query(D.sql(D.tokens(), D.sentences(), D.heat(), "SELECT doc_id, 'STYLE_LONG_SENTENCE' AS rule_id, start, least(stop, start + 40) AS stop, words FROM ht WHERE words > 50"))
def long_sentences(spark, sf):
    return sentences.long_sentences(docs(spark, sf)).select("doc_id", "rule_id", *long(*SPAN), "words")


_VARIANT_HITS = (D.arabic(), D.tokens("ar"), D.lexicon("l", "grp, form", R.VARIANTS), f"vh AS (SELECT doc_id, grp AS rule_id, start, stop, piece AS surface FROM t JOIN l ON form = {D.normalize('piece', 'lookup')} WHERE kind = 'arabic')")


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    groups = spark.createDataFrame(R.VARIANTS, "rule_id string, form string")
    t = tokens(arabic(spark, sf)).where("kind = 'arabic'").withColumn("form", normalize(F.col("piece"), "lookup"))
    return t.join(F.broadcast(groups), "form").select("doc_id", "rule_id", *long(*SPAN), F.col("piece").alias("surface"))


@query(D.sql(*_VARIANT_HITS, "n AS (SELECT doc_id, rule_id FROM vh GROUP BY ALL HAVING count(DISTINCT surface) >= 2)", "SELECT vh.* FROM vh JOIN n USING (doc_id, rule_id) WHERE surface <> CASE rule_id WHEN 'now' THEN 'الآن' WHEN 'responsible' THEN 'المسؤول' WHEN 'city' THEN 'المدينة' END"))
def doc_rule_consistency(spark, sf):
    return document_rules.consistency(_variants(spark, sf), {"now": "الآن", "responsible": "المسؤول", "city": "المدينة"})


@query(D.sql(D.arabic(), D.hits(), "c AS (SELECT doc_id, rule_id, start, stop, count(*) OVER (PARTITION BY doc_id, rule_id) AS n, row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY start, stop) AS k FROM h)", "SELECT doc_id, rule_id, start, stop, n FROM c WHERE n >= 2 AND k = 1"))
def doc_rule_occurrence(spark, sf):
    hits = rules.literal_hits(arabic(spark, sf), rules.rule_table(spark)).select("doc_id", "rule_id", *long(*SPAN))
    return document_rules.occurrence(hits)


_SUPPRESSED = ("su AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'rule' WHEN 1 THEN 'word' WHEN 2 THEN 'line' ELSE 'document' END AS kind, CASE doc_id % 4 WHEN 0 THEN 'HAMZA_TO' WHEN 1 THEN 'لاكن' WHEN 2 THEN '1' ELSE '' END AS value FROM ar WHERE doc_id % 3 <> 0)",)


@query(D.sql(D.arabic(), D.hits(), *_SUPPRESSED, f"SELECT h.doc_id, h.rule_id, h.start, h.stop FROM h JOIN ar USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM su WHERE su.doc_id = h.doc_id AND CASE su.kind WHEN 'document' THEN true WHEN 'rule' THEN value = rule_id WHEN 'word' THEN value = {D.normalize('substr(ar.text, h.start + 1, h.stop - h.start)', 'lookup')} ELSE value = '1' END)"))
def suppressed_rules(spark, sf):
    ar = arabic(spark, sf)
    k = F.col("doc_id") % 4
    su = ar.where("doc_id % 3 <> 0").select("doc_id", F.when(k == 0, "rule").when(k == 1, "word").when(k == 2, "line").otherwise("document").alias("kind"), F.when(k == 0, "HAMZA_TO").when(k == 1, "لاكن").when(k == 2, "1").otherwise("").alias("value"))
    return document_rules.suppress(rules.literal_hits(ar, rules.rule_table(spark)), ar, su).select("doc_id", "rule_id", *long(*SPAN))


@query(D.sql(D.arabic(), D.hits("autofix"), D.resolved(), "e AS (SELECT DISTINCT r.doc_id, r.start, r.stop, suggestion FROM r JOIN h USING (doc_id, start, stop, rule_id))", "g AS (SELECT e.*, text, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS pos FROM e JOIN ar USING (doc_id))", "c AS (SELECT doc_id, string_agg(substr(text, pos + 1, start - pos) || suggestion, '' ORDER BY start) AS head, max(stop) AS pos FROM g GROUP BY doc_id)", "SELECT ar.doc_id, coalesce(head || substr(text, pos + 1), text) AS text FROM ar LEFT JOIN c USING (doc_id)"))
def corrected_text(spark, sf):
    ar = arabic(spark, sf)
    return document_rules.correct(ar, spans.resolve(rules.literal_hits(ar, rules.rule_table(spark)).where("autofix")))


@query("WITH c AS (SELECT doc_id, [lang, source, quality::VARCHAR] AS replacements, CASE doc_id % 3 WHEN 0 THEN ['en'] WHEN 1 THEN ['src1', '1'] ELSE ['none'] END AS accepted FROM labels JOIN documents USING (doc_id)), r AS (SELECT list_min(list_filter(list_transform(accepted, lambda a: coalesce(list_position(replacements, a), 0)), lambda p: p > 0)) AS r FROM c) SELECT round(coalesce(avg(coalesce(1 / r, 0)), 1), 6)::DOUBLE AS mrr, count(*)::BIGINT AS cases FROM r")
def eval_mrr(spark, sf):
    k = F.col("doc_id") % 3
    lists = lambda *x: F.array(*map(F.lit, x))
    cases = table(spark, sf, "labels").join(docs(spark, sf), "doc_id").select(F.array("lang", "source", F.col("quality").cast("string")).alias("replacements"), F.when(k == 0, lists("en")).when(k == 1, lists("src1", "1")).otherwise(lists("none")).alias("accepted"))
    return document_rules.reciprocal_rank(cases)


@query("WITH r AS (SELECT DISTINCT user_id AS doc, (epoch_us(ts) // 1000)::BIGINT AS ms, event_id AS seq FROM events WHERE event_type <> 'click'), d AS (SELECT DISTINCT 'p' || (user_id % 2)::VARCHAR AS peer, user_id AS doc, 1706000000000::BIGINT AS ms FROM events) SELECT peer, r.doc, r.ms, r.seq FROM r JOIN d ON r.doc = d.doc WHERE (r.ms, r.seq) > (d.ms, 0)")
def undelivered(spark, sf):
    e = table(spark, sf, "events")
    r = e.select(F.col("user_id").alias("doc"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_id").alias("seq"), F.col("event_type").alias("origin"))
    d = e.select(F.concat(F.lit("p"), F.col("user_id") % 2).alias("peer"), F.col("user_id").alias("doc"), F.lit(1706000000000).alias("ms"), F.lit(0).cast("long").alias("seq")).distinct()
    return stateful.undelivered(r, d, "click")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS since, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def event_windows(spark, sf):
    return stateful.windows(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.date_format("since", "yyyy-MM-dd").alias("since"), "event_type", "n")


@query()
def token_bucket(spark, sf):
    """A stream over the events as they lie in the file, played to its end."""
    e = stateful.stream_of(table(spark, sf, "events"), f"{sf}/event[s].parquet")
    return stateful.played(stateful.token_bucket(e.select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))))


@query()
def consistency_tracker(spark, sf):
    """A stream over the documents; the chunks of a conversation are the Arabic texts of ten ids."""
    d = stateful.stream_of(docs(spark, sf), f"{sf}/document[s].parquet")
    return stateful.played(stateful.consistency_tracker(arabic_of(d).select(F.floor(F.col("doc_id") / 10).alias("conv_id"), F.col("doc_id").alias("turn"), "text")))


@query()
def spell_suggestions(spark, sf):
    """Arabic texts in which every fiftieth document has one letter dropped."""
    ar = arabic(spark, sf)
    slip = F.concat(F.substring("text", F.lit(1), (F.col("doc_id") % 40 + 3).cast("int")), F.substring("text", (F.col("doc_id") % 40 + 5).cast("int"), F.char_length("text")))
    return spelling.suggestions(ar.withColumn("text", F.when(F.col("doc_id") % 50 == 0, slip).otherwise(F.col("text"))), morphology.lexemes(spark))


_BEFORE = "substr(text, 1, start)"


@query(D.sql(D.arabic(), D.hits(), f"SELECT h.doc_id, rule_id, start, stop, (length({_BEFORE}) - length(replace({_BEFORE}, chr(10), '')))::BIGINT AS line, length(string_split({_BEFORE}, chr(10))[-1])::BIGINT + length(regexp_replace(string_split({_BEFORE}, chr(10))[-1], '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))::BIGINT AS col, substr(text, greatest(start - 20, 0) + 1, stop + 20 - greatest(start - 20, 0)) AS context, (start - greatest(start - 20, 0))::BIGINT AS context_offset FROM h JOIN ar USING (doc_id)"))
def match_responses(spark, sf):
    ar = arabic(spark, sf)
    hits = rules.literal_hits(ar, rules.rule_table(spark)).select("doc_id", "rule_id", *long(*SPAN))
    return serving.context(serving.positions(hits, ar), ar)


@query(D.sql(D.arabic(), "SELECT doc_id, translate(text, '٠١٢٣٤٥٦٧٨٩', '0123456789') AS text FROM ar"))
def western_digits(spark, sf):
    return arabic(spark, sf).select("doc_id", serving.to_western(F.col("text")).alias("text"))


@query(D.sql(D.arabic(), D.tokens("ar"), "SELECT doc_id, idx, piece, CASE WHEN suffix(piece, 'ون') OR suffix(piece, 'ان') THEN left(piece, length(piece) - 2) || 'ين' ELSE piece END AS oblique FROM t WHERE kind = 'arabic'"))
def oblique_forms(spark, sf):
    return tokens(arabic(spark, sf)).where("kind = 'arabic'").select("doc_id", *long("idx"), "piece", serving.oblique(F.col("piece")).alias("oblique"))


@query("SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*)::BIGINT AS docs, sum(length(text))::BIGINT AS chars, count(DISTINCT md5(text))::BIGINT AS texts FROM documents GROUP BY GROUPING SETS ((), (lang), (source))")
def corpus_manifest(spark, sf):
    return serving.manifest(docs(spark, sf), "lang", "source")


@query("WITH a AS (SELECT user_id AS doc, max(event_id) AS upto FROM events WHERE event_id % 20 = 0 GROUP BY ALL) SELECT user_id AS doc, event_id AS seq FROM events LEFT JOIN a ON a.doc = user_id WHERE upto IS NULL OR event_id > upto")
def compacted_updates(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("seq"))
    return serving.compacted(e, e.where("seq % 20 = 0"))


@query("WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events) SELECT * FROM r WHERE nth <= 5")
def latest_history(spark, sf):
    return serving.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", 5)


@query("WITH s AS (SELECT user_id, event_type, count(*)::DOUBLE AS score FROM events GROUP BY ALL), e AS (SELECT *, exp((score - max(score) OVER (PARTITION BY user_id)) / 0.82) AS e FROM s) SELECT user_id, event_type, score, round(e / sum(e) OVER (PARTITION BY user_id), 5) AS prob FROM e")
def softmax_rank(spark, sf):
    s = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return serving.softmax(s, "user_id", "score")


from warraq.plans import language, reports  # noqa: E402, F401  their queries register themselves
