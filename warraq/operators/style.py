"""Style and meaning over parsed words: light verbs, dense sentences, contradictions, chips, explanations, personal weight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from warraq.functions import resources as R
from warraq.functions.text import normalize, tokens
from warraq.operators.morphology import best
from warraq.operators.syntax import FEATURES

#: Why a category of match matters.
WHY = {"spelling": "correctness", "grammar": "correctness", "punctuation": "readability", "style": "clarity", "dialect": "register", "semantics": "consistency"}
MARKS = r"[.!?؟؛…]"


def sentence_words(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Arabic words with their analysis, the number ``sent`` of terminators and line ends before them, and their place in that stretch."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    ends = ((F.col("kind") == "punctuation") & F.col("piece").rlike(MARKS)) | ((F.col("kind") == "whitespace") & F.col("piece").contains("\n"))
    t = tokens(docs).withColumn("sent", F.sum(ends.cast("long")).over(order)).where("kind = 'arabic'")
    t = t.select("doc_id", "sent", "idx", "start", "stop", "piece", normalize(F.col("piece"), "lookup").alias("form"))
    t = t.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "sent").orderBy("idx")))
    return t.join(best(t.select("form").distinct(), lexicon).select("form", *FEATURES), "form", "left")


def light_verbs(pairs: DataFrame) -> DataFrame:
    """A form of «do» with a verbal noun behind a preposition, and the verb for both, in the auxiliary's gender and number."""
    fixed = pairs.sparkSession.createDataFrame([(p + a, p, g, n, dict(zip(("masculine", "feminine", "plural"), v, strict=True))[g]) for a, g in R.AUXILIARIES for p in ("", "و", "ف") for n, *v in R.NOMINALIZATIONS], "form string, conj string, person string, noun string, verb string")
    hit = pairs.where((F.col("r.pos") == "verbal_noun") & (F.col("r.preposition") != "")).withColumn("noun", F.col("r.lemma")).join(F.broadcast(fixed), ["form", "noun"])
    sure = F.round(F.least(F.coalesce("sure", F.lit(0.85)), F.col("r.sure")) * 0.9, 6)
    return hit.select("doc_id", F.lit("STYLE_LIGHT_VERB_NOMINALIZATION").alias("rule_id"), "start", F.col("r.stop").alias("stop"), F.concat("conj", "verb").alias("suggestion"), sure.alias("confidence"))


def dense_sentences(words: DataFrame, least_words: int = 24, least_nouns: int = 4, least_links: int = 2) -> DataFrame:
    """Stretches of sentence_words() with many verbal nouns and connectives and few verbs; the span is 48 code points at most."""
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    link = F.col("form").isin(*R.CONNECTIVES) | ((F.char_length("form") > 2) & (F.col("form").startswith("و") | F.col("form").startswith("ف")))
    per = words.groupBy("doc_id", "sent").agg(F.count(F.lit(1)).alias("words"), count(F.col("pos") == "verbal_noun").alias("nouns"), count(F.col("pos") == "verb").alias("verbs"), count(link).alias("links"), F.min("start").alias("start"), F.max("stop").alias("end"))
    hit = per.where((F.col("words") >= least_words) & (F.col("nouns") >= least_nouns) & (F.col("nouns") > F.col("verbs") * 2) & (F.col("links") >= least_links))
    return hit.select("doc_id", F.lit("STYLE_NOMINALIZATION_DENSITY").alias("rule_id"), "start", F.least("end", F.col("start") + 48).alias("stop"), "words", "nouns", "links")


def contradictions(words: DataFrame, reach: int = 8) -> DataFrame:
    """A verb that is negated within eight words after the same verb, with no word of time between.

    One window over the words of a stretch and one over the verbs of a lemma in it; no join.
    """
    within = Window.partitionBy("doc_id", "sent").orderBy("place")
    bare = F.when((F.char_length("form") > 2) & F.substring("form", 1, 1).isin("و", "ف"), F.expr("substring(form, 2)")).otherwise(F.col("form"))
    rows = words.withColumns({"negated": F.lag(bare.isin(*R.NEGATORS), 1, False).over(within), "from": F.lag("start").over(within), "timed": F.max(F.when(F.col("form").isin(*R.TEMPORAL), F.col("place"))).over(within)})
    verbs = rows.where("pos = 'verb'").withColumn("earlier", F.lag("place").over(Window.partitionBy("doc_id", "sent", "lemma").orderBy("place")))
    hit = F.col("negated") & (F.col("place") - 1 - F.col("earlier") <= reach) & (F.coalesce("timed", F.lit(0)) <= F.col("earlier"))
    return verbs.where(hit).select("doc_id", F.lit("SEMANTIC_EXPLICIT_SELF_CONTRADICTION").alias("rule_id"), F.col("from").alias("start"), "stop", "lemma", F.round(F.least(F.lit(0.985), "sure"), 6).alias("confidence"))


def explanations(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """Matches ``doc_id, rule_id, category, start, stop, autofix`` with their source text, why they matter and who decides."""
    why = F.create_map(*[F.lit(x) for kv in WHY.items() for x in kv])[F.col("category")]
    rows = matches.join(docs.select("doc_id", "text"), "doc_id")
    source = F.substring("text", F.col("start").cast("int") + 1, (F.col("stop") - F.col("start")).cast("int"))
    return rows.select("doc_id", "rule_id", "start", "stop", source.alias("source"), F.coalesce(why, F.lit("transparency")).alias("why"), F.when(F.col("autofix"), "safe_autofix").otherwise("review_required").alias("decision"))


def personalized(matches: DataFrame, drift: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Matches of style get a tag and one step of priority by how far their document is from its author's voice.

    ``drift(doc_id, drift, reliable)``; documents that are missing there or unreliable keep their matches as they are.
    """
    rows = matches.join(drift.select("doc_id", "drift", "reliable"), "doc_id", "left")
    touched = (F.col("category") == "style") & F.coalesce("reliable", F.lit(False))
    far = F.col("drift") >= threshold
    tag = F.when(touched, F.when(far, "voice:divergent").otherwise("voice:aligned"))
    step = F.when(touched, F.when(far, 1).otherwise(-1)).otherwise(0)
    return rows.withColumns({"tag": tag, "priority": (F.col("priority") + step).cast("int")}).drop("drift", "reliable")


def chips(tone: DataFrame) -> DataFrame:
    """Target registers ranked by relevance for ``doc_id, tone, dialect_signal``."""
    among = lambda *names: F.col("tone").isin(*names)
    of = {
        "academic": F.when(among("conversational", "neutral"), 0.92).otherwise(0.70),
        "formal": F.greatest(F.lit(0.68), F.least(F.lit(0.98), 0.72 + F.col("dialect_signal") * 0.24)),
        "casual": F.when(among("formal", "objective"), 0.82).otherwise(0.64),
        "persuasive": F.when(among("persuasive"), 0.55).otherwise(0.86),
    }
    rows = tone.select("doc_id", F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.round(c, 6).alias("relevance")) for t, c in of.items()))).alias("c")).select("doc_id", "c.*")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("relevance"), "target")).cast("long"))


TONES = ("assertive", "conversational", "formal", "objective", "persuasive")
BASE, NEUTRAL = 180, 1000


def toned(sums: DataFrame, *keys: str) -> DataFrame:
    """``keys, tone, confidence`` of rows with one sum of thousandths by tone; ties go to the first name.

    Each tone has 0.18 and its words' weights, neutral has 1. Confidence is the first share and half its lead.
    """
    of = F.array_sort(F.array(*(F.struct((-(F.col(t) + BASE)).alias("s"), F.lit(t).alias("tone")) for t in TONES), F.struct(F.lit(-NEUTRAL).cast("long").alias("s"), F.lit("neutral").alias("tone"))))
    total = sum((F.col(t) for t in TONES), F.lit(NEUTRAL + BASE * len(TONES)))
    rows = sums.withColumns({"of": of, "total": total})
    first, second = -F.col("of")[0]["s"] / F.col("total"), -F.col("of")[1]["s"] / F.col("total")
    return rows.select(*keys, F.col("of")[0]["tone"].alias("tone"), F.round(F.least(F.lit(0.999), first + (first - second) * 0.5), 6).alias("confidence"))


def tone_shifts(words: DataFrame, least_sentences: int = 3, steady: float = 0.38, least: float = 0.48, share: float = 0.6) -> DataFrame:
    """Conversational stretches of sentence_words() in documents that are formal or objective for the most part."""
    lex = F.broadcast(words.sparkSession.createDataFrame([(t, f, round(w * 1000)) for t, f, w in R.TONE_WORDS], "tone string, form string, w long"))
    weighed = words.select("doc_id", "sent", "start", "stop", "form").join(lex, "form", "left")
    each = [F.coalesce(F.sum(F.when(F.col("tone") == t, F.col("w"))), F.lit(0)).alias(t) for t in TONES]
    per = weighed.groupBy("doc_id", "sent").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), *each)
    whole = toned(per.groupBy("doc_id").agg(*(F.sum(t).alias(t) for t in TONES)), "doc_id").select("doc_id", F.col("tone").alias("of_all"), F.col("confidence").alias("all_confidence")).where(F.col("of_all").isin("formal", "objective"))
    rows = toned(per, "doc_id", "sent", "start", "stop").join(whole, "doc_id")
    by = Window.partitionBy("doc_id")
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(by), "like": F.count_if((F.col("tone") == F.col("of_all")) & (F.col("confidence") >= steady)).over(by)})
    hit = (F.col("n") >= least_sentences) & (F.col("like") >= F.greatest(F.lit(2), F.ceil(F.col("n") * share))) & (F.col("tone") == "conversational") & (F.col("confidence") >= least)
    return rows.where(hit).select("doc_id", F.lit("STYLE_TONE_SHIFT").alias("rule_id"), "start", F.least("stop", F.col("start") + 48).alias("stop"), F.round(F.least("confidence", "all_confidence") * 0.9, 6).alias("confidence"))
