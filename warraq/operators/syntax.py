"""Relations of adjacent words, the cases they give, and agreement checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from warraq.functions import resources as R
from warraq.functions.text import normalize, tokens
from warraq.operators.morphology import best

#: Kinds of tokens that part two words; numbers, Latin words, hashtags and mentions do not.
BARRIERS = ("punctuation", "symbol", "code", "url", "email")
FEATURES = ("lemma", "pos", "gender", "number", "definite", "preposition", "tense", "sure")
LEAST = 0.8
#: Case that a relation gives its dependent, in the order in which ties are decided: the last wins.
CASES = {"DEMONSTRATIVE": "follows", "IDAFA": "genitive", "JUSSIVE_VERB": "jussive", "NAAT": "follows", "PREPOSITION_OBJECT": "genitive", "SUBJECT": "nominative", "SUBJUNCTIVE_VERB": "subjunctive"}


def parsed(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Arabic words with their best analysis (null where none is sure enough) and ``apart``, the barriers before them.

    Words are analysed once each, however often they occur.
    """
    order = Window.partitionBy("doc_id").orderBy("idx")
    t = tokens(docs).withColumn("apart", F.sum(F.col("kind").isin(*BARRIERS).cast("long")).over(order)).where("kind = 'arabic'")
    t = t.select("doc_id", "idx", "start", "stop", "piece", "apart", normalize(F.col("piece"), "lookup").alias("form"))
    return t.join(best(t.select("form").distinct(), lexicon).select("form", *FEATURES), "form", "left")


def pairs(words: DataFrame) -> DataFrame:
    """Each word with the next one of its document, ``r`` null where a barrier parts them."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    following = F.lead(F.struct("idx", "start", "stop", "piece", "form", "apart", *FEATURES)).over(order)
    return words.withColumn("r", following).withColumn("r", F.when(F.col("r.apart") == F.col("apart"), F.col("r")))


def _sure(structural: float, *tokens_: Column) -> Column:
    """Confidence of a relation; an unanalysed token counts as nothing."""
    least = F.least(*(F.coalesce(t, F.lit(0.0)) for t in tokens_)) if len(tokens_) > 1 else tokens_[0]
    return F.round(F.least(F.lit(0.999), F.lit(structural * 0.55) + least * 0.45), 6)


def relations(p: DataFrame) -> DataFrame:
    """``doc_id, relation, head, dependent, confidence`` of pairs() and the words' spans and features.

    Function words count as certain. A preposition within a word has no head.
    """
    nominal = lambda c: F.col(c).isin("noun", "verbal_noun")
    word, after, verb = F.col("sure"), F.col("r.sure"), F.col("r.pos") == "verb"
    near = F.col("r").isNotNull()
    one = lambda name, when, sure, head=F.col("idx"), dependent=F.col("r.idx"): F.when(when, F.struct(F.lit(name).alias("relation"), head.cast("long").alias("head"), dependent.cast("long").alias("dependent"), sure.alias("confidence")))
    found = F.array(
        one("DEMONSTRATIVE", near & F.col("form").isin([d for d, _, _ in R.DEMONSTRATIVES]) & nominal("r.pos"), _sure(0.98, after)),
        one("PREPOSITION_OBJECT", near & F.col("form").isin(*R.PREPOSITIONS) & F.col("r.pos").isin("noun", "verbal_noun", "adjective"), _sure(0.97, after)),
        one("SUBJUNCTIVE_VERB", near & F.col("form").isin(*R.SUBJUNCTIVE_PARTICLES) & verb, _sure(0.96, after)),
        one("JUSSIVE_VERB", near & F.col("form").isin(*R.JUSSIVE_PARTICLES) & verb, _sure(0.97, after)),
        one("NAAT", near & nominal("pos") & (F.col("r.pos") == "adjective") & F.col("definite") & F.col("r.definite"), _sure(0.94, word, after)),
        one("IDAFA", near & nominal("pos") & nominal("r.pos") & ~F.col("definite") & F.col("r.definite"), _sure(0.91, word, after)),
        one("SUBJECT", near & F.col("lemma").isin(*R.INTRANSITIVE) & (F.col("pos") == "verb") & nominal("r.pos"), _sure(0.93, word, after)),
        one("SUBJECT", near & nominal("pos") & F.col("definite") & verb, _sure(0.88, word, after), F.col("r.idx"), F.col("idx")),
        one("PREPOSITION_OBJECT", nominal("pos") & (F.col("preposition") != ""), F.round(F.least(F.lit(0.97), word + 0.04), 6), F.lit(None), F.col("idx")),
    )
    rows = p.withColumn("x", F.explode(F.filter(found, lambda x: x.isNotNull())))
    return rows.select(*p.columns, "x.*")


def cases(rels: DataFrame) -> DataFrame:
    """The case of each dependent from its surest relation; of equally sure ones the last by name."""
    top = rels.groupBy("doc_id", "dependent").agg(F.max(F.struct("confidence", "relation", "head")).alias("m"))
    case = F.create_map(*[F.lit(x) for kv in CASES.items() for x in kv])[F.col("m.relation")]
    return top.select("doc_id", "dependent", "m.relation", "m.head", "m.confidence", case.alias("case"))


def parse_confidence(words: DataFrame, rels: DataFrame) -> DataFrame:
    """By document 0.72 of the mean confidence of its words and 0.28 of that of its relations, of the words where it has none."""
    w = words.groupBy("doc_id").agg(F.avg(F.coalesce("sure", F.lit(0.0))).alias("w"), F.count(F.lit(1)).alias("words"))
    r = rels.groupBy("doc_id").agg(F.avg("confidence").alias("r"), F.count(F.lit(1)).alias("relations"))
    return w.join(r, "doc_id", "left").select("doc_id", "words", F.coalesce("relations", F.lit(0)).alias("relations"), F.round(F.col("w") * 0.72 + F.coalesce("r", "w") * 0.28, 5).alias("confidence"))


def checks(rels: DataFrame) -> DataFrame:
    """Matches where the forms of a sure relation disagree: ``doc_id, rule_id, start, stop, suggestion``."""
    r = lambda c: F.col(f"r.{c}")
    demo = {d: (g, [x for x, g2, far2 in R.DEMONSTRATIVES if far2 == far and g2 != g][0]) for d, g, far in R.DEMONSTRATIVES}
    gender = F.create_map(*[F.lit(x) for d, (g, _) in demo.items() for x in (d, g)])[F.col("form")]
    other = F.create_map(*[F.lit(x) for d, (_, o) in demo.items() for x in (d, o)])[F.col("form")]
    is_ = lambda *names: F.col("relation").isin(*names)
    hit = lambda when, rule, start, stop, to: F.when(when, F.struct(F.lit(rule).alias("rule_id"), start.cast("long").alias("start"), stop.cast("long").alias("stop"), to.alias("suggestion")))
    single = r("number") == "singular"
    cut = lambda c, n: F.substring(c, F.lit(1), F.char_length(c) - n)
    feminine = F.when(r("piece").endswith("ة"), cut(r("piece"), 1)).otherwise(F.concat(r("piece"), F.lit("ة")))
    found = F.array(
        hit(is_("DEMONSTRATIVE") & single & (gender != r("gender")), "SYNTAX_DEMONSTRATIVE_AGREEMENT", F.col("start"), r("stop"), F.concat(other, F.lit(" "), r("piece"))),
        hit(is_("NAAT") & (F.col("number") == "singular") & single & (F.col("gender") != r("gender")), "SYNTAX_NAAT_AGREEMENT", r("start"), r("stop"), feminine),
        hit(is_("SUBJECT") & (F.col("pos") == "verb") & (F.col("tense") == "past") & single & (F.col("gender") == "masculine") & (r("gender") == "feminine"), "SYNTAX_VERB_SUBJECT_GENDER", F.col("start"), F.col("stop"), F.concat("piece", F.lit("ت"))),
        hit(is_("PREPOSITION_OBJECT") & F.col("head").isNotNull() & (r("number") != "singular") & (r("piece").endswith("ون") | r("piece").endswith("ان")), "SYNTAX_PREPOSITION_CASE", r("start"), r("stop"), F.concat(cut(r("piece"), 2), F.lit("ين"))),
        hit(is_("SUBJUNCTIVE_VERB", "JUSSIVE_VERB") & r("piece").endswith("ون"), "SYNTAX_FIVE_VERBS", r("start"), r("stop"), F.concat(cut(r("piece"), 1), F.lit("ا"))),
        hit(is_("IDAFA") & (F.col("number") != "singular") & (F.col("piece").endswith("ون") | F.col("piece").endswith("ين") | F.col("piece").endswith("ان")), "SYNTAX_IDAFA_NUN_DROP", F.col("start"), F.col("stop"), cut(F.col("piece"), 1)),
    )
    rows = rels.where(F.col("confidence") >= LEAST).select("doc_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x"))
    return rows.select("doc_id", "x.*")
