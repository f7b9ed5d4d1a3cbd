"""Forms of a lexicon, and analyses of distinct words by lexicon and by templates of roots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from warraq.functions import resources as R

LEAST = 0.55
KEYS = ("lemma", "root", "pattern", "pos", "gender", "number", "definite", "preposition", "tense", "frequency", "confidence", "origin")


def template_regex(name: str) -> str:
    """The letters that stand for the root's become groups; the others are fixed."""
    return r"\A" + "".join("(.)" if c in "فعل" else c for c in name) + r"\z"


def lexemes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(R.LEXEMES, "lemma string, root string, pattern string, pos string, gender string, frequency int")


def forms(lexicon: DataFrame) -> DataFrame:
    """Every form of each lexeme with its features: ``form`` and KEYS. Affixes are small fixed tables, joined by gender or class."""
    spark = lexicon.sparkSession
    fixed = lambda rows, schema: F.broadcast(spark.createDataFrame(rows, schema))
    prefixes = fixed([(True, *p) for p in R.NOMINAL_PREFIXES], "nominal boolean, prefix string, definite boolean, preposition string")
    endings = fixed(R.NOMINAL_ENDINGS, "ending string, number string, gender string, tail string")
    verbal = fixed([("verb", *v) for v in R.VERB_AFFIXES], "pos string, prefix string, ending string, gender string, number string, tense string")
    confidence = F.round(0.98 - F.when(F.col("prefix") != "", 0.02).otherwise(0.0) - F.when(F.col("ending") != "", 0.03).otherwise(0.0), 6).alias("confidence")
    origin = F.lit("lexicon").alias("origin")
    # a prefixed noun's bare stem keeps its last letter unless that is the feminine one
    stem = F.when(F.col("lemma").endswith("ة"), F.concat(F.expr("left(lemma, char_length(lemma) - 1)"), F.col("tail"))).otherwise(F.col("lemma"))
    nouns = lexicon.where("pos <> 'verb'").withColumn("nominal", F.lit(True)).join(prefixes, "nominal").join(endings, "gender")
    nouns = nouns.select(F.concat("prefix", stem, "ending").alias("form"), "lemma", "root", "pattern", "pos", "gender", "number", "definite", "preposition", F.lit("").alias("tense"), "frequency", confidence, origin)
    verbs = lexicon.where("pos = 'verb'").drop("gender").join(verbal, "pos")
    verbs = verbs.select(F.concat("prefix", "lemma", "ending").alias("form"), "lemma", "root", "pattern", "pos", "gender", "number", F.lit(False).alias("definite"), F.lit("").alias("preposition"), "tense", "frequency", confidence, origin)
    return nouns.unionByName(verbs)


def by_template(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Analyses of words by affixes and templates. A root of the lexicon adds 0.17; affixes cost 0.05, 0.06 or 0.10."""
    one = lambda xs: F.explode(F.array(*map(F.lit, xs)))
    cut = words.select("form", one(R.STEM_PREFIXES).alias("prefix")).where(F.col("form").startswith(F.col("prefix")))
    cut = cut.select("*", one(R.STEM_ENDINGS).alias("ending")).where(F.col("form").endswith(F.col("ending")))
    size = F.char_length("form") - F.char_length("prefix") - F.char_length("ending")
    cut = cut.where(size >= 3).withColumn("stem", F.substring("form", F.char_length("prefix") + 1, size))
    tried = F.array(*(F.when(F.col("stem").rlike(template_regex(n)), F.struct(F.lit(n).alias("pattern"), F.lit(pos).alias("pos"), F.lit(c).alias("base"), F.regexp_replace("stem", template_regex(n), "$1$2$3").alias("root"))) for n, pos, c in R.TEMPLATES))
    found = cut.select("form", "prefix", "ending", "stem", F.explode(F.filter(tried, lambda t: t.isNotNull())).alias("t")).select("form", "prefix", "ending", "stem", "t.*")
    known = lexicon.groupBy("root").agg(F.max("frequency").alias("frequency"))
    cost = F.when((F.col("prefix") != "") & (F.col("ending") != ""), 0.10).when(F.col("prefix") != "", 0.05).when(F.col("ending") != "", 0.06).otherwise(0.0)
    sure = F.col("base") + F.when(F.col("frequency").isNotNull(), 0.17).otherwise(0.0) - cost
    number = F.when(F.col("ending").isin("ات", "ون"), "plural").when(F.col("ending") == "ين", "dual").otherwise("singular")
    preposition = F.when(F.col("prefix").isin("ب", "بال"), "ب").when(F.col("prefix") == "ل", "ل").otherwise("")
    return found.join(F.broadcast(known), "root", "left").select(
        "form", F.col("stem").alias("lemma"), "root", "pattern", "pos", F.when(F.col("stem").endswith("ة") | (F.col("ending") == "ات"), "feminine").otherwise("masculine").alias("gender"), number.alias("number"),
        F.col("prefix").endswith("ال").alias("definite"), preposition.alias("preposition"), F.when(F.col("pattern") == "يفعل", "present").when(F.col("pos") == "verb", "past").otherwise("").alias("tense"),
        F.coalesce("frequency", F.lit(1)).alias("frequency"), F.round(F.greatest(F.lit(0.25), F.least(F.lit(0.86), sure)), 6).alias("confidence"), F.lit("template").alias("origin"),
    )


def analyses(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Ranked analyses of ``words(form)``, which should be distinct; the lexicon is a resource and is broadcast.

    Equal (lemma, root, pattern, part of speech, features) are one analysis, the surest of them. Words
    that nothing explains have none.
    """
    every = words.select("form").join(F.broadcast(forms(lexicon)), "form").unionByName(by_template(words, lexicon))
    same = [k for k in KEYS if k not in ("frequency", "confidence", "origin")]
    merged = every.groupBy("form", *same).agg(F.max(F.struct("confidence", "frequency", "origin")).alias("m")).select("form", *same, "m.*")
    order = Window.partitionBy("form").orderBy(F.desc("confidence"), F.desc("frequency"), *same)
    ranked = merged.withColumns({"rank": F.row_number().over(order).cast("long"), "second": F.lead("confidence").over(order)})
    return ranked.withColumn("margin", F.round(F.when(F.col("rank") == 1, F.coalesce(F.col("confidence") - F.col("second"), F.lit(0.3))), 6)).drop("second")


def best(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The first analysis of each word that is sure enough; its token confidence also weighs the margin."""
    sure = F.round(F.least(F.lit(0.999), F.col("confidence") * 0.82 + F.least(F.lit(0.18), F.col("margin") * 0.6)), 6)
    return analyses(words, lexicon).where((F.col("rank") == 1) & (F.col("confidence") >= LEAST)).withColumn("sure", sure)


def by_root(lexicon: DataFrame, root: str) -> DataFrame:
    """Lexemes of a root, the most frequent first."""
    return lexicon.where(F.col("root") == root).orderBy(F.desc("frequency"), "lemma")


def forms_of(lexicon: DataFrame, lemma: str, pos: str | None = None, **features) -> DataFrame:
    """Forms of a lemma that have the features asked for, as ``number="plural"``, the surest first."""
    rows = forms(lexicon).where(F.col("lemma") == lemma)
    for name, value in {"pos": pos, **features}.items():
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows.orderBy(F.desc("confidence"), "form")
