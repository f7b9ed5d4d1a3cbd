"""Document and corpus measures: readability, vocabulary, fingerprints, author profiles, dialect, tone, consistency."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from warraq.functions.resources import DIALECT_FORMS, TONE_WORDS, VARIANTS
from warraq.functions.scan import bare, rows_of, tokens_of, words_of
from warraq.functions.text import normalize, tokens
from warraq.operators.sentences import measured as sentence_measures
from warraq.operators.sentences import split_sentences

ENDS, PARAGRAPH = re.compile(r"[.!?؟؛…]"), re.compile(r"[^\n]+")


def six(x: Column) -> Column:
    return F.round(x.cast("double"), 6)


def clamp(x: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))


def words(docs: DataFrame) -> DataFrame:
    """Arabic and Latin word tokens with their lookup form."""
    return rows_of(docs, lambda text: ((i, *w) for i, w in enumerate(words_of(text))), "idx int, piece string, start long, stop long, form string")


#: Whole numbers by document, all from one pass over its tokens: words, their letters without marks, those of eight or more, and those that
#: repeat the one before; distinct words and those that occur once; sentences; letters of the pieces, and squares of these; numbers,
#: runs of marks, those that begin with a comma; words of each stretch between terminators or line ends.
MEASURES = (
    "words long, chars long, long_words long, repeats long, types long, hapax long, sentences long, piece_chars long, piece_chars_sq long, "
    "numbers long, marks long, commas long, stretches array<int>"
)


def measured(text: str) -> tuple:
    forms: Counter[str] = Counter()
    chars = long_words = repeats = pieces = squares = numbers = marks = commas = here = 0
    before, stretches = None, []
    for piece, _, _, kind in tokens_of(text):
        if kind in ("arabic", "latin"):
            form = bare(piece).lower()
            forms[form] += 1
            size = len(form)
            chars, long_words, repeats = chars + size, long_words + (size >= 8), repeats + (form == before)
            pieces, squares = pieces + len(piece), squares + len(piece) ** 2
            before, here = form, here + 1
            continue
        numbers += kind == "number"
        marks += kind == "punctuation"
        commas += piece[0] in "،,"
        if here and ((kind == "punctuation" and ENDS.search(piece)) or (kind == "whitespace" and "\n" in piece)):
            stretches.append(here)
            here = 0
    if here:
        stretches.append(here)
    hapax = sum(n == 1 for n in forms.values())
    return forms.total(), chars, long_words, repeats, len(forms), hapax, len(split_sentences(text)), pieces, squares, numbers, marks, commas, stretches


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id``, the columns to keep and MEASURES: one row per document, without a shuffle."""
    return rows_of(docs, lambda text: (measured(text),), MEASURES, *keep)


def readability(docs: DataFrame, *keep: str) -> DataFrame:
    """Clarity by document over word tokens and sentences, of which there is one at least."""
    return readable(measures(docs, *keep), *keep)


def readable(out: DataFrame, *keep: str) -> DataFrame:
    n, sentences = F.nullif("words", F.lit(0)), F.greatest(F.lit(1), F.col("sentences"))
    avg_words, avg_chars, long_ratio = F.col("words") / sentences, F.coalesce(F.col("chars") / n, F.lit(0.0)), F.coalesce(F.col("long_words") / n, F.lit(0.0))
    repeated = F.col("repeats") / F.greatest(F.lit(1), F.col("words") - 1)
    penalty = F.greatest(F.lit(0.0), avg_words - 14.0) * 1.35 + F.greatest(F.lit(0.0), avg_chars - 5.5) * 4.0 + long_ratio * 22.0 + repeated * 35.0
    clarity = F.when(F.col("words") == 0, 100.0).otherwise(clamp(100.0 - penalty))
    band = F.when(clarity >= 82, "clear").when(clarity >= 65, "moderate").when(clarity >= 45, "dense").otherwise("very_dense")
    return out.select("doc_id", *keep, "words", sentences.cast("long").alias("sentences"), six(avg_words).alias("avg_words"), six(avg_chars).alias("avg_chars"), six(long_ratio).alias("long_ratio"), six(repeated).alias("repeated_ratio"), six(clarity).alias("clarity"), band.alias("band"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """Types, type-token ratio and words that occur once, by document that has words."""
    per = measures(docs).where("words > 0")
    return per.select("doc_id", F.col("words").alias("tokens"), "types", "hapax", six(F.col("types") / F.col("words")).alias("ttr"), six(F.col("hapax") / F.col("types")).alias("hapax_ratio"))


def document_analytics(docs: DataFrame) -> DataFrame:
    """Size, reading time at 180 and speaking time at 130 words a minute."""

    def found(text: str) -> Iterator[tuple]:
        yield len(text), len(PARAGRAPH.findall(text)), text.count("?") + text.count("؟"), len(words_of(text))

    out = rows_of(docs, found, "characters long, paragraphs long, questions long, words long")
    return out.select("*", F.ceil(F.col("words") * 60 / 180).cast("long").alias("reading_s"), F.ceil(F.col("words") * 60 / 130).cast("long").alias("speaking_s"))


def fingerprint(docs: DataFrame, *keys: str) -> DataFrame:
    """Scalar style features by document that has tokens, as whole counts so that sums of them are exact."""
    per = measures(docs.where(F.char_length("text") > 0), *keys)
    return per.select("doc_id", *keys, "words", F.col("piece_chars").alias("chars"), F.col("piece_chars_sq").alias("chars_sq"), "numbers", "marks", "commas")


FEATURES = {"word_length": ("chars", "words"), "number_share": ("numbers", "words"), "mark_share": ("marks", "words"), "comma_share": ("commas", "words")}


def features(prints: DataFrame, *keys: str) -> DataFrame:
    """``doc_id, feature, value`` rounded to whole millionths; documents without words are left out."""
    rows = F.array(*(F.struct(F.lit(f).alias("feature"), F.round(F.col(a) * 1000000 / F.col(b)).cast("long").alias("value")) for f, (a, b) in FEATURES.items()))
    return prints.where("words > 0").select("doc_id", *keys, F.explode(rows).alias("f")).select("doc_id", *keys, "f.*")


def moments(rows: DataFrame, *keys: str) -> DataFrame:
    """Mergeable sums by key and feature: n, sum and sum of squares, exact in decimals."""
    return rows.groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("s"), F.sum(F.col("value").cast("decimal(19,0)") * F.col("value").cast("decimal(19,0)")).cast("decimal(38,0)").alias("q"))


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy(*keys, "feature").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"), F.sum("q").cast("decimal(38,0)").alias("q"))


def fitted(sums: DataFrame) -> DataFrame:
    """Sums by feature as whole numbers of 64 bits; sums or squares of which any has more are decimals, as exact.

    The type depends on the values, so the few rows are worked out here. Squares pass 64 bits at some 360,000 documents, or by one word of 3,100 letters.
    """
    rows = sums.select("feature", "n", "s", "q").collect()
    wide = [any(not -(1 << 63) <= r[c] < 1 << 63 for r in rows) for c in ("s", "q")]
    s, q = ("decimal(38,0)" if w else "long" for w in wide)
    fit = [(r["feature"], r["n"], *(r[c] if w else int(r[c]) for c, w in zip(("s", "q"), wide))) for r in rows]
    return sums.sparkSession.createDataFrame(fit, f"feature string, n long, s {s}, q {q}")


def profile(sums: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of each feature from its sums."""
    n, s, q = F.col("n").cast("double"), F.col("s").cast("double") / 1e6, F.col("q").cast("double") / 1e12
    var = F.when(n > 1, F.greatest(F.lit(0.0), q - s * s / n) / (n - 1)).otherwise(0.0)
    return sums.withColumns({"mean": s / n, "std": F.sqrt(var)})


def drift(rows: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """Mean of z/(z+2) over the features of each document against its author's profile; spread of a tenth of the mean or 0.02 at least."""
    floor = F.greatest(F.abs("mean") * 0.1, F.lit(0.02))
    z = F.abs(F.col("value") / 1e6 - F.col("mean")) / F.greatest("std", floor)
    return rows.join(profiles.drop("n", "s", "q"), [key, "feature"]).groupBy("doc_id").agg(F.avg(z / (z + 2)).alias("drift"), F.count(F.lit(1)).alias("features"))


def dialect_hits(docs: DataFrame) -> DataFrame:
    forms = docs.sparkSession.createDataFrame(DIALECT_FORMS, "form string, dialect string, weight double")
    return tokens(docs).where("kind = 'arabic'").withColumn("form", normalize(F.col("piece"), "lookup")).join(F.broadcast(forms), "form").select("doc_id", "start", "stop", "form", "dialect", "weight")


def dialects(docs: DataFrame) -> DataFrame:
    """The dialect by document: 0.08 and the weights of its forms, each shared among its dialects; ties by name.

    A best score below 0.72, or a second of 0.48 and less than 0.3 behind, is ambiguous: the dialect is then mixed if the second
    has 0.35 or more. A text without such forms is standard.
    """
    hits = dialect_hits(docs)
    shared = hits.withColumn("labels", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "start")))
    scores = shared.groupBy("doc_id", "dialect").agg((F.sum(F.round(F.col("weight") / F.col("labels") * 1000).cast("long")) / 1000 + 0.08).alias("score"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "dialect"))
    second = F.coalesce(F.lead("score").over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "dialect")), F.lit(0.08))
    weight = F.sum("score").over(Window.partitionBy("doc_id")) - 0.08 * F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    top = scores.withColumns({"rank": rank, "second": second, "weight": weight}).where("rank = 1")
    every = docs.select("doc_id").join(top, "doc_id", "left")
    gap = F.col("score") - F.col("second")
    ambiguous = F.coalesce((F.col("score") < 0.72) | ((F.col("second") >= 0.48) & (gap < 0.3)), F.lit(False))
    sure = F.least(F.lit(0.995), 0.48 + F.least(F.lit(0.34), F.col("weight") * 0.11) + F.least(F.lit(0.17), gap * 0.22))
    sure = F.coalesce(F.when(ambiguous, F.least(F.lit(0.69), sure)).otherwise(sure), F.lit(0.995))
    name = F.when(ambiguous & (F.col("second") >= 0.35), "mixed").otherwise(F.coalesce("dialect", F.lit("msa")))
    return every.select("doc_id", name.alias("dialect"), six(F.coalesce("score", F.lit(1.0))).alias("score"), ambiguous.alias("ambiguous"), F.round(sure, 5).alias("confidence"))


def tones(docs: DataFrame) -> DataFrame:
    """Lexical tone scores by document: 0.18 and the weights of its words; neutral has 1."""
    lex = docs.sparkSession.createDataFrame(TONE_WORDS, "tone string, form string, weight double")
    hits = tokens(docs).where("kind = 'arabic'").withColumn("form", normalize(F.col("piece"), "lookup")).join(F.broadcast(lex), "form")
    return hits.groupBy("doc_id", "tone").agg((F.sum(F.round(F.col("weight") * 1000).cast("long")) / 1000 + 0.18).alias("score"), F.count(F.lit(1)).alias("hits")).withColumn("score", six(F.col("score")))


def variant_consistency(docs: DataFrame) -> DataFrame:
    """Words of a variant group that differ from the first of it in the document."""
    groups = docs.sparkSession.createDataFrame(VARIANTS, "grp string, form string")
    seen = tokens(docs).where("kind = 'arabic'").withColumn("form", normalize(F.col("piece"), "lookup")).join(F.broadcast(groups), "form")
    first = F.first("piece").over(Window.partitionBy("doc_id", "grp").orderBy("start"))
    return seen.withColumn("preferred", first).where("piece <> preferred").select("doc_id", "grp", "start", "stop", "piece", "preferred")


def numeral_consistency(docs: DataFrame) -> DataFrame:
    """Numbers in other digits than the first unmixed number of the document, and numbers that mix both."""
    western, arabic = F.col("piece").rlike("[0-9]"), F.col("piece").rlike("[٠-٩]")
    style = F.when(western & arabic, "mixed").when(western, "western").otherwise("arabic_indic")
    numbers = tokens(docs).where("kind = 'number'").withColumn("style", style)
    first = F.first(F.when(F.col("style") != "mixed", F.col("style")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("start"))
    return numbers.withColumn("preferred", first).where("style = 'mixed' or style <> preferred").select("doc_id", "start", "stop", "piece", "style", "preferred")


def spelling_neighbours(docs: DataFrame) -> DataFrame:
    """Pairs of distinct Arabic words one deletion, insertion, substitution or swap apart: an equi-join on deletion keys."""
    forms = tokens(docs).where("kind = 'arabic'").select(normalize(F.col("piece"), "lookup").alias("form")).distinct().where(F.char_length("form") >= 4)
    cut = F.transform(F.sequence(F.lit(1), F.char_length("form")), lambda i: F.concat(F.substring("form", F.lit(1), i - 1), F.substring("form", i + 1, F.char_length("form"))))
    keys = forms.select("form", F.explode(F.array_distinct(F.concat(F.array("form"), cut))).alias("key"))
    return keys.alias("a").join(keys.alias("b"), "key").where("a.form < b.form").select(F.col("a.form").alias("left_form"), F.col("b.form").alias("right_form")).distinct()


#: Words that address a reader's question.
MARKERS = ("لذلك", "لأن", "مثال", "النتيجة")


def engagement(docs: DataFrame) -> DataFrame:
    """Engagement by document from clarity, questions, markers, variety of sentence lengths and type-token ratio, in one pass.

    A sentence is what stands between terminators or line ends and holds a word.
    """

    def found(text: str) -> Iterator[tuple]:
        yield (*measured(text), text.count("?") + text.count("؟"), sum(map(text.count, MARKERS)))

    rows = rows_of(docs, found, MEASURES + ", q long, m long")
    rows = readable(rows, "types", "stretches", "q", "m")
    # in whole numbers, so that the order of addition does not matter: sum |k*n - total| / (k * total)
    k, total = F.size("stretches").cast("long"), F.col("words")
    off = F.aggregate("stretches", F.lit(0).cast("long"), lambda a, n: a + F.abs(n * k - total))
    variety = F.when(k > 1, F.least(F.lit(1.0), off / (k * F.greatest(total, k)))).otherwise(0.0)
    ttr = F.coalesce(F.round(F.try_divide(F.col("types"), total), 6), F.lit(0.0))
    value = F.col("clarity") * 0.52 + F.least(F.lit(15.0), F.col("q") * 3.0) + F.least(F.lit(12.0), F.col("m") * 2.0) + variety * 14.0 + F.least(F.lit(7.0), ttr * 10.0)
    return rows.select("doc_id", F.round(clamp(value), 4).alias("engagement"), F.round(variety, 6).alias("variety"))


def tone_balance(scores: DataFrame) -> DataFrame:
    """Entropy of the scores of ``doc_id, tone, score`` as a share of the most it could be, in hundredths; 0 with one tone."""
    total = Window.partitionBy("doc_id")
    p = F.col("score") / F.sum("score").over(total)
    rows = scores.where("score > 0").withColumn("p", p).groupBy("doc_id").agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"), F.count(F.lit(1)).alias("n"), F.max_by("tone", F.struct("score", "tone")).alias("dominant"))
    return rows.select("doc_id", "dominant", F.round(F.when(F.col("n") > 1, clamp(F.col("h") / F.log2("n") * 100)).otherwise(0.0), 4).alias("balance"))


def vocabulary_report(docs: DataFrame) -> DataFrame:
    """Words, types, type-token and hapax shares, mean length, longest sentence, clauses, complexity and its band, in one pass over each text.

    A clause is one, and one more for each comma, semicolon or colon. Words without a sentence have no longest one.
    """

    def found(text: str) -> Iterator[tuple]:
        yield (*measured(text), max((x[2] for x in sentence_measures(text)), default=0), 1 + sum(map(text.count, "،؛:")))

    rows = readable(rows_of(docs, found, MEASURES + ", longest long, clauses long"), "types", "hapax", "longest", "clauses")
    value = clamp((100 - F.col("clarity")) * 0.62 + F.greatest(F.lit(0.0), F.col("avg_words") - 12) * 1.25 + F.greatest(F.lit(0), F.col("clauses") - 1) * 7.0)
    value = F.when(F.col("words") == 0, 0.0).otherwise(value)
    band = F.when(value < 22, "simple").when(value < 45, "moderate").when(value < 68, "advanced").otherwise("complex")
    share = lambda a, b: six(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)))
    return rows.select("doc_id", "words", "types", share("types", "words").alias("ttr"), share("hapax", "types").alias("hapax_ratio"), "avg_chars", "longest", "clauses", F.round(value, 4).alias("complexity"), band.alias("band"))
