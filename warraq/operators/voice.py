"""Stylometric fingerprints of forty features, and how far a text is from its author's profile."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from warraq.functions.scan import bare, rows_of, tokens_of
from warraq.functions.text import COMPOSED, MARKS, STROKE
from warraq.operators.sentences import split_sentences

#: Connectives and function words, in lookup form.
CONNECTIVES = ("و", "ف", "ثم", "لكن", "بل", "كما", "حيث", "اذ", "لذلك", "غير")
FUNCTION_WORDS = ("في", "من", "على", "الى", "عن", "ان", "قد", "لقد", "هذا", "هذه", "ذلك", "التي", "الذي", "كان", "ليس")
#: Features and how much each counts.
WEIGHTS = {
    "sentence_length_mean": 3.0, "sentence_length_std": 2.0, "word_length_mean": 1.5, "type_token_ratio": 2.0, "hapax_ratio": 1.0, "diacritics_density": 1.5, "tatweel_rate": 0.5,
    "punctuation_rate": 1.5, "arabic_comma_share": 1.0, "question_share": 1.0, "exclamation_share": 1.0, "connector_rate": 2.5, "function_word_rate": 2.0, "latin_share": 1.0, "arabic_digit_share": 0.5,
} | {f"connector_{w}": 0.4 for w in CONNECTIVES} | {f"funcword_{w}": 0.25 for w in FUNCTION_WORDS}
NAMES = tuple(sorted(WEIGHTS))
PUNCTUATION = "،,؛;:.!؟?…«»\"'()-—"
MARK, ARABIC_DIGIT, WESTERN_DIGIT = re.compile(f"[{MARKS}]"), re.compile("[٠-٩]"), re.compile("[0-9]")
WORDS = ("arabic", "latin", "hashtag", "mention")
#: A profile of fewer samples or words, and a text of fewer words, is not to be relied on.
LEAST_SAMPLES, LEAST_WORDS, LEAST_TEXT = 3, 300, 30


def lookup(word: str) -> str:
    for pair, one in COMPOSED:
        word = word.replace(pair, one)
    return bare(word)


def share(a: float, b: float) -> float:
    return a / b if b else 0.0


def features(text: str) -> tuple[int, int, dict[str, float]]:
    """Words, sentences and the features that are not zero."""
    words = [(piece, at, kind) for piece, at, _, kind in tokens_of(text) if kind in WORDS]
    spans = split_sentences(text)
    starts, sizes = [a for a, _, _ in spans], [0] * len(spans)
    for _, at, _ in words:
        if (k := bisect_right(starts, at)) and at < spans[k - 1][1]:
            sizes[k - 1] += 1
    lengths = [n for n in sizes if n > 1]
    mean = share(sum(lengths), len(lengths))
    ends = [text[a : b + 3] for a, b, _ in spans]
    arabic = [piece for piece, _, kind in words if kind == "arabic"]
    forms = Counter(map(lookup, arabic))
    letters, strokes = sum(len(bare(w)) for w in arabic), sum(w.count(STROKE) for w in arabic)
    commas = text.count("،"), text.count(",")
    digits = len(ARABIC_DIGIT.findall(text)), len(WESTERN_DIGIT.findall(text))
    links, functions = sum(forms[w] for w in CONNECTIVES), sum(forms[w] for w in FUNCTION_WORDS)
    n = len(words)
    out = {
        "sentence_length_mean": mean, "sentence_length_std": share(sum((x - mean) ** 2 for x in lengths), len(lengths)) ** 0.5, "word_length_mean": share(letters, len(arabic)),
        "type_token_ratio": share(len(forms), len(arabic)), "hapax_ratio": share(sum(k == 1 for k in forms.values()), len(arabic)),
        "diacritics_density": share(sum(len(MARK.findall(w)) for w in arabic), letters), "tatweel_rate": share(strokes, letters),
        "punctuation_rate": share(sum(map(text.count, PUNCTUATION)), n), "arabic_comma_share": share(commas[0], sum(commas)) if n else 0.0,
        "question_share": share(sum("؟" in x or "?" in x for x in ends), len(spans)), "exclamation_share": share(sum("!" in x or "﹗" in x for x in ends), len(spans)),
        "connector_rate": share(links, len(spans)) if arabic else 0.0, "function_word_rate": share(1000 * functions, len(arabic)),
        "latin_share": share(sum(kind != "arabic" and piece.isascii() for piece, _, kind in words), n), "arabic_digit_share": share(digits[0], sum(digits)) if n else 0.0,
    }
    out |= {f"{name}_{w}": share(1000 * forms[w], len(arabic)) for name, ws in (("connector", CONNECTIVES), ("funcword", FUNCTION_WORDS)) for w in ws}
    return n, len(spans), out


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """``doc_id``, keys, ``words, sentences, feature, value``: forty rows per document, values in whole millionths so that sums of them are exact.

    One pass over each text. A null or empty text has zeros.
    """

    def found(text: str) -> Iterator[tuple]:
        words, sentences, values = features(text)
        return ((words, sentences, name, values[name]) for name in NAMES)

    return rows_of(docs, found, "words long, sentences long, feature string, raw double", *keys).select("doc_id", *keys, "words", "sentences", "feature", F.round(F.col("raw") * 1e6).cast("long").alias("value"))


def sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Mergeable sums by key and feature over documents with words: samples, words, values and their squares."""
    big = F.col("value").cast("decimal(19,0)")
    return rows.where("words > 0").groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"), F.sum(big).cast("decimal(38,0)").alias("s"), F.sum(big * big).cast("decimal(38,0)").alias("q"))


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy(*keys, "feature").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.sum("s").cast("decimal(38,0)").alias("s"), F.sum("q").cast("decimal(38,0)").alias("q"))


def profiles(totals: DataFrame) -> DataFrame:
    """Mean and sample deviation of each feature, and whether the profile is to be relied on."""
    n, s, q = F.col("n").cast("double"), F.col("s").cast("double") / 1e6, F.col("q").cast("double") / 1e12
    variance = F.when(n > 1, F.greatest(F.lit(0.0), q - s * s / n) / (n - 1)).otherwise(0.0)
    reliable = (F.col("n") >= LEAST_SAMPLES) & (F.col("words") >= LEAST_WORDS)
    return totals.withColumns({"mean": s / n, "std": F.sqrt(variance), "reliable": reliable})


def weight_of(feature: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[feature]


def deviations(rows: DataFrame, profile: DataFrame, key: str) -> DataFrame:
    """Each feature of a document against its author's: observed, mean, spread, score z / (z + 2) and weight."""
    spread = F.greatest("std", F.abs("mean") * 0.1, F.lit(0.02))
    z = F.abs(F.col("value") / 1e6 - F.col("mean")) / spread
    at = rows.join(profile.select(key, "feature", "mean", "std", "reliable"), [key, "feature"])
    return at.withColumns({"score": z / (z + 2), "weight": weight_of(F.col("feature"))})


def drift(rows: DataFrame, profile: DataFrame, key: str, most: int = 3) -> DataFrame:
    """``doc_id, drift, alignment, reliable`` and the features that deviate most by score times weight, ties by name."""
    per = deviations(rows, profile, key)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.round(F.col("score") * F.col("weight"), 9)), "feature"))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "feature")))), lambda x: x["feature"]), ",")
    # In whole billionths, so that the order of addition does not matter.
    value = F.sum(F.round(F.col("score") * F.col("weight") * 1e9).cast("long")) / 1e9 / F.sum("weight")
    out = per.withColumn("rank", rank).groupBy("doc_id").agg(value.alias("d"), (F.min("reliable") & (F.max("words") >= LEAST_TEXT)).alias("reliable"), top.alias("most"))
    return out.select("doc_id", F.round("d", 9).alias("drift"), F.round(1 - F.col("d"), 9).alias("alignment"), "reliable", "most")
