"""Toxicity by a weighted lexicon.

Texts are folded (case, compatibility forms, homoglyphs, digit substitutions, everything else a
blank) and scanned once by an Aho-Corasick automaton of word beginnings and phrases. Where several
entries begin at one word the longest counts; entries without weight are exceptions that mask the
shorter ones. Summed weights are normalised by length and turned into a score by a logistic curve.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.llm.common import discard, ship, stored, whole

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p",
    "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i",
}
#: Signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e"}
#: Words of abuse and phrases in which they are harmless; used where labels say nothing.
ABUSE = ("asshole", "bastard", "bitch", "clown", "cretin", "dickhead", "disgusting", "dumbass", "fuck", "idiot", "imbecile", "loser", "moron", "motherfucker", "pathetic", "retard", "scum", "shit", "slut", "stupid", "trash", "whore", "worthless")
HARMLESS = ("clown fish", "clownfish", "class clown", "idiot proof", "trash bag", "trash bin", "trash can", "retardant", "scum line", "shiitake", "shitake")
SEED_WEIGHT = 3.0
#: Word beginnings of these lengths are learned, besides whole words.
PREFIXES = range(3, 10)
#: Stems that a task counts before it hands the counts on.
TALLY = 200_000


class Folding(dict):
    """A str.translate table that decides each character once."""

    def __missing__(self, code: int) -> str:
        c = unicodedata.normalize("NFKC", chr(code)).lower()
        out = "".join(HOMOGLYPHS.get(x, SUBSTITUTES.get(x, x)) for x in c)
        out = "".join(x if x.isalpha() else "" if unicodedata.category(x) in ("Mn", "Cf") else " " for x in out)
        self[code] = out
        return out


FOLD = Folding()


def fold(text: str | None) -> list[str]:
    return unicodedata.normalize("NFC", text or "").translate(FOLD).split()


@dataclass
class Lexicon:
    """Entries by folded form: a word beginning or phrase, with a closing blank if whole words are meant; weight 0: an exception."""

    entries: dict[str, float]
    coefficients: list[float] = field(default_factory=lambda: [-6.0, 1.0, 1.0, 0.5, 0.0])

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            a.add_word(" " + entry, (len(entry), weight))
        if len(a):
            a.make_automaton()
        return a


def seed() -> Lexicon:
    return Lexicon({w: SEED_WEIGHT for w in ABUSE} | {p + (" " if " " in p else ""): 0.0 for p in HARMLESS})


def hits(words: list[str], automaton) -> list[float]:
    """Weight of each word or phrase at which an entry begins, the longest entry at each place."""
    if not len(automaton):
        return []
    best: dict[int, tuple[int, float]] = {}
    for end, (size, weight) in automaton.iter(" " + " ".join(words) + " "):
        start = end - size
        if start not in best or best[start][0] < size:
            best[start] = (size, weight)
    return [w for _, w in best.values() if w > 0]


def features(words: list[str], automaton) -> list[float]:
    found, n = hits(words, automaton), len(words)
    total = sum(found)
    return [1.0, math.log1p(total), math.log1p(100 * total / (n + 10)), max(found, default=0.0), math.log1p(n) if found else 0.0]


def score(row: list[float], coefficients: list[float]) -> float:
    z = sum(a * b for a, b in zip(row, coefficients, strict=True))
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def stems(words: list[str]) -> set[str]:
    return {w[:k] for w in set(words) for k in PREFIXES if len(w) >= k} | {w + " " for w in set(words)}


def weigh(counts: DataFrame, pos: int, neg: int, least_gain: float = 20.0) -> dict[str, float]:
    """Entries from ``counts(stem, pos, neg)`` of toxic and other documents by stem.

    A stem is kept if it tells the classes apart (likelihood ratio statistic) and points to toxic,
    and no longer stem holds nearly all of its toxic documents;
    its longer forms that occur mostly in other documents, or only there, become exceptions.
    """
    a, b, p = F.col("pos"), F.col("neg"), pos / (pos + neg)

    def share(x: Column, q: float) -> Column:
        return F.when(x > 0, x * F.log(x / ((a + b) * q))).otherwise(0.0)

    odds = F.log((a + 0.5) / (pos + 1)) - F.log((b + 0.5) / (neg + 1))
    judged = counts.withColumn("odds", odds).withColumn("kept", (a >= 4) & (odds >= 1.0) & (2 * (share(a, p) + share(b, 1 - p)) >= least_gain))
    kept = {r["stem"]: (r["pos"], r["neg"], r["odds"]) for r in judged.where("kept").collect()}
    longer: dict[str, int] = {}
    for s in kept:
        if not s.endswith(" "):
            for k in range(2, len(s)):
                longer[s[:k]] = max(longer.get(s[:k], 0), kept[s][0])
    out = {s: w[2] for s, w in kept.items() if longer.get(s, 0) < 0.9 * w[0] and w != kept.get(s[:-1] if s.endswith(" ") else None)}
    beginnings = F.transform(F.sequence(F.lit(2), F.char_length("stem") - 1), lambda k: F.substring("stem", F.lit(1), k))
    harmless = judged.where("not kept and neg >= 3 and odds < 0.5 and char_length(stem) > 2").select("stem", F.explode(beginnings).alias("short"))
    found = harmless.join(F.broadcast(judged.where("kept").select(F.col("stem").alias("short"))), "short", "left_semi").select("stem").distinct().collect()
    return out | {r["stem"]: 0.0 for r in found}


def fit(rows: np.ndarray, labels: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Logistic regression by Newton's method."""
    w = np.zeros(rows.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -35, 35)))
        h = (rows * (p * (1 - p) + 1e-9)[:, None]).T @ rows + ridge * np.eye(len(w))
        step = np.linalg.solve(h, rows.T @ (labels - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """A lexicon from labelled documents outside the held-out fifth (crc32 of doc_id mod 5 is 0).

    Fitted on at most ``most_rows`` labelled rows, chosen by hash of doc_id; that bound makes their
    ids and labels small enough to broadcast, so texts are not shuffled. All their stems are
    weighed, and only the entries collected. Rows without a label or an id are left out; of labels
    that differ the larger counts, and of texts that share a doc_id the least, so that repeated rows
    do not add to the sample. A null text is empty. Without both classes, as with an empty table, the fixed list is used.
    Other columns are not read.
    """
    ship(docs.sparkSession)
    told = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    told = told.where((F.crc32(F.col("doc_id").cast("string")) % 5) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    train = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).join(F.broadcast(told), "doc_id")
    train = train.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic")).select("text", "toxic").persist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: tuple[Counter, Counter] = (Counter(), Counter())

        def counted() -> Iterator[pa.RecordBatch]:
            for y, c in enumerate(tally):
                if c:
                    n = pa.array(c.values(), pa.int64())
                    none = pa.array(np.zeros(len(c), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), n if y else none, none if y else n], names=["stem", "pos", "neg"])
                    c.clear()

        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = tally[int(y > 0)]
                c.update(stems(fold(text)))
                c[""] += 1
                if len(c) > TALLY:
                    yield from counted()
        yield from counted()

    total = None
    try:
        total = stored(train.mapInArrow(count, "stem string, pos long, neg long").groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "stems")
        documents = total.where("stem = ''").first()
        if documents is None or not documents["pos"] or not documents["neg"]:
            return seed()
        found = Lexicon(seed().entries | weigh(total.where("stem <> ''"), documents["pos"], documents["neg"]))

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = found.automaton()
            for b in batches:
                f = [[*features(fold(t), a), float(y > 0)] for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64()))], names=["f"])

        sample = np.array([r["f"] for r in train.mapInArrow(gather, "f array<double>").collect()])
        return Lexicon(found.entries, fit(sample[:, :-1], sample[:, -1]))
    finally:
        train.unpersist()
        if total is not None:
            discard(total)


def assess(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Score every whole text: ``doc_id, held_out, score, predicted, n_words, n_hits`` per row of docs.

    With ``keep``, the columns of docs and ``score`` instead. Null and empty texts score as texts
    without hits; a null doc_id is not held out; repeated rows are scored each; very long texts are scored whole; a ``score`` of docs is
    replaced with ``keep``, and other columns do not matter. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    entries, coefficients = lexicon.entries, lexicon.coefficients

    def of(texts: list[str], automaton) -> tuple[list[float], list[int], list[int]]:
        rows = []
        for t in texts:
            words = fold(t)
            rows.append((score(features(words, automaton), coefficients), len(words), len(hits(words, automaton))))
        return tuple(map(list, zip(*rows, strict=True))) if rows else ([], [], [])

    if keep:
        def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            a = Lexicon(entries).automaton()
            for s in parts:
                yield pd.Series(of(s.tolist(), a)[0], dtype="float64")

        return docs.withColumn("score", F.pandas_udf(scored, "double")(whole(text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Lexicon(entries).automaton()
        for b in batches:
            s, n, k = of(b.column(1).to_pylist(), a)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(n, pa.int64()), pa.array(k, pa.int64())], names=["doc_id", "score", "n_words", "n_hits"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, n_words long, n_hits long")
    held = F.coalesce((F.crc32(F.col("doc_id").cast("string")) % 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", "n_hits")
