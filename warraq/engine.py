"""The engine as one object: layers that are switched on, categories, profiles and filters; each method takes and gives DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.functions import resources as R
from warraq.functions.scan import bare, rows_of, tokens_of
from warraq.functions.text import normalize
from warraq.operators import analytics, checks, conversion, document_rules, morphology, pattern_rules, privacy, rewriting, sentences, spans, spelling, style, syntax, voice
from warraq.operators.rules import literals, rule_table

#: Layers in the order in which their matches are united.
LAYERS = ("rules", "checks", "patterns", "sentences", "consistency", "spelling", "syntax", "style", "dialect")
MATCH = "layer string, rule_id string, category string, severity string, start long, stop long, suggestion string, confidence double, priority int, autofix boolean"
COLUMNS = ("doc_id", *(x.split()[0] for x in MATCH.split(", ")))
#: How much the match of a layer counts against others.
PRIORITIES = {"checks": 0, "patterns": 20, "sentences": 0, "consistency": 88, "spelling": 76, "syntax": 90, "style": 31, "dialect": 45}
CATEGORY_OF = (("AGREEMENT", "grammar"), ("PUNCT", "punctuation"), ("DIALECT", "dialect"), ("CONSISTENCY", "consistency"))
SEVERITIES = {"error": 3, "warning": 2, "hint": 1}
#: Layers that look words up, for which a text does not suffice.
PARSED = frozenset({"patterns", "spelling", "syntax", "style", "dialect"})
#: Words that a user may add, and letters of one.
MOST_WORDS, MOST_LETTERS = 500, 80


def category(rule: str) -> str:
    return next((c for prefix, c in CATEGORY_OF if rule.startswith(prefix)), "style")


def own_words(text: str) -> tuple[str, ...]:
    """Words of a list by commas, semicolons or lines: trimmed, one of each lookup form, 500 at most; a longer list or word is an error."""
    words = {bare(w): w for w in reversed([x.strip() for x in re.split(r"[\n,،;؛]", text)]) if w}
    if len(words) > MOST_WORDS or any(len(w) > MOST_LETTERS for w in words):
        raise ValueError(f"more than {MOST_WORDS} words, or one of more than {MOST_LETTERS} letters")
    return tuple(reversed(words.values()))


@dataclass(frozen=True)
class Engine:
    """``rules`` is a table of surfaces as rule_table() gives it, ``lexicon`` one of lexemes; ours where they are left out.

    Categories that are not enabled, rules and categories that are disabled, and matches of the user's own words are filtered
    at the end, as are matches on private spans; a layer of which no category is enabled is not run at all.
    """

    spark: SparkSession
    layers: tuple[str, ...] = LAYERS
    categories: tuple[str, ...] | None = None
    profiles: tuple[str, ...] | None = None
    disabled_rules: tuple[str, ...] = ()
    disabled_categories: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    guard_private: bool = True
    rules: DataFrame | None = None
    lexicon: DataFrame | None = None

    def __post_init__(self):
        if unknown := set(self.layers) - set(LAYERS):
            raise ValueError(f"unknown layers: {sorted(unknown)}")

    def with_options(self, **options) -> Engine:
        return replace(self, **options)

    def _lexemes(self) -> DataFrame:
        return self.lexicon if self.lexicon is not None else morphology.lexemes(self.spark)

    def _allowed(self, cat: str) -> bool:
        return (self.categories is None or cat in self.categories) and cat not in self.disabled_categories

    def _scanner(self) -> Callable[[str], Iterator[tuple]]:
        """Matches of a text by the layers that need no more than it: one pass, one tokenisation."""
        rules = self.rules if self.rules is not None else rule_table(self.spark, self.profiles)
        if self.rules is not None and self.profiles is not None:
            rules = rules.where((F.col("profile") == "all") | F.col("profile").isin(*self.profiles))
        on = set(self.layers)
        look_up = literals(rules) if "rules" in on else None
        variants = {form: group for group, form in R.VARIANTS}
        priorities, allowed, off = dict(PRIORITIES), self._allowed, frozenset(self.disabled_rules)
        cats = {c: allowed(c) for c in ("spelling", "grammar", "punctuation", "style", "dialect", "consistency")}
        own = frozenset(map(bare, self.words))
        guard = self.guard_private

        def each(text: str) -> Iterator[tuple]:
            if look_up:
                for start, stop, rule, to, cat, severity, sure, priority, fix, _ in look_up.hits(text):
                    yield "rules", rule, cat, severity, start, stop, to, sure, priority, fix
            tokens = list(tokens_of(text)) if on & {"checks", "consistency"} else []
            if "checks" in on:
                for name in checks.CHECKS:
                    for rule, start, stop, to in checks.CHECKS[name](text, tokens):
                        yield "checks", rule, category(rule), "warning", start, stop, to, 0.8, priorities["checks"], False
            if "sentences" in on:
                for start, stop, n, *_ in sentences.measured(text):
                    if n > sentences.LONG_WORDS:
                        yield "sentences", "STYLE_LONG_SENTENCE", "style", "hint", start, min(stop, start + 40), None, 0.72, priorities["sentences"], False
            if "consistency" in on:
                first: dict[str, str] = {}
                for piece, start, stop, kind in tokens:
                    group = variants.get(bare(piece)) if kind == "arabic" else None
                    if group and first.setdefault(group, piece) != piece:
                        yield "consistency", f"CONSISTENCY_VARIANT_{group.upper()}", "consistency", "hint", start, stop, first[group], 0.9, priorities["consistency"], False

        def found(text: str) -> Iterator[tuple]:
            hidden = privacy.private(text) if guard else []
            for m in each(text):
                if cats.get(m[2], True) and m[1] not in off and not (own and bare(text[m[4] : m[5]]) in own) and not any(a < m[5] and m[4] < b for _, a, b in hidden):
                    yield m

        return found

    def _resolver(self) -> Callable[[str], Iterator[tuple]]:
        found = self._scanner()

        def resolved(text: str) -> Iterator[tuple]:
            matches = sorted(found(text), key=lambda m: (-m[8], -m[7], -SEVERITIES.get(m[3], 1), m[6] is None, m[4] - m[5], m[4], m[1]))
            for k in spans.kept((m[4], m[5]) for m in matches):
                _, rule, _, _, start, stop, to, *_ = matches[k]
                yield start, stop, rule, to

        return resolved

    def _parsed(self, docs: DataFrame) -> Iterator[DataFrame]:
        """Matches of the layers that look words up."""
        on = set(self.layers)
        lexemes = self._lexemes()

        def rows(df: DataFrame, layer: str, cat: str, severity: str, **given) -> DataFrame:
            out = df.withColumns({"layer": F.lit(layer), "category": F.lit(cat), "severity": F.lit(severity), "priority": F.lit(PRIORITIES[layer]), "autofix": F.lit(False), **given})
            for name, kind in (("suggestion", "string"), ("confidence", "double")):
                out = out if name in out.columns else out.withColumn(name, F.lit(None if kind == "string" else 0.9).cast(kind))
            return out.select("doc_id", *(F.col(c.split()[0]).cast("int" if c.endswith(" int") else c.split()[1]).alias(c.split()[0]) for c in MATCH.split(", ")))

        if "patterns" in on and self._allowed("style"):
            yield rows(pattern_rules.matches(docs, pattern_rules.rules(self.profiles or ())), "patterns", "style", "hint", confidence=F.lit(0.72))
        if "syntax" in on and self._allowed("grammar"):
            yield rows(syntax.checks(syntax.relations(syntax.pairs(syntax.parsed(docs, lexemes)))), "syntax", "grammar", "error")
        if "style" in on and (self._allowed("style") or self._allowed("semantics")):
            words = style.sentence_words(docs, lexemes)
            yield rows(style.light_verbs(syntax.pairs(syntax.parsed(docs, lexemes))), "style", "style", "hint")
            yield rows(style.dense_sentences(words), "style", "style", "hint", confidence=F.lit(0.72))
            yield rows(style.contradictions(words), "style", "semantics", "warning", priority=F.lit(86))
        if "dialect" in on and self._allowed("dialect"):
            yield rows(conversion.to_standard(docs), "dialect", "dialect", "hint", priority=F.lit(PRIORITIES["dialect"]))
        if "spelling" in on and self._allowed("spelling"):
            found = spelling.suggestions(docs, lexemes)
            right = morphology.analyses(found.select("form").union(found.select("candidate")).distinct(), lexemes).select("form", "confidence")
            wrong = spelling.decisions(found, right).where("reason = 'corrected'").select("form", F.col("candidate").alias("suggestion"), "confidence")
            words = rows_of(docs, lambda text: ((piece, a, b) for piece, a, b, kind in tokens_of(text) if kind == "arabic"), "piece string, start long, stop long").withColumn("form", normalize(F.col("piece"), "lookup"))
            yield rows(words.join(wrong, "form").withColumn("rule_id", F.lit("SPELL_LEXICAL_UNKNOWN")), "spelling", "spelling", "error")

    def found(self, docs: DataFrame) -> DataFrame:
        """All matches of the layers, before they are resolved: COLUMNS."""
        out, more = rows_of(docs, self._scanner(), MATCH), None
        for rows in self._parsed(docs):
            more = rows if more is None else more.unionByName(rows)
        if more is None:
            return out
        enabled = [c for c in ("spelling", "grammar", "punctuation", "style", "dialect", "consistency", "semantics") if self._allowed(c)]
        more = more.where(F.col("category").isin(*enabled) & ~F.col("rule_id").isin(*self.disabled_rules)) if self.disabled_rules else more.where(F.col("category").isin(*enabled))
        if self.words:
            more = document_rules.suppress(more, docs, docs.select("doc_id", F.lit("word").alias("kind"), F.explode(F.array(*map(F.lit, self.words))).alias("value")))
        if self.guard_private:
            more = privacy.outside(more, docs)
        return out.unionByName(more)

    def check(self, docs: DataFrame, suppressions: DataFrame | None = None) -> DataFrame:
        """Matches that stay when they are resolved against each other: ``doc_id, start, stop, rule_id, suggestion``.

        Where only the texts are scanned, matches are resolved row by row in the same pass, and nothing is shuffled.
        """
        if suppressions is None and not set(self.layers) & PARSED:
            return rows_of(docs, self._resolver(), "start long, stop long, rule_id string, suggestion string")
        rows = self.found(docs)
        if suppressions is not None:
            rows = document_rules.suppress(rows, docs, suppressions)
        return spans.resolve(rows)

    def correct(self, docs: DataFrame, mode: str = "safe") -> DataFrame:
        """Texts with replacements put in: ``safe`` ones, those of ``dialect``, or ``all``."""
        rows = self.found(docs).where("suggestion is not null")
        rows = rows.where("autofix") if mode == "safe" else rows.where("category = 'dialect'") if mode == "dialect" else rows
        return document_rules.correct(docs, spans.resolve(rows))

    def analyze_words(self, words: DataFrame) -> DataFrame:
        """Analyses of ``form``."""
        return morphology.analyses(words, self._lexemes())

    def parse(self, docs: DataFrame) -> DataFrame:
        return syntax.relations(syntax.pairs(syntax.parsed(docs, self._lexemes())))

    def diacritize(self, docs: DataFrame) -> DataFrame:
        """Words with the final mark of their case."""
        words = syntax.parsed(docs, self._lexemes())
        return conversion.marked(words, conversion.settled(syntax.cases(syntax.relations(syntax.pairs(words)))))

    def dialect_report(self, docs: DataFrame) -> DataFrame:
        return analytics.dialects(docs)

    def convert_to_msa(self, docs: DataFrame) -> DataFrame:
        return document_rules.correct(docs, spans.resolve(conversion.to_standard(docs)))

    def analyze_tone(self, docs: DataFrame) -> DataFrame:
        return analytics.tones(docs)

    def style_report(self, docs: DataFrame) -> DataFrame:
        return self.with_options(layers=tuple(x for x in self.layers if x in ("patterns", "sentences", "style"))).check(docs)

    def semantic_report(self, docs: DataFrame) -> DataFrame:
        return self.with_options(layers=("consistency",)).check(docs)

    def analytics_report(self, docs: DataFrame) -> DataFrame:
        return analytics.document_analytics(docs).join(analytics.readability(docs).select("doc_id", "clarity", "band"), "doc_id").join(analytics.engagement(docs), "doc_id")

    def rewrite(self, docs: DataFrame, mode: str) -> DataFrame:
        return rewriting.rewrite(docs, mode)

    def learn_voice(self, docs: DataFrame, key: str) -> DataFrame:
        return voice.profiles(voice.sums(voice.fingerprints(docs, key), key))

    def voice_report(self, docs: DataFrame, profile: DataFrame, key: str) -> DataFrame:
        return voice.drift(voice.fingerprints(docs, key), profile, key)
