"""Rules with regular expressions: token sequences, contexts, exceptions, and rules that block others.

Matches are cut out natively: the text between matches and the matches alternate, so offsets are prefix
sums of both. A pattern must not match the empty text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from warraq.functions.resources import EXCEPTION_RULES, PATTERN_RULES
from warraq.operators.spans import drop_overlapping

WINDOW = 60
SENTENCE_END = r"[.!?؟؛…\n]"


@dataclass(frozen=True)
class PatternRule:
    rule_id: str
    regex: str
    suggestion: str = ""
    profile: str = "all"
    before: str = ""
    after: str = ""
    exception: str = ""
    scope: str = ""


def rules(profiles: Sequence[str] | None = None) -> list[PatternRule]:
    """The packaged rules, those of active profiles only if given."""
    every = [PatternRule(*r) for r in PATTERN_RULES]
    return [r for r in every if profiles is None or r.profile == "all" or r.profile in profiles]


def sequence(*words: str, optional: Sequence[str] = ()) -> str:
    """Pattern of words parted by white space; those in ``optional`` may be missing."""
    return words[0] + "".join(rf"(?:\s+{w})?" if w in optional else rf"\s+{w}" for w in words[1:])


def found(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``doc_id, rule_id, start, stop, surface`` of every leftmost non-overlapping match of each pattern."""
    each = F.array(*(F.struct(F.lit(name).alias("rule_id"), F.split("text", p, -1).alias("gap"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("surface")) for name, p in patterns.items()))
    rows = docs.select("doc_id", F.explode(each).alias("f")).where(F.size("f.surface") > 0)
    rows = rows.select("doc_id", "f.rule_id", F.posexplode(F.arrays_zip("f.gap", "f.surface")).alias("nth", "z")).select("doc_id", "rule_id", "nth", "z.*").where("surface is not null")
    size = F.char_length("surface")
    stop = F.sum(F.char_length("gap") + size).over(Window.partitionBy("doc_id", "rule_id").orderBy("nth"))
    return rows.select("doc_id", "rule_id", (stop - size).alias("start"), stop.alias("stop"), "surface")


def _around(rule: PatternRule) -> Column | None:
    """Whether a match of the rule stands in its context and outside its exception; None where it has neither."""
    start, stop, text = F.col("start").cast("int"), F.col("stop").cast("int"), F.col("text")
    left = F.greatest(start - WINDOW, F.lit(0))
    before, after = F.substring(text, left + 1, start - left), F.substring(text, stop + 1, F.lit(WINDOW))
    tests = []
    if rule.before:
        tests.append(before.rlike(f"(?:{rule.before})\\z"))
    if rule.after:
        tests.append(after.rlike(f"\\A(?:{rule.after})"))
    if rule.exception:
        whole = {
            "match": lambda: F.col("surface"),
            "window": lambda: F.concat(before, F.col("surface"), after),
            "sentence": lambda: F.concat(F.element_at(F.split(F.substring(text, F.lit(1), start), SENTENCE_END, -1), -1), F.col("surface"), F.element_at(F.split(F.substring(text, stop + 1, F.char_length(text)), SENTENCE_END, -1), 1)),
        }[rule.scope]()
        tests.append(~whole.rlike(rule.exception))
    out = None
    for t in tests:
        out = t if out is None else out & t
    return out


def matches(docs: DataFrame, active: Sequence[PatternRule], blocks: Sequence[tuple[str, str, str]] = EXCEPTION_RULES) -> DataFrame:
    """``doc_id, rule_id, start, stop, suggestion``. Texts are joined only to matches whose rule looks around them."""
    hits = found(docs, {r.rule_id: r.regex for r in active})
    looking = {r.rule_id: c for r in active if (c := _around(r)) is not None}
    kept = hits.where(~F.col("rule_id").isin(*looking)) if looking else hits
    if looking:
        ok = F.lit(False)
        for name, c in looking.items():
            ok = F.when(F.col("rule_id") == name, c).otherwise(ok)
        kept = kept.unionByName(hits.where(F.col("rule_id").isin(*looking)).join(docs.select("doc_id", "text"), "doc_id").where(ok).drop("text"))
    blocks = [b for b in blocks if any(r.rule_id == b[2] for r in active)]
    if blocks:
        target = F.create_map(*[F.lit(x) for name, _, blocked in blocks for x in (name, blocked)])[F.col("rule_id")]
        key = lambda rule: F.struct("doc_id", rule.alias("rule_id"))
        walls = found(docs, {name: p for name, p, _ in blocks}).select(key(target).alias("doc_id"), "start", "stop")
        kept = drop_overlapping(kept.select(key(F.col("rule_id")).alias("doc_id"), "start", "stop", "surface"), walls).select("doc_id.doc_id", "doc_id.rule_id", "start", "stop", "surface")
    to = F.lit(None).cast("string")
    for r in active:
        to = F.when(F.col("rule_id") == r.rule_id, F.regexp_replace("surface", r.regex, r.suggestion)).otherwise(to)
    return kept.select("doc_id", "rule_id", "start", "stop", to.alias("suggestion"))
