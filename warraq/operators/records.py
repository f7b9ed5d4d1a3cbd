"""Operators on records: evaluation, agreement, distillation, splits, journal recovery, retries, ranking, trends, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from warraq.functions.text import tokens
from warraq.operators.analytics import six


def ratio(a: Column, b: Column) -> Column:
    """a / b, 1 where nothing was there to find."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(1.0))


def f_beta(p: Column, r: Column, beta: float = 0.5) -> Column:
    return F.coalesce(F.try_divide((1 + beta * beta) * p * r, beta * beta * p + r), F.lit(0.0))


def evaluate(gold: DataFrame, found: DataFrame, *slices: str) -> DataFrame:
    """Counts, precision, recall and F0.5 of spans equal in (doc_id, start, stop, category), for all and each value of each slice.

    Repeated spans count once. One pass over one full outer join; slices by grouping sets.
    """
    key = ["doc_id", "start", "stop", "category"]
    both = gold.select(*key, *slices).dropDuplicates(key).withColumn("g", F.lit(1)).join(found.select(*key, *[F.col(s).alias(f"f_{s}") for s in slices]).dropDuplicates(key).withColumn("p", F.lit(1)), key, "full_outer")
    both = both.select("g", "p", *[F.coalesce(s, f"f_{s}").alias(s) for s in slices])
    agg = (F.sum(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1).otherwise(0)).alias("tp"), F.sum(F.when(F.col("g").isNull(), 1).otherwise(0)).alias("fp"), F.sum(F.when(F.col("p").isNull(), 1).otherwise(0)).alias("fn"))
    sets = [[], *([F.col(s)] for s in slices)]
    counts = both.groupingSets(sets, *[F.col(s) for s in slices]).agg(*agg) if slices else both.agg(*agg)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(*[F.coalesce(s, F.lit("*")).alias(s) for s in slices], *(F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")), six(p).alias("precision"), six(r).alias("recall"), six(f_beta(p, r)).alias("f05"))


def kappa(pairs: DataFrame, *keys: str) -> DataFrame:
    """Cohen's kappa of two yes-no judgements ``a, b`` (0 or 1); 1 where chance and agreement are both certain."""
    s = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("a") == F.col("b")).cast("long")).alias("same"), F.sum("a").alias("a1"), F.sum("b").alias("b1"))
    n = F.col("n").cast("double")
    pa, pb, observed = F.col("a1") / n, F.col("b1") / n, F.col("same") / n
    expected = pa * pb + (1 - pa) * (1 - pb)
    value = F.when(F.abs(expected - 1) < 1e-9, F.when(F.abs(observed - 1) < 1e-9, 1.0).otherwise(0.0)).otherwise((observed - expected) / (1 - expected))
    return s.select(*keys, "n", six(observed).alias("observed"), six(value).alias("kappa"))


def distilled(pairs: DataFrame, support: int = 3, most: int = 3) -> DataFrame:
    """Replacements ``bad, good`` of at most three words that at least ``support`` accepted corrections share.

    The common first and last words of ``original`` and ``corrected`` are cut; pure insertions and deletions go.
    """
    a, b = F.split("original", " "), F.split("corrected", " ")
    lead = F.coalesce(F.nullif(F.array_position(F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"].eqNullSafe(p["y"])), F.lit(False)), F.lit(0)) - 1, F.least(F.size(a), F.size(b)).cast("long"))
    rows = pairs.select("original", "corrected", a.alias("a"), b.alias("b"), lead.alias("lead"))
    tail = F.coalesce(F.nullif(F.array_position(F.transform(F.arrays_zip(F.reverse("a").alias("x"), F.reverse("b").alias("y")), lambda p: p["x"].eqNullSafe(p["y"])), F.lit(False)), F.lit(0)) - 1, F.least(F.size("a"), F.size("b")).cast("long"))
    rows = rows.withColumn("tail", F.least(tail, F.least(F.size("a"), F.size("b")) - F.col("lead")).cast("int")).withColumn("lead", F.col("lead").cast("int"))
    cut = lambda c: F.array_join(F.slice(c, F.col("lead") + 1, F.size(c) - F.col("lead") - F.col("tail")), " ")
    n = lambda c: F.size(c) - F.col("lead") - F.col("tail")
    rows = rows.where((n("a") > 0) & (n("b") > 0) & (n("a") <= most) & (n("b") <= most)).select(cut("a").alias("bad"), cut("b").alias("good"), "original")
    out = rows.groupBy("bad", "good").agg(F.count(F.lit(1)).alias("support"), F.min("original").alias("example")).where(F.col("support") >= support)
    return out.withColumn("rule_id", F.concat(F.lit("DISTILLED_"), F.upper(F.left(F.sha2(F.concat_ws("\t", "bad", "good"), 256), F.lit(10)))))


def split_of(text: Column) -> Column:
    """train, validation or test by the first eight hex digits of the SHA-256, mod 100."""
    bucket = F.conv(F.left(F.sha2(text, 256), F.lit(8)), 16, 10).cast("long") % 100
    return F.when(bucket < 80, "train").when(bucket < 90, "validation").otherwise("test")


def recover(journal: DataFrame, after: DataFrame, page: int = 1000) -> DataFrame:
    """Records to replay: from the newest snapshot if the peer's cursor is older or unknown, then later updates, one page.

    ``journal(doc, ms, seq, kind)``, ``after(doc, ms, seq)``; cursors compare as pairs of numbers.
    """
    cursor = F.struct("ms", "seq")
    snap = journal.where("kind = 'snapshot'").groupBy("doc").agg(F.max(cursor).alias("snap"))
    base = journal.select("doc").distinct().join(snap, "doc", "left").join(after.select("doc", cursor.alias("seen")), "doc", "left")
    use = F.col("snap").isNotNull() & (F.col("seen").isNull() | (F.col("seen") < F.col("snap")))
    base = base.select("doc", F.when(use, F.col("snap")).otherwise(F.col("seen")).alias("base"), use.alias("from_snapshot"))
    tail = journal.withColumn("cursor", cursor).join(base, "doc").where("base is null or cursor > base or (from_snapshot and cursor = base)")
    rank = F.row_number().over(Window.partitionBy("doc").orderBy("cursor"))
    return tail.withColumn("rank", rank).where(F.col("rank") <= page).select("doc", "ms", "seq", "kind", "from_snapshot", F.col("rank").cast("long").alias("rank"))


def retry_after(attempts: Column) -> Column:
    """Milliseconds: one second doubled with each attempt, five minutes at most."""
    return F.least(F.lit(300000), F.lit(1000) * F.pow(F.lit(2), F.least(attempts, F.lit(20)))).cast("long")


def trend(daily: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """Change of each value against the key's previous snapshot."""
    w = Window.partitionBy(key).orderBy(order)
    return daily.select("*", *[(F.col(v) - F.lag(v).over(w)).alias(f"{v}_delta") for v in values])


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def redacted(docs: DataFrame) -> DataFrame:
    """Texts with addresses, e-mails and phone-like numbers replaced by their kind."""
    text = F.col("text")
    for kind, pattern in REDACTIONS.items():
        text = F.regexp_replace(text, pattern, f"[REDACTED_{kind}]")
    return docs.select("doc_id", text.alias("text"))


#: What counts as an address, an e-mail and a phone number, replaced in this order.
REDACTIONS = {
    "URL": r"(?i)(?:https?://|ftp://|www\.)[^\s<>\[\]{}\"'`]*[^\s<>\[\]{}\"'`.,،؛؟!?:;)»]",
    "EMAIL": r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "PHONE": r"\+?[0-9٠-٩](?:[\s().\-]?[0-9٠-٩]){6,14}",
}


def private_spans(docs: DataFrame) -> DataFrame:
    """Address and e-mail tokens: ``doc_id, kind, start, stop``; punctuation that closes an address is not part of it."""
    t = tokens(docs).where("kind in ('url', 'email')")
    size = F.char_length(F.regexp_replace("piece", r"[.,،؛؟!?:;)»\]}>]+\z", ""))
    return t.select("doc_id", "kind", "start", F.when(F.col("kind") == "url", F.col("start") + size).otherwise(F.col("stop")).alias("stop"))
