"""A labelled corpus by arithmetic on row numbers: sentences with one error or none, and where it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.operators.records import split_of

DOMAINS = ("journalism", "academic", "administrative", "educational", "social")
DIALECTS = ("msa", "iraqi", "gulf", "levantine", "egyptian")
#: Sentence around the word, wrong word, right word, category.
PATTERNS = (
    ("ذهب الوفد % المدينة صباحا.", "الى", "إلى", "spelling"), ("قرأت % الصفحة مرتين.", "هذة", "هذه", "spelling"), ("الوقت ضيق، % العمل كثير.", "لاكن", "لكن", "spelling"),
    ("اشترى المعلم % سيارات.", "خمسة", "خمس", "grammar"), ("حضر % طلاب إلى القاعة.", "سبع", "سبعة", "grammar"), ("هل وصلت الرسالة%", "?", "؟", "punctuation"), ("أريد أن أعرف %.", "شلونك", "كيف حالك", "dialect"),
)
OPENINGS = ("", "نعم: ", "في الحقيقة، ", "رقم ٣.١٤ — ")


def generate(spark: SparkSession, n: int) -> DataFrame:
    """``id, text, domain, split, dialect, category, start, stop, accepted`` of n cases; every fourth has no error, and null in the last four."""
    i = F.col("id")
    pick = lambda values, e: F.element_at(F.array(*map(F.lit, values)), (e % len(values) + 1).cast("int"))
    which = F.floor(i / len(DOMAINS))
    rows = spark.range(n).select(
        i, pick(DOMAINS, i).alias("domain"), pick(DIALECTS, F.floor(i / 7)).alias("dialect"), pick(OPENINGS, F.floor(i / 3)).alias("opening"), (i % 4 == 3).alias("clean"),
        *(pick([p[k] for p in PATTERNS], which).alias(c) for k, c in enumerate(("frame", "bad", "good", "category"))),
    )
    word = F.when(F.col("clean"), F.col("good")).otherwise(F.col("bad"))
    text = F.concat("opening", F.replace("frame", F.lit("%"), word), F.lit(" ["), i.cast("string"), F.lit("]"))
    start = (F.char_length("opening") + F.locate("%", "frame") - 1).cast("long")
    given = lambda c: F.when(~F.col("clean"), c)
    return rows.select(
        i, text.alias("text"), "domain", split_of(text).alias("split"), "dialect", given(F.col("category")).alias("category"), given(start).alias("start"),
        given(start + F.char_length("bad")).alias("stop"), given(F.array("good")).alias("accepted"),
    )
