"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. In every stage a null text is an empty one that is kept as null, an
empty table gives no rows, very long texts are read whole, and columns of docs beyond those of documents are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warraq.llm import line_dedup, minhash_dedup, mixing, packing, toxicity
from warraq.llm.common import discard, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are scored below one half; the lexicon is learned from the labels of those given.

    Repeated rows are scored each and stay or go alike; empty texts and rows with a null id are scored as any other.
    """
    docs = docs.select(*COLUMNS)
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.assess(docs, lexicon, keep=True).where("score < 0.5").select(*COLUMNS)


def drop_repeated_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks that an earlier one has; those of which nothing is left go.

    Empty and null texts lose nothing and stay. Rows with a null id stay as they are; rows that repeat an id and text lose the same; n_chars is
    counted anew where something was lost.
    """
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    gone = (F.size("removed") > 0) & (F.trim("text") == "")
    chars = F.when(F.size("removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(~F.coalesce(gone, F.lit(False))).withColumn("n_chars", chars).select(*COLUMNS)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class of near duplicates, and one row of it, of the least text.

    Empty texts are one class. Rows with a null id are no document of a class and stay.
    """
    docs = docs.select(*COLUMNS)
    kept = minhash_dedup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    one = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    # Most ids have one row, and are not gathered.
    often = one.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    first = one.join(often, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return one.join(often, "doc_id", "left_anti").unionByName(first).unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which sources are mixed to their target weights.

    A null source is one of its own; rows that are equal are interchangeable.
    """
    return mixing.in_order(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence; sequences are numbered in the order of the documents.

    A null or empty text is the closing id alone; each row is packed, also repeated ones and those with a null id.
    """
    return packing.pack(packing.in_file_order(docs))


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_blocks),
    ("minhash near-dedup", keep_one_of_each_class),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Lexicon learning, patience alignment, sampling, scheduling and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; what a stage kept is removed when the next has been written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(last)
    out = stored(STAGES[-1][1](spark, docs, sf_dir), "packing")
    discard(docs)
    return out
