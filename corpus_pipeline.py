"""Corpus pipeline: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Extra
columns are dropped; an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.llm import latent_leaks, line_templates, near_copies, packing, quality
from edgewise.llm.queries import crc_mod, word_tokenizer
from edgewise.session import read_table, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.5 or more), row by row; a null text is
    scored as an empty one, and without labels, or with one class, every row has the mean label."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality").where(crc_mod(3) != 1)
    return quality.accepted(docs.select(*COLUMNS), quality.fitted(docs, labels))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without recurring lines; null texts stay null, and a text may become empty."""
    out = line_templates.drop_recurring_lines(docs.select(*COLUMNS))
    return out.select(*COLUMNS[:-1], F.length("text").cast("long").alias("n_chars"))


def row_key():
    """A 64-bit key of a row by its doc_id, null told apart, and its text."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id, of equal ids the
    one whose text has the smallest hash; a document without an id only where no other has one.

    Near-duplicates share 0.8 or more of their shingles of five words (Jaccard), or are
    connected by such pairs. Rows are told apart by id and text, so different texts
    of one id, or without an id, are documents of their own; equal rows are one.
    """
    docs = docs.select(*COLUMNS)
    classes, _ = near_copies.copy_classes(docs, width=5)
    keyed = docs.withColumns({"_node": near_copies.node_of(), "_row": row_key()})
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_node", "_row")
    first = keyed.select("doc_id", "_node", "_row").join(classes, F.col("_node") == F.col("node")).groupBy("root").agg(F.min(rank).alias("first"))
    return keyed.join(first.select(F.col("first._row").alias("_row")).hint("merge"), "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, told apart by id and text, so that no row is dropped for
    another with its id and none stays for want of one."""
    keyed = docs.select(*COLUMNS).withColumn("_row", row_key())
    found = latent_leaks.leaks(keyed.select(F.col("_row").alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_row")).distinct()
    return keyed.join(found, "_row", "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that are left; a null or empty text is its end token alone."""
    return packing.pack(docs, word_tokenizer(), with_ids=False).drop("ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", leak_stage),
    ("packing", packing_stage),
]

#: A classifier, fingerprints and singular vectors are beyond SQL; tests/llm hold the near-dedup,
#: line and packing stages against brute-force versions, the classifier against labels and
#: decontamination against the planted items.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
