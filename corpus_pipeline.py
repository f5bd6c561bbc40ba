"""Corpus pipeline: from raw documents to a deduplicated, decontaminated mix.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of
documents; the last adds what the mix takes of each document.

In all stages a null or empty text is a document without words, a null id or
source a value like any other, other columns pass through whatever their names
(but for those that the mix adds, which replace columns of theirs), texts are
handled whole however long they are, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posekeel.llm.common import Workspace, read_table
from posekeel.llm.decontaminate import drop_contaminated
from posekeel.llm.line_dedup import line_dedup
from posekeel.llm.minhash_dedup import keep_one
from posekeel.llm.mixing import mix_sources
from posekeel.llm.quality_classifier import quality_classifier


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go: all that score at
    its threshold or above, for their form or for abuse as the labels table marks
    it.  Repeated rows get one score; documents without words are scored by the
    classifier's bias and binned features."""
    return quality_classifier(docs, labelled=read_table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def remove_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site lines stay in one document each, that of least id (in all
    rows of it, if ids repeat); a document that loses lines and of which no word
    is left goes, one that had none stays.  n_chars follows the text."""
    got = line_dedup(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return got.withColumn("n_chars", length).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: that of least id,
    a null one last, one row of those that repeat whole.  Documents without
    words are in no class and all stay."""
    return keep_one(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark passages
    go, just a twentieth included; repeated rows go together, those without
    words stay, and without a benchmark all do."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents the mix does not take go, and
    with them all without words.  Of rows that repeat whole some can be taken."""
    return mix_sources(docs).where("taken > 0")


STAGES = [
    ("quality classifier", reject_low_quality),
    ("line dedup", remove_boilerplate_lines),
    ("minhash near-dedup", remove_near_duplicates),
    ("benchmark decontamination", remove_contaminated),
    ("mixing sources to target weights", mix),
]

#: no SQL: the classifier, the weighted samples and the knapsack have none
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread;
    a stage's table goes when the next one's is written."""
    docs = read_table(spark, sf_dir, "documents")
    work = Workspace(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = work.put(f"stage{i}", docs)
            work.drop(f"stage{i - 1}")
    return docs
