"""The thin opN_<name> queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .decontaminate import decontaminate
from .html_extraction import extract_text
from .line_dedup import line_dedup
from .minhash_dedup import near_duplicates
from .mixing import mix_sources
from .oracles import ORACLES
from .quality_classifier import quality_classifier
from .quality_rules import quality_rules
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .warc import warc_roundtrip


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), length=13, spans=False)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"), length=35, keep_text=False)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    return quality_rules(read_table(spark, sf_dir, "documents"), trusted).drop("score")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_classifier(read_table(spark, sf_dir, "documents"), labelled=read_table(spark, sf_dir, "labels"))
    return got.select("doc_id", "p_bad", "kept")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_table(spark, sf_dir, "documents"), length=400, keep_text=False)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_roundtrip(read_table(spark, sf_dir, "pages"), min_bytes=0).drop("url")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup(read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_substring_dedup, op3_quality_rules, op4_quality_classifier, op5_suffix_dedup,
        op6_minhash_dedup, op7_warc_revisits, op8_html_extraction, op9_line_dedup, op10_mix_sources,
    )
}

__all__ = ["ORACLES", "QUERIES"]
