"""The pipeline's stages, each against the operator it calls, and odd rows."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from posekeel.llm.decontaminate import decontaminate
from posekeel.llm.minhash_dedup import near_duplicates
from posekeel.llm.oracles import ORACLES
from posekeel.llm.quality_classifier import quality_classifier
from posekeel.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).persist())
    assert [f.columns for f in seen[1:-1]] == [columns] * 4
    quality, lines, one, clean, mixed = seen[1:]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids(quality) == ids(quality_classifier(docs, labelled=labels).where("kept"))
    assert set(ids(lines)) <= set(ids(quality)) and lines.where("n_chars <> length(text) and n_chars is not null").count() == 0
    classes = near_duplicates(lines).collect()
    assert ids(one) == sorted({r.class_id for r in classes})
    judged = decontaminate(one, spark.read.parquet(f"{SF}/benchmark.parquet"), spans=False)
    assert ids(clean) == ids(judged.where("not contaminated"))
    assert mixed.where("taken = 0 or taken > 3 * size").count() == 0 and set(ids(mixed)) <= set(ids(clean))
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m")).collect():
        assert abs(r.t - r.g) <= r.m


def test_odd_rows(spark):
    """Nulls everywhere, repeated rows and clashing names go through all stages."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(None, None, None, None, None), (1, words, "en", "a", 5), (1, words, "en", "a", 5), (2, words + " x", None, None, None), (3, "", "en", "b", 0), (4, " \n", "en", "b", 2), (5, "one line\n" * 50, "en", "c", 1)]
    extra = {c: F.lit(1) for c in ("c", "kept", "label", "size", "passes", "host", "copies", "n_words", "bare", "sites")}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(extra)
    for frame in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, SF).persist()
            assert set(extra) <= set(frame.columns)
            frame.count()
    assert frame.count() == 0


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    expected, got = con.execute(ORACLES[name]).df(), QUERIES[name](spark, SF).toPandas()
    assert sorted(expected.columns) == sorted(got.columns)
    rows = lambda f: sorted(tuple("~" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in f[sorted(f.columns)].itertuples(index=False))
    assert rows(expected) == rows(got)
