"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from posekeel.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame):
    def text(v):
        return "~" if pd.isna(v) else format(float(v), ".6g") if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(text(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    spark.catalog.clearCache()
    assert len(got)
    if name in ORACLES:
        expected = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)


def test_group_similarity_counts_all_rows(spark, tmp_path):
    data = pd.DataFrame({"vec_id": [1, 2, 3, 50], "label": [0, 0, 1, 1], "embedding": [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [0.0, 0.0]]})
    data.to_parquet(tmp_path / "embeddings.parquet")
    got = {(r.label, r.other): r.similarity for r in QUERIES["group_similarity"](spark, str(tmp_path)).collect()}
    assert got == {(0, 0): 0.5, (0, 1): 0.25, (1, 0): 0.25, (1, 1): 0.25}


def test_every_query_row_has_its_neighbors(spark, duck, tmp_path):
    data = pd.DataFrame({"vec_id": range(8, 408), "label": 0, "embedding": [[float(i % 7), float(i % 3)] for i in range(400)]})
    data.to_parquet(tmp_path / "embeddings.parquet")
    sql = ORACLES["nearest_neighbors"].replace("embeddings", f"'{tmp_path}/embeddings.parquet'")
    got = QUERIES["nearest_neighbors"](spark, str(tmp_path)).toPandas()
    assert set(got["query_id"]) == set(range(50, 408, 50)) and rows(got) == rows(duck.execute(sql).df())


def test_nearest_of_one_row(spark):
    from posekeel.operators import embeddings

    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "vec_id long, v array<double>")
    got = embeddings.nearest(frame, 1, "vec_id", "v", k=1).toPandas()
    assert got[["vec_id", "distance"]].values.tolist() == [[3, 0.0]]
    assert embeddings.nearest(frame, 7, "vec_id", "v").count() == 0  # there is no id 7


def test_nearest_by_blocks(spark, monkeypatch):
    from posekeel.operators import embeddings

    frame = spark.range(300).selectExpr("id AS vec_id", "array(cos(id * 7), sin(id * 7)) AS v").repartition(5)
    whole = embeddings.nearest_each(frame, frame.where("vec_id % 10 = 0"), "vec_id", "v").toPandas()
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 4)
    parts = embeddings.nearest_each(frame, frame.where("vec_id % 10 = 0"), "vec_id", "v").toPandas()
    assert len(whole) == 150 and rows(whole) == rows(parts)
