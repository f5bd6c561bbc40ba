"""The driver's entry points."""

import __spark_entry__ as engine
from posekeel.queries import QUERIES


def test_entry(spark):
    rows = engine.entry(spark).collect()
    assert len(rows) == 3 and sum(r.n_frames for r in rows) == 1500


def test_every_sql_has_its_query():
    names = set(engine.queries())
    assert set(QUERIES) <= names and set(engine.oracle_sql()) <= names
