"""Running sums over buckets against plain sorting."""

import random

from posekeel.functions.ranks import sums_before
from posekeel.operators.embeddings import memory_bank, tokens_of

import numpy as np


def test_sums_before(spark):
    rnd = random.Random(1)
    rows = [(g, v, rnd.randint(1, 5)) for g in "ab" for v in rnd.sample([x / 4 for x in range(-200, 200)], 90)]
    df = spark.createDataFrame(rows, "g string, v double, c int").repartition(5)
    for descending in (False, True):
        sign = -1 if descending else 1
        got = {(r.g, r.v): r.before_c for r in sums_before(df, "v", ["c"], ["g"], descending, buckets=7).collect()}
        assert got == {(g, v): sum(c for h, w, c in rows if h == g and sign * w < sign * v) for g, v, _ in rows}
    assert sums_before(df.where("false"), "v", ["c"]).count() == 0
    one = spark.createDataFrame(rows[:1], df.schema)
    assert [r.before_c for r in sums_before(one, "v", ["c"]).collect()] == [0]


def test_bank_of_many_crops():
    crops = [tokens_of(np.random.default_rng(i).normal(size=16), 4) for i in range(50)]
    whole, owners = memory_bank(crops, list(range(50)), 20)
    kept = [u for u in range(50) if (u + 1) * 20 // 50 > u * 20 // 50]
    part, same = memory_bank([crops[u] for u in kept], kept, 20, kept, 50)
    assert owners == same and np.array_equal(whole, part)
