"""Operator 10: budgets, exact sums and totals against brute force."""

import itertools
import random
from collections import defaultdict

from posekeel.llm import mixing
from posekeel.llm.mixing import _nearest_sum, fit_counts, mix_sources, water_fill


def test_water_fill_shares_all():
    assert water_fill([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    targets = water_fill([10, 1000, 1000], [5, 2, 1])
    assert targets[0] == 30 and abs(sum(targets) - 2010) < 1e-9
    assert all(t <= 3 * s + 1e-9 for t, s in zip(targets, [10, 1000, 1000]))
    assert water_fill([], []) == [] and water_fill([0, 5], [5, 2]) == [0.0, 5.0]


def test_knapsack_is_exact():
    rnd = random.Random(3)
    for _ in range(60):
        lengths = rnd.sample(range(1, 15), 4)
        counts = [rnd.randint(0, 3) for _ in lengths]
        budget = rnd.randint(0, 40)
        best = max(s for c in itertools.product(*[range(n + 1) for n in counts]) if (s := sum(a * b for a, b in zip(c, lengths))) <= budget)
        got = _nearest_sum(lengths, counts, budget, budget)
        assert all(g <= c for g, c in zip(got, counts))
        assert sum(a * b for a, b in zip(got, lengths)) == best


def test_fit_counts_is_near():
    rnd = random.Random(4)
    for most in (40, 1):
        for _ in range(60):
            lengths = sorted(rnd.sample(range(1, 500), 12))
            counts = [rnd.randint(1, most) for _ in lengths]
            total = sum(a * b for a, b in zip(lengths, counts))
            budget = rnd.randint(0, total)
            got = fit_counts(lengths, counts, budget)
            assert all(0 <= g <= c for g, c in zip(got, counts))
            best = min(abs(sum(c) - budget) for n in range(13) for c in itertools.combinations(lengths, n)) if most == 1 else lengths[0]
            assert abs(sum(a * b for a, b in zip(got, lengths)) - budget) <= best


def test_long_documents_of_unique_lengths_are_settled():
    lengths = [12000, 13000, 14000, 15000, 16000]
    assert fit_counts(lengths, [1] * 5, 39000) == [1, 1, 1, 0, 0]
    assert fit_counts([10007, 15013, 20011], [1, 1, 1], 30030) == [1, 0, 1]
    rnd = random.Random(6)
    for _ in range(40):
        lengths = sorted(rnd.sample(range(5000, 20000), 8))
        budget = rnd.randint(0, 4 * lengths[-1])
        best = min(abs(sum(c) - budget) for n in range(9) for c in itertools.combinations(lengths, n))
        got = fit_counts(lengths, [1] * 8, budget)
        assert set(got) <= {0, 1} and abs(sum(a * b for a, b in zip(got, lengths)) - budget) == best


def rows(seed):
    rnd = random.Random(seed)
    sources = ["b", "a", None, "é", "", "c"]
    out = [(i % 150, " ".join("w" * rnd.randint(1, 40)) if rnd.random() < 0.9 else None, rnd.choice(sources)) for i in range(300)]
    return [*out, *[(None, "x y z", "a")] * 6, (1, " \t", "b")]


def test_mix(spark):
    data = rows(5)
    frame = spark.createDataFrame([(*r, 1, "t") for r in data], "doc_id long, text string, source string, size int, target string")
    got = mix_sources(frame).collect()
    assert mix_sources(frame.repartition(7)).groupBy().sum("taken").first()[0] == sum(r.taken for r in got)
    assert sorted(map(str, ((r.doc_id, r.text, r.source) for r in got))) == sorted(map(str, data))
    size = lambda t: len((t or "").split())
    total = defaultdict(int)
    for _, t, s in data:
        total[s] += size(t)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, water_fill([total[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    taken = defaultdict(int)
    for r in got:
        assert r.size == size(r.text) and r.source_size == total[r.source] and abs(r.target - targets[r.source]) < 1e-6
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - targets[s]) <= 1 or abs(taken[s] - targets[s]) < 0.02 * max(total[s], 50)


def test_repeated_rows_and_joins_by_shuffle(spark, monkeypatch):
    """Of equal rows some are taken; a table of cuts too large to broadcast gives the same."""
    data = [(1, "a b c", "s")] * 50 + [(2, "d e", "t")] * 100
    frame = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mix_sources(frame, weights=(1, 2)).collect()
    taken = {s: sum(r.taken for r in got if r.source == s) for s in "st"}
    assert len(got) == 150 and abs(taken["s"] - 350 / 3) <= 2 and abs(taken["t"] - 700 / 3) <= 2
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    again = mix_sources(frame, weights=(1, 2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = spark.createDataFrame([(*r, 1, "t") for r in rows(7)], "doc_id long, text string, source string, size int, target string")
    shuffled = sorted(map(str, mix_sources(mixed).collect()))
    monkeypatch.undo()
    assert sorted(map(str, mix_sources(mixed).collect())) == shuffled


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
