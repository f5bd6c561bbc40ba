"""Operator 6 against brute force over all pairs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from posekeel.llm.common import text_blocks
from posekeel.llm.minhash_dedup import _sets, counted, inverse_frequencies, keep_one, near_duplicates, samples, shingles, weighted_jaccard
from posekeel.llm.repeats import with_key


def edited(rnd, words, share):
    return [w if rnd.random() > share else f"z{rnd.randint(0, 10**6)}" for w in words]


def corpus(seed):
    rnd = random.Random(seed)
    texts = []
    for _ in range(25):
        base = [f"w{rnd.randint(0, 300)}" for _ in range(rnd.randint(3, 300))]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 4)):
            texts.append("  ".join(edited(rnd, base, rnd.choice([0, 0.002, 0.01, 0.03, 0.2]))))
    hub = [f"h{i}" for i in range(150)]  # a diffuse group: near the hub, less near each other
    texts += [" ".join(edited(rnd, hub, 0.012)) for _ in range(40)] + [" ".join(hub)]
    texts += [None, "", " \n", "one", "one", "a b c", "x " * 3000, "x " * 2900, "x " * 100]
    rnd.shuffle(texts)
    return texts


def brute(texts, ids, table, threshold):
    sets = _sets([t or "" for t in texts], table)
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if weighted_jaccard(sets[i], sets[j]) >= threshold - 1e-9:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(texts)):
        r = find(i)
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(find(i)) if (texts[i] or "").split() else ids[i] for i in range(len(texts))]


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    rates = []
    for _ in range(40):
        h = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
        w = rng.gamma(1.0, 2.0, 400) + 0.1
        v = np.where(rng.random(400) < 0.4, w * rng.random(400) * 2 + 0.01, w)
        true = np.minimum(w, v).sum() / np.maximum(w, v).sum()
        a, b = samples(h, np.zeros(400, int), w), samples(h, np.zeros(400, int), v)
        rates.append(((a == b).mean(), true**3))
    got, expected = np.array(rates).mean(0)
    assert abs(got - expected) < 0.06


def test_against_all_pairs(spark):
    for seed in range(2):
        texts = corpus(seed)
        ids = [None if i == 4 else i for i in range(len(texts))]
        frame = spark.createDataFrame([(i, t, "clash") for i, t in zip(ids, texts)], "doc_id long, text string, label string").repartition(5)
        table = inverse_frequencies(with_key(frame, "doc_id", "text"))
        expected = Counter(zip(ids, brute(texts, ids, table, 0.8)))
        assert Counter(map(tuple, near_duplicates(frame).collect())) == expected
        kept = keep_one(frame).collect()
        assert kept[0].asDict().keys() == {"doc_id", "text", "label"}
        classes = {c for i, c in expected if c is not None}
        assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(classes)


def test_repeated_rows_and_empty(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(7, long)] * 3 + [(3, long + " end"), (1, None), (1, None), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, near_duplicates(frame).collect())) == Counter([(7, 3)] * 3 + [(3, 3), (1, 1), (1, 1), (None, None)])
    assert Counter(r.doc_id for r in keep_one(frame).collect()) == Counter([3, 1, 1, None])
    assert [r.doc_id for r in keep_one(frame.where("doc_id = 7")).collect()] == [7]
    assert near_duplicates(frame.where("false")).count() == 0 and keep_one(frame.where("false")).count() == 0


def test_shingles_of_short_texts():
    block = next(text_blocks(pa.array(["a b", "", "a b c d e f", "a  b"])))
    h, text, na, _ = shingles(block)
    assert text.tolist() == [0, 2, 2, 3] and h[0] == h[3] and na[0] == na[3]
    assert counted(np.array([5, 5, 2], np.uint64), np.array([0, 0, 0]))[2].tolist() == [1, 2]
