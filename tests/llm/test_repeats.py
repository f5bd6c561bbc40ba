"""Operators 2 and 5 against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from posekeel.llm import suffix_dedup as suffix_module
from posekeel.llm.common import Workspace
from posekeel.llm.repeats import with_key
from posekeel.llm.substring_dedup import repeated_word_runs, substring_dedup
from posekeel.llm.suffix_dedup import repeated_places, suffix_dedup

RUNS = pa.schema([("ida", pa.int64()), ("idb", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cover(n, starts, length):
    gone = [False] * n
    for s in starts:
        for i in range(s, s + length):
            gone[i] = True
    return gone


def brute(units_of_texts, length):
    seen = Counter(tuple(u[i : i + length]) for u in units_of_texts for i in range(len(u) - length + 1))
    return [cover(len(u), [i for i in range(len(u) - length + 1) if seen[tuple(u[i : i + length])] > 1], length) for u in units_of_texts]


def corpus(seed, words):
    rnd = random.Random(seed)
    pieces = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))) for _ in range(8)]
    texts = [rnd.choice([" ", "\n", "\t "]).join(rnd.choice(pieces) for _ in range(rnd.randint(0, 6))) for _ in range(40)]
    return [*texts, None, "", " \n", texts[3], "é" * 30, " ".join(["ab"] * 200)]


def frame(spark, texts):
    ids = [None if i == 5 else min(i, 30) for i in range(len(texts))]  # a null id, repeated ids
    return spark.createDataFrame([(i, t, None, "x") for i, t in zip(ids, texts)], "doc_id long, text string, n_words long, _id string").repartition(5)


@pytest.mark.parametrize("length", [1, 2, 5, 6, 9, 12])
def test_substring_dedup(spark, length):
    texts = corpus(length, ["a", "b", "cé", "dd"])
    units = [WORD.findall(t or "") for t in texts]
    expected = Counter()
    for t, u, gone in zip(texts, units, brute(units, length)):
        kept = " ".join(w for w, g in zip(u, gone) if not g)
        expected[(len(u), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)] += 1
    rows = substring_dedup(frame(spark, texts), length=length).drop("doc_id").collect()
    assert Counter(map(tuple, rows)) == expected


@pytest.mark.parametrize(("length", "strings"), [(8, 1024), (16, 2), (40, 3)])
def test_suffix_dedup(spark, length, strings, monkeypatch):
    """A core with more than so many strings is dealt out anew by longer runs."""
    monkeypatch.setattr(suffix_module, "CORE_STRINGS", strings)
    texts = corpus(length, ["a", "b", "é"])
    units = [(t or "").encode() for t in texts]
    expected = Counter()
    for u, gone in zip(units, brute(units, length)):
        kept = bytes(b for b, g in zip(u, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        expected[(len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)] += 1
    rows = suffix_dedup(frame(spark, texts), length=length).drop("doc_id").collect()
    assert Counter((*r[:4], bytes(r[4])) for r in rows) == expected


def test_merged_transforms(monkeypatch):
    rnd = random.Random(1)
    for _ in range(150):
        monkeypatch.setattr(suffix_module, "SHARD_BYTES", rnd.choice([10, 40, 1000]))
        length, step = rnd.choice([(4, 1), (8, 2), (12, 3), (12, 1), (16, 2)])
        pieces = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 30))) for _ in range(4)]
        texts = [b"".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 4))) for _ in range(rnd.randint(1, 8))]
        weights = [rnd.choice([1, 1, 3]) for _ in texts]
        seen = Counter()
        for t, w in zip(texts, weights):
            for i in range(len(t) - length + 1):
                seen[t[i : i + length]] += w
        expected = [[seen[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] for t in texts]
        assert [list(map(bool, x)) for x in repeated_places(texts, weights, length, step)] == expected


def test_levels_double_until_none_is_left(spark):
    rnd = random.Random(3)
    words = lambda n: " ".join(str(rnd.randrange(10**6)) for _ in range(n))
    shared, short = words(1300), words(150)
    texts = [shared, f"{words(50)} {shared}", f"{short} {words(1200)}", f"{words(1000)} {short}", words(1500)]
    docs = with_key(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    seen = []
    _, runs = repeated_word_runs(Workspace(spark), docs, 1000, lambda length, n: seen.append((length, n)))
    assert [length for length, _ in seen] == [8, 16, 32, 63, 125, 250, 500, 1000]
    assert all(n > 0 for _, n in seen) and runs.count() == seen[-1][1]
    _, none = repeated_word_runs(Workspace(spark), docs.where("_id > 1"), 1000, lambda length, n: seen.append((length, n)))
    assert none is None and seen[-1][1] == 0 and seen[-1][0] < 1000  # ended early


def test_all_removed_bytes_come_from_the_merge(spark, monkeypatch):
    texts = corpus(5, ["a", "b", "é"])
    assert sum(r.n_removed for r in suffix_dedup(frame(spark, texts), length=16).collect()) > 0
    nothing = lambda length, step: lambda batches: (pa.RecordBatch.from_pylist([], RUNS) for _ in batches)
    monkeypatch.setattr(suffix_module, "_merge", nothing)
    assert sum(r.n_removed for r in suffix_dedup(frame(spark, texts), length=16).collect()) == 0


def test_repeated_rows(spark):
    """Thousands of equal rows are one text to look at."""
    rnd = random.Random(4)
    text = " ".join(str(rnd.randrange(10**6)) for _ in range(3000))
    same = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(8)
    assert substring_dedup(same, keep_text=False).select("n_words", "n_removed").distinct().collect() == [(3000, 3000)]
    assert suffix_dedup(same, keep_text=False).select("n_bytes", "n_removed", "n_spans").distinct().collect() == [(len(text), len(text), 1)]


def test_very_long_texts(spark):
    """Texts over several stripes, and a word over several, among short ones."""
    rnd = random.Random(5)
    word = "".join(rnd.choice("abcdef") for _ in range(1_300_000))
    body = " ".join(str(rnd.randrange(10**6)) for _ in range(300_000))
    part = body[700_000:703_000]
    texts = [body, f"x {part} y", word, f"a {word[400_000:401_000]} b", f"{word} end"]
    expected = [brute_bytes(t, texts, 400) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup(df, keep_text=False).collect()}
    assert [got[i] for i in range(5)] == expected
    words = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(df, keep_text=False).collect()}
    inner = len(part.split())
    assert words[0][0] == 300_000 and inner - 2 <= words[0][1] == words[1][1] <= inner and words[2] == (1, 0)
    assert words[4] == (2, 0)


def brute_bytes(text, texts, length):
    """Bytes of ``text`` in strings that start twice, from numpy views."""
    seen = Counter()
    for t in texts:
        raw = t.encode()
        seen.update(hash(raw[i : i + length]) for i in range(len(raw) - length + 1))
    raw = text.encode()
    steps = np.zeros(len(raw) + 1, np.int64)
    for i in range(len(raw) - length + 1):
        if seen[hash(raw[i : i + length])] > 1:
            steps[i] += 1
            steps[i + length] -= 1
    return int((np.cumsum(steps[:-1]) > 0).sum())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(empty).count() == 0
    assert suffix_dedup(empty).count() == 0
