"""Operators 3 and 9 against brute force; neither plan may hold Python."""

import random
import re
from collections import Counter, defaultdict

from posekeel.llm.line_dedup import line_dedup
from posekeel.llm.quality_rules import base_columns, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def base(text):
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def texts(seed):
    rnd = random.Random(seed)
    words = ["a", "bé", "c#", "|", "Dd", "e*e"]
    make = lambda n, v: "".join(rnd.choice(v) + rnd.choice([" ", "\n", "  ", "\t", "\x0b"]) for _ in range(rnd.randint(0, n)))
    many = [f"w{i}" for i in range(200)]
    return [make(30, words) for _ in range(30)] + [make(60, many) for _ in range(30)] + [None, "", "\n\n", "x " * 3000, "a b c d e", "a b c d e f a b c d e", "a a a a a a"]


def test_base_counts(spark):
    data = texts(1)
    frame = spark.createDataFrame([(i, t or "") for i, t in enumerate(data)], "i int, t string")
    for r in base_columns(frame, "t").collect():
        b = base(data[r.i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b, data[r.i]
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0])


def test_verdicts(spark):
    rnd = random.Random(2)
    good = [" ".join(rnd.choice(["river", "stone", "walker", "gather"]) + str(rnd.randint(0, 9)) for _ in range(60)) for _ in range(40)]
    junk = [" ".join(rnd.choice(["ZZ!!", "QQ!!", "#%|"]) + str(rnd.randint(0, 9)) + "!!" for _ in range(60)) for _ in range(10)]
    rows = [(i, t, 1.0) for i, t in enumerate(good + junk)] + [(None, None, 0.0), (3, good[3], 0.0), (99, "", 0.0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score double")
    trusted = spark.createDataFrame([(i,) for i in range(30)] + [(None,), (3,)], "doc_id long")
    result = quality_rules(frame, trusted)
    got = result.collect()
    assert len(got) == len(rows) and "Python" not in plan(result) and "Arrow" not in plan(result)
    kept = defaultdict(set)
    for r in got:
        kept[r.doc_id].add(r.kept and not r.base_failed)
    assert all(kept[i] == {True} for i in range(40) if base(good[i])[4] * 5 <= 60)
    assert all(kept[i] == {False} for i in (*range(40, 50), None, 99))
    assert quality_rules(frame.where("false"), trusted).count() == 0
    assert quality_rules(frame, trusted.where("false")).where("score <> 0").count() == 0


def brute_lines(rows, min_sites):
    sites, holder = defaultdict(set), {}
    edge = " \t\x0b\x0c\r"
    for doc, text, site in rows:
        for x in (text or "").split("\n"):
            if k := x.strip(edge):
                sites[k].add(site)
                if doc is not None:
                    holder[k] = min(holder.get(k, doc), doc)
    out = Counter()
    for doc, text, site in rows:
        if text is None:
            out[(doc, None, site, 0, 0)] += 1
            continue
        kept, gone = [], 0
        for x in text.split("\n"):
            k = x.strip(edge)
            if k and len(sites[k]) >= min_sites and doc != holder.get(k):
                gone += 1
            else:
                kept.append(x)
        out[(doc, "\n".join(kept), site, sum(bool(x.strip(edge)) for x in text.split("\n")), gone)] += 1
    return out


def test_line_dedup(spark):
    rnd = random.Random(3)
    common = [f"common {i}" for i in range(12)]
    rows = []
    for i in range(120):
        lines = [rnd.choice([*common[: rnd.randint(1, 12)], f" own {rnd.randint(0, 60)} ", "", " \t"]) for _ in range(rnd.randint(0, 8))]
        rows.append((i if i % 11 else None, "\n".join(lines), rnd.choice([None, "", *"abcdefgh"])))
    rows += [(5, None, "a"), (6, "", "a"), (7, "common 0\r\n" * 2000, "z"), *[(200, "null only", None)] * 3]
    for min_sites in (2, 4, 8):
        result = line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=min_sites)
        assert Counter(map(tuple, result.collect())) == brute_lines(rows, min_sites)
        assert "Python" not in plan(result) and "Arrow" not in plan(result)
    clash = spark.createDataFrame([(1, "a", "s", 9)], "doc_id long, text string, source string, n_lines int")
    assert line_dedup(clash).columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    assert line_dedup(clash.where("false")).count() == 0
