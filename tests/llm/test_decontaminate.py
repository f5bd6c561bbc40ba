"""Operator 1 against brute force."""

import hashlib
import random
import re

from posekeel.llm import decontaminate as module
from posekeel.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, length):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - length + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + length]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                ids = windows.get(tuple(w[i : i + n]))
                if ids:
                    found |= ids
                    hit |= set(range(i, i + n))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def case(seed):
    rnd = random.Random(seed)
    vocabulary = ["a", "B", "été", "Été", "x1", "-", "c-d", "\x00", "İ"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, n)))
    items = [(i % 9, text(8)) for i in range(12)] + [(None, "a B"), (20, None), (21, ""), (22, "--"), (3, text(6))]
    docs = [(i % 25, text(40)) for i in range(30)] + [(None, items[0][1]), (40, None), (41, ""), (42, "A-b" * 40)]
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    for seed in range(3):
        docs, items = case(seed)
        if seed == 2:
            monkeypatch.setattr(module, "BLOCK_WORDS", 5)  # several blocks, and items over several
        d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, n_words string")
        b = spark.createDataFrame(items, "item_id long, text string")
        rows = decontaminate(d, b, length=4, spans=False).collect()
        assert sorted(map(str, map(tuple, rows))) == sorted(map(str, brute(docs, items, 4)))


def test_spans_are_offsets_of_the_original(spark):
    d = spark.createDataFrame([(1, "xx Éa, BEE --  c! yy")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "Éa bee c")], "item_id long, text string")
    row = decontaminate(d, b, length=3).first()
    assert [(s.item_id, row and "xx Éa, BEE --  c! yy"[s.start : s.end]) for s in row.spans] == [("7", "Éa, BEE --  c")]


def test_blocks_of_long_items_overlap(monkeypatch):
    monkeypatch.setattr(module, "BLOCK_WORDS", 6)
    text = " ".join(f"w{i}" for i in range(50))
    blocks = list(module.item_blocks(iter([("a", text), ("b", "x y"), ("c", None)]), 4))
    found = {w for block in blocks for _, j in block for n in [j.split(b" ")] for i in range(max(1, len(n) - 3)) for w in [tuple(n[i : i + 4])]}
    assert found == {tuple(f"w{k}".encode() for k in range(i, i + 4)) for i in range(47)} | {(b"x", b"y")}
    assert all(sum(len(j.split()) for _, j in b) <= 6 + 3 for b in blocks)


def test_long_text(spark):
    item = " ".join(f"q{i}" for i in range(14))
    text = "w " * 400_000 + item + " w" * 400_000
    row = decontaminate(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([("i", item)], "item_id string, text string")).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (800_014, 14, 1, False)
    assert [text[s.start : s.end].split()[0] for s in row.spans] == ["q0", "q1"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(none, items).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert tuple(decontaminate(one, items, spans=False).first())[:4] == (1, 2, 0, 0)
