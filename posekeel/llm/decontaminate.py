"""Benchmark decontamination with one Aho-Corasick automaton over words.

Words of the normalised benchmark (A-Z lower-cased) get numbers, and the
automaton's keys are windows of numbers, so a window costs thirteen nodes.
Texts are normalised and scanned once; hits are word numbers, mapped back, on
request, to code point offsets of the original text.  Documents are not
shuffled.  Only a benchmark beyond the size of a block, which bounds what is
broadcast and the automaton in each worker, takes a scan for each block, and
then the hits, which are few, are gathered by document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import count

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import covered_units

#: fixed value: a word of a lower-cased text
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: limits of a block of the benchmark: words, each of which begins a window of
#: the automaton, and bytes, which are broadcast
BLOCK_WORDS = 300_000
BLOCK_TEXT = 8 << 20

# In UTF-8, bytes from 0x80 on belong to non-ASCII characters, all of which
# are word characters; so the rule can be applied to bytes.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256)
)


def _words(raw: bytes) -> list[bytes]:
    return [w for w in raw.translate(_TABLE).split(b" ") if w]


def item_blocks(items: Iterator[tuple[str, str | None]], length: int) -> Iterator[list[tuple[str, bytes]]]:
    """Blocks of (item id, joined words); an item longer than a block goes to
    several, which overlap by a window less one word."""
    block: list[tuple[str, bytes]] = []
    count = size = 0
    for item, text in items:
        words = _words((text or "").encode())
        at = 0
        while at < len(words):
            part, held = [], 0
            for w in words[at : at + BLOCK_WORDS + length - 1]:
                if held > BLOCK_TEXT and len(part) >= length:
                    break
                part.append(w)
                held += len(w) + 1
            if block and (count + len(part) > BLOCK_WORDS or size + held > BLOCK_TEXT):
                yield block
                block, count, size = [], 0, 0
            block.append((item, b" ".join(part)))
            count, size = count + len(part), size + held
            if at + len(part) == len(words):
                break
            at += len(part) - length + 1
    if block:
        yield block


class Benchmark:
    """Automaton of one block: the value of a window is its number, by which
    it has a number of words and the items it stands in."""

    def __init__(self, items: list[tuple[str, bytes]], length: int):
        self.numbers: dict[bytes, int] = {}
        self.names: list[str] = [name for name, _ in items]
        self.sizes: list[int] = []
        self.owners: list[list[int]] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, (_, joined) in enumerate(items):
            own = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in joined.split(b" ")]
            for i in range(max(1, len(own) - length + 1)):
                key = tuple(own[i : i + length])
                at = self.automaton.get(key, -1)
                if at < 0:
                    self.automaton.add_word(key, len(self.sizes))
                    self.sizes.append(len(key))
                    self.owners.append([k])
                elif self.owners[at][-1] != k:
                    self.owners[at].append(k)
        self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> list[tuple[int, int, list[int]]]:
        """(first word, word after the last, items) of each window found."""
        if not self.sizes:
            return []
        get = self.numbers.get
        numbers = tuple([get(w, 0) for w in words])
        return [(end + 1 - self.sizes[w], end + 1, self.owners[w]) for end, w in self.automaton.iter(numbers)]


_BUILT: dict[int, Benchmark] = {}


def _benchmark(block: Broadcast, number: int, length: int) -> Benchmark:
    """The block's automaton, kept by a worker for its next task."""
    if number not in _BUILT:
        _BUILT.clear()
        _BUILT[number] = Benchmark(block.value, length)
    return _BUILT[number]


def _hit_rows(block: Broadcast, number: int, length: int, columns: list[str], text: str, every: bool):
    """first, last and item of each hit, as arrays, for ``every`` row or those
    with hits; and n_words."""
    extra = pa.schema([("n_words", pa.int64()), ("first", pa.list_(pa.int32())), ("last", pa.list_(pa.int32())), ("item", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _benchmark(block, number, length)
        for batch in batches:
            rows, out = [], ([], [], [], [])
            for k, value in enumerate(batch.column(text)):
                raw = value.as_py()
                words = _words(raw.encode()) if raw else []
                found = known.hits(words)
                if not (found or every):
                    continue
                rows.append(k)
                each = [(a, b, known.names[i]) for a, b, items in found for i in items]
                for column, new in zip(out, (len(words), [e[0] for e in each], [e[1] for e in each], [e[2] for e in each])):
                    column.append(new)
            kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in columns]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(c, f.type) for c, f in zip(out, extra)], names=[*columns, *extra.names])

    return run


def _judged(text: str, columns: list[str], spans: bool):
    """Counts, digest and spans from the gathered hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, n_items, shas, found = [], [], [], []
            rows = zip(*[batch.column(c).to_pylist() for c in ("n_words", "first", "last", "item")])
            for k, (n_words, first, last, item) in enumerate(rows):
                names = sorted(set(item or ()))
                n_hit.append(int(covered_units(n_words, np.array(first), np.array(last)).sum()) if first else 0)
                n_items.append(len(names))
                shas.append(hashlib.sha256(",".join(names).encode()).hexdigest())
                own = []
                if spans and first:
                    at = [m.span() for m in WORD.finditer(batch.column(text)[k].as_py().translate(_LOWER))]
                    own = [{"item_id": i, "start": at[a][0], "end": at[b - 1][1]} for a, b, i in sorted(set(zip(first, last, item)))]
                found.append(own)
            out = [batch.column(c) for c in columns] + [batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(shas, pa.string())]
            names = [*columns, "n_words", "n_hit", "n_items", "items_sha256"]
            if spans:
                out.append(pa.array(found, pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _with_hits(source: DataFrame, benchmark: DataFrame, columns: list[str], text: str, item_col: str, item_text_col: str, length: int) -> DataFrame:
    """``source`` with n_words and the arrays first, last and item."""
    items = ((("" if r[0] is None else str(r[0])), r[1]) for r in benchmark.select(item_col, item_text_col).toLocalIterator())
    sc = source.sparkSession.sparkContext
    extra = [T.StructField("n_words", T.LongType()), *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("first", "last")], T.StructField("item", T.ArrayType(T.StringType()))]
    blocks = [(sc.broadcast(b), next(_NUMBERS)) for b in item_blocks(items, length)] or [(sc.broadcast([]), next(_NUMBERS))]
    if len(blocks) == 1:
        schema = T.StructType([source.schema[c] for c in columns] + extra)
        return source.mapInArrow(_hit_rows(*blocks[0], length, columns, text, True), schema)
    keys = list(dict.fromkeys([*columns, text]))
    keyed = source.withColumns({"_ka": F.xxhash64(*keys), "_kb": F.xxhash64(F.lit(17), *keys[::-1])})
    schema = T.StructType([T.StructField("_ka", T.LongType()), T.StructField("_kb", T.LongType())] + extra)
    parts = [keyed.select("_ka", "_kb", text).mapInArrow(_hit_rows(*b, length, ["_ka", "_kb"], text, False), schema) for b in blocks]
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    # rows with one key repeat whole, and so do their hits: one of each is enough
    once = hits.select("_ka", "_kb", F.explode(F.arrays_zip("first", "last", "item")).alias("h")).groupBy("_ka", "_kb").agg(F.collect_set("h").alias("h"))
    arrays = [F.col(f"h.{c}").alias(c) for c in ("first", "last", "item")]
    none = _hit_rows(sc.broadcast([]), next(_NUMBERS), length, [*columns, "_ka", "_kb"], text, True)
    counted = keyed.mapInArrow(none, T.StructType([*[keyed.schema[c] for c in (*columns, "_ka", "_kb")], *extra])).drop("first", "last", "item")
    return counted.join(once.hint("shuffle_hash"), ["_ka", "_kb"], "left").select(*columns, "n_words", *arrays)


_NUMBERS = count()
_LOWER = {c: c + 32 for c in range(65, 91)}


def decontaminate(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = 13, spans: bool = True
) -> DataFrame:
    """Words of each text that lie in an occurrence of a benchmark window.

    A window is ``length`` consecutive words of an item; an item with fewer
    words, but not none, is one window.  One row per input row: the id,
    n_words, n_hit, n_items, items_sha256, contaminated (a twentieth of the
    words or more are hit) and, if ``spans``, spans (item_id, start, end in
    code points of the original text, one for each window and item).  Null
    texts and items, and empty ones, have no words; items with one id count as
    one, a null item id is the empty string; repeated rows are judged alike;
    there are no ties; a very long text is held by one worker, a very long item
    goes to several blocks; an empty table, or an empty benchmark, is no special
    case; other columns are not read, whatever their names."""
    source = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = T.StructType(
        [T.StructField("_id", source.schema["_id"].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("n_words", "n_hit", "n_items")]
        + [T.StructField("items_sha256", T.StringType())]
    )
    if spans:
        span = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
        schema.add("spans", T.ArrayType(span))
    hits = _with_hits(source, benchmark, ["_id", "_text"] if spans else ["_id"], "_text", item_col, item_text_col, length)
    judged = hits.mapInArrow(_judged("_text", ["_id"], spans), schema)
    contaminated = (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
    names = [c for c in schema.names if c not in ("_id", "spans")]
    return judged.select(F.col("_id").alias(id_col), *names, contaminated.alias("contaminated"), *(["spans"] if spans else []))


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = 13) -> DataFrame:
    """The rows of ``df`` that are not contaminated, with all their columns;
    rules and odd cases as in ``decontaminate``."""
    names = [f"_c{i}" for i in range(len(df.columns))]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, df.schema)])
    for c in ("n_words", "n_hit", "n_items"):
        schema.add(c, T.LongType())
    schema.add("items_sha256", T.StringType())
    hits = _with_hits(df.toDF(*names), benchmark, names, names[df.columns.index(text_col)], item_col, item_text_col, length)
    judged = hits.mapInArrow(_judged(names[df.columns.index(text_col)], names, False), schema)
    clean = judged.where((F.col("n_hit") == 0) | (F.col("n_hit") * 20 < F.col("n_words")))
    return clean.select(*names).toDF(*df.columns)
