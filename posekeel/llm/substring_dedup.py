"""Substring deduplication by level-wise doubling of repeated word windows.

The levels' lengths double from eight words or so up to the window's (35: 9,
18, 35).  At a level, only runs of its length that occur twice or more stay
candidates; those are extended to the next length, on the side on which the
window has room, until the window's length is reached or no candidate is left.
Runs of the first level are looked at in minimiser places only, which is exact:
equal windows have equal minimisers.  Nothing else decides what is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rolling, Workspace, covered_units, signed, text_blocks, word_spans
from .repeats import PART, SEGMENT, level_lengths, parts_with_texts, range_arrays, ranges_by_text, repeated_segments, representatives, split_parts, survivors, taken_parts, unit_codes, with_key, with_texts

PARTS = "gram long, sa long, copies long, at int, i int, j int, c int, _ka long, _kb long, core long"


def _core_rows(longer: int):
    """Hash of each part's core of ``longer`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, text, parts in taken_parts(batches):
            codes, bounds = unit_codes(block, "word")
            start = bounds[text] + parts["at"] + parts["c"]
            core = Rolling(codes)(start, start + longer)
            names = [*PART, "ka", "kb"]
            yield pa.RecordBatch.from_arrays([pa.array(parts[c]) for c in names] + [pa.array(signed(core))], names=[*PART, "_ka", "_kb", "core"])

    return run


def _window_rows(length: int):
    """The windows of each part, with two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, text, parts in taken_parts(batches):
            codes, bounds = unit_codes(block, "word")
            n = parts["j"] - parts["i"] + 1
            part = np.repeat(np.arange(len(n)), n)
            window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + parts["i"][part]
            at = (bounds[text] + parts["at"])[part] + window
            hashes = [signed(Rolling(codes, which)(at, at + length)) for which in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts[c][part]) for c in (*SEGMENT, "copies")] + [pa.array(window.astype(np.int32)), *map(pa.array, hashes)],
                names=[*SEGMENT, "copies", "i", "wa", "wb"],
            )

    return run


def repeated_word_runs(work: Workspace, docs: DataFrame, length: int, told: Callable[[int, int], None] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(places, runs): segments of keyed ``docs``, and the runs (gram, sa, lo,
    hi) of their words that windows of ``length`` words cover which start at
    two places or more; None if no candidate reaches that length.  ``told`` is
    called with the length of each level and its number of candidates."""
    levels = level_lengths(length)
    places = repeated_segments(work, docs, "word", length, levels[0], levels[min(1, len(levels) - 1)])
    alive = work.put("level0", representatives(places))
    for k, (now, longer) in enumerate(zip(levels, levels[1:])):
        if told:
            told(now, alive.count())
        if alive.isEmpty():
            return places, None
        if longer == length:
            break
        parts = split_parts(alive, length, now, longer)
        if k:
            named = parts.withColumns({"ka": F.col("_ka"), "kb": F.col("_kb")})
            parts = work.put(f"cores{k}", parts_with_texts(docs, named, "ka", "kb").mapInArrow(_core_rows(longer), PARTS))
        alive = survivors(work, parts, f"level{k + 1}")
        work.drop(f"level{k}", f"cores{k}")
    windows = work.put("windows", parts_with_texts(docs, alive).mapInArrow(_window_rows(length), "gram long, sa long, copies long, i int, wa long, wb long"))
    twice = work.put("twice", windows.groupBy("wa", "wb").agg(F.sum("copies").alias("_c")).where("_c > 1").select("wa", "wb"))
    starts = windows.join(twice, ["wa", "wb"]).groupBy(*SEGMENT).agg(F.collect_set("i").alias("s"), F.min("i").alias("a"), F.max("i").alias("b"))
    # the windows of a segment are mostly one run of neighbours
    one = F.array(F.struct(F.col("a").alias("lo"), (F.col("b") + length).alias("hi")))
    each = F.transform("s", lambda i: F.struct(i.alias("lo"), (i + length).alias("hi")))
    runs = work.put("runs", starts.select(*SEGMENT, F.inline(F.when(F.size("s") == F.col("b") - F.col("a") + 1, one).otherwise(each))))
    if told:
        told(length, runs.count())
    work.drop("windows", "twice", *[f"level{k}" for k in range(len(levels))])
    return places, runs


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("_text")):
                starts, ends, bounds = word_spans(block)
                lo, hi = range_arrays(batch.column("ranges"), block.rows, bounds)
                gone = covered_units(len(starts), lo, hi)
                sums = np.concatenate([[0], np.cumsum(gone)])
                removed = sums[bounds[1:]] - sums[bounds[:-1]]
                shas, texts = [], []
                raw = block.data.tobytes()
                for i in range(len(block.rows)):
                    a, b = bounds[i], bounds[i + 1]
                    if removed[i]:
                        keep = np.flatnonzero(~gone[a:b]) + a
                        kept = b" ".join([raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist())])
                    else:
                        kept = b" ".join(raw[block.offsets[i] : block.offsets[i + 1]].split())
                    shas.append(hashlib.sha256(kept).hexdigest())
                    if keep_text:
                        texts.append(kept.decode("utf-8", "replace"))
                rows = pa.array(block.rows)
                out = [batch.column("_id").take(rows), pa.array(np.diff(bounds)), pa.array(removed.astype(np.int64)), pa.array(shas, pa.string())]
                names = ["_id", "n_words", "n_removed", "kept_sha256"]
                if keep_text:
                    out.append(pa.array(texts, pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35, keep_text: bool = True) -> DataFrame:
    """Remove every word covered by a ``length``-word window that starts at
    two or more places of the corpus, the same text included.

    One row per input row: the id, n_words, n_removed, kept_sha256 and, if
    ``keep_text``, kept_text (kept words joined by one space).  A null text has
    no words; texts shorter than the window lose nothing; repeated rows repeat
    each other, so they lose all windows; a null id is an id like any other.
    A very long text is one row to a worker, which holds it a few times over.
    There are no ties.  Other columns of ``df`` are not read, whatever their
    names.  An empty table gives no rows.  Work tables and the result are
    written to the shared folder when this is called."""
    if length < 1:
        raise ValueError("length must be at least 1")
    docs = with_key(df, id_col, text_col)
    work = Workspace(df.sparkSession)
    places, runs = repeated_word_runs(work, docs, length)
    id_type = docs.schema["_id"].dataType
    schema = T.StructType(
        [T.StructField("_id", id_type), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
        + [T.StructField("kept_text", T.StringType())] * keep_text
    )
    if runs is None:
        joined = docs.select("_id", "_text", F.lit(None).cast("array<struct<lo: int, hi: int>>").alias("ranges"))
    else:
        joined = with_texts(docs, ranges_by_text(places, runs), "left").select("_id", "_text", "ranges")
    return work.result(joined.mapInArrow(_cut(keep_text), schema)).withColumnRenamed("_id", id_col)
