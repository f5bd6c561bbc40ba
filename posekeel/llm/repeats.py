"""Common steps of the two exact-repeat operators.

A text is a sequence of units (words or bytes).  A *window* is ``length``
neighbouring units of one text; the operators ask which windows start at more
than one place of the corpus.  Windows are not shuffled one by one: neighbours
with the same minimiser (see ``common.anchored_segments``) travel as one
*segment* of a few numbers.  Segments of equal content become one
representative that weighs as many as there are; only representatives are
looked at by the operators, and what they find is carried back to all places.

A *part* is a run of windows of a representative that share a core: a run of
units, at a place that the windows' content alone decides, so that equal
windows have equal cores.  A core of which there is only one in the corpus
rules its windows out; the others get a longer core.

Rows are identified by two 64-bit hashes of (id, text), so null ids and
repeated ids are safe; rows that agree in both are interchangeable here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, BYTE_CODES, Block, Rolling, Workspace, anchored_segments, signed, text_blocks, word_codes, word_spans

KEY = ("_ka", "_kb")
#: a segment's content is named by its minimiser's hash and a hash of its own
SEGMENT = ("gram", "sa")
SEGMENTS = "_ka long, _kb long, at int, n int, r int, gram long, right_ext long, left_ext long, sa long"
PART = ("gram", "sa", "copies", "at", "i", "j", "c")


def with_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text under fixed names, with the two key hashes."""
    doc, text = F.col(id_col), F.col(text_col)
    return df.select(doc.alias("_id"), F.coalesce(text, F.lit("")).alias("_text")).withColumns(
        {"_ka": F.xxhash64("_id", "_text"), "_kb": F.xxhash64(F.lit(17), F.length("_text"), "_text", "_id")}
    )


def level_lengths(length: int) -> list[int]:
    """Lengths of the levels, ascending to ``length``: each is at most twice
    the one before, the first has eight units, or a quarter of a short length."""
    least = max(1, min(8, -(-length // 4)))
    out = [length]
    while out[0] >= 2 * least:
        out.insert(0, -(-out[0] // 2))
    return out


def unit_codes(block: Block, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the units of a block, and the units' number before each text."""
    if unit == "byte":
        return BYTE_CODES[block.data], block.offsets
    starts, ends, bounds = word_spans(block)
    return word_codes(block, starts, ends), bounds


def _stripes(block: Block, unit: str, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(codes, bounds, shift): the whole block, or stripes of a long text that
    overlap by a window less one unit, so each window is in one of them."""
    if unit == "byte" and len(block.data) > 2 * BLOCK_BYTES:
        n = len(block.data)
        for at in range(0, max(1, n - length + 1), BLOCK_BYTES):
            codes = BYTE_CODES[block.data[at : at + BLOCK_BYTES + length - 1]]
            yield codes, np.array([0, len(codes)]), at
        return
    codes, bounds = unit_codes(block, unit)
    yield codes, bounds, 0


def _segment_batches(unit: str, length: int, step: int, double: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ka, kb = (batch.column(c).to_numpy(zero_copy_only=False) for c in KEY)
            for block in text_blocks(batch.column("_text")):
                for codes, bounds, shift in _stripes(block, unit, length):
                    one = Rolling(codes)
                    grams = one.windows(step)
                    text, first, last, anchor = anchored_segments(grams, bounds, length, step)
                    if not len(text):
                        continue
                    lo, hi, total = bounds[text], bounds[text + 1], bounds[-1]
                    more = double - step
                    right = np.where(anchor + double <= hi, one(anchor, np.minimum(anchor + double, total)), np.uint64(0))
                    left = np.where(anchor - more >= lo, one(np.maximum(anchor - more, 0), anchor + step), np.uint64(1))
                    rows = block.rows[text]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ka[rows]),
                            pa.array(kb[rows]),
                            pa.array((first - lo + shift).astype(np.int32)),
                            pa.array((last - first + 1).astype(np.int32)),
                            pa.array((anchor - first).astype(np.int32)),
                            pa.array(signed(grams[anchor])),
                            pa.array(signed(right)),
                            pa.array(signed(left)),
                            pa.array(signed(Rolling(codes, 1)(first, last + length))),
                        ],
                        names=["_ka", "_kb", "at", "n", "r", "gram", "right_ext", "left_ext", "sa"],
                    )

    return run


def repeated_segments(work: Workspace, docs: DataFrame, unit: str, length: int, step: int, double: int) -> DataFrame:
    """Table "places": segments whose minimiser gram (``step`` units) occurs at
    two places or more; right_ext and left_ext are hashes of the runs of
    ``double`` units that begin and end with it.

    Grams are counted with one partial row for each gram and task.  Repeated
    grams are a table too: so they are one plain side of the join, and Spark
    can split a gram with very many places over tasks."""
    found = work.put("segments", docs.select(*KEY, "_text").mapInArrow(_segment_batches(unit, length, step, double), SEGMENTS))
    twice = work.put("grams", found.groupBy("gram").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("gram"))
    places = work.put("places", found.join(twice, "gram"))
    work.drop("segments", "grams")
    return places


def representatives(places: DataFrame) -> DataFrame:
    """One part for each distinct segment content: all its windows (i to j,
    counted from the segment's first), the core's first unit (c), how many
    segments it stands for, and one place of them."""
    place = F.struct("_ka", "_kb", "at")
    got = places.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("p"), *[F.first(c).alias(c) for c in ("n", "r", "right_ext", "left_ext")])
    return got.select(*SEGMENT, "copies", "p.*", F.lit(0).alias("i"), (F.col("n") - 1).alias("j"), F.col("r").alias("c"), F.col("r"), "right_ext", "left_ext")


def split_parts(parts: DataFrame, length: int, now: int, longer: int, *columns: str) -> DataFrame:
    """Each part of cores of ``now`` units as two with cores of ``longer``:
    windows that hold the core when it grows to the right, and the others, in
    which it grows to the left.  Adds core, if the hashes are there."""
    known = "right_ext" in parts.columns
    limit = F.col("c") + longer - length  # the first window that holds the right one
    right = F.struct(F.greatest("i", limit).cast("int").alias("i"), F.col("j").alias("j"), F.col("c").alias("c"), *([F.col("right_ext").alias("core")] if known else []))
    left = F.struct(F.col("i").alias("i"), F.least("j", limit - 1).cast("int").alias("j"), (F.col("c") + now - longer).cast("int").alias("c"), *([F.col("left_ext").alias("core")] if known else []))
    kept = [x for x in ("gram", "sa", "copies", "_ka", "_kb", "at", *columns)]
    return parts.select(*kept, F.explode(F.array(right, left)).alias("_p")).select(*kept, "_p.*").where("i <= j")


def survivors(work: Workspace, parts: DataFrame, name: str) -> DataFrame:
    """Table ``name``: the parts whose core stands for two places or more."""
    twice = work.put(f"{name}_cores", parts.groupBy("core").agg(F.sum("copies").alias("_c")).where("_c > 1").select("core"))
    out = work.put(name, parts.join(twice, "core"))
    work.drop(f"{name}_cores")
    return out


def with_texts(docs: DataFrame, per_text: DataFrame, how: str) -> DataFrame:
    """Join per-text rows to the texts.  The small side is hashed, so the
    texts are neither sorted nor buffered; it has one row for each key."""
    return docs.join(per_text.hint("shuffle_hash"), list(KEY), how)


def parts_with_texts(docs: DataFrame, parts: DataFrame, *columns: str) -> DataFrame:
    """Texts that hold representatives, with an array of their parts: bounded
    by the text's length, as representatives stand at places of their own."""
    per_text = parts.groupBy(*KEY).agg(F.collect_list(F.struct(*PART, *columns)).alias("parts"))
    return with_texts(docs.select(*KEY, "_text"), per_text, "inner")


def taken_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, np.ndarray, dict[str, np.ndarray]]]:
    """(block, text number in the block of each part, columns of the parts) of
    joined texts; of rows with one key, which repeat whole, one is taken."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in KEY)))
        fresh = [k for k, key in enumerate(keys) if key not in seen and not seen.add(key)]
        batch = batch.take(pa.array(fresh, pa.int64()))
        parts = batch.column("parts")
        counts = parts.value_lengths().to_numpy(zero_copy_only=False)
        flat = parts.flatten()
        columns = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
        row = np.repeat(np.arange(len(batch)), counts)
        for block in text_blocks(batch.column("_text")):
            a, b = np.searchsorted(row, [block.rows[0], block.rows[-1] + 1])
            if a < b:
                yield block, row[a:b] - block.rows[0], {k: v[a:b] for k, v in columns.items()}


def ranges_by_text(places: DataFrame, runs: DataFrame) -> DataFrame:
    """(_ka, _kb, ranges): the unit ranges of each text under the runs
    (gram, sa, lo, hi) of its segments.  Equal ranges of equal rows are one."""
    at = F.struct((F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))
    return places.select(*KEY, "at", *SEGMENT).join(runs, list(SEGMENT)).groupBy(*KEY).agg(F.collect_set(at).alias("ranges"))


def range_arrays(column: pa.Array, rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (lo, hi) of some rows of an array<struct<lo, hi>> column, moved by
    the first unit of their text in the block."""
    part = column.slice(int(rows[0]), len(rows))
    counts = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = part.flatten()
    base = np.repeat(bounds[: len(rows)], counts)
    return flat.field("lo").to_numpy(zero_copy_only=False) + base, flat.field("hi").to_numpy(zero_copy_only=False) + base
