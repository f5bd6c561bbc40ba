"""Byte-exact substring deduplication with merged Burrows-Wheeler transforms.

Whole texts are cut into segments of candidate windows (``repeats``); those
with a run of an eighth and of a quarter of the window that occurs once go.
What is left is dealt out by the longest run that all its windows share, and
all repeats are decided there: the strings of a task are cut into shards, each
shard gets a suffix order and a Burrows-Wheeler transform, and the transforms
are merged by refining the interleave one symbol an iteration.  Where
neighbours part gives their common prefix; those that are still together after
``length`` bytes are the repeated intervals.  No suffix is compared again.

Symbols are runs of a quarter of the window, ranked within the task.  A run
that very many different strings share is dealt out anew by longer runs, with
fewer windows to a string, down to one; equal strings are one with a weight.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTE_CODES, Rolling, Workspace, covered_units, signed, text_blocks
from .repeats import SEGMENT, parts_with_texts, range_arrays, ranges_by_text, repeated_segments, representatives, split_parts, survivors, taken_parts, with_key, with_texts

#: symbols to a window: the interleave is refined so many times, each costs time in proportion
SYMBOLS = 4
SHARD_BYTES = 1 << 16
#: bytes of strings whose transforms are merged together, about
CHUNK_BYTES = 1 << 19
#: different strings with one core that go to one task; more are dealt out anew
CORE_STRINGS = 512
#: windows to a string, as shares of the window's length, when dealt out anew
NARROW = (8, 64)

STRINGS = "ida long, idb long, rel int, r int, copies long, core long, body binary"
BANDS = "ida long, idb long, rel int, r int, copies long, core long, bh long, body binary"

# ------------------------------------------------------------ transform merge


def stable_order(keys: np.ndarray) -> np.ndarray:
    """Stable order of ranks, by counting passes over 16 bits each."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    if len(keys) and keys.max() > 0xFFFF:
        order = order[np.argsort((keys[order] >> 16).astype(np.uint16), kind="stable")]
    return order


class Shard:
    """Suffix order and transform of some symbol strings.

    ``symbols`` joins the strings; ``follow[i]`` is the place of the symbol
    after place i, or -1 at a string's end; ``before[i]`` that of the one
    before, or -1 at its start.  Each place is one suffix; they are ordered by
    their first ``depth`` symbols, in rounds that double what is compared."""

    def __init__(self, symbols: np.ndarray, follow: np.ndarray, before: np.ndarray, depth: int):
        rank, ahead, known = symbols, follow, 1
        while known < depth:
            behind = np.where(ahead >= 0, rank[ahead] + 1, 0).astype(np.int64)
            rank = np.unique(rank.astype(np.int64) << 32 | behind, return_inverse=True)[1]
            ahead = np.where(ahead >= 0, ahead[ahead], -1)
            known *= 2
        self.order = stable_order(rank)
        previous = before[self.order]
        self.bwt = np.where(previous >= 0, symbols[previous], -1)


def merge_transforms(transforms: list[np.ndarray], ends: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave refinement of several transforms.

    ``transforms[b][i]`` is the symbol before suffix i of shard b in its own
    order, -1 at a string's start.  ``ends[b]`` are the last symbols of the
    strings of shard b: their empty suffixes stand first in every order and
    carry them.  Returns the shard of each suffix in the merged order by the
    first ``depth`` symbols, and the length in symbols of its common prefix
    with the one before it (``depth`` if that long or longer)."""
    shards = len(transforms)
    whole = [np.concatenate([e, t]) for e, t in zip(ends, transforms)]
    flat = np.concatenate(whole)
    z = np.repeat(np.arange(shards, dtype=np.uint16), [len(t) for t in whole])
    n = len(z)
    common = np.full(n, depth, np.int64)
    if not n:
        return z, common
    block, new = np.zeros(n, np.int32), np.zeros(n, bool)
    # empty suffixes are all that a string's start leads to: they stay ahead
    empties = np.repeat(np.arange(shards, dtype=np.uint16), [len(e) for e in ends])
    k = len(empties)
    for step in range(1, depth + 1):
        c = np.empty(n, flat.dtype)
        c[np.argsort(z, kind="stable")] = flat  # shards stand one after the other in ``flat``
        real = np.flatnonzero(c >= 0)
        order = real[stable_order(c[real])]
        moved, from_block = c[order], block[order]
        z = np.concatenate([empties, z[order]])
        fresh = np.ones(n, bool)
        fresh[1:k] = False
        fresh[k + 1 :] = (moved[1:] != moved[:-1]) | (from_block[1:] != from_block[:-1])
        common[fresh & ~new] = step - 1
        new |= fresh
        block = np.cumsum(new, dtype=np.int32)
        if new.all():
            break
    common[0] = 0
    return z, common


def repeated_places(texts: list[bytes], weights: list[int], length: int, step: int) -> list[np.ndarray]:
    """For each text, whether its window of ``length`` bytes at each place
    stands for two places or more: it starts at another place of these texts
    too, or its text weighs two or more.  A text's strings are its ``step``
    residue classes; a symbol is the rank of ``step`` bytes."""
    depth = length // step
    assert depth * step == length
    sizes = np.array([len(t) for t in texts])
    stops = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    symbols = np.unique(Rolling(BYTE_CODES[data]).windows(step), return_inverse=True)[1]
    # shards are runs of whole texts
    number = (stops - sizes) // SHARD_BYTES
    firsts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    shards, ends, owners = [], [], []
    for a, b in zip(firsts, np.append(firsts[1:], len(texts))):
        lo, size = stops[a] - sizes[a], sizes[a:b]
        stop = np.repeat(np.cumsum(size), size)
        start = stop - np.repeat(size, size)
        here = np.arange(len(stop))
        use = np.flatnonzero(here + step <= stop)
        slot = np.full(len(stop) + step, -1, np.int64)
        slot[use] = np.arange(len(use))
        follow = np.where(use + 2 * step <= stop[use], slot[use + step], -1)
        before = np.where(use - step >= start[use], slot[use - step], -1)
        own = symbols[lo + use]
        shard = Shard(own, follow, before, depth)
        shards.append(shard)
        ends.append(own[follow < 0])
        owners.append(lo + use[shard.order])
    z, common = merge_transforms([s.bwt for s in shards], ends, depth)
    # intervals: neighbours with a common prefix of a whole window
    interval = np.cumsum(common < depth)
    at = np.concatenate([np.concatenate([np.full(len(e), -1), o]) for e, o in zip(ends, owners)])
    place = np.empty(len(z), np.int64)
    place[np.argsort(z, kind="stable")] = at
    text = np.repeat(np.arange(len(texts)), sizes)
    weight = np.where(place >= 0, np.minimum(np.asarray(weights), 2)[text[place]], 0)
    twice = np.bincount(interval, weight)[interval] >= 2
    flags = np.zeros(len(data), bool)
    flags[place[(place >= 0) & twice]] = True
    return [flags[e - n : e - n + max(0, n - length + 1)] for e, n in zip(stops.tolist(), sizes.tolist())]


# ------------------------------------------------------------------ operators


def _string_rows(length: int):
    """The bytes of each part, from its first window to the end of its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, text, parts in taken_parts(batches):
            start = block.offsets[text] + parts["at"]
            body = [block.data[s:e].tobytes() for s, e in zip((start + parts["i"]).tolist(), (start + parts["j"] + length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (parts["gram"], parts["sa"], parts["i"], (parts["r"] - parts["i"]).astype(np.int32), parts["copies"], parts["core"])] + [pa.array(body, pa.binary())],
                names=["ida", "idb", "rel", "r", "copies", "core", "body"],
            )

    return run


def _narrow(length: int, width: int):
    """Strings of ``width`` windows or less, by their distance to the minimiser
    (r before the string's first window): they share all but that many bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ida, idb, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ida", "idb", "copies"))
            for k, (rel, r, body) in enumerate(zip(batch.column("rel").to_pylist(), batch.column("r").to_pylist(), batch.column("body").to_pylist())):
                nearest = r - (len(body) - length)  # distance of the last window
                bands = range(r // width, nearest // width - 1, -1)
                hashed = Rolling(BYTE_CODES[np.frombuffer(body, np.uint8)]), Rolling(BYTE_CODES[np.frombuffer(body, np.uint8)], 1)
                tops = np.array([min(r, b * width + width - 1) for b in bands])
                lows = np.array([max(nearest, b * width) for b in bands])
                a, e, c = r - tops, r - lows + length, r - np.array(bands) * width
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(a), ida[k])), pa.array(np.full(len(a), idb[k])), pa.array((rel + a).astype(np.int32)), pa.array(tops.astype(np.int32)), pa.array(np.full(len(a), copies[k])),
                        pa.array(signed(hashed[0](c, c + length - width + 1))), pa.array(signed(hashed[1](a, e))), pa.array([body[x:y] for x, y in zip(a.tolist(), e.tolist())], pa.binary()),
                    ],
                    names=["ida", "idb", "rel", "r", "copies", "core", "bh", "body"],
                )

    return run


def _merge(length: int, step: int):
    """Repeated runs of the strings of whole cores, some cores at a time."""

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for (_, a, b, rel, _, _), flags in zip(rows, repeated_places([r[5] for r in rows], [r[4] for r in rows], length, step)):
            edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
            for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
                for column, value in zip(out, (a, b, rel + s, rel + e - 1 + length)):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["ida", "idb", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("core", "ida", "idb", "rel", "copies", "body")]):
                if size >= CHUNK_BYTES and row[0] != last:
                    yield judged(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
                last = row[0]
        if held:
            yield judged(held)

    return run


def merged_runs(work: Workspace, strings: DataFrame, length: int, widths: list[int], name: str = "w") -> DataFrame:
    """(ida, idb, lo, hi): runs of the bytes of ``strings`` that repeated
    windows cover.  Equal windows have equal cores, so they meet in one task."""
    cores = work.put(f"{name}_cores", strings.groupBy("core").agg(F.sum("copies").alias("_w"), F.count(F.lit(1)).alias("_c")).where("_w > 1").select("core", "_c"))
    few = strings.join(cores.where(F.col("_c") <= CORE_STRINGS) if widths else cores, "core").select("core", "ida", "idb", "rel", "copies", "body")
    runs = work.put(f"{name}_runs", few.repartition("core").sortWithinPartitions("core").mapInArrow(_merge(length, length // SYMBOLS), "ida long, idb long, lo int, hi int"))
    many = cores.where(F.col("_c") > CORE_STRINGS)
    if not widths or many.isEmpty():
        return runs
    bands = work.put(f"{name}_bands", strings.join(many, "core").mapInArrow(_narrow(length, widths[0]), BANDS))
    one = bands.groupBy("core", "bh").agg(F.sum("copies").alias("copies"), F.first("r").alias("r"), F.first("body").alias("body"))
    equal = work.put(f"{name}_equal", one.select(F.col("core").alias("ida"), F.col("bh").alias("idb"), F.lit(0).alias("rel"), "r", "copies", "core", "body"))
    inner = merged_runs(work, equal, length, widths[1:], f"{name}w").select(F.col("ida").alias("core"), F.col("idb").alias("bh"), "lo", "hi")
    carried = bands.select("ida", "idb", "rel", "core", "bh").join(inner, ["core", "bh"]).select("ida", "idb", (F.col("rel") + F.col("lo")).alias("lo"), (F.col("rel") + F.col("hi")).alias("hi"))
    out = work.put(f"{name}_all", runs.unionByName(carried))
    work.drop(f"{name}_cores", f"{name}_runs", f"{name}_bands", f"{name}_equal")
    return out


def repeated_byte_runs(work: Workspace, docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(places, runs): segments of keyed ``docs``, and the runs (gram, sa, lo,
    hi) of their bytes that strings of ``length`` bytes cover which start at
    two places or more."""
    if length % SYMBOLS or length < SYMBOLS:
        raise ValueError(f"length must be a multiple of {SYMBOLS}")
    step = length // 4
    places = repeated_segments(work, docs, "byte", length, step, 2 * step)
    parts = split_parts(work.put("segments", representatives(places)), length, step, 2 * step, "r")
    alive = survivors(work, parts, "parts")
    strings = work.put("strings", parts_with_texts(docs, alive, "r", "core").mapInArrow(_string_rows(length), STRINGS))
    work.drop("segments", "parts")
    widths = sorted({max(1, length // share) for share in NARROW} | {1}, reverse=True)
    runs = merged_runs(work, strings, length, widths).select(F.col("ida").alias("gram"), F.col("idb").alias("sa"), "lo", "hi")
    work.drop("strings")
    return places, runs


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column("_text")):
                lo, hi = range_arrays(batch.column("ranges"), block.rows, block.offsets)
                gone = covered_units(len(block.data), lo, hi)
                removed, spans, shas, bodies = [], [], [], []
                for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist()):
                    mine = gone[a:b]
                    kept = block.data[a:b][~mine].tobytes()
                    removed.append(b - a - len(kept))
                    spans.append(int(np.count_nonzero(np.diff(mine.astype(np.int8), prepend=0) == 1)))
                    shas.append(hashlib.sha256(kept).hexdigest())
                    if keep_text:
                        bodies.append(kept)
                out = [batch.column("_id").take(pa.array(block.rows)), pa.array(np.diff(block.offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string())]
                names = ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if keep_text:
                    out.append(pa.array(bodies, pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep_text: bool = True) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that starts
    at two or more places of the corpus, the same text included.

    One row per input row: the id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 and, if ``keep_text``, kept (the other bytes; a
    cut can fall inside a character).  A null text is empty; texts shorter than
    ``length`` lose nothing; repeated rows repeat each other; a null id is an
    id like any other; a very long text is one row to a worker, which holds it
    a few times over; there are no ties; other columns of ``df`` are not read,
    whatever their names; an empty table gives no rows.  Work tables and the
    result are written to the shared folder when this is called."""
    docs = with_key(df, id_col, text_col)
    work = Workspace(df.sparkSession)
    places, runs = repeated_byte_runs(work, docs, length)
    schema = T.StructType(
        [T.StructField("_id", docs.schema["_id"].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
        + [T.StructField("kept_sha256", T.StringType())]
        + [T.StructField("kept", T.BinaryType())] * keep_text
    )
    joined = with_texts(docs, ranges_by_text(places, runs), "left").select("_id", "_text", "ranges")
    return work.result(joined.mapInArrow(_cut(keep_text), schema)).withColumnRenamed("_id", id_col)
