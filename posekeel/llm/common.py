"""Shared helpers: work tables, blocks of whole texts as bytes, rolling hashes.

Texts are handled as UTF-8 buffers straight from Arrow.  All hashing is
vectorised over a *block* (whole documents, about half a megabyte together);
a longer text is a block of its own, whose bytes are hashed in stripes, so a
worker holds a few times the longest single text.
"""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of a block of texts that is handled at once; a longer text is a block of its own
BLOCK_BYTES = 1 << 19
#: limits of the Arrow batches that go to Python workers: rows and bytes
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20

# ---------------------------------------------------------------- work tables


def work_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, removed when the driver ends.
    Where that is unset, a local master uses a folder of its own (there is one
    machine then), any other refuses."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "/tmp/posekeel-work"
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{root.rstrip('/')}/posekeel-{uuid.uuid4().hex}"
    atexit.register(remove_folder, spark, path)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a work folder through Hadoop, whatever store it is in."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone when the interpreter ends
        if path.startswith("/"):
            shutil.rmtree(path, ignore_errors=True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded rows and bytes, for the session of a registered
    query: the JVM and the Python worker of a task each hold a batch of whole
    texts, and the limits are read when a plan runs, after the call."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def batch_limits(spark: SparkSession) -> Iterator[None]:
    """The same limits for what runs inside; the session's own come back."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {n: spark.conf.get(n, None) for n in names}
    small_batches(spark)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def _written(df: DataFrame, path: str) -> DataFrame:
    with batch_limits(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: an executor lost later costs only the tasks it ran, since
    the rows are in shared storage."""
    return _written(df, work_folder(df.sparkSession))


class Workspace:
    """Work tables of one operator call, by name, in one shared folder.  Each
    is removed by ``drop`` once what was made of it is written; what is left
    goes when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = work_folder(spark)
        self.names: set[str] = set()

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.names.add(name)
        return _written(df, f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self.names.discard(name)
            remove_folder(self.spark, f"{self.root}/{name}")

    def result(self, df: DataFrame) -> DataFrame:
        """Write the result, and remove all other tables."""
        out = self.put("result", df)
        self.drop(*(self.names - {"result"}))
        return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns; extra columns with clashing names go early."""
    return df.select(*[F.col(c) for c in columns])


def sha_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


# ------------------------------------------------------------- texts as bytes

#: fixed values: space and the five ASCII control blanks
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[list(BLANKS)] = True


@dataclass
class Block:
    """Some whole texts of one Arrow batch: ``data`` is their joined bytes and
    text ``i`` is ``data[offsets[i]:offsets[i + 1]]``; ``rows`` are their row
    numbers in the batch (null texts are empty)."""

    data: np.ndarray
    offsets: np.ndarray
    rows: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Split a string column into blocks of whole texts.  After the last one
    the worker gives free memory back, as the JVM beside it may need it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        yield Block(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at], np.arange(at, to))
        at = to
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


# --------------------------------------------------------------- rolling hash

_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))  # odd, so invertible
LENGTH_CODE = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up = _POWERS.get(which)
    if up is None or len(up[0]) < n:
        size = max(n, BLOCK_BYTES + 1024)
        base = BASES[which]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (base, inverse))
        if n <= BLOCK_BYTES + 1024:
            _POWERS[which] = up
    return up


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


class Rolling:
    """Hashes of any slices of a sequence of 64-bit codes, by prefix sums
    modulo 2**64 times powers of an odd base, then mixed with the length."""

    def __init__(self, codes: np.ndarray, which: int = 0):
        self.up, self.down = _powers(which, len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.up[: len(codes)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mixed(h + (end - start).astype(np.uint64) * LENGTH_CODE)

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all slices of length k, in order."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[k:] - self.sums[:n]) * self.down[:n] + np.uint64(k * int(LENGTH_CODE) & (1 << 64) - 1))


def word_spans(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the blank-separated words of a block, and for each
    text the number of words before it (one entry more than texts)."""
    data, offsets = block.data, block.offsets
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~IS_BLANK[data]
    before = np.zeros(n + 1, bool)  # a word may start here
    before[0] = True
    before[1:] = ~np.append(solid, False)[:-1]
    before[offsets] = True
    starts = np.flatnonzero(solid & before[:-1])
    after = np.ones(n + 1, bool)  # a word may end before this
    after[:-1] = ~solid
    after[offsets] = True
    ends = np.flatnonzero(solid & after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_codes(block: Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word, by stripes of bytes: a word that reaches over several
    is the sum of its parts, each shifted by the bytes before it."""
    n = len(block.data)
    if n <= BLOCK_BYTES:
        return Rolling(BYTE_CODES[block.data])(starts, ends)
    raw = np.zeros(len(starts), np.uint64)
    base = int(BASES[0])
    for at in range(0, n, BLOCK_BYTES):
        to = min(n, at + BLOCK_BYTES)
        a, b = np.searchsorted(ends, at, side="right"), np.searchsorted(starts, to)
        if a == b:
            continue
        part = Rolling(BYTE_CODES[block.data[at:to]])
        lo, hi = np.maximum(starts[a:b], at) - at, np.minimum(ends[a:b], to) - at
        h = (part.sums[hi] - part.sums[lo]) * part.down[lo]
        before = at - int(starts[a])  # only the first word can begin in an earlier stripe
        if before > 0:
            h[0] *= np.uint64(pow(base, before, 1 << 64))
        raw[a:b] += h
    return mixed(raw + (ends - starts).astype(np.uint64) * LENGTH_CODE)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


# ------------------------------------------------------------------- anchors


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w neighbours, by doubling."""
    out, have = keys, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchored_segments(grams: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Group the windows of ``length`` units by their minimiser.

    ``grams`` are hashes of all runs of ``k`` units of the joined texts, whose
    limits are ``bounds``.  The minimiser of a window is the place of its
    least gram, leftmost on ties; two equal windows have theirs at the same
    offset, so windows whose minimiser gram occurs once can't be repeated.
    Returns, for each run of neighbouring windows with one minimiser: text
    number, first and last window start, and place of the minimiser."""
    none = np.zeros(0, np.int64)
    w = length - k + 1
    if len(grams) < w:
        return none, none, none, none
    places = np.arange(len(grams), dtype=np.uint64)
    mask = np.uint64((1 << max(26, len(grams).bit_length())) - 1)  # room for the places of a block
    least = sliding_min((grams & ~mask) | places, w)
    anchor = (least & mask).astype(np.int64)
    n = len(anchor)
    text = np.searchsorted(bounds, np.arange(n), side="right") - 1
    valid = np.arange(n) + length <= bounds[np.minimum(text + 1, len(bounds) - 1)]
    cut = np.ones(n, bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~valid[1:] | ~valid[:-1]
    first = np.flatnonzero(cut)
    last = np.append(first[1:] - 1, n - 1)
    keep = valid[first]
    first, last = first[keep], last[keep]
    return text[first], first, last, anchor[first]


def covered_units(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n units lie in any of the given half-open ranges."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0
