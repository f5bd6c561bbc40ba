"""Near-duplicate classes by improved consistent weighted sampling.

Shingles of five words are weighted by term frequency times inverse document
frequency, counted over all documents in hashed bins.  Consistent weighted
samples are banded; documents that share a band are candidates, and a pair is
linked if the exact weighted Jaccard similarity reaches the threshold.

Copies are one node from the start.  In a band's group, a few centres are first
compared with the members that are in another component than theirs.  Members
that then still are outside the group's largest component are compared, in
blocks, with all members of other components; pairs are not made into rows.  So
no link that would join two components is missed, and a group of copies costs
a few comparisons a member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Block, Rolling, mixed, signed, stash, text_blocks, word_codes, word_spans
from .repeats import KEY, with_key

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 10
BAND_ROWS = 3
#: bins of document frequencies: the table that is broadcast has so many, four
#: megabytes.  A shingle's frequency is known to a bin's share of all shingles of
#: a document, about a two-thousandth of the documents, whatever the corpus.
DF_BITS = 20
#: bins that a task sends in one batch
FREQUENCY_ROWS = 1 << 15
#: centres of a group in each of the first rounds
CENTRES = (1, 4)
#: nodes outside the largest component that are held in a block, and members
#: that are read past it in one task
BLOCK_NODES = 256
SHARD_NODES = 4096
#: bytes of a block of texts whose samples are drawn together
SAMPLE_BLOCK = 1 << 19

_RNG = np.random.Generator(np.random.PCG64(6))
_TABLE = 1 << 16
#: draws from Gamma(2, 1), which hashes index: r, 1 / r and log c of the method
GAMMA_R = _RNG.gamma(2.0, 1.0, _TABLE).astype(np.float32) + np.float32(1e-6)
GAMMA_R_INVERSE = (1 / GAMMA_R).astype(np.float32)
LOG_C = np.log(_RNG.gamma(2.0, 1.0, _TABLE) + 1e-9).astype(np.float32)
SEEDS = _RNG.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts of a block and the number of their
    text, then two hashes of each text's whole word sequence.  A text with
    fewer words than a shingle, but not none, is one shingle."""
    starts, ends, bounds = word_spans(block)
    codes = word_codes(block, starts, ends)
    one, two = Rolling(codes), Rolling(codes, 1)
    n = np.diff(bounds)
    count = np.where(n >= SHINGLE_WORDS, n - SHINGLE_WORDS + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), count)
    first = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + bounds[:-1][text]
    last = np.minimum(first + SHINGLE_WORDS, bounds[1:][text])
    return one(first, last), text, one(bounds[:-1], bounds[1:]), two(bounds[:-1], bounds[1:])


def counted(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) in that order, and how often each occurs."""
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(text[order], kind="stable")]
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return h[at], t[at], np.diff(np.append(at, len(h)))


def _bin(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - DF_BITS)).astype(np.int64)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << DF_BITS, np.int64)
    texts = 0
    for batch in batches:
        for block in text_blocks(batch.column("_text")):
            hashes, text, _, _ = shingles(block)
            pairs = np.unique((text.astype(np.int64) << DF_BITS) | _bin(hashes))
            total += np.bincount(pairs & ((1 << DF_BITS) - 1), minlength=1 << DF_BITS)
            texts += len(np.unique(text))
    seen = np.flatnonzero(total)
    bins, n = np.append(seen, -1).astype(np.int32), np.append(total[seen], texts)
    for at in range(0, len(bins), FREQUENCY_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + FREQUENCY_ROWS]) for c in (bins, n)], names=["bin", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Weight of each bin: log of the share of documents with a shingle in it,
    over all documents; a tenth at least.  Sums are of whole numbers; the driver
    gets eight bytes a bin."""
    counts = docs.select("_text").mapInArrow(_document_frequencies, "bin int, n long").groupBy("bin").agg(F.sum("n").cast("float").alias("n"))
    df, total = np.zeros(1 << DF_BITS, np.float32), 0.0
    for batch in counts.toArrow().to_batches():
        bins, n = batch.column("bin").to_numpy(), batch.column("n").to_numpy()
        df[bins[bins >= 0]] = n[bins >= 0]
        total += float(n[bins < 0].sum())
    return np.maximum(np.log(np.float32(1 + total) / (1 + df)), np.float32(0.1)).astype(np.float32)


def samples(hashes: np.ndarray, text: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Band keys, one row for each distinct text number, in order.  For each
    hash function the sample is the shingle and its quantised log weight at the
    least ln a = ln c - r (t - b + 1), where t = floor(ln w / r + b)."""
    starts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    row = np.cumsum(np.append(True, text[1:] != text[:-1])) - 1
    log_weight = np.log(weights).astype(np.float32)
    keys = np.zeros((len(starts), BANDS), np.uint64)
    for k, seed in enumerate(SEEDS):
        x = hashes * seed
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        which = (x & np.uint64(0xFFFF)).astype(np.int32)
        beta = ((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_weight * GAMMA_R_INVERSE[which] + beta)
        a = LOG_C[((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int32)] - GAMMA_R[which] * (t - beta + 1)
        least = np.flatnonzero(a == np.minimum.reduceat(a, starts)[row])
        least = least[np.append(True, row[least][1:] != row[least][:-1])]
        sample = mixed(hashes[least] + t[least].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        band = k // BAND_ROWS
        keys[:, band] = mixed((keys[:, band] + np.uint64(band + 1)) * np.uint64(0x94D049BB133111EB) ^ sample)
    return keys


def _signatures(weights: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for batch in batches:
            for block in text_blocks(batch.column("_text"), SAMPLE_BLOCK):
                hashes, text, na, nb = shingles(block)
                m = len(block.rows)
                node = np.stack([na, nb], 1).astype(">u8").tobytes()
                bands: list = [None] * m
                nodes: list = [None] * m
                if len(hashes):
                    h, t, tf = counted(hashes, text)
                    keys = signed(samples(h, t, tf * table[_bin(h)]))
                    for i, key in zip(np.unique(t).tolist(), keys):
                        bands[i] = key
                        nodes[i] = node[16 * i : 16 * i + 16]
                rows = pa.array(block.rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(rows) for c in ("_id", *KEY)] + [pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["_id", *KEY, "node", "bands"],
                )

    return run


def _sets(texts: list[str], table: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted shingle hashes of each text and their weights."""
    out: list = []
    for block in text_blocks(pa.array(texts, pa.large_string())):
        hashes, text, _, _ = shingles(block)
        h, t, tf = counted(hashes, text)
        w = tf * table[_bin(h)].astype(np.float64)
        cut = np.searchsorted(t, np.arange(len(block.rows) + 1))
        out += [(h[a:b], w[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser over sum of the greater weights; 0 if both are empty."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    both = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    shared = np.minimum(a[1][at[both]], b[1][both]).sum()
    whole = a[1].sum() + b[1].sum() - shared
    return float(shared / whole) if whole > 0 else 0.0


def _linked(weights: Broadcast, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                own = dict(zip(a, part.column("ta").to_pylist()))
                sets = dict(zip(own, _sets(list(own.values()), table)))
                keep = [weighted_jaccard(sets[x], y) >= threshold - 1e-9 for x, y in zip(a, _sets(part.column("tb").to_pylist(), table))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, k in zip(c, keep) if k], pa.binary()) for c in (a, b)], names=["a", "b"]
                )

    return run


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) with labels of linked nodes made equal: each label points
    to the least one it is linked to, links move along, until none is left."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    edges = stash(ends.where("la <> lb").select(F.col("la").alias("u"), F.col("lb").alias("v")).distinct())
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")))
        labels = stash(labels.join(parent.withColumnRenamed("u", "label"), "label", "left").select("node", F.coalesce("p", "label").alias("label")))
        moved = edges.join(parent.select("u", F.col("p").alias("pu")), "u").join(parent.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
        edges = stash(moved.where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
    return labels


def _block_links(weights: Broadcast, threshold: float):
    """Rows come by group (g), its outliers (role 0) before its members.  One
    link is enough for an outlier and a label; a pair that shares several bands
    is compared in the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        now, block, index = None, [], None
        for batch in batches:
            links: list[tuple] = []
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = _sets(part.column("_text").to_pylist(), table)
                bands = np.array(part.column("bands").to_pylist(), np.int64)
                columns = [part.column(c).to_pylist() for c in ("g", "role", "band", "node", "label")]
                for k, (g, role, band, node, label) in enumerate(zip(*columns)):
                    if g != now:
                        now, block, index, found = g, [], None, set()
                    if role == 0:
                        block.append((node, label, bands[k], *sets[k]))
                        continue
                    if index is None and block:
                        sizes = [len(x[3]) for x in block]
                        index = (
                            np.concatenate([x[3] for x in block]), np.concatenate([x[4] for x in block]), np.repeat(np.arange(len(block)), sizes),
                            np.array([x[4].sum() for x in block]), np.stack([x[2] for x in block]),
                        )
                    if index is None:
                        continue
                    h, w, owner, total, their = index
                    own, value = sets[k]
                    place = np.searchsorted(own, h)
                    place[place == len(own)] = 0
                    same = own[place] == h
                    shared = np.bincount(owner[same], np.minimum(value[place[same]], w[same]), minlength=len(block))
                    near = shared >= (threshold - 1e-9) * (total + value.sum() - shared)
                    near &= ~(their[:, :band] == bands[k][:band]).any(1)
                    for i in np.flatnonzero(near).tolist():
                        if block[i][1] != label and (i, label) not in found:
                            found.add((i, label))
                            links.append((min(node, block[i][0]), max(node, block[i][0])))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.binary()) for c in (0, 1)], names=["a", "b"])

    return run


def near_duplicate_labels(docs: DataFrame, rows: DataFrame, weights: Broadcast, threshold: float) -> DataFrame:
    """(node, label) of the nodes that share a band with another one."""
    nodes = rows.where("node is not null").dropDuplicates(["node"])
    places = stash(nodes.select("node", *KEY, "bands"))
    banded = places.select("node", F.posexplode("bands").alias("band", "key"))
    several = stash(banded.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"))
    left = stash(banded.join(several, "key"))  # members that have not been centres
    wanted = left.select("node").distinct()
    texts = stash(docs.select(*KEY, "_text").join(places.join(wanted, "node").hint("shuffle_hash"), list(KEY)).select("node", "bands", "_text"))
    labels = stash(wanted.select("node", F.col("node").alias("label")))
    for parts in CENTRES:
        named = left.join(labels, "node")
        open_ = stash(named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key"))
        left = stash(named.join(open_, "key"))
        part = F.pmod(F.xxhash64("node", F.lit(parts)), F.lit(parts))
        centres = stash(left.groupBy("key", part.alias("part")).agg(F.min(F.struct("node", "label")).alias("c")).select("key", F.col("c.node").alias("centre"), F.col("c.label").alias("own")))
        pairs = stash(left.join(centres, "key").where("label <> own").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct())
        full = pairs.join(texts.select(F.col("node").alias("b"), F.col("_text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("_text").alias("ta")), "a")
        links = stash(full.select("a", "b", "ta", "tb").mapInArrow(_linked(weights, threshold), "a binary, b binary"))
        labels = components(labels, links)
        left = left.join(centres.select("key", F.col("centre").alias("node")), ["key", "node"], "left_anti").select("key", "node", "band")
    left = stash(left.join(labels, "node"))
    sizes = left.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    groups = stash(
        sizes.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("major"), F.sum("c").alias("m"), F.max("c").alias("top")).where("top < m")
        .select("key", "major", F.ceil((F.col("m") - F.col("top")) / BLOCK_NODES).cast("int").alias("blocks"), F.ceil(F.col("m") / SHARD_NODES).cast("int").alias("shards"))
    )
    if groups.isEmpty():
        return labels
    member = left.join(groups, "key")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pick = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    out = member.where("label <> major").select("key", "node", "label", "band", F.lit(0).alias("role"), pick("blocks", 1).alias("block"), spread("shards").alias("shard"))
    every = member.select("key", "node", "label", "band", F.lit(1).alias("role"), spread("blocks").alias("block"), pick("shards", 2).alias("shard"))
    dealt = out.unionByName(every).select(F.xxhash64("key", "block", "shard").alias("g"), "role", "band", "node", "label")
    full = dealt.join(texts, "node").repartition("g").sortWithinPartitions("g", "role")
    return components(labels, stash(full.mapInArrow(_block_links(weights, threshold), "a binary, b binary")))


def _classified(df: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """_id, _ka, _kb, label: one row per input row; label null without words."""
    docs = with_key(df, id_col, text_col)
    spark = df.sparkSession
    weights = spark.sparkContext.broadcast(inverse_frequencies(docs))
    schema = T.StructType(
        [T.StructField("_id", docs.schema["_id"].dataType), T.StructField("_ka", T.LongType()), T.StructField("_kb", T.LongType())]
        + [T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    )
    rows = stash(docs.select("_id", *KEY, "_text").mapInArrow(_signatures(weights), schema))
    labels = near_duplicate_labels(docs, rows, weights, threshold)
    return stash(rows.join(labels, "node", "left").select("_id", *KEY, F.coalesce("label", "node").alias("label")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row per input row: the id and class_id, the least id of its class
    (documents joined by chains of pairs with similarity ``threshold`` or more).

    Word sequences that are equal are similar.  A text without words (null,
    empty, blank) is in no class and has its own id; null ids stand aside when
    the least id is taken, unless a class has no other; repeated rows share a
    class; a very long text is held by one worker at a time; ties between equal
    samples go to the first shingle by hash; other columns are not read, whatever
    their names; an empty table gives no rows.  Work tables are written when
    this is called."""
    rows = _classified(df, id_col, text_col, threshold)
    least = stash(rows.where("label is not null").groupBy("label").agg(F.min("_id").alias("class_id")))
    joined = rows.join(least, "label", "left")
    return joined.select(F.col("_id").alias(id_col), F.when(F.col("label").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """All columns of one row of each class: the one with the least id (null
    last).  Rows without words all stay; of rows that agree in id and text one
    stays."""
    rows = _classified(df, id_col, text_col, threshold)
    rank = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_ka").alias("a"), F.col("_kb").alias("b"))
    chosen = rows.where("label is not null").groupBy("label").agg(F.min(rank).alias("r")).select(F.col("r.a").alias("_ka"), F.col("r.b").alias("_kb"))
    bare = rows.where("label is null").select(*KEY)
    number = stash(rows.join(chosen.unionByName(bare).distinct(), list(KEY)).groupBy(*KEY, F.col("label").isNull().alias("_bare")).agg(F.count(F.lit(1)).alias("_c")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = {"_ka": F.xxhash64(F.col(id_col), text), "_kb": F.xxhash64(F.lit(17), F.length(text), text, F.col(id_col))}
    kept = df.withColumns(keys).join(number.hint("shuffle_hash"), list(KEY))
    single = kept.where("_c = 1 or _bare")
    repeated = kept.where("_c > 1 and not _bare").dropDuplicates(list(KEY))
    return single.unionByName(repeated).select(*df.columns)
