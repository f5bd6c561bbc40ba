"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document (bad, good, abstain).
Expectation-maximisation over the counts of vote patterns, of all documents,
estimates each labeller's accuracies and the posterior of every pattern.
The posteriors of a bounded sample train a linear scorer over hashed byte
n-grams, which then judges every document over its whole text.  No hand label
of quality is used for training; a labels table only measures the result.

Abuse is another cause of rejection, which features of form cannot show: few
words of an otherwise good text.  Where labelled rows are given, a bounded
sample of them yields the words that tell abusive documents from others, and
documents with such a word get that cause's probability on top.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Block, Rolling, Workspace, mixed, signed, text_blocks, word_codes, word_spans

#: documents, about, those of least hash, whose posteriors train the scorer
TRAIN_DOCS = 4096
N_BUCKETS = 1 << 14
GRAM_BYTES = 3
EPOCHS = 150
MIN_WORDS = 20
#: labelled rows of each kind, about, those of least hash, from which abusive
#: words are learnt; fewer abusive rows than the second are too few to learn from
LABELLED_DOCS = 4096
MIN_LABELLED = 20
#: a word is abusive if it is in this share of the abusive rows at least, and of
#: the rows with it (both kinds by their true numbers) this share is abusive
ABUSE_SHARE = 0.02
ABUSE_PRECISION = 0.95

#: Labellers that vote bad beyond a limit of their feature (sign: +1 above,
#: -1 below) and else abstain.
LABELLERS = {
    "upper_share": (1, 0.35),
    "symbols_per_word": (1, 0.30),
    "bang_words": (1, 0.20),
    "repeated_bigrams": (1, 0.35),
    "distinct_words": (-1, 0.25),
    "word_length": (1, 7.2),
    "short_words": (-1, 0.10),
}
#: One more votes good where all these features are in range, bad where two or
#: more are out of it, and else abstains.
PROSE = {"upper_share": (0.0, 0.15), "symbols_per_word": (0.0, 0.10), "repeated_bigrams": (0.0, 0.15), "distinct_words": (0.45, 1.0), "word_length": (4.2, 6.2), "short_words": (0.15, 0.48)}
N_VOTERS = len(LABELLERS) + 1
#: limits of the bins in which features enter the scorer besides n-grams
BINS = {
    "upper_share": (0.05, 0.15, 0.35, 0.6),
    "symbols_per_word": (0.02, 0.1, 0.3, 0.7),
    "bang_words": (0.02, 0.05, 0.2, 0.5),
    "repeated_bigrams": (0.05, 0.15, 0.35, 0.6),
    "distinct_words": (0.1, 0.25, 0.45, 0.6),
    "word_length": (3.5, 4.2, 6.2, 7.2),
    "short_words": (0.05, 0.15, 0.48, 0.6),
}
N_WEIGHTS = N_BUCKETS + 5 * len(BINS)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _distinct(codes: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """Distinct codes of each text."""
    order = np.lexsort((codes, text))
    c, t = codes[order], text[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (t[1:] != t[:-1])
    return np.bincount(t[new], minlength=n_texts)


def features(block: Block) -> dict[str, np.ndarray]:
    """The labellers' features of each text of a block, and n_words."""
    data, offsets, m = block.data, block.offsets, len(block.rows)
    starts, ends, bounds = word_spans(block)
    n = np.diff(bounds)
    some = np.maximum(n, 1)
    text = np.repeat(np.arange(m), n)
    codes = word_codes(block, starts, ends)
    chars = (data & 0xC0) != 0x80
    length = ends - starts
    pair = Rolling(codes).windows(2)
    first = np.arange(len(pair))
    inside = text[first] == text[first + 1] if len(pair) else np.zeros(0, bool)
    pairs = np.bincount(text[first[inside]], minlength=m) if len(pair) else np.zeros(m)
    kinds = _distinct(pair[inside], text[first[inside]], m) if len(pair) else np.zeros(m)
    bang = np.zeros(len(starts), bool)
    if len(starts):
        bang = (data[ends - 1] == 33) & (length > 1) & (data[np.maximum(ends - 2, 0)] == 33)
    solid = _per_text(chars, offsets) - _per_text(np.isin(data, (9, 10, 11, 12, 13, 32)), offsets)
    return {
        "n_words": n,
        "upper_share": _per_text(_UPPER[data], offsets) / np.maximum(_per_text(_ALPHA[data], offsets), 1),
        "symbols_per_word": _per_text(_SYMBOL[data], offsets) / some,
        "bang_words": _per_text(bang, bounds) / some,
        "repeated_bigrams": 1 - kinds / np.maximum(pairs, 1) * (pairs > 0) - (pairs == 0),
        "distinct_words": _distinct(codes, text, m) / some,
        "word_length": solid / some,
        "short_words": _per_text(length <= 3, bounds) / some,
        "long_lines": n / (1 + _per_text(data == 10, offsets)),
    }


def votes(got: dict[str, np.ndarray]) -> np.ndarray:
    """One row of votes for each text: 1 bad, 0 good, -1 abstains."""
    out = np.full((len(got["n_words"]), N_VOTERS), -1, np.int8)
    for j, (name, (sign, limit)) in enumerate(LABELLERS.items()):
        out[sign * got[name] > sign * limit, j] = 1
    odd = sum((got[name] < low) | (got[name] > high) for name, (low, high) in PROSE.items())
    out[odd == 0, -1] = 0
    out[odd >= 2, -1] = 1
    out[got["n_words"] < MIN_WORDS] = -1
    return out


@dataclass
class Votes:
    """Estimates of the votes' model: share of bad documents, and each
    labeller's accuracy where it votes."""

    prior: float
    accuracy: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that documents with these votes are bad."""
        weight = np.log(self.accuracy / (1 - self.accuracy))
        log = np.log(self.prior / (1 - self.prior)) + np.where(patterns == 1, weight, np.where(patterns == 0, -weight, 0.0)).sum(1)
        return 1 / (1 + np.exp(-np.clip(log, -30, 30)))


def estimate_accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Votes:
    """Expectation-maximisation over vote patterns with their counts, begun
    with an accuracy of 0.9 for all; accuracies have a weak prior and limits."""
    model = Votes(0.1, np.full(patterns.shape[1], 0.9))
    bad = model.posterior(patterns)
    for _ in range(rounds):
        right = np.where(patterns == 1, bad[:, None], np.where(patterns == 0, 1 - bad[:, None], 0.0))
        cast = (patterns >= 0) * counts[:, None]
        accuracy = np.clip(((right * counts[:, None]).sum(0) + 9) / (cast.sum(0) + 10), 0.55, 0.98)
        model = Votes(float(np.clip((bad * counts).sum() / counts.sum(), 1e-2, 0.5)), accuracy)
        new = model.posterior(patterns)
        done = np.abs(new - bad).max() < 1e-6
        bad = new
        if done:
            break
    return model


def bin_weights(got: dict[str, np.ndarray]) -> np.ndarray:
    """Indices of the scorer's weights for the binned features of each text."""
    return np.stack([N_BUCKETS + 5 * j + np.searchsorted(limits, got[name]) for j, (name, limits) in enumerate(BINS.items())], 1)


def _buckets(block: Block) -> np.ndarray:
    """Bucket of the byte n-gram at each place of the joined texts."""
    data = block.data.astype(np.uint64)
    n = max(0, len(data) - GRAM_BYTES + 1)
    code = np.zeros(n, np.uint64)
    for i in range(GRAM_BYTES):
        code = code * np.uint64(257) + data[i : i + n]
    return (mixed(code) >> np.uint64(50)).astype(np.int64)


def _gram_limits(block: Block) -> tuple[np.ndarray, np.ndarray]:
    lo = block.offsets[:-1]
    return lo, np.maximum(lo, block.offsets[1:] - GRAM_BYTES + 1)


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = 3 ** np.arange(N_VOTERS)
    for batch in batches:
        for block in text_blocks(batch.column("_text")):
            pattern = (votes(features(block)) + 1) @ powers
            kinds, counts = np.unique(pattern, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["pattern", "n"])


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = 3 ** np.arange(N_VOTERS)
    for batch in batches:
        order = batch.column("_h")
        for block in text_blocks(batch.column("_text")):
            got = features(block)
            pattern = ((votes(got) + 1) @ powers).astype(np.int64)
            bucket, binned = _buckets(block), bin_weights(got)
            lo, hi = _gram_limits(block)
            index, value = [], []
            for k, (a, b) in enumerate(zip(lo.tolist(), hi.tolist())):
                count = np.bincount(bucket[a:b], minlength=N_BUCKETS)
                seen = np.flatnonzero(count)
                index.append(np.concatenate([seen, binned[k]]).astype(np.int32))
                value.append(np.concatenate([count[seen] / max(1, b - a), np.ones(len(BINS))]).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [order.take(pa.array(block.rows)), pa.array(pattern), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))],
                names=["_h", "pattern", "index", "value"],
            )


def train_scorer(sizes: np.ndarray, index: np.ndarray, value: np.ndarray, posterior: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Logistic regression on gram shares and binned features by Adam, whole
    batches, nothing left to chance.  Inputs are scaled by their root mean
    square, and the scale is folded into the weights returned.  ``index`` and
    ``value`` join the inputs of all rows; ``sizes`` are how many each has."""
    weights, bias, n = np.zeros(N_WEIGHTS), 0.0, len(sizes)
    if not n:
        return weights, -1.0
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)
    scale = (np.sqrt(np.bincount(index, value**2, minlength=N_WEIGHTS) / n) + 1e-4).astype(np.float32)
    scale[:N_BUCKETS] *= 30.0  # hundreds of grams against a few bins
    scale[N_BUCKETS:] = 1.0
    value = value / scale[index]
    m, v = np.zeros(N_WEIGHTS + 1), np.zeros(N_WEIGHTS + 1)
    share = np.clip((posterior > 0.5).mean(), 0.05, 0.95)
    balance = np.where(posterior > 0.5, 0.5 / share, 0.5 / (1 - share))
    for step in range(1, epochs + 1):
        margin = np.bincount(row, weights[index] * value, minlength=n) + bias
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - posterior) * balance / n
        grad = np.append(np.bincount(index, error[row] * value, minlength=N_WEIGHTS) + 1e-4 * weights, error.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        change = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        weights, bias = weights - change[:-1], bias - change[-1]
    return weights / scale, float(bias)


def _judge(weights: np.ndarray, bias: float, abuse: Abuse, columns: list[str]):
    pattern = abuse.pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            scores = np.full(len(batch), bias)
            for block in text_blocks(texts):
                bucket = _buckets(block)
                sums = np.concatenate([[0.0], np.cumsum(weights[bucket])])
                lo, hi = _gram_limits(block)
                n = np.maximum(hi - lo, 1)
                lo, hi = np.minimum(lo, len(sums) - 1), np.minimum(hi, len(sums) - 1)
                scores[block.rows] += (sums[hi] - sums[lo]) / n + weights[bin_weights(features(block))].sum(1)
            bad = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
            if pattern:
                found = pc.fill_null(pc.match_substring_regex(texts, pattern, ignore_case=True), False)
                bad = 1 - (1 - bad) * np.where(found.to_numpy(zero_copy_only=False), 1 - abuse.precision, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(bad)], names=[*columns, "p_bad"])

    return run


def _hash_below(column: Column, share: float) -> Column:
    """Whether a hash, spread evenly, is in this share of its range."""
    return column <= min((1 << 63) - 1, int(min(1.0, share) * (1 << 64)) - (1 << 63))


@dataclass
class Abuse:
    """Words that mark abuse, and the share of abusive ones among labelled rows with any."""

    words: tuple[str, ...] = ()
    precision: float = 0.0

    def pattern(self) -> str:
        """Any of the words, not inside of a longer one."""
        return r"(?:^|[^\pL])(?:" + "|".join(self.words) + r")(?:[^\pL]|$)" if self.words else ""


def cover(holders: dict[str, set[int]], n_docs: int, times: int = 3) -> list[str]:
    """Words, each the one that is in most documents which hold fewer than
    ``times`` earlier ones, until a word adds fewer than two documents or than one
    in 500; ties by the word.  Of the many rare words that copies of one document
    share, only so many are taken."""
    out, need, left = [], {d: times for docs in holders.values() for d in docs}, dict(holders)
    while left:
        gain, best = min((-sum(need[d] > 0 for d in docs), word) for word, docs in left.items())
        if -gain < max(2, n_docs / 500):
            break
        out.append(best)
        for d in left.pop(best):
            need[d] -= 1
    return out


def learn_abuse(df: DataFrame, labelled: DataFrame, id_col: str, text_col: str, label_col: str) -> Abuse:
    """Abusive words from a bounded sample of the labelled rows.

    ``labelled`` has ``id_col`` and ``label_col`` (0 or false: clean; null: not
    labelled); an id with several labels is abusive if any is.  Words are runs of
    letters in lower case; equal texts are one, abusive if any is.  Too few
    abusive rows, or none that are clean, give no words."""
    marks = labelled.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int") != 0).alias("_abusive"))
    total = {r["_abusive"]: r["count"] for r in marks.groupBy("_abusive").count().collect()}
    if total.get(True, 0) < MIN_LABELLED or not total.get(False):
        return Abuse()
    share = {k: LABELLED_DOCS / n for k, n in total.items()}
    place = F.xxhash64("_id")
    few = marks.where((F.col("_abusive") & _hash_below(place, share[True])) | (~F.col("_abusive") & _hash_below(place, share[False])))
    # some 2 * LABELLED_DOCS ids, whatever the size of either table
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null").join(F.broadcast(few), "_id")
    texts = texts.groupBy(F.xxhash64("_text").alias("_h")).agg(F.max("_abusive").alias("_abusive"), F.first("_text").alias("_text"))
    work = Workspace(df.sparkSession)
    pairs = work.put("pairs", texts.select("_h", "_abusive", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("word")))
    seen = {r["_abusive"]: r["n"] for r in pairs.groupBy("_abusive").agg(F.countDistinct("_h").alias("n")).collect()}
    if not seen.get(True) or not seen.get(False):
        return Abuse()
    rate = {k: total[k] / seen[k] for k in total}
    count = pairs.groupBy("word").agg(F.count_if("_abusive").alias("a"), F.count_if(~F.col("_abusive")).alias("c"))
    telling = count.where((F.col("a") >= ABUSE_SHARE * seen[True]) & (F.col("a") * rate[True] * (1 - ABUSE_PRECISION) >= F.col("c") * rate[False] * ABUSE_PRECISION))
    holders: dict[str, set[int]] = {}
    clean = set()
    for r in pairs.join(telling.select("word"), "word").select("word", "_h", "_abusive").toLocalIterator():
        if r["_abusive"]:
            holders.setdefault(r["word"], set()).add(r["_h"])
        else:
            clean.add((r["word"], r["_h"]))
    work.drop("pairs")
    words = cover(holders, seen[True])
    right = len(set().union(*(holders[w] for w in words))) * rate[True]
    wrong = len({h for w, h in clean if w in words}) * rate[False]
    return Abuse(tuple(words), (right + 1) / (right + wrong + 2) if words else 0.0)


def fit(df: DataFrame, id_col: str, text_col: str) -> tuple[Votes, np.ndarray, float]:
    """Vote counts cover every document; the scorer's sample is bounded."""
    source = df.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("_h"), F.col(text_col).alias("_text"))
    counted = source.select("_text").mapInArrow(_vote_rows, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    patterns = np.array([r["pattern"] for r in counted], np.int64)
    digits = (patterns[:, None] // 3 ** np.arange(N_VOTERS)[None, :]) % 3 - 1 if len(patterns) else np.zeros((0, N_VOTERS), np.int64)
    if not len(patterns):
        return Votes(0.1, np.full(N_VOTERS, 0.9)), np.zeros(N_WEIGHTS), -1.0
    model = estimate_accuracies(digits, np.array([r["n"] for r in counted], float))
    posterior = dict(zip(patterns.tolist(), model.posterior(digits)))
    # about TRAIN_DOCS documents, found without a sort and without moving other texts
    share = TRAIN_DOCS / max(1, sum(r["n"] for r in counted))
    least = source.where(_hash_below(F.col("_h"), share)).groupBy("_h").agg(F.first("_text").alias("_text"))
    sample = least.mapInArrow(_training_rows, "_h long, pattern long, index array<int>, value array<float>").toArrow()
    sample = sample.take(pa.array(np.argsort(sample.column("_h").to_numpy(), kind="stable"))).combine_chunks()  # sums in one order
    lists = {c: sample.column(c).combine_chunks() for c in ("index", "value")}
    sizes = lists["index"].value_lengths().to_numpy(zero_copy_only=False)
    seen = np.array([posterior.get(p, 0.05) for p in sample.column("pattern").to_pylist()])
    weights, bias = train_scorer(sizes, lists["index"].flatten().to_numpy(), lists["value"].flatten().to_numpy(), seen)
    return model, weights, bias


def quality_classifier(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, labelled: DataFrame | None = None, label_col: str = "toxic"
) -> DataFrame:
    """Judge every row; all columns stay, p_bad (probability of low quality or,
    given labelled rows of ``id_col`` and ``label_col``, of abuse) and kept
    (p_bad < threshold) are added, replacing columns of those names.

    Null texts are empty ones; texts under three bytes have no n-gram and are
    scored by their binned features alone; all labellers abstain under 20 words.
    Repeated rows get one score and are one row of the sample; ties in the
    sample's hash too; a very long text is scored whole by one worker; columns
    with other names pass through; an empty table gives no rows; null ids and
    labels teach nothing, and with fewer than 20 abusive labels there is no cause
    but quality.  The model is fitted when this is called."""
    _, weights, bias = fit(df, id_col, text_col)
    abuse = Abuse() if labelled is None else learn_abuse(df, labelled, id_col, text_col, label_col)
    own = [c for c in df.columns if c.lower() not in ("p_bad", "kept", "_text")]
    schema = T.StructType([df.schema[c] for c in own] + [T.StructField("p_bad", T.DoubleType())])
    judged = df.select(*own, F.col(text_col).alias("_text")).mapInArrow(_judge(weights, bias, abuse, own), schema)
    return judged.withColumn("kept", F.col("p_bad") < threshold)
