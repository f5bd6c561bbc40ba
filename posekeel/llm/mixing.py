"""Mixing sources to target weights by subset-sum budget fitting.

Each source's budget is met with whole passes over the source, then with
documents chosen by exact length: the counts of lengths are scaled down in
proportion, and what that leaves of the budget is settled by bounded-knapsack
dynamic programming over all lengths.  Which documents of a length are taken
is decided by seeded hash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
#: the dynamic programme settles so many longest documents, or more
SETTLED = 4
#: and has so many more documents to choose from, short ones
CHOICES = 16
#: hash bins in which the last document taken of a length is looked for
HASH_BINS = 1024
#: rows of the table of cuts that is broadcast (about 64 bytes each); a larger
#: one is joined by shuffling
BROADCAST_ROWS = 1 << 19


def n_tokens(text: Column) -> Column:
    """Number of blank-separated words, null: 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[float], passes: int = MAX_PASSES) -> list[float]:
    """Targets that share the sum of ``sizes`` by weight, none above
    ``passes`` times its size, the excess reshared by weight."""
    total = float(sum(sizes))
    targets = [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    while open_:
        budget = total - sum(targets[i] for i in range(len(sizes)) if i not in set(open_))
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if budget * weights[i] / whole > passes * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = budget * weights[i] / whole
            break
        for i in over:
            targets[i] = float(passes * sizes[i])
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def _nearest_sum(lengths: Sequence[int], counts: Sequence[int], goal: int, most: int) -> list[int]:
    """How many of each length to take so that the sum, ``most`` at most, is as
    near to ``goal`` as it can be, below it in a tie.  Reachable sums are bits of
    an integer; of each, the first length that reached it is kept."""
    unit = math.gcd(*lengths) or 1
    steps, room = [n // unit for n in lengths], most // unit
    mask = (1 << (room + 1)) - 1
    owner = np.full(room + 1, -1, np.int32)
    reach = 1
    for i, (length, count) in enumerate(zip(steps, counts)):
        if goal % unit == 0 and (reach >> (goal // unit)) & 1:
            break
        old, left, power = reach, min(count, room // length), 1
        while left > 0:  # binary splitting of the bound
            k = min(power, left)
            reach |= (reach << (k * length)) & mask
            left -= k
            power *= 2
        if reach != old:
            new = np.frombuffer((reach ^ old).to_bytes(room // 8 + 1, "little"), np.uint8)
            owner[np.flatnonzero(np.unpackbits(new, bitorder="little"))] = i
    below = (reach & ((1 << (goal // unit + 1)) - 1)).bit_length() - 1
    above = reach >> (goal // unit + 1)
    at = goal // unit + (above & -above).bit_length() if above else below
    if goal - below * unit <= at * unit - goal:
        at = below
    taken = [0] * len(steps)
    while at > 0:
        i = owner[at]
        taken[i] += 1
        at -= steps[i]
    return taken


def fit_counts(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """Documents of each length whose sum is near ``budget``, 0 included: the
    nearest there is if the budget is within SETTLED times the longest length.

    Counts in proportion leave less than one document of each length; those are
    added from the longest down.  Then documents are given back, one of each
    length in turn, until the dynamic programme has room for SETTLED longest
    ones, and CHOICES short ones; it finds the nearest sum, a longest document
    past the budget too."""
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    take = [budget * c // total for c in counts]
    gap = budget - sum(n * t for n, t in zip(lengths, take))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    longest = lengths[order[0]]
    for i in order:
        if gap >= lengths[i] + SETTLED * longest and counts[i] > take[i]:
            take[i] += 1
            gap -= lengths[i]
    if gap == 0:
        return take
    while gap < SETTLED * longest and any(take):
        for i in order:
            if take[i] and gap < SETTLED * longest:
                take[i] -= 1
                gap += lengths[i]
    more = CHOICES
    for i in reversed(order):
        back = min(more, take[i])
        take[i], gap, more = take[i] - back, gap + back * lengths[i], more - back
    spare = [i for i in range(len(lengths)) if lengths[i] > 0 and counts[i] > take[i]]
    for i, more in zip(spare, _nearest_sum([lengths[i] for i in spare], [counts[i] - take[i] for i in spare], gap, gap + longest)):
        take[i] += more
    return take


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, seed: int = 20240229, size: Column | None = None
) -> DataFrame:
    """Mix all sources so that each gives about its target of words.

    Sources are ordered by code point, null last, and weigh ``weights`` in
    turn; together they give as many words as there are, none more than three
    times its own.  All columns of ``df`` are kept; added are size, source_size,
    target and taken (words the mix takes of the document, a multiple of size
    up to three times), which replace columns of those names.  A null text has
    size 0 and takes 0, an empty one too; documents of one source and length
    are chosen by a seeded hash of id and text, ties (repeated rows) in any one
    order, which changes no total; a very long text makes the dynamic programme
    as large as SETTLED such texts have words; an empty table gives no rows.
    Work tables are written when this is called."""
    count = n_tokens(F.col(text_col)) if size is None else size
    own = [c for c in df.columns if c.lower() not in ("size", "source_size", "target", "taken")]
    keys = {
        "_n": count,
        "_s": F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("")),
        "_h": F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)),
    }
    work = Workspace(df.sparkSession)
    # Source, length and hash of every document, counted and read once; all
    # that follows is decided on it.
    rows = work.put("rows", df.select(*[c.alias(k) for k, c in keys.items()]).withColumn("_bin", F.pmod("_h", F.lit(HASH_BINS)).cast("int")))
    bins = work.put("bins", rows.groupBy("_s", "_n", "_bin").agg(F.count(F.lit(1)).alias("c")))
    lengths = bins.groupBy("_s", "_n").agg(F.sum("c").alias("count"))
    # One row for each source comes to the driver, as the targets hang together.
    sums = {r[0]: int(r[1]) for r in lengths.groupBy("_s").agg(F.sum(F.col("_n") * F.col("count")).alias("words")).collect()}
    names = sorted(sums, key=lambda s: (s == "", s))
    targets = water_fill([sums[s] for s in names], [weights[i % len(weights)] for i in range(len(names))])
    budget = [(s, sums[s], t) for s, t in zip(names, targets)]
    plan = df.sparkSession.createDataFrame(budget, "_s string, _total long, _target double")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_n")
        used = frame[frame["_n"] > 0]
        total, target = int(frame["_total"].iloc[0]), int(round(frame["_target"].iloc[0]))
        passes = min(MAX_PASSES, target // total) if total else 0
        rest = fit_counts(used["_n"].tolist(), used["count"].tolist(), target - passes * total) if total and passes < MAX_PASSES else [0] * len(used)
        return frame[["_s", "_n", "_total", "_target"]].assign(_passes=passes, quota=[0] * (len(frame) - len(used)) + rest)

    # Rows of a source here are its distinct lengths, not its documents.
    quotas = work.put("quotas", lengths.join(plan, "_s").groupBy("_s").applyInPandas(fit, "_s string, _n long, _total long, _target double, _passes long, quota long"))
    # Of each length, the documents of least hash are taken: bins up to the cut
    # as a whole, and of the cut's bin (one for each length) so many.
    running = Window.partitionBy("_s", "_n").orderBy("_bin")
    upto = bins.withColumn("upto", F.sum("c").over(running)).join(quotas.select("_s", "_n", "quota"), ["_s", "_n"])
    cuts = upto.where((F.col("upto") - F.col("c") < F.col("quota")) & (F.col("quota") < F.col("upto"))).select("_s", "_n", "_bin", (F.col("quota") - F.col("upto") + F.col("c")).alias("left"))
    ranked = rows.join(cuts, ["_s", "_n", "_bin"]).groupBy("_s", "_n", "_bin", "_h", "left").agg(F.count(F.lit(1)).alias("same"))
    order = Window.partitionBy("_s", "_n", "_bin").orderBy("_h")
    last = ranked.withColumn("before", F.sum("same").over(order) - F.col("same")).where(F.col("before") < F.col("left"))
    last = last.groupBy("_s", "_n").agg(F.max(F.struct("_h", (F.col("left") - F.col("before")).alias("more"), "same")).alias("last"))
    ends = upto.where(F.col("upto") <= F.col("quota")).groupBy("_s", "_n").agg(F.max("_bin").alias("full"))
    cut = cuts.select("_s", "_n", F.col("_bin").alias("edge"))
    table = work.put("cuts", quotas.drop("quota").join(ends, ["_s", "_n"], "left").join(cut, ["_s", "_n"], "left").join(last, ["_s", "_n"], "left"))
    # documents stay where they are while the table is known to be small
    small = table.count() <= BROADCAST_ROWS
    marked = df.select(*own, *[c.alias(k) for k, c in keys.items()]).join(F.broadcast(table) if small else table, ["_s", "_n"])
    at = F.pmod("_h", F.lit(HASH_BINS)).cast("int")
    tied = F.coalesce((at == F.col("edge")) & (F.col("_h") == F.col("last._h")) & (F.col("last.more") < F.col("last.same")), F.lit(False))
    under = F.coalesce(at <= F.col("full"), F.lit(False)) | F.coalesce((at == F.col("edge")) & (F.col("_h") <= F.col("last._h")), F.lit(False))
    whole = marked.where(~tied).withColumn("_extra", under.cast("int"))
    if not table.where("last.more < last.same").isEmpty():  # rows that repeat whole, of which only some are taken
        rank = F.row_number().over(Window.partitionBy("_s", "_n", "_h").orderBy(F.lit(0)))
        whole = whole.unionByName(marked.where(tied).withColumn("_extra", (rank <= F.col("last.more")).cast("int")))
    work.drop("rows", "bins", "quotas")
    taken = (F.col("_n") * (F.col("_passes") + F.col("_extra"))).cast("long")
    return whole.select(*own, F.col("_n").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"))
