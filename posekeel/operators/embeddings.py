"""Appearance outliers over embedding columns (id, group, vector)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posekeel.functions.columns import dot, round_half_up, schema_with, unit
from posekeel.functions.ranks import mean_rank, sums_before, value_counts

#: rows of a block of the reference that is broadcast
BLOCK_ROWS = 20000
#: queries of a block from which the others' k-th distance is bounded
BOUND_ROWS = 2048


def stratified_reference(df: DataFrame, group: str, order: str, share: float = 0.2, least: int = 20) -> DataFrame:
    """Every (n / take)-th row of each group in order of a numeric id; take is a
    share of the group, ``least`` rows at least."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    numbered = sums_before(df.withColumn("_one", F.lit(1)), order, ["_one"], [group]).withColumnRenamed("before__one", "_i").join(sizes, group)
    take = F.least(F.col("_n"), F.greatest(F.lit(least), round_half_up(F.col("_n") * share))).cast("long")
    t = F.ceil(F.col("_i") * take / F.col("_n"))
    kept = numbered.where((F.floor(t * F.col("_n") / take) == F.col("_i")) & (t < take))
    return kept.select(*df.columns)


def _reference_blocks(df: DataFrame, id_col: str, vec_col: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The reference in blocks of bounded size, one at a time on the driver."""
    ids, rows = [], []
    for r in df.select(id_col, vec_col).toLocalIterator(prefetchPartitions=True):
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == BLOCK_ROWS:
            yield np.array(ids), np.array(rows, float)
            ids, rows = [], []
    if ids:
        yield np.array(ids), np.array(rows, float)


def knn_outlier(df: DataFrame, reference: DataFrame, id_col: str, vec_col: str, k: int = 6) -> DataFrame:
    """Adds knn: mean distance to the k nearest reference rows, never itself
    (k is cut to one less than the reference; 0 without two).  Each block of the
    reference is broadcast by itself; rows carry their k least distances."""
    size = reference.count()
    kk = min(k, size - 1)
    if kk <= 0:
        return df.withColumn("knn", F.lit(0.0))
    out = df.withColumn("_least", F.array().cast("array<double>"))
    schema = out.schema

    def step(shared: Broadcast):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, ref = shared.value
            for frame in frames:
                best = []
                for at in range(0, len(frame), 512):
                    part = frame.iloc[at : at + 512]
                    d = 2 - 2 * np.stack(part[vec_col].to_numpy()).astype(float) @ ref.T
                    d[part[id_col].to_numpy()[:, None] == ids[None, :]] = np.inf
                    take = min(kk, d.shape[1])
                    near = np.partition(d, take - 1, axis=1)[:, :take]
                    best += [np.sort(np.concatenate([old, new]))[:kk] for old, new in zip(part["_least"], near)]
                yield frame.assign(_least=best)

        return run

    for block in _reference_blocks(reference, id_col, vec_col):
        out = out.mapInPandas(step(df.sparkSession.sparkContext.broadcast(block)), schema)
    least = F.transform("_least", lambda d: F.sqrt(F.greatest(d, F.lit(0.0))))
    return out.withColumn("knn", F.aggregate(least, F.lit(0.0), lambda a, d: a + d) / kk).drop("_least")


def nearest(df: DataFrame, query_id: object, id_col: str, vec_col: str, k: int = 5) -> DataFrame:
    """The k rows nearest to one row, by distance then id: a top-k plan.
    Without that row there are none."""
    found = df.where(F.col(id_col) == query_id).select(vec_col).first()
    if found is None:
        return df.withColumn("distance", F.lit(0.0)).limit(0)
    vector = F.lit(found[0])
    rest = df.where(F.col(id_col) != query_id).withColumn("distance", F.lit(2.0) - F.lit(2.0) * dot(F.col(vec_col), vector))
    return rest.orderBy("distance", id_col).limit(k)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, summed in order of the dimensions: copies of
    a row have the same product wherever they stand."""
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T):
        out += x[:, None] * y[None, :]
    return out


def _merge_nearest(found: pd.DataFrame, k: int) -> pd.DataFrame:
    return found.sort_values(["query_id", "distance", "id"]).groupby("query_id", sort=False).head(k)


def nearest_each(df: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 5) -> DataFrame:
    """(query_id, id, distance) of the k rows nearest to each query, by distance
    then id, never itself; fewer if there are no more rows.

    Queries are rows of ``df``, in blocks that are broadcast one by one.  A task
    keeps k rows of each query, and only those that are as near as the k-th of
    some other queries of the block: what tasks send grows with the queries."""
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField(id_col, kind), T.StructField("distance", T.DoubleType())])

    def step(shared: Broadcast):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, vectors, bound = shared.value
            bound, best = bound.copy(), None
            for frame in frames:
                for at in range(0, len(frame), 512):
                    part = frame.iloc[at : at + 512]
                    own, x = part[id_col].to_numpy(), np.stack(part[vec_col].to_numpy()).astype(float)
                    found = [] if best is None else [best]
                    for q in range(0, len(ids), 1024):
                        d = 2 - 2 * _products(vectors[q : q + 1024], x)
                        i, j = np.nonzero((d <= bound[q : q + 1024, None]) & (ids[q : q + 1024, None] != own[None, :]))
                        found.append(pd.DataFrame({"at": i + q, "query_id": ids[i + q], "id": own[j], "distance": d[i, j]}))
                    best = _merge_nearest(pd.concat(found, ignore_index=True), k)
                    full = best.groupby("at")["distance"].agg(["size", "max"])
                    full = full[full["size"] == k]
                    bound[full.index] = np.minimum(bound[full.index], full["max"])
            if best is not None:
                yield best[["query_id", "id", "distance"]].rename(columns={"id": id_col})

        return run

    out = None
    rows = df.select(id_col, vec_col).where(F.col(id_col).isNotNull())
    for ids, vectors in _reference_blocks(queries, id_col, vec_col):
        bound = np.full(len(ids), np.inf)
        if len(ids) > k:
            some = slice(0, BOUND_ROWS)
            for q in range(0, len(ids), 1024):
                d = 2 - 2 * _products(vectors[q : q + 1024], vectors[some])
                d[ids[q : q + 1024, None] == ids[some][None, :]] = np.inf
                if d.shape[1] > k:
                    bound[q : q + 1024] = np.partition(d, k - 1, axis=1)[:, k - 1]
        shared = df.sparkSession.sparkContext.broadcast((ids, vectors, bound))
        near = rows.mapInPandas(step(shared), schema)
        out = near if out is None else out.unionByName(near)
    if out is None:
        return df.sparkSession.createDataFrame([], schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", id_col))
    return out.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def robust_z(df: DataFrame, value: str, groups: list[str], least: int = 1) -> DataFrame:
    """Adds z within groups; groups under ``least`` rows get 0.  Medians are
    aggregated, then joined: no group is held in one task."""
    def median(rows: DataFrame, column: str, name: str) -> DataFrame:
        freq = rows.groupBy(*groups, column).agg(F.count(F.lit(1)).alias("_f"))
        return freq.groupBy(*groups).agg(F.expr(f"percentile({column}, 0.5, _f)").alias(name), F.sum("_f").alias(f"{name}_n"))

    joined = df.join(median(df, value, "_m"), groups).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    scale = median(joined, "_d", "_mad").withColumn("_mad", F.when(F.col("_mad") == 0, F.lit(1e-9)).otherwise(F.col("_mad")))
    z = (F.col(value) - F.col("_m")) / (F.lit(1.4826) * F.col("_mad"))
    return joined.join(scale, groups).withColumn("z", F.when(F.col("_m_n") < least, F.lit(0.0)).otherwise(z)).drop("_m", "_m_n", "_d", "_mad", "_mad_n")


def mean_vector(df: DataFrame, vec_col: str) -> list[float]:
    """Mean of each dimension; one row comes back whatever the size."""
    long = df.select(F.posexplode(vec_col).alias("d", "v")).groupBy("d").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return [r["m"] for r in long.orderBy("d").collect()]


def prototype(df: DataFrame, faulty: Column, clean: Column, vec_col: str, least_clean: int = 3) -> list[float] | None:
    """Unit direction from clean (from all, if too few are clean) to faulty."""
    bad = mean_vector(df.where(faulty), vec_col)
    if not bad:
        return None
    few = df.where(clean).limit(least_clean).count() < least_clean
    rest = mean_vector(df if few else df.where(clean), vec_col)
    w = np.subtract(bad, rest)
    return (w / (np.sqrt((w**2).sum()) or 1.0)).tolist()


def prototype_scores(df: DataFrame, direction: list[float], vec_col: str) -> DataFrame:
    return df.withColumn("prototype", dot(unit(F.col(vec_col)), F.lit(direction)))


def rank_blend(df: DataFrame, base: str, extra: str, alpha: float) -> DataFrame:
    """Adds blend: weighted mean of the two ranks; with weight 0 the base as it is."""
    alpha = min(1.0, max(0.0, alpha))
    if alpha == 0:
        return df.withColumn("blend", F.col(base))
    n = F.lit(df.count())
    for name in (base, extra):
        counts = sums_before(value_counts(df, name), name, ["_c"])
        df = df.join(counts.select(name, mean_rank(F.col("before__c"), F.col("_c"), n).alias(f"_rank_{name}")), name)
    return df.withColumn("blend", F.col(f"_rank_{base}") * (1 - alpha) + F.col(f"_rank_{extra}") * alpha).drop(f"_rank_{base}", f"_rank_{extra}")


def rank_in_group(df: DataFrame, value: str, group: str) -> DataFrame:
    """Adds rank: from 0 to 1 within each group, ties sharing their mean."""
    counts = sums_before(value_counts(df, value, [group]), value, ["_c"], [group])
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    ranks = counts.join(sizes, group).select(group, value, mean_rank(F.col("before__c"), F.col("_c"), F.col("_n")).alias("rank"))
    return df.join(ranks, [group, value])


# ------------------------------------------------------------ patch memory bank


def memory_bank(tokens: list[np.ndarray], owners: list, budget: int = 2048, places: list[int] | None = None, size: int | None = None) -> tuple[np.ndarray, list]:
    """Up to ``budget`` tokens split evenly over crops, from rotated places.
    ``tokens[i]`` are the unit tokens of crop ``owners[i]``, number ``places[i]``
    of ``size`` crops if only those that give a token are passed."""
    places = list(range(len(tokens))) if places is None else places
    size = len(tokens) if size is None else size
    whole = sum(map(len, tokens)) if size == len(tokens) else size * len(tokens[0])
    take = min(whole, max(1, budget))
    rows, own = [], []
    for u, t, owner in zip(places, tokens, owners):
        share = min(len(t), (u + 1) * take // size - u * take // size)
        picked = [(j * len(t) // share + u) % len(t) for j in range(share)]
        rows += [t[i] for i in picked]
        own += [owner] * len(picked)
    return np.array(rows[:take]), own[:take]


def tokens_of(vector: np.ndarray, n_tokens: int) -> np.ndarray:
    t = np.asarray(vector, float).reshape(n_tokens, -1)
    norm = np.sqrt((t**2).sum(1, keepdims=True))
    return t / np.where(norm == 0, 1.0, norm)


def top_mean(d: np.ndarray, share: float = 0.25) -> float:
    """Mean of the largest share of the values, one at least."""
    if not len(d):
        return 0.0
    take = min(len(d), max(1, int(np.ceil(share * len(d)))))
    return float(np.sort(d)[::-1][:take].mean())


def patch_scores(df: DataFrame, reference: DataFrame, id_col: str, vec_col: str, n_tokens: int, share: float = 0.25, budget: int = 2048) -> DataFrame:
    """Adds patch: top mean of each token's distance to its nearest bank token
    of another crop; a bank under two tokens gives 0."""
    size = reference.count()
    take = min(size * n_tokens, max(1, budget))
    # a crop gives the tokens between two multiples; most give none if there
    # are more crops than tokens, and those are not kept on the driver
    ids, crops, places = [], [], []
    for u, r in enumerate(reference.select(id_col, vec_col).orderBy(id_col).toLocalIterator()):
        if size * n_tokens <= budget or (u + 1) * take // size > u * take // size:
            ids.append(r[0])
            crops.append(tokens_of(r[1], n_tokens))
            places.append(u)
    bank, owners = memory_bank(crops, ids, budget, places, size) if ids else (np.zeros((0, 1)), [])
    shared = df.sparkSession.sparkContext.broadcast((bank, np.array(owners)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bank, owners = shared.value
        for frame in frames:
            out = np.zeros(len(frame))
            for i, (own, v) in enumerate(zip(frame[id_col], frame[vec_col])) if len(bank) >= 2 else ():
                near = np.where(owners[None, :] == own, -np.inf, tokens_of(v, n_tokens) @ bank.T).max(1)
                out[i] = top_mean(np.where(np.isfinite(near), 1 - near, 0.0), share)
            yield frame.assign(patch=out)

    return df.mapInPandas(run, schema_with(df, patch=T.DoubleType()))


def appearance_scores(df: DataFrame, reference: DataFrame, id_col: str, vec_col: str, n_tokens: int, k: int = 6, share: float = 0.25, budget: int = 2048) -> DataFrame:
    """Adds score and scorer: patch distances where vectors divide into tokens
    and the bank has two at least, else kNN distances, which scorer says."""
    first = reference.select(F.size(vec_col).alias("d")).first()
    if first is None or first["d"] % n_tokens or min(reference.limit(3).count() * n_tokens, budget) < 2:
        return knn_outlier(df, reference, id_col, vec_col, k).withColumnRenamed("knn", "score").withColumn("scorer", F.lit("knn"))
    return patch_scores(df, reference, id_col, vec_col, n_tokens, share, budget).withColumnRenamed("patch", "score").withColumn("scorer", F.lit("patch"))


def packed(df: DataFrame, vec_col: str, n_tokens: int, grid: int = 4, dim: int = 64) -> DataFrame:
    """Adds packed: the tokens of each vector, pooled and quantised to bytes;
    null where they are no square or the vector is null."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [None if v is None else pack_tokens(np.asarray(v, float).reshape(n_tokens, -1), grid, dim) for v in frame[vec_col]]
            yield frame.assign(packed=[None if g is None else g.tobytes() for g in got])

    return df.mapInPandas(run, schema_with(df, packed=T.BinaryType()))


def unpacked(df: DataFrame, packed_col: str = "packed", dim: int = 64) -> DataFrame:
    """Adds tokens: the unit tokens of a packed column, one after the other."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(tokens=[None if v is None else unpack_tokens(np.frombuffer(v, np.int8), dim).ravel().tolist() for v in frame[packed_col]])

    return df.mapInPandas(run, schema_with(df, tokens=T.ArrayType(T.DoubleType())))


def pack_tokens(tokens: np.ndarray, grid: int = 4, dim: int = 64, seed: int = 0x5EED1E) -> np.ndarray | None:
    """Pool a square of tokens to grid x grid, project to ``dim`` by a seeded
    Gaussian matrix, and quantise each unit token to a byte."""
    from posekeel.functions.numeric import seeded_normals

    count, depth = tokens.shape
    side = int(np.floor(np.sqrt(count) + 0.5))
    if side * side != count or not count:
        return None
    cells = max(1, min(side, grid))
    square = tokens.reshape(side, side, depth)
    matrix = (seeded_normals(seed, depth * dim) / np.sqrt(dim)).reshape(depth, dim)
    edge = [(i * side // cells, max(i * side // cells + 1, (i + 1) * side // cells)) for i in range(cells)]
    pooled = np.array([square[a:b, c:d].reshape(-1, depth).mean(0) for a, b in edge for c, d in edge])
    scaled = lambda v: v / np.where((n := np.sqrt((v**2).sum(1, keepdims=True))) == 0, 1.0, n)
    return np.clip(np.floor(scaled(scaled(pooled) @ matrix) * 127 + 0.5), -127, 127).astype(np.int8)


def unpack_tokens(packed: np.ndarray, dim: int = 64) -> np.ndarray:
    return tokens_of(packed.astype(float).ravel(), packed.size // dim)


# ------------------------------------------------------------------------- pca


def pca2(df: DataFrame, id_col: str, vec_col: str, rounds: int = 40) -> DataFrame:
    """Coordinates on the first two components.  Means and products of pairs of
    dimensions are summed by Spark; power iteration runs on that small matrix."""
    size = F.size(vec_col)
    d = df.select(size.alias("d")).first()
    if d is None:
        return df.select(id_col, F.lit(0.0).alias("pc1"), F.lit(0.0).alias("pc2"))
    dim = d["d"]

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, outer, n = np.zeros(dim), np.zeros((dim, dim)), 0
        for frame in frames:
            x = np.stack(frame[vec_col].to_numpy()).astype(float)
            total += x.sum(0)
            outer += x.T @ x
            n += len(x)
        yield pd.DataFrame({"i": np.arange(dim + 1), "n": n, "v": [*outer, total]})

    sums = df.select(vec_col).mapInPandas(products, "i int, n long, v array<double>")
    long = sums.select("i", "n", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toPandas()
    table = np.zeros((dim + 1, dim))
    table[long["i"], long["j"]] = long["v"]
    n = max(1, int(long["n"].max()))
    mean = table[dim] / n
    cov = table[:dim] / n - np.outer(mean, mean)
    start = np.asarray(df.orderBy(id_col).select(vec_col).first()[0], float) - mean + (np.arange(dim) % 7 - 3) * 1e-3 + 1e-6
    axes: list[np.ndarray] = []
    for _ in range(2):
        v = start.copy()
        for _ in range(rounds):
            v = cov @ v
            for a in axes:
                v = v - (v @ a) * a
            v = v / (np.sqrt(v @ v) or 1.0)
        axes.append(v)
    centred = F.zip_with(F.col(vec_col), F.lit(mean.tolist()), lambda x, m: x.cast("double") - m)
    return df.withColumn("_c", centred).select(id_col, dot(F.col("_c"), F.lit(axes[0].tolist())).alias("pc1"), dot(F.col("_c"), F.lit(axes[1].tolist())).alias("pc2"))
