"""Pose geometry as SQL expressions generated from the skeleton.

Coordinates are columns x0, y0, x1, ...; an invisible node is null, and null
spreads by itself through distances and angles.  Expressions are layered, so
each is short and stays inside one generated stage.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from posekeel.skeleton import Skeleton

Layer = dict[str, str]
Stat = Callable[[str], str]
#: above so many generated pair expressions, geometry goes through arrays in a
#: vectorised function instead (the code of one stage has a size limit)
MAX_PAIR_EXPRESSIONS = 120
#: bytes of code above which the JVM only interprets a method: a stage with a
#: larger one is better made of split expressions
JIT_LIMIT = "8000"


def add_layers(df: DataFrame, layers: Sequence[Layer]) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", JIT_LIMIT)
    for layer in layers:
        df = df.selectExpr("*", *[f"{sql} AS {name}" for name, sql in layer.items()])
    return df


def layers_sql(source: str, layers: Sequence[Layer]) -> str:
    for layer in layers:
        source = f"(SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in layer.items())} FROM {source})"
    return source


def distance(i: int, j: int) -> str:
    return f"sqrt((x{i} - x{j}) * (x{i} - x{j}) + (y{i} - y{j}) * (y{i} - y{j}))"


def pair_name(i: int, j: int) -> str:
    return f"d_{min(i, j)}_{max(i, j)}"


def angle(c: int, a: int, b: int) -> str:
    """Angle at c between a and b; null if an arm is shorter than 1e-6."""
    one, two = pair_name(c, a), pair_name(c, b)
    inner = f"((x{a} - x{c}) * (x{b} - x{c}) + (y{a} - y{c}) * (y{b} - y{c})) / nullif({one} * {two}, 0.0)"
    return f"CASE WHEN {one} IS NULL OR {two} IS NULL OR {one} < 1e-6 OR {two} < 1e-6 THEN NULL ELSE acos(least(1.0, greatest(-1.0, {inner}))) END"


def visible(i: int) -> str:
    return f"x{i} IS NOT NULL AND y{i} IS NOT NULL"


def total(parts: Sequence[str]) -> str:
    return "(" + " + ".join(f"coalesce({p}, 0.0)" for p in parts) + ")" if parts else "0.0"


def known(parts: Sequence[str]) -> str:
    return "(" + " + ".join(f"(CASE WHEN {p} IS NULL THEN 0 ELSE 1 END)" for p in parts) + ")" if parts else "0"


def most(parts: Sequence[str], default: str = "0.0") -> str:
    if not parts:
        return default
    return f"coalesce({parts[0] if len(parts) == 1 else 'greatest(' + ', '.join(parts) + ')'}, {default})"


def mean_of(parts: Sequence[str]) -> str:
    return f"coalesce({total(parts)} / nullif({known(parts)}, 0), 0.0)"


def measures(s: Skeleton) -> list[Layer]:
    """Distances, angles, bounding box and centroid of each pose."""
    nodes = range(s.n_nodes)
    first: Layer = {pair_name(i, j): distance(i, j) for i, j in s.node_pairs()}
    first |= {f"v{i}": f"(CASE WHEN {visible(i)} THEN 1 ELSE 0 END)" for i in nodes}
    first |= {f"{op}_{axis}": f"{fn}({', '.join(f'{axis}{i}' for i in nodes)})" for axis in "xy" for op, fn in (("lo", "least"), ("hi", "greatest"))}
    second: Layer = {f"a_{c}_{a}_{b}": angle(c, a, b) for c, a, b in s.angle_triplets()}
    second["n_visible"] = "(" + " + ".join(f"v{i}" for i in nodes) + ")"
    third: Layer = {
        "bbox_area": "CASE WHEN n_visible < 2 THEN NULL ELSE (hi_x - lo_x) * (hi_y - lo_y) END",
        "cx": f"CASE WHEN n_visible < 2 THEN NULL ELSE {total([f'x{i}' for i in nodes])} / n_visible END",
        "cy": f"CASE WHEN n_visible < 2 THEN NULL ELSE {total([f'y{i}' for i in nodes])} / n_visible END",
    }
    fourth: Layer = {f"r{i}": f"sqrt((x{i} - cx) * (x{i} - cx) + (y{i} - cy) * (y{i} - cy))" for i in nodes}
    return [first, second, third, fourth]


def measure_names(s: Skeleton) -> list[str]:
    """Measures whose mean and deviation are learned."""
    return [pair_name(i, j) for i, j in s.node_pairs()] + [f"a_{c}_{a}_{b}" for c, a, b in s.angle_triplets()] + ["bbox_area"]


def fit_aggregates(names: Sequence[str], floor: float = 1e-6) -> list[str]:
    """One pass over the fit rows: m_<name> and s_<name>."""
    return [f"coalesce(avg({n}), 0.0) AS m_{n}" for n in names] + [f"greatest(coalesce(stddev_pop({n}), 0.0), {floor}) AS s_{n}" for n in names]


def symmetry(s: Skeleton) -> str:
    """Least consistency over left/right pairs; 1 with fewer than two."""
    if len(s.pairs) < 2:
        return "1.0"
    scores = []
    for l1, r1 in s.pairs:
        terms = []
        for l2, r2 in s.pairs:
            if (l2, r2) != (l1, r1):
                ratio = f"{pair_name(l1, l2)} / greatest({pair_name(l1, r2)}, 1e-6)"
                terms.append(f"CASE WHEN v{l1} + v{r1} + v{l2} + v{r2} < 4 THEN NULL WHEN {ratio} < 0.9 THEN 1.0 WHEN {ratio} <= 1.1 THEN 0.5 ELSE 0.0 END")
        scores.append(f"({total(terms)} / nullif({known(terms)}, 0))")
    return f"coalesce(least({', '.join(scores)}), 1.0)"


def isolated(s: Skeleton) -> str:
    tests = [f"(v{i} = 0 AND {' AND '.join(f'v{n} = 1' for n in near)})" for i, near in enumerate(s.neighbours) if near]
    return f"CASE WHEN {' OR '.join(tests)} THEN 1.0 ELSE 0.0 END" if tests else "0.0"


def baseline_features(s: Skeleton, stat: Stat) -> list[Layer]:
    """The first twelve features.  ``stat`` gives the SQL of a fitted value."""
    def z(name: str) -> str:
        return f"(({name} - {stat('m_' + name)}) / {stat('s_' + name)})"

    edges = [pair_name(a, b) for a, b in s.edges]
    angles = [f"a_{c}_{a}_{b}" for c, a, b in s.angle_triplets()]
    pairs = [pair_name(i, j) for i, j in s.node_pairs()]
    radii = [f"r{i}" for i in range(s.n_nodes)]
    zs: Layer = {f"z_{n}": z(n) for n in dict.fromkeys(pairs + angles)}
    as_double = lambda layer: {n: f"CAST({sql} AS DOUBLE)" for n, sql in layer.items()}
    absolute = lambda names: [f"abs(z_{n})" for n in names]
    spread = [f"({r} - mean_r) * ({r} - mean_r)" for r in radii]
    return [
        zs | {"mean_r": mean_of(radii)},
        as_double({
            "max_edge_zscore": most(absolute(edges)), "mean_edge_zscore": mean_of(absolute(edges)),
            "max_angle_zscore": most(absolute(angles)), "mean_angle_zscore": mean_of(absolute(angles)),
            "max_pairwise_zscore": most(absolute(pairs)), "mean_pairwise_zscore": mean_of(absolute(pairs)),
            "bbox_area_zscore": f"coalesce({z('bbox_area')}, 0.0)",
            "max_centroid_distance": most(radii), "centroid_distance_std": f"sqrt({mean_of(spread)})",
            "min_symmetry_consistency": symmetry(s), "visibility_rate": f"n_visible / {float(s.n_nodes)}", "has_isolated_invisible": isolated(s),
        }),
    ]


def turn(prev: int, here: int, nxt: int) -> str:
    """Signed deviation from a straight line at an inner node of a chain."""
    cross = f"((x{prev} - x{here}) * (y{nxt} - y{here}) - (y{prev} - y{here}) * (x{nxt} - x{here}))"
    inner = f"((x{prev} - x{here}) * (x{nxt} - x{here}) + (y{prev} - y{here}) * (y{nxt} - y{here})) / nullif({pair_name(prev, here)} * {pair_name(here, nxt)}, 0.0)"
    bend = f"({3.141592653589793} - acos(least(1.0, greatest(-1.0, {inner}))))"
    one, two = pair_name(prev, here), pair_name(here, nxt)
    short = f"{one} IS NULL OR {two} IS NULL OR {one} < 1e-8 OR {two} < 1e-8"
    return f"CASE WHEN {short} THEN NULL WHEN {cross} < 0 THEN -{bend} ELSE {bend} END"


def curvature(chain: Sequence[int]) -> list[Layer]:
    bends = {f"k{i}": turn(chain[i - 1], chain[i], chain[i + 1]) for i in range(1, len(chain) - 1)}
    if not bends:
        return [{c: "CAST(0.0 AS DOUBLE)" for c in ("max_curvature", "mean_curvature", "curvature_std")}]
    names = list(bends)
    return [
        bends,
        {"mean_k": mean_of(names)},
        {
            "max_curvature": most([f"abs({n})" for n in names]),
            "mean_curvature": mean_of([f"abs({n})" for n in names]),
            "curvature_std": f"sqrt({mean_of([f'({n} - mean_k) * ({n} - mean_k)' for n in names])})",
        },
    ]


def co_visibility(s: Skeleton) -> list[str]:
    """P(j visible | i visible) for all i, j as p_i_j, in one pass."""
    return [f"coalesce(avg(CASE WHEN v{i} = 1 THEN v{j} * 1.0 END), 0.0) AS p_{i}_{j}" for i in range(s.n_nodes) for j in range(s.n_nodes) if i != j]


def visibility_pattern(s: Skeleton, stat: Stat) -> Layer:
    """Share of surprising presences and absences, one at most."""
    n = s.n_nodes
    terms = [
        f"(CASE WHEN v{i} = 1 AND v{j} = 0 AND {stat(f'p_{i}_{j}')} > 0.9 THEN 1 WHEN v{i} = 1 AND v{j} = 1 AND {stat(f'p_{i}_{j}')} < 0.1 THEN 1 ELSE 0 END)"
        for i in range(n) for j in range(n) if i != j
    ]
    return {"visibility_pattern_score": f"CAST(least(1.0, ({' + '.join(terms) or '0'}) / {float(max(1, n))}) AS DOUBLE)"}


def straddle(a: int, b: int, c: int, d: int) -> str:
    """Whether segments ab and cd properly cross, no orientation under 1e-8."""
    def side(p: int, q: int, r: int) -> str:
        return f"((x{q} - x{p}) * (y{r} - y{p}) - (y{q} - y{p}) * (x{r} - x{p}))"

    o = [side(c, d, a), side(c, d, b), side(a, b, c), side(a, b, d)]
    apart = f"({o[0]} > 0) <> ({o[1]} > 0) AND ({o[2]} > 0) <> ({o[3]} > 0)"
    return f"(CASE WHEN {apart} AND least({', '.join(f'abs({x})' for x in o)}) > 1e-8 THEN 1 ELSE 0 END)"


def ordering(chains: Sequence[Sequence[int]], max_turn: float = 3.141592653589793 / 3) -> list[Layer]:
    """Inversion rate, crossings and the combined score of ordered chains."""
    turns, rates, crossings = {}, [], []
    for c, chain in enumerate(chains):
        names = []
        for i in range(1, len(chain) - 1):
            names.append(f"t_{c}_{i}")
            turns[names[-1]] = f"abs({turn(chain[i - 1], chain[i], chain[i + 1])})"
        rates.append(f"coalesce({total([f'(CASE WHEN {n} > {max_turn} THEN 1.0 WHEN {n} IS NOT NULL THEN 0.0 END)' for n in names])} / nullif({known(names)}, 0), 0.0)")
        found = [straddle(chain[i], chain[i + 1], chain[j], chain[j + 1]) for i in range(len(chain) - 1) for j in range(i + 2, len(chain) - 1)]
        crossings.append(" + ".join(found) or "0")
    if not turns:
        return [{"order_inversion_rate": "0.0", "chain_intersection_count": "0"}, {"ordering_score": "0.0"}]
    return [
        turns,
        {"order_inversion_rate": f"CAST({most(rates)} AS DOUBLE)", "chain_intersection_count": most([f"({c})" for c in crossings], "0")},
        {"ordering_score": "CASE WHEN chain_intersection_count >= 1 THEN CAST(1.0 AS DOUBLE) ELSE order_inversion_rate END"},
    ]
