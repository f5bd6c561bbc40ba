"""Skeleton graph analysis on the driver: a few dozen nodes, used when plans are built."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations


@dataclass(frozen=True)
class Skeleton:
    """Named nodes, undirected edges and left/right pairs, by node index."""

    names: tuple[str, ...]
    edges: tuple[tuple[int, int], ...]
    pairs: tuple[tuple[int, int], ...] = ()

    @property
    def n_nodes(self) -> int:
        return len(self.names)

    @cached_property
    def neighbours(self) -> tuple[tuple[int, ...], ...]:
        """Distinct neighbours of each node in the order edges name them."""
        out: list[dict[int, None]] = [{} for _ in self.names]
        for a, b in self.edges:
            out[a].setdefault(b)
            out[b].setdefault(a)
        return tuple(tuple(x) for x in out)

    @cached_property
    def degree(self) -> tuple[int, ...]:
        return tuple(map(len, self.neighbours))

    @property
    def endpoints(self) -> list[int]:
        return [i for i, d in enumerate(self.degree) if d == 1]

    @property
    def branch_points(self) -> list[int]:
        return [i for i, d in enumerate(self.degree) if d > 2]

    def walk_from(self, start: int) -> dict[int, int | None]:
        """Breadth-first predecessor of each reachable node, in visiting order."""
        came: dict[int, int | None] = {start: None}
        queue = deque([start])
        while queue:
            here = queue.popleft()
            for there in self.neighbours[here]:
                if there not in came:
                    came[there] = here
                    queue.append(there)
        return came

    def path(self, start: int, end: int) -> list[int]:
        came = self.walk_from(start)
        if end not in came:
            return []
        out: list[int] = []
        node: int | None = end
        while node is not None:
            out.append(node)
            node = came[node]
        return out[::-1]

    @cached_property
    def spine(self) -> list[int]:
        """The longest of the paths from each endpoint to its farthest node;
        the first found wins a tie."""
        best: list[int] = []
        for start in self.endpoints or ([0] if self.names else []):
            lengths: dict[int, int] = {}
            for node, before in self.walk_from(start).items():
                lengths[node] = 0 if before is None else lengths[before] + 1
            far = max(lengths, key=lengths.__getitem__)
            path = self.path(start, far)
            if len(path) > len(best):
                best = path
        return best

    def chains(self, shortest: int = 3) -> list[list[int]]:
        """Maximal runs between endpoints and branch points, each edge once."""
        stops = list(dict.fromkeys([*self.endpoints, *self.branch_points]))
        used: set[frozenset[int]] = set()
        out = []
        for start in stops:
            for step in self.neighbours[start]:
                if frozenset((start, step)) in used:
                    continue
                run = [start, step]
                used.add(frozenset(run))
                while run[-1] not in stops:
                    onward = [n for n in self.neighbours[run[-1]] if n != run[-2]]
                    if not onward:
                        break
                    used.add(frozenset((run[-1], onward[0])))
                    run.append(onward[0])
                if len(run) >= shortest:
                    out.append(run)
        return out

    def curvature_chains(self, shortest: int = 3) -> list[list[int]]:
        """The spine, then chains that leave it, longest first."""
        found = [self.spine] if len(self.spine) >= shortest else []
        found += [c for c in self.chains(shortest) if not set(c) <= set(self.spine)]
        return sorted(found, key=len, reverse=True)

    def angle_triplets(self) -> list[tuple[int, int, int]]:
        """(centre, lower, higher) for each two edges that meet."""
        return [(c, min(a, b), max(a, b)) for c, near in enumerate(self.neighbours) for a, b in combinations(near, 2)]

    def node_pairs(self) -> list[tuple[int, int]]:
        return list(combinations(range(self.n_nodes), 2))

    def side_pairs(self) -> list[tuple[int, int]]:
        return list(self.pairs) or pairs_by_name(self.names)

    def midline(self) -> list[int]:
        sided = {n for p in self.side_pairs() for n in p}
        return [i for i in range(self.n_nodes) if i not in sided]

    def ordered_chains(self, by_name: Sequence[Sequence[str]] | None = None) -> list[list[int]]:
        """Chains to judge the order of: those named, if any has three known
        nodes, else the curvature chains; cut where a node's degree is not two."""
        index = {n: i for i, n in enumerate(self.names)}
        named = [[index[n] for n in chain if n in index] for chain in by_name or ()]
        named = [c for c in named if len(c) >= 3]
        return linear_runs(named or self.curvature_chains(), self.degree)


def linear_runs(chains: Iterable[Sequence[int]], degree: Sequence[int]) -> list[list[int]]:
    """Pieces of at least three nodes between inner nodes of degree other than two."""
    out = []
    for chain in chains:
        cuts = [0, *[i for i in range(1, len(chain) - 1) if degree[chain[i]] != 2], len(chain) - 1]
        out += [list(chain[a : b + 1]) for a, b in zip(cuts, cuts[1:]) if b - a >= 2]
    return out


#: fixed values: side words, longer first, and what may stand beside them
SIDES = (("left", "right"), ("l", "r"))
SEPARATOR = r"[ _\-.]?"


def _side_of(name: str) -> tuple[str, int] | None:
    """(stem key, 0 left or 1 right) of a node name; word before letter, and
    at the end before at the start."""
    for words in SIDES:
        for side, word in enumerate(words):
            for place, pattern in (("end", rf"(.+?){SEPARATOR}{word}"), ("start", rf"{word}{SEPARATOR}(.+)")):
                if hit := re.fullmatch(pattern, name, re.IGNORECASE):
                    return f"{place}:{hit[1].lower()}", side
    return None


def pairs_by_name(names: Sequence[str]) -> list[tuple[int, int]]:
    """(left, right) indices of names that differ in the side only; the first
    of a side and stem wins, no node is in two pairs."""
    stems: dict[str, dict[int, int]] = {}
    for i, name in enumerate(names):
        if found := _side_of(name):
            stems.setdefault(found[0], {}).setdefault(found[1], i)
    used: set[int] = set()
    out = []
    for sides in stems.values():
        if len(sides) == 2 and not used & {sides[0], sides[1]}:
            out.append((sides[0], sides[1]))
            used |= {sides[0], sides[1]}
    return sorted(out)


def parts_without_edge(nodes: Sequence[int], edges: Iterable[tuple[int, int]], cut: tuple[int, int]) -> list[list[int]]:
    """Connected parts of ``nodes`` once the edge ``cut`` is gone."""
    near: dict[int, list[int]] = {n: [] for n in nodes}
    for a, b in edges:
        if (a, b) != cut:
            near[a].append(b)
            near[b].append(a)
    parts, seen = [], set()
    for n in nodes:
        if n in seen:
            continue
        part, queue = [], [n]
        seen.add(n)
        while queue:
            here = queue.pop()
            part.append(here)
            for m in near[here]:
                if m not in seen:
                    seen.add(m)
                    queue.append(m)
        parts.append(sorted(part))
    return parts
