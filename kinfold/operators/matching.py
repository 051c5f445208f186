"""Matching of the two sides of a small bipartite graph: weakly and strongly stable marriages with ties.

Sides are lists; preferences come from scores, higher is better, equal scores tie, a missing score means
unacceptable. The functions are plain Python and run inside Arrow-batched functions, one call per pair of lists.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Hashable, Iterable
from typing import NamedTuple


class Edge(NamedTuple):
    first: Hashable
    second: Hashable
    weight: float

    def reversed(self) -> Edge:
        return Edge(self.second, self.first, self.weight)


Ranks = list[list[list[int]]]


def ranking(scores: dict[tuple[int, int], float], n_from: int, n_to: int) -> Ranks:
    """For each source the groups of targets of equal score, best first."""
    out: Ranks = []
    for a in range(n_from):
        by: dict[float, list[int]] = {}
        for b in range(n_to):
            if (a, b) in scores:
                by.setdefault(scores[a, b], []).append(b)
        out.append([by[s] for s in sorted(by, reverse=True)])
    return out


def _positions(prefs: Ranks) -> list[dict[int, int]]:
    return [{b: level for level, tie in enumerate(groups) for b in tie} for groups in prefs]


def weakly_stable(left: Ranks, right: Ranks) -> list[tuple[int, int]]:
    """Proposals by the left; a right side changes only to a strictly better partner, so no pair strictly prefers each other."""
    rank = _positions(right)
    wishes = [deque(b for tie in groups for b in tie) for groups in left]
    held: dict[int, int] = {}
    free = deque(range(len(left)))
    while free:  # one proposal each in turn, so that among tied suitors the first choice of one comes before the second of another
        a = free.popleft()
        if not wishes[a]:
            continue
        b = wishes[a].popleft()
        if a not in rank[b]:
            free.append(a)
        elif b not in held:
            held[b] = a
        elif rank[b][a] < rank[b][held[b]]:
            free.append(held[b])
            held[b] = a
        else:
            free.append(a)
    return sorted((a, b) for b, a in held.items())


def maximum_matching(edges: dict[int, set[int]]) -> dict[int, int]:
    """Left to right, by augmenting paths."""
    partner: dict[int, int] = {}
    for root in edges:
        seen: set[int] = set()
        came: dict[int, int] = {}
        queue = deque([root])
        end = None
        while queue and end is None:
            a = queue.popleft()
            for b in sorted(edges[a]):
                if b in seen:
                    continue
                seen.add(b)
                came[b] = a
                if b not in partner:
                    end = b
                    break
                queue.append(partner[b])
        while end is not None:
            a = came[end]
            before = next((b for b, x in partner.items() if x == a), None)
            partner[end] = a
            end = before if a != root else None
    return {a: b for b, a in partner.items()}


def critical_set(engaged: dict[int, set[int]]) -> set[int]:
    """Men of the critical set: while some are unmatched in a maximum matching, take them out with all women next to them."""
    rest = {a: set(bs) for a, bs in engaged.items()}
    critical: set[int] = set()
    while True:
        lonely = set(rest) - set(maximum_matching(rest))
        if not lonely:
            return critical
        gone = set().union(*(rest[a] for a in lonely))
        critical |= lonely
        for a in lonely:
            del rest[a]
        for bs in rest.values():
            bs -= gone


def strongly_stable(left: Ranks, right: Ranks) -> list[tuple[int, int]]:
    """Irving's algorithm for strong stability; without a strongly stable matching, the engagements it ends with."""
    wants = [[set(tie) for tie in groups] for groups in left]
    likes = [[set(tie) for tie in groups] for groups in right]
    engaged: dict[int, set[int]] = {a: set() for a in range(len(left))}

    def remove(a: int, b: int) -> None:
        engaged[a].discard(b)
        for lists, x, y in ((wants, a, b), (likes, b, a)):
            for tie in lists[x]:
                tie.discard(y)
            lists[x][:] = [tie for tie in lists[x] if tie]

    while True:
        free = [a for a in engaged if not engaged[a] and wants[a]]
        while free:
            a = free.pop(0)
            if engaged[a] or not wants[a]:
                continue
            for b in sorted(wants[a][0]):
                level = next((i for i, tie in enumerate(likes[b]) if a in tie), None)
                if level is None:
                    remove(a, b)
                    continue
                engaged[a].add(b)
                for worse in [m for tie in likes[b][level + 1 :] for m in tie]:
                    remove(worse, b)
                    if not engaged[worse]:
                        free.append(worse)
            if not engaged[a] and wants[a]:
                free.append(a)
        critical = critical_set({a: bs for a, bs in engaged.items() if bs})
        if not critical:
            break
        for b in set().union(*(engaged[a] for a in critical)):
            for a in list(likes[b][-1]) if likes[b] else []:
                remove(a, b)
    final = maximum_matching({a: bs for a, bs in engaged.items() if bs})
    return sorted(final.items())


Matcher = Callable[[Ranks, Ranks], list[tuple[int, int]]]
MATCHERS: dict[str, Matcher] = {"weak": weakly_stable, "strong": strongly_stable}


def match(forth: Iterable[Edge], back: Iterable[Edge], matcher: Matcher = weakly_stable) -> list[Edge]:
    """Matched edges with the weights of ``forth``; equal elements are one."""
    forth, back = list(forth), list(back)
    lefts = list(dict.fromkeys([e.first for e in forth] + [e.second for e in back]))
    rights = list(dict.fromkeys([e.second for e in forth] + [e.first for e in back]))
    li, ri = {x: i for i, x in enumerate(lefts)}, {x: i for i, x in enumerate(rights)}
    one = {(li[e.first], ri[e.second]): e.weight for e in forth}
    two = {(ri[e.first], li[e.second]): e.weight for e in back}
    pairs = matcher(ranking(one, len(lefts), len(rights)), ranking(two, len(rights), len(lefts)))
    return [Edge(lefts[a], rights[b], one[a, b]) for a, b in pairs if (a, b) in one]


def assign(edges: Iterable[Edge], matcher: Matcher = weakly_stable) -> list[Edge]:
    """Undirected: both sides see the same scores."""
    edges = list(edges)
    return match(edges, [e.reversed() for e in edges], matcher)
