from itertools import permutations, product

from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.operators import matching as g


def prefs(text):
    """'3[01]2' is 3, then 0 and 1 tied, then 2."""
    out = []
    for word in text.split(" / "):
        groups, tie = [], None
        for c in word:
            if c == "[":
                tie = []
            elif c == "]":
                groups.append(tie)
                tie = None
            elif tie is not None:
                tie.append(int(c))
            else:
                groups.append([int(c)])
        out.append(groups)
    return out


def pairs(text):
    return [(int(x[0]), int(x[1])) for x in text.split()]


CASES = [
    ("ws", "1023 / 3012 / 0213 / 1203", "0213 / 2301 / 3120 / 2103", "00 13 22 31"),
    ("ws", "3012 / 1203 / 1320 / 2031", "3021 / 0213 / 0123 / 3021", "03 12 21 30"),
    ("ws", "302 / 103 / 132 / 031", "301 / 213 / 02 / 0321", "03 21 30"),
    ("w", "3012 / 3120 / 1320 / 2031", "3021 / 0[21]3 / 0123 / 3021", "03 12 21 30"),
    ("s", "3012 / 1203 / 1320 / 2031", "3021 / 0[21]3 / 0123 / 3021", "03 12 30"),
]


def test_vectors():
    for kinds, left, right, want in CASES:
        if "w" in kinds:
            assert g.weakly_stable(prefs(left), prefs(right)) == pairs(want)
        if "s" in kinds:
            assert g.strongly_stable(prefs(left), prefs(right)) == pairs(want)


def test_critical_sets():
    assert g.critical_set({0: {11}, 1: {13}, 2: {10}, 3: {11}}) == {0, 3}
    medium = {0: {10, 11, 13}, 1: {11, 12}, 2: {11, 12}, 3: {11, 12}}
    assert g.critical_set(medium) == {1, 2, 3}
    assert g.critical_set(medium | {4: {13, 14}}) == {1, 2, 3}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=3, max_size=3), min_size=6, max_size=6))
def test_stability_by_brute_force(grid):
    scores = {(a, b): float(grid[a][b]) for a in range(3) for b in range(3)}
    back = {(b, a): float(grid[3 + b][a]) for a in range(3) for b in range(3)}
    left, right = g.ranking(scores, 3, 3), g.ranking(back, 3, 3)
    got = dict(g.weakly_stable(left, right))
    partner = {b: a for a, b in got.items()}
    for a, b in product(range(3), range(3)):
        assert not (scores[a, b] > scores[a, got[a]] and back[b, a] > back[b, partner[b]])

    def strong(m):
        of = {b: a for a, b in enumerate(m)}
        return not any(m[a] != b and ((scores[a, b] > scores[a, m[a]] and back[b, a] >= back[b, of[b]]) or (scores[a, b] >= scores[a, m[a]] and back[b, a] > back[b, of[b]])) for a, b in product(range(3), range(3)))

    stable = [m for m in permutations(range(3)) if strong(m)]
    found = dict(g.strongly_stable(left, right))
    if stable:
        assert tuple(found[a] for a in range(3)) in stable


def test_edges():
    e = [g.Edge("a", "x", 1.0), g.Edge("a", "y", 0.5), g.Edge("b", "x", 0.9)]
    assert {(m.first, m.second) for m in g.assign(e)} == {("a", "x")}
    assert g.match([], []) == []
