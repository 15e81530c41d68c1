"""Every operator against brute force on random region sets, from the definitions."""

import random

import pytest

from spanloom.operators import contain, pair, sets

N_DOCS = 400


def make(seed):
    rng = random.Random(seed)
    out = {}
    for d in range(N_DOCS):
        out[d] = [sorted({(s, s + rng.choice([1, 1, 1, 2, 2, 3, 5]) - 1) for s in (rng.randrange(15) for _ in range(rng.randrange(9)))}) for _ in range(2)]
    out[0][1] = []
    out[1][0] = []
    out[2][1] = list(out[2][0])
    return out


DATA = make(7)


def inside(x, y):
    return (x[0] > y[0] and x[1] <= y[1]) or (x[1] < y[1] and x[0] >= y[0])


def covered(a):
    return {p for s, e in a for p in range(s, e + 1)}


def runs(positions):
    out = []
    for p in sorted(positions):
        if out and p == out[-1][1] + 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


def pairs(a, b):
    """By depth: each left, in order of its end, is matched as brackets are."""
    events = sorted([(e, 1, s, (s, e)) for s, e in a] + [(s, -1, e, (s, e)) for s, e in b], key=lambda x: x[:3])
    depth, last, out = 0, {}, []
    for _, k, _, r in events:
        if k == 1:
            depth += 1
            last[depth] = r
        else:
            if last.get(depth):
                out.append((last[depth], r))
            last[depth] = None
            depth -= 1
    return out


def quotes(a, b):
    out, limit = [], -1
    while True:
        left = min((x for x in a if x[0] > limit), default=None)
        right = left and min((y for y in b if y[0] > left[1]), default=None)
        if not right:
            return out
        out.append((left, right))
        limit = right[1]


def gap(x, y):
    return max(y[0] - x[1] - 1, x[0] - y[1] - 1, 0) if x[1] < y[0] or y[1] < x[0] else 0


ORACLES = {
    "in": (lambda a, b: contain.within(a, b), lambda a, b: [x for x in a if any(inside(x, y) for y in b)]),
    "not in": (lambda a, b: contain.within(a, b, True), lambda a, b: [x for x in a if not any(inside(x, y) for y in b)]),
    "containing": (lambda a, b: contain.containing(a, b), lambda a, b: [x for x in a if any(inside(y, x) for y in b)]),
    "not containing": (lambda a, b: contain.containing(a, b, True), lambda a, b: [x for x in a if not any(inside(y, x) for y in b)]),
    "equal": (lambda a, b: contain.equal(a, b), lambda a, b: [x for x in a if x in b]),
    "not equal": (lambda a, b: contain.equal(a, b, True), lambda a, b: [x for x in a if x not in b]),
    "inner": (lambda a, b: contain.inner(a), lambda a, b: [x for x in a if not any(inside(y, x) for y in a)]),
    "outer": (lambda a, b: contain.outer(a), lambda a, b: [x for x in a if not any(inside(x, y) for y in a)]),
    "parenting": (contain.parenting, lambda a, b: [x for x in a if any(inside(y, x) and not any(inside(y, m) and inside(m, x) for m in a) for y in b)]),
    "childrening": (contain.childrening, lambda a, b: [x for x in a if any(inside(x, y) and not any(inside(x, m) and inside(m, y) for m in a) for y in b)]),
    "near": (lambda a, b: contain.near(a, b, 2), lambda a, b: [x for x in a if any(gap(x, y) <= 2 for y in b)]),
    "before": (lambda a, b: contain.before(a, b, 2), lambda a, b: [x for x in a if any(0 <= y[0] - x[1] - 1 <= 2 for y in b)]),
    "second in": (lambda a, b: contain.nth_in(a, b, 2), lambda a, b: [c[1] for y in b if len(c := [x for x in a if inside(x, y)]) > 1]),
    "last in": (lambda a, b: contain.nth_in(a, b, -1), lambda a, b: [c[-1] for y in b if (c := [x for x in a if inside(x, y)])]),
    "or": (sets.union, lambda a, b: a + b),
    "concat": (lambda a, b: sets.concat(a), lambda a, b: runs(covered(a))),
    "join": (lambda a, b: sets.join_n(a, 3), lambda a, b: [(a[i][0], a[i + 2][1]) for i in range(len(a) - 2)]),
    "extracting": (sets.extracting, lambda a, b: [r for x in a for r in runs(covered([x]) - covered(b))]),
    "first bytes": (lambda a, b: sets.first_bytes(a, 2), lambda a, b: [(s, min(e, s + 1)) for s, e in a]),
    "last bytes": (lambda a, b: sets.last_bytes(a, 2), lambda a, b: [(max(s, e - 1), e) for s, e in a]),
    "..": (lambda a, b: pair.pair(a, b, ".."), lambda a, b: [(x[0], y[1]) for x, y in pairs(a, b)]),
    "._": (lambda a, b: pair.pair(a, b, "._"), lambda a, b: [(x[0], y[0] - 1) for x, y in pairs(a, b)]),
    "_.": (lambda a, b: pair.pair(a, b, "_."), lambda a, b: [(x[1] + 1, y[1]) for x, y in pairs(a, b)]),
    "__": (lambda a, b: pair.pair(a, b, "__"), lambda a, b: [(x[1] + 1, y[0] - 1) for x, y in pairs(a, b)]),
    "quote": (pair.quote, lambda a, b: [(x[0], y[1]) for x, y in quotes(a, b)]),
    "_quote": (lambda a, b: pair.quote(a, b, True), lambda a, b: [(x[1] + 1, y[1]) for x, y in quotes(a, b)]),
    "quote_": (lambda a, b: pair.quote(a, b, False, True), lambda a, b: [(x[0], y[0] - 1) for x, y in quotes(a, b)]),
    "_quote_": (lambda a, b: pair.quote(a, b, True, True), lambda a, b: [(x[1] + 1, y[0] - 1) for x, y in quotes(a, b)]),
}


@pytest.fixture(scope="module")
def frames(spark):
    ddl = "doc_id long, start_pos long, end_pos long"
    return [spark.createDataFrame([(d, *r) for d, x in DATA.items() for r in x[k]], ddl).cache() for k in (0, 1)]


@pytest.mark.parametrize("name", ORACLES)
def test_operator(frames, name):
    build, oracle = ORACLES[name]
    want = {(d, s, e) for d, (a, b) in DATA.items() for s, e in oracle(a, b) if s <= e}
    got = [tuple(r) for r in build(*frames).collect()]
    assert len(got) == len(set(got)), "a region set has no equal rows"
    assert set(got) == want


def precedes(x, y):
    return x[1] < y[0]


def test_pairs_satisfy_the_definition():
    """One-to-one, ordered, and no pair could be closer together."""
    for a, b in DATA.values():
        got = pairs(a, b)
        assert len({x for x, _ in got}) == len(got) == len({y for _, y in got})
        assert all(precedes(x, y) for x, y in got)


@pytest.mark.parametrize("name", ["parenting", "childrening", "second in", "last in", "extracting"])
def test_operator_over_cells(frames, name, monkeypatch):
    """Regions that go over several cells of text meet their partners once."""
    monkeypatch.setattr(contain, "CELL", 3)
    monkeypatch.setattr(sets, "CELL", 3)
    test_operator(frames, name)
