import random

import pytest

from conceptmill.operators.hierarchy import Hierarchy

SCHEMA = "g string, child string, parent string, id string, c string"


def brute(links):
    """Reachability, loops and paths by search from every node."""
    up = {}
    nodes = set()
    for g, c, p in links:
        up.setdefault((g, c), set()).add((g, p))
        nodes |= {(g, c), (g, p)}
    reach = {}
    for n in nodes:
        seen, stack = set(), list(up.get(n, ()))
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += up.get(x, ())
        reach[n] = seen
    low = {n: min([x for x in reach[n] if n in reach[x]], default=n) for n in nodes}
    loops = {(n[0], low[n][1], n[1]) for n in nodes if n in reach[n]}
    below = set()
    for n in nodes:
        for a in reach[n]:
            below.add((a[0], low[a][1], n[1], n in reach[n]))
    above = {}
    for n in nodes:
        for a in up.get(n, ()):
            if low[n] != low[a]:
                above.setdefault(low[n], set()).add(low[a])
    paths = []

    def climb(start, path):
        more = above.get(path[-1], ())
        if not more:
            names = [x[1] for x in reversed(path)]
            paths.append((start[0], start[1], " > ".join(names), len(names) - 1, names[0], path[-1] in reach[path[-1]]))
        for a in more:
            climb(start, [*path, a])

    for n in {low[n] for n in nodes}:
        climb(n, [n])
    return loops, below, sorted(paths)


def run(spark, links, rounds):
    rows = [(*x, "other", "clash") for x in links]
    h = Hierarchy(spark.createDataFrame(rows, SCHEMA), most_rounds=rounds)
    return (
        {tuple(r) for r in h.loops().collect()},
        {tuple(r) for r in h.descendants().collect()},
        sorted(tuple(r) for r in h.paths().collect()),
        h,
    )


CASES = {
    "tree": [("g", f"n{i}", f"n{i // 2}") for i in range(1, 30) if i // 2 != i and i // 2],
    "chain": [("g", f"n{i:03}", f"n{i + 1:03}") for i in range(9)],
    "lattice": [("g", f"{a}{i}", f"{b}{i + 1}") for i in range(4) for a in "xy" for b in "xy"],
    "loops": [("g", "a", "b"), ("g", "b", "c"), ("g", "c", "a"), ("g", "d", "d"), ("g", "x", "a"), ("g", "c", "top"), ("g", "top", "up"), ("h", "a", "b"), ("g", "e", "d"), ("g", "d", "f"), ("g", "e", "y")],
    "two loops linked": [("g", "a", "b"), ("g", "b", "a"), ("g", "b", "m"), ("g", "m", "c"), ("g", "c", "d"), ("g", "d", "c"), ("g", "k", "a"), ("g", "d", "z")],
    "nulls and repeats": [("g", "a", "b"), ("g", "a", "b"), (None, "a", "b"), ("g", None, "b"), ("g", "a", None)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("rounds", [1, 64])
def test_cases(spark, name, rounds):
    links = CASES[name]
    loops, below, paths, _ = run(spark, links, rounds)
    want = brute({x for x in links if None not in x})
    assert loops == want[0]
    assert below == want[1]
    assert paths == want[2]


@pytest.mark.parametrize("rounds", [1, 64])
def test_random(spark, rounds):
    rnd = random.Random(5)
    links = [("g", f"n{rnd.randrange(40):02}", f"n{rnd.randrange(40):02}") for _ in range(34)]
    links += [("h", f"n{i:02}", f"n{rnd.randrange(i + 1, 42):02}") for i in range(40) for _ in range(rnd.randrange(1, 3)) if i < 8 or _ == 0]
    loops, below, paths, h = run(spark, links, rounds)
    want = brute(set(links))
    assert (loops, below, paths) == want
    size = {(r["g"], r["concept"]): r["n_below"] for r in h.concepts().collect()}
    assert len(size) == len({(p[0], p[1]) for p in want[2]})


@pytest.mark.parametrize("rounds", [1, 64])
def test_members_of_loops(spark, rounds):
    """Each member of a loop has the paths, depths, roots and descendants of its loop."""
    links = CASES["loops"] + [("k", *x[1:]) for x in CASES["two loops linked"]]
    h = Hierarchy(spark.createDataFrame([(*x, "other", "clash") for x in links], SCHEMA), most_rounds=rounds)
    loops, _, paths = brute(links)
    members = {}
    for g, low, concept in loops:
        members.setdefault((g, low), []).append(concept)
    want = sorted((g, m, *rest, (g, c) in members) for g, c, *rest in paths for m in members.get((g, c), [c]))
    assert sorted(tuple(r) for r in h.member_paths().collect()) == want
    below = {(g, p, c) for g, c, p in links}
    while more := {(g, a, d) for g, a, b in below for h_, c, d in below if (g, b) == (h_, c)} - below:
        below |= more
    on = {(g, m) for g, _, m in loops}
    assert sorted(tuple(r) for r in h.member_descendants().collect()) == sorted((g, a, d, (g, a) in on, (g, d) in on) for g, a, d in below)
    concepts = h.member_concepts().collect()
    ends = {(g, x) for g, *two in links for x in two}
    assert sorted((r["g"], r["concept"]) for r in concepts) == sorted(ends)
    for r in concepts:
        own = [w for w in want if w[:2] == (r["g"], r["concept"])]
        assert (r["min_depth"], r["max_depth"], r["n_paths"], r["on_loop"]) == (min(w[3] for w in own), max(w[3] for w in own), len(own), (r["g"], r["concept"]) in on)


def test_number_below_counts_members(spark):
    """x is above a loop of three and a leaf; the loop's members are below each of them."""
    links = [("g", "a", "b"), ("g", "b", "c"), ("g", "c", "a"), ("g", "c", "x"), ("g", "leaf", "b"), ("g", "self", "self"), ("g", "x", "top")]
    for rounds in (1, 64):
        h = Hierarchy(spark.createDataFrame([(*x, "other", "clash") for x in links], SCHEMA), most_rounds=rounds)
        got = {r["concept"]: r["n_below"] for r in h.member_concepts().collect()}
        assert got == {"top": 5, "x": 4, "a": 4, "b": 4, "c": 4, "leaf": 0, "self": 1}
