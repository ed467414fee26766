import random

import pytest

from conceptmill.llm.packing import best_fit, mix, pack, schedule

TARGETS = [("a", 0.5), ("b", 0.3), ("c", 0.2), ("absent", 0.1)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc long, source string, n long, queue string, piece int")


def targets(spark):
    return spark.createDataFrame(TARGETS, "source string, target_share double")


def test_schedule_follows_the_shares():
    plan = schedule({"a": 500, "b": 300, "c": 50, "": 70}, dict(TARGETS))
    ends = {}
    for q, lo, hi, t, rate in plan:
        assert ends.get(q, (0, 0))[0] == lo
        ends[q] = (hi, t + (hi - lo) * rate)
    assert {q: hi for q, (hi, _) in ends.items()} == {"a": 500, "b": 300, "c": 50, "": 70}
    assert abs(max(t for _, t in ends.values()) - 920) < 1e-6
    first = {q: rate for q, lo, _, _, rate in plan if lo == 0 and q}
    assert first == pytest.approx({"a": 2.0, "b": 1 / 0.3, "c": 5.0})


def test_best_fit():
    rnd = random.Random(2)
    sizes = [rnd.randrange(0, 101) for _ in range(500)]
    at = best_fit(sizes, 100)
    fill = {}
    for s, (b, place) in zip(sizes, at):
        fill.setdefault(b, []).append((place, s))
    for parts in fill.values():
        end = 0
        for place, s in sorted(parts):
            assert place == end
            end += s
        assert end <= 100
    assert len(fill) <= sum(sizes) / 100 * 1.05 + 1


def test_pack(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("aaaaabbbcc"), rnd.randrange(1, 40)) for i in range(3000)]
    rows += [(3000, "a", 730), (3001, None, 5), (3002, "other", 100), (3003, "b", None), (3004, "b", 0), (3000, "a", 730), (3005, "c", 200)]
    got = pack(table(spark, rows), "doc", "n", "source", targets(spark), capacity=100, window_containers=25).collect()
    size = {}
    for r in got:
        assert 0 <= r["n_tokens"] <= 100
        size[(r["window"], r["slot"])] = size.get((r["window"], r["slot"]), 0) + r["n_tokens"]
    assert max(size.values()) <= 100
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc"], []).append((r["piece"], r["first_token"], r["n_tokens"]))
    want = {}
    for d, _, n in rows:
        want.setdefault(d, []).extend((i // 100, i, min(100, (n or 0) - i)) for i in range(0, max(n or 0, 1), 100))
    assert {d: sorted(p) for d, p in pieces.items()} == {d: sorted(p) for d, p in want.items()}
    assert sum(size.values()) / (100 * len(size)) > 0.95  # each window leaves part of a container


def test_each_window_holds_the_mix(spark):
    """Up to the window in which the first queue ends, each source is within one text of its target at the end of every window."""
    rnd = random.Random(4)
    rows = [(i, rnd.choice("aaaaabbbcc"), rnd.choice([0, rnd.randrange(1, 40), 90, 260])) for i in range(3000)]
    packed = pack(table(spark, rows), "doc", "n", "source", targets(spark), capacity=100, window_containers=25)
    got = mix(packed, "source", targets(spark)).collect()
    assert {r["source"] for r in got} == set("abc") and sum(r["n_tokens"] for r in got) == sum(n for _, _, n in rows)
    assert sum(r["all_last"] for r in got) > 60
    for r in got:
        assert r["target_share"] == pytest.approx(dict(TARGETS)[r["source"]])
        if r["all_last"]:
            assert abs(r["deficit"]) <= 200
    share = {}
    for r in packed.collect():
        share.setdefault(r["window"], {}).setdefault(r["source"], []).append(r["n_tokens"])
    for r in got:
        assert r["n_tokens"] == sum(share[r["window"]].get(r["source"], []))
    last = {s: max(r["window"] for r in got if r["source"] == s and r["n_tokens"]) for s in "abc"}
    assert all(r["all_last"] == (r["window"] < min(last.values())) for r in got)


def test_one_source_holds_all(spark):
    got = pack(table(spark, [(i, "a", 7) for i in range(500)]), "doc", "n", "source", targets(spark), capacity=70, window_containers=3).collect()
    assert len(got) == 500 and len({(r["window"], r["slot"]) for r in got}) <= 53


def test_empty(spark):
    none = pack(table(spark, []), "doc", "n", "source", targets(spark))
    assert none.collect() == [] and mix(none, "source", targets(spark)).collect() == []
    assert pack(table(spark, [(1, "", 3)]), "doc", "n", "source", spark.createDataFrame([], "source string, target_share double")).count() == 1
