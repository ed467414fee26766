import random

import pytest

from conceptmill.llm.mixing import Mixture, flight, land, shares


def test_flight_keeps_both_totals():
    rnd = random.Random(1)
    xs = [float(rnd.randrange(1, 500)) for _ in range(800)]
    ps = [0.37] * 800
    got = flight(xs, ps, 5)
    assert sum(0 < p < 1 for p in got) <= 2
    assert sum(got) == pytest.approx(sum(ps)) and sum(x * p for x, p in zip(xs, got)) == pytest.approx(sum(x * 0.37 for x in xs))
    assert got == flight(xs, ps, 5) != flight(xs, ps, 6)
    alike = flight([5.0] * 100, [0.255] * 100, 1)
    assert sum(0 < p < 1 for p in alike) <= 2


def test_landing():
    """Only the open texts are decided, by number first and then by tokens."""
    assert land([5.0, 7.0, 9.0], [0.0, 1.0, 1.0]) == [0.0, 1.0, 1.0]
    assert land([5.0, 100.0, 9.0], [0.5, 1.0, 0.5]) == [1.0, 1.0, 0.0]  # one of the two; 5 is as near as 9
    assert land([10.0, 3.0, 90.0], [0.3, 0.0, 0.7]) == [0.0, 0.0, 1.0]
    assert land([10.0, 90.0], [0.1, 0.1]) == [1.0, 0.0]
    assert land([10.0], [0.4]) == [0.0] and land([10.0], [0.6]) == [1.0] and land([], []) == []


@pytest.mark.parametrize("p", [0.05, 0.13, 0.37])
def test_flight_and_landing_balance_tokens_and_texts(p):
    """Texts of 1 to 4 000 tokens.  All but two texts are the flight's; neither total drifts, and short and long texts keep their chance."""
    short = long = 0
    for seed in range(60):
        rnd = random.Random(seed)
        xs = sorted(float(int(rnd.paretovariate(0.9) * 20) % 4000 + 1) for _ in range(400))
        flown = flight(xs, [p] * len(xs), seed)
        got = land(xs, flown)
        assert set(got) <= {0.0, 1.0} and sum(a != b for a, b in zip(flown, got)) <= 2
        assert abs(sum(got) - p * len(xs)) < 1 and abs(sum(x for x, g in zip(xs, got) if g) - p * sum(xs)) <= max(xs)
        short, long = short + sum(got[:200]), long + sum(got[200:])
    assert short / 12000 == pytest.approx(p, abs=0.02) and long / 12000 == pytest.approx(p, abs=0.02)


def test_shares():
    got = {s.source: s for s in shares({"a": (1000, 10), "b": (100, 5)}, [("a", 0.5, 1), ("b", 0.5, 3), ("none", 0.2, 1), ("bad", None, 1)])}
    assert set(got) == {"a", "b", "none"}
    assert (got["b"].whole, got["a"].whole) == (3, 0) and got["a"].fraction == pytest.approx(0.3) and got["none"].supply_tokens == 0


@pytest.mark.parametrize("block", [50, 100_000])
def test_mixture(spark, block):
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["big"] * 8 + ["mid"] * 3 + ["small", None, "other"]), rnd.choice([None, 0, rnd.randrange(1, 400)])) for i in range(3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc long, source string, n long, p string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("absent", 0.1, 1)], "source string, target_share double, max_repeats int")
    m = Mixture(df, "doc", "n", "source", targets, block_rows=block)
    got = m.selection().collect()
    cap = {"big": 1, "mid": 2, "small": 4}
    by = dict(zip([r[0] for r in rows], rows))
    assert len({r["doc"] for r in got}) == len(got)
    for r in got:
        assert 1 <= r["copies"] <= cap[r["source"]] and by[r["doc"]][1:] == (r["source"], r["n_tokens"])
    reached = {r["source"]: r for r in m.reached().collect()}
    for s in cap:
        assert abs(reached[s]["n_tokens"] - reached[s]["expected_tokens"]) < 400 and abs(reached[s]["n_copies"] - reached[s]["expected_copies"]) < 1
        assert reached[s]["reached_share"] == pytest.approx(reached[s]["target_share"], abs=0.005)
    assert reached["absent"]["n_tokens"] == 0
    assert any(reached[s]["most_copies"] == cap[s] for s in cap)


@pytest.mark.parametrize("block", [50, 100_000])
def test_number_of_texts(spark, block):
    """A source whose tokens lie in a few long texts still gives its expected number of texts."""
    rnd = random.Random(2)
    rows = [(i, "ab"[i % 5 == 0], rnd.choice([3, 5, 8, 13, 400 + i])) for i in range(2000)]
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 2)], "source string, target_share double, max_repeats int")
    m = Mixture(spark.createDataFrame(rows, "doc long, source string, n long"), "doc", "n", "source", targets, block_rows=block)
    reached = m.reached().collect()
    assert len(reached) == 2
    for r in reached:
        assert abs(r["n_copies"] - r["expected_copies"]) < 1 and abs(r["n_tokens"] - r["expected_tokens"]) < 2400


def test_empty(spark):
    df = spark.createDataFrame([], "doc long, source string, n long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    m = Mixture(df, "doc", "n", "source", targets)
    assert m.selection().collect() == [] and m.reached().collect()[0]["reached_share"] == 0.0
