import random

import pytest

from conceptmill.llm.components import groups


def brute(links):
    near = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = set()
    for n in near:
        seen, stack = {n}, [n]
        while stack:
            for x in near[stack.pop()] - seen:
                seen.add(x)
                stack.append(x)
        out.add((n, min(seen)))
    return out


rnd = random.Random(3)
CASES = {
    "chain": [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)],
    "star": [("hub", f"x{i}") for i in range(40)] + [(f"x{i}", "hub") for i in range(5)],
    "random": [(f"n{rnd.randrange(60):02}", f"n{rnd.randrange(60):02}") for _ in range(45)],
    "dirty": [("a", "a"), (None, "b"), ("b", None), ("c", "d"), ("c", "d"), ("d", "c"), ("", "e")],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("hot", [3, 1_000_000])
def test_groups(spark, name, hot):
    df = spark.createDataFrame([(*x, "extra", 1) for x in CASES[name]], "a string, b string, u string, m int")
    got = [tuple(r) for r in groups(df, "a", "b", hot_links=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(CASES[name])
