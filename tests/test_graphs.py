import random

import pytest

from opsight.functions.graphs import circles
from opsight.scratch import materialize


def plain(edges):
    nodes = {x for e in edges for x in e}
    after = {n: {b for a, b in edges if a == n} for n in nodes}

    def reach(n):
        seen, waiting = set(), [n]
        while waiting:
            for m in after[waiting.pop()] - seen:
                seen.add(m)
                waiting.append(m)
        return seen

    far = {n: reach(n) for n in nodes}
    return {n: min(m for m in far[n] if n in far[m]) for n in nodes if n in far[n]}


@pytest.mark.parametrize("seed", range(4))
def test_equal_to_plain_reachability(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(1, 25), rng.randint(1, 25)) for _ in range(rng.choice([15, 25, 35]))]
    df = spark.createDataFrame(edges + edges[:3] + [(None, 1), (2, None)], "src long, dst long")
    assert {r.node: r.circle for r in circles(df, materialize).collect()} == plain(edges)


def test_names_and_no_edges(spark):
    df = spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "c"), ("d", "a")], "src string, dst string")
    assert {r.node: r.circle for r in circles(df, materialize).collect()} == {"a": "a", "b": "a", "c": "c"}
    assert circles(df.limit(0), materialize).count() == 0
