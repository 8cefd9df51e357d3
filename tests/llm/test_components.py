"""Components against a plain search, with chains, hubs, repeated edges and self loops."""

import random

import numpy as np
import pytest

from tramline.llm import components as co


def brute(edges):
    near = {}
    for u, v in edges:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    root = {}
    for n in sorted(near):
        todo = [n] if n not in root else []
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = n
                todo += near[x]
    return root


def tangle():
    r = random.Random(5)
    chain = [(i, i + 1) for i in range(-40, 40)]
    hub = [(1000, 1001 + i) for i in range(100)]
    loose = [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(200)]
    edges = chain + hub + hub + loose + [(7, 7), (5000, 5000), (-(1 << 63), (1 << 63) - 1)]
    r.shuffle(edges)
    return edges


def test_stars_of_a_task():
    edges = tangle()
    child, root = co.stars(*np.array(edges, np.int64).T)
    assert dict(zip(child.tolist(), root.tolist(), strict=True)) == {n: r for n, r in brute(edges).items() if n != r}


@pytest.mark.parametrize("at_once, parts", [(1, 5), (1_000_000, 3)])
def test_components(spark, monkeypatch, at_once, parts):
    monkeypatch.setattr(co, "AT_ONCE", at_once)
    monkeypatch.setitem(co.__dict__, "_local", co._local if at_once > 1 else lambda e: e)
    edges = tangle()
    got = co.components(spark.createDataFrame(edges, "u long, v long").repartition(parts)).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.root for r in got} == brute(edges)


def test_no_edges(spark):
    assert co.components(spark.createDataFrame([], "u long, v long")).collect() == []
