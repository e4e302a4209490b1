import random

import pytest
from glyspark.llm._io import Workspace
from glyspark.llm.components import components


def brute(edges):
    comp = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    for _ in comp:
        for a, b in edges:
            if a in comp and b in comp and None not in (a, b):
                comp[a] = comp[b] = min(comp[a], comp[b])
    return comp


@pytest.mark.parametrize("kind", ["path", "star", "random", "empty", "loops"])
def test_components(spark, kind):
    random.seed(3)
    edges = {"path": [(k, k + 1) for k in range(40)], "star": [(7, k) for k in range(50)], "random": [(random.randrange(60), random.randrange(60)) for _ in range(40)], "empty": [], "loops": [(1, 1), (2, 3), (3, 2), (2, 3), (None, 4)]}[kind]
    got = components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "t")).collect()
    assert {r.node: r.component for r in got} == brute(edges) and len(got) == len({r.node for r in got})
