import random

from graphloom.llm._shared import components


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    edges += [(2000, 2001 + i) for i in range(50)] + [(2001 + i, 5) for i in range(3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    for most in (1_000_000, 10):  # in one task, in rounds
        got = components(spark.createDataFrame(edges, "a long, b long"), "test", most).collect()
        assert {r.id: r.component_id for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0
