import math

import numpy as np

from graphloom.llm.nra_topk import Block, top_k


def test_reading_stops_early_and_is_exact():
    r = np.random.default_rng(1)
    values = np.rint(r.normal(size=(2000, 3)) * 1000).astype(np.int64)
    ids = r.permutation(2000).astype(np.int64)
    block = Block(ids, values)
    depths = []
    queries = np.rint(r.normal(size=(30, 3)) * 1000).astype(np.int64)
    for t, (got_ids, got, depth) in enumerate(block.tops(ids[:30], queries, 10)):
        depths.append(depth)
        want = sorted((-int(v @ queries[t]), int(i)) for i, v in zip(ids, values) if i != ids[t])[:10]
        assert [(-int(s), int(i)) for s, i in zip(got, got_ids)] == want
    assert np.median(depths) < 1000


def test_against_brute_force(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=8).round(2).tolist()) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(40)]  # ties
    rows += [(400, None), (500, [None] * 8), (600, [math.nan] * 8), (700, [math.inf] + [0.0] * 7), (None, rows[1][1]), (800, [1.0]), (801, [2.0]),
             (7, rows[7][1]), (200, rows[200][1]), (900, [0.0] * 8)]
    df = spark.createDataFrame([(*x, 3, "z") for x in rows], "vec_id long, embedding array<float>, rank int, query string")
    f32 = [(i, np.floor(1024 * np.array(v, np.float32).astype(np.float64)).astype(int)) for i, v in rows
           if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = set()
    for i, q in f32:
        if i % 100 == 0:
            near = sorted((-int(q @ v), j) for j, v in f32 if j != i and len(v) == len(q))[:10]
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(near)}
    got = top_k(df, block_rows=40, query_rows=2).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert top_k(df.limit(0)).count() == 0


def test_huge_components_are_exact(spark):
    """Products beyond 2**53 are whole numbers of any size; scores beyond 63 bits count as the end of the range."""
    rows = [(0, [3.0, -7.5e15]), (100, [1e300, 1.0]), (1, [2.0**40, 1.0]), (2, [2.0**40 + 1, 1.0]), (3, [-1e308, 0.0]), (4, [0.5, 2.0**41]),
            (200, [2.0**20, 3.0]), (5, [2.0**20 + 1, -1.0])]
    df = spark.createDataFrame([(*x, "c") for x in rows], "vec_id long, embedding array<double>, score string")
    most = int(np.finfo(np.float64).max)
    ints = {i: [max(-most, min(most, math.floor(1024 * x))) if math.isfinite(1024 * x) else (most if x > 0 else -most) for x in v] for i, v in rows}
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    got = {}
    for x in top_k(df, every=100, k=10, scale=1024).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    for q in (0, 100, 200):
        want = sorted((-clip(ints[q][0] * ints[i][0] + ints[q][1] * ints[i][1]), i) for i in ints if i != q)
        assert [(-s, i) for _, i, s in sorted(got[q])] == want
    assert top_k(df.limit(0)).count() == 0
