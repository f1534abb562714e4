import math

import numpy as np
import pytest

from graphloom.llm.nn_descent import audit, near_dedup, tree_count


def corpus(seed, n=300, dim=24, hot=90):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dim))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(40):
        rows.append((1000 + i, (base[i % 20] + r.normal(size=dim) * 0.12).tolist()))
    for i in range(hot):
        rows.append((2000 + i, (base[25] + r.normal(size=dim) * 0.1).tolist()))
    for i in range(40):
        rows.append((3000 + i, (base[30] * (i % 2 + 1)).tolist()))
    nan = [math.nan] * dim
    rows += [(4000, None), (4001, []), (4002, [0.0] * dim), (4003, nan), (4004, [None] + [1.0] * (dim - 1)), (4005, [math.inf] + [0.0] * (dim - 1)),
             (None, base[0].tolist()), (4006, [1.0, 2.0]), (4007, [2.0, 4.0]), (7, base[7].tolist())]
    return rows


def brute(rows, threshold):
    ok = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows
          if i is not None and v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    comp = {i: i for i, _ in rows}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    n = [0] * len(ok)
    for a, (i, x) in enumerate(ok):
        for b, (j, y) in enumerate(ok[:a]):
            if len(x) == len(y) and x @ y >= threshold:
                n[a] += 1
                n[b] += 1
                p, q = sorted((find(i), find(j)))
                comp[q] = p
    return ok, n, find


@pytest.mark.parametrize("leaf", [32, 128])
def test_against_brute_force(spark, leaf):
    rows = corpus(leaf)
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, embedding array<double>, p string, unit int")
    result = near_dedup(df, 0.9, leaf_rows=leaf).cache()
    got = result.collect()
    assert len(got) == len(rows)
    ok, n, find = brute(rows, 0.9)
    mine = {}
    for r in got:
        mine.setdefault(r.vec_id, r)
        assert r.kept == (r.vec_id is not None and r.vec_id == r.component_id)
    links, found = sum(n), sum(mine[i].n_links for i, _ in ok)
    assert 0.95 * links <= found <= links
    right = sum(mine[i].component_id == find(i) for i, _ in ok)
    assert right >= 0.97 * len(ok)
    for i in (4000, 4001, 4002, 4003, 4004, 4005):
        assert (mine[i].n_links, mine[i].component_id) == (0, i)
    assert mine[None].component_id is None and mine[None].n_links == 0
    assert 0.9 <= audit(df, result) <= 1.0


def test_empty(spark):
    assert near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def subgroups(seed, groups, size, dim=64):
    """Tight groups of one wide group: each point has its nearest in its own group, and links to all others."""
    r = np.random.default_rng(seed)
    base = r.normal(size=dim)
    centres = base + r.normal(size=(groups, dim)) * 0.2
    return [(g * size + i, (centres[g] + r.normal(size=dim) * 0.02).tolist()) for g in range(groups) for i in range(size)]


@pytest.mark.parametrize("groups,size", [(2, 30), (20, 30), (100, 20)])
def test_tight_subgroups_are_joined(spark, groups, size):
    rows = subgroups(groups, groups, size)
    got = {r.vec_id: r for r in near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9).collect()}
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = (unit @ unit.T >= 0.9).sum(1) - 1
    assert near.min() >= size  # links leave the own group
    assert [got[i].n_links for i, _ in rows] == near.tolist()
    assert {r.component_id for r in got.values()} == {0}


def test_vectors_of_one_id_are_points_of_their_own(spark):
    r = np.random.default_rng(1)
    a, b, c = r.normal(size=(3, 16)).tolist()
    rows = [(5, a), (3, a), (5, b), (7, b), (9, c)]
    got = sorted((x.vec_id, x.n_links, x.component_id) for x in near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(3, 1, 3), (5, 1, 3), (5, 1, 3), (7, 1, 3), (9, 0, 9)]


def test_trees_grow_with_depth():
    for bits in (0, 5, 12, 16, 24):
        together = (1 - math.acos(0.9) / math.pi) ** bits
        assert 1 - (1 - together) ** tree_count(bits, 0.9) >= 0.95
    assert tree_count(5, 0.9) == 12 < tree_count(12, 0.9) < tree_count(16, 0.9)


def test_pairs_at_the_threshold_meet_in_deep_trees(spark):
    r = np.random.default_rng(8)
    base = r.normal(size=(2200, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(300):
        side = r.normal(size=64)
        side -= (side @ base[i]) * base[i]
        rows.append((10_000 + i, (0.902 * base[i] + math.sqrt(1 - 0.902**2) * side / np.linalg.norm(side)).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    linked = near_dedup(df, 0.9, leaf_rows=1).where("n_links > 0").count()  # twelve levels
    assert linked >= 0.95 * 600
