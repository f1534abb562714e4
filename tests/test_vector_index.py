import tempfile

import numpy as np
import pytest

from graphloom.operators import retrieval
from graphloom.operators.vector_index import VectorIndex

SCHEMA = "id string, embedding array<double>"


def clustered(n=1200, d=32, groups=30, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    return [(f"v{i:04d}", [float(c) for c in centres[i % groups] + 0.25 * rng.normal(size=d)]) for i in range(n)]


def scan(rows, q, k):
    x = np.array([v for _, v in rows])
    s = x @ np.array(q) / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
    return [rows[i][0] for i in sorted(range(len(rows)), key=lambda i: (-s[i], rows[i][0]))[:k]]


def ids(df):
    return [r.id for r in df.collect()]


@pytest.fixture(scope="module")
def built(spark):
    with tempfile.TemporaryDirectory() as root:
        rows = clustered()
        odd = [("null", None), ("zero", [0.0] * 32), ("nan", [float("nan")] * 32), ("part", [1.0] * 31 + [None])]
        yield rows, VectorIndex.build(spark.createDataFrame(rows + odd, SCHEMA), root + "/index")


def test_recall_of_few_cells(built):
    rows, index = built
    cells = len(index.model()[0])
    assert cells == 35
    found = [len(set(ids(index.search(v, 10, probes=6))) & set(scan(rows, v, 10))) for _, v in rows[::120]]
    assert sum(found) >= 0.95 * 10 * len(found)


def test_exact_search_equals_a_scan(spark, built):
    rows, index = built
    for _, v in rows[5::400]:
        want = retrieval.nearest(spark.createDataFrame(rows, SCHEMA), v, 12)
        assert ids(index.search(v, 12, probes=2, exact=True)) == ids(want)
    assert len(ids(index.search(rows[0][1], 5000, exact=True))) == len(rows)


def test_a_search_reads_only_its_cells(built):
    rows, index = built
    plan = index.search(rows[3][1], 5, probes=3)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    q = np.array(rows[3][1])
    read = index.rows(index.manifest(), [0, 1]).select("bucket").distinct().count()
    assert read == 2 and np.isfinite(q).all()


def test_rows_come_and_go(spark):
    with tempfile.TemporaryDirectory() as root:
        rows = clustered(300, 16, 8)
        index = VectorIndex.build(spark.createDataFrame(rows[:200], SCHEMA), root + "/index", cells=6)
        index.add(spark.createDataFrame(rows[200:], SCHEMA))
        index.add(spark.createDataFrame([("v0007", rows[150][1]), ("far", [-40.0] * 16)], SCHEMA))  # one moves
        index.remove(spark.createDataFrame([("v0009",), ("v0150",)], "id string"))
        now = [(i, rows[150][1] if i == "v0007" else v) for i, v in rows if i not in ("v0009", "v0150")] + [("far", [-40.0] * 16)]
        for q in (rows[150][1], rows[9][1], [-1.0] * 16):
            assert ids(index.search(q, 8, probes=1, exact=True)) == scan(now, q, 8)
        index.compact()
        assert ids(index.search(rows[9][1], 8, probes=1, exact=True)) == scan(now, rows[9][1], 8) and not index.manifest()["deletions"]
        assert ids(index.search([0.0] * 16, 3)) == []


def test_nothing_to_index(spark):
    with tempfile.TemporaryDirectory() as root:
        index = VectorIndex.build(spark.createDataFrame([("a", None)], SCHEMA), root + "/index")
        assert ids(index.search([1.0, 2.0], 3)) == []
