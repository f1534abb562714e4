import __spark_entry__
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators.context import within_budget
from graphloom.plans.driver_tables import Project


def vectors(spark, sf):
    return {r.id: np.asarray(r.embedding, float) for r in Project(spark, sf).vectors.select("id", "embedding").collect()}


def test_near_duplicates_over_all_vectors(spark, sf):
    got = {(r.query_id, r.id, r.place) for r in __spark_entry__.queries()["win06_near_duplicates"](spark, sf).collect()}
    found, want = vectors(spark, sf), set()
    assert max(found) >= 400
    for query in {i // 300 * 3 + i % 3 for i in found}:
        kept = []
        for i in sorted(i for i in found if i // 300 * 3 + i % 3 == query):
            if len(kept) < 20 and all(found[i] @ found[k] < 0.35 for k in kept):
                kept.append(i)
                want.add((query, i, len(kept)))
    assert got == want


def test_leaders_over_all_vectors(spark, sf):
    got = {r.seq: r.leader for r in __spark_entry__.queries()["win07_question_leaders"](spark, sf).collect()}
    found, leaders, want = vectors(spark, sf), {}, {}
    for i in sorted(found):
        mine = leaders.setdefault(i % 4, [])
        want[i] = next((k for k in mine if found[i] @ found[k] >= 0.35), i)
        if want[i] == i:
            mine.append(i)
    assert got == want and len(got) == len(found)


def test_budget_over_all_lines(spark, sf):
    got = {r.id for r in __spark_entry__.queries()["win05_budget"](spark, sf).collect()}
    lines = {}
    for r in Project(spark, sf).chunk.select("doc_id", "idx", "id", "text").collect():
        lines.setdefault(r.doc_id, []).append(r)
    want = set()
    for rows in lines.values():
        rows.sort(key=lambda r: r.idx)
        keep = within_budget([(r.text, r.idx % 3 == 0) for r in rows], 200)
        want |= {r.id for r, k in zip(rows, keep, strict=True) if k}
    assert got == want


@pytest.mark.parametrize("name", ["qry01_search", "qry01_search_fused", "top06_rerank_pool"])
def test_searches_rank_copies_as_their_sql_does(spark, sf, tmp_path, name):
    for t, key in (("documents", "doc_id"), ("embeddings", "vec_id"), ("labels", "doc_id")):
        rows = spark.read.parquet(f"{sf}/{t}.parquet")
        rows.unionByName(rows.withColumn(key, F.col(key) + 100_000)).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    rel = con.sql(__spark_entry__.oracle_sql()[name])
    as_row = lambda r: str([round(x, 5) if isinstance(x, float) else x for x in r])
    got = __spark_entry__.queries()[name](spark, str(tmp_path)).select(*rel.columns).collect()
    assert sorted(map(as_row, got)) == sorted(map(as_row, rel.fetchall()))
