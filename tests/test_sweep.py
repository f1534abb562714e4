import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import records
from graphloom.schema import EVALSET

NAMES = ("questions", "hit_1", "hit_3", "hit_k", "mrr", "rejection", "overall")


@pytest.mark.parametrize("kinds", [(False, True), (False,), (True,)])
def test_each_threshold_as_a_search_of_its_own(spark, kinds):
    r, rows, asked = random.Random(len(kinds)), [], []
    for q in range(25):
        asked.append((f"q{q}", "?", {"doc": f"d{r.randrange(6)}", "pages": None, "contains": None, "none": r.choice(kinds)}))
        scores = sorted((round(r.random(), 1) for _ in range(r.randrange(8))), reverse=True)
        rows += [(f"q{q}", i + 1, f"d{r.randrange(6)}", 1, "t", s) for i, s in enumerate(scores)]
    questions = spark.createDataFrame(asked, EVALSET)
    results = spark.createDataFrame(rows, "id string, place int, doc_id string, page long, text string, score double").cache()
    ts = [0.7, 0.0, 0.3, 0.3, 2.0]
    got = {x.min_score: x for x in records.sweep(results, questions, ts, k=4).collect()}
    assert sorted(got) == sorted(set(ts))
    for t in got:
        want = records.metrics(records.evaluated(results.where(F.col("score") >= t), questions), k=4).first()
        for n in NAMES:
            assert got[t][n] == (None if want[n] is None else pytest.approx(want[n])), (t, n)


def test_no_questions(spark):
    none = spark.createDataFrame([], EVALSET)
    results = spark.createDataFrame([], "id string, place int, doc_id string, page long, text string, score double")
    assert [(x.min_score, x.questions, x.hit_k, x.overall) for x in records.sweep(results, none, [0.5]).collect()] == [(0.5, 0, None, None)]
