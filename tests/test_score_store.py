from pyspark.sql import functions as F

from graphloom import models
from graphloom.operators.score_store import ScoreStore

PAIR = "question string, id string, text string"


def test_the_model_sees_unknown_pairs_only(spark, tmp_path):
    store, asked = ScoreStore(spark, str(tmp_path / "scores")), []

    def model(new):
        asked.append(sorted((r.question, r.id) for r in new.collect()))
        return new.withColumn("score", F.length("text").cast("double"))

    pairs = lambda *rows: spark.createDataFrame(rows, PAIR)
    first = store.scored("1", pairs(("q", "a", "xx"), ("q", "a", "xx"), ("r", "a", "x"), (None, "a", "x"), ("q", "n", None)), model)
    assert sorted((r.question or "", r.id, r.score) for r in first.collect() if r.score) == [("q", "a", 2.0), ("q", "a", 2.0), ("r", "a", 1.0)]
    assert first.count() == 5
    again = ScoreStore(spark, str(tmp_path / "scores"))  # another session
    assert [r.score for r in again.scored("1", pairs(("q", "a", "changed"), ("q", "b", "yyy")), model).orderBy("id").collect()] == [2.0, 3.0]
    again.scored("2", pairs(("q", "a", "changed")), model)
    assert asked == [[("q", "a"), ("q", "n"), ("r", "a")], [("q", "b")], [("q", "a")]]
    assert again.forget() == ["1"] and again.known("1").count() == 0 and [r.score for r in again.known("2").collect()] == [7.0]
    assert again.scored("2", pairs(("q", "a", "z")).limit(0), model).count() == 0


def test_as_a_rerank_step(spark, tmp_path):
    store = ScoreStore(spark, str(tmp_path / "scores"))
    cands = spark.createDataFrame([("a", "green tea"), ("b", "black tea"), ("c", "coffee")], "id string, text string")
    want = sorted(map(tuple, models.reranked("green tea")(cands).select("id", "rerank").collect()))
    for _ in range(2):
        got = store.rerank("1", "green tea")(cands)
        assert sorted(map(tuple, got.select("id", "rerank").collect())) == want
    assert len(store.log.manifest()["live"]) == 1  # the second run had nothing to add
