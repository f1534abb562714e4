"""Scores of a reranker that were worked out before: a table, so that sessions and executors share them.

A score belongs to a version of the project, a question and a passage. Known scores are joined to the pairs asked for,
the model sees the distinct pairs that are left, and what it gives is one segment of a log: a run that dies adds
nothing, two runs at once may both add a pair (the later counts), and an old version is forgotten by one manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import models
from graphloom.schema import SCORE
from graphloom.streaming.segments import SegmentLog

_PAIR = ["question", "id"]


class ScoreStore:
    def __init__(self, spark: SparkSession, root: str):
        self.log = SegmentLog(spark, root, SCORE)
        if not self.log.versions():
            self.log = SegmentLog.create(spark, root, SCORE)

    def known(self, version: str) -> DataFrame:
        """(question, id, score) of a version."""
        rows = self.log.records().where(F.col("project") == version)
        return rows.groupBy(*_PAIR).agg(F.max_by("score", F.struct("at", "score")).alias("score"))

    def scored(self, version: str, pairs: DataFrame, model: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """pairs(question, id, text, ...) with their score. `model` adds `score` to distinct (question, id, text); it is asked for
        unknown pairs only. Of several texts of a pair the least is scored; a null question or id is never kept, and has no score."""
        whole = pairs.where("question is not null and id is not null").groupBy(*_PAIR).agg(F.min("text").alias("text"))
        new = model(whole.join(self.known(version), _PAIR, "left_anti"))
        self.log.append(new.select(F.unix_millis(F.current_timestamp()).alias("at"), F.lit(version).alias("project"), *_PAIR, F.col("score").cast("double")))
        return pairs.join(self.known(version), _PAIR, "left")

    def rerank(self, version: str, question: str, model: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame], DataFrame]:
        """A rerank step for retrieval.search: candidates(id, text, ...) with `rerank`, by models.reranked unless another is given."""
        step = model or models.reranked(question)

        def run(candidates: DataFrame) -> DataFrame:
            pairs = candidates.withColumn("question", F.lit(question))
            done = self.scored(version, pairs, lambda new: step(new).withColumnRenamed("rerank", "score"))
            return candidates.join(done.select("id", F.col("score").alias("rerank")).distinct(), "id")

        return run

    def forget(self, versions: int = 1, most: int = 20_000) -> list[str]:
        """Keep the `versions` of the latest scores, fewer if together they have more than `most` rows, but always the
        latest; then compact. The versions that went."""
        pieces: dict[str, list[int]] = {}
        for segment in self.log.manifest()["live"]:
            for version, rows, _, last in segment["pieces"]:
                at, n = pieces.get(version, (last, 0))
                pieces[version] = [max(at, last), n + rows]
        latest = sorted(pieces, key=lambda v: (pieces[v][0], v), reverse=True)
        kept, rows = 0, 0
        for version in latest[:versions]:
            rows += pieces[version][1]
            if kept and rows > most:
                break
            kept += 1
        for version in latest[kept:]:
            self.log.clear(version)
        if latest:
            self.log.compact()
        return sorted(latest[kept:])
