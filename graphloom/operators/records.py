"""Evaluation, feedback and usage analytics; read windows; folder listings; compliance reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.config import DEFAULTS
from graphloom.functions.columns import question_key

HOUR = 3_600_000


# usage history

def calls_since(calls: DataFrame, now_ms: int, hours: int, channel: str = "", operation: str = "", project: str = "", errors: bool = False) -> DataFrame:
    """Calls of the last hours (1 to 2160) that match; an empty filter is no filter."""
    hours = max(1, min(2160, hours))
    found = calls.where(F.col("at") >= now_ms - hours * HOUR)
    for name, value in (("channel", channel), ("operation", operation), ("project", project)):
        if value:
            found = found.where(F.col(name) == value)
    return found.where(~F.col("ok")) if errors else found


def totals(calls: DataFrame) -> DataFrame:
    """Calls, tokens, the upper median duration and errors; 0 over no calls."""
    n = F.count("*")
    counted = calls.agg(n.alias("calls"), F.coalesce(F.sum("context_tokens"), F.lit(0)).alias("tokens"), F.count_if(~F.col("ok")).alias("errors"))
    # durations repeat, so their counts are few; the upper median is the first whose running count passes half
    by_value = calls.groupBy("duration_ms").agg(n.alias("m"))
    running = F.sum("m").over(Window.orderBy("duration_ms"))
    half = by_value.withColumn("upto", running).crossJoin(F.broadcast(counted.select("calls"))).where(F.col("upto") > F.floor(F.col("calls") / 2))
    return counted.crossJoin(half.agg(F.coalesce(F.min("duration_ms"), F.lit(0)).alias("median_ms")))


def series(calls: DataFrame, now_ms: int, hours: int, main: str = "mcp") -> DataFrame:
    """Buckets counted back from now: hours up to 48 hours, else days; empty ones kept. (bucket, start, calls, main_tokens, other_tokens)"""
    hours = max(1, min(2160, hours))
    width = HOUR if hours <= 48 else 24 * HOUR
    n = -(-hours * HOUR // width)
    start = now_ms - n * width
    at = F.least(F.greatest(F.floor((F.col("at") - start) / width), F.lit(0)), F.lit(n - 1)).cast("long")
    filled = calls.where(F.col("at") >= now_ms - hours * HOUR).groupBy(at.alias("bucket")).agg(
        F.count("*").alias("calls"), F.sum(F.when(F.col("channel") == main, F.col("context_tokens")).otherwise(0)).alias("main_tokens"),
        F.sum(F.when(F.col("channel") != main, F.col("context_tokens")).otherwise(0)).alias("other_tokens"))
    spine = calls.sparkSession.range(n).select(F.col("id").alias("bucket"), (F.lit(start) + F.col("id") * width).alias("start"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return spine.join(filled, "bucket", "left").select("bucket", "start", zero("calls"), zero("main_tokens"), zero("other_tokens"))


def page(calls: DataFrame, offset: int, limit: int) -> DataFrame:
    """Newest calls, at most 500 a page."""
    return calls.orderBy(F.desc("at"), F.desc("event_id")).offset(offset).limit(min(limit, 500))


# evaluation

def expectation_met(text, page_no, doc):
    """Whether a passage answers `expect`: its document, a page within one, all substrings in any case."""
    e = F.col("expect")
    on_page = e["pages"].isNull() | (F.size(e["pages"]) == 0) | F.exists(e["pages"], lambda p: F.abs(p - page_no) <= 1)
    holds = F.coalesce(F.forall(e["contains"], lambda s: F.lower(text).contains(F.lower(s))), F.lit(True))
    return (e["doc"].isNull() | (e["doc"] == doc)) & on_page & holds


def evaluated(results: DataFrame, questions: DataFrame) -> DataFrame:
    """(id, rank, returned): 1-based rank of the first right passage of each question.

    results: (id, place, doc_id, page, text); questions: (id, question, expect)."""
    judged = results.join(questions.select("id", "expect"), "id").withColumn("hit", expectation_met(F.col("text"), F.col("page"), F.col("doc_id")))
    ranks = judged.groupBy("id").agg(F.min(F.when(F.col("hit"), F.col("place"))).alias("rank"), F.count("*").alias("returned"))
    return questions.select("id", F.coalesce(F.col("expect.none"), F.lit(False)).alias("none")).join(ranks, "id", "left").withColumn(
        "returned", F.coalesce("returned", F.lit(0)))


def metrics(ranked: DataFrame, k: int = DEFAULTS.k) -> DataFrame:
    """hit@1, hit@3, hit@k and MRR over answerable questions; rejection over the others; overall."""
    answerable = ~F.col("none")
    hit = lambda n: F.avg(F.when(answerable, F.when(F.col("rank") <= n, 1.0).otherwise(0.0)))
    out = ranked.agg(F.count("*").alias("questions"), hit(1).alias("hit_1"), hit(3).alias("hit_3"), hit(k).alias("hit_k"),
                     F.avg(F.when(answerable, F.coalesce(1.0 / F.col("rank"), F.lit(0.0)))).alias("mrr"),
                     F.avg(F.when(F.col("none"), F.when(F.col("returned") == 0, 1.0).otherwise(0.0))).alias("rejection"))
    both = (F.col("hit_k") + F.col("rejection")) / 2
    return out.withColumn("overall", F.coalesce(both, "hit_k", "rejection"))


def sweep(results: DataFrame, questions: DataFrame, thresholds: list[float], k: int = DEFAULTS.k) -> DataFrame:
    """metrics() at each threshold of the score (min_score), from one search a question without a threshold.

    results: (id, place, doc_id, page, text, score), the place by falling score; a threshold then cuts an end off, so a
    question matters by two numbers: how many thresholds its first right passage passes, and how many its best passage."""
    ts = sorted(set(map(float, thresholds)))
    passed = F.size(F.filter(F.array(*map(F.lit, ts)), lambda t: t <= F.col("score")))
    judged = results.join(questions.select("id", "expect"), "id").withColumn("passed", passed).withColumn(
        "hit", expectation_met(F.col("text"), F.col("page"), F.col("doc_id")))
    each = judged.groupBy("id").agg(F.min(F.when(F.col("hit"), F.col("place"))).alias("rank"), F.max(F.when(F.col("hit"), F.col("passed"))).alias("right"),
                                    F.max("passed").alias("best"))
    none = F.coalesce(F.col("expect.none"), F.lit(False))
    each = questions.select("id", none.alias("none")).join(each, "id", "left")
    answerable, rank = ~F.col("none"), F.col("rank")
    level = F.coalesce(F.when(answerable, F.col("right")).otherwise(F.col("best")), F.lit(0))
    sums = {"hit_1": F.when(rank <= 1, 1.0), "hit_3": F.when(rank <= 3, 1.0), "hit_k": F.when(rank <= k, 1.0), "mrr": 1.0 / rank, "asked": F.lit(1.0)}
    levels = each.groupBy(level.alias("level")).agg(
        *[F.sum(F.when(answerable, c)).alias(n) for n, c in sums.items()], F.count_if("none").alias("kept"), F.count("*").alias("questions"))
    spine = questions.sparkSession.createDataFrame(list(enumerate([None, *ts])), "level int, min_score double")
    above = Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)  # a row a threshold
    whole = Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = lambda c, w: F.sum(F.coalesce(c, F.lit(0))).over(w)
    share = lambda c: F.try_divide(over(c, above), over("asked", whole)).alias(c)
    refused = F.try_divide(over("kept", whole) - over("kept", above), over("kept", whole))
    out = spine.join(levels, "level", "left").select(
        "min_score", over("questions", whole).alias("questions"), *map(share, ("hit_1", "hit_3", "hit_k", "mrr")), refused.alias("rejection")).where("min_score is not null")
    return out.withColumn("overall", F.coalesce((F.col("hit_k") + F.col("rejection")) / 2, "hit_k", "rejection"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The sweep's row of best (overall, mrr, min_score)."""
    return sweep.orderBy(F.desc("overall"), F.desc("mrr"), F.desc("min_score")).limit(1)


# feedback

def latest_citations(log: DataFrame) -> DataFrame:
    """The last citation of each question, and how many it had."""
    cited = log.where("kind = 'cite'").withColumn("qkey", question_key(F.col("question")))
    last = F.max_by(F.struct("question", "outcome", "chunks"), F.struct("at", "seq") if "seq" in log.columns else F.col("at"))
    return cited.groupBy("qkey").agg(last.alias("last"), F.max("at").alias("at"), F.count("*").alias("n")).select("qkey", "last.*", "at", "n")


def gaps(log: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    """Questions that the documents do not answer: empty searches, and last citations that are not `answered`.

    (qkey, question, n, unanswered, reported, last_at, best): grouped by equal keys; see question_leaders for near ones."""
    searches = log.where("kind = 'search' and (chunks is null or size(chunks) = 0)").select(
        question_key(F.coalesce("question", "query")).alias("qkey"), F.coalesce("question", "query").alias("question"), "at", "best", F.lit(1).alias("u"), F.lit(0).alias("r"))
    reports = latest_citations(log).where("outcome <> 'answered'").select("qkey", "question", "at", F.lit(None).cast("double").alias("best"), F.lit(0).alias("u"), F.lit(1).alias("r"))
    each = searches.unionByName(reports)
    wording = each.groupBy("qkey", "question").agg(F.count("*").alias("w"), F.max("at").alias("wa"))
    usual = wording.groupBy("qkey").agg(F.max_by("question", F.struct("w", "wa", "question")).alias("question"))
    found = each.groupBy("qkey").agg(F.count("*").alias("n"), F.sum("u").alias("unanswered"), F.sum("r").alias("reported"), F.max("at").alias("last_at"), F.max("best").alias("best"))
    found = found.join(usual, "qkey")
    return found if dismissed is None else found.join(dismissed, "qkey", "left_anti")


def proposals(log: DataFrame, chunk: DataFrame, dismissed: DataFrame, known: DataFrame) -> DataFrame:
    """Answered questions with passages that still exist, neither dismissed nor in the evaluation set (qkey)."""
    answered = latest_citations(log).where("outcome = 'answered'").join(dismissed, "qkey", "left_anti").join(known, "qkey", "left_anti")
    alive = answered.select("qkey", F.explode("chunks").alias("id")).join(chunk.select("id", "doc_id", "page"), "id")
    first = alive.groupBy("qkey").agg(F.min("doc_id").alias("doc"), F.sort_array(F.collect_set(F.when(F.col("page") > 0, F.col("page")))).alias("pages"))
    return answered.join(first, "qkey").orderBy(F.desc("at"), "qkey")


def question_leaders(questions: DataFrame, threshold: float = DEFAULTS.same_question, key: str = "project") -> DataFrame:
    """(key, seq, leader): greedy clusters in order; a question joins the first leader near enough. Sequential by nature, a project at a time."""

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("seq")
        vectors, names, out = np.empty((64, 0)), [], []  # rows up to len(names) are leaders
        for seq, v in zip(pdf["seq"], pdf["embedding"], strict=True):
            v = np.asarray(v, float)
            if not names:
                vectors = np.empty((64, len(v)))
            hits = vectors[:len(names)] @ v >= threshold
            if hits.any():
                out.append(names[int(hits.argmax())])
                continue
            if len(names) == len(vectors):
                vectors = np.concatenate([vectors, np.empty_like(vectors)])
            vectors[len(names)] = v
            names.append(seq)
            out.append(seq)
        return pd.DataFrame({key: pdf[key], "seq": pdf["seq"], "leader": out})

    types = dict(questions.dtypes)
    return questions.groupBy(key).applyInPandas(lead, f"{key} {types[key]}, seq {types['seq']}, leader {types['seq']}")


def unknown_chunks(cited: DataFrame, chunk: DataFrame) -> DataFrame:
    return cited.join(chunk.select("id"), "id", "left_anti")


# reading around, sessions, folders

def read_window(chunk: DataFrame, wanted: DataFrame, window: int = 1) -> DataFrame:
    """Passages within `window` (0 to 3) of those asked for (id), in ranges merged when they touch: (doc_id, range, idx, id, asked, text)."""
    window = max(0, min(DEFAULTS.read_window, window))
    asked = chunk.join(wanted.select("id").distinct(), "id", "left_semi").select("doc_id", "idx")
    around = asked.select("doc_id", F.explode(F.sequence(F.col("idx") - window, F.col("idx") + window)).alias("idx")).distinct()
    found = chunk.join(around, ["doc_id", "idx"]).join(asked.withColumn("asked", F.lit(True)), ["doc_id", "idx"], "left")
    order = Window.partitionBy("doc_id").orderBy("idx")
    starts = F.when(F.coalesce(F.col("idx") - F.lag("idx").over(order) > 1, F.lit(True)), 1).otherwise(0)
    return found.withColumn("new", starts).withColumn("range", F.sum("new").over(order)).select(
        "doc_id", "range", "idx", "id", F.coalesce("asked", F.lit(False)).alias("asked"), "text")


def not_sent(ranked: DataFrame, sent: DataFrame) -> DataFrame:
    """Passages that a session has not had yet."""
    return ranked.join(sent.select("id"), "id", "left_anti")


def folder_changes(listing: DataFrame, state: DataFrame, present: DataFrame) -> DataFrame:
    """(path, change): listing and state are (path, size, mtime_s), present the paths that have a document.

    Unchanged means an equal stamp and a document; a known file without one counts as changed."""
    old = state.select("path", F.struct("size", "mtime_s").alias("old"))
    new = listing.select("path", F.struct("size", "mtime_s").alias("new"))
    has = present.select("path").distinct().withColumn("has", F.lit(True))
    change = (F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added")
              .when((F.col("new") == F.col("old")) & F.coalesce("has", F.lit(False)), "unchanged").otherwise("changed"))
    return new.join(old, "path", "full_outer").join(has, "path", "left").select("path", change.alias("change"))


def compliance(requirements: DataFrame) -> DataFrame:
    """Counts by status and the rate over what can be verified, rounded to a whole percent."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = requirements.agg(F.count("*").alias("total"), n("compliant"), n("partial"), n("non_compliant"), n("not_verifiable"))
    rate = F.round(100 * F.try_divide(F.col("compliant"), F.col("total") - F.col("not_verifiable"))).cast("long")
    return out.withColumn("rate", F.coalesce(rate, F.lit(0)))


def gap_cards(requirements: DataFrame) -> DataFrame:
    """Requirements that fail or half fail, worst first."""
    order = lambda c, names: F.coalesce(*[F.when(F.col(c) == x, i) for i, x in enumerate(names)], F.lit(len(names)))
    return requirements.where("status in ('non_compliant', 'partial')").orderBy(
        order("status", ["non_compliant", "partial"]), order("severity", ["critical", "major", "minor"]), "id")


def answer_sources(answers: DataFrame, chunk: DataFrame, document: DataFrame) -> DataFrame:
    """(answer_id, doc_id, title, passages, pages): what answers(answer_id, cited array, read array) rest on, the passages
    cited, else those read, by document; documents in the order of their first passage in the list."""
    ids = F.when(F.size(F.coalesce("cited", F.array())) > 0, F.col("cited")).otherwise(F.col("read"))
    each = answers.select("answer_id", F.posexplode(F.array_distinct(ids)).alias("place", "id"))
    placed = each.join(chunk.select("id", "doc_id", "page"), "id").join(document.select(F.col("id").alias("doc_id"), "title"), "doc_id")
    return placed.groupBy("answer_id", "doc_id", "title").agg(
        F.min("place").alias("place"), F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("passages"),
        F.array_sort(F.collect_set(F.when(F.col("page") > 0, F.col("page")))).alias("pages"))
