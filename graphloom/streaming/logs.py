"""Structured Streaming: usage series over a log of calls, sessions that remember what they were sent, folder polling."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schema import CALL, FEEDBACK


def read_log(spark: SparkSession, path: str, feedback: bool = False, most: int = 20_000) -> DataFrame:
    """The last records of a JSON-lines log, equal times in the order of the other columns; lines that do not parse are skipped."""
    schema = FEEDBACK if feedback else CALL
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.orderBy(F.desc("at"), *[c for c in schema.fieldNames() if c != "at"]).limit(most)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    """Calls as they are appended, with event time `ts`."""
    rows = spark.readStream.schema(CALL).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("ts", F.timestamp_millis("at"))


def hourly(calls: DataFrame, late: str = "2 hours") -> DataFrame:
    """Calls, tokens and errors an hour and channel; records later than `late` are dropped by the watermark."""
    if calls.isStreaming:
        calls = calls.withWatermark("ts", late)
    return calls.groupBy(F.window("ts", "1 hour").alias("w"), "channel").agg(
        F.count("*").alias("calls"), F.sum("context_tokens").alias("tokens"), F.count_if(~F.col("ok")).alias("errors")).select(
        F.col("w.start").alias("hour"), "channel", "calls", "tokens", "errors")


def new_passages(sent: DataFrame, hours: int = 4) -> DataFrame:
    """(session, chunk_id) of a stream (session, chunk_id[, ts]) without what the session had in the last hours.

    State is the session's ids; it times out, by event time (arrival where there is no ts), `hours` after its last
    record. Records that are late are dropped, and the number of sessions has no limit: sessions.not_yet_sent has neither
    fault; `session_ids` is for a table of sent passages."""
    if "ts" not in sent.columns:
        sent = sent.withColumn("ts", F.current_timestamp())
    sent = sent.withWatermark("ts", "0 seconds")

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        had, last = set(state.get[0].split("\n")) if state.exists else set(), state.get[1] if state.exists else 0
        for pdf in batches:
            last = max(last, int(pdf["ts"].max().timestamp() * 1000))
            fresh = pdf.drop_duplicates("chunk_id")
            fresh = fresh[~fresh["chunk_id"].isin(had)]
            had |= set(fresh["chunk_id"])
            yield fresh[["session", "chunk_id"]]
        state.update(("\n".join(sorted(had)), last))
        state.setTimeoutTimestamp(max(last + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))

    return sent.groupBy("session").applyInPandasWithState(
        step, "session string, chunk_id string", "ids string, last long", "append", "EventTimeTimeout")


def session_ids(sent: DataFrame, now, hours: int = 4, most: int = 500) -> DataFrame:
    """(session, chunk_id) of a table (session, chunk_id, ts) that sessions still remember: those active in the last
    hours, and of these the `most` latest; older ones are forgotten whole."""
    live = sent.groupBy("session").agg(F.max("ts").alias("last")).where(F.col("last") > now - F.expr(f"INTERVAL {hours} HOURS"))
    kept = live.orderBy(F.desc("last"), "session").limit(most).select("session")
    return sent.join(F.broadcast(kept), "session", "left_semi").select("session", "chunk_id").distinct()  # `most` rows at most


def rotate_log(spark: SparkSession, path: str, most_bytes: int = 20_000_000) -> str | None:
    """Move a log aside when it has grown above the limit; its new name, or None."""
    import time

    from graphloom.operators.store import Files

    files = Files(spark, path)
    if files.size(path) <= most_bytes:
        return None
    aside = f"{path.rstrip('/')}-{int(time.time() * 1000)}"
    files.rename(path, aside)
    return aside


def clear_log(spark: SparkSession, path: str, project: str = "") -> int:
    """Forget the calls of one project, or all calls and rotated logs; how many of the visible calls went.

    Calls of other projects stay, those too old to be visible also. The whole log is written anew: segments.SegmentLog
    clears by one manifest and is safe against a writer that dies in between."""
    import uuid

    from graphloom.operators.store import Files

    files, path = Files(spark, path), path.rstrip("/")
    rows = read_log(spark, path)
    gone = rows if not project else rows.where(F.col("project") == project)
    count = gone.count()
    aside = f"{path}.{uuid.uuid4().hex}"
    whole = spark.read.schema(CALL).option("mode", "DROPMALFORMED").json(path)
    whole.where(~F.col("project").eqNullSafe(project) if project else F.lit(False)).write.json(aside)
    folder, name = path.rsplit("/", 1)
    for old in files.names(folder) if not project else []:
        if re.fullmatch(re.escape(name) + r"-\d+", old):
            files.delete(f"{folder}/{old}")
    files.delete(path)
    files.rename(aside, path)
    return count


def poll_folder(list_now: Callable[[], DataFrame], load_state: Callable[[], DataFrame], present: Callable[[], DataFrame], apply: Callable[[DataFrame], None]) -> DataFrame:
    """One poll: listing against state, the changes handed on. Run it on a schedule of five seconds at least; the file
    stream source would miss files that change or go."""
    from graphloom.operators.records import folder_changes

    changes = folder_changes(list_now(), load_state(), present()).where("change <> 'unchanged'")
    apply(changes)
    return changes
