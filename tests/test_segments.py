import random

import pytest

from graphloom.operators.store import Conflict
from graphloom.schema import FEEDBACK
from graphloom.streaming.segments import SegmentLog

CALLS = "at long, project string, detail string"


def rows(df):
    return [(r.at, r.project, r.detail) for r in df.select("at", "project", "detail").collect()]


def order(kept):
    """Newest first, no time last; nulls first among equal times."""
    return sorted(kept, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or "", r[2]))


def test_equal_to_a_list(spark, tmp_path):
    log, kept, r = SegmentLog.create(spark, str(tmp_path / "log")), [], random.Random(5)
    for step in range(6):
        new = [(r.choice([None, step * 10 + r.randrange(15)]), r.choice(["p", "q", "", None]), f"{step}-{i}") for i in range(12)]
        log.append(spark.createDataFrame(new, CALLS))
        kept += new
        if step == 2:
            assert log.clear("p") == sum(x[1] == "p" for x in kept)
            kept = [x for x in kept if x[1] != "p"]
        if step == 4:
            assert log.clear("") == sum(x[1] == "" for x in kept)
            kept = [x for x in kept if x[1] != ""]
    assert rows(log.last(1000)) == order(kept) and rows(log.last(17)) == order(kept)[:17]
    assert rows(log.last(9, "q")) == order([x for x in kept if x[1] == "q"])[:9]
    before = order(kept)
    log.compact()
    assert rows(log.last(1000)) == before and len(log.manifest()["live"]) == 1
    assert log.sweep(keep=1, older_ms=0) == 6 and rows(log.last(17)) == before[:17]
    assert log.clear() == len(kept) and log.last().count() == 0


def test_old_segments_are_not_read(spark, tmp_path):
    log = SegmentLog.create(spark, str(tmp_path / "log"))
    for step in range(5):
        log.append(spark.createDataFrame([(step * 100 + i, "pq"[i % 2], str(i)) for i in range(20)], CALLS).coalesce(1))
    assert len(log.last(30).inputFiles()) == 2 and len(log.records().inputFiles()) == 5
    assert len(log.last(25, "p").inputFiles()) == 3
    assert log.last(25, "p").count() == 25


def test_rotation_and_other_writers(spark, tmp_path):
    root = str(tmp_path / "log")
    log = SegmentLog.create(spark, root)
    with pytest.raises(Conflict):
        SegmentLog.create(spark, root)
    one = spark.createDataFrame([(1, "p", "a"), (2, "q", "b")], CALLS)
    log.append(one)
    assert log.rotate() == 0 and log.rotate(most_bytes=1) == 1
    assert log.last().count() == 0 and log.records(rotated=True).count() == 2
    log.append(one)
    assert log.clear("p") == 1 and rows(log.records(rotated=True)) == [(2, "q", "b")] * 2
    publish, other = log.publish, SegmentLog(spark, root)

    def late(manifest):  # another writer is first, once
        log.publish = publish
        other.append(one)
        return publish(manifest)

    log.publish = late
    log.append(one)
    assert log.records().count() == 5

    def dies(manifest):
        raise RuntimeError("gone")

    log.publish = dies
    with pytest.raises(RuntimeError):
        log.append(one)
    with pytest.raises(RuntimeError):
        log.clear("q")
    log.publish = publish
    assert log.records().count() == 5 and log.sweep(keep=1, older_ms=3_600_000) == 0
    assert log.sweep(keep=1, older_ms=0) == 1 and log.records().count() == 5

    stale = log.manifest()
    other.append(one)
    log.manifest = lambda version=None: stale
    with pytest.raises(Conflict):
        log.compact()
    del log.manifest
    assert log.records().count() == 7


def test_a_batch_is_added_once(spark, tmp_path):
    log = SegmentLog.create(spark, str(tmp_path / "log"))
    one = spark.createDataFrame([(1, "p", "a")], CALLS)
    assert log.append_batch(one, "s", 0) and not log.append_batch(one, "s", 0) and log.append_batch(one, "t", 0)
    assert log.append_batch(one.limit(0), "s", 1) and log.records().count() == 2
    inbox = tmp_path / "in"
    one.write.json(str(inbox))
    for _ in range(2):  # the second start has nothing new
        stream = spark.readStream.schema(CALLS).json(str(inbox))
        log.append_stream(stream, "files", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    assert log.records().count() == 3


def test_records_without_a_project(spark, tmp_path):
    log = SegmentLog.create(spark, str(tmp_path / "log"), FEEDBACK)
    log.append(spark.createDataFrame([("search", 3, ["a"]), ("cite", 5, None)], "kind string, at long, chunks array<string>"))
    assert [r.kind for r in log.last(1).collect()] == ["cite"] and log.clear() == 2 and log.last().count() == 0
