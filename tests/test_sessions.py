import json
import os
import random

from graphloom.streaming.sessions import not_yet_sent

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold(batches, hours, most):
    """What a single process would send, row by row in order of arrival."""
    out, alive, had = [], {}, {}
    for batch in batches:
        for project, session, chunk, ms in sorted(batch, key=lambda r: (r[3], r[2])):
            mine = alive.setdefault(project, {})
            now = max([ms, *mine.values()])
            for s in [s for s, last in mine.items() if last + hours * 3_600_000 <= now]:
                del mine[s]
            if session not in mine:
                if len(mine) >= most:
                    del mine[min(mine, key=lambda s: (mine[s], s))]
                mine[session] = ms
                had[project, session] = set()
            mine[session] = max(mine[session], ms)
            if chunk not in had[project, session]:
                had[project, session].add(chunk)
                out.append((project, session, chunk))
    return sorted(out)


def run(spark, tmp_path, batches, hours, most):
    """The stream over the batches, started again for each: state comes from the checkpoint."""
    inbox, got = tmp_path / "in", []
    inbox.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else processing time alone goes on for ever
    try:
        for n, batch in enumerate(batches):
            text = "\n".join(json.dumps({"project": p, "session": s, "chunk_id": c, "ms": ms}) for p, s, c, ms in batch)
            (inbox / f"{n:03d}.part").write_text(text)
            os.rename(inbox / f"{n:03d}.part", inbox / f"{n:03d}.json")
            rows = spark.readStream.schema("project string, session string, chunk_id string, ms long").option("pathGlobFilter", "*.json").json(str(inbox))
            query = not_yet_sent(rows.selectExpr("project", "session", "chunk_id", "timestamp_millis(ms) AS ts"), hours, most).writeStream.foreachBatch(
                lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return sorted(got)


def test_equals_a_fold_with_late_rows_silence_and_eviction(spark, tmp_path):
    rng, hour, base = random.Random(2), 3_600_000, 1_700_000_000_000
    batches = []
    for n in range(3):
        at = base + n * 2 * hour
        batches.append(sorted({(rng.choice(["alpha", "beta"]), f"s{rng.randrange(6)}", f"c{rng.randrange(8)}", at + rng.randrange(90) * 60_000) for _ in range(30)}))
    batches[1].append(("alpha", "s0", "late", base - 10 * hour))  # a row that is much too late still comes out
    batches[2].append(("alpha", "again", "c1", base + 30 * hour))  # all others have been silent by then
    batches[2].append(("alpha", "s1", "c1", base + 31 * hour))
    got = run(spark, tmp_path, batches, hours=4, most=3)
    assert got == fold(batches, 4, 3)
    assert ("alpha", "s0", "late") in got and got.count(("alpha", "s1", "c1")) >= 1
    assert len(got) < sum(map(len, batches))
