import random
import tempfile

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, ingest
from graphloom.operators.live import OWNED, LiveProject
from graphloom.operators.store import Conflict, Missing

NAMES = ["Ada", "Bern", "Cham", "Dora", "Elba", "Faro"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in texts.items()], "id string, content string")


def state(live):
    rows = lambda df: sorted(map(tuple, df.collect()))
    t = live.tables()
    return {"documents": rows(t["document"].select("id", "content")), "chunks": rows(t["chunk"].select("id", "text")), "related": rows(t["related"]),
            "mentions": rows(t["mentions"].select("chunk_id", F.lower("surface"))), "entities": rows(t["entity"].select("id"))}


def check(live, texts):
    """Against a recount of the documents' texts."""
    now, t = state(live), live.tables()
    assert now["documents"] == sorted(texts.items())
    lines = [(f"{i}#{n}", line) for i, x in texts.items() for n, line in enumerate(x.split("\n")) if line]
    assert now["chunks"] == sorted(lines)
    assert now["mentions"] == sorted({(c, w.lower()) for c, line in lines for w in line.split() if w in NAMES})
    assert now["related"] == sorted(map(tuple, graph.pair_weights(t["mentions"]).collect()))
    assert now["entities"] == sorted({(r.entity_id,) for r in t["mentions"].collect()})


@pytest.mark.parametrize("seed", [1, 2])
def test_weights_equal_a_recount_after_any_changes(spark, seed):
    rng = random.Random(seed)
    text = lambda: "\n".join(" ".join(rng.choices(NAMES, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 3)))
    with tempfile.TemporaryDirectory() as root:
        live, texts = LiveProject.create(spark, root, buckets=4), {}
        put = lambda new: live.ingest(docs(spark, new), split=ingest.line_passages, embedder=None)
        first = {f"d{i}": text() for i in range(8)}
        put(first)
        texts |= first
        for step in range(4):
            act = rng.choice(["add", "replace", "delete"])
            if act == "delete":
                gone = rng.sample(sorted(texts), 2)
                live.delete(gone)
                texts = {i: t for i, t in texts.items() if i not in gone}
            else:
                new = {f"n{step}" if act == "add" else rng.choice(sorted(texts)): text()}
                put(new)
                texts |= new
        check(live, texts)
        before = state(live)
        live.compact()
        assert state(live) == before and live.parts() == len(OWNED) + 3 and not live.manifest()["deletions"]


def test_a_change_writes_the_documents_own_rows(spark):
    with tempfile.TemporaryDirectory() as root:
        live = LiveProject.create(spark, root, buckets=8)
        live.ingest(docs(spark, {f"d{i}": "Ada Bern\nCham Dora" for i in range(40)}), split=ingest.line_passages, embedder=None)
        old = live.manifest()
        live.ingest(docs(spark, {"d7": "Ada Cham"}), split=ingest.line_passages, embedder=None)
        new = live.manifest()
        for table, parts in old["rows"].items():
            assert new["rows"][table][:len(parts)] == parts  # nothing is written again
        written = live.read("chunk", new["rows"]["chunk"][1:], live._schema("chunk")).collect()
        assert [(r.id, r.text) for r in written] == [("d7#0", "Ada Cham")] and len(live.files.names(f"{root}/chunk/seq=2/turn={new['rows']['chunk'][1]['turn']}")) <= 2
        near = live.neighbours("head:ada").collect()
        assert [(r.id, r.weight) for r in near] == [("body:bern", 39), ("head:cham", 1)]
        seed = spark.createDataFrame([("head:ada", 1.0, "query")], "id string, score double, via string")
        found = live.expand(seed, 30)
        from graphloom.operators import retrieval
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, retrieval.expand(live.table("related"), seed, 30).collect()))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "/mentions" not in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
        plan = live._rows(new, "chunk", [3])._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
        assert live.table("document", version=1).where("id = 'd7'").first().content == "Ada Bern\nCham Dora"  # earlier versions stay readable


def test_dates_patch_and_names(spark):
    with tempfile.TemporaryDirectory() as root:
        live = LiveProject.create(spark, root, buckets=4)
        put = lambda t, **k: live.ingest(docs(spark, t), split=ingest.line_passages, embedder=None, **k)
        put({"a": "Ada"})
        made = live.table("document").first().created_at
        with pytest.raises(Conflict):
            put({"a": "Bern"}, create=True)
        put({"a": "Ada Bern Ada"})
        assert live.table("document").first().created_at == made
        live.patch(spark.createDataFrame([("a", "DRAFT")], "id string, status string"))
        row = live.table("document").first()
        assert (row.status, row.content, live.table("document").count(), live.table("chunk").count()) == ("DRAFT", "Ada Bern Ada", 1, 1)
        label = lambda chunk: chunk.select(F.col("id").alias("chunk_id"), "doc_id", F.col("text").alias("surface"), F.lit("OTHER").alias("label"), F.lit(0.9).alias("score"))
        put({"b": "ada"[0].upper() + "da"}, extract=label)
        assert {r.entity_id for r in live.table("mentions").collect()} == {"head:ada", "body:bern"}  # the known name wins over the new label
        with pytest.raises(Missing):
            live.delete(["nothing"])


def test_of_two_writers_the_second_fails_and_a_dead_one_blocks_nobody(spark):
    with tempfile.TemporaryDirectory() as root:
        one = LiveProject.create(spark, root, buckets=2)
        two = LiveProject(spark, root)
        late = two._next(two.manifest())
        two._add(late, late, "document", spark.createDataFrame([("x", "Ada")], "id string, content string"), "id")  # written, not yet published
        one.ingest(docs(spark, {"a": "Ada"}), split=ingest.line_passages, embedder=None)
        with pytest.raises(Conflict):
            two.publish(late)
        one.ingest(docs(spark, {"b": "Bern"}), split=ingest.line_passages, embedder=None)
        assert sorted(r.id for r in one.table("document").collect()) == ["a", "b"]
        one.compact()
        assert one.expire(keep=1) > 0 and one.versions() == [3]
        assert sorted(r.id for r in one.table("document").collect()) == ["a", "b"] and one.expire(keep=1) == 0
        with pytest.raises(Conflict):
            LiveProject.create(spark, root)


def test_pairs_and_stored_mentions_are_those_of_a_join(spark, tmp_path):
    rows = [("c1", "d", s, "HEAD" if s == "Bob" else "BODY", 0.6) for s in ("Bob", "Ann", "Zed", "ANN")] + [("c2", "e", "Ann", "HEAD", 0.7), ("c2", "e", "Bob", "BODY", 0.5), ("c3", "e", "Bob", "HEAD", 0.9)]
    raw = spark.createDataFrame(rows, "chunk_id string, doc_id string, surface string, label string, score double")
    as_rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    plain, kept = ingest.canonical(raw), ingest.canonical(raw, aside=str(tmp_path / "aside"))
    assert as_rows(kept[0].select(*plain[0].columns)) == as_rows(plain[0]) and as_rows(kept[1]) == as_rows(plain[1])
    one = plain[0].select("chunk_id", F.col("entity_id").alias("a")).distinct()
    joined = one.join(one.withColumnRenamed("a", "b"), "chunk_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))
    pairs = graph.pair_weights(spark.createDataFrame(plain[0].collect(), plain[0].schema))
    assert as_rows(pairs) == as_rows(joined) and pairs.count() == 3
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    chunk = spark.createDataFrame([("c1", "d"), ("c2", "e"), ("c3", "e")], "id string, doc_id string")
    document = spark.createDataFrame([("d", "DRAFT"), ("e", "PUBLISHED")], "id string, status string")
    assert as_rows(graph.mention_counts(kept[0], chunk, document)) == as_rows(graph.mention_counts(plain[0], chunk, document))


def test_an_ingest_extracts_once_and_leaves_nothing_aside(spark, tmp_path):
    calls = []

    def extract(chunk):
        calls.append(1)
        return ingest.capital_mentions(chunk)

    live = LiveProject.create(spark, str(tmp_path / "live"))
    live.ingest(spark.createDataFrame([("a", "Ann met Bob."), ("b", "Zed saw (Ann")], "id string, content string"), extract=extract)
    assert live.files.names(f"{live.root}/aside") == [] and len(calls) == 1
    assert sorted(r.weight for r in live.table("related").collect()) == [1, 1]


def test_names_are_evaluated_once(spark):
    raw = spark.createDataFrame([("c", "d", s, "BODY", 0.9) for s in ("Ann (Lee", " “Bob” ", "x", "plain", "The", "User", None, "A")], "chunk_id string, doc_id string, surface string, label string, score double")
    found = ingest.cleaned(raw)
    assert sorted(r.surface for r in found.collect()) == ["Ann (Lee)", "Bob", "The"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?U)") <= 3


def test_a_large_bucket_is_written_by_several_tasks(spark):
    from graphloom.operators.live import _COUNT

    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    rows = spark.range(4000, numPartitions=8).select(F.concat(F.lit("entity"), "id").alias("entity_id"), F.col("id").alias("n"))
    with tempfile.TemporaryDirectory() as root:
        live = LiveProject.create(spark, root, buckets=1)
        spark.conf.set(size, "4k")
        try:
            part = live.write(rows, "counts", 1, F.lit(0), ["entity_id"])
        finally:
            spark.conf.unset(size)
        found = live.read("counts", [part], _COUNT)
        assert len(found.inputFiles()) > 1
        assert sorted((r.entity_id, r.n) for r in found.collect()) == sorted((f"entity{i}", i) for i in range(4000))


def test_plain_names_pass_as_other_names_do(spark):
    from graphloom.functions.columns import clean_name

    given = ["Ada", "x", "A1", " Ada  B ", "(Ada", "Ada\n", "É", "Éa", "a", "", "Foo (bar", "..Ada..", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, name string")
    assert [r.c for r in rows.select("i", clean_name(F.col("name")).alias("c")).orderBy("i").collect()] == [
        "Ada", None, "A1", "Ada B", "Ada", "Ada", None, "Éa", None, None, "Foo (bar)", "Ada", None]
