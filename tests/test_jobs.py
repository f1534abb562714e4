import threading

import pytest
from pyspark.sql import functions as F

from graphloom.functions import stem, text
from graphloom.operators import console, records, retrieval
from graphloom.operators.jobs import Jobs
from graphloom.operators.store import Conflict, Projects
from graphloom.sources import documents
from graphloom.streaming import logs


def test_jobs_run_in_order_cancel_and_resume(spark, tmp_path):
    gate, seen = threading.Event(), []

    def work(job, step):
        seen.append((job.document_id, job.operation))
        if job.document_id == "first":
            gate.wait(30)
        step("chunking", 1, 2)
        if job.document_id == "bad":
            raise ValueError("no text")
        return {"rows": spark.range(3).count()}

    folder = str(tmp_path / "jobs")
    jobs = Jobs(spark, folder, work)
    first, second, bad, last = (jobs.submit("p", n) for n in ("first", "second", "bad", "last"))
    assert jobs.cancel(second.id) and not jobs.cancel("unknown") and len(jobs.files.names(folder)) == 4
    gate.set()
    jobs.close()
    assert [n for n, _ in seen] == ["first", "bad", "last"]
    assert (first.stage, second.stage, bad.stage, bad.error, last.report) == ("done", "cancelled", "failed", "no text", {"rows": 3})
    assert first.percent == 100 and "no text" in bad.line() and [j.id for j in jobs.list("p")][0] == last.id and not jobs.list("q")
    assert jobs.files.names(folder) == [] and not jobs.cancel(first.id)
    jobs.files.replace(f"{folder}/x.json", '{"id": "x", "project": "p", "document_id": "left", "operation": "create", "created_at": 1.0}')
    again = Jobs(spark, folder, work)
    assert [j.operation for j in again.resume()] == ["upsert"]
    again.close()
    assert seen[-1] == ("left", "upsert")


def test_store_keeps_vectors_images_and_one_of_two_writers(spark, tmp_path):
    projects = Projects(spark, str(tmp_path / "p"))
    projects.create("demo")
    projects.rename("demo", "Demo")
    store = projects.open("demo", "hashed")
    doc = spark.createDataFrame([("d", "Title", "# Paris\nParis is a big Town.\n<!-- image 1 -->\nFigure 1: a map of Paris.")], "id string, title string, content string")
    store.ingest(doc)
    assert store.table("chunk").where("embedding is null").count() == 0 and store.table("entity").where("embedding is null").count() == 0
    assert store.table("image").count() == store.table("shows").count() == 1
    assert store.manifest()["name"] == "Demo" and projects.health()["projects"] == 1
    store.files.claim(f"{store.root}/claims/{store.version + 1}")
    with pytest.raises(Conflict):
        store.write({"chunk": store.table("chunk")})
    assert store.table("chunk").count() > 0


def test_keyword_index_follows_changes(spark, tmp_path):
    chunk = spark.createDataFrame([("a#0", "Running cats"), ("a#1", "the dogs"), ("b#0", "cat food")], "id string, text string")
    index = retrieval.KeywordIndex.build(chunk)
    changed = index.without(spark.createDataFrame([("b#0",)], "chunk_id string")).with_passages(spark.createDataFrame([("a#1", "a cat runs")], "id string, text string"))
    changed.write(str(tmp_path / "index"))
    read = retrieval.KeywordIndex.read(spark, str(tmp_path / "index"))
    want = retrieval.postings(spark.createDataFrame([("a#0", "Running cats"), ("a#1", "a cat runs")], "id string, text string"), stem.stemmed_terms)
    assert sorted(map(tuple, read.tf.collect())) == sorted(map(tuple, want[0].collect()))
    hits = retrieval.bm25_search(read.tf, read.lengths, stem.analyse("cats running"), 5).collect()
    assert {h.chunk_id for h in hits} == {"a#0", "a#1"}


def test_small_operators(spark, tmp_path):
    assert len(stem.STOPWORDS) == 92
    assert text.link_titles("see Guide A and guide", {"Guide": "g", "Guide A": "ga"}) == "see [Guide A](#doc=ga) and [guide](#doc=g)"
    (tmp_path / "root" / "in").mkdir(parents=True)
    assert documents.inside(str(tmp_path / "root"), "in").endswith("/root/in")
    with pytest.raises(ValueError):
        documents.inside(str(tmp_path / "root"), "../other")
    tables = {r.name: r.kind for r in console.show_tables(spark, {"chunk": None, "mentions": None}).collect()}
    assert tables == {"chunk": "node", "mentions": "relation"}
    answers = spark.createDataFrame([(1, ["c2", "c1"], ["c3"]), (2, [], ["c3", "c3"])], "answer_id long, cited array<string>, read array<string>")
    chunk = spark.createDataFrame([("c1", "d", 2), ("c2", "d", 0), ("c3", "e", 1)], "id string, doc_id string, page long")
    doc = spark.createDataFrame([("d", "D"), ("e", "E")], "id string, title string")
    got = {(r.answer_id, r.doc_id): (r.passages, r.pages) for r in records.answer_sources(answers, chunk, doc).collect()}
    assert got == {(1, "d"): (["c2", "c1"], [2]), (2, "e"): (["c3"], [1])}


def test_logs_clear_rotate_and_sessions(spark, tmp_path):
    path = str(tmp_path / "calls")
    old = str(tmp_path / "long")
    logs.append_log(spark.range(20_010).selectExpr("id AS at", "if(id < 10, 'q', 'p') AS project"), old)
    assert logs.clear_log(spark, old, "p") == 20_000 and logs.read_log(spark, old).count() == 10  # these were not visible before
    logs.append_log(spark.createDataFrame([(i, "pq"[i % 2]) for i in range(6)], "at long, project string"), path)
    assert logs.rotate_log(spark, path) is None and logs.clear_log(spark, path, "p") == 3
    assert {r.project for r in logs.read_log(spark, path).collect()} == {"q"}
    aside = logs.rotate_log(spark, path, most_bytes=10)
    logs.append_log(spark.createDataFrame([(9, "p")], "at long, project string"), path)
    assert aside and logs.clear_log(spark, path) == 1 and logs.read_log(spark, path).count() == 0
    assert not (tmp_path / aside.rsplit("/", 1)[1]).exists()
    sent = spark.createDataFrame([(f"s{i}", "c", i) for i in range(5)] + [("s4", "d", 9)], "session string, chunk_id string, t long").withColumn("ts", F.timestamp_seconds(F.col("t") * 3600))
    got = logs.session_ids(sent, F.timestamp_seconds(F.lit(6 * 3600)), hours=4, most=2)
    assert {(r.session, r.chunk_id) for r in got.collect()} == {("s3", "c"), ("s4", "c"), ("s4", "d")}


def test_dense_maps_are_thinned(spark):
    from graphloom.operators import graph

    weights = [i % 7 + 1 for i in range(30)]
    edges = spark.createDataFrame([(str(i), str(i + 1), w) for i, w in enumerate(weights)], "a string, b string, weight long")
    for nodes in (3, 7, 8, 100):
        cut = max(2, sorted(weights, reverse=True)[3 * nodes]) if len(weights) > 4 * nodes else 0
        assert graph.thinned(edges, nodes).count() == sum(w >= cut for w in weights)


def test_renames_are_versions_and_a_dead_writers_claim_is_taken_over(spark, tmp_path):
    from graphloom.operators.store import Conflict, Projects

    projects = Projects(spark, str(tmp_path))
    store = projects.create("one")
    with pytest.raises(Conflict):
        projects.create("one")
    old = store.manifest()
    projects.rename("one", "First")
    assert store.manifest()["name"] == "First" and store.version == 1
    with pytest.raises(Conflict):
        store.publish(old)  # it started from the version before
    store.files.claim(f"{tmp_path}/one/claims/2")  # and its writer died
    with pytest.raises(Conflict):
        store.publish(store.manifest())
    assert store.publish(store.manifest(), stale_ms=-1) == 2


def test_of_several_entities_of_a_name_the_most_mentioned_wins(spark, tmp_path):
    from graphloom.operators import ingest
    from graphloom.operators.store import Projects

    store = Projects(spark, str(tmp_path)).create("one")
    entity = spark.createDataFrame([("a:ada", "Ada", "A"), ("z:ada", "Ada", "Z")], "id string, name string, label string")
    mentions = spark.createDataFrame([("x#0", "a:ada", 0.9, "Ada"), ("x#1", "z:ada", 0.9, "Ada"), ("x#2", "z:ada", 0.9, "Ada")], "chunk_id string, entity_id string, score double, surface string")
    chunk = spark.createDataFrame([(f"x#{i}", "x", i, "Ada") for i in range(3)], "id string, doc_id string, idx long, text string")
    store.write({"entity": entity, "mentions": mentions, "chunk": chunk, "document": spark.createDataFrame([("x", "Ada")], "id string, content string")})
    store.ingest(spark.createDataFrame([("y", "Here is Ada.")], "id string, content string"), extract=ingest.capital_mentions)
    assert "z:ada" in {r.entity_id for r in store.table("mentions").where("chunk_id like 'y%'").collect()}
