import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from graphloom import catalog, models
from graphloom.functions import columns as C
from graphloom.operators import console, context, graph, ingest, records, retrieval, store
from graphloom.plans.driver_tables import Project
from graphloom.streaming import logs

SAMPLE = ["agg01_statistics", "agg08_decrement", "agg14_history_totals", "agg15_history_series", "grf02_expand", "kw02_bm25", "qry01_search", "jn12_read_window", "qry14_cypher", "agg18_gaps", "cy14_unwind_range", "cy34_show_tables"]


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in "documents labels pages embeddings events conversations benchmark lineitem orders customer".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(catalog.ORACLE[name])
    df = catalog.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(rel.columns)
    as_row = lambda r: str([round(x, 5) if isinstance(x, float) else x for x in r])
    assert sorted(as_row(r) for r in df.select(*rel.columns).collect()) == sorted(map(as_row, rel.fetchall()))


def test_entry_has_rows_and_every_oracle_has_a_query(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_weights_are_shared_passages_after_a_delete(spark, sf):
    p = Project(spark, sf)
    tables = {"document": p.document, "chunk": p.chunk, "mentions": p.mentions, "entity": p.entity}
    after = ingest.deleted(tables, p.document.where("id < '2'").select("id"))
    assert after["related"].exceptAll(graph.pair_weights(after["mentions"])).count() == 0
    assert graph.orphan_entities(after["entity"], after["mentions"]).count() == 0
    delta = graph.pair_weights(p.mentions).exceptAll(after["related"])
    assert delta.count() > 0


def test_project_store(spark, tmp_path):
    projects = store.Projects(spark, str(tmp_path / "projects"))
    s = projects.create("alpha")
    with pytest.raises(store.Conflict):
        projects.create("alpha")
    with pytest.raises(ValueError):
        projects.create("Bad Id")
    docs = spark.createDataFrame([("a", "Alpha Beta met. Alpha left."), ("b", "Alpha Gamma met Beta.")], "id string, content string")
    assert s.ingest(docs, create=True) == 1
    with pytest.raises(store.Conflict):
        s.ingest(docs.limit(1), create=True)
    assert s.table("document").count() == 2 and s.table("chunk").count() == 2
    n = s.table("related").count()
    s.ingest(spark.createDataFrame([("b", "Nothing Here.")], "id string, content string"))
    assert s.version == 2 and s.table("related").count() < n and s.table("document").count() == 2
    s.patch(spark.createDataFrame([("a", "New")], "id string, title string"))
    assert s.table("document").where("id = 'a'").first().title == "New"
    s.delete(["a"])
    with pytest.raises(store.Missing):
        s.delete(["nope"])
    assert [r.id for r in s.table("document").collect()] == ["b"] and projects.list() == ["alpha"]
    projects.delete("alpha")
    assert projects.list() == []


def test_console_only_reads(spark, sf):
    tables = {"document": Project(spark, sf).document}
    df, more = console.run_sql(spark, tables, "SELECT id FROM document")
    assert not more and df.count() == 200
    for bad in ("DROP TABLE document", "INSERT INTO document SELECT * FROM document", "MATCH (n) DELETE n"):
        with pytest.raises(ValueError):
            console.run_sql(spark, tables, bad)
    assert console.forbidden_word("SELECT 'drop' AS x") is None
    assert "LEFT JOIN" in console.cypher_to_sql("MATCH (c:Chunk) OPTIONAL MATCH (c)-[:MENTIONS]->(e:Entity) RETURN c.id, collect(e.name)")
    assert "UNION ALL" in console.cypher_to_sql("MATCH (a:Entity)-[r:RELATED]-(b:Entity) RETURN a.id AS a, b.id AS b ORDER BY a LIMIT 5")


def test_context_budget():
    a, b, c = "x" * 400, "y" * 400, "z" * 40
    assert context.within_budget([(a, False), (b, False), (c, False)], 120) == [True, False, True]
    assert context.within_budget([(a, True), (a, False), (b, False)], 100) == [True, True, False]
    hits = [{"id": "d#0", "title": "D", "page": 2, "text": "A › B\nBody text.", "entities": ["E"]}, {"id": "d#1", "title": "D", "page": None, "text": "More."}]
    text, sent = context.render(hits, "full", None, {"d#1"})
    assert sent == ["d#0"] and "provided before" in text and "A › B" in text
    assert context.render(hits, "map")[1] == []
    with pytest.raises(ValueError):
        context.render(hits, "other")


def test_near_duplicates_and_leaders(spark):
    rows = [(1, 1, "a", [1.0, 0.0]), (1, 2, "b", [1.0, 0.01]), (1, 3, "c", [0.0, 1.0]), (1, 4, "d", [0.7, 0.7])]
    df = spark.createDataFrame(rows, "query_id int, rank int, id string, embedding array<double>")
    assert [r.id for r in retrieval.without_near_duplicates(df, 2, 0.95).orderBy("place").collect()] == ["a", "c"]
    q = df.selectExpr("'p' project", "rank seq", "embedding")
    assert {r.seq: r.leader for r in records.question_leaders(q, 0.9).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_upper_median_and_empty(spark):
    calls = spark.createDataFrame([(i, d, 1, True) for i, d in enumerate([4, 1, 3, 2])], "at long, duration_ms long, context_tokens long, ok boolean")
    assert records.totals(calls).first().median_ms == 3
    assert records.totals(calls.limit(0)).first().asDict() == {"calls": 0, "tokens": 0, "errors": 0, "median_ms": 0}


def test_columns(spark):
    df = spark.createDataFrame([(" Hello   World?! ", "Cafés", "fig12.PNG", ["b ", "", "B", "a"])], "q string, n string, alt string, tags array<string>")
    r = df.select(C.question_key("q").alias("k"), C.compact_name("n").alias("c"), C.useful_alt(F.col("alt")).alias("a"), C.normal_tags(F.col("tags")).alias("t"),
                  C.slug(F.lit("Été à Paris!")).alias("s"), C.file_title(F.lit("/x/my_file.v2.pdf")).alias("f"), C.collapse_leaders(F.lit("A ..... 3...")).alias("l"),
                  C.join_hyphenated(F.lit("exam-\nple Non-\nFoo")).alias("h"), C.token_estimate(F.lit("éé")).alias("e")).first()
    assert (r.k, r.c, r.a, r.t, r.s, r.f, r.l, r.h, r.e) == ("hello world", "café", None, ["b", "a"], "ete-a-paris", "my file.v2", "A … 3...", "example Non-\nFoo", 1)


def test_folder_changes(spark):
    new = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 3)], "path string, size long, mtime_s long")
    old = spark.createDataFrame([("b", 2, 2), ("c", 3, 3), ("d", 1, 1)], "path string, size long, mtime_s long")
    got = {r.path: r.change for r in records.folder_changes(new, old, spark.createDataFrame([("b",)], "path string")).collect()}
    assert got == {"a": "added", "b": "unchanged", "c": "changed", "d": "removed"}


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "calls")
    rows = spark.createDataFrame([(1_700_000_000_000 + i * 600_000, "api", "p", "search", i % 5 != 0, 10) for i in range(30)], "at long, channel string, project string, operation string, ok boolean, context_tokens long")
    logs.append_log(rows, folder)
    with open(f"{folder}/broken.json", "w") as f:
        f.write("{not json\n")
    assert logs.read_log(spark, folder).count() == 30
    q = logs.hourly(logs.stream_log(spark, folder)).writeStream.outputMode("complete").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    batch = logs.hourly(logs.read_log(spark, folder).withColumn("ts", F.timestamp_millis("at")))
    assert sorted(map(tuple, spark.sql("SELECT * FROM hours").collect())) == sorted(map(tuple, batch.collect()))
    sent = str(tmp_path / "sent")
    spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b"), ("t", "a")], "session string, chunk_id string").write.json(sent)
    fresh = logs.new_passages(spark.readStream.schema("session string, chunk_id string").json(sent))
    # a processing-time timeout asks for batches for ever, so the run is bounded by its input
    q = fresh.writeStream.outputMode("append").format("memory").queryName("fresh").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.sql("SELECT * FROM fresh").collect())) == [("s", "a"), ("s", "b"), ("t", "a")]


def test_models(spark):
    v = models.HashedTerms(64).embed(["a cat sat", "a cat sat", ""])
    assert abs(float(v[0] @ v[1]) - 1) < 1e-5 and float(v[2] @ v[2]) == 0
    assert ("ACME-12", "identifier", 0.9) in models.Patterns().extract(["see ACME-12 now"], [], 0.5)[0]
    assert "Paris" in models.question_entities("Where is Paris?", [])
    chunk = spark.createDataFrame([("d#0", "d", "Paris is big. Mail a@b.org")], "id string, doc_id string, text string")
    assert {r.surface for r in models.extracted(chunk).collect()} >= {"Paris", "a@b.org"}


def test_edges_of_some_entities_are_those_of_all(spark):
    rows = [("c1", "a"), ("c1", "b"), ("c1", "c"), ("c1", "a"), ("c2", "a"), ("c2", "b"), ("c3", "b"), ("c3", "d"), (None, "a"), (None, "b"), ("c2", None)]
    mentions = spark.createDataFrame(rows, "chunk_id string, entity_id string")
    some = spark.createDataFrame([("a",), ("c",), ("a",), ("z",)], "id string")
    want = graph.both_ways(graph.pair_weights(mentions)).where("x in ('a', 'c')")
    assert sorted(map(tuple, graph.edges_of(mentions, some).collect())) == sorted(map(tuple, want.collect())) != []
