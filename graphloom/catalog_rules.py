"""More named queries: library operators that `catalog` reaches only in part, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.catalog import COS, EXPAND_SQL, FEEDBACK_SQL, HYBRID_SQL, NEAR_COPIES_STAY, TERMS, _feedback, _query_vector, query, r6
from graphloom.functions import columns as C
from graphloom.operators import console, context, graph, ingest, records, retrieval
from graphloom.plans.driver_tables import Project
from graphloom.sources import documents
from graphloom.streaming import logs


def pick(index, *values: str):
    """One of a few texts by a column of numbers from 0."""
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def natural_places(names: DataFrame) -> DataFrame:
    """The first 400 names in natural order with their places."""
    first = names.withColumn("key", C.natural_key(F.col("name"))).orderBy("key", "name").limit(400)
    return first.select("name", F.row_number().over(Window.orderBy("key", "name")).alias("place"))


# console

query("cy34_show_tables", """SELECT 'chunk' AS name, 'node' AS kind, count(*) AS n FROM chunk UNION ALL SELECT 'document', 'node', count(*) FROM document
UNION ALL SELECT 'mentions', 'relation', count(*) FROM mentions UNION ALL SELECT 'related', 'relation', count(*) FROM related""")(
    lambda p: console.table_sizes(p.spark, {"document": p.document, "chunk": p.chunk, "mentions": p.mentions, "related": p.related}))
query("cy40_parameters", "SELECT id FROM document WHERE source = 'src1' AND updated_at >= 100")(
    lambda p: console.whole_result(p.spark, {"document": p.document}, "SELECT id FROM document WHERE source = :s AND updated_at >= :n", {"s": "src1", "n": 100}))

# sources

query("src09_useful_alt", r"SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 5 THEN p_name || ' ' || p_brand END AS alt FROM part", False)(
    lambda p: p.raw("part").select("p_partkey", C.useful_alt(F.concat(F.when(F.col("p_partkey") % 6 == 2, F.lit("Image ")).when(F.col("p_partkey") % 6 == 4, F.lit("  ")).otherwise(F.lit("")), F.when(
        F.col("p_partkey") % 6 == 2, F.col("p_partkey").cast("string")).when(F.col("p_partkey") % 6 == 4, F.lit("")).otherwise(F.col("p_name")), pick(
        F.col("p_partkey") % 6, "", " (description automatically generated)", "", ".PNG", "", ""), F.when(F.col("p_partkey") % 6 == 5, F.concat(F.lit("\n "), "p_brand")).otherwise(F.lit("")))).alias("alt")))
query("src17_resolved_links", r"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN root || '/a/c.html' WHEN 1 THEN scheme || '://cdn.example.org/x.png' WHEN 2 THEN NULL
  WHEN 3 THEN root || regexp_replace(path, '[^/]*$', '') || 'next.html' WHEN 4 THEN 'https://other.example.org/z' END AS link FROM (
  SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)""", False)(
    lambda p: p.raw("pages").select("page_id", documents.resolved_links(F.col("url"), pick(
        F.col("page_id") % 5, "/a/b/.././c.html#part", "//cdn.example.org/x.png", "mailto:someone@example.org", "next.html", "https://other.example.org/z#end")).alias("link")))
query("src21_tags", "SELECT doc_id, lang || '|' || source AS tags FROM documents", False)(
    lambda p: p.raw("documents").select("doc_id", F.array_join(documents.parse_tags(F.when(F.col("doc_id") % 2 == 0, F.to_json(F.array("lang", "source"))).otherwise(
        F.concat("lang", F.lit(" , ,"), "source", F.lit(",")))), "|").alias("tags")))
query("src22_base64", "SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN md5(text) END AS md5 FROM documents", False)(
    lambda p: documents.from_base64(p.raw("documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.lit("no base64!")).otherwise(F.base64(F.col("text").cast("binary"))).alias("data"))).select(
        "doc_id", F.md5("content").alias("md5")))
FNV_SQL = """lower(lpad(to_hex((list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i, 1))::UHUGEINT)),
  lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT))::UBIGINT), 16, '0'))"""
query("snk04_stored_names", f"SELECT c_custkey, {FNV_SQL} || '.pdf' AS file FROM (SELECT c_custkey, c_name AS name FROM customer)", False)(
    lambda p: p.raw("customer").select("c_custkey", documents.stored_names(F.col("c_name"), "pdf").alias("file")))
query("snk07_json_lines", "SELECT CAST(json_object('n_nationkey', n_nationkey, 'n_name', n_name) AS VARCHAR) AS json FROM nation", False)(
    lambda p: documents.to_json_lines(p.raw("nation").select("n_nationkey", "n_name")))

# filters and scalar rules

NOISE_SQL = ", ".join(f"'{w}'" for w in ingest.NOISE)
query("flt07_cleaned_mentions", f"""SELECT chunk_id, doc_id, label, min(surface) AS surface, round(max(score), 6) AS score FROM mention_row
  WHERE score >= 0.58 AND lower(surface) NOT IN ({NOISE_SQL}) GROUP BY chunk_id, doc_id, label, lower(surface)""")(
    lambda p: ingest.cleaned(p.raw_mentions, 0.58).select("chunk_id", "doc_id", "label", "surface", r6(F.col("score"), "score")))
query("flt08_clean_names", r"""SELECT id, CASE WHEN length(regexp_replace(c, '[^\p{L}\p{N}]', '', 'g')) >= 2 THEN c END AS name FROM (
  SELECT id, CASE WHEN contains(b, '(') AND NOT contains(b, ')') THEN b || ')' ELSE b END AS c FROM (
  SELECT id, regexp_replace(regexp_replace(trim(regexp_replace(CASE updated_at % 3 WHEN 0 THEN '« ' || title || ' »' WHEN 1 THEN title || '  (draft)' ELSE '-' || left(title, 1) END, '\s+', ' ', 'g')),
    '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', '') AS b FROM document))""")(
    lambda p: p.document.select("id", C.clean_name(F.when(F.col("updated_at") % 3 == 0, F.concat(F.lit("« "), "title", F.lit(" »"))).when(
        F.col("updated_at") % 3 == 1, F.concat("title", F.lit("  (draft)"))).otherwise(F.concat(F.lit("-"), F.left("title", F.lit(1))))).alias("name")))
query("sc24_job_percent", """SELECT l_orderkey, l_linenumber, CAST(round(low + share * (high - low)) AS INTEGER) AS percent FROM (SELECT l_orderkey, l_linenumber, least(l_quantity / total, 1.0::DOUBLE) AS share,
  [0, 0, 5, 8, 45, 90, 100][l_linenumber] AS low, [0, 5, 8, 45, 90, 99, 100][l_linenumber] AS high FROM (SELECT *, 10 + l_partkey % 40 AS total FROM lineitem))""", False)(
    lambda p: p.raw("lineitem").select("l_orderkey", "l_linenumber", C.job_percent(
        pick(F.col("l_linenumber") - 1, "queued", "extracting", "chunking", "embedding", "entities", "writing", "done"), F.col("l_quantity"), 10 + F.col("l_partkey") % 40).alias("percent")))
query("sc29_age_groups", """SELECT event_id, CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN 'week' WHEN d < 30 THEN 'month' ELSE 'older' END AS age
  FROM (SELECT event_id, date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS d FROM events)""", False)(
    lambda p: p.raw("events").select("event_id", C.age_group(F.to_date("ts"), F.to_date(F.lit("2024-01-31"))).alias("age")))
query("sc30_file_titles", r"SELECT p_partkey, p_name AS title FROM part", False)(
    lambda p: p.raw("part").select("p_partkey", C.file_title(F.concat(F.lit("in/v1.2/_"), F.translate("p_name", " ", "_"), F.lit("_.final.pdf"))).alias("full")).select(
        "p_partkey", F.regexp_replace("full", r"[ .]*final$", "").alias("title")))
query("sc33_clip_bytes", "SELECT id, CASE WHEN strlen(t) > 40 THEN left(t, list_max(list_filter(range(0, 41), lambda i: strlen(left(t, i)) <= 40))) || '…' ELSE t END AS short FROM (SELECT id, 'é' || text AS t FROM chunk)")(
    lambda p: p.chunk.select("id", C.clip_bytes(F.concat(F.lit("é"), "text"), 40).alias("short")))
query("sc34_image_types", "SELECT event_id, ['png', 'jpg', 'gif', 'webp', NULL, NULL][event_id % 6 + 1] AS kind FROM events", False)(
    lambda p: p.raw("events").select("event_id", C.image_type(F.unhex(pick(
        F.col("event_id") % 6, "89504E470D0A1A0A0000000D", "FFD8FFE000104A464946", "474946383961010001", "524946461A00000057454250", "524946461A00000057415645", "3C737667")).cast("binary")).alias("kind")))
query("win09_natural_order", "SELECT name, row_number() OVER (ORDER BY p_partkey, name) AS place FROM (SELECT p_partkey, 'REQ-' || p_partkey AS name FROM part UNION ALL SELECT p_partkey, 'REQ-' || p_partkey || 'b' FROM part WHERE p_partkey % 5 = 0) ORDER BY place LIMIT 400", False)(
    lambda p: natural_places(p.raw("part").select(F.concat(F.lit("REQ-"), "p_partkey").alias("name")).unionByName(
        p.raw("part").where("p_partkey % 5 = 0").select(F.concat(F.lit("REQ-"), "p_partkey", F.lit("b")).alias("name")))))

# joins, limits, ordered operators

query("jn11_images", """, img AS (SELECT 'img' || id AS image_id, doc_id, n, file FROM (SELECT id, id AS doc_id, updated_at AS n, substr(md5(source || tags[1]), 1, 16) AS file FROM document))
SELECT id, file, doc_id, n FROM (SELECT c.id, i.file, c.doc_id, c.idx, i.n, row_number() OVER (PARTITION BY i.file ORDER BY c.doc_id, c.idx, i.n) AS r FROM chunk c JOIN img i ON i.doc_id = c.doc_id WHERE c.idx < 2)
WHERE r = 1 ORDER BY doc_id, idx, n LIMIT 24""")(lambda p: graph.images_of(
    p.chunk, p.chunk.where("idx < 2").select(F.col("id").alias("chunk_id"), F.concat(F.lit("img"), "doc_id").alias("image_id")),
    p.document.select(F.concat(F.lit("img"), "id").alias("id"), F.substring(F.md5(F.concat("source", F.get("tags", F.lit(0)))), 1, 16).alias("file"), F.lit("").alias("caption"), F.col("updated_at").alias("n"))
).select(F.col("chunk_id").alias("id"), "file", "doc_id", "n"))
query("jn15_proposals", FEEDBACK_SQL + """SELECT qkey, CAST(conv_id AS VARCHAR) AS doc, n FROM (SELECT qkey, arg_max(conv_id, at_ms) AS conv_id, arg_max(outcome, at_ms) AS outcome, count(*) AS n FROM
  (SELECT qkey, at_ms, conv_id, ['answered', 'partial', 'not_found'][conv_id % 3 + 1] AS outcome FROM talk WHERE turn < 2) GROUP BY 1) l
  WHERE outcome = 'answered' AND qkey NOT IN (SELECT qkey FROM talk WHERE conv_id % 10 = 0) AND qkey NOT IN (SELECT qkey FROM talk WHERE conv_id % 7 = 1)
  AND EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.conv_id AND split_part(d.text, chr(10), 1) <> '')""", False)(
    lambda p: (lambda log, talk: records.proposals(log, p.chunk, talk.where("conv_id % 10 = 0").select("qkey"), talk.where("conv_id % 7 = 1").select("qkey")).select("qkey", "doc", "n"))(
        _feedback(p), p.raw("conversations").where("role = 'user'").select("conv_id", C.question_key(F.col("text")).alias("qkey"))))
query("jn17_unknown_chunks", "SELECT DISTINCT l_orderkey || '#' || l_linenumber AS id FROM lineitem WHERE l_orderkey || '#' || l_linenumber NOT IN (SELECT id FROM chunk)")(
    lambda p: records.unknown_chunks(p.raw("lineitem").select(F.concat("l_orderkey", F.lit("#"), "l_linenumber").alias("id")).distinct(), p.chunk))
query("grf07_thinned", """, cut AS (SELECT greatest(2, weight) AS w FROM related ORDER BY weight DESC, a, b LIMIT 1 OFFSET 300)
SELECT a, b, weight FROM related WHERE (SELECT count(*) FROM related) <= 400 OR weight >= (SELECT w FROM cut)""")(lambda p: graph.thinned(p.related, 100))
query("top12_gap_cards", """SELECT o_orderkey AS id, o_orderkey % 4 AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey % 4 IN (1, 2)
  ORDER BY o_orderkey % 4 DESC, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, o_orderkey LIMIT 300""", False)(
    lambda p: records.gap_cards(p.raw("orders").select(F.col("o_orderkey").alias("id"), pick(F.col("o_orderkey") % 4, "compliant", "partial", "non_compliant", "not_verifiable").alias("status"),
                                F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "major").when(F.col("o_orderpriority") == "3-MEDIUM", "minor").alias("severity"),
                                F.col("o_orderpriority").alias("priority"))).limit(300).select("id", F.when(F.col("status") == "partial", F.lit(1)).otherwise(2).cast("long").alias("status"), "priority"))
SENTENCES_SQL = r""", part AS (SELECT id, trim(regexp_replace(s, '\s+', ' ', 'g')) AS s, i FROM (SELECT id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (
  SELECT id, string_split(regexp_replace(text, '([.!?…;])\s', '\1' || chr(1), 'g'), chr(1)) AS x FROM chunk))),
long_enough AS (SELECT *, right(s, 1) IN ('.', '!', '?', '…', ';') AS ended FROM part WHERE length(regexp_replace(s, '[^\p{L}]', '', 'g')) >= 15),
shown AS (SELECT * FROM long_enough l WHERE ended OR NOT EXISTS (SELECT 1 FROM long_enough o WHERE o.id = l.id AND o.ended) QUALIFY row_number() OVER (PARTITION BY id ORDER BY i) <= 14)
"""
query("vec04_closest_sentences", SENTENCES_SQL + "SELECT id, arg_max(s, (length(s), -i)) AS sentence FROM shown GROUP BY 1")(
    lambda p: context.closest_sentences(p.chunk, [1.0, 0.0], lambda c: F.array(F.char_length(c).cast("double"), F.lit(1.0))))
query("str04_sessions", """SELECT DISTINCT 'u' || user_id AS session, event_type AS chunk_id FROM events WHERE user_id IN (
  SELECT user_id FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) WHERE last > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 48 HOUR ORDER BY last DESC, 'u' || user_id LIMIT 40)""", False)(
    lambda p: logs.session_ids(p.raw("events").select(F.concat(F.lit("u"), "user_id").alias("session"), F.col("event_type").alias("chunk_id"), "ts"),
                               F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00")), 48, 40))
query("qry22_answer_sources", """, cited AS (SELECT id AS answer_id, CASE WHEN updated_at % 2 = 0 THEN [id || '#1', id || '#0', CAST(updated_at + 1 AS VARCHAR) || '#0', id || '#1'] ELSE [id || '#0'] END AS ids FROM document),
each AS (SELECT answer_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS place FROM cited), once AS (SELECT answer_id, id, min(place) AS place FROM each GROUP BY 1, 2)
SELECT o.answer_id, c.doc_id, array_to_string(list(o.id ORDER BY o.place), ',') AS passages FROM once o JOIN chunk c ON c.id = o.id GROUP BY 1, 2""")(
    lambda p: records.answer_sources(p.document.select(
        F.col("id").alias("answer_id"), F.when(F.col("updated_at") % 2 == 0, F.array(F.concat("id", F.lit("#1")), F.concat("id", F.lit("#0")), F.concat(F.col("updated_at") + 1, F.lit("#0")), F.concat("id", F.lit("#1")))).alias("cited"),
        F.array(F.concat("id", F.lit("#0"))).alias("read")), p.chunk, p.document).select("answer_id", "doc_id", F.array_join("passages", ",").alias("passages")))

# retrieval

named_vectors = lambda p: p.vectors.select(F.col("id").cast("string").alias("id"), F.concat(F.lit("Name "), "id").alias("name"), "embedding")
query("top02_entity_seeds", f"""WITH near AS (SELECT CAST(e.vec_id AS VARCHAR) AS id, {COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY s DESC, id LIMIT 10)
SELECT '5' AS id, 1.0::DOUBLE AS score, 'query' AS via UNION ALL SELECT id, round(s, 6), 'vector' FROM near WHERE 1 - s <= 0.72 AND id <> '5'""", False)(
    lambda p: retrieval.seeds(named_vectors(p), ["NAME 5"], _query_vector(p), 0.72).select("id", r6(F.col("score"), "score"), "via"))
query("top04_graph_passages", """SELECT m.chunk_id AS id, sum(length(e.name))::DOUBLE AS graph FROM mentions m JOIN entity e ON e.id = m.entity_id JOIN chunk c ON c.id = m.chunk_id
  JOIN document d ON d.id = c.doc_id WHERE e.label = 'HEAD' AND d.status = 'PUBLISHED' GROUP BY 1 ORDER BY graph DESC, 1 LIMIT 20""")(
    lambda p: retrieval.graph_candidates(p.entity.where("label = 'HEAD'").select("id", F.char_length("name").cast("double").alias("score")), p.mentions, p.chunk, p.document, 10, graph.visible()))
query("flt04_min_score", f"""WITH sim AS (SELECT e.vec_id AS id, {COS} AS s, e.vec_id % 3 + 1 AS src, CASE WHEN e.vec_id % 5 = 0 THEN e.vec_id % 11 + 1 END AS g, CASE WHEN e.vec_id % 7 = 0 THEN e.vec_id % 13 + 1 END AS k
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
SELECT id, round(s + w + 0.05 * coalesce(g / top_g, 0), 6) AS score, src = 2 AS via_graph, src = 3 AS via_keywords FROM (SELECT *, 0.04 * coalesce(k / (SELECT max(k) FROM sim), 0) AS w, (SELECT max(g) FROM sim) AS top_g FROM sim)
WHERE s + w >= 0.05""", False)(
    lambda p: retrieval.fused(p.vectors.select(
        "id", C.cosine(F.col("embedding"), C.vector(_query_vector(p))).alias("similarity"), (F.col("id") % 3 + 1).alias("source"), F.when(F.col("id") % 5 == 0, F.col("id") % 11 + 1.0).alias("graph"),
        F.when(F.col("id") % 7 == 0, F.col("id") % 13 + 1.0).alias("bm25"), F.lit(11.0).alias("graph_max"), F.lit(13.0).alias("bm25_max")), 0.05).select("id", r6(F.col("score"), "score"), "via_graph", "via_keywords"))
query("kw01_index_changes", r"""SELECT id AS chunk_id, term, count(*) AS tf FROM (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda t: length(t) >= 2)) AS term
  FROM chunk WHERE doc_id < '7') GROUP BY 1, 2""")(
    lambda p: retrieval.KeywordIndex.build(p.chunk.where("doc_id < '5'"), retrieval.simple_terms).with_passages(p.chunk.where("doc_id >= '4'"), retrieval.simple_terms)
    .without(p.chunk.where("doc_id >= '7'").select(F.col("id").alias("chunk_id"))).tf)
GRAPH_SEARCH_SQL = EXPAND_SQL + (", " + HYBRID_SQL.lstrip().removeprefix(",")).replace(
    "cand AS (SELECT id, min(src) AS src FROM (SELECT id, 1 AS src FROM vec UNION ALL", """gr AS (SELECT m.chunk_id AS id, round(sum(g.score), 9) AS g FROM mentions m JOIN grown g ON g.id = m.entity_id JOIN passages p ON p.id = m.chunk_id
  JOIN document d ON d.id = p.doc_id WHERE d.status = 'PUBLISHED' GROUP BY 1 ORDER BY round(sum(g.score), 9) DESC, 1 LIMIT 16), gr_max AS (SELECT max(g) AS top FROM gr),
cand AS (SELECT id, min(src) AS src FROM (SELECT id, 1 AS src FROM vec UNION ALL SELECT id, 2 FROM gr UNION ALL""")
JUDGED = """ FROM (SELECT c.id, c.src, sim.s, 0.04 * coalesce(kw.k / (SELECT top FROM kw_max), 0) AS word, 0.05 * coalesce(gr.g / (SELECT top FROM gr_max), 0) AS edge, p.text
  FROM cand c JOIN sim USING (id) JOIN passages p USING (id) JOIN document d ON d.id = sim.doc_id LEFT JOIN kw USING (id) LEFT JOIN gr USING (id) WHERE d.status = 'PUBLISHED') WHERE s + word >= 0.05"""
GRAPH_SEARCH_SQL = GRAPH_SEARCH_SQL[:GRAPH_SEARCH_SQL.rindex("SELECT row_number()")]


def graph_search(p: Project, rerank=None) -> DataFrame:
    p.with_stored_mentions()
    tables = {"chunk": p.passages, "document": p.document, "entity": p.entity, "mentions": p.mentions}
    return retrieval.search(tables, _query_vector(p), TERMS, ["the", "der"], k=8, min_score=0.05, rerank=rerank, analyser=retrieval.simple_terms, settings=NEAR_COPIES_STAY)


query("qry01_search_fused", GRAPH_SEARCH_SQL + "SELECT row_number() OVER (ORDER BY s + edge + word DESC, id) AS rank, id, round(s + edge + word, 6) AS score, src = 2 AS via_graph, src = 3 AS via_keywords" + JUDGED + " ORDER BY 1 LIMIT 8")(
    lambda p: graph_search(p).select("rank", "id", r6(F.col("score"), "score"), "via_graph", "via_keywords"))
query("top06_rerank_pool", GRAPH_SEARCH_SQL + "SELECT row_number() OVER (ORDER BY length(text) DESC, id) AS rank, id FROM (SELECT id, text" + JUDGED + " ORDER BY s + edge + word DESC, id LIMIT 16) ORDER BY 1 LIMIT 8")(
    lambda p: graph_search(p, lambda found: found.withColumn("rerank", F.char_length("text").cast("double"))).select("rank", "id"))

# whole queries

query("qry08_resolve_compact", r"SELECT id, name, 2 AS rank FROM entity JOIN counts ON entity_id = id WHERE regexp_replace(lower(name), '[^\p{L}\p{N}]', '', 'g') = 'the' ORDER BY total DESC, id LIMIT 1")(
    lambda p: graph.resolve(p.entity, p.counts, "T-h-e-s").select("id", "name", "rank"))
query("qry08_resolve_part", "SELECT id, name, 3 AS rank FROM entity JOIN counts ON entity_id = id WHERE contains(lower(name), 'he') ORDER BY total DESC, id LIMIT 1")(
    lambda p: graph.resolve(p.entity, p.counts, "HE").select("id", "name", "rank"))


@query("qry07_entity_detail", """, top AS (SELECT entity_id AS id FROM counts ORDER BY total DESC, entity_id LIMIT 1),
own AS (SELECT c.* FROM chunk c JOIN mentions m ON m.chunk_id = c.id WHERE m.entity_id = (SELECT id FROM top))
(SELECT 'neighbour' AS part, y AS id, weight AS n FROM both_ways WHERE x = (SELECT id FROM top) ORDER BY weight DESC, y LIMIT 50)
UNION ALL SELECT 'document', doc_id, count(*) FROM own GROUP BY 2
UNION ALL (SELECT 'passage', id, idx FROM own ORDER BY doc_id, idx LIMIT 50)
UNION ALL SELECT 'entity', id, 1 FROM entity WHERE id = (SELECT id FROM top)""")
def _detail(p: Project) -> DataFrame:
    top = p.counts.orderBy(F.desc("total"), "entity_id").first().entity_id
    found = graph.entity_detail({"document": p.document, "chunk": p.chunk, "entity": p.entity, "mentions": p.mentions, "related": p.related}, top)
    part = lambda name, kind, n: found[name].select(F.lit(kind).alias("part"), F.col("doc_id" if kind == "document" else "id").alias("id"), n.cast("long").alias("n"))
    return (part("neighbours", "neighbour", F.col("weight")).unionByName(part("documents", "document", F.col("passages")))
            .unionByName(part("passages", "passage", F.col("idx"))).unionByName(part("entity", "entity", F.lit(1))))
