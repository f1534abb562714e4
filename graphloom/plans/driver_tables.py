"""The driver's tables as a project: documents to passages, mentions, entities and relations."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph, ingest
from graphloom.session import scratch


class Project:
    """Logical tables over one data folder, each built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._raw = spark, sf_dir, {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:  # finding a table's schema is a job of its own
            self._raw[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._raw[name]

    @cached_property
    def document(self) -> DataFrame:
        """Documents; a label of quality 0 makes a draft; tags are language and source."""
        quality = self.raw("labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        docs = self.raw("documents").join(quality, "doc_id", "left")
        title = F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 60)
        return docs.select(F.col("doc_id").cast("string").alias("id"), title.alias("title"), "source",
                           F.when(F.col("quality") == 0, "DRAFT").otherwise("PUBLISHED").alias("status"),
                           F.array("lang", "source").alias("tags"), F.col("doc_id").alias("updated_at"), F.col("text").alias("content"))

    @cached_property
    def chunk(self) -> DataFrame:
        """A passage a line; three a page; src0 has no pages. Lines come from the documents alone: no join, no shuffle of text."""
        docs = self.raw("documents").select(F.col("doc_id").cast("string").alias("id"), "source", F.col("text").alias("content"))
        page = F.when(F.col("source") == "src0", 0).otherwise(F.floor(F.col("idx") / 3) + 1).cast("long")
        return ingest.line_passages(docs, ("source",)).select("id", "doc_id", "idx", "text", page.alias("page"))

    @cached_property
    def raw_mentions(self) -> DataFrame:
        return ingest.capital_mentions(self.chunk)

    def with_stored_mentions(self) -> Project:
        """This project with mentions written aside once: for queries that make several tables of them."""
        mentions, entity = ingest.canonical(self.raw_mentions, aside=scratch(self.spark, "mentions"))
        self.__dict__ |= {"mentions": mentions, "entity": entity}
        return self

    @cached_property
    def mentions(self) -> DataFrame:
        return ingest.canonical(self.raw_mentions)[0]

    @cached_property
    def entity(self) -> DataFrame:
        return ingest.canonical(self.raw_mentions)[1]

    @cached_property
    def related(self) -> DataFrame:
        return graph.pair_weights(self.mentions)

    @cached_property
    def counts(self) -> DataFrame:
        return graph.mention_counts(self.mentions, self.chunk, self.document)

    @cached_property
    def calls(self) -> DataFrame:
        """The event stream as a call log; `at` in milliseconds."""
        e = self.raw("events")
        return e.select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("at"), F.col("event_type").alias("operation"),
                        F.element_at(F.array(F.lit("ui"), F.lit("api"), F.lit("mcp")), (F.col("user_id") % 3 + 1).cast("int")).alias("channel"),
                        F.when(F.col("user_id") % 2 == 0, "alpha").otherwise("beta").alias("project"),
                        F.floor("value").cast("long").alias("duration_ms"), (F.floor("value") * 4).cast("long").alias("context_chars"),
                        F.floor("value").cast("long").alias("context_tokens"), (F.col("event_type") != "error").alias("ok"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")

    @cached_property
    def passages(self) -> DataFrame:
        """First lines of documents that have a vector; cut from the text, other lines never become rows."""
        lines = self.raw("documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("text"), "source")
        page = F.when(F.col("source") == "src0", 0).otherwise(1).cast("long")
        first = lines.where("text <> ''").select(F.concat("doc_id", F.lit("#0")).alias("id"), "doc_id", "text", F.lit(0).cast("long").alias("idx"), page.alias("page"))
        return first.join(self.raw("embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), "embedding"), "doc_id")


#: The same tables in SQL, to be followed by a final query.
PRELUDE = r"""
WITH RECURSIVE document AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, substr(split_part(d.text, chr(10), 1), 1, 60) AS title, d.source,
    CASE WHEN q.quality = 0 THEN 'DRAFT' ELSE 'PUBLISHED' END AS status, [d.lang, d.source] AS tags, d.doc_id AS updated_at, d.text AS content
  FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) q USING (doc_id)),
line AS (
  SELECT id AS doc_id, source, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS idx FROM document),
chunk AS (
  SELECT doc_id || '#' || idx AS id, doc_id, CAST(idx AS BIGINT) AS idx, text,
    CAST(CASE WHEN source = 'src0' THEN 0 ELSE idx // 3 + 1 END AS BIGINT) AS page FROM line WHERE text <> ''),
word AS (
  SELECT id AS chunk_id, doc_id, regexp_extract_all(text, '[A-Z][a-z]{2,}') AS w FROM chunk),
raw_mention AS (
  SELECT chunk_id, doc_id, unnest(w) AS surface, generate_subscripts(w, 1) AS pos FROM word),
mention_row AS (
  SELECT chunk_id, doc_id, surface, CASE WHEN pos = 1 THEN 'HEAD' ELSE 'BODY' END AS label, least(1.0, 0.5 + length(surface) / 40.0)::DOUBLE AS score FROM raw_mention),
tally AS (SELECT lower(surface) AS key, label, count(*) AS n, round(sum(score), 6) AS s FROM mention_row GROUP BY 1, 2),
vote AS (SELECT key, label FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, s DESC, label) AS r FROM tally) WHERE r = 1),
placed AS (
  SELECT m.chunk_id, m.surface, m.score, v.label, lower(v.label) || ':' || v.key AS entity_id FROM mention_row m JOIN vote v ON v.key = lower(m.surface)),
mentions AS (SELECT chunk_id, entity_id, max(score) AS score, min(surface) AS surface FROM placed GROUP BY 1, 2),
entity AS (SELECT entity_id AS id, min(surface) AS name, min(label) AS label FROM placed GROUP BY 1),
related AS (
  SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS weight FROM mentions x JOIN mentions y ON x.chunk_id = y.chunk_id AND x.entity_id < y.entity_id GROUP BY 1, 2),
counts AS (
  SELECT m.entity_id, count(*) AS total, count(*) FILTER (WHERE d.status = 'PUBLISHED') AS published
  FROM mentions m JOIN chunk c ON c.id = m.chunk_id JOIN document d ON d.id = c.doc_id GROUP BY 1),
both_ways AS (SELECT a AS x, b AS y, weight FROM related UNION ALL SELECT b, a, weight FROM related),
calls AS (
  SELECT event_id, epoch_us(ts) // 1000 AS at, event_type AS operation, ['ui', 'api', 'mcp'][user_id % 3 + 1] AS channel,
    CASE WHEN user_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS project, CAST(floor(value) AS BIGINT) AS duration_ms,
    CAST(floor(value) * 4 AS BIGINT) AS context_chars, CAST(floor(value) AS BIGINT) AS context_tokens, event_type <> 'error' AS ok FROM events),
passages AS (
  SELECT c.id, c.doc_id, c.text, c.idx, c.page, e.embedding FROM chunk c JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = c.doc_id WHERE c.idx = 0)
"""
