"""Named queries over stores that a query fills from the driver's tables: changing projects, vector index, logs, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import models
from graphloom.catalog import COS, EXPAND_SQL, ORACLE, _query_vector, query, r6
from graphloom.operators import ingest, retrieval
from graphloom.operators.live import LiveProject
from graphloom.operators.score_store import ScoreStore
from graphloom.operators.vector_index import VectorIndex
from graphloom.plans.driver_tables import PRELUDE, Project
from graphloom.session import scratch
from graphloom.streaming.segments import SegmentLog

_NOISE = ", ".join(f"'{w}'" for w in sorted(set(ingest.NOISE)))
#: The driver's project without mentions of words that name nothing; of equal names and labels in a passage one stays.
_CLEAN = PRELUDE.replace("mention_row AS (", "every_mention AS (").replace("FROM raw_mention),", f"""FROM raw_mention WHERE lower(surface) NOT IN ({_NOISE})),
mention_row AS (SELECT chunk_id, doc_id, min(surface) AS surface, label, max(score) AS score FROM every_mention GROUP BY chunk_id, doc_id, label, lower(surface)),""")


def _put(live: LiveProject, document: DataFrame) -> None:
    live.ingest(document.select("id", "title", "source", "status", "tags", "content"), split=ingest.line_passages, embedder=None)


def _changed(p: Project) -> LiveProject:
    """All documents, then each seventh replaced by its first line, then each eleventh deleted."""
    live = LiveProject.create(p.spark, scratch(p.spark, "live"))
    _put(live, p.document)
    number = F.col("id").cast("long")
    _put(live, p.document.where(number % 7 == 0).withColumn("content", F.split_part("content", F.lit("\n"), F.lit(1))))
    live.delete(p.document.where(number % 11 == 0).select("id"))
    return live


CHANGED_SQL = rf"""WITH line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS text, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS idx FROM (
  SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN split_part(text, chr(10), 1) ELSE text END AS t FROM documents WHERE doc_id % 11 <> 0)),
word AS (SELECT doc_id, idx, unnest(regexp_extract_all(text, '[A-Z][a-z]{{2,}}')) AS w FROM line),
named AS (SELECT DISTINCT doc_id, idx, lower(w) AS k FROM word WHERE lower(w) NOT IN ({_NOISE}))
"""


@query("snk05_changed_weights", CHANGED_SQL + "SELECT x.k AS a, y.k AS b, count(*) AS weight FROM named x JOIN named y USING (doc_id, idx) WHERE x.k < y.k GROUP BY 1, 2", False)
def _weights(p: Project) -> DataFrame:
    name = lambda c: F.expr(f"substring({c}, instr({c}, ':') + 1)")
    return _changed(p).table("related").select(F.least(name("a"), name("b")).alias("a"), F.greatest(name("a"), name("b")).alias("b"), "weight")


@query("snk05_changed_documents", CHANGED_SQL + """SELECT doc_id::VARCHAR AS id, count(*) FILTER (text <> '') AS chunks, coalesce(any_value(m), 0)::BIGINT AS mentions FROM line
  LEFT JOIN (SELECT doc_id, count(*) AS m FROM named GROUP BY 1) USING (doc_id) GROUP BY 1""", False)
def _documents(p: Project) -> DataFrame:
    live = _changed(p)
    live.compact()
    t = live.tables()
    chunk = t["chunk"].select(F.col("id").alias("chunk_id"), F.col("doc_id").alias("id"))
    chunks = chunk.groupBy("id").agg(F.count("*").alias("chunks"))
    mentions = t["mentions"].join(chunk, "chunk_id").groupBy("id").agg(F.count("*").alias("mentions"))
    found = t["document"].select("id").join(chunks, "id", "left").join(mentions, "id", "left")
    return found.select("id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("mentions", F.lit(0)).alias("mentions"))


@query("grf02_expand_stored", None)
def _expand_stored(p: Project) -> DataFrame:
    live = LiveProject.create(p.spark, scratch(p.spark, "live"))
    _put(live, p.document)
    seed = retrieval.seeds(live.table("entity"), ["the", "Der"], None)
    return live.expand(seed).select("id", r6(F.col("score"), "score"), "via")


ORACLE["grf02_expand_stored"] = _CLEAN + EXPAND_SQL + "SELECT id, round(score, 6) AS score, via FROM grown"


@query("vec02_knn_ivf", f"SELECT CAST(e.vec_id AS VARCHAR) AS id, round({COS}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {COS} DESC, CAST(e.vec_id AS VARCHAR) LIMIT 50", False)
def _knn_ivf(p: Project) -> DataFrame:
    """Exact search through the stored index: cells that the radius rules out are not read."""
    index = VectorIndex.build(p.vectors, scratch(p.spark, "vectors"))
    return index.search(_query_vector(p), 50, exact=True).select("id", r6(F.col("similarity"), "similarity"))


def _log(p: Project) -> SegmentLog:
    """Events as a log: three appends by time of day, the errors of the first two cleared, the first put aside, the rest as one segment."""
    log = SegmentLog.create(p.spark, scratch(p.spark, "log"))
    events = p.raw("events").select(F.expr("unix_millis(from_utc_timestamp(cast(ts AS timestamp), current_timezone()))").alias("at"), F.lit("api").alias("channel"), F.col("event_type").alias("project"),
                                    F.col("event_id").cast("string").alias("detail"), F.hour("ts").alias("hour"))
    log.append(events.where("hour < 8"))
    log.rotate(most_bytes=0)
    log.append(events.where("hour between 8 and 15"))
    log.clear("error")
    log.append(events.where("hour > 15 or hour is null"))
    log.compact()
    return log


LOG_SQL = """WITH event AS (SELECT epoch_us(ts) // 1000 AS at, event_type AS project, CAST(event_id AS VARCHAR) AS detail, hour(ts) AS hour FROM events
  WHERE event_type IS DISTINCT FROM 'error' OR coalesce(hour(ts), 24) > 15)
"""


@query("snk02_log_last", LOG_SQL + "SELECT e.at, project, detail FROM event e WHERE coalesce(hour, 24) >= 8 ORDER BY e.at DESC NULLS LAST, project NULLS FIRST, detail NULLS FIRST LIMIT 20000", False)
def _log_last(p: Project) -> DataFrame:
    return _log(p).last().select("at", "project", "detail")


@query("snk02_log_records", LOG_SQL + "SELECT project, count(*) AS calls, min(e.at) AS first_at, max(e.at) AS last_at FROM event e GROUP BY 1", False)
def _log_records(p: Project) -> DataFrame:
    return _log(p).records(rotated=True).groupBy("project").agg(F.count("*").alias("calls"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


@query("jn18_known_scores")
def _known_scores(p: Project) -> DataFrame:
    """Scores of all passages for one question; those of the first passages of the documents are known before."""
    store, question = ScoreStore(p.spark, scratch(p.spark, "scores")), "reation oration"
    rerank = store.rerank("1", question, models.reranked(question))
    rerank(p.chunk.where("idx = 0").select("id", "text"))
    return rerank(p.chunk.select("id", "text")).select("id", F.round("rerank", 6).alias("rerank"))
