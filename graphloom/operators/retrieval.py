"""Retrieval: BM25, nearest neighbours, graph expansion, fusion, near-duplicate removal."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.config import DEFAULTS, Settings
from graphloom.functions.stem import stemmed_terms
from graphloom.functions.columns import bm25, cosine, vector
from graphloom.operators.graph import both_ways, edges_of
from graphloom.session import scratch


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(high, n))


def simple_terms(c) -> Column:
    """Lower-case words of two characters at least, split where neither letter, digit nor underscore stands."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda t: F.char_length(t) >= 2)


def postings(chunk: DataFrame, terms=simple_terms, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunk_id, term, tf) and (chunk_id, length); `only`: postings of these terms alone, filtered before they are rows,
    with the passage's length, so that a search of them needs no join to find it. An analyser in Python (it has `among`)
    reads each passage once: lengths and wanted terms are written aside, for statistics and hits."""
    if only is not None and hasattr(terms, "among"):
        at = scratch(chunk.sparkSession, "terms")
        chunk.select(F.col("id").alias("chunk_id"), terms.among(F.col("text"), only).alias("found")).select("chunk_id", "found.*").write.parquet(at)
        analysed = chunk.sparkSession.read.parquet(at)
        tf = analysed.select("chunk_id", "length", F.explode("terms").alias("term")).groupBy("chunk_id", "term", "length").agg(F.count("*").alias("tf"))
        return tf, analysed.select("chunk_id", "length")
    analysed = chunk.select(F.col("id").alias("chunk_id"), terms(F.col("text")).alias("terms"))
    wanted = "terms" if only is None else F.filter("terms", lambda t: t.isin(*dict.fromkeys(only)))
    length = F.size("terms").cast("long").alias("length")
    keys = ["chunk_id", "term"] if only is None else ["chunk_id", "term", "length"]
    tf = analysed.select("chunk_id", length, F.explode(wanted).alias("term")).groupBy(*keys).agg(F.count("*").alias("tf"))
    return tf, analysed.select("chunk_id", length)


class KeywordIndex:
    """Postings and lengths as tables: what documents add or take away, never built anew as a whole."""

    def __init__(self, tf: DataFrame, lengths: DataFrame):
        self.tf, self.lengths = tf, lengths

    @classmethod
    def build(cls, chunk: DataFrame, analyser=stemmed_terms) -> KeywordIndex:
        return cls(*postings(chunk, analyser))

    def without(self, chunk_ids: DataFrame) -> KeywordIndex:
        """Without the passages of chunk_ids(chunk_id)."""
        return KeywordIndex(*(t.join(chunk_ids.select("chunk_id"), "chunk_id", "left_anti") for t in (self.tf, self.lengths)))

    def with_passages(self, chunk: DataFrame, analyser=stemmed_terms) -> KeywordIndex:
        """Passages added, or put in the place of those of their ids."""
        kept, new = self.without(chunk.select(F.col("id").alias("chunk_id"))), postings(chunk, analyser)
        return KeywordIndex(kept.tf.unionByName(new[0]), kept.lengths.unionByName(new[1]))

    def write(self, path: str) -> None:
        """Sorted by term within files, so that a search of a few terms skips most row groups."""
        self.tf.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")

    @classmethod
    def read(cls, spark, path: str) -> KeywordIndex:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))


def bm25_search(tf: DataFrame, lengths: DataFrame, terms: list[str], limit: int, settings: Settings = DEFAULTS) -> DataFrame:
    """(chunk_id, score) of the best passages for the terms; statistics cover all passages, drafts too."""
    stats = lengths.agg(F.count("*").cast("double").alias("n"), F.avg("length").alias("mean"))
    hits = tf.where(F.col("term").isin(*dict.fromkeys(terms)))  # reaches the scan of stored postings; terms are few
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    # statistics are one row; document frequencies are one row a query term
    placed = hits if "length" in tf.columns else hits.join(lengths, "chunk_id")
    scored = placed.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    each = bm25(F.col("tf"), F.col("length"), F.col("df"), F.col("n"), F.col("mean"), settings.k1, settings.b)
    return scored.groupBy("chunk_id").agg(F.sum(each).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(limit)


def nearest(vectors: DataFrame, query: list[float], limit: int, where: Column | None = None) -> DataFrame:
    """(id, similarity) of the nearest vectors(id, embedding): exact scores, then a top-k of partial top-ks."""
    found = vectors if where is None else vectors.where(where)
    q = vector(query)
    return found.select("id", cosine(F.col("embedding"), q).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(limit)


def vector_candidates(chunk: DataFrame, document: DataFrame, query: list[float], k: int, seen: Column) -> DataFrame:
    """A pool of clamp(8 k, 40, 400) nearest passages, then the visible ones, then max(2 k, 10)."""
    q = vector(query)
    scored = chunk.select("id", "doc_id", cosine(F.col("embedding"), q).alias("similarity"))  # one reading: the document comes along
    pool = scored.orderBy(F.desc("similarity"), "id").limit(clamp(8 * k, 40, 400))
    docs = document.where(seen).select(F.col("id").alias("doc_id"))
    return (pool.join(docs, "doc_id", "left_semi")
            .select("id", "similarity").orderBy(F.desc("similarity"), "id").limit(max(2 * k, 10)))


def seeds(entity: DataFrame, names: list[str], query: list[float] | None, distance: float = DEFAULTS.seed_distance) -> DataFrame:
    """(id, score, via): entities named in the question (score 1) and the ten nearest within the distance."""
    named = entity.where(F.lower("name").isin(*[n.lower() for n in names])).select("id", F.lit(1.0).alias("score"), F.lit("query").alias("via"))
    if query is None:
        return named
    near = nearest(entity, query, 10).where(1 - F.col("similarity") <= distance).select("id", F.col("similarity").alias("score"), F.lit("vector").alias("via"))
    return named.unionByName(near.join(named, "id", "left_anti"))


def expand(related: DataFrame, seed: DataFrame, limit: int = DEFAULTS.max_neighbours) -> DataFrame:
    """(id, score, via): seeds and their strongest neighbours at half the seed's score, scaled by weight; an entity keeps its best."""
    return grown(both_ways(related), seed, limit)


def grown(edges: DataFrame, seed: DataFrame, limit: int = DEFAULTS.max_neighbours) -> DataFrame:
    """expand() over edges (x, y, weight) in either direction; a name may stand for many seeds, so how they are joined is left to the planner."""
    start = seed.select(F.col("id").alias("x"), "score")
    edges = edges.join(start, "x").join(seed.select(F.col("id").alias("y")), "y", "left_anti")
    strongest = edges.orderBy(F.desc("weight"), "x", "y").limit(limit)
    most = F.max("weight").over(Window.partitionBy())  # over `limit` rows
    near = strongest.withColumn("most", most).select(F.col("y").alias("id"), (0.5 * F.col("score") * F.col("weight") / F.col("most")).alias("score"))
    near = near.groupBy("id").agg(F.max("score").alias("score")).withColumn("via", F.lit("neighbour"))
    return seed.select("id", "score", "via").unionByName(near)


def graph_candidates(entities: DataFrame, mentions: DataFrame, chunk: DataFrame, document: DataFrame, k: int, seen: Column) -> DataFrame:
    """(id, graph): passages by the sum of the weights of the entities that they mention."""
    docs = document.where(seen).select(F.col("id").alias("doc_id"))
    weight = "score_e" if "score_e" in entities.columns else "score"
    hits = mentions.join(entities.select(F.col("id").alias("entity_id"), F.col(weight).alias("score_e")), "entity_id")
    placed = hits.join(chunk.select(F.col("id").alias("chunk_id"), "doc_id"), "chunk_id").join(docs, "doc_id", "left_semi")
    # rounded: a sum of doubles depends on the order of the rows, and the order of ties on the sum
    return placed.groupBy(F.col("chunk_id").alias("id")).agg(F.round(F.sum("score_e"), 9).alias("graph")).orderBy(F.desc("graph"), "id").limit(max(2 * k, 10))


def candidates(nearest: DataFrame, graph: DataFrame, keywords: DataFrame, k: int) -> DataFrame:
    """(id, source, graph, bm25, graph_max, bm25_max): the vector list (source 1), graph passages (2), then the first
    max(2 k, 10) keyword hits (3), with the scores that a passage has on any list and the best of each list.

    Each list is read once: they are put below one another and grouped."""
    whole = Window.partitionBy()  # the lists hold a few hundred rows at most
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "chunk_id"))
    none = F.lit(None).cast("double")
    rows = (nearest.select("id", F.lit(1).alias("source"), none.alias("graph"), none.alias("bm25"))
            .unionByName(graph.select("id", F.lit(2).alias("source"), "graph", none.alias("bm25")))
            .unionByName(keywords.select(F.col("chunk_id").alias("id"), F.when(place <= max(2 * k, 10), 3).alias("source"), none.alias("graph"), F.col("score").alias("bm25"))))
    found = rows.groupBy("id").agg(F.min("source").alias("source"), F.max("graph").alias("graph"), F.max("bm25").alias("bm25"))
    return found.withColumns({"graph_max": F.max("graph").over(whole), "bm25_max": F.max("bm25").over(whole)}).where("source is not null")


def fused(found: DataFrame, min_score: float, settings: Settings = DEFAULTS) -> DataFrame:
    """Rows of found(similarity and the columns of candidates()) above the threshold with score, via_graph, via_keywords.

    Threshold: similarity and keyword boost; the graph boost counts only in the order."""
    word = settings.keyword_boost * F.coalesce(F.try_divide("bm25", "bm25_max"), F.lit(0.0))
    edge = settings.graph_boost * F.coalesce(F.try_divide("graph", "graph_max"), F.lit(0.0))
    return (found.withColumns({"word": word, "edge": edge}).where(F.col("similarity") + F.col("word") >= min_score)
            .withColumns({"score": F.col("similarity") + F.col("edge") + F.col("word"), "via_graph": F.col("source") == 2, "via_keywords": F.col("source") == 3})
            .drop("word", "edge", "source", "graph", "bm25", "graph_max", "bm25_max"))


def without_near_duplicates(ranked: DataFrame, k: int, threshold: float = DEFAULTS.near_duplicate, key: str = "query_id") -> DataFrame:
    """Greedy: in rank order a passage stays unless it is too near to one that stayed; testing ends at k.

    ranked: (key, rank, id, embedding, ...), a hundred rows a query at most; (key, id, rank, ..., place) comes back."""
    carried = [c for c in ranked.columns if c not in (key, "id", "rank", "embedding")]

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("rank")
        kept: list = []
        rows = []
        for i, v in enumerate(pdf["embedding"]):
            if len(kept) == k:
                break
            v = np.asarray(v, float)
            if all(float(v @ w) < threshold for w in kept):
                kept.append(v)
                rows.append(i)
        out = pdf.iloc[rows][[key, "id", "rank", *carried]].copy()
        out["place"] = range(1, len(out) + 1)
        return out

    types = dict(ranked.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in (key, "id", "rank", *carried))
    return ranked.groupBy(key).applyInPandas(keep, f"{schema}, place bigint")


def search(tables: dict[str, DataFrame], query: list[float], terms: list[str], names: list[str], k: int = DEFAULTS.k, drafts: bool = False,
           tags: list[str] | None = None, min_score: float = DEFAULTS.min_score, rerank=None, settings: Settings = DEFAULTS, analyser=stemmed_terms) -> DataFrame:
    """Hybrid search: (rank, id, doc_id, similarity, score, via_graph, via_keywords, text), and what `rerank` adds.

    Where the tables have no `related`, edges are counted from the mentions, those of the question's entities alone.

    terms: the question's, by the analyser (`stem.analyse`). Stored `postings` and `lengths` among the tables (see
    KeywordIndex) are used; else passages are analysed here.

    rerank: candidates -> candidates with a `rerank` column, which then alone orders the best max(2 k, 16)."""
    from graphloom.operators.graph import visible

    k = clamp(k, 1, settings.max_k)
    chunk, document, seen = tables["chunk"], tables["document"], visible(drafts, tags)
    near = vector_candidates(chunk, document, query, k, seen)
    with_vectors = "embedding" in tables["entity"].columns
    if names or with_vectors:
        start = seeds(tables["entity"], names, query if with_vectors else None, settings.seed_distance)
        edges = both_ways(tables["related"]) if "related" in tables else edges_of(tables["mentions"], start)
        graph = graph_candidates(grown(edges, start, settings.max_neighbours), tables["mentions"], chunk, document, k, seen)
    else:  # nothing to start from
        graph = near.where("false").select("id", F.lit(0.0).alias("graph"))
    index = (tables["postings"], tables["lengths"]) if "postings" in tables else postings(chunk, analyser, terms)
    words = bm25_search(*index, terms, clamp(4 * k, 20, 100), settings)
    found = candidates(near, graph, words, k)
    docs = document.where(seen).select(F.col("id").alias("doc_id"))
    q = vector(query)
    # passages are read once for the candidates, a few hundred rows, and carry their text and vector to the end
    detail = chunk.select("id", "doc_id", "text", "embedding").join(F.broadcast(found), "id").join(docs, "doc_id", "left_semi")
    ranked = fused(detail.withColumn("similarity", cosine(F.col("embedding"), q)), min_score, settings)
    if rerank is not None:
        ranked = rerank(ranked.orderBy(F.desc("score"), "id").limit(max(2 * k, 16)))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("rerank" if rerank is not None else "score"), "id")
    placed = ranked.withColumn("rank", F.row_number().over(order)).withColumn("query_id", F.lit(1))
    if settings.near_duplicate is None:
        kept = placed.where(F.col("rank") <= k).withColumn("place", F.col("rank"))
    else:
        kept = without_near_duplicates(placed, k, settings.near_duplicate)
    more = [c for c in ranked.columns if c not in ("id", "doc_id", "similarity", "score", "via_graph", "via_keywords", "text", "embedding")]
    return kept.select(F.col("place").alias("rank"), "id", "doc_id", "similarity", "score", "via_graph", "via_keywords", "text", *more).orderBy("rank")


def lsh_nearest(vectors: DataFrame, query: list[float], limit: int, buckets: float = 0.5, tables: int = 8) -> DataFrame:
    """Approximate neighbours by random projections; for tables too large for an exact scan."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = vectors.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=buckets, numHashTables=tables, seed=7).fit(rows)
    return model.approxNearestNeighbors(rows, Vectors.dense(query), limit).select("id", F.col("distCol").alias("distance"))
