"""Property-graph operators over the logical tables: statistics, lists, entities, relations, maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.columns import compact_name, strength


def visible(drafts: bool = False, tags: list[str] | None = None) -> Column:
    """Documents that a search may see: published unless drafts are wanted, and any of the tags (case counts)."""
    status = F.lit(True) if drafts else F.col("status") == "PUBLISHED"
    return status & F.arrays_overlap("tags", F.array(*map(F.lit, tags))) if tags else status


def both_ways(related: DataFrame) -> DataFrame:
    """Undirected edges: (x, y, weight) in either direction."""
    ends = F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))
    return related.select(F.explode(ends).alias("e"), "weight").select("e.x", "e.y", "weight")  # a union would count the pairs twice


def statistics(document: DataFrame, chunk: DataFrame, entity: DataFrame, mentions: DataFrame, related: DataFrame) -> DataFrame:
    """One row with the seven counts of a project."""
    docs = document.agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "PUBLISHED").alias("published"),
                        F.count_if(~F.col("status").eqNullSafe("PUBLISHED")).alias("not_published"))
    for df, name in ((chunk, "chunks"), (entity, "entities"), (mentions, "mentions"), (related, "relations")):
        docs = docs.crossJoin(df.agg(F.count("*").alias(name)))  # one row each
    return docs


def label_counts(entity: DataFrame) -> DataFrame:
    return entity.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def tag_counts(document: DataFrame) -> DataFrame:
    return document.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def list_documents(document: DataFrame, chunk: DataFrame, mentions: DataFrame, title: str = "", status: str = "", tag: str = "") -> DataFrame:
    """Documents that match, with their passage and entity counts, newest first; an empty filter is no filter."""
    found = document
    if title:
        found = found.where(F.lower("title").contains(title.lower()))
    if status:
        found = found.where(F.col("status") == status.upper())
    if tag:
        found = found.where(F.array_contains("tags", tag))
    chunks = chunk.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    entities = mentions.join(chunk.select(F.col("id").alias("chunk_id"), "doc_id"), "chunk_id").groupBy("doc_id").agg(
        F.count_distinct("entity_id").alias("entities"))
    counts = chunks.join(entities, "doc_id", "left").withColumnRenamed("doc_id", "id")
    return found.join(counts, "id", "left").withColumns(
        {"chunks": F.coalesce("chunks", F.lit(0)), "entities": F.coalesce("entities", F.lit(0))}).orderBy(F.desc("updated_at"), "id")


def passages(chunk: DataFrame, mentions: DataFrame, entity: DataFrame, doc_id: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of a document's passages with entity names; page 0 is no page. The limit comes before the join."""
    part = chunk.where(F.col("doc_id") == doc_id).orderBy("idx").offset(offset).limit(min(limit, 200))
    names = mentions.join(part.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").join(
        entity.select(F.col("id").alias("entity_id"), "name"), "entity_id").groupBy("chunk_id").agg(F.sort_array(F.collect_set("name")).alias("entities"))
    return part.join(names.withColumnRenamed("chunk_id", "id"), "id", "left").select(
        "id", "idx", "text", F.nullif(F.col("page"), F.lit(0)).alias("page"),
        F.coalesce("entities", F.array().cast("array<string>")).alias("entities")).orderBy("idx")


def mention_counts(mentions: DataFrame, chunk: DataFrame, document: DataFrame) -> DataFrame:
    """(entity_id, total, published) mentions; those that have their doc_id need no passage to find it."""
    own = mentions if "doc_id" in mentions.columns else mentions.join(chunk.select(F.col("id").alias("chunk_id"), "doc_id"), "chunk_id")
    placed = own.join(
        document.select(F.col("id").alias("doc_id"), "status"), "doc_id")
    return placed.groupBy("entity_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "PUBLISHED").alias("published"))


def list_entities(entity: DataFrame, counts: DataFrame, name: str = "", label: str = "", drafts: bool = False, limit: int = 1000) -> DataFrame:
    """Entities by mentions; without drafts only those with a published one."""
    found = entity
    if name:
        found = found.where(F.lower("name").contains(name.lower()))
    if label:
        found = found.where(F.col("label") == label)
    n = F.col("total") if drafts else F.col("published")
    return (found.join(counts.withColumnRenamed("entity_id", "id"), "id").withColumn("n", n).where(F.lit(drafts) | (F.col("published") > 0))
            .select("id", "name", "label", "n").orderBy(F.desc("n"), "name", "id").limit(min(limit, 1000)))


def pair_weights(mentions: DataFrame) -> DataFrame:
    """(a, b, weight): passages that mention both, a < b; a passage's mentions are few, so pairs stay in proportion.

    A passage's entities come together once, in order; pairs are made from that list, not by a join of mentions with themselves."""
    return signed_weights(mentions.select("chunk_id", "entity_id", F.lit(1).cast("long").alias("sign")))


def signed_weights(mentions: DataFrame) -> DataFrame:
    """(a, b, weight) as pair_weights() of mentions with a sign, that of their passage: its pairs count as much.

    Weights that come to nothing stay away."""
    lists = mentions.where("chunk_id is not null").groupBy("chunk_id", "sign").agg(F.array_sort(F.collect_set("entity_id")).alias("all"))
    firsts = lists.select("all", "sign", F.posexplode("all").alias("i", "a"))
    pairs = firsts.select("a", F.explode_outer(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"), "sign").where("b is not null")
    return pairs.groupBy("a", "b").agg(F.sum("sign").alias("weight")).where("weight <> 0")


def edges_of(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(x, y, weight) of entities(id), as both_ways() of pair_weights() has them: pairs of no other entity are made."""
    own = mentions.select("chunk_id", "entity_id")
    starts = own.join(entities.select(F.col("id").alias("entity_id")).distinct(), "entity_id").select("chunk_id", F.col("entity_id").alias("x")).distinct()
    pairs = own.join(starts, "chunk_id").where("x <> entity_id").distinct()
    return pairs.groupBy("x", F.col("entity_id").alias("y")).agg(F.count("*").alias("weight"))


def edge_strengths(related: DataFrame, counts: DataFrame) -> DataFrame:
    left, right = (counts.select(F.col("entity_id").alias(x), F.col("total").alias(f"n_{x}")) for x in "ab")
    return related.join(left, "a").join(right, "b").withColumn("strength", strength(F.col("weight"), F.col("n_a"), F.col("n_b")))


def entity_documents(mentions: DataFrame, chunk: DataFrame, document: DataFrame, entity_id: str, most_pages: int = 12) -> DataFrame:
    """Documents of an entity: passages, and the first distinct pages."""
    placed = mentions.where(F.col("entity_id") == entity_id).join(chunk.select(F.col("id").alias("chunk_id"), "doc_id", "page"), "chunk_id")
    pages = F.slice(F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("page") > 0, F.col("page"))))), 1, most_pages)
    found = placed.groupBy("doc_id").agg(F.count("*").alias("passages"), pages.alias("pages"))
    return found.join(document.select(F.col("id").alias("doc_id"), "title", "status"), "doc_id").orderBy(F.desc("passages"), "doc_id")


def neighbours(related: DataFrame, entity_id: str, limit: int = 50) -> DataFrame:
    return both_ways(related).where(F.col("x") == entity_id).select(F.col("y").alias("id"), "weight").orderBy(F.desc("weight"), "id").limit(limit)


def entity_detail(tables: dict[str, DataFrame], entity_id: str, limit: int = 50) -> dict[str, DataFrame]:
    """Everything about one entity: itself, its neighbours, documents, passages and, where there are any, images."""
    mentions, chunk = tables["mentions"], tables["chunk"]
    own = mentions.where(F.col("entity_id") == entity_id).select(F.col("chunk_id").alias("id")).distinct()
    of = chunk.join(own, "id", "left_semi")
    out = {"entity": tables["entity"].where(F.col("id") == entity_id), "neighbours": neighbours(tables["related"], entity_id, limit),
           "documents": entity_documents(mentions, chunk, tables["document"], entity_id),
           "passages": of.select("id", "doc_id", "idx", "page", "text").orderBy("doc_id", "idx").limit(limit)}
    if "image" in tables:
        out["images"] = images_of(of, tables["shows"], tables["image"])
    return out


def relation(mentions: DataFrame, chunk: DataFrame, first: str, second: str, limit: int = 30) -> DataFrame:
    """Passages that mention both entities; the weight is their number, counted before the limit."""
    of = lambda e: mentions.where(F.col("entity_id") == e).select("chunk_id").distinct()
    shared = of(first).join(of(second), "chunk_id", "left_semi")
    weight = shared.agg(F.count("*").alias("weight"))
    return (chunk.join(shared.withColumnRenamed("chunk_id", "id"), "id", "left_semi").select("id", "doc_id", "idx", "text")
            .orderBy("doc_id", "idx").limit(limit).crossJoin(weight))


def resolve(entity: DataFrame, counts: DataFrame, name: str, drafts: bool = False) -> DataFrame:
    """One entity for a name: equal name or id, else equal compact form, else a name that contains it; most mentioned first."""
    n = counts.select(F.col("entity_id").alias("id"), F.col("total").alias("n"))
    key = F.lit(name)
    rank = (F.when((F.lower("name") == F.lower(key)) | (F.lower("id") == F.lower(key)), 1)
            .when(compact_name(F.col("name")) == compact_name(key), 2).when(F.lower("name").contains(name.lower()), 3))
    return (entity.withColumn("rank", rank).where("rank is not null").join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            .select("id", "name", "label", "n", "rank").orderBy("rank", F.desc("n"), "id").limit(1))


def edges_among(related: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes (id)."""
    return related.join(nodes.select(F.col("id").alias("a")), "a", "left_semi").join(nodes.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b", "weight")


def document_graph(mentions: DataFrame, chunk: DataFrame, doc_id: str, limit: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Entities and pairs of one document, by distinct passages."""
    own = mentions.join(chunk.where(F.col("doc_id") == doc_id).select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    nodes = own.groupBy(F.col("entity_id").alias("id")).agg(F.count_distinct("chunk_id").alias("n")).orderBy(F.desc("n"), "id").limit(limit)
    return nodes, edges_among(pair_weights(own), nodes)


def neighbourhood(related: DataFrame, entity_id: str, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """An entity, its strongest neighbours, and the edges among them."""
    near = neighbours(related, entity_id, limit)
    nodes = near.select("id").unionByName(related.sparkSession.createDataFrame([(entity_id,)], "id string")).distinct()
    return nodes, edges_among(related, nodes)


def thinned(edges: DataFrame, nodes: int) -> DataFrame:
    """A dense graph's edges above a cut: the weight at place 3 n when there are more than 4 n, two at least."""
    at = edges.orderBy(F.desc("weight"), "a", "b").offset(3 * nodes).limit(1).agg(F.max(F.greatest(F.lit(2), "weight")).alias("cut"))
    more = edges.offset(4 * nodes).limit(1).agg(F.count("*").alias("more"))
    # one row each
    return edges.crossJoin(F.broadcast(at)).crossJoin(F.broadcast(more)).where("more = 0 or weight >= cut").drop("cut", "more")


def without_labels(nodes: DataFrame, edges: DataFrame, hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of labels that show, and no edge that dangles."""
    kept = nodes.where(~F.col("label").isin(*hidden)) if hidden else nodes
    return kept, edges_among(edges, kept)


def next_chain(chunk: DataFrame) -> DataFrame:
    """(id, next_id): the passage that follows in the document."""
    after = F.lead("id").over(Window.partitionBy("doc_id").orderBy("idx"))
    return chunk.select("id", after.alias("next_id")).where("next_id is not null")


def orphan_chunks(chunk: DataFrame, document: DataFrame) -> DataFrame:
    return chunk.join(document.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")


def orphan_entities(entity: DataFrame, mentions: DataFrame) -> DataFrame:
    return entity.join(mentions.select(F.col("entity_id").alias("id")), "id", "left_anti")


def images_of(chunk: DataFrame, shows: DataFrame, image: DataFrame, limit: int = 24) -> DataFrame:
    """Images of passages, each file once, at its first place."""
    placed = chunk.select(F.col("id").alias("chunk_id"), "doc_id", "idx").join(shows, "chunk_id").join(
        image.select(F.col("id").alias("image_id"), "file", "caption", "n"), "image_id")
    first = F.row_number().over(Window.partitionBy("file").orderBy("doc_id", "idx", "n"))
    return placed.withColumn("first", first).where("first = 1").drop("first").orderBy("doc_id", "idx", "n").limit(limit)


def suggestions(entity: DataFrame, counts: DataFrame, related: DataFrame, least: int = 3) -> DataFrame:
    """Questions to open a conversation with: the most mentioned entity, and the strongest edge if it is strong."""
    top = list_entities(entity, counts, drafts=True, limit=1).select(F.lit("entity").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"))
    edge = related.where(F.col("weight") >= least).orderBy(F.desc("weight"), "a", "b").limit(1).select(F.lit("relation").alias("kind"), "a", "b")
    return top.unionByName(edge)
