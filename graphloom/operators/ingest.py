"""From documents to graph tables: passages, mentions, entities, relations; replacement and deletion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as rules
from graphloom.functions.columns import clean_name, entity_id, is_noise
from graphloom.operators.graph import pair_weights

_PASSAGE = "array<struct<text: string, page: bigint, images: array<struct<n: bigint, caption: string>>>>"

# Words that extractors tag although they name nothing.
NOISE = tuple((
    "i me you he she it we they them us your our their this that user users app apps application applications developer developers people "
    "customer customers client clients team company system systems file files data code example examples device devices server computer world home "
    "je moi tu toi il elle on nous vous ils elles eux ce cela ça utilisateur utilisateurs utilisatrice développeur développeurs équipe équipes "
    "entreprise société salarié salariés personne personnes système fichier fichiers données exemple serveur ordinateur monde").split())


def passages(document: DataFrame, structured: bool = True, size: int = 1000, overlap: int = 150) -> DataFrame:
    """chunk rows (id, doc_id, idx, text, page) and their images, of document(id, content)."""
    cut = rules.chunk_document if structured else rules.chunk_plain

    @F.pandas_udf(_PASSAGE)
    def chunked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t or "", size, overlap))

    each = document.select(F.col("id").alias("doc_id"), F.posexplode(chunked("content")).alias("idx", "p"))
    return each.select(F.concat("doc_id", F.lit("#"), F.col("idx")).alias("id"), "doc_id", F.col("idx").cast("long").alias("idx"),
                       F.col("p.text").alias("text"), F.coalesce("p.page", F.lit(0)).alias("page"), F.col("p.images").alias("images"))


def sentence_lists(c):
    """The sentences of a text, as a column: array<string>."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: rules.sentences(t or ""))

    return run(c)


def heading_parts(c):
    """struct<path, body> of a passage, as a column."""

    @F.pandas_udf("struct<path: string, body: string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rules.split_heading(t or "") for t in texts], columns=["path", "body"])

    return run(c)


def line_passages(document: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One passage a line that is not blank; columns of the document named in carry come along, short ones."""
    each = document.select(F.col("id").alias("doc_id"), *carry, F.posexplode(F.split("content", "\n", -1)).alias("idx", "text"))
    return each.where("text <> ''").select(F.concat("doc_id", F.lit("#"), F.col("idx")).alias("id"), "doc_id", F.col("idx").cast("long").alias("idx"), "text", *carry)


def capital_mentions(chunk: DataFrame) -> DataFrame:
    """The default extractor in SQL: capitalised words; the first of a passage is labelled HEAD, others BODY.

    (chunk_id, doc_id, surface, label, score)"""
    words = F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]{2,}"), F.lit(0))
    each = chunk.select(F.col("id").alias("chunk_id"), "doc_id", F.posexplode(words).alias("pos", "surface"))
    return each.select("chunk_id", "doc_id", "surface", F.when(F.col("pos") == 0, "HEAD").otherwise("BODY").alias("label"),
                       F.least(F.lit(1.0), F.lit(0.5) + F.char_length("surface") / F.lit(40.0)).alias("score"))


def cleaned(raw: DataFrame, threshold: float = 0.5, noise=NOISE) -> DataFrame:
    """Mentions at the threshold with clean names that are no noise, the best of equal ones in a passage."""
    # exploded, so that no filter evaluates the name again
    kept = F.filter(F.array(clean_name(F.col("surface"))), lambda s: s.isNotNull() & ~is_noise(s, noise))
    named = raw.where(F.col("score") >= threshold).select("chunk_id", "doc_id", "label", "score", F.explode(kept).alias("surface"))
    return named.groupBy("chunk_id", "doc_id", "label", F.lower("surface").alias("key")).agg(
        F.max("score").alias("score"), F.min("surface").alias("surface")).drop("key")


def label_votes(raw: DataFrame) -> DataFrame:
    """(key, label): the label of most mentions of a name, then of the larger score sum, then by name."""
    counted = raw.groupBy(F.lower("surface").alias("key"), "label").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("s"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), F.desc("s"), "label"))
    return counted.withColumn("rank", rank).where("rank = 1").select("key", "label")


def canonical(raw: DataFrame, entity: DataFrame | None = None, aside: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Mentions (chunk_id, entity_id, score, surface) and entities (id, name, label).

    aside: a new folder where mentions with their entities are written, as more than one table is made of them; mentions
    then have their doc_id too.

    An entity of the name that the base has keeps its id and label (the most mentioned one if there are
    several: `entity` may carry n); other names get the voted label."""
    votes = label_votes(raw)
    if entity is not None:
        n = F.col("n") if "n" in entity.columns else F.lit(0)
        rank = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy(F.desc(n), "id"))
        known = entity.withColumn("rank", rank).where("rank = 1").select(F.lower("name").alias("key"), F.col("label").alias("old"), F.col("id").alias("old_id"))
        votes = votes.join(known, "key", "left").select("key", F.coalesce("old", "label").alias("label"), "old_id")
    else:
        votes = votes.withColumn("old_id", F.lit(None).cast("string"))
    placed = raw.drop("label").withColumn("key", F.lower("surface")).join(votes, "key")
    placed = placed.withColumn("entity_id", F.coalesce("old_id", entity_id(F.col("label"), F.col("surface"))))
    best = [F.max("score").alias("score"), F.min("surface").alias("surface")]
    if aside is None:
        mentions = placed.groupBy("chunk_id", "entity_id").agg(*best)
    else:
        placed.groupBy("chunk_id", "entity_id").agg(*best, F.min("doc_id").alias("doc_id"), F.min("label").alias("label")).write.parquet(aside)
        placed = raw.sparkSession.read.parquet(aside)
        mentions = placed.drop("label")
    entities = placed.groupBy(F.col("entity_id").alias("id")).agg(F.min("surface").alias("name"), F.first("label").alias("label"))
    return mentions, entities


def reusable(chunk: DataFrame, previous: DataFrame) -> DataFrame:
    """New passages with the id of an earlier one of equal text: by hash, then by the text itself; one of several equal ones."""
    before = previous.groupBy(F.xxhash64("text").alias("h"), "text").agg(F.min("id").alias("previous_id"))
    return chunk.withColumn("h", F.xxhash64("text")).join(before, ["h", "text"], "left").drop("h")


def replaced(tables: dict[str, DataFrame], new: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """Tables after documents (id) are replaced by new rows; entities without a mention go, relations are counted again."""
    kept = deleted(tables, doc_ids, prune=False)
    out = {name: kept[name].unionByName(new[name], allowMissingColumns=True) if name in new else kept[name] for name in kept}
    return pruned(out)


def deleted(tables: dict[str, DataFrame], doc_ids: DataFrame, prune: bool = True) -> dict[str, DataFrame]:
    """Tables without documents (id): passages, mentions, figures and what hangs on them go too."""
    of_doc = doc_ids.select(F.col("id").alias("doc_id"))
    out = dict(tables)
    out["document"] = tables["document"].join(doc_ids.select("id"), "id", "left_anti")
    out["chunk"] = tables["chunk"].join(of_doc, "doc_id", "left_anti")
    gone = tables["chunk"].join(of_doc, "doc_id", "left_semi").select(F.col("id").alias("chunk_id"))
    out["mentions"] = tables["mentions"].join(gone, "chunk_id", "left_anti")
    if "image" in tables:
        out["image"] = tables["image"].join(of_doc, "doc_id", "left_anti")
        out["shows"] = tables["shows"].join(gone, "chunk_id", "left_anti")
    return pruned(out) if prune else out


def pruned(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Entities that are mentioned, and relations counted from the mentions: a weight is the number of passages with both."""
    return tables | {"entity": tables["entity"].join(tables["mentions"].select(F.col("entity_id").alias("id")), "id", "left_semi"),
                     "related": pair_weights(tables["mentions"])}


def merged_weights(related: DataFrame, delta: DataFrame) -> DataFrame:
    """Edges after weights are added (or, if negative, taken away); those at zero go."""
    both = related.select("a", "b", "weight").unionByName(delta.select("a", "b", "weight"))
    return both.groupBy("a", "b").agg(F.sum("weight").alias("weight")).where("weight > 0")


def patched(document: DataFrame, patch: DataFrame, now) -> DataFrame:
    """Documents with new values where the patch (id, title, source, metadata, status, creator, tags) has them."""
    fields = [c for c in patch.columns if c != "id"]
    new = patch.select("id", F.lit(True).alias("hit"), *[F.col(c).alias(f"new_{c}") for c in fields])
    joined = document.join(new, "id", "left")
    for c in fields:
        joined = joined.withColumn(c, F.coalesce(f"new_{c}", c))
    joined = joined.withColumn("updated_at", F.when(F.col("hit"), now).otherwise(F.col("updated_at")))
    return joined.select(*document.columns)


def kept_images(found: DataFrame, least_bytes: int = 2048, most_repeats: int = 4, most: int = 300) -> DataFrame:
    """Images of documents (doc_id, n, hash, size): no tiny ones, none seen `most_repeats` times in its document, the first `most`."""
    per_hash, per_doc = Window.partitionBy("doc_id", "hash"), Window.partitionBy("doc_id").orderBy("n")
    kept = found.where(F.col("size") >= least_bytes).withColumn("seen", F.count("*").over(per_hash)).where(F.col("seen") < most_repeats)
    return kept.withColumn("place", F.row_number().over(per_doc)).where(F.col("place") <= most).drop("seen", "place")


def unreferenced(files: DataFrame, image: DataFrame) -> DataFrame:
    """Stored files that no image names."""
    return files.join(image.select("file").distinct(), "file", "left_anti")
