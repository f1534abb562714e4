"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept, written as
Parquet and read again. All but the last return the columns of documents; n_chars follows the text
where a stage changes it. Rows of one id are one document to the dedup stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import line_dedup, ngram_join, packing, suffix_dedup, toxicity
from graphloom.llm._shared import cut, table


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of these documents, but for held-out ones."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.keep_clean(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters at least that stand earlier in the corpus, up to two edits, go."""
    return _counted(line_dedup.line_dedup(docs, max_edits=2, min_chars=40))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at a Jaccard similarity of 0.8, the one of the smallest id stays."""
    found = ngram_join.ngram_join(docs, n=5, num=80, den=100)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes at least that stand in a document of a smaller id go; a null text becomes empty."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    done = suffix_dedup.suffix_dedup(docs, length=100, whole_chars=True, carry=others)
    by_name = {"doc_id": F.col("doc_id"), "text": F.decode("kept", "UTF-8"), **{c: F.col(f"carry.`{c}`") for c in others}}
    return _counted(done.select(*[by_name[c].alias(c) for c in docs.columns]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_join", drop_near_copies),
          ("suffix_dedup", drop_passages), ("packing", pack)]

#: SQL cannot express the classifier, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
