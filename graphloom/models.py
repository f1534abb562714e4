"""Model slots and deterministic defaults. A model is loaded once in each Python worker and fed Arrow batches.

The defaults stand in where no model files are at hand: they make results repeatable, not good."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import sigmoid


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Extractor(Protocol):
    def extract(self, texts: list[str], labels: list[str], threshold: float) -> list[list[tuple[str, str, float]]]: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class HashedTerms:
    """Hashed bag of terms and letter trigrams, scaled to length one."""

    def __init__(self, dim: int = 256):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower()):
                for piece in (word, *(f"#{word[i:i + 3]}" for i in range(len(word) - 2))):
                    h = zlib.crc32(piece.encode())
                    row[h % self.dim] += 1 if h >> 16 & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Patterns:
    """Capitalised spans, addresses and identifiers."""

    rules = (("email", re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+"), 0.99), ("url", re.compile(r"https?://[^\s)>\]]+"), 0.95),
             ("identifier", re.compile(r"\b[A-Z]{2,}(?:[-_][A-Z0-9]+)+\b|\b[A-Z]+\d+\b"), 0.9),
             ("name", re.compile(r"\b[A-ZÀ-Þ][\w'-]+(?: [A-ZÀ-Þ][\w'-]+)*"), 0.6))

    def extract(self, texts, labels, threshold):
        return [[(m[0], label, s) for label, rule, s in self.rules if s >= threshold and (not labels or label in labels) for m in rule.finditer(t)] for t in texts]


class Overlap:
    """Share of the question's terms that a text holds, as a logit."""

    def score(self, query, texts):
        want = set(re.findall(r"\w+", query.lower()))
        return [6 * len(want & set(re.findall(r"\w+", t.lower()))) / max(1, len(want)) - 3 for t in texts]


def pooled(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the token vectors under the mask, scaled to length one."""
    m = mask[..., None].astype(np.float32)
    mean = (tokens * m).sum(1) / np.maximum(m.sum(1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)


def embedded(c: Column, make: Callable[[], Embedder] = HashedTerms, prefix: str = "passage: ", batch: int = 16) -> Column:
    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in parts:
            given = [prefix + (t or "") for t in texts]
            rows = [v for a in range(0, len(given), batch) for v in model.embed(given[a:a + batch])]
            yield pd.Series([v.tolist() for v in rows], dtype=object)

    return run(c)


def extracted(chunk: DataFrame, make: Callable[[], Extractor] = Patterns, labels: tuple[str, ...] = (), threshold: float = 0.5, batch: int = 8) -> DataFrame:
    """(chunk_id, doc_id, surface, label, score) of passages' prose."""
    from graphloom.functions.text import prose

    @F.pandas_udf("array<struct<surface: string, label: string, score: double>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in parts:
            given = [prose(t or "") for t in texts]
            found = [x for a in range(0, len(given), batch) for x in model.extract(given[a:a + batch], list(labels), threshold)]
            yield pd.Series([[{"surface": s, "label": n, "score": float(p)} for s, n, p in row] for row in found], dtype=object)

    return chunk.select(F.col("id").alias("chunk_id"), "doc_id", F.explode(run("text")).alias("x")).select("chunk_id", "doc_id", "x.*")


def reranked(query: str, make: Callable[[], Reranker] = Overlap, batch: int = 8) -> Callable[[DataFrame], DataFrame]:
    """A rerank step for retrieval.search."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in parts:
            given = [t or "" for t in texts]
            yield pd.Series([float(s) for a in range(0, len(given), batch) for s in model.score(query, given[a:a + batch])])

    return lambda cands: cands.withColumn("rerank", sigmoid(run("text")))


def question_entities(question: str, names: list[str] | None = None, make: Callable[[], Extractor] = Patterns) -> list[str]:
    """Names in a question: what the extractor finds, and known names that it holds."""
    found = [s for s, _, _ in make().extract([question], [], 0.5)[0]]
    low = f" {question.lower()} "
    return list(dict.fromkeys(found + [n for n in names or [] if f" {n.lower()} " in low]))
