"""Context for a reader: passages rendered under a token budget, in full or as a map."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.config import DEFAULTS
from graphloom.functions.columns import vector
from graphloom.functions.text import clip, display_sentences, split_heading


def tokens(text: str) -> int:
    return math.ceil(len(text.encode()) / 4)


def within_budget(items: list[tuple[str, bool]], budget: int, used: int = 0) -> list[bool]:
    """Which texts go in, in order: one that would pass the budget is skipped and does not count, so later smaller
    ones may fit; nothing is skipped before one fresh text has gone in. items: (text, already provided)."""
    budget = max(budget, DEFAULTS.budget_floor)
    out, fresh = [], False
    for text, provided in items:
        fits = provided or not fresh or used + tokens(text) <= budget
        out.append(fits)
        if fits:
            used += tokens(text)
            fresh |= not provided
    return out


def budgeted(ranked: DataFrame, budget: int, key: str = "query_id") -> DataFrame:
    """Rows of ranked(key, rank, id, text, provided) that go in; a fold over a query's few passages."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        keep = within_budget(list(zip(pdf["text"], pdf["provided"], strict=True)), budget)
        return pdf[keep][[key, "rank", "id"]]

    types = dict(ranked.dtypes)
    return ranked.groupBy(key).applyInPandas(fold, f"{key} {types[key]}, rank {types['rank']}, id {types['id']}")


def closest_sentences(passages: DataFrame, query: list[float], embed) -> DataFrame:
    """(id, sentence): of each passage the sentence nearest to the question, the first of equals. embed: text column -> vector column."""

    @F.pandas_udf("array<string>")
    def parts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: display_sentences(split_heading(t or "")[1]))

    q = vector(query)
    each = passages.select("id", F.posexplode(parts("text")).alias("pos", "sentence")).withColumn("v", embed(F.col("sentence")))
    near = F.aggregate(F.zip_with("v", q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return each.groupBy("id").agg(F.max_by("sentence", F.struct(near, -F.col("pos"))).alias("sentence"))


def location(title: str, page: int | None) -> str:
    return f"{title}, p. {page}" if page else title


def render(hits: list[dict], mode: str = "full", budget: int | None = None, sent: set[str] | None = None, entities: list[str] | None = None) -> tuple[str, list[str]]:
    """(Markdown, ids that count as sent) of ranked hits: id, title, page, text, sentence, entities.

    Passages that were sent before become a reminder line and keep their rank; a map shows a sentence each and marks nothing as sent."""
    if mode not in ("full", "map"):
        raise ValueError(f"unknown mode: {mode}")
    sent = sent or set()
    lines, fresh = [], []
    for n, hit in enumerate(hits, 1):
        place = location(hit["title"], hit.get("page"))
        if hit["id"] in sent:
            lines.append((f"[{n}] {place} ({hit['id']}): provided before", True))
            continue
        names = ", ".join((hit.get("entities") or [])[: 8 if mode == "map" else 12])
        path, body = split_heading(hit["text"])
        body = clip(hit.get("sentence") or body, 240) if mode == "map" else body
        head = f"[{n}] {place} ({hit['id']})" + (f"\n{path}" if path else "")
        lines.append((head + "\n" + body + (f"\nEntities: {names}" if names else ""), False))
        fresh.append(hit["id"])
    keep = within_budget(lines, budget) if budget else [True] * len(lines)
    shown = [text for (text, _), k in zip(lines, keep, strict=True) if k]
    ids = [h["id"] for h, (_, old), k in zip(hits, lines, keep, strict=True) if k and not old]
    if entities:
        shown.insert(0, "Entities: " + ", ".join(entities[:15]))
    if len(shown) < len(lines) + bool(entities):
        shown.append(f"{keep.count(False)} passages left out for length")
    return "\n\n".join(shown), ids if mode == "full" else []


def default_context(entities: list[dict], hits: list[dict]) -> str:
    """Without options: fifteen entities with six co-occurrences each, then the passages."""
    head = [f"- {e['name']} ({e['label']})" + (": " + ", ".join(e["near"][:6]) if e.get("near") else "") for e in entities[:15]]
    return "\n".join(head) + ("\n\n" if head else "") + render(hits)[0]
