"""Logical tables of a project and the records of its logs."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _l, _d, _t, _b = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


DOCUMENT = _struct(id=_s, title=_s, source=_s, metadata=_s, status=_s, creator=_s, tags=T.ArrayType(_s), created_at=_t, updated_at=_t, content=_s)
CHUNK = _struct(id=_s, doc_id=_s, idx=_l, text=_s, embedding=T.ArrayType(T.FloatType()), page=_l)
ENTITY = _struct(id=_s, name=_s, label=_s, embedding=T.ArrayType(T.FloatType()))
MENTIONS = _struct(chunk_id=_s, entity_id=_s, score=_d, surface=_s)
RELATED = _struct(a=_s, b=_s, weight=_l)
IMAGE = _struct(id=_s, doc_id=_s, file=_s, caption=_s, page=_l, n=_l)
SHOWS = _struct(chunk_id=_s, image_id=_s)
CALL = _struct(at=_l, channel=_s, project=_s, operation=_s, detail=_s, result=_s, context_chars=_l, context_tokens=_l, duration_ms=_l, ok=_b, error=_s)
FEEDBACK = _struct(kind=_s, at=_l, query=_s, question=_s, channel=_s, chunks=T.ArrayType(_s), best=_d, outcome=_s, key=_s)
SCORE = _struct(at=_l, project=_s, question=_s, id=_s, score=_d)
EVALSET = _struct(id=_s, question=_s, expect=_struct(doc=_s, pages=T.ArrayType(_l), contains=T.ArrayType(_s), none=_b))
WATCH = _struct(path=_s, size=_l, mtime_s=_l)

TABLES = {"document": DOCUMENT, "chunk": CHUNK, "entity": ENTITY, "mentions": MENTIONS, "related": RELATED, "image": IMAGE, "shows": SHOWS}

STATUSES = ("DRAFT", "PUBLISHED")
OUTCOMES = ("answered", "partial", "not_found")


def parse_status(value: str | None) -> str:
    """DRAFT or PUBLISHED, in any case; nothing means PUBLISHED; else an error."""
    found = (value or "PUBLISHED").strip().upper()
    if found not in STATUSES:
        raise ValueError(f"unknown status: {value}")
    return found
