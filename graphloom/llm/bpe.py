"""Byte-level BPE with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be merged over, so every such pair
inside a pre-token is a certain cut. The fragments between cuts are encoded independently by the
merge table and their ids concatenated; a bounded memo keeps recent chunks and fragments.

A text is first parted at the vocabulary's added tokens, then into chunks of one word with its
leading space or of white space. No pre-token spans two chunks, so a chunk's ids depend on the
chunk alone.

Null texts are empty: no ids, and decoded to the empty text. Repeated rows and null ids are kept,
each row for itself; columns other than doc_id and text are not looked at, whatever their names.
An empty table gives an empty result."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import _shared

#: White space as the pre-tokenizer sees it (Unicode White_Space).
WHITE = " \\t\\n\\r\\f\\v\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNKS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Chunks of the memo, of about 200 bytes each.
MEMO = 700_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


class Encoder(dict):
    """chunk -> little-endian 32-bit ids; missing chunks are encoded on demand."""

    def __init__(self, path: str):
        import json

        import tokenizers

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = tokenizers.Tokenizer.from_file(path)
        self.split = self.tok.pre_tokenizer.pre_tokenize_str
        self.model = self.tok.model
        letters = byte_letters()
        self.byte_of = {c: b for b, c in letters.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_re = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        size = 1 + max([*spec["model"]["vocab"].values(), *self.added.values()])
        self.token_bytes = [b""] * size
        self.inside = np.zeros((256, 256), bool)
        for token, i in spec["model"]["vocab"].items():
            raw = bytes(self.byte_of[c] for c in token)
            self.token_bytes[i] = raw
            for a, b in zip(raw, raw[1:], strict=False):
                self.inside[a, b] = True
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        self.joined = {letters[a] + letters[b] for a, b in zip(*np.nonzero(self.inside), strict=True)}
        self.fragments: dict[str, bytes] = {}

    def cuts(self, pre: str) -> list[str]:
        """Fragments of a pre-token (in byte letters) between forced boundaries."""
        out, start = [], 0
        joined = self.joined
        for i in range(1, len(pre)):
            if pre[i - 1:i + 1] not in joined:
                out.append(pre[start:i])
                start = i
        out.append(pre[start:])
        return out

    def fragment(self, piece: str) -> bytes:
        found = self.fragments.get(piece)
        if found is None:
            found = np.array([t.id for t in self.model.tokenize(piece)], "<u4").tobytes()
            if len(piece) <= 64:
                if len(self.fragments) > MEMO // 2:
                    self.fragments.clear()
                self.fragments[piece] = found
        return found

    def __missing__(self, chunk: str) -> bytes:
        found = b"".join([self.fragment(f) for pre, _ in self.split(chunk) for f in self.cuts(pre)])
        if len(chunk) <= 64:
            self[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        if len(self) > MEMO:
            self.clear()
        if self.added_re is None or not self.added_re.search(text):
            return b"".join(map(self.__getitem__, CHUNKS.findall(text)))
        out = []
        for part in self.added_re.split(text):
            if part in self.added:
                out.append(np.array([self.added[part]], "<u4").tobytes())
            else:
                out.extend(map(self.__getitem__, CHUNKS.findall(part)))
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary."""
    _shared.alone("bpe", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row of docs(doc_id, text); `path` is the vocabulary's JSON file."""
    _shared.small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        enc = encoder(path)
        for batch in batches:
            coded = [enc.encode(x or "") for x in batch.column(1).to_pylist()]
            ends = np.zeros(len(coded) + 1, np.int32)
            ends[1:] = np.cumsum([len(c) // 4 for c in coded])
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): what the ids stand for, added tokens included; bytes that are no UTF-8 become U+FFFD."""

    def run(batches):
        import pyarrow as pa

        token = encoder(path).token_bytes.__getitem__
        for batch in batches:
            ids = batch.column(1)
            flat, ends = ids.values.to_numpy(zero_copy_only=False).tolist(), ids.offsets.to_pylist()
            texts = [b"".join(map(token, flat[a:b])).decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """The contract's columns."""
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                          F.sha2("text", 256).alias("decoded_sha256"))
