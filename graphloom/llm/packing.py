"""Hierarchical multi-length packing of token streams.

Documents are tokenized and packed where they are read, without a shuffle: a task buffers up to
`buffer_tokens` tokens, packs them, and goes on. In a buffer, the full windows of the longest
tier are cut off each document; the rest is routed to the smallest tier that holds it. From the
longest tier down, each tier's rests go best-fit into windows of that size, and gaps are filled
from the shorter tiers, whole documents first, then a cut one. What is left at the end of a task
is laid in windows of falling powers of two, so no sequence needs padding. The windows of a buffer
are dealt to step groups of about `step_tokens` tokens, the largest first to the least loaded, so
the groups of a buffer hold the same number of tokens up to one window.

An empty table gives an empty result; other columns are not looked at, whatever their names.
Null texts are empty (only the end id). Rows with equal or null ids are packed each for itself.
Sequence ids are unique: the task's partition number above, its counter below."""

from __future__ import annotations

import bisect
import heapq
import re
import unicodedata
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import _shared

#: Words of the memo, of about 150 bytes each.
MEMO = 900_000
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, tier int, step_group long")
#: str.split() parts at these too, the tokenizer's white space does not hold them.
_CONTROL = re.compile("[\x1c-\x1f]")


class WordEncoder(dict):
    """Word (normalized, between white space) -> little-endian 32-bit ids."""

    def __init__(self, path: str):
        import json

        import tokenizers

        super().__init__()
        with open(path, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.added = added
        self.added_re = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.tok = tokenizers.Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.plain = frozenset(".,!?;:")

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(word) > 1 and word[-1] in self.plain and word[-2].isalpha():
            found = self[word[:-1]] + self[word[-1]]
        else:
            found = self.whole(word)
        if len(word) <= 64:
            self[word] = found
        return found

    def part(self, text: str) -> bytes:
        if _CONTROL.search(text):
            return self.whole(text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return b"".join(map(self.__getitem__, text.lower().split()))

    def encode(self, text: str) -> bytes:
        if len(self) > MEMO:
            self.clear()
        if self.added_re is None or "<|" not in text:
            return self.part(text)
        return b"".join(np.array([self.added[p]], "<u4").tobytes() if p in self.added else self.part(p)
                        for p in self.added_re.split(text))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    _shared.alone("packing", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tiers_of(window: int) -> list[int]:
    """Context sizes, longest first: each a quarter of the one before, down to 64 at least."""
    out = [window]
    while out[-1] >= 256:
        out.append(out[-1] // 4)
    return out


def balanced(sizes: list[int], step_tokens: int) -> list[int]:
    """A step group for each window: the largest first to the least loaded of as many groups as there
    are `step_tokens`. Sizes are powers of two, so loads differ by one window at most, the last dealt."""
    loads = [(0, g) for g in range(max(1, round(sum(sizes) / step_tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = loads[0]
        heapq.heapreplace(loads, (load + sizes[i], g))
        out[i] = g
    return out


class Packer:
    """Packs (key, start, length) runs; a window is (tier, [(key, start, length), ...])."""

    def __init__(self, window: int):
        self.window, self.tiers = window, tiers_of(window)

    def pack(self, docs: list[tuple[int, int, int]]):
        """docs: (key, first free token, tokens left). Returns full windows and the runs left over."""
        done = []
        by_tier: list[list] = [[] for _ in self.tiers]
        for key, start, n in docs:
            while n >= self.window:
                done.append((self.window, [(key, start, self.window)]))
                start, n = start + self.window, n - self.window
            if n:
                t = max(i for i, size in enumerate(self.tiers) if size >= n)
                by_tier[t].append((n, key, start))
        for runs in by_tier:
            runs.sort()
        for t, size in enumerate(self.tiers):
            bins = self.best_fit(by_tier[t], size)
            by_tier[t] = []
            shorter = by_tier[t + 1:]
            for free, runs in bins:
                free = self.fill(free, runs, shorter)
                if free == 0:
                    done.append((size, runs))
                else:  # nothing shorter is left: these go on as rests
                    by_tier[t].extend((n, key, start) for key, start, n in runs)
        return done, [(key, start, n) for runs in by_tier for n, key, start in runs]

    @staticmethod
    def best_fit(runs: list, size: int):
        """Best-fit decreasing into bins of `size`: [(free, [(key, start, length)])]."""
        bins: list[list] = []
        frees: list[tuple[int, int]] = []
        for n, key, start in reversed(runs):
            i = bisect.bisect_left(frees, (n, -1))
            if i < len(frees):
                free, b = frees.pop(i)
                bins[b].append((key, start, n))
            else:
                free, b = size, len(bins)
                bins.append([(key, start, n)])
            bisect.insort(frees, (free - n, b))
        return [(free, bins[b]) for free, b in frees]

    @staticmethod
    def fill(free: int, runs: list, shorter: list[list]) -> int:
        """Fill a gap from the shorter tiers' sorted rests: the longest that fit, then one that is cut."""
        for rests in shorter:
            while free:
                i = bisect.bisect_right(rests, (free, 1 << 62, 0)) - 1
                if i < 0:
                    break
                n, key, start = rests.pop(i)
                runs.append((key, start, n))
                free -= n
        if free:
            for rests in shorter:
                if rests:  # each is longer than the gap
                    n, key, start = rests.pop(0)
                    runs.append((key, start, free))
                    bisect.insort(rests, (n - free, key, start + free))
                    return 0
        return free

    def rest(self, docs: list[tuple[int, int, int]]):
        """Leftover runs in windows of falling powers of two."""
        total, out = sum(n for _, _, n in docs), []
        queue = list(reversed(docs))
        while total:
            size = min(self.window, 1 << (total.bit_length() - 1))
            total -= size
            runs, free = [], size
            while free:
                key, start, n = queue.pop()
                take = min(n, free)
                runs.append((key, start, take))
                free -= take
                if n > take:
                    queue.append((key, start + take, n - take))
            out.append((size, runs))
        return out


def pack(docs: DataFrame, path: str, window: int = 4096, end_id: int = 2, buffer_tokens: int = 4 << 20,
         step_tokens: int = 1 << 16) -> DataFrame:
    """One row per piece of docs(doc_id, text): see SCHEMA. `window` is a power of two."""
    _shared.small_batches(docs.sparkSession)
    if window < 64 or window & (window - 1):
        raise ValueError("window is a power of two, 64 at least")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, packer = encoder(path), Packer(window)
        end = np.array([end_id], "<u4").tobytes()
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 33
        state = {"next": 0, "groups": 0}
        held: dict[int, tuple] = {}  # key: (doc_id, tokens, ids); until all of them are in windows
        waiting: list[tuple[int, int, int]] = []

        def rows(windows):
            cols: list[list] = [[] for _ in range(9)]
            groups = balanced([size for size, _ in windows], step_tokens)
            for (size, runs), group in zip(windows, groups, strict=True):
                sequence, group, at = first + state["next"], first + state["groups"] + group, 0
                state["next"] += 1
                for key, start, n in runs:
                    doc_id, total, ids = held[key]
                    values = (doc_id, start, n, zlib.crc32(ids[4 * start:4 * (start + n)]), total, sequence, at, size, group)
                    for c, v in zip(cols, values, strict=True):
                        c.append(v)
                    at += n
            state["groups"] += max(groups, default=-1) + 1
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            for a in range(0, len(cols[0]), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(c[a:a + 8192], k) for c, k in zip(cols, kinds, strict=True)], names=names)

        key = tokens = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.encode(text or "") + end
                held[key] = (doc_id, len(ids) // 4, ids)
                waiting.append((key, 0, len(ids) // 4))
                tokens += len(ids) // 4
                key += 1
                if tokens >= buffer_tokens:
                    windows, waiting = packer.pack(waiting)
                    yield from rows(windows)
                    held = {k: held[k] for k, _, _ in waiting}
                    tokens = sum(n for _, _, n in waiting)
        windows, waiting = packer.pack(waiting)
        yield from rows(windows + packer.rest(waiting))

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, SCHEMA)
