"""Exact substring dedup by a common-prefix-aware distributed merge sort of suffixes.

A byte of a document is removed when a string of `length` bytes that covers it also starts in a
document with a smaller id. Only suffixes that can matter are sorted: every window of `length`
bytes has one anchor (its smallest k-mer under a fixed hash, leftmost on ties), chosen by the
window's bytes alone, so equal windows have equal anchors at equal offsets. Steps, all keyed by
blocks of a few hundred documents:

1. each block sends its distinct anchor hashes as sorted runs, by hash range; the receivers
   answer with bitmaps of those that other documents have too;
2. at such anchors it sends a hash of the context (all windows of this anchor), once a block, with
   the smallest document. All but the smallest holder of a context are settled by that, on 96 bits of
   hash (48 of the anchor or a second one of the context, 48 of the context), without a look at bytes;
   the rest matters only where another context of the anchor agrees with it on a side;
3. the suffixes at those anchors (with their left contexts) are sorted and sent as front-coded
   runs. A loser tree merges the runs: it compares known common-prefix lengths, and bytes only
   beyond them; the lengths that it finds give the windows shared with smaller documents;
4. each block applies the answers to its texts.

An anchor in more than `hot_docs` documents (a line that half of the corpus holds) is sent by
context and whole window, which spread by their own hash and shrink to one a block, so no
receiver gets a group that grows with the corpus other than one entry a block.

Blocks are dealt by a hash of id and text, so neither one id nor null ids fill a block. Nulls are
empty texts. Null ids sort last. Rows with equal ids never remove bytes of each other. An empty table
gives an empty result; other columns are not looked at unless carried, whatever their names."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import _shared

_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
_CHUNK = 1 << 19


def shape(length: int) -> tuple[int, int]:
    """k-mer length and k-mers per window (64 at most: offsets are bits of a word)."""
    w = min(64, length - max(1, int(length * 0.4)) + 1)
    return length - w + 1, w


def _mix(h):
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(32))
    return h * np.uint64(0x94D049BB133111EB)


_VALUES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
_OTHERS = _mix(_VALUES + np.uint64(_STEP))


def kmer_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every k bytes, by doubling."""
    have, size, done, out = _VALUES[buf], 1, 0, None
    while True:
        if k & size:
            if out is None:
                out, done = have, size
            else:
                n = min(len(out) - 0, len(have) - done)
                if n <= 0:
                    return np.empty(0, np.uint64)
                out = out[:n] * np.uint64(pow(_STEP, size, 1 << 64)) + have[done:done + n]
                done += size
        if size * 2 > k:
            break
        if len(have) <= size:
            return np.empty(0, np.uint64)
        have = have[:-size] * np.uint64(pow(_STEP, size, 1 << 64)) + have[size:]
        size *= 2
    return _mix(out[: max(0, len(buf) - k + 1)])


_power_cache = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int):
    """Powers of the hash base and of its inverse, n at least."""
    if len(_power_cache[0]) < n:
        for i, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            p = np.full(1 << n.bit_length(), base, np.uint64)
            p[0] = 1
            _power_cache[i] = np.multiply.accumulate(p)
    return _power_cache


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """Hashes of buf[start:end] for arrays of starts and ends; spans are shorter than a chunk of 1 MB.

    Sums of byte values times powers, taken from running sums over chunks of bounded size."""
    values = _VALUES if values is None else values
    out = np.empty(len(start), np.uint64)
    order = None if len(start) < 2 or (start[1:] >= start[:-1]).all() else np.argsort(start, kind="stable")
    s = start if order is None else start[order]
    e = end if order is None else end[order]
    at = 0
    while at < len(s):
        low = int(s[at])
        to = int(np.searchsorted(s, low + (1 << 20)))
        high = int(e[at:to].max())
        part = buf[low:high]
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * up[: len(part)], out=total[1:])
        found = _mix((total[e[at:to] - low] - total[s[at:to] - low]) * down[s[at:to] - low])
        if order is None:
            out[at:to] = found
        else:
            out[order[at:to]] = found
        at = to
    return out


def anchors(buf: np.ndarray, starts: np.ndarray, length: int):
    """(doc index, anchor, first window, last window, 48-bit hash) for the concatenated texts."""
    k, w = shape(length)
    ends = np.append(starts[1:], len(buf))
    found = []
    for c in range(0, max(0, len(buf) - length + 1), _CHUNK):
        part = buf[c:c + _CHUNK + length - 1]
        h = kmer_hashes(part, k)
        m = (h & np.uint64(_MASK ^ 0xFFFFF)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= w:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < w:
            m = np.minimum(m[: len(m) - (w - size)], m[w - size:])
        at = (m & np.uint64(0xFFFFF)).astype(np.int64)
        p = np.arange(len(at))
        doc = np.searchsorted(starts, p + c, side="right") - 1
        ok = p + c + length <= ends[doc]
        p, at, doc = p[ok], at[ok], doc[ok]
        if not len(p):
            continue
        new = np.empty(len(p), bool)
        new[0] = True
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(p)) - 1
        a = at[first]
        found.append((doc[first], a + c, p[first] + c, p[last] + c, _mix(h[a] + np.uint64(_STEP)) >> np.uint64(16)))
    if not found:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _joined(texts: list[bytes]):
    starts = np.zeros(len(texts), np.int64)
    if len(texts) > 1:
        starts[1:] = np.cumsum([len(t) for t in texts])[:-1]
    whole = b"".join(texts)
    # empty texts share their start with the next; keep the last, which is the one with bytes
    return whole, np.frombuffer(whole, np.uint8), starts


def six(values: np.ndarray) -> bytes:
    """48-bit values as six bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def by_range(values: np.ndarray, parts: int) -> np.ndarray:
    """Slice borders of sorted 48-bit values by equal hash ranges."""
    edges = (np.arange(1, parts, dtype=np.float64) * (2.0**48 / parts)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])


def distinct_hashes(hashes: np.ndarray, docs: np.ndarray):
    """Sorted distinct hashes of a block, and how many of its ids have each (255 at most)."""
    if len(docs) and int(docs.max()) >> 16:  # does not fit beside 48 bits
        order = np.lexsort((docs, hashes))
        h, d = hashes[order], docs[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        held = h[new]
    else:
        held = np.unique(hashes << np.uint64(16) | docs.astype(np.uint64)) >> np.uint64(16)
    values, counts = np.unique(held, return_counts=True)
    return values, np.minimum(counts, 255).astype(np.uint8)


def send_hashes(block: int, values: np.ndarray, counts: np.ndarray, parts: int):
    import pyarrow as pa

    cuts = by_range(values, parts)
    rows = [(p, cuts[p], cuts[p + 1]) for p in range(parts) if cuts[p + 1] > cuts[p]]
    return pa.table({
        "block": pa.array([block] * len(rows), pa.int32()), "part": pa.array([p for p, _, _ in rows], pa.int32()),
        "hashes": pa.array([six(values[a:b]) for _, a, b in rows], pa.binary()),
        "counts": pa.array([counts[a:b].tobytes() for _, a, b in rows], pa.binary())})


def answer_repeats(table, hot: int):
    """Receiver of step 1: for each run, bits of the hashes that several ids hold, and of those that more than `hot` hold."""
    import pyarrow as pa

    runs = [from_six(x) for x in table.column("hashes").to_pylist()]
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8)
    _, back = np.unique(np.concatenate(runs), return_inverse=True)
    total = np.bincount(back, weights=counts)[back]
    out, at = [], 0
    for r in runs:
        t = total[at:at + len(r)]
        at += len(r)
        out.append(np.packbits(t > 1).tobytes() + np.packbits(t > hot).tobytes())
    return pa.table({"block": table.column("block"), "part": table.column("part"), "bits": pa.array(out, pa.binary())})


def two_bits(data: bytes, n: int):
    half = len(data) // 2
    return tuple(np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x in (data[:half], data[half:]))


def read_bits(values: np.ndarray, replies: list, parts: int):
    """Bits that the receivers gave for a block's sorted hashes; replies: (part, bits)."""
    cuts = by_range(values, parts)
    multi, hot = np.zeros(len(values), bool), np.zeros(len(values), bool)
    for p, bits in replies:
        a, b = cuts[p], cuts[p + 1]
        multi[a:b], hot[a:b] = two_bits(bits, b - a)
    return multi, hot


class Contexts:
    """A block's distinct contexts (all windows of one anchor occurrence) at repeated anchors.

    For each: key (the anchor's hash, or a second one of its own if the anchor is hot), hash, smallest id, side
    prints, and its first occurrence; for each occurrence the context that it has."""

    def __init__(self, buf, found, ids, multi, hot, values, length):
        k, _ = shape(length)
        doc, a, p, q, h = found
        where = np.searchsorted(values, h)
        keep = multi[where]
        self.id, self.a, self.p, self.q = np.array(ids, np.int64)[doc[keep]], a[keep], p[keep], q[keep]
        self.length, is_hot, h = length, hot[where[keep]], h[keep]
        whole = span_hashes(buf, self.p, self.q + length)
        ctx = _mix(whole + (self.a - self.p).astype(np.uint64) * np.uint64(_STEP) + (self.q - self.p).astype(np.uint64)) >> np.uint64(16)
        key = h.copy()
        if is_hot.any():  # a second hash of the context, of other byte values
            key[is_hot] = _mix(span_hashes(buf, self.p[is_hot], self.q[is_hot] + length, _OTHERS) + (self.a - self.p)[is_hot].astype(np.uint64)) >> np.uint64(16)
        order = np.lexsort((self.id, ctx, key, is_hot))
        ctx_o, hot_o, key_o = ctx[order], is_hot[order], key[order]
        new = np.ones(len(order), bool)
        new[1:] = (ctx_o[1:] != ctx_o[:-1]) | (key_o[1:] != key_o[:-1]) | (hot_o[1:] != hot_o[:-1])
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.first = order[new]
        self.key, self.ctx, self.hot = key_o[new], ctx_o[new], hot_o[new]
        self.least = self.id[self.first]
        # a window reaches `side` bytes beyond the k-mer on the left or on the right
        side = (length - k) // 2
        a1 = self.a[self.first]
        left, right = a1 - self.p[self.first], self.q[self.first] + length - a1 - k
        self.left_ok, self.right_ok = left >= side, right >= side
        print_of = lambda s, e: (span_hashes(buf, s, e) >> np.uint64(48)).astype(np.uint16)
        self.left = print_of(np.where(self.left_ok, a1 - side, a1), a1)
        self.right = print_of(a1 + k, np.where(self.right_ok, a1 + k + side, a1 + k))

    def ranges(self, parts: int):
        """(part, from, to): even parts hold plain anchors by key range, odd ones hot contexts."""
        n = int(np.searchsorted(self.hot, True))
        for hot, offset, values in ((0, 0, self.key[:n]), (1, n, self.key[n:])):
            cuts = by_range(values, parts)
            for p in range(parts):
                if cuts[p + 1] > cuts[p]:
                    yield 2 * p + hot, offset + int(cuts[p]), offset + int(cuts[p + 1])

    def send(self, block: int, parts: int):
        import pyarrow as pa

        rows = [(p, b"".join([six(self.key[x:y]), six(self.ctx[x:y]), self.left[x:y].tobytes(), self.right[x:y].tobytes(),
                              np.packbits(self.left_ok[x:y]).tobytes(), np.packbits(self.right_ok[x:y]).tobytes(),
                              np.ascontiguousarray(self.least[x:y].view(np.uint8).reshape(-1, 8).T).tobytes()]), y - x)
                for p, x, y in self.ranges(parts)]
        return pa.table({"block": pa.array([block] * len(rows), pa.int32()), "part": pa.array([r[0] for r in rows], pa.int32()),
                         "n": pa.array([r[2] for r in rows], pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})

    def read(self, replies: list, parts: int):
        """For each context: a smaller id elsewhere has all of it; its windows are to be compared."""
        done, open_ = np.zeros(len(self.key), bool), np.zeros(len(self.key), bool)
        given = dict(replies)
        for p, x, y in self.ranges(parts):
            if p in given:
                done[x:y], open_[x:y] = two_bits(given[p], y - x)
        return done, open_

    def suffixes(self, whole: bytes, open_):
        """Suffixes to compare: plain [(right, left), id, context] and hot {window: smallest id}."""
        plain, hot = [], {}
        for c in np.flatnonzero(open_).tolist():
            e = self.first[c]
            a, p, q, i = int(self.a[e]), int(self.p[e]), int(self.q[e]), int(self.least[c])
            if self.hot[c]:
                for y in range(p, q + 1):
                    w = whole[y:y + self.length]
                    if hot.setdefault(w, i) > i:
                        hot[w] = i
            else:
                plain.append(((whole[a:q + self.length], whole[p:a]), i, c))
        return plain, hot


def answer_contexts(table):
    """Receiver of step 2: two bits for each context sent, see Contexts.read."""
    import pyarrow as pa

    fields: list[list] = [[] for _ in range(7)]
    sizes = table.column("n").to_pylist()
    is_hot = table.column("part").to_pylist()[0] & 1
    for n, data in zip(sizes, table.column("data").to_pylist(), strict=True):
        bits = -(-n // 8)
        at = np.cumsum([0, 6 * n, 6 * n, 2 * n, 2 * n, bits, bits, 8 * n]).tolist()
        piece = [data[x:y] for x, y in zip(at, at[1:], strict=False)]
        values = [from_six(piece[0]), from_six(piece[1]), np.frombuffer(piece[2], np.uint16), np.frombuffer(piece[3], np.uint16),
                  *(np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x in piece[4:6]),
                  np.ascontiguousarray(np.frombuffer(piece[6], np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1)]
        for f, v in zip(fields, values, strict=True):
            f.append(v)
    key, ctx, left, right, left_ok, right_ok, ids = (np.concatenate(f) for f in fields)
    order = np.lexsort((ids, ctx, key))
    k, c = key[order], ctx[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    done = np.empty(len(k), bool)
    done[order] = ids[order] > ids[order][new][np.cumsum(new) - 1]  # rows of the smallest id may be in several blocks
    open_ = np.zeros(len(k), bool)
    lead = order[new]
    if is_hot:
        open_[lead] = True
    else:
        for prints, ok in ((left, left_ok), (right, right_ok)):
            mine = lead[ok[lead]]
            _, back, counts = np.unique(key[mine] << np.uint64(16) | prints[mine].astype(np.uint64), return_inverse=True, return_counts=True)
            open_[mine[counts[back] > 1]] = True
    out, at = [], 0
    for n in sizes:
        out.append(np.packbits(done[at:at + n]).tobytes() + np.packbits(open_[at:at + n]).tobytes())
        at += n
    return pa.table({"block": table.column("block"), "part": table.column("part"), "bits": pa.array(out, pa.binary())})


def dealt(plain: list, hot: dict, k: int, parts: int):
    """Sorted runs [((right, left), id, context)] by part: even parts by anchor, odd ones by window."""
    import zlib

    runs: dict[int, list] = {}
    for x in plain:
        runs.setdefault(2 * (zlib.crc32(x[0][0][:k]) % parts), []).append(x)
    for w, i in hot.items():
        runs.setdefault(2 * (zlib.crc32(w) % parts) + 1, []).append(((w, b""), i, -1))
    for run in runs.values():
        run.sort()
    return runs


def front_coded(keys: list, ids: list[int]) -> bytes:
    """A sorted run: counts and lengths, then the bytes that differ from the suffix before."""
    lcp, tails, before = [], [], b""
    for right, _ in keys:
        n = common(before, right, 0)
        lcp.append(n)
        tails.append(right[n:])
        before = right
    head = np.array([len(keys)], "<u4").tobytes()
    return b"".join([head, np.array(lcp, "<u2").tobytes(), np.array([len(t) for t in tails], "<u2").tobytes(),
                     np.array([len(x) for _, x in keys], "<u2").tobytes(), np.array(ids, "<i8").tobytes(),
                     *tails, *[x for _, x in keys]])


def decoded(data: bytes):
    """Of a front-coded run: (suffix, common prefix with the one before, left context, id)."""
    n = int(np.frombuffer(data, "<u4", 1)[0])
    lcp, tail, left = (np.frombuffer(data, "<u2", n, 4 + 2 * n * i).tolist() for i in range(3))
    ids = np.frombuffer(data, "<i8", n, 4 + 6 * n).tolist()
    at = 4 + 14 * n
    back = at + sum(tail)
    before = b""
    for i in range(n):
        before = before[: lcp[i]] + data[at:at + tail[i]]
        at += tail[i]
        yield before, lcp[i], data[back:back + left[i]], ids[i]
        back += left[i]


def common(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes need no look."""
    n = min(len(x), len(y))
    a, b = x[known:n], y[known:n]
    if a == b:
        return n
    return known + (len(a) * 8 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length()) // 8


def merged(runs: list):
    """LCP loser tree: yields (suffix, common prefix with the last one out, left, id, run) in order.

    A head carries its common prefix with the last suffix out. Of two heads the one with the longer
    such prefix is smaller, without a look at bytes; on a tie bytes beyond it decide, and the loser
    then knows its common prefix with the winner, which is the next one out on that path."""
    size = 1
    while size < max(1, len(runs)):
        size *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (size - len(runs))
    lcps = [0] * size
    lost = [0] * size

    def play(i: int, j: int) -> tuple[int, int]:
        x, y = heads[i], heads[j]
        if x is None:
            return j, i
        if y is None:
            return i, j
        p, q = lcps[i], lcps[j]
        if p != q:
            return (i, j) if p > q else (j, i)
        n = common(x[0], y[0], p)
        if n == len(x[0]) or (n < len(y[0]) and x[0][n] < y[0][n]):
            lcps[j] = n
            return i, j
        lcps[i] = n
        return j, i

    won = list(range(size))
    level, base = size, size
    while level > 1:
        after = []
        for t in range(0, level, 2):
            w, x = play(won[t], won[t + 1])
            lost[(base + t) // 2] = x
            after.append(w)
        won, level, base = after, level // 2, base // 2
    best = won[0]
    while heads[best] is not None:
        suffix, _, left, i = heads[best]
        yield suffix, lcps[best], left, i, best
        heads[best] = after = next(runs[best], None)
        lcps[best] = after[1] if after else 0
        node = (best + size) // 2
        while node:
            best, lost[node] = play(best, lost[node])
            node //= 2


def shared_windows(group: list, length: int) -> list[int]:
    """For entries (suffix, lcp, left, id) of one anchor, in order: the offsets, as bits, of the
    windows that an entry with a smaller id has too."""
    n = len(group)
    if n == 1:
        return [0]
    masks = [0] * n
    if n <= 8:
        for i in range(n):
            right_i, _, left_i, id_i = group[i]
            match = len(right_i)
            for j in range(i + 1, n):
                right_j, lcp, left_j, id_j = group[j]
                match = min(match, lcp)
                if id_i == id_j:
                    continue
                low = length - match
                if low > min(len(left_i), len(left_j)):
                    continue
                back = common(left_i[::-1], left_j[::-1], 0)
                if low <= back:
                    masks[i if id_i > id_j else j] |= (2 << back) - (1 << low)
        return masks
    owner: dict[bytes, int] = {}
    for right, _, left, i in group:
        for o in range(length - len(right), len(left) + 1):
            key = left[len(left) - o:] + right[: length - o]
            if owner.setdefault(key, i) > i:
                owner[key] = i
    for x, (right, _, left, i) in enumerate(group):
        for o in range(length - len(right), len(left) + 1):
            if owner[left[len(left) - o:] + right[: length - o]] < i:
                masks[x] |= 1 << o
    return masks


def answer_windows(table, length: int):
    """Receiver of step 3: a word of offset bits for each suffix of each run."""
    import pyarrow as pa

    k, _ = shape(length)
    kind = table.column("part").to_pylist()[0] & 1
    same = k if kind == 0 else length
    payloads = table.column("run").to_pylist()
    masks: list[list[int]] = [[] for _ in payloads]
    group, owners = [], []

    def close():
        for run, mask in zip(owners, shared_windows(group, length), strict=True):
            masks[run].append(mask)

    for suffix, lcp, left, i, run in merged([decoded(x) for x in payloads]):
        if group and lcp < same:
            close()
            group, owners = [], []
        group.append((suffix, lcp, left, i))
        owners.append(run)
    if group:
        close()
    return pa.table({"block": table.column("block"), "part": table.column("part"),
                     "bits": pa.array([np.array(m, "<u8").tobytes() for m in masks], pa.binary())})


def suffix_dedup(docs: DataFrame, length: int = 50, rows_per_block: int = 512, hot_docs: int = 4096,
                 whole_chars: bool = False, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, end>>, kept binary) for every row of docs(doc_id, text).

    whole_chars: a character goes only with all of its bytes. carry: columns that go along, as a struct `carry`."""
    spark = docs.sparkSession
    _shared.small_batches(spark)
    packed, blocks = _shared.packed_blocks(docs, rows_per_block, carry)
    parts = _shared.receivers(spark, blocks)
    k, _ = shape(length)

    def prepare(table):
        ids, texts, _ = _shared.unpack(table)
        whole, buf, starts = _joined(texts)
        found = anchors(buf, starts, length)
        rank = {i: n for n, i in enumerate(dict.fromkeys(ids))}
        order = np.array([rank[i] for i in ids], np.int64)
        values, counts = distinct_hashes(found[4], order[found[0]])
        return ids, texts, whole, buf, starts, found, values, counts

    def replies_of(table, step: int):
        import pyarrow.compute as pc

        mine = table.filter(pc.equal(table.column("step"), step))
        return list(zip(mine.column("part").to_pylist(), mine.column("bits").to_pylist(), strict=True))

    def contexts_of(table, replies):
        ids, texts, whole, buf, starts, found, values, _ = prepare(table)
        multi, hot = read_bits(values, replies_of(replies, 1), parts)
        return ids, texts, whole, starts, Contexts(buf, found, ids, multi, hot, values, length)

    def send_anchors(key, table):
        *_, values, counts = prepare(table)
        return send_hashes(key[0].as_py(), values, counts, parts)

    def send_contexts(key, table, replies):
        return contexts_of(table, replies)[4].send(key[0].as_py(), parts)

    def send_suffixes(key, table, replies):
        import pyarrow as pa

        _, _, whole, _, contexts = contexts_of(table, replies)
        _, open_ = contexts.read(replies_of(replies, 2), parts)
        rows = [(p, front_coded([x[0] for x in run], [x[1] for x in run]))
                for p, run in dealt(*contexts.suffixes(whole, open_), k, parts).items()]
        return pa.table({"block": pa.array([key[0].as_py()] * len(rows), pa.int32()),
                         "part": pa.array([p for p, _ in rows], pa.int32()), "run": pa.array([r for _, r in rows], pa.binary())})

    def apply(key, table, replies):
        import pyarrow as pa

        ids, texts, whole, starts, c = contexts_of(table, replies)
        done, open_ = c.read(replies_of(replies, 2), parts)
        plain, hot = c.suffixes(whole, open_)
        runs, mask_of, window_of = dealt(plain, hot, k, parts), {}, {}
        for p, m in replies_of(replies, 3):
            for (pair, _, x), mask in zip(runs[p], np.frombuffer(m, "<u8").tolist(), strict=True):
                if p & 1:
                    window_of[pair[0]] = mask
                else:
                    mask_of[x] = mask
        total = sum(map(len, texts))
        edge = np.zeros(total + length + 1, np.int32)
        # a smaller id, elsewhere or in this block, has all windows of the context
        full = done[c.of] | (c.id > c.least[c.of])
        np.add.at(edge, c.p[full], 1)
        np.add.at(edge, c.q[full] + length, -1)
        begin, end = [], []
        for e in np.flatnonzero(~full & open_[c.of]).tolist():
            x, a, p, q = int(c.of[e]), int(c.a[e]), int(c.p[e]), int(c.q[e])
            if c.hot[x]:
                for y in range(p, q + 1):
                    w = whole[y:y + length]
                    if window_of[w] or hot[w] < c.id[e]:
                        begin.append(y)
                        end.append(y + length)
                continue
            mask = mask_of[x]
            while mask:  # runs of bits
                low = (mask & -mask).bit_length() - 1
                high = low
                while mask >> (high + 1) & 1:
                    high += 1
                begin.append(a - high)
                end.append(a - low + length)
                mask &= ~((2 << high) - (1 << low))
        np.add.at(edge, np.array(begin, np.int64), 1)
        np.add.at(edge, np.array(end, np.int64), -1)
        gone = np.cumsum(edge)[:total] > 0
        if whole_chars and total:
            heads = np.flatnonzero((np.frombuffer(whole, np.uint8) & 0xC0) != 0x80)
            gone = np.repeat(np.logical_and.reduceat(gone, heads), np.diff(np.append(heads, total)))
        spans, kept = [], []
        for text, s in zip(texts, starts.tolist(), strict=True):
            mine = gone[s:s + len(text)]
            if not mine.any():
                spans.append([])
                kept.append(text)
                continue
            turn = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
            spans.append([{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)])
            kept.append(np.frombuffer(text, np.uint8)[~mine].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        out = {"doc_id": pa.array([None if i == _shared.NO_ID else i for i in ids], pa.int64()),
               "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
               "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())}
        if carry:
            out["carry"] = table.column("carry").take(pa.array(_shared.unpack(table)[2]))
        return pa.table(out)

    # every step reads the same exchange of packed texts
    by_block = lambda *replies: packed.groupBy("block").cogroup(
        reduce(DataFrame.unionByName, replies).groupBy("block"))
    answer = lambda sent, f, step: sent.groupBy("part").applyInArrow(
        f, "block int, part int, bits binary").withColumn("step", F.lit(step))
    first = answer(packed.groupBy("block").applyInArrow(send_anchors, "block int, part int, hashes binary, counts binary"),
                   lambda table: answer_repeats(table, hot_docs), 1)
    second = answer(by_block(first).applyInArrow(send_contexts, "block int, part int, n int, data binary"), answer_contexts, 2)
    third = answer(by_block(first, second).applyInArrow(send_suffixes, "block int, part int, run binary"),
                   lambda table: answer_windows(table, length), 3)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()),
                           T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
                           T.StructField("kept", T.BinaryType()), *[f for f in packed.schema.fields if f.name == "carry"]])
    return by_block(first, second, third).applyInArrow(apply, schema)


def digest(deduped: DataFrame) -> DataFrame:
    """The contract's columns."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return deduped.select("doc_id", "n_bytes", removed.alias("n_removed"),
                          F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
