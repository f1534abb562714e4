"""Prefix trie of conversations by a Cartesian tree over their LCP array.

1. Turns become hashes of (role, text), 128 bits; texts are not shuffled. Turns are sorted by range of (conversation,
   turn), so one conversation of very many turns lies in several tasks, each of which gives one segment of its key:
   16 bytes a turn. Segments are put together, and each conversation is rebuilt (see `rebuilt`).
2. Equal sequences are one row with their number; the hash of their members' ids is streamed in order of the ids.
3. Distinct sequences are sorted by range of their keys. LCP[p] is the number of turns that sequence p shares with
   the one before it, -1 at either end of the array.
4. All nearest smaller values: a block of the array finds them with a stack. What it cannot find inside, it asks of
   the nearest block whose minimum is small enough; requests are one for each value, block and side.
5. Position p with the nearest smaller values l and r1 is the node of depth LCP[p] over the sequences l to r1 - 1;
   positions of equal (l, depth) are one node. Sequences that are no prefix of the next one are leaves. The depths
   between a node and its parent, the larger of LCP[l] and LCP[r1], are filled in.
6. Members, smallest members and leaves of an interval come from prefix sums and minima of blocks, sums over
   subtrees from prefix sums over positions.

The driver holds a few numbers for each block of sequences. Rows of a null conv_id are no conversation. Turns of
equal number are ordered by hash; repeated rows are turns of their own. A conversation's key is one row, as a text is.
An empty table has no node. Other columns are not read."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm._shared import columns, cut, drop, module_path, partitions

WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()
_BIG = (1 << 63) - 1


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, hash, words) of conversations(conv_id, turn, role, text)."""
    rows = columns(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("hash"),
                       F.regexp_count(text, F.lit(WORD)).cast("int").alias("words"))


def _segments(batches):
    """(conv_id, block, key, words) of each run of a conversation in a sorted task."""
    import numpy as np
    import pyarrow as pa

    block, now, key, words, out = TaskContext.get().partitionId(), None, [], [], []

    def batch():
        ids, keys, lists = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([block] * len(ids), pa.int32()), pa.array(keys, pa.binary()),
                                           pa.array(lists, pa.list_(pa.int32()))], names=["conv_id", "block", "key", "words"])

    for part in batches:
        if not part.num_rows:
            continue
        ids, count = part.column(0).to_numpy(), part.column(3).to_numpy()
        hashes = b"".join(part.column(2).to_pylist())
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if now is not None and ids[a] != now:
                out.append((now, b"".join(key), np.concatenate(words)))
                key, words = [], []
            now = int(ids[a])
            key.append(hashes[16 * a:16 * b])
            words.append(count[a:b])
        if len(out) >= 4096:
            yield batch()
            out.clear()
    if now is not None:
        out.append((now, b"".join(key), np.concatenate(words)))
        yield batch()


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, words): 16 bytes and a number of words for each turn, in order of the turns."""
    order = ["conv_id", "turn", "hash", "salt"]  # the salt parts equal rows
    placed = turns(conversations).withColumn("salt", F.rand(7))
    placed = placed.repartitionByRange(partitions(conversations.sparkSession), *order).sortWithinPartitions(*order)
    parts = placed.select("conv_id", "turn", "hash", "words").mapInArrow(_segments, "conv_id long, block int, key binary, words array<int>")
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "key", "words"))).alias("p"))
    return whole.select("conv_id", F.aggregate("p", F.lit(bytearray()), lambda a, x: F.concat(a, x["key"])).alias("key"),
                        F.flatten(F.transform("p", lambda x: x["words"])).alias("words"))


def rebuilt(own: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose first h turns are those of conversation c - c % every (fewer if it has fewer, none if it is
    absent), then their own from turn h on; h is crc32(c) % most. `own`: a written table, it is read twice."""
    head = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("g"), F.substring("key", 1, 16 * most).alias("head"),
                                                           F.slice("words", 1, most).alias("head_words"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    mine = own.withColumns({"g": F.col("conv_id") - F.col("conv_id") % every, "h": h}).join(head, "g", "left")
    key = F.concat(F.coalesce(F.substring(F.col("head"), F.lit(1), 16 * F.col("h")), F.lit(bytearray())),
                   F.substring(F.col("key"), 16 * F.col("h") + 1, F.octet_length("key")))
    words = F.concat(F.coalesce(F.slice("head_words", F.lit(1), F.col("h")), F.array().cast("array<int>")), F.slice("words", F.col("h") + 1, F.size("words")))
    return mine.select("conv_id", key.alias("key"), words.alias("words"))


def _pieces(batches, most: int = 4096):
    """(kid, least, n, ids): runs of ids of equal sequences, at most `most` a piece, of a task sorted by (kid, conv_id)."""
    import pyarrow as pa

    def batch(rows):
        kid, least, n, ids = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(kid, pa.binary()), pa.array(least, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string())],
                                          names=["kid", "least", "n", "ids"])

    now, ids, out = None, [], []
    for part in batches:
        for kid, conv in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            if kid != now or len(ids) == most:
                if ids:
                    out.append((now, ids[0], len(ids), ",".join(map(str, ids))))
                now, ids = kid, []
            ids.append(conv)
        if len(out) >= 1024:
            yield batch(out)
            out = []
    if ids:
        out.append((now, ids[0], len(ids), ",".join(map(str, ids))))
    if out:
        yield batch(out)


def _streamed(batches):
    """(conv_id, copies, sha) of each kid, its pieces read in order; a hash's state is all that is kept."""
    import pyarrow as pa

    def batch(rows):
        conv, n, sha = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["conv_id", "copies", "sha"])

    now, conv, copies, state, out = None, 0, 0, None, []
    for part in batches:
        for kid, least, n, ids in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
            if kid != now:
                if state is not None:
                    out.append((conv, copies, state.hexdigest()))
                now, conv, copies, state = kid, least, 0, hashlib.sha256()
            else:
                state.update(b",")
            copies += n
            state.update(ids.encode())
        if len(out) >= 4096:
            yield batch(out)
            out = []
    if state is not None:
        out.append((conv, copies, state.hexdigest()))
    if out:
        yield batch(out)


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """(conv_id, copies, sha): the smallest conversation of each sequence, and the hash of the ids of all its copies."""
    n = partitions(convs.sparkSession)
    ids = convs.select(F.unhex(F.md5("key")).alias("kid"), "conv_id").repartitionByRange(n, "kid", "conv_id").sortWithinPartitions("kid", "conv_id")
    pieces = ids.mapInArrow(_pieces, "kid binary, least long, n long, ids string")
    return pieces.repartition(n, "kid").sortWithinPartitions("kid", "least").mapInArrow(_streamed, "conv_id long, copies long, sha string")


def shared(a: bytes, b: bytes) -> int:
    """Turns that two keys share at their beginning."""
    low, high = 0, min(len(a), len(b)) // 16
    step = 1
    while low < high:  # steps double while they hold, then halve
        to = min(low + step, high)
        if a[16 * low:16 * to] == b[16 * low:16 * to]:
            low, step = to, 2 * step
        elif to == low + 1:
            return low
        else:
            high, step = to - 1, 1
    return low


class _Block:
    """A block of the sorted sequences as arrays; with `grid` (what the driver knows of all blocks) at its place."""

    def __init__(self, table, grid=None):
        import numpy as np

        rows = table.select(["key", "conv_id", "copies", "sha", "words"]).combine_chunks().sort_by("key")
        self.keys, self.sha, self.words = rows["key"].to_pylist(), rows["sha"].to_pylist(), rows["words"]
        self.conv, self.copies = rows["conv_id"].to_numpy(), rows["copies"].to_numpy()
        self.n = len(self.keys)
        self.lens = np.array([len(k) // 16 for k in self.keys], np.int64)
        self.lcp = np.array([-1, *(shared(a, b) for a, b in zip(self.keys, self.keys[1:], strict=False))], np.int64)
        if grid:
            self.at = b = grid["order"][table["block"][0].as_py()]
            self.lcp[0], self.start = grid["first"][b], int(grid["start"][b])
            self.next = np.append(self.lcp[1:], grid["first"][b + 1])
            self.leaf = self.next < self.lens
            self.before = grid["copies"][b] + np.append(0, np.cumsum(self.copies))  # members before position, and at the end
            self.leaves = grid["leaves"][b] + np.append(0, np.cumsum(self.leaf))

    def smaller(self, left: bool) -> list:
        """Place of the nearest smaller value on a side, or None: by a stack."""
        out, stack, lcp = [None] * self.n, [], self.lcp.tolist()
        for i in range(self.n) if left else range(self.n - 1, -1, -1):
            while stack and lcp[stack[-1]] >= lcp[i]:
                stack.pop()
            out[i] = stack[-1] if stack else None
            stack.append(i)
        return out


def _summary(table):
    """One row of a block: what others need to know of it, and its first and last key."""
    import pyarrow as pa

    x = _Block(table)
    row = {"block": table["block"][0].as_py(), "n": x.n, "least": int(x.conv.min()), "copies": int(x.copies.sum()), "inner": int((x.lcp[1:] < x.lens[:-1]).sum()),
           "low": int(x.lcp[1:].min()) if x.n > 1 else _BIG, "head": x.keys[0], "tail": x.keys[-1], "last_len": int(x.lens[-1]), "last_sha": x.sha[-1]}
    return pa.Table.from_pylist([row], pa.schema([("block", pa.int32()), *((c, pa.int64()) for c in ("n", "least", "copies", "inner", "low")),
                                                  ("head", pa.binary()), ("tail", pa.binary()), ("last_len", pa.int64()), ("last_sha", pa.string())]))


def _grid(blocks: DataFrame) -> dict:
    """What the driver tells all tasks: arrays with a few numbers for each block of sequences."""
    import numpy as np

    @F.pandas_udf("long")
    def lcp(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([-1 if x is None else shared(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")

    known = blocks.groupBy("block").applyInArrow(_summary, "block int, n long, least long, copies long, inner long, low long, head binary, tail binary, last_len long, last_sha string")
    chain = known.withColumn("before", F.lag("tail").over(Window.partitionBy(F.lit(1)).orderBy("block")))  # a row a block
    rows = chain.select("block", "n", "least", "copies", "inner", "low", "last_len", "last_sha", lcp("before", "head").alias("first")).orderBy("block").collect()
    first = np.array([r["first"] for r in rows] + [-1], np.int64)
    total = lambda values: np.append(0, np.cumsum(np.array(values, np.int64)))
    least = [np.array([r.least for r in rows], np.int64)]
    while 2 ** len(least) <= len(rows):  # minima of 1, 2, 4 ... blocks
        half = 2 ** (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    return {"order": {r.block: i for i, r in enumerate(rows)}, "first": first, "start": total([r.n for r in rows]), "copies": total([r.copies for r in rows]),
            "leaves": total([r.inner + (first[i + 1] < r.last_len) for i, r in enumerate(rows)]), "least": least,
            "low": np.minimum([r.low for r in rows], first[:-1]), "last": [(r.last_len, r.last_sha) for r in rows]}


def _least(tables, a: int, b: int) -> int:
    """The smallest of the places a to b - 1."""
    if a >= b:
        return _BIG
    level = (b - a).bit_length() - 1
    return int(min(tables[level][a], tables[level][b - 2**level]))


_REQUEST = "target int, block int, left boolean, v long"
_ANSWER = "block int, left boolean, v long, place long, value long, members long, leaves long, edge long"
_PLACE = ("leaf boolean, i long, l long, r1 long, depth long, above long, parent long, conv_id long, n_convs long, n_leaves long, n_equal long, "
          "ended int, sha string, words array<int>")


def _requests(grid):
    def run(table):
        import numpy as np
        import pyarrow as pa

        x, out, name = _Block(table, grid), [], table["block"][0].as_py()
        names = {i: b for b, i in grid["order"].items()}
        for left in (True, False):
            for v in {int(x.lcp[i]) for i, j in enumerate(x.smaller(left)) if j is None} - {-1}:
                found = np.flatnonzero(grid["low"][:x.at] < v) if left else x.at + 1 + np.flatnonzero(grid["low"][x.at + 1:] < v)
                if len(found):  # none on the right: the array ends
                    out.append({"target": names[int(found[-1 if left else 0])], "block": name, "left": left, "v": v})
        return pa.Table.from_pylist(out, pa.schema([("target", pa.int32()), ("block", pa.int32()), ("left", pa.bool_()), ("v", pa.int64())]))

    return run


def _answers(grid):
    def run(asked, table):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("block", pa.int32()), ("left", pa.bool_()), *((c, pa.int64()) for c in ("v", "place", "value", "members", "leaves", "edge"))])
        if not asked.num_rows:
            return schema.empty_table()
        x, known, out = _Block(table, grid), {}, []
        for r in asked.to_pylist():
            if (r["left"], r["v"]) not in known:
                j = int(np.flatnonzero(x.lcp < r["v"])[-1 if r["left"] else 0])
                edge = x.conv[j:] if r["left"] else x.conv[:j]
                known[r["left"], r["v"]] = {"place": x.start + j, "value": int(x.lcp[j]), "members": int(x.before[j]), "leaves": int(x.leaves[j]),
                                            "edge": int(edge.min()) if len(edge) else _BIG}
            out.append({"block": r["block"], "left": r["left"], "v": r["v"], **known[r["left"], r["v"]]})
        return pa.Table.from_pylist(out, schema)

    return run


def _places(grid):
    def run(answers, table):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("leaf", pa.bool_()), *((c, pa.int64()) for c in ("i", "l", "r1", "depth", "above", "parent", "conv_id", "n_convs", "n_leaves", "n_equal")),
                            ("ended", pa.int32()), ("sha", pa.string()), ("words", pa.list_(pa.int32()))])
        x, end = _Block(table, grid), len(grid["low"])
        known = {(r["left"], r["v"]): r for r in answers.to_pylist()}
        far = {"place": int(grid["start"][end]), "value": -1, "members": int(grid["copies"][end]), "leaves": int(grid["leaves"][end]), "edge": _BIG}
        least = [x.conv]
        while 2 ** len(least) <= x.n:
            half = 2 ** (len(least) - 1)
            least.append(np.minimum(least[-1][:-half], least[-1][half:]))
        block_of = lambda p: int(np.searchsorted(grid["start"], p, "right")) - 1
        words = lambda i, above, depth: [0] * (above < 0) + x.words[i].as_py()[max(above, 0):depth]
        own: dict = {}
        rows = []
        lefts, rights, lcp = x.smaller(True), x.smaller(False), x.lcp.tolist()
        for i in range(x.n):
            p, v = x.start + i, lcp[i]
            if p:
                if lefts[i] is not None:
                    j = lefts[i]
                    l, low, from_, leaves, a, conv = x.start + j, lcp[j], x.before[j], x.leaves[j], j, _BIG
                else:
                    r = known[True, v]
                    l, low, from_, leaves, a = r["place"], r["value"], r["members"], r["leaves"], 0
                    conv = min(r["edge"], _least(grid["least"], block_of(l) + 1, x.at))
                if rights[i] is not None:
                    j = rights[i]
                    r1, high, to, leaves_to, b = x.start + j, lcp[j], x.before[j], x.leaves[j], j
                else:
                    r = known.get((False, v), far)
                    r1, high, to, leaves_to, b = r["place"], r["value"], r["members"], r["leaves"], x.n
                    conv = min(conv, r["edge"], _least(grid["least"], x.at + 1, end if r is far else block_of(r1)))
                above = max(low, high)
                first = own.get((l, v))
                row = {"leaf": False, "i": p, "l": l, "depth": v, "conv_id": min(conv, _least(least, a, b)), "n_equal": 0}
                if first:
                    first["n_equal"] += 1
                else:
                    own[l, v] = row
                    last, sha = (int(x.lens[i - 1]), x.sha[i - 1]) if i else grid["last"][x.at - 1]
                    ended = l == p - 1 and last == v
                    row |= {"r1": r1, "above": above, "parent": l if low >= high else r1, "n_convs": int(to - from_), "n_leaves": int(leaves_to - leaves), "n_equal": 1,
                            "ended": int(ended), "sha": sha if ended else None, "words": words(i, above, v)}
                rows.append(row)
            if x.leaf[i]:
                low, high, depth, n = v, int(x.next[i]), int(x.lens[i]), int(x.copies[i])
                above = max(low, high)
                rows.append({"leaf": True, "i": p, "l": p, "r1": p + 1, "depth": depth, "above": above, "parent": p if low >= high else p + 1, "conv_id": int(x.conv[i]),
                             "n_convs": n, "n_leaves": 1, "n_equal": 0, "ended": 1, "sha": x.sha[i], "words": words(i, above, depth) if n > 1 else None})
        return pa.Table.from_pylist(rows, schema)

    return run


def _expanded(batches):
    """A row for each depth of a node, from below its parent down to its own."""
    import pyarrow as pa

    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    kinds = [pa.int64()] * 7 + [pa.string()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    out: list = []
    for part in batches:
        for r in part.to_pylist():
            saved, n, parent = r["saved"], r["n_convs"], r["parent_conv_id"]
            for step, depth in enumerate(range(r["above"] + 1, r["depth"] + 1)):
                last = depth == r["depth"]
                out.append((r["conv_id"], depth, parent if depth else None, n, r["n_children"] if last else 1, r["n_leaves"], saved,
                            (r["sha"] or EMPTY) if last else EMPTY))
                parent = r["conv_id"]
                if r["words"] is not None:
                    saved -= (n - 1) * r["words"][step]
                if len(out) == 8192:
                    yield batch(out)
                    out = []
    if out:
        yield batch(out)


def nodes(convs: DataFrame, per_block: int = 20_000, per_chunk: int = 65_536) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, key, words), a written table: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = convs.sparkSession
    module_path(spark)
    distinct = cut(distinct_sequences(convs), "trie-distinct")
    count = distinct.count()
    if not count:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    keyed = distinct.join(convs, "conv_id").select("conv_id", "copies", "sha", "key", "words")
    blocks = cut(keyed.repartitionByRange(math.ceil(count / per_block), "key").withColumn("block", F.spark_partition_id()), "trie-blocks")
    drop(distinct)
    grid = _grid(blocks)
    asked = blocks.groupBy("block").applyInArrow(_requests(grid), _REQUEST)
    answers = asked.groupBy("target").cogroup(blocks.groupBy("block")).applyInArrow(_answers(grid), _ANSWER)
    places = cut(answers.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(_places(grid), _PLACE), "trie-places")
    drop(blocks)

    one = lambda c: F.first(c, ignorenulls=True).alias(c)  # noqa: E731  all that are not null are equal
    inner = places.where("not leaf and n_equal > 0").groupBy("l", "depth").agg(
        F.min("i").alias("i"), F.sum("n_equal").alias("n_equal"), F.max("ended").alias("ended"), *[F.max(c).alias(c) for c in ("r1", "above", "parent", "conv_id", "n_convs", "n_leaves", "sha")], one("words"))
    both = inner.withColumn("n_children", F.col("n_equal") + 1 - F.col("ended")).withColumn("leaf", F.lit(False)).unionByName(
        places.where("leaf").withColumn("n_children", F.lit(0).cast("long")))
    own = F.when(F.col("words").isNull(), F.lit(0).cast("long")).otherwise(
        (F.col("n_convs") - 1) * F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x.cast("long")))
    compact = cut(both.select("leaf", "i", "l", "r1", "depth", "above", "parent", "conv_id", "n_convs", "n_children", "n_leaves", "sha", "words", own.alias("own")), "trie-compact")

    # sums before each position, of inner nodes and of leaves: within chunks, and of the chunks before
    cells = compact.groupBy(F.col("i").alias("id")).agg(F.sum(F.when(F.col("leaf"), 0).otherwise(F.col("own"))).alias("inner_own"), F.sum(F.when(F.col("leaf"), F.col("own")).otherwise(0)).alias("leaf_own"))
    every = spark.range(count + 1).join(cells, "id", "left").fillna(0, ["inner_own", "leaf_own"]).withColumn("chunk", F.floor(F.col("id") / per_chunk))
    here = Window.partitionBy("chunk").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    until = Window.partitionBy(F.lit(1)).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    by_chunk = every.groupBy("chunk").agg(F.sum("inner_own").alias("a"), F.sum("leaf_own").alias("b")).select(
        "chunk", F.coalesce(F.sum("a").over(until), F.lit(0)).alias("a"), F.coalesce(F.sum("b").over(until), F.lit(0)).alias("b"))
    sums = cut(every.select("id", "chunk", "inner_own", "leaf_own", F.sum("inner_own").over(here).alias("x"), F.sum("leaf_own").over(here).alias("y")).join(by_chunk, "chunk").select(
        "id", (F.col("a") + F.col("x")).alias("inner_to"), (F.col("a") + F.col("x") - F.col("inner_own")).alias("inner_before"),
        (F.col("b") + F.col("y") - F.col("leaf_own")).alias("leaf_before")), "trie-sums")

    left = sums.select(F.col("id").alias("l"), F.col("inner_to").alias("inner_l"), F.col("leaf_before").alias("leaf_l"))
    right = sums.select(F.col("id").alias("r1"), F.col("inner_before").alias("inner_r"), F.col("leaf_before").alias("leaf_r"))
    up = places.where("not leaf").select(F.col("i").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    total = F.when(F.col("leaf"), F.col("own")).otherwise(F.col("inner_r") - F.col("inner_l") + F.col("leaf_r") - F.col("leaf_l"))
    full = compact.join(left, "l").join(right, "r1").join(up, "parent", "left").select(
        "conv_id", "depth", "above", "parent_conv_id", "n_convs", "n_children", "n_leaves", total.alias("saved"), "sha", "words")
    return full.mapInArrow(_expanded, "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")


def trie(conversations: DataFrame, every: int = 20, most: int = 4, per_block: int = 20_000) -> DataFrame:
    """Nodes of all conversations(conv_id, turn, role, text), rebuilt."""
    module_path(conversations.sparkSession)
    own = cut(sequences(conversations), "trie-own")
    convs = cut(rebuilt(own, every, most), "trie-convs")
    drop(own)
    return nodes(convs, per_block)
