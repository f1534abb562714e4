"""Jaccard self-join of word n-gram sets, verified in prefix trees; exact but for collisions of hashes
(n-grams are compared by 48 bits, whole sets are taken as equal by 64 bits and their size).

1. Every text becomes its set of n-gram hashes in one global order (by hash). The hash range is
   split into more equal parts than two linked sets of that size can differ in, so linked sets
   agree on a whole part that is not empty; parts are hashed to signatures. Set sizes lie in
   geometric bands, and a set signs for its own band and the next, so linked sizes meet. There are
   a fifth more parts than needed, so linked sets agree on that many and one, and a set of fewer
   repeated signatures is done (one with more empty parts signs these too). No link is lost.
2. Blocks exchange sorted runs of signatures; the answers are bitmaps of those seen elsewhere.
   Sets without a repeated signature are done.
3. Members of a signature group are compared with the group's first member, if their sizes can
   link. A group's first member may be too short for others that link, so groups that still span
   several components are compared across these: pairs of small groups, large ones chunk by chunk.
   Only groups of the rarest signatures count there: a set that shares k of its r with any linked
   set meets it in the r - k + 1 rarest. Equal sets count once.
4. Comparisons of one set with many: the others, in the global order, form a trie (sorted
   sequences with shared prefixes); the walk keeps the overlap at every node, resumes where two
   paths part, and leaves a subtree when the lengths that remain cannot reach the threshold.

Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. Fewer than n words make
one n-gram; no words or a null text make the empty set, which links with nothing. Rows with equal
ids are one vertex. Null ids link with nothing and have a null component. An empty table gives an
empty result; other columns are not looked at, whatever their names."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import _shared
from graphloom.llm.suffix_dedup import _mix, answer_repeats, distinct_hashes, from_six, read_bits, send_hashes, six, span_hashes

_STEP = 24  # tokens between the trie's nodes
_TRIE_BYTES = 1 << 20  # of packed tokens in one trie
_FEW = 64  # sets of a group of which pairs are made; larger ones are compared chunk by chunk


def _byte_tables():
    values = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for b in range(65, 91):
        values[b] = values[b + 32]
    white = np.zeros(256, bool)
    white[[0x20, *range(0x09, 0x0E)]] = True
    return values, white


_VALUES, _WHITE = _byte_tables()


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, in order."""
    parts = []
    for a in _pieces(text):
        buf = np.frombuffer(a, np.uint8)
        inside = np.empty(len(buf) + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(_WHITE[buf], out=inside[1:-1])
        turn = np.flatnonzero(inside[1:] != inside[:-1])
        if not len(turn):
            continue
        start, end = turn[0::2], turn[1::2]
        parts.append(span_hashes(buf, start, end, _VALUES))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _pieces(text: bytes, size: int = 1 << 20):
    """The text in pieces of about `size` bytes, cut at white space."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while at < len(text):
        to = min(len(text), at + size)
        while to < len(text) and text[to] not in b" \t\n\v\f\r":
            to += 1
        out.append(text[at:to])
        at = to
    return out


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams."""
    w = word_hashes(text)
    if not len(w):
        return w
    m = min(n, len(w))
    h = np.full(len(w) - m + 1, m, np.uint64)
    for j in range(m):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[j:len(w) - m + 1 + j])
    return np.unique(h)


class Bands:
    """Size bands and the number of parts of each scheme (a scheme serves two neighbouring bands)."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.lows = num, den, [1]

    def band(self, size: int) -> int:
        while self.lows[-1] <= size:
            self.lows.append(self.lows[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.lows, size, side="right")) - 1

    def parts(self, scheme: int) -> tuple[int, int]:
        """Parts of the hash range, and how many of them may be empty in a set that signs only others."""
        while len(self.lows) < scheme + 2:
            self.lows.append(self.lows[-1] * self.den // self.num + 1)
        most = 2 * (self.lows[scheme + 1] - 1) * (self.den - self.num) // (self.den + self.num)
        spare = -(-(most + 1) // 5) if most else 0
        return most + 1 + spare, spare


def signatures(tokens: np.ndarray, bands: Bands) -> list[tuple[np.ndarray, int]]:
    """48-bit signatures of a set of sorted distinct 48-bit tokens, for its own band and the next; with
    each, how many of them any linked set shares: the parts that agree, less the set's empty ones."""
    out = []
    own = bands.band(len(tokens))
    deep = _mix(tokens + np.uint64(0x9E3779B97F4A7C15))
    for scheme in (own, own + 1):
        parts, spare = bands.parts(scheme)
        part = ((tokens >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sums, index = np.add.reduceat(deep, first), part[first]
        empty = parts - len(first)
        need = 1 + spare - empty
        if need < 1:  # then linked sets may agree on empty parts alone
            rest = np.setdiff1d(np.arange(parts, dtype=np.uint64), index)
            sums, index = np.concatenate([sums, np.zeros(len(rest), np.uint64)]), np.concatenate([index, rest])
        signed = _mix(_mix(sums) + index * np.uint64(0x9E3779B97F4A7C15) + np.uint64(scheme << 40)) >> np.uint64(16)
        out.append((signed, max(1, need)))
    return out


def needed(a: int, b: int, num: int, den: int) -> int:
    """Smallest overlap of sets of a and b tokens that links them."""
    return -(-num * (a + b) // (num + den))


def trie_matches(base: list[int], others: list[tuple[list[int], int]], num: int, den: int) -> list[int]:
    """Keys of the sorted sequences `others` (sequence, key) that link with the sorted `base`."""
    have = set(base).__contains__
    found, path, before = [], [0], []
    size = len(base)
    for seq, key in sorted(others):
        need, n = needed(size, len(seq), num, den), len(seq)
        depth = 0
        while depth + 1 < len(path) and seq[depth * _STEP:(depth + 1) * _STEP] == before[depth * _STEP:(depth + 1) * _STEP]:
            depth += 1
        del path[depth + 1:]
        at, overlap = depth * _STEP, path[depth]
        while at < n and overlap + n - at >= need:
            overlap += sum(map(have, seq[at:at + _STEP]))
            at += _STEP
            if at <= n:
                path.append(overlap)
        if at >= n and overlap >= need:
            found.append(key)
        before = seq
    return found


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets (row_id, toks) link."""
    _shared.small_batches(pairs.sparkSession, 64)  # a row holds two sets
    with_b = pairs.join(sets.select(F.col("row_id").alias("b"), F.col("toks").alias("b_toks")), "b")
    both = with_b.join(sets.select(F.col("row_id").alias("a"), F.col("toks").alias("a_toks")), "a")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, b, b_toks, a_toks = (batch.column(n).to_pylist() for n in ("a", "b", "b_toks", "a_toks"))
            out_a, out_b, i = [], [], 0
            while i < len(a):
                j, size = i, 0
                while j < len(a) and a[j] == a[i] and size < _TRIE_BYTES:
                    size += len(b_toks[j])
                    j += 1
                others = [(from_six(b_toks[x]).tolist(), b[x]) for x in range(i, j)]
                keys = trie_matches(from_six(a_toks[i]).tolist(), others, num, den)
                out_a += [a[i]] * len(keys)
                out_b += keys
                i = j
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return both.select("a", "b", "b_toks", "a_toks").mapInArrow(run, "a long, b long")


def across(members: DataFrame, num: int, den: int, chunk_rows: int = 512) -> DataFrame:
    """Links (a, b) that join components c inside families; members: (row_id, family, c, n, toks).

    A family's sets are dealt to chunks by size band, and large components to chunks of their own.
    Chunks of the same or neighbouring bands are compared in pairs, but not two of one component; a
    pair of chunks gives no more links than it needs to join what it joins."""
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) * (1 - 1e-9)).cast("int")
    sized = members.withColumn("band", band)
    large = sized.groupBy("family", "c").count().where(F.col("count") > chunk_rows // 2).select("family", "c", F.col("c").alias("own"))
    sized = sized.join(large, ["family", "c"], "left").withColumn("own", F.coalesce("own", F.lit(-1)))
    kinds = sized.groupBy("family", "band", "own").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))
    dealt = sized.join(kinds, ["family", "band", "own"]).withColumn("chunk", F.expr("cast(pmod(xxhash64(row_id, 5), chunks) as int)"))
    each = kinds.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    left = each.select("family", *[F.col(x).alias(f"{x}_x") for x in ("band", "own", "chunk")])
    right = each.select("family", *[F.col(x).alias(f"{x}_y") for x in ("band", "own", "chunk")])
    x, y = F.struct("band_x", "own_x", "chunk_x"), F.struct("band_y", "own_y", "chunk_y")
    pairs = (left.join(right, "family").where(F.col("band_y").between(F.col("band_x") - 2, F.col("band_x") + 2))
             .where(x <= y).where("own_x = -1 or own_x <> own_y"))
    pairs = pairs.withColumn("pair", F.struct("band_x", "own_x", "chunk_x", "band_y", "own_y", "chunk_y"))
    sides = pairs.select("family", "pair", F.col("band_x").alias("band"), F.col("own_x").alias("own"), F.col("chunk_x").alias("chunk")).unionByName(
        pairs.where(x != y).select("family", "pair", F.col("band_y").alias("band"), F.col("own_y").alias("own"), F.col("chunk_y").alias("chunk")))
    blocks = dealt.join(sides, ["family", "band", "own", "chunk"]).select("family", "pair", "row_id", "c", "toks")
    _shared.small_batches(members.sparkSession, 64)

    def compare(table):
        import pyarrow as pa

        ids, comp = table.column("row_id").to_pylist(), table.column("c").to_pylist()
        toks = table.column("toks").to_pylist()
        root: dict[int, int] = {}

        def find(v):
            while root.setdefault(v, v) != v:
                root[v] = v = root[root[v]]
            return v

        out_a, out_b = [], []
        order = sorted(range(len(ids)), key=lambda i: (len(toks[i]), ids[i]))
        unpacked, held = {}, [0]

        def seq(i):
            found = unpacked.get(i)
            if found is None:
                found = from_six(toks[i]).tolist()
                if held[0] + len(found) < 2_000_000:  # beyond that, sets are unpacked anew each time
                    unpacked[i] = found
                    held[0] += len(found)
            return found

        for at, i in enumerate(order):
            apart = [j for j in order[:at] if find(comp[j]) != find(comp[i]) and len(toks[j]) * den >= len(toks[i]) * num]
            while apart:
                now, size = [], 0
                while apart and (not now or size < _TRIE_BYTES):
                    now.append(apart.pop())
                    size += len(toks[now[-1]])
                for j in trie_matches(seq(i), [(seq(j), j) for j in now], num, den):
                    if find(comp[i]) != find(comp[j]):
                        root[find(comp[i])] = find(comp[j])
                        out_a.append(ids[i])
                        out_b.append(ids[j])
                apart = [j for j in apart if find(comp[j]) != find(comp[i])]
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return blocks.groupBy("family", "pair").applyInArrow(compare, "a long, b long")


def rarest(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """Of groups(sig, side, row_id, ...) those rows by which linked sets still meet; sizes: (sig, m) of repeated signatures.

    A set of r repeated signatures that shares `need` of them with any linked set (side: 2 * need + scheme) keeps
    the r - need + 1 rarest, by one order for all sets: the rarest that two linked sets share is among those of both."""
    own = Window.partitionBy("row_id", "side")
    ranked = groups.join(sizes, "sig").withColumn("place", F.row_number().over(own.orderBy("m", "sig"))).withColumn("r", F.count("*").over(own))
    return ranked.where(F.col("place") <= F.col("r") - F.floor(F.col("side") / 2) + 1).drop("place", "r", "m")


def group_pairs(members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of sets that share a signature, are of two components and of sizes that can link, a not larger;
    members: (sig, row_id, n, c), few of a signature.

    Sets that share a passage share many signatures. So groups of the same members count once, and a set's later
    neighbours in all its groups are brought together before they become pairs; those of a very large set in several parts."""
    lists = members.groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("n", "row_id", "c"))).alias("all")).select("all").distinct()
    firsts = lists.select("all", F.posexplode("all").alias("i", "x")).where(F.col("i") + 1 < F.size("all"))
    later = F.filter(F.slice("all", F.col("i") + 2, F.size("all")), lambda y: (y["c"] != F.col("x.c")) & (F.col("x.n") * den >= y["n"] * num))
    part = F.pmod(F.xxhash64("all"), 1 + F.floor(F.col("x.n") / 16384))
    near = firsts.select(F.col("x.row_id").alias("a"), part.alias("part"), F.transform(later, lambda y: y["row_id"]).alias("later")).where(F.size("later") > 0)
    joined = near.groupBy("a", "part").agg(F.array_distinct(F.flatten(F.collect_list("later"))).alias("later"))
    return joined.select("a", F.explode("later").alias("b")).distinct()


def ngram_join(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, rows_per_block: int = 512) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text): sets whose
    intersection is at least num / den of their union are linked."""
    spark = docs.sparkSession
    _shared.small_batches(spark)
    packed, blocks = _shared.packed_blocks(_shared.columns(docs, "doc_id", "text"), rows_per_block)
    parts = _shared.receivers(spark, blocks)

    def prepare(table):
        """Ids, set sizes, and the tokens and signatures of each distinct set of the block, by its first row."""
        ids, texts, _ = _shared.unpack(table)
        bands = Bands(num, den)
        sizes, prints, first, sets, sigs = [], [], {}, {}, {}
        for x, (i, text) in enumerate(zip(ids, texts, strict=True)):
            s = shingles(text, n)
            sizes.append(len(s))
            prints.append(int(_mix(np.sum(_mix(s), dtype=np.uint64) + np.uint64(len(s))).view(np.int64)) if len(s) else 0)
            if len(s) and i != _shared.NO_ID and first.setdefault((prints[-1], len(s)), x) == x:
                sets[x] = np.unique(s >> np.uint64(16))
                sigs[x] = signatures(sets[x], bands)
        if sigs:
            flat = np.concatenate([s for both in sigs.values() for s, _ in both])
            owner = np.repeat(np.array(list(sigs)), [sum(len(s) for s, _ in both) for both in sigs.values()])
        else:
            flat, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
        values, counts = distinct_hashes(flat, owner)
        return ids, sizes, prints, sets, sigs, values, counts

    def send(key, table):
        *_, values, counts = prepare(table)
        return send_hashes(key[0].as_py(), values, counts, parts)

    def signed(key, table, replies):
        import pyarrow as pa

        ids, sizes, prints, sets, sigs, values, _ = prepare(table)
        multi, _ = read_bits(values, list(zip(replies.column("part").to_pylist(), replies.column("bits").to_pylist(), strict=True)), parts)
        mine, sides, toks = [], [], []
        for x in range(len(ids)):
            again = [(s[multi[np.searchsorted(values, s)]], need) for s, need in sigs.get(x, ())]
            again = [(s, need) for s, need in again if len(s) >= need]  # else no other set can link by this scheme
            marks = [np.full(len(s), 2 * need + side) for side, (s, need) in enumerate(again)]
            again = [s for s, _ in again]
            mine.append(np.concatenate(again).astype(np.int64) if again else None)
            sides.append(np.concatenate(marks).astype(np.int32) if again else None)
            toks.append(None if mine[-1] is None else six(sets[x]))
        return pa.table({"row_id": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64()), "print": pa.array(prints, pa.int64()),
                         "sigs": pa.array(mine, pa.list_(pa.int64())), "sides": pa.array(sides, pa.list_(pa.int32())), "toks": pa.array(toks, pa.binary())})

    sent = packed.groupBy("block").applyInArrow(send, "block int, part int, hashes binary, counts binary")
    bits = sent.groupBy("part").applyInArrow(
        lambda table: answer_repeats(table, 1 << 62), "block int, part int, bits binary")
    rows = _shared.cut(packed.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(
        signed, "row_id long, n long, print long, sigs array<long>, sides array<int>, toks binary"), "op6-rows")
    del packed, sent, bits  # their shuffle files are not needed any more
    _shared.release(spark)

    sets = rows.where("toks is not null").select("row_id", "toks")
    # one row a signature and set; equal sets of different blocks are linked without a comparison
    groups = rows.where("sigs is not null").select(F.explode(F.arrays_zip("sigs", "sides")).alias("s"), "row_id", "n", "print").select("s.sigs", "s.sides", "row_id", "n", "print").toDF("sig", "side", "row_id", "n", "print")
    first = groups.groupBy("sig").agg(F.min(F.struct("n", "row_id", "print")).alias("first"), F.count("*").alias("m")).where("m > 1")
    fits = lambda a, b: F.col(a) * den >= F.col(b) * num
    star = (groups.join(first.select("sig", "first"), "sig")
            .where((F.col("row_id") != F.col("first.row_id")) & ((F.col("n") != F.col("first.n")) | (F.col("print") != F.col("first.print"))))
            .groupBy(F.col("first.row_id").alias("a"), F.col("row_id").alias("b"))
            .agg(F.count("*").alias("shared"), F.max(fits("first.n", "n")).alias("fits")))
    star = _shared.cut(star, "op6-star")
    # this only joins what is easily joined; sets of one shared signature are left to the families below
    true_star = _shared.cut(verify(star.where("shared > 1 and fits").select("a", "b"), sets, num, den), "op6-links")
    known = rows.where(f"n > 0 and row_id <> {_shared.NO_ID}")
    same = known.groupBy("print", "n").agg(F.min("row_id").alias("a"))
    equal = known.join(same, ["print", "n"]).select("a", F.col("row_id").alias("b"))
    links = true_star.unionByName(equal).where("a <> b")
    found = _shared.components(links, "op6-comp")

    # linked sets share one of each other's rarest signatures: groups of these that still span components are compared across them
    alike = same.select(F.col("a").alias("row_id"))  # of equal sets one is enough
    rare = _shared.cut(rarest(groups.join(alike, "row_id", "left_semi"), first.select("sig", "m")).join(found.withColumnRenamed("id", "row_id"), "row_id", "left")
                       .select("sig", "row_id", "n", F.coalesce("component_id", "row_id").alias("c")), "op6-rare")
    split = rare.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).where("lo < hi")
    few = rare.join(split.where(F.col("m") <= _FEW).select("sig"), "sig")
    more = _shared.cut(verify(group_pairs(few, num, den), sets, num, den), "op6-few")
    many = rare.join(split.where(F.col("m") > _FEW).select("sig"), "sig")  # those with common sets are one family: a pair is compared once
    tied = many.join(many.groupBy("sig").agg(F.min("row_id").alias("a")), "sig").select("a", F.col("row_id").alias("b"))
    family = _shared.components(tied, "op6-family").select(F.col("id").alias("row_id"), F.col("component_id").alias("family"))
    members = _shared.cut(many.select("row_id", "n", "c").distinct().join(family, "row_id").join(sets, "row_id"), "op6-members")
    del rare, split, few, many, tied, family, first, groups
    _shared.release(spark)
    more = more.unionByName(_shared.cut(across(members, num, den), "op6-more"))
    if more.limit(1).count():
        found = _shared.components(links.unionByName(more), "op6-comp")
    out = rows.select("row_id", "n").join(found.withColumnRenamed("id", "row_id"), "row_id", "left")
    null_id = F.col("row_id") == _shared.NO_ID
    return out.select(F.when(~null_id, F.col("row_id")).alias("doc_id"), F.col("n").alias("n_shingles"),
                      F.when(~null_id, F.coalesce("component_id", "row_id")).alias("component_id"))
