"""Embedding near-duplicates: NN-descent to a neighbour graph, threshold edges kept.

1. Vectors are unit-scaled in double precision; equal directions are one point with a count.
2. Random-hyperplane trees give each point its first neighbours: points are dealt to leaves by
   sign bits, of about `leaf_rows` points if directions are even; a leaf is compared with itself. A
   larger leaf is dealt to chunks, compared in pairs, so no task holds a hot leaf (all pairs within it).
   Trees grow in number with their depth, so that a pair at the threshold meets in one at least with a
   chance of `meet` (tree_count): 18 at half a million points, 35 at eight million, for a threshold of 0.9.
3. Rounds of neighbour-of-neighbour joins: each point sends its list along its (sampled both
   ways) edges; candidates are scored exactly and the best kept, until few lists change.
4. A point whose whole list passes the threshold is saturated: it may have more links. Its list and
   those of its neighbours double, filled by new trees over these points alone and by a round among
   them, `doublings` times or until no list is full. A list of any length may still miss a link of a
   dense group, so components in which a list was ever full are also compared whole: they are dealt to
   chunks, each in a ball (centre and largest angle). Chunks whose balls are within the threshold's
   angle, of one component or of two, are compared whole, so given right lists of the other points
   no link of dense groups is lost. The balls are compared in pairs of blocks: their number is that
   of the dense chunks, not of the points, but that step grows with its square.
5. Recall is audited against brute force for a stated set of queries (`audit`); it is a function of
   its own, which the query does not run: its cost grows with queries times rows.

Vectors that are null, zero, or hold null or non-finite components link with nothing. Repeated
rows and null ids: each row is a vector; rows of one id are one vertex, and null ids have a null
component. Rows of one id with different vectors are points of their own, joined as one vertex.
Vectors link only with vectors of the same length. An empty table gives an empty result; other
columns are not looked at, whatever their names."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import _shared


def points(vectors: DataFrame) -> DataFrame:
    """(vec_id, unit binary) per row of vectors(vec_id, embedding): little-endian doubles of length one, null if it takes no part."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                unit = None
                if x and None not in x:
                    v = np.array(x, np.float64)
                    norm = math.sqrt(float(v @ v)) if np.isfinite(v).all() else 0.0
                    if norm > 0 and math.isfinite(norm):
                        unit = (v / norm).tobytes()
                out.append(unit)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "unit"])

    rows = _shared.columns(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "vec_id long, unit binary")


def tree_count(bits: int, threshold: float, meet: float = 0.95, least: int = 12) -> int:
    """Trees of depth `bits` after which a pair at the threshold has shared a leaf with a chance of `meet`: one random
    plane parts it with a chance of its angle over pi."""
    together = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return least if together >= 1 else max(least, math.ceil(math.log(1 - meet) / math.log1p(-together)))


def _depth(count: int, leaf_rows: int) -> int:
    return max(0, math.ceil(math.log2(max(1, count / leaf_rows))))


@functools.lru_cache(4)
def _planes(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(count, dim))


def _matrix(units: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1)


def _best(x: np.ndarray, ids: np.ndarray, y: np.ndarray, others: np.ndarray, k: int):
    """For each row of x its k best of y (itself out): (p, q, cosine)."""
    cos = x @ y.T
    cos[ids[:, None] == others[None, :]] = -2
    k = min(k, len(others))
    top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(cos, top, 1)
    keep = value > -2
    return np.repeat(ids, keep.sum(1)), others[top[keep]], value[keep]


def _edges(parts):
    import pyarrow as pa

    p, q, c = (np.concatenate(x) if parts else np.empty(0) for x in (zip(*parts, strict=True) if parts else ((), (), ())))
    return pa.table({"p": pa.array(p, pa.int64()), "q": pa.array(q, pa.int64()), "cos": pa.array(c, pa.float64())})


def first_lists(found: DataFrame, k: int, trees: int, leaf_rows: int, count: int, seed: int) -> DataFrame:
    """(p, q, cos): each point's k best in its leaf of each tree. found: (p, unit)."""
    bits = _depth(count, leaf_rows)

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            ids, units = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[list] = [[], [], [], []]
            for i, u in zip(ids, units, strict=True):
                v = np.frombuffer(u, np.float64)
                sign = _planes(len(v), trees * bits, seed) @ v > 0 if bits else np.zeros(0, bool)
                for t in range(trees):
                    code = int("1" + "".join("01"[b] for b in sign[t * bits:(t + 1) * bits].astype(int)), 2)
                    for column, value in zip(rows, (f"{t}/{len(v)}", code, i, u), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0]), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.binary())],
                names=["tree", "code", "p", "unit"])

    dealt = found.select("p", "unit").mapInArrow(deal, "tree string, code long, p long, unit binary")
    sized = dealt.groupBy("tree", "code").agg(F.ceil(F.count("*") / leaf_rows).cast("int").alias("chunks"))
    return _blockwise(dealt.join(sized, ["tree", "code"]), ["tree", "code"], k)


def _blockwise(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """k best of each row of (keys, p, unit, chunks) in its group; groups are dealt to chunks, and each
    pair of chunks is compared by itself."""
    rows = rows.withColumn("chunk", F.expr("cast(pmod(xxhash64(p, 11), chunks) as int)"))
    paired = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    paired = paired.withColumns({"x": F.least("chunk", "other"), "y": F.greatest("chunk", "other")})

    def compare(table):
        ids, chunk = table.column("p").to_numpy(), table.column("chunk").to_numpy()
        m = _matrix(table.column("unit").to_pylist())
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        if x == y:
            return _edges([_best(m, ids, m, ids, k)])
        a, b = chunk == x, chunk == y
        if not a.any() or not b.any():
            return _edges([])
        return _edges([_best(m[a], ids[a], m[b], ids[b], k), _best(m[b], ids[b], m[a], ids[a], k)])

    return paired.groupBy(*keys, "x", "y").applyInArrow(compare, "p long, q long, cos double")


def best_lists(edges: DataFrame, k: int) -> DataFrame:
    """The k best of each point's candidates (p, q, cos)."""
    from pyspark.sql import Window

    once = edges.groupBy("p", "q").agg(F.max("cos").alias("cos"))
    rank = F.row_number().over(Window.partitionBy("p").orderBy(F.desc("cos"), "q"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def descend(lists: DataFrame, found: DataFrame, k: int, keep: int = 4) -> DataFrame:
    """One round: around every point, its neighbours both ways are compared with each other; each offers its best `keep`."""
    from pyspark.sql import Window

    back = lists.select(F.col("q").alias("p"), F.col("p").alias("q"))
    pick = F.row_number().over(Window.partitionBy("p").orderBy(F.xxhash64("q", "p")))
    back = back.withColumn("n", pick).where(F.col("n") <= k).drop("n")
    around = lists.select("p", "q").unionByName(back).distinct()
    with_unit = around.join(found.select(F.col("p").alias("q"), "unit"), "q")
    grouped = with_unit.groupBy("p").agg(F.collect_list(F.struct("q", "unit")).alias("near"))  # 2 k rows at most

    def compare(batches):
        for batch in batches:
            parts = []
            for near in batch.column(0).to_pylist():
                if len(near) > 1:
                    ids = np.array([n["q"] for n in near])
                    m = _matrix([n["unit"] for n in near])
                    parts.append(_best(m, ids, m, ids, min(k, keep)))
            yield from _edges(parts).to_batches()

    return best_lists(lists.unionByName(grouped.select("near").mapInArrow(compare, "p long, q long, cos double")), k)


def near_chunks(rows: DataFrame, threshold: float, block_rows: int = 1024) -> DataFrame:
    """(cell_x, chunk_x, cell_y, chunk_y), each pair once: the chunks of rows(cell, chunk, unit) that may hold a link."""

    def ball(key, table):
        import pyarrow as pa

        m = _matrix(table.column("unit").to_pylist())
        centre = m.sum(0)
        norm = math.sqrt(float(centre @ centre))
        centre = centre / norm if norm > 0 else m[0]
        radius = math.acos(max(-1.0, min(1.0, float((m @ centre).min()))))
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "chunk": pa.array([key[1].as_py()], pa.int32()),
                         "centre": pa.array([centre.tobytes()], pa.binary()), "radius": pa.array([radius], pa.float64())})

    balls = _shared.cut(rows.select("cell", "chunk", "unit").groupBy("cell", "chunk").applyInArrow(
        ball, "cell long, chunk int, centre binary, radius double"), "op10-balls").withColumn("size", F.octet_length("centre"))
    sized = balls.groupBy("size").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    dealt = balls.join(sized, "size").withColumn("block", F.expr("cast(pmod(xxhash64(cell, chunk), blocks) as int)"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6

    def compare(table):
        import pyarrow as pa

        cell, chunk, block, radius = (table.column(n).to_numpy() for n in ("cell", "chunk", "block", "radius"))
        m = _matrix(table.column("centre").to_pylist())
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        a, b = np.flatnonzero(block == x), np.flatnonzero(block == y)
        near = np.arccos(np.clip(m[a] @ m[b].T, -1, 1)) <= radius[a][:, None] + radius[b][None, :] + reach
        i, j = np.nonzero(near)
        i, j = a[i], b[j]
        once = (i <= j) if x == y else np.ones(len(i), bool)
        i, j = i[once], j[once]
        return pa.table({"cell_x": pa.array(cell[i], pa.int64()), "chunk_x": pa.array(chunk[i], pa.int32()),
                         "cell_y": pa.array(cell[j], pa.int64()), "chunk_y": pa.array(chunk[j], pa.int32())})

    return paired.groupBy("size", "x", "y").applyInArrow(compare, "cell_x long, chunk_x int, cell_y long, chunk_y int")


def dense_links(groups: DataFrame, found: DataFrame, threshold: float, chunk_rows: int) -> DataFrame:
    """(p, links, a, b) for the points of groups(cell, p), in which saturated points lie: weighted counts of
    the links among them, in parts; and, with p null, the cells a and b that a link joins."""
    rows = groups.join(found.select("p", "unit", "copies"), "p")
    sized = rows.groupBy("cell").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))
    rows = _shared.cut(rows.join(sized, "cell").withColumn("chunk", F.expr("cast(pmod(xxhash64(p, 11), chunks) as int)")).drop("chunks"), "op10-dense")
    pairs = _shared.cut(near_chunks(rows, threshold), "op10-near").withColumn("pair", F.struct("cell_x", "chunk_x", "cell_y", "chunk_y"))
    sides = pairs.select("pair", F.explode(F.array_distinct(F.array(
        F.struct(F.col("cell_x").alias("cell"), F.col("chunk_x").alias("chunk")),
        F.struct(F.col("cell_y").alias("cell"), F.col("chunk_y").alias("chunk"))))).alias("s")).select("pair", "s.*")
    blocks = rows.join(sides, ["cell", "chunk"]).select("pair", "cell", "chunk", "p", "unit", "copies")

    def count(key, table):
        import pyarrow as pa

        pair = key[0].as_py()
        ids, cell, chunk = (table.column(n).to_numpy() for n in ("p", "cell", "chunk"))
        copies = table.column("copies").to_numpy().astype(np.int64)
        m = _matrix(table.column("unit").to_pylist())
        x = (cell == pair["cell_x"]) & (chunk == pair["chunk_x"])
        if x.all():
            near = (m @ m.T) >= threshold
            np.fill_diagonal(near, False)
            links = near @ copies
        else:
            near = (m[x] @ m[~x].T) >= threshold
            links = np.empty(len(ids), np.int64)
            links[x], links[~x] = near @ copies[~x], near.T @ copies[x]
        some = links > 0
        join = int(pair["cell_x"] != pair["cell_y"] and some.any())
        return pa.table({"p": pa.array([*ids[some].tolist(), *[None] * join], pa.int64()), "links": pa.array([*links[some].tolist(), *[None] * join], pa.int64()),
                         "a": pa.array([None] * int(some.sum()) + [pair["cell_x"]] * join, pa.int64()),
                         "b": pa.array([None] * int(some.sum()) + [pair["cell_y"]] * join, pa.int64())})

    return blocks.groupBy("pair").applyInArrow(count, "p long, links long, a long, b long")


def enlarged(lists: DataFrame, found: DataFrame, threshold: float, k: int, doublings: int, leaf_rows: int, seed: int) -> DataFrame:
    """The lists with those of saturated points, and of their neighbours, doubled."""
    for turn in range(doublings):
        full = _shared.cut(lists.where(F.col("cos") >= threshold).groupBy("p").count().where(F.col("count") >= k).select("p"), "op10-full")
        if not full.limit(1).count():
            break
        around = _shared.cut(full.unionByName(lists.join(full, "p").select(F.col("q").alias("p"))).distinct(), "op10-around")
        mine = lists.join(around, "p", "left_semi")
        k *= 2
        more = descend(mine, found, k, keep=k).select("p", "q", "cos").unionByName(
            first_lists(found.join(around, "p", "left_semi"), k, 2, leaf_rows, around.count(), seed + 1 + turn))
        before, lists = lists, _shared.cut(best_lists(lists.select("p", "q", "cos").unionByName(more), k), "op10-lists")
        _shared.drop(before)
    return lists


def near_dedup(vectors: DataFrame, threshold: float = 0.9, k: int = 8, trees: int | None = None, leaf_rows: int = 128,
               seed: int = 5, doublings: int = 1) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding); `trees` None: by tree_count."""
    spark = vectors.sparkSession
    _shared.small_batches(spark, 1024)
    rows = _shared.cut(points(vectors), "op10-points")
    taking = rows.where("unit is not null and vec_id is not null")
    # points have keys of their own: an id may have several vectors, and a vector several ids
    found = _shared.cut(taking.groupBy("unit").agg(F.min("vec_id").alias("v"), F.count("*").alias("copies"))
                        .sortWithinPartitions("unit").withColumn("p", F.monotonically_increasing_id()), "op10-found")
    count = found.count()
    trees = trees or tree_count(_depth(count, leaf_rows), threshold)
    lists = _shared.cut(best_lists(first_lists(found, k, trees, leaf_rows, count, seed), k), "op10-lists")
    _shared.small_batches(spark, 256)
    while True:  # lists only get better, so this ends
        after = _shared.cut(descend(lists, found, k), "op10-lists")
        changed = after.join(lists, ["p", "q"], "left_anti").count()
        _shared.drop(lists)
        lists = after
        if changed <= lists.count() // 1000:
            break
    lists = enlarged(lists, found, threshold, k, doublings, leaf_rows, seed)
    links = lists.where(F.col("cos") >= threshold)
    pairs = links.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    comps = _shared.cut(_shared.components(pairs, "op10-comp"), "op10-comps")
    # saturated: the whole list passes, so there may be more, in such components and between them
    full = links.groupBy("p").count().where(F.col("count") >= k).select(F.col("p").alias("id"))
    dense = comps.join(full, "id").select("component_id").distinct()
    groups = _shared.cut(comps.join(dense, "component_id").select(F.col("component_id").alias("cell"), F.col("id").alias("p")), "op10-groups")
    counted = _shared.cut(dense_links(groups, found, threshold, 4 * leaf_rows), "op10-whole")
    whole = counted.where("p is not null").groupBy("p").agg(F.sum("links").alias("links"))
    joins = counted.where("p is null").select("a", "b").distinct()
    # the points of an id's vectors are one vertex
    shared = taking.groupBy("vec_id").agg(F.min(F.xxhash64("unit")).alias("lo"), F.max(F.xxhash64("unit")).alias("hi")).where("lo < hi").select("vec_id")
    several = taking.join(shared, "vec_id").join(found.select("unit", "p"), "unit").select("vec_id", "p").distinct()
    same = several.groupBy("vec_id").agg(F.min("p").alias("a")).join(several, "vec_id").select("a", F.col("p").alias("b")).where("a <> b")
    extra = _shared.cut(joins.unionByName(same), "op10-extra")
    if extra.limit(1).count():
        comps = _shared.cut(_shared.components(pairs.unionByName(extra), "op10-comp"), "op10-comps")
    least = comps.join(found.select(F.col("p").alias("id"), "v"), "id").groupBy("component_id").agg(F.min("v").alias("least"))
    named = comps.join(least, "component_id").select(F.col("id").alias("p"), F.col("least").alias("component_id"))
    copies = found.select(F.col("p").alias("b"), "copies")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sparse = both.join(groups.select(F.col("p").alias("a")), "a", "left_anti").join(copies, "b").groupBy(F.col("a").alias("p")).agg(
        F.sum("copies").alias("links"))
    counts = found.join(whole.unionByName(sparse), "p", "left").join(named, "p", "left")
    out = rows.join(counts, "unit", "left")
    component = F.coalesce("component_id", "v", "vec_id")
    return out.select("vec_id", F.when(F.col("p").isNotNull() & F.col("vec_id").isNotNull(), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
                      F.when(F.col("vec_id").isNotNull(), component).alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def audit(vectors: DataFrame, result: DataFrame, threshold: float = 0.9, every: int = 20) -> float:
    """Share of the true links of the vectors whose id is divisible by `every` that the result counts;
    those queries against all rows, in blocks. A surplus of one vector makes up for no loss of another."""
    rows = points(vectors).where("unit is not null and vec_id is not null")
    queries = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, math.ceil(queries.count() / 512))
    rows = rows.withColumn("size", F.octet_length("unit"))
    queries = queries.withColumn("size", F.octet_length("unit"))
    dealt = queries.withColumn("block", F.expr(f"pmod(xxhash64(vec_id), {blocks})"))
    packed = dealt.groupBy("size", "block").agg(F.collect_list(F.struct("vec_id", "unit")).alias("queries"))
    slices = rows.withColumn("slice", F.expr("pmod(xxhash64(vec_id), 64)")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def count(table, blocks_table):
        import pyarrow as pa

        if not table.num_rows or not blocks_table.num_rows:
            return pa.table({"vec_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        near = blocks_table.column("queries")[0].as_py()
        q, ids = _matrix([n["unit"] for n in near]), np.array([n["vec_id"] for n in near])
        links = (q @ _matrix(table.column("unit").to_pylist()).T >= threshold) & (ids[:, None] != table.column("vec_id").to_numpy()[None, :])
        return pa.table({"vec_id": pa.array(ids, pa.int64()), "n": pa.array(links.sum(1), pa.int64())})

    spread = packed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(63))))
    truth = slices.groupBy("size", "block", "slice").cogroup(spread.groupBy("size", "block", "slice")).applyInArrow(count, "vec_id long, n long")
    truth = truth.groupBy("vec_id").agg(F.sum("n").alias("n"))
    sums = truth.join(result.groupBy("vec_id").agg(F.sum("n_links").alias("n_links")), "vec_id").agg(F.sum("n"), F.sum(F.least("n", "n_links"))).first()
    return 1.0 if not sums[0] else float(sums[1]) / float(sums[0])
