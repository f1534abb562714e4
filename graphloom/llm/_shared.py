"""What the operators of this subpackage share: scratch tables, batch sizes, blocks of rows."""

from __future__ import annotations

import atexit
import ctypes
import gc
import math
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a null id inside numpy code; such a row sorts after all others.
NO_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session. A session on one machine that has none gets a local folder;
    on a cluster that would lose rows, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "graphloom-scratch")
    return f"{found.rstrip('/')}/graphloom-{spark.sparkContext.applicationId}"


_swept: set[str] = set()


def sweep(spark: SparkSession, path: str) -> None:
    """Remove a folder of scratch tables."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended: what is left is in the shared folder, by application
        pass


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: cuts lineage, survives lost executors.

    The tables of a session go when the driver ends; `drop` removes one sooner."""
    spark = df.sparkSession
    top = scratch_dir(spark)
    if top not in _swept:
        _swept.add(top)
        atexit.register(sweep, spark, top)
    path = f"{top}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a table that `cut` has written; no plan may read it any more."""
    sweep(df.sparkSession, df._scratch)


def release(spark: SparkSession) -> None:
    """Let the driver drop shuffle files that no live plan needs any more (else they stay until its next GC)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Texts may be very long, so Arrow batches hold few rows."""
    module_path(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_memos: dict[str, Callable[[], None]] = {}


def alone(name: str, clear: Callable[[], None] | None = None) -> None:
    """In a Python worker: operator `name` begins, and what other operators have memorized there goes.

    Workers are reused between stages, so memos would add up; `clear` empties the operator's own."""
    others = [n for n in _memos if n != name]
    for n in others:
        _memos.pop(n)()
    if others:
        gc.collect()
        ctypes.CDLL(None).malloc_trim(0)
    if clear:
        _memos[name] = clear


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def receivers(spark: SparkSession, blocks: int) -> int:
    """Hash ranges that blocks of rows exchange by: some for each shuffle partition, and enough that none
    gets more than what 64 blocks send, whatever the number of shuffle partitions."""
    return max(2 * min(blocks, partitions(spark)), -(-blocks // 64))


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; a missing one is a clear error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def forest(a, b):
    """Distinct ids of the edges (a, b), sorted, and the smallest reachable id of each: roots hook to smaller roots."""
    import numpy as np

    ids, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = back[: len(a)], back[len(a):], np.arange(len(ids))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            return ids, ids[root]
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def components(edges: DataFrame, label: str, task_edges: int = 1_000_000) -> DataFrame:
    """Smallest reachable id per vertex of an edge table (a, b), as (id, component_id) for vertices with
    at least one edge.

    Up to `task_edges` edges (counted; 16 bytes each) are joined in one task. More go through alternating
    large-star and small-star rounds over at most the edges, O(log n) rounds in practice. There a vertex
    of very many edges is no group of one task: minima are partial sums, and the joins are ones that can be split."""
    edges = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    if edges.count() > task_edges:
        return _star_rounds(edges, label)

    def join(batches):
        import numpy as np
        import pyarrow as pa

        parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if parts:
            ids, roots = forest(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            for at in range(0, len(ids), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at:at + 8192]), pa.array(roots[at:at + 8192])], names=["id", "component_id"])

    module_path(edges.sparkSession)
    found = cut(edges.coalesce(1).mapInArrow(join, "id long, component_id long"), label)
    drop(edges)
    return found


def _star_rounds(edges: DataFrame, label: str) -> DataFrame:
    """components() for any number of edges (a > b, distinct, a table of `cut`)."""
    seen = None
    while True:
        # large star: the larger neighbours of u, and u itself, link to the smallest of u's neighbourhood
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                              F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = edges.join(least.where("m < u").withColumnRenamed("u", "b"), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        # small star: u's smaller neighbours, and u itself, link to the smallest of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        before, edges = edges, cut(small.where("a <> b").distinct(), label)
        drop(before)
        # equal tables have equal sums; a star forest stays as it is
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003), F.sum(F.hash("b", "a").cast("long"))).first())
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return roots.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())


def module_path(spark: SparkSession) -> None:
    """Python workers import this package; they find it where the driver did, unless their path has it already."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def packed_blocks(docs: DataFrame, rows_per_block: int, carry: list[str] | None = None) -> tuple[DataFrame, int]:
    """(row_id, block, z) hash-partitioned by block: the whole texts, zstd-compressed, dealt to
    blocks of about rows_per_block rows by a hash of id and text.

    One plan may read it several times; the exchange is the same subplan, so Spark runs it once.
    Null ids become NO_ID, null texts stay null. Columns named in carry go along as a struct."""
    spark = docs.sparkSession
    blocks = max(1, math.ceil(docs.count() / rows_per_block))

    def pack(batches):
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = [None if x is None else squeeze(x.encode()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary()), *batch.columns[3:]],
                                             names=["row_id", "block", "z", *batch.schema.names[3:]])

    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carry")] if carry else []
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("row_id"), "text",
                        F.expr(f"cast(pmod(xxhash64(doc_id, text), {blocks}) as int)").alias("block"), *more)
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("z", T.BinaryType()),
                           *keyed.schema.fields[3:]])
    out = keyed.mapInArrow(pack, schema)
    return out.repartition(min(blocks, partitions(spark)), "block"), blocks


def unpack(table):
    """ids and UTF-8 texts (null: empty) of a block, ordered by id, text; and each row's place in the table."""
    import zstandard

    alone("blocks")
    grow = zstandard.ZstdDecompressor().decompress
    rows = [(i, b"" if z is None else grow(z), n) for n, (i, z) in
            enumerate(zip(table.column("row_id").to_pylist(), table.column("z").to_pylist(), strict=True))]
    rows.sort()
    return [i for i, _, _ in rows], [t for _, t, _ in rows], [n for _, _, n in rows]
