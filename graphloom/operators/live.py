"""Projects that change by parts: a document's change writes its own rows, never a whole table.

A table is a list of parts, written once and never changed, in folders by bucket (a hash of the owner, so a reader
of a few documents opens few of them). A part holds rows; rows of an owner die when a later part of deletions names it.
Relation weights and mention counts are signed: a change adds what it brings and what it takes away. Relations are
stored as lists of neighbours, by bucket of the entity. Compaction writes what lives as one part.

Each version is a manifest file of its own that only one writer can publish: of two that start from one version the
second gets a Conflict, and a writer that dies leaves nothing that blocks the next."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom import models
from graphloom.config import DEFAULTS
from graphloom.operators import graph, ingest, retrieval
from graphloom.operators.store import Conflict, Files, Missing
from graphloom.schema import TABLES

_PLACE = [T.StructField("seq", T.LongType()), T.StructField("turn", T.StringType()), T.StructField("bucket", T.IntegerType())]
_GONE = T.StructType([T.StructField("owner", T.StringType())])


class Parts:
    """The parts of some tables, and the manifests that name them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.root}/versions") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known or version is not None and version not in known:
            raise Missing(self.root)
        return json.loads(self.files.read(f"{self.root}/versions/{version if version is not None else known[-1]:012d}.json"))

    def publish(self, manifest: dict) -> int:
        """Make the manifest the version after its own; Conflict if another writer has made that."""
        version = manifest["version"] + 1
        if not self.files.publish(f"{self.root}/versions/{version:012d}.json", json.dumps(manifest | {"version": version})):
            raise Conflict(f"version {version} is written by another")
        return version

    def write(self, rows: DataFrame, table: str, seq: int, bucket, order: list[str] | None = None) -> dict:
        """A new part of rows in folders by bucket, sorted within files; nobody reads it before a manifest names it.

        Buckets are few: a large one is written by several tasks, small ones by one."""
        part = {"seq": seq, "turn": uuid.uuid4().hex}
        (rows.withColumn("bucket", bucket.cast("int")).hint("rebalance", "bucket").sortWithinPartitions("bucket", *order or ()).write.partitionBy("bucket").option("compression", "zstd")
         .parquet(f"{self.root}/{table}/seq={seq}/turn={part['turn']}"))
        return part

    def read(self, table: str, parts: list[dict], schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
        """Rows of parts with seq and bucket; of some buckets only where they are named."""
        full = T.StructType([*schema.fields, *_PLACE])
        if not parts:
            return self.spark.createDataFrame([], full)
        base = f"{self.root}/{table}"
        rows = self.spark.read.schema(full).option("basePath", base).parquet(*[f"{base}/seq={p['seq']}/turn={p['turn']}" for p in parts])
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def living(self, rows: DataFrame, deletions: list[dict], owner: str) -> DataFrame:
        """Rows whose owner no later deletion names."""
        if not deletions:
            return rows
        gone = self.read("deletions", deletions, _GONE).groupBy("owner").agg(F.max("seq").alias("gone_at"))
        return rows.join(gone, rows[owner] == gone["owner"], "left").where("gone_at is null or seq >= gone_at").drop("owner", "gone_at")

    def expire(self, keep: int = 2) -> int:
        """Forget all versions but the `keep` latest, and the parts that only they name; how many parts went."""
        known = self.versions()
        kept = [self.manifest(v) for v in known[-keep:]]
        named = {(t, p["seq"], p["turn"]) for m in kept for t, parts in [*m["rows"].items(), *(("deletions", d) for d in m["deletions"].values())] for p in parts}
        gone = 0
        for v in known[:-keep]:
            self.files.delete(f"{self.root}/versions/{v:012d}.json")
        for table in self.files.names(self.root):
            for seq in self.files.names(f"{self.root}/{table}") if table != "versions" else []:
                if seq[:4] != "seq=" or int(seq[4:]) > known[-1]:  # a writer may be at work on the next version
                    continue
                for turn in self.files.names(f"{self.root}/{table}/{seq}"):
                    if (table, int(seq[4:]), turn[5:]) not in named:
                        self.files.delete(f"{self.root}/{table}/{seq}/{turn}")
                        gone += 1
        return gone


#: Tables by document: the column that holds it.
OWNED = {"document": "id", "chunk": "doc_id", "mentions": "doc_id", "image": "doc_id", "shows": "doc_id"}
_EDGE = T.StructType([T.StructField("x", T.StringType()), T.StructField("y", T.StringType()), T.StructField("weight", T.LongType())])
_COUNT = T.StructType([T.StructField("entity_id", T.StringType()), T.StructField("n", T.LongType())])
_NAMED = T.StructType([*TABLES["entity"].fields, T.StructField("key", T.StringType())])


class LiveProject(Parts):
    """A project whose documents change one by one or in batches."""

    @classmethod
    def create(cls, spark: SparkSession, root: str, buckets: int = 16) -> LiveProject:
        made = cls(spark, root)
        if made.versions() or not made.files.publish(f"{made.root}/versions/{0:012d}.json", json.dumps({"version": 0, "buckets": buckets, "rows": {}, "deletions": {}})):
            raise Conflict(root)
        return made

    def _schema(self, table: str) -> T.StructType:
        own = TABLES[table]
        return own if OWNED[table] in own.fieldNames() else T.StructType([*own.fields, T.StructField(OWNED[table], T.StringType())])

    def _rows(self, m: dict, table: str, buckets: list[int] | None = None) -> DataFrame:
        """Living rows of a table by document."""
        return self.living(self.read(table, m["rows"].get(table, []), self._schema(table), buckets), m["deletions"].get(table, []), OWNED[table])

    def _entities(self, m: dict, buckets: list[int] | None = None) -> DataFrame:
        """Entities that are mentioned, with their mentions n; the first spelling of an id stays."""
        rows = self.read("entity", m["rows"].get("entity", []), _NAMED, buckets)
        first = rows.groupBy("id").agg(F.min_by(F.struct("name", "label", "embedding", "key"), F.struct("seq", "name")).alias("e")).select("id", "e.*")
        n = self.read("counts", m["rows"].get("counts", []), _COUNT).groupBy(F.col("entity_id").alias("id")).agg(F.sum("n").alias("n")).where("n > 0")
        return first.join(n, "id")

    def _edges(self, m: dict, buckets: list[int] | None = None) -> DataFrame:
        """(x, y, weight) in either direction; the edges of an entity x lie in one bucket, sorted by x."""
        return self.read("adjacent", m["rows"].get("adjacent", []), _EDGE, buckets)

    def _weights(self, m: dict) -> DataFrame:
        both = self._edges(m).where("x < y").groupBy(F.col("x").alias("a"), F.col("y").alias("b"))
        return both.agg(F.sum("weight").alias("weight")).where("weight > 0")

    def edges_of(self, entities: DataFrame) -> DataFrame:
        """(x, y, weight) of entities(id): only the buckets that hold their lists are read."""
        m = self.manifest()
        buckets = [r.b for r in entities.select(self._bucket(m, "id").cast("int").alias("b")).distinct().collect()]
        lists = self._edges(m, buckets).join(entities.select(F.col("id").alias("x")).distinct(), "x", "left_semi")
        return lists.groupBy("x", "y").agg(F.sum("weight").alias("weight")).where("weight > 0")

    def neighbours(self, entity_id: str, limit: int = 50) -> DataFrame:
        """(id, weight) of the strongest neighbours of one entity."""
        m = self.manifest()
        bucket = self.spark.range(1).select(F.lit(entity_id).alias("id")).select(self._bucket(m, "id").cast("int").alias("b")).first().b
        own = self._edges(m, [bucket]).where(F.col("x") == entity_id).groupBy(F.col("y").alias("id")).agg(F.sum("weight").alias("weight"))
        return own.where("weight > 0").orderBy(F.desc("weight"), "id").limit(limit)

    def expand(self, seed: DataFrame, limit: int = DEFAULTS.max_neighbours) -> DataFrame:
        """(id, score, via): seeds (id, score, via) and their strongest neighbours, from the seeds' lists alone."""
        return retrieval.grown(self.edges_of(seed), seed, limit)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        found = self._entities(m) if name == "entity" else self._weights(m) if name == "related" else self._rows(m, name)
        return found.select(*TABLES[name].fieldNames())

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        return {name: self.table(name, version) for name in TABLES}

    def _bucket(self, m: dict, *names: str):
        return F.pmod(F.xxhash64(*names), F.lit(m["buckets"]))

    def _add(self, m: dict, out: dict, table: str, rows: DataFrame, by: str, order: list[str] | None = None) -> dict:
        part = self.write(rows, table, m["version"] + 1, self._bucket(m, by), order)
        out["rows"].setdefault(table, []).append(part)
        return part

    def _taken(self, m: dict, ids: DataFrame, buckets: list[int]) -> DataFrame:
        """Living mentions of documents ids(owner), read from their buckets."""
        return self._rows(m, "mentions", buckets).join(ids, F.col("doc_id") == F.col("owner"), "left_semi")

    def _signed(self, m: dict, out: dict, new: DataFrame | None, old: DataFrame) -> None:
        """Weights and counts that mentions bring (new) and take away (old)."""
        signs = [rows.select("chunk_id", "entity_id", F.lit(sign).cast("long").alias("sign")) for sign, rows in ((1, new), (-1, old)) if rows is not None]
        changed = signs[0] if len(signs) == 1 else signs[0].unionByName(signs[1])
        self._add(m, out, "adjacent", graph.both_ways(graph.signed_weights(changed)), "x", ["x", "y"])
        self._add(m, out, "counts", changed.groupBy("entity_id").agg(F.sum("sign").alias("n")).where("n <> 0"), "entity_id")

    def _next(self, m: dict) -> dict:
        return {"version": m["version"], "buckets": m["buckets"], "rows": {k: list(v) for k, v in m["rows"].items()}, "deletions": {k: list(v) for k, v in m["deletions"].items()}}

    def _forget(self, m: dict, out: dict, ids: DataFrame, tables) -> None:
        part = self.write(ids.select("owner"), "deletions", m["version"] + 1, self._bucket(m, "owner"))
        for table in tables:
            out["deletions"].setdefault(table, []).append(part)

    def ingest(self, document: DataFrame, create: bool = False, split: Callable[[DataFrame], DataFrame] = ingest.passages,
               extract: Callable[[DataFrame], DataFrame] = ingest.capital_mentions, embedder=models.HashedTerms) -> int:
        """Documents (id, content, ...) to a new version; those that exist are replaced and keep creator and creation date.

        A name that an entity has already, or that several have, goes to the most mentioned one. Reads the buckets of
        the documents and of the names in them, writes their rows."""
        m = self.manifest()
        out = self._next(m)
        ids = document.select(F.col("id").alias("owner")).distinct()
        buckets = [r.b for r in ids.select(self._bucket(m, "owner").cast("int").alias("b")).distinct().collect()] if m["rows"].get("document") else []
        known = self._rows(m, "document", buckets).join(ids, F.col("id") == F.col("owner"), "left_semi").select(
            "id", F.col("creator").alias("old_creator"), F.col("created_at").alias("old_created"))
        if create and known.limit(1).count():
            raise Conflict("a document of that id exists")
        missing = {f.name: F.lit(None).cast(f.dataType) for f in TABLES["document"].fields if f.name not in document.columns}
        if m["rows"].get("document"):
            before = document.withColumns(missing).join(known, "id", "left")
        else:  # nothing to join the texts with
            before = document.withColumns({**missing, "old_creator": F.lit(None).cast("string"), "old_created": F.lit(None).cast("timestamp")})
        full = before.withColumns({
            "creator": F.coalesce("creator", "old_creator"), "created_at": F.coalesce("old_created", "created_at", F.current_timestamp()),
            "updated_at": F.coalesce(F.col("updated_at").cast("timestamp"), F.current_timestamp()), "status": F.coalesce("status", F.lit("PUBLISHED"))})
        fields = TABLES["document"].fields
        documents = self._add(m, out, "document", full.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]), "id")
        written = self.read("document", [documents], self._schema("document"))

        cut = split(written)
        vector = models.embedded(F.col("text"), embedder) if embedder else F.lit(None).cast("array<float>")
        page = F.col("page").cast("long") if "page" in cut.columns else F.lit(0).cast("long")
        images = F.col("images") if "images" in cut.columns else F.lit(None).cast("array<struct<n: bigint, caption: string>>")
        carried = cut.select("id", "doc_id", "idx", "text", vector.alias("embedding"), page.alias("page"), images.alias("images"))
        part = self.write(carried, "chunk", m["version"] + 1, self._bucket(m, "doc_id"))
        out["rows"].setdefault("chunk", []).append(part)
        chunk = self.read("chunk", [part], T.StructType([*self._schema("chunk").fields, T.StructField("images", carried.schema["images"].dataType)]))
        shown = chunk.select(F.col("id").alias("chunk_id"), "doc_id", "page", F.explode("images").alias("i")).withColumn("id", F.concat("doc_id", F.lit("!"), "i.n"))
        self._add(m, out, "image", shown.select("id", "doc_id", F.lit(None).cast("string").alias("file"), F.col("i.caption").alias("caption"), "page", F.col("i.n").alias("n")), "doc_id")
        self._add(m, out, "shows", shown.select("chunk_id", F.col("id").alias("image_id"), "doc_id"), "doc_id")

        aside = f"{self.root}/aside/{uuid.uuid4().hex}"  # read by several tables below
        ingest.cleaned(extract(chunk)).write.parquet(f"{aside}/raw")
        raw = self.spark.read.parquet(f"{aside}/raw")
        keys = raw.select(F.lower("surface").alias("key")).distinct()
        names = [r.b for r in keys.select(self._bucket(m, "key").cast("int").alias("b")).distinct().collect()]
        known_names = self._entities(m, names).join(keys, "key", "left_semi").select("id", "name", "label", "n")
        found, entity = ingest.canonical(raw, known_names, f"{aside}/placed")
        part = self._add(m, out, "mentions", found, "doc_id")
        mentions = self.read("mentions", [part], self._schema("mentions"))
        fresh = entity.join(known_names.select("id"), "id", "left_anti")
        named = models.embedded(F.col("name"), embedder) if embedder else F.lit(None).cast("array<float>")
        self._add(m, out, "entity", fresh.select("id", "name", "label", named.alias("embedding"), F.lower("name").alias("key")), "key")
        self.files.delete(aside)
        self._signed(m, out, mentions, self._taken(m, ids, buckets))
        self._forget(m, out, known.select(F.col("id").alias("owner")), OWNED)
        return self.publish(out)

    def delete(self, ids: list[str] | DataFrame) -> int:
        """Documents, given as a list or as a table (id), with all that hangs on them, in a new version."""
        m = self.manifest()
        gone = ids.select(F.col("id").alias("owner")).distinct() if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in set(ids)], "owner string")
        out = self._next(m)
        buckets = [r.b for r in gone.select(self._bucket(m, "owner").cast("int").alias("b")).distinct().collect()]
        if unknown := gone.join(self._rows(m, "document", buckets), F.col("id") == F.col("owner"), "left_anti").limit(3).collect():
            raise Missing(str([r.owner for r in unknown]))
        self._signed(m, out, None, self._taken(m, gone, buckets))
        self._forget(m, out, gone, OWNED)
        return self.publish(out)

    def patch(self, patch: DataFrame) -> int:
        """New values of documents (id and some fields); only their rows of the document table are written."""
        m = self.manifest()
        out, ids = self._next(m), patch.select(F.col("id").alias("owner")).distinct()
        old = self._rows(m, "document").join(ids, F.col("id") == F.col("owner"), "left_semi").select(*TABLES["document"].fieldNames())
        self._add(m, out, "document", ingest.patched(old, patch, F.current_timestamp()), "id")
        self._forget(m, out, ids, ["document"])
        return self.publish(out)

    def compact(self) -> int:
        """What lives, as one part a table; readers of earlier versions are not disturbed."""
        m = self.manifest()
        out = self._next(m) | {"rows": {}, "deletions": {}}
        for table in OWNED:
            self._add(m, out, table, self._rows(m, table).drop("seq", "turn", "bucket"), OWNED[table])
        self._add(m, out, "adjacent", graph.both_ways(self._weights(m)), "x", ["x", "y"])
        living = self._entities(m)
        self._add(m, out, "counts", living.select(F.col("id").alias("entity_id"), "n"), "entity_id")
        self._add(m, out, "entity", living.drop("n"), "key")
        return self.publish(out)

    def parts(self) -> int:
        """Parts of the latest version; a sign of when to compact."""
        m = self.manifest()
        return sum(map(len, m["rows"].values())) + len({p["turn"] for d in m["deletions"].values() for p in d})
