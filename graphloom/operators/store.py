"""Projects on disk: immutable snapshots of the logical tables behind a manifest.

A write makes a new version and then flips the manifest, so readers see all of it or nothing. Tables that a
write leaves alone are carried over by reference. Paths go through Spark's file system, so any store that it reads works."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom import models
from graphloom.operators import ingest
from graphloom.schema import TABLES

PROJECT_ID = re.compile(r"[a-z0-9][a-z0-9_-]{0,63}")


class Conflict(ValueError):
    """The write clashes with what is there."""


class Missing(KeyError):
    """What is asked for is not there."""


class Files:
    """The few file operations that a manifest needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.gateway, self.conf = spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def read(self, path: str) -> str | None:
        if not self.fs.exists(self.path(path)):
            return None
        stream = self.fs.open(self.path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _put(self, path: str, text: str, overwrite: bool) -> None:
        stream = self.fs.create(self.path(path), overwrite)
        stream.write(bytearray(text.encode()))
        stream.close()

    def replace(self, path: str, text: str) -> None:
        """Write aside, then rename over in one step of the file system: a reader sees the old text or the new."""
        aside = f"{path}.{uuid.uuid4().hex}"
        self._put(aside, text, True)
        over = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = over
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        context.rename(self.fs.makeQualified(self.path(aside)), self.fs.makeQualified(self.path(path)), options)

    def publish(self, path: str, text: str) -> bool:
        """Write aside, then rename to a name that must be free; whether it was."""
        from py4j.protocol import Py4JJavaError

        if self.fs.exists(self.path(path)):
            return False
        aside = f"{path}.{uuid.uuid4().hex}"
        self._put(aside, text, True)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.fs.makeQualified(self.path(aside)), self.fs.makeQualified(self.path(path)), self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError:
            self.delete(aside)
            if not self.fs.exists(self.path(path)):
                raise
            return False
        return True

    def claim(self, path: str) -> bool:
        """Make a file that must not exist; whether this call made it."""
        from py4j.protocol import Py4JJavaError

        try:
            self._put(path, "", False)
        except Py4JJavaError:
            if not self.fs.exists(self.path(path)):
                raise
            return False
        return True

    def age(self, path: str) -> int | None:
        """Milliseconds since a file was written; None if it is not there."""
        import time

        return int(time.time() * 1000) - self.fs.getFileStatus(self.path(path)).getModificationTime() if self.fs.exists(self.path(path)) else None

    def rename(self, path: str, to: str) -> None:
        if not self.fs.rename(self.path(path), self.path(to)):
            raise OSError(f"cannot rename {path}")

    def names(self, path: str) -> list[str]:
        if not self.fs.exists(self.path(path)):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(path)))

    def delete(self, path: str) -> bool:
        return self.fs.delete(self.path(path), True)

    def size(self, path: str) -> int:
        return self.fs.getContentSummary(self.path(path)).getLength() if self.fs.exists(self.path(path)) else 0


class Projects:
    """Projects below a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def list(self) -> list[str]:
        return [n for n in self.files.names(self.root) if self.files.read(f"{self.root}/{n}/manifest.json")]

    def create(self, project: str, model: str = "hashed", name: str | None = None) -> Store:
        if not PROJECT_ID.fullmatch(project):
            raise ValueError(f"not a project id: {project}")
        if not self.files.publish(f"{self.root}/{project}/manifest.json", json.dumps({"version": 0, "model": model, "name": name or project, "tables": {}})):
            raise Conflict(project)
        return self.open(project, model)

    def open(self, project: str, model: str = "hashed") -> Store:
        store = Store(self.spark, f"{self.root}/{project}")
        if store.manifest()["model"] != model:
            raise Conflict(f"{project} was made with the model {store.manifest()['model']}")
        return store

    def rename(self, project: str, name: str) -> None:
        """A new display name."""
        store = Store(self.spark, f"{self.root}/{project}")
        store.publish(store.manifest() | {"name": name})

    def health(self) -> dict:
        """State of the service and its settings."""
        from dataclasses import asdict

        from graphloom.config import DEFAULTS

        return {"status": "ok", "spark": self.spark.version, "projects": len(self.list()), "settings": asdict(DEFAULTS)}

    def delete(self, project: str) -> None:
        if not self.files.delete(f"{self.root}/{project}"):
            raise Missing(project)


class Store:
    """The snapshots of one project."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root, Files(spark, root)

    def manifest(self) -> dict:
        text = self.files.read(f"{self.root}/manifest.json")
        if text is None:
            raise Missing(self.root)
        return json.loads(text)

    @property
    def version(self) -> int:
        """Grows with every write; results are cached by it."""
        return self.manifest()["version"]

    def table(self, name: str) -> DataFrame:
        where = self.manifest()["tables"].get(name)
        return self.spark.read.schema(TABLES[name]).parquet(where) if where else self.spark.createDataFrame([], TABLES[name])

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in TABLES}

    def write(self, changed: dict[str, DataFrame]) -> int:
        """A new version with the changed tables. Of two writers that start from one version the second to end
        fails: the version is claimed by a file that only one can make."""
        manifest, turn = self.manifest(), uuid.uuid4().hex[:8]
        version = manifest["version"] + 1
        for name, df in changed.items():
            path = f"{self.root}/v{version}-{turn}/{name}"
            missing = [f for f in TABLES[name].fields if f.name not in df.columns]
            from pyspark.sql import functions as F

            full = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else df
            full.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields]).write.mode("overwrite").parquet(path)
            manifest["tables"][name] = path
        return self.publish(manifest)

    def publish(self, manifest: dict, stale_ms: int = 600_000) -> int:
        """The manifest as the version after its own. A claim that is older than `stale_ms` is of a writer that died between
        claim and manifest: it is taken over."""
        version = manifest["version"] + 1
        claim = f"{self.root}/claims/{version}"
        if not self.files.claim(claim):
            age = self.files.age(claim)
            if self.version >= version or age is None or age < stale_ms:
                raise Conflict(f"version {version} is written by another")
            self.files.delete(claim)
            if not self.files.claim(claim):
                raise Conflict(f"version {version} is written by another")
        self.files.replace(f"{self.root}/manifest.json", json.dumps(manifest | {"version": version}))
        return version

    def ingest(self, document: DataFrame, create: bool = False, extract=ingest.capital_mentions, structured: bool = True, embedder=models.HashedTerms, **sizes) -> int:
        """Documents to a new version, passages and new entities with their vectors, images with the passages that show
        them; `create` refuses ids that exist, else they are replaced and keep creator and creation date."""
        from pyspark.sql import functions as F

        old = self.tables()
        known = old["document"].join(document.select("id"), "id", "left_semi")
        if create and known.limit(1).count():
            raise Conflict("a document of that id exists")
        before = known.select("id", F.col("creator").alias("old_creator"), F.col("created_at").alias("old_created"))
        missing = {f.name: F.lit(None).cast(f.dataType) for f in TABLES["document"].fields if f.name not in document.columns}
        full = document.withColumns(missing).join(before, "id", "left").withColumns({
            "creator": F.coalesce("creator", "old_creator"), "created_at": F.coalesce("old_created", "created_at", F.current_timestamp()),
            "updated_at": F.coalesce("updated_at", F.current_timestamp()), "status": F.coalesce("status", F.lit("PUBLISHED"))})
        full = full.select(*TABLES["document"].fieldNames())
        chunk = ingest.passages(full, structured, **sizes).withColumn("embedding", models.embedded(F.col("text"), embedder))
        counted = old["mentions"].groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"))
        most = old["entity"].join(counted, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))  # of several of a name the most mentioned
        mentions, entity = ingest.canonical(ingest.cleaned(extract(chunk)), most)
        fresh = entity.join(old["entity"].select("id"), "id", "left_anti").withColumn("embedding", models.embedded(F.col("name"), embedder))
        shown = chunk.select(F.col("id").alias("chunk_id"), "doc_id", "page", F.explode("images").alias("i")).withColumn("id", F.concat("doc_id", F.lit("!"), "i.n"))
        new = {"document": full, "chunk": chunk.drop("images"), "mentions": mentions, "entity": fresh, "shows": shown.select("chunk_id", F.col("id").alias("image_id")),
               "image": shown.select("id", "doc_id", F.col("i.caption").alias("caption"), "page", F.col("i.n").alias("n"))}
        return self.write(ingest.replaced(old, new, full.select("id")))

    def delete(self, ids: list[str]) -> int:
        gone = self.spark.createDataFrame([(i,) for i in ids], "id string")
        old = self.tables()
        if old["document"].join(gone, "id", "left_semi").count() < len(set(ids)):
            raise Missing(str(ids))
        return self.write(ingest.deleted(old, gone))

    def patch(self, patch: DataFrame) -> int:
        from pyspark.sql import functions as F

        return self.write({"document": ingest.patched(self.table("document"), patch, F.current_timestamp())})

    def size(self) -> int:
        return self.files.size(self.root)


class Cache:
    """Results by version and settings, the least recently used dropped; scores of one version."""

    def __init__(self, results: int = 256, scores: int = 20_000):
        from collections import OrderedDict

        self.results, self.most = OrderedDict(), results
        self.scores: dict = {}
        self.score_version, self.most_scores = None, scores

    def get(self, key, build):
        if key not in self.results:
            self.results[key] = build()
            if len(self.results) > self.most:
                self.results.popitem(last=False)
        self.results.move_to_end(key)
        return self.results[key]

    def known_scores(self, version: int, question: str, ids) -> dict:
        if version != self.score_version:
            return {}
        return {i: self.scores[question, i] for i in ids if (question, i) in self.scores}

    def put_scores(self, version: int, question: str, scores: dict) -> None:
        if version != self.score_version or len(self.scores) + len(scores) > self.most_scores:
            self.scores, self.score_version = {}, version
        self.scores |= {(question, i): s for i, s in scores.items()}
