"""A log in segments: files that never change, behind manifests that tell what is visible.

A segment is one append, sorted by time. Its manifest entry holds rows, least and greatest time of each project, so
the last records are read from the few segments that can hold them, and a cleared project is an entry that goes: no
file is rewritten and no other project's record moves. Appending, clearing, rotating and compacting each publish one
manifest. A writer that dies before that leaves a folder that nobody reads and that `sweep` removes; of two writers
that start from one version the second takes its change to the new one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.live import Parts
from graphloom.operators.store import Conflict
from graphloom.schema import CALL

_NEVER = -(1 << 63)  # records without a time are older than all others


class SegmentLog(Parts):
    """A log of calls, or of other records with a time `at`; records without a project column are one project's."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType = CALL):
        super().__init__(spark, root)
        self.schema, self.owned = schema, "project" in schema.fieldNames()

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: T.StructType = CALL) -> SegmentLog:
        log = cls(spark, root, schema)
        if log.versions() or not log.files.publish(f"{log.root}/versions/{0:012d}.json", json.dumps({"version": 0, "live": [], "old": [], "streams": {}})):
            raise Conflict(root)
        return log

    def _path(self, name: str) -> str:
        return f"{self.root}/segments/segment={name}"

    def _change(self, edit: Callable[[dict], dict], tries: int = 20) -> int:
        """Publish an edit of the newest manifest; where another writer was first, the same edit of the next one."""
        for _ in range(tries):
            try:
                return self.publish(edit(self.manifest()))
            except Conflict:
                continue
        raise Conflict(f"{self.root} changed {tries} times")

    def _write(self, rows: DataFrame) -> dict | None:
        """A segment of rows, not yet visible; None without rows. Its pieces, one a project, are counted from what was written."""
        own = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        name = uuid.uuid4().hex
        rows.select(*own).sortWithinPartitions(F.desc("at")).write.option("compression", "zstd").parquet(self._path(name))
        at = F.coalesce("at", F.lit(_NEVER))
        project = F.col("project") if self.owned else F.lit(None).cast("string")
        pieces = self.spark.read.schema(self.schema).parquet(self._path(name)).groupBy(project.alias("project")).agg(
            F.count("*").alias("rows"), F.min(at).alias("first"), F.max(at).alias("last")).collect()  # a row a project
        if not pieces:
            self.files.delete(self._path(name))
            return None
        return {"name": name, "bytes": self.files.size(self._path(name)), "pieces": [list(p) for p in pieces], "cleared": []}

    def append(self, rows: DataFrame) -> int:
        """Add records; the version that shows them."""
        made = self._write(rows)
        return self._change(lambda m: m | {"live": m["live"] + [made] * (made is not None)})

    def append_stream(self, rows: DataFrame, stream: str, checkpoint: str):
        """Add the records of a stream, each batch once: the manifest that shows a batch also names it. Gives the writer, to be started."""

        def add(batch: DataFrame, number: int) -> None:
            self.append_batch(batch, stream, number)

        return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)

    def append_batch(self, rows: DataFrame, stream: str, number: int) -> bool:
        """Add a numbered batch of a stream unless it is there; whether it was added."""
        if self.manifest()["streams"].get(stream, -1) >= number:
            return False
        made, added = self._write(rows), False

        def edit(m: dict) -> dict:
            nonlocal added
            added = m["streams"].get(stream, -1) < number
            return m | {"live": m["live"] + [made] * (added and made is not None), "streams": m["streams"] | ({stream: number} if added else {})}

        self._change(edit)
        return added

    def _visible(self, segments: list[dict]) -> DataFrame:
        """Records of segments without those of projects cleared from them."""
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        base = f"{self.root}/segments"
        full = T.StructType([*self.schema.fields, T.StructField("segment", T.StringType())])
        rows = self.spark.read.schema(full).option("basePath", base).parquet(*[self._path(s["name"]) for s in segments])
        cleared = [(s["name"], p) for s in segments for p in s["cleared"]]
        if cleared:  # as many rows as the manifest has entries
            gone = F.broadcast(self.spark.createDataFrame(cleared, "in_segment string, gone string"))
            rows = rows.join(gone, (F.col("segment") == F.col("in_segment")) & F.col("project").eqNullSafe(F.col("gone")), "left_anti")
        return rows.drop("segment")

    def records(self, rotated: bool = False) -> DataFrame:
        """All visible records; with `rotated` also those that rotation has put aside."""
        m = self.manifest()
        return self._visible(m["live"] + (m["old"] if rotated else []))

    def last(self, most: int = 20_000, project: str | None = None) -> DataFrame:
        """The last records, of one project if it is named; equal times in the order of the other columns. Segments, and within
        them times, that `most` known records outdo are not read."""
        segments = self.manifest()["live"]
        pieces = [(first, rows) for s in segments for p, rows, first, _ in s["pieces"] if project is None or p == project]
        since, known = _NEVER, 0
        for first, rows in sorted(pieces, reverse=True):
            known += rows
            if known >= most:
                since = first
                break
        rows = self._visible([s for s in segments if any(last >= since for p, _, _, last in s["pieces"] if project is None or p == project)])
        if since > _NEVER:
            rows = rows.where(F.col("at") >= since)
        if project is not None:
            rows = rows.where(F.col("project") == project)
        return rows.orderBy(F.desc("at"), *[c for c in self.schema.fieldNames() if c != "at"]).limit(most)

    def clear(self, project: str | None = None) -> int:
        """Forget a project's records, or all, those put aside included; how many of the visible ones went."""
        count = 0

        def without(segments: list[dict]) -> list[dict]:
            out = []
            for s in segments:
                stay = [p for p in s["pieces"] if project is not None and p[0] != project]
                if stay:
                    out.append(s if len(stay) == len(s["pieces"]) else s | {"pieces": stay, "cleared": [*s["cleared"], project]})
            return out

        def edit(m: dict) -> dict:
            nonlocal count
            count = sum(p[1] for s in m["live"] for p in s["pieces"] if project is None or p[0] == project)
            return m | {"live": without(m["live"]), "old": without(m["old"])}

        self._change(edit)
        return count

    def rotate(self, most_bytes: int = 20_000_000) -> int:
        """Put all segments aside when together they have grown above the limit; how many went."""
        moved = 0

        def edit(m: dict) -> dict:
            nonlocal moved
            moved = len(m["live"]) if sum(s["bytes"] for s in m["live"]) > most_bytes else 0
            return m | {"live": [], "old": m["old"] + m["live"]} if moved else m

        self._change(edit)
        return moved

    def compact(self, part_rows: int = 1_000_000) -> int:
        """Write the visible records as one segment, files by time; a Conflict, and no change, if another writer came between."""
        m = self.manifest()
        rows = sum(p[1] for s in m["live"] for p in s["pieces"])
        made = self._write(self._visible(m["live"]).repartitionByRange(max(1, rows // part_rows), F.desc("at"))) if rows else None
        return self.publish(m | {"live": [made] if made else []})

    def sweep(self, keep: int = 2, older_ms: int = 3_600_000) -> int:
        """Forget all versions but the `keep` latest, and segments of that age that they do not name; how many segments went."""
        known = self.versions()
        named = {s["name"] for v in known[-keep:] for m in [self.manifest(v)] for s in m["live"] + m["old"]}
        for v in known[:-keep]:
            self.files.delete(f"{self.root}/versions/{v:012d}.json")
        gone = [n for n in self.files.names(f"{self.root}/segments") if n.removeprefix("segment=") not in named
                and (self.files.age(f"{self.root}/segments/{n}") or 0) >= older_ms]  # a younger one may be an append at work
        for n in gone:
            self.files.delete(f"{self.root}/segments/{n}")
        return len(gone)
