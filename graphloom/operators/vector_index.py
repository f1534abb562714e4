"""Stored vector index: cells around k-means centres, residuals as product-quantised codes.

A vector lies in the folder of its nearest centre, so a search that reads a few cells prunes all others. Beside the
vector stands a code of one byte for each eight components of its residual, and the length of the error that the code
makes. A search reads codes first: with the error, each gives a lower and an upper bound of the similarity. Then only
vectors whose upper bound reaches the k-th best lower bound are scored exactly, so codes lose nothing. With `exact`
cells are read as well whose radius allows a vector that is good enough: the result is that of a whole scan.

Rows are added and taken away as parts (see live.py); centres and code books stay those of the first build, which
learns them from a bounded sample. Null, zero and non-finite vectors have no direction and are not indexed."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.columns import cosine, vector
from graphloom.operators.live import Parts

_ROW = T.StructType([T.StructField("id", T.StringType()), T.StructField("code", T.BinaryType()), T.StructField("error", T.DoubleType()),
                     T.StructField("embedding", T.ArrayType(T.DoubleType()))])
#: Components that one byte of a code stands for.
WIDTH = 8


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lloyd(x: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    """k-means centres of a sample; an empty cell is put on a row drawn anew."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=len(centres))])
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1)[None, :] - 2 * x @ centres.T, axis=1)


def usable(vectors: DataFrame) -> DataFrame:
    """(id, embedding) of vectors that have a direction, as text and doubles."""
    fine = F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))) & F.exists("embedding", lambda c: c != 0)
    return vectors.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & fine)


class VectorIndex(Parts):
    """An index below a folder."""

    @classmethod
    def build(cls, vectors: DataFrame, root: str, cells: int | None = None, sample: int = 20_000, seed: int = 7) -> VectorIndex:
        """Index vectors(id, embedding). Centres (by default the square root of the rows, 4,096 at most) and code books are
        learnt from `sample` rows drawn by a hash of the id; all rows are indexed."""
        index = cls(vectors.sparkSession, root)
        rows = usable(vectors)
        count = rows.count()
        drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # bounded by `sample`
        d = len(drawn[0].embedding) if drawn else 0
        x, rng = _unit(np.array([r.embedding for r in drawn])) if drawn else np.zeros((0, 0)), np.random.default_rng(seed)
        centres = _lloyd(x, cells or max(1, min(4096, round(count**0.5))), rng) if drawn else x
        left = x - centres[_nearest(x, centres)] if drawn else x
        books = [_lloyd(left[:, a:a + WIDTH], 256, rng).tolist() for a in range(0, d, WIDTH)]
        index.files.publish(f"{index.root}/model.json", json.dumps({"centres": centres.tolist(), "books": books}))
        if index.versions() or not index.files.publish(f"{index.root}/versions/{0:012d}.json", json.dumps(
                {"version": 0, "rows": {}, "deletions": {}, "radius": [0.0] * len(centres)})):
            raise ValueError(f"there is an index at {root}")
        if drawn:
            index.add(vectors)
        return index

    def model(self) -> tuple[np.ndarray, list[np.ndarray]]:
        found = json.loads(self.files.read(f"{self.root}/model.json"))
        return np.array(found["centres"]), [np.array(b) for b in found["books"]]

    def _coded(self, rows: DataFrame) -> DataFrame:
        """(id, code, error, embedding, cell, angle) of rows: a place for each vector."""
        centres, books = self.model()  # a few megabytes at most, sent to tasks
        directions = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)

        @F.pandas_udf("struct<code: binary, error: double, cell: int, angle: double>")
        def place(vectors: pd.Series) -> pd.DataFrame:
            if not len(vectors):
                return pd.DataFrame({"code": [], "error": [], "cell": [], "angle": []})
            x = _unit(np.array(vectors.tolist()))
            cell = _nearest(x, centres)
            left = x - centres[cell]
            codes = np.stack([_nearest(left[:, j * WIDTH:(j + 1) * WIDTH], b) for j, b in enumerate(books)], 1)
            known = np.concatenate([b[codes[:, j]] for j, b in enumerate(books)], 1)
            angle = np.arccos(np.clip((x * directions[cell]).sum(1), -1, 1))
            return pd.DataFrame({"code": [c.tobytes() for c in codes.astype(np.uint8)], "error": np.linalg.norm(left - known, axis=1), "cell": cell.astype(np.int32), "angle": angle})

        return rows.withColumn("p", place("embedding")).select("id", "p.code", "p.error", "embedding", "p.cell", "p.angle")

    def add(self, vectors: DataFrame) -> int:
        """Rows in a new version; rows of an id that is there take its place."""
        m, rows = self.manifest(), usable(vectors)
        seq = m["version"] + 1
        coded = self._coded(rows)
        part = self._write(coded, seq)
        wide = self._widths(part)
        m["rows"].setdefault("vectors", []).append(part)
        m["radius"] = [max(r, wide.get(c, 0.0)) for c, r in enumerate(m["radius"])]
        if len(m["rows"]["vectors"]) > 1:
            self._forget(m, rows.select(F.col("id").alias("owner")).distinct())
        return self.publish(m)

    def _write(self, coded: DataFrame, seq: int) -> dict:
        return self.write(coded.withColumnRenamed("cell", "bucket"), "vectors", seq, F.col("bucket"))

    def _widths(self, part: dict) -> dict[int, float]:
        """The largest angle to the centre in each cell of a part: a row a cell."""
        rows = self.read("vectors", [part], T.StructType([*_ROW.fields, T.StructField("angle", T.DoubleType())]))
        return {r.bucket: r.angle for r in rows.groupBy("bucket").agg(F.max("angle").alias("angle")).collect()}

    def _forget(self, m: dict, owners: DataFrame) -> None:
        m["deletions"].setdefault("vectors", []).append(self.write(owners, "deletions", m["version"] + 1, F.lit(0)))

    def remove(self, ids: DataFrame) -> int:
        """Take the vectors of ids(id) away."""
        m = self.manifest()
        self._forget(m, ids.select(F.col("id").cast("string").alias("owner")).distinct())
        return self.publish(m)

    def compact(self) -> int:
        """What lives, as one part; the radius of each cell is measured again."""
        m = self.manifest()
        part = self._write(self._coded(self.rows(m).select("id", "embedding")), m["version"] + 1)
        wide = self._widths(part)
        return self.publish(m | {"rows": {"vectors": [part]}, "deletions": {}, "radius": [wide.get(c, 0.0) for c in range(len(m["radius"]))]})

    def rows(self, m: dict, cells: list[int] | None = None) -> DataFrame:
        return self.living(self.read("vectors", m["rows"].get("vectors", []), _ROW, cells), m["deletions"].get("vectors", []), "id")

    def search(self, query: list[float], k: int, probes: int = 8, exact: bool = False) -> DataFrame:
        """(id, similarity) of the k nearest in the `probes` nearest cells, or of all (`exact`); ties to the smaller id."""
        m = self.manifest()
        centres, books = self.model()
        norm = float(np.linalg.norm(query))
        if not len(centres) or not norm or not np.isfinite(norm):
            return self.spark.createDataFrame([], "id string, similarity double")
        q = np.array(query, float) / norm
        order = np.argsort(-(centres @ q), kind="stable")
        cells = [int(c) for c in order[:probes]]
        read = self._bounds(m, cells, q, centres, books)
        low = read.select((F.col("near") - F.col("error")).alias("low")).orderBy(F.desc("low")).limit(k).agg(F.min("low").alias("low"), F.count("*").alias("n")).first()
        least = low.low - 1e-9 if low.n == k else -2.0
        if exact:
            sure = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
            gap = np.maximum(np.arccos(np.clip(sure @ q, -1, 1)) - np.array(m["radius"]), 0)
            cells = sorted({*cells, *(int(c) for c in np.flatnonzero(np.cos(gap) >= least))})
            read = self._bounds(m, cells, q, centres, books)
        best = read.where(F.col("near") + F.col("error") >= least)
        return best.select("id", cosine(F.col("embedding"), vector(query)).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)

    def _bounds(self, m: dict, cells: list[int], q: np.ndarray, centres: np.ndarray, books: list[np.ndarray]) -> DataFrame:
        """Rows of cells with `near`, the similarity that their code tells."""
        base = centres @ q
        parts = [b @ q[j * WIDTH:(j + 1) * WIDTH] for j, b in enumerate(books)]

        @F.pandas_udf("double")
        def near(code: pd.Series, cell: pd.Series) -> pd.Series:
            if not len(code):
                return pd.Series([], dtype="float64")
            c = np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1)
            return pd.Series(base[cell.to_numpy()] + sum(p[c[:, j]] for j, p in enumerate(parts)))

        return self.rows(m, cells).withColumn("near", near("code", "bucket"))
