"""Whitening of embeddings by a randomised range finder.

1. Each vector's entries c become whole numbers x = floor(256 c). Equal x vectors are one row of the fit list, a table
   that is written once. Its count and sums are exact.
2. Range finder: a random basis Q of k + oversample columns. A pass over all rows, centred before they are
   multiplied, gives Y = V Q, V the covariance; partial sums of tasks are added up in a few tasks, so the driver gets
   a few small matrices. The orthonormal basis of Y is the next Q: a power pass.
3. Rayleigh-Ritz: each pass also gives Q'VQ, its eigenvectors and the residuals of the leading ones. Where they do
   not fall to rounding level within `passes` passes, the basis is widened, to the full dimension at last, where
   one pass leaves no residual.
4. Rows are projected; the covariance of the whitened fit list is measured in a pass of its own.

Rows whose vector is null or holds null or non-finite entries, or entries whose x no long holds, take no part.
A shorter vector counts as one with zeros at its end. Rows of null or repeated ids are rows like all others. Directions
without variance (e at rounding level) are no components, so equal vectors or a single one give no row; nor does an
empty table. A deviation that no long holds is null. Other columns are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import columns, cut, module_path

_LONG = (1 << 63) - 1


def scaled(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id") -> DataFrame:
    """(vec_id, x): entries as whole numbers, of rows that can be."""
    value = lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))
    whole = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(F.lit(float(scale)) * c.cast("double")) < 2.0**62)
    rows = columns(vectors, id_col, "embedding").where(F.col("embedding").isNotNull()).where(F.forall("embedding", lambda c: F.coalesce(whole(c), F.lit(False))))
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform("embedding", lambda c: value(c).cast("long")).alias("x"))


def _matrix(batch, d: int):
    """The x vectors of an Arrow batch as rows of d longs."""
    import numpy as np

    lists = batch.column(batch.schema.get_field_index("x"))
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == d).all():
        return flat.reshape(-1, d)
    out, at = np.zeros((len(sizes), d), np.int64), 0
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at:at + n]
        at += n
    return out


def _summed(rows: DataFrame, cells: int, per_batch, receivers: int = 16) -> list:
    """Sums over all batches of the vector of `cells` doubles that per_batch gives. Each task gives one row, `receivers`
    tasks add them up, and the driver adds the rest."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(cells)
        for batch in batches:
            if batch.num_rows:
                total += per_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["cells"])

    def add(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(cells)
        for batch in batches:
            for row in batch.column(0).to_pylist():
                total += np.array(row)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["cells"])

    import numpy as np

    found = rows.mapInArrow(run, "cells array<double>").repartition(receivers).mapInArrow(add, "cells array<double>").collect()
    return np.sum([r.cells for r in found], axis=0) if found else np.zeros(cells)


def _exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows and sums by dimension, exact: high and low halves are added apart."""
    def run(batches):
        import pyarrow as pa

        n, high, low = 0, [0] * d, [0] * d
        for batch in batches:
            x = _matrix(batch, d)
            n += len(x)
            high = [a + int(b) for a, b in zip(high, (x >> 31).sum(0), strict=True)]
            low = [a + int(b) for a, b in zip(low, (x & 0x7FFFFFFF).sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(2 * d + 1), pa.int32()), pa.array([n, *high, *low], pa.int64())], names=["cell", "value"])

    got = {r.cell: int(r.value) for r in fit.mapInArrow(run, "cell int, value long").groupBy("cell").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}  # 2 d + 1 rows
    return got.get(0, 0), [(got[1 + j] << 31) + got[1 + d + j] for j in range(d)] if got else [0] * d


def _centred(x, n: int, sums: list[int]):
    """x - S / n: the mean's whole part is taken off in whole numbers, so nothing is lost before the rest goes."""
    import numpy as np

    whole = [s // n for s in sums]
    return (x - np.array(whole, np.int64)).astype(np.float64) - np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])


class Model:
    """n, sums, eigenvalues e and components (one a column), the trace and the identity error."""

    def __init__(self, n, sums, e, parts, trace, identity_error, width, passes):
        self.n, self.sums, self.e, self.parts, self.trace = n, sums, e, parts, trace
        self.identity_error, self.width, self.passes = identity_error, width, passes


def fit(vectors: DataFrame, k: int = 4, oversample: int = 8, passes: int = 6, tolerance: float = 1e-13, seed: int = 7) -> Model | None:
    """The model of scaled vectors (vec_id, x); None without rows or without variance."""
    import numpy as np

    spark = vectors.sparkSession
    module_path(spark)
    d = vectors.agg(F.max(F.size("x")).alias("d")).first().d or 0
    if not d:
        return None
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x"))
    rows = cut(vectors.select(F.concat("x", zeros).alias("x")).distinct(), "whitening-fit")
    n, sums = _exact_sums(rows, d)

    def multiply(q):
        """V q, and the trace of V."""
        def batch(b):
            c = _centred(_matrix(b, d), n, sums)
            return np.append((c.T @ (c @ q)).ravel(), (c * c).sum()) / n

        got = _summed(rows, d * q.shape[1] + 1, batch)
        return got[:-1].reshape(d, -1), float(got[-1])

    rng = np.random.default_rng(seed)
    width, count = min(d, k + oversample), 0
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    while True:
        for _ in range(passes):
            y, trace = multiply(q)
            count += 1
            if trace <= 0:
                return None
            small = q.T @ y
            e, w = np.linalg.eigh((small + small.T) / 2)
            e, w = e[::-1], w[:, ::-1]
            u = q @ w
            residual = np.linalg.norm((y @ w - u * e)[:, :k], axis=0)
            done = (residual <= tolerance * e[0]).all()
            if done or width == d:
                break
            q = np.linalg.qr(y @ w)[0]
        if done or width == d:
            break
        wider = min(d, 4 * width)  # the residuals fail: more columns, the whole space in the end
        q = np.linalg.qr(np.hstack([u, rng.standard_normal((d, wider - width))]))[0]
        width = wider
    keep = int((e[:k] > d * np.finfo(float).eps * trace).sum())
    e, parts = e[:keep].copy(), u[:, :keep].copy()

    def covariance(b):
        white = _centred(_matrix(b, d), n, sums) @ parts / np.sqrt(e)
        return (white.T @ white).ravel() / n

    error = float(np.abs(_summed(rows, keep * keep, covariance).reshape(keep, keep) - np.eye(keep)).max()) if keep else 0.0
    return Model(n, sums, e, parts, trace, error, width, count)


def whiten(vectors: DataFrame, model: Model | None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of scaled vectors, a row a component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.e):
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums, e, parts, trace, error = model.n, model.sums, model.e, model.parts, model.trace, model.identity_error
    d, keep = len(sums), len(e)

    def deviations(x):
        import numpy as np

        most = max(int(abs(x).max(initial=0)), 1) * n + max(map(abs, sums), default=0)
        if d * most * most <= _LONG:
            y = x * n - np.array(sums, np.int64)
            return (y * y).sum(1).tolist()
        exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
        return [v if v <= _LONG else None for v in exact]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch, d)
            white = _centred(x, n, sums) @ parts / np.sqrt(e)
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            back, m = pa.array(np.repeat(np.arange(len(x)), keep)), len(x) * keep
            yield pa.RecordBatch.from_arrays([
                ids.take(back), pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), len(x))), pa.array(np.full(m, n, np.int64)),
                pa.array(deviations(x), pa.int64()).take(back), pa.array(white.ravel()), pa.array(np.tile(e / trace, len(x))), pa.array(np.full(m, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, schema)


def whitened(embeddings: DataFrame, k: int = 4, scale: int = 256) -> DataFrame:
    """All rows of embeddings(vec_id, embedding) on their k leading components, fitted on all of them."""
    rows = scaled(embeddings, scale)
    return whiten(rows, fit(rows, k))
