"""Linear reductions and the consensus of several embeddings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tether.config import Config

MODELING = Config().modeling


@dataclass(frozen=True)
class Projection:
    """v -> (v - mean) @ axes, with each axis's singular value or standard deviation, largest first."""

    mean: np.ndarray
    axes: np.ndarray
    values: np.ndarray

    def apply(self, df: DataFrame, col: str = "vec") -> DataFrame:
        mean, axes = self.mean, self.axes

        def run(batches):
            for batch in batches:
                k = batch.schema.get_field_index(col)
                v = batch.column(k)
                x = np.array(v.flatten()).reshape(len(v), -1) if len(v) else np.zeros((0, len(mean)))
                z = (x - mean) @ axes
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * axes.shape[1]), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([lists if i == k else c for i, c in enumerate(batch.columns)], batch.schema.names)

        return df.withColumn(col, F.col(col).cast("array<double>")).mapInArrow(run, df.withColumn(col, F.col(col).cast("array<double>")).schema)


def moments(df: DataFrame, col: str = "vec") -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sum, sum of outer products); what comes to the driver depends on the number of dimensions alone."""

    def run(batches):
        n, s, g = 0, None, None
        for batch in batches:
            v = batch.column(0)
            if len(v):
                x = np.array(v.flatten()).reshape(len(v), -1)
                n, s, g = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if g is None else g)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([g.ravel().tolist()])], ["n", "s", "g"])

    rows = df.select(F.col(col).cast("array<double>").alias("v")).mapInArrow(run, "n long, s array<double>, g array<double>")
    # partial sums are added element by element before they reach the driver
    flat = rows.select("n", F.posexplode(F.concat("s", "g")).alias("i", "x")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("i").toArrow()
    if not flat.num_rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    x = flat["x"].to_numpy()
    d = int((np.sqrt(1 + 4 * len(x)) - 1) / 2)
    return int(flat["n"][0].as_py()), x[:d], x[d:].reshape(d, d)


def _axes(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    value, vector = np.linalg.eigh((matrix + matrix.T) / 2)
    order = np.argsort(value)[::-1][: min(k, len(value))]
    axes = vector[:, order]
    # the largest entry of an axis is positive, so that reruns agree in sign
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return np.maximum(value[order], 0), axes


def truncated_svd(df: DataFrame, k: int, col: str = "vec") -> Projection:
    """The k leading right singular vectors (fewer if there are fewer dimensions), not centred."""
    n, s, g = moments(df, col)
    if not n:
        raise RuntimeError("no rows to fit")
    value, axes = _axes(g, k)
    return Projection(np.zeros(len(s)), axes, np.sqrt(value))


def pca(df: DataFrame, k: int, col: str = "vec") -> Projection:
    n, s, g = moments(df, col)
    if not n:
        raise RuntimeError("no rows to fit")
    mean = s / n
    value, axes = _axes((g - n * np.outer(mean, mean)) / max(n - 1, 1), k)
    return Projection(mean, axes, np.sqrt(value))


def center_kernel(k: np.ndarray) -> np.ndarray:
    """Double centring: minus row and column means, plus the grand mean."""
    out = k - k.mean(axis=0) - k.mean(axis=1)[:, None] + k.mean()
    return (out + out.T) / 2


def positive_pairs(k: np.ndarray, dims: int, floor: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenpairs above ``floor``, filled up with zeros to ``dims``."""
    value, vector = _axes(k, dims)
    keep = value > floor
    out_v, out_x = np.zeros(dims), np.zeros((len(k), dims))
    out_v[: keep.sum()], out_x[:, : keep.sum()] = value[keep], vector[:, keep]
    return out_v, out_x


def _joint(batch, names: list[str], epsilon: float) -> np.ndarray:
    """All members side by side, each of unit length and scaled, so that inner products are mean cosines."""
    parts = []
    for name in names:
        v = batch.column(name)
        v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
        x = np.array(v.flatten()).reshape(len(v), -1)
        parts.append(x / (np.linalg.norm(x, axis=1, keepdims=True) + epsilon) / np.sqrt(len(names)))
    return np.concatenate(parts, axis=1)


@dataclass(frozen=True)
class Consensus:
    """The anchors' mean and the kernel's axes, both in the space of all members side by side.

    The mean cosine kernel is the inner product of that space, so a row's centred kernel against the anchors, times
    the scaled eigenvectors, is (row - mean) @ axes, however many anchors there are.
    """

    names: tuple[str, ...]
    mean: np.ndarray
    axes: np.ndarray

    def apply(self, df: DataFrame, epsilon: float = 1e-8) -> DataFrame:
        """``id, vec``: every row's mean cosines to the anchors, centred, projected and of unit length."""
        names, mean, axes = list(self.names), self.mean, self.axes

        def run(batches):
            for batch in batches:
                z = (_joint(batch, names, epsilon) - mean) @ axes if len(batch) else np.zeros((0, axes.shape[1]))
                z = z / (np.linalg.norm(z, axis=1, keepdims=True) + epsilon)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "vec"])

        return df.select("id", *[F.col(n).cast("array<double>") for n in names]).mapInArrow(run, "id long, vec array<double>")


def consensus(df: DataFrame, members: list[str], dims: int = MODELING.umap_params["n_components"], anchors: int = MODELING.cosine_consensus_n_samples, epsilon: float = 1e-8) -> Consensus:
    """Kernel PCA of the mean cosine kernel of several embeddings over at most ``anchors`` rows, taken by hash of id.

    With fewer columns than anchors the eigenpairs come from the covariance, which has the same positive ones.
    """
    rows = df.orderBy(F.xxhash64("id"), "id").limit(anchors).select("id", *[F.col(m).cast("array<double>") for m in members]).toArrow()
    if not rows.num_rows:
        raise RuntimeError("no rows to fit")
    x = _joint(rows, members, epsilon)
    mean = x.mean(axis=0)
    x = x - mean
    if x.shape[1] < len(x):
        value, axes = positive_pairs(x.T @ x, dims)
        # signs as of the kernel's eigenvectors: their largest entry is positive
        u = x @ axes
        axes = axes * np.where(u[np.abs(u).argmax(axis=0), np.arange(dims)] < 0, -1, 1)
    else:
        value, vector = positive_pairs(x @ x.T, dims)
        axes = np.where(value > 0, x.T @ vector / np.sqrt(np.where(value > 0, value, 1)), 0)
    return Consensus(tuple(members), mean, axes)
