"""Embedding whitening by merged moments.

Each partition computes the count, the local mean and the centred scatter of its vectors, batch by batch;
two such states are merged by Chan's formula, and treeReduce merges those of all partitions within the
executors first.  The driver sees a few states of d + d*d numbers, whatever the number of vectors, and takes the
eigenvectors of the covariance.  A second pass whitens every vector and merges the moments of the results:
how far their covariance is from the identity is reported with every row.

Components c become integers floor(1024 c) + 100000, whose sums are exact integers of any size.

Defined results.  Vectors that are null or hold null or non-finite components take no part, nor do those of
another length than most (of equally frequent lengths the smallest counts).  Zero vectors, repeated rows and
rows without id take part.  Components beyond a long's range are cut off there.  `deviation` is null where
the exact number is no long.  Where the vectors vary in fewer than `k` directions, the other components have
null for `whitened`.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema

K, SCALE, SHIFT, DEPTH = 8, 1024, 100_000, 3
#: Vectors of a step.
ROWS = 4096
#: Directions whose variance is at most this part of the largest one count as constant.
CONSTANT = 1e-12


@dataclass
class Moments:
    """Count, mean, centred scatter, and exact sums, of vectors seen so far."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: list

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
        left = x - mean
        whole = [] if x.dtype != np.int64 else [int(h) * (1 << 32) + int(low) for h, low in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), strict=True)]
        return cls(len(x), mean, left.T @ left, whole)

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not self.n or not other.n:
            return self if self.n else other
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n), [a + b for a, b in zip(self.sums, other.sums, strict=True)])


@dataclass
class Whitening:
    """What the driver holds: n and the sums, components by falling variance, and what they explain."""

    n: int
    sums: list
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    @classmethod
    def fit(cls, m: Moments, k: int) -> Whitening:
        values, vectors = np.linalg.eigh(m.scatter / m.n)
        order = np.argsort(-values, kind="stable")[:k]
        values, vectors, trace = np.maximum(values[order], 0), vectors[:, order], max(float(np.trace(m.scatter)) / m.n, 1e-300)
        sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
        return cls(m.n, m.sums, vectors * sign, np.where(values > CONSTANT * values.max(initial=0), values, 0), values / trace)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """The whitened vectors; not a number for constant components."""
        centred = x - np.array([s / self.n for s in self.sums])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (centred @ self.components) / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list:
        """For each vector the exact sum of (n x - S)**2, or None if that is no long."""
        top = max([abs(s) for s in self.sums] + [self.n * int(np.abs(x.astype(np.float64)).max(initial=0))])
        if top < 1 << 62:
            d = self.n * x - np.array(self.sums, np.int64)
            if float(np.abs(d).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
                return (d**2).sum(1).tolist()
        d = self.n * x.astype(object) - np.array(self.sums, object)
        return [v if v < 1 << 63 else None for v in (d**2).sum(1).tolist()]


def _vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their integers."""
    good = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), size), False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(good)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(good), size)
    fine = np.isfinite(flat).all(1)
    return good[fine], np.clip(np.floor(flat[fine] * SCALE) + SHIFT, -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def _moments(rows: DataFrame, size: int, seen) -> Moments | None:
    """The merged moments of what `seen` makes of each step's integers."""

    def run(batches):
        state = None
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                m = Moments.of(seen(_vectors(batch.column(0).slice(a, ROWS), size)[1]))
                state = m if state is None else state.merge(m)
        if state is not None and state.n:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["state"])

    states = rows.select("embedding").mapInArrow(run, "state binary").rdd.map(lambda r: pickle.loads(r.state))
    none = Moments(0, np.zeros(0), np.zeros((0, 0)), [])
    return states.union(rows.sparkSession.sparkContext.parallelize([none], 1)).treeReduce(Moments.merge, DEPTH)


def whiten(vectors: DataFrame, k: int = K) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, out = vectors.select("vec_id", "embedding").filter("embedding is not null"), arrow_schema(schema)
    size = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    moments = _moments(rows, size["size"], lambda x: x) if size and size["size"] else None
    if moments is None or not moments.n:
        return vectors.sparkSession.createDataFrame([], schema)
    size, model = size["size"], Whitening.fit(moments, k)
    varied = np.flatnonzero(model.values > 0)
    again = _moments(rows, size, lambda x: model.apply(x)[:, varied])
    error = float(np.abs(again.scatter / again.n - np.eye(len(varied))).max(initial=0))

    def run(batches):
        c = model.components.shape[1]
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                at, x = _vectors(part.column(1), size)
                w, ids = model.apply(x).ravel(), part.column(0).take(pa.array(np.repeat(at, c)))
                deviation = pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), c)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, c + 1), len(at)), pa.int32()), pa.array(np.full(len(w), model.n)), deviation, pa.array(w, mask=np.isnan(w)), pa.array(np.tile(model.explained, len(at))), pa.array(np.full(len(w), error))], schema=out
                )

    return rows.mapInArrow(run, schema)
