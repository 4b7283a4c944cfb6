"""Centroid clustering of integer vectors, exact at every step.

Vectors are dealt into blocks; a block's squared distances to all centroids are
|x|^2 - 2 x.c + |c|^2, one float64 matrix product. All numbers are integers, so
while every partial sum stays below 2^53 the product is exact in any order of
summation. Whatever could pass that bound goes to integers instead: 64 bits
where these hold, else Python's own. Each block sums its vectors by cluster, and
an RDD's treeAggregate combines these sums without a bound on their size, so
what reaches the driver are sums for each centroid, whatever the number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dpspark.llm.common import shared_dir, written

# Fixed values of the query.
DIM, CENTROIDS, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
#: Vectors and distances of a block at most, and the largest long.
BLOCK, DISTANCES, LONG = 4096, 1 << 22, (1 << 63) - 1
SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole(block: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as doubles, which hold every such integer; infinite where only Python's integers do."""
    with np.errstate(over="ignore"):
        return np.floor(block * scale)


def integers(block: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as Python integers."""

    def of(x: float) -> int:
        top, bottom = float(x).as_integer_ratio()
        return top * scale // bottom

    return np.array([[of(x) for x in row] for row in block.tolist()], object).reshape(block.shape)


def bound(dim: int, limit: int) -> int:
    """The largest m for which four sums of ``dim`` squares of numbers up to m are below ``limit``."""
    m = 1
    while 4 * dim * (2 * m) ** 2 < limit:
        m *= 2
    return m


def by_product(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product; exact up to ``bound(dim, 2**53)``."""
    return ((x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)


def by_integers(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of Python integers."""
    return np.array([[sum((a - b) ** 2 for a, b in zip(row, centre, strict=True)) for centre in c] for row in x.tolist()], object).reshape(len(x), len(c))


@dataclass
class Nearest:
    """cluster: of each vector; distance: Python integers where a long can't hold them, else int64; rows: the vectors as integers."""

    cluster: np.ndarray
    distance: np.ndarray
    rows: np.ndarray


def nearest(block: np.ndarray, centres: list[list[int]], scale: int = SCALE) -> list[tuple[np.ndarray, Nearest]]:
    """For the vectors of a block, in up to three groups by their size: their places, and the nearest centroid of each (ties: the smaller number).

    A vector within the float64 bound is held against centroids within it by a
    product. A centroid beyond the bound is left out for it if its distance is
    certain to be larger; else the vector goes to integers with all centroids.
    """
    x = whole(block, scale)
    dim = x.shape[1]
    exact, long = bound(dim, 1 << 53), bound(dim, 1 << 62)
    size = np.abs(x).max(axis=1, initial=0.0)
    reach = [max((abs(v) for v in c), default=0) for c in centres]
    # a centroid this far is further from a vector within the bound than any centroid within it
    far = exact + 2 * exact * (int(np.ceil(np.sqrt(dim))) + 1)
    near = [k for k, r in enumerate(reach) if r <= exact]
    plain = bool(near) and all(r <= exact or r > far for r in reach)
    out, left = [], np.ones(len(x), bool)
    if plain and (rows := size <= exact).any():
        d = by_product(x[rows], np.array([centres[k] for k in near], float))
        best = d.argmin(axis=1)
        out.append((np.flatnonzero(rows), Nearest(np.array(near)[best], d[np.arange(len(d)), best], x[rows].astype(np.int64))))
        left &= ~rows
    if max(reach, default=0) <= long and (rows := left & (size <= long)).any():
        v = x[rows].astype(np.int64)
        d = np.stack([((v - np.array(c, np.int64)) ** 2).sum(axis=1) for c in centres], axis=1)
        best = d.argmin(axis=1)
        out.append((np.flatnonzero(rows), Nearest(best, d[np.arange(len(d)), best], v)))
        left &= ~rows
    if left.any():
        v = integers(block[left], scale)
        d = by_integers(v, np.array(centres, object))
        best = np.array([min(range(len(centres)), key=row.__getitem__) for row in d.tolist()], int)
        out.append((np.flatnonzero(left), Nearest(best, d[np.arange(len(d)), best], v)))
    return out


@dataclass
class Sums:
    """By centroid: vectors, and sums of their components and distances, as Python integers."""

    n: np.ndarray
    total: np.ndarray
    inertia: np.ndarray

    @classmethod
    def zero(cls, k: int, dim: int) -> Sums:
        return cls(np.zeros(k, object), np.zeros((k, dim), object), np.zeros(k, object))

    def add(self, data: bytes, centres: list[list[int]], scale: int) -> Sums:
        block = np.frombuffer(data, np.float64).reshape(-1, self.total.shape[1])
        for _, found in nearest(block, centres, scale):
            for k in np.unique(found.cluster).tolist():
                own = found.cluster == k
                self.n[k] += int(own.sum())
                if found.rows.dtype == object or max(int(np.abs(found.rows).max(initial=0)), int(found.distance.max(initial=0))) >= LONG // (2 * len(block)):
                    self.total[k] += found.rows[own].astype(object).sum(axis=0)
                    self.inertia[k] += sum(map(int, found.distance[own]))
                else:
                    self.total[k] += np.array(found.rows[own].sum(axis=0).tolist(), object)
                    self.inertia[k] += int(found.distance[own].sum())
        return self

    def merge(self, other: Sums) -> Sums:
        return Sums(self.n + other.n, self.total + other.total, self.inertia + other.inertia)


def kept(vectors: DataFrame, dim: int, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors with exactly ``dim`` components, all of them finite."""
    x = F.col(embedding).cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), x.alias("x"))
    return rows.where((F.size("x") == dim) & F.coalesce(finite, F.lit(False)))


def _blocks(size: int):
    """Rows of an Arrow batch as blocks of up to ``size`` vectors of raw doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.slice(at, size)
                x = part["x"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([part["vec_id"].to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], names=["ids", "data"])

    return run


def seeds(rows: DataFrame, k: int, seed: int, scale: int = SCALE) -> list[list[int]]:
    """The ``k`` vectors with the smallest hash of ``seed`` and id; null ids come last, equal ids by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), "x").limit(k).collect()
    return integers(np.array([r["x"] for r in first], float), scale).tolist() if first else []


def fingerprint(centre: Sequence[int]) -> str:
    return hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """Every vector's cluster after ``rounds`` of exact k-means on integers floor(scale * x).

    One row per kept row of ``vectors`` (vec_id, embedding): vec_id, cluster,
    distance (squared), cluster_inertia, inertia, centroid_sha256. A vector that
    is null, has another number of components, or a null or non-finite one, is
    left out. Ties go to the smaller number; a centroid without vectors stays.
    Fewer than ``k`` vectors make as many centroids; an empty table gives no row.
    Repeated rows and ids and null ids are vectors like others; other columns are
    ignored. A distance or inertia beyond a long is null; clusters are exact then
    too. ``scale`` is a power of two.
    """
    spark = vectors.sparkSession
    rows = kept(vectors, dim)
    centres = seeds(rows, k, seed, scale)
    blocks = written(rows.mapInArrow(_blocks(max(1, min(BLOCK, DISTANCES // k))), "ids array<long>, data binary"), shared_dir(spark), "blocks")
    if not centres:
        return spark.createDataFrame([], SCHEMA)
    data = blocks.select("data").rdd

    def sums(now: list[list[int]]) -> Sums:
        held = spark.sparkContext.broadcast(now)
        return data.treeAggregate(Sums.zero(len(now), dim), lambda s, row: s.add(row["data"], held.value, scale), Sums.merge)

    for _ in range(rounds):
        found = sums(centres)
        moved = [[t // n for t in total] if n else list(c) for n, total, c in zip(found.n, found.total.tolist(), centres, strict=True)]
        if moved == centres:
            break
        centres = moved
    final = sums(centres)
    return assigned(blocks, centres, [int(x) for x in final.inertia], dim, scale)


def assigned(blocks: DataFrame, centres: list[list[int]], inertia: list[int], dim: int, scale: int) -> DataFrame:
    """The blocks' vectors with their cluster and its figures."""
    names = [fingerprint(c) for c in centres]

    def long(x: int) -> int | None:
        return int(x) if x <= LONG else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(batch["ids"], batch["data"], strict=True):
                for at, found in nearest(np.frombuffer(data.as_py(), np.float64).reshape(-1, dim), centres, scale):
                    of = found.cluster.tolist()
                    yield pa.RecordBatch.from_arrays([
                        ids.values.take(pa.array(at)), pa.array(of, pa.int32()), pa.array([long(d) for d in found.distance.tolist()], pa.int64()),
                        pa.array([long(inertia[c]) for c in of], pa.int64()), pa.array([long(sum(inertia))] * len(of), pa.int64()), pa.array([names[c] for c in of]),
                    ], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.mapInArrow(run, SCHEMA)


def sql(rounds: int = ROUNDS) -> str:
    """The query's rows, with one step for each round."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, [CAST(floor({SCALE} * x) AS BIGINT) FOR x IN CAST(embedding AS DOUBLE[])] AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN CAST(embedding AS DOUBLE[])])
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS k, v FROM (SELECT v, sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS h FROM kept ORDER BY h, v LIMIT {CENTROIDS})
)"""]
    distance = "list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(a.v, c.v)])"
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT row, vec_id, v, best.k AS k, best.d AS d FROM (
    SELECT a.row, any_value(a.vec_id) AS vec_id, any_value(a.v) AS v, min({{'d': CAST({distance} AS BIGINT), 'k': c.k}}) AS best
    FROM (SELECT row_number() OVER () AS row, vec_id, v FROM kept) a, c{i} c GROUP BY a.row)
)""")
        if i < rounds:
            steps.append(f"""
s{i} AS (
  SELECT k, place, sum(x) AS t, count(*) AS n FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{i}) GROUP BY k, place
), c{i + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT k, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY place) AS v FROM s{i} GROUP BY k) m ON c.k = m.k
)""")
    return f"""
WITH {','.join(steps)}
SELECT vec_id, a.k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.k = c.k
"""


SQL = sql()
