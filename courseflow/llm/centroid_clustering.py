"""Exact integer k-means over vectors, with centroids filtered by an n-simplex projection.

A few vectors are pivots. The squared distances of a vector to them, computed once in integers and kept,
place it as the apex over the pivots' simplex: coordinates within the pivots' span and the height above it.
Between two apexes, the distance with both heights on one side is at most the true distance, that with the
heights on opposite sides at least. A centroid whose lower bound exceeds another's upper bound is not the
nearest; the others are compared exactly. Bounds are widened by a bound of their rounding error, so what is
chosen never depends on floating point: the base of the simplex is computed to 60 digits.

A round is one pass over the kept table. Tasks return sums and counts a cluster (exact, in limbs of 32 bits,
so no value can overflow), which are added up in Spark; the driver gets at most that many numbers.

Defined cases: vectors that are null, of another length, or that hold null or non-finite components take no
part; ties go to the smaller number; rows that share a vec_id are vectors of their own, of which those
of smaller components start first; a row with a null vec_id starts a centroid only if there are not enough
others; fewer vectors than centroids give fewer centroids; equal starting vectors leave the later ones empty; components
of any finite size are exact (beyond 2**27 after scaling without the filter), and a distance or an inertia
that 64 bits cannot hold is null; an empty table gives no rows; further columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courseflow.llm.shared import materialise

DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
NARROW = 1 << 27  # components below it have squared distances below 2**62
LIMB = 32
ULP = 2.0**-52


def usable(vectors: DataFrame, dimensions: int) -> DataFrame:
    """(vec_id, x): the vectors that take part, as doubles."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.size(F.filter("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))) == dimensions
    return vectors.select("vec_id", x.alias("x")).where((F.size("x") == dimensions) & fine)


def scaled(x: float, scale: int) -> int:
    """floor(scale * x) for a scale that is a power of two, exact at any size."""
    y = scale * x
    return int(np.floor(y)) if np.isfinite(y) else int(x) * scale


class Simplex:
    """The base over pivots (rows of integers), without those that lie nearly in the span of the others."""

    def __init__(self, pivots: list[list[int]]):
        self.pivots = [pivots[0]]
        rows: list[list[Decimal]] = []
        with localcontext() as ctx:
            ctx.prec = 60
            for p in pivots[1:]:
                own = [a - b for a, b in zip(p, self.pivots[0])]
                gram = [Decimal(sum(a * (b - c) for a, b, c in zip(own, q, self.pivots[0]))) for q in self.pivots[1:]]
                row: list[Decimal] = []
                for i, g in enumerate(gram):
                    row.append((g - sum((a * b for a, b in zip(row, rows[i])), Decimal(0))) / rows[i][i])
                length = Decimal(sum(a * a for a in own))
                height = length - sum((a * a for a in row), Decimal(0))
                if height > length / 1000:
                    self.pivots.append(p)
                    rows.append([*row, height.sqrt()])
            k = len(rows)
            inverse = [[Decimal(0)] * k for _ in range(k)]
            for j in range(k):
                for i in range(j, k):
                    done = sum((rows[i][m] * inverse[m][j] for m in range(j, i)), Decimal(0))
                    inverse[i][j] = ((1 if i == j else 0) - done) / rows[i][i]
            self.inverse = np.array([[float(x) for x in r] for r in inverse]).reshape(k, k)
        self.base = np.array([float(sum((a - b) ** 2 for a, b in zip(p, self.pivots[0]))) for p in self.pivots[1:]])

    def apexes(self, squared: np.ndarray) -> np.ndarray:
        """Coordinates, height and error bound of each row of squared distances to the pivots."""
        zero, rest = squared[:, :1], squared[:, 1:]
        g, size = (zero + self.base - rest) / 2, zero + self.base + rest
        y = g @ self.inverse.T
        error = (size * (4 + len(self.base)) * ULP) @ np.abs(self.inverse).T
        e = np.sqrt((error * error).sum(1))
        within = (y * y).sum(1)
        height2 = np.maximum(zero[:, 0] - within, 0)
        slack = (2 * np.sqrt(within) + e) * e + 16 * ULP * (zero[:, 0] + within)
        height = np.sqrt(height2)
        with np.errstate(divide="ignore", invalid="ignore"):
            off = np.where(height2 > 0, np.minimum(np.sqrt(slack), slack / height), np.sqrt(slack))
        return np.column_stack([y, height, 1.001 * (e + off)])


def bounds(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distance between each apex of x and of c."""
    flat = ((x[:, None, :-2] - c[None, :, :-2]) ** 2).sum(2)
    near, far = ((x[:, None, -2] + sign * c[None, :, -2]) ** 2 for sign in (-1, 1))
    error = x[:, None, -1] + c[None, :, -1]
    return np.sqrt(flat + near) * (1 - 1e-12) - error, np.sqrt(flat + far) * (1 + 1e-12) + error


def is_narrow(v: list[int]) -> bool:
    return all(-NARROW < x < NARROW for x in v)


def _squared(v: np.ndarray, points: list[list[int]]) -> np.ndarray:
    return np.column_stack([((v - np.array(p, np.int64)) ** 2).sum(1) for p in points])


class Nearest:
    """The nearest of ``centroids`` for rows of the kept table."""

    def __init__(self, centroids: list[list[int]], simplex: Simplex | None):
        self.centroids, self.filtered = centroids, 0
        fit = [i for i, c in enumerate(centroids) if is_narrow(c)]
        self.fit, self.wide = fit, [i for i in range(len(centroids)) if i not in set(fit)]
        self.points = np.array([centroids[i] for i in fit], np.int64)
        self.apexes = simplex.apexes(_squared(self.points, simplex.pivots).astype(float)) if simplex and fit else None

    def narrow(self, v: np.ndarray, apex: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """(cluster, squared distance) of vectors below NARROW. A wide centroid is compared in Python integers."""
        n = len(v)
        if not self.fit:
            return self.exact(v.tolist())
        keep = np.ones((n, len(self.fit)), bool)
        if self.apexes is not None:
            lower, upper = bounds(apex, self.apexes)
            keep = lower <= upper.min(1, keepdims=True)
            self.filtered += int(keep.size - keep.sum())
        d = np.full((n, len(self.fit)), np.iinfo(np.int64).max)
        for j in range(len(self.fit)):
            at = np.flatnonzero(keep[:, j])
            d[at, j] = ((v[at] - self.points[j]) ** 2).sum(1)
        best = d.argmin(1)
        cluster, distance = np.array(self.fit)[best], d[np.arange(n), best]
        if not self.wide:
            return cluster, distance
        return self._with_wide(v.tolist(), cluster.tolist(), distance.tolist())

    def _with_wide(self, rows: list[list[int]], cluster: list[int], distance: list[int]) -> tuple[np.ndarray, list[int]]:
        for r, row in enumerate(rows):
            distance[r], cluster[r] = min([(distance[r], cluster[r]), *((sum((a - b) ** 2 for a, b in zip(row, self.centroids[i])), i) for i in self.wide)])
        return np.array(cluster, np.int64), distance

    def exact(self, rows: list[list[int]]) -> tuple[np.ndarray, list[int]]:
        found = [min((sum((a - b) ** 2 for a, b in zip(row, c)), i) for i, c in enumerate(self.centroids)) for row in rows]
        return np.array([i for _, i in found], np.int64), [d for d, _ in found]


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _kept(rows: DataFrame, simplex: Simplex | None, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, v, wide, apex): integers, as decimal texts where they are wide, and the apex of narrow vectors."""
    width = len(simplex.pivots) + 1 if simplex else 0

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), dimensions, float)
            with np.errstate(over="ignore"):
                y = np.floor(scale * x)
            narrow = (np.abs(y) < NARROW).all(1)
            v = np.where(narrow[:, None], y, 0).astype(np.int64)
            wide = [None if fine else [str(scaled(c, scale)) for c in row] for fine, row in zip(narrow, x)]
            apex = simplex.apexes(_squared(v, simplex.pivots).astype(float)) if simplex else np.zeros((len(v), 0))
            lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists(v), pa.array(wide, pa.list_(pa.string())), lists(apex.reshape(len(v), width))], ["vec_id", "v", "wide", "apex"])

    return rows.mapInArrow(keep, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, v array<long>, wide array<string>, apex array<double>")


def _placed(batch: pa.RecordBatch, nearest: Nearest, width: int, dimensions: int):
    """(narrow, vectors, wide vectors, cluster, distance): the assignment of a batch; ``narrow`` tells rows apart."""
    narrow = batch.column("wide").is_null().to_numpy(zero_copy_only=False)
    v = _matrix(batch.column("v"), dimensions, np.int64)
    wide = [[int(x) for x in row] for row in batch.column("wide").filter(pa.array(~narrow)).to_pylist()]
    cluster, distance = np.zeros(len(v), np.int64), np.zeros(len(v), object)
    for some, (c, d) in ((narrow, nearest.narrow(v[narrow], _matrix(batch.column("apex"), width, float)[narrow])), (~narrow, nearest.exact(wide))):
        cluster[some], distance[some] = c, d
    return narrow, v, wide, cluster, distance


def limbs(x: int) -> Iterator[tuple[int, int]]:
    """(place, limb) with x = the sum of limb << (32 * place); limbs fit 33 bits."""
    place = 0
    while not -(1 << LIMB) < x < 1 << LIMB:
        yield place, x & ((1 << LIMB) - 1)
        x, place = x >> LIMB, place + 1
    yield place, x


def moved(kept: DataFrame, centroids: list[list[int]], simplex: Simplex | None, dimensions: int) -> list[list[int]]:
    """The centroids after one round."""
    width = len(simplex.pivots) + 1 if simplex else 0

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(centroids, simplex)
        total: dict[int, list[int]] = {}
        for batch in batches:
            narrow, v, wide, cluster, _ = _placed(batch, nearest, width, dimensions)
            for c in np.unique(cluster[narrow]).tolist():
                some = narrow & (cluster == c)
                sums = [*v[some].sum(0).tolist(), int(some.sum())]
                total[c] = [a + b for a, b in zip(total[c], sums)] if c in total else sums
            for c, row in zip(cluster[~narrow].tolist(), wide):
                total[c] = [a + b for a, b in zip(total.get(c, [0] * (dimensions + 1)), [*row, 1])]
        rows = [(c, i, place, x) for c, sums in total.items() for i, s in enumerate(sums) for place, x in limbs(s)]
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cluster", "i", "place", "x"])

    sums = kept.mapInArrow(add, "cluster long, i long, place long, x long").groupBy("cluster", "i", "place").agg(F.sum("x").alias("x"))
    found = {c: [0] * (dimensions + 1) for c in range(len(centroids))}
    for r in sums.collect():  # at most centroids x (dimensions + 1) x the limbs of a number
        found[r["cluster"]][r["i"]] += r["x"] << (LIMB * r["place"])
    return [[x // found[c][-1] for x in found[c][:-1]] if found[c][-1] else own for c, own in enumerate(centroids)]


def starts(rows: DataFrame, count: int, scale: int, seed: int = SEED) -> list[list[int]]:
    """The vectors whose hashed ids are least, as integers."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(key.alias("key"), "x").orderBy(F.asc_nulls_last("key"), "x").limit(count).collect()
    return [[scaled(c, scale) for c in r["x"]] for r in first]


def cluster(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part."""
    rows = usable(vectors, dimensions)
    centroids = starts(rows, count, scale)
    pivots = [c for c in centroids if is_narrow(c)]
    simplex = Simplex(pivots) if pivots else None
    kept = materialise(_kept(rows, simplex, dimensions, scale), "vectors")
    for _ in range(rounds if centroids else 0):
        after = moved(kept, centroids, simplex, dimensions)
        if after == centroids:  # then later rounds change nothing either
            break
        centroids = after
    width = len(simplex.pivots) + 1 if simplex else 0

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(centroids, simplex)
        for batch in batches:
            *_, found, distance = _placed(batch, nearest, width, dimensions)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(found, pa.int32()), pa.array([int(d) if d < 1 << 63 else None for d in distance], pa.int64())], ["vec_id", "cluster", "distance"])

    placed = materialise(kept.mapInArrow(assign, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"), "clusters")
    told = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.count("*").alias("n"), F.count("distance").alias("known")).collect()  # a row a centroid
    sums = {r["cluster"]: int(r["d"]) if r["n"] == r["known"] else None for r in told}
    total = sum(sums.values()) if None not in sums.values() else None
    return placed.select("vec_id", "cluster", "distance", _said({c: _fits(d) for c, d in sums.items()}, "long").alias("cluster_inertia"), F.lit(_fits(total)).cast("long").alias("inertia"), _said({c: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for c, v in enumerate(centroids)}, "string").alias("centroid_sha256"))


def _fits(x: int | None) -> int | None:
    return x if x is not None and x < 1 << 63 else None


def _said(values: dict, kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for c, x in values.items():
        out = F.when(F.col("cluster") == c, F.lit(x).cast(kind)).otherwise(out)
    return out
