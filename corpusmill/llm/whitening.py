"""Whitening of embeddings by principal components, with a covariance by polarisation (operator 12).

Entries become integers, so that every sum is exact: first the sums of each dimension, then, of values centred at
the rounded mean, the squares of each dimension and of the sum of each two dimensions. With y = n x - S,
which the centring's remainder corrects to, sum((y_i + y_j)^2) - sum(y_i^2) - sum(y_j^2) is twice sum(y_i y_j); the
matrix of n^2-fold covariances is exact until eigh takes it as doubles. Each task adds up its batches and hands on one
number a pair, which Spark sums; the driver gets numbers by dimensions and pairs, never by rows.

Defined results: rows whose vector is null, holds a null or not finite entry, or one of 2^30 or more in size are left out,
and so are those of another length than the commonest (of equally common ones the longest; empty vectors count
as such a length, and have no components). Null and repeated ids are kept, a row each. Components without variance (an eigenvalue of
RANK times the largest or less) have a null whitened; explained is null where nothing varies; identity_error is taken over
the components with variance, null without any. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Least size of an entry that is left out, so that sums of squares of 10^12 rows fit 38 digits.
TOO_LARGE = float(1 << 30)
RANK = 1e-11
_SAFE = 1 << 62


def as_integers(rows: DataFrame, name: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, x (array<long>): floor(1024 c) + 100000 of each entry, rows with unfit entries left out."""

    def fit(c: Column) -> Column:
        return F.coalesce(F.abs(c.cast("double")) < TOO_LARGE, F.lit(False))  # NaN is larger than all

    kept = rows.where(F.col(vector).isNotNull()).where(F.forall(vector, fit))
    return kept.select(F.col(name).alias("vec_id"), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT).alias("x"))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.asarray(batch.column("x").flatten(), dtype=np.int64).reshape(-1, width)


def exact_sums(values: np.ndarray) -> np.ndarray:
    """Sums of the columns as Python integers, of integers of any size."""
    most = int(np.abs(values).max(initial=0))
    return (values if most * max(len(values), 1) < _SAFE else values.astype(object)).sum(axis=0).astype(object)


def pair_squares(z: np.ndarray) -> np.ndarray:
    """out[i, j] = sum of (z_i + z_j)^2 over rows for i < j, out[i, i] = sum of z_i^2: exact, as Python integers."""
    width = z.shape[1]
    out = np.zeros((width, width), dtype=object)
    most = 4 * int(np.abs(z).max(initial=0)) ** 2
    rows = max(1, min(4096, _SAFE // max(most, 1)))
    for at in range(0, len(z), rows):
        part = np.ascontiguousarray(z[at : at + rows].T)
        if most >= _SAFE:
            part = part.astype(object)
        for i in range(width):
            sums = part[i:] + part[i]
            sums[0] = part[i]
            out[i, i:] += (sums * sums).sum(axis=1).astype(object)
    return out


def _sums(xs: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of rows and the sum of each dimension."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(width, dtype=object)
        for batch in batches:
            n, sums = n + batch.num_rows, sums + exact_sums(_matrix(batch, width))
        yield pa.RecordBatch.from_pydict({"i": list(range(-1, width)), "part": [str(v) for v in (n, *sums)]}, schema=pa.schema([("i", pa.int32()), ("part", pa.string())]))

    rows = xs.select("x").mapInArrow(parts, "i int, part string").groupBy("i").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("v"))
    found = {r.i: int(r.v) for r in rows.collect()}  # a row a dimension
    return found.get(-1, 0), [found.get(i, 0) for i in range(width)]


def _pairs(xs: DataFrame, centre: list[int]) -> np.ndarray:
    """pair_squares of all rows, centred."""
    width = len(centre)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width, width), dtype=object)
        for batch in batches:
            sums = sums + pair_squares(_matrix(batch, width) - np.array(centre, dtype=np.int64))
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(v) for v in sums[i, j]])], ["i", "j", "part"])

    rows = xs.select("x").mapInArrow(parts, "i int, j int, part string").groupBy("i", "j").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("v"))
    out = np.zeros((width, width), dtype=object)
    for r in rows.toLocalIterator():  # a row a pair of dimensions
        out[r.i, r.j] = int(r.v)
    return out


def covariance(n: int, rest: list[int], squares: np.ndarray) -> np.ndarray:
    """Covariances, divisor n, of values whose centred sums are `rest` and centred squares `squares`."""
    width = len(rest)
    # n times the sum of squares less the square of the sum: n^2 times the variance, of each dimension and of each sum of two
    spread = [[n * squares[i, j] - ((rest[i] + rest[j]) if i < j else rest[i]) ** 2 for j in range(width)] for i in range(width)]
    out = np.zeros((width, width))
    for i in range(width):
        out[i, i] = spread[i][i] / (n * n)
        for j in range(i + 1, width):
            out[i, j] = out[j, i] = (spread[i][j] - spread[i][i] - spread[j][j]) / (2 * n * n)
    return out


def whiten(rows: DataFrame, name: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """rows (vec_id, embedding) -> vec_id, component, n, deviation (decimal), whitened, explained, identity_error.

    Four scans: lengths and sums, pair squares, the whitened values' covariance, and the result.
    """
    columns = "vec_id {}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double".format(rows.schema[name].dataType.simpleString())
    xs = as_integers(rows, name, vector)
    common = xs.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = common[0].width if common else 0
    if not width:
        return rows.sparkSession.createDataFrame([], columns)
    xs = xs.where(F.size("x") == width)
    n, sums = _sums(xs, width)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    values, vectors = np.linalg.eigh(covariance(n, rest, _pairs(xs, centre)))
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(width)] < 0, -1.0, 1.0)
    count, trace = min(most, width), float(values.sum())
    varied = int((values[:count] > RANK * values[0]).sum()) if values[0] > 0 else 0
    turn = vectors[:, :varied] / np.sqrt(values[:varied])
    offset = np.array([r / n for r in rest])
    middle = np.array(centre, dtype=np.int64)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((varied + 1, varied))
        for batch in batches:
            w = ((_matrix(batch, width) - middle) - offset) @ turn
            sums += np.vstack([w.sum(axis=0), w.T @ w])
        i, j = np.indices(sums.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums.ravel())], ["i", "j", "part"])

    error = None
    if varied:
        found = np.zeros((varied + 1, varied))
        for r in xs.select("x").mapInArrow(squares, "i int, j int, part double").groupBy("i", "j").agg(F.sum("part").alias("v")).collect():  # 72 rows at most, for 8 components
            found[r.i, r.j] = r.v / n
        error = float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(varied)).max())
    explained = [float(v) / trace if trace > 0 else None for v in values[:count]]

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _matrix(batch, width) - middle
            safe = (n * (int(np.abs(z).max(initial=0)) + 1)) ** 2 * width < _SAFE
            y = (z if safe else z.astype(object)) * n - np.array(rest, dtype=np.int64 if safe else object)
            deviation = [int(v) for v in (y * y).sum(axis=1)]
            white = np.full((len(z), count), np.nan)
            white[:, :varied] = (z - offset) @ turn
            flat = white.ravel()
            k = len(z)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(k), count))), pa.array(np.tile(np.arange(1, count + 1), k), pa.int32()), pa.array(np.full(k * count, n), pa.int64()),
                    pa.array([str(d) for d in deviation]).take(pa.array(np.repeat(np.arange(k), count))), pa.array(flat, mask=np.isnan(flat)), pa.array(explained * k, pa.float64()), pa.array([error] * (k * count), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return xs.mapInArrow(results, columns.replace("decimal(38,0)", "string")).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is null where it passes a long."""
    done = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return done.withColumn("deviation", F.col("deviation").try_cast("long"))
