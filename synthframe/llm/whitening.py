"""Whitening of embedding vectors: each distinct vector is fitted and projected once.

Entries become integers.  Identical vectors are grouped; the distinct ones, weighted by
one or by their copies, give exact sums, a covariance by matrix products of centred
batches, and its eigenvectors.  Each distinct vector is whitened once and joined back to
the rows that hold it.  Only matrices of dimensions x dimensions reach the driver.

Dropped: vectors that are null or hold a null, NaN or infinite entry, and vectors of
another length than the commonest one (the longer, if two are equally common).  Entries
beyond +-2^46 count as +-2^46.  Components with no variance (an eigenvalue of at most
1e-12 of the trace) are left out, so one distinct vector alone, and an empty table, give
no rows.  Repeated rows, equal vectors and null ids are ordinary rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthframe.functions.frames import lookup_join
from synthframe.llm.common import stash, tidied
from synthframe.session import ship_package

SCALE = 64
OFFSET = 1_000_000
LARGEST = float(1 << 52)
FLAT = 1e-12
LONG = (1 << 63) - 1


@dataclass
class Whitening:
    """Exact sums of the fit list, and the components by falling eigenvalue (one a column)."""

    n: int
    sums: list[int]
    trace: float
    eigenvalues: np.ndarray
    components: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n without cancellation: the whole part is taken off as integers."""
        shift, rest = self.shift()
        return (x - shift).astype(float) - np.array([float(r) / self.n for r in rest])

    def shift(self) -> tuple[np.ndarray, list[int]]:
        whole = [s // self.n for s in self.sums]
        return np.array(whole, dtype=np.int64), [s - self.n * w for s, w in zip(self.sums, whole, strict=True)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.eigenvalues))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 per vector, exact; null where a long cannot hold it."""
        shift, rest = self.shift()
        y = x - shift
        largest = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if x.shape[1] * largest * largest <= LONG:
            return (((self.n * y - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1)).tolist()
        exact = [sum((self.n * int(v) - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in y]
        return [e if e <= LONG else None for e in exact]


def matrix(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dims)


def integer_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, x) of the valid rows, and the length of x."""
    rows = vectors.select("vec_id", F.transform("embedding", lambda c: c.cast("double")).alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & sound)
    common = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = common["dims"] if common else 0

    def whole(c):
        return F.floor(F.greatest(F.least(c * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))).cast("long") + OFFSET

    return rows.filter(F.size("v") == dims).select("vec_id", F.transform("v", whole).alias("x")), dims


def exact_sums(distinct: DataFrame, dims: int, weight: str) -> tuple[int, list[int]]:
    """Total weight and weighted sums per dimension; each task sends one row a dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for batch in batches:
            w = batch[weight].to_numpy().astype(np.int64)
            x = matrix(batch["x"], dims, np.int64)
            high, low = x >> 26, x & ((1 << 26) - 1)  # neither sum can overflow
            n += int(w.sum())
            sums = [s + (int(h) << 26) + int(v) for s, h, v in zip(sums, w @ high, w @ low, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()),
                                              pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], ["dim", "n", "s"])

    rows = distinct.mapInArrow(tidied(run), "dim int, n bigint, s decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    rows.sort(key=lambda r: r["dim"])
    return (rows[0]["n"], [int(r["s"]) for r in rows]) if rows else (0, [])


def covariance(distinct: DataFrame, dims: int, weight: str, column: str, kind: type, centred, n: int) -> np.ndarray:
    """Weighted covariance, divisor n, of a column of arrays that `centred` centres before the product.

    A task sums its batches and sends one row a dimension; those are summed by dimension.
    """
    def run(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            w = batch[weight].to_numpy().astype(float)
            c = centred(matrix(batch[column], dims, kind))
            total += (c * w[:, None]).T @ c
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["dim", "line"])

    def add(table: pa.Table) -> pa.Table:
        lines = table["line"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        return pa.table({"dim": table["dim"][:1], "line": pa.array([lines.sum(axis=0).tolist()], pa.list_(pa.float64()))})

    schema = "dim int, line array<double>"
    lines = distinct.select(weight, column).mapInArrow(tidied(run), schema).groupBy("dim").applyInArrow(add, schema).collect()
    out = np.zeros((dims, dims))
    for r in lines:
        out[r["dim"]] = r["line"]
    return (out + out.T) / 2 / n


def fit(distinct: DataFrame, dims: int, weight: str, most: int) -> Whitening | None:
    """Sums, covariance and components of the distinct vectors (x, copies, one)."""
    n, sums = exact_sums(distinct, dims, weight)
    if not n:
        return None
    model = Whitening(n, sums, 0.0, np.zeros(0), np.zeros((dims, 0)))
    v = covariance(distinct, dims, weight, "x", np.int64, model.centred, n)
    values, vectors = np.linalg.eigh(v)
    model.trace = float(np.trace(v))
    kept = np.argsort(-values, kind="stable")[:most]
    kept = kept[values[kept] > FLAT * model.trace]
    model.eigenvalues, model.components = values[kept], vectors[:, kept]
    if len(kept):
        lead = np.abs(model.components).argmax(axis=0)
        model.components = model.components * np.sign(model.components[lead, np.arange(len(kept))])
    return model


def whiten(vectors: DataFrame, components: int = 16, by_copies: bool = False) -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error) of every valid row.

    `whitened` and `explained` are arrays over the components.  The fit weighs each
    distinct vector by one, or by its copies if `by_copies`.
    """
    ship_package(vectors.sparkSession)
    rows, dims = integer_vectors(vectors)
    keyed = rows.select("vec_id", "x", F.unhex(F.sha2(F.concat_ws(",", F.col("x").cast("array<string>")), 256)).alias("key"))
    distinct = keyed.groupBy("key").agg(F.any_value("x").alias("x"), F.count("*").alias("copies"))
    distinct = stash(distinct.withColumn("one", F.lit(1).cast("long")), "whiten-distinct")
    weight = "copies" if by_copies else "one"
    model = fit(distinct, dims, weight, components)
    k = len(model.eigenvalues) if model else 0
    if not k:
        empty = "vec_id, 0L AS n, 0L AS deviation, cast(array() AS array<double>) AS whitened, cast(array() AS array<double>) AS explained, 0D AS identity_error"
        return rows.filter("false").selectExpr(*[c.strip() for c in empty.split(", ")])

    def project(batches):
        for batch in batches:
            x = matrix(batch["x"], dims, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["copies"], batch["one"], pa.array(model.deviations(x), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(model.whitened(x).ravel()))],
                ["key", "copies", "one", "deviation", "whitened"])

    done = stash(distinct.mapInArrow(tidied(project), "key binary, copies bigint, one bigint, deviation bigint, whitened array<double>"), "whitened")
    means = done.agg(*[F.sum(F.col("whitened")[i] * F.col(weight)).alias(f"m{i}") for i in range(k)]).first()
    centre = np.array([m / model.n for m in means])
    error = np.abs(covariance(done, k, weight, "whitened", np.float64, lambda z: z - centre, model.n) - np.eye(k)).max()
    found = lookup_join(keyed.select("vec_id", "key"), done.select("key", "copies", "deviation", "whitened"), "key", "copies")
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    return found.select("vec_id", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"),
                        F.lit(float(error)).alias("identity_error"))


def by_component(found: DataFrame) -> DataFrame:
    """One row per vector and component, numbered from 1."""
    cells = F.posexplode(F.arrays_zip("whitened", "explained"))
    long = found.select("vec_id", "n", "deviation", "identity_error", cells.alias("at", "cell"))
    return long.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
                       F.col("cell.whitened").alias("whitened"), F.col("cell.explained").alias("explained"), "identity_error")
