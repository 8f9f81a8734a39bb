"""All neighbours of vectors within a radius: pairs, kernel sums and links, compared block by block.

Vectors are sorted by the grid cells of their first coordinates and cut into blocks,
and these into pieces, the rows that Spark moves.  Two blocks meet in one task where
their bounding boxes are within the radius, so every pair of vectors meets exactly once;
the task holds the first block and takes the pieces of the second as they come.  It
compares tiles by a matrix product and settles pairs whose distance is within rounding
of the radius by their differences.  Only results leave a task: the pairs themselves
(`pairs`), one sum per vector (`sums`), or links that join the same vectors as the pairs
do (`links`).  Work grows with the pairs of pieces that meet; a vector is sent once per
block that it meets, and the blocks grow with the table until one is as large as a task may hold.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthframe.session import ship_package, written

GRID = 3
#: Rows of a tile: its distances stay in the processor's cache.
TILE = 512
#: Most vectors of a piece.
PIECE = 2_048
#: Blocks that smaller tables are cut into, where they have a tile each, so that every core has pairs of blocks to compare.
LEAST = 12
#: Most partitions of a scan over pairs of blocks.
PARTS = 2_048
#: Distances by matrix product count as exact where their rounding is at most this share of the squared radius.
ROUNDING = 1e-12
#: Pairs whose coordinates are held at once to be compared by differences.
CHECKED = 1 << 14
#: Pairs that are listed in one order before they are in the other: near enough for the compression of a file to see the same distances twice.
TURNED = 128


@dataclass
class Blocks:
    """Packed vectors (block, piece, ids, x) and the pieces that the pairs of blocks that meet need."""

    rows: DataFrame
    sides: DataFrame        # (block, piece, part, pair, first, alone): one row per piece and pair of blocks
    pieces: int             # about so many
    count: int
    parts: int
    dims: int
    radius: float
    id_type: str

    def places(self) -> DataFrame:
        """(id, block, piece, slot) of every vector."""
        return self.rows.select("block", "piece", F.posexplode("ids").alias("slot", "id"))


def packed(nodes: DataFrame, vertex: str, dims: int, radius: float, block_rows: int) -> Blocks:
    """Blocks of at most about `block_rows` vectors; rows without an id or with a missing or not finite coordinate have no neighbours.

    Coordinates that are single precision numbers are kept as such.
    """
    ship_package(nodes.sparkSession)
    id_type = nodes.schema[vertex].dataType.simpleString()
    reach = radius * (1 + 1e-9) + 1e-12
    rows = nodes.select(F.col(vertex).alias("id"), F.slice(F.col("x").cast("array<double>"), 1, dims).alias("x"))
    rows = rows.filter((F.size("x") == dims) & F.col("id").isNotNull()
                       & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    total = rows.count()
    count = max(1, math.ceil(total / block_rows), min(LEAST, total // TILE))
    order = [*[F.floor(F.col("x")[i] / reach) for i in range(min(GRID, dims))], F.col("id"), F.xxhash64("x")]
    rows = rows.repartitionByRange(count, *order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id())

    def pack(batches):
        held, waiting, piece = [], 0, 0

        def made(table):
            x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            with np.errstate(over="ignore"):
                single = x.astype(np.float32)
            body = single if (single == x).all() else x
            ids = table["id"].combine_chunks()
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([table["block"].combine_chunks()[:1], pa.array([piece], pa.int32()), lists, pa.array([body.tobytes()], pa.binary()),
                                               pa.array([x.min(axis=0).tolist()]), pa.array([x.max(axis=0).tolist()])], ["block", "piece", "ids", "x", "lo", "hi"])

        for batch in batches:
            held.append(batch)
            waiting += len(batch)
            if waiting >= PIECE:
                table = pa.Table.from_batches(held)
                for _ in range(waiting // PIECE):
                    yield made(table.slice(0, PIECE))
                    table, piece = table.slice(PIECE), piece + 1
                held, waiting = table.to_batches(), len(table)
        if waiting:
            yield made(pa.Table.from_batches(held))

    made = written(rows.mapInArrow(pack, f"block int, piece int, ids array<{id_type}>, x binary, lo array<double>, hi array<double>"), "neighbour-blocks")
    boxes = made.groupBy("block").agg(*[F.array(*[f(F.col(c)[d]) for d in range(dims)]).alias(f"other_{c}") for c, f in (("lo", F.min), ("hi", F.max))])
    apart = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)),
                        lambda d: F.greatest(F.get("other_lo", d) - F.get("hi", d), F.get("lo", d) - F.get("other_hi", d), F.lit(0.0)))
    gap = F.aggregate(apart, F.lit(0.0), lambda total, g: total + g * g)
    parts = min(count * (count + 1) // 2, PARTS)
    low, high = F.least("block", "other"), F.greatest("block", "other").cast("long")
    met = made.join(F.broadcast(boxes.withColumnRenamed("block", "other"))).filter(gap <= reach * reach)
    pair = (high * (high + 1) / 2).cast("long") + low
    sides = met.select("block", "piece", F.pmod(pair, F.lit(parts)).cast("int").alias("part"), pair.alias("pair"),
                       (F.col("block") <= F.col("other")).alias("first"), (F.col("block") == F.col("other")).alias("alone"))
    sides = written(sides.coalesce(1), "neighbour-sides")
    return Blocks(made.select("block", "piece", "ids", "x"), sides, max(1, math.ceil(total / PIECE)), count, parts, dims, radius, id_type)


class _Side:
    """One piece in a task: its place, ids, coordinates and, where given, the numbers `q` of its vectors and what they `pull`."""

    def __init__(self, batch: pa.RecordBatch, i: int, dims: int, size: int):
        self.place, self.ids = (batch["block"][i].as_py(), batch["piece"][i].as_py()), batch["ids"][i].values
        body = batch["x"][i].as_buffer()
        self.x = np.frombuffer(body, dtype=float if len(body) == 8 * dims * len(self.ids) else np.float32).reshape(-1, dims).copy()
        if size:
            q = batch["q"][i]
            self.q = np.frombuffer(q.as_buffer(), dtype=float).reshape(-1, size).copy() if q.is_valid else np.zeros((len(self.x), size))
            self.pull = np.zeros_like(self.q)


def _scan(blocks: Blocks, work: Callable, end: Callable, schema: str, q: DataFrame | None = None, size: int = 0) -> DataFrame:
    """What `work(held, piece, memory)` yields for the pieces that meet, and `end(held, memory)` after each pair of blocks.

    `held` are the pieces of the first block; where a block meets itself, those up to
    the piece, which is the last of them.  `memory` is a dictionary for each pair of
    blocks; `q` gives each piece (block, piece, q) numbers.
    """
    dims = blocks.dims

    def run(batches):
        held, memory, now = [], {}, None
        for batch in batches:
            for i, (pair, first, alone) in enumerate(zip(batch["pair"].to_pylist(), batch["first"].to_pylist(), batch["alone"].to_pylist(), strict=True)):
                if pair != now:
                    yield from end(held, memory)
                    held, memory, now = [], {}, pair
                side = _Side(batch, i, dims, size)
                if first:
                    held.append(side)
                if held and (alone or not first):
                    yield from work(held, side, memory)
        yield from end(held, memory)

    rows = blocks.rows if q is None else blocks.rows.join(q, ["block", "piece"], "left")
    placed = rows.join(F.broadcast(blocks.sides), ["block", "piece"]).repartitionById(blocks.parts, "part").sortWithinPartitions("pair", F.desc("first"), "piece")
    return placed.mapInArrow(run, schema)


def _nothing(held, memory):
    return ()


def _tiles(left: _Side, right: _Side, radius: float):
    """(i, j, d2, near, square): slices of both blocks, squared distances, which are within the radius; a square tile holds each pair twice."""
    bound = radius * radius
    same = left is right
    x, y = left.x.astype(float), right.x.astype(float)
    shift = x.mean(axis=0)
    a = x - shift
    b = a if same else y - shift
    sa, sb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    starts = range(0, len(a), TILE), range(0, len(b), TILE)
    boxes = [[(z[s:s + TILE].min(axis=0), z[s:s + TILE].max(axis=0)) for s in at] for z, at in zip((a, b), starts, strict=True)]
    for p, i in enumerate(starts[0]):
        for r, j in enumerate(starts[1]):
            if same and j < i:
                continue
            (la, ha), (lb, hb) = boxes[0][p], boxes[1][r]
            rows, cols = slice(i, min(i + TILE, len(a))), slice(j, min(j + TILE, len(b)))
            most = sa[rows].max() + sb[cols].max()
            slack = (a.shape[1] + 8) * 4.5e-16 * most
            if (np.maximum(np.maximum(lb - ha, la - hb), 0) ** 2).sum() > bound + slack:
                continue
            d2 = a[rows] @ b[cols].T
            d2 *= -2
            d2 += sa[rows][:, None]
            d2 += sb[cols][None]
            near = d2 <= bound + slack
            sure = d2 <= bound - slack if slack <= ROUNDING * bound else np.zeros_like(near)
            if np.count_nonzero(near) != np.count_nonzero(sure):
                at = np.nonzero(near & ~sure)
                for s in range(0, len(at[0]), CHECKED):
                    u, v = at[0][s:s + CHECKED], at[1][s:s + CHECKED]
                    gap = x[i + u] - y[j + v]
                    d2[u, v] = (gap * gap).sum(axis=1)
                near = d2 <= bound
            square = same and i == j
            if square:
                np.fill_diagonal(near, False)
            if near.any():
                np.maximum(d2, 0, out=d2)
                yield rows, cols, d2, near, square


def _turned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """TURNED entries of `a`, as many of `b`, the next of `a`, and so on."""
    whole = len(a) // TURNED * TURNED
    return np.concatenate([np.stack([a[:whole].reshape(-1, TURNED), b[:whole].reshape(-1, TURNED)], axis=1).ravel(), a[whole:], b[whole:]])


def pairs(blocks: Blocks, both: bool = False) -> DataFrame:
    """(a, b, d2) of all two ids at most the radius apart: with a < b, or with `both` in both orders."""
    radius = blocks.radius

    def work(held, right, _):
        for left in held:
            ids = left.ids.to_numpy(zero_copy_only=False), right.ids.to_numpy(zero_copy_only=False)
            for rows, cols, d2, near, square in _tiles(left, right, radius):
                i, j = np.nonzero(np.triu(near) if square else near)
                a, b, gaps = ids[0][rows][i], ids[1][cols][j], d2[i, j]
                differ = a != b
                if not differ.all():
                    a, b, gaps = a[differ], b[differ], gaps[differ]
                if both:
                    a, b, gaps = _turned(a, b), _turned(b, a), _turned(gaps, gaps)
                else:
                    swap = a > b
                    a, b = np.where(swap, b, a), np.where(swap, a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a, left.ids.type), pa.array(b, left.ids.type), pa.array(gaps)], ["a", "b", "d2"])

    return _scan(blocks, work, _nothing, f"a {blocks.id_type}, b {blocks.id_type}, d2 double")


def sums(blocks: Blocks, values: DataFrame, size: int, gamma: float) -> DataFrame:
    """(id, pull): for every id the sum of exp(-gamma d^2) q over its neighbours; `values` is (id, q), q an array of `size`, 0 where missing."""
    radius = blocks.radius

    def pack(batches):
        bodies = {}
        for batch in batches:
            q = batch["q"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            slots, rows = batch["slot"].to_numpy(), batch["rows"].to_numpy()
            places, at = np.unique(np.stack([batch["block"].to_numpy(), batch["piece"].to_numpy()], axis=1), axis=0, return_inverse=True)
            for k, place in enumerate(map(tuple, places.tolist())):
                of = at.ravel() == k
                bodies.setdefault(place, np.zeros((int(rows[of][0]), size)))[slots[of]] = q[of]
        for (block, piece), body in bodies.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([piece], pa.int32()), pa.array([body.tobytes()], pa.binary())], ["block", "piece", "q"])

    def work(held, right, _):
        for left in held:
            for rows, cols, d2, near, square in _tiles(left, right, radius):
                d2 *= -gamma
                np.exp(d2, out=d2)
                d2 *= near
                left.pull[rows] += d2 @ right.q[cols]
                if not square:
                    right.pull[cols] += d2.T @ left.q[rows]
        if right is not held[-1]:
            yield from end([right], _)

    def end(held, _):
        for side in held:
            lists = pa.ListArray.from_arrays(pa.array([0, len(side.ids)], pa.int32()), side.ids)
            block, piece = side.place
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([piece], pa.int32()), lists, pa.array([side.pull.tobytes()], pa.binary())],
                                             ["block", "piece", "ids", "total"])

    def add(batches):
        """Rows come piece by piece."""
        def done():
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * size, pa.int32()), pa.array(total))
            return pa.RecordBatch.from_arrays([ids, lists], ["id", "pull"])

        total, ids, now = None, None, None
        for batch in batches:
            for i, place in enumerate(zip(batch["block"].to_pylist(), batch["piece"].to_pylist(), strict=True)):
                part = np.frombuffer(batch["total"][i].as_buffer(), dtype=float)
                if place == now:
                    total += part
                    continue
                if now is not None:
                    yield done()
                total, ids, now = part.copy(), batch["ids"][i].values, place
        if now is not None:
            yield done()

    sizes = blocks.rows.select("block", "piece", F.size("ids").alias("rows"), F.posexplode("ids").alias("slot", "id"))
    placed = sizes.join(values.select("id", "q"), "id").select("block", "piece", "rows", "slot", "q").repartition(blocks.pieces, "block", "piece")
    met = _scan(blocks, work, end, f"block int, piece int, ids array<{blocks.id_type}>, total binary", placed.mapInArrow(pack, "block int, piece int, q binary"), size)
    return met.repartition(blocks.pieces, "block", "piece").sortWithinPartitions("block", "piece").mapInArrow(add, f"id {blocks.id_type}, pull array<double>")


def _merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`labels` after the groups `a` and `b`, label by label, became one: each takes the smallest label it reaches."""
    while len(a):
        lower = np.arange(len(labels))
        np.minimum.at(lower, np.maximum(a, b), np.minimum(a, b))
        while (lower[lower] != lower).any():
            lower = lower[lower]
        labels, a, b = lower[labels], lower[a], lower[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return labels


def links(blocks: Blocks) -> DataFrame:
    """(src, dst) in both directions: of every two blocks a star for each group that their pairs join, so components are those of all pairs."""
    radius = blocks.radius

    def stars(ids, labels, start=0):
        """Links of the vectors from `start` on to the first of their group."""
        far = start + np.nonzero(labels[start:] != np.arange(start, len(labels)))[0]
        tips, hubs = ids.take(pa.array(far)), ids.take(pa.array(labels[far]))
        return pa.RecordBatch.from_arrays([pa.concat_arrays([tips, hubs]), pa.concat_arrays([hubs, tips])], ["src", "dst"])

    def work(held, right, memory):
        before = held[:-1] if right is held[-1] else held
        starts = np.cumsum([0, *[len(h.x) for h in before]])
        labels = memory.get("labels", np.zeros(0, int))
        labels = np.concatenate([labels, np.arange(len(labels), starts[-1] + len(right.x))])
        for left, start in [*zip(before, starts, strict=False), *([(right, starts[-1])] if right is held[-1] else [])]:
            for rows, cols, _, near, _ in _tiles(left, right, radius):
                at, to = labels[start + rows.start:start + rows.stop], labels[starts[-1] + cols.start:starts[-1] + cols.stop]
                if at.min() == at.max() == to.min() == to.max():
                    continue
                i, j = np.nonzero(near & (at[:, None] != to[None]))
                labels = _merged(labels, at[i], to[j])
        if right is held[-1]:
            memory["labels"] = labels
        else:
            memory["labels"] = labels[:starts[-1]]
            yield stars(pa.concat_arrays([h.ids for h in [*held, right]]), labels, starts[-1])

    def end(held, memory):
        if "labels" in memory:
            yield stars(pa.concat_arrays([h.ids for h in held]), memory["labels"])

    return _scan(blocks, work, end, f"src {blocks.id_type}, dst {blocks.id_type}")
