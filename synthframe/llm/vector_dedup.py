"""Near-duplicate vectors of one label by a subspace pigeonhole join.

Unit vectors are rotated and split into blocks.  A cosine of at least c means a squared
distance of at most 2 - 2c, so at least one block has its proportional share of that
budget or less; each block is range-joined under its share and the pairs found by any
block are verified by their cosine.  A block's first coordinates lie on a grid whose
cells are two radii wide.  A vector is at home in one cell and a guest of those forward
neighbours that its range reaches, so a pair in range meets in exactly one cell a block.

A cell is compared where it lies, and only counts and one partner per vector leave it:
pairs are never emitted, so a group of a million near copies costs comparisons, not
rows.  A link that several blocks find is counted by the block where its share of the
budget is used least, which every block computes alike.  Identical vectors of a label
are one node with a weight.  Cells beyond TILE vectors are cut into parts that meet in
pairs of parts.

Odd rows: vectors that are null, empty, zero or hold a null, NaN or infinite entry, and
rows without a label, link with nothing and are kept.  Only vectors of equal length are
compared.  A null id counts as a vector but is no component's smallest id unless it has
no other.  Repeated rows link with each other and are kept or dropped together.  An
empty table gives no rows.  Only vec_id, embedding and label are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthframe.functions.frames import lookup_join
from synthframe.llm.common import BROADCAST_KEYS, stash, tidied
from synthframe.llm.near_dedup import components
from synthframe.session import ship_package

COSINE = 0.98
#: Blocks of a vector, and coordinates of a block that make its grid.
BLOCKS = 4
GRID = 3
#: Vectors of a cell compared in one task; larger cells are cut into parts of about half as many.
TILE = 32_768
#: Pairs whose distances are held at once.
PAIRS = 1 << 22
SLACK = 1e-9
SEED = 20


def usable(batch: pa.RecordBatch) -> list[bytes | None]:
    """The entries of each vector as packed doubles; none for a vector that links with nothing."""
    out = []
    for vector in batch["embedding"]:
        body = None
        if vector.is_valid and len(vector) and not vector.values.null_count:
            x = vector.values.to_numpy(zero_copy_only=False).astype(float)
            if np.isfinite(x).all() and x.any():
                body = x.tobytes()
        out.append(body)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return np.ascontiguousarray(x / np.sqrt((x * x).sum(axis=1, keepdims=True)))


@lru_cache(maxsize=4)
def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation, which spreads any direction over all blocks."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def rotated(u: np.ndarray) -> np.ndarray:
    """u times the rotation, summed in one fixed order: a vector has the same coordinates in every task."""
    turn = rotation(u.shape[1])
    out = np.zeros_like(u)
    for j in range(u.shape[1]):
        out += u[:, j:j + 1] * turn[j]
    return out


def spans(dims: int, blocks: int) -> list[tuple[int, int]]:
    """Bounds of the blocks of a vector; a short vector has fewer."""
    blocks = max(1, min(blocks, dims))
    cuts = [i * dims // blocks for i in range(blocks + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def budgets(dims: int, blocks: int, cosine: float) -> np.ndarray:
    """Shares of the squared distance 2 - 2 cosine in proportion to the blocks' dimensions."""
    return np.array([(2 - 2 * cosine) * (b - a) / dims for a, b in spans(dims, blocks)])


def places(z: np.ndarray, radius: float, grid: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, cells, at home) of the grid places of one block's coordinates."""
    z = z[:, :grid]
    reach = radius * (1 + SLACK) + 1e-12
    side = 2 * reach
    cell = np.floor(z / side).astype(np.int64)
    inside = z - cell * side
    touches = {0: np.ones(z.shape, bool), -1: inside <= reach, 1: side - inside <= reach}
    for offset in itertools.product((-1, 0, 1), repeat=z.shape[1]):
        if offset < (0,) * z.shape[1]:
            continue
        there = np.logical_and.reduce([touches[o][:, i] for i, o in enumerate(offset)])
        rows = np.flatnonzero(there)
        yield rows, cell[rows] + np.array(offset), not any(offset)


def matrix(bodies: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bodies), dtype=np.float64).reshape(len(bodies), -1)


def members(vectors: DataFrame) -> DataFrame:
    """(vec_id, node, label, body): the node names label and vector, null if the row links with nothing."""
    def run(batches):
        for batch in batches:
            labels = batch["label"].to_pylist()
            bodies = [b if t is not None else None for t, b in zip(labels, usable(batch), strict=True)]
            nodes = [None if b is None else sha256(f"{len(t)}:{t}".encode() + b).digest()[:16] for t, b in zip(labels, bodies, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(nodes, pa.binary()), batch["label"], pa.array(bodies, pa.binary())],
                                             ["vec_id", "node", "label", "body"])

    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    return slim.mapInArrow(tidied(run), "vec_id bigint, node binary, label string, body binary")


def placed(nodes: DataFrame, cosine: float, blocks: int, grid: int, bodies: bool) -> DataFrame:
    """(label, dims, block, cell, home[, node, w, body]): the cells where each node is at home or a guest."""
    def run(batches):
        for batch in batches:
            sizes = np.array([len(b) // 8 for b in batch["body"].to_pylist()])
            for dims in np.unique(sizes):
                some = batch.take(pa.array(np.flatnonzero(sizes == dims)))
                z = rotated(unit(matrix(some["body"].to_pylist())))
                for block, ((a, b), budget) in enumerate(zip(spans(dims, blocks), budgets(dims, blocks, cosine), strict=True)):
                    for rows, cells, home in places(z[:, a:b], budget ** 0.5, grid):
                        at, n = pa.array(rows), len(rows)
                        flat = pa.array(np.ascontiguousarray(cells).astype(np.int16).view(f"S{2 * cells.shape[1]}").ravel().tolist(), pa.binary()) if n else pa.array([], pa.binary())
                        columns = [some["label"].take(at), pa.array([int(dims)] * n, pa.int32()), pa.array([block] * n, pa.int32()), flat, pa.array([home] * n, pa.bool_())]
                        columns += [some[c].take(at) for c in ("node", "w", "body")] if bodies else []
                        yield pa.RecordBatch.from_arrays(columns, names)

    schema = "label string, dims int, block int, cell binary, home boolean" + (", node binary, w bigint, body binary" if bodies else "")
    names = [part.split()[0] for part in schema.split(", ")]
    return nodes.select("label", "node", "w", "body").mapInArrow(tidied(run), schema)


def tiles(nodes: DataFrame, cosine: float, blocks: int, grid: int, tile: int) -> DataFrame:
    """The placed rows, dealt into tiles (i, j) of two parts of a cell; most cells are one tile (0, 0)."""
    cell = ["label", "dims", "block", "cell"]
    crowds = placed(nodes, cosine, blocks, grid, False).groupBy(*cell).agg(F.count("*").alias("size"), F.max("home").alias("home"))
    crowds = crowds.filter("home AND size > 1").drop("home").withColumn("parts", F.ceil(2 * F.col("size") / tile).cast("int"))
    crowds = stash(crowds.withColumn("parts", F.when(F.col("size") <= tile, 1).otherwise(F.col("parts"))), "vector-crowds")
    if crowds.count() <= BROADCAST_KEYS:
        crowds = F.broadcast(crowds)
    rows = placed(nodes, cosine, blocks, grid, True).join(crowds.drop("size"), cell)
    rows = rows.withColumn("part", F.expr("cast(pmod(xxhash64(node, 'part'), parts) AS int)"))
    met = F.expr("transform(sequence(0, parts - 1), q -> named_struct('i', least(q, part), 'j', greatest(q, part)))")
    return rows.select(*cell, "home", "node", "w", "body", "part", F.explode(met).alias("tile")).select("*", "tile.*").drop("tile")


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`root` after the links (a, b): the smallest member of each component of what was met so far."""
    while True:
        left, right = root[a], root[b]
        apart = left != right
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        high, low = np.maximum(left[apart], right[apart]), np.minimum(left[apart], right[apart])
        np.minimum.at(root, high, low)
        while True:
            after = root[root]
            if (after == root).all():
                break
            root = after


def compare(u: np.ndarray, home: np.ndarray, part: np.ndarray, w: np.ndarray, block: int, blocks: int, cosine: float, mixed: bool) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of the rows of a tile: weighted links that this block owns, and one linked row standing for the component."""
    n, dims = u.shape
    z = rotated(u)
    bounds, shares = spans(dims, blocks), budgets(dims, blocks, cosine)
    a0, b0 = bounds[block]
    sub = np.ascontiguousarray(z[:, a0:b0])
    norms = (sub * sub).sum(axis=1)
    links, root = np.zeros(n, dtype=np.int64), np.arange(n)
    order = np.flatnonzero(home | mixed)  # rows that look for partners
    for low in range(0, len(order), max(1, PAIRS // n)):
        rows = order[low:low + max(1, PAIRS // n)]
        near = norms[rows, None] + norms[None] - 2 * (sub[rows] @ sub.T) <= shares[block] + SLACK
        meet = (part[rows, None] < part[None]) & (home[rows, None] | home[None]) if mixed else (rows[:, None] < np.arange(n)[None]) | ~home[None]
        near &= meet
        if near.sum() * 8 > near.size:
            near &= u[rows] @ u.T >= cosine
            a, b = np.nonzero(near)
            a = rows[a]
        else:
            a, b = np.nonzero(near)
            a = rows[a]
            whole = np.concatenate([np.einsum("ij,ij->i", u[a[s:s + 65536]], u[b[s:s + 65536]]) for s in range(0, len(a), 65536)] or [np.zeros(0)])
            a, b = a[whole >= cosine], b[whole >= cosine]
        for s in range(0, len(a), 65536):
            x, y = a[s:s + 65536], b[s:s + 65536]
            apart = (z[x] - z[y]) ** 2
            used = np.stack([apart[:, p:q].sum(axis=1) / share for (p, q), share in zip(bounds, shares, strict=True)], axis=1)
            owned = used.argmin(axis=1) == block
            x, y = x[owned], y[owned]
            np.add.at(links, x, w[y])
            np.add.at(links, y, w[x])
            root = joined(root, x, y)
    return links, root


def counted(dealt: DataFrame, cosine: float, blocks: int) -> DataFrame:
    """(node, links, partner) per tile of the nodes with links in it."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block, i, j = key[2].as_py(), key[4].as_py(), key[5].as_py()
        table = table.sort_by([("home", "descending"), ("node", "ascending")])
        u = unit(matrix(table["body"].to_pylist()))
        home = table["home"].to_numpy()
        links, root = compare(u, home, table["part"].to_numpy(), table["w"].to_numpy(), block, blocks, cosine, i != j)
        hit = np.flatnonzero(links)
        node = table["node"].combine_chunks()
        return pa.table({"node": node.take(pa.array(hit)), "links": pa.array(links[hit]), "partner": node.take(pa.array(root[hit]))})

    keys = ["label", "dims", "block", "cell", "i", "j"]
    return dealt.groupBy(*keys).applyInArrow(run, "node binary, links bigint, partner binary")


def deduplicate(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, grid: int = GRID, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Rows of equal label link if the cosine of their vectors is at least `cosine`;
    component_id is the smallest vec_id reachable by links.
    """
    ship_package(vectors.sparkSession)
    rows = members(vectors)
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.any_value("label").alias("label"), F.any_value("body").alias("body"), F.count("*").alias("w"), F.min("vec_id").alias("low"))
    nodes = stash(nodes, "vector-nodes")
    found = stash(counted(tiles(nodes, cosine, blocks, grid, tile), cosine, blocks), "vector-links")
    roots = components(found.select(F.col("node").alias("a"), F.col("partner").alias("b")).filter("a <> b"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "w", "low").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("w").alias("size"))
    named = lookup_join(named, smallest, "root", "size")
    named = named.select("node", "w", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = lookup_join(rows.select("vec_id", "node"), stash(named, "vector-components"), "node", "w")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))


def oracle() -> str:
    """DuckDB SQL of `op12_vector_dedup`: every pair of a label."""
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n_links, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l USING (vec_id) LEFT JOIN degree d USING (vec_id)"""
