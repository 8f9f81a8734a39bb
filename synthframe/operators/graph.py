"""Similarity graphs as edge lists: vertices, neighbour edges, components, Laplacian eigenpairs.

Rows with equal coordinates are one vertex with a weight.  Two vertices have an edge
where the Gaussian kernel is at least `floor`, that is within a radius: blocks of
vertices that can be that near are compared (`neighbours`), so edges are exact, and what
is left out changes a degree by less than `floor` per row.  The edges of a graph are not
stored: degrees and the product of the Laplacian with a block of vectors are sums over
the blocks, which work the kernel out anew.  Only a graph of at most WHOLE vertices is
solved as a matrix.
Only matrices of a few dozen rows (projections on the search space) and a few numbers
per component of the vertices reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthframe.functions.frames import lookup_join, spread
from synthframe.functions.rng import hash_uniform
from synthframe.operators import neighbours
from synthframe.session import ship_package, small_batches, written

GAMMA = 5.0
FLOOR = 1e-3
#: Most vertices of a block (`neighbours`): with their numbers about 60 MB in a task.
CELL_ROWS = 60_000
#: Fixed value: added to every eigenvalue before drops are compared.
RIDGE = 1e-5
#: Vertices of one graph where a caller asks for merged rows: the finest grid with about as few cells.
VERTICES = 1_500
#: Graphs of at most so many vertices have their whole spectrum solved as one matrix (18 MB).
WHOLE = 1_500
#: Steps of the ladder that the largest drop spans, and most windows that are looked for (`no_larger_drop`).
SPANS = 8
MOST_WINDOWS = 100_000
#: Residuals at most this share of the spectrum's bound end the search for eigenvectors.
TOLERANCE = 1e-6
MAX_STEPS = 120
#: Vectors that join the search space at once, and vertices whose vectors one task holds.
BLOCK = 24
TASK_VERTICES = 4_096


def radius_of(floor: float, gamma: float = GAMMA) -> float:
    """Distance at which the kernel falls to `floor`."""
    return math.sqrt(-math.log(floor) / gamma)


def points(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`df` with `x`, the array of its coordinates; null where a coordinate is missing or not finite."""
    x = F.array(*[F.col(c).cast("double") + 0.0 for c in columns])  # -0.0 becomes 0.0
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return df.withColumn("x", F.when(whole, x))


def cell_of(step: float) -> Column:
    """The key of a row's vertex: its coordinates, or their grid cell."""
    return F.col("x") if step == 0 else F.transform("x", lambda c: F.floor(c / step).cast("double"))


def grid_step(pointed: DataFrame, most: int, gamma: float = GAMMA) -> float:
    """0 if at most `most` rows are distinct, else the finest of 1/8, 1/4, 1/2, 1, ... kernel widths with about as few cells.

    One scan estimates the cells of all steps.  In many dimensions no step may be
    coarse enough (signs alone keep rows apart); the last one is taken then.
    """
    if pointed.filter("x IS NOT NULL").select("x").distinct().limit(most + 1).count() <= most:
        return 0.0
    width = 1 / math.sqrt(2 * gamma)
    steps = [width * 2.0 ** e for e in range(-3, 9)]
    cells = pointed.filter("x IS NOT NULL").agg(*[F.approx_count_distinct(cell_of(s), 0.02).alias(f"s{i}") for i, s in enumerate(steps)]).first()
    return next((s for s, c in zip(steps, cells) if c <= most), steps[-1])


def vertices(pointed: DataFrame, step: float) -> DataFrame:
    """(vertex, cell, weight, x): one row per cell, x being the mean of its rows."""
    dims = len(pointed.select("x").filter("x IS NOT NULL").limit(1).collect()[0][0]) if step else 0
    keyed = pointed.filter("x IS NOT NULL").select(cell_of(step).alias("cell"), "x")
    if step:
        grouped = keyed.groupBy("cell").agg(F.count("*").alias("weight"), F.array(*[F.avg(F.col("x")[i]) for i in range(dims)]).alias("x"))
    else:
        grouped = keyed.groupBy("cell").agg(F.count("*").alias("weight")).withColumn("x", F.col("cell"))
    return written(grouped.withColumn("vertex", F.monotonically_increasing_id()), "graph-vertices")


def near_blocks(nodes: DataFrame, vertex: str, dims: int, radius: float) -> neighbours.Blocks:
    """The vertices packed into blocks that meet where they can be within `radius`; `nodes` has x."""
    return neighbours.packed(nodes, vertex, dims, radius, CELL_ROWS)


def neighbour_pairs(nodes: DataFrame, vertex: str, dims: int, radius: float) -> DataFrame:
    """(a, b, d2) with a < b of all vertices at most `radius` apart; `nodes` has x."""
    return neighbours.pairs(near_blocks(nodes, vertex, dims, radius))


def neighbour_edges(nodes: DataFrame, vertex: str, dims: int, floor: float = FLOOR, gamma: float = GAMMA) -> DataFrame:
    """(src, dst, weight) in both directions, weight = exp(-gamma d^2) >= floor, without loops."""
    pairs = neighbours.pairs(near_blocks(nodes, vertex, dims, radius_of(floor, gamma)), both=True)
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.exp(-gamma * F.col("d2")).alias("weight"))


def laplacian_edges(edges: DataFrame) -> DataFrame:
    """Graph Laplacian (src, dst, value) of a symmetric edge list (src, dst, weight).

    Off the diagonal it is the negative weight; the diagonal is the degree.
    """
    off = edges.filter(F.col("src") != F.col("dst"))
    degree = off.groupBy(F.col("src")).agg(F.sum("weight").alias("value"))
    return (off.select("src", "dst", (-F.col("weight")).alias("value"))
            .unionByName(degree.select("src", F.col("src").alias("dst"), "value")))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertex, component): the smallest vertex that edges lead to.

    Each round takes the smallest component beside a vertex and then that of its
    component, which halves long paths; minima are aggregated before they move.
    """
    state = written(nodes.select("vertex", F.col("vertex").alias("component")), "graph-components")
    ends = edges.select("src", "dst")
    while True:
        beside = ends.join(state.withColumnRenamed("vertex", "dst"), "dst").groupBy(F.col("src").alias("vertex")).agg(F.min("component").alias("near"))
        low = state.join(beside, "vertex", "left").withColumn("low", F.least("component", F.coalesce("near", "component")))
        hooks = low.groupBy("component").agg(F.min("low").alias("hook"))  # a whole component follows its lowest member
        moved = state.join(hooks, "component").select("vertex", F.col("component").alias("old"), F.col("hook").alias("component"))
        jump = moved.select(F.col("vertex").alias("component"), F.col("component").alias("next")).dropDuplicates(["component"])
        moved = moved.join(jump, "component").select("vertex", "old", F.col("next").alias("component"))
        moved = written(moved, "graph-components")
        changed = moved.filter("old <> component").limit(1).count()
        state = moved.drop("old")
        if not changed:
            return state


@dataclass
class Spectrum:
    """Smallest Laplacian eigenvalues, ascending: `zeros` of them are 0, then `values`."""

    rows: int
    zeros: int
    values: np.ndarray
    vectors: DataFrame | None       # (vertex, y): unit vectors over vertices, scaled by the root of the weight
    top: float                      # no eigenvalue is larger
    whole: bool                     # all eigenvalues but those of copies are in `values`
    residual: float = 0.0


@dataclass
class Graph:
    """Vertices (vertex, weight, x, degree, component), their blocks, and how rows find their vertex."""

    columns: list[str]
    step: float
    nodes: DataFrame
    blocks: neighbours.Blocks
    gamma: float
    floor: float
    _spectrum: Spectrum | None = field(default=None, repr=False)

    @property
    def edges(self) -> DataFrame:
        """(src, dst, weight) in both directions, worked out anew at each use."""
        return neighbour_edges(self.nodes, "vertex", len(self.columns), self.floor, self.gamma)


def build(df: DataFrame, columns: Sequence[str], gamma: float = GAMMA, floor: float = FLOOR, most: int | None = None) -> Graph:
    """The graph of the rows of `df` that have all coordinates.

    Only equal rows are one vertex, however many there are; with `most` rows are merged
    on a grid where more are distinct.  `degree` is the sum of edge weights to other
    vertices, each counted by its rows.
    """
    ship_package(df.sparkSession)
    columns = list(columns)
    pointed = points(df.select(*columns), columns)
    step = 0.0 if most is None else grid_step(points(spread(df.select(*columns)), columns), most, gamma)
    bare = vertices(pointed, step)
    with small_batches(df.sparkSession):
        blocks = near_blocks(bare, "vertex", len(columns), radius_of(floor, gamma))
        weights = bare.select(F.col("vertex").alias("id"), F.array(F.col("weight").cast("double")).alias("q"))
        degree = neighbours.sums(blocks, weights, 1, gamma).select(F.col("id").alias("vertex"), F.col("pull")[0].alias("degree"))
        links = written(neighbours.links(blocks).distinct(), "graph-links")
        nodes = bare.join(degree, "vertex", "left").join(components(bare, links), "vertex")
        nodes = written(nodes.withColumn("degree", F.coalesce("degree", F.lit(0.0))), "graph-nodes")
    return Graph(columns, step, nodes, blocks, gamma, floor)


def row_degrees(df: DataFrame, graph: Graph) -> DataFrame:
    """`df` with `degree`, the affinity of each row to all other rows (copies count 1 each); null without a vertex."""
    own = graph.nodes.select("cell", (F.col("degree") + F.col("weight") - 1).alias("degree"), "weight")
    return on_rows(df, graph, own)


def on_rows(df: DataFrame, graph: Graph, table: DataFrame) -> DataFrame:
    """Give each row the columns of its vertex (`table` has cell and weight)."""
    def text(cell: Column) -> Column:
        """A cell as text, different for different cells: arrays as join keys are normalised anew at each comparison of a sort."""
        return F.array_join(F.transform(cell, lambda c: c.cast("string")), ",")

    # the one-row generator keeps the optimiser from deriving constraints over all columns of x
    keyed = points(df, graph.columns).withColumn("cell", F.explode(F.array(text(cell_of(graph.step))))).drop("x")
    return lookup_join(keyed, table.withColumn("cell", text(F.col("cell"))), "cell", "weight").drop("cell")


# ------------------------------------------------------------------- eigenpairs

def _block(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _gram(state: DataFrame, names: Sequence[str], by_component: str | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Products of the array columns `names`, side by side, summed over the vertices.

    With `by_component` also that column's products with the unit vectors that are
    constant on a component (times the root of the component's weight).  Tasks send
    one matrix each, which one task adds as they come.
    """
    def run(batches):
        total, parts = None, {}
        for batch in batches:
            q = np.concatenate([_block(batch[n]) for n in names], axis=1)
            total = q.T @ q if total is None else total + q.T @ q
            if by_component:
                groups, at = np.unique(batch["component"].to_numpy(), return_inverse=True)
                sums = np.zeros((len(groups), _block(batch[by_component]).shape[1]))
                np.add.at(sums, at, _block(batch[by_component]) * np.sqrt(batch["weight"].to_numpy())[:, None])
                for c, line in zip(groups.tolist(), sums, strict=True):
                    parts[c] = parts.get(c, 0.0) + line
        if total is not None:
            yield pack(dict(enumerate(total)), parts)

    def pack(lines, parts):
        keys = [*lines, *parts]
        body = [np.asarray(v).tolist() for v in (*lines.values(), *parts.values())]
        return pa.RecordBatch.from_arrays([pa.array([False] * len(lines) + [True] * len(parts)), pa.array(keys, pa.int64()),
                                           pa.array(body, pa.list_(pa.float64()))], ["part", "i", "line"])

    def add(batches):
        sums = {}
        for batch in batches:
            for kind, i, line in zip(batch["part"].to_pylist(), batch["i"].to_pylist(), batch["line"], strict=True):
                sums[kind, i] = sums.get((kind, i), 0.0) + line.values.to_numpy()
        yield pack({i: v for (kind, i), v in sums.items() if not kind}, {i: v for (kind, i), v in sums.items() if kind})

    schema = "part boolean, i bigint, line array<double>"
    rows = state.select("component", "weight", *names).mapInArrow(run, schema).repartition(1).mapInArrow(add, schema).collect()
    lines = sorted((r["i"], r["line"]) for r in rows if not r["part"])
    return np.array([line for _, line in lines]), {r["i"]: np.array(r["line"]) for r in rows if r["part"]}


_KEYS = ["vertex", "weight", "degree", "component"]


def _mapped(state: DataFrame, work, names: Sequence[str]) -> DataFrame:
    """(vertex, weight, degree, component, names...): array columns that `work` makes of a batch in numpy."""
    def run(batches):
        for batch in batches:
            made = work({c: _block(batch[c]) for c in inputs}, batch["degree"].to_numpy(), batch)
            arrays = [pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m).ravel())) for m in made]
            yield pa.RecordBatch.from_arrays([batch[c] for c in _KEYS] + arrays, [*_KEYS, *names])

    inputs = [c for c in state.columns if c not in _KEYS]
    return state.mapInArrow(run, "vertex bigint, weight bigint, degree double, component bigint, " + ", ".join(f"{n} array<double>" for n in names))


def _applied(state: DataFrame, graph: Graph, name: str, size: int) -> DataFrame:
    """`state` with `s`, the scaled Laplacian times the array column `name`: sums over the neighbours, joined by vertex."""
    root = F.sqrt("weight")
    moving = state.select(F.col("vertex").alias("id"), F.transform(name, lambda v: v * root).alias("q"))
    pull = neighbours.sums(graph.blocks, moving, size, graph.gamma).withColumnRenamed("id", "vertex")
    return state.join(pull, "vertex").withColumn("s", F.zip_with(name, "pull", lambda v, p: F.col("degree") * v - root * p)).drop("pull")


def whole_spectrum(graph: Graph, wanted: int, rows: int, zeros: int, top: float) -> Spectrum:
    """All eigenvalues of a graph of at most WHOLE vertices, and the vectors of the `wanted` smallest but the zeros."""
    nodes = graph.nodes.select(*_KEYS).orderBy("vertex").toPandas()
    place = {v: i for i, v in enumerate(nodes["vertex"])}
    edges = graph.edges.toPandas()
    root = np.sqrt(nodes["weight"].to_numpy(float))
    i, j = edges["src"].map(place).to_numpy(int), edges["dst"].map(place).to_numpy(int)
    matrix = np.diag(nodes["degree"].to_numpy(float))
    matrix[i, j] -= edges["weight"].to_numpy(float) * root[i] * root[j]
    null = np.zeros((len(nodes), zeros))
    null[np.arange(len(nodes)), np.unique(nodes["component"], return_inverse=True)[1]] = root
    null /= np.sqrt((null ** 2).sum(axis=0))
    values, vectors = np.linalg.eigh(matrix + null @ null.T * (4 * top + 1))  # the null space goes to the far end
    free = len(nodes) - zeros
    y = vectors[:, :min(wanted, free)]
    made = [(int(v), int(w), line) for v, w, line in zip(nodes["vertex"], nodes["weight"], y.tolist(), strict=True)]
    found = graph.nodes.sparkSession.createDataFrame(made, "vertex bigint, weight bigint, y array<double>")
    return Spectrum(rows, zeros, np.maximum(values[:free], 0.0), found, top, True)


def smallest_eigenpairs(graph: Graph, wanted: int, seed: int = 0, tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS, whole: int = WHOLE) -> Spectrum:
    """The `wanted` smallest non-zero eigenvalues of the Laplacian and their vectors.

    A graph of at most `whole` vertices is solved as one matrix, a larger one by block
    Davidson: the residuals of the lowest vectors of the search space, divided by
    the degrees, join the space until they vanish.  The null space is known from the
    components and is taken out.  A step is one scan of the blocks that meet and two sums
    over the vertices.
    """
    facts = graph.nodes.agg(F.sum("weight"), F.countDistinct("component"), F.count("*"), F.max("degree"), F.max(F.col("degree") + F.when(F.col("weight") > 1, F.col("weight")))).first()
    rows, zeros, count = int(facts[0] or 0), int(facts[1]), int(facts[2])
    top = max(2 * (facts[3] or 0.0), facts[4] or 0.0)
    free = count - zeros                      # eigenvalues beside the zeros
    wanted = min(wanted, free)
    if wanted <= 0:
        return Spectrum(rows, zeros, np.zeros(0), None, top, True)
    if count <= whole:
        return whole_spectrum(graph, wanted, rows, zeros, top)
    with small_batches(graph.nodes.sparkSession):
        return _davidson(graph, wanted, seed, tolerance, max_steps, Spectrum(rows, zeros, np.zeros(0), None, top, wanted >= free), count)


def _davidson(graph: Graph, wanted: int, seed: int, tolerance: float, max_steps: int, found: Spectrum, count: int) -> Spectrum:
    """`found` with the `wanted` smallest non-zero eigenvalues of a graph of `count` vertices and their vectors."""
    free, top = count - found.zeros, found.top
    active = graph.nodes.filter("degree > 0").select(*_KEYS)
    block = min(max(wanted + 4, BLOCK), free)
    tasks = max(1, count // TASK_VERTICES)  # one task per so many vertices
    sizes = {r["component"]: float(r["whole"]) for r in active.groupBy("component").agg(F.sum("weight").alias("whole")).collect()}
    empty = F.array().cast("array<double>")
    state = active.withColumn("w", F.array(*[hash_uniform(F.col("vertex"), f"start{i}", seed) - 0.5 for i in range(block)]))
    state = state.withColumn("b", empty).withColumn("a", empty).withColumn("r", empty)
    kept = 0                                  # columns of b and a
    for _ in range(max_steps):
        g, parts = _gram(state, ["b", "w", "r"], "w")
        if found.vectors is not None:
            found.residual = float(np.sqrt(np.maximum(np.diag(g)[kept + block:], 0)).max())
            if found.residual <= tolerance * top:
                break
        null = np.array([v / math.sqrt(sizes[c]) for c, v in parts.items()])
        overlap, own = g[:kept, kept:kept + block], g[kept:kept + block, kept:kept + block] - null.T @ null
        own = own - overlap.T @ overlap
        size = np.sqrt(np.maximum(np.diag(own), 1e-300))
        values, turns = np.linalg.eigh((own + own.T) / 2 / np.outer(size, size))
        sound = values > 1e-10
        if not sound.any():
            break
        turn = turns[:, sound] / np.sqrt(values[sound]) / size[:, None]
        means = {c: v / sizes[c] for c, v in parts.items()}

        def fresh(q, degree, batch):
            """b, a and the new unit vectors: w without its parts in the null space and in b."""
            root = np.sqrt(batch["weight"].to_numpy())[:, None]
            clean = q["w"] - root * np.array([means[c] for c in batch["component"].to_pylist()])
            return [q["b"], q["a"], clean @ turn - q["b"] @ (overlap @ turn)]

        added = _applied(_mapped(state, fresh, ["b", "a", "v"]), graph, "v", turn.shape[1])
        state = written(added.select(*_KEYS, F.concat("b", "v").alias("b"), F.concat("a", "s").alias("a")).coalesce(tasks), "graph-space")
        kept += turn.shape[1]
        g, _ = _gram(state, ["b", "a"])
        inner, middle = g[:kept, :kept], g[:kept, kept:]
        scale, basis = np.linalg.eigh(inner)
        good = scale > 1e-10 * scale.max()
        basis = basis[:, good] / np.sqrt(scale[good])
        theta, z = np.linalg.eigh(basis.T @ ((middle + middle.T) / 2) @ basis)
        z = basis @ z
        first = z[:, :wanted]
        found.values = np.maximum(theta[:wanted], 0.0)
        found.vectors = _mapped(state, lambda q, d, _, first=first: [q["b"] @ first], ["y"]).select("vertex", "weight", "y")
        found.residual = math.inf             # not known before the next step
        if len(theta) >= free:
            found.residual = 0.0
            break
        block = min(block, len(theta))
        few = z[:, :4 * block] if kept + block > 10 * block else None  # start again from the lowest vectors
        if few is not None:
            kept, z, theta = few.shape[1], np.eye(few.shape[1]), theta[:few.shape[1]]
        lead, at = z[:, :block], theta[:block]

        def directions(q, degree, _):
            """b and a, the scaled residuals of the lowest vectors, and the residuals of the wanted ones."""
            b, a = (q["b"], q["a"]) if few is None else (q["b"] @ few, q["a"] @ few)
            off = a @ lead - (b @ lead) * at
            return [b, a, off / np.maximum(degree[:, None] - at, 0.1 * degree[:, None]), off[:, :wanted]]

        state = _mapped(state, directions, ["b", "a", "w", "r"])
    if found.vectors is not None:
        found.vectors = written(found.vectors, "graph-vectors")
    return found


def eigen_gap(graph: Graph, most: int | None = None, seed: int = 0, whole: int = WHOLE) -> tuple[int, bool]:
    """Clusters by the largest relative drop of the ridged Laplacian spectrum, and whether that is certain.

    Eigenvalues come from the small end, ever more of them until no drop further up can
    be larger: because it is at most 1 - (largest known) / (bound of all), or because
    the degrees show eigenvalues too close together for it (`no_larger_drop`).  The
    answer is uncertain only where a caller's limit `most` or the solver's steps ended the search.
    """
    wanted = 2
    while True:
        spectrum = smallest_eigenpairs(graph, wanted, seed, whole=whole)
        k, best = gap_of(graph, spectrum)
        highest = spectrum.values[-1] if len(spectrum.values) else 0.0
        settled = spectrum.whole or best >= 1 - (highest + RIDGE) / (spectrum.top + RIDGE) or no_larger_drop(graph, highest, best, spectrum.top)
        certain = settled and spectrum.residual <= TOLERANCE * spectrum.top
        graph._spectrum = spectrum
        if settled or (most is not None and wanted >= most):
            return k, bool(certain)
        wanted = 4 * wanted if most is None else min(4 * wanted, most)


def no_larger_drop(graph: Graph, known: float, best: float, top: float) -> bool:
    """Whether eigenvalues above `known` are shown to lie so close that none of their drops reaches `best`.

    Some eigenvalue is within the length of the rest of a vertex's line of the Laplacian
    of its degree.  A drop of `best` spans SPANS steps of a geometric ladder, so it would
    hold a window of SPANS - 2 of them; it cannot be where each window holds such a range.
    """
    if not 0 < best < 1 or known <= 0:
        return False
    step = -math.log1p(-best) / SPANS
    windows = SPANS * math.log((top + RIDGE) / (known + RIDGE)) / -math.log1p(-best) - SPANS
    if windows < 0:
        return True
    if windows > MOST_WINDOWS:
        return False
    weights = graph.nodes.select(F.col("vertex").alias("id"), F.array(F.col("weight").cast("double")).alias("q"))
    squares = neighbours.sums(graph.blocks, weights, 1, 2 * graph.gamma)
    rest = F.sqrt(F.col("weight") * F.col("pull")[0]) * (1 + 1e-9)
    ranges = graph.nodes.join(squares.withColumnRenamed("id", "vertex"), "vertex").select((F.col("degree") - rest + RIDGE).alias("low"), (F.col("degree") + rest + RIDGE).alias("high"))
    ladder = [F.log(F.col(c) / (known + RIDGE)) / step for c in ("low", "high")]
    held = ranges.filter("low > 0").select(F.ceil(ladder[1]).alias("last"), F.floor(ladder[0]).alias("first"))
    held = held.select(F.greatest(F.col("last") - (SPANS - 2), F.lit(1)).alias("begin"), F.least("first", F.lit(math.floor(windows) + 1)).alias("end")).filter("begin <= end")
    return held.distinct().select(F.explode(F.sequence("begin", "end"))).distinct().count() == math.floor(windows) + 1


def gap_of(graph: Graph, spectrum: Spectrum) -> tuple[int, float]:
    """The cluster count at the largest known drop, and that drop.

    Copies of a vertex add the eigenvalue degree + weight, weight - 1 times.
    """
    copies = graph.nodes.filter("weight > 1").groupBy((F.col("degree") + F.col("weight")).alias("value")).agg(F.sum(F.col("weight") - 1).alias("times"))
    if not spectrum.whole:
        copies = copies.filter(F.col("value") <= float(spectrum.values[-1]))
    ladder = [(0.0, spectrum.zeros)] if spectrum.zeros else []
    ladder = sorted([*ladder, *[(float(v), 1) for v in spectrum.values], *[(r["value"], r["times"]) for r in copies.collect()]])
    values, below = np.array([v for v, _ in ladder]) + RIDGE, np.cumsum([t for _, t in ladder])
    if len(values) < 2:
        return 1, 0.0
    drops = 1 - values[:-1] / values[1:]
    place = len(drops) - 1 - int(np.argmax(drops[::-1]))   # among equal drops the one at the larger eigenvalues
    k = spectrum.rows - int(below[place])
    return (int(below[place]) + 1 if k > 0.9 * spectrum.rows else k), float(drops[place])
