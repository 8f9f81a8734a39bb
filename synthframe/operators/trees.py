"""Tree ensembles grown by histograms, all models of a search in the same scans.

Features are cut into bins once and the rows written as packed blocks.  A scan adds up
counts and target sums per tree, node and bin for every tree that is growing, whatever
its fold, setting or class; a task sends one packed row a tree, the rows of a tree are
added as they arrive, and only the chosen splits reach the driver.  A forest is grown
once to its greatest depth: its first trees and upper levels are the smaller forests of
the grid.  Boosting follows the softmax loss with one tree a class and round; its
scores are kept with the rows and written anew every few rounds.  Folds and bootstrap
weights are hashes of a row's content, so a lost task repeats the same draw.

Rows that share all cells reach the same leaf of any tree.  Where a table has at most
PROFILES such cell vectors, one scan adds up the sums of each vector (per tree and
fold, or per fold and class) and the trees are grown from these, exactly as from the
rows; longer tables cost longer scans, but no more of them.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthframe.functions.frames import string_columns
from synthframe.session import ship_package, written

#: The settings that the searches run over.
FOREST_TREES = (100, 200, 300, 400)
FOREST_DEPTHS = (1, 3, 5, 7)
CRITERIA = ("squared_error", "poisson")
BOOST_TREES = tuple(range(50, 151, 10))
BOOST_RATES = (0.01, 0.1, 0.2)
BOOST_DEPTHS = (3, 4, 5)
BOOST_SPLIT = (2, 3, 4)
BOOST_LEAF = (1, 2, 3)

BINS = 32
#: Bytes of sums that one scan holds in a task; more trees take more scans.
SCAN_BYTES = 64 << 20
#: Cell vectors of one search; with more of them trees are grown by scans over the rows.
PROFILES = 65_536
#: Rounds of boosting between two writes of the scores.
REWRITE = 3
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1.0, 12.0)]))


def hashed(key: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from the keys of rows and a seed."""
    x = key.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53


# -------------------------------------------------------------------- features

def _number(df: DataFrame, name: str) -> Column:
    kind, column = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.DateType):
        column = F.unix_date(column)
    elif isinstance(kind, T.TimestampNTZType):
        column = column.cast("timestamp")
    return F.coalesce(column.cast("double"), F.lit(float("nan")))


@dataclass
class Encoder:
    """Bins of number columns and values of text columns; a cell is one bin or value of one column.

    Bin 0 of a column holds missing numbers, null texts and texts unknown to the training rows.
    """

    numeric: list[str]
    categories: list[str]
    bounds: list[np.ndarray] = field(default_factory=list)
    values: list[pd.Index] = field(default_factory=list)

    @classmethod
    def fit(cls, df: DataFrame, numeric: Sequence[str], categories: Sequence[str], bins: int = BINS) -> Encoder:
        """Approximate quantiles of every number column and the distinct texts, in one aggregate."""
        made = cls(list(numeric), list(categories))
        shares = [i / bins for i in range(1, bins)]
        parts = [F.percentile_approx(F.nanvl(_number(df, c), F.lit(None).cast("double")), shares, 10_000).alias(f"n{i}") for i, c in enumerate(numeric)]
        parts += [F.collect_set(f"`{c}`").alias(f"c{i}") for i, c in enumerate(categories)]
        row = df.agg(F.count("*").alias("rows"), *parts).first()
        made.bounds = [np.unique(np.array(row[f"n{i}"] or [], dtype=float)) for i in range(len(made.numeric))]
        made.values = [pd.Index(sorted(row[f"c{i}"])) for i in range(len(made.categories))]
        return made

    @property
    def starts(self) -> np.ndarray:
        """First cell of every column, and the number of cells at the end."""
        return np.cumsum([0, *[len(b) + 2 for b in self.bounds], *[len(v) + 1 for v in self.values]])

    @property
    def equality(self) -> np.ndarray:
        """Per column: whether a split asks for one value and not for an order."""
        return np.array([False] * len(self.bounds) + [True] * len(self.values))

    def columns(self, df: DataFrame) -> list[Column]:
        numbers = F.array(*[_number(df, c) for c in self.numeric]) if self.numeric else F.array().cast("array<double>")
        texts = F.array(*[F.col(f"`{c}`").cast("string") for c in self.categories]) if self.categories else F.array().cast("array<string>")
        return [numbers.alias("numbers"), texts.alias("texts")]

    def cells(self, numbers: pa.Array, texts: pa.Array) -> np.ndarray:
        """Cell numbers, rows x columns."""
        n, starts = len(numbers), self.starts
        out = np.empty((n, len(starts) - 1), np.int32)
        values = numbers.flatten().to_numpy(zero_copy_only=False).reshape(n, len(self.numeric))
        for j, bounds in enumerate(self.bounds):
            v = values[:, j]
            out[:, j] = starts[j] + np.where(np.isnan(v), 0, 1 + np.searchsorted(bounds, v, side="left"))
        words = texts.flatten().to_numpy(zero_copy_only=False).reshape(n, len(self.categories))
        for j, known in enumerate(self.values):
            out[:, len(self.bounds) + j] = starts[len(self.bounds) + j] + 1 + known.get_indexer(pd.Index(words[:, j], dtype=object))
        return out


@dataclass
class Block:
    """Rows of one packed block: keys, target, cells, boosting scores."""

    key: np.ndarray
    y: np.ndarray
    x: np.ndarray
    scores: np.ndarray

    def folds(self, folds: int, seed: int) -> np.ndarray:
        return (hashed(self.key, seed) * folds).astype(np.int64)


_PACKED = "key binary, y binary, x binary, scores binary"


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Block]:
    for batch in batches:
        for key, y, x, scores in zip(*(batch[c].to_pylist() for c in ("key", "y", "x", "scores")), strict=True):
            keys = np.frombuffer(key, np.int64)
            yield Block(keys, np.frombuffer(y), np.frombuffer(x, np.int32).reshape(len(keys), width), np.frombuffer(scores).reshape(len(keys), -1))


def _packed(block: Block) -> pa.RecordBatch:
    columns = [np.ascontiguousarray(a).tobytes() for a in (block.key, block.y, block.x, block.scores)]
    return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["key", "y", "x", "scores"])


def pack(df: DataFrame, encoder: Encoder, label: str, classes: pd.Index | None = None) -> DataFrame:
    """The rows with a label as a written table of packed blocks; with `classes` the target is the class number."""
    spark, used = df.sparkSession, [*encoder.numeric, *encoder.categories, label]
    ship_package(spark)
    target = F.col(f"`{label}`").cast("string" if classes is not None else "double")
    rows = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in used]).alias("key"), target.alias("y"), *encoder.columns(df)).filter("y IS NOT NULL AND y <> 'NaN'")
    tasks = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < tasks:
        rows = rows.repartition(tasks)
    empty = None if classes is None else len(classes)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                y = batch["y"].to_numpy(zero_copy_only=False)
                y = y.astype(float) if empty is None else classes.get_indexer(pd.Index(y, dtype=object)).astype(float)
                yield _packed(Block(batch["key"].to_numpy(), y, encoder.cells(batch["numbers"], batch["texts"]), np.zeros((len(y), 0))))

    return written(rows.mapInArrow(run, _PACKED), "tree-rows")


# ----------------------------------------------------------------------- trees

@dataclass
class Tree:
    """A tree as a heap: node i has children 2i + 1 and 2i + 2; a leaf has no column."""

    depth: int
    column: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls(depth, np.full(size, -1, np.int16), np.zeros(size, np.int32), np.zeros(size))

    def nodes(self, x: np.ndarray, equality: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row reaches after at most `levels` splits."""
        at = np.zeros(len(x), np.int64)
        flat, row = x.ravel(), np.arange(len(x)) * x.shape[1]
        for _ in range(min(levels, self.depth)):
            column, cut = self.column[at], self.cut[at]
            cell = flat[row + np.maximum(column, 0)]
            left = (cell <= cut) & ((cell == cut) | ~equality[column])
            at = np.where(column >= 0, 2 * at + 2 - left, at)
        return at

    def divide(self, level: int, splits: Sequence[np.ndarray]) -> None:
        """Take the splits of a level's nodes, as `best_splits` returns them."""
        column, cut, own, left, right = splits
        here = np.arange(2 ** level) + 2 ** level - 1
        if level == 0:
            self.value[0] = own[0]
        split = column >= 0
        self.column[here], self.cut[here] = column, cut
        self.value[2 * here[split] + 1], self.value[2 * here[split] + 2] = left[split], right[split]

    def splits_above(self, level: int) -> bool:
        """Whether any node of this level exists."""
        first = 2 ** level - 1
        return level == 0 or bool((self.column[(first - 1) // 2:first] >= 0).any())

    def predict(self, x: np.ndarray, equality: np.ndarray, levels: int | None = None) -> np.ndarray:
        return self.value[self.nodes(x, equality, self.depth if levels is None else levels)]


@dataclass
class Rules:
    """How a tree chooses splits: criterion, fewest rows of a node that splits and of a leaf, factor of leaf values."""

    criterion: str = "squared_error"
    split: int = 2
    leaf: int = 1
    factor: float = 1.0


def best_splits(sums: np.ndarray, starts: np.ndarray, equality: np.ndarray, rules: Rules) -> tuple[np.ndarray, ...]:
    """(column or -1, cut, own value, left value, right value) of every node; `sums` is nodes x cells x (rows, a, b).

    A value is b / a.  Squared error gains b^2 / a, Poisson deviance b log(b / a), and
    boosting ("gradient") b^2 / rows.  Equal gains take the first cell.
    """
    nodes = len(sums)
    whole = sums[:, starts[0]:starts[1]].sum(axis=1)
    left = sums.copy()
    for j in np.flatnonzero(~equality):
        left[:, starts[j]:starts[j + 1]] = np.cumsum(sums[:, starts[j]:starts[j + 1]], axis=1)
    right = whole[:, None] - left

    def gain(s):
        rows, a, b = s[..., 0], s[..., 1], s[..., 2]
        if rules.criterion == "poisson":
            ok = (a > 0) & (b > 1e-12)
            return np.where(ok, b * np.log(np.where(ok, b, 1.0) / np.where(ok, a, 1.0)), -np.inf)
        weight = rows if rules.criterion == "gradient" else a
        return np.where(weight > 0, b * b / np.where(weight > 0, weight, 1.0), 0.0)

    base = gain(whole)
    with np.errstate(invalid="ignore"):
        better = gain(left) + gain(right) - base[:, None]
    allowed = (left[..., 0] >= rules.leaf) & (right[..., 0] >= rules.leaf) & (whole[:, 0] >= rules.split)[:, None]
    better = np.where(allowed & np.isfinite(better), better, -np.inf)
    cell = better.argmax(axis=1)
    pick = np.arange(nodes)
    scale = np.where(np.isfinite(base), np.abs(base), 0.0)
    column = np.where(better[pick, cell] > 1e-10 * scale + 1e-14, np.searchsorted(starts, cell, side="right") - 1, -1)

    def value(s):
        return rules.factor * np.where(s[:, 1] > 1e-150, s[:, 2] / np.where(s[:, 1] > 1e-150, s[:, 1], 1.0), 0.0)

    return column, cell, value(whole), value(left[pick, cell]), value(right[pick, cell])


#: Per block: (tree number, rows that take part, their a and b) of every growing tree.
Source = Callable[[Block], Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]


def _scan(blocks: DataFrame, trees: dict[int, Tree], rules: dict[int, Rules], source: Source, level: int, encoder: Encoder) -> None:
    """Add one level to the trees, from one pass over the blocks."""
    starts, equality, width = encoder.starts, encoder.equality, len(encoder.starts) - 1
    cells, nodes, first = int(starts[-1]), 2 ** level, 2 ** level - 1

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for block in _blocks(batches, width):
            for t, rows, a, b in source(block):
                x = block.x[rows]
                at = trees[t].nodes(x, equality, level) - first
                inside = at >= 0
                if not inside.any():
                    continue
                code = (at[inside, None] * cells + x[inside]).ravel()
                sums = np.stack([np.bincount(code, None if v is None else np.repeat(v[inside], width), nodes * cells) for v in (None, a, b)], axis=1).astype(float)
                totals[t] = totals[t] + sums if t in totals else sums
        for t, sums in totals.items():
            some = np.flatnonzero(sums[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([some.astype(np.int32).tobytes()], pa.binary()),
                                              pa.array([sums[some].tobytes()], pa.binary())], ["tree", "at", "sums"])

    def choose(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, at, sums in zip(*(batch[c].to_pylist() for c in ("tree", "at", "sums")), strict=True):
                held = totals.setdefault(t, np.zeros((nodes * cells, 3)))
                held[np.frombuffer(at, np.int32)] += np.frombuffer(sums).reshape(-1, 3)
        for t, sums in totals.items():
            found = best_splits(sums.reshape(nodes, cells, 3), starts, equality, rules[t])
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([np.stack(found).astype(float).tobytes()], pa.binary())], ["tree", "splits"])

    packed = blocks.mapInArrow(add, "tree int, at binary, sums binary")
    chosen = packed.repartition(blocks.sparkSession.sparkContext.defaultParallelism, "tree").mapInArrow(choose, "tree int, splits binary").collect()
    for row in chosen:
        trees[row["tree"]].divide(level, np.frombuffer(row["splits"]).reshape(5, nodes))


def grow(blocks: DataFrame, trees: dict[int, Tree], rules: dict[int, Rules], make_source: Callable[[list[int]], Source], encoder: Encoder) -> None:
    """Grow all trees level by level; a scan takes as many trees as its sums have room for."""
    for level in range(max(t.depth for t in trees.values())):
        room = max(1, SCAN_BYTES // (2 ** level * int(encoder.starts[-1]) * 24))
        alive = [t for t, tree in trees.items() if tree.depth > level and tree.splits_above(level)]
        for s in range(0, len(alive), room):
            some = alive[s:s + room]
            _scan(blocks, {t: trees[t] for t in some}, {t: rules[t] for t in some}, make_source(some), level, encoder)


# --------------------------------------------------------------- cell vectors

@dataclass
class Profiles:
    """The distinct cell vectors of a table, in the order of their codes."""

    codes: np.ndarray
    x: np.ndarray
    encoder: Encoder

    def places(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.codes, _codes(x, self.encoder))


def _codes(x: np.ndarray, encoder: Encoder) -> np.ndarray:
    """One number per cell vector: its cells as digits, each column with its own base."""
    starts = encoder.starts
    return (x - starts[:-1]) @ np.cumprod(np.r_[1, np.diff(starts)[:-1]])


def find_profiles(blocks: DataFrame, encoder: Encoder, most: int) -> Profiles | None:
    """The cell vectors of the blocks, or None if there are more than `most`."""
    sizes = np.diff(encoder.starts)
    if not len(sizes) or np.log2(sizes.astype(float)).sum() > 62:
        return None
    width = len(sizes)

    def distinct(batches):
        for block in _blocks(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_codes(block.x, encoder)))], ["code"])

    rows = blocks.mapInArrow(distinct, "code bigint").distinct().limit(most + 1).collect()
    if not rows or len(rows) > most:
        return None
    codes = np.sort(np.array([r["code"] for r in rows], np.int64))
    digits = codes[:, None] // np.cumprod(np.r_[1, sizes[:-1]]) % sizes
    return Profiles(codes, (digits + encoder.starts[:-1]).astype(np.int32), encoder)


def grow_on(x: np.ndarray, sums: np.ndarray, depth: int, rules: Rules, encoder: Encoder) -> Tree:
    """A tree from cell vectors and their sums (rows, a, b)."""
    starts, equality, width = encoder.starts, encoder.equality, x.shape[1]
    tree, cells = Tree.empty(depth), int(starts[-1])
    for level in range(depth):
        if not tree.splits_above(level):
            break
        nodes = 2 ** level
        at = tree.nodes(x, equality, level) - (nodes - 1)
        inside = at >= 0
        code = (at[inside, None] * cells + x[inside]).ravel()
        held = np.stack([np.bincount(code, np.repeat(sums[inside, i], width), nodes * cells) for i in range(3)], axis=1)
        tree.divide(level, best_splits(held.reshape(nodes, cells, 3), starts, equality, rules))
    return tree


# --------------------------------------------------------------------- forests

@dataclass
class Forest:
    """The mean of trees, read to a depth."""

    encoder: Encoder
    trees: list[Tree]
    depth: int
    criterion: str
    scores: pd.DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        """`df` with `prediction`."""
        ship_package(df.sparkSession)
        encoder, trees, depth, equality = self.encoder, self.trees, self.depth, self.encoder.equality

        @F.arrow_udf("double")
        def predict(numbers: pa.Array, texts: pa.Array) -> pa.Array:
            x = encoder.cells(numbers, texts)
            return pa.array(sum(t.predict(x, equality, depth) for t in trees) / len(trees))

        return df.withColumn("prediction", predict(*encoder.columns(df)))


def forest_search(df: DataFrame, numeric: Sequence[str], categories: Sequence[str], label: str, trees: Sequence[int] = FOREST_TREES,
                  depths: Sequence[int] = FOREST_DEPTHS, criteria: Sequence[str] = CRITERIA, folds: int = 5, seed: int = 42, bins: int = BINS) -> Forest:
    """Grid over trees, depth and criterion, k-fold, by mean absolute error, refitted on all rows.

    A node whose targets do not sum to more than zero has no Poisson split.  Rows without
    a label are left out; no row at all is an error.  Rows of equal content share a fold
    and a bootstrap weight.  `scores` of the result holds every grid point's fold errors.
    """
    encoder = Encoder.fit(df, numeric, categories, bins)
    blocks = pack(df, encoder, label)
    most, depth, width, equality = max(trees), max(depths), len(encoder.starts) - 1, encoder.equality
    models = [(c, f) for c in criteria for f in (*range(folds), -1)]  # fold -1 learns from all rows
    grown = {m * most + i: Tree.empty(depth) for m in range(len(models)) for i in range(most)}
    rules = {t: Rules(models[t // most][0]) for t in grown}
    profiles = find_profiles(blocks, encoder, PROFILES)

    def weights_of(block, i):
        return np.searchsorted(_POISSON, hashed(block.key, seed * 1_000_003 + 1 + i), side="right").astype(float)

    def make_source(some):
        def source(block):
            fold, weights = block.folds(folds, seed), {}
            for t in some:
                i = t % most
                if i not in weights:
                    weights[i] = weights_of(block, i)
                rows = np.flatnonzero((fold != models[t // most][1]) & (weights[i] > 0))
                w = weights[i][rows]
                yield t, rows, w, w * block.y[rows]

        return source

    def predictions(x, m):
        """(depth, trees, mean of the first trees) of a model's forests."""
        for d in sorted(set(depths)):
            total = np.zeros(len(x))
            for i in range(most):
                total += grown[m * most + i].predict(x, equality, d)
                if i + 1 in trees:
                    yield d, i + 1, total / (i + 1)

    if profiles is None:
        grow(blocks, grown, rules, make_source, encoder)
    else:
        grown.update(_forest_trees(blocks, profiles, models, most, depth, folds, seed, weights_of))
        known = _forest_means(blocks.sparkSession, profiles, models, predictions)

    def errors(batches):
        rows = []
        for block in _blocks(batches, width):
            fold = block.folds(folds, seed)
            places = None if profiles is None else profiles.places(block.x)
            for m, (criterion, f) in enumerate(models):
                held = np.flatnonzero(fold == f)
                if not len(held):
                    continue
                means = predictions(block.x[held], m) if profiles is None else ((d, n, mean[places[held]]) for d, n, mean in known[m])
                rows += [(criterion, d, n, f, len(held), float(np.abs(mean - block.y[held]).sum())) for d, n, mean in means]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["criterion", "depth", "trees", "fold", "n", "error"]).astype(
            {"criterion": str, "depth": "int32", "trees": "int32", "fold": "int32", "n": "int64", "error": float}), preserve_index=False)

    found = blocks.mapInArrow(errors, "criterion string, depth int, trees int, fold int, n bigint, error double")
    by_fold = found.groupBy("criterion", "depth", "trees", "fold").agg(F.sum("error").alias("error"), F.sum("n").alias("n")).toPandas()
    if by_fold.empty:
        raise ValueError("no row with a label to learn from")
    by_fold["mae"] = by_fold["error"] / by_fold["n"]
    table = by_fold.groupby(["criterion", "depth", "trees"], as_index=False)["mae"].mean().sort_values(["mae", "trees", "depth", "criterion"])
    best = table.iloc[0]
    m = models.index((best["criterion"], -1))
    chosen = [grown[m * most + i] for i in range(int(best["trees"]))]
    return Forest(encoder, chosen, int(best["depth"]), str(best["criterion"]), table.reset_index(drop=True))


def _forest_trees(blocks: DataFrame, profiles: Profiles, models: list[tuple[str, int]], most: int, depth: int, folds: int, seed: int,
                  weights_of: Callable[[Block, int], np.ndarray]) -> dict[int, Tree]:
    """All trees of a forest search from the sums of each cell vector, per bootstrap and fold."""
    width, count, encoder = profiles.x.shape[1], len(profiles.x), profiles.encoder
    size = count * folds
    room = max(1, SCAN_BYTES // (size * 24))
    made: dict[int, Tree] = {}
    for s in range(0, most, room):
        some = range(s, min(s + room, most))

        def add(batches, some=some):
            totals: dict[int, np.ndarray] = {}
            for block in _blocks(batches, width):
                place = profiles.places(block.x) * folds + block.folds(folds, seed)
                for i in some:
                    w = weights_of(block, i)
                    at = place[w > 0]
                    sums = np.stack([np.bincount(at, minlength=size), np.bincount(place, w, size), np.bincount(place, w * block.y, size)], axis=1).astype(float)
                    totals[i] = totals[i] + sums if i in totals else sums
            for i, sums in totals.items():
                held = np.flatnonzero(sums[:, 0])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([held.astype(np.int32).tobytes()], pa.binary()),
                                                  pa.array([sums[held].tobytes()], pa.binary())], ["tree", "at", "sums"])

        def build(batches):
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, at, sums in zip(*(batch[c].to_pylist() for c in ("tree", "at", "sums")), strict=True):
                    totals.setdefault(i, np.zeros((size, 3)))[np.frombuffer(at, np.int32)] += np.frombuffer(sums).reshape(-1, 3)
            for i, sums in totals.items():
                by_fold = sums.reshape(count, folds, 3)
                for m, (criterion, f) in enumerate(models):
                    part = by_fold[:, [g for g in range(folds) if g != f]].sum(axis=1)
                    held = part[:, 0] > 0
                    tree = grow_on(profiles.x[held], part[held], depth, Rules(criterion), encoder)
                    yield pa.RecordBatch.from_arrays([pa.array([m * most + i], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in (tree.column, tree.cut, tree.value)]],
                                                     ["tree", "columns", "cuts", "values"])

        packed = blocks.mapInArrow(add, "tree int, at binary, sums binary")
        tasks = blocks.sparkSession.sparkContext.defaultParallelism
        for r in packed.repartition(tasks, "tree").mapInArrow(build, "tree int, columns binary, cuts binary, values binary").collect():
            made[r["tree"]] = Tree(depth, np.frombuffer(r["columns"], np.int16), np.frombuffer(r["cuts"], np.int32), np.frombuffer(r["values"]))
    return made


def _forest_means(spark, profiles: Profiles, models: list[tuple[str, int]], predictions: Callable) -> dict[int, list]:
    """Per model with a fold: (depth, trees, mean prediction of every cell vector); a task serves one model."""
    def run(batches):
        for batch in batches:
            for m in batch["id"].to_pylist():
                if models[m][1] >= 0:
                    for d, n, mean in predictions(profiles.x, m):
                        yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([d], pa.int32()), pa.array([n], pa.int32()), pa.array([mean.tobytes()], pa.binary())],
                                                         ["model", "depth", "trees", "means"])

    known: dict[int, list] = {}
    for r in spark.range(0, len(models), 1, len(models)).mapInArrow(run, "model int, depth int, trees int, means binary").collect():
        known.setdefault(r["model"], []).append((r["depth"], r["trees"], np.frombuffer(r["means"])))
    return known


# -------------------------------------------------------------------- boosting

@dataclass
class Setting:
    """One draw of the boosting search."""

    trees: int
    rate: float
    depth: int
    split: int
    leaf: int


@dataclass
class Boosting:
    """Class scores as the sum of a prior and shrunken trees, one a class and round (one a round for two classes)."""

    encoder: Encoder
    classes: list[str]
    prior: np.ndarray
    rounds: list[list[Tree]]
    setting: Setting
    scores: pd.DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        """`df` with `prediction` (the class as text) and `probability` (per class, in the order of `classes`)."""
        ship_package(df.sparkSession)
        encoder, prior, rounds, rate, equality = self.encoder, self.prior, self.rounds, self.setting.rate, self.encoder.equality

        @F.arrow_udf("array<double>")
        def probability(numbers: pa.Array, texts: pa.Array) -> pa.Array:
            x = encoder.cells(numbers, texts)
            raw = np.tile(prior, (len(x), 1))
            for trees in rounds:
                for k, tree in enumerate(trees):
                    raw[:, k] += rate * tree.predict(x, equality)
            shares = probabilities(raw)
            return pa.ListArray.from_arrays(np.arange(0, shares.size + 1, shares.shape[1], dtype=np.int32), shares.ravel())

        out = df.withColumn("probability", probability(*encoder.columns(df)))
        names = F.array(*[F.lit(c) for c in self.classes])
        return out.withColumn("prediction", F.get(names, F.array_position("probability", F.array_max("probability")).cast("int") - 1))


def probabilities(raw: np.ndarray) -> np.ndarray:
    """Softmax of the scores; one score is that of the second of two classes."""
    if raw.shape[1] == 1:
        raw = np.hstack([np.zeros_like(raw), raw])
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def boosting_search(df: DataFrame, numeric: Sequence[str], categories: Sequence[str], label: str, draws: int = 10, folds: int = 5, seed: int = 123,
                    trees: Sequence[int] = BOOST_TREES, rates: Sequence[float] = BOOST_RATES, depths: Sequence[int] = BOOST_DEPTHS,
                    split: Sequence[int] = BOOST_SPLIT, leaf: Sequence[int] = BOOST_LEAF, bins: int = BINS) -> Boosting:
    """Boosted trees on the softmax loss, `draws` settings picked from the grid by seed, k-fold, by accuracy, refitted on all rows.

    Labels of any type are compared as text; rows without one are left out.  All draws
    and folds, and the fits on all rows, advance in the same scans.
    """
    space = list(product(trees, rates, depths, split, leaf))
    settings = [Setting(*s) for s in random.Random(seed).sample(space, min(draws, len(space)))]
    counts = df.groupBy(F.col(f"`{label}`").cast("string").alias("label")).count().collect()
    classes = pd.Index(sorted(r["label"] for r in counts if r["label"] not in (None, "NaN")))
    if len(classes) < 2:
        raise ValueError("boosting needs rows of two classes or more")
    encoder = Encoder.fit(df, numeric, categories, bins)
    blocks = pack(df, encoder, label, classes)
    wide, width = (1 if len(classes) == 2 else len(classes)), len(encoder.starts) - 1
    models = [(d, f) for d in range(len(settings)) for f in (*range(folds), -1)]

    def seen(batches):
        for block in _blocks(batches, width):
            fold, c = block.folds(folds, seed), block.y.astype(int)
            table = np.bincount(fold * len(classes) + c, minlength=folds * len(classes))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(table))), pa.array(table)], ["place", "n"])

    held = np.zeros(folds * len(classes))
    for row in blocks.mapInArrow(seen, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect():
        held[row["place"]] = row["n"]
    held = held.reshape(folds, len(classes))

    def prior(fold: int) -> np.ndarray:
        share = held.sum(axis=0) - (held[fold] if fold >= 0 else 0)
        share = np.log(np.maximum(share, 1e-9) / max(share.sum(), 1e-9))
        return share[1:] - share[0] if wide == 1 else share

    starts = np.stack([prior(f) for _, f in models])
    profiles = find_profiles(blocks, encoder, PROFILES)
    if profiles is None:
        sums, rounds_of = _boost_by_scans(blocks, encoder, models, settings, starts, len(classes), folds, seed)
    else:
        sums, rounds_of = _boost_on_profiles(blocks, profiles, models, settings, starts, len(classes), folds, seed)
    sums["draw"] = [models[m][0] for m in sums["model"]]
    sums["accuracy"] = sums["hit"] / sums["n"]
    table = sums.groupby("draw", as_index=False)["accuracy"].mean().sort_values(["accuracy", "draw"], ascending=[False, True])
    best = int(table.iloc[0]["draw"])
    m = models.index((best, -1))
    rounds = rounds_of(m)
    for name in ("trees", "rate", "depth", "split", "leaf"):
        table[name] = [getattr(settings[int(d)], name) for d in table["draw"]]
    return Boosting(encoder, list(classes), starts[m], rounds, settings[best], table.reset_index(drop=True))


def _boost_by_scans(blocks: DataFrame, encoder: Encoder, models: list[tuple[int, int]], settings: list[Setting], starts: np.ndarray, classes: int, folds: int,
                    seed: int) -> tuple[pd.DataFrame, Callable[[int], list[list[Tree]]]]:
    """(model, rows and hits of its held-out fold) and the trees of a model; all models advance in the same scans of the rows."""
    wide, width, equality = starts.shape[1], len(encoder.starts) - 1, encoder.equality
    factor = 1.0 if wide == 1 else (wide - 1) / wide
    rates_of = [settings[d].rate for d, _ in models]
    history: list[dict[int, Tree]] = []  # one entry a round: number of model and class -> tree
    kept = 0  # rounds whose scores are written with the rows

    def scores(block: Block, recent: list[dict[int, Tree]], some: Sequence[int]) -> dict[int, np.ndarray]:
        """Scores of the models, rows x classes."""
        out = {}
        for m in some:
            raw = block.scores.reshape(len(block.y), len(models), wide)[:, m].copy() if block.scores.size else np.tile(starts[m], (len(block.y), 1))
            for trees_of in recent:
                for k in range(wide):
                    if m * wide + k in trees_of:
                        raw[:, k] += rates_of[m] * trees_of[m * wide + k].predict(block.x, equality)
            out[m] = raw
        return out

    def with_scores(recent):
        def run(batches):
            for block in _blocks(batches, width):
                found = scores(block, recent, range(len(models)))
                yield _packed(Block(block.key, block.y, block.x, np.stack([found[m] for m in range(len(models))], axis=1)))

        return run

    def source_of(recent):
        def make(some):
            def source(block):
                fold = block.folds(folds, seed)
                for m, raw in scores(block, recent, sorted({t // wide for t in some})).items():
                    rows = np.flatnonzero(fold != models[m][1])
                    p = probabilities(raw[rows])[:, -wide:]
                    for k in range(wide):
                        if m * wide + k in some:
                            g = (block.y[rows] == k + (wide == 1)) - p[:, k]
                            yield m * wide + k, rows, p[:, k] * (1 - p[:, k]), g

            return source

        return make

    for r in range(max(s.trees for s in settings)):
        if r - kept == REWRITE:
            blocks, kept = written(blocks.mapInArrow(with_scores(history[kept:]), _PACKED), "tree-scores"), r
        grown, rules = {}, {}
        for m, (d, _) in enumerate(models):
            s = settings[d]
            if r < s.trees:
                for k in range(wide):
                    grown[m * wide + k] = Tree.empty(s.depth)
                    rules[m * wide + k] = Rules("gradient", s.split, s.leaf, factor)
        grow(blocks, grown, rules, source_of(history[kept:]), encoder)
        history.append(grown)

    def hits(recent):
        def run(batches):
            for block in _blocks(batches, width):
                fold, found = block.folds(folds, seed), scores(block, recent, range(len(models)))
                right = [(m, int((fold == f).sum()), int((probabilities(found[m]).argmax(axis=1) == block.y)[fold == f].sum())) for m, (_, f) in enumerate(models) if f >= 0]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*right, strict=True)], ["model", "n", "hit"])

        return run

    sums = blocks.mapInArrow(hits(history[kept:]), "model bigint, n bigint, hit bigint").groupBy("model").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).filter("n > 0").toPandas()
    return sums, lambda m: [[trees_of[m * wide + k] for k in range(wide)] for trees_of in history[:settings[models[m][0]].trees]]


def _boost_on_profiles(blocks: DataFrame, profiles: Profiles, models: list[tuple[int, int]], settings: list[Setting], starts: np.ndarray, classes: int, folds: int,
                       seed: int) -> tuple[pd.DataFrame, Callable[[int], list[list[Tree]]]]:
    """As `_boost_by_scans`, from the rows of each cell vector, fold and class; a task serves one model."""
    wide, width, encoder, equality = starts.shape[1], profiles.x.shape[1], profiles.encoder, profiles.encoder.equality
    factor, size = 1.0 if wide == 1 else (wide - 1) / wide, folds * classes
    x = profiles.x

    def count(batches):
        total = np.zeros(len(x) * size, np.int64)
        for block in _blocks(batches, width):
            total += np.bincount((profiles.places(block.x) * folds + block.folds(folds, seed)) * classes + block.y.astype(np.int64), minlength=len(total))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], ["place", "n"])

    found = blocks.mapInArrow(count, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(x) * size)
    counts[found["place"].to_numpy()] = found["n"].to_numpy()
    counts = counts.reshape(len(x), folds, classes)

    def learn(m: int) -> tuple[list[list[Tree]], np.ndarray]:
        (draw, fold), setting = models[m], settings[models[m][0]]
        rules = Rules("gradient", setting.split, setting.leaf, factor)
        per_class = counts[:, [f for f in range(folds) if f != fold]].sum(axis=1)
        rows = per_class.sum(axis=1)
        seen, raw, rounds = rows > 0, np.tile(starts[m], (len(x), 1)), []
        for _ in range(setting.trees):
            p, grown = probabilities(raw)[:, -wide:], []
            for k in range(wide):
                sums = np.stack([rows, rows * p[:, k] * (1 - p[:, k]), per_class[:, k + (wide == 1)] - rows * p[:, k]], axis=1)
                grown.append(grow_on(x[seen], sums[seen], setting.depth, rules, encoder))
            for k, tree in enumerate(grown):
                raw[:, k] += setting.rate * tree.predict(x, equality)
            rounds.append(grown)
        return rounds, raw

    def run(batches):
        for batch in batches:
            for m in batch["id"].to_pylist():
                fold = models[m][1]
                rounds, raw = learn(m)
                if fold >= 0:
                    guess = probabilities(raw).argmax(axis=1)
                    n, hit, kept = int(counts[:, fold].sum()), int(counts[np.arange(len(x)), fold, guess].sum()), None
                else:
                    n, hit, kept = 0, 0, np.concatenate([np.concatenate([t.column, t.cut, t.value]) for grown in rounds for t in grown]).astype(float).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.int64()), pa.array([n], pa.int64()), pa.array([hit], pa.int64()), pa.array([kept], pa.binary())], ["model", "n", "hit", "trees"])

    made = blocks.sparkSession.range(0, len(models), 1, len(models)).mapInArrow(run, "model bigint, n bigint, hit bigint, trees binary").collect()
    packed = {r["model"]: r["trees"] for r in made if r["trees"] is not None}

    def rounds_of(m: int) -> list[list[Tree]]:
        setting = settings[models[m][0]]
        parts = np.frombuffer(packed[m]).reshape(setting.trees, wide, 3, -1)
        return [[Tree(setting.depth, column.astype(np.int16), cut.astype(np.int32), value) for column, cut, value in grown] for grown in parts]

    return pd.DataFrame([(r["model"], r["n"], r["hit"]) for r in made if r["n"] > 0], columns=["model", "n", "hit"]), rounds_of


def inputs(df: DataFrame, label: str, drop: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(number, date and boolean columns; text columns) that a model may learn from."""
    categories = [c for c in string_columns(df) if c != label and c not in drop]
    return [c for c in df.columns if c not in categories and c != label and c not in drop], categories
