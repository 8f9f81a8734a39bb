"""Merkle manifest of a dataset: leaves, subroots per group, one root and a proof for every row.

A row's leaf is the SHA-256 of its fields; the leaves of a group, in order, are hashed in
runs of two until one subroot is left, and the subroots likewise give the root.  Nodes
are held in superblocks of 2^HEIGHT neighbours.  On the way up each superblock is reduced
to its top node and the tops form the next layer, so a tree of any size takes a few
layers and no task sees more than one superblock.  On the way down the nodes of a
superblock and the outer nodes that its proofs need (one row) are cogrouped, and one
function reduces the superblock again, joins inner and outer siblings and folds them.

Ties and odd rows: equal order keys follow each other by leaf, a null order key comes
first, a null group is the first group; null and empty fields have different leaves;
repeated rows have equal leaves at different places.  An empty table gives no rows.
Columns other than the fields are not read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthframe.llm.common import BROADCAST_KEYS, stash
from synthframe.session import ship_package

#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEIGHT = 10
NODE = "tree string, pos bigint, n bigint, digest string"
PATH = "tree string, pos bigint, subroot string, root string, lefts array<boolean>, siblings array<string>"
RESULT = "subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def levels(nodes: list[str], height: int) -> list[list[str]]:
    """The nodes and the `height` levels above them."""
    out = [nodes]
    for _ in range(height):
        below = out[-1]
        out.append([digest(*below[i:i + 2]) for i in range(0, len(below), 2)])
    return out


def height_of(n: int, most: int) -> int:
    """Levels that a superblock of a layer of n nodes is reduced by."""
    return min(most, (n - 1).bit_length())


def path_in(tree: list[list[str]], place: int) -> tuple[list[bool], list[str | None]]:
    """For each level below the top: whether the sibling is to the left, and the sibling if there is one."""
    lefts, siblings = [], []
    for level, nodes in enumerate(tree[:-1]):
        at = place >> level
        other = at ^ 1
        lefts.append(bool(at & 1))
        siblings.append(nodes[other] if other < len(nodes) else None)
    return lefts, siblings


def fold(start: str, lefts: Sequence[bool], siblings: Sequence[str | None]) -> str:
    """The top that a node and its siblings lead to."""
    node = start
    for left, other in zip(lefts, siblings, strict=True):
        node = digest(node) if other is None else digest(other, node) if left else digest(node, other)
    return node


def ranked(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """`nodes` with `pos`, the place in the tree by `order`, and `n`, the nodes of the tree.

    Range partitions are sorted and numbered apart and written; what comes before a
    partition is summed over (tree, partition), of which there are few.  The last sort
    key numbers the input rows, so that repeated rows are split between partitions too.
    """
    keys = ["tree", *order, "tie"]
    numbered = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stash(numbered.drop("tie").withColumn("place", F.monotonically_increasing_id()), "merkle-places")
    placed = placed.withColumn("part", F.shiftright("place", 33))
    runs = placed.groupBy("tree", "part").agg(F.min("place").alias("low"), F.count("*").alias("rows"))
    before = "sum(rows) OVER (PARTITION BY tree ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    runs = stash(runs.selectExpr("tree", "part", f"coalesce({before}, 0) - low AS shift", "sum(rows) OVER (PARTITION BY tree) AS n"), "merkle-runs")
    if runs.count() <= BROADCAST_KEYS:
        runs = F.broadcast(runs)
    return placed.join(runs, ["tree", "part"]).withColumn("pos", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def blocks(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", height))


def climb(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The layers (tree, pos, n, digest) from the tops of the first superblocks to one node a tree."""
    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        tops = levels(rows.sort_values("pos")["digest"].tolist(), height_of(n, height))[-1]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [-(-n >> height)], "digest": tops})

    layers, below = [], nodes
    while not layers or below.filter("n > 1").limit(1).count():
        slim = below.select("tree", "pos", "n", "digest")
        below = stash(blocks(slim, height).groupBy("tree", "block").applyInPandas(reduce, NODE), "merkle-layer")
        layers.append(below)
    return layers


def descend(layers: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """Outer paths (PATH) of the nodes of the lowest layer; `tops` holds those of the highest."""
    def exchange(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        above = outer.iloc[0]
        tree = levels(rows["digest"].tolist(), height_of(int(rows["n"].iloc[0]), height))
        paths = [path_in(tree, i) for i in range(len(rows))]
        return pd.DataFrame({
            "tree": key[0], "pos": rows["pos"].to_numpy(), "subroot": above["subroot"], "root": above["root"],
            "lefts": [[*lefts, *above["lefts"]] for lefts, _ in paths],
            "siblings": [[*siblings, *above["siblings"]] for _, siblings in paths]})

    paths = tops
    for layer in reversed(layers[:-1]):
        outer = paths.withColumnRenamed("pos", "block")
        inner = blocks(layer, height)
        paths = stash(inner.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(exchange, PATH), "merkle-paths")
    return paths


def proved(nodes: DataFrame, paths: DataFrame, height: int, keep: str, proofs: bool) -> DataFrame:
    """The columns `keep` (a schema) of every node of the lowest layer, with its proof and what it folds to.

    `nodes` may have `changed`, a digest that is folded in place of the node's own.
    """
    names = [part.split()[0] for part in keep.split(", ")]

    def finish(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        above = outer.iloc[0]
        digests = rows["digest"].tolist()
        tree = levels(digests, height_of(int(rows["n"].iloc[0]), height))
        starts = [c or d for c, d in zip(rows["changed"].tolist(), digests, strict=True)]
        found = []
        for i, start in enumerate(starts):
            lefts, siblings = path_in(tree, i)
            lefts, siblings = [*lefts, *above["lefts"]], [*siblings, *above["siblings"]]
            proof = [s for s in siblings if s is not None]
            found.append((digest(*proof), fold(start, lefts, siblings), proof))
        out = rows[names].reset_index(drop=True)
        out["subroot"], out["root"] = above["subroot"], above["root"]
        out["proof_sha256"], out["folded_root"] = [f[0] for f in found], [f[1] for f in found]
        out["verified"] = out["folded_root"] == out["root"]
        if proofs:
            out["proof"] = [f[2] for f in found]
        return out

    outer = paths.withColumnRenamed("pos", "block")
    schema = f"{keep}, {RESULT}" + (", proof array<string>" if proofs else "")
    return blocks(nodes, height).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(finish, schema)


def manifest(docs: DataFrame, changes: dict[str, Column] | None = None, changed: Column | None = None, proofs: bool = False,
             height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of `docs`.

    Rows where `changed` holds are folded to the root from a leaf whose fields are
    replaced by `changes` (a later state of the data, say), the others from their own
    leaf; `verified` says whether that gives the root.  With `proofs` the column `proof`
    lists the siblings themselves.  Trees are per `lang`, ordered by `doc_id`.
    """
    ship_package(docs.sparkSession)
    fields = {c: F.col(f"`{c}`") for c in FIELDS}
    other = leaf([(changes or {}).get(c, fields[c]) for c in FIELDS])
    leaves = stash(docs.select(
        F.coalesce(F.concat(F.lit("="), fields["lang"]), F.lit("-")).alias("tree"),
        fields["doc_id"].cast("long").alias("doc_id"), leaf(list(fields.values())).alias("digest"),
        F.when(changed if changed is not None else F.lit(False), other).alias("changed")), "merkle-leaves")
    nodes = ranked(leaves, ["doc_id", "digest"])
    layers = climb(nodes, height)

    subroots = layers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", F.lit(None).cast("string").alias("changed"))
    subroots = ranked(subroots, ["name"])
    crown = climb(subroots, height)
    none = "cast(array() AS array<boolean>) AS lefts", "cast(array() AS array<string>) AS siblings"
    top = crown[-1].selectExpr("tree", "pos", "digest AS subroot", "digest AS root", *none)
    paths = descend(crown, top, height)
    trees = tree_paths(subroots, paths, height)
    found = proved(nodes, descend(layers, trees, height), height, "doc_id bigint, digest string", proofs)
    return found.withColumnRenamed("digest", "leaf")


def tree_paths(subroots: DataFrame, paths: DataFrame, height: int) -> DataFrame:
    """The path (PATH, at place 0) of each tree's subroot to the root."""
    def exchange(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        above = outer.iloc[0]
        tree = levels(rows["digest"].tolist(), height_of(int(rows["n"].iloc[0]), height))
        inner = [path_in(tree, i) for i in range(len(rows))]
        return pd.DataFrame({
            "tree": rows["name"].to_numpy(), "pos": 0, "subroot": rows["digest"].to_numpy(), "root": above["root"],
            "lefts": [[*lefts, *above["lefts"]] for lefts, _ in inner],
            "siblings": [[*siblings, *above["siblings"]] for _, siblings in inner]})

    outer = paths.withColumnRenamed("pos", "block")
    return stash(blocks(subroots, height).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(exchange, PATH), "merkle-trees")


def oracle() -> str:
    """DuckDB SQL of `op11_merkle_manifest`: the tree level by level, then each leaf's way up."""
    def enc(c: str) -> str:
        value = f"CAST({c} AS VARCHAR)"
        return f"coalesce(CAST(strlen({value}) AS VARCHAR) || ':' || {value}, '-')"

    def leaf_sql(**changes: str) -> str:
        return "sha256(" + " || ".join(enc(changes.get(c, c)) for c in FIELDS) + ")"

    crc = ("xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(id) + 1), lambda i: "
           "list_prepend(CAST(1000 + ascii(id[i]) AS BIGINT), list_transform(range(8), lambda r: CAST(0 AS BIGINT)))))), "
           "lambda crc, b: CASE WHEN b >= 1000 THEN xor(crc, b - 1000) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END), 4294967295)")
    return f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS tree, {leaf_sql()} AS leaf, {leaf_sql(n_chars="n_chars + 1")} AS altered,
         CAST(doc_id AS VARCHAR) AS id FROM documents),
leaves AS (
  SELECT doc_id, tree, leaf, CASE WHEN {crc} % 7 = 0 THEN altered ELSE leaf END AS start,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM rows),
nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS h, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2),
tops AS (
  SELECT tree, level, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
crown AS (
  SELECT 0 AS level, place AS pos, subroot AS h, n FROM tops
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM crown WHERE n > 1 GROUP BY level, pos // 2),
root AS (SELECT h AS root, level FROM crown WHERE n = 1),
walk AS (
  SELECT l.doc_id, l.tree, l.pos AS first, 0 AS step, l.pos, l.start AS h, '' AS proof FROM leaves l
  UNION ALL
  SELECT w.doc_id, w.tree, w.first, w.step + 1, w.at // 2,
         sha256(CASE WHEN w.sibling IS NULL THEN w.h WHEN w.at % 2 = 1 THEN w.sibling || w.h ELSE w.h || w.sibling END), w.proof || coalesce(w.sibling, '')
  FROM (SELECT w.doc_id, w.tree, w.first, w.step, w.h, w.proof,
               CASE WHEN w.step = t.level THEN t.place ELSE w.pos END AS at,
               CASE WHEN w.step < t.level THEN s.h ELSE c.h END AS sibling
        FROM walk w JOIN tops t ON w.tree = t.tree JOIN root r ON w.step < t.level + r.level
        LEFT JOIN nodes s ON s.tree = w.tree AND s.level = w.step AND s.pos = xor(w.pos, 1) AND w.step < t.level
        LEFT JOIN crown c ON c.level = w.step - t.level AND c.pos = xor(CASE WHEN w.step = t.level THEN t.place ELSE w.pos END, 1)) w)
SELECT w.doc_id, l.leaf, t.subroot, r.root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = r.root AS verified
FROM walk w JOIN tops t ON w.tree = t.tree CROSS JOIN root r JOIN leaves l ON l.tree = w.tree AND l.pos = w.first WHERE w.step = t.level + r.level"""
