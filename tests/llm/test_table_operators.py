"""Manifest, vector near-dedup and whitening against plain versions, and their behaviour on odd rows."""

import math
import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthframe.llm import merkle, vector_dedup, whitening

DATA = "/root/testdata/sf0.001"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, **changes):
    values = [changes.get(c, row[c]) for c in merkle.FIELDS]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded_root, verified) of every row, tree by tree."""
    trees = {}
    for row in rows:
        trees.setdefault(row["lang"], []).append(row)
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {}
    for t in names:
        trees[t].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        built[t] = plain_levels([plain_leaf(r) for r in trees[t]])
    crown = plain_levels([built[t][-1][0] for t in names])
    root = crown[-1][0] if names else None
    out = []
    for place, t in enumerate(names):
        for at, row in enumerate(trees[t]):
            hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0 and row["n_chars"] is not None
            node = plain_leaf(row, n_chars=row["n_chars"] + 1) if hit else plain_leaf(row)
            proof = []
            for levels, start in ((built[t], at), (crown, place)):
                for depth, nodes in enumerate(levels[:-1]):
                    i = start >> depth
                    pair = nodes[i - i % 2:i - i % 2 + 2]
                    proof += [x for j, x in enumerate(pair) if j != i % 2]
                    pair[i % 2] = node
                    node = digest(*pair)
            out.append((row["doc_id"], plain_leaf(row), built[t][-1][0], root, digest(*proof), node, node == root))
    return out


def keyed(rows):
    return sorted(rows, key=str)


def tampered(docs, height=merkle.HEIGHT, proofs=False):
    return merkle.manifest(docs, {"n_chars": F.col("n_chars") + 1}, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, proofs, height)


FIELDS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, tree string, pos int, n int, block int"


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Null fields, empty and long texts, a null and a lone group, ties, repeated rows, clashing names."""
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", "é\nx", "a" * 300_000, f"text {i}"]), rng.choice([None, "", "en", "en", "en", "é", "z"]),
             rng.choice([None, "s"]), rng.choice([None, i]), "d", "t", 1, 2, 3) for i in range(90)]
    rows += [rows[7], rows[7], (7, "other", "en", "s", 7, "d", "t", 1, 2, 3), (None, "x", "en", None, None, None, None, None, None, None),
             (500, "lone", "only", "s", 4, "d", "t", 1, 2, 3)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.mark.parametrize("height", [1, 3, 10])
def test_manifest_matches_plain_trees_of_any_superblock(odd_docs, height):
    want = plain_manifest([r.asDict() for r in odd_docs.collect()])
    got = [tuple(r[c] for c in FIELDS) for r in tampered(odd_docs, height).collect()]
    assert keyed(got) == keyed(want)
    assert {r[-1] for r in want} == {True, False}


def test_manifest_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = plain_manifest([r.asDict() for r in docs.collect()])
    got = tampered(docs, 4, proofs=True).collect()
    assert keyed(tuple(r[c] for c in FIELDS) for r in got) == keyed(want)
    assert all(digest(*r["proof"]) == r["proof_sha256"] for r in got)


def test_manifest_of_one_row_and_none(spark):
    one = spark.createDataFrame([(3, "t", None, "s", 1) + (None,) * 5], DOCS)
    (row,) = merkle.manifest(one).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof_sha256"] == digest()
    assert merkle.manifest(one.limit(0)).collect() == []


def plain_links(rows, cosine=0.98):
    """(vec_id, n_links, component_id, kept), all pairs compared."""
    def sound(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    units = [np.array(v, float) / np.abs(np.array(v, float)).max() if t is not None and sound(v) else None for _, v, t in rows]
    units = [None if u is None else u / np.linalg.norm(u) for u in units]
    root, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine:
                links[i] += 1
                links[j] += 1
                root = [root[i] if r == root[j] else r for r in root]
    out = []
    for i, (vec, _, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if root[k] == root[i] and rows[k][0] is not None]
        component = min(ids) if ids else None
        out.append((vec, links[i], component, vec == component))
    return out


def as_rows(frame):
    return [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in frame.collect()]


VECTORS = "vec_id long, embedding array<double>, label int, node string, w int, cell int, root string"


@pytest.fixture(scope="module")
def vectors(spark):
    """Groups with cosines around the threshold, chains, copies, scaled and odd vectors, clashing names."""
    rng = np.random.default_rng(8)
    rows = []
    for dims, groups in ((64, 6), (5, 3), (1, 1)):
        for _ in range(groups):
            base, label = rng.normal(size=dims), int(rng.integers(3))
            for size in rng.choice([0.0, 0.08, 0.11, 0.14, 0.16, 0.3], size=18):
                rows.append((base + size * rng.normal(size=dims), label))
    rows += [(rng.normal(size=64), int(rng.integers(3))) for _ in range(60)]
    rows += [(rows[0][0] * 1e200, rows[0][1]), (rows[0][0] * 1e-300, rows[0][1]), (-rows[0][0], rows[0][1]), (np.zeros(64), 1), (rows[3][0], None), (rows[3][0], rows[3][1])]
    rows = [(i, [float(x) for x in v], t) for i, (v, t) in enumerate(rows)]
    order = rng.permutation(len(rows))
    rows = [(int(order[i]), v, t) for i, v, t in rows]
    rows += [(900, None, 1), (901, [], 1), (902, [1.0, None], 1), (903, [1.0, math.nan], 1), (904, [math.inf, 1.0], 1), (None, rows[5][1], rows[5][2]), rows[9], rows[9]]
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, 2, "r") for r in rows], VECTORS).repartition(4)


@pytest.mark.parametrize("blocks,grid,tile", [(4, 3, 32_768), (4, 3, 6), (8, 2, 20), (1, 4, 9), (3, 1, 2)])
def test_vector_links_are_exact(spark, vectors, blocks, grid, tile):
    want = plain_links(vectors)
    got = as_rows(vector_dedup.deduplicate(frame_of(spark, vectors), blocks=blocks, grid=grid, tile=tile))
    assert keyed(got) == keyed(want)
    assert sum(w[1] for w in want) > 500


def test_vectors_of_another_threshold_and_an_empty_table(spark, vectors):
    assert keyed(as_rows(vector_dedup.deduplicate(frame_of(spark, vectors), 0.9))) == keyed(plain_links(vectors, 0.9))
    assert as_rows(vector_dedup.deduplicate(frame_of(spark, vectors).limit(0))) == []


def test_a_crowd_leaves_its_cell_as_one_row_a_vector(spark):
    """Near copies in one cell: rows that leave the comparison grow with the vectors, not with the pairs."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=64)
    rows = [(i, [float(x) for x in base + 0.05 * rng.normal(size=64)], 1) for i in range(600)]
    nodes = vector_dedup.members(frame_of(spark, rows)).select("node", "label", "body").withColumn("w", F.lit(1).cast("long"))
    dealt = vector_dedup.tiles(nodes, 0.98, 4, 3, vector_dedup.TILE)
    found = vector_dedup.counted(dealt, 0.98, 4)
    assert dealt.count() <= 600 * 4 * 14 and found.count() <= 600 * 4 * 8
    assert found.agg(F.sum("links")).first()[0] == 600 * 599


def plain_whitening(vectors, by_copies=False, most=16):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors])
    fitted = x if by_copies else np.unique(x, axis=0)
    n, s = len(fitted), fitted.sum(axis=0)
    centred = fitted - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return n, deviation, (x - s / n) @ axes / np.sqrt(values), values / (centred ** 2).sum(axis=1).mean()


@pytest.mark.parametrize("by_copies", [False, True])
def test_whitening_matches_numpy(spark, by_copies):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 20)) * np.linspace(1, 3, 20) + 5
    rows = np.concatenate([base, base[:3], np.repeat(base[:1], 200, axis=0)])
    odd = [(900, None, 1), (901, [], 1), (902, [None] * 20, 1), (903, [math.nan] * 20, 1), (904, [math.inf] * 20, 1), (905, [1.0] * 7, 1)]
    found = whitening.whiten(frame_of(spark, [*[(i, [float(x) for x in v], 1) for i, v in enumerate(rows)], *odd]), by_copies=by_copies)
    got = sorted(found.collect(), key=lambda r: r["vec_id"])
    n, deviation, want, explained = plain_whitening(rows, by_copies)
    assert [r["vec_id"] for r in got] == list(range(len(rows))) and {r["n"] for r in got} == {n}
    assert [r["deviation"] for r in got] == deviation
    z = np.array([r["whitened"] for r in got])
    signs = np.sign((z * want).sum(axis=0))
    assert np.allclose(z * signs, want, atol=1e-9) and np.allclose(got[0]["explained"], explained, rtol=1e-9)
    assert got[0]["identity_error"] < 1e-9


def test_whitening_by_component_and_odd_tables(spark):
    rows = [(1, [0.0, 1.0, 7.0], 1), (2, [2.0, 1.0, 7.0], None), (None, [2.0, 1.0, 7.0], 1), (2, [2.0, 1.0, 7.0], None), (4, [5e300, 1.0, 7.0], 1)]
    long = whitening.by_component(whitening.whiten(frame_of(spark, rows[:4]))).collect()
    assert {(r["component"], r["n"], r["deviation"]) for r in long} == {(1, 2, 128 ** 2)} and len(long) == 4  # two flat directions are left out
    assert sorted(round(r["whitened"], 9) for r in long) in ([-1, 1, 1, 1], [-1, -1, -1, 1])
    huge = whitening.whiten(frame_of(spark, rows)).collect()
    assert len(huge) == 5 and {r["deviation"] for r in huge} == {None}
    for few in (rows[:1], [], rows[1:4]):
        assert whitening.by_component(whitening.whiten(frame_of(spark, few))).collect() == []
