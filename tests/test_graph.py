"""Similarity graphs, their Laplacian spectrum and spectral clustering against dense numpy versions."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from synthframe.operators import graph as graphs
from synthframe.operators import spectral
from synthframe.session import small_batches

DATA = "/root/testdata/sf0.01"


def table(spark, x):
    names = [f"c{i}" for i in range(x.shape[1])]
    rows = [(i, *[float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names)).repartition(3), names


def dense(x, gamma, floor):
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    w = np.where(d2 <= graphs.radius_of(floor, gamma) ** 2, np.exp(-gamma * d2), 0.0)
    np.fill_diagonal(w, 0)
    return w, np.diag(w.sum(1)) - w


def dense_k(laplacian):
    """The rule on the whole spectrum of a dense matrix."""
    values = np.linalg.eigvalsh(laplacian)[::-1]
    values = np.maximum(values, 0) + graphs.RIDGE
    k = int(np.argmin(np.diff(values) / values[:-1])) + 1
    return len(values) - k + 1 if k > 0.9 * len(values) else k


@pytest.fixture(scope="module")
def crowd():
    """Points with copies, a far outlier and several densities."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(150, 3)) * 0.4, rng.normal(size=(60, 3)) + 1, np.repeat(rng.normal(size=(3, 3)), 5, axis=0), [[30.0, 0, 0]]])
    return x


@pytest.mark.parametrize("floor", [1e-3, 1e-8, 0.3])
def test_edges_are_all_pairs_within_the_radius(spark, crowd, floor):
    x = np.unique(crowd, axis=0)
    df, names = table(spark, x)
    nodes = graphs.points(df, names).withColumnRenamed("id", "vertex")
    got = {(r["src"], r["dst"]): r["weight"] for r in graphs.neighbour_edges(nodes, "vertex", 3, floor).collect()}
    w, _ = dense(x, graphs.GAMMA, floor)
    want = {(i, j): w[i, j] for i, j in zip(*np.nonzero(w), strict=True)}
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-12 for e in want)


def test_crowded_cells_are_cut_without_losing_a_pair(spark, crowd, monkeypatch):
    monkeypatch.setattr(graphs, "CELL_ROWS", 7)
    x = np.unique(crowd, axis=0)
    df, names = table(spark, x)
    got = graphs.neighbour_edges(graphs.points(df, names).withColumnRenamed("id", "vertex"), "vertex", 3, 1e-3).count()
    assert got == np.count_nonzero(dense(x, graphs.GAMMA, 1e-3)[0])


def test_edges_of_embeddings_have_full_recall(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in rows], dtype=float)
    nodes = spark.createDataFrame([(r["vec_id"], [float(v) for v in r["embedding"]]) for r in rows], "vertex long, x array<double>")
    got = {(r["src"], r["dst"]) for r in graphs.neighbour_edges(nodes, "vertex", 64, 1e-4).collect()}
    order = {r["vec_id"]: i for i, r in enumerate(rows)}
    w, _ = dense(x, graphs.GAMMA, 1e-4)
    assert {(order[a], order[b]) for a, b in got} == set(zip(*(v.tolist() for v in np.nonzero(w)), strict=True))


def test_degrees_count_copies_and_missing_coordinates(spark, crowd):
    df, names = table(spark, crowd)
    odd = df.unionByName(df.limit(1).withColumn("c1", F.lit(None).cast("double")).withColumn("id", F.lit(9999).cast("long")))
    graph = graphs.build(odd, names)
    got = {r["id"]: r["degree"] for r in graphs.row_degrees(odd, graph).collect()}
    w, _ = dense(crowd, graphs.GAMMA, graphs.FLOOR)
    assert got.pop(9999) is None and graph.step == 0
    np.testing.assert_allclose([got[i] for i in range(len(crowd))], w.sum(1), rtol=1e-9, atol=1e-12)


def test_components_of_long_paths(spark):
    n = 200
    links = [(i, i + 1) for i in range(0, n) if i not in (60, 61, 150)]
    edges = spark.createDataFrame(links + [(b, a) for a, b in links], "src long, dst long")
    got = {r["vertex"]: r["component"] for r in graphs.components(spark.range(n + 1).withColumnRenamed("id", "vertex"), edges).collect()}
    assert got == {i: 0 if i <= 60 else 61 if i == 61 else 62 if i <= 150 else 151 for i in range(n + 1)}


@pytest.mark.parametrize("whole", [0, 1_500])
def test_eigenpairs_match_numpy(spark, whole):
    """500 rows with copies: eigenvalues, and vectors up to sign, of the dense Laplacian over the rows."""
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(440, 2)) * [1.5, 0.7], np.repeat(rng.normal(size=(30, 2)), 2, axis=0)])
    df, names = table(spark, x)
    graph = graphs.build(df, names, gamma=0.8, floor=1e-4)
    _, laplacian = dense(x, 0.8, 1e-4)
    values, vectors = np.linalg.eigh(laplacian)
    zeros = int((values < 1e-9).sum())
    found = graphs.smallest_eigenpairs(graph, 4, tolerance=1e-9, whole=whole)
    assert found.zeros == zeros and found.rows == 500
    np.testing.assert_allclose(found.values[:4], values[zeros:zeros + 4], rtol=1e-7, atol=1e-10)
    graph._spectrum = found
    marks = zeros if zeros > 1 else 0
    made = spectral.spectral_embedding(df, graph, marks + 4).orderBy("id").toPandas()
    got = made[[f"spectral_{i}" for i in range(marks + 1, marks + 5)]].to_numpy()
    np.testing.assert_allclose(np.abs((got * vectors[:, zeros:zeros + 4]).sum(0)), 1, atol=1e-6)


@pytest.mark.parametrize("groups,whole", [(1, 1_500), (3, 0), (14, 1_500)])
def test_eigen_gap_has_no_ceiling(spark, groups, whole):
    rng = np.random.default_rng(groups)
    centres = np.array([[i % 4, i // 4] for i in range(groups)]) * 6.0
    x = np.concatenate([c + 0.3 * rng.normal(size=(25, 2)) for c in centres])
    df, names = table(spark, x)
    graph = graphs.build(df, names)
    k, certain = graphs.eigen_gap(graph, whole=whole)
    assert certain and k == dense_k(dense(x, graphs.GAMMA, graphs.FLOOR)[1])
    assert groups < 14 or k > 10


def test_rings_and_blobs_are_separated(spark):
    rng = np.random.default_rng(1)
    turn = rng.uniform(0, 2 * np.pi, 600)
    ring = np.where(np.arange(600) % 2 == 0, 1.0, 3.0) + 0.1 * rng.uniform(size=600)
    df, names = table(spark, np.stack([ring * np.cos(turn), ring * np.sin(turn)], axis=1))
    labelled, _ = spectral.spectral_labels(df, names, 2)
    assert labelled.groupBy(F.col("id") % 2, "cluster").count().count() == 2
    blobs = np.concatenate([c + rng.uniform(-0.5, 0.5, size=(70, 2)) for c in np.array([[0, 0], [0, 3], [3, 0], [3, 3]])])
    df, names = table(spark, blobs)
    labelled, _ = spectral.spectral_labels(df, names, 4, gamma=1.0, floor=1e-4)
    found = labelled.groupBy((F.col("id") / 70).cast("int").alias("blob"), "cluster").count().collect()
    assert len(found) == 4


def test_many_rows_merge_into_bounded_vertices(spark):
    df = spark.range(20_000).select(*[F.randn(s).alias(f"c{s}") for s in range(2)])
    graph = graphs.build(df, ["c0", "c1"], most=500)
    assert graph.step > 0 and graph.nodes.count() <= 550
    assert graph.nodes.agg(F.sum("weight")).first()[0] == 20_000


def test_a_graph_keeps_all_distinct_rows(spark):
    """Beyond 1,500 distinct rows the grid of the embeddings merged those with equal signs; only equal rows are one vertex now."""
    x = 0.2 * np.abs(np.random.default_rng(9).normal(size=(1_600, 24)))
    df, names = table(spark, x)
    graph = graphs.build(df.unionByName(df.filter("id < 3")), names)
    assert graph.step == 0 and graph.nodes.count() == 1_600
    got = {r["id"]: r["degree"] for r in graphs.row_degrees(df, graph).collect()}
    w = dense(x, graphs.GAMMA, graphs.FLOOR)[0]
    want = w.sum(1) + w[:, :3].sum(1)
    want[:3] += 1
    np.testing.assert_allclose([got[i] for i in range(len(x))], want, rtol=1e-9, atol=1e-12)


def test_blocks_settle_pairs_at_the_radius_and_far_from_the_origin(spark, monkeypatch):
    """Distances whose rounding matters are taken by differences: a lattice with pairs exactly at the radius, moved far away."""
    monkeypatch.setattr(graphs, "CELL_ROWS", 10)
    x = np.array([[i, j, k] for i in range(4) for j in range(4) for k in range(3)], dtype=float) + 1e7
    x[0] += 1e9
    nodes = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(100, [None, 1.0, 1.0]), (None, x[1].tolist()), (101, None)], "vertex long, x array<double>")
    got = {(r["a"], r["b"]): r["d2"] for r in graphs.neighbour_pairs(nodes, "vertex", 3, 1.0).collect()}
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = {(i, j) for i, j in zip(*(v.tolist() for v in np.nonzero(np.triu(d2 <= 1.0, 1))), strict=True)}
    assert got.keys() == want and set(got.values()) == {1.0}


def test_sums_and_links_of_blocks_equal_those_of_all_pairs(spark, crowd, monkeypatch):
    """The graph stores no edges: kernel sums and components come from blocks that meet."""
    monkeypatch.setattr(graphs, "CELL_ROWS", 20)
    x = np.unique(crowd, axis=0)
    df, names = table(spark, x)
    nodes = graphs.points(df, names).withColumnRenamed("id", "vertex")
    blocks = graphs.near_blocks(nodes, "vertex", 3, graphs.radius_of(0.3))
    assert blocks.count > 5
    w, _ = dense(x, graphs.GAMMA, 0.3)
    q = np.random.default_rng(2).normal(size=(len(x), 4))
    values = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q) if i % 5], "id long, q array<double>")
    got = {r["id"]: r["pull"] for r in graphs.neighbours.sums(blocks, values, 4, graphs.GAMMA).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(x))], w @ np.where(np.arange(len(x))[:, None] % 5 == 0, 0.0, q), atol=1e-12)
    links = graphs.neighbours.links(blocks)
    made = {r["vertex"]: r["component"] for r in graphs.components(nodes, links).collect()}
    want = np.arange(len(x))
    while (low := np.minimum(want, np.where(w > 0, want[None], len(x)).min(axis=1))).tolist() != want.tolist():
        want = low
    assert [made[i] for i in range(len(x))] == want.tolist()


def test_rows_find_their_vertex_by_shuffle(spark, crowd, monkeypatch):
    monkeypatch.setattr(graphs.lookup_join, "__defaults__", (10, 3))
    df, names = table(spark, crowd - 1.0)
    graph = graphs.build(df, names)
    got = {r["id"]: r["degree"] for r in graphs.row_degrees(df, graph).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(crowd))], dense(crowd, graphs.GAMMA, graphs.FLOOR)[0].sum(1), rtol=1e-9, atol=1e-12)


def test_blocks_grow_with_the_table_and_hold_single_precision(spark):
    """80,000 vectors were 14 blocks and are 12, so each is sent 12 times at most; coordinates of single precision take four bytes."""
    nodes = spark.range(80_000).select(F.col("id").alias("vertex"), F.array(*[F.rand(s).cast("float").cast("double") for s in range(4)]).alias("x"))
    blocks = graphs.near_blocks(nodes, "vertex", 4, 0.5)
    sent = blocks.sides.groupBy("block", "piece").count().agg(F.max("count")).first()[0]
    assert blocks.count == 12 and sent <= 12
    assert blocks.rows.agg(F.sum(F.length("x")), F.sum(F.size("ids")), F.max(F.size("ids"))).first()[:] == (80_000 * 16, 80_000, graphs.neighbours.PIECE)


def test_pieces_of_blocks_meet_once(spark, crowd, monkeypatch):
    """Blocks of several pieces: edges, kernel sums and components are those of all pairs, whatever the precision of the coordinates."""
    monkeypatch.setattr(graphs, "CELL_ROWS", 50)
    monkeypatch.setattr(graphs.neighbours, "PIECE", 8)
    for x in (np.unique(crowd, axis=0), np.unique(crowd.astype(np.float32).astype(float), axis=0)):
        df, names = table(spark, x)
        nodes = graphs.points(df, names).withColumnRenamed("id", "vertex")
        blocks = graphs.near_blocks(nodes, "vertex", 3, graphs.radius_of(0.3))
        assert blocks.rows.groupBy("block").count().filter("count > 2").count() > 2
        w, _ = dense(x, graphs.GAMMA, 0.3)
        edges = [(r["src"], r["dst"], r["weight"]) for r in graphs.neighbour_edges(nodes, "vertex", 3, 0.3).collect()]
        assert len(edges) == np.count_nonzero(w) and all(abs(w[a, b] - v) < 1e-12 for a, b, v in edges)
        q = np.random.default_rng(5).normal(size=(len(x), 2))
        values = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "id long, q array<double>")
        pull = {r["id"]: r["pull"] for r in graphs.neighbours.sums(blocks, values, 2, graphs.GAMMA).collect()}
        assert len(pull) == len(x)
        np.testing.assert_allclose([pull[i] for i in range(len(x))], w @ q, atol=1e-12)
        made = {r["vertex"]: r["component"] for r in graphs.components(nodes, graphs.neighbours.links(blocks)).collect()}
        want = np.arange(len(x))
        while (low := np.minimum(want, np.where(w > 0, want[None], len(x)).min(axis=1))).tolist() != want.tolist():
            want = low
        assert [made[i] for i in range(len(x))] == want.tolist()


def test_edges_list_both_orders_near_each_other(spark, crowd):
    """Equal distances stand within a few KB, where the compression of a file finds them."""
    x = np.random.default_rng(3).normal(size=(400, 2))
    df, names = table(spark, x)
    nodes = graphs.points(df, names).withColumnRenamed("id", "vertex")
    rows = [(r["src"], r["dst"]) for r in graphs.neighbour_edges(nodes, "vertex", 2).collect()]
    place = {e: i for i, e in enumerate(rows)}
    assert len(rows) > 10_000 and max(abs(i - place[b, a]) for (a, b), i in place.items()) < 256


def test_eigen_gap_looks_beyond_32_eigenvalues(spark):
    """A chain of 40 points and 20 points close together: the drop stands above 41 eigenvalues, whichever way the graph is solved."""
    near = math.sqrt(-math.log(0.05) / graphs.GAMMA)
    x = np.array([[i * near] for i in range(40)] + [[100 + 1e-3 * i] for i in range(20)])
    df, names = table(spark, x)
    graph = graphs.build(df, names)
    want = dense_k(dense(x, graphs.GAMMA, graphs.FLOOR)[1])
    assert graphs.eigen_gap(graph) == graphs.eigen_gap(graph, whole=0) == (want, True) and want > 2


def test_degrees_show_where_no_larger_drop_can_be(spark, crowd):
    """What is called impossible is so in the dense spectrum, and a spectrum without gaps is seen as such."""
    rng = np.random.default_rng(8)
    for x, sure in ((np.unique(crowd, axis=0), False), (rng.normal(size=(700, 2)) * 0.5, True)):
        df, names = table(spark, x)
        graph = graphs.build(df, names)
        values = np.linalg.eigvalsh(dense(x, graphs.GAMMA, graphs.FLOOR)[1])
        seen = []
        for known in values[[len(x) // 3, len(x) // 2, 2 * len(x) // 3]]:
            above = values[values >= known] + graphs.RIDGE
            largest = (1 - above[:-1] / above[1:]).max()
            for best in (0.2, 0.5, 0.9):
                said = graphs.no_larger_drop(graph, float(known), best, 2 * float(values[-1]))
                assert not said or largest < best
                seen.append(said)
        assert any(seen) or not sure


def test_wide_rows_reach_python_in_small_batches(spark):
    """64 MB batches of 4 KB rows were most of an executor's memory outside its heap; the session's own setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    wide = spark.range(20_000, numPartitions=1).select(F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: i + F.col("id") * 1.0).alias("x"))

    def largest():
        return wide.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n bigint").agg(F.max("n")).first()[0]

    with small_batches(spark):
        assert spark.conf.get(key) != before and largest() < 6e6
    assert spark.conf.get(key) == before and largest() > 3e7


def test_solver_and_build_run_in_small_batches(spark, monkeypatch):
    """The setting holds in each job of the graph that sends vectors or wide rows, and is gone afterwards."""
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", set()
    before = spark.conf.get(key)
    sums, gram = graphs.neighbours.sums, graphs._gram
    monkeypatch.setattr(graphs.neighbours, "sums", lambda *a: (seen.add(("sums", spark.conf.get(key))), sums(*a))[1])
    monkeypatch.setattr(graphs, "_gram", lambda *a: (seen.add(("gram", spark.conf.get(key))), gram(*a))[1])
    df, names = table(spark, np.random.default_rng(2).normal(size=(60, 2)))
    graph = graphs.build(df, names)
    found = graphs.smallest_eigenpairs(graph, 2, max_steps=2, whole=0)
    assert seen == {("sums", "4m"), ("gram", "4m")} and spark.conf.get(key) == before and found.vectors.count() > 0
