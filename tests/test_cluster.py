import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftlab.functions.geo import ang2pix, auto_nside, geodetic_to_cartesian, pix2ang
from shiftlab.operators import cluster as cl
from shiftlab.operators import consensus as co
from shiftlab.operators import graph, stats
from shiftlab.operators.masks import sorted_labels


def test_dbscan(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (30, 2)) for c in (0, 3, 6)] + [rng.uniform(-3, 9, (20, 2))])
    eps, least = 0.5, 4
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, a double, b double")
    got = {r.id: r.cluster for r in cl.dbscan(df, ["a", "b"], eps, least).collect()}
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= least
    label = np.arange(len(x))
    for _ in x:
        label = np.array([min(label[j] for j in np.flatnonzero(near[i] & core)) if core[i] else label[i] for i in range(len(x))])
    for i in range(len(x)):
        if core[i]:
            assert all((got[i] == got[j]) == (label[i] == label[j]) for j in np.flatnonzero(core))
        else:
            own = np.flatnonzero(near[i] & core)
            assert got[i] == (got[own[0]] if len(own) else -1)


def test_hdbscan():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.3, (60, 3)), rng.normal(5, 0.3, (40, 3)), rng.uniform(-20, 20, (15, 3))])
    got = cl.HDBSCAN(min_cluster_size=10).fit_predict(x)
    assert len(set(got[:60]) - {-1}) == 1 and len(set(got[60:100]) - {-1}) == 1 and got[0] != got[60] and (got[100:] == -1).mean() > 0.7
    assert (cl.HDBSCAN(min_cluster_size=10).fit_predict(x[:5]) == -1).all()
    assert set(cl.HDBSCAN(min_cluster_size=5).fit_predict(np.zeros((30, 3)))) <= {-1, 0}
    a, b, w = cl.spanning_tree(x, cl.core_distances(x, iter([x]), 5))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    c = np.sort(d, axis=1)[:, 4]
    reach = np.maximum(np.maximum(c[:, None], c[None]), d)
    tree, inside = 0.0, {0}  # Prim on the full matrix
    while len(inside) < len(x):
        i, j = min(((i, j) for i in inside for j in range(len(x)) if j not in inside), key=lambda e: reach[e])
        tree += reach[i, j]
        inside.add(j)
    assert math.isclose(tree, w.sum(), rel_tol=1e-9)


def test_hdbscan_in_blocks(spark):
    """The tree and the labels from pairs of blocks are those of all points at once, also with equal points and distances."""
    rng = np.random.default_rng(4)
    for x in (
        np.concatenate([rng.normal(c, 0.4, (60, 3)) for c in (0, 3, 9)] + [rng.uniform(-15, 15, (30, 3))]),
        rng.integers(0, 5, (150, 3)).astype(float),
        np.concatenate([np.zeros((70, 2)), rng.normal(4, 0.1, (20, 2))]),
    ):
        axes = [f"c{i}" for i in range(x.shape[1])]
        df = spark.createDataFrame([(1000 * i, *map(float, p)) for i, p in enumerate(x)], "id long, " + ", ".join(f"{a} double" for a in axes))
        core = cl.core_distances(x, iter([x]), 5)
        want = sorted(zip(*(np.asarray(z).tolist() for z in cl.spanning_tree(x, core))))
        for block in (1000, 40, 15):
            got = sorted((r.a // 1000, r.b // 1000, r.w) for r in cl.mutual_tree(df, axes, 5, block).collect())
            assert got == want
        method = cl.HDBSCAN(min_cluster_size=5)
        labels = {r.id // 1000: r.cluster for r in cl.hdbscan(df, axes, method, 40).collect()}
        assert [labels[i] for i in range(len(x))] == method.fit_predict(x).tolist()
    assert {r.cluster for r in cl.hdbscan(df.limit(3), axes, method).collect()} == {-1}


def test_ward():
    assert stats.ward_consistency(np.zeros((1, 5))) == 0.0
    assert stats.ward_consistency(np.array([[1, 2, 3.0], [3, 1, 2]])) == 1.0
    rng = np.random.default_rng(2)
    s = rng.normal(size=(7, 20))
    r2 = np.corrcoef(s) ** 2
    groups, heights = [[i] for i in range(7)], []
    d = {(i, j): 1 - r2[i, j] for i in range(7) for j in range(i)}
    dist = lambda a, b: d[max(a, b), min(a, b)]
    names, size, nxt = list(range(7)), {i: 1 for i in range(7)}, 7
    while len(names) > 1:
        i, j = min(((a, b) for a in names for b in names if a < b), key=lambda e: dist(*e))
        h = dist(i, j)
        heights.append(h)
        for k in names:
            if k not in (i, j):
                t = size[i] + size[j] + size[k]
                d[nxt, k] = math.sqrt(((size[i] + size[k]) * dist(i, k) ** 2 + (size[j] + size[k]) * dist(j, k) ** 2 - size[k] * h * h) / t)
        size[nxt] = size[i] + size[j]
        names = [k for k in names if k not in (i, j)] + [nxt]
        nxt += 1
    want = 1 / ((heights[-1] - np.mean(heights)) / np.std(heights, ddof=1))
    assert math.isclose(stats.ward_consistency(s), want, rel_tol=1e-9)
    assert groups


def test_healpix(spark):
    for n in (1, 2, 4, 16):
        p = spark.range(12 * n * n)
        lat, lon = pix2ang(n, F.col("id"))
        assert p.select("id", lat.alias("a"), lon.alias("o")).where(ang2pix(n, F.col("a"), F.col("o")) != F.col("id")).count() == 0
    poles = spark.createDataFrame([(90.0, 0.0), (-90.0, 0.0), (0.0, 360.0), (0.0, -180.0)], "lat double, lon double")
    assert all(0 <= r.p < 192 for r in poles.select(ang2pix(4, F.col("lat"), F.col("lon")).alias("p")).collect())
    assert [auto_nside(k) for k in (12, 13, 400, 16200)] == [1, 2, 8, 64]
    with pytest.raises(ValueError):
        auto_nside(3)


def test_wgs84(spark):
    x = spark.createDataFrame([(0.0, 0.0), (90.0, 0.0), (0.0, 90.0)], "lat double, lon double").select(*[c.alias(n) for c, n in zip(geodetic_to_cartesian(F.col("lat"), F.col("lon")), "xyz")]).collect()
    assert np.allclose(x, [(6378.137, 0, 0), (0, 0, 6356.752), (0, 6378.137, 0)], atol=1e-6)


def test_components_and_edges(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20 != 19] + [(5, 5)], "src long, dst long")
    got = {r.node: r.component for r in graph.connected_components(e).collect()}
    assert got == {i: i // 20 * 20 for i in range(60)}
    assert graph.connected_components(e.limit(0)).count() == 0
    cells = spark.range(12).select(F.col("id").alias("cell_id"), F.floor(F.col("id") / 4).cast("int").alias("y_idx"), (F.col("id") % 4).cast("int").alias("x_idx"))
    assert graph.grid_edges(cells, 4).count() == 17 and graph.grid_edges(cells, 8).count() == 29


def test_knn(spark):
    rng = np.random.default_rng(5)
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, 300))), rng.uniform(-180, 180, 300)
    df = spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate(zip(lat, lon))], "node long, lat double, lon double")
    p, q = np.radians(lat), np.radians(lon)
    u = np.stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)], axis=1)
    d = ((u[:, None] - u[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, 9)
    want = {(i, int(j)) for i in range(300) for j in np.argsort(d[i])[:5] if i < j}
    for block in (2000, 10):
        assert {(r.src, r.dst) for r in graph.knn_edges(df, 5, block).collect()} == want


def labels(spark, rows):
    return spark.createDataFrame(rows, "cell_id long, t_idx int, cluster int")


def test_relabel_and_consensus(spark):
    lab = labels(spark, [(0, 0, 9), (1, 0, 9), (2, 0, 5), (3, 0, 7), (4, 0, 5), (8, 0, -1)])
    got = {r.cell_id: r.cluster for r in sorted_labels(lab).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 4: 1, 3: 2, 8: -1}
    cells = spark.range(9).select(F.col("id").alias("cell_id"), F.floor(F.col("id") / 3).cast("int").alias("y_idx"), (F.col("id") % 3).cast("int").alias("x_idx"))
    same = co.consensus({"a": lab, "b": lab}, cells, "native", 1.0)
    got = {r.cell_id: (r.cluster, r.consistency) for r in same.collect()}
    assert got[0] == got[1] == (0, 1.0) or got[2][0] == 0
    assert got[8] == (-1, 0.0) and got[3] == (-1, 0.0) and got[2] == got[4]
    none = labels(spark, [(0, 0, -1)])
    assert {(r.cluster, r.consistency) for r in co.consensus({"a": none}, cells, "native").collect()} == {(-1, 0.0)}
