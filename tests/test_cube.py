import datetime
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from shiftlab.checkpoints import checkpoint_dir
from shiftlab.cube import ShiftCube
from shiftlab.operators import masks, series
from shiftlab.operators.cluster import DBSCAN, HDBSCAN, SparkML
from shiftlab.operators.detect import MeanDifference, polyfit
from shiftlab.operators.optimize import OBJECTIVES, guided, sample_params
from shiftlab.sources import synth
from shiftlab.streaming.monitor import detect_batches, running_cells


@pytest.fixture(scope="module")
def cube(spark):
    df = synth.global_dataset(spark, 10, 20, 60, n_shifts=0, random_seed=3)
    axis = np.linspace(0, 100, 60)
    df = synth.add_shift_blob(df, axis, (20, -75), (25, 30), 30, 1.0)
    df = synth.add_shift_blob(df, axis, (-40, 100), (15, 30), 15, -1.0, number=2).select("lat", "lon", "t", "value")
    c = ShiftCube.from_dataframe(df.persist(), "t", values=["value"])
    for table in (c.grid, c.cells, c.times):
        table.persist()
    return c


@pytest.fixture(scope="module")
def done(cube):
    c = cube.compute_shifts("value")
    c.tables["value_dts"].persist()
    c = c.compute_clusters("value", HDBSCAN(min_cluster_size=4), output_label_suffix="_h")
    c = c.compute_clusters("value_dts", DBSCAN(4000.0, 3), shift_selection="all", output_label_suffix="_d")
    for name in c.cluster_vars:  # many tests read them
        c.tables[name].persist()
    return c


def test_dimensions(cube):
    assert (cube.ny, cube.nx, cube.n_t, cube.grid_kind) == (10, 20, 60, "latlon")
    assert cube.base_vars == ["value"] and cube.space_dims == ("lat", "lon") and cube.grid.count() == 12000


def test_stages(done):
    assert done.shift_vars == ["value_dts"] and done.cluster_vars == ["value_dts_cluster_h", "value_dts_cluster_d"]
    assert done.get_clusters("value_dts_cluster_h").where("cluster >= 0").count() > 0
    with pytest.raises(ValueError):
        done.get_clusters("value")
    assert done.compute_shifts("value", MeanDifference(5)).shift_vars == ["value_dts", "value_dts_1"]
    assert done.drop_shifts().cluster_vars == [] and done.drop_clusters("value_dts_cluster_h").cluster_vars == ["value_dts_cluster_d"]
    assert "value_dts_cluster_d" in done._repr_html_()


def test_methods(done):
    v = "value_dts_cluster_d"
    n = done.get_cluster_counts(v).collect()
    assert sum(r.n for r in n) == done.n_cells * done.n_t
    assert done.get_cluster_density_temporal(v, 0).count() == done.n_cells
    assert done.get_cluster_density_spatial(v).count() == done.n_t
    assert done.get_cluster_mask_permanent_noise(v).count() + done.get_clusters(v).where("cluster >= 0").select("cell_id").distinct().count() == done.n_cells
    assert done.get_cluster_timeseries("value", 0, v, "mean").count() == done.n_t
    s = done.stats(v)
    k = done.get_clusters(v).where("cluster >= 0").select("cluster").distinct().count()
    for df in (s.space(), s.score_consistency(), s.score_nonlinearity()):
        assert df.count() == k
    assert done.aggregate.cluster_occurrence_rate().count() == done.n_cells
    found, summary = done.aggregate.cluster_consensus(min_consensus=0.5)
    assert found.count() == done.n_cells and summary.count() == found.where("cluster >= 0").select("cluster").distinct().count()
    assert done.plot_data.time_of_max_shift("value").count() > 0
    assert done.preprocess.preprocess_variable("value", lambda c: c > 1e9, 0.0).grid.agg(F.max("value")).first()[0] == 0


def test_optimise(done):
    c = done.compute_clusters("value_dts", DBSCAN(4000.0, 3), optimize=True, optimize_params={"min_samples": (2, 4), "shift_threshold": 0.4}, objective="median_heaviside", n_trials=2, output_label="best")
    about = c.catalog["best"]
    assert about["optimization"] and about["shift_threshold"] == 0.4 and 2 <= about["opt_best_params"]["min_samples"] <= 4


def test_search_is_guided():
    """Trials gather where earlier ones scored well; the kind of a range is that of its low end."""
    rng, past = random.Random(0), []
    params = {"a": (0.0, 10), "b": (1, 9.5), "c": "x"}
    for i in range(60):
        drawn = sample_params(params, rng, guided(past, rng) if i >= 10 else None)
        assert isinstance(drawn["a"], float) and 0 <= drawn["a"] <= 10 and drawn["b"] in range(1, 10) and drawn["c"] == "x"
        past.append((-((drawn["a"] - 7) ** 2) - (drawn["b"] - 3) ** 2, drawn))
    late = past[30:]
    assert np.mean([abs(d["a"] - 7) for _, d in late]) < 1.5 and np.mean([abs(d["b"] - 3) for _, d in late]) < 1.5
    assert sample_params({"n": (3, 3)}, rng) == {"n": 3}


def plain_heaviside(v, t):
    fit = np.polyval(np.polyfit(t, v, 1), t)
    full = ((v - np.median(v)) ** 2).sum()
    return ((v - fit) ** 2).sum() / full if full > 0 else 0.0


def test_objectives_against_plain_numbers(done):
    """`median_heaviside` looks at median series, and at the shifts' own variable."""
    wide = done.grid.withColumn("other", F.lit(1.0))
    two = replace(done, grid=wide, catalog={"other": {"variable_type": "base"}, **done.catalog, "trial": done.catalog["value_dts_cluster_d"]}, tables={**done.tables, "trial": done.tables["value_dts_cluster_d"]})
    labels = two.tables["trial"]
    g = done.grid.toPandas().pivot(index="t_idx", columns="cell_id", values="value")
    t = np.array(done.axis)
    lab = labels.where("cluster >= 0").toPandas()
    cells = {k: sorted(set(x.cell_id)) for k, x in lab.groupby("cluster") if k in sorted(set(lab.cluster))[:10]}
    for name, inner, outer in (("median_heaviside", np.median, np.median), ("mean_heaviside", np.mean, np.mean)):
        want = outer([plain_heaviside(inner(g[c].to_numpy(), axis=1), t) for c in cells.values()])
        assert OBJECTIVES[name](two, labels) == pytest.approx(want, rel=1e-6)


def test_scores_by_function_and_keywords(done):
    s = done.stats("value_dts_cluster_d")
    own = {r.cluster: r.score for r in s.score_heaviside(how="median").collect()}
    assert s.aggregate_cluster_scores("score_heaviside", lambda x: max(x) + len(x), how="median").first()[0] == pytest.approx(max(own.values()) + len(own))
    assert s.aggregate_cluster_scores("score_heaviside", "nothing").first()[0] == 0
    plain = {r.cluster: r for r in s.score_overview(aggregation="median").collect()}
    assert {k: r.score_heaviside for k, r in plain.items()} == pytest.approx(own)
    noise = {r.cluster: r for r in s.score_overview(exclude_noise=False, aggregation="median").collect()}
    clustered = done.get_clusters("value_dts_cluster_d").where("cluster >= 0").count()
    assert noise.keys() == plain.keys() | {-1} and noise[-1].size == done.n_cells * done.n_t - clustered
    assert all(noise[k].size == plain[k].size and noise[k].score_heaviside == pytest.approx(plain[k].score_heaviside) for k in plain)


def test_stages_are_computed_once(spark, done):
    """Reading labels again doesn't run the clusterer again."""
    runs = spark.sparkContext.accumulator(0)

    class Counted:
        def fit_predict(self, X, y=None):  # noqa: N803
            runs.add(1)
            return np.zeros(len(X), int)

    c = done.compute_clusters("value_dts", Counted(), output_label="counted")
    before = runs.value
    assert before >= 1 and c.get_clusters("counted").count() == c.get_clusters("counted").where("cluster = 0").count() and runs.value == before


def test_errors_of_clusterers_and_regridders(done):
    class Wrong:
        def fit_predict(self, X, y=None):  # noqa: N803
            raise ValueError("my own bug")

    class Few:
        def fit_predict(self, X, y=None):  # noqa: N803
            raise ValueError("min_samples (5) must be at most the number of samples")

    class Rows:
        """A user's regridder: one place for each row of cells."""

        key = "row"

        def regrid(self, points):
            return points.groupBy("t_idx", "t", F.floor("lat").cast("long").alias("row")).agg(F.avg("w").alias("w"), F.avg("lat").alias("lat"), F.lit(0.0).alias("lon"))

        def labels_back(self, points, labels):
            return points.withColumn("row", F.floor("lat").cast("long")).join(labels, ["t_idx", "row"], "left").select("cell_id", "t_idx", F.coalesce("cluster", F.lit(-1)).alias("cluster"))

    with pytest.raises(Exception, match="my own bug"):
        done.compute_clusters("value_dts", Wrong(), output_label="x")
    few = done.compute_clusters("value_dts", Few(), output_label="x").get_clusters("x")
    assert few.count() > 0 and few.where("cluster >= 0").count() == 0
    for method in (DBSCAN(4000.0, 2), HDBSCAN(4), SparkML(KMeans(k=2, seed=1))):
        back = done.compute_clusters("value_dts", method, regridder=Rows(), output_label="x").get_clusters("x")
        assert back.count() == few.count() and back.where("cluster >= 0").count() > 0
    assert {r[0] for r in back.select("cluster").distinct().collect()} == {0, 1}


def test_small_helpers(done, caplog):
    lab = done.get_clusters("value_dts_cluster_d")
    with caplog.at_level("WARNING", "shiftlab"):
        assert masks.existing_ids(lab, [0, 999]) == [0] and "999" in caplog.text
    assert masks.is_equal_to([-1], -1) and masks.is_equal_to(-1, -1) and not masks.is_equal_to([-1, 0], -1) and masks.contains_value([1, -1], -1) and not masks.contains_value(3, -1)
    assert np.allclose(polyfit(np.arange(5), np.arange(5) ** 2, 2), [1, 0, 0])
    with pytest.raises(NotImplementedError):
        done.preprocess.preprocess()


def test_dimension_to_variables(spark, monkeypatch):
    df = spark.createDataFrame([(k, m, float(10 * k + m)) for k in range(3) for m in range(4)], "k int, m int, v double")
    assert series.dimension_to_variables(df, "v", "m", ["k"]).columns == ["k", "v_m_0", "v_m_1", "v_m_2", "v_m_3"]
    kept = series.dimension_to_variables(df, "v", "m", ["k"], drop_original=False)
    assert kept.count() == 12 and kept.where("k = 2 and m = 1").first().v_m_3 == 23
    monkeypatch.setattr(series, "MAX_MEMBERS", 3)
    with pytest.raises(ValueError, match="more than 3"):
        series.dimension_to_variables(df, "v", "m", ["k"])


def test_synthetic_truth(spark):
    """Without noise each shifted cell steps up at its labelled step, by the magnitudes of the truth."""
    truth = synth.shift_parameters(2, 5)
    df = synth.global_dataset(spark, 12, 24, 60, background_noise=0.0, n_shifts=2, random_seed=5).toPandas()
    cells = [x.sort_values("t_idx") for _, x in df.groupby("cell_id")]
    marked = [x for x in cells if x.shift_label.any()]
    assert truth[0]["center_time"] == 20 and truth[1]["center_time"] == 70 and 0 < len(marked) < len(cells)
    for x in cells:
        v, steps = x.value.to_numpy(), np.flatnonzero(x.shift_label)
        if not len(steps):
            assert np.ptp(v) < 1e-9
        elif len(steps) == 1:
            assert steps[0] < 59 and abs(np.argmax(np.diff(v)) + 0.5 - steps[0]) < 1 and 0.9 < v[-1] < 1.1 or steps[0] == 59


def test_no_shared_folder(spark, monkeypatch):
    """Only a local session may go without a shared folder."""

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(dict)  # noqa: N815

    class Session:
        sparkContext = Context  # noqa: N815
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session)


def test_save_and_load(spark, done, tmp_path):
    path = done.drop_clusters("value_dts_cluster_h").save(str(tmp_path / "cube"), "x")
    back = ShiftCube.load(spark, path)
    assert back.axis == done.axis and back.cluster_vars == ["value_dts_cluster_d"]
    assert back.get_shifts("value").count() == done.get_shifts("value").count()
    with pytest.raises(Exception, match="(?i)exists"):
        back.save(str(tmp_path / "cube"), "x")


def test_timestamps_and_irregular(spark):
    start = datetime.datetime(2020, 1, 1)
    rows = [(start + datetime.timedelta(days=k), j, i, 10.0 * j + k, 20.0 * i, float("nan") if k == 2 and i == 0 else float(k * j)) for k in range(4) for j in range(2) for i in range(3)]
    c = ShiftCube.from_dataframe(spark.createDataFrame(rows, "time timestamp, j int, i int, lat double, lon double, v double"), "time", "j", "i", ["v"])
    assert c.axis == (0.0, 86400.0, 172800.0, 259200.0) and c.grid_kind == "irregular"
    assert c.grid.where("v is null").count() == 2 and c.cells.where("lat is null").count() == 0
    with pytest.raises(AssertionError):
        ShiftCube.from_dataframe(c.grid, "nothing")


def test_streaming(spark, tmp_path):
    v = np.concatenate([np.zeros(30), np.full(30, 9.0)]) + np.arange(60) % 3
    rows = [(c, i, float(x * (c + 1))) for c in range(3) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "cell_id long, t_idx int, v double")
    run = detect_batches(str(tmp_path / "d"), list(range(60)))
    run(df.where("t_idx < 40"), 0)
    run(df.where("t_idx >= 40 and cell_id < 2"), 1)
    got = spark.read.parquet(str(tmp_path / "d/shifts"))
    assert {r.cell_id for r in got.where("batch = 1").select("cell_id").distinct().collect()} == {0, 1}
    assert got.where("batch = 1").agg(F.max("dts")).first()[0] > 0.5
    src = tmp_path / "in"
    df.select("cell_id", (F.timestamp_seconds(F.col("t_idx") * 43200)).alias("ts"), "v").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("cell_id long, ts timestamp, v double").parquet(str(src))
    q = running_cells(stream).writeStream.format("memory").queryName("running").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("running").count() == 90 and spark.table("running").agg(F.sum("n")).first()[0] == 180
