import datetime
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import blocks, spatial
from lacuna.operators import panel as panels
from lacuna.operators.forest import ChainedForest, InitialisedForest, IterativeForest, Settings, unfitted_fill
from lacuna.operators.kalman import fill_series, filter_series, kalman_fill
from lacuna.plans import evaluation

from .test_operators import DAY, make

SMALL = {"n_estimators": 4, "max_iter": 1, "max_depth": 3, "max_bins": 16}


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(0)
    base = 50 + 30 * np.sin(np.arange(500) / 58)
    series = {s: [None if rng.random() < 0.2 else float(x) for x in base * k + rng.normal(0, 1, 500)] for s, k in (("a", 1.0), ("b", 2.0), ("c", 0.5))}
    stations = spark.createDataFrame([("a",), ("b",), ("c",)], "station string")
    places = spark.createDataFrame([("a", 20.0, 80.0), ("b", 20.0, 81.0), ("c", 21.0, 80.0)], "station string, latitude double, longitude double")
    dist = spatial.distances(stations, places).cache()
    conn = spatial.connectivity(stations, spark.createDataFrame([("b", "a")], "station string, contributor string")).cache()
    return make(spark, series).cache(), Settings(dist, conn, **SMALL)


def check(filled, panel, trained=None):
    """No gap remains, readings stay, rows stay, predictions are within the range of what was learnt from."""
    both = filled.join(panel.select("station", "date", "value"), ["station", "date"])
    assert filled.count() == both.count() == panel.count()
    assert both.where("filled IS NULL OR value <> filled OR was_missing <> (value IS NULL)").count() == 0
    span = (panel if trained is None else trained.select(*panel.columns).unionByName(panel)).groupBy("station").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    assert both.join(span, "station").where("filled < lo - 1e-9 OR filled > hi + 1e-9").count() == 0


@pytest.mark.parametrize("kind, update", [(IterativeForest, "gauss_seidel"), (InitialisedForest, "jacobi"), (ChainedForest, "jacobi")])
def test_forests(spark, world, kind, update):
    panel, settings = world[0], replace(world[1], update=update)
    seed, part = panels.between(panel, DAY, "1980-12-31"), panels.outside(panel, DAY, "1980-12-31")
    model = kind(settings).fit(seed)
    check(model.transform(part), part, seed)
    truth = make(spark, {s: [float(k * (50 + 30 * np.sin(t / 58))) for t in range(500)] for s, k in (("a", 1.0), ("b", 2.0), ("c", 0.5))}).withColumnRenamed("value", "t")
    error = model.transform(part).where("was_missing").join(truth, ["station", "date"]).agg(F.avg(F.abs(F.col("filled") - F.col("t")) / F.col("t"))).first()[0]
    assert error < 0.25


def test_vanilla_unfitted_and_no_gaps(spark, world):
    panel, settings = world
    model = IterativeForest(**SMALL).fit(panel)
    check(model.transform(panel), panel)
    full = model.transform(panel).select("station", "date", "dn", F.col("filled").alias("value"))
    again = IterativeForest(settings).fit(full)
    assert again.transform(full).where("was_missing").count() == 0
    means = unfitted_fill(panel)
    assert means.where("filled IS NULL").count() == 0
    custom = InitialisedForest(Settings(**SMALL)).fit(panel)  # the calendar alone
    check(custom.transform(panel), panel)


def test_fixed_seed_repeats(world):
    panel, settings = world
    runs = [sorted(map(tuple, IterativeForest(settings).fit(panel).transform(panel).where("was_missing").select("station", "dn", "filled").collect())) for _ in range(2)]
    assert runs[0] == runs[1]


def test_saved_fits_are_reused(world, tmp_path, monkeypatch):
    panel, settings = world
    first = blocks.fit_cached(InitialisedForest(settings), panel, f"file://{tmp_path}")
    monkeypatch.setattr(InitialisedForest, "_fit", None)  # another fit would fail
    again = blocks.fit_cached(InitialisedForest(settings), panel, f"file://{tmp_path}")
    rows = [sorted(map(tuple, m.transform(panel).where("was_missing").select("station", "dn", "filled").collect())) for m in (first, again)]
    assert rows[0] == rows[1]


def test_blocks_cover_the_panel(world):
    panel, settings = world
    start, end = datetime.date(1980, 5, 1), datetime.date(1980, 7, 31)
    for kind in (blocks.chaining, blocks.expanding):
        out = kind(panel, start, end, 1, settings)
        check(out, panel)
    only = blocks.seed_only(panel, start, end, settings)
    assert only.count() == panel.count() - 3 * 92
    both = blocks.seed_and_fill(panel, "1980-01-01", "1980-12-31", 100, settings)
    check(both, panels.between(panel, "1980-01-01", "1980-12-31"))


def test_kalman_matches_plain_recursion():
    rng = np.random.default_rng(1)
    y = rng.normal(size=40)
    y[[5, 6, 20]] = np.nan
    _, predicted = filter_series(y, np.array([0.6, 0.0, 0.0, 0.0]))
    for t in range(10, 40):  # a first-order model carries the last value on
        past = next(k for k in range(1, 10) if y[t - k] == y[t - k])
        assert predicted[t] == pytest.approx(0.6**past * y[t - past], rel=1e-3, abs=1e-6)


def test_kalman_fill(spark, world):
    panel, _ = world
    out = kalman_fill(panel, 20)
    assert out.where("filled IS NULL").count() == 0 and out.count() == panel.count()
    assert (fill_series(np.full(30, np.nan), 10) == 0).all()
    assert fill_series(np.array([1.0, np.nan, 3.0]), 10)[1] == 2


def test_evaluation_isolates_failures(world):
    panel, settings = world

    def broken(*_):
        raise RuntimeError("no")

    methods = {"broken": broken, "linear_interpolation": evaluation.METHODS["linear_interpolation"], "knn_k5": evaluation.METHODS["knn_k5"], "forest_chained_equations": evaluation.METHODS["forest_chained_equations"]}
    rows = evaluation.evaluate(panel, "1980-01-01", "1981-05-14", settings, (3, 10), years=1, methods=methods).collect()
    assert [(r["gap_scenario"], r["method"]) for r in rows] == [(g, m) for g in ("10-day_gap", "3-day_gap") for m in sorted(methods)]
    assert all((r["rmse"] is None) == (r["method"] == "broken") for r in rows)
    assert all((r["error"] == "RuntimeError: no") if r["method"] == "broken" else r["error"] is None for r in rows)
    assert all(r["r2"] == r["nse"] for r in rows)


def test_settings_are_params():
    one = IterativeForest(Settings(max_iter=3))
    other = one.copy({one.n_estimators: 7}).setParams(max_depth=4)
    assert (other.settings.max_iter, other.settings.n_estimators, other.settings.max_depth) == (3, 7, 4)
    assert (one.settings.n_estimators, one.settings.max_depth) == (100, 10)


def test_forests_of_the_seed_are_fitted_once(world, monkeypatch):
    panel, settings = world
    fits = []
    fit = InitialisedForest._fit
    monkeypatch.setattr(InitialisedForest, "_fit", lambda self, p: fits.append(1) or fit(self, p))
    methods = {"forest_seed_only": evaluation.METHODS["forest_seed_only"]}
    drawn = []
    rows = evaluation.evaluate(panel, "1980-01-01", "1981-05-14", settings, (3, 10), years=1, methods=methods, plot=lambda cells, method, gap: drawn.append((method, gap, cells.count()))).collect()
    assert len(rows) == 2 and len(fits) == 1
    assert [d[:2] for d in drawn] == [("forest_seed_only", 3), ("forest_seed_only", 10)] and all(d[2] > 0 for d in drawn)


def test_rolling(world):
    panel, settings = world
    out = blocks.rolling(panel, 1980, 1981, 1, 10.0, settings)
    check(out, panels.between(panel, "1980-01-01", "1981-12-31"))
