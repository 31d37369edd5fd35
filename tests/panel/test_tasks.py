"""Work that is small goes to few tasks, with the same results."""

from dataclasses import replace

import numpy as np
import pytest

from lacuna.operators import forest
from lacuna.operators.forest import ChainedForest, InitialisedForest, IterativeForest, Settings
from lacuna.operators.kalman import fill_lanes, kalman_fill
from lacuna.plans import demo, evaluation, queries

from .test_models import world  # noqa: F401
from .test_operators import make


def test_nine_stations_are_filtered_by_one_task(spark):
    rng = np.random.default_rng(3)
    y = 50 + rng.normal(size=(60, 9)).cumsum(0)
    y[rng.random(y.shape) < 0.1] = np.nan
    y[:, 4] = np.nan
    filled = kalman_fill(make(spark, {f"s{k}": [None if np.isnan(v) else float(v) for v in y[:, k]] for k in range(9)}), 30)
    assert filled.rdd.getNumPartitions() == 1
    rows = {(r["station"], r["dn"]): r["filled"] for r in filled.collect()}
    first = min(dn for _, dn in rows)
    for k in range(9):  # as each alone
        assert [rows[f"s{k}", first + t] for t in range(60)] == pytest.approx(fill_lanes(y[:, [k]], 30)[:, 0], rel=1e-9)


def test_replays_of_few_stations_share_a_task(world, monkeypatch):  # noqa: F811
    panel, settings = world
    model = ChainedForest(replace(settings, update="jacobi")).fit(panel)
    tasks, cut = [], forest.cut
    monkeypatch.setattr(forest, "cut", lambda df, *by: tasks.append((df.columns, df.rdd.getNumPartitions())) or cut(df, *by))
    filled = model.transform(panel)
    assert [n for columns, n in tasks if "trees" in columns] == [1]
    assert filled.where("filled IS NULL").count() == 0 and filled.count() == panel.count()


def test_evaluation_writes_the_panel_and_finds_its_window_once(spark, monkeypatch):
    calls = []
    panel, find = demo.panel, queries.panels.find_best_window
    monkeypatch.setattr(demo, "panel", lambda *a: calls.append("panel") or panel(*a))
    monkeypatch.setattr(queries.panels, "find_best_window", lambda *a: calls.append("window") or find(*a))
    for name in list(queries.evaluation.METHODS):  # the plain fills stay
        if name not in ("linear_interpolation", "historical_mean"):
            monkeypatch.delitem(queries.evaluation.METHODS, name)
    rows = queries.QUERIES["evaluation"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 8 and all(r["error"] is None and r["n_metrics"] == 5 for r in rows)
    assert calls == ["panel", "window"]


@pytest.mark.parametrize("kind, tolerance", [(IterativeForest, 30.0), (ChainedForest, 1e-6), (InitialisedForest, 1e9)])
def test_all_passes_of_a_replay_are_one_job(spark, world, monkeypatch, kind, tolerance):  # noqa: F811
    """By blocks of days as pass by pass: the same values after the same number of passes."""
    panel, settings = world
    panel = panel.unionByName(make(spark, {"none": [None] * 500}))
    model = kind(replace(settings, update="jacobi", max_iter=4, tolerance=tolerance)).fit(panel)
    steps, own, cut = [], IterativeForest._step, forest.cut
    monkeypatch.setattr(forest, "REPLAY_DAYS", 100)
    monkeypatch.setattr(IterativeForest, "_step", lambda self, *a: steps.append(a) or own(self, *a))
    rows = lambda: sorted((r["station"], r["dn"], r["was_missing"], r["filled"]) for r in model.transform(panel).collect() if r["station"] != "none")
    at_once = rows()
    assert not steps
    monkeypatch.setattr(forest, "REPLAY_BYTES", -1)
    by_pass = rows()
    assert (len(steps) > 1) == (tolerance < 1e9)
    assert at_once == by_pass and len(at_once) == 1500


def test_evaluation_runs_whole_forests(spark, monkeypatch):
    """Trees and passes as many as the reference's (and the operators' own), down to pure leaves; forward and backward are two passes side by side."""
    whole = Settings()
    size = queries.EVALUATED
    assert (size["n_estimators"], size["max_iter"]) == (whole.n_estimators, whole.max_iter) == (100, 10)
    assert (size["max_depth"], size["max_bins"]) == (0, 0)
    found = []

    class Recorded(IterativeForest):
        def fit(self, seed):
            found.append(self.settings)
            return self

        def transform(self, part):
            return part

    monkeypatch.setattr(evaluation, "IterativeForest", Recorded)
    for update, passes in (("jacobi", 20), ("gauss_seidel", 10)):
        evaluation.METHODS["forest_vanilla"](None, None, None, (), Settings(**size | {"update": update}))
        assert (found[-1].max_iter, found[-1].n_estimators, found[-1].max_depth) == (passes, 100, 0)


def test_the_seed_is_filled_once_for_all_gap_lengths(world, monkeypatch):  # noqa: F811
    panel, settings = world
    fits, fills = [], []
    fit, fill = InitialisedForest._fit, forest.IterativeForestModel._transform
    monkeypatch.setattr(InitialisedForest, "_fit", lambda self, p: fits.append(1) or fit(self, p))
    monkeypatch.setattr(forest.IterativeForestModel, "_transform", lambda self, p: fills.append(1) or fill(self, p))
    methods = {m: evaluation.METHODS[m] for m in ("forest_chaining", "forest_expanding")}
    rows = evaluation.evaluate(panel, "1980-01-01", "1981-05-14", replace(settings, update="jacobi"), (3, 10), years=1, methods=methods).collect()
    assert len(rows) == 4 and all(r["error"] is None and r["n"] > 0 for r in rows)
    assert len(fits) == 2 and len(fills) == 9  # the seed's model and the expanded one; the seed, and a block on either side for each pair
