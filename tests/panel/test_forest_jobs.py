"""Trees against brute force, saved estimators, tuning, resumed evaluations."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from lacuna.operators import gaps, trees
from lacuna.operators import panel as panels
from lacuna.operators.evaluators import GapEvaluator
from lacuna.operators.forest import ChainedForest, InitialisedForest, IterativeForest, IterativeForestModel, Settings
from lacuna.operators.kalman import filter_lanes, search
from lacuna.plans import evaluation

from .test_models import SMALL, world  # noqa: F401
from .test_operators import make


def fills_of(model, panel):
    return sorted(map(tuple, model.transform(panel).select("station", "dn", "filled", "was_missing").collect()))


def stump(x, y):
    """The best split by trying all."""
    tries = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for a, b in zip(values[:-1], values[1:]):
            left = x[:, j] <= a
            tries.append((y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum(), -j, -a, (a + b) / 2))
    _, j, _, threshold = max(tries)
    return -j, threshold


def test_a_tree_of_depth_one_is_the_best_split():
    rng = np.random.default_rng(0)
    for seed in range(20):
        x, y = rng.integers(0, 6, (60, 4)).astype(float), rng.integers(0, 50, 60).astype(float)
        forest = trees.grow(x, y, 1, 4, seed, 1, bootstrap=False)
        j, threshold = stump(x, y)
        left = x[:, j] <= threshold
        assert (forest["feature"][0], forest["threshold"][0]) == (j, threshold)
        assert trees.predict(forest, x) == pytest.approx(np.where(left, y[left].mean(), y[~left].mean()))


def test_deep_trees_learn_their_days_and_follow_their_options():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    y = 3 * x[:, 0] + np.sin(3 * x[:, 1])
    whole = trees.grow(x, y, 2, 5, 0, bootstrap=False)
    assert trees.predict(whole, x) == pytest.approx(y)
    forest = trees.grow(x, y, 40, 2, 0, 8)
    fresh = rng.normal(size=(300, 5))
    truth = 3 * fresh[:, 0] + np.sin(3 * fresh[:, 1])
    assert np.mean((trees.predict(forest, fresh) - truth) ** 2) < 0.25 * truth.var()
    assert all(np.array_equal(forest[c], trees.grow(x, y, 40, 2, 0, 8)[c]) for c in trees.COLUMNS)
    depth = {k: 0 for k in range(40)}
    for k, child in enumerate(forest["child"]):
        if child >= 0:
            depth[child] = depth[child + 1] = depth[k] + 1
    assert max(depth.values()) <= 8
    few = trees.grow(x, y, 5, 5, 0, max_bins=4)
    for j in range(5):
        assert len(set(few["threshold"][few["feature"] == j])) <= 6  # between any two of four bins
    flat = trees.grow(x, np.full(300, 2.0), 3, 2, 0)
    assert (flat["feature"] == -1).all() and (flat["value"] == 2).all()
    one = trees.grow(x[:1], y[:1], 3, 2, 0)
    assert trees.predict(one, x[:2]) == pytest.approx([y[0], y[0]])
    same = trees.grow(np.ones((50, 2)), np.arange(50.0), 2, 2, 0, bootstrap=False)
    assert trees.predict(same, np.ones((1, 2))) == pytest.approx([24.5])


def test_stations_see_what_was_predicted_before_them(world):
    """Stations one after the other differ from all at once in the pass's later stations."""
    panel, settings = world
    options = dict(n_estimators=3, max_iter=1, max_depth=4)
    one = fills_of(ChainedForest(**options, update="gauss_seidel").fit(panel), panel)
    all_ = fills_of(ChainedForest(**options, update="jacobi").fit(panel), panel)
    assert [r[:2] for r in one] == [r[:2] for r in all_] and one != all_
    first = ChainedForest(**options).order([5, 2, 7])
    assert first == [1, 0, 2]


def test_passes_end_once_nothing_moves(world, monkeypatch):
    panel, _ = world
    steps = []
    own = IterativeForest._step
    monkeypatch.setattr(IterativeForest, "_step", lambda self, days, factors, stations, models: steps.append(stations) or own(self, days, factors, stations, models))
    for kind, tolerance, passes in ((IterativeForest, 1e9, 1), (InitialisedForest, 1e9, 1), (IterativeForest, 0.0, 3)):
        steps.clear()
        kind(n_estimators=2, max_iter=3, max_depth=2, update="jacobi", tolerance=tolerance).fit(panel)
        assert len(steps) == passes
    steps.clear()
    IterativeForest(n_estimators=2, max_iter=1, max_depth=2).fit(panel)
    assert steps == [[0], [1], [2], [2], [1], [0]]  # forward and backward


def test_norms_of_change(spark, world):
    from lacuna.operators.forest import Wide, _STEP
    from lacuna.sources.checkpoints import cut

    panel = make(spark, {"a": [1.0, None, 3.0], "b": [None, 5.0, 6.0]})
    wide = Wide(panel, ["a", "b"], None, {"a": 2.0, "b": 5.5})
    days = {r["date"]: r for r in wide.df.orderBy("date").collect()}
    dates = sorted(days)
    assert [days[d]["v"] for d in dates] == [[1.0, 5.5], [2.0, 5.0], [3.0, 6.0]] and [days[d]["m"] for d in dates] == [[False, True], [True, False], [False, False]]
    assert wide.missing() == [1, 1]
    rows = [(0, dates[1], 5.0), (1, dates[0], 9.5)]
    step = cut(spark.createDataFrame([(k, d, p, None, None, None, None, None, None) for k, d, p in rows], _STEP))
    assert IterativeForest()._change([step], wide.df) == pytest.approx(5.0)
    assert ChainedForest()._change([step], wide.df) == pytest.approx(4.0)
    assert wide.long().count() == 6


def test_stations_without_readings_and_empty_panels(spark):
    panel = make(spark, {"a": [1.0, None, 3.0, 4.0], "none": [None] * 4})
    out = {(r["station"], r["dn"]): r["filled"] for r in IterativeForest(**SMALL, update="jacobi").fit(panel).transform(panel).collect()}
    assert len(out) == 8 and all(v is None for (s, _), v in out.items() if s == "none") and all(v is not None for (s, _), v in out.items() if s == "a")
    nothing = panel.limit(0)
    assert IterativeForest(**SMALL).fit(nothing).transform(nothing).count() == 0
    assert IterativeForest(**SMALL).fit(panel).transform(nothing).count() == 0


def test_a_pipeline_can_be_saved_and_loaded(spark, world, tmp_path):
    panel, settings = world
    for kind in (IterativeForest, InitialisedForest, ChainedForest):
        own = Settings(settings.distances, settings.connectivity, **SMALL, update="jacobi")
        model = Pipeline(stages=[kind(own)]).fit(panel)
        model.write().overwrite().save(f"file://{tmp_path}/{kind.__name__}")
        again = PipelineModel.load(f"file://{tmp_path}/{kind.__name__}")
        assert isinstance(again.stages[0], IterativeForestModel) and type(again.stages[0].forest) is kind and again.stages[0].uid == model.stages[0].uid
        assert fills_of(again, panel) == fills_of(model, panel)
        stage = kind(own)
        Pipeline(stages=[stage]).write().overwrite().save(f"file://{tmp_path}/{kind.__name__}-unfitted")
        loaded = Pipeline.load(f"file://{tmp_path}/{kind.__name__}-unfitted").getStages()[0]
        assert type(loaded) is kind and loaded.uid == stage.uid and {p.name: loaded.getOrDefault(p) for p in loaded.params} == {p.name: stage.getOrDefault(p) for p in stage.params}
        assert not loaded.settings.vanilla


def test_a_validator_picks_the_better_setting(spark, world):
    panel, _ = world
    gapped = gaps.apply_plan(panel, gaps.contiguous_gaps_by_percent(panel, 5, 10.0))
    masked = gapped.select("station", "date", "dn", "value").withColumn("fold", F.pmod(F.floor(F.col("dn") / 20), F.lit(2)).cast("int")).cache()
    forest = ChainedForest(n_estimators=5, max_iter=1, update="jacobi")
    grid = ParamGridBuilder().addGrid(forest.max_depth, [1, 6]).build()
    for metric in ("kge", "rmse"):
        judge = GapEvaluator(gapped=gapped, metricName=metric)
        assert judge.isLargerBetter() == (metric == "kge")
        found = CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=judge, numFolds=2, foldCol="fold").fit(masked)
        best, worse = (found.avgMetrics[1], found.avgMetrics[0])
        assert (best > worse) == (metric == "kge")
        assert found.bestModel.forest.settings.max_depth == 6
    judge = GapEvaluator(gapped=gapped.where("false"), metricName="mae")
    assert judge.evaluate(panel.select("station", "date", F.col("value").alias("filled"))) == float("inf")
    with pytest.raises(ValueError):
        GapEvaluator(gapped=gapped, metricName="none")


def test_a_stopped_evaluation_goes_on_from_its_ledger(world, tmp_path):
    panel, settings = world
    calls = []

    def method(name, fails=()):
        def fill(seed, part, whole, ends, s):
            calls.append(name)
            if name in fails:
                raise KeyboardInterrupt if name == "stop" else RuntimeError(name)
            return evaluation.METHODS["historical_mean"](seed, part, whole, ends, s)

        return fill

    ledger = f"file://{tmp_path}/ledger"
    span = dict(start="1980-01-01", end="1981-05-14", settings=settings, gap_lengths=(3, 10), years=1, ledger=ledger)
    stopping = {"one": method("one"), "two": method("two", ("two",)), "stop": method("stop", ("stop",))}
    with pytest.raises(KeyboardInterrupt):
        evaluation.evaluate(panel, **span, methods=stopping, parallel=1)
    assert calls.count("one") == 2 and "stop" in calls
    calls.clear()
    whole = {"one": method("one"), "two": method("two"), "stop": method("stop")}
    rows = evaluation.evaluate(panel, **span, methods=whole, parallel=3).collect()
    assert "one" not in calls and calls.count("two") == calls.count("stop") == 2  # failures are tried again
    assert len(rows) == 6 and all(r["error"] is None and r["n"] > 0 for r in rows)
    calls.clear()
    assert evaluation.evaluate(panel, **span, methods=whole).collect() == rows and not calls
    other = evaluation.evaluate(panel.withColumn("value", F.col("value") + 1), **span, methods={"one": method("one")}).collect()
    assert len(other) == 2 and len(calls) == 2  # other readings, other results


def test_gains_settle_and_points_are_filtered_alike():
    rng = np.random.default_rng(2)
    y = rng.normal(size=(400, 3)).cumsum(0) * 0.1
    y[:200][rng.random((200, 3)) < 0.1] = np.nan
    params = np.array([[0.5, 0.1, 0.3, 0.1], [0.7, 0.0, 0.2, 0.1], [0.1, 0.2, 0.1, 0.0]])
    gains = []
    likelihood, predicted = filter_lanes(y, params, True, gains)
    assert np.abs(gains[-1] - gains[-50]).max() < 1e-9 < np.abs(gains[20] - gains[-1]).max()
    for j in range(3):
        one, alone = filter_lanes(y[:, [j]], params[[j]], True)
        assert one[0] == pytest.approx(likelihood[j], rel=1e-9) and np.allclose(alone[:, 0], predicted[:, j], rtol=1e-9)
    best = search(y, 60)
    assert (filter_lanes(y, best)[0] >= filter_lanes(y, np.tile([0.5, 0.1, 0.3, 0.1], (3, 1)))[0]).all()
    assert np.array_equal(search(y[:, [1]], 60)[0], best[1])


def test_memory_of_growing_trees_does_not_follow_their_days(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(2)
    x, y = rng.gamma(2.0, 100.0, (2557, 26)), rng.normal(size=2557)
    tracemalloc.start()  # 110 MB when a level's samples were ordered all at once
    trees.grow(x, y, 100, 5, 0, 4, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 << 20
    small = [trees.grow(x[:200], y[:200], 20, 5, 0, 0, bins) for bins in (0, 16)]
    monkeypatch.setattr(trees, "CELLS", 50)
    for bins, whole in zip((0, 16), small):
        parts = trees.grow(x[:200], y[:200], 20, 5, 0, 0, bins)
        assert all(np.array_equal(parts[c], whole[c]) for c in trees.COLUMNS)
