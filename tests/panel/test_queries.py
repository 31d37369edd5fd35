"""Model queries run the operators' whole jobs; models themselves are replaced here."""

import pytest

from lacuna.operators.forest import Settings
from lacuna.plans import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def asked(monkeypatch):
    """What the queries give to models: settings, and the panel's number of stations."""
    found = {}

    def take(panel, settings):
        found.update(stations=panel.select("station").distinct().count(), settings=settings)
        return panel.selectExpr("station", "date", "dn", "coalesce(value, 1) AS filled", "value IS NULL AS was_missing")

    class Recorded:
        def __init__(self, settings=None, **options):
            self.settings = settings or Settings(**options)

        def fit(self, seed):
            take(seed, self.settings)
            return self

        def transform(self, part):
            return take(part, self.settings)

    for name in ("IterativeForest", "InitialisedForest", "ChainedForest"):
        monkeypatch.setattr(queries, name, Recorded)
    for name in ("seed_and_fill", "chaining", "expanding"):
        monkeypatch.setattr(queries.blocks, name, lambda panel, *rest: take(panel, rest[-1]))
    monkeypatch.setattr(queries.evaluation, "evaluate", lambda panel, start, end, settings, *lengths, **options: found.update(lengths=lengths, options=options) or take(panel, settings).selectExpr("'' AS gap_scenario", "'' AS method", "1L AS n", "'' AS error", *[f"1D AS {m}" for m in ("rmse", "mae", "r2", "nse", "kge")]))
    monkeypatch.setattr(queries, "kalman_fill", lambda panel, *evaluations: found.update(evaluations=evaluations) or take(panel, None))
    return found


@pytest.mark.parametrize("name", ["forest_base", "forest_custom", "forest_vanilla", "forest_chained_equations", "seed_and_fill", "chaining", "expanding", "evaluation"])
def test_forests_on_the_nation_panel(spark, asked, name):
    queries.QUERIES[name](spark, DIR)
    s, size = asked["settings"], queries.EVALUATED if name == "evaluation" else queries.MODELS
    assert {k: getattr(s, k) for k in size} == size
    assert asked["stations"] == queries.demo.keys(spark, DIR).count() > 5


def test_held_counts_what_changed(spark):
    day = "DATE '2000-01-01' + k"
    panel = spark.sql(f"SELECT 'a' AS station, {day} AS date, nullif(k, 2) * 1D AS value FROM VALUES (0), (1), (2), (3) AS t(k)")
    right = panel.selectExpr("station", "date", "coalesce(value, 1.5) AS filled", "value IS NULL AS was_missing")
    assert tuple(queries.held(right, panel, panel).first()) == ("a", 4, 1, 0, 0, 0, 0)
    wrong = right.selectExpr("station", "date", "CASE day(date) WHEN 1 THEN 9 WHEN 2 THEN NULL WHEN 3 THEN 99 ELSE filled END AS filled", "was_missing AND day(date) <> 3 AS was_missing")
    assert tuple(queries.held(wrong, panel, panel).first()) == ("a", 4, 1, 1, 2, 1, 1)


def test_evaluation_has_all_gap_lengths(spark, asked):
    queries.QUERIES["evaluation"](spark, DIR)
    assert asked["lengths"] == () and "gap_lengths" not in asked["options"]


def test_all_gap_kinds(spark):
    rows = queries.QUERIES["metrics_gap_kinds_all"](spark, DIR).collect()
    want = {("contiguous", n) for n in (7, 14, 30, 60, 180)} | {("single_point", n) for n in (30, 60, 90, 180)}
    assert {(r["gap_type"], r["gap_length"]) for r in rows} == want and len(rows) == 9


def test_likelihood_search_is_whole(spark, asked):
    queries.QUERIES["kalman_fill"](spark, DIR)
    assert asked["evaluations"] == () and asked["stations"] == queries.demo.keys(spark, DIR).count() > 5
    queries.QUERIES["evaluation"](spark, DIR)
    assert "methods" not in asked["options"]  # the operators' own, kalman_sarima with all evaluations
