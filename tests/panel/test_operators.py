import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from lacuna.operators import blocks, fills, gaps, knn, metrics, spatial
from lacuna.operators import panel as panels

DAY = datetime.date(1980, 1, 1)


def make(spark, series, start=DAY):
    rows = [(s, start + datetime.timedelta(k), v) for s, values in series.items() for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "station string, date date, value double").selectExpr("station", "date", "datediff(date, DATE '1970-01-01') dn", "value")


def series_of(n, seed=0, missing=0.4):
    rng = random.Random(seed)
    return [None if rng.random() < missing else float(rng.randrange(100)) for _ in range(n)]


@pytest.fixture(scope="module")
def data():
    return {"a": series_of(2200, 1), "b": series_of(2200, 2, 0.8), "c": [None] * 2200, "d": [5.0] * 2200}


def filled(spark, data, method):
    rows = fills.fill(make(spark, data), method).orderBy("station", "dn").collect()
    return {s: [r["filled"] for r in rows if r["station"] == s] for s in data}


def test_fills_against_pandas(spark, data):
    index = pd.date_range(DAY, periods=2200)
    got = {m: filled(spark, data, m) for m in fills.METHODS}
    for s, values in data.items():
        y = pd.Series([np.nan if v is None else v for v in values], index)
        mean = 0.0 if y.isna().all() else y.mean()
        assert np.allclose(got["column_mean"][s], y.fillna(mean))
        season = [v if v == v else (w.mean() if (w := y[d - pd.Timedelta(15, "D") : d + pd.Timedelta(15, "D")].dropna()).size else mean) for d, v in y.items()]
        assert np.allclose(got["seasonal_mean"][s], season)
        past = []
        for d, v in y.items():
            h = y[(index.dayofyear == d.dayofyear) & (index.year < d.year)].dropna()
            past.append(v if v == v else h.mean() if len(h) >= 2 else mean)
        assert np.allclose(got["historical_mean"][s], past)
        line = y.interpolate(method="time").ffill().bfill()
        if y.isna().all():
            assert got["linear_time"][s] == [None] * len(y)
        else:
            assert np.allclose(got["linear_time"][s], line)


def test_initialise_leaves_nothing(spark, data):
    for method in fills.INITIAL:
        assert fills.initialise(make(spark, data), method).where("filled IS NULL").count() == 0
    with pytest.raises(ValueError):
        fills.initialise(make(spark, data), "median")
    with pytest.raises(ValueError):
        fills.fill(make(spark, data), "median")


def test_min_years(spark):
    values = [None] * 1500
    values[10] = 4.0
    panel = make(spark, {"a": values})
    row = fills.fill(panel, "historical_mean", min_years=1).where("date = DATE '1981-01-11'").first()
    assert row["filled"] == 4.0


def test_windows_against_pandas(spark, data):
    panel = make(spark, data)
    y = pd.DataFrame({s: pd.Series([np.nan if v is None else v for v in x], pd.date_range(DAY, periods=2200)) for s, x in data.items()})
    score = y.notna().sum(axis=1).rolling("365D", min_periods=365).sum()
    best = panels.best_window(panel, 365).first()
    assert best["end_date"] == score.idxmax().date() and best["score"] == score.max()
    assert panels.find_best_window(panel, "1980-01-01", "1985-12-31", 365) == (best["start_date"], best["end_date"])


def test_absent_date_voids_windows(spark):
    panel = make(spark, {"a": [1.0] * 20}).where("date <> DATE '1980-01-11'")
    got = {str(r["end_date"]) for r in panels.windows(panel, 5).collect()}
    assert got == {f"1980-01-{d:02d}" for d in [*range(5, 11), *range(16, 21)]}
    assert str(panels.best_window(panel, 5).first()["end_date"]) == "1980-01-05"  # the earliest of equals
    with pytest.raises(ValueError, match="whole window"):
        panels.find_best_window(panel, "1980-01-01", "1980-01-20", 15)
    with pytest.raises(ValueError, match="no data"):
        panels.find_best_window(panel, "1990-01-01", "1990-01-20", 5)


def test_year_completeness(spark):
    panel = make(spark, {"a": [1.0] * 366 + [None] * 365 + [1.0] * 365})
    got = [(r["first_year"], round(r["percent"], 3)) for r in panels.year_completeness(panel).orderBy("first_year").collect()]
    assert got == [(1980, 100.0), (1981, 0.0), (1982, 100.0)]
    assert panels.year_completeness(panel, 2, 50.0).orderBy("first_year").first()["first_year"] == 1980


def test_wide_and_back(spark, data):
    panel = make(spark, data)
    wide = panels.to_wide(panel, sorted(data))
    assert wide.columns == ["date", "a", "b", "c", "d", "day_of_year_sin", "day_of_year_cos"]
    again = panels.to_long(wide, sorted(data))
    assert again.exceptAll(panel.select(*again.columns)).count() == 0


def kge(t, p):
    r = np.corrcoef(t, p)[0, 1] if np.std(t) and np.std(p) else 0.0
    beta = np.mean(p) / np.mean(t) if np.mean(t) else (1.0 if not np.mean(p) else np.nan)
    gamma = np.std(p) / np.std(t) if np.std(t) else (1.0 if not np.std(p) else np.nan)
    return 1 - math.sqrt((r - 1) ** 2 + (beta - 1) ** 2 + (gamma - 1) ** 2)


@pytest.mark.parametrize("t, p", [
    ([1.0, 2, 3, 4], [1.5, 2, 2.5, 5]), ([1.0, 1, 1], [1.0, 2, 3]), ([1.0, 1, 1], [2.0, 2, 2]), ([0.0, 0, 0], [0.0, 0, 0]), ([0.0, 0], [1.0, 1]), ([-1.0, 1], [2.0, 3]),
    ([1.0, 2], [3.0, 3]), ([5.0], [4.0]), ([], []), ([None, 1.0], [1.0, None]), ([float("nan"), 1.0, 2.0], [1.0, 1.0, 2.5]),
])
def test_metrics(spark, t, p):
    t, p = ([x if x is None else float(x) for x in side] for side in (t, p))
    row = metrics.evaluate(spark.createDataFrame(list(zip(t, p)), "true_value double, filled double")).first()
    pairs = [(a, b) for a, b in zip(t, p) if a is not None and b is not None and a == a and b == b]
    if not pairs:
        assert row["n"] == 0 and all(row[m] is None for m in metrics.NAMES)
        return
    a, b = (np.array(x) for x in zip(*pairs))
    assert row["rmse"] == pytest.approx(math.sqrt(((a - b) ** 2).mean())) and row["mae"] == pytest.approx(abs(a - b).mean())
    total = ((a - a.mean()) ** 2).sum()
    assert row["r2"] == row["nse"] == (pytest.approx(1 - ((a - b) ** 2).sum() / total) if total else None)
    want = kge(a, b)
    assert row["kge"] == (pytest.approx(want) if want == want else None)


def test_evaluate_gaps(spark):
    original, gapped = make(spark, {"a": [1.0, 2.0, None, 4.0]}), make(spark, {"a": [1.0, None, None, None]})
    full = fills.fill(gapped, "column_mean")
    assert metrics.evaluate_gaps(original, gapped, full).first()["n"] == 2
    assert metrics.evaluate_gaps(original, gapped, full, False).first()["n"] == 2


def test_gap_plans(spark, data):
    panel = make(spark, {"a": data["a"], "b": data["b"][:50]})
    plan = {}
    for r in gaps.contiguous_gaps(panel, 30).collect():
        plan.setdefault(r["station"], []).append((r["start"], r["stop"]))
    assert len(plan["a"]) == 5 and len(plan["b"]) == 1
    spans = sorted(plan["a"])
    assert all(b - a == 30 for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert gaps.contiguous_gaps(panel, 0).count() == 0
    whole = {(r["station"], r["start"], r["stop"]) for r in gaps.contiguous_gaps(panel, 60).collect() if r["station"] == "b"}
    assert whole == {("b", 0, 50)}
    share = gaps.contiguous_gaps_by_percent(panel, 7, 10.0).groupBy("station").count().collect()
    assert {r["station"]: r["count"] for r in share} == {"a": 31, "b": 1}
    points = {r["station"]: r["count"] for r in gaps.point_gaps(panel, 30).groupBy("station").count().collect()}
    assert points == {"a": int(2200 * 30 / 365), "b": int(50 * 30 / 365)}
    assert gaps.point_gaps(panel, 0).count() == 0
    assert {r["count"] for r in gaps.point_gaps(panel, 1).groupBy("station").count().collect()} == {1, 6}
    assert gaps.point_gaps(panel, 400).count() == 2250
    done = gaps.apply_plan(panel, gaps.contiguous_gaps(panel, 30))
    assert done.count() == 2250 and done.where("is_gap").count() == 180
    assert done.where("is_gap AND value IS NOT NULL OR NOT is_gap AND NOT value <=> true_value").count() == 0


def test_legacy_draw():
    rng = np.random.RandomState(42)
    starts = np.arange(100 - 10 + 1)
    rng.shuffle(starts)
    first = gaps.legacy_starts({"a": 100, "b": 5}, 10)
    assert first[0] == ("a", starts[0], starts[0] + 10) and first[-1] == ("b", 0, 5)
    assert len(gaps.legacy_starts({"a": 100}, 10, 10.0)) == 1


def test_weights(spark):
    stations = spark.createDataFrame([("a",), ("b",), ("c",), ("x",)], "station string")
    places = spark.createDataFrame([("a", 20.0, 80.0), ("b", 20.0, 81.0), ("c", 20.0, 83.0)], "station string, latitude double, longitude double")
    dist = spatial.distances(stations, places)
    km = {(r["target"], r["predictor"]): r["km"] for r in dist.collect()}
    assert len(km) == 16 and km["a", "b"] == km["b", "a"] and km["a", "a"] == 0 and km["a", "x"] is None
    conn = spatial.connectivity(stations, spark.createDataFrame([("a", "c"), ("a", "a"), ("a", "unknown")], "station string, contributor string"))
    w = {(r["target"], r["predictor"]): r["weight"] for r in spatial.weights(dist, conn).collect()}
    ab, ac = 1 / (km["a", "b"] + 1e-9), 1 / (km["a", "c"] + 1e-9)
    assert w["a", "b"] == pytest.approx(0.5 * ab / (ab + ac)) and w["a", "c"] == pytest.approx(0.5 * ac / (ab + ac) + 0.5)
    assert w["a", "x"] == 0 and all(w["x", s] == 0 for s in "abc")
    assert w["b", "a"] + w["b", "c"] == pytest.approx(1)
    far = {(r["target"], r["predictor"]): r["weight"] for r in spatial.weights(dist, spatial.connectivity(stations, None), "exponential", 0.01).collect()}
    assert far["a", "b"] == pytest.approx(math.exp(-0.01 * km["a", "b"]) / (math.exp(-0.01 * km["a", "b"]) + math.exp(-0.01 * km["a", "c"])))


def test_knn_against_numpy(spark):
    rng = np.random.default_rng(0)
    seed = {s: [None if rng.random() < 0.2 else float(x) for x in rng.normal(50, 10, 60)] for s in "abc"}
    part = {s: [None if rng.random() < 0.4 else float(x) for x in rng.normal(50, 10, 20)] for s in "abc"}
    part["c"] = [None] * 20  # missing throughout: the seed's mean
    got = knn.knn_fill(make(spark, seed), make(spark, part, datetime.date(1990, 1, 1))).orderBy("station", "dn").collect()
    got = np.array([r["filled"] for r in got]).reshape(3, 20).T
    x = np.array([[np.nan if v is None else v for v in seed[s]] for s in "abc"]).T
    y = np.array([[np.nan if v is None else v for v in part[s]] for s in "abc"]).T
    full = np.where(np.isnan(x), np.nanmean(x, 0), x)
    mean, scale = full.mean(0), full.std(0)
    zx, zy = (x - mean) / scale, (y - mean) / scale
    zy[:, 2] = 0.0
    for i in range(20):
        both = ~np.isnan(zx) & ~np.isnan(zy[i])
        d = np.sqrt(3 / np.maximum(both.sum(1), 1) * np.where(both, (zx - zy[i]) ** 2, 0).sum(1))
        d[both.sum(1) == 0] = np.inf
        for c in range(3):
            if np.isnan(zy[i, c]):
                donors = [k for k in np.argsort(d.round(8), kind="stable") if not np.isnan(zx[k, c]) and np.isfinite(d[k])][:5]
                want = (zx[donors, c].mean() if donors else 0.0) * scale[c] + mean[c]
            else:
                want = zy[i, c] * scale[c] + mean[c]
            assert got[i, c] == pytest.approx(want)


@pytest.mark.parametrize("start, end", [(400, 799), (0, 399), (1600, 1999), (0, 1999)])
def test_block_plans(spark, start, end):
    day = lambda k: DAY + datetime.timedelta(k)
    panel = make(spark, {"a": [1.0] * 2000})
    plan = blocks.plan(day(0), day(1999), day(start), day(end), 365)
    covered = sorted((b.start, b.end) for b in plan)
    days = {b.start + datetime.timedelta(k) for b in plan for k in range((b.end - b.start).days + 1)}
    assert len(days) == 2000 - (end - start + 1) and not days & {day(k) for k in range(start, end + 1)}
    assert all((b - a).days <= 365 for a, b in covered)
    table = blocks.plan_table(panel, spark.createDataFrame([(day(start), day(end))], "start_date date, end_date date"), 365)
    assert {(r["direction"], r["step"], r["start_date"], r["end_date"]) for r in table.collect()} == {(b.direction, b.step, b.start, b.end) for b in plan}
    assert blocks.window_days(3) == 1095 and blocks.window_days(5) == 1826


def test_knn_with_calendar(spark):
    rng = np.random.default_rng(1)
    seed = {s: [None if rng.random() < 0.2 else float(x) for x in rng.normal(50, 10, 60)] for s in "abc"}
    part = {s: [None if k == 3 or rng.random() < 0.4 else float(x) for k, x in enumerate(rng.normal(50, 10, 20))] for s in "abc"}
    start = datetime.date(1990, 1, 20)
    got = knn.knn_fill(make(spark, seed), make(spark, part, start), calendar=True).orderBy("station", "dn").collect()
    got = np.array([r["filled"] for r in got]).reshape(3, 20).T

    def wide(series, first, n):
        turn = 2 * np.pi * np.array([(first + datetime.timedelta(k)).timetuple().tm_yday for k in range(n)]) / 366
        return np.column_stack([[[np.nan if v is None else v for v in series[s]] for s in "abc"][c] for c in range(3)] + [np.sin(turn), np.cos(turn)])

    x, y = wide(seed, DAY, 60), wide(part, start, 20)
    full = np.where(np.isnan(x), np.nanmean(x, 0), x)
    mean, scale = full.mean(0), full.std(0)
    zx, zy = (x - mean) / scale, (y - mean) / scale
    for i in range(20):
        both = ~np.isnan(zx) & ~np.isnan(zy[i])
        d = np.sqrt(5 / both.sum(1) * np.where(both, (zx - zy[i]) ** 2, 0).sum(1)).round(8)
        for c in range(3):
            z = zx[[k for k in np.argsort(d, kind="stable") if not np.isnan(zx[k, c])][:5], c].mean() if np.isnan(zy[i, c]) else zy[i, c]
            assert got[i, c] == pytest.approx(z * scale[c] + mean[c])


def test_windows_have_no_single_partition(spark, data, capsys):
    """Two-level running counts equal plain ones over absent dates and block ends, and no window lacks a partition."""
    rng = np.random.default_rng(5)
    days = sorted(rng.choice(1500, 1400, replace=False).tolist())
    panel = spark.createDataFrame([(s, DAY + datetime.timedelta(k), (DAY - datetime.date(1970, 1, 1)).days + k, 1.0 if rng.random() < 0.7 else None) for k in days for s in "ab"], "station string, date date, dn int, value double").cache()
    counts = {r["dn"]: r["n_readings"] for r in panels.row_completeness(panel).collect()}
    for size in (1, 7, 40):
        want = {d: sum(counts[x] for x in range(d - size + 1, d + 1)) for d in counts if all(x in counts for x in range(d - size + 1, d + 1))}
        got = {(r["end_date"] - datetime.date(1970, 1, 1)).days: (r["score"], (r["end_date"] - r["start_date"]).days) for r in panels.windows(panel, size).collect()}
        assert got == {d: (n, size - 1) for d, n in want.items()}
    panels.best_window(panel, 7).explain()
    plan = capsys.readouterr().out
    assert "Window" in plan and not [line for line in plan.splitlines() if "Window" in line and "windowspecdefinition(block" not in line and "Exchange" not in line]


@pytest.mark.parametrize("seed", [0, 42, 7])
def test_numpy_plans(spark, seed):
    """One generator over all stations and sizes, as NumPy draws; sizes at and beyond the series' length."""
    panel = make(spark, {"b": [1.0] * 90, "a": [2.0] * 40, "c": [3.0] * 8})
    rng, want = np.random.RandomState(seed), set()
    for length in (3, 8, 60):
        for s, n in (("a", 40), ("b", 90), ("c", 8)):
            if length >= n:
                want.add((length, s, 0, n))
                continue
            starts, found = np.arange(n - length + 1), []
            rng.shuffle(starts)
            for x in starts.tolist():
                if all(x + length <= a or x >= a + length for a in found) and len(found) < max(int(np.floor(n * 0.2 / length)), 1):
                    found.append(x)
            want |= {(length, s, x, x + length) for x in found}
    plan = gaps.numpy_gaps(panel, (3, 8, 60), 20.0, seed=seed)
    assert {tuple(r) for r in plan.collect()} == want
    masked = gaps.apply_plan(panel, plan.where("gap_length = 3"))
    assert masked.where("is_gap").count() == sum(b - a for k, _, a, b in want if k == 3)
    rng, want = np.random.RandomState(seed), set()
    for rate in (30, 400):
        for s, n in (("a", 40), ("b", 90), ("c", 8)):
            k = int(n * (rate / 365.0)) or 1
            want |= {(float(rate), s, int(x)) for x in (np.arange(n) if k >= n else rng.choice(n, k, replace=False))}
    plan = gaps.numpy_points(panel, (30, 400), seed)
    assert {tuple(r) for r in plan.collect()} == want
    assert gaps.apply_plan(panel, plan.where("days_a_year = 400")).where("NOT is_gap").count() == 0
    assert gaps.numpy_points(panel.limit(0), (30,)).count() == 0 and gaps.numpy_gaps(panel.limit(0), (3,)).count() == 0


def test_distances_near_antipodes(spark):
    """Published lengths of geodesics (Karney, 2013) and half a meridian; either direction gives the same."""
    from lacuna.functions import geodesic_km

    rows = [(0.0, 0.0, 0.5, 179.5, 19936.288578965), (-30.0, 0.0, 29.9, 179.8, 19989.832827610), (0.0, 0.0, 0.0, 180.0, 20003.931458625), (30.0, 10.0, -30.0, -170.0, 20003.931458625), (90.0, 0.0, -90.0, 55.0, 20003.931458625), (0.0, 179.0, 0.0, -179.0, 222.638981587), (10.0, 10.0, 10.0, 10.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, km double")
    for r in df.select("km", geodesic_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("x"), geodesic_km(F.col("c"), F.col("d"), F.col("a"), F.col("b")).alias("y")).collect():
        assert r["x"] == pytest.approx(r["km"], abs=1e-6) and r["y"] == pytest.approx(r["x"], abs=1e-9)
    unknown = spark.createDataFrame([(None, 1.0, 2.0, 3.0), (1.0, 2.0, 3.0, None)], "a double, b double, c double, d double")
    assert [r[0] for r in unknown.select(geodesic_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()] == [None, None]
