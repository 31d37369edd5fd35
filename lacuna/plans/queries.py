"""One query an operator, over the order tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean_station_name, parse_coordinate, to_number
from ..operators import blocks, fills, gaps, knn, metrics, spatial
from ..operators import panel as panels
from ..operators.forest import ChainedForest, InitialisedForest, IterativeForest, Settings
from ..operators.kalman import kalman_fill
from ..sources import tables
from ..sources.checkpoints import cut
from . import demo, evaluation

SEED_DAYS = blocks.window_days(3)
GAP_LENGTHS, PERCENT = (3, 7, 30, 100), 10.0

NAMES = [" Parm anpur ", "Bamni'dih", "BAMNIDIH", 'Kes"inga', "Tika`ra\tpara", "none", "", "a'b\"c`d e"]
COORDINATES = ["21°50'02\"", "21.5", "-21 30", "-21 N", "21 S", "181", "abc", "81°36'21\" E", "81 36 21 W", "12o30'", "", "-95", "7 8 9 10", "S 10", "90", "-90.0", "5."]
NUMBERS = ["1", " 2.5 ", "-3e2", "abc", "", "4,5", "NaN", "1.", ".5", "12abc", "0007"]


def _date(c: str = "date"):
    return F.col(c).cast("string").alias(c)


def _r(c, digits: int = 6):
    return F.round(c, digits)


def panel_daily(spark, sf_dir):
    return demo.panel(spark, sf_dir).select("station", _date(), "dn", "value")


def _fill(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fills.fill(demo.panel(spark, sf_dir), method).select("station", _date(), _r("filled").alias("filled"), "was_missing")

    return query


def best_window(spark, sf_dir):
    return panels.best_window(demo.panel(spark, sf_dir), SEED_DAYS).select(_date("start_date"), _date("end_date"), "score")


def rolling_completeness(spark, sf_dir):
    return panels.windows(demo.panel(spark, sf_dir), SEED_DAYS).select(_date("start_date"), _date("end_date"), "score")


def row_completeness(spark, sf_dir):
    return panels.row_completeness(demo.panel(spark, sf_dir)).select(_date(), "n_readings")


def null_counts(spark, sf_dir):
    return panels.null_counts(demo.panel(spark, sf_dir))


def year_completeness(spark, sf_dir):
    return panels.year_completeness(demo.panel(spark, sf_dir), 2, 20.0).withColumn("percent", _r("percent"))


def temporal_features(spark, sf_dir):
    dates = demo.panel(spark, sf_dir).select("date").distinct()
    return panels.with_calendar(dates).select(_date(), _r("day_of_year_sin", 9).alias("day_of_year_sin"), _r("day_of_year_cos", 9).alias("day_of_year_cos"))


def clean_names(spark, sf_dir):
    given = spark.createDataFrame([(x,) for x in NAMES], "raw string")
    made = demo.table(spark, sf_dir, "part").select(F.concat(F.lit(" "), F.upper("p_name"), F.lit("'s\t`X\" ")).alias("raw"))
    return given.unionByName(made).unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS raw")).select("raw", clean_station_name(F.col("raw")).alias("clean"))


def parse_dms(spark, sf_dir):
    given = spark.createDataFrame([(x,) for x in COORDINATES], "raw string")
    made = demo.coordinates(spark, sf_dir)
    raw = given.unionByName(made.select(F.col("latitude_text").alias("raw"))).unionByName(made.select(F.col("longitude_text").alias("raw")))
    return raw.select("raw", _r(parse_coordinate(F.col("raw"), True), 9).alias("latitude"), _r(parse_coordinate(F.col("raw"), False), 9).alias("longitude"))


def coerce_numeric(spark, sf_dir):
    given = spark.createDataFrame([(x,) for x in NUMBERS], "raw string")
    made = demo.table(spark, sf_dir, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise("")).alias("raw"))
    return given.unionByName(made).select("raw", to_number(F.col("raw")).alias("number"))


def canonical_stations(spark, sf_dir):
    places = demo.coordinates(spark, sf_dir).where("latitude < 23")
    return spatial.canonical_stations(demo.panel(spark, sf_dir), places)


def contrib_edges(spark, sf_dir):
    edges = spatial.edges_from_matrix(demo.matrix(spark, sf_dir), "code", "Name of site")
    return spatial.keep_known(edges, demo.keys(spark, sf_dir))


def connectivity(spark, sf_dir):
    return spatial.connectivity(demo.keys(spark, sf_dir), contrib_edges(spark, sf_dir))


def _distances(spark, sf_dir):
    return spatial.distances(demo.keys(spark, sf_dir), demo.coordinates(spark, sf_dir))


def distance_matrix(spark, sf_dir):
    return _distances(spark, sf_dir).withColumn("km", _r("km"))


def _weights(kind: str, edges: bool = True, rate: float = 0.1):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        held = contrib_edges(spark, sf_dir) if edges else None
        conn = spatial.connectivity(demo.keys(spark, sf_dir), held)
        return spatial.weights(_distances(spark, sf_dir), conn, kind, rate).withColumn("weight", _r("weight", 9))

    return query


def gaps_points(spark, sf_dir):
    panel = demo.panel(spark, sf_dir)
    return gaps.apply_plan(panel, gaps.point_gaps(panel, 30)).where("is_gap").select("station", _date(), "true_value")


def gaps_contiguous(spark, sf_dir):
    return gaps.contiguous_gaps(demo.panel(spark, sf_dir), 7)


def gaps_by_percent(spark, sf_dir):
    return gaps.contiguous_gaps_by_percent(demo.panel(spark, sf_dir), 30, PERCENT)


def _seed(spark, sf_dir) -> tuple[DataFrame, tuple]:
    panel = demo.panel(spark, sf_dir)
    return panel, panels.find_best_window(panel, demo.FIRST, demo.LAST, SEED_DAYS)


def seed_eval_split(spark, sf_dir):
    panel, ends = _seed(spark, sf_dir)
    both = panels.between(panel, *ends).withColumn("part", F.lit("seed")).unionByName(panels.outside(panel, *ends).withColumn("part", F.lit("evaluation")))
    return both.groupBy("part").agg(F.count("*").alias("n_rows"), F.count("value").alias("n_readings"), F.min("dn").alias("first_dn"), F.max("dn").alias("last_dn"))


def block_plan(spark, sf_dir):
    panel = demo.panel(spark, sf_dir)
    return blocks.plan_table(panel, panels.best_window(panel, SEED_DAYS), blocks.window_days(1)).select("direction", "step", _date("start_date"), _date("end_date"))


def block_plan_expand(spark, sf_dir):
    plan = block_plan(spark, sf_dir)
    return plan.groupBy("step").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.count("*").alias("n_blocks"))


def _gap_cells(spark, sf_dir) -> DataFrame:
    """All gap lengths at once: the panel outside of the seed, by scenario."""
    panel, ends = _seed(spark, sf_dir)
    outside = cut(panels.outside(panel, *ends))
    cells = None
    for length in GAP_LENGTHS:
        part = gaps.apply_plan(outside, gaps.contiguous_gaps_by_percent(outside, length, PERCENT)).withColumn("gap_scenario", F.lit(f"{length}-day_gap"))
        cells = part if cells is None else cells.unionByName(part)
    return cells


def _leaderboard(methods):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        keys = ("gap_scenario", "station")
        filled = _gap_cells(spark, sf_dir).withColumns({m: fills.METHODS[m](keys) for m in methods}).where("is_gap AND true_value IS NOT NULL")
        long = filled.select("gap_scenario", "true_value", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("filled")) for m in methods])).alias("x")).select("gap_scenario", "true_value", "x.*")
        found = metrics.evaluate(long, ("gap_scenario", "method")).orderBy("gap_scenario", "method")
        return found.select("gap_scenario", "method", "n", *[_r(m).alias(m) for m in metrics.NAMES])

    return query


def _gap_kinds(*sizes):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = evaluation.evaluate_gap_kinds(demo.panel(spark, sf_dir), *sizes)
        return found.select("gap_type", "gap_length", "n", *[_r(m).alias(m) for m in metrics.NAMES])

    return query


def _region(spark, sf_dir) -> tuple[DataFrame, tuple]:
    """The panel by region, and its best window."""
    panel = cut(demo.panel(spark, sf_dir, "region"))
    return panel, panels.find_best_window(panel, demo.FIRST, demo.LAST, SEED_DAYS)


def _region_parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The best window and everything outside of it."""
    panel, ends = _region(spark, sf_dir)
    return panels.between(panel, *ends), panels.outside(panel, *ends)


def scale_stats(spark, sf_dir):
    return knn.scale_stats(_region_parts(spark, sf_dir)[0]).select("station", _r("mean").alias("mean"), _r("scale").alias("scale"))


def knn_fill(spark, sf_dir):
    return knn.knn_fill(*_region_parts(spark, sf_dir)).select("station", _date(), _r("filled", 4).alias("filled"), "was_missing")


def knn_fill_calendar(spark, sf_dir):
    return knn.knn_fill(*_nation_parts(spark, sf_dir), calendar=True).select("station", _date(), _r("filled", 4).alias("filled"), "was_missing")


def _nation(spark, sf_dir) -> tuple[DataFrame, tuple]:
    """The panel by nation, written, and its best window."""
    panel = cut(demo.panel(spark, sf_dir))
    return panel, panels.find_best_window(panel, demo.FIRST, demo.LAST, SEED_DAYS)


def _nation_parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The best window and everything outside of it."""
    panel, ends = _nation(spark, sf_dir)
    return panels.between(panel, *ends), panels.outside(panel, *ends)


#: Size of the models in the queries: trees as the reference has; README has the time that more passes take.
MODELS = {"n_estimators": 100, "max_depth": 10}
SIDE_BY_SIDE = {"update": "jacobi", "max_iter": 3}
ONE_BY_ONE = {"update": "gauss_seidel", "max_iter": 1}
EVALUATED = {"n_estimators": 100, "max_depth": 0, "max_bins": 0, "update": "jacobi", "max_iter": 10}  # the reference's: whole trees, up to ten passes


def _settings(spark, sf_dir, **options) -> Settings:
    return Settings(cut(_distances(spark, sf_dir)), cut(connectivity(spark, sf_dir)), **MODELS | SIDE_BY_SIDE | options)


def held(filled: DataFrame, panel: DataFrame, trained: DataFrame | None = None) -> DataFrame:
    """What a model's fill must leave as it is, by station: rows, missing cells, cells still null, readings and marks that
    changed, and (with ``trained``) filled cells outside of the range of its readings. The last four are 0."""
    both = panel.select("station", "date", "value").join(filled.select("station", "date", "filled", "was_missing"), ["station", "date"], "full_outer")
    was = F.col("value").isNull()
    counts = {
        "n_missing": was,
        "n_left": F.col("filled").isNull(),
        "n_changed": ~was & ~F.col("filled").eqNullSafe(F.col("value")),
        "n_marked_wrong": ~F.col("was_missing").eqNullSafe(was),
    }
    if trained is not None:
        both = both.join(F.broadcast(trained.groupBy("station").agg(F.min("value").alias("low"), F.max("value").alias("high"))), "station", "left")  # a row a station
        counts["n_outside"] = was & ~F.col("filled").between(F.col("low") - 1e-9, F.col("high") + 1e-9)
    return both.groupBy("station").agg(F.count("*").alias("n_rows"), *[F.count_if(c).alias(name) for name, c in counts.items()])


def forest_base(spark, sf_dir):
    seed, part = _nation_parts(spark, sf_dir)
    return held(IterativeForest(_settings(spark, sf_dir, **ONE_BY_ONE)).fit(seed).transform(part), part, seed)


def forest_custom(spark, sf_dir):
    seed, part = _nation_parts(spark, sf_dir)
    return held(InitialisedForest(_settings(spark, sf_dir, initialization_method="historical_mean")).fit(seed).transform(part), part, seed)


def forest_vanilla(spark, sf_dir):
    seed, part = _nation_parts(spark, sf_dir)
    return held(IterativeForest(**MODELS | SIDE_BY_SIDE).fit(seed).transform(part), part, seed)


def forest_chained_equations(spark, sf_dir):
    seed, part = _nation_parts(spark, sf_dir)
    return held(ChainedForest(**MODELS | SIDE_BY_SIDE).fit(seed).transform(part), part, seed)


def forest_stump(spark, sf_dir):
    """One tree of one split a station, on all other stations: the fill itself."""
    seed, part = _nation_parts(spark, sf_dir)
    stump = IterativeForest(n_estimators=1, max_depth=1, max_bins=0, subset="all", bootstrap=False, calendar=False, update="jacobi", max_iter=1)
    return stump.fit(seed).transform(part).select("station", _date(), _r("filled").alias("filled"), "was_missing")


#: Parameters a, b, A, C of the state-space fill without a search.
GIVEN = (0.5, 0.1, 0.3, 0.1)


def kalman_given(spark, sf_dir):
    return kalman_fill(_nation(spark, sf_dir)[0], params=GIVEN).select("station", _date(), _r("filled", 4).alias("filled"), "was_missing")


def kalman(spark, sf_dir):
    panel = _nation(spark, sf_dir)[0]
    return held(cut(kalman_fill(panel)), panel)


def seed_and_fill(spark, sf_dir):
    panel = _nation(spark, sf_dir)[0]
    return held(blocks.seed_and_fill(panel, demo.FIRST, demo.LAST, SEED_DAYS, _settings(spark, sf_dir)), panel, panel)


def chaining(spark, sf_dir):
    panel, ends = _nation(spark, sf_dir)
    return held(blocks.chaining(panel, *ends, 3, _settings(spark, sf_dir)), panel, panel)


def expanding(spark, sf_dir):
    panel, ends = _nation(spark, sf_dir)
    return held(blocks.expanding(panel, *ends, 3, _settings(spark, sf_dir)), panel, panel)


def evaluation_all(spark, sf_dir):
    """All gap lengths and methods: cells, defined metrics, error; the RMSE of the methods that aren't fitted models."""
    settings = _settings(spark, sf_dir, **EVALUATED | {"initialization_method": "historical_mean"})
    found = evaluation.evaluate(demo.panel(spark, sf_dir), demo.FIRST, demo.LAST, settings)  # which writes the panel and finds its window
    defined = sum(F.col(m).isNotNull().cast("int") for m in metrics.NAMES)
    plain = F.col("method").isin("linear_interpolation", "historical_mean")
    return found.select("gap_scenario", "method", "n", defined.alias("n_metrics"), "error", F.when(plain, _r("rmse")).alias("rmse"))


def plot_series(spark, sf_dir):
    panel = demo.panel(spark, sf_dir)
    gapped = gaps.apply_plan(panel, gaps.contiguous_gaps(panel, 7))
    filled = gapped.withColumn("filled", fills.linear_time())
    return tables.series_data(filled).select("station", _date(), "true_value", "is_gap", _r("filled").alias("filled"))


QUERIES = {
    "panel_daily": panel_daily,
    "fill_column_mean": _fill("column_mean"),
    "fill_historical_mean": _fill("historical_mean"),
    "fill_seasonal_mean": _fill("seasonal_mean"),
    "fill_linear_time": _fill("linear_time"),
    "best_window": best_window,
    "rolling_completeness": rolling_completeness,
    "row_completeness": row_completeness,
    "null_counts": null_counts,
    "year_completeness": year_completeness,
    "temporal_features": temporal_features,
    "clean_names": clean_names,
    "parse_dms": parse_dms,
    "coerce_numeric": coerce_numeric,
    "canonical_stations": canonical_stations,
    "contrib_edges": contrib_edges,
    "connectivity": connectivity,
    "distance_matrix": distance_matrix,
    "weights_inverse": _weights("inverse"),
    "weights_exp": _weights("exponential", rate=0.01),
    "weights_no_contrib": _weights("inverse", False),
    "gaps_points": gaps_points,
    "gaps_contiguous": gaps_contiguous,
    "gaps_by_percent": gaps_by_percent,
    "seed_eval_split": seed_eval_split,
    "block_plan_chain": block_plan,
    "block_plan_expand": block_plan_expand,
    "metrics_historical": _leaderboard(("historical_mean",)),
    "metrics_seasonal": _leaderboard(("seasonal_mean",)),
    "metrics_linear": _leaderboard(("linear_time",)),
    "metrics_leaderboard": _leaderboard(tuple(fills.METHODS)),
    "metrics_gap_kinds": _gap_kinds((7, 30), (30, 90)),  # the sizes of its SQL
    "metrics_gap_kinds_all": _gap_kinds(),
    "plot_series": plot_series,
    "scale_stats": scale_stats,
    "knn_fill": knn_fill,
    "knn_fill_calendar": knn_fill_calendar,
    "forest_base": forest_base,
    "forest_custom": forest_custom,
    "forest_vanilla": forest_vanilla,
    "forest_chained_equations": forest_chained_equations,
    "forest_stump": forest_stump,
    "kalman_fill": kalman,
    "kalman_given": kalman_given,
    "seed_and_fill": seed_and_fill,
    "chaining": chaining,
    "expanding": expanding,
    "evaluation": evaluation_all,
}
