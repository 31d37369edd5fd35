"""Agreement of truth and prediction, pooled over all rows of a group. Undefined metrics are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = ("rmse", "mae", "r2", "nse", "kge")


def metric_columns(truth: str = "true_value", pred: str = "filled") -> list[Column]:
    """n and the five metrics as aggregates of one pass; pairs with a missing side don't count."""
    both = F.col(truth).isNotNull() & F.col(pred).isNotNull() & ~F.isnan(truth) & ~F.isnan(pred)
    t, p = F.when(both, F.col(truth)), F.when(both, F.col(pred))
    n = F.count(t)
    total = F.var_pop(t) * n
    r2 = F.when(total > 0, 1 - F.sum(F.pow(t - p, 2)) / total)
    spread = F.stddev_pop(t) * F.stddev_pop(p)
    r = F.when(spread > 0, F.covar_pop(t, p) / spread).otherwise(0.0)
    ratio = lambda a, b: F.when(b != 0, a / F.when(b != 0, b)).when((b == 0) & (a == 0), 1.0)
    beta, gamma = ratio(F.avg(p), F.avg(t)), ratio(F.stddev_pop(p), F.stddev_pop(t))
    kge = 1 - F.sqrt(F.pow(r - 1, 2) + F.pow(beta - 1, 2) + F.pow(gamma - 1, 2))
    return [n.alias("n"), F.sqrt(F.avg(F.pow(t - p, 2))).alias("rmse"), F.avg(F.abs(t - p)).alias("mae"), r2.alias("r2"), r2.alias("nse"), kge.alias("kge")]


def evaluate(df: DataFrame, by: tuple[str, ...] = (), truth: str = "true_value", pred: str = "filled") -> DataFrame:
    return df.groupBy(*by).agg(*metric_columns(truth, pred))


def evaluate_gaps(original: DataFrame, gapped: DataFrame, filled: DataFrame, only_known: bool = True, pred: str = "filled") -> DataFrame:
    """Metrics over the cells that ``gapped`` lacks (and, if ``only_known``, ``original`` has), joined by (station, date)."""
    truth = original.select("station", "date", F.col("value").alias("true_value"))
    cells = gapped.where("value IS NULL").select("station", "date").join(truth, ["station", "date"])
    if only_known:
        cells = cells.where("true_value IS NOT NULL")
    return evaluate(cells.join(filled.select("station", "date", pred), ["station", "date"]), (), "true_value", pred)
