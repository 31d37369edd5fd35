"""The metrics of filled gaps as a measure for tuning: forests' depth, weights' decay or starts can be chosen by a ``CrossValidator``.

What is tuned sees a panel with artificial gaps (``gaps.apply_plan``); the evaluator holds what was there. It
joins a model's fill with the truth of the gaps, so readings that were never masked don't count, and folds
may take any rows (days, best by a fold column) of the masked panel."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics

#: Metrics of which less is better.
ERRORS = ("rmse", "mae")


class GapEvaluator(Evaluator):
    """One metric of a fill (station, date, filled) over the gaps of ``gapped`` (station, date, true_value, is_gap).

    Gaps without a true value don't count. Without a single gap in what is evaluated, or where the metric is
    undefined, the result is the worst there is, so that such a setting isn't chosen."""

    metricName = Param(Params._dummy(), "metricName", f"one of {metrics.NAMES}", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "column of the fill", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, gapped: DataFrame, metricName: str = "kge", predictionCol: str = "filled"):
        super().__init__()
        if metricName not in metrics.NAMES:
            raise ValueError(f"no metric {metricName}; there are {metrics.NAMES}")
        self._truth = gapped.where("is_gap AND true_value IS NOT NULL").select("station", "date", F.col("true_value").alias("__truth"))
        self._set(metricName=metricName, predictionCol=predictionCol)

    def isLargerBetter(self) -> bool:
        return self.getOrDefault(self.metricName) not in ERRORS

    def _evaluate(self, dataset: DataFrame) -> float:
        own = dataset.select("station", "date", F.col(f"`{self.getOrDefault(self.predictionCol)}`").alias("__filled"))
        found = metrics.evaluate(self._truth.join(own, ["station", "date"]), (), "__truth", "__filled").first()
        value = found[self.getOrDefault(self.metricName)]
        return float(value) if value is not None else float("-inf" if self.isLargerBetter() else "inf")
