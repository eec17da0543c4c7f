"""Evaluators backed by the exact DataFrame metrics (custom ``Evaluator`` for A7)."""

from __future__ import annotations

from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wearline.operators.metrics import ranking_metrics


class AveragePrecisionEvaluator(Evaluator):
    """PR-AUC as the step sum (sklearn's ``average_precision``), not Spark's interpolated areaUnderPR."""

    def __init__(self, labelCol: str = "machine_failure", probabilityCol: str = "probability"):
        super().__init__()
        self.labelCol = labelCol
        self.probabilityCol = probabilityCol

    def _evaluate(self, dataset) -> float:
        s = dataset.select(F.col(self.labelCol).cast("int").alias("y"),
                           vector_to_array(F.col(self.probabilityCol)).getItem(1).alias("s"))
        row = ranking_metrics(s, "y", "s").first()
        return float(row["average_precision"] or 0.0)

    def isLargerBetter(self) -> bool:
        return True
