"""The parameters of a run in one object, stored beside its results."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

from tributary.operators import evaluate, matcher


@dataclass(frozen=True)
class RunConfig:
    """What a run of training and evaluation depends on beside its tables.

    ``sample`` is the number of S1 records to evaluate (all by default), ``universe`` the targets they may meet ("all", or "truth" for
    a quick check), ``threshold`` a fixed one instead of the best of ``thresholds``.
    """

    sample: int | None = None
    universe: str = "all"
    mode: str = "multiset"
    negatives: int = matcher.NEGATIVES
    seed: int = matcher.SEED
    thresholds: tuple[float, ...] = evaluate.THRESHOLDS
    threshold: float | None = None

    def __post_init__(self) -> None:
        if self.universe not in ("all", "truth") or self.mode not in ("multiset", "distinct"):
            raise ValueError("universe is all or truth, mode is multiset or distinct")
        if not self.thresholds or not all(0 <= x <= 1 for x in self.thresholds):
            raise ValueError("thresholds are one or more of 0 to 1")

    def write(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> RunConfig:
        said = json.loads(spark.read.text(path).first()[0])
        return RunConfig(**{**said, "thresholds": tuple(said["thresholds"])})
