"""Collected queries, their SQL and the flagship query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import sequential
from tidewatch.params import PARTITIONS
from tidewatch.plans import queries as _q
from tidewatch.plans import queries_model, queries_rest  # noqa: F401  (they register their queries)
from tidewatch.plans.workload import Workload


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """First crossing of the recursion over fused-rank evidence, per held-out benign horizon."""
    w = Workload(spark, folder)
    rows = w.horizon_rows(w.fusion_evidence(), PARTITIONS[3])
    states = sequential.global_state(rows, ["horizon_id"])
    return sequential.global_stops(states.withColumn("supported", F.lit(True)), ["horizon_id"], w.p.thresholds)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_q.SQL)
