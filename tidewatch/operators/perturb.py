"""Controlled changes of score and rank tables (mechanism and robustness checks)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def target_clients(clients: list[str], count: int) -> list[str]:
    return sorted(clients)[:count]


def shift_scores(rows: DataFrame, clients: list[str], shift: float | Column) -> DataFrame:
    """Add ``shift`` (a number or a column) to the scores of the listed clients."""
    amount = shift if isinstance(shift, Column) else F.lit(shift)
    return rows.withColumn("score", F.col("score") + F.when(F.col("client_id").isin(clients), amount).otherwise(F.lit(0.0)))


def contaminated_clients(outside: list[str], fraction: float) -> list[str]:
    """First clients in order, their number rounded half up."""
    return sorted(outside)[: math.floor(fraction * len(outside) + 0.5)]


def contaminate_ranks(rows: DataFrame, clients: list[str], shift: float, epsilon: float) -> DataFrame:
    """Raise outside ranks, cut at ``1 - epsilon`` from above only."""
    raised = F.least(F.col("rank") + F.lit(shift), F.lit(1.0 - epsilon))
    return rows.withColumn("rank", F.when(F.col("client_id").isin(clients), raised).otherwise(F.col("rank")))


def nuisance(statistic: Column, transform: str) -> Column:
    if transform == "linear":
        return statistic
    if transform == "tanh":
        return F.tanh(statistic * 2.0)
    if transform == "softplus":
        return F.log1p(F.exp(statistic)) - F.lit(math.log(2.0))
    raise ValueError(f"unknown transform {transform}")


def scalar_innovation(rows: DataFrame, keys: list[str], members: list[str], context: list[str], transform: str) -> DataFrame:
    """Mean score of a coalition minus the transformed mean score of its context."""
    mean = lambda ids: F.avg(F.when(F.col("client_id").isin(ids), F.col("score")))
    return rows.groupBy(*keys).agg(mean(members).alias("response"), mean(context).alias("context")).withColumn(
        "innovation", F.col("response") - nuisance(F.col("context"), transform)
    )
