"""Evidence factors and their aggregation over coalitions and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import arrays
from tidewatch.params import OPERATIONAL_COMPENSATOR


def compensator(bound: float, bet: float) -> float:
    return bet * bet * (2.0 * bound) ** 2 / 8.0


def signed_factor(statistic: Column, bound: float, bet: float) -> Column:
    return F.exp(F.lit(bet) * arrays.clip(statistic, -bound, bound) - F.lit(compensator(bound, bet)))


def signed_statistic(atom: Column, coefficient: float, bound: float) -> Column:
    """First coordinate with the sign of a coefficient fixed in advance, clipped."""
    if coefficient == 0.0:
        raise ValueError("signed evidence needs a non-zero coefficient")
    sign = 1.0 if coefficient > 0 else -1.0
    return arrays.clip(F.element_at(atom, 1) * F.lit(sign), -bound, bound)


def norm_statistic(norm: Column, reference: Column, floor: float, bound: float) -> Column:
    return arrays.clip(norm / F.greatest(reference, F.lit(floor)) - F.lit(1.0), -bound, bound)


def operational_factor(norm: Column, reference: Column, floor: float, bound: float, bet: float) -> Column:
    """The compensator of this route is one fixed value, whatever the bound and the bet."""
    return F.exp(F.lit(bet) * norm_statistic(norm, reference, floor, bound) - F.lit(OPERATIONAL_COMPENSATOR))


def coalition_evidence(scored: DataFrame, floor: float, bound: float, bet: float) -> DataFrame:
    return scored.withColumn(
        "factor", operational_factor(arrays.norm(F.col("atom")), F.col("q_norm"), floor, bound, bet)
    )


def order_evidence(evidence: DataFrame, keys: list[str], orders: tuple[int, ...], epochs: DataFrame | None = None) -> DataFrame:
    """Mean factor per enabled order (columns ``e1``..); one where no coalition is active.

    ``epochs`` lists key rows that must appear even when every coalition abstains.
    """
    means = evidence.groupBy(*keys).agg(
        *[F.avg(F.when(F.col("ord") == r, F.col("factor"))).alias(f"e{r}") for r in orders]
    )
    if epochs is not None:
        means = epochs.select(*keys).join(means, keys, "left")
    return means.select(*keys, *[F.coalesce(f"e{r}", F.lit(1.0)).alias(f"e{r}") for r in orders])


def combine_orders(by_order: DataFrame, keys: list[str], methods: dict[str, tuple[int, ...]], extra: tuple[str, ...] = ()) -> DataFrame:
    """Equal mean over the enabled orders, one row per method; all methods in one plan."""
    options = []
    for name, orders in methods.items():
        if not orders:
            raise ValueError("the enabled order set must not be empty")
        mean = sum((F.col(f"e{r}") for r in orders), F.lit(0.0)) / F.lit(float(len(orders)))
        options.append(F.struct(F.lit(name).alias("method"), mean.alias("factor")))
    return by_order.select(*keys, *extra, F.explode(F.array(*options)).alias("m")).select(
        F.col("m.method").alias("method"), *keys, *extra, F.col("m.factor").alias("factor")
    )


def evidence_growth(evidence: DataFrame, keys: list[str]) -> DataFrame:
    return evidence.groupBy(*keys).agg(F.avg(F.log("factor")).alias("log_growth"))


def order_shares(by_order: DataFrame, orders: tuple[int, ...], floor: float, tolerance: float) -> DataFrame:
    """Share of each order and the decisive order (largest evidence above one, ties to the smaller)."""
    total = sum((F.col(f"e{r}") for r in orders), F.lit(0.0)) + F.lit(floor)
    out = by_order
    for r in orders:
        out = out.withColumn(f"share{r}", F.col(f"e{r}") / total)
    logs = [F.when(F.col(f"e{r}") > 1.0, F.log(f"e{r}")) for r in orders]
    best = F.greatest(*logs) if len(logs) > 1 else logs[0]
    decisive = F.coalesce(*[F.when(lg >= best - F.lit(tolerance), F.lit(r)) for r, lg in zip(orders, logs, strict=True)])
    return out.withColumn("decisive_order", decisive)
