"""Local stopping policies of single clients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import binomial
from tidewatch.functions.quantiles import exact_quantiles


def candidate_thresholds(nuisance: DataFrame, quantiles: tuple[float, ...]) -> DataFrame:
    """Linear quantiles of each client's nuisance scores."""
    packed = exact_quantiles(nuisance, ["client_id"], "score", quantiles)
    return packed.select("client_id", F.posexplode("q").alias("q_index", "threshold"))


def persistence(exceeded: Column, m: int, n: int, keys: list[str], pos: str) -> Column:
    """At least ``m`` exceedances among the current and the ``n - 1`` epochs before it."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(-(n - 1), 0)
    return F.sum(exceeded.cast("int")).over(w) >= m


def local_stops(rows: DataFrame, keys: list[str], pos: str, choices: tuple[tuple[int, int], ...]) -> DataFrame:
    """First stop per sequence for every ``(m, n)``.

    ``rows`` has ``score`` and ``threshold``; ``keys`` name one sequence (client, candidate,
    horizon or campaign), whose length is the horizon. All choices share one shuffle.
    """
    out = rows.withColumn("exceeded", F.col("score") >= F.col("threshold"))
    flags = []
    for i, (m, n) in enumerate(choices):
        out = out.withColumn(f"_f{i}", persistence(F.col("exceeded"), m, n, keys, pos))
        flags.append(
            F.struct(
                F.lit(m).alias("m"), F.lit(n).alias("n"), F.min(F.when(F.col(f"_f{i}"), F.col(pos))).alias("stop")
            )
        )
    return (
        out.groupBy(*keys, "threshold")
        .agg(F.array(*flags).alias("_s"))
        .select(*keys, "threshold", F.explode("_s").alias("_s"))
        .select(*keys, "threshold", "_s.m", "_s.n", "_s.stop")
    )


def false_stops(stops: DataFrame) -> DataFrame:
    return stops.groupBy("client_id", "threshold", "m", "n").agg(
        F.count("*").alias("horizons"), F.count("stop").alias("false_stops")
    )


def choose_policy(counts: DataFrame, confidence: float, target: float) -> DataFrame:
    """Least stringent policy, ordered by (threshold, m, n), whose bound meets the target."""
    ok = binomial.bound_within(F.col("false_stops"), F.col("horizons"), confidence, target)
    chosen = counts.groupBy("client_id").agg(F.min(F.when(ok, F.struct("threshold", "m", "n"))).alias("p"))
    return chosen.select(
        "client_id",
        F.col("p.threshold").alias("threshold"),
        F.col("p.m").alias("m"),
        F.col("p.n").alias("n"),
        F.when(F.col("p").isNull(), "Operating Point Unavailable").otherwise("Available").alias("operating_point"),
    )


def policy_stops(rows: DataFrame, policies: DataFrame, keys: list[str], pos: str, choices: tuple[tuple[int, int], ...]) -> DataFrame:
    """Stops of the chosen policies; there is one policy per selected client."""
    joined = rows.join(policies.select("client_id", "threshold", F.col("m").alias("_m"), F.col("n").alias("_n")), "client_id")
    held = joined.filter(F.col("threshold").isNotNull())
    stops = local_stops(held.select(*rows.columns, "threshold", "_m", "_n"), [*keys, "_m", "_n"], pos, choices)
    return stops.filter((F.col("m") == F.col("_m")) & (F.col("n") == F.col("_n"))).drop("_m", "_n")


def empirical_pfa(stops: DataFrame, keys: list[str], confidence: float) -> DataFrame:
    """Share of stopped sequences with its one-sided exact bound."""
    return stops.groupBy(*keys).agg(F.count("*").alias("horizons"), F.count("stop").alias("false_stops")).withColumn(
        "pfa", F.col("false_stops") / F.col("horizons")
    ).withColumn("pfa_upper", binomial.upper_bound(F.col("false_stops"), F.col("horizons"), confidence))
