"""Outcome and quality metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import arrays, prefix
from tidewatch.params import MESSAGE_BYTES


def earliest_local(stops: DataFrame, keys: list[str]) -> DataFrame:
    return stops.groupBy(*keys).agg(F.min("stop").alias("local_stop"))


def strict_lead(global_stops: DataFrame, local: DataFrame, keys: list[str]) -> DataFrame:
    """Outcome rows: the indicator needs both stops and a strictly earlier global one."""
    both = global_stops.join(local, keys, "left")
    return (
        both.withColumn("indicator", F.coalesce((F.col("stop") < F.col("local_stop")).cast("int"), F.lit(0)))
        .withColumn("detected", F.col("stop").isNotNull().cast("int"))
        .withColumn("detected_without_lead", ((F.col("detected") == 1) & (F.col("indicator") == 0)).cast("int"))
    )


def leads(outcomes: DataFrame, latency_seconds: float, epoch_seconds: int) -> DataFrame:
    """Statistical and operational lead; null unless both stops exist."""
    lead = F.col("local_stop") - F.col("stop")
    return outcomes.withColumn("statistical_lead", lead).withColumn(
        "operational_lead", lead - F.lit(latency_seconds / epoch_seconds)
    )


def rates(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    return outcomes.groupBy(*keys).agg(
        F.count("*").alias("campaigns"), F.avg("indicator").alias("lead_rate"), F.avg("detected").alias("detection_rate")
    )


def false_campaigns_per_10k(false_stops: Column, epochs: Column) -> Column:
    return F.lit(10000.0) * false_stops / epochs


def censored_stop(stop: Column, horizon: int, offset: int) -> Column:
    """For plots only; the raw stop keeps its null."""
    return F.coalesce(stop, F.lit(horizon + offset).cast("long"))


def slope(rows: DataFrame, keys: list[str], x: str, y: str, name: str = "derivative") -> DataFrame:
    return rows.groupBy(*keys).agg(F.regr_slope(y, x).alias(name))


def attenuation(derivative: Column, direct: Column, floor: float) -> Column:
    return F.lit(1.0) - F.abs(derivative) / (F.abs(direct) + F.lit(floor))


def _vector_moments(rows: DataFrame, keys: list[str], vector: str, width: int, tag: str) -> DataFrame:
    """Mean vector and trace of the covariance per key, in one pass."""
    return rows.groupBy(*keys).agg(
        F.array(*[F.avg(F.get(vector, F.lit(i))) for i in range(width)]).alias(f"mu_{tag}"),
        sum((F.coalesce(F.var_samp(F.get(vector, F.lit(i))), F.lit(0.0)) for i in range(width)), F.lit(0.0)).alias(f"trace_{tag}"),
    )


def standardized_drift(attack: DataFrame, null: DataFrame, keys: list[str], vector: str, width: int, floor: float) -> DataFrame:
    """``|mu1 - mu0| / max(sqrt(trace cov0), floor)`` per key (a key may name a proper subset)."""
    a, b = (_vector_moments(d, keys, vector, width, t) for d, t in ((attack, "1"), (null, "0")))

    def missing_as_zero(x: Column, y: Column) -> Column:
        return F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))

    gap = arrays.norm(F.zip_with("mu_1", "mu_0", missing_as_zero))
    return a.join(b, keys).select(
        *keys, (gap / F.greatest(F.sqrt("trace_0"), F.lit(floor))).alias("drift")
    )


def target_drift(attack: DataFrame, null: DataFrame, keys: list[str], value: str, floor: float) -> DataFrame:
    a = attack.groupBy(*keys).agg(F.avg(value).alias("m1"))
    b = null.groupBy(*keys).agg(F.avg(value).alias("m0"), F.stddev_samp(value).alias("s0"))
    return a.join(b, keys).select(
        *keys, ((F.col("m1") - F.col("m0")) / F.greatest("s0", F.lit(floor))).alias("target_drift")
    )


def atom_agreement(pairs: DataFrame, keys: list[str], left: str, right: str, floor: float) -> DataFrame:
    """Normalised error and cosine of two atom columns of the same rows."""
    gap = F.zip_with(left, right, lambda a, b: a - b)
    sums = pairs.groupBy(*keys).agg(
        F.avg(arrays.dot(gap, gap)).alias("ee"),
        F.avg(arrays.dot(F.col(left), F.col(left))).alias("ll"),
        F.avg(arrays.dot(F.col(right), F.col(right))).alias("rr"),
        F.avg(arrays.dot(F.col(left), F.col(right))).alias("lr"),
        F.count("*").alias("n"),
    )
    n = F.col("n")
    cosine = F.col("lr") * n / (F.sqrt(F.col("ll") * n) * F.sqrt(F.col("rr") * n) + F.lit(floor))
    return sums.select(
        *keys, (F.sqrt("ee") / (F.sqrt("ll") + F.lit(floor))).alias("nrmse"), cosine.alias("cosine")
    )


def projection_nrmse(rows: DataFrame, keys: list[str], fitted: str, truth: str, tensor: str, floor: float) -> DataFrame:
    gap = F.zip_with(fitted, truth, lambda a, b: a - b)
    return rows.groupBy(*keys).agg(
        (
            F.sqrt(F.avg(arrays.dot(gap, gap)))
            / (F.sqrt(F.avg(arrays.dot(F.col(tensor), F.col(tensor)))) + F.lit(floor))
        ).alias("projection_nrmse")
    )


def null_bias(rows: DataFrame, keys: list[str], vector: str, width: int, floor: float) -> DataFrame:
    m = _vector_moments(rows, keys, vector, width, "0")
    length = arrays.norm(F.transform("mu_0", lambda x: F.coalesce(x, F.lit(0.0))))
    return m.select(*keys, (length / F.greatest(F.sqrt("trace_0"), F.lit(floor))).alias("null_bias"))


def mean_absolute_error(rows: DataFrame, keys: list[str], estimate: str, truth: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(F.abs(F.col(estimate) - F.col(truth))).alias("mae"))


def paired_stops(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Stop difference of finite pairs and the detection difference of all pairs."""
    joined = left.select(*keys, F.col("stop").alias("a")).join(right.select(*keys, F.col("stop").alias("b")), keys)
    return joined.select(
        *keys,
        (F.col("a") - F.col("b")).alias("stop_difference"),
        (F.col("a").isNotNull().cast("int") - F.col("b").isNotNull().cast("int")).alias("detection_difference"),
    )


def suppression(pfa: Column, raw_pfa: Column, floor: float) -> Column:
    return F.lit(1.0) - pfa / (raw_pfa + F.lit(floor))


def ranking_quality(rows: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """AUROC (ties count half) and average precision; both null without positives, AUROC not a number without negatives.

    Rows shrink to counts per distinct score before they are ordered, and the ordering runs in
    value buckets, so a common score or a large key costs no single task.
    """
    p = F.col(positive).cast("long")
    counts = rows.groupBy(*keys, F.col(score).cast("double").alias("_v")).agg(
        F.sum(p).alias("_p"), F.sum(1 - p).alias("_n")
    ).withColumn("_down", -F.col("_v"))
    ran = prefix.running_sums(
        counts, keys, ["_down"], prefix.magnitude_bucket("_down"), {"cp": "_p", "cn": "_n"}, whole=True
    )
    wins = (F.col("cn_all") - F.col("cn")) * F.col("_p") + F.col("_n") * F.col("_p") * 0.5
    precision = F.col("_p") * F.col("cp") / (F.col("cp") + F.col("cn"))
    sums = ran.groupBy(*keys).agg(
        F.sum(wins).alias("w"), F.sum(precision).alias("ap"), F.max("cp_all").alias("positives"), F.max("cn_all").alias("negatives")
    )
    found = F.col("positives") > 0
    pairs = F.col("positives") * F.col("negatives")
    return sums.select(
        *keys, "positives", "negatives",
        F.when(found & (pairs == 0), F.lit(float("nan"))).when(found, F.col("w") / pairs).alias("auroc"),
        F.when(found, F.col("ap") / F.col("positives")).alias("average_precision"),
    )


def payload(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg((F.count("*") * MESSAGE_BYTES).alias("payload_bytes"))
