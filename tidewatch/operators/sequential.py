"""Sequential recursion, distributed support, stops and threshold calibration.

Sequences that restart with their horizon or campaign never exceed its length and are one window. Trajectories of any length are
scanned in chunks (:func:`entry_states`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import binomial
from tidewatch.session import written


def global_state(evidence: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """``G = (G + 1) * E`` from zero, in closed form: exp(L_t) * sum exp(-L_{s-1})."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    log_sum = evidence.withColumn("_l", F.sum(F.log("factor")).over(w))
    inner = F.sum(F.exp(-(F.col("_l") - F.log("factor")))).over(w)
    return log_sum.withColumn("state", F.exp("_l") * inner).drop("_l")


#: states are cut off here: a state this large has crossed any threshold, and products stay finite
_MOST = 1e300


def _chunk_steps(pos: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("factor").alias("f"))))


def entry_states(evidence: DataFrame, keys: list[str], pos: str = "pos", chunk: int = 1024) -> DataFrame:
    """(keys, _chunk, entry): the state before each chunk of ``chunk`` positions of a trajectory of any length.

    A step maps g to (g + 1) f, so a chunk maps g to a g + b. Maps of chunks are composed over doubling distances, the
    first chunk starts from zero; no trajectory is ever one row.
    """
    fold = lambda acc, s: F.struct(
        F.least(acc["a"] * s["f"], F.lit(_MOST)).alias("a"), F.least((acc["b"] + 1.0) * s["f"], F.lit(_MOST)).alias("b")
    )
    own = evidence.groupBy(*keys, F.floor(F.col(pos) / chunk).alias("_chunk")).agg(_chunk_steps(pos).alias("s"))
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    maps = own.select(*keys, "_chunk", F.aggregate("s", start, fold).alias("m")).select(*keys, "_chunk", "m.a", "m.b")
    order = Window.partitionBy(*keys).orderBy("_chunk")
    maps = written(maps.withColumn("_i", F.row_number().over(order)), "chunk-maps")
    most, distance = maps.agg(F.max("_i")).first()[0] or 0, 1
    while distance < most:
        before = [F.lag(c, distance).over(order) for c in ("a", "b")]
        joined = maps.withColumns({"_a": F.coalesce(before[0], F.lit(1.0)), "_b": F.coalesce(before[1], F.lit(0.0))})
        both = {"a": F.least(F.col("a") * F.col("_a"), F.lit(_MOST)), "b": F.least(F.col("a") * F.col("_b") + F.col("b"), F.lit(_MOST))}
        maps = written(joined.withColumns(both).drop("_a", "_b"), "chunk-maps")
        distance *= 2
    return maps.select(*keys, "_chunk", F.coalesce(F.lag("b").over(order), F.lit(0.0)).alias("entry"))


def stops_by_fold(evidence: DataFrame, keys: list[str], threshold: float, pos: str = "pos", chunk: int = 1024) -> DataFrame:
    """First crossing of trajectories of any length, free of overflow, with their numbers of rows.

    Every chunk is walked from its entry state; the first crossing of the first chunk that has one is the stop.
    """
    entries = entry_states(evidence, keys, pos, chunk)
    own = evidence.groupBy(*keys, F.floor(F.col(pos) / chunk).alias("_chunk")).agg(_chunk_steps(pos).alias("s"), F.count("*").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        g = F.least((acc["g"] + 1.0) * s["f"], F.lit(_MOST))
        return F.struct(g.alias("g"), F.coalesce(acc["stop"], F.when(g >= threshold, s["p"].cast("long"))).alias("stop"))

    start = F.struct(F.col("entry").alias("g"), F.lit(None).cast("long").alias("stop"))
    walked = own.join(entries, [*keys, "_chunk"]).select(*keys, "n", F.aggregate("s", start, step)["stop"].alias("stop"))
    return walked.groupBy(*keys).agg(F.min("stop").alias("stop"), F.sum("n").alias("length"))


def distributed_support(
    evidence: DataFrame, keys: list[str], material: float, window: int, clients: int, pos: str = "pos"
) -> DataFrame:
    """Positions at which enough distinct clients took part in material coalitions lately.

    ``evidence`` has ``members`` and ``factor``. A client active at ``pos`` counts up to
    ``pos + window - 1``, so each activity is laid out over that fixed span; no window is sorted.
    """
    active = (
        evidence.filter(F.col("factor") >= material)
        .select(*keys, pos, F.explode("members").alias("client_id"))
        .distinct()
    )
    span = active.select(
        *keys, "client_id", F.explode(F.sequence(F.col(pos), F.col(pos) + window - 1)).alias(pos)
    ).distinct()
    return span.groupBy(*keys, pos).agg(F.count("*").alias("active_clients")).filter(F.col("active_clients") >= clients)


def with_support(states: DataFrame, support: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    flag = support.select(*keys, pos, F.lit(True).alias("supported"))
    return states.join(flag, [*keys, pos], "left").withColumn("supported", F.coalesce("supported", F.lit(False)))


def global_stops(states: DataFrame, keys: list[str], thresholds: tuple[float, ...], pos: str = "pos") -> DataFrame:
    """First position with ``state >= threshold`` and support, for every threshold at once."""
    stops = [F.min(F.when((F.col("state") >= h) & F.col("supported"), F.col(pos))) for h in thresholds]
    rows = F.array(*[F.struct(F.lit(float(h)).alias("threshold"), s.alias("stop")) for h, s in zip(thresholds, stops, strict=True)])
    return (
        states.groupBy(*keys)
        .agg(rows.alias("_s"))
        .select(*keys, F.explode("_s").alias("_s"))
        .select(*keys, F.col("_s.threshold").alias("threshold"), F.col("_s.stop").alias("stop"))
    )


def false_stop_counts(stops: DataFrame, keys: list[str]) -> DataFrame:
    return stops.groupBy(*keys, "threshold").agg(
        F.count("*").alias("horizons"), F.count("stop").alias("false_stops")
    )


def calibrated_threshold(counts: DataFrame, keys: list[str], confidence: float, target: float) -> DataFrame:
    """Smallest threshold whose upper bound meets the target; none is an unavailable operating point."""
    ok = binomial.bound_within(F.col("false_stops"), F.col("horizons"), confidence, target)
    return counts.groupBy(*keys).agg(F.min(F.when(ok, F.col("threshold"))).alias("threshold")).withColumn(
        "operating_point", F.when(F.col("threshold").isNull(), "Operating Point Unavailable").otherwise("Available")
    )


def restricted_mean(stops: DataFrame, keys: list[str], maximum: int) -> DataFrame:
    """Mean of ``min(T, M)``; a trajectory without a stop contributes ``M`` exactly."""
    held = F.least(F.coalesce(F.col("stop").cast("double"), F.lit(float(maximum))), F.lit(float(maximum)))
    return stops.groupBy(*keys).agg(F.avg(held).alias("restricted_mean"), F.count_if(F.col("stop").isNull()).alias("censored"))
