"""Paired statistics over independent units (seeds). Replicates, not data, drive the cost."""

from __future__ import annotations

from statistics import NormalDist


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewatch.functions import text
from tidewatch.functions.binomial import lower_bound, upper_bound
from tidewatch.session import spread, written


def unit_means(rows: DataFrame, unit: str, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(unit, *keys).agg(F.avg(value).alias("value"))


def paired_differences(means: DataFrame, unit: str, method: str, treatment: str, reference: str) -> DataFrame:
    return (
        means.groupBy(unit)
        .agg(
            F.max(F.when(F.col(method) == treatment, F.col("value"))).alias("t"),
            F.max(F.when(F.col(method) == reference, F.col("value"))).alias("r"),
        )
        .filter(F.col("t").isNotNull() & F.col("r").isNotNull())
        .select(unit, (F.col("t") - F.col("r")).alias("difference"))
    )


def _packed(differences: DataFrame, unit: str) -> DataFrame:
    """Differences as one ordered array. Units are seeds of a study: a configured handful."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(unit).alias("u"), F.col("difference").alias("d"))))
    return differences.agg(pairs.alias("p")).select(F.col("p.d").alias("d"), F.size("p").alias("n"))


def _beside(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame as a scalar subquery."""
    return rows.withColumn("_o", one.select(F.struct(*one.columns)).scalar()).select(*rows.columns, "_o.*")


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def sign_flip_means(differences: DataFrame, unit: str, units: int, exact_limit: int, seed: int) -> DataFrame:
    """Flipped means: all ``2^n`` sign patterns when they fit, otherwise hashed patterns.

    Bit j of the pattern index flips unit j. Pattern 0, all positive, is the observed one.
    """
    exact = 2**units <= exact_limit
    count = 2**units if exact else exact_limit
    index = differences.sparkSession.range(count).withColumnRenamed("id", "pattern")
    rows = _beside(index, _packed(differences, unit))
    if exact:
        bit = lambda j: F.pmod(F.floor(F.col("pattern") / F.pow(F.lit(2.0), j)), F.lit(2))
    else:
        bit = lambda j: F.pmod(F.xxhash64(F.lit(seed), F.col("pattern"), j), F.lit(2))
    signed = F.transform("d", lambda x, j: x * (F.lit(1) - F.lit(2) * bit(j)))
    return rows.select(
        "pattern", _mean(signed).alias("flipped"), _mean(F.col("d")).alias("observed"), F.lit(exact).alias("exact")
    )


def sign_flip_p(flipped: DataFrame) -> DataFrame:
    """One- and two-sided p-values. Simulated patterns use (1 + extreme) / (1 + B)."""
    f, o = F.col("flipped"), F.col("observed")
    counts = flipped.agg(
        F.count("*").alias("patterns"),
        F.count_if(f >= o).alias("ge"),
        F.count_if(f <= o).alias("le"),
        F.count_if(F.abs(f) >= F.abs(o)).alias("two"),
        F.max("exact").alias("exact"),
    )

    def p(c: str) -> Column:
        return F.when(F.col("exact"), F.col(c) / F.col("patterns")).otherwise((1 + F.col(c)) / (1 + F.col("patterns")))

    return counts.select("patterns", p("ge").alias("p_greater"), p("le").alias("p_less"), p("two").alias("p_two_sided"))


def hodges_lehmann(differences: DataFrame, unit: str) -> DataFrame:
    """Median of all Walsh averages (i <= j) of the units."""
    walsh = F.flatten(
        F.transform("d", lambda x, i: F.transform(F.slice("d", i + 1, F.size("d") - i), lambda y: (x + y) / 2.0))
    )
    return _packed(differences, unit).select(F.explode(walsh).alias("w")).agg(F.median("w").alias("shift"))


def resample_means(differences: DataFrame, unit: str, replicates: int, seed: int) -> DataFrame:
    """Bootstrap means; draw ``k`` of replicate ``b`` picks a unit by hash, so reruns agree."""
    index = differences.sparkSession.range(replicates).withColumnRenamed("id", "replicate")
    rows = _beside(index, _packed(differences, unit))
    draw = lambda k: F.get(
        F.col("d"),
        F.floor(text.hash_uniform(F.concat_ws(":", F.lit(seed), F.col("replicate"), k)) * F.col("n")).cast("int"),
    )
    sample = F.transform(F.sequence(F.lit(0), F.col("n") - 1), draw)
    return rows.select("replicate", _mean(sample).alias("estimate"), _mean(F.col("d")).alias("observed"))


def _bca_levels(pdf_iter):
    normal = NormalDist()
    for pdf in pdf_iter:
        lows, highs = [], []
        for below, acc, conf in zip(pdf["below"], pdf["acceleration"], pdf["confidence"], strict=True):
            tail = (1.0 - conf) / 2.0
            if not 0.0 < below < 1.0:
                lows.append(None)
                highs.append(None)
                continue
            z0 = normal.inv_cdf(below)
            level = []
            for q in (tail, 1.0 - tail):
                z = z0 + normal.inv_cdf(q)
                level.append(normal.cdf(z0 + z / (1.0 - acc * z)))
            lows.append(level[0])
            highs.append(level[1])
        yield pdf.assign(low=lows, high=highs)


def bca_interval(means: DataFrame, differences: DataFrame, unit: str, confidence: float) -> DataFrame:
    """Bias-corrected accelerated interval of the mean.

    If every replicate equals the estimate, the interval is that point. If the correction cannot be
    computed for another reason the state is Invalid; there is no percentile fallback.
    """
    jack = _packed(differences, unit).select(
        F.transform("d", lambda x: (_mean(F.col("d")) * F.col("n") - x) / (F.col("n") - 1)).alias("j")
    )
    centre = jack.select(F.transform("j", lambda x: _mean(F.col("j")) - x).alias("c"))
    cubes = F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x * x)
    squares = F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x)
    acceleration = centre.select(
        F.when(squares > 0, cubes / (6.0 * F.pow(squares, F.lit(1.5)))).otherwise(F.lit(0.0)).alias("acceleration")
    )
    summary = means.agg(
        F.first("observed").alias("observed"),
        (F.count_if(F.col("estimate") < F.col("observed")) / F.count("*")).alias("below"),
        F.min("estimate").alias("lo"),
        F.max("estimate").alias("hi"),
    )
    base = summary.withColumn("acceleration", acceleration.scalar()).withColumn("confidence", F.lit(confidence))
    schema = StructType([*base.schema.fields, StructField("low", DoubleType()), StructField("high", DoubleType())])
    levels = base.mapInPandas(_bca_levels, schema)
    # quantiles at computed levels: linear interpolation on the ordered replicates
    ordered = means.agg(F.array_sort(F.collect_list("estimate")).alias("e"))
    rows = _beside(levels, ordered)

    def at(q: str) -> Column:
        h = F.col(q) * (F.size("e") - 1)
        i = F.floor(h).cast("int")
        upper = F.least(i + 1, F.size("e") - 1)
        return F.get("e", i) + (h - i) * (F.get("e", upper) - F.get("e", i))

    degenerate = (F.col("lo") == F.col("observed")) & (F.col("hi") == F.col("observed"))
    return rows.select(
        F.col("observed").alias("estimate"),
        F.when(degenerate, F.col("observed")).when(F.col("low").isNotNull(), at("low")).alias("lower"),
        F.when(degenerate, F.col("observed")).when(F.col("high").isNotNull(), at("high")).alias("upper"),
        F.when(degenerate, "Degenerate").when(F.col("low").isNull(), "Invalid").otherwise("Completed").alias("state"),
    )


def hierarchical_bootstrap(cells: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Resample campaigns, then seeds; ``cells`` has (campaign, seed, value) with paired differences.

    Per replicate the draw weights of each campaign and seed are found from hashed draws; the
    aggregate is a weighted mean, so cells join on their index instead of being copied.
    """
    listed = cells.agg(
        F.array_sort(F.collect_set("campaign")).alias("campaigns"), F.array_sort(F.collect_set("seed")).alias("seeds")
    )
    index = cells.sparkSession.range(replicates).withColumnRenamed("id", "replicate")
    base = _beside(index, listed)

    def drawn(tag: str, column: str) -> DataFrame:
        picks = F.transform(
            F.sequence(F.lit(0), F.size(column) - 1),
            lambda k: F.get(
                F.col(column),
                F.floor(text.hash_uniform(F.concat_ws(":", F.lit(seed), F.lit(tag), F.col("replicate"), k)) * F.size(column)).cast("int"),
            ),
        )
        name = column[:-1]
        return base.select("replicate", F.explode(picks).alias(name)).groupBy("replicate", name).agg(F.count("*").alias(f"w_{name}"))

    weights = drawn("campaign", "campaigns").join(drawn("seed", "seeds"), "replicate")
    joined = weights.join(cells, ["campaign", "seed"])
    w = F.col("w_campaign") * F.col("w_seed")
    return joined.groupBy("replicate").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("estimate"))


def percentile_interval(means: DataFrame, confidence: float) -> DataFrame:
    tail = (1.0 - confidence) / 2.0
    q = F.percentile("estimate", F.array(F.lit(tail), F.lit(1.0 - tail)))
    return means.agg(q.alias("q")).select(F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))


def equivalent(lower: Column, upper: Column, region_lower: float, region_upper: float) -> Column:
    return (lower >= region_lower) & (upper <= region_upper)


def holm(tests: DataFrame, family: str = "family") -> DataFrame:
    """Holm-adjusted p-values per family of named hypotheses (a fixed list of a few names).

    An untested member enters with p = 1 to keep the family size; its own result stays null.
    """
    filled = tests.withColumn("holm_input_p", F.coalesce("p", F.lit(1.0)))
    order = Window.partitionBy(family).orderBy("holm_input_p", "hypothesis")
    size = Window.partitionBy(family)
    ranked = filled.withColumn("_r", F.row_number().over(order) - 1).withColumn("_m", F.count("*").over(size))
    step = F.least(F.lit(1.0), (F.col("_m") - F.col("_r")) * F.col("holm_input_p"))
    running = F.max(step).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("_a", running).withColumn("adjusted_p", F.when(F.col("p").isNotNull(), F.col("_a"))).drop("_r", "_m", "_a")


def claim_state(observed: Column, minimum: Column, available: Column) -> Column:
    return (
        F.when(~F.coalesce(available, F.lit(False)) | observed.isNull(), "NOT_TESTED")
        .when(observed >= minimum, "SUPPORTED")
        .otherwise("NOT_SUPPORTED")
    )


def two_sided_interval(rows: DataFrame, successes: str, trials: str, confidence: float) -> DataFrame:
    """Rows with ``lower`` and ``upper``, the equal-tail exact interval of a proportion.

    A bound is some thousand times the work of a row, so bounds are solved once for each pair of counts, spread over tasks.
    """
    each = 1.0 - (1.0 - confidence) / 2.0
    x, n = F.col("_x"), F.col("_n")
    # without keys: a repartition by the keys of the distinct rows would be dropped
    pairs = spread(rows.select(F.col(successes).alias("_x"), F.col(trials).alias("_n")).distinct())
    solved = written(pairs.select("_x", "_n", lower_bound(x, n, each).alias("lower"), upper_bound(x, n, each).alias("upper")), "intervals")
    same = F.col(successes).eqNullSafe(x) & F.col(trials).eqNullSafe(n)
    return rows.join(solved, same).drop("_x", "_n")
