"""Alternative scores over the same rank tables."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidewatch.functions import arrays, prefix
from tidewatch.functions.quantiles import exact_quantiles
from tidewatch.operators import evidence
from tidewatch.session import written


def rank_fusion(ranks: DataFrame, keys: list[str]) -> DataFrame:
    return ranks.groupBy(*keys).agg(F.avg("rank").alias("mean_rank"), F.max("rank").alias("max_rank"))


def dependence_moment(r: Column) -> Column:
    """Product of ``2u - 1`` over the members (pairs: dependence, triples: Lancaster moment)."""
    return F.aggregate(r, F.lit(1.0), lambda acc, u: acc * (u * 2.0 - 1.0))


def with_stats(rows: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Attach statistics by key, or as scalar subqueries when there is no key."""
    if keys:
        return rows.join(stats, keys)
    packed = rows.withColumn("_s", stats.select(F.struct(*stats.columns)).scalar()).filter(F.col("_s").isNotNull())
    return packed.select(*rows.columns, "_s.*")


def nonconformity(rows: DataFrame, reference: DataFrame, keys: list[str], value: str, floor: float) -> DataFrame:
    """``abs((x - mean) / max(sd, floor))`` with benign moments per key; under two rows a key abstains."""
    stats = reference.groupBy(*keys).agg(
        F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"), F.count(value).alias("_rows")
    )
    joined = with_stats(rows, stats.filter(F.col("_rows") >= 2), keys)
    return joined.withColumn(
        "nonconformity", F.abs((F.col(value) - F.col("_mean")) / F.greatest(F.col("_sd"), F.lit(floor)))
    ).drop("_mean", "_sd", "_rows")


def common_calibration(
    rows: DataFrame, reference: DataFrame, keys: list[str], value: str, quantile: float, scale_floor: float,
    norm_floor: float, bound: float, bet: float,
) -> DataFrame:
    """Standardize on nuisance rows, take the magnitude, refer it to its nuisance quantile, bound it."""
    ref = nonconformity(reference, reference, keys, value, scale_floor)
    quantiles = exact_quantiles(ref, keys, "nonconformity", (quantile,)).select(*keys, F.col("q")[0].alias("_q"))
    scored = nonconformity(rows, reference, keys, value, scale_floor)
    joined = with_stats(scored, quantiles, keys)
    return joined.withColumn(
        "factor", evidence.operational_factor(F.col("nonconformity"), F.col("_q"), norm_floor, bound, bet)
    ).drop("_q")


def cusum(ranks: DataFrame, keys: list[str], pos: str, center: float, drift: float) -> DataFrame:
    """``C = max(0, C + u - center - drift)`` of bounded sequences (one horizon or campaign per key).

    Closed form: running sum minus the smaller of zero and its running minimum.
    """
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    walked = ranks.withColumn("_s", F.sum(F.col("rank") - F.lit(center) - F.lit(drift)).over(w))
    return walked.withColumn("cusum", F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(w))).drop("_s")


def cusum_stream(ranks: DataFrame, keys: list[str], pos: str, center: float, drift: float, width: int = prefix.CHUNK) -> DataFrame:
    """The same recursion over an unbounded axis: chunk sums and chunk minima carry the state."""
    local = ranks.withColumn("_chunk", prefix.time_chunk(pos, width))
    w = Window.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    walked = local.withColumn("_s", F.sum(F.col("rank") - F.lit(center) - F.lit(drift)).over(w)).withColumn(
        "_m", F.min("_s").over(w)
    )
    ends = walked.groupBy(*keys, "_chunk").agg(F.max_by("_s", pos).alias("_e"), F.min("_m").alias("_lo"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.withColumn("_base", F.coalesce(F.sum("_e").over(before), F.lit(0.0)))
    base = base.withColumn("_floor", F.least(F.lit(0.0), F.coalesce(F.min(F.col("_base") + F.col("_lo")).over(before), F.lit(0.0))))
    joined = walked.join(base.select(*keys, "_chunk", "_base", "_floor"), [*keys, "_chunk"])
    total = F.col("_base") + F.col("_s")
    return joined.withColumn("cusum", total - F.least(F.col("_floor"), F.col("_base") + F.col("_m"))).drop(
        "_s", "_m", "_base", "_floor", "_chunk"
    )


def global_cusum(states: DataFrame, keys: list[str]) -> DataFrame:
    return states.groupBy(*keys).agg(F.max("cusum").alias("global_cusum"))


# -- binned triples -----------------------------------------------------------------------------


def triple_bins(rows: DataFrame, bins: int) -> DataFrame:
    b = F.transform("r", lambda u: F.least(F.floor(u * bins), F.lit(bins - 1)).cast("int"))
    return rows.filter(F.size("r") == 3).withColumn("_b", b).select(
        "*", *[F.get("_b", F.lit(i)).alias(f"b{i + 1}") for i in range(3)]
    ).drop("_b")


def smoothed_table(counts: np.ndarray, pseudocount: float) -> np.ndarray:
    return (counts + pseudocount) / (counts + pseudocount).sum()


def match_marginal(table: np.ndarray, target: np.ndarray, axis: int) -> np.ndarray:
    """Scale a table so that its sum over ``axis`` equals ``target``; empty margins stay."""
    current = table.sum(axis=axis)
    scale = np.where(current > 0, target / np.where(current > 0, current, 1.0), 1.0)
    return table * np.expand_dims(scale, axis)


def pair_maxent(full: np.ndarray, iterations: int, tolerance: float) -> tuple[np.ndarray, int]:
    """Maximum-entropy table with the pair marginals of ``full``, from a uniform start."""
    table = np.full(full.shape, 1.0 / full.size)
    targets = [full.sum(axis=a) for a in range(3)]
    for done in range(1, iterations + 1):
        for axis in (2, 1, 0):
            table = match_marginal(table, targets[axis], axis)
        if max(np.abs(table.sum(axis=a) - targets[a]).max() for a in range(3)) <= tolerance:
            return table, done
    return table, iterations


TABLE_SCHEMA = (
    "coalition_id string, cell int, b1 int, b2 int, b3 int, p_full double, p_pair double, iterations int"
)


def triple_tables(reference: DataFrame, bins: int, pseudocount: float, iterations: int, tolerance: float) -> DataFrame:
    """Smoothed and pair-constrained probabilities per (coalition, cell).

    Spark counts the bins; a group handed to Python holds at most ``bins ** 3`` counts.
    """
    counts = triple_bins(reference, bins).groupBy("coalition_id", "cell", "b1", "b2", "b3").agg(F.count("*").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros((bins, bins, bins))
        dense[pdf["b1"], pdf["b2"], pdf["b3"]] = pdf["n"]
        full = smoothed_table(dense, pseudocount)
        pair, used = pair_maxent(full, iterations, tolerance)
        grid = np.indices(dense.shape).reshape(3, -1)
        return pd.DataFrame(
            {
                "coalition_id": pdf["coalition_id"].iat[0], "cell": pdf["cell"].iat[0],
                "b1": grid[0], "b2": grid[1], "b3": grid[2],
                "p_full": full.ravel(), "p_pair": pair.ravel(), "iterations": used,
            }
        )

    return counts.groupBy("coalition_id", "cell").applyInPandas(fit, TABLE_SCHEMA)


def binned_scores(rows: DataFrame, tables: DataFrame, bins: int, floor: float) -> DataFrame:
    """Connected information ``ln(p_full / p_pair)`` and log-linear ``-ln p_pair`` per row."""
    full, pair = F.greatest("p_full", F.lit(floor)), F.greatest("p_pair", F.lit(floor))
    cells = tables.select(
        "coalition_id", "cell", "b1", "b2", "b3",
        F.log(full / pair).alias("connected_information"), (-F.log(pair)).alias("log_linear"),
    )
    return triple_bins(rows, bins).join(cells, ["coalition_id", "cell", "b1", "b2", "b3"])


# -- Kendall's tau and the Gaussian D-vine ------------------------------------------------------


def concordance(y: np.ndarray, w: np.ndarray, small: int = 256) -> float:
    """Weighted sum of sign(dx) * sign(dy) over unordered pairs of points in ascending x; all y differ.

    Blocks of doubled size are put in order of y; what lies to the right meets the running weight of what lies to the left.
    """
    n, total = len(y), 0.0
    if n <= small:
        return float(sum(w[i] * (np.sign(y[i] - y[:i]) @ w[:i]) for i in range(1, n)))
    place = np.arange(n)
    size = 1
    while size < n:
        order = np.lexsort((y, place // (2 * size)))
        right, weight = (order // size) % 2 == 1, w[order]
        left = np.where(right, 0.0, weight)
        running = np.cumsum(left)
        block = order // (2 * size)
        begins = np.flatnonzero(np.diff(block, prepend=-1))
        sizes = np.diff(np.append(begins, n))
        before = np.repeat(running[begins] - left[begins], sizes)
        whole = np.repeat(np.add.reduceat(left, begins), sizes)
        total += float((weight * (2 * (running - before) - whole))[right].sum())
        size *= 2
    return total


def kendall(rows: DataFrame, keys: list[str], x: str, y: str, task_points: int = 1 << 16, fan: int = 16) -> DataFrame:
    """Kendall's tau-b of two columns per key, exact, without a whole key or one value in one task and without pairs.

    Equal points become one with a weight. Points get their places in the order (x, y) and in the order (y, x); with places instead
    of values no two are tied, and each pair that ties in x or in y counts as concordant, which the tie
    counts take back. Runs of ``task_points`` places in x are counted inside one task by merging. Between runs,
    ``fan`` neighbouring runs make a block, ``fan`` blocks a larger one, and so on: in the order of y, the running weight of each part of
    a block tells every point how much of the parts to its left lies below it. A level is one shuffle, a
    key of n points has log(n / task_points) / log(fan) levels, a small key none.
    """
    points = rows.groupBy(*keys, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").cast("double").alias("w"))
    placed = prefix.positions(prefix.positions(points, keys, ["x", "y"], "px"), keys, ["y", "x"], "py")
    placed = written(placed.select(*keys, "x", "y", "w", "px", "py"), "kendall-points")
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in placed.select(*keys).schema)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("px")
        return pdf[keys].head(1).assign(s=concordance(pdf["py"].to_numpy(), pdf["w"].to_numpy()))

    run = F.floor(F.col("px") / task_points)
    parts = placed.select(*keys, "px", "py", "w", run.alias("run")).groupBy(*keys, "run").applyInPandas(score, f"{kinds}s double")
    last = placed.agg(F.max("px")).first()[0] or 0
    width = task_points
    while width <= last:
        block = [*keys, "block"]
        level = placed.select(*keys, "py", "w", F.floor(F.col("px") / (width * fan)).alias("block"), (F.floor(F.col("px") / width) % fan).alias("part"))
        level = level.withColumns({f"w{i}": F.when(F.col("part") == i, F.col("w")).otherwise(0.0) for i in range(fan)})
        ran = prefix.running_sums(level, block, ["py"], F.floor(F.col("py") / task_points), {f"r{i}": f"w{i}" for i in range(fan)}, whole=True)
        below = sum(F.when(F.col("part") > i, 2 * F.col(f"r{i}") - F.col(f"r{i}_all")).otherwise(0.0) for i in range(fan))
        parts = parts.unionByName(ran.groupBy(*keys).agg(F.sum(F.col("w") * below).alias("s")))
        width *= fan
    sums = parts.groupBy(*keys).agg(F.sum("s").alias("s"))

    def tied(col: str) -> DataFrame:
        per = placed.groupBy(*keys, col).agg(F.sum("w").alias("t"), F.sum(F.col("w") * F.col("w")).alias("q"))
        return per.groupBy(*keys).agg(
            F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(f"t_{col}"),
            F.sum((F.col("t") * F.col("t") - F.col("q")) / 2).alias(f"d_{col}"),
            F.sum("t").alias(f"n_{col}"),
        )

    joined = sums.join(tied("x"), keys).join(tied("y"), keys)
    pairs = F.col("n_x") * (F.col("n_x") - 1) / 2
    spread = F.sqrt((pairs - F.col("t_x")) * (pairs - F.col("t_y")))
    agreed = F.col("s") - F.col("d_x") - F.col("d_y")
    return joined.select(*keys, F.when(spread > 0, agreed / spread).otherwise(0.0).alias("tau"))


_NORMAL = NormalDist()


@F.pandas_udf(DoubleType())
def normal_quantile(u: pd.Series) -> pd.Series:
    return u.map(_NORMAL.inv_cdf, na_action="ignore").astype(float)


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(_NORMAL.cdf, na_action="ignore").astype(float)


def gaussian_h(left: Column, given: Column, rho: Column, epsilon: float) -> Column:
    """Conditional distribution of a Gaussian pair copula."""
    z = [normal_quantile(arrays.clip(u, epsilon, 1.0 - epsilon)) for u in (left, given)]
    return normal_cdf((z[0] - rho * z[1]) / F.sqrt(1.0 - rho * rho))


def tau_to_rho(tau: Column) -> Column:
    return F.sin(F.lit(math.pi / 2) * tau)


def vine_scores(rows: DataFrame, reference: DataFrame, epsilon: float, limit: float = 0.999999) -> DataFrame:
    """D-vine i - j - k: absolute log density of the (i, k given j) Gaussian copula."""
    keys = ["coalition_id", "cell"]

    def slots(d: DataFrame) -> DataFrame:
        return d.filter(F.size("r") == 3).select("*", *[F.get("r", F.lit(i)).alias(f"u{i + 1}") for i in range(3)])

    def rho(d: DataFrame, x: str, y: str, name: str) -> DataFrame:
        return kendall(d, keys, x, y).select(*keys, arrays.clip(tau_to_rho(F.col("tau")), -limit, limit).alias(name))

    ref = slots(reference)
    first = rho(ref, "u1", "u2", "r12").join(rho(ref, "u2", "u3", "r23"), keys)

    def conditioned(d: DataFrame) -> DataFrame:
        return (
            d.join(first, keys)
            .withColumn("h1", gaussian_h(F.col("u1"), F.col("u2"), F.col("r12"), epsilon))
            .withColumn("h3", gaussian_h(F.col("u3"), F.col("u2"), F.col("r23"), epsilon))
        )

    second = rho(conditioned(ref), "h1", "h3", "r13")
    scored = conditioned(slots(rows)).join(second, keys)
    a, b, p = (
        normal_quantile(arrays.clip(F.col("h1"), epsilon, 1 - epsilon)),
        normal_quantile(arrays.clip(F.col("h3"), epsilon, 1 - epsilon)),
        F.col("r13"),
    )
    scored = scored.withColumn("_a", a).withColumn("_b", b)
    a, b = F.col("_a"), F.col("_b")
    q = 1.0 - p * p
    density = -F.log(q) / 2 - (p * p * (a * a + b * b) - 2.0 * p * a * b) / (2.0 * q)
    return scored.withColumn("vine", F.abs(density)).drop("_a", "_b")


# -- global factor ------------------------------------------------------------------------------


def panel_moments(panel: DataFrame, width: int) -> DataFrame:
    """Sums of products ``(i, j, s)`` of the panel arrays with a leading one: one pass, K^2 rows."""
    one = F.concat(F.array(F.lit(1.0)), F.col("now"))
    pairs = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.lit(width)),
                lambda i: F.transform(F.sequence(i, F.lit(width)), lambda j: F.struct(i.alias("i"), j.alias("j"))),
            )
        )
    )
    rows = panel.select(one.alias("v"), pairs.alias("p"))
    return rows.groupBy(F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(
        F.sum(F.get("v", F.col("p.i")) * F.get("v", F.col("p.j"))).alias("s")
    )


def panel_covariance(panel: DataFrame, width: int) -> DataFrame:
    """Scatter matrix about the column means, in long form with 0-based client slots."""
    m = panel_moments(panel, width)
    n = m.filter("i = 0 and j = 0").select(F.col("s").alias("n"))
    means = m.filter("i = 0 and j > 0").select(F.col("j").alias("k"), F.col("s").alias("t"))
    return (
        m.filter("i > 0")
        .join(means.withColumnsRenamed({"k": "i", "t": "ti"}), "i")
        .join(means.withColumnsRenamed({"k": "j", "t": "tj"}), "j")
        .withColumn("n", n.scalar())
        .select(
            (F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), (F.col("s") - F.col("ti") * F.col("tj") / F.col("n")).alias("scatter"),
            (F.col("ti") / F.col("n")).alias("mean_i"),
        )
    )


def factor_rank(values: np.ndarray, target: float, fallback: int, candidates: tuple[int, ...]) -> int:
    """Least candidate whose leading singular values hold the target share of variance; else the fallback rank."""
    explained = np.cumsum(np.square(values))
    if not explained[-1] > 0:
        return fallback
    needed = 1 + int(np.searchsorted(explained, target * explained[-1]))
    return min((r for r in candidates if needed <= r <= len(values)), default=fallback)


def factor_residuals(
    panel: DataFrame, nuisance: DataFrame, width: int, target: float, fallback: int, candidates: tuple[int, ...]
) -> DataFrame:
    """L2 residual of each epoch after removing the leading factors of the nuisance panel.

    Only the K x K scatter matrix reaches the driver; the residual is a column expression.
    """
    scatter, mean = np.zeros((width, width)), np.zeros(width)
    for row in panel_covariance(nuisance, width).collect():
        scatter[row["i"], row["j"]] = scatter[row["j"], row["i"]] = row["scatter"]
        mean[row["i"]] = row["mean_i"]
    values, vectors = np.linalg.eigh(scatter)
    order = np.argsort(values)[::-1]
    singular = np.sqrt(np.maximum(values[order], 0.0))
    rank = factor_rank(singular, target, fallback, candidates)

    def literal(v: np.ndarray) -> Column:
        return F.array(*[F.lit(float(x)) for x in v])

    centred = F.zip_with("now", literal(mean), lambda u, m: u - m)

    def share(c: Column, factor: Column) -> Column:
        return arrays.let(arrays.dot(c, factor), lambda load: F.transform(factor, lambda x: x * load))

    def remove(c: Column) -> Column:
        left = c
        for k in order[:rank]:
            left = F.zip_with(left, share(c, literal(vectors[:, k])), lambda a, b: a - b)
        return left

    return panel.withColumn("factor_residual", arrays.norm(arrays.let(centred, remove))).withColumn(
        "factor_rank", F.lit(rank)
    )


# -- choice of the strongest comparator ---------------------------------------------------------


def strongest_comparator(candidates: DataFrame, error_tolerance: float, runtime_tolerance: float) -> DataFrame:
    """Scan candidates in listed order (``pos, name, error, runtime``): error, then runtime, then name.

    Tolerant ties are not transitive, so an ORDER BY would be wrong. The list is a handful of names.
    """
    listed = F.array_sort(F.collect_list(F.struct("pos", "name", "error", "runtime")))

    def better(best: Column, c: Column) -> Column:
        de, dr = c["error"] - best["error"], c["runtime"] - best["runtime"]
        tie = F.abs(de) <= error_tolerance
        by_name = (F.abs(dr) <= runtime_tolerance) & (c["name"] < best["name"])
        return F.when((de < -error_tolerance) | (tie & ((dr < -runtime_tolerance) | by_name)), c).otherwise(best)

    packed = candidates.agg(listed.alias("c"))
    chosen = F.aggregate(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))), F.element_at("c", 1), better)
    return packed.select(chosen.alias("b")).select("b.name", "b.error", "b.runtime")
