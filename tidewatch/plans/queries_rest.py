"""Queries of comparators, seed statistics, perturbations, fitted detectors and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import binomial
from tidewatch.operators import comparators, detectors, metrics, perturb, projection, statistics
from tidewatch.params import PARTITIONS, Params
from tidewatch.plans.oracle import bisected
from tidewatch.plans.queries import HELDOUT, NUISANCE, n64, query, r6
from tidewatch.plans.workload import Workload
from tidewatch.streaming import jobs

# -- comparators --------------------------------------------------------------------------------

FUSION_KEYS = ["stream", "epoch", "partition", "part_pos", "part_size"]


@query("SELECT stream, epoch, round(avg(rank), 6) AS mean_rank, round(max(rank), 6) AS max_rank FROM ranks GROUP BY ALL", "ranks")
def comparator_rank_fusion(w: Workload) -> DataFrame:
    return w.fusion().select("stream", "epoch", r6("mean_rank").alias("mean_rank"), r6("max_rank").alias("max_rank"))


def _moment_sql(order: int, product: str) -> str:
    return f"""SELECT coalition_id, stream, count(*) AS rows, round(avg(abs((x - m) / greatest(s, 1e-6))), 5) AS nonconformity FROM (
  SELECT coalition_id, cell, stream, {product} AS x FROM conditional WHERE ord = {order}) JOIN (
  SELECT coalition_id, cell, avg({product}) AS m, stddev_samp({product}) AS s FROM conditional
  WHERE ord = {order} AND stream = 'benign' AND partition = 'nuisance_fit' GROUP BY ALL HAVING count(*) >= 2) USING (coalition_id, cell) GROUP BY ALL"""


def _moment(w: Workload, order: int) -> DataFrame:
    rows = w.conditional().filter(F.col("ord") == order).withColumn("x", comparators.dependence_moment(F.col("r")))
    reference = rows.filter((F.col("stream") == "benign") & (F.col("partition") == NUISANCE))
    out = comparators.nonconformity(rows, reference, ["coalition_id", "cell"], "x", w.p.scale_floor)
    return out.groupBy("coalition_id", "stream").agg(F.count("*").alias("rows"), F.round(F.avg("nonconformity"), 5).alias("nonconformity"))


@query(_moment_sql(2, "(2 * r[1] - 1) * (2 * r[2] - 1)"), "conditional")
def comparator_pair_dependence(w: Workload) -> DataFrame:
    return _moment(w, 2)


@query(_moment_sql(3, "(2 * r[1] - 1) * (2 * r[2] - 1) * (2 * r[3] - 1)"), "conditional")
def comparator_lancaster(w: Workload) -> DataFrame:
    return _moment(w, 3)


def _tables(w: Workload) -> DataFrame:
    return w.stage("triple-tables", lambda: comparators.triple_tables(w.conditional_nuisance(), w.p.table_bins, w.p.pseudocount, w.p.ipf_iterations, w.p.ipf_tolerance))


_TABLE = """, bins AS (SELECT coalition_id, cell, list_transform(r, lambda u: least(CAST(floor(u * 4) AS BIGINT), 3)) AS b FROM conditional WHERE ord = 3 AND stream = 'benign' AND partition = 'nuisance_fit'),
keys AS (SELECT DISTINCT coalition_id, cell FROM bins),
counts AS (SELECT coalition_id, cell, b[1] AS b1, b[2] AS b2, b[3] AS b3, count(*) AS n FROM bins GROUP BY ALL),
full_table AS (SELECT k.coalition_id, k.cell, x.b1, y.b2, z.b3, (coalesce(n, 0) + 0.5) / (sum(coalesce(n, 0) + 0.5) OVER (PARTITION BY k.coalition_id, k.cell)) AS p
  FROM keys k, (SELECT unnest(range(0, 4)) AS b1) x, (SELECT unnest(range(0, 4)) AS b2) y, (SELECT unnest(range(0, 4)) AS b3) z
  LEFT JOIN counts c ON c.coalition_id = k.coalition_id AND c.cell = k.cell AND c.b1 = x.b1 AND c.b2 = y.b2 AND c.b3 = z.b3)
"""


@query(
    _TABLE + "SELECT coalition_id, CAST(cell AS BIGINT) AS cell, CAST(b1 AS BIGINT) AS b1, CAST(b2 AS BIGINT) AS b2, round(sum(p), 6) AS p12, round(max(p), 6) AS highest FROM full_table GROUP BY ALL",
    "conditional",
)
def comparator_smoothed_tables(w: Workload) -> DataFrame:
    """Pair marginals of the smoothed tables, taken from the fitted pair tables, which must match them."""
    t = _tables(w)
    return t.groupBy("coalition_id", n64("cell").alias("cell"), n64("b1").alias("b1"), n64("b2").alias("b2")).agg(
        r6(F.sum("p_full")).alias("p12"), r6(F.max("p_full")).alias("highest")
    )


@query(
    _TABLE + """SELECT coalition_id, CAST(cell AS BIGINT) AS cell, round(max(p) + 3.1e-6, 5) AS p12, round(max(q) + 3.1e-6, 5) AS p13, round(max(s) + 3.1e-6, 5) AS p23 FROM (
  SELECT coalition_id, cell, sum(p) OVER (PARTITION BY coalition_id, cell, b1, b2) AS p, sum(p) OVER (PARTITION BY coalition_id, cell, b1, b3) AS q,
    sum(p) OVER (PARTITION BY coalition_id, cell, b2, b3) AS s FROM full_table) GROUP BY ALL""",
    "conditional",
)
def comparator_pair_maxent_margins(w: Workload) -> DataFrame:
    """Largest pair marginals of the fitted maximum-entropy tables: they equal the smoothed ones.

    The small offset keeps exact halves off the rounding border.
    """
    t = _tables(w)
    keys = ["coalition_id", "cell"]
    parts = []
    for name, (a, b) in {"p12": ("b1", "b2"), "p13": ("b1", "b3"), "p23": ("b2", "b3")}.items():
        margin = t.groupBy(*keys, a, b).agg(F.sum("p_pair").alias("m"))
        parts.append(margin.groupBy(*keys).agg(F.round(F.max("m") + 3.1e-6, 5).alias(name)))
    out = parts[0].join(parts[1], keys).join(parts[2], keys)
    return out.withColumn("cell", n64("cell"))


@query()
def comparator_connected_information(w: Workload) -> DataFrame:
    scored = comparators.binned_scores(w.conditional(), _tables(w), w.p.table_bins, w.p.probability_floor)
    return scored.groupBy("coalition_id", "stream").agg(F.count("*").alias("rows"), r6(F.avg("connected_information")).alias("score"))


@query()
def comparator_log_linear(w: Workload) -> DataFrame:
    scored = comparators.binned_scores(w.conditional(), _tables(w), w.p.table_bins, w.p.probability_floor)
    return scored.groupBy("coalition_id", "stream").agg(F.count("*").alias("rows"), r6(F.avg("log_linear")).alias("score"))


@query(
    """, pts AS (SELECT coalition_id, cell, r[1] AS x, r[2] AS y FROM conditional WHERE ord = 2 AND stream = 'benign' AND partition = 'nuisance_fit'),
n AS (SELECT coalition_id, cell, count(*) * (count(*) - 1) / 2 AS pairs FROM pts GROUP BY ALL),
s AS (SELECT a.coalition_id, a.cell, sum(sign(a.x - b.x) * sign(a.y - b.y)) / 2.0 AS s, (count(*) FILTER (a.x = b.x)) AS ex, (count(*) FILTER (a.y = b.y)) AS ey, max(c.k) AS k
  FROM pts a JOIN pts b USING (coalition_id, cell) JOIN (SELECT coalition_id, cell, count(*) AS k FROM pts GROUP BY ALL) c USING (coalition_id, cell) GROUP BY ALL)
SELECT coalition_id, CAST(cell AS BIGINT) AS cell, round(s / sqrt((pairs - (ex - k) / 2.0) * (pairs - (ey - k) / 2.0)), 6) AS tau FROM s JOIN n USING (coalition_id, cell)""",
    "conditional",
)
def comparator_kendall(w: Workload) -> DataFrame:
    rows = w.conditional_nuisance().filter("ord = 2").select("coalition_id", "cell", F.get("r", F.lit(0)).alias("a"), F.get("r", F.lit(1)).alias("b"))
    tau = comparators.kendall(rows, ["coalition_id", "cell"], "a", "b", 32)
    return tau.select("coalition_id", n64("cell").alias("cell"), r6("tau").alias("tau"))


def _newton(source: str) -> str:
    """One Newton step for the normal quantile z of u; the distribution function by its series of positive terms."""
    a = "least(abs(z), 8.5)"
    cdf = f"0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 160), lambda k: exp((2 * k + 1) * ln({a}) - odd[k + 1])))"
    return f"SELECT u, CASE WHEN z = 0 THEN 0 ELSE z - ({cdf} - u) / (exp(-z * z / 2) / sqrt(2 * pi())) END AS z FROM {source}, odds"


def _tau(source: str, x: str, y: str) -> str:
    """Correlation of the Gaussian copula from Kendall's tau over all pairs."""
    return f"""SELECT coalition_id, cell, least(greatest(sin(pi() / 2 * CASE WHEN xx * yy > 0 THEN s / sqrt(xx * yy) ELSE 0 END), -0.999999), 0.999999) AS rho FROM (
  SELECT a.coalition_id, a.cell, sum(sign(a.{x} - b.{x}) * sign(a.{y} - b.{y})) AS s, count(*) FILTER (a.{x} <> b.{x}) * 1.0 AS xx, count(*) FILTER (a.{y} <> b.{y}) * 1.0 AS yy
  FROM {source} a JOIN {source} b USING (coalition_id, cell) GROUP BY ALL)"""


@query(
    """, three AS MATERIALIZED (SELECT coalition_id, cell, stream, epoch, r, stream = 'benign' AND partition = 'nuisance_fit' AS ref FROM conditional WHERE ord = 3),
odds AS MATERIALIZED (SELECT list_transform(range(0, 160), lambda k: lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)) AS odd),
q0 AS (SELECT u, CASE WHEN u < 0.5 THEN -1 ELSE 1 END * (t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)) AS z FROM (
  SELECT u, sqrt(-2 * ln(least(u, 1 - u))) AS t FROM (SELECT DISTINCT least(greatest(unnest(r), 1e-12), 1 - 1e-12) AS u FROM three))),
q1 AS MATERIALIZED (""" + _newton("q0") + "), q2 AS MATERIALIZED (" + _newton("q1") + "), q3 AS MATERIALIZED (" + _newton("q2") + """),
marks AS MATERIALIZED (SELECT coalition_id, cell, stream, epoch, ref, r[1] AS u1, r[2] AS u2, r[3] AS u3, a.z AS z1, b.z AS z2, c.z AS z3 FROM three JOIN q3 a ON a.u = r[1] JOIN q3 b ON b.u = r[2] JOIN q3 c ON c.u = r[3]),
base AS MATERIALIZED (SELECT * FROM marks WHERE ref),
r12 AS MATERIALIZED (""" + _tau("base", "u1", "u2") + "), r23 AS MATERIALIZED (" + _tau("base", "u2", "u3") + """),
given AS MATERIALIZED (SELECT m.*, (z1 - r12.rho * z2) / sqrt(1 - r12.rho ** 2) AS t1, (z3 - r23.rho * z2) / sqrt(1 - r23.rho ** 2) AS t3 FROM marks m JOIN r12 USING (coalition_id, cell) JOIN r23 USING (coalition_id, cell)),
given_base AS MATERIALIZED (SELECT * FROM given WHERE ref),
r13 AS MATERIALIZED (""" + _tau("given_base", "t1", "t3") + """),
scored AS (SELECT coalition_id, stream, abs(-ln(1 - rho * rho) / 2 - (rho * rho * (a * a + b * b) - 2 * rho * a * b) / (2 * (1 - rho * rho))) AS vine FROM (
  SELECT g.*, rho, least(greatest(t1, -7.034483825), 7.034483825) AS a, least(greatest(t3, -7.034483825), 7.034483825) AS b FROM given g JOIN r13 USING (coalition_id, cell)))
SELECT coalition_id, stream, count(*) AS rows, round(avg(vine), 4) AS score FROM scored GROUP BY ALL""",
    "conditional",
)
def comparator_vine(w: Workload) -> DataFrame:
    scored = comparators.vine_scores(w.conditional(), w.conditional_nuisance(), w.p.rank_epsilon)
    return scored.groupBy("coalition_id", "stream").agg(F.count("*").alias("rows"), F.round(F.avg("vine"), 4).alias("score"))


@query(
    """, ols AS (SELECT *, (sy - b1 * s1 - b2 * s2) / n AS b0 FROM (SELECT *, (c22 * c1y - c12 * c2y) / (c11 * c22 - c12 * c12) AS b1, (c11 * c2y - c12 * c1y) / (c11 * c22 - c12 * c12) AS b2
  FROM (SELECT *, s11 - s1 * s1 / n AS c11, s12 - s1 * s2 / n AS c12, s22 - s2 * s2 / n AS c22, s1y - s1 * sy / n AS c1y, s2y - s2 * sy / n AS c2y FROM trains WHERE fold = -1 AND ord = 2)))
SELECT coalition_id, CAST(f.cell AS BIGINT) AS cell, round(sum((y - b0 - b1 * x1 - b2 * x2) ** 2), 5) AS squares, round(max(abs(y - b0 - b1 * x1 - b2 * x2)), 6) AS largest
FROM fit_points f JOIN ols o USING (coalition_id, ord, cell) GROUP BY ALL""",
    "trains",
)
def comparator_orthogonal_atoms(w: Workload) -> DataFrame:
    """In-sample residuals of the unpenalised (pseudo-inverse) projection of pairs."""
    p = w.p
    pairs = w.folded().filter("ord = 2")
    fits = projection.fit_projections(pairs, p.check_basis, (0.0,), p.folds, p.tie_tolerance, p.svd_cutoff)
    final = fits.filter(F.col("fold") == projection.COMPLETE).select("coalition_id", "cell", "coef")
    z = pairs.join(final, ["coalition_id", "cell"]).withColumn("z", F.get(projection.residual(F.col("r"), F.col("coef"), p.check_basis), F.lit(0)))
    return z.groupBy("coalition_id", n64("cell").alias("cell")).agg(F.round(F.sum(F.col("z") ** 2), 5).alias("squares"), r6(F.max(F.abs("z"))).alias("largest"))


@query()
def comparator_orthogonal_atoms_full(w: Workload) -> DataFrame:
    p = w.p
    fits = projection.fit_projections(w.folded(), p.basis_size, (0.0,), p.folds, p.tie_tolerance, p.svd_cutoff)
    final = fits.filter(F.col("fold") == projection.COMPLETE).select("coalition_id", "cell", "coef")
    z = w.folded().join(final, ["coalition_id", "cell"]).withColumn("z", projection.residual(F.col("r"), F.col("coef"), p.basis_size))
    return z.groupBy("coalition_id", "cell").agg(F.count("*").alias("rows"), r6(F.avg(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x))).alias("mean_square"))


@query(
    """SELECT CAST(a.i AS BIGINT) AS i, CAST(b.i AS BIGINT) AS j, round(sum((a.rank - a.m) * (b.rank - b.m)), 6) AS scatter FROM
  (SELECT epoch, rank, dense_rank() OVER (ORDER BY client_id) - 1 AS i, avg(rank) OVER (PARTITION BY client_id) AS m FROM ranks WHERE stream = 'benign' AND partition = 'nuisance_fit') a JOIN
  (SELECT epoch, rank, dense_rank() OVER (ORDER BY client_id) - 1 AS i, avg(rank) OVER (PARTITION BY client_id) AS m FROM ranks WHERE stream = 'benign' AND partition = 'nuisance_fit') b
  ON a.epoch = b.epoch AND a.i <= b.i GROUP BY ALL""",
    "ranks",
)
def comparator_covariance(w: Workload) -> DataFrame:
    panel = w.panel().filter((F.col("stream") == "benign") & (F.col("partition") == NUISANCE))
    rows = comparators.panel_covariance(panel, len(w.client_ids()))
    return rows.select(n64("i").alias("i"), n64("j").alias("j"), r6("scatter").alias("scatter"))


@query()
def comparator_factor_residual(w: Workload) -> DataFrame:
    panel = w.panel()
    nuisance = panel.filter((F.col("stream") == "benign") & (F.col("partition") == NUISANCE))
    out = comparators.factor_residuals(panel, nuisance, len(w.client_ids()), w.p.factor_target, w.p.factor_fallback, w.p.factor_ranks)
    return out.select("stream", "epoch", r6("factor_residual").alias("factor_residual"), "factor_rank")


@query(
    """, walk AS (WITH RECURSIVE base AS (SELECT r.client_id, a.horizon_id, a.pos, r.rank FROM ranks r JOIN horizon_axis a USING (stream, epoch, partition) WHERE partition = 'heldout_benign'),
  go AS (SELECT client_id, horizon_id, pos, greatest(0, rank - 0.55) AS c FROM base WHERE pos = 0
    UNION ALL SELECT b.client_id, b.horizon_id, b.pos, greatest(0, g.c + b.rank - 0.55) FROM go g JOIN base b ON b.client_id = g.client_id AND b.horizon_id = g.horizon_id AND b.pos = g.pos + 1)
  SELECT * FROM go)
SELECT CAST(horizon_id AS BIGINT) AS horizon_id, CAST(pos AS BIGINT) AS pos, round(max(c), 6) AS global_cusum FROM walk GROUP BY ALL""",
    "horizon_axis",
)
def comparator_cusum(w: Workload) -> DataFrame:
    rows = w.horizon_rows(w.ranks(), HELDOUT)
    walked = comparators.cusum(rows, ["client_id", "horizon_id"], "pos", w.p.cusum_center, w.p.cusum_drift)
    return comparators.global_cusum(walked, ["horizon_id", "pos"]).select("horizon_id", n64("pos").alias("pos"), r6("global_cusum").alias("global_cusum"))


@query(
    """, walk AS (WITH RECURSIVE base AS (SELECT client_id, epoch, rank FROM ranks WHERE stream = 'all'),
  go AS (SELECT client_id, epoch, greatest(0, rank - 0.55) AS c FROM base WHERE epoch = (SELECT min(epoch) FROM base)
    UNION ALL SELECT b.client_id, b.epoch, greatest(0, g.c + b.rank - 0.55) FROM go g JOIN base b ON b.client_id = g.client_id AND b.epoch = g.epoch + 1)
  SELECT * FROM go)
SELECT client_id, epoch, round(c, 6) AS cusum FROM walk""",
    "ranks",
)
def comparator_cusum_stream(w: Workload) -> DataFrame:
    """The recursion over the whole axis; a small chunk width makes the carry between chunks work."""
    rows = w.ranks().filter("stream = 'all'")
    out = comparators.cusum_stream(rows, ["client_id"], "epoch", w.p.cusum_center, w.p.cusum_drift, 64)
    return out.select("client_id", "epoch", r6("cusum").alias("cusum"))


@query(
    """, fused AS (SELECT stream, epoch, partition, avg(rank) AS v FROM ranks GROUP BY ALL), ref AS (SELECT avg(v) AS m, stddev_samp(v) AS s FROM fused WHERE stream = 'benign' AND partition = 'nuisance_fit'),
q AS (SELECT quantile_cont(abs((v - m) / greatest(s, 1e-6)), 0.95) AS q FROM fused, ref WHERE stream = 'benign' AND partition = 'nuisance_fit')
SELECT stream, epoch, round(exp(0.5 * least(greatest(abs((v - m) / greatest(s, 1e-6)) / greatest(q, 1e-6) - 1, -1), 1) - 0.125), 6) AS factor FROM fused, ref, q""",
    "ranks",
)
def comparator_calibrated_fusion(w: Workload) -> DataFrame:
    return w.fusion_evidence().select("stream", "epoch", r6("factor").alias("factor"))


@query(
    """, listed AS (SELECT row_number() OVER (ORDER BY event_type) AS pos, event_type AS name, round(avg(value) / 100, 4) AS error, round(count(*) / 1000.0, 3) AS runtime FROM labelled GROUP BY event_type),
scan AS (WITH RECURSIVE go AS (SELECT pos, name, CAST(error AS DOUBLE) AS error, CAST(runtime AS DOUBLE) AS runtime FROM listed WHERE pos = 1
  UNION ALL SELECT l.pos, CASE WHEN better THEN l.name ELSE l.n0 END, CASE WHEN better THEN l.error ELSE l.e0 END, CASE WHEN better THEN l.runtime ELSE l.r0 END FROM (
    SELECT c.pos, c.name, c.error, c.runtime, g.name AS n0, g.error AS e0, g.runtime AS r0, c.error - g.error < -0.01 OR (abs(c.error - g.error) <= 0.01 AND (c.runtime - g.runtime < -0.05
      OR (abs(c.runtime - g.runtime) <= 0.05 AND c.name < g.name))) AS better FROM go g JOIN listed c ON c.pos = g.pos + 1) l) SELECT * FROM go)
SELECT name, error, runtime FROM scan WHERE pos = (SELECT max(pos) FROM scan)""",
    "labelled",
)
def comparator_strongest(w: Workload) -> DataFrame:
    """The tolerant scan over a listed handful, here event types with an error and a cost each."""
    from pyspark.sql import Window

    listed = w.table("events").groupBy("event_type").agg(F.round(F.avg("value") / 100, 4).alias("error"), F.round(F.count("*") / 1000.0, 3).alias("runtime"))
    listed = listed.withColumn("pos", F.row_number().over(Window.orderBy("event_type"))).withColumnRenamed("event_type", "name")
    return comparators.strongest_comparator(listed, 0.01, 0.05)


# -- seed statistics ----------------------------------------------------------------------------
# Ten user groups play independent seeds; purchases and clicks are the paired methods.

_SEEDS = """WITH means AS (SELECT user_id % 10 AS seed, event_type AS method, avg(value) AS value FROM events GROUP BY ALL),
diffs AS (SELECT seed, max(value) FILTER (method = 'purchase') - max(value) FILTER (method = 'click') AS d, row_number() OVER (ORDER BY seed) - 1 AS i FROM means GROUP BY seed)
"""


def _differences(w: Workload) -> DataFrame:
    rows = w.table("events").select((F.col("user_id") % 10).alias("seed"), F.col("event_type").alias("method"), "value")
    means = statistics.unit_means(rows, "seed", ["method"], "value")
    return statistics.paired_differences(means, "seed", "method", "purchase", "click")


@query(_SEEDS + "SELECT seed, round(d, 6) AS difference FROM diffs")
def statistic_paired_differences(w: Workload) -> DataFrame:
    return _differences(w).select("seed", r6("difference").alias("difference"))


@query(_SEEDS + "SELECT CAST(k AS BIGINT) AS pattern, round(sum(CASE WHEN (k >> i) & 1 = 1 THEN -d ELSE d END) / 10, 6) AS flipped FROM diffs, (SELECT unnest(range(0, 1024)) AS k) GROUP BY k")
def statistic_sign_flips(w: Workload) -> DataFrame:
    flips = statistics.sign_flip_means(_differences(w), "seed", 10, w.p.exact_flip_limit, w.p.statistics_seed)
    return flips.select("pattern", r6("flipped").alias("flipped"))


@query(
    _SEEDS + """, flips AS (SELECT k, sum(CASE WHEN (k >> i) & 1 = 1 THEN -d ELSE d END ORDER BY i) / 10 AS f FROM diffs, (SELECT unnest(range(0, 1024)) AS k) GROUP BY k), o AS (SELECT f AS o FROM flips WHERE k = 0)
SELECT count(*) AS patterns, round(count(*) FILTER (f >= o - 1e-12) / count(*), 6) AS p_greater, round(count(*) FILTER (f <= o + 1e-12) / count(*), 6) AS p_less, round(count(*) FILTER (abs(f) >= abs(o) - 1e-12) / count(*), 6) AS p_two_sided FROM flips, o"""
)
def statistic_sign_flip_p(w: Workload) -> DataFrame:
    p = statistics.sign_flip_p(statistics.sign_flip_means(_differences(w), "seed", 10, w.p.exact_flip_limit, w.p.statistics_seed))
    return p.select("patterns", *[r6(c).alias(c) for c in ("p_greater", "p_less", "p_two_sided")])


@query()
def statistic_sign_flip_sampled(w: Workload) -> DataFrame:
    """Simulated patterns when the exact family does not fit."""
    return statistics.sign_flip_p(statistics.sign_flip_means(_differences(w), "seed", 10, 1000, w.p.statistics_seed))


@query(_SEEDS + "SELECT round(median((a.d + b.d) / 2), 6) AS shift FROM diffs a JOIN diffs b ON a.i <= b.i")
def statistic_hodges_lehmann(w: Workload) -> DataFrame:
    return statistics.hodges_lehmann(_differences(w), "seed").select(r6("shift").alias("shift"))


@query(
    _SEEDS + """SELECT CAST(b AS BIGINT) AS replicate, round(avg(d), 6) AS estimate FROM (
  SELECT b, k, CAST(floor(('0x' || substr(sha256('3000:' || b || ':' || k), 1, 8))::UBIGINT / 4294967296.0 * 10) AS BIGINT) AS i FROM (SELECT unnest(range(0, 2000)) AS b), (SELECT unnest(range(0, 10)) AS k)) JOIN diffs USING (i) GROUP BY b"""
)
def statistic_bootstrap_means(w: Workload) -> DataFrame:
    return statistics.resample_means(_differences(w), "seed", w.p.bootstrap_replicates, w.p.statistics_seed).select("replicate", r6("estimate").alias("estimate"))


@query()
def statistic_bca_interval(w: Workload) -> DataFrame:
    d = _differences(w)
    out = statistics.bca_interval(statistics.resample_means(d, "seed", w.p.bootstrap_replicates, w.p.statistics_seed), d, "seed", 0.95)
    return out.select(r6("estimate").alias("estimate"), r6("lower").alias("lower"), r6("upper").alias("upper"), "state").withColumn(
        "equivalent", statistics.equivalent(F.col("lower"), F.col("upper"), -5.0, 5.0)
    )


@query(
    """WITH cells AS (SELECT event_type AS campaign, user_id % 10 AS seed, avg(value) AS value FROM events GROUP BY ALL),
camps AS (SELECT campaign, row_number() OVER (ORDER BY campaign) - 1 AS i FROM (SELECT DISTINCT campaign FROM cells)),
dc AS (SELECT b, campaign, count(*) AS wc FROM (SELECT b, CAST(floor(('0x' || substr(sha256('17:campaign:' || b || ':' || k), 1, 8))::UBIGINT / 4294967296.0 * 5) AS BIGINT) AS i
  FROM (SELECT unnest(range(0, 500)) AS b), (SELECT unnest(range(0, 5)) AS k)) JOIN camps USING (i) GROUP BY ALL),
ds AS (SELECT b, CAST(floor(('0x' || substr(sha256('17:seed:' || b || ':' || k), 1, 8))::UBIGINT / 4294967296.0 * 10) AS BIGINT) AS seed, count(*) AS ws
  FROM (SELECT unnest(range(0, 500)) AS b), (SELECT unnest(range(0, 10)) AS k) GROUP BY ALL)
SELECT CAST(b AS BIGINT) AS replicate, round(sum(wc * ws * value) / sum(wc * ws), 6) AS estimate FROM dc JOIN ds USING (b) JOIN cells USING (campaign, seed) GROUP BY b"""
)
def statistic_hierarchical_bootstrap(w: Workload) -> DataFrame:
    cells = w.table("events").groupBy(F.col("event_type").alias("campaign"), (F.col("user_id") % 10).alias("seed")).agg(F.avg("value").alias("value"))
    return statistics.hierarchical_bootstrap(cells, 500, 17).select("replicate", r6("estimate").alias("estimate"))


_TESTS = """WITH tests AS (SELECT family, hypothesis, CASE WHEN hypothesis = 'view' THEN NULL ELSE v END AS p FROM (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'primary' ELSE 'secondary' END AS family, event_type AS hypothesis, round(avg(value) / 1000, 6) AS v FROM events GROUP BY 1, 2)),
ranked AS (SELECT *, coalesce(p, 1) AS q, row_number() OVER (PARTITION BY family ORDER BY coalesce(p, 1), hypothesis) - 1 AS k, count(*) OVER (PARTITION BY family) AS m FROM tests)
"""


@query(_TESTS + "SELECT family, hypothesis, round(q, 6) AS holm_input_p, round(coalesce(CASE WHEN p IS NOT NULL THEN a END, -1), 6) AS adjusted_p FROM (SELECT *, max(least(1, (m - k) * q)) OVER (PARTITION BY family ORDER BY k) AS a FROM ranked)")
def statistic_holm(w: Workload) -> DataFrame:
    """Two families of five names; an untested member (-1 here) enters with p = 1."""
    family = F.when(F.col("user_id") % 2 == 0, "primary").otherwise("secondary")
    rows = w.table("events").groupBy(family.alias("family"), F.col("event_type").alias("hypothesis")).agg(F.avg("value").alias("v"))
    tests = rows.select("family", "hypothesis", F.when(F.col("hypothesis") != "view", F.round(F.col("v") / 1000, 6)).alias("p"))
    out = statistics.holm(tests)
    return out.select("family", "hypothesis", r6("holm_input_p").alias("holm_input_p"), r6(F.coalesce("adjusted_p", F.lit(-1.0))).alias("adjusted_p"))


@query(
    "SELECT user_id, CASE WHEN count(*) < 50 THEN 'NOT_TESTED' WHEN avg(CASE WHEN value >= 60 THEN 1 ELSE 0 END) >= 0.3 THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS claim_state FROM events GROUP BY 1"
)
def statistic_claim_state(w: Workload) -> DataFrame:
    rows = w.table("events").groupBy("user_id").agg(F.avg((F.col("value") >= 60).cast("int")).alias("observed"), (F.count("*") >= 50).alias("available"))
    return rows.select("user_id", statistics.claim_state(F.col("observed"), F.lit(0.3), F.col("available")).alias("claim_state"))


@query(
    """WITH counts AS (SELECT user_id, count(*) AS n, count(*) FILTER (value >= 200) AS x FROM events GROUP BY 1)
SELECT user_id, counts.n AS trials, counts.x AS successes, CASE WHEN counts.x = 0 THEN 0 ELSE round(1 - (down.lo + down.hi) / 2, 6) END AS lower,
  CASE WHEN counts.x = counts.n THEN 1 ELSE round((up.lo + up.hi) / 2, 6) END AS upper FROM counts
JOIN (""" + bisected("(SELECT DISTINCT n, x FROM counts)", "0.025") + """) up ON up.n = counts.n AND up.x = counts.x
JOIN (""" + bisected("(SELECT DISTINCT n, n - x AS x FROM counts)", "0.025") + """) down ON down.n = counts.n AND down.x = counts.n - counts.x"""
)
def statistic_two_sided_interval(w: Workload) -> DataFrame:
    """Equal-tail exact intervals."""
    c = w.table("events").groupBy("user_id").agg(F.count("*").alias("trials"), F.count_if(F.col("value") >= 200).alias("successes"))
    both = statistics.two_sided_interval(c, "successes", "trials", 0.95)
    return both.select("user_id", "trials", "successes", r6("lower").alias("lower"), r6("upper").alias("upper"))


@query(
    """WITH RECURSIVE counts AS (SELECT user_id % 12 AS site, count(*) AS n, count(*) FILTER (value >= 250) AS x FROM events GROUP BY 1),
walk AS (SELECT site, n, x, 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM counts
  UNION ALL SELECT site, n, x, step + 1, CASE WHEN list_sum(list_transform(range(0, x + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln((lo + hi) / 2) + (n - k) * ln(1 - (lo + hi) / 2)))) > 0.05
    THEN (lo + hi) / 2 ELSE lo END, CASE WHEN list_sum(list_transform(range(0, x + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln((lo + hi) / 2) + (n - k) * ln(1 - (lo + hi) / 2)))) > 0.05
    THEN hi ELSE (lo + hi) / 2 END FROM walk WHERE step < 50)
SELECT site, n AS trials, x AS successes, round((lo + hi) / 2, 6) AS upper_bound FROM walk WHERE step = 50"""
)
def statistic_upper_bound(w: Workload) -> DataFrame:
    """One-sided exact upper bound against a bisection with gamma functions."""
    c = w.table("events").groupBy((F.col("user_id") % 12).alias("site")).agg(F.count("*").alias("trials"), F.count_if(F.col("value") >= 250).alias("successes"))
    return c.withColumn("upper_bound", r6(binomial.upper_bound(F.col("successes"), F.col("trials"), 0.95)))


# -- perturbations ------------------------------------------------------------------------------

MEMBERS, CONTEXT = ["c00", "c01", "c02"], ["c01", "c03", "c04", "c05"]


@query(
    """, eps AS (SELECT unnest([-0.1, -0.05, 0.0, 0.05, 0.1]) AS e), moved AS (SELECT epoch, e, client_id, score / 1e6 + CASE WHEN client_id IN ('c00', 'c01', 'c02') THEN e ELSE 0 END AS s FROM scores, eps WHERE stream = 'benign' AND partition = 'heldout_benign'),
rows_ AS (SELECT epoch, e, avg(s) FILTER (client_id IN ('c00', 'c01', 'c02')) AS a, avg(s) FILTER (client_id IN ('c01', 'c03', 'c04', 'c05')) AS b FROM moved GROUP BY ALL),
inn AS (SELECT 'linear' AS transform, e, a - b AS i, b AS n FROM rows_ UNION ALL SELECT 'tanh', e, a - tanh(2 * b), tanh(2 * b) FROM rows_ UNION ALL SELECT 'softplus', e, a - (ln(1 + exp(b)) - ln(2)), ln(1 + exp(b)) - ln(2) FROM rows_)
SELECT transform, round(regr_slope(n, e), 6) AS nuisance_slope, round(regr_slope(i, e), 6) AS innovation_slope, round(1 - abs(regr_slope(i, e)) / (1 + 1e-12), 6) AS attenuation FROM inn GROUP BY 1""",
    "scores",
)
def perturbation_derivatives(w: Workload) -> DataFrame:
    """Response of a coalition innovation to small score shifts of its members."""
    base = w.scores().filter((F.col("stream") == "benign") & (F.col("partition") == HELDOUT)).select("client_id", "epoch", (F.col("score") / 1e6).alias("score"))
    steps = F.explode(F.array(*[F.lit(e) for e in (-0.1, -0.05, 0.0, 0.05, 0.1)]))
    moved = perturb.shift_scores(base.withColumn("e", steps), perturb.target_clients(w.client_ids(), 3), F.col("e"))
    out = None
    for transform in ("linear", "tanh", "softplus"):
        rows = perturb.scalar_innovation(moved, ["epoch", "e"], MEMBERS, CONTEXT, transform).withColumn("n", F.col("response") - F.col("innovation"))
        a = metrics.slope(rows.withColumn("transform", F.lit(transform)), ["transform"], "e", "n", "nuisance_slope")
        b = metrics.slope(rows.withColumn("transform", F.lit(transform)), ["transform"], "e", "innovation", "innovation_slope")
        part = a.join(b, "transform")
        out = part if out is None else out.unionByName(part)
    return out.select(
        "transform", r6("nuisance_slope").alias("nuisance_slope"), r6("innovation_slope").alias("innovation_slope"),
        r6(metrics.attenuation(F.col("innovation_slope"), F.lit(1.0), w.p.denominator_floor)).alias("attenuation"),
    )


@query(
    "SELECT stream, client_id, round(avg(CASE WHEN client_id IN ('c03', 'c04', 'c05', 'c06', 'c07') THEN least(rank + 0.25, 1 - 1e-12) ELSE rank END), 6) AS mean_rank, "
    "round(max(CASE WHEN client_id IN ('c03', 'c04', 'c05', 'c06', 'c07') THEN least(rank + 0.25, 1 - 1e-12) ELSE rank END), 6) AS max_rank FROM ranks GROUP BY ALL",
    "ranks",
)
def perturbation_contaminated_ranks(w: Workload) -> DataFrame:
    """Half of the nine outside clients (4.5 rounds up to five) of the first triple are raised."""
    outside = [c for c in w.client_ids() if c not in perturb.target_clients(w.client_ids(), 3)]
    rows = perturb.contaminate_ranks(w.ranks(), perturb.contaminated_clients(outside, 0.5), 0.25, w.p.rank_epsilon)
    return rows.groupBy("stream", "client_id").agg(r6(F.avg("rank")).alias("mean_rank"), r6(F.max("rank")).alias("max_rank"))


# -- fitted detectors ---------------------------------------------------------------------------


def _detector_rows(w: Workload) -> tuple[DataFrame, DataFrame, int]:
    rows = w.stage("scaled", lambda: w.scored().select("stream", "client_id", "epoch", "partition", F.transform("scaled", lambda x: F.signum(x) * F.log1p(F.abs(x))).alias("features")))
    fit = rows.filter((F.col("stream") == "benign") & (F.col("partition") == PARTITIONS[0]))
    return rows, fit, w.p.hash_buckets + 2


def _forest_sql(trees: int, cap: int, dimension: int, seed: int) -> str:
    def draw(names: str) -> str:
        return f"('0x' || substr(sha256('{seed}:' || {names}), 1, 13))::BIGINT / {16**13}::DOUBLE"

    def ends(f: str) -> str:
        return "[" + ", ".join(f"list_{f}(list_transform(fs, lambda f: f[{i}]))" for i in range(1, dimension + 1)) + "]"

    def path(n: str) -> str:
        return f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1) / {n}::DOUBLE WHEN {n} = 2 THEN 1 ELSE 0 END"

    def judged(source: str) -> str:
        return f"""SELECT client_id, t, node, depth, sample, fs, CASE WHEN len(os) > 0 THEN os[CAST(floor({draw("'feature:' || client_id || ':' || t || ':' || node")} * len(os)) AS INT) + 1] END AS feature, lo, hi FROM (
      SELECT *, CASE WHEN depth < ceil(log2(greatest(sample, 2))) AND len(fs) > 1 THEN list_filter(range(1, {dimension + 1}), lambda i: hi[i] > lo[i]) ELSE [] END AS os FROM (SELECT *, {ends("min")} AS lo, {ends("max")} AS hi FROM ({source})))"""

    cut = f"lo[feature] + {draw("'cut:' || client_id || ':' || t || ':' || node")} * (hi[feature] - lo[feature])"
    return f""", x AS MATERIALIZED (SELECT stream, client_id, epoch, partition, list(round((value - median) / greatest(iqr, 1e-6), 9) ORDER BY feature) AS f FROM featl JOIN scaler USING (client_id, feature) GROUP BY ALL),
draws AS (SELECT client_id, epoch, f, t, {draw("'row:' || client_id || ':' || t || ':' || epoch")} AS u FROM x, (SELECT unnest(range(0, {trees})) AS t) WHERE stream = 'benign' AND partition = 'detector_fit'),
picked AS (SELECT client_id, t, list(f) AS fs, count(*) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY client_id, t ORDER BY u, epoch) AS i FROM draws) WHERE i <= {cap} GROUP BY ALL),
grown AS (SELECT *, {cut} AS cut FROM ({judged("SELECT client_id, t, 1 AS node, 0 AS depth, sample, fs FROM picked")})
  UNION ALL SELECT *, {cut} AS cut FROM ({judged("SELECT client_id, t, 2 * node + side AS node, depth + 1 AS depth, sample, list_filter(fs, lambda f: CASE WHEN side = 1 THEN f[feature] > cut ELSE f[feature] <= cut END) AS fs FROM grown, (SELECT unnest([0, 1]) AS side) WHERE feature IS NOT NULL")})),
nodes AS MATERIALIZED (SELECT client_id, t, node, feature, cut, (depth + {path("len(fs)")}) / ({path("sample")}) AS ends FROM grown),
walked AS (SELECT stream, client_id, epoch, t, f, 1 AS node FROM x, (SELECT unnest(range(0, {trees})) AS t)
  UNION ALL SELECT w.stream, w.client_id, w.epoch, w.t, w.f, CASE WHEN w.f[n.feature] > n.cut THEN 2 * w.node + 1 ELSE 2 * w.node END FROM walked w JOIN nodes n USING (client_id, t, node) WHERE n.feature IS NOT NULL)
SELECT stream, client_id, epoch, round(pow(2, -sum(ends) / {trees}), 6) AS score FROM walked JOIN nodes n USING (client_id, t, node) WHERE n.feature IS NULL GROUP BY ALL"""


@query(_forest_sql(Params.isolation_trees, Params.isolation_cap, 10, 5), "scores")
def detector_isolation_forest(w: Workload) -> DataFrame:
    """Scores of all epochs under forests of the production size."""
    rows = w.scored().select("stream", "client_id", "epoch", "partition", F.transform("scaled", lambda x: F.round(x, 9)).alias("features"))
    fit = rows.filter((F.col("stream") == "benign") & (F.col("partition") == PARTITIONS[0]))
    samples = w.stage("tree-samples", lambda: detectors.tree_samples(fit, w.p.isolation_trees, w.p.isolation_cap, 5))
    nodes = w.stage("tree-nodes", lambda: detectors.isolation_nodes(samples, 5))
    out = detectors.isolation_scores(rows, nodes, w.p.isolation_trees)
    return out.select("stream", "client_id", "epoch", r6("score").alias("score"))


def _rbf_sql() -> str:
    frequencies, phases = detectors.rbf_frequencies(10, 16, 77)
    rows = ", ".join(f"({i}, {f}, {p})" for i, (f, p) in enumerate(zip(frequencies, phases, strict=True)))
    return f""", rff(k, w, b) AS (VALUES {rows}),
x AS (SELECT stream, client_id, epoch, partition, list(sign(v) * ln(1 + abs(v)) ORDER BY feature) AS f FROM (
  SELECT stream, client_id, epoch, partition, feature, (value - median) / greatest(iqr, 1e-6) AS v FROM featl JOIN scaler USING (client_id, feature)) GROUP BY ALL),
g AS (SELECT client_id, 1 / (10 * var_pop(v)) AS gamma FROM (SELECT client_id, unnest(f) AS v FROM x WHERE stream = 'benign' AND partition = 'detector_fit') GROUP BY 1),
z AS (SELECT stream, client_id, epoch, partition, k, cos(list_dot_product(f, CAST(w AS DOUBLE[])) * sqrt(2 * gamma) + b) * sqrt(2.0 / 16) AS z FROM x JOIN g USING (client_id), rff),
c AS (SELECT client_id, k, avg(z) AS c FROM z WHERE stream = 'benign' AND partition = 'detector_fit' GROUP BY ALL)
SELECT stream, client_id, epoch, round(1 - sum(z * c), 6) AS score FROM z JOIN c USING (client_id, k) GROUP BY ALL"""


@query(_rbf_sql(), "scores")
def detector_rbf(w: Workload) -> DataFrame:
    rows, fit, dimension = _detector_rows(w)
    out = detectors.rbf_scores(rows, fit, dimension, w.p.rbf_features, 77)
    return out.select("stream", "client_id", "epoch", r6("score").alias("score"))


@query()
def detector_autoencoder(w: Workload) -> DataFrame:
    rows, fit, dimension = _detector_rows(w)
    models = w.stage("autoencoders", lambda: detectors.train_autoencoders(fit, dimension, w.p.encoder_passes, w.p.encoder_rate, w.p.encoder_batch, 3))
    out = detectors.reconstruction_scores(rows, models, dimension)
    return out.groupBy("stream", "client_id").agg(F.count("*").alias("epochs"), F.round(F.avg("score"), 4).alias("mean_score"))


@query()
def detector_federated_autoencoder(w: Workload) -> DataFrame:
    rows, fit, dimension = _detector_rows(w)
    shared = detectors.federated_autoencoder(fit, dimension, w.p.federated_rounds, w.p.federated_passes, w.p.encoder_rate, w.p.encoder_batch, 3)
    out = detectors.federated_scores(rows, shared, dimension)
    return out.groupBy("stream", "client_id").agg(F.count("*").alias("epochs"), F.round(F.avg("score"), 4).alias("mean_score"))


@query(
    """SELECT CAST(slot AS BIGINT) AS slot, round(CAST(CAST(sum(m * n) / sum(n) AS FLOAT) AS DOUBLE), 4) AS weight FROM (
  SELECT client_id, feature AS slot, avg(value) AS m FROM featl WHERE stream = 'all' GROUP BY ALL) JOIN (SELECT client_id, sum(n) AS n FROM sparse GROUP BY 1) USING (client_id) GROUP BY 1""",
    "featl",
)
def detector_federated_mean(w: Workload) -> DataFrame:
    """The averaging step on per-client parameter vectors (mean features, weighted by records)."""
    width = w.p.hash_buckets + 2
    means = w.feature_rows().filter("stream = 'all'").groupBy("client_id").agg(F.array(*[F.avg(F.get("features", F.lit(i))) for i in range(width)]).alias("weights"))
    counts = w.sparse().groupBy("client_id").agg(F.sum("n").alias("n"))
    out = detectors.federated_mean(means.join(counts, "client_id"))
    return out.select(n64("slot").alias("slot"), F.round("w", 4).alias("weight"))


@query("SELECT client_id, count(*) AS epochs, CAST(0 AS BIGINT) AS missing FROM scores WHERE stream = 'benign' GROUP BY 1", "scores")
def detector_stream_state(w: Workload) -> DataFrame:
    return detectors.score_stream_state(w.scores().filter("stream = 'benign'"))


# -- streams ------------------------------------------------------------------------------------


def _stream(w: Workload) -> DataFrame:
    schema = w.table("events").schema
    events = jobs.event_stream(w.spark, w.folder, "events.parquet", schema)
    return events.select(
        F.col("event_id").cast("string").alias("uid"), F.col("ts").cast("timestamp").alias("ts"), w.site().alias("client_id"), "event_type", "value"
    )


@query(
    "SELECT epoch, client_id, bucket, count(*) AS n FROM labelled GROUP BY ALL",
    "labelled",
)
def stream_epoch_counts(w: Workload) -> DataFrame:
    """All epochs of the streaming aggregate, the last ones by the closing marker."""
    out = jobs.drain(_stream(w), "stream-counts", lambda s: jobs.epoch_counts(s, "ts", w.p.epoch_seconds, w.p.hash_buckets, "10 minutes"), "ts")
    return out.select("epoch", "client_id", n64("bucket").alias("bucket"), "n")


@query("SELECT client_id, count(*) AS events, count(DISTINCT uid) AS identifiers FROM labelled GROUP BY 1", "labelled")
def stream_distinct_events(w: Workload) -> DataFrame:
    """Every event sent twice: the stream keeps one copy of each identifier."""
    events = _stream(w)
    doubled = events.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    out = jobs.drain(jobs.distinct_events(doubled, "ts", "1 hour"), "stream-distinct")
    return out.groupBy("client_id").agg(F.count("*").alias("events"), F.count_distinct("uid").alias("identifiers"))


@query(
    """, x AS (SELECT original_order, client_id, least(value / 600, 1) AS s, least(CAST(floor(least(value / 600, 1) * 32) AS BIGINT), 31) AS b FROM labelled)
, ref AS (SELECT client_id, b, count(*) AS c, sum(count(*)) OVER (PARTITION BY client_id) AS n, sum(count(*)) OVER (PARTITION BY client_id ORDER BY b) AS upto FROM x GROUP BY client_id, b)
SELECT x.client_id, count(*) AS events, round(sum((upto - c + 0.5 * c + 0.5) / (n + 1)), 5) AS rank_sum FROM x JOIN ref USING (client_id, b) GROUP BY 1""",
    "labelled",
)
def stream_online_ranks(w: Workload) -> DataFrame:
    """Streaming values ranked against the fixed binned reference of their client."""
    score = F.least(F.col("value") / 600, F.lit(1.0))
    history = w.table("events").select(w.site().alias("client_id"), score.alias("score"))
    reference = w.stage("stream-reference", lambda: jobs.reference_bins(history, 32))
    out = jobs.drain(jobs.online_ranks(_stream(w).withColumn("score", score), reference, 32), "stream-ranks")
    return out.groupBy("client_id").agg(F.count("*").alias("events"), F.round(F.sum("rank"), 5).alias("rank_sum"))


@query(
    """, starts AS (SELECT unnest([e * 3600 - k * 3600 for k in [0, 1, 2, 3, 4, 5]]) AS s FROM (SELECT DISTINCT epoch AS e FROM labelled))
SELECT CAST(s AS BIGINT) AS start_second, (SELECT count(*) FROM labelled WHERE ts_seconds >= s AND ts_seconds < s + 21600) AS n FROM (SELECT DISTINCT s FROM starts)""",
    "labelled",
)
def stream_stress_windows(w: Workload) -> DataFrame:
    return jobs.drain(_stream(w), "stream-stress", lambda s: jobs.stress_counts(s, "ts", 6 * 3600, 3600, "10 minutes"), "ts")


@query(
    """, hot AS (SELECT client_id, CAST(round(ts_seconds * 1000000) AS BIGINT) AS t FROM labelled WHERE gt_class = 'malicious'),
cut AS (SELECT *, sum(CASE WHEN t - p < 10800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY client_id ORDER BY t) AS g FROM (SELECT *, lag(t) OVER (PARTITION BY client_id ORDER BY t) AS p FROM hot)),
runs_ AS (SELECT client_id, min(t) AS a, max(t) + 10800000000 AS b, count(*) AS n FROM cut GROUP BY client_id, g)
SELECT client_id, a AS start_micros, b AS end_micros, n AS records FROM runs_""",
    "labelled",
)
def stream_malicious_sessions(w: Workload) -> DataFrame:
    hot = _stream(w).filter(F.col("value") >= w.p.attack_value)
    return jobs.drain(hot, "stream-sessions", lambda s: jobs.malicious_sessions(s, "ts", (w.p.merge_gap + 1) * w.p.epoch_seconds, "10 minutes"), "ts")


def _epoch_stream(w: Workload, name: str, rows: DataFrame, value: str) -> DataFrame:
    """A stage table replayed as a stream of (key, pos, at, value)."""
    from tidewatch.session import fresh_path

    path = w._once(f"stream-source-{name}", lambda: fresh_path(w.spark, f"stream-source-{name}"))
    shaped = rows.select(
        F.col("key").cast("string").alias("key"), n64("epoch").alias("pos"), F.timestamp_seconds(F.col("epoch") * w.p.epoch_seconds).alias("at"), F.col(value).cast("double").alias("value")
    )
    w._once(f"stream-written-{name}", lambda: shaped.write.mode("errorifexists").parquet(path) or True)
    return w.spark.readStream.schema(shaped.schema).parquet(path)


def _with_rocksdb(w: Workload, run):
    """Stateful processors need the RocksDB store; the former setting comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = w.spark.conf.get(key)
    w.spark.conf.set(key, jobs.ROCKSDB)
    try:
        return run()
    finally:
        w.spark.conf.set(key, before)


@query(
    """, base AS (SELECT epoch, factor FROM method_evidence WHERE method = 'order_one' AND stream = 'all'),
walk AS (WITH RECURSIVE go AS (SELECT epoch, factor AS state FROM base WHERE epoch = (SELECT min(epoch) FROM base)
  UNION ALL SELECT b.epoch, (g.state + 1) * b.factor FROM go g JOIN base b ON b.epoch = g.epoch + 1) SELECT * FROM go)
SELECT epoch AS pos, round(state, 6) AS state, min(CASE WHEN state >= 2.6 THEN epoch END) OVER (ORDER BY epoch) AS stop FROM walk""",
    "method_evidence",
)
def stream_global_recursion(w: Workload) -> DataFrame:
    rows = w.method_evidence(check=True).filter("method = 'order_one' AND stream = 'all'").withColumn("key", F.col("method"))
    source = _epoch_stream(w, "recursion", rows, "factor")
    out = _with_rocksdb(w, lambda: jobs.drain(source, "stream-recursion", lambda s: jobs.online_recursion(s, 2.6, "2 hours"), "at"))
    return out.select("pos", r6("state").alias("state"), "stop")


@query(
    """, walk AS (WITH RECURSIVE base AS (SELECT client_id, epoch, rank FROM ranks WHERE stream = 'all'),
  go AS (SELECT client_id, epoch, greatest(0, rank - 0.55) AS c FROM base WHERE epoch = (SELECT min(epoch) FROM base)
    UNION ALL SELECT b.client_id, b.epoch, greatest(0, g.c + b.rank - 0.55) FROM go g JOIN base b ON b.client_id = g.client_id AND b.epoch = g.epoch + 1)
  SELECT * FROM go)
SELECT client_id, epoch AS pos, round(c, 6) AS cusum FROM walk""",
    "ranks",
)
def stream_cusum(w: Workload) -> DataFrame:
    source = _epoch_stream(w, "ranks", w.ranks().filter("stream = 'all'").withColumn("key", F.col("client_id")), "rank")
    out = _with_rocksdb(w, lambda: jobs.drain(source, "stream-cusum", lambda s: jobs.online_cusum(s, w.p.cusum_center, w.p.cusum_drift, "2 hours"), "at"))
    return out.select(F.col("key").alias("client_id"), "pos", r6("state").alias("cusum"))


@query(
    """, hits AS (SELECT client_id, epoch, count(*) FILTER (rank >= 0.8) OVER (PARTITION BY client_id ORDER BY epoch ROWS 4 PRECEDING) AS h FROM ranks WHERE stream = 'all')
SELECT client_id, epoch AS pos, CAST(h AS BIGINT) AS hits FROM hits""",
    "ranks",
)
def stream_persistence(w: Workload) -> DataFrame:
    source = _epoch_stream(w, "ranks", w.ranks().filter("stream = 'all'").withColumn("key", F.col("client_id")), "rank")
    out = _with_rocksdb(w, lambda: jobs.drain(source, "stream-persistence", lambda s: jobs.online_persistence(s, 0.8, 3, 5, "2 hours"), "at"))
    return out.select(F.col("key").alias("client_id"), "pos", n64("state").alias("hits"))


