"""Queries of basis, projection, innovations, evidence and sequential decisions.

The SQL twins use the small fit (one basis function, orders one and two), whose ridge solution has
a closed form; the full fit runs next to it as rows-only queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import arrays, basis
from tidewatch.operators import evidence, metrics, projection, sequential
from tidewatch.params import PARTITIONS
from tidewatch.plans.queries import CALIBRATION, HELDOUT, n64, query, r6
from tidewatch.plans.workload import Workload

_PHI = {
    1: "sqrt(3) * (2 * {u} - 1)",
    2: "sqrt(5) * (6 * {u} ** 2 - 6 * {u} + 1)",
    3: "sqrt(7) * (20 * {u} ** 3 - 30 * {u} ** 2 + 12 * {u} - 1)",
    4: "3 * (70 * {u} ** 4 - 140 * {u} ** 3 + 90 * {u} ** 2 - 20 * {u} + 1)",
}


def _phi(i: int, u: str) -> str:
    return "(" + _PHI[i].format(u=u) + ")"


@query("SELECT stream, client_id, epoch, " + ", ".join(f"round({_phi(i, 'rank')}, 6) AS phi{i}" for i in range(1, 5)) + " FROM ranks", "ranks")
def basis_values(w: Workload) -> DataFrame:
    rows = w.ranks().withColumn("p", basis.phi(F.col("rank"), 4))
    return rows.select("stream", "client_id", "epoch", *[r6(F.get("p", F.lit(i - 1))).alias(f"phi{i}") for i in range(1, 5)])


_BASES = ", ".join(f"[{_phi(1, f'r[{i}]')}, {_phi(2, f'r[{i}]')}] AS {n}" for i, n in ((1, "a"), (2, "b"), (3, "c")))


@query(
    f"""SELECT coalition_id, count(*) AS rows, round(sum(list_sum(list_transform(range(0, 8), lambda t: (t + 1) * a[t // 4 + 1] * b[(t // 2) % 2 + 1] * c[t % 2 + 1]))), 5) AS tensor_sum,
  round(sum(1 + list_sum(list_transform(range(0, 2), lambda t: (t + 2) * a[t + 1] + (t + 4) * b[t + 1] + (t + 6) * c[t + 1]))
    + list_sum(list_transform(range(0, 4), lambda t: (t + 8) * a[t // 2 + 1] * b[t % 2 + 1] + (t + 12) * a[t // 2 + 1] * c[t % 2 + 1] + (t + 16) * b[t // 2 + 1] * c[t % 2 + 1]))), 5) AS design_sum
FROM (SELECT coalition_id, {_BASES} FROM conditional WHERE ord = 3) GROUP BY 1""",
    "conditional",
)
def basis_tensor_and_design(w: Workload) -> DataFrame:
    """Position-weighted coordinate sums of triples: order of coordinates matters."""

    def weighted(a):
        return arrays.total(F.transform(a, lambda x, i: x * (i + 1)))

    rows = w.conditional().filter("ord = 3").select("coalition_id", basis.tensor(F.col("r"), 2).alias("t"), basis.design(F.col("r"), 2).alias("d"))
    return rows.groupBy("coalition_id").agg(
        F.count("*").alias("rows"), F.round(F.sum(weighted(F.col("t"))), 5).alias("tensor_sum"), F.round(F.sum(weighted(F.col("d"))), 5).alias("design_sum")
    )


@query("SELECT coalition_id, CAST(cell AS BIGINT) AS cell, epoch, CAST(fold AS BIGINT) AS fold FROM folded WHERE n >= 5", "folded")
def projection_folds(w: Workload) -> DataFrame:
    return w.folded().select("coalition_id", n64("cell").alias("cell"), "epoch", n64("fold").alias("fold"))


@query(
    "SELECT coalition_id, CAST(cell AS BIGINT) AS cell, CAST(fold AS BIGINT) AS fold, CAST(l AS DOUBLE) AS ridge, round(b0, 6) AS b0, "
    "CASE WHEN ord = 2 THEN round(b1, 6) END AS b1, CASE WHEN ord = 2 THEN round(b2, 6) END AS b2 FROM models",
    "models",
)
def projection_fit(w: Workload) -> DataFrame:
    """Chosen penalty and coefficients of every fold and of the complete refit (fold -1)."""
    c = F.get("coef", F.lit(0))
    return w.fits(check=True).select(
        "coalition_id", n64("cell").alias("cell"), n64("fold").alias("fold"), "ridge", *[r6(F.get(c, F.lit(i))).alias(f"b{i}") for i in range(3)]
    )


@query("SELECT coalition_id, CAST(cell AS BIGINT) AS cell, CAST(l AS DOUBLE) AS ridge, round(mse, 6) AS mse FROM cv", "cv")
def projection_cross_validation(w: Workload) -> DataFrame:
    rows = w.fits(check=True).filter(F.col("fold") == projection.COMPLETE).select("coalition_id", n64("cell").alias("cell"), F.posexplode("cv").alias("i", "mse"))
    grid = F.array(*[F.lit(c) for c in w.p.check_candidates])
    return rows.select("coalition_id", "cell", F.get(grid, F.col("i")).alias("ridge"), r6("mse").alias("mse"))


@query(
    """SELECT coalition_id, CAST(cell AS BIGINT) AS cell, round((h + sqrt(h * h - d)) / (h - sqrt(h * h - d)), 4) AS condition FROM (
  SELECT coalition_id, cell, (s11 + s22) / 2 AS h, s11 * s22 - s12 * s12 AS d FROM trains WHERE fold = -1 AND ord = 2)""",
    "trains",
)
def projection_condition(w: Workload) -> DataFrame:
    rows = w.fits(check=True).filter((F.col("fold") == projection.COMPLETE) & (F.col("ord") == 2))
    return rows.select("coalition_id", n64("cell").alias("cell"), F.round("condition", 4).alias("condition"))


@query("SELECT coalition_id, stream, count(*) AS rows, round(sum(z), 5) AS z_sum, round(sqrt(sum(z * z)), 6) AS z_norm FROM atoms GROUP BY ALL", "atoms")
def projection_residuals(w: Workload) -> DataFrame:
    rows = w.conditional().filter("ord <= 2").join(w.calibrated(True).select("coalition_id", "cell", "coef"), ["coalition_id", "cell"])
    z = rows.withColumn("z", F.get(projection.residual(F.col("r"), F.col("coef"), w.p.check_basis), F.lit(0)))
    return z.groupBy("coalition_id", "stream").agg(
        F.count("*").alias("rows"), F.round(F.sum("z"), 5).alias("z_sum"), r6(F.sqrt(F.sum(F.col("z") * F.col("z")))).alias("z_norm")
    )


@query("SELECT coalition_id, CAST(cell AS BIGINT) AS cell, epoch, CAST(fold AS BIGINT) AS fold, round(z, 6) AS z FROM innovations", "innovations")
def innovation_held_folds(w: Workload) -> DataFrame:
    return w.innovations(check=True).select("coalition_id", n64("cell").alias("cell"), "epoch", n64("fold").alias("fold"), r6(F.get("z", F.lit(0))).alias("z"))


@query("SELECT coalition_id, CAST(cell AS BIGINT) AS cell, rows, round(mu, 6) AS mu, round(sd, 6) AS sd FROM moments", "moments")
def innovation_moments(w: Workload) -> DataFrame:
    m = w.moments(check=True)
    return m.select("coalition_id", n64("cell").alias("cell"), "rows", r6(F.get("mu", F.lit(0))).alias("mu"), r6(F.get("sd", F.lit(0))).alias("sd"))


@query("SELECT coalition_id, CAST(cell AS BIGINT) AS cell, round(sum(atom), 5) AS atom_sum, round(sum(atom * atom), 4) AS atom_squares FROM atoms GROUP BY ALL", "atoms")
def innovation_standardized(w: Workload) -> DataFrame:
    a = F.get("atom", F.lit(0))
    return w.evidence(check=True).groupBy("coalition_id", n64("cell").alias("cell")).agg(
        F.round(F.sum(a), 5).alias("atom_sum"), F.round(F.sum(a * a), 4).alias("atom_squares")
    )


@query(
    "SELECT coalition_id, CAST(held AS BIGINT) AS fold, CAST(cell AS BIGINT) AS cell, count(*) AS rows, round(sum(z), 5) AS z_sum, round(sqrt(sum(z * z)), 6) AS z_norm FROM x_innovations GROUP BY ALL",
    "x_innovations",
)
def innovation_cross_fitted_chain(w: Workload) -> DataFrame:
    """Every fitted step redone without the held fold: sums of its innovations."""
    z = w.cross_fitted(check=True).withColumn("x", F.get("z", F.lit(0)))
    return z.groupBy("coalition_id", n64("fold").alias("fold"), n64("cell").alias("cell")).agg(
        F.count("*").alias("rows"), F.round(F.sum("x"), 5).alias("z_sum"), r6(F.sqrt(F.sum(F.col("x") * F.col("x")))).alias("z_norm")
    )


@query()
def innovation_full_calibration(w: Workload) -> DataFrame:
    """Penalty, condition and norm reference of the full fit (all orders, full basis)."""
    return w.calibrated().select("coalition_id", "ord", "cell", "n", "ridge", r6("condition").alias("condition"), r6("q_norm").alias("q_norm"))


@query(
    """SELECT count(*) AS fits, count(*) FILTER (ord = 2 AND c > 1.5) AS failed, round(count(*) FILTER (ord = 2 AND c > 1.5) / count(*), 6) AS failure_rate FROM (
  SELECT ord, (h + sqrt(h * h - d)) / nullif(h - sqrt(h * h - d), 0) AS c FROM (
    SELECT ord, (s11 + s22) / 2 AS h, s11 * s22 - s12 * s12 AS d FROM trains WHERE fold = -1))""",
    "trains",
)
def innovation_failure_rate(w: Workload) -> DataFrame:
    """Failures under a strict condition limit."""
    rows = projection.numerical_failures(w.fits(check=True), 1.5)
    return rows.select("fits", "failed", r6("failure_rate").alias("failure_rate"))


# -- evidence -----------------------------------------------------------------------------------


@query(
    "SELECT coalition_id, stream, round(avg(exp(0.5 * least(greatest(-atom, -1), 1) - 0.125)), 6) AS mean_factor, round(avg(least(greatest(-atom, -1), 1)), 6) AS mean_statistic FROM atoms GROUP BY ALL",
    "atoms",
)
def evidence_signed(w: Workload) -> DataFrame:
    p = w.p
    stat = evidence.signed_statistic(F.col("atom"), -0.4, p.clip_bound)
    rows = w.evidence(check=True).select("coalition_id", "stream", stat.alias("s"))
    return rows.groupBy("coalition_id", "stream").agg(
        r6(F.avg(evidence.signed_factor(F.col("s"), p.clip_bound, p.bet))).alias("mean_factor"), r6(F.avg("s")).alias("mean_statistic")
    )


@query("SELECT coalition_id, CAST(cell AS BIGINT) AS cell, round(q_norm, 6) AS q_norm FROM norms", "norms")
def evidence_norm_reference(w: Workload) -> DataFrame:
    return w.calibrated(check=True).select("coalition_id", n64("cell").alias("cell"), r6("q_norm").alias("q_norm"))


@query("SELECT coalition_id, stream, count(*) AS rows, round(sum(factor), 5) AS factor_sum, round(max(factor), 6) AS factor_max FROM evidence GROUP BY ALL", "evidence")
def evidence_operational(w: Workload) -> DataFrame:
    return w.evidence(check=True).groupBy("coalition_id", "stream").agg(
        F.count("*").alias("rows"), F.round(F.sum("factor"), 5).alias("factor_sum"), r6(F.max("factor")).alias("factor_max")
    )


@query("SELECT stream, epoch, round(e1, 6) AS e1, round(e2, 6) AS e2 FROM order_evidence", "order_evidence")
def evidence_orders(w: Workload) -> DataFrame:
    return w.order_evidence(check=True).select("stream", "epoch", r6("e1").alias("e1"), r6("e2").alias("e2"))


@query("SELECT method, stream, epoch, round(factor, 6) AS factor FROM method_evidence", "method_evidence")
def evidence_methods(w: Workload) -> DataFrame:
    return w.method_evidence(check=True).select("method", "stream", "epoch", r6("factor").alias("factor"))


@query(
    """SELECT stream, CAST(ord AS BIGINT) AS ord, count(*) AS rows, round(avg(exp(0.5 * least(greatest(abs((y - mu) / greatest(sd, 1e-6)) / greatest(q_norm, 1e-6) - 1, -1), 1) - 0.125)), 6) AS mean_factor
FROM points p JOIN moments USING (coalition_id, ord, cell) JOIN norms USING (coalition_id, cell) GROUP BY ALL""",
    "norms",
)
def evidence_without_purification(w: Workload) -> DataFrame:
    rows = w.evidence(check=True, purify=False)
    return rows.groupBy("stream", n64("ord").alias("ord")).agg(F.count("*").alias("rows"), r6(F.avg("factor")).alias("mean_factor"))


@query(
    """SELECT stream, epoch, round(e1 / (e1 + e2 + 1e-12), 6) AS share1, round(e2 / (e1 + e2 + 1e-12), 6) AS share2,
  CAST(CASE WHEN e1 > 1 AND (e2 <= 1 OR ln(e1) >= ln(e2) - 1e-12) THEN 1 WHEN e2 > 1 THEN 2 ELSE 0 END AS BIGINT) AS decisive
FROM (SELECT stream, epoch, e1 / 0.7 AS e1, e2 / 0.7 AS e2 FROM order_evidence)""",
    "order_evidence",
)
def evidence_shares(w: Workload) -> DataFrame:
    """Shares and the decisive order, with order evidence scaled so that both outcomes occur."""
    rows = w.order_evidence(check=True)
    scaled = rows.select("stream", "epoch", (F.col("e1") / 0.7).alias("e1"), (F.col("e2") / 0.7).alias("e2"))
    shares = evidence.order_shares(scaled, (1, 2), w.p.denominator_floor, w.p.tie_tolerance)
    return shares.select("stream", "epoch", r6("share1").alias("share1"), r6("share2").alias("share2"), n64(F.coalesce("decisive_order", F.lit(0))).alias("decisive"))


@query("SELECT method, stream, partition, round(avg(ln(factor)), 6) AS log_growth FROM method_evidence GROUP BY ALL", "method_evidence")
def evidence_growth(w: Workload) -> DataFrame:
    rows = evidence.evidence_growth(w.method_evidence(check=True), ["method", "stream", "partition"])
    return rows.select("method", "stream", "partition", r6("log_growth").alias("log_growth"))


# -- sequential ---------------------------------------------------------------------------------


@query("SELECT method, CAST(horizon_id AS BIGINT) AS horizon_id, CAST(pos AS BIGINT) AS pos, round(state, 6) AS state FROM horizon_states WHERE partition = 'heldout_benign'", "horizon_states")
def sequential_state(w: Workload) -> DataFrame:
    return w.horizon_states(HELDOUT, check=True).select("method", "horizon_id", "pos", r6("state").alias("state"))


@query("SELECT method, CAST(horizon_id AS BIGINT) AS horizon_id, CAST(pos AS BIGINT) AS pos, active_clients FROM supported WHERE partition = 'heldout_benign'", "supported")
def sequential_support(w: Workload) -> DataFrame:
    axis = w.horizon_rows(w.epoch_axis(), HELDOUT)
    placed = axis.select("stream", "epoch", "horizon_id", "pos")
    rows = w.support_rows(["horizon_id"], placed, check=True).filter(F.col("pos") < w.p.horizon)
    return rows.select("method", "horizon_id", "pos", "active_clients")


@query("SELECT method, CAST(horizon_id AS BIGINT) AS horizon_id, threshold, CAST(stop AS BIGINT) AS stop FROM stops WHERE partition = 'heldout_benign' AND stop IS NOT NULL", "stops")
def sequential_stops(w: Workload) -> DataFrame:
    stops = sequential.global_stops(w.horizon_states(HELDOUT, check=True), ["method", "horizon_id"], w.p.thresholds)
    return stops.filter("stop IS NOT NULL").select("method", "horizon_id", "threshold", n64("stop").alias("stop"))


@query("SELECT method, threshold, horizons, false_stops FROM false_stops WHERE partition = 'threshold_and_policy_calibration'", "false_stops")
def sequential_false_stops(w: Workload) -> DataFrame:
    return w.false_stop_counts(CALIBRATION, check=True)


@query("SELECT method, threshold, CASE WHEN threshold IS NULL THEN 'Operating Point Unavailable' ELSE 'Available' END AS operating_point FROM calibrated", "calibrated")
def sequential_threshold(w: Workload) -> DataFrame:
    return w.thresholds(check=True)


@query(
    """, walk AS (WITH RECURSIVE base AS (SELECT partition, stream, part_pos AS pos, factor FROM method_evidence WHERE method = 'order_one'),
  go AS (SELECT partition, stream, pos, factor AS state FROM base WHERE pos = 0
    UNION ALL SELECT b.partition, b.stream, b.pos, (g.state + 1) * b.factor FROM go g JOIN base b ON b.partition = g.partition AND b.stream = g.stream AND b.pos = g.pos + 1)
  SELECT * FROM go),
firsts AS (SELECT stream, partition, min(pos) FILTER (state >= 2.6) AS stop FROM walk GROUP BY ALL)
SELECT stream, round(avg(least(coalesce(stop, 100), 100)), 6) AS restricted_mean, count(*) FILTER (stop IS NULL) AS censored FROM firsts GROUP BY 1""",
    "method_evidence",
)
def sequential_restricted_mean(w: Workload) -> DataFrame:
    """Stopping times of one long trajectory per split, censored at 100 epochs."""
    rows = w.method_evidence(check=True).filter("method = 'order_one'").withColumn("pos", F.col("part_pos"))
    stops = sequential.stops_by_fold(rows, ["stream", "partition"], 2.6)
    out = sequential.restricted_mean(stops, ["stream"], 100)
    return out.select("stream", r6("restricted_mean").alias("restricted_mean"), "censored")


@query()
def sequential_full_campaign_stops(w: Workload) -> DataFrame:
    """Global stops of all methods of the full fit on every campaign."""
    return w.campaign_stops().select("method", "checksum", "threshold", "stop")


@query()
def flagship_fused_rank_stops(w: Workload) -> DataFrame:
    from tidewatch.plans import registry

    return registry.flagship(w.spark, w.folder)


# -- outcomes -----------------------------------------------------------------------------------


def _outcomes(w: Workload) -> DataFrame:
    local = metrics.earliest_local(w.campaign_local_stops(), ["checksum"])
    return metrics.strict_lead(w.campaign_stops(check=True), local, ["checksum"])


@query("SELECT checksum, CAST(local_stop AS BIGINT) AS local_stop FROM camp_local", "camp_local")
def metric_earliest_local(w: Workload) -> DataFrame:
    rows = metrics.earliest_local(w.campaign_local_stops(), ["checksum"]).filter("local_stop IS NOT NULL")
    return rows.select("checksum", n64("local_stop").alias("local_stop"))


@query(
    "SELECT method, checksum, CAST(coalesce(stop, -1) AS BIGINT) AS stop, CAST(coalesce(local_stop, -1) AS BIGINT) AS local_stop, CAST(indicator AS BIGINT) AS indicator, CAST(detected AS BIGINT) AS detected, "
    "CAST(CASE WHEN detected = 1 AND indicator = 0 THEN 1 ELSE 0 END AS BIGINT) AS detected_without_lead FROM outcomes",
    "outcomes",
)
def metric_strict_lead(w: Workload) -> DataFrame:
    """Nulls appear as -1 in this report only."""
    o = _outcomes(w)
    return o.select(
        "method", "checksum", n64(F.coalesce("stop", F.lit(-1))).alias("stop"), n64(F.coalesce("local_stop", F.lit(-1))).alias("local_stop"),
        n64("indicator").alias("indicator"), n64("detected").alias("detected"), n64("detected_without_lead").alias("detected_without_lead"),
    )


@query(
    "SELECT method, checksum, CAST(local_stop - stop AS BIGINT) AS statistical_lead, round(local_stop - stop - 12.5 / 3600, 6) AS operational_lead FROM outcomes WHERE stop IS NOT NULL AND local_stop IS NOT NULL",
    "outcomes",
)
def metric_leads(w: Workload) -> DataFrame:
    rows = metrics.leads(_outcomes(w), 12.5, w.p.epoch_seconds).filter("statistical_lead IS NOT NULL")
    return rows.select("method", "checksum", n64("statistical_lead").alias("statistical_lead"), r6("operational_lead").alias("operational_lead"))


@query("SELECT method, count(*) AS campaigns, round(avg(indicator), 6) AS lead_rate, round(avg(detected), 6) AS detection_rate FROM outcomes GROUP BY 1", "outcomes")
def metric_rates(w: Workload) -> DataFrame:
    rows = metrics.rates(_outcomes(w), ["method"])
    return rows.select("method", "campaigns", r6("lead_rate").alias("lead_rate"), r6("detection_rate").alias("detection_rate"))


@query(
    "SELECT method, horizons, false_stops, round(false_stops / horizons, 6) AS pfa, round(10000 * false_stops / (horizons * 6), 6) AS per_10k FROM false_stops f JOIN calibrated c USING (method, threshold) WHERE partition = 'heldout_benign'",
    "calibrated",
)
def metric_false_alarms(w: Workload) -> DataFrame:
    """Held-out false alarms at the calibrated threshold."""
    counts = w.false_stop_counts(HELDOUT, check=True).join(w.thresholds(check=True).select("method", "threshold"), ["method", "threshold"])
    return counts.select(
        "method", "horizons", "false_stops", r6(F.col("false_stops") / F.col("horizons")).alias("pfa"),
        r6(metrics.false_campaigns_per_10k(F.col("false_stops"), F.col("horizons") * w.p.horizon)).alias("per_10k"),
    )


@query("SELECT method, checksum, CAST(coalesce(stop, 6 + 1) AS BIGINT) AS plotted_stop FROM outcomes", "outcomes")
def metric_censored_stop(w: Workload) -> DataFrame:
    o = _outcomes(w)
    return o.select("method", "checksum", n64(metrics.censored_stop(F.col("stop"), w.p.horizon, 1)).alias("plotted_stop"))


@query(
    """SELECT CAST(a.horizon_id AS BIGINT) AS horizon_id, CAST(coalesce(a.stop - b.stop, -99) AS BIGINT) AS stop_difference,
  CAST((CASE WHEN a.stop IS NULL THEN 0 ELSE 1 END) - (CASE WHEN b.stop IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS detection_difference
FROM stops a JOIN stops b USING (partition, horizon_id, threshold) WHERE partition = 'heldout_benign' AND threshold = 1.8 AND a.method = 'order_at_most_two' AND b.method = 'order_one'""",
    "stops",
)
def metric_paired_stops(w: Workload) -> DataFrame:
    """Stop differences (-99 where a stop is missing) and detection differences of two methods."""
    stops = sequential.global_stops(w.horizon_states(HELDOUT, check=True), ["method", "horizon_id"], (1.8,))
    rows = metrics.paired_stops(stops.filter("method = 'order_at_most_two'"), stops.filter("method = 'order_one'"), ["horizon_id"])
    return rows.select("horizon_id", n64(F.coalesce("stop_difference", F.lit(-99))).alias("stop_difference"), n64("detection_difference").alias("detection_difference"))


@query(
    """SELECT threshold, round(1 - (a / n) / (b / n + 1e-12), 6) AS suppression, round((b - a) / n, 6) AS pfa_difference FROM (
  SELECT threshold, max(horizons) AS n, max(false_stops) FILTER (method = 'order_at_most_two') AS a, max(false_stops) FILTER (method = 'order_one') AS b
  FROM false_stops WHERE partition = 'heldout_benign' GROUP BY 1) WHERE b > 0""",
    "false_stops",
)
def metric_suppression(w: Workload) -> DataFrame:
    c = w.false_stop_counts(HELDOUT, check=True).groupBy("threshold").agg(
        F.max("horizons").alias("n"),
        *[F.max(F.when(F.col("method") == m, F.col("false_stops"))).alias(k) for k, m in (("a", "order_at_most_two"), ("b", "order_one"))],
    )
    a, b = F.col("a") / F.col("n"), F.col("b") / F.col("n")
    return c.filter("b > 0").select("threshold", r6(metrics.suppression(a, b, w.p.denominator_floor)).alias("suppression"), r6(b - a).alias("pfa_difference"))


@query(
    """, ols AS (SELECT *, (sy - b1 * s1 - b2 * s2) / n AS b0 FROM (SELECT *, (c22 * c1y - c12 * c2y) / (c11 * c22 - c12 * c12) AS b1, (c11 * c2y - c12 * c1y) / (c11 * c22 - c12 * c12) AS b2
  FROM (SELECT *, s11 - s1 * s1 / n AS c11, s12 - s1 * s2 / n AS c12, s22 - s2 * s2 / n AS c22, s1y - s1 * sy / n AS c1y, s2y - s2 * sy / n AS c2y FROM trains WHERE fold = -1 AND ord = 2)))
, pairs AS (SELECT f.coalition_id, f.y, f.y - o.b0 - o.b1 * f.x1 - o.b2 * f.x2 AS h, f.y - m.b0 - m.b1 * f.x1 - m.b2 * f.x2 AS z
  FROM fit_points f JOIN ols o USING (coalition_id, ord, cell) JOIN models m ON m.coalition_id = f.coalition_id AND m.cell = f.cell AND m.fold = -1)
SELECT coalition_id, round(sqrt(avg((z - h) ** 2)) / (sqrt(avg(z * z)) + 1e-12), 6) AS nrmse, round(sum(z * h) / (sqrt(sum(z * z)) * sqrt(sum(h * h)) + 1e-12), 6) AS cosine,
  round(sqrt(avg((z - h) ** 2)) / (sqrt(avg(y * y)) + 1e-12), 6) AS projection_nrmse, round(abs(avg(z)) / greatest(sqrt(var_samp(z)), 1e-12), 6) AS null_bias FROM pairs GROUP BY 1""",
    "models",
)
def metric_atom_agreement(w: Workload) -> DataFrame:
    """Ridge atoms against unpenalised orthogonal atoms of pairs on the nuisance epochs."""
    p, keys = w.p, ["coalition_id"]
    pairs = w.folded().filter("ord = 2")
    plain = projection.fit_projections(pairs, p.check_basis, (0.0,), p.folds, p.tie_tolerance, p.svd_cutoff)
    rows = pairs.select("coalition_id", "cell", "epoch", "r")
    for fit, name in ((w.fits(check=True), "z"), (plain, "h")):
        final = fit.filter(F.col("fold") == projection.COMPLETE).select("coalition_id", "cell", F.col("coef").alias(f"coef_{name}"))
        rows = rows.join(final, ["coalition_id", "cell"]).withColumn(name, projection.residual(F.col("r"), F.col(f"coef_{name}"), p.check_basis))
    rows = rows.withColumn("t", basis.tensor(F.col("r"), p.check_basis)).withColumn("fit", F.zip_with("t", "z", lambda a, b: a - b)).withColumn(
        "truth", F.zip_with("t", "h", lambda a, b: a - b)
    )
    rows = rows.select("coalition_id", "z", "h", "t", "fit", "truth")
    agreed = metrics.atom_agreement(rows, keys, "z", "h", p.denominator_floor)
    projected = metrics.projection_nrmse(rows, keys, "fit", "truth", "t", p.denominator_floor)
    bias = metrics.null_bias(rows, keys, "z", 1, p.denominator_floor)
    joined = agreed.join(projected, keys).join(bias, keys)
    return joined.select("coalition_id", *[r6(c).alias(c) for c in ("nrmse", "cosine", "projection_nrmse", "null_bias")])


@query("SELECT c.coalition_id, round(avg(abs(c.r[1] - k.rank)), 6) AS mae FROM conditional c JOIN ranks k ON k.client_id = c.coalition_id AND k.stream = c.stream AND k.epoch = c.epoch WHERE c.ord = 1 GROUP BY 1", "conditional")
def metric_rank_error(w: Workload) -> DataFrame:
    """Mean absolute gap of conditional and marginal ranks of single clients."""
    rows = w.conditional().filter("ord = 1").select("coalition_id", F.get("r", F.lit(0)).alias("a"), F.get("u", F.lit(0)).alias("b"))
    return metrics.mean_absolute_error(rows, ["coalition_id"], "a", "b").select("coalition_id", r6("mae").alias("mae"))


_DRIFT_ROWS = f"""attack AS (SELECT r.client_id, {_phi(1, 'rank')} AS p1, {_phi(2, 'rank')} AS p2 FROM ranks r JOIN registry g ON r.epoch BETWEEN g.start_epoch AND g.end_epoch WHERE r.stream = 'all'),
calm AS (SELECT client_id, {_phi(1, 'rank')} AS p1, {_phi(2, 'rank')} AS p2 FROM ranks WHERE stream = 'benign' AND partition = 'nuisance_fit')"""


@query(
    f""", {_DRIFT_ROWS} SELECT client_id, round(sqrt((a1 - c1) ** 2 + (a2 - c2) ** 2) / greatest(sqrt(v), 1e-12), 6) AS drift, round((a1 - c1) / greatest(s1, 1e-12), 6) AS target_drift
FROM (SELECT client_id, avg(p1) AS a1, avg(p2) AS a2 FROM attack GROUP BY 1) JOIN (SELECT client_id, avg(p1) AS c1, avg(p2) AS c2, var_samp(p1) + var_samp(p2) AS v, stddev_samp(p1) AS s1 FROM calm GROUP BY 1) USING (client_id)""",
    "registry",
)
def metric_drift(w: Workload) -> DataFrame:
    """Drift of each single-client basis and of its first coordinate, campaign epochs against nuisance."""
    runs = w.registry().select(F.explode(F.sequence("start_epoch", "end_epoch")).alias("epoch"))
    attack = w.ranks().filter("stream = 'all'").join(runs, "epoch")
    calm = w.rank_partition(PARTITIONS[1])
    a, b = (d.select("client_id", basis.phi(F.col("rank"), 2).alias("v")).withColumn("x", F.get("v", F.lit(0))) for d in (attack, calm))
    drift = metrics.standardized_drift(a, b, ["client_id"], "v", 2, w.p.denominator_floor)
    target = metrics.target_drift(a, b, ["client_id"], "x", w.p.denominator_floor)
    return drift.join(target, "client_id").select("client_id", r6("drift").alias("drift"), r6("target_drift").alias("target_drift"))


@query(
    """, rows_ AS (SELECT s.client_id, s.score, coalesce(l.malicious, false) AS bad FROM scores s LEFT JOIN labels l USING (client_id, epoch) WHERE s.stream = 'all'),
ranked AS (SELECT *, rank() OVER (PARTITION BY client_id ORDER BY score) + (count(*) OVER (PARTITION BY client_id, score) - 1) / 2.0 AS k,
  count(*) FILTER (bad) OVER (PARTITION BY client_id ORDER BY score DESC) AS cp, count(*) OVER (PARTITION BY client_id ORDER BY score DESC) AS c FROM rows_)
SELECT client_id, CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives, round((w - p * (p + 1) / 2.0) / (p * n), 6) AS auroc, round(ap / p, 6) AS average_precision FROM (
  SELECT client_id, count(*) FILTER (bad) AS p, count(*) FILTER (NOT bad) AS n, sum(k) FILTER (bad) AS w, sum(cp / c) FILTER (bad) AS ap FROM ranked GROUP BY 1)""",
    "labels",
)
def metric_ranking_quality(w: Workload) -> DataFrame:
    rows = w.scores().filter("stream = 'all'").join(w.epoch_labels().select("client_id", "epoch", "malicious"), ["client_id", "epoch"], "left")
    rows = rows.withColumn("malicious", F.coalesce("malicious", F.lit(False)))
    out = metrics.ranking_quality(rows, ["client_id"], "score", "malicious")
    return out.select("client_id", "positives", "negatives", r6("auroc").alias("auroc"), r6("average_precision").alias("average_precision"))


@query("SELECT epoch, count(*) * 20 AS payload_bytes FROM grid WHERE stream = 'all' GROUP BY 1", "grid")
def metric_payload(w: Workload) -> DataFrame:
    return metrics.payload(w.grid().filter("stream = 'all'"), ["epoch"])
