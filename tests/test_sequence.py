"""Features, partitions, campaigns, policies, evidence, stops and outcomes on fixed inputs."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import campaigns, coalitions, detectors, evidence, features, metrics, partitions, perturb, policy, sequential


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_epoch_features(spark):
    row = spark.createDataFrame([("a", 0, [2, 0, 2]), ("a", 1, [0, 0, 0])], "client_id string, epoch long, counts array<long>")
    got = {r["epoch"]: r for r in features.epoch_features(row).collect()}
    assert got[0]["total"] == 4 and abs(got[0]["entropy"] - math.log(2)) < 1e-12
    assert [round(v, 12) for v in got[0]["features"][:3]] == [round(math.log1p(v), 12) for v in (2, 0, 2)]
    assert got[1]["total"] == 0 and got[1]["entropy"] == 0.0
    stressed = features.epoch_features(row, 1.5).filter("epoch = 0").first()
    assert abs(stressed["features"][0] - math.log1p(3.0)) < 1e-12 and stressed["features"][3] == 6.0
    bad = spark.createDataFrame([("a", [1.0, float("nan")])], "client_id string, features array<double>")
    assert features.non_finite_rows(bad).first()["non_finite"] == 1
    with pytest.raises(Exception, match="non-finite"):
        features.require_finite(bad).collect()


def test_grid_interval_partitions_horizons(spark):
    seen = {"p": (3, 12), "q": (4, 11), "r": (2, 12)}
    dense = spark.createDataFrame([(c, e, [2]) for c, ends in seen.items() for e in ends], "client_id string, epoch long, counts array<long>")
    ids = dense.select("client_id").distinct()
    span = features.common_interval(dense, ids)
    assert tuple(span.first()) == (4, 11)
    grid = features.dense_grid(dense, ids, span, 1)
    assert grid.count() == 24 and grid.filter("counts[0] = 0").count() == 22
    roles = partitions.assign_partitions(grid.filter("client_id = 'q'"), (0.25, 0.25, 0.125)).orderBy("pos").collect()
    assert [r["partition"] for r in roles] == ["detector_fit"] * 2 + ["nuisance_fit"] * 2 + ["threshold_and_policy_calibration"] + ["heldout_benign"] * 3
    silent = ids.union(spark.createDataFrame([("never seen",)], "client_id string"))
    assert features.common_interval(dense, silent).count() == 0
    with pytest.raises(ValueError, match="exceed"):
        partitions.assign_partitions(grid, (0.4, 0.4, 0.4))
    axis = spark.range(50).select(F.lit("heldout_benign").alias("partition"), F.col("id").alias("epoch"), F.col("id").alias("part_pos"), F.lit(50).cast("long").alias("part_size"))
    blocks = partitions.assign_horizons(axis, 7)
    assert blocks.select("horizon_id").distinct().count() == 7 and blocks.count() == 49
    assert partitions.horizon_eligibility(blocks, 0.05, 0.95).first()["claim_state"] == "NOT_TESTED"


def test_scaler_floor(spark):
    fit = spark.createDataFrame([("a", [float(v), 1.0]) for v in (0, 1, 2, 3, 10)], "client_id string, features array<double>")
    scaler = {r["feature"]: r for r in features.fit_scaler(fit).collect()}
    assert (scaler[0]["median"], scaler[0]["iqr"], scaler[1]["iqr"]) == (2.0, 2.0, 0.0)
    out = features.apply_scaler(fit.limit(1), features.fit_scaler(fit), 1e-6).first()["scaled"]
    assert out == [-1.0, 0.0]


def test_stress_windows_keep_ties(spark):
    totals = spark.createDataFrame([(e, v) for e, v in enumerate([1, 5, 5, 1, 5, 5, 0, 0])], "epoch long, total long")
    got = partitions.stress_windows(totals, 2, 1, 0.1).orderBy("start_epoch").collect()
    assert [(r["start_epoch"], r["window_total"]) for r in got] == [(1, 10), (4, 10)]


def test_campaign_rules(spark):
    hot = [("a", 10), ("b", 11), ("a", 14), ("c", 40), ("a", 60), ("b", 75)]
    labels = spark.createDataFrame([(c, e, True, 1) for c, e in hot] + [("a", 0, False, 1)], "client_id string, epoch long, malicious boolean, records long")
    runs = campaigns.epoch_runs(labels, 2)
    merged = [(r["start_epoch"], r["end_epoch"]) for r in campaigns.merged_runs(runs).orderBy("start_epoch").collect()]
    assert merged == [(10, 11), (14, 14), (40, 40), (60, 60), (75, 75)] or merged == [(10, 14), (40, 40), (60, 60), (75, 75)]
    assert (14 - 11 - 1 <= 2) == ((10, 14) in merged)
    judged = campaigns.judged_runs(
        campaigns.merged_runs(runs), campaigns.run_spread(campaigns.run_participants(labels, runs)), labels.agg(F.min("epoch").alias("first_epoch")), 10, 2, 3, 10
    )
    registry = campaigns.campaign_registry(judged, "d").collect()
    assert [(r["start_epoch"], r["end_epoch"], r["participants"]) for r in registry] == [(10, 14, ["a", "b"])]
    none = campaigns.judged_runs(
        campaigns.merged_runs(runs), campaigns.run_spread(campaigns.run_participants(labels, runs)), labels.agg(F.min("epoch").alias("first_epoch")), 10, 2, 3, 11
    )
    assert campaigns.campaign_registry(none, "d").count() == 0  # the warm-up would start before the data
    frame = campaigns.replay_frame(campaigns.campaign_registry(judged, "d"), 3, 2).orderBy("epoch").collect()
    assert [(r["epoch"], r["c_pos"]) for r in frame] == [(8, -2), (9, -1), (10, 0), (11, 1), (12, 2)]


def test_persistence_and_policy_choice(spark):
    """Exceedances at 1, 2 and 5 of seven epochs; a score equal to the threshold exceeds it."""
    scores = (0.1, 0.5, 3.0, 0.49, 0.0, 0.5, 0.2)
    rows = spark.createDataFrame([("a", 0, i, s, 0.5) for i, s in enumerate(scores)], "client_id string, horizon_id long, pos long, score double, threshold double")
    stops = {(r["m"], r["n"]): r["stop"] for r in policy.local_stops(rows, ["client_id", "horizon_id"], "pos", ((1, 4), (2, 2), (2, 4), (3, 5), (3, 4))).collect()}
    assert stops == {(1, 4): 1, (2, 2): 2, (2, 4): 2, (3, 5): 5, (3, 4): None}
    counts = spark.createDataFrame(
        [("a", 2.0, 1, 1, 40, 6), ("a", 2.5, 1, 1, 40, 1), ("a", 2.5, 2, 3, 40, 0), ("a", 9.0, 1, 1, 40, 0), ("b", 2.0, 1, 1, 40, 40)],
        "client_id string, threshold double, m int, n int, horizons long, false_stops long",
    )
    got = {r["client_id"]: (r["threshold"], r["m"], r["operating_point"]) for r in policy.choose_policy(counts, 0.95, 0.08).collect()}
    assert got == {"a": (2.5, 2, "Available"), "b": (None, None, "Operating Point Unavailable")}


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_long_trajectories_in_chunks(spark, chunk):
    """Against a plain walk: crossings in any chunk, none at all, gaps in the positions, factors that overflow and vanish."""
    import random

    rng = random.Random(chunk)
    paths = {k: [(p, math.exp(rng.gauss(m, 0.4))) for p in range(rng.randrange(1, 60)) if rng.random() < 0.9] for k, m in enumerate((-0.5, -0.3, -0.1, 0.05, 0.3, -0.2, -0.2))}
    paths |= {100: [(p, 1e200) for p in range(9)], 101: [(p, 1e-200 if p % 2 else 1e150) for p in range(9)], 102: [(0, 0.0), (1, 0.5), (2, 9.0)], 103: [(5, 0.1)]}
    rows = [(k, p, f) for k, path in paths.items() for p, f in path]
    got = {r["k"]: (r["stop"], r["length"]) for r in sequential.stops_by_fold(spark.createDataFrame(rows, "k long, pos long, factor double").repartition(3), ["k"], 3.0, chunk=chunk).collect()}
    for k, path in paths.items():
        g, stop = 0.0, None
        for p, f in path:
            g = (g + 1.0) * f
            if g >= 3.0:
                stop = p
                break
        if path:
            assert got[k] == (stop, len(path))


def test_threshold_choice(spark):
    """60 horizons: with one stop the bound at 90 % is 0.063, with three 0.109; a method that always stops has no threshold."""
    counts = spark.createDataFrame([("slow", 4.0, 60, 0), ("slow", 1.5, 60, 1), ("slow", 1.0, 60, 3), ("eager", 4.0, 60, 60)], "method string, threshold double, horizons long, false_stops long")
    got = {r["method"]: (r["threshold"], r["operating_point"]) for r in sequential.calibrated_threshold(counts, ["method"], 0.90, 0.08).collect()}
    assert got == {"slow": (1.5, "Available"), "eager": (None, "Operating Point Unavailable")}


def test_evidence_values(spark):
    assert abs(one(spark, evidence.signed_factor(F.lit(1.0), 1.0, 0.5)) - math.exp(0.375)) < 1e-12
    assert abs(one(spark, evidence.signed_factor(F.lit(-3.0), 1.0, 0.5)) - math.exp(-0.625)) < 1e-12
    assert abs(one(spark, evidence.operational_factor(F.lit(2.0), F.lit(2.0), 1e-6, 1.0, 0.5)) - math.exp(-0.125)) < 1e-12
    with pytest.raises(ValueError):
        evidence.signed_statistic(F.array(F.lit(1.0)), 0.0, 1.0)
    rows = spark.createDataFrame([(0, 1, 2.0), (0, 1, 4.0)], "epoch int, ord int, factor double")
    epochs = spark.createDataFrame([(0,), (1,)], "epoch int")
    got = {r["epoch"]: (r["e1"], r["e2"]) for r in evidence.order_evidence(rows, ["epoch"], (1, 2), epochs).collect()}
    assert got == {0: (3.0, 1.0), 1: (1.0, 1.0)}
    three = spark.createDataFrame([(0, 1.0, 3.0, 5.0)], "epoch int, e1 double, e2 double, e3 double")
    assert evidence.combine_orders(three, ["epoch"], {"full": (1, 2, 3)}).first()["factor"] == 3.0


def test_recursion_and_stop(spark):
    rows = spark.createDataFrame([("h", i, f) for i, f in enumerate((2.0, 1.5))], "k string, pos long, factor double")
    states = [r["state"] for r in sequential.global_state(rows, ["k"]).orderBy("pos").collect()]
    assert [round(s, 12) for s in states] == [2.0, 4.5]
    rows = spark.createDataFrame([("h", i, f, s) for i, (f, s) in enumerate(((1.0, False), (2.0, True), (2.0, True)))], "k string, pos long, factor double, supported boolean")
    stops = {r["threshold"]: r["stop"] for r in sequential.global_stops(sequential.global_state(rows, ["k"]), ["k"], (2.0, 100.0)).collect()}
    assert stops == {2.0: 1, 100.0: None}
    long = spark.range(5000).select(F.lit("t").alias("k"), F.col("id").alias("pos"), F.lit(1.0).alias("factor"))
    fold = sequential.stops_by_fold(long, ["k"], 1000.0)
    assert fold.first()["stop"] == 999
    assert sequential.restricted_mean(fold, ["k"], 100).first()["restricted_mean"] == 100.0


def test_distributed_support_window(spark):
    rows = spark.createDataFrame([("h", 0, 2.0, ["a"]), ("h", 3, 2.0, ["b", "a"]), ("h", 9, 1.0, ["a", "b"])], "k string, pos long, factor double, members array<string>")
    got = {r["pos"]: r["active_clients"] for r in sequential.distributed_support(rows, ["k"], 1.25, 5, 2).collect()}
    assert got == {p: 2 for p in range(3, 8)}


def test_strict_lead(spark):
    schema = "c int, stop long"
    glob = spark.createDataFrame([(1, 4), (2, 5), (3, None), (4, 2)], schema)
    local = metrics.earliest_local(spark.createDataFrame([(1, 5), (1, 8), (2, 5), (2, 8), (3, 5), (4, None)], schema), ["c"])
    got = {r["c"]: (r["indicator"], r["detected"]) for r in metrics.strict_lead(glob, local, ["c"]).collect()}
    assert got == {1: (1, 1), 2: (0, 1), 3: (0, 0), 4: (0, 1)}
    assert one(spark, metrics.censored_stop(F.lit(None).cast("long"), 60, 1)) == 61


def test_coalitions(spark):
    assert coalitions.coalition_count(12, 3) == 298 and coalitions.coalition_count(48, 3) == 18_472
    assert coalitions.required_outside(9, 2, 0.5) == 5 and coalitions.required_outside(1, 2, 0.5) == 2
    for k in (1, 2, 3, 5):
        ids = spark.createDataFrame([(f"c{i}",) for i in range(k)], "client_id string")
        rows = coalitions.enumerate_coalitions(ids, k, 3).collect()
        assert len(rows) == len({r["coalition_id"] for r in rows}) == coalitions.coalition_count(k, 3)
        assert all(sorted(r["members"] + r["complement"]) == [f"c{i}" for i in range(k)] for r in rows)
    subsets = coalitions.proper_subsets(coalitions.enumerate_coalitions(ids, 5, 3)).filter("coalition_id = 'c0|c1|c2'").collect()
    assert sorted("".join(r["subset"]) for r in subsets) == ["c0", "c0c1", "c0c2", "c1", "c1c2", "c2"]


def test_context_variants(spark):
    from tidewatch.operators import contexts

    lagged = [i / 6 + 0.01 for i in range(6)]
    row = spark.createDataFrame([([0, 1, 2], lagged, [True] * 6)], "idx array<int>, lagged array<double>, avail array<boolean>")
    kept = {"exact": [3, 4, 5], "inclusive": range(6), "leave_one_out": range(1, 6), "partial": range(2, 6), "local_history": range(3)}
    for variant, members in kept.items():
        hist = row.select(contexts.outside_histogram(variant, F.col("idx"), F.col("lagged"), F.col("avail"), 6)).first()[0]
        assert [i for i, m in enumerate(hist) if m > 0] == list(members) and abs(sum(hist) - 1) < 1e-12


def test_perturbations(spark):
    rows = spark.createDataFrame([("a", 0, 1.0, 0.9), ("b", 0, 2.0, 0.1)], "client_id string, epoch int, score double, rank double")
    moved = {r["client_id"]: r["score"] for r in perturb.shift_scores(rows, perturb.target_clients(["b", "a"], 1), 1.5).collect()}
    assert moved == {"a": 2.5, "b": 2.0}
    assert perturb.contaminated_clients(["d", "b", "c"], 0.5) == ["b", "c"] and perturb.contaminated_clients(["b"], 0.0) == []
    raised = {r["client_id"]: r["rank"] for r in perturb.contaminate_ranks(rows, ["a"], 0.25, 1e-12).collect()}
    assert raised == {"a": 1 - 1e-12, "b": 0.1}
    assert abs(one(spark, perturb.nuisance(F.lit(0.0), "softplus"))) < 1e-12


def test_federated_mean_and_tree_samples(spark):
    models = spark.createDataFrame([("a", 1, [1.0, 3.0]), ("b", 3, [5.0, 7.0])], "client_id string, n long, weights array<double>")
    assert [r["w"] for r in detectors.federated_mean(models).orderBy("slot").collect()] == [4.0, 6.0]
    rows = spark.range(300).select(F.lit("a").alias("client_id"), F.col("id").alias("epoch"), F.array(F.col("id").cast("double"), (F.col("id") % 7).cast("double")).alias("features"))
    samples = detectors.tree_samples(rows, 9, 64, 3)
    sizes = samples.groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("epoch").alias("d")).collect()
    assert len(sizes) == 9 and all(r["n"] == r["d"] == 64 for r in sizes)
    small = detectors.tree_samples(rows.limit(20), 3, 64, 3).groupBy("tree").count().collect()
    assert [r["count"] for r in small] == [20, 20, 20]


def test_isolation_scores_follow_the_nodes(spark):
    """Every row walks by hand; blocks of a client, a client without trees and rows that are all alike."""
    import numpy as np

    rng = np.random.default_rng(7)
    data = [("a", i, np.round(rng.normal(size=3), 3).tolist()) for i in range(90)] + [("b", i, [1.0, 2.0, 3.0]) for i in range(7)] + [("c", 0, [0.0, 0.0, 0.0]), ("d", 0, [0.0, 1.0, 0.0])]
    rows = spark.createDataFrame(data, "client_id string, epoch long, features array<double>").repartition(3)
    samples = detectors.tree_samples(rows.filter("client_id <> 'd'"), 5, 16, 2)
    nodes = detectors.isolation_nodes(samples, 2)
    table = {(r["client_id"], r["tree"], r["node"]): r for r in nodes.collect()}
    taken = {(c, t): [r for r in samples.collect() if (r["client_id"], r["tree"]) == (c, t)] for c in "abc" for t in range(5)}
    for (c, t), mine in taken.items():
        assert table[c, t, 1]["size"] == len(mine) == min(16, sum(d[0] == c for d in data))
    assert len({tuple(sorted(r["epoch"] for r in taken["a", t])) for t in range(5)}) == 5

    def mean_path(n):
        return 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def score(client, x):
        total = 0.0
        for t in range(5):
            node = 1
            while table[client, t, node]["feature"] >= 0:
                here = table[client, t, node]
                node = 2 * node + (x[here["feature"]] > here["cut"])
            end = table[client, t, node]
            total += (node.bit_length() - 1 + mean_path(end["size"])) / max(mean_path(end["sample"]), 1e-12)
        return 2 ** (-total / 5)

    for block in (10, 1 << 16):
        got = detectors.isolation_scores(rows, nodes, 5, block).collect()
        assert len(got) == len(data)
        for r in got:
            assert r["score"] is None if r["client_id"] == "d" else r["score"] == pytest.approx(score(r["client_id"], r["features"]), abs=1e-12)


def test_isolation_and_autoencoder_rank_outliers_high(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    data = [("a", i, rng.normal(0, 1, 4).tolist()) for i in range(200)] + [("a", 999, [9.0, -9.0, 9.0, 9.0])]
    rows = spark.createDataFrame(data, "client_id string, epoch long, features array<double>")
    fit = rows.filter("epoch < 999")
    trees = detectors.isolation_nodes(detectors.tree_samples(fit, 25, 64, 3), 3)
    scored = detectors.isolation_scores(rows, trees, 25).orderBy(F.desc("score"))
    assert scored.first()["epoch"] == 999
    models = detectors.train_autoencoders(fit, 4, 30, 0.001, 32, 3)
    assert detectors.reconstruction_scores(rows, models, 4).orderBy(F.desc("score")).first()["epoch"] == 999
    rbf = {r["epoch"]: r["score"] for r in detectors.rbf_scores(rows, fit, 4, 256, 3).collect()}
    x = np.array([d[2] for d in data])
    gamma = 1 / (4 * x[:200].var())
    exact = [1 - np.exp(-gamma * ((x[:200] - v) ** 2).sum(1)).mean() for v in x]
    assert max(abs(rbf[d[1]] - e) for d, e in zip(data, exact, strict=True)) < 0.2 and rbf[999] > np.quantile(list(rbf.values()), 0.9)
