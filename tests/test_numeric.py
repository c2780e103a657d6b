"""Ranks, running sums, projections, statistics: against brute force and fixed values."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import arrays, basis, binomial, prefix, quantiles
from tidewatch.operators import comparators, contexts, metrics, projection, statistics


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_running_sums_across_chunks(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), i, rng.randint(0, 9)) for i in rng.sample(range(-500, 900), 600)]
    frame = spark.createDataFrame(data, "k string, t long, v long").repartition(7)
    got = prefix.running_sums(frame, ["k"], ["t"], prefix.time_chunk("t", 13), {"s": "v"}, whole=True).collect()
    for key in "ab":
        rows = sorted((t, v) for k, t, v in data if k == key)
        want = dict(zip([t for t, _ in rows], np.cumsum([v for _, v in rows]), strict=True))
        mine = {r["t"]: r["s"] for r in got if r["k"] == key}
        assert mine == want and {r["s_all"] for r in got if r["k"] == key} == {sum(v for _, v in rows)}
    linked = prefix.previous_and_next(frame.select("k", "t"), ["k"], "t", 13, include_next=True).collect()
    for key in "ab":
        times = sorted(t for k, t, _ in data if k == key)
        assert {r["t"]: (r["previous"], r["following"]) for r in linked if r["k"] == key} == {
            t: (times[i - 1] if i else None, times[i + 1] if i + 1 < len(times) else None) for i, t in enumerate(times)
        }
    placed = prefix.row_positions(frame.select("k", "t"), ["k"], "t", 13).collect()
    assert sorted(r["pos"] for r in placed if r["k"] == "a") == list(range(sum(1 for d in data if d[0] == "a")))


def test_midranks_with_hot_ties(spark):
    rng = random.Random(2)
    ref = [("a", rng.choice([0.0, 0.0, 0.0, -3.5, 1e6, 2.25, rng.random()])) for _ in range(400)] + [("b", 1.0)]
    ask = [("a", v) for v in (-9.0, 0.0, 0.5, 2.25, 1e6, 1e7)] + [("b", 1.0), ("c", 1.0)]
    frames = [spark.createDataFrame(d, "k string, v double") for d in (ref, ask)]
    got = {(r["k"], r["v"]): r["midrank"] for r in prefix.midrank_table(*frames, ["k"], "v", prefix.magnitude_bucket("v", 2)).collect()}
    for key, value in ask:
        mine = [v for k, v in ref if k == key]
        want = None if not mine else (sum(v < value for v in mine) + 0.5 * sum(v == value for v in mine) + 0.5) / (len(mine) + 1)
        assert got[key, value] == want
    four = [spark.createDataFrame([(0, v) for v in d], "k int, v double") for d in ([0.0, 0.5, 0.5, 1.0], [0.5])]
    assert {r["v"]: r["midrank"] for r in prefix.midrank_table(*four, ["k"], "v", prefix.unit_bucket("v")).collect()}[0.5] == 0.5


@pytest.mark.parametrize("limit", [5, 60, 1 << 16])
def test_quantiles_by_selection(spark, limit):
    """Frequent values, values over many magnitudes, two values, one value, nulls, and a key with most of the rows."""
    rng = np.random.default_rng(8)
    data = {
        "hot": np.where(rng.random(9000) < 0.4, 0.0, rng.normal(size=9000)), "wide": np.sign(rng.normal(size=700)) * 10.0 ** rng.integers(-300, 300, 700),
        "two": np.repeat([1.0, 2.0], [399, 1]), "same": np.full(300, 7.5), "one": np.array([3.0]), "steps": rng.integers(0, 5, 2000).astype(float), None: rng.random(400),
    }
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("hot", None), ("void", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(4)
    ps = (0.0, 0.25, 0.5, 0.9, 0.999, 1.0)
    got = {r["k"]: r["q"] for r in quantiles.exact_quantiles(frame, ["k"], "v", ps, limit).collect()}
    want = {r["k"]: r["q"] for r in frame.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(p) for p in ps])).alias("q")).collect() if r["q"]}
    assert got == want
    whole = quantiles.exact_quantiles(frame, [], "v", (0.3,), limit).first()["q"]
    assert whole == frame.agg(F.percentile("v", F.array(F.lit(0.3)))).first()[0]


def test_binomial_bounds(spark):
    def cdf(x, n, p):
        return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1))

    for x, n in ((0, 59), (4, 200), (5, 200), (20, 20), (7, 43)):
        row = spark.createDataFrame([(x, n)], "x long, n long").select(
            binomial.upper_bound(F.col("x"), F.col("n"), 0.95).alias("u"),
            binomial.bound_within(F.col("x"), F.col("n"), 0.95, 0.05).alias("ok"),
            binomial.lower_bound(F.col("x"), F.col("n"), 0.95).alias("l"),
        ).first()
        assert row["u"] == 1.0 if x == n else abs(cdf(x, n, row["u"]) - 0.05) < 1e-9
        assert row["ok"] == (x < n and row["u"] <= 0.05 + 1e-12)
        assert row["l"] == 0.0 if x == 0 else abs(1 - cdf(x - 1, n, row["l"]) - 0.05) < 1e-9
    assert binomial.minimum_horizons(0.05, 0.95) == 59
    big = spark.createDataFrame([(900, 20_000)], "x long, n long").select(binomial.bound_within(F.col("x"), F.col("n"), 0.95, 0.05)).first()[0]
    assert big


def test_binomial_bounds_of_large_counts_cost_no_more(spark):
    """A billion successes: against sums of probability ratios around the bound, and the tail at it."""

    def tail(x, n, p):
        reach = int(40 * math.sqrt(n * p * (1 - p)) + 40)
        down = np.arange(x, max(0, x - reach), -1, dtype=np.longdouble)
        up = np.arange(x + 1, min(n, x + reach) + 1, dtype=np.longdouble)
        odds = np.log(np.longdouble(p)) - np.log1p(-np.longdouble(p))
        below = 1 + np.exp(np.cumsum(np.log(down) - np.log(n - down + 1) - odds)).sum()
        above = np.exp(np.cumsum(np.log(n - up + 1) - np.log(up) + odds)).sum()
        return float(below / (below + above))

    for x, n in ((10**9, 2 * 10**9), (1000, 10**9), (3, 10**9), (10**6, 10**8), (2 * 10**6 - 5, 2 * 10**6), (40, 1500)):
        got = spark.createDataFrame([(x, n)], "x long, n long").select(binomial.upper_bound(F.col("x"), F.col("n"), 0.95).alias("u")).first()["u"]
        assert tail(x, n, got) == pytest.approx(0.05, abs=1e-9)
        cdf = spark.createDataFrame([(x, n, got)], "x long, n long, p double").select(binomial.binomial_cdf(F.col("x"), F.col("n"), F.col("p"))).first()[0]
        assert cdf == pytest.approx(0.05, abs=1e-9)


def test_basis_native_equals_numpy(spark):
    rng = np.random.default_rng(3)
    for order in (1, 2, 3):
        u = rng.random((5, order))
        frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(u)], "i int, u array<double>")
        rows = frame.select("i", basis.design(F.col("u"), 3).alias("d"), basis.tensor(F.col("u"), 3).alias("t")).orderBy("i").collect()
        x, y = basis.design_and_tensor(u, 3)
        np.testing.assert_allclose([r["d"] for r in rows], x, atol=1e-12)
        np.testing.assert_allclose([r["t"] for r in rows], y, atol=1e-12)
        assert x.shape[1] == basis.design_size(order, 3) == (1, 7, 37)[order - 1] and y.shape[1] == (3, 9, 27)[order - 1]
    q = (np.arange(2000) + 0.5) / 2000
    gram = basis.phi_matrix(q, 4).T @ basis.phi_matrix(q, 4) / 2000
    np.testing.assert_allclose(gram, np.eye(4), atol=1e-4)


def test_folds_and_ridge_ties(spark):
    rows = spark.createDataFrame([("a", 0, 100 + 3 * i, [0.5]) for i in range(11)] + [("b", 0, i, [0.5]) for i in range(4)], "coalition_id string, cell int, epoch long, r array<double>")
    got = projection.with_folds(rows, 5).filter("coalition_id = 'a'").orderBy("epoch").collect()
    assert [r["fold"] for r in got] == [0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert projection.with_folds(rows, 5).filter("coalition_id = 'b'").count() == 0
    assert projection.choose_ridge((0.01, 0.1), [1.0, 1.0], 1e-12) == 0.1
    assert projection.choose_ridge((0.01, 0.1), [1.0, 1.0 + 1e-9], 1e-12) == 0.01


@pytest.mark.parametrize("order", [2, 3])
def test_chunked_fit_equals_direct_fit(spark, order, monkeypatch):
    """Factors of many chunks give the fit of all rows, also where the design is rank deficient."""
    rng = np.random.default_rng(order)
    n, folds, size = 157, 5, 2
    u = rng.random((n, order))
    if order == 2:
        u[:, 1] = rng.choice([0.25, 0.75], n)  # two levels: second-degree columns are dependent
    monkeypatch.setattr(prefix, "CHUNK", 4096)
    data = [("a", order, 0, 10 * i, r.tolist()) for i, r in enumerate(u)]
    rows = spark.createDataFrame(data, "coalition_id string, ord int, cell int, epoch long, r array<double>").repartition(5)
    folded = projection.with_folds(rows, folds)
    spread = folded.withColumn("pos", F.col("pos") * 200)  # ~ 20 rows per chunk
    candidates = (0.0, 1e-4, 1e-2, 1.0)
    fits = {r["fold"]: r for r in projection.fit_projections(spread, size, candidates, folds, 1e-12, 1e-12).collect()}
    x, y = basis.design_and_tensor(u, size)
    parts = np.array_split(np.arange(n), folds)
    errors = []
    for ridge in candidates:
        total = 0.0
        for held in parts:
            train = np.setdiff1d(np.arange(n), held)
            if ridge:
                pen = np.eye(x.shape[1]) * ridge
                pen[0, 0] = 0
                m = np.linalg.solve(x[train].T @ x[train] + pen, x[train].T @ y[train])
            else:
                m = np.linalg.pinv(x[train], rcond=1e-12) @ y[train]
            total += np.sum((y[held] - x[held] @ m) ** 2)
        errors.append(total / n)
    np.testing.assert_allclose(fits[-1]["cv"], errors, rtol=1e-8)
    assert fits[-1]["ridge"] == candidates[int(np.argmin(errors))] and set(fits) == {-1, 0, 1, 2, 3, 4}
    got = projection.held_innovations(folded, spark.createDataFrame([(*r[:6], r[6], r[7], r[8], r[9]) for r in fits.values()], projection.FIT_SCHEMA), size)
    z = {r["epoch"]: r["z"] for r in got.collect()}
    ridge = fits[-1]["ridge"]
    held = parts[1]
    train = np.setdiff1d(np.arange(n), held)
    pen = np.eye(x.shape[1]) * ridge
    pen[0, 0] = 0
    m = np.linalg.pinv(x[train], rcond=1e-12) @ y[train] if ridge == 0 else np.linalg.solve(x[train].T @ x[train] + pen, x[train].T @ y[train])
    for i in held:
        np.testing.assert_allclose(z[10 * i], y[i] - x[i] @ m, atol=1e-7)


def test_nearest_centroid_tie(spark):
    cells = F.array(*[F.array(F.lit(a), F.lit(0.0)) for a in (0.0, 2.0)])
    assert one(spark, arrays.nearest(F.array(F.lit(1.0), F.lit(0.0)), cells, 1e-12)) == 0
    assert one(spark, arrays.nearest(F.array(F.lit(1.5), F.lit(0.0)), cells, 1e-12)) == 1


def test_histogram_bins_and_abstention(spark):
    bins = [one(spark, contexts.histogram_bin(F.lit(u), 8)) for u in (0.01, 0.13, 0.99, 1.0)]
    assert bins == [0, 1, 7, 7]
    row = spark.createDataFrame([([0], [0.5, 0.25, None, 0.0, 0.99], [True, True, True, True, True])], "idx array<int>, lagged array<double>, avail array<boolean>")
    row = contexts.federation_bins(row, 2)
    exact = row.select(contexts.exact_histogram(F.col("idx"), F.col("_bins"), F.col("_counts"), F.col("avail"), F.col("_n"))).first()[0]
    assert exact == [0.5, 0.25]  # four outside clients are available, one has no lagged rank
    direct = row.select(contexts.outside_histogram("exact", F.col("idx"), F.col("lagged"), F.col("avail"), 2)).first()[0]
    assert direct == exact


def test_kmeans_finds_separated_groups(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):
        centre = [0.8, 0.2, 0.0] if i % 3 else [0.1, 0.1, 0.8]
        rows.append(("d", 1, [f"c{i % 5}"], i, (np.array(centre) + np.round(rng.random(3) * 0.05, 2)).tolist()))
    frame = spark.createDataFrame(rows, "dataset string, ord int, members array<string>, epoch long, hist array<double>")
    capped = contexts.capped_rows(frame, 4100, 1000)
    assert sorted(r["pos"] for r in capped.collect()) == list(range(120))
    assert contexts.capped_rows(frame, 4100, 7).count() == 7
    best = contexts.fit_centroids(frame, 2, 5, 50, 1e-6, 1e-12, 7).first()["cells"]
    x = np.array([r[4] for r in rows])
    groups = [x[[i for i in range(120) if (i % 3 > 0) == side]].mean(0) for side in (True, False)]
    np.testing.assert_allclose(sorted(best), sorted(g.tolist() for g in groups), atol=1e-9)
    assert contexts.fit_centroids(frame.limit(1), 2, 1, 5, 1e-6, 1e-12, 7).collect() == []


def plain_kmeans(x, cells, restarts, iterations, tolerance, tie, seed):
    """Row by row: the same draws, no weights, no distinct histograms."""
    x = np.array(sorted(x.tolist()))
    n, runs = len(x), []
    for r in range(restarts):
        state = x[contexts._starts(seed, n, r, cells)]
        for step in range(iterations):
            far = np.sqrt(((x[:, None] - state[None]) ** 2).sum(2))
            cell = (far - far.min(1, keepdims=True) <= tie).argmax(1)
            new = np.stack([x[cell == c].mean(0) if (cell == c).any() else x[contexts.draw_number(seed, n, r, c, step)] for c in range(cells)])
            shift = np.linalg.norm(new - state, axis=1).max()
            inertia = sum(((x[cell == c] - new[c]) ** 2).sum() for c in range(cells))
            state = new
            if shift <= tolerance:
                break
        runs.append((inertia, state))
    least = min(i for i, _ in runs)
    return next(s for i, s in runs if i <= least + 1e-9 * (1 + least))


@pytest.mark.parametrize("cells", [2, 4])
def test_kmeans_agrees_with_plain_rows(spark, cells):
    """Two keys, many equal histograms (so that cells run empty) and every restart to its end."""
    rng = np.random.default_rng(cells)
    x = {o: np.repeat(rng.integers(0, 4, size=(9, 3)) / 8, rng.integers(1, 30, size=9), axis=0) for o in (1, 2)}
    frame = spark.createDataFrame([(o, h.tolist()) for o, m in x.items() for h in m], "ord int, hist array<double>").repartition(3)
    got = {r["ord"]: r["cells"] for r in contexts.fit_centroids(frame, cells, 6, 50, 1e-9, 1e-12, 11).collect()}
    for o, m in x.items():
        np.testing.assert_allclose(got[o], plain_kmeans(m, cells, 6, 50, 1e-9, 1e-12, 11), atol=1e-12)
    two = spark.createDataFrame([(1, [0.5])] * 5, "ord int, hist array<double>")
    assert contexts.fit_centroids(two, 2, 3, 10, 1e-9, 1e-12, 1).first()["cells"] == [[0.5], [0.5]]


def test_training_hash_is_canonical_json(spark):
    import hashlib
    import json

    body = {"context_seed": 4100, "dataset": "d", "coalition_order": 2, "coalition_client_ids": ["a", "b"], "epoch_index": 12}
    want = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    got = one(spark, contexts.training_hash(F.lit("d"), F.lit(2), F.array(F.lit("a"), F.lit("b")), F.lit(12), 4100))
    assert got == want


def plain_tau(a, b):
    n = len(a)
    s = sum(np.sign(a[i] - a[j]) * np.sign(b[i] - b[j]) for i in range(n) for j in range(i))
    ties = [sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1]) for v in (a, b)]
    n0 = n * (n - 1) / 2
    spread = math.sqrt((n0 - ties[0]) * (n0 - ties[1]))
    return s / spread if spread else 0.0


@pytest.mark.parametrize(("points", "fan"), [(2, 2), (7, 3), (1 << 16, 16)])
def test_kendall_over_levels(spark, points, fan):
    """Ties, repeated points, a value of x that half the points share, points outside 0 to 1, several keys."""
    rng = np.random.default_rng(5)
    data = {"a": rng.integers(0, 12, (150, 2)) / 12, "b": np.stack([np.where(rng.random(90) < 0.5, -3.0, rng.normal(size=90) * 100), rng.normal(size=90)], 1)}
    data |= {"one": np.array([[1.0, 2.0]]), "flat": np.array([[1.0, 2.0], [1.0, 3.0]]), "c": np.repeat(rng.random((20, 2)), 3, axis=0)}
    frame = spark.createDataFrame([(k, float(x), float(y)) for k, m in data.items() for x, y in m], "k string, a double, b double").repartition(3)
    got = {r["k"]: r["tau"] for r in comparators.kendall(frame, ["k"], "a", "b", points, fan).collect()}
    for k, m in data.items():
        assert got[k] == pytest.approx(plain_tau(m[:, 0], m[:, 1]), abs=1e-12)


def test_concordance_by_merging():
    rng = np.random.default_rng(9)
    for n in (2, 5, 64, 129, 700):
        y, w = rng.permutation(n), rng.integers(1, 5, n).astype(float)
        want = sum(w[i] * w[j] * np.sign(y[i] - y[j]) for i in range(n) for j in range(i))
        assert comparators.concordance(y, w, small=1) == want == comparators.concordance(y, w)


def test_pair_tables_and_ipf():
    rng = np.random.default_rng(6)
    full = comparators.smoothed_table(rng.integers(0, 9, (4, 4, 4)).astype(float), 0.5)
    assert abs(full.sum() - 1) < 1e-12
    pair, _ = comparators.pair_maxent(full, 10_000, 1e-10)
    for axis in range(3):
        np.testing.assert_allclose(pair.sum(axis=axis), full.sum(axis=axis), atol=1e-9)
    logs = np.log(pair)
    third = logs - logs[:1] - logs[:, :1] - logs[:, :, :1] + logs[:1, :1] + logs[:1, :, :1] + logs[:, :1, :1] - logs[:1, :1, :1]
    assert np.abs(third).max() < 1e-6  # no triple term is left


def test_moments_and_h_function(spark):
    assert one(spark, comparators.dependence_moment(F.array(F.lit(0.5), F.lit(0.5)))) == 0
    assert one(spark, comparators.dependence_moment(F.array(F.lit(1.0), F.lit(1.0)))) == 1
    assert one(spark, comparators.dependence_moment(F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0)))) == -1
    assert abs(one(spark, comparators.gaussian_h(F.lit(0.3), F.lit(0.8), F.lit(0.0), 1e-12)) - 0.3) < 1e-12


def test_cusum_forms_agree(spark):
    assert abs(max(0.0, 1 + 0.9 - 0.5 - 0.05) - 1.35) < 1e-12
    rng = random.Random(8)
    data = [(c, t, rng.random()) for c in "xy" for t in range(200)]
    frame = spark.createDataFrame(data, "c string, t long, rank double").repartition(3)
    want = {}
    for c in "xy":
        state = 0.0
        for _, t, r in sorted(d for d in data if d[0] == c):
            state = max(0.0, state + r - 0.55)
            want[c, t] = state
    for out in (comparators.cusum(frame, ["c"], "t", 0.5, 0.05), comparators.cusum_stream(frame, ["c"], "t", 0.5, 0.05, 17)):
        got = {(r["c"], r["t"]): r["cusum"] for r in out.collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-12


def test_factor_rank_and_residual(spark):
    assert comparators.factor_rank(np.array([2.0, 1.0, 0.1]), 0.8, 3, (1, 2, 3)) == 2
    assert comparators.factor_rank(np.array([0.0]), 0.8, 3, (1, 2, 3)) == 3
    rng = np.random.default_rng(9)
    x = rng.random((60, 4))
    panel = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "epoch int, now array<double>")
    got = comparators.factor_residuals(panel, panel, 4, 0.8, 3, (1, 2, 3)).orderBy("epoch").collect()
    centred = x - x.mean(0)
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    rank = next((r for r in (1, 2, 3) if (s[:r] ** 2).sum() / (s**2).sum() >= 0.8), 3)
    want = np.linalg.norm(centred - centred @ v[:rank].T @ v[:rank], axis=1)
    np.testing.assert_allclose([r["factor_residual"] for r in got], want, atol=1e-10)


def test_strongest_comparator_scans_in_order(spark):
    schema = "pos int, name string, error double, runtime double"
    chain = [(1, "c", 0.020, 1.0), (2, "b", 0.012, 2.0), (3, "a", 0.004, 2.0)]
    assert comparators.strongest_comparator(spark.createDataFrame(chain, schema), 0.01, 1e-6).first()["name"] == "a"
    tie = [(1, "z", 0.5, 1.0), (2, "a", 0.505, 1.0)]
    assert comparators.strongest_comparator(spark.createDataFrame(tie, schema), 0.01, 1e-6).first()["name"] == "a"
    single = [(1, "z", 0.5, 1.0)]
    assert comparators.strongest_comparator(spark.createDataFrame(single, schema), 0.01, 1e-6).first()["name"] == "z"


def test_nearest_sums_of_a_task_are_those_of_each_row():
    rng = np.random.default_rng(5)
    rows = [{"ord": int(rng.integers(1, 4)), "hist": rng.integers(0, 3, 3).astype(float).tolist(), "w": int(rng.integers(1, 9))} for _ in range(90)]
    centers = {(o,): ([0, 4], rng.integers(0, 3, (2, 2, 3)).astype(float)) for o in (1, 2)}
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 40], schema=pa.schema([("ord", pa.int32()), ("hist", pa.list_(pa.float64())), ("w", pa.int64())])) for i in (0, 40, 80)]
    out = [r for b in contexts._nearest_sums(["ord"], centers, 1e-12)(iter(batches)) for r in b.to_pylist()]
    want = {}
    for row in rows:
        for i, r in enumerate(centers.get((row["ord"],), ([], None))[0]):
            apart = [math.dist(row["hist"], c) for c in centers[row["ord"],][1][i]]
            cell = next(j for j, d in enumerate(apart) if d - min(apart) <= 1e-12)
            w, s, q = want.get((row["ord"], r, cell), (0, np.zeros(3), 0.0))
            want[row["ord"], r, cell] = (w + row["w"], s + np.array(row["hist"]) * row["w"], q + np.dot(row["hist"], row["hist"]) * row["w"])
    assert {(r["ord"], r["restart"], r["cell"]): (r["w"], r["s"], r["sq"]) for r in out} == {k: (w, s.tolist(), q) for k, (w, s, q) in want.items()}


def test_intervals_are_solved_once_for_equal_counts(spark, monkeypatch):
    solved = []
    monkeypatch.setattr(statistics, "written", lambda df, name: solved.append(df) or df)
    counts = [(0, 5), (2, 9), (9, 9), (0, 0), (None, 4)]
    rows = spark.createDataFrame([(i, *counts[i % 5]) for i in range(500)], "k int, x long, n long")
    got = statistics.two_sided_interval(rows, "x", "n", 0.95)
    assert got.columns == ["k", "x", "n", "lower", "upper"]
    found = {(r["k"], r["x"], r["n"]): (r["lower"], r["upper"]) for r in got.collect()}
    assert set(found) == {(i, *counts[i % 5]) for i in range(500)}
    assert [d.count() for d in solved] == [5]
    assert solved[0].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    for i, (x, n) in enumerate(counts[:3]):
        lower, upper = found[i, x, n]
        assert x == 0 and lower == 0 or abs(sum(math.comb(n, k) * lower**k * (1 - lower) ** (n - k) for k in range(x, n + 1)) - 0.025) < 1e-9
        assert x == n and upper == 1 or abs(sum(math.comb(n, k) * upper**k * (1 - upper) ** (n - k) for k in range(x + 1)) - 0.025) < 1e-9


def test_ranking_quality(spark):
    rng = random.Random(11)
    data = [("k", round(rng.random() * 3, 1), rng.random() < 0.3) for _ in range(300)] + [("none", 1.0, False)]
    got = {r["k"]: r for r in metrics.ranking_quality(spark.createDataFrame(data, "k string, s double, y boolean"), ["k"], "s", "y").collect()}
    pos = [s for k, s, y in data if k == "k" and y]
    neg = [s for k, s, y in data if k == "k" and not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(got["k"]["auroc"] - auc) < 1e-12
    ap, last = 0.0, 0.0
    for cut in sorted({s for k, s, _ in data if k == "k"}, reverse=True):
        tp, fp = sum(p >= cut for p in pos), sum(n >= cut for n in neg)
        ap += (tp / len(pos) - last) * tp / (tp + fp)
        last = tp / len(pos)
    assert abs(got["k"]["average_precision"] - ap) < 1e-12
    assert got["none"]["auroc"] is None


def test_ranking_quality_without_negatives(spark):
    """As the SQL has it: precision is one at every cut, and no pair of classes leaves the area undefined."""
    rows = spark.createDataFrame([("k", 1.0, True), ("k", 2.0, True), ("k", 2.0, True), ("none", 1.0, False)], "k string, s double, y boolean")
    got = {r["k"]: r for r in metrics.ranking_quality(rows, ["k"], "s", "y").collect()}
    assert math.isnan(got["k"]["auroc"]) and got["k"]["average_precision"] == 1.0
    assert got["none"]["auroc"] is None and got["none"]["average_precision"] is None


def test_statistics_against_direct_formulas(spark):
    rng = np.random.default_rng(12)
    d = np.round(rng.normal(0.3, 1.0, 8), 3)
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(d)], "seed int, difference double")
    p = statistics.sign_flip_p(statistics.sign_flip_means(frame, "seed", 8, 100_000, 1)).first()
    flips = [np.mean(d * [1 if (k >> j) % 2 == 0 else -1 for j in range(8)]) for k in range(256)]
    assert p["patterns"] == 256
    assert abs(p["p_greater"] - np.mean([f >= d.mean() - 1e-12 for f in flips])) < 1 / 250
    assert abs(p["p_two_sided"] - np.mean([abs(f) >= abs(d.mean()) - 1e-12 for f in flips])) < 1 / 120
    walsh = [(d[i] + d[j]) / 2 for i in range(8) for j in range(i, 8)]
    assert abs(statistics.hodges_lehmann(frame, "seed").first()["shift"] - np.median(walsh)) < 1e-12
    means = statistics.resample_means(frame, "seed", 1500, 5)
    got = statistics.bca_interval(means, frame, "seed", 0.9).first()
    e = np.sort([r["estimate"] for r in means.collect()])
    from statistics import NormalDist

    nd = NormalDist()
    jack = np.array([(d.sum() - v) / 7 for v in d])
    c = jack.mean() - jack
    acc, z0 = (c**3).sum() / (6 * (c**2).sum() ** 1.5), nd.inv_cdf(np.mean(e < got["estimate"]))
    levels = [nd.cdf(z0 + (z0 + nd.inv_cdf(q)) / (1 - acc * (z0 + nd.inv_cdf(q)))) for q in (0.05, 0.95)]
    np.testing.assert_allclose([got["lower"], got["upper"]], np.quantile(e, levels), atol=1e-9)
    flat = spark.createDataFrame([(i, 0.5) for i in range(8)], "seed int, difference double")
    same = statistics.bca_interval(statistics.resample_means(flat, "seed", 50, 5), flat, "seed", 0.9).first()
    assert (same["state"], same["lower"], same["upper"]) == ("Degenerate", 0.5, 0.5)


def test_holm_and_claims(spark):
    tests = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("f", "d", None)], "family string, hypothesis string, p double")
    got = {r["hypothesis"]: r["adjusted_p"] for r in statistics.holm(tests).collect()}
    assert got["d"] is None and abs(got["a"] - 0.04) < 1e-12 and abs(got["c"] - 0.09) < 1e-12 and abs(got["b"] - 0.09) < 1e-12
    assert one(spark, statistics.claim_state(F.lit(0.2), F.lit(0.2), F.lit(True))) == "SUPPORTED"
    assert one(spark, statistics.claim_state(F.lit(None).cast("double"), F.lit(0.2), F.lit(True))) == "NOT_TESTED"
    assert one(spark, statistics.claim_state(F.lit(0.3), F.lit(0.2), F.lit(False))) == "NOT_TESTED"
    assert one(spark, statistics.equivalent(F.lit(-0.5), F.lit(0.5), -1.0, 1.0))


def test_vine_and_binned_scores_against_numpy(spark):
    from statistics import NormalDist

    rng = np.random.default_rng(21)
    z = rng.multivariate_normal([0, 0, 0], [[1, 0.5, 0.3], [0.5, 1, 0.4], [0.3, 0.4, 1]], 90)
    u = np.argsort(np.argsort(z, axis=0), axis=0) / 91 + 0.5 / 91
    frame = spark.createDataFrame([("a|b|c", 0, i, r.tolist()) for i, r in enumerate(u)], "coalition_id string, cell int, epoch long, r array<double>")
    got = {r["epoch"]: r["vine"] for r in comparators.vine_scores(frame, frame, 1e-12).collect()}
    nd = NormalDist()
    q = np.vectorize(nd.inv_cdf)

    def rho(a, b):
        n = len(a)
        s = sum(np.sign(a[i] - a[j]) * np.sign(b[i] - b[j]) for i in range(n) for j in range(i))
        return math.sin(math.pi / 2 * s / (n * (n - 1) / 2))

    def h(a, b, r):
        return np.vectorize(nd.cdf)((q(a) - r * q(b)) / math.sqrt(1 - r * r))

    h1, h3 = h(u[:, 0], u[:, 1], rho(u[:, 0], u[:, 1])), h(u[:, 2], u[:, 1], rho(u[:, 1], u[:, 2]))
    p = rho(h1, h3)
    a, b = q(h1), q(h3)
    want = np.abs(-0.5 * math.log(1 - p * p) - (p * p * (a * a + b * b) - 2 * p * a * b) / (2 * (1 - p * p)))
    np.testing.assert_allclose([got[i] for i in range(90)], want, atol=1e-8)
    tables = comparators.triple_tables(frame, 4, 0.5, 10_000, 1e-10)
    dense = np.zeros((4, 4, 4))
    bins = np.minimum((u * 4).astype(int), 3)
    np.add.at(dense, tuple(bins.T), 1)
    full = (dense + 0.5) / (dense + 0.5).sum()
    rows = {(r["b1"], r["b2"], r["b3"]): r for r in tables.collect()}
    assert len(rows) == 64 and all(abs(rows[k]["p_full"] - full[k]) < 1e-12 for k in rows)
    scored = {r["epoch"]: r for r in comparators.binned_scores(frame, tables, 4, 1e-12).collect()}
    for i in range(90):
        k = tuple(bins[i])
        assert abs(scored[i]["connected_information"] - math.log(full[k] / rows[k]["p_pair"])) < 1e-9
        assert abs(scored[i]["log_linear"] + math.log(rows[k]["p_pair"])) < 1e-9


def test_results_do_not_depend_on_row_order(spark):
    rng = random.Random(4)
    data = [("k", rng.choice([0.1, 0.2, 0.2, rng.random()]), i) for i in range(200)]
    outs = []
    for seed in (1, 2):
        shuffled = random.Random(seed).sample(data, len(data))
        frame = spark.createDataFrame(shuffled, "k string, v double, i long").repartition(seed + 2)
        table = prefix.midrank_table(frame, frame, ["k"], "v", prefix.unit_bucket("v"))
        outs.append(sorted((r["v"], r["midrank"]) for r in table.collect()))
    assert outs[0] == outs[1]
