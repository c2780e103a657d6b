"""Fitted local detectors: isolation trees, a random-feature RBF score and autoencoders.

Raw events never reach these fits. Their rows are one feature array per client and epoch.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidewatch.functions import arrays


def _rng(*parts: object) -> np.random.Generator:
    digest = hashlib.sha256(":".join(map(str, parts)).encode()).digest()
    return np.random.default_rng(int.from_bytes(digest[:8], "big"))


# -- isolation trees ----------------------------------------------------------------------------
#
# Every random choice is the SHA-256 of a seed and names, so a tree is the same on every engine and on every retry.

#: rows of a client that walk its trees in one task
WALK_ROWS = 1 << 16
#: hexadecimal digits of a hash that make a number from 0 to 1
_DIGITS = 13


def unit_draw(*parts: Column) -> Column:
    """Number from 0 to below 1 from the SHA-256 of the parts, joined by colons."""
    digits = F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, _DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def _unit(*parts: object) -> float:
    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:_DIGITS], 16) / 16**_DIGITS


def tree_samples(rows: DataFrame, trees: int, cap: int, seed: int) -> DataFrame:
    """``min(cap, n)`` fit rows per client and tree, those with the smallest draws: without replacement, and each tree on its own.

    A row is made for the trees for which its draw lies below what ``cap`` of the client's rows reach with many standard deviations to
    spare, so about ``trees * cap`` rows per client move, whatever the history. Trees that still lack rows, if any, take theirs from all rows.
    """
    sizes = rows.groupBy("client_id").agg(F.count("*").alias("n"))
    known = rows.select("client_id", "epoch", "features").join(sizes, "client_id")
    draw = lambda t: unit_draw(F.lit(str(seed)), F.lit("row"), F.col("client_id"), t.cast("string"), F.col("epoch").cast("string"))
    bound = F.least(F.lit(1.0), F.lit(cap + 8 * math.sqrt(cap) + 16) / F.col("n"))
    every = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), draw(t).alias("u")))
    near = known.withColumn("c", F.explode(F.filter(every, lambda c: c["u"] < bound))).select("*", "c.tree", "c.u").drop("c")
    counted = near.groupBy("client_id", "tree").agg(F.count("*").alias("got"))
    wanted = sizes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    short = wanted.join(counted, ["client_id", "tree"], "left").filter(F.coalesce("got", F.lit(0)) < F.least(F.lit(cap), F.col("n"))).select("client_id", "tree")
    whole = known.join(short, "client_id").withColumn("u", draw(F.col("tree")))
    both = near.join(short, ["client_id", "tree"], "left_anti").unionByName(whole.select(near.columns))
    first = Window.partitionBy("client_id", "tree").orderBy("u", "epoch")
    kept = both.withColumn("_i", F.row_number().over(first)).filter(F.col("_i") <= cap)
    return kept.select("client_id", "tree", "epoch", "features", F.least(F.col("n"), F.lit(cap)).cast("int").alias("sample"))


def _average_path(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def tree_depth(sample: int) -> int:
    return math.ceil(math.log2(max(sample, 2)))


NODES = "client_id string, tree int, sample int, node int, size int, feature int, cut double"


def isolation_nodes(samples: DataFrame, seed: int) -> DataFrame:
    """All nodes of all trees as rows: children of node i are 2 i and 2 i + 1, a leaf has feature -1.

    A tree grows from at most ``cap`` rows in one group. A node draws one of the features that differ inside it, and a cut between
    their ends; it is a leaf at the depth limit, with one row, or where all rows are alike.
    """

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["features"].to_numpy())
        client, tree, sample = pdf["client_id"].iat[0], int(pdf["tree"].iat[0]), int(pdf["sample"].iat[0])
        limit, pending, out = tree_depth(sample), [(1, np.arange(len(x)))], []
        while pending:
            node, rows = pending.pop()
            lo, hi = x[rows].min(0), x[rows].max(0)
            open_features = np.flatnonzero(hi > lo)
            if node >> limit or len(rows) < 2 or not len(open_features):
                out.append((node, len(rows), -1, 0.0))
                continue
            feature = int(open_features[int(_unit(seed, "feature", client, tree, node) * len(open_features))])
            cut = float(lo[feature] + _unit(seed, "cut", client, tree, node) * (hi[feature] - lo[feature]))
            out.append((node, len(rows), feature, cut))
            right = x[rows, feature] > cut
            pending += [(2 * node, rows[~right]), (2 * node + 1, rows[right])]
        nodes = pd.DataFrame(out, columns=["node", "size", "feature", "cut"])
        return nodes.assign(client_id=client, tree=tree, sample=sample)[["client_id", "tree", "sample", "node", "size", "feature", "cut"]]

    return samples.groupBy("client_id", "tree").applyInPandas(grow, NODES)


def path_lengths(x: np.ndarray, nodes: pd.DataFrame, chunk: int = 256) -> np.ndarray:
    """Sum over trees of the path of each row of ``x``, each over the average path of its sample."""
    names, tree = np.unique(nodes["tree"].to_numpy(), return_inverse=True)
    width = 2 << int(math.log2(nodes["node"].max()))
    shape = (len(names), width)
    feature, cut, ends = np.full(shape, -1), np.zeros(shape), np.zeros(shape)
    at = nodes["node"].to_numpy()
    feature[tree, at], cut[tree, at] = nodes["feature"], nodes["cut"]
    scale = np.maximum(_average_path(nodes["sample"].to_numpy()), 1e-12)
    ends[tree, at] = (np.floor(np.log2(at)) + _average_path(nodes["size"].to_numpy())) / scale
    out = np.zeros(len(x))
    all_trees = np.arange(len(names))[None, :]
    for lo in range(0, len(x), chunk):
        rows = x[lo : lo + chunk]
        line = np.arange(len(rows))[:, None]
        here = np.ones((len(rows), len(names)), dtype=int)
        while True:
            f = feature[all_trees, here]
            moving = f >= 0
            if not moving.any():
                break
            here = np.where(moving, 2 * here + (rows[line, f] > cut[all_trees, here]), here)
        out[lo : lo + chunk] = ends[all_trees, here].sum(1)
    return out


def isolation_scores(rows: DataFrame, nodes: DataFrame, trees: int, block_rows: int = WALK_ROWS) -> DataFrame:
    """``2 ** (-mean path / average path of the sample)`` per row, larger is more anomalous; null without trees.

    Rows of a client are cut into blocks that meet the client's nodes in a join of groups and walk all trees level by level. A
    client's trees have a size fixed by parameters, and blocks of a client with very many rows lie in as many tasks.
    """
    blocks = rows.groupBy("client_id").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("_blocks"))
    dealt = rows.join(blocks, "client_id").withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), "_blocks")).drop("_blocks")
    copied = nodes.join(blocks, "client_id").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", score double"

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.drop(columns="_block")
        if not len(left) or not len(right):
            return left.assign(score=np.nan)
        return left.assign(score=np.exp2(-path_lengths(np.stack(left["features"].to_numpy()), right) / trees))

    scored = dealt.groupBy("client_id", "_block").cogroup(copied.groupBy("client_id", "_block")).applyInPandas(walk, schema)
    return scored.withColumn("score", F.when(~F.isnan("score"), F.col("score")))


# -- RBF one-class score ------------------------------------------------------------------------


def rbf_frequencies(dimension: int, count: int, seed: int) -> tuple[list[list[float]], list[float]]:
    rng = np.random.default_rng(seed)
    return rng.standard_normal((count, dimension)).round(6).tolist(), (rng.random(count) * 2 * math.pi).round(6).tolist()


def _by_client(stats: DataFrame, value: str):
    """Per-client values as one scalar map: its size is the number of selected clients."""
    return stats.agg(F.map_from_entries(F.collect_list(F.struct("client_id", value)))).scalar()


def rbf_scores(rows: DataFrame, fit: DataFrame, dimension: int, count: int, seed: int) -> DataFrame:
    """One minus the mean RBF similarity to the client's fit rows (width ``1 / (d * var)``).

    Random cosine features turn the mean similarity into one dot product per row, so no pair of
    rows is ever formed. Similarity is approximate with error about ``1 / sqrt(count)``.
    """
    frequencies, phases = rbf_frequencies(dimension, count, seed)
    spread = fit.select("client_id", F.explode("features").alias("x")).groupBy("client_id").agg(F.var_pop("x").alias("v"))
    gamma = spread.select(
        "client_id", F.when(F.col("v") > 0, 1.0 / (F.lit(float(dimension)) * F.col("v"))).otherwise(F.lit(1.0)).alias("gamma")
    )

    def mapped(d: DataFrame) -> DataFrame:
        joined = d.withColumn("gamma", F.element_at(_by_client(gamma, "gamma"), F.col("client_id")))
        scale = F.sqrt(F.lit(2.0) * F.col("gamma"))
        w = F.array(*[F.array(*[F.lit(v) for v in f]) for f in frequencies])
        b = F.array(*[F.lit(p) for p in phases])
        z = F.zip_with(w, b, lambda f, p: F.cos(arrays.dot(F.col("features"), f) * scale + p) * math.sqrt(2.0 / count))
        return joined.withColumn("_z", z).drop("gamma")

    centre = mapped(fit).groupBy("client_id").agg(
        F.array(*[F.avg(F.get("_z", F.lit(i))) for i in range(count)]).alias("_c")
    )
    scored = mapped(rows).withColumn("_c", F.element_at(_by_client(centre, "_c"), F.col("client_id")))
    return scored.withColumn("score", F.lit(1.0) - arrays.dot(F.col("_z"), F.col("_c"))).drop("_z", "_c")


# -- autoencoders -------------------------------------------------------------------------------

HIDDEN = (32, 8, 32)


def _start(dimension: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed % (1 << 32))
    widths = (dimension, *HIDDEN, dimension)
    layers = []
    for i, (a, b) in enumerate(zip(widths, widths[1:], strict=False)):
        bound = (1.0 if i == 3 else math.sqrt(2.0)) * math.sqrt(6.0 / (a + b))
        layers += [rng.uniform(-bound, bound, (a, b)).astype(np.float32), np.zeros(b, np.float32)]
    return layers


def _forward(x: np.ndarray, layers: list[np.ndarray]) -> list[np.ndarray]:
    outs = [x]
    for i in range(4):
        h = outs[-1] @ layers[2 * i] + layers[2 * i + 1]
        outs.append(np.maximum(h, 0) if i < 3 else h)
    return outs


def _train(x: np.ndarray, layers: list[np.ndarray], passes: int, rate: float, batch: int, *seed: object) -> list[np.ndarray]:
    """Adam on mini-batches; moments start at zero on every call."""
    layers = [a.copy() for a in layers]
    m, v, step = [np.zeros_like(a) for a in layers], [np.zeros_like(a) for a in layers], 0
    for epoch in range(passes):
        order = _rng(*seed, epoch).permutation(len(x))
        for start in range(0, len(x), batch):
            part = x[order[start : start + batch]]
            outs = _forward(part, layers)
            delta = (outs[-1] - part) * np.float32(2.0 / part.size)
            grads: list[np.ndarray] = [None] * 8
            for i in (3, 2, 1, 0):
                grads[2 * i], grads[2 * i + 1] = outs[i].T @ delta, delta.sum(0)
                if i:
                    delta = (delta @ layers[2 * i].T) * (outs[i] > 0)
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                move = (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                layers[k] = (layers[k] - rate * move).astype(np.float32)
    return layers


def _pack(layers: list[np.ndarray]) -> list[float]:
    return np.concatenate([a.ravel() for a in layers]).astype(float).tolist()


def _unpack(flat: np.ndarray, dimension: int) -> list[np.ndarray]:
    widths, layers, at = (dimension, *HIDDEN, dimension), [], 0
    flat = np.asarray(flat, dtype=np.float32)
    for a, b in zip(widths, widths[1:], strict=False):
        layers += [flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]]
        at += a * b + b
    return layers


def train_autoencoders(fit: DataFrame, dimension: int, passes: int, rate: float, batch: int, seed: int) -> DataFrame:
    """One model per client, trained in parallel over clients.

    Mini-batch training is sequential by nature. A group is the client's detector-fit epochs:
    bounded by the length of the time axis (a year of minutes is 52,560 fit rows), not by events.
    """

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("epoch")
        x = np.stack(pdf["features"].to_numpy()).astype(np.float32)
        client = pdf["client_id"].iat[0]
        layers = _train(x, _start(dimension, seed), passes, rate, batch, seed, client)
        return pd.DataFrame({"client_id": [client], "n": [len(x)], "weights": [_pack(layers)]})

    return fit.select("client_id", "epoch", "features").groupBy("client_id").applyInPandas(
        train, "client_id string, n long, weights array<double>"
    )


def _reconstruction(rows: DataFrame, held: dict[str | None, list[float]], dimension: int) -> DataFrame:
    """Mean squared error under the client's model, or under the shared one (key None)."""
    shared = rows.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf(DoubleType())
    def error(client: pd.Series, features: pd.Series) -> pd.Series:
        result = np.full(len(client), np.nan)
        for name, index in client.groupby(client).indices.items():
            weights = shared.value.get(name, shared.value.get(None))
            if weights is not None:
                x = np.stack(features.iloc[index].to_numpy()).astype(np.float32)
                out = _forward(x, _unpack(np.array(weights), dimension))[-1]
                result[index] = np.mean(np.square(x - out), axis=1, dtype=np.float64)
        return pd.Series(result)

    return rows.withColumn("score", error("client_id", "features"))


def reconstruction_scores(rows: DataFrame, models: DataFrame, dimension: int) -> DataFrame:
    """Scores under one model per selected client, a few thousand numbers each."""
    held = {r["client_id"]: r["weights"] for r in models.select("client_id", "weights").collect()}
    return _reconstruction(rows, held, dimension)


def federated_mean(models: DataFrame) -> DataFrame:
    """Sample-weighted mean of each parameter: summed in double, kept in single precision."""
    long = models.select("n", F.posexplode("weights").alias("slot", "w"))
    return long.groupBy("slot").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).cast("float").cast("double").alias("w"))


def federated_autoencoder(
    fit: DataFrame, dimension: int, rounds: int, passes: int, rate: float, batch: int, seed: int
) -> list[float]:
    """Rounds of local training and weighted averaging; the shared model has a fixed size."""
    def local_step(start: list[float], number: int):
        def local(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("epoch")
            x = np.stack(pdf["features"].to_numpy()).astype(np.float32)
            client = pdf["client_id"].iat[0]
            layers = _train(x, _unpack(np.array(start), dimension), passes, rate, batch, seed, client, number)
            return pd.DataFrame({"client_id": [client], "n": [len(x)], "weights": [_pack(layers)]})

        return local

    current = _pack(_start(dimension, seed))
    for number in range(rounds):
        trained = fit.select("client_id", "epoch", "features").groupBy("client_id").applyInPandas(
            local_step(current, number), "client_id string, n long, weights array<double>"
        )
        mean = federated_mean(trained).collect()
        current = [0.0] * len(mean)
        for r in mean:
            current[r["slot"]] = r["w"]
    return current


def federated_scores(rows: DataFrame, weights: list[float], dimension: int) -> DataFrame:
    return _reconstruction(rows, {None: weights}, dimension)


def score_stream_state(scores: DataFrame) -> DataFrame:
    """Rows and missing scores per client: a stream must not be empty and larger means worse."""
    return scores.groupBy("client_id").agg(
        F.count("*").alias("epochs"), F.count_if(F.col("score").isNull() | F.isnan("score")).alias("missing")
    )
