"""Outside-context histograms, context cells and their support."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import arrays, prefix, text
from tidewatch.session import spread, written

VARIANTS = ("exact", "inclusive", "leave_one_out", "partial", "local_history", "none")


def histogram_bin(u: Column, bins: int) -> Column:
    return F.when(u.isNotNull(), F.least(F.floor(u * bins), F.lit(bins - 1))).cast("int")  # least skips nulls


def _kept(variant: str, i: Column, idx: Column) -> Column:
    """Whether client index ``i`` feeds the context of coalition ``idx``."""
    inside = F.array_contains(idx, i)
    if variant == "exact":
        return ~inside
    if variant == "inclusive":
        return F.lit(True)
    if variant == "leave_one_out":
        return i != F.element_at(idx, 1)
    if variant == "partial":  # triples drop two members, smaller coalitions the first
        return ~F.array_contains(F.slice(idx, 1, F.greatest(F.size(idx) - 1, F.lit(1))), i)
    if variant == "local_history":
        return inside
    raise ValueError(f"unknown context variant {variant}")


def outside_histogram(variant: str, idx: Column, lagged: Column, avail: Column, bins: int) -> Column:
    """Mass of lagged ranks per bin over the available context clients, divided by their number.

    A client that is available now but has no lagged rank lowers the mass. Exact exclusion, the
    primary method, counts the whole federation once and takes its at most three members away.
    """
    slots = F.sequence(F.lit(0), F.size(avail) - 1)
    if variant == "none":
        return F.array(F.lit(1.0))
    use = F.transform(slots, lambda i: F.get(avail, i) & _kept(variant, i, idx))
    return arrays.let(
        F.struct(
            F.zip_with(use, lagged, lambda a, u: F.when(a, histogram_bin(u, bins))).alias("b"),
            F.size(F.filter(use, lambda a: a)).alias("n"),
        ),
        lambda s: F.transform(
            F.sequence(F.lit(0), F.lit(bins - 1)),
            lambda k: F.size(F.filter(s["b"], lambda x: x == k)) / F.greatest(s["n"], F.lit(1)),
        ),
    )


def federation_bins(panel: DataFrame, bins: int) -> DataFrame:
    """Per epoch: lagged bin of each available client, bin counts and available count, once."""
    eff = F.zip_with("avail", "lagged", lambda a, u: F.when(a, histogram_bin(u, bins)))
    return panel.withColumn("_bins", eff).withColumn(
        "_counts", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.size(F.filter("_bins", lambda x: x == k)))
    ).withColumn("_n", F.size(F.filter("avail", lambda a: a)))


def exact_histogram(idx: Column, bins: Column, counts: Column, avail: Column, n: Column) -> Column:
    """Federation counts minus the members' own bins: work per coalition is its order, not its size."""
    return arrays.let(
        F.struct(
            F.transform(idx, lambda i: F.get(bins, i)).alias("own"),
            (n - F.size(F.filter(idx, lambda i: F.get(avail, i)))).alias("left"),
        ),
        lambda s: F.transform(
            counts, lambda c, k: (c - F.size(F.filter(s["own"], lambda x: x == k))) / F.greatest(s["left"], F.lit(1))
        ),
    )


def shuffled_epochs(epochs: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Permutation of epochs inside each split: the i-th epoch takes the i-th epoch in hash order.

    ``epochs`` has distinct ``keys, epoch``.
    """
    hashed = epochs.withColumn(
        "_h", text.hash64(F.concat_ws(":", F.lit(seed), *keys, F.col("epoch").cast("string")))
    ).withColumn("_one", F.lit(1).cast("long"))
    top = F.floor(F.col("_h") / F.lit(2**52).cast("decimal(20,0)")).cast("long")
    by_hash = prefix.running_sums(hashed, keys, ["_h", "epoch"], top, {"pos": "_one"}).select(
        *keys, "pos", F.col("epoch").alias("source_epoch")
    )
    by_time = prefix.running_sums(hashed, keys, ["epoch"], prefix.time_chunk("epoch"), {"pos": "_one"})
    return by_time.join(by_hash, [*keys, "pos"]).select(*keys, "epoch", "source_epoch")


def training_hash(dataset: Column, order: Column, members: Column, epoch: Column, seed: int) -> Column:
    """First eight SHA-256 bytes of the row identity written as canonical JSON (keys sorted)."""
    quoted = F.array_join(F.transform(members, lambda m: F.concat(F.lit('"'), m, F.lit('"'))), ",")
    body = F.concat(
        F.lit('{"coalition_client_ids":['), quoted, F.lit('],"coalition_order":'), order.cast("string"),
        F.lit(f',"context_seed":{seed},"dataset":"'), dataset, F.lit('","epoch_index":'), epoch.cast("string"), F.lit("}"),
    )
    return F.substring(F.sha2(body, 256), 1, 16)


def hashed_rows(rows: DataFrame, seed: int, by: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Training rows with their position ``pos`` in hash order.

    ``rows`` has ``dataset, ord, members, epoch``; ``by`` names the keys of one clustering. The hash is uniform, so its first digits cut
    the rows into equal chunks and no order is ever sorted in one task.
    """
    hashed = rows.withColumn(
        "row_hash", training_hash(F.col("dataset"), F.col("ord"), F.col("members"), F.col("epoch"), seed)
    ).withColumn("_one", F.lit(1).cast("long"))
    chunk = F.conv(F.substring("row_hash", 1, 3), 16, 10).cast("long")
    ran = prefix.running_sums(hashed, list(by), ["row_hash", "members", "epoch"], chunk, {"pos": "_one"})
    return ran.withColumn("pos", F.col("pos") - 1).drop("_one")


def capped_rows(rows: DataFrame, seed: int, cap: int, by: tuple[str, ...] = ("ord",)) -> DataFrame:
    """The ``cap`` rows of each order with the smallest hashes. An operator of its own; centroids are fitted to all rows."""
    return hashed_rows(rows, seed, by).filter(F.col("pos") < cap)


def assign_cells(rows: DataFrame, centroids: DataFrame, tolerance: float, by: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Nearest centroid of the row's order. ``centroids`` (ord, cells) has one row per order.

    Pass a written table: Spark then knows its size and never shuffles rows by so few keys.
    """
    return (
        rows.join(centroids, list(by))
        .withColumn("cell", arrays.nearest(F.col("hist"), F.col("cells"), tolerance))
        .drop("cells")
    )


def seed_centroids(capped: DataFrame, cells: int, by: tuple[str, ...] = ("ord",)) -> DataFrame:
    """First distinct histograms in hash order, as (ord, cells): a start without random numbers.

    Spark limits each group to ``cells`` rows before the shuffle (window group limit).
    """
    first = capped.groupBy(*by, "hist").agg(F.min("pos").alias("pos"))
    ranked = first.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("pos")))
    top = ranked.filter(F.col("_i") <= cells).groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("pos", "hist"))).alias("s")
    )
    return top.select(*by, F.col("s.hist").alias("cells"))


def lloyd_step(weighted: DataFrame, centroids: DataFrame, tolerance: float, by: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Mean update of (ord, hist, w) rows; an empty cell keeps its centroid. Returns (ord, cells)."""
    assigned = assign_cells(weighted, centroids, tolerance, by)
    long = assigned.select(*by, "cell", "w", F.posexplode("hist").alias("bin", "mass"))
    means = (
        long.groupBy(*by, "cell", "bin")
        .agg((F.sum(F.col("mass") * F.col("w")) / F.sum("w")).alias("mean"))
        .groupBy(*by, "cell")
        .agg(F.array_sort(F.collect_list(F.struct("bin", "mean"))).alias("b"))
        .select(*by, "cell", F.col("b.mean").alias("mean"))
    )
    packed = means.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("cell", "mean"))).alias("m"))
    return (
        centroids.join(packed, list(by), "left")
        .select(*by, F.transform("cells", lambda c, i: F.coalesce(F.element_at("m", i), c)).alias("cells"))
    )


def weigh(capped: DataFrame, by: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Equal histograms act alike, so they are counted once with a weight."""
    return capped.groupBy(*by, "hist").agg(F.count("*").alias("w"))


def draw_number(seed: int, n: int, *names: int) -> int:
    """A number below n from the SHA-256 of the seed and the names, the same on every engine."""
    text = ":".join(str(x) for x in (seed, *names))
    return int(hashlib.sha256(text.encode()).hexdigest()[:15], 16) % n


def _starts(seed: int, n: int, restart: int, cells: int) -> list[int]:
    """Numbers of ``cells`` different rows of n: each draw is among the rows that are left, in order."""
    taken: list[int] = []
    for j in range(cells):
        x = draw_number(seed, n - j, restart, j)
        for t in sorted(taken):
            x += x >= t
        taken.append(x)
    return taken


def numbered_histograms(rows: DataFrame, by: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Distinct histograms with their weight ``w`` and row numbers ``lo`` up to ``hi`` (exclusive) of ``n``.

    Rows are numbered in the order of their histograms, so equal ones have neighbouring numbers.
    """
    chunk = F.floor(F.coalesce(F.get("hist", F.lit(0)), F.lit(0.0)) * 1024).cast("long")
    ran = prefix.running_sums(weigh(rows, by), list(by), ["hist"], chunk, {"hi": "w"}, whole=True)
    return ran.select(*by, "hist", "w", (F.col("hi") - F.col("w")).alias("lo"), "hi", F.col("hi_all").alias("n"))


def _nearest_sums(by: list[str], centroids: dict[tuple, tuple[list[int], np.ndarray]], tie: float):
    """Per task: weight, weighted sum and weighted squares of the histograms nearest to each cell of each restart.

    ``centroids`` maps a key to its restarts and their (restart, cell, bin) numbers; other keys are left out.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {key: (np.zeros(c.shape[:2], np.int64), np.zeros(c.shape), np.zeros(c.shape[:2])) for key, (_, c) in centroids.items()}
        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch[k].type for k in by]
            for key, (_, c) in centroids.items():
                mine = functools.reduce(pc.and_, [pc.equal(batch[k], v) for k, v in zip(by, key, strict=True)])
                part = batch.filter(mine)
                if not part.num_rows:
                    continue
                h = part["hist"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                w = part["w"].to_numpy(zero_copy_only=False)
                square = sum((h[:, i] * h[:, i] for i in range(h.shape[1])), np.zeros(len(h))) * w
                for r in range(len(c)):
                    apart = np.sqrt(sum((np.square(h[:, i, None] - c[r, None, :, i]) for i in range(h.shape[1])), np.zeros((len(h), c.shape[1]))))
                    cell = np.argmax(apart - apart.min(1)[:, None] <= tie, axis=1)
                    sums[key][0][r] += np.bincount(cell, w, c.shape[1]).astype(np.int64)
                    for i in range(h.shape[1]):
                        sums[key][1][r, :, i] += np.bincount(cell, h[:, i] * w, c.shape[1])
                    sums[key][2][r] += np.bincount(cell, square, c.shape[1])
        rows = [(*key, centroids[key][0][r], i, w[r, i], s[r, i].tolist(), q[r, i]) for key, (w, s, q) in sums.items() for r, i in np.argwhere(w > 0)]
        if rows:
            kinds += [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64()]
            names = [*by, "restart", "cell", "w", "s", "sq"]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return step


def fit_centroids(
    rows: DataFrame, cells: int, restarts: int, iterations: int, tolerance: float, tie: float, seed: int, by: tuple[str, ...] = ("ord",)
) -> DataFrame:
    """K-means with restarts over all training rows, as (by, cells); keys with fewer rows than cells have none.

    Rows shrink to distinct histograms with weights once. One Spark job per Lloyd iteration serves every key and every restart that still
    moves; the driver holds centroids only: keys x restarts x cells x bins numbers. A cell without rows starts again
    from a drawn row. A restart ends when no centroid moves by more than ``tolerance``. Within a billionth of the least
    inertia the first restart wins, so restarts that meet at the same cells are not told apart by rounding.
    """
    # few bytes, but each row meets all cells of all restarts in every iteration
    table = written(spread(numbered_histograms(rows, by), *by, "hist"), "context-histograms")
    spark, kinds = table.sparkSession, dict(table.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in by)
    sizes = {tuple(r[k] for k in by): r["n"] for r in table.groupBy(*by).agg(F.max("n").alias("n")).collect()}

    def rows_at(asked: dict[tuple, int]) -> dict[tuple, np.ndarray]:
        """Histogram of each asked row; ``asked`` maps (key, name) to a row number. There are few."""
        if not asked:
            return {}
        names = list(asked)
        few = spark.createDataFrame([(*names[i][0], i, asked[names[i]]) for i in range(len(names))], f"{head}, i int, x long")
        hit = (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))
        return {names[r["i"]]: np.array(r["hist"]) for r in table.join(F.broadcast(few), list(by)).filter(hit).select("i", "hist").collect()}

    starts = {(key, (r, j)): x for key, n in sizes.items() if n >= cells for r in range(restarts) for j, x in enumerate(_starts(seed, n, r, cells))}
    first = rows_at(starts)
    state = {(key, r): np.stack([first[key, (r, j)] for j in range(cells)]) for key, n in sizes.items() if n >= cells for r in range(restarts)}
    running, inertia = set(state), {}
    bins = len(next(iter(state.values()))[0]) if state else 0
    for step in range(iterations):
        if not running:
            break
        now = {key: sorted(r for k, r in running if k == key) for key in {k for k, _ in running}}
        near = _nearest_sums(list(by), {key: (rs, np.stack([state[key, r] for r in rs])) for key, rs in now.items()}, tie)
        got = (
            table.select(*by, "hist", "w")
            .mapInArrow(near, f"{head}, restart int, cell int, w long, s array<double>, sq double")
            .groupBy(*by, "restart", "cell")
            .agg(F.sum("w").alias("w"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(bins)]).alias("s"), F.sum("sq").alias("sq"))
            .collect()
        )
        groups: dict[tuple, dict[int, tuple]] = {}
        for g in got:
            mean = np.array(g["s"]) / g["w"]
            groups.setdefault((tuple(g[k] for k in by), g["restart"]), {})[g["cell"]] = (mean, g["sq"] - g["w"] * float(mean @ mean))
        lost = {(key, (r, c)): draw_number(seed, sizes[key], r, c, step) for key, r in running for c in range(cells) if c not in groups[key, r]}
        fresh = rows_at(lost)
        for key, r in sorted(running):
            found = groups[key, r]
            new = np.stack([found[c][0] if c in found else fresh[key, (r, c)] for c in range(cells)])
            shift = float(np.max(np.linalg.norm(new - state[key, r], axis=1)))
            inertia[key, r] = sum(v[1] for v in found.values())
            state[key, r] = new
            if shift <= tolerance:
                running.discard((key, r))
    best = []
    for key, n in sorted(sizes.items()):
        if n >= cells:
            least = min(inertia[key, r] for r in range(restarts))
            chosen = min(r for r in range(restarts) if inertia[key, r] <= least + 1e-9 * (1 + least))
            best.append((*key, state[key, chosen].tolist()))
    return spark.createDataFrame(best, f"{head}, cells array<array<double>>")


def required_support(order: Column, minima: tuple[int, int, int]) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in minima]), order)


def cell_support(nuisance: DataFrame, minima: tuple[int, int, int]) -> DataFrame:
    """Nuisance epochs per coalition and cell, and whether they reach the order's minimum."""
    return (
        nuisance.groupBy("coalition_id", "ord", "cell")
        .agg(F.count("*").alias("support"))
        .withColumn("supported", F.col("support") >= required_support(F.col("ord"), minima))
    )


def coverage(rows: DataFrame, support: DataFrame) -> DataFrame:
    """Supported over eligible coalition-epochs and the abstention rate, per order."""
    known = rows.join(support.select("coalition_id", "cell", "supported"), ["coalition_id", "cell"], "left")
    return known.groupBy("ord").agg(
        F.count("*").alias("eligible"),
        F.count_if(F.coalesce("supported", F.lit(False))).alias("covered"),
    ).withColumn("coverage", F.col("covered") / F.col("eligible")).withColumn("abstention", 1 - F.col("coverage"))
