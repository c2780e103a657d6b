"""Cross-fitted ridge projection of tensors onto lower-order designs.

A (coalition, cell) fit needs all its nuisance epochs, which grow with the data. They are never
gathered: each chunk of epochs is reduced to the triangular factor of its [design | tensor]
matrix. That factor is at most (p + q) x (p + q) whatever the chunk holds, it has the same Gram
matrix, singular values and least-squares solutions as the rows, and factors stack. Folds,
penalties and the complete refit are all solved from the stacked factors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import arrays, prefix
from tidewatch.functions.basis import design, design_and_tensor, design_size, tensor
from tidewatch.functions.quantiles import exact_quantiles
from tidewatch.session import spread

PARTIAL_SCHEMA = (
    "coalition_id string, ord int, cell int, fold int, n long, factor array<double>, "
    "lo array<double>, hi array<double>"
)
FIT_SCHEMA = (
    "coalition_id string, ord int, cell int, fold int, n long, ridge double, "
    "coef array<array<double>>, condition double, cv array<double>, singular boolean"
)
COMPLETE = -1  # fold number of the refit on all nuisance epochs


def fold_of(pos: Column, n: Column, folds: int) -> Column:
    """Contiguous fold of a 0-based position; the first ``n mod k`` folds hold one epoch more."""
    q, r = F.floor(n / folds), n % folds
    border = r * (q + 1)
    inside = F.when(pos < border, F.floor(pos / (q + 1))).otherwise(r + F.floor((pos - border) / F.greatest(q, F.lit(1))))
    return F.when(n >= folds, inside).cast("int")


def with_folds(rows: DataFrame, folds: int) -> DataFrame:
    """Chronological folds per (coalition, cell). Groups smaller than ``folds`` get none."""
    placed = prefix.row_positions(rows, ["coalition_id", "cell"], "epoch")
    return placed.withColumn("fold", fold_of(F.col("pos"), F.col("n"), folds)).filter(F.col("fold").isNotNull())


def _partial(size: int):
    def reduce_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (cell, fold), part in pdf.groupby(["cell", "fold"], sort=True):
            ranks = np.stack(part["r"].to_numpy())
            x, y = design_and_tensor(ranks, size)
            factor = np.linalg.qr(np.concatenate([x, y], axis=1), mode="r")
            out.append(
                (part["coalition_id"].iat[0], part["ord"].iat[0], cell, fold, len(part), factor.ravel(), x.min(0), x.max(0))
            )
        return pd.DataFrame(out, columns=["coalition_id", "ord", "cell", "fold", "n", "factor", "lo", "hi"])

    return reduce_chunk


def solve(x: np.ndarray, y: np.ndarray, ridge: float, cutoff: float) -> np.ndarray:
    """Least-squares coefficients (p x q) with ``ridge`` on all but the intercept, as rows below the data.

    Without a penalty, directions whose singular value is at most ``cutoff`` times the largest get no weight.
    """
    if ridge <= 0.0:
        return np.linalg.lstsq(x, y, rcond=cutoff)[0]
    below = math.sqrt(ridge) * np.eye(x.shape[1])[1:]
    return np.linalg.lstsq(np.vstack([x, below]), np.vstack([y, np.zeros((len(below), y.shape[1]))]), rcond=None)[0]


def choose_ridge(candidates: tuple[float, ...], errors: list[float], tolerance: float) -> float:
    """Largest penalty whose error is within the tolerance of the least error."""
    error = np.asarray(errors, dtype=float)
    return float(np.asarray(candidates)[error <= error.min() + tolerance].max())


def _fit(size: int, candidates: tuple[float, ...], folds: int, tie: float, cutoff: float):
    def fit_coalition(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for cell, part in pdf.groupby("cell", sort=True):
            order = int(part["ord"].iat[0])
            p = design_size(order, size)
            width = p + size**order
            pieces, counts = {}, {}
            for fold, rows in part.groupby("fold", sort=True):
                pieces[fold] = np.concatenate([np.reshape(f, (-1, width)) for f in rows["factor"]])
                counts[fold] = int(rows["n"].sum())
            if len(pieces) < folds:
                continue
            total = sum(counts.values())
            train = {f: np.concatenate([pieces[g] for g in pieces if g != f]) for f in pieces}
            whole = np.concatenate(list(pieces.values()))
            errors, singular = [], False
            for ridge in candidates:
                mse = 0.0
                for f in pieces:
                    try:
                        m = solve(train[f][:, :p], train[f][:, p:], ridge, cutoff)
                        mse += float(np.sum((pieces[f][:, p:] - pieces[f][:, :p] @ m) ** 2))
                    except np.linalg.LinAlgError:
                        singular, mse = True, float("inf")
                errors.append(mse / total)
            ridge = choose_ridge(candidates, errors, tie)
            lo = np.min(np.stack(part["lo"].to_numpy()), axis=0)
            hi = np.max(np.stack(part["hi"].to_numpy()), axis=0)
            moving = whole[:, :p][:, hi > lo]
            condition = None
            if moving.shape[1]:
                values = np.linalg.svd(moving, compute_uv=False)
                condition = float((values.max() / values.min()) ** 2) if values.min() > 0 and len(moving) >= moving.shape[1] else float("inf")
            for fold in [*pieces, COMPLETE]:
                data = whole if fold == COMPLETE else train[fold]
                try:
                    coef = solve(data[:, :p], data[:, p:], ridge, cutoff).T.tolist()
                except np.linalg.LinAlgError:
                    coef, singular = None, True
                out.append(
                    (part["coalition_id"].iat[0], order, cell, fold, total, ridge, coef, condition, errors, singular)
                )
        columns = ["coalition_id", "ord", "cell", "fold", "n", "ridge", "coef", "condition", "cv", "singular"]
        return pd.DataFrame(out, columns=columns)

    return fit_coalition


def fit_projections(
    folded: DataFrame, size: int, candidates: tuple[float, ...], folds: int, tie: float, cutoff: float
) -> DataFrame:
    """Chosen penalty and coefficients per (coalition, cell, fold) and for the complete refit.

    ``folded`` has ``coalition_id, ord, cell, fold, pos, r``. Only ranks move in the shuffle;
    designs are built in the tasks.
    """
    chunks = folded.select("coalition_id", "ord", "cell", "fold", "r", prefix.time_chunk("pos").alias("chunk"))
    partial = (
        spread(chunks, "coalition_id", "chunk")
        .groupBy("coalition_id", "chunk")
        .applyInPandas(_partial(size), PARTIAL_SCHEMA)
    )
    return spread(partial, "coalition_id").groupBy("coalition_id").applyInPandas(_fit(size, candidates, folds, tie, cutoff), FIT_SCHEMA)


def residual(r: Column, coef: Column, size: int) -> Column:
    """``tensor - M' design`` with ``coef`` as one coefficient row per tensor coordinate."""
    return arrays.let(
        F.struct(design(r, size).alias("d"), tensor(r, size).alias("t")),
        lambda s: F.zip_with(s["t"], F.transform(coef, lambda m: arrays.dot(m, s["d"])), lambda a, b: a - b),
    )


def held_innovations(folded: DataFrame, fits: DataFrame, size: int) -> DataFrame:
    """Innovation ``z`` of every nuisance epoch under the fit that left its fold out."""
    part = fits.filter((F.col("fold") != COMPLETE) & F.col("coef").isNotNull()).select("coalition_id", "cell", "fold", "coef")
    return folded.join(part, ["coalition_id", "cell", "fold"]).select(
        "coalition_id", "ord", "cell", "fold", "epoch", residual(F.col("r"), F.col("coef"), size).alias("z")
    )


def innovation_moments(innovations: DataFrame, size: int, max_order: int) -> DataFrame:
    """Mean and sample deviation of each coordinate; fewer than two rows are unsupported."""
    width = size**max_order
    keep = F.pow(F.lit(size), F.col("ord")).cast("int")
    moments = innovations.groupBy("coalition_id", "ord", "cell").agg(
        F.count("*").alias("rows"),
        F.array(*[F.avg(F.get("z", F.lit(i))) for i in range(width)]).alias("mu"),
        F.array(*[F.stddev_samp(F.get("z", F.lit(i))) for i in range(width)]).alias("sd"),
    )
    return moments.filter(F.col("rows") >= 2).withColumn("mu", F.slice("mu", 1, keep)).withColumn("sd", F.slice("sd", 1, keep))


def standardize(z: Column, mu: Column, sd: Column, floor: float) -> Column:
    centred = F.zip_with(z, mu, lambda a, b: a - b)
    return F.zip_with(centred, sd, lambda a, b: a / F.greatest(b, F.lit(floor)))


def norm_reference(innovations: DataFrame, moments: DataFrame, quantile: float, floor: float) -> DataFrame:
    """Quantile of the standardized innovation norm per (coalition, cell)."""
    joined = innovations.join(moments.select("coalition_id", "cell", "mu", "sd"), ["coalition_id", "cell"])
    norms = joined.select(
        "coalition_id", "cell", arrays.norm(standardize(F.col("z"), F.col("mu"), F.col("sd"), floor)).alias("norm")
    )
    found = exact_quantiles(norms, ["coalition_id", "cell"], "norm", (quantile,))
    return found.select("coalition_id", "cell", F.col("q")[0].alias("q_norm"))


def calibration(fits: DataFrame, moments: DataFrame, norms: DataFrame) -> DataFrame:
    """The complete refit with its centering, scaling and norm reference."""
    final = fits.filter((F.col("fold") == COMPLETE) & F.col("coef").isNotNull()).drop("fold")
    return final.join(moments.drop("ord", "rows"), ["coalition_id", "cell"]).join(norms, ["coalition_id", "cell"])


def numerical_failures(fits: DataFrame, limit: float) -> DataFrame:
    """Share of attempted fits that are singular or too badly conditioned."""
    final = fits.filter(F.col("fold") == COMPLETE)
    failed = F.col("singular") | F.coalesce(F.col("condition") > limit, F.lit(False))
    return final.agg(F.count("*").alias("fits"), F.count_if(failed).alias("failed")).withColumn(
        "failure_rate", F.col("failed") / F.col("fits")
    )


def score_rows(rows: DataFrame, calibrated: DataFrame, size: int, floor: float, purify: bool = True) -> DataFrame:
    """Standardized atoms of coalition epochs. Without purification the raw tensor takes the residual's place."""
    joined = rows.join(
        calibrated.select("coalition_id", "cell", "coef", "mu", "sd", "q_norm"), ["coalition_id", "cell"]
    )
    z = residual(F.col("r"), F.col("coef"), size) if purify else tensor(F.col("r"), size)
    return joined.withColumn("atom", standardize(z, F.col("mu"), F.col("sd"), floor)).drop("coef", "mu", "sd")
