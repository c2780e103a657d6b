"""Bounded samples of labelled documents and logistic fits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """One label (0 or 1) per doc_id: the mean of its rows, from one half on 1; null labels and ids are no rows."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    return rows.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))


def sample(documents: DataFrame, chosen: DataFrame, limit: int, chars: int, salt: str) -> pa.Table:
    """Text and label of at most ``limit`` labelled documents in hash order, of at most ``chars`` characters in all.

    Longer documents than what is left of ``chars`` are passed over. Only ids and lengths are looked at
    before the choice; both bounds are parameters of the classifiers.
    """
    spark = documents.sparkSession
    ids = chosen.orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id").limit(limit)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # both broadcasts hold at most ``limit`` rows of two numbers
    sizes = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.length("text")).alias("n"), F.first("y").alias("y")).orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id").collect()
    left, kept = chars, []
    for r in sizes:
        if r["n"] <= left:
            left -= r["n"]
            kept.append((r["doc_id"], r["y"], r["n"]))
    if not kept:
        return pa.table({"text": pa.array([], pa.string()), "y": pa.array([], pa.int32())})
    few = spark.createDataFrame(kept, "doc_id long, y int, n int")
    rows = texts.join(F.broadcast(few), "doc_id").filter(F.length("text") == F.col("n")).dropDuplicates(["doc_id"])
    return rows.orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id").select("text", "y").toArrow()


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 40, weights: np.ndarray | None = None) -> np.ndarray:
    """Coefficients of a ridge-penalised logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    weights = np.ones(len(y)) if weights is None else weights
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (weights * (p - y)) / len(y) + ridge * w
        curve = (x.T * (weights * p * (1 - p))) @ x / len(y) + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def scored(documents: DataFrame, columns: list[str], score, held_out, extra: str = "score double, predicted int") -> DataFrame:
    """The chosen columns, ``held_out`` and score and prediction of each document."""
    names = [f"c{i}" for i in range(len(columns))]
    rows = documents.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out.alias("held_out"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in names)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, p = score(batch["text"])
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), batch["held_out"], pa.array(s, pa.float64()), pa.array(p.astype(np.int32))], [*names, "held_out", "score", "predicted"])

    out = rows.mapInArrow(step, f"{kinds}{', ' if kinds else ''}held_out boolean, {extra}")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, columns, strict=True)), "held_out", "score", "predicted")
