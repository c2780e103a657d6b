"""Quality classifier by Bradley-Terry pairwise ranking.

A document is a vector of how its bytes, words and lines are made up, each measure cut into the bins of its
quantiles. Scores are linear in it and learned from preference pairs (a document labelled 1 over one labelled 0)
by logistic loss on the difference of the two vectors. The threshold is a quantile of the scores of the labelled
sample, the one at which accepting what lies above agrees best with the labels; the reported score is the
logistic curve of the ranking score around that threshold, so 0.5 is the threshold.

The fit takes at most :data:`SAMPLE_ROWS` labelled documents of :data:`SAMPLE_CHARS` characters. Scoring is one
pass over whole texts without a shuffle. Null and empty texts have a vector of their own and a score; without
labels of both kinds every document scores 0.5 and is accepted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import words as W
from tidewatch.llm.common import query, remainder, table
from tidewatch.llm.learn import labelled, logistic, sample, scored, sigmoid

SAMPLE_ROWS, SAMPLE_CHARS = 12_000, 48_000_000
#: partners of each document labelled 0, and bins of a measure
PAIRS, BINS = 12, 10


def measures(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """One row of measures per text."""
    data, offsets = W.flat(texts)
    parts = []
    for lo, hi in W.chunks(offsets):
        raw, cut, n = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], hi - lo
        row = np.repeat(np.arange(n), np.diff(cut))
        count = np.bincount(row * 256 + raw, minlength=n * 256).reshape(n, 256).astype(float)
        size = np.maximum(count.sum(1), 1)
        start, end, first = W.bounds(raw, cut, "space")
        h, words = W.hashes(raw, start, end, "space"), np.diff(first).astype(float)
        of = W.rows_of(first)
        begin, stop, line_first = W.bounds(raw, cut, "line")
        lines, line_of = np.diff(line_first).astype(float), W.rows_of(line_first)
        per = np.maximum(words, 1)
        length = (end - start).astype(float)
        last = raw[end - 1] if len(end) else raw[:0]
        total = lambda x, r: np.bincount(r, x, n)
        squares = total(length**2, of) / per - (total(length, of) / per) ** 2
        symbols = count[:, [*b"#$%&*+<=>@[]^_{}~\\/"]].sum(1)
        parts.append(
            np.stack(
                [
                    np.log1p(words), total(length, of) / per, np.sqrt(np.maximum(squares, 0)), symbols / size, count[:, ord("|")] / per, count[:, 0x30:0x3A].sum(1) / size,
                    count[:, 0x41:0x5B].sum(1) / size, count[:, [*b".,;:!?"]].sum(1) / per, count[:, [*b"!?"]].sum(1) / per, _distinct(h, of, n) / per,
                    _distinct(W.hashes(raw, begin, stop, "line"), line_of, n) / np.maximum(lines, 1), words / np.maximum(lines, 1), count[:, 0x80:].sum(1) / size,
                    total((length == 1).astype(float), of) / per, total(np.isin(last, [*b".!?"]).astype(float), of) / per, -(count / size[:, None] * np.log(np.maximum(count, 1) / size[:, None])).sum(1),
                ],
                axis=1,
            )
        )
    return np.concatenate(parts) if parts else np.zeros((0, 16))


def _distinct(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=n).astype(float)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Indicator columns of the bins of each measure."""
    out = []
    for j, e in enumerate(edges):
        out.append(np.eye(len(e) + 1, dtype=np.float32)[np.searchsorted(e, x[:, j], "right")])
    return np.concatenate(out, axis=1)


def pair_weights(f: np.ndarray, over: np.ndarray, under: np.ndarray, ridge: float, steps: int = 40, block: int = 256) -> np.ndarray:
    """Weights of the logistic loss on differences of features, by Newton's method; row i of ``over`` is preferred to ``under[i]``.

    A pair (a over b) is also the pair (b under a): with both, the fit needs no intercept. Gradient and curvature are summed
    over blocks of rows, so the differences of all pairs are never held at once.
    """
    w, pairs = np.zeros(f.shape[1]), over.size
    for _ in range(steps):
        gradient, curve = ridge * w, ridge * np.eye(len(w))
        for lo in range(0, len(under), block):
            d = (f[over[lo : lo + block]] - f[under[lo : lo + block]][:, None, :]).reshape(-1, len(w)).astype(float)
            p = sigmoid(d @ w)
            gradient += d.T @ (p - 1) / pairs
            curve += (d.T * (p * (1 - p))) @ d / pairs
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: pa.Table) -> dict | None:
    """Bin edges, weights, and the threshold and slope of the reported score; None without both labels."""
    y = np.asarray(rows["y"].to_pylist(), float)
    if not 0 < y.sum() < len(y):
        return None
    x = measures(rows["text"])
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(x.shape[1])]
    f = binned(x, edges)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    draw = np.random.default_rng(5).integers(0, len(good), (len(bad), PAIRS))
    w = pair_weights(f, good[draw], bad, ridge=2e-3)
    s = f @ w
    order = np.argsort(s, kind="stable")
    right = np.concatenate([[0], np.cumsum(y[order] == 0)]) + np.concatenate([np.cumsum(y[order][::-1] == 1)[::-1], [0]])
    k = int(right.argmax())
    below, above = s[order[k - 1]] if k else s[order[0]] - 1, s[order[k]] if k < len(s) else s[order[-1]] + 1
    threshold = (below + above) / 2
    slope = logistic((s - threshold)[:, None], y, ridge=1e-4)[0]
    return {"edges": edges, "w": w, "threshold": threshold, "slope": max(float(slope), 1e-6), "quantile": k / len(s)}


def judge(texts: pa.Array, model: dict | None) -> tuple[np.ndarray, np.ndarray]:
    """Score, and 1 from 0.5 on."""
    if model is None:
        return np.full(len(texts), 0.5), np.ones(len(texts))
    s = sigmoid(model["slope"] * (binned(measures(texts), model["edges"]) @ model["w"] - model["threshold"]))
    return s, s >= 0.5


def judged(documents: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """The chosen columns with held_out, score and predicted; rows whose remainder is 1 are never learned from."""
    known = labelled(labels, "quality").filter(remainder("doc_id", 3) != 1)
    model = documents.sparkSession.sparkContext.broadcast(fit(sample(documents, known, SAMPLE_ROWS, SAMPLE_CHARS, "quality")))
    return scored(documents, columns, lambda texts: judge(texts, model.value), remainder("doc_id", 3) == 1)


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all their columns, that the classifier accepts."""
    names = [f"c{i}" for i in range(len(documents.columns))]
    rows = judged(documents.select("doc_id", "text", *(F.col(c).alias(n) for c, n in zip(documents.columns, names, strict=True))), labels, names)
    return rows.filter("predicted = 1").select(*(F.col(n).alias(c) for n, c in zip(names, documents.columns, strict=True)))


@query("op5_bradley_terry_quality")
def op5_bradley_terry_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document of the table."""
    return judged(table(spark, folder, "documents"), table(spark, folder, "labels"), ["doc_id"])
