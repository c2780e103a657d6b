"""Toxicity by class-conditional Kneser-Ney models.

One bigram model per class (toxic, ordinary). Word probabilities are continuation counts of the class, of which a
discount of :data:`WORD_DISCOUNT` goes to one shared distribution, the counts of the same words over all
documents, labelled or not. Bigrams are discounted as well and back off, with :data:`WEIGHT` counts besides the
discount, to the pooled bigram model of both classes, tilted by the ratio of the class's word probability to the
pooled one. So a rare expression that the labels say little about gets nearly the same probability from both. A
document is compared by its length-normalised log-likelihoods: mean log ratio per word, and the mean of the
parts of single ratios above :data:`STRONG`, with the length. A logistic curve over these, fitted on labelled
documents that the models have not seen, turns them into a probability.

The models take at most :data:`CLASS_ROWS` documents of :data:`CLASS_CHARS` characters per class, the curve
:data:`CURVE_ROWS` documents; so the broadcast model is bounded. The shared counts are gathered from every
document in two scans without a text shuffle: each task adds up its words and sends packed arrays.

Null and empty texts score by the curve at ratio and length zero. Without labels of both kinds the score is the share
of label 1 in the sample (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import routing as R
from tidewatch.llm import words as W
from tidewatch.llm.common import groups_for, query, remainder, table
from tidewatch.llm.learn import labelled, logistic, sample, scored, sigmoid

CLASS_ROWS, CLASS_CHARS = 3_000, 10_000_000
CURVE_ROWS, CURVE_CHARS = 6_000, 20_000_000
WORD_DISCOUNT, DISCOUNT, WEIGHT, STRONG, THRESHOLD = 3.0, 0.75, 5.0, 1.5, 0.3
_START = np.uint64(0x1234567)


def _pairs(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: its rows, the hash of each word and of the word before it in the row, and first words."""
    data, offsets = W.flat(texts)
    for lo, hi in W.chunks(offsets):
        raw = data[offsets[lo] : offsets[hi]]
        start, end, first = W.bounds(raw, offsets[lo : hi + 1] - offsets[lo], "alnum")
        word = W.hashes(raw, start, end, "alnum")
        before = np.empty_like(word)
        before[1:] = word[:-1]
        begin = first[:-1][np.diff(first) > 0]
        before[begin] = _START
        yield lo, hi, word, before, first


def _bigram(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return W.mix(before * np.uint64(0xC2B2AE3D27D4EB4F) + word)


def _find(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Position of each key in an ordered array, or its length."""
    if not len(ordered):
        return np.zeros(len(keys), np.int64)
    order = np.argsort(keys)
    at = np.empty(len(keys), np.int64)
    at[order] = np.searchsorted(ordered, keys[order])
    at[at == len(ordered)] = 0
    at[ordered[at] != keys] = len(ordered)
    return at


def counted(texts: list[pa.ChunkedArray]) -> dict:
    """Counts of both classes over joint ordered keys; each array has one entry more, for unknown keys."""
    words, befores = [], []
    for t in texts:
        parts = list(_pairs(t))
        words.append(np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.uint64))
        befores.append(np.concatenate([p[3] for p in parts]) if parts else np.zeros(0, np.uint64))
    vocabulary, contexts = np.unique(np.concatenate(words)), np.unique(np.concatenate(befores))
    bigrams = [_bigram(b, w) for b, w in zip(befores, words, strict=True)]
    keys = np.unique(np.concatenate(bigrams))
    model = {"vocabulary": vocabulary, "contexts": contexts, "keys": keys, "bigram": [], "context": [], "followers": [], "continued": []}
    for word, before, bigram in zip(words, befores, bigrams, strict=True):
        _, one = np.unique(bigram, return_index=True)
        model["bigram"].append(np.bincount(_find(bigram, keys), minlength=len(keys) + 1).astype(np.float32))
        model["context"].append(np.bincount(_find(before, contexts), minlength=len(contexts) + 1).astype(np.float32))
        model["followers"].append(np.bincount(_find(before[one], contexts), minlength=len(contexts) + 1).astype(np.float32))
        model["continued"].append(np.bincount(_find(word[one], vocabulary), minlength=len(vocabulary) + 1).astype(np.float32))
    return model


def shared_counts(documents: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word of the model occurs in all documents; the last entry counts all other words."""
    spark, n = documents.sparkSession, len(vocabulary)
    parts = groups_for(documents, 32 << 20)
    known = spark.sparkContext.broadcast(vocabulary)
    spread = np.linspace(0, 2**64 - 2**40, n + 1).astype(np.uint64)  # ordered stand-ins for positions, to deal them out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n + 1, np.int64)
        for batch in batches:
            for _, _, word, _, _ in _pairs(batch["text"]):
                total += np.bincount(_find(word, known.value), minlength=n + 1)
        out, at = R.asks(), np.flatnonzero(total)
        groups = R.part_of(spread[at], parts)
        for a, b in zip(*R.cuts(groups), strict=True):
            out.add(int(groups[a]), R.QUESTION, -1, at[a:b].astype(np.uint64).tobytes(), None, R.pack(total[at[a:b]]))
        yield from out.table().to_batches()

    def add(group: pa.Table) -> pa.Table:
        at = np.concatenate([R.keys_of(x) for x in group["keys"].to_pylist()]).astype(np.int64)
        value = np.concatenate([R.unpack(x) for x in group["values"].to_pylist()])
        keys, where = np.unique(at, return_inverse=True)
        out = R.answers()
        out.add(0, keys.astype(np.uint64).tobytes(), R.pack(np.bincount(where, value).astype(np.int64)))
        return out.table()

    total = np.zeros(n + 1, np.int64)
    rows = documents.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for r in rows.mapInArrow(count, R.ASK).groupBy("part").applyInArrow(add, R.ANSWER).toLocalIterator():
        total[R.keys_of(r["keys"]).astype(np.int64)] += R.unpack(r["values"])
    return total


def finished(model: dict, shared: np.ndarray) -> dict:
    """The model with the probability of each word at the lower orders and the weight of backing off."""
    base = (shared + 1.0) / (shared.sum() + len(shared))
    base[-1] /= 1e3  # one of the many unseen words
    out = {k: model[k] for k in ("vocabulary", "contexts", "keys")}
    # both classes, then the pooled model
    counts = {k: [model[k][0], model[k][1], model[k][0] + model[k][1]] for k in ("bigram", "context", "followers", "continued")}
    out["lower"] = []
    for continued in counts["continued"]:
        total = max(continued.sum(), 1)
        kept = np.maximum(continued - WORD_DISCOUNT, 0)
        out["lower"].append(((kept + (continued - kept).sum() * base) / total).astype(np.float32))
    out["seen"] = [np.maximum(x - DISCOUNT, 0).astype(np.float32) for x in counts["bigram"]]
    out["left"] = [(DISCOUNT * x).astype(np.float32) for x in counts["followers"]]
    out["context"] = counts["context"]
    return out


def measures(texts: pa.Array | pa.ChunkedArray, model: dict) -> np.ndarray:
    """Per text: 1, mean log ratio per word, mean of its strong parts, and these with the length."""
    out = [np.zeros((0, 6))]
    for lo, hi, word, before, first in _pairs(texts):
        w, v, k = _find(word, model["vocabulary"]), _find(before, model["contexts"]), _find(_bigram(before, word), model["keys"])
        seen, context, left, lower = (model[x] for x in ("seen", "context", "left", "lower"))
        pooled = np.where(context[2][v] > 0, (seen[2][k] + left[2][v] * lower[2][w]) / np.maximum(context[2][v], 1), lower[2][w])
        tilt = pooled / lower[2][w]
        p = [(seen[c][k] + (left[c][v] + WEIGHT) * tilt * lower[c][w]) / (context[c][v] + WEIGHT) for c in (0, 1)]
        ratio = np.log(p[1]) - np.log(p[0])
        row, n = W.rows_of(first), np.diff(first)
        size = np.maximum(n, 1)
        mean = np.bincount(row, ratio, hi - lo) / size
        strong = np.bincount(row, np.maximum(ratio - STRONG, 0), hi - lo) / size
        root = np.sqrt(n)
        out.append(np.stack([np.ones(hi - lo), mean, strong, mean * root, strong * root, np.log1p(n)], axis=1))
    return np.concatenate(out)


def fit(documents: DataFrame, known: DataFrame) -> dict:
    """Model and curve from labelled documents; one part of them is kept for the curve."""
    aside = F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(3)) == 0
    classes = [sample(documents, known.filter(~aside & (F.col("y") == c)), CLASS_ROWS, CLASS_CHARS, "class") for c in (0, 1)]
    curve = sample(documents, known.filter(aside), CURVE_ROWS, CURVE_CHARS, "curve")
    y = np.asarray(curve["y"].to_pylist(), float)
    least = min(t.num_rows for t in classes)
    if not least or not 0 < y.sum() < len(y):
        return {"share": float(y.mean()) if len(y) else 0.0}
    model = counted([t["text"].slice(0, least) for t in classes])
    model = finished(model, shared_counts(documents, model["vocabulary"]))
    x = measures(curve["text"], model)
    spread = np.maximum(x.std(0), 1e-9)
    spread[0] = 1
    return model | {"w": logistic(x / spread, y, ridge=1e-3) / spread}


def judge(texts: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray]:
    s = np.full(len(texts), model["share"]) if "share" in model else sigmoid(measures(texts, model) @ model["w"])
    return s, s >= THRESHOLD


def judged(documents: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """The chosen columns with held_out, score and predicted; rows whose remainder is 2 are never learned from."""
    known = labelled(labels, "toxic").filter(remainder("doc_id", 4) != 2)
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, known))
    return scored(documents, columns, lambda texts: judge(texts, model.value), remainder("doc_id", 4) == 2)


@query("op1_kneser_ney_toxicity")
def op1_kneser_ney_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document of the table."""
    return judged(table(spark, folder, "documents"), table(spark, folder, "labels"), ["doc_id"])
