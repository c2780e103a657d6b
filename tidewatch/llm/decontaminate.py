"""Benchmark decontamination by winnowing.

Of every ten consecutive words the smallest hash of five words is kept, on both sides by the same rule: a
shared run of ten words keeps the same five, so comparing these fingerprints finds every such run. A hit is
extended to the windows that kept it, whose ten words are compared by two independent 64-bit hashes. Items
of fewer words are one window and are looked up by their own length.

The benchmark is taken in blocks of a bounded size, each broadcast on its own; documents stream past the
blocks without a shuffle, so a hot document source or passage costs its own length only.

Null and empty texts have no words and are never hit. Items without words have no window. A null item id
counts as the empty text. Repeated rows are judged each on its own; repeated item ids count once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import words as W
from tidewatch.llm.common import query, table

#: words of a window, words of a fingerprint, and k-grams in a window of ten words
WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
#: characters of benchmark text in one broadcast block
BLOCK_CHARS = 8_000_000
_SECOND = 0x51ED270B

COLUMNS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[dict]:
    """Windows and fingerprints of the items, some ``block_chars`` of text at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(chars / block_chars))
    for b in range(n):
        yield model(items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).toArrow())


def model(items: pa.Table) -> dict:
    """Ordered window keys by window length with their items, and the fingerprints of full windows."""
    data, offsets = W.flat(items["text"])
    names = np.array(items["item"].to_pylist() or [""], object)
    start, end, first = W.bounds(data, offsets, "alnum")
    h = W.hashes(data, start, end, "alnum")
    counts, found = np.diff(first), {}
    for n in sorted({min(int(c), WINDOW) for c in counts} - {0}):
        ok = W.gram_starts(first, n, max(0, len(h) - n + 1))
        row = W.rows_of(first)[: len(ok)]
        at = np.flatnonzero(ok & ((counts[row] == n) | (n == WINDOW)))
        key, check = W.grams_at(h, at, n), W.grams_at(h, at, n, _SECOND)
        order = np.argsort(key, kind="stable")
        found[n] = (key[order], check[order], row[at][order])
    g = W.grams(h, GRAM)
    full = np.flatnonzero(W.gram_starts(first, WINDOW, max(0, len(h) - WINDOW + 1)))
    marks = np.unique(g[W.anchors(g, SPAN)[full]]) if len(full) else np.zeros(0, np.uint64)
    return {"names": names, "windows": found, "marks": marks}


def _look_up(h: np.ndarray, at: np.ndarray, n: int, known: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(position, item) of each window that starts at one of the positions and occurs in an item."""
    key, check, item = known
    mine = W.grams_at(h, at, n)
    lo, hi = np.searchsorted(key, mine, "left"), np.searchsorted(key, mine, "right")
    some = hi > lo
    at, lo, count = at[some], lo[some], (hi - lo)[some]
    pick = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
    at = np.repeat(at, count)
    same = check[pick] == W.grams_at(h, at, n, _SECOND)
    return at[same], item[pick[same]]


def hits(h: np.ndarray, first: np.ndarray, known: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words are hit, and (row, item) of each item with an occurring window."""
    hit, row_of = np.zeros(len(h), bool), W.rows_of(first)
    pairs: list[np.ndarray] = []
    for n, windows in known["windows"].items():
        ok = W.gram_starts(first, n, max(0, len(h) - n + 1))
        if n == WINDOW:
            g = W.grams(h, GRAM)
            kept = W.anchors(g, SPAN)[: len(ok)]
            marked = np.zeros(len(g), bool)
            sel = np.unique(kept[ok])
            marked[sel] = W.member(g[sel], known["marks"])
            at = np.flatnonzero(ok & marked[kept])
        else:
            at = np.flatnonzero(ok & W.member(W.grams(h, n), windows[0]))
        at, item = _look_up(h, at, n, windows)
        if len(at):
            hit |= W.covered(np.unique(at), n, len(h))
            pairs.append(np.unique(np.stack([row_of[at], item]), axis=1))
    both = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)
    return hit, both[0], both[1]


def _judge(batch: pa.RecordBatch, known: dict) -> tuple[np.ndarray, list[bytes], list[list[str]]]:
    """Words, bits of the hit words and item names of each row of a batch."""
    data, offsets = W.flat(batch["text"])
    counts, bits, items = np.zeros(batch.num_rows, np.int64), [b""] * batch.num_rows, [[] for _ in range(batch.num_rows)]
    for lo, hi in W.chunks(offsets):
        part, cut = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        start, end, first = W.bounds(part, cut, "alnum")
        hit, row, item = hits(W.hashes(part, start, end, "alnum"), first, known)
        counts[lo:hi] = np.diff(first)
        for r in np.unique(row):
            bits[lo + r] = np.packbits(hit[first[r] : first[r + 1]]).tobytes()
            items[lo + r] = sorted({known["names"][i] for i in item[row == r]})
    return counts, bits, items


def _fold(bits: bytes, more: bytes) -> bytes:
    return bits or more if not (bits and more) else (np.frombuffer(bits, np.uint8) | np.frombuffer(more, np.uint8)).tobytes()


def judged(documents: DataFrame, benchmark: DataFrame, columns: list[str], only_clean: bool = False) -> DataFrame:
    """The chosen columns of each document with :data:`COLUMNS`; or, ``only_clean``, those columns of clean ones alone."""
    spark = documents.sparkSession
    names = [f"c{i}" for i in range(len(columns))]
    rows = documents.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)), F.col("text").cast("string").alias("text"), F.lit(None).cast("binary").alias("bits"), F.lit(None).cast("array<string>").alias("items"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    models = list(blocks(benchmark))
    for k, known in enumerate(models):
        last, shared = k == len(models) - 1, spark.sparkContext.broadcast(known)
        out = f"{kinds}, {COLUMNS}" if last else f"{kinds}, text string, bits binary, items array<string>"

        def step(batches: Iterator[pa.RecordBatch], last=last, shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts, bits, items = _judge(batch, shared.value)
                if batch["bits"].null_count < batch.num_rows:
                    bits = [_fold(a or b"", b) for a, b in zip(batch["bits"].to_pylist(), bits, strict=True)]
                    items = [sorted({*(a or ()), *b}) for a, b in zip(batch["items"].to_pylist(), items, strict=True)]
                own = [batch[n] for n in names]
                if not last:
                    yield pa.RecordBatch.from_arrays([*own, batch["text"], pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string()))], [*names, "text", "bits", "items"])
                    continue
                n_hit = np.array([int.from_bytes(b, "little").bit_count() for b in bits], np.int64)
                done = pa.RecordBatch.from_arrays(
                    [*own, pa.array(counts), pa.array(n_hit), pa.array(list(map(len, items)), pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array(n_hit > 0)],
                    [*names, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )
                yield done.filter(pa.array(n_hit == 0)) if only_clean else done

        rows = rows.mapInArrow(step, out)
    found = [] if only_clean else ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return rows.select(*(F.col(n).alias(c) for n, c in zip(names, columns, strict=True)), *found)


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all their columns, without those that a benchmark window occurs in."""
    return judged(documents, benchmark, documents.columns, only_clean=True)


_ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
spots AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw CROSS JOIN (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
found AS (SELECT doc_id, i, spots.n, item_id FROM spots JOIN win ON spots.g = win.g AND spots.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op10_winnowing_decontamination", _ORACLE)
def op10_winnowing_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Hit words and items of every document of the table."""
    return judged(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])
