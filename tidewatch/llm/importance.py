"""Importance resampling towards a target: hashed n-gram features from prefix CRCs, Gumbel top draws.

A document is normalised (A-Z lower-cased, its words joined by one space) and its running CRC-32 is scanned once;
only the states at word edges are kept. CRC is linear over GF(2): the state after a prefix, shifted by the length
of what follows, cancels out of the state after the longer prefix. So the CRC of any n-gram is

    state(end) ^ shift(state(start) ^ ones, length) ^ ones

with ``shift`` a table lookup per byte of the state, and no n-gram is ever built as text. Buckets (CRC modulo
:data:`BUCKETS`) are written as one binary column, so texts are read once.

A bucket's gain is the floored thousandfold log of its smoothed probability in the target against that in the
corpus; both counts cover all rows, and tasks add up their own counts before they are shuffled. The table of gains has
:data:`BUCKETS` rows, whatever the corpus. Adding Gumbel noise, derived from the id, to a document's mean gain and taking the
largest sums draws without replacement in proportion to the exponentials of the mean gains.

Rows: a null text has no words, so no features and weight 0; a null id counts as the empty text in the noise. Rows
that repeat an id are rows of their own; equal scores go by doc_id (nulls last), rows equal in both by n_features and weight, and
rows equal in all of these in any order. An empty table gives no rows; an empty target gives gains against counts of zero. Texts are walked
in segments, so memory grows by the number of words of the longest text only. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm import words as W
from tidewatch.llm.common import query, shuffle_partitions, table
from tidewatch.session import written

#: feature lengths in words, buckets (at most 2^16), words of a document that may be drawn, drawn hundredths, seed
LONGEST, BUCKETS, LEAST_WORDS, DRAWN, SEED = 2, 10_000, 20, 25, 7
#: rows of one range of scores whose places are counted in one task
RANGE_ROWS = 1_000_000

_ONES = np.uint32(0xFFFFFFFF)
#: bytes that one lane scans; lanes advance together
_LANE = 1024


def _byte_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x


_STEP = _byte_table()
_SHIFTS: list[np.ndarray] = []


def _advance(x: np.ndarray) -> np.ndarray:
    """States after one more zero byte."""
    return _STEP[x & 255] ^ (x >> np.uint32(8))


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map, given by its values on the four bytes of a state, on all states."""
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


def _shifts() -> np.ndarray:
    """Maps of shifts by 0 to _LANE bytes, made once per process."""
    if not _SHIFTS:
        byte = np.arange(256, dtype=np.uint32)
        maps = np.empty((_LANE + 1, 4, 256), np.uint32)
        maps[0] = np.stack([byte << np.uint32(8 * i) for i in range(4)])
        for i in range(_LANE):
            maps[i + 1] = _advance(maps[i])
        _SHIFTS.append(maps)
    return _SHIFTS[0]


def shift(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each state after n more zero bytes; n of any size, by squaring beyond a lane."""
    maps = _shifts()
    at = n % _LANE
    out = maps[at, 0, x & 255] ^ maps[at, 1, (x >> 8) & 255] ^ maps[at, 2, (x >> 16) & 255] ^ maps[at, 3, x >> 24]
    far, power = n // _LANE, maps[_LANE]
    while far.any():
        odd = (far & 1).astype(bool)
        out[odd] = _apply(power, out[odd])
        far, power = far >> 1, np.stack([_apply(power, p) for p in power])
    return out


def _scan(buffer: np.ndarray, at: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """Running states at ascending positions of a buffer and at its end, from ``state`` on."""
    lanes = max(1, -(-len(buffer) // _LANE))
    padded = np.zeros(lanes * _LANE, np.uint8)
    padded[: len(buffer)] = buffer
    columns = np.ascontiguousarray(padded.reshape(lanes, _LANE).T)
    inside = np.zeros((_LANE + 1, lanes), np.uint32)
    for i in range(_LANE):
        inside[i + 1] = _advance(inside[i] ^ columns[i])
    maps, before = _shifts()[_LANE], np.zeros(lanes, np.uint32)
    before[0] = state
    for k in range(1, lanes):
        before[k] = _apply(maps, before[k - 1 : k])[0] ^ inside[_LANE, k - 1]
    ends = np.append(at, len(buffer))
    lane = np.minimum(ends // _LANE, lanes - 1)
    offset = ends - lane * _LANE
    out = inside[offset, lane]
    part = offset < _LANE
    out[part] ^= shift(before[lane[part]], offset[part])
    out[~part] ^= _apply(maps, before[lane[~part]])
    return out[:-1], int(out[-1])


def _normalised(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The words, lower-cased, with one space after each."""
    size = end - start + 1
    stop = np.cumsum(size)
    source = np.arange(stop[-1]) + np.repeat(start - (stop - size), size)
    out = W.KINDS["alnum"][1][data[np.minimum(source, len(data) - 1)]]
    out[stop - 1] = 0x20
    return out


def edge_states(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running states of the normalised text before and after each word, in segments of bounded size."""
    left, right = np.zeros(len(start), np.uint32), np.zeros(len(start), np.uint32)
    total = np.cumsum(end - start + 1)
    lo, state = 0, 0
    while lo < len(start):
        base = total[lo - 1] if lo else 0
        hi = int(np.searchsorted(total, base + W.SEGMENT, "right"))
        if hi <= lo:  # one word longer than a segment
            left[lo] = state
            word = W.KINDS["alnum"][1][data[start[lo] : end[lo]]].tobytes()
            right[lo] = zlib.crc32(word, state ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
            state = zlib.crc32(b" ", int(right[lo]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
            lo += 1
            continue
        size = end[lo:hi] - start[lo:hi] + 1
        stop = np.cumsum(size)
        edges = np.stack([stop - size, stop - 1], axis=1).ravel()
        states, state = _scan(_normalised(data, start[lo:hi], end[lo:hi]), edges, state)
        left[lo:hi], right[lo:hi] = states[::2], states[1::2]
        lo = hi
    return left, right


def gram_crcs(left: np.ndarray, right: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """CRC-32 of the n words from each position on, joined by spaces; rows are not looked at."""
    m = max(0, len(size) - n + 1)
    if not m:
        return np.zeros(0, np.uint32)
    total = np.concatenate([[0], np.cumsum(size + 1)])
    length = total[n : n + m] - total[:m] - 1
    return right[n - 1 : n - 1 + m] ^ shift(left[:m] ^ _ONES, length) ^ _ONES


def features(data: np.ndarray, offsets: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRCs of all runs of 1 to ``longest`` words of each row, the first one of each row, and words per row."""
    start, end, first = W.bounds(data, offsets, "alnum")
    left, right = edge_states(data, start, end)
    words = np.diff(first)
    per = [np.maximum(words - n + 1, 0) for n in range(1, longest + 1)]
    begin = np.concatenate([[0], np.cumsum(sum(per))])
    out = np.zeros(begin[-1], np.uint32)
    done = begin[:-1].copy()
    for n, count in enumerate(per, 1):
        crc = gram_crcs(left, right, end - start, n)
        rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        out[np.repeat(done, count) + rank] = crc[np.repeat(first[:-1], count) + rank]
        done += count
    return out, begin, words


def bucketed(rows: DataFrame, columns: list[str], longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """The chosen columns, ``n_words`` and ``found``: the bucket of each feature as 16-bit integers."""
    names = [f"c{i}" for i in range(len(columns))]
    slim = rows.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)), F.col("text").cast("string").alias("text"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in slim.schema if f.name in names)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.flat(batch["text"])
            for lo, hi in W.chunks(offsets):
                crc, begin, words = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], longest)
                raw = (crc % np.uint32(buckets)).astype("<u2")
                found = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((begin * 2).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([*(batch[n].slice(lo, hi - lo) for n in names), pa.array(words.astype(np.int64)), found], [*names, "n_words", "found"])

    out = slim.mapInArrow(step, f"{kinds}n_words long, found binary")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, columns, strict=True)), "n_words", "found")


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 16-bit integers of a binary column and where each row begins (one more than rows)."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw[at[0] : at[-1]].tobytes(), "<u2"), (at - at[0]) // 2


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows; every task adds up its own before anything is shuffled."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_codes(batch["found"])[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    sums = found.select("found").mapInArrow(step, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log ratio of the smoothed probability of each bucket."""
    n = float(len(corpus))
    return np.floor(1000 * np.log((target + 1.0) * (corpus.sum() + n) / ((corpus + 1.0) * (target.sum() + n)))).astype(np.int64)


def weighed(found: DataFrame, columns: list[str], gain: np.ndarray) -> DataFrame:
    """The chosen columns, ``n_words``, ``n_features`` and ``weight``, the floored mean gain."""
    shared = found.sparkSession.sparkContext.broadcast(gain)  # one number per bucket
    names = [f"c{i}" for i in range(len(columns))]
    rows = found.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)), "n_words", "found")
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name in names)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, begin = _codes(batch["found"])
            total = np.concatenate([[0], np.cumsum(shared.value[codes])])
            n = np.diff(begin)
            weight = (total[begin[1:]] - total[begin[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), batch["n_words"], pa.array(n), pa.array(weight)], [*names, "n_words", "n_features", "weight"])

    out = rows.mapInArrow(step, f"{kinds}n_words long, n_features long, weight long")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, columns, strict=True)), "n_words", "n_features", "weight")


def noise(doc_id: str, seed: int = SEED):
    """Floored thousandfold Gumbel noise from the first 32 bits of a SHA-256."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def placed(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``name``: 1-based place of each row in an order. Ranges of the order are counted one by one.

    The last sort key deals out rows that are equal in the order, so no range grows with them. The ranges are a written table,
    so the places and the counts before them refer to the same cut.
    """
    spark = rows.sparkSession
    parts = max(shuffle_partitions(spark), -(-rows.count() // RANGE_ROWS))
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *order, F.col("_row")).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_part").orderBy(*order, "_row")
    out = ranged.withColumn("_at", F.row_number().over(inner)).join(sizes, "_part")
    return out.select(*rows.columns, (F.col("_at") + F.col("_before")).cast("long").alias(name))


def resampled(documents: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every document."""
    found = written(bucketed(documents, ["doc_id"]), "buckets")
    gain = gains(bucket_counts(found), bucket_counts(bucketed(target, [])))
    scored = written(weighed(found, ["doc_id"], gain).withColumn("score", F.col("weight") + noise("doc_id")), "weighed")
    may = F.col("n_words") >= LEAST_WORDS
    ranked = placed(scored.filter(may), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")], "rank")
    drawn = scored.filter(may).count() * DRAWN // 100
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = ranked.unionByName(scored.filter(~may).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_ORACLE = r"""
WITH steps AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
dw AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS MATERIALIZED (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS MATERIALIZED (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM dw WHERE len(w) > 0),
tf AS MATERIALIZED (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM iw WHERE len(w) > 0),
kinds AS MATERIALIZED (SELECT g, hex(encode(g)) AS x FROM (SELECT g FROM df UNION SELECT g FROM tf)),
crcs AS MATERIALIZED (SELECT g, xor(list_reduce(list_transform(range(1, len(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT)),
       lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 10000 AS b FROM kinds CROSS JOIN steps),
s AS (SELECT b, count(*) AS n FROM df JOIN crcs USING (g) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM tf JOIN crcs USING (g) GROUP BY b),
gain AS MATERIALIZED (SELECT k.b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)
       / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)))) AS BIGINT) AS v
     FROM (SELECT unnest(range(10000)) AS b) k LEFT JOIN s ON s.b = k.b LEFT JOIN t ON t.b = k.b),
mean AS (SELECT r, count(*) AS n, CAST(floor(sum(v) / count(*)::DOUBLE) AS BIGINT) AS v FROM df JOIN crcs USING (g) JOIN gain USING (b) GROUP BY r),
scored AS (SELECT dw.r, doc_id, len(w) AS n_words, coalesce(mean.n, 0) AS n_features, coalesce(v, 0) AS weight,
       coalesce(v, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
     FROM dw LEFT JOIN mean USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (r)
"""


@query("op13_prefix_crc_resampling", _ORACLE)
def op13_prefix_crc_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Weights, scores and draws of every document of the table towards the benchmark."""
    return resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
