"""Substring dedup by relative Lempel-Ziv parsing.

The reference is every earlier document, cut into blocks (shards). Its index is the set of windows of 13
words with the first document of each. A document is parsed greedily from left to right: a factor starts at
an indexed window and grows while the next window is indexed with the same reference; where the reference
changes, the next factor starts inside the last one, so the windows over a factor boundary are checked too.
Words under factors are duplicate spans.

Most windows are unique and are never sent. Of each window the smallest hash of five words is its anchor
(equal windows have equal anchors); only windows whose anchor occurs in two documents are asked about.
Anchors and windows travel as packed arrays in groups of hashes (:mod:`routing`): a passage that a third of
all documents share is asked about once per task. Texts are shuffled once, by a hash of doc_id, and that
exchange is read for both passes. Everything is one lazy plan, so a lost executor costs its partitions.

Windows are compared by 96 bits of two hashes. Null and empty texts and texts of fewer than 13 words have no
window. A null doc_id counts as larger than all others; rows with the same doc_id are not duplicates of each
other. Windows are judged on the input, not on what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import routing as R
from tidewatch.llm import words as W
from tidewatch.llm.common import groups_for, query, table

#: words of a duplicate window and of an anchor
WINDOW, GRAM = 13, 5
SPAN = WINDOW - GRAM + 1
#: bytes of the stored table per shard of documents and per group of keys
SHARD_BYTES, PART_BYTES = 6 << 20, 8 << 20
_SECOND = 0x2C1B3C6D
_NO_ID = np.iinfo(np.int64).max

SPANS = "doc_id long, start_word int, n_words int, ref_doc_id long"


def _shard_column(shards: int):
    return F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")


def _parsed(texts: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk of rows: its range, word hashes, first words, and start and anchor hash of each window."""
    data, offsets = W.flat(texts)
    for lo, hi in W.chunks(offsets):
        part = data[offsets[lo] : offsets[hi]]
        start, end, first = W.bounds(part, offsets[lo : hi + 1] - offsets[lo], "space")
        h = W.hashes(part, start, end, "space")
        g = W.grams(h, GRAM)
        at = np.flatnonzero(W.gram_starts(first, WINDOW, max(0, len(h) - WINDOW + 1)))
        yield lo, hi, h, first, at, W.anchors(g, SPAN)[at], g


def _anchor_asks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Which anchors does each shard hold? Those of two documents of the batch are known to be shared."""
    for batch in batches:
        ids, shards = batch["id"].to_numpy(zero_copy_only=False), batch["shard"].to_numpy(zero_copy_only=False)
        keys, rows = [], []
        for lo, _, _, first, at, kept, g in _parsed(batch["text"]):
            sel = np.unique(kept)
            keys.append(g[sel])
            rows.append(np.searchsorted(first, sel, "right") - 1 + lo)
        if not keys:
            continue
        key, row = np.concatenate(keys), np.concatenate(rows)
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        out = R.asks()
        if len(key):
            a, b = R.cuts(key)
            low, high = np.minimum.reduceat(ids[row], a), np.maximum.reduceat(ids[row], a)
            shared = low < high
            R.ask(out, parts, R.QUESTION, key[a[~shared]], shards[row[a[~shared]]])
            R.ask(out, parts, R.SHARED, key[a[shared]], None)
            inside = np.repeat(shared, b - a)
            pair = np.unique(np.stack([shards[row[inside]].astype(np.uint64), key[inside]]), axis=1)
            ready = R.answers()
            R.answer(ready, pair[0].astype(np.int64), pair[1])
            for s, k, _ in zip(*ready.columns, strict=True):
                out.add(s % parts, R.READY, s, k, None, None)
        yield from out.table().to_batches()


def _anchor_answers(asked: pa.Table) -> pa.Table:
    """To each shard, those of its anchors that another document holds."""
    kind = asked["kind"].to_numpy()
    keys, values = asked["keys"].to_pylist(), asked["values"].to_pylist()
    out = R.answers()
    for i in np.flatnonzero(kind == R.READY):
        out.add(asked["shard"][int(i)].as_py(), keys[i], None)
    mine = np.flatnonzero(kind == R.QUESTION)
    if len(mine):
        key = np.concatenate([R.keys_of(keys[i]) for i in mine])
        shard = np.concatenate([R.unpack(values[i]) for i in mine])
        known = [R.keys_of(keys[i]) for i in np.flatnonzero(kind == R.SHARED)]
        order = np.argsort(key, kind="stable")
        key, shard = key[order], shard[order]
        again = np.zeros(len(key), bool)
        again[1:] = key[1:] == key[:-1]
        again[:-1] |= again[1:]
        if known:
            again |= W.member(key, np.unique(np.concatenate(known)))
        R.answer(out, shard[again], key[again])
    return out.table()


def _all(column: pa.ChunkedArray, of) -> np.ndarray:
    parts = [of(x) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else of(None)


def _window_asks(documents: pa.Table, known: pa.Table, parts: int) -> pa.Table:
    """The first document of the shard for each window with a shared anchor."""
    out = R.asks()
    shared = np.unique(_all(known["keys"], R.keys_of))
    if not len(shared) or not documents.num_rows:
        return out.table()
    ids, keys, checks, rows = documents["id"].to_numpy(), [], [], []
    for lo, _, h, first, at, kept, g in _parsed(documents["text"]):
        at = at[W.member(g[kept], shared)]
        keys.append(W.grams_at(h, at, WINDOW))
        checks.append((W.grams_at(h, at, WINDOW, _SECOND) >> np.uint64(32)).astype(np.uint32))
        rows.append(np.searchsorted(first, at, "right") - 1 + lo)
    key, check, doc = np.concatenate(keys), np.concatenate(checks), ids[np.concatenate(rows)]
    if not len(key):
        return out.table()
    order = np.lexsort((doc, check, key))
    key, check, doc = key[order], check[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    a = np.flatnonzero(new)
    R.ask(out, parts, R.QUESTION, key[a], doc[a], check[a], int(documents["shard"][0].as_py()))
    twice = np.maximum.reduceat(doc, a) > doc[a]
    ready = a[twice]
    if len(ready):
        s = int(documents["shard"][0].as_py())
        out.add(s % parts, R.READY, s, key[ready].tobytes(), None, R.pack(doc[ready]))
    return out.table()


def _window_answers(asked: pa.Table) -> pa.Table:
    """To each shard, those of its windows that an earlier document holds, with the first such document."""
    kind, shards = asked["kind"].to_numpy(), asked["shard"].to_numpy()
    keys, checks, values = (asked[c].to_pylist() for c in ("keys", "checks", "values"))
    out = R.answers()
    for i in np.flatnonzero(kind == R.READY):
        out.add(int(shards[i]), keys[i], values[i])
    mine = np.flatnonzero(kind == R.QUESTION)
    if len(mine):
        key = np.concatenate([R.keys_of(keys[i]) for i in mine])
        check = np.concatenate([np.frombuffer(checks[i], np.uint32) for i in mine])
        doc = np.concatenate([R.unpack(values[i]) for i in mine])
        shard = np.repeat(shards[mine], [len(keys[i]) // 8 for i in mine])
        order = np.lexsort((doc, check, key))
        key, check, doc, shard = key[order], check[order], doc[order], shard[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
        first = doc[np.flatnonzero(new)[np.cumsum(new) - 1]]
        late = doc > first
        R.answer(out, shard[late], key[late], first[late])
    return out.table()


def _factors(documents: pa.Table, known: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Per row: its number, and start, length and reference of its factors, and its number of words."""
    key, ref = _all(known["keys"], R.keys_of), _all(known["values"], R.unpack)
    order = np.lexsort((ref, key))
    key, ref = key[order], ref[order]
    if len(key):
        at = R.cuts(key)[0]
        key, ref = key[at], ref[at]
    ids = documents["id"].to_numpy()
    for lo, hi, h, first, at, _, _ in _parsed(documents["text"]):
        row = np.searchsorted(first, at, "right") - 1
        if len(key) and len(at):
            mine = W.grams_at(h, at, WINDOW)
            spot = np.minimum(np.searchsorted(key, mine), len(key) - 1)
            found = (key[spot] == mine) & (ids[row + lo] > ref[spot])
            at, row, source = at[found], row[found], ref[spot[found]]
        else:
            at, row, source = at[:0], row[:0], ids[:0]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]) | (source[1:] != source[:-1])
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(at))) + WINDOW - 1
        edges = np.searchsorted(row[start], np.arange(hi - lo + 1))
        for r in range(hi - lo):
            f = start[edges[r] : edges[r + 1]]
            yield lo + r, at[f] - first[r], length[edges[r] : edges[r + 1]], source[f], int(first[r + 1] - first[r])


def _marked(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge)[:n] > 0


def _parsed_by(documents: DataFrame, columns: list[str], result, schema: str) -> DataFrame:
    """``result`` of each shard's rows and answers; columns travel as c0, c1, ..."""
    shards, parts = groups_for(documents, SHARD_BYTES), groups_for(documents, PART_BYTES)
    names = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    plain = documents.select(ids.alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = documents.select(ids.alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *names).withColumn("shard", _shard_column(shards))
    asked = plain.withColumn("shard", _shard_column(shards)).mapInArrow(lambda it: _anchor_asks(it, parts), R.ASK)
    shared = asked.groupBy("part").applyInArrow(_anchor_answers, R.ANSWER)
    asked = whole.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(lambda d, k: _window_asks(d, k, parts), R.ASK)
    known = asked.groupBy("part").applyInArrow(_window_answers, R.ANSWER)
    return whole.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(result, schema)


def duplicate_spans(documents: DataFrame) -> DataFrame:
    """Factors of every document: first word, number of words and the reference document."""

    def result(d: pa.Table, known: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        ids = d["id"].to_pylist()
        for r, start, length, source, _ in _factors(d, known):
            for column, values in zip(out, ([ids[r]] * len(start), start.tolist(), length.tolist(), source.tolist()), strict=True):
                column += values
        return pa.table({"doc_id": pa.array(out[0], pa.int64()), "start_word": pa.array(out[1], pa.int32()), "n_words": pa.array(out[2], pa.int32()), "ref_doc_id": pa.array(out[3], pa.int64())})

    return _parsed_by(documents, [], result, SPANS).withColumn("doc_id", F.nullif("doc_id", F.lit(_NO_ID)))


def judged(documents: DataFrame) -> DataFrame:
    """Words, removed words and the hash of the kept words of every document."""

    def result(d: pa.Table, known: pa.Table) -> pa.Table:
        n = d.num_rows
        counts, removed, hashed = np.zeros(n, np.int64), np.zeros(n, np.int64), [""] * n
        data, offsets = W.flat(d["text"])
        for r, start, length, _, n_words in _factors(d, known):
            words = data[offsets[r] : offsets[r + 1]].tobytes().split()
            counts[r] = n_words
            if len(start):
                gone = _marked(start, length, n_words)
                removed[r] = gone.sum()
                words = [words[i] for i in np.flatnonzero(~gone)]
            hashed[r] = hashlib.sha256(b" ".join(words)).hexdigest()
        return pa.table({"id": d["id"], "n_words": counts, "n_removed": removed, "kept_sha256": pa.array(hashed, pa.string())})

    rows = _parsed_by(documents, [], result, "id long, n_words long, n_removed long, kept_sha256 string")
    return rows.select(F.nullif("id", F.lit(_NO_ID)).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def deduplicated(documents: DataFrame) -> DataFrame:
    """The documents, all their columns, without duplicate spans.

    What is left between spans keeps its own white space, and pieces are joined by a line break; n_chars, where
    it is a column, counts what is left. Documents of which no word is left go; texts without words stay.
    """
    columns = documents.columns
    at = columns.index("text")
    schema = ", ".join(f"c{i} {documents.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))

    def result(d: pa.Table, known: pa.Table) -> pa.Table:
        data, offsets = W.flat(d["text"])
        texts, stay = d[f"c{at}"].to_pylist(), np.ones(d.num_rows, bool)
        for r, start, length, _, n_words in _factors(d, known):
            if not len(start):
                continue
            left = ~_marked(start, length, n_words)
            raw = data[offsets[r] : offsets[r + 1]]
            begin, end, _ = W.bounds(raw, np.array([0, len(raw)]), "space")
            edge = np.flatnonzero(np.diff(np.concatenate([[False], left, [False]]).astype(np.int8)))
            texts[r] = "\n".join(raw[begin[a] : end[b - 1]].tobytes().decode() for a, b in zip(edge[::2], edge[1::2], strict=True))
            stay[r] = left.any()
        out = d.select([f"c{i}" for i in range(len(columns))])
        return out.set_column(at, f"c{at}", pa.array(texts, out.schema.field(at).type)).filter(pa.array(stay))

    rows = _parsed_by(documents, columns, result, schema).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))
    return rows.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in columns else rows


_ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM dw WHERE len(w) >= 13)),
firsts AS (SELECT g, min(doc_id) AS d FROM spots GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM spots JOIN firsts USING (g) WHERE doc_id > d),
lists AS (SELECT doc_id, w, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM dw),
kept AS (SELECT l.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY l.p) AS t FROM lists l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.p = g.p GROUP BY l.doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM dw LEFT JOIN kept USING (doc_id)
"""


@query("op6_relative_lempel_ziv", _ORACLE)
def op6_relative_lempel_ziv(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document under factors of earlier documents."""
    return judged(table(spark, folder, "documents"))
