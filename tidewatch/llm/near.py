"""MinHash near-dedup with odd sketches.

Each text becomes the set of its distinct word shingles. Equal sets are one class (compared by a 128-bit sum
of hashes), so groups of copies shrink to one row by a map-side minimum. Each class has :data:`HASHES`
MinHash samples: bands of them form buckets, and all samples are folded into an odd sketch, a bitmap in which
every (hash, sample) toggles one bit. The XOR of two sketches keeps the bits of samples that differ, so its
population count estimates high similarities; pairs far below the threshold go before any text is read.

Links are confirmed on full sets. First each bucket is a star: its members are compared with its centre, the
member that meets most band mates, never all with all. What the stars join are components; the members of buckets of three and more that
still span several components are compared further, across components alone. For that they are not paired by bucket but by prefix:
shingles have one order, rare ones first, and two sets that reach the threshold have a shingle in common among the first fifth (and
one more) of each; what either has from the first common one on is at least 4/9 of both sizes. So a shingle far down in a set
needs a partner small enough, and neither near copies nor pages of one template, which share their frequent shingles, meet in pairs.
Every pair of classes in one bucket ends up in one component, ruled out, or compared. A pair at similarity 0.8 shares a
bucket but for 1.3e-7 (30 bands of four hashes) and passes its sketch but for 1e-6.

Null and empty texts have the empty set and link with nothing. Fewer words than a shingle: the whole sequence
is one shingle. Inside, each text of each doc_id is a node of its own, named by a 64-bit hash of both, so a shared or missing id
multiplies nothing. In :func:`near_duplicates`, one row per document, nodes of equal ids are joined at the end: a null doc_id counts
as one largest id, and rows that repeat a doc_id as one document with all of their texts. In :func:`deduplicated` they stay apart, so
neither a shared nor a missing id links texts or removes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import words as W
from tidewatch.llm.common import query, table
from tidewatch.session import written

BANDS, ROWS, HASHES = 30, 4, 240
#: longs of an odd sketch, and the most differing bits of a pair at the threshold: 48 of 240 samples are expected
#: to differ, deviation 6.2; at five deviations 79 differ and toggle 158 of 1024 bits, 136 of them odd times
SKETCH_LONGS, MOST_BITS = 16, 140
THRESHOLD = 80
#: counters that put shingles in order of their frequency; shingles that share one are ordered by their hash
COUNTERS = 1 << 18
#: most bits of a filter of nodes; beyond the nodes it can tell apart it lets more rows through, never fewer
FILTER_BITS = 1 << 26
#: pairs of texts that a Python worker holds at once
PAIR_ROWS = 200
_NO_ID = np.iinfo(np.int64).max

_RANDOM = W.mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_MULTIPLY, _FLIP = (_RANDOM[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_RANDOM[HASHES:] >> np.uint64(32)).astype(np.uint32)

_SET = "id long, doc long, n_shingles long, low long, high long, bands array<long>, sketch array<long>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Ordered distinct shingle hashes of each row, and where each row starts (one more than rows)."""
    start, end, first = W.bounds(data, offsets, "lower")
    h, n = W.hashes(data, start, end, "lower"), np.diff(first)
    g, row = W.grams(h, words), W.rows_of(first)
    ok = W.gram_starts(first, words, len(g))
    keys, rows = [g[ok]], [row[: len(g)][ok]]
    for k in range(1, words):  # texts of k words, each one shingle
        short = np.flatnonzero(n == k)
        keys.append(W.grams_at(h, first[short], k, salt=k))
        rows.append(short)
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def samples(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash samples of non-empty sets, one row per hash function."""
    short = (keys >> np.uint64(32)).astype(np.uint32)
    out = np.empty((HASHES, len(starts)), np.uint32)
    work = np.empty_like(short)
    for i in range(HASHES):
        np.bitwise_xor(short, _FLIP[i], out=work)
        np.multiply(work, _MULTIPLY[i], out=work)
        np.minimum.reduceat(work, starts, out=out[i])
    return out


def odd_sketches(sampled: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, one row of longs per set."""
    bits = SKETCH_LONGS * 64
    which = np.arange(HASHES, dtype=np.uint64)[:, None] << np.uint64(32)
    spot = (W.mix(sampled.astype(np.uint64) | which) % np.uint64(bits)).astype(np.int64)
    n = sampled.shape[1]
    count = np.bincount((spot + np.arange(n) * bits).ravel(), minlength=n * bits).reshape(n, bits)
    return np.packbits((count & 1).astype(np.uint8), axis=1).view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = W.flat(batch["text"])
        for lo, hi in W.chunks(offsets):
            key, at = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)
            size = np.diff(at)
            full = np.flatnonzero(size)
            low, high, n = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64), hi - lo
            bands, sketch = np.zeros((n, BANDS), np.int64), np.zeros((n, SKETCH_LONGS), np.int64)
            if len(full):
                low[full] = np.add.reduceat(W.mix(key), at[full])
                high[full] = np.add.reduceat(W.mix(key ^ np.uint64(0x5851F42D4C957F2D)), at[full])
                sampled = samples(key, at[full])
                sketch[full] = odd_sketches(sampled)
                s = sampled.astype(np.uint64)
                for b in range(BANDS):
                    total = np.full(len(full), b + 1, np.uint64)
                    for r in range(ROWS):
                        total = W.mix(total + s[b * ROWS + r])
                    bands[full, b] = total.view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)), pa.array(bands[full].ravel()))
            maps = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * SKETCH_LONGS), pa.array(sketch.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch["id"].slice(lo, n), batch["doc"].slice(lo, n), pa.array(size.astype(np.int64)), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), lists, maps],
                ["id", "doc", "n_shingles", "low", "high", "bands", "sketch"],
            )


def _rows(documents: DataFrame) -> DataFrame:
    """id (node), doc and text of every document."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    return documents.select(_node("doc_id", "text").alias("id"), doc.alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _node(doc: str, text: str):
    return F.xxhash64(F.coalesce(F.col(doc).cast("long"), F.lit(_NO_ID)), F.coalesce(F.col(text).cast("string"), F.lit("")))


def _likely(a: str, b: str):
    """Whether sizes and sketches of two sides allow the threshold."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = F.aggregate(F.zip_with(f"{a}.s", f"{b}.s", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, c: t + c)
    return (100 * F.least(n_a, n_b) >= THRESHOLD * F.greatest(n_a, n_b)) & (differ <= MOST_BITS)


def _asked(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows whose node may be among ``ids``: a filter of bounded size, so that the texts of all others need not be shuffled."""
    bits = min(FILTER_BITS, 1 << max(10, (32 * ids.count()).bit_length()))
    spot = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select(spot.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS int))")).alias("mask")).toArrow()
    mask = np.zeros(bits // 64, np.int64)
    mask[words["word"].to_numpy()] = words["mask"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(mask)

    @F.pandas_udf("boolean")
    def maybe(at: pd.Series) -> pd.Series:
        x = at.to_numpy()
        return pd.Series((shared.value[x // 64] >> (x % 64)) & 1 == 1)

    return rows.filter(maybe(spot))


def _texts_of(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """One text per node of ``ids`` (column id): copies of a node have equal texts."""
    ids = written(ids.distinct(), "asked")
    return _asked(ids, rows.select("id", "text")).join(ids, "id", "left_semi").dropDuplicates(["id"])


def confirmed(pairs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, as a written table."""
    spark = pairs.sparkSession
    rows = _texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), rows)
    text_a, text_b = rows.select(F.col("id").alias("a"), F.col("text").alias("text_a")), rows.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("text_a", "text_b"):
                data, offsets = W.flat(batch[name])
                found: list[np.ndarray] = []
                for lo, hi in W.chunks(offsets):
                    key, at = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)
                    found += [key[at[i] : at[i + 1]] for i in range(hi - lo)]
                sides.append(found)
            both = np.array([W.member(x, y).sum() for x, y in zip(*sides, strict=True)], np.int64)
            total = np.array([len(x) + len(y) for x, y in zip(*sides, strict=True)], np.int64)
            linked = pa.array((both > 0) & (100 * both >= THRESHOLD * (total - both)))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(linked), batch["b"].filter(linked)], ["a", "b"])

    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(PAIR_ROWS))
    try:
        return written(pairs.join(text_a, "a").join(text_b, "b").select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long"), "links")
    finally:
        spark.conf.set(limit, before)


def _sets_of(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi of a batch with their ordered distinct shingles and where each row starts."""
    data, offsets = W.flat(batch["text"])
    for lo, hi in W.chunks(offsets):
        yield lo, hi, *shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)


def prefixes(texts: DataFrame, words: int) -> DataFrame:
    """(id, token, place) for the first shingles of each text, rare ones first, that any text at the threshold shares one of."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, _, key, _ in _sets_of(batch, words):
                total += np.bincount((key % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["counter", "n"])

    sums = texts.select("text").mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(COUNTERS, np.int64)  # its size is a parameter, whatever the corpus
    seen[sums["counter"].to_numpy()] = sums["n"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(seen)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, key, at in _sets_of(batch, words):
                size = np.diff(at)
                row = np.repeat(np.arange(hi - lo), size)
                order = np.lexsort((key, shared.value[(key % np.uint64(COUNTERS)).astype(np.int64)], row))
                place = np.arange(len(key)) - np.repeat(at[:-1], size)
                kept = place < np.repeat(size - (THRESHOLD * size + 99) // 100 + 1, size)
                ids = batch["id"].slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row[kept]]), pa.array(key[order][kept].view(np.int64)), pa.array(place[kept])], ["id", "token", "place"])

    return texts.mapInArrow(first, "id long, token long, place long")


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node (node, component), by alternating large and small stars."""
    stars, before = edges, None
    while True:
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).union(stars.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.filter("a > b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select("b", "m").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        stars = written(small, "stars")
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if tuple(state) == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = tuple(state)


def classes(rows: DataFrame, words: int) -> DataFrame:
    """Per row (id, doc, text): id, doc, n_shingles and the component, a node."""
    described = written(rows.mapInArrow(lambda it: _describe(it, words), _SET), "sets")
    sets = described.filter("n_shingles > 0").groupBy("low", "high").agg(F.min("id").alias("rep"), F.min("n_shingles").alias("n"), F.min("bands").alias("bands"), F.min("sketch").alias("s"))
    sets = written(sets, "classes")
    members = sets.select("rep", F.posexplode("bands").alias("band", "key")).select("key", "rep")
    buckets = members.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    shared = written(members.join(buckets, "key"), "buckets")
    met = shared.groupBy("rep").agg(F.sum("m").alias("met"))
    centre = shared.join(met, "rep").groupBy("key").agg(F.max(F.struct("met", (-F.col("rep")).alias("first"))).alias("c")).select("key", (-F.col("c.first")).alias("centre"))
    starred = written(shared.join(centre, "key").select("key", "rep", "centre", "m"), "starred")
    pairs = starred.filter("rep != centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()

    def linked(pairs: DataFrame) -> DataFrame:
        sides = [sets.select(F.col("rep").alias(k), F.struct("n", "s").alias(v)) for k, v in (("a", "x"), ("b", "y"))]
        likely = written(pairs.join(sides[0], "a").join(sides[1], "b").filter(_likely("x", "y")).select("a", "b"), "likely")
        return confirmed(likely, rows, words)

    links = linked(pairs)
    found = components(links)
    # two members need no more than their star; where more span components, those that are not linked with the centre may be with each other
    labelled = starred.filter("m > 2").join(found, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    spanning = labelled.groupBy("key").agg(F.min("component").alias("l"), F.max("component").alias("h")).filter("l < h").select("key")
    mixed = written(labelled.join(spanning, "key").select("rep", "component").distinct(), "mixed")
    if not mixed.isEmpty():
        texts = written(_texts_of(mixed.select(F.col("rep").alias("id")), rows), "mixed-texts")
        tokens = prefixes(texts, words).join(mixed.join(sets.select("rep", "n"), "rep").withColumnRenamed("rep", "id"), "id")
        # the common part of a pair is at least 4/9 of both sizes, so a shingle at some place allows partners up to a size
        tokens = written(tokens.withColumn("most", F.floor((5 * F.col("n") - 9 * F.col("place")) / 4)), "prefixes")
        tokens = tokens.join(tokens.groupBy("token").agg(F.min("n").alias("least")), "token").filter("most >= least").drop("least")
        tokens = written(tokens, "allowed-prefixes")
        # a token of one component alone says nothing across components
        several = tokens.groupBy("token").agg(F.min("component").alias("l"), F.max("component").alias("h")).filter("l < h").select("token")
        tokens = written(tokens.join(several, "token"), "shared-prefixes")
        fits = (F.col("x.n") <= F.col("y.most")) & (F.col("y.n") <= F.col("x.most"))
        across = tokens.alias("x").join(tokens.alias("y"), "token").filter((F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & fits)
        more = linked(across.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
        if not more.isEmpty():
            found = components(links.union(more))
    named = sets.select("low", "high", "rep").join(found, F.col("rep") == F.col("node"), "left").select("low", "high", F.coalesce("component", "rep").alias("component"))
    return described.select("id", "doc", "n_shingles", "low", "high").join(named, ["low", "high"], "left").select("id", "doc", "n_shingles", F.coalesce("component", "id").alias("component"))


def near_duplicates(documents: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    nodes = written(classes(_rows(documents), words), "nodes")
    first = nodes.groupBy("component").agg(F.min("doc").alias("first"))
    # rows that repeat a doc_id join the components of their texts, each one with the smallest of them
    several = nodes.groupBy("doc").agg(F.min("component").alias("l"), F.max("component").alias("h")).filter("l < h")
    joins = nodes.join(several, "doc").filter("component > l").select(F.col("component").alias("a"), F.col("l").alias("b")).distinct()
    joins = written(joins, "joins")
    if not joins.isEmpty():
        wider = components(joins).withColumnRenamed("component", "whole")
        first = first.join(wider, F.col("component") == F.col("node"), "left").select("component", "first", F.coalesce("whole", "component").alias("whole"))
        least = first.groupBy("whole").agg(F.min("first").alias("least"))
        first = first.join(least, "whole").select("component", F.col("least").alias("first"))
    out = nodes.join(first, "component")
    ids = [F.nullif(c, F.lit(_NO_ID)).alias(n) for c, n in (("doc", "doc_id"), ("first", "component_id"))]
    return out.select(ids[0], "n_shingles", ids[1], (F.col("doc") == F.col("first")).alias("kept"))


def deduplicated(documents: DataFrame, words: int = 5) -> DataFrame:
    """The documents, all their columns, without those that a row with a smaller doc_id represents.

    One row of each component stays, of the smallest doc_id (a null one is the largest); of rows with equal doc_id
    and text that is the smallest by all columns that have an order. Null texts and texts without words all stay.
    """
    nodes = written(classes(_rows(documents), words).filter("n_shingles > 0").select("id", "doc", "component"), "nodes")
    several = nodes.groupBy("component").agg(F.min(F.struct("doc", "id")).alias("first"), F.count("*").alias("m")).filter("m > 1")
    gone = nodes.join(several, "component").filter(F.col("id") != F.col("first.id")).select(F.col("id").alias("gone")).distinct()
    again = nodes.groupBy("id").count().filter("count > 1").join(several.select(F.col("first.id").alias("id")), "id", "left_semi").select(F.col("id").alias("again"))
    again = written(again, "again")
    # the document's columns travel as one value, so no name of theirs meets one of these
    named = documents.select(_node("doc_id", "text").alias("node"), F.struct(*documents.columns).alias("row"))
    kept = named.join(gone, F.col("node") == F.col("gone"), "left_anti")
    if again.isEmpty():
        return kept.select("row.*")
    order = F.struct(*[c for c in documents.columns if _has_order(documents.schema[c].dataType)])
    copies = documents.select(_node("doc_id", "text").alias("node"), F.struct(*documents.columns).alias("row"), order.alias("order"))
    copies = copies.join(again, F.col("node") == F.col("again"), "left_semi").groupBy("node").agg(F.min_by("row", "order").alias("row"))
    return kept.join(again, F.col("node") == F.col("again"), "left_anti").select("row.*").union(copies.select("row.*"))


def _has_order(kind) -> bool:
    """Whether Spark can compare values of the type; maps have no order."""
    return "map" not in kind.simpleString()


_ORACLE = r"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i:i + 1], ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM dw WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 80 * (na.n + nb.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""


@query("op7_odd_sketch_near_dedup", _ORACLE)
def op7_odd_sketch_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under links of two-word shingles."""
    return near_duplicates(table(spark, folder, "documents"), words=2)
