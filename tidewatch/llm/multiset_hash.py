"""Document fingerprints: a homomorphic multiset hash of paragraphs, in Spark expressions alone.

Each paragraph (line) is hashed to a wide vector, and the vectors of a document are added, lane by lane, modulo a
power of two. The sum does not depend on the order of paragraphs, and a paragraph is inserted or deleted by
adding or subtracting its vector (:func:`combined`). The vector has two parts:

* :data:`EQUAL` lanes of 32 bits, seeded hashes of the whole paragraph, modulo 2^32: equal multisets of paragraphs
  have equal sums, others differ but for chance. The number of paragraphs is one more lane.
* :data:`NEAR` longs of two lanes, modulo 2^62: the sums over the paragraph's pairs of neighbouring words of
  single bits of their hash, and the number of pairs. Twice a lane minus that number is a sum of random signs,
  so products of lanes estimate common pairs, and likeness is 2 <x, y> / (<x, x> + <y, y>) cut to 0..1.

A paragraph without pairs counts as one pair of its whole text. Null counts as the empty text, which is one
empty paragraph. Lanes are summed inside the row: blocks of 255 hashes add their bits as bytes of seven bytes a
long, so no pair becomes a row. Documents are put in shards by quantiles of doc_id and each shard is ordered in
one task; the next document's text and sums come from the same window, so the texts are shuffled once. The last
document of each shard is followed by the first of the next shard with documents. Rows that repeat a doc_id
follow each other in the order of their texts; null ids come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import query, shuffle_partitions, table
from tidewatch.session import written

EQUAL, NEAR = 8, 48
#: two bits of a hash that are the two lanes of a long; no text has the 2^31 pairs that would carry over
_LANE = 31
#: hashes of a block: their bits are counted in bytes, of which a signed long has seven whole ones
_BLOCK, _BYTES = 255, 0x0001010101010101
#: rows of a shard, and quantiles of doc_id before shards are cut to equal widths
SHARD_ROWS, QUANTILES = 20_000, 64
SUMS = [f"e{i}" for i in range(EQUAL)] + ["paragraphs"] + [f"n{i}" for i in range(NEAR)] + ["pairs"]


def _equal_lane(seed: int) -> Column:
    return F.expr(f"aggregate(_mh_lines, 0L, (a, x) -> a + (xxhash64({seed}, x) & 4294967295L)) & 4294967295L")


def _blocks(hashes: str) -> Column:
    """The hashes of a row in blocks, the last one shorter."""
    return F.expr(f"transform(sequence(0, cast((size({hashes}) - 1) div {_BLOCK} as int)), i -> slice({hashes}, i * {_BLOCK} + 1, {_BLOCK}))")


def _bit_counts(blocks: str) -> Column:
    """Eight longs a block: byte b of long j counts the hashes with bit 8 b + j, for bits below 56."""
    ones = (f"aggregate(b, 0L, (a, x) -> a + (shiftrightunsigned(x, {j}) & {_BYTES}L))" for j in range(8))
    return F.expr(f"transform({blocks}, b -> array({', '.join(ones)}))")


def _near_lane(counts: str, bit: int) -> Column:
    """A long of two lanes, the sums of a bit and of the bit 31 places above it."""
    low, high = (f"(shiftrightunsigned(element_at(c, {b % 8 + 1}), {8 * (b // 8)}) & 255L)" for b in (bit, bit + _LANE))
    return F.expr(f"aggregate({counts}, 0L, (a, c) -> a + {low} + shiftleft({high}, {_LANE}))")


def with_sums(rows: DataFrame, text: str, name: str) -> DataFrame:
    """The rows with a struct of the sums of a text's paragraphs; columns ``_mh_*`` are used on the way.

    Each step is a column that the next one reads many times, so the steps stay projections of their own.
    """
    keep, per = [c for c in rows.columns if c != name], NEAR // 2
    step = rows.withColumn("_mh_lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    step = step.withColumn("_mh_h0", F.flatten(F.transform(F.transform("_mh_lines", lambda line: F.split(line, " ", -1)), _pair_hashes)))
    step = step.withColumn("_mh_h1", F.transform("_mh_h0", lambda x: F.xxhash64(x)))
    step = step.withColumns({f"_mh_b{i}": _blocks(f"_mh_h{i}") for i in range(2)})
    step = step.withColumns({f"_mh_c{i}": _bit_counts(f"_mh_b{i}") for i in range(2)})
    whole = [*(_equal_lane(i).alias(f"e{i}") for i in range(EQUAL)), F.size("_mh_lines").cast("long").alias("paragraphs")]
    near = [*(_near_lane(f"_mh_c{i // per}", i % per).alias(f"n{i}") for i in range(NEAR)), F.size("_mh_h0").cast("long").alias("pairs")]
    return step.select(*keep, F.struct(*whole, *near).alias(name))


def fingerprints(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """The sums of each row's paragraphs next to its key."""
    return with_sums(rows.select(*key, F.col(text).alias("_mh_text")), "_mh_text", "_mh_sums").select(*key, "_mh_sums.*")


def _pair_hashes(words: Column) -> Column:
    n = F.size(words) - 1
    neighbours = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    return F.when(n > 0, neighbours).otherwise(F.transform(words, lambda w: F.xxhash64(w)))


def combined(a: dict, b: dict, sign: int = 1) -> dict:
    """Sums of the union of two multisets, or (sign -1) of their difference."""
    return {k: (a[k] + sign * b[k]) % (2**32 if k[0] == "e" else 2**62) for k in SUMS}


def as_text(sums: str) -> Column:
    """A struct of sums as fixed-width hexadecimal text."""
    return F.expr(f"concat({', '.join(f"lpad(lower(hex({sums}.{c})), {8 if c[0] == 'e' else 16}, '0')" for c in SUMS)})")


def _signs(sums: str) -> Column:
    """Sums of random signs, one entry per lane of a struct of sums."""
    lanes = (f"shiftrightunsigned({sums}.n{i}, {_LANE * j}) & {2**_LANE - 1}L" for i in range(NEAR) for j in range(2))
    return F.expr(f"transform(array({', '.join(lanes)}), v -> cast(2 * v - {sums}.pairs as double))")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def likeness(a: str, b: str) -> Column:
    """Likeness of two columns of signs."""
    both = _dot(a, a) + _dot(b, b)
    return F.when(both > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * _dot(a, b) / both))).otherwise(F.lit(1.0))


def _sharded(rows: DataFrame) -> tuple[DataFrame, int]:
    """A shard number that does not decrease with doc_id, from quantiles and equal widths between them."""
    spark = rows.sparkSession
    n = rows.select(F.count("*")).first()[0]
    shards = max(2 * shuffle_partitions(spark), -(-n // SHARD_ROWS))
    coarse = min(QUANTILES, shards)
    fine = -(-shards // coarse)
    edges = sorted({int(x) for x in rows.approxQuantile("doc_id", [i / coarse for i in range(coarse + 1)], 0.001)})
    if not edges:  # no id at all
        return rows.withColumn("shard", F.lit(0)), 1
    bounds = F.array(*(F.lit(e) for e in edges))
    at = F.greatest(F.size(F.filter(bounds, lambda e: e <= F.col("doc_id"))), F.lit(1))
    low, high = F.element_at(bounds, at), F.element_at(bounds, F.least(at + 1, F.lit(len(edges))))
    inner = F.least(F.lit(fine - 1), F.greatest(F.lit(0), F.floor((F.col("doc_id") - low) * fine / F.greatest(high - low, F.lit(1)))))
    shard = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(at * fine + inner)
    return rows.withColumn("shard", shard.cast("int")), (len(edges) + 1) * fine


def followed(documents: DataFrame) -> DataFrame:
    """doc_id, text, its sums x, and the next document's text and sums; the first document follows the last."""
    rows, shards = _sharded(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    # the first document of each shard, found by ids and then read; their number is bounded like partitions
    least = rows.groupBy("shard").agg(F.min(F.col("doc_id").isNotNull()).alias("known"), F.min("doc_id").alias("least"))
    # written, so that its size is known and the texts that it picks from need no shuffle
    least = written(least.select("shard", F.when(F.col("known"), F.col("least")).alias("doc_id")), "shard-least")
    numbers = sorted(r["shard"] for r in least.select("shard").collect())
    heads = rows.join(least.withColumnsRenamed({"shard": "s", "doc_id": "d"}), (F.col("shard") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    heads = heads.groupBy("shard").agg(F.min("text").alias("first_text"))
    after = documents.sparkSession.createDataFrame([(s, numbers[(i + 1) % len(numbers)]) for i, s in enumerate(numbers)], "before int, shard int")
    heads = written(with_sums(heads.join(after, "shard").select("before", "first_text"), "first_text", "first_x"), "shard-firsts")
    order = Window.partitionBy("shard").orderBy("doc_id", "text")
    inner = with_sums(rows.repartition(shards, "shard"), "text", "x")
    inner = inner.select("doc_id", "text", "x", "shard", F.lead("text").over(order).alias("next_text"), F.lead("x").over(order).alias("next_x"))
    out = inner.join(heads, (F.col("shard") == F.col("before")) & F.col("next_text").isNull(), "left")
    return out.select("doc_id", "text", "x", F.coalesce("next_text", "first_text").alias("next_text"), F.coalesce("next_x", "first_x").alias("next_x"))


def compared(documents: DataFrame) -> DataFrame:
    """Fingerprints of each document and its edited text, and their likeness."""
    rows = followed(documents).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_sums(rows.select("doc_id", "n_chars", "x", "next_x", edited.alias("edited")), "edited", "y")
    signs = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "x", "y", _signs("x").alias("s"), _signs("y").alias("s_edited"), _signs("next_x").alias("s_next"))
    prints = [as_text(x).alias(name) for x, name in (("x", "fingerprint"), ("y", "edited_fingerprint"))]
    return signs.select("doc_id", "n_chars", "edited_sha256", *prints, likeness("s", "s_edited").alias("near_edited"), likeness("s", "s_next").alias("near_next"))


@query("op4_homomorphic_multiset_hash")
def op4_homomorphic_multiset_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints and likeness of every document of the table."""
    return compared(table(spark, folder, "documents"))
