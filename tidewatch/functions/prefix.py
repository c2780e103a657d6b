"""Running aggregates that never put a whole key group into one task.

A plain running window sorts a whole key in one task, so a key that holds a third of the rows
decides the run time. Here each key is cut into ordered chunks: a window runs inside a chunk, and
the chunk totals (a few values per chunk) carry the running value across chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import written

CHUNK = 4096
#: rows of one range of :func:`positions`
RANGE = 1 << 20


def time_chunk(order: str, width: int = CHUNK) -> Column:
    return F.floor(F.col(order) / F.lit(width))


def magnitude_bucket(value: str, per_unit: int = 64) -> Column:
    """Monotone bucket of a double of any magnitude (log1p is semi-monotone by contract)."""
    v = F.col(value)
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * per_unit).cast("long")


def unit_bucket(value: str, buckets: int = 64) -> Column:
    return F.least(F.floor(F.col(value) * buckets), F.lit(buckets - 1)).cast("long")


def _carry(local: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    totals = local.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    return totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_chunk").alias("_k_chunk"),
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums],
        *[F.sum(f"_t_{o}").over(whole).alias(f"_n_{o}") for o in sums],
    )


def _same_chunk(keys: list[str]) -> Column:
    cond = F.col("_chunk") == F.col("_k_chunk")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return cond


def running_sums(
    df: DataFrame, keys: list[str], order: list, chunk: Column, sums: dict[str, str], whole: bool = False
) -> DataFrame:
    """Inclusive running sums ``{out: column}`` over distinct ``order``; ``<out>_all`` when ``whole``."""
    local = df.withColumn("_chunk", chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ran = local
    for out, col in sums.items():
        ran = ran.withColumn(f"_r_{out}", F.sum(col).over(w))
    joined = ran.join(_carry(local, keys, sums), _same_chunk(keys))
    for out in sums:
        joined = joined.withColumn(out, F.col(f"_r_{out}") + F.col(f"_b_{out}"))
        if whole:
            joined = joined.withColumn(f"{out}_all", F.col(f"_n_{out}"))
    return joined.select(*df.columns, *sums, *([f"{o}_all" for o in sums] if whole else []))


def row_positions(df: DataFrame, keys: list[str], order: str, width: int = CHUNK) -> DataFrame:
    """0-based chronological ``pos`` and group size ``n`` per key over an integer order column."""
    marked = df.withColumn("_one", F.lit(1).cast("long"))
    ran = running_sums(marked, keys, [order], time_chunk(order, width), {"_pos": "_one"}, whole=True)
    return ran.select(*df.columns, (F.col("_pos") - 1).alias("pos"), F.col("_pos_all").alias("n"))


def positions(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """0-based position ``name`` of each row of its key in an order of any columns, for rows that differ in it.

    Rows are cut into ranges of keys and order together, so neither a key nor one value of the first order column fills a
    task. The ranges are a written table: positions inside and counts before them refer to the same cut.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE))
    ranged = rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, f"ranges-{name}")
    counts = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_k_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_k_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inner = Window.partitionBy("_part", *keys).orderBy(*order)
    out = ranged.withColumn("_at", F.row_number().over(inner)).join(starts, same)
    return out.select(*rows.columns, (F.col("_at") - 1 + F.col("_before")).cast("long").alias(name))


def midrank_table(
    reference: DataFrame, queries: DataFrame, keys: list[str], value: str, bucket: Column
) -> DataFrame:
    """Midrank of every distinct query value within the reference of its key."""
    both = reference.select(*keys, value, F.lit(1).cast("long").alias("w")).unionByName(
        queries.select(*keys, value, F.lit(0).cast("long").alias("w"))
    )
    return weighted_midranks(both, keys, value, "w", bucket)


def weighted_midranks(rows: DataFrame, keys: list[str], value: str, weight: str, bucket: Column) -> DataFrame:
    """``(less + equal / 2 + 1 / 2) / (n + 1)`` per distinct value, counting rows by ``weight``.

    Reference rows weigh one, rows that only ask weigh zero. Rows shrink to distinct values with
    map-side combining before anything is ordered. Keys without reference rows give a null rank.
    """
    counts = rows.groupBy(*keys, value).agg(F.sum(weight).alias("_eq"))
    ran = running_sums(counts, keys, [value], bucket, {"_le": "_eq"}, whole=True)
    less = F.col("_le") - F.col("_eq")
    rank = (less + F.col("_eq") * 0.5 + 0.5) / (F.col("_le_all") + 1)
    return ran.select(*keys, value, F.when(F.col("_le_all") > 0, rank).alias("midrank"))


def previous_and_next(
    df: DataFrame, keys: list[str], order: str, width: int = CHUNK, include_next: bool = False
) -> DataFrame:
    """Previous (and next) integer ``order`` value per key, across chunk borders as well."""
    local = df.withColumn("_chunk", time_chunk(order, width))
    w = Window.partitionBy(*keys, "_chunk").orderBy(order)
    edges = local.groupBy(*keys, "_chunk").agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    edges = edges.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_chunk").alias("_k_chunk"),
        F.lag("_hi").over(across).alias("_before"),
        F.lead("_lo").over(across).alias("_after"),
    )
    out = local.withColumn("_p", F.lag(order).over(w)).withColumn("_n", F.lead(order).over(w))
    out = out.join(edges, _same_chunk(keys))
    cols = [F.coalesce("_p", "_before").alias("previous")]
    if include_next:
        cols.append(F.coalesce("_n", "_after").alias("following"))
    return out.select(*df.columns, *cols)
