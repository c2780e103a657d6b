"""Exact quantiles per key by selection, without a buffer of a key's values.

A key of few values is one exact percentile. For the others the wanted ranks are searched: a sketch of bounded size gives a grid of
marks and with it two marks between which each rank must lie; one pass counts what lies below and at them and keeps only what lies
between, which is a few cells of the grid. A rank that falls on a mark is found, whatever the number of its copies, so a
frequent value is never carried on. A round leaves a small fixed share of the rows of a target, so rows of 10^10
values need four rounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import written

#: values of a key or of a target that are put in order at once, cells of the grid, accuracy of the sketch (rank error n / accuracy)
LIMIT, GRID, ACCURACY = 1 << 16, 64, 4096


def _marks(value: str) -> Column:
    return F.percentile_approx(value, F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]), F.lit(ACCURACY))


def _mark(at: Column) -> Column:
    return F.element_at("marks", F.least(F.greatest(at, F.lit(0)), F.lit(GRID)).cast("int") + 1)


def _same(keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return cond


def _renamed(df: DataFrame, keys: list[str], *others) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *others)


def _narrowed(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round: what is found, and the rows that are left. ``wanted`` has ``rank`` (0-based among ``rows`` of a key) and ``name``."""
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("n"), _marks("value").alias("marks"), F.min("value").alias("least"), F.max("value").alias("most"))
    cell = F.floor(F.col("rank") * GRID / F.col("n"))
    ends = wanted.join(_renamed(sketch, keys, "n", "marks", "least", "most"), _same(keys)).select(
        *keys, "name", "rank", F.when(cell < 2, F.col("least")).otherwise(_mark(cell - 1)).alias("lo"), F.when(cell > GRID - 4, F.col("most")).otherwise(_mark(cell + 2)).alias("hi")
    )
    ends = written(ends, "quantile-ends")
    targets = ends.groupBy(*keys).agg(F.collect_list(F.struct("name", "rank", "lo", "hi")).alias("targets"))
    each = rows.join(_renamed(targets, keys, "targets"), _same(keys)).select(*keys, "value", F.explode("targets").alias("t"))
    v, lo, hi = F.col("value"), F.col("t.lo"), F.col("t.hi")
    counts = each.groupBy(*keys, F.col("t.name").alias("name")).agg(
        F.count_if(v < lo).alias("below"), F.count_if(v == lo).alias("at_lo"), F.count_if((v > lo) & (v < hi)).alias("between")
    )
    found = ends.join(_renamed(counts, [*keys, "name"], "below", "at_lo", "between"), _same([*keys, "name"]))
    inside = F.col("rank") - F.col("below") - F.col("at_lo")
    answer = F.when(inside < 0, F.col("lo")).when(inside >= F.col("between"), F.col("hi"))
    judged = written(found.select(*keys, "name", answer.alias("answer"), inside.alias("rank"), "between", "lo", "hi"), "quantile-round")
    open_ = judged.filter("answer IS NULL").groupBy(*keys).agg(F.collect_list(F.struct("name", "lo", "hi")).alias("targets"))
    left = rows.join(_renamed(open_, keys, "targets"), _same(keys)).select(
        *keys, "value", F.explode(F.expr("filter(targets, t -> value > t.lo AND value < t.hi)")).alias("t")
    )
    return judged, left.select(*keys, F.col("t.name").alias("name"), "value")


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, probabilities: tuple[float, ...], limit: int = LIMIT) -> DataFrame:
    """(keys, q): linearly interpolated quantiles of the non-null values of each key, as one array.

    ``rows`` is read two or three times, so pass a written table where it is dear. Keys without values are left out.
    """
    if not keys:
        return exact_quantiles(rows.withColumn("_all", F.lit(0)), ["_all"], value, probabilities, limit).drop("_all")
    base = rows.select(*keys, F.col(value).cast("double").alias("value")).filter("value IS NOT NULL")
    sizes = written(base.groupBy(*keys).agg(F.count("*").alias("n")), "quantile-sizes")
    few = base.join(_renamed(sizes.filter(F.col("n") <= limit), keys), _same(keys), "left_semi")
    small = few.groupBy(*keys).agg(F.percentile("value", F.array(*[F.lit(p) for p in probabilities])).alias("q"))
    large = sizes.filter(F.col("n") > limit)
    if large.isEmpty():
        return small
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    ranks = [f(place(p)).cast("long") for p in probabilities for f in (F.floor, F.ceil)]
    wanted = large.select(*keys, F.posexplode(F.array(*ranks)).alias("name", "rank"))
    wanted = written(wanted, "quantile-wanted")
    left = written(base.join(_renamed(large, keys), _same(keys), "left_semi"), "quantile-rows")
    by, answers = list(keys), None
    while True:
        if by == keys:
            judged, rest = _narrowed(left, wanted, keys)
        else:  # from the second round on every target has rows of its own
            judged, rest = _narrowed(left, wanted.withColumn("_target", F.col("name")), by)
            judged = judged.drop("_target")
            rest = rest.drop("_target")
        done = judged.filter("answer IS NOT NULL").select(*keys, "name", "answer")
        answers = done if answers is None else answers.unionByName(done)
        wanted = judged.filter("answer IS NULL").select(*keys, "name", "rank", "between")
        if wanted.isEmpty():
            break
        rest = written(rest, "quantile-rows")
        short = wanted.filter(F.col("between") <= limit)
        order = Window.partitionBy(*keys, "name").orderBy("value")
        target = [*keys, "name"]
        listed = rest.join(_renamed(short, target, F.col("rank").alias("_rank")), _same(target)).drop(*[f"_k_{k}" for k in target])
        hit = listed.withColumn("_at", F.row_number().over(order) - 1).filter(F.col("_at") == F.col("_rank"))
        answers = answers.unionByName(hit.select(*keys, "name", F.col("value").alias("answer")))
        wanted = written(wanted.filter(F.col("between") > limit).select(*keys, "name", "rank"), "quantile-wanted")
        if wanted.isEmpty():
            break
        left = rest.join(_renamed(wanted, target), _same(target), "left_semi").withColumn("_target", F.col("name")).drop("name")
        by = [*keys, "_target"]
    packed = answers.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("name", "answer"))).alias("a"))
    joined = large.join(_renamed(packed, keys, "a"), _same(keys))

    def lerp(i: int, p: float) -> Column:
        low, high = F.floor(place(p)), F.ceil(place(p))
        a, b = F.col("a")[2 * i]["answer"], F.col("a")[2 * i + 1]["answer"]
        return F.when(low == high, a).otherwise((high - place(p)) * a + (place(p) - low) * b)

    return small.unionByName(joined.select(*keys, F.array(*[lerp(i, p) for i, p in enumerate(probabilities)]).alias("q")))


def rounds_needed(n: int, limit: int = LIMIT) -> int:
    """Rounds for a key of n values without ties: a round leaves at most five cells of the grid."""
    return max(0, math.ceil(math.log(n / limit) / math.log(GRID / 5)))
