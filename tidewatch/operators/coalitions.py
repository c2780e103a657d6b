"""Coalitions of selected clients.

The selected clients are few by construction (a target count), so an epoch of the federation is
one row with arrays in client order. Coalitions are generated from that row without any join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import spread


def coalition_count(clients: int, max_order: int) -> int:
    return sum(math.comb(clients, r) for r in range(1, max_order + 1))


def required_outside(outside: int, minimum: int, fraction: float) -> int:
    return max(minimum, math.ceil(fraction * outside))


def required_outside_column(order: Column, clients: int, max_order: int, minimum: int, fraction: float) -> Column:
    values = [F.lit(required_outside(clients - r, minimum, fraction)) for r in range(1, max_order + 1)]
    return F.element_at(F.array(*values), order)


def index_coalitions(clients: int, max_order: int) -> Column:
    """Array of sorted index arrays, singles first."""
    last = clients - 1

    def after(i: Column) -> Column:
        return F.when(i < last, F.sequence(i + 1, F.lit(last))).otherwise(F.array().cast("array<int>"))

    every = F.sequence(F.lit(0), F.lit(last))
    singles = F.transform(every, lambda i: F.array(i))
    parts = [singles]
    if max_order > 1:
        parts.append(F.flatten(F.transform(every, lambda i: F.transform(after(i), lambda j: F.array(i, j)))))
    if max_order > 2:
        parts.append(
            F.flatten(
                F.flatten(
                    F.transform(
                        every,
                        lambda i: F.transform(after(i), lambda j: F.transform(after(j), lambda k: F.array(i, j, k))),
                    )
                )
            )
        )
    return F.concat(*parts)


def enumerate_coalitions(clients: DataFrame, count: int, max_order: int) -> DataFrame:
    """All coalitions of the selected clients (``count`` of them) with complement arrays."""
    ids = clients.agg(F.array_sort(F.collect_set("client_id")).alias("ids"))
    return (
        ids.select("ids", F.explode(index_coalitions(count, max_order)).alias("idx"))
        .select("ids", F.transform("idx", lambda i: F.get("ids", i)).alias("members"))
        .select(
            F.array_join("members", "|").alias("coalition_id"),
            "members",
            F.size("members").alias("ord"),
            F.array_except("ids", "members").alias("complement"),
        )
    )


def proper_subsets(coalitions: DataFrame) -> DataFrame:
    """Coalition and each of its non-empty proper subsets (at most six for a triple)."""
    n = F.size("members")
    masks = F.array(*[F.array(*[F.lit(bool(m >> i & 1)) for i in range(3)]) for m in range(1, 8)])
    picked = F.transform(masks, lambda m: F.filter("members", lambda _x, i: F.get(m, i)))
    # a mask that reaches past the members repeats a smaller one, so keep distinct arrays
    subsets = F.filter(F.array_distinct(picked), lambda s: (F.size(s) > 0) & (F.size(s) < n))
    return coalitions.select("coalition_id", "ord", F.explode(subsets).alias("subset")).withColumn(
        "subset_order", F.size("subset")
    )


def admissible(field: Column, members: Column) -> Column:
    """A nuisance field may hold outside clients only."""
    return ~F.arrays_overlap(field, members) | (F.size(field) == 0)


def availability_dropout(clients: Column, epoch: Column, seed: int, fraction: float) -> Column:
    """Reproducible availability of a client in an epoch (hash-uniform below ``1 - fraction``)."""
    from tidewatch.functions.text import hash_uniform

    key = F.concat_ws(":", F.lit(seed), clients, epoch.cast("string"))
    return hash_uniform(key) < F.lit(1.0 - fraction)


def epoch_panel(rows: DataFrame, client_ids: list[str], keys: list[str], lag: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per key and epoch: arrays ``now`` (ranks), ``lagged`` (ranks) and ``avail``.

    ``rows`` has ``client_id, epoch, rank, available``; ``carry`` names columns that depend on the
    epoch only. A rank feeds its own epoch and the one ``lag`` later, so the lag costs no join: one
    aggregate with map-side combining makes the whole panel.
    """
    none = F.lit(None)
    own = F.struct(
        F.col("epoch").alias("e"), F.col("rank").alias("now"), none.cast("double").alias("lagged"), F.col("available").alias("up"), *carry
    )
    later = F.struct(
        (F.col("epoch") + lag).alias("e"), none.cast("double").alias("now"), F.col("rank").alias("lagged"), none.cast("boolean").alias("up"),
        *[none.alias(c) for c in carry],
    )
    fed = rows.select(*keys, "client_id", F.explode(F.array(own, later)).alias("f"))
    slot = [F.col("client_id") == c for c in client_ids]

    def gather(name: str) -> list[Column]:
        return [F.max(F.when(s, F.col(f"f.{name}"))) for s in slot]

    panel = fed.groupBy(*keys, F.col("f.e").alias("epoch")).agg(
        F.array(*gather("now")).alias("now"),
        F.array(*gather("lagged")).alias("lagged"),
        F.array(*[F.coalesce(c, F.lit(False)) for c in gather("up")]).alias("avail"),
        *[F.max(f"f.{c}").alias(c) for c in carry],
        F.count("f.up").alias("_own"),
    )
    return panel.filter(F.col("_own") > 0).drop("_own")


def active(idx: Column, avail: Column, clients: int, max_order: int, minimum: int, fraction: float) -> Column:
    """All members available and enough available clients outside."""
    members_ok = F.forall(idx, lambda i: F.get(avail, i))
    outside = F.size(F.filter(avail, lambda a: a)) - F.size(F.filter(idx, lambda i: F.get(avail, i)))
    return members_ok & (outside >= required_outside_column(F.size(idx), clients, max_order, minimum, fraction))


def coalition_epochs(panel: DataFrame, keys: list[str], client_ids: list[str], max_order: int, minimum: int, fraction: float) -> DataFrame:
    """Coalition-epoch rows from panel rows.

    A panel is small and fans out into every coalition, so its rows are spread before the explode.
    """
    panel = spread(panel, *[k for k in keys if not k.startswith("_")], "epoch")
    ids = F.array(*[F.lit(c) for c in client_ids])
    k = len(client_ids)
    return (
        panel.select(*keys, "epoch", "now", "lagged", "avail", F.explode(index_coalitions(k, max_order)).alias("idx"))
        .withColumn("ord", F.size("idx"))
        .withColumn("coalition_id", F.array_join(F.transform("idx", lambda i: F.get(ids, i)), "|"))
        .withColumn("u", F.transform("idx", lambda i: F.get("now", i)))
        .withColumn("active", active(F.col("idx"), F.col("avail"), k, max_order, minimum, fraction))
    )
