"""Duplicate removal without the pairwise scan.

Every key keeps its smallest ``(timestamp, original order)`` row by an aggregate that combines
map-side, so a key with very many copies never gathers in one task.

Rows with and without an identifier in one data set (:func:`judged`): rows come in order and are compared with the rows
kept so far. Two rows with identifiers are copies if these agree; otherwise the exact key decides. Only the first row without an
identifier of each key, its *blank*, can be kept, and it is unless an earlier row of the key is. A blank that is kept blocks later rows of
its key, and an identifier keeps its first row that is not blocked. So identifiers wait for blanks and blanks for
identifiers, always for earlier rows: both are settled in rounds, over the rows that still wait, until none is left. The
rounds are as many as the longest alternating chain of identifiers and keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import written

EXACT_KEY = ("client_id", "ts_seconds", "event_type", "payload")
CONTENT = ("payload", "client_id", "event_type")


def identity_mode(events: DataFrame) -> DataFrame:
    """One row: how many rows carry a unique identifier, and whether both kinds occur."""
    return events.agg(
        F.count("uid").alias("with_uid"), F.count("*").alias("records")
    ).withColumn("mixed", (F.col("with_uid") > 0) & (F.col("with_uid") < F.col("records")))


def retain_first(events: DataFrame, by_uid: bool, key: tuple[str, ...] = EXACT_KEY) -> DataFrame:
    """First copy of each key and the number of its copies.

    ``by_uid``: all rows have an identifier, which is the key; otherwise the exact key is, whatever the identifiers.
    """
    row = F.struct(*[c for c in events.columns if c not in ("ts_seconds", "original_order")])
    at = F.struct("ts_seconds", "original_order")
    groups = [F.col(k).alias(f"_g_{k}") for k in (("uid",) if by_uid else key)]
    first = events.groupBy(*groups).agg(F.min(at).alias("_at"), F.min_by(row, at).alias("_first"), F.count("*").alias("copies"))
    columns = [F.col(f"_at.{c}" if c in ("ts_seconds", "original_order") else f"_first.{c}").alias(c) for c in events.columns]
    return first.select(*columns, "copies")


def _digest(columns: tuple[str, ...], size: int) -> Column:
    """The first bytes of the SHA-256 of several columns; nulls differ from empty texts, zeros of both signs do not.

    Keys of a whole data set take 16 bytes; 8 are enough where a row is compared with one other row.
    """
    texts = [(F.col(c) + F.lit(0.0) if c == "ts_seconds" else F.col(c)).cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, size)


def judged(events: DataFrame, key: tuple[str, ...] = EXACT_KEY) -> DataFrame:
    """``at`` (timestamp, order), ``owner`` and ``conflict`` of every row of a data set of both kinds.

    ``owner`` is the ``at`` of the kept row that the row is compared with successfully first, its own if it is kept.
    ``conflict``: that row has the same identifier but another payload, client or event type.
    Rows move once by key and once by identifier; only those behind a blank, and those without identifier, move by key again.
    """
    rows = events.select(
        F.struct("ts_seconds", "original_order").alias("at"), "uid", _digest(key, 16).alias("k"), _digest(CONTENT, 8).alias("content")
    )
    blanks = rows.filter("uid IS NULL").groupBy("k").agg(F.min("at").alias("blank"))
    rows = written(rows.join(blanks, "k", "left"), "dedup-rows")
    named = rows.filter("uid IS NOT NULL")
    behind = F.col("blank") < F.col("at")
    # rows behind a blank may be blocked, so the first one before or without a blank is the last that an identifier can keep
    free = named.groupBy("uid").agg(F.min(F.when(F.col("blank").isNull() | ~behind, F.struct("at", "k", "content"))).alias("free"))
    free = written(free, "dedup-free")
    waiting = written(
        named.filter(behind).join(free.select("uid", F.col("free.at").alias("free")), "uid").filter(F.col("free").isNull() | (F.col("at") < F.col("free"))).select("uid", "k", "content", "at"),
        "dedup-waiting",
    )
    guards = named.filter(F.col("at") < F.col("blank")).select("uid", "k", "at")
    guards = written(guards.join(waiting.select("k").distinct(), "k", "left_semi"), "dedup-guards")
    settled = free.join(waiting.select("uid").distinct(), "uid", "left_anti")
    owners = written(settled.select("uid", F.col("free.at").alias("kept"), F.col("free.k").alias("kept_k"), F.col("free.content").alias("kept_content")), "dedup-owners")
    while not waiting.isEmpty():
        known = guards.join(owners, "uid", "left").groupBy("k").agg(
            F.bool_or(F.coalesce(F.col("at") == F.col("kept"), F.lit(False))).alias("taken"), F.bool_or(F.col("kept").isNull()).alias("open")
        )
        state = F.when(F.col("taken"), "taken").when(F.col("open"), "open").otherwise("blocked")
        told = waiting.join(known, "k", "left").withColumn("state", F.when(F.col("taken").isNull(), "blocked").otherwise(state))
        step = told.groupBy("uid").agg(F.min(F.when(F.col("state") != "blocked", F.struct("at", "state", "k", "content"))).alias("next"))
        step = written(step.join(free, "uid"), "dedup-step")
        done = step.filter("next IS NULL OR next.state = 'taken'")
        # an identifier whose rows are all blocked keeps none; the empty place tells it from one that waits
        none = F.struct(F.lit(None).cast("double").alias("ts_seconds"), F.lit(None).cast("long").alias("original_order")).cast(rows.schema["at"].dataType)
        done = done.select(
            "uid", F.coalesce("next.at", "free.at", none).alias("kept"), F.coalesce("next.k", "free.k").alias("kept_k"), F.coalesce("next.content", "free.content").alias("kept_content")
        )
        owners = written(owners.unionByName(done), "dedup-owners")
        waiting = written(waiting.join(done.select("uid"), "uid", "left_anti"), "dedup-waiting")
    first = owners.filter("kept_k IS NOT NULL").groupBy(F.col("kept_k").alias("k")).agg(F.min("kept").alias("first"))
    keys = rows.filter(F.col("uid").isNull() & (F.col("at") == F.col("blank"))).select("k", "blank").join(first, "k", "left")
    keys = written(keys.select("k", "first", (F.col("first").isNull() | (F.col("blank") < F.col("first"))).alias("blank_kept")), "dedup-keys")
    stop = F.when(F.col("blank_kept"), F.col("blank"))
    blocked = named.filter(behind).join(keys, "k").select("uid", "at", "content", stop.alias("stop"))
    clear = named.filter(F.col("blank").isNull() | ~behind).select("uid", "at", "content", F.lit(None).cast(rows.schema["at"].dataType).alias("stop"))
    by_name = blocked.unionByName(clear).join(owners.drop("kept_k"), "uid")
    earlier = F.when(F.col("kept.original_order").isNotNull() & (F.col("kept") <= F.col("at")), F.col("kept"))
    by_name = by_name.withColumn("owner", F.least(earlier, "stop")).withColumn(
        "conflict", F.coalesce((F.col("owner") == F.col("kept")) & (F.col("content") != F.col("kept_content")), F.lit(False))
    )
    by_key = rows.filter("uid IS NULL").join(keys, "k").withColumn("owner", F.least(stop, "first"))
    columns = ["at", "owner", "conflict"]
    return by_name.select(*columns).unionByName(by_key.withColumn("conflict", F.lit(False)).select(*columns))


def _mixed(events: DataFrame) -> bool:
    """Whether rows with and without an identifier occur; one row comes to the driver."""
    return identity_mode(events).first()["mixed"]


def conflicting_uids(events: DataFrame) -> DataFrame:
    """Identifiers whose copies disagree on payload, client or event type."""
    return (
        events.filter(F.col("uid").isNotNull())
        .withColumn("content", _digest(CONTENT, 8))
        .groupBy("uid")
        .agg(F.min("content").alias("lo"), F.max("content").alias("hi"))
        .filter(F.col("lo") != F.col("hi"))
        .select("uid")
    )


def deduplicated(events: DataFrame, by_uid: bool) -> DataFrame:
    """Kept rows and the number of their copies; a conflict anywhere makes the data set invalid and leaves no rows.

    ``by_uid`` false takes the exact key alone. Where only some rows have an identifier, rows are judged in order.
    """
    if not by_uid:
        return retain_first(events, False)
    if not _mixed(events):
        kept = retain_first(events, events.filter("uid IS NOT NULL").limit(1).count() > 0)
        return kept.filter(conflicting_uids(events).agg(F.count("*")).scalar() == 0)
    verdicts = written(judged(events), "dedup-verdicts")
    sizes = verdicts.groupBy("owner").agg(F.count("*").alias("copies"))
    conflicts = verdicts.agg(F.count_if("conflict")).scalar()
    at = F.struct("ts_seconds", "original_order")
    return events.withColumn("owner", at).join(sizes, "owner").drop("owner").filter(conflicts == 0)


def _counted(conflicts: Column, kept: Column, duplicates: Column) -> list[Column]:
    return [
        F.when(conflicts > 0, "Invalid").otherwise("READY").alias("state"),
        F.when(conflicts > 0, F.lit(0)).otherwise(kept).cast("long").alias("retained"),
        duplicates.cast("long").alias("duplicates"),
    ]


def accounting(events: DataFrame, by_uid: bool) -> DataFrame:
    """State, retained and duplicate counts.

    For an invalid data set only the duplicates before the first conflict, in chronological order, count. Without any
    identifier the exact key decides.
    """
    mode = identity_mode(events).first() if by_uid else None
    if mode and mode["mixed"]:
        verdicts = written(judged(events).select("at", "conflict", (F.col("at") == F.col("owner")).alias("kept")), "dedup-verdicts")
        conflict = verdicts.filter("conflict").agg(F.min("at")).scalar()
        counted = verdicts.withColumn("stop", conflict)
        before = ~F.col("kept") & (F.col("stop").isNull() | (F.col("at") < F.col("stop")))
        totals = counted.agg(F.count_if("conflict").alias("conflicts"), F.count_if("kept").alias("kept"), F.count_if(before).alias("duplicates"))
        return totals.select(*_counted(F.col("conflicts"), F.col("kept"), F.col("duplicates")))
    if mode and mode["with_uid"]:
        return _accounting_by_uid(events)
    kept = events.groupBy(_digest(EXACT_KEY, 16).alias("k")).agg(F.count("*").alias("copies")).agg(F.count("*").alias("retained"), F.coalesce(F.sum("copies"), F.lit(0)).alias("records"))
    return kept.select(F.lit("READY").alias("state"), "retained", (F.col("records") - F.col("retained")).alias("duplicates"))


def _accounting_by_uid(events: DataFrame) -> DataFrame:
    """Every row has an identifier: counts come from one aggregate, and only rows of identifiers that disagree meet each other."""
    at = F.struct("ts_seconds", "original_order")
    rows = events.select(at.alias("at"), "uid", _digest(CONTENT, 8).alias("content"))
    groups = rows.groupBy("uid").agg(F.min("at").alias("first"), F.min("content").alias("lo"), F.max("content").alias("hi"))
    groups = written(groups.select("uid", "first", (F.col("lo") != F.col("hi")).alias("torn")), "dedup-groups")
    torn = rows.join(groups.filter("torn").select("uid"), "uid", "left_semi")
    firsts = torn.groupBy("uid").agg(F.min_by("content", "at").alias("first_content"))
    stop = torn.join(firsts, "uid").filter(F.col("content") != F.col("first_content")).agg(F.min("at")).first()[0]
    before = kept_before = F.lit(True)
    if stop is not None:
        edge = F.struct(*[F.lit(stop[c]).alias(c) for c in ("ts_seconds", "original_order")])
        before, kept_before = F.col("at") < edge, F.col("first") < edge
    counts = groups.agg(F.count("*").alias("kept"), F.count_if(kept_before).alias("kept_before"))
    totals = rows.agg(F.count_if(before).alias("rows_before")).crossJoin(counts)
    return totals.select(*_counted(F.lit(int(stop is not None)), F.col("kept"), F.col("rows_before") - F.col("kept_before")))
