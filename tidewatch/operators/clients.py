"""Client eligibility, selection and detector assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import params as P
from tidewatch.functions import timing


def benign_tally(benign: DataFrame, epoch_seconds: int) -> DataFrame:
    """Benign records and distinct non-empty epochs per client.

    Counting per (client, epoch) first keeps a busy client spread over its epochs.
    """
    per_epoch = (
        benign.withColumn("epoch", timing.epoch_index(F.col("ts_seconds"), epoch_seconds))
        .groupBy("client_id", "epoch")
        .agg(F.count("*").alias("n"))
    )
    return per_epoch.groupBy("client_id").agg(
        F.sum("n").alias("benign_records"), F.count("*").alias("benign_epochs")
    )


def eligibility(tally: DataFrame, minimum_records: int, minimum_epochs: int) -> DataFrame:
    return tally.withColumn(
        "eligible", (F.col("benign_records") >= minimum_records) & (F.col("benign_epochs") >= minimum_epochs)
    )


def _top(judged: DataFrame, target: int, minimum: int) -> DataFrame:
    eligible = judged.filter("eligible")
    # top-k with ties settled by the id; only ``target`` rows leave each task
    top = eligible.orderBy(F.col("benign_records").desc(), F.col("client_id")).limit(target)
    return top.withColumn("eligible_clients", eligible.agg(F.count("*")).scalar()).filter(
        F.col("eligible_clients") >= minimum
    )


def select_strict(judged: DataFrame, target: int) -> DataFrame:
    """Exactly ``target`` clients or none (claim state NOT_TESTED)."""
    return _top(judged, target, target)


def select_flexible(judged: DataFrame, target: int, minimum: int) -> DataFrame:
    """None below ``minimum``, all up to ``target``, otherwise the ``target`` busiest."""
    return _top(judged, target, minimum)


def selection_state(judged: DataFrame, required: int) -> DataFrame:
    return judged.agg(
        F.count("*").alias("clients"), F.count_if("eligible").alias("eligible_clients")
    ).withColumn("claim_state", F.when(F.col("eligible_clients") < required, "NOT_TESTED").otherwise("SUPPORTED"))


def detector_families(selected: DataFrame) -> DataFrame:
    """Lexicographic index modulo three; runs over the selected clients only."""
    index = F.row_number().over(Window.orderBy("client_id")) - 1
    names = F.array(*[F.lit(f) for f in P.DETECTOR_FAMILIES])
    return selected.select("client_id", index.alias("client_index")).withColumn(
        "family", F.element_at(names, (F.col("client_index") % 3 + 1).cast("int"))
    )
