"""Campaign registry: merged malicious runs of a federation and their replay frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import prefix


def epoch_runs(labels: DataFrame, gap: int) -> DataFrame:
    """Run id of every malicious epoch (union over clients).

    Two epochs share a run when at most ``gap`` benign epochs lie between them. The work runs on
    distinct epochs, in chunks, never on one global sort.
    """
    epochs = labels.filter("malicious").select("epoch").distinct()
    linked = prefix.previous_and_next(epochs, [], "epoch")
    opens = linked.withColumn(
        "opens",
        (F.col("previous").isNull() | (F.col("epoch") - F.col("previous") - 1 > gap)).cast("long"),
    )
    return prefix.running_sums(opens, [], ["epoch"], prefix.time_chunk("epoch"), {"run_id": "opens"}).drop("opens")


def merged_runs(epoch_run: DataFrame) -> DataFrame:
    """Start, end and inclusive duration of each run, with the malicious epoch before it."""
    return (
        epoch_run.groupBy("run_id")
        .agg(
            F.min("epoch").alias("start_epoch"),
            F.max("epoch").alias("end_epoch"),
            F.min_by("previous", "epoch").alias("previous_end"),
        )
        .withColumn("duration", F.col("end_epoch") - F.col("start_epoch") + 1)
    )


def run_participants(labels: DataFrame, epoch_run: DataFrame) -> DataFrame:
    """First malicious epoch of each client in each run; an equi-join on the epoch, not a range join."""
    active = labels.filter("malicious").select("client_id", "epoch")
    return (
        active.join(epoch_run.select("epoch", "run_id"), "epoch")
        .groupBy("run_id", "client_id")
        .agg(F.min("epoch").alias("first_epoch"))
    )


def run_spread(participants: DataFrame) -> DataFrame:
    """Participants are selected clients, so the array has a small fixed bound."""
    return participants.groupBy("run_id").agg(
        F.count("*").alias("participant_count"),
        (F.max("first_epoch") - F.min("first_epoch")).alias("spread"),
        F.array_sort(F.collect_set("client_id")).alias("participants"),
    )


def judged_runs(
    runs: DataFrame, spread: DataFrame, axis: DataFrame, window: int, clients: int, duration: int, warmup: int
) -> DataFrame:
    """Every run with each campaign condition; ``axis`` is one row with ``first_epoch``."""
    clean = F.col("previous_end").isNull() | (F.col("start_epoch") - F.col("previous_end") > warmup)
    return (
        runs.join(spread, "run_id")
        .withColumn("first_epoch", axis.select("first_epoch").scalar())
        .withColumn("first_activity_distributed", F.col("spread") <= window)
        .withColumn("distributed_support", F.col("participant_count") >= clients)
        .withColumn("long_enough", F.col("duration") >= duration)
        .withColumn("warmup_clean", clean & (F.col("start_epoch") - warmup >= F.col("first_epoch")))
        .drop("first_epoch")
    )


def campaign_registry(judged: DataFrame, dataset: str) -> DataFrame:
    """Campaigns that meet every condition, keyed by (data set, start, end, participants)."""
    key = F.concat_ws("|", F.lit(dataset), F.col("start_epoch"), F.col("end_epoch"), F.array_join("participants", ","))
    return judged.filter(
        "first_activity_distributed and distributed_support and long_enough and warmup_clean"
    ).select(
        F.lit(dataset).alias("dataset"),
        "start_epoch",
        "end_epoch",
        "duration",
        "participants",
        "participant_count",
        F.sha2(key, 256).alias("checksum"),
    )


def replay_frame(campaigns: DataFrame, horizon: int, warmup: int) -> DataFrame:
    """Epochs of each campaign: positions 0..H-1 from its start, negative for the warm-up."""
    return campaigns.select(
        "checksum", "start_epoch", F.explode(F.sequence(F.lit(-warmup), F.lit(horizon - 1))).alias("c_pos")
    ).select("checksum", (F.col("start_epoch") + F.col("c_pos")).alias("epoch"), F.col("c_pos").cast("long").alias("c_pos"))


def replay(campaigns: DataFrame, rows: DataFrame, horizon: int, warmup: int) -> DataFrame:
    return rows.join(replay_frame(campaigns, horizon, warmup), "epoch")
