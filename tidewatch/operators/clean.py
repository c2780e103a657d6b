"""Record exclusion, ground truth and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import params as P
from tidewatch.functions import text, timing


def _integer(col: Column) -> Column:
    trimmed = text.strip(col)
    return F.when(trimmed.rlike(r"^[+-]?[0-9]+$"), trimmed.try_cast("int"))


def _reason(identity: Column, seconds: Column, label: Column, kind: Column) -> Column:
    return (
        F.when(~identity, F.lit("unusable_host_identity"))
        .when(seconds.isNull(), F.lit("unparseable_timestamp"))
        .when(label.isNull() | kind.isNull() | (kind == ""), F.lit("structurally_invalid_event"))
    )


def judge_flows(raw: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Every raw flow record with its first failing ``reason`` (null when it is kept)."""
    seconds = timing.number_seconds(F.col("ts"))
    label = _integer(F.col("label"))
    kind = text.strip(F.col("type"))
    return raw.select(
        *[c for c in raw.columns if c not in P.FLOW_REQUIRED],
        seconds.alias("ts_seconds"),
        text.client_id(F.col("src_ip"), ascii_only).alias("client_id"),
        text.token(F.col("proto"), P.MISSING_PROTOCOL, ascii_only).alias("proto"),
        text.token(F.col("service"), P.MISSING_SERVICE, ascii_only).alias("service"),
        label.alias("binary_label"),
        kind.alias("attack_type"),
        _reason(text.identity_usable(F.col("src_ip"), True), seconds, label, kind).alias("reason"),
    )


def judge_packets(raw: DataFrame) -> DataFrame:
    """Packet records: timestamps may be ISO text with an offset, identity is only trimmed."""
    seconds = timing.timestamp_seconds(F.col("`frame.time`"))
    label = _integer(F.col("Attack_label"))
    kind = text.strip(F.col("Attack_type"))
    host = F.col("`ip.src_host`")
    protocol = text.protocol_group(raw.columns)
    dotted = [c for c in raw.columns if "." in c]
    return raw.select(
        *[c for c in raw.columns if c not in P.PACKET_REQUIRED and c not in dotted],
        seconds.alias("ts_seconds"),
        text.strip(host).alias("client_id"),
        protocol.alias("protocol_group"),
        label.alias("binary_label"),
        kind.alias("attack_type"),
        _reason(text.identity_usable(host, False), seconds, label, kind).alias("reason"),
    )


def kept(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reason").isNull()).drop("reason")


def rejected(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reason").isNotNull())


def flow_events(records: DataFrame) -> DataFrame:
    return records.withColumn("event_type", F.concat_ws("::", "proto", "service"))


def packet_events(records: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Event type per packet; ``counted`` is false for unknown protocols, the record stays."""
    return records.withColumn(
        "event_type", text.protocol_event_type(F.col("protocol_group"), ascii_only)
    ).withColumn("counted", text.counts_in_epoch(F.col("protocol_group")))


def ground_truth(records: DataFrame, lower_type: bool = True) -> DataFrame:
    """Class, type and ambiguity from the binary label and the type, which must agree."""
    stripped = text.strip(F.col("attack_type"))
    normal = F.lower(stripped) == "normal"
    kind = F.lower(stripped) if lower_type else stripped
    cls = (
        F.when((F.col("binary_label") == 0) & normal, "benign")
        .when((F.col("binary_label") == 1) & ~normal, "malicious")
        .otherwise("ambiguous")
    )
    return records.withColumn("gt_class", cls).withColumn("gt_type", kind).withColumn(
        "is_ambiguous", F.col("gt_class") == "ambiguous"
    )


def benign(labelled: DataFrame) -> DataFrame:
    return labelled.filter(F.col("gt_class") == "benign")


def evaluation(labelled: DataFrame) -> DataFrame:
    """Everything that is not plainly benign, ambiguous records included."""
    return labelled.filter(F.col("gt_class") != "benign")


def discrepancies(labelled: DataFrame) -> DataFrame:
    return labelled.filter(F.col("is_ambiguous"))


def attack_type_profile(labelled: DataFrame, expected: tuple[str, ...], lower_type: bool = True) -> DataFrame:
    """Record counts per type and whether the type is a documented one."""
    stripped = text.strip(F.col("attack_type"))
    name = F.lower(stripped) if lower_type else stripped
    return (
        labelled.groupBy(name.alias("attack_type"))
        .agg(F.count("*").alias("records"))
        .withColumn("expected", F.col("attack_type").isin(*expected))
    )


def extension_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c.strip().startswith(P.FLOW_EXTENSION_PREFIXES)]


def epoch_labels(labelled: DataFrame, epoch_seconds: int) -> DataFrame:
    """A client epoch is malicious when it holds at least one explicit malicious record."""
    return (
        labelled.withColumn("epoch", timing.epoch_index(F.col("ts_seconds"), epoch_seconds))
        .groupBy("client_id", "epoch")
        .agg(F.max(F.col("gt_class") == "malicious").alias("malicious"), F.count("*").alias("records"))
    )
