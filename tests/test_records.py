"""Cleaning, duplicates, selection and sources on small fixed inputs."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tidewatch import params as P
from tidewatch.functions import text, timing
from tidewatch.operators import clean, clients, dedup
from tidewatch.sources import flows

FLOWS = "ts,src_ip,proto,service,label,type\n"


def _write(path, body: str, bom: bool = False) -> str:
    path.write_text(("﻿" if bom else "") + body, encoding="utf-8")
    return str(path)


def test_flow_csv_reasons_and_bom(spark, tmp_path):
    """Two usable lines among three without a host, two without a time and one with a label that is no number."""
    lines = [
        "1500.25,cam-7,udp,ntp,0,normal", " ,cam-8,udp,ntp,0,normal", "noon,cam-9,udp,ntp,0,normal", "1501, - ,udp,ntp,0,normal",
        "1502,   ,udp,ntp,0,normal", "1503,,udp,ntp,1,dos", "1504,cam-7,udp,ntp,yes,normal", "1e3,cam-7,icmp,-,1,dos",
    ]
    path = _write(tmp_path / "flows.csv", FLOWS + "\n".join(lines) + "\n", bom=True)
    judged = clean.judge_flows(flows.scan_flow_csv(spark, path))
    reasons = {r["reason"]: r["n"] for r in judged.groupBy("reason").agg(F.count("*").alias("n")).collect()}
    assert reasons == {None: 2, "unparseable_timestamp": 2, "unusable_host_identity": 3, "structurally_invalid_event": 1}
    assert clean.kept(judged).count() == 2 and clean.rejected(judged).count() == 6


def test_first_failing_check_names_the_reason(spark, tmp_path):
    """Host before time, time before label and type, whatever else is wrong with the line."""
    cases = {
        "x,,udp,ntp,x,": "unusable_host_identity", "1,-,udp,ntp,0,normal": "unusable_host_identity", "x,cam,udp,ntp,x,normal": "unparseable_timestamp",
        "7,cam,udp,ntp,0,": "structurally_invalid_event", "8,cam,udp,ntp,1.5,dos": "structurally_invalid_event",
    }
    for i, (line, reason) in enumerate(cases.items()):
        judged = clean.judge_flows(flows.scan_flow_csv(spark, _write(tmp_path / f"{i}.csv", f"{FLOWS}{line}\n")))
        assert [r["reason"] for r in judged.collect()] == [reason]


def test_missing_column_fails_and_schema_state(spark, tmp_path):
    path = _write(tmp_path / "a.csv", "ts,src_ip\n1,a\n")
    with pytest.raises(ValueError, match="proto"):
        flows.scan_flow_csv(spark, path)
    state = flows.schema_state(spark.read.csv(path, header=True), P.FLOW_REQUIRED).first()
    assert state["state"] == "Invalid" and state["missing_columns"] == "proto,service,label,type"
    with pytest.raises(ValueError, match="missing from the observed schema"):
        flows.map_columns(spark.read.csv(path, header=True), {"x": "nope"})


def test_packet_csv(spark, tmp_path):
    """Epoch seconds and zoned ISO times count; local times, words and empty hosts do not."""
    header = "frame.time,ip.src_host,Attack_label,Attack_type,udp.port,tcp.flags\n"
    lines = ["86400.5,plc-1,0,Normal,53,0", "yesterday,plc-2,0,Normal,53,0", "86401,,0,Normal,53,0", "1970-01-02T00:00:02,plc-3,0,Normal,53,0", "1970-01-02T01:00:03+01:00,plc-4,1,Uploading,0,0.0"]
    judged = clean.judge_packets(flows.scan_packet_csv(spark, _write(tmp_path / "p.csv", header + "\n".join(lines) + "\n")))
    kept = {r["client_id"]: r for r in clean.packet_events(clean.kept(judged)).collect()}
    assert set(kept) == {"plc-1", "plc-4"}
    first, zoned = kept["plc-1"], kept["plc-4"]
    assert first["ts_seconds"] == 86400.5 and first["event_type"] == "PROTOCOL::UDP" and first["counted"]
    assert zoned["ts_seconds"] == 86403.0 and zoned["event_type"] == "PROTOCOL::UNKNOWN_PROTOCOL" and not zoned["counted"]


def test_numbers_java_would_accept_are_rejected(spark):
    rows = spark.createDataFrame([("1d",), ("0x1p3",), ("nan",), ("inf",), (" 1.5e2 ",), ("1_0",)], "t string")
    got = [r[0] for r in rows.select(timing.number_seconds(F.col("t"))).collect()]
    assert got == [None, None, None, None, 150.0, None]


def test_tokens_unicode_and_buckets(spark):
    rows = spark.createDataFrame([(None,), (" - ",), (" http\t",), (" ｈｔｔｐ",), ("straße",)], "t string")
    got = [r[0] for r in rows.select(text.token(F.col("t"), "MISSING")).collect()]
    assert got == ["MISSING", "MISSING", "HTTP", "HTTP", "STRASSE"]
    names = ["UNKNOWN_PROTO::UNKNOWN_SERVICE", "PROTOCOL::TCP"]
    frame = spark.createDataFrame([(n,) for n in names], "t string")
    want = [int.from_bytes(hashlib.sha256(n.encode()).digest()[:8], "big") % 64 for n in names]
    assert [r[0] for r in frame.select(text.hash_bucket(F.col("t"), 64)).collect()] == want == [53, 2]


def test_dominant_protocol_order(spark):
    row = spark.createDataFrame([("0", "2", "0.0")], "`arp.opcode` string, `tcp.flags` string, `udp.port` string")
    assert row.select(text.protocol_group(row.columns)).first()[0] == "tcp"


def test_ingest_to_selection(spark, tmp_path):
    """Three sensors over five half-minutes: ``s-a`` has benign records in three of them, ``s-b`` in two, ``s-c`` in one."""
    header = "ts,src_ip,proto,service,label,type,ssl_version,dst_port\n"
    lines = [
        "0,s-a,udp,dns,0,normal,-,53", "31,s-a,udp,dns,0,normal,-,53", "149,s-a,tcp,ssl,0,normal,v3,443", "2,s-b,tcp,-,0,normal,-,1", "3,s-b,tcp,-,0,normal,-,1",
        "95,s-b,tcp,ssl,0,normal,v3,443", "96,s-b,tcp,ssl,1,scanning,v3,443", "40,s-c,udp,dns,0,normal,-,53", "41,s-c,udp,dns,1,normal,-,53", "42,s-c,udp,dns,0,mitm,-,53",
    ]
    raw = flows.scan_flow_csv(spark, _write(tmp_path / "a.csv", header + "\n".join(lines) + "\n"))
    assert clean.extension_columns(raw.columns) == ["ssl_version"]
    labelled = clean.ground_truth(clean.flow_events(clean.kept(clean.judge_flows(raw))))
    assert clean.benign(labelled).count() == 7 and clean.discrepancies(labelled).count() == 2 and clean.evaluation(labelled).count() == 3
    tally = clients.benign_tally(clean.benign(labelled), 30)
    assert {(r["client_id"], r["benign_records"], r["benign_epochs"]) for r in tally.collect()} == {("s-a", 3, 3), ("s-b", 3, 2), ("s-c", 1, 1)}
    judged = clients.eligibility(tally, 3, 2)
    assert {r[0] for r in clients.select_strict(judged, 2).collect()} == {"s-a", "s-b"}
    assert clients.select_strict(judged, 3).count() == 0
    assert clients.selection_state(judged, 3).first()["claim_state"] == "NOT_TESTED"
    assert clients.select_flexible(judged, 3, 2).count() == 2 and clients.select_flexible(judged, 3, 3).count() == 0
    hot = clean.epoch_labels(labelled, 30).filter("malicious").collect()
    assert [(r["client_id"], r["epoch"]) for r in hot] == [("s-b", 3)]


def test_client_ranking_and_families(spark):
    rows = spark.createDataFrame([(".2", 3, 3), (".1", 2, 2), (".3", 2, 2), (".4", 1, 1)], "client_id string, benign_records long, benign_epochs long")
    top = clients.select_strict(clients.eligibility(rows, 2, 2), 3)
    assert [r[0] for r in top.orderBy(F.desc("benign_records"), "client_id").collect()] == [".2", ".1", ".3"]
    families = {r["client_id"]: r["family"] for r in clients.detector_families(top).collect()}
    assert families == {".1": "Isolation Forest", ".2": "One-Class SVM", ".3": "Autoencoder"}


EVENT = "original_order long, uid string, client_id string, ts_seconds double, event_type string, payload string"


def test_dedup_keeps_first_and_counts(spark):
    """Two of five rows repeat the key of an earlier place, in whatever order the rows come."""
    rows = [(40, None, "w", 7.5, "ping", "1"), (12, None, "w", 7.5, "ping", "1"), (30, None, "w", 7.5, "ping", "2"), (3, None, "w", 8.0, "ping", "1"), (2, None, "v", 7.5, "ping", "1"), (41, None, "w", 7.5, "ping", "1")]
    events = spark.createDataFrame(rows, EVENT)
    kept = {r["original_order"]: r["copies"] for r in dedup.deduplicated(events, by_uid=False).collect()}
    assert kept == {12: 3, 30: 1, 3: 1, 2: 1}
    assert tuple(dedup.accounting(events, by_uid=False).first()) == ("READY", 4, 2)


def test_dedup_conflict_is_invalid(spark):
    rows = spark.createDataFrame([(0, "u", "a", 1.0, "t", "left"), (1, "u", "a", 2.0, "t", "right"), (2, "v", "a", 3.0, "t", "x")], EVENT)
    assert dedup.deduplicated(rows, by_uid=True).count() == 0
    state = dedup.accounting(rows, by_uid=True).first()
    assert (state["state"], state["retained"], state["duplicates"]) == ("Invalid", 0, 0)
    mixed = rows.withColumn("uid", F.when(F.col("original_order") < 2, F.col("uid")))
    assert dedup.identity_mode(mixed).first()["mixed"]


def test_hot_duplicate_key(spark):
    rows = spark.range(5000).select(
        F.col("id").alias("original_order"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("uid"),
        F.lit("a").alias("client_id"), (5000 - F.col("id")).cast("double").alias("ts_seconds"), F.lit("t").alias("event_type"), F.lit("p").alias("payload"),
    )
    kept = dedup.deduplicated(rows, by_uid=True)
    assert kept.count() == 5000 - 1667 + 1
    assert kept.filter("uid = 'hot'").first()["original_order"] == 4998


def test_file_inventory(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a b.bin").write_bytes(b"abc" * 1000)
    (tmp_path / "c.bin").write_bytes(b"")
    got = {r["path"].rsplit("/", 1)[1]: (r["sha256"], r["bytes"]) for r in flows.file_inventory(spark, str(tmp_path)).collect()}
    assert got["a b.bin"] == (hashlib.sha256(b"abc" * 1000).hexdigest(), 3000)
    assert got["c.bin"] == (hashlib.sha256(b"").hexdigest(), 0)
