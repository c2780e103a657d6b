"""Registered queries: one or more per operator, each over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import params as P
from tidewatch.functions import arrays, basis, binomial, prefix, text, timing
from tidewatch.operators import (
    campaigns, clean, clients, coalitions, comparators, contexts, dedup, detectors, evidence, features, metrics,
    partitions, perturb, policy, projection, sequential, statistics,
)
from tidewatch.params import PARTITIONS, WorkloadParams
from tidewatch.plans.oracle import LLOYD_STEP, bisected, chain
from tidewatch.plans.workload import Workload
from tidewatch.session import fresh_path
from tidewatch.sources import flows
from tidewatch.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
D = WorkloadParams()
DETECTOR, NUISANCE, CALIBRATION, HELDOUT = PARTITIONS


def query(sql: str | None = None, upto: str | None = None):
    """Register a query under its function name, with its SQL where SQL can express it."""

    def register(build: Callable[[Workload], DataFrame]) -> Callable[[Workload], DataFrame]:
        name = build.__name__
        QUERIES[name] = lambda spark, folder: build(Workload(spark, folder))
        if sql is not None:
            SQL[name] = chain(upto, sql) if upto else sql
        return build

    return register


def r6(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), 6)


def n64(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("long")


# -- sources and sinks --------------------------------------------------------------------------


@query(
    "SELECT original_order, client_id, round(ts_seconds, 6) AS ts_seconds, event_type, CAST(binary_label AS BIGINT) AS binary_label, attack_type, gt_class FROM labelled",
    "labelled",
)
def source_event_table(w: Workload) -> DataFrame:
    return w.labelled().select(
        "original_order", "client_id", r6("ts_seconds").alias("ts_seconds"), "event_type",
        n64("binary_label").alias("binary_label"), "attack_type", "gt_class",
    )


_RAW_FLOWS = """
WITH raw AS (SELECT event_id AS i, event_id AS original_order,
  CASE WHEN event_id % 97 = 0 THEN 'not-a-ts' WHEN event_id % 101 = 0 THEN 'nan' ELSE 'ok' END AS ts, epoch_us(ts) / 1e6 AS seconds,
  CASE WHEN event_id % 89 = 0 THEN '-' WHEN event_id % 83 = 0 THEN '' ELSE '10.0.0.' || (user_id % 12) END AS host,
  CASE WHEN event_id % 7 = 0 THEN 'UNKNOWN_PROTO' ELSE upper(event_type) END AS proto,
  CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN 'UNKNOWN_SERVICE' ELSE upper(substr(event_type, 1, 4)) END AS service,
  CASE WHEN event_id % 79 = 0 THEN NULL WHEN value >= 200 THEN 1 ELSE 0 END AS label,
  CASE WHEN event_id % 73 = 0 THEN '' WHEN value >= 200 AND event_id % 3 <> 0 THEN 'D' || event_type ELSE 'Normal' END AS kind
  FROM events),
judged AS (SELECT *, CASE WHEN host IN ('', '-') THEN 'unusable_host_identity' WHEN ts <> 'ok' THEN 'unparseable_timestamp'
  WHEN label IS NULL OR kind = '' THEN 'structurally_invalid_event' END AS reason FROM raw),
kept AS (SELECT *, CASE WHEN label = 0 AND lower(kind) = 'normal' THEN 'benign' WHEN label = 1 AND lower(kind) <> 'normal' THEN 'malicious'
  ELSE 'ambiguous' END AS gt_class, lower(kind) AS gt_type FROM judged WHERE reason IS NULL)
"""


@query(
    _RAW_FLOWS + "SELECT host AS client_id, coalesce(reason, 'kept') AS outcome, count(*) AS records, "
    "round(sum(CASE WHEN reason IS NULL THEN seconds - 1704067200 ELSE 0 END), 3) AS seconds FROM judged GROUP BY ALL"
)
def source_flow_csv(w: Workload) -> DataFrame:
    """Write the raw records as CSV, scan them back and judge them."""
    path = fresh_path(w.spark, "flow-csv")
    flows.write_csv(w.raw_flows(), path)
    judged = clean.judge_flows(flows.scan_flow_csv(w.spark, path), ascii_only=True)
    kept = F.when(F.col("reason").isNull(), F.col("ts_seconds") - 1704067200).otherwise(0.0)
    return judged.groupBy(F.coalesce("client_id", F.lit("")).alias("client_id"), F.coalesce("reason", F.lit("kept")).alias("outcome")).agg(
        F.count("*").alias("records"), F.round(F.sum(kept), 3).alias("seconds")
    )


_RAW_PACKETS = """
WITH raw AS (SELECT event_id AS original_order, CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 3 = 0 THEN epoch_us(ts) / 1e6 - 7200 ELSE epoch_us(ts) / 1e6 END AS seconds,
  CASE WHEN event_id % 89 = 0 THEN '' ELSE 'h' || (user_id % 12) END AS host,
  CASE event_type WHEN 'view' THEN 'arp' WHEN 'click' THEN 'http' WHEN 'purchase' THEN 'tcp' WHEN 'signup' THEN 'udp' ELSE 'UNKNOWN_PROTOCOL' END AS protocol_group
  FROM events),
judged AS (SELECT *, CASE WHEN host = '' THEN 'unusable_host_identity' WHEN seconds IS NULL THEN 'unparseable_timestamp' END AS reason FROM raw)
"""


@query(
    _RAW_PACKETS + "SELECT protocol_group, coalesce(reason, 'kept') AS outcome, count(*) AS records FROM judged GROUP BY ALL"
)
def source_packet_csv(w: Workload) -> DataFrame:
    path = fresh_path(w.spark, "packet-csv")
    flows.write_csv(w.raw_packets(), path)
    judged = clean.judge_packets(flows.scan_packet_csv(w.spark, path))
    return judged.groupBy("protocol_group", F.coalesce("reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("records"))


@query(
    "SELECT 'flow' AS layout, 'READY' AS state, '' AS missing_columns, CAST(7 AS BIGINT) AS observed_columns, count(*) AS records FROM events "
    "UNION ALL SELECT 'event', 'Invalid', 'src_ip,proto,service,label,type', CAST(6 AS BIGINT), count(*) FROM events"
)
def source_schema_state(w: Workload) -> DataFrame:
    parts = []
    for layout, frame in (("flow", w.raw_flows()), ("event", w.table("events"))):
        state = flows.schema_state(frame, P.FLOW_REQUIRED).withColumn("layout", F.lit(layout))
        parts.append(state.withColumn("records", frame.agg(F.count("*")).scalar()))
    return parts[0].unionByName(parts[1])


@query("SELECT event_type AS kind, CAST(user_id % 12 AS BIGINT) AS site, count(*) AS records, round(sum(value), 4) AS amount FROM events GROUP BY ALL")
def source_column_mapping(w: Workload) -> DataFrame:
    mapped = flows.map_columns(w.table("events"), {"kind": "event_type", "owner": "user_id", "amount": "value"})
    return mapped.groupBy("kind", (F.col("owner") % 12).alias("site")).agg(
        F.count("*").alias("records"), F.round(F.sum("amount"), 4).alias("amount")
    )


@query()
def source_file_inventory(w: Workload) -> DataFrame:
    listed = flows.file_inventory(w.spark, w.folder, "*.parquet")
    return listed.select(F.element_at(F.split("path", "/"), -1).alias("file"), "sha256", "bytes")


@query("SELECT partition, stream, count(*) AS records, CAST(sum(total) AS BIGINT) AS events FROM feat GROUP BY ALL", "feat")
def sink_partitioned_table(w: Workload) -> DataFrame:
    """Write the epoch table by stream and partition and read the totals back."""
    path = fresh_path(w.spark, "epoch-table")
    flows.write_table(w.feature_rows().drop("features"), path, ("stream", "partition"))
    return w.spark.read.parquet(path).groupBy("partition", "stream").agg(
        F.count("*").alias("records"), F.sum("total").alias("events")
    )


# -- cleaning -----------------------------------------------------------------------------------


@query(_RAW_FLOWS + "SELECT original_order, coalesce(reason, 'kept') AS outcome FROM judged")
def clean_first_reason(w: Workload) -> DataFrame:
    return clean.judge_flows(w.raw_flows()).select("original_order", F.coalesce("reason", F.lit("kept")).alias("outcome"))


@query(_RAW_FLOWS + "SELECT reason, count(*) AS records FROM judged WHERE reason IS NOT NULL GROUP BY ALL")
def clean_rejects(w: Workload) -> DataFrame:
    return clean.rejected(clean.judge_flows(w.raw_flows(), ascii_only=True)).groupBy("reason").agg(F.count("*").alias("records"))


@query(
    _RAW_FLOWS + "SELECT original_order, host AS client_id, proto, service, proto || '::' || service AS event_type, round(seconds, 5) AS ts_seconds FROM kept"
)
def clean_flow_events(w: Workload) -> DataFrame:
    """Canonical ids and tokens; the NFKC step runs for non-ASCII text only."""
    kept = clean.flow_events(clean.kept(clean.judge_flows(w.raw_flows())))
    return kept.select("original_order", "client_id", "proto", "service", "event_type", F.round("ts_seconds", 5).alias("ts_seconds"))


@query(
    _RAW_PACKETS + "SELECT original_order, round(seconds, 5) AS ts_seconds, host AS client_id, protocol_group, 'PROTOCOL::' || upper(protocol_group) AS event_type, "
    "protocol_group <> 'UNKNOWN_PROTOCOL' AS counted FROM judged WHERE reason IS NULL"
)
def clean_packet_events(w: Workload) -> DataFrame:
    kept = clean.packet_events(clean.kept(clean.judge_packets(w.raw_packets())))
    return kept.select(
        "original_order", F.round("ts_seconds", 5).alias("ts_seconds"), "client_id", "protocol_group", "event_type", "counted"
    )


@query(
    _RAW_PACKETS + "SELECT host AS client_id, CAST(floor(seconds / 3600) AS BIGINT) AS epoch, count(*) AS records FROM judged "
    "WHERE reason IS NULL AND protocol_group <> 'UNKNOWN_PROTOCOL' GROUP BY ALL"
)
def clean_counted_packets(w: Workload) -> DataFrame:
    kept = clean.packet_events(clean.kept(clean.judge_packets(w.raw_packets()))).filter("counted")
    return kept.groupBy("client_id", timing.epoch_index(F.col("ts_seconds"), 3600).alias("epoch")).agg(F.count("*").alias("records"))


@query(
    _RAW_FLOWS + "SELECT proto || '::' || service AS event_type, CAST(('0x' || substr(sha256(proto || '::' || service), 1, 16))::UBIGINT % 64 AS BIGINT) AS bucket, "
    "count(*) AS records FROM kept GROUP BY ALL"
)
def clean_hash_bucket(w: Workload) -> DataFrame:
    kept = clean.flow_events(clean.kept(clean.judge_flows(w.raw_flows(), ascii_only=True)))
    return kept.groupBy("event_type").agg(F.count("*").alias("records")).withColumn(
        "bucket", n64(text.hash_bucket(F.col("event_type"), 64))
    )


@query("SELECT CAST(floor((epoch_us(ts) / 1e6 - 1705000000.5) / 3600) AS BIGINT) AS epoch, count(*) AS records FROM events GROUP BY ALL")
def clean_epoch_index(w: Workload) -> DataFrame:
    """Epochs about an origin inside the data: negative times floor downward."""
    seconds = timing.naive_seconds(F.col("ts")) - 1705000000.5
    return w.table("events").groupBy(timing.epoch_index(seconds, 3600).alias("epoch")).agg(F.count("*").alias("records"))


@query(_RAW_FLOWS + "SELECT gt_class, gt_type, gt_class = 'ambiguous' AS is_ambiguous, count(*) AS records FROM kept GROUP BY ALL")
def clean_ground_truth(w: Workload) -> DataFrame:
    labelled = clean.ground_truth(clean.kept(clean.judge_flows(w.raw_flows(), ascii_only=True)))
    return labelled.groupBy("gt_class", "gt_type", "is_ambiguous").agg(F.count("*").alias("records"))


@query(
    "SELECT CASE WHEN value >= 200 THEN 'malicious' ELSE 'benign' END AS gt_class, CASE WHEN value >= 200 THEN 'DDoS_UDP' ELSE 'Normal' END AS gt_type, count(*) AS records "
    "FROM events WHERE event_id % 89 <> 0 AND event_id % 97 <> 0 GROUP BY ALL"
)
def clean_packet_ground_truth(w: Workload) -> DataFrame:
    """The packet layout keeps the case of the type."""
    labelled = clean.ground_truth(clean.kept(clean.judge_packets(w.raw_packets())), lower_type=False)
    return labelled.groupBy("gt_class", "gt_type").agg(F.count("*").alias("records"))


@query(
    _RAW_FLOWS + "SELECT lower(kind) AS attack_type, count(*) AS records, lower(kind) IN ('normal', 'backdoor', 'dos', 'ddos', 'injection', 'mitm', "
    "'password', 'ransomware', 'scanning', 'xss') AS expected FROM kept GROUP BY ALL"
)
def clean_attack_profile(w: Workload) -> DataFrame:
    kept = clean.kept(clean.judge_flows(w.raw_flows(), ascii_only=True))
    return clean.attack_type_profile(kept, P.FLOW_ATTACK_TYPES)


@query(
    _RAW_FLOWS + "SELECT 'benign' AS split, count(*) AS records FROM kept WHERE gt_class = 'benign' UNION ALL "
    "SELECT 'evaluation', count(*) FROM kept WHERE gt_class <> 'benign' UNION ALL SELECT 'discrepancies', count(*) FROM kept WHERE gt_class = 'ambiguous'"
)
def clean_splits(w: Workload) -> DataFrame:
    labelled = clean.ground_truth(clean.kept(clean.judge_flows(w.raw_flows(), ascii_only=True)))
    parts = [
        f(labelled).agg(F.lit(name).alias("split"), F.count("*").alias("records"))
        for name, f in (("benign", clean.benign), ("evaluation", clean.evaluation), ("discrepancies", clean.discrepancies))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT client_id, epoch, malicious, records FROM labels", "labels")
def clean_epoch_labels(w: Workload) -> DataFrame:
    return w.epoch_labels().select("client_id", "epoch", "malicious", "records")


# -- duplicates ---------------------------------------------------------------------------------

_COPIES = """
WITH base AS (SELECT event_id AS original_order, CAST(event_id AS VARCHAR) AS uid, 'c' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') AS client_id,
  epoch_us(ts) / 1e6 AS ts_seconds, event_type, props AS payload FROM events),
copies AS (SELECT * FROM base UNION ALL SELECT original_order + 1000000000, uid, client_id,
  ts_seconds + CASE WHEN (original_order + 1000000000) % 20 = 3 THEN 30.0 ELSE 0 END, event_type, payload FROM base WHERE original_order % 10 = 3),
clash AS (SELECT * FROM base UNION ALL SELECT original_order + 1000000000, uid, client_id,
  ts_seconds + CASE WHEN (original_order + 1000000000) % 20 = 3 THEN 30.0 ELSE 0 END, event_type,
  CASE WHEN (original_order + 1000000000) % 100 = 3 THEN 'changed' ELSE payload END FROM base WHERE original_order % 10 = 3)
"""


@query(
    _COPIES + "SELECT uid, client_id, original_order, CAST(copies AS BIGINT) AS copies FROM (SELECT *, count(*) OVER (PARTITION BY uid) AS copies, "
    "row_number() OVER (PARTITION BY uid ORDER BY ts_seconds, original_order) AS i FROM copies) WHERE i = 1"
)
def dedup_by_identifier(w: Workload) -> DataFrame:
    return dedup.deduplicated(w.with_copies(), by_uid=True).select("uid", "client_id", "original_order", "copies")


def _walked(name: str, payload: str) -> str:
    """Rows of the data set of both kinds, walked one by one in order; each linked set of rows is walked on its own."""
    return f"""
{name}_rows AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ts_seconds, original_order) AS i, *, (client_id, ts_seconds, event_type, payload) AS k FROM (
  SELECT original_order * 8 AS original_order, CASE WHEN original_order % 3 <> 0 THEN uid END AS uid, client_id, ts_seconds, event_type, payload FROM base WHERE original_order % 10 <> 3
  UNION ALL SELECT original_order * 8 + (v * 3 + original_order) % 8, CASE WHEN (original_order // 10 + v) % 3 = 0 THEN NULL WHEN v % 2 = 1 THEN uid ELSE uid || 'b' END,
    client_id, ts_seconds + 30 * ((original_order + 2 * v) % 3), event_type, {payload} FROM base CROSS JOIN (SELECT unnest(range(6)) AS v) WHERE original_order % 10 = 3)),
{name}_links AS MATERIALIZED (SELECT a.i AS a, b.i AS b FROM {name}_rows a JOIN {name}_rows b ON a.uid = b.uid UNION SELECT a.i, b.i FROM {name}_rows a JOIN {name}_rows b ON a.k = b.k),
{name}_reach(a, b) AS (SELECT i, i FROM {name}_rows UNION SELECT r.a, l.b FROM {name}_reach r JOIN {name}_links l ON r.b = l.a),
{name}_steps AS MATERIALIZED (SELECT r.*, c, row_number() OVER (PARTITION BY c ORDER BY i) AS step FROM {name}_rows r JOIN (SELECT a, min(b) AS c FROM {name}_reach GROUP BY a) ON a = i),
{name}_walk AS (
  SELECT c, step, i, i AS owner, false AS clash, [{{'i': i, 'uid': uid, 'k': k, 'what': (payload, client_id, event_type)}}] AS kept FROM {name}_steps WHERE step = 1
  UNION ALL
  SELECT c, step, i, coalesce(hit.i, i), hit IS NOT NULL AND uid = hit.uid AND what <> hit.what, CASE WHEN hit IS NULL THEN list_append(kept, {{'i': i, 'uid': uid, 'k': k, 'what': what}}) ELSE kept END
  FROM (SELECT s.c, s.step, s.i, s.uid, s.k, (s.payload, s.client_id, s.event_type) AS what, kept,
      list_filter(kept, lambda e: CASE WHEN e.uid IS NULL OR s.uid IS NULL THEN e.k = s.k ELSE e.uid = s.uid END)[1] AS hit
    FROM {name}_walk w JOIN {name}_steps s ON s.c = w.c AND s.step = w.step + 1))"""


_MIXED = _COPIES.replace("WITH base", "WITH RECURSIVE base").rstrip() + "," + _walked("mixed", "payload")
_MIXED_CLASH = _MIXED + "," + _walked("odd", "CASE WHEN v = 4 AND original_order % 100 = 13 THEN 'changed' ELSE payload END")


@query(
    _MIXED + """
SELECT uid, client_id, event_type, original_order, copies FROM mixed_rows JOIN (SELECT owner, count(*) AS copies FROM mixed_walk GROUP BY owner) ON owner = i"""
)
def dedup_mixed_identity(w: Workload) -> DataFrame:
    """Records of both kinds: identifiers decide between identified rows, the exact key wherever one row has none."""
    return dedup.deduplicated(w.with_mixed_copies(), by_uid=True).select("uid", "client_id", "event_type", "original_order", "copies")


@query(
    _COPIES + "SELECT client_id, event_type, original_order, CAST(copies AS BIGINT) AS copies FROM (SELECT *, count(*) OVER w AS copies, row_number() OVER (w ORDER BY original_order) AS i "
    "FROM copies WINDOW w AS (PARTITION BY client_id, ts_seconds, event_type, payload)) WHERE i = 1"
)
def dedup_exact_key(w: Workload) -> DataFrame:
    rows = dedup.deduplicated(w.with_copies().withColumn("uid", F.lit(None).cast("string")), by_uid=False)
    return rows.select("client_id", "event_type", "original_order", "copies")


@query(_COPIES + "SELECT uid FROM clash GROUP BY uid HAVING count(DISTINCT payload) > 1")
def dedup_conflicts(w: Workload) -> DataFrame:
    return dedup.conflicting_uids(w.with_copies(conflict=True))


@query(
    _MIXED_CLASH + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts_seconds, original_order) AS i,
  first_value(payload) OVER (PARTITION BY uid ORDER BY ts_seconds, original_order) AS p0 FROM clash),
hit AS (SELECT min((ts_seconds, original_order)) AS first_hit FROM ranked WHERE payload <> p0)
SELECT 'copies' AS data, 'READY' AS state, count(DISTINCT uid) AS retained, count(*) - count(DISTINCT uid) AS duplicates FROM copies
UNION ALL SELECT 'clash', 'Invalid', CAST(0 AS BIGINT), count(*) FROM ranked, hit WHERE i > 1 AND (ts_seconds, original_order) < first_hit
UNION ALL SELECT 'exact', 'READY', count(DISTINCT (client_id, ts_seconds, event_type, payload)), count(*) - count(DISTINCT (client_id, ts_seconds, event_type, payload)) FROM copies
UNION ALL SELECT 'mixed', 'READY', count(*) FILTER (WHERE owner = i), count(*) FILTER (WHERE owner <> i) FROM mixed_walk
UNION ALL SELECT 'mixed clash', 'Invalid', CAST(0 AS BIGINT), count(*) FILTER (WHERE owner <> i AND i < (SELECT min(i) FROM odd_walk WHERE clash)) FROM odd_walk"""
)
def dedup_accounting(w: Workload) -> DataFrame:
    good = dedup.accounting(w.with_copies(), by_uid=True).withColumn("data", F.lit("copies"))
    bad = dedup.accounting(w.with_copies(conflict=True), by_uid=True).withColumn("data", F.lit("clash"))
    exact = dedup.accounting(w.with_copies(), by_uid=False).withColumn("data", F.lit("exact"))
    mixed = dedup.accounting(w.with_mixed_copies(), by_uid=True).withColumn("data", F.lit("mixed"))
    odd = dedup.accounting(w.with_mixed_copies(conflict=True), by_uid=True).withColumn("data", F.lit("mixed clash"))
    return good.unionByName(bad).unionByName(exact).unionByName(mixed).unionByName(odd)


# -- client selection ---------------------------------------------------------------------------

_TALLY = """
WITH tally AS (SELECT 'u' || user_id AS client_id, count(*) AS benign_records, count(DISTINCT floor(epoch_us(ts) / 1e6 / 3600)) AS benign_epochs
  FROM events WHERE value < 200 GROUP BY user_id),
judged AS (SELECT *, benign_records >= 60 AND benign_epochs >= 58 AS eligible FROM tally)
"""


def _user_eligibility(w: Workload) -> DataFrame:
    tally = clients.benign_tally(clean.benign(clean.ground_truth(w.user_flows())), w.p.epoch_seconds)
    return clients.eligibility(tally, 60, 58)


@query(_TALLY + "SELECT * FROM judged")
def select_tally(w: Workload) -> DataFrame:
    return _user_eligibility(w)


@query(
    _TALLY + "SELECT client_id, benign_records FROM judged WHERE eligible AND (SELECT count(*) FROM judged WHERE eligible) >= 12 "
    "ORDER BY benign_records DESC, client_id LIMIT 12"
)
def select_strict(w: Workload) -> DataFrame:
    return clients.select_strict(_user_eligibility(w), 12).select("client_id", "benign_records")


@query(_TALLY + "SELECT client_id, benign_records FROM judged WHERE eligible AND (SELECT count(*) FROM judged WHERE eligible) >= 6")
def select_flexible(w: Workload) -> DataFrame:
    """Between the minimum and the target every eligible client is taken."""
    return clients.select_flexible(_user_eligibility(w), 100_000, 6).select("client_id", "benign_records")


@query(
    _TALLY + "SELECT count(*) AS clients, count(*) FILTER (eligible) AS eligible_clients, "
    "CASE WHEN count(*) FILTER (eligible) < 100000 THEN 'NOT_TESTED' ELSE 'SUPPORTED' END AS claim_state FROM judged"
)
def select_state(w: Workload) -> DataFrame:
    return clients.selection_state(_user_eligibility(w), 100_000)


@query(
    "SELECT client_id, i AS client_index, ['Isolation Forest', 'One-Class SVM', 'Autoencoder'][i % 3 + 1] AS family "
    "FROM (SELECT client_id, row_number() OVER (ORDER BY client_id) - 1 AS i FROM selected)",
    "selected",
)
def select_detector_family(w: Workload) -> DataFrame:
    return clients.detector_families(w.selected()).select("client_id", n64("client_index").alias("client_index"), "family")


# -- features and partitions --------------------------------------------------------------------


@query("SELECT client_id, epoch, bucket, CAST(n AS BIGINT) AS n, CAST(n_benign AS BIGINT) AS n_benign FROM sparse", "sparse")
def feature_bucket_counts(w: Workload) -> DataFrame:
    return w.sparse().select("client_id", "epoch", n64("bucket").alias("bucket"), "n", "n_benign")


@query(
    "SELECT stream, client_id, epoch, total, round(entropy, 6) AS entropy, round(list_sum(list_transform(counts, lambda x: ln(1.0 + x))), 6) AS log_counts FROM feat",
    "feat",
)
def feature_vectors(w: Workload) -> DataFrame:
    """Dense grid with zero epochs, log counts, total and entropy."""
    logs = arrays.total(F.slice("features", 1, w.p.hash_buckets))
    return w.feature_rows().select("stream", "client_id", "epoch", "total", r6("entropy").alias("entropy"), r6(logs).alias("log_counts"))


@query("SELECT start_epoch, end_epoch FROM span", "span")
def feature_common_interval(w: Workload) -> DataFrame:
    return w.interval()


@query("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS non_finite FROM feat", "feat")
def feature_non_finite(w: Workload) -> DataFrame:
    return features.non_finite_rows(w.feature_rows())


@query("SELECT client_id, CAST(feature AS BIGINT) AS feature, round(median, 6) AS median, round(iqr, 6) AS iqr FROM scaler", "scaler")
def feature_scaler(w: Workload) -> DataFrame:
    return w.scaler().select("client_id", n64("feature").alias("feature"), r6("median").alias("median"), r6("iqr").alias("iqr"))


@query("SELECT stream, client_id, epoch, round(score, 4) AS score FROM scores", "scores")
def feature_distance_score(w: Workload) -> DataFrame:
    return w.scores().select("stream", "client_id", "epoch", F.round("score", 4).alias("score"))


@query("SELECT stream, client_id, epoch, partition, CAST(part_pos AS BIGINT) AS part_pos, CAST(part_size AS BIGINT) AS part_size FROM grid", "grid")
def partition_roles(w: Workload) -> DataFrame:
    return w.grid().select("stream", "client_id", "epoch", "partition", n64("part_pos").alias("part_pos"), n64("part_size").alias("part_size"))


@query("SELECT DISTINCT partition, epoch, CAST(horizon_id AS BIGINT) AS horizon_id, CAST(pos AS BIGINT) AS pos FROM horizon_axis", "horizon_axis")
def partition_horizons(w: Workload) -> DataFrame:
    rows = partitions.assign_horizons(w.epoch_axis().filter("stream = 'benign'"), w.p.horizon)
    return rows.select("partition", "epoch", "horizon_id", F.col("h_pos").alias("pos"))


@query(
    "SELECT partition, count(DISTINCT horizon_id) AS horizons, count(*) = count(DISTINCT epoch) AS non_overlapping, CAST(ceil(ln(0.05) / ln(0.7)) AS BIGINT) AS required, "
    "CASE WHEN count(DISTINCT horizon_id) < ceil(ln(0.05) / ln(0.7)) THEN 'NOT_TESTED' ELSE 'SUPPORTED' END AS claim_state FROM horizon_axis GROUP BY 1",
    "horizon_axis",
)
def partition_eligibility(w: Workload) -> DataFrame:
    rows = partitions.assign_horizons(w.epoch_axis().filter("stream = 'benign'"), w.p.horizon)
    return partitions.horizon_eligibility(rows, w.p.pfa_target, w.p.confidence)


@query(
    """SELECT start_epoch, end_epoch, CAST(t AS BIGINT) AS window_total FROM (SELECT *, rank() OVER (ORDER BY t DESC) AS k, count(*) OVER () AS n FROM (
  SELECT epoch - 5 AS start_epoch, epoch AS end_epoch, sum(total) OVER (ORDER BY epoch ROWS 5 PRECEDING) AS t, row_number() OVER (ORDER BY epoch) AS i
  FROM (SELECT epoch, sum(total) AS total FROM feat WHERE stream = 'benign' AND partition = 'heldout_benign' GROUP BY 1)) WHERE i >= 6)
WHERE k <= ceil(0.05 * n)""",
    "feat",
)
def stress_windows(w: Workload) -> DataFrame:
    heldout = w.feature_rows().filter((F.col("stream") == "benign") & (F.col("partition") == HELDOUT))
    totals = heldout.groupBy("epoch").agg(F.sum("total").alias("total"))
    return partitions.stress_windows(totals, w.p.horizon, w.p.stress_stride, 0.05).select("start_epoch", "end_epoch", "window_total")


@query(
    """SELECT factor, client_id, epoch, round(f * total, 6) AS stressed_total, round(entropy, 6) AS entropy,
  round(list_sum(list_transform(counts, lambda x: ln(1.0 + f * x))), 6) AS log_counts
FROM feat, (VALUES ('1.25', 1.25::DOUBLE), ('1.5', 1.5::DOUBLE), ('2.0', 2.0::DOUBLE)) v(factor, f) WHERE stream = 'benign' AND partition = 'heldout_benign'""",
    "feat",
)
def stress_counts(w: Workload) -> DataFrame:
    """Counts and totals times a factor before the logarithm; entropy stays."""
    out = None
    for factor in w.p.stress_factors:
        rows = w.feature_rows(factor).filter((F.col("stream") == "benign") & (F.col("partition") == HELDOUT))
        part = rows.select(
            F.lit(str(factor)).alias("factor"), "client_id", "epoch",
            r6(F.element_at("features", -2)).alias("stressed_total"), r6("entropy").alias("entropy"),
            r6(arrays.total(F.slice("features", 1, w.p.hash_buckets))).alias("log_counts"),
        )
        out = part if out is None else out.unionByName(part)
    return out


# -- campaigns ----------------------------------------------------------------------------------


@query("SELECT start_epoch, end_epoch, duration FROM runs", "runs")
def campaign_runs(w: Workload) -> DataFrame:
    return campaigns.merged_runs(w.epoch_runs()).select("start_epoch", "end_epoch", "duration")


@query("SELECT start_epoch, client_id, first_epoch FROM participants JOIN runs USING (run_id)", "participants")
def campaign_participants(w: Workload) -> DataFrame:
    runs = campaigns.merged_runs(w.epoch_runs()).select("run_id", "start_epoch")
    return campaigns.run_participants(w.epoch_labels(), w.epoch_runs()).join(runs, "run_id").select("start_epoch", "client_id", "first_epoch")


@query(
    "SELECT start_epoch, end_epoch, CAST(participant_count AS BIGINT) AS participant_count, spread, first_activity_distributed, distributed_support, long_enough, warmup_clean FROM judged",
    "judged",
)
def campaign_conditions(w: Workload) -> DataFrame:
    return w.judged_runs().select(
        "start_epoch", "end_epoch", "participant_count", "spread", "first_activity_distributed", "distributed_support",
        "long_enough", "warmup_clean",
    )


@query("SELECT start_epoch, end_epoch, duration, names AS participants, checksum FROM registry", "registry")
def campaign_registry(w: Workload) -> DataFrame:
    return w.registry().select("start_epoch", "end_epoch", "duration", F.array_join("participants", ",").alias("participants"), "checksum")


@query(
    "SELECT r.checksum, s.client_id, s.epoch, s.epoch - r.start_epoch AS c_pos, round(s.score, 4) AS score FROM registry r JOIN scores s "
    "ON s.epoch BETWEEN r.start_epoch - 6 AND r.start_epoch + 5 WHERE s.stream = 'all'",
    "registry",
)
def campaign_replay(w: Workload) -> DataFrame:
    rows = w.scores().filter("stream = 'all'")
    return campaigns.replay(w.registry(), rows, w.p.horizon, w.p.warmup).select(
        "checksum", "client_id", "epoch", "c_pos", F.round("score", 4).alias("score")
    )


# -- ranks --------------------------------------------------------------------------------------


@query("SELECT stream, client_id, epoch, round(rank, 9) AS rank FROM ranks", "ranks")
def rank_marginal(w: Workload) -> DataFrame:
    return w.ranks().select("stream", "client_id", "epoch", F.round("rank", 9).alias("rank"))


@query(
    "SELECT coalition_id, CAST(cell AS BIGINT) AS cell, CAST(slot AS BIGINT) AS slot, count(*) AS rows, round(sum(v), 6) AS rank_sum, round(min(v), 9) AS lowest, round(max(v), 9) AS highest "
    "FROM (SELECT coalition_id, cell, unnest(r) AS v, unnest(range(0, ord)) AS slot FROM conditional) GROUP BY ALL",
    "conditional",
)
def rank_conditional(w: Workload) -> DataFrame:
    long = w.conditional().select("coalition_id", n64("cell").alias("cell"), F.posexplode("r").alias("slot", "v"))
    return long.groupBy("coalition_id", "cell", n64("slot").alias("slot")).agg(
        F.count("*").alias("rows"), r6(F.sum("v")).alias("rank_sum"), F.round(F.min("v"), 9).alias("lowest"), F.round(F.max("v"), 9).alias("highest")
    )


# -- local policy -------------------------------------------------------------------------------


@query("SELECT client_id, CAST(q_index AS BIGINT) AS q_index, round(threshold, 4) AS threshold FROM candidates", "candidates")
def policy_thresholds(w: Workload) -> DataFrame:
    return w.policy_thresholds().select("client_id", n64("q_index").alias("q_index"), F.round("threshold", 4).alias("threshold"))


_POLICY_WORKLOAD = "client_id, round(threshold, 4) AS threshold, CAST(m AS BIGINT) AS m, CAST(n AS BIGINT) AS n"


@query(
    f"SELECT {_POLICY_WORKLOAD}, horizons, false_stops FROM policy_counts WHERE partition = 'threshold_and_policy_calibration'", "policy_counts"
)
def policy_false_stops(w: Workload) -> DataFrame:
    c = w.policy_counts(CALIBRATION)
    return c.select("client_id", F.round("threshold", 4).alias("threshold"), n64("m").alias("m"), n64("n").alias("n"), "horizons", "false_stops")


@query(
    f"SELECT DISTINCT {_POLICY_WORKLOAD}, CAST(horizon_id AS BIGINT) AS horizon_id, CAST(stop AS BIGINT) AS stop FROM policy_stops WHERE partition = 'heldout_benign' AND stop IS NOT NULL",
    "policy_stops",
)
def policy_first_stops(w: Workload) -> DataFrame:
    """First stop of every candidate policy in each held-out horizon that has one."""
    rows = w.horizons(w.scores(), HELDOUT).join(w.policy_thresholds(), "client_id")
    stops = policy.local_stops(rows, ["client_id", "q_index", "horizon_id"], "h_pos", w.p.persistence)
    return (
        stops.filter("stop IS NOT NULL")
        .select("client_id", F.round("threshold", 4).alias("threshold"), n64("m").alias("m"), n64("n").alias("n"), "horizon_id", n64("stop").alias("stop"))
        .distinct()
    )


@query(
    """, tails AS (WITH RECURSIVE t AS (SELECT DISTINCT horizons AS n, 0 AS k, power(0.7, horizons) AS t FROM policy_counts
  UNION ALL SELECT n, k + 1, t * (n - k) / (k + 1.0) * (0.3 / 0.7) FROM t WHERE k < n)
  SELECT n AS horizons, k AS false_stops, sum(t) OVER (PARTITION BY n ORDER BY k) AS cdf FROM t)
SELECT CAST(horizons AS BIGINT) AS horizons, CAST(false_stops AS BIGINT) AS false_stops, round(cdf, 6) AS tail, false_stops < horizons AND cdf <= 0.05 + 1e-15 AS within,
  CASE WHEN false_stops = horizons THEN 1.0 ELSE round((lo + hi) / 2, 6) END AS bound
FROM (SELECT DISTINCT horizons, false_stops FROM policy_counts WHERE partition = 'threshold_and_policy_calibration') JOIN tails USING (horizons, false_stops)
JOIN (""" + bisected("(SELECT DISTINCT horizons AS n, false_stops AS x FROM policy_counts)", "0.05") + """) ON n = horizons AND x = false_stops""",
    "policy_counts",
)
def policy_bound(w: Workload) -> DataFrame:
    """Upper bound and its decision form over the observed counts."""
    c = w.policy_counts(CALIBRATION).select("horizons", "false_stops").distinct()
    x, n = F.col("false_stops"), F.col("horizons")
    bound = binomial.upper_bound(x, n, w.p.confidence)
    return c.select(
        "horizons", "false_stops", r6(binomial.binomial_cdf(x, n, w.p.pfa_target)).alias("tail"),
        binomial.bound_within(x, n, w.p.confidence, w.p.pfa_target).alias("within"),
        r6(bound).alias("bound"),
    )


@query(
    "SELECT client_id, round(p[1], 4) AS threshold, CAST(p[2] AS BIGINT) AS m, CAST(p[3] AS BIGINT) AS n, CASE WHEN p IS NULL THEN 'Operating Point Unavailable' ELSE 'Available' END AS operating_point "
    "FROM policies",
    "policies",
)
def policy_choice(w: Workload) -> DataFrame:
    return w.policies().select("client_id", F.round("threshold", 4).alias("threshold"), n64("m").alias("m"), n64("n").alias("n"), "operating_point")


@query(
    "SELECT s.client_id, count(*) AS horizons, count(stop) AS false_stops, round(count(stop) / count(*), 6) AS pfa FROM policy_stops s JOIN policies p USING (client_id) "
    "WHERE partition = 'heldout_benign' AND (threshold, m, n) = p.p GROUP BY 1",
    "policies",
)
def policy_heldout(w: Workload) -> DataFrame:
    rates = policy.empirical_pfa(w.heldout_stops(), ["client_id"], w.p.confidence)
    return rates.select("client_id", "horizons", "false_stops", r6("pfa").alias("pfa"))


# -- coalitions ---------------------------------------------------------------------------------


@query(
    "SELECT coalition_id, CAST(ord AS BIGINT) AS ord, (SELECT string_agg(client_id, ',' ORDER BY client_id) FROM selected WHERE NOT list_contains(members, client_id)) AS complement FROM coalitions",
    "coalitions",
)
def coalition_list(w: Workload) -> DataFrame:
    rows = coalitions.enumerate_coalitions(w.selected(), len(w.client_ids()), 3)
    return rows.select("coalition_id", n64("ord").alias("ord"), F.array_join("complement", ",").alias("complement"))


@query(
    "SELECT a.coalition_id, b.coalition_id AS subset, CAST(b.ord AS BIGINT) AS subset_order FROM coalitions a JOIN coalitions b ON b.ord < a.ord AND list_has_all(a.members, b.members)",
    "coalitions",
)
def coalition_subsets(w: Workload) -> DataFrame:
    rows = coalitions.enumerate_coalitions(w.selected(), len(w.client_ids()), 3)
    return coalitions.proper_subsets(rows).select("coalition_id", F.array_join("subset", "|").alias("subset"), n64("subset_order").alias("subset_order"))


@query(
    "SELECT CAST(ord AS BIGINT) AS ord, count(*) AS coalitions, CAST(greatest(2, ceil(0.5 * (12 - ord))) AS BIGINT) AS required_outside FROM coalitions GROUP BY ord",
    "coalitions",
)
def coalition_requirements(w: Workload) -> DataFrame:
    k = len(w.client_ids())
    rows = coalitions.enumerate_coalitions(w.selected(), k, 3)
    need = coalitions.required_outside_column(F.col("ord"), k, 3, w.p.outside_minimum, w.p.outside_fraction)
    return rows.groupBy("ord").agg(F.count("*").alias("coalitions")).select(n64("ord").alias("ord"), "coalitions", n64(need).alias("required_outside"))


@query(
    "SELECT coalition_id, NOT list_contains(members, 'c00') AND NOT list_contains(members, 'c05') AS admissible FROM coalitions", "coalitions"
)
def coalition_admissible(w: Workload) -> DataFrame:
    rows = coalitions.enumerate_coalitions(w.selected(), len(w.client_ids()), 3)
    return rows.select("coalition_id", coalitions.admissible(F.array(F.lit("c00"), F.lit("c05")), F.col("members")).alias("admissible"))


_DROPOUT = """, up AS (SELECT DISTINCT client_id, epoch, ('0x' || substr(sha256('7:' || client_id || ':' || epoch), 1, 8))::UBIGINT / 4294967296.0 < 0.5 AS here FROM ranks),
outside AS (SELECT epoch, count(*) FILTER (here) AS n FROM up GROUP BY 1),
inside AS (SELECT m.coalition_id, m.ord, u.epoch, count(*) FILTER (here) AS n FROM member_slots m JOIN up u USING (client_id) GROUP BY ALL)
"""


@query(
    _DROPOUT + "SELECT coalition_id, count(*) AS epochs, count(*) FILTER (i.n = i.ord AND o.n - i.n >= greatest(2, ceil(0.5 * (12 - ord)))) AS active_epochs "
    "FROM inside i JOIN outside o USING (epoch) GROUP BY 1",
    "member_slots",
)
def coalition_activity(w: Workload) -> DataFrame:
    """Epochs in which each coalition stays active when half of the clients drop out."""
    rows = w.coalition_rows(dropout=0.5).filter("stream = 'benign'")
    return rows.groupBy("coalition_id").agg(F.count("*").alias("epochs"), F.count_if("active").alias("active_epochs"))


# -- contexts -----------------------------------------------------------------------------------

_HIST_SUMS = "CAST(ord AS BIGINT) AS ord, stream, epoch, count(*) AS coalitions, round(sum(hist[1]), 6) AS mass1, round(sum(hist[4]), 6) AS mass4, round(sum(hist[8]), 6) AS mass8, round(sum(list_sum(hist)), 6) AS mass"


def _hist_sums(rows: DataFrame) -> DataFrame:
    at = lambda i: r6(F.sum(F.get("hist", F.lit(i))))
    return rows.groupBy(n64("ord").alias("ord"), "stream", "epoch").agg(
        F.count("*").alias("coalitions"), at(0).alias("mass1"), at(3).alias("mass4"), at(7).alias("mass8"), r6(F.sum(arrays.total(F.col("hist")))).alias("mass")
    )


@query(f"SELECT {_HIST_SUMS} FROM hists GROUP BY ord, stream, epoch", "hists")
def context_histograms(w: Workload) -> DataFrame:
    return _hist_sums(w.coalition_rows().filter("active"))


@query(
    """SELECT coalition_id, count(*) AS rows, round(sum(hist[1]), 6) AS mass1, round(sum(hist[2] * epoch), 3) AS weighted2, round(sum(list_sum(hist)), 6) AS mass
FROM hists WHERE stream = 'benign' GROUP BY 1""",
    "hists",
)
def context_histograms_by_coalition(w: Workload) -> DataFrame:
    rows = w.coalition_rows().filter("active and stream = 'benign'")
    return rows.groupBy("coalition_id").agg(
        F.count("*").alias("rows"), r6(F.sum(F.get("hist", F.lit(0)))).alias("mass1"),
        F.round(F.sum(F.get("hist", F.lit(1)) * F.col("epoch")), 3).alias("weighted2"), r6(F.sum(arrays.total(F.col("hist")))).alias("mass"),
    )


def _variant_sql(keep: str) -> str:
    return f"""SELECT coalition_id, round(sum(h[1]), 6) AS mass1, round(sum(h[8]), 6) AS mass8, round(sum(list_sum(h)), 6) AS mass FROM (
  SELECT coalition_id, epoch, list_transform(range(0, 8), lambda k: len(list_filter(bs, lambda x: x = k)) / CAST(n AS DOUBLE)) AS h FROM (
    SELECT c.coalition_id, s.epoch, count(*) AS n, list(l.b) FILTER (l.b IS NOT NULL) AS bs
    FROM coalitions c JOIN (SELECT DISTINCT client_id, epoch FROM ranks WHERE stream = 'benign') s ON {keep}
    LEFT JOIN (SELECT * FROM lagged WHERE stream = 'benign') l ON l.client_id = s.client_id AND l.epoch = s.epoch GROUP BY ALL)) GROUP BY 1"""


def _variant(w: Workload, name: str) -> DataFrame:
    rows = w.coalition_rows(variant=name).filter("active and stream = 'benign'")
    return rows.groupBy("coalition_id").agg(
        r6(F.sum(F.get("hist", F.lit(0)))).alias("mass1"), r6(F.sum(F.get("hist", F.lit(7)))).alias("mass8"), r6(F.sum(arrays.total(F.col("hist")))).alias("mass")
    )


@query(_variant_sql("true"), "lagged")
def context_inclusive(w: Workload) -> DataFrame:
    return _variant(w, "inclusive")


@query(_variant_sql("s.client_id <> c.members[1]"), "lagged")
def context_leave_one_out(w: Workload) -> DataFrame:
    return _variant(w, "leave_one_out")


@query(_variant_sql("NOT list_contains(c.members[1:greatest(c.ord - 1, 1)], s.client_id)"), "lagged")
def context_partial(w: Workload) -> DataFrame:
    return _variant(w, "partial")


@query(_variant_sql("list_contains(c.members, s.client_id)"), "lagged")
def context_local_history(w: Workload) -> DataFrame:
    return _variant(w, "local_history")


@query(
    """, hashed AS (SELECT DISTINCT stream, epoch, partition, ('0x' || substr(sha256('11:' || stream || ':' || partition || ':' || epoch), 1, 16))::UBIGINT AS h FROM grid)
SELECT a.stream, a.partition, a.epoch, b.epoch AS source_epoch FROM (SELECT *, row_number() OVER (PARTITION BY stream, partition ORDER BY epoch) AS i FROM hashed) a
JOIN (SELECT *, row_number() OVER (PARTITION BY stream, partition ORDER BY h, epoch) AS i FROM hashed) b USING (stream, partition, i)""",
    "grid",
)
def context_shuffled(w: Workload) -> DataFrame:
    """Source epoch of the outside context when contexts are permuted inside each split."""
    epochs = w.epoch_axis().select("stream", "partition", "epoch")
    return contexts.shuffled_epochs(epochs, ["stream", "partition"], 11)


@query(LLOYD_STEP + "SELECT CAST(ord AS BIGINT) AS ord, array_to_string(members, '|') AS coalition_id, epoch, CAST(pos AS BIGINT) AS pos, row_hash FROM capped WHERE pos < 5000", "training")
def context_row_cap(w: Workload) -> DataFrame:
    """The cap operator: rows of each order with the smallest hashes."""
    rows = contexts.capped_rows(w.training_rows(), w.p.context_seed, 5000)
    return rows.select(n64("ord").alias("ord"), F.array_join("members", "|").alias("coalition_id"), "epoch", "pos", "row_hash")


@query(
    LLOYD_STEP + "SELECT CAST(ord AS BIGINT) AS ord, CAST(cell AS BIGINT) AS cell, CAST(bin AS BIGINT) AS bin, round(mass, 9) AS mass FROM (SELECT ord, 0 AS cell, unnest(c0) AS mass, "
    "unnest(range(0, 8)) AS bin FROM stepped UNION ALL SELECT ord, 1, unnest(c1), unnest(range(0, 8)) FROM stepped)",
    "training",
)
def context_lloyd_step(w: Workload) -> DataFrame:
    """One mean step from the first distinct histograms in hash order."""
    hashed = w.stage("hashed-rows", lambda: contexts.hashed_rows(w.training_rows(), w.p.context_seed))
    start = contexts.seed_centroids(hashed, w.p.cells)
    rows = contexts.lloyd_step(contexts.weigh(hashed), start, w.p.tie_tolerance).select("ord", F.posexplode("cells").alias("cell", "c"))
    return rows.select(n64("ord").alias("ord"), n64("cell").alias("cell"), F.posexplode("c").alias("bin", "mass")).select(
        "ord", "cell", n64("bin").alias("bin"), F.round("mass", 9).alias("mass")
    )


@query(
    """SELECT CAST(ord AS BIGINT) AS ord, CAST(cell AS BIGINT) AS cell, CAST(bin AS BIGINT) AS bin, round(mass, 9) AS mass, CAST(rows AS BIGINT) AS rows FROM (
  SELECT ord, 0 AS cell, unnest(c0) AS mass, unnest(range(0, 8)) AS bin FROM centroids UNION ALL SELECT ord, 1, unnest(c1), unnest(range(0, 8)) FROM centroids)
JOIN (SELECT ord, cell, sum(w) AS rows FROM (SELECT w.*, CASE WHEN list_distance(hist, c0) - least(list_distance(hist, c0), list_distance(hist, c1)) <= 1e-12 THEN 0 ELSE 1 END AS cell
  FROM weights w JOIN centroids USING (ord)) GROUP BY ALL) USING (ord, cell)""",
    "centroids",
)
def context_kmeans(w: Workload) -> DataFrame:
    """Centroids of the best of all restarts over all training rows, with the rows of each cell."""
    table = w.centroids()
    sizes = contexts.assign_cells(contexts.weigh(w.training_rows()), table, w.p.tie_tolerance).groupBy("ord", "cell").agg(F.sum("w").alias("rows"))
    long = table.select("ord", F.posexplode("cells").alias("cell", "c")).select("ord", "cell", F.posexplode("c").alias("bin", "mass"))
    return long.join(sizes, ["ord", "cell"]).select(n64("ord").alias("ord"), n64("cell").alias("cell"), n64("bin").alias("bin"), F.round("mass", 9).alias("mass"), "rows")


@query("SELECT coalition_id, stream, CAST(cell AS BIGINT) AS cell, count(*) AS epochs, CAST(sum(epoch) AS BIGINT) AS epoch_sum FROM cells GROUP BY ALL", "cells")
def context_cells(w: Workload) -> DataFrame:
    return w.cells().groupBy("coalition_id", "stream", n64("cell").alias("cell")).agg(F.count("*").alias("epochs"), F.sum("epoch").alias("epoch_sum"))


@query("SELECT coalition_id, CAST(cell AS BIGINT) AS cell, support, supported FROM support", "support")
def context_support(w: Workload) -> DataFrame:
    return w.support().select("coalition_id", n64("cell").alias("cell"), "support", "supported")


@query(
    """SELECT CAST(ord AS BIGINT) AS ord, count(*) AS eligible, count(*) FILTER (s.support >= CASE ord WHEN 1 THEN 40 WHEN 2 THEN 50 ELSE 60 END) AS covered,
  round(count(*) FILTER (s.support >= CASE ord WHEN 1 THEN 40 WHEN 2 THEN 50 ELSE 60 END) / count(*), 6) AS coverage
FROM cells c LEFT JOIN support s USING (coalition_id, ord, cell) GROUP BY 1""",
    "support",
)
def context_coverage(w: Workload) -> DataFrame:
    """Coverage under stricter support minima."""
    strict = contexts.cell_support(w.nuisance(), (40, 50, 60))
    rows = contexts.coverage(w.cells(), strict)
    return rows.select(n64("ord").alias("ord"), "eligible", "covered", r6("coverage").alias("coverage"))


@query(
    """SELECT coalition_id, CAST(cell AS BIGINT) AS cell, CAST(n AS BIGINT) AS own, CAST(CASE WHEN n >= CASE ord WHEN 1 THEN 40 WHEN 2 THEN 50 ELSE 60 END THEN n ELSE sum(n) OVER (PARTITION BY coalition_id) END AS BIGINT) AS reference_rows
FROM (SELECT coalition_id, ord, cell, support AS n FROM support)""",
    "support",
)
def context_forced(w: Workload) -> DataFrame:
    """No abstention: a cell without support falls back to the coalition's pooled reference."""
    strict = contexts.cell_support(w.nuisance(), (40, 50, 60))
    pooled = strict.groupBy("coalition_id").agg(F.sum("support").alias("pooled"))
    joined = strict.join(pooled, "coalition_id")
    return joined.select(
        "coalition_id", n64("cell").alias("cell"), F.col("support").alias("own"),
        n64(F.when(F.col("supported"), F.col("support")).otherwise(F.col("pooled"))).alias("reference_rows"),
    )
