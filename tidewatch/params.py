"""Parameters of the analysis. Fixed values come first, test-size settings last."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values ---------------------------------------------------------------
MISSING_PROTOCOL = "UNKNOWN_PROTO"
MISSING_SERVICE = "UNKNOWN_SERVICE"
MISSING_FIELD = "-"
UNKNOWN_GROUP = "UNKNOWN_PROTOCOL"
FLOW_REQUIRED = ("ts", "src_ip", "proto", "service", "label", "type")
PACKET_REQUIRED = ("frame.time", "ip.src_host", "Attack_label", "Attack_type")
PROTOCOL_PREFIXES = ("arp.", "http.", "tcp.", "udp.", "icmp.", "mqtt.", "mbtcp.")
UNRESOLVED_PAYLOADS = ("", "-", "0", "0.0", "0.0.0.0")
FLOW_ATTACK_TYPES = (
    "normal", "backdoor", "dos", "ddos", "injection",
    "mitm", "password", "ransomware", "scanning", "xss",
)
PACKET_ATTACK_TYPES = (
    "Normal", "DDoS_UDP", "DDoS_ICMP", "DDoS_TCP", "DDoS_HTTP", "SQL_injection", "Uploading",
    "Backdoor", "Port_Scanning", "Vulnerability_scanner", "Password", "XSS", "Ransomware",
    "Fingerprinting", "MITM",
)
FLOW_EXTENSION_PREFIXES = ("dns_", "ssl_", "http_", "weird_")
PARTITIONS = (
    "detector_fit", "nuisance_fit", "threshold_and_policy_calibration", "heldout_benign",
)
DETECTOR_FAMILIES = ("Isolation Forest", "One-Class SVM", "Autoencoder")
OPERATIONAL_COMPENSATOR = 0.125
MESSAGE_BYTES = 20
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Params:
    """Production settings of the published study."""

    epoch_seconds: int = 60
    hash_buckets: int = 64
    iqr_floor: float = 1e-6
    fractions: tuple[float, float, float] = (0.1, 0.18, 0.36)
    horizon: int = 60
    warmup: int = 200
    merge_gap: int = 10
    first_activity_window: int = 10
    minimum_duration: int = 3
    minimum_benign_records: int = 5000
    minimum_benign_epochs: int = 600
    target_clients: int = 12
    minimum_clients: int = 6
    maximum_order: int = 3
    support_clients: int = 2
    support_window: int = 5
    material_evidence: float = 1.25
    outside_lag: int = 1
    outside_minimum: int = 2
    outside_fraction: float = 0.5
    rank_epsilon: float = 1e-12
    histogram_bins: int = 8
    cells: int = 4
    kmeans_restarts: int = 20
    kmeans_iterations: int = 300
    kmeans_tolerance: float = 1e-4
    tie_tolerance: float = 1e-12
    context_seed: int = 4100
    support_minima: tuple[int, int, int] = (100, 200, 400)
    basis_size: int = 3
    folds: int = 5
    ridge_candidates: tuple[float, ...] = (0.0, 1e-4, 1e-3, 1e-2, 1e-1, 1.0)
    svd_cutoff: float = 1e-12
    condition_limit: float = 1e6
    scale_floor: float = 1e-6
    norm_floor: float = 1e-6
    clip_bound: float = 1.0
    bet: float = 0.5
    norm_quantile: float = 0.95
    arl_alpha: float = 0.001
    pfa_target: float = 0.05
    confidence: float = 0.95
    thresholds: tuple[float, ...] = (2, 3, 5, 10, 20, 50, 100, 200, 500, 1000)
    policy_quantiles: tuple[float, ...] = (0.99, 0.995, 0.999, 0.9995, 0.9999)
    persistence: tuple[tuple[int, int], ...] = ((1, 1), (2, 3), (3, 5))
    cusum_center: float = 0.5
    cusum_drift: float = 0.05
    denominator_floor: float = 1e-12
    stress_stride: int = 1
    stress_fraction: float = 0.01
    stress_factors: tuple[float, ...] = (1.25, 1.5, 2.0)
    dataset: str = "network"
    isolation_trees: int = 300
    isolation_cap: int = 256
    rbf_features: int = 512
    encoder_passes: int = 50
    encoder_rate: float = 0.001
    encoder_batch: int = 128
    federated_rounds: int = 50
    federated_passes: int = 1
    table_bins: int = 4
    pseudocount: float = 0.5
    ipf_iterations: int = 10_000
    ipf_tolerance: float = 1e-8
    probability_floor: float = 1e-12
    factor_ranks: tuple[int, ...] = (1, 2, 3)
    factor_target: float = 0.8
    factor_fallback: int = 3
    bootstrap_replicates: int = 10_000
    exact_flip_limit: int = 100_000
    statistics_seed: int = 3000


@dataclass(frozen=True)
class WorkloadParams(Params):
    """Settings that fit the hourly event table used for checks and benches."""

    epoch_seconds: int = 3600
    hash_buckets: int = 8
    horizon: int = 6
    warmup: int = 6
    merge_gap: int = 2
    minimum_duration: int = 2
    minimum_benign_records: int = 20
    minimum_benign_epochs: int = 10
    cells: int = 2
    basis_size: int = 2
    support_minima: tuple[int, int, int] = (10, 15, 20)
    pfa_target: float = 0.3
    rbf_features: int = 16
    encoder_passes: int = 20
    encoder_batch: int = 32
    federated_rounds: int = 3
    ipf_tolerance: float = 1e-12
    bootstrap_replicates: int = 2000
    thresholds: tuple[float, ...] = (1.2, 1.4, 1.6, 1.8, 2.0, 2.1, 2.2, 2.3, 2.5, 3.0)
    material_evidence: float = 0.9
    policy_quantiles: tuple[float, ...] = (0.9, 0.95, 0.99)
    site_count: int = 12
    attack_value: float = 200.0
    # settings of the small fit whose results plain SQL can confirm
    check_basis: int = 1
    check_order: int = 2
    check_candidates: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0)
