"""Job parameters and the fixed values every stage agrees on."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values (contract of the flow, label and alert tables) -------------------------------

# Label domain; the position in this list is the class index.
CLASSES = (
    "benign",
    "ddos",
    "c2_beaconing",
    "dga_dns_tunnelling",
    "encrypted_malware",
    "recon_scanning",
    "data_exfiltration",
)
BENIGN = 0

# Model features by group, in vector order.
FEATURE_GROUPS = {
    "flow": ["duration", "packet_count", "byte_count", "packet_rate", "byte_rate", "avg_packet_size"],
    "connection": ["dest_fanout", "port_fanout", "flow_count"],
    "directional": ["byte_ratio", "packet_ratio"],
    "timing": ["iat_mean", "iat_std", "periodicity_score"],
    "entropy": ["entropy"],
    "dns": [
        "dns_query_length",
        "dns_entropy",
        "has_dns",
        "dns_is_A",
        "dns_is_AAAA",
        "dns_is_TXT",
        "dns_is_NS",
    ],
    "tls": ["has_tls", "tls_sni_length"],
}

# Ablation stages: each adds groups to the one before.
ABLATION_STAGES = {
    "flow_only": ["flow"],
    "flow_plus_behavioral": ["flow", "connection", "directional", "timing", "entropy"],
    "plus_dns": ["flow", "connection", "directional", "timing", "entropy", "dns"],
    "plus_tls": ["flow", "connection", "directional", "timing", "entropy", "dns", "tls"],
}

IDENTITY_COLUMNS = ["flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
NUMERIC_COLUMNS = [
    "duration",
    "packet_count",
    "byte_count",
    "packet_rate",
    "byte_rate",
    "avg_packet_size",
    "byte_ratio",
    "packet_ratio",
    "dest_fanout",
    "port_fanout",
    "flow_count",
    "entropy",
    "dns_query_length",
    "dns_entropy",
    "iat_mean",
    "iat_std",
    "periodicity_score",
]
CATEGORICAL_COLUMNS = ["dns_record_type", "tls_ja3", "tls_ja3s", "tls_ja4", "tls_sni"]

# DNS query type codes that get a name; every other code is OTHER.
DNS_TYPES = {1: "A", 28: "AAAA", 5: "CNAME", 15: "MX", 16: "TXT", 2: "NS", 6: "SOA", 33: "SRV"}

# Attack type of an experiment log entry -> class.
ATTACK_LABELS = {
    "syn_flood": "ddos",
    "udp_flood": "ddos",
    "port_scan": "recon_scanning",
    "host_scan": "recon_scanning",
    "dns_tunnel": "dga_dns_tunnelling",
    "dga": "dga_dns_tunnelling",
    "c2_beacon": "c2_beaconing",
    "tls_malware": "encrypted_malware",
    "exfil": "data_exfiltration",
    "benign": "benign",
}

# Severity by verifier confidence (first row whose floor is reached), and the default below.
SEVERITY_FLOORS = [(0.90, "CRITICAL"), (0.75, "HIGH"), (0.50, "MEDIUM")]
SEVERITY_DEFAULT = "LOW"

# Severity by class and its weight (design-document variant).
CLASS_SEVERITY = {
    "benign": "info",
    "ddos": "critical",
    "c2_beaconing": "high",
    "dga_dns_tunnelling": "high",
    "encrypted_malware": "medium",
    "recon_scanning": "medium",
    "data_exfiltration": "critical",
}
SEVERITY_WEIGHT = {"info": 0.1, "medium": 0.5, "high": 0.8, "critical": 1.0}

# Routing, splitting and reporting parameters.
DEFAULT_THETA = 0.85
REFERENCE_THETAS = [0.50, 0.60, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95]
MAX_HEAVY_FRACTION = 0.40
DISAGREEMENT_FACTOR = 0.85
TRAIN_FRACTION = 0.70
VALIDATION_FRACTION = 0.15
SEQUENCE_LENGTH = 10
EVIDENCE_K = 5
EVIDENCE_SOURCE = "xgboost_triage"
TARGET_RATES = [100, 500, 1000, 5000]
RATE_WINDOW_SECONDS = 10.0
TRIAGE_ONLY_FLOOR = 0.90
LIGHT_FLOOR = 0.60
INCIDENT_WINDOW_SECONDS = 300
INCIDENT_RISK = 0.85
INCIDENT_CLASSES = 2
SEED = 42

# --- Derived -----------------------------------------------------------------------------------

FEATURE_COLUMNS = [c for group in FEATURE_GROUPS.values() for c in group]
FLOW_COLUMNS = IDENTITY_COLUMNS + NUMERIC_COLUMNS + CATEGORICAL_COLUMNS
THETA_GRID = sorted({round(0.50 + 0.02 * i, 2) for i in range(25)} | set(REFERENCE_THETAS))
MICROS = 1_000_000
REPLAY_HISTORY_CAP = 512
REPLAY_SOURCE_CAP = 10_000


@dataclass(frozen=True)
class FlowConfig:
    """Timeouts and bounds that change results.

    A cap that is not set holds in the replay modes alone, which promise what a bounded memory sees.
    """

    tcp_timeout_s: float = 120.0
    udp_timeout_s: float = 60.0
    other_timeout_s: float = 30.0
    history_cap: int | None = None
    source_window_s: float = 60.0
    source_cap: int | None = None
    initiator: str = "canonical"  # or "first_packet"

    def timeout_s(self, protocol: str | None) -> float:
        by_name = {"TCP": self.tcp_timeout_s, "UDP": self.udp_timeout_s}
        return by_name.get((protocol or "").upper(), self.other_timeout_s)

    def history(self, mode: str) -> int | None:
        """Packets of a flow that its history keeps."""
        return REPLAY_HISTORY_CAP if self.history_cap is None and mode == "replay_exact" else self.history_cap

    def openings(self, mode: str) -> int | None:
        """Opened flows of a source that are remembered."""
        return REPLAY_SOURCE_CAP if self.source_cap is None and mode == "replay_visible" else self.source_cap

    @property
    def source_window_us(self) -> int:
        return int(round(self.source_window_s * MICROS))


DEFAULT = FlowConfig()


def stage_features(stage: str) -> list[str]:
    """Feature columns of one ablation stage, in vector order."""
    return [c for group in ABLATION_STAGES[stage] for c in FEATURE_GROUPS[group]]
