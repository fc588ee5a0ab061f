"""Table layouts, names and fixed values shared by every module.

The panel table is keyed ``(case_id, role, service, i)``; ``role`` is ``case``
for the window under study and ``reference`` for its baseline window.
"""

from __future__ import annotations

METRICS = [
    "cpu_usage",
    "memory_usage",
    "request_rate",
    "error_rate",
    "latency",
    "network_in",
    "network_out",
]
STAT_METRICS = METRICS[:6]

SERIES_KEY = ["case_id", "role", "service"]
WINDOW_KEY = ["case_id", "role"]

# Feature names by group, in output order.
FEATURE_GROUPS = {
    "workload": [
        "global_load_ratio",
        "cpu_request_correlation",
        "cross_service_sync",
        "error_rate_delta",
        "latency_cpu_correlation",
        "change_point_magnitude",
    ],
    "behavioral": [
        "onset_gradient",
        "peak_duration",
        "cascade_score",
        "recovery_indicator",
        "affected_service_ratio",
        "variance_change_ratio",
    ],
    "context": [
        "cpu_deviation",
        "error_rate_ratio",
        "correlation_shift",
        "latency_deviation",
        "baseline_confidence",
    ],
    "statistical": [f"mean_{m}" for m in STAT_METRICS]
    + [f"std_{m}" for m in STAT_METRICS]
    + ["max_error_rate"],
    "service-level": [
        "n_services",
        "max_cpu_service_ratio",
        "max_error_service_ratio",
        "cpu_spread",
        "error_spread",
        "latency_spread",
    ],
    "extended": [
        "spectral_entropy",
        "high_freq_energy_ratio",
        "dominant_frequency",
        "network_asymmetry",
        "graph_anomaly_centrality",
        "anomaly_spread",
        "max_cpu_derivative",
        "error_rate_slope",
    ],
}

# Names of the context group in the two other context modes.
CONTEXT_COLUMNS = {
    "comparison": FEATURE_GROUPS["context"],
    "derived": [
        "anomaly_gini",
        "load_uniformity",
        "periodicity_strength",
        "correlation_coherence",
        "regime_stability",
    ],
    "external": [
        "event_active",
        "event_expected_impact",
        "time_seasonality",
        "recent_deployment",
        "context_confidence",
    ],
}

FEATURE_COLUMNS = [name for group in FEATURE_GROUPS.values() for name in group]


def feature_columns(context_mode: str = "comparison") -> list[str]:
    """The 44 feature names when the context group comes from ``context_mode``."""
    groups = {**FEATURE_GROUPS, "context": CONTEXT_COLUMNS[context_mode]}
    return [name for group in groups.values() for name in group]


# Label codes.
LABELS = {"FAULT": 0, "EXPECTED_LOAD": 1, "UNKNOWN": 2}
FAULT, EXPECTED_LOAD, UNKNOWN = 0, 1, 2

# Column suffix of a wide recording -> canonical metric.
METRIC_ALIASES = {
    "cpu_usage": "cpu_usage",
    "memory_usage": "memory_usage",
    "request_rate": "request_rate",
    "error_rate": "error_rate",
    "latency": "latency",
    "network_in": "network_in",
    "network_out": "network_out",
    "cpu": "cpu_usage",
    "mem": "memory_usage",
    "load": "request_rate",
    "error": "error_rate",
    "workload": "request_rate",
    "latency-50": "latency",
    "latency-90": "latency",
    "diskio": "network_in",
    "socket": "network_out",
}

# Fault tokens that may occur in a recording's directory name.
FAULT_TOKENS = ["cpu", "mem", "disk", "delay", "loss", "socket", "f1", "f2", "f3", "f4", "f5"]

# Detailed fault type -> benchmark fault type.
FAULT_TAXONOMY = {
    "cpu_hog": "cpu",
    "memory_leak": "mem",
    "network_delay": "delay",
    "packet_loss": "loss",
    "disk_io": "disk",
    "pod_failure": "socket",
    "dns_failure": "socket",
    "connection_pool_exhaustion": "socket",
    "thread_leak": "cpu",
    "config_error": "cpu",
    "dependency_failure": "delay",
}

# Names of the metrics file of a recording, best first.
METRICS_FILES = ["simple_metrics.csv", "simple_data.csv", "metrics.csv", "data.csv"]

# Neighbours of each service of the demo shop.
SERVICE_EDGES = {
    "frontend": ["cart", "checkout", "productcatalog", "recommendation", "ad", "currency"],
    "cart": ["frontend", "redis-cart"],
    "checkout": ["frontend", "cart", "payment", "shipping", "email", "currency", "productcatalog"],
    "payment": ["checkout"],
    "shipping": ["checkout"],
    "email": ["checkout"],
    "currency": ["frontend", "checkout"],
    "productcatalog": ["frontend", "checkout", "recommendation"],
    "recommendation": ["frontend", "productcatalog"],
    "ad": ["frontend"],
    "redis-cart": ["cart"],
}

# Probability of each severity by difficulty profile.
SEVERITY_PROFILES = {
    "default": {"low": 0.35, "medium": 0.35, "high": 0.30},
    "moderate": {"low": 0.60, "medium": 0.25, "high": 0.15},
    "hard": {"low": 0.85, "medium": 0.12, "high": 0.03},
}

EPS = 1e-10
