"""Fixed domains of the screening model: severities, method weights, ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "clean": 0}
RISK_NAME = ["clean", "low", "medium", "high", "critical"]
WEIGHTS = {
    "clone_detection": 0.85, "phash": 0.90, "pvalue_check": 0.80, "tortured_phrases": 0.80, "ela": 0.70, "llm_vision": 0.70,
    "llm_screening": 0.70, "variance_ratio": 0.70, "sprite": 0.65, "grim": 0.60, "grimmer": 0.60, "noise_analysis": 0.50,
    "terminal_digit": 0.45, "distribution_fit": 0.40, "dct_analysis": 0.30, "jpeg_ghost": 0.30, "benford": 0.30,
    "metadata_forensics": 0.30, "duplicate_check": 0.25, "fft_analysis": 0.15,
}
PRODUCTION_WEIGHTS = {k: v for k, v in WEIGHTS.items() if k != "metadata_forensics"} | {"duplicate_values": 0.25, "temporal_patterns": 0.50}
AUTO_RISK_WEIGHTS = {
    "hash_match": 30, "clone_detection": 25, "tortured_phrases": 25, "retraction": 20, "grim": 15, "grimmer": 15, "pvalue_check": 15,
    "variance_ratio": 15, "sprite": 12, "dct_analysis": 12, "ela": 10, "noise_analysis": 10, "pubpeer": 10, "jpeg_ghost": 10,
    "fft_analysis": 8, "terminal_digit": 8, "temporal_patterns": 8, "benford": 5,
}
COMPRESSION_METHODS = ["ela", "noise_analysis", "dct_analysis", "jpeg_ghost", "fft_analysis"]
STAGES = ["discover", "prioritize", "download", "extract_text", "extract_figures", "extract_stats", "analyze_images_auto", "analyze_stats", "classify_figures", "analyze_images_llm", "aggregate", "report"]
DEFAULT_WEIGHT = 0.5


def lookup(key: Column, values: dict, default) -> Column:
    """A CASE over a fixed domain."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def severity_rank(severity: Column) -> Column:
    return lookup(F.coalesce(severity, F.lit("low")), SEVERITY_RANK, 0)


def method_weight(method: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    return lookup(method, {k: float(v) for k, v in weights.items()}, DEFAULT_WEIGHT)


def risk_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in RISK_NAME]), (rank + 1).cast("int"))


def case_sql(key: str, values: dict, default) -> str:
    text = " ".join(f"WHEN '{k}' THEN {f'CAST({v} AS double)' if isinstance(v, float) else v}" for k, v in values.items())
    return f"CASE {key} {text} ELSE {f'CAST({default} AS double)' if isinstance(default, float) else default} END"
