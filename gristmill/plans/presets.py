"""Named bundles of options for a review, and how two of them differ."""

from __future__ import annotations

# The bundles.
PRESETS: dict[str, dict] = {
    "security": {"types": ["security"], "min_severity": "medium", "fail_on_critical": True, "high_threshold": 0},
    "performance": {"types": ["performance"], "min_severity": "medium", "fail_on_critical": False, "high_threshold": 5},
    "quick": {"types": ["security", "correctness"], "min_severity": "high", "max_findings": 20, "fail_on_critical": True},
}


def compare(a: str, b: str) -> dict[str, tuple]:
    """Options in which two presets differ, with both values (None where one has none)."""
    x, y = PRESETS[a], PRESETS[b]
    return {k: (x.get(k), y.get(k)) for k in sorted({*x, *y}) if x.get(k) != y.get(k)}


def merged(*layers: dict) -> dict:
    """Options of several layers, later ones first; nested options are merged, not replaced."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
