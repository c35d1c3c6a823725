"""Constants of the weighted vote."""

from collections.abc import Sequence

# Order in which the methods report; ties in the consensus follow it.
RUN_ORDER = ["keyword", "regex", "agro", "commercial", "ml", "layout"]

# Vote weights, in the order that breaks ties in the final decision.
WEIGHTS = {"keyword": 0.15, "regex": 0.15, "ml": 0.10, "layout": 0.08, "agro": 0.25, "commercial": 0.22}

# Thresholds and boosts of the decision.
VOTE_MINIMUM = 0.1
STRONG_VOTES = 2
STRONG_AVERAGE = 0.5
CONSENSUS_BOOST = 0.1
PRIORITY_CONFIDENCE = 0.9
AGRO_PRIORITY = 0.3
COMMERCIAL_PRIORITY = 0.25
PENALTY_ABOVE = 0.7
PENALTY_FACTOR = 0.9
MIN_CONFIDENCE = 0.15
HIGH_CONFIDENCE = 0.8
DOMAIN_THRESHOLD = 0.3

# Confidence bands of the report view.
BAND_HIGH = 0.8
BAND_MEDIUM = 0.5


def run_order(methods: Sequence[str]) -> list[str]:
    """``methods`` in the order they report: the known ones first, then any others as they are given."""
    return [m for m in RUN_ORDER if m in methods] + [m for m in dict.fromkeys(methods) if m not in RUN_ORDER]
