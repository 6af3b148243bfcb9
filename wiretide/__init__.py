"""Network-traffic and security analytics as Spark DataFrame operators.

The main steps are importable from here; single operators live in the sub-packages.
"""

from wiretide.plans.context import context_summary
from wiretide.plans.detect import (
    Detection,
    overall_risk,
    overall_risk_worst_first,
    run_rules,
)
from wiretide.plans.features import (
    EventFeatures,
    Features,
    Tables,
    extract_features,
    feature_bundle,
)
from wiretide.rules import Rule, RuleRegistry, default_registry
from wiretide.sources.dissected import parse_packets, read_packets
from wiretide.streaming.rules import RuleStream, start_rule_stream

__version__ = "0.1.0"

__all__ = [
    "Detection",
    "EventFeatures",
    "Features",
    "Rule",
    "RuleRegistry",
    "RuleStream",
    "Tables",
    "context_summary",
    "default_registry",
    "extract_features",
    "feature_bundle",
    "overall_risk",
    "overall_risk_worst_first",
    "parse_packets",
    "read_packets",
    "run_rules",
    "start_rule_stream",
]
