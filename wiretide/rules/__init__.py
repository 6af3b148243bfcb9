"""Detection rules."""

from wiretide.rules import flow_rules, host_rules
from wiretide.rules.base import Rule, RuleRegistry, evidence, make_finding

# In evaluation order.
BUILT_IN = (
    Rule("NET-001", "Port Scan Detection", "profiles", host_rules.port_scan),
    Rule("NET-002", "DNS Tunneling Detection", "dns", host_rules.dns_tunneling),
    Rule("NET-003", "FTP Brute Force Detection", "ftp", host_rules.ftp_brute_force),
    Rule("NET-004", "SMTP Abuse Detection", "smtp", host_rules.smtp_abuse),
    Rule("NET-005", "SYN Flood", "flows", flow_rules.syn_flood),
    Rule("NET-007", "ICMP Flood", "flows", flow_rules.icmp_flood),
    Rule("NET-006", "HTTP Anomaly", "http", host_rules.http_anomaly),
    Rule("NET-008", "Top Talker", "flows", flow_rules.top_talker),
    Rule("NET-009", "Beaconing", "flows", flow_rules.beaconing),
    Rule("NET-010", "Cleartext Credentials", "logins", host_rules.cleartext_credentials),
    Rule("NET-011", "Large Outbound Transfer", "flows", flow_rules.large_outbound),
)
SUSPICIOUS_VOLUME = Rule(
    "VOL-001", "Suspicious Traffic Volume", "flows", flow_rules.suspicious_volume
)


def default_registry() -> RuleRegistry:
    """All eleven built-in rules."""
    return RuleRegistry(BUILT_IN)


__all__ = [
    "BUILT_IN",
    "Rule",
    "RuleRegistry",
    "SUSPICIOUS_VOLUME",
    "default_registry",
    "evidence",
    "make_finding",
]
