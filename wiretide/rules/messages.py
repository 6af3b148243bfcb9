"""Texts of findings, as printf patterns for ``format_string``."""

PORT_SCAN_TITLE = "Port scan detected from %s"
PORT_SCAN_TEXT = (
    "Source %s connected to %d distinct ports across %d hosts (%.1f connections/min, "
    "failed ratio %.0f%%, %.1f ports/host). Pattern: %s. "
    "This is indicative of reconnaissance or port-scanning activity."
)
PORT_SCAN_VERTICAL = "vertical scan (many ports on few targets)"
PORT_SCAN_HORIZONTAL = "horizontal scan (few ports across many targets)"
PORT_SCAN_OTHER = "reconnaissance activity"
PORT_SCAN_ADVICE = (
    "Investigate host %s for malicious scanning activity. Consider rate-limiting inbound "
    "connections or deploying an IPS/IDS to block automated scanners."
)

DNS_TITLE = "Potential DNS tunneling detected: %s"
DNS_TEXT = (
    "Domain %s exhibits %d/5 DNS-tunneling indicators: base64_ratio=%.2f%%, subdomains=%d, "
    "entropy=%.2f, query_rate=%.1f/min. This pattern is consistent with data exfiltration or "
    "C2 communication over DNS."
)
DNS_ADVICE = (
    "Review DNS queries to %s originating from %s. Consider blocking or sinkholing the domain "
    "if confirmed malicious. Inspect subdomain payloads for encoded data."
)

FTP_TITLE = "FTP brute force detected from %s"
FTP_TEXT = (
    "Source %s performed %d failed FTP authentications (%.0f%% failure rate) at %.2f "
    "attempts/sec. This is consistent with credential stuffing or brute-force attack."
)
FTP_ADVICE = (
    "Block or rate-limit FTP connections from %s. Enable account lockout policies and review "
    "logs for compromised credentials. Consider moving to key-based or multi-factor "
    "authentication."
)

SMTP_TITLE = "SMTP abuse detected from %s"
SMTP_TEXT = (
    "Source %s sent %d messages to %d unique recipients (%d failed auths, %d connections). %s"
)
SMTP_SPAM = "The high recipient count suggests a spam or phishing campaign."
SMTP_STUFFING = "The elevated auth failures suggest credential stuffing activity."
SMTP_RELAY = "This may indicate unauthorized relay or compromised account use."
SMTP_ADVICE = (
    "Review SMTP relay logs for source %s. Consider blocking if unauthorized. Implement rate "
    "limiting, SPF/DKIM/DMARC, and ensure relay is restricted to authenticated users."
)

SYN_TITLE = "SYN Flood from %s"
SYN_TEXT = "Detects TCP SYN flood attacks by high SYN counts with low ACK ratios"
SYN_ADVICE = (
    "Block source IP or rate-limit TCP SYN packets; enable SYN cookies on edge firewalls"
)

HTTP_TITLE = "HTTP Anomaly Detected"
HTTP_TEXT = "Detects suspicious HTTP behavior (errors, malicious UAs, unusual ports)"
HTTP_ADVICE = "Review HTTP traffic for scanners, bots, or misconfigured applications"

ICMP_TITLE = "ICMP Flood from %s"
ICMP_TEXT = "Detects ICMP flood attacks by high packet rates or burst volumes"
ICMP_ADVICE = "Block source IP if unsolicited ICMP; enable ICMP rate-limiting on edge routers"

TALKER_TITLE = "Top Talker: %s → %s"
TALKER_TEXT = "Detects flows consuming an outsized share of total traffic"
TALKER_ADVICE = "Investigate source IP for data exfiltration or misconfigured application"

BEACON_TITLE = "Beaconing %s → %s"
BEACON_TEXT = (
    "Detects periodic beaconing traffic by low interval variance and small packet sizes"
)
BEACON_ADVICE = (
    "Investigate periodic outbound connections for C2 beaconing or telemetry exfiltration"
)

OUTBOUND_TITLE = "Large outbound transfer %s → %s: %,d B"
OUTBOUND_TEXT = "Detects large data transfers to external (non-RFC1918) destinations"
OUTBOUND_ADVICE = (
    "Investigate the source host for data exfiltration. Review destination IP reputation and "
    "block if malicious."
)
