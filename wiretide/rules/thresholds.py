"""Detection thresholds. Results depend on these numbers."""

# NET-001 port scan
PORT_SCAN_RATIO = 0.7
PORT_SCAN_CPM_LOW = 50.0
PORT_SCAN_CPM_MEDIUM = 150.0
PORT_SCAN_CPM_HIGH = 600.0
PORT_SCAN_PORTS_MEDIUM = 20
PORT_SCAN_PORTS_HIGH = 50
PORT_SCAN_PORTS_CRITICAL = 200
PORT_SCAN_PORTS_PER_HOST = 50.0

# NET-002 DNS tunnelling (rates in queries per minute)
DNS_BASE64_SUSPECT = 0.3
DNS_BASE64_HIGH = 0.7
DNS_SUBDOMAINS_SUSPECT = 20
DNS_SUBDOMAINS_HIGH = 50
DNS_ENTROPY_SUSPECT = 4.0
DNS_ENTROPY_HIGH = 5.5
DNS_DOMAIN_RATE_SUSPECT = 60.0
DNS_DOMAIN_RATE_HIGH = 200.0
DNS_IP_RATE_SUSPECT = 20.0

# NET-003 FTP brute force
FTP_FAILED_RATIO = 0.7
FTP_FAILED_MIN = 3
FTP_RATE_SUSPECT = 0.3
FTP_RATE_HIGH = 1.0

# NET-004 SMTP abuse
SMTP_FAILED_SUSPECT = 3
SMTP_RECIPIENTS_SUSPECT = 25
SMTP_RECIPIENTS_HIGH = 100
SMTP_MESSAGES_SUSPECT = 5
SMTP_MESSAGES_HIGH = 20

# NET-005 SYN flood
SYN_COUNT_SUSPECT = 20
SYN_COUNT_HIGH = 100
SYN_ACK_RATIO_MIN = 0.1
SYN_DURATION_MS_MAX = 5_000

# NET-006 HTTP anomaly
HTTP_ERROR_RATIO = 0.5
HTTP_PATH_SHARE = 0.7
HTTP_SCANNER_AGENTS = (
    "nmap", "sqlmap", "nikto", "masscan", "wpscan", "curl", "python-requests",
)

# NET-007 ICMP flood
ICMP_PPS_SUSPECT = 50
ICMP_PPS_HIGH = 200
ICMP_PACKETS_SUSPECT = 100

# NET-008 top talker
TALKER_RATE_SUSPECT = 5.0
TALKER_RATE_HIGH = 20.0
TALKER_BYTES_SUSPECT = 1_000_000
TALKER_SHARE = 0.5

# NET-009 beaconing
BEACON_VARIATION_SUSPECT = 0.3
BEACON_VARIATION_HIGH = 0.05
BEACON_PACKETS_MIN = 10
BEACON_SIZE_MAX = 200
BEACON_DURATION_MS_MIN = 5_000

# NET-010 cleartext credentials
LOGIN_KEYWORDS = ("login", "signin", "auth", "authenticate", "token", "password")
CLEARTEXT_REPEATED = 5

# NET-011 large outbound transfer
OUTBOUND_BYTES_MIN = 100_000_000
OUTBOUND_SECONDS_MIN = 1.0
OUTBOUND_UPLOAD_SHARE = 0.3
OUTBOUND_WEB_PORTS = (80, 443, 8080)

# Suspicious volume (optional rule)
VOLUME_DEVIATION_CRITICAL = 10.0
VOLUME_DEVIATION_HIGH = 5.0
VOLUME_DEVIATION_MEDIUM = 2.0
VOLUME_BYTES = 100_000_000
