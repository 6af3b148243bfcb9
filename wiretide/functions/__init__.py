"""Column helpers built from Spark built-ins only (no Python UDFs)."""

from wiretide.functions.addresses import canonical_ip, is_private_ip, is_valid_ip
from wiretide.functions.coercion import first_value, scalar_int, scalar_ip, scalar_text
from wiretide.functions.flags import (
    ACK_BIT,
    RST_BIT,
    SYN_BIT,
    hex_flag_bits,
    text_has_flag,
)
from wiretide.functions.names import (
    looks_base64,
    registered_domain,
    shannon_entropy,
    subdomain,
    subdomain_entropy,
    url_path,
)
from wiretide.functions.scoring import (
    confidence_code,
    confidence_name,
    risk_label,
    risk_score,
    severity_code,
    severity_from_rank,
    severity_name,
    severity_rank,
    threat_level,
)
from wiretide.functions.timing import parse_window, truncate_bucket

__all__ = [
    "ACK_BIT",
    "RST_BIT",
    "SYN_BIT",
    "canonical_ip",
    "confidence_code",
    "confidence_name",
    "first_value",
    "hex_flag_bits",
    "is_private_ip",
    "is_valid_ip",
    "looks_base64",
    "parse_window",
    "registered_domain",
    "risk_label",
    "risk_score",
    "scalar_int",
    "scalar_ip",
    "scalar_text",
    "severity_code",
    "severity_from_rank",
    "severity_name",
    "severity_rank",
    "shannon_entropy",
    "subdomain",
    "subdomain_entropy",
    "text_has_flag",
    "threat_level",
    "truncate_bucket",
    "url_path",
]
