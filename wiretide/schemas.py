"""Record schemas. Every table carries a grouping key: capture_id, or session_id on streams."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _TS, _B = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.TimestampType(),
    T.BooleanType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Protocol domain.
TRANSPORTS = ("TCP", "UDP", "ICMP")
PROTOCOLS = ("TCP", "UDP", "ICMP", "HTTP", "DNS", "FTP", "SMTP")

PACKETS = _struct(
    capture_id=_S, packet_number=_L, ts=_TS, src_ip=_S, dst_ip=_S, src_port=_I, dst_port=_I,
    protocol=_S, length=_L, info=_S, tcp_flags=_S,
)
DNS_RECORDS = _struct(
    capture_id=_S, seq=_L, ts=_TS, src_ip=_S, dst_ip=_S, qname=_S, qtype=_S, response_code=_S,
    answers=T.ArrayType(_S), query_size_bytes=_L,
)
HTTP_RECORDS = _struct(
    capture_id=_S, seq=_L, ts=_TS, src_ip=_S, dst_ip=_S, method=_S, host=_S, uri=_S,
    status_code=_I, user_agent=_S, content_type=_S, request_length=_L,
)
FTP_RECORDS = _struct(
    capture_id=_S, seq=_L, ts=_TS, src_ip=_S, dst_ip=_S, command=_S, argument=_S,
    response_code=_I, response_message=_S,
)
SMTP_RECORDS = _struct(
    capture_id=_S, seq=_L, ts=_TS, src_ip=_S, dst_ip=_S, command=_S, argument=_S,
    response_code=_I, mail_from=_S, rcpt_to=T.ArrayType(_S),
)
# Wire form of a live event: numbers are read as text so that a bad value rejects one event
# and not the file.
RAW_EVENTS = _struct(
    ts=_S, src_ip=_S, dst_ip=_S, src_port=_S, dst_port=_S, protocol=_S, bytes=_S, packets=_S,
    flags=_S, http_method=_S, http_uri=_S, http_host=_S, http_status=_S, http_user_agent=_S,
    dns_qname=_S, dns_qtype=_S, session_id=_S, collector_id=_S,
)
FLOW_EVENTS = _struct(
    seq=_L, ts=_TS, src_ip=_S, dst_ip=_S, src_port=_I, dst_port=_I, protocol=_S, bytes=_L,
    packets=_L, flags=_S, http_method=_S, http_uri=_S, http_host=_S, http_status=_I,
    http_user_agent=_S, dns_qname=_S, dns_qtype=_S, session_id=_S, collector_id=_S,
)
FLOWS = _struct(
    capture_id=_S, src_ip=_S, dst_ip=_S, src_port=_I, dst_port=_I, protocol=_S,
    packets_total=_L, bytes_total=_L, duration_ms=_D, start_time=_TS, end_time=_TS,
    src_bytes=_L, dst_bytes=_L, syn_count=_L, rst_count=_L, ack_count=_L,
    inter_packet_interval_ms=_D, inter_packet_interval_variance_ms=_D,
)
GROUND_TRUTH = _struct(
    capture_id=_S, pcap_file=_S, attack_present=_B, attack_types=T.ArrayType(_S),
    source_ips=T.ArrayType(_S), notes=_S, unknown_keys=T.ArrayType(_S),
)
EVIDENCE = _struct(key=_S, value=_S, threshold=_S, unit=_S)
