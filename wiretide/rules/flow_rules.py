"""Rules over single flows. ``flows`` rows carry their group's totals as ``group_bytes`` and
``group_seconds``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiretide.functions.addresses import is_private_ip
from wiretide.functions.scoring import confidence_code
from wiretide.rules import messages as M
from wiretide.rules import thresholds as T
from wiretide.rules.base import evidence, make_finding


def _c(name: str) -> Column:
    return F.col(name)


def _count(*flags: Column) -> Column:
    total = F.lit(0)
    for flag in flags:
        total = total + F.coalesce(flag.cast("int"), F.lit(0))
    return total


def _flow_finding(fires: Column, title: Column, text: str, advice: str, **rest) -> Column:
    return make_finding(
        fires,
        entity=_c("src_ip"),
        subject=F.concat_ws(
            "|", "src_ip", _c("src_port").cast("string"), "dst_ip",
            _c("dst_port").cast("string"), "protocol",
        ),
        title=title,
        description=F.lit(text),
        recommendation=F.lit(advice),
        entities=F.array("src_ip", "dst_ip"),
        start=_c("start_time"),
        end=_c("end_time"),
        **rest,
    )


def _bump(raw: Column, *steps: tuple[Column, float]) -> Column:
    """Add each step's points where its condition holds, then cut at 1."""
    for condition, points in steps:
        raw = raw + F.when(condition, points).otherwise(0.0)
    return F.least(raw, F.lit(1.0))


def syn_flood() -> Column:
    syn, ack = _c("syn_count"), _c("ack_count")
    duration = F.greatest(_c("duration_ms"), F.lit(1.0))
    pps = _c("packets_total") / (duration / 1000.0)
    ack_ratio = ack / F.greatest(syn, F.lit(1))
    unanswered = ack_ratio < T.SYN_ACK_RATIO_MIN
    burst = (duration < T.SYN_DURATION_MS_MAX) & (syn >= T.SYN_COUNT_HIGH)
    raw = _bump(
        0.3 + 0.5 * (syn / F.lit(T.SYN_COUNT_HIGH)),
        (unanswered, 0.3),
        (syn >= T.SYN_COUNT_HIGH, 0.2),
    )
    return _flow_finding(
        (F.upper("protocol") == "TCP") & (syn >= T.SYN_COUNT_SUSPECT) & (unanswered | burst),
        F.format_string(M.SYN_TITLE, "src_ip"),
        M.SYN_TEXT,
        M.SYN_ADVICE,
        raw=raw,
        confidence=confidence_code(_count(unanswered, burst), 2),
        evidences=[
            evidence(
                "syn_ack_ratio", F.round(ack_ratio, 2), T.SYN_ACK_RATIO_MIN, when=unanswered
            ),
            evidence("syn_pps", F.round(pps, 1), T.SYN_COUNT_HIGH, "pps", when=burst),
        ],
        snapshot={
            "syn_count": syn,
            "ack_count": ack,
            "ack_ratio": F.round(ack_ratio, 2),
            "pps": F.round(pps, 1),
        },
    )


def icmp_flood() -> Column:
    packets = _c("packets_total")
    duration = F.greatest(_c("duration_ms"), F.lit(1.0))
    pps = packets / (duration / 1000.0)
    fast, many = pps >= T.ICMP_PPS_SUSPECT, packets >= T.ICMP_PACKETS_SUSPECT
    raw = _bump(
        0.2 + 0.6 * F.least(packets / F.lit(T.ICMP_PACKETS_SUSPECT), F.lit(1.0)),
        (pps >= T.ICMP_PPS_HIGH, 0.2),
    )
    return _flow_finding(
        (F.upper("protocol") == "ICMP") & (fast | many),
        F.format_string(M.ICMP_TITLE, "src_ip"),
        M.ICMP_TEXT,
        M.ICMP_ADVICE,
        raw=raw,
        confidence=confidence_code(_count(fast, many), 2),
        evidences=[
            evidence("icmp_pps", F.round(pps, 1), T.ICMP_PPS_SUSPECT, "pps", when=fast),
            evidence("icmp_total_pkts", packets, T.ICMP_PACKETS_SUSPECT, when=many),
        ],
        snapshot={
            "total_pkts": packets,
            "pps": F.round(pps, 1),
            "duration_ms": F.round(duration, 1),
        },
    )


def top_talker() -> Column:
    volume = _c("bytes_total")
    share = volume / F.greatest(_c("group_bytes"), F.lit(1))
    bps = volume / F.greatest(_c("group_seconds"), F.lit(1.0))
    big, fast = volume >= T.TALKER_BYTES_SUSPECT, bps >= T.TALKER_RATE_SUSPECT
    raw = _bump(F.least(0.4 + share * 0.6, F.lit(1.0)), (bps >= T.TALKER_RATE_HIGH, 0.2))
    return _flow_finding(
        share >= T.TALKER_SHARE,
        F.format_string(M.TALKER_TITLE, "src_ip", "dst_ip"),
        M.TALKER_TEXT,
        M.TALKER_ADVICE,
        raw=raw,
        confidence=confidence_code(_count(F.lit(True), big, fast), 3),
        evidences=[
            evidence("traffic_share", F.round(share, 3), T.TALKER_SHARE),
            evidence("total_bytes", volume, T.TALKER_BYTES_SUSPECT, "B", when=big),
            evidence("bytes_per_sec", F.round(bps, 1), T.TALKER_RATE_SUSPECT, "B/s", when=fast),
        ],
        snapshot={
            "bytes_total": volume,
            "traffic_share": F.round(share, 4),
            "bytes_per_sec": F.round(bps, 1),
            "packets_total": _c("packets_total"),
        },
    )


def beaconing() -> Column:
    packets = _c("packets_total")
    size = _c("bytes_total") / F.greatest(packets, F.lit(1))
    mean, variance = _c("inter_packet_interval_ms"), _c("inter_packet_interval_variance_ms")
    variation = F.when(mean > 0, F.sqrt(variance) / mean)
    raw = _bump(
        0.3
        + 0.5
        * (1 - F.least(variation / F.lit(T.BEACON_VARIATION_SUSPECT), F.lit(1.0))),
        (size < T.BEACON_SIZE_MAX / 2, 0.1),
        (variation < T.BEACON_VARIATION_HIGH, 0.2),
    )
    return _flow_finding(
        (packets >= T.BEACON_PACKETS_MIN)
        & (F.greatest(_c("duration_ms"), F.lit(1.0)) >= T.BEACON_DURATION_MS_MIN)
        & (size < T.BEACON_SIZE_MAX)
        & (mean > 0)
        & (variation < T.BEACON_VARIATION_SUSPECT),
        F.format_string(M.BEACON_TITLE, "src_ip", "dst_ip"),
        M.BEACON_TEXT,
        M.BEACON_ADVICE,
        raw=raw,
        # firing needs all three indicators
        confidence=confidence_code(F.lit(3), 3),
        evidences=[
            evidence("beacon_pkt_count", packets, T.BEACON_PACKETS_MIN),
            evidence("beacon_avg_size", F.round(size, 1), T.BEACON_SIZE_MAX, "B"),
            evidence("beacon_cv", F.round(variation, 3), T.BEACON_VARIATION_SUSPECT),
        ],
        snapshot={
            "pkt_count": packets,
            "avg_size": F.round(size, 1),
            "cv": F.round(variation, 4),
            "interval_ms": F.round(mean, 1),
            "interval_variance_ms": F.round(variance, 1),
        },
    )


def large_outbound() -> Column:
    volume, sent = _c("bytes_total"), _c("src_bytes")
    seconds = _c("duration_ms") / 1000.0
    share = sent / F.greatest(volume, F.lit(1))
    upload = share > T.OUTBOUND_UPLOAD_SHARE
    raw = _bump(
        F.lit(0.4),
        (upload, 0.3),
        (_c("dst_port").isin(*T.OUTBOUND_WEB_PORTS), 0.1),
        (F.upper("protocol") == "TCP", 0.1),
    )
    return _flow_finding(
        (seconds >= T.OUTBOUND_SECONDS_MIN)
        & (volume >= T.OUTBOUND_BYTES_MIN)
        & ~is_private_ip(_c("dst_ip"))
        & is_private_ip(_c("src_ip")),
        F.format_string(M.OUTBOUND_TITLE, _c("src_ip"), _c("dst_ip"), volume),
        M.OUTBOUND_TEXT,
        M.OUTBOUND_ADVICE,
        raw=raw,
        confidence=F.when(upload, F.lit(3)).otherwise(F.lit(2)),
        evidences=[
            evidence("outbound_bytes", volume, T.OUTBOUND_BYTES_MIN, "B"),
            evidence("upload_ratio", F.round(share, 3), T.OUTBOUND_UPLOAD_SHARE),
            evidence("duration_sec", F.round(seconds, 1), T.OUTBOUND_SECONDS_MIN, "s"),
        ],
        snapshot={
            "bytes_total": volume,
            "src_bytes": sent,
            "upload_ratio": F.round(share, 3),
            "duration_sec": F.round(seconds, 1),
            "dst_port": _c("dst_port"),
        },
    )


def suspicious_volume() -> Column:
    """Optional: flow rate far above the group's rate, or a very large upload."""
    volume = _c("bytes_total")
    seconds = F.greatest(_c("duration_ms") / 1000.0, F.lit(0.001))
    expected = F.greatest(_c("group_rate"), F.lit(0.001))
    times = volume / seconds / expected
    upload = _c("src_bytes") > _c("dst_bytes")
    deviation = F.least(F.lit(100.0), (times - 1) * 100 / 10)
    upload_points = F.when(upload & (deviation > 50), 70.0).otherwise(0.0)
    volume_points = F.least(F.lit(100.0), volume / F.lit(T.VOLUME_BYTES) * 100)
    raw = (deviation * 0.5 + F.greatest(upload_points, volume_points * 0.5)) / 100.0
    large = volume >= T.VOLUME_BYTES
    severity = (
        F.when((times >= T.VOLUME_DEVIATION_CRITICAL) | (large & upload), 5)
        .when((times >= T.VOLUME_DEVIATION_HIGH) | large, 4)
        .when(times >= T.VOLUME_DEVIATION_MEDIUM, 3)
        .otherwise(2)
    )
    return _flow_finding(
        (times >= T.VOLUME_DEVIATION_MEDIUM) | large,
        F.format_string("Suspicious traffic volume %s → %s", "src_ip", "dst_ip"),
        "Flow rate or volume far above the rest of the capture",
        "Check whether the transfer was expected",
        raw=F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)),
        severity=severity,
        confidence=confidence_code(_count(times >= T.VOLUME_DEVIATION_HIGH, upload, large), 3),
        evidences=[
            evidence("times_baseline", F.round(times, 2), T.VOLUME_DEVIATION_MEDIUM),
            evidence("total_bytes", volume, T.VOLUME_BYTES, "B", when=large),
        ],
        snapshot={"times_baseline": F.round(times, 2), "bytes_total": volume},
    )
