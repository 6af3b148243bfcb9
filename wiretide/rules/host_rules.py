"""Rules over per-source and per-name profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiretide.functions.scoring import CRITICAL, HIGH, LOW, MEDIUM, confidence_code
from wiretide.rules import messages as M
from wiretide.rules import thresholds as T
from wiretide.rules.base import evidence, make_finding


def _c(name: str) -> Column:
    return F.col(name)


def _capped(value: Column, full: float) -> Column:
    return F.least(value / F.lit(full), F.lit(1.0))


def _n(flag: Column) -> Column:
    return F.coalesce(flag.cast("int"), F.lit(0))


def port_scan() -> Column:
    """Over connection profiles."""
    ports, hosts = _c("unique_dst_ports"), _c("unique_dst_ips")
    per_host, cpm = _c("unique_dst_ports_per_host"), _c("connections_per_minute")
    ratio, src = _c("failed_connection_ratio"), _c("src_ip")
    raw = (
        0.5 * _capped(ports, T.PORT_SCAN_PORTS_CRITICAL)
        + 0.3 * _capped(cpm, T.PORT_SCAN_CPM_HIGH)
        + 0.2 * _capped(ratio, 1.0)
        + 0.1 * (_capped(per_host, T.PORT_SCAN_PORTS_PER_HOST) * 0.5)
    )
    severity = (
        F.when((ports >= T.PORT_SCAN_PORTS_CRITICAL) | (cpm >= T.PORT_SCAN_CPM_HIGH), CRITICAL)
        .when((ports >= T.PORT_SCAN_PORTS_HIGH) | (cpm >= T.PORT_SCAN_CPM_MEDIUM), HIGH)
        .when((ports >= T.PORT_SCAN_PORTS_MEDIUM) | (cpm >= T.PORT_SCAN_CPM_LOW), MEDIUM)
        .otherwise(LOW)
    )
    fired = (
        _n(ports >= T.PORT_SCAN_PORTS_MEDIUM)
        + _n(cpm >= T.PORT_SCAN_CPM_MEDIUM)
        + _n(ratio >= T.PORT_SCAN_RATIO)
        + _n(per_host >= 10)
    )
    pattern = (
        F.when((per_host >= 10) & (hosts <= 3), M.PORT_SCAN_VERTICAL)
        .when((per_host <= 3) & (hosts > 10), M.PORT_SCAN_HORIZONTAL)
        .otherwise(M.PORT_SCAN_OTHER)
    )
    return make_finding(
        _c("port_scan_suspect"),
        entity=src,
        subject=src,
        raw=raw,
        shown_digits=4,
        severity=severity,
        confidence=confidence_code(fired, 4),
        title=F.format_string(M.PORT_SCAN_TITLE, src),
        description=F.format_string(
            M.PORT_SCAN_TEXT, src, ports, hosts, cpm, ratio * 100, per_host.cast("double"), pattern
        ),
        recommendation=F.format_string(M.PORT_SCAN_ADVICE, src),
        evidences=[
            evidence("unique_dst_ports", ports, T.PORT_SCAN_PORTS_MEDIUM, "ports"),
            evidence("failed_connection_ratio", F.round(ratio, 4), T.PORT_SCAN_RATIO, "ratio"),
            evidence(
                "connections_per_minute", F.round(cpm, 2), f"{T.PORT_SCAN_CPM_LOW}+", "cpm"
            ),
            evidence("unique_dst_ips", hosts, "N/A", "hosts"),
            evidence("unique_dst_ports_per_host", per_host, "N/A", "ports/host"),
        ],
        entities=F.array(src),
        start=_c("first_seen"),
        end=_c("last_seen"),
        snapshot={
            "unique_dst_ports": ports,
            "connections_per_minute": cpm,
            "failed_connection_ratio": ratio,
            "unique_dst_ips": hosts,
            "port_scan_suspect": F.lit(1.0),
        },
    )


def dns_tunneling() -> Column:
    """Over DNS profiles with the group's time window."""
    base64, subs = _c("base64_ratio"), _c("unique_subdomain_count")
    entropy, rate = _c("subdomain_entropy"), _c("query_frequency_per_domain")
    qname, source = _c("qname"), F.coalesce("top_src_ip", F.lit("unknown"))

    # indicator: value, suspect from, strong from, strong points, suspect points
    scales = (
        (base64, T.DNS_BASE64_SUSPECT, T.DNS_BASE64_HIGH, 0.30, 0.15),
        (subs, T.DNS_SUBDOMAINS_SUSPECT, T.DNS_SUBDOMAINS_HIGH, 0.20, 0.10),
        (entropy, T.DNS_ENTROPY_SUSPECT, T.DNS_ENTROPY_HIGH, 0.20, 0.10),
        (rate, T.DNS_DOMAIN_RATE_SUSPECT, T.DNS_DOMAIN_RATE_HIGH, 0.15, 0.08),
    )
    strong_hits = [(v >= high, points) for v, _, high, points, _ in scales]
    weak_hits = [((v >= low) & (v < high), points) for v, low, high, _, points in scales]
    weak_hits.append((_c("max_query_frequency_per_ip") >= T.DNS_IP_RATE_SUSPECT, 0.07))

    strong, weak, points = F.lit(0), F.lit(0), F.lit(0.0)
    for hit, value in strong_hits:
        strong, points = strong + _n(hit), points + F.when(hit, value).otherwise(0.0)
    for hit, value in weak_hits:
        weak, points = weak + _n(hit), points + F.when(hit, value).otherwise(0.0)
    gradual = (
        _capped(base64, 1.0) * 0.10
        + _capped(subs, 100) * 0.10
        + _capped(entropy, 8.0) * 0.10
        + _capped(rate, 200) * 0.10
    )
    raw = F.least(points + gradual, F.lit(1.0))
    severity = (
        F.when((raw >= 0.7) | (strong >= 3), CRITICAL)
        .when((raw >= 0.5) | (strong >= 2), HIGH)
        .when((raw >= 0.3) | (strong >= 1), MEDIUM)
        .otherwise(LOW)
    )
    return make_finding(
        (strong > 0) | (weak >= 2),
        entity=qname,
        subject=qname,
        raw=raw,
        shown_digits=4,
        severity=severity,
        confidence=confidence_code(strong + weak, 5),
        title=F.format_string(M.DNS_TITLE, qname),
        description=F.format_string(
            M.DNS_TEXT, qname, strong + weak, base64 * 100, subs, entropy, rate
        ),
        recommendation=F.format_string(M.DNS_ADVICE, qname, source),
        evidences=[
            evidence("base64_ratio", F.round(base64, 4), f"{T.DNS_BASE64_SUSPECT}+", "ratio"),
            evidence(
                "unique_subdomain_count", subs, f"{T.DNS_SUBDOMAINS_SUSPECT}+", "subdomains"
            ),
            evidence("subdomain_entropy", F.round(entropy, 4), f"{T.DNS_ENTROPY_SUSPECT}+", "bits"),
            evidence(
                "query_frequency_per_domain", F.round(rate, 2),
                f"{T.DNS_DOMAIN_RATE_SUSPECT}+", "qpm",
            ),
        ],
        entities=F.concat(F.array(qname, source), _c("listed_src_ips")),
        start=_c("window_start"),
        end=_c("window_end"),
        snapshot={
            "base64_ratio": base64,
            "unique_subdomain_count": subs,
            "subdomain_entropy": entropy,
            "query_frequency_per_domain": rate,
            "query_count": _c("query_count"),
            "response_success_rate": _c("response_success_rate"),
        },
    )


def ftp_brute_force() -> Column:
    """Over FTP summaries with the group's time window."""
    failed, ratio, src = _c("failed_auth_count"), _c("failed_auth_ratio"), _c("src_ip")
    rate = F.coalesce("auth_rate_per_second", F.lit(0.0))
    known_rate = _c("auth_rate_per_second").isNotNull()
    quick = known_rate & (rate >= T.FTP_RATE_SUSPECT)
    very_quick = known_rate & (rate >= T.FTP_RATE_HIGH)
    many = failed >= T.FTP_FAILED_MIN * 3
    raw = 0.4 * _capped(ratio, 1.0) + 0.3 * _capped(rate, T.FTP_RATE_HIGH) + 0.3 * _capped(
        failed, 30.0
    )
    severity = (
        F.when((raw >= 0.7) | (very_quick & many), CRITICAL)
        .when((raw >= 0.5) | very_quick, HIGH)
        .when(raw >= 0.3, MEDIUM)
        .otherwise(LOW)
    )
    fired = _n(ratio >= T.FTP_FAILED_RATIO) + _n(quick) + _n(many)
    return make_finding(
        (failed >= T.FTP_FAILED_MIN) & (ratio >= T.FTP_FAILED_RATIO),
        entity=src,
        subject=src,
        raw=raw,
        shown_digits=4,
        severity=severity,
        confidence=confidence_code(fired, 3),
        title=F.format_string(M.FTP_TITLE, src),
        description=F.format_string(M.FTP_TEXT, src, failed, ratio * 100, rate),
        recommendation=F.format_string(M.FTP_ADVICE, src),
        evidences=[
            evidence("failed_auth_ratio", F.round(ratio, 4), f"{T.FTP_FAILED_RATIO}+", "ratio"),
            evidence("failed_auth_count", failed, f"{T.FTP_FAILED_MIN}+", "attempts"),
            evidence(
                "auth_rate_per_second", F.round(rate, 4), f"{T.FTP_RATE_SUSPECT}+", "attempts/sec"
            ),
            evidence("success_auth_count", _c("success_auth_count"), "N/A", "attempts"),
        ],
        entities=F.array(src),
        start=_c("window_start"),
        end=_c("window_end"),
        snapshot={
            "failed_auth_ratio": ratio,
            "failed_auth_count": failed,
            "auth_rate_per_second": rate,
            "success_auth_count": _c("success_auth_count"),
            "total_commands": _c("total_commands"),
        },
    )


def smtp_abuse() -> Column:
    """Over SMTP summaries with the group's time window."""
    recipients, messages = _c("unique_recipients"), _c("message_count")
    failed, links, src = _c("failed_auth_count"), _c("total_connections"), _c("src_ip")
    some_rcpt, many_rcpt = (
        recipients >= T.SMTP_RECIPIENTS_SUSPECT, recipients >= T.SMTP_RECIPIENTS_HIGH
    )
    some_mail, many_mail = messages >= T.SMTP_MESSAGES_SUSPECT, messages >= T.SMTP_MESSAGES_HIGH
    guessing = failed >= T.SMTP_FAILED_SUSPECT
    strong = many_rcpt | many_mail
    r, m, a = (
        _capped(recipients, T.SMTP_RECIPIENTS_HIGH),
        _capped(messages, T.SMTP_MESSAGES_HIGH),
        _capped(failed, T.SMTP_FAILED_SUSPECT * 3),
    )
    mix = (
        F.when(many_rcpt & ~many_mail, 0.5 * r + 0.2 * m + 0.1 * a)
        .when(many_rcpt & many_mail, 0.4 * r + 0.4 * m + 0.1 * a)
        .when(guessing & some_rcpt, 0.3 * r + 0.2 * m + 0.4 * a)
        .otherwise(0.3 * r + 0.3 * m + 0.3 * a)
    )
    raw = F.least(mix + F.when(strong, 0.1).otherwise(0.0), F.lit(1.0))
    severity = (
        F.when((raw >= 0.7) | (strong & guessing), CRITICAL)
        .when((raw >= 0.5) | strong, HIGH)
        .when(raw >= 0.3, MEDIUM)
        .otherwise(LOW)
    )
    kind = F.when(many_rcpt, M.SMTP_SPAM).when(guessing, M.SMTP_STUFFING).otherwise(M.SMTP_RELAY)
    return make_finding(
        some_rcpt | some_mail | guessing,
        entity=src,
        subject=src,
        raw=raw,
        shown_digits=4,
        severity=severity,
        confidence=confidence_code(_n(some_rcpt) + _n(some_mail) + _n(guessing), 3),
        title=F.format_string(M.SMTP_TITLE, src),
        description=F.format_string(M.SMTP_TEXT, src, messages, recipients, failed, links, kind),
        recommendation=F.format_string(M.SMTP_ADVICE, src),
        evidences=[
            evidence(
                "unique_recipients", recipients, f"{T.SMTP_RECIPIENTS_SUSPECT}+", "recipients"
            ),
            evidence("message_count", messages, f"{T.SMTP_MESSAGES_SUSPECT}+", "messages"),
            evidence("failed_auth_count", failed, f"{T.SMTP_FAILED_SUSPECT}+", "attempts"),
            evidence("total_connections", links, "N/A", "connections"),
        ],
        entities=F.array(src),
        start=_c("window_start"),
        end=_c("window_end"),
        snapshot={
            "unique_recipients": recipients,
            "message_count": messages,
            "failed_auth_count": failed,
            "total_connections": links,
        },
    )


def http_anomaly() -> Column:
    """Over HTTP overviews (one row per group) with the group's time window."""
    responses, errors = _c("responses"), _c("error_responses")
    agents, listed = _c("scanner_agents"), _c("listed_requests")
    error_ratio = F.when(responses > 0, errors / responses).otherwise(F.lit(0.0))
    share = F.when(listed > 0, _c("top_requests") / listed).otherwise(F.lit(0.0))
    failing, scanning = error_ratio >= T.HTTP_ERROR_RATIO, agents >= 1
    dominated = share >= T.HTTP_PATH_SHARE
    raw = F.least(
        0.3 + 0.5 * error_ratio + F.when(scanning, 0.2).otherwise(0.0), F.lit(1.0)
    )
    return make_finding(
        (listed > 0) & (failing | scanning | dominated),
        entity=F.lit(""),
        subject=F.lit(""),
        raw=raw,
        confidence=confidence_code(_n(failing) + _n(scanning) + _n(dominated), 3),
        title=F.lit(M.HTTP_TITLE),
        description=F.lit(M.HTTP_TEXT),
        recommendation=F.lit(M.HTTP_ADVICE),
        evidences=[
            evidence(
                "http_error_ratio", F.round(error_ratio, 3), T.HTTP_ERROR_RATIO, when=failing
            ),
            evidence("suspicious_ua_count", agents, 1, when=scanning),
            evidence("single_uri_share", F.round(share, 3), T.HTTP_PATH_SHARE, when=dominated),
        ],
        entities=F.array(),
        start=_c("window_start"),
        end=_c("window_end"),
        snapshot={
            "error_ratio": F.round(error_ratio, 3),
            "suspicious_ua_count": agents,
            "single_uri_share": F.round(share, 3),
        },
    )


def cleartext_credentials() -> Column:
    """Over login attempts in clear text per (source, destination)."""
    web, ftp = _c("web_logins"), _c("ftp_passwords")
    repeated = web + ftp >= T.CLEARTEXT_REPEATED
    src, dst = _c("src_ip"), _c("dst_ip")
    raw = (
        F.lit(0.4)
        + F.when(repeated, 0.3).otherwise(0.0)
        + F.when(ftp > 0, 0.2).otherwise(0.0)
    )
    return make_finding(
        (web + ftp) > 0,
        entity=src,
        subject=F.concat_ws("|", src, dst),
        raw=raw,
        shown_digits=4,
        confidence=confidence_code(F.lit(1) + _n(repeated) + _n(ftp > 0), 3),
        title=F.format_string("Cleartext credentials from %s to %s", src, dst),
        description=F.lit("Login data sent over an unencrypted protocol"),
        recommendation=F.lit("Move the service to an encrypted protocol and change passwords"),
        evidences=[
            evidence("web_logins", web, 1, "requests", when=web > 0),
            evidence("ftp_passwords", ftp, 1, "commands", when=ftp > 0),
        ],
        entities=F.array(src, dst),
        start=_c("first_seen"),
        end=_c("last_seen"),
        snapshot={"web_logins": web, "ftp_passwords": ftp},
    )
