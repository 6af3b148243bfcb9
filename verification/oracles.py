"""Plain SQL for DuckDB, one text per registered query, written apart from the Spark code."""

from __future__ import annotations

from verification.inputs import cte
from verification.queries import (
    ALERTS_SINCE,
    LIVE_NOW,
    LIVE_WINDOW,
    RETENTION_NOW,
    RISK_NOW,
    RISK_WINDOW,
    RULE_IDS,
)
from wiretide.functions.timing import parse_window

ORACLES: dict[str, str] = {}


def _at(moment) -> str:
    return f"TIMESTAMP '{moment:%Y-%m-%d %H:%M:%S}'"


# -- flows -------------------------------------------------------------------------------------
def _flow_cte(group: str = "capture_id", directed_icmp: bool = True) -> str:
    """Flows of the packets CTE, as CTE ``flow``."""
    directed = "protocol = 'ICMP' OR" if directed_icmp else ""
    port = "" if directed_icmp else "0"
    sport = f"coalesce(src_port, {port})" if port else "src_port"
    dport = f"coalesce(dst_port, {port})" if port else "dst_port"
    return f"""
p1 AS (SELECT *, capture_id AS {'grp' if group == 'capture_id' else 'grp'}, {sport} AS sp, {dport} AS dp,
   CASE WHEN {directed} src_ip < dst_ip OR (src_ip = dst_ip
        AND coalesce(src_port, 0) <= coalesce(dst_port, 0)) THEN 0 ELSE 1 END AS rev FROM packets),
p2 AS (SELECT *, CASE rev WHEN 0 THEN src_ip ELSE dst_ip END AS l_ip,
   CASE rev WHEN 0 THEN sp ELSE dp END AS l_port, CASE rev WHEN 0 THEN dst_ip ELSE src_ip END AS r_ip,
   CASE rev WHEN 0 THEN dp ELSE sp END AS r_port FROM p1),
p3 AS (SELECT *, CAST(ts_ms - lag(ts_ms) OVER (PARTITION BY grp, protocol, l_ip, l_port, r_ip, r_port
   ORDER BY packet_number) AS HUGEINT) AS gap FROM p2),
p4 AS (SELECT grp, protocol, l_ip, l_port, r_ip, r_port, min(packet_number * 2 + rev) % 2 AS flip,
   CAST(min(packet_number * 2 + rev) // 2 AS BIGINT) AS first_seq,
   count(*) AS packets_total, CAST(sum(length) AS BIGINT) AS bytes_total,
   CAST(sum(CASE rev WHEN 0 THEN length ELSE 0 END) AS BIGINT) AS l_bytes,
   min(ts_ms) AS start_ms, max(ts_ms) AS end_ms,
   count(*) FILTER (tcp_flags IN ('0x002', '0x012')) AS syn_count,
   count(*) FILTER (tcp_flags = '0x004') AS rst_count,
   count(*) FILTER (tcp_flags IN ('0x010', '0x012')) AS ack_count,
   count(gap) AS n, sum(gap) AS s, sum(gap * gap) AS ss
   FROM p3 GROUP BY ALL),
flow AS (SELECT grp AS {group}, protocol, CASE flip WHEN 0 THEN l_ip ELSE r_ip END AS src_ip,
   CASE flip WHEN 0 THEN r_ip ELSE l_ip END AS dst_ip,
   coalesce(CASE flip WHEN 0 THEN l_port ELSE r_port END, 0) AS src_port,
   coalesce(CASE flip WHEN 0 THEN r_port ELSE l_port END, 0) AS dst_port,
   first_seq, packets_total, bytes_total, CASE flip WHEN 0 THEN l_bytes ELSE bytes_total - l_bytes END AS src_bytes,
   CASE flip WHEN 0 THEN bytes_total - l_bytes ELSE l_bytes END AS dst_bytes,
   CAST(end_ms - start_ms AS DOUBLE) AS duration_ms, start_ms, end_ms, syn_count, rst_count, ack_count,
   CASE WHEN n > 0 THEN round(CAST(s AS DOUBLE) / n, 4) ELSE 0.0 END AS inter_packet_interval_ms,
   CASE WHEN n > 1 THEN CAST(((n * ss - s * s) * 20000 + n * (n - 1)) // (2 * n * (n - 1)) AS DOUBLE) / 10000.0
        ELSE 0.0 END AS inter_packet_interval_variance_ms
   FROM p4)"""


FLOWS = cte("packets") + "," + _flow_cte()
EVENT_FLOWS = cte("packets") + "," + _flow_cte("session_id", directed_icmp=False)
FLOW_ID = "capture_id, src_ip, src_port, dst_ip, dst_port, protocol"

ORACLES["flow_records"] = f"""{FLOWS}
SELECT {FLOW_ID}, packets_total, bytes_total, src_bytes, dst_bytes, duration_ms, start_ms, end_ms,
 syn_count, rst_count, ack_count FROM flow"""
ORACLES["flow_intervals"] = f"""{FLOWS}
SELECT {FLOW_ID}, inter_packet_interval_ms, inter_packet_interval_variance_ms FROM flow"""
ORACLES["failed_flows"] = f"""{FLOWS}
SELECT capture_id, count(*) AS total_flows,
 count(*) FILTER (protocol = 'TCP' AND rst_count > 0 AND bytes_total <= 200) AS failed_flows
FROM flow GROUP BY 1"""
ORACLES["stored_flow_rows"] = f"""{FLOWS}
SELECT capture_id, src_ip, nullif(src_port, 0) AS src_port, dst_ip, nullif(dst_port, 0) AS dst_port,
 protocol, src_bytes AS bytes_sent, dst_bytes AS bytes_recv, packets_total AS packets_count,
 nullif(inter_packet_interval_ms, 0) AS inter_packet_interval_ms FROM flow"""
ORACLES["event_flows"] = f"""{EVENT_FLOWS}
SELECT session_id, src_ip, src_port, dst_ip, dst_port, protocol, packets_total, bytes_total,
 src_bytes, syn_count, rst_count, ack_count, duration_ms FROM flow"""


# -- profiles ----------------------------------------------------------------------------------
_PROFILE = """
pair AS (SELECT capture_id, src_ip, dst_ip, count(DISTINCT dst_port) AS ports FROM packets GROUP BY ALL),
scan AS (SELECT capture_id, src_ip, count(*) FILTER (ports > 0) AS pairs,
   count(*) FILTER (ports >= 20) AS suspects, max(ports) AS most FROM pair GROUP BY ALL),
conn AS (SELECT capture_id, src_ip, count(*) AS flows,
   count(*) FILTER (protocol = 'TCP' AND rst_count > 0 AND bytes_total <= 200) AS failed
   FROM flow GROUP BY ALL),
host AS (SELECT capture_id, src_ip, count(DISTINCT dst_ip) AS ips, count(DISTINCT dst_port) AS ports,
   CAST(sum(length) AS BIGINT) AS bytes, count(*) AS packets, min(ts_ms) AS first_ms,
   max(ts_ms) AS last_ms, string_agg(DISTINCT protocol, ',' ORDER BY protocol) AS protocols
   FROM packets GROUP BY ALL),
profile AS (SELECT h.capture_id, h.src_ip, ips AS unique_dst_ips, h.ports AS unique_dst_ports,
   coalesce(flows, 0) AS total_connections, coalesce(failed, 0) AS failed_connections,
   coalesce(flows - failed, 0) AS success_connections, bytes AS total_bytes_sent,
   packets AS total_packets_sent, first_ms, last_ms, protocols AS distinct_protocols,
   CASE WHEN flows > 0 THEN round(failed / CAST(flows AS DOUBLE), 4) ELSE 0.0 END AS failed_connection_ratio,
   CASE WHEN pairs > 0 THEN suspects / CAST(pairs AS DOUBLE) >= 0.7 ELSE FALSE END AS port_scan_suspect,
   most AS unique_dst_ports_per_host,
   round(coalesce(flows, 0) / greatest((last_ms - first_ms) / 1000.0 / 60.0, CAST(1.0 AS DOUBLE) / 60.0), 4)
     AS connections_per_minute
   FROM host h JOIN scan USING (capture_id, src_ip) LEFT JOIN conn USING (capture_id, src_ip))"""
PROFILES = FLOWS + "," + _PROFILE

ORACLES["connection_profiles"] = f"{PROFILES} SELECT * FROM profile"
ORACLES["port_scan_pairs"] = f"""{cte("packets")}
SELECT capture_id, src_ip, dst_ip, count(DISTINCT dst_port) AS ports,
 count(*) FILTER (dst_port IS NOT NULL) AS packets, count(DISTINCT dst_port) >= 20 AS suspect
FROM packets WHERE dst_port IS NOT NULL GROUP BY ALL"""
ORACLES["event_profiles"] = f"""{EVENT_FLOWS},
pair AS (SELECT session_id, src_ip, dst_ip, count(DISTINCT dst_port) AS ports FROM flow GROUP BY ALL),
scan AS (SELECT session_id, src_ip, count(*) AS pairs, count(*) FILTER (ports >= 20) AS suspects,
   max(ports) AS most FROM pair GROUP BY ALL),
host AS (SELECT session_id, src_ip, count(DISTINCT dst_ip) AS unique_dst_ips,
   count(DISTINCT dst_port) AS unique_dst_ports, count(*) AS total_connections,
   count(*) FILTER (rst_count > 0 AND bytes_total <= 200) AS failed_connections,
   CAST(sum(bytes_total) AS BIGINT) AS total_bytes_sent,
   CAST(sum(packets_total) AS BIGINT) AS total_packets_sent, min(start_ms) AS first_ms,
   max(start_ms) AS last_ms, string_agg(DISTINCT protocol, ',' ORDER BY protocol) AS distinct_protocols
   FROM flow GROUP BY ALL)
SELECT h.*, total_connections - failed_connections AS success_connections,
 round(failed_connections / CAST(total_connections AS DOUBLE), 4) AS failed_connection_ratio,
 suspects / CAST(pairs AS DOUBLE) >= 0.7 AS port_scan_suspect, most AS unique_dst_ports_per_host,
 round(total_connections / greatest((last_ms - first_ms) / 1000.0 / 60.0, CAST(1.0 AS DOUBLE) / 60.0), 4)
   AS connections_per_minute
FROM host h JOIN scan USING (session_id, src_ip)"""

# -- DNS ---------------------------------------------------------------------------------------
_DNS = """
named AS (SELECT *, string_split(rtrim(qname, '.'), '.') AS labels FROM dns),
d AS (SELECT *, CASE WHEN len(labels) <= 2 THEN rtrim(qname, '.')
        ELSE labels[-2] || '.' || labels[-1] END AS domain,
   CASE WHEN len(labels) <= 2 THEN '' ELSE array_to_string(labels[1:len(labels) - 2], '.') END AS sub
   FROM named),
span AS (SELECT capture_id, greatest((max(ts_ms) - min(ts_ms)) / 1000.0 / 60.0, CAST(1.0 AS DOUBLE) / 60.0) AS minutes
   FROM dns GROUP BY 1),
rate AS (SELECT capture_id, qname, src_ip, count(*) AS queries, round(count(*) / any_value(minutes), 4)
   AS queries_per_minute FROM d JOIN span USING (capture_id) GROUP BY ALL),
subs AS (SELECT capture_id, domain, sub, count(*) AS queries FROM d GROUP BY ALL),
dom AS (SELECT capture_id, domain, CAST(sum(queries) AS BIGINT) AS domain_queries,
   count(*) AS unique_subdomain_count,
   CASE WHEN count(*) FILTER (sub <> '') > 0 THEN round(count(*) FILTER (length(sub) >= 12
      AND regexp_full_match(sub, '[A-Za-z0-9+/=]+') AND regexp_matches(sub, '[A-Z]')
      AND regexp_matches(sub, '[a-z]') AND regexp_matches(sub, '[0-9]'))
      / CAST(count(*) FILTER (sub <> '') AS DOUBLE), 4) ELSE 0.0 END AS base64_ratio,
   round(sum(queries) / any_value(minutes), 4) AS query_frequency_per_domain
   FROM subs JOIN span USING (capture_id) GROUP BY ALL),
letters AS (SELECT DISTINCT capture_id, qname,
   unnest(string_split(CASE WHEN len(labels) <= 2 THEN '' ELSE array_to_string(labels[1:len(labels) - 2], '') END, ''))
   AS ch, generate_subscripts(string_split(CASE WHEN len(labels) <= 2 THEN '' ELSE
   array_to_string(labels[1:len(labels) - 2], '') END, ''), 1) AS pos FROM named),
shares AS (SELECT capture_id, qname, count(*) AS c, sum(count(*)) OVER (PARTITION BY capture_id, qname) AS n
   FROM letters WHERE ch <> '' GROUP BY capture_id, qname, ch),
entropy AS (SELECT capture_id, qname, abs(round(-sum(c / CAST(n AS DOUBLE) * log2(c / CAST(n AS DOUBLE))), 4)) AS e
   FROM shares GROUP BY ALL),
names AS (SELECT capture_id, qname, any_value(domain) AS domain, count(*) AS query_count,
   string_agg(DISTINCT qtype, ',' ORDER BY qtype) AS unique_qtypes,
   coalesce(round(avg(query_size_bytes), 2), 0.0) AS avg_query_size_bytes,
   CASE WHEN count(response_code) > 0 THEN round(count(*) FILTER (response_code = '0')
     / CAST(count(response_code) AS DOUBLE), 4) ELSE 1.0 END AS response_success_rate FROM d GROUP BY ALL),
sources AS (SELECT capture_id, qname, count(*) AS unique_src_ips,
   array_to_string(list_sort(list(src_ip))[1:10], ',') AS listed_src_ips,
   arg_max(src_ip, queries * 1000000 - place) AS top_src_ip,
   max(queries_per_minute) AS max_query_frequency_per_ip
   FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, qname ORDER BY src_ip) AS place FROM rate)
   GROUP BY ALL),
profile AS (SELECT n.capture_id, n.qname, n.domain, query_count, unique_qtypes,
   coalesce(e, 0.0) AS subdomain_entropy, avg_query_size_bytes, response_success_rate, unique_src_ips,
   listed_src_ips, top_src_ip, max_query_frequency_per_ip, query_frequency_per_domain,
   unique_subdomain_count, base64_ratio
   FROM names n JOIN dom USING (capture_id, domain) JOIN sources USING (capture_id, qname)
   LEFT JOIN entropy USING (capture_id, qname))"""
DNS = cte("dns") + "," + _DNS
ORACLES["dns_profiles"] = f"{DNS} SELECT * FROM profile"
ORACLES["dns_rates_by_ip"] = f"{DNS} SELECT * FROM rate"
ORACLES["dns_domain_stats"] = f"{DNS} SELECT * FROM dom"

# -- applications ------------------------------------------------------------------------------
_HTTP = """
paths AS (SELECT capture_id, CASE WHEN split_part(uri, '?', 1) = '' THEN '/' ELSE split_part(uri, '?', 1) END
   AS path, count(*) AS requests, min(seq) AS first_seq FROM http WHERE uri <> '' GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id
   ORDER BY requests DESC, first_seq, path) AS place FROM paths) WHERE place <= 20)"""
ORACLES["http_methods"] = f"""{cte("http")} SELECT capture_id, upper(method) AS method,
 count(*) AS requests FROM http WHERE method <> '' GROUP BY ALL"""
ORACLES["http_statuses"] = f"""{cte("http")} SELECT capture_id, status_code,
 count(*) AS responses FROM http WHERE status_code IS NOT NULL GROUP BY ALL"""
ORACLES["http_top_paths"] = f"{cte('http')},{_HTTP} SELECT * REPLACE (CAST(place AS INT) AS place) FROM top"
ORACLES["http_agents"] = f"""{cte("http")} SELECT capture_id, user_agent, count(*) AS requests,
 min(seq) AS first_seq FROM http WHERE user_agent <> '' GROUP BY ALL"""
ORACLES["page_url_paths"] = r"""
WITH u AS (SELECT regexp_replace(url, '^[a-z]+://[^/?#]*', '') AS rest FROM pages),
p AS (SELECT regexp_replace(regexp_replace(rest, '[?#].*$', ''), ';[^/]*$', '') AS path FROM u)
SELECT CASE WHEN path = '' THEN '/' ELSE path END AS path, count(*) AS pages FROM p GROUP BY ALL"""
_FTP = """
fa AS (SELECT capture_id, src_ip, count(*) FILTER (response_code = 530) AS failed_auth_count,
   count(*) FILTER (response_code = 230) AS success_auth_count,
   count(*) FILTER (command <> '') AS total_commands, (max(ts_ms) - min(ts_ms)) / 1000.0 AS seconds
   FROM ftp GROUP BY ALL),
fs AS (SELECT capture_id, src_ip, failed_auth_count, success_auth_count, total_commands,
   CASE WHEN seconds > 0 AND total_commands > 0 THEN
     round((failed_auth_count + success_auth_count) / seconds, 4) END AS auth_rate_per_second,
   CASE WHEN failed_auth_count + success_auth_count > 0 THEN
     round(failed_auth_count / CAST(failed_auth_count + success_auth_count AS DOUBLE), 4) ELSE 0.0 END
     AS failed_auth_ratio FROM fa)"""
ORACLES["ftp_summary"] = f"{cte('ftp')},{_FTP} SELECT * FROM fs"
_SMTP = """
sa AS (SELECT capture_id, src_ip, count(*) FILTER (command = 'MAIL') AS message_count,
   count(DISTINCT trim(rcpt, '<>')) AS unique_recipients,
   count(*) FILTER (response_code = 535) AS failed_auth_count,
   count(*) FILTER (command IN ('EHLO', 'HELO')) AS hello,
   min(seq) FILTER (command = 'MAIL') AS first_mail,
   min(seq) FILTER (command IN ('EHLO', 'HELO')) AS first_hello FROM smtp GROUP BY ALL),
ss AS (SELECT capture_id, src_ip, message_count, unique_recipients, failed_auth_count,
   greatest(1, hello + CASE WHEN first_mail IS NOT NULL AND (first_hello IS NULL OR first_mail < first_hello)
     THEN 1 ELSE 0 END) AS total_connections FROM sa)"""
ORACLES["smtp_summary"] = f"{cte('smtp')},{_SMTP} SELECT * FROM ss"

# -- baseline ----------------------------------------------------------------------------------
ORACLES["capture_stats"] = f"""{cte("packets")}
SELECT capture_id, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS total_bytes,
 min(ts_ms) AS start_ms, max(ts_ms) AS end_ms,
 round((max(ts_ms) - min(ts_ms)) / 1000.0, 4) AS capture_duration_seconds FROM packets GROUP BY 1"""
_BASE = """
bt AS (SELECT capture_id, CAST(sum(length) AS BIGINT) AS total_bytes, count(*) AS total_packets,
   CASE WHEN max(ts_ms) > min(ts_ms) THEN (max(ts_ms) - min(ts_ms)) / 1000.0 ELSE 1.0 END AS seconds,
   count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips
   FROM packets GROUP BY 1),
base AS (SELECT capture_id, round(total_bytes / seconds, 2) AS expected_bytes_per_second,
   round(total_packets / seconds, 2) AS expected_packets_per_second, total_bytes, total_packets,
   round(seconds, 4) AS duration_seconds, unique_src_ips, unique_dst_ips FROM bt)"""
ORACLES["traffic_baseline"] = f"{cte('packets')},{_BASE} SELECT * FROM base"
ORACLES["protocol_shares"] = f"""{cte("packets")}
SELECT capture_id, protocol, count(*) AS packets, round(count(*)
 / CAST(sum(count(*)) OVER (PARTITION BY capture_id) AS DOUBLE) * 100, 2) AS percentage
FROM packets GROUP BY capture_id, protocol"""
ORACLES["traffic_deviations"] = f"""{FLOWS},{_BASE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY bytes_total DESC, start_ms,
   first_seq, src_ip, dst_ip, src_port, dst_port) AS place FROM flow),
r AS (SELECT f.*, greatest(duration_ms / 1000.0, 0.001) AS seconds,
   greatest(expected_bytes_per_second, 0.001) AS expected FROM ranked f JOIN base USING (capture_id)
   WHERE place <= 20)
SELECT capture_id, CAST(place AS INT) AS place, src_ip, dst_ip,
 round((bytes_total / seconds / expected - 1) * 100, 2) + 0.0 AS bytes_exceeded_pct,
 round(packets_total / seconds, 2) AS packets_per_second,
 round(bytes_total / seconds, 2) AS bytes_per_second, src_bytes > dst_bytes AS is_upload_dominated
FROM r"""
ORACLES["event_baseline"] = f"""{EVENT_FLOWS},
t AS (SELECT session_id, CAST(sum(bytes_total) AS BIGINT) AS total_bytes,
   CAST(sum(packets_total) AS BIGINT) AS total_packets,
   greatest((max(end_ms) - min(start_ms)) / 1000.0, 0.001) AS seconds,
   count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips
   FROM flow GROUP BY 1)
SELECT session_id, round(total_bytes / seconds, 2) AS expected_bytes_per_second,
 round(total_packets / seconds, 2) AS expected_packets_per_second, total_bytes, total_packets,
 round(seconds, 4) AS duration_seconds, unique_src_ips, unique_dst_ips FROM t"""

# -- dashboard ---------------------------------------------------------------------------------
_VOLUME = "CAST(sum(packets_total) AS BIGINT) AS packets, CAST(sum(bytes_total) AS BIGINT) AS bytes"
_DIMENSIONS = " UNION ALL ".join(
    f"SELECT capture_id, '{d}' AS dimension, CAST({d} AS VARCHAR) AS key, {_VOLUME} FROM flow "
    f"{'WHERE dst_port <> 0 ' if d == 'dst_port' else ''}GROUP BY capture_id, {d}"
    for d in ("src_ip", "dst_ip", "dst_port", "protocol")
)
ORACLES["top_talkers"] = f"""{FLOWS}, dims AS ({_DIMENSIONS})
SELECT * REPLACE (CAST(place AS INT) AS place) FROM (SELECT *, row_number() OVER (PARTITION BY capture_id,
 dimension ORDER BY bytes DESC, key) AS place FROM dims) WHERE place <= 10"""
ORACLES["protocol_distribution"] = f"""{FLOWS}, v AS (SELECT capture_id, protocol, {_VOLUME}
 FROM flow GROUP BY ALL)
SELECT *, round(bytes / CAST(sum(bytes) OVER (PARTITION BY capture_id) AS DOUBLE) * 100, 2)
 AS percentage FROM v"""
ORACLES["traffic_timeline"] = f"""{FLOWS},
b AS (SELECT capture_id, min(start_ms) AS t0, max(end_ms) AS t1 FROM flow GROUP BY 1),
w AS (SELECT *, greatest(1, CAST(floor((t1 - t0) / 1000.0 / 60) AS BIGINT)) AS bucket_seconds
   FROM b WHERE t1 > t0)
SELECT capture_id, CAST((start_ms - t0) // (bucket_seconds * 1000) AS BIGINT) AS bucket,
 t0 + CAST((start_ms - t0) // (bucket_seconds * 1000) AS BIGINT) * bucket_seconds * 1000 AS bucket_ms,
 bucket_seconds, {_VOLUME}, count(*) AS flows
FROM flow JOIN w USING (capture_id) GROUP BY capture_id, 2, 3, bucket_seconds"""
ORACLES["live_talkers"] = f"""{cte("packets", "captures")},{_flow_cte()},
recent AS (SELECT * FROM flow WHERE capture_id IN (SELECT capture_id FROM captures
   WHERE uploaded_at >= {_at(LIVE_NOW - parse_window(LIVE_WINDOW))} AND deleted_at IS NULL)),
s AS (SELECT src_ip AS ip, 'src' AS direction, {_VOLUME} FROM recent GROUP BY 1
   ORDER BY bytes DESC, ip LIMIT 10),
d AS (SELECT dst_ip AS ip, 'dst' AS direction, {_VOLUME} FROM recent GROUP BY 1
   ORDER BY bytes DESC, ip LIMIT 10),
m AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY bytes DESC, direction DESC) AS place
   FROM (SELECT * FROM s UNION ALL SELECT * FROM d))
SELECT ip, direction, bytes, packets FROM m WHERE place = 1 ORDER BY bytes DESC, ip LIMIT 10"""
ORACLES["heatmap"] = f"""{FLOWS}
SELECT capture_id, src_ip AS ip, CAST(start_ms // 3600000 % 24 AS INT) AS hour, {_VOLUME}
FROM flow GROUP BY ALL"""
ORACLES["global_top_ips"] = f"""{FLOWS},
ends AS (SELECT capture_id, src_ip AS ip, packets_total, bytes_total FROM flow
   UNION ALL SELECT capture_id, dst_ip, packets_total, bytes_total FROM flow WHERE dst_ip <> src_ip)
SELECT ip, CAST(sum(bytes_total) AS BIGINT) AS total_bytes,
 CAST(sum(packets_total) AS BIGINT) AS total_packets, count(DISTINCT capture_id) AS capture_count
FROM ends GROUP BY 1 ORDER BY total_bytes DESC, ip LIMIT 10"""

# -- alerts ------------------------------------------------------------------------------------
_RANK = """CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4
 WHEN 'informational' THEN 5 ELSE 6 END"""
_NAME = "['critical', 'high', 'medium', 'low', 'informational', 'informational']"
ORACLES["alert_list"] = f"""{cte("alerts")}
SELECT alert_id, session_id, rule_id, severity, status, risk_score, epoch_us(triggered_at) AS triggered_us
FROM alerts WHERE status = 'active' AND severity = 'critical'
ORDER BY triggered_at DESC, alert_id LIMIT 50 OFFSET 25"""
ORACLES["alert_count"] = f"""{cte("alerts")}
SELECT count(*) AS total FROM alerts WHERE status = 'active' AND severity = 'critical'"""
ORACLES["alert_timeline"] = f"""{cte("alerts")}
SELECT rule_id, epoch_ms(date_trunc('hour', triggered_at)) AS bucket_ms, count(*) AS count,
 {_NAME}[min({_RANK})] AS max_severity
FROM alerts WHERE triggered_at >= {_at(ALERTS_SINCE)} GROUP BY 1, 2"""
ORACLES["alert_timeline_pivot"] = f"""{cte("alerts")}
SELECT epoch_ms(date_trunc('day', triggered_at)) AS bucket_ms, """ + ", ".join(
    f"count(*) FILTER (rule_id = '{r}') AS {r.replace('-', '_').lower()}" for r in RULE_IDS
) + f" FROM alerts WHERE triggered_at >= {_at(ALERTS_SINCE)} GROUP BY 1"
ORACLES["risk_snapshot"] = f"""{cte("alerts", "captures")},
a AS (SELECT round(coalesce(avg(risk_score), 0) / 100, 4) AS risk_avg FROM alerts
   WHERE triggered_at >= {_at(RISK_NOW - parse_window(RISK_WINDOW))}),
t AS (SELECT rule_id, count(*) AS n FROM alerts WHERE session_id IN (SELECT capture_id FROM captures
   WHERE uploaded_at >= {_at(RISK_NOW - parse_window(RISK_WINDOW))} AND deleted_at IS NULL)
   GROUP BY 1 ORDER BY n DESC, rule_id LIMIT 5)
SELECT risk_avg, CASE WHEN risk_avg >= 0.76 THEN 'critical' WHEN risk_avg >= 0.51 THEN 'high'
 WHEN risk_avg >= 0.26 THEN 'medium' ELSE 'low' END AS threat_level,
 (SELECT string_agg(rule_id, ',' ORDER BY n DESC, rule_id) FROM t) AS top_rules_triggered FROM a"""
ORACLES["risk_series"] = f"""{cte("alerts")}
SELECT epoch_ms(date_trunc('minute', triggered_at)) AS bucket_ms,
 round(sum(risk_score) / CAST(count(*) AS DOUBLE) / 100, 4) AS risk_avg, count(*) AS count
FROM alerts WHERE triggered_at >= {_at(ALERTS_SINCE)} GROUP BY 1"""
_STATS = """
st AS (SELECT rule_id, session_id, count(*) AS evaluations, count(*) FILTER (triggered) AS hits,
   count(*) FILTER (NOT triggered) AS miss,
   round(sum(risk_score) / CAST(count(*) AS DOUBLE), 6) AS avg_risk_score,
   CAST(max(risk_score) AS DOUBLE) AS max_risk_score, epoch_us(max(evaluated_at)) AS last_us
   FROM evaluations GROUP BY ALL)"""
ORACLES["rule_stats"] = f"{cte('evaluations')},{_STATS} SELECT * FROM st"
ORACLES["stream_rule_stats"] = ORACLES["rule_stats"]
ORACLES["rule_stat_list"] = f"""{cte("evaluations")},{_STATS}
SELECT rule_id, session_id, evaluations, hits, miss, round(hits / CAST(evaluations AS DOUBLE), 4)
 AS hit_ratio, last_us FROM st ORDER BY last_us DESC, rule_id, session_id LIMIT 100"""
ORACLES["rule_history"] = f"""{cte("evaluations")}
SELECT rule_id, epoch_ms(date_trunc('minute', evaluated_at)) AS bucket_ms, count(*) AS evaluations,
 count(*) FILTER (triggered) AS hits, CAST(0 AS BIGINT) AS false_positives,
 round(sum(risk_score) / CAST(count(*) AS DOUBLE), 6) AS avg_risk FROM evaluations GROUP BY ALL"""
ORACLES["evaluation_rows"] = f"""{cte("evaluations")},
rules AS (SELECT 'NET-0' || lpad(CAST(i AS VARCHAR), 2, '0') AS rule_id FROM range(1, 12) r(i))
SELECT e.session_id, e.flush_id, r.rule_id, e.triggered AND e.rule_id = r.rule_id AS triggered,
 CASE WHEN e.triggered AND e.rule_id = r.rule_id THEN risk_score ELSE 0 END AS risk_score
FROM evaluations e CROSS JOIN rules r"""
ORACLES["latest_alert_status"] = """
SELECT user_id AS alert_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id
 ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place = 1"""

# -- captures ----------------------------------------------------------------------------------
ORACLES["capture_dedup"] = f"""{cte("captures", "evaluations")},
c AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY uploaded_at, capture_id) AS place,
   count(*) OVER (PARTITION BY sha256) AS copies FROM captures),
j AS (SELECT * FROM (SELECT session_id AS capture_id, flush_id AS job_id, rule_id AS job_status,
   row_number() OVER (PARTITION BY session_id ORDER BY evaluated_at DESC, flush_id DESC) AS place
   FROM evaluations) WHERE place = 1)
SELECT sha256, c.capture_id, epoch_ms(uploaded_at) AS uploaded_ms, copies, job_id, job_status
FROM c LEFT JOIN j ON c.capture_id = j.capture_id WHERE c.place = 1"""
_EXPIRED = f"deleted_at IS NULL AND expires_at <= {_at(RETENTION_NOW)}"
ORACLES["expired_captures"] = f"""{cte("captures")}
SELECT capture_id, file_size, epoch_ms(expires_at) AS expires_ms FROM captures WHERE {_EXPIRED}"""
ORACLES["expire_captures"] = f"""{cte("captures")}
SELECT capture_id, CASE WHEN {_EXPIRED} THEN 'deleted' ELSE status END AS status,
 epoch_ms(CASE WHEN {_EXPIRED} THEN {_at(RETENTION_NOW)} ELSE deleted_at END) AS deleted_ms FROM captures"""
ORACLES["storage_status"] = f"""{cte("captures")}
SELECT count(*) FILTER (deleted_at IS NULL) AS capture_count,
 CAST(coalesce(sum(file_size) FILTER (deleted_at IS NULL), 0) AS BIGINT) AS total_bytes,
 count(*) FILTER ({_EXPIRED}) AS expired_count FROM captures"""

# -- rules -------------------------------------------------------------------------------------
_SEVERITY = """CASE WHEN {s} >= 76 THEN 'CRITICAL' WHEN {s} >= 51 THEN 'HIGH' WHEN {s} >= 26 THEN 'MEDIUM'
 WHEN {s} >= 1 THEN 'LOW' ELSE 'INFORMATIONAL' END"""
_LEVELS = "['LOW', 'MEDIUM', 'HIGH', 'CRITICAL']"


def _confidence(fired: str, total: int) -> str:
    share = f"(({fired}) / CAST({total} AS DOUBLE))"
    return f"CASE WHEN {share} >= 0.8 THEN 'HIGH' WHEN {share} >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"


def _rule(rule_id: str, inner: str, severity: str | None = None) -> str:
    """``inner`` gives capture_id, subject, entity, raw, confidence of fired rows (and severity)."""
    score = "CAST(floor(least(greatest(raw, 0.0), 1.0) * 100) AS INT)"
    level = severity or _SEVERITY.format(s=score)
    return f"""SELECT capture_id, '{rule_id}' AS rule_id, subject, entity, {score} AS risk_score,
 {level} AS severity, confidence, round(raw, 4) AS raw_score FROM ({inner})"""


_FLOW_SUBJECT = "concat_ws('|', src_ip, src_port, dst_ip, dst_port, protocol) AS subject, src_ip AS entity"
D = "CAST({} AS DOUBLE)".format

RULE_SQL = {
    "NET-001": _rule("NET-001", f"""
 SELECT *, src_ip AS subject, src_ip AS entity,
  0.5 * least(unique_dst_ports / {D(200)}, 1.0) + 0.3 * least(connections_per_minute / {D(600)}, 1.0)
  + 0.2 * least(failed_connection_ratio / {D(1)}, 1.0)
  + 0.1 * (least(unique_dst_ports_per_host / {D(50)}, 1.0) * 0.5) AS raw,
  {_confidence('''(unique_dst_ports >= 20)::INT + (connections_per_minute >= 150)::INT
   + (failed_connection_ratio >= 0.7)::INT + (unique_dst_ports_per_host >= 10)::INT''', 4)} AS confidence
 FROM profile WHERE port_scan_suspect""", """CASE
 WHEN unique_dst_ports >= 200 OR connections_per_minute >= 600 THEN 'CRITICAL'
 WHEN unique_dst_ports >= 50 OR connections_per_minute >= 150 THEN 'HIGH'
 WHEN unique_dst_ports >= 20 OR connections_per_minute >= 50 THEN 'MEDIUM' ELSE 'LOW' END"""),
    "NET-002": _rule("NET-002", f"""
 SELECT *, qname AS subject, qname AS entity, {_confidence("strong + weak", 5)} AS confidence,
  least(CASE WHEN b2 THEN 0.30 ELSE 0 END::DOUBLE + CASE WHEN s2 THEN 0.20 ELSE 0 END
   + CASE WHEN e2 THEN 0.20 ELSE 0 END + CASE WHEN f2 THEN 0.15 ELSE 0 END
   + CASE WHEN b1 THEN 0.15 ELSE 0 END + CASE WHEN s1 THEN 0.10 ELSE 0 END
   + CASE WHEN e1 THEN 0.10 ELSE 0 END + CASE WHEN f1 THEN 0.08 ELSE 0 END
   + CASE WHEN i1 THEN 0.07 ELSE 0 END
   + (least(base64_ratio / {D(1)}, 1.0) * 0.10 + least(unique_subdomain_count / {D(100)}, 1.0) * 0.10
   + least(subdomain_entropy / {D(8)}, 1.0) * 0.10
   + least(query_frequency_per_domain / {D(200)}, 1.0) * 0.10), 1.0) AS raw
 FROM (SELECT *, b2::INT + s2::INT + e2::INT + f2::INT AS strong,
   b1::INT + s1::INT + e1::INT + f1::INT + i1::INT AS weak
  FROM (SELECT *, base64_ratio >= 0.7 AS b2, base64_ratio >= 0.3 AND base64_ratio < 0.7 AS b1,
   unique_subdomain_count >= 50 AS s2, unique_subdomain_count BETWEEN 20 AND 49 AS s1,
   subdomain_entropy >= 5.5 AS e2, subdomain_entropy >= 4.0 AND subdomain_entropy < 5.5 AS e1,
   query_frequency_per_domain >= 200 AS f2,
   query_frequency_per_domain >= 60 AND query_frequency_per_domain < 200 AS f1,
   max_query_frequency_per_ip >= 20 AS i1 FROM profile))
 WHERE strong > 0 OR weak >= 2""", f"""{_LEVELS}[CASE WHEN raw >= 0.7 OR strong >= 3 THEN 4
 WHEN raw >= 0.5 OR strong >= 2 THEN 3 WHEN raw >= 0.3 OR strong >= 1 THEN 2 ELSE 1 END]"""),
    "NET-003": _rule("NET-003", f"""
 SELECT *, src_ip AS subject, src_ip AS entity,
  0.4 * least(failed_auth_ratio / {D(1)}, 1.0) + 0.3 * least(coalesce(auth_rate_per_second, 0) / {D(1)}, 1.0)
  + 0.3 * least(failed_auth_count / {D(30)}, 1.0) AS raw,
  {_confidence('''1 + (coalesce(auth_rate_per_second, 0) >= 0.3)::INT
   + (failed_auth_count >= 9)::INT''', 3)} AS confidence
 FROM fs WHERE failed_auth_count >= 3 AND failed_auth_ratio >= 0.7""", f"""{_LEVELS}[CASE
 WHEN raw >= 0.7 OR (coalesce(auth_rate_per_second, 0) >= 1 AND failed_auth_count >= 9) THEN 4
 WHEN raw >= 0.5 OR coalesce(auth_rate_per_second, 0) >= 1 THEN 3 WHEN raw >= 0.3 THEN 2 ELSE 1 END]"""),
    "NET-004": _rule("NET-004", f"""
 SELECT *, src_ip AS subject, src_ip AS entity, least(CASE
   WHEN r2 AND NOT m2 THEN 0.5 * r + 0.2 * m + 0.1 * a WHEN r2 THEN 0.4 * r + 0.4 * m + 0.1 * a
   WHEN a1 AND r1 THEN 0.3 * r + 0.2 * m + 0.4 * a ELSE 0.3 * r + 0.3 * m + 0.3 * a END
   + CASE WHEN r2 OR m2 THEN 0.1 ELSE 0 END::DOUBLE, 1.0) AS raw,
  {_confidence("r1::INT + m1::INT + a1::INT", 3)} AS confidence
 FROM (SELECT *, unique_recipients >= 25 AS r1, unique_recipients >= 100 AS r2, message_count >= 5 AS m1,
   message_count >= 20 AS m2, failed_auth_count >= 3 AS a1, least(unique_recipients / {D(100)}, 1.0) AS r,
   least(message_count / {D(20)}, 1.0) AS m, least(failed_auth_count / {D(9)}, 1.0) AS a FROM ss)
 WHERE r1 OR m1 OR a1""", f"""{_LEVELS}[CASE WHEN raw >= 0.7 OR ((r2 OR m2) AND a1) THEN 4
 WHEN raw >= 0.5 OR r2 OR m2 THEN 3 WHEN raw >= 0.3 THEN 2 ELSE 1 END]"""),
    "NET-005": _rule("NET-005", f"""
 SELECT *, {_FLOW_SUBJECT}, {_confidence("low::INT + burst::INT", 2)} AS confidence,
  least(0.3 + 0.5 * (syn_count / {D(100)}) + CASE WHEN low THEN 0.3 ELSE 0 END::DOUBLE
   + CASE WHEN syn_count >= 100 THEN 0.2 ELSE 0 END::DOUBLE, 1.0) AS raw
 FROM (SELECT *, ack_count / CAST(syn_count AS DOUBLE) < 0.1 AS low,
   greatest(duration_ms, 1) < 5000 AND syn_count >= 100 AS burst
   FROM flow WHERE protocol = 'TCP' AND syn_count >= 20) WHERE low OR burst"""),
    "NET-006": _rule("NET-006", f"""
 SELECT *, '' AS subject, '' AS entity,
  {_confidence("(er >= 0.5)::INT + (agents >= 1)::INT + (share >= 0.7)::INT", 3)} AS confidence,
  least(0.3 + 0.5 * er + CASE WHEN agents >= 1 THEN 0.2 ELSE 0 END::DOUBLE, 1.0) AS raw
 FROM (SELECT capture_id, coalesce(er, 0.0) AS er, coalesce(agents, 0) AS agents,
   most / CAST(listed AS DOUBLE) AS share
  FROM (SELECT capture_id, max(requests) AS most, sum(requests) AS listed FROM top GROUP BY 1)
  LEFT JOIN (SELECT capture_id, count(*) FILTER (status_code >= 400) / CAST(count(*) AS DOUBLE) AS er
    FROM http WHERE status_code IS NOT NULL GROUP BY 1) USING (capture_id)
  LEFT JOIN (SELECT capture_id, count(DISTINCT user_agent) AS agents FROM http
    WHERE regexp_matches(lower(user_agent), 'nmap|sqlmap|nikto|masscan|wpscan|curl|python-requests')
    GROUP BY 1) USING (capture_id))
 WHERE er >= 0.5 OR agents >= 1 OR share >= 0.7"""),
    "NET-007": _rule("NET-007", f"""
 SELECT *, {_FLOW_SUBJECT}, {_confidence("(pps >= 50)::INT + (packets_total >= 100)::INT", 2)} AS confidence,
  least(0.2 + 0.6 * least(packets_total / {D(100)}, 1.0) + CASE WHEN pps >= 200 THEN 0.2 ELSE 0 END::DOUBLE,
   1.0) AS raw
 FROM (SELECT *, packets_total / (greatest(duration_ms, 1) / {D(1000)}) AS pps FROM flow
   WHERE protocol = 'ICMP') WHERE packets_total >= 100 OR pps >= 50"""),
    "NET-008": _rule("NET-008", f"""
 SELECT *, {_FLOW_SUBJECT},
  {_confidence("1 + (bytes_total >= 1000000)::INT + (bps >= 5)::INT", 3)} AS confidence,
  least(least(0.4 + share * 0.6, 1.0) + CASE WHEN bps >= 20 THEN 0.2 ELSE 0 END::DOUBLE, 1.0) AS raw
 FROM (SELECT f.*, f.bytes_total / CAST(greatest(b.total_bytes, 1) AS DOUBLE) AS share,
   f.bytes_total / greatest(duration_seconds, 1.0) AS bps FROM flow f JOIN base b USING (capture_id))
 WHERE share >= 0.5"""),
    "NET-009": _rule("NET-009", f"""
 SELECT *, {_FLOW_SUBJECT}, 'HIGH' AS confidence,
  least(0.3 + 0.5 * (1 - least(cv / {D(0.3)}, 1.0)) + CASE WHEN size < 100 THEN 0.1 ELSE 0 END::DOUBLE
   + CASE WHEN cv < 0.05 THEN 0.2 ELSE 0 END::DOUBLE, 1.0) AS raw
 FROM (SELECT *, bytes_total / CAST(packets_total AS DOUBLE) AS size,
   sqrt(inter_packet_interval_variance_ms) / nullif(inter_packet_interval_ms, 0) AS cv FROM flow)
 WHERE packets_total >= 10 AND duration_ms >= 5000 AND size < 200 AND inter_packet_interval_ms > 0
  AND cv < 0.3"""),
    "NET-010": _rule("NET-010", f"""
 SELECT capture_id, concat(src_ip, '|', dst_ip) AS subject, src_ip AS entity,
  CAST(0.4 AS DOUBLE) + CASE WHEN web + pass >= 5 THEN 0.3 ELSE 0 END::DOUBLE
   + CASE WHEN pass > 0 THEN 0.2 ELSE 0 END::DOUBLE AS raw,
  {_confidence("1 + (web + pass >= 5)::INT + (pass > 0)::INT", 3)} AS confidence
 FROM (SELECT capture_id, src_ip, dst_ip, sum(web) AS web, sum(pass) AS pass FROM (
   SELECT capture_id, src_ip, dst_ip, 1 AS web, 0 AS pass FROM http
    WHERE regexp_matches(lower(uri), 'login|signin|auth|authenticate|token|password')
   UNION ALL SELECT capture_id, src_ip, dst_ip, 0, 1 FROM ftp WHERE upper(command) = 'PASS') GROUP BY ALL)"""),
    "NET-011": _rule("NET-011", f"""
 SELECT *, {_FLOW_SUBJECT}, CASE WHEN up THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
  least(CAST(0.4 AS DOUBLE) + CASE WHEN up THEN 0.3 ELSE 0 END::DOUBLE
   + CASE WHEN dst_port IN (80, 443, 8080) THEN 0.1 ELSE 0 END::DOUBLE
   + CASE WHEN protocol = 'TCP' THEN 0.1 ELSE 0 END::DOUBLE, 1.0) AS raw
 FROM (SELECT *, src_bytes / CAST(bytes_total AS DOUBLE) > 0.3 AS up FROM flow
   WHERE duration_ms >= 1000 AND bytes_total >= 100000000
   AND NOT starts_with(dst_ip, '10.') AND starts_with(src_ip, '10.'))"""),
}


def _rule_cte(*tables: str) -> str:
    """Everything the given rules read."""
    parts = [cte("packets", *tables), _flow_cte(), _PROFILE, _BASE]
    if "dns" in tables:
        parts.append(_DNS.replace("profile AS (", "dns_profile AS ("))
    for name, text in (("http", _HTTP), ("ftp", _FTP), ("smtp", _SMTP)):
        if name in tables:
            parts.append(text)
    return ",".join(parts)


RULE_TABLES = {
    "NET-002": ("dns",), "NET-003": ("ftp",), "NET-004": ("smtp",), "NET-006": ("http",),
    "NET-010": ("http", "ftp"),
}
RULE_SQL["NET-002"] = RULE_SQL["NET-002"].replace("FROM profile", "FROM dns_profile")
for _id, _sql in RULE_SQL.items():
    ORACLES["rule_" + _id.replace("-", "").lower()] = (
        f"{_rule_cte(*RULE_TABLES.get(_id, ()))} {_sql}"
    )

ALL_RULES = _rule_cte("dns", "http", "ftp", "smtp")
FINDINGS = ", finding AS (" + " UNION ALL ".join(RULE_SQL.values()) + ")"
ORACLES["findings_all"] = f"{ALL_RULES}{FINDINGS} SELECT * FROM finding"
_WEIGHT = """CASE severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2
 ELSE 1 END"""
_OVERALL = f""", risk AS (SELECT capture_id, max(risk_score) AS max_score,
   CAST(sum(risk_score * {_WEIGHT}) // sum({_WEIGHT}) AS BIGINT) AS weighted_score,
   count(*) AS total_findings, count(*) FILTER (severity = 'CRITICAL') AS critical
   FROM finding GROUP BY 1),
overall AS (SELECT b.capture_id, coalesce(max_score, 0) AS max_score,
   coalesce(weighted_score, 0) AS weighted_score, CASE WHEN weighted_score >= 76 THEN 'Critical'
   WHEN weighted_score >= 51 THEN 'High' WHEN weighted_score >= 26 THEN 'Medium'
   WHEN weighted_score >= 1 THEN 'Low' ELSE 'Informational' END AS severity_label,
   coalesce(total_findings, 0) AS total_findings, coalesce(critical, 0) AS critical
   FROM base b LEFT JOIN risk USING (capture_id))"""
ORACLES["overall_risk_scores"] = f"""{ALL_RULES}{FINDINGS}{_OVERALL}
SELECT *, CAST(least(total_findings, 5) AS INT) AS top_findings FROM overall"""
ORACLES["overall_risk_worst"] = f"""{ALL_RULES}{FINDINGS},
o AS (SELECT capture_id, risk_score, row_number() OVER (PARTITION BY capture_id ORDER BY risk_score DESC)
   AS place FROM finding),
w AS (SELECT capture_id, max(risk_score) AS top, coalesce(sum(risk_score) FILTER (place BETWEEN 2 AND 4), 0)
   AS more FROM o GROUP BY 1)
SELECT b.capture_id, coalesce(top, 0) AS max_score,
 round(least(coalesce(top, 0) + coalesce(more, 0) * {D(0.05)}, 100.0), 2) AS worst_first_score
FROM base b LEFT JOIN w USING (capture_id)"""

# -- evaluation --------------------------------------------------------------------------------
_MATRIX = f"""{cte("ground_truth", "alerts")},
known AS (SELECT * FROM (VALUES ('NET-001', 'Port Scan Detection'), ('NET-002', 'DNS Tunneling Detection'),
   ('NET-003', 'FTP Brute Force Detection'), ('NET-004', 'SMTP Abuse Detection')) v(rule_id, rule_name)),
expect AS (SELECT * FROM (VALUES ('port_scan', 'NET-001'), ('dns_tunneling', 'NET-002'),
   ('ftp_brute_force', 'NET-003'), ('smtp_abuse', 'NET-004'), ('botnet_c2', 'NET-001'),
   ('botnet_c2', 'NET-002')) v(attack, rule_id)),
j AS (SELECT rule_id, rule_name, attack_present AND EXISTS (SELECT 1 FROM expect e
     WHERE e.attack = g.attack_type AND e.rule_id = k.rule_id) AS want,
   EXISTS (SELECT 1 FROM alerts a WHERE a.session_id = g.capture_id AND a.rule_id = k.rule_id) AS hit
   FROM ground_truth g, known k),
m AS (SELECT rule_id, rule_name, count(*) AS labeled_captures, count(*) FILTER (want AND hit) AS tp,
   count(*) FILTER (NOT want AND hit) AS fp, count(*) FILTER (NOT want AND NOT hit) AS tn,
   count(*) FILTER (want AND NOT hit) AS fn FROM j GROUP BY ALL),
r AS (SELECT *, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS p,
   coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS q FROM m),
x AS (SELECT *, coalesce(2 * p * q / nullif(p + q, 0), 0) AS f FROM r)"""
ORACLES["confusion_matrix"] = f"""{_MATRIX}
SELECT rule_id, rule_name, labeled_captures, tp, fp, tn, fn, round(p, 4) AS precision,
 round(q, 4) AS recall, round(f, 4) AS f1, round(coalesce(fp / CAST(nullif(fp + tn, 0) AS DOUBLE), 0), 4) AS fpr,
 round((tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE), 4) AS accuracy FROM x"""
ORACLES["macro_metrics"] = f"""{_MATRIX}
SELECT max(labeled_captures) AS labeled_captures, round(avg(p), 4) AS macro_precision,
 round(avg(q), 4) AS macro_recall, round(avg(f), 4) AS macro_f1, CAST(sum(tp) AS BIGINT) AS total_tp,
 CAST(sum(fp) AS BIGINT) AS total_fp, CAST(sum(tn) AS BIGINT) AS total_tn,
 CAST(sum(fn) AS BIGINT) AS total_fn FROM x"""
ORACLES["capture_evaluation"] = f"""{cte("packets", "ground_truth", "alerts")},
s AS (SELECT capture_id, count(*) AS packet_count FROM packets GROUP BY 1),
f AS (SELECT session_id AS capture_id, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules,
   count(*) AS n FROM alerts GROUP BY 1)
SELECT s.capture_id, packet_count, attack_present IS NOT NULL AS has_label,
 coalesce(attack_present, FALSE) AS attack_present, coalesce(attack_type, '') AS attack_types,
 coalesce(rules, '') AS rule_ids_fired, coalesce(n, 0) AS findings,
 round(packet_count / {D(2)}, 2) AS throughput_pps
FROM s LEFT JOIN ground_truth USING (capture_id) LEFT JOIN f USING (capture_id)"""

# -- dissector ---------------------------------------------------------------------------------
def _parsed(name: str, columns: str, number: str = "seq") -> str:
    """What is left of packet texts: broken numbers are NULL, broken addresses lose the packet."""
    return f"{cte(name)} SELECT capture_id, {number}, src_ip, {columns} FROM {name} WHERE {number} % 13 <> 0"


_JUNK = "CASE WHEN {} % 11 = 0 THEN NULL ELSE {} END AS {}".format
ORACLES["parsed_packets"] = _parsed(
    "packets",
    "ts_ms, dst_ip, protocol, CAST(length AS BIGINT) AS length, "
    "CASE WHEN protocol = 'TCP' THEN tcp_flags END AS tcp_flags, "
    "CASE WHEN packet_number % 11 = 0 OR protocol = 'ICMP' THEN NULL ELSE src_port END AS src_port, "
    "CASE WHEN protocol <> 'ICMP' THEN dst_port END AS dst_port",
    "packet_number",
)
_NUMBERED = " UNION ALL ".join(
    f"SELECT capture_id, '{k}' AS kind, {'packet_number' if k == 'packets' else 'seq'} AS number FROM {k}"
    for k in ("packets", "dns", "http", "ftp", "smtp")
)
ORACLES["stored_records"] = f"""{cte("packets", "dns", "http", "ftp", "smtp")}
SELECT capture_id, kind, count(*) AS records FROM ({_NUMBERED}) WHERE number % 13 <> 0 GROUP BY ALL"""
ORACLES["packets_from_array"] = ORACLES["parsed_packets"]
ORACLES["parsed_dns"] = _parsed(
    "dns",
    "qname, qtype, response_code, "
    + _JUNK("seq", "CAST(query_size_bytes AS BIGINT)", "query_size_bytes"),
)
ORACLES["parsed_http"] = _parsed(
    "http", "method, host, uri, user_agent, " + _JUNK("seq", "status_code", "status_code")
)
ORACLES["parsed_ftp"] = _parsed("ftp", "command, response_code")
ORACLES["parsed_smtp"] = _parsed("smtp", "command, response_code")

# -- alerts of findings ------------------------------------------------------------------------
ORACLES["severe_findings"] = (
    f"{ALL_RULES}{FINDINGS} SELECT * FROM finding WHERE severity IN ('HIGH', 'CRITICAL')"
)
ORACLES["stored_alert_rows"] = f"""{ALL_RULES}{FINDINGS}
SELECT capture_id, rule_id, lower(severity) AS severity, rule_id AS category, FALSE AS ai_corroborated,
 risk_score, confidence FROM finding"""
ORACLES["live_alert_records"] = f"""{ALL_RULES}{FINDINGS}
SELECT CAST(capture_id AS VARCHAR) AS session_id, rule_id, lower(severity) AS severity,
 lower(confidence) AS confidence, risk_score, 'active' AS status FROM finding"""
ORACLES["retained_flows"] = f"""{FLOWS}
SELECT capture_id, src_ip, nullif(src_port, 0) AS src_port, dst_ip, nullif(dst_port, 0) AS dst_port, protocol
FROM flow WHERE DATE '2024-01-01' + CAST(capture_id % 100 AS INT) >= DATE '2024-01-11'"""

ORACLES["flow_rollup"] = f"""{FLOWS},
s AS (SELECT capture_id, src_ip, dst_ip, nullif(dst_port, 0) AS dst_port, protocol, packets_total, src_bytes,
  dst_bytes, start_ms - start_ms % 3600000 AS hour_ms, capture_id % 10 < 3 AS summed FROM flow)
SELECT capture_id, src_ip, dst_ip, dst_port, protocol, count(*) AS flows, CAST(sum(packets_total) AS BIGINT) AS packets,
 CAST(sum(src_bytes) AS BIGINT) AS bytes_sent, CAST(sum(dst_bytes) AS BIGINT) AS bytes_recv, hour_ms, summed
FROM s WHERE summed GROUP BY ALL
UNION ALL SELECT capture_id, src_ip, dst_ip, dst_port, protocol, 1, packets_total, src_bytes, dst_bytes, NULL, summed
FROM s WHERE NOT summed"""

# -- events ------------------------------------------------------------------------------------
_BAD = {
    "src_ip": "src_ip = '' OR src_ip = '10.0.0.256'",
    "dst_ip": "dst_ip = 'server'",
    "src_port": "CAST(src_port AS BIGINT) NOT BETWEEN 0 AND 65535",
    "dst_port": "CAST(dst_port AS BIGINT) NOT BETWEEN 0 AND 65535",
    "protocol": "trim(protocol) = ''",
    "ts": "ts = 'yesterday'",
    "bytes": "bytes = 'many'",
    "packets": "CAST(packets AS BIGINT) < 1",
    "http_status": "CAST(http_status AS BIGINT) NOT BETWEEN 100 AND 599",
    "session_id": "session_id = 'nope'",
}
_REASONS = "concat_ws(',', " + ", ".join(
    f"CASE WHEN {bad} THEN '{name}' END" for name, bad in _BAD.items()
) + ")"
ORACLES["event_validation"] = f"""{cte("raw_events")}
SELECT seq, {_REASONS} AS rejected_for FROM raw_events"""
ORACLES["typed_events"] = f"""{cte("raw_events")}
SELECT seq, src_ip, dst_ip, CAST(src_port AS INT) AS src_port, CAST(dst_port AS INT) AS dst_port,
 upper(trim(protocol)) AS protocol, CAST(packets AS BIGINT) AS packets,
 coalesce(CAST(bytes AS BIGINT), 0) AS bytes, coalesce(session_id, 'none') AS session_id,
 coalesce(epoch_ms(CAST(replace(replace(ts, 'T', ' '), 'Z', '') AS TIMESTAMP)), 0) AS ts_ms
FROM raw_events WHERE {_REASONS} = ''"""
_VALID = f"""{cte("raw_events")}, v AS (SELECT *, coalesce(session_id, 'none') AS own FROM raw_events
 WHERE {_REASONS} = '')"""
ORACLES["event_http_records"] = f"""{_VALID}
SELECT own AS session_id, seq, http_method AS method, coalesce(http_host, dst_ip) AS host,
 coalesce(nullif(http_uri, ''), '/') AS uri, CAST(http_status AS INT) AS status_code FROM v WHERE http_method <> ''"""
ORACLES["event_dns_records"] = f"""{_VALID}
SELECT own AS session_id, seq, dns_qname AS qname, coalesce(nullif(dns_qtype, ''), 'A') AS qtype FROM v
WHERE dns_qname <> ''"""
ORACLES["address_classes"] = f"""{cte("packets")},
ips AS (SELECT src_ip AS ip FROM packets UNION ALL SELECT dst_ip FROM packets)
SELECT ip, starts_with(ip, '10.') AS private, count(*) AS packets FROM ips GROUP BY ip"""
_ENDS = """
e1 AS (SELECT *, capture_id AS session_id, coalesce(src_port, 0) AS sp, coalesce(dst_port, 0) AS dp FROM packets),
e2 AS (SELECT *, src_ip < dst_ip OR (src_ip = dst_ip AND sp <= dp) AS fwd FROM e1),
e AS (SELECT session_id, ts_ms, protocol, length, tcp_flags, CASE WHEN fwd THEN src_ip ELSE dst_ip END AS left_ip,
   CASE WHEN fwd THEN sp ELSE dp END AS left_port, CASE WHEN fwd THEN dst_ip ELSE src_ip END AS right_ip,
   CASE WHEN fwd THEN dp ELSE sp END AS right_port FROM e2)"""
ORACLES["sliding_flow_counts"] = f"""{cte("packets")},{_ENDS}
SELECT session_id, (ts_ms // 1000 - k) * 1000 AS window_ms, protocol, left_ip, left_port, right_ip,
 right_port, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes,
 count(*) FILTER (tcp_flags IN ('0x002', '0x012')) AS syn
FROM e, range(0, 5) r(k) GROUP BY ALL"""
_SESSION_KEY = "session_id, protocol, left_ip, left_port, right_ip, right_port"
ORACLES["session_flows"] = f"""{cte("packets")},{_ENDS},
b AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY {_SESSION_KEY} ORDER BY ts_ms) < 30000
   THEN 0 ELSE 1 END AS opens FROM e),
s AS (SELECT *, sum(opens) OVER (PARTITION BY {_SESSION_KEY} ORDER BY ts_ms
   RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM b)
SELECT session_id, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, protocol, left_ip, left_port, right_ip,
 right_port, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes
FROM s GROUP BY {_SESSION_KEY}, part"""

ORACLES["rule_failures"] = f"""{FLOWS}
SELECT DISTINCT capture_id, 'BAD-001' AS rule_id, 'run' AS stage, 'DIVIDE_BY_ZERO' AS error FROM flow WHERE dst_port = 300"""
_EVENT_RULES = " UNION ALL ".join(f"({RULE_SQL[r]})" for r in ("NET-005", "NET-007", "NET-008", "NET-009", "NET-011"))
ORACLES["stream_findings"] = f"""{cte("packets")},{_flow_cte("capture_id", directed_icmp=False)},{_PROFILE},{_BASE}
SELECT CAST(capture_id AS VARCHAR) AS session_id, rule_id, risk_score, lower(severity) AS severity,
 lower(confidence) AS confidence, raw_score FROM ({_EVENT_RULES})"""
ORACLES["isolated_findings"] = ORACLES["findings_all"]

# a walk from opening to opening, one recursion step per closed flow; then flows of (session, opening)
_OPENINGS = cte("packets").replace("WITH packets AS", "WITH RECURSIVE raw AS") + """,
k AS (SELECT *, CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND coalesce(src_port, 0) <= coalesce(dst_port, 0))
   THEN concat_ws('|', capture_id, protocol, src_ip, coalesce(src_port, 0), dst_ip, coalesce(dst_port, 0))
   ELSE concat_ws('|', capture_id, protocol, dst_ip, coalesce(dst_port, 0), src_ip, coalesce(src_port, 0)) END AS flow_id
   FROM raw),
o(flow_id, opened) AS (SELECT flow_id, min(ts_ms) FROM k GROUP BY 1 UNION ALL
  SELECT o.flow_id, min(k.ts_ms) FROM o JOIN k ON k.flow_id = o.flow_id AND k.ts_ms >= o.opened + 30000
  GROUP BY o.flow_id, o.opened),
packets AS (SELECT k.* REPLACE (concat(k.capture_id, '@', o.opened) AS capture_id)
  FROM k ASOF JOIN o ON k.flow_id = o.flow_id AND k.ts_ms >= o.opened)"""
ORACLES["active_flows"] = f"""{_OPENINGS},{_flow_cte("session_id", directed_icmp=False)}
SELECT CAST(split_part(session_id, '@', 1) AS BIGINT) AS session_id, src_ip, src_port, dst_ip, dst_port, protocol,
 packets_total, bytes_total, src_bytes, dst_bytes, start_ms, end_ms, duration_ms, syn_count, rst_count, ack_count,
 protocol = 'TCP' AND rst_count > 0 AND bytes_total <= 200 AS is_failed_flow, inter_packet_interval_ms,
 inter_packet_interval_variance_ms FROM flow"""

# -- adaptive scores ---------------------------------------------------------------------------
ORACLES["adaptive_scores_original"] = f"""{cte("scores")},
w AS (SELECT *, count(raw_score) OVER prev AS n, avg(raw_score) OVER prev AS mu,
   stddev_pop(raw_score) OVER prev AS sd FROM scores WINDOW prev AS (PARTITION BY session_id, rule_id
   ORDER BY flush_id, seq ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, first_value(n) OVER f AS bn, first_value(mu) OVER f AS bm, first_value(sd) OVER f AS bs
   FROM w WINDOW f AS (PARTITION BY session_id, rule_id, flush_id ORDER BY seq)),
z AS (SELECT *, CASE WHEN bs > 1e-9 THEN greatest(least((raw_score - bm) / bs, 3.0), -3.0)
   ELSE sign(raw_score - bm) * 3.0 END AS z FROM b)
SELECT session_id, rule_id, flush_id, seq, bn AS baseline_samples,
 round(CASE WHEN bn < 10 THEN raw_score ELSE least(greatest(raw_score * (1.0 + z * 0.15), 0.0), 1.0) END, 6)
   AS adapted_score FROM z"""
ORACLES["adaptive_scores_blocks"] = ORACLES["adaptive_scores_original"]
ORACLES["adaptive_rescored"] = ORACLES["adaptive_scores_original"][
    : ORACLES["adaptive_scores_original"].rindex("SELECT session_id")
] + """, a AS (SELECT *, CASE WHEN bn < 10 OR rule_id = 'NET-003' THEN raw_score
   ELSE round(least(greatest(raw_score * (1.0 + z * 0.15), 0.0), 1.0), 9) END AS adapted FROM z),
s AS (SELECT *, CAST(floor(adapted * 100) AS INT) AS risk_score FROM a)
SELECT session_id, rule_id, flush_id, seq, round(adapted, 6) AS raw_score, risk_score, CASE
 WHEN risk_score >= 76 THEN 'CRITICAL' WHEN risk_score >= 51 THEN 'HIGH' WHEN risk_score >= 26 THEN 'MEDIUM'
 WHEN risk_score >= 1 THEN 'LOW' ELSE 'INFORMATIONAL' END AS severity FROM s"""
# a baseline is a list of the latest 100 adapted scores, one recursion step per flush of a rule
ORACLES["adaptive_scores"] = f"""{cte("scores").replace("WITH ", "WITH RECURSIVE ", 1)},
g AS (SELECT session_id, rule_id, flush_id, list(raw_score ORDER BY seq) AS raws, list(seq ORDER BY seq) AS seqs,
   row_number() OVER (PARTITION BY session_id, rule_id ORDER BY flush_id) AS k FROM scores
   GROUP BY session_id, rule_id, flush_id),
r(session_id, rule_id, k, flush_id, seqs, n, adapted, past) AS (
 SELECT session_id, rule_id, k, flush_id, seqs, CAST(0 AS BIGINT), raws, raws[-100:] FROM g WHERE k = 1
 UNION ALL
 SELECT session_id, rule_id, k, flush_id, seqs, n, adapted, list_concat(past, adapted)[-100:] FROM (
  SELECT *, CASE WHEN n < 10 THEN raws ELSE [least(greatest(x * (1.0 + 0.15 * CASE WHEN sd > 1e-9
     THEN greatest(least((x - mu) / sd, 3.0), -3.0) ELSE sign(x - mu) * 3.0 END), 0.0), 1.0) for x in raws] END AS adapted
  FROM (SELECT g.*, past, CAST(len(past) AS BIGINT) AS n, list_avg(past) AS mu, list_stddev_pop(past) AS sd
   FROM r JOIN g ON g.session_id = r.session_id AND g.rule_id = r.rule_id AND g.k = r.k + 1)))
SELECT session_id, rule_id, flush_id, unnest(seqs) AS seq, n AS baseline_samples,
 round(unnest(adapted), 6) AS adapted_score FROM r"""
ORACLES["adaptive_baselines"] = f"""{cte("scores")},
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, rule_id ORDER BY flush_id DESC, seq DESC) AS place
   FROM scores)
SELECT session_id, rule_id, count(*) AS samples, round(avg(raw_score), 6) AS mean,
 round(stddev_pop(raw_score), 6) AS std_dev FROM r WHERE place <= 100 GROUP BY ALL"""

ORACLES["adaptive_scores_speculated"] = ORACLES["adaptive_scores"]
ORACLES["stream_scores"] = ORACLES["adaptive_scores"].replace(
    "CAST((event_id - event_id % 10) / 10 AS BIGINT) AS flush_id", "event_id // 500 AS flush_id"
)

# -- assessment --------------------------------------------------------------------------------
ORACLES["assessment_parse"] = """
WITH r AS (SELECT *, event_id % 17 <> 0 AND event_id % 13 <> 0 AS ok FROM events)
SELECT event_id AS response_id, ok AS valid, CASE WHEN ok THEN event_type || ' seen' END AS executive_summary,
 CAST(CASE WHEN ok THEN 1 END AS INT) AS rationales,
 CASE WHEN ok THEN 'f' || CAST(event_id AS VARCHAR) END AS finding_id,
 CASE WHEN ok THEN 'medium' END AS qualifier,
 CASE WHEN ok THEN CAST(least(greatest(event_id % 5 - 1, 0), 1) AS DOUBLE) END AS likelihood,
 CAST(CASE WHEN ok THEN 2 END AS INT) AS steps,
 CASE WHEN ok THEN CAST(event_id % 4 + 1 AS VARCHAR) || ',3' END AS priorities FROM r"""
_ONE_ENTITY = ("NET-001", "NET-003", "NET-004")
_HOSTS = f"""{FINDINGS}, hosts AS (
 SELECT DISTINCT f.capture_id, unnest(CASE WHEN rule_id = 'NET-006' THEN [] WHEN rule_id IN {_ONE_ENTITY!r} THEN [entity]
   WHEN rule_id = 'NET-002' THEN list_concat([entity, top_src_ip], string_split(listed_src_ips, ','))
   WHEN rule_id = 'NET-010' THEN string_split(subject, '|')
   ELSE [split_part(subject, '|', 1), split_part(subject, '|', 3)] END) AS host
 FROM finding f LEFT JOIN dns_profile p ON rule_id = 'NET-002' AND f.capture_id = p.capture_id AND subject = qname)"""
ORACLES["affected_hosts"] = f"{ALL_RULES}{_HOSTS} SELECT * FROM hosts"
ORACLES["template_summary"] = f"""{ALL_RULES}{_HOSTS}{_OVERALL},
n AS (SELECT capture_id, count(*) AS hosts FROM hosts GROUP BY 1),
first_one AS (SELECT * FROM (SELECT f.capture_id, f.rule_id, f.entity, f.subject, row_number() OVER (
   PARTITION BY f.capture_id ORDER BY CASE f.rule_id WHEN 'NET-006' THEN 7 WHEN 'NET-007' THEN 6
     ELSE CAST(right(f.rule_id, 2) AS INT) * 1.0 + CASE WHEN f.rule_id > 'NET-007' THEN 1 ELSE 0 END END,
   x.start_ms, f.subject) AS place
   FROM finding f LEFT JOIN (SELECT capture_id, concat_ws('|', src_ip, src_port, dst_ip, dst_port, protocol)
     AS subject, start_ms FROM flow) x ON f.capture_id = x.capture_id AND f.subject = x.subject) WHERE place = 1)
SELECT o.capture_id, CASE WHEN total_findings = 0 THEN
  'No findings were detected. The network appears clean.' ELSE
  'Detected ' || total_findings || ' finding(s) across ' || coalesce(hosts, 0) || ' affected host(s). Overall risk is '
  || severity_label || ' (weighted score: ' || weighted_score || '). The top concern is '
  || CASE rule_id WHEN 'NET-001' THEN 'Port scan detected from ' || entity
     WHEN 'NET-002' THEN 'Potential DNS tunneling detected: ' || entity
     WHEN 'NET-006' THEN 'HTTP Anomaly Detected'
     WHEN 'NET-003' THEN 'FTP brute force detected from ' || entity
     WHEN 'NET-004' THEN 'SMTP abuse detected from ' || entity WHEN 'NET-005' THEN 'SYN Flood from ' || entity
     WHEN 'NET-007' THEN 'ICMP Flood from ' || entity
     WHEN 'NET-008' THEN 'Top Talker: ' || entity || ' → ' || split_part(subject, '|', 3)
     WHEN 'NET-009' THEN 'Beaconing ' || entity || ' → ' || split_part(subject, '|', 3)
     ELSE 'Cleartext credentials from ' || entity || ' to ' || split_part(subject, '|', 2) END
  || ' (' || rule_id || '). Investigate the source IPs in your SIEM and apply recommended remediation steps.'
  END AS executive_summary
FROM overall o LEFT JOIN n USING (capture_id) LEFT JOIN first_one USING (capture_id)"""
ORACLES["context_summary"] = f"""{cte("packets", "dns", "http")},{_DNS},
t AS (SELECT capture_id, count(*) AS total_packets, CAST(sum(length) AS BIGINT) AS total_bytes,
   round((max(ts_ms) - min(ts_ms)) / 1000.0, 4) AS duration_seconds FROM packets GROUP BY 1),
pr AS (SELECT capture_id, string_agg(protocol || '=' || n, ',' ORDER BY n DESC, protocol) AS top_protocols
   FROM (SELECT capture_id, protocol, count(*) AS n FROM packets GROUP BY ALL) GROUP BY 1),
ip AS (SELECT capture_id, ip, sum(sent) AS s, sum(got) AS g FROM (
   SELECT capture_id, src_ip AS ip, length AS sent, 0 AS got FROM packets
   UNION ALL SELECT capture_id, dst_ip, 0, length FROM packets) GROUP BY ALL),
ta AS (SELECT capture_id, max(n) AS unique_ips, string_agg(ip || '=' || b, ',' ORDER BY place)
   FILTER (place <= 10) AS top_talkers
   FROM (SELECT capture_id, ip, CAST(greatest(s, g) AS BIGINT) AS b, count(*) OVER (PARTITION BY capture_id) AS n,
     row_number() OVER (PARTITION BY capture_id ORDER BY greatest(s, g) DESC, ip) AS place FROM ip) GROUP BY 1),
dd AS (SELECT capture_id, count(*) AS total_domains_queried,
   string_agg(domain || '=' || domain_queries, ',' ORDER BY domain_queries DESC, domain) AS top_dns_domains
   FROM dom GROUP BY 1),
hr AS (SELECT capture_id, count(*) AS total_http_requests FROM http WHERE method <> '' GROUP BY 1)
SELECT capture_id, total_packets, total_bytes, duration_seconds, unique_ips, total_domains_queried,
 total_http_requests, top_protocols, top_talkers, top_dns_domains
FROM t JOIN pr USING (capture_id) JOIN ta USING (capture_id) LEFT JOIN dd USING (capture_id)
LEFT JOIN hr USING (capture_id)"""
