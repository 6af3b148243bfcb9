"""Network tables derived from the driver's tables.

Each text runs unchanged in Spark and DuckDB and uses every row of its source tables; the number
of captures grows with the data. Times are epoch milliseconds; ``load`` adds a timestamp column
for Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_MS = 1704067200000  # 2024-01-01T00:00:00Z

# Ordinary traffic: one packet per line item, eight captures per 100,000 orders. The packet number
# grows with time; equal packet numbers have equal stamps, so ties do not change any result.
LINE_PACKETS = f"""
WITH b AS (
 SELECT l_suppkey % 8 + 8 * CAST((l_orderkey - l_orderkey % 100000) / 100000 AS BIGINT) AS capture_id,
        l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, l_orderkey * 8 + l_linenumber AS pn,
        CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS d,
        CAST(round(l_tax * 100) AS BIGINT) AS t, l_returnflag AS rf
 FROM {{lineitem}}),
c AS (
 SELECT *, CASE WHEN d = 0 THEN 'ICMP' WHEN d <= 3 THEN 'UDP' ELSE 'TCP' END AS protocol,
   concat('10.0.', CAST(sk % 4 AS VARCHAR(9)), '.', CAST(ok % 16 + 1 AS VARCHAR(9))) AS client,
   CASE WHEN ok % 16 = 3 THEN '93.184.216.34'
        ELSE concat('10.1.0.', CAST(pk % 6 + 1 AS VARCHAR(9))) END AS server,
   CAST(1024 + ok % 16 AS INT) AS cport,
   CAST(CASE WHEN ok % 16 = 5 THEN 1 + pk % 400 WHEN d <= 3 THEN 53 WHEN t <= 2 THEN 80
             WHEN t <= 4 THEN 21 WHEN t <= 6 THEN 25 ELSE 443 END AS INT) AS sport
 FROM b)
SELECT capture_id, pn AS packet_number, {EPOCH_MS} + pn * 5 + (pn * 7919) % 5 AS ts_ms,
  CASE WHEN rf = 'R' THEN server ELSE client END AS src_ip,
  CASE WHEN rf = 'R' THEN client ELSE server END AS dst_ip,
  CASE WHEN protocol = 'ICMP' THEN NULL WHEN rf = 'R' THEN sport ELSE cport END AS src_port,
  CASE WHEN protocol = 'ICMP' THEN NULL WHEN rf = 'R' THEN cport ELSE sport END AS dst_port,
  protocol, 40 + q * 28 AS length,
  CASE WHEN protocol <> 'TCP' THEN NULL WHEN ok % 16 = 7 THEN '0x002' WHEN d = 4 THEN '0x002'
       WHEN d = 5 THEN '0x012' WHEN d = 6 THEN '0x004' ELSE '0x010' END AS tcp_flags
FROM c
"""

# Attack traffic: every order is a packet; each block of 1,000 orders forms five captures
# (0 beacon, 1 ICMP flood, 2 bulk upload, 3 vertical scan, 4 plain browsing).
ORDER_PACKETS = f"""
WITH o AS (
 SELECT CAST((o_orderkey - o_orderkey % 1000) / 1000 AS BIGINT) AS block, o_orderkey % 1000 AS i FROM {{orders}}),
k AS (
 SELECT block, i, CASE WHEN i < 60 THEN 0 WHEN i < 360 THEN 1 WHEN i < 510 THEN 2
                       WHEN i < 760 THEN 3 ELSE 4 END AS kind,
        CASE WHEN i < 60 THEN i WHEN i < 360 THEN i - 60 WHEN i < 510 THEN i - 360
             WHEN i < 760 THEN i - 510 ELSE i - 760 END AS n
 FROM o)
SELECT 1000000 + block * 10 + kind AS capture_id, n + 1 AS packet_number,
  {EPOCH_MS} + n * CASE kind WHEN 0 THEN 5000 WHEN 1 THEN 4 WHEN 2 THEN 20 WHEN 3 THEN 10 ELSE 250 END
    AS ts_ms,
  concat('10.9.0.', CAST(kind + 1 AS VARCHAR(9))) AS src_ip,
  CASE kind WHEN 0 THEN '8.8.4.4' WHEN 1 THEN '10.9.0.250' WHEN 2 THEN '8.8.4.4'
            WHEN 3 THEN '10.9.0.251' ELSE '93.184.216.34' END AS dst_ip,
  CASE WHEN kind = 1 THEN NULL ELSE CAST(50001 + kind AS INT) END AS src_port,
  CASE kind WHEN 1 THEN NULL WHEN 3 THEN CAST(1 + n AS INT) ELSE CAST(443 AS INT) END AS dst_port,
  CASE WHEN kind = 1 THEN 'ICMP' ELSE 'TCP' END AS protocol,
  CASE kind WHEN 0 THEN 90 WHEN 1 THEN 84 WHEN 2 THEN 1000000 WHEN 3 THEN 60 ELSE 600 + n END
    AS length,
  CASE kind WHEN 1 THEN NULL WHEN 3 THEN '0x002' ELSE '0x010' END AS tcp_flags
FROM k
"""

PACKETS = f"SELECT * FROM ({LINE_PACKETS}) lp UNION ALL SELECT * FROM ({ORDER_PACKETS}) op"

_EVENT_KEYS = (
    "user_id % 4 + 4 * CAST((event_id - event_id % 100000) / 100000 AS BIGINT) AS capture_id, "
    f"event_id AS seq, {EPOCH_MS} + event_id * 180 AS ts_ms"
)

DNS = f"""
SELECT {_EVENT_KEYS},
 concat('10.0.0.', CAST(user_id % 32 + 1 AS VARCHAR(9))) AS src_ip, '10.0.255.53' AS dst_ip,
 CASE WHEN user_id % 10 = 0 THEN concat(upper(substr(md5(CAST(event_id AS VARCHAR(20))), 1, 12)),
        substr(md5(CAST(event_id AS VARCHAR(20))), 13, 16), '.tunnel-example.net')
      ELSE concat('h', CAST(user_id % 12 AS VARCHAR(9)), '.svc', CAST(event_id % 5 AS VARCHAR(9)),
        '.example.com.') END AS qname,
 CASE WHEN user_id % 10 = 0 THEN 'TXT' WHEN event_id % 7 = 0 THEN 'AAAA' ELSE 'A' END AS qtype,
 CASE event_type WHEN 'error' THEN '3' WHEN 'view' THEN NULL ELSE '0' END AS response_code,
 CAST(20 + event_id % 60 AS INT) AS query_size_bytes
FROM {{events}}
"""

HTTP = f"""
SELECT {_EVENT_KEYS},
 concat('10.0.0.', CAST(user_id % 32 + 1 AS VARCHAR(9))) AS src_ip, '93.184.216.34' AS dst_ip,
 CASE WHEN event_type = 'view' THEN '' WHEN event_type = 'purchase' THEN 'post' ELSE 'GET' END
   AS method, 'shop.example.com' AS host,
 CASE WHEN event_type = 'view' THEN ''
      WHEN user_id % 4 = 1 THEN concat('/login?try=', CAST(event_id AS VARCHAR(20)))
      ELSE concat('/p/', CAST(event_id % 30 AS VARCHAR(9)), '?u=', CAST(user_id AS VARCHAR(9))) END
   AS uri,
 CAST(CASE WHEN event_type = 'view' THEN CASE WHEN user_id % 4 = 1 THEN 401 ELSE 200 END
      WHEN event_type = 'error' THEN 500 ELSE NULL END AS INT) AS status_code,
 CASE WHEN event_type = 'view' THEN NULL WHEN user_id % 25 = 3 THEN 'sqlmap/1.7'
      ELSE concat('Mozilla/5.0 (', CAST(user_id % 6 AS VARCHAR(9)), ')') END AS user_agent
FROM {{events}}
"""

FTP = f"""
SELECT {_EVENT_KEYS},
 concat('10.0.1.', CAST(user_id % 8 + 1 AS VARCHAR(9))) AS src_ip, '10.0.255.21' AS dst_ip,
 CASE WHEN event_type IN ('view', 'error') THEN '' WHEN event_type = 'click' THEN 'USER'
      ELSE 'PASS' END AS command,
 CAST(CASE WHEN event_type = 'error' THEN 530
      WHEN event_type = 'view' THEN CASE WHEN user_id % 8 < 3 THEN 530 ELSE 230 END
      ELSE NULL END AS INT) AS response_code
FROM {{events}}
"""

SMTP = f"""
SELECT {_EVENT_KEYS},
 concat('10.0.2.', CAST(user_id % 8 + 1 AS VARCHAR(9))) AS src_ip, '10.0.255.25' AS dst_ip,
 CASE event_type WHEN 'click' THEN 'EHLO' WHEN 'purchase' THEN 'MAIL' WHEN 'signup' THEN 'RCPT'
      ELSE '' END AS command,
 CAST(CASE WHEN event_type = 'error' AND user_id % 8 = 2 THEN 535
      WHEN event_type IN ('error', 'view') THEN 250 ELSE NULL END AS INT) AS response_code,
 CASE WHEN event_type = 'signup' THEN concat('<u', CAST(CASE WHEN user_id % 8 = 5 THEN event_id
      ELSE event_id % 7 END AS VARCHAR(20)), '@example.org>') ELSE NULL END AS rcpt
FROM {{events}}
"""

CAPTURES = """
SELECT o_orderkey AS capture_id,
 md5(CAST(o_orderkey - CASE WHEN o_orderkey % 5 < 2 THEN o_orderkey % 5 ELSE 0 END AS VARCHAR(20)))
   AS sha256,
 CAST(floor(o_totalprice) AS BIGINT) AS file_size,
 CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'failed' END AS status,
 o_orderdate AS uploaded_at, o_orderdate + INTERVAL '7' DAY AS expires_at,
 CASE WHEN o_custkey % 11 = 0 THEN o_orderdate + INTERVAL '1' DAY ELSE NULL END AS deleted_at
FROM {orders}
"""

ALERTS = """
SELECT event_id AS alert_id, user_id AS session_id,
 concat('NET-0', CASE WHEN (user_id * 7 + event_id % 3) % 11 + 1 < 10 THEN '0' ELSE '' END,
        CAST((user_id * 7 + event_id % 3) % 11 + 1 AS VARCHAR(9))) AS rule_id,
 CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium'
      WHEN 'click' THEN 'low' ELSE 'informational' END AS severity,
 CASE WHEN event_id % 4 = 0 THEN 'resolved' ELSE 'active' END AS status,
 CAST(floor(least(value, 100.0)) AS INT) AS risk_score, ts AS triggered_at
FROM {events}
"""

# One evaluation of one rule per event: it triggered when the event is not a page view.
EVALUATIONS = """
SELECT user_id AS session_id, event_id AS flush_id,
 concat('NET-0', CASE WHEN event_id % 11 + 1 < 10 THEN '0' ELSE '' END,
        CAST(event_id % 11 + 1 AS VARCHAR(9))) AS rule_id,
 event_type <> 'view' AS triggered,
 CASE WHEN event_type = 'view' THEN 0 ELSE CAST(floor(least(value, 100.0)) AS INT) END AS risk_score,
 ts AS evaluated_at
FROM {events}
"""

# Scores of findings in arrival order; ten consecutive events make one flush.
SCORES = """
SELECT user_id % 8 AS session_id, concat('NET-00', CAST(event_id % 9 + 1 AS VARCHAR(9))) AS rule_id,
 CAST((event_id - event_id % 10) / 10 AS BIGINT) AS flush_id, event_id AS seq,
 CAST(floor(least(value, 100.0)) AS DOUBLE) / 100 AS raw_score
FROM {events}
"""

GROUND_TRUTH = """
SELECT c_custkey AS capture_id, c_custkey % 3 = 0 AS attack_present,
 CASE WHEN c_custkey % 3 <> 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 'port_scan'
      WHEN c_custkey % 4 = 1 THEN 'dns_tunneling' WHEN c_custkey % 4 = 2 THEN 'botnet_c2'
      ELSE 'ftp_brute_force' END AS attack_type
FROM {customer}
"""

# Raw live events, some of them broken on purpose.
RAW_EVENTS = f"""
SELECT event_id AS seq, CASE WHEN event_id % 61 = 0 THEN 'yesterday' WHEN event_id % 67 = 0 THEN NULL
      ELSE concat('2024-01-0', CAST(event_id % 9 + 1 AS VARCHAR(9)), 'T00:00:00Z') END AS ts,
 CASE WHEN event_id % 71 = 0 THEN 'many' WHEN event_id % 73 = 0 THEN NULL
      ELSE CAST(event_id % 1000 AS VARCHAR(9)) END AS bytes,
 CASE WHEN event_id % 79 = 0 THEN 'nope' WHEN event_id % 7 = 0 THEN NULL
      ELSE concat('12345678-1234-1234-1234-12345678900', CAST(event_id % 10 AS VARCHAR(9))) END AS session_id,
 CASE WHEN event_id % 4 = 0 THEN 'GET' WHEN event_id % 4 = 1 THEN '' ELSE NULL END AS http_method,
 CASE WHEN event_id % 3 = 0 THEN concat('/p/', CAST(event_id AS VARCHAR(20))) ELSE '' END AS http_uri,
 CASE WHEN event_id % 5 = 0 THEN 'kiosk.test' ELSE NULL END AS http_host,
 CASE WHEN event_id % 6 = 0 THEN concat('n', CAST(user_id AS VARCHAR(9)), '.kiosk.test') ELSE NULL END AS dns_qname,
 CASE WHEN event_id % 12 = 0 THEN 'TXT' ELSE '' END AS dns_qtype,
 CASE WHEN event_id % 29 = 0 THEN '10.0.0.256' WHEN event_id % 31 = 0 THEN ''
      WHEN event_id % 5 = 0 THEN concat('fd00::', CAST(user_id % 9 + 1 AS VARCHAR(9)))
      ELSE concat('10.0.0.', CAST(user_id % 32 + 1 AS VARCHAR(9))) END AS src_ip,
 CASE WHEN event_id % 37 = 0 THEN 'server' ELSE '10.0.255.1' END AS dst_ip,
 CAST(CASE WHEN event_id % 41 = 0 THEN 65536 ELSE 1024 + user_id % 500 END AS VARCHAR(9)) AS src_port,
 CAST(CASE WHEN event_id % 43 = 0 THEN -1 ELSE 80 END AS VARCHAR(9)) AS dst_port,
 CASE WHEN event_id % 47 = 0 THEN '  ' WHEN event_id % 3 = 0 THEN ' tcp' ELSE 'UDP' END AS protocol,
 CAST(CASE WHEN event_id % 53 = 0 THEN 0 ELSE 1 + event_id % 3 END AS VARCHAR(9)) AS packets,
 CAST(CASE WHEN event_id % 59 = 0 THEN 99 ELSE 200 END AS VARCHAR(9)) AS http_status
FROM {{events}}
"""

# Answers of an assessment model, some fenced, some broken.
RESPONSES = """
SELECT event_id AS response_id, user_id AS capture_id,
 concat(CASE WHEN event_id % 3 = 0 THEN concat('```json', chr(10)) ELSE '' END,
  CASE WHEN event_id % 17 = 0 THEN 'no json here'
       WHEN event_id % 13 = 0 THEN concat('{{"note": "', event_type, '"}}')
       ELSE concat('{{"executive_summary": "', event_type, ' seen", "finding_rationales": [',
         '{{"finding_id": "f', CAST(event_id AS VARCHAR(20)), '", "explanation": "x", ',
         '"false_positive_likelihood": ', CAST(event_id % 5 - 1 AS VARCHAR(9)), '}}, ',
         '{{"explanation": "no id"}}], "remediation_steps": [{{"action": "block", "priority": ',
         CAST(event_id % 4 + 1 AS VARCHAR(9)), '}}, {{"action": "review"}}]}}') END,
  CASE WHEN event_id % 3 = 0 THEN concat(chr(10), '```') ELSE '' END) AS response
FROM {events}
"""

SOURCES = ("lineitem", "orders", "events", "customer")
TABLES = {
    "packets": PACKETS,
    "dns": DNS,
    "http": HTTP,
    "ftp": FTP,
    "smtp": SMTP,
    "captures": CAPTURES,
    "alerts": ALERTS,
    "evaluations": EVALUATIONS,
    "scores": SCORES,
    "ground_truth": GROUND_TRUTH,
    "raw_events": RAW_EVENTS,
    "responses": RESPONSES,
}


def cte(*names: str) -> str:
    """``WITH`` list giving the named derived tables to a DuckDB query."""
    plain = {source: source for source in SOURCES}
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n].format(**plain)})" for n in names)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame with a ``ts`` column where it has ``ts_ms``."""
    text = TABLES[name]
    used = {s: spark.read.parquet(f"{sf_dir}/{s}.parquet") for s in SOURCES if f"{{{s}}}" in text}
    table = spark.sql(text, **used)
    if "ts_ms" in table.columns:
        table = table.withColumn("ts", F.timestamp_millis(F.col("ts_ms")))
    for column in ("uploaded_at", "expires_at", "deleted_at", "triggered_at", "evaluated_at"):
        if column in table.columns:
            table = table.withColumn(column, F.col(column).cast("timestamp"))
    if name == "smtp":
        table = table.withColumn("rcpt_to", F.when(F.col("rcpt").isNotNull(), F.array("rcpt")))
    return table


def packet_texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Rows of a derived table as packets in a dissector's JSON: ``capture_id`` and ``value``.

    Values are scalars, in every third packet lists with a second entry. Every eleventh packet has a
    port, status or size that no number type holds, every thirteenth a source that is no address.
    """
    rows = load(spark, sf_dir, name)
    number = F.col("packet_number" if name == "packets" else "seq")
    junk = lambda c: F.when(number % 11 == 0, F.lit("9" * 30)).otherwise(F.col(c).cast("string"))
    stamp = F.format_string("%d.%03d000", F.floor(F.col("ts_ms") / 1000), F.col("ts_ms") % 1000)
    ends = {
        "ip.src": F.when(number % 13 == 0, F.lit("no address")).otherwise(F.col("src_ip")),
        "ip.dst": F.col("dst_ip"),
    }
    ports = {"srcport": junk("src_port"), "dstport": F.col("dst_port").cast("string")} if name == "packets" else {}
    fields = {
        "packets": {},
        "dns": {
            "dns.qry.name": "qname", "dns.qry.type": "qtype", "dns.flags.rcode": "response_code",
            "dns.qry.name.len": "query_size_bytes",
        },
        "http": {
            "http.request.method": "method", "http.host": "host", "http.request.uri": "uri",
            "http.response.code": "status_code", "http.user_agent": "user_agent",
        },
        "ftp": {"ftp.request.command": "command", "ftp.response.code": "response_code"},
        "smtp": {
            "smtp.command": "command", "smtp.response.code": "response_code",
        },
    }[name]
    odd = ("query_size_bytes", "status_code")

    def text(as_list: bool) -> Column:
        def value(column: Column) -> Column:
            return F.when(column.isNotNull(), F.array(column, F.lit("second"))) if as_list else column

        def layer(values: dict[str, Column]) -> Column:
            return F.struct(*[value(v).alias(n) for n, v in values.items()])

        own = {n: junk(c) if c in odd else F.col(c).cast("string") for n, c in fields.items() if c in rows.columns}
        layers = [
            F.struct(
                number.cast("string").alias("frame.number"), stamp.alias("frame.time_epoch"),
                (F.col("length") if name == "packets" else F.lit(80)).cast("string").alias("frame.len"),
            ).alias("frame"),
            F.struct(*[v.alias(n) for n, v in ends.items()]).alias("ip"),
        ]
        if name == "packets":
            for kind in ("tcp", "udp"):
                values = {f"{kind}.{n}": v for n, v in ports.items()}
                if kind == "tcp":
                    values["tcp.flags"] = F.col("tcp_flags")
                layers.append(F.when(F.col("protocol") == kind.upper(), layer(values)).alias(kind))
            icmp = F.struct(F.lit("8").alias("icmp.type"))
            layers.append(F.when(F.col("protocol") == "ICMP", icmp).alias("icmp"))
        else:
            layers.append(layer(own).alias(name))
        return F.to_json(F.struct(F.struct(F.struct(*layers).alias("layers")).alias("_source")))

    return rows.select("capture_id", F.when(number % 3 == 0, text(True)).otherwise(text(False)).alias("value"))
