"""Work per row of the findings: spread over tasks, and the cheap paths give what the general ones give."""

import statistics
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wiretide.functions import hex_flag_bits
from wiretide.operators import dns, flows
from wiretide.plans.detect import run_rules
from wiretide.plans.features import Features, Tables
from wiretide.rules import BUILT_IN, RuleRegistry
from wiretide.schemas import PACKETS

from test_flows import packet


def _dns(spark, n):
    start = datetime(2024, 1, 1)
    rows = [
        ("c", i, start + timedelta(milliseconds=i), f"10.0.0.{i % 3}", f"Ab{i}cdefGhij{i * 7919}.tunnel.net", "TXT", "0", 40)
        for i in range(n)
    ]
    names = "capture_id string, seq long, ts timestamp, src_ip string, qname string, qtype string, response_code string"
    return spark.createDataFrame(rows, f"{names}, query_size_bytes int")


def test_rules_of_many_names_are_more_than_one_task(spark):
    packets = spark.createDataFrame([packet(n, "10.0.0.1", 1, "10.0.0.2", 2, 60, n, capture="c") for n in range(3)], PACKETS)
    tunnel = RuleRegistry([r for r in BUILT_IN if r.rule_id == "NET-002"])
    with Features(Tables(packets=packets, dns=_dns(spark, 400))) as features:
        found = run_rules(features, tunnel).findings.select("subject", F.spark_partition_id().alias("task")).collect()
    assert len({r.subject for r in found}) == len(found) == 400
    assert len({r.task for r in found}) > 1


def test_domains_are_counted_once_per_query_not_per_source_or_type(spark):
    rows = _dns(spark, 60)
    cells = dns.dns_cells(rows.unionByName(rows.withColumn("qtype", F.lit("A"))))
    assert {r.unique_subdomain_count for r in dns.dns_profiles(cells).collect()} == {60}
    per_minute = {r.query_frequency_per_domain for r in dns.dns_profiles(cells).collect()}
    assert per_minute == {120 / (1 / 60)}


def test_usual_and_odd_spellings_of_flags_agree(spark):
    texts = ["0x002", "0x2", "0xAbC", "0X012", " 0x012 ", "012", "0x", "0xg1", "x12", "0x" + "f" * 20, "", None]
    got = spark.createDataFrame([(t,) for t in texts], "v string").select(hex_flag_bits(F.col("v"))).collect()
    assert [r[0] for r in got] == [2, 2, 0xABC, 0x12, 0x12, 0x12, None, None, None, 16**15 - 1, None, None]


def test_variance_where_squares_change_from_longs_to_decimals(spark):
    stamps = [0, 0.000001, 3000.000001, 6000.000002, 9999.5, 9999.75]
    rows = [packet(n, "10.0.0.1", 1, "10.0.0.2", 2, 10, at) for n, at in enumerate(stamps)]
    packets = spark.createDataFrame(rows, PACKETS)
    micros = [round(at * 1e6) for at in stamps]
    gaps = [b - a for a, b in zip(micros, micros[1:])]
    state = flows.flow_state(flows.packet_rows(packets)).collect()
    assert [int(r.gap_squares) for r in state] == [sum(g * g for g in gaps)]
    found = flows.flows(packets).collect()[0].inter_packet_interval_variance_ms
    assert abs(found - statistics.variance(g / 1000 for g in gaps)) < 1e-3
