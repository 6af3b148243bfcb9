"""Per-source behaviour: connection profiles and port-scan evidence.

Distinct counts are taken by grouping on the counted value first, so a source that sends a third
of all packets is counted by many tasks and only totals meet at the end. There is no join: totals
from traffic, from ports and from flows are stacked and summed once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretide.operators.flows import FAILED_FLOW_MAX_BYTES, _keys

# A pair is suspect from this many ports; a source from this share of its pairs.
SCAN_PAIR_PORTS = 20
SCAN_SUSPECT_SHARE = 0.7


def scan_pairs(directed: DataFrame, by: str | Sequence[str] = "capture_id") -> DataFrame:
    """Distinct destination ports per (source, destination) that saw any port."""
    keys = _keys(by)
    return (
        directed.where(F.col("dst_port").isNotNull())
        .groupBy(*keys, "src_ip", "dst_ip", "dst_port")
        .agg(F.sum("packets").alias("packets"))
        .groupBy(*keys, "src_ip", "dst_ip")
        .agg(F.count(F.lit(1)).alias("ports"), F.sum("packets").alias("packets"))
        .withColumn("suspect", F.col("ports") >= SCAN_PAIR_PORTS)
    )


def _per_source(directed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per destination and one per port of every source, told apart by ``kind``."""
    ports = directed.groupBy(*keys, "src_ip", "dst_ip", "dst_port").agg(
        F.sum("packets").alias("packets"),
        F.sum("bytes").alias("bytes"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
    )
    source = [F.col(k) for k in keys] + [F.col("src_ip")]
    grouped = (
        ports.groupingSets(
            [[*source, F.col("dst_ip")], [*source, F.col("dst_port")]],
            *source, F.col("dst_ip"), F.col("dst_port"),
        )
        .agg(
            F.grouping("dst_ip").alias("by_port"),
            F.count("dst_port").alias("ports"),
            F.sum("packets").alias("packets"),
            F.sum("bytes").alias("bytes"),
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
        )
    )
    of_host = F.col("by_port") == 0
    hosts_and_ports = grouped.select(
        *keys,
        "src_ip",
        F.when(of_host, 1).alias("dst_ips"),
        F.when(~of_host & F.col("dst_port").isNotNull(), 1).alias("dst_ports"),
        F.when(of_host, F.col("ports")).alias("pair_ports"),
        F.when(of_host, F.col("packets")).alias("packets"),
        F.when(of_host, F.col("bytes")).alias("bytes"),
        F.when(of_host, F.col("first_us")).alias("first_us"),
        F.when(of_host, F.col("last_us")).alias("last_us"),
    )
    protocols = directed.select(*keys, "src_ip", "protocol").distinct()
    return hosts_and_ports.unionByName(protocols, allowMissingColumns=True)


def _flow_totals(flow_table: DataFrame, keys: list[str], failed: Column) -> DataFrame:
    return flow_table.groupBy(*keys, "src_ip").agg(
        F.count(F.lit(1)).alias("connections"), F.count_if(failed).alias("failures")
    )


def _profile(stacked: DataFrame, keys: list[str]) -> DataFrame:
    totals = stacked.groupBy(*keys, "src_ip").agg(
        F.count("dst_ips").alias("unique_dst_ips"),
        F.count("dst_ports").alias("unique_dst_ports"),
        F.coalesce(F.sum("connections"), F.lit(0)).alias("total_connections"),
        F.coalesce(F.sum("failures"), F.lit(0)).alias("failed_connections"),
        F.sum("bytes").alias("total_bytes_sent"),
        F.sum("packets").alias("total_packets_sent"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.sort_array(F.collect_set("protocol")).alias("distinct_protocols"),
        F.count_if(F.col("pair_ports") > 0).alias("pairs"),
        F.count_if(F.col("pair_ports") >= SCAN_PAIR_PORTS).alias("suspect_pairs"),
        F.coalesce(F.max("pair_ports"), F.lit(0)).alias("unique_dst_ports_per_host"),
    )
    flows_, failed = F.col("total_connections"), F.col("failed_connections")
    minutes = F.greatest(
        F.coalesce((F.col("last_us") - F.col("first_us")) / 1e6, F.lit(0.0)) / 60.0,
        F.lit(1.0) / 60.0,
    )
    return totals.select(
        *keys,
        "src_ip",
        "unique_dst_ips",
        "unique_dst_ports",
        "total_connections",
        "failed_connections",
        F.greatest(flows_ - failed, F.lit(0)).alias("success_connections"),
        "total_bytes_sent",
        "total_packets_sent",
        F.timestamp_micros("first_us").alias("first_seen"),
        F.timestamp_micros("last_us").alias("last_seen"),
        "distinct_protocols",
        F.when(flows_ > 0, F.round(failed / flows_, 4))
        .otherwise(F.lit(0.0))
        .alias("failed_connection_ratio"),
        F.when(
            F.col("pairs") > 0, F.col("suspect_pairs") / F.col("pairs") >= SCAN_SUSPECT_SHARE
        )
        .otherwise(F.lit(False))
        .alias("port_scan_suspect"),
        "unique_dst_ports_per_host",
        F.round(flows_ / minutes, 4).alias("connections_per_minute"),
    )


def connection_profiles(
    directed: DataFrame,
    flow_table: DataFrame,
    by: str | Sequence[str] = "capture_id",
    *,
    count_failures: bool = True,
    initiator_only: bool = False,
) -> DataFrame:
    """Batch profiles from directed traffic and flows.

    ``count_failures=False`` reports zero failures, as the batch analyser this follows does.
    ``initiator_only=True`` counts hosts and ports only for the end that opened each flow, which
    keeps busy servers from looking like scanners.
    """
    keys = _keys(by)
    if initiator_only:
        directed = flow_table.select(
            *keys,
            "src_ip",
            "dst_ip",
            F.when(F.col("protocol") != "ICMP", F.col("dst_port")).alias("dst_port"),
            "protocol",
            F.col("packets_total").alias("packets"),
            F.col("bytes_total").alias("bytes"),
            F.unix_micros("start_time").alias("first_us"),
            F.unix_micros("end_time").alias("last_us"),
        )
    failed = F.col("is_failed_flow") if count_failures else F.lit(False)
    stacked = _per_source(directed, keys).unionByName(
        _flow_totals(flow_table, keys, failed), allowMissingColumns=True
    )
    return _profile(stacked, keys)


def event_connection_profiles(
    flow_table: DataFrame, by: str | Sequence[str] = "session_id"
) -> DataFrame:
    """Stream profiles: taken from flows alone, spans use flow start times only."""
    keys = _keys(by)
    directed = flow_table.select(
        *keys,
        "src_ip",
        "dst_ip",
        "dst_port",
        "protocol",
        F.col("packets_total").alias("packets"),
        F.col("bytes_total").alias("bytes"),
        F.unix_micros("start_time").alias("first_us"),
        F.unix_micros("start_time").alias("last_us"),
    )
    failed = (F.col("rst_count") > 0) & (F.col("bytes_total") <= FAILED_FLOW_MAX_BYTES)
    stacked = _per_source(directed, keys).unionByName(
        _flow_totals(flow_table, keys, failed), allowMissingColumns=True
    )
    return _profile(stacked, keys)
