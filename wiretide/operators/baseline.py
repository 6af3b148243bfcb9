"""Traffic baseline of a group, protocol shares and deviating flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretide.operators.flows import _keys

# Fixed value: flows compared with the baseline.
TOP_DEVIATIONS = 20


def capture_stats(packets: DataFrame, by: str | Sequence[str] = "capture_id") -> DataFrame:
    """Packets, bytes, first and last stamp and length of each group."""
    return packets.groupBy(*_keys(by)).agg(
        F.count(F.lit(1)).alias("packet_count"),
        F.sum(F.coalesce(F.col("length"), F.lit(0))).cast("bigint").alias("total_bytes"),
        F.min("ts").alias("window_start"),
        F.max("ts").alias("window_end"),
        F.round(
            F.coalesce(
                (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6, F.lit(0.0)
            ),
            4,
        ).alias("capture_duration_seconds"),
    )


def protocol_shares(directed: DataFrame, by: str | Sequence[str] = "capture_id") -> DataFrame:
    """Packets per protocol and their share of the group's packets in percent."""
    keys = _keys(by)
    counts = directed.groupBy(*keys, "protocol").agg(F.sum("packets").alias("packets"))
    total = F.sum("packets").over(Window.partitionBy(*keys))
    return counts.withColumn("percentage", F.round(F.col("packets") / total * 100, 2))


def _baseline(directed: DataFrame, by: str | Sequence[str], seconds: Column) -> DataFrame:
    keys = _keys(by)
    group = [F.col(k) for k in keys]
    dims = [F.col(c) for c in ("src_ip", "dst_ip", "protocol")]
    ends = directed.groupingSets([[*group, d] for d in dims], *group, *dims).agg(
        F.grouping("src_ip").alias("not_src"),
        F.grouping("dst_ip").alias("not_dst"),
        F.grouping("protocol").alias("not_protocol"),
        F.sum("packets").alias("packets"),
        F.sum("bytes").alias("bytes"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
    )
    protocol_row = F.col("not_protocol") == 0
    totals = ends.groupBy(*keys).agg(
        F.sum(F.when(protocol_row, F.col("bytes"))).alias("total_bytes"),
        F.sum(F.when(protocol_row, F.col("packets"))).alias("total_packets"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.count_if(F.col("not_src") == 0).alias("unique_src_ips"),
        F.count_if(F.col("not_dst") == 0).alias("unique_dst_ips"),
        # one entry per protocol, so the list is as short as the protocol domain
        F.map_from_entries(
            F.collect_list(F.when(protocol_row, F.struct("protocol", "packets")))
        ).alias("protocol_packets"),
    )
    return totals.withColumn("seconds", seconds).select(
        *keys,
        F.round(F.col("total_bytes") / F.col("seconds"), 2).alias("expected_bytes_per_second"),
        F.round(F.col("total_packets") / F.col("seconds"), 2).alias("expected_packets_per_second"),
        "total_bytes",
        "total_packets",
        F.round("seconds", 4).alias("duration_seconds"),
        "unique_src_ips",
        "unique_dst_ips",
        F.transform_values(
            "protocol_packets",
            lambda _, n: F.round(n / F.greatest(F.col("total_packets"), F.lit(1)) * 100, 2),
        ).alias("protocol_percentages"),
        F.timestamp_micros("first_us").alias("window_start"),
        F.timestamp_micros("last_us").alias("window_end"),
    )


def _span() -> Column:
    return F.coalesce((F.col("last_us") - F.col("first_us")) / 1e6, F.lit(0.0))


def traffic_baseline(directed: DataFrame, by: str | Sequence[str] = "capture_id") -> DataFrame:
    """Batch baseline from directed traffic; no measurable length counts as one second."""
    return _baseline(directed, by, F.when(_span() > 0, _span()).otherwise(F.lit(1.0)))


def event_traffic_baseline(
    flow_table: DataFrame, by: str | Sequence[str] = "session_id"
) -> DataFrame:
    """Stream baseline from flows; the length is at least a millisecond."""
    directed = flow_table.select(
        *_keys(by),
        "src_ip",
        "dst_ip",
        "protocol",
        F.col("packets_total").alias("packets"),
        F.col("bytes_total").alias("bytes"),
        F.unix_micros("start_time").alias("first_us"),
        F.unix_micros("end_time").alias("last_us"),
    )
    return _baseline(directed, by, F.greatest(_span(), F.lit(0.001)))


def traffic_deviations(
    flow_table: DataFrame,
    baseline: DataFrame,
    by: str | Sequence[str] = "capture_id",
    top: int = TOP_DEVIATIONS,
) -> DataFrame:
    """Largest flows of each group compared with the group's baseline."""
    keys = _keys(by)
    order = Window.partitionBy(*keys).orderBy(
        F.desc("bytes_total"), "start_time", "first_seq", "src_ip", "dst_ip", "src_port", "dst_port"
    )
    largest = flow_table.withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= top
    )
    seconds = F.greatest(F.col("duration_ms") / 1000.0, F.lit(0.001))
    expected = F.greatest(F.col("expected_bytes_per_second"), F.lit(0.001))
    rate = F.col("bytes_total") / seconds
    return largest.join(
        baseline.select(*keys, "expected_bytes_per_second"), keys
    ).select(
        *keys,
        "place",
        "src_ip",
        "dst_ip",
        (F.round((rate / expected - 1) * 100, 2) + F.lit(0.0)).alias("bytes_exceeded_pct"),
        F.round(F.col("packets_total") / seconds, 2).alias("packets_per_second"),
        F.round(rate, 2).alias("bytes_per_second"),
        (F.col("src_bytes") > F.col("dst_bytes")).alias("is_upload_dominated"),
    )
