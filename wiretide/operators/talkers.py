"""Dashboard queries over stored flows: talkers, protocol shares, timelines, heat map.

Stored flows have the columns of ``flows.stored_flows``. Top-k lists rank inside a window with a
limit on the rank, which Spark turns into a per-task top-k before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretide.functions.timing import parse_window
from wiretide.operators.flows import _keys

TALKER_SORTS = ("bytes", "packets", "ip", "direction")


def _volume() -> list[Column]:
    return [
        F.sum("packets_count").alias("packets"),
        (F.sum("bytes_sent") + F.sum("bytes_recv")).alias("bytes"),
    ]


def top_talkers(
    stored: DataFrame, by: str | Sequence[str] = "capture_id", limit: int = 10
) -> DataFrame:
    """Top sources, destinations, destination ports and protocols of each group by bytes.

    One pass over the flows for all four lists. Ties go by key text.
    """
    keys = _keys(by)
    group = [F.col(k) for k in keys]
    dims = ("src_ip", "dst_ip", "dst_port", "protocol")
    columns = [F.col(d) for d in dims]
    grouped = stored.groupingSets([[*group, c] for c in columns], *group, *columns).agg(
        F.grouping_id().alias("gid"), *_volume()
    )
    dimension, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for place, name in enumerate(dims):
        # bit of every dimension but this one is set
        gid = 0b1111 & ~(1 << (len(dims) - 1 - place))
        dimension = F.when(F.col("gid") == gid, F.lit(name)).otherwise(dimension)
        key = F.when(F.col("gid") == gid, F.col(name).cast("string")).otherwise(key)
    ranked = (
        grouped.select(*keys, dimension.alias("dimension"), key.alias("key"), "packets", "bytes")
        .where(F.col("key").isNotNull())
        .withColumn(
            "place",
            F.row_number().over(
                Window.partitionBy(*keys, "dimension").orderBy(F.desc("bytes"), "key")
            ),
        )
    )
    return ranked.where(F.col("place") <= limit)


def protocol_distribution(
    stored: DataFrame, by: str | Sequence[str] = "capture_id"
) -> DataFrame:
    """Packets, bytes and share of bytes per protocol, in no order."""
    keys = _keys(by)
    counts = stored.groupBy(*keys, "protocol").agg(*_volume())
    total = F.sum("bytes").over(Window.partitionBy(*keys))
    share = F.round(
        F.col("bytes") / F.when(total == 0, F.lit(1)).otherwise(total) * 100, 2
    )
    return counts.withColumn("percentage", share)


def traffic_timeline(
    stored: DataFrame, by: str | Sequence[str] = "capture_id", bucket_count: int = 60
) -> DataFrame:
    """Packets, bytes and flows per equal time slice from the first flow start.

    Slices are whole seconds, at least one. A group without any length has no slices.
    """
    keys = _keys(by)
    start_us = F.unix_micros("start_time")
    bounds = (
        stored.groupBy(*keys)
        .agg(
            F.min(start_us).alias("first_us"),
            F.max(F.unix_micros("end_time")).alias("last_us"),
        )
        .where(F.col("last_us") > F.col("first_us"))
        .withColumn(
            "bucket_seconds",
            F.greatest(
                F.lit(1),
                F.floor((F.col("last_us") - F.col("first_us")) / 1e6 / bucket_count),
            ),
        )
    )
    offset = F.floor((start_us - F.col("first_us")) / (F.col("bucket_seconds") * 1_000_000))
    return (
        stored.where(F.col("start_time").isNotNull())
        .join(bounds, keys)
        .groupBy(*keys, "first_us", "bucket_seconds", offset.alias("bucket"))
        .agg(*_volume(), F.count(F.lit(1)).alias("flows"))
        .select(
            *keys,
            "bucket",
            F.timestamp_micros(
                F.col("first_us") + F.col("bucket") * F.col("bucket_seconds") * 1_000_000
            ).alias("bucket_start"),
            "bucket_seconds",
            "packets",
            "bytes",
            "flows",
        )
    )


def recent_captures(captures: DataFrame, now: datetime, window: str) -> DataFrame:
    """Keys of captures uploaded within the window before ``now`` and not deleted."""
    since = F.lit(now - parse_window(window)).cast("timestamp")
    return captures.where(
        (F.col("uploaded_at") >= since) & F.col("deleted_at").isNull()
    ).select("capture_id")


def live_talkers(
    stored: DataFrame,
    captures: DataFrame,
    now: datetime,
    window: str = "5m",
    limit: int = 10,
    sort_by: str = "bytes",
    ascending: bool = False,
) -> DataFrame:
    """Busiest addresses over recent captures.

    Top sources and top destinations are ranked apart, merged per address keeping the side with
    more bytes (the source side on a tie), and cut again.
    """
    if sort_by not in TALKER_SORTS:
        raise ValueError(f"sort_by must be one of {TALKER_SORTS}, not {sort_by!r}")
    recent = stored.join(recent_captures(captures, now, window), "capture_id", "left_semi")
    src, dst = F.col("src_ip"), F.col("dst_ip")
    sides = (
        recent.groupingSets([[src], [dst]], src, dst)
        .agg(F.grouping("src_ip").alias("is_dst"), *_volume())
        .select(F.coalesce("src_ip", "dst_ip").alias("ip"), "is_dst", "packets", "bytes")
    )
    per_side = Window.partitionBy("is_dst").orderBy(F.desc("bytes"), "ip")
    top_sides = sides.withColumn("place", F.row_number().over(per_side)).where(
        F.col("place") <= limit
    )
    larger = Window.partitionBy("ip").orderBy(F.desc("bytes"), "is_dst")
    merged = (
        top_sides.withColumn("side_place", F.row_number().over(larger))
        .where(F.col("side_place") == 1)
        .select(
            "ip",
            F.when(F.col("is_dst") == 1, "dst").otherwise("src").alias("direction"),
            "bytes",
            "packets",
        )
        .orderBy(F.desc("bytes"), "ip")
        .limit(limit)
    )
    return merged.orderBy(F.col(sort_by).asc() if ascending else F.col(sort_by).desc(), "ip")


def traffic_heatmap(stored: DataFrame, by: str | Sequence[str] = "capture_id") -> DataFrame:
    """Packets and bytes per source address and hour of day."""
    return stored.groupBy(
        *_keys(by), F.col("src_ip").alias("ip"), F.hour("start_time").alias("hour")
    ).agg(*_volume())


def global_top_ips(stored: DataFrame, limit: int = 10) -> DataFrame:
    """Busiest addresses over all captures, counting both ends of every flow once per address."""
    ends = stored.select(
        "capture_id",
        F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))).alias("ip"),
        "packets_count",
        "bytes_sent",
        "bytes_recv",
    )
    return (
        ends.groupBy("ip", "capture_id")
        .agg(*_volume())
        .groupBy("ip")
        .agg(
            F.sum("bytes").alias("total_bytes"),
            F.sum("packets").alias("total_packets"),
            F.count(F.lit(1)).alias("capture_count"),
        )
        .orderBy(F.desc("total_bytes"), "ip")
        .limit(limit)
    )


def flow_samples(
    stored: DataFrame, by: str | Sequence[str] = "capture_id", limit: int = 100
) -> DataFrame:
    """A fixed-size sample of each group's flows, spread evenly by a hash of the flow."""
    keys = _keys(by)
    dice = F.xxhash64("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "start_time")
    order = Window.partitionBy(*keys).orderBy(dice, "src_ip", "dst_ip", "src_port", "dst_port")
    return (
        stored.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= limit)
        .drop("place")
    )
