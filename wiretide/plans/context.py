"""One compact context record per capture: what a reader or a model needs to know about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretide.operators import applications, dns
from wiretide.plans.features import Features

# List lengths.
TOP_PROTOCOLS, TOP_TALKERS, TOP_DOMAINS, TOP_HOSTS = 5, 10, 10, 10


def _top_list(
    table: DataFrame, by: str, size: int, order: list[Column], fields: list[str], name: str
) -> DataFrame:
    """The first ``size`` rows per group as an ordered array."""
    ranked = table.withColumn(
        "place", F.row_number().over(Window.partitionBy(by).orderBy(*order))
    ).where(F.col("place") <= size)
    return ranked.groupBy(by).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("place", *fields))),
            lambda e: F.struct(*[e[f].alias(f) for f in fields]),
        ).alias(name)
    )


def context_summary(features: Features) -> DataFrame:
    """Capture totals, top protocols, talkers, DNS domains and HTTP hosts, nested, one row each."""
    by = features.by
    directed = features.directed
    protocols = directed.groupBy(by, "protocol").agg(F.sum("packets").alias("packets"))
    ends = directed.groupBy(by, "src_ip", "dst_ip").agg(F.sum("bytes").alias("bytes"))
    sides = ends.select(
        by,
        F.inline(
            F.array(
                F.struct(F.col("src_ip").alias("ip"), "bytes", F.lit("outbound").alias("side")),
                F.struct(F.col("dst_ip").alias("ip"), "bytes", F.lit("inbound").alias("side")),
            )
        ),
    )
    addresses = (
        sides.groupBy(by, "ip")
        .agg(
            F.coalesce(F.sum(F.when(F.col("side") == "outbound", F.col("bytes"))), F.lit(0)).alias(
                "sent"
            ),
            F.coalesce(F.sum(F.when(F.col("side") == "inbound", F.col("bytes"))), F.lit(0)).alias(
                "received"
            ),
        )
        .select(
            by,
            "ip",
            F.greatest("sent", "received").alias("bytes"),
            F.when(F.col("sent") >= F.col("received"), "outbound")
            .otherwise("inbound")
            .alias("direction"),
        )
    )
    parts = [
        addresses.groupBy(by).agg(F.count(F.lit(1)).alias("unique_ips")),
        _top_list(
            protocols, by, TOP_PROTOCOLS, [F.desc("packets"), F.col("protocol")],
            ["protocol", "packets"], "top_protocols",
        ),
        _top_list(
            addresses, by, TOP_TALKERS, [F.desc("bytes"), F.col("ip")],
            ["ip", "bytes", "direction"], "top_talkers",
        ),
    ]
    if features.dns_cells is not None:
        domains = dns.dns_domain_stats(features.dns_cells, by)
        parts += [
            domains.groupBy(by).agg(F.count(F.lit(1)).alias("total_domains_queried")),
            _top_list(
                domains.withColumnRenamed("domain_queries", "queries"), by, TOP_DOMAINS,
                [F.desc("queries"), F.col("domain")], ["domain", "queries"], "top_dns_domains",
            ),
        ]
    records = features._records("http")
    if records is not None:
        methods = applications.http_methods(records, by)
        hosts = (
            records.where(F.col("host") != "")
            .groupBy(by, "host")
            .agg(F.count(F.lit(1)).alias("requests"))
        )
        parts += [
            methods.groupBy(by).agg(
                F.sum("requests").alias("total_http_requests"),
                F.map_from_entries(F.collect_list(F.struct("method", "requests"))).alias(
                    "http_methods"
                ),
            ),
            _top_list(
                hosts, by, TOP_HOSTS, [F.desc("requests"), F.col("host")], ["host", "requests"],
                "top_http_hosts",
            ),
        ]
    summary = features.totals.select(
        by,
        F.col("group_packets").alias("total_packets"),
        F.col("group_bytes").alias("total_bytes"),
        F.col("capture_duration_seconds").alias("duration_seconds"),
        F.round(F.col("group_bytes") / F.col("group_packets"), 2).alias("avg_packet_size_bytes"),
        F.round(F.col("group_packets") / F.col("group_seconds"), 2).alias("packets_per_second"),
        F.col("group_rate").alias("bytes_per_second"),
    )
    for part in parts:
        summary = summary.join(part, by, "left")
    return summary
