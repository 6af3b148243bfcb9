"""DNS behaviour per name, per name and source, and per registered domain.

Records collapse to (name, type, source) first; lists that can grow without bound stay rows
(``dns_rates_by_ip``) instead of arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretide.functions.names import (
    looks_base64,
    registered_domain,
    subdomain,
    subdomain_entropy,
)
from wiretide.operators.flows import _keys

# Fixed value: response code of success.
NOERROR = "0"
LISTED_SOURCES = 10


def dns_cells(records: DataFrame, by: str | Sequence[str] = "capture_id") -> DataFrame:
    """Records counted per (name, type, source); every other DNS table starts here."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    return records.groupBy(*_keys(by), "qname", "qtype", "src_ip").agg(
        F.count(F.lit(1)).alias("queries"),
        F.count("response_code").alias("coded"),
        F.count_if(F.col("response_code") == NOERROR).alias("succeeded"),
        F.count("query_size_bytes").alias("sized"),
        F.coalesce(F.sum("query_size_bytes"), F.lit(0)).cast("bigint").alias("size_sum"),
        F.min(ts).alias("first_us"),
        F.max(ts).alias("last_us"),
    )


def dns_minutes(cells: DataFrame, by: str | Sequence[str] = "capture_id") -> DataFrame:
    """Length of each group's DNS traffic in minutes, at least one second."""
    span = (F.max("last_us") - F.min("first_us")) / 1e6
    return cells.groupBy(*_keys(by)).agg(
        F.greatest(F.coalesce(span, F.lit(0.0)) / 60.0, F.lit(1.0) / 60.0).alias("minutes")
    )


def dns_rates_by_ip(cells: DataFrame, by: str | Sequence[str] = "capture_id") -> DataFrame:
    """Queries per minute of every (name, source)."""
    keys = _keys(by)
    return (
        cells.groupBy(*keys, "qname", "src_ip")
        .agg(F.sum("queries").alias("queries"))
        .join(dns_minutes(cells, by), keys)
        .withColumn("queries_per_minute", F.round(F.col("queries") / F.col("minutes"), 4))
        .drop("minutes")
    )


def _domain_counts(names: DataFrame, keys: list[str]) -> DataFrame:
    """Queries, distinct subdomains and base64-like share per domain.

    ``names`` has one row per name with its ``query_count``.
    """
    subdomains = (
        names.select(
            *keys,
            registered_domain(F.col("qname")).alias("domain"),
            subdomain(F.col("qname")).alias("subdomain"),
            "query_count",
        )
        .groupBy(*keys, "domain", "subdomain")
        .agg(F.sum("query_count").alias("queries"))
    )
    filled = F.col("subdomain") != ""
    return (
        subdomains.groupBy(*keys, "domain")
        .agg(
            F.sum("queries").alias("domain_queries"),
            F.count(F.lit(1)).alias("unique_subdomain_count"),
            F.count_if(filled).alias("filled"),
            F.count_if(filled & looks_base64(F.col("subdomain"))).alias("encoded"),
        )
        .select(
            *keys,
            "domain",
            "domain_queries",
            "unique_subdomain_count",
            F.when(F.col("filled") > 0, F.round(F.col("encoded") / F.col("filled"), 4))
            .otherwise(F.lit(0.0))
            .alias("base64_ratio"),
        )
    )


def dns_domain_stats(cells: DataFrame, by: str | Sequence[str] = "capture_id") -> DataFrame:
    """Query rate, distinct subdomains and base64-like share per registered domain.

    The empty subdomain counts as one subdomain but not towards the base64 share.
    """
    keys = _keys(by)
    names = cells.groupBy(*keys, "qname").agg(F.sum("queries").alias("query_count"))
    rate = F.round(F.col("domain_queries") / F.col("minutes"), 4)
    return (
        _domain_counts(names, keys)
        .join(dns_minutes(cells, by), keys)
        .withColumn("query_frequency_per_domain", rate)
        .drop("minutes")
    )


def dns_profiles(cells: DataFrame, by: str | Sequence[str] = "capture_id") -> DataFrame:
    """One profile per query name.

    ``listed_src_ips`` holds the first ten sources in text order, ``top_src_ip`` the busiest one
    (first in text order on ties); the complete per-source table is ``dns_rates_by_ip``.
    """
    keys = _keys(by)
    name = [*keys, "qname"]
    sums = ("queries", "coded", "succeeded", "sized", "size_sum")
    columns = [F.col(c) for c in name]
    # one shuffle for rows per (name, source) and per (name, type)
    grouped = cells.groupingSets(
        [[*columns, F.col("src_ip")], [*columns, F.col("qtype")]],
        *columns, F.col("src_ip"), F.col("qtype"),
    ).agg(F.grouping("src_ip").alias("of_type"), *[F.sum(c).alias(c) for c in sums])
    by_text = Window.partitionBy(*name).orderBy("src_ip")
    listed = (
        grouped.where(F.col("of_type") == 0)
        .select(*name, "src_ip")
        .withColumn("place", F.row_number().over(by_text))
        .where(F.col("place") <= LISTED_SOURCES)
        .select(*name, F.col("src_ip").alias("listed_ip"))
    )
    of_source = F.col("of_type") == 0
    stacked = grouped.unionByName(listed, allowMissingColumns=True)
    per_name = stacked.groupBy(*name).agg(
        *[F.sum(F.when(of_source, F.col(c))).alias(c) for c in sums],
        F.count_if(of_source).alias("unique_src_ips"),
        F.sort_array(F.collect_set("qtype")).alias("unique_qtypes"),
        F.sort_array(F.collect_set("listed_ip")).alias("listed_src_ips"),
        F.min(F.when(of_source, F.struct((-F.col("queries")).alias("order"), F.col("src_ip")))).alias("busiest"),
    ).withColumnRenamed("queries", "query_count")
    counts = cells.groupBy(*name).agg(F.sum("queries").alias("query_count"))
    # the entropy before the join: what follows it may be a single task, as its bytes are few
    return (
        per_name.withColumns(
            {
                "domain": registered_domain(F.col("qname")),
                "subdomain_entropy": subdomain_entropy(F.col("qname")),
            }
        )
        .join(_domain_counts(counts, keys), [*keys, "domain"])
        .join(dns_minutes(cells, by), keys)
        .select(
            *name,
            "domain",
            "query_count",
            "unique_qtypes",
            "subdomain_entropy",
            F.when(F.col("sized") > 0, F.round(F.col("size_sum") / F.col("sized"), 2))
            .otherwise(F.lit(0.0))
            .alias("avg_query_size_bytes"),
            F.when(F.col("coded") > 0, F.round(F.col("succeeded") / F.col("coded"), 4))
            .otherwise(F.lit(1.0))
            .alias("response_success_rate"),
            "unique_src_ips",
            "listed_src_ips",
            F.col("busiest.src_ip").alias("top_src_ip"),
            F.round(-F.col("busiest.order") / F.col("minutes"), 4).alias(
                "max_query_frequency_per_ip"
            ),
            F.round(F.col("domain_queries") / F.col("minutes"), 4).alias(
                "query_frequency_per_domain"
            ),
            "unique_subdomain_count",
            "base64_ratio",
        )
    )
