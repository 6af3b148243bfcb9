"""HTTP, FTP and SMTP summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretide.functions.names import url_path
from wiretide.operators.flows import _keys

# List length and reply codes.
TOP_PATHS = 20
FTP_LOGGED_IN, FTP_NOT_LOGGED_IN = 230, 530
SMTP_AUTH_FAILED = 535
SMTP_GREETINGS = ("EHLO", "HELO")


def http_methods(records: DataFrame, by: str | Sequence[str] = "capture_id") -> DataFrame:
    """Requests per upper-cased method; rows without a method do not count."""
    return (
        records.where(F.col("method") != "")
        .groupBy(*_keys(by), F.upper("method").alias("method"))
        .agg(F.count(F.lit(1)).alias("requests"))
    )


def http_statuses(records: DataFrame, by: str | Sequence[str] = "capture_id") -> DataFrame:
    """Responses per status code."""
    return (
        records.where(F.col("status_code").isNotNull())
        .groupBy(*_keys(by), "status_code")
        .agg(F.count(F.lit(1)).alias("responses"))
    )


def http_top_paths(
    records: DataFrame, by: str | Sequence[str] = "capture_id", top: int = TOP_PATHS
) -> DataFrame:
    """Most requested paths, earlier first appearance first on ties."""
    keys = _keys(by)
    order = Window.partitionBy(*keys).orderBy(F.desc("requests"), "first_seq", "path")
    return (
        records.where(F.col("uri") != "")
        .groupBy(*keys, url_path(F.col("uri")).alias("path"))
        .agg(F.count(F.lit(1)).alias("requests"), F.min("seq").alias("first_seq"))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= top)
    )


def http_agents(records: DataFrame, by: str | Sequence[str] = "capture_id") -> DataFrame:
    """Distinct user agents; ``first_seq`` gives their order of appearance."""
    return (
        records.where(F.col("user_agent") != "")
        .groupBy(*_keys(by), "user_agent")
        .agg(F.count(F.lit(1)).alias("requests"), F.min("seq").alias("first_seq"))
    )


def ftp_summary(records: DataFrame, by: str | Sequence[str] = "capture_id") -> DataFrame:
    """Login results and rate per source."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    counts = records.groupBy(*_keys(by), "src_ip").agg(
        F.count_if(F.col("response_code") == FTP_NOT_LOGGED_IN).alias("failed_auth_count"),
        F.count_if(F.col("response_code") == FTP_LOGGED_IN).alias("success_auth_count"),
        F.count_if(F.col("command") != "").alias("total_commands"),
        F.coalesce((F.max(ts) - F.min(ts)) / 1e6, F.lit(0.0)).alias("seconds"),
    )
    attempts = F.col("failed_auth_count") + F.col("success_auth_count")
    return counts.select(
        *_keys(by),
        "src_ip",
        "failed_auth_count",
        "success_auth_count",
        "total_commands",
        F.when(
            (F.col("seconds") > 0) & (F.col("total_commands") > 0),
            F.round(attempts / F.col("seconds"), 4),
        ).alias("auth_rate_per_second"),
        F.when(attempts > 0, F.round(F.col("failed_auth_count") / attempts, 4))
        .otherwise(F.lit(0.0))
        .alias("failed_auth_ratio"),
    )


def smtp_summary(records: DataFrame, by: str | Sequence[str] = "capture_id") -> DataFrame:
    """Messages, distinct recipients, failed logins and connections per source.

    A message sent before any greeting stands for one connection of its own; a source with
    neither counts as one.
    """
    keys = [*_keys(by), "src_ip"]
    command = F.upper("command")
    greeted = command.isin(*SMTP_GREETINGS)
    sent = command == "MAIL"
    counts = records.groupBy(*keys).agg(
        F.count_if(sent).alias("messages"),
        F.count_if(greeted).alias("greetings"),
        F.min(F.when(sent, F.col("seq"))).alias("first_message"),
        F.min(F.when(greeted, F.col("seq"))).alias("first_greeting"),
        F.count_if(F.col("response_code") == SMTP_AUTH_FAILED).alias("failures"),
    )
    recipients = (
        records.select(*keys, F.explode("rcpt_to").alias("address"))
        .select(*keys, F.regexp_replace("address", r"^[<>]+|[<>]+$", "").alias("recipient"))
        .distinct()
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("recipients"))
    )
    totals = (
        counts.unionByName(recipients, allowMissingColumns=True)
        .groupBy(*keys)
        .agg(
            F.max("messages").alias("message_count"),
            F.coalesce(F.max("recipients"), F.lit(0)).alias("unique_recipients"),
            F.max("failures").alias("failed_auth_count"),
            F.max("greetings").alias("greetings"),
            F.max("first_message").alias("first_message"),
            F.max("first_greeting").alias("first_greeting"),
        )
    )
    ungreeted = F.col("first_message").isNotNull() & (
        F.col("first_greeting").isNull() | (F.col("first_message") < F.col("first_greeting"))
    )
    return totals.select(
        *keys,
        "message_count",
        "unique_recipients",
        "failed_auth_count",
        F.greatest(F.col("greetings") + ungreeted.cast("int"), F.lit(1)).alias(
            "total_connections"
        ),
        F.lit(None).cast("double").alias("avg_message_size_bytes"),
    )
