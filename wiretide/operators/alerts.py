"""Queries over alerts, rule evaluations and assessments."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretide.functions.scoring import severity_from_rank, severity_rank, threat_level
from wiretide.functions.timing import parse_window, truncate_bucket
from wiretide.operators.talkers import recent_captures

TOP_RULES = 5


def _alert_filter(alerts: DataFrame, **wanted: object) -> DataFrame:
    for name, value in wanted.items():
        if value is not None:
            alerts = alerts.where(F.col(name) == F.lit(value))
    return alerts


def alert_list(
    alerts: DataFrame,
    *,
    status: str | None = None,
    severity: str | None = None,
    rule_id: str | None = None,
    session_id: object | None = None,
    sort_by: str = "triggered_at",
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """One page of alerts, newest first (or by ``risk_score``), ties by alert id."""
    chosen = _alert_filter(
        alerts, status=status, severity=severity, rule_id=rule_id, session_id=session_id
    )
    return chosen.orderBy(F.desc(sort_by), "alert_id").offset(offset).limit(limit)


def alert_count(alerts: DataFrame, **wanted: object) -> DataFrame:
    """Number of alerts behind the pages of ``alert_list``."""
    return _alert_filter(alerts, **wanted).agg(F.count(F.lit(1)).alias("total"))


def alert_timeline(
    alerts: DataFrame,
    since: datetime,
    bucket: str = "hour",
    session_id: object | None = None,
) -> DataFrame:
    """Alerts per rule and hour or day: count and most severe; newest bucket first."""
    chosen = _alert_filter(alerts, session_id=session_id).where(
        F.col("triggered_at") >= F.lit(since).cast("timestamp")
    )
    return (
        chosen.groupBy(
            "rule_id", truncate_bucket(F.col("triggered_at"), bucket).alias("bucket_start")
        )
        .agg(
            F.count(F.lit(1)).alias("count"),
            severity_from_rank(F.min(severity_rank(F.col("severity")))).alias("max_severity"),
        )
        .orderBy(F.desc("bucket_start"), F.desc("count"), "rule_id")
    )


def alert_timeline_pivot(timeline: DataFrame, rule_ids: list[str]) -> DataFrame:
    """Buckets by rules, zero where a rule had no alert.

    The rules are named by the caller, so no extra job looks for them.
    """
    return (
        timeline.groupBy("bucket_start")
        .pivot("rule_id", rule_ids)
        .agg(F.sum("count"))
        .na.fill(0, rule_ids)
        .orderBy("bucket_start")
    )


def evaluation_rows(
    flushes: DataFrame, findings: DataFrame, rule_ids: list[str], by: str = "session_id"
) -> DataFrame:
    """One evaluation per flush and registered rule; rules without findings are misses.

    ``flushes`` has ``by``, ``flush_id`` and ``evaluated_at``.
    """
    fired = findings.groupBy(by, "flush_id", "rule_id").agg(
        F.max("risk_score").alias("risk_score")
    )
    every_rule = flushes.select(
        by,
        "flush_id",
        "evaluated_at",
        F.explode(F.array(*[F.lit(r) for r in rule_ids])).alias("rule_id"),
    )
    return every_rule.join(fired, [by, "flush_id", "rule_id"], "left").select(
        by,
        "flush_id",
        "rule_id",
        F.col("risk_score").isNotNull().alias("triggered"),
        F.coalesce("risk_score", F.lit(0)).alias("risk_score"),
        "evaluated_at",
    )


def rule_stats(evaluations: DataFrame, by: str = "session_id") -> DataFrame:
    """Evaluations, hits, misses, mean and highest risk per rule and session."""
    return evaluations.groupBy("rule_id", by).agg(
        F.count(F.lit(1)).alias("evaluations"),
        F.count_if("triggered").alias("hits"),
        F.count_if(~F.col("triggered")).alias("miss"),
        # whole scores: the sum is exact in any order
        (F.sum("risk_score") / F.count(F.lit(1))).alias("avg_risk_score"),
        F.max("risk_score").cast("double").alias("max_risk_score"),
        F.max("evaluated_at").alias("last_evaluation_at"),
    )


def rule_stat_list(
    stats: DataFrame, session_id: object | None = None, limit: int = 50, by: str = "session_id"
) -> DataFrame:
    """Latest rule statistics with hit ratio."""
    chosen = stats if session_id is None else stats.where(F.col(by) == F.lit(session_id))
    ratio = F.when(
        F.col("evaluations") > 0, F.round(F.col("hits") / F.col("evaluations"), 4)
    ).otherwise(F.lit(0.0))
    return (
        chosen.withColumn("hit_ratio", ratio)
        .orderBy(F.desc("last_evaluation_at"), "rule_id", by)
        .limit(limit)
    )


def rule_history(evaluations: DataFrame, width: str = "60 seconds") -> DataFrame:
    """Evaluations, hits, false positives and mean risk per rule and time bucket.

    A false positive is a hit marked ``false_positive``; without that column there are none.
    """
    wrong: Column = (
        F.col("false_positive") if "false_positive" in evaluations.columns else F.lit(False)
    )
    return (
        evaluations.groupBy(F.window("evaluated_at", width).alias("w"), "rule_id")
        .agg(
            F.count(F.lit(1)).alias("evaluations"),
            F.count_if("triggered").alias("hits"),
            F.count_if(F.col("triggered") & wrong).alias("false_positives"),
            (F.sum("risk_score") / F.count(F.lit(1))).alias("avg_risk"),
        )
        .select(
            "rule_id",
            F.col("w.start").alias("bucket_start"),
            "evaluations",
            "hits",
            "false_positives",
            "avg_risk",
        )
    )


def risk_snapshot(
    assessments: DataFrame,
    alerts: DataFrame,
    captures: DataFrame,
    now: datetime,
    window: str = "5m",
) -> DataFrame:
    """Mean risk (0..1), threat level and most frequent rules over a window, as one row."""
    since = F.lit(now - parse_window(window)).cast("timestamp")
    average = assessments.where(F.col("created_at") >= since).agg(
        F.round(F.coalesce(F.avg("risk_score"), F.lit(0.0)) / 100, 4).alias("risk_avg")
    )
    top = (
        alerts.where(F.col("rule_id").isNotNull())
        .join(recent_captures(captures, now, window), "capture_id", "left_semi")
        .groupBy("rule_id")
        .agg(F.count(F.lit(1)).alias("alerts"))
        .orderBy(F.desc("alerts"), "rule_id")
        .limit(TOP_RULES)
        .agg(F.collect_list(F.struct(-F.col("alerts"), "rule_id")).alias("ranked"))
    )
    # two one-row tables side by side
    both = average.unionByName(top, allowMissingColumns=True).agg(
        F.max("risk_avg").alias("risk_avg"), F.flatten(F.collect_list("ranked")).alias("ranked")
    )
    return both.select(
        "risk_avg",
        threat_level(F.col("risk_avg")).alias("threat_level"),
        F.transform(F.array_sort("ranked"), lambda r: r["rule_id"]).alias("top_rules_triggered"),
    )


def risk_series(assessments: DataFrame, since: datetime) -> DataFrame:
    """Mean risk and number of assessments per minute, oldest first."""
    return (
        assessments.where(
            (F.col("created_at") >= F.lit(since).cast("timestamp"))
            & F.col("risk_score").isNotNull()
        )
        .groupBy(F.date_trunc("minute", "created_at").alias("bucket_start"))
        .agg(
            F.round(F.sum("risk_score") / F.count(F.lit(1)) / 100, 4).alias("risk_avg"),
            F.count(F.lit(1)).alias("count"),
        )
        .orderBy("bucket_start")
    )


def latest_alert_status(alert_events: DataFrame) -> DataFrame:
    """Last lifecycle event of each alert; the later event id wins a tie."""
    latest = Window.partitionBy("alert_id").orderBy(F.desc("created_at"), F.desc("event_id"))
    return (
        alert_events.withColumn("place", F.row_number().over(latest))
        .where(F.col("place") == 1)
        .select("alert_id", "event_type", "created_at")
    )
