"""Writers: flows, alerts, live alerts, assessments and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretide.operators.flows import stored_flows


def write_flows(flow_table: DataFrame, path: str, by: str = "capture_id", mode: str = "append") -> None:
    """Stored flows by day of flow start, sorted by group, protocol and time.

    Rebalancing gathers a day in few files but splits a day or capture that is too large for one
    task; the sort gives Parquet narrow min/max ranges to skip by.
    """
    rows = stored_flows(flow_table, by).withColumn("day", F.to_date("start_time"))
    (
        rows.hint("rebalance", "day")
        .sortWithinPartitions("day", by, "protocol", "start_time")
        .write.mode(mode)
        .partitionBy("day")
        .parquet(path)
    )


def _evidence() -> Column:
    return F.struct("rule_id", "rule_name", "rule_version", "evidences")


def alert_rows(findings: DataFrame, by: str = "capture_id") -> DataFrame:
    """Findings as alerts: lower-case severity, category = rule, the rest packed as JSON."""
    return findings.select(
        F.col("finding_id").alias("alert_id"),
        by,
        F.lower("severity").alias("severity"),
        F.col("rule_id").alias("category"),
        "title",
        "description",
        F.to_json(
            F.struct(
                "rule_id", "rule_name", "rule_version", "confidence", "risk_score", "raw_score",
                "recommendation", "affected_entities", "evidences",
            )
        ).alias("evidence"),
        "rule_id",
        F.lit(False).alias("ai_corroborated"),
    )


def live_alert_rows(
    findings: DataFrame, by: str = "session_id", session_id: str | None = None
) -> DataFrame:
    """Findings as live alerts with status active; ``session_id`` overrides the group key."""
    session = F.col(by).cast("string") if session_id is None else F.lit(session_id)
    return findings.select(
        F.col("finding_id").alias("alert_id"),
        session.alias("session_id"),
        "rule_id",
        F.lower("severity").alias("severity"),
        F.lower("confidence").alias("confidence"),
        "risk_score",
        "raw_score",
        F.lit("active").alias("status"),
        "title",
        "description",
        "recommendation",
        "affected_entities",
        F.to_json(_evidence()).alias("evidence"),
        "feature_snapshot",
        "timestamp_start",
        "timestamp_end",
    )


def write_alerts(findings: DataFrame, path: str, by: str = "capture_id", mode: str = "append") -> None:
    alert_rows(findings, by).write.mode(mode).parquet(path)


def assessment_rows(
    assessments: DataFrame, provider: str, model: str, fallback: bool, by: str = "capture_id"
) -> DataFrame:
    """Assessments as stored: rationales and steps as JSON. The score lives in the risk table."""
    rationales = (
        F.col("finding_rationales")
        if "finding_rationales" in assessments.columns
        else F.array().cast("array<string>")
    )
    note = f"provider={provider};fallback_used={fallback}"
    return assessments.select(
        by,
        F.lit(None).cast("int").alias("risk_score"),
        F.lit(None).cast("string").alias("risk_label"),
        "executive_summary",
        F.to_json(F.struct(rationales.alias("rationales"))).alias("key_findings"),
        F.to_json(F.struct(F.col("remediation_steps").alias("steps"))).alias("recommendations"),
        F.lit(model).alias("model_name"),
        F.lit(note).alias("raw_response"),
    )


def write_assessments(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).parquet(path)


def write_reports(
    evaluations: DataFrame, overall: DataFrame, path: str, by: str = "capture_id"
) -> None:
    """One JSON report line per capture: label, fired rules, risk, throughput.

    Findings stay in the alert table; a report names them by id.
    """
    risk = overall.select(by, F.struct(*[c for c in overall.columns if c != by]).alias("overall_risk"))
    evaluations.join(risk, by, "left").write.mode("overwrite").json(path)


def write_metrics(metrics: DataFrame, macro: DataFrame, path: str) -> None:
    """Detection quality as JSON: one line per rule and one with the averages."""
    lines = metrics.select(F.to_json(F.struct("*")).alias("value")).unionByName(
        macro.select(F.to_json(F.struct(F.lit("overall").alias("rule_id"), "*")).alias("value"))
    )
    lines.coalesce(1).write.mode("overwrite").text(path)
