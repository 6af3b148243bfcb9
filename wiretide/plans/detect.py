"""Run rules over features, and score whole captures."""

from __future__ import annotations

from collections.abc import Container
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretide.functions.scoring import (
    SEVERITIES,
    confidence_name,
    risk_label,
    risk_score,
    severity_code,
    severity_name,
)
from wiretide.plans.features import Features
from wiretide.rules import Rule, RuleRegistry, default_registry

TOP_FINDINGS = 5
# Fixed value: points per further finding in the worst-first score.
WORST_FIRST_BONUS = 0.05


@dataclass(frozen=True)
class Detection:
    """Findings of all rules and the ids of rules that could not be planned."""

    findings: DataFrame
    failed_rules: tuple[str, ...]


def _identified(raw: DataFrame, by: str) -> DataFrame:
    key = F.concat_ws(
        "|", F.col(by).cast("string"), "rule_id", "subject", F.col("timestamp_start").cast("string")
    )
    score = risk_score(F.col("raw"))
    scored = raw.withColumns(
        {
            "risk_score": score,
            "raw_score": F.when(F.col("shown_digits") == 4, F.round("raw", 4)).otherwise(
                F.col("raw")
            ),
            "severity_code": F.coalesce("own_severity", severity_code(score)),
        }
    )
    return scored.select(
        F.sha2(key, 256).alias("finding_id"),
        by,
        "rule_place",
        "rule_id",
        "rule_name",
        "rule_version",
        "entity",
        "subject",
        # flow findings follow flow start, all others follow their subject
        F.when(F.col("timed"), F.col("timestamp_start")).alias("order_time"),
        "severity_code",
        severity_name(F.col("severity_code")).alias("severity"),
        "confidence_code",
        confidence_name(F.col("confidence_code")).alias("confidence"),
        "risk_score",
        "raw_score",
        "title",
        "description",
        "recommendation",
        "evidences",
        "affected_entities",
        "timestamp_start",
        "timestamp_end",
        "feature_snapshot",
    )


def _candidate(rule: Rule, place: int, skip: Column | None = None):
    body = rule.column()
    return F.struct(
        F.lit(place).alias("rule_place"),
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.rule_name).alias("rule_name"),
        F.lit(rule.version).alias("rule_version"),
        F.lit(rule.source == "flows").alias("timed"),
        (body if skip is None else F.when(~skip, body)).alias("body"),
    )


def _without_lost(source: DataFrame, lost: DataFrame, by: str) -> DataFrame:
    """The feature table with ``lost_rules``, the rules that are not evaluated on the row's group."""
    rules = lost.groupBy(F.col(by).alias("lost_group")).agg(F.collect_set("rule_id").alias("lost_rules"))
    return source.join(rules, F.col(by).eqNullSafe(F.col("lost_group")), "left").drop("lost_group")


def run_rules(
    features: Features,
    registry: RuleRegistry | None = None,
    *,
    hold: bool = False,
    only: Container[str] | None = None,
    known: set[str] | None = None,
    lost: DataFrame | None = None,
) -> Detection:
    """Evaluate every rule, one pass per feature table.

    ``hold=True`` computes the findings once for several outputs. ``only`` names the rules to run, in
    their places among all. ``known`` names rules that need no trial planning, as they have been planned over
    the same feature tables; it gains those that pass. ``lost`` (group, ``rule_id``) names rules over feature tables that are
    not evaluated on some groups. A rule whose plan Spark refuses is left out and named; errors while running
    fail the job (``isolation.run_rules_isolated`` contains them).
    """
    by = features.by
    registry = registry or default_registry()
    parts: list[DataFrame] = []
    failed: list[str] = []
    grouped: dict[str, list] = {}
    sources: dict[str, DataFrame | None] = {}
    for place, rule in enumerate(registry.get_all()):
        if only is not None and rule.rule_id not in only:
            continue
        try:
            if rule.plan is not None:
                parts.append(
                    rule.plan(features).withColumns(
                        {
                            "rule_place": F.lit(place),
                            "rule_id": F.lit(rule.rule_id),
                            "rule_name": F.lit(rule.rule_name),
                            "rule_version": F.lit(rule.version),
                            "timed": F.lit(False),
                        }
                    )
                )
                continue
            if rule.source not in sources:
                sources[rule.source] = features.table(rule.source)
                if lost is not None and sources[rule.source] is not None:
                    sources[rule.source] = _without_lost(sources[rule.source], lost, by)
            source = sources[rule.source]
            if source is None:
                continue
            skip = None
            if lost is not None:
                skip = F.coalesce(F.array_contains("lost_rules", rule.rule_id), F.lit(False))
            candidate = _candidate(rule, place, skip)
            if known is None or rule.rule_id not in known:
                source.select(candidate).schema  # analysis only: is the rule plannable?
            if known is not None:
                known.add(rule.rule_id)
            grouped.setdefault(rule.source, []).append(candidate)
        except (PySparkException, KeyError, TypeError, ValueError):
            failed.append(rule.rule_id)
    for name, candidates in grouped.items():
        # a column first: generators and lambdas interpret what is inside them, columns are compiled
        fired = F.filter("candidates", lambda c: c["body"].isNotNull())
        parts.append(
            sources[name]
            .select(by, F.array(*candidates).alias("candidates"))
            .select(by, F.inline(fired))
            .select(by, "rule_place", "rule_id", "rule_name", "rule_version", "timed", "body.*")
        )
    if not parts:
        raise ValueError("no rule could be planned")
    findings = parts[0]
    for part in parts[1:]:
        findings = findings.unionByName(part)
    findings = _identified(findings, by)
    return Detection(features.hold(findings) if hold else findings, tuple(failed))


def overall_risk(
    findings: DataFrame,
    groups: DataFrame,
    by: str = "capture_id",
    failed_rules: tuple[str, ...] = (),
    failures: DataFrame | None = None,
) -> DataFrame:
    """Risk summary of every group in ``groups`` (one row each); no findings means zero.

    ``failed_rules`` failed on every group; ``failures`` (group, ``rule_id``) says which failed where.
    """
    weight, score = F.col("severity_code"), F.col("risk_score")
    counts = [
        F.count_if(weight == code).alias(f"n_{name}") for code, name in enumerate(SEVERITIES, 1)
    ]
    summary = findings.groupBy(by).agg(
        F.max(score).alias("max_score"),
        F.sum(score * weight).alias("weighted_sum"),
        F.sum(weight).alias("total_weight"),
        F.count(F.lit(1)).alias("total_findings"),
        *counts,
    )
    order = Window.partitionBy(by).orderBy(F.desc("risk_score"), "rule_place", "finding_id")
    top = (
        findings.select(by, "risk_score", "rule_place", "finding_id")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= TOP_FINDINGS)
        .groupBy(by)
        .agg(F.array_sort(F.collect_list(F.struct("place", "finding_id"))).alias("top"))
    )
    weighted = F.coalesce(
        F.call_function("div", F.col("weighted_sum"), F.col("total_weight")), F.lit(0)
    )
    by_severity = F.map_filter(
        F.create_map(
            *[x for name in SEVERITIES for x in (F.lit(name), F.coalesce(f"n_{name}", F.lit(0)))]
        ),
        lambda _, n: n > 0,
    )
    everywhere = F.array(*[F.lit(r) for r in failed_rules]).cast("array<string>")
    known = groups.select(by).join(summary, by, "left").join(top, by, "left")
    if failures is not None:
        lost = failures.groupBy(by).agg(F.array_sort(F.collect_set("rule_id")).alias("lost_rules"))
        known = known.join(lost, by, "left")
        everywhere = F.array_union(everywhere, F.coalesce("lost_rules", everywhere))
    return (
        known.select(
            by,
            F.coalesce("max_score", F.lit(0)).alias("max_score"),
            weighted.alias("weighted_score"),
            risk_label(weighted).alias("severity_label"),
            F.coalesce("total_findings", F.lit(0)).alias("total_findings"),
            by_severity.alias("findings_by_severity"),
            F.coalesce(
                F.transform("top", lambda t: t["finding_id"]), F.array().cast("array<string>")
            ).alias("top_finding_ids"),
            everywhere.alias("failed_rules"),
        )
    )


def overall_risk_worst_first(
    findings: DataFrame, groups: DataFrame, by: str = "capture_id"
) -> DataFrame:
    """Highest score plus 5 % of each of the next three, at most 100."""
    order = Window.partitionBy(by).orderBy(F.desc("risk_score"), "rule_place", "finding_id")
    top = (
        findings.select(by, "risk_score", "rule_place", "finding_id")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= 4)
        .groupBy(by)
        .agg(
            F.max("risk_score").alias("max_score"),
            F.sum(F.when(F.col("place") > 1, F.col("risk_score"))).alias("next_scores"),
        )
    )
    score = F.least(
        F.coalesce("max_score", F.lit(0))
        + F.coalesce(F.col("next_scores"), F.lit(0)) * F.lit(WORST_FIRST_BONUS),
        F.lit(100.0),
    )
    return (
        groups.select(by)
        .join(top, by, "left")
        .select(by, F.coalesce("max_score", F.lit(0)).alias("max_score"),
                F.round(score, 2).alias("worst_first_score"))
    )
