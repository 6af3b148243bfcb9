"""Assessment tables around findings: severity filter, hosts, template text, model prompts and
the parsing of model answers. No model is called here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretide.functions.scoring import HIGH, SEVERITIES

# Template texts and defaults for missing answer fields.
CLEAN_SUMMARY = "No findings were detected. The network appears clean."
SUMMARY = (
    "Detected %d finding(s) across %d affected host(s). Overall risk is %s (weighted score: %d). "
    "The top concern is %s (%s). Investigate the source IPs in your SIEM and apply recommended "
    "remediation steps."
)
TEMPLATE_QUALIFIER, TEMPLATE_LIKELIHOOD = "medium", 0.3
TEMPLATE_STEPS = (
    (
        1,
        "Investigate the source IPs in your SIEM",
        "Multiple findings detected — correlation needed",
    ),
    (
        2,
        "Review firewall rules for affected hosts",
        "Detection rules indicate suspicious network activity",
    ),
)
DEFAULT_QUALIFIER, DEFAULT_LIKELIHOOD, DEFAULT_PRIORITY = "medium", 0.5, 3
#: What a model is told before the parts of a prompt: the answer that ``parse_assessments`` reads.
SYSTEM_PROMPT = (
    "You review the findings of network detection rules for a security team. Reply with a single JSON object: "
    "executive_summary, a few sentences for readers outside the team; finding_rationales, a list of objects with "
    "finding_id, explanation, confidence_qualifier (high, medium or low) and false_positive_likelihood (0 to 1); "
    "remediation_steps, a list of objects with priority (1 is most urgent, 5 least), action, reason and reference."
)

_STEP_TYPE = "array<struct<priority:int,action:string,reason:string,reference:string>>"


def at_least(findings: DataFrame, severity: str = "HIGH") -> DataFrame:
    """Findings of a severity or worse; an unknown name means HIGH."""
    name = severity.upper()
    floor = SEVERITIES.index(name) + 1 if name in SEVERITIES else HIGH
    return findings.where(F.col("severity_code") >= floor)


def affected_hosts(findings: DataFrame, by: str = "capture_id") -> DataFrame:
    """Distinct entities over all findings of a group, one row each."""
    return findings.select(by, F.explode("affected_entities").alias("host")).distinct()


def first_findings(findings: DataFrame, by: str = "capture_id") -> DataFrame:
    """First finding of each group in evaluation order."""
    order = Window.partitionBy(by).orderBy("rule_place", "order_time", "subject")
    return (
        findings.select(by, "rule_place", "order_time", "subject", "rule_id", "title")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") == 1)
        .select(by, F.col("rule_id").alias("first_rule"), F.col("title").alias("first_title"))
    )


def template_summaries(
    findings: DataFrame, overall: DataFrame, by: str = "capture_id"
) -> DataFrame:
    """Template text for every scored group, with its fixed remediation steps."""
    hosts = affected_hosts(findings, by).groupBy(by).agg(F.count(F.lit(1)).alias("hosts"))
    text = F.format_string(
        SUMMARY,
        F.col("total_findings"),
        F.coalesce("hosts", F.lit(0)),
        F.col("severity_label"),
        F.col("weighted_score"),
        F.col("first_title"),
        F.col("first_rule"),
    )
    steps = F.array(
        *[
            F.struct(
                F.lit(p).alias("priority"),
                F.lit(a).alias("action"),
                F.lit(r).alias("reason"),
                F.lit(None).cast("string").alias("reference"),
            )
            for p, a, r in TEMPLATE_STEPS
        ]
    )
    return (
        overall.join(hosts, by, "left")
        .join(first_findings(findings, by), by, "left")
        .select(
            by,
            F.when(F.col("total_findings") > 0, text)
            .otherwise(F.lit(CLEAN_SUMMARY))
            .alias("executive_summary"),
            steps.cast(_STEP_TYPE).alias("remediation_steps"),
        )
    )


def template_rationales(findings: DataFrame, by: str = "capture_id") -> DataFrame:
    """Template rationale of every finding, one row each."""
    return findings.select(
        by,
        "finding_id",
        F.col("description").alias("explanation"),
        F.lit(TEMPLATE_QUALIFIER).alias("confidence_qualifier"),
        F.lit(TEMPLATE_LIKELIHOOD).alias("false_positive_likelihood"),
    )


def prompt_parts(findings: DataFrame, overall: DataFrame, by: str = "capture_id") -> DataFrame:
    """Prompt of each group as ordered rows: section, place, text; section -1 is the system prompt.

    A group with a million findings is a million rows spread over tasks; whoever sends the
    prompt reads them in (section, place) order.
    """
    risk = overall.select(
        by,
        F.lit(0).alias("section"),
        F.lit("").alias("place"),
        F.concat(
            F.lit("## Overall Risk\n"),
            F.to_json(
                F.struct(
                    "max_score", "weighted_score", "severity_label", "total_findings",
                    "findings_by_severity", "failed_rules",
                )
            ),
        ).alias("text"),
    )
    title = (
        findings.groupBy(by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            by,
            F.lit(1).alias("section"),
            F.lit("").alias("place"),
            F.format_string("## Detected Findings (%d total)", "n").alias("text"),
        )
    )
    body = findings.select(
        by,
        F.lit(2).alias("section"),
        F.concat_ws(
            "|", F.lpad(F.col("rule_place").cast("string"), 4, "0"),
            F.col("order_time").cast("string"), "subject", "finding_id",
        ).alias("place"),
        F.to_json(
            F.struct(
                F.col("finding_id").alias("id"), "rule_id", "rule_name", "severity", "confidence",
                "risk_score", "title", "description", "recommendation", "evidences",
                "affected_entities", "raw_score",
            )
        ).alias("text"),
    )
    hosts = affected_hosts(findings, by).select(
        by, F.lit(4).alias("section"), F.col("host").alias("place"), F.col("host").alias("text")
    )
    host_title = (
        hosts.select(by)
        .distinct()
        .select(
            by,
            F.lit(3).alias("section"),
            F.lit("").alias("place"),
            F.lit("## Affected Hosts").alias("text"),
        )
    )
    parts = overall.select(
        by, F.lit(-1).alias("section"), F.lit("").alias("place"), F.lit(SYSTEM_PROMPT).alias("text")
    )
    for more in (risk, title, body, host_title, hosts):
        parts = parts.unionByName(more)
    return parts


def _unfenced(text: Column) -> Column:
    """Answer without a surrounding code fence and its language tag."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    opened = F.regexp_replace(trimmed, r"^```[^\n]*\n", "")
    return F.when(
        F.startswith(trimmed, F.lit("```")), F.regexp_replace(opened, r"```$", "")
    ).otherwise(trimmed)


def _entries(answer: Column, path: str) -> Column:
    """Objects in a list of the answer; anything else in the list is dropped."""
    listed = F.coalesce(
        F.try_variant_get(answer, path, "array<variant>"), F.array().cast("array<variant>")
    )
    return F.filter(listed, lambda e: F.startswith(F.schema_of_variant(e), F.lit("OBJECT")))


def _field(entry: Column, name: str) -> Column:
    return F.try_variant_get(entry, f"$.{name}", "string")


def _given(entry: Column, name: str) -> Column:
    return F.try_variant_get(entry, f"$.{name}", "variant").isNotNull()


def parse_assessments(responses: DataFrame, text: str = "response") -> DataFrame:
    """Typed columns of model answers.

    An answer is valid when it is a JSON object with ``executive_summary``. Entries without a
    finding id, or with a likelihood or priority that is no number, are dropped; likelihoods are
    cut to 0..1.
    """

    def rationale(e: Column) -> Column:
        likelihood = F.when(
            _given(e, "false_positive_likelihood"),
            _field(e, "false_positive_likelihood").try_cast("double"),
        ).otherwise(F.lit(DEFAULT_LIKELIHOOD))
        return F.struct(
            _field(e, "finding_id").alias("finding_id"),
            F.coalesce(_field(e, "explanation"), F.lit("")).alias("explanation"),
            F.coalesce(_field(e, "confidence_qualifier"), F.lit(DEFAULT_QUALIFIER)).alias(
                "confidence_qualifier"
            ),
            F.least(F.greatest(likelihood, F.lit(0.0)), F.lit(1.0)).alias(
                "false_positive_likelihood"
            ),
            likelihood.isNotNull().alias("usable"),
        )

    def step(e: Column) -> Column:
        priority = F.when(
            _given(e, "priority"),
            _field(e, "priority").try_cast("double").try_cast("int"),
        ).otherwise(F.lit(DEFAULT_PRIORITY))
        return F.struct(
            priority.alias("priority"),
            F.coalesce(_field(e, "action"), F.lit("")).alias("action"),
            F.coalesce(_field(e, "reason"), F.lit("")).alias("reason"),
            F.nullif(_field(e, "reference"), F.lit("")).alias("reference"),
        )

    answer = F.col("_answer")
    parsed = responses.withColumn("_answer", F.try_parse_json(_unfenced(F.col(text))))
    valid = F.coalesce(
        F.startswith(F.schema_of_variant(answer), F.lit("OBJECT"))
        & F.try_variant_get(answer, "$.executive_summary", "variant").isNotNull(),
        F.lit(False),
    )
    rationales = F.filter(
        F.transform(_entries(answer, "$.finding_rationales"), rationale),
        lambda r: r["usable"] & r["finding_id"].isNotNull(),
    )
    rationales = F.transform(
        rationales,
        lambda r: F.struct(
            *[
                r[name].alias(name)
                for name in (
                    "finding_id", "explanation", "confidence_qualifier",
                    "false_positive_likelihood",
                )
            ]
        ),
    )
    steps = F.filter(
        F.transform(_entries(answer, "$.remediation_steps"), step),
        lambda s: s["priority"].isNotNull(),
    )
    return parsed.withColumn("valid", valid).select(
        *[c for c in responses.columns if c != text],
        "valid",
        F.when(
            F.col("valid"), F.try_variant_get(answer, "$.executive_summary", "string")
        ).alias("executive_summary"),
        F.when(F.col("valid"), rationales).alias("finding_rationales"),
        F.when(F.col("valid"), steps).alias("remediation_steps"),
    )
