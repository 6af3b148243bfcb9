"""Detection quality against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules measured, and the rules each labelled attack type should fire.
MEASURED_RULES = {
    "NET-001": "Port Scan Detection",
    "NET-002": "DNS Tunneling Detection",
    "NET-003": "FTP Brute Force Detection",
    "NET-004": "SMTP Abuse Detection",
}
EXPECTED_RULES = {
    "port_scan": ("NET-001",),
    "dns_tunneling": ("NET-002",),
    "ftp_brute_force": ("NET-003",),
    "smtp_abuse": ("NET-004",),
    "botnet_c2": ("NET-001", "NET-002"),
}


def _expected(rule: Column) -> Column:
    """True when one of the capture's attack types should fire the rule."""
    hit = F.lit(False)
    for attack, rules in EXPECTED_RULES.items():
        hit = hit | (F.array_contains("attack_types", attack) & rule.isin(*rules))
    return F.coalesce(F.col("attack_present") & hit, F.lit(False))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def confusion_matrix(labels: DataFrame, fired: DataFrame) -> DataFrame:
    """True and false positives and negatives per rule over labelled captures.

    ``labels``: capture_id, attack_present, attack_types; ``fired``: capture_id, rule_id.
    Captures without a label row do not count. The four rules are unfolded inside each label row.
    """
    rules = F.create_map(*[F.lit(x) for pair in MEASURED_RULES.items() for x in pair])
    cases = labels.where(F.col("attack_present").isNotNull()).select(
        "capture_id", "attack_present", "attack_types", F.explode(rules).alias("rule_id", "rule_name")
    )
    hits = fired.select("capture_id", "rule_id").distinct().withColumn("hit", F.lit(True))
    judged = cases.join(hits, ["capture_id", "rule_id"], "left").select(
        "rule_id",
        "rule_name",
        _expected(F.col("rule_id")).alias("expected"),
        F.col("hit").isNotNull().alias("hit"),
    )
    expected, hit = F.col("expected"), F.col("hit")
    return judged.groupBy("rule_id", "rule_name").agg(
        F.count(F.lit(1)).alias("labeled_captures"),
        F.count_if(expected & hit).alias("tp"),
        F.count_if(~expected & hit).alias("fp"),
        F.count_if(~expected & ~hit).alias("tn"),
        F.count_if(expected & ~hit).alias("fn"),
    )


def _rates() -> dict[str, Column]:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": _ratio(2 * precision * recall, precision + recall),
        "fpr": _ratio(fp, fp + tn),
        "accuracy": _ratio(tp + tn, tp + fp + tn + fn),
    }


def rule_metrics(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1, false-positive rate and accuracy per rule, four decimals."""
    return matrix.withColumns({name: F.round(rate, 4) for name, rate in _rates().items()})


def macro_metrics(matrix: DataFrame) -> DataFrame:
    """Averages over rules and totals, one row."""
    rates = _rates()
    return matrix.agg(
        F.coalesce(F.max("labeled_captures"), F.lit(0)).alias("labeled_captures"),
        *[
            F.round(F.coalesce(F.avg(rates[name]), F.lit(0.0)), 4).alias(f"macro_{name}")
            for name in ("precision", "recall", "f1")
        ],
        *[
            F.coalesce(F.sum(name), F.lit(0)).alias(f"total_{name}")
            for name in ("tp", "fp", "tn", "fn")
        ],
    )


def capture_evaluation(
    stats: DataFrame, labels: DataFrame, findings: DataFrame, seconds: float | None = None
) -> DataFrame:
    """Per capture: label, fired rules and, when the run time is given, packets per second."""
    fired = findings.groupBy("capture_id").agg(
        F.sort_array(F.collect_set("rule_id")).alias("rule_ids_fired"),
        F.count(F.lit(1)).alias("findings"),
    )
    rate = F.round(F.col("packet_count") / F.lit(seconds), 2) if seconds else F.lit(0.0)
    return (
        stats.join(labels, "capture_id", "left")
        .join(fired, "capture_id", "left")
        .select(
            "capture_id",
            "packet_count",
            F.col("attack_present").isNotNull().alias("has_label"),
            F.coalesce("attack_present", F.lit(False)).alias("attack_present"),
            F.coalesce("attack_types", F.array().cast("array<string>")).alias("attack_types"),
            F.coalesce("rule_ids_fired", F.array().cast("array<string>")).alias("rule_ids_fired"),
            F.coalesce("findings", F.lit(0)).alias("findings"),
            rate.alias("throughput_pps"),
        )
    )
