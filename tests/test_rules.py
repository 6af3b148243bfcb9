from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from wiretide.operators import assessment, evaluation
from wiretide.plans import isolation
from wiretide.plans.detect import overall_risk, overall_risk_worst_first, run_rules
from wiretide.plans.features import Features, Tables
from wiretide.rules import BUILT_IN, SUSPICIOUS_VOLUME, Rule, RuleRegistry, default_registry, evidence, make_finding
from wiretide.schemas import PACKETS
from wiretide.sinks import tables as sinks

from test_flows import packet


@pytest.fixture(scope="module")
def traffic(spark):
    rows = [packet(n, "10.9.0.1", 50001, "8.8.4.4", 443, 90, n * 5, flags="0x010", capture="beacon")
            for n in range(60)]
    rows += [packet(n, "10.9.0.2", None, "10.9.0.250", None, 84, n * 0.004, "ICMP", capture="ping")
             for n in range(300)]
    rows += [packet(n, "10.9.0.3", 50003, "8.8.4.4", 443, 1_000_000, n * 0.02, flags="0x010", capture="bulk")
             for n in range(150)]
    rows += [packet(n, "10.9.0.4", 50004, "10.9.0.251", 80, 60, n * 0.01, flags="0x002", capture="flood")
             for n in range(120)]
    rows += [packet(n, f"10.9.1.{n}", 1, f"10.9.2.{n}", 2, 200, n, flags="0x010", capture="quiet")
             for n in range(5)]
    return Features(Tables(packets=spark.createDataFrame(rows, PACKETS)))


@pytest.fixture(scope="module")
def found(traffic):
    return run_rules(traffic)


def test_flow_rules_fire_where_planted(found):
    hits = {(r.capture_id, r.rule_id): r for r in found.findings.collect()}
    assert set(hits) == {
        ("beacon", "NET-008"), ("beacon", "NET-009"), ("ping", "NET-007"), ("ping", "NET-008"),
        ("bulk", "NET-008"), ("bulk", "NET-011"), ("flood", "NET-005"), ("flood", "NET-008"),
    }
    assert found.failed_rules == ()
    beacon = hits["beacon", "NET-009"]
    assert (beacon.risk_score, beacon.severity, beacon.confidence) == (100, "CRITICAL", "HIGH")
    assert beacon.title == "Beaconing 10.9.0.1 → 8.8.4.4"
    assert beacon.feature_snapshot["interval_ms"] == 5000.0
    bulk = hits["bulk", "NET-011"]
    assert bulk.raw_score == pytest.approx(0.9)
    assert bulk.title == "Large outbound transfer 10.9.0.3 → 8.8.4.4: 150,000,000 B"
    assert bulk.affected_entities == ["10.9.0.3", "8.8.4.4"]
    flood = hits["flood", "NET-005"]
    assert [e.key for e in flood.evidences] == ["syn_ack_ratio", "syn_pps"]


def test_overall_risk_covers_quiet_captures(found, traffic):
    rows = {r.capture_id: r for r in overall_risk(found.findings, traffic.totals).collect()}
    quiet = rows["quiet"]
    assert (quiet.max_score, quiet.weighted_score, quiet.severity_label) == (0, 0, "Informational")
    assert (quiet.findings_by_severity, quiet.top_finding_ids) == ({}, [])
    assert rows["beacon"].total_findings == 2
    assert len(rows["beacon"].top_finding_ids) == 2


def test_worst_first_example(spark):
    scores = [85, 60, 45, 20]
    table = spark.createDataFrame([("c", s, i, str(i)) for i, s in enumerate(scores)],
                                  "capture_id string, risk_score int, rule_place int, finding_id string")
    groups = spark.createDataFrame([("c",), ("d",)], "capture_id string")
    rows = {r.capture_id: r.worst_first_score for r in overall_risk_worst_first(table, groups).collect()}
    assert rows == {"c": 91.25, "d": 0.0}


def test_registry():
    registry = default_registry()
    assert len(registry) == 11
    assert registry.get("NET-010").rule_name == "Cleartext Credentials"
    with pytest.raises(ValueError):
        registry.register(Rule("", "nameless"))
    again = Rule("NET-001", "Mine", "profiles", BUILT_IN[0].finding)
    registry.register(again)
    assert len(registry) == 11 and registry.get("NET-001") is again
    registry.clear()
    assert len(registry) == 0 and registry.get("NET-001") is None


def test_a_rule_that_cannot_be_planned_is_named(traffic):
    broken = Rule("BAD-1", "Broken", "flows", lambda: F.struct(F.col("no_such_column").alias("x")))
    result = run_rules(traffic, RuleRegistry([broken, *BUILT_IN]))
    assert result.failed_rules == ("BAD-1",)
    assert result.findings.count() == 8


def fragile(fails_at):
    """A rule over flows that divides by zero where the source port is ``fails_at``, and fires elsewhere."""
    port = F.col("src_port")
    return lambda: make_finding(
        1 / (port - fails_at) != 7, entity=F.col("src_ip"), subject=F.col("src_ip"), raw=F.lit(0.5), confidence=F.lit(1),
        title=F.lit("t"), description=F.lit("d"), recommendation=F.lit("r"), evidences=[evidence("port", port, 1)],
        entities=F.array("src_ip"), start=F.col("start_time"), end=F.col("end_time"), snapshot={"port": port},
    )


def test_a_rule_that_fails_while_running_fails_only_where_it_does(traffic, found):
    no_plan = Rule("BAD-1", "Broken", "flows", lambda: F.struct(F.col("no_such_column").alias("x")))
    registry = RuleRegistry([no_plan, Rule("BAD-2", "Fragile", "flows", fragile(50003)), *BUILT_IN])
    got = isolation.run_rules_isolated(traffic, registry)
    lost = {(r.capture_id, r.rule_id, r.stage, r.error) for r in got.failures.collect()}
    captures = {"beacon", "ping", "bulk", "flood", "quiet"}
    assert lost == {(c, "BAD-1", "plan", "NOT_PLANNED") for c in captures} | {("bulk", "BAD-2", "run", "DIVIDE_BY_ZERO")}
    hits = got.findings.collect()
    assert {r.capture_id for r in hits if r.rule_id == "BAD-2"} == captures - {"bulk"}
    built_in = {(r.finding_id, r.risk_score, r.rule_place - 2) for r in hits if r.rule_id.startswith("NET")}
    assert built_in == {(r.finding_id, r.risk_score, r.rule_place) for r in found.findings.collect()}
    risk = {r.capture_id: r.failed_rules for r in overall_risk(got.findings, traffic.totals, failures=got.failures).collect()}
    assert risk["bulk"] == ["BAD-1", "BAD-2"] and risk["quiet"] == ["BAD-1"]


def test_isolation_is_bounded_and_free_where_nothing_fails(traffic, found):
    all_lost = Rule("BAD-3", "Everywhere", "flows", lambda: fragile(0)().withField("raw", F.raise_error(F.lit("no")).cast("double")))
    registry = RuleRegistry([all_lost, *BUILT_IN])
    got = isolation.run_rules_isolated(traffic, registry, most_trials=1)
    assert {r.capture_id for r in got.failures.collect()} == {"beacon", "ping", "bulk", "flood", "quiet"}
    assert {r.finding_id for r in got.findings.collect()} == {r.finding_id for r in found.findings.collect()}
    fine = isolation.run_rules_isolated(traffic)
    assert fine.failures.collect() == [] and fine.findings.count() == found.findings.count()


def test_failing_groups_and_their_errors_are_found_without_splitting(traffic, found):
    def finding():
        size = F.when(F.col("protocol") == "ICMP", F.lit("many")).otherwise(F.lit("3")).cast("int")
        raw = 1 / (F.col("src_port") - 50003)
        return fragile(7)().withField("raw", F.when(F.col("src_ip") != "10.9.0.1", raw + raw * size).otherwise(raw + size))

    registry = RuleRegistry([Rule("BAD-4", "Two errors", "flows", finding), Rule("BAD-2", "Fragile", "flows", fragile(50004)), *BUILT_IN])
    got = isolation.run_rules_isolated(traffic, registry, most_trials=0)
    lost = {(r.capture_id, r.rule_id, r.stage, r.error) for r in got.failures.collect()}
    assert lost == {
        ("bulk", "BAD-4", "run", "DIVIDE_BY_ZERO"), ("ping", "BAD-4", "run", "CAST_INVALID_INPUT"),
        ("flood", "BAD-2", "run", "DIVIDE_BY_ZERO"),
    }
    hits = {(r.capture_id, r.rule_id) for r in got.findings.collect()}
    assert {c for c, r in hits if r == "BAD-4"} == {"beacon", "flood", "quiet"}
    assert {r.finding_id for r in got.findings.collect() if r.rule_id.startswith("NET")} == {
        r.finding_id for r in found.findings.collect()
    }


def test_own_rule_and_optional_rule(traffic):
    volume = run_rules(traffic, RuleRegistry([SUSPICIOUS_VOLUME])).findings.collect()
    assert {r.capture_id for r in volume} >= {"bulk"}


def test_alert_sink_and_assessment(found, traffic, tmp_path, spark):
    sinks.write_alerts(found.findings, str(tmp_path / "alerts"))
    sinks.write_flows(traffic.flows, str(tmp_path / "flows"))
    alerts = spark.read.parquet(str(tmp_path / "alerts")).where("category = 'NET-009'").collect()
    assert alerts[0].severity == "critical" and '"confidence":"HIGH"' in alerts[0].evidence
    stored = spark.read.parquet(str(tmp_path / "flows"))
    assert stored.count() == traffic.flows.count()
    assert stored.where("protocol = 'ICMP'").select("src_port", "bytes_recv").collect()[0] == (None, 0)
    overall = overall_risk(found.findings, traffic.totals)
    text = {r.capture_id: r.executive_summary
            for r in assessment.template_summaries(found.findings, overall).collect()}
    assert text["quiet"] == "No findings were detected. The network appears clean."
    assert text["flood"].startswith("Detected 2 finding(s) across 2 affected host(s). Overall risk is")
    parts = assessment.prompt_parts(assessment.at_least(found.findings, "nonsense"), overall)
    sections = [r.section for r in parts.where("capture_id = 'flood'").orderBy("section", "place").collect()]
    assert sections == [-1, 0, 1, 2, 2, 3, 4, 4]


def test_answers_of_a_model(spark):
    texts = [
        '```json\n{"executive_summary": "s", "finding_rationales": [{"finding_id": 7, '
        '"false_positive_likelihood": "1.5"}, {"finding_id": "b", "false_positive_likelihood": "x"}, 3], '
        '"remediation_steps": [{"priority": "2", "reference": ""}, {"priority": "soon"}]}\n```',
        "[1]", "not json", '{"finding_rationales": []}', None,
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, response string")
    parsed = {r.id: r for r in assessment.parse_assessments(rows).collect()}
    assert [parsed[i].valid for i in range(5)] == [True, False, False, False, False]
    first = parsed[0]
    assert [(r.finding_id, r.false_positive_likelihood, r.confidence_qualifier)
            for r in first.finding_rationales] == [("7", 1.0, "medium")]
    assert [(s.priority, s.action, s.reference) for s in first.remediation_steps] == [(2, "", None)]


def test_confusion_matrix_counts(spark):
    labels = spark.createDataFrame(
        [("a", True, ["port_scan"]), ("b", True, ["botnet_c2"]), ("c", False, []), ("d", None, [])],
        "capture_id string, attack_present boolean, attack_types array<string>",
    )
    fired = spark.createDataFrame([("a", "NET-001"), ("c", "NET-001"), ("b", "NET-002"), ("d", "NET-001")],
                                  "capture_id string, rule_id string")
    matrix = evaluation.confusion_matrix(labels, fired)
    rows = {r.rule_id: (r.tp, r.fp, r.tn, r.fn) for r in matrix.collect()}
    assert rows["NET-001"] == (1, 1, 0, 1)
    assert rows["NET-002"] == (1, 0, 2, 0)
    assert rows["NET-004"] == (0, 0, 3, 0)
    macro = evaluation.macro_metrics(matrix).collect()[0]
    assert (macro.labeled_captures, macro.total_tp) == (3, 2)
