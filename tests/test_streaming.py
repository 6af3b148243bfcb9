import math
import random

import pytest
from pyspark.sql import functions as F

from wiretide.operators import alerts, flows
from wiretide.plans.detect import run_rules
from wiretide.plans.features import EventFeatures
from wiretide.rules import BUILT_IN, RuleRegistry
from wiretide.schemas import FLOW_EVENTS
from wiretide.streaming import adaptive, expiry, rules, windows

from test_flows import T0
from datetime import timedelta

FEW_RULES = RuleRegistry([r for r in BUILT_IN if r.rule_id in ("NET-001", "NET-005", "NET-006", "NET-007")])


def event(n, src, sport, dst, dport, size=60, at=0.0, protocol="TCP", flags=None, session="s", packets=1, **http):
    fields = dict(seq=n, ts=T0 + timedelta(seconds=at), src_ip=src, dst_ip=dst, src_port=sport, dst_port=dport,
                  protocol=protocol, bytes=size, packets=packets, flags=flags, session_id=session, **http)
    return tuple(fields.get(f.name) for f in FLOW_EVENTS.fields)


def scan(n, session="s"):
    return [event(i, "10.0.0.1", 999, "10.0.0.2", i, 50, i * 0.1, flags="SYN", session=session)
            for i in range(1, n + 1)]


def test_event_flows_weigh_packets_and_flags(spark):
    rows = [
        event(1, "10.0.0.1", 5, "10.0.0.2", 80, 100, 0, flags="syn", packets=3),
        event(2, "10.0.0.2", 80, "10.0.0.1", 5, 40, 1, flags="SYN+ACK", packets=2),
    ]
    f = flows.event_flows(spark.createDataFrame(rows, FLOW_EVENTS)).collect()
    assert len(f) == 1
    assert (f[0].packets_total, f[0].syn_count, f[0].ack_count, f[0].src_bytes) == (5, 5, 2, 100)


def test_stream_profiles_find_scans_and_failures(spark):
    rows = scan(30) + [event(99, "10.0.0.7", 1, "10.0.0.8", 2, 50, 0, flags="SYN+RST")]
    features = EventFeatures(spark.createDataFrame(rows, FLOW_EVENTS))
    by_ip = {p.src_ip: p for p in features.profiles.collect()}
    assert by_ip["10.0.0.1"].port_scan_suspect
    assert by_ip["10.0.0.7"].failed_connection_ratio == 1.0
    features.release()


def test_rule_stream_equals_batch_and_replays_safely(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    web = [event(1000 + i, "10.0.0.3", 7, "10.0.0.4", 80, 500, i, session="t", http_method="GET", http_uri="/x",
                 http_status=500, http_user_agent="sqlmap") for i in range(5)]
    table = spark.createDataFrame(scan(40) + web, FLOW_EVENTS)
    table.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(FLOW_EVENTS).parquet(str(source))
    rules.start_rule_stream(stream, str(out), str(tmp_path / "cp"), FEW_RULES, interval=None).awaitTermination()
    got = spark.read.parquet(str(out / "alerts"))
    want = run_rules(EventFeatures(table), FEW_RULES).findings
    columns = ["session_id", "rule_id", "risk_score", "title"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert {r.rule_id for r in got.collect()} == {"NET-001", "NET-006"}
    # the same batch again overwrites its folder
    before = got.count()
    rules.RuleStream(str(out), FEW_RULES).flush(table, 0)
    assert spark.read.parquet(str(out / "alerts")).count() == before
    stats = {(r.session_id, r.rule_id): (r.evaluations, r.hits) for r in
             alerts.rule_stats(spark.read.parquet(str(out / "evaluations"))).collect()}
    assert len(stats) == 2 * len(FEW_RULES)
    assert stats["s", "NET-001"] == (1, 1) and stats["t", "NET-001"] == (1, 0)


def test_settings_of_small_flushes_hold_in_the_stream_only(spark, tmp_path):
    before = {n: spark.conf.get(n) for n in rules.SMALL_FLUSHES}
    table = spark.createDataFrame(scan(40), FLOW_EVENTS)
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FLOW_EVENTS).parquet(str(tmp_path / "in"))
    out, point = str(tmp_path / "out"), str(tmp_path / "cp")
    one = RuleRegistry(FEW_RULES.get_all()[:1])
    rules.start_rule_stream(stream, out, point, one, interval=None, settings=rules.SMALL_FLUSHES).awaitTermination()
    got = spark.read.parquet(f"{out}/alerts").collect()
    want = run_rules(EventFeatures(table), one).findings.collect()
    assert [(r.rule_id, r.risk_score) for r in got] == [(r.rule_id, r.risk_score) for r in want] != []
    assert {n: spark.conf.get(n) for n in before} == before


def test_rule_stream_adapts_to_earlier_batches(spark, tmp_path):
    config = adaptive.AdaptiveConfig(min_samples=2, window_size=3)
    handler = rules.RuleStream(str(tmp_path), RuleRegistry(FEW_RULES.get_all()[:1]), config)
    for batch, ports in enumerate([30, 30, 30, 60]):
        handler.flush(spark.createDataFrame(scan(ports), FLOW_EVENTS), batch)
    rows = spark.read.parquet(str(tmp_path / "alerts")).orderBy("batch_id").collect()
    raw = [r.raw_score for r in rows]
    assert raw[0] == raw[1] == raw[2] < raw[3]
    plain = run_rules(EventFeatures(spark.createDataFrame(scan(60), FLOW_EVENTS)), handler.registry).findings
    # no spread in the history: the boost is capped
    assert raw[3] == pytest.approx(min(plain.collect()[0].raw_score * 1.45, 1.0), abs=1e-4)
    kept = spark.read.parquet(str(tmp_path / "scores" / "batch_id=3"))
    assert kept.count() == 3


def walk(rows, config, record):
    """Scores one at a time, as the live engine would."""
    out, history, pending, flush = [], {}, {}, {}
    for session, rule, f, seq, raw in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        key = (session, rule)
        if flush.get(key) != f:
            history.setdefault(key, []).extend(pending.pop(key, []))
            flush[key] = f
        base = history[key][-config.window_size:]
        score = raw
        if len(base) >= config.min_samples and rule not in config.disabled_rules:
            mean = sum(base) / len(base)
            std = math.sqrt(sum((x - mean) ** 2 for x in base) / len(base))
            z = (raw - mean) / std if std > 1e-9 else 3.0 * ((raw > mean) - (raw < mean))
            z = max(-3.0, min(3.0, z))
            score = max(0.0, min(1.0, raw * (1 + 0.15 * z)))
        pending.setdefault(key, []).append(score if record == "adapted" else raw)
        out.append((session, rule, f, seq, round(score, 9), len(base)))
    return sorted(out)


@pytest.fixture(params=[("true", "3"), ("true", "8"), ("false", "8"), ("false", "200")])
def planning(spark, request):
    names = "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions"
    before = [spark.conf.get(n) for n in names]
    for name, value in zip(names, request.param):
        spark.conf.set(name, value)
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


@pytest.mark.parametrize("record, block", [("adapted", 10_000), ("adapted", 10), ("adapted", 1), ("original", 1), ("original", 5), ("original", 20)])
def test_adaptive_scores_equal_the_walked_result(spark, planning, record, block):
    dice = random.Random(3)
    rows = [(f"s{dice.randint(0, 1)}", f"r{dice.randint(0, 2)}", n // 7, n, dice.choice([0.2, 0.5, 0.8, 0.81]))
            for n in range(900)]
    config = adaptive.AdaptiveConfig(window_size=25, min_samples=5, disabled_rules=("r2",))
    table = spark.createDataFrame(rows, "session_id string, rule_id string, flush_id long, seq long, raw_score double")
    got = adaptive.adaptive_scores(table.repartition(5), config, record=record, block_flushes=block).collect()
    got = sorted((r.session_id, r.rule_id, r.flush_id, r.seq, round(r.adapted_score, 9), r.baseline_samples)
                 for r in got)
    want = walk(rows, config, record)
    assert [g[:4] + g[5:] for g in got] == [w[:4] + w[5:] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want], abs=1e-8)


def test_stateful_scores_equal_batch_scores(spark, tmp_path):
    dice = random.Random(5)
    rows = [("s", f"r{n % 2}", n // 20, n, dice.random()) for n in range(120)]
    schema = "session_id string, rule_id string, flush_id long, seq long, raw_score double"
    table = spark.createDataFrame(rows, schema)
    for flush in range(6):
        table.where(F.col("flush_id") == flush).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    config = adaptive.AdaptiveConfig(window_size=15, min_samples=5)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    (adaptive.stream_adaptive_scores(stream, config).writeStream.format("parquet").outputMode("append")
     .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
     .start(str(tmp_path / "out")).awaitTermination())
    want = {r.seq: r.adapted_score for r in adaptive.adaptive_scores(table, config).collect()}
    got = {r.seq: r.adapted_score for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_window_arguments():
    for size, slide in ((0, 1), (5, 0), (1, 2), (-1, -1)):
        with pytest.raises(ValueError):
            windows.check_window(size, slide)


def test_sliding_windows_count_every_event_in_each_window(spark):
    rows = [event(i, "10.0.0.1", 1, "10.0.0.2", 2, 10, at) for i, at in enumerate([0.2, 1.2, 4.9, 7.0])]
    table = spark.createDataFrame(rows, FLOW_EVENTS)
    counts = windows.sliding_flow_counts(table, 5, 1)
    assert counts.agg(F.sum("packets")).collect()[0][0] == 5 * len(rows)
    full = windows.sliding_flows(table, 5, 1)
    first = full.where(F.col("window_start") == F.lit(T0)).collect()[0]
    assert (first.packets_total, first.inter_packet_interval_ms) == (3, 2350.0)


@pytest.mark.parametrize(("size", "slide"), [(5, 1), (5, 2), (3, 3), (0.6, 0.4), (8, 0.5)])
def test_sliding_windows_read_off_buckets_are_not_hashed_again(spark, monkeypatch, size, slide):
    dice = random.Random(7)
    rows = [event(i, "10.0.0.1", 1 + i % 2, "10.0.0.2", 2, 10 + i, round(dice.uniform(-30, 60), 1)) for i in range(150)]
    rows += [event(200 + i, "10.0.0.2", 2, "10.0.0.1", 1, 5, 3600 * slide * i - 0.1) for i in range(-2, 3)]
    table = spark.createDataFrame(rows, FLOW_EVENTS)
    beside = windows.sliding_flow_counts(table, size, slide)
    assert beside._jdf.queryExecution().executedPlan().toString().count("HashAggregate") == 2
    monkeypatch.setattr(windows, "SLICE_SLIDES", 20)
    sliced = windows.sliding_flow_counts(table, size, slide)
    monkeypatch.setattr(windows, "MOST_BESIDE", 0)
    hashed = windows.sliding_flow_counts(table, size, slide)
    want = sorted(map(str, hashed.collect()))
    assert len(want) > 50
    assert sorted(map(str, beside.select(*hashed.columns).collect())) == want
    assert sorted(map(str, sliced.select(*hashed.columns).collect())) == want


def test_streamed_windows_equal_batch_windows(spark, tmp_path):
    rows = [event(i, "10.0.0.1", 1, "10.0.0.2", 2, 10, at) for i, at in enumerate([0, 1, 2, 40, 41, 100])]
    table = spark.createDataFrame(rows, FLOW_EVENTS)
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FLOW_EVENTS).parquet(str(tmp_path / "in"))
    (windows.idle_flows(stream, 10).writeStream.format("parquet").outputMode("append")
     .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
     .start(str(tmp_path / "out")).awaitTermination())
    got = sorted(r.packets for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = sorted(r.packets for r in windows.idle_flows(table, 10).collect())
    assert batch == [1, 2, 3]
    # the last flow is still open: no later event has moved the watermark past its gap
    assert got == [2, 3]


def test_idle_flows_join_across_slices(spark):
    dice = random.Random(11)
    at, rows = 0.0, []
    for n in range(400):
        at += dice.choice([0.5, 5, 9.9, 10.0, 30, 200])
        rows.append(event(n, "10.0.0.1", 1, "10.0.0.2", 2, 10, at, session="hot" if n % 3 else "cold"))
    want = []
    for session in ("hot", "cold"):
        stamps = [(r[1] - T0).total_seconds() for r in rows if r[FLOW_EVENTS.fieldNames().index("session_id")] == session]
        sizes = [1]
        for a, b in zip(stamps, stamps[1:]):
            if round(b - a, 6) >= 10:
                sizes.append(0)
            sizes[-1] += 1
        want += [(session, s) for s in sizes]
    got = windows.idle_flows(spark.createDataFrame(rows, FLOW_EVENTS), 10).collect()
    assert sorted((r.session_id, r.packets) for r in got) == sorted(want)


def test_guessed_windows_that_are_wrong_are_folded_again(spark, monkeypatch):
    """Without rows before a block to guess from, every guess but the first is wrong."""
    monkeypatch.setattr(adaptive, "LEAD_WINDOWS", 0.04)
    dice = random.Random(9)
    rows = [("s", "r0", n // 5, n, dice.random()) for n in range(700)] + [("s", "r1", n, n, 0.5) for n in range(30)]
    config = adaptive.AdaptiveConfig(window_size=25, min_samples=5)
    table = spark.createDataFrame(rows, "session_id string, rule_id string, flush_id long, seq long, raw_score double")
    want = {(w[1], w[3]): w[4] for w in walk(rows, config, "adapted")}
    for rounds in (5, 50):  # most blocks are walked through in the end, or all are folded again
        monkeypatch.setattr(adaptive, "ROUNDS", rounds)
        got = adaptive.adaptive_scores(table, config, block_flushes=20).collect()
        assert {(r.rule_id, r.seq): round(r.adapted_score, 9) for r in got} == want and len(got) == len(rows)


def cut_by_hand(rows, seconds):
    """Flows of (stamp, from the left, bytes) in time order, opened and closed one event at a time."""
    out = []
    for at, left, size in rows:
        if not out or at - out[-1][0] >= seconds:
            out.append([at, at, 0, 0, 0, []])
        flow = out[-1]
        flow[1], flow[2], flow[3 if left else 4] = at, flow[2] + 1, flow[3 if left else 4] + size
        flow[5].append(at)
    return out


def flow_numbers(table):
    start = T0.replace(tzinfo=None)
    return sorted(
        ((r.start_time - start).total_seconds(), (r.end_time - start).total_seconds(), r.packets_total, r.src_ip,
         r.src_bytes, r.dst_bytes, r.inter_packet_interval_ms, r.inter_packet_interval_variance_ms)
        for r in table.collect()
    )


def by_hand(rows, seconds):
    out = []
    for (opened, last, n, left, right, stamps), first in zip(cut_by_hand(rows, seconds), [r for r in rows if r[0] in {f[0] for f in cut_by_hand(rows, seconds)}]):
        gaps = [b - a for a, b in zip(stamps, stamps[1:])]
        mean = sum(gaps) / len(gaps) if gaps else 0.0
        spread = sum((g - mean) ** 2 for g in gaps) / (len(gaps) - 1) if len(gaps) > 1 else 0.0
        out.append((opened, last, n, "10.0.0.1" if first[1] else "10.0.0.2", left if first[1] else right,
                    right if first[1] else left, pytest.approx(mean * 1000, abs=1e-3), pytest.approx(spread * 1e6, abs=1e-2)))
    return sorted(out, key=lambda f: f[0])


def both_ways(rows):
    return [event(n, "10.0.0.1", 1, "10.0.0.2", 2, size, at) if left else event(n, "10.0.0.2", 2, "10.0.0.1", 1, size, at)
            for n, (at, left, size) in enumerate(rows)]


@pytest.mark.parametrize("slice_seconds", [3, 10, 64, 10_000])
def test_active_expiry_at_rest_equals_a_walk(spark, slice_seconds):
    dice, at, rows = random.Random(21), 0.0, []
    for _ in range(400):
        at += dice.choice([0.25, 0.5, 1, 2.5, 9.75, 10, 31])
        rows.append((at, dice.random() < 0.5, dice.randint(1, 99)))
    other = [event(900 + n, "10.0.0.8", 1, "10.0.0.9", 2, 5, n) for n in range(9)]
    table = spark.createDataFrame(both_ways(rows), FLOW_EVENTS)
    assert flow_numbers(expiry.active_flows(table, 10, slice_seconds=slice_seconds)) == by_hand(rows, 10)
    short = expiry.active_flows(spark.createDataFrame(other, FLOW_EVENTS), 10, slice_seconds=slice_seconds).collect()
    assert [r.packets_total for r in short] == [9]


def test_active_expiry_of_a_stream_equals_a_walk(spark, tmp_path):
    dice, at, rows = random.Random(22), 0.0, []
    for _ in range(120):
        at += dice.choice([0.25, 0.5, 1, 2.5, 9.75, 10, 31])
        rows.append((at, dice.random() < 0.5, dice.randint(1, 99)))
    events = both_ways(rows) + [event(999, "10.0.0.9", 1, "10.0.0.8", 2, 10, at + 500)]
    for k in range(0, len(events), 40):  # several micro-batches, with flows open between them
        spark.createDataFrame(events[k : k + 40], FLOW_EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FLOW_EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    (expiry.active_flows(stream, 10).writeStream.format("parquet").outputMode("append")
     .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
     .start(str(tmp_path / "out")).awaitTermination())
    got = flow_numbers(spark.read.parquet(str(tmp_path / "out")))
    assert got == by_hand(rows, 10)


def test_active_expiry_cuts_busy_flows(spark, tmp_path):
    rows = [event(i, "10.0.0.1", 1, "10.0.0.2", 2, 10, i) for i in range(25)]
    rows.append(event(99, "10.0.0.9", 1, "10.0.0.8", 2, 10, 500))
    spark.createDataFrame(rows, FLOW_EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FLOW_EVENTS).parquet(str(tmp_path / "in"))
    (expiry.active_flows(stream, 10).writeStream.format("parquet").outputMode("append")
     .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
     .start(str(tmp_path / "out")).awaitTermination())
    got = sorted((r.start_time.second, r.packets_total) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 10), (10, 10), (20, 5)]


def test_active_expiry_at_rest_cuts_many_slices_in_one_python_call(spark):
    """A group without a number beside ids that a double cannot hold; many flows in one batch of rows."""
    big, rows = 2**53 + 1, [(0.5 * n, True, 1) for n in range(60)]
    events = [event(n, f"10.0.0.{k}", 1, "10.0.1.1", 2, 1, at) for k in range(9) for n, (at, _, _) in enumerate(rows)]
    table = spark.createDataFrame(events, FLOW_EVENTS).drop("session_id")
    ids = F.explode(F.array(F.lit(big), F.lit(None).cast("long"), F.lit(big + 1)))
    found = expiry.active_flows(table.withColumn("session_id", ids).coalesce(1), 10, slice_seconds=2)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    got = {(r.session_id, r.src_ip, r.start_time.second, r.packets_total) for r in found.collect()}
    assert got == {(i, f"10.0.0.{k}", s, 20) for i in (big, None, big + 1) for k in range(9) for s in (0, 10, 20)}


@pytest.mark.parametrize("slice_seconds", [3, 64])
def test_active_expiry_of_busy_keys_equals_a_walk(spark, slice_seconds):
    dice, at, rows = random.Random(23), 0.0, []
    for _ in range(300):
        at += dice.choice([0.25, 0.5, 1, 2.5, 9.75, 10, 31])
        rows.append((at, dice.random() < 0.5, dice.randint(1, 99)))
    table = spark.createDataFrame(both_ways(rows), FLOW_EVENTS)
    assert flow_numbers(expiry.active_flows(table, 10, slice_seconds=slice_seconds, busy_rows=0)) == by_hand(rows, 10)


def test_active_expiry_of_busy_and_other_keys_is_the_same(spark):
    """Arrival out of time order, gaps whose squares outgrow 64 bits, keys with nulls, numbers that are missing."""
    dice, rows = random.Random(24), []
    for n in range(900):
        k, at = n % 7, dice.choice([0.5, 7, 4000]) * n + dice.randint(0, 9)
        rows.append(event(n, f"10.0.0.{k}", 1, "10.0.1.1", 2, dice.randint(1, 99), at) if n % 2 else
                    event(n, "10.0.1.1", 2, f"10.0.0.{k}", 1, dice.randint(1, 99), at))
    none = F.when(F.col("seq") % 7 == 3, None)
    table = spark.createDataFrame(rows, FLOW_EVENTS).withColumn("src_ip", none.otherwise(F.col("src_ip")))
    lost = (F.col("seq") % 7 == 5) & (F.col("seq") < 6)  # the first event of a key has no number
    table = table.withColumn("seq", F.when(~lost, F.col("seq")))
    for seconds in (30, 9000):
        found = [
            sorted(map(repr, expiry.active_flows(table, seconds, slice_seconds=2000, busy_rows=n).collect()))
            for n in (0, 100, 1000)
        ]
        assert found[0] == found[1] == found[2] and len(found[0]) > 7


def test_active_expiry_shuffles_ordinary_events_once(spark):
    rows = [event(n, f"10.0.0.{n % 9}", 1, "10.0.1.1", 2, 1, 0.5 * n) for n in range(600)]
    found = expiry.active_flows(spark.createDataFrame(rows, FLOW_EVENTS), 10)
    assert sum(r.packets_total for r in found.collect()) == 600
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    shuffles = [line for line in final.splitlines() if " Exchange hashpartitioning" in line]
    # nothing of the counts of keys is left in the plan once no key turned out busy
    assert len(shuffles) == 1 and "xxhash64(session_id" in shuffles[0]


def test_a_micro_batch_of_several_flushes_equals_batch_scores(spark, tmp_path):
    dice = random.Random(6)
    rows = [("s", f"r{n % 2}", n // 20, n, dice.random()) for n in range(240)]
    schema = "session_id string, rule_id string, flush_id long, seq long, raw_score double"
    table = spark.createDataFrame(dice.sample(rows, len(rows)), schema)
    for first in (0, 4):  # flushes 0 to 3, and 4 to 11
        part = table.where(F.col("flush_id").between(first, 2 * first + 3))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    config = adaptive.AdaptiveConfig(window_size=15, min_samples=5)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    (adaptive.stream_adaptive_scores(stream, config).writeStream.format("parquet").outputMode("append")
     .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
     .start(str(tmp_path / "out")).awaitTermination())
    numbers = lambda found: {r.seq: (r.baseline_samples, round(r.adapted_score, 9)) for r in found.collect()}
    assert numbers(spark.read.parquet(str(tmp_path / "out"))) == numbers(adaptive.adaptive_scores(table, config))


def test_copies_before_small_blocks_stay_in_proportion(spark):
    rows = [(None if n % 2 else 1, "r", n, n, 0.5) for n in range(2000)]
    table = spark.createDataFrame(rows, "session_id long, rule_id string, flush_id long, seq long, raw_score double")
    found = adaptive._blocks_with_lead(table, ["session_id", "rule_id"], 100, 5)
    counts = {r._lead: r["count"] for r in found.groupBy("_lead").count().collect()}
    assert counts[False] == 2000 and 0 < counts[True] <= 4000
