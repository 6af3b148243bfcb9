import random
import statistics
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wiretide.operators import baseline, flows, profiles
from wiretide.schemas import PACKETS

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def packet(n, src, sport, dst, dport, length=100, at=None, protocol="TCP", flags=None, capture="c"):
    ts = None if at is None else T0 + timedelta(seconds=at)
    return (capture, n, ts, src, dst, sport, dport, protocol, length, None, flags)


def build(spark, rows, **options):
    return flows.flows(spark.createDataFrame(rows, PACKETS), **options)


def one(spark, rows):
    found = build(spark, rows).collect()
    assert len(found) == 1
    return found[0]


def test_both_directions_are_one_flow(spark):
    f = one(spark, [
        packet(1, "10.0.0.1", 5000, "10.0.0.2", 80, 100, 0),
        packet(2, "10.0.0.2", 80, "10.0.0.1", 5000, 200, 1),
    ])
    assert (f.packets_total, f.bytes_total, f.src_bytes, f.dst_bytes) == (2, 300, 100, 200)
    assert (f.duration_ms, f.inter_packet_interval_ms) == (1000.0, 1000.0)
    assert (f.src_ip, f.src_port, f.dst_ip, f.dst_port) == ("10.0.0.1", 5000, "10.0.0.2", 80)


def test_source_is_the_first_arrival_not_the_first_stamp(spark):
    f = one(spark, [
        packet(2, "10.0.0.1", 5000, "10.0.0.2", 80, 100, 0),
        packet(1, "10.0.0.2", 80, "10.0.0.1", 5000, 200, 5),
    ])
    assert (f.src_ip, f.src_bytes) == ("10.0.0.2", 200)
    assert f.inter_packet_interval_ms == -5000.0


def test_flags_and_failure(spark):
    f = one(spark, [
        packet(1, "10.0.0.1", 5000, "10.0.0.2", 80, 60, 0, flags="0x002"),
        packet(2, "10.0.0.2", 80, "10.0.0.1", 5000, 60, 1, flags="0x012"),
        packet(3, "10.0.0.2", 80, "10.0.0.1", 5000, 60, 2, flags="0x004"),
        packet(4, "10.0.0.2", 80, "10.0.0.1", 5000, 0, 2, flags="junk"),
    ])
    assert (f.syn_count, f.rst_count, f.ack_count, f.is_failed_flow) == (2, 1, 1, True)


def test_udp_never_fails_and_icmp_is_directed(spark):
    assert not one(spark, [packet(1, "10.0.0.1", 5, "10.0.0.2", 53, 50, 0, "UDP")]).is_failed_flow
    found = build(spark, [
        packet(1, "10.0.0.1", None, "10.0.0.2", None, 84, 0, "ICMP"),
        packet(2, "10.0.0.2", None, "10.0.0.1", None, 84, 1, "ICMP"),
    ]).collect()
    assert sorted((f.src_ip, f.src_port, f.packets_total) for f in found) == [
        ("10.0.0.1", 0, 1), ("10.0.0.2", 0, 1),
    ]


def test_missing_stamps_are_skipped(spark):
    f = one(spark, [
        packet(1, "10.0.0.1", 5000, "10.0.0.2", 80, 10, None),
        packet(2, "10.0.0.1", 5000, "10.0.0.2", 80, 10, 1),
        packet(3, "10.0.0.1", 5000, "10.0.0.2", 80, 10, None),
        packet(4, "10.0.0.1", 5000, "10.0.0.2", 80, 10, 4),
    ])
    assert (f.packets_total, f.duration_ms, f.inter_packet_interval_ms) == (4, 3000.0, 3000.0)


def random_packets(count, seed=7):
    dice = random.Random(seed)
    rows = []
    for n in range(count):
        # one conversation holds most packets
        ends = [("10.0.0.1", 4000), ("10.0.0.2", 80)] if dice.random() < 0.7 else [
            (f"10.0.{dice.randint(0, 2)}.9", dice.choice([1, 2, None])), ("2001:db8::1", dice.choice([53, 443])),
        ]
        if dice.random() < 0.4:
            ends.reverse()
        (src, sport), (dst, dport) = ends
        at = None if dice.random() < 0.1 else n * 0.5 + dice.random() * 3
        rows.append(packet(n * 3 + 1, src, sport, dst, dport, dice.randint(40, 1500), at,
                           dice.choice(["TCP", "UDP"]), dice.choice(["0x002", "0x010", "0x004", None])))
    return rows


def brute_force(rows):
    """Flows by walking packets one at a time."""
    groups = {}
    for r in sorted(rows, key=lambda r: r[1]):
        a, b = (r[3], r[5]), (r[4], r[6])
        key = (r[7], *sorted([a, b], key=lambda e: (e[0], e[1] or 0)))
        groups.setdefault(key, []).append(r)
    out = {}
    for key, packets in groups.items():
        first = packets[0]
        stamps = [p[2] for p in packets if p[2] is not None]
        gaps = [(b - a) / timedelta(milliseconds=1) for a, b in zip(stamps, stamps[1:])]
        own = sum(p[8] for p in packets if (p[3], p[5]) == (first[3], first[5]))
        out[(first[3], first[5] or 0, first[4], first[6] or 0, first[7], len(packets))] = (
            sum(p[8] for p in packets), own, statistics.fmean(gaps) if gaps else 0.0,
            statistics.variance(gaps) if len(gaps) > 1 else 0.0,
        )
    return out


@pytest.mark.parametrize("chunk_rows", [1, 7, 100, 1_000_000])
def test_any_chunk_size_gives_the_walked_result(spark, chunk_rows):
    rows = random_packets(300)
    want = brute_force(rows)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    got = build(spark, shuffled, chunk_rows=chunk_rows).collect()
    assert len(got) == len(want)
    for f in got:
        key = (f.src_ip, f.src_port, f.dst_ip, f.dst_port, f.protocol, f.packets_total)
        volume, own, mean, variance = want[key]
        assert (f.bytes_total, f.src_bytes, f.dst_bytes) == (volume, own, volume - own)
        assert f.inter_packet_interval_ms == pytest.approx(mean, abs=1e-3)
        assert f.inter_packet_interval_variance_ms == pytest.approx(variance, rel=1e-6, abs=1e-3)


def test_long_gaps_do_not_overflow(spark):
    days = 400 * 86400.0
    f = one(spark, [packet(n, "10.0.0.1", 1, "10.0.0.2", 2, 10, at) for n, at in enumerate([0, 1, days, 2 * days])])
    want = statistics.variance([1000.0, (days - 1) * 1000.0, days * 1000.0])
    assert f.inter_packet_interval_variance_ms == pytest.approx(want, rel=1e-9)


def test_directed_traffic_from_state_equals_direct(spark):
    packets = spark.createDataFrame(random_packets(200), PACKETS)
    state = flows.flow_state(flows.packet_rows(packets))
    columns = ["src_ip", "dst_ip", "dst_port", "protocol"]

    def table(directed):
        rows = directed.groupBy(*columns).agg(
            F.sum("packets"), F.sum("bytes"), F.min("first_us"), F.max("last_us")
        ).collect()
        return sorted(map(tuple, rows), key=repr)

    assert table(flows.directed_from_state(state)) == table(flows.directed_traffic(packets))


def test_port_scan_profile_and_compatibility(spark):
    rows = [packet(n, "10.0.0.9", 1000, "10.0.0.1", n, 60, n, flags="0x004") for n in range(1, 31)]
    packets = spark.createDataFrame(rows, PACKETS)
    directed, table = flows.directed_traffic(packets), flows.flows(packets)
    p = profiles.connection_profiles(directed, table).collect()[0]
    assert (p.port_scan_suspect, p.unique_dst_ports, p.unique_dst_ports_per_host) == (True, 30, 30)
    assert (p.total_connections, p.failed_connections, p.failed_connection_ratio) == (30, 30, 1.0)
    old = profiles.connection_profiles(directed, table, count_failures=False).collect()[0]
    assert (old.failed_connections, old.success_connections) == (0, 30)


def test_server_is_not_a_scanner_when_only_initiators_count(spark):
    rows = [packet(n, "10.0.0.1", 443, "10.0.0.9", 1000 + n, 60, n + 0.5) for n in range(2, 62, 2)]
    rows += [packet(n - 1, "10.0.0.9", 1000 + n, "10.0.0.1", 443, 60, n) for n in range(2, 62, 2)]
    packets = spark.createDataFrame(rows, PACKETS)
    directed, table = flows.directed_traffic(packets), flows.flows(packets)
    both = {p.src_ip: p.port_scan_suspect for p in profiles.connection_profiles(directed, table).collect()}
    own = {p.src_ip: p.port_scan_suspect
           for p in profiles.connection_profiles(directed, table, initiator_only=True).collect()}
    assert both["10.0.0.1"] is True
    assert own == {"10.0.0.9": False}


def test_baseline_of_one_packet_counts_one_second(spark):
    packets = spark.createDataFrame([packet(1, "10.0.0.1", 1, "10.0.0.2", 2, 500, 3)], PACKETS)
    b = baseline.traffic_baseline(flows.directed_traffic(packets)).collect()[0]
    assert (b.expected_bytes_per_second, b.duration_seconds) == (500.0, 1.0)
    assert b.protocol_percentages == {"TCP": 100.0}
