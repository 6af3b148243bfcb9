import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wiretide.sources import arrays, dissected, events, labels


def dissect(number, layers, **ips):
    frame = {"frame.number": str(number), "frame.time_epoch": f"{1650000000 + number}.250000", "frame.len": "80"}
    ip = {"ip.src": "172.20.5.9", "ip.dst": "203.0.113.7"} if not ips else ips
    return {"_source": {"layers": {"frame": frame, "ip": ip, **layers, "_ws.col.Info": "info"}}}


CAPTURE = [
    dissect(1, {"udp": {"udp.srcport": "40961", "udp.dstport": "53"},
                "dns": {"dns.qry.name": "kiosk.test", "dns.qry.type": "A", "dns.flags.rcode": "0",
                        "dns.resp.name": "kiosk.test", "dns.a": ["198.51.100.3", "", "198.51.100.4"]}}),
    dissect(2, {"tcp": {"tcp.srcport": ["50123", "1"], "tcp.dstport": "80", "tcp.flags": "0x018"},
                "http": {"http.request.method": "GET", "http.request.uri": "/a?b", "http.host": "h"}}),
    dissect(3, {"icmp": {"icmp.type": "8"}}),
    dissect(4, {"tcp": {"tcp.srcport": "1", "tcp.dstport": "21"}, "ftp": {"ftp.response.code": "530"}}),
    dissect(5, {"tcp": {"tcp.srcport": "1", "tcp.dstport": "25"},
                "smtp": {"smtp.command": "RCPT", "smtp.rcpt_to": "<a@b.c>"}}),
    dissect(6, {"tcp": {"tcp.srcport": "x", "tcp.dstport": "9"}}, **{"ip.src": "not an ip", "ip.dst": "203.0.113.7"}),
]


def pretty(packets):
    blocks = ["  " + json.dumps(p, indent=2).replace("\n", "\n  ") for p in packets]
    return "[\n" + ",\n".join(blocks) + "\n]\n"


@pytest.fixture(params=["pretty", "lines", "array", "split"])
def capture(request, tmp_path):
    text = {
        "pretty": pretty(CAPTURE),
        "lines": "\n".join(json.dumps(p) for p in CAPTURE),
        "array": json.dumps(CAPTURE),
        "split": json.dumps(CAPTURE),
    }[request.param]
    (tmp_path / "scan-1.json").write_text(text)
    return request.param, str(tmp_path)


def test_every_layout_gives_the_same_tables(spark, capture):
    layout, path = capture
    tables = dissected.parse_packets(dissected.read_packets(spark, path, layout))
    packets = tables.packets.orderBy("packet_number").collect()
    assert [(p.capture_id, p.packet_number, p.protocol, p.src_port, p.dst_port, p.tcp_flags) for p in packets] == [
        ("scan-1", 1, "UDP", 40961, 53, None), ("scan-1", 2, "TCP", 50123, 80, "0x018"),
        ("scan-1", 3, "ICMP", None, None, None), ("scan-1", 4, "TCP", 1, 21, None),
        ("scan-1", 5, "TCP", 1, 25, None),
    ]
    assert packets[0].length == 80
    stamp = tables.packets.agg(F.min(F.unix_micros("ts"))).collect()[0][0]
    assert stamp == 1650000001250000
    d = tables.dns.collect()[0]
    assert (d.qname, d.qtype, d.response_code) == ("kiosk.test", "A", "0")
    assert d.answers == ["kiosk.test", "198.51.100.3", "198.51.100.4"]
    h = tables.http.collect()[0]
    assert (h.method, h.host, h.uri, h.status_code) == ("GET", "h", "/a?b", None)
    assert tables.ftp.collect()[0].response_code == 530
    assert tables.smtp.collect()[0].rcpt_to == ["<a@b.c>"]


def test_records_are_parsed_once_and_read_by_kind(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "scan-1.json").write_text(json.dumps(CAPTURE))
    rows = dissected.read_packets(spark, str(tmp_path / "in"))
    stored, counts = dissected.store_records(rows, str(tmp_path / "records"))
    plain = dissected.parse_packets(rows)
    for kind in ("packets", "dns", "http", "ftp", "smtp"):
        table, want = getattr(stored, kind), getattr(plain, kind)
        assert table.columns == want.columns and [f.dataType for f in table.schema] == [f.dataType for f in want.schema]
        assert sorted(map(repr, table.collect())) == sorted(map(repr, want.collect()))
        assert counts[kind] == want.count()
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "from_json" not in plan and f"(kind#" in plan.split("PartitionFilters")[1] and f"= {kind})" in plan
    none, counts = dissected.store_records(rows.limit(0), str(tmp_path / "none"))
    assert none.packets.collect() == [] and set(counts.values()) <= {0}


def test_broken_packet_loses_only_itself(spark, tmp_path):
    text = pretty(CAPTURE[:3]).replace('"udp.srcport": "40961"', '"udp.srcport": 53 53')
    (tmp_path / "bad.json").write_text(text)
    tables = dissected.parse_packets(dissected.read_packets(spark, str(tmp_path)))
    assert sorted(p.packet_number for p in tables.packets.collect()) == [2, 3]


@pytest.mark.parametrize("text", [
    json.dumps(CAPTURE), json.dumps(CAPTURE, separators=(",", ":")) + "\n", json.dumps(CAPTURE, indent=4),
    "[" + ",\n".join(json.dumps(p) for p in CAPTURE) + "]", "[\n" + "\n,\n".join(json.dumps(p) for p in CAPTURE) + "\n]",
])
def test_default_layout_reads_every_packet_of_any_array(spark, tmp_path, text):
    (tmp_path / "c.json").write_text(text)
    rows = dissected.read_packets(spark, str(tmp_path))
    assert rows.count() == len(CAPTURE)


@pytest.fixture(params=[7, 64, 4096])
def split_bytes(spark, request):
    names = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield request.param
    for name, value in before.items():
        spark.conf.set(name, value)


def test_one_line_arrays_are_read_by_many_tasks(spark, tmp_path, split_bytes):
    tricky = [
        {"a": 'a } in { a "string" \\', "b": {"c": [{}, {"d": "}}"}]}}, {}, {"é": "\u007b \\\"} {", "n": None},
        {"long": "x{" * 40, "deep": {"deep": {"deep": {"end": "\""}}}}, {"k": "end"},
    ]
    (tmp_path / "one.json").write_text(json.dumps(tricky))
    (tmp_path / "two.json").write_text(json.dumps(tricky[:2], indent=1, ensure_ascii=False) + "\n")
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "cut.json").write_text(json.dumps(tricky)[:-30])
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, tricky)))
    got = {}
    for row in arrays.array_objects(spark, str(tmp_path)).collect():
        got.setdefault(row.name, []).append(json.dumps(json.loads(row.value), sort_keys=True))
    text = lambda items: sorted(json.dumps(i, sort_keys=True) for i in items)
    assert {n: sorted(v) for n, v in got.items()} == {
        "one.json": text(tricky), "two.json": text(tricky[:2]), "cut.json": text(tricky[:3]), "lines.json": text(tricky)
    }
    if split_bytes < 4096:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 3


def test_text_of_arrays_is_not_shuffled(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(CAPTURE * 50))
    objects = arrays.array_objects(spark, str(tmp_path)).select("value")
    plan = objects._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 1 and "hashpartitioning(file" in shuffles[0]  # parts that cross a border, two a split at most
    assert objects.count() == 50 * len(CAPTURE)


def test_files_in_one_split_are_cut_without_summing_up(spark, tmp_path, monkeypatch):
    """Their text passes through Python once; sums are only for files of several splits."""

    def no_sums(batches):
        for batch in batches:
            raise AssertionError(f"{batch.num_rows} rows summed up")
        return iter(())

    monkeypatch.setattr(arrays, "_sum_splits", no_sums)
    for n in range(3):
        (tmp_path / f"f{n}.json").write_text(json.dumps([{"n": n, "k": k, "t": '}"{\\'} for k in range(40)]))
    found = sorted((r.name, json.loads(r.value)["k"]) for r in arrays.array_objects(spark, str(tmp_path)).collect())
    assert found == [(f"f{n}.json", k) for n in range(3) for k in range(40)]


def test_objects_are_cut_as_by_a_walk_over_the_signs(spark):
    dice = random.Random(4)
    for _ in range(300):
        fragments = ["".join(dice.choice('"\\{a,') for _ in range(dice.randint(0, 9))) + "}" for _ in range(12)]
        for inside in (0, 1):
            quotes, depth, want = inside, 0, []
            for fragment in fragments:
                skip = False
                for sign in fragment[:-1]:
                    if skip or sign == "\\":
                        skip = not skip
                    elif sign == '"':
                        quotes += 1
                    elif sign == "{":
                        depth += quotes % 2 == 0
                depth -= quotes % 2 == 0
                want.append((quotes % 2, depth))
            data = np.frombuffer("".join(fragments).encode(), np.uint8)
            ends = np.cumsum([len(f) for f in fragments]) - 1
            found, odd, *depths = arrays._depths(data, ends)
            assert found + inside == quotes
            assert [((o + inside) % 2, d) for o, d in zip(odd.tolist(), depths[inside].tolist(), strict=True)] == want


def test_array_that_would_be_cut_wrongly_is_an_error(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(CAPTURE, indent=1))
    with pytest.raises(Exception, match="layout='array'"):
        dissected.read_packets(spark, str(tmp_path)).count()


def test_values_too_large_lose_only_themselves(spark, tmp_path):
    wide = dissect(1, {"tcp": {"tcp.srcport": "99999999999", "tcp.dstport": "9" * 40, "tcp.flags": "0x" + "0" * 30 + "12"},
                       "http": {"http.response.code": "99999999999"}})
    wide["_source"]["layers"]["frame"]["frame.time_epoch"] = "99999999999999.5"
    (tmp_path / "c.json").write_text(json.dumps([wide, CAPTURE[1]]))
    tables = dissected.parse_packets(dissected.read_packets(spark, str(tmp_path)))
    found = tables.packets.orderBy("packet_number").collect()
    assert [(p.src_port, p.dst_port) for p in found] == [(None, None), (50123, 80)]
    assert [h.status_code for h in tables.http.collect()] == [None, None]


def test_packet_filter_and_extra_layer(spark, tmp_path):
    packet = dissect(9, {"tcp": {"tcp.srcport": "1", "tcp.dstport": "443"}, "tls": {"tls.sni": "x.example"}})
    (tmp_path / "c.json").write_text(json.dumps(packet))
    rows = dissected.read_packets(
        spark, str(tmp_path), "lines", {"tls": ["tls.sni"]}, "layers.tcp.`tcp.dstport` = '443'"
    )
    assert rows.select("layers.tls.`tls.sni`").collect()[0][0] == "x.example"


def test_events_are_checked_and_typed(spark):
    good = dict(ts="2024-01-01T00:00:00Z", src_ip="FD00:0::1", dst_ip="10.0.0.2", src_port="1", dst_port="0",
                protocol=" tcp ", session_id="12345678-1234-1234-1234-1234567890ab")
    bad = dict(ts="2024-01-01T00:00:00Z", src_ip="10.0.0.300", dst_ip="", src_port="65536", dst_port="x",
               protocol=" ", packets="0", http_status="99", session_id="nope")
    raw = spark.createDataFrame([good, bad], schema="ts string, src_ip string, dst_ip string, src_port string, "
                                "dst_port string, protocol string, packets string, http_status string, session_id string")
    checked = events.check_events(raw)
    typed = events.valid_events(checked).collect()
    assert [(e.src_ip, e.protocol, e.packets, e.bytes, e.dst_port) for e in typed] == [("fd00::1", "TCP", 1, 0, 0)]
    assert events.rejected_events(checked).collect()[0].rejected_for == [
        "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packets", "http_status", "session_id",
    ]


def test_bad_stamps_and_sizes_are_rejected_and_missing_ones_filled(spark):
    base = dict(src_ip="10.0.0.1", dst_ip="10.0.0.2", src_port="1", dst_port="2", protocol="tcp")
    rows = [dict(base, ts="yesterday"), dict(base, bytes="many"), dict(base), dict(base, ts="2024-01-01T00:00:00Z", bytes="7")]
    raw = spark.createDataFrame(rows, "ts string, src_ip string, dst_ip string, src_port string, dst_port string, "
                                "protocol string, bytes string")
    checked = events.check_events(raw)
    assert sorted(r.rejected_for for r in events.rejected_events(checked).collect()) == [["bytes"], ["ts"]]
    typed = events.valid_events(checked, F.timestamp_seconds(F.lit(5))).orderBy("ts").collect()
    assert [(e.ts.year, e.bytes, e.session_id) for e in typed] == [(1970, 0, "none"), (2024, 7, "none")]


def test_labels(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text(
        "pcap_file: a.pcap\nattack_present: true\nattack_types:\n  - port_scan\nsource_ips: [10.0.0.5]\nextra: 1\n"
    )
    (tmp_path / "b.yaml").write_text("- just\n- a list\n")
    rows = labels.read_labels(spark, str(tmp_path)).collect()
    assert [(r.capture_id, r.attack_present, r.attack_types, r.source_ips, r.unknown_keys) for r in rows] == [
        ("a", True, ["port_scan"], ["10.0.0.5"], ["extra"]),
    ]


def test_a_packet_is_parsed_once(spark):
    texts = spark.createDataFrame([("a", json.dumps(p)) for p in CAPTURE] + [("a", "junk"), ("a", "{}")], "capture_id string, value string")
    rows = dissected.packets_from_text(texts)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and rows.count() == len(CAPTURE)
