import ipaddress
import math
from collections import Counter
from datetime import timedelta
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from wiretide import functions as X

ADDRESSES = [
    "0.0.0.1", "10.0.0.1", "9.255.255.255", "11.0.0.0", "127.0.0.1", "169.254.9.9", "172.15.255.255",
    "172.16.0.0", "172.31.255.255", "172.32.0.0", "192.0.0.8", "192.0.0.9", "192.0.0.10", "192.0.0.11",
    "192.0.2.1", "192.168.1.1", "198.17.255.255", "198.18.0.1", "198.19.255.255", "198.51.100.7",
    "203.0.113.9", "100.64.0.1", "8.8.8.8", "224.0.0.1", "240.0.0.1", "255.255.255.255",
    "::", "::1", "::2", "fc00::1", "fdff::1", "fe80::1", "fec0::1", "2001:db8::5", "2001:db9::5",
    "2001:4860:4860::8888", "100::1", "64:ff9b:1::1", "64:ff9b::1", "2001::1", "2001:1::1", "2001:20::1",
    "::ffff:10.0.0.1", "::ffff:8.8.8.8", "2001:DB8:0:0:1:0:0:1", "2001:0db8:0000:0000:0000:0000:0000:0001",
    "1:0:0:2:0:0:0:3", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "0:0:0:0:0:0:0:0", "1:0:3:4:5:6:7:8",
]
BROKEN = ["", "10.0.0", "10.0.0.256", "01.2.3.4", "1.2.3.4.5", ":::", "1::2::3", "12345::", "g::1", "server",
          "1:2:3:4:5:6:7:8:9", "::1.2.3.256"]


def evaluate(spark, values, *columns):
    table = spark.createDataFrame([(v,) for v in values], "v string")
    return [tuple(r) for r in table.select(*columns).collect()]


def test_addresses_agree_with_the_standard_library(spark):
    v = F.col("v")
    got = evaluate(spark, ADDRESSES, X.is_valid_ip(v), X.is_private_ip(v), X.canonical_ip(v))
    for text, (valid, private, canonical) in zip(ADDRESSES, got):
        address = ipaddress.ip_address(text)
        want = address.is_private or address.is_loopback or address.is_link_local
        assert valid, text
        assert private == want, text
        if "." not in text or ":" not in text:
            assert canonical == str(address), text


def test_broken_addresses_are_invalid(spark):
    got = evaluate(spark, [*BROKEN, None], X.is_valid_ip(F.col("v")), X.is_private_ip(F.col("v")))
    assert got == [(False, False)] * (len(BROKEN) + 1)


NAMES = ["", ".", "com", "example.com", "a.example.com.", "a.b.example.com", "x..y.example.com",
         "QWxhZGRpbjpv9.evil.net", "QWxhZGRpbjpv9.QWxhZGRpbjpv9.evil.net"]


def python_labels(name):
    return name.rstrip(".").split(".")


def test_dns_names(spark):
    v = F.col("v")
    got = evaluate(
        spark, NAMES, X.registered_domain(v), X.subdomain(v), X.subdomain_entropy(v),
        X.looks_base64(X.subdomain(v)),
    )
    for name, (domain, sub, entropy, encoded) in zip(NAMES, got):
        labels = python_labels(name)
        assert domain == (".".join(labels[-2:]) if len(labels) > 2 else name.rstrip("."))
        assert sub == (".".join(labels[:-2]) if len(labels) > 2 else "")
        letters = Counter("".join(labels[:-2]) if len(labels) > 2 else "")
        n = sum(letters.values())
        assert entropy == pytest.approx(
            -sum(c / n * math.log2(c / n) for c in letters.values()) if n else 0.0, abs=1e-4
        )
        assert encoded == (name == "QWxhZGRpbjpv9.evil.net")


def test_url_paths(spark):
    urls = ["/", "/a/b?x=1", "?x=1", "http://h.example/p;v=1/q;z?y#f", "https://h.example", "//h/p", "a/b#c",
            "/a;b/c", "foo:bar", "/x y?z", "http://h?q"]
    got = [r[0] for r in evaluate(spark, urls, X.url_path(F.col("v")))]
    assert got == [urlparse(u).path or "/" for u in urls]


def test_flags_and_coercion(spark):
    v = F.col("v")
    assert evaluate(spark, ["0x012", "12", "zz", "", None], X.hex_flag_bits(v)) == [
        (18,), (18,), (None,), (None,), (None,),
    ]
    got = evaluate(spark, ["7", '["8","9"]', "x", "1.5", None], X.scalar_int(v), X.scalar_text(v))
    assert got == [(7, "7"), (8, "8"), (None, "x"), (None, "1.5"), (None, None)]


def test_scores(spark):
    table = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.009, 0.26, 0.51, 0.76, 0.999, 2.0)], "v double")
    score = X.risk_score(F.col("v"))
    rows = table.select(score, X.severity_name(X.severity_code(score)), X.risk_label(score)).collect()
    assert [r[0] for r in rows] == [0, 0, 0, 26, 51, 76, 99, 100]
    assert [r[1] for r in rows] == [
        "INFORMATIONAL", "INFORMATIONAL", "INFORMATIONAL", "MEDIUM", "HIGH", "CRITICAL", "CRITICAL", "CRITICAL",
    ]
    assert rows[4][2] == "High"


def test_window_strings():
    assert X.parse_window(" 10M ") == timedelta(minutes=10)
    for bad in ("", "5", "m5", "5 m", "5w", "-5m"):
        with pytest.raises(ValueError):
            X.parse_window(bad)
