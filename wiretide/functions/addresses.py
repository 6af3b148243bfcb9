"""IP address predicates and normalisation as Column expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H = r"[0-9A-Fa-f]{1,4}"

# Special-purpose address blocks (IANA registries) that count as
# not publicly routable, and the globally routable exceptions inside them.
PRIVATE_V4 = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
)
PUBLIC_V4 = ("192.0.0.9/32", "192.0.0.10/32")
PRIVATE_V6 = (
    "::1/128",
    "::/128",
    "64:ff9b:1::/48",
    "100::/64",
    "2001::/23",
    "2001:db8::/32",
    "fc00::/7",
    "fe80::/10",
)
PUBLIC_V6 = (
    "2001:1::1/128",
    "2001:1::2/128",
    "2001:3::/32",
    "2001:4:112::/48",
    "2001:20::/28",
    "2001:30::/28",
)
MAPPED_V4_PREFIX = "00000000000000000000ffff"


def _v6_pattern() -> str:
    """All spellings of an IPv6 address: full, compressed, IPv4 tail, scope id."""
    shapes = [rf"(?:{_H}:){{7}}{_H}", rf"(?:{_H}:){{6}}{_V4}"]
    for head in range(0, 8):
        lead = rf"{_H}(?::{_H}){{{head - 1}}}" if head else ""
        rest = 7 - head
        tail = rf"(?:{_H}(?::{_H}){{0,{rest - 1}}})?" if rest else ""
        shapes.append(rf"{lead}::{tail}")
        if head <= 5:
            inner = rf"(?:{_H}:){{0,{5 - head}}}" if head < 5 else ""
            shapes.append(rf"{lead}::{inner}{_V4}")
    return r"(?:" + "|".join(shapes) + r")(?:%[^%\s]+)?"


IPV4_REGEX = rf"^{_V4}$"
IPV6_REGEX = rf"^{_v6_pattern()}$"


# Lambdas are written as SQL text: one parsed text plans much faster than hundreds of Column calls,
# and the lambda variable keeps a value from being repeated all over the plan.
_QUAD = rf"regexp_extract(ip, r'({_V4})(?:%.*)?$', 1)"
_OCTETS_HEX = ", ".join(
    f"lpad(lower(hex(CAST(o[{i}] AS INT))), 2, '0')" + (", ':'" if i == 1 else "")
    for i in range(4)
)
_QUAD_HEX = rf"transform(array(split({_QUAD}, r'\.')), o -> concat({_OCTETS_HEX}))[0]"
_PLAIN = "lower(regexp_replace(ip, '%.*$', ''))"
_GROUPS = rf"""ip -> transform(array(
  CASE WHEN {_QUAD} <> '' THEN concat(regexp_replace({_PLAIN}, r'{_V4}$', ''), {_QUAD_HEX})
  ELSE {_PLAIN} END),
 p -> transform(array(struct(
   filter(split(substring_index(p, '::', 1), ':'), g -> g <> '') AS head,
   CASE WHEN contains(p, '::') THEN filter(split(substring_index(p, '::', -1), ':'), g -> g <> '')
     ELSE CAST(array() AS ARRAY<STRING>) END AS tail)),
  s -> transform(concat(s.head, array_repeat('0', greatest(8 - size(s.head) - size(s.tail), 0)),
    s.tail), g -> lpad(g, 4, '0')))[0])[0]"""


def _apply(value: Column, function: str) -> Column:
    """A SQL lambda applied to one value."""
    return F.get(F.call_function("transform", F.array(value), F.expr(function)), F.lit(0))


def is_valid_ip(ip: Column) -> Column:
    """True for a syntactically valid IPv4 or IPv6 address, never NULL."""
    return F.coalesce(ip.rlike(IPV4_REGEX) | ip.rlike(IPV6_REGEX), F.lit(False))


def _squeeze() -> str:
    """Replace the first longest run of two or more zero groups by ``::``."""
    squeezed = "t"
    for run in range(2, 9):
        pattern = f"r'^(.*?)(?:^|:)0(?::0){{{run - 1}}}(?::|$)(.*)$'"
        squeezed = (
            f"CASE WHEN t RLIKE {pattern} THEN regexp_replace(t, {pattern}, '$1::$2') "
            f"ELSE {squeezed} END"
        )
    return f"t -> {squeezed}"


_UNPADDED = "g -> array_join(transform(g, x -> regexp_replace(x, '^0{1,3}', '')), ':')"


def canonical_ip(ip: Column) -> Column:
    """RFC 5952 text: IPv6 lower-cased, unpadded, longest zero run as ``::``.

    IPv4 text passes through. The value decides flow identity, so two spellings
    of one address must not open two flows.
    """
    text = _apply(_apply(_apply(ip, _GROUPS), _UNPADDED), _squeeze())
    scope = F.regexp_extract(ip, "(%.*)$", 1)
    return F.when(F.contains(ip, F.lit(":")), F.concat(text, scope)).otherwise(ip)


def _v4_within(number: str, blocks: tuple[str, ...]) -> str:
    nets = [ipaddress.IPv4Network(b) for b in blocks]
    return " OR ".join(f"{number} BETWEEN {int(n[0])} AND {int(n[-1])}" for n in nets)


def _v6_within(hex32: str, blocks: tuple[str, ...]) -> str:
    nets = [ipaddress.IPv6Network(b) for b in blocks]
    return " OR ".join(f"{hex32} BETWEEN '{int(n[0]):032x}' AND '{int(n[-1]):032x}'" for n in nets)


_V4_PRIVATE = f"n -> ({_v4_within('n', PRIVATE_V4)}) AND NOT ({_v4_within('n', PUBLIC_V4)})"
_V4_NUMBER = (
    r"q -> aggregate(split(q, r'\.'), 0L, (n, octet) -> n * 256 + CAST(octet AS BIGINT))"
)
_V6_PRIVATE = f"""h -> CASE WHEN startswith(h, '{MAPPED_V4_PREFIX}')
  THEN transform(array(CAST(conv(substring(h, 25, 8), 16, 10) AS BIGINT)), {_V4_PRIVATE})[0]
  ELSE ({_v6_within('h', PRIVATE_V6)}) AND NOT ({_v6_within('h', PUBLIC_V6)}) END"""


def is_private_ip(ip: Column) -> Column:
    """True when an address is private, loopback, link-local or reserved."""
    hex32 = _apply(_apply(ip, _GROUPS), "g -> array_join(g, '')")
    return (
        F.when(ip.rlike(IPV4_REGEX), _apply(_apply(ip, _V4_NUMBER), _V4_PRIVATE))
        .when(ip.rlike(IPV6_REGEX), _apply(hex32, _V6_PRIVATE))
        .otherwise(F.lit(False))
    )
