"""Tolerant coercion of dissector values, which arrive as text or JSON lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiretide.functions.addresses import canonical_ip, is_valid_ip


def as_list(value: Column) -> Column:
    """Array view of a value that is either a scalar or a JSON list; NULL stays NULL."""
    return F.when(
        F.startswith(F.ltrim(value), F.lit("[")), F.from_json(value, "array<string>")
    ).when(value.isNotNull(), F.array(value))


def first_value(value: Column) -> Column:
    """The value itself, or the first element of a JSON list."""
    return F.get(as_list(value), F.lit(0))


def scalar_text(value: Column) -> Column:
    return first_value(value)


def scalar_int(value: Column) -> Column:
    """Whole number or NULL; decimals, junk and what no bigint holds are NULL."""
    # named once: a list is parsed anew wherever it stands in the expression
    return F.regexp_extract(F.trim(first_value(value)), r"^[+-]?[0-9]+$", 0).try_cast("bigint")


def scalar_ip(value: Column) -> Column:
    """Canonical address text, or NULL when it is not an address."""
    return F.when(is_valid_ip(value), canonical_ip(value))
