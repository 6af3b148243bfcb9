"""TCP flag predicates for hex bit fields and for flag names in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# TCP header flag bits.
SYN_BIT = 0x002
RST_BIT = 0x004
ACK_BIT = 0x010

_ANY_LENGTH = 2**31 - 1


def hex_flag_bits(flags: Column) -> Column:
    """Hex text such as ``0x012`` as a number; NULL when absent or malformed.

    Of longer texts it is the low 60 bits, where all flags are. The usual shape, ``0x`` and hex digits, needs no pattern.
    """
    usual = F.substring(flags, 3, _ANY_LENGTH)
    is_usual = F.startswith(flags, F.lit("0x")) & (F.length(flags) > 2) & F.unhex(usual).isNotNull()
    digits = F.regexp_extract(flags, r"^\s*(?:0[xX])?([0-9a-fA-F]+)\s*$", 1)

    def number(text: Column) -> Column:
        return F.conv(F.right(text, F.lit(15)), 16, 10).try_cast("bigint")

    return F.when(is_usual, number(usual)).when(digits != "", number(digits))


def bit_set(bits: Column, bit: int) -> Column:
    """1 when the bit is set, else 0 (also for NULL)."""
    return F.coalesce((bits.bitwiseAND(F.lit(bit)) != 0).cast("int"), F.lit(0))


def text_has_flag(flags: Column, name: str) -> Column:
    """1 when the flag name occurs in the text, ignoring case, else 0."""
    return F.coalesce(F.contains(F.upper(flags), F.lit(name)).cast("int"), F.lit(0))
