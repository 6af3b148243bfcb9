"""DNS name and URL helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shape of an encoded payload, and URL schemes with path parameters.
BASE64_ALPHABET = r"^[A-Za-z0-9+/=]+$"
BASE64_MIN_LENGTH = 12
PARAM_SCHEMES = (
    "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtspu", "sip", "sips",
    "mms", "sftp", "tel",
)


def _labels(qname: Column) -> Column:
    return F.split(F.regexp_replace(qname, r"\.+$", ""), r"\.")


def registered_domain(qname: Column) -> Column:
    """Last two labels of a name, trailing dots ignored."""
    labels = _labels(qname)
    return F.array_join(F.when(F.size(labels) > 2, F.slice(labels, -2, 2)).otherwise(labels), ".")


def _leading_labels(qname: Column) -> Column:
    labels = _labels(qname)
    return F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0)))


def subdomain(qname: Column) -> Column:
    """Everything before the registered domain, or the empty string."""
    return F.array_join(_leading_labels(qname), ".")


# The letters and each share are bound once by a lambda instead of being recomputed per letter.
_ENTROPY = """t -> transform(array(filter(split(t, ''), c -> c <> '')), letters ->
  CASE WHEN size(letters) = 0 THEN 0D ELSE
    -- adding 0 turns the -0.0 of a one-letter alphabet into 0.0
    round(-aggregate(array_distinct(letters), 0D, (total, c) -> total + transform(
      array(size(filter(letters, x -> x = c)) / size(letters)), p -> p * log2(p))[0]), 4) + 0D
  END)[0]"""


def shannon_entropy(text: Column) -> Column:
    """Bits per character, four decimals; 0 for the empty string."""
    return F.get(F.call_function("transform", F.array(text), F.expr(_ENTROPY)), F.lit(0))


def subdomain_entropy(qname: Column) -> Column:
    """Entropy of the subdomain labels joined without dots."""
    return shannon_entropy(F.array_join(_leading_labels(qname), ""))


def looks_base64(text: Column) -> Column:
    """Long enough, only base64 characters, and upper, lower and digit all present."""
    return (
        (F.length(text) >= BASE64_MIN_LENGTH)
        & text.rlike(BASE64_ALPHABET)
        & text.rlike("[A-Z]")
        & text.rlike("[a-z]")
        & text.rlike("[0-9]")
    )


def url_path(uri: Column) -> Column:
    """Path of an absolute or relative URL; ``/`` when the path is empty."""
    clean = F.regexp_replace(F.regexp_replace(uri, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(clean, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    path = F.regexp_extract(
        clean, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1
    )
    has_params = (scheme == "") | scheme.isin(*PARAM_SCHEMES)
    path = F.when(has_params, F.regexp_replace(path, r";[^/]*$", "")).otherwise(path)
    return F.when(path == "", F.lit("/")).otherwise(path)
