"""String functions that differ from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_encode(c: Column) -> Column:
    """Percent-encoding of everything but letters, digits and ``-._~``; a space becomes %20, not +."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")
