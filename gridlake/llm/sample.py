"""A bounded sample of texts, the same for the same rows: by hash, so that no task sends more than its share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BUCKETS = 1 << 40


def sampled_texts(df: DataFrame, column: str, about: int) -> list[str]:
    """About so many distinct texts of a column, all of them where there are fewer: those whose hash is under a threshold that the
    number of rows gives. Copies are in the sample together, and then once."""
    rows = df.select(F.col(column).alias("text"))
    n = rows.count()
    if not n:
        return []
    limit = int(min(1.0, about / n) * _BUCKETS)
    h = F.xxhash64("text")
    picked = rows.where(F.pmod(h, F.lit(_BUCKETS)) < limit).groupBy(h.alias("h")).agg(F.min("text").alias("text"))
    return [r["text"] for r in picked.orderBy("h").collect()]  # about so many rows: a share of about / n of all hashes
