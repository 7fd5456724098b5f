"""Timestamps as texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rfc3339_valid(text: Column) -> Column:
    """Whether a text is a date and time with an offset, all parts in their ranges (an offset
    stays under 24 hours). False for null."""
    form = text.rlike("^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?(Z|[+-]([01]\\d|2[0-3]):[0-5]\\d)$")
    return F.coalesce(form & F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull(), F.lit(False))
