"""Metadata filters on candidates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_date(value: object) -> Column:
    if isinstance(value, dt.datetime):
        value = value.date()
    return F.lit(str(value)).cast("date")


def metadata_filter(filters: Mapping[str, object] | None, *, ignore_case: bool = False) -> Column:
    """AND of the known keys (department, date_gte, date_lte); unknown keys are ignored.

    A row without a date fails ``date_gte`` and passes ``date_lte``.
    """
    tests: list[Column] = []
    for key, value in (filters or {}).items():
        if key == "department":
            have, want = F.coalesce(F.col("department"), F.lit("")), F.lit(str(value))
            tests.append(F.lower(have) == F.lower(want) if ignore_case else have == want)
        elif key == "date_gte":
            tests.append(F.coalesce(F.col("date") >= _as_date(value), F.lit(False)))
        elif key == "date_lte":
            tests.append(F.coalesce(F.col("date") <= _as_date(value), F.lit(True)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))
