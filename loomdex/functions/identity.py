"""Stable identities and file-name metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.functions.arrays import let
from loomdex.functions.text import stem

# Fixed value: RFC 4122 name space for URLs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def file_id(path: Column) -> Column:
    """UUID version 5 of the path in the URL name space."""

    def layout(h: Column) -> Column:
        variant = F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int") % F.lit(4)
        return F.concat_ws(
            "-",
            F.substr(h, F.lit(1), F.lit(8)),
            F.substr(h, F.lit(9), F.lit(4)),
            F.concat(F.lit("5"), F.substr(h, F.lit(14), F.lit(3))),
            F.concat(F.substr(F.lit("89ab"), variant + F.lit(1), F.lit(1)), F.substr(h, F.lit(18), F.lit(3))),
            F.substr(h, F.lit(21), F.lit(12)),
        )

    return let(F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(path, "UTF-8"))), layout)


def name_date(path: Column) -> Column:
    """First eight digits of the file stem as a date; NULL when they are no valid date."""
    return F.try_to_timestamp(F.regexp_substr(stem(path), F.lit(r"\d{8}")), F.lit("yyyyMMdd")).cast("date")


def name_department(path: Column) -> Column:
    """Text before the first underscore of the file stem; NULL without an underscore."""
    name = stem(path)
    return F.when(F.contains(name, F.lit("_")), F.substring_index(name, "_", 1))
