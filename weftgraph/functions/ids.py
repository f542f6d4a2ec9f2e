"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix:HEX32 of the parts joined by U+001F; a null part is empty."""
    return F.concat(F.lit(prefix + ":"), F.upper(F.left(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), F.lit(32))))


def edge_id(type_: Column, src: Column, dst: Column) -> Column:
    return F.sha2(F.concat_ws("|", type_, src, dst), 256)


def community_id(members: Column) -> Column:
    """Of an array of member ids, in any order."""
    return F.concat(F.lit("community:"), F.left(F.sha2(F.array_join(F.array_sort(members), "\n"), 256), F.lit(24)))
