"""Scalar functions over versions and loosely typed JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = r"(>=|<=|>|<|=)?\s*v?([0-9]+(?:\.[0-9]+)*)"


def _numbers(version: Column) -> Column:
    return F.transform(F.split(version, r"\."), lambda x: x.cast("long"))


def _padded(numbers: Column, length: Column) -> Column:
    return F.concat(numbers, F.array_repeat(F.lit(0).cast("long"), F.greatest(length - F.size(numbers), F.lit(0))))


def satisfies(version: Column, constraint: Column) -> Column:
    """Whether a dotted version meets all comparators of a constraint; = compares only the components that it gives.

    An empty or null constraint holds; a null version or one that is no version meets none; a constraint without
    a comparator that can be read isn't met.
    """
    have = _numbers(F.regexp_extract(version, r"^\s*v?([0-9]+(?:\.[0-9]+)*)", 1))
    parts = F.transform(F.regexp_extract_all(constraint, F.lit(_PART), F.lit(0)), lambda p: F.struct(F.regexp_extract(p, _PART, 1).alias("op"), _numbers(F.regexp_extract(p, _PART, 2)).alias("n")))

    def holds(p: Column) -> Column:
        size = F.greatest(F.size(have), F.size(p["n"]))
        a, b = _padded(have, size), _padded(p["n"], size)
        same = F.slice(a, 1, F.size(p["n"])) == p["n"]
        return F.when(p["op"] == ">=", a >= b).when(p["op"] == "<=", a <= b).when(p["op"] == ">", a > b).when(p["op"] == "<", a < b).otherwise(same)

    read = F.coalesce(version.rlike(r"^\s*v?[0-9]"), F.lit(False))
    return F.when(F.coalesce(F.trim(constraint), F.lit("")) == "", True).otherwise(read & (F.size(parts) > 0) & F.forall(parts, holds))


def string_map(json: Column) -> Column:
    """A JSON object as a map of strings: numbers, booleans and arrays become their text, nulls and blanks go; null if it is no object."""
    got = F.from_json(json, "map<string,string>")
    return F.map_filter(got, lambda k, v: F.coalesce(F.trim(v), F.lit("")) != "")


def rewrite_queries(answer: Column, most: int = 8) -> Column:
    """Distinct queries of a JSON answer {"queries": [...]}, fenced or not, in order; malformed answers give an empty array."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")
    got = F.transform(F.coalesce(F.from_json(bare, "queries array<string>")["queries"], F.array().cast("array<string>")), lambda q: F.trim(q))
    return F.slice(F.array_distinct(F.filter(got, lambda q: F.coalesce(q, F.lit("")) != "")), 1, most)
