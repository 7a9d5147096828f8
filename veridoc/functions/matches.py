"""Matches of a pattern with their offsets, and texts rebuilt with some matches replaced; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def matches(text: Column, pattern: str) -> Column:
    """array<struct<at, found>>: non-overlapping matches from the left, at counts characters from 0; null for a null text.

    The text between matches (split) and the matches themselves (regexp_extract_all) alternate, so offsets are running
    sums of their lengths.  The pattern must not match the empty string.
    """
    hits, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(hits, F.slice(between, 1, F.greatest(F.size(hits), F.lit(0))), lambda h, b: F.struct(h.alias("found"), F.length(b).alias("skipped")))
    kind = "array<struct<at:int,found:string>>"
    begin = F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("list"))

    def step(a: Column, p: Column) -> Column:
        at = a["end"] + p["skipped"]
        return F.struct((at + F.length(p["found"])).alias("end"), F.concat(a["list"], F.array(F.struct(at.alias("at"), p["found"].alias("found")))).alias("list"))

    return F.aggregate(F.filter(pairs, lambda p: p["found"].isNotNull()), begin, step, lambda a: a["list"])


def rebuilt(text: Column, pattern: str, replacements: Column) -> Column:
    """text with its k-th match exchanged for the k-th replacement; a null replacement, or none, leaves the match."""
    hits, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    new = F.zip_with(hits, F.slice(replacements, 1, F.greatest(F.size(hits), F.lit(0))), lambda h, r: F.coalesce(r, h))
    return F.array_join(F.zip_with(between, new, lambda b, h: F.concat(b, F.coalesce(h, F.lit("")))), "")


def whole_number(digits: Column) -> Column:
    """Digits, with a sign or without, as an integer is written."""
    plain = F.regexp_replace(digits, r"^(-?)0+(?=[0-9])", "$1")
    return F.when(plain == "-0", "0").otherwise(plain)
