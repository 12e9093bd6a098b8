"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines_of(text: Column) -> Column:
    return F.split(text, r"\r\n|\r|\n", -1)


def line_number(text: Column, offset: Column) -> Column:
    """The 1-based line of a 0-based offset."""
    return F.size(lines_of(F.substring(text, F.lit(1), offset)))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^[\s ﻿]+|[\s ﻿]+$", "")


def snippet(line: Column, most: int = 300) -> Column:
    s = trimmed(line)
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("…"))).otherwise(s)


def entropy(s: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(s).cast("double")
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.coalesce(F.aggregate(counts, F.lit(0.0), lambda h, p: h - p * F.log2(p)), F.lit(0.0))


def round_half_up(x: Column, digits: int = 0) -> Column:
    f = 10.0**digits
    return F.floor(x * f + 0.5) / f


def hash31(s: Column) -> Column:
    """The 31-multiplier hash kept to 32 bits."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(4294967295)))


def fnv1a(s: Column) -> Column:
    """FNV-1a, 32 bits."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 55, "C").when(score >= 40, "D").otherwise("F")


def signed_hash31(s: Column) -> Column:
    """The 31-multiplier hash as a signed number of 32 bits."""
    h = hash31(s)
    return F.when(h >= 2147483648, h - 4294967296).otherwise(h)
