"""Views of results: filters, orders, buckets and chains as parameters of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANKS = ["info", "low", "medium", "high", "critical"]


def severity_rank(severity: Column) -> Column:
    """4 for critical down to 0 for info and anything else; case and outer spaces ignored."""
    return F.greatest(F.array_position(F.array(*map(F.lit, RANKS)), F.lower(F.trim(severity))) - 1, F.lit(0))


def matching(df: DataFrame, text: str = "", fields: tuple[str, ...] = (), **equal: str | None) -> DataFrame:
    """Rows that hold ``text`` in one of ``fields`` joined by spaces, in any case, and have the given values.

    An empty text holds everywhere; a value of None asks for rows without one.
    """
    if text:
        df = df.where(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(text.lower())))
    for column, value in equal.items():
        df = df.where(F.col(column).isNull() if value is None else F.col(column) == value)
    return df


def ordered(df: DataFrame, by: str, descending: bool = True, tie: str = "ev_seq") -> DataFrame:
    """``df`` with ``row_no`` in the chosen order: severities by rank, the rest by value, nulls last, ties by ``tie``."""
    key = severity_rank(F.col(by)) if by == "severity" else F.col(by)
    return df.withColumn("row_no", F.row_number().over(Window.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), tie)))


def severity_buckets(found: DataFrame) -> DataFrame:
    """``place, severity, n`` from critical to info, without severities that no finding has."""
    level = F.lower(F.trim("severity"))
    return found.where(level.isin(*RANKS)).groupBy(level.alias("severity")).agg((F.lit(4) - F.max(severity_rank(F.col("severity")))).cast("int").alias("place"), F.count(F.lit(1)).alias("n"))


def busiest_files(found: DataFrame, most: int = 5, path: str = "path") -> DataFrame:
    """The files with most findings; ties by path."""
    return found.where(F.col(path).isNotNull()).groupBy(path).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), path).limit(most)


def chain(causes: DataFrame, capped: DataFrame, nodes: DataFrame, claims: DataFrame, unit: str = "unit") -> DataFrame:
    """From each cause to its findings, their analyzers and files, the graph's nodes of those and its claim."""
    keys = [unit, "category"]
    held = capped.groupBy(*keys).agg(F.count(F.lit(1)).alias("evidence"), F.count_distinct("analyzer").alias("analyzers"), F.count_distinct("path").alias("files"))
    drawn = capped.join(nodes.where("node_type = 'evidence'").select(unit, F.col("node_id").alias("id")), [unit, "id"], "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("nodes"))
    out = causes.select(*keys, "rank_no").join(held, keys, "left").join(drawn, keys, "left").join(claims.select(*keys, "status"), keys, "left")
    return out.na.fill(0, ["evidence", "analyzers", "files", "nodes"])
