"""Problem 2: the N highest items of every group, with a hot-cold split.

Exact group counts part the groups. Light groups go to an ordinary window. Heavy groups
are sorted in ranges: the order itself is cut into ranges (severity, confidence band)
and salted by the key within a range, each piece keeps its first N, and the few rows
left are ranked once more. No task ever sorts a whole heavy group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillscan.session import durable

SEVERITIES = ["critical", "high", "medium", "low", "info"]


def same_file(path: Column) -> Column:
    """A path with ``/`` only and without empty, ``.`` and ``..`` segments."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.array_join(F.filter(parts, lambda s: ~s.isin("", ".", "..")), "/")


def severity_rank(severity: Column) -> Column:
    s, rank = F.lower(F.trim(severity)), F.lit(len(SEVERITIES))
    for k, name in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(s == name, k).otherwise(rank)
    return rank


def first_of_deliveries(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the smallest ``order`` of each key; rows with a null in the key stay."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    w = Window.partitionBy(*keys).orderBy(order)
    kept = df.where(whole).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return kept.unionByName(df.where(~whole))


def top_n(df: DataFrame, group: list[str], order: list[Column], bands: list[Column], n: int, heavy_from: int = 20_000, salts: int = 32, key: str = "finding_key") -> DataFrame:
    """The first ``n`` rows of each group as ``rank_no`` 1..n.

    ``order`` must be total (end with a unique key), so ties are broken alike in every
    run. ``bands`` are expressions that rise along the order; they cut a heavy group
    into ranges. A group with ``heavy_from`` rows or more is heavy. Groups with a null
    in the group key are groups of their own. An empty table gives an empty result.
    """
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= heavy_from)
    same = [df[g].eqNullSafe(counts[g]) for g in group]
    light = df.join(counts, same, "left_anti")
    heavy = df.join(counts, same, "left_semi").withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    local = Window.partitionBy(*group, *bands, "_salt").orderBy(*order)
    heavy = heavy.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= n).drop("_r", "_salt")
    final = Window.partitionBy(*group).orderBy(*order)
    ranked = [d.withColumn("rank_no", F.row_number().over(final)).where(F.col("rank_no") <= n) for d in (light, heavy)]
    return ranked[0].unionByName(ranked[1])


def top_findings(findings: DataFrame, n: int = 3, heavy_from: int = 20_000) -> DataFrame:
    """``finding_key, rank_no`` of the first ``n`` findings of each repo and file.

    Null paths belong to no file; an unknown severity counts as null; null severity and
    null confidence come last; NaN confidence counts as null.
    """
    f = findings.select("finding_key", "scan_id", "repo", "id", "severity", "confidence", "file_path")
    f = first_of_deliveries(f, ["repo", "scan_id", "id"], "finding_key").where(F.col("file_path").isNotNull())
    f = f.select("finding_key", "repo", same_file(F.col("file_path")).alias("file"), severity_rank(F.col("severity")).alias("sev"), F.nanvl("confidence", F.lit(None).cast("double")).alias("conf"))
    f = durable(f)  # counted, then read by the light and the heavy side
    order = [F.col("sev"), F.col("conf").desc_nulls_last(), F.col("finding_key")]
    bands = [F.col("sev"), F.floor(F.coalesce("conf", F.lit(-1.0)) * 10)]
    return top_n(f, ["repo", "file"], order, bands, n, heavy_from).select("finding_key", F.col("rank_no").cast("bigint").alias("rank_no"))
