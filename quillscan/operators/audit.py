"""Comparison of what was expected with what was found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compared(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, category, outcome``: each distinct category of a case is matched, missing or extra; case is ignored."""
    once = lambda df, flag: df.select(*keys, F.lower("category").alias("category")).distinct().withColumn(flag, F.lit(True))
    both = once(expected, "_e").join(once(actual, "_a"), [*keys, "category"], "full")
    return both.select(*keys, "category", F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").otherwise("matched").alias("outcome"))


def precision_recall(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Counts, precision and recall per group.

    With nothing found, precision is 1 if nothing was expected and 0 otherwise; with nothing
    expected, recall is 1.
    """
    n = lambda o: F.count_if(F.col("outcome") == o)
    counts = outcomes.groupBy(*by).agg(n("matched").alias("matched"), n("missing").alias("missing"), n("extra").alias("extra"))
    found, wanted = F.col("matched") + F.col("extra"), F.col("matched") + F.col("missing")
    return counts.withColumn("precision", F.when(found > 0, F.col("matched") / found).when(wanted == 0, 1.0).otherwise(0.0)).withColumn("recall", F.when(wanted > 0, F.col("matched") / wanted).otherwise(1.0))
