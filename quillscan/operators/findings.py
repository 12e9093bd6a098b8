"""Union, order, validation and cap of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillscan.functions.text import round_half_up
from quillscan.operators import detectors, graph

POOL = 3000
PER_FILE = 5
KEPT = 300


def weight(severity: Column) -> Column:
    return F.when(severity == "critical", 3).when(severity == "high", 2).when(severity == "medium", 1).otherwise(0)


def categories(spark: SparkSession) -> DataFrame:
    """The constant table of categories: analyzer, type, first confidence, tags and place in the order."""
    rows = [(c, *k, detectors.TAGS[c], detectors.RANK[c], 1 if c == "missing_tests" else 2 if c in ("god_class", "tight_coupling", "circular_dependency") else 0) for c, k in detectors.KINDS.items()]
    return spark.createDataFrame(rows, "category string, analyzer string, finding_type string, confidence double, tags array<string>, rank int, phase int")


def untested(files: DataFrame) -> DataFrame:
    """Units of more than five files without a test file, with their first file."""
    each = files.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.bool_or("is_test").alias("tested"), F.min("ordinal").alias("ordinal"), F.min_by("path", "ordinal").alias("path"), F.min_by("first_line", "ordinal").alias("first_line"))
    return each.where("n > 5 and not tested")


def all_findings(files: DataFrame, local: DataFrame, edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """Findings of all detectors with ``ev_seq``, the order in which they count.

    Only the first ``POOL`` of a unit are kept, so its ranking never holds more.
    """
    none = lambda kind: F.lit(None).cast(kind)
    tests = untested(files)
    row = lambda df, category, severity, message, metric, value: df.select("unit", "ordinal", "path", F.lit(category).alias("category"), F.lit(severity).alias("severity"), none("int").alias("line"), message.alias("message"), F.nullif(F.substring(F.regexp_replace(F.col("first_line"), r"^\s+|\s+$", ""), 1, 300), F.lit("")).alias("snippet"), F.lit(metric).alias("metric_name"), value.alias("metric_value"), F.lit(0).alias("place"))
    code = files.where("readable").where(F.col("ext").isin(*detectors.paths.CODE_EXTENSIONS)).select("unit", "path", "ordinal", "first_line")
    coupled = graph.coupling(edges).join(code, ["unit", "path"])
    cyclic = cycles.join(code, ["unit", "path"])
    found = local.unionByName(row(tests, "missing_tests", "high", F.lit("no tests"), "test_files", F.lit(0.0)))
    found = found.unionByName(row(coupled, "tight_coupling", "medium", F.concat(F.col("imports").cast("string"), F.lit(" imports")), "imports", F.col("imports").cast("double")))
    found = found.unionByName(row(cyclic, "circular_dependency", "high", F.lit("import cycle"), None, none("double")))
    found = found.join(F.broadcast(categories(files.sparkSession)), "category")
    order = Window.partitionBy("unit").orderBy("phase", "ordinal", "path", "rank", "place")
    found = found.withColumn("ev_seq", F.row_number().over(order)).where(F.col("ev_seq") <= POOL)
    return found.select("unit", "ev_seq", F.concat(F.lit("local-ev-"), F.col("ev_seq").cast("string")).alias("id"), "analyzer", "finding_type", "severity", "category", "path", "line", "message", "snippet", "tags", "metric_name", "metric_value", "confidence")


def validated(found: DataFrame) -> DataFrame:
    """Status and calibrated confidence of each finding.

    A detector that finds again what it found is a second witness; a secret needs an
    entropy of 3.5 bits to be more than partly confirmed.
    """
    v, c, base = F.col("metric_value"), F.col("category"), F.col("confidence")
    status = F.when(c == "hardcoded_secret", F.when(v >= 3.5, "verified").otherwise("partial")).otherwise("verified")
    step = lambda a, high, b, mid, low: F.when(v > a, high).when(v > b, mid).otherwise(low)
    sure = (
        F.when(c == "large_file", step(2000, 0.9, 1000, 0.85, 0.7))
        .when(c == "long_function", step(150, 0.8, 80, 0.7, 0.6))
        .when(c == "high_complexity", step(80, 0.9, 40, 0.8, 0.7))
        .when(c == "deep_nesting", step(10, 0.9, 8, 0.8, 0.65))
        .when(c == "magic_number", F.when(v >= 1000, 0.5).otherwise(0.4))
        .when(c == "hardcoded_secret", 0.95)
        .when(c.isin("command_injection", "empty_handler"), 0.8)
        .when(c == "weak_crypto", 0.7)
        .when(c == "todo_debt", 0.75)
        .otherwise(F.greatest(base, F.lit(0.8)))
    )
    witness = F.when(c == "hardcoded_secret", F.when(v.isNotNull(), "entropy-validator")).when(c.isin("command_injection", "weak_crypto", "magic_number"), "context-validator").when(c == "empty_handler", "brace-validator").when(c.isin("high_complexity", "long_function"), "metric-validator")
    out = found.withColumn("validation_status", status)
    calibrated = F.when(F.col("validation_status") == "verified", sure).when(F.col("validation_status") == "partial", round_half_up(F.least(base, F.lit(0.65)), 2)).otherwise(round_half_up(F.least(base, F.lit(0.5)), 2))
    return out.withColumn("confidence", calibrated).withColumn("validated_by", F.array_compact(F.array(F.col("analyzer"), witness)))


def capped(found: DataFrame, unit: str = "unit", path: str = "path", seq: str = "ev_seq", per_file: int = PER_FILE, kept: int = KEPT) -> DataFrame:
    """At most ``per_file`` per file and category, then the ``kept`` heaviest of a unit; ties by ``seq``."""
    each = Window.partitionBy(unit, path, "category").orderBy(seq)
    top = Window.partitionBy(unit).orderBy(weight(F.col("severity")).desc(), seq)
    few = found.withColumn("_n", F.row_number().over(each)).where(F.col("_n") <= per_file).drop("_n")
    return few.withColumn("kept_rank", F.row_number().over(top)).where(F.col("kept_rank") <= kept)
