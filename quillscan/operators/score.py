"""The eight-dimension health score of a unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.functions import paths
from quillscan.functions.text import grade, round_half_up

# Folders of layers, patterns of paths, weights of the dimensions.
LAYERS = "controllers services models domain repository views api core src".split()
NOT_README = r"(?i)(^|/)(\.pytest_cache|\.mypy_cache|\.ruff_cache|node_modules|dist|build|coverage|htmlcov|fixtures?|tests?|test-data|__pycache__)/"
CI = r"(?i)\.github/workflows|\.gitlab-ci\.yml|jenkinsfile|azure-pipelines|circle\.yml|\.travis\.yml"
LINT = r"(?i)eslint|ruff|golangci|\.prettierrc|biome|flake8|\.pylintrc|tsconfig\.json"
LOCK = r"(?i)package-lock\.json|pnpm-lock\.yaml|yarn\.lock|poetry\.lock|cargo\.lock|go\.sum|gemfile\.lock|pipfile\.lock"
WEIGHTS = {"security": 0.15, "architecture": 0.20, "code_quality": 0.25, "testing": 0.15, "documentation": 0.10, "performance": 0.05, "developer_experience": 0.05, "scalability": 0.05}


def _clamp(x: Column, low: int, high: int = 95) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def file_facts(files: DataFrame) -> DataFrame:
    """One row per unit of all counts that the score takes from the files."""
    p = F.col("path")
    any_ = lambda rx: F.bool_or(p.rlike(rx))
    count = lambda cond: F.count_if(cond)
    segments = F.split(p, "/")
    readme = p.rlike(r"(?i)readme") & ~p.rlike(NOT_README)
    manifest = paths.base_name(p).isin(*paths.MANIFESTS)
    return files.groupBy("unit").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), count(F.col("is_test")).alias("tests"), count(F.col("ext").isin(*paths.CODE_EXTENSIONS)).alias("sources"),
        sum((F.max(F.array_contains(segments, x).cast("int")) for x in LAYERS), F.lit(0)).alias("layers"),
        (any_(r"(^|/)(packages|apps|services|modules)/").cast("int") + (any_(r"(^|/)services/[^/]+/[^/]+") & (count(p.rlike(r"(^|/)services/")) >= 2)).cast("int") + any_(r"(^|/)(ports|adapters|application|infrastructure)/").cast("int")
         + any_(r"(^|/)(event|events|consumers?|producers?|queues?|streams?)/").cast("int") + any_(r"(^|/)(controllers?|routes?|views?|templates?)/").cast("int")).alias("signals"),
        F.max(F.size(segments)).alias("depth"), count(manifest).alias("manifests"), F.coalesce(F.bool_or("framework"), F.lit(False)).alias("framework"),
        F.sum("assertions").alias("assertions"),
        F.max(F.when(readme, F.struct(F.coalesce("length", F.lit(0)).alias("length"), (-F.col("ordinal")).alias("back"), F.coalesce("n_lines", F.lit(1)).alias("lines"), F.coalesce("headings", F.lit(0)).alias("headings"), F.coalesce("fences", F.lit(0.0)).alias("fences")))).alias("readme"),
        any_(r"(?i)(^|/)(docs|doc|documentation)/").alias("docs"), any_(CI).alias("ci"), any_(LINT).alias("lint"), any_(LOCK).alias("lock"),
    )


def finding_facts(found: DataFrame) -> DataFrame:
    cat, sev, p = F.col("category"), F.col("severity"), F.col("path")
    loss = lambda c, s, hard, soft: F.sum(F.when(cat == c, F.when(sev == s, hard).otherwise(soft)).otherwise(0))
    files = lambda *cs: F.count_distinct(F.when(cat.isin(*cs), p))
    return found.groupBy("unit").agg(
        (loss("hardcoded_secret", "critical", 25, 12) + loss("command_injection", "high", 15, 7) + loss("weak_crypto", "medium", 8, 3)).alias("exposed"),
        F.bool_or((cat == "hardcoded_secret") & (sev == "critical")).alias("leaked"), files("circular_dependency").alias("cyclic"), F.count_if(cat == "god_class").alias("gods"), files("tight_coupling").alias("coupled"),
        files("large_file", "long_function", "todo_debt", "high_complexity", "deep_nesting", "empty_handler").alias("troubled"), F.count_if(cat == "large_file").alias("large"), F.count_if((cat == "large_file") & F.contains(F.col("message"), F.lit("1000"))).alias("huge"),
    )


def health(files: DataFrame, found: DataFrame) -> DataFrame:
    """One row per unit: eight dimensions, ``overall`` and ``grade``; units without files have none."""
    f = file_facts(files).join(finding_facts(found), "unit", "left").na.fill(0, ["exposed", "cyclic", "gods", "coupled", "troubled", "large", "huge", "assertions"]).na.fill(False, ["leaked"])
    c = F.col
    ratio = c("troubled") / c("files")
    tests = F.when(c("sources") > 0, c("tests") / c("sources")).otherwise(0.0)
    dense = F.when(c("tests") > 0, c("assertions") / c("tests"))
    testing = F.when((tests == 0) & (c("tests") == 0), 30).when(tests < 0.02, 45).when(tests < 0.05, 65).when(tests < 0.10, 80).otherwise(90)
    testing = _clamp(testing + F.when(c("framework"), 5).otherwise(0).cast("double"), 25)
    layered = c("layers") >= 2
    lines, size = c("readme.lines"), c("bytes") / c("files")
    scores = f.select(
        "unit", "files", "sources", "leaked",
        _clamp(90.0 - c("exposed"), 20).alias("security"),
        _clamp(80.0 - F.least(F.lit(30), c("cyclic") * 10) - F.least(F.lit(24), c("gods") * 8) - F.least(F.lit(16), c("coupled") * 4) + F.when(layered, 6).otherwise(0) + F.least(F.lit(6), c("signals") * 3) + F.when(c("depth").between(2, 5), 4).otherwise(0), 20).alias("architecture"),
        _clamp(92.0 - F.when(ratio < 0.01, 0.0).otherwise(F.least(F.lit(45.0), round_half_up(ratio * 150))) - F.least(F.lit(15.0), c("huge") * 1.5), 25).alias("code_quality"),
        _clamp(testing - F.when(dense < 0.5, 25).when(dense < 2, 10).otherwise(0), 25).alias("testing"),
        _clamp(F.when(c("readme").isNull(), 35.0).otherwise(F.when(lines >= 200, 68.0).otherwise(60.0) + F.when(c("docs"), 8).otherwise(0) + F.when(c("readme.headings") >= 5, 5).otherwise(0) + F.when(c("readme.fences") >= 3, 4).otherwise(0)), 25).alias("documentation"),
        _clamp(F.when(size < 5000, 90.0).when(size < 20000, 78.0).when(size < 60000, 65.0).otherwise(50.0) - F.when(c("large") > c("files") * 0.05, 10).otherwise(0), 25).alias("performance"),
        _clamp(55.0 + F.when(c("manifests") > 0, 15).otherwise(0) + F.when(c("ci"), 15).otherwise(0) + F.when(c("lint"), 8).otherwise(0) + F.when(c("lock"), 7).otherwise(0), 25).alias("developer_experience"),
        _clamp(75.0 - F.when(c("coupled") / c("files") > 0.02, 12).otherwise(0) - F.when(c("gods") > 0, 10).otherwise(0) + F.when(layered, 8).otherwise(0), 25).alias("scalability"),
    )
    total = sum((c(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)) - F.when(c("leaked"), 15).otherwise(0)
    overall = F.when(c("sources") == 0, F.least(F.lit(40.0), c("documentation"))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)))
    return scores.withColumn("overall", round_half_up(overall, 1)).withColumn("grade", grade(c("overall"))).drop("files", "sources", "leaked")
