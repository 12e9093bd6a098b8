"""Sources and sinks: directories, catalogs, reports, run logs and histories."""

from __future__ import annotations

import posixpath
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Endings of binary files.
BINARY = ".png .jpg .jpeg .gif .webp .ico .pdf .zip .gz .tar .exe .dll .so .dylib .woff .woff2 .ttf .eot .mp3 .mp4 .jar".split()
CATALOG = T.StructType([T.StructField("repositories", T.ArrayType(T.StructType([T.StructField(n, T.LongType() if n == "stars" else T.StringType()) for n in "url name org lang type stars reason".split()])))])


def read_directory(spark: SparkSession, root: str, repo: Column | None = None, most_bytes: int = 2_000_000) -> DataFrame:
    """``repo, ordinal, path, size, content`` of all text files below ``root``.

    The length filter reaches the scan before any byte is read. ``ordinal`` follows the
    path order within a repository. Bytes that aren't UTF-8 become replacement marks.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).where(F.col("length") < most_bytes)
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + base.replace(".", r"\."), "")
    f = raw.select(F.regexp_replace(rel, "^/+", "").alias("path"), F.col("length").alias("size"), "content")
    f = f.withColumn("repo", repo if repo is not None else F.lit(PurePosixPath(base).name))
    # the order is made on paths alone, which are read without any content
    order = f.select("repo", "path", (F.row_number().over(Window.partitionBy("repo").orderBy("path")) - 1).alias("ordinal"))
    text = F.make_valid_utf8(F.col("content").cast("string")).alias("content")
    return f.join(order, ["repo", "path"]).select("repo", "ordinal", "path", "size", text)


def clone_limits(files: DataFrame, most_files: int = 8000, most_bytes: int = 1_000_000, budget: int = 200 * 1024 * 1024) -> DataFrame:
    """The files of a clone that an analysis takes: no binary ones, none too large, the first ones within a budget of files and bytes per repository."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    order = Window.partitionBy("repo").orderBy("ordinal")
    f = files.where(~ext.isin(*BINARY) & (F.col("size") < most_bytes))
    f = f.withColumn("_n", F.row_number().over(order)).withColumn("_b", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return f.where((F.col("_n") <= most_files) & (F.col("_b") <= budget)).drop("_n", "_b")


def workspace(files: DataFrame, extensions: list[str], most_files: int = 500, depth: int = 8) -> tuple[DataFrame, DataFrame]:
    """(files of the given extensions up to a depth, bytes of all files) per repository."""
    inside = files.where(F.size(F.split("path", "/")) <= depth)
    picked = inside.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*extensions))
    picked = picked.withColumn("_n", F.row_number().over(Window.partitionBy("repo").orderBy("ordinal"))).where(F.col("_n") <= most_files).drop("_n")
    return picked, inside.groupBy("repo").agg(F.sum("size").alias("bytes"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The repositories of a catalog file; a missing file is an empty catalog."""
    try:
        df = spark.read.schema(CATALOG).option("multiLine", True).json(path)
    except Exception as e:  # noqa: BLE001 - the reader names a missing path only in its message
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CATALOG["repositories"].dataType.elementType)
    return df.select(F.inline("repositories"))


def safe_url(url: Column) -> Column:
    """http(s) or git addresses whose literal host isn't local or private."""
    host = F.lower(F.regexp_extract(url, r"^[a-z+]+://(?:[^@/]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    private = host.rlike(r"^(localhost|.*\.local|0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|\[::1\]|\[f[cd]|\[fe80)")
    return url.rlike(r"^(https?|git)://") & (host != "") & ~private


def inside(root: str, path: str) -> bool:
    """Does ``path``, taken from ``root`` where it isn't absolute, stay below ``root`` once ``.`` and ``..`` are applied?"""
    top = posixpath.normpath(root)
    return PurePosixPath(posixpath.normpath(posixpath.join(top, path))).is_relative_to(top)


def below(root: str, path: str) -> str:
    """``path`` joined to ``root``; an error where it would lead outside."""
    if not inside(root, path):
        raise ValueError(f"{path!r} leads outside {root!r}")
    return posixpath.join(root, path)


# What a browser doesn't send.
UNSENT_FOLDERS = "node_modules .git .next .turbo .cache dist build coverage vendor __pycache__ .venv venv bin obj .idea .vscode validation_workspace validation_results benchmarks".split()
UNSENT_EXTENSIONS = "png jpg jpeg gif ico svg webp avif pdf zip tar gz 7z rar mp4 mp3 mov woff woff2 ttf eot otf exe dll so dylib class pyc db sqlite bin iso lock pack idx".split()


def sent_files(files: DataFrame) -> DataFrame:
    """The files that a browser would upload, of any size."""
    low = F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
    return files.where(~F.arrays_overlap(F.split("path", r"[/\\]"), F.array(*map(F.lit, UNSENT_FOLDERS))) & ~low.isin(*UNSENT_EXTENSIONS))


def write_artifacts(artifacts: dict[str, DataFrame], folder: str, key: str = "unit") -> None:
    """One table of JSON rows per artifact, parted by unit; a unit's rows of an earlier run are replaced."""
    for name, df in artifacts.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(below(folder, name))


def execution_log(runs: DataFrame) -> DataFrame:
    """``repository, status, retries, errors`` of every result of the runs."""
    r = runs.select("run_id", F.explode("results").alias("r")).where("r is not null")
    return r.select("run_id", F.col("r.repository").alias("repository"), F.col("r.execution_log.status").alias("status"), F.col("r.execution_log.retries").alias("retries"), F.coalesce(F.size("r.execution_log.errors"), F.lit(0)).alias("errors"))


def run_summary(log: DataFrame) -> DataFrame:
    """Per run the results by status, the retries and errors; only runs with a real result count."""
    return log.where("status is not null").groupBy("run_id").agg(F.count(F.lit(1)).alias("results"), F.count_if(F.lower("status").isin("success", "completed", "ok")).alias("successful"), F.sum("retries").alias("retries"), F.sum("errors").alias("errors"))


def write_results(df: DataFrame, folder: str, key: str = "job_id") -> None:
    df.write.mode("append").partitionBy(key).json(folder)


def read_result(spark: SparkSession, folder: str, job: str, schema: T.StructType, key: str = "job_id") -> DataFrame:
    """One job's rows by partition filter."""
    return spark.read.schema(schema).json(folder).where(F.col(key) == job)


def outstanding(jobs: DataFrame, done: DataFrame, key: str = "repo") -> DataFrame:
    """Jobs without a checkpoint row."""
    return jobs.join(done.select(key).distinct(), key, "left_anti")


def merged(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """Old and new rows, the latest of each key; a new row wins over an old one of the same time."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def history(log: DataFrame, most: int = 20, url: str = "repo_url", at: str = "ts") -> DataFrame:
    """The newest entry of each repository, newest first, at most ``most``."""
    w = Window.partitionBy(url).orderBy(F.desc(at))
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy(F.desc(at), url).limit(most)


def without(log: DataFrame, entry: str | None = None, url: str = "repo_url") -> DataFrame:
    """The history without one repository's entries, or none of it."""
    return log.limit(0) if entry is None else log.where(~F.col(url).eqNullSafe(F.lit(entry)))


def exported(log: DataFrame, payload: bool = True, column: str = "result") -> DataFrame:
    """The history as JSON texts, with or without its results."""
    kept = log if payload else log.drop(column)
    return kept.select(F.to_json(F.struct(*kept.columns)).alias("entry"))


def report_text(scores: DataFrame, causes: DataFrame, form: str = "markdown") -> DataFrame:
    """One text per unit: markdown, html or json; another form falls back to markdown."""
    c = causes.groupBy("unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "title", "severity", "evidence_count"))), lambda x: x).alias("causes"))
    r = scores.join(c, "unit", "left")
    if form == "json":
        return r.select("unit", F.to_json(F.struct(*r.columns)).alias("text"))
    items = F.coalesce(F.transform("causes", lambda x: F.concat(F.lit("<li>" if form == "html" else "- "), x["title"], F.lit(" ("), x["severity"], F.lit(", "), x["evidence_count"].cast("string"), F.lit(")"), F.lit("</li>" if form == "html" else ""))), F.array())
    head = F.concat(F.lit("<h1>" if form == "html" else "# "), F.lit("Unit "), F.col("unit").cast("string"), F.lit(": "), F.col("overall").cast("string"), F.lit(" "), F.col("grade"), F.lit("</h1>" if form == "html" else ""))
    return r.select("unit", F.concat_ws("\n", head, F.array_join(items, "\n")).alias("text"))
