"""Queries over the project's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillscan.functions import paths, text
from quillscan.session import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def level(severity: Column) -> Column:
    return F.lower(F.trim(severity))


def weight(severity: Column) -> Column:
    s = level(severity)
    return F.when(s == "critical", 3).when(s == "high", 2).when(s == "medium", 1).otherwise(0)


W = "CASE lower(trim(severity)) WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
NORMAL = "array_to_string(list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda s: s NOT IN ('', '.', '..')), '/')"
EXT = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]*)$', 1))"


@query("SELECT finding_type, lower(trim(severity)) AS severity, analyzer, count(*) AS n FROM findings GROUP BY GROUPING SETS ((finding_type), (lower(trim(severity))), (analyzer))")
def a01_counts(spark, d):
    f = load(spark, d, "findings").select("finding_type", level(F.col("severity")).alias("severity"), "analyzer")
    return f.groupingSets([["finding_type"], ["severity"], ["analyzer"]], "finding_type", "severity", "analyzer").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT repo, count(*) AS total, count(*) FILTER (WHERE validation_status = 'verified') AS passed, count(*) FILTER (WHERE validation_status = 'partial') AS warning, count(*) FILTER (WHERE validation_status = 'unverified') AS failed FROM findings GROUP BY repo")
def a02_status_counts(spark, d):
    s = F.col("validation_status")
    return load(spark, d, "findings").groupBy("repo").agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "verified").alias("passed"), F.count_if(s == "partial").alias("warning"), F.count_if(s == "unverified").alias("failed"))


@query(f"SELECT repo, scan_id, file_path, arg_max(lower(trim(severity)), ({W})::BIGINT * 1000000000 - finding_key) AS worst FROM findings WHERE file_path IS NOT NULL AND severity IS NOT NULL GROUP BY repo, scan_id, file_path")
def a03_worst_per_file(spark, d):
    f = load(spark, d, "findings").where("file_path is not null and severity is not null")
    return f.groupBy("repo", "scan_id", "file_path").agg(F.max_by(level(F.col("severity")), F.struct(weight(F.col("severity")), -F.col("finding_key"))).alias("worst"))


@query(f"WITH w AS ({SQL['a03_worst_per_file']}) SELECT worst, count(*) AS files FROM w GROUP BY worst")
def a04_worst_histogram(spark, d):
    return a03_worst_per_file(spark, d).groupBy("worst").agg(F.count(F.lit(1)).alias("files"))


@query("SELECT repo, count(DISTINCT CASE WHEN category IN ('large_file','long_function','todo_debt','high_complexity','deep_nesting','empty_handler') THEN file_path END) AS troubled, count(DISTINCT CASE WHEN category = 'circular_dependency' THEN file_path END) AS cyclic FROM findings GROUP BY repo")
def a05_distinct_files(spark, d):
    c, p = F.col("category"), F.col("file_path")
    return load(spark, d, "findings").groupBy("repo").agg(F.count_distinct(F.when(c.isin("large_file", "long_function", "todo_debt", "high_complexity", "deep_nesting", "empty_handler"), p)).alias("troubled"), F.count_distinct(F.when(c == "circular_dependency", p)).alias("cyclic"))


@query("SELECT category, count(*) AS n, floor(avg(coalesce(confidence, 0.8)) * 100 + 0.5) / 100 AS confidence FROM findings GROUP BY category")
def a06_confidence(spark, d):
    return load(spark, d, "findings").groupBy("category").agg(F.count(F.lit(1)).alias("n"), text.round_half_up(F.avg(F.coalesce("confidence", F.lit(0.8))), 2).alias("confidence"))


@query("""WITH f AS (SELECT repo, category, file_path, min(finding_key) AS k FROM findings WHERE file_path IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY repo, category ORDER BY k) AS n FROM f)
SELECT repo, category, string_agg(file_path, '|' ORDER BY k) AS first_files FROM r WHERE n <= 8 GROUP BY repo, category""")
def a07_first_files(spark, d):
    f = load(spark, d, "findings").where("file_path is not null").groupBy("repo", "category", "file_path").agg(F.min("finding_key").alias("k"))
    f = f.withColumn("n", F.row_number().over(Window.partitionBy("repo", "category").orderBy("k"))).where("n <= 8")
    return f.groupBy("repo", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "file_path"))), lambda x: x["file_path"]), "|").alias("first_files"))


BINS = [(0.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 0.9), (0.9, 1.0)]


@query("""WITH b(lo, hi) AS (VALUES (0.0::DOUBLE, 0.2::DOUBLE), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 0.9), (0.9, 1.0))
SELECT b.lo, b.hi, count(f.confidence) AS n FROM b LEFT JOIN findings f ON f.confidence >= b.lo AND (f.confidence < b.hi OR b.hi = 1.0 AND f.confidence <= 1.0) GROUP BY b.lo, b.hi""")
def a17_confidence_bins(spark, d):
    c = F.col("confidence")
    k = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(BINS))):
        k = F.when((c >= lo) & ((c < hi) if hi < 1 else (c <= hi)), i).otherwise(k)
    counts = load(spark, d, "findings").select(k.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    bins = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(BINS)], "bin int, lo double, hi double")
    return bins.join(counts, "bin", "left").select("lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH r AS (SELECT unnest(results) AS r FROM validation_runs), s AS (SELECT unnest(r.smells) AS s FROM r WHERE r IS NOT NULL), n AS (SELECT count(*) AS total FROM r WHERE r IS NOT NULL)
SELECT s.smell AS smell, count(*) AS n, floor(100.0 * count(*) / max(total) + 0.5) AS percentage FROM s, n WHERE s IS NOT NULL AND s.smell IS NOT NULL GROUP BY s.smell ORDER BY n DESC, smell LIMIT 10""")
def a18_top_smells(spark, d):
    r = load(spark, d, "validation_runs").select(F.explode("results").alias("r")).where("r is not null")
    total = r.agg(F.count(F.lit(1)).alias("total"))
    s = r.select(F.explode("r.smells").alias("s")).where("s is not null and s.smell is not null").groupBy(F.col("s.smell").alias("smell")).agg(F.count(F.lit(1)).alias("n"))
    return s.join(F.broadcast(total), F.lit(True)).select("smell", "n", text.round_half_up(100.0 * F.col("n") / F.col("total")).cast("double").alias("percentage")).orderBy(F.desc("n"), "smell").limit(10)


@query("""WITH r AS (SELECT unnest(results) AS r FROM validation_runs), c AS (SELECT name, min(type) AS type FROM repo_catalog GROUP BY name)
SELECT coalesce(c.type, 'Unknown') AS type, count(*) AS n, floor(avg(r.coverage) * 100 + 0.5) / 100 AS coverage FROM r LEFT JOIN c ON c.name = r.repository WHERE r IS NOT NULL GROUP BY 1""")
def a19_by_type(spark, d):
    r = load(spark, d, "validation_runs").select(F.explode("results").alias("r")).where("r is not null").select(F.col("r.repository").alias("name"), F.col("r.coverage").alias("coverage"))
    c = load(spark, d, "repo_catalog").groupBy("name").agg(F.min("type").alias("type"))
    return r.join(c, "name", "left").groupBy(F.coalesce("type", F.lit("Unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"), text.round_half_up(F.avg("coverage"), 2).alias("coverage"))


@query("SELECT count(*) AS scans, sum(total_files)::BIGINT AS files, sum(total_bytes)::BIGINT AS bytes, sum(total_lines)::BIGINT AS lines, floor(avg(total_files) * 100 + 0.5) / 100 AS mean_files, count(*) FILTER (WHERE has_tests) AS tested FROM scans")
def a20_totals(spark, d):
    return load(spark, d, "scans").agg(F.count(F.lit(1)).alias("scans"), F.sum("total_files").alias("files"), F.sum("total_bytes").alias("bytes"), F.sum("total_lines").alias("lines"), text.round_half_up(F.avg("total_files"), 2).alias("mean_files"), F.count_if("has_tests").alias("tested"))


@query("SELECT repo, arg_max(scan_id, total_lines * 10000000 - scan_id) AS largest, arg_min(scan_id, total_lines * 10000000 + scan_id) AS smallest FROM scans WHERE total_lines IS NOT NULL GROUP BY repo")
def a21_extremes(spark, d):
    s = load(spark, d, "scans").where("total_lines is not null")
    return s.groupBy("repo").agg(F.max_by("scan_id", F.struct("total_lines", -F.col("scan_id"))).alias("largest"), F.min_by("scan_id", F.struct("total_lines", "scan_id")).alias("smallest"))


_PAIR = """ends AS (SELECT repo, min(scan_id) AS a, max(scan_id) AS b FROM findings GROUP BY repo HAVING min(scan_id) < max(scan_id)),
x AS (SELECT DISTINCT f.repo, lower(category) AS category FROM findings f JOIN ends e ON f.repo = e.repo AND f.scan_id = e.a),
y AS (SELECT DISTINCT f.repo, lower(category) AS category FROM findings f JOIN ends e ON f.repo = e.repo AND f.scan_id = e.b)"""


def _first_and_last(spark, d) -> tuple[DataFrame, DataFrame]:
    f = load(spark, d, "findings").select("repo", "scan_id", F.lower("category").alias("category"), "confidence")
    ends = f.groupBy("repo").agg(F.min("scan_id").alias("a"), F.max("scan_id").alias("b")).where("a < b")
    f = f.join(ends, "repo")
    return f.where("scan_id = a").drop("a", "b"), f.where("scan_id = b").drop("a", "b")


@query("SELECT ext, sum(n)::BIGINT AS n FROM (SELECT unnest(map_keys(extension_counts)) AS ext, unnest(map_values(extension_counts)) AS n FROM scans) GROUP BY ext ORDER BY n DESC, ext LIMIT 5")
def a24_top_extensions(spark, d):
    return load(spark, d, "scans").select(F.explode("extension_counts").alias("ext", "n")).groupBy("ext").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ext").limit(5)


@query("""WITH ends AS (SELECT repo, min(scan_id) AS a, max(scan_id) AS b FROM findings GROUP BY repo HAVING min(scan_id) < max(scan_id)),
x AS (SELECT f.repo, lower(category) AS category, avg(confidence) AS c FROM findings f JOIN ends e ON f.repo = e.repo AND f.scan_id = e.a GROUP BY 1, 2),
y AS (SELECT f.repo, lower(category) AS category, avg(confidence) AS c FROM findings f JOIN ends e ON f.repo = e.repo AND f.scan_id = e.b GROUP BY 1, 2)
SELECT coalesce(x.repo, y.repo) AS repo, coalesce(x.category, y.category) AS category, CASE WHEN x.repo IS NULL THEN 'new' WHEN y.repo IS NULL THEN 'gone' WHEN abs(coalesce(x.c, 0) - coalesce(y.c, 0)) > 0.01 THEN 'changed' ELSE 'unchanged' END AS state
FROM x FULL JOIN y ON x.repo = y.repo AND x.category = y.category""")
def g09_diff(spark, d):
    a, b = _first_and_last(spark, d)
    a = a.groupBy("repo", "category").agg(F.avg("confidence").alias("x"), F.lit(True).alias("a"))
    b = b.groupBy("repo", "category").agg(F.avg("confidence").alias("y"), F.lit(True).alias("b"))
    moved = F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))) > 0.01
    return a.join(b, ["repo", "category"], "full").select("repo", "category", F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(moved, "changed").otherwise("unchanged").alias("state"))


@query("SELECT f.finding_key, c.org, c.stars FROM findings f LEFT JOIN repo_catalog c ON c.name = f.repo")
def g06_lookup(spark, d):
    c = load(spark, d, "repo_catalog").select(F.col("name").alias("repo"), "org", "stars")
    return load(spark, d, "findings").select("finding_key", "repo").join(c, "repo", "left").select("finding_key", "org", "stars")


@query("SELECT scan_id, repo FROM scans s WHERE EXISTS (SELECT 1 FROM findings f WHERE f.scan_id = s.scan_id AND f.category = 'hardcoded_secret')")
def g07_semi(spark, d):
    f = load(spark, d, "findings").where("category = 'hardcoded_secret'").select("scan_id")
    return load(spark, d, "scans").select("scan_id", "repo").join(f, "scan_id", "left_semi")


@query("SELECT name FROM repo_catalog c WHERE NOT EXISTS (SELECT 1 FROM scans s WHERE s.repo = c.name)")
def g08_anti(spark, d):
    return load(spark, d, "repo_catalog").select("name").join(load(spark, d, "scans").select(F.col("repo").alias("name")), "name", "left_anti")


@query("SELECT r.run_id AS run_id, s.smell AS smell, e AS evidence_id FROM (SELECT run_id, unnest(results) AS r FROM validation_runs) r, unnest(r.r.smells) AS t(s), unnest(s.evidence_ids) AS u(e) WHERE e IS NOT NULL")
def g10_membership(spark, d):
    r = load(spark, d, "validation_runs").select("run_id", F.explode("results").alias("r")).select("run_id", F.explode("r.smells").alias("s"))
    return r.select("run_id", F.col("s.smell").alias("smell"), F.explode("s.evidence_ids").alias("evidence_id")).where("evidence_id is not null")


@query("""WITH f AS (SELECT repo, category, min(finding_key) AS k FROM findings WHERE category <> 'magic_number' GROUP BY 1, 2)
SELECT repo, category, n AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY k) AS n FROM f) WHERE n <= 5""")
def w05_first_categories(spark, d):
    f = load(spark, d, "findings").where("category <> 'magic_number'").groupBy("repo", "category").agg(F.min("finding_key").alias("k"))
    return f.withColumn("rank_no", F.row_number().over(Window.partitionBy("repo").orderBy("k"))).where("rank_no <= 5").select("repo", "category", "rank_no")


@query("SELECT repo, scan_id, total_files FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY scanned_at DESC, scan_id DESC) AS n FROM scans) WHERE n = 1")
def w09_latest(spark, d):
    w = Window.partitionBy("repo").orderBy(F.desc("scanned_at"), F.desc("scan_id"))
    return load(spark, d, "scans").withColumn("n", F.row_number().over(w)).where("n = 1").select("repo", "scan_id", "total_files")


@query(f"SELECT finding_key FROM findings WHERE validation_status = 'verified' ORDER BY {W} DESC, finding_key LIMIT 3")
def w11_top_verified(spark, d):
    return load(spark, d, "findings").where("validation_status = 'verified'").orderBy(weight(F.col("severity")).desc(), "finding_key").select("finding_key").limit(3)


@query("SELECT category FROM findings WHERE validation_status = 'verified' INTERSECT SELECT category FROM findings WHERE validation_status = 'unverified'")
def u01_intersect(spark, d):
    f = load(spark, d, "findings").select("category", "validation_status")
    return f.where("validation_status = 'verified'").select("category").intersect(f.where("validation_status = 'unverified'").select("category"))


@query("SELECT repo FROM scans UNION SELECT name FROM repo_catalog")
def u03_keys(spark, d):
    return load(spark, d, "scans").select("repo").union(load(spark, d, "repo_catalog").select("name")).distinct()


@query(f"SELECT DISTINCT {EXT} AS ext, count(*) AS files FROM (SELECT {NORMAL} AS path FROM scan_files WHERE path IS NOT NULL) GROUP BY 1")
def p01_extensions(spark, d):
    f = load(spark, d, "scan_files").where("path is not null").select(paths.normal_path(F.col("path")).alias("path"))
    return f.groupBy(paths.extension_of(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("files"))


@query("SELECT file_id FROM scan_files WHERE regexp_matches(path, '(^|[/\\\\_.-])tests?([/\\\\_.-]|$)|__tests__|\\.(test|spec)\\.|(^|[/\\\\])test[_\\-]', 'i')")
def p08_test_files(spark, d):
    return load(spark, d, "scan_files").where(paths.is_test(F.col("path"))).select("file_id")


@query("""WITH f AS (SELECT scan_id, string_split(path, '/') AS p FROM scan_files WHERE path IS NOT NULL),
a AS (SELECT DISTINCT scan_id, array_to_string(p[1:k], '/') AS dir FROM f, range(1, 40) t(k) WHERE k < len(p)) SELECT scan_id, count(*) AS dirs FROM a GROUP BY scan_id""")
def p13_directories(spark, d):
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    f = load(spark, d, "scan_files").where((F.size(parts) > 1) & F.col("path").isNotNull()).select("scan_id", F.explode(dirs).alias("dir"))
    return f.groupBy("scan_id").agg(F.count_distinct("dir").alias("dirs"))


@query("""SELECT scan_id, count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (WHERE length(content) > 0) AS text_files, sum(CASE WHEN length(content) > 0 THEN len(regexp_split_to_array(content, '\\r\\n|\\r|\\n')) END)::BIGINT AS lines FROM scan_files GROUP BY scan_id""")
def p14_scan_aggregates(spark, d):
    n = F.when(F.length("content") > 0, F.size(text.lines_of(F.col("content"))))
    return load(spark, d, "scan_files").groupBy("scan_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_if(F.length("content") > 0).alias("text_files"), F.sum(n).alias("lines"))


@query("""WITH s AS (SELECT finding_key, evidence_snippet AS s FROM findings WHERE category = 'hardcoded_secret' AND length(evidence_snippet) > 0),
c AS (SELECT finding_key, length(s)::DOUBLE AS n, unnest(string_split(s, '')) AS ch FROM s), p AS (SELECT finding_key, count(*) / max(n) AS p FROM c GROUP BY finding_key, ch)
SELECT finding_key, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY finding_key""")
def e07_entropy(spark, d):
    f = load(spark, d, "findings").where((F.col("category") == "hardcoded_secret") & (F.length("evidence_snippet") > 0))
    return f.select("finding_key", F.round(text.entropy(F.col("evidence_snippet")), 6).alias("entropy"))


@query("SELECT finding_key FROM findings WHERE contains(lower(concat_ws(' ', message, category, file_path)), 'settings') OR contains(lower(concat_ws(' ', message, category, file_path)), 'monolith')")
def r14_text_filter(spark, d):
    s = F.lower(F.concat_ws(" ", "message", "category", "file_path"))
    return load(spark, d, "findings").where(F.contains(s, F.lit("settings")) | F.contains(s, F.lit("monolith"))).select("finding_key")


@query("""WITH r AS (SELECT run_id, unnest(results) AS r FROM validation_runs), c AS (SELECT run_id, r.repository AS repository, unnest(r.false_positive_candidates) AS c FROM r)
SELECT run_id, repository, c.candidate_id AS candidate_id FROM c WHERE c.confidence < 0.75 OR c.evidence_count < 2""")
def r11_doubtful(spark, d):
    r = load(spark, d, "validation_runs").select("run_id", F.explode("results").alias("r")).select("run_id", F.col("r.repository").alias("repository"), F.explode("r.false_positive_candidates").alias("c"))
    return r.where("c.confidence < 0.75 or c.evidence_count < 2").select("run_id", "repository", F.col("c.candidate_id").alias("candidate_id"))


@query("SELECT repo, scan_id, n AS run_no, total_files - lag(total_files) OVER (PARTITION BY repo ORDER BY n) AS grown FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY scanned_at, scan_id) AS n FROM scans)")
def w06_neighbours(spark, d):
    s = load(spark, d, "scans").withColumn("run_no", F.row_number().over(Window.partitionBy("repo").orderBy("scanned_at", "scan_id")))
    return s.select("repo", "scan_id", "run_no", (F.col("total_files") - F.lag("total_files").over(Window.partitionBy("repo").orderBy("run_no"))).alias("grown"))
