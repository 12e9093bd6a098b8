import json

from pyspark.sql import functions as F

from quillscan.functions import paths, text
from quillscan.operators import external, metrics
from quillscan.sources import files as sources
from quillscan.streaming import scan_stream


def test_directory_source_and_limits(spark, tmp_path):
    for name, body in {"a/x.py": "x = 1\n", "a/b/y.js": "y", "logo.png": "z", "big.txt": "q" * 100}.items():
        p = tmp_path / "repo" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    df = sources.read_directory(spark, str(tmp_path / "repo"), most_bytes=50)
    assert [(r.path, r.ordinal, r.content) for r in df.orderBy("ordinal").collect()] == [("a/b/y.js", 0, "y"), ("a/x.py", 1, "x = 1\n"), ("logo.png", 2, "z")]
    assert [r.path for r in sources.clone_limits(df, most_files=1).collect()] == ["a/b/y.js"]
    picked, total = sources.workspace(df, [".py"])
    assert [r.path for r in picked.collect()] == ["a/x.py"] and total.first().bytes == 8


def test_catalog_missing_or_there(spark, tmp_path):
    assert sources.read_catalog(spark, str(tmp_path / "no.json")).count() == 0
    (tmp_path / "c.json").write_text(json.dumps({"repositories": [{"url": "u", "name": "n", "stars": 3}]}))
    assert sources.read_catalog(spark, str(tmp_path / "c.json")).first().stars == 3


def test_results_history_and_merge(spark, tmp_path):
    df = spark.createDataFrame([("j1", 1), ("j2", 2)], "job_id string, n int")
    sources.write_results(df, str(tmp_path / "r"))
    assert sources.read_result(spark, str(tmp_path / "r"), "j2", df.schema).first().n == 2
    log = spark.createDataFrame([("u", 1), ("u", 3), ("v", 2)], "repo_url string, ts int")
    assert [tuple(r) for r in sources.history(log).collect()] == [("u", 3), ("v", 2)]
    assert sources.outstanding(log.select(F.col("repo_url").alias("repo")), spark.createDataFrame([("u",)], "repo string")).count() == 1
    new = spark.createDataFrame([("u", 3)], "repo_url string, ts int").withColumn("x", F.lit("new"))
    assert {tuple(r) for r in sources.merged(log.withColumn("x", F.lit("old")), new, "repo_url", "ts").collect()} == {("u", 3, "new"), ("v", 2, "old")}


def test_urls_and_paths(spark):
    urls = {"https://example.org/x": True, "http://localhost/x": False, "https://10.0.0.1/": False, "ftp://example.org": False, "https://u:p@192.168.1.1/": False}
    got = {r.u: r.ok for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", sources.safe_url(F.col("u")).alias("ok")).collect()}
    assert got == urls
    assert sources.inside("/w", "a/b") and not sources.inside("/w", "../a") and not sources.inside("/w", "a/../../b") and not sources.inside("/w", "/w/../etc") and sources.inside("/w", "/w/a/../b") and not sources.inside("/w", "/wide")


def test_functions(spark):
    df = spark.createDataFrame([("\\a\\./b/../C.TS", "abc", ".env")], "p string, s string, e string")
    r = df.select(paths.normal_path(F.col("p")), paths.extension_of(paths.normal_path(F.col("p"))), paths.extension_of(F.col("e")), text.hash31(F.col("s")), text.fnv1a(F.col("s")), text.entropy(F.col("s")), text.line_number(F.lit("a\r\nb\nc"), F.lit(5)), text.snippet(F.lit("  x  "))).first()
    assert r[0] == "a/b/C.TS" and r[1] == ".ts" and r[2] == "" and r[3] == 96354 and r[4] == 440920331 and abs(r[5] - 1.584963) < 1e-5 and r[6] == 3 and r[7] == "x"
    skips = {"node_modules/a.js": True, "src/a.ts": False, "src/generated/a.ts": True, "x/.backup_1/a.py": True, "a.bak.js": True, "secrets.enc.json": True, "temp_x.json": True, "Docs/keep/a.md": False, "own/skip/a.py": True}
    got = {r.p: r.s for r in spark.createDataFrame([(p,) for p in skips], "p string").select("p", paths.skipped(F.col("p"), paths.ignored_segments(F.lit("# c\n!x\n*.y\n/own/skip/\n"))).alias("s")).collect()}
    assert got == skips


def test_metrics_and_agreement(spark):
    assert metrics.measure(".py", "class A:\n    def f(self):\n        # c\n        return 1\n")[:5] == ("python", 5, 3, 1, 1)
    assert metrics.measure(".ts", "class A {}\nfunction f() {\n  return 1;\n}\n")[3:5] == (1, 1)
    f = spark.createDataFrame([("r", "t", "1", 0.8), ("r", "u", "2", 0.9)], "repository string, finding_type string, id string, confidence double")
    e = spark.createDataFrame([("r", "t", "a", 0.5), ("r", "t", "b", 0.7), ("r", "w", "a", 0.1)], "repository string, finding_type string, source_type string, confidence double")
    got = {r.id: (r.agreement, r.status) for r in external.agreement(f, e).collect()}
    assert got == {"1": (0.76, "likely_verified"), "2": (0.0, "unknown")}
    assert external.false_positives(external.agreement(f, e)).count() == 1 and external.false_negatives(e, f).count() == 1


def test_streams(spark, tmp_path, tables):
    src = spark.read.parquet(f"{tables}/scan_files.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    q = scan_stream.stream_findings(scan_stream.read_stream(spark, str(tmp_path / "in"), src, 1)).writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert spark.table("found").count() > 0
    f = spark.read.parquet(f"{tables}/findings.parquet")
    f.write.parquet(str(tmp_path / "f"))
    once = scan_stream.without_redelivery(scan_stream.read_stream(spark, str(tmp_path / "f"), f), late="3650 days")
    q = once.select("finding_key").writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    q.awaitTermination()
    assert spark.table("once").count() == f.select("repo", "scan_id", "id").distinct().count()
    s = scan_stream.windowed_counts(scan_stream.read_stream(spark, str(tmp_path / "f"), f), late="1 hour")
    q = s.writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert spark.table("counts").columns == ["start", "severity", "n"] and spark.table("counts").count() > 0
