"""The operators of the pipeline over the project's tables, each beside the SQL that gives the same rows.

The findings table stands in for the detectors' output here, so that everything behind the
detectors can be compared: order, cap, validation, scores, causes, plan, graph and claims.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillscan.functions import dates, paths, text
from quillscan.operators import audit, detectors, external, findings, graph, metrics, report, score, views
from quillscan.plans.analytics import query
from quillscan.session import durable, load
from quillscan.sources import files as sources

_list = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_re = lambda rx: "'" + rx.replace("'", "''") + "'"
_LINES = "len(regexp_split_to_array(content, '\\r\\n|\\r|\\n'))"

KEPT = f"""p0 AS (SELECT scan_id AS unit, ordinal, content, coalesce(size, strlen(content), 0) AS size, array_to_string(list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda s: s NOT IN ('', '.', '..')), '/') AS path FROM scan_files WHERE path IS NOT NULL),
p1 AS (SELECT *, lower(path) AS low, string_split(path, '/') AS segs, regexp_extract(path, '[^/]*$') AS base, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]*)$', 1)) AS ext, row_number() OVER (PARTITION BY unit, path ORDER BY ordinal) AS n FROM p0 WHERE path <> ''),
kept AS (SELECT *, coalesce(ext IN {tuple(paths.TEXT_EXTENSIONS)} AND size <= {paths.MAX_TEXT_BYTES} AND length(content) > 0, false) AS readable, ext IN {tuple(paths.CODE_EXTENSIONS)} AS code, regexp_matches(path, {_re(paths.TEST_FILE)}) AS is_test FROM p1
  WHERE n = 1 AND NOT list_has_any(string_split(low, '/'), {_list(paths.SKIP_SEGMENTS)}) AND NOT regexp_matches(low, '(^|/)\\.?backup|backup[-_.]\\d{{6,}}') AND NOT regexp_matches(lower(base), {_re(paths.BACKUP_NAME)}) AND lower(base) NOT IN {tuple(paths.SKIP_NAMES)}
  AND NOT regexp_matches(lower(base), '({"|".join(e.replace(".", "[.]") for e in paths.SKIP_ENDINGS)})$') AND NOT regexp_matches(path, {_re(paths.GENERATED)}) AND NOT regexp_matches(path, {_re(paths.ENCRYPTED)}) AND NOT regexp_matches(path, {_re(paths.TEMPORARY)}))"""
FOUND = "f AS (SELECT scan_id AS unit, finding_key AS ev_seq, 'ev-' || finding_key AS id, analyzer, finding_type, lower(trim(severity)) AS severity, category, file_path AS path, line, message, evidence_snippet AS snippet, metric_value, confidence, replace(validation_status, 'partially_verified', 'partial') AS validation_status FROM findings)"
W = "CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
CAPPED = f"""{FOUND}, c0 AS (SELECT *, row_number() OVER (PARTITION BY unit, path, category ORDER BY ev_seq) AS n FROM f),
c1 AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY {W} DESC, ev_seq) AS kept_rank FROM c0 WHERE n <= 5), capped AS (SELECT * FROM c1 WHERE kept_rank <= 300)"""
_TEMPLATES = ", ".join("('" + "', '".join(x.replace("'", "''") for x in (c, t, a)) + "')" for c, (t, a) in report.CAUSES.items())
CAUSES = f"""{CAPPED}, t(category, title, advice) AS (VALUES {_TEMPLATES}), g AS (SELECT capped.*, t.title, t.advice FROM capped JOIN t ON t.category = capped.category),
e AS (SELECT unit, category, title, advice, count(*) AS evidence_count, floor(avg(coalesce(confidence, 0.8)) * 100 + 0.5) / 100 AS confidence, arg_max(severity, ({W})::BIGINT * 1000000000 - ev_seq) FILTER (WHERE severity IS NOT NULL) AS severity, min(ev_seq) AS first_seq FROM g GROUP BY ALL),
ff AS (SELECT unit, category, path, min(ev_seq) AS k FROM g GROUP BY ALL), fr AS (SELECT *, row_number() OVER (PARTITION BY unit, category ORDER BY k) AS n FROM ff),
fl AS (SELECT unit, category, string_agg(path, '|' ORDER BY k) AS affected_files FROM fr WHERE n <= 8 GROUP BY unit, category),
causes AS (SELECT * FROM (SELECT e.*, coalesce(fl.affected_files, '') AS affected_files, row_number() OVER (PARTITION BY e.unit ORDER BY first_seq) AS rank_no FROM e LEFT JOIN fl ON fl.unit = e.unit AND fl.category = e.category) WHERE rank_no <= 5)"""


def as_findings(spark: SparkSession, d: str) -> DataFrame:
    """The findings table in the layout of the pipeline; a finding's key gives its order."""
    f = load(spark, d, "findings")
    return f.select(
        F.col("scan_id").alias("unit"), F.col("finding_key").alias("ev_seq"), F.concat(F.lit("ev-"), F.col("finding_key").cast("string")).alias("id"), "analyzer", "finding_type", F.lower(F.trim("severity")).alias("severity"), "category", F.col("file_path").alias("path"), "line", "message",
        F.col("evidence_snippet").alias("snippet"), "metric_value", "confidence", F.replace("validation_status", F.lit("partially_verified"), F.lit("partial")).alias("validation_status"),
    )


def _capped(spark, d) -> DataFrame:
    return findings.capped(as_findings(spark, d))


def _kept(spark, d) -> DataFrame:
    return detectors.kept_files(load(spark, d, "scan_files"))


def _local(spark, d, category: str) -> DataFrame:
    return detectors.parts(durable(detectors.one_pass(load(spark, d, "scan_files"))))[1].where(F.col("category") == category)


@query(f"WITH {CAPPED} SELECT ev_seq AS finding_key, kept_rank FROM capped")
def w01_w02_cap(spark, d):
    return _capped(spark, d).select(F.col("ev_seq").alias("finding_key"), "kept_rank")


@query(f"WITH {CAUSES} SELECT unit, category, title, advice, evidence_count, confidence, severity, affected_files, rank_no FROM causes")
def r02_root_causes(spark, d):
    return report.root_causes(_capped(spark, d)).withColumn("affected_files", F.array_join("affected_files", "|"))


@query(f"WITH {CAUSES} SELECT unit, 'step-' || rank_no AS step_id, category, advice AS action, CASE WHEN severity = 'critical' THEN 8 ELSE 4 END AS hours, 1 AS sprint, severity AS risk, (rank_no + 0.5)::DOUBLE AS roi, rank_no <= 2 AS quick_win FROM causes")
def r03_plan_steps(spark, d):
    return report.plan_steps(report.root_causes(_capped(spark, d))).withColumn("roi", F.col("roi").cast("double"))


@query(f"WITH {CAUSES} SELECT unit, count(*) AS steps, sum(CASE WHEN severity = 'critical' THEN 8 ELSE 4 END)::BIGINT AS hours, count(*) FILTER (WHERE rank_no <= 2) AS quick_wins, {', '.join(f'''count(*) FILTER (WHERE severity = '{r}') AS {r}_risk''' for r in ('critical', 'high', 'medium', 'low'))} FROM causes GROUP BY unit")
def r04_plan_totals(spark, d):
    return report.plan_totals(report.plan_steps(report.root_causes(_capped(spark, d))))


_SHARES = "s AS (SELECT unit, category, avg((coalesce(validation_status, '') = 'verified')::INT::DOUBLE) FILTER (WHERE validation_status IS NOT NULL) AS confirmed, bool_or(coalesce(validation_status = 'partial', false)) AS partly FROM capped GROUP BY ALL)"
_CLAIMS = "claims AS (SELECT c.unit, c.category, c.title, c.confidence, s.confirmed, CASE WHEN confirmed >= 0.9 THEN 2 ELSE 1 END AS consensus, CASE WHEN confirmed >= 0.9 THEN 'verified' WHEN confirmed >= 0.5 OR partly THEN 'opinion' ELSE 'rejected' END AS status, CASE WHEN confirmed >= 0.9 THEN 'verified' WHEN confirmed >= 0.5 THEN 'partially_verified' ELSE 'unverified' END AS validation FROM causes c JOIN s ON s.unit = c.unit AND s.category = c.category)"


@query(f"WITH {CAUSES}, {_SHARES}, {_CLAIMS} SELECT unit, category, title, confidence, round(confirmed, 6) AS confirmed, consensus, status, validation FROM claims")
def r06_claims(spark, d):
    capped = _capped(spark, d)
    return report.claims(report.root_causes(capped), capped).withColumn("confirmed", F.round("confirmed", 6))


@query(f"WITH {CAUSES} SELECT unit, severity, count(*) AS causes, string_agg(title, '; ' ORDER BY rank_no) AS hypotheses FROM causes GROUP BY unit, severity")
def r06_clusters(spark, d):
    return report.clusters(report.root_causes(_capped(spark, d)))


_NODES = f"""{KEPT}, {CAPPED}, r AS (SELECT unit, path, row_number() OVER (PARTITION BY unit ORDER BY ordinal, path) AS n FROM kept),
nodes AS (SELECT DISTINCT unit, 'repo' AS node_id, 'repository' AS node_type, NULL::VARCHAR AS label FROM kept UNION ALL SELECT unit, 'file-' || n, 'file', path FROM r WHERE n <= 50 UNION ALL SELECT unit, id, 'evidence', message FROM capped WHERE kept_rank <= 50)"""


@query(f"WITH {_NODES} SELECT unit, node_id, node_type, label FROM nodes")
def r05_graph_nodes(spark, d):
    return report.graph_nodes(_kept(spark, d), _capped(spark, d))


@query(f"""WITH {_NODES}, n AS (SELECT * FROM nodes WHERE node_type = 'file') SELECT unit, node_id AS source_id, 'repo' AS target_id, 'belongs_to' AS edge_type FROM n
UNION ALL SELECT c.unit, c.id, coalesce(n.node_id, 'repo'), 'found_in' FROM capped c LEFT JOIN n ON n.unit = c.unit AND n.label = c.path WHERE kept_rank <= 50""")
def r05_graph_edges(spark, d):
    capped = _capped(spark, d)
    return report.graph_edges(report.graph_nodes(_kept(spark, d), capped), capped)


@query(f"WITH {KEPT}, {CAPPED}, a AS (SELECT unit, count(*) AS n FROM kept GROUP BY unit), b AS (SELECT unit, count(*) AS n FROM capped GROUP BY unit) SELECT a.unit, least(1 + a.n + coalesce(b.n, 0), 101) AS total_nodes FROM a LEFT JOIN b ON a.unit = b.unit")
def r05_graph_size(spark, d):
    return report.graph_size(_kept(spark, d), _capped(spark, d))


_STEP = lambda a, x, b, y, z: f"CASE WHEN metric_value > {a} THEN {x} WHEN metric_value > {b} THEN {y} ELSE {z} END"


@query(f"""WITH {FOUND}, s AS (SELECT *, CASE WHEN category = 'hardcoded_secret' THEN CASE WHEN metric_value >= 3.5 THEN 'verified' ELSE 'partial' END ELSE 'verified' END AS st FROM f)
SELECT ev_seq, st AS validation_status, CASE WHEN st = 'partial' THEN floor(least(confidence, 0.65) * 100 + 0.5) / 100
  WHEN category = 'large_file' THEN {_STEP(2000, 0.9, 1000, 0.85, 0.7)} WHEN category = 'long_function' THEN {_STEP(150, 0.8, 80, 0.7, 0.6)} WHEN category = 'high_complexity' THEN {_STEP(80, 0.9, 40, 0.8, 0.7)} WHEN category = 'deep_nesting' THEN {_STEP(10, 0.9, 8, 0.8, 0.65)}
  WHEN category = 'magic_number' THEN CASE WHEN metric_value >= 1000 THEN 0.5 ELSE 0.4 END WHEN category = 'hardcoded_secret' THEN 0.95 WHEN category IN ('command_injection', 'empty_handler') THEN 0.8 WHEN category = 'weak_crypto' THEN 0.7 WHEN category = 'todo_debt' THEN 0.75 ELSE greatest(confidence, 0.8) END::DOUBLE AS confidence,
  concat_ws('|', analyzer, CASE WHEN category = 'hardcoded_secret' THEN CASE WHEN metric_value IS NOT NULL THEN 'entropy-validator' END WHEN category IN ('command_injection', 'weak_crypto', 'magic_number') THEN 'context-validator' WHEN category = 'empty_handler' THEN 'brace-validator' WHEN category IN ('high_complexity', 'long_function') THEN 'metric-validator' END) AS validated_by FROM s""")
def v01_validated(spark, d):
    return findings.validated(as_findings(spark, d)).select("ev_seq", "validation_status", "confidence", F.array_join("validated_by", "|").alias("validated_by"))


_ANY = lambda rx: f"bool_or(regexp_matches(path, {_re(rx)}))"
_LAYERS = " + ".join(f"max(list_contains(segs, '{x}')::INT)" for x in score.LAYERS)
FACTS = f"""rm AS (SELECT unit, coalesce({_LINES}, 1) AS lines, coalesce(len(regexp_extract_all(content, '(?m)^#{{1,3}}\\s+')), 0) AS headings, coalesce(len(regexp_extract_all(content, '```')) / 2, 0) AS fences, row_number() OVER (PARTITION BY unit ORDER BY coalesce(length(content), 0) DESC, ordinal) AS n
  FROM kept WHERE regexp_matches(path, '(?i)readme') AND NOT regexp_matches(path, {_re(score.NOT_README)})),
ff0 AS (SELECT unit, count(*) AS files, sum(size) AS bytes, count(*) FILTER (WHERE is_test) AS tests, count(*) FILTER (WHERE code) AS sources, {_LAYERS} AS layers, {_ANY('(^|/)(packages|apps|services|modules)/')}::INT
  + ({_ANY('(^|/)services/[^/]+/[^/]+')} AND count(*) FILTER (WHERE regexp_matches(path, '(^|/)services/')) >= 2)::INT + {_ANY('(^|/)(ports|adapters|application|infrastructure)/')}::INT + {_ANY('(^|/)(event|events|consumers?|producers?|queues?|streams?)/')}::INT + {_ANY('(^|/)(controllers?|routes?|views?|templates?)/')}::INT AS signals,
  max(len(segs)) AS depth, count(*) FILTER (WHERE base IN {tuple(paths.MANIFESTS)}) AS manifests, coalesce(bool_or(readable AND base IN {tuple(paths.MANIFESTS)} AND regexp_matches(lower(content), {_re(detectors.FRAMEWORK)})), false) AS framework,
  coalesce(sum(len(regexp_extract_all(content, {_re(detectors.ASSERTION)}))) FILTER (WHERE readable AND is_test), 0) AS assertions, {_ANY('(?i)(^|/)(docs|doc|documentation)/')} AS docs, {_ANY(score.CI)} AS ci, {_ANY(score.LINT)} AS lint, {_ANY(score.LOCK)} AS lock FROM kept GROUP BY unit),
ff AS (SELECT ff0.*, rm.lines, rm.headings, rm.fences FROM ff0 LEFT JOIN rm ON rm.unit = ff0.unit AND rm.n = 1),
fd AS (SELECT unit, sum(CASE category WHEN 'hardcoded_secret' THEN CASE WHEN severity = 'critical' THEN 25 ELSE 12 END WHEN 'command_injection' THEN CASE WHEN severity = 'high' THEN 15 ELSE 7 END WHEN 'weak_crypto' THEN CASE WHEN severity = 'medium' THEN 8 ELSE 3 END ELSE 0 END) AS exposed,
  bool_or(coalesce(category = 'hardcoded_secret' AND severity = 'critical', false)) AS leaked, count(DISTINCT path) FILTER (WHERE category = 'circular_dependency') AS cyclic, count(*) FILTER (WHERE category = 'god_class') AS gods, count(DISTINCT path) FILTER (WHERE category = 'tight_coupling') AS coupled,
  count(DISTINCT path) FILTER (WHERE category IN ('large_file', 'long_function', 'todo_debt', 'high_complexity', 'deep_nesting', 'empty_handler')) AS troubled, count(*) FILTER (WHERE category = 'large_file') AS large, count(*) FILTER (WHERE category = 'large_file' AND contains(message, '1000')) AS huge FROM f GROUP BY unit),
x AS (SELECT ff.*, coalesce(exposed, 0) AS exposed, coalesce(leaked, false) AS leaked, coalesce(cyclic, 0) AS cyclic, coalesce(gods, 0) AS gods, coalesce(coupled, 0) AS coupled, coalesce(troubled, 0) AS troubled, coalesce(large, 0) AS large, coalesce(huge, 0) AS huge FROM ff LEFT JOIN fd ON fd.unit = ff.unit),
y AS (SELECT *, CASE WHEN sources > 0 THEN tests / sources ELSE 0 END AS ratio, CASE WHEN tests > 0 THEN assertions / tests END AS dense, troubled / files AS bad FROM x),
z AS (SELECT unit, sources, leaked, greatest(20, least(95, 90.0 - exposed)) AS security,
  greatest(20, least(95, 80.0 - least(30, cyclic * 10) - least(24, gods * 8) - least(16, coupled * 4) + CASE WHEN layers >= 2 THEN 6 ELSE 0 END + least(6, signals * 3) + CASE WHEN depth BETWEEN 2 AND 5 THEN 4 ELSE 0 END)) AS architecture,
  greatest(25, least(95, 92.0 - CASE WHEN bad < 0.01 THEN 0 ELSE least(45, floor(bad * 150 + 0.5)) END - least(15, huge * 1.5))) AS code_quality,
  greatest(25, least(95, greatest(25, least(95, CASE WHEN ratio = 0 AND tests = 0 THEN 30 WHEN ratio < 0.02 THEN 45 WHEN ratio < 0.05 THEN 65 WHEN ratio < 0.10 THEN 80 ELSE 90 END + CASE WHEN framework THEN 5 ELSE 0 END)) - CASE WHEN dense < 0.5 THEN 25 WHEN dense < 2 THEN 10 ELSE 0 END)) AS testing,
  greatest(25, least(95, CASE WHEN lines IS NULL THEN 35 ELSE CASE WHEN lines >= 200 THEN 68 ELSE 60 END + CASE WHEN docs THEN 8 ELSE 0 END + CASE WHEN headings >= 5 THEN 5 ELSE 0 END + CASE WHEN fences >= 3 THEN 4 ELSE 0 END END)) AS documentation,
  greatest(25, least(95, CASE WHEN bytes / files < 5000 THEN 90 WHEN bytes / files < 20000 THEN 78 WHEN bytes / files < 60000 THEN 65 ELSE 50 END - CASE WHEN large > files * 0.05 THEN 10 ELSE 0 END)) AS performance,
  greatest(25, least(95, 55 + CASE WHEN manifests > 0 THEN 15 ELSE 0 END + CASE WHEN ci THEN 15 ELSE 0 END + CASE WHEN lint THEN 8 ELSE 0 END + CASE WHEN lock THEN 7 ELSE 0 END)) AS developer_experience,
  greatest(25, least(95, 75 - CASE WHEN coupled / files > 0.02 THEN 12 ELSE 0 END - CASE WHEN gods > 0 THEN 10 ELSE 0 END + CASE WHEN layers >= 2 THEN 8 ELSE 0 END)) AS scalability FROM y),
o AS (SELECT *, floor((CASE WHEN sources = 0 THEN least(40, documentation) ELSE greatest(0, least(100, {" + ".join(f"{k} * {w}::DOUBLE" for k, w in score.WEIGHTS.items())} - CASE WHEN leaked THEN 15 ELSE 0 END)) END) * 10 + 0.5) / 10 AS overall FROM z),
scores AS (SELECT unit, {", ".join(f"{k}::DOUBLE AS {k}" for k in score.WEIGHTS)}, overall::DOUBLE AS overall, CASE WHEN overall >= 85 THEN 'A' WHEN overall >= 70 THEN 'B' WHEN overall >= 55 THEN 'C' WHEN overall >= 40 THEN 'D' ELSE 'F' END AS grade FROM o)"""


def _scores(spark, d) -> DataFrame:
    return score.health(_kept(spark, d), as_findings(spark, d))


@query(f"WITH {KEPT}, {FOUND}, {FACTS} SELECT * FROM scores")
def a08_a13_health(spark, d):
    return _scores(spark, d)


@query(f"WITH {KEPT}, {FOUND}, {FACTS}, g AS (SELECT unit, count(*) FILTER (WHERE finding_type = 'security') AS n, bool_or(coalesce(severity = 'critical', false)) AS hot FROM f GROUP BY unit) SELECT s.unit, s.security, coalesce(g.n, 0) AS security_findings, CASE WHEN hot THEN 'critical' ELSE 'info' END AS overall_severity FROM scores s LEFT JOIN g ON g.unit = s.unit")
def r08_security_review(spark, d):
    return report.security_review(as_findings(spark, d), _scores(spark, d))


@query(f"""WITH {KEPT}, {FOUND}, {FACTS}, wf AS (SELECT unit, path, max({W}) AS worst FROM f WHERE path IS NOT NULL GROUP BY ALL), pr AS (SELECT unit, {", ".join(f"count(*) FILTER (WHERE worst = {k}) AS {n}_files" for k, n in ((3, "critical"), (2, "high"), (1, "medium"), (0, "low")))} FROM wf GROUP BY unit),
i AS (SELECT unit, count(*) AS files, count(*) FILTER (WHERE readable) AS text_files, sum(size)::BIGINT AS bytes, sum(CASE WHEN readable THEN {_LINES} END)::BIGINT AS lines, count(*) > 150 AS truncated, count(DISTINCT CASE WHEN len(segs) > 1 THEN array_to_string(segs[:-2], '/') END) AS folders FROM kept GROUP BY unit), n AS (SELECT unit, count(*) AS n FROM f GROUP BY unit)
SELECT i.*, coalesce(n.n, 0) AS findings, {", ".join(f"coalesce(pr.{x}_files, 0) AS {x}_files" for x in ("critical", "high", "medium", "low"))}, s.overall, s.grade FROM i LEFT JOIN n ON n.unit = i.unit LEFT JOIN pr ON pr.unit = i.unit LEFT JOIN scores s ON s.unit = i.unit""")
def r07_header(spark, d):
    return report.header(_kept(spark, d), as_findings(spark, d), _scores(spark, d))


@query(f"WITH {KEPT} SELECT unit, n AS place, path, ext, size FROM (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY unit ORDER BY ordinal, path) AS n FROM kept) WHERE n <= 150")
def r07_inventory(spark, d):
    return report.inventory(_kept(spark, d))


@query(f"WITH {CAUSES}, {_SHARES}, {_CLAIMS}, h AS (SELECT unit, category, count(*) AS evidence, count(DISTINCT analyzer) AS analyzers, count(DISTINCT path) AS files, count(*) FILTER (WHERE kept_rank <= 50) AS nodes FROM capped GROUP BY ALL) SELECT c.unit, c.category, c.rank_no, h.evidence, h.analyzers, h.files, h.nodes, k.status FROM causes c JOIN h ON h.unit = c.unit AND h.category = c.category JOIN claims k ON k.unit = c.unit AND k.category = c.category")
def r15_chain(spark, d):
    capped = _capped(spark, d)
    causes = report.root_causes(capped)
    return views.chain(causes, capped, report.graph_nodes(_kept(spark, d), capped), report.claims(causes, capped))


@query(f"""WITH {CAUSES.replace("causes AS (SELECT * FROM", "causes AS (SELECT * FROM")}, a AS (SELECT unit, string_agg('- [' || severity || '] ' || category || ': ' || title || ' (' || split_part(affected_files, '|', 1) || ', ' || evidence_count || ' findings)', chr(10) ORDER BY rank_no) AS causes FROM causes GROUP BY unit),
v AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY kept_rank) AS m FROM capped WHERE validation_status = 'verified' AND snippet IS NOT NULL), b AS (SELECT unit, string_agg('- ' || coalesce(path, '') || ':' || coalesce(line, 1) || ': ' || left(regexp_replace(snippet, '\\s+', ' ', 'g'), 220), chr(10) ORDER BY m) AS snippets FROM v WHERE m <= 3 GROUP BY unit)
SELECT a.unit, concat_ws(chr(10), 'Findings:', a.causes, CASE WHEN b.snippets IS NOT NULL THEN chr(10) || 'Key evidence snippets:' || chr(10) || b.snippets END, chr(10) || 'Explain the top 3 most important findings; keep the rest brief.') AS prompt FROM a LEFT JOIN b ON b.unit = a.unit""")
def r13_prompt(spark, d):
    capped = _capped(spark, d)
    return report.prompt_text(report.root_causes(capped), capped)


@query("""WITH t AS (SELECT section_id AS id, regexp_replace(coalesce(body, ''), '^\\s+|\\s+$', '', 'g') AS body FROM llm_sections) SELECT id, 0 AS section_no, 'Explanation' AS title, CASE WHEN body = '' THEN 'Empty answer.' ELSE body END AS body, 'medium' AS confidence FROM t""")
def r13_sections(spark, d):
    return report.answer_sections(load(spark, d, "llm_sections"), "section_id", "body")


@query(f"WITH {FOUND}, {KEPT}, {CAUSES.replace(FOUND + ', ', '')}, u AS (SELECT DISTINCT unit FROM kept) SELECT u.unit, 3 + (u.unit IN (SELECT unit FROM capped WHERE finding_type IN ('metric', 'complexity')))::INT + (u.unit IN (SELECT unit FROM capped))::INT + 2 * (u.unit IN (SELECT unit FROM causes))::INT + 1 AS phases FROM u")
def a25_phases(spark, d):
    files, capped = _kept(spark, d), _capped(spark, d)
    none = spark.createDataFrame([], "unit bigint")
    return report.phases(files, capped, report.root_causes(capped), none, _scores(spark, d))


@query("""WITH e AS (SELECT DISTINCT repo, scan_id, lower(category) AS category FROM findings WHERE validation_status = 'verified'), a AS (SELECT DISTINCT repo, scan_id, lower(category) AS category FROM findings WHERE confidence >= 0.7),
o AS (SELECT coalesce(e.category, a.category) AS category, count(*) FILTER (WHERE e.category IS NOT NULL AND a.category IS NOT NULL) AS matched, count(*) FILTER (WHERE a.category IS NULL) AS missing, count(*) FILTER (WHERE e.category IS NULL) AS extra FROM e FULL JOIN a ON e.repo = a.repo AND e.scan_id = a.scan_id AND e.category = a.category GROUP BY 1)
SELECT *, CASE WHEN matched + extra > 0 THEN matched / (matched + extra) WHEN matched + missing = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS precision, CASE WHEN matched + missing > 0 THEN matched / (matched + missing) ELSE 1.0 END::DOUBLE AS recall FROM o""")
def a22_precision_recall(spark, d):
    f = load(spark, d, "findings")
    return audit.precision_recall(audit.compared(f.where("validation_status = 'verified'"), f.where("confidence >= 0.7"), ["repo", "scan_id"]), ["category"])


_EVIDENCE = "ev AS (SELECT s.repository, replace(lower(trim(s.smell.smell)), ' ', '_') AS finding_type, 'run-' || s.run_id AS source_type, s.smell.confidence AS confidence FROM (SELECT run_id, r.repository AS repository, unnest(r.smells) AS smell FROM (SELECT run_id, unnest(results) AS r FROM validation_runs) WHERE r IS NOT NULL) s WHERE s.smell IS NOT NULL AND s.smell.smell IS NOT NULL)"
_AGREED = f"""{_EVIDENCE}, eg AS (SELECT repository, finding_type, count(DISTINCT source_type) AS sources, count(*) AS items, avg(confidence) AS other FROM ev GROUP BY ALL),
ag AS (SELECT f.repo AS repository, f.category AS finding_type, f.finding_key::VARCHAR AS id, f.confidence, coalesce(eg.sources, 0) AS sources, coalesce(eg.items, 0) AS items, other, floor((CASE WHEN sources >= 2 THEN least(0.95::DOUBLE, 0.4::DOUBLE + 0.15::DOUBLE * sources + 0.03::DOUBLE * items) WHEN sources = 1 THEN 0.35::DOUBLE ELSE 0 END) * 100 + 0.5) / 100 AS agreement FROM findings f LEFT JOIN eg ON eg.repository = f.repo AND eg.finding_type = f.category),
agreed AS (SELECT repository, finding_type, id, confidence, sources, items, agreement, floor(least(1.0::DOUBLE, agreement * 0.6::DOUBLE + coalesce(other, 0) * 0.4::DOUBLE) * 100 + 0.5) / 100 AS external_confidence, CASE WHEN sources >= 3 AND agreement >= 0.7 THEN 'verified' WHEN sources >= 2 AND agreement >= 0.5 THEN 'likely_verified' WHEN sources >= 1 THEN 'weak_evidence' ELSE 'unknown' END AS status FROM ag)"""


def evidence(spark, d) -> DataFrame:
    """The smells of the validation runs as evidence; each run is a source of its own."""
    r = load(spark, d, "validation_runs").select("run_id", F.explode("results").alias("r")).where("r is not null").select("run_id", F.col("r.repository").alias("repository"), F.explode("r.smells").alias("s")).where("s is not null and s.smell is not null")
    return r.select("repository", F.replace(F.lower(F.trim("s.smell")), F.lit(" "), F.lit("_")).alias("finding_type"), F.concat(F.lit("run-"), F.col("run_id").cast("string")).alias("source_type"), F.col("s.confidence").alias("confidence"))


def _agreed(spark, d) -> DataFrame:
    ours = load(spark, d, "findings").selectExpr("repo AS repository", "category AS finding_type", "cast(finding_key AS string) AS id", "confidence")
    return external.agreement(ours, evidence(spark, d))


@query(f"WITH {_AGREED} SELECT * FROM agreed")
def agreement(spark, d):
    return _agreed(spark, d)


@query(f"""WITH {_AGREED}, ty AS (SELECT finding_type, count(*) FILTER (WHERE status IN ('verified', 'likely_verified')) AS yes FROM agreed GROUP BY 1)
SELECT count(*) AS findings, {", ".join(f"count(*) FILTER (WHERE status = '{n}') AS {n}" for n in ("verified", "likely_verified", "weak_evidence", "contradicted", "unknown"))}, floor(avg(agreement) * 100 + 0.5) / 100 AS agreement, floor(avg(external_confidence) * 100 + 0.5) / 100 AS confidence, floor(avg(items) * 10 + 0.5) / 10 AS evidence,
(SELECT finding_type FROM ty ORDER BY yes DESC, finding_type LIMIT 1) AS most_confirmed, (SELECT min(finding_type) FROM ty) AS most_controversial FROM agreed""")
def a23_external_summary(spark, d):
    return external.summary(_agreed(spark, d))


@query(f"WITH {_EVIDENCE} SELECT DISTINCT repository, finding_type, source_type, confidence FROM ev WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.repo = ev.repository AND f.category = ev.finding_type)")
def r11_false_negatives(spark, d):
    ours = load(spark, d, "findings").selectExpr("repo AS repository", "category AS finding_type")
    return external.false_negatives(evidence(spark, d), ours).select("repository", "finding_type", "source_type", "confidence").distinct()


@query(f"WITH {_AGREED} SELECT repository, finding_type, id FROM agreed WHERE confidence > 0.75 AND agreement < 0.4")
def r11_false_positives(spark, d):
    return external.false_positives(_agreed(spark, d)).select("repository", "finding_type", "id")


@query(f"WITH {_AGREED}, ns AS (SELECT DISTINCT repository AS node_id, 'repository' AS node_type FROM agreed UNION ALL SELECT id, 'finding' FROM agreed UNION ALL SELECT DISTINCT source_type, 'source' FROM ev) SELECT node_type, count(*) AS n FROM ns GROUP BY 1")
def r10_external_nodes(spark, d):
    return external.evidence_graph(_agreed(spark, d), evidence(spark, d))[0].groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 4 - list_position(['info', 'low', 'medium', 'high', 'critical'], lower(trim(severity))) + 1 AS place, lower(trim(severity)) AS severity, count(*) AS n FROM findings WHERE severity IS NOT NULL GROUP BY 1, 2")
def a24_severity_buckets(spark, d):
    return views.severity_buckets(load(spark, d, "findings"))


@query("SELECT file_path AS path, count(*) AS n FROM findings WHERE file_path IS NOT NULL GROUP BY 1 ORDER BY n DESC, path LIMIT 5")
def a24_busiest_files(spark, d):
    return views.busiest_files(load(spark, d, "findings").withColumnRenamed("file_path", "path"))


_RANK = "coalesce(list_position(['info', 'low', 'medium', 'high', 'critical'], severity), 1)"


@query(f"WITH {CAUSES} SELECT unit, category, row_number() OVER (ORDER BY {_RANK} DESC, unit, category) AS by_severity, row_number() OVER (ORDER BY evidence_count, unit, category) AS by_evidence FROM causes")
def w10_sorted_causes(spark, d):
    c = report.root_causes(_capped(spark, d)).withColumn("key", F.struct("unit", "category"))
    a = views.ordered(c, "severity", tie="key").select("unit", "category", F.col("row_no").alias("by_severity"))
    return a.join(views.ordered(c, "evidence_count", descending=False, tie="key").select("unit", "category", F.col("row_no").alias("by_evidence")), ["unit", "category"])


@query(f"WITH {CAUSES} SELECT unit, category FROM causes WHERE severity = 'high' AND contains(lower(concat_ws(' ', category, title, advice)), 'split')")
def r14_filtered_causes(spark, d):
    return views.matching(report.root_causes(_capped(spark, d)), "Split", ("category", "title", "advice"), severity="high").select("unit", "category")


@query(f"WITH {KEPT} SELECT unit, path FROM kept WHERE contains(lower(path), 'service')")
def r14_filtered_files(spark, d):
    return views.matching(_kept(spark, d), "service", ("path",)).select("unit", "path")


@query(f"WITH {KEPT} SELECT unit, ordinal, path, ext, size, readable, is_test FROM kept")
def p02_p09_kept_files(spark, d):
    return _kept(spark, d).select("unit", "ordinal", "path", "ext", "size", "readable", "is_test")


@query(f"SELECT file_id FROM scan_files WHERE path IS NOT NULL AND NOT list_has_any(regexp_split_to_array(path, '[/\\\\]'), {_list(sources.UNSENT_FOLDERS)}) AND lower(regexp_extract(path, '\\.([^.]*)$', 1)) NOT IN {tuple(sources.UNSENT_EXTENSIONS)}")
def s03_sent_files(spark, d):
    return sources.sent_files(load(spark, d, "scan_files")).select("file_id")


@query("SELECT run_id, r.repository AS repository, r.execution_log.status AS status, r.execution_log.retries AS retries, coalesce(len(r.execution_log.errors), 0) AS errors FROM (SELECT run_id, unnest(results) AS r FROM validation_runs) WHERE r IS NOT NULL")
def s11_execution_log(spark, d):
    return sources.execution_log(load(spark, d, "validation_runs"))


@query("WITH l AS (SELECT run_id, r.execution_log.status AS status, r.execution_log.retries AS retries, coalesce(len(r.execution_log.errors), 0) AS errors FROM (SELECT run_id, unnest(results) AS r FROM validation_runs) WHERE r IS NOT NULL) SELECT run_id, count(*) AS results, count(*) FILTER (WHERE lower(status) IN ('success', 'completed', 'ok')) AS successful, sum(retries)::BIGINT AS retries, sum(errors)::BIGINT AS errors FROM l WHERE status IS NOT NULL GROUP BY run_id")
def s11_run_summary(spark, d):
    return sources.run_summary(sources.execution_log(load(spark, d, "validation_runs")))


@query(f"WITH {KEPT}, l AS (SELECT unit, path, {_LINES} AS n FROM kept WHERE readable AND code) SELECT unit, path, CASE WHEN n > 1000 THEN 'high' ELSE 'medium' END AS severity, n::DOUBLE AS lines FROM l WHERE n > 600")
def d01_large_files(spark, d):
    return _local(spark, d, "large_file").select("unit", "path", "severity", F.col("metric_value").alias("lines"))


@query(f"""WITH {KEPT}, l AS (SELECT unit, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM kept WHERE readable),
m AS (SELECT unit, path, n, length(regexp_extract(line, '^(.*?)\\b(?:[tT][oO][dD][oO]|[fF][iI][xX][mM][eE]|[hH][aA][cC][kK])\\b', 1)) AS t, CASE WHEN regexp_matches(line, '//|#|--|/\\*|\\*') THEN length(regexp_extract(line, '^(.*?)(?://|#|--|/\\*|\\*)', 1)) ELSE -1 END AS c FROM l WHERE regexp_matches(line, '\\b(todo|fixme|hack)\\b', 'i'))
SELECT unit, path, min(n)::INT AS line FROM m WHERE c = -1 OR t > c GROUP BY unit, path""")
def d02_debt_marks(spark, d):
    return _local(spark, d, "todo_debt").select("unit", "path", "line")


@query(f"WITH {KEPT} SELECT unit, arg_min(path, ordinal) AS path FROM kept GROUP BY unit HAVING count(*) > 5 AND NOT bool_or(is_test)")
def d11_missing_tests(spark, d):
    return findings.untested(_kept(spark, d)).select("unit", "path")


@query(f"""WITH {KEPT}, l AS (SELECT unit, path, ext, unnest(regexp_split_to_array(content, '\\r\\n|\\r|\\n')) AS line FROM kept WHERE readable AND ext IN ('.py', '.rb')), m AS (SELECT unit, path, ext, max(length(regexp_extract(line, '^[ \\t]*'))) AS w FROM l WHERE regexp_matches(line, '\\S') GROUP BY ALL),
x AS (SELECT unit, path, floor(w / CASE WHEN ext = '.py' THEN 4 ELSE 2 END + 0.5) AS depth FROM m) SELECT unit, path, depth::DOUBLE AS depth FROM x WHERE depth >= 6""")
def e05_deep_indent(spark, d):
    return _local(spark, d, "deep_nesting").where("path like '%.py' or path like '%.rb'").select("unit", "path", F.col("metric_value").alias("depth"))


def _transitions(spark, d) -> DataFrame:
    """A graph for the graph operators: per user the kinds of events that follow each other."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, d, "events").select(F.col("user_id").alias("unit"), F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"))
    return e.where("dst is not null")


_GRAPH = """RECURSIVE e AS (SELECT user_id AS unit, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), d AS (SELECT DISTINCT unit, src, dst FROM e WHERE dst IS NOT NULL AND src <> dst),
r AS (SELECT unit, src, dst FROM d UNION SELECT r.unit, r.src, d.dst FROM r JOIN d ON d.unit = r.unit AND d.src = r.dst),
c AS (SELECT a.unit, a.src AS path, max(a.dst) AS component FROM r a JOIN r b ON b.unit = a.unit AND b.src = a.dst AND b.dst = a.src GROUP BY 1, 2)"""


@query(f"WITH {_GRAPH} SELECT unit, path, component FROM c")
def g04_components(spark, d):
    return graph.components(_transitions(spark, d))


@query(f"WITH {_GRAPH}, l AS (SELECT DISTINCT unit, src AS path FROM e WHERE src = dst AND NOT EXISTS (SELECT 1 FROM c WHERE c.unit = e.unit AND c.path = e.src)), u AS (SELECT DISTINCT unit, component FROM c UNION ALL SELECT unit, path FROM l) SELECT unit, count(*) AS cycles FROM u GROUP BY unit")
def g05_component_count(spark, d):
    e = _transitions(spark, d)
    return graph.component_count(e, graph.components(e))


@query("WITH e AS (SELECT user_id AS unit, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), b AS (SELECT unit, src AS path, 1 AS o, 0 AS i, dst AS other FROM e WHERE dst IS NOT NULL UNION ALL SELECT unit, dst, 0, 1, src FROM e WHERE dst IS NOT NULL) SELECT unit, path, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(DISTINCT other) AS neighbours FROM b GROUP BY unit, path")
def g13_degrees(spark, d):
    e = _transitions(spark, d)
    return graph.degrees(e).join(graph.adjacency(e), ["unit", "path"])


def a15_a16_evidence_columns(spark, d):
    """No SQL: it starts from the second metric engine."""
    units = metrics.unit_metrics(metrics.file_metrics(load(spark, d, "scan_files")))
    return metrics.evidence_columns(units, spark.createDataFrame([], "unit bigint, cycles bigint"))


query()(a15_a16_evidence_columns)


def g03_module_edges(spark, d):
    """No SQL: the imports come from masked texts."""
    files, _, imported = detectors.parts(durable(detectors.one_pass(load(spark, d, "scan_files"))))
    return graph.module_edges(imported, files)


query()(g03_module_edges)


_CODES = "list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT)"


@query(f"WITH n AS (SELECT DISTINCT name FROM repo_catalog), h AS (SELECT name, list_reduce({_CODES}, lambda h, c: (h * 31 + c) & 4294967295) AS hash31, list_reduce(list_prepend(2166136261::BIGINT, {_CODES}), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS fnv FROM n) SELECT name, hash31, CASE WHEN hash31 >= 2147483648 THEN hash31 - 4294967296 ELSE hash31 END AS signed_hash, fnv FROM h")
def f4_hashes(spark, d):
    n = load(spark, d, "repo_catalog").select("name").distinct()
    return n.select("name", text.hash31(F.col("name")).alias("hash31"), text.signed_hash31(F.col("name")).alias("signed_hash"), text.fnv1a(F.col("name")).alias("fnv"))


@query("SELECT scan_id, epoch_us(scanned_at) // 1000 AS epoch_ms, strftime(scanned_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, (scanned_at::DATE - 7)::VARCHAR AS week_before FROM scans")
def f5_dates(spark, d):
    at = F.col("scanned_at")
    return load(spark, d, "scans").select("scan_id", dates.epoch_ms(at).alias("epoch_ms"), dates.iso(at).alias("iso"), dates.days_before(at, 7).cast("string").alias("week_before"))
