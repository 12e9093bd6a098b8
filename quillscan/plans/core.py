"""Registered queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillscan.operators import detectors, flatten, metrics, report, schema_drift
from quillscan.plans import analytics, reports  # noqa: F401 - reports registers its queries with those of analytics
from quillscan.plans.pipeline import Analysis, analyse
from quillscan.session import load
from quillscan.sources import files as sources


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.drift(load(spark, sf_dir, "result_exports"))


def p1_table_analysis_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.migrated(load(spark, sf_dir, "result_exports"), "analysis_result", "classification")


def p1_table_demo_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.migrated(load(spark, sf_dir, "result_exports"), "demo_result", "engineering_review")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = flatten.flatten_arrays(load(spark, sf_dir, "validation_runs"), "run_id", ["failures", "results"])
    graphs = flatten.flatten_json(load(spark, sf_dir, "demo_results"), "result_id", "knowledge_graph")
    return runs.unionByName(graphs).select("child_table", "record_id", "pos_path")


def p6_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of p6_found that comes from typed columns."""
    return flatten.flatten_arrays(load(spark, sf_dir, "validation_runs"), "run_id", ["failures", "results"]).select("child_table", "record_id", "pos_path")


def p6_smells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.child_table(load(spark, sf_dir, "validation_runs"), "run_id", "results", "results.smells")


def _analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    return analyse(load(spark, sf_dir, "scan_files"))


def pipeline_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).raw


def pipeline_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).capped


def pipeline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).scores


def pipeline_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.root_causes(_analysis(spark, sf_dir).capped)


def pipeline_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.plan_steps(report.root_causes(_analysis(spark, sf_dir).capped))


def pipeline_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = _analysis(spark, sf_dir).capped
    return report.claims(report.root_causes(capped), capped)


def pipeline_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analysis(spark, sf_dir)
    return report.graph_nodes(a.files, a.capped)


def pipeline_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analysis(spark, sf_dir)
    return report.graph_edges(report.graph_nodes(a.files, a.capped), a.capped)


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).edges


def import_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).cycles


def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.file_metrics(load(spark, sf_dir, "scan_files"))


def unit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.unit_metrics(file_metrics(spark, sf_dir))


def architecture_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.architecture_labels(detectors.kept_files(load(spark, sf_dir, "scan_files")))


def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analysis(spark, sf_dir)
    return sources.report_text(a.scores, report.root_causes(a.capped))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_found, p1_table_analysis_result, p1_table_demo_result, p6_found, p6_runs, p6_smells, pipeline_findings, pipeline_capped, pipeline_scores, pipeline_causes, pipeline_steps, pipeline_claims, pipeline_nodes, pipeline_edges, import_edges, import_cycles, file_metrics, unit_metrics, architecture_labels, report_texts]
    return {f.__name__: f for f in own} | analytics.QUERIES


_ARRAYS = ["classification.secondary_languages", *(f"architecture.{x}" for x in ("detected_patterns", "detected_smells", "detected_root_causes", "recommendations")), "smells", "false_positive_candidates", "execution_log.errors"]
_RUNS = [
    "WITH r AS (SELECT run_id, unnest(results) AS r, generate_subscripts(results, 1) - 1 AS i FROM validation_runs),",
    "s AS (SELECT run_id, i, unnest(r.smells) AS s, generate_subscripts(r.smells, 1) - 1 AS j FROM r WHERE r IS NOT NULL)",
    "SELECT 'failures' AS child_table, run_id AS record_id, CAST(i AS VARCHAR) AS pos_path FROM (SELECT run_id, unnest(failures) AS e, generate_subscripts(failures, 1) - 1 AS i FROM validation_runs) WHERE e IS NOT NULL",
    "UNION ALL SELECT 'results', run_id, CAST(i AS VARCHAR) FROM r WHERE r IS NOT NULL",
    *(f"UNION ALL SELECT 'results.{a}', run_id, i || '.' || j FROM (SELECT run_id, i, unnest(r.{a}) AS e, generate_subscripts(r.{a}, 1) - 1 AS j FROM r WHERE r IS NOT NULL) WHERE e IS NOT NULL" for a in _ARRAYS),
    "UNION ALL SELECT 'results.smells.evidence_ids', run_id, i || '.' || j || '.' || k FROM (SELECT run_id, i, j, unnest(s.evidence_ids) AS e, generate_subscripts(s.evidence_ids, 1) - 1 AS k FROM s WHERE s IS NOT NULL) WHERE e IS NOT NULL",
]

SQL = analytics.SQL | {
    "p6_runs": "\n".join(_RUNS),
    "p6_smells": """
WITH r AS (SELECT run_id, unnest(results) AS res, generate_subscripts(results, 1) - 1 AS i FROM validation_runs),
s AS (SELECT run_id, i, unnest(res.smells) AS e, generate_subscripts(res.smells, 1) - 1 AS j FROM r WHERE res IS NOT NULL)
SELECT run_id AS record_id, i || '.' || j AS pos_path, CAST(i AS VARCHAR) AS parent_pos, e.smell AS smell, e.severity AS severity, e.confidence AS confidence
FROM s WHERE e IS NOT NULL
""",
}
