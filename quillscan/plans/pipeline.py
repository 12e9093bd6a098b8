"""The whole analysis: files -> findings -> validated -> capped -> scores and reports.

The texts are read once. Checkpoints hold what that reading found, the resolved imports
and the validated findings; all are narrow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from quillscan.operators import detectors, findings, graph, score
from quillscan.session import durable


@dataclass
class Analysis:
    files: DataFrame
    edges: DataFrame
    cycles: DataFrame
    raw: DataFrame
    capped: DataFrame

    @property
    def scores(self) -> DataFrame:
        return score.health(self.files, self.raw)


def analyse(files: DataFrame, unit: str = "scan_id") -> Analysis:
    """All repositories of a table in one job; a unit is one scan of one repository."""
    kept, local, imported = detectors.parts(durable(detectors.one_pass(files, unit)))
    edges = durable(graph.import_edges(imported, kept))
    cycles = graph.components(edges)
    raw = durable(findings.validated(findings.all_findings(kept, local, edges, cycles)))
    return Analysis(kept, edges, cycles, raw, findings.capped(raw))
