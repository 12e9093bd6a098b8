"""Agreement of findings with evidence from other sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.functions.text import round_half_up


def agreement(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per finding (repository, finding_type, id, confidence) the sources that speak for it.

    ``evidence``: repository, finding_type, source_type, confidence. Two source types or
    more agree by .4 + .15 per type + .03 per item, at most .95; one gives .35, none 0. An
    optional column ``contradicts`` tells evidence that speaks against a finding.
    """
    against = F.count_if("contradicts") if "contradicts" in evidence.columns else F.lit(0)
    e = evidence.groupBy("repository", "finding_type").agg(F.count_distinct("source_type").alias("sources"), F.count(F.lit(1)).alias("items"), F.avg("confidence").alias("other"), against.alias("against"))
    f = findings.join(e, ["repository", "finding_type"], "left").na.fill(0, ["sources", "items", "against"])
    agreed = F.when(F.col("sources") >= 2, F.least(F.lit(0.95), 0.4 + 0.15 * F.col("sources") + 0.03 * F.col("items"))).when(F.col("sources") == 1, 0.35).otherwise(0.0)
    f = f.withColumn("agreement", round_half_up(agreed, 2))
    blend = round_half_up(F.least(F.lit(1.0), F.col("agreement") * 0.6 + F.coalesce("other", F.lit(0.0)) * 0.4), 2)
    contradicted = (F.col("against") > 0) & (F.col("agreement") < 0.5)
    status = F.when(contradicted, "contradicted").when((F.col("sources") >= 3) & (F.col("agreement") >= 0.7), "verified").when((F.col("sources") >= 2) & (F.col("agreement") >= 0.5), "likely_verified").when(F.col("sources") >= 1, "weak_evidence").otherwise("unknown")
    return f.select("repository", "finding_type", "id", "confidence", "sources", "items", "agreement", blend.alias("external_confidence"), status.alias("status"))


def summary(agreed: DataFrame) -> DataFrame:
    """One row: findings by status, mean agreement, confidence and evidence, the most confirmed type and the most contradicted one."""
    s = F.col("status")
    confirmed = s.isin("verified", "likely_verified").cast("int")
    types = agreed.groupBy("finding_type").agg(F.sum(confirmed).alias("yes"), F.count_if(s == "contradicted").alias("no"))
    # of equal types the first by name
    best = types.agg(F.min_by("finding_type", F.struct(-F.col("yes"), F.col("finding_type"))).alias("most_confirmed"), F.min_by("finding_type", F.struct(-F.col("no"), F.col("finding_type"))).alias("most_controversial"))
    counts = agreed.agg(F.count(F.lit(1)).alias("findings"), *(F.count_if(s == n).alias(n) for n in ("verified", "likely_verified", "weak_evidence", "contradicted", "unknown")), round_half_up(F.avg("agreement"), 2).alias("agreement"), round_half_up(F.avg("external_confidence"), 2).alias("confidence"), round_half_up(F.avg("items"), 1).alias("evidence"))
    return counts.join(best, F.lit(True))


def false_positives(agreed: DataFrame) -> DataFrame:
    """Sure findings that nothing else supports."""
    return agreed.where("confidence > 0.75 and agreement < 0.4")


def false_negatives(evidence: DataFrame, findings: DataFrame) -> DataFrame:
    """Evidence of a kind that the repository has no finding of."""
    return evidence.join(findings.select("repository", "finding_type").distinct(), ["repository", "finding_type"], "left_anti")


def evidence_graph(agreed: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (repository, finding, source) and the edges between them."""
    nodes = agreed.select(F.col("repository").alias("node_id"), F.lit("repository").alias("node_type")).distinct().unionByName(agreed.select(F.col("id").alias("node_id"), F.lit("finding").alias("node_type"))).unionByName(evidence.select(F.col("source_type").alias("node_id"), F.lit("source").alias("node_type")).distinct())
    own = agreed.select(F.col("id").alias("source_id"), F.col("repository").alias("target_id"), F.lit("belongs_to").alias("edge_type"))
    says = agreed.join(evidence.select("repository", "finding_type", "source_type").distinct(), ["repository", "finding_type"]).select(F.col("source_type").alias("source_id"), F.col("id").alias("target_id"), F.when(F.col("status").isin("verified", "likely_verified"), "confirms").otherwise("mentions").alias("edge_type"))
    return nodes, own.unionByName(says)
