"""Root causes, plan, knowledge graph and claims as projections of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillscan.functions.text import round_half_up

#: Categories that have a root cause (magic numbers have none), with what to do about them.
CAUSES = {
    "hardcoded_secret": ("Secrets live in the source", "Move secrets to a store and rotate them"), "command_injection": ("Commands are built from data", "Pass arguments as lists and check them"), "weak_crypto": ("Broken hash or cipher in use", "Use SHA-256 or a modern cipher"),
    "long_function": ("Functions do too much", "Split long functions"), "high_complexity": ("Decisions pile up in one place", "Break decisions into tables or functions"), "deep_nesting": ("Blocks nest too deep", "Return early"), "large_file": ("Files hold several modules", "Split large files"),
    "empty_handler": ("Errors vanish", "Handle or log each error"), "todo_debt": ("Work was put off", "Schedule the marked work"), "god_class": ("A class knows too much", "Part the class by task"), "tight_coupling": ("Modules lean on many others", "Cut imports behind an interface"),
    "circular_dependency": ("Modules import each other", "Turn one direction around"), "missing_tests": ("Nothing checks the code", "Add tests for the main paths"),
}


def templates(found: DataFrame) -> DataFrame:
    return found.sparkSession.createDataFrame([(c, t, a) for c, (t, a) in CAUSES.items()], "category string, title string, advice string")


def root_causes(capped: DataFrame, most: int = 5, unit: str = "unit", path: str = "path", seq: str = "ev_seq") -> DataFrame:
    """Up to ``most`` causes of a unit: its categories by first appearance that have a template."""
    f = capped.join(F.broadcast(templates(capped)), "category")
    each = f.groupBy(unit, "category", "title", "advice").agg(
        F.count(F.lit(1)).alias("evidence_count"),
        round_half_up(F.avg(F.coalesce("confidence", F.lit(0.8))), 2).alias("confidence"),
        F.max_by("severity", F.struct(F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0), -F.col(seq))).alias("severity"),
        F.min(seq).alias("first_seq"),
    )
    few = Window.partitionBy(unit, "category").orderBy(seq)
    named = f.select(unit, "category", path, seq).groupBy(unit, "category", path).agg(F.min(seq).alias(seq)).withColumn("n", F.row_number().over(few)).where("n <= 8")
    files = named.groupBy(unit, "category").agg(F.transform(F.array_sort(F.collect_list(F.struct(seq, path))), lambda x: x[path]).alias("affected_files"))
    order = Window.partitionBy(unit).orderBy("first_seq")
    return each.join(files, [unit, "category"], "left").withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= most).drop("first_seq")


def plan_steps(causes: DataFrame) -> DataFrame:
    """One step per cause: hours, sprint, order, expected return, and whether it is a quick win."""
    return causes.select("unit", F.concat(F.lit("step-"), F.col("rank_no").cast("string")).alias("step_id"), "category", F.col("advice").alias("action"), F.when(F.col("severity") == "critical", 8).otherwise(4).alias("hours"), F.lit(1).alias("sprint"), F.col("severity").alias("risk"), (F.col("rank_no") + 0.5).alias("roi"), (F.col("rank_no") <= 2).alias("quick_win"))


def plan_totals(steps: DataFrame) -> DataFrame:
    """Per unit the steps, their hours, the quick wins and the steps of each risk."""
    risks = [F.count_if(F.col("risk") == r).alias(f"{r}_risk") for r in ("critical", "high", "medium", "low")]
    return steps.groupBy("unit").agg(F.count(F.lit(1)).alias("steps"), F.sum("hours").alias("hours"), F.count_if("quick_win").alias("quick_wins"), *risks)


def graph_nodes(files: DataFrame, capped: DataFrame, most: int = 50) -> DataFrame:
    """The repository, its first files and its first findings as nodes."""
    w = Window.partitionBy("unit").orderBy("ordinal", "path")
    first = files.select("unit", "ordinal", "path").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    root = files.select("unit").distinct().select("unit", F.lit("repo").alias("node_id"), F.lit("repository").alias("node_type"), F.lit(None).cast("string").alias("label"))
    file_nodes = first.select("unit", F.concat(F.lit("file-"), F.col("n").cast("string")).alias("node_id"), F.lit("file").alias("node_type"), F.col("path").alias("label"))
    evidence = capped.where(F.col("kept_rank") <= most).select("unit", F.col("id").alias("node_id"), F.lit("evidence").alias("node_type"), F.col("message").alias("label"))
    return root.unionByName(file_nodes).unionByName(evidence)


def graph_edges(nodes: DataFrame, capped: DataFrame) -> DataFrame:
    """Files belong to the repository; findings belong to their file's node, else to the repository."""
    files = nodes.where("node_type = 'file'")
    own = files.select("unit", F.col("node_id").alias("source_id"), F.lit("repo").alias("target_id"), F.lit("belongs_to").alias("edge_type"))
    at = capped.where(F.col("kept_rank") <= 50).select("unit", "id", "path").join(files.select("unit", F.col("label").alias("path"), F.col("node_id").alias("file_node")), ["unit", "path"], "left")
    return own.unionByName(at.select("unit", F.col("id").alias("source_id"), F.coalesce("file_node", F.lit("repo")).alias("target_id"), F.lit("found_in").alias("edge_type")))


def graph_size(files: DataFrame, capped: DataFrame) -> DataFrame:
    """Per unit the nodes that the graph tells: the repository, all files and findings, 101 at most."""
    f, e = files.groupBy("unit").agg(F.count(F.lit(1)).alias("f")), capped.groupBy("unit").agg(F.count(F.lit(1)).alias("e"))
    return f.join(e, "unit", "left").select("unit", F.least(1 + F.col("f") + F.coalesce("e", F.lit(0)), F.lit(101)).alias("total_nodes"))


def claims(causes: DataFrame, capped: DataFrame) -> DataFrame:
    """Per cause the share of confirmed findings, the consensus and the status that it earns."""
    s = F.col("validation_status")
    shares = capped.groupBy("unit", "category").agg(F.avg((s == "verified").cast("double")).alias("confirmed"), F.bool_or(F.coalesce(s == "partial", F.lit(False))).alias("partly"))
    c = F.col("confirmed")
    status = F.when(c >= 0.9, "verified").when((c >= 0.5) | F.col("partly"), "opinion").otherwise("rejected")
    validation = F.when(c >= 0.9, "verified").when(c >= 0.5, "partially_verified").otherwise("unverified")
    return causes.join(shares, ["unit", "category"]).select("unit", "category", "title", "confidence", "confirmed", F.when(c >= 0.9, 2).otherwise(1).alias("consensus"), status.alias("status"), validation.alias("validation"))


def clusters(causes: DataFrame) -> DataFrame:
    """Causes of a unit by severity: a cluster each, with its hypotheses in order."""
    return causes.groupBy("unit", "severity").agg(F.count(F.lit(1)).alias("causes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "title"))), lambda x: x["title"]), "; ").alias("hypotheses"))


def gates(scores: DataFrame, causes: DataFrame) -> DataFrame:
    """Per unit three gates: an overall score of 55 or more, no critical cause, security of 70 or more."""
    worst = causes.groupBy("unit").agg(F.count_if(F.col("severity") == "critical").alias("critical"))
    return scores.join(worst, "unit", "left").select("unit", (F.col("overall") >= 55).alias("score_gate"), (F.coalesce("critical", F.lit(0)) == 0).alias("cause_gate"), (F.col("security") >= 70).alias("security_gate"))


def header(files: DataFrame, found: DataFrame, scores: DataFrame) -> DataFrame:
    """Per unit the scan's summary: files, texts, bytes, lines, directories, files by worst severity, score and grade."""
    rank = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)
    worst = found.where("path is not null").groupBy("unit", "path").agg(F.max(rank).alias("worst"))
    problems = worst.groupBy("unit").agg(*(F.count_if(F.col("worst") == k).alias(n) for k, n in ((3, "critical_files"), (2, "high_files"), (1, "medium_files"), (0, "low_files"))))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    inventory = files.groupBy("unit").agg(F.count(F.lit(1)).alias("files"), F.count_if("readable").alias("text_files"), F.sum("size").alias("bytes"), F.sum("n_lines").alias("lines"), (F.count(F.lit(1)) > 150).alias("truncated"), F.count_distinct(F.when(folder != "", folder)).alias("folders"))
    counts = found.groupBy("unit").agg(F.count(F.lit(1)).alias("findings"))
    out = inventory.join(counts, "unit", "left").join(problems, "unit", "left").join(scores.select("unit", "overall", "grade"), "unit", "left")
    return out.na.fill(0, ["findings", "critical_files", "high_files", "medium_files", "low_files"])


def inventory(files: DataFrame, most: int = 150) -> DataFrame:
    """The first files of each unit."""
    return files.withColumn("place", F.row_number().over(Window.partitionBy("unit").orderBy("ordinal", "path"))).where(F.col("place") <= most).select("unit", "place", "path", "ext", "size")


def security_review(found: DataFrame, scores: DataFrame) -> DataFrame:
    """Per unit its security score, the security findings and the severity: critical if any finding is, else info."""
    each = found.groupBy("unit").agg(F.count_if(F.col("finding_type") == "security").alias("security_findings"), F.bool_or(F.coalesce(F.col("severity") == "critical", F.lit(False))).alias("any"))
    out = scores.select("unit", "security").join(each, "unit", "left")
    return out.select("unit", "security", F.coalesce("security_findings", F.lit(0)).alias("security_findings"), F.when(F.col("any"), "critical").otherwise("info").alias("overall_severity"))


def prompt_text(causes: DataFrame, capped: DataFrame) -> DataFrame:
    """Per unit the text that asks for an explanation: its first ten causes and three sure findings with their lines."""
    line = F.concat(F.lit("- ["), "severity", F.lit("] "), "category", F.lit(": "), "title", F.lit(" ("), F.coalesce(F.get(F.array_compact("affected_files"), F.lit(0)), F.lit("")), F.lit(", "), F.col("evidence_count").cast("string"), F.lit(" findings)"))
    asked = causes.where("rank_no <= 10").groupBy("unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", line.alias("line")))), lambda x: x["line"]), "\n").alias("causes"))
    w = Window.partitionBy("unit").orderBy(F.col("kept_rank"))
    sure = capped.where("validation_status = 'verified' and snippet is not null").withColumn("n", F.row_number().over(w)).where("n <= 3")
    shown = F.concat(F.lit("- "), F.coalesce("path", F.lit("")), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("1")), F.lit(": "), F.left(F.regexp_replace("snippet", r"\s+", " "), F.lit(220)))
    snippets = sure.groupBy("unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", shown.alias("line")))), lambda x: x["line"]), "\n").alias("snippets"))
    # The wording of the prompt.
    tail = "Explain the top 3 most important findings; keep the rest brief."
    return asked.join(snippets, "unit", "left").select("unit", F.concat_ws("\n", F.lit("Findings:"), "causes", F.when(F.col("snippets").isNotNull(), F.concat(F.lit("\nKey evidence snippets:\n"), "snippets")), F.lit("\n" + tail)).alias("prompt"))


def answer_sections(answers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, section_no, title, body, confidence`` of an answer: the sections of its JSON, else the whole text as one.

    A fenced block is taken out of its fence and the text from the first to the last brace
    is read. Sections without title and body are left out; an unknown confidence is medium.
    """
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"^\s+|\s+$", "")
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    candidate = F.when(fenced != "", fenced).otherwise(text)
    braced = F.regexp_extract(candidate, r"(?s)(\{.*\})", 1)
    kind = "sections array<struct<title:string,body:string,confidence:string>>"
    held = F.filter(F.from_json(braced, kind)["sections"], lambda s: (F.coalesce(s["title"], F.lit("")) != "") | (F.coalesce(s["body"], F.lit("")) != ""))
    sure = lambda c: F.when(c.isin("high", "medium", "low"), c).otherwise("medium")
    read = F.transform(held, lambda s: F.struct(F.coalesce(F.nullif(s["title"], F.lit("")), F.lit("Explanation")).alias("title"), F.coalesce(s["body"], F.lit("")).alias("body"), sure(s["confidence"]).alias("confidence")))
    whole = F.array(F.struct(F.lit("Explanation").alias("title"), F.coalesce(F.nullif(text, F.lit("")), F.lit("Empty answer.")).alias("body"), F.lit("medium").alias("confidence")))
    rows = answers.select(F.col(id_col).alias("id"), F.posexplode(F.when(F.size(read) > 0, read).otherwise(whole)).alias("section_no", "s"))
    return rows.select("id", "section_no", "s.title", "s.body", "s.confidence")


def phases(files: DataFrame, capped: DataFrame, causes: DataFrame, edges: DataFrame, scores: DataFrame) -> DataFrame:
    """Per unit with files how many of nine phases left something: repository, inventory, dependencies, metrics, evidence, graph, causes, plan, review."""
    has = lambda df, name: df.select("unit").distinct().withColumn(name, F.lit(1))
    parts = {"dependencies": edges, "metrics": capped.where(F.col("finding_type").isin("metric", "complexity")), "evidence": capped, "causes": causes, "review": scores}
    out = files.select("unit").distinct()
    for name, df in parts.items():
        out = out.join(has(df, name), "unit", "left")
    out = out.na.fill(0, list(parts))
    # the repository, its inventory and its graph are there with the files; a plan has a step per cause
    return out.select("unit", (F.lit(3) + F.col("dependencies") + F.col("metrics") + F.col("evidence") + 2 * F.col("causes") + F.col("review")).alias("phases"))
