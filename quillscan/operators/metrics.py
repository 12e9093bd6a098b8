"""A second metric engine: lines, declarations and scopes per file for several languages."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.functions.text import round_half_up
from quillscan.operators import detectors, structure
from quillscan.operators.masking import mask

#: Extensions, scope style, and patterns of classes and functions per language.
LANGUAGES: dict[str, tuple[list[str], str, str, str]] = {
    "python": ([".py"], "indent", r"^\s*class\s+(\w+)", r"^\s*(?:async\s+)?def\s+(\w+)"),
    "ruby": ([".rb"], "end", r"^\s*(?:class|module)\s+(\w+)", r"^\s*def\s+(?:self\.)?(\w+[?!]?)"),
    "javascript": ([".js", ".jsx", ".mjs", ".cjs"], "brace", r"\bclass\s+(\w+)", r"\bfunction\s*\*?\s+(\w+)\s*\(|\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"),
    "typescript": ([".ts", ".tsx"], "brace", r"\b(?:class|interface)\s+(\w+)", r"\bfunction\s*\*?\s+(\w+)\s*[(<]|\b(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>"),
    "java": ([".java"], "brace", r"\b(?:class|interface|enum|record)\s+(\w+)", r"\b(?:public|private|protected|static)\s+[\w<>\[\],\s]+?\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+[\w,\s]+)?\{"),
    "go": ([".go"], "brace", r"\btype\s+(\w+)\s+(?:struct|interface)\b", r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)\s*\("),
    "rust": ([".rs"], "brace", r"\b(?:struct|enum|trait)\s+(\w+)", r"\bfn\s+(\w+)"),
    "csharp": ([".cs"], "brace", r"\b(?:class|interface|struct|record)\s+(\w+)", r"\b(?:public|private|protected|internal|static)\s+[\w<>\[\],\s]+?\s+(\w+)\s*\([^)]*\)\s*\{"),
    "php": ([".php"], "brace", r"\b(?:class|interface|trait)\s+(\w+)", r"\bfunction\s+(\w+)\s*\("),
    "kotlin": ([".kt"], "brace", r"\b(?:class|interface|object)\s+(\w+)", r"\bfun\s+(?:<[^>]*>\s*)?(\w+)\s*\("),
    "swift": ([".swift"], "brace", r"\b(?:class|struct|protocol|enum)\s+(\w+)", r"\bfunc\s+(\w+)"),
    "scala": ([".scala"], "brace", r"\b(?:class|object|trait)\s+(\w+)", r"\bdef\s+(\w+)"),
    "c": ([".c", ".h"], "brace", r"\bstruct\s+(\w+)\s*\{", r"^\w[\w\s*]*?\b(\w+)\s*\([^;{]*\)\s*\{"),
    "cpp": ([".cc", ".cpp", ".hpp"], "brace", r"\b(?:class|struct)\s+(\w+)", r"^\w[\w\s*&:<>]*?\b(\w+)\s*\([^;{]*\)\s*(?:const\s*)?\{"),
}
BY_EXTENSION = {e: (name, style, re.compile(c, re.M), re.compile(f, re.M)) for name, (exts, style, c, f) in LANGUAGES.items() for e in exts}


def measure(ext: str, text: str) -> tuple:
    """(language, total lines, code lines, classes, functions, mean and longest function, long functions, large, largest class)."""
    name, style, classes, functions = BY_EXTENSION[ext]
    code = mask(text, patterns=style == "brace" and name in ("javascript", "typescript"))
    total = len(re.split(r"\r\n|\r|\n", text))
    loc = sum(bool(x.strip()) for x in code.splitlines())
    family = {"indent": "python", "end": "ruby", "brace": "brace"}[style]
    outline = structure.Outline(code, family)
    at = lambda m: m.start() + len(m[0]) - len(m[0].lstrip())
    spans = [(s.start, s.lines + 1) for m in functions.finditer(code) if (s := outline.body(at(m), m.end())) and s.closed]
    starts = sorted(s for s, _ in spans)
    bodies = [(at(m), outline.body(at(m), m.end())) for m in classes.finditer(code)]
    held = [bisect_left(starts, s.end) - bisect_right(starts, start) if s else 0 for start, s in bodies]
    lengths = [n for _, n in spans]
    return name, total, loc, len(held), len(spans), sum(lengths) / len(lengths) if lengths else 0.0, max(lengths, default=0), sum(n > 50 for n in lengths), loc > 500, max(held, default=0)


COLUMNS = "language string, total_lines int, loc int, classes int, functions int, mean_function double, longest_function int, long_functions int, large_file boolean, methods int"


def file_metrics(files: DataFrame, unit: str = "scan_id") -> DataFrame:
    """Metrics of each readable file of a known language; of repeated paths in a unit the first counts."""
    kinds = dict(c.split() for c in COLUMNS.split(", "))
    key = ["row_no", "unit", "ordinal", "path", "digest", "ignored"]
    keys = {c: detectors.FILE[c] for c in key}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [measure(e, t) if t and e in BY_EXTENSION else (None,) * len(kinds) for e, t in zip(b["ext"].to_pylist(), b["text"].to_pylist())]
            arrays = [b[c].cast(detectors.ARROW[t]) for c, t in keys.items()] + [pa.array([x[k] for x in got], detectors.ARROW[t]) for k, t in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *kinds])

    rows = detectors.candidates(files, unit).select(*key, "ext", "text").mapInArrow(run, detectors.schema(keys, kinds))
    return detectors.first_of_paths(rows).where("language is not null").select("unit", "path", *kinds)


def unit_metrics(metrics: DataFrame) -> DataFrame:
    """Sums over the files of a unit; the mean function length is the mean of the files that have functions."""
    return metrics.groupBy("unit").agg(
        F.count(F.lit(1)).alias("files"), F.sum("total_lines").alias("total_lines"), F.sum("loc").alias("loc"), F.sum("classes").alias("classes"), F.sum("functions").alias("functions"), round_half_up(F.avg(F.when(F.col("mean_function") > 0, F.col("mean_function"))), 2).alias("mean_function"),
        F.max("longest_function").alias("longest_function"), F.sum("long_functions").alias("long_functions"), F.count_if("large_file").alias("large_files"), F.count_if(F.col("methods") > structure.METHODS).alias("god_classes"),
    )


def evidence_columns(units: DataFrame, cycles: DataFrame) -> DataFrame:
    """Per unit what its metrics stand for: findings by severity and analyzer, causes, smells, recommendations, coverage.

    ``cycles``: unit, cycles; a unit without a row has none.
    """
    c = F.col
    u = units.join(cycles, "unit", "left").withColumn("cycles", F.coalesce("cycles", F.lit(0)))
    gods, loops, large, long = c("god_classes") > 0, c("cycles") > 0, c("large_files") > 3, (F.coalesce("mean_function", F.lit(0.0)) > 50) | (c("long_functions") > 0)
    listed = lambda *names: F.array_compact(F.array(*(F.when(rule, F.lit(n)) for rule, n in zip((gods, loops, large, long), names))))
    # Names and weights of causes and smells.
    causes = listed("god_class", "circular_dependency", "large_file", "long_method")
    total = c("long_functions") + c("god_classes") + c("cycles") + c("large_files")
    return u.select(
        "unit", c("cycles").alias("critical"), (c("long_functions") + c("god_classes")).alias("high"), c("large_files").alias("medium"), F.lit(0).alias("low"),
        c("long_functions").alias("complexity_analyzer"), c("cycles").alias("import_analyzer"), c("large_files").alias("metrics_engine"), c("god_classes").alias("architecture_analyzer"),
        causes.alias("causes"), listed("God Component:high:0.85", "Cyclic Dependency:high:0.92", "Architecture Sink:medium:0.75", "Blob Module:medium:0.70").alias("smells"),
        F.size(causes).alias("recommendations"), (gods.cast("int") + loops.cast("int")).alias("verified_recommendations"),
        F.when(total > 0, F.least(F.lit(100.0), round_half_up(100.0 * total / F.greatest(F.lit(1), 2 * F.size(causes))))).when(c("files") > 0, 100.0).otherwise(0.0).alias("coverage"),
    )


# Folder names that speak for an architecture.
LABELS = {
    "layered": ["controllers", "services", "models"], "mvc": ["controllers", "views", "models"], "hexagonal": ["ports", "adapters"], "domain": ["domain"], "microservices": ["services"], "monorepo": ["packages", "apps"], "event-driven": ["events", "consumers", "producers"], "plugin": ["plugins", "extensions"], "component": ["components"],
}


def architecture_labels(kept: DataFrame) -> DataFrame:
    """``unit, labels``: a label applies if the unit has all folders that speak for it."""
    dirs = kept.select("unit", F.explode(F.split(F.lower(F.regexp_replace("path", r"/?[^/]*$", "")), "/")).alias("dir")).groupBy("unit").agg(*(F.bool_or(F.col("dir") == d).alias(d) for d in sorted({x for v in LABELS.values() for x in v})))
    hits = [F.when(F.expr(" and ".join(f"`{d}`" for d in v)), F.lit(k)) for k, v in LABELS.items()]
    return dirs.select("unit", F.array_compact(F.array(*hits)).alias("labels"))
