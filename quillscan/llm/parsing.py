"""Problem 7: source files that do not parse."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.llm.grammars import BY_EXTENSION
from quillscan.session import spread

CONFLICT = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?=[ \r\n]|\Z)", re.M)
MARKUP = re.compile(r"\s*(?:<!DOCTYPE\b|<\?(?:xml|php)\b|<html\b|#!\s*/\S*\b(?:ba|z|k)?sh\b|#include\s*[<\"])", re.I)
OPENED = re.compile(r"\"\"\"|'''|/\*|[\"'`]")
LINES_OF_A_LANGUAGE = 3


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def _unfinished(text: str, far: int) -> bool:
    """Does the text end where a longer one could go on: at its end, or inside a literal or comment that nothing closes?"""
    end = len(text.rstrip())
    if far >= end - 1:
        return True
    if text[far] == "}" and "`" in text[:far]:  # the rest of a template
        return "`" not in text[far:]
    m = OPENED.match(text, far)
    if not m:
        return False
    closed = {"/*": "*/"}.get(m[0], m[0])
    return text.find(closed, m.end()) < 0 and (len(m[0]) > 1 or m[0] == "`" or "\n" not in text[far:end])


def cause(ext: str, text: str, far: int) -> str:
    """Why a text was refused with its furthest failure at ``far``.

    ``conflict``: a line of conflict marks at or before the failure. ``language``: markup or
    a script of another kind, or three lines or more that another grammar takes as a whole.
    ``truncated``: the text ends where a longer one could go on. ``syntax``: the rest.
    """
    if (m := CONFLICT.search(text)) and m.start() <= far:
        return "conflict"
    if MARKUP.match(text) or sum(1 for x in text.split("\n") if x.strip()) >= LINES_OF_A_LANGUAGE and any(g.check(text)[0] for e, g in BY_EXTENSION.items() if e != ext and {e, ext} != {"js", "ts"}):
        return "language"
    return "truncated" if _unfinished(text, far) else "syntax"


def refused(ext: str, text: str) -> bool:
    return bool(text.strip()) and not BY_EXTENSION[ext].check(text)[0]


def failure(ext: str, text: str) -> tuple[bool, int | None, str | None]:
    """(parses, furthest failure position in the text, cause)."""
    ok, far = BY_EXTENSION[ext].check(text)
    return (True, None, None) if ok else (False, far, cause(ext, text, far))


def _texts(files: DataFrame, id_col: str, keep: list[str]) -> DataFrame:
    picked = files.select(F.col(id_col).alias("id"), *keep, extension(F.col("path")).alias("ext"), F.col("content").alias("_text"))
    return spread(picked.where(F.col("ext").isin(*BY_EXTENSION) & (F.length("_text") > 0)))


def parsed(files: DataFrame, id_col: str = "file_id", keep: list[str] | None = None) -> DataFrame:
    """``id, ext, parses, failed_at, cause`` of each non-blank file of a known language.

    Null, empty and blank contents, null paths and other extensions give no row; repeated
    files are judged each; ``keep`` names columns that go along. Depth and length have no
    bound but memory.
    """
    keep = keep or []
    kinds = ", ".join([f"id {files.schema[id_col].dataType.simpleString()}", *(f"{c} {files.schema[c].dataType.simpleString()}" for c in keep), "ext string, parses boolean, failed_at bigint, cause string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[f["_text"].str.strip() != ""]
            got = pd.DataFrame([failure(e, t) for e, t in zip(f["ext"], f["_text"])], columns=["parses", "failed_at", "cause"], index=f.index)
            yield pd.concat([f[["id", *keep, "ext"]], got.astype({"failed_at": "Int64"})], axis=1)

    return _texts(files, id_col, keep).mapInPandas(run, kinds)


def unparsable(files: DataFrame) -> DataFrame:
    """``file_id`` of the files that ``parsed`` refuses, without looking for causes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.loc[[refused(e, t) for e, t in zip(f["ext"], f["_text"])], ["id"]].rename(columns={"id": "file_id"})

    return _texts(files, "file_id", []).mapInPandas(run, f"file_id {files.schema['file_id'].dataType.simpleString()}")


def failure_rates(files: DataFrame, scans: DataFrame) -> DataFrame:
    """Per repository and extension: parsed and failed files, their rate, causes, and the files that the scans count."""
    each = parsed(files, keep=["repo"]).groupBy("repo", "ext").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(~F.col("parses")).alias("failed"),
        F.avg(F.when(F.col("parses"), 0.0).otherwise(1.0)).alias("rate"),
        *(F.count_if(F.col("cause") == c).alias(c) for c in ("conflict", "truncated", "language", "syntax")),
    )
    counted = scans.select("repo", F.explode("extension_counts").alias("key", "n")).groupBy("repo", F.regexp_replace(F.lower("key"), "^\\.", "").alias("ext")).agg(F.sum("n").alias("counted_by_scans"))
    return each.join(counted, ["repo", "ext"], "left")
