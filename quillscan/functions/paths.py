"""Path functions: normal form, extension, language family and the skip rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders that hold no source of the project.
SKIP_SEGMENTS = (
    ".git .next .turbo .cache node_modules dist build coverage htmlcov analysis-results vendor fixtures __pycache__ backups backup bak old archive archived backup-files snapshots "
    "temp tmp .pytest_cache .mypy_cache .ruff_cache .venv venv env .idea .vscode .vs .ds_store .yarn .pnp .pnpm-store .terraform .serverless .amplify .aws-sam "
    "playwright-report playwright_report test-results test_results traces .playwright-artifacts allure-results allure_report cypress screenshots test-results-reports html-reports"
).split()
# ``.DS_Store`` is listed by the rules in mixed case and paths are compared in lower case, so it never matches.
SKIP_SEGMENTS.remove(".ds_store")
# File names and endings that tools write.
SKIP_NAMES = "coverage.xml package-lock.json pnpm-lock.yaml yarn.lock package-lock.yaml bun.lock bun.lockb flake.lock poetry.lock go.sum composer.lock".split()
SKIP_ENDINGS = ".min.js .min.css .map .pyc".split()
GENERATED = r"(?i)[-.]gen\.(css|js|ts|tsx|jsx)$|\.generated\.|\.min\.(css|js|jsx|ts)$|\.bundle\.(js|css)$|\.chunk\.(js|css)$|(^|/)generated/.*\.(css|js|json|ts|tsx)$|\.(css|js|ts)\.map$"
ENCRYPTED = r"(?i)\.(encrypted|enc)\.[a-z0-9]+$|\.(gpg|age|lockbox|vault)$"
TEMPORARY = r"(?i)(^|/)temp[_-]|\.(tmp|temp)$"
BACKUP_SEGMENT = r"^\.?backup|backup[-_.]\d{6,}"
BACKUP_NAME = r"\.(backup|bak)\.[a-z0-9]+$"
TEST_FILE = r"(?i)(^|[/\\_.-])tests?([/\\_.-]|$)|__tests__|\.(test|spec)\.|(^|[/\\])test[_\-]"
CODE_EXTENSIONS = ".ts .tsx .js .jsx .mjs .cjs .py .java .kt .go .rs .cs .php .rb .swift .c .cc .cpp .h .hpp .css .scss .html .vue .svelte .sql .sh .ps1".split()
TEXT_EXTENSIONS = CODE_EXTENSIONS + ".json .md .env .yaml .yml .toml .xml .ini .cfg".split()
MANIFESTS = "package.json requirements.txt pyproject.toml pom.xml build.gradle Cargo.toml go.mod composer.json Gemfile".split()
MAX_TEXT_BYTES = 1024 * 1024


def normal_path(path: Column) -> Column:
    """``/`` only, without a leading ``/`` and without empty, ``.`` and ``..`` segments."""
    return F.array_join(F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: ~s.isin("", ".", "..")), "/")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_of(path: Column) -> Column:
    """The last suffix in lower case, with its dot; none where the dot leads the name."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1))


def family_of(ext: Column) -> Column:
    return F.when(ext == ".py", "python").when(ext == ".rb", "ruby").otherwise("brace")


def is_test(path: Column) -> Column:
    return path.rlike(TEST_FILE)


def skipped(path: Column, ignored: Column | None = None) -> Column:
    """Is a normal path outside the analysis? ``ignored``: the ignore file's segments, or null."""
    low = F.lower(path)
    parts = F.split(low, "/")
    name = base_name(low)
    out = (
        F.arrays_overlap(parts, F.array(*map(F.lit, SKIP_SEGMENTS)))
        | F.exists(parts, lambda p: p.rlike(BACKUP_SEGMENT))
        | name.rlike(BACKUP_NAME)
        | name.isin(*SKIP_NAMES)
        | F.reduce(F.array(*map(F.lit, SKIP_ENDINGS)), F.lit(False), lambda hit, e: hit | name.endswith(e))
        | path.rlike(GENERATED)
        | path.rlike(ENCRYPTED)
        | path.rlike(TEMPORARY)
    )
    if ignored is None:
        return out
    framed = F.concat(F.lit("/"), low, F.lit("/"))
    return out | F.coalesce(F.exists(ignored, lambda s: F.contains(framed, F.concat(F.lit("/"), s, F.lit("/")))), F.lit(False))


def ignored_segments(text: Column) -> Column:
    """The plain lines of an ignore file: no comments, negations or patterns."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    plain = F.filter(lines, lambda s: (s != "") & ~s.startswith("#") & ~s.startswith("!") & ~s.rlike(r"[*?\[\]{}]"))
    clean = F.transform(plain, lambda s: F.lower(F.regexp_replace(s, r"^/+|/+$", "")))
    return F.filter(clean, lambda s: ~s.isin("", ".", ".."))
