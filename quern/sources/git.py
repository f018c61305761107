"""Git as a source: changes and commits as DataFrames, parsed from its plain output."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.settings import NEVER, STATE_DIR

FIELD, RECORD = "\x1f", "\x1e"
LOG = f"--pretty=format:%H{FIELD}%h{FIELD}%aI{FIELD}%an{FIELD}%s{FIELD}%b{RECORD}"
CHANGES = "path string, status string, insertions int, deletions int, previous_path string"
COMMITS = "hash string, short_hash string, date string, author string, subject string, body string"


def run(root: str, *args: str) -> str | None:
    """Output of a git command; null if it fails."""
    try:
        done = subprocess.run(["git", *args], cwd=root, capture_output=True, text=True, check=True, errors="replace")
        return done.stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return None


def is_repository(root: str) -> bool:
    return run(root, "rev-parse", "--is-inside-work-tree") == "true"


def current_branch(root: str) -> str | None:
    return run(root, "rev-parse", "--abbrev-ref", "HEAD")


def head_commit(root: str) -> str | None:
    return run(root, "rev-parse", "HEAD")


def short_commit(root: str, ref: str = "HEAD") -> str | None:
    return run(root, "rev-parse", "--short", ref)


def has_uncommitted(root: str) -> bool:
    return bool(run(root, "status", "--porcelain"))


def default_branch(root: str) -> str | None:
    head = run(root, "symbolic-ref", "--quiet", "refs/remotes/origin/HEAD")
    if head:
        return head.replace("refs/remotes/origin/", "")
    return next((b for b in ("main", "master", "develop") if run(root, "rev-parse", "--verify", "--quiet", b)), None)


def file_at(root: str, ref: str, path: str) -> str | None:
    """Text of a file at a ref."""
    return run(root, "show", f"{ref}:{path}")


def _lines(spark: SparkSession, text: str | None) -> DataFrame:
    rows = [(i, x) for i, x in enumerate((text or "").split("\n")) if x.strip()]
    return spark.createDataFrame(rows, "n int, line string")


def name_status(lines: DataFrame) -> DataFrame:
    """(n, path, status, previous_path) of ``git diff --name-status`` lines (n, line)."""
    parts = F.split("line", "\t")
    code, first, second = (F.get(parts, F.lit(i)) for i in range(3))
    renamed = code.startswith("R") & second.isNotNull()
    status = F.when(renamed, "renamed").when(code.startswith("A"), "added").when(code.startswith("D"), "deleted").otherwise("modified")
    return lines.select("n", F.when(renamed, second).otherwise(first).alias("path"), status.alias("status"), F.when(renamed, first).alias("previous_path")).where("path <> ''")


def numstat(lines: DataFrame) -> DataFrame:
    """(path, insertions, deletions) of ``git diff --numstat`` lines; a binary file's dash counts 0."""
    parts = F.split("line", "\t")
    count = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0))
    path = F.array_join(F.slice(parts, 3, 1 << 20), "\t")
    return lines.select(path.alias("path"), count(0).alias("insertions"), count(1).alias("deletions"))


def combined(files: DataFrame, counts: DataFrame) -> DataFrame:
    """Changed files with their line counts, as ``CHANGES`` with n."""
    out = files.join(counts.dropDuplicates(["path"]), "path", "left")
    return out.select("n", "path", "status", F.coalesce("insertions", F.lit(0)).alias("insertions"), F.coalesce("deletions", F.lit(0)).alias("deletions"), "previous_path")


def deduplicated(files: DataFrame) -> DataFrame:
    """One row a path, the first one's status and the largest counts; without state files and folders never analysed."""
    parts = F.split("path", "/")
    own = ~F.col("path").startswith(STATE_DIR + "/") & ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in sorted(NEVER)]))
    first = F.min_by(F.struct("status", "previous_path"), "n").alias("f")
    return files.where(own).groupBy("path").agg(first, F.max("insertions").alias("insertions"), F.max("deletions").alias("deletions")).select("path", "f.status", "insertions", "deletions", "f.previous_path")


def diff(spark: SparkSession, root: str, what: str) -> DataFrame:
    """Changes against a ref or over a range."""
    files = name_status(_lines(spark, run(root, "diff", "--name-status", what)))
    return combined(files, numstat(_lines(spark, run(root, "diff", "--numstat", what))))


def untracked(spark: SparkSession, root: str) -> DataFrame:
    lines = _lines(spark, run(root, "ls-files", "--others", "--exclude-standard"))
    return lines.select((F.col("n") + (1 << 30)).alias("n"), F.col("line").alias("path"), F.lit("untracked").alias("status"), F.lit(0).alias("insertions"), F.lit(0).alias("deletions"), F.lit(None).cast("string").alias("previous_path"))


@dataclass(frozen=True)
class Changes:
    description: str
    base: str | None
    files: DataFrame


def detect_changes(spark: SparkSession, root: str, base: str | None = None, include_untracked: bool = True) -> Changes | None:
    """What changed: against ``base`` if given, else uncommitted, else on this branch, else in the last commit."""
    if not is_repository(root):
        return None
    if base:
        return Changes(f"changes vs {base}", base, deduplicated(diff(spark, root, base if ".." in base else f"{base}...HEAD")))
    working = diff(spark, root, "HEAD")
    working = working.union(untracked(spark, root)) if include_untracked else working
    if not working.isEmpty():
        return Changes("uncommitted changes vs HEAD", "HEAD", deduplicated(working))
    main, branch = default_branch(root), current_branch(root)
    fork = run(root, "merge-base", main, "HEAD") if main and branch and main != branch else None
    for said, at, what in ((f"branch changes vs {main}", fork, f"{fork}..HEAD"), ("last commit", "HEAD~1", "HEAD~1..HEAD")):
        files = diff(spark, root, what) if at else None
        if files is not None and not files.isEmpty():
            return Changes(said, at, deduplicated(files))
    return Changes("no changes detected", None, spark.createDataFrame([], CHANGES))


def parse_log(records: DataFrame) -> DataFrame:
    """``COMMITS`` of log records (n, record); records without both hashes are left out."""
    parts = F.split(F.regexp_replace("record", r"^\s+|\s+$", ""), FIELD)
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    out = records.select("n", part(0).alias("hash"), part(1).alias("short_hash"), part(2).alias("date"), part(3).alias("author"), part(4).alias("subject"), F.regexp_replace(part(5), r"^\s+|\s+$", "").alias("body"))
    return out.where("hash <> '' and short_hash <> ''")


def _log(spark: SparkSession, root: str, *args: str) -> DataFrame:
    text = run(root, "log", *args) or ""
    return parse_log(spark.createDataFrame(list(enumerate(text.split(RECORD))), "n int, record string"))


def log(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """All commits, newest first."""
    return _log(spark, root, *([f"-n{limit}"] if limit else []), LOG)


def file_history(spark: SparkSession, root: str, path: str, limit: int = 50) -> DataFrame:
    """Commits of a file across renames, newest first."""
    return _log(spark, root, "--follow", f"-n{limit}", LOG, "--", path)


def file_creation(spark: SparkSession, root: str, path: str) -> DataFrame:
    """The commit that added a file, as one row or none."""
    return _log(spark, root, "--follow", "--diff-filter=A", "-n1", LOG, "--", path)


def commit_count(root: str, path: str) -> int:
    said = run(root, "rev-list", "--count", "HEAD", "--", path) or ""
    return int(said) if said.isdigit() else 0


def commit_files(spark: SparkSession, root: str) -> DataFrame:
    """(hash, n, author, merge, path) of all files of all commits; n counts commits from the newest."""
    text = run(root, "log", f"--pretty=format:{RECORD}%H{FIELD}%an{FIELD}%P{FIELD}", "--name-only") or ""
    records = spark.createDataFrame([(i, r) for i, r in enumerate(text.split(RECORD)) if r.strip()], "n int, record string")
    parts = F.split("record", FIELD)
    path = F.explode(F.filter(F.split(F.get(parts, F.lit(3)), "\n"), lambda p: F.trim(p) != ""))
    return records.select(F.get(parts, F.lit(0)).alias("hash"), "n", F.get(parts, F.lit(1)).alias("author"), (F.size(F.split(F.get(parts, F.lit(2)), " ")) > 1).alias("merge"), path.alias("path"))


def authors(files: DataFrame, path: str) -> DataFrame:
    """(name, commits) of a file, merges left out, most commits first."""
    own = files.where((F.col("path") == path) & ~F.col("merge"))
    return own.groupBy(F.col("author").alias("name")).agg(F.countDistinct("hash").alias("commits")).orderBy(F.desc("commits"), "name")


def co_changed(files: DataFrame, path: str, limit: int = 30) -> DataFrame:
    """(path, times) of the files in the last ``limit`` commits of a file, merges left out.

    The commits are found first, so only their files are joined.
    """
    last = files.where((F.col("path") == path) & ~F.col("merge")).select("hash", "n").distinct().orderBy("n").limit(limit).select("hash")
    others = files.where(F.col("path") != path).join(last, "hash", "left_semi")
    return others.groupBy("path").agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), "path")
