"""What a project remembers between runs: baseline, history, the last run and the parse cache, as Parquet.

Every table carries its version; one of another version reads as no rows.
"""

from __future__ import annotations

import os
import shutil
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.extract import PARSED, parse_files
from quern.plans import settings as S
from quern.sources import git
from quern.sources.project import read_texts

BASELINE_VERSION, HISTORY_VERSION, SNAPSHOT_VERSION, CACHE_VERSION = "1", "1", "1", "3"
MAX_HISTORY = 50
METRICS = ("overall", "architecture", "maintainability", "complexity", "dependencies", "typeSafety")
STATS = ("files", "layeredFiles", "linesOfCode", "functions", "cycles", "layerViolations", "layerSkips", "crossFeatureImports", "largeFiles", "largeFunctions", "deeplyNested", "complexFunctions", "duplicateBlocks", "anyUsages", "suppressions", "unsafeAssertions", "jsFilesInTsProject", "unresolvedImports", "maxImportDepth")
FINDING = "id string, fingerprint string, severity string, category string, file string, line int, title string, message string, detail array<string>, suggestion string, baseline string, current string"
_METRICS = ", ".join(f"{m} long" for m in METRICS)
BASELINE = f"version string, created_at string, commit string, branch string, config_fingerprint string, metrics struct<{', '.join(f'{m}:bigint' for m in METRICS)}>, stats struct<{', '.join(f'{s}:bigint' for s in STATS)}>"
HISTORY = "version string, id long, at string, kind string, commit string, branch string, status string, baseline_overall long, errors long, warnings long, infos long, note string, " + _METRICS
SNAPSHOT = "version string, at string, command string, number long, fingerprint string, id string, severity string, title string, file string, line int"
CACHE = f"version string, tool string, mtime long, size long, {PARSED}, text string"


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


class State:
    """Tables of one project's state folder; each write goes to a fresh folder before the name turns to it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _pointer(self, name: str) -> str:
        return os.path.join(self.root, S.STATE_DIR, name, "CURRENT")

    def read(self, name: str, schema: str, version: str) -> DataFrame:
        """A table's rows of ``version``; none where it was never written."""
        pointer = self._pointer(name)
        if not os.path.exists(pointer):
            return self.spark.createDataFrame([], schema)
        with open(pointer, encoding="utf-8") as f:
            path = os.path.join(os.path.dirname(pointer), f.read().strip())
        return self.spark.read.schema(schema).parquet(path).where(F.col("version") == version)

    def write(self, name: str, rows: DataFrame) -> str:
        S.state_dir(self.root)
        fresh = uuid.uuid4().hex
        path = os.path.join(os.path.dirname(self._pointer(name)), fresh)
        rows.write.parquet(path)
        with open(self._pointer(name) + ".new", "w", encoding="utf-8") as f:
            f.write(fresh)
        held = self._held(name)
        os.replace(self._pointer(name) + ".new", self._pointer(name))
        folder = os.path.dirname(self._pointer(name))
        for old in os.listdir(folder):  # the version before stays for those who still read it
            if old not in ("CURRENT", fresh, held):
                shutil.rmtree(os.path.join(folder, old), ignore_errors=True)
        return path

    def _held(self, name: str) -> str | None:
        try:
            with open(self._pointer(name), encoding="utf-8") as f:
                return f.read().strip()
        except OSError:
            return None

    # baseline ---------------------------------------------------------------

    def baseline(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(one row or none of ``BASELINE``, its findings, its file metrics)."""
        return (
            self.read("baseline", BASELINE, BASELINE_VERSION),
            self.read("baseline-findings", FINDING + ", version string", BASELINE_VERSION).drop("version"),
            self.read("baseline-files", "path string, lines int, sloc int, functions long, maxComplexity int, version string", BASELINE_VERSION).drop("version"),
        )

    def write_baseline(self, row: DataFrame, findings: DataFrame, file_metrics: DataFrame) -> None:
        version = F.lit(BASELINE_VERSION).alias("version")
        self.write("baseline-findings", findings.select(*[f.split()[0] for f in FINDING.split(", ")], version))
        self.write("baseline-files", file_metrics.select("path", "lines", "sloc", "functions", "maxComplexity", version))
        self.write("baseline", row)

    def build_baseline(self, metrics: DataFrame, stats: DataFrame, settings: S.Settings) -> DataFrame:
        """One row of ``BASELINE`` from one row each of scores and counts."""
        pack = lambda names: F.struct(*[F.col(n).cast("long").alias(n) for n in names])
        lit = lambda x: F.lit(x).cast("string")
        both = metrics.select(*METRICS).join(F.broadcast(stats.select(*STATS)), how="cross")
        return both.select(lit(BASELINE_VERSION).alias("version"), lit(now()).alias("created_at"), lit(git.head_commit(self.root)).alias("commit"), lit(git.current_branch(self.root)).alias("branch"), lit(S.fingerprint(settings)).alias("config_fingerprint"), pack(METRICS).alias("metrics"), pack(STATS).alias("stats"))

    # history ------------------------------------------------------------------

    def history(self, last: int = MAX_HISTORY) -> DataFrame:
        """The last entries, oldest first."""
        rows = self.read("history", HISTORY, HISTORY_VERSION)
        return rows.orderBy(F.desc("id")).limit(last).orderBy("id")

    def append_history(self, entry: dict) -> int:
        """Add an entry after the last; the oldest beyond ``MAX_HISTORY`` go."""
        held = self.read("history", HISTORY, HISTORY_VERSION)
        number = (held.agg(F.max("id")).first()[0] or 0) + 1
        fresh = self.spark.createDataFrame([entry | {"version": HISTORY_VERSION, "id": number}], HISTORY)
        newest = Window.orderBy(F.desc("id"))  # at most MAX_HISTORY + 1 rows
        self.write("history", held.unionByName(fresh).withColumn("k", F.row_number().over(newest)).where(F.col("k") <= MAX_HISTORY).drop("k"))
        return number

    # the last run ---------------------------------------------------------------

    def snapshot(self) -> DataFrame:
        return self.read("last-run", SNAPSHOT, SNAPSHOT_VERSION)

    def write_snapshot(self, command: str, issues: DataFrame) -> None:
        """Numbered issues of a run."""
        said = [F.lit(SNAPSHOT_VERSION).alias("version"), F.lit(now()).alias("at"), F.lit(command).alias("command")]
        self.write("last-run", issues.select(*said, F.col("number").cast("long").alias("number"), "fingerprint", "id", "severity", "title", "file", "line"))

    # parse cache ------------------------------------------------------------------

    def cached(self, tool: str) -> DataFrame:
        """Parsed rows of this tool's version."""
        return self.read("cache", CACHE, CACHE_VERSION).where(F.col("tool") == tool)

    def save_cache(self, tool: str, rows: DataFrame) -> None:
        """Replace the cache by ``rows`` (columns of ``CACHE`` without version and tool), so that dead paths go."""
        names = [c.split()[0] for c in ("mtime long", "size long")] + [f.name for f in rows.schema if f.name not in ("mtime", "size", "version", "tool")]
        self.write("cache", rows.select(F.lit(CACHE_VERSION).alias("version"), F.lit(tool).alias("tool"), *names))


def parse_cached(state: State, paths: list[str], tool: str) -> DataFrame:
    """Parsed rows of a tree's files, with their text: those whose time and size, or else content, are cached aren't parsed again.

    The cache is replaced by what is returned, so that dead paths go.
    """
    spark, root = state.spark, state.root
    stats = [(p, os.stat(os.path.join(root, p))) for p in paths if os.path.exists(os.path.join(root, p))]
    listing = spark.createDataFrame([(p, s.st_mtime_ns, s.st_size) for p, s in stats], "path string, mtime long, size long")
    cached = state.cached(tool)
    hits, misses = cache_hits(listing, cached)
    asked = [r.path for r in misses.select("path").collect()]
    texts = misses.join(read_texts(spark, root, asked), "path").withColumn("hash", F.substring(F.sha1(F.coalesce("text", F.lit("")).cast("binary")), 1, 16))
    same, new = revalidated(texts, cached)
    names = [c for c in cached.columns if c not in ("version", "tool")]
    parsed = parse_files(new).join(listing, "path")
    state.save_cache(tool, hits.select(names).unionByName(same.select(names)).unionByName(parsed.select(names)))
    return state.cached(tool).drop("version", "tool", "mtime", "size")


def cache_hits(listing: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cached rows whose file has the same time and size, listed files without one)."""
    hits = cached.join(listing.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_semi")
    return hits, listing.join(hits.select("path"), "path", "left_anti")


def revalidated(misses: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cached rows whose content is the same under another time, files to parse); ``misses`` has path, mtime, size, text, hash."""
    old = cached.drop("mtime", "size", "text", "version", "tool")
    same = misses.join(old, ["path", "hash"])
    return same, misses.join(same.select("path"), "path", "left_anti")


def invalidated(cached: DataFrame, path: str) -> DataFrame:
    """The cache without one path."""
    return cached.where(F.col("path") != path)
