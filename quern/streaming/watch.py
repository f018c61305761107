"""Watching a tree: changes come as a stream of paths, in batches, and each batch reports what is new.

A stream of (path, ts) events is read by Structured Streaming.  Spark runs one
batch at a time and what arrives meanwhile is in the next, so nothing is lost
and no two runs overlap.  ``bursts`` of ``sessions`` gives the same debounce
in event time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions import globs
from quern.functions.extract import LANGUAGES, parse_files
from quern.operators import graph
from quern.plans import analysis as A
from quern.plans import reports_project as Q
from quern.plans.settings import NEVER, Settings

DEBOUNCE = "400 milliseconds"
CONFIG_FILES = ("package.json", "tsconfig.json", "go.mod")


def affects_analysis(path: str, settings: Settings):
    """Whether a changed path can change the analysis: a source that isn't ignored, or a manifest."""
    parts = F.split(F.col(path), "/")
    name = F.element_at(parts, -1)
    source = F.regexp_extract(name, r"(\.[^.]*)$", 1).isin(*LANGUAGES) & ~globs.matches(path, list(settings.ignore))
    return (source | name.isin(*CONFIG_FILES)) & ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in sorted(NEVER)]))


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, ts) from text files of one path a line, as a lister appends them."""
    return spark.readStream.format("text").load(folder).select(F.trim("value").alias("path"), F.current_timestamp().alias("ts")).where("path <> ''")


@dataclass
class Session:
    """What a watch remembers: the analysis it compares with, the last scores and the findings already told."""

    analysis: A.Analysis
    known: set[str] = field(default_factory=set)
    metrics: dict[str, int] = field(default_factory=dict)
    reports: list[dict] = field(default_factory=list)

    @classmethod
    def start(cls, a: A.Analysis) -> Session:
        return cls(a, {r.fingerprint for r in a.findings.select("fingerprint").distinct().collect()}, a.metrics.first().asDict())


def reparsed(a: A.Analysis, texts: DataFrame, touched: list[str]) -> A.Analysis:
    """The analysis with the touched files parsed anew from ``texts`` (path, text); files without text are gone."""
    fresh = parse_files(texts.where(F.col("path").isin(touched or [""]) & F.col("text").isNotNull()))
    rest = a.files.where(~F.col("path").isin(touched or [""]))
    return A.Analysis(a.spark, graph.cut(rest.unionByName(fresh)), a.info, a.settings, a.truncated, a.base_packages)


def step(session: Session, texts: DataFrame, touched: list[str]) -> dict:
    """One run after a batch of changes: all rules again, then only what is new since the watch began, by place, and scores that fell."""
    session.analysis = reparsed(session.analysis, texts, touched)
    a = session.analysis
    fresh = a.findings.where(~F.col("fingerprint").isin(list(session.known) or [""])) if len(session.known) < 10_000 else a.findings.join(a.spark.createDataFrame([(k,) for k in session.known], "fingerprint string"), "fingerprint", "left_anti")
    told = Q.attribute(touched, fresh, a).select("place", "id", "fingerprint", "severity", "file", "line", "title").orderBy("place", "file", "line", "id")
    found = [r.asDict() for r in told.collect()]
    now = a.metrics.first().asDict()
    report = {"touched": sorted(touched), "new": found, "dropped": {m: now[m] - v for m, v in session.metrics.items() if now[m] < v}}
    session.known |= {r["fingerprint"] for r in found}
    session.metrics = now
    session.reports.append(report)
    return report


def watch(stream: DataFrame, session: Session, texts: Callable[[list[str]], DataFrame], checkpoint: str, debounce: str = DEBOUNCE, on_error: Callable[[Exception], None] = lambda e: None, once: bool = False) -> StreamingQuery:
    """Run ``step`` on each batch of distinct changed paths; ``texts`` reads the paths' present texts.

    An error in a run is told and the watch goes on with the next batch.
    """
    settings = session.analysis.settings

    def run(batch: DataFrame, _: int) -> None:
        paths = batch.where(affects_analysis("path", settings)).select("path").distinct().orderBy("path")
        touched = [r.path for r in paths.collect()]
        if touched:
            try:
                step(session, texts(touched), touched)
            except Exception as e:
                on_error(e)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=debounce)).start()


def first_seen(findings: DataFrame) -> DataFrame:
    """A stream of findings (fingerprint, ts and more) with each fingerprint once: stateful, for any number of files."""
    state = "fingerprint string, seen boolean"

    def once(key: tuple, batches: Iterator, kept) -> Iterator:
        import pandas as pd

        rows = [b for b in batches if len(b)]
        if rows and not kept.exists:
            kept.update((key[0], True))
            yield pd.concat(rows).sort_values("ts").head(1)

    return findings.groupBy("fingerprint").applyInPandasWithState(once, findings.schema, state, "append", "NoTimeout")
