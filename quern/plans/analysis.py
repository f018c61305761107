"""An analysis: a project's files as tables, what follows from them, and its counts and scores.

``Analysis`` is the handle that rules and reports take: every table is built
on first use and kept.  Files are parsed once, written to the shared scratch
folder and read back, so no rule parses again and a lost executor costs no
parse.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import extract
from quern.functions.lines import TEST_PATH
from quern.operators import boundary, graph, layers, resolve
from quern.plans import findings as R
from quern.plans.settings import MAX_FILES, Settings
from quern.plans.settings import base as base_settings
from quern.plans.settings import load as load_settings
from quern.sources import git
from quern.sources import project as S

#: What parsed a cached row; another version's rows are parsed again.
TOOL = "quern-0.2"
STEPS = ("reading-project", "parsing-files", "building-graph", "checking-architecture", "checking-patterns", "done")
#: Fixed: shares of the scores in the overall one, and what a count costs.
WEIGHTS = {"architecture": 0.3, "complexity": 0.2, "maintainability": 0.2, "dependencies": 0.15, "typeSafety": 0.15}
# Order of severities, priority of rules in acting on them.
SEVERITY_RANK = {"error": 0, "warning": 1, "info": 2}
DEFAULT_PRIORITY = 7
RULE_PRIORITY = {
    "next/secret-in-client-bundle": 0,
    "next/server-module-in-client-bundle": 0,
    "next/server-import-in-client": 0,
    "architecture/circular-dependency": 0,
    "scope/out-of-scope-change": 1,
    "architecture/layer-violation": 1,
    "architecture/forbidden-dependency": 1,
    "architecture/layer-skip": 2,
    "architecture/cross-feature-import": 2,
    "python/bare-except": 2,
    "python/mutable-default": 2,
    "go/ignored-error": 2,
    "patterns/parallel-implementations": 3,
    "patterns/duplicate-helper": 3,
    "dependencies/duplicate-dependency": 3,
    "complexity/large-file": 4,
    "complexity/large-component": 4,
    "react/effect-dependency-risk": 4,
    "type-safety/suppression": 5,
    "type-safety/explicit-any": 5,
    "complexity/large-function": 6,
    "complexity/high-complexity": 6,
}


@dataclass
class Analysis:
    """Parsed files, facts and settings of a project; everything else is derived."""

    spark: SparkSession
    files: DataFrame
    info: S.ProjectInfo = field(default_factory=S.ProjectInfo)
    settings: Settings = field(default_factory=base_settings)
    truncated: bool = False
    base_packages: DataFrame | None = None
    parts: tuple[DataFrame, ...] = ()

    @cached_property
    def sources(self) -> DataFrame:
        return self.files.where("not is_test")

    @cached_property
    def tests(self) -> DataFrame:
        """(path) of the tests: a table of its own, since they are few and edges are asked for them again and again."""
        return graph.cut(self.files.where("is_test").select("path"))

    @cached_property
    def functions(self) -> DataFrame:
        """One row for each function, with its place in the file."""
        return self.files.select("path", "language", "is_test", F.posexplode("functions").alias("ordinal", "f")).select("path", "language", "is_test", "ordinal", "f.*")

    @cached_property
    def imports(self) -> DataFrame:
        return resolve.imports_of(self.files)

    @cached_property
    def markers(self) -> DataFrame:
        return self.files.select("path", "language", "is_test", F.explode("markers").alias("m")).select("path", "language", "is_test", "m.*")

    @cached_property
    def graph(self) -> resolve.Graph:
        return resolve.build_graph(self.files, self.info, graph.cut)

    @cached_property
    def _linked(self) -> tuple[DataFrame, ...]:
        """Edges and unresolved imports, without what they are made from."""
        return self.imported("edges", "unresolved")

    @property
    def edges(self) -> DataFrame:
        return self._linked[0]

    @cached_property
    def external(self) -> DataFrame:
        return self.imported("external", where=F.col("package").isNotNull())[0]

    @property
    def unresolved(self) -> DataFrame:
        return self._linked[1]

    @property
    def resolved(self) -> DataFrame:
        return self.graph.resolved

    def imported(self, *names: str, own: DataFrame | None = None, where: Column | None = None) -> tuple[DataFrame, ...]:
        """Tables of the graph of imports by name, for the imports of some files or of some kind alone: ``resolve.tables``."""
        if "graph" in vars(self) and own is None and where is None:
            return tuple(self.graph.whole(name, graph.cut) for name in names)
        return resolve.tables(names, self.files, self.info, graph.cut, graph.discard, own, where)

    def texts(self, tests: bool) -> list[DataFrame]:
        """(path, text) of the tests or of the sources, in the parts that they came in."""
        if not self.parts:
            return [self.files.where(F.col("is_test") == tests).select("path", "text")]
        return [p.where(F.col("path").rlike(TEST_PATH) == tests).select("path", "text") for p in self.parts]

    @cached_property
    def packages(self) -> DataFrame:
        """(package, version) that the manifest declares for use or development."""
        declared = self.info.dependencies | self.info.dev_dependencies
        return self.spark.createDataFrame(list(declared.items()), "package string, version string")

    @cached_property
    def layers(self) -> layers.Layers:
        return layers.model(self.settings, self.files)

    @cached_property
    def coverage(self) -> DataFrame:
        return layers.coverage(self.files, self.layers)

    @cached_property
    def unplaced(self) -> DataFrame:
        return layers.unplaced(self.files, self.layers)

    @cached_property
    def nodes(self) -> DataFrame:
        return self.files.select(F.col("path").alias("node"))

    @cached_property
    def circles(self) -> DataFrame:
        """(node, component) of the files on loops of imports, types too; depths and loops without types both read it."""
        return graph.components(self.edges)

    @cached_property
    def depths(self) -> DataFrame:
        """(node, depth) of every file; files without edges have none."""
        return graph.cut(self.nodes.join(graph.depths(self.edges, self.circles), "node", "left").select("node", F.coalesce("depth", F.lit(0)).alias("depth")))

    @cached_property
    def root_depths(self) -> DataFrame:
        """Depths of the files that nothing imports."""
        return self.depths.join(self.edges.select(F.col("dst").alias("node")), "node", "left_anti")

    @cached_property
    def cycles(self) -> DataFrame:
        """(files) along one loop of each group of files that import each other; types make no loop."""
        return graph.cut(graph.loops(graph.inside(self.edges.where("not type_only"), self.circles).select("src", "dst")).select("files"))

    @cached_property
    def leaks(self) -> DataFrame:
        return graph.cut(boundary.client_leaks(self.files, self.edges, written=True))

    @cached_property
    def shared_names(self) -> DataFrame:
        return R.shared_names(self)

    @cached_property
    def findings(self) -> DataFrame:
        return graph.cut(R.run_all(self))

    def findings_of(self, *rules: str) -> DataFrame:
        """Findings of some rules alone."""
        return R.run_all(self, rules)

    @cached_property
    def stats(self) -> DataFrame:
        return graph.cut(stats(self))

    @cached_property
    def metrics(self) -> DataFrame:
        return scores(self.stats, self.info.has_typescript)

    @cached_property
    def warnings(self) -> DataFrame:
        return extract.warnings(self.files)


#: What files that come in parts are kept without: their texts can be asked for again.
NOT_KEPT = ("text", "hash")


def from_texts(spark: SparkSession, texts: DataFrame | Sequence[DataFrame], info: S.ProjectInfo | None = None, settings: Settings | None = None, **more) -> Analysis:
    """An analysis of (path, text) rows, however they came; several tables of them are parsed one after the other, and their texts read again where a rule asks for them."""
    if isinstance(texts, DataFrame):
        files = graph.cut(extract.parse_files(texts))
    else:
        files, more = reduce(DataFrame.unionByName, [graph.cut(extract.parse_files(p, NOT_KEPT)) for p in texts]), more | {"parts": tuple(texts)}
    return Analysis(spark, files, info or S.ProjectInfo(), settings or base_settings(), **more)


def analyze(spark: SparkSession, root: str, settings: Settings | None = None, max_files: int = MAX_FILES, changes: git.Changes | None = None, progress: Callable[[str], None] = lambda step: None, cache: bool = False) -> Analysis:
    """An analysis of a folder; ``progress`` hears each of ``STEPS``; with ``cache``, unchanged files aren't parsed again."""
    progress(STEPS[0])
    settings = settings or load_settings(root)
    paths, cut_short = S.scan(root, settings, max_files)
    info = S.detect(root, paths)
    progress(STEPS[1])
    before = manifest_at(spark, root, changes.base) if changes and changes.base else None
    if cache:
        from quern.sources.state import State, parse_cached

        a = Analysis(spark, parse_cached(State(spark, root), paths, TOOL), info, settings, cut_short, before)
    else:
        a = from_texts(spark, S.read_texts(spark, root, paths), info, settings, truncated=cut_short, base_packages=before)
    for step, built in zip(STEPS[2:5], ("edges", "cycles", "findings")):
        progress(step)
        getattr(a, built)
    progress(STEPS[5])
    return a


def manifest_at(spark: SparkSession, root: str, ref: str) -> DataFrame | None:
    """(package, version) that the manifest declared at a ref; null where it can't be read."""
    import json

    try:
        said = json.loads(git.file_at(root, ref, "package.json") or "")
    except json.JSONDecodeError:
        return None
    declared = (said.get("dependencies") or {}) | (said.get("devDependencies") or {})
    return spark.createDataFrame(list(declared.items()), "package string, version string")


# counts and scores -----------------------------------------------------------------


def ratio(part: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(part, total), F.lit(0.0))


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(x + F.lit(0.5)))).cast("long")


def stats(a: Analysis) -> DataFrame:
    """One row of the nineteen counts.

    Counts of functions and markers are taken inside each file's row, so one
    pass over the files gives them; edges, depths and findings give a row each.
    """
    t = a.settings.thresholds
    n = lambda test: F.size(F.filter("functions", test))
    marked = lambda kind: F.size(F.filter("markers", lambda m: m["kind"] == kind))
    large = lambda f: f["lines"] > F.when(f["is_component"], t["maxComponentLines"]).otherwise(t["maxFunctionLines"])
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    untyped = R.is_untyped(F.col("path"), F.col("language"), F.col("is_test")) & F.lit(a.info.has_typescript)
    files = a.sources.agg(
        F.count(F.lit(1)).alias("files"),
        total("sloc").alias("linesOfCode"),
        total(F.size("functions")).alias("functions"),
        F.count(F.when(F.col("lines") > t["maxFileLines"], 1)).alias("largeFiles"),
        total(n(large)).alias("largeFunctions"),
        total(n(lambda f: f["max_nesting"] > t["maxNesting"])).alias("deeplyNested"),
        total(n(lambda f: f["complexity"] > t["maxComplexity"])).alias("complexFunctions"),
        total(marked("any")).alias("anyUsages"),
        total(marked("ts-ignore")).alias("suppressions"),
        total(marked("unsafe-assertion")).alias("unsafeAssertions"),
        F.count(F.when(untyped, 1)).alias("jsFilesInTsProject"),
    )
    if_ = lambda c: F.count(F.when(c, 1))
    e = R.layered_edges(a).withColumns({"f": layers.feature_of("src", a.layers), "g": layers.feature_of("dst", a.layers)})
    crossing = F.coalesce((F.col("f") != F.col("g")) & (F.col("f") != "") & (F.col("g") != ""), F.lit(False))
    edges = e.agg(if_(F.col("relation") == "inverted").alias("layerViolations"), if_(F.col("relation") == "skip").alias("layerSkips"), if_(crossing).alias("crossFeatureImports"))
    parts = [
        a.coverage.select(F.col("layered").cast("long").alias("layeredFiles")),
        edges,
        a.cycles.agg(F.count(F.lit(1)).alias("cycles")),
        a.findings.agg(if_(F.col("id") == "maintainability/duplicate-block").alias("duplicateBlocks")),
        a.unresolved.agg(F.count(F.lit(1)).alias("unresolvedImports")),
        a.root_depths.agg(F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("maxImportDepth")),
    ]
    for p in parts:  # single rows
        files = files.join(F.broadcast(p), how="cross")
    return files


def scores(stats: DataFrame, has_typescript: bool) -> DataFrame:
    """Six scores from 0 to 100 of rows of counts."""
    c = F.col
    per100 = F.greatest(F.lit(1.0), c("files") / 100)
    kloc = F.greatest(F.lit(1.0), c("linesOfCode") / 1000)
    broken = (c("cycles") * 10 + c("layerViolations") * 5 + c("layerSkips") * 2 + c("crossFeatureImports")) / per100
    typed = 100 - c("anyUsages") / kloc * 3 - c("suppressions") / kloc * 8 - c("unsafeAssertions") / kloc * 2 - ratio(c("jsFilesInTsProject"), c("files")) * 50
    out = stats.select(
        *stats.columns,
        clamped(100 - broken - R.withheld(c("layeredFiles"), c("files"))).alias("architecture"),
        clamped(100 - ratio(c("complexFunctions"), c("functions")) * 180 - ratio(c("deeplyNested"), c("functions")) * 60).alias("complexity"),
        clamped(100 - ratio(c("largeFiles"), c("files")) * 200 - ratio(c("largeFunctions"), c("functions")) * 100 - c("duplicateBlocks") / per100 * 2).alias("maintainability"),
        clamped(100 - c("unresolvedImports") / per100 * 3 - F.greatest(F.lit(0), c("maxImportDepth") - 8) * 2).alias("dependencies"),
        (clamped(typed) if has_typescript else F.lit(100).cast("long")).alias("typeSafety"),
    )
    overall = sum((c(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return out.select(clamped(overall).alias("overall"), *WEIGHTS)


def file_metrics(files: DataFrame) -> DataFrame:
    """(path, lines, sloc, functions, maxComplexity) of every file."""
    worst = F.coalesce(F.array_max(F.transform("functions", lambda f: f["complexity"])), F.lit(0))
    return files.select("path", "lines", "sloc", F.size("functions").cast("long").alias("functions"), worst.alias("maxComplexity"))


# order ---------------------------------------------------------------------------------


def _rank(column: str, table: dict[str, int], other: int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(column)), F.lit(other))


def overshoot() -> Column:
    """How many times over its limit a finding is; 1 where it has none."""
    return F.when((F.col("baseline_num") > 0) & (F.col("current_num") > 0), F.col("current_num") / F.col("baseline_num")).otherwise(1.0)


def _place() -> list[Column]:
    return [F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)), F.col("rule_ord"), F.col("title"), F.col("fingerprint")]


def reading_order() -> list[Column]:
    """By severity, category, file and line."""
    return [_rank("severity", SEVERITY_RANK, 3), F.col("category"), *_place()]


def acting_order() -> list[Column]:
    """By severity, priority of the rule, how far over the limit, file and line."""
    return [_rank("severity", SEVERITY_RANK, 3), _rank("id", RULE_PRIORITY, DEFAULT_PRIORITY), -overshoot(), *_place()]


def sorted_findings(found: DataFrame) -> DataFrame:
    return found.orderBy(*reading_order())


#: What the acting order looks at.
ORDERED_BY = ("id", "severity", "file", "line", "title", "fingerprint", "baseline_num", "current_num", "rule_ord")


def numbered(found: DataFrame, *columns: str) -> DataFrame:
    """Findings, or some of their columns, with their issue number, from 1 in acting order.

    A total order over all findings: they are sorted by range, and each part
    adds how many stand before it, so no task holds them all.
    """
    columns = columns or tuple(found.columns)
    spread = found.select(*dict.fromkeys((*columns, *ORDERED_BY))).repartitionByRange(*acting_order()).sortWithinPartitions(*acting_order())
    ordered = graph.cut(spread.select(*columns, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")))
    sizes = ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("before"))  # a row for each part
    return ordered.join(F.broadcast(before), "_p").withColumn("number", (F.col("before") + F.col("_i") + 1).cast("long")).drop("_p", "_i", "before")


def with_numbers(subset: DataFrame, everything: DataFrame) -> DataFrame:
    """``subset`` with the numbers of the full run; what isn't in it is numbered after the last."""
    all_ = numbered(everything).select("fingerprint", "number").groupBy("fingerprint").agg(F.max("number").alias("number"))
    known = subset.join(all_, "fingerprint", "left")
    new = numbered(known.where("number is null").drop("number"))
    last = all_.agg(F.coalesce(F.max("number"), F.lit(0)).alias("last"))
    new = new.join(F.broadcast(last), how="cross").withColumn("number", F.col("number") + F.col("last")).drop("last")
    return known.where("number is not null").unionByName(new)


def pick(found: DataFrame, most: int) -> DataFrame:
    """The first issue of each rule and file, ``most`` at most, by number."""
    first = found.groupBy("id", F.coalesce("file", F.lit("")).alias("at")).agg(F.min("number").alias("number")).select("number")
    return found.join(first, "number", "left_semi").orderBy("number").limit(most)


def severity_counts(found: DataFrame) -> DataFrame:
    """One row: error, warning, info."""
    return found.agg(*[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITY_RANK])


PRIORITY = {"error": "critical", "warning": "important", "info": "minor"}


def priority_counts(found: DataFrame) -> DataFrame:
    """One row: critical, important, minor, total."""
    return found.agg(*[F.count(F.when(F.col("severity") == s, 1)).alias(p) for s, p in PRIORITY.items()], F.count(F.lit(1)).alias("total"))
