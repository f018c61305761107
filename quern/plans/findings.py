"""The rules: each takes an analysis and returns findings as a DataFrame, or none where there is nothing to ask.

A rule is declarative: the rows it starts from, a condition, and the columns
of a finding.  ``RULES`` keeps their order, which breaks ties in all sorting.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import globs
from quern.functions import paths as P
from quern.operators import layers, marks, patterns, resolve
from quern.operators.graph import cut

if TYPE_CHECKING:
    from quern.plans.analysis import Analysis

SCHEMA = "id string, fingerprint string, severity string, category string, file string, line int, title string, message string, detail array<string>, suggestion string, baseline string, current string, baseline_num double, current_num double, rule_ord int"
# Names that are meant to repeat, how many shared names make a module, sizes of single-use modules, root tooling.
CONVENTIONAL_NAMES = ("default", "GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "handler", "middleware", "config", "metadata", "generateMetadata", "generateStaticParams", "loader", "action", "Page", "Layout", "Error", "Loading", "main", "run", "setup", "init", "render")
PARALLEL = 3
SMALL_SLOC, SMALL_FUNCTIONS, GROWTH_FILES, GROWTH_SINGLE, GROWTH_SHARE = 30, 2, 8, 5, 0.5
SERVED = ("public", "static", "assets")
ROOT_TOOLING = r"^[^/]*\.(config|setup|conf|rc)\.[cm]?js$"


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    description: str
    run: Callable[[Analysis], DataFrame | None]


RULES: list[Rule] = []


def rule(id: str, category: str, description: str):
    """Register a function from an analysis to rows as a rule."""

    def add(f: Callable[[Analysis], DataFrame | None]):
        RULES.append(Rule(id, category, description, f))
        return f

    return add


def by_id(id: str) -> Rule | None:
    return next((r for r in RULES if r.id == id), None)


def severity_of(id: str, rules: dict[str, str]) -> str:
    return rules.get(id, "off")


def enabled(id: str, rules: dict[str, str]) -> bool:
    return severity_of(id, rules) != "off"


def said(*parts) -> Column:
    """Text and columns as one string."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)


def count_label(n: Column, singular: str, many: str | None = None) -> Column:
    return said(n, " ", plural(n, singular, many or singular + "s"))


def _json(x: Column | None, kind: str) -> Column:
    if x is None:
        return F.lit(None).cast("string")
    return x.cast("string") if kind == "n" else F.to_json(x) if kind == "a" else F.concat(F.lit('"'), x, F.lit('"'))


def rows(of: DataFrame, *, file: Column, title: Column, message: Column, line: Column | None = None, detail: Column | None = None, suggestion: str | Column = "", key: tuple = (), baseline=None, current=None, kind: str = "n") -> DataFrame:
    """Columns of a finding without what its rule gives; ``kind`` of ``current``: n(umber), a(rray), s(tring)."""
    wrap = lambda x: x if x is None or isinstance(x, Column) else F.lit(x)
    baseline, current = wrap(baseline), wrap(current)
    number = lambda x, on: x.cast("double") if x is not None and on else F.lit(None).cast("double")
    b_kind = "n" if kind == "n" else "s"
    return of.select(
        file.cast("string").alias("file"),
        (F.lit(None) if line is None else line).cast("int").alias("line"),
        title.cast("string").alias("title"),
        message.cast("string").alias("message"),
        (F.lit(None) if detail is None else detail).cast("array<string>").alias("detail"),
        wrap(suggestion).cast("string").alias("suggestion"),
        _key(key).alias("_key"),
        _json(baseline, b_kind).alias("baseline"),
        _json(current, kind).alias("current"),
        number(baseline, b_kind == "n").alias("baseline_num"),
        number(current, kind == "n").alias("current_num"),
    )


def _key(parts: tuple) -> Column:
    """Parts of a fingerprint: columns, or (column,) for an array whose elements all count."""
    none = F.array().cast("array<string>")
    return F.concat(none, *[p[0].cast("array<string>") if isinstance(p, tuple) else F.array(p.cast("string") if isinstance(p, Column) else F.lit(str(p))) for p in parts])


def finish(found: DataFrame, r: Rule, severity: str, order: int) -> DataFrame:
    """A rule's rows as findings of ``SCHEMA``; the fingerprint is of the rule, the file and the key."""
    print_ = F.substring(F.sha1(F.concat_ws(" ", F.lit(r.id), F.col("file"), F.col("_key")).cast("binary")), 1, 12)
    lead = [F.lit(r.id).alias("id"), print_.alias("fingerprint"), F.lit(severity).alias("severity"), F.lit(r.category).alias("category")]
    return found.select(*lead, *[c for c in found.columns if c != "_key"], F.lit(order).alias("rule_ord"))


def crash(spark, r: Rule, error: Exception, order: int) -> DataFrame:
    """What a rule that can't be run leaves behind; the others go on."""
    return spark.createDataFrame([(r.id and "internal/rule-error", f"internal/{r.id}", "info", r.category, None, None, f"Rule {r.id} could not run", f"{type(error).__name__}: {error}"[:500], None, None, None, None, None, None, order)], SCHEMA)


def run_all(a: Analysis, only: tuple[str, ...] = ()) -> DataFrame:
    """Findings of all rules that are on, or of those among ``only``."""
    out = []
    for order, r in enumerate(RULES):
        severity = severity_of(r.id, a.settings.rules)
        if severity == "off" or only and r.id not in only:
            continue
        try:
            found = r.run(a)
            if found is not None:
                out.append(finish(found, r, severity, order))
        except Exception as e:
            out.append(crash(a.spark, r, e, order))
    none = a.spark.createDataFrame([], SCHEMA)
    return reduce(DataFrame.unionByName, out, none)


# architecture -----------------------------------------------------------------


def is_package_init(files: Column) -> Column:
    """A loop that only runs through a package's own ``__init__``."""
    inits = F.filter(files, lambda f: f.endswith("/__init__.py") | (f == "__init__.py"))
    folders = F.transform(inits, lambda f: F.regexp_replace(f, "[^/]*$", ""))
    return (F.size(inits) > 0) & F.forall(files, lambda f: F.array_contains(inits, f) | F.exists(folders, lambda d: f.startswith(d)))


@rule("architecture/circular-dependency", "architecture", "Loops of imports.")
def circular(a):
    files = F.col("files")
    chain = F.array_join(F.concat(files, F.slice(files, 1, 1)), " -> ")
    return rows(a.cycles.where(~is_package_init(files)), file=F.get(files, F.lit(0)), title=said(F.size(files), " files import one another in a loop"), message=F.lit("Whoever needs one of them gets all of them."), detail=F.array(chain), suggestion="Find the import that the loop can do without, and take what it needs out of the loop.", key=((files,),), current=files, kind="a")


def layered_edges(a: Analysis) -> DataFrame:
    """Imports that are no types and don't start in a test, with layers and their relation."""
    m = a.layers
    e = a.edges.where("not type_only").join(a.tests.select(F.col("path").alias("src")), "src", "left_anti")
    e = e.withColumns({"a": layers.layer_of("src", m), "b": layers.layer_of("dst", m)})
    return e.withColumn("relation", layers.relation(F.col("a"), F.col("b"), m))


def _layer_rule(a: Analysis, wanted: str) -> DataFrame | None:
    m = a.layers
    if not m.usable:
        return None
    e = layered_edges(a).where(F.col("relation") == wanted)
    low, high = F.col("a"), F.col("b")
    after = F.element_at(F.create_map(*[F.lit(x) for layer in m.order for x in (layer, m.after(layer))]), low)
    if wanted == "skip":
        title, expected = said(low, " goes straight to ", high), said(low, " -> ", after, " -> ", high)
        message, fix = said(F.col("src"), " takes ", F.col("dst"), " and leaves ", after, f" out; the order is {m.chain}."), said("Ask ", after, " for it.")
    else:
        title, expected = said(low, " depends upwards on ", high), said(high, " -> ", low)
        message, fix = said(F.col("src"), " takes ", F.col("dst"), f", against the order {m.chain}."), said("Hand it over from ", high, ", or put it where ", low, " may look.")
    found = said(low, " -> ", high)
    return rows(e, file=F.col("src"), line=F.col("line"), title=title, message=message, detail=F.array(said("found:    ", found), said("expected: ", expected)), suggestion=fix, key=(F.col("dst"), F.col("line")), current=found, kind="s")


@rule("architecture/layer-violation", "architecture", "Imports that go up the layers.")
def layer_violation(a):
    return _layer_rule(a, "inverted")


@rule("architecture/layer-skip", "architecture", "Imports that leave a layer out.")
def layer_skip(a):
    return _layer_rule(a, "skip")


def feature_edges(a: Analysis) -> DataFrame:
    e = layered_edges(a).withColumns({"f": layers.feature_of("src", a.layers), "g": layers.feature_of("dst", a.layers)})
    return e.where("f is not null and g is not null and f <> '' and g <> '' and f <> g")


@rule("architecture/cross-feature-import", "architecture", "Imports between features.")
def cross_feature(a):
    if not a.layers.feature_root:
        return None
    pair = said(F.col("f"), " -> ", F.col("g"))
    return rows(feature_edges(a), file=F.col("src"), line=F.col("line"), title=said(F.col("f"), " reaches into the feature ", F.col("g")), message=said(F.col("src"), " takes ", F.col("dst"), f" from another folder of {a.layers.feature_root}/."), detail=F.array(pair), suggestion="Take it from where the other feature offers it, or give it a place of its own.", key=(F.col("dst"), F.col("line")), current=pair, kind="s")


@rule("architecture/forbidden-dependency", "architecture", "Imports that the settings rule out.")
def forbidden(a):
    pairs = list(a.settings.forbidden)
    if not pairs:
        return None
    e = patterns.forbidden_edges(a.edges, pairs)
    return rows(e, file=F.col("src"), line=F.col("line"), title=F.lit("An import that the settings rule out"), message=said(F.col("src"), " takes ", F.col("dst"), "; the pair ", F.col("pair"), " stands against it."), suggestion="Do without the import, or without the pair.", key=(F.col("dst"), F.col("pair")), current=F.col("pair"), kind="s")


@rule("architecture/deep-import-chain", "architecture", "Roots that load a long line of modules.")
def deep_chain(a):
    limit = a.settings.thresholds["maxImportDepth"]
    # few are deep: edges are asked for these alone
    deep = cut(a.depths.where(F.col("depth") > limit))
    deep = deep.join(a.edges.select(F.col("dst").alias("node")).join(deep.select("node"), "node", "left_semi").distinct(), "node", "left_anti")
    return rows(deep, file=F.col("node"), title=said("Loads ", F.col("depth"), " modules in a row"), message=said(F.col("depth"), " modules in a row stand behind ", F.col("node"), f"; {limit} are allowed."), suggestion="Let modules in the row be loaded by the root itself, or later.", key=(F.col("depth"),), baseline=limit, current=F.col("depth"))


def withheld(layered: Column, total: Column) -> Column:
    """Points that the architecture score loses for code no layer covers."""
    return F.when((layered == 0) | (total == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), layers.TARGET - layered / F.nullif(total, F.lit(0))) * 50)


def rounded(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


@rule("architecture/unlayered-code", "architecture", "Code outside all layers.")
def unlayered(a):
    c = a.coverage.where("total > 0")
    if not a.layers.usable:
        few = "only one layer" if len(a.layers.order) == 1 else "no layers"
        return rows(c, file=F.lit(None), title=F.lit("No layers to hold imports against"), message=F.lit(f"With {few} there is no border that an import could cross."), detail=F.array().cast("array<string>"), suggestion="Name the layers in the settings.", key=("none",), current=0)
    percent = rounded(F.col("share") * 100)
    where = F.transform(F.slice(F.col("places"), 1, 6), lambda p: said(p["directory"], ": ", count_label(p["files"], "file")))
    places = a.unplaced.agg(F.array_sort(F.collect_list(F.struct((-F.col("files")).alias("o"), "directory", "files"))).alias("places"))
    c = c.where(F.col("share") < layers.TARGET).join(F.broadcast(places), how="cross")
    lost = rounded(withheld(F.col("layered"), F.col("total")))
    return rows(c, file=F.lit(None), title=said(F.col("total") - F.col("layered"), " sources belong to no layer"), message=said(percent, "% of the sources have a layer; the rest costs the architecture score ", count_label(lost, "point"), "."), detail=where, suggestion="Give these folders a layer.", key=(percent,), baseline=int(layers.TARGET * 100 + 0.5), current=percent)


# complexity ----------------------------------------------------------------------


@rule("complexity/large-file", "complexity", "Files with more lines than allowed.")
def large_file(a):
    limit = a.settings.thresholds["maxFileLines"]
    f = a.sources.where(F.col("lines") > limit)
    return rows(f, file=F.col("path"), title=said(F.col("path"), " has grown to ", F.format_number("lines", 0), " lines"), message=F.lit(f"Files here may have {limit:,} lines."), detail=F.array(said(F.size("functions"), " functions, ", F.format_number("sloc", 0), " lines of code")), suggestion="Look for a part that the rest rarely mentions, and move it out.", baseline=limit, current=F.col("lines"))


def _function_rule(a: Analysis, measure: str, limit_name: str, where: Column, title, message, suggestion: str) -> DataFrame:
    limit = a.settings.thresholds[limit_name]
    f = a.functions.where(~F.col("is_test") & where & (F.col(measure) > limit))
    return rows(f, file=F.col("path"), line=F.col("line"), title=title, message=message(limit), suggestion=suggestion, key=(F.col("name"), F.col("line")), baseline=limit, current=F.col(measure))


@rule("complexity/large-function", "complexity", "Functions with more lines than allowed.")
def large_function(a):
    n = F.col("name")
    return _function_rule(a, "lines", "maxFunctionLines", ~F.col("is_component"), said("The body of ", n, "() takes ", F.col("lines"), " lines"), lambda x: said(F.col("lines"), " lines of ", F.col("path"), " are ", n, f"(); {x} are allowed."), "Give its steps names and functions of their own.")


@rule("complexity/large-component", "complexity", "Components with more lines than allowed.")
def large_component(a):
    n = F.col("name")
    return _function_rule(a, "lines", "maxComponentLines", F.col("is_component"), said("Component ", n, " takes ", F.col("lines"), " lines"), lambda x: said(n, " has ", F.col("lines"), f" lines; components may have {x}."), "Let smaller components show its parts, and keep what loads data apart.")


@rule("complexity/high-complexity", "complexity", "Functions that branch too often.")
def high_complexity(a):
    n = F.col("name")
    return _function_rule(a, "complexity", "maxComplexity", F.lit(True), said(n, "() branches ", F.col("complexity"), " ways"), lambda x: said(F.col("complexity"), " ways lead through ", n, f"(); {x} are allowed."), "Answer the simple cases first, and the others by functions of their own.")


@rule("complexity/deep-nesting", "complexity", "Functions with blocks inside blocks.")
def deep_nesting(a):
    n = F.col("name")
    return _function_rule(a, "max_nesting", "maxNesting", F.lit(True), said("Blocks in ", n, "() go ", F.col("max_nesting"), " levels down"), lambda x: said(n, "() puts ", F.col("max_nesting"), f" blocks into one another; {x} are allowed."), "Leave the function as soon as a case is settled.")


@rule("complexity/too-many-params", "complexity", "Functions that take too much.")
def too_many_params(a):
    n = F.col("name")
    return _function_rule(a, "params", "maxParams", F.lit(True), said(F.col("params"), " values to call ", n, "()"), lambda x: said(n, "() wants ", F.col("params"), f" values; {x} are allowed."), "Pass what belongs together as one.")


# maintainability -------------------------------------------------------------------


def normalized_line(x: Column) -> Column:
    """Without white space around it, and single spaces inside."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def is_structural(x: Column) -> Column:
    """A normalised line that says nothing about duplication."""
    return (F.length(x) < 8) | x.rlike(r"^[}\]);,]+$") | x.rlike(r"^(//|#|\*)") | x.rlike(r"^(import|export|from|package|use\s)")


def informative(structural: str, start: Column, window: int) -> Column:
    """Whether none of the ``window`` lines from ``start`` (from 1) is structural; ``structural`` has a flag for each line."""
    return ~reduce(lambda a, b: a | b, [F.get(structural, start + (k - 1)) for k in range(window)])


def block_places(texts: DataFrame, window: int) -> DataFrame:
    """(key, path, line) of all windows of ``window`` lines, none structural; ``texts`` has path, text.

    Windows are cut inside each row and named by a 128-bit key.  Of a file's
    windows of one key those that overlap one that counts don't count.
    """
    lines = F.transform(F.split("text", "\n"), normalized_line)
    per_file = texts.where("text is not null").select("path", lines.alias("l")).where(F.size("l") >= window)
    free = F.filter(F.sequence(F.lit(1), F.size("l") - window + 1), lambda i: informative("s", i, window))
    each = per_file.withColumn("s", F.transform("l", is_structural)).select("path", F.explode(F.transform(free, lambda i: F.struct(i.alias("line"), F.unhex(F.md5(F.array_join(F.slice("l", i, window), "\n").cast("binary"))).alias("key")))).alias("w")).select("path", "w.*")
    per = each.groupBy("key", "path").agg(F.array_sort(F.collect_list("line")).alias("all"))
    kept = F.aggregate("all", F.array().cast("array<int>"), lambda kept, i: F.when(i - F.coalesce(F.try_element_at(kept, F.lit(-1)), i - window) < window, kept).otherwise(F.array_append(kept, i)))
    return per.select("key", "path", F.explode(F.when(F.size("all") == 1, F.col("all")).otherwise(kept)).alias("line"))


def marked_regions(places: DataFrame, window: int) -> DataFrame:
    """(region, n, span, mark) of runs of ``window`` lines or more that stand in several of the places of ``block_places``.

    The places of a window become a mark that adds up (``marks``), with lines
    told from the first place: windows that follow each other at the same
    places have equal marks and join into a region.  ``n`` counts its places.
    """
    keys = places.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "line")).alias("first"), marks.sums("path").alias("who"), marks.sums("path", times=F.col("line")).alias("far")).where("n > 1")
    where = marks.moved(F.col("far"), F.col("first.line"), F.col("who"))
    keys = keys.select("key", "n", F.col("first.path").alias("path"), F.col("first.line").alias("at"), F.array_join(F.concat("who", where).cast("array<string>"), ".").alias("mark"))
    group = Window.partitionBy("path", "mark", "n").orderBy("at")
    marked = keys.withColumn("new", F.coalesce((F.col("at") > F.lag("at").over(group) + window).cast("int"), F.lit(1)))
    islands = marked.withColumn("island", F.sum("new").over(group.rowsBetween(Window.unboundedPreceding, 0)))
    regions = islands.groupBy("path", "mark", "n", "island").agg(F.min_by("key", "at").alias("region"), (F.max("at") - F.min("at") + window).cast("int").alias("span"))
    return regions.select("region", "n", "span", "mark")


def duplicate_regions(texts: DataFrame | Sequence[DataFrame], window: int) -> DataFrame:
    """``marked_regions`` of parts of the texts, each with all lines of its files, with their files and lines: the first ``marks.MANY``, so a block in every file of a project costs rows of bounded size."""
    places = reduce(DataFrame.unionByName, [cut(block_places(p, window)) for p in ([texts] if isinstance(texts, DataFrame) else texts)])
    regions = cut(marked_regions(places, window))
    shown = marks.listed(places.withColumnRenamed("key", "region").join(regions.select("region"), "region", "left_semi"), ["region"], ["path", "line"], "p")
    return regions.join(shown, "region").select("region", "n", F.transform("p", lambda x: x["path"]).alias("files"), F.transform("p", lambda x: x["line"]).alias("lines"), "span", "mark")


def whole_or_mark(members: Column, n: Column, mark: Column) -> Column:
    """What a fingerprint takes of a set: all members if they are listed, else its mark."""
    return F.when(n <= marks.MANY, members).otherwise(F.array(mark))


@rule("maintainability/duplicate-block", "maintainability", "Runs of lines that occur again.")
def duplicate_block(a):
    r = duplicate_regions(a.texts(tests=False), a.settings.thresholds["minDuplicateLines"])
    places = F.transform(F.arrays_zip("files", "lines"), lambda p: F.concat_ws(":", p["files"], p["lines"]))
    n = F.col("n").cast("int")
    return rows(r, file=F.get("files", F.lit(0)), line=F.get("lines", F.lit(0)), title=said("A block of ", F.col("span"), " lines occurs ", n, " times"), message=said(n, " places hold the same ", F.col("span"), " lines; who changes one has to think of the others."), detail=F.slice(places, 1, 5), suggestion="Give the lines a function, and call it.", key=((whole_or_mark(places, n, F.col("mark")),), F.col("span")), current=n)


@rule("maintainability/unresolved-import", "maintainability", "Imports without a target.")
def unresolved_import(a):
    per = a.unresolved.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "specifier", "line"))).alias("u"))
    n, u = F.size("u"), F.col("u")
    return rows(per, file=F.col("path"), line=F.get(u, F.lit(0))["line"], title=said("No target for ", count_label(n, "import")), message=said(F.col("path"), " asks for ", count_label(n, "module"), " that neither the files nor the declared packages hold."), detail=F.transform(F.slice(u, 1, 5), lambda x: said(x["specifier"], " (line ", x["line"], ")")), suggestion="Look for a file that moved, or an alias that no settings explain.", key=((F.transform(u, lambda x: x["specifier"]),),), current=n)


# types -----------------------------------------------------------------------------


def _marked(a: Analysis, kinds: tuple[str, ...], where: Column) -> DataFrame:
    """Sources with the markers of the kinds as ``m``, where there are any."""
    own = F.filter("markers", lambda m: m["kind"].isin(*kinds))
    return a.files.where(where).withColumn("m", own).where("size(m) > 0")


def _each_marker(a: Analysis, kind: str, where: Column, title: str, message: str, suggestion: str) -> DataFrame:
    m = _marked(a, (kind,), where).select("path", F.explode("m").alias("m"))
    return rows(m, file=F.col("path"), line=F.col("m.line"), title=F.lit(title), message=said(F.col("path"), ":", F.col("m.line"), " ", message), suggestion=suggestion, key=(F.col("m.line"),))


def _line_list(m: str = "m", most: int = 8) -> Column:
    return F.array(said("lines: ", F.array_join(F.transform(F.slice(m, 1, most), lambda x: x["line"].cast("string")), ", ")))


def _source() -> Column:
    return ~F.col("is_test")


@rule("type-safety/explicit-any", "type-safety", "Files that say `any` too often.")
def explicit_any(a):
    budget = F.greatest(F.lit(2), rounded(F.col("sloc") / 1000 * a.settings.thresholds["maxAnyPerKLoc"]).cast("int"))
    f = _marked(a, ("any",), _source() & (F.col("language") == "typescript")).withColumn("budget", budget).where("size(m) > budget")
    n = F.size("m")
    return rows(f, file=F.col("path"), line=F.get("m", F.lit(0))["line"], title=said(F.col("path"), " says `any` ", n, " times"), message=said("Of ", F.format_number("sloc", 0), " lines of code ", F.col("budget"), " may say `any`."), detail=_line_list(), suggestion="Start with those that most code passes through.", baseline=F.col("budget"), current=n)


@rule("type-safety/suppression", "type-safety", "Comments that switch the compiler off.")
def suppression(a):
    return _each_marker(a, "ts-ignore", _source(), "A compiler error is switched off here", "hides what the compiler would say, now and later.", "Mend the type, or use the directive that complains once the error has gone.")


@rule("type-safety/unsafe-assertion", "type-safety", "Assertions that nothing checks.")
def unsafe_assertion(a):
    f = _marked(a, ("unsafe-assertion",), _source() & (F.col("language") == "typescript"))
    n = F.size("m")
    return rows(f, file=F.col("path"), line=F.get("m", F.lit(0))["line"], title=said(count_label(n, "assertion"), " that the compiler can't check"), message=said(F.col("path"), " goes from `any` or `unknown` to a type ", count_label(n, "time"), "."), detail=_line_list(), suggestion="Test the value before it gets its type.", current=n)


def is_untyped(path: Column, language: Column, is_test: Column) -> Column:
    """Plain JavaScript by neglect: no test, no module-format extension, no root tooling, not served as it is."""
    own = (language == "javascript") & ~is_test & ~path.rlike(r"\.[cm]js$") & ~path.rlike(ROOT_TOOLING)
    return own & ~F.substring_index(path, "/", 1).isin(*SERVED)


def untyped(files: DataFrame, has_typescript: bool) -> DataFrame:
    return files.where(is_untyped(F.col("path"), F.col("language"), F.col("is_test")) & F.lit(has_typescript))


def _listed(of: DataFrame, column: str = "path") -> DataFrame:
    """All values as one sorted list, if there are any."""
    return of.agg(F.array_sort(F.collect_list(column)).alias("all")).where("size(all) > 0")


@rule("type-safety/js-in-ts-project", "type-safety", "Sources without types beside typed ones.")
def js_in_ts(a):
    if not a.info.has_typescript:
        return None
    n, every = F.size("all"), F.col("all")
    return rows(_listed(untyped(a.files, True)), file=F.get(every, F.lit(0)), title=said(count_label(n, "file"), " left in plain JavaScript"), message=said("The compiler passes over ", count_label(n, "source"), "."), detail=F.slice(every, 1, 8), suggestion="Give them types, or say in the settings that they have none.", key=((every,),), current=n)


# frameworks -----------------------------------------------------------------------


@rule("react/effect-dependency-risk", "maintainability", "Effects that every render repeats.")
def effect_risk(a):
    f = a.sources.where(F.size(F.coalesce("effects", F.array().cast("array<int>"))) > 0)
    n = F.size("effects")
    return rows(f, file=F.col("path"), line=F.get("effects", F.lit(0)), title=said(count_label(n, "effect"), " without a list of what they depend on"), message=said("Each render of ", F.col("path"), " starts ", count_label(n, "effect"), " again."), detail=F.array(said("lines: ", F.array_join(F.slice("effects", 1, 8).cast("array<string>"), ", "))), suggestion="List what the effect depends on, or note why each render needs it.", current=n)


@rule("next/server-import-in-client", "architecture", "Packages for servers in browser code.")
def server_import(a):
    own = F.coalesce("server_only", F.array().cast("array<string>"))
    f = a.files.where(F.col("use_client") & (F.size(own) > 0))
    return rows(f, file=F.col("path"), title=F.lit("Browser code takes a package meant for servers"), message=said("No browser can run ", F.array_join(own, ", "), ", which ", F.col("path"), " asks for."), detail=F.transform(own, lambda x: said("imports ", x)), suggestion="Let a module of the server use the package and hand over what it finds.", key=((own,),), current=own, kind="a")


def leaks_by(a: Analysis, kind: str) -> DataFrame:
    """Leaks whose worst reason is ``secret``, or ``package`` where no secret is read."""
    return a.leaks.where(F.when(F.size("secrets") > 0, "secret").otherwise("package") == kind)


def chain_text(chain: Column) -> Column:
    return F.array_join(chain, " → ")


@rule("next/secret-in-client-bundle", "architecture", "Ways from browser code to secrets.")
def secret_in_bundle(a):
    names, chain, direct = F.slice("secrets", 1, 4), F.col("chain"), F.size("chain") == 1
    message = F.when(direct, said(F.col("client"), " is browser code and asks for ", F.array_join(names, ", "), ".")).otherwise(said("By way of ", F.col("client"), " the browser gets ", F.col("target"), " too, which asks for ", F.array_join(names, ", "), "."))
    detail = F.concat(F.array(chain_text(chain)), F.transform(F.slice("secrets", 1, 6), lambda x: said("reads process.env.", x)))
    return rows(leaks_by(a, "secret"), file=F.col("client"), line=F.when(direct, F.col("line")), title=F.when(direct, "A secret is read in browser code").otherwise("Browser code leads to a module that reads a secret"), message=message, detail=detail, suggestion="Keep the module with the secret out of what the browser loads.", key=(F.col("target"), (names,)), current=chain, kind="a")


@rule("next/server-module-in-client-bundle", "architecture", "Ways from browser code to packages for servers.")
def server_module_in_bundle(a):
    names = F.slice("packages", 1, 4)
    detail = F.concat(F.array(chain_text(F.col("chain"))), F.transform(names, lambda x: said(F.col("target"), " imports ", x)))
    found = leaks_by(a, "package").where("size(chain) > 1")
    return rows(found, file=F.col("client"), title=F.lit("Browser code leads to a module meant for servers"), message=said("By way of ", F.col("client"), " the browser gets ", F.col("target"), ", which needs ", F.array_join(names, ", "), "."), detail=detail, suggestion="Cut the way at its weakest step, and let the server answer instead.", key=(F.col("target"), (names,)), current=F.col("chain"), kind="a")


# languages ------------------------------------------------------------------------


@rule("python/bare-except", "maintainability", "Handlers without a type.")
def bare_except(a):
    return _each_marker(a, "bare-except", _source() & (F.col("language") == "python"), "An `except:` without a type", "answers to whatever goes wrong, and to the user's wish to stop.", "Name what the handler is for.")


@rule("python/mutable-default", "maintainability", "Defaults that calls share and can change.")
def mutable_default(a):
    return _each_marker(a, "mutable-default", F.col("language") == "python", "A default that calls can change", "makes its default once, for all calls together.", "Make the value in the function where none is given.")


@rule("python/global-state", "maintainability", "Functions that set names of their module.")
def global_state(a):
    f = _marked(a, ("global-state",), _source() & (F.col("language") == "python"))
    n = F.size("m")
    return rows(f, file=F.col("path"), line=F.get("m", F.lit(0))["line"], title=said("Module names set by ", count_label(n, "`global` statement")), message=said("Functions of ", F.col("path"), " change what others read."), detail=_line_list(), suggestion="Let the function take the old value and give the new one back.", current=n)


@rule("go/ignored-error", "maintainability", "Results that are dropped.")
def ignored_error(a):
    f = _marked(a, ("ignored-error",), _source() & (F.col("language") == "go"))
    n = F.size("m")
    detail = F.transform(F.slice("m", 1, 5), lambda x: F.trim(said("line ", x["line"], ": ", F.coalesce(x["text"], F.lit("")))))
    return rows(f, file=F.col("path"), line=F.get("m", F.lit(0))["line"], title=said(count_label(n, "result"), " dropped unseen"), message=said(F.col("path"), " drops what a call gives back ", count_label(n, "time"), ", errors among it."), detail=detail, suggestion="Look at the error, or note why it can be left.", current=n)


@rule("go/large-package", "complexity", "Packages of many lines.")
def large_package(a):
    limit = a.settings.thresholds["maxFileLines"] * 5
    folder = F.coalesce(F.nullif(P.directory("path"), F.lit("")), F.lit("."))
    per = a.sources.where("language = 'go'").groupBy(folder.alias("d")).agg(F.sum("lines").alias("n"), F.count(F.lit(1)).alias("files"), F.min("path").alias("first")).where(F.col("n") > limit)
    return rows(per, file=F.col("first"), title=said(F.col("d"), " adds up to ", F.format_number("n", 0), " lines"), message=said(F.col("files"), " files of ", F.col("d"), " have ", F.format_number("n", 0), f" lines; {limit:,} are allowed."), suggestion="Let a part of it become a package.", key=(F.col("d"),), baseline=limit, current=F.col("n"))


# patterns --------------------------------------------------------------------------


def defined_exports(files: DataFrame) -> DataFrame:
    """(path, name) of exported names that a file defines itself, without conventional and short ones."""
    names = F.transform(F.filter("functions", lambda f: F.array_contains("exports", f["name"])), lambda f: f["name"])
    each = files.select("path", F.explode(names).alias("name"))
    return each.where(~F.col("name").isin(*CONVENTIONAL_NAMES) & (F.length("name") >= 4))


def shared_names(a: Analysis) -> DataFrame:
    """(set, n, files, names) of names that the same set of files defines, without sets that a design explains.

    A name's files become a mark that adds up, and names of one mark a group.
    A set is explained if one of its files imports all others, or another
    module imports all of them: members are rows, joined to edges and counted.
    ``n`` counts its files; ``files`` lists the first ``marks.MANY``.
    """
    defined = cut(defined_exports(a.sources))
    per = defined.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.array_join(marks.sums("path").cast("array<string>"), ".").alias("set")).where("n > 1")
    groups = cut(per.groupBy("set", "n").agg(F.array_sort(F.collect_list("name")).alias("names")))
    places = cut(defined.join(groups.select("set", F.get("names", F.lit(0)).alias("name")), "name").select("set", "path"))
    member = places.distinct()
    takers = member.join(a.edges.select("src", F.col("dst").alias("path")), "path").groupBy("set", "src").agg(F.countDistinct("path").alias("taken"))
    inside = member.select("set", F.col("path").alias("src"), F.lit(1).alias("own"))
    sizes = member.groupBy("set").agg(F.count(F.lit(1)).alias("size"))
    explained = takers.join(sizes, "set").join(inside, ["set", "src"], "left").where(F.col("taken") >= F.col("size") - F.coalesce("own", F.lit(0))).select("set").distinct()
    shown = marks.listed(places, ["set"], ["path"], "p").select("set", F.transform("p", lambda x: x["path"]).alias("files"))
    return groups.join(explained, "set", "left_anti").join(shown, "set").select("set", "n", "files", "names")


@rule("patterns/duplicate-helper", "maintainability", "Functions that several files define.")
def duplicate_helper(a):
    g = a.shared_names.where(F.size("names") < PARALLEL).select("set", "n", "files", F.explode("names").alias("name"))
    n = F.col("n").cast("int")
    return rows(g, file=F.get("files", F.lit(0)), title=said(n, " files have their own ", F.col("name"), "()"), message=said("`", F.col("name"), "` is defined and offered by ", n, " files, and each has to be kept right."), detail=F.col("files"), suggestion="Let one file offer it, or give them names that tell them apart.", key=(F.col("name"), (whole_or_mark(F.col("files"), n, F.col("set")),)), current=F.col("files"), kind="a")


@rule("patterns/parallel-implementations", "maintainability", "Modules with the same names inside.")
def parallel(a):
    g = a.shared_names.where(F.size("names") >= PARALLEL)
    names, files, n = F.col("names"), F.col("files"), F.col("n").cast("int")
    return rows(g, file=F.get(files, F.lit(0)), title=said(F.size(names), " names that ", n, " modules share"), message=said(F.array_join(F.slice(names, 1, 4), ", "), F.when(F.size(names) > 4, " and more").otherwise(""), " are found in each of ", F.array_join(F.slice(files, 1, 4), ", "), F.when(n > 4, " and more").otherwise(""), "."), detail=names, suggestion="Settle on one of the modules, or on one place that picks between them.", key=((whole_or_mark(files, n, F.col("set")),), (names,)), current=names, kind="a")


@rule("patterns/thin-wrapper", "maintainability", "Modules that pass one call on.")
def thin_wrapper(a):
    f = a.sources.where("language <> 'go' and size(exports) = 1 and size(functions) = 1").withColumn("fn", F.get("functions", F.lit(0))).where("fn.complexity <= 1 and fn.lines <= 3 and array_contains(exports, fn.name)")
    # only what such files import is asked for
    own = a.imported("resolved", own=f)[0]
    one = own.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target")).where("n = 1")
    f = cut(f.select("path", "fn").join(one, "path"))
    f = f.join(a.edges.select(F.col("dst").alias("path")).join(f.select("path"), "path", "left_semi").distinct(), "path", "left_semi")
    return rows(f, file=F.col("path"), line=F.col("fn.line"), title=said(P.base_name("path"), " adds nothing to ", P.base_name("target")), message=said("All that ", F.col("path"), " offers is one function of ", F.col("fn.lines"), " lines over ", F.col("target"), "."), detail=F.array(said(F.col("path"), " -> ", F.col("target"))), suggestion="Let its users take the target.", key=(F.col("target"),), current=F.col("target"), kind="s")


@rule("patterns/abstraction-growth", "architecture", "Folders of small modules with one user each.")
def abstraction_growth(a):
    into = a.edges.groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("dependents"))
    folder = F.when(F.contains("path", F.lit("/")), P.directory("path")).otherwise(".")
    single = (F.col("sloc") <= SMALL_SLOC) & (F.size("functions") <= SMALL_FUNCTIONS) & (F.col("dependents") == 1)
    per = a.sources.join(into, "path", "left").groupBy(folder.alias("d")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(single, F.col("path")))).alias("single"))
    per = per.where((F.col("n") >= GROWTH_FILES) & (F.size("single") >= GROWTH_SINGLE) & (F.size("single") / F.col("n") >= GROWTH_SHARE))
    k = F.size("single")
    return rows(per, file=F.get("single", F.lit(0)), title=said(k, " small modules of ", F.col("d"), "/ have a single user"), message=said("Of ", F.col("n"), " files in ", F.col("d"), "/ ", k, f" have at most {SMALL_SLOC} lines and one importer."), detail=F.slice("single", 1, 8), suggestion="Put small modules where they are used.", key=(F.col("d"), k), current=k)


# dependencies ------------------------------------------------------------------------


def major(version: Column) -> Column:
    """The major number of a version range; null where it names none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(version, r"^[\^~>=<\s]*", ""), r"(\d+)\.", 1), F.lit(""))


@rule("dependencies/major-version-change", "dependencies", "Packages with another major number than before.")
def major_change(a):
    if a.base_packages is None:
        return None
    both = a.packages.join(a.base_packages.withColumnRenamed("version", "old"), "package").withColumns({"x": major(F.col("old")), "y": major(F.col("version"))}).where("x <> y")
    p, old, new = F.col("package"), F.col("old"), F.col("version")
    return rows(both, file=F.lit("package.json"), title=said(p, " goes from major ", F.col("x"), " to ", F.col("y")), message=said("The range of ", p, " was ", old, " and is ", new, "."), suggestion=said("See what ", p, " no longer does."), key=(p, old, new), baseline=old, current=new, kind="s")


def _one_list(found: DataFrame, title, message, detail, suggestion: str) -> DataFrame:
    n, every = F.size("all"), F.col("all")
    return rows(found, file=F.lit("package.json"), title=title(n), message=message(F.array_join(every, ", ")), detail=detail, suggestion=suggestion, key=((every,),), current=every, kind="a")


@rule("dependencies/new-dependency", "dependencies", "Packages that weren't declared before.")
def new_dependency(a):
    if a.base_packages is None:
        return None
    added = a.packages.join(a.base_packages, "package", "left_anti").agg(F.array_sort(F.collect_list("package")).alias("all"), F.array_sort(F.collect_list(F.concat_ws("@", "package", "version"))).alias("at")).where("size(all) > 0")
    return _one_list(added, lambda n: said(count_label(n, "package"), " not declared before"), lambda s: said("Declared since the base: ", s, "."), F.col("at"), "Ask of each what it is for.")


@rule("dependencies/unused-dependency", "dependencies", "Declared packages without an import.")
def unused_dependency(a):
    if not a.info.dependencies:
        return None
    found = _listed(resolve.unused_packages(list(a.info.dependencies), a.external), "package")
    return _one_list(found, lambda n: said("Nothing imports ", count_label(n, "declared package")), lambda s: said("No source names ", s, "; other tools may."), F.col("all"), "Take out those that no tool needs either.")


@rule("dependencies/duplicate-dependency", "dependencies", "Packages in both lists.")
def duplicate_dependency(a):
    twice = sorted(set(a.info.dependencies) & set(a.info.dev_dependencies))
    if not twice:
        return None
    found = a.spark.createDataFrame([(twice,)], "all array<string>")
    return _one_list(found, lambda n: said(count_label(n, "package"), " in both dependency lists"), lambda s: said("Two ranges are given for ", s, "."), F.col("all"), "Leave each in the list that fits.")
