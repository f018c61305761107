"""Imports to files: what an import spells, joined to what the files may be spelled as.

A file may be spelled three ways at most: by its path, without its extension
and without /index.  So an import is one row for what it spells, not one for
each path that it could mean, and the least place in the order of extensions
gives the file.  Nothing is looked up on the driver, so a project of any size
resolves by one shuffle of imports.  Files are dealt into slices that resolve
one after the other, so what is shuffled at a time doesn't grow with the project.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import paths as P
from quern.sources.project import Alias, ProjectInfo

#: Fixed: extensions in the order they are tried.
EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
#: What stands behind a spelled path, by place: nothing, an extension, or one of an index file.
SUFFIXES = ("", *EXTENSIONS, *(f"/index{e}" for e in EXTENSIONS))
#: Fixed: specifiers that name an asset, not a module.
ASSET = r"(?i)\.(css|scss|sass|less|styl|svg|png|jpe?g|gif|webp|avif|ico|bmp|woff2?|ttf|otf|eot|mp[34]|webm|wav|ogg|pdf|txt|md|mdx|csv|ya?ml|json|json5|graphql|gql|wasm|glsl|frag|vert)(\?.*)?$"


#: Imports that are resolved at a time.
SLICE = 16_000_000


@dataclass(frozen=True)
class Graph:
    """edges (src, dst, line, type_only), external (path, package), unresolved (path, specifier, line, ordinal), resolved (path, ordinal, target); ``slices`` are those of a part of the files each, if there are several."""

    edges: DataFrame
    external: DataFrame
    unresolved: DataFrame
    resolved: DataFrame
    slices: tuple[Graph, ...] = ()

    def whole(self, name: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A table, kept slice by slice: no two rows of different slices are of one file."""
        return reduce(DataFrame.unionByName, [keep(getattr(g, name)) for g in self.slices or (self,)])


def package_of(raw: Column) -> Column:
    """The package a specifier belongs to; null for relative, absolute and ``@/`` ones."""
    scoped = F.when(raw.startswith("@/"), None).otherwise(F.substring_index(raw, "/", 2))
    inner = F.when(raw.startswith("node:"), raw).when(raw.startswith("@"), scoped).otherwise(F.substring_index(raw, "/", 1))
    return F.when(~raw.startswith(".") & ~raw.startswith("/"), inner)


def is_asset(raw: Column) -> Column:
    return raw.rlike(ASSET)


def is_aliased(raw: Column, aliases: tuple[Alias, ...]) -> Column:
    said = F.lit(False)
    for a in aliases:
        said = said | ((raw == a.prefix) if a.exact else raw.startswith(a.prefix) if a.prefix else F.lit(False))
    return said


def _spots(path: Column) -> Column:
    """What a specifier may spell to mean a file, as (key, place): its path, the path without extension, and that without /index; ``SUFFIXES`` are in the order of places."""
    ending = F.regexp_extract(path, r"\.(?:[cm]?[jt]s|[jt]sx)\z", 0)
    n = F.array_position(F.array(*map(F.lit, EXTENSIONS)), ending).cast("int")
    stem = F.left(path, F.length(path) - F.length(ending))
    spot = lambda key, place: F.struct(key.alias("key"), place.cast("int").alias("place"))
    inner = F.when((n > 0) & stem.endswith("/index"), spot(F.left(stem, F.length(stem) - len("/index")), n + len(EXTENSIONS)))
    return F.array_compact(F.array(spot(path, F.lit(0)), F.when(n > 0, spot(stem, n)), inner))


def _asked(bases: Column) -> Column:
    """(key, turn, kind) of what a script's specifier spells; one in .js may also mean another extension of the same name."""
    ask = lambda key, turn, kind: F.struct(key.alias("key"), turn.cast("int").alias("turn"), F.lit(kind).alias("kind"))

    def one(base: Column, i: Column) -> Column:
        bare = F.regexp_replace(base, r"\.[cm]?js$", "")
        return F.array_compact(F.array(ask(base, 2 * i, "any"), F.when(bare != base, ask(bare, 2 * i + 1, "extension"))))

    return F.flatten(F.transform(bases, one))


def _script_bases(path: Column, raw: Column, info: ProjectInfo) -> Column:
    """What a specifier spells, in order: relative, or by alias, then from source roots."""
    none = F.array().cast("array<string>")
    parts = []
    for a in info.aliases:
        rest = F.expr("''") if a.exact else F.expr(f"substring(raw, {len(a.prefix) + 1})")
        spelled = [F.lit(t) if a.exact else F.concat(F.lit(t + "/" if t else ""), rest) for t in a.targets]
        fits = (raw == a.prefix) if a.exact else raw.startswith(a.prefix)
        parts.append(F.when(fits, F.array(*spelled) if spelled else none).otherwise(none))
    roots = [F.concat(F.lit(r + "/"), raw) for r in info.source_roots]
    others = F.concat(*parts, F.array(*roots) if roots else none)
    return F.when(raw.startswith("."), F.array(P.joined(P.directory(path), raw))).otherwise(others)


def _python_candidates(path: Column, raw: Column, info: ProjectInfo) -> Column:
    dots = F.length(F.regexp_extract(raw, r"^(\.*)", 1))
    module = F.translate(F.expr("substring(raw, length(regexp_extract(raw, '^([.]*)', 1)) + 1)"), ".", "/")
    parts = P.segments(P.directory(path))
    up = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - (dots - 1), F.lit(0))), "/")
    inside = F.concat(up, F.lit("/"), module)
    relative = F.when(module != "", F.array(F.concat(inside, F.lit(".py")), F.concat(inside, F.lit("/__init__.py")))).otherwise(F.array(F.concat(up, F.lit("/__init__.py"))))
    spelled = [F.concat(F.lit(r + "/" if r else ""), F.translate(raw, ".", "/"), F.lit(end)) for r in ("", *info.source_roots) for end in (".py", "/__init__.py")]
    return F.when(raw.startswith("."), relative).otherwise(F.array(*spelled))


def imports_of(files: DataFrame) -> DataFrame:
    """One row for each import: path, language, is_test, ordinal and its fields."""
    return files.select("path", "language", "is_test", F.posexplode("imports").alias("ordinal", "i")).select("path", "language", "is_test", "ordinal", "i.*")


def _parts(own: DataFrame) -> int:
    """How many slices the imports of some files are resolved in."""
    total = own.agg(F.sum(F.size("imports"))).first()[0] or 0
    return -(-total // SLICE) or 1


def _part(own: DataFrame, i: int, parts: int) -> DataFrame:
    return own if parts == 1 else own.where(F.pmod(F.xxhash64("path"), F.lit(parts)) == i)


def _known(files: DataFrame) -> DataFrame:
    """(key, least, extended): the least place of the files that a key may mean, and of those with an extension."""
    return files.select(F.explode(_spots(F.col("path"))).alias("s")).select("s.*").groupBy("key").agg(F.min("place").alias("least"), F.min(F.when(F.col("place").between(1, len(EXTENSIONS)), F.col("place"))).alias("extended"))


def build_graph(files: DataFrame, info: ProjectInfo, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Graph:
    """The import graph of parsed files: the first import of a file that means another makes the edge.

    Self edges and imports built at run time make none.  Tables are lazy;
    ``keep`` may write what files are spelled as and the imports with their
    targets, which all of them read.
    """
    parts, known = _parts(files), _known(files)
    if parts == 1:
        return _resolved(files, files, known, info, keep)
    known = keep(known)
    slices = tuple(_resolved(_part(files, i, parts), files, known, info, keep) for i in range(parts))
    return Graph(*(reduce(DataFrame.unionByName, [getattr(g, name) for g in slices]) for name in ("edges", "external", "unresolved", "resolved")), slices)


def tables(names: tuple[str, ...], files: DataFrame, info: ProjectInfo, keep: Callable[[DataFrame], DataFrame], drop: Callable[..., None], own: DataFrame | None = None, where: Column | None = None) -> tuple[DataFrame, ...]:
    """Some of the graph's tables alone, as ``build_graph`` has them; what they are made from is dropped slice by slice.

    ``own`` are the files whose imports are asked for, all if not given, and
    ``where`` says of which: it may look at what an import spells and at the
    ``package`` that it names if it means no file.
    """
    own = files if own is None else own
    parts, known = _parts(own), _known(files)
    if parts > 1:
        known = keep(known)
    made: list[DataFrame] = []

    def note(df: DataFrame) -> DataFrame:
        made.append(keep(df))
        return made[-1]

    out: list[list[DataFrame]] = [[] for _ in names]
    for i in range(parts):
        g = _resolved(_part(own, i, parts), files, known, info, note, where)
        for rows, name in zip(out, names):
            rows.append(keep(getattr(g, name)))
        drop(*made)
        made.clear()
    if parts > 1:
        drop(known)
    return tuple(reduce(DataFrame.unionByName, rows) for rows in out)


def _package(info: ProjectInfo) -> Column:
    """The package that an import names if it means no file; null for none."""
    raw, language = F.col("raw"), F.col("language")
    go = F.when(F.contains(raw, F.lit(".")) & ~raw.startswith("."), raw)
    python = F.when(~raw.startswith("."), F.substring_index(raw, ".", 1))
    return F.nullif(F.when(language == "go", go).when(language == "python", python).when(~is_aliased(raw, info.aliases), package_of(raw)), F.lit(""))


def _resolved(own: DataFrame, files: DataFrame, known: DataFrame, info: ProjectInfo, keep: Callable[[DataFrame], DataFrame], where: Column | None = None) -> Graph:
    """The graph of some files' own imports, among all files and what they are spelled as; ``where`` as for ``tables``."""
    path, raw, python = F.col("path"), F.col("raw"), F.col("language") == "python"
    imports = imports_of(own).where("not computed")
    if where is not None:
        imports = imports.withColumn("package", _package(info)).where(where)
    imports = imports.select("path", "language", "ordinal", "raw", "line", "type_only")
    exact = F.transform(_python_candidates(path, raw, info), lambda x, i: F.struct(x.alias("key"), i.cast("int").alias("turn"), F.lit("exact").alias("kind")))
    spelled = imports.where("language <> 'go'").withColumn("asked", F.when(python, exact).otherwise(_asked(_script_bases(path, raw, info))))
    none = F.lit(None).cast("string")
    place = F.when(F.col("kind") == "any", F.col("least")).when(F.col("kind") == "extension", F.col("extended")).when(F.col("least") == 0, F.lit(0))
    target = F.concat("key", F.get(F.array(*map(F.lit, SUFFIXES)), place))
    # an import that spells nothing stays as a row without a key
    found = spelled.select(*imports.columns, F.size("asked").alias("n"), F.explode_outer("asked").alias("a")).select(*imports.columns, "n", "a.*").join(known, "key", "left").select(*imports.columns, "n", "turn", target.alias("target"))
    # a Go import means every file of a folder
    go = imports.where("language = 'go'")
    if info.go_module:
        inside = F.when(raw == info.go_module, "").when(raw.startswith(info.go_module + "/"), F.expr(f"substring(raw, {len(info.go_module) + 2})"))
        folder = files.where("path like '%.go' and path not like '%\\_test.go'").select(F.col("path").alias("target"), P.directory("path").alias("folder"))
        inner = go.withColumn("folder", inside)
        go = inner.where("folder is not null").join(folder, "folder", "left").drop("folder").unionByName(inner.where("folder is null").drop("folder").withColumn("target", none))
    else:
        go = go.withColumn("target", none)
    found = keep(found.unionByName(go.select(*imports.columns, F.lit(1).alias("n"), F.lit(0).alias("turn"), "target")))
    # an import that spells one path at most is settled by the join; others take the first that there is
    one = found.where("n <= 1").select(*imports.columns, "target")
    several = found.where("n > 1").groupBy("path", "ordinal").agg(F.first(F.struct("language", "raw", "line", "type_only")).alias("i"), F.min(F.when(F.col("target").isNotNull(), F.struct("turn", "target"))).alias("t")).select("path", "i.language", "ordinal", "i.raw", "i.line", "i.type_only", "t.target")
    linked = one.union(several)
    hit = linked.where("target is not null")
    # the first import's line and kind in one number, so that hashing aggregates them without a sort
    first = F.min(F.shiftleft(F.col("ordinal").cast("long"), 32) + F.col("line") * 2 + F.col("type_only").cast("int"))
    edges = hit.where("path <> target").groupBy(F.col("path").alias("src"), F.col("target").alias("dst")).agg(first.alias("f")).select("src", "dst", F.shiftright(F.col("f").bitwiseAND(F.lit((1 << 32) - 1)), 1).cast("int").alias("line"), (F.col("f").bitwiseAND(F.lit(1)) == 1).alias("type_only"))
    left = linked.where("target is null")
    script = ~F.col("language").isin("python", "go")
    left = left.withColumn("package", _package(info))
    external = left.where("package is not null").select("path", "package").distinct()
    unresolved = left.where(script & F.col("package").isNull() & ~is_asset(raw)).select("path", F.col("raw").alias("specifier"), "line", "ordinal")
    return Graph(edges, external, unresolved, hit.select("path", "ordinal", "target"))


def unused_packages(declared: list[str], external: DataFrame) -> DataFrame:
    """Declared packages that nothing imports and that don't work without being imported."""
    spark = external.sparkSession
    rows = spark.createDataFrame([(d,) for d in declared], "package string")
    return rows.join(external.select("package"), "package", "left_anti").where(~is_implicit(F.col("package"))).orderBy("package")


def undeclared_packages(external: DataFrame, declared: list[str]) -> DataFrame:
    """Imported packages that no manifest declares; without the platform's own modules."""
    return external.select("package").distinct().where(~is_builtin(F.col("package")) & ~F.col("package").isin(declared or [""])).orderBy("package")


#: Fixed: the platform's modules, and packages that do their job without being imported.
BUILTINS = ("fs", "path", "os", "url", "util", "events", "stream", "crypto", "http", "https", "child_process", "assert", "buffer", "zlib", "net", "tls", "dns", "readline", "worker_threads", "perf_hooks", "string_decoder", "querystring", "timers", "tty", "v8", "vm", "process", "module")
IMPLICIT = r"^@types/|^react-dom$|^eslint|^@eslint/|^typescript-eslint$|^prettier|^postcss|^tailwindcss$|^autoprefixer$|^typescript$|^tsx$|^tsup$|^vite$|^vitest|^@vitest/|^jest$|^husky$|^lint-staged$|^sharp$|^encoding$"


def is_builtin(name: Column) -> Column:
    return name.startswith("node:") | name.isin(*BUILTINS)


def is_implicit(name: Column) -> Column:
    return name.rlike(IMPLICIT)
