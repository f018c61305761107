"""A project's tree as a source: listing by globs, texts, manifests, aliases, modules, frameworks."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import globs
from quern.functions.extract import LANGUAGES, language
from quern.plans.settings import MAX_FILES, NEVER, SAMPLE_IGNORE, Settings


def gitignore(text: str) -> list[str]:
    """The patterns of a root ignore file as globs; no negation."""
    out = []
    for line in map(str.strip, text.split("\n")):
        if line and not line.startswith(("#", "!")):
            body = line.removesuffix("/")
            out += [body.removeprefix("/")] if "/" in body else [f"**/{body}", f"**/{body}/**"]
    return out


def _text(root: str, name: str) -> str | None:
    try:
        with open(os.path.join(root, name), encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return None


def _is_file(entry: os.DirEntry) -> bool:
    """Files and links to files; links to folders aren't followed, so a walk ends."""
    try:
        return entry.is_file()
    except OSError:
        return False


def scan(root: str, settings: Settings, max_files: int = MAX_FILES) -> tuple[list[str], bool]:
    """(source paths below ``root``, sorted; whether the cap cut the walk)."""
    ignore = [*settings.ignore, *gitignore(_text(root, ".gitignore") or "")]
    found: list[str] = []

    def walk(folder: str, prefix: str) -> bool:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return False
        for e in entries:
            path = prefix + e.name
            if e.is_dir(follow_symlinks=False):
                if e.name not in NEVER and not globs.admits(path + "/", ignore) and not globs.admits(path, ignore) and walk(e.path, path + "/"):
                    return True
            elif language(e.name) != "unknown" and _is_file(e) and not globs.admits(path, ignore) and (not settings.include or globs.admits(path, list(settings.include))):
                found.append(path)
                if len(found) >= max_files:
                    return True
        return False

    cut = walk(root, "")
    return sorted(found), cut


def admitted(path, settings: Settings, ignore: list[str] = ()) -> object:
    """The listing's rules as a column, for trees that Spark lists itself."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    ext = F.lower(F.regexp_extract(F.element_at(parts, -1), r"(\.[^.]*)$", 1))
    keep = ext.isin(*LANGUAGES) & ~F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(x) for x in sorted(NEVER)]))
    keep &= ~globs.matches(path, [*settings.ignore, *ignore])
    return keep & globs.matches(path, list(settings.include)) if settings.include else keep


def read_texts(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(path, text) of the named files, read by the tasks; null text where one can't be read."""

    def read(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": [_text(root, p) for p in batch["path"]]})

    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths) // 200))
    return rows.mapInPandas(read, "path string, text string")


def read_tree(spark: SparkSession, root: str, settings: Settings) -> DataFrame:
    """(path, text) of a tree on a shared file system, listed and read by Spark; no cap."""
    base = root.rstrip("/") + "/"
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    path = F.expr("substring(file, instr(file, '" + base.replace("'", "") + "') + " + str(len(base)) + ")")
    return rows.select(path.alias("path"), "text").where(admitted("path", settings))


# manifests ---------------------------------------------------------------------

#: Fixed: framework by dependency, in order.
FRAMEWORKS = [("next", "Next.js"), ("react", "React"), ("react-native", "React Native"), ("vue", "Vue"), ("nuxt", "Nuxt"), ("svelte", "Svelte"), ("@angular/core", "Angular"), ("astro", "Astro"), ("vite", "Vite"), ("express", "Express"), ("@nestjs/core", "NestJS"), ("fastify", "Fastify"), ("hono", "Hono"), ("@remix-run/react", "Remix"), ("electron", "Electron")]
PYTHON_FRAMEWORKS = [("django", "Django"), ("fastapi", "FastAPI"), ("flask", "Flask")]
RUNNERS = {"pnpm": "pnpm", "npm": "npm run", "yarn": "yarn", "bun": "bun run"}
SCRIPTS = {"test": ("test", "test:unit", "tests", "vitest", "jest"), "build": ("build", "compile"), "typecheck": ("typecheck", "type-check", "tsc", "types"), "lint": ("lint", "eslint")}
#: Fixed: folders that act as roots of imports.
SOURCE_ROOTS = ("src", "app", "lib", "packages")


@dataclass(frozen=True)
class Alias:
    prefix: str
    targets: tuple[str, ...]
    exact: bool = False


@dataclass(frozen=True)
class ProjectInfo:
    root: str = ""
    name: str = ""
    is_git: bool = False
    package_manager: str | None = None
    languages: tuple[str, ...] = ()
    frameworks: tuple[str, ...] = ()
    monorepo: tuple[str, tuple[str, ...]] | None = None
    has_typescript: bool = False
    file_count: int = 0
    dependencies: dict[str, str] = field(default_factory=dict)
    dev_dependencies: dict[str, str] = field(default_factory=dict)
    entry_points: dict | None = None
    scripts: dict[str, str] | None = None
    aliases: tuple[Alias, ...] = ()
    go_module: str | None = None
    source_roots: tuple[str, ...] = ()


def manifest(root: str) -> dict | None:
    """The package manifest; null where there is none or it isn't JSON."""
    try:
        got = json.loads(_text(root, "package.json") or "")
        return got if isinstance(got, dict) else None
    except json.JSONDecodeError:
        return None


def _exists(root: str, *names: str) -> bool:
    return any(os.path.exists(os.path.join(root, n)) for n in names)


def package_manager(root: str, pkg: dict | None) -> str | None:
    said = (pkg or {}).get("packageManager") or ""
    for name in ("pnpm", "yarn", "bun"):
        if said.startswith(name):
            return name
    for name, locks in (("pnpm", ["pnpm-lock.yaml"]), ("bun", ["bun.lockb", "bun.lock"]), ("yarn", ["yarn.lock"]), ("npm", ["package-lock.json"])):
        if _exists(root, *locks):
            return name
    return "npm" if pkg else None


def workspaces(pkg: dict | None) -> tuple[str, ...]:
    said = (pkg or {}).get("workspaces")
    return tuple(said if isinstance(said, list) else (said or {}).get("packages") or ())


def monorepo(root: str, pkg: dict | None) -> tuple[str, tuple[str, ...]] | None:
    listed = _text(root, "pnpm-workspace.yaml")
    if listed is not None:
        return "pnpm", tuple(re.findall(r"""^[^\S\n]*-\s*['"]?([^'"\n]+)['"]?\s*$""", listed, re.M))
    if _exists(root, "nx.json"):
        return "nx", ()
    if _exists(root, "turbo.json"):
        return "turborepo", workspaces(pkg)
    own = workspaces(pkg)
    return ("yarn" if _exists(root, "yarn.lock") else "npm", own) if own else None


def python_frameworks(root: str) -> list[str]:
    found = []
    for name in ("requirements.txt", "pyproject.toml", "Pipfile"):
        text = _text(root, name) or ""
        found += [label for word, label in PYTHON_FRAMEWORKS if label not in found and re.search(rf"(^|\n)\s*{word}", text, re.I)]
    return found + ["Django"] * (_exists(root, "manage.py") and "Django" not in found)


def languages(root: str, paths: list[str]) -> tuple[str, ...]:
    found = {language(p) for p in paths if not p.endswith(".pyi")} - {"unknown"}
    return tuple(sorted(found | ({"go"} if _exists(root, "go.mod") else set())))


def _json_with_comments(text: str) -> dict:
    """JSON as tools write it: comments and trailing commas are dropped, strings kept."""
    bare = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return json.loads(re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare, flags=re.S))


def aliases(root: str) -> tuple[Alias, ...]:
    """Path aliases of the compiler's settings, and ``@/`` where they don't name it."""
    text = _text(root, "tsconfig.json")
    if text is None:
        return ()
    try:
        options = _json_with_comments(text).get("compilerOptions") or {}
    except (json.JSONDecodeError, AttributeError):
        return ()
    base = os.path.join(root, options.get("baseUrl") or "")
    out = []
    for pattern, targets in (options.get("paths") or {}).items():
        exact = "*" not in pattern
        cut = [t if exact else t[: t.find("*")] for t in targets]
        places = [os.path.relpath(os.path.normpath(os.path.join(base, c)), root).replace(os.sep, "/") for c in cut]
        out.append(Alias(pattern.split("*")[0], tuple("" if p == "." else p for p in places), exact))
    if not any(a.prefix == "@/" for a in out):
        out.append(Alias("@/", tuple(d for d in ("src", "app", "") if d == "" or _exists(root, d))))
    return tuple(out)


def go_module(root: str) -> str | None:
    m = re.search(r"^module\s+(\S+)", _text(root, "go.mod") or "", re.M)
    return m[1] if m else None


def is_git(root: str) -> bool:
    at = os.path.abspath(root)
    while not os.path.exists(os.path.join(at, ".git")):
        up = os.path.dirname(at)
        if up == at:
            return False
        at = up
    return True


def detect(root: str, paths: list[str]) -> ProjectInfo:
    """Everything a project's own files say about it."""
    pkg = manifest(root)
    own, dev = (pkg or {}).get("dependencies") or {}, (pkg or {}).get("devDependencies") or {}
    frameworks = [label for name, label in FRAMEWORKS if {**own, **dev}.get(name)] + python_frameworks(root)
    frameworks += ["Go modules"] * _exists(root, "go.mod")
    spoken = languages(root, paths)
    return ProjectInfo(
        root=root,
        name=(pkg or {}).get("name") or os.path.basename(os.path.abspath(root)),
        is_git=is_git(root),
        package_manager=package_manager(root, pkg),
        languages=spoken,
        frameworks=tuple(frameworks),
        monorepo=monorepo(root, pkg),
        has_typescript=_exists(root, "tsconfig.json") or bool({**own, **dev}.get("typescript")),
        file_count=len(paths),
        dependencies=own,
        dev_dependencies=dev,
        entry_points={k: pkg.get(k) for k in ("main", "module", "bin", "exports")} if pkg else None,
        scripts=(pkg or {}).get("scripts"),
        aliases=aliases(root) if {"typescript", "javascript"} & set(spoken) else (),
        go_module=go_module(root),
        source_roots=tuple(d for d in SOURCE_ROOTS if _exists(root, d)),
    )


def stack(p: ProjectInfo) -> str:
    """The stack in a line: first framework, then languages."""
    parts = list(p.frameworks[:1])
    if p.has_typescript or "typescript" in p.languages:
        parts.append("TypeScript")
    elif "javascript" in p.languages:
        parts.append("JavaScript")
    parts += [label for kind, label in (("python", "Python"), ("go", "Go")) if kind in p.languages]
    return " · ".join(dict.fromkeys(parts)) or "Unknown"


def find_script(scripts: dict[str, str], target: str) -> str | None:
    return next((n for n in SCRIPTS.get(target, (target,)) if isinstance(scripts.get(n), str)), None)


def commands(p: ProjectInfo) -> dict[str, str]:
    """How the project is tested, built, type-checked and linted."""
    if "go" in p.languages:
        return {"test": "go test ./...", "build": "go build ./..."}
    run, out = RUNNERS[p.package_manager or "npm"], {}
    for target in SCRIPTS:
        if p.scripts and (name := find_script(p.scripts, target)):
            out[target] = f"{run} {name}"
    if "typecheck" not in out and p.has_typescript:
        out["typecheck"] = "npx tsc --noEmit"
    if "test" not in out and "python" in p.languages:
        out["test"] = "pytest"
    return out


def verification_command(found: dict[str, str]) -> str | None:
    return next((found[k] for k in ("test", "typecheck", "build") if k in found), None)


# what a scan leaves out ------------------------------------------------------------

_SKIP = frozenset(("node_modules", ".git", "dist", "build", ".next", "coverage"))
_SOURCEISH = re.compile(r"\.(ts|tsx|js|jsx|mjs|cjs|py|go)$")


def folders(root: str, depth: int = 2, prefix: str = "") -> Iterator[str]:
    """Folders down to ``depth`` that could hold source."""
    try:
        entries = sorted(os.scandir(os.path.join(root, prefix)), key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        if e.is_dir(follow_symlinks=False) and not e.name.startswith(".") and e.name not in _SKIP:
            yield prefix + e.name
            if depth > 1:
                yield from folders(root, depth - 1, prefix + e.name + "/")


def count_sourceish(folder: str, depth: int = 6) -> int:
    n = 0
    try:
        for e in os.scandir(folder):
            if e.is_dir(follow_symlinks=False):
                n += count_sourceish(e.path, depth - 1) if depth else 0
            else:
                n += bool(_SOURCEISH.search(e.name))
    except OSError:
        pass
    return n


def skipped_samples(root: str, settings: Settings) -> list[tuple[str, int, str]]:
    """(folder, files, pattern) of sample code that the settings leave out."""
    patterns = [p for p in settings.ignore if p in SAMPLE_IGNORE]
    found: list[tuple[str, int, str]] = []
    for folder in folders(root):
        pattern = next((p for p in patterns if globs.admits(f"{folder}/x", [p])), None)
        if pattern and not any(folder.startswith(f + "/") for f, *_ in found) and (n := count_sourceish(os.path.join(root, folder))):
            found.append((folder, n, pattern))
    return sorted(found, key=lambda x: (-x[1], x[0]))
