"""Text of source files to rows: one adapter for each language, all to one schema."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import lines as L
from quern.functions.script import SERVER_ONLY, Script, path_literals

#: Fixed: language by extension.
LANGUAGES = {".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".pyi": "python", ".go": "go"}

_IMPORT = "struct<raw:string,kind:string,line:int,type_only:boolean,names:array<string>,wildcard:boolean,computed:boolean>"
_FUNCTION = "struct<name:string,line:int,end_line:int,lines:int,complexity:int,max_nesting:int,params:int,is_component:boolean>"
_MARKER = "struct<kind:string,line:int,text:string>"
_META = "use_client boolean, use_server boolean, has_jsx boolean, effects array<int>, server_only array<string>, env_reads array<struct<name:string,line:int>>, path_literals array<string>, package string"
#: A parsed file; ``error`` says why one could not be parsed.
PARSED = f"path string, language string, hash string, lines int, sloc int, is_test boolean, imports array<{_IMPORT}>, functions array<{_FUNCTION}>, exports array<string>, markers array<{_MARKER}>, {_META}, error string"


def language(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    return LANGUAGES.get(name[name.rfind(".") :] if "." in name else "", "unknown")


def _script(path: str, text: str, lines: list[str], kind: str) -> dict:
    s = Script(path, text)
    imports, said = s.imports(), s.directives()
    return {
        "sloc": L.sloc(lines, ("//",)),
        "imports": imports,
        "functions": [{k: f[k] for k in ("name", "line", "end_line", "lines", "complexity", "max_nesting", "params", "is_component")} for f in s.functions],
        "exports": s.exports(),
        "markers": s.markers(kind == "typescript"),
        "use_client": "use client" in said,
        "use_server": "use server" in said,
        "has_jsx": path.endswith((".tsx", ".jsx")),
        "effects": s.effects_without_deps(),
        "server_only": [i["raw"] for i in imports if i["raw"] in SERVER_ONLY],
        "env_reads": s.env_reads(),
        "path_literals": path_literals(text),
    }


#: One parser for each language: (path, text, lines, language) -> columns.
ADAPTERS: dict[str, Callable[[str, str, list[str], str], dict]] = {
    "typescript": _script,
    "javascript": _script,
    "python": lambda path, text, lines, kind: L.python(lines) | {"sloc": L.sloc(lines, ("#",))},
    "go": lambda path, text, lines, kind: L.go(lines) | {"sloc": L.sloc(lines, ("//",)), "package": L.go_package(lines)},
}
_EMPTY = {"imports": [], "functions": [], "exports": [], "markers": [], "use_client": False, "use_server": False, "has_jsx": False, "effects": [], "server_only": [], "env_reads": [], "path_literals": [], "package": None, "error": None}


def parse(path: str, text: str | None) -> dict:
    """The row of one file; a file that can't be read or parsed is an empty row with ``error``."""
    kind, text_ = language(path), text or ""
    lines = text_.split("\n")
    row = {"path": path, "language": kind, "hash": hashlib.sha1(text_.encode("utf-8", "replace")).hexdigest()[:16], "lines": len(lines), "sloc": 0, "is_test": L.is_test(path)} | _EMPTY
    if text is None:
        return row | {"error": "could not be read"}
    try:
        adapter = ADAPTERS.get(kind)
        return row | (adapter(path, text_, lines, kind) if adapter else {"sloc": L.sloc(lines, ("//", "#"))})
    except Exception as e:  # one file never fails the run
        return row | {"error": f"could not be parsed: {type(e).__name__}: {e}"}


def _arrow_type() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(PARSED))


def parse_files(raw: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """``PARSED`` rows of (path, text), one for each file, with ``text`` behind; ``without`` names columns to leave out."""
    schema = _arrow_type()
    out = T.StructType([f for f in T.StructType.fromDDL(f"{PARSED}, text string") if f.name not in without])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts = batch.column("path").to_pylist(), batch.column("text").to_pylist()
            rows = pa.RecordBatch.from_pylist([parse(p, t) for p, t in zip(paths, texts)], schema=schema)
            yield pa.RecordBatch.from_arrays([*rows.columns, batch.column("text")], names=[*schema.names, "text"]).select(out.names)

    return raw.select(F.col("path"), F.col("text")).mapInArrow(run, out)


def warnings(files: DataFrame) -> DataFrame:
    """file, message of the files that could not be read or parsed."""
    return files.where("error is not null").select(F.col("path").alias("file"), F.col("error").alias("message"))
