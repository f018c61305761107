"""Python and Go text, read line by line: functions, imports, exports, markers; and what all languages share."""

from __future__ import annotations

import re

#: Fixed: paths that hold tests.
TEST_PATH = r"(^|/)(tests?|__tests__|spec|e2e)/|\.(test|spec)\.[cm]?[jt]sx?$|(^|/)test_[^/]+\.py$|_test\.(py|go)$"
_TEST = re.compile(TEST_PATH)
_W = "[A-Za-z0-9_]"
_DEF = re.compile(rf"(\s*)(?:async\s+)?def\s+([A-Za-z_]{_W}*)\s*\(([^)]*)")
_CLASS = re.compile(rf"class\s+([A-Za-z_]{_W}*)")
_FROM = re.compile(r"\s*from\s+(\.*[A-Za-z0-9_.]*)\s+import\s+")
_IMPORT = re.compile(r"\s*import\s+([A-Za-z0-9_.]+(?:\s*,\s*[A-Za-z0-9_.]+)*)")
_PY_BRANCH = re.compile(r"(?:^|\s)(?:if|elif|for|while|except|assert|and|or)(?:\s|:|$)")
_MUTABLE = re.compile(r"=\s*(\[\s*\]|\{\s*\}|set\(\)|list\(\)|dict\(\))")
_BARE = re.compile(r"except\s*:\s*$|except\s+BaseException\s*:")
_GLOBAL = re.compile(rf"global\s+{_W}")
_FUNC = re.compile(rf"func\s+(?:\([^)]*\)\s*)?([A-Za-z_]{_W}*)\s*\(([^)]*)")
_GO_BRANCH = re.compile(r"(?:^|\s)(?:if|for|case|select|&&|\|\|)(?:\s|\{|$)")
_GO_PACKAGE = re.compile(rf"package\s+({_W}+)")
_GO_SINGLE = re.compile(rf'\s*import\s+(?:{_W}+\s+)?"([^"]+)"')
_GO_ENTRY = re.compile(r'\s*(?:[A-Za-z0-9_.]+\s+)?"([^"]+)"')
_DISCARDED = re.compile(r"(?:^|[\s(])_\s*(?:,\s*[A-Za-z0-9_.]+\s*)?(?::=|=)\s*[A-Za-z0-9_.]+\(|,\s*_\s*(?::=|=)\s*[A-Za-z0-9_.]+\(")


def is_test(path: str) -> bool:
    return bool(_TEST.search(path))


def sloc(lines: list[str], prefixes: tuple[str, ...]) -> int:
    """Lines with code: not blank, not in a block comment, not a line comment."""
    n, inside = 0, False
    for line in map(str.strip, lines):
        if inside:
            inside = "*/" not in line
        elif line.startswith("/*"):
            inside = "*/" not in line
        elif line and not line.startswith(("*", *prefixes)):
            n += 1
    return n


def indent(line: str) -> int:
    """Width of the white space in front; a tab counts four."""
    return len(line[: len(line) - len(line.lstrip())].replace("\t", "    "))


def is_blank(line: str) -> bool:
    return line.strip().startswith("#") or not line.strip()


def _imported(raw: str, line: int) -> dict:
    return {"raw": raw, "kind": "import", "line": line, "type_only": False, "names": None, "wildcard": False, "computed": False}


def python(lines: list[str]) -> dict:
    """Functions by indentation; imports, exports and markers by line."""
    out = {"imports": [], "functions": [], "exports": [], "markers": []}
    width = [None if is_blank(x) else indent(x) for x in lines]
    branches = [0 if w is None else len(_PY_BRANCH.findall(x)) for x, w in zip(lines, width)]

    def mark(kind: str, n: int, text: str) -> None:
        out["markers"].append({"kind": kind, "line": n, "text": text})

    for n, line in enumerate(lines, 1):
        text = line.strip()
        if m := _FROM.match(line):
            out["imports"].append(_imported(m[1], n))
        elif m := _IMPORT.match(line):
            out["imports"] += [_imported(x.strip(), n) for x in m[1].split(",")]
        if _BARE.match(text):
            mark("bare-except", n, text)
        if m := _DEF.match(line):
            own = indent(line)
            last = n
            for k in range(n, len(lines)):
                if width[k] is not None:
                    if width[k] <= own:
                        break
                    last = k + 1
            deepest = max((w - own) // 4 for w in [own, *(w for w in width[n:last] if w is not None)])
            params = [p for p in map(str.strip, m[3].split(",")) if p and p not in ("self", "cls")]
            out["functions"].append({"name": m[2], "line": n, "end_line": last, "lines": last - n + 1, "complexity": 1 + sum(branches[n:last]), "max_nesting": max(0, deepest - 1), "params": len(params), "is_component": False})
            if _MUTABLE.search(line):
                mark("mutable-default", n, text)
            if indent(line) == 0 and not m[2].startswith("_"):
                out["exports"].append(m[2])
        elif (c := _CLASS.match(line)) and indent(line) == 0:
            out["exports"].append(c[1])
        if _GLOBAL.match(text):
            mark("global-state", n, text)
    return out


def go(lines: list[str]) -> dict:
    """Functions by balance of braces; imports single or grouped; discarded results."""
    out = {"imports": [], "functions": [], "exports": [], "markers": []}
    grouped = False
    for n, line in enumerate(lines, 1):
        text = line.strip()
        if grouped:
            grouped = not text.startswith(")")
            if grouped and (m := _GO_ENTRY.match(line)):
                out["imports"].append(_imported(m[1], n))
        elif re.fullmatch(r"import\s*\(", text):
            grouped = True
        elif m := _GO_SINGLE.match(line):
            out["imports"].append(_imported(m[1], n))
        if not text.startswith("//") and _DISCARDED.search(line):
            out["markers"].append({"kind": "ignored-error", "line": n, "text": text})
        if m := _FUNC.match(line):
            depth, begun, branches, deepest, last = 0, False, 0, 0, n
            for k in range(n - 1, len(lines)):
                now, last = lines[k], k + 1
                if k >= n:
                    branches += len(_GO_BRANCH.findall(now))
                    deepest = max(deepest, depth - 1)
                depth += now.count("{") - now.count("}")
                begun = begun or "{" in now
                if begun and depth <= 0:
                    break
            params = [p for p in map(str.strip, m[2].split(",")) if p]
            out["functions"].append({"name": m[1], "line": n, "end_line": last, "lines": last - n + 1, "complexity": 1 + branches, "max_nesting": deepest, "params": len(params), "is_component": False})
    out["exports"] = [f["name"] for f in out["functions"] if "A" <= f["name"][0] <= "Z"]
    return out


def go_package(lines: list[str]) -> str:
    return next((m[1] for m in map(_GO_PACKAGE.match, lines) if m), "")
