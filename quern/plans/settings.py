"""Settings of an analysis: presets, resolution of a project's own settings, checks of them, and their identity."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace

STATE_DIR = ".quern"
# Thresholds of the three presets, severities, patterns and key names.
_NAMES = ("maxFileLines", "maxFunctionLines", "maxComponentLines", "maxComplexity", "maxNesting", "maxParams", "maxImportDepth", "minDuplicateLines", "maxAnyPerKLoc")
THRESHOLDS = {
    "relaxed": dict(zip(_NAMES, (1200, 160, 1000, 25, 6, 8, 12, 12, 12))),
    "balanced": dict(zip(_NAMES, (800, 100, 800, 15, 4, 5, 8, 8, 6))),
    "strict": dict(zip(_NAMES, (400, 60, 300, 10, 3, 4, 6, 6, 2))),
}
SEVERITIES = {
    "architecture/circular-dependency": "error",
    "architecture/layer-violation": "error",
    "architecture/layer-skip": "warning",
    "architecture/cross-feature-import": "warning",
    "architecture/forbidden-dependency": "error",
    "architecture/deep-import-chain": "info",
    "architecture/unlayered-code": "info",
    "complexity/large-file": "warning",
    "complexity/large-function": "warning",
    "complexity/large-component": "warning",
    "complexity/high-complexity": "warning",
    "complexity/deep-nesting": "info",
    "complexity/too-many-params": "info",
    "maintainability/duplicate-block": "info",
    "maintainability/unresolved-import": "info",
    "type-safety/explicit-any": "warning",
    "type-safety/suppression": "warning",
    "type-safety/unsafe-assertion": "info",
    "type-safety/js-in-ts-project": "info",
    "react/effect-dependency-risk": "info",
    "next/server-import-in-client": "error",
    "next/secret-in-client-bundle": "error",
    "next/server-module-in-client-bundle": "error",
    "python/bare-except": "warning",
    "python/mutable-default": "warning",
    "python/global-state": "info",
    "go/ignored-error": "warning",
    "go/large-package": "info",
    "patterns/duplicate-helper": "warning",
    "patterns/parallel-implementations": "warning",
    "patterns/thin-wrapper": "info",
    "patterns/abstraction-growth": "info",
    "dependencies/major-version-change": "warning",
    "dependencies/new-dependency": "info",
    "dependencies/unused-dependency": "info",
    "dependencies/duplicate-dependency": "warning",
}
OVERLAYS = {
    "relaxed": {
        "architecture/layer-skip": "info",
        "architecture/cross-feature-import": "info",
        "complexity/deep-nesting": "off",
        "complexity/too-many-params": "off",
        "maintainability/duplicate-block": "off",
        "type-safety/explicit-any": "info",
        "type-safety/unsafe-assertion": "off",
        "type-safety/js-in-ts-project": "off",
        "architecture/deep-import-chain": "off",
        "patterns/thin-wrapper": "off",
        "patterns/abstraction-growth": "off",
        "patterns/parallel-implementations": "info",
        "dependencies/new-dependency": "off",
        "dependencies/unused-dependency": "off",
    },
    "balanced": {},
    "strict": {
        "architecture/layer-skip": "error",
        "architecture/cross-feature-import": "error",
        "complexity/deep-nesting": "warning",
        "complexity/too-many-params": "warning",
        "maintainability/duplicate-block": "warning",
        "type-safety/unsafe-assertion": "warning",
        "type-safety/js-in-ts-project": "warning",
        "react/effect-dependency-risk": "warning",
        "patterns/thin-wrapper": "warning",
        "patterns/abstraction-growth": "warning",
        "dependencies/new-dependency": "warning",
    },
}
#: Sample code: reported apart from build output where it is skipped.
SAMPLE_IGNORE = ["**/fixtures/**", "**/__fixtures__/**", "**/__mocks__/**", "**/__snapshots__/**", "**/testdata/**", "examples/**", "example/**", "**/*.stories.*", "**/*.fixture.*"]
_BUILT = ["node_modules", ".git", "dist", "build", "out", ".next", ".nuxt", ".turbo", ".venv", "venv", "__pycache__", "vendor", "coverage", ".cache", ".svelte-kit", "target"]
_TOOLS = [STATE_DIR, "playwright-report", "test-results", "storybook-static", ".vercel", ".output", ".astro"]
IGNORE = [*[f"**/{d}/**" for d in _BUILT], "**/*.min.js", "**/*.d.ts", *[f"**/{d}/**" for d in _TOOLS], *SAMPLE_IGNORE]
#: Folders that are never listed, whatever the settings say.
NEVER = frozenset([*_BUILT, *_TOOLS, ".idea", ".vscode", ".parcel-cache"])
MAX_FILES = 20_000
CI = {"failOn": "error", "maxOverallDrop": 5, "newFindingsOnly": True}
_KEYS = {
    "": ("strictness", "include", "ignore", "architecture", "thresholds", "rules", "ci", "scope"),
    "architecture": ("layers", "layerPolicy", "featureRoot", "forbidden"),
    "thresholds": _NAMES,
    "ci": tuple(CI),
}
_LEVELS = ("off", "info", "warning", "error")
_CHOICES = {"strictness": tuple(THRESHOLDS), "architecture.layerPolicy": ("adjacent", "downward"), "ci.failOn": ("warning", "error", "never")}
_FILES = tuple(f"{stem}.{ext}" for stem in (f"{STATE_DIR}/config", "quern.config") for ext in ("ts", "mts", "js", "mjs", "json")) + (".quernrc.ts", ".quernrc.js", ".quernrc.mjs", ".quernrc.json", ".quernrc")


@dataclass(frozen=True)
class Settings:
    strictness: str = "balanced"
    include: tuple[str, ...] = ()
    ignore: tuple[str, ...] = tuple(IGNORE)
    layers: dict[str, list[str]] = field(default_factory=dict)
    layer_policy: str = "adjacent"
    feature_root: str | None = None
    forbidden: tuple[tuple[str, str], ...] = ()
    thresholds: dict[str, int] = field(default_factory=lambda: dict(THRESHOLDS["balanced"]))
    rules: dict[str, str] = field(default_factory=lambda: dict(SEVERITIES))
    ci: dict[str, object] = field(default_factory=lambda: dict(CI))
    scope: tuple[str, ...] = ()
    source: str | None = None
    warnings: tuple[str, ...] = ()


def rule_severities(strictness: str) -> dict[str, str]:
    return SEVERITIES | OVERLAYS[strictness]


def base(strictness: str = "balanced") -> Settings:
    """A preset without a project's own settings."""
    return Settings(strictness=strictness, layer_policy="downward" if strictness == "relaxed" else "adjacent", thresholds=dict(THRESHOLDS[strictness]), rules=rule_severities(strictness))


def merge_ignore(defaults: Iterable[str], project: Iterable[str]) -> list[str]:
    """Defaults without those that the project takes back by a leading !, then the project's own."""
    project = list(project)
    back = {p[1:] for p in project if p.startswith("!")}
    return [p for p in defaults if p not in back] + [p for p in project if not p.startswith("!")]


def resolve(raw: dict) -> Settings:
    """A preset with a project's settings over it."""
    b = base(raw.get("strictness") if raw.get("strictness") in THRESHOLDS else "balanced")
    arch = raw.get("architecture") or {}
    return replace(
        b,
        include=tuple(raw.get("include") or b.include),
        ignore=tuple(merge_ignore(b.ignore, raw.get("ignore") or ())),
        layers=arch.get("layers") or b.layers,
        layer_policy=arch.get("layerPolicy") or b.layer_policy,
        feature_root=arch.get("featureRoot") or b.feature_root,
        forbidden=tuple(tuple(p) for p in arch.get("forbidden") or () if isinstance(p, (list, tuple)) and len(p) == 2),
        thresholds=b.thresholds | (raw.get("thresholds") or {}),
        rules=b.rules | (raw.get("rules") or {}),
        ci=b.ci | (raw.get("ci") or {}),
        scope=tuple(raw.get("scope") or ()),
        warnings=tuple(validate(raw)),
    )


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def did_you_mean(value: str, candidates: Iterable[str]) -> str | None:
    """The first nearest candidate, if it is within one change for every four characters (one at least)."""
    candidates = list(candidates)
    if not candidates:
        return None
    best = min(candidates, key=lambda c: edit_distance(value.lower(), c.lower()))
    near = edit_distance(value.lower(), best.lower()) <= max(1, max(len(value), len(best)) // 4)
    return best if near else None


def _hint(value: str, candidates: Iterable[str]) -> str:
    best = did_you_mean(value, candidates)
    return f'; did you mean "{best}"?' if best else "."


def validate(raw: object) -> list[str]:
    """What is wrong with a project's settings, in words; never fatal."""
    out: list[str] = []
    if not isinstance(raw, dict):
        return out

    def part(name: str) -> dict:
        value = raw if not name else raw.get(name)
        return value if isinstance(value, dict) else {}

    for name, allowed in _KEYS.items():
        out += [f"{name + '.' if name else ''}{k} is not a setting{_hint(k, allowed)}" for k in part(name) if k not in allowed]
    for label, allowed in _CHOICES.items():
        head, _, key = label.rpartition(".")
        value = part(head).get(key)
        if value is not None and value not in allowed:
            out.append(f"{label}: {json.dumps(value)} is not valid; use {', '.join(allowed)}.")
    for rule, level in part("rules").items():
        if rule not in SEVERITIES:
            out.append(f'rules: "{rule}" is not a rule, so this severity is ignored{_hint(rule, SEVERITIES)}')
        elif level not in _LEVELS:
            out.append(f'rules["{rule}"]: {json.dumps(level)} is not a severity; use {", ".join(_LEVELS)}.')
    for i, pair in enumerate(part("architecture").get("forbidden") or ()):
        if not isinstance(pair, (list, tuple)) or len(pair) != 2:
            out.append(f"architecture.forbidden[{i}]: expected a [from, to] pair of glob patterns.")
    return out


def canonical(value: object) -> str:
    """JSON with sorted keys, without spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(s: Settings) -> str:
    """Identity of the settings that decide findings and scores; not of CI, scope or where they stand."""
    said = {
        "strictness": s.strictness,
        "include": sorted(s.include),
        "ignore": sorted(s.ignore),
        "architecture": {"layers": s.layers, "layerPolicy": s.layer_policy, "featureRoot": s.feature_root, "forbidden": sorted(f"{a} -> {b}" for a, b in s.forbidden)},
        "thresholds": s.thresholds,
        "rules": s.rules,
    }
    return hashlib.sha1(canonical(said).encode()).hexdigest()[:16]


def find(root: str) -> str | None:
    """The first settings file there is."""
    return next((p for p in (os.path.join(root, f) for f in _FILES) if os.path.exists(p)), None)


def read(path: str) -> dict:
    """A JSON settings file.  Scripts are never run: one is an error that says so."""
    if not path.endswith((".json", ".quernrc")):
        raise ValueError(f"{path} is a script; settings are read from JSON only")
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except json.JSONDecodeError as e:
        raise ValueError(f"could not parse {path} as JSON: {e}") from e


def load(root: str) -> Settings:
    """A project's settings, or the balanced preset where it has none."""
    path = find(root)
    return replace(resolve(read(path)), source=path) if path else base()


def write(root: str, raw: dict) -> str:
    """Write settings to the state folder."""
    path = os.path.join(state_dir(root), "config.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(raw, f, indent=2)
    return path


_LOCAL = ("cache/", "history/", "last-run/")


def state_dir(root: str) -> str:
    """The state folder, with an ignore file that names what is local; lines already there stay."""
    folder = os.path.join(root, STATE_DIR)
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, ".gitignore")
    held = open(path, encoding="utf-8").read() if os.path.exists(path) else ""
    lines = {x.strip().rstrip("/") for x in held.split("\n")}
    missing = [x for x in _LOCAL if x.rstrip("/") not in lines]
    if missing:
        with open(path, "a", encoding="utf-8") as f:
            f.write(("" if not held or held.endswith("\n") else "\n") + "\n".join(missing) + "\n")
    return folder


def as_dict(s: Settings) -> dict:
    return asdict(s)


def define(raw: dict) -> dict:
    """A project's settings as given; for settings kept in code."""
    return raw
