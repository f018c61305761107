"""Glob patterns as one Java regular expression each; ordered lists of them as one column."""

from __future__ import annotations

import re
from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\*\*/|\*\*|\*|\?|\{[^}]*\}|.", re.S)
#: Fixed meanings of the wildcards.
_MEANING = {"**/": "(?:[^/]*/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
#: Fixed: folders around the source that a project's patterns may leave out.
WRAPPERS = ("src", "app_src", "source")


def _body(text: str) -> str:
    def one(token: str) -> str:
        if token in _MEANING:
            return _MEANING[token]
        if len(token) > 1:  # {a,b}: each choice is a glob
            return f"(?:{'|'.join(map(_body, token[1:-1].split(',')))})"
        return re.escape(token)

    return "".join(map(one, _TOKEN.findall(text)))


def normalized(glob: str) -> str:
    """Without spaces around it and a leading ./; slashes forward; a trailing one takes all below."""
    value = glob.strip().replace("\\", "/").removeprefix("./")
    return value + "**" if value.endswith("/") else value


def to_regex(glob: str) -> str:
    """A regex for whole paths; a name without wildcards also covers what lies in it."""
    value = normalized(glob)
    below = "" if re.search(r"[*?{}]", value) else "(?:/.*)?"
    return f"^{_body(value)}{below}$"


def project_globs(glob: str) -> list[str]:
    """The pattern as written and below each wrapper folder, unless it starts with one."""
    return [glob] if glob.removeprefix("./").split("/")[0] in WRAPPERS else [glob, *[f"{w}/{glob}" for w in WRAPPERS]]


def matches(path: Column | str, globs: list[str]) -> Column:
    """Whether the last of ``globs`` that matches admits the path; one with a leading ! excludes. No match: false."""
    path = F.col(path) if isinstance(path, str) else path

    def step(so_far: Column, run: tuple[bool, list[str]]) -> Column:
        excludes, own = run
        return F.when(path.rlike("|".join(to_regex(g.removeprefix("!")) for g in own)), F.lit(not excludes)).otherwise(so_far)

    # neighbours of one sign are one expression
    return reduce(step, [(k, list(own)) for k, own in groupby(globs, lambda g: g.startswith("!"))], F.lit(False))


def matches_project(path: Column | str, glob: str) -> Column:
    """Whether any spelling of a project's pattern matches."""
    path = F.col(path) if isinstance(path, str) else path
    return reduce(lambda a, b: a | b, [matches(path, [g]) for g in project_globs(glob)])


def admits(path: str, globs: list[str]) -> bool:
    """``matches`` for one path, for listings on the driver."""
    verdict = False
    for g in globs:
        if re.match(to_regex(g.removeprefix("!")), path, re.S):
            verdict = not g.startswith("!")
    return verdict
