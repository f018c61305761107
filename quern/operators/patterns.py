"""Many glob patterns against many paths, without asking every path for every pattern.

A pattern has a key that its paths must hold: the path that it names, if it
has no wildcard; else the name at its end, the folder before its first
wildcard, or nothing.  A path has the keys of its folders, itself and its
name.  The two meet by equal keys, and only survivors are asked for the
pattern's regular expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.globs import normalized, project_globs, to_regex

#: Rows of compiled patterns that are sent to every task; more are joined by a shuffle.
FEW = 100_000
_WILD = re.compile(r"[*?{}]")


def key_of(glob: str) -> tuple[int, str]:
    """(how much it tells, the key) of a pattern."""
    value = normalized(glob)
    first = _WILD.search(value)
    if not first:
        return 2000 + len(value), f"at:{value}"
    last = value.rsplit("/", 1)[-1]
    if last and not _WILD.search(last):
        return 1000 + len(last), f"name:{last}"
    head = value[: first.start()].rpartition("/")[0]
    return (len(head), f"at:{head}") if head else (0, "")


def keys(path: Column) -> Column:
    """All keys of a path."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("at:"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.concat(above, F.array(F.concat(F.lit("name:"), F.element_at(parts, -1)), F.lit("")))


def _compiled(pairs: list[tuple[str, str]]) -> list[tuple[str, str, str, str, str]]:
    """(pair, side, key, regex of src, regex of dst) for each spelling of each pair; the side that tells more is looked up."""
    out = []
    for a, b in pairs:
        for x in project_globs(a):
            for y in project_globs(b):
                side, (_, key) = max(("src", key_of(x)), ("dst", key_of(y)), key=lambda s: s[1][0])
                out.append((f"{a} -> {b}", side, key, to_regex(x), to_regex(y)))
    return out


def forbidden_edges(edges: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``edges`` with each pair of patterns (``pair``) that their src and dst match, each pair once; edges differ in src or dst."""
    rows = _compiled(pairs)
    table = edges.sparkSession.createDataFrame(rows, "pair string, _side string, _key string, _x string, _y string")
    found = None
    for side in sorted({r[1] for r in rows}):
        own = table.where(F.col("_side") == side)
        asked = edges.withColumn("_key", F.explode(keys(F.col(side)))).join(F.broadcast(own) if len(rows) <= FEW else own, "_key")
        hit = asked.where(F.regexp_like("src", F.col("_x")) & F.regexp_like("dst", F.col("_y"))).select(*edges.columns, "pair")
        found = hit if found is None else found.unionByName(hit)
    return found.dropDuplicates(["src", "dst", "pair"])
