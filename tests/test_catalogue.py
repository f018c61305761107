"""Graph operators on small edge lists, and a few queries against their SQL."""

import glob
import os

import duckdb
import pytest

from quern.operators import graph
from quern.functions import globs
from quern.plans import catalogue, project_queries, reports, rules

SF = "/root/testdata/sf0.001"


def _closure(spark, edges):
    return {(r.src, r.dst): r.depth for r in graph.closure(spark.createDataFrame(edges, "src string, dst string")).collect()}


def test_closure_takes_the_shortest_depth(spark):
    assert _closure(spark, [("e", "l"), ("e", "r"), ("l", "s"), ("r", "s"), ("e", "s")]) == {("e", "l"): 1, ("e", "r"): 1, ("l", "s"): 1, ("r", "s"): 1, ("e", "s"): 1}


def test_components_are_nodes_on_one_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "x")], "src string, dst string")
    got = {r.node: r.component for r in graph.strong_components(graph.closure(edges)).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c"}


def test_no_edges(spark):
    assert _closure(spark, []) == {}


def test_globs_cover_folders_choices_and_exclusions(spark):
    rows = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/x/b.tsx", "lib/a.ts", "srcs/a.ts", "src/gen/c.ts", "a.ts")], "path string")
    kept = lambda *g: {r.path for r in rows.where(globs.matches("path", list(g))).collect()}
    assert kept("src") == {"src/a.ts", "src/x/b.tsx", "src/gen/c.ts"} and kept() == set()
    assert kept("src", "!src/gen") == {"src/a.ts", "src/x/b.tsx"} and kept("**/*.{ts,tsx}", "!**/a.ts", "lib/**") == {"src/x/b.tsx", "src/gen/c.ts", "lib/a.ts"}


@pytest.mark.parametrize("name", ["sloc_per_file", "dup_block_windows", "edges_first_wins", "layer_relations", "session_debounce", "unused_dependencies", *(n for n, f in catalogue.QUERIES.items() if f.__module__ in (reports.__name__, rules.__name__, project_queries.__name__) and n in catalogue.SQL)])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df, rel = catalogue.QUERIES[name](spark, SF), con.sql(catalogue.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall())
