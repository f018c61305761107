"""Graph queries on all edges and their operators, against brute force."""

import random

import duckdb
import pytest

from quern.operators import graph
from quern.plans import catalogue, reports, rules  # noqa: F401 - they register queries

SF = "/root/testdata/sf0.001"


def _depths(edges):
    """(src, dst): least number of steps, of one at least."""
    after, out = {}, {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    for a in after:
        seen, at, depth = {}, {a}, 0
        while at:
            depth += 1
            at = {y for x in at for y in after.get(x, ()) if y not in seen}
            seen |= dict.fromkeys(at, depth)
        out |= {(a, b): k for b, k in seen.items()}
    return out


def _affected(depths):
    out = {}
    for _, b in depths:
        out[b] = out.get(b, 0) + 1
    return out


def _components(depths):
    out = {}
    for a, b in depths:
        if (b, a) in depths:
            out[a] = min(out.get(a, b), b)
    return out


@pytest.fixture
def by_joins(monkeypatch):
    """Beyond the local bound."""
    monkeypatch.setattr(graph, "LOCAL_EDGES", -1)


@pytest.mark.parametrize("seed, n, m, bound", [(1, 30, 36, graph.LOCAL_EDGES), (2, 30, 60, graph.LOCAL_EDGES), (3, 14, 22, -1)])
def test_operators_equal_brute_force(spark, monkeypatch, seed, n, m, bound):
    monkeypatch.setattr(graph, "LOCAL_EDGES", bound)
    rng = random.Random(seed)
    rows = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]  # self edges and repeats too
    df, depths = spark.createDataFrame([*rows, (None, 1), (2, None)], "src long, dst long"), _depths(rows)
    assert {r.node: r.component for r in graph.components(df).collect()} == _components(depths)
    assert {r.node: r.affected for r in graph.reach_counts(df).collect()} == _affected(depths)


class Rounds:
    """Counts the rounds of an operator: every table it writes."""

    def __init__(self, monkeypatch):
        self.n, write = 0, graph.cut

        def cut(df):
            self.n += 1
            return write(df)

        monkeypatch.setattr(graph, "cut", cut)


def test_contraction_of_chains_trees_and_cycles(spark, monkeypatch, by_joins):
    # a cycle of 300 without a way out, one of 300 through a hub, a tree into each, a chain out of each, two hubs with a loop of their own
    ring = [(i, (i + 1) % 300) for i in range(300)]
    hub = [(1000 + i, 1000 + (i + 1) % 300) for i in range(300)] + [(1000, 5000), (1000, 1000), (5000, 5001), (5001, 5001)]
    tree = [(2000 + i, 2000 + (i - 1) // 2) for i in range(1, 64)] + [(2000, 5), (2040, 1007)]
    chain = [(3000 + i, 3001 + i) for i in range(300)] + [(1100, 3000)]
    rows = ring + hub + tree + chain
    count = Rounds(monkeypatch)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(300)}, **{1000 + i: 1000 for i in range(300)}, 5001: 5001}
    assert count.n < 120


def test_sketches_estimate_within_their_error(spark):
    # 400 tops, each over two of 20 middles, which all stand over one node
    rows = [(100 + i, j) for i in range(400) for j in (i % 20, (i * 7 + 3) % 20)] + [(j, 99) for j in range(20)]
    df, truth = spark.createDataFrame(rows, "src long, dst long"), _affected(_depths(rows))
    assert truth[99] == 420 and max(n for x, n in truth.items() if x != 99) < 63
    exact = {r.node: (r.affected, r.exact) for r in graph.reach_counts(df).collect()}
    assert exact == {n: (c, True) for n, c in truth.items()}
    some = {r.node: (r.affected, r.exact) for r in graph.reach_counts(df, 64).collect()}
    assert some.pop(99)[1] is False and some == {n: (c, True) for n, c in truth.items() if n != 99}
    estimates = [{r.node: r.affected for r in graph.reach_counts(df, k).collect()}[99] for k in (64, 200)]
    assert all(abs(n - 420) < 3 / (k - 2) ** 0.5 * 420 for n, k in zip(estimates, (64, 200)))


def _longest(edges):
    """Longest chains by the definition: a component of n counts n - 1, then the best way on."""
    depths = _depths(edges)
    part = {x: min([x, *(b for (a, b) in depths if a == x and (b, a) in depths)]) for e in edges for x in e}
    size = {p: sum(q == p for q in part.values()) for p in part.values()}
    after = {p: {part[b] for a, b in edges if part[a] == p and part[b] != p} for p in size}

    def deep(p):
        return size[p] - 1 + max((1 + deep(q) for q in after[p]), default=0)

    return {x: deep(p) for x, p in part.items()}


EDGES = {
    "chain": ["ab", "bc", "cd"],
    "two ways": ["es", "el", "lm", "mn"],
    "diamond": ["el", "er", "ls", "rs", "sx"],
    "loop of two": ["ab", "ba", "bt", "tu"],
    "loop of three": ["ab", "bc", "ca"],
    "apart": ["ab", "bc", "xy"],
}


@pytest.mark.parametrize("name", EDGES)
def test_depths(spark, name):
    rows = [tuple(e) for e in EDGES[name]]
    got = {r.node: r.depth for r in graph.depths(spark.createDataFrame(rows, "src string, dst string")).collect()}
    assert got == _longest(rows) and max(got.values()) == {"chain": 3, "two ways": 3, "diamond": 3, "loop of two": 3, "loop of three": 2, "apart": 2}[name]


def test_reach_and_loops(spark):
    rows = [tuple(e) for e in ("ab", "bc", "ca", "cd", "de", "xy", "yx")]
    df = spark.createDataFrame(rows, "src string, dst string")
    got = {(r.start, r.node): r.distance for r in graph.reach(df, spark.createDataFrame([("a",), ("x",)], "start string"), 3).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3, ("x", "y"): 1}
    assert {r.node for r in graph.dependents(df, spark.createDataFrame([("d",)], "start string")).collect()} == {"a", "b", "c"}
    assert sorted(r.files for r in graph.loops(df).collect()) == [["a", "b", "c"], ["x", "y"]]


def test_depth_of_a_large_branching_graph(spark):
    rows = [(i, j) for i in range(2000) for j in range(i + 1, min(i + 4, 2000))]
    got = {r.node: r.depth for r in graph.depths(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got[0] == 1999 and got[1999] == 0


def test_a_long_chain_takes_few_rounds(spark, monkeypatch, by_joins):
    rows = [(i, i + 1) for i in range(10_000)]
    monkeypatch.setattr(graph, "components", lambda edges: edges.sparkSession.createDataFrame([], "node long, component long"))
    count = Rounds(monkeypatch)
    got = {r.node: r.depth for r in graph.depths(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == {i: 10_000 - i for i in range(10_001)}
    assert count.n <= 2 * 15 + 5  # a table of depths and one of pairs for each


@pytest.mark.parametrize("bound", [40])
def test_depths_when_pairs_are_bounded(spark, monkeypatch, by_joins, bound):
    monkeypatch.setattr(graph, "AHEAD", 0), monkeypatch.setattr(graph, "LEAST_AHEAD", bound)
    rows = [(i, j) for i in range(12) for j in range(i + 1, min(i + 3, 12))] + [(3, 2)]
    assert {r.node: r.depth for r in graph.depths(spark.createDataFrame(rows, "src long, dst long")).collect()} == _longest(rows)


def test_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert graph.components(none).count() == graph.reach_counts(none).count() == 0


@pytest.fixture(scope="module")
def edges():
    return duckdb.sql(catalogue._EDGES.replace("FROM lineitem", f"FROM '{SF}/lineitem.parquet'")).fetchall()


def test_closure_queries_use_all_edges(spark, edges):
    depths = _depths(edges)
    run = lambda name: [tuple(r) for r in catalogue.QUERIES[name](spark, SF).collect()]
    assert dict(run("scc_members")) == _components(depths)
    assert dict(run("reverse_reachable")) == _affected(depths)
    levels = {}
    for (_, b), k in depths.items():
        key = b, "high" if k == 1 else "medium" if k <= 3 else "low"
        levels[key] = levels.get(key, 0) + 1
    assert {(c, level): n for c, level, n in run("impact_levels")} == levels
    sizes = {}
    for c in _components(depths).values():
        sizes[c] = sizes.get(c, 0) + 1
    assert {c: n for c, n, _ in run("cycle_findings")} == sizes


@pytest.mark.parametrize("name", ["in_out_degree", "layer_relations", "cross_feature_imports", "forbidden_dependencies", "central_modules"])
def test_plain_queries_equal_their_sql_on_all_edges(spark, name):
    rel = duckdb.sql(catalogue.SQL[name].replace("FROM lineitem", f"FROM '{SF}/lineitem.parquet'"))
    df = catalogue.QUERIES[name](spark, SF).select(*rel.columns)
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


def test_rules_can_fire(spark, edges):
    found = {tuple(r) for r in catalogue.QUERIES["forbidden_dependencies"](spark, SF).select("src", "dst").collect()}
    assert found == {(a, b) for a, b in edges if (a % 4, b % 4) in {(0, 2), (1, 3), (3, 0)}} and any((a % 4, b % 4) == (3, 0) for a, b in found)


def test_near_counts_are_those_of_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "NEAR", 64)
    monkeypatch.setattr(graph, "STRIDE", 8)
    # loops of two and three, a hub, numbers below zero and far apart
    pairs = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 2), (-5, 1), (900, -5), (4, 900), (7, 7), (5000, 4), *((100 + i, 3) for i in range(90)), *((3, 300 + i) for i in range(90))]
    e = spark.createDataFrame(pairs, "src long, dst long")
    want = {}
    for r in graph.closure(e, 3).collect():
        one, near = want.get(r.dst, (0, 0))
        want[r.dst] = one + (r.depth == 1), near + 1
    closure = graph.closure
    monkeypatch.setattr(graph, "closure", None)  # no pairs
    assert {r.node: (r.one, r.near) for r in graph.near_counts(e, 3).collect()} == want
    monkeypatch.setattr(graph, "closure", closure)
    monkeypatch.setattr(graph, "NEAR_EDGES", 100)  # some groups by pairs
    assert {r.node: (r.one, r.near) for r in graph.near_counts(e, 3).collect()} == want


def test_near_counts_in_wide_groups_and_turns(spark, monkeypatch):
    pairs = [(i, (i * 7 + j) % 500) for i in range(-40, 1200) for j in (1, 3, 90) if i != (i * 7 + j) % 500]
    e = spark.createDataFrame(pairs, "src long, dst long")
    want = {}
    for r in graph.closure(e, 3).collect():
        one, near = want.get(r.dst, (0, 0))
        want[r.dst] = one + (r.depth == 1), near + 1
    dealt = []
    near_groups = graph._near_groups
    monkeypatch.setattr(graph, "_near_groups", lambda edges, starts, width, most: dealt.append(width) or near_groups(edges, starts, width, most))
    monkeypatch.setattr(graph, "NEAR", 64), monkeypatch.setattr(graph, "STRIDE", 32)
    monkeypatch.setattr(graph, "NEAR_DEALT", 2 * len(pairs))  # two groups at a time
    assert {r.node: (r.one, r.near) for r in graph.near_counts(e, 3).collect()} == want
    assert dealt == [128] * 6  # two times 64 starts in a group


def test_reach_counts_beyond_the_sketch_are_exact(spark, monkeypatch):
    monkeypatch.setattr(graph, "SKETCH", 8), monkeypatch.setattr(graph, "REACH_ROWS", 300)
    # layers that all lead on, a loop of three above and one below: larger parts count with their sizes
    rng = random.Random(5)
    rows = [(100 * a + i, 100 * a + 100 + rng.randrange(30)) for a in range(1, 6) for i in range(30) for _ in range(2)]
    rows += [(1, 2), (2, 3), (3, 1), (3, 105), (600, 601), (601, 600)]
    truth = _affected(_depths(rows))
    assert sum(n > 8 for n in truth.values()) > 50
    got = {r.node: (r.affected, r.exact) for r in graph.reach_counts(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == {n: (c, True) for n, c in truth.items()}


def test_reach_counts_of_many_parts_are_no_estimates(spark):
    e = spark.createDataFrame([(i, 5000 + i % 2) for i in range(1300)] + [(5000, 6000), (5001, 6000)], "src long, dst long")
    assert {r.node: (r.affected, r.exact) for r in graph.reach_counts(e).collect()} == {5000: (650, True), 5001: (650, True), 6000: (1302, True)}
