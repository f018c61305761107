"""The sample project's rows are dealt out before they are parsed, and what follows from them is worked out once."""

import pytest

from quern.operators import graph
from quern.plans import analysis as A
from quern.sources import sample

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("part", [sample.domain, sample.services, sample.components])
def test_a_table_of_one_file_is_parsed_by_many_tasks(spark, part):
    assert part(spark, D).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_depths_and_loops_share_the_components(spark, monkeypatch):
    rows = [("a.ts", "import { b } from './b';\n"), ("b.ts", "import { a } from './a';\nimport type { c } from './c';\n"), ("c.ts", "import { b } from './b';\n")]
    a, asked, real = A.from_texts(spark, spark.createDataFrame(rows, "path string, text string")), [], graph.components
    monkeypatch.setattr(graph, "components", lambda edges: asked.append(edges.count()) or real(edges))
    assert {r.node: r.depth for r in a.depths.collect()} == {"a.ts": 2, "b.ts": 2, "c.ts": 2}
    assert [r.files for r in a.cycles.collect()] == [["a.ts", "b.ts"]]
    assert asked[0] == 4 and max(asked[1:], default=0) <= 3  # all edges once, then those inside components that are no types


def _tables(spark):
    import os

    return {x for x in os.listdir(graph.scratch(spark).removeprefix("file:")) if x.startswith("graph-")}


def test_graph_operators_leave_no_table_but_their_result(spark, monkeypatch):
    monkeypatch.setattr(graph, "LOCAL_EDGES", 0)
    edges = graph.cut(spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("e", "a")], "src string, dst string"))
    before = _tables(spark)
    parts = graph.components(edges)
    assert {tuple(r) for r in parts.collect()} == {("a", "a"), ("b", "a")}
    assert len(_tables(spark) - before) == 1
    deep = graph.depths(edges, parts)
    assert {r.node: r.depth for r in deep.collect()} == {"a": 3, "b": 3, "c": 1, "d": 0, "e": 4}
    assert len(_tables(spark) - before) <= 3


def test_slices_resolve_as_the_whole_does(spark, monkeypatch):
    from quern.operators import resolve

    files = A.from_texts(spark, sample.texts(spark, D).where("crc32(path) % 4 = 0"), sample.INFO).files
    tables = lambda g: [sorted(map(tuple, g.whole(x, graph.cut).collect())) for x in ("edges", "external", "unresolved", "resolved")]
    whole = resolve.build_graph(files, sample.INFO, graph.cut)
    monkeypatch.setattr(resolve, "SLICE", 400)
    parted = resolve.build_graph(files, sample.INFO, graph.cut)
    assert not whole.slices and len(parted.slices) > 2
    assert tables(whole) == tables(parted) and all(tables(whole))


def test_parts_of_the_project_are_parsed_apart_and_kept_without_texts(spark, monkeypatch):
    whole = {tuple(r) for r in sample.texts(spark, D).collect()}
    monkeypatch.setattr(sample, "PART_ROWS", 2_500)
    parts = [[tuple(r) for r in p.collect()] for p in sample.parts(spark, D)]
    assert len(parts) == 3 and all(parts) and sum(map(len, parts)) == len(whole) and {r for p in parts for r in p} == whole
    some = [p.where("crc32(path) % 4 = 0") for p in sample.parts(spark, D)]
    a, b = A.from_texts(spark, some, sample.INFO), A.from_texts(spark, sample.texts(spark, D).where("crc32(path) % 4 = 0"), sample.INFO)
    assert not set(A.NOT_KEPT) & set(a.files.columns) and sorted(map(str, a.files.collect())) == sorted(map(str, b.files.drop(*A.NOT_KEPT).collect()))
    for tests in (False, True):
        own = [sorted(tuple(r) for t in x.texts(tests) for r in t.collect()) for x in (a, b)]
        assert own[0] == own[1] and own[0]


def test_tables_of_the_graph_leave_nothing_else(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quern.operators import resolve

    a = A.from_texts(spark, sample.texts(spark, D).where("crc32(path) % 4 = 0"), sample.INFO)
    whole = resolve.build_graph(a.files, sample.INFO)
    monkeypatch.setattr(resolve, "SLICE", 1000)
    rows = lambda df: sorted(map(tuple, df.collect()))
    before, parts = _tables(spark), resolve._parts(a.files)
    assert parts > 1 and rows(a.edges) == rows(whole.edges) and rows(a.unresolved) == rows(whole.unresolved)
    assert len(_tables(spark) - before) == 2 * parts
    assert rows(a.external) == rows(whole.external) and a.external.count() > 0
    assert len(_tables(spark) - before) == 3 * parts
    own = a.files.where("path like '%7.ts'")
    assert rows(a.imported("resolved", own=own)[0]) == rows(whole.resolved.join(own.select("path"), "path", "left_semi"))
    assert rows(a.imported("external", where=F.col("package") == "stripe")[0]) == rows(whole.external.where("package = 'stripe'"))


def test_modules_only_passed_on_are_asked_of_files_that_pass_names_on(spark):
    from quern.plans import reports_project as Q

    texts = {
        "src/a.ts": "export const a = 1;\n", "src/b.ts": "export const b = 1;\n", "src/c.ts": "export const c = 1;\n", "src/d.ts": "export const d = 1;\n",
        "src/pass.ts": "export { a } from './a';\nexport { b } from './b';\nexport { c } from './c';\nimport { d } from './d';\n",
        "src/also.ts": "import { a } from './a';\n", "src/user.ts": "import { b } from './pass';\n",
    }
    made = lambda t: A.from_texts(spark, spark.createDataFrame(list(t.items()), "path string, text string"))
    assert [tuple(r) for r in Q.only_reexported(made(texts)).collect()] == [("src/c.ts", "src/pass.ts")]
    # where none passes names on, no import is joined to its target
    plain = Q.only_reexported(made({p: t for p, t in texts.items() if p != "src/pass.ts"}))
    assert plain.count() == 0 and "Join" not in plain._jdf.queryExecution().toString()


def test_written_edges_are_read_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(graph, "LOCAL_EDGES", 0)
    edges = graph.cut(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"))
    starts, made = spark.createDataFrame([("c",)], "start string"), []
    for written in (False, True):
        before = _tables(spark)
        assert {tuple(r) for r in graph.dependents(edges, starts, written=written).collect()} == {("c", "b", 1), ("c", "a", 2)}
        made.append(len(_tables(spark) - before))
    assert graph.kept(edges) and made[1] <= made[0]
