"""A project of source files written from the tables, so that analyses can be held against plain SQL at any size.

customer -> src/components/c<key>.tsx, importing its orders (and, from some
nations, a part); every tenth runs in the browser and imports supplier <key>.
orders -> src/services/o<key>.ts, importing the parts of its lines and a
package for each supplier.  part (up to size 45) -> src/domain/p<key>.ts,
importing part key/2, with one export that nobody takes.  supplier ->
src/db/s<key>.ts, importing customer <key> and reading a secret; every fifth
repeats a block.  Every fiftieth order has a test.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.project import ProjectInfo
from quern.sources.tables import table

#: Parts above this size have no file: imports of them can't be resolved.
LARGEST = 45
INFO = ProjectInfo(name="sample", languages=("typescript",), has_typescript=True, source_roots=("src",))


def _said(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def package(supplier: Column) -> Column:
    """The package that a supplier's goods come from: two that belong to a service, else one of its own."""
    return F.when(supplier % 10 == 0, "stripe").when(supplier % 10 == 1, "@supabase/js").otherwise(_said("pkg-", supplier))


#: Lines that every fifth supplier's file repeats.
BLOCK = "".join(f"register(table{i}, column{i});\n" for i in range(7))


def _ordered(rows: Column, said: Callable[[Column], Column]) -> Column:
    """What is said of each of sorted rows, a line each with its line feed; the rows are keys, so only these are dealt out."""
    return F.array_join(F.transform(rows, lambda r: F.concat(said(r), F.lit("\n"))), "")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a key, before texts are written of them: a table of one file would be parsed by one task, and a plan that adapts to small keys would make it one again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


#: Lines of orders whose texts are written at a time.
PART_ROWS = 8_000_000


def _own(spark: SparkSession, d: str, name: str, key: str, part: tuple[int, int]) -> DataFrame:
    """The rows of a table that belong to a part (which, of how many) of the project."""
    rows, (i, n) = table(spark, d, name), part
    return rows if n == 1 else rows.where(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(n)) == i)


def components(spark: SparkSession, d: str, part: tuple[int, int] = (0, 1)) -> DataFrame:
    orders = _dealt(_own(spark, d, "orders", "o_custkey", part).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey").groupBy("c_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("o"))
    c, k = _dealt(_own(spark, d, "customer", "c_custkey", part).select("c_custkey", "c_nationkey"), "c_custkey").join(orders, "c_custkey", "left"), F.col("c_custkey")
    imports = _ordered("o", lambda o: _said("import { order", o, " } from '../services/o", o, "';"))
    direct = F.when(F.col("c_nationkey") % 5 == 0, _said("import { part", k, " } from '../domain/p", k, "';\n")).otherwise("")
    client = k % 10 == 0
    head = F.when(client, "'use client';\n").otherwise("")
    store = F.when(client, _said("import { s", k, " } from '../db/s", k, "';\n")).otherwise("")
    text = F.concat(head, F.coalesce(imports, F.lit("")), direct, store, _said("export const C", k, " = () => <b>it's {name}</b>;\n"))
    return c.select(_said("src/components/c", k, ".tsx").alias("path"), text.alias("text"))


def services(spark: SparkSession, d: str, part: tuple[int, int] = (0, 1)) -> DataFrame:
    # equal lines differ at most in kind and step: "import type" comes before "import", a step with && before one without
    lines = _own(spark, d, "lineitem", "l_orderkey", part).select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.struct(
            F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("e"),
            F.when(F.col("l_returnflag") == "R", False).otherwise(True).alias("value"),
            F.when(F.col("l_linestatus") == "O", False).otherwise(True).alias("plain"),
        ).alias("l"),
    )
    per = _dealt(lines, "o_orderkey").groupBy("o_orderkey").agg(F.array_sort(F.collect_list("l")).alias("l"))
    o, k = _dealt(_own(spark, d, "orders", "o_orderkey", part).select("o_orderkey"), "o_orderkey").join(per, "o_orderkey", "left"), F.col("o_orderkey")
    rows = F.coalesce("l", F.array().cast(per.schema["l"].dataType))
    own = _ordered(rows, lambda r: _said(F.when(r["value"], "import").otherwise("import type"), " { part", r["p"], " } from '../domain/p", r["p"], "';"))
    other = _ordered(rows, lambda r: _said("import pkg", r["s"], " from '", package(r["s"]), "/x';"))
    step = _ordered(rows, lambda r: F.when(r["plain"], _said("  if (a > ", r["n"], ") { go(", r["n"], "); }")).otherwise(_said("  if (a > ", r["n"], " && b) { const v", r["n"], ": any = pkg", r["s"], "; }")))
    text = F.concat(own, other, _said("export function order", k, "(a: number, b: string) {\n"), step, F.lit("}\n"))
    return o.select(_said("src/services/o", k, ".ts").alias("path"), text.alias("text"))


def domain(spark: SparkSession, d: str, part: tuple[int, int] = (0, 1)) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    parent = F.floor(k / 2).cast("long")
    up = F.when(k >= 2, _said("import { part", parent, " } from './p", parent, "';\n")).otherwise("")
    params = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.when(i < size % 8, F.concat(F.lit("a"), i.cast("string")))), ", ")
    depth = (size % 6).cast("int")
    body = F.concat(F.repeat(F.lit("if (x) {\n"), depth), F.lit("go();\n"), F.repeat(F.lit("}\n"), depth))
    text = F.concat(up, _said("export function part", k, "(", params, ") {\n"), body, _said("}\nexport const spare", k, " = 1;\n"))
    return _dealt(_own(spark, d, "part", "p_partkey", part).where(size <= LARGEST).select("p_partkey", "p_size"), "p_partkey").select(_said("src/domain/p", k, ".ts").alias("path"), text.alias("text"))


def storage(spark: SparkSession, d: str, part: tuple[int, int] = (0, 1)) -> DataFrame:
    k = F.col("s_suppkey")
    text = _said("import { C", k, " } from '../components/c", k, "';\nexport const s", k, " = process.env.S", k, "_TOKEN;\n")
    text = F.concat(text, F.when(k % 5 == 0, BLOCK).otherwise(""))
    return _own(spark, d, "supplier", "s_suppkey", part).select(_said("src/db/s", k, ".ts").alias("path"), text.alias("text"))


def tests(spark: SparkSession, d: str, part: tuple[int, int] = (0, 1)) -> DataFrame:
    k = F.col("o_orderkey")
    text = _said("import { order", k, " } from '../src/services/o", k, "';\ntest('order', () => order", k, "(1, ''));\n")
    return _own(spark, d, "orders", "o_orderkey", part).where(k % 50 == 0).select(_said("tests/o", k, ".test.ts").alias("path"), text.alias("text"))


def texts(spark: SparkSession, d: str, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """(path, text) of all files, or of those of a part."""
    out = components(spark, d, part)
    for more in (services, domain, storage, tests):
        out = out.unionByName(more(spark, d, part))
    return out


def parts(spark: SparkSession, d: str) -> list[DataFrame]:
    """``texts`` dealt out by their keys, so that what is shuffled at a time doesn't grow with the tables."""
    n = -(-table(spark, d, "lineitem").count() // PART_ROWS) or 1
    return [texts(spark, d, (i, n)) for i in range(n)]


#: The second project: Python, Go and TypeScript with what the rules on languages, types and patterns look for.
MIXED = ProjectInfo(name="mixed", languages=("typescript", "python", "go"), has_typescript=True, source_roots=("src",))


def mixed_texts(spark: SparkSession, d: str) -> DataFrame:
    """(path, text): supplier -> py/s<key>.py, part -> go/b<key % 10>/p<key>.go, customer -> src/lib/h<key>.ts, every fiftieth as .js.

    Suppliers: every third has a mutable default, every fourth sets a global,
    every fifth catches all.  Every fourth part drops an error.  Customers:
    three by three they define a function of one name; every sixth ignores the
    compiler, every seventh asserts unchecked, every ninth has an effect
    without a list of dependencies.
    """
    s, p, c = F.col("s_suppkey"), F.col("p_partkey"), F.col("c_custkey")
    either = lambda where, a, b="": F.when(where, a).otherwise(b)
    python = F.concat(F.lit("TOTAL = 0\n\n\ndef load"), s.cast("string"), either(s % 3 == 0, "(a, cache=[]):\n", "(a, cache=None):\n"), either(s % 4 == 0, "    global TOTAL\n    TOTAL = a\n"), F.lit("    try:\n        go(a)\n"), either(s % 5 == 0, "    except:\n", "    except ValueError:\n"), F.lit("        pass\n"))
    go = F.concat(F.lit("package b\n\nfunc Part"), p.cast("string"), F.lit("() int {\n"), either(p % 4 == 0, "\tv, _ := load()\n", "\tv := load()\n"), F.lit("\treturn v\n}\n"))
    script = F.concat(F.lit("export function tax"), F.floor(c / 3).cast("string"), F.lit("(x: number) {\n  if (x > "), c.cast("string"), F.lit(") { return 2; }\n  return 1;\n}\n"), either(c % 6 == 0, _said("// @ts-ignore\ngo(", c, ");\n")), either(c % 7 == 0, _said("const v", c, " = raw as unknown as Thing;\n")), either(c % 9 == 0, "useEffect(() => { go(); });\n"))
    out = table(spark, d, "supplier").select(_said("py/s", s, ".py").alias("path"), python.alias("text"))
    out = out.unionByName(table(spark, d, "part").select(_said("go/b", p % 10, "/p", p, ".go").alias("path"), go.alias("text")))
    return out.unionByName(table(spark, d, "customer").select(F.concat(_said("src/lib/h", c), either(c % 50 == 0, ".js", ".ts")).alias("path"), script.alias("text")))
