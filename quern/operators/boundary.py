"""From client modules to what must stay on a server: the shortest chain of imports to each such module.

A round extends all clients' frontiers at once by one join.  A row is of fixed
size: client, module, the module it was met from and its place in the order in
which a walk from the client meets modules; of chains of the least length the
first in that order wins.  Clients walk along imports that lead to such a
module alone, found backwards first; only those that find one behind other
modules walk along all, since what they meet on the way counts against
``MAX_VISITS``.  Chains are put together afterwards, for the modules
that were sought alone, by following the rows back.  Modules that must stay on
a server end the walk, as do ``MAX_DEPTH`` steps and ``MAX_VISITS`` modules
met from a client.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.graph import cut

# Names that are public or harmless, what makes a name look secret, bounds of a walk.
PUBLIC = ("NEXT_PUBLIC_", "PUBLIC_", "VITE_", "REACT_APP_", "NUXT_PUBLIC_", "EXPO_PUBLIC_", "GATSBY_", "STORYBOOK_", "VUE_APP_")
HARMLESS = ("NODE_ENV", "VERCEL_ENV", "VERCEL_URL", "CI", "PORT", "TZ", "npm_package_version")
SECRET = "(?i)(SECRET|_KEY|^KEY_|APIKEY|API_KEY|TOKEN|PASSWORD|PASSWD|CREDENTIAL|PRIVATE|SERVICE_ROLE|ACCESS_ID|CLIENT_SECRET|WEBHOOK|SIGNING|SALT|CERT|_PEM|_DSN|DATABASE_URL|DB_URL|CONNECTION_STRING|AUTH)"
MAX_DEPTH, MAX_VISITS = 10, 2000


def is_secret_name(name: Column) -> Column:
    """Whether reading this variable in a browser would give something away; a public prefix wins."""
    return ~name.rlike("^(" + "|".join(PUBLIC) + ")") & ~name.isin(*HARMLESS) & name.rlike(SECRET)


def reasons(files: DataFrame) -> DataFrame:
    """(path, secrets, packages, line) of modules that must stay on a server."""
    secrets = F.filter(F.coalesce("env_reads", F.array().cast("array<struct<name:string,line:int>>")), lambda r: is_secret_name(r["name"]))
    packages = F.coalesce("server_only", F.array().cast("array<string>"))
    rows = files.select("path", F.transform(secrets, lambda r: r["name"]).alias("secrets"), packages.alias("packages"), F.get(secrets, F.lit(0))["line"].alias("line"))
    return rows.where("size(secrets) > 0 or size(packages) > 0")


def runtime_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Imports as a bundler sees them: without types, and without modules whose calls go over the network."""
    actions = cut(files.where("use_server").select(F.col("path").alias("dst")))  # few, and known to be so
    return edges.where("not type_only").join(actions, "dst", "left_anti").select("src", "dst", "line")


def walks(starts: DataFrame, steps: DataFrame, ends: DataFrame, most: int = MAX_DEPTH) -> DataFrame:
    """(client, node, parent, rank, depth) of all modules that walks from ``starts`` (client) meet by ``steps`` (src, dst, line); they stop at ``ends`` (node)."""
    known = fresh = cut(starts.select("client", F.col("client").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("rank"), F.lit(0).alias("depth")))
    depth = 0
    while depth < most and not fresh.isEmpty():
        depth += 1
        few = known.groupBy("client").agg(F.count(F.lit(1)).alias("visits")).where(F.col("visits") < MAX_VISITS)
        live = fresh.join(ends.select("node"), "node", "left_anti").join(few, "client", "left_semi")
        met = live.join(steps, F.col("node") == F.col("src")).select("client", F.col("dst").alias("to"), F.struct(F.col("rank").alias("of"), "line", F.col("dst").alias("dst")).alias("order"), "node")
        met = met.join(known.select("client", F.col("node").alias("to")), ["client", "to"], "left_anti").groupBy("client", "to").agg(F.min("order").alias("order"), F.min_by("node", "order").alias("parent"))
        fresh = cut(met.select("client", F.col("to").alias("node"), "parent", F.row_number().over(Window.partitionBy("client").orderBy("order")).alias("rank"), F.lit(depth).alias("depth")))
        known = known.union(fresh)
    return known


def leading(steps: DataFrame, ends: DataFrame, most: int = MAX_DEPTH) -> DataFrame:
    """The ``steps`` (src, dst, line) on ways of ``most`` steps at most to ``ends`` (node); none leaves an end."""
    known = fresh = ends.select("node")
    kept = steps.limit(0)
    depth = 0
    while depth < most and not fresh.isEmpty():
        depth += 1
        into = cut(steps.join(fresh.select(F.col("node").alias("dst")), "dst", "left_semi").join(ends.select(F.col("node").alias("src")), "src", "left_anti").select(steps.columns))
        kept = kept.union(into)
        fresh = cut(into.select(F.col("src").alias("node")).distinct().join(known, "node", "left_anti"))
        known = known.union(fresh)
    return cut(kept)


def chains(hits: DataFrame, known: DataFrame) -> DataFrame:
    """``hits`` (client, node) with the chain from the client to the node, following ``known`` back a step a round."""
    back = known.select("client", F.col("node").alias("_at"), F.col("parent").alias("_next"))
    out = hits.withColumns({"chain": F.array("node"), "_at": F.col("node")})
    for _ in range(known.agg(F.max("depth")).first()[0] or 0):
        out = out.join(back, ["client", "_at"], "left").withColumn("chain", F.when(F.col("_next").isNull(), F.col("chain")).otherwise(F.array_prepend("chain", F.col("_next")))).drop("_at").withColumnRenamed("_next", "_at")
    return out.drop("_at")


def client_leaks(files: DataFrame, edges: DataFrame, most: int = MAX_DEPTH, written: bool = False) -> DataFrame:
    """(client, target, chain, secrets, packages, line): one row for each client and module it must not reach.  Edges between files that are ``written`` aren't copied."""
    why = cut(reasons(files).withColumnRenamed("path", "node"))
    steps = runtime_edges(edges, files)
    steps = steps if written else cut(steps.join(files.select(F.col("path").alias("dst")), "dst", "left_semi"))
    known = cut(walks(files.where("use_client and not is_test").select(F.col("path").alias("client")), leading(steps, why, most), why, most))
    # a first step is always taken; further ones end with MAX_VISITS, of which all modules met count
    deep = cut(known.where("depth > 1").join(why, "node", "left_semi").select("client").distinct())
    if not deep.isEmpty():
        known = cut(known.join(deep, "client", "left_anti").select(known.columns).union(walks(deep, steps, why, most).select(known.columns)))
    found = cut(known.select("client", "node").join(why, "node"))
    return chains(found, known).select("client", F.col("node").alias("target"), "chain", "secrets", "packages", "line")
