"""More named queries: paths, globs, counts, histories, suggestions and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import globs, paths
from quern.functions.text import round_half_up
from quern.plans.catalogue import _EDGES, _FILES, _LINES, _NORMAL, _STRUCTURAL, query
from quern.plans.findings import is_structural, normalized_line
from quern.plans.reports_project import age_text, days_since
from quern.sources import tables as T

_NOW = "1998-12-01"


def _count_all():
    return F.count(F.lit(1))


def _count_if(condition):
    return F.count(F.when(condition, 1))


@query(rf"SELECT path, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_extract(path, '([^/]*)$', 1) AS base, regexp_extract(path, '[^/](\.[^./]*)$', 1) AS ext, split_part(path, '/', 1) AS top, len(list_filter(string_split(path, '/'), lambda s: s <> '')) AS depth FROM ({_FILES})")
def path_functions(spark, d):
    return T.files(spark, d).select("path", paths.directory("path").alias("dir"), paths.base_name("path").alias("base"), paths.extension("path").alias("ext"), F.substring_index("path", "/", 1).alias("top"), F.size(paths.segments("path")).cast("long").alias("depth"))


@query(f"SELECT path, substr(sha1(text), 1, 16) AS hash FROM ({_FILES})")
def content_hashes(spark, d):
    return T.files(spark, d).select("path", F.substring(F.sha1("text"), 1, 16).alias("hash"))


@query(f"SELECT path, CASE WHEN regexp_matches(path, '^src1/') THEN true WHEN regexp_matches(path, '/de/') THEN false ELSE regexp_matches(path, '^src1[^/]*/') END AS admitted FROM ({_FILES})")
def glob_last_match_wins(spark, d):
    return T.files(spark, d).select("path", globs.matches("path", ["src1*/**", "!**/{de}/**", "src1"]).alias("admitted"))


@query(r"SELECT language, count(*) FILTER (regexp_matches(text, 'https?://')) AS links, count(*) FILTER (regexp_matches(text, '[0-9]{4}-[0-9]{2}')) AS dates, count(*) FILTER (regexp_matches(text, '(secret|token|password)')) AS secrets FROM (" + _FILES + ") GROUP BY language")
def marker_counts(spark, d):
    has = lambda p: _count_if(F.col("text").rlike(p))
    return T.files(spark, d).groupBy("language").agg(has("https?://").alias("links"), has("[0-9]{4}-[0-9]{2}").alias("dates"), has("(secret|token|password)").alias("secrets"))


@query(f"SELECT area, count(*) AS n, count(*) FILTER ({_STRUCTURAL}) AS structural, count(DISTINCT line) AS different FROM (SELECT split_part(path, '/', 1) AS area, {_NORMAL} AS line FROM ({_LINES})) GROUP BY area")
def structural_lines(spark, d):
    rows = T.lines(spark, d).select(F.substring_index("path", "/", 1).alias("area"), normalized_line(F.col("line")).alias("line"))
    each = rows.groupBy("area", "line").agg(_count_all().alias("n"))  # equal lines meet first, so a hot area is small
    return each.groupBy("area").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(is_structural(F.col("line")), F.col("n"))), F.lit(0)).alias("structural"), _count_all().alias("different"))


@query("SELECT o_orderkey AS file, count(l_orderkey) AS functions, coalesce(max(l_quantity), 0) AS complexity FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def file_metrics(spark, d):
    # aggregated before the join, so that only one row per file is dealt out
    own = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(_count_all().alias("functions"), F.max("l_quantity").alias("complexity"))
    files = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("file")).distinct()
    return files.join(own, "file", "left").select("file", F.coalesce("functions", F.lit(0)).alias("functions"), F.coalesce("complexity", F.lit(0)).alias("complexity"))


@query("SELECT count(*) AS functions, count(*) FILTER (l_quantity > 40) AS complex, count(*) FILTER (l_returnflag = 'R') AS returned, max(l_quantity) AS worst, coalesce(count(*) FILTER (l_quantity > 40) / nullif(count(*), 0), 0) AS share FROM lineitem")
def stats_counts(spark, d):
    hard = _count_if(F.col("l_quantity") > 40)
    share = F.coalesce(F.try_divide(hard, _count_all()), F.lit(0.0))
    return T.table(spark, d, "lineitem").agg(_count_all().alias("functions"), hard.alias("complex"), _count_if(F.col("l_returnflag") == "R").alias("returned"), F.max("l_quantity").alias("worst"), share.alias("share"))


@query(f"SELECT dst AS module, count(*) AS dependents FROM ({_EDGES}) GROUP BY dst ORDER BY dependents DESC, module LIMIT 10")
def central_modules(spark, d):
    return T.edges(spark, d).groupBy(F.col("dst").alias("module")).agg(_count_all().alias("dependents")).orderBy(F.desc("dependents"), "module").limit(10)


@query("SELECT o_custkey AS author, count(*) AS commits, min(o_orderdate) AS first_commit, max(o_orderdate) AS last_commit FROM orders GROUP BY o_custkey")
def author_counts(spark, d):
    return T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("author")).agg(_count_all().alias("commits"), F.min("o_orderdate").alias("first_commit"), F.max("o_orderdate").alias("last_commit"))


@query("SELECT l_linestatus AS category, count(*) FILTER (l_quantity > 45) AS critical, count(*) FILTER (l_quantity > 25 AND l_quantity <= 45) AS warning, count(*) FILTER (l_quantity <= 25) AS info FROM lineitem GROUP BY l_linestatus")
def severity_counts(spark, d):
    q = F.col("l_quantity")
    return T.table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("category")).agg(_count_if(q > 45).alias("critical"), _count_if((q > 25) & (q <= 45)).alias("warning"), _count_if(q <= 25).alias("info"))


@query("WITH f AS (SELECT l_partkey AS name, string_agg(DISTINCT l_returnflag || l_linestatus || l_linenumber % 3, '|' ORDER BY l_returnflag || l_linestatus || l_linenumber % 3) AS files FROM lineitem GROUP BY l_partkey) SELECT files, count(*) AS names, min(name) AS first_name FROM f GROUP BY files HAVING count(*) > 1")
def shared_name_groups(spark, d):
    held = T.table(spark, d, "lineitem").select(F.col("l_partkey").alias("name"), F.concat("l_returnflag", "l_linestatus", (F.col("l_linenumber") % 3).cast("string")).alias("file"))
    sets = held.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("file")), "|").alias("files"))
    return sets.groupBy("files").agg(_count_all().alias("names"), F.min("name").alias("first_name")).where("names > 1")


@query("SELECT l_partkey AS module, count(DISTINCT l_suppkey) AS names, count(DISTINCT l_suppkey) FILTER (l_orderkey % 7 = 0) AS in_tests, bool_or(l_returnflag = 'R') AS wildcard FROM lineitem GROUP BY l_partkey")
def name_usage(spark, d):
    # one row per module and name first, so that a hot module's rows meet already combined
    each = T.table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.bool_or(F.col("l_orderkey") % 7 == 0).alias("test"), F.bool_or(F.col("l_returnflag") == "R").alias("wild"))
    return each.groupBy(F.col("l_partkey").alias("module")).agg(_count_all().alias("names"), _count_if(F.col("test")).alias("in_tests"), F.bool_or("wild").alias("wildcard"))


@query("SELECT l_returnflag AS metric, count(*) FILTER (l_shipdate < TIMESTAMP '1995-06-17') AS before_n, count(*) FILTER (l_shipdate >= TIMESTAMP '1995-06-17') AS after_n, count(*) FILTER (l_shipdate >= TIMESTAMP '1995-06-17') - count(*) FILTER (l_shipdate < TIMESTAMP '1995-06-17') AS delta FROM lineitem GROUP BY l_returnflag HAVING delta <> 0")
def metric_drift(spark, d):
    old = F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp_ntz")
    counts = T.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("metric")).agg(_count_if(old).alias("before_n"), _count_if(~old).alias("after_n"))
    return counts.withColumn("delta", F.col("after_n") - F.col("before_n")).where("delta <> 0")


_MINUTES = f"floor(date_diff('second', o_orderdate, TIMESTAMP '{_NOW}') / 60.0 + 0.5)"


@query(f"""SELECT o_orderkey AS id, greatest(0, floor(date_diff('second', o_orderdate, TIMESTAMP '{_NOW}') / 86400.0 + 0.5))::BIGINT AS days,
CASE WHEN m IS NULL THEN 'earlier' WHEN m < 2 THEN 'just now' WHEN m < 60 THEN m::BIGINT || ' minutes ago' WHEN floor(m / 60 + 0.5) < 24 THEN floor(m / 60 + 0.5)::BIGINT || CASE WHEN floor(m / 60 + 0.5) = 1 THEN ' hour ago' ELSE ' hours ago' END
ELSE floor(floor(m / 60 + 0.5) / 24 + 0.5)::BIGINT || CASE WHEN floor(floor(m / 60 + 0.5) / 24 + 0.5) = 1 THEN ' day ago' ELSE ' days ago' END END AS age FROM (SELECT *, {_MINUTES} AS m FROM orders)""")
def commit_ages(spark, d):
    date, now = F.col("o_orderdate").cast("string"), F.lit(_NOW).cast("timestamp")
    return T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), days_since(date, now).alias("days"), age_text(date, now).alias("age"))


@query("SELECT typed, min_by(r_name, (distance, r_regionkey)) AS suggestion FROM (SELECT typed, r_name, r_regionkey, levenshtein(lower(typed), lower(r_name)) AS distance FROM (SELECT DISTINCT lower(substr(r_name, 1, length(r_name) - 1)) AS typed FROM region UNION SELECT n_name FROM nation), region) GROUP BY typed HAVING min(distance) <= greatest(1, greatest(length(typed), length(min_by(r_name, (distance, r_regionkey)))) // 4)")
def did_you_mean(spark, d):
    # both sides are fixed vocabularies of names, a few dozen rows at any scale
    region = T.table(spark, d, "region")
    typed = region.select(F.lower(F.expr("substr(r_name, 1, length(r_name) - 1)")).alias("typed")).union(T.table(spark, d, "nation").select("n_name")).distinct()
    pairs = typed.join(region, how="cross").withColumn("distance", F.levenshtein(F.lower("typed"), F.lower("r_name")))
    best = pairs.groupBy("typed").agg(F.min("distance").alias("distance"), F.min_by("r_name", F.struct("distance", "r_regionkey")).alias("suggestion"))
    budget = F.greatest(F.lit(1), F.floor(F.greatest(F.length("typed"), F.length("suggestion")) / 4))
    return best.where(F.col("distance") <= budget).select("typed", "suggestion")


@query("SELECT o_orderkey AS change, count(*) AS files, count(DISTINCT l_suppkey) AS areas, CASE WHEN sum(l_quantity) > 150 THEN 'large' WHEN sum(l_quantity) > 50 THEN 'medium' ELSE 'small' END AS magnitude FROM (SELECT DISTINCT o_orderkey FROM orders) JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def change_size(spark, d):
    size = F.sum("l_quantity")
    per = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("change")).agg(_count_all().alias("files"), F.countDistinct("l_suppkey").alias("areas"), F.when(size > 150, "large").when(size > 50, "medium").otherwise("small").alias("magnitude"))
    return per.join(T.table(spark, d, "orders").select(F.col("o_orderkey").alias("change")), "change", "left_semi")


@query("SELECT p_brand AS area, count(*) AS n, sum(p_size)::BIGINT AS lines, floor(100.0 * count(*) FILTER (p_size <= 10) / count(*) + 0.5)::BIGINT AS singles FROM part GROUP BY p_brand HAVING count(*) >= 5 AND sum(p_size) > 100")
def abstraction_share(spark, d):
    small = round_half_up(100 * _count_if(F.col("p_size") <= 10) / _count_all())
    return T.table(spark, d, "part").groupBy(F.col("p_brand").alias("area")).agg(_count_all().alias("n"), F.sum("p_size").cast("long").alias("lines"), small.alias("singles")).where("n >= 5 and lines > 100")
