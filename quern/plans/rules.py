"""Rules, predicates and sinks as named queries: limits, layers, features, dependencies, severities, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import fingerprint
from quern.operators import graph
from quern.plans.catalogue import _CLOSURE, _EDGES, _FILES, _LINES, query
from quern.plans.reports_project import RATIONALE, is_rationale
from quern.sources import tables as T

#: Fixed limits of the rules on functions: rule, measure, limit.
LIMITS = [("large-function", "l_extendedprice", 90000), ("high-complexity", "l_quantity", 48), ("deep-nesting", "l_linenumber", 6)]
#: Fixed severities; a rule that is not named is off.
SEVERITIES = {"1-URGENT": "error", "2-HIGH": "warning", "3-MEDIUM": "info"}
#: Layers (node mod 4) that may not import from another layer.
FORBIDDEN = [(0, 2), (1, 3), (3, 0)]


def _count_all():
    return F.count(F.lit(1))


def _count_if(condition):
    return F.count(F.when(condition, 1))


@query("SELECT package, count(*) AS n FROM (SELECT CASE WHEN starts_with(s, '@') THEN split_part(s, '/', 1) || '/' || split_part(s, '/', 2) ELSE split_part(s, '/', 1) END AS package FROM (SELECT regexp_replace(url, '^https?://', '') AS s FROM pages)) GROUP BY package")
def package_of_specifier(spark, d):
    s = F.regexp_replace("url", "^https?://", "")
    package = F.when(s.startswith("@"), F.substring_index(s, "/", 2)).otherwise(F.substring_index(s, "/", 1))
    return T.table(spark, d, "pages").groupBy(package.alias("package")).agg(_count_all().alias("n"))


@query(f"""WITH RECURSIVE {_CLOSURE}, two AS (SELECT DISTINCT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src), three AS (SELECT DISTINCT a.src, b.dst FROM two a JOIN edges b ON a.dst = b.src)
SELECT dst AS changed, CASE WHEN (src, dst) IN (SELECT src, dst FROM edges) THEN 'high' WHEN (src, dst) IN (SELECT src, dst FROM two UNION SELECT src, dst FROM three) THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM reach GROUP BY 1, 2""")
def impact_levels(spark, d):
    # nodes are counted up to three steps; the rest of those affected is low
    e = graph.cut(T.edges(spark, d))
    near = graph.near_counts(e, 3).select("node", F.col("one").alias("high"), (F.col("near") - F.col("one")).alias("medium"))
    rows = graph.reach_counts(e).join(near, "node").withColumn("low", F.col("affected") - F.col("high") - F.col("medium"))
    level = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).alias("n")) for x in ("high", "medium", "low")]))
    return rows.select(F.col("node").alias("changed"), level.alias("x")).select("changed", "x.*").where("n > 0")


@query(f"SELECT src % 5 AS from_feature, dst % 5 AS to_feature, count(*) AS n FROM ({_EDGES}) WHERE src % 5 <> dst % 5 GROUP BY 1, 2")
def cross_feature_imports(spark, d):
    a, b = F.col("src") % 5, F.col("dst") % 5
    return T.edges(spark, d).where(a != b).groupBy(a.alias("from_feature"), b.alias("to_feature")).agg(_count_all().alias("n"))


@query(f"SELECT src, dst FROM ({_EDGES}) JOIN (VALUES {', '.join(map(str, FORBIDDEN))}) AS f(a, b) ON src % 4 = a AND dst % 4 = b")
def forbidden_dependencies(spark, d):
    # the configured pairs are a handful: a disjunction needs no join
    pair = F.concat_ws(">", F.col("src") % 4, F.col("dst") % 4)
    return T.edges(spark, d).where(pair.isin([f"{a}>{b}" for a, b in FORBIDDEN])).select("src", "dst")


@query(" UNION ALL ".join(f"SELECT l_orderkey AS file, l_linenumber::BIGINT AS ordinal, '{rule}' AS rule, {column}::DOUBLE AS measured FROM lineitem WHERE {column} > {limit}" for rule, column, limit in LIMITS))
def function_limits(spark, d):
    # one scan for all rules
    found = F.array(*[F.when(F.col(column) > limit, F.struct(F.lit(rule).alias("rule"), F.col(column).cast("double").alias("measured"))) for rule, column, limit in LIMITS])
    rows = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("ordinal"), F.explode(F.array_compact(found)).alias("f"))
    return rows.select("file", "ordinal", "f.*")


@query(f"SELECT path, count(*) FILTER (regexp_matches(line, '[0-9]')) AS markers, count(*) AS lines FROM ({_LINES}) GROUP BY path HAVING count(*) FILTER (regexp_matches(line, '[0-9]')) > greatest(2, floor(count(*) * 50 / 1000.0 + 0.5))")
def marker_density(spark, d):
    # counted inside each row, so nothing is dealt out
    lines = F.split("text", "\n")
    rows = T.files(spark, d).select("path", F.size(F.filter(lines, lambda x: x.rlike("[0-9]"))).cast("long").alias("markers"), F.size(lines).cast("long").alias("lines"))
    return rows.groupBy("path").agg(F.sum("markers").alias("markers"), F.sum("lines").alias("lines")).where(F.col("markers") > F.greatest(F.lit(2), F.floor(F.col("lines") * 50 / 1000 + 0.5)))


@query("SELECT count(*) AS files, count(*) FILTER (p_size > 25) AS layered, CASE WHEN count(*) FILTER (p_size > 25) = 0 THEN 'no layers' WHEN 100 * count(*) FILTER (p_size > 25) < 80 * count(*) THEN 'low coverage' ELSE 'ok' END AS verdict FROM part")
def unlayered_code(spark, d):
    n, layered = F.col("files"), F.col("layered")
    verdict = F.when(layered == 0, "no layers").when(100 * layered < 80 * n, "low coverage").otherwise("ok")
    return T.table(spark, d, "part").agg(_count_all().alias("files"), _count_if(F.col("p_size") > 25).alias("layered")).withColumn("verdict", verdict)


@query(f"SELECT area, language, sum(lines)::BIGINT AS lines, count(*) AS files FROM ({_FILES}) GROUP BY area, language HAVING sum(lines) > 5 * 20")
def large_packages(spark, d):
    return T.files(spark, d).groupBy("area", "language").agg(F.sum("lines").cast("long").alias("lines"), _count_all().alias("files")).where("lines > 5 * 20")


@query("SELECT user_id, floor(arg_min(value, (ts, event_id)) / 100)::BIGINT AS before_major, floor(arg_max(value, (ts, event_id)) / 100)::BIGINT AS after_major FROM events WHERE value IS NOT NULL GROUP BY user_id HAVING before_major <> after_major")
def major_version_changes(spark, d):
    at = F.struct("ts", "event_id")
    rows = T.table(spark, d, "events").where("value is not null").groupBy("user_id").agg(F.floor(F.min_by("value", at) / 100).alias("before_major"), F.floor(F.max_by("value", at) / 100).alias("after_major"))
    return rows.where("before_major <> after_major")


@query("SELECT DISTINCT l_partkey AS package FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-17' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-17')")
def new_dependencies(spark, d):
    # the least date of a package says whether an older row exists: one aggregation, no join
    first = T.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("package")).agg(F.min("l_shipdate").alias("first"))
    return first.where(F.col("first") >= F.lit("1995-06-17").cast("timestamp_ntz")).select("package")


@query("SELECT l_partkey AS package, l_suppkey AS manifest FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def duplicate_dependencies(spark, d):
    rows = T.table(spark, d, "lineitem").where("l_returnflag in ('R', 'A')").groupBy(F.col("l_partkey").alias("package"), F.col("l_suppkey").alias("manifest"))
    return rows.agg(F.min("l_returnflag").alias("lo"), F.max("l_returnflag").alias("hi")).where("lo < hi").select("package", "manifest")


@query("SELECT o_orderkey AS id, CASE o_orderpriority " + " ".join(f"WHEN '{r}' THEN '{s}'" for r, s in SEVERITIES.items()) + " END AS severity, substr(sha1(concat_ws(' ', o_orderpriority, o_custkey::VARCHAR)), 1, 12) AS fingerprint FROM orders WHERE o_orderpriority IN ('" + "', '".join(SEVERITIES) + "')")
def findings_with_severity(spark, d):
    severity = F.element_at(F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair]), F.col("o_orderpriority"))
    rows = T.table(spark, d, "orders").where(F.col("o_orderpriority").isin(list(SEVERITIES)))
    return rows.select(F.col("o_orderkey").alias("id"), severity.alias("severity"), fingerprint(F.col("o_orderpriority"), F.col("o_custkey").cast("string")).alias("fingerprint"))


@query("SELECT o_custkey AS scope, count(*) FILTER (o_totalprice > 300000) AS critical, least(5, greatest(3, count(*) FILTER (o_totalprice > 300000))) AS listed FROM orders GROUP BY o_custkey")
def issue_list_length(spark, d):
    critical = _count_if(F.col("o_totalprice") > 300000)
    return T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("scope")).agg(critical.alias("critical"), F.least(F.lit(5), F.greatest(F.lit(3), critical)).cast("long").alias("listed"))


@query("SELECT role, count(*) AS n, count(*) FILTER (regexp_matches(coalesce(text, '') || ' ', '(?i)" + "|".join(RATIONALE) + "')) AS reasons FROM conversations GROUP BY role")
def rationale_commits(spark, d):
    return T.table(spark, d, "conversations").groupBy("role").agg(_count_all().alias("n"), _count_if(is_rationale(F.coalesce("text", F.lit("")), F.lit(""))).alias("reasons"))


@query("SELECT l_orderkey AS file, bool_or(l_quantity > 40 OR l_linenumber > 5) AS behaves FROM lineitem GROUP BY l_orderkey")
def testable_behaviour(spark, d):
    return T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.bool_or((F.col("l_quantity") > 40) | (F.col("l_linenumber") > 5)).alias("behaves"))


@query("SELECT l_orderkey AS file, count(*) AS unresolved, min(l_linenumber)::BIGINT AS first_line FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45) GROUP BY l_orderkey")
def unresolved_imports(spark, d):
    known = T.table(spark, d, "part").where("p_size <= 45").select(F.col("p_partkey").alias("l_partkey"))
    rows = T.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(known, "l_partkey", "left_anti")
    return rows.groupBy(F.col("l_orderkey").alias("file")).agg(_count_all().alias("unresolved"), F.min("l_linenumber").cast("long").alias("first_line"))


@query(f"SELECT path, list_has_any(string_split(path, '/'), ['en', 'src1']) AS entry FROM ({_FILES})")
def entry_directories(spark, d):
    return T.files(spark, d).select("path", F.arrays_overlap(F.split("path", "/"), F.array(F.lit("en"), F.lit("src1"))).alias("entry"))


@query("SELECT o_orderkey AS id, o_orderdate AS taken FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def history_last_fifty(spark, d):
    return T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("taken")).orderBy(F.desc("taken"), F.desc("id")).limit(50)


@query(f"SELECT path, '{{\"path\":\"' || path || '\",\"lines\":' || lines || '}}' AS json FROM ({_FILES})")
def findings_json(spark, d):
    return T.files(spark, d).select("path", F.to_json(F.struct("path", "lines")).alias("json"))


@query("""WITH s AS (SELECT o_custkey AS change, count(*) FILTER (o_orderpriority = '1-URGENT') AS errors, count(*) FILTER (o_orderpriority = '2-HIGH') AS warnings, count(*) FILTER (o_orderstatus = 'F') - count(*) FILTER (o_orderstatus = 'O') AS drift FROM orders GROUP BY o_custkey)
SELECT change, CASE WHEN errors > 0 OR drift <= -5 THEN 'degraded' WHEN warnings > 0 OR drift < 0 THEN 'needs-review' ELSE 'healthy' END AS verdict FROM s""")
def review_verdicts(spark, d):
    is_ = lambda column, value: _count_if(F.col(column) == value)
    s = T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("change")).agg(is_("o_orderpriority", "1-URGENT").alias("errors"), is_("o_orderpriority", "2-HIGH").alias("warnings"), (is_("o_orderstatus", "F") - is_("o_orderstatus", "O")).alias("drift"))
    verdict = F.when((F.col("errors") > 0) | (F.col("drift") <= -5), "degraded").when((F.col("warnings") > 0) | (F.col("drift") < 0), "needs-review").otherwise("healthy")
    return s.select("change", verdict.alias("verdict"))
