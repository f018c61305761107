"""Named queries over the virtual project, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import fingerprint, round_half_up, sloc
from quern.operators import graph
from quern.plans.findings import informative, is_structural, normalized_line
from quern.sources import tables as T
from quern.streaming.sessions import bursts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_FILES = "SELECT concat_ws('/', source, lang, 'doc' || doc_id || '.txt') AS path, source AS area, lang AS language, text, len(string_split(text, chr(10))) AS lines, doc_id % 7 = 0 AS is_test FROM documents"
_LINES = f"SELECT path, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM ({_FILES})"
_EDGES = "SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst FROM lineitem) WHERE src <> dst"
_CLOSURE = f"edges AS ({_EDGES}), reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"SELECT path, lines FROM ({_FILES}) WHERE lines > 20 AND NOT is_test")
def large_files(spark, d):
    return T.files(spark, d).where("lines > 20 and not is_test").select("path", "lines")


_STATE = "list_reduce(list_prepend({'n': 0, 'inside': false, 't': ''}, list_transform(string_split(text, chr(10)), lambda x: {'n': 0, 'inside': false, 't': trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))})), lambda s, x: {'n': s.n + CASE WHEN NOT s.inside AND x.t <> '' AND NOT starts_with(x.t, '*') AND NOT starts_with(x.t, '/*') AND NOT starts_with(x.t, '//') THEN 1 ELSE 0 END, 'inside': (s.inside OR starts_with(x.t, '/*')) AND NOT contains(x.t, '*/'), 't': ''}).n"


@query(f"SELECT path, lines AS n_lines, {_STATE} AS sloc FROM ({_FILES})")
def sloc_per_file(spark, d):
    # counted inside the row: nothing is dealt out
    return T.files(spark, d).select("path", F.col("lines").alias("n_lines"), sloc(F.split("text", "\n")).alias("sloc"))


@query(f"SELECT area, language, count(*) AS n_files, sum(lines)::BIGINT AS n_lines, count(*) FILTER (is_test) AS n_tests, max(lines) AS longest FROM ({_FILES}) GROUP BY area, language")
def area_stats(spark, d):
    return T.files(spark, d).groupBy("area", "language").agg(F.count(F.lit(1)).alias("n_files"), F.sum("lines").alias("n_lines"), F.count(F.when(F.col("is_test"), 1)).alias("n_tests"), F.max("lines").alias("longest"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '([^/]*)$', 1) AS leaf, len(string_split(url, '/')) - 1 AS slashes FROM pages")
def path_parts(spark, d):
    return T.table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "([^/]*)$", 1).alias("leaf"), (F.size(F.split("url", "/")) - 1).cast("long").alias("slashes"))


@query(f"SELECT area, regexp_matches(path, '^src1[0-9]*/(en|de)/') AS in_scope, count(*) AS n FROM ({_FILES}) GROUP BY 1, 2")
def glob_scope_partition(spark, d):
    return T.files(spark, d).groupBy("area", F.col("path").rlike("^src1[0-9]*/(en|de)/").alias("in_scope")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT path, n AS line, regexp_extract(line, '(secret|token|password|api_?key)', 1) AS name FROM ({_LINES}) WHERE regexp_matches(line, '(secret|token|password|api_?key)')")
def secret_names(spark, d):
    p = "(secret|token|password|api_?key)"
    return T.lines(spark, d).where(F.col("line").rlike(p)).select("path", F.col("n").cast("long").alias("line"), F.regexp_extract("line", p, 1).alias("name"))


@query(f"SELECT path, substr(sha1(concat_ws(' ', 'large-file', path, CASE WHEN is_test THEN 'test' END)), 1, 12) AS fingerprint FROM ({_FILES})")
def fingerprints(spark, d):
    return T.files(spark, d).select("path", fingerprint(F.lit("large-file"), F.col("path"), F.when(F.col("is_test"), F.lit("test"))).alias("fingerprint"))


_NORMAL = r"regexp_replace(regexp_replace(line, '^[ \t\r\f\v]+|[ \t\r\f\v]+$', '', 'g'), '[ \t\r\f\v]+', ' ', 'g')"
_STRUCTURAL = r"(length(line) < 8 OR regexp_matches(line, '^[}\]);,]+$') OR regexp_matches(line, '^(//|#|\*)') OR regexp_matches(line, '^(import|export|from|package|use\s)'))"


@query(f"""WITH l AS (SELECT path, n, {_NORMAL} AS line FROM ({_LINES})),
w AS (SELECT path, n, line || chr(10) || lead(line) OVER p || chr(10) || lead(line, 2) OVER p AS block, bool_or({_STRUCTURAL}) OVER (p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS broken FROM l WINDOW p AS (PARTITION BY path ORDER BY n)),
g AS (SELECT sha1(block) AS block, count(*) AS places, count(DISTINCT path) AS files, min(path) AS first_path FROM w WHERE block IS NOT NULL AND NOT broken GROUP BY 1) SELECT * FROM g WHERE places > 1""")
def dup_block_windows(spark, d):
    # windows of three lines are cut inside the row; regions and overlaps are in project_duplicate_blocks
    lines = F.transform(F.split("text", "\n"), normalized_line)
    rows = T.files(spark, d).select("path", lines.alias("l")).withColumn("s", F.transform("l", is_structural)).where("size(l) > 2")
    free = F.filter(F.sequence(F.lit(1), F.size("l") - 2), lambda i: informative("s", i, 3))
    each = rows.select("path", F.explode(F.transform(free, lambda i: F.sha1(F.array_join(F.slice("l", i, 3), "\n").cast("binary")))).alias("block"))
    per = each.groupBy("block", "path").agg(F.count(F.lit(1)).alias("n"))  # a file's windows meet before they are dealt out by block
    return per.groupBy("block").agg(F.sum("n").alias("places"), F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path")).where("places > 1")


@query("SELECT l_partkey AS src, l_suppkey AS dst, l_linenumber::BIGINT AS line FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS k FROM lineitem) WHERE k = 1")
def edges_first_wins(spark, d):
    first = F.min_by("l_linenumber", F.struct("l_orderkey", "l_linenumber", "l_extendedprice"))
    return T.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(first.cast("long").alias("line"))


@query(f"WITH e AS ({_EDGES}) SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node")
def in_out_degree(spark, d):
    e = T.edges(spark, d)
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    return e.select(ends.alias("x")).select("x.*").groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


@query(f"WITH RECURSIVE {_CLOSURE} SELECT dst AS node, count(*) AS affected FROM reach GROUP BY dst")
def reverse_reachable(spark, d):
    return graph.reach_counts(T.edges(spark, d)).select("node", "affected")


@query(f"WITH RECURSIVE {_CLOSURE} SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src")
def scc_members(spark, d):
    return graph.components(T.edges(spark, d))


@query(f"WITH RECURSIVE {_CLOSURE}, m AS (SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src) SELECT component, count(*) AS size, string_agg(node::VARCHAR, ' ' ORDER BY node) AS members FROM m GROUP BY component")
def cycle_findings(spark, d):
    m = graph.components(T.edges(spark, d))
    return m.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.array_sort(F.collect_list("node")).cast("array<string>"), " ").alias("members"))


@query(f"WITH e AS ({_EDGES}) SELECT CASE WHEN dst % 4 = src % 4 THEN 'same' WHEN dst % 4 < src % 4 THEN 'violation' WHEN dst % 4 > src % 4 + 1 THEN 'skip' ELSE 'ok' END AS relation, count(*) AS n FROM e GROUP BY 1")
def layer_relations(spark, d):
    s, t = F.col("src") % 4, F.col("dst") % 4
    relation = F.when(t == s, "same").when(t < s, "violation").when(t > s + 1, "skip").otherwise("ok")
    return T.edges(spark, d).groupBy(relation.alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand AS layer, count(*) AS n, count(*) FILTER (p_size > 25) AS covered, floor(100.0 * count(*) FILTER (p_size > 25) / count(*) + 0.5)::BIGINT AS percent FROM part GROUP BY p_brand")
def layer_coverage(spark, d):
    covered = F.count(F.when(F.col("p_size") > 25, 1))
    return T.table(spark, d, "part").groupBy(F.col("p_brand").alias("layer")).agg(F.count(F.lit(1)).alias("n"), covered.alias("covered"), round_half_up(100 * covered / F.count(F.lit(1))).alias("percent"))


_SCORES = "SELECT l_orderkey AS file, count(*) AS functions, max(l_quantity) AS complexity, greatest(0, least(100, floor(100 - greatest(0, max(l_quantity) - 40) * 5 + 0.5)))::BIGINT AS score FROM lineitem GROUP BY l_orderkey"


@query(_SCORES)
def stats_scores(spark, d):
    worst = F.max("l_quantity")
    score = F.greatest(F.lit(0), F.least(F.lit(100), round_half_up(100 - F.greatest(F.lit(0.0), worst - 40) * 5))).cast("long")
    return T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.count(F.lit(1)).alias("functions"), worst.alias("complexity"), score.alias("score"))


@query("""WITH f AS (SELECT DISTINCT o_custkey AS key, o_orderdate < TIMESTAMP '1995-06-17' AS old FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT key, CASE WHEN bool_and(old) THEN 'resolved' WHEN bool_or(old) THEN 'kept' ELSE 'new' END AS status FROM f GROUP BY key""")
def baseline_diff(spark, d):
    o = T.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("key"), (F.col("o_orderdate") < F.lit("1995-06-17").cast("timestamp_ntz")).alias("old"))
    status = F.when(F.bool_and("old"), "resolved").when(F.bool_or("old"), "kept").otherwise("new")
    return o.groupBy("key").agg(status.alias("status"))


@query("SELECT o_orderkey AS id, k FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 20")
def rank_and_number(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.row_number().over(w).cast("long").alias("k")).where("k <= 20")


#: The file asked about, and how many of its last commits count (fixed).
CHANGED_FILE, LAST_COMMITS = 7, 30


@query(f"WITH c AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), last AS (SELECT l_orderkey FROM c JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey = {CHANGED_FILE} ORDER BY o_orderdate DESC, l_orderkey DESC LIMIT {LAST_COMMITS}) SELECT l_partkey AS file, count(*) AS times FROM c WHERE l_orderkey IN (FROM last) AND l_partkey <> {CHANGED_FILE} GROUP BY 1")
def cochange_pairs(spark, d):
    # the commits of the file are found first, so no pairs of other files are made
    c = T.table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    dates = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    last = c.where(F.col("l_partkey") == CHANGED_FILE).join(dates, "l_orderkey").orderBy(F.desc("o_orderdate"), F.desc("l_orderkey")).limit(LAST_COMMITS).select("l_orderkey")
    others = c.where(F.col("l_partkey") != CHANGED_FILE).join(F.broadcast(last), "l_orderkey", "left_semi")
    return others.groupBy(F.col("l_partkey").alias("file")).agg(F.count(F.lit(1)).alias("times"))


@query("""SELECT user_id, min(ts) AS started, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM
(SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, burst""")
def session_debounce(spark, d):
    return bursts(T.table(spark, d, "events"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'R')")
def unused_dependencies(spark, d):
    used = T.table(spark, d, "lineitem").where("l_quantity >= 50 and l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"))
    return T.table(spark, d, "supplier").join(used, "s_suppkey", "left_anti").select("s_suppkey", "s_name")


@query("SELECT l_partkey AS file, count(DISTINCT l_orderkey) AS commits, count(DISTINCT o_custkey) AS authors, min(o_orderdate) AS created, max(o_orderdate) AS changed FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey")
def file_history(spark, d):
    rows = T.table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(T.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("l_partkey").alias("file")).agg(F.countDistinct("l_orderkey").alias("commits"), F.countDistinct("o_custkey").alias("authors"), F.min("o_orderdate").alias("created"), F.max("o_orderdate").alias("changed"))
