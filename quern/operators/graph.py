"""Graph operators on (src, dst) edges, as rounds of joins that hold a row per node or edge.

A graph of at most ``LOCAL_EDGES`` edges, counted first, is solved in memory;
both ways give the same rows.  What a larger graph costs is its rounds.  Long chains take no round a step: nodes
with a single way on are contracted by doubling pointers, and depths double
the steps that they look ahead.  Strong components come from searches of 64
pivots at a time, a bit each, and from colours, which split what is left.
Every round is written to the folder that the cluster shares and the one
before it deleted, so plans don't grow and lost executors lose no round.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections import defaultdict, deque
from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark's switch for deleting a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Edges of a graph that is solved in memory: a few MB, as small as a table that is broadcast, and spared some hundred jobs.
LOCAL_EDGES = 20_000
#: Starts whose reach in such a graph is held in memory: at most this many times its nodes.
LOCAL_STARTS = 50
#: Pivots of a search: the bits of a long.
PIVOTS = 64
#: Nodes with a single way on are contracted if they are more than these: a long chain is costly however small its share.
FEW = 32
#: Rows that a round of ``depths`` may join to look twice as far ahead: a multiple of the edges, or this many.
AHEAD, LEAST_AHEAD = 1, 16_000_000
#: Starts whose nearest nodes are counted together, a bit each, and edges around them that a task may hold for that.
NEAR, NEAR_EDGES = 1024, 8_000_000
#: How many times ``NEAR`` starts a task may take with the edges around all of them, and edges that are dealt out to tasks at a time, at most.
NEAR_WIDE, NEAR_DEALT = 16, 128_000_000
#: Edges whose bits are merged at once.
STRIDE = 1 << 16
#: Rows of a sketch: sums over fewer parts are read off it, others are estimated with a standard error of 1 / sqrt(SKETCH - 2), or counted by bits.
SKETCH = 1024
#: Rows of 64 bits each that are held at a time where parts are counted by bits.
REACH_ROWS = 16_000_000


def scratch(spark: SparkSession) -> str:
    """The folder that the cluster shares; where none is set, one in the warehouse, and a local one only if all runs in one process.

    A cluster whose warehouse lies on a local file system has no folder that
    all machines see: that is an error, not a folder of the driver's own.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if sc.master.startswith("local"):
            root = tempfile.mkdtemp(prefix="quern-")
        else:
            root = f"{spark.conf.get('spark.sql.warehouse.dir')}/quern-scratch"
            if _folder(spark, root)[1].getUri().getScheme() == "file":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    return root


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read back, so that plans don't grow with the rounds.

    What was shuffled for a table is deleted when the table is there, not when
    the driver's memory is next collected.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/graph-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    if getattr(_WRITTEN, "paths", None) is not None:
        _WRITTEN.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> bool:
    """Whether the files that a table of ``cut`` reads are still there."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at, system = _folder(df.sparkSession, path)
        if not system.exists(at):
            return False
    return True


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once nothing reads them any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/graph-" in path:
                at, system = _folder(df.sparkSession, path)
                system.delete(at, True)


#: Per thread, the tables written since the innermost ``tidy`` function began.
_WRITTEN = threading.local()


def tidy(f: Callable) -> Callable:
    """A function that leaves no table but those its results read; the others it wrote are deleted at its end."""

    @wraps(f)
    def run(*args, **more):
        outer, _WRITTEN.paths = getattr(_WRITTEN, "paths", None), []
        try:
            out = f(*args, **more)
            read = {p.rpartition("/")[0].rpartition("/")[2] for df in (out if isinstance(out, tuple) else (out,)) for p in df.inputFiles()}
            for path in _WRITTEN.paths:
                if path.rpartition("/")[2] not in read:
                    at, system = _folder(args[0].sparkSession, path)
                    system.delete(at, True)
                elif outer is not None:
                    outer.append(path)
            return out
        finally:
            _WRITTEN.paths = outer

    return run


def _back(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _local(edges: DataFrame) -> list[tuple] | None:
    """All edges of a written table, if they are few enough; they are counted first."""
    if edges.count() > LOCAL_EDGES:
        return None
    rows = edges.toArrow()
    return list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))


def _node_type(edges: DataFrame) -> str:
    return edges.schema["src"].dataType.simpleString()


def _adjacency(pairs: list[tuple]) -> dict:
    out: dict = defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
        out.setdefault(b, out[b])
    return out


def _strong(after: dict) -> list[list]:
    """Strong components, every one after those it leads to."""
    index, low, on, stack, out = {}, {}, set(), [], []
    for root in after:
        if root in index:
            continue
        work = [(root, iter(after[root]))]
        index[root] = low[root] = len(index)
        stack.append(root), on.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt), on.add(nxt)
                    work.append((nxt, iter(after[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(stack.pop())
                        on.discard(group[-1])
                    out.append(group)
    return out


def closure(edges: DataFrame, most: int | None = None, starts: DataFrame | None = None) -> DataFrame:
    """(src, dst, depth) of all pairs joined by a path of one edge or more, and of ``most`` at most if given; depth is the shortest.  ``starts`` (src) may say from where."""
    edges = cut(edges.select("src", "dst").distinct())
    first = edges if starts is None else edges.join(starts, "src", "left_semi")
    known = fresh = cut(first.withColumn("depth", F.lit(1).cast("long")))
    depth = 1
    while depth != most and not fresh.isEmpty():
        depth += 1
        step = fresh.alias("f").join(edges.alias("e"), F.col("f.dst") == F.col("e.src")).select("f.src", F.col("e.dst").alias("dst")).distinct()
        fresh = cut(step.join(known, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        known = known.union(fresh)
    return known


@tidy
def near_counts(edges: DataFrame, most: int) -> DataFrame:
    """(node, one, near): how many nodes reach each in one step, and in ``most`` at most, itself too if on so short a cycle.

    As ``closure`` counts them, without its pairs: starts with numbers next to
    each other are a group, which takes the edges up to ``most`` steps from
    them and keeps a bit for each of ``NEAR`` starts in turn at every node.  A
    group is up to ``NEAR_WIDE`` times so many starts, so edges are dealt out
    to few groups, and ``NEAR_DEALT`` of them at a time at most.  Groups with
    more than ``NEAR_EDGES`` edges around them are made smaller, and at last counted by pairs.
    """
    edges = cut(edges.select("src", "dst").distinct())
    starts, sums = cut(edges.select(F.col("src").alias("start")).distinct()), []
    width = NEAR * max(1, min(NEAR_WIDE, starts.count() // (2 * NEAR * edges.sparkSession.sparkContext.defaultParallelism)))
    turn = max(1, NEAR_DEALT // max(1, min(edges.count(), NEAR_EDGES)))  # groups at a time
    while True:
        group = F.floor(F.col("start") / width).cast("long").alias("group")
        least, last = starts.agg(F.min(group), F.max(group)).first()
        left = []
        for at in range(least or 0, (last if last is not None else -1) + 1, turn):
            counted, large = _near_groups(edges, starts.select(group, "start").where(F.col("group").between(at, at + turn - 1)), width, most)
            sums.append(counted)
            if not large.isEmpty():
                left.append(large)
        if not left:
            break
        starts = reduce(DataFrame.union, left)
        if width == NEAR:
            pairs = closure(edges, most, starts.select(F.col("start").alias("src")))
            sums.append(pairs.groupBy(F.col("dst").alias("node")).agg(F.count(F.when(F.col("depth") == 1, 1)).alias("one"), F.count(F.lit(1)).alias("near")))
            break
        width = NEAR
    return cut(reduce(DataFrame.union, sums).groupBy("node").agg(F.sum("one").alias("one"), F.sum("near").alias("near"))) if sums else edges.selectExpr("src node", "0L one", "0L near").limit(0)


def _near_groups(edges: DataFrame, starts: DataFrame, width: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(node, one, near) of some groups' starts (group, start), ``width`` numbers wide, and (start) of the groups with too many edges around them."""
    asked = ring = starts = cut(starts.withColumnRenamed("start", "node"))
    for _ in range(most - 1):
        ring = cut(ring.join(edges, F.col("node") == F.col("src")).select("group", F.col("dst").alias("node")).distinct())
        asked = asked.union(ring)
    asked = cut(asked.distinct())
    ways = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    large = cut(asked.join(ways, "node").groupBy("group").agg(F.sum("n").alias("n")).where(F.col("n") > NEAR_EDGES).select("group"))
    around = asked.join(large, "group", "left_anti").join(edges, F.col("node") == F.col("src")).select("group", "src", "dst")

    def count(key, rows):
        import numpy as np
        import pandas as pd

        nodes, codes = np.unique(np.concatenate([rows["src"].to_numpy(), rows["dst"].to_numpy()]), return_inverse=True)
        src, dst = codes[: len(rows)], codes[len(rows) :]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        ones, nears = np.zeros(len(nodes), dtype=np.int64), np.zeros(len(nodes), dtype=np.int64)
        size = lambda bits: np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        for first in range(key[0] * width, (key[0] + 1) * width, NEAR):
            bit = nodes[src] - first
            own = np.flatnonzero((bit >= 0) & (bit < NEAR))
            if not len(own):
                continue
            one = np.zeros((len(nodes), NEAR // 64), dtype=np.uint64)
            np.bitwise_or.at(one, (dst[own], bit[own] // 64), np.uint64(1) << (bit[own] % 64).astype(np.uint64))
            near = one
            for _ in range(most - 1):
                live = np.flatnonzero(near.any(axis=1)[src])  # edges from nodes with a bit
                near = merged(np, one.copy(), near, src[live], dst[live])
            ones += size(one)
            nears += size(near)
        found = pd.DataFrame({"node": nodes, "one": ones, "near": nears})
        return found[found["near"] > 0]

    def merged(np, wider, near, src, dst):
        """The bits of ``near`` carried over edges in order of ``dst``, into ``wider``."""
        if not len(dst):
            return wider
        heads = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])  # where the edges into a node begin
        ends = np.r_[heads, len(dst)]
        a = 0
        while a < len(heads):
            z = max(a + 1, int(np.searchsorted(ends, heads[a] + STRIDE, "right")) - 1)
            start, end = heads[a], ends[z]
            while end - start > STRIDE:  # one node with very many edges into it
                wider[dst[start]] |= np.bitwise_or.reduce(near[src[start : start + STRIDE]], axis=0)
                start += STRIDE
            wider[dst[heads[a:z]]] |= np.bitwise_or.reduceat(near[src[start:end]], np.maximum(heads[a:z], start) - start, axis=0)
            a = z
        return wider

    counted = around.groupBy("group").applyInPandas(count, "node long, one long, near long").groupBy("node").agg(F.sum("one").alias("one"), F.sum("near").alias("near"))
    counted, left = cut(counted), cut(starts.join(large, "group", "left_semi").select(F.col("node").alias("start")))
    discard(asked, large)
    return counted, left


def strong_components(pairs: DataFrame) -> DataFrame:
    """(node, component) for nodes on cycles, from a closure: the definition that ``components`` follows without holding all pairs."""
    back = pairs.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return pairs.select("src", "dst").join(back, ["src", "dst"]).groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("component"))


@tidy
def reach(edges: DataFrame, starts: DataFrame, most: int | None = None, written: bool = False) -> DataFrame:
    """(start, node, distance) along edges from each of ``starts`` (start), the start itself left out, ``most`` steps at most.

    Holds a row for each start and node it reaches, so the starts decide the
    size: a change, the tests, a page, not all nodes of a large graph.
    Edges that are ``written`` once each are read where they are, not copied.
    """
    edges, starts = edges.select("src", "dst") if written else cut(edges.select("src", "dst").distinct()), starts.select("start").distinct()
    pairs = _local(edges)
    asked = [r.start for r in starts.limit(LOCAL_STARTS + 1).collect()] if pairs is not None else []
    if pairs is not None and len(asked) <= LOCAL_STARTS:
        after, rows = _adjacency(pairs), []
        for s in asked:
            seen, queue = {s: 0}, deque([s])
            while queue:
                at = queue.popleft()
                if most is None or seen[at] < most:
                    for nxt in after.get(at, ()):
                        if nxt not in seen:
                            seen[nxt] = seen[at] + 1
                            queue.append(nxt)
            rows += [(s, n, d) for n, d in seen.items() if d]
        kind = _node_type(edges)
        return edges.sparkSession.createDataFrame(rows, f"start {kind}, node {kind}, distance int")
    known = fresh = cut(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("distance")))
    depth = 0
    while depth != most and not fresh.isEmpty():
        depth += 1
        step = fresh.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        fresh = cut(step.join(known, ["start", "node"], "left_anti").withColumn("distance", F.lit(depth)))
        known = known.union(fresh)
    return known.where("distance > 0")


def dependents(edges: DataFrame, starts: DataFrame, most: int | None = None, written: bool = False) -> DataFrame:
    """``reach`` against the edges: who could break if a start changes."""
    return reach(_back(edges), starts, most, written)


def _flow(edges: DataFrame, start: DataFrame, merge: Callable[[str], Column], *by: str) -> DataFrame:
    """(node, label): ``start``'s labels merged along all paths, a node's own included, apart for each ``by``; merging is idempotent and only ever changes a label one way."""
    keys = ["node", *by]
    known, fresh = start, cut(start)
    while not fresh.isEmpty():
        step = fresh.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), *by, "label").groupBy(*keys).agg(merge("label").alias("label"))
        old = known.select(*keys, F.col("label").alias("old"))
        both = step.join(old, keys, "left").select(*keys, F.explode(F.array("label", F.coalesce("old", "label"))).alias("label"), "old").groupBy(*keys, "old").agg(merge("label").alias("label"))
        fresh, last = cut(both.where("old is null or label <> old").select(*keys, "label")), fresh
        known, before = cut(known.select(*keys, "label").join(fresh, keys, "left_anti").union(fresh)), known
        discard(last, *([] if before is start else [before]))
    return known


def _contract(edges: DataFrame, loops: DataFrame) -> dict | None:
    """What is left when nodes with a single way on are merged into where they lead, as long as that is single too; None if it isn't worth it.

    Pointers are doubled: after k rounds a node points 2**k steps on, or to the
    first node that has several ways or none.  Pointers that never end are on
    or lead into a cycle without an exit, a component by itself.  ``jumps`` are
    the pointers of every round; ``into`` where each merged node ends.
    """
    pointers = cut(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("at")).where("n = 1").select(F.col("src").alias("node"), "at", F.least("src", "at").alias("least"), F.lit(False).alias("done")))
    jumps, left = [pointers], pointers.count()
    if left <= FEW:
        return None
    for _ in range(left.bit_length() + 1):
        on = pointers.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("least").alias("l"), F.col("done").alias("d"))
        moved = pointers.where("not done").join(on, "at", "left").select("node", F.coalesce("next", "at").alias("at"), F.least("least", F.coalesce("l", "least")).alias("least"), (F.col("next").isNull() | F.col("d")).alias("done"))
        pointers = cut(moved.union(pointers.where("done")))
        jumps.append(pointers)
        if pointers.where("not done").isEmpty():
            break
    ends = pointers.where("not done")
    closed = cut(ends.select(F.col("at").alias("node")).distinct().join(pointers.select("node", "least"), "node"))
    merged = pointers.select("node", "at", "done")
    lead = edges.join(merged.select(F.col("node").alias("src")), "src", "left_anti").join(merged.select(F.col("node").alias("dst"), "at", "done"), "dst", "left").where("done is null or done")
    lead = cut(lead.select("src", F.coalesce("at", "dst").alias("dst")).distinct())
    own = loops.join(merged.select("node"), "node", "left_anti").union(lead.where("src = dst").select(F.col("src").alias("node"))).distinct()
    return {"edges": lead.where("src <> dst"), "loops": cut(own), "before": edges, "before_loops": loops, "closed": closed, "jumps": jumps, "into": pointers.where("done").select("node", "at")}


def _restore(level: dict, found: DataFrame) -> DataFrame:
    """(node, component) before a contraction from those after it.

    A merged node is on a cycle if a node that was kept enters it, or one
    that leads to it, and belongs with where it ends; the jumps carry that on.
    """
    into = level["into"]
    entered = level["before"].join(into.select(F.col("node").alias("dst"), "at"), "dst").join(found.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(found.select(F.col("node").alias("at"), F.col("component").alias("b")), "at").where("a = b")
    marked = cut(entered.select(F.col("dst").alias("node")).distinct())
    for jump in level["jumps"]:
        further = marked.join(jump.select("node", F.col("at").alias("to")), "node").select(F.col("to").alias("node"))
        marked, last = cut(marked.union(further).distinct()), marked
        discard(last)
    more = marked.join(into, "node").join(found.select(F.col("node").alias("at"), "component"), "at").select("node", "component")
    found = found.union(more).union(level["closed"].select("node", F.col("least").alias("component")))
    alone = level["before_loops"].join(found, "node", "left_anti")
    return cut(found.union(alone.select("node", F.col("node").alias("component"))))


def _trim(edges: DataFrame, rounds: int) -> DataFrame:
    """Without nodes that nothing enters or nothing leaves, which are on no cycle; ``rounds`` at most.  The table of ``edges`` is deleted."""
    n = edges.count()
    for _ in range(rounds):
        src, dst = edges.select("src").distinct(), edges.select(F.col("dst").alias("src")).distinct()
        both = src.join(dst, "src", "left_semi")
        edges, last = cut(edges.join(both, "src", "left_semi").join(both.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst")), edges
        discard(last)
        before, n = n, edges.count()
        if n in (0, before):
            break
    return edges


def _search(edges: DataFrame, kind: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(node, component) of the components that hold a pivot, and (node, kind) of the other nodes, split by what they reach.

    Every kind of nodes has up to ``PIVOTS`` pivots, a bit each; edges stay
    inside a kind.  Nodes of one component reach the same pivots and are
    reached by the same, so a node that shares a bit both ways is in that
    pivot's component, and no component is split.
    """
    h = F.xxhash64("node", F.lit(turn))
    slots = kind.select("kind", "node", h.alias("h")).groupBy("kind", F.pmod(F.col("h"), F.lit(PIVOTS)).cast("int").alias("slot")).agg(F.min_by("node", "h").alias("node"))
    pivots = cut(slots.select("node", F.expr("shiftleft(1L, slot)").alias("label")))
    ahead, behind = _flow(edges, pivots, F.bit_or), _flow(_back(edges), pivots, F.bit_or)
    seen = kind.join(ahead.withColumnRenamed("label", "f"), "node", "left").join(behind.withColumnRenamed("label", "b"), "node", "left").fillna(0, ["f", "b"])
    seen = cut(seen.withColumn("own", F.col("f").bitwiseAND(F.col("b"))))
    names = seen.where("own <> 0").groupBy("kind", "own").agg(F.min("node").alias("component"))
    return cut(seen.where("own <> 0").join(names, ["kind", "own"]).select("node", "component")), seen.where("own = 0").select("node", F.xxhash64("kind", "f", "b").alias("kind"))


def _colour(edges: DataFrame, kind: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``_search``: each node takes the least node that reaches it as its colour; those that reach it inside the colour are its component."""
    colour = _flow(edges, kind.select("node", F.col("node").alias("label")), F.min)
    a, b = colour.toDF("src", "a"), colour.toDF("dst", "b")
    inside = cut(edges.join(a, "src").join(b, "dst").where("a = b").select("src", "dst"))
    found = _flow(_back(inside), cut(colour.where("node = label")), F.min)
    rest = kind.join(found.select("node"), "node", "left_anti").join(colour, "node")
    return found.select("node", F.col("label").alias("component")), rest.select("node", F.xxhash64("kind", "label").alias("kind"))


@tidy
def components(edges: DataFrame) -> DataFrame:
    """(node, component) for nodes on cycles: the least node of those that reach it and that it reaches.

    Chains and trees are contracted both ways first.  What is left is searched
    from many pivots and by colours in turn; found components leave, and edges
    between nodes that were told apart are cut.  Rounds follow the diameter
    of what can't be contracted, not the length of chains.
    """
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    pairs = _local(edges)
    if pairs is not None:
        own = {a for a, b in pairs if a == b}
        groups = [g for g in _strong(_adjacency(pairs)) if len(g) > 1 or g[0] in own]
        kind = _node_type(edges)
        return edges.sparkSession.createDataFrame([(n, min(g)) for g in groups for n in g], f"node {kind}, component {kind}")
    loops = cut(edges.where("src = dst").select(F.col("src").alias("node")))
    live = _trim(edges.where("src <> dst"), 2)
    levels, sides, n = [], [False, True], live.count()
    while n and sides:
        back = sides.pop(0)
        level = _contract(_back(live) if back else live, loops)
        if level:
            live, loops = cut(_back(level["edges"]) if back else level["edges"]), level["loops"]
            n = live.count()
            levels.append(level)
            sides.append(back)
    live = _trim(live, 2)
    found, turn = live.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0), 0
    kind = live.select(F.col("src").alias("node"), F.lit(0).cast("long").alias("kind")).distinct()
    while not live.isEmpty():
        kind = cut(kind)
        gone, kind = _search(live, kind, turn) if turn % 2 == 0 else _colour(live, kind)
        found, turn = found.union(gone), turn + 1
        kind = cut(kind)
        a, b = kind.select(F.col("node").alias("src"), F.col("kind").alias("a")), kind.select(F.col("node").alias("dst"), F.col("kind").alias("b"))
        live = _trim(cut(live.join(a, "src").join(b, "dst").where("a = b").select("src", "dst")), 2)
        kind = kind.join(live.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    # a part of one node is a cycle only by a self edge
    cyclic = found.groupBy("component").count().where("count > 1").select("component")
    found = found.join(cyclic, "component", "left_semi").select("node", "component")
    found = cut(found.union(loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))))
    for level in reversed(levels):
        found = _restore(level, found)
    names = found.groupBy("component").agg(F.min("node").alias("least"))
    return cut(found.join(names, "component").select("node", F.col("least").alias("component")))


def inside(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """The edges inside a component of (node, component): with some edges left out, loops run along these alone."""
    a, b = parts.toDF("src", "component"), parts.toDF("dst", "other")
    return edges.join(a, "src").join(b, "dst").where("component = other")


@tidy
def condensed(edges: DataFrame, parts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, part, size, cyclic) of every node, and the edges between different parts; a part is a strong component, ``components`` of the edges if not given."""
    return _condensed(cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct()), parts)


def _condensed(edges: DataFrame, parts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Of distinct edges: those that touch no node on a cycle stay as they are, so only the others are told apart again."""
    parts = components(edges) if parts is None else parts
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    cyclic = cut(parts.join(sizes, "component").select("node", "component", "size"))
    part = nodes.join(cyclic, "node", "left").select("node", F.coalesce("component", "node").alias("part"), F.coalesce("size", F.lit(1)).cast("long").alias("size"), F.col("component").isNotNull().alias("cyclic"))
    a, b = cyclic.select(F.col("node").alias("src"), F.col("component").alias("a")), cyclic.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    both = edges.join(a, "src", "left").join(b, "dst", "left")
    plain = both.where("a is null and b is null and src <> dst").select("src", "dst")
    moved = both.where("a is not null or b is not null").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst")).where("src <> dst").distinct()
    return cut(part), cut(plain.union(moved))


@tidy
def depths(edges: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(node, depth): the longest chain of edges from each node, where a component of n nodes counts n - 1; ``parts`` as for ``condensed``.

    Over the parts, ``deep`` is the longest chain of under 2**k steps and
    ``ahead`` the longest of exactly 2**k steps to each part so far away; both
    double in a round.  Where the pairs ahead would be too many (``AHEAD``,
    ``LEAST_AHEAD``), k stays, and rounds of 2**k steps go on until no depth grows.
    """
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct())
    pairs = _local(edges)
    if pairs is not None:
        after = _adjacency(pairs)
        deep: dict = {}
        for group in _strong(after):
            own = set(group)
            beyond = max((1 + deep[t] for n in group for t in after[n] if t not in own), default=0)
            deep.update(dict.fromkeys(group, len(group) - 1 + beyond))
        return edges.sparkSession.createDataFrame(list(deep.items()), f"node {_node_type(edges)}, depth int")
    part, between = _condensed(edges, parts)
    discard(edges)
    size = part.select(F.col("part").alias("src"), "size").distinct()
    ahead = cut(between.join(size, "src").select("src", "dst", F.col("size").cast("long").alias("far")))
    discard(between)
    most = max(AHEAD * ahead.count(), LEAST_AHEAD)
    deep = cut(part.select(F.col("part").alias("node"), (F.col("size") - 1).cast("long").alias("depth")).distinct())
    doubling = True
    while not ahead.isEmpty():
        more = ahead.join(deep.select(F.col("node").alias("dst"), "depth"), "dst").groupBy(F.col("src").alias("node")).agg(F.max(F.col("far") + F.col("depth")).alias("new"))
        grown = deep.join(more, "node", "left").select("node", F.greatest("depth", F.coalesce("new", "depth")).alias("depth"), (F.col("new") > F.col("depth")).alias("grew"))
        grown = cut(grown)
        changed = not grown.where("grew").isEmpty()
        discard(deep)
        deep = grown.select("node", "depth")
        if not doubling:
            if not changed:
                break
            continue
        into, out = ahead.groupBy(F.col("dst").alias("at")).agg(F.count(F.lit(1)).alias("i")), ahead.groupBy(F.col("src").alias("at")).agg(F.count(F.lit(1)).alias("o"))
        pairs = into.join(out, "at").agg(F.sum(F.col("i") * F.col("o"))).first()[0] or 0
        if pairs > most:
            doubling = False
            continue
        a, b = ahead.select("src", F.col("dst").alias("at"), F.col("far").alias("x")), ahead.select(F.col("src").alias("at"), "dst", F.col("far").alias("y"))
        ahead, last = cut(a.join(b, "at").groupBy("src", "dst").agg(F.max(F.col("x") + F.col("y")).alias("far"))), ahead
        discard(last)
    return part.select("node", "part").join(deep.select(F.col("node").alias("part"), "depth"), "part").select("node", F.col("depth").cast("int").alias("depth"))


@tidy
def loops(edges: DataFrame) -> DataFrame:
    """(component, files): one loop through each strong component of two nodes or more.

    The loop starts at the least node and goes depth first by name; where that
    finds none back to the start, it is all members by name.  Components come
    to one task each, with the edges inside them.
    """
    own = inside(edges.where("src <> dst"), components(edges.where("src <> dst"))).select("component", "src", "dst").distinct()

    def one(pairs: list[tuple]) -> list:
        after: dict = {}
        for a, b in sorted(pairs):
            after.setdefault(a, []).append(b)
        start = min(after)
        path, seen, work = [start], {start}, [iter(after[start])]
        while work:
            for nxt in work[-1]:
                if nxt == start and len(path) > 1:
                    return path
                if nxt not in seen:
                    path.append(nxt), seen.add(nxt), work.append(iter(after[nxt]))
                    break
            else:
                path.pop(), work.pop()
        return sorted(after)

    kind = _node_type(edges)

    def run(key, rows):
        import pandas as pd

        return pd.DataFrame({"component": [key[0]], "files": [one(list(zip(rows["src"], rows["dst"])))]})

    return own.groupBy("component").applyInPandas(run, f"component {kind}, files array<{kind}>")


def _sketches(between: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """(part, id, rank, size): of the parts that reach a part, itself too, the ``k`` of least rank.

    A part's rank is exponential with its size as the rate, from its hash, so
    that sketches of overlapping sets merge by keeping the least ranks.  They
    are merged along the edges; in a round only entries that were new and stayed go on.
    """
    uniform = (F.pmod(F.xxhash64("part", F.lit(29)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    known = fresh = cut(weights.select("part", F.col("part").alias("id"), (-F.log(uniform) / F.col("size")).alias("rank"), "size"))
    least = Window.partitionBy("part").orderBy("rank", "id")
    while not fresh.isEmpty():
        step = fresh.withColumnRenamed("part", "src").join(between, "src").select(F.col("dst").alias("part"), "id", "rank", "size").distinct()
        new = step.join(known.select("part", "id"), ["part", "id"], "left_anti").withColumn("new", F.lit(True))
        both = cut(known.withColumn("new", F.lit(False)).unionByName(new).withColumn("k", F.row_number().over(least)).where(F.col("k") <= k).drop("k"))
        if fresh is not known:
            discard(known)
        known, fresh = both.drop("new"), both.where("new").drop("new")
    return known


def _by_bits(between: DataFrame, weights: DataFrame, entries: DataFrame, many: DataFrame) -> DataFrame:
    """(id, all): the summed sizes of all parts that reach each of ``many`` (id), itself too.

    What follows one of ``many`` is one of them, and the ``entries`` of other
    parts are all that reach them: so bits of what stands before ``many`` go
    on among these alone, 64 parts with names next to each other to a row.
    Rows are made in turns of ``REACH_ROWS`` at most.
    """
    row = F.monotonically_increasing_id()
    spot = cut(weights.repartitionByRange("part").sortWithinPartitions("part").select(F.col("part").alias("id"), "size", F.shiftright(row, 6).alias("word"), row.bitwiseAND(F.lit(63)).cast("int").alias("slot")))
    turns = -(-many.count() * spot.select("word").distinct().count() // REACH_ROWS) or 1
    bit = F.expr("shiftleft(1L, slot)")
    turn = F.pmod(F.xxhash64("word"), F.lit(turns)).alias("turn")
    lists = entries.join(many.select(F.col("id").alias("part")), "part", "left_anti").join(spot, "id").select("part", "word", bit.alias("label"))
    lists = cut(lists.groupBy("part", "word").agg(F.bit_or("label").alias("label")).withColumn("turn", turn))
    inner = between.join(many.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    border = cut(inner.join(many.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst"))
    inner = cut(inner.join(many.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst"))
    own = spot.join(many, "id").select(F.col("id").alias("node"), "word", bit.alias("label"), turn)
    # parts of one node count by their bits, the others what they have besides
    more = cut(spot.where("size > 1").groupBy("word").agg(F.collect_list(F.struct(bit.alias("bit"), (F.col("size") - 1).alias("more"))).alias("large")))
    besides = F.aggregate(F.filter(F.coalesce("large", F.array().cast(more.schema["large"].dataType)), lambda x: x["bit"].bitwiseAND(F.col("label")) != 0), F.lit(0).cast("long"), lambda n, x: n + x["more"])
    sums = []
    for i in range(turns):
        before = lists.where(F.col("turn") == i).join(border, F.col("part") == F.col("src")).select(F.col("dst").alias("node"), "word", "label")
        start = cut(before.union(own.where(F.col("turn") == i).select("node", "word", "label")).groupBy("node", "word").agg(F.bit_or("label").alias("label")))
        known = _flow(inner, start, F.bit_or, "word")
        sums.append(cut(known.join(more, "word", "left").select(F.col("node").alias("id"), (F.bit_count("label") + besides).alias("n")).groupBy("id").agg(F.sum("n").alias("all"))))
        discard(start, known)
    return reduce(DataFrame.union, sums).groupBy("id").agg(F.sum("all").alias("all"))


@tidy
def reach_counts(edges: DataFrame, k: int | None = None) -> DataFrame:
    """(node, affected, exact): how many nodes reach each node that any reaches, itself too if on a cycle.

    All counts are exact unless ``k`` asks for estimates.  Sketches hold
    ``SKETCH`` rows a part; where fewer parts reach a part their sizes are
    added up, the others are counted by bits (``_by_bits``).  With ``k``, at most
    ``k`` rows are held a part, and where a sketch is full each but the k-th is counted by one over its
    chance to be listed: unbiased, with a standard error of at most 1 / sqrt(k - 2) of the sum.
    """
    part, between = condensed(edges)
    size = part.groupBy("part").agg(F.first("size").alias("size"), F.first("cyclic").alias("cyclic"))
    rows = k or SKETCH
    found = _sketches(between, size.select("part", "size"), rows)
    entries = found.withColumn("last", F.max("rank").over(Window.partitionBy("part")))
    # an entry is among the least by the chance that its rank is under the last one
    share = F.when(F.col("rank") < F.col("last"), F.col("size") / (1 - F.exp(-F.col("size") * F.col("last"))))
    sums = entries.groupBy(F.col("part").alias("id")).agg(F.sum("size").alias("all"), F.count(F.lit(1)).alias("n"), F.sum(share).alias("estimate"))
    if k is None:
        sums = cut(sums.select("id", "all", (F.col("n") < rows).alias("listed")))
        many = cut(sums.where("not listed").select("id"))
        total, exact = F.col("all"), F.lit(True)
        if not many.isEmpty():
            whole = _by_bits(between, size.select("part", "size"), found.select("part", "id"), many)
            sums = cut(sums.where("listed").select("id", "all").union(whole))
    else:
        total = F.when(F.col("n") < k, F.col("all")).otherwise(F.greatest(F.col("all"), F.round("estimate").cast("long")))
        exact = F.col("n") < k
    per = sums.join(size.withColumnRenamed("part", "id"), "id").select("id", (total - F.when(F.col("cyclic"), 0).otherwise(1)).alias("affected"), exact.alias("exact"))
    return part.select("node", F.col("part").alias("id")).join(per.where("affected > 0"), "id").select("node", "affected", "exact")
