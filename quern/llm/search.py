"""Nearest neighbours by a tree of k-means and best-bin-first traversal.

Vectors that repeat are one class with its ``KEEP`` least ids: no answer can
need more of them.  A tree is fitted on a bounded sample by k-means, node by
node, and every class goes down to its leaf.  A query walks the tree with a
priority queue of nodes, nearest centre first, and visits leaves until it has
enough of them and enough rows.  How many is calibrated: queries from the
sample are compared with all classes, and the number of visits is widened
until the visited leaves hold ``TARGET`` of their true neighbours.

Queries and classes of a leaf meet in blocks of bounded size, however many
there are of either; the nearest of all blocks are merged by ranks that are
limited before they are shuffled.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component take no part, nor do rows without vec_id and vectors of another
length than that of the least vec_id (the least vector of it, if it repeats).
Rows equal in id and vector count once; an id with several vectors asks once
for each and is never its own neighbour.  Ties go to the smaller vec_id.  With
fewer than ``NEAREST`` candidates all are returned; a lone row gets none and an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.codes import usable
from quern.llm.store import materialize

NEAREST = 10
#: Ids kept of a class: one more than asked for, since a query's own is left out.
KEEP = NEAREST + 1
#: Classes on which the tree is fitted, at most; it fixes the number of leaves.
SAMPLE = 40_000
BRANCH = 8
#: Sampled classes of a leaf, and classes of the table that a leaf should hold.
LEAF_SAMPLE, LEAF = 24, 1024
ROUNDS = 6
#: Queries of the sample that are held against all classes, and the share of their neighbours to be found.
CALIBRATE, TARGET = 100, 0.97
#: Queries and classes that meet in one group, about.
QUERY_BLOCK, CLASS_BLOCK = 1024, 4096


class Tree:
    """centres: of all nodes; children: first child of each node and how many; leaf: number of a node's leaf, -1 inside."""

    def __init__(self, sample: np.ndarray, size: int) -> None:
        rng = np.random.Generator(np.random.PCG64(5))
        self.centres = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])]
        self.first, self.many, self.leaf, self.leaves = [0], [0], [-1], 0
        queue = [(0, np.arange(len(sample)))]
        for node, rows in queue:
            groups = [] if len(rows) <= max(size, 1) else self._split(sample, rows, rng)
            if len(groups) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            self.first[node], self.many[node] = len(self.centres), len(groups)
            for group in groups:
                queue.append((len(self.centres), group))
                self.centres.append(sample[group].mean(0))
                self.first.append(0), self.many.append(0), self.leaf.append(-1)
        self.centres = np.array(self.centres)
        self.first, self.many, self.leaf = (np.array(a, np.int64) for a in (self.first, self.many, self.leaf))

    @staticmethod
    def _split(sample: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
        x = sample[rows]
        centres = x[rng.choice(len(x), min(BRANCH, len(x)), replace=False)]
        own = np.zeros(len(x), np.int64)
        for _ in range(ROUNDS):
            own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
            used = np.unique(own)
            centres = np.array([x[own == c].mean(0) for c in used])
        own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        return [rows[own == c] for c in range(len(centres)) if (own == c).any()]

    def down(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child's, from the root on."""
        node = np.zeros(len(x), np.int64)
        while True:
            at = self.many[node] > 0
            if not at.any():
                return self.leaf[node]
            for parent in np.unique(node[at]).tolist():
                on = np.flatnonzero(node == parent)
                a, n = int(self.first[parent]), int(self.many[parent])
                c = self.centres[a : a + n]
                node[on] = a + ((c**2).sum(1) - 2 * x[on] @ c.T).argmin(1)

    def order(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first: the nearest node that was seen and not yet opened comes next."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            n = int(self.many[node])
            if not n:
                yield int(self.leaf[node])
                continue
            a = int(self.first[node])
            for k, d in enumerate(((self.centres[a : a + n] - q) ** 2).sum(1).tolist()):
                heapq.heappush(queue, (d, a + k))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def classes_of(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row per different vector: key, v and its ``KEEP`` least ids.

    The key is the vector's hash and its least id, so different vectors have
    different keys unless both agree, which takes a repeated id.
    """
    rows = usable(rows, vector).where(F.col("vec_id").isNotNull() & F.exists(vector, lambda x: x != 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v"))
    least = rows.select("vec_id", "v", F.size("v").alias("size")).orderBy("vec_id", "v").limit(1).collect()
    rows = rows.where(F.size("v") == (least[0]["size"] if least else 0)).withColumn("h", F.xxhash64("v"))
    ranked = rows.withColumn("k", F.dense_rank().over(Window.partitionBy("h", "v").orderBy("vec_id"))).where(F.col("k") <= KEEP)
    found = ranked.groupBy("h", "v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    return found.select(F.struct("h", F.col("ids")[0].alias("id")).alias("key"), "v", "ids")


def fit(classes: DataFrame, n: int) -> tuple[Tree, np.ndarray]:
    """A tree on about ``SAMPLE`` classes, by hash, and the first ``CALIBRATE`` of the sample."""
    share = F.pmod(F.xxhash64("key.h", F.lit(17)), F.lit(1 << 32)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 32))
    rows = classes.where(share).select("key", "v").toArrow()
    order = np.lexsort([rows.column("key").combine_chunks().field(f).to_numpy() for f in ("id", "h")])
    x = _matrix(rows.column("v"))[order]
    return Tree(x, max(LEAF_SAMPLE, int(LEAF * min(1.0, SAMPLE / max(1, n)))) if n > LEAF else n), x[:CALIBRATE]


def index(classes: DataFrame, tree: Tree) -> DataFrame:
    """``classes`` with their leaf."""
    shared = classes.sparkSession.sparkContext.broadcast(tree)  # bounded by SAMPLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.down(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["key", "v", "ids", "leaf"])

    return classes.select("key", "v", "ids").mapInArrow(run, f"key struct<h:long,id:long>, v {classes.schema['v'].dataType.simpleString()}, ids array<long>, leaf long")


def calibrate(indexed: DataFrame, tree: Tree, queries: np.ndarray, target: float = TARGET) -> tuple[int, float]:
    """(leaves to visit, share of the queries' true neighbours in them): the queries are held against all classes."""
    if not len(queries):
        return 1, 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, leaf = _matrix(batch.column(0)), np.asarray(batch.column(1))
            for q, v in enumerate(queries):
                d = ((x - v) ** 2).sum(1)
                near = np.argsort(d, kind="stable")[:KEEP]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), q)), pa.array(d[near]), pa.array(leaf[near])], names=["q", "d", "leaf"])

    found = indexed.select("v", "leaf").mapInArrow(run, "q long, d double, leaf long")
    best = found.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy("d", "leaf"))).where(F.col("k") <= KEEP).collect()
    place = [{leaf: k for k, leaf in enumerate(tree.order(q))} for q in queries]
    at = np.array([place[r["q"]][r["leaf"]] for r in best])
    visits = 1
    while (at < visits).mean() < target and visits < tree.leaves:
        visits += max(1, visits // 16)
    return min(visits, tree.leaves), float((at < visits).mean())


def route(queries: DataFrame, tree: Tree, visits: int, sizes: np.ndarray) -> DataFrame:
    """A row (leaf, key, v) for every leaf that a query visits: ``visits`` that hold rows, and more until they hold ``KEEP`` ids."""
    shared = queries.sparkSession.sparkContext.broadcast((tree, sizes))  # bounded by SAMPLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, sizes = shared.value
        for batch in batches:
            x = _matrix(batch.column(1))
            for i in range(len(x)):
                leaves, held = [], 0
                for k, leaf in enumerate(tree.order(x[i])):
                    if k >= visits and held >= KEEP:
                        break
                    if sizes[leaf]:
                        leaves.append(leaf)
                        held += sizes[leaf]
                at = pa.array(np.full(len(leaves), i))
                yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), batch.column(0).take(at), batch.column(1).take(at)], names=["leaf", "key", "v"])

    return queries.select("key", "v").mapInArrow(run, f"leaf long, key struct<h:long,id:long>, v {queries.schema['v'].dataType.simpleString()}")


def _deal(rows: DataFrame, blocks: DataFrame, own: str, other: str) -> DataFrame:
    """Rows of a leaf dealt by key over its ``own`` blocks, and repeated for each of its ``other`` ones."""
    rows = rows.join(F.broadcast(blocks), "leaf")
    return rows.withColumn(own, F.pmod(F.xxhash64("key", F.lit(23)), F.col(f"n_{own}"))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{other}") - 1))).drop(f"n_{own}", f"n_{other}")


def meet(routed: DataFrame, indexed: DataFrame, blocks: DataFrame) -> DataFrame:
    """key, d, id: a query's ``KEEP`` nearest ids in each pair of blocks; blocks: leaf, n_qb, n_cb, a row per leaf."""

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, ds, ids = [], [], []
        if left.num_rows and right.num_rows:
            x = _matrix(right.column("v"))
            lists = right.column("ids").combine_chunks()
            first, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            count, start = np.diff(first), first[:-1]
            for i, q in enumerate(_matrix(left.column("v"))):
                d = np.sqrt(((x - q) ** 2).sum(1))
                on = np.flatnonzero(d <= np.partition(d, KEEP - 1)[KEEP - 1]) if len(d) > KEEP else np.arange(len(d))
                who = np.concatenate([flat[start[r] : start[r] + count[r]] for r in on])
                dist = np.repeat(d[on], count[on])
                best = np.lexsort((who, dist))[:KEEP]
                keys.append(np.full(len(best), i)), ds.append(dist[best]), ids.append(who[best])
        cat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return pa.table({"key": left.column("key").combine_chunks().take(cat(keys, pa.int64())), "d": cat(ds, pa.float64()), "id": cat(ids, pa.int64())})

    by = ["leaf", "qb", "cb"]
    queries = _deal(routed, blocks, "qb", "cb").groupBy(*by)
    return queries.cogroup(_deal(indexed, blocks, "cb", "qb").groupBy(*by)).applyInArrow(pair, "key struct<h:long,id:long>, d double, id long")


def search(rows: DataFrame, every: int, vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest of each row whose vec_id ``every`` divides, among all other rows."""
    spark = rows.sparkSession
    classes = materialize(classes_of(rows, vector), "classes")
    n = classes.count()
    tree, asked = fit(classes, n)
    indexed = materialize(index(classes, tree), "indexed")
    counts = indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("ids")).collect()  # a row per leaf at most
    sizes = np.zeros(tree.leaves, np.int64)
    for r in counts:
        sizes[r["leaf"]] = r["ids"]
    visits, _ = calibrate(indexed, tree, asked, target)
    # the queries' ids, and their classes, which ask once however many ids they have
    asking = usable(rows, vector).where(F.col("vec_id") % every == 0).select(F.col("vec_id").cast("long").alias("query_id"), F.col(vector).alias("v")).withColumn("h", F.xxhash64("v"))
    known = indexed.select("key", "v", F.col("key.h").alias("h"))
    members = materialize(asking.distinct().join(known, ["h", "v"]).select("query_id", "key"), "members")
    queries = indexed.join(members.select("key").distinct(), "key", "left_semi")
    routed = materialize(route(queries, tree, visits, sizes), "routed")
    per_leaf = dict(routed.groupBy("leaf").count().collect())
    blocks = spark.createDataFrame([(r["leaf"], -(-per_leaf[r["leaf"]] // QUERY_BLOCK), -(-r["n"] // CLASS_BLOCK)) for r in counts if r["leaf"] in per_leaf], "leaf long, n_qb long, n_cb long")
    near = meet(routed, indexed, blocks)
    best = near.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("d", "id"))).where(F.col("k") <= KEEP)
    lists = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("near"))
    # a repeated id may be among its own neighbours more than once: the lists are cut after it has gone
    own = F.expr("slice(filter(near, x -> x.id <> query_id), 1, %d)" % NEAREST)
    out = members.join(lists, "key").select("query_id", F.posexplode(own).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.d").alias("score"))
