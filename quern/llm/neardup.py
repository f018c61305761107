"""Near-duplicate documents by SetSketch registers, banding and verification.

1. Documents with the same shingle set form a class (128-bit set fingerprint);
   only one row per class goes on, so exact copies never make pairs.
2. A class gets ``M`` SetSketch registers.  Every shingle is the source of a
   Poisson process of points (time, register); a register is the first time
   that any shingle hits it, truncated at ``REACH / n`` and placed on an
   exponential scale of base ``BASE``.  Registers of a union are maxima of
   registers, so sketches merge, and equal registers have about the
   probability of the Jaccard similarity.
3. ``BANDS`` bands of ``ROWS`` registers give buckets.  A pair at similarity
   0.85 shares none with probability under 1e-6, one at 0.8 under 1e-4.
4. In a bucket each class is first paired with the bucket's least class alone.
   The joint likelihood of two sketches over the similarity drops pairs that
   can't reach the threshold; the rest are verified on full shingle sets.
5. In buckets whose classes the links found have not joined yet, classes are
   compared across components on full sets, by products of incidence
   matrices, so no link that banding reveals is lost and no pair becomes a row
   unless it is a link.  A large bucket is dealt out in pairs of blocks, so
   what one task holds is bounded.
6. Components come from alternating large-star and small-star rounds.

Defined cases: null, empty or word-free text has an empty set and is linked
with nothing but rows of its own doc_id; repeated rows share a class; the
component is the smallest doc_id reachable; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textops as X
from quern.llm.store import materialize

BANDS, ROWS = 25, 5
M = 128
REACH = 8.0
BASE = 1.001
BLOCK, BLOCK_SHINGLES = 2048, 4 << 20
SCAN = "doc_id long, n_shingles long, cls binary, sketch binary"
_SEED_T, _SEED_R = X.U(0xA0761D6478BD642F), X.U(0xE7037ED1A0B428DB)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, their rows), by row; a row of fewer words has its whole sequence as one."""
    words = X.Words(X.LOWER[data], offs)
    h, rows = words.hashes(), words.rows
    ok = X.whole(rows, k)
    sh, sr = X.windows(h, k)[ok], rows[: len(ok)][ok]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    extra = [X.mix(X.windows(h[words.first[r] : words.first[r + 1]], int(words.counts[r])) + X.U(words.counts[r])) for r in short]
    sh, sr = np.concatenate([sh, *extra]), np.concatenate([sr, short])
    order = np.lexsort((sh, sr))
    sh, sr = sh[order], sr[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (sr[1:] != sr[:-1])
    return sh[new], sr[new]


def fingerprints(sh: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits of each row's set: two sums of independent mixes, which don't depend on order."""
    out = np.zeros((len(first) - 1, 2), X.U)
    for i, seed in enumerate((_SEED_T, _SEED_R)):
        c = np.zeros(len(sh) + 1, X.U)
        np.cumsum(X.mix(sh ^ seed), out=c[1:])
        out[:, i] = c[first[1:]] - c[first[:-1]]
    return out


def registers(sh: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """M 16-bit registers for each row; 0 is a register that no point reached."""
    best = np.full(len(sizes) * M, np.inf, np.float32)
    limit = (REACH / np.maximum(sizes, 1)).astype(np.float32)
    h, at, t = sh, rows * M, np.zeros(len(sh), np.float32)
    k = 0
    while len(h):
        k += 1
        h = X.mix(h + _SEED_T)
        # 40 bits for the waiting time, 7 for the register
        t = t - np.log1p(-((h >> X.U(24)).astype(np.float64) / 2.0**40)).astype(np.float32) / np.float32(M)
        keep = t < limit[at // M]
        h, at, t = h[keep], at[keep], t[keep]
        np.minimum.at(best, at + (h & X.U(M - 1)).astype(np.int64), t)
    with np.errstate(divide="ignore"):
        level = np.floor(24000.0 - np.log(best.astype(np.float64)) / np.log(BASE))
    return np.where(np.isfinite(best), np.clip(level, 1, 65535), 0).astype("<u2").reshape(-1, M)


def scan(docs: DataFrame, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keys``, set size, class and sketch (null for rows of a class seen before in the batch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sizes, fps = np.zeros(n, np.int64), np.zeros((n, 2), X.U)
            sketches, seen = [None] * n, set()

            def flush(rows: list[int], sets: list[np.ndarray]) -> None:
                if rows:
                    own = np.array([len(s) for s in sets])
                    regs = registers(np.concatenate(sets), np.repeat(np.arange(len(sets)), own), own)
                    for r, reg in zip(rows, regs):
                        sketches[r] = reg.tobytes()
                rows.clear(), sets.clear()

            small: tuple[list, list] = ([], [])
            for i, j, data, offs in X.slices(batch.column("text"), X.SMALL):
                sh, rows = shingle_sets(data, offs, k)
                first = np.searchsorted(rows, np.arange(j - i + 1))
                sizes[i:j], fps[i:j] = np.diff(first), fingerprints(sh, first)
                large: tuple[list, list] = ([], [])
                for r in range(j - i):
                    a, z = first[r], first[r + 1]
                    key = fps[i + r].tobytes()
                    if z > a and key not in seen:
                        seen.add(key)
                        to = small if z - a < 64 else large  # small sets take many rounds: together at the end
                        to[0].append(i + r), to[1].append(sh[a:z].copy())
                flush(*large)
            flush(*small)
            cls = [fps[r].tobytes() if sizes[r] else None for r in range(n)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], batch.column("doc_id"), pa.array(sizes), pa.array(cls, pa.binary()), pa.array(sketches, pa.binary())], names=[*keys, "doc_id", "n_shingles", "cls", "sketch"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys] + [SCAN])
    return docs.select(*keys, F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(X.tidy(run), schema)


def bands(classes: DataFrame) -> DataFrame:
    """(bucket, cls) for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            regs = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), "<u2").reshape(n, M)
            keys = np.empty((n, BANDS), X.U)
            for b in range(BANDS):
                h = np.full(n, b + 1, X.U)
                for c in range(b * ROWS, (b + 1) * ROWS):
                    h = X.mix(h * X.U(65537) + regs[:, c])
                keys[:, b] = h
            cls = batch.column("cls").take(pa.array(np.repeat(np.arange(n), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), cls], names=["bucket", "cls"])

    return classes.select("cls", "sketch").mapInArrow(X.tidy(run), "bucket long, cls binary")


def likely(pairs: DataFrame, threshold: float, slack: float = 12.0) -> DataFrame:
    """Pairs whose joint likelihood at some similarity from ``threshold`` on is within e**-slack of the best.

    ``pairs`` has a, b, na, nb, sa, sb; set sizes are known, so the likelihood
    is one of the similarity alone.  Sizes that rule the threshold out drop a
    pair exactly.
    """
    grid = np.linspace(0.0, 1.0, 201)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(n, M).astype(np.int32) for c in ("sa", "sb"))
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            above, below = (ra > rb).sum(1)[:, None], (ra < rb).sum(1)[:, None]
            u = (na / (na + nb))[:, None]
            j = np.minimum(grid, np.minimum(u / (1 - u), (1 - u) / u))
            more, less = p(np.maximum(u - (1 - u) * j, 1e-12)), p(np.maximum(1 - u - u * j, 1e-12))
            ll = above * np.log(more) + below * np.log(less) + (M - above - below) * np.log(np.maximum(1 - more - less, 1e-12))
            ok = (np.minimum(na, nb) >= threshold * np.maximum(na, nb)) & (ll[:, grid >= threshold - 1e-9].max(1) >= ll.max(1) - slack)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.mapInArrow(X.tidy(run), "a binary, b binary")


def _with_sketches(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b with sizes and sketches of both, for pairs of sizes that can be linked."""
    out = pairs
    for x in "ab":
        side = classes.select(F.col("cls").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        out = out.join(side, x)
    return out.select("a", "b", "na", "nb", "sa", "sb")


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on full shingle sets; ``texts`` has cls, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            ok = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb")):
                if a != last[0]:
                    last = a, _one_set(ta.as_py(), k)
                other = _one_set(tb.as_py(), k)
                both = len(np.intersect1d(last[1], other, assume_unique=True))
                ok.append(100 * both >= percent * (len(last[1]) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    out = pairs.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
    out = out.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a")
    return out.select("a", "b", "ta", "tb").mapInArrow(X.tidy(run), "a binary, b binary")


def blocks(opened: DataFrame) -> DataFrame:
    """Rows of open buckets dealt to groups of bounded size: bucket, grp, cls, root, seeks, offered.

    ``opened`` has bucket, cls, root, n_shingles.  A class outside the
    bucket's largest component seeks partners among all of the bucket; a pair
    of two components has such a class.  A bucket of more than ``BLOCK``
    classes or ``BLOCK_SHINGLES`` shingles falls into ``nb`` blocks by a hash
    of the class, and group (i, j) holds the seekers of block i and what block
    j offers them; two blocks of seekers meet once.
    """
    per_root = opened.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    wanted = F.ceil(F.greatest(F.sum("n") / BLOCK, F.sum("s") / BLOCK_SHINGLES))
    per = per_root.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("top"), wanted.cast("int").alias("nb"))
    rows = opened.join(per, "bucket").withColumn("seek", F.col("root") != F.col("top")).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
    every = F.sequence(F.lit(0), F.col("nb") - 1)
    seeks = F.when(F.col("seek"), F.transform(every, lambda j: F.struct(F.col("own").alias("i"), j.alias("j"))))
    offered = F.transform(F.filter(every, lambda i: ~F.col("seek") | (i <= F.col("own"))), lambda i: F.struct(i.alias("i"), F.col("own").alias("j")))
    rows = rows.withColumn("grp", F.explode(F.array_distinct(F.concat(F.coalesce(seeks, F.array().cast("array<struct<i:int,j:int>>")), offered))))
    gives = (F.col("grp.j") == F.col("own")) & (~F.col("seek") | (F.col("grp.i") <= F.col("own")))
    return rows.select("bucket", "grp", "cls", "root", (F.col("seek") & (F.col("grp.i") == F.col("own"))).alias("seeks"), gives.alias("offered"))


def across(dealt: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components inside each group of ``blocks``: enough of them to join all that full sets link.

    ``dealt`` has the columns of ``blocks`` and text.  Intersections of the
    sets are products of the group's incidence matrix of shared shingles, in
    blocks of rows and of shingles, so no pair becomes a row before it is
    known to be a link.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        g = group.num_rows
        cls, text = group.column("cls").to_pylist(), group.column("text").combine_chunks()
        order = sorted(range(g), key=cls.__getitem__)
        cls, text = [cls[i] for i in order], text.take(pa.array(order))
        roots = group.column("root").to_pylist()
        names = {r: i for i, r in enumerate(sorted(set(roots)))}
        label = np.array([names[roots[i]] for i in order])
        seek = np.flatnonzero(group.column("seeks").to_numpy()[order])
        offered = group.column("offered").to_numpy()[order]
        edges = []
        if len(seek) and offered.any():
            sets = [(i, *shingle_sets(data, offs, k)) for i, _, data, offs in X.slices(text, X.SMALL)]
            sh, who = np.concatenate([s for _, s, _ in sets]), np.concatenate([w + i for i, _, w in sets])
            size = np.bincount(who, minlength=g)
            _, col, often = np.unique(sh, return_inverse=True, return_counts=True)
            on = often[col] > 1
            col, who = np.unique(col[on], return_inverse=True)[1], who[on]
            by_col = np.argsort(col, kind="stable")
            col, who = col[by_col], who[by_col]
            width = int(col[-1]) + 1 if len(col) else 0
            rows, cols = 512, min(max(width, 1), max(64, (4 << 20) // g))
            for r in range(0, len(seek), rows):
                x = seek[r : r + rows]
                both = np.zeros((len(x), g), np.float32)
                for c in range(0, width, cols):
                    a, z = np.searchsorted(col, [c, c + cols])
                    part = np.zeros((g, cols), np.float32)
                    part[who[a:z], col[a:z] - c] = 1
                    both += part[x] @ part.T
                linked = offered & (100 * both >= percent * (size[x][:, None] + size - both))
                for i, row in zip(x.tolist(), linked):
                    near = np.flatnonzero(row & (label != label[i]))
                    for other, at in zip(*np.unique(label[near], return_index=True)):
                        edges.append((i, int(near[at])))
                        label[label == other] = label[i]
        pairs = [(min(e), max(e)) for e in edges]
        return pa.table({"a": pa.array([cls[a] for a, _ in pairs], pa.binary()), "b": pa.array([cls[b] for _, b in pairs], pa.binary())})

    return dealt.groupBy("bucket", "grp").applyInArrow(run, "a binary, b binary")


def _one_set(text: str, k: int) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return shingle_sets(raw, np.array([0, len(raw)]), k)[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node reachable."""
    edges = materialize(edges.select("a", "b").distinct(), "edges")
    size = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        edges = materialize(small.union(down.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == size:
            break
        size = now
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    ``keys`` names further columns of ``docs`` to carry along.
    """
    rows = materialize(scan(docs, k, keys), "shingles")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch"))
    classes = materialize(classes, "classes")
    keyed = materialize(bands(classes), "bands")
    hubs = keyed.groupBy("bucket").agg(F.min("cls").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "a")
    stars = keyed.withColumnRenamed("cls", "b").join(hubs, "bucket").where("a != b").select("a", "b").distinct()
    first = materialize(likely(_with_sketches(stars, classes), percent / 100), "pairs")

    def texts_of(ids: DataFrame) -> DataFrame:
        """(cls, text) of the classes of ``ids``, from the row of their representative whose set is theirs: ids can repeat."""
        ids = ids.select("cls").distinct().join(classes, "cls").select("cls", F.col("rep").alias("doc_id"))
        return materialize(_of_class(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id"), k), "texts")

    ends = first.select(F.col("a").alias("cls")).union(first.select("b"))
    links = materialize(verify(first, texts_of(ends), k, percent), "links")
    comp = materialize(components(links), "components")
    labelled = keyed.join(comp, keyed["cls"] == comp["node"], "left").select("bucket", "cls", F.coalesce("root", "cls").alias("root"))
    # buckets of several bands often hold the same classes, which are compared once
    groups = labelled.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("sum"), F.count(F.lit(1)).alias("n")).where("lo != hi")
    chosen = labelled.join(groups.groupBy("sum", "n").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket")
    opened = materialize(chosen.join(classes.select("cls", "n_shingles"), "cls"), "opened")
    if not opened.isEmpty():
        links = links.union(materialize(across(blocks(opened).join(texts_of(opened), "cls"), k, percent), "links"))
        comp = materialize(components(links), "components")
    of_class = classes.join(comp, classes["cls"] == comp["node"], "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    least = of_class.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = of_class.join(least, "root").select("cls", "component_id")
    out = rows.select(*keys, "doc_id", "n_shingles", "cls").join(labels, "cls", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(*keys, "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _of_class(texts: DataFrame, k: int) -> DataFrame:
    """One row (cls, text) per class, from rows of its representative's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            cls = batch.column("cls").to_pylist()
            for i, j, data, offs in X.slices(batch.column("text"), X.SMALL):
                sh, rows = shingle_sets(data, offs, k)
                fp = fingerprints(sh, np.searchsorted(rows, np.arange(j - i + 1)))
                ok[i:j] = [fp[r].tobytes() == cls[i + r] for r in range(j - i)]
            yield batch.select(["cls", "text"]).filter(pa.array(ok))

    return texts.select("cls", "text").mapInArrow(X.tidy(run), "cls binary, text string").dropDuplicates(["cls"])
