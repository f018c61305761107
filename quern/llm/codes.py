"""Vector codes: product quantisation with integer codebooks, fitted by Lloyd's rounds over heaps.

Components become integers (floor(1024 * x)), vectors are cut into ``PARTS``
consecutive parts, and every part has a codebook of at most ``ENTRIES``
entries.  Vectors are kept in packets of at most ``PACKET`` rows, each with a
heap per part and entry.  A heap holds the packet's parts that are assigned to
its entry, keyed by lower minus upper bound (distance to the nearest other
entry less distance to the own one, as last measured) plus the entry's
cumulative drift at that time.  A round adds to each entry's drift how far it
and the farthest other entry moved; only parts whose key no longer exceeds the
drift can have a nearer entry, so they alone are popped, compared with all
entries exactly and pushed again.  Packets report the sums of what moved, which
add up by (part, entry); the driver holds the codebooks and their totals,
whose size is fixed.  Packets are written to the shared folder after each
round; no vector is ever shuffled.

Distances are exact: integers below 2**53 in float64, beyond that int64.

Defined cases: vectors that are null, empty or hold a null or non-finite
component are dropped; so are vectors of another length than that of the least
kept vec_id (the least vector of it, if it repeats).  A length that four
doesn't divide is padded with zeros.  Integer components stop at +-2**24.
Null vec_ids come after all others, and equal ones are ordered by their
vectors; all of them get codes.  With fewer than ``ENTRIES`` vectors the
codebooks are as short.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.store import drop, materialize

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Vectors of a packet: they and their heaps are some 20 MB in a worker.
PACKET = 1 << 14
MOST = 1 << 24
#: More than the rounding error of bounds: a part this near to a tie is compared again.
SLACK = 1e-6
#: Labels whose totals are sent to every task; more are joined by a shuffle with split keys.
FEW_LABELS = 50_000
SALTS = 32

_PACKET = "ids binary, id_null binary, labels array<string>, label_null binary, vectors binary, dtype string, codes binary, heap_rows binary, heap_keys binary, heap_sizes binary, moved binary"


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there, not empty and finite throughout."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad)


def integers(flat: np.ndarray, width: int) -> np.ndarray:
    """(rows, PARTS, part width) integers of vectors laid end to end."""
    x = np.clip(np.floor(flat.astype(np.float64) * SCALE), -MOST, MOST).astype(np.int32).reshape(-1, width)
    return np.pad(x, ((0, 0), (0, -width % PARTS))).reshape(len(x), PARTS, -1)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of parts (rows, width) to entries (entries, width), as int64."""
    top = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    exact = np.float64 if 4 * top * top * max(1, book.shape[1]) < 1 << 53 else np.int64
    a, b = x.astype(exact), book.astype(exact)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, least index on ties; distance to the next other entry less that to it)."""
    code, slack = np.zeros(len(x), np.uint8), np.full(len(x), np.inf)
    for i in range(0, len(x), rows):
        d = distances(x[i : i + rows], book)
        best = d.argmin(1)
        at = np.arange(len(d))
        code[i : i + rows] = best
        if len(book) > 1:
            own = d[at, best]
            d[at, best] = np.iinfo(np.int64).max
            slack[i : i + rows] = np.sqrt(d.min(1)) - np.sqrt(own)
    return code, slack


class Heaps:
    """For one part of a packet: codes of its rows, and a heap of (key, row) for every entry."""

    def __init__(self, codes: np.ndarray, heaps: list[list[tuple[float, int]]]) -> None:
        self.codes, self.heaps = codes, heaps

    @classmethod
    def fill(cls, x: np.ndarray, book: np.ndarray, drift: np.ndarray) -> Heaps:
        """All rows compared with all entries."""
        codes, slack = nearest(x, book)
        heaps: list[list[tuple[float, int]]] = [[] for _ in book]
        for row, (code, key) in enumerate(zip(codes.tolist(), (slack + drift[codes]).tolist())):
            heaps[code].append((key, row))
        for heap in heaps:
            heapq.heapify(heap)
        return cls(codes, heaps)

    def round(self, x: np.ndarray, book: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pop, compare and push the rows whose key the drift has reached: (rows, their old codes, their new ones)."""
        popped = []
        for heap, limit in zip(self.heaps, (drift + SLACK).tolist()):
            while heap and heap[0][0] <= limit:
                popped.append(heapq.heappop(heap)[1])
        rows = np.array(popped, np.int64)
        old = self.codes[rows]
        new, slack = nearest(x[rows], book)
        self.codes[rows] = new
        for row, code, key in zip(popped, new.tolist(), (slack + drift[new]).tolist()):
            heapq.heappush(self.heaps[code], (key, row))
        return rows, old, new


def moves(x: np.ndarray, rows: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> np.ndarray:
    """(entries, 1 + width): how counts and sums change when rows go from old entries to new ones."""
    if old is not None:
        on = old != new
        rows, old, new = rows[on], old[on], new[on]
    full = np.concatenate([np.ones((len(rows), 1), np.int64), x[rows].astype(np.int64)], 1)
    out = np.zeros((entries, full.shape[1]), np.int64)
    np.add.at(out, new, full)
    if old is not None:
        np.subtract.at(out, old, full)
    return out


def packets(rows: DataFrame, width: int, vector: str, label: str) -> DataFrame:
    """Packets of the rows, without codes and heaps."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PACKET):
                part = batch.slice(i, PACKET)
                ids, labels = part.column(0), part.column(1)
                x = integers(part.column(2).flatten().to_numpy(zero_copy_only=False), width)
                if max(x.max(initial=0), -x.min(initial=0)) < 1 << 15:
                    x = x.astype(np.int16)
                null = lambda c: np.asarray(c.is_null().to_numpy(zero_copy_only=False), bool).tobytes()
                yield pa.RecordBatch.from_pylist([{"ids": ids.fill_null(0).to_numpy().tobytes(), "id_null": null(ids), "labels": labels.fill_null("").to_pylist(), "label_null": null(labels), "vectors": x.tobytes(), "dtype": x.dtype.str}])

    chosen = rows.select(F.col("vec_id").cast("long"), F.col(label).cast("string"), F.col(vector)).where(F.size(vector) == width)
    return chosen.mapInArrow(pack, "ids binary, id_null binary, labels array<string>, label_null binary, vectors binary, dtype string")


def _vectors(row: dict, padded: int) -> np.ndarray:
    return np.frombuffer(row["vectors"], np.dtype(row["dtype"])).reshape(-1, PARTS, padded // PARTS)


def _read(row: dict) -> list[Heaps]:
    n = len(row["ids"]) // 8
    codes = np.frombuffer(row["codes"], np.uint8).reshape(PARTS, n).copy()
    rows, keys = np.frombuffer(row["heap_rows"], np.int32).reshape(PARTS, n), np.frombuffer(row["heap_keys"]).reshape(PARTS, n)
    ends = np.cumsum(np.frombuffer(row["heap_sizes"], np.int32).reshape(PARTS, -1), 1)
    out = []
    for p in range(PARTS):
        pairs = list(zip(keys[p].tolist(), rows[p].tolist()))
        out.append(Heaps(codes[p], [pairs[a:z] for a, z in zip([0, *ends[p, :-1]], ends[p])]))
    return out


def _write(heaps: list[Heaps]) -> dict:
    flat = [[pair for heap in h.heaps for pair in heap] for h in heaps]
    return {
        "codes": np.concatenate([h.codes for h in heaps]).tobytes(),
        "heap_rows": np.array([[r for _, r in f] for f in flat], np.int32).tobytes(),
        "heap_keys": np.array([[k for k, _ in f] for f in flat], np.float64).tobytes(),
        "heap_sizes": np.array([[len(x) for x in h.heaps] for h in heaps], np.int32).tobytes(),
    }


def assign(state: DataFrame, books: np.ndarray, drift: np.ndarray, first: bool) -> DataFrame:
    """Packets with every part at its nearest entry, and ``moved``, the change of counts and sums."""
    padded, entries = books.shape[2] * PARTS, books.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                x = _vectors(row, padded)
                if first:
                    heaps = [Heaps.fill(x[:, p], books[p], drift[p]) for p in range(PARTS)]
                    change = [moves(x[:, p], np.arange(len(x)), None, heaps[p].codes, entries) for p in range(PARTS)]
                else:
                    heaps = _read(row)
                    change = [moves(x[:, p], *heaps[p].round(x[:, p], books[p], drift[p]), entries) for p in range(PARTS)]
                yield pa.RecordBatch.from_pylist([row | _write(heaps) | {"moved": np.stack(change).tobytes()}], schema=_SCHEMA)

    return state.mapInArrow(run, _PACKET)


_SCHEMA = pa.schema(
    [
        *((c, pa.binary()) for c in ("ids", "id_null")), ("labels", pa.list_(pa.string())), ("label_null", pa.binary()), ("vectors", pa.binary()), ("dtype", pa.string()),
        *((c, pa.binary()) for c in ("codes", "heap_rows", "heap_keys", "heap_sizes", "moved")),
    ]
)


def change_of(state: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """The packets' ``moved`` added up, inside tasks and then by (part, entry): (PARTS, entries, 1 + width)."""
    parts, entries, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, 1 + width), np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), np.int64).reshape(total.shape)
        on = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64()), *[pa.array(total[on, c]) for c in range(1 + width)]], names=["at", *[f"s{c}" for c in range(1 + width)]])

    sums = [f"s{c}" for c in range(1 + width)]
    rows = state.select("moved").mapInArrow(run, ", ".join(["at long", *[f"{c} long" for c in sums]]))
    out = np.zeros((parts * entries, 1 + width), np.int64)
    for row in rows.groupBy("at").agg(*[F.sum(c).alias(c) for c in sums]).collect():  # at most PARTS * ENTRIES rows
        out[row[0]] = row[1:]
    return out.reshape(parts, entries, 1 + width)


def fit(rows: DataFrame, vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray, int] | None:
    """(packets with final codes, codebooks, components of a vector), or None without vectors."""
    rows = usable(rows, vector)
    first = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v"), F.size(vector).alias("size")).orderBy(F.asc_nulls_last("vec_id"), "v").limit(1).collect()
    if not first:
        return None
    width = first[0]["size"]
    start = rows.where(F.size(vector) == width).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v")).orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).collect()
    books = integers(np.array([r["v"] for r in start], np.float64).reshape(-1), width).transpose(1, 0, 2).astype(np.int64)
    drift = np.zeros(books.shape[:2])
    totals = np.zeros((PARTS, books.shape[1], 1 + books.shape[2]), np.int64)
    state = packets(rows, width, vector, label)
    for k in range(ROUNDS + 1):
        before, state = state, materialize(assign(state, books, drift, first=k == 0), "codes")
        if k:
            drop(before)
        if k == ROUNDS:
            break
        totals += change_of(state, books.shape)
        count = totals[:, :, :1]
        moved = np.where(count > 0, totals[:, :, 1:] // np.maximum(count, 1), books)
        step = np.sqrt(((moved - books).astype(np.float64) ** 2).sum(2))
        for p in range(PARTS):
            # a part's own entry moved by step, and the others by as much as the farthest of them
            others = np.array([np.delete(step[p], e).max(initial=0) for e in range(step.shape[1])])
            drift[p] += (step[p] + others) * (1 + 1e-12)
        books = moved
    return state, books, width


def codes_of(state: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every vector in the packets."""
    padded = books.shape[2] * PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                x = _vectors(row, padded).astype(np.int64)
                codes = np.frombuffer(row["codes"], np.uint8).reshape(PARTS, len(x))
                error = sum(((x[:, p] - books[p][codes[p]]) ** 2).sum(1) for p in range(PARTS))
                text = codes.T.copy().tobytes().hex()
                ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["id_null"], bool))
                labels = pa.array([None if null else x for x, null in zip(row["labels"], np.frombuffer(row["label_null"], bool).tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return state.mapInArrow(run, "vec_id long, label string, code string, error long")


def digest_of(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the errors added up over equal labels; a label of a third of all rows is no hot key."""
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    totals = materialize(totals.select(F.col("label").alias("of"), "label_error"), "labels")
    if totals.count() <= FEW_LABELS:
        return coded.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    totals = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("part", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(totals, F.col("label").eqNullSafe(F.col("of")) & (F.col("part") == F.col("salt"))).drop("of", "salt", "part")


def compress(rows: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every usable vector."""
    found = fit(rows, vector, label)
    if found is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, label string, code string, error long, label_error long, codebooks_sha256 string")
    state, books, _ = found
    coded = materialize(codes_of(state, books), "coded")
    drop(state)
    return with_label_error(coded).withColumn("codebooks_sha256", F.lit(digest_of(books)))
