"""Repeated passages by recompression of the token streams.

Words are named by hash.  Each round renames maximal runs of one symbol, then
pairs of neighbours whose coins (a bit of the symbol's name) are 0 and 1.
Names are hashes of what they replace, so all tasks give the same run or pair
the same name without exchanging dictionaries, and equal substrings have equal
symbols except near their ends.  With each symbol goes the span of words that
fixed its borders; where that span lies in ``CONTEXT`` words around the
symbol, the symbol with that context is the same in every copy.

A window of ``size`` words is represented by the least such symbol (by hash)
in it, so windows with equal words choose equal symbols at equal offsets.

1. Symbols: every task sends the distinct symbols of its documents to their
   bucket once per home (a block of documents); a bucket tells each home which
   of its symbols occur elsewhere.  Symbols met twice in one task are known to
   be shared and go to their homes directly.
2. Windows under shared symbols are verified on all their words: each home
   sends the hash of each such window (once, with its first place) to a
   bucket, which tells the homes whose first place isn't the first of all.
3. Homes remove the words of windows that also start earlier.

A home or bucket is a bounded block: their numbers follow the input's size.
A passage in a third of all documents makes one row per task or home and
bucket, not one per document.  Places are ordered by (doc_id, start); rows
with equal ids count as one document at equal starts.

Defined cases: null, empty and short texts lose nothing; an empty table gives
no rows; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textops as X
from quern.llm.store import materialize, text_bytes

SIZE = 20
ROUNDS = 2
BEFORE, AFTER = 5, 7  # CONTEXT: words before a symbol's first word, and from it on
HOME_BYTES = 6 << 20
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_NONE = X.U(0xFFFFFFFFFFFFFFFF)
_COIN = X.U(0x8EBC6AF09C88C6E3)
PACKET = "place int, keys binary, homes binary, docs binary, starts binary"


def _compress(names: np.ndarray, rows: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """One round: runs, then pairs.  ``at``: first word; ``lo``, ``hi``: the words that fix the symbol."""
    far = np.int64(1) << 40
    n = len(names)
    new = np.ones(n, bool)
    new[1:] = (names[1:] != names[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    runs = last - first + 1
    names = np.where(runs > 1, X.mix(names[first] * X._Q + runs.astype(X.U)), names[first])
    left, right = np.full(len(first), -far), np.full(len(first), far)
    inner = rows[first[1:]] == rows[last[:-1]]
    left[1:][inner], right[:-1][inner] = lo[last[:-1]][inner], hi[first[1:]][inner]
    rows, at, lo, hi = rows[first], at[first], np.minimum(left, lo[first]), np.maximum(right, hi[last])
    n = len(names)
    coin = (X.mix(names ^ _COIN) & X.U(1)).astype(bool)
    joins = np.zeros(n, bool)
    same = rows[1:] == rows[:-1]
    joins[:-1] = ~coin[:-1] & coin[1:] & same
    second = np.zeros(n, bool)
    second[1:] = joins[:-1]
    keep = np.flatnonzero(~second)
    pair = joins[keep]
    nxt = np.minimum(keep + 1, n - 1)
    prv = np.maximum(keep - 1, 0)
    out = np.where(pair, X.mix(names[keep] * X._Q + X.mix(names[nxt] + X._P)), names[keep])
    open_left, open_right = coin[keep], ~coin[keep] & ~pair
    has_left, has_right = (keep > 0) & (rows[prv] == rows[keep]), (nxt > keep) & (rows[nxt] == rows[keep])
    nlo = np.where(open_left, np.where(has_left, np.minimum(lo[prv], lo[keep]), -far), lo[keep])
    nhi = np.where(pair, np.maximum(hi[nxt], hi[keep]), np.where(open_right, np.where(has_right, np.maximum(hi[nxt], hi[keep]), far), hi[keep]))
    nlo = np.where(pair, np.minimum(nlo, lo[nxt]), nlo)
    return out, rows[keep], at[keep], nlo, nhi


def window_symbols(h: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts of all windows, the hash of each, key and place of the symbol that represents it)."""
    n = len(h)
    ok = np.flatnonzero(X.whole(rows, size))
    full = X.windows(h, size)
    if not len(ok):
        return ok, full[:0], full[:0], ok
    at = np.arange(n)
    names, srows, pos, lo, hi = h, rows, at, at, at
    for _ in range(ROUNDS):
        names, srows, pos, lo, hi = _compress(names, srows, pos, lo, hi)
    fixed = (lo >= pos - BEFORE) & (hi < pos + AFTER) & (pos >= BEFORE) & (pos + AFTER <= n)
    pos, names = pos[fixed], names[fixed]
    keys = np.full(n + size, _NONE, X.U)
    context = X.windows(h, BEFORE + AFTER)
    keys[pos] = X.mix(names + context[pos - BEFORE])
    reach = size - BEFORE - AFTER + 1
    m = n - size + 1
    best, where = keys[BEFORE : BEFORE + m].copy(), np.zeros(m, np.int8)
    for j in range(1, reach):
        less = keys[BEFORE + j : BEFORE + j + m] < best
        np.minimum(best, keys[BEFORE + j : BEFORE + j + m], out=best)
        where[less] = j
    best, full = best[ok], full[ok]
    none = best == _NONE  # a window without a fixed symbol stands for itself
    return ok, full, np.where(none, X.mix(full + _COIN), best), np.where(none, -1 - ok, ok + where[ok])


def _packets(place: np.ndarray, keys: np.ndarray, homes: np.ndarray, docs: np.ndarray | None = None, starts: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of PACKET: the entries of each place as packed arrays."""
    order = np.lexsort((keys, place))
    place = place[order]
    cut = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(place))

    def packed(x: np.ndarray | None, kind: str) -> pa.Array:
        x = None if x is None else x[order].astype(kind)
        return pa.array([b"" if x is None else x[a:z].tobytes() for a, z in zip(cut, ends)], pa.binary())

    cols = [pa.array(place[cut].astype(np.int32)), packed(keys, "<u8"), packed(homes, "<i4"), packed(docs, "<i8"), packed(starts, "<i4")]
    return pa.RecordBatch.from_arrays(cols, names=["place", "keys", "homes", "docs", "starts"])


def _column(group: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(group.column(name).to_pylist()), kind)


def _unique(*cols: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return [c[new] for c in cols]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> X.U(32)) * X.U(buckets) >> X.U(32)).astype(np.int32)


def _symbols(docs: DataFrame, size: int, buckets: int) -> DataFrame:
    """Packets to buckets (place >= 0) and, of symbols known to be shared, to homes (place < 0: -1 - home)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, parts = batch.column("home").to_numpy(), []
            for i, j, data, offs in X.slices(batch.column("text")):
                words = X.Words(data, offs)
                rows = words.rows
                at, _, key, place = window_symbols(words.hashes(), rows, size)
                if len(at):
                    r, fresh = rows[at], np.append(True, place[1:] != place[:-1])  # windows with one symbol: one occurrence
                    parts.append((key[fresh], home[i + r[fresh]]))
            if not parts:
                continue
            key, where = (np.concatenate([p[x] for p in parts]) for x in (0, 1))
            order = np.argsort(key, kind="stable")
            key, where = key[order], where[order]
            new = np.append(True, key[1:] != key[:-1])
            count = np.diff(np.append(np.flatnonzero(new), len(key)))
            many = np.repeat(count > 1, count)
            yield _packets(_bucket(key[~many], buckets), key[~many], where[~many])
            mk, mh = _unique(key[many], where[many])
            if len(mk):
                yield _packets(-1 - mh, mk, mh)
                told = np.unique(mk)
                yield _packets(_bucket(told, buckets), told, np.full(len(told), -1))

    return docs.select("text", "home").mapInArrow(run, PACKET)


def _shared(key: tuple, group: pa.Table) -> pa.Table:
    """Of a bucket's symbols, those with two occurrences or more, to the homes that have them."""
    keys, homes = _column(group, "keys", "<u8"), _column(group, "homes", "<i4")
    order = np.argsort(keys, kind="stable")
    keys, homes = keys[order], homes[order]
    same = keys[1:] == keys[:-1]
    many = np.append(same, False) | np.append(False, same)
    if len(keys):
        many |= np.isin(keys, keys[homes < 0])
    many &= homes >= 0
    k, h = _unique(keys[many], homes[many])
    return pa.Table.from_batches([_packets(-1 - h, k, h)])


def _home_windows(docs: pa.Table, shared: np.ndarray, size: int) -> Iterator[tuple]:
    """For slices of a home's rows in (doc_id) order: rows, words, starts and hashes of windows under shared symbols."""
    for i, j, data, offs in X.slices(docs.column("text")):
        words = X.Words(data, offs)
        at, full, key, _ = window_symbols(words.hashes(), words.rows, size)
        if len(at) and len(shared):
            p = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
            under = shared[p] == key
            at, full = at[under], full[under]
        else:
            at, full = at[:0], full[:0]
        yield i, j, data, words, at, full


def _ordered(group: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A home's rows by doc_id, and the ids (a null id: the least number)."""
    ids = group.column("doc_id").fill_null(-(2**63)).to_numpy()
    order = np.argsort(ids, kind="stable")
    return group.take(pa.array(order)), ids[order]


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for every row of ``docs`` (doc_id, text)."""
    total = text_bytes(docs)
    n_homes = max(64, -(-total // HOME_BYTES))
    buckets = max(32, -(-total // HOME_BYTES))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("home", F.pmod(F.xxhash64("doc_id"), F.lit(n_homes)).cast("int"))
    found = materialize(_symbols(docs, size, buckets), "symbols")
    told = found.where("place >= 0").groupBy("place").applyInArrow(_shared, PACKET)
    shared = materialize(found.where("place < 0").union(told).select((-1 - F.col("place")).alias("home"), "keys"), "shared")

    def windows_of(key: tuple, rows: pa.Table, keys: pa.Table) -> pa.Table:
        shared = np.unique(_column(keys, "keys", "<u8"))
        rows, ids = _ordered(rows)
        parts = []
        for i, _, _, words, at, full in _home_windows(rows, shared, size):
            r = words.rows[at]
            parts.append((full, ids[i + r], at - words.first[r]))
        if not parts or not sum(len(p[0]) for p in parts):
            return pa.Table.from_batches([_packets(*[np.zeros(0, t) for t in (np.int32, X.U, np.int32, np.int64, np.int64)])])
        full, doc, start = (np.concatenate([p[x] for p in parts]) for x in range(3))
        _, first = np.unique(full, return_index=True)  # rows are in order of id and start
        full, doc, start = full[first], doc[first], start[first]
        home = np.full(len(full), key[0].as_py())
        return pa.Table.from_batches([_packets(_bucket(full, buckets), full, home, doc, start)])

    by_home = docs.select("home", "doc_id", "text").groupBy("home")
    windows = materialize(by_home.cogroup(shared.groupBy("home")).applyInArrow(windows_of, PACKET), "windows")

    def later(key: tuple, group: pa.Table) -> pa.Table:
        full, home, doc, start = (_column(group, c, t) for c, t in (("keys", "<u8"), ("homes", "<i4"), ("docs", "<i8"), ("starts", "<i4")))
        order = np.lexsort((start, doc, full))
        full, home, doc, start = full[order], home[order], doc[order], start[order]
        new = np.append(True, full[1:] != full[:-1])[: len(full)]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(full)), 0))
        late = (doc != doc[lead]) | (start != start[lead])
        return pa.Table.from_batches([_packets(home[late], full[late], home[late])])

    late = windows.groupBy("place").applyInArrow(later, PACKET).select(F.col("place").alias("home"), "keys")
    both = materialize(shared.select("home", "keys", F.lit(0).alias("kind")).union(late.select("home", "keys", F.lit(1).alias("kind"))), "late")

    def cut(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        kinds, packed = told.column("kind").to_pylist(), told.column("keys").to_pylist()
        shared, late = (np.unique(np.frombuffer(b"".join(p for p, k in zip(packed, kinds) if k == x), "<u8")) for x in (0, 1))
        rows, ids = _ordered(rows)
        slices = [(i, j, data, words, at, full) for i, j, data, words, at, full in _home_windows(rows, shared, size)]
        full = np.concatenate([s[5] for s in slices]) if slices else np.zeros(0, X.U)
        doc = np.concatenate([ids[s[0] + s[3].rows[s[4]]] for s in slices]) if slices else np.zeros(0, np.int64)
        start = np.concatenate([s[4] - s[3].first[s[3].rows[s[4]]] for s in slices]) if slices else doc
        _, first, back = np.unique(full, return_index=True, return_inverse=True)
        gone = (doc != doc[first][back]) | (start != start[first][back]) | np.isin(full, late)
        n_words, n_removed, texts, p = [], [], [], 0
        for i, j, data, words, at, _ in slices:
            flags = np.zeros(len(words), bool)
            flags[at[gone[p : p + len(at)]]] = True
            p += len(at)
            lost = X.cover(flags, size, len(words))
            removed = X.row_sums(lost, words.first)
            raw = data.tobytes()
            for r in range(j - i):
                a, z = words.first[r], words.first[r + 1]
                n_words.append(int(z - a)), n_removed.append(int(removed[r]))
                said = WORD.findall(raw[words.offs[r] : words.offs[r + 1]])
                if removed[r]:
                    said = [said[k] for k in np.flatnonzero(~lost[a:z])]
                texts.append(b" ".join(said).decode())
        return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(texts, pa.string())})

    return by_home.cogroup(both.groupBy("home")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
