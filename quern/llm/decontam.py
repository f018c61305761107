"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Texts are lower-cased (A-Z only) and cut into words of letters, digits and
non-ASCII characters.  A window is ``n`` consecutive words of an item, or the
whole item if it has fewer.  Windows are looked up by a 64-bit hash and then
verified word by word, so a reported hit is exact.

The set is broadcast only up to ``max_windows`` windows; a larger benchmark is
cut into blocks of items under that bound, with one scan of the documents for
each block and the hits merged between scans.

Defined cases: null or empty text has no words and no hits; a null item text
is no item; rows that repeat are judged alike; an empty benchmark hits nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textops as X
from quern.llm.store import materialize

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MAX_WINDOWS = 2_000_000
_BITS = 1 << 20


class Index:
    """The windows of a block of items, by length and hash."""

    def __init__(self, items: list[tuple[object, str]], n: int) -> None:
        self.items: dict[bytes, list[str]] = defaultdict(list)
        lengths: dict[int, set[bytes]] = defaultdict(set)
        for item_id, text in items:
            words = WORD.findall((text or "").encode().lower())
            k = min(n, len(words))
            for i in range(len(words) - k + 1 if k else 0):
                key = b" ".join(words[i : i + k])
                lengths[k].add(key)
                self.items[key].append(str(item_id))
        self.by_length = []
        for k, keys in sorted(lengths.items()):
            ordered = sorted(keys)
            hashes = np.concatenate([self._hashes(ordered[i : i + 4096], k) for i in range(0, len(ordered), 4096)])
            at = np.argsort(hashes)
            bits = np.zeros(_BITS, bool)
            bits[(hashes & X.U(_BITS - 1)).astype(np.int64)] = True
            self.by_length.append((k, hashes[at], [ordered[i] for i in at], bits))

    @staticmethod
    def _hashes(keys: list[bytes], k: int) -> np.ndarray:
        data = np.frombuffer(b" ".join(keys), np.uint8)
        words = X.Words(data, np.array([0, len(data)]), X.ALNUM)
        return X.windows(words.hashes(), k)[::k]

    def hits(self, words: X.Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """(which words lie in an occurrence; items found by row)."""
        n, rows, h = len(words), words.rows, words.hashes()
        hit, found = np.zeros(n, bool), defaultdict(set)
        text = words.data.tobytes()
        for k, hashes, keys, bits in self.by_length:
            w = X.windows(h, k)
            at = np.flatnonzero(bits[(w & X.U(_BITS - 1)).astype(np.int64)] & X.whole(rows, k))
            w = w[at]
            lo = np.searchsorted(hashes, w)
            ok = hashes[np.minimum(lo, len(hashes) - 1)] == w
            for i, p in zip(at[ok].tolist(), lo[ok].tolist()):
                said = b" ".join(WORD.findall(text[words.starts[i] : words.ends[i + k - 1]]))
                while True:  # past other windows of the same hash
                    if keys[p] == said:
                        hit[i : i + k] = True
                        found[int(rows[i])].update(self.items[said])
                        break
                    if p + 1 < len(hashes) and hashes[p + 1] == hashes[p]:
                        p += 1
                    else:
                        break
        return hit, found


def _blocks(benchmark: DataFrame, n: int, max_windows: int) -> list[DataFrame]:
    """Items in blocks of at most about ``max_windows`` windows each."""
    items = benchmark.select(benchmark["item_id"].alias("item_id"), benchmark["text"].alias("text")).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // (2 * max_windows)))  # a word and its separator are two bytes at least
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == b) for b in range(parts)]


_OUT = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = MAX_WINDOWS, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """``docs`` with n_words, spans (first word, last word + 1, by pairs, of merged hits) and items found.

    Keeps every column of ``docs``; the three added names replace any of the
    same name.  ``then`` may go over the rows of the last scan in the same pass.
    """
    kept = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    out = docs.select(*kept, F.lit(None).cast("long").alias("n_words"), F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"))
    blocks = _blocks(benchmark, n, max_windows)
    spark = docs.sparkSession
    for b, block in enumerate(blocks):
        if b:
            out = materialize(out, "decontam")
        shared = spark.sparkContext.broadcast(Index([tuple(r) for r in block.collect()], n))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                counts, spans, items = [], [], []
                old_spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                for i, j, data, offs in X.slices(batch.column("text"), X.SMALL):
                    words = X.Words(X.LOWER[data], offs, X.ALNUM)
                    hit, found = index.hits(words)
                    counts += words.counts.tolist()
                    for r in range(j - i):
                        a, z = words.first[r], words.first[r + 1]
                        if r in found:
                            mine = np.zeros(z - a + 2, bool)
                            mine[1:-1] = hit[a:z]
                            for s, e in zip(*[iter(old_spans[i + r] or [])] * 2):
                                mine[s + 1 : e + 1] = True
                            spans.append(np.flatnonzero(mine[1:] != mine[:-1]).tolist())
                            items.append(sorted(found[r].union(old_items[i + r] or [])))
                        else:
                            spans.append(old_spans[i + r] or [])
                            items.append(old_items[i + r] or [])
                new = {"n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, _OUT.field("spans").type), "items": pa.array(items, _OUT.field("items").type)}
                yield pa.RecordBatch.from_arrays([new.get(c, batch.column(x)) for x, c in enumerate(batch.schema.names)], names=batch.schema.names)

        last = then if then and b + 1 == len(blocks) else iter
        out = out.mapInArrow(X.tidy(lambda batches, scan=scan, last=last: last(scan(batches))), out.schema)
    return out


def digest(hits: DataFrame) -> DataFrame:
    """One row per document of ``find_hits`` with counts and the digest of item ids."""
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _cutter(whole_share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts without their hit words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, counts = batch.column("text"), batch.column("spans").to_pylist(), batch.column("n_words").to_pylist()
            out, keep = [], []
            for i, sp in enumerate(spans):
                text = texts[i].as_py()
                if sp:
                    raw = text.encode()
                    words = [m.span() for m in WORD.finditer(raw.lower())]
                    parts, at, gone = [], 0, 0
                    for s, e in zip(*[iter(sp)] * 2):
                        parts.append(raw[at : words[s][0]])
                        at, gone = words[e - 1][1], gone + e - s
                    text = b"".join([*parts, raw[at:]]).decode()
                    keep.append(gone < whole_share * counts[i])
                else:
                    keep.append(True)
                out.append(text)
            cols = [pa.array(out, f.type) if f.name == "text" else batch.column(k) for k, f in enumerate(batch.schema)]
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema).filter(pa.array(keep))

    return cut


def remove_spans(hits: DataFrame, whole_share: float = 0.5) -> DataFrame:
    """Texts of ``find_hits`` without their hit words.

    A document loses each hit span, from its first word's first byte to its
    last word's last byte; one with ``whole_share`` of its words hit goes
    altogether.  Clean rows pass through unchanged.
    """
    return hits.mapInArrow(X.tidy(_cutter(whole_share)), hits.schema)


def remove_hits(docs: DataFrame, benchmark: DataFrame, whole_share: float = 0.5, **more) -> DataFrame:
    """``remove_spans(find_hits(docs, benchmark))`` without a second pass: that would keep two Python workers a task, and send each text twice."""
    return find_hits(docs, benchmark, then=_cutter(whole_share), **more)
