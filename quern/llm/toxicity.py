"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their five- and four-byte stems, hashed.  The machine
scores the set of a text's terms as w0 + sum(w) + sum over pairs of <v, v'>,
so a pair (an insult and a group mention, say) can count for more than its
parts.  It is trained by AdaGrad in numpy on the driver, on a bounded sample
of labelled rows: ``SAMPLE`` rows of each class, by a hash of doc_id.  Every
hashed term of the sample has a weight and factors, shrunk by how little its
chi-square is above ``CHANCE``; the intercept is corrected for the share of each class among all labelled rows.

Defined cases: null and empty texts get the intercept's score; without
labelled rows of both classes every score is the smoothed share of class 1;
repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textops as X
from quern.llm.store import doc_hash

BITS = 20
FACTORS = 8
CHANCE = 300.0
SAMPLE = 3000
EPOCHS = 12
THRESHOLD = 0.3
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_LETTER[0x27] = True


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed terms, their rows), with repeats."""
    words = X.Words(X.LOWER[data], offs, _LETTER)
    sums = X.byte_sums(words.data)
    rows, out = words.rows, []
    for stem in (0, 5, 4):
        on = np.flatnonzero(words.ends - words.starts >= stem)
        ends = words.starts[on] + stem if stem else words.ends
        h = X.span_hashes(sums, words.starts[on], ends) + X.U(stem)
        out.append(((X.mix(h) >> X.U(64 - BITS)).astype(np.int64), rows[on]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


class Machine:
    """slot: the place of each hash among the sample's terms, 0 for none; weights of places from 1 on."""

    def __init__(self, texts: list[str], y: np.ndarray, prior: float) -> None:
        self.slot = np.zeros(1 << BITS, np.int32)
        n = len(texts)
        self.w0 = float(np.log(prior / (1 - prior)))
        self.w, self.v = np.zeros(1), np.zeros((1, FACTORS))
        if not n or y.min() == y.max():
            return
        pairs = []
        for i, _, data, offs in X.slices(pa.array(texts, pa.string())):
            t, r = terms(data, offs)
            pairs.append(np.unique((r + i) << BITS | t))
        pairs = np.concatenate(pairs)
        rows, t = pairs >> BITS, pairs & ((1 << BITS) - 1)
        own = np.unique(t)
        self.slot[own] = np.arange(1, len(own) + 1)
        self.w, self.v = np.zeros(len(own) + 1), np.zeros((len(own) + 1, FACTORS))
        # a signed chi-square of each term's presence against the class: terms count by how far it is above chance
        share = [np.bincount(self.slot[t[y[rows] == c]], minlength=len(own) + 1) / max(1, (y == c).sum()) for c in (0, 1)]
        gain = n * (share[1] - share[0]) ** 2 / (share[1] + share[0] + 4.0 / n)
        size = (gain / (gain + CHANCE))[:, None]
        self._fit(rows, self.slot[t].astype(np.int64), size[:, 0], y, n)
        self.w, self.v = (self.w * size[:, 0]).astype(np.float32), (self.v * size).astype(np.float32)
        self.w0 += float(np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean())))

    def _fit(self, rows: np.ndarray, slots: np.ndarray, size: np.ndarray, y: np.ndarray, n: int) -> None:
        rng = np.random.Generator(np.random.PCG64(7))
        first = np.searchsorted(rows, np.arange(n + 1))
        self.v = rng.normal(0, 0.01, self.v.shape)
        self.v[0] = 0
        b, w, v = 0.0, self.w, self.v
        gb, gw, gv = 1e-6, np.full(w.shape, 1e-6), np.full(v.shape, 1e-6)
        for epoch in range(EPOCHS):
            order = rng.permutation(n)
            for at in range(0, n, 64):
                docs = order[at : at + 64]
                own = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
                local = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
                s = slots[own]
                x, xv = size[s], v[s] * size[s, None]
                lin = np.bincount(local, w[s] * x, len(docs))
                vs = np.stack([np.bincount(local, k, len(docs)) for k in xv.T], 1)
                sq = np.bincount(local, (xv**2).sum(1), len(docs))
                z = b + lin + 0.5 * ((vs**2).sum(1) - sq)
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[docs]) / len(docs)
                gb += g.sum() ** 2
                b -= 0.1 * g.sum() / np.sqrt(gb)
                on, back = np.unique(s, return_inverse=True)
                dw, dv = np.bincount(back, g[local] * x, len(on)), (g[local] * x)[:, None] * (vs[local] - xv)
                dv = np.stack([np.bincount(back, k, len(on)) for k in dv.T], 1)
                dw, dv = dw + 1e-5 * w[on], dv + 1e-5 * v[on]
                gw[on] += dw**2
                gv[on] += dv**2
                w[on] -= 0.1 * dw / np.sqrt(gw[on])
                v[on] -= 0.02 * dv / np.sqrt(gv[on])
        self.w0 = b

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        t, r = terms(data, offs)
        s = self.slot[t].astype(np.int64)
        on = s > 0
        key = np.unique(r[on] * len(self.w) + s[on])
        r, s = key // len(self.w), key % len(self.w)
        z = self.w0 + np.bincount(r, self.w[s], n)
        for f in range(FACTORS):
            x = self.v[s, f]
            z += 0.5 * (np.bincount(r, x, n) ** 2 - np.bincount(r, x * x, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> tuple[list[tuple[str, int]], float]:
    """At most ``sample`` labelled texts of each class, by hash of doc_id, and class 1's smoothed share.

    Repeated labels of a document count once, as the largest; labels other than 0 and 1 are left out.
    """
    y = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("y")).where("y in (0, 1)")
    y = y.where(doc_hash(4) != 2).groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    counts = dict(y.groupBy("y").count().collect())
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).where("text is not null")
    rows: list[tuple[str, int]] = []
    for c in (0, 1):
        ids = y.where(F.col("y") == c).orderBy("h", "doc_id").limit(sample).select("doc_id", "h").collect()
        if ids:
            chosen = docs.sparkSession.createDataFrame([(r[0],) for r in ids], "doc_id long")
            rows += [(r[1], c) for r in sorted(texts.join(F.broadcast(chosen), "doc_id").limit(2 * sample).collect(), key=lambda r: (r[0], r[1]))]
    return rows, (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    rows, prior = labelled(docs, labels, sample=sample)
    machine = Machine([r[0] for r in rows], np.array([r[1] for r in rows]), prior)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # bounded: 2**BITS slots, and weights of at most as many terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.score(data, offs) for _, _, data, offs in X.slices(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.concatenate(parts) if parts else [], pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (doc_hash(4) == 2).alias("held_out"), "text")
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
