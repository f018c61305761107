"""Language identification by averaged hashed subword embeddings.

Byte n-grams of words with their borders are hashed to embeddings; a text is
the average of its n-grams' embeddings and a linear softmax gives the
language.  Both are trained by stochastic gradient descent in numpy on the
driver, on a bounded sample: ``SAMPLE`` labelled rows of each language by a
hash of doc_id, as whole texts and as short pieces of them.  A fifth of the
sample is set aside to calibrate a temperature and, from it, the probability
under which a prediction is rejected (``REJECT`` of that part's right answers).

Since averaging and the linear layer commute, scoring needs one table of
(n-gram, language) and sums of it.

Defined cases: null text and text without a letter are ``und`` with score 0;
without any labelled row every text is ``und``; ties go to the first language
by name; repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import textops as X
from quern.llm.store import doc_hash

BITS = 16
DIM = 16
ORDERS = (2, 3, 4)
SAMPLE = 600
EPOCHS = 4
REJECT = 0.01
_FOLD = X.LOWER.copy()
_FOLD[:65] = _FOLD[91:97] = _FOLD[123:128] = 32  # all but letters and non-ASCII bytes: a border


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams inside or at the border of words, their rows' offsets), by row."""
    n = len(offs) - 1
    size = len(data) + n + 1  # a border before each row and at the end
    padded = np.full(size, 32, np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offs))
    padded[at] = _FOLD[data]
    starts = offs[:-1] + np.arange(n)
    p = padded.astype(np.uint32)
    space = padded == 32
    idx, where = [], []
    for k in ORDERS:
        m = size - k + 1
        if m <= 0:
            continue
        h = p[:m].copy()
        ok = ~(space[:m] & space[1 : m + 1])
        for j in range(1, k):
            h = h * np.uint32(0x01000193) + p[j : j + m]
            if j < k - 1:
                ok &= ~space[j : j + m]
        h = (h * np.uint32(0x9E3779B1)) ^ np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)
        on = np.flatnonzero(ok)
        idx.append((h[on] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS))
        where.append(on)
    idx, where = np.concatenate(idx or [np.zeros(0, np.uint32)]), np.concatenate(where or [np.zeros(0, int)])
    return idx.astype(np.int64), np.searchsorted(starts, where, "right") - 1


def letters(texts: pa.Array, data: np.ndarray, offs: np.ndarray, first: int) -> np.ndarray:
    """Which rows hold a letter; only rows without an ASCII letter are looked at one by one."""
    low = X.LOWER[data]
    ascii_letter = X.row_sums((low >= 97) & (low <= 122), offs) > 0
    for r in np.flatnonzero(~ascii_letter & (np.diff(offs) > 0)):
        ascii_letter[r] = any(c.isalpha() for c in texts[first + int(r)].as_py())
    return ascii_letter


class Model:
    def __init__(self, texts: list[str], langs: list[str]) -> None:
        self.langs = sorted(set(langs))
        self.table = np.zeros((1 << BITS, max(1, len(self.langs))), np.float32)
        self.bias, self.heat, self.least = np.zeros(max(1, len(self.langs))), 1.0, 0.0
        if not self.langs:
            return
        rng = np.random.Generator(np.random.PCG64(11))
        y = np.searchsorted(self.langs, langs)
        part = np.arange(len(texts)) % 5 == 4
        pieces, of = [], []
        for i, text in enumerate(texts):
            words = text.split()
            pieces.append(text), of.append(i)
            for n in (1, 3, 8, 20):
                a = int(rng.integers(0, max(1, len(words) - n + 1)))
                pieces.append(" ".join(words[a : a + n])), of.append(i)
        of = np.array(of)
        bags = []
        for i, j, data, offs in X.slices(pa.array(pieces, pa.string())):
            idx, rows = grams(data, offs)
            key, count = np.unique(rows << BITS | idx, return_counts=True)
            first = np.searchsorted(key >> BITS, np.arange(j - i + 1))
            bags += [(key[a:z] & ((1 << BITS) - 1), count[a:z] / max(1, count[a:z].sum())) for a, z in zip(first[:-1], first[1:])]
        train = [k for k in range(len(pieces)) if not part[of[k]]]
        n, c = len(bags), len(self.langs)
        emb, out, bias = rng.normal(0, 0.1, (1 << BITS, DIM)), np.zeros((DIM, c)), np.zeros(c)
        out = rng.normal(0, 0.1, (DIM, c))
        steps, done = EPOCHS * -(-len(train) // 32), 0
        for _ in range(EPOCHS):
            order = rng.permutation(train)
            for at in range(0, len(order), 32):
                chosen = order[at : at + 32]
                idx = np.concatenate([bags[k][0] for k in chosen])
                val = np.concatenate([bags[k][1] for k in chosen])
                row = np.repeat(np.arange(len(chosen)), [len(bags[k][0]) for k in chosen])
                mean = np.stack([np.bincount(row, emb[idx, d] * val, len(chosen)) for d in range(DIM)], 1)
                p = self._softmax(mean @ out + bias)
                p[np.arange(len(chosen)), y[of[chosen]]] -= 1
                rate = 4.0 * (1 - done / steps)
                back = p @ out.T
                out -= rate * mean.T @ p / len(chosen)
                bias -= rate * p.mean(0)
                step = -rate * val[:, None] * back[row]
                slots, inv = np.unique(idx, return_inverse=True)
                emb[slots] += np.stack([np.bincount(inv, step[:, d], len(slots)) for d in range(DIM)], 1)
                done += 1
        self.table, self.bias = (emb @ out).astype(np.float32), bias
        held = [k for k in range(n) if part[of[k]]]
        if held:
            z = np.stack([self.table[bags[k][0]].T @ bags[k][1] + bias for k in held])
            right = y[of[held]]
            heats = np.exp(np.linspace(-2, 2, 41))
            self.heat = float(heats[np.argmin([-np.log(self._softmax(z / t)[np.arange(len(held)), right] + 1e-12).mean() for t in heats])])
            p = self._softmax(z / self.heat)
            good = p.max(1)[p.argmax(1) == right]
            self.least = float(np.quantile(good, REJECT)) if len(good) else 0.0

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def probabilities(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        idx, rows = grams(data, offs)
        size = np.maximum(np.bincount(rows, minlength=n), 1)
        z = np.stack([np.bincount(rows, self.table[idx, c], n) / size for c in range(len(self.langs))], 1) + self.bias
        return self._softmax(z / self.heat)


def training_rows(docs: DataFrame, sample: int) -> list[tuple[str, str]]:
    """At most ``sample`` (text, lang) of each language, by hash of doc_id, without held-out rows."""
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"]).where(F.col("lang").isNotNull() & docs["text"].isNotNull() & (doc_hash(4) != 2))
    ids = ids.withColumn("h", F.xxhash64("doc_id"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = ids.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample).select("doc_id", "lang").distinct().collect()
    if not chosen:
        return []
    chosen = docs.sparkSession.createDataFrame(chosen, "doc_id long, lang string")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"], docs["text"]).where("text is not null")
    # ids may repeat any number of times: one text of each
    rows = texts.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text")).collect()
    return [(r[2], r[1]) for r in sorted(rows, key=lambda r: (r[0] or 0, r[1], r[2]))]


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row."""
    rows = training_rows(docs, sample)
    model = Model([r[0] for r in rows], [r[1] for r in rows])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2**BITS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            langs, scores = [], []
            texts = batch.column("text")
            for i, j, data, offs in X.slices(texts):
                known = letters(texts, data, offs, i) & bool(m.langs)
                p = m.probabilities(data, offs) if m.langs else np.zeros((j - i, 1))
                langs += [m.langs[k] if ok else "und" for k, ok in zip(p.argmax(1).tolist(), known.tolist())]
                scores.append(np.where(known, p.max(1), 0.0))
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(score), pa.array(score < m.least)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (doc_hash(4) == 2).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
