"""Language-model scoring by a hashed maximum-entropy model with class-factored softmax.

Counts.  Word counts of all training rows: every task sends the distinct words
of its batches with counts to buckets by hash, which add them up.  The words
with at least ``t`` occurrences are the vocabulary, ``t`` the least count that
leaves at most ``room(N)`` words; the others form the rare class and never
leave their buckets.

Model.  P(word | history) = P(class | history) * P(member | class, history) *
P(word | member).  Classes are found by k-means on which of the ``NEAR``
commonest words stand next to a word, counted over all training rows; each
word has one.  A class has ``CLASSES`` members: its commonest words by
themselves, and its other words together.  Both softmaxes sum weight rows of
the active features: bias, the previous word, the word before it (skip), their
pair, and the pair of their classes; the second crosses each with the target's
class.  Rows are hashed, and their number, like the vocabulary's, follows the
square root of the training tokens up to ``MOST``, since all tasks hold them.
P(word | member) and P(word | rare) are the optimum of one indicator per word:
its smoothed share.

Training.  The weights start from the features' own counts with each class.
Then come ``ROUNDS`` distributed gradient updates, each on the texts of one
residue of a hash of doc_id, so that every training token is a target once:
every task sums over its texts how often each cell occurs beyond what the
common weights expect, the sums are added over all tasks, and one step is
taken.  A step depends on the sums alone, so scores don't depend on how rows
fall to tasks.

Scores.  The known part of a text's score needs the broadcast tables only.
Rare words go to their buckets once per block of texts with the place of
their text, and return as sums; texts aren't shuffled at all.

Defined cases: null or empty text is the end token alone; without training
rows N is 0, V is 0 and every word is rare; repeated rows are scored and
counted one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textops as X
from quern.llm.store import doc_hash, materialize, text_bytes

CLASSES = 32
NEAR = 128
ROUNDS = 3
#: Bounds of the vocabulary and of the weight rows of a level: a broadcast of at most 270 MB.
LEAST, MOST = 1 << 13, 1 << 20
#: Chosen on the training rows whose crc32 mod 11 is 3, by a model of the others.
SHRINK, PULL, STEP = 4.0, 0.5, 0.4
#: A task reads this much text at least, and that of this many tables, since it sends a whole one.
TASK_BYTES, TABLES = 64 << 20, 16
BUCKET_BYTES = 12 << 20
#: The hash that stands for a text's end.
END = X.U(0x5EED0FE4D0C0FFEE)
_BLOCK = 1 << 16  # cells in a message
RARE = 0


def room(n_tokens: int) -> int:
    """Vocabulary and weight rows of a level for so many training tokens: a power of two."""
    return min(MOST, max(LEAST, 1 << int(np.ceil(np.log2(2.0 * max(n_tokens, 1) ** 0.5)))))


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of words and ends, rows, rows' offsets): each row's words, then its end."""
    words = X.Words(X.LOWER[data], offs)
    n = len(offs) - 1
    first = words.first + np.arange(n + 1)
    out = np.full(len(words) + n, END, X.U)
    rows = words.rows
    out[np.arange(len(words)) + rows] = words.hashes()
    return out, np.repeat(np.arange(n), np.diff(first)), first


def _tally(h: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    s = h[order]
    cut = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    if weight is None:
        return s[cut], np.diff(np.append(cut, len(s)))
    return s[cut], np.add.reduceat(weight[order], cut) if len(cut) else weight[:0]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> X.U(32)) * X.U(buckets) >> X.U(32)).astype(np.int32)


def _split(place: np.ndarray, **columns: np.ndarray) -> dict[str, pa.Array]:
    """The entries of each place as one row of packed arrays."""
    order = np.argsort(place, kind="stable")
    place = place[order]
    cut = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(place))
    out = {"place": pa.array(place[cut].astype(np.int64))}
    for name, x in columns.items():
        x = x[order]
        out[name] = pa.array([x[a:z].tobytes() for a, z in zip(cut, ends)], pa.binary())
    return out


def _all(group: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in group.column(name).to_pylist() if x), kind)


def word_counts(train: DataFrame, buckets: int) -> DataFrame:
    """place (bucket), keys, counts: packed counts of all words and ends of the rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_tally(tokens(data, offs)[0]) for _, _, data, offs in X.slices(batch.column("text"), X.SMALL)]
            if parts:
                h, c = _tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                yield pa.RecordBatch.from_pydict(_split(_bucket(h, buckets), keys=h, counts=c.astype("<u4")))

    def add(key: tuple, group: pa.Table) -> pa.Table:
        h, c = _tally(_all(group, "keys", "<u8"), _all(group, "counts", "<u4").astype(np.int64))
        return pa.table(_split(np.full(len(h), key[0].as_py()), keys=h, counts=c.astype("<u4")))

    schema = "place long, keys binary, counts binary"
    return train.select("text").mapInArrow(X.tidy(scan), schema).groupBy("place").applyInArrow(add, schema)


class Vocabulary:
    """The frequent words: sorted hashes, counts and classes; totals of all words."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, total: int, distinct: int) -> None:
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        self.total, self.distinct = total, distinct
        self.classes = np.zeros(len(keys) + 1, np.int64)  # the last is for words not found
        bits = 1 << 18
        self.mask = X.U(bits - 1)
        self.bits = np.zeros(bits, bool)
        self.bits[(self.keys & self.mask).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of words, ``len(keys)`` for rare ones."""
        out = np.full(len(h), len(self.keys), np.int64)
        may = np.flatnonzero(self.bits[(h & self.mask).astype(np.int64)])
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h[may]), len(self.keys) - 1)
            ok = self.keys[at] == h[may]
            out[may[ok]] = at[ok]
        return out

    def near(self) -> np.ndarray:
        """The place of each word among the ``NEAR`` commonest, the last for the others."""
        n, top = len(self.keys), min(NEAR, len(self.keys))
        out = np.full(n + 1, top)
        out[np.argsort(-self.counts, kind="stable")[:top]] = np.arange(top)
        return out

    def classify(self, side: np.ndarray) -> None:
        """Classes by k-means of which of the commonest words stand next to a word; the end has its own."""
        n = len(self.keys)
        seen = side.sum(1) > 0
        x = np.sqrt(side / np.maximum(side.sum(1, keepdims=True), 1))
        k = CLASSES - 2
        order = [i for i in np.argsort(-self.counts, kind="stable") if seen[i]]
        if order:
            centre = x[order[:: max(1, min(len(order), 2048) // k)][:k]]
            for _ in range(8):
                own = np.argmax(x[order] @ centre.T, 1)
                for c in range(len(centre)):
                    if (own == c).any():
                        m = x[np.array(order)[own == c]].mean(0)
                        centre[c] = m / max(np.linalg.norm(m), 1e-9)
            self.classes[: n] = 2 + np.argmax(x[:n] @ centre.T, 1)
        self.classes[:n][self.keys == END] = 1
        self.classes[n] = RARE

    def finish(self) -> None:
        """Members of each class, log10 P(word | member) and the denominator of the rare class."""
        n = len(self.keys)
        own = self.classes[:n]
        order = np.lexsort((self.keys, -self.counts, own))
        starts = np.searchsorted(own[order], np.arange(CLASSES))
        self.member = np.zeros(n + 1, np.int64)
        self.member[order] = np.minimum(np.arange(n) - starts[own[order]], CLASSES - 1)
        mass = np.bincount(own * CLASSES + self.member[:n], self.counts, CLASSES * CLASSES)
        self.inside = np.append(np.log10(self.counts / np.maximum(mass[own * CLASSES + self.member[:n]], 1)), 0.0)
        rare_mass, rare_words = self.total - self.counts.sum(), self.distinct - n
        self.rare = float(np.log10(rare_mass + rare_words + 1))  # one more for words never met
        mass[RARE * CLASSES] = max(rare_mass, 1)  # a class of one member, like the end's
        self.mass = mass.reshape(CLASSES, CLASSES)


def neighbours(train: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """Of each vocabulary word, how often each of the commonest stands after and before it in all rows; neighbours cross no row."""
    shared = train.sparkSession.sparkContext.broadcast(vocab)
    n, wide = len(vocab.keys) + 1, 2 * (min(NEAR, len(vocab.keys)) + 1)

    def pack(cells: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(_split(cells // (_BLOCK * wide), cells=cells.astype("<u4"), counts=counts.astype("<i8")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        near, side = vocab.near(), np.zeros(n * wide, np.uint32)
        for batch in batches:
            for _, _, data, offs in X.slices(batch.column("text"), X.SMALL):
                h, rows, _ = tokens(data, offs)
                at = vocab.find(h)
                both = rows[1:] == rows[:-1]
                a, b = at[:-1][both], at[1:][both]
                cells, counts = np.unique(np.concatenate([a * wide + near[b], b * wide + wide // 2 + near[a]]), return_counts=True)
                side[cells] += counts.astype(np.uint32)
        cells = np.flatnonzero(side)
        if len(cells):
            yield pack(cells, side[cells])

    def add(key: tuple, group: pa.Table) -> pa.Table:
        cells, back = np.unique(_all(group, "cells", "<u4"), return_inverse=True)
        counts = np.bincount(back, _all(group, "counts", "<i8"), len(cells))
        return pa.Table.from_batches([pack(cells.astype(np.int64), counts)])

    schema = "place long, cells binary, counts binary"
    side = np.zeros(n * wide, np.float32)
    for row in train.select("text").mapInArrow(X.tidy(scan), schema).groupBy("place").applyInArrow(add, schema).toLocalIterator():
        side[np.frombuffer(row["cells"], "<u4")] = np.frombuffer(row["counts"], "<i8")
    return side.reshape(n, wide)


def features(at: np.ndarray, h: np.ndarray, rows: np.ndarray, classes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Weight rows of each token's history and class, by level: bias, class pair, previous, skip, pair."""
    n = len(h)
    one, two = np.full(n, END, X.U), np.full(n, END, X.U)
    c1, c2 = np.ones(n, np.int64), np.ones(n, np.int64)
    if n > 1:
        in1 = rows[1:] == rows[:-1]
        one[1:][in1], c1[1:][in1] = h[:-1][in1], classes[at[:-1]][in1]
    if n > 2:
        in2 = rows[2:] == rows[:-2]
        two[2:][in2], c2[2:][in2] = h[:-2][in2], classes[at[:-2]][in2]
    own, pair = classes[at], c1 * CLASSES + c2
    history = (one + X.U(1), two * X._Q + X.U(2), X.mix(one) + two * X._P)

    def put(x: np.ndarray, low: int) -> np.ndarray:
        return ((X.mix(x) >> X.U(32)) * X.U(room - low) >> X.U(32)).astype(np.int64) + low

    first = np.stack([np.zeros(n, np.int64), 1 + pair, *[put(x, 1 + CLASSES * CLASSES) for x in history]])
    cross = own.astype(X.U) * X.U(0x9E3779B97F4A7C15)
    second = np.stack([own, *[put(X.mix(x) + cross, CLASSES) for x in (pair.astype(X.U) + X.U(3), *history)]])
    return first, second


class Weights:
    """Weight rows of both levels, a column for each class or member, and how they are learnt."""

    def __init__(self, room: int) -> None:
        self.room = room
        self.w = np.zeros((2, room, CLASSES), np.float32)

    def probabilities(self, level: int, f: np.ndarray) -> np.ndarray:
        """Softmax over classes or members of each token (a row)."""
        w = self.w[level]
        z = w[f[0]]
        for x in f[1:]:
            z += w[x]
        np.exp(z, out=z)  # weights are bounded, so no sum overflows
        z /= np.maximum(z.sum(1, keepdims=True), np.float32(1e-30))
        return z

    def start(self, observed: np.ndarray, vocab: Vocabulary) -> None:
        """From counts alone: biases are log shares, other rows of the first level the shrunken log ratio of their shares to the bias."""
        share = observed[0][0] + 0.5
        share /= share.sum()
        o = observed[0][1:]
        self.w[0][0] = np.log(share)
        self.w[0][1:] = PULL * np.log((o + SHRINK * share) / ((o.sum(1, keepdims=True) + SHRINK) * share))
        mass = vocab.mass / np.maximum(vocab.mass.sum(1, keepdims=True), 1)
        self.w[1][:CLASSES] = np.where(mass > 0, np.log(np.maximum(mass, 1e-12)), -60.0)  # members that a class lacks are never chosen

        # how much a part of the texts is expected to tell of each cell, which scales the steps
        self.scale = []
        for o in observed:
            share = o.sum(0) / max(o.sum(), 1)
            self.scale.append((o + o.sum(1, keepdims=True) * share) / (2 * ROUNDS) + SHRINK)

    def step(self, gradient: np.ndarray) -> None:
        """One gradient step on all cells."""
        for w, g, scale in zip(self.w, gradient, self.scale):
            w += STEP * np.clip(g / scale, -2.0, 2.0)
            np.clip(w, -60.0, 12.0, out=w)


def _tokens_of(batches: Iterator[pa.RecordBatch], vocab: Vocabulary, room: int, chunk: int = 16384) -> Iterator[tuple]:
    """Runs of training tokens: (features of the first level, classes, features of the second, members)."""
    for batch in batches:
        for _, _, data, offs in X.slices(batch.column("text"), X.SMALL):
            h, rows, _ = tokens(data, offs)
            at = vocab.find(h)
            f, g = features(at, h, rows, vocab.classes, room)
            y, m = vocab.classes[at], vocab.member[at]
            inner = np.flatnonzero(y > 1)  # the rare class and the end have one member
            for a in range(0, len(h), chunk):
                z = min(a + chunk, len(h))
                i = inner[np.searchsorted(inner, a) : np.searchsorted(inner, z)]
                yield f[:, a:z], y[a:z], g[:, i], m[i]


def observe(batches: Iterator[pa.RecordBatch], vocab: Vocabulary, room: int) -> np.ndarray:
    """How often each cell (level, row, class or member) occurs."""
    out = np.zeros((2, room * CLASSES))
    for f, y, g, m in _tokens_of(batches, vocab, room):
        np.add.at(out[0], (f * CLASSES + y).ravel(), 1.0)
        np.add.at(out[1], (g * CLASSES + m).ravel(), 1.0)
    return out


def gradient(batches: Iterator[pa.RecordBatch], vocab: Vocabulary, weights: Weights) -> np.ndarray:
    """How often each cell occurs beyond what the weights expect."""
    room = weights.room
    seen, out = np.zeros((2, room * CLASSES)), np.zeros((2, CLASSES, room))
    for f, y, g, m in _tokens_of(batches, vocab, room):
        for level, x, t in ((0, f, y), (1, g, m)):
            np.add.at(seen[level], (x * CLASSES + t).ravel(), 1.0)
            p = weights.probabilities(level, x).T.astype(np.float64)
            flat = x.ravel()
            for c in range(CLASSES):
                out[level, c] += np.bincount(flat, np.tile(p[c], len(x)), room)
    return seen.reshape(2, room, CLASSES) - out.transpose(0, 2, 1)


def _summed(train: DataFrame, cells: int, run) -> np.ndarray:
    """``run`` over the batches of each task, added over all tasks in blocks of cells."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = run(batches).reshape(-1)
        for i in range(0, cells, _BLOCK):
            part = got[i : i + _BLOCK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([i // _BLOCK], pa.int32()), "x": pa.array([part.astype("<f4").tobytes()], pa.binary())})

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(min(_BLOCK, cells))
        for t in parts:
            for x in t.column("x").to_pylist():
                total += np.frombuffer(x, "<f4")
        yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "x": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    schema, out = "block int, x binary", np.zeros(cells, np.float32)
    for row in train.select("text").mapInArrow(X.tidy(scan), schema).groupBy("block").applyInArrow(add, schema).toLocalIterator():
        out[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.frombuffer(row["x"], "<f4")
    return out


def train_weights(train: DataFrame, vocab: Vocabulary, size: int) -> Weights:
    """Counts of all cells, then a step for each part of the texts, on sums over all tasks; ``size`` (bytes) decides how many tasks."""
    sc = train.sparkSession.sparkContext
    weights = Weights(room(vocab.total))
    cells, shape, shared = weights.w.size, weights.w.shape, sc.broadcast(vocab)
    # a task sends a whole table: all of them together send no more than a part of the text
    tasks = max(1, min(max(2 * sc.defaultParallelism, -(-size // TASK_BYTES)), size // (TABLES * weights.w.nbytes)))
    width = weights.room
    observed = _summed(train.coalesce(tasks), cells, lambda b: observe(b, shared.value, width))
    weights.start(observed.reshape(shape), vocab)
    for r in range(ROUNDS):
        now = sc.broadcast(weights)
        part = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == r).coalesce(tasks)
        weights.step(_summed(part, cells, lambda b, now=now: gradient(b, shared.value, now.value)).reshape(shape))
    return weights


def log_probs(vocab: Vocabulary, weights: Weights, at: np.ndarray, h: np.ndarray, rows: np.ndarray, chunk: int = 16384) -> np.ndarray:
    """log10 P(token | history) of each token; of a rare one, of its class alone."""
    f, g = features(at, h, rows, vocab.classes, weights.room)
    y, m = vocab.classes[at], vocab.member[at]
    out = vocab.inside[at]
    inner = np.flatnonzero(y > 1)
    for level, x, t, place in ((0, f, y, np.arange(len(h))), (1, g, m, inner)):
        for a in range(0, len(place), chunk):
            i = place[a : a + chunk]
            p = weights.probabilities(level, x[:, i])
            out[i] += np.log10(np.maximum(p[np.arange(len(i)), t[i]], 1e-30))
    return out


def _vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals and the frequent words, from packed counts."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _all(batch, "counts", "<u4")
            n, times = np.unique(np.minimum(c, 1 << 20), return_counts=True)
            yield pa.RecordBatch.from_pydict({"c": pa.array(n.astype(np.int64)), "words": pa.array(times), "tokens": pa.array([int(c[np.minimum(c, 1 << 20) == x].sum()) if x >= 1 << 20 else int(x) * int(t) for x, t in zip(n, times)], pa.int64())})

    rows = counts.mapInArrow(histogram, "c long, words long, tokens long").groupBy("c").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens"))
    rows = sorted(tuple(r) for r in rows.collect())  # at most 2**20 rows, and far fewer: counts that occur
    total, distinct = sum(r[2] for r in rows), sum(r[1] for r in rows)
    least, held = (1 << 20) + 1, 0
    for c, words, _ in reversed(rows):
        if held + words > room(total):
            break
        least, held = c, held + words

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, c = _all(batch, "keys", "<u8"), _all(batch, "counts", "<u4")
            on = c >= least
            yield pa.RecordBatch.from_pydict({"k": pa.array(k[on].view(np.int64)), "c": pa.array(c[on].astype(np.int64))})

    top = counts.mapInArrow(frequent, "k long, c long").collect()
    return Vocabulary(np.array([r[0] for r in top], np.int64).view(X.U), np.array([r[1] for r in top], np.int64), total, distinct)


def score(docs: DataFrame, held_out_mod: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    size = text_bytes(docs)
    buckets = max(32, -(-size // BUCKET_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (doc_hash(held_out_mod) == held_out).alias("held_out"), "text")
    train = rows.where("not held_out")
    counts = materialize(word_counts(train, buckets), "counts")
    vocab = _vocabulary(counts)
    vocab.classify(neighbours(train, vocab))
    vocab.finish()
    weights = train_weights(train, vocab, size)
    shared = spark.sparkContext.broadcast((vocab, weights))
    block = 4096

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, weights = shared.value
        known = np.append(np.log10(vocab.counts + 1.0), 0.0)
        denominator = np.log10(vocab.total + vocab.distinct + 1.0)
        for batch in batches:
            rid, keys, whose, out = batch.column("rid").to_numpy(), [], [], []
            for i, _, data, offs in X.slices(batch.column("text"), X.SMALL):
                h, rows, first = tokens(data, offs)
                at = vocab.find(h)
                lp = log_probs(vocab, weights, at, h, rows)
                rare = at == len(vocab.keys)
                lp[rare] -= vocab.rare
                n = np.diff(first)
                # every row has a token, its end; sums stay within rows, so that long texts lose no digits
                out.append((n, X.row_sums(~rare, first), np.add.reduceat(known[at] - denominator, first[:-1]), np.add.reduceat(lp, first[:-1])))
                keys.append(h[rare]), whose.append(rid[i + rows[rare]])
            n, n_known, base, full = (np.concatenate([o[x] for o in out]) for x in range(4)) if out else [np.zeros(0)] * 4
            yield _row(rid=batch.column("rid"), doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), n_tokens=n, n_known=n_known, base=base, full=full, size=batch.num_rows)
            if keys and sum(map(len, keys)):
                k, w = np.concatenate(keys), np.concatenate(whose)
                made = _split(_bucket(k, buckets), keys=k, rids=w.astype("<i8"))
                yield _row(**made, size=len(made["place"]))

    def _row(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in _WIDE], schema=_WIDE)

    numbered = rows.withColumn("rid", F.monotonically_increasing_id())
    wide = materialize(numbered.mapInArrow(X.tidy(scan), "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, full double, place long, keys binary, rids binary"), "scores")
    asked = wide.where("place is not null").select("place", "keys", "rids")

    def answer(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        """Sums of log10(count + 1) and numbers of known words of each text's rare words in the bucket."""
        h, rid = _all(asked, "keys", "<u8"), _all(asked, "rids", "<i8")
        keys, counts = _all(known, "keys", "<u8"), _all(known, "counts", "<u4")
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        c = np.zeros(len(h), np.int64)
        if len(keys) and len(h):
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            ok = keys[at] == h
            c[ok] = counts[at[ok]]
        on = c > 0
        rid, c = rid[on], c[on]
        ids, back = np.unique(rid, return_inverse=True)
        sums, n = np.bincount(back, np.log10(c + 1.0), len(ids)), np.bincount(back, minlength=len(ids))
        return pa.table(_split(ids // block, rids=ids, sums=sums, n=n.astype("<u4")))

    told = asked.groupBy("place").cogroup(counts.groupBy("place")).applyInArrow(answer, "place long, rids binary, sums binary, n binary")
    base = wide.where("rid is not null").select("rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "full", F.floor(F.col("rid") / block).alias("place"))
    total = vocab.total

    def finish(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        rid = rows.column("rid").to_numpy()
        ids, sums, n = _all(told, "rids", "<i8"), _all(told, "sums", "<f8"), _all(told, "n", "<u4")
        order = np.argsort(rid)
        at = order[np.searchsorted(rid[order], ids)] if len(ids) else np.zeros(0, np.int64)
        sums, n = np.bincount(at, sums, len(rid)), np.bincount(at, n, len(rid)).astype(np.int64)
        return pa.table({"doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "n_tokens": rows.column("n_tokens"), "n_known": pa.array(rows.column("n_known").to_numpy() + n), "train_tokens": pa.array([total] * len(rid), pa.int64()), "base_score": pa.array(rows.column("base").to_numpy() + sums), "score": pa.array(rows.column("full").to_numpy() + sums)})

    return base.groupBy("place").cogroup(told.groupBy("place")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_WIDE = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("full", pa.float64()), ("place", pa.int64()), ("keys", pa.binary()), ("rids", pa.binary())])
