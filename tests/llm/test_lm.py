"""The language model: plain counts, gain over the base, and scores that don't depend on how rows fall to tasks."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import lm

SF = "/root/testdata/sf0.001"


def _plain(rows):
    """(held_out, n_tokens, n_known, train_tokens, base_score) by the contract, for (doc_id, text)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: [*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(low)), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in cut(t))
    n, v = sum(counts.values()), len(counts)
    return [(held(i), len(cut(t)), sum(counts[w] > 0 for w in cut(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in cut(t))) for i, t in rows]


def _same(df, rows):
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.held_out, r.n_known, r.train_tokens, round(r.base_score, 6), r.score) for r in df.collect()), key=str)
    want = sorted(((i is None, i or 0, p[1], p[0], p[2], p[3], round(p[4], 6)) for (i, _), p in zip(rows, _plain(rows))), key=str)
    assert [g[:-1] for g in got] == want
    return got


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_exact_columns_and_gain(spark, docs):
    got = _same(lm.score(docs), [tuple(r) for r in docs.select("doc_id", "text").collect()])
    held = [g for g in got if g[3]]
    assert all(g[-1] <= 0 and math.isfinite(g[-1]) for g in got)
    assert sum(g[-1] for g in held) > sum(g[6] for g in held)


def test_scores_do_not_depend_on_partitions(spark, docs):
    few = docs.select("doc_id", "text").where("doc_id < 60")
    scores = [sorted((r.doc_id, r.score) for r in lm.score(few.repartition(n)).collect()) for n in (1, 4, 16)]
    for other in scores[1:]:
        assert [x[0] for x in other] == [x[0] for x in scores[0]]
        assert np.allclose([x[1] for x in other], [x[1] for x in scores[0]], rtol=1e-5)


def test_null_ids_ties_hot_and_very_long_texts(spark):
    rows = [(None, "A b a"), (None, None), (3, ""), (3, "x " * 300_000), (4, "a b a"), *[(7, "same words here")] * 50]
    got = _same(lm.score(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))), rows)
    assert len({g[-1] for g in got if g[1] == 7}) == 1


def test_empty_table_and_no_training_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(none).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.score(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == pytest.approx(0.0)


TEXTS = [f"a{i % 5} b{i % 3} c{i}" for i in range(50)] + ["one", ""]


def _vocabulary():
    data, offs = lm.X.buffers(pa.array(TEXTS))
    keys, counts = lm._tally(lm.tokens(data, offs)[0])
    return lm.Vocabulary(keys, counts, int(counts.sum()), len(keys))


def test_every_token_is_a_target():
    vocab, n = _vocabulary(), sum(len(t.split()) + 1 for t in TEXTS)
    vocab.finish()
    weights = lm.Weights(lm.LEAST)
    for texts, tokens in ((TEXTS, n), (["x"], 2), (["two words"], 3)):  # texts of a few tokens take part too
        batch = pa.RecordBatch.from_pydict({"text": texts})
        assert lm.observe(iter([batch]), vocab, lm.LEAST).reshape(weights.w.shape)[0][0].sum() == tokens  # the bias row sees every token
        steps = lm.gradient(iter([batch]), vocab, weights)
        assert np.allclose(steps.sum(), 0, atol=1e-6) and abs(steps[0][0]).sum() > 0


def test_neighbours_are_counted_over_all_rows(spark):
    vocab = _vocabulary()
    rows = spark.createDataFrame([(t,) for t in TEXTS * 40 + [None]], "text string").repartition(3)
    side, near, want = lm.neighbours(rows, vocab), vocab.near(), np.zeros((len(vocab.keys) + 1, 2 * (min(lm.NEAR, len(vocab.keys)) + 1)))
    for t in TEXTS * 40:
        data, offs = lm.X.buffers(pa.array([t]))
        at = vocab.find(lm.tokens(data, offs)[0])
        for a, b in zip(at, at[1:]):
            want[a, near[b]] += 1
            want[b, want.shape[1] // 2 + near[a]] += 1
    assert len(TEXTS) * 40 > 1500 and (side == want).all() and side[:-1].any(1).all()


def test_probabilities_of_a_history_add_up_to_one():
    rng = np.random.default_rng(3)
    counts = np.sort(rng.integers(1, 900, 200))[::-1].copy()
    keys = np.append(rng.integers(1, 2**62, 199, dtype=np.uint64), lm.END)
    vocab = lm.Vocabulary(keys, counts, int(counts.sum()) + 70, 260)
    vocab.classify(rng.random((201, 2 * (lm.NEAR + 1))).astype(np.float32))
    vocab.finish()
    weights = lm.Weights(lm.LEAST)
    observed = rng.integers(0, 5, weights.w.shape).astype(float)
    weights.start(observed, vocab)
    n = len(vocab.keys)
    history = np.array([vocab.keys[0], vocab.keys[5]])
    total = 0.0
    for w in range(n + 1):
        h = np.append(history, vocab.keys[w] if w < n else np.uint64(12345))
        lp = lm.log_probs(vocab, weights, np.append([0, 5], w), h, np.zeros(3, int))[-1]
        total += 10**lp  # the rare words' shares of their class add up to one
    assert total == pytest.approx(1.0, abs=1e-3)
