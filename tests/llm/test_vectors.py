"""Neighbours, vector codes and the filter audit against brute force, and their defined cases."""

import hashlib
import math
import random
from itertools import permutations

import numpy as np
import pytest

from quern.llm import audit, codes, queries, search

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int, score string"


def table(spark, rows):
    """Rows (vec_id, vector, label), with a column that clashes with a result's."""
    return spark.createDataFrame([(*r, "clash") for r in rows], VECTORS)


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def random_rows(n, width, seed, spread=4):
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = rng.normal(0, 1, (spread, width))
    x = (centres[rng.integers(0, spread, n)] + rng.normal(0, 0.2, (n, width))).astype(np.float32)
    return [(i, v, i % 3) for i, v in enumerate(x.tolist())]


# neighbours ------------------------------------------------------------------------


def exact(rows, every, k=10):
    """Nearest of each id that ``every`` divides, by the definition."""
    rows = sorted({(i, tuple(v)) for i, v, *_ in rows if i is not None and good(v) and any(v)})
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for i, v in rows:
        if i % every == 0:
            d = np.sqrt(((x - np.array(v)) ** 2).sum(1)).tolist()
            near = sorted((d[j], rows[j][0]) for j in range(len(rows)) if rows[j][0] != i)
            out[i] = [(n, dist) for dist, n in near[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def close(got, want):
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items() if x}
    assert all(abs(a - b) < 1e-12 for q in got for (_, a), (_, b) in zip(got[q], want[q]))


def test_one_leaf_is_exact_with_copies_ties_and_bad_vectors(spark):
    rows = random_rows(60, 6, 1)
    rows += [(100 + i, rows[20][1], 0) for i in range(30)]  # more copies than an answer holds, queries among them
    rows += [(200, None, 1), (201, [], 1), (210, [0.0] * 6, 1), (220, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (230, [float("nan")] * 6, 1), (240, [float("inf")] + [0.0] * 5, 1), (None, [1.0] * 6, 1), (250, [1.0] * 5, 1)]
    rows += [rows[10], rows[10]]  # the same row again
    close(found(search.search(table(spark, rows), 10)), exact([r for r in rows if r[1] is None or len(r[1]) == 6], 10))


def test_few_or_no_candidates(spark):
    assert search.search(table(spark, []), 10).count() == 0
    assert search.search(table(spark, [(10, [1.0, 2.0], 0)]), 10).count() == 0
    rows = [(i, [float(i), 1.0], 0) for i in range(4)]
    close(found(search.search(table(spark, rows), 2)), exact(rows, 2))


def test_blocks_and_leaves_lose_nothing_that_is_visited(spark, monkeypatch):
    # every leaf is visited and split into many blocks, so the answers are exact
    for name, value in (("LEAF", 40), ("LEAF_SAMPLE", 10), ("SAMPLE", 150), ("QUERY_BLOCK", 7), ("CLASS_BLOCK", 16)):
        monkeypatch.setattr(search, name, value)
    rows = random_rows(400, 8, 2)
    close(found(search.search(table(spark, rows), 5, target=1.01)), exact(rows, 5))


def test_best_bin_first_opens_the_nearest_node_that_was_seen():
    x = np.array([v for _, v, _ in random_rows(500, 5, 3)], np.float64)
    tree = search.Tree(x, 20)
    order = list(tree.order(x[0]))
    assert sorted(order) == list(range(tree.leaves)) and tree.leaves > 20
    own = tree.down(x)
    assert np.bincount(own, minlength=tree.leaves).max() < 200
    assert np.mean([next(tree.order(v)) == leaf for v, leaf in zip(x, own)]) > 0.95  # the way down is nearly always the first bin


def test_recall_on_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got, want = found(queries.op11_neighbours(spark, "/root/testdata/sf0.1")), exact(rows, 100)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9


# codes -----------------------------------------------------------------------------


def lloyd(rows, entries=256, rounds=4):
    """(vec_id, label, code, error, label_error, sha) by plain rounds over all entries."""
    rows = [r for r in rows if good(r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    x = np.array([[math.floor(1024 * c) for c in v] + [0] * (-len(v) % 4) for _, v, _ in rows], np.int64).reshape(len(rows), 4, -1)
    books = [[x[i, p] for i in range(min(entries, len(rows)))] for p in range(4)]
    for turn in range(rounds + 1):
        best = [[min((int(((v - b) ** 2).sum()), e) for e, b in enumerate(books[p])) for v in x[:, p]] for p in range(4)]
        if turn < rounds:
            for p in range(4):
                for e in range(len(books[p])):
                    own = [x[i, p] for i in range(len(rows)) if best[p][i][1] == e]
                    if own:
                        books[p][e] = np.array([math.floor(int(s) / len(own)) for s in sum(own)])
    sha = hashlib.sha256(",".join(str(c) for p in books for b in p for c in b).encode()).hexdigest()
    errors = [sum(best[p][i][0] for p in range(4)) for i in range(len(rows))]
    total = {}
    for (_, _, label), e in zip(rows, errors):
        total[label] = total.get(label, 0) + e
    return sorted((str(r[0]), str(r[2]), "".join(f"{best[p][i][1]:02x}" for p in range(4)), errors[i], total[r[2]], sha) for i, r in enumerate(rows))


def coded(df):
    return sorted((str(r.vec_id), str(r.label), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("width, packet", [(8, 1 << 14), (6, 32)])
def test_codes_equal_plain_rounds(spark, monkeypatch, width, packet):
    monkeypatch.setattr(codes, "PACKET", packet)
    rows = random_rows(330, width, width, spread=9)
    rows += [(400 + i, rows[3][1], None) for i in range(20)]  # copies, without a label
    rows += [(500, None, 1), (501, [None] * width, 1), (502, [float("inf")] * width, 1), (503, [1.0] * (width + 1), 1), (None, rows[5][1], 2), rows[7], (504, [], 0)]
    assert coded(codes.compress(table(spark, rows).repartition(3))) == lloyd(rows)


def test_ties_go_to_the_lower_entry_and_small_tables_have_small_books(spark):
    rows = [(i, [float(i % 2), 0.0, 0.0, 1.0], 0) for i in range(6)]  # equal entries
    assert coded(codes.compress(table(spark, rows))) == lloyd(rows)
    assert coded(codes.compress(table(spark, rows[:1]))) == lloyd(rows[:1])
    assert codes.compress(table(spark, [])).count() == codes.compress(table(spark, [(1, None, 0)])).count() == 0


def test_very_large_components_are_clamped(spark):
    rows = [(0, [1e30, -1e30, 1e30, 0.0], 0), (1, [1.0, 1.0, 1.0, 1.0], 0)]
    assert [r.error for r in codes.compress(table(spark, rows)).collect()] == [0, 0]


def test_many_labels_are_joined_by_split_keys(spark, monkeypatch):
    rows = random_rows(40, 4, 4) + [(100, [0.1] * 4, None)]
    want = lloyd(rows)
    monkeypatch.setattr(codes, "FEW_LABELS", 1)
    assert coded(codes.compress(table(spark, rows))) == want


def test_heaps_pop_only_what_the_drift_has_reached():
    rng = np.random.Generator(np.random.PCG64(8))
    centres = rng.integers(-9000, 9000, (16, 4))
    x = (centres[rng.integers(0, 16, 2000)] + rng.integers(-300, 300, (2000, 4))).astype(np.int32)
    book, drift = centres.astype(np.int64), np.zeros(16)
    heaps = codes.Heaps.fill(x, book, drift)
    for _ in range(5):
        moved = book + rng.integers(-40, 40, book.shape)
        step = np.sqrt(((moved - book) ** 2).sum(1))
        drift = drift + step + np.array([np.delete(step, e).max() for e in range(16)])
        book = moved
        rows, _, _ = heaps.round(x, book, drift)
        assert (heaps.codes == codes.nearest(x, book)[0]).all()
        assert sorted(r for h in heaps.heaps for _, r in h) == list(range(2000))
        assert all((heaps.codes[[r for _, r in h]] == e).all() for e, h in enumerate(heaps.heaps))
    assert len(rows) < 1000  # well separated parts stay where they are, unseen


# audit -----------------------------------------------------------------------------


def plain_audit(docs, labels):
    """Every order applied step by step to sets of rows."""
    marks = {}
    for i, quality, toxic in labels:
        g, t = marks.get(i, (False, False))
        marks[i] = g or quality == 1, t or toxic == 1
    rows = []
    for doc_id, text, lang in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs),
        }
        rows.append((lang or "", fails, *(marks.get(doc_id, (False, False)) if doc_id is not None else (False, False))))
    out = {}
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                redundant = sum(r[1][f] for r in own) - len(gone)
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                unique = sum(r[1][f] and sum(r[1].values()) == 1 for r in own)
                out[part, "".join(order), k + 1] = [f, len(left), len(gone), redundant, unique, sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, k), x in out.items():
            if p == part:
                x.append(shapley[x[0]])
    return {k: tuple(v[1:]) for k, v in out.items()}


def audited(spark, docs, labels):
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, lang string, mask string")
    rows = audit.audit(d, spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, part int")).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


def test_audit_equals_every_order_applied(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(30):
        t = " ".join(word() for _ in range(rng.choice([40, 99, 100, 150])))
        if rng.random() < 0.4:
            t = " ".join(t.split(" ")[: rng.choice([10, 30])] * 6)
        if rng.random() < 0.3:
            t = t.upper() if rng.random() < 0.5 else t[:20].upper() + t[20:]
        if rng.random() < 0.3:
            t += rng.choice("#$%&*|é\n")
        texts.append(t)
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(80)]
    docs += [(80, None, "en"), (81, "", "en"), (82, None, None), (None, texts[0], "en"), (None, texts[0], "en"), (5, docs[5][1], "de"), (0, docs[3][1], "en"), (90, "x " * 50_000, "fr"), (91, "x " * 50_000, "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 95, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    assert audited(spark, docs, labels) == plain_audit(docs, labels)


def test_audit_of_an_empty_table(spark):
    assert audited(spark, [], []) == {}
