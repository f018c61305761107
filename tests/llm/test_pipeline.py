"""The pipeline's run() against a plain version of its five stages on small documents."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quern.llm import decontam, pii, quality

WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
PRIVATE = {"jo.doe@mail.example.org": "<email>", "10.20.30.40": "<ip>", "4539148803436467": "<card>", "+49 (30) 1234-5678": "<phone>"}


def _prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 7))) for _ in range(n))


def _rows() -> tuple[list, list]:
    passage = _prose(900, 30)
    texts = [_prose(i, 80 + i) for i in range(14)]
    texts += [texts[3], texts[4].replace(texts[4].split()[10], "changed", 1), None, "", _prose(50, 20), "spam eggs ham " * 40]
    texts += [_prose(60, 90) + " " + " ".join(_prose(61, 20).upper().split()), _prose(62, 90) + " ! ! ! ? ?" * 12]
    texts += [_prose(70, 60) + ". " + passage + ", " + _prose(71, 40), passage + " " + _prose(72, 21)]
    texts += [_prose(80, 50) + " " + " and ".join(PRIVATE) + " " + _prose(81, 30), "naïve 東京 — " + _prose(82, 70) + "<|endoftext|>"]
    rows = [(i, t, [None, "en", "de"][i % 3], None if i % 5 == 0 else "s", 7) for i, t in enumerate(texts)]
    return [*rows, rows[5]], [(1, passage), (2, None), (3, "")]  # the last row repeats an id and text


def _passes(rows: list) -> list:
    """Rows that the base rule and one cutoff per feature keep; no group here reaches MIN_GROUP rows."""
    counts = []
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        again = {i + o for i, g in enumerate(grams) if grams.count(g) > 1 for o in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        c = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(x in "#*$%&|<>" for x in t), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again), "n_capitals": sum("A" <= x <= "Z" for x in t), "n_marks": sum(x in "!?" for x in t)}
        counts.append((c, len(w) < 50 or 2 * len(again) > len(w)))
    assert len(rows) < quality.MIN_GROUP
    kept = [not failed for _, failed in counts]
    for over, under, scale, floor in quality.FEATURES.values():
        bins = [c[over] * scale // c[under] if c[under] else 0 for c, _ in counts]
        ranked = sorted(b for b, (_, failed) in zip(bins, counts) if not failed)
        q1, q3 = (next(b for i, b in enumerate(ranked, 1) if 4 * i >= q * len(ranked)) for q in (1, 3))
        cut = max(q3 + quality.SPREAD * (q3 - q1), floor)
        kept = [k and b <= cut for k, b in zip(kept, bins)]
    return [r for r, k in zip(rows, kept) if k]


def _firsts(rows: list) -> list:
    """The least row of each group linked at 0.8 on five-word shingles."""
    rows = sorted(set(rows), key=lambda r: r[0])
    words = [(r[1] or "").translate(LOW) for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(WORD.findall, words)]
    root = list(range(len(rows)))
    for _ in rows:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if 100 * len(x & y) >= 80 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    return [r for i, r in enumerate(rows) if root[i] == i]


def _clean(text: str, benchmark: list) -> str | None:
    at = [m.span() for m in ALNUM.finditer(text.translate(LOW))]
    words = [text.translate(LOW)[a:z] for a, z in at]
    hit = [False] * len(words)
    for _, item in benchmark:
        w = ALNUM.findall((item or "").translate(LOW))
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            for i in range(len(words) - k + 1):
                if words[i : i + k] == w[s : s + k]:
                    hit[i : i + k] = [True] * k
    if 2 * sum(hit) >= max(len(words), 1):
        return None
    out, last = [], 0
    for i, h in enumerate(hit):
        if h and not (i and hit[i - 1]):
            out.append(text[last : at[i][0]])
        if h:
            last = at[i][1]
    return "".join([*out, text[last:]])


def test_run_equals_a_plain_version(spark, tmp_path):
    rows, bench = _rows()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = _firsts(_passes(rows))
    want = {}
    for r in kept:
        text = _clean(r[1], bench)
        for value, kind in PRIVATE.items() if text else ():
            text = text.replace(value, kind)
        if text is not None:
            want[r[0]] = text
    # every stage has something to do here, and clean documents stay
    assert {14, 15, 16, 17, 18, 19, 20, 21, 23}.isdisjoint(want) and {*range(14), 22, 24, 25} == set(want)
    assert "<email> and <ip> and <card> and <phone>" in want[24] and len(want[22]) < len(rows[22][1])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in want.items()}
    covered = {i: 0 for i in ids}
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
        covered[p.doc_id] += p.length
    assert covered == {i: len(x) for i, x in ids.items()}


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_the_columns_of_documents(spark, tmp_path, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = corpus_pipeline.STAGES[stage][1](spark, spark.createDataFrame([], schema), str(tmp_path))
    assert empty.columns == ["doc_id", "text", "lang", "source", "n_chars"] and empty.count() == 0


def test_a_stage_scans_and_rewrites_texts_in_one_worker_a_task(spark, tmp_path):
    rows, bench = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    benchmark = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    two = {
        corpus_pipeline.benchmark_decontamination: decontam.remove_spans(decontam.find_hits(docs, benchmark)),
        corpus_pipeline.personal_data: pii.mask(pii.find_pii(docs)),
    }
    for stage, plain in two.items():
        out = stage(spark, docs, str(tmp_path))
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        assert sorted(map(repr, out.select("doc_id", "text").collect())) == sorted(map(repr, plain.select("doc_id", "text").collect()))
    # in blocks, only the last scan rewrites
    assert sorted(map(repr, decontam.remove_hits(docs, benchmark, max_windows=40).collect())) == sorted(map(repr, decontam.remove_hits(docs, benchmark).collect()))
