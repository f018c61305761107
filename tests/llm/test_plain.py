"""Operators whose results SQL can't say, against plain versions; hot ids, ties, nulls and very long texts."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import langid, packing, pii, secretscan, toxicity
from quern.llm import textops as X

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def _digest(spans, names):
    said = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return hashlib.sha256(said.encode()).hexdigest(), said


# personal data -------------------------------------------------------------------------


def _luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _private(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) < 256 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and _luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    return out


def test_personal_data_base_columns(docs, rows):
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(docs.select("doc_id", "text"))).collect()}
    for i, text in rows:
        spans, r = _private(text or ""), got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in spans) for x in range(4)]
        assert r.base_sha256 == _digest(spans, pii.KINDS)[0]
        assert set(_digest(spans, pii.KINDS)[1].split(",")) <= set(r.spans.split(","))


VARIANTS = "Pay 4111 1111 1111 1111 today. Later 4111.1111.1111.1111 again, or 4111/1111/1111/1111. Call +1 415 555 0100 or 415-555-0100 now. Write jo.doe@mail.example.org, JO.DOE@MAIL soon."


def test_field_adds_repeated_and_similar_words(spark, rows):
    more = [(10**6 + i, VARIANTS) for i in range(3)] + [(2 * 10**6, "order 4111111111111112 of 415-555-0100 on 2024-01-05 at noon"), (None, None), (5, "")]
    df = spark.createDataFrame(rows + more, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find_pii(df).collect()}
    added = {(VARIANTS[s["start"] : s["stop"]], pii.KINDS[s["kind"]]) for s in found[10**6].pii if not s["base"]}
    assert {("4111.1111.1111.1111", "card"), ("4111/1111/1111/1111", "card"), ("415-555-0100", "phone"), ("JO.DOE@MAIL", "email")} <= added
    assert found[2 * 10**6].pii == [] and found[None].pii == []
    masked = {r.doc_id: r.text for r in pii.mask(pii.find_pii(df)).collect()}[10**6]
    assert "1111" not in masked and "0100" not in masked and "@" not in masked


def test_every_repeat_takes_the_kind_of_the_base_span():
    text = " ".join(f"word{chr(97 + i % 26)} 4111.1111.1111.1111" for i in range(60)) + " card 4111 1111 1111 1111"
    data, offs = X.buffers(pa.array([text]))
    graph, crf = pii.Graph(data, offs), pii.Crf()
    kind = graph.on_spans([pii.base_spans(text)])
    p = crf.marginals(graph, kind)
    assert len(p) == 61 and (p[:, 2] >= pii.MIN_MARGINAL).all() and [len(a) for a, _ in graph.edges(kind)] == [0, 60, 60]
    none = np.full(61, -1)  # without the clamped node nothing is personal
    assert (crf.marginals(graph, none)[:, -1] > 0.5).all()


# secrets ----------------------------------------------------------------------------------


def _secrets(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def test_secret_base_columns(docs, rows):
    got = {r.doc_id: r for r in secretscan.digest(secretscan.find_secrets(docs)).collect()}
    for i, text in rows:
        spans, r = _secrets(text or ""), got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in spans) for x in range(3)]
        assert r.base_sha256 == _digest(spans, secretscan.KINDS)[0]


def test_owners_tell_examples_from_live_tokens(spark):
    live, copied, forks = "Zk3v9Qw7Lm2Xr8Tb4Np6Hd", "Ab1Cd2Ef3Gh4Ij5Kl6Mn7O", "Qq8Ww7Ee6Rr5Tt4Yy3Uu2I"
    rows = [(1, f"use {live} here", "acme/x"), (2, f"doc {copied}", "acme/x"), (3, f"doc {copied}", "bolt/y"), (4, f"doc {copied}", "core/z")]
    rows += [(10 + i, f"fork {forks}", f"acme/r{i}") for i in range(5)] + [(20, f'token = "{copied}"', None), (21, None, "acme/x")]
    rows += [(30 + i, f"hot {copied}", "acme/x") for i in range(300)]  # a value that most rows hold
    got = {r.doc_id: [(s["kind"], s["verdict"]) for s in r.spans] for r in secretscan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1] == [(3, "live")] and got[2] == got[3] == got[30] == [] and got[20] == [(0, "example")] and got[21] == []
    assert all(got[10 + i] == [(3, "live")] for i in range(5))  # the forks of one owner make no example


# language -----------------------------------------------------------------------------------


def test_language_of_a_text_is_a_mean_of_its_grams(spark):
    texts = ["the cat sat on the mat " * 3, "der hund und die katze " * 3] * 20
    model = langid.Model(texts, ["en", "de"] * 20)
    data, offs = X.buffers(pa.array(["the cat and", "katze und hund", "x"]))
    p = model.probabilities(data, offs)
    for text, row in zip(["the cat and", "katze und hund", "x"], p):
        one, none = X.buffers(pa.array([text]))
        idx, _ = langid.grams(one, none)
        z = model.table[idx].sum(0) / max(len(idx), 1) + model.bias
        e = np.exp((z - z.max()) / model.heat)
        assert np.allclose(row, e / e.sum(), atol=1e-6)
    assert [model.langs[i] for i in p.argmax(1)[:2]] == ["en", "de"]


def test_language_with_hot_ids_ties_and_long_texts(spark):
    rows = [(1, "the cat sat " * 5, "en")] * 50 + [(3, "der hund bellt " * 5, "de"), (None, "the cat", "en"), (4, None, "en"), (5, "123 456", "en"), (7, "the cat " * 200_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    assert len(langid.training_rows(df, 10)) <= 4  # one text of an id, however often it repeats
    got = langid.identify(df).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id in (4, 5)} == {"und"} and all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2) for r in got)


# toxicity --------------------------------------------------------------------------------------


def _machine():
    texts = [f"calm words number{i % 7}" for i in range(60)] + [f"vile people number{i % 7}" for i in range(60)]
    return toxicity.Machine(texts, np.repeat([0, 1], 60), 0.3)


def test_score_is_the_plain_sum_over_pairs():
    m = _machine()
    for text in ("vile people", "calm", "", "unknown thing", "vile vile calm people"):
        data, offs = X.buffers(pa.array([text]))
        slots = sorted(set(m.slot[toxicity.terms(data, offs)[0]]) - {0})
        z = m.w0 + sum(float(m.w[s]) for s in slots) + sum(float(m.v[a] @ m.v[b]) for i, a in enumerate(slots) for b in slots[:i])
        assert m.score(data, offs)[0] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_a_pair_counts_beyond_its_parts():
    texts = ["insult weather"] * 80 + ["group weather"] * 80 + ["plain weather"] * 80 + ["insult group"] * 80
    m = toxicity.Machine(texts, np.repeat([0, 0, 0, 1], 80), 0.25)
    score = lambda t: float(m.score(*X.buffers(pa.array([t])))[0])
    logit = lambda p: np.log(p / (1 - p))
    alone = logit(score("insult")) + logit(score("group")) - logit(score(""))
    assert score("insult group") > 0.5 and logit(score("insult group")) > alone


def test_toxicity_with_nulls_ties_and_hot_ids(spark):
    rows = [(i, "vile people" if i % 2 else "calm words") for i in range(40)] + [(1, "vile people")] * 30 + [(None, None), (50, ""), (51, "calm " * 200_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2 + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and min(r.score for r in got if r.doc_id == 1) > max(r.score for r in got if r.doc_id == 51)


# packing ------------------------------------------------------------------------------------------


def test_hot_and_null_ids_are_dealt_to_many_blocks(spark):
    import public_tokenizers

    df = spark.createDataFrame([(7 if i % 3 else None, f"text number {i}") for i in range(300)], "doc_id long, text string")
    tokens = packing.tokenize(df, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pieces = packing.pack(tokens, block_docs=50).collect()
    assert len(pieces) >= 300 and len({p.sequence_id >> 32 for p in pieces}) > 3
