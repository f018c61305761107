"""The registered queries of the corpus operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import audit, codes, decontam, langid, lm, neardup, packing, pii, quality, search, secretscan, substring, toxicity
from quern.llm.store import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = packing.tokenize(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(materialize(tokens, "tokens"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(*base, "base_failed", "kept", "reason")


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(secretscan.find_secrets(_table(spark, sf_dir, "documents")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.remove_repeats(_table(spark, sf_dir, "documents")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text"))
    return decontam.digest(decontam.find_hits(docs, _table(spark, sf_dir, "benchmark")))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_table(spark, sf_dir, "embeddings"), every=100)


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings")).drop("label")


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_language, op3_quality, op4_neardup, op5_lm, op6_secrets, op7_pii, op8_toxicity, op9_substrings, op10_decontamination, op11_neighbours, op12_codes, op13_audit, pipeline)
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_QUALITY_BINS = ", ".join(f"CASE WHEN {u} > 0 THEN {o} * {s} // {u} ELSE 0 END AS bin_{f}" for f, (o, u, s, _) in quality.FEATURES.items())
_FEATURE_ROWS = " UNION ALL ".join(f"SELECT lang, source, '{f}' AS feature, bin_{f} AS bin FROM binned WHERE NOT base_failed" for f in quality.FEATURES)
_FLOORS = " ".join(f"WHEN '{f}' THEN {v[3]}" for f, v in quality.FEATURES.items())


def _fence(name: str, keys: str) -> str:
    by = f"{keys}, " if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""{name} AS (
  SELECT {lead}feature, max(size) AS size, greatest(min(CASE WHEN below * 4 >= size * 3 THEN bin END) + {quality.SPREAD} * (min(CASE WHEN below * 4 >= size * 3 THEN bin END) - min(CASE WHEN below * 4 >= size THEN bin END)), CASE feature {_FLOORS} END) AS cut
  FROM (SELECT {lead}feature, bin, sum(n) OVER (PARTITION BY {by}feature ORDER BY bin) AS below, sum(n) OVER (PARTITION BY {by}feature) AS size
        FROM (SELECT {lead}feature, bin, count(*) AS n FROM feats GROUP BY {by}feature, bin))
  GROUP BY {by}feature)"""


_REASONS = " ".join(f"WHEN bin_{f} > cut_{f} THEN '{f}'" for f in quality.FEATURES)
_CUTS = ", ".join(f"max(cut) FILTER (feature = '{f}') AS cut_{f}" for f in quality.FEATURES)



def _lloyd(k: int) -> str:
    """Round k in SQL: every part's nearest entry of book k, and book k + 1."""
    return f"""
near{k} AS MATERIALIZED (
  SELECT p.row, p.part, p.v, min(struct_pack(d := p.vv - 2 * list_inner_product(p.v, b.v) + b.vv, e := b.entry)) AS best FROM parts p JOIN book{k} b ON b.part = p.part GROUP BY p.row, p.part, p.v),
mean{k} AS (SELECT part, best.e AS entry, i, floor(sum(v[i]) / count(*)) AS x FROM near{k}, unnest(range(1, len(v) + 1)) AS t(i) GROUP BY ALL),
next{k} AS (SELECT part, entry, list(x ORDER BY i) AS v FROM mean{k} GROUP BY part, entry),
book{k + 1} AS MATERIALIZED (SELECT part, entry, v, list_inner_product(v, v) AS vv FROM (SELECT b.part, b.entry, coalesce(n.v, b.v) AS v FROM book{k} b LEFT JOIN next{k} n USING (part, entry))),"""


ORACLES: dict[str, str] = {
    "op12_codes": f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, part, v, list_inner_product(v, v) AS vv FROM (SELECT row, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS v FROM kept, unnest(range(4)) AS t(part))),
book0 AS MATERIALIZED (SELECT part, row - 1 AS entry, v, vv FROM parts WHERE row <= {codes.ENTRIES}),
{"".join(_lloyd(k) for k in range(codes.ROUNDS + 1))}
coded AS (SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near{codes.ROUNDS} GROUP BY row),
digest AS (SELECT sha256(string_agg(v[i]::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM book{codes.ROUNDS}, unnest(range(1, len(v) + 1)) AS t(i))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row), digest""",
    "op13_audit": """
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM texts),
marked AS (
  SELECT doc_id, part, CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM words),
flags AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS n_good, coalesce(sum(toxic), 0) AS n_toxic FROM marked LEFT JOIN flags USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
steps AS (SELECT filter_order, step, filter_order[step] AS filter, (1 << (ascii(filter_order[step]) - 65))::INTEGER AS bit FROM orders, unnest(range(1, 6)) AS t(step)),
long AS (SELECT *, mask & bit AS failed, coalesce(bit_or(mask & bit) OVER (PARTITION BY part, mask, filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM cells, steps),
counted AS (
  SELECT part, filter_order, step, filter,
    sum(CASE WHEN failed = 0 AND earlier = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN failed <> 0 AND earlier = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failed <> 0 AND earlier <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failed <> 0 AND earlier = 0 THEN n_good ELSE 0 END) AS good_lost, sum(CASE WHEN failed <> 0 AND earlier = 0 THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM long GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, filter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM counted""",
    "op3_quality": f"""
WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, lang, source, text, regexp_extract_all(text, {_WORD}) AS ws FROM texts),
tri AS (SELECT doc_id, i, list_slice(ws, i, i + 2) AS w FROM words, unnest(range(1, len(ws) - 1)) AS t(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM tri) WHERE c > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM again, unnest(range(0, 3)) AS t(o) GROUP BY doc_id),
lines AS (SELECT doc_id, l, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM texts) WHERE regexp_matches(l, {_WORD})),
dups AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY doc_id),
counts AS (
  SELECT doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
    length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals, length(text) - length(translate(text, '!?', '')) AS n_marks
  FROM words LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id)),
binned AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, {_QUALITY_BINS} FROM counts),
feats AS ({_FEATURE_ROWS}),
{_fence("own", "lang, source")}, {_fence("by_lang", "lang")}, {_fence("overall", "")},
cuts AS (
  SELECT own.lang, own.source, own.feature, CASE WHEN own.size >= {quality.MIN_GROUP} THEN own.cut WHEN by_lang.size >= {quality.MIN_GROUP} THEN by_lang.cut ELSE overall.cut END AS cut
  FROM own JOIN by_lang ON own.lang IS NOT DISTINCT FROM by_lang.lang AND own.feature = by_lang.feature JOIN overall ON own.feature = overall.feature),
wide AS (SELECT lang, source, {_CUTS} FROM cuts GROUP BY lang, source),
judged AS (SELECT b.*, CASE WHEN base_failed THEN 'base' {_REASONS} END AS reason FROM binned b LEFT JOIN wide w ON b.lang IS NOT DISTINCT FROM w.lang AND b.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, reason IS NULL AS kept, reason FROM judged""",
    "op4_neardup": f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOW}, {_WORD}) AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') AS s FROM words, unnest(range(1, greatest(len(ws) - 1, 2))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.d WHERE reach.r < l.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.r) AS component_id, d.doc_id = min(reach.r) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.d = d.doc_id GROUP BY d.doc_id, n.n""",
    "op9_substrings": f"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS w FROM words, unnest(range(1, len(ws) - 18)) AS t(i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM later, unnest(range(0, 20)) AS t(o)),
each AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM words),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)""",
    "op10_decontamination": f"""
WITH words AS (SELECT doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOW}, {_ALNUM}) AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(list_slice(ws, i, i + least(10, len(ws)) - 1), ' ') AS w FROM items, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS t(i) WHERE len(ws) > 0),
lengths AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, i, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS w FROM words, lengths, unnest(range(1, len(ws) - k + 2)) AS t(i)),
hits AS (SELECT doc_id, i, k, item_id FROM dw JOIN iw USING (k, w)),
n_hit AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM hits, unnest(range(0, k)) AS t(o) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AS contaminated
FROM words LEFT JOIN n_hit USING (doc_id) LEFT JOIN found USING (doc_id)""",
}
