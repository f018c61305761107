"""Quality rules with thresholds learned per language and source.

Each document gets counts (words, symbols, repeated lines, repeated 3-word
windows, capitals).  Every (language, source) group keeps one mergeable
quantile sketch per feature: a histogram over fixed integer bins of a ratio,
so sketches of parts add up exactly, ranks are exact and values are exact to
one bin.  A group's cutoffs are fences from its sketch, the third quartile
plus ``SPREAD`` times the interquartile range and never below a floor; groups
under ``MIN_GROUP`` rows use their language's merged sketch, and languages
under it the sketch of all rows.  The cutoffs are then joined to the rows.

Defined cases: null text has no words and fails the base rule; null language
or source is a group of its own; an empty table gives no rows; ties and
repeated rows get the same verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import textops as X
from quern.llm.store import materialize

MIN_GROUP = 100
SPREAD = 6
#: feature -> (numerator, denominator, scale, least cutoff); bins are integers, the ratio times the scale.
FEATURES = {
    "word_length": ("word_chars", "n_words", 10, 40),
    "symbols": ("n_symbols", "n_words", 1000, 100),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 400),
    "repeats": ("n_repeat_words", "n_words", 1000, 300),
    "capitals": ("n_capitals", "word_chars", 1000, 30),
    "marks": ("n_marks", "n_words", 1000, 300),
}
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(b"#*$%&|<>")] = 1
_CAPITAL = np.zeros(256, np.uint8)
_CAPITAL[65:91] = 1
_MARK = np.zeros(256, np.uint8)
_MARK[list(b"!?")] = 1
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks"]


def _count(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offs) - 1
    words = X.Words(data, offs)
    sums = X.byte_sums(data)
    of_bytes = lambda flags: X.row_sums(flags, offs)
    out = {"n_words": words.counts, "word_chars": of_bytes(words.inside & ((data & 0xC0) != 0x80))}
    out |= {"n_symbols": of_bytes(_SYMBOL[data]), "n_capitals": of_bytes(_CAPITAL[data]), "n_marks": of_bytes(_MARK[data])}
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offs[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([offs[1:], breaks]))
    rows = np.searchsorted(breaks, offs)
    of_line = np.repeat(np.arange(n), np.diff(rows) + 1)
    full = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    line_rows = of_line[full]
    _, again = X.row_repeats(X.span_hashes(sums, starts[full], ends[full]), line_rows)
    out["n_lines"] = np.bincount(line_rows, minlength=n)
    out["n_dup_lines"] = np.bincount(line_rows[again], minlength=n)
    h, rows = X.span_hashes(sums, words.starts, words.ends), words.rows
    ok = np.flatnonzero(X.whole(rows, 3))
    twice, _ = X.row_repeats(X.windows(h, 3)[ok], rows[ok])
    flags = np.zeros(len(h), bool)
    flags[ok[twice]] = True
    out["n_repeat_words"] = X.row_sums(X.cover(flags, 3, len(h)), words.first)
    return out


def count_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of ``COUNTS`` in place of the text column.

    Lines are pieces between line feeds that hold a word; a line break inside
    the sorted starts and ends never crosses rows, since rows meet at offsets.
    """
    kept = [c for c in docs.columns if c not in (*COUNTS, text)]
    names = [f for f in docs.schema.fields if f.name in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in names] + [f"{c} long" for c in COUNTS])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_count(data, offs) for _, _, data, offs in X.slices(batch.column(text), X.SMALL)]
            cols = [batch.column(c) for c in kept]
            new = [pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([*cols, *new], names=[*kept, *COUNTS])

    return docs.select(*kept, text).mapInArrow(X.tidy(scan), schema)


def _bin(feature: str):
    over, under, scale, _ = FEATURES[feature]
    return F.when(F.col(under) > 0, F.floor(F.col(over) * scale / F.col(under))).otherwise(0).cast("long")


def sketches(counts: DataFrame) -> DataFrame:
    """Mergeable sketches: rows (lang, source, feature, bin, n) over the rows that pass the base rule."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"bin_{f}").alias("bin")) for f in FEATURES])
    return counts.where(~F.col("base_failed")).select("lang", "source", F.explode(pairs).alias("p")).groupBy("lang", "source", "p.feature", "p.bin").agg(F.count(F.lit(1)).alias("n"))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: its size and the cutoff of each feature, from merged sketches."""
    merged = sketch.groupBy(*keys, "feature", "bin").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys, "feature").orderBy("bin")
    ranked = merged.withColumn("below", F.sum("n").over(upto)).withColumn("size", F.sum("n").over(Window.partitionBy(*keys, "feature")))
    quartiles = ranked.groupBy(*keys, "feature").agg(F.max("size").alias("size"), *[F.min(F.when(F.col("below") * 4 >= F.col("size") * q, F.col("bin"))).alias(f"q{q}") for q in (1, 3)])
    floor = F.element_at(F.create_map(*[F.lit(x) for f, v in FEATURES.items() for x in (f, v[3])]), F.col("feature"))
    cut = F.greatest(F.col("q3") + SPREAD * (F.col("q3") - F.col("q1")), floor.cast("long"))
    return quartiles.groupBy(*keys).agg(F.max("size").alias("size"), *[F.max(F.when(F.col("feature") == f, cut)).alias(f"cut_{f}") for f in FEATURES])


def judge(docs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts, cutoffs and verdict of every row: ``keys``, doc_id, COUNTS, base_failed, reason, kept.

    Needs doc_id, text, lang and source; of other columns only ``keys`` are
    carried along.  ``reason`` is the first rule broken (``base`` first), null
    for rows kept.
    """
    counts = count_rules(docs.select(*keys, "doc_id", "text", "lang", "source"))
    counts = counts.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    counts = materialize(counts.withColumns({f"bin_{f}": _bin(f) for f in FEATURES}), "quality")
    # one row per group, feature and bin in use: its size follows the groups, not the rows
    sketch = materialize(sketches(counts), "sketches")
    cuts = [f"cut_{f}" for f in FEATURES]
    own = _fences(sketch, ["lang", "source"])
    lang = _fences(sketch, ["lang"]).select(F.col("lang").alias("l2"), F.col("size").alias("s2"), *[F.col(c).alias(f"{c}2") for c in cuts])
    every = _fences(sketch.withColumn("one", F.lit(1)), ["one"]).select(*[F.col(c).alias(f"{c}3") for c in cuts])
    groups = own.join(lang, own["lang"].eqNullSafe(lang["l2"]), "left").join(every, how="left")
    chosen = [F.when(F.col("size") >= MIN_GROUP, F.col(c)).when(F.col("s2") >= MIN_GROUP, F.col(f"{c}2")).otherwise(F.col(f"{c}3")).alias(c) for c in cuts]
    groups = groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *chosen)
    rows = counts.join(groups, counts["lang"].eqNullSafe(groups["g_lang"]) & counts["source"].eqNullSafe(groups["g_source"]), "left")
    reason = F.when(F.col("base_failed"), "base")
    for f in FEATURES:
        reason = reason.when(F.col(f"bin_{f}") > F.col(f"cut_{f}"), f)
    return rows.select(*keys, "doc_id", *COUNTS, "base_failed", reason.alias("reason"), *cuts, reason.isNull().alias("kept"))
