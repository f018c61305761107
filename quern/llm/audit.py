"""Audit of how filters interact, over all orders in which they can be applied.

Every document gets a mask of the filters it fails.  Masks are counted by
part and label first, so all that follows works on at most 2**filters cells a
part: the cells are unpivoted against the steps of every order, a running
bit-or tells which filters failed earlier in that order, conditional sums give
the counts of a step, and totals over windows of (part, filter) give each
filter's share over all orders.

A text's copies are found by its SHA-256 and its length, not letter by letter.
Copies are counted by (text, part, labels) before they meet, so a text that
fills the table costs a few rows.

Defined cases: a null text is an empty one (no words, so it passes the ratio
rules); a null part is the empty string; a row with a null doc_id is neither
an earlier copy of another row nor a later one, and has no labels; rows that
share doc_id and text are no copies of each other; repeated labels of a
doc_id count once, a 1 before a 0; an empty table gives no rows.  Of the
tables only the named columns are read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.store import materialize

WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS = 100
LEAST_DISTINCT = 80
MOST_CAPITALS = 10
SYMBOLS = r"[#$%&*|]"
#: Letters of the filters; a filter's bit is its place here.
FILTERS = "ABCDE"
COPY = "E"
_BIT = {f: 1 << i for i, f in enumerate(FILTERS)}


def text_failures(text: Column) -> dict[str, Column]:
    """Which of the filters on a text alone it fails: too short, repetitive, shouted, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n_capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * n_capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


def masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """Per row: doc_id, part, key of the text, and the mask of the filters on the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    fails = text_failures(text)
    mask = sum((F.when(fails[f], _BIT[f]).otherwise(0) for f in fails), F.lit(0))
    key = F.struct(F.unhex(F.sha2(text, 256)).alias("sha"), F.length(text).alias("size"))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), key.alias("text_key"), mask.cast("int").alias("mask"))


def cells(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows counted by part and mask, copies included: part, mask, n, n_good, n_toxic."""
    flags = labels.select(labels["doc_id"].cast("long").alias("doc_id"), (labels["quality"] == 1).alias("good"), (labels["toxic"] == 1).alias("toxic")).where("doc_id is not null")
    flags = flags.groupBy("doc_id").agg(F.max(F.coalesce("good", F.lit(False))).alias("good"), F.max(F.coalesce("toxic", F.lit(False))).alias("toxic"))
    named = marked.where("doc_id is not null").join(flags, "doc_id", "left").fillna(False, ["good", "toxic"])
    by = ["text_key", "mask", "part", "good", "toxic"]
    # rows of one doc_id and text are one another's repeats: counted apart, they tell how many rows the least doc_id has
    counted = named.groupBy("doc_id", *by).agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("text_key"))
    n_first = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.array(F.struct(F.col("mask").alias("mask"), n_first.alias("n")), F.struct((F.col("mask").bitwiseOR(_BIT[COPY])).alias("mask"), (F.col("n") - n_first).alias("n")))
    halves = counted.withColumn("least", least).select("part", "good", "toxic", F.explode(split).alias("x")).select("part", "x.mask", "x.n", "good", "toxic").where("n > 0")
    nameless = marked.where("doc_id is null").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).select("part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return halves.unionByName(nameless).groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good").alias("n_good"), of("toxic").alias("n_toxic"))


def interactions(cell: DataFrame) -> DataFrame:
    """One row per part, order and step, from counted cells."""
    steps = [(("".join(order)), k + 1, f) for order in permutations(FILTERS) for k, f in enumerate(order)]
    long = F.explode(F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(f).alias("filter"), F.lit(_BIT[f]).alias("bit")) for o, k, f in steps])).alias("s")
    failed = F.col("mask").bitwiseAND(F.col("bit"))
    rows = cell.select("*", long).select("part", "mask", "n", "n_good", "n_toxic", "s.*").withColumn("failed", failed)
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    here, gone = (F.col("failed") != 0) & (F.col("earlier") == 0), F.col("earlier") != 0
    out = rows.groupBy("part", "filter_order", "step", "filter").agg(
        total((F.col("failed") == 0) & ~gone).alias("kept"),
        total(here).alias("removed"),
        total((F.col("failed") != 0) & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(here, "n_good").alias("good_lost"),
        total(here, "n_toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    marked = materialize(masks(docs, part), "masks")
    return interactions(materialize(cells(marked, labels), "cells"))
