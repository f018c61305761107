"""Scalar functions on paths, text and hashes."""

from pyspark.sql import functions as F


def fingerprint(*parts):
    """First 12 hex digits of SHA-1 of the non-null parts joined by a space."""
    return F.substring(F.sha1(F.concat_ws(" ", *parts)), 1, 12)


def round_half_up(x):
    return F.floor(x + F.lit(0.5))


def sloc(lines, prefixes=("//",)):
    """Lines with code of an array of lines: not blank, not in a block comment, not a line comment; a fold inside the row."""
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("inside"))

    def step(s, line):
        x = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
        ends = F.contains(x, F.lit("*/"))
        opens = ~s["inside"] & x.startswith("/*")
        code = ~s["inside"] & (x != "") & ~x.startswith("*") & ~x.startswith("/*")
        for p in prefixes:
            code = code & ~x.startswith(p)
        return F.struct((s["n"] + code.cast("int")).alias("n"), ((s["inside"] | opens) & ~ends).alias("inside"))

    return F.aggregate(lines, start, step)["n"]


def line_count(text):
    return F.size(F.split(text, "\n")).cast("long")
