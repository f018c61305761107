"""State as tables: versions, history, the last run, the parse cache."""

import os

from pyspark.sql import functions as F

from quern.functions import extract
from quern.plans import analysis as A
from quern.sources import state as ST


def test_missing_and_other_versions_read_as_nothing(spark, tmp_path):
    s = ST.State(spark, str(tmp_path))
    assert s.baseline()[0].count() == s.snapshot().count() == s.history().count() == 0
    s.write("last-run", spark.createDataFrame([("9", "t", "check", 1, "f", "i", "error", "x", None, None)], ST.SNAPSHOT))
    assert s.snapshot().count() == 0


def test_history_keeps_the_last_fifty(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "MAX_HISTORY", 3)
    s = ST.State(spark, str(tmp_path))
    assert [s.append_history({"kind": "review", "overall": 60 + i}) for i in range(5)] == [1, 2, 3, 4, 5]
    assert [(r.id, r.overall) for r in s.history().collect()] == [(3, 62), (4, 63), (5, 64)] and [r.id for r in s.history(1).collect()] == [5]
    assert len(os.listdir(tmp_path / ".quern" / "history")) == 3  # the pointer, this version and the one before
    assert "history/" in (tmp_path / ".quern" / ".gitignore").read_text()


def test_unchanged_files_are_not_parsed_again(spark, tmp_path, monkeypatch):
    for name, text in {"a.py": "def f():\n    pass\n", "b.py": "def g():\n    pass\n"}.items():
        (tmp_path / name).write_text(text)
    s = ST.State(spark, str(tmp_path))
    first = {r.path: r for r in ST.parse_cached(s, ["a.py", "b.py"], A.TOOL).collect()}
    assert first["a.py"].functions[0].name == "f" and first["a.py"].text.startswith("def f")
    asked = []
    monkeypatch.setattr(ST, "parse_files", lambda new: (asked.append(sorted(r.path for r in new.select("path").collect())), extract.parse_files(new))[1])
    os.utime(tmp_path / "a.py", ns=(1, 1))  # another time, the same content
    (tmp_path / "b.py").write_text("def h():\n    pass\n\n")
    (tmp_path / "c.py").write_text("def k():\n    pass\n")
    got = {r.path: [f.name for f in r.functions] for r in ST.parse_cached(s, ["a.py", "b.py", "c.py"], A.TOOL).collect()}
    assert got == {"a.py": ["f"], "b.py": ["h"], "c.py": ["k"]} and asked == [["b.py", "c.py"]]
    ST.parse_cached(s, ["a.py"], A.TOOL)
    assert asked[-1] == [] and [r.path for r in s.cached(A.TOOL).collect()] == ["a.py"] and s.cached("other").count() == 0
    assert ST.invalidated(s.cached(A.TOOL), "a.py").count() == 0


def test_a_hit_needs_time_and_size(spark):
    cached = spark.createDataFrame([("a", 1, 10), ("b", 1, 10)], "path string, mtime long, size long").withColumn("lines", F.lit(3))
    listing = spark.createDataFrame([("a", 1, 10), ("b", 2, 10), ("c", 1, 1)], "path string, mtime long, size long")
    hits, misses = ST.cache_hits(listing, cached)
    assert [r.path for r in hits.collect()] == ["a"] and sorted(r.path for r in misses.collect()) == ["b", "c"]
