"""Secret scanning with corpus-wide ownership frequency.

Each text is scanned for three base kinds (assignments, access keys, long hex)
and for generic tokens.  Every candidate value is hashed; hashes are counted
by distinct repositories and owners over the whole corpus.  A value that many
owners hold is a copied example; one that few hold and that looks random is
live.  Base spans always stay; a generic token becomes a span if it is live.

Defined cases: null or empty text has no spans; repeated rows are scanned
alike and count as one owner; an empty table gives no rows; a null owner
counts as no owner, and where a value has none, its repositories count; a very
long text is scanned whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.store import materialize

KINDS = ["assign", "access", "hex", "token"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # greedy from a run's start, so the same as runs of 32 and more
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Cheap tests by a linear-time engine; a text that fails all has no candidate.
_MAY = [r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "AKIA[A-Z0-9]", "[0-9a-f]{32}", "[A-Za-z0-9+/_=-]{20}"]
#: Owners from which on a value counts as a copied example.
WIDE_OWNERS = 3
MIN_BITS = 3.0
SALTS = 64
_SPAN = "array<struct<start:long,kind:int,stop:long>>"
_CAND = "array<struct<start:long,kind:int,stop:long,value:binary,live:boolean>>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_live(value: str) -> bool:
    """Random enough for a credential: letters and digits mixed, and ``MIN_BITS`` bits a character."""
    return len(value) >= 8 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= MIN_BITS


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, stop, value): base matches, then generic tokens clear of them."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    taken = sorted((s, e) for s, _, e, _ in out)
    i = 0
    for m in TOKEN.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if looks_live(m[0]) and all(s >= m.end() for s, _ in taken[i:][:1]):
            out.append((m.start(), 3, m.end(), m[0]))
    return sorted(out)


def scan(docs: DataFrame) -> DataFrame:
    """rid (row), doc_id, repo, owner and candidates of every row."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64()), ("value", pa.binary()), ("live", pa.bool_())]))
        for batch in batches:
            texts = batch.column("text")
            may = [pc.fill_null(pc.match_substring_regex(texts, p), False) for p in _MAY]
            hits = [False] * batch.num_rows
            for flags in may:
                hits = [a or b for a, b in zip(hits, flags.to_pylist())]
            found = [[{"start": s, "kind": k, "stop": e, "value": hashlib.sha256(v.encode()).digest()[:16], "live": looks_live(v)} for s, k, e, v in find(texts[i].as_py())] if hit else [] for i, hit in enumerate(hits)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("rid", "doc_id", "repo", "owner")], pa.array(found, kind)], names=["rid", "doc_id", "repo", "owner", "found"])

    return docs.mapInArrow(run, f"rid long, doc_id long, repo string, owner string, found {_CAND}")


def find_secrets(docs: DataFrame, repo: str = "source", owner: str | None = None, wide_owners: int = WIDE_OWNERS) -> DataFrame:
    """doc_id and spans (start, kind index, stop, verdict ``live``, ``example`` or ``weak``) of every row.

    ``repo`` and ``owner`` name the columns whose distinct values are counted;
    without ``owner`` it is what stands before the first slash of ``repo``.
    """
    whose = F.substring_index(docs[repo].cast("string"), "/", 1) if owner is None else docs[owner].cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"], docs[repo].cast("string").alias("repo"), whose.alias("owner"))
    rows = materialize(scan(rows), "secrets")
    each = rows.where(F.size("found") > 0).select("rid", "repo", "owner", F.explode("found").alias("c")).select("rid", "repo", "owner", "c.*")
    held = each.groupBy("value", "repo", "owner").agg(F.max("live").alias("live"))
    spread = held.groupBy("value").agg(F.countDistinct("repo").alias("repos"), F.countDistinct("owner").alias("owners"))
    # the forks of one owner say little: owners decide, and repositories where owners are unknown
    wide = spread.where((F.col("owners") >= wide_owners) | ((F.col("owners") == 0) & (F.col("repos") >= wide_owners))).select("value", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("wide"))
    verdict = F.when(F.col("wide"), "example").when(F.col("live"), "live").otherwise("weak")
    # a value that a third of all rows hold is dealt to SALTS tasks
    salted = each.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
    judged = salted.join(wide, ["value", "salt"], "left").withColumn("verdict", verdict).where("kind < 3 or verdict = 'live'")
    spans = judged.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "verdict"))).alias("spans"))
    return rows.select("rid", "doc_id").join(spans, "rid", "left").select("doc_id", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,stop:bigint,verdict:string>>")).alias("spans"))


def _joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def _is(kind: int):
    return lambda x: x == kind  # one parameter: a second one would be the element's index


def digest(found: DataFrame) -> DataFrame:
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id",
        *[F.size(F.filter(F.transform("spans", lambda s: s["kind"]), _is(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"),
        count(lambda s: s["verdict"] == "example").alias("n_example"),
    )
