"""Cost-balanced packing of token streams into fixed-length sequences.

A document of t tokens costs about ``LINEAR * t + t * t`` (projections plus
attention).  Documents are cut into full sequences and one tail; the tails of
a block are assigned in descending order to the lowest-cost sequence that has
token capacity left, and a tail that overflows one continues in the next.  A
block opens as many sequences as its tokens need, so at most one sequence's
worth of padding is left per block of ``BLOCK_DOCS`` documents.

Blocks are cut by a hash of a row number written with the tokens; their number
follows the row count, so a block stays bounded even where ids repeat, and
packing needs one shuffle, of tails only.

Defined cases: null or empty text is the end token alone; a special token of
the tokenizer in a text is its own id; repeated rows and ids are packed as
separate documents; a very long text is cut into full sequences where it is
read; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 1024
LINEAR = 2048
BLOCK_DOCS = 8192
#: Word pieces remembered by a worker; the dictionary is emptied when full.
CACHE = 400_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


class Encoder(dict):
    """Ids of texts as little-endian 32-bit bytes, by a byte-level BPE rank file and the tokenizer's own file.

    A text is cut at the special tokens that the latter adds, which stand for
    their ids, and at each single space between two other characters, where
    the pre-tokenizer always cuts; the ids of each piece are remembered.  Parts
    with other spacing are encoded as one.
    """

    def __init__(self, ranks_file: str, tokenizer_file: str) -> None:
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(tokenizer_file, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        if max([*ranks.values(), *added.values()]) >= 1 << 16:
            raise ValueError("tails hold 16-bit ids")
        self.special = {text: np.array([i], "<u4").tobytes() for text, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.bpe = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise KeyError(piece)
        if len(self) >= CACHE:
            self.clear()
        out = self._whole(" " + piece)
        if len(piece) < 64:
            self[piece] = out
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.cut and self.cut.search(text):
            return b"".join(self.special.get(part) or self._part(part) for part in self.cut.split(text) if part)
        return self._part(text)

    def _part(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        if not head or head[-1].isspace():
            return self._whole(text)
        try:
            return self._whole(head) + b"".join(map(self.__getitem__, rest))
        except KeyError:
            return self._whole(text)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(*files: str) -> Encoder:
    if files not in _ENCODERS:
        _ENCODERS[files] = Encoder(*files)
    return _ENCODERS[files]


def tokenize(docs: DataFrame, ranks_file: str, tokenizer_file: str | None = None, end_id: int = 0, length: int = LENGTH) -> DataFrame:
    """row number, doc_id, doc_tokens, crcs of the full sequences (32-bit) and the ids of the tail (16-bit); materialize it, which fixes the numbers.

    Without ``tokenizer_file``, that of the ranks' name is taken.
    """
    tokenizer_file = tokenizer_file or ranks_file.removesuffix(".tiktoken") + ".json"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, full = encoder(ranks_file, tokenizer_file), np.array([end_id], "<u4").tobytes(), 4 * length
        for batch in batches:
            tokens, crcs, tails = [], [], []
            for value in batch.column("text"):
                ids = enc.encode(value.as_py() or "") + end
                cut = len(ids) - len(ids) % full
                tokens.append(len(ids) // 4)
                crcs.append(np.array([zlib.crc32(ids[i : i + full]) for i in range(0, cut, full)], "<u4").tobytes())
                tails.append(np.frombuffer(ids[cut:], "<u4").astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(crcs, pa.binary()), pa.array(tails, pa.binary())], names=["row", "doc_id", "doc_tokens", "crcs", "tail"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scan, "row long, doc_id long, doc_tokens long, crcs binary, tail binary")


def assign(sizes: list[int], length: int) -> list[tuple[int, int, int, int, int]]:
    """(item, from, to, sequence, offset) for tails given in descending order."""
    n = -(-sum(sizes) // length)
    heap = [(0, s, 0) for s in range(n)]
    out = []
    for item, size in enumerate(sizes):
        at = 0
        while at < size:
            cost, s, used = heapq.heappop(heap)
            take = min(size - at, length - used)
            out.append((item, at, at + take, s, used))
            if used + take < length:
                heapq.heappush(heap, (cost + LINEAR * take + take * take, s, used + take))
            at += take
    return out


def pack(tokens: DataFrame, length: int = LENGTH, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Pieces (``PIECES``) of the rows of ``tokenize``; sequence ids are unique across blocks."""
    blocks = max(1, -(-tokens.count() // block_docs))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        block = key[0].as_py()
        ids, total = group.column("doc_id").to_pylist(), group.column("doc_tokens").to_pylist()
        crcs, tails = group.column("crcs").to_pylist(), group.column("tail").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (-len(tails[i]), ids[i] is None, ids[i], -total[i], tails[i], crcs[i]))
        rows, base = [], block << 32
        used = [i for i in order if tails[i]]
        pieces = assign([len(tails[i]) // 2 for i in used], length)
        for item, a, z, s, offset in pieces:
            i = used[item]
            crc = zlib.crc32(np.frombuffer(tails[i], "<u2")[a:z].astype("<u4").tobytes())
            rows.append((ids[i], total[i] - len(tails[i]) // 2 + a, z - a, crc, total[i], base + s, offset))
        s = base + max((p[3] for p in pieces), default=-1) + 1
        for i in order:
            for k, crc in enumerate(np.frombuffer(crcs[i], "<u4").tolist()):
                rows.append((ids[i], k * length, length, crc, total[i], s, 0))
                s += 1
        cols = list(zip(*rows)) or [[]] * 7
        cost = [float(LINEAR * n + n * n) for n in cols[2]]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table({**{n: pa.array(c, pa.int64()) for n, c in zip(names, cols)}, "cost": pa.array(cost, pa.float64())})

    block = F.pmod(F.xxhash64("row"), F.lit(blocks))
    return tokens.withColumn("block", block).groupBy("block").applyInArrow(run, PIECES)
