"""Byte-level BPE encoding and decoding with a published rank file.

The rank file (path is a parameter) maps byte strings to ranks, one
``base64 rank`` pair a line.  Each match of the pattern is encoded on its
own: a match that is itself a token gives its rank; otherwise the leftmost
pair of neighbouring tokens with the least rank is merged until no pair
has a rank.

The search for that pair is a segment tree over the match's byte
positions.  Leaf ``i`` holds ``rank << 32 | i`` of the pair that starts
at byte ``i``, so the root is the leftmost pair of least rank.  A merge
changes the leaf of the merged token, of its left neighbour and of the
token that vanished: three updates of logarithmic cost, also in a match as
long as the text.  Encoded matches are remembered in a table of bounded
size.

Edge cases: null text is empty text, which has no ids and decodes to no
bytes; whole texts of any length are encoded; columns named in ``keep``
pass through (others are dropped, so names cannot clash); an empty table
gives an empty result.  Unknown ids raise ``KeyError``.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from layover.llm.common import prepare

MEMORY = 600_000  # remembered matches of a worker
_NONE = 1 << 62


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match of the pattern."""
    get = ranks.get
    if (whole := get(piece)) is not None:
        return [whole]
    n = len(piece)
    leaves = [_NONE if (r := get(piece[i:i + 2])) is None else r << 32 | i for i in range(n - 1)]
    leaves += [_NONE] * ((1 << max(1, (n - 2).bit_length())) - len(leaves))
    levels = [leaves]  # the segment tree, one list a level, the root last
    while len(levels[-1]) > 1:
        levels.append(list(map(min, levels[-1][::2], levels[-1][1::2])))
    steps, root = list(zip(levels, levels[1:], strict=False)), levels[-1]
    after, before = list(range(1, n + 2)), list(range(-1, n))
    while (top := root[0]) < _NONE:
        i = top & 0xFFFFFFFF
        gone = after[i]
        end = after[i] = after[gone]  # the token at i now ends here
        before[end] = i
        r = get(piece[i:after[end]]) if end < n else None
        changes = [(i, _NONE if r is None else r << 32 | i)]
        if gone < n - 1:
            changes.append((gone, _NONE))
        if (p := before[i]) >= 0:
            r = get(piece[p:end])
            changes.append((p, _NONE if r is None else r << 32 | p))
        for k, low in changes:
            leaves[k] = low
            for here, up in steps:
                other = here[k ^ 1]
                if other < low:
                    low = other
                k >>= 1
                if up[k] == low:
                    break
                up[k] = low
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:after[i]]])
        i = after[i]
    return ids


class _Memory(dict):
    """Ids of the matches seen; kept by a worker from task to task."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= MEMORY:
            self.clear()
        ids = tuple(merge(piece.encode(), self.ranks))
        if len(piece) <= 64:
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def _memory(path: str) -> _Memory:
    return _Memory(load_ranks(path))


@lru_cache(maxsize=2)
def _tokens(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in load_ranks(path).items()}


def _kept(df: DataFrame, keep: list[str], name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([df.schema[c] for c in keep] + [T.StructField(name, kind)])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``id_bytes`` of every row: the ids as unsigned
    32-bit little-endian integers, the usual layout of token files."""
    prepare(df.sparkSession)
    keep = list(keep)

    def run(batches):
        memory, find = _memory(path), regex.compile(pattern).findall
        for b in batches:
            out = [np.fromiter(chain.from_iterable(map(memory.__getitem__, find(t or ""))), "<u4").tobytes()
                   for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(out, pa.binary())], [*keep, "id_bytes"])

    return df.select(*keep, text).mapInArrow(run, _kept(df, keep, "id_bytes", T.BinaryType()))


def decode(df: DataFrame, path: str, ids: str = "id_bytes", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``decoded`` (binary) of every row; null ids
    decode to no bytes."""
    prepare(df.sparkSession)
    keep = list(keep)

    def run(batches):
        token = _tokens(path)
        for b in batches:
            out = [b"".join(map(token.__getitem__, np.frombuffer(x or b"", "<u4").tolist()))
                   for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(out, pa.binary())], [*keep, "decoded"])

    return df.select(*keep, ids).mapInArrow(run, _kept(df, keep, "decoded", T.BinaryType()))


def unpacked(df: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids`` (array of int) from ``id_bytes``."""
    keep = list(keep)

    def run(batches):
        for b in batches:
            ids = [np.frombuffer(x or b"", "<u4").astype(np.int32) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(ids, pa.list_(pa.int32()))], [*keep, "ids"])

    return df.select(*keep, "id_bytes").mapInArrow(run, _kept(df, keep, "ids", T.ArrayType(T.IntegerType())))
