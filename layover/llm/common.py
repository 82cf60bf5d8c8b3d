"""Helpers shared by the operators: staging, keys, word hashes, components.

Row identity
    ``doc_id`` need not be unique or non-null.  Rows are addressed by
    ``(doc_id, xxhash64(text))``: rows that agree in both are exact
    repetitions, and every operator gives them the same result.

Staging
    Intermediates that are read twice are written as Parquet below the
    folder in ``spark.checkpoint.dir`` and read back, which cuts the
    lineage and survives the loss of executors.
"""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layover.session import checkpoint_dir, configure, register_scratch, remove_scratch

#: rows of an Arrow batch; texts are long, so batches are kept short
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Session options of the operators (all runtime SQL options)."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return register_scratch(spark, f"{checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the reread table."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete ``staged`` tables that nothing reads any more."""
    for df in tables:
        remove_scratch(df.sparkSession, df.staged_path)


def text_key(text: str | Column = "text") -> Column:
    """64-bit hash of a text; a null text has its own value."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---------------------------------------------------------------- hashing
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S27, _S30, _S31 = np.uint64(27), np.uint64(30), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection on 64-bit words."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


class WordHash(dict):
    """Word -> 64-bit hash, with a memory that is emptied when full."""

    LIMIT = 1_000_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class WordScanner:
    """Words of many texts at once, without a Python object for each word.

    A word is a run of bytes of ``word`` (256 flags).  Its hash comes from
    prefix sums of ``table[byte] * base^position`` modulo 2^64, moved to
    position 0 by the inverse power of its start, and is then mixed."""

    CHUNK = 1 << 17  # bytes hashed at once; a longer text is hashed alone
    BASE = 0x9E3779B97F4A7C15

    def __init__(self, word: np.ndarray):
        self.word = word
        self.table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 1 << 20)
            for name, base in (("power", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))

    def _chunk(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        a = np.frombuffer(b"\n".join(texts), np.uint8)
        self._grow(len(a) + 1)
        step = np.diff(self.word[a].astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(self.table[a] * self.power[:len(a)], out=sums[1:])
        h = mix64((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        return h, np.searchsorted(start, offsets)

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words in order, bounds: text i has the words
        ``bounds[i]:bounds[i + 1]``)."""
        hashes, counts, part, size = [], [np.zeros(1, np.int64)], [], 0
        for i, t in enumerate(texts):
            part.append(t)
            size += len(t) + 1
            if size >= self.CHUNK or i + 1 == len(texts):
                h, b = self._chunk(part)
                hashes.append(h)
                counts.append(np.diff(b))
                part, size = [], 0
        return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.cumsum(np.concatenate(counts))


#: bytes other than the six ASCII white space characters
UNSPACED = ~np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: ASCII letters and digits, and all bytes of other characters
ALPHANUMERIC = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; a shorter
    non-empty sequence is one shingle, an empty one has none."""
    if not len(words):
        return np.empty(0, np.uint64)
    k = min(n, len(words))
    h = np.full(len(words) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        h = mix64((h + _GOLD) ^ words[i: len(words) - k + 1 + i])
    return np.unique(h)


# ------------------------------------------------------------- components
def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Components of an undirected graph: ``edges(a, b)`` of longs ->
    ``(id, component)`` with the smallest id of the component.

    Alternating large-star and small-star rounds; each is an aggregate
    (minimum of a vertex' neighbourhood) and a join back, on the edges
    alone.  A round's edges are staged, so lineage stays short.  The rounds
    end when the edges are stars (every vertex has one edge to a smaller one
    and none to a larger, or is a centre); their number grows with the
    logarithm of the longest path.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:  # neighbours larger than the vertex go to its minimum
            n = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
                e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:  # smaller neighbours and the vertex itself go to the minimum
            n = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        m = n.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        j = n.join(m, "u")
        if large:
            out = j.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = j.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
                m.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b")

    def stars(e: DataFrame) -> bool:
        ends = e.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            e.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return ends.where("up + down > 1").isEmpty()

    e = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label)
    while not stars(e):
        old, e = e, staged(star(star(e, True), False).distinct(), label)
        release(old)
    v = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return v.union(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
