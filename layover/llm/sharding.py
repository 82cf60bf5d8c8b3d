"""Sharding by jump consistent hashing, in DataFrame functions only.

A row's shard depends on its key and the shard count alone.  The key is
the first 64 bits of the MD5 of the key column as text; the published
jump generator ``k <- k * 2862933555777941757 + 1 (mod 2^64)`` gives the
successive jump targets, and the shard is the last target below the shard
count.  No ring table is kept, and appending a shard moves rows only into
the new shard: the expected ``1/(n+1)`` of them.

64-bit products do not fit Spark's longs, so the generator's state is held
as two 32-bit halves.  The jumps are a fold over a short sequence (a row
needs about ``ln n`` of them); the rare row that needs more than 64 is
folded on to ``n``, its greatest possible number, so the result is exact.

``slot`` is the row's gapless position in its shard in the order of
(key, crc32 of the text, size), nulls first: a range-partitioned sort over
all rows with offsets for each partition, so a shard, a hot key or a group
of copies is never sorted in one task as a whole.

Edge cases: a null key hashes as the empty string; a null text has size 1
and crc32 0, like an empty one; repeated rows share their shard and take
neighbouring slots; an empty table gives an empty result; only the key and
text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layover.llm.common import prepare, staged
from layover.operators.ranking import global_index

#: multiplier of the published generator (fixed value)
MULTIPLIER = 2862933555777941757
_HI, _LO = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_USUAL_JUMPS = 64


def _key_halves(key: Column) -> tuple[Column, Column]:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))


def _jump(s: Column, n: int) -> Column:
    """One jump of the state (hi, lo, at, shard, grown); none once at > n."""
    hi, lo = s["hi"], s["lo"]
    p0 = (lo.bitwiseAND(0xFFFF)) * F.lit(_LO) + 1
    p1 = F.shiftright(lo, 16) * F.lit(_LO) + F.shiftright(p0, 16)
    new_lo = F.shiftleft(p1.bitwiseAND(0xFFFF), 16) + p0.bitwiseAND(0xFFFF)
    cross = (hi.bitwiseAND(0xFFFF)) * F.lit(_LO) + F.shiftleft(
        (F.shiftright(hi, 16) * F.lit(_LO & 0xFFFF)).bitwiseAND(0xFFFF), 16)
    new_hi = (F.shiftright(p1, 16) + lo * F.lit(_HI) + cross).bitwiseAND(0xFFFFFFFF)
    target = F.floor((s["at"] + 1) * (F.lit(2147483648.0) / (F.shiftright(new_hi, 1) + 1)))
    moved = F.struct(
        new_hi.alias("hi"), new_lo.alias("lo"), F.least(target, F.lit(1 << 40)).cast("long").alias("at"),
        F.when(s["at"] < n, s["at"]).otherwise(s["shard"]).alias("shard"), s["at"].alias("grown"))
    return F.when(s["at"] <= n, moved).otherwise(s)


def jump_shards(key: Column, n: int) -> Column:
    """Struct with ``shard`` among n shards and ``grown`` among n + 1."""
    hi, lo = _key_halves(key)
    zero = F.lit(0).cast("long")
    start = F.struct(hi.alias("hi"), lo.alias("lo"), zero.alias("at"), zero.alias("shard"), zero.alias("grown"))
    fold = lambda state, jumps: F.aggregate(F.sequence(F.lit(1), F.lit(jumps)), state, lambda s, _: _jump(s, n))
    state = fold(start, min(n + 1, _USUAL_JUMPS))
    if n + 1 > _USUAL_JUMPS:
        state = F.when(state["at"] <= n, fold(state, n + 1 - _USUAL_JUMPS)).otherwise(state)
    return state


def shard_rows(df: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    prepare(df.sparkSession)
    state = jump_shards(F.col("key"), n)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("body")).select(
        "key", (F.coalesce(F.octet_length("body"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("body", F.lit("")).cast("binary")).alias("text_crc32"), state.alias("state"))
    rows = rows.select("key", "size", "text_crc32", F.col("state.shard").cast("int").alias("shard"),
                       F.col("state.grown").cast("int").alias("grown_shard"))
    rows = staged(rows, "shards")
    placed = global_index(rows, ["shard", "key", "text_crc32", "size"], "place")
    # first place of each shard: a table of at most n rows
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("k")).select(
        "shard", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("place") - F.col("first") - 1).cast("long").alias("slot"), "grown_shard")
