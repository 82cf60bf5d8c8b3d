"""Hard-negative mining by Fagin's threshold algorithm.

Rows are packed into blocks of ``BLOCK`` rows; a block holds its vectors as
integers (floor of 256 times each component) and, for each dimension, its
rows sorted by that component.  An anchor reads a block by sorted access:
in each dimension it goes down the list if its own component is positive
and up if it is negative, so every list falls in what it adds to the score.
A row met for the first time is scored in full (random access, an integer
inner product).  After each depth the threshold, the sum over dimensions of
the anchor's component times the list's present one, bounds the score of
every row not met; reading ends once it is strictly below the kth score of
each window that the anchor asks for, or below the window itself.  A pack of
anchors reads a block together: what one of them meets is scored for all that
still read, by one matrix product, and an anchor leaves when its own threshold
lets it.

Two searches, each merged over the blocks by a partial aggregate of short
lists: the anchor's first ``positives`` other rows of its label (one window
without bounds), then for each positive its first ``negatives`` rows of other
labels whose scores fall into the window that the positive's score sets.

Anchors are a stated query set: each pack of about ``PACK`` anchors meets
each block once, in an equi-join on spans of blocks; no anchor, row or list of
all rows is broadcast or collected.  A task keeps one short list a window over
all blocks of its span, whose kth scores also bound what later blocks add.

Edge cases: rows with a null label, a null vector or a component that is
null or not finite take no part; vectors of other lengths count as padded by
zeros; a null ``vec_id`` is no anchor and comes last among ties; equal rows
are separate rows, and an anchor leaves out only itself; a positive score
that is negative has an empty window; without positives or negatives an
anchor has no rows; other columns are ignored; an empty table gives an empty
result.  Scores are exact: in floats while every partial sum stays below 2^24,
in doubles while it stays below 2^53, else (anchor by anchor) in Python's
integers of up to 34 digits (greater ones count as the greatest); one that does
not fit 64 bits is returned as the nearest that does.
"""

from __future__ import annotations

import math
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, localcontext
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layover.llm.common import staged
from layover.operators.ranking import global_index

BLOCK = 2048
PACK = 1024
#: pairs of a pack and a block that a task should search
CELLS = 64
#: packs whose lists a task holds at once
HELD = 16
SCALE = 256.0
#: depths of the first sorted accesses; each next one is twice as deep
FIRST_DEPTH = 16
EXACT = 2.0 ** 53
SINGLE = 2.0 ** 24
_MOST = 10 ** 34 - 1  # Spark negates decimals in 34 digits
_LONG = (1 << 63) - 1


def taking_part(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v): rows with a label and a finite vector."""
    v = F.col(vector).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < float("inf"))
    x = rows.where(F.col("label").isNotNull() & F.col(vector).isNotNull())
    return x.select("vec_id", F.col("label").cast("long").alias("label"), v.alias("v")).where(F.forall("v", finite))


# ------------------------------------------------------------------ blocks
_BLOCKS = "block long, size int, dims int, ids binary, nulls binary, labels binary, vectors binary, lists binary"


def _pack_rows(batches):
    """Blocks of up to BLOCK rows, with their sorted lists."""
    from pyspark import TaskContext

    task, made = TaskContext.get().partitionId(), 0
    held, count = [], 0

    def block(rows: list) -> pa.RecordBatch:
        nonlocal made
        t = pa.Table.from_batches(rows).combine_chunks()
        lists = t["v"].combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        dims = int(sizes.max(initial=0))
        m = np.zeros((len(sizes), dims))
        m[np.arange(dims) < sizes[:, None]] = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * SCALE)
        ids = t["vec_id"].combine_chunks()
        order = np.argsort(m.T, axis=1, kind="stable").astype(np.uint16)
        row = [(task << 32) + made, len(sizes), dims, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
               ids.is_null().to_numpy(zero_copy_only=False).tobytes(), t["label"].to_numpy().astype(np.int64).tobytes(), m.tobytes(), order.tobytes()]
        made += 1
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)],
                                          ["block", "size", "dims", "ids", "nulls", "labels", "vectors", "lists"])

    for b in batches:
        while b.num_rows:
            part = b.slice(0, BLOCK - count)
            held.append(part)
            count += part.num_rows
            b = b.slice(part.num_rows)
            if count == BLOCK:
                yield block(held)
                held, count = [], 0
    if count:
        yield block(held)


class Block:
    """A block's rows and sorted lists as arrays."""

    def __init__(self, size, dims, ids, nulls, labels, vectors, lists):
        self.size, self.dims = size, dims
        self.ids, self.nulls = np.frombuffer(ids, np.int64), np.frombuffer(nulls, bool)
        self.labels = np.frombuffer(labels, np.int64)
        self.m = np.frombuffer(vectors, np.float64).reshape(size, dims)
        self.lists = np.frombuffer(lists, np.uint16).reshape(dims, size)
        self.down = np.ascontiguousarray(self.lists[:, ::-1])
        self.most = float(np.abs(self.m).max(initial=0))

    def exact(self, a: np.ndarray) -> bool:
        return self.dims * self.most * float(np.abs(a).max(initial=0)) * 100 < EXACT

    @cached_property
    def single(self) -> np.ndarray:
        return self.m.astype(np.float32)

    def at_depth(self, lists: np.ndarray, depth: int) -> np.ndarray:
        """The component that each list shows at ``depth``."""
        return self.m[lists[:, depth - 1], np.arange(self.dims)]


class Window:
    """The first ``k`` rows with ``lo <= 100 * score <= hi`` among those where
    ``allowed``: keys of the rows found, as (score, null id, id, row)."""

    def __init__(self, block: Block, k: int, allowed: np.ndarray, lo=None, hi=None):
        self.block, self.k, self.allowed, self.lo, self.hi = block, k, allowed, lo, hi
        self.score, self.row = np.empty(0), np.empty(0, np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray) -> None:
        ok = self.allowed[rows]
        if self.lo is not None:
            ok &= (100 * scores >= self.lo) & (100 * scores <= self.hi)
        if not ok.any():
            return
        score, row = np.concatenate((self.score, scores[ok])), np.concatenate((self.row, rows[ok]))
        b = self.block
        first = np.lexsort((b.ids[row], b.nulls[row], -score))[:self.k]
        self.score, self.row = score[first], row[first]

    def done(self, threshold) -> bool:
        if self.lo is not None and 100 * threshold < self.lo:
            return True
        return len(self.score) == self.k and threshold < self.score[-1]

    def found(self) -> list[tuple]:
        b = self.block
        return [(Decimal(-min(max(int(s), -_MOST), _MOST)), bool(b.nulls[r]), int(b.ids[r])) for s, r in zip(self.score, self.row, strict=True)]


def threshold_search(block: Block, anchor: np.ndarray, windows: list[Window]) -> int:
    """Fill the windows by the threshold algorithm; the depth that was read."""
    a = anchor[:block.dims]
    a = np.concatenate((a, np.zeros(block.dims - len(a))))
    m = block.m
    if not block.exact(a):
        a, m = np.array([int(x) for x in a], object), m.astype(int).astype(object) if block.most < 2 ** 62 else np.vectorize(int, otypes=[object])(m)
    signed = np.flatnonzero(a != 0)
    lists = np.where((a[signed] > 0)[:, None], block.down[signed], block.lists[signed])
    met = np.zeros(block.size, bool)
    open_, at, depth = windows, 0, min(FIRST_DEPTH, block.size)
    if not len(signed):  # every score is 0: nothing bounds, all rows are met at once
        lists, depth = np.arange(block.size)[None], block.size
    while True:
        new = np.zeros(block.size, bool)
        new[lists[:, at:depth].ravel()] = True
        rows = np.flatnonzero(new & ~met)
        if len(rows):
            met[rows] = True
            scores = m[rows] @ a if block.dims else np.zeros(len(rows))
            for w in open_:
                w.add(rows, scores)
        if depth >= block.size or met.all():
            return depth
        at = depth
        threshold = (m[lists[:, at - 1], signed] * a[signed]).sum()
        open_ = [w for w in open_ if not w.done(threshold)]
        if not open_:
            return depth
        depth = min(2 * depth, block.size)


class Pack:
    """Anchors that search together, and what their windows hold so far: the
    first ``k`` rows of each as scores (descending), null ids and ids."""

    def __init__(self, group: int, blocks, ats, labels, vectors: list[bytes], windows: list[list[Decimal]], k: int, same_label: bool):
        self.group, self.k, self.same_label = group, k, same_label
        self.blocks, self.ats, self.labels = (np.asarray(x, np.int64) for x in (blocks, ats, labels))
        rows = [np.frombuffer(v, np.float64) for v in vectors]
        self.windows = windows
        self.a = np.zeros((len(rows), max(map(len, rows), default=0)))
        for to, v in zip(self.a, rows, strict=True):
            to[:len(v)] = v
        self.largest = np.abs(self.a).max(axis=1, initial=0)
        n, width = len(rows), 1 if same_label else max(map(len, windows), default=0)
        # whole scores from lo to hi; a window that is missing has none
        self.lo, self.hi = np.full((n, width), -EXACT), np.full((n, width), np.inf if same_label else -np.inf)
        if not same_label:
            with localcontext(prec=60):
                for i, ps in enumerate(windows):
                    for w, p in enumerate(ps):
                        if p >= 0:
                            lo, hi = (p * 30 / 100).to_integral_value(ROUND_CEILING), (p * 90 / 100).to_integral_value(ROUND_FLOOR)
                            self.lo[i, w], self.hi[i, w] = (float(min(x, Decimal(int(EXACT)))) for x in (lo, hi))
        self.score, self.none, self.id = np.full((n * width, k), -np.inf), np.zeros((n * width, k), bool), np.zeros((n * width, k), np.int64)

    @property
    def kth(self) -> np.ndarray:
        """The kth score of each window, if it holds as many."""
        return self.score[:, self.k - 1].reshape(self.lo.shape)

    def done(self, who: np.ndarray, threshold: np.ndarray) -> np.ndarray:
        t = threshold[:, None]
        return ((t < self.lo[who]) | (t < self.kth[who]) | (self.hi[who] < self.lo[who])).all(axis=1)

    def add(self, block: Block, here: int, who: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        """Rows of a block with their scores for the anchors ``who``."""
        ok = (block.labels[rows] == self.labels[who][:, None]) == self.same_label
        own = np.flatnonzero(self.blocks[who] == here)
        at = np.searchsorted(rows, self.ats[who[own]])
        met = at < len(rows)
        met[met] = rows[at[met]] == self.ats[who[own[met]]]
        ok[own[met], at[met]] = False
        x = np.where(ok, scores, scores.dtype.type(-np.inf))
        lo, hi, kth, ordered = self.lo[who], self.hi[who], self.kth[who], None
        found = []
        for w in range(lo.shape[1]):
            cut, top = np.maximum(lo[:, w], kth[:, w])[:, None], hi[:, w][:, None]
            some = (x >= cut) & (x <= top)
            if np.count_nonzero(some) > 4 * self.k * len(who):  # rows that others of this block keep out
                ordered = np.sort(x, axis=1) if ordered is None else ordered
                last = np.count_nonzero(ordered <= top, axis=1) - self.k
                best = np.where(last >= 0, ordered[np.arange(len(who)), np.maximum(last, 0)], -np.inf)
                some &= x >= best[:, None]
            i, j = np.nonzero(some)
            found.append((who[i] * lo.shape[1] + w, x[i, j].astype(np.float64), rows[j]))
        at, score, row = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        if len(at):
            self._merge(at, score, block.nulls[row], block.ids[row])

    def _merge(self, at: np.ndarray, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        which = np.unique(at)
        at = np.concatenate((np.repeat(which, self.k), at))
        score, none, ids = (np.concatenate((old[which].ravel(), new)) for old, new in ((self.score, score), (self.none, none), (self.id, ids)))
        real = score > -np.inf
        order = np.flatnonzero(real)[np.lexsort((ids[real], none[real], -score[real], at[real]))]
        at, score, none, ids = (c[order] for c in (at, score, none, ids))
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        first = rank < self.k
        at, rank = at[first], rank[first]
        self.score[which] = -np.inf
        self.score[at, rank], self.none[at, rank], self.id[at, rank] = score[first], none[first], ids[first]

    def found(self, part: int) -> pa.RecordBatch:
        """The windows that hold rows, as rows of ``_FOUND``."""
        held = self.score > -np.inf
        sizes = held.sum(axis=1)
        at, width = np.flatnonzero(sizes), max(1, self.lo.shape[1])
        score = pa.array((-self.score[held]).astype(np.int64)).cast(pa.decimal128(38, 0))
        items = pa.StructArray.from_arrays([score, pa.array(self.none[held]), pa.array(self.id[held])], fields=list(_ITEM))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes[at]))).astype(np.int32)), items)
        of, w = at // width, at % width
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int64)), pa.array(self.blocks[of]), pa.array(self.ats[of].astype(np.int32)),
                                           pa.array(w.astype(np.int32)), lists.cast(_KINDS[-1])], _NAMES)


def pack_search(block: Block, here: int, pack: Pack, who: np.ndarray) -> int:
    """Fill the windows of the anchors ``who`` by the threshold algorithm, all
    of them together; the depth that was read."""
    a = pack.a[:, :block.dims]
    a = np.pad(a, ((0, 0), (0, block.dims - a.shape[1])))
    single = block.dims * block.most * float(pack.largest[who].max(initial=0)) < SINGLE
    m, vectors = (block.single, a.astype(np.float32)) if single else (block.m, a)
    met, at, depth = np.zeros(block.size, bool), 0, min(FIRST_DEPTH, block.size)
    while True:
        new, up = np.zeros(block.size, bool), a[who] < 0
        down = a[who] > 0
        if not (up | down).any(axis=1).all():  # every score is 0: nothing bounds, all rows are met at once
            new[:], depth = True, block.size
        new[block.down[down.any(axis=0), at:depth]] = True
        new[block.lists[up.any(axis=0), at:depth]] = True
        rows = np.flatnonzero(new & ~met)
        if len(rows):
            met[rows] = True
            pack.add(block, here, who, rows, vectors[who] @ m[rows].T)
        if depth >= block.size or met.all():
            return depth
        at = depth
        threshold = np.maximum(a[who], 0) @ block.at_depth(block.down, at) + np.minimum(a[who], 0) @ block.at_depth(block.lists, at)
        who = who[~pack.done(who, threshold)]
        if not len(who):
            return depth
        depth = min(2 * depth, block.size)


# --------------------------------------------------------------- the grid
_FOUND = "part long, block long, at int, window int, found array<struct<score:decimal(38,0),none:boolean,id:long>>"
_NAMES = ["part", "block", "at", "window", "found"]
_ITEM = pa.struct([("score", pa.decimal128(38, 0)), ("none", pa.bool_()), ("id", pa.int64())])
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(_ITEM)]


def _one_by_one(block: Block, here: int, pack: Pack, who: np.ndarray, part: int) -> pa.RecordBatch | None:
    """The search of anchors whose scores doubles do not hold."""
    out = []
    for q in who.tolist():
        allowed = (block.labels == pack.labels[q]) == pack.same_label
        if pack.blocks[q] == here:
            allowed[pack.ats[q]] = False
        ps = [int(p) for p in pack.windows[q]]
        asked = [None] if pack.same_label else sorted({p for p in ps if p >= 0})
        of = {p: Window(block, pack.k, allowed, *(() if p is None else (30 * p, 90 * p))) for p in asked}
        if not of or not allowed.any():
            continue
        threshold_search(block, pack.a[q], list(of.values()))
        for i, p in enumerate([None] if pack.same_label else ps):
            if p in of and len(of[p].row):
                out.append((part, int(pack.blocks[q]), int(pack.ats[q]), i, [{"score": s, "none": n, "id": v} for s, n, v in of[p].found()]))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _KINDS, strict=True)], _NAMES) if out else None


def _grid(k: int, same_label: bool):
    """Rows of (pack of anchors, block) -> the short list of each window."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, block, packs = None, None, {}
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i] for c in b.schema.names}
                if (here := r["here"].as_py()) != held:
                    held, block = here, Block(*[r[c].as_py() for c in ("size", "dims", "ids", "nulls", "labels", "vectors", "lists")])
                if (group := r["group"].as_py()) not in packs:
                    if len(packs) >= HELD:
                        yield packs.pop(next(iter(packs))).found(part)
                    x = r["pack"].values
                    packs[group] = Pack(group, *[x.field(c).to_numpy(zero_copy_only=False) for c in ("block", "at", "label")],
                                        x.field("v").to_pylist(), x.field("windows").to_pylist(), k, same_label)
                pack = packs[group]
                exact = block.dims * block.most * pack.largest * 100 < EXACT
                if exact.any():
                    pack_search(block, here, pack, np.flatnonzero(exact))
                if not exact.all() and (more := _one_by_one(block, here, pack, np.flatnonzero(~exact), part)) is not None:
                    yield more
        for pack in packs.values():
            yield pack.found(part)

    return run


def _search(blocks: DataFrame, anchors: DataFrame, packs: int, k: int, same_label: bool) -> DataFrame:
    """(block, at, window, found): each anchor's first ``k`` rows a window."""
    n = blocks.agg(F.max("number")).first()[0] or 1
    spans = min(n, max(2 * blocks.sparkSession.sparkContext.defaultParallelism, -(-n * packs // CELLS)))
    group = F.pmod(F.xxhash64("block", "at"), F.lit(packs))
    pack = anchors.groupBy(group.alias("group")).agg(F.collect_list(F.struct("block", "at", "label", "v", "windows")).alias("pack"))
    pack = pack.withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spans - 1).cast("long"))))
    here = blocks.withColumnRenamed("block", "here").withColumn("span", F.pmod("number", F.lit(spans)))
    # an explicit deal: the rows are few but dear, and must not depend on how files were cut
    cells = pack.repartition(2 * spans, "span").hint("merge").join(here.repartition(2 * spans, "span"), "span")
    part = cells.mapInArrow(_grid(k, same_label), _FOUND)
    shorter = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, k)
    # in two steps, so that no task holds the lists of all spans
    some = part.groupBy("block", "at", "window", (F.col("part") % (math.isqrt(spans) + 1)).alias("s")).agg(shorter("found").alias("found"))
    return some.groupBy("block", "at", "window").agg(shorter("found").alias("found"))


def _unpack_rows(batches):
    """Blocks -> their rows as (block, at, vec_id, label, v)."""
    for b in batches:
        for r in b.to_pylist():
            ids, none = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["nulls"], bool)
            m = np.frombuffer(r["vectors"], np.float64).reshape(r["size"], r["dims"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["block"]] * r["size"], pa.int64()), pa.array(np.arange(r["size"], dtype=np.int32)), pa.array(ids, pa.int64(), mask=none),
                 pa.array(np.frombuffer(r["labels"], np.int64)), pa.array([x.tobytes() for x in m], pa.binary())], ["block", "at", "vec_id", "label", "v"])


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10) -> DataFrame:
    """Hard negatives of ``rows(vec_id, label, v)`` for the rows where
    ``is_anchor``: (anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score)."""
    spark = rows.sparkSession
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    packed = staged(rows.select("vec_id", "label", "v").mapInArrow(_pack_rows, _BLOCKS), "blocks")
    try:
        spark.conf.set(batch, "4")  # a row is a block or a pack
        number = staged(global_index(packed.select("block"), ["block"], out="number"), "numbers")
        blocks = packed.join(number, "block")
        anchors = packed.mapInArrow(_unpack_rows, "block long, at int, vec_id long, label long, v binary").where(is_anchor)
        anchors = staged(anchors, "anchors")
        packs = max(1, -(-anchors.count() // PACK))
        first = staged(_search(blocks, anchors.withColumn("windows", F.array().cast("array<decimal(38,0)>")), packs, positives, True), "positives")
        first = first.select("block", "at", F.col("found").alias("positives"))
        # scores are kept negated, so that the first ones sort first
        asked = anchors.join(first, ["block", "at"]).withColumn("windows", F.transform("positives", lambda p: (-p["score"]).cast("decimal(38,0)")))
        asked = staged(asked, "asked")
        found = staged(_search(blocks, asked, packs, negatives, False), "negatives")
    finally:
        spark.conf.set(batch, before)
    pos = asked.select("block", "at", F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("window", "p"))
    x = pos.join(found, ["block", "at", "window"]).select("anchor_id", "p", F.posexplode("found").alias("i", "n"))
    of = lambda s: F.when(~F.col(f"{s}.none"), F.col(f"{s}.id"))
    score = lambda s: F.greatest(F.least(-F.col(f"{s}.score"), F.lit(_LONG)), F.lit(-_LONG)).cast("long")
    return x.select("anchor_id", of("p").alias("positive_id"), (F.col("i") + 1).cast("int").alias("rank"), of("n").alias("negative_id"),
                    score("p").alias("positive_score"), score("n").alias("negative_score"))


def relabelled(rows: DataFrame) -> DataFrame:
    """``label`` becomes (label + 1) % 10 where ``vec_id`` is divisible by 7."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
