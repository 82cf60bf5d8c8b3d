"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact check.

Documents are sets of distinct n-word shingles (64-bit hashes).  Two
documents link when ``den * |A & B| >= num * |A | B|``.  The join finds
every link and returns the classes (connected components) of the link
graph without writing out the pairs of a class.

1. Size bands.  ``|A| >= t |B|`` holds for every link, so a pair is sought
   in the band of its larger set; a set enters its own band and the next
   ones whose smallest size it can reach.
2. Tiles.  In a band whose largest size is ``hi``, a link has at most
   ``d = 2 hi (1-t)/(1+t)`` elements on one side only.  The hash range is
   cut into ``m = d + 1 + x`` ranges, so linked sets agree entirely on at
   least ``1 + x`` of them.  A tile is (band, range, content of the range):
   a hash of several shingles, not of one, so that passages shared by many
   documents seldom fill a tile.  Ranges with fewer than ``c`` elements are
   left out by a set that has at most ``x`` of them (one of its agreeing
   ranges then remains); a set with more emits all its ranges.  Both cases
   together lose no link.
3. Candidates.  First every set of a tile is paired with the tile's
   smallest id, one row per distinct pair; the pairs are checked exactly.
   After the links found so have been merged, the tiles that still hold
   several classes are searched whole, once: bit counts of the bitmaps bound
   the overlap from above (``|A & B| <= |A| - popcount(a & ~b)``), and the
   sets that pairs of different classes above the bound connect are a group.
   A tile gives out the members of its groups, never its pairs; equal groups
   of several tiles are one.
4. Exact check of a group: overlaps of the sorted arrays, class by class, so
   that a group gives out a spanning forest of its links.  Every link lies in
   a class or in a group, so one search is whole.

Tiles with many or large sets are cut into blocks and searched block against
block, so that no task holds more than two blocks.

Edge cases: a null or empty text, or one without words, has an empty set
and links with nothing; texts with fewer than n words form one shingle;
repeated rows and equal sets share a class; a null ``doc_id`` is a document
like others but never names a class (the class of null ids alone is null).
Only ``doc_id`` and ``text`` are read; other columns are ignored.  An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layover.llm.common import UNSPACED, WordScanner, connected_components, mix64, prepare, release, shingles, staged, text_key

BAND_RATIO = 1.25
REMEMBERED = 200_000  # sets whose tiles a task has given out
BLOCK, BLOCK_HASHES = 1024, 1 << 20  # sets of a block of a large tile, and hashes in them
BROADCAST_KEYS = 400_000  # at most this many rows of up to three longs (9.6 MB) are broadcast


# ------------------------------------------------------------ band layout
@lru_cache(maxsize=None)
def _edges(limit: int) -> tuple[int, ...]:
    lows = [1]
    while lows[-1] <= limit:
        lows.append(max(lows[-1] + 1, math.ceil(lows[-1] * BAND_RATIO)))
    return tuple(lows)


@lru_cache(maxsize=None)
def _layout(lo: int, hi: int, num: int, den: int) -> tuple[int, int, int]:
    """(d, m, c) of the band of sizes lo..hi: differing elements, ranges and
    the least content of a range that a usual set emits."""
    d = 2 * hi * (den - num) // (den + num)
    if d == 0:
        return 0, 0, 0
    least = max(1, math.ceil(lo * num / den))
    for c in (4, 3, 2, 1):
        for m in range(d + 2, max(d + 4, (d + 1) * 13 // 10 + 3)):
            lam = least / m
            few = sum(math.exp(-lam) * lam**k / math.factorial(k) for k in range(c))
            if m * few + 3 * math.sqrt(m * few * (1 - few)) <= m - d - 1:
                return d, m, c
    return d, d + 2 + d // 8, 1


def _bands(n: int, num: int, den: int) -> Iterator[tuple[int, int, int]]:
    """(number, lo, hi) of the bands that a set of n elements enters."""
    lows = _edges(1 << (2 * n * den // num + 2).bit_length())
    b = int(np.searchsorted(lows, n, side="right")) - 1
    while lows[b] * num <= n * den:
        yield b, lows[b], lows[b + 1] - 1
        b += 1


@lru_cache(maxsize=4096)
def _cuts(m: int) -> np.ndarray:
    return np.array([(i << 64) // m for i in range(1, m)], np.uint64)


def tile_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Tiles of a set (sorted distinct hashes)."""
    n, out = len(s), []
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    for b, lo, hi in _bands(n, num, den):
        d, m, c = _layout(lo, hi, num, den)
        if not m:
            continue
        at = np.concatenate(([0], np.searchsorted(s, _cuts(m)), [n]))
        size, content = np.diff(at), sums[at[1:]] - sums[at[:-1]]
        part = np.arange(m, dtype=np.uint64)
        key = mix64(mix64(content + size.astype(np.uint64)) ^ mix64(part * np.uint64(0x10001) + np.uint64(b + 1)))
        usual = size >= c
        out.append(key if m - usual.sum() > m - d - 1 else key[usual])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Hashed bitmap of a set, two to four bits an element; its width is a
    power of two, so that a wider one can be folded onto a narrower one."""
    width = max(256, 1 << (2 * len(s) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(mix64(s) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits)


def _fold(b: np.ndarray, to: int) -> np.ndarray:
    while len(b) > to:
        b = b[: len(b) // 2] | b[len(b) // 2:]
    return b


def _bound(na, a, nb, b) -> np.ndarray:
    """Upper bound of the overlap of sets from their bitmaps (one against
    many, or many against many row by row)."""
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(na - only_a, nb - only_b)


# ------------------------------------------------------------- text passes
def _shingle_sets(texts: list, scanner: WordScanner, n: int) -> Iterator[np.ndarray]:
    """Sets of a batch.  Words are runs of bytes other than the six ASCII
    white space characters, A-Z lower-cased."""
    h, at = scanner.scan([(t or "").encode().lower() for t in texts])
    for i in range(len(texts)):
        yield shingles(h[at[i]:at[i + 1]], n)


def _i64(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _set_id(s: np.ndarray) -> int:
    h = np.array([np.sum(mix64(s ^ np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64) + np.uint64(len(s))], np.uint64)
    return int(_i64(mix64(h))[0])


def _sets_pass(n: int):
    def run(batches):
        scanner = WordScanner(UNSPACED)
        for b in batches:
            size, sid = [], []
            for s in _shingle_sets(b.column(2).to_pylist(), scanner, n):
                size.append(len(s))
                sid.append(_set_id(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(sid, pa.int64())], ["doc_id", "th", "n", "sid"])
    return run


def _tiles_pass(n: int, num: int, den: int):
    """One row per tile of a text: straight into the shuffle, never staged.  A
    task gives out the tiles of equal sets once (as long as it remembers them)."""
    def run(batches):
        scanner, known = WordScanner(UNSPACED), set()
        for b in batches:
            ids, keys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for s in _shingle_sets(b.column(0).to_pylist(), scanner, n):
                if not len(s) or (sid := _set_id(s)) in known:
                    continue
                if len(known) >= REMEMBERED:
                    known.clear()
                known.add(sid)
                keys.append(_i64(tile_keys(s, num, den)))
                ids.append(np.full(len(keys[-1]), sid, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys))], ["sid", "tile"])
    return run


def _bitmaps_pass(n: int):
    def run(batches):
        scanner = WordScanner(UNSPACED)
        for b in batches:
            sets = list(_shingle_sets(b.column(1).to_pylist(), scanner, n))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in sets], pa.int64()),
                 pa.array([bitmap(x).tobytes() for x in sets], pa.binary())], ["sid", "n", "bits"])
    return run


def _arrays_pass(n: int):
    def run(batches):
        scanner = WordScanner(UNSPACED)
        for b in batches:
            sets = [_i64(x) for x in _shingle_sets(b.column(1).to_pylist(), scanner, n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["sid", "arr"])
    return run


# ---------------------------------------------------------------- the join
def _reaches(overlap, na, nb, num: int, den: int):
    return den * overlap >= num * (na + nb - overlap)


def _bound_pass(num: int, den: int):
    """Pairs with sizes and bitmaps -> whether the bound lets them link."""
    def run(batches):
        for b in batches:
            na, nb = (b.column(i).to_numpy() for i in (2, 3))
            ok = np.zeros(len(na), bool)
            for i, (x, y) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                w = min(len(x), len(y))
                ok[i] = _reaches(_bound(na[i], _fold(x, w), nb[i], _fold(y, w)), na[i], nb[i], num, den)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok)], ["a", "b", "ok"])
    return run


def _exact_pass(num: int, den: int):
    """Pairs with sorted arrays -> whether they link."""
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                u, v = x.values.to_numpy(), y.values.to_numpy()
                ok.append(bool(_reaches(len(np.intersect1d(u, v, assume_unique=True)), len(u), len(v), num, den)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])
    return run


def _search(sid, n, label, side, bits, refuted, num, den) -> list[np.ndarray]:
    """Groups of one tile (or of two blocks of one): the sets that pairs of
    different classes above the bound connect."""
    width = min(map(len, bits))
    bm = np.stack([_fold(np.frombuffer(x, np.uint8), width) for x in bits])
    bm = np.ascontiguousarray(bm).view(np.uint64)
    known = [set(np.asarray(r).tolist()) if r is not None else () for r in refuted]
    names = sid.tolist()

    def near(i: int, js: np.ndarray) -> np.ndarray:
        js = js[(label[js] != label[i]) & ((side[js] != side[i]) | (side[i] == 2))
                & (np.minimum(n[js], n[i]) * den >= np.maximum(n[js], n[i]) * num)]
        if len(js):
            js = js[_reaches(_bound(n[i], bm[i], n[js], bm[js]), n[i], n[js], num, den)]
        return np.array([j for j in js.tolist() if names[j] not in known[i] and names[i] not in known[j]], np.int64)

    rest, out = np.argsort(sid, kind="stable"), []
    while len(rest):
        members, queue, rest = [rest[0]], [rest[0]], rest[1:]
        while queue and len(rest):
            js = near(queue.pop(), rest)
            if len(js):
                members += js.tolist()
                queue += js.tolist()
                rest = rest[~np.isin(rest, js)]
        if len(members) > 1:
            out.append(np.array(members))
    return out


def _group_links(sid, label, arrays: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Exact links of a group, enough to span its classes."""
    n = np.array([len(x) for x in arrays])
    at = np.concatenate(([0], np.cumsum(n)))
    hashes, number = np.unique(np.concatenate(arrays), return_inverse=True)
    number = [number[at[i]:at[i + 1]] for i in range(len(n))]
    mark, out = np.zeros(len(hashes), bool), []
    _, kind, size = np.unique(label, return_inverse=True, return_counts=True)
    rest = np.lexsort((sid, kind, size[kind]))  # small classes ask large ones
    while len(rest):
        same = kind[rest] == kind[rest[0]]
        queue, rest = rest[same].tolist(), rest[~same]
        while queue and len(rest):
            i = queue.pop()
            js = rest[np.minimum(n[rest], n[i]) * den >= np.maximum(n[rest], n[i]) * num]
            if not len(js):
                continue
            mark[number[i]] = True
            overlap = np.add.reduceat(mark[np.concatenate([number[j] for j in js])], np.cumsum(n[js]) - n[js], dtype=np.int64)
            mark[number[i]] = False
            js = js[_reaches(overlap, n[i], n[js], num, den)]
            if len(js):  # one pair for each class reached
                reached, first = np.unique(kind[js], return_index=True)
                out += [(int(sid[i]), int(sid[j])) for j in js[first]]
                gone = np.isin(kind[rest], reached)
                queue += rest[gone].tolist()
                rest = rest[~gone]
    return out


def _runs(batches, keys: int) -> Iterator[list[list]]:
    """Columns of the rows that agree in the first ``keys`` columns: rows are
    sorted by them, and a run never spans partitions."""
    held, key = [], None
    for b in batches:
        cols = [[x.values.to_numpy() if x.is_valid else None for x in c] if pa.types.is_list(c.type) else c.to_pylist() for c in b.columns]
        for r in zip(*cols, strict=True):
            if r[:keys] != key:
                if len(held) > 1:
                    yield list(zip(*held, strict=True))
                held, key = [], r[:keys]
            held.append(r)
    if len(held) > 1:
        yield list(zip(*held, strict=True))


def _batches(rows: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns of longs, in batches of some thousand rows."""
    held, count = [], 0
    for r in rows:
        held.append(r)
        count += len(r[0])
        if count >= 1 << 13:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)
            held, count = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)


def _search_pass(num: int, den: int):
    """Rows sorted by (tile, block pair) -> members of groups.  A group is named
    by the sum of its members, so that equal ones have the same name (different
    ones of one name would be checked together)."""
    def groups(batches):
        known = set()  # groups that this task has given out
        for _, _, *cols, bits, refuted in _runs(batches, 2):
            sid, n, label, side = (np.array(c, np.int64) for c in cols)
            for g in _search(sid, n, label, side, bits, refuted, num, den):
                name = int(np.sum(mix64(sid[g].view(np.uint64)), dtype=np.uint64).view(np.int64))
                if name not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known.add(name)
                    yield np.full(len(g), name, np.int64), sid[g], label[g]

    return lambda batches: _batches(groups(batches), ["name", "sid", "label"])


def _links_pass(num: int, den: int):
    """Rows(name, sid, label, arr) sorted by name -> links."""
    def links(batches):
        for _, sid, label, arrays in _runs(batches, 1):
            pairs = _group_links(np.array(sid, np.int64), np.array(label, np.int64), arrays, num, den)
            if pairs:
                yield tuple(np.array(pairs, np.int64).T)

    return lambda batches: _batches(links(batches), ["a", "b"])


def _search_tiles(rows: DataFrame, num: int, den: int) -> DataFrame:
    """rows(tile, sid, n, label, bits, refuted) -> members of groups (name, sid, label).  A
    tile of more than BLOCK sets or BLOCK_HASHES hashes is cut into blocks by the
    hash of the id; block pairs are searched on their own."""
    size = rows.groupBy("tile").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_HASHES)).cast("int").alias("blocks"))
    x = rows.join(size, "tile").withColumn("blk", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.withColumn("pair", F.least("blk", "other") * F.lit(1 << 20) + F.greatest("blk", "other"))
    # side 2: a block against itself; 0 and 1: the two blocks of a pair
    x = x.withColumn("side", F.when(F.col("blk") == F.col("other"), 2).when(F.col("blk") < F.col("other"), 0).otherwise(1))
    x = x.select("tile", "pair", "sid", "n", "label", "side", "bits", "refuted")
    x = x.repartition("tile", "pair").sortWithinPartitions("tile", "pair")
    return x.mapInArrow(_search_pass(num, den), "name long, sid long, label long").distinct()


def _some(df: DataFrame) -> DataFrame:
    """Broadcast staged keys of a checked number, else leave the join to Spark."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(sid, text) of the representatives ``keys(sid, kd, kt)``."""
    k = _some(keys)
    j = docs.join(k, docs["doc_id"].eqNullSafe(F.col("kd")) & (docs["th"] == F.col("kt")))
    return j.select("sid", "text")  # repeated rows give equal rows


def _link(tiles: DataFrame, feats: DataFrame, docs: DataFrame, keys: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Classes by exact links enough to span every one: tiles(tile, sid,
    leader) of tiles with several sets, feats(sid, n, bits) -> (sid,
    component) of the sets with a link.  Arrays are made for the sets of
    pairs that pass the bound, and only for them."""
    def arrays(ids: DataFrame) -> DataFrame:
        ids = staged(ids.distinct(), "ids")
        wanted = staged(keys.join(_some(ids), "sid", "left_semi"), "wanted")
        out = staged(_texts(docs, wanted).mapInArrow(_arrays_pass(n), "sid long, arr array<long>")
                     .dropDuplicates(["sid"]), "arrays")
        release(ids, wanted)
        return out

    # every set against the leaders of its tiles
    pairs = tiles.where("sid <> leader").select(F.col("leader").alias("a"), F.col("sid").alias("b")).distinct()
    fa = feats.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    fb = feats.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    j = pairs.join(fa, "a").join(fb, "b").select("a", "b", "na", "nb", "ba", "bb")
    open_ = staged(j.mapInArrow(_bound_pass(num, den), "a long, b long, ok boolean").where("ok").select("a", "b"), "bound")
    arr = arrays(open_.select(F.col("a").alias("sid")).union(open_.select("b")))
    x = (open_.join(arr.select(F.col("sid").alias("a"), F.col("arr").alias("xa")), "a")
         .join(arr.select(F.col("sid").alias("b"), F.col("arr").alias("xb")), "b").select("a", "b", "xa", "xb"))
    seen = staged(x.mapInArrow(_exact_pass(num, den), "a long, b long, ok boolean"), "verified")
    release(open_, arr)
    links = seen.where("ok").select("a", "b")
    labels = connected_components(links).withColumnRenamed("id", "sid")
    rows = (tiles.select("tile", "sid").join(labels, "sid", "left")
            .withColumn("label", F.coalesce("component", "sid")).drop("component"))
    # tiles with several classes, one of those with the same sets
    still = (rows.groupBy("tile").agg(
        F.min("label").alias("l0"), F.max("label").alias("l1"), F.count(F.lit(1)).alias("k"),
        F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("s0"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("s1"))
        .where("l0 <> l1").groupBy("k", "s0", "s1").agg(F.min("tile").alias("tile")).select("tile"))
    # leaders that a set does not link with; no more than it has tiles
    no = seen.where("not ok").groupBy(F.col("b").alias("sid")).agg(F.collect_set("a").alias("refuted"))
    rows = (rows.join(still, "tile", "left_semi").join(feats.select("sid", "n", "bits"), "sid")
            .join(no, "sid", "left"))
    groups = staged(_search_tiles(rows, num, den), "groups")
    arr = arrays(groups.select("sid"))
    x = groups.join(arr, "sid").select("name", "sid", "label", "arr").repartition("name").sortWithinPartitions("name")
    more = x.mapInArrow(_links_pass(num, den), "a long, b long")
    # the links so far as their stars
    out = connected_components(labels.select(F.col("sid").alias("a"), F.col("component").alias("b")).union(more))
    release(seen, groups, arr)
    return out.withColumnRenamed("id", "sid")


def jaccard_classes(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per row of ``docs``: ``doc_id``,
    ``th`` (text key), ``n_shingles``, ``class_id`` (smallest doc_id of the
    class) and ``rep_doc``, ``rep_th`` (the row key that represents the
    class: its smallest doc_id, nulls last, then smallest text key)."""
    spark = prepare(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), F.col("text"))
    sets = staged(d.mapInArrow(_sets_pass(n), "doc_id long, th long, n long, sid long"), "sets")
    # tiles that several sets share; a set's own copies count once
    one = Window.partitionBy("tile")
    tiles = (d.select("text").mapInArrow(_tiles_pass(n, num, den), "sid long, tile long")
             .withColumn("leader", F.min("sid").over(one)).withColumn("last", F.max("sid").over(one))
             .where("leader <> last").select("tile", "sid", "leader").distinct())
    tiles = staged(tiles, "tiles")
    keys = (sets.where("sid is not null").join(tiles.select("sid").distinct(), "sid", "left_semi")
            .groupBy("sid").agg(F.min_by(F.struct("doc_id", "th"), F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("k"))
            .select("sid", F.col("k.doc_id").alias("kd"), F.col("k.th").alias("kt")))
    keys = staged(keys, "keys")
    feats = staged(_texts(d, keys).mapInArrow(_bitmaps_pass(n), "sid long, n long, bits binary")
                   .dropDuplicates(["sid"]), "features")
    comp = _link(tiles, feats, d, keys, n, num, den)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    reps = sets.where("sid is not null").groupBy("sid").agg(F.min(first).alias("r"))
    reps = reps.join(comp, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    top = reps.groupBy("component").agg(F.min("r").alias("top"))
    reps = reps.join(top, "component").select("sid", F.col("top.doc_id").alias("rd"), F.col("top.th").alias("rt"))
    out = sets.select("doc_id", "th", "n", "sid").join(reps, "sid", "left")
    alone = F.col("sid").isNull()
    return out.select(
        "doc_id", "th", F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("rd")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("rd")).alias("rep_doc"),
        F.when(alone, F.col("th")).otherwise(F.col("rt")).alias("rep_th"), alone.alias("alone"))
