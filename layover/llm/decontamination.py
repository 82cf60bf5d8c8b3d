"""Benchmark decontamination: CGK embedding, bit-sampling LSH, edit check.

Texts are normalised: lower-cased words with one space between.  An item of
L characters matches a document where some part of the document is within
``k = int(MAX_EDIT * L)`` edits (of characters) of the whole item.

Embedding
    A CGK random walk writes out the present character in each step and moves
    on with chance ``ADVANCE``, by a hash of (walk, step, character).  Walks
    from two aligned places agree until an edit, and often fall into step
    again after it, so edit distance becomes Hamming distance.  Measured on
    items with a fifth of their characters edited, walks over a whole item
    agree on 0.31 of their places (median; 0.11 for unrelated text), too few
    for one sample of a whole window.  So a window of an item's size is
    embedded piecewise, by a walk of up to ``STEPS`` steps from every place.
    (A walk that stays half of the time, as in the first description of the
    method, reads too few characters to tell texts of one language apart.)

Bit sampling
    Each of ``WALKS`` walks is a table: a sample of its steps, ``BITS`` of all
    ``STEPS``, is hashed; equal samples are a hit.  The places of an item are in
    every table; those of a document take turns, so that each place asks one
    table and neighbours ask different ones.  A hit's diagonal is the place
    in the document less the place in the item.  In a match, the walks
    that no edit touches hit on at most k + 1 neighbouring diagonals, so hits
    are summed over item-sized windows of diagonals: in buckets of at least
    that width, two neighbouring buckets at a time.  Where such a window has
    ``least`` hits, on as many places of the item and of the document, and as
    many within k + 1 diagonals, the item is a candidate.

``least`` is stated by recall: of ``DRAWS`` draws of k edited places (the most
that a match may have, at random among all) and of the walks' advance, the
share ``RECALL`` leaves that many walks whole.  Fewer edits, or edits next to
each other as in changed words, leave more.  The number of steps is the
largest whose ``least`` tells copies from other text.  Only many edits spread
more evenly than at random can leave less than ``least`` and be missed.

Every candidate is verified exactly: the least edit distance between the item
and any part of the document within the candidate's diagonals.

The items are taken in blocks of bounded size; each block is sent to the
tasks and held against all documents.

Edge cases: null, empty or wordless documents and items match nothing;
items of one word are sought like others (shorter than 5 characters: exact
copies, also inside words); equal items each report; repeated rows match
alike; whole texts of any length are searched; other columns are ignored; an
empty table on either side gives no matches.  Null ids are reported as they
are.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layover.llm.common import mix64, prepare, staged, text_key

BLOCK_ITEMS = 2_000  # items sent to the tasks at once
MAX_EDIT = 0.2
RECALL, DRAWS = 0.999, 4_000  # of copies with the most edits, at random places
STEPS, WALKS, BITS = 11, 2, 10  # of a walk; walks (tables); steps sampled
ADVANCE = 0.8  # chance of a step to the next character
LENGTHS = tuple(range(STEPS, 0, -1))  # steps that an item's walks may have
ENOUGH = 12  # hits that tell a copy from other text
CHUNK = 1 << 18  # characters searched at once; a chunk has a cost of its own
# words: runs of other characters than ASCII and general punctuation and spaces
_WORD = re.compile("[^\\x00-/:-@\\[-`{-\x7f\xa0-\xbf\u2000-\u206f\u3000-\u303f]+")
_IN_WORD = np.array([bool(_WORD.match(chr(c))) for c in range(0x3041)])
_CHARACTER = mix64(np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_STAY = np.uint64(int((1 - ADVANCE) * 2 ** 64))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised texts in a row, a space after every word: the characters,
    where each stands in its lower-cased text, the bounds of the texts, and
    whether a character belongs to a word."""
    low = [t.lower() for t in texts]
    codes = _codes("\n".join(low) + "\n")
    word = _IN_WORD[np.minimum(codes, 0x3040)]
    kept = np.flatnonzero(word | np.concatenate(([False], word[:-1])))
    offsets = np.cumsum([0] + [len(t) + 1 for t in low])
    word = word[kept]
    bounds = np.searchsorted(kept, offsets)
    return np.where(word, codes[kept], 32).astype(np.uint32), kept - np.repeat(offsets[:-1], np.diff(bounds)), bounds, word


def _string(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


@cache
def _places(walk: int) -> list[int]:
    """The walk's sampled steps: the first, and others at random."""
    rng = np.random.default_rng(walk)
    return [0, *sorted((rng.choice(STEPS - 1, BITS - 1, replace=False) + 1).tolist())]


def samples(codes: np.ndarray, start: np.ndarray, walk: int, lengths: set[int]) -> dict[int, np.ndarray]:
    """Bit samples of the embeddings of ``codes`` from each ``start``: for each
    of the ``lengths`` those of so many steps (a walk is the start of a longer one)."""
    h = np.concatenate((_CHARACTER[codes & 0xFFFF], np.zeros(STEPS + 1, np.uint64)))
    odd = mix64(np.arange(1, STEPS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(walk * 7919 + 1)) | np.uint64(1)
    places, found = _places(walk), {}
    at, out = start.astype(np.int64), np.full(len(start), walk + 1, np.uint64)
    here = np.empty(len(start), np.uint64)
    for j in range(max(lengths)):
        np.take(h, at, out=here, mode="clip")  # never beyond the end; "raise" would buffer
        if j in places:
            out ^= here
            out *= _MIX
        if j + 1 in lengths:
            found[j + 1] = out.copy()
        here *= odd[j]
        at += here >= _STAY
    return found


def _least(length: int, memory: dict) -> tuple[int, int]:
    """(steps, hits that a copy of an item of so many characters has at least);
    lengths are rounded down, and beyond 1,024 the hits of that many repeat."""
    n = length if length < 64 else length >> length.bit_length() - 6 << length.bit_length() - 6
    n, times = min(n, 1024), max(1, length // 1024)
    if n not in memory:
        k = int(MAX_EDIT * n) if n < 64 else -int(-MAX_EDIT * n // 1)
        rng = np.random.default_rng(n)
        place = rng.random((DRAWS, n))
        edited = place <= np.partition(place, k - 1, axis=1)[:, k - 1:k] if k else np.zeros((DRAWS, n), bool)
        before = np.concatenate((np.zeros((DRAWS, 1), np.int32), np.cumsum(edited, axis=1, dtype=np.int32)), axis=1)
        turn = (np.arange(n) + rng.integers(WALKS, size=(DRAWS, 1))) % WALKS
        for steps in [x for x in LENGTHS if x <= max(2, n)]:
            whole = np.zeros(DRAWS, np.int64)
            for walk in range(WALKS):
                last = max(p for p in _places(walk) if p < steps)
                read = np.arange(n) + rng.binomial(last, ADVANCE, size=(DRAWS, n)) + 1
                clean = np.take_along_axis(before, np.minimum(read, n), axis=1) == before[:, :-1]
                whole += (clean & (read <= n) & (turn == walk)).sum(axis=1)
            least = int(np.quantile(whole, 1 - RECALL, method="lower"))
            if least >= max(1, min(ENOUGH, n // 8)):
                break
        memory[n] = steps, max(least, 1)
    steps, least = memory[n]
    return steps, least * times


def edit_match(item: str, text: str, allowed: int) -> tuple[int, int, int] | None:
    """(distance, start, end): the part of ``text`` of least edit distance to
    the whole item; the first end, then the longest part (bit-parallel).
    None if that distance is more than allowed."""
    def scan(pattern: str, s: str, free_start: bool) -> list[int]:
        m = len(pattern)
        masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(pattern):
            masks[c] |= 1 << i
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score, scores, mask, carry = full, 0, m, [m], masks.get, 0 if free_start else 1
        for c in s:
            eq = mask(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv) & full, pv & xh
            if ph & top:  # never both
                score += 1
            elif mh & top:
                score -= 1
            ph = (ph << 1) & full | carry
            mh = (mh << 1) & full
            pv, mv = mh | ~(xv | ph) & full, ph & xv
            scores.append(score)
        return scores

    if item and (start := text.find(item)) >= 0:  # no edit: the scans would end here
        return 0, start, start + len(item)
    ends = scan(item, text, True)
    best = min(ends)
    if best > allowed:
        return None
    end = ends.index(best)
    starts = scan(item[::-1], text[:end][::-1], False)
    back = max(i for i, d in enumerate(starts) if d == best)
    return best, end - back, end


def _index(items: list[str]) -> dict:
    """By number of steps: a table for each walk with the samples of all places
    of the (normalised) items in slots, and where the buckets of each item lie
    among all buckets of a chunk."""
    longest = max(map(len, items), default=0)
    chunk = max(CHUNK, 4 * longest)
    overlap = longest + int(MAX_EDIT * longest) + STEPS
    by: dict[int, list[tuple[int, int]]] = defaultdict(list)
    memory: dict = {}
    for k, text in enumerate(items):
        if text:
            steps, least = _least(len(text), memory)
            by[steps].append((k, least))
    out = {}
    for steps, group in by.items():
        length = np.array([len(items[k]) for k, _ in group])
        # a bucket is 2^shift diagonals, at least one more than there may be edits
        shift = np.array([int(MAX_EDIT * n).bit_length() for n in length.tolist()])
        buckets = ((chunk + overlap + longest) >> shift) + 2
        base = np.cumsum(buckets) - buckets
        tables = []
        for walk in range(WALKS):
            h = [samples(c := _codes(items[k]), np.arange(len(c)), walk, {steps})[steps] for k, _ in group]
            h, at = np.concatenate(h), np.concatenate([np.arange(len(x)) for x in h])
            bits = min(24, max(10, int(16 * len(h)).bit_length()))
            slot = (h >> np.uint64(64 - bits)).view(np.int64)
            o = np.argsort(slot, kind="stable")
            first = np.concatenate(([0], np.cumsum(np.bincount(slot, minlength=1 << bits)))).astype(np.int32)
            number = np.repeat(np.arange(len(group)), length)[o]
            tables.append({"bits": bits, "used": np.diff(first) > 0, "first": first, "back": (longest - at[o]).astype(np.int32),
                           "base": base[number].astype(np.int32), "shift": shift[number].astype(np.int32)})
        out[steps] = {"tables": tables, "least": np.repeat([x for _, x in group], buckets), "few": min(x for _, x in group), "starts": base, "ends": base + buckets - 1,
                      "shifts": shift, "lengths": length, "items": np.array([k for k, _ in group])}
    return {"longest": longest, "chunk": chunk, "overlap": overlap, "by": out}


def _hits(found: np.ndarray, walk: int, x: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, place of the document, longest less place of the item) of the
    hits of a walk's samples, sorted by place."""
    slot = (found >> np.uint64(64 - x["bits"])).view(np.int64)
    at = np.flatnonzero(x["used"].take(slot))
    slot = slot[at]
    left = x["first"][slot]
    n = x["first"][slot + 1] - left
    place = np.repeat((at * WALKS + walk).astype(np.int32), n)
    e = np.arange(len(place), dtype=np.int32) + np.repeat(left - (np.cumsum(n, dtype=np.int32) - n), n)
    back = x["back"][e]
    return ((place + back) >> x["shift"][e]) + x["base"][e], place, back


def _spans(codes: np.ndarray, index: dict) -> list[np.ndarray]:
    """Candidates: (item, first and end place of the text to search)."""
    found, longest = [], index["longest"]
    for lo in range(0, len(codes), index["chunk"]):
        part = codes[lo:lo + index["chunk"] + index["overlap"]]
        sampled = [samples(part, np.arange(walk, len(part), WALKS), walk, set(index["by"])) for walk in range(WALKS)]
        for steps, x in index["by"].items():
            walks = [_hits(sampled[walk][steps], walk, table) for walk, table in enumerate(x["tables"])]
            if sum(len(bucket) for bucket, _, _ in walks) < x["few"]:
                continue
            once = []
            for bucket, place, _ in walks:
                # a place of the document counts once in a bucket
                fresh = np.ones(len(bucket), bool)
                fresh[1:] = (bucket[1:] != bucket[:-1]) | (place[1:] != place[:-1])
                once.append(bucket[fresh])
            two = np.bincount(np.concatenate(once), minlength=len(x["least"]))
            two[:-1] += two[1:]  # numpy buffers operands that overlap
            two[x["ends"]] = 0
            pair = np.flatnonzero(two >= x["least"])
            if not len(pair):
                continue
            number = np.searchsorted(x["starts"], pair, "right") - 1
            length, shift = x["lengths"][number], x["shifts"][number]
            start = ((pair - x["starts"][number]) << shift) - longest  # first diagonal
            # as many places of the item and of the document
            known = np.full(len(two) + 1, -1, np.int32)
            known[pair] = np.arange(len(pair))
            inside = np.zeros(len(two) + 1, bool)  # buckets of a pair
            inside[pair] = inside[pair + 1] = True
            size = length + (2 << shift)
            room = np.cumsum(size) - size
            both = np.zeros((2, len(pair)), np.int64)
            # hits by diagonal, with room after the last for a window of k + 1
            wide, edits = 2 << shift, (MAX_EDIT * length).astype(int) + 1
            line = np.cumsum(wide + edits) - (wide + edits)
            diagonal = np.zeros(int((wide + edits).sum()), np.int64)
            for bucket, place, back in walks:
                near = np.flatnonzero(inside[bucket])
                mine, theirs = (np.zeros(int(size.sum()), bool) for _ in range(2))
                b, i, p = bucket[near], longest - back[near], place[near]
                for c in (known[b], known[b - 1]):
                    in_pair = np.flatnonzero(c >= 0)
                    c = c[in_pair]
                    mine[room[c] + i[in_pair]] = True
                    theirs[room[c] + p[in_pair] - start[c]] = True
                    diagonal += np.bincount(line[c] + p[in_pair] - i[in_pair] - start[c], minlength=len(diagonal))
                both += [np.add.reduceat(side, room, dtype=np.int64) for side in (mine, theirs)]
            upto = np.concatenate(([0], np.cumsum(diagonal)))
            end = np.minimum(np.arange(len(diagonal)) + np.repeat(edits, wide + edits), len(diagonal))
            densest = np.maximum.reduceat(upto[end] - upto[:-1], line)
            ok = np.minimum(both.min(axis=0), densest) >= x["least"][pair]
            found.append(np.column_stack([x["items"][number], lo + start, lo + start + size + (MAX_EDIT * length).astype(int)])[ok])
    return found


def _matches(texts: list[str], items: list[str], index: dict):
    """(document, item, distance, start, end): the best place of each item in
    each document."""
    codes, at, bounds, word = _normal(texts)
    found = _spans(codes, index)
    if not found:
        return
    found = np.concatenate(found)
    parts: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    first = np.maximum(np.searchsorted(bounds, np.maximum(found[:, 1], 0), "right") - 1, 0)
    for (k, lo, hi), d in zip(found.tolist(), first.tolist(), strict=True):
        while d < len(texts) and bounds[d] < hi:  # diagonals may reach over several documents
            a, z = max(lo, int(bounds[d])), min(hi, int(bounds[d + 1]) - 1)  # without the last space
            if a < z:
                parts[d, k].append((a, z))
            d += 1
    for (d, k), spans in sorted(parts.items()):
        merged: list[list[int]] = []
        for a, z in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(z, merged[-1][1])
            else:
                merged.append([a, z])
        best = None
        for a, z in merged:
            match = edit_match(items[k], _string(codes[a:z]), int(MAX_EDIT * len(items[k])))
            if match and (best is None or match[0] < best[0]):
                best = match[0], a + match[1], a + match[2]
        if best:
            distance, a, z = best
            z = max(a + 1, z)
            while a < z - 1 and not word[a]:
                a += 1
            while z - 1 > a and not word[z - 1]:
                z -= 1
            while a > bounds[d] and word[a - 1]:  # whole words
                a -= 1
            while z < bounds[d + 1] and word[z]:
                z += 1
            a, z = int(at[a]), int(at[z - 1]) + 1
            t = texts[d]
            if len(t.lower()) != len(t):  # back to the code points of the text
                of = np.repeat(np.arange(len(t)), [len(c.lower()) for c in t])
                a, z = int(of[a]), int(of[z - 1]) + 1
            yield d, k, distance, a, z


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Matches: doc_id, th (text key), item_id, distance, length (of the
    normalised item), start, end (code points of the document) - the best
    place of each item in each document."""
    spark = prepare(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), "text")
    kind = "doc_id long, th long, item_id long, distance int, length int, start int, end int"
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    blocks = -(-bench.count() // BLOCK_ITEMS)
    out = spark.createDataFrame([], kind)
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))
    for block in range(blocks):
        items = [tuple(r) for r in bench.where(block_of == block).orderBy("item_id", "text").collect()]
        plain = [" ".join(_WORD.findall(text.lower())) for _, text in items]
        sent = spark.sparkContext.broadcast(([i for i, _ in items], plain, _index(plain)))
        out = out.union(d.mapInArrow(_search(sent), kind))
    return staged(out, "matches")


def _search(sent):
    def run(batches):
        ids, items, index = sent.value
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            rows = [(b.column(0)[d].as_py(), b.column(1)[d].as_py(), ids[k], distance, len(items[k]), start, end)
                    for d, k, distance, start, end in _matches(texts, items, index)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 3 else pa.int32()) for i, c in enumerate(cols)],
                                             ["doc_id", "th", "item_id", "distance", "length", "start", "end"])
    return run


def matched_documents(matches: DataFrame) -> DataFrame:
    """One row key (doc_id, th) per document with a match."""
    return matches.select("doc_id", "th").distinct()
