"""Personal data: base patterns and bootstrapped contextual extraction.

Base.  Four kinds are found by fixed forms: e-mail addresses, IPv4
addresses, card numbers (Luhn) and international phone numbers, leftmost
and without overlap within a kind.  Each scan is linear in the text, also
in long runs of digits or letters.

Bootstrapping.  Base matches are the seeds.  Every seed and every other
token with a digit or an at sign is an instance; the words around its
occurrences are its lexical patterns (two words before, one before and one
after, two before and one after).  Patterns and instances form a graph that
Spark scores in rounds, for each kind:

* a pattern's confidence is the mean score of its instances, smoothed by
  half an instance of score 0; it counts only with ``min_seeds`` different
  seeds of the kind, so a chance neighbour induces nothing, and if they are
  at least ``MIN_SHARE`` of its instances;
* an instance that is no seed scores ``1 - prod(1 - confidence)`` over its
  patterns.

Scores only grow from round to round.  Once no confidence changes by more
than ``TOLERANCE`` the occurrences of instances that stand in a pattern
of at least ``min_confidence`` and whose own score reaches it are added as
spans of the kind, where they touch no base span.

Edge cases: null text is empty and has no spans; spans are offsets in code
points, end exclusive; a base match that fails its check is dropped and
not tried again; an occurrence takes the kind of highest score (ties: the
first kind as listed); repeated rows get equal spans; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layover.llm.common import prepare, staged, text_key

KINDS = ["email", "ip", "card", "phone"]
BROADCAST_ROWS = 200_000
MIN_SHARE = 0.16  # of seeds among the instances of a pattern
TOLERANCE = 1e-4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")


def _emails(text: str):
    at = end = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at += 1


def _ips(text: str):
    for run in _DOTTED.finditer(text):
        parts, at = [], run.start()
        for p in run[0].split("."):
            parts.append((p, at))
            at += len(p) + 1
        i = 0
        while i + 3 < len(parts):
            four = parts[i:i + 4]
            if not all(p for p, _ in four):
                i += 1
                continue
            if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p, _ in four):
                yield four[0][1], four[3][1] + len(four[3][0])
            i += 4


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) in order."""
    text = text or ""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(s, 1, e) for s, e in _ips(text)] + [(s, 2, e) for s, e in _cards(text)]
        out += [(s, 3, e) for s, e in _phones(text)] if "+" in text else []
    return sorted(out)


_EDGE = ".,;:!?()[]{}<>\"'«»“”|*#&%$="


def _words(part: str) -> list[str]:
    return [re.sub(r"[0-9]", "0", w.lower().strip(_EDGE) or w) for w in part.split()]


def _context(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of an occurrence; words cut by the window are left out."""
    a, z = max(0, start - 120), min(len(text), end + 80)
    before, after = text[a:start], text[end:z]
    before = before if a == 0 or text[a - 1].isspace() else before.partition(" ")[2]
    after = after if z == len(text) or text[z].isspace() else after.rpartition(" ")[0]
    left, right = _words(before)[-2:], _words(after)[:1]
    out = []
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} _")
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    if len(left) == 2 and right:
        out.append(f"{left[0]} {left[1]} _ {right[0]}")
    return out


def occurrences(text: str | None, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, list[str]]]:
    """(start, end, kind or -1, hash of the value, patterns) of the seeds and
    of the tokens with a digit or an at sign that touch no seed."""
    text = text or ""
    taken, out, at = sorted((s, e) for s, _, e in base), [], 0
    value = lambda s, e: xxhash.xxh3_64_intdigest(text[s:e].lower().encode()) - (1 << 63)
    for s, k, e in base:
        out.append((s, e, k, value(s, e), _context(text, s, e)))
    i = 0
    while m := _MARK.search(text, at):
        s = m.start()
        while s > 0 and not text[s - 1].isspace():
            s -= 1
        gap = _SPACE.search(text, m.end())
        e = at = gap.start() if gap else len(text)
        while s < e and text[s] in _EDGE:
            s += 1
        while e > s and text[e - 1] in _EDGE:
            e -= 1
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s < e and not any(a < e and s < z for a, z in taken[i:i + 4]):
            out.append((s, e, -1, value(s, e), _context(text, s, e)))
    return out


def _pass(batches):
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    occ = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("value", pa.int64()),
                              ("patterns", pa.list_(pa.string()))]))
    for b in batches:
        spans, occs = [], []
        for t in b.column(2):
            t = t.as_py()
            base = base_spans(t)
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            occs.append([dict(zip(("start", "end", "kind", "value", "patterns"), o, strict=True)) for o in occurrences(t, base)]
                        if base or t and _MARK.search(t) else [])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, span), pa.array(occs, occ)],
                                         ["doc_id", "th", "base", "occ"])


_SPAN = "array<struct<start: int, kind: int, end: int>>"
_OCC = "array<struct<start: int, end: int, kind: int, value: bigint, patterns: array<string>>>"


def score_graph(edges: DataFrame, seeds: DataFrame, min_seeds: int) -> tuple[DataFrame, DataFrame]:
    """``edges(pattern, value)`` distinct, ``seeds(value, kind)`` distinct ->
    (patterns(pattern, kind, confidence), instances(value, kind, score))."""
    size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"))
    support = (edges.join(seeds, "value").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("support"))
               .where(F.col("support") >= min_seeds))
    known = staged(support.join(size, "pattern").where(F.col("support") >= MIN_SHARE * F.col("instances")), "patterns")
    scores = seeds.withColumn("score", F.lit(1.0))
    usable = staged(edges.join(known.select("pattern").distinct(), "pattern", "left_semi"), "edges")
    before = known.select("pattern", "kind", F.lit(0.0).alias("before"))
    while True:
        total = usable.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("total"))
        patterns = (known.join(total, ["pattern", "kind"])
                    .select("pattern", "kind", (F.col("total") / (F.col("instances") + 0.5)).alias("confidence")))
        patterns = staged(patterns, "confidence")
        change = patterns.join(before, ["pattern", "kind"]).agg(F.max(F.abs(F.col("confidence") - F.col("before")))).first()[0]
        before = patterns.withColumnRenamed("confidence", "before")
        induced = (usable.join(patterns, "pattern").join(seeds.select("value"), "value", "left_anti")
                   .groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score")))
        scores = staged(seeds.withColumn("score", F.lit(1.0)).unionByName(induced), "scores")
        if change is None or change <= TOLERANCE:
            return patterns, scores


def find(docs: DataFrame, min_seeds: int = 5, min_confidence: float = 0.9) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, th (text key), base
    and added (arrays of (start, kind, end); kind indexes KINDS)."""
    prepare(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), "text")
    rows = staged(d.mapInArrow(_pass, f"doc_id long, th long, base {_SPAN}, occ {_OCC}"), "spans")
    occ = rows.select("doc_id", "th", F.explode("occ").alias("o")).select("doc_id", "th", "o.*")
    edges = occ.select(F.explode("patterns").alias("pattern"), "value").distinct()
    seeds = staged(occ.where("kind >= 0").select("value", "kind").distinct(), "seeds")
    patterns, scores = score_graph(edges, seeds, min_seeds)
    # occurrences that are no seeds, in a pattern and of a value above the bound
    sure = patterns.where(F.col("confidence") >= min_confidence).select("pattern", F.col("kind").alias("found"))
    good = scores.where(F.col("score") >= min_confidence).select("value", F.col("kind").alias("found"), "score")
    added = (occ.where("kind < 0").select("doc_id", "th", "start", "end", "value", F.explode("patterns").alias("pattern"))
             .join(sure, "pattern").join(good, ["value", "found"])
             .groupBy("doc_id", "th", "start", "end")
             .agg(F.max_by("found", F.struct("score", -F.col("found"))).alias("kind"))
             .groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t"))
             .agg(F.collect_list(F.struct("start", "kind", "end")).alias("added")))
    added = staged(added, "added")
    if added.count() <= BROADCAST_ROWS:
        added = F.broadcast(added)
    j = rows.join(added, rows["doc_id"].eqNullSafe(F.col("d")) & (rows["th"] == F.col("t")), "left")
    return j.select("doc_id", "th", "base", F.coalesce("added", F.array().cast(_SPAN)).alias("added"))


def redacted(batches, columns: list[str], text: str):
    """Arrow batches of ``columns`` and ``_added``: the spans of ``text`` are
    replaced by the kind in angle brackets; overlapping spans become one."""
    at = columns.index(text)
    for b in batches:
        out = []
        for t, added in zip(b.column(at).to_pylist(), b.column(len(columns)).to_pylist(), strict=True):
            spans = base_spans(t) + [(s["start"], s["kind"], s["end"]) for s in added or ()]
            if t is None or not spans:
                out.append(t)
                continue
            parts, end = [], 0
            for s, k, e in sorted(spans):
                if s >= end:
                    parts += [t[end:s], f"<{KINDS[k].upper()}>"]
                end = max(end, e)
            out.append("".join(parts) + t[end:])
        cols = list(b.columns[:len(columns)])
        cols[at] = pa.array(out, b.schema.field(at).type)
        yield pa.RecordBatch.from_arrays(cols, columns)


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``found`` taken out of ``text``; the other
    columns are untouched, except that ``n_chars`` follows the text."""
    cols = docs.columns
    extra = found.where(F.size("added") > 0).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("added").alias("_added"))
    extra = staged(extra.dropDuplicates(["_d", "_t"]), "redactions")
    if extra.count() <= BROADCAST_ROWS:
        extra = F.broadcast(extra)
    j = docs.join(extra, docs["doc_id"].eqNullSafe(extra["_d"]) & (text_key(docs["text"]) == extra["_t"]), "left")
    j = j.select(*[docs[c] for c in cols], extra["_added"])
    out = j.mapInArrow(lambda bs: redacted(bs, cols, "text"), docs.schema)
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out
