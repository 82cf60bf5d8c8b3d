"""Quality rules: isolation forest on rule statistics.

One pass over the texts counts the rule statistics of every document; a
statistic enters as the excess over its rule's limits (``LIMITS``), so
that ordinary variation within them is no anomaly.  An isolation forest is
grown on a sample of these rows (``trees`` trees, each
on ``leaf_rows`` of at most ``sample_rows`` rows with the least hashes):
every node splits a random statistic at a random place, and a document that
few splits separate from the rest is anomalous.  The score is
``2^(-E[path length] / c(leaf_rows))``.  The sample is the method's own and
bounded by its parameters; every document is scored.

A tree splits a statistic only as far as it varies in the tree's rows, so a
kind of junk must not depend on luck to be among them: all documents are
sorted into strata by statistic and power of two of the excess, and every
tree draws one of the strata that exist for each statistic and, if none of
its rows leaves the limits as far, takes a row of that stratum in.  A kind
of junk is so found however rare it is among however many documents.

The threshold is calibrated on all labelled rows (``labels``: doc_id,
quality 0 or 1): counts of both classes by score, in a thousand steps,
give the threshold that rejects most bad rows while it loses at most
``clean_loss`` of the good ones (ties: the higher threshold), half way to
the next labelled row below.

A document is kept if it passes the base rules and scores below the
threshold.

Edge cases: a null text has no words and fails the base; statistics of
documents without words or lines are 0; null labels and labels of unknown
documents are ignored; without labels of both classes the threshold is
``DEFAULT_THRESHOLD``; repeated rows score alike and ties at the threshold
are kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layover.llm.common import WordHash, mix64, prepare, staged, text_key

DEFAULT_THRESHOLD = 0.65
STEPS = 1000
LEVELS = (-8, 8)  # least and greatest power of two of an excess
STRATUM_ROWS = 16  # kept of a statistic and power
_SPACE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"
_LOUD = b"!?"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower",
          "n_digits", "n_loud", "n_distinct"]
FEATURES = ["word_length", "symbols", "dup_lines", "repeat_words", "upper", "digits", "loud", "sameness"]

# Limits of the rules: code points a word; symbols a word; share of repeated
# lines; share of words in repeated windows; share of capitals among A-Z and
# a-z; digits among the code points of words; ! and ? a word; how far the
# logarithm of the distinct words stays below that of all words.
LIMITS = {"word_length": (3, 10), "symbols": (0, 0.1), "dup_lines": (0, 0.3), "repeat_words": (0, 0.3), "upper": (0, 0.3),
          "digits": (0, 0.2), "loud": (0, 0.2), "sameness": (0, 0.15)}


def _count(b: bytes, those: bytes) -> int:
    return len(b) - len(b.translate(None, those))


def rule_counts(text: str | None, cache: WordHash) -> tuple[int, ...]:
    """COUNTS of a text; words are runs of other bytes than ASCII white space."""
    text = text or ""
    b = text.encode()
    words = b.split()
    n = len(words)
    lines = [x for x in b.split(b"\n") if x.strip(_SPACE)]
    repeated = distinct = 0
    if n:
        h = cache.array(words)
        distinct = len(np.unique(h))
        if n > 3:
            g = mix64(mix64(mix64(h[:-2]) ^ h[1:-1]) ^ h[2:])
            _, back, times = np.unique(g, return_inverse=True, return_counts=True)
            twice = times[back] > 1
            inside = np.zeros(n, bool)
            for k in range(3):
                inside[k:n - 2 + k] |= twice
            repeated = int(inside.sum())
    return (n, len(text) - _count(b, _SPACE), _count(b, _SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines),
            _count(b, _UPPER), _count(b, _LOWER), _count(b, _DIGITS), _count(b, _LOUD), distinct)


def _features(c: np.ndarray) -> np.ndarray:
    """COUNTS (rows x columns) -> FEATURES: by how much a statistic leaves
    the limits of its rule, 0 within them."""
    n, chars, symbols, dup, rep, lines, up, low, digits, loud, distinct = c.astype(np.float64).T
    per = lambda a, b: a / np.maximum(b, 1)
    values = np.column_stack([per(chars, n), per(symbols, n), per(dup, lines), per(rep, n), per(up, up + low), per(digits, chars),
                              per(loud, n), 1 - per(np.log1p(distinct), np.log1p(n))])
    low, high = (np.array([LIMITS[f][i] for f in FEATURES]) for i in (0, 1))
    return np.maximum(0, np.maximum(low - values, values - high)) / high


def _mean_path(n: float) -> float:
    """Mean path of an unsuccessful search in a tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(rows: np.ndarray, trees: int, leaf_rows: int, seed: int, strata: list[dict[int, np.ndarray]] | None = None) -> dict:
    """Forest as arrays (trees x nodes): feature (-1: leaf), cut, left, path.
    ``strata``: for each feature, power of two of the excess -> rows."""
    rng = np.random.default_rng(seed)
    size = min(leaf_rows, len(rows))
    limit = math.ceil(math.log2(max(2, size)))
    nodes = 2 ** (limit + 1)
    feature, cut, path = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees):
        drawn = rows[rng.choice(len(rows), size, replace=False)]
        for f, levels in enumerate(strata or []):
            if levels and f < size:
                level = int(rng.choice(sorted(levels)))
                if drawn[:, f].max() < 2.0 ** level:
                    drawn[f] = levels[level][rng.integers(len(levels[level]))]
        todo = [(1, drawn, 0)]
        while todo:  # node k has children 2k and 2k + 1
            k, x, depth = todo.pop()
            low, high = x.min(axis=0), x.max(axis=0)
            can = np.flatnonzero(high > low)
            if depth >= limit or len(x) <= 1 or not len(can):
                path[t, k] = depth + _mean_path(len(x))
                continue
            f = int(rng.choice(can))
            c = rng.uniform(low[f], high[f])
            feature[t, k], cut[t, k] = f, c
            below = x[:, f] < c
            todo += [(2 * k, x[below], depth + 1), (2 * k + 1, x[~below], depth + 1)]
    return {"feature": feature, "cut": cut, "path": path, "depth": limit, "norm": max(_mean_path(size), 1e-9)}


def path_scores(x: np.ndarray, forest: dict) -> np.ndarray:
    total = np.zeros(len(x))
    for feature, cut, path in zip(forest["feature"], forest["cut"], forest["path"], strict=True):
        at = np.ones(len(x), np.int64)
        for _ in range(forest["depth"]):
            f = feature[at]
            go = f >= 0
            if not go.any():
                break
            right = x[np.arange(len(x)), np.maximum(f, 0)] >= cut[at]
            at = np.where(go, 2 * at + right, at)
        total += path[at]
    return 2.0 ** (-total / len(forest["feature"]) / forest["norm"])


def _rows(b, first: int) -> np.ndarray:
    return np.column_stack([b.column(first + i).to_numpy() for i in range(len(COUNTS))]).reshape(-1, len(COUNTS))


def _strata(stats: DataFrame, seed: int) -> list[dict[int, np.ndarray]]:
    """For each feature, power of two of the excess -> features of the rows
    with the least hash in each of STRATUM_ROWS parts, over all rows."""
    kinds = ", ".join(f"{c} long" for c in COUNTS)

    def least(batches):
        for b in batches:
            counts, h = _rows(b, 1), b.column(0).to_numpy()
            x, picked = _features(counts), []
            for f in range(len(FEATURES)):
                at = np.flatnonzero(x[:, f] > 0)
                at = at[np.argsort(h[at], kind="stable")]
                level = np.clip(np.floor(np.log2(x[at, f])), *LEVELS).astype(np.int64)
                _, first = np.unique(level * STRATUM_ROWS + h[at] % STRATUM_ROWS, return_index=True)
                picked += [(f, int(level[i]), int(at[i])) for i in first]
            f, level, at = (np.array([p[i] for p in picked], np.int64) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (f, level, h[at], *counts[at].T)], ["feature", "level", "h", *COUNTS])

    d = stats.select(F.xxhash64("doc_id", "th", F.lit(seed)).alias("h"), *COUNTS)
    rows = (d.mapInArrow(least, f"feature long, level long, h long, {kinds}")
            .groupBy("feature", "level", F.pmod("h", F.lit(STRATUM_ROWS)).alias("part"))
            .agg(F.min(F.struct("h", *COUNTS)).alias("r")).select("feature", "level", "r.*")
            .orderBy("feature", "level", "h", *COUNTS).toArrow())  # at most features x levels x STRATUM_ROWS
    out: list[dict[int, np.ndarray]] = [{} for _ in FEATURES]
    if rows.num_rows:
        x = _features(np.column_stack([rows[c].to_numpy() for c in COUNTS]))
        feature, level = rows["feature"].to_numpy(), rows["level"].to_numpy()
        for f, v in sorted(set(zip(feature.tolist(), level.tolist(), strict=True))):
            out[f][v] = x[(feature == f) & (level == v)]
    return out


def calibrate(steps: dict[int, tuple[int, int]], clean_loss: float) -> float:
    """Threshold from {score step: (bad rows, good rows)}."""
    bad, good = (sum(v[i] for v in steps.values()) for i in (0, 1))
    if not bad or not good:
        return DEFAULT_THRESHOLD
    best, caught, lost, most = DEFAULT_THRESHOLD, 0, 0, -1
    order = sorted(steps, reverse=True)
    for s, below in zip(order, [*order[1:], 0], strict=True):
        caught, lost = caught + steps[s][0], lost + steps[s][1]
        if lost > clean_loss * good:
            break
        if caught > most:  # half way to the next labelled row
            best, most = (s + below + 1) / 2 / STEPS, caught
    return best


def judge(docs: DataFrame, labels: DataFrame, trees: int = 100, leaf_rows: int = 256, sample_rows: int = 4096,
          clean_loss: float = 0.005, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, COUNTS, base_failed, score, threshold,
    kept."""
    prepare(docs.sparkSession)

    def count(batches):
        cache = WordHash()
        for b in batches:
            cols = list(zip(*(rule_counts(t.as_py(), cache) for t in b.column(2)), strict=True)) or [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "th", *COUNTS])

    kinds = ", ".join(f"{c} long" for c in COUNTS)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), "text")
    stats = staged(d.mapInArrow(count, f"doc_id long, th long, {kinds}"), "statistics")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    # the forest describes documents that the base rules let pass
    sample = (stats.where("not base_failed").orderBy(F.xxhash64("doc_id", "th", F.lit(seed)), "doc_id", "th")
              .limit(sample_rows).select(*COUNTS).toArrow())
    x = _features(np.column_stack([sample[c].to_numpy() for c in COUNTS])) if sample.num_rows else np.zeros((1, len(FEATURES)))
    strata = _strata(stats.where("not base_failed"), seed)
    sent = docs.sparkSession.sparkContext.broadcast(grow(x, trees, leaf_rows, seed, strata))

    def score(batches):
        for b in batches:
            s = path_scores(_features(_rows(b, 2)), sent.value) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, "score"])

    scored = staged(stats.mapInArrow(score, f"doc_id long, th long, {kinds}, base_failed boolean, score double"), "scored")
    marked = (scored.where("not base_failed").join(
        labels.select(F.col("doc_id").cast("long").alias("id"), "quality").where("quality in (0, 1)"), F.col("doc_id") == F.col("id"))
        .groupBy(F.floor(F.col("score") * STEPS).cast("int").alias("step"))
        .agg(F.sum(1 - F.col("quality")).alias("bad"), F.sum("quality").alias("good")).collect())  # at most STEPS + 1 rows
    cut = calibrate({r["step"]: (int(r["bad"]), int(r["good"])) for r in marked}, clean_loss)
    return scored.select("doc_id", *COUNTS, "base_failed", "score", F.lit(cut).alias("threshold"),
                         (~F.col("base_failed") & (F.col("score") < F.lit(cut))).alias("kept"))
