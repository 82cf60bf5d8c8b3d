"""Language identification: sparse multinomial logistic regression.

Features are character n-grams (1 to 3) of the lower-cased text, in which
every run of other characters than letters is one space, hashed to
``2^15`` buckets.  A text is the L2-normalised vector of
``(1 + ln tf) * idf``; document frequencies are counted over all learning
rows, whole texts.

The model is trained by follow-the-regularised-leader (proximal, one rate a
coordinate) with elastic-net penalties: the L1 part keeps a weight at zero
until its evidence exceeds it, so the model is sparse.  It is fitted on at
most ``sample_rows`` learning rows in expectation, the same number from each
language (chosen by a hash of ``doc_id``); a fifth of them is kept apart to
fit the temperature that calibrates the scores.

Every row is then predicted from its text alone.

Edge cases: a text that is null or has no letter is ``und`` with score 0;
rows without a language or a ``doc_id`` are predicted but not learnt from;
with no learning row at all every text is ``und`` with score 0; with one
language every text with a letter has that language; repeated rows are
predicted alike; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layover.llm.common import prepare

BITS = 15
DIM = 1 << BITS
UNDECIDED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], bool)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, counts) of a text's n-grams; None without any letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    c = np.concatenate(([np.uint32(32)], c[keep], [np.uint32(32)]))
    g, grams = c * np.uint32(0x9E3779B1), []
    for k in range(3):
        if k:
            g = (g[:-1] ^ (g[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[k:]
        grams.append(((g ^ (g >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS))
    n = np.bincount(np.concatenate(grams), minlength=DIM)
    at = np.flatnonzero(n)
    return at, n[at]


def _vector(counts: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = counts
    x = (1 + np.log(n)) * idf[at]
    return at, x / max(np.linalg.norm(x), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Multinomial FTRL-proximal; column DIM of the weights is the bias,
    which is not penalised."""

    def __init__(self, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((classes, DIM + 1)), np.zeros((classes, DIM + 1))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, bias = self.z[:, at], np.asarray(at) == DIM
        l1, l2 = np.where(bias, 0.0, self.l1), np.where(bias, 0.0, self.l2)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[:, at])) / self.alpha + l2)
        return np.where(np.abs(z) > l1, w, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, DIM), np.append(x, 1.0)
        w = self.weights(at)
        p = _softmax(w @ x)
        p[label] -= 1
        g = np.outer(p, x)
        n = self.n[:, at]
        self.z[:, at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[:, at] = n + g * g


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Least mean log loss over a grid of temperatures, then refined."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
    grid = np.geomspace(0.05, 20, 60)
    best = grid[int(np.argmin([loss(t) for t in grid]))]
    fine = np.geomspace(best / 1.15, best * 1.15, 30)
    return float(fine[int(np.argmin([loss(t) for t in fine]))])


def fit(docs: DataFrame, learn: Column, lang: str = "lang", sample_rows: int = 4000, epochs: int = 3, alpha: float = 2.0,
        beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 7) -> dict:
    """Model from the rows of ``docs(doc_id, text, lang)`` where ``learn``."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("id"), F.col(lang).alias("label"), F.col("text").alias("body"))
    sizes = {r["label"]: r["k"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("k")).collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": []}

    def frequencies(batches):
        df, docs_seen = np.zeros(DIM, np.int64), 0
        for b in batches:
            for t in b.column(0):
                if (c := ngram_counts(t.as_py())) is not None:
                    df[c[0]] += 1
                    docs_seen += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(df[at], docs_seen))], ["bucket", "k"])

    counted = (rows.select("body").mapInArrow(frequencies, "bucket long, k long")
               .groupBy("bucket").agg(F.sum("k").alias("k")).collect())  # at most DIM + 1 rows
    df, total = np.zeros(DIM), 0
    for r in counted:
        if r["bucket"] < 0:
            total = r["k"]
        else:
            df[r["bucket"]] = r["k"]
    idf = np.log((1 + total) / (1 + df)) + 1

    per = sample_rows / len(langs)
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    take = F.coalesce(*[F.when(F.col("label") == la, part < per / k) for la, k in sizes.items()], F.lit(False))
    number = {la: i for i, la in enumerate(langs)}

    def features(batches):
        for b in batches:
            y, at, n = [], [], []
            for label, t in zip(b.column(0), b.column(1), strict=True):
                if (c := ngram_counts(t.as_py())) is not None:
                    y.append(number[label.as_py()])
                    at.append(c[0].astype(np.int32))
                    n.append(c[1].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], ["y", "at", "n"])

    got = rows.where(take).orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").select("label", "body")
    got = got.mapInArrow(features, "y int, at array<int>, n array<int>").toArrow()
    xs = [_vector((a.values.to_numpy(), n.values.to_numpy()), idf) for a, n in zip(got["at"], got["n"], strict=True)]
    ys = got["y"].to_numpy()
    model = Ftrl(len(langs), alpha, beta, l1, l2)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(xs))
    held, used = order[: len(xs) // 5], order[len(xs) // 5:]
    for _ in range(epochs):
        for i in rng.permutation(used):
            model.learn(*xs[i], int(ys[i]))
    w = model.weights(np.arange(DIM + 1))
    logits = np.array([w[:, xs[i][0]] @ xs[i][1] + w[:, DIM] for i in held]).reshape(len(held), len(langs))
    return {"langs": langs, "w": w.astype(np.float32), "idf": idf.astype(np.float32), "t": _temperature(logits, ys[held]),
            "nonzero": float((w != 0).mean()), "rows": len(xs)}


def predict(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` of every row."""
    keep = list(keep)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # classes x 2^15 floats

    def run(batches):
        m = sent.value
        langs = m["langs"]
        for b in batches:
            names, scores = [], []
            for t in b.column(len(keep)):
                c = ngram_counts(t.as_py()) if langs else None
                if c is None:
                    names.append(UNDECIDED)
                    scores.append(0.0)
                    continue
                at, x = _vector(c, m["idf"])
                p = _softmax((m["w"][:, at] @ x + m["w"][:, DIM]).astype(np.float64) / m["t"])
                k = int(np.argmax(p))
                names.append(langs[k])
                scores.append(float(p[k]))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             [*keep, "lang_pred", "score"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, "text").mapInArrow(run, schema)


def held_out(parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of ``doc_id`` as text falls into the part kept apart; a
    null id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """Fit on the rows of ``docs`` that are not held out, predict all."""
    prepare(docs.sparkSession)
    return predict(docs, fit(docs, ~held_out(), **options), keep)
