"""Toxicity by a convolutional text classifier.

A text is its lower-cased words (runs of letters and digits).  A word has
three keys, the hashes of its first 5 bytes, of its first 8 and of the whole
(equal where it is shorter), so that an unseen form of a known stem is known
in part.  Its embedding is the sum of two rows for each key, one from each of
two tables: two keys share both rows only with probability 2^-32, so a word
that was never learnt from does not pass for one that was.  Filters over one, two
and three words run along the text; the greatest value of each over the whole
text (max pooling), cut at zero, goes into a logistic output.

Training runs on Spark over every labelled row and its whole text.  The rows are
staged once, dealt by hash into shards of about ``SHARD_ROWS``.  In each round
a task goes through its shards text by text (AdaGrad, gradients through the
windows that hold the maxima), starting from the same broadcast network, and
gives back the table rows that changed; a shuffle adds them up, each
shard weighted by the squared gradients that it saw for the row, so that shards
that hardly know a word do not dilute it.  The driver holds one network at a
time, whatever the size of the tables.  The first round of several shards is one
shard alone, so that the networks of the others start alike.  Both labels weigh
the same up to ``MOST_WEIGHT``.  Table rows that no word of the learnt rows uses
become zero.

A fifth of the labelled rows is kept apart to calibrate: for each language the
threshold with the least sum of both error rates, in the middle of the values
that reach it, from counts of all these rows over logits in steps of 1/64.
Scores are shifted so that the threshold of a text's language
is ``at``.  The language of a text is told from its words alone, by a naive
Bayes table of the counts of all learnt rows; a language with few rows of either label,
and a text without words, use the threshold of all rows.

Every row is scored from its whole text.  Very long texts are read in chunks.

Edge cases: a null text is an empty one, and both, like texts without words,
get the score of no evidence, which is below ``at``; rows without a ``doc_id`` are scored and never
learnt from; labels other than 0 and 1, null labels and labels of unknown
rows are ignored; a document with both labels is learnt from with each, and rows
alike in ``doc_id``, text and label count once;
without labels, or with one label only, every score is the learnt rate of
toxic rows, below ``at`` (0 without labels); repeated rows get equal scores;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layover.llm.common import ALPHANUMERIC, WordScanner, mix64, release, staged

#: bytes of the stems that are keys besides the word
STEMS = (5, 8)
BITS = 16
ROWS = 1 << BITS
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
PAD = max(WIDTHS) - 1
COLUMNS = FILTERS * sum(WIDTHS)
#: words scored at once
CHUNK = 1 << 14
LANGUAGES = 16
#: labelled rows of a shard, rounds over all shards (and over a single one)
SHARD_ROWS, ROUNDS, ROUNDS_ALONE = 16_384, 2, 4
MOST_WEIGHT = 8.0
#: steps of a logit, and the greatest one, of the counts that calibrate
STEPS, MOST_LOGIT = 64, 512
#: filter and place in its window of each column of ``w``
FILTER_OF = np.concatenate([FILTERS * i + np.tile(np.arange(FILTERS), w) for i, w in enumerate(WIDTHS)])
PLACE_OF = np.concatenate([np.repeat(np.arange(w), FILTERS) for w in WIDTHS])


class Words(WordScanner):
    """Texts -> the 32-bit keys of their words, one row a word."""

    def __init__(self):
        super().__init__(ALPHANUMERIC)

    def _chunk(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        a = np.frombuffer(b"\n".join(texts), np.uint8)
        self._grow(len(a) + 1)
        step = np.diff(self.word[a].astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(self.table[a] * self.power[:len(a)], out=sums[1:])
        keys = np.empty((len(start), len(STEMS) + 1), np.uint64)
        for k, stem in enumerate((*STEMS, len(a))):
            stop = np.minimum(end, start + stem)
            keys[:, k] = mix64((sums[stop] - sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        return keys, np.searchsorted(start, offsets)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        h, bounds = self.scan([(t or "").lower().encode("utf-8", "replace") for t in texts])
        return (h.reshape(-1, len(STEMS) + 1) >> np.uint64(32)).astype(np.uint32), bounds


def _halves(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint32(ROWS - 1)).astype(np.int64), (h >> np.uint32(BITS)).astype(np.int64)


def _spread(n: int, projected: np.ndarray) -> np.ndarray:
    """Values of all filters at the ``n`` first words of a run that is
    followed by PAD more (words or zeros)."""
    out, at = np.empty((n, FILTERS * len(WIDTHS)), projected.dtype), 0
    for i, w in enumerate(WIDTHS):
        part = out[:, FILTERS * i:FILTERS * (i + 1)]
        part[:] = projected[:n, at:at + FILTERS]
        for k in range(1, w):
            part += projected[k:k + n, at + k * FILTERS:at + (k + 1) * FILTERS]
        at += w * FILTERS
    return out


class Network:
    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        shapes = {"e0": (ROWS, DIM), "e1": (ROWS, DIM), "w": (DIM, COLUMNS), "c": (FILTERS * len(WIDTHS),), "u": (FILTERS * len(WIDTHS),), "b": (1,)}
        scale = {"e0": 0.05, "e1": 0.05, "w": 0.5, "c": 0.0, "u": 0.3, "b": 0.0}
        self.p = {k: (rng.standard_normal(s) * scale[k]).astype(np.float32) for k, s in shapes.items()}
        self.p["u"] = np.abs(self.p["u"])
        self.seen = {k: np.full(s, 1e-2, np.float32) for k, s in shapes.items()}

    def _update(self, k: str, at, g: np.ndarray, rate: float) -> None:
        self.seen[k][at] += g * g
        self.p[k][at] -= rate * g / np.sqrt(self.seen[k][at])

    def _embedded(self, h: np.ndarray) -> np.ndarray:
        i0, i1 = _halves(h)
        return self.p["e0"][i0].sum(axis=1) + self.p["e1"][i1].sum(axis=1)

    def _tops(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest value of each filter and the first word of its window; long
        texts in chunks."""
        best, top = np.full(FILTERS * len(WIDTHS), -np.inf, np.float32), np.zeros(FILTERS * len(WIDTHS), np.int64)
        for s in range(0, len(h), CHUNK):
            part = h[s:s + CHUNK + PAD]
            n = min(CHUNK, len(h) - s)
            x = np.zeros((n + PAD, DIM), np.float32)
            x[:len(part)] = self._embedded(part)
            z = _spread(n, x @ self.p["w"])
            at = z.argmax(axis=0)
            value = z[at, np.arange(z.shape[1])]
            better = value > best
            best[better], top[better] = value[better], at[better] + s
        return best, top

    def learn(self, h: np.ndarray, y: int, rate: float, weight: float = 1.0) -> float:
        p, n = self.p, len(h)
        best, top = self._tops(h)
        pooled = best + p["c"]
        act = np.maximum(pooled, 0)
        prob = 1 / (1 + np.exp(-np.clip(act @ p["u"] + p["b"][0], -30, 30)))
        d = np.float32((prob - y) * weight)
        da = d * p["u"] * (pooled > 0)
        # the word under each column of w, if the text has one there
        place, back = top[FILTER_OF] + PLACE_OF, da[FILTER_OF]
        real = np.flatnonzero(place < n)
        rows, of = np.unique(place[real], return_inverse=True)
        i0, i1 = _halves(h[rows])
        x = np.zeros((COLUMNS, DIM), np.float32)
        x[real] = (p["e0"][i0].sum(axis=1) + p["e1"][i1].sum(axis=1))[of]
        g = np.zeros((len(rows), DIM), np.float32)
        np.add.at(g, of, (p["w"] * back).T[real])
        self._update("u", slice(None), d * act, rate)
        self._update("b", slice(None), np.array([d], np.float32), rate)
        self._update("c", slice(None), da, rate)
        self._update("w", slice(None), x.T * back, rate)
        for table, i in (("e0", i0), ("e1", i1)):
            # a word that holds several maxima gets the sum of their gradients
            of, inverse = np.unique(i.ravel(), return_inverse=True)
            s = np.zeros((len(of), DIM), np.float32)
            np.add.at(s, inverse, np.repeat(g, i.shape[1], axis=0))
            self._update(table, of, s, rate)
        return float(prob)

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """Parameters and their squared gradients as rows of ``DIM`` values: the
        two tables, then the others one after the other."""
        def rows(x: dict) -> np.ndarray:
            rest = np.concatenate([x[k].ravel() for k in ("w", "c", "u", "b")])
            return np.concatenate([x["e0"], x["e1"], np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)])
        return rows(self.p), rows(self.seen)

    @classmethod
    def of(cls, p: np.ndarray, seen: np.ndarray) -> "Network":
        """The network of ``flat`` rows."""
        net = cls.__new__(cls)
        shapes = {"w": (DIM, COLUMNS), "c": (FILTERS * len(WIDTHS),), "u": (FILTERS * len(WIDTHS),), "b": (1,)}

        def named(x: np.ndarray) -> dict:
            out, rest, at = {"e0": x[:ROWS].copy(), "e1": x[ROWS:2 * ROWS].copy()}, x[2 * ROWS:].ravel(), 0
            for k, shape in shapes.items():
                size = int(np.prod(shape))
                out[k] = rest[at:at + size].reshape(shape).copy()
                at += size
            return out
        net.p, net.seen = named(p), named(seen)
        return net

    def projected(self) -> tuple[np.ndarray, np.ndarray]:
        return self.p["e0"] @ self.p["w"], self.p["e1"] @ self.p["w"]


class Scorer:
    """Logits and languages of texts by a fitted model."""

    def __init__(self, model: dict):
        self.m, self.words = model, Words()
        self.t0, self.t1 = model["e0"] @ model["w"], model["e1"] @ model["w"]

    def pooled(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest value of each filter, and sum of the language table, over
        each text; texts without words stay at minus infinity."""
        texts = len(bounds) - 1
        best = np.full((texts, FILTERS * len(WIDTHS)), -np.inf, np.float32)
        lang = np.zeros((texts, self.m["bayes"].shape[1]), np.float32)
        # PAD empty places after each text keep windows inside it
        sizes = np.diff(bounds)
        starts = bounds[:-1] + PAD * np.arange(texts)
        place = np.repeat(starts - bounds[:-1], sizes) + np.arange(len(h))
        total = len(h) + PAD * texts
        i0, i1 = _halves(h)
        for s in range(0, total, CHUNK):
            e = min(s + CHUNK, total)
            a, b = np.searchsorted(place, [s, e + PAD])
            x = np.zeros((e - s + PAD, COLUMNS), np.float32)
            at = place[a:b] - s
            for k in range(i0.shape[1]):
                x[at] += self.t0[i0[a:b, k]] + self.t1[i1[a:b, k]]
            z = _spread(e - s, x)
            b = np.searchsorted(place, e)
            if a == b:
                continue
            # texts with words in the chunk, and the first place of each
            t = np.searchsorted(bounds, [a, b - 1], side="right") - 1
            of = np.arange(t[0], t[1] + 1)
            of = of[sizes[of] > 0]
            first = np.maximum(starts[of] - s, 0)
            ends = np.minimum(starts[of] + sizes[of] - s, e - s)
            cut = np.empty(2 * len(of), np.int64)
            cut[::2], cut[1::2] = first, ends
            cut = cut[:-1] if cut[-1] == len(z) else cut
            best[of] = np.maximum(best[of], np.maximum.reduceat(z, cut, axis=0)[::2])
            lang[of] += np.add.reduceat(self.m["bayes"][i0[a:b, -1]], np.maximum(bounds[of], a) - a, axis=0)
        return best, lang

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(logits, numbers of languages; -1 without words)."""
        return self.hashed(*self.words(texts))

    def hashed(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, lang = self.pooled(h, bounds)
        logit = np.maximum(best + self.m["c"], 0).astype(np.float64) @ self.m["u"] + self.m["b"][0]
        of = np.where(np.diff(bounds) > 0, lang.argmax(axis=1) if lang.shape[1] else 0, -1)
        return logit, of


def _threshold(logits: np.ndarray, y: np.ndarray, count: np.ndarray | None = None) -> float:
    """Value with the least sum of both error rates, in the middle of those
    that reach it; each value stands for ``count`` rows."""
    order = np.argsort(logits, kind="stable")
    n = np.ones(len(y), int) if count is None else count[order]
    v, t = logits[order], y[order] * n
    missed = np.concatenate(([0], np.cumsum(t))) / max(t.sum(), 1)
    alarms = np.concatenate(([(n - t).sum()], (n - t).sum() - np.cumsum(n - t))) / max((n - t).sum(), 1)
    edges = np.concatenate(([v[0] - 1], (v[1:] + v[:-1]) / 2, [v[-1] + 1]))
    real = np.concatenate(([True], v[1:] > v[:-1], [True]))
    loss = np.where(real, missed + alarms, np.inf)
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    return float((edges[best[0]] + edges[best[-1]]) / 2)


def labelled(docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: int | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """(id, la, body, held) of every learning row, and (id, y) of every label 0 or 1; a
    caller may ask for ``sample_rows`` of them in expectation, half of each label."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y")).distinct()
    if sample_rows is not None:
        sizes = {r["y"]: r["k"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("k")).collect()}  # two rows
        part = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        known = known.where(F.coalesce(*[F.when(F.col("y") == y, part < sample_rows / 2 / k) for y, k in sizes.items()], F.lit(False)))
    rows = docs.where(learn & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.col("lang").alias("la"))
    return rows.withColumn("held", F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(5)) == 0), known


def _texts(b: pa.RecordBatch, words: Words, last: int | None):
    """(number of the row, hashes) of the texts of a batch that have words and
    do not repeat the row before them (``last``: key of the row before)."""
    h, bounds = words(b.column("body").to_pylist())
    for i, key in enumerate(b.column("key").to_pylist()):
        if key != last and bounds[i] < bounds[i + 1]:
            yield i, h[bounds[i]:bounds[i + 1]]
        last = key


def _round(rows: DataFrame, net: Network, rate: float, weights: dict[int, float]) -> Network:
    """The network after one pass over ``rows``, ordered by key in shards."""
    spark = rows.sparkSession
    p, seen = net.flat()
    sent = spark.sparkContext.broadcast((p, seen))  # one network
    values = [f"d{i}" for i in range(DIM)] + [f"g{i}" for i in range(DIM)]

    def changes(net: Network) -> pa.RecordBatch:
        (p0, s0), (p1, s1) = sent.value, net.flat()
        gain = (s1 - s0).astype(np.float64)
        at = np.flatnonzero(gain.sum(axis=1) > 0)
        mass = np.where(at < 2 * ROWS, gain[at].sum(axis=1), 1.0)
        out = np.hstack([(p1 - p0)[at], gain[at]]) * mass[:, None]
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(mass), *[pa.array(c) for c in out.T]], ["r", "m", *values])

    def run(batches):
        words, mine, shard, last = Words(), None, None, None
        for b in batches:
            shards, y = b.column("shard").to_pylist(), b.column("y").to_pylist()
            for i, h in _texts(b, words, last):
                if mine is None or shards[i] != shard:
                    if mine is not None:
                        yield changes(mine)
                    mine, shard = Network.of(*sent.value), shards[i]
                mine.learn(h, y[i], rate, weights[y[i]])
            last = b.column("key")[-1].as_py() if b.num_rows else last
        if mine is not None:
            yield changes(mine)

    got = rows.select("key", "shard", "y", "body").mapInArrow(run, ", ".join(["r long", "m double", *[f"{v} double" for v in values]]))
    got = got.groupBy("r").agg(F.sum("m").alias("m"), *[F.sum(v).alias(v) for v in values]).toArrow()  # at most the rows of a network
    at, m = got["r"].to_numpy(), got["m"].to_numpy()
    mean = np.column_stack([got[v].to_numpy() for v in values]).astype(np.float64).reshape(len(at), 2 * DIM) / m[:, None]
    p[at] += mean[:, :DIM].astype(np.float32)
    seen[at] += mean[:, DIM:].astype(np.float32)
    sent.unpersist()
    return Network.of(p, seen)


def _uses(rows: DataFrame, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Whether words of ``rows`` use each row of the two tables, and how many
    words of each language use each row of the first one."""
    number = {la: i for i, la in enumerate(langs)}

    def run(batches):
        words, last = Words(), None
        used, counts = np.zeros((2, ROWS), np.int64), np.zeros((len(langs), ROWS), np.int64)
        for b in batches:
            la = b.column("la").to_pylist()
            for i, h in _texts(b, words, last):
                i0, i1 = _halves(h)
                used[0, i0.ravel()] = used[1, i1.ravel()] = 1
                if la[i] in number:
                    np.add.at(counts[number[la[i]]], i0[:, -1], 1)
            last = b.column("key")[-1].as_py() if b.num_rows else last
        every = np.vstack([used, counts])
        col, row = np.nonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(col, pa.int64()), pa.array(row, pa.int64()), pa.array(every[col, row])], ["c", "r", "n"])

    got = rows.select("key", "la", "body").mapInArrow(run, "c long, r long, n long").groupBy("c", "r").agg(F.sum("n").alias("n")).toArrow()
    every = np.zeros((2 + len(langs), ROWS))
    every[got["c"].to_numpy(), got["r"].to_numpy()] = got["n"].to_numpy()
    return every[:2] > 0, every[2:].T


def _thresholds(rows: DataFrame, model: dict) -> np.ndarray:
    """The threshold of each language from all ``rows``."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer, last = Scorer(sent.value), None
        for b in batches:
            keys = b.column("key").to_pylist()
            b = b.filter(pa.array([k != l for k, l in zip(keys, [last, *keys], strict=False)], pa.bool_()))
            last = keys[-1] if keys else last
            logit, of = scorer(b.column("body").to_pylist())
            step = np.floor(np.clip(logit, -MOST_LOGIT, MOST_LOGIT) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(of.astype(np.int64)), b.column("y")], ["step", "of", "y"])

    got = rows.select("key", "y", "body").mapInArrow(run, "step long, of long, y int").groupBy("step", "of", "y").agg(F.count(F.lit(1)).alias("n")).toArrow()
    step, of, y, n = (got[c].to_numpy() for c in ("step", "of", "y", "n"))
    value = (step + 0.5) / STEPS
    everywhere = _threshold(value, y, n)
    per = [everywhere] * max(len(model["langs"]), 1)
    for k in range(len(model["langs"])):
        mine = of == k
        if min(n[mine & (y == 1)].sum(), n[mine & (y == 0)].sum()) >= 10:
            per[k] = _threshold(value[mine], y[mine], n[mine])
    return np.array(per)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: int | None = None, seed: int = 11, rate: float = 0.2, at: float = 0.7) -> dict:
    """Model from all rows of ``docs(doc_id, text, lang)`` where ``learn`` that
    ``labels(doc_id, toxic)`` marks."""
    texts, known = labelled(docs, labels, learn, sample_rows, seed)
    # at most four rows
    sizes = {(r["y"], r["held"]): r["k"] for r in texts.select("id", "held").join(known, "id").groupBy("y", "held").agg(F.count(F.lit(1)).alias("k")).collect()}
    per = {y: sum(k for (z, _), k in sizes.items() if z == y) for y in (0, 1)}
    rows = sum(per.values())
    if min(per.values()) == 0:
        return {"constant": min(per[1] / max(rows, 1), at - 0.01)}
    shards = -(-rows // SHARD_ROWS)
    # texts are dealt once: the deal into shards is that of the join
    x = texts.repartition(shards, "id").join(known.repartition(shards, "id"), "id")
    x = x.withColumns({"shard": F.spark_partition_id(), "key": F.xxhash64("id", "y", "body", F.lit(seed + 1))}).sortWithinPartitions("key")
    x = staged(x.select("key", "shard", "held", "y", "la", "body"), "labelled")
    whole = len(sizes) < 4  # too few rows to keep any apart
    used, held = (x, x) if whole else (x.where("not held"), x.where("held"))
    weights = {y: min(rows / 2 / k, MOST_WEIGHT) for y, k in per.items()}
    net = Network(seed)
    if shards > 1:
        first = used.where(F.pmod(F.xxhash64("key"), F.lit(shards)) == 0).withColumn("shard", F.lit(0))
        net = _round(first.repartition(1).sortWithinPartitions("key"), net, rate, weights)
    for i in range(ROUNDS if shards > 1 else ROUNDS_ALONE):
        net = _round(used, net, rate / (1 + i), weights)
    counts = used.where("la is not null").groupBy("la").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "la").limit(LANGUAGES)
    langs = sorted(r["la"] for r in counts.collect())
    uses, seen = _uses(used, langs)
    for table, of in zip(("e0", "e1"), uses, strict=True):
        net.p[table][~of] = 0
    seen += 0.1
    model = {**net.p, "bayes": np.log(seen / seen.sum(axis=0)).astype(np.float32), "langs": langs, "at": at, "rows": rows}
    model["thresholds"] = _thresholds(held, model)
    release(x)
    return model


def predict(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` of every row."""
    keep = list(keep)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two tables of 2^16 rows

    def run(batches):
        m = sent.value
        scorer = None if "constant" in m else Scorer(m)
        for b in batches:
            if scorer is None:
                score = np.full(b.num_rows, m["constant"])
            else:
                logit, of = scorer(b.column(len(keep)).to_pylist())
                z = logit - m["thresholds"][of] + np.log(m["at"] / (1 - m["at"]))
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                # a value at the threshold is at it in floating point too
                score = np.where((logit >= m["thresholds"][of]) & (of >= 0), np.maximum(score, m["at"]), np.minimum(score, np.nextafter(m["at"], 0)))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(score, pa.float64())], [*keep, "score"])

    schema = docs.select(*keep).schema.add("score", "double")
    return docs.select(*keep, "text").mapInArrow(run, schema)


def held_out(parts: int = 3, part: int = 1) -> Column:
    """Whether crc32 of ``doc_id`` as text falls into the part kept apart; a
    null id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(False))
