"""Toxicity: held-out rates, pooling against a plain convolution, edge rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from layover.llm import toxicity as tx
from layover.llm.common import prepare
from layover.llm.queries import QUERIES

STEMS = {"en": ["grub", "vilesome"], "de": ["schmaf", "knurzel"]}


def _text(rng, lang, n, toxic):
    syllables = {"en": "ther ing on ea st and or ly".split(), "de": "sch ung keit ber ein ach lich zu".split()}[lang]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    for _ in range(3 * toxic):
        words[rng.randrange(n)] = rng.choice(STEMS[lang]) + rng.choice(["", "er", "ig", "s"])
    return " ".join(words)


def _tables(spark, rows, labels):
    docs = prepare(spark).createDataFrame([(i, t, la, 1, "x") for i, t, la in rows], "doc_id long, text string, lang string, id int, y string")
    return docs, spark.createDataFrame([(i, 1, y, 3) for i, y in labels], "doc_id long, quality int, toxic int, id int")


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(2400):
        lang, y = rng.choice(["en", "de"]), int(rng.random() < 0.3)
        rows.append((i, _text(rng, lang, rng.randint(20, 120), y), lang))
        labels.append((i, y))
    return rows, labels


def test_pooling_equals_plain_convolution():
    rng = np.random.default_rng(2)
    net = tx.Network(1)
    model = {**net.p, "bayes": rng.standard_normal((tx.ROWS, 3)).astype(np.float32)}
    scorer = tx.Scorer(model)
    sizes = [0, 1, 2, 3, 0, 40_000, 7, tx.CHUNK, 0]
    h = rng.integers(0, 1 << 32, (sum(sizes), 3), dtype=np.uint32)
    bounds = np.cumsum([0, *sizes])
    best, lang = scorer.pooled(h, bounds)
    for t, n in enumerate(sizes):
        if not n:
            assert np.isinf(best[t]).all()
            continue
        i0, i1 = tx._halves(h[bounds[t]:bounds[t + 1]])
        x = np.zeros((n + tx.PAD, tx.DIM), np.float32)
        x[:n] = net.p["e0"][i0].sum(axis=1) + net.p["e1"][i1].sum(axis=1)
        at, plain = 0, []
        for w in tx.WIDTHS:
            kernel = net.p["w"][:, at:at + w * tx.FILTERS].reshape(tx.DIM, w, tx.FILTERS)
            plain.append(np.max([sum(x[p + k] @ kernel[:, k] for k in range(w)) for p in range(n)] if n < 100 else
                                sum(x[k:k + n] @ kernel[:, k] for k in range(w)), axis=0))
            at += w * tx.FILTERS
        assert np.allclose(best[t], np.concatenate(plain), atol=1e-4)
        assert np.allclose(lang[t], model["bayes"][i0[:, -1]].sum(axis=0), rtol=1e-3, atol=0.3)


def test_gradient_of_one_step():
    """A small step on one text lowers its loss."""
    net = tx.Network(3)
    h = np.random.default_rng(3).integers(0, 1 << 32, (30, 3), dtype=np.uint32)
    probs = [net.learn(h, 1, 0.02) for _ in range(12)]
    assert probs[-1] > probs[0] and all(b >= a - 1e-3 for a, b in zip(probs, probs[1:], strict=False))


def test_held_out_rows_and_languages(spark, planted):
    rows, labels = planted
    docs, marks = _tables(spark, rows, labels)
    model = tx.fit(docs, marks, ~tx.held_out())
    assert model["langs"] == ["de", "en"] and len(model["thresholds"]) == 2
    got = tx.predict(docs.withColumn("held", tx.held_out()), model, keep=("doc_id", "held")).where("held").toPandas()
    y = got["doc_id"].map(dict(labels))
    caught = (got["score"] >= 0.7)
    assert caught[y == 1].mean() > 0.9 and caught[y == 0].mean() < 0.05
    assert got["score"].between(0, 1).all()


def test_inputs_of_a_score(spark, planted):
    """Neither lang, source nor doc_id of a row changes its score."""
    rows, labels = planted
    docs, marks = _tables(spark, rows, labels)
    model = tx.fit(docs, marks, ~tx.held_out(), sample_rows=600)
    same = docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") * 7 + 5)
    a = tx.predict(docs, model).toPandas().sort_values("doc_id")["score"].to_numpy()
    b = tx.predict(same, model).toPandas().sort_values("doc_id")["score"].to_numpy()
    assert (a == b).all()


def test_edge_rows(spark, planted):
    rows, labels = planted
    long = " ".join(["ther"] * 400_000)
    rows = rows[:600] + [(None, None, None), (9001, "", "en"), (9002, "?!", "de"), (9003, long + " grub vilesome grubs", "en"), (9003, long, "en"),
                         (9004, "grub grub", None), (9004, "grub grub", None)]
    labels = labels[:600] + [(None, 1), (9001, None), (7777, 1), (5, 1), (5, 0), (6, 4)]
    docs, marks = _tables(spark, rows, labels)
    got = tx.predict(docs, tx.fit(docs, marks, ~tx.held_out())).toPandas()
    assert len(got) == len(rows) and got["score"].notna().all()
    empty = got[got["doc_id"].isna() | got["doc_id"].isin([9001, 9002])]["score"]
    assert empty.nunique() == 1 and empty.iloc[0] < 0.7
    assert got[got["doc_id"] == 9004]["score"].nunique() == 1
    none = tx.fit(docs, marks.where("false"), ~tx.held_out())
    assert set(tx.predict(docs, none).toPandas()["score"]) == {0.0}
    one = tx.fit(docs, marks.where("toxic = 1"), ~tx.held_out())
    assert set(tx.predict(docs, one).toPandas()["score"]) == {0.7 - 0.01}
    assert tx.predict(docs.where("false"), one).count() == 0
    assert tx.fit(docs.where("false"), marks, ~tx.held_out()) == {"constant": 0.0}


def test_threshold_is_in_the_middle():
    z, y = np.array([0.0, 1.0, 5.0, 6.0]), np.array([0, 0, 1, 1])
    assert tx._threshold(z, y) == 3.0
    assert tx._threshold(np.array([1.0, 1.0, 1.0]), np.array([0, 1, 0])) in (0.0, 1.0, 2.0)


def test_query(spark):
    got = QUERIES["op12_toxicity"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) == 1000 and list(got.columns) == ["doc_id", "held_out", "score", "predicted"]
    assert ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()


def test_learns_from_every_row_and_long_texts(spark):
    """Only texts of more than 2,000 words are toxic here; none is left out."""
    rng = random.Random(4)
    rows = [(i, _text(rng, "en", 2100 if i % 2 else 30, i % 2), "en") for i in range(400)]
    docs, marks = _tables(spark, rows, [(i, i % 2) for i, _, _ in rows])
    model = tx.fit(docs, marks, ~tx.held_out())
    assert model["rows"] == docs.where(~tx.held_out()).count()
    got = tx.predict(docs.where(tx.held_out()), model).toPandas()
    caught, y = got["score"] >= 0.7, got["doc_id"] % 2
    assert caught[y == 1].mean() > 0.9 and caught[y == 0].mean() < 0.1


def test_shards_learn_together(spark, planted, monkeypatch):
    """Networks of many shards add up to one that knows the words of all."""
    monkeypatch.setattr(tx, "SHARD_ROWS", 250)
    rows, labels = planted
    docs, marks = _tables(spark, rows, labels)
    model = tx.fit(docs, marks, ~tx.held_out())
    assert model["rows"] == docs.where(~tx.held_out()).count()
    got = tx.predict(docs.where(tx.held_out()), model).toPandas()
    y, caught = got["doc_id"].map(dict(labels)), got["score"] >= 0.7
    assert caught[y == 1].mean() > 0.9 and caught[y == 0].mean() < 0.05


def test_long_text_in_chunks():
    """Filters and gradients do not depend on where a text is cut."""
    h = np.random.default_rng(5).integers(0, 1 << 32, (3000, 3), dtype=np.uint32)
    nets = [tx.Network(2), tx.Network(2)]
    chunk = tx.CHUNK
    try:
        for net, tx.CHUNK in zip(nets, (chunk, 70), strict=True):
            net.learn(h, 1, 0.1, 2.0)
    finally:
        tx.CHUNK = chunk
    assert all(np.allclose(a, b) for a, b in zip(nets[0].flat(), nets[1].flat(), strict=True))
    again = tx.Network.of(*nets[0].flat())
    assert all((again.p[k] == nets[0].p[k]).all() for k in again.p)
