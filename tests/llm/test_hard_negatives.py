"""Hard negatives: the threshold algorithm against brute force and SQL."""

from __future__ import annotations

import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from layover.llm import hard_negatives as hn
from layover.llm.common import prepare
from layover.llm.oracle import ORACLE
from layover.llm.queries import QUERIES
from layover.oracle.compare import same

SF = "/root/testdata/sf0.001"


def _brute(rows, divisor=100):
    kept = []
    for i, (vec_id, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((i, vec_id, label, [math.floor(256 * x) for x in v]))
    first = lambda x: (-x[0], x[1] is None, x[1] or 0)
    clip = lambda s: min(max(s, 1 - 2 ** 63), 2 ** 63 - 1)
    out = []
    for i, a, label, v in kept:
        if a is None or a % divisor:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), b, la) for j, b, la, w in kept if j != i]
        pos = sorted([(s, b) for s, b, la in scored if la == label], key=first)[:5]
        for p, pid in pos:
            neg = sorted([(s, b) for s, b, la in scored if la != label and 30 * p <= 100 * s <= 90 * p], key=first)[:10]
            out += [(a, pid, k + 1, b, clip(p), clip(s)) for k, (s, b) in enumerate(neg)]
    return sorted(out, key=str)


def _run(spark, rows):
    df = prepare(spark).createDataFrame([(a, v, la, 7, 1.5) for a, v, la in rows], "vec_id long, embedding array<double>, label int, block long, v double")
    got = hn.mine(hn.taking_part(hn.relabelled(df)), F.col("vec_id") % 100 == 0)
    return sorted([tuple(r) for r in got.collect()], key=str)


def _rows(seed, n, dims, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    return [(i, [spread * (c + rng.gauss(0, 0.7)) for c in centres[i % 4]], rng.choice([i % 4, i % 4, 9])) for i in range(n)]


@pytest.mark.parametrize("block", [7, 64, 2048])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hn, "BLOCK", block)
    rows = _rows(1, 450, 6)
    assert _run(spark, rows) == _brute(rows)


def test_edge_rows(spark):
    rng = random.Random(2)
    rows = _rows(3, 120, 3)
    rows += [(100, [1.0, 1.0, 1.0], 3), (100, [1.0, 1.0, 1.0], 3), (200, [1.0], 3), (300, [], 3), (400, [0.0, 0.0, 0.0], 2), (500, None, 1),
             (600, [1.0, None, 2.0], 1), (700, [1.0, float("nan"), 2.0], 1), (800, [float("inf"), 0.0, 0.0], 1), (900, [0.5, 0.5, 0.5], None),
             (None, [1.0, 1.0, 1.0], 3), (None, [0.9, 0.5, 0.5], 2), (1000, [1.0, 0.5, 0.5, 4.0], 8)]
    rows += [(i, [0.5, 0.25, 0.5], rng.choice([3, 4])) for i in range(2000, 2060)]  # ties
    assert _run(spark, rows) == _brute(rows)


def test_scores_beyond_doubles_and_longs(spark):
    rows = _rows(5, 210, 3, spread=3e12)
    assert _run(spark, rows) == _brute(rows)
    assert _run(spark, rows + [(300, [1e300, 1e300, 1e300], 1), (301, [1e299, 1e300, 1e300], 1), (302, [6e299, 5e299, 1e299], 2)])


def test_empty_and_one_label(spark):
    assert _run(spark, []) == []
    rows = [(i, [1.0, i / 10], 1) for i in range(0, 500, 50)]
    assert _run(spark, [r for r in rows if r[0] % 7]) == []


def test_reading_ends_before_the_lists_do():
    rng = np.random.default_rng(4)
    m = np.floor(np.abs(rng.standard_normal((4096, 2))) ** 6 * 256)
    lists = np.argsort(m.T, axis=1, kind="stable").astype(np.uint16)
    ids = np.arange(4096)
    b = hn.Block(4096, 2, ids.tobytes(), np.zeros(4096, bool).tobytes(), np.zeros(4096, np.int64).tobytes(), m.tobytes(), lists.tobytes())
    w = hn.Window(b, 5, np.ones(4096, bool))
    a = np.array([256.0, 128.0])
    assert hn.threshold_search(b, a, [w]) < 1024
    assert [-s for s, _, _ in w.found()] == sorted((m @ a).astype(int).tolist(), reverse=True)[:5]


def test_query_equals_sql(spark, duck):
    got = QUERIES["op11_hard_negatives"](spark, SF).toPandas()
    assert len(got) and same(got, duck.execute(ORACLE["op11_hard_negatives"]).df()) == (True, "")


def _block(rng, size, dims, scale):
    m = np.floor(rng.standard_normal((size, dims)) * scale)
    lists = np.argsort(m.T, axis=1, kind="stable").astype(np.uint16)
    ids, nulls = rng.integers(0, 3 * size, size), rng.random(size) < 0.1
    return hn.Block(size, dims, ids.tobytes(), nulls.tobytes(), rng.integers(0, 4, size).tobytes(), m.tobytes(), lists.tobytes())


@pytest.mark.parametrize("scale", [3, 256, 1e5])
@pytest.mark.parametrize("same_label", [True, False])
def test_a_pack_keeps_one_list_a_window_over_all_blocks(scale, same_label):
    """As single searches find them in each block, merged; with ties, and where floats are too short."""
    rng = np.random.default_rng(6)
    blocks = [_block(rng, int(n), 5, scale) for n in (300, 1, 700)]
    b, ats = blocks[0], np.arange(0, 300, 7)
    a = np.concatenate((b.m[ats], np.zeros((1, 5))))  # the last anchor scores 0 everywhere
    ats = np.append(ats, 299)
    asked = [[] if same_label else [Decimal(int(p)) for p in rng.integers(-2, 9 * scale * scale, 3)] for _ in ats]
    pack = hn.Pack(0, np.zeros(len(ats)), ats, b.labels[ats], [v.tobytes() for v in a], asked, 4, same_label)
    for here, x in enumerate(blocks):
        hn.pack_search(x, here, pack, np.arange(len(ats)))
    got = {(r["at"], r["window"]): [(i["score"], i["none"], i["id"]) for i in r["found"]] for r in pack.found(0).to_pylist()}
    want = {}
    for q, at in enumerate(ats):
        for w, p in enumerate([None] if same_label else asked[q]):
            found = []
            for here, x in enumerate(blocks):
                allowed = (x.labels == b.labels[at]) == same_label
                if here == 0:
                    allowed[at] = False
                window = hn.Window(x, 4, allowed, *(() if p is None else (30 * int(p), 90 * int(p))))
                if p is None or p >= 0:
                    hn.threshold_search(x, a[q], [window])
                found += window.found()
            if found:
                want[int(at), w] = sorted(found)[:4]
    assert got == want and len(got) > 20


def test_a_pack_stops_reading_early():
    rng = np.random.default_rng(4)
    m = np.floor(np.abs(rng.standard_normal((4096, 2))) ** 6 * 256)
    lists = np.argsort(m.T, axis=1, kind="stable").astype(np.uint16)
    b = hn.Block(4096, 2, np.arange(4096).tobytes(), np.zeros(4096, bool).tobytes(), np.zeros(4096, np.int64).tobytes(), m.tobytes(), lists.tobytes())
    v = np.array([[256.0, 128.0], [64.0, 256.0]])
    pack = hn.Pack(0, [1, 1], [0, 1], [0, 0], [x.tobytes() for x in v], [[], []], 5, True)
    assert hn.pack_search(b, 0, pack, np.arange(2)) < 1024


def test_blocks_are_dealt_over_tasks_whatever_the_files(spark):
    """One file, one task that packs: the searches still have several tasks."""
    rows = hn.taking_part(spark.createDataFrame([(i, [float(i % 7), 1.0], i % 3) for i in range(20_000)], "vec_id long, embedding array<double>, label int").coalesce(1))
    tasks = {}
    real = hn._search

    def seen(blocks, anchors, packs, k, same_label):
        out = real(blocks, anchors, packs, k, same_label)
        tasks[same_label] = blocks.count(), out._jdf.queryExecution().executedPlan().toString()
        return out

    hn._search = seen
    try:
        hn.mine(rows, F.col("vec_id") % 100 == 0).count()
    finally:
        hn._search = real
    for n, plan in tasks.values():
        assert n > 8 and "REPARTITION_BY_NUM" in plan
