"""Conversation repair: the search against plain dynamic programming, blocks
against the whole, the query against SQL on edge rows."""

from __future__ import annotations

import random

import duckdb
import pytest

from layover.llm import conversation_repair as cr
from layover.llm.common import prepare
from layover.llm.oracle import ORACLE
from layover.llm.queries import QUERIES
from layover.oracle.compare import same


def _plain(codes: str) -> tuple[int, str]:
    """Cheapest (cost, audit) by dynamic programming over (turn, state)."""
    best = {0: (0, "")}
    for c in codes:
        for _ in range(2):  # at most two inserts are of use
            for q, (cost, audit) in list(best.items()):
                x = (cost + 5, audit + "I")
                best[cr.NEXT[q]] = min(best.get(cr.NEXT[q], x), x)
        after: dict[int, tuple] = {}
        for q, (cost, audit) in best.items():
            kind, initial = divmod((cr.SOUND + cr.TRUNCATED + cr.DOOMED).index(c), 4)
            options = [(2, "D", q)]
            if kind < 2:
                options.append((1 + 5 * kind, "R", cr.NEXT[q]))
                if (initial, q) in ((0, 0), (1, 0), (1, 1), (1, 3), (2, 2)):
                    options.append((5 * kind, "K", {0: 1, 1: 2, 2: 3}[initial]))
            for more, edit, to in options:
                x = (cost + more, audit + edit)
                after[to] = min(after.get(to, x), x)
        best = after
    ends = [(c + 5 * k, a + "I" * k) for q, (c, a) in best.items() for k, to in ((0, q), (1, cr.NEXT[q]), (2, cr.NEXT[cr.NEXT[q]])) if to in (0, 3)]
    return min(ends)


def test_search_is_cheapest_and_least():
    rng = random.Random(3)
    for _ in range(3000):
        codes = "".join(rng.choices("suaoSUAO1234", weights=[1, 5, 5, 1, 1, 2, 2, 1, 1, 1, 1, 1], k=rng.randint(1, 14)))
        assert cr.search(codes) == _plain(codes), codes


def test_blocks_compose_to_the_whole():
    rng = random.Random(4)
    for _ in range(300):
        codes = "".join(rng.choices("suaoSUAO1234", weights=[2, 5, 5, 1, 1, 2, 2, 1, 1, 1, 1, 1], k=rng.randint(4, 40)))
        parts = [codes[i:i + 3] for i in range(0, len(codes), 3)]
        cells = [cr.block_cells(p, i == 0, i + 1 == len(parts)) for i, p in enumerate(parts)]
        level = [{(q, t): (cost, rank) for q, t, cost, rank, _ in c} for c in cells]
        while len(level) > 1:
            level = [cr._table(cr._composed(level[i:i + 2])) for i in range(0, len(level), 2)]
        whole = cr._chains([{(q, t): (cost, rank) for q, t, cost, rank, _ in c} for c in cells], {0})[0, cr.END]
        audit = "".join(next(a for q, t, _, _, a in c if (q, t) == (whole[1][k], whole[1][k + 1])) for k, c in enumerate(cells))
        assert level[0][0, cr.END][0] == whole[0]
        assert (whole[0], audit) == _plain(codes)


def _given(spark, rows):
    return prepare(spark).createDataFrame([(c, t, r, x, 1, "k") for c, t, r, x in rows],
                                          "conv_id long, turn long, role string, text string, pos int, key string")


def _edge_rows():
    rng = random.Random(9)
    rows = [(None, 0, "user", "Hello."), (None, 1, "assistant", "Yes."), (1, None, "user", "A."), (1, None, None, "B!"), (1, 4, "assistant", None),
            (2, None, None, None), (3, 0, "tool", "x."), (3, 0, "tool", "x."), (3, 1, "", "y."), (4, 5, "system", "s."), (5, 1, "user", " \t\n"),
            (6, 1, "user", "long " * 50_000 + "."), (6, 2, "assistant", "end?\n")]
    for c in range(10, 40):
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([t, t, t + 2]), rng.choice(["user", "assistant", "assistant", "system", "User"]),
                         rng.choice(["One.", "Two", "Three!", "", "Four? ", "é.", "One."])))
    for t in range(400):  # a long conversation
        rows.append((99, t, ("user", "assistant")[t % 2] if t % 7 else "user", f"turn {t // 3}" + ".!? "[t % 4]))
    return rows


@pytest.mark.parametrize("rows", [[], _edge_rows()], ids=["empty", "edges"])
def test_query_equals_sql(spark, tmp_path, rows):
    _given(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op13_conversation_repair"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(ORACLE["op13_conversation_repair"]).df()
    assert same(got, want) == (True, "")


def test_small_blocks_and_repaired_rows(spark):
    rows = cr.turns(_given(spark, _edge_rows()))
    whole, faults = cr.repair(rows, block=512)
    split, same_faults = cr.repair(rows, block=5, fan=3)
    assert sorted(cr.digest(whole).collect()) == sorted(cr.digest(split).collect())
    assert sorted(faults.collect()) == sorted(same_faults.collect())
    kept = whole.where("edit <> 'D'").orderBy("key", "pos", "seq").toPandas()
    for _, g in kept.groupby("key"):
        roles = "".join(r[0] for r in g["role"])
        roles = roles[1:] if roles.startswith("s") else roles
        assert roles == "ua" * (len(roles) // 2)
