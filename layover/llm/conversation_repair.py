"""Conversation structure repair by iterative-deepening A*.

A conversation is brought to the role pattern ``(s?(ua)+)?`` (initials of
system, user, assistant) by edits of its turns: Keep costs 0, Rerole to
user or assistant 1, Delete 2, Insert of an empty user or assistant turn 5;
a truncated turn that is not deleted costs 5 more, and blank or repeated
turns must be deleted.  Of the cheapest edit sequences the one whose
initials come first in ASCII order is taken.

Search
    Depth-first in ASCII edit order (D, I, K, R) under a cost bound that
    rises to the least cost that exceeded it.  The table of failed states
    keeps, for each (turn, role state), the least cost that is still
    possible from there, so a state that failed is not entered again with
    as little left.  The first accepting path is the answer.

Conversations of any length
    The search runs on blocks of ``block`` turns.  What a block does
    depends on the rest only through the role state at its two ends, so a
    conversation of one block is one search, and a block of a longer one is
    searched once for each pair of end states.  Blocks are then composed,
    ``fan`` at a time and level by level, to the cheapest chain of states
    (ties by the order of the blocks' edits, which is the order of the
    whole: inserts stand before the turn that follows them, so two audits
    between different states differ before either ends).  No task ever
    holds a whole conversation; its hash alone is one stream, since
    SHA-256 has an order, and is fed row by row.

Edge cases: turns stand by ``turn`` (nulls first), then role and text;
null roles and texts are one space; a null ``conv_id`` is a conversation
of its own; equal rows are separate turns, the later ones duplicates; a
role of any other initial, or none, can only be reroled or deleted; a
conversation without turns has no edits; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import cmp_to_key

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layover.llm.common import staged
from layover.operators.ordered import row_index

BLOCK = 64
FAN = 256
INF = 1 << 60

#: role states: nothing yet, after system, after user, after assistant
START, SYSTEM, USER, ASSISTANT = range(4)
#: the end of the conversation, as the state after its last block
END = 4
#: state after one more turn of the role that may follow
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}

#: one letter a turn: sound, truncated and to be deleted, by role initial
SOUND, TRUNCATED, DOOMED = "suao", "SUAO", "1234"
_LETTERS = SOUND + TRUNCATED + DOOMED


# ------------------------------------------------------------------ search
def _moves(code: str, q: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state after) of one turn in ASCII order, inserts apart."""
    out = [("D", 2, q)]
    at = _LETTERS.index(code)
    kind, initial = divmod(at, 4)
    if kind < 2:
        more = 5 * kind
        if initial == 0 and q == START:
            out.append(("K", more, SYSTEM))
        elif initial in (1, 2) and NEXT[q] == (USER, ASSISTANT)[initial - 1]:
            out.append(("K", more, NEXT[q]))
        out.append(("R", 1 + more, NEXT[q]))
    return out


_MOVES = {(c, q): _moves(c, q) for c in _LETTERS for q in range(4)}
#: least cost of a turn in any state but START, where one system turn is free
_LEAST = {c: 1 if c in "so" else 0 if c in "ua" else 2 for c in _LETTERS}


def search(codes: str, state: int = START, target: int = END) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of the turns ``codes`` from
    ``state`` to ``target``, first in ASCII order among equals."""
    n = len(codes)
    rest, system = [0] * (n + 1), [False] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + _LEAST[codes[i]]
        system[i] = system[i + 1] or codes[i] == "s"
    low: dict[int, int] = {}  # failed states: least cost still possible

    def least(i: int, q: int) -> int:
        if (known := low.get(4 * i + q)) is not None:
            return known
        return rest[i] - (q == START and system[i])

    path: list[str] = []

    def down(i: int, q: int, left: int) -> bool:
        if i == n and (q == target or target == END and q in (START, ASSISTANT)):
            return True
        best = INF
        steps = [(e, c, i + 1, s) for e, c, s in _MOVES[codes[i], q]] if i < n else []
        if i < n or target == END:
            steps.insert(1, ("I", 5, i, NEXT[q]))
        for edit, cost, j, s in steps:
            if cost + least(j, s) <= left:
                path.append(edit)
                if down(j, s, left - cost):
                    return True
                path.pop()
            best = min(best, cost + least(j, s))
        low[4 * i + q] = max(best, low.get(4 * i + q, 0))
        return False

    bound = least(0, state)
    while not down(0, state, bound):
        bound = least(0, state)
    return bound, "".join(path)


def _reachable(codes: str, state: int, target: int) -> bool:
    if target in (USER, ASSISTANT, END) or state == target:
        return True
    return state == START and target == SYSTEM and any(c in "sS" for c in codes)


def block_cells(codes: str, first: bool, last: bool) -> list[tuple[int, int, int, int, str]]:
    """(state in, state out, cost, rank, audit) of a block; the rank orders
    the audits of one state in."""
    cells = []
    for q in ((START,) if first else range(4)):
        of = [(t, *search(codes, q, t)) for t in ((END,) if last else range(4)) if _reachable(codes, q, t)]
        rank = {t: r for r, (t, _, _) in enumerate(sorted(of, key=lambda x: x[2]))}
        cells += [(q, t, cost, rank[t], audit) for t, cost, audit in of]
    return cells


# ------------------------------------------------------------- composition
def _chains(children: list[dict], starts: set[int]) -> dict:
    """(state in, state out) -> (cost, states after each child) of the
    cheapest chain; ``children``: {(in, out): (cost, rank)} in order."""
    out = {}
    for target in {t for _, t in children[-1]}:
        value, choice = {target: 0}, []
        for child in reversed(children):
            best: dict[int, tuple] = {}
            for (q, t), (cost, rank) in child.items():
                if t in value and (x := (cost + value[t], rank, t)) < best.get(q, (INF,)):
                    best[q] = x
            value = {q: x[0] for q, x in best.items()}
            choice.append({q: x[2] for q, x in best.items()})
        for q in starts & value.keys():
            states = [q]
            for step in reversed(choice):
                states.append(step[states[-1]])
            out[q, target] = (value[q], states)
    return out


def _composed(children: list[dict]) -> list[int]:
    """Flat (in, out, cost, rank) of a run of children."""
    chains = _chains(children, {q for q, _ in children[0]})
    flat = []
    for q in {q for q, _ in chains}:
        def order(a, b):
            for k, child in enumerate(children):
                x, y = (chains[q, t][1][k:k + 2] for t in (a, b))
                if x != y:
                    return child[tuple(x)][1] - child[tuple(y)][1]
            return 0
        for rank, t in enumerate(sorted((t for s, t in chains if s == q), key=cmp_to_key(order))):
            flat += [q, t, chains[q, t][0], rank]
    return flat


def _table(flat) -> dict:
    return {(int(flat[i]), int(flat[i + 1])): (int(flat[i + 2]), int(flat[i + 3])) for i in range(0, len(flat), 4)}


def _compose_group(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("node")
    flat = _composed([_table(x) for x in g["cells"]])
    return pd.DataFrame({"key": [g["key"].iloc[0]], "node": [g["parent"].iloc[0]], "cells": [flat]})


def _choose_group(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("node")
    q, t = int(g["q_in"].iloc[0]), int(g["q_out"].iloc[0])
    states = _chains([_table(x) for x in g["cells"]], {q})[q, t][1]
    return pd.DataFrame({"key": g["key"], "node": g["node"], "q_in": states[:-1], "q_out": states[1:]})


def _choose_states(blocks: DataFrame, fan: int) -> DataFrame:
    """(key, node, q_in, q_out) of every block of the long conversations."""
    levels = [blocks]
    while levels[-1].agg(F.max("node")).first()[0]:
        up = levels[-1].withColumn("parent", F.floor(F.col("node") / fan).cast("long"))
        levels.append(staged(up.groupBy("key", "parent").applyInPandas(_compose_group, "key string, node long, cells array<long>"), "chains"))
    chosen = levels.pop().select("key", "node", F.lit(START).alias("q_in"), F.lit(END).alias("q_out"))
    while levels:
        down = levels.pop().withColumn("parent", F.floor(F.col("node") / fan).cast("long"))
        ends = chosen.select("key", F.col("node").alias("parent"), "q_in", "q_out")
        chosen = down.join(ends, ["key", "parent"]).groupBy("key", "parent").applyInPandas(
            _choose_group, "key string, node long, q_in int, q_out int")
    return chosen


# ------------------------------------------------------------------- turns
def conversation_key(conv_id: str | Column = "conv_id") -> Column:
    """A conversation's key: never null, one value for the null id."""
    c = (F.col(conv_id) if isinstance(conv_id, str) else conv_id).cast("string")
    return F.coalesce(F.concat(F.lit("="), c), F.lit(""))


def turns(conversations: DataFrame) -> DataFrame:
    """(key, turn, role, text, pos, code): turns in order, numbered from 0 in
    their conversation, with the letter of role initial and first fault."""
    space = F.lit(" ")
    x = conversations.select(conversation_key().alias("key"), "turn", F.coalesce("role", space).alias("role"),
                             F.coalesce("text", space).alias("text"))
    # equal rows are told apart, so that Spark can split any number of them
    x = x.withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc(), F.col("tie").asc()]
    x = row_index(x, ["key"], order).withColumn("pos", F.col("row_index").cast("long") - 1)
    same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    x = x.select("key", "pos", "turn", "role", "text", same.alias("same"))
    first = x.groupBy("key", "same").agg(F.min("pos").alias("pos")).select("key", "pos", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    fault = (F.when(blank, 3).when(F.col("first").isNull(), 2)
             .when(~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z"), 1).otherwise(0))
    letters = F.array(*[F.lit(c) for c in SOUND + TRUNCATED + DOOMED + DOOMED])
    y = x.join(first, ["key", "pos"], "left").withColumn("fault", fault)
    code = F.element_at(letters, 4 * F.col("fault") + kind + 1)
    return staged(y.select("key", "pos", "turn", "role", "text", "fault", code.alias("code")), "turns")


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """(key, node, codes, before, more): the letters of each block, the letter
    of the turn before it and whether another block follows."""
    node, at = F.floor(F.col("pos") / block).cast("long"), F.col("pos") % block
    sent = F.array(F.struct(node.alias("node"), F.lit(0).alias("what")),
                   F.when(at == block - 1, F.struct((node + 1).alias("node"), F.lit(-1).alias("what"))),
                   F.when((at == 0) & (node > 0), F.struct((node - 1).alias("node"), F.lit(1).alias("what"))))
    x = rows.select("key", "pos", "code", F.explode(F.filter(sent, lambda s: s.isNotNull())).alias("s"))
    what = F.col("s.what")
    own = F.collect_list(F.when(what == 0, F.struct("pos", "code")))
    g = x.groupBy("key", F.col("s.node").alias("node")).agg(
        F.array_join(F.transform(F.array_sort(own), lambda r: r["code"]), "").alias("codes"),
        F.max(F.when(what == -1, F.col("code"))).alias("before"), F.coalesce(F.bool_or(what == 1), F.lit(False)).alias("more"))
    return g.where(F.col("codes") != "")


def _initials(codes: str) -> str:
    return "".join(SOUND[_LETTERS.index(c) % 4] for c in codes)


_SOLVED = "key string, node long, codes string, more boolean, illegal long, cells array<long>, audits array<string>"


def _solve(batches):
    known: dict[tuple, tuple] = {}
    for b in batches:
        cells, audits, illegal = [], [], []
        for _, node, codes, before, more in zip(*[c.to_pylist() for c in b.columns], strict=True):
            at = (codes, node == 0, not more)
            if at not in known:
                if len(known) > 50_000:
                    known.clear()
                found = block_cells(*at)
                known[at] = ([v for c in found for v in c[:4]], [c[4] for c in found])
            cells.append(known[at][0])
            audits.append(known[at][1])
            roles = _initials((before or "") + codes)
            illegal.append(sum(x + y not in ("su", "ua", "au") for x, y in zip(roles, roles[1:], strict=False)))
        key, node, codes, _, more = b.columns
        yield pa.RecordBatch.from_arrays(
            [key, node, codes, more, pa.array(illegal, pa.int64()), pa.array(cells, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))],
            ["key", "node", "codes", "more", "illegal", "cells", "audits"])


def _expand(block: int):
    """Blocks with their state in and audit -> one row an edit."""
    names = ["key", "pos", "seq", "edit", "new_role", "cost"]

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for key, node, codes, q, audit in zip(*[c.to_pylist() for c in b.columns], strict=True):
                i = seq = 0
                for e in audit:
                    # inserts after the last turn stand behind it
                    i, seq = (i, seq) if i < len(codes) else (i - 1, max(seq, 1) + 1_000)
                    code, role = codes[i], None
                    if e == "K":
                        q = SYSTEM if code in "sS" else NEXT[q]
                    elif e != "D":
                        q = NEXT[q]
                        role = ROLE[q]
                    cost = {"K": 0, "R": 1, "D": 2, "I": 5}[e] + (5 if e in "KR" and code in TRUNCATED else 0)
                    out.append((key, node * block + i, seq, e, role, cost))
                    if e == "I":
                        seq += 1
                    else:
                        i, seq = i + 1, 0
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def repair(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Edits and faults of the conversations of ``turns``:

    * edits ``(key, pos, seq, edit, cost, role, text)``, one row an edit in
      the order (pos, seq); role and text are those of the repaired turn,
      null where it is deleted;
    * faults ``(key, blank, duplicate, truncated, illegal)`` by conversation.
    """
    solved = staged(_blocks(rows, block).select("key", "node", "codes", "before", "more").mapInArrow(_solve, _SOLVED), "blocks")
    single = (F.col("node") == 0) & ~F.col("more")
    found = solved.where(single).select("key", "node", "codes", F.lit(START).alias("q_in"), F.element_at("audits", 1).alias("audit"))
    long = solved.where(~single)
    if not long.isEmpty():
        chosen = _choose_states(long.select("key", "node", "cells"), fan)
        y = long.join(chosen, ["key", "node"])
        i = F.expr("array_position(transform(sequence(0, size(audits) - 1), i -> cells[4 * i] = q_in and cells[4 * i + 1] = q_out), true)")
        found = found.unionByName(y.select("key", "node", "codes", "q_in", F.element_at("audits", i.cast("int")).alias("audit")))
    edits = found.mapInArrow(_expand(block), "key string, pos long, seq int, edit string, new_role string, cost long")
    e, t = edits.alias("e"), rows.select("key", "pos", "role", "text").alias("t")
    role = F.when(F.col("edit") == "K", F.col("t.role")).otherwise(F.col("new_role"))
    text = F.when(F.col("edit") == "I", "").when(F.col("edit") != "D", F.col("t.text"))
    edits = e.join(t, ["key", "pos"]).select("key", "pos", "seq", "edit", "cost", role.alias("role"), text.alias("text"))
    faults = rows.groupBy("key").agg(*[F.count_if(F.col("fault") == k).alias(n) for k, n in ((3, "blank"), (2, "duplicate"), (1, "truncated"))])
    illegal = solved.groupBy("key").agg(F.sum("illegal").alias("illegal"))
    return edits, faults.join(illegal, "key")


def _digest_rows(batches):
    """Rows sorted by conversation and order -> one row a conversation; only
    the running hash and the audit are held."""
    names = ["key", "cost", "audit", "repaired_sha256"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]
    key = None
    cost, audit, sha, began = 0, [], hashlib.sha256(), False
    for b in batches:
        done = []
        for k, e, c, role, text in zip(*[b.column(n).to_pylist() for n in ("key", "edit", "cost", "role", "text")], strict=True):
            if k != key:
                if key is not None:
                    done.append((key, cost, "".join(audit), sha.hexdigest()))
                key, cost, audit, sha, began = k, 0, [], hashlib.sha256(), False
            cost += c
            audit.append(e)
            if e != "D":
                sha.update((("\n" if began else "") + role + ":" + text).encode())
                began = True
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names)
    if key is not None:
        done = [(key, cost, "".join(audit), sha.hexdigest())]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names)


def digest(edits: DataFrame) -> DataFrame:
    """(key, cost, audit, repaired_sha256) of every conversation with edits."""
    x = edits.repartition("key").sortWithinPartitions("key", "pos", "seq")
    return x.mapInArrow(_digest_rows, "key string, cost long, audit string, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """The rows damaged by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row,
    1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the
    user's; nulls are one space."""
    space = F.lit(" ")
    at = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(at.cast("binary")) % 20
    x = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                             kind.alias("kind")).where("kind <> 0")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    x = x.select("*", copies.alias("copy"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return x.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def gaps(rows: DataFrame) -> DataFrame:
    """(key, gaps): turn numbers that are missing between least and greatest."""
    g = rows.groupBy("key").agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"), F.countDistinct("turn").alias("n"))
    return g.select("key", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("n"), F.lit(0)).cast("long").alias("gaps"))
