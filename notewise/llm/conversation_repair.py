"""Conversation structure repair by weighted interval parsing.

A conversation is a string of rows; the cheapest edits are wanted that turn its role initials into
``(s?(ua)+)?``. Keeping a row costs 0, giving it the role user or assistant 1, deleting it 2 (required
for blank and duplicate rows), inserting an empty user or assistant turn 5, and a truncated row that
isn't deleted 5 more.

The repair grammar is in Chomsky normal form: one nonterminal X(p, q) for each pair of states of the
role language (0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn),
binary rules X(p, q) -> X(p, r) X(r, q), and one row, edited, as the terminal. A cell holds the minimum
(cost, audit) of one nonterminal over one span of rows, an audit being the edits' initials in order;
cells are closed under insertions at both ends of the span (X over an empty span). Spans are combined
bottom-up by length. Because the nonterminals cover every state at every border, each border of a span
gives the same cells, so one split a span is enough and a conversation of n rows takes n - 1
combinations, not n^3; a span can also be as long as a task's share of a conversation, so a huge
conversation is parsed in pieces by many tasks. A concatenation of least audits is the least: the
letters of a row's edit fix its cost, so no audit of a span is a proper prefix of another one that
costs the same.

Steps: rows are dealt by ranges of (conversation, turn, role, text), which splits a conversation of any
size, and numbered; a table of repeated (role, text) marks gives the duplicates; blocks of at most
``BLOCK`` rows are parsed where they lie; one row a block meets by conversation, where spans are joined
and the audit is cut back into one portion a block; portions meet their rows again by block. The digest
of a repaired conversation is sequential by nature: its rows pass through one task, in order and as a
stream (memory holds one batch). A conversation's audit is one value, so 11 times its length is held
while its blocks are joined.

Cases: a null role or text is one space; a null turn sorts first; rows of one turn are taken by role,
then text; repeated rows are duplicates of the first; rows with a null conversation id form one
conversation; a role that begins with none of s, u, a (the empty one too) can't be kept; an empty table
gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewise.llm.staging import staged

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows that are parsed in one piece, as a power of two.
BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS
SPACES = " \t\n\x0b\x0c\r"
ENDINGS = (".", "!", "?")

_NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
PAIRS = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
_AT = {pq: i for i, pq in enumerate(PAIRS)}
#: For each nonterminal the (left, right) cells of its rules.
_RULES = [[(_AT[p, r], _AT[r, q]) for r in range(4) if (p, r) in _AT and (r, q) in _AT] for p, q in PAIRS]
_NONE = (1 << 60, "")
#: X over the empty span: the least insertions between two states.
_EMPTY = [{(0, 2): (INSERT, "I"), (0, 3): (2 * INSERT, "II"), (1, 2): (INSERT, "I"), (1, 3): (2 * INSERT, "II"),
           (2, 3): (INSERT, "I"), (3, 2): (INSERT, "I")}.get(pq, (0, "") if pq[0] == pq[1] else _NONE) for pq in PAIRS]


def combine(left: list, right: list) -> list:
    """Cells of a span from those of its two parts."""
    out = []
    for rules in _RULES:
        least = min(left[i][0] + right[j][0] for i, j in rules)
        if least >= _NONE[0]:
            out.append(_NONE)
            continue
        out.append((least, min(left[i][1] + right[j][1] for i, j in rules if left[i][0] + right[j][0] == least)))
    return out


def kind(initial: str, fault: str) -> str:
    """One digit for a row: all that the grammar sees of it."""
    if fault in ("blank", "duplicate"):
        return "0"
    return str(1 + "sua".find(initial) % 4 + 4 * (fault == "truncated")) if initial else str(4 + 4 * (fault == "truncated"))


@lru_cache(maxsize=1 << 14)
def _short(kinds: str) -> list:
    """Cells of a span of up to 8 rows."""
    if len(kinds) > 1:
        half = 1 << (len(kinds) - 1).bit_length() - 1
        return combine(_short(kinds[:half]), _short(kinds[half:]))
    k = int(kinds)
    row = []
    for p, q in PAIRS:
        options = [(DELETE, "D")] if p == q else []
        if k:
            more = TRUNCATED if k > 4 else 0
            initial = "suax"[(k - 1) % 4]
            if _NEXT[p].get(initial) == q:
                options.append((KEEP + more, "K"))
            if q in (_NEXT[p].get("u"), _NEXT[p].get("a")):
                options.append((REROLE + more, "R"))
        row.append(min(options, default=_NONE))
    return combine(combine(_EMPTY, row), _EMPTY)


def parse(kinds: str) -> list:
    """Cells of a span of rows, spans combined bottom-up by length."""
    if not kinds:
        return _EMPTY
    return joined([_short(kinds[i:i + 8]) for i in range(0, len(kinds), 8)])


def joined(level: list) -> list:
    """Cells of neighbouring spans, pair by pair, until one span is left."""
    while len(level) > 1:
        level = [combine(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def best(cells: list) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    return min(cells[_AT[0, 0]], cells[_AT[0, 3]])


def _packed(cells: list) -> str:
    return ",".join(f"{c}:{a}" for c, a in cells)


def _unpacked(text: str) -> list:
    return [(int(c), a) for c, _, a in (x.partition(":") for x in text.split(","))]


# ---- rows in order

def in_order(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, pos (order over the whole table), block, mark, ending of each row, written once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        role.alias("role"), text.alias("text"))
    # whole texts would be sampled into the range borders; equal short rows may lie in any order
    rows = rows.withColumns({"head": F.substring("text", 1, 63),
                             "among": F.when(F.length("text") < 64, F.monotonically_increasing_id()).otherwise(F.lit(0))})
    rows = rows.repartitionByRange("conv_id", "turn", "role", "head", "among").sortWithinPartitions(
        "conv_id", "turn", "role", "text")
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    ending = F.when(last == "", "blank").when(last.isin(*ENDINGS), "whole").otherwise("truncated")
    mark = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                           F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("pos"),
                       F.unhex(mark).alias("mark"), ending.alias("ending"))
    return staged(rows.withColumn("block", F.shiftright("pos", BLOCK_BITS)), "turns-in-order")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, pos, block, initial, fault (blank, duplicate, truncated or null) of each row of :func:`in_order`."""
    seen = rows.groupBy("mark").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    out = rows.select("conv_id", "turn", "pos", "block", F.left("role", F.lit(1)).alias("initial"), "mark", "ending").join(
        seen.select("mark", "first"), "mark", "left")
    fault = (F.when(F.col("ending") == "blank", "blank").when(F.col("pos") > F.col("first"), "duplicate")
             .when(F.col("ending") == "truncated", "truncated"))
    return out.select("conv_id", "turn", "pos", "block", "initial", fault.alias("fault"))


# ---- blocks of rows, then conversations

_BLOCK_SCHEMA = ("conv_id long, block long, cells string, n_rows long, blank long, duplicate long, truncated long, illegal long, "
                 "first string, last string, n_turns long, low long, high long")
_LEGAL = {"su", "ua", "au"}


def _block_cells(batches):
    for b in batches:
        t = b.to_pydict()
        out = [[], [], [], [], [], [], [], []]
        for initials, found in zip(t["initials"], t["faults"]):
            kinds = "".join(map(kind, initials, found))
            illegal = sum(x + y not in _LEGAL for x, y in zip(initials, initials[1:]))
            for col, v in zip(out, (_packed(parse(kinds)), len(kinds), found.count("blank"), found.count("duplicate"),
                                    found.count("truncated"), illegal, initials[0], initials[-1])):
                col.append(v)
        arrays = [b.column("conv_id"), b.column("block"), *(pa.array(c, pa.string() if i in (0, 6, 7) else pa.int64())
                                                            for i, c in enumerate(out)),
                  b.column("n_turns"), b.column("low"), b.column("high")]
        yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _BLOCK_SCHEMA.split(", ")])


def blocks(found: DataFrame) -> DataFrame:
    """Cells and counts of each block (at most BLOCK rows) of each conversation."""
    packed = found.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct(
        "pos", "initial", F.coalesce("fault", F.lit("")).alias("fault"), "turn"))).alias("rows"))
    turns = F.filter(F.col("rows.turn"), lambda x: x.isNotNull())
    return packed.select("conv_id", "block", F.col("rows.initial").alias("initials"), F.col("rows.fault").alias("faults"),
                         F.size(F.array_distinct(turns)).cast("long").alias("n_turns"), F.array_min(turns).alias("low"),
                         F.array_max(turns).alias("high")).mapInArrow(_block_cells, _BLOCK_SCHEMA)


#: numbers of a report row: gaps, blank, duplicate, truncated, illegal, cost; of a portion: turns put out before it, in all
_EDIT_SCHEMA = "conv_id long, block long, audit string, numbers array<long>"


def _edits(batches):
    """One report row (block -1) and one portion a block from a stream of blocks in order."""
    held: list[dict] = []
    out: list[tuple] = []

    def close():
        cells = joined([_unpacked(h["cells"]) for h in held])
        cost, audit = best(cells)
        low = [h["low"] for h in held if h["low"] is not None]
        gaps = illegal = 0
        if low:
            high = max(h["high"] for h in held if h["high"] is not None)
            some = [h for h in held if h["low"] is not None]
            n = sum(h["n_turns"] for h in some) - sum(x["high"] == y["low"] for x, y in zip(some, some[1:]))
            gaps = high - low[0] + 1 - n
        illegal = sum(h["illegal"] for h in held) + sum(x["last"] + y["first"] not in _LEGAL for x, y in zip(held, held[1:]))
        counts = [sum(h[c] for h in held) for c in ("blank", "duplicate", "truncated")]
        out.append((held[0]["conv_id"], -1, audit, [gaps, *counts, illegal, cost]))
        letters = np.frombuffer(audit.encode(), dtype=np.uint8)
        ends = np.flatnonzero(letters != ord("I"))[np.cumsum([h["n_rows"] for h in held]) - 1] + 1
        ends[-1] = len(letters)  # what is inserted at the end belongs to the last block
        made = np.concatenate([[0], np.cumsum(letters != ord("D"))])
        for h, a, b in zip(held, [0, *ends[:-1]], ends):
            out.append((h["conv_id"], h["block"], audit[a:b], [int(made[a]), int(made[-1])]))

    def flushed():
        cols = list(zip(*out))
        types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                           names=["conv_id", "block", "audit", "numbers"])
        out.clear()
        return batch

    for b in batches:
        for row in b.to_pylist():
            if held and held[0]["conv_id"] != row["conv_id"]:
                close()
                held.clear()
            held.append(row)
        if out:
            yield flushed()
    if held:
        close()
        yield flushed()


def edits(found: DataFrame) -> DataFrame:
    """The cheapest edits: one report row (block -1) a conversation and one portion of its audit a block, written once."""
    together = blocks(found).repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return staged(together.mapInArrow(_edits, _EDIT_SCHEMA), "conversation-edits")


def report(plan: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation that has rows."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return plan.where("block = -1").select("conv_id", *[F.col("numbers")[i].alias(n) for i, n in enumerate(names)], "audit")


# ---- edited turns

_TURN_SCHEMA = "conv_id long, place long, edit string, role string, text string"


def _streamed(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """Portions, and the rows of their blocks, as one table; a portion has pos -1."""
    none = F.lit(None).cast("string")
    return plan.select("conv_id", "block", F.lit(-1).cast("long").alias("pos"), "audit", "numbers", none.alias("role"),
                       none.alias("text")).unionByName(
        rows.select("conv_id", "block", "pos", none.alias("audit"), F.lit(None).cast("array<long>").alias("numbers"),
                    "role", "text"))


def _edited(batches):
    """(conversation, report numbers and audit or None, turns) of each batch: lists of (key, place, edit, role, text).

    Rows come by (conv_id, block, pos); items that carry a report come before the conversation's turns."""
    letters, at, made, total, key = "", 0, 0, 0, None

    def inserted(until):
        nonlocal at, made
        while at < until:
            role = "user" if (made - total % 2) % 2 == 0 else "assistant"
            yield key, made, "insert", role, ""
            at, made = at + 1, made + 1

    for b in batches:
        out, reports = [], []
        t = b.to_pydict()
        for conv, block, pos, audit, numbers, role, text in zip(
                t["conv_id"], t["block"], t["pos"], t["audit"], t["numbers"], t["role"], t["text"]):
            if pos < 0:
                out.extend(inserted(len(letters)))
                letters, at, key = "", 0, conv
                if block < 0:
                    reports.append((len(out), conv, numbers, audit))
                else:
                    letters, (made, total) = audit, numbers
                continue
            end = at
            while letters[end] == "I":
                end += 1
            out.extend(inserted(end))
            edit = letters[at]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                role = "user" if (made - total % 2) % 2 == 0 else "assistant"
            out.append((conv, made, "keep" if edit == "K" else "rerole", role, text))
            made += 1
        yield out, reports
    yield list(inserted(len(letters))), []


def _turn_rows(batches):
    for out, _ in _edited(batches):
        if out:
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                             names=["conv_id", "place", "edit", "role", "text"])


def repaired_turns(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (keep, rerole, insert), role, text of the repaired conversations' turns.

    ``plan`` of :func:`edits`, ``rows`` of :func:`in_order`. Blocks are edited apart from each other."""
    mixed = _streamed(plan.where("block >= 0"), rows)
    return mixed.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos").mapInArrow(
        _turn_rows, _TURN_SCHEMA)


_DIGEST_SCHEMA = "conv_id long, numbers array<long>, audit string, repaired_sha256 string"


def _digests(batches):
    """One row a conversation: its report and the digest of its repaired turns, read as a stream."""
    state = None  # conversation, numbers, audit, digest so far, whether a turn was read

    def row():
        return state[0], state[1], state[2], state[3].hexdigest()

    for turns, reports in _edited(batches):
        done, i = [], 0
        for stop, conv, numbers, audit in [*reports, (len(turns), None, None, None)]:
            for _, _, _, role, text in turns[i:stop]:
                state[3].update((("\n" if state[4] else "") + role + ":" + text).encode())
                state[4] = True
            i = stop
            if numbers is not None:
                if state is not None:
                    done.append(row())
                state = [conv, numbers, audit, hashlib.sha256(), False]
        if done:
            yield _digest_batch(done)
    if state is not None:
        yield _digest_batch([row()])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      names=["conv_id", "numbers", "audit", "repaired_sha256"])


def digests(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """The report of each conversation with the SHA-256 of its repaired turns (``role:text``, newline-joined)."""
    mixed = _streamed(plan, rows).repartition("conv_id").sortWithinPartitions("conv_id", "block", "pos")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return mixed.mapInArrow(_digests, _DIGEST_SCHEMA).select(
        "conv_id", *[F.col("numbers")[i].alias(n) for i, n in enumerate(names)], "audit", "repaired_sha256")


def repair(turns: DataFrame, **columns) -> tuple[DataFrame, DataFrame]:
    """(plan, rows) of a table of turns, for :func:`report`, :func:`repaired_turns` and :func:`digests`."""
    rows = in_order(turns, **columns)
    return edits(faults(rows)), rows


# ---- damage, as the registered query wants it

def damaged(turns: DataFrame) -> DataFrame:
    """conversations rows damaged by crc32(``conv_id:turn``) % 20; a null is one space.

    0 drops the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 sets the role user."""
    def said(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", "".join(ENDINGS), "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")
