"""Conversation repair, fill-in-middle and exact top-k search against plain versions, and awkward inputs."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF01
from pyspark.sql import functions as F

from notewise.llm import catalog, staging
from notewise.llm import conversation_repair as cr
from notewise.llm import fill_middle as fm
from notewise.llm import pivot_search as ps

QUERIES, _ = catalog.load()

# ---- conversation repair


def every_audit(rows, most_inserts):
    """All (cost, audit) that give legal roles; rows: (initial, fault)."""
    found = []

    def go(i, audit, cost, roles, inserts):
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, audit))
        if inserts < most_inserts:
            for r in "ua":
                go(i, audit + "I", cost + 5, roles + r, inserts + 1)
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, audit + "D", cost + 2, roles, inserts)
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                go(i + 1, audit + "K", cost + more, roles + (initial or "-"), inserts)
                for r in "ua":
                    go(i + 1, audit + "R", cost + 1 + more, roles + r, inserts)

    go(0, "", 0, "", 0)
    return min(found)


def all_splits(kinds):
    """Cells of a span by trying every split of every span (the textbook form)."""
    n = len(kinds)
    cells = {(i, i): cr._EMPTY for i in range(n + 1)} | {(i, i + 1): cr._short(kinds[i]) for i in range(n)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            tries = [cr.combine(cells[i, k], cells[k, i + size]) for k in range(i, i + size + 1) if (i, k) in cells and (k, i + size) in cells]
            cells[i, i + size] = [min(t[x] for t in tries) for x in range(len(cr.PAIRS))]
    return cells[0, n]


def test_cells_equal_all_edits_tried():
    rnd = random.Random(3)
    for _ in range(150):
        rows = [(rnd.choice(["s", "u", "u", "a", "a", "t", ""]), rnd.choice(["", "", "", "blank", "truncated", "duplicate"]))
                for _ in range(rnd.randint(0, 4))]
        assert cr.best(cr.parse("".join(cr.kind(*r) for r in rows))) == every_audit(rows, 3)


def test_one_split_a_span_gives_the_cells_of_all_splits():
    rnd = random.Random(4)
    for n in [1, 2, 3, 5, 8, 13, 17, 30]:
        kinds = "".join(rnd.choice("001233356782") for _ in range(n))
        assert cr.parse(kinds) == all_splits(kinds)
        cut = rnd.randint(0, n)
        assert cr.combine(cr.parse(kinds[:cut]), cr.parse(kinds[cut:])) == cr.parse(kinds)


def plain_repair(rows):
    """rows of one conversation: (turn, role, text); the query's columns by a walk over states."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {0: "su", 1: "u", 2: "a", 3: "u"}
    state = {"s": 1, "u": 2, "a": 3}

    def with_inserts(best):
        for _ in range(2):
            for p, (cost, audit, out) in list(best.items()):
                for c in after[p].replace("s", ""):
                    new = (cost + 5, audit + "I", (*out, ({"u": "user", "a": "assistant"}[c], "")))
                    if state[c] not in best or new[:2] < best[state[c]][:2]:
                        best[state[c]] = new
        return best

    best = with_inserts({0: (0, "", ())})
    for (_, role, text), fault in zip(rows, faults):
        now = {}

        def offer(q, item):
            if q not in now or item[:2] < now[q][:2]:
                now[q] = item
        for p, (cost, audit, out) in best.items():
            offer(p, (cost + 2, audit + "D", out))
            if fault in ("", "truncated"):
                more = 5 * (fault != "")
                if role[:1] and role[:1] in after[p]:
                    offer(state[role[:1]], (cost + more, audit + "K", (*out, (role, text))))
                for c in after[p].replace("s", ""):
                    offer(state[c], (cost + 1 + more, audit + "R", (*out, ({"u": "user", "a": "assistant"}[c], text))))
        best = with_inserts(now)
    cost, audit, out = min(best[q] for q in (0, 3) if q in best)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def conversations():
    rnd = random.Random(5)
    texts = ["Yes.", "Yes.", "no", "Why? ", "", " \n", "A long one " * 9 + "!", "ends here.\x0b", "中文.", "half", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = []
    for conv in [*range(12), None, 40, 41]:
        n = {40: 300, 41: 1}.get(conv, rnd.randint(1, 9))
        rows += [(conv, None if rnd.random() < 0.1 else rnd.randint(0, n), rnd.choice(roles), rnd.choice(texts), "x", 1.5) for _ in range(n)]
    rows += [(50, None, None, None, "x", 1.5)] * 40 + [(50, 3, "user", "same.", "x", 1.5)] * 40
    return rows


CONV_SCHEMA = "conv_id long, turn long, role string, text string, block string, audit double"


def by_conversation(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return out


@pytest.mark.parametrize("bits", [12, 2])
def test_repair_equals_a_plain_walk(spark, monkeypatch, bits):
    """With blocks of 4096 rows and of 4: conversations that lie in many blocks give the same."""
    monkeypatch.setattr(cr, "BLOCK_BITS", bits)
    staging.prepare(spark)
    rows = conversations()
    plan, placed = cr.repair(spark.createDataFrame(rows, CONV_SCHEMA).repartition(5))
    got = {r[0]: tuple(r[1:]) for r in cr.digests(plan, placed).collect()}
    assert got == {c: plain_repair(r) for c, r in by_conversation(rows).items()}
    assert {r[0]: tuple(r[1:]) for r in cr.report(plan).collect()} == {c: r[:-1] for c, r in got.items()}
    turns = {}
    for r in cr.repaired_turns(plan, placed).collect():
        turns.setdefault(r.conv_id, []).append((r.place, r.role, r.text, r.edit))
    for conv, (*_, audit, digest) in got.items():
        mine = sorted(turns.get(conv, []))
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(f"{m[1]}:{m[2]}" for m in mine).encode()).hexdigest() == digest
        assert [{"keep": "K", "rerole": "R", "insert": "I"}[m[3]] for m in mine] == [c for c in audit if c != "D"]
        assert re.fullmatch("(s?(ua)+)?", "".join(m[1][:1] for m in mine))


def test_repair_of_an_empty_table(spark):
    staging.prepare(spark)
    plan, rows = cr.repair(spark.createDataFrame([], CONV_SCHEMA))
    assert cr.digests(plan, rows).count() == 0 and cr.repaired_turns(plan, rows).count() == 0
    assert cr.damaged(spark.createDataFrame([], CONV_SCHEMA)).count() == 0


def test_damage_follows_the_rule(spark):
    rows = [(c, t, r, x) for (c, t), (r, x) in zip(itertools.product([*range(40), None], [*range(6), None]),
                                                   itertools.cycle([("user", "a. b! c?"), ("system", None), (None, "x"), ("assistant", "")]))]
    want = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if code == 0:
            continue
        x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
        want += [(c, t, "user" if code == 4 else r, x)] * (2 if code == 3 else 1)
    got = [tuple(r) for r in cr.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


# ---- fill-in-middle

MARKS = ("<P>", "<S>", "<M>")


def plain_middle(doc_id, text, rate=90, spm=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= rate:
        return text, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return f"<S>{s}<P>{p}<M>{m}", n, "spm", a, b - a, text
    return f"<P>{p}<S>{s}<M>{m}", n, "psm", a, b - a, text


FIM_TEXTS = ["", None, "a", "<", "<P", "<<S", "x<S>y", "P>S>M>", "ab", "é", "😀😀", "中文字 and words", "<<<>>>", "word " * 40_000, "ü" * 100_001]


@pytest.mark.parametrize("settings", [{}, {"rate": 1.0, "spm": 0.5}, {"rate": 0.0}])
def test_middle_equals_a_plain_version_and_goes_back(spark, settings):
    staging.prepare(spark)
    rnd = random.Random(6)
    rows = [(i, t, "z", 1) for i, t in enumerate(FIM_TEXTS)] + [(None, "null id", "z", 1)] * 2
    rows += [(100 + i, "".join(rnd.choice("<PSM>aé😀 \n") for _ in range(rnd.randint(0, 40))), "z", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n long").repartition(3)
    made = fm.transform(docs, **settings)
    back = fm.restore(made.withColumn("kept_beside", F.col("output")))
    want = sorted((str(r[0]), *plain_middle(r[0], r[1], round(100 * settings.get("rate", 0.9)), round(100 * settings.get("spm", 0.2))))
                  for r in rows)
    got = [(str(r.doc_id), r.kept_beside, r.n, r.form, r.prefix_chars, r.middle_chars, r.text) for r in back.collect()]
    assert sorted(got, key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_middle_of_an_empty_table_and_a_broken_output(spark):
    staging.prepare(spark)
    made = fm.transform(spark.createDataFrame([], "doc_id long, text string"))
    assert made.count() == 0 and fm.restore(made).count() == 0
    with pytest.raises(Exception, match="lacks"):
        fm.restore(spark.createDataFrame([("<P>a<S>b", "psm")], "output string, form string")).collect()


# ---- exact top-k

VEC_SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def plain_top(rows, asked, k, scale=1024):
    """{(query id, its vector): [(rank, id, score)]} over all rows that take part, in exact integers."""
    def ints(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v):
            return None
        return [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]
    table = [(i, ints(v)) for i, v in rows if i is not None and ints(v) is not None]
    out = {}
    for q, v in asked:
        x = ints(v)
        if q is None or x is None:
            continue
        scores = sorted((-sum(a * b for a, b in itertools.zip_longest(x, y, fillvalue=0)), i) for i, y in table if i != q)
        out[q, tuple(x)] = [(n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return out


def as_lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("shard_rows,pivots", [(None, 64), (16, 5), (7, 1)])
def test_top_k_equals_all_pairs(spark, shard_rows, pivots):
    staging.prepare(spark)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((6, 12))
    x = centres[rng.integers(0, 6, 500)] + 0.3 * rng.standard_normal((500, 12))
    x[:160] = centres[0]  # a third are equal: ties by id
    x[160:200] *= 30  # long ones
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(900, None), (901, [float("nan")] * 12), (902, [1.0, None] + [0.0] * 10), (903, []), (904, [2.0]), (905, [float("inf")] * 12),
             (None, [1.0] * 12), (7, [0.5] * 12), (906, [0.1] * 14), (1000, [0.0] * 12), (907, [1e30] + [0.0] * 11)]
    df = spark.createDataFrame([(*r, "z", 3) for r in rows], VEC_SCHEMA).repartition(4)
    index = ps.build(df, pivots=pivots, shard_rows=shard_rows)
    asked = [r for r in rows if r[0] is not None and r[0] % 25 == 0]
    got = as_lists(ps.top_k(index, df.where("vec_id % 25 = 0")))
    want = plain_top([r for r in rows if r[0] != 907], asked, 10)
    assert got == {q: v for (q, _), v in want.items()}


def test_top_k_of_few_and_no_rows(spark):
    staging.prepare(spark)
    empty = spark.createDataFrame([], VEC_SCHEMA)
    assert ps.build(empty) is None and ps.top_k(None, empty).count() == 0
    few = spark.createDataFrame([(100, [1.0, 0.0], "z", 1), (100, [1.0, 0.0], "z", 1), (3, [0.5, 1.0], "z", 1), (4, None, "z", 1)], VEC_SCHEMA)
    assert as_lists(ps.top_k(ps.build(few), few.where("vec_id = 100"))) == {100: [(1, 3, 512 * 1024)]}
    two = spark.createDataFrame([(100, [1.0, 0.0], "z", 1), (100, [0.0, 1.0], "z", 1), (3, [0.5, 1.0], "z", 1)], VEC_SCHEMA)
    assert as_lists(ps.top_k(ps.build(two), two.where("vec_id = 100"))) == {100: [(1, 3, 512 * 1024), (1, 3, 1024 * 1024)]}
    assert ps.top_k(ps.build(few), empty).count() == 0


def test_top_k_beyond_floats_is_exact(spark):
    staging.prepare(spark)
    rnd = random.Random(9)
    rows = [(i, [float(np.float32(rnd.randint(-2 ** 19, 2 ** 19))) for _ in range(4)]) for i in range(300)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], VEC_SCHEMA)
    index = ps.build(df, shard_rows=40, pivots=8)
    assert index.top > 2 ** 53
    got = as_lists(ps.top_k(index, df.where("vec_id % 50 = 0"), k=7))
    assert got == {q: v for (q, _), v in plain_top(rows, [r for r in rows if r[0] % 50 == 0], 7).items()}


@pytest.mark.parametrize("name,by", [("op11_conversation_repair", "conv_id"), ("op12_fill_middle", "doc_id")])
def test_queries_return_every_row(spark, name, by):
    table = {"conv_id": "conversations", "doc_id": "documents"}[by]
    ids = staging.read_table(spark, SF01, table).select(by)
    out = QUERIES[name](spark, SF01)
    assert out.count() == (ids.distinct() if by == "conv_id" else ids).count()
