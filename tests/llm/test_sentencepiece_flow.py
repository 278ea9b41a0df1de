"""op2's data flow: numbers of words, and one exchange of the words for all that read them."""

import numpy as np

from notewise.llm import queries as Q
from notewise.llm import sentencepieces


def test_keys_are_numbered_in_the_order_in_which_they_come():
    first, number = sentencepieces._in_order([np.array([9, 4, 9], dtype=np.uint64), np.array([7, 4, 1, 9], dtype=np.uint64)])
    assert first.tolist() == [0, 1, 3, 5] and number.tolist() == [0, 1, 0, 2, 1, 3, 0]
    assert sentencepieces._in_order([])[0].tolist() == []


def test_words_are_exchanged_once(spark):
    texts = ["some words and some more words", None, "", "x" * 100 + " words", "=" * 700, "words  and=" + "=" * 700, "some"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sentencepieces.encode(docs, Q.PIECES, decoded=True)
    sp = sentencepieces.model(Q.PIECES)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows[i].text == (t or "") and list(rows[i].ids) == (sp.encode(t) if t else [])
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    mine = [x for x in plan.splitlines() if "REPARTITION_BY_COL" in x]
    assert sum("ReusedExchange" not in x for x in mine) == 1 and len(mine) == 3


def test_answers_travel_packed_a_row_a_chunk(spark):
    rnd = np.random.default_rng(5)
    rows = [(chunk, at, rnd.integers(0, 32_000, rnd.integers(1, 6)).tolist())
            for chunk in (3 << 36, 7) for at in np.sort(rnd.choice(250_000, 3_000, replace=False)).tolist()]
    rows.append((9, 249_999, [0] * 2_048))
    answers = spark.createDataFrame(rows, "chunk long, at int, ids array<int>").repartition(2, "at")
    got = sentencepieces._packed(answers.sortWithinPartitions("chunk", "at")).collect()
    assert len(got) == 5 and sorted({r.chunk for r in got}) == [7, 9, 3 << 36]  # a row a partition and chunk
    assert sum(len(r.answers) for r in got) < 12 * len(rows)
    back = []
    for chunk in (3 << 36, 7, 9):
        at, size, ids = sentencepieces._unpacked([r.answers for r in got if r.chunk == chunk])
        end = np.cumsum(size)
        back += sorted((chunk, int(a), ids[e - n:e].tolist()) for a, n, e in zip(at, size, end))
    assert back == rows
    assert [len(x) for x in sentencepieces._unpacked([])] == [0, 0, 0]
    assert sentencepieces._packed(answers.where("at < 0")).collect() == []


def test_the_way_back_shuffles_packed_answers_only(spark):
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(50)], "doc_id long, text string")
    plan = sentencepieces.encode(docs, Q.PIECES)._jdf.queryExecution().optimizedPlan().toString()
    top = plan[:plan.index("Join")].splitlines()  # from the cogroup down to the join of words and ids
    assert any("MapInArrow" in x and "answers" in x for x in top), plan
