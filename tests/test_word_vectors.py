"""Trained word vectors against plain versions of each step."""

import collections
import math
import random

import numpy as np
from conftest import SF001

from notewise.operators import features as fe
from notewise.operators import word_vectors as wv
from notewise.plans.catalog import load_all

TEXTS = ["the cat sat on the mat", "A dog sat; on the log!", None, "", "cat dog cat dog", "9 ** 1", "mat"]


def notes(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "note_id long, text string")


def plain_words(text):
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz" else " " for c in text.lower()).split()


def plain_pairs(texts, words, window):
    n = collections.Counter()
    for t in texts:
        w = plain_words(t or "")
        for i in range(len(w)):
            for j in range(max(0, i - window), min(len(w), i + window + 1)):
                if i != j and w[i] in words and w[j] in words:
                    n[w[i], w[j]] += 1 / abs(i - j)
    return n


def test_pairs_and_weights_equal_a_plain_count(spark):
    words = ["the", "cat", "dog", "on", "sat"]
    tokens = wv._tokens(notes(spark), "text", "note_id", False)
    pairs = wv.pair_counts(tokens, words, 3, "note_id")
    want = plain_pairs(TEXTS, words, 3)
    got = {(words[r.a], words[r.b]): r.n for r in pairs.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    of = collections.Counter()
    for (a, _), n in want.items():
        of[a] += n
    total = sum(want.values())
    pmi = {(a, b): math.log(n * total / (of[a] * of[b])) for (a, b), n in want.items()}
    got = {(words[r.a], words[r.b]): r.w for r in wv.ppmi(pairs).collect()}
    want = {k: v for k, v in pmi.items() if v > 1e-12}
    assert {k for k, v in got.items() if v > 1e-12} == want.keys() and all(math.isclose(got[k], v) for k, v in want.items())


def test_factors_equal_the_eigenvectors(spark):
    rng = np.random.default_rng(1)
    low = rng.standard_normal((40, 3))
    dense = low @ np.diag([9.0, -5.0, 3.0]) @ low.T
    rows = [(i, j, float(dense[i, j])) for i in range(40) for j in range(40)]
    matrix = spark.createDataFrame(rows, "a long, b long, w double").repartition(5)
    block = rng.standard_normal((40, 4))
    assert np.allclose(wv.times_block(matrix, block), dense @ block)
    got = wv.factored(matrix, 40, 3)
    values, vectors = np.linalg.eigh(dense)
    top = np.argsort(-np.abs(values))[:3]
    assert np.allclose(np.abs(got), np.abs(vectors[:, top] * np.sqrt(np.abs(values[top]))), atol=1e-6)
    assert wv.factored(matrix.where("a < 2 and b < 2"), 2, 5).shape == (2, 5)


def test_words_in_like_contexts_are_near(spark):
    """Two groups of words that never meet each other's contexts; words of a group share contexts, never a note."""
    rnd = random.Random(5)
    groups = [["alpha", "beta", "gamma"], ["delta", "epsilon", "zeta"]]
    contexts = [[f"c{x}" for x in "abcdefgh"], [f"d{x}" for x in "abcdefgh"]]
    texts = []
    for _ in range(600):
        g = rnd.randrange(2)
        texts.append(" ".join([*rnd.sample(contexts[g], 3), rnd.choice(groups[g]), *rnd.sample(contexts[g], 3)]))
    model = wv.train(notes(spark, texts), dim=4, vocabulary=100)
    for g in groups:
        for w in g:
            score = dict(wv.nearest(model, w, 100))
            assert min(score[x] for x in g if x != w) > 0.8 > 0.3 > max(abs(score[x]) for h in groups if h is not g for x in h)
    got = {r.note_id: np.array(r.embedding) for r in wv.note_vectors(notes(spark, [*texts, "", None, "unknown"]), model).collect()}
    assert len(got) == 602 and not got[600].any() and not got[602].any()
    place = {w: i for i, w in enumerate(model.words)}
    weighted = model.vectors * (1e-3 / (1e-3 + model.share))[:, None]
    for i in (0, 17, 599):
        mean = np.mean([weighted[place[w]] for w in texts[i].split()], axis=0)
        assert np.allclose(got[i], mean / np.linalg.norm(mean), atol=1e-6)


def test_vocabulary_bounds_and_empty_notes(spark):
    model = wv.train(notes(spark), dim=8, vocabulary=3)
    assert model.words == ["cat", "dog", "the"] and model.vectors.shape == (3, 8)
    none = wv.train(notes(spark, [None, "", "1 2 3"]), dim=8)
    assert none.words == [] and wv.note_vectors(notes(spark, ["a"]), none).first().embedding == [0.0] * 8


def test_hashed_encoders_take_no_shuffle(spark):
    for build in (lambda d: fe.bucket_counts(d, 64), lambda d: fe.hashed_vectors(d, 64)):
        plan = build(notes(spark))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("MapInArrow") >= 1
    wide = {r.note_id: r.embedding for r in fe.hashed_vectors(notes(spark), 200).collect()}
    assert len(wide) == 6 and all(len(v) == 200 for v in wide.values()) and not any(wide[3])
    assert math.isclose(np.linalg.norm(wide[6]), 1, rel_tol=1e-6)  # one word: its own signs


def test_the_trained_query_gives_unit_vectors(spark):
    out = load_all()["embed_trained"].fn(spark, SF001).collect()
    assert len(out) == 200
    assert all(len(r.embedding) == 32 and (abs(np.linalg.norm(r.embedding) - 1) < 1e-5 or not any(r.embedding)) for r in out)
