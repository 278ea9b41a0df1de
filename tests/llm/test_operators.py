"""Each operator against a plain version of itself, and awkward inputs."""

import collections
import hashlib
import json
import math
import random
import zlib
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from conftest import SF001, SF01
from pyspark.sql import functions as F

from notewise.llm import (chat, fingerprints, groups, near_text, near_vectors, packing, quality, sentencepieces, staging,
                          textbuf, token_counts, toxicity, url_filter)
from notewise.llm import queries as Q

LONG = " ".join(f"word{i % 997} and" for i in range(20_000))
TEXTS = ["", None, " ", "one", "One  two\nthree", "Ünïcode ça va 中文字 😀 'tis we'll", "<|endoftext|> a\\b <|im_start|> [INST]",
         LONG, LONG + " more", "one", "x" * 3000, "a b c d e f g", "A B C D E F G", "a b c d e f h", "▁▁ marks ▁"]


def awkward(spark, empty=False):
    """Null, empty, long, tied and repeated rows, with columns named like the operators' own."""
    rows = [(None if i == 3 else i, t, "en" if i % 2 else None, 0.5, 7, "z") for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4]]
    schema = "doc_id long, text string, lang string, score double, n long, component_id string"
    staging.prepare(spark)
    return spark.createDataFrame([] if empty else rows, schema), [] if empty else rows


def labels_of(spark, rows):
    return spark.createDataFrame([(r[0], i % 2, i % 2) for i, r in enumerate(rows)] + [(None, 1, 1), (10 ** 9, 1, None)],
                                 "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_documents(spark, empty):
    docs, rows = awkward(spark, empty)
    n = len(rows)
    labels = labels_of(spark, rows)
    assert toxicity.classify(docs, labels).count() == n
    assert fingerprints.edit_report(docs).count() == n
    assert fingerprints.fingerprint(docs).count() == n
    counted = token_counts.count_tokens(docs, Q.PIECES).collect()
    assert len(counted) == n and all(r.n_tokens >= r.n_words >= 0 for r in counted)
    near = near_text.near_duplicates(docs).collect()
    assert len(near) == n
    judged = quality.classify(docs, labels.where("quality = 1").select("doc_id")).collect()
    assert len(judged) == n
    pieces = packing.pack(docs, Q.BYTE_BPE).collect()
    assert (len(pieces) == 0) == empty
    for kept in (toxicity.filter_documents(docs, labels), near_text.drop_copies(docs),
                 quality.filter_documents(docs, labels.where("quality = 1").select("doc_id"))):
        assert kept.columns == docs.columns and kept.count() <= n
    if not empty:
        by = {r.doc_id: r for r in near}
        assert by[None].kept and by[None].component_id is None
        assert by[0].n_shingles == 0 and by[0].component_id == 0
        assert by[3 + 8].component_id == 11 and by[12].component_id == 11  # equal but for case
        assert by[9].component_id == 9 and by[4].component_id == 4
        assert by[8].component_id == 7 and not by[8].kept


def test_nothing_trusted_keeps_everything(spark):
    docs, rows = awkward(spark)
    none = spark.createDataFrame([], "doc_id long")
    assert quality.filter_documents(docs, none).count() == len(rows)


# ---- 1 toxicity

def test_toxicity_finds_held_out_rows_and_ignores_their_labels(spark):
    rnd = random.Random(1)
    bad = ["horrid", "wretch"]
    rows = []
    for i in range(600):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(30)]
        toxic = i % 3 == 0
        if toxic:
            words[rnd.randrange(30)] = rnd.choice(bad) + rnd.choice(["", "ly", "s"])
        rows.append((i, " ".join(words), int(toxic)))
    staging.prepare(spark)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    for i, _, y in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.5)
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.classify(docs, flipped).collect()}
    assert all(math.isclose(again[i], got[i].score, abs_tol=1e-9) for i in again)


def _plain_buckets(text):
    """Buckets of a text's n-grams, one character at a time."""
    low = [ord(c.lower()) if len(c.lower()) == 1 and ord(c) < 0x10000 else ord(c) for c in text]
    out = set()
    for n in toxicity.SIZES:
        for i in range(len(low) - n + 1):
            h = low[i] + 1
            for c in low[i + 1:i + n]:
                h = (h * 0x9E3779B97F4A7C15 + c + 1) % 2 ** 64
            out.add((h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2 ** 64 >> 64 - toxicity.BUCKET_BITS)
    return out


def test_toxicity_model_equals_a_plain_one(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(160):
        words = [rnd.choice(["alpha", "Beta", "gämma", "delta", "中文字符", "epsilon"]) for _ in range(12)]
        y = int(i % 4 == 0)
        words += [rnd.choice(["HORRID", "wretched"] if rnd.random() < (0.9 if y else 0.1) else ["lovely"])]
        rows.append((i, " ".join(words), y))
    staging.prepare(spark)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, y int")
    l2 = 1e-3
    model = toxicity.fit(docs, labels, l2=l2)
    learnt = [(_plain_buckets(t), y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    n1 = sum(y for _, y in learnt)
    n0 = len(learnt) - n1
    p, q = (collections.Counter(b for s, y in learnt if y == c for b in s) for c in (1, 0))
    ratio = {}
    for b in sorted(p.keys() | q.keys()):
        r1, r0 = (p[b] + 1) / (n1 + 2), (q[b] + 1) / (n0 + 2)
        if abs(r1 - r0) >= 3 * math.sqrt(r1 * (1 - r1) / (n1 + 2) + r0 * (1 - r0) / (n0 + 2)):
            ratio[b] = math.log(r1 / r0)
    assert model.buckets.tolist() == list(ratio) and np.allclose(model.ratio, list(ratio.values()))
    place = {b: k for k, b in enumerate(ratio)}

    def scaled(buckets):
        x = np.zeros(len(ratio))
        for b in buckets & ratio.keys():
            x[place[b]] = ratio[b]
        return x / (np.linalg.norm(x) or 1)

    x, y = np.array([scaled(s) for s, _ in learnt]), np.array([y for _, y in learnt])
    odds = 1 / (1 + np.exp(-(x @ model.weight + model.intercept)))
    gradient = np.append(x.T @ (odds - y) / len(y) + l2 * model.weight, np.mean(odds - y))
    assert np.abs(gradient).max() < 1e-4  # the one minimum of a convex loss
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, t, _ in rows:
        assert math.isclose(got[i], 1 / (1 + math.exp(-(scaled(_plain_buckets(t)) @ model.weight + model.intercept))), abs_tol=1e-9)


def test_ngrams_do_not_cross_rows():
    col = pa.array(["abcdefgh", "", "zyxwvuts"])
    (_, data, off), = textbuf.slices(col)
    together = [set(map(tuple, np.stack(g, 1).tolist())) for g in toxicity.grams(data, off)]
    for row, text in ((0, "abcdefgh"), (2, "zyxwvuts")):
        (_, d, o), = textbuf.slices(pa.array([text]))
        for k, (_, b) in enumerate(toxicity.grams(d, o)):
            assert {x for r, x in together[k] if r == row} == set(b.tolist())


# ---- 2 sentencepiece

def test_sentencepiece_equals_the_library(spark):
    staging.prepare(spark)
    rnd = random.Random(4)
    texts = [t for t in TEXTS if t] + ["".join(rnd.choice("the and  \nÉß文😀qz.,") for _ in range(rnd.randint(1, 60))) for _ in range(150)]
    texts = [t.replace("▁", " ") for t in texts]
    docs = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string").repartition(3, "doc_id")
    docs = staging.staged(docs, "sp-test")
    got = {r.doc_id: r for r in sentencepieces.decode(sentencepieces.encode(docs, Q.PIECES), Q.PIECES).collect()}
    sp = sentencepieces.model(Q.PIECES)
    assert len(got) == len(texts) + 2 and got[len(texts)].ids == [] and got[len(texts) + 1].text == ""
    for i, t in enumerate(texts):
        assert got[i].text == t
        assert got[i].ids == sp.encode(t), t


def test_long_words_equal_the_library(spark):
    staging.prepare(spark)
    rnd = random.Random(9)
    letters = lambda some, n: "".join(rnd.choice(some) for _ in range(n))
    texts = ["x" * 3000, "-" * 2000, "=" * 2000, letters("acgt", 20_000), " " * 5000, "a " * 40 + "-" * 513 + "é文😀" * 300]
    docs = staging.staged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "sp-long")
    got = {r.doc_id: r for r in sentencepieces.encode(docs, Q.PIECES, decoded=True).collect()}
    sp = sentencepieces.model(Q.PIECES)
    for i, t in enumerate(texts):
        assert got[i].ids == sp.encode(t) and got[i].text == t, t[:20]


def test_folds_of_long_words_equal_the_lattice(spark):
    rnd = random.Random(10)
    table, to_byte, unknown = sentencepieces.piece_scores(Q.PIECES)
    pieces, same_bytes, same_unknown = sentencepieces.piece_table(spark, Q.PIECES)
    assert (to_byte, unknown) == (same_bytes, same_unknown)
    words = ["".join(rnd.choice("thean-=é文▁") for _ in range(rnd.randint(1, 90))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(words)), "h long, word string")
    edges = sentencepieces.lattice(rows, pieces, to_byte, unknown, max(map(len, table))).cache()
    for fold, plain in ((sentencepieces.merged_path, lambda w: sentencepieces.merged_long(w, table, to_byte)),
                        (sentencepieces.best_path, lambda w: sentencepieces.best_long(w, table, to_byte, unknown))):
        assert {r.h: r.ids for r in fold(edges).collect()} == dict(enumerate(map(plain, words)))


def test_viterbi_fold_equals_a_plain_one(spark):
    rnd = random.Random(8)
    vocab = {w: -rnd.random() * 10 for w in {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(40)}}
    for c in "abc":
        vocab.setdefault(c, -9.0)
    pieces = spark.createDataFrame([(p, i, s) for i, (p, s) in enumerate(vocab.items())], "piece string, id int, score double")
    ids = {p: i for i, p in enumerate(vocab)}
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 20))) for _ in range(120)]
    to_byte = list(range(1000, 1256))
    rows = spark.createDataFrame(list(enumerate(words)), "h long, word string")
    got = {r.h: r.ids for r in sentencepieces.best_path(sentencepieces.lattice(rows, pieces, to_byte, -25.0, 4)).collect()}
    for h, w in enumerate(words):
        best = [(0.0, [])] + [None] * len(w)
        for e in range(1, len(w) + 1):
            for s in range(max(0, e - 4), e):
                p = w[s:e]
                if p in vocab or e - s == 1:
                    score = best[s][0] + vocab.get(p, -25.0)
                    if best[e] is None or score > best[e][0]:
                        best[e] = (score, best[s][1] + ([ids[p]] if p in vocab else [1000 + ord(p)]))
        assert got[h] == best[-1][1]


# ---- 3 URL filters

def test_rules_by_index_and_by_join(spark):
    staging.prepare(spark)
    urls = [None, "", "no scheme", "http://Example.ORG/es/x", "https://a.b.example.org/en/12?q#f", "http://example.org",
            "http://org/", "ftp://x.com/de/1", "http://com/fr/", "http://notexample.org/es/", "x://y://z.org/a", "http://.org/é"] * 2
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame(Q.URL_RULES + [("com", "/de/1", "allow"), ("com", "/de/1", "block"), (None, "/", "block")],
                                  "host string, path string, verdict string")
    a = sorted(map(tuple, url_filter.filter_urls(pages, rules).collect()))
    b = sorted(map(tuple, url_filter.filter_urls(pages, rules, max_index_bytes=0).collect()))
    assert a == b
    by = {r[0]: r[1:] for r in a}
    assert by[0] == ("", "", None, "allow") == by[2]
    assert by[3] == ("example.org", "/es/x", "example.org/es/", "block")
    assert by[4] == ("a.b.example.org", "/en/12", "example.org/en/1", "block")
    assert by[5] == ("example.org", "", None, "allow") and by[6][2:] == ("org/", "allow")
    assert by[7][2:] == ("com/de/1", "block") and by[9][2] == "org/" and by[10][0] == "y:"
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_filter.filter_urls(pages, empty).collect()} == {"allow"}


def test_digest_collisions_are_confirmed(monkeypatch):
    monkeypatch.setattr(url_filter, "digest", lambda text: len(text) % 2)
    rules = [(h, p, v == "block") for h, p, v in Q.URL_RULES]
    index = url_filter._index("collide", url_filter.DigestIndex.arrays(rules))
    rule, verdict = index.judge(["x.example.org", "a.com", "net"], ["/es/1", "/de/", "/"])
    assert rule == ["example.org/es/", "com/de/", None] and verdict == ["block", "block", "allow"]


# ---- 4 vectors

def test_vector_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    staging.prepare(spark)
    base = rng.standard_normal((300, 64))
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(base)]
    hub = base[0]
    for k in range(120):
        rows.append((1000 + k, [float(x) for x in hub + rng.standard_normal(64) * 0.1 * rng.random()], 0))
    rows += [(2000 + k, rows[5][1], 2) for k in range(30)] + [(3000, rows[5][1], 1)]
    rows += [(4000, None, 1), (4001, [0.0] * 64, 1), (4002, [float("nan")] * 64, 1), (4003, [1.0, None], 1), (4004, rows[5][1], None),
             (4005, [], 1), (4006, [float("inf")] * 64, 1), (None, rows[5][1], 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    got = {r.vec_id: r for r in near_vectors.near_duplicates(df).collect()}
    good = [(i, np.array(v), lab) for i, v, lab in rows if i is not None and i < 4000]
    links = collections.defaultdict(set)
    for x, (i, v, a) in enumerate(good):
        for j, w, b in good[:x]:
            if a == b and v @ w >= 0.98 * np.linalg.norm(v) * np.linalg.norm(w):
                links[i].add(j)
                links[j].add(i)
    for i, _, _ in good:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), min(seen), i == min(seen))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(4000, 4007))
    assert got[None].n_links == 0 and got[None].kept
    assert near_vectors.near_duplicates(df.limit(0)).count() == 0


def test_caps_equal_all_directions_above_the_bar(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((40, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for number in range(near_vectors.CODES):
        turn, cut, (w1, w2) = near_vectors.code(10, 64, number)
        y = x @ turn
        scores = (y[:, :cut] @ w1.T)[:, :, None] + (y[:, cut:] @ w2.T)[:, None, :]
        height = NormalDist().inv_cdf(1 - near_vectors.CAPS / 64 ** 2) / np.sqrt(10) * np.sqrt(2)
        for top in (near_vectors._TOP, 6):  # with few scores combined at first the rest is listed by search
            monkeypatch.setattr(near_vectors, "_TOP", top)
            monkeypatch.setattr(near_vectors, "LEAST", 6)
            for got, s in zip(near_vectors.caps(x, 64, number), scores.reshape(40, -1)):
                bar = min(height, np.sort(s)[-6])
                assert (got == np.flatnonzero(s >= bar - 1e-12) + number * 64 ** 2).all()
            monkeypatch.undo()


def test_a_bar_that_is_a_sum_is_exceeded_by_that_pair():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a, b = rng.standard_normal((2, 30)) / 6
        sums = (a[:, None] + b[None, :]).ravel()
        bar = np.sort(sums)[-6]  # whether a[i] - bar is rounded up or down
        assert np.sort(near_vectors._exceeding(a, b, bar)).tolist() == np.flatnonzero(sums >= bar).tolist()


def test_codewords_grow_without_a_limit_and_codes_cover_each_other():
    assert [near_vectors.codewords(n) for n in (0, 10 ** 6, 10 ** 8, 10 ** 10)] == [64, 16384, 131072, 2097152]
    rng = np.random.default_rng(6)
    x, z = rng.standard_normal((2, 2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98 ** 2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    met = np.zeros(len(x), bool)
    for number in range(near_vectors.CODES):
        met |= [len(np.intersect1d(a, b)) > 0 for a, b in zip(*(near_vectors.caps(v, 4096, number) for v in (x, y)))]
    assert met.all()


def test_large_groups_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(groups, "BLOCK", 16)
    members = spark.createDataFrame([(1, 60, i) for i in range(60)], "bucket long, n long, id long")
    rows = groups.in_blocks(members).collect()
    met = collections.defaultdict(set)
    for r in rows:
        met[r.lo, r.hi].add((r.side, r.id))
    pairs = collections.Counter()
    for (lo, hi), m in met.items():
        for s, i in m:
            for t, j in m:
                if i < j and (lo == hi or s != t):
                    pairs[i, j] += 1
    assert len(pairs) == 60 * 59 // 2 and set(pairs.values()) == {1}


def test_components_of_a_long_chain(spark):
    ids = list(range(400))
    random.Random(2).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])) + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in groups.components(edges).collect()}
    assert all(got[i] == 0 for i in ids if i) and got[1001] == 1000


# ---- 5 fingerprints

def test_edited_texts_and_equal_texts(spark):
    df = staging.read_table(spark, SF001, "documents").select("doc_id", "text")
    df = df.unionByName(df.where("doc_id < 3").withColumn("doc_id", F.col("doc_id") + 10_000))
    rows = sorted(((r.doc_id, r.text) for r in df.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.edit_report(df).collect()}
    nxt = {a[0]: b for a, b in zip(rows, rows[1:] + rows[:1])}
    for i, t in rows:
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[i][1][:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_next == fingerprints.likeness(r.fingerprint, got[nxt[i][0]].fingerprint)
        assert 0 <= r.near_edited <= 1 and (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint)
    assert all(got[i].fingerprint == got[i + 10_000].fingerprint for i in range(3))
    assert np.mean([r.near_edited for r in got.values()]) > 5 * np.mean([r.near_next for r in got.values()])


def test_document_frequencies(spark):
    docs = spark.createDataFrame([(1, "a b A"), (2, "b c"), (3, "")], "doc_id long, text string")
    got = sorted(r.df for r in fingerprints.document_frequencies(docs).collect())
    assert got == [1, 1, 2]


# ---- 6 token counts

def test_automaton_equals_greedy_matching():
    rnd = random.Random(6)
    for complete in (True, False):
        vocab = {"".join(rnd.choice("ab▁c") for _ in range(rnd.randint(1, 6))).encode() for _ in range(60)}
        vocab |= {bytes([b]) for b in range(256)} if complete else {b"a"}
        auto = token_counts.PieceAutomaton(vocab)
        for _ in range(600):
            word = "".join(rnd.choice("abc▁d") for _ in range(rnd.randint(0, 25))).encode()
            at = n = 0
            while at < len(word):
                size = next((k for k in range(len(word) - at, 0, -1) if word[at:at + k] in vocab), 0)
                if not size:
                    n = 1
                    break
                at, n = at + size, n + 1
            assert auto.count(word) == n, word


def test_counts_of_documents(spark):
    df = staging.read_table(spark, SF001, "documents")
    vocab = set(token_counts.sentencepiece_vocabulary(Q.PIECES))
    longest = max(map(len, vocab))
    got = {r.doc_id: r for r in token_counts.count_tokens(df, Q.PIECES).collect()}
    for r in df.limit(25).collect():
        words, n = r.text.encode().split(), 0
        for w in words:
            w = token_counts.WORD_MARK.encode() + w
            at = 0
            while at < len(w):
                at += next(k for k in range(min(longest, len(w) - at), 0, -1) if w[at:at + k] in vocab)
                n += 1
        assert (got[r.doc_id].n_words, got[r.doc_id].n_tokens) == (len(words), n)


# ---- 7 chat

def test_layouts_become_the_same_turns(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "extra": 1}], "id": 5},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"}, {"prompt": "q", "response": "a"}, {"instruction": "q", "output": "a"},
        {"turns": [{"turn": 1, "role": "assistant", "text": "a"}, {"turn": 0, "role": "user", "text": "q"}]},
        {"instruction": "q", "input": "", "output": "a"}, {"instruction": "q", "input": "more", "output": "a"},
        {"prompt": None, "completion": "a"}, {"unknown": 1}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(99, None), (98, "{broken")], "id long, j string")
    rows = chat.turns_of_json(df, "id", "j")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in rows.collect()}
    want = [("user", "q"), ("assistant", "a")]
    assert all(got[i] == want for i in range(7))
    assert got[7] == [("user", "q\n\nmore"), ("assistant", "a")] and got[8][0] == ("user", "")
    assert got[9] == got[99] == got[98] == []
    back = {r.conv_id: r for r in chat.read_back(chat.format_turns(rows)).collect()}
    assert back[0].loss_text == "a" and [tuple(t) for t in back[0].turns] == want and back[9].formatted_chars == 0


def test_control_strings_come_back(spark):
    rnd = random.Random(7)
    parts = ["<|", "|>", "<|end|>", "<|turn|>", "\\", "[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "|", "<", "[", "é", "\n", "x", "<\\|"]
    convs = [(i, [("".join(rnd.choice(parts) for _ in range(2)) if k % 3 else "assistant",
                   "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))) for k in range(rnd.randint(0, 5))]) for i in range(150)]
    df = spark.createDataFrame(convs, f"conv_id long, turns {chat.TURNS}")
    out = chat.format_turns(df)
    made = {r.conv_id: r.formatted for r in out.collect()}
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    for i, turns in convs:
        assert [tuple(t) for t in back[i].turns] == turns
        assert back[i].loss_text == "".join(t for r, t in turns if r == "assistant")
        assert made[i].count("<|end|>") == len(turns) and "[INST]" not in made[i] and "</s>" not in made[i]


def test_turn_rows_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, 1, "assistant", None, 0), (1, 0, None, "q", 0), (1, 1, "assistant", "b", 0),
                                (None, 0, "user", "x", 0)], "conv_id long, turn long, role string, text string, turns int")
    rows = chat.turns_of_table(chat.rows_to_records(df), "conv_id").collect()
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in rows}
    assert got == {1: [("", "q"), ("assistant", ""), ("assistant", "b")], None: [("user", "x")]}
    assert chat.rows_to_records(df.limit(0)).count() == 0


# ---- 8 packing

def test_split_equals_the_tokenizer():
    encoder = packing.ByteBpe(Q.BYTE_BPE, memo=50)
    rnd = random.Random(3)
    al = "a b  \n\t'sreveldtm 1²½é ß,.!—中文😀<|endoftext|>́ا٣"
    texts = ["".join(rnd.choice(al) for _ in range(rnd.randint(0, 50))) for _ in range(1500)] + [t or "" for t in TEXTS]
    for ids, t in zip(encoder.encode_column(pa.array(texts)), texts):
        assert ids.tolist() == encoder.tok.encode(t, add_special_tokens=False).ids, t


def test_assignment_fills_sequences():
    rnd = random.Random(5)
    for _ in range(40):
        sizes = [rnd.randint(1, 63) for _ in range(rnd.randint(0, 80))]
        placed = packing.assign(np.array(sizes, dtype=np.int64), 64, 1.0, 1.0)
        for i, n in enumerate(sizes):
            at = sorted((s, k) for j, s, k, _, _ in placed if j == i)
            assert sum(k for _, k in at) == n and [s for s, _ in at] == list(np.cumsum([0] + [k for _, k in at])[:-1])
        by = collections.defaultdict(list)
        for _, _, k, b, o in placed:
            by[b].append((o, k))
        for spans in by.values():
            spans.sort()
            used = sum(k for _, k in spans)
            assert [o for o, _ in spans] == list(np.cumsum([0] + [k for _, k in spans])[:-1])
            assert used <= 64 and used & (used - 1) == 0


def test_packed_documents(spark):
    docs = staging.read_table(spark, SF001, "documents")
    pieces = packing.pack(docs, Q.BYTE_BPE, group_rows=50).collect()
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(Q.BYTE_BPE)
    by = collections.defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    for r in docs.collect():
        ids = np.array(tok.encode(r.text, add_special_tokens=False).ids + [0], dtype="<u4")
        at = 0
        for p in sorted(by[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


# ---- 9 near-duplicates

def test_components_equal_brute_force(spark):
    rnd = random.Random(11)
    rows = [(r.doc_id, r.text) for r in staging.read_table(spark, SF001, "documents").collect()]
    base = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(120)]
    for i in range(150):  # a large group with links at every distance
        words = list(base)
        for _ in range(rnd.randint(0, 8)):
            words[rnd.randrange(120)] = f"w{rnd.randrange(9999)}"
        rows.append((5000 + i, " ".join(words)))
    for i in range(40):
        words = [f"s{rnd.randrange(3)}" for _ in range(rnd.randint(1, 9))]
        rows.append((6000 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in near_text.near_duplicates(df).collect()}
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(i for i in sets if sets[i])
    for x, i in enumerate(ids):
        for j in ids[:x]:
            k = len(sets[i] & sets[j])
            if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), find(i), find(i) == i)


def test_no_link_of_short_texts_is_lost(spark):
    """Pairs at Jaccard 0.75 or little more (words i to j of a text of their own), and one just below."""
    staging.prepare(spark)
    kinds = [((0, 8), (0, 7), True), ((0, 12), (0, 10), True), ((0, 11), (1, 12), True), ((0, 14), (0, 12), True),
             ((0, 13), (0, 12), True), ((0, 10), (1, 11), False), ((0, 7), (0, 6), False)]
    rows = []
    for i in range(3000):
        words = [f"{i}w{k}" for k in range(20)]
        for side in (0, 1):
            for kind, spans in enumerate(kinds):
                rows.append((100 * i + 2 * kind + side, " ".join(f"{kind}{w}" for w in words[slice(*spans[side])])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_text.near_duplicates(df).collect()}
    for i in range(3000):
        for kind, (_, _, linked) in enumerate(kinds):
            at = 100 * i + 2 * kind
            assert (got[at], got[at + 1]) == (at, at if linked else at + 1), (i, kind)


def test_empty_registers_borrow_on_their_own():
    rng = np.random.default_rng(6)
    lost = 0
    for _ in range(3000):
        a = np.sort(rng.integers(0, 2 ** 63, 4, dtype=np.uint64) * np.uint64(2))
        both = np.stack([near_text.sketch(a), near_text.sketch(np.delete(a, rng.integers(4)))])
        keys = near_text.band_keys(both)
        lost += not (keys[0] == keys[1]).any() or near_text.estimates(both)[0, 1] < near_text.ESTIMATE
    assert lost <= 1


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.75, 0.9):
        errors = []
        for _ in range(30):
            u = rng.integers(0, 2 ** 63, 600, dtype=np.uint64) * np.uint64(2)
            k = int(600 * share)
            a, b = np.sort(u[:k + (600 - k) // 2]), np.sort(np.concatenate([u[:k], u[k + (600 - k) // 2:]]))
            est = near_text.estimates(np.stack([near_text.sketch(a), near_text.sketch(b)]))[0, 1]
            errors.append(est - k / 600)
        assert abs(np.mean(errors)) < 0.03


def test_intersections_are_exact():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 500, rng.integers(0, 200)).astype(np.uint64)) for _ in range(30)]
    got = near_text.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30) if i != j)


# ---- 10 quality

def _kneser_ney(texts, discounts):
    """Plain interpolated modified Kneser-Ney over the same n-grams."""
    top = collections.Counter()
    for t in texts:
        sym = [quality.START] * (quality.ORDER - 1) + [ord(c) for c in t]
        for i in range(len(t)):
            top[tuple(sym[i:i + quality.ORDER])] += 1
    counts = {quality.ORDER: top}
    for k in range(quality.ORDER - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])

    def p(g):
        if not g:
            return 1 / (1 << quality.SYMBOL_BITS)
        k = len(g)
        d = discounts[k]
        ctx = [n for h, n in counts[k].items() if h[:-1] == g[:-1]]
        if not ctx:
            return p(g[1:])
        less = lambda n: d[min(n, 3) - 1]
        n = counts[k][g]
        return ((n - less(n) if n else 0) + sum(map(less, ctx)) * p(g[1:])) / sum(ctx)
    return counts, p


def test_language_model_equals_a_plain_one(spark, monkeypatch):
    staging.prepare(spark)
    texts = ["abracadabra abra", "cadabra abrac", "aab bba"]
    trusted = spark.createDataFrame([(t,) for t in texts], "text string")
    model = staging.staged(quality.train(trusted), "lm-test")
    tables = {k: spark.createDataFrame([(n,) for n in c.values()], "n long") for k, c in _kneser_ney(texts, {})[0].items()}
    discounts = {k: quality.discounts(t) for k, t in tables.items()}
    _, p = _kneser_ney(texts, discounts)
    new = ["abra zeb", "cad", "", "bab"]
    docs = spark.createDataFrame(list(enumerate(new)), "doc_id long, text string")
    for shard_rows in (10 ** 6, 40):
        scored, total, size = quality.with_logp(docs, model, shard_rows=shard_rows)
        for r in scored.collect():
            sym = [quality.START] * (quality.ORDER - 1) + [ord(c) for c in r.text]
            want = sum(math.log(p(tuple(sym[i:i + quality.ORDER]))) for i in range(len(r.text)))
            assert math.isclose(r[total], want, rel_tol=1e-5, abs_tol=1e-6) and r[size] == len(r.text)


def test_rare_code_points_share_one_symbol_and_common_ones_do_not(spark):
    staging.prepare(spark)
    texts = ["中文字 中文 한국어 😀", "中文 abc 한국", "abc ab a"]
    trusted = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = collections.Counter("".join(texts))
    for size in (quality.RARE, 5):
        points = quality.alphabet(trusted, size)
        want = sorted(ord(c) for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size])
        assert points.tolist() == want
        model = staging.staged(quality.train(trusted, alphabet_size=size), "lm-rare")
        known = set(want)
        coded = ["".join(c if ord(c) in known else "\0" for c in t) for t in texts]  # rare ones folded beforehand
        same = staging.staged(quality.train(spark.createDataFrame([(t,) for t in coded], "text string")), "lm-coded")
        new = ["文字 中", "日本 語", "한 abc 😀", "Zz"]
        folded = ["".join(c if ord(c) in known else "\0" for c in t) for t in new]
        sums = []
        for m, rows in ((model, new), (same, folded)):
            docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
            scored, total, _ = quality.with_logp(docs, m)
            sums.append([r[total] for r in scored.orderBy("doc_id").collect()])
        assert np.allclose(*sums, rtol=1e-6)


def test_junk_goes_and_clean_text_stays(spark):
    got = {r.doc_id: r.kept for r in Q.op10_quality_classifier(spark, SF01).collect()}
    known = spark.read.parquet(f"{SF01}/labels.parquet").collect()
    clean = [got[r.doc_id] for r in known if r.quality == 1]
    junk = [got[r.doc_id] for r in known if r.quality == 0]
    assert sum(clean) / len(clean) > 0.99 and sum(junk) / len(junk) < 0.35


def test_threshold_is_a_quantile_of_held_out_trusted_rows(spark):
    docs, labels = (staging.read_table(spark, SF01, t) for t in ("documents", "labels"))
    out = quality.classify(docs, labels.where("quality = 1").select("doc_id"), least=5)
    held = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(10)) == 0
    rows = out.join(labels.select("doc_id", "quality"), "doc_id").withColumn("held", held).where("perplexity is not null").collect()
    by = collections.defaultdict(list)
    for r in rows:
        if r.held and r.quality == 1:
            by[r.lang].append(r)
    own = [x for x in by.values() if len(x) >= 5]
    assert own
    for x in own:  # fewer than 200 rows: the 0.995 quantile is the largest
        assert math.isclose(x[0].threshold, max(r.perplexity for r in x), rel_tol=1e-6)
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(junk) / len(junk) < 0.05
