"""Word vectors trained on the notes: pointwise mutual information, factored by a randomised block method.

1. The ``vocabulary`` most frequent words (ties by the word) get numbers; other words are skipped, but keep
   their place.
2. Words at most ``window`` places apart in a note are counted, nearer ones for more (1 / distance), first
   inside a batch, then by pair.
3. A pair's weight is max(0, log(n_ab n / (n_a n_b))), the positive pointwise mutual information.
4. That symmetric sparse matrix is multiplied a few times with a block of dim + ``EXTRA`` vectors (each time
   one pass over its entries, summed by row), which turns the block towards its leading space; projected on
   the block it is a small matrix whose eigenvectors give the factors. A word's vector is its row of
   Q U sqrt(|lambda|).
5. A note's vector is the mean of its words' vectors, each weighted by a / (a + p(word)), unit length.

What the driver and each task hold is the vocabulary and vocabulary x (dim + EXTRA) numbers, so
``vocabulary`` is the bound (4,096 x 42 by default: 1.4 MB; 200,000 x 110: 176 MB). Pairs are counted over all
notes and never collected. Null texts are dropped; a note without known words is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.operators.features import tokens_of, vector_batch, word_batches
from notewise.session import materialize, ship_package

EXTRA = 10
ROUNDS = 4
SMOOTH = 1e-3


@dataclass
class WordVectors:
    words: list[str]
    vectors: np.ndarray  # one row a word
    share: np.ndarray    # of all words in the notes


def _tokens(df: DataFrame, text_col: str, key: str, cleaned: bool) -> DataFrame:
    return tokens_of(df.where(F.col(text_col).isNotNull()).select(key, text_col), text_col, cleaned).select(key, "tokens")


def _known(words: list[str], place: dict[str, int]) -> np.ndarray:
    return np.array([place.get(w, -1) for w in words], dtype=np.int64)


def pair_counts(tokens: DataFrame, words: list[str], window: int, key: str) -> DataFrame:
    """a, b, n: how often (weighted by 1 / distance) word b stands within ``window`` places of word a, both ways."""
    place = tokens.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    size = len(words)

    def run(batches):
        for keys, seen, index, offsets in word_batches(batches, key):
            if not len(index):
                continue
            number = _known(seen, place.value)[index]
            note = np.repeat(np.arange(len(keys)), np.diff(offsets))
            pairs, weights = [], []
            for d in range(1, window + 1):
                a, b = number[:-d], number[d:]
                ok = (a >= 0) & (b >= 0) & (note[:-d] == note[d:])
                for x, y in ((a, b), (b, a)):
                    pairs.append(x[ok] * size + y[ok])
                    weights.append(np.full(ok.sum(), 1.0 / d))
            pair, at = np.unique(np.concatenate(pairs), return_inverse=True)
            if len(pair):
                n = np.bincount(at, np.concatenate(weights))
                yield pa.RecordBatch.from_arrays([pa.array(pair // size), pa.array(pair % size), pa.array(n)], names=["a", "b", "n"])
    found = tokens.mapInArrow(run, "a long, b long, n double")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"))


def ppmi(pairs: DataFrame) -> DataFrame:
    """a, b, w of the pairs whose pointwise mutual information is positive."""
    sums = F.broadcast(pairs.groupBy("a").agg(F.sum("n").alias("of")))  # one row a word of the vocabulary
    total = pairs.agg(F.sum("n")).scalar()
    out = pairs.join(sums.withColumnRenamed("of", "of_a"), "a").join(
        sums.select(F.col("a").alias("b"), F.col("of").alias("of_b")), "b")
    return out.select("a", "b", F.log(F.col("n") * total / (F.col("of_a") * F.col("of_b"))).alias("w")).where("w > 0")


def times_block(matrix: DataFrame, block: np.ndarray) -> np.ndarray:
    """matrix (a, b, w) @ block, one pass over the entries; rows are summed inside a batch, then by row."""
    shared = matrix.sparkSession.sparkContext.broadcast(block)
    width = block.shape[1]

    def run(batches):
        for b in batches:
            a, at = np.unique(b.column("a").to_numpy(), return_inverse=True)
            order = np.argsort(at, kind="stable")
            v = shared.value[b.column("b").to_numpy()[order]] * b.column("w").to_numpy()[order, None]
            starts = np.searchsorted(at[order], np.arange(len(a)))
            yield vector_batch(pa.array(a), np.add.reduceat(v, starts, axis=0), "a", "v")

    def add(batches):
        here: dict[int, np.ndarray] = {}
        for b in batches:
            rows = np.array(b.column("v").flatten()).reshape(-1, width)
            for a, v in zip(b.column("a").to_pylist(), rows):
                here[a] = here[a] + v if a in here else v
        if here:
            yield vector_batch(pa.array(list(here)), np.array(list(here.values())), "a", "v")

    schema = "a long, v array<double>"
    got = matrix.mapInArrow(run, schema).repartition("a").mapInArrow(add, schema).toArrow()  # at most one row a word
    out = np.zeros(block.shape)
    if len(got):
        out[got["a"].to_numpy()] = np.array(got["v"].combine_chunks().flatten()).reshape(-1, width)
    shared.unpersist()
    return out


def factored(matrix: DataFrame, size: int, dim: int, seed: int = 42, rounds: int = ROUNDS) -> np.ndarray:
    """size x dim rows Q U sqrt(|lambda|) of the matrix's leading eigenpairs (by |lambda|), signs fixed."""
    width = min(size, dim + EXTRA)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))
    for _ in range(rounds):
        q, _ = np.linalg.qr(times_block(matrix, q))
    small = q.T @ times_block(matrix, q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-np.abs(values), kind="stable")[:dim]
    out = (q @ vectors[:, top]) * np.sqrt(np.abs(values[top]))
    sign = np.sign(out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])])
    return np.pad(out * np.where(sign == 0, 1, sign), ((0, 0), (0, dim - out.shape[1])))


def train(df: DataFrame, dim: int = 64, vocabulary: int = 4096, window: int = 5, text_col: str = "text", key: str = "note_id",
          cleaned: bool = False, seed: int = 42) -> WordVectors:
    """Word vectors of the notes' ``vocabulary`` most frequent words."""
    ship_package(df.sparkSession)
    tokens = _tokens(df, text_col, key, cleaned)
    counts = tokens.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts)
    top = counts.orderBy(F.desc("n"), "word").limit(vocabulary).toArrow()
    total = counts.agg(F.sum("n")).first()[0] or 1
    words = top["word"].to_pylist()
    if not words:
        return WordVectors([], np.zeros((0, dim)), np.zeros(0))
    matrix = materialize(ppmi(materialize(pair_counts(tokens, words, window, key))))
    return WordVectors(words, factored(matrix, len(words), dim, seed), top["n"].to_numpy() / total)


def note_vectors(df: DataFrame, model: WordVectors, text_col: str = "text", key: str = "note_id", cleaned: bool = False) -> DataFrame:
    """key, encoder, embedding (array<float>) of each note whose text isn't null."""
    ship_package(df.sparkSession)
    dim = model.vectors.shape[1]
    shared = df.sparkSession.sparkContext.broadcast(
        ({w: i for i, w in enumerate(model.words)}, model.vectors * (SMOOTH / (SMOOTH + model.share))[:, None]))

    def run(batches):
        place, weighted = shared.value
        for keys, seen, index, offsets in word_batches(batches, key):
            out = np.zeros((len(keys), dim))
            number = _known(seen, place)[index] if len(index) else index
            for r in range(len(keys)):
                mine = number[offsets[r]:offsets[r + 1]]
                mine = mine[mine >= 0]
                if len(mine):
                    out[r] = weighted[mine].mean(axis=0)
            size = np.linalg.norm(out, axis=1, keepdims=True)
            yield vector_batch(keys, (out / np.where(size > 0, size, 1)).astype(np.float32), key, "embedding")
    kind = df.schema[key].dataType.simpleString()
    out = _tokens(df, text_col, key, cleaned).mapInArrow(run, f"{key} {kind}, embedding array<float>")
    return out.select(key, F.lit("word_vectors").alias("encoder"), "embedding")


def nearest(model: WordVectors, word: str, n: int = 10) -> list[tuple[str, float]]:
    """The n words nearest to ``word`` by cosine."""
    unit = model.vectors / np.maximum(np.linalg.norm(model.vectors, axis=1, keepdims=True), 1e-12)
    score = unit @ unit[model.words.index(word)]
    order = [i for i in np.argsort(-score, kind="stable") if model.words[i] != word][:n]
    return [(model.words[i], float(score[i])) for i in order]
