"""Feature operators.

Vectors are ``array<float>`` columns keyed by note id, so embeddings meet
labels through a join on the key, never by row position.

Encoders turn cleaned text into one fixed-length vector per note:

* ``hashed_tfidf``: words hashed (MD5) into buckets, counted row by row once, IDF from
  one aggregate over the written counts, L2-normalised.
* ``hashed_vectors``: mean of per-word hashed sign vectors, row by row; no vocabulary.
* :mod:`notewise.operators.word_vectors`: word vectors trained on the notes themselves.
* :class:`ExternalEncoder`: any batch encoder (e.g. a transformer checkpoint)
  run by ``mapInPandas`` over Arrow batches; the model is built once per
  Python worker on first use, never per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewise.functions.numeric import safe_div
from notewise.functions.text import clean_text, tokenize, truncate_tokens
from notewise.session import materialize, ship_package


def class_weight_column(df: DataFrame, y: str = "y", out_col: str = "weight",
                        pos_weight: Column | float | None = None) -> DataFrame:
    """``weight = negatives / positives`` for positive rows, 1 otherwise.
    The ratio is computed over ``df`` (pass the training split) as a scalar
    subquery unless given."""
    if pos_weight is None:
        pos_weight = df.agg(safe_div(F.sum(1 - F.col(y)), F.sum(F.col(y)))).scalar()
    pw = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    return df.withColumn(out_col, F.when(F.col(y) == 1, pw).otherwise(F.lit(1.0)).cast("double"))


def align_embeddings(vectors: DataFrame, labels: DataFrame, key: str = "note_id") -> DataFrame:
    """Pair each vector with its label row by key (inner join)."""
    return vectors.join(labels, key, "inner")


def fuse_features(df: DataFrame, vec_col: str = "embedding",
                  extra_cols: Sequence[str] = ("age", "gender"), out_col: str = "features") -> DataFrame:
    """Append structured columns to the vector when *all* are present;
    otherwise the vector alone (checked on the schema, no job). A string
    column is encoded by :data:`CATEGORIES`, unknown and null as -1; a null
    number is 0."""
    v = F.col(vec_col).cast("array<double>")
    if extra_cols and all(c in df.columns for c in extra_cols):
        v = F.concat(v, F.array(*[_numeric(df, c) for c in extra_cols]))
    return df.withColumn(out_col, v)


#: Codes of a structured column's category names (lower case).
CATEGORIES = {"f": 0.0, "female": 0.0, "m": 1.0, "male": 1.0}


def _numeric(df: DataFrame, name: str) -> Column:
    if df.schema[name].dataType.simpleString() != "string":
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    code = F.try_to_number(F.col(name), F.lit("999999999.99")).cast("double")
    for word, value in CATEGORIES.items():
        code = F.when(F.lower(F.trim(F.col(name))) == word, value).otherwise(code)
    return F.coalesce(code, F.lit(-1.0))


def tokens_of(df: DataFrame, text_col: str = "text", cleaned: bool = False,
              max_tokens: int | None = None) -> DataFrame:
    txt = F.col(text_col) if cleaned else clean_text(text_col)
    return df.withColumn("tokens", truncate_tokens(tokenize(txt, cleaned=True), max_tokens))


#: Notes whose words are held at once in a kernel.
_NOTES = 256


def word_batches(batches, key: str) -> Iterator[tuple]:
    """(keys, distinct words, index of each word, offsets of the notes) of rows (key, tokens), some notes at a time."""
    for b in batches:
        for i in range(0, len(b), _NOTES):
            part = b.slice(i, _NOTES)
            tokens = part.column("tokens")
            words = tokens.flatten().dictionary_encode()
            sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            yield part.column(key), words.dictionary.to_pylist(), words.indices.to_numpy(), np.concatenate([[0], np.cumsum(sizes)])


def vector_batch(keys, vectors: np.ndarray, key: str, out_col: str) -> pa.RecordBatch:
    """Rows (key, vector) with the vectors' own type of number."""
    n, width = vectors.shape
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(vectors.ravel()))
    return pa.RecordBatch.from_arrays([keys, lists], names=[key, out_col])


def _digest(seed, word: str) -> str:
    """The MD5 that :func:`notewise.functions.numeric.hash_unit` takes its digits from."""
    return hashlib.md5(f"{seed}:{word}".encode()).hexdigest()


def bucket_counts(df: DataFrame, dim: int, text_col: str = "text", key: str = "note_id", cleaned: bool = False,
                  max_tokens: int | None = None, seed: int = 42) -> DataFrame:
    """key, counts: how many of a note's words fall into each of ``dim`` buckets (hash_unit(seed, word) % dim)."""
    ship_package(df.sparkSession)
    t = tokens_of(df.where(F.col(text_col).isNotNull()).select(key, text_col), text_col, cleaned, max_tokens)

    def run(batches):
        for keys, words, index, offsets in word_batches(batches, key):
            bucket = np.array([int(_digest(seed, w)[:8], 16) % dim for w in words], dtype=np.int64)
            row = np.repeat(np.arange(len(keys)), np.diff(offsets))
            at = row * dim + bucket[index] if len(index) else row
            counts = np.bincount(at, minlength=len(keys) * dim).reshape(len(keys), dim)
            yield vector_batch(keys, counts.astype(np.float32), key, "counts")
    return t.select(key, "tokens").mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, counts array<float>")


def hashed_tfidf(df: DataFrame, dim: int = 256, text_col: str = "text", key: str = "note_id",
                 cleaned: bool = False, max_tokens: int | None = None, seed: int = 42) -> DataFrame:
    """Hashed bag of words, weighted by ln((notes + 1) / (notes with the bucket + 1)), L2-normalised, as array<float>.

    Texts are cleaned and counted once; the counts are written and read twice. Null texts are dropped."""
    tf = materialize(bucket_counts(df, dim, text_col, key, cleaned, max_tokens, seed))
    seen = tf.agg(Summarizer.numNonZeros(array_to_vector(F.col("counts").cast("array<double>"))).alias("df"), F.count(F.lit(1)).alias("n"))
    idf = seen.select(F.transform(vector_to_array("df"), lambda d: F.log((F.col("n") + 1) / (d + 1))).alias("idf")).first()
    idf = np.array(idf["idf"] or [0.0] * dim, dtype=np.float64)  # one number a bucket

    def run(batches):
        for b in batches:
            v = np.asarray(b.column("counts").flatten(), dtype=np.float64).reshape(len(b), dim) * idf
            size = np.sqrt((v * v).sum(axis=1, keepdims=True))
            yield vector_batch(b.column(key), (v / np.where(size > 0, size, 1)).astype(np.float32), key, "embedding")
    out = tf.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, embedding array<float>")
    return out.select(key, F.lit("hashed_tfidf").alias("encoder"), "embedding")


def word_signs(words: Sequence[str], dim: int, seed: int) -> np.ndarray:
    """One row of +1 and -1 a word: the bits of its MD5 digits (128 a seed, seeds counted up)."""
    parts = []
    for k, a in enumerate(range(0, dim, 128)):
        digests = np.frombuffer(b"".join(bytes.fromhex(_digest(seed + k, w)) for w in words), dtype=np.uint8).reshape(len(words), 16)
        parts.append(np.unpackbits(digests, axis=1)[:, :min(128, dim - a)])
    return np.concatenate(parts, axis=1).astype(np.int8) * 2 - 1


def hashed_vectors(df: DataFrame, dim: int = 64, text_col: str = "text", key: str = "note_id",
                   cleaned: bool = False, seed: int = 42) -> DataFrame:
    """Mean of the note's word vectors, where a word's vector is ``dim`` signs drawn from
    its hash, scaled to unit length: a dense encoder of every word without a vocabulary or a
    shuffle. Null texts are dropped; a note without words is 0."""
    ship_package(df.sparkSession)
    t = tokens_of(df.where(F.col(text_col).isNotNull()).select(key, text_col), text_col, cleaned)

    def run(batches):
        for keys, words, index, offsets in word_batches(batches, key):
            out = np.zeros((len(keys), dim))
            signs = word_signs(words, dim, seed) if words else np.zeros((0, dim), np.int8)
            for r in np.flatnonzero(np.diff(offsets)):
                used, times = np.unique(index[offsets[r]:offsets[r + 1]], return_counts=True)
                out[r] = times @ signs[used].astype(np.int64) / times.sum() / np.sqrt(dim)
            yield vector_batch(keys, out.astype(np.float32), key, "embedding")
    out = t.select(key, "tokens").mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, embedding array<float>")
    return out.select(key, F.lit("hashed_vectors").alias("encoder"), "embedding")


_WORKER_MODELS: dict = {}


class ExternalEncoder:
    """Batch encoder hook for ``mapInPandas``.

    ``factory()`` returns a callable ``encode(list[str]) -> np.ndarray[n, dim]``;
    it runs once per Python worker (cached by ``name``). ``batch_size`` rows
    are encoded at a time inside each Arrow batch.
    """

    def __init__(self, name: str, factory: Callable[[], Callable], dim: int, batch_size: int = 32):
        self.name, self.factory, self.dim, self.batch_size = name, factory, dim, batch_size

    def apply(self, df: DataFrame, text_col: str = "clean_text", key: str = "note_id") -> DataFrame:
        name, factory, dim, bs = self.name, self.factory, self.dim, self.batch_size

        def run(batches):
            model = _WORKER_MODELS.get(name)
            if model is None:
                model = _WORKER_MODELS[name] = factory()
            for pdf in batches:
                texts = pdf[text_col].astype(str).tolist()
                parts = [np.asarray(model(texts[i:i + bs]), dtype=np.float32).reshape(-1, dim)
                         for i in range(0, len(texts), bs)]
                mat = np.concatenate(parts) if parts else np.zeros((0, dim), np.float32)
                yield pd.DataFrame({key: pdf[key].to_numpy(), "encoder": name,
                                    "embedding": list(mat)})
        schema = f"{key} long, encoder string, embedding array<float>"
        return df.where(F.col(text_col).isNotNull()).select(key, text_col).mapInPandas(run, schema)


def embed_all(df: DataFrame, encoders: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Run every encoder over the same notes; one long table keyed by
    (note_id, encoder)."""
    out = None
    for enc in encoders:
        part = enc(df)
        out = part if out is None else out.unionByName(part)
    return out
