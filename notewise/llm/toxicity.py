"""Toxicity: character n-gram linear classifier over naive-Bayes-scaled features.

Features are the character n-grams (``SIZES`` code points, case folded) that a
text contains, hashed into ``BUCKETS`` buckets. Each bucket's value is its
log-count ratio r = log((p + 1) / (n1 + 2)) - log((q + 1) / (n0 + 2)), from the
numbers p and q of labelled texts of either class that contain it. The values
of a text are scaled to unit length and a logistic regression is fitted on
them. Buckets whose two rates differ by less than ``min_z`` standard errors
carry no evidence and are left out; all others (at most ``BUCKETS``) are kept.

It is fitted on a sample of at most ``max_rows`` labelled rows, half of each
class (those with the smallest hash of the id), weighted back to the classes'
shares. Only the text is an input of a score.

Cases: null and empty texts, and texts without a known n-gram, get the score
of the intercept; texts may be of any length; a document with labels of both
kinds counts as toxic; rows without an id are scored but teach nothing; with
no row of one of the classes (an empty table, say) every score is the smoothed
share of toxic rows, or 0 without any; repeated rows are scored one by one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewise.llm import textbuf
from notewise.llm.staging import free_name, freed, id_and_text, staged

SIZES = (4, 6, 7)
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """Lower-case code point of each code point of the basic plane."""
    table = np.arange(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


def grams(data: np.ndarray, off: np.ndarray):
    """(row, bucket) of every n-gram of every row of a slice; repeats included."""
    cp, at = textbuf.code_points(data, off)
    low = np.where(cp < 0x10000, folded()[np.minimum(cp, 0xFFFF)], cp).astype(np.uint64) + np.uint64(1)
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    h = low
    for n in range(2, max(SIZES) + 1):
        if len(low) < n:
            return
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + low[n - 1:]
        if n in SIZES:
            inside = row[:len(h)] == row[n - 1:]
            g = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield row[:len(h)][inside], (g >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)[inside]


@dataclass
class Model:
    buckets: np.ndarray  # of the features, sorted
    ratio: np.ndarray  # their log-count ratios
    weight: np.ndarray  # of the scaled values
    intercept: float

    def place(self) -> np.ndarray:
        """Feature number of each bucket, or -1."""
        table = np.full(BUCKETS, -1, dtype=np.int32)
        table[self.buckets] = np.arange(len(self.buckets), dtype=np.int32)
        return table

    def scores(self, col, table: np.ndarray) -> np.ndarray:
        out = []
        square, product = self.ratio ** 2, self.ratio * self.weight
        for _, data, off in textbuf.slices(col):
            n = len(off) - 1
            row, feature = distinct(data, off, table)
            norm = np.sqrt(np.bincount(row, square[feature], n))
            z = self.intercept + np.bincount(row, product[feature], n) / np.where(norm > 0, norm, 1.0)
            out.append(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))
        return np.concatenate(out) if out else np.zeros(0)


def distinct(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs of a slice, each once."""
    pairs = [np.zeros(0, np.int64)]
    width = np.int64(BUCKETS)
    for row, bucket in grams(data, off):
        f = table[bucket]
        hit = f >= 0
        pairs.append(row[hit].astype(np.int64) * width + f[hit])
    u = np.unique(np.concatenate(pairs))
    return (u // width).astype(np.int64), (u % width).astype(np.int64)


def held_out(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``, is 0; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, folds: int) -> tuple[DataFrame, dict]:
    """(text, y) of the sample, and the number of labelled rows of each class.

    ``labels``: doc_id, y. The sample's ids are bounded by ``max_rows``, so they are broadcast."""
    known = (labels.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds))
             .groupBy("doc_id").agg(F.max("y").cast("int").alias("y")))
    sizes = {int(r.y): r["count"] for r in known.groupBy("y").count().collect()}
    order = F.xxhash64("doc_id")
    picked = [known.where(F.col("y") == c).orderBy(order, "doc_id").limit(max_rows // 2) for c in (0, 1)]
    ids = staged(picked[0].unionByName(picked[1]).coalesce(1), "toxic-sample")
    return docs.join(F.broadcast(ids), "doc_id").select("text", "y"), sizes


def class_counts(sample: DataFrame) -> DataFrame:
    """(bucket, p, q): labelled texts of class 1 and 0 that contain the bucket."""
    identity = np.arange(BUCKETS, dtype=np.int32)

    def run(batches):
        seen = np.zeros((2, BUCKETS), dtype=np.int64)
        for b in batches:
            y = b.column(1).to_numpy()
            for first, data, off in textbuf.slices(b.column(0)):
                row, bucket = distinct(data, off, identity)
                of_class = y[first:first + len(off) - 1][row]
                for c in (0, 1):
                    seen[c] += np.bincount(bucket[of_class == c], minlength=BUCKETS)
        bucket = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(seen[1][bucket]),
                                          pa.array(seen[0][bucket])], names=["bucket", "p", "q"])

    return (sample.mapInArrow(freed(run), "bucket int, p long, q long").groupBy("bucket")
            .agg(F.sum("p").alias("p"), F.sum("q").alias("q")))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, min_z: float = 3.0,
        folds: int = 5, l2: float = 1e-5, rounds: int = 100) -> Model:
    """Fit on (doc_id, text) and (doc_id, y); see the module's text."""
    sample, sizes = labelled_sample(docs, labels, max_rows, folds)
    none = np.zeros(0)
    if not sizes.get(0) or not sizes.get(1):
        n = sum(sizes.values())
        share = (sizes.get(1, 0) + 1) / (n + 2)
        return Model(none.astype(np.int64), none, none, float(np.log(share / (1 - share))) if n else -np.inf)
    sample = staged(sample, "toxic-texts")
    size = {int(r.y): r["count"] for r in sample.groupBy("y").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    rate1, rate0 = (F.col("p") + 1) / F.lit(n1 + 2.0), (F.col("q") + 1) / F.lit(n0 + 2.0)
    error = F.sqrt(rate1 * (1 - rate1) / F.lit(n1 + 2.0) + rate0 * (1 - rate0) / F.lit(n0 + 2.0))
    z = F.abs(rate1 - rate0) / error
    best = (class_counts(sample).select("bucket", F.log(rate1 / rate0).alias("ratio"), z.alias("z"))
            .where(F.col("z") >= min_z).toArrow())
    order = np.argsort(best.column(0).to_numpy())
    model = Model(best.column(0).to_numpy()[order].astype(np.int64), best.column(1).to_numpy()[order],
                  np.zeros(len(order)), 0.0)
    if not len(order):  # no evidence: the share of the class
        return Model(model.buckets, model.ratio, model.weight, float(np.log((sizes[1] + 1) / (sizes[0] + 1))))
    return _regression(model, sample, {1: sizes[1] / max(n1, 1), 0: sizes[0] / max(n0, 1)}, l2, rounds)


def _regression(model: Model, sample: DataFrame, weight: dict, l2: float, rounds: int) -> Model:
    """Weighted logistic regression on the sample's scaled values: L-BFGS, gradients summed in tasks."""
    buckets, ratio = model.buckets, model.ratio
    vector = T.StructField("x", VectorUDT.sqlType())

    def run(batches):
        table = Model(buckets, None, None, 0.0).place()
        for b in batches:
            lists, values = [], []
            for _, data, off in textbuf.slices(b.column(0)):
                n = len(off) - 1
                row, feature = distinct(data, off, table)
                norm = np.sqrt(np.bincount(row, ratio[feature] ** 2, n))
                value = ratio[feature] / norm[row]
                ends = np.searchsorted(row, np.arange(n + 1))
                lists += [feature[ends[i]:ends[i + 1]].astype(np.int32) for i in range(n)]
                values += [value[ends[i]:ends[i + 1]] for i in range(n)]
            kind = pa.list_(pa.int32()), pa.list_(pa.float64())
            n = len(lists)
            x = pa.StructArray.from_arrays(
                [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, len(buckets), np.int32)), pa.array(lists, kind[0]),
                 pa.array(values, kind[1])], names=["type", "size", "indices", "values"])
            y = b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(y.astype(float)), pa.array(np.where(y == 1, weight[1], weight[0])), x],
                                             names=["y", "w", "x"])

    plain = T.StructType([T.StructField("y", T.DoubleType()), T.StructField("w", T.DoubleType()), vector])
    written = staged(sample.mapInArrow(freed(run), plain), "toxic-values")
    as_vectors = T.StructType([*plain.fields[:2], T.StructField("x", VectorUDT())])  # the same columns, read as vectors
    rows = sample.sparkSession.read.schema(as_vectors).parquet(*written.inputFiles())
    fitted = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=l2, maxIter=rounds, standardization=False).fit(rows)
    return Model(buckets, ratio, fitted.coefficients.toArray(), float(fitted.intercept))


def score(df: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``df`` with a score column added (under ``name``, underscored if taken)."""
    name = free_name(df.columns, name)
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches):
        table = None
        for b in batches:
            table = shared.value.place() if table is None else table
            got = shared.value.scores(b.column(at), table)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*b.schema.names, name])

    return df.mapInArrow(freed(run), T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", folds: int = 5, max_rows: int = 16_000) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; the labels of held-out ids are never learnt."""
    rows = id_and_text(docs, id_col, text_col)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    scored = score(rows, fit(rows, known, max_rows, folds=folds))
    return scored.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     label_col: str = "toxic", folds: int = 5, max_rows: int = 16_000) -> DataFrame:
    """The rows of ``docs`` with a score below 0.5, with their own columns."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    name = free_name(docs.columns, "score")
    scored = score(docs, fit(id_and_text(docs, id_col, text_col), known, max_rows, folds=folds), text_col, name)
    return scored.where(F.col(name) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
