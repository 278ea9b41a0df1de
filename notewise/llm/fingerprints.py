"""Document fingerprints: I-Match over randomised lexicons.

Terms are the words of a text (runs of characters other than ASCII white
space, A-Z lower-cased), as 64-bit digests. Document frequencies are counted
over all documents; the lexicon keeps the terms whose frequency lies between
``low`` and ``high`` of the documents (a band of inverse document frequency).
A fingerprint has one part per randomised subset of the lexicon: the hash of
the text's distinct terms in that subset, in sorted order. Subsets are drawn
at several rates, from the whole lexicon to one term in thousands, so that
short and long texts both have parts that outlive an edit.

The lexicon has at most mean distinct terms / ``low`` entries, as no more terms
can reach that frequency; ``low`` is raised until this bound is at most
``max_lexicon``, and only then is the lexicon broadcast.

A text with fewer than ``MIN_TERMS`` lexicon terms is fingerprinted by all its
terms. ``likeness`` of two fingerprints is the largest share, over the rates,
of equal parts among the parts in which either text has a term, with one more
part that differs (a rate with few parts says little); equal fingerprints have 1.

Cases: null and empty texts have no terms and one common fingerprint, whose
likeness to itself is 1 and to others 0; texts may be of any length; repeated
rows are fingerprinted one by one; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.llm import textbuf
from notewise.llm.staging import id_and_text, staged

#: (rate is one in this many terms, number of subsets)
RATES = ((1, 2), (4, 2), (16, 8), (64, 8), (256, 8), (1024, 8), (4096, 4))
DIGITS = 8  # hexadecimal digits of a part
MIN_TERMS = 4
_MERGE_AT = 2_000_000


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    n = sum(k for _, k in RATES)
    seed = textbuf.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    top = np.repeat(np.array([(1 << 64) // r - 1 for r, _ in RATES], dtype=np.uint64), [k for _, k in RATES])
    return seed[:, None], top[:, None]


SEED, TOP = _seeds()


def term_sets(col):
    """Sorted distinct term digests of each row."""
    for _, data, off in textbuf.slices(col):
        units, starts, ends, first = textbuf.ascii_words(data, off)
        h = textbuf.span_hashes(units, starts, ends)
        for r in range(len(off) - 1):
            yield np.unique(h[first[r]:first[r + 1]])


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df) over all rows of (doc_id, text), summed per task before the shuffle."""

    def run(batches):
        terms, counts, held = [], [], 0

        def merged():
            t, back = np.unique(np.concatenate(terms), return_inverse=True)
            return t, np.bincount(back, np.concatenate(counts), len(t)).astype(np.int64)

        for b in batches:
            for s in term_sets(b.column(0)):
                terms.append(s)
                counts.append(np.ones(len(s), dtype=np.int64))
                held += len(s)
                if held > _MERGE_AT:
                    t, n = merged()
                    terms, counts, held = [t], [n], 0
                    if len(t) > _MERGE_AT // 2:
                        yield _batch(t, n)
                        terms, counts = [], []
        if terms:
            yield _batch(*merged())

    def _batch(t, n):
        return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n)], names=["term", "df"])

    return (docs.select("text").mapInArrow(run, "term long, df long")
            .groupBy("term").agg(F.sum("df").alias("df")))


def lexicon(docs: DataFrame, low: float, high: float, max_lexicon: int) -> np.ndarray:
    """Sorted digests (uint64) of the terms in the band; at most ``max_lexicon``."""
    df = staged(document_frequencies(docs), "term-df")
    n, total = docs.count(), df.agg(F.sum("df")).first()[0] or 0
    least = max(2.0, low * n, total / max_lexicon)
    band = df.where((F.col("df") >= least) & (F.col("df") <= max(high * n, least)))
    return np.sort(band.select("term").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


class Fingerprinter:
    """Fingerprints of term sets against a lexicon."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.coarse = np.zeros(1 << 22, dtype=bool)
        self.coarse[terms >> np.uint64(42)] = True

    def of(self, terms: np.ndarray) -> str:
        near = terms[self.coarse[terms >> np.uint64(42)]]
        if len(near):
            at = np.minimum(np.searchsorted(self.terms, near), len(self.terms) - 1)
            near = near[self.terms[at] == near]
        kept = near if len(near) >= MIN_TERMS else terms
        if not len(kept):
            return "-" * (DIGITS * len(SEED))
        parts = np.zeros(len(SEED), dtype=np.uint64)
        n = np.zeros(len(SEED), dtype=np.int64)
        for a in range(0, len(kept), 4096):  # bounded: a block of terms at a time
            u = textbuf.mix(kept[None, a:a + 4096] ^ SEED)
            member = u <= TOP
            parts += np.where(member, textbuf.mix(u), np.uint64(0)).sum(axis=1, dtype=np.uint64)
            n += member.sum(axis=1)
        return "".join(f"{int(p) >> (64 - 4 * DIGITS):0{DIGITS}x}" if k else "-" * DIGITS for p, k in zip(parts, n))


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints only."""
    if a == b:
        return 1.0
    best, none, at = 0.0, "-" * DIGITS, 0
    for _, k in RATES:
        used = same = 0
        for i in range(at, at + k):
            x, y = a[i * DIGITS:(i + 1) * DIGITS], b[i * DIGITS:(i + 1) * DIGITS]
            if x != none or y != none:
                used += 1
                same += x == y
        at += k
        best = max(best, same / (used + 1))
    return best


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = 2e-4,
                high: float = 0.05, max_lexicon: int = 4_000_000) -> DataFrame:
    """doc_id, fingerprint of each row."""
    rows = id_and_text(docs, id_col, text_col)
    shared = rows.sparkSession.sparkContext.broadcast(lexicon(rows, low, high, max_lexicon))

    def run(batches):
        maker = Fingerprinter(shared.value)
        for b in batches:
            out = [maker.of(t) for t in term_sets(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(run, "doc_id long, fingerprint string")


# ---- neighbours in descending order of ids, and what an edit does to a fingerprint

_LOWEST = -(1 << 63)


def with_next(docs: DataFrame, rows_per_bucket: int = 100_000) -> DataFrame:
    """Rows of (doc_id, text) dealt to id ranges and sorted, for a pass that sees each
    row's next one in descending order: (bucket, doc_id, text, extra), sorted by
    bucket, extra, doc_id descending, text. Each range ends with a copy (extra) of
    the first row of the next range; the lowest with a copy of the very first row.

    The texts are shuffled once. The driver holds one id per range."""
    spark = docs.sparkSession
    ids = docs.select(F.coalesce("doc_id", F.lit(_LOWEST)).alias("k"))
    n = ids.count()
    want = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // rows_per_bucket)
    cuts = [i / want for i in range(1, want)]
    edges = ids.agg(F.percentile_approx("k", cuts, max(10_000, 10 * want))).first()[0] if n else []
    edges = np.unique(np.array(edges or [], dtype=np.int64))

    def bucket_of(batches):
        for b in batches:
            k = np.searchsorted(edges, b.column(0).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), b.column(0)], names=["bucket", "k"])

    tops = (ids.mapInArrow(bucket_of, "bucket long, k long").groupBy("bucket").agg(F.max("k").alias("k"))
            .orderBy("bucket").collect())
    above = {r.k: tops[(i + 1) % len(tops)].bucket for i, r in enumerate(tops)}
    first = np.array(sorted(above), dtype=np.int64)
    goes_to = np.array([above[k] for k in first.tolist()], dtype=np.int64)

    def route(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            k = t.column(0).fill_null(_LOWEST).to_numpy()
            home = np.searchsorted(edges, k, side="right").astype(np.int64)
            at = np.minimum(np.searchsorted(first, k), len(first) - 1)
            twice = np.flatnonzero(first[at] == k)
            for rows, bucket, extra in ((t, home, 0), (t.take(pa.array(twice)), goes_to[at[twice]], 1)):
                for piece in rows.append_column("bucket", pa.array(bucket)).append_column(
                        "extra", pa.array(np.full(len(bucket), extra, dtype=np.int32))).to_batches():
                    yield piece.select(["bucket", "doc_id", "text", "extra"])

    routed = docs.mapInArrow(route, "bucket long, doc_id long, text string, extra int")
    return routed.repartition("bucket").sortWithinPartitions("bucket", "extra", F.desc_nulls_last("doc_id"), "text")


EDIT_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
               "near_edited double, near_next double")


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = 2e-4,
                high: float = 0.05, max_lexicon: int = 4_000_000, chunk: int = 500) -> DataFrame:
    """Each row's fingerprint beside that of an edited text: the last floor(n / 2) code
    points replaced by as many from the start of the next document (descending ids;
    equal ids by text; a null id is the lowest; after the last comes the first)."""
    rows = id_and_text(docs, id_col, text_col)
    shared = rows.sparkSession.sparkContext.broadcast(lexicon(rows, low, high, max_lexicon))
    names = [p.split()[0] for p in EDIT_SCHEMA.split(", ")]

    def run(batches):
        maker = Fingerprinter(shared.value)

        def prints(texts):
            return [maker.of(t) for t in term_sets(pa.array(texts, pa.large_string()))]

        def report(held):
            """``held``: (bucket, doc_id, text, extra) in order; all but the last of its bucket get a row."""
            own = prints([h[2] for h in held])
            pairs = [i for i in range(len(held) - 1) if held[i][0] == held[i + 1][0] and not held[i][3]]
            edited = []
            for i in pairs:
                text, nxt = held[i][2], held[i + 1][2]
                half = len(text) // 2
                edited.append(text[:len(text) - half] + nxt[:half])
            new = prints(edited)
            out = [(held[i][1], len(held[i][2]), hashlib.sha256(e.encode()).hexdigest(), own[i], f,
                    likeness(own[i], f), likeness(own[i], own[i + 1])) for i, e, f in zip(pairs, edited, new)]
            cols = list(zip(*out)) if out else [[]] * len(names)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        held = []
        for b in batches:
            for a in range(0, b.num_rows, chunk):
                held += zip(*(c.to_pylist() for c in b.slice(a, chunk).columns))
                yield report(held)
                held = held[-1:]

    return with_next(rows).mapInArrow(run, EDIT_SCHEMA)
