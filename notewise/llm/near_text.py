"""MinHash near-dedup with HyperMinHash registers.

A text's set: its distinct runs of ``WORDS`` words (words are runs of
characters other than ASCII white space, A-Z lower-cased) as 64-bit digests;
a shorter text's whole word sequence is its one element. Texts with equal sets
(two 64-bit sums over the digests, and the size) form a class; only classes go
on, each as its smallest id.

A class's sketch has ``REGISTERS`` registers: a digest's top bits pick the
register, and the smallest of the other bits is kept there as its number of
leading zeros and its next ``MANTISSA`` bits, 16 bits in all. Registers that no
digest reached borrow one by fixed random choices of their own, so small sets
fill every register. ``BANDS`` bands of ``ROWS`` registers each give the candidate
groups: two large sets of Jaccard similarity 0.75 share no band with probability
(1 - 0.75^4)^32 = 5e-6, smaller ones somewhat more often, as elements meet in a
register (of 100,000 random pairs each, 2 of 12 and 9 elements, 1 of 20 and 15
and 0 of 100 and 75 shared none; the estimate below dropped no other).

In each group the similarity of the members is estimated from the share of
equal registers, corrected for equal registers of different elements; members
without a partner estimated at ``ESTIMATE`` or more (over five standard errors
below 0.75) leave. The others' full sets are compared as bit sets, exactly:
linked if 100 * intersection >= 75 * union. A group yields only a spanning
forest of its links; components follow from all forests.

Sets of up to ``FEW`` elements are not sketched but met exactly: sets A and B are
linked if and only if the size of C = A & B is at least 3/7 of |A| + |B|, so C
has all but a quarter of either's elements. Each set gives all such subsets of
itself (37 at most; sets of 9 and 10 give those that a set of ``FEW`` can hold).
Of the sets that give C, whichever link through C link with the smallest one,
so a star around it yields all their components.

Cases: null texts are empty; texts without words have an empty set and link
with nothing; texts may be of any length; repeated rows get the same answer;
a null id links with nothing and is kept; an empty table gives no rows; other
columns are not read (``drop_copies`` passes them through).
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.llm import groups, textbuf
from notewise.llm.staging import freed, id_and_text, staged

WORDS = 5
REGISTER_BITS = 7
REGISTERS = 1 << REGISTER_BITS
MANTISSA = 10
ROWS = 4
BANDS = REGISTERS // ROWS
ESTIMATE = 0.5
LEAST = 75  # per cent
FEW = 8
#: Size of the largest set that links with one of FEW.
FEW_PARTNER = FEW * 100 // LEAST
#: Chance that two different elements leave equal registers: a third of 2^-MANTISSA.
COLLISION = 1 / (3 * (1 << MANTISSA))
_U = np.uint64
#: Register that an empty register asks in its n-th try.
TRIES = (textbuf.mix(np.arange(REGISTERS * 64, dtype=_U) + _U(12345)) >> _U(64 - REGISTER_BITS)).astype(np.int64).reshape(64, REGISTERS)
#: Order in which a register (row) asks the full ones if all tries fail: the lowest first.
LAST_ORDER = textbuf.mix(np.arange(REGISTERS * REGISTERS, dtype=_U) + _U(1 << 32)).reshape(REGISTERS, REGISTERS)


def shingle_sets(col):
    """Sorted distinct shingle digests (uint64) of each row."""
    weight = textbuf.mix(np.arange(1, WORDS + 1, dtype=_U)) | _U(1)
    for _, data, off in textbuf.slices(col):
        units, starts, ends, first = textbuf.ascii_words(data, off)
        h = textbuf.span_hashes(units, starts, ends)
        n = len(h)
        total = np.zeros(max(n - WORDS + 1, 0), dtype=_U)
        for k in range(WORDS):
            total += h[k:n - WORDS + 1 + k] * weight[k] if n >= WORDS else total
        total = textbuf.mix(total)
        for r in range(len(off) - 1):
            a, b = first[r], first[r + 1]
            if b - a >= WORDS:
                yield np.unique(total[a:b - WORDS + 1])
            elif b > a:
                few = h[a:b]
                yield textbuf.mix(np.array([(few * weight[:len(few)]).sum(dtype=_U) + _U(len(few))], dtype=_U))
            else:
                yield few_none()


def few_none() -> np.ndarray:
    return np.zeros(0, dtype=_U)


def sketch(elements: np.ndarray) -> np.ndarray:
    """Registers (uint16) of a sorted, non-empty set of digests."""
    edge = np.arange(REGISTERS, dtype=_U) << _U(64 - REGISTER_BITS)
    at = np.searchsorted(elements, edge)
    full = at < np.append(at[1:], len(elements))
    rest = elements[np.minimum(at, len(elements) - 1)] << _U(REGISTER_BITS)
    # leading zeros from the exponent of the (exactly rounded down) high bits
    high = (rest >> _U(11)).astype(np.float64)
    zeros = np.where(high > 0, 53 - np.frexp(high)[1], 53).astype(_U)
    mantissa = (rest << (zeros + _U(1))) >> _U(64 - MANTISSA)
    reg = ((zeros << _U(MANTISSA)) | mantissa).astype(np.uint16)
    if not full.all():
        source = np.arange(REGISTERS)
        empty = np.flatnonzero(~full)
        for tries in TRIES:
            hit = full[tries[empty]]
            source[empty[hit]] = tries[empty[hit]]
            empty = empty[~hit]
            if not len(empty):
                break
        if len(empty):  # after 64 tries: each by an order of its own among all that are full
            there = np.flatnonzero(full)
            source[empty] = there[LAST_ORDER[np.ix_(empty, there)].argmin(axis=1)]
        reg = reg[source]
    return reg


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, of (n, REGISTERS) registers."""
    r = registers.reshape(len(registers), BANDS, ROWS).astype(_U)
    key = np.zeros((len(registers), BANDS), dtype=_U)
    for k in range(ROWS):
        key = (key << _U(16)) | r[:, :, k]
    return key


def estimates(registers: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of all pairs of a block."""
    n = len(registers)
    out = np.empty((n, n), dtype=np.float32)
    for i in range(n):
        out[i] = (registers == registers[i]).mean(axis=1)
    return np.clip((out - COLLISION) / (1 - COLLISION), 0, 1)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of the intersections of all pairs of sets, by bit sets over the
    elements that two sets or more share; 65,536 elements at a time."""
    n = len(sets)
    out = np.zeros((n, n), dtype=np.int32)
    element, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = np.flatnonzero(count > 1)
    place = np.full(len(element), -1, dtype=np.int64)
    place[shared] = np.arange(len(shared))
    at = place[code]
    owner, at = owner[at >= 0], at[at >= 0]
    width = 1 << 16
    for low in range(0, len(shared), width):
        pick = (at >= low) & (at < low + width)
        columns = min(width, len(shared) - low)
        bits = np.zeros((n, (columns + 63) // 64 * 64), dtype=bool)
        bits[owner[pick], at[pick] - low] = True
        words = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        for i in range(n):
            out[i] += np.bitwise_count(words & words[i]).sum(axis=1, dtype=np.int32)
    return out


def _marks(elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each digest, whose sums stand for a set."""
    return textbuf.mix(elements ^ _U(0x5DEECE66D)), textbuf.mix(elements + _U(0x2545F4914F6CDD1D))


@lru_cache(maxsize=None)
def subset_masks(n: int) -> np.ndarray:
    """(subsets, n) of 0 and 1: the subsets of a set of n that can be what it shares with a
    linked set, where one of the two has up to FEW elements."""
    sizes = range(-(-LEAST * n // 100), min(n, FEW) + 1)
    picks = [c for k in sizes for c in combinations(range(n), k)]
    out = np.zeros((len(picks), n), dtype=_U)
    for row, c in zip(out, picks):
        row[list(c)] = 1
    return out


def _subsets(classes: DataFrame) -> DataFrame:
    """(shared, k1, k2, n, id): every subset that a class of few elements may share with a linked one."""

    def run(batches):
        for b in batches:
            size, ids = b.column(1).to_numpy(), b.column(0).to_numpy()
            raw = b.column(2).to_pylist()
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                sets = np.frombuffer(b"".join(raw[i] for i in at), dtype=_U).reshape(-1, n)
                masks = subset_masks(n)
                a, c = ((m @ masks.T).ravel().view(np.int64) for m in _marks(sets))
                shared = masks.sum(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(shared, len(at))), pa.array(a), pa.array(c), pa.array(np.full(len(a), n, dtype=np.int32)),
                     pa.array(np.repeat(ids[at], len(masks)))], names=["shared", "k1", "k2", "n", "id"])

    few = classes.where("few is not null").select("id", "n", "few")
    return few.mapInArrow(freed(run), "shared int, k1 long, k2 long, n int, id long")


def few_links(classes: DataFrame) -> DataFrame:
    """(a, b): for every subset, links of the smallest class that gives it with the others that do."""
    given = _subsets(classes)
    key = ["shared", "k1", "k2"]
    hubs = (given.groupBy(*key).agg(F.min(F.struct("n", "id")).alias("hub"), F.count(F.lit(1)).alias("members"))
            .where("members > 1").drop("members"))
    linked = (100 + LEAST) * F.col("shared") >= LEAST * (F.col("n") + F.col("hub.n"))
    return (given.join(hubs, key).where(linked & (F.col("id") != F.col("hub.id")))
            .select(F.col("hub.id").alias("a"), F.col("id").alias("b")))


def signatures(rows: DataFrame) -> DataFrame:
    """(doc_id, n, d1, d2, registers, few) of rows of (doc_id, text); registers of sets of
    over FEW elements, few: the digests of sets of up to FEW_PARTNER."""

    def run(batches):
        for b in batches:
            n, d1, d2, regs, few = [], [], [], [], []
            for s in shingle_sets(b.column(1)):
                n.append(len(s))
                a, c = _marks(s)
                d1.append(int(a.sum(dtype=_U).astype(np.int64)))
                d2.append(int(c.sum(dtype=_U).astype(np.int64)))
                regs.append(sketch(s).tobytes() if len(s) > FEW else None)
                few.append(s.tobytes() if 0 < len(s) <= FEW_PARTNER else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.array(regs, pa.binary()), pa.array(few, pa.binary())], names=["doc_id", "n", "d1", "d2", "registers", "few"])

    return rows.mapInArrow(freed(run), "doc_id long, n long, d1 long, d2 long, registers binary, few binary")


def _bands(classes: DataFrame) -> DataFrame:
    """(band, key, id) of every class and band."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                reg = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(reg))),
                     pa.array(band_keys(reg).ravel().view(np.int64)),
                     pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["band", "key", "id"])

    return classes.select("id", "registers").mapInArrow(freed(run), "band int, key long, id long")


def _likely(met: DataFrame) -> DataFrame:
    """(bucket, lo, hi, side, id) of the members with a partner whose estimate is ESTIMATE or more."""
    names = ["bucket", "lo", "hi", "side", "id"]

    def run(batches):
        for t in groups.runs(batches):
            reg = np.frombuffer(b"".join(t["registers"].to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
            near = (estimates(reg) >= ESTIMATE) & groups.pairs_to_try(t)
            keep = near.any(axis=0) | near.any(axis=1)
            if keep.any():
                yield from t.select(names).filter(pa.array(keep)).to_batches()

    return met.mapInArrow(freed(run), "bucket long, lo int, hi int, side int, id long")


def _links(met: DataFrame) -> DataFrame:
    """(a, b) of a spanning forest of the links of each group; rows carry the whole sets."""

    def run(batches):
        for t in groups.runs(batches):
            sets = [np.frombuffer(x, dtype=_U) for x in t["elements"].to_pylist()]
            size = np.array([len(s) for s in sets], dtype=np.int64)
            both = intersections(sets).astype(np.int64)
            linked = (100 * both >= LEAST * (size[:, None] + size[None, :] - both)) & groups.pairs_to_try(t)
            a, b = np.nonzero(linked)
            tree = groups.forest(len(sets), a, b)
            if tree:
                ids = t["id"].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[[x for x, _ in tree]]), pa.array(ids[[y for _, y in tree]])],
                                                 names=["a", "b"])

    return met.mapInArrow(freed(run), "a long, b long")


def _elements(rows: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingle_sets(b.column(1))], pa.binary())],
                                             names=["id", "elements"])

    return rows.mapInArrow(freed(run), "id long, elements binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    rows = id_and_text(docs, id_col, text_col)
    signed = staged(signatures(rows), "near-signatures")
    classes = staged(signed.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2")
                     .agg(F.min("doc_id").alias("id"), F.first("registers").alias("registers"),
                          F.first("few").alias("few")), "near-classes")
    bands = _bands(classes.where(F.col("n") > FEW))
    kept = groups.distinct_groups(bands, ["band", "key"])
    members = bands.join(kept, ["band", "key"]).select("bucket", "n", "id")
    members = groups.in_blocks(members.join(classes.select("id", "registers"), "id"))
    likely = staged(_likely(groups.meet(members.select("bucket", "lo", "hi", "side", "id", "registers"))), "near-likely")
    ids = staged(likely.select("id").distinct(), "near-ids")
    elements = _elements(groups.only(rows, ids, "doc_id").dropDuplicates(["doc_id"]))
    met = groups.meet(likely.join(elements, "id").select("bucket", "lo", "hi", "side", "id", "elements"))
    links = groups.components(_links(met).unionByName(few_links(classes)), "near-components")
    of_class = classes.join(links, "id", "left").select(
        "n", "d1", "d2", F.coalesce("component", "id").alias("component_id"))
    out = signed.join(of_class, ["n", "d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component (that of the smallest id)."""
    found = near_duplicates(docs, id_col, text_col)
    gone = staged(found.where(~F.col("kept")).select("doc_id").distinct(), "near-gone")
    return groups.without(docs, gone, id_col)
