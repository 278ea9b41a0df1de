"""Quality: interpolated modified Kneser-Ney language model trained on trusted text.

Symbols are numbers of ``SYMBOL_BITS`` bits: the ``RARE`` code points that are
commonest in the trusted rows (of equal ones the lower) have one each, all other
code points share the symbol ``RARE``. An n-gram is one integer, so its context is
a shift and its suffix a mask. Counts of the highest order come
from all trusted rows (summed per task, then by n-gram); the counts of a lower
order are the numbers of distinct n-grams one longer that end in it. Each
order's three discounts come from its counts of counts. A table's counts are
joined with their contexts' totals and with the next lower order's
probabilities, all keyed and sharded by n-gram, to give

    p(w | c) = (count - D) / total(c) + gamma(c) * p(w | c without its first).

The result is a table of log probabilities by n-gram and of log gammas by
context, with the alphabet in rows of their own. It is cut into shards by the symbol before the predicted one, so that
an n-gram, its contexts and all it backs off to share a shard; a shard of at
most ``shard_rows`` rows is broadcast at a time and adds its part of each
document's log probability.

A document's perplexity is exp(-(sum + PRIOR * mean) / (symbols + PRIOR)), drawn
towards its language's mean where there is little text. Its threshold is the
``quantile`` of the log perplexities of its language's trusted rows; those rows
(one in ``folds``, by hash) are not trained on. Languages with fewer than
``least`` of them use the quantile of all languages.

Cases: null and empty texts have a null perplexity and are kept, since nothing
speaks against them; a null language is a language of its own; with no trusted
rows everything is kept; texts may be of any length; repeated rows are scored
one by one; extra columns pass through ``filter_documents`` untouched.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewise.llm import textbuf
from notewise.llm.staging import free_name, freed, staged

ORDER = 5
SYMBOL_BITS = 12
START = (1 << SYMBOL_BITS) - 1  # stands before a text's first symbol
RARE = START - 1
ALPHABET = ORDER + 1  # level of the model's rows (code point, symbol)
PRIOR = 100.0
_MASK = (1 << SYMBOL_BITS) - 1
MAX_BROADCAST_IDS = 4_000_000
_MERGE_AT = 4_000_000
_POINTS = 0x110000


def _points(data: np.ndarray, off: np.ndarray):
    cp, at = textbuf.code_points(data, off)
    return np.minimum(cp, _POINTS - 1), at


def alphabet(trusted: DataFrame, size: int = RARE) -> np.ndarray:
    """The ``size`` commonest code points of (text), sorted; the symbol of each is its place."""

    def run(batches):
        seen = np.zeros(_POINTS, dtype=np.int64)
        for b in batches:
            for _, data, off in textbuf.slices(b.column(0)):
                n = np.bincount(_points(data, off)[0])
                seen[:len(n)] += n
        cp = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(cp), pa.array(seen[cp])], names=["cp", "n"])

    counts = trusted.select("text").mapInArrow(freed(run), "cp long, n long").groupBy("cp").agg(F.sum("n").alias("n"))
    return np.sort(counts.orderBy(F.desc("n"), "cp").limit(size).toArrow().column(0).to_numpy())


def symbol_table(points: np.ndarray) -> np.ndarray:
    """Symbol of each code point under an alphabet."""
    table = np.full(_POINTS, RARE, dtype=np.uint16)
    table[points] = np.arange(len(points), dtype=np.uint16)
    return table


def symbols(data: np.ndarray, off: np.ndarray, table: np.ndarray):
    """n-gram (highest order) that ends at each code point, and the rows' offsets."""
    cp, at = _points(data, off)
    sym = table[cp].astype(np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = np.arange(len(cp)) - at[row]
    code = np.zeros(len(cp), dtype=np.int64)
    for k in range(ORDER - 1, -1, -1):  # k symbols back
        back = np.full(len(cp), START, dtype=np.int64)
        back[k:] = sym[:max(len(cp) - k, 0)]
        code = code << SYMBOL_BITS | np.where(place >= k, back, START)
    return code, at


def trained_counts(trusted: DataFrame, points: np.ndarray) -> DataFrame:
    """(g, n) of the highest order over (text); summed per task before the shuffle."""

    def run(batches):
        table = symbol_table(points)
        grams, counts, held = [], [], 0

        def merged():
            u, back = np.unique(np.concatenate(grams), return_inverse=True)
            return u, np.bincount(back, np.concatenate(counts), len(u)).astype(np.int64)

        for b in batches:
            for _, data, off in textbuf.slices(b.column(0)):
                u, n = np.unique(symbols(data, off, table)[0], return_counts=True)
                grams.append(u)
                counts.append(n)
                held += len(u)
                if held > _MERGE_AT:
                    u, n = merged()
                    grams, counts, held = [u], [n], len(u)
                    if held > _MERGE_AT // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], names=["g", "n"])
                        grams, counts, held = [], [], 0
        if grams:
            yield pa.RecordBatch.from_arrays([*map(pa.array, merged())], names=["g", "n"])

    return trusted.select("text").mapInArrow(freed(run), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney's D1, D2, D3+ from the numbers of n-grams that occur 1 to 4 times."""
    row = counts.agg(*[F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (float(x) for x in row)
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    ratio = lambda a, b: a / b if b else 0.5
    return [min(max(k - (k + 1) * y * ratio(up, at), 0.05 * k), 0.95 * k)
            for k, at, up in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def train(trusted: DataFrame, name: str = "lm", alphabet_size: int = RARE) -> DataFrame:
    """Rows (level, g, v): log probability of n-gram g of order ``level``, or, at level
    -k, log gamma of the context g of k symbols; level 0 holds log(1 / alphabet) scaled
    by the unigrams' gamma, for symbols never seen. Level ``ALPHABET`` holds the symbols
(v) of the alphabet's code points (g)."""
    points = alphabet(trusted, alphabet_size)
    counts = {ORDER: staged(trained_counts(trusted, points), f"{name}-counts")}
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("g").bitwiseAND((1 << SYMBOL_BITS * k) - 1)
        counts[k] = counts[k + 1].groupBy(suffix.alias("g")).agg(F.count(F.lit(1)).alias("n"))
    lower = None
    parts = [trusted.sparkSession.createDataFrame([(ALPHABET, p, float(i)) for i, p in enumerate(points.tolist())],
                                                  "level int, g long, v double")]
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(counts[k])
        context = F.shiftright("g", SYMBOL_BITS)
        less = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        rows = counts[k].withColumn("c", context).withColumn("less", less)
        totals = rows.groupBy("c").agg(F.sum("n").alias("total"), F.sum("less").alias("mass"))
        rows = rows.join(totals, "c").select(
            "g", "c", ((F.col("n") - F.col("less")) / F.col("total")).alias("u"), (F.col("mass") / F.col("total")).alias("gamma"))
        uniform = F.lit(1.0 / (1 << SYMBOL_BITS))
        if k == 1:
            probs = rows.select("g", (F.col("u") + F.col("gamma") * uniform).alias("p"))
            parts.append(totals.select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("g"),
                                       F.log(F.col("mass") / F.col("total") * uniform).alias("v")))
        else:
            suffix = F.col("g").bitwiseAND((1 << SYMBOL_BITS * (k - 1)) - 1)
            probs = (rows.withColumn("s", suffix).join(lower.select(F.col("g").alias("s"), F.col("p").alias("q")), "s")
                     .select("g", (F.col("u") + F.col("gamma") * F.col("q")).alias("p")))
            parts.append(totals.select(F.lit(1 - k).alias("level"), F.col("c").alias("g"),
                                       F.log(F.col("mass") / F.col("total")).alias("v")))
        lower = staged(probs, f"{name}-order{k}")
        parts.append(lower.select(F.lit(k).alias("level"), "g", F.log("p").alias("v")))
    return staged(reduce(DataFrame.unionByName, parts), name)


class Shard:
    """Sorted tables of one shard; ``logp`` backs off through them."""

    SLOTS_LOG2 = 20

    def __init__(self, level: np.ndarray, g: np.ndarray, v: np.ndarray):
        self.tables = {}
        for k in range(1 - ORDER, ORDER + 1):
            pick = level == k
            order = np.argsort(g[pick])
            self.tables[k] = g[pick][order], v[pick][order]
        self.key = np.full(1 << self.SLOTS_LOG2, -1, dtype=np.int64)
        self.value = np.zeros(1 << self.SLOTS_LOG2)

    @staticmethod
    def _look(table, keys):
        g, v = table
        if not len(g):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(g, keys), len(g) - 1)
        return g[at] == keys, v[at]

    def _back_off(self, codes: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        for k in range(ORDER, 0, -1):
            keys = codes[left] & ((1 << SYMBOL_BITS * k) - 1)
            found, v = self._look(self.tables[k], keys)
            out[left[found]] += v[found]
            left, keys = left[~found], keys[~found]
            if k > 1:
                seen, v = self._look(self.tables[1 - k], keys >> SYMBOL_BITS)
                out[left] += np.where(seen, v, 0.0)
        out[left] += self.tables[0][1][0]
        return out

    def logp(self, codes: np.ndarray) -> np.ndarray:
        slot = (textbuf.mix(codes.view(np.uint64)) >> np.uint64(64 - self.SLOTS_LOG2)).astype(np.int64)
        out = self.value[slot]
        miss = np.flatnonzero(self.key[slot] != codes)
        if len(miss):
            u, back = np.unique(codes[miss], return_inverse=True)
            v = self._back_off(u)
            out[miss] = v[back]
            s = (textbuf.mix(u.view(np.uint64)) >> np.uint64(64 - self.SLOTS_LOG2)).astype(np.int64)
            self.key[s], self.value[s] = u, v
        return out


def shards(model: DataFrame, shard_rows: int) -> list[list[int]]:
    """Symbols (those before the predicted one) dealt to shards of about ``shard_rows`` rows.
    Unigrams belong to every shard."""
    before = F.when(F.col("level").between(2, ORDER), F.shiftright("g", SYMBOL_BITS).bitwiseAND(_MASK)).when(
        F.col("level") < 0, F.col("g").bitwiseAND(_MASK))
    sizes = model.select(before.alias("s")).where("s is not null").groupBy("s").count().collect()  # one row per symbol
    out, room = [[]], shard_rows
    for r in sorted(sizes, key=lambda r: (-r["count"], r.s)):
        if r["count"] > room and out[-1]:
            out.append([])
            room = shard_rows
        out[-1].append(r.s)
        room -= r["count"]
    return out


def with_logp(df: DataFrame, model: DataFrame, text_col: str = "text", shard_rows: int = 6_000_000) -> tuple[DataFrame, str, str]:
    """``df`` with two columns added (their names follow): the text's log probability
    under the model, and its number of symbols. One pass over the texts per shard."""
    total, size = free_name(df.columns, "logp"), free_name(df.columns, "n_symbols")
    at = df.columns.index(text_col)
    points = np.sort(model.where(F.col("level") == ALPHABET).select("g").toArrow().column(0).to_numpy())
    dealt = shards(model, shard_rows)
    for i, own in enumerate(dealt):
        df = _one_shard(df, model, own, i, len(dealt), at, total, size, points)
    return df, total, size


def _one_shard(df: DataFrame, model: DataFrame, own: list[int], number: int, n_shards: int, at: int, total: str,
               size: str, points: np.ndarray) -> DataFrame:
    before = F.when(F.col("level").between(2, ORDER), F.shiftright("g", SYMBOL_BITS).bitwiseAND(_MASK)).otherwise(F.col("g").bitwiseAND(_MASK))
    rows = model.where(F.col("level") <= ORDER)
    rows = rows if n_shards == 1 else rows.where(F.col("level").isin(0, 1) | before.isin(own))
    got = rows.select(F.col("level").cast("byte").alias("level"), "g", F.col("v").cast("float").alias("v")).toArrow()
    shared = df.sparkSession.sparkContext.broadcast(tuple(c.to_numpy() for c in got.columns))
    # a context's symbol that no shard owns is scored by the first
    owner = np.zeros(_MASK + 1, dtype=bool)
    owner[own] = True
    others = None if n_shards == 1 else owner
    first = number == 0
    fields = df.schema.fields if not first else [*df.schema.fields, T.StructField(total, T.DoubleType()),
                                                 T.StructField(size, T.LongType())]
    known = None if n_shards == 1 else _known(model)

    def run(batches):
        shard, table = Shard(*shared.value), symbol_table(points)
        for b in batches:
            sums, sizes = [], []
            for _, data, off in textbuf.slices(b.column(at)):
                codes, ends = symbols(data, off, table)
                if others is None:
                    logp = shard.logp(codes)
                else:
                    s = codes >> SYMBOL_BITS & _MASK
                    mine = others[s] | (first & ~known[s])
                    logp = np.zeros(len(codes))
                    logp[mine] = shard.logp(codes[mine])
                upto = np.concatenate([[0.0], np.cumsum(logp)])
                sums.append(upto[ends[1:]] - upto[ends[:-1]])
                sizes.append(np.diff(ends))
            sums = np.concatenate(sums) if sums else np.zeros(0)
            if first:
                cols = [*b.columns, pa.array(sums), pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64), pa.int64())]
            else:
                k = b.schema.names.index(total)
                cols = [*b.columns[:k], pa.array(b.column(k).to_numpy() + sums), *b.columns[k + 1:]]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return df.mapInArrow(freed(run), T.StructType(fields))


def _known(model: DataFrame) -> np.ndarray:
    """Which symbols some shard owns."""
    own = np.zeros(_MASK + 1, dtype=bool)
    own[[s for part in shards(model, 1 << 62) for s in part]] = True
    return own


def _only(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is in ``ids`` (distinct): broadcast up to MAX_BROADCAST_IDS longs, else a shuffled join."""
    few = ids.count() <= MAX_BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs[id_col] == ids["_trusted"], "left_semi")


def judged(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           quantile: float = 0.995, folds: int = 10, least: int = 30) -> tuple[DataFrame, str, str]:
    """``docs`` with log perplexity and its threshold added; the names of the two columns follow.

    ``trusted_ids``: one column of the ids of trusted rows."""
    ids = staged(trusted_ids.select(F.col(trusted_ids.columns[0]).cast("long").alias("_trusted"))
                 .where("_trusted is not null").distinct(), "trusted-ids")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    fold = F.pmod(F.xxhash64("_trusted"), F.lit(folds))
    model = train(_only(texts, ids.where(fold != 0), "doc_id"))
    if model.where("level = 0").isEmpty():  # nothing is trusted
        names = [free_name(docs.columns, n) for n in ("log_perplexity", "log_threshold")]
        return docs.withColumns({n: F.lit(None).cast("double") for n in names}), *names
    sample, total, size = with_logp(_only(texts, ids.where(fold == 0), "doc_id"), model)
    sample = staged(sample.where(F.col(size) > 0).select("lang", total, size), "trusted-scores")
    both = sample.unionByName(sample.withColumn("lang", F.lit(None).cast("string")).withColumn("all", F.lit(True)), True)
    by = ["lang", F.coalesce("all", F.lit(False)).alias("all")]
    means = both.groupBy(*by).agg((F.sum(total) / F.sum(size)).alias("mean"), F.count(F.lit(1)).alias("rows"))
    means = means.select(F.col("lang").alias("_lang"), F.col("all").alias("_all"), "mean", "rows")
    both = both.select(*by, total, size)
    met = both.join(F.broadcast(means), F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("all") == F.col("_all")))
    log_ppl = -(F.col(total) + PRIOR * F.col("mean")) / (F.col(size) + PRIOR)
    marks = met.groupBy("lang", "all", "mean", "rows").agg(
        F.percentile_approx(log_ppl, quantile, 10_000).alias("limit"))
    limits = staged(marks.coalesce(1), "quality-limits")
    general = limits.where("all").first()
    own = limits.where(~F.col("all") & (F.col("rows") >= least)).select(
        F.col("lang").alias("_lang"), F.col("mean").alias("_mean"), F.col("limit").alias("_limit"))
    scored, total, size = with_logp(docs, model, text_col)
    ppl, limit = (free_name(scored.columns, n) for n in ("log_perplexity", "log_threshold"))
    mean = F.coalesce("_mean", F.lit(general["mean"] if general else 0.0))
    value = F.when(F.col(size) > 0, -(F.col(total) + PRIOR * mean) / (F.col(size) + PRIOR))
    bound = F.coalesce("_limit", F.lit(general["limit"] if general else None).cast("double"))
    scored = scored.join(F.broadcast(own), scored[lang_col].eqNullSafe(F.col("_lang")), "left")
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns], value.alias(ppl), bound.alias(limit)), ppl, limit


def keeps(ppl: str, limit: str):
    return F.coalesce(F.col(ppl) <= F.col(limit), F.lit(True))


def classify(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", **options) -> DataFrame:
    """doc_id, lang, perplexity, threshold, kept of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"))
    out, ppl, limit = judged(rows, trusted_ids, **options)
    return out.select("doc_id", "lang", F.exp(ppl).alias("perplexity"), F.exp(limit).alias("threshold"),
                      keeps(ppl, limit).alias("kept"))


def filter_documents(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    out, ppl, limit = judged(docs, trusted_ids, id_col, text_col, lang_col, **options)
    return out.where(keeps(ppl, limit)).select(*[F.col(f"`{c}`") for c in docs.columns])
