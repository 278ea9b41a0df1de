"""SentencePiece encoding and decoding by a relational lattice.

A text is escaped as SentencePiece does (one space is put before it, spaces
become the word mark) and cut into words between any two characters that no
piece holds side by side (a letter and the next word's mark, for one): no piece
can cross such a place, so words are encoded one by one, however long.

Documents are dealt into chunks (runs of rows of an input split, about
``CHUNK_BYTES`` of text). Each chunk numbers its distinct words in the order in
which they come and asks for each once. The distinct words of all chunks are
exploded into their substrings of bounded length, equi-joined to the piece
table, grouped again by word, and folded with Spark's higher-order ``aggregate``.
The answers go back to the chunks, where each document's ids are put together
from the numbers of its words. What is shuffled is a row per chunk and distinct
word, the answers, which a task packs into a row per chunk, and the words'
numbers once, compressed; the texts themselves don't travel.

The fold is the model type's own. Unigram: Viterbi, the best sum of scores up
to each position, then back from the end; of equal paths the one whose last
piece is longer; an unknown character costs ``UNKNOWN`` below the lowest score.
BPE: its scores are merge ranks, whose sums mean nothing, so Viterbi would not
give the model's ids; there the fold takes, step by step, the edge of the best
score (of equal ones the leftmost) that joins two neighbours, until none does.
A character that no piece holds becomes its byte pieces. The lattice's folds cost
the square of a word's length, so distinct words of over ``MAX_WORD`` characters
(without a cut place) are not asked for: the task that puts a chunk's ids
together folds them to the same answer by a heap of joins, or by Viterbi over
lists, in memory that grows with the longest word.

``docs`` must deal the same rows to the same partition whenever it is run, as
a table scan does; a chunk's key holds a digest of its words, and a word without
an answer raises an error.

Cases: null and empty texts have no ids; texts may be of any length; a word
mark in a text decodes as a space, as in the library; repeated rows are encoded
one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewise.llm import textbuf
from notewise.llm.staging import freed, id_and_text

MARK = "▁"
MAX_WORD = 512  # longer words are folded outside the lattice
SHORT = 60  # words of up to so many characters keep their cuts in one integer
CHUNK_BYTES = 8 << 20
UNKNOWN = 10.0
_SLICE = 1 << 17  # bytes of text handled at a time (a task has two Python workers here)
_WORDS = 1 << 15  # words whose documents are put together at a time
_USER_DEFINED = -1e8  # scores below are placeholders of user-defined pieces


@lru_cache(maxsize=2)
def model(path: str):
    from sentencepiece import SentencePieceProcessor
    return SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def piece_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Text bytes of each id (word marks as spaces), as flat bytes and starts."""
    sp = model(path)
    out = []
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            out.append(bytes([int(sp.id_to_piece(i)[1:-1], 16)]))
        else:
            out.append(b"" if sp.is_control(i) else sp.id_to_piece(i).replace(MARK, " ").encode())
    starts = np.concatenate([[0], np.cumsum([len(x) for x in out])])
    return np.frombuffer(b"".join(out), dtype=np.uint8), starts


def piece_table(spark: SparkSession, path: str) -> tuple[DataFrame, list[int], float]:
    """(piece, id, score); the ids of the 256 byte pieces; the score of an unknown character.

    The table has one row per piece of the vocabulary file, a fixed size."""
    sp = model(path)
    rows, to_byte, lowest = [], [sp.unk_id()] * 256, 0.0
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            to_byte[int(sp.id_to_piece(i)[1:-1], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            score = float(sp.get_score(i))
            rows.append((sp.id_to_piece(i), i, score))
            lowest = min(lowest, score) if score > _USER_DEFINED else lowest
    return spark.createDataFrame(rows, "piece string, id int, score double"), to_byte, lowest - UNKNOWN


# ---- words of documents

_LOW = 0x250  # pairs of characters below this are looked up in a table, others by search


@lru_cache(maxsize=2)
def neighbours(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of characters that some piece holds side by side: a table for low ones, and all, sorted."""
    sp = model(path)
    pairs = set()
    for i in range(sp.get_piece_size()):
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            piece = sp.id_to_piece(i).replace(MARK, " ")
            pairs.update(zip(map(ord, piece), map(ord, piece[1:])))
    table = np.zeros((_LOW, _LOW), dtype=bool)
    for a, b in pairs:
        if a < _LOW and b < _LOW:
            table[a, b] = True
    return table.ravel(), np.array(sorted(a << 21 | b for a, b in pairs), dtype=np.int64)


def words(data: np.ndarray, off: np.ndarray, path: str):
    """(code points, starts, ends, first): word spans of the rows, each text after one more space."""
    table, every = neighbours(path)
    cp, at = textbuf.code_points(data, off)
    size = np.diff(at)
    full = size > 0
    new = np.concatenate([[0], np.cumsum(size + full)])
    units = np.full(int(new[-1]), 32, dtype=np.int64)
    units[np.arange(len(cp)) + np.repeat(np.cumsum(full), size)] = cp
    a, b = units[:-1], units[1:]
    low = (a < _LOW) & (b < _LOW)
    held = table[np.where(low, a * _LOW + b, 0)]
    high = np.flatnonzero(~low)
    if len(high) and len(every):
        key = a[high] << 21 | b[high]
        held[high] = every[np.minimum(np.searchsorted(every, key), len(every) - 1)] == key
    begin = np.ones(len(units), dtype=bool)
    begin[1:] = ~held
    begin[new[:-1][full]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(units))
    return units, starts, ends, np.searchsorted(starts, new)


def spelled(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """The spans as strings."""
    size = ends - starts
    cp = units[textbuf.ragged(starts, size)].astype("<u4")
    width = 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(size)])]
    flat = cp.tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(flat))


def _without_marks(col):
    import pyarrow.compute as pc
    return pc.replace_substring(col.cast(pa.large_string()).fill_null(""), MARK, " ")


def _chunks(batches):
    """(number, doc ids, texts) of one task, about CHUNK_BYTES of text each."""
    number, ids, texts, held = TaskContext.get().partitionId() << 16, [], [], 0
    for b in batches:
        text = _without_marks(b.column(1))
        ids.append(b.column(0))
        texts.append(text)
        held += text.nbytes
        if held >= CHUNK_BYTES:
            yield number, pa.concat_arrays(ids), pa.concat_arrays(texts)
            number, ids, texts, held = number + 1, [], [], 0
    if ids:
        yield number, pa.concat_arrays(ids), pa.concat_arrays(texts)


def _key(number: int, keys: np.ndarray) -> int:
    """A chunk's key: its number and 20 bits of a digest of its distinct words in order."""
    digest = np.bitwise_xor.reduce(textbuf.mix(keys + np.arange(len(keys), dtype=np.uint64))) if len(keys) else 0
    return number << 20 | int(digest) & 0xFFFFF


def _in_order(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each distinct key, in order, and the number of each key among the distinct ones."""
    every = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
    _, first, inverse = np.unique(every, return_index=True, return_inverse=True)
    number = np.empty(len(first), dtype=np.int32)
    number[np.argsort(first)] = np.arange(len(first), dtype=np.int32)
    return np.sort(first), number[inverse]


_SEEN = 1 << 18  # places in which a task remembers words that it met, the last one a place


def _asked(rows: DataFrame, path: str) -> DataFrame:
    """(chunk, at, word): each chunk's distinct words of up to MAX_WORD characters, and their numbers there."""

    def run(batches):
        for number, _, texts in _chunks(batches):
            seen = (np.arange(_SEEN, dtype=np.uint64) + np.uint64(1)) % np.uint64(_SEEN)  # no word that belongs to the place
            keys, short, spelt = [], [], []
            for _, data, off in textbuf.slices(texts, _SLICE):
                units, starts, ends, _ = words(data, off, path)
                key = textbuf.span_hashes(units, starts, ends)
                place = (key % np.uint64(_SEEN)).astype(np.intp)
                at = np.flatnonzero(seen[place] != key)  # all that are new, and some met before
                at = at[np.sort(np.unique(key[at], return_index=True)[1])]
                seen[place[at]] = key[at]
                few = ends[at] - starts[at] <= MAX_WORD
                keys.append(key[at])
                short.append(few)
                spelt.append(spelled(units, starts[at], np.where(few, ends[at], starts[at])))
            first, _ = _in_order(keys)
            if not len(first):
                continue
            keys, at = np.concatenate(keys)[first], np.flatnonzero(np.concatenate(short)[first])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), _key(number, keys), dtype=np.int64)), pa.array(at.astype(np.int32)),
                 pa.concat_arrays(spelt).take(pa.array(first[at]))], names=["chunk", "at", "word"])

    return rows.mapInArrow(freed(run), "chunk long, at int, word string")


def _planes(numbers: np.ndarray) -> np.ndarray:
    """Unsigned little-endian numbers of 4 bytes, a byte a plane."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel()


def _of_planes(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


_BUNDLE = ("ids", "words", "planes", "long_at", "long")


def _bundles(rows: DataFrame, path: str) -> DataFrame:
    """(chunk, bundle): each chunk's doc ids, words a document, word numbers and words of over MAX_WORD characters.

    A number that comes for the first time (it is the next one) is 0, others are one more; a byte a plane."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=5)
        for number, ids, texts in _chunks(batches):
            keys, local, sizes, long_keys, long = [], [], [], [], []
            for _, data, off in textbuf.slices(texts, _SLICE):
                units, starts, ends, of_row = words(data, off, path)
                key = textbuf.span_hashes(units, starts, ends)
                first, mine = _in_order([key])
                keys.append(key[first])
                local.append(mine)
                sizes.append(np.diff(of_row).astype(np.int32))
                one = first[ends[first] - starts[first] > MAX_WORD]
                long_keys.append(key[one])
                long.append(spelled(units, starts[one], ends[one]))
            first, numbers = _in_order(keys)
            edge = np.cumsum([0, *map(len, keys)])
            every = np.concatenate(keys)[first] if keys else np.zeros(0, dtype=np.uint64)
            at = np.concatenate([numbers[x:][mine] for x, mine in zip(edge, local)]) if keys else np.zeros(0, dtype=np.int32)
            code = at + 1
            code[np.flatnonzero(np.diff(np.maximum.accumulate(at), prepend=-1))] = 0
            one, _ = _in_order(long_keys)
            order = np.argsort(every)
            long_at = order[np.searchsorted(every, np.concatenate(long_keys)[one], sorter=order)] if len(one) else one
            lists = [ids, pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int32)),
                     pa.array(_planes(code)), pa.array(long_at.astype(np.int32)),
                     pa.concat_arrays(long).take(pa.array(one)) if long else pa.array([], pa.string())]
            batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists], names=_BUNDLE)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as w:
                w.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([_key(number, every)], pa.int64()), pa.array([press.compress(sink.getvalue())], pa.binary())],
                                             names=["chunk", "bundle"])

    return rows.mapInArrow(freed(run), "chunk long, bundle binary")


def _unbundled(raw: bytes) -> list:
    """Doc ids, words a document, word numbers, and numbers and texts of long words."""
    batch = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(raw)).read_all().combine_chunks().to_batches()[0]
    ids, sizes, planes, long_at, long = (batch.column(i).flatten() for i in range(len(_BUNDLE)))
    code = _of_planes(planes.to_numpy())
    new = code == 0
    return [ids, sizes.to_numpy(), np.where(new, np.cumsum(new) - 1, code - 1), long_at.to_numpy(), long.to_pylist()]


_ROWS = 64  # packed answers handed over at a time


def _packed(answers: DataFrame) -> DataFrame:
    """(chunk, answers) of (chunk, at, ids) in order: a partition's answers to a chunk, as steps from one word's
    number to the next, numbers of ids, and ids."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=5)
        chunk, held, done = None, [], []

        def row():
            at, size, ids = (np.concatenate(x) for x in zip(*held))
            count = np.array([len(at)], dtype="<u4").tobytes()
            raw = (_planes(x).tobytes() for x in (np.diff(at, prepend=0), size, ids))
            return chunk, count + press.compress(b"".join(raw))

        def batch():
            chunks, answers = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(answers, pa.binary())], names=["chunk", "answers"])

        for b in batches:
            if not b.num_rows:
                continue
            of, at, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            edge, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1), len(of)]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if held and of[x] != chunk:
                    done.append(row())
                    held = []
                chunk = int(of[x])
                held.append((at[x:y], np.diff(edge[x:y + 1]), flat[edge[x]:edge[y]]))
            if len(done) >= _ROWS:
                yield batch()
                done = []
        if held:
            done.append(row())
            yield batch()

    return answers.mapInArrow(freed(run), "chunk long, answers binary")


def _unpacked(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words' numbers, numbers of ids, and ids of a chunk's packed answers."""
    parts = [[np.zeros(0, dtype=np.int64)] * 3]
    for raw in raws:
        n = int(np.frombuffer(raw, dtype="<u4", count=1)[0])
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[4:]), dtype=np.uint8)
        step, size, ids = (_of_planes(x) for x in np.split(planes, [4 * n, 8 * n]))
        parts.append([np.cumsum(step), size, ids])
    at, size, ids = (np.concatenate(x) for x in zip(*parts))
    return at, size, ids


# ---- the lattice

def lattice(distinct: DataFrame, pieces: DataFrame, to_byte: list[int], unknown: float, longest: int) -> DataFrame:
    """(h, edges) of (h, word): every piece at every place, as (end, start, score, ids), sorted."""
    word = F.translate("word", " ", MARK)
    at = F.explode(F.expr("sequence(1, char_length(w))")).alias("start")
    spans = (distinct.select("h", word.alias("w")).select("h", "w", at)
             .select("h", "start", F.expr(f"substring(w, start, {longest})").alias("rest"))
             .select("h", "start", "rest", F.explode(F.expr("sequence(1, char_length(rest))")).alias("n"))
             .select("h", "start", "n", F.expr("substring(rest, 1, n)").alias("piece")))
    table = F.array(*[F.lit(i) for i in to_byte])
    raw = F.encode("piece", "utf-8")
    as_bytes = F.transform(F.sequence(F.lit(1), F.octet_length("piece")), lambda i: F.element_at(
        table, (F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int") + 1)))
    edges = spans.join(F.broadcast(pieces), "piece", "left").where("id is not null or n = 1")
    edge = F.struct((F.col("start") + F.col("n") - 1).alias("end"), (F.col("start") - 1).alias("start"),
                    F.coalesce("score", F.lit(unknown)).alias("score"),
                    F.when(F.col("id").isNotNull(), F.array("id")).otherwise(as_bytes).alias("ids"))
    return edges.select("h", edge.alias("e")).groupBy("h").agg(F.sort_array(F.collect_list("e")).alias("edges"))


def best_path(lattices: DataFrame) -> DataFrame:
    """(h, ids): Viterbi over the sorted edges. ``best[i]`` is (score, start, ids) of the
    best way to position i; an edge to a new position is appended, a better one replaces it."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start"), F.array().cast("array<int>").alias("ids")))

    def step(best, e):
        score = best[e["start"]]["score"] + e["score"]
        way = F.array(F.struct(score.alias("score"), e["start"].alias("start"), e["ids"].alias("ids")))
        return (F.when(F.size(best) == e["end"], F.concat(best, way))
                .when(score > best[e["end"]]["score"], F.concat(F.slice(best, 1, e["end"]), way)).otherwise(best))

    best = F.aggregate("edges", start, step)
    back = F.aggregate(
        F.sequence(F.lit(1), F.size("best") - 1), F.struct((F.size("best") - 1).alias("at"), F.array().cast("array<int>").alias("ids")),
        lambda acc, _: F.when(acc["at"] > 0, F.struct(
            F.col("best")[acc["at"]]["start"].alias("at"), F.concat(F.col("best")[acc["at"]]["ids"], acc["ids"]).alias("ids")))
        .otherwise(acc), lambda acc: acc["ids"])
    return lattices.select("h", best.alias("best")).select("h", back.alias("ids"))


def merged_path(lattices: DataFrame) -> DataFrame:
    """(h, ids): the merges of a BPE model over the sorted edges.

    The state is the set of cuts between the pieces so far; an edge is a merge
    if its ends are cuts and there is one cut between. A word of n characters has
    at most n - 1 merges; a step without one leaves the cuts as they are. What a
    lambda reads travels in the state: an outer column's expression would be
    evaluated again in every step."""
    size = F.element_at("edges", -1)["end"]
    return merged_short(lattices.where(size <= SHORT)).unionByName(merged_longer(lattices.where(size > SHORT)))


def _let(value, body):
    return F.transform(F.array(value), body)[0]


def merged_short(lattices: DataFrame) -> DataFrame:
    """:func:`merged_path` of words of up to SHORT characters: the cuts are the bits of one long."""
    rows = lattices.withColumn("size", F.element_at("edges", -1)["end"])
    masked = F.expr("""transform(edges, e -> struct(
        e.score as score, -e.start as left, shiftleft(1L, e.start) | shiftleft(1L, e.end) as ends,
        shiftleft(1L, e.end) - shiftleft(2L, e.start) as inside, e.ids as ids))""")

    def bit_step(acc, _):
        best = F.array_max(F.filter(acc["joins"], lambda j: (acc["cuts"].bitwiseAND(j["ends"]) == j["ends"]) & (
            F.bit_count(acc["cuts"].bitwiseAND(j["inside"])) == 1)))
        off = F.coalesce(F.bitwise_not(best["inside"]), F.lit(-1).cast("long"))
        return F.struct(acc["cuts"].bitwiseAND(off).alias("cuts"), acc["joins"].alias("joins"))

    def by_bits(edges):
        joins = F.filter(edges, lambda e: e["inside"] != 0)
        start = F.struct(F.expr("shiftleft(1L, size + 1) - 1").alias("cuts"), joins.alias("joins"))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("size") - 1, F.lit(1))), start, bit_step, lambda acc: acc["cuts"])

    def bit_ids(pair):
        return F.flatten(F.transform(F.filter(pair["edges"], lambda e: (
            pair["cuts"].bitwiseAND(e["ends"]) == e["ends"]) & (pair["cuts"].bitwiseAND(e["inside"]) == 0)), lambda e: e["ids"]))

    return rows.select("h", _let(masked, lambda edges: _let(
        F.struct(edges.alias("edges"), by_bits(edges).alias("cuts")), bit_ids)).alias("ids"))


def merged_longer(lattices: DataFrame) -> DataFrame:
    """:func:`merged_path` of longer words: a sorted array of cuts."""
    rows = lattices.withColumn("size", F.element_at("edges", -1)["end"])

    def step(acc, _):
        def joins_two(e):
            at = F.array_position(acc["cuts"], e["start"]).cast("int")
            return (at > 0) & (F.get(acc["cuts"], at + 1) == e["end"])
        best = F.array_max(F.transform(F.filter(acc["joins"], joins_two), lambda e: F.struct(
            e["score"].alias("score"), (-e["start"]).alias("left"), e["end"].alias("end"))))
        cuts = _let(best, lambda m: F.when(m.isNull(), acc["cuts"]).otherwise(
            F.filter(acc["cuts"], lambda c: (c <= -m["left"]) | (c >= m["end"]))))
        return F.struct(cuts.alias("cuts"), acc["joins"].alias("joins"))

    start = F.struct(F.sequence(F.lit(0), "size").alias("cuts"), F.filter("edges", lambda e: e["end"] - e["start"] > 1).alias("joins"))
    cuts = F.aggregate(F.sequence(F.lit(1), F.col("size") - 1), start, step, lambda acc: acc["cuts"])
    return rows.select("h", _let(cuts, lambda c: F.flatten(F.transform(
        F.filter("edges", lambda e: F.get(c, F.array_position(c, e["start"]).cast("int")) == e["end"]),
        lambda e: e["ids"]))).alias("ids"))


def is_bpe(path: str) -> bool:
    from sentencepiece import sentencepiece_model_pb2
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model(path).serialized_model_proto())
    return proto.trainer_spec.model_type == proto.trainer_spec.BPE


# ---- words of over MAX_WORD characters

@lru_cache(maxsize=2)
def piece_scores(path: str) -> tuple[dict, list[int], float]:
    """piece -> (score, id), and the ids and the score of :func:`piece_table`."""
    sp = model(path)
    table, to_byte, lowest = {}, [sp.unk_id()] * 256, 0.0
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            to_byte[int(sp.id_to_piece(i)[1:-1], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            score = float(sp.get_score(i))
            table[sp.id_to_piece(i)] = score, i
            lowest = min(lowest, score) if score > _USER_DEFINED else lowest
    return table, to_byte, lowest - UNKNOWN


def _ids_of(word: str, edges, table: dict, to_byte: list[int]) -> list[int]:
    ids = []
    for a, b in edges:
        known = table.get(word[a:b])
        ids.extend([known[1]] if known else [to_byte[x] for x in word[a:b].encode()])
    return ids


def merged_long(word: str, table: dict, to_byte: list[int]) -> list[int]:
    """As :func:`merged_path`: the join of the best score, of equal ones the leftmost, until there is none."""
    n, longest = len(word), max(map(len, table))
    end = list(range(1, n + 1))  # end of the piece that starts here; 0 once it is joined to the one before
    before = list(range(-1, n - 1))  # start of the piece before
    heap = []

    def offer(a, b, c):  # the pieces a to b and b to c
        known = table.get(word[a:c]) if c - a <= longest else None
        if known:
            heapq.heappush(heap, (-known[0], a, b, c))

    for a in range(n - 1):
        offer(a, a + 1, a + 2)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if end[a] != b or end[b] != c:
            continue
        end[a], end[b] = c, 0
        if c < n:
            before[c] = a
            offer(a, c, end[c])
        if a:
            offer(before[a], a, c)
    edges, at = [], 0
    while at < n:
        edges.append((at, end[at]))
        at = end[at]
    return _ids_of(word, edges, table, to_byte)


def best_long(word: str, table: dict, to_byte: list[int], unknown: float) -> list[int]:
    """As :func:`best_path`: Viterbi; of equal paths the one whose last piece is longer."""
    n, longest = len(word), max(map(len, table))
    score, start = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for e in range(1, n + 1):
        for s in range(max(0, e - longest), e):
            known = table.get(word[s:e])
            if known or e - s == 1:
                way = score[s] + (known[0] if known else unknown)
                if way > score[e]:
                    score[e], start[e] = way, s
    edges, at = [], n
    while at:
        edges.append((start[at], at))
        at = start[at]
    return _ids_of(word, edges[::-1], table, to_byte)


def long_answers(texts: list[str], path: str, bpe: bool) -> list[np.ndarray]:
    """The ids of the words, folded one by one."""
    table, to_byte, unknown = piece_scores(path)
    spelt = (w.replace(" ", MARK) for w in texts)
    return [np.array(merged_long(w, table, to_byte) if bpe else best_long(w, table, to_byte, unknown), dtype=np.int32) for w in spelt]


def encode_words(asked: DataFrame, path: str) -> DataFrame:
    """(h, ids) of the distinct words of (chunk, at, word, h); rows of an h stay in one partition.

    All of a row is read here, as by the join with the answers, so that both read the same exchange."""
    pieces, to_byte, unknown = piece_table(asked.sparkSession, path)
    sp = model(path)
    longest = max(len(sp.id_to_piece(i)) for i in range(sp.get_piece_size()) if not sp.is_byte(i) and not sp.is_control(i))
    distinct = asked.groupBy("h", "word").agg(F.max("chunk").alias("chunk"), F.max("at").alias("at"), F.max(F.char_length("word")).alias("size"))
    distinct = distinct.where("chunk >= 0 and at >= 0")

    def edges(rows):
        return lattice(rows.select("h", "word"), pieces, to_byte, unknown, longest)
    if not is_bpe(path):
        return best_path(edges(distinct))
    # told apart before the lattice, which is so built once a word, but after the exchange, which all read
    return merged_short(edges(distinct.where(f"size <= {SHORT}"))).unionByName(merged_longer(edges(distinct.where(f"size > {SHORT}"))))


def texts_of(ids: np.ndarray, edge: np.ndarray, path: str) -> list[str]:
    """The texts of runs of ids (run i is ids[edge[i]:edge[i + 1]])."""
    flat, starts = piece_bytes(path)
    size = starts[ids + 1] - starts[ids]
    data = flat[textbuf.ragged(starts[ids], size)].tobytes()
    upto = np.concatenate([[0], np.cumsum(size)])[edge]
    return [data[x:y].decode("utf-8", "replace")[1:] for x, y in zip(upto[:-1], upto[1:])]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, ids of each row; with ``decoded`` also the text that the ids decode to
    (as :func:`decode` would add it, without another Python worker per task)."""
    rows = id_and_text(docs, id_col, text_col)
    bpe = is_bpe(path)
    h = F.xxhash64("word")  # made after the exchange: it needs no room there
    asked = _asked(rows, path).repartition(h).withColumn("h", h)
    # a row a chunk, packed: the ids alone would be the largest part of what is shuffled
    answers = _packed(asked.join(encode_words(asked, path), "h").select("chunk", "at", "ids").sortWithinPartitions("chunk", "at"))

    def assemble(bundle: pa.Table, answer: pa.Table) -> pa.Table:
        none = {"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))}
        out = [pa.table(none | ({"text": pa.array([], pa.string())} if decoded else {}))]
        at, count, flat = _unpacked(answer["answers"].to_pylist())
        for raw in bundle["bundle"].to_pylist():
            doc_ids, n_words, numbers, long_at, long = _unbundled(raw)
            begin, size = np.zeros((2, int(numbers.max(initial=-1)) + 1), dtype=np.int64)
            known = np.zeros(len(begin), dtype=bool)
            if at.max(initial=-1) < len(begin):
                begin[at], size[at], known[at] = np.cumsum(count) - count, count, True
            if len(long):  # the chunk's longer words, each folded once
                found = long_answers(long, path, bpe)
                more = np.array([len(x) for x in found], dtype=np.int64)
                begin[long_at], size[long_at], known[long_at] = len(flat) + np.cumsum(more) - more, more, True
                flat = np.concatenate([flat, *found])
            if not known.all():
                raise ValueError("a word has no answer: the input's partitions differ between two runs")
            upto_word = np.concatenate([[0], np.cumsum(n_words, dtype=np.int64)])
            first = 0
            while first < len(n_words):
                last = max(first + 1, int(np.searchsorted(upto_word, upto_word[first] + _WORDS, side="right")) - 1)
                mine = numbers[upto_word[first]:upto_word[last]]
                ids = flat[textbuf.ragged(begin[mine], size[mine])]
                upto = np.concatenate([[0], np.cumsum(size[mine])])[upto_word[first:last + 1] - upto_word[first]]
                rows = {"doc_id": doc_ids.slice(first, last - first),
                        "ids": pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids.astype(np.int32)))}
                if decoded:
                    rows["text"] = pa.array(texts_of(ids.astype(np.int64), upto, path), pa.string())
                out.append(pa.table(rows))
                first = last
        return pa.concat_tables(out)

    return _bundles(rows, path).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        assemble, "doc_id long, ids array<int>" + (", text string" if decoded else ""))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", name: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids added."""
    at = encoded.columns.index(ids_col)
    kinds = [*encoded.columns, name]

    def run(batches):
        for b in batches:
            lists = b.column(at)
            edge = lists.offsets.to_numpy()
            text = texts_of(lists.flatten().to_numpy().astype(np.int64), edge - edge[0], path)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=kinds)

    return encoded.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields) + f", `{name}` string")
