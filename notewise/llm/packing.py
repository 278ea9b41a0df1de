"""Packing: documents into training sequences, balanced by attention cost.

Each document becomes token ids of a byte-level BPE file plus an end id. Its
full windows of ``seq_len`` ids are sequences of their own; the remainders are
packed in groups. A group of remainders with R ids in all opens
R // seq_len sequences. Remainders go in descending order to the sequence of
the lowest cost (``linear * n + quadratic * n^2`` per piece: attention is
within a document) that has room for the whole piece; those that fit nowhere
are cut to fill the room that is left, in the lowest-cost sequence first. The
last R % seq_len ids form sequences whose lengths are powers of two, which
need no padding, so every sequence is full or a power of two.

A task packs the documents of its own input split, ``group_rows`` remainders
at a time: no shuffle, bounded memory (one batch plus one group), and a lost
task is redone from its split alone. ``sequence_id`` is the task's number
times 2^32 plus a counter.

Cases: null and empty texts hold the end id alone; a text of any length is cut
into windows; equal documents are packed one by one; an empty table gives no
rows; other columns are not read; a null doc_id stays null.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.llm import textbuf
from notewise.llm.staging import freed, id_and_text

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
#: The contractions of the byte-level BPE's splitting pattern.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")
_BAD, _OTHER, _LETTER, _NUMBER, _WHITE = 0, 1, 2, 3, 4
#: Unicode's White_Space in the basic plane (fixed values).
_WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of each code point of the basic plane; unassigned ones and those beyond are _BAD."""
    table = np.zeros(0x10000, dtype=np.uint8)
    for c in range(0x10000):
        k = unicodedata.category(chr(c))
        table[c] = {"L": _LETTER, "N": _NUMBER}.get(k[0], _BAD if k in ("Cn", "Cs", "Co") else _OTHER)
    table[_WHITE_SPACE] = _WHITE
    return table


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Vocabulary as bytes -> id, where ids grow in the order of the merges (then an
    id is also its merge's rank); None for other vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    model = spec["model"]
    made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if made != sorted(made) or spec["normalizer"] is not None:
        return None
    return {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items() if all(c in letters for c in piece)}


class ByteBpe:
    """Token ids of whole columns, by a ``tokenizers`` file with the GPT-2 style split.

    Texts are split with array operations; each distinct split string is
    merged once and remembered (at most ``memo`` of them, then the memory
    starts afresh). Texts with code points outside the class table or with a
    special token's string go to the tokenizer whole."""

    SLOTS_LOG2 = 19

    def __init__(self, path: str, memo: int = 150_000):
        import tiktoken
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            ranks = byte_ranks(json.load(f))
        if ranks is None:
            self.merge = lambda piece: self.tok.encode(piece.decode(), add_special_tokens=False).ids
        else:
            special = {s: self.tok.token_to_id(s) for s in self.special}
            ranks = {k: v for k, v in ranks.items() if v not in special.values()}
            self.merge = tiktoken.Encoding("ranks", pat_str=".", mergeable_ranks=ranks,
                                           special_tokens=special)._core_bpe.encode_single_piece
        self.limit = memo
        self.fresh()

    def fresh(self):
        self.known: dict[int, int] = {}
        self.key = np.zeros(1 << self.SLOTS_LOG2, dtype=np.uint64)
        self.entry = np.zeros(1 << self.SLOTS_LOG2, dtype=np.int32)
        self.begin = np.zeros(self.limit, dtype=np.int64)
        self.size = np.zeros(self.limit, dtype=np.int64)
        self.pool = np.zeros(1 << 20, dtype=np.uint32)
        self.used = 0

    def _learn(self, hashes: list[int], pieces: list[bytes]):
        ids = list(map(self.merge, pieces))
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        n = len(self.known)
        self.pool[self.used:self.used + len(flat)] = flat
        self.size[n:n + len(ids)] = size
        self.begin[n:n + len(ids)] = self.used + np.cumsum(size) - size
        self.used += len(flat)
        self.known.update(zip(hashes, range(n, n + len(ids))))

    def _split(self, cp: np.ndarray, off: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Positions where the splitting pattern begins a match."""
        n = len(cp)
        white, blank = cls == _WHITE, cp == 32
        first = np.zeros(n + 1, dtype=bool)
        first[off] = True
        begin = np.ones(n, dtype=bool)
        prev_white = np.zeros(n, dtype=bool)
        prev_white[1:] = white[:-1]
        next_solid = np.zeros(n, dtype=bool)
        next_solid[:-1] = ~white[1:]
        next_solid &= ~first[1:]
        begin[1:] = cls[1:] != cls[:-1]
        inside = white & prev_white
        begin[inside] = next_solid[inside]
        after_blank = np.zeros(n, dtype=bool)
        after_blank[1:] = blank[:-1]
        begin[~white & after_blank] = False
        begin |= first[:n]
        marks = np.flatnonzero((cp == 39) & begin)
        if len(marks):
            end = off[np.searchsorted(off, marks, side="right")]
            pad = np.concatenate([cp, np.zeros(3, cp.dtype)])
            a = np.where(marks + 1 < end, pad[marks + 1], 0)
            b = np.where(marks + 2 < end, pad[marks + 2], 0)
            one = np.isin(a, [ord(c) for c in ONE_LETTER])
            two = np.zeros(len(marks), dtype=bool)
            for x, y in TWO_LETTERS:
                two |= (a == ord(x)) & (b == ord(y))
            for hit, width in ((one, 2), (two & ~one, 3)):
                p = marks[hit]
                for k in range(1, width):
                    begin[p + k] = False
                stop = p + width
                begin[stop[stop < end[hit]]] = True
        return np.flatnonzero(begin)

    def _entries(self, h: np.ndarray, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Memory entries of the strings with the hashes h; learns those not yet known."""
        uniq, at = np.unique(h, return_index=True)
        keys = uniq.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.limit = max(self.limit, len(keys))
            self.fresh()
            new = range(len(keys))
        if len(new):
            text = cp.astype("<u4").tobytes().decode("utf-32-le")
            first = at[list(new)]
            self._learn([keys[i] for i in new],
                        [text[a:b].encode() for a, b in zip(starts[first].tolist(), ends[first].tolist())])
        entry = np.fromiter(map(self.known.__getitem__, keys), np.int32, len(keys))
        s = (uniq >> np.uint64(64 - self.SLOTS_LOG2)).astype(np.int64)
        self.key[s], self.entry[s] = uniq, entry
        return entry[np.searchsorted(uniq, h)]

    def _fast(self, cp: np.ndarray, off: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self._split(cp, off, cls)
        ends = np.append(starts[1:], len(cp))
        h = textbuf.span_hashes(cp, starts, ends)
        slot = (h >> np.uint64(64 - self.SLOTS_LOG2)).astype(np.int64)
        entry = self.entry[slot]
        miss = np.flatnonzero(self.key[slot] != h)
        if len(miss):
            memory = self.known
            found = self._entries(h[miss], cp, starts[miss], ends[miss])
            if self.known is memory:
                entry[miss] = found
            else:  # the memory was begun afresh: earlier hits point into the old one
                entry = self._entries(h, cp, starts, ends)
        size = self.size[entry]
        ids = self.pool[textbuf.ragged(self.begin[entry], size)]
        upto = np.concatenate([[0], np.cumsum(size)])
        return ids, upto[np.searchsorted(starts, off)]

    def encode_column(self, col):
        """Yield the ids (uint32 array) of each row, in order; null is empty."""
        table = char_classes()
        for _, data, off in textbuf.slices(col):
            cp, at = textbuf.code_points(data, off)
            cls = np.where(cp < 0x10000, table[np.minimum(cp, 0xFFFF)], _BAD)
            odd = np.zeros(len(at) - 1, dtype=bool)
            bad = np.flatnonzero(cls == _BAD)
            if len(bad):
                odd[np.searchsorted(at, bad, side="right") - 1] = True
            raw = data.tobytes()
            if any(s.encode() in raw for s in self.special):
                for r in range(len(odd)):
                    row = raw[off[r]:off[r + 1]]
                    odd[r] |= any(s.encode() in row for s in self.special)
            if odd.any():
                sizes = np.diff(at)
                keep = np.repeat(~odd, sizes)
                cp, cls = cp[keep], cls[keep]
                at = np.concatenate([[0], np.cumsum(np.where(odd, 0, sizes))])
            if len(cp):
                ids, upto = self._fast(cp, at, cls)
            for r in range(len(odd)):
                if odd[r]:
                    text = raw[off[r]:off[r + 1]].decode()
                    yield np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
                elif at[r] == at[r + 1]:
                    yield np.zeros(0, dtype=np.uint32)
                else:
                    yield ids[upto[r]:upto[r + 1]]


@lru_cache(maxsize=1)
def _encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


def assign(sizes: np.ndarray, room: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pack pieces of the given sizes (each < room) into full sequences.

    Returns (piece, start in it, length, sequence, offset). All
    sequences but the last few are full; those have power-of-two lengths."""
    sizes = np.asarray(sizes, dtype=np.int64)
    total = int(sizes.sum())
    n_full, tail = divmod(total, room)
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    cost = np.zeros(n_full)
    free = np.full(n_full, room, dtype=np.int64)
    out, rest = [], []
    for i in order.tolist():
        n = int(sizes[i])
        fits = np.where(free >= n, cost, np.inf) if n_full else cost
        b = int(fits.argmin()) if n_full else -1
        if b < 0 or fits[b] == np.inf:
            rest.append(i)
            continue
        out.append((i, 0, n, b, room - int(free[b])))
        free[b] -= n
        cost[b] += linear * n + quadratic * n * n
    bins = [(cost[b], b, room - int(free[b]), int(free[b])) for b in range(n_full) if free[b]]
    heapq.heapify(bins)
    tails, at = [], n_full
    for k in range(tail.bit_length() - 1, -1, -1):
        if tail >> k & 1:
            tails.append((at, 0, 1 << k))
            at += 1
    for i in rest:
        done, n = 0, int(sizes[i])
        while done < n:
            if bins:
                c, b, used, left = heapq.heappop(bins)
                take = min(left, n - done)
                if take < left:
                    heapq.heappush(bins, (c + linear * take + quadratic * take * take, b, used + take, left - take))
            else:
                b, used, left = tails.pop(0)
                take = min(left, n - done)
                if take < left:
                    tails.insert(0, (b, used + take, left - take))
            out.append((i, done, take, b, used))
            done += take
    return out


class _Packer:
    """Rows of one task: full windows at once, remainders by group."""

    def __init__(self, first: int, seq_len: int, group_rows: int, linear: float, quadratic: float):
        self.next, self.seq_len, self.group_rows = first, seq_len, group_rows
        self.linear, self.quadratic = linear, quadratic
        self.rest: list[tuple] = []
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray):
        n = len(ids)
        full = n - n % self.seq_len
        for s in range(0, full, self.seq_len):
            self.rows.append((doc_id, s, self.seq_len, zlib.crc32(ids[s:s + self.seq_len].tobytes()), n, self.next, 0))
            self.next += 1
        if full < n:
            self.rest.append((doc_id, full, n, ids[full:].copy()))
            if len(self.rest) >= self.group_rows:
                self.flush()

    def flush(self):
        placed = assign(np.array([len(r[3]) for r in self.rest]), self.seq_len, self.linear, self.quadratic)
        for i, start, length, seq, offset in placed:
            doc_id, full, n, ids = self.rest[i]
            self.rows.append((doc_id, full + start, length, zlib.crc32(ids[start:start + length].tobytes()), n,
                              self.next + seq, offset))
        self.next += max((p[3] for p in placed), default=-1) + 1
        self.rest = []

    def take(self, types) -> pa.RecordBatch:
        cols, self.rows = list(zip(*self.rows)) if self.rows else [[]] * 7, []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=types)


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 1024, end_id: int = 0, group_rows: int = 1024,
         linear: float = 1.0, quadratic: float = 1.0 / 1024, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece (see SCHEMA); the tokenizer file must be at the same path on every worker."""
    if seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")
    names = [p.split()[0] for p in SCHEMA.split(", ")]

    def run(batches):
        encoder = _encoder(tokenizer_path)
        packer = _Packer(TaskContext.get().partitionId() << 32, seq_len, group_rows, linear, quadratic)
        end = np.array([end_id], dtype=np.uint32)
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for i, ids in enumerate(encoder.encode_column(b.column(1))):
                packer.add(doc_ids[i], np.concatenate([ids, end]).astype("<u4"))
            yield packer.take(names)
        packer.flush()
        yield packer.take(names)

    return id_and_text(docs, id_col, text_col).mapInArrow(freed(run), SCHEMA)


def unpack(pieces: DataFrame) -> DataFrame:
    """Documents' pieces in order, as (doc_id, pieces array): the way back to whole documents."""
    return pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list(
        F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))
