"""Token counts: greedy longest-match word pieces, counted by an automaton.

The vocabulary is a byte trie. Each node has a failure link and the number of
pieces popped on the way to it, both computed once, so a word is counted in
one pass over its bytes without building pieces or going back: on a byte with
no edge, add the node's pops and follow its link. A node's ``tail`` is the
number of pieces that its own string still yields at the end of a word.

Words are runs of characters other than ASCII white space. The first piece of
a word carries the word mark (as pieces of a SentencePiece model do), later
pieces don't. A character that no piece holds counts as its bytes if the
vocabulary has byte pieces; otherwise the word is one unknown token.

Cases: null and empty texts have no words and no tokens; words and texts may
be of any length; repeated rows are counted one by one; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from notewise.llm import textbuf
from notewise.llm.staging import id_and_text

WORD_MARK = "▁"


class PieceAutomaton:
    """Counts greedy longest-match pieces of byte strings."""

    def __init__(self, pieces):
        """``pieces``: the vocabulary as byte strings."""
        self.edges: dict[int, int] = {}  # node * 256 + byte -> node
        whole = [False]
        for piece in pieces:
            node = 0
            for b in piece:
                node = self.edges.setdefault(node << 8 | b, len(whole))
                if node == len(whole):
                    whole.append(False)
            whole[node] = node != 0
        n = len(whole)
        children: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for key, node in self.edges.items():
            children[key >> 8].append((key & 255, node))
        self.link, self.pops = [-1] * n, [0] * n
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for b, v in children[u]:
                queue.append(v)
                if whole[v]:
                    self.link[v], self.pops[v] = 0, 1
                    continue
                z, popped = self.link[u], self.pops[u]
                while z >= 0 and (z << 8 | b) not in self.edges:
                    popped += self.pops[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[v], self.pops[v] = self.edges[z << 8 | b], popped
        self.tail = [0] * n
        for v in self._by_link_depth(n):
            up = self.link[v]
            self.tail[v] = -1 if up < 0 or self.tail[up] < 0 else self.pops[v] + self.tail[up]

    def _by_link_depth(self, n: int):
        """Nodes but the root, each after the node its link leads to (links lead to shorter strings)."""
        depth = [0] * n
        for key, node in self.edges.items():
            depth[node] = depth[key >> 8] + 1  # parents are numbered before their children
        return sorted(range(1, n), key=depth.__getitem__)

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 if it can't be segmented (unknown), 0 if empty."""
        edges, link, pops = self.edges, self.link, self.pops
        node = n = 0
        for b in word:
            while (nxt := edges.get(node << 8 | b)) is None:
                n += pops[node]
                node = link[node]
                if node < 0:
                    return 1
            node = nxt
        return 1 if self.tail[node] < 0 else n + self.tail[node]


def sentencepiece_vocabulary(path: str) -> list[bytes]:
    """The pieces of a SentencePiece model file; byte pieces as the bytes they stand for."""
    from sentencepiece import SentencePieceProcessor
    sp = SentencePieceProcessor(model_file=path)
    out = []
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            out.append(bytes([int(sp.id_to_piece(i)[1:-1], 16)]))
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            out.append(sp.id_to_piece(i).encode())
    return out


class WordCounts:
    """Counts per distinct word, remembered by hash (a bounded memory that starts afresh when full)."""

    SLOTS_LOG2 = 21

    def __init__(self, automaton: PieceAutomaton, memo: int = 1_000_000):
        self.automaton, self.limit = automaton, memo
        self.known: dict[int, int] = {}
        self.key = np.zeros(1 << self.SLOTS_LOG2, dtype=np.uint64)
        self.value = np.zeros(1 << self.SLOTS_LOG2, dtype=np.int64)
        self.mark = WORD_MARK.encode()

    def of(self, units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = textbuf.span_hashes(units, starts, ends)
        slot = (h >> np.uint64(64 - self.SLOTS_LOG2)).astype(np.int64)
        out = self.value[slot]
        miss = np.flatnonzero(self.key[slot] != h)
        if len(miss):
            uniq, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
            if len(self.known) > self.limit:
                self.known = {}
            raw, known, count = units.tobytes(), self.known, self.automaton.count
            found = np.empty(len(uniq), dtype=np.int64)
            for i, (k, j) in enumerate(zip(uniq.tolist(), miss[at].tolist())):
                n = known.get(k)
                if n is None:
                    n = known[k] = count(self.mark + raw[starts[j]:ends[j]])
                found[i] = n
            out[miss] = found[back]
            s = (uniq >> np.uint64(64 - self.SLOTS_LOG2)).astype(np.int64)
            self.key[s], self.value[s] = uniq, found
        return out


@lru_cache(maxsize=1)
def _counter(path: str) -> WordCounts:
    return WordCounts(PieceAutomaton(sentencepiece_vocabulary(path)))


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of each row; the vocabulary file must be at the same path on every worker."""

    def run(batches):
        counter = _counter(vocabulary_path)
        for b in batches:
            words, tokens = [], []
            for _, data, off in textbuf.slices(b.column(1)):
                units, starts, ends, first = textbuf.ascii_words(data, off, lower=False)
                upto = np.concatenate([[0], np.cumsum(counter.of(units, starts, ends))])
                words.append(np.diff(first))
                tokens.append(upto[first[1:]] - upto[first[:-1]])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
                                for x in (words, tokens))], names=["doc_id", "n_words", "n_tokens"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
