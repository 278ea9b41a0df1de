"""Fill-in-middle transformation by displacement scatter.

A document's text is cut twice and its parts change places: ``<P>`` prefix ``<S>`` suffix ``<M>``
middle (psm) or ``<S>`` suffix ``<P>`` prefix ``<M>`` middle (spm). A batch of texts is one array of
bytes. Scanning the lead bytes turns cuts in code points into cuts in bytes; each part of a text moves
as a whole, so its displacement is written once, as the difference from the part before, and a
cumulative sum gives every byte of the batch its shift; one scatter builds all outputs, and a second one
the control strings. Restoring scans the outputs for the control strings, builds the displacements of
the way back from their places alone and gathers.

Which documents are changed, and where they are cut, follows from the SHA-256 of ``1:`` and the decimal
doc_id, so it doesn't depend on partitions: four 8-digit groups h1 to h4, read as unsigned integers; the
prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) of the n code points, the middle after the
larger; a text stays plain where h3 % 100 >= 100 * ``rate``, and is spm where h4 % 100 < 100 * ``spm``.

Cases: null text is empty; a text that is empty or holds a control string stays plain; a null doc_id
counts as an empty string; very long texts make a slice of their own (a text is held three times in a
task); repeated rows give repeated rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.llm.staging import id_and_text
from notewise.llm.textbuf import slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Parts (0 prefix, 1 middle, 2 suffix) and control strings in the order of the output.
ORDERS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
_MARK = 3


def with_cuts(docs: DataFrame, rate: float = 0.9, spm: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars (null where the form is plain)."""
    rows = id_and_text(docs, id_col, text_col)
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = rows.withColumns({"n": F.length("text").cast("long"), "digest": digest})
    h = [F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    has_mark = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        has_mark = has_mark | F.contains("text", F.lit(m.decode()))
    form = (F.when((F.col("n") == 0) | has_mark | (h[2] % 100 >= round(100 * rate)), "plain")
            .when(h[3] % 100 < round(100 * spm), "spm").otherwise("psm"))
    a, b = (h[i] % (F.col("n") + 1) for i in (0, 1))
    rows = rows.select("doc_id", "text", "n", form.alias("form"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    cut = F.col("form") != "plain"
    return rows.select("doc_id", "text", "n", "form", F.when(cut, F.col("a")).alias("prefix_chars"),
                       F.when(cut, F.col("b") - F.col("a")).alias("middle_chars"))


def displaced(starts: np.ndarray, shifts: np.ndarray, n: int) -> np.ndarray:
    """The shift of each of n units: shifts[i] from starts[i] on (starts ascending; of equal ones the last holds)."""
    diff = np.zeros(n + 1, dtype=np.int64)
    np.add.at(diff, starts, np.diff(shifts, prepend=0))
    return np.cumsum(diff)[:n]


def scattered(data: np.ndarray, off: np.ndarray, form: np.ndarray, first: np.ndarray, second: np.ndarray):
    """(bytes, offsets) of the outputs of texts data[off[r]:off[r + 1]].

    form: 0 plain, 1 psm, 2 spm; first, second: the cuts in code points from the text's begin."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # code point -> byte
    before = np.searchsorted(lead, off)  # code points before each text
    byte = np.append(lead, len(data))
    one, two = byte[before[:-1] + first], byte[before[:-1] + second]
    plain = form == 0
    one, two = np.where(plain, off[1:], one), np.where(plain, off[1:], two)
    size = np.diff(off)
    out_off = np.concatenate([[0], np.cumsum(size + 3 * _MARK * ~plain)])
    cuts = np.stack([off[:-1], one, two], axis=1)  # begins of prefix, middle, suffix
    lengths = np.stack([one - off[:-1], two - one, off[1:] - two], axis=1)
    places = np.repeat(out_off[:-1, None], 3, axis=1)
    out = np.empty(out_off[-1], dtype=np.uint8)
    for number, order in enumerate(ORDERS.values(), 1):
        rows = np.flatnonzero(form == number)
        at = out_off[rows]
        for mark, part in order:
            for i, c in enumerate(mark):
                out[at + i] = c
            places[rows, part] = at + _MARK
            at = at + _MARK + lengths[rows, part]
    shift = displaced(cuts.ravel(), (places - cuts).ravel(), len(data))
    out[np.arange(len(data)) + shift] = data
    return out, out_off


def gathered(data: np.ndarray, off: np.ndarray, form: np.ndarray):
    """(bytes, offsets) of the texts behind outputs data[off[r]:off[r + 1]], from output and form alone."""
    rows = np.flatnonzero(form)
    size = np.diff(off) - 3 * _MARK * (form != 0)
    text_off = np.concatenate([[0], np.cumsum(size)])
    n = int(text_off[-1])
    # control strings: the first of each kind that the form's order calls for
    at = {}
    open_ = np.flatnonzero(data == PREFIX[0])
    open_ = open_[open_ + 2 < len(data)]
    open_ = open_[data[open_ + 2] == PREFIX[2]]
    owner = np.searchsorted(off, open_, side="right") - 1
    inside = (form[owner] != 0) & (open_ + 2 < off[owner + 1]) if len(open_) else np.zeros(0, bool)
    open_, owner = open_[inside], owner[inside]
    for mark in (PREFIX, SUFFIX, MIDDLE):
        hit = data[open_ + 1] == mark[1]
        seen, first = np.unique(owner[hit], return_index=True)
        if not np.array_equal(seen, rows):
            raise ValueError(f"an output lacks {mark.decode()}")
        at[mark] = open_[hit][first]
    begins = np.repeat(text_off[:-1, None], 3, axis=1)  # in the text: prefix, middle, suffix
    from_ = np.repeat(off[:-1, None], 3, axis=1)  # in the output
    for number, order in enumerate(ORDERS.values(), 1):
        mine = form[rows] == number
        r, ends = rows[mine], [at[m][mine] for m, _ in order[1:]] + [off[rows[mine] + 1]]
        lengths = np.zeros((len(r), 3), dtype=np.int64)
        for (mark, part), end in zip(order, ends):
            from_[r, part] = at[mark][mine] + _MARK
            lengths[:, part] = end - from_[r, part]
        begins[r, 1] = begins[r, 0] + lengths[:, 0]
        begins[r, 2] = begins[r, 1] + lengths[:, 1]
    shift = displaced(begins.ravel(), (from_ - begins).ravel(), n)
    return data[np.arange(n) + shift], text_off


_FORMS = {"plain": 0, **{f: i for i, f in enumerate(ORDERS, 1)}}


def _strings(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """A string column without a copy row by row."""
    col = pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)])
    return col.cast(pa.large_string()).cast(pa.string())


def _rebuilt(batches, kind: str):
    """Batches with their column ``text`` or ``output`` replaced; a batch for each slice."""
    for b in batches:
        names = b.schema.names
        source = "text" if kind == "output" else "output"
        form_of = np.array([_FORMS[f] for f in b.column("form").to_pylist()], dtype=np.int8)
        for i, data, off in slices(b.column(source)):
            part = b.slice(i, len(off) - 1)
            form = form_of[i:i + len(off) - 1]
            if kind == "output":
                first = part.column("prefix_chars").fill_null(0).to_numpy(zero_copy_only=False)
                second = first + part.column("middle_chars").fill_null(0).to_numpy(zero_copy_only=False)
                made, made_off = scattered(data, off, form, first, second)
            else:
                made, made_off = gathered(data, off, form)
            at = names.index(source)
            cols = [_strings(made, made_off) if k == at else part.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=[kind if k == at else x for k, x in enumerate(names)])


def transform(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, output, n, form, prefix_chars, middle_chars of each document (settings of :func:`with_cuts`)."""
    schema = "doc_id long, output string, n long, form string, prefix_chars long, middle_chars long"
    return with_cuts(docs, **settings).mapInArrow(lambda batches: _rebuilt(batches, "output"), schema)


def restore(made: DataFrame) -> DataFrame:
    """``made`` (output, form and any other columns) with the texts as ``text``, rebuilt from output and form alone."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" if f.name != "output" else "text string" for f in made.schema)
    return made.mapInArrow(lambda batches: _rebuilt(batches, "text"), schema)
