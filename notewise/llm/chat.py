"""Chat formatting: heterogeneous prompt, instruction and message layouts to one template.

A layout is declared as a set of nested field paths plus a mapping to
canonical turns (role, text). The hash of a record's field paths, cut down to
the paths that some layout names (so extra fields don't matter), selects its
mapping: once for a typed table (``turns_of_table``), row by row for a column
of JSON records (``turns_of_json``).

The template writes a turn as ``<|turn|>role<|text|>text<|end|>``. In roles
and texts a backslash is doubled and one is put inside every control string of
this and other usual templates, so no text can open or close a turn; reading
back undoes it exactly. ``loss_spans`` are the (start, length) code point
ranges of the assistants' texts. Only DataFrame functions are used.

A conversation becomes one string, so its rows meet in one task; its size is
that of the result row.

Cases: null text and null role are empty; a record whose layout is unknown has
a null layout and no turns; no turns format as the empty string; repeated turn
numbers are ordered by role, then text; a null conversation id is a
conversation of its own; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What follows < or [ in a control string of a usual chat template (fixed values).
CONTROL = r"([<\[])(\||/?s>|/?INST\]|/?SYS>)"


@dataclass(frozen=True)
class Layout:
    """``listed``: (field holding a list of messages, role field, text field).
    ``fields``: (role, field, further field appended after a blank line or None), in order of turns."""

    name: str
    paths: tuple[str, ...]
    listed: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str, str | None], ...] = ()
    order: str | None = None


LAYOUTS = (
    Layout("turn rows", ("turns[].turn", "turns[].role", "turns[].text"), ("turns", "role", "text"), order="turn"),
    Layout("messages", ("messages[].role", "messages[].content"), ("messages", "role", "content")),
    Layout("from-value", ("conversations[].from", "conversations[].value"), ("conversations", "from", "value")),
    Layout("prompt", ("prompt", "completion"), fields=(("user", "prompt", None), ("assistant", "completion", None))),
    Layout("prompt-response", ("prompt", "response"), fields=(("user", "prompt", None), ("assistant", "response", None))),
    Layout("system-prompt", ("system", "prompt", "response"),
           fields=(("system", "system", None), ("user", "prompt", None), ("assistant", "response", None))),
    Layout("instruction", ("instruction", "output"),
           fields=(("user", "instruction", None), ("assistant", "output", None))),
    Layout("instruction-input", ("instruction", "input", "output"),
           fields=(("user", "instruction", "input"), ("assistant", "output", None))),
)
#: Role names of the from-value layout, and what they are called here.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LISTS = tuple(sorted({lay.listed[0] for lay in LAYOUTS if lay.listed}))
KNOWN = tuple(sorted({p for lay in LAYOUTS for p in lay.paths}))
TURNS = "array<struct<role:string,text:string>>"


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema: a.b for structs, a[] for lists."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}".lstrip("."))]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(paths: Column) -> Column:
    """Hash of the known ones of an array of field paths, in order."""
    known = F.array(*[F.lit(p) for p in KNOWN])
    return F.xxhash64(F.concat_ws(",", F.array_sort(F.array_intersect(paths, known))))


def _literal(layout: Layout) -> Column:
    return fingerprint(F.array(*[F.lit(p) for p in layout.paths]))


def _role(role: Column) -> Column:
    out = role
    for name, ours in ROLES.items():
        out = F.when(role == name, ours).otherwise(out)
    return F.coalesce(out, F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.cast("string").alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _mapped(layout: Layout, items, field) -> Column:
    """Canonical turns; items(name) is a list column, field(name) a text column."""
    if layout.listed:
        name, role, text = layout.listed
        named = _role if role == "from" else lambda c: F.coalesce(c, F.lit(""))
        return F.transform(items(name), lambda m: _turn(named(m[role]), m[text]))
    turns = []
    for role, name, more in layout.fields:
        text = F.coalesce(field(name), F.lit(""))
        if more:
            extra = F.coalesce(field(more), F.lit(""))
            text = F.concat(text, F.when(extra != "", F.concat(F.lit("\n\n"), extra)).otherwise(""))
        turns.append(_turn(F.lit(role), text))
    return F.array(*turns)


def turns_of_table(df: DataFrame, id_col: str) -> DataFrame:
    """(conv_id, layout, turns) of a typed table; its schema's fingerprint selects the mapping."""
    paths = sorted(set(field_paths(T.StructType([f for f in df.schema.fields if f.name != id_col]))) & set(KNOWN))
    layout = next((lay for lay in LAYOUTS if sorted(lay.paths) == paths), None)
    ident = F.col(id_col).alias("conv_id")
    if layout is None:
        return df.select(ident, F.lit(None).cast("string").alias("layout"), F.array().cast(TURNS).alias("turns"))
    items = lambda name: F.sort_array(F.col(name)) if layout.order else F.col(name)
    turns = F.coalesce(_mapped(layout, items, F.col), F.array().cast(TURNS))
    chosen = F.when(fingerprint(F.array(*[F.lit(p) for p in paths])) == _literal(layout), layout.name)
    return df.select(ident, chosen.alias("layout"), turns.alias("turns"))


def turns_of_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(conv_id, layout, turns) of a column of JSON records of any of the layouts, mixed."""
    record = F.from_json(F.col(json_col), "map<string,string>")
    rows = df.select(F.col(id_col).alias("conv_id"), F.coalesce(record, F.create_map().cast("map<string,string>")).alias("_r"))
    lists = {n: F.from_json(F.col("_r")[n], "array<map<string,string>>") for n in LISTS}
    rows = rows.withColumns({f"_l_{n}": c for n, c in lists.items()})
    paths = F.map_keys("_r")
    for n in LISTS:
        inner = F.array_distinct(F.flatten(F.transform(F.col(f"_l_{n}"), lambda m: F.map_keys(m))))
        paths = F.concat(paths, F.coalesce(F.transform(inner, _below(n)), F.array().cast("array<string>")))
    rows = rows.withColumn("_f", fingerprint(paths))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for lay in LAYOUTS:
        hit = F.col("_f") == _literal(lay)
        items = lambda n, lay=lay: (F.array_sort(F.col(f"_l_{n}"), _by_number(lay.order)) if lay.order
                                    else F.col(f"_l_{n}"))
        layout = F.when(hit, lay.name).otherwise(layout)
        turns = F.when(hit, _mapped(lay, items, lambda n: F.col("_r")[n])).otherwise(turns)
    return rows.select("conv_id", layout.alias("layout"), F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))


def _below(name: str):
    """A field of a list's elements to its path."""
    return lambda key: F.concat(F.lit(f"{name}[]."), key)


def _by_number(name: str):
    def compare(a, b):
        x, y = F.coalesce(a[name].cast("double"), F.lit(0.0)), F.coalesce(b[name].cast("double"), F.lit(0.0))
        return F.when(x < y, -1).when(x > y, 1).otherwise(0)
    return compare


def rows_to_records(df: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text") -> DataFrame:
    """A table with a row per turn as one record per conversation."""
    rows = df.select(F.col(id_col).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.collect_list("t").alias("turns"))


def escape(text: Column) -> Column:
    """Reversible: backslashes double, and one goes inside every control string."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.regexp_replace(doubled, CONTROL, r"$1\\$2"), F.lit("|>"), F.lit("|\\>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(df: DataFrame) -> DataFrame:
    """(conv_id, turns) to (conv_id, formatted, loss_spans)."""
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("body"),
        (t["role"] == "assistant").alias("learn")))
    spans = F.aggregate(
        "parts", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END)).alias("at"),
            F.when(p["learn"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length")))))
            .otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return df.withColumn("parts", parts).select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        spans.alias("loss_spans"))


def read_back(df: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) to (conv_id, turns, loss_text): parses the formatted strings.

    A turn's text belongs to the loss if a span begins where it begins; the
    start is counted from the lengths of what precedes it."""
    chunks = F.expr(r"slice(split(formatted, '<\\|turn\\|>'), 2, size(split(formatted, '<\\|turn\\|>')))")
    raw = F.transform("chunks", lambda c: F.struct(
        F.substring_index(c, TEXT, 1).alias("role"),
        F.substring_index(F.substring_index(c, TEXT, -1), END, 1).alias("text")))
    starts = F.aggregate(
        "raw", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, t: F.struct(
            (acc["at"] + len(TURN + TEXT + END) + F.length(t["role"]) + F.length(t["text"])).alias("at"),
            F.concat(acc["starts"], F.array(acc["at"] + len(TURN + TEXT) + F.length(t["role"]))).alias("starts")),
        lambda acc: acc["starts"])
    learned = F.zip_with("raw", "starts", lambda t, s: F.struct(
        t["text"].alias("text"), F.array_contains(F.col("loss_spans"), F.struct(
            s.alias("start"), F.length(t["text"]).alias("length"))).alias("learn")))
    return (df.withColumn("chunks", chunks).withColumn("raw", raw).withColumn("starts", starts).select(
        "conv_id",
        F.transform("raw", lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))).alias("turns"),
        F.array_join(F.transform(F.filter(learned, lambda t: t["learn"]), lambda t: unescape(t["text"])), "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars")))
