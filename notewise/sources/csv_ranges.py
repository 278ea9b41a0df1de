"""Quoted CSV with line breaks inside fields, read by many tasks a file.

Whether a line break ends a record depends on the quotes before it, so a file can't be cut blindly. A
quote (doubled ones count twice) turns "inside a field" on or off, hence the parity of the quotes before a
byte range says whether the range begins inside a field:

1. each range's lines are counted for quotes (JVM, one small row a range): how many lines hold an odd
   number of them, and the first and the last such line;
2. the running parity over that table tells for every range whether it begins and ends inside a field;
3. a range's own records are the lines between, joined where a field holds line breaks; this pass is
   narrow (no shuffle) and lazy;
4. the lines before a range's first odd line, if it begins inside, and those from its last odd line on,
   if it ends inside, belong to records that cross a border: they alone are shuffled and joined (a few
   lines a range), and written once.

Ranges are Spark's own file splits (``spark.sql.files.maxPartitionBytes``); the table of step 1 has a row
a split, so it is broadcast (a petabyte in 128 MB splits: 8 million rows of 40 bytes).

The file must be RFC 4180 in its quotes: a field with a quote in it is quoted, and the quote doubled. A
file whose quotes don't come in pairs is refused. Fields are parsed by Spark's own CSV parser, one record
at a time. Empty lines between records are left out, as Spark's reader does; a record's closing carriage
return is cut, those inside fields stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notewise.session import materialize, scratch_path, ship_package

QUOTE = '"'


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """file (hash of its path), start (of its split), id (ascending along a split), value of each physical line."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                      F.monotonically_increasing_id().alias("id"), "value")


def _quotes(value: str = "value"):
    return F.length(value) - F.length(F.replace(value, F.lit(QUOTE)))


def ranges_of(lines: DataFrame) -> DataFrame:
    """One row a split: file, start, base (its first line's id), first and last odd line, begins and ends inside a field."""
    odd = F.when(_quotes() % 2 == 1, F.col("id"))
    counted = lines.groupBy("file", "start").agg(F.min("id").alias("base"), F.min(odd).alias("first"), F.max(odd).alias("last"),
                                                 F.count(odd).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("file").orderBy("start"))
    out = counted.select("file", "start", "base", (F.col("first") - F.col("base")).alias("first"),
                         (F.col("last") - F.col("base")).alias("last"), ((so_far - F.col("n")) % 2 == 1).alias("begins"),
                         (so_far % 2 == 1).alias("ends"))
    return materialize(out)


def _own_records(batches):
    """Records that begin and end in one split; (record, whether it is the file's first)."""
    here, inside, skipping, opened, count = None, False, False, [], 0

    def joined(open_lines, lengths):
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), open_lines), "\n")

    for b in batches:
        file, start = b.column("file").to_numpy(), b.column("start").to_numpy()
        change = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
        for i, j in zip([0, *change], [*change, len(b)]):
            if i == j:
                continue
            if here != (file[i], start[i]):
                here, opened, count = (file[i], start[i]), [], 0
                inside = skipping = b.column("begins")[i].as_py()
            part = b.column("value").slice(i, j - i).cast(pa.string())
            odd = pc.count_substring(part, QUOTE).to_numpy(zero_copy_only=False) % 2
            state = (int(inside) + np.cumsum(odd)) % 2
            ends = np.flatnonzero(state == 0)
            inside = bool(state[-1])
            if not len(ends):
                if not skipping:
                    opened.append(part)
                continue
            first = 0
            if skipping:  # the rest of an earlier split's record
                first, skipping, ends = ends[0] + 1, False, ends[1:]
            whole = part.slice(first, (ends[-1] + 1 if len(ends) else first) - first)
            if len(ends):
                sizes = np.diff(np.concatenate([[first - 1], ends]))
                if opened:
                    sizes[0] += sum(map(len, opened))
                    whole = pa.concat_arrays([*opened, whole])
                    opened = []
                record = joined(whole, sizes)
                heads = np.zeros(len(record), dtype=bool)
                heads[0] = start[i] == 0 and count == 0 and first == 0
                count += len(record)
                yield pa.RecordBatch.from_arrays([record, pa.array(heads)], names=["record", "heads"])
            after = (ends[-1] + 1) if len(ends) else first
            if after < len(part):
                opened.append(part.slice(after))


def _border_records(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Records that cross a split's end, from the few lines at the borders."""
    near = lines.join(F.broadcast(ranges.where("begins or ends")), ["file", "start"])
    row = F.col("id") - F.col("base")
    head = F.col("begins") & (F.col("first").isNull() | (row <= F.col("first")))
    tail = F.col("ends") & (row >= F.col("last"))
    opens = tail & F.col("last").isNotNull()
    near = near.where(head | tail).select("file", "start", row.alias("row"), "value", opens.alias("opens"),
                                          (opens & (F.col("start") == 0) & (row == 0)).alias("heads"))
    # the split in which a line's record begins: its own, or the last one before it that ends inside and has an odd line
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("ends") & F.col("last").isNotNull(), F.col("start")), ignorenulls=True).over(order)
    earlier = materialize(ranges.select("file", "start", before.alias("from")))
    placed = near.join(F.broadcast(earlier), ["file", "start"]).withColumn(
        "from", F.when(F.col("opens"), F.col("start")).otherwise(F.col("from")))
    grouped = placed.groupBy("file", "from").agg(
        F.sort_array(F.collect_list(F.struct("start", "row", "value"))).alias("lines"), F.max("heads").alias("heads"))
    return grouped.select(F.array_join(F.col("lines.value"), "\n").alias("record"), "heads")


def records_of(spark: SparkSession, path: str) -> DataFrame:
    """record, heads (the file's first one) of each CSV record of the files at ``path``, header records included."""
    ship_package(spark)
    lines = lines_of(spark, path)
    ranges = ranges_of(lines)
    last = Window.partitionBy("file").orderBy(F.desc("start"))
    if ranges.withColumn("n", F.row_number().over(last)).where("n = 1 and ends").limit(1).count():
        raise ValueError(f"the quotes in {path} don't come in pairs")
    begins = lines.join(F.broadcast(ranges.select("file", "start", "begins")), ["file", "start"])
    own = begins.select("file", "start", "begins", "value").mapInArrow(_own_records, "record string, heads boolean")
    border = scratch_path(spark, "csv-border-records")
    _border_records(lines, ranges).write.parquet(border)
    out = own.unionByName(spark.read.schema(own.schema).parquet(border))
    return out.withColumn("record", F.regexp_replace("record", "\\r$", "")).where("record <> ''")


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """The header's names; only the head of a file is read."""
    head = spark.read.option("header", True).option("multiLine", True).option("quote", QUOTE).option("escape", QUOTE).csv(path)
    return [c.rstrip("\r") for c in head.columns]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns of the CSV files at ``path`` as strings, named by the first file's header."""
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns_of(spark, path))
    options = {"quote": QUOTE, "escape": QUOTE, "multiLine": "true"}
    parsed = records_of(spark, path).where(~F.col("heads")).select(F.from_csv("record", schema, options).alias("r"))
    return parsed.select("r.*")
