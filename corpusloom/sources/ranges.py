"""CSV records read by many tasks, also when cells hold line breaks.

Lines are read in byte ranges, which any file can be cut into. Whether a range begins inside a quoted
cell is not known in it, so each range is read as if from both states and gives a function: state at its
begin to state at its end. Composed in the order of the ranges (four functions are possible, so that a
running sum does it) these tell every range how it begins. A second pass then joins lines to records;
a record that crosses ranges is put together from the pieces of all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from corpusloom.operators.scale import collect_small, rows_to_local
from corpusloom.session import stable

#: A task hands on its records when it holds so many.
HELD = 10_000


def inside_after(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether the end of a line lies inside a quoted cell, if its begin does or does not.

    A cell is quoted if a quote is its first character; in it two quotes stand for one. After the closing
    quote, and in other cells, quotes are characters like any other.
    """
    at = 0
    while True:
        if not inside:
            if line[at:at + 1] == '"':
                inside, at = True, at + 1
            else:
                at = line.find(sep, at) + len(sep)
                if at < len(sep):
                    return False
                continue
        while True:
            at = line.find('"', at) + 1
            if not at:
                return True
            if line[at:at + 1] != '"':
                break
            at += 1
        inside = False
        at = line.find(sep, at) + len(sep)
        if at < len(sep):
            return False


def _runs(batches) -> Iterator[tuple[pa.RecordBatch, tuple]]:
    """Slices of batches that lie in one range, with (path, start)."""
    for batch in batches:
        path, start = batch.column("path"), batch.column("start").to_numpy(zero_copy_only=False)
        if not batch.num_rows:
            continue
        names = path.dictionary_encode()
        change = np.flatnonzero((np.diff(names.indices.to_numpy()) != 0) | (np.diff(start) != 0)) + 1
        for a, z in zip([0, *change], [*change, batch.num_rows]):
            yield batch.slice(a, z - a), (path[int(a)].as_py(), int(start[a]))


def _quoted(values: pa.Array) -> np.ndarray:
    return np.flatnonzero(np.array(pc.match_substring(values, '"').fill_null(False).to_numpy(zero_copy_only=False)))


def transfers(sep: str) -> Callable:
    """Per range the state at its end for both states at its begin, and whether, if it begins inside quotes,
    any of its lines ends outside."""
    def run(batches):
        now, ends, left = None, [False, True], False
        done = []
        for piece, where in _runs(batches):
            if where != now:
                if now is not None:
                    done.append((*now, *ends, left))
                now, ends, left = where, [False, True], False
            values = piece.column("value")
            for i in _quoted(values):
                line = values[int(i)].as_py()
                ends = [inside_after(line, e, sep) for e in ends] if ends[0] != ends[1] else [inside_after(line, ends[0], sep)] * 2
                left = left or not ends[1]
        if now is not None:
            done.append((*now, *ends, left))
        yield _batch(done, ("path", "start", "from_outside", "from_inside", "leaves"),
                     (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()))
    return run


TRANSFERS = "path string, start long, from_outside boolean, from_inside boolean, leaves boolean"


def _batch(rows: list, names: tuple, kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))


def joiner(sep: str) -> Callable:
    """Whole records, and the pieces of records that cross ranges, with the range in which the record began.
    The first record of a file is its head."""
    def run(batches):
        now, inside, held, opened, head, owner = None, False, [], False, False, -1
        out: list = []

        def give(record: str, whole: bool):
            nonlocal head
            mine = whole or opened  # the record began in this range
            out.append((*now, now[1] if mine else owner, head and mine, whole, record))
            head = head and (not mine or not record.strip())

        for piece, where in _runs(batches):
            if where != now:
                if held:
                    give("\n".join(held), False)
                now, held, opened, head = where, [], False, where[1] == 0
                inside, owner = piece.column("inside")[0].as_py(), piece.column("owner")[0].as_py()
                if inside is None:
                    raise ValueError(f"The ranges of {where[0]} are not those that were looked at first.")
            values = piece.column("value")
            at = 0
            for i in [*_quoted(values).tolist(), len(values)]:
                plain = values.slice(at, i - at).to_pylist()  # lines without quotes leave the state as it is
                if inside:
                    held += plain
                else:
                    for line in plain:
                        give(line, True)
                if i == len(values):
                    break
                line, at = values[i].as_py(), i + 1
                opened = opened or not inside
                held.append(line)
                inside = inside_after(line, inside, sep)
                if not inside:
                    give("\n".join(held), opened)
                    held, opened = [], False
            if len(out) > HELD:
                yield _batch(out, *_RECORD)
                out = []
        if held:
            give("\n".join(held), False)
        yield _batch(out, *_RECORD)
    return run


_RECORD = (("path", "start", "owner", "head", "whole", "record"),
           (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()))
RECORDS = "path string, start long, owner long, head boolean, whole boolean, record string"


def line_ranges(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, start, value): lines, ended by \\n alone, with the range of the file in which they were read."""
    lines = spark.read.options(lineSep="\n", **options).text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                        F.make_valid_utf8("value").alias("value"))


def begin_states(lines: DataFrame, sep: str) -> DataFrame:
    """Per range: whether it begins and ends inside quotes, and the range in which the record that is open
    at its begin began (owner)."""
    found = lines.mapInArrow(transfers(sep), TRANSFERS)
    order = Window.partitionBy("path").orderBy("start")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    # a range leaves the state as it is, turns it round, or sets it; after the last that sets it, turns count
    sets = F.col("from_outside") == F.col("from_inside")
    turns = F.col("from_outside") & ~F.col("from_inside")
    found = found.withColumn("turned", F.sum(turns.cast("long")).over(order))
    found = found.withColumns({
        "last": F.last(F.when(sets, F.struct(F.col("from_outside").alias("state"), "turned")), ignorenulls=True).over(earlier),
        "so_far": F.coalesce(F.lag("turned").over(order), F.lit(0))})
    odd = (F.col("so_far") - F.coalesce("last.turned", F.lit(0))) % 2 == 1
    found = found.withColumn("inside", F.coalesce("last.state", F.lit(False)) != odd)
    begun = F.when(~F.col("inside") | F.col("leaves"), F.col("start"))
    return found.select("path", "start", "inside", F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside")).alias("after"),
                        F.coalesce(F.last(begun, ignorenulls=True).over(earlier), F.lit(-1)).alias("owner"),
                        F.lead("start").over(order).isNull().alias("final"))


def csv_records(lines: DataFrame, sep: str = ",", balanced: bool = True) -> DataFrame:
    """(path, head, record): the records of CSV files from their lines; blank lines are no records, and
    line ends are \\n.

    A file that ends inside quotes raises if `balanced`; otherwise its rest is one record. States are one
    row per range: broadcast if they are few, else joined, and the lines sorted back into their order.
    """
    spark = lines.sparkSession
    states = begin_states(lines, sep)
    rows = collect_small(states)
    if rows is None:
        states = stable(states)
    open_ = states.filter("final AND after").select("path").limit(3).collect() if rows is None else \
        [r for r in rows if r.final and r.after][:3]
    if balanced and open_:
        raise ValueError(f"Quotes are not balanced in {', '.join(r.path for r in open_)}.")

    def joined(wanted: str | None, how: str) -> DataFrame:
        if rows is None:
            side = states.filter(wanted) if wanted else states
            numbered = lines.withColumn("line", F.monotonically_increasing_id()).join(side, ["path", "start"], how)
            return numbered.repartition("path", "start").sortWithinPartitions("path", "start", "line")
        kept = [r for r in rows if not wanted or r.inside or r.after]
        return lines.join(F.broadcast(rows_to_local(spark, kept, states.schema)), ["path", "start"], how)

    blank = F.trim("record", F.lit(" \r\t")) == ""
    out = joined(None, "left").mapInArrow(joiner(sep), RECORDS).filter("whole").select("path", "head", "record")
    crossing = rows is None or any(r.inside or r.after for r in rows)
    if crossing:
        parts = joined("inside OR after", "inner").mapInArrow(joiner(sep), RECORDS).filter("NOT whole")
        texts = F.transform(F.array_sort(F.collect_list(F.struct("start", "record"))), lambda x: x["record"])
        out = out.unionByName(parts.groupBy("path", "owner").agg(
            F.bool_or("head").alias("head"), F.array_join(texts, "\n").alias("record")).drop("owner"))
    return out.filter(~blank).withColumn("record", F.replace(F.rtrim("record", F.lit("\r")), F.lit("\r\n"), F.lit("\n")))


def _ddl(fields) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields)


#: Types that a column of text may be given, the narrowest first, and the pattern its values must have.
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^NaN$|^-?Inf$"
TYPES = (("int", r"^[+-]?\d+$"), ("bigint", r"^[+-]?\d+$"), ("double", _NUMBER), ("date", r"^\d{4}-\d\d-\d\d$"),
         ("timestamp", r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d.*)?$"), ("boolean", r"^(?i)(true|false)$"))


def _value(column: Column, kind: str) -> Column:
    if kind == "double":
        column = F.regexp_replace(column, "^(-?)Inf$", "$1Infinity")
    return column.try_cast(kind)


def infer_types(rows: DataFrame) -> T.StructType:
    """The narrowest type that all values of each text column have, in one aggregate."""
    facts = rows.agg(*[F.struct(F.count(F.col(f"`{c}`")).alias("n"), *[
        F.count_if(F.col(f"`{c}`").rlike(pattern) & _value(F.col(f"`{c}`"), kind).isNotNull()).alias(kind) for kind, pattern in TYPES
    ]).alias(f"c{i}") for i, c in enumerate(rows.columns)]).first()
    kinds = [next((kind for kind, _ in TYPES if f["n"] and f[kind] == f["n"]), "string") for f in facts]
    return T.StructType([T.StructField(c, T._parse_datatype_string(k)) for c, k in zip(rows.columns, kinds)])


def read_csv(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | str | None = None) -> DataFrame:
    """The rows of CSV files with a head line, in as many tasks as their bytes allow.

    Cells may hold line breaks; quotes in cells are doubled. Without a schema the narrowest of int, bigint,
    double, date, timestamp and boolean is taken that all values of a column have, else string; an empty cell
    is null. Files are read once to find how ranges begin, once to infer types, and once for the rows (ranges
    in which a record crosses the border twice).
    """
    options = {"sep": sep, "escape": '"', "multiLine": "true"}
    records = csv_records(line_ranges(spark, path), sep).filter(~F.col("head"))
    if schema is None:
        names = spark.read.options(header=True, **options).csv(path).columns
        texts = T.StructType([T.StructField(c, T.StringType()) for c in names])
        rows = records.select(F.from_csv("record", _ddl(texts), options).alias("r")).select("r.*")
        fields = infer_types(rows).fields
        return rows.select(*[F.col(f"`{f.name}`") if f.dataType == T.StringType() else
                             _value(F.col(f"`{f.name}`"), f.dataType.simpleString()).alias(f.name) for f in fields])
    fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
    return records.select(F.from_csv("record", _ddl(fields), options).alias("r")).select("r.*")
