"""A stream over the rows of Parquet files that knows its offsets: row numbers, to which it seeks.

Files get a place once, when they are found, those found together by name; a log in the folder `log` keeps
places and the rows of each row group. So the number of a row never changes, files may be added under any
name, and only the footers of new files are read. An offset is a row number; the rows of a batch are split
into tasks at row groups, and groups before the offset are not opened. `skip` seeks before the first row,
`stop` ends the stream before the row of that number. After each batch the log keeps the rows seen, so that
a query without the old checkpoint can go on there (`resume`).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a task should read at least, and files whose footers are read at once.
TASK_ROWS, FOOTERS = 1_000_000, 32


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


@dataclass
class Rows(InputPartition):
    """Rows `first` … `last` - 1 of one file, which lie in its row groups `groups`; `before` rows are in earlier groups."""

    file: str
    groups: list[int]
    before: int
    first: int
    last: int
    number: int  # of the row `first` in the stream


class RowLog:
    """Places of files and the rows of their row groups, kept as numbered JSON files that never change."""

    def __init__(self, path: str, log: str) -> None:
        self.files, self.source = filesystem(path)
        self.log_files, self.log = filesystem(log)
        self.entries: list[tuple[str, list[int]]] = []
        self.parts = 0
        self.log_files.create_dir(self.log, recursive=True)
        while self._info(f"{self.log}/{self.parts}.json"):
            self.entries += self._read(f"{self.log}/{self.parts}.json")
            self.parts += 1

    def _info(self, path: str) -> bool:
        return self.log_files.get_file_info(path).type == fs.FileType.File

    def _read(self, path: str):
        with self.log_files.open_input_stream(path) as f:
            return json.loads(f.read())

    def _write(self, path: str, content) -> None:
        """Under another name first, so that no half-written file is ever read."""
        with self.log_files.open_output_stream(f"{path}.new") as f:
            f.write(json.dumps(content).encode())
        self.log_files.move(f"{path}.new", path)

    def find_new(self) -> None:
        """Give new files a place. Files whose name begins with a dot or an underscore are not data."""
        info = self.files.get_file_info(self.source)
        if info.type == fs.FileType.File:
            found = [info]
        else:
            found = self.files.get_file_info(fs.FileSelector(self.source, allow_not_found=True, recursive=True))
        known = {file for file, _ in self.entries}
        names = sorted(i.path for i in found if i.type == fs.FileType.File and i.path not in known
                       and not i.base_name.startswith((".", "_")))
        if not names:
            return
        with ThreadPoolExecutor(FOOTERS) as pool:
            sizes = list(pool.map(self._group_rows, names))
        new = [(name, rows) for name, rows in zip(names, sizes)]
        self._write(f"{self.log}/{self.parts}.json", new)
        self.entries += new
        self.parts += 1

    def _group_rows(self, file: str) -> list[int]:
        with self.files.open_input_file(file) as f:
            footer = pq.read_metadata(f)
        return [footer.row_group(i).num_rows for i in range(footer.num_row_groups)]

    def total(self) -> int:
        return sum(sum(rows) for _, rows in self.entries)

    def seen(self) -> int:
        """Rows of committed batches."""
        path = f"{self.log}/seen"
        return self._read(path)["row"] if self._info(path) else 0

    def commit(self, row: int) -> None:
        self._write(f"{self.log}/seen", {"row": row})

    def ranges(self, start: int, end: int, task_rows: int) -> list[Rows]:
        """The rows `start` … `end` - 1 by file, cut at row groups once a part has enough rows."""
        out, number = [], 0
        for file, sizes in self.entries:
            groups, before, first = [], 0, 0
            at = 0
            for k, size in enumerate(sizes):
                lo, hi = max(start, number), min(end, number + size)
                if lo < hi:
                    if not groups:
                        before, first = at, at + lo - number
                    groups.append(k)
                    last = at + hi - number
                    if last - first >= task_rows:
                        out.append(Rows(file, groups, before, first, last, lo - (at + lo - number) + first))
                        groups = []
                at += size
                number += size
            if groups:
                out.append(Rows(file, groups, before, first, last, number - at + first))
            if number >= end:
                break
        return out


class RowReader(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema = schema
        self.path, self.log = options["path"], options["log"]
        self.skip, self.stop_row = int(options.get("skip", 0)), int(options["stop"]) if "stop" in options else None
        self.resume = options.get("resume", "false").lower() == "true"
        self.task_rows = int(options.get("taskrows", TASK_ROWS))
        self.number = options.get("rownumber")

    def initialOffset(self) -> dict:
        return {"row": max(self.skip, RowLog(self.path, self.log).seen() if self.resume else 0)}

    def latestOffset(self) -> dict:
        log = RowLog(self.path, self.log)
        log.find_new()
        end = log.total() if self.stop_row is None else min(log.total(), self.stop_row)
        # never before the first row, also if fewer rows are there than are to be skipped
        return {"row": max(end, self.initialOffset()["row"])}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        return RowLog(self.path, self.log).ranges(start["row"], end["row"], self.task_rows)

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(self.path)
        kind = to_arrow_schema(self.schema)
        names = [n for n in kind.names if n != self.number]
        with files.open_input_file(partition.file) as f:
            table = pq.ParquetFile(f)
            at, here = partition.before, [n for n in names if n in table.schema_arrow.names]
            for batch in table.iter_batches(row_groups=partition.groups, columns=here):
                lo, hi = max(partition.first - at, 0), min(partition.last - at, batch.num_rows)
                at += batch.num_rows
                if lo >= hi:
                    continue
                some = batch.slice(lo, hi - lo)
                first = partition.number + at - batch.num_rows + lo - partition.first
                columns = []
                for field in kind:
                    if field.name == self.number:
                        columns.append(pa.array(range(first, first + some.num_rows), field.type))
                    elif field.name in here:
                        columns.append(some.column(field.name).cast(field.type))
                    else:  # a file without the column
                        columns.append(pa.nulls(some.num_rows, field.type))
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([f.with_nullable(True) for f in kind]))

    def commit(self, end: dict) -> None:
        RowLog(self.path, self.log).commit(end["row"])


class RowSource(DataSource):
    """Options: path, log, skip, stop, resume, taskRows, rowNumber (a column of the schema that gets the row's number)."""

    @classmethod
    def name(cls) -> str:
        return "corpusloom_rows"

    def streamReader(self, schema: T.StructType) -> RowReader:
        return RowReader(schema, {k.lower(): v for k, v in self.options.items()})


def seeking_source(spark: SparkSession, path: str, schema: T.StructType | str, log: str, skip: int = 0,
                   limit: int | None = None, resume: bool = False, number: str | None = None,
                   task_rows: int = TASK_ROWS) -> DataFrame:
    """Stream of the Parquet files below `path`, from row `skip` on, at most `limit` rows.

    `log` is a folder of its own for one source; two queries that run at once need two. A restart goes on at
    the offset of its checkpoint; with `resume` a query without a checkpoint goes on after the rows that
    were committed before. Only the columns of `schema` are read, a missing one is null, and `number` adds
    the row's number as a column. A run with the trigger `availableNow` takes all there is as one batch.
    No files, or fewer rows than are to be skipped, give no rows; more files may follow later.
    """
    spark.dataSource.register(RowSource)
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kind = T.StructType(list(kind.fields))
    reader = spark.readStream.format(RowSource.name()).option("log", log).option("skip", skip) \
        .option("resume", resume).option("taskRows", task_rows)
    if limit is not None:
        reader = reader.option("stop", skip + limit)
    if number is not None:
        kind = kind.add(number, T.LongType())
        reader = reader.option("rowNumber", number)
    return reader.schema(kind).load(path)


def rows_seen(path: str, log: str) -> int:
    """Rows of the source that committed batches have read or skipped."""
    return RowLog(path, log).seen()
