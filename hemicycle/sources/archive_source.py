"""Archives as a Spark data source: ``read_transcripts(spark, folder)``.

Planning lists files and reads year and issue number off their names. Tests on
``source_file``, ``file_year``, ``issue_year`` and ``issue_number`` (``where``) are applied there,
so a file that they exclude is never opened. With ``files`` (a Parquet folder with the columns
path and length, as an anti-join against a stored table writes it) only those are read, at any
number of stored issues. One partition is a group of files of about equal bytes.

``where`` is given to the reader and not left to Spark's filter push-down: Spark 4.1 keeps the
filters that it pushed into a Python source with the loaded relation, so a second query of the
same DataFrame would plan with the filters of the first.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from hemicycle.schemas import RUNS
from hemicycle.sources import storage, transcripts

ARCHIVE_PATTERN = "*.taz"
GROUP_BYTES = 16 << 20
ROWS_PER_BATCH = 2000
FILE_COLUMNS = ("source_file", "file_year", "issue_year", "issue_number")


def name_columns(path: str) -> dict[str, object]:
    """What a path says: the rules of ``functions.files``, for one string."""
    stem = re.sub(r"(?<=.)\.[^.]*$", "", path.rsplit("/", 1)[-1], flags=re.S)
    folder = re.search(r"(?:^|/)(\d{4})(?=/|$)", path, re.A)
    named = re.match(r"^.{3}(\d{4}).{2}", stem, re.A)
    number = re.match(r"^.{7}(\d+)", stem, re.A)
    year = stem[3:7].strip()
    small = number and int(number.group(1)) < 1 << 31
    return {
        "source_file": path,
        "file_year": folder.group(1) if folder else named.group(1) if named else "unknown",
        "issue_year": int(year) if re.fullmatch(r"[+-]?\d+", year, re.A) else None,
        "issue_number": int(number.group(1)) if small else None,
    }


COMPARE = {
    "=": operator.eq, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "!=": operator.ne,
    "in": lambda a, b: a in b, "not in": lambda a, b: a not in b, "starts with": lambda a, b: a.startswith(b),
}
Test = tuple[str, str, object]


def holds(tests: list[Test], columns: dict[str, object]) -> bool:
    """All (column, comparison, value) tests are true; null compares as false, as in SQL."""
    return all(columns[c] is not None and COMPARE[how](columns[c], value) for c, how, value in tests)


class FileGroup(ds.InputPartition):
    def __init__(self, paths: tuple[str, ...]):
        self.paths = paths


def grouped(files: list[tuple[str, int]], group_bytes: int, tasks: int) -> list[FileGroup]:
    """Files in groups of about ``group_bytes``, smaller ones if there would be under ``tasks``."""
    total = sum(size for _, size in files)
    most = max(1, min(group_bytes, -(-total // max(1, tasks))))
    groups, now, held = [], [], 0
    for path, size in sorted(files):
        if now and held + size > most:
            groups.append(FileGroup(tuple(now)))
            now, held = [], 0
        now.append(path)
        held += size
    return [*groups, FileGroup(tuple(now))] if now else groups


class TranscriptReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.tests = json.loads(options.get("where", "[]"))

    def listed(self) -> Iterator[tuple[str, int]]:
        chosen = self.options.get("files")
        if chosen is None:
            yield from storage.files_below(self.options["path"], self.options.get("pattern", ARCHIVE_PATTERN))
            return
        system, inside = storage.resolve(chosen)
        for batch in pads.dataset(inside, format="parquet", filesystem=system).to_batches(columns=["path", "length"]):
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

    def partitions(self) -> list[FileGroup]:
        files = [(path, size or 0) for path, size in self.listed()
                 if holds(self.tests, name_columns(path))]
        return grouped(files, int(self.options.get("groupbytes", GROUP_BYTES)), int(self.options.get("tasks", 1)))

    def read(self, partition: FileGroup | None) -> Iterator[pa.RecordBatch]:
        """Rows of one group; without any file, Spark asks once with no group."""
        keep_all = self.options.get("keepall", "false").lower() == "true"
        files = ((path, lambda path=path: storage.open_file(path)) for path in (partition.paths if partition else ()))
        yield from batches_of(files, keep_all)


def batches_of(files: Iterator[tuple[str, object]], keep_all: bool) -> Iterator[pa.RecordBatch]:
    """Rows of (path, opener) pairs in small Arrow batches."""
    schema, buffer = to_arrow_schema(RUNS), []
    for path, opened in files:
        named = name_columns(path)
        buffer.extend({**row, **named} for row in transcripts.file_rows(path, opened, keep_all))
        while len(buffer) >= ROWS_PER_BATCH:
            yield pa.RecordBatch.from_pylist(buffer[:ROWS_PER_BATCH], schema=schema)
            buffer = buffer[ROWS_PER_BATCH:]
    if buffer:
        yield pa.RecordBatch.from_pylist(buffer, schema=schema)


class Transcripts(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> StructType:
        return RUNS

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return TranscriptReader(dict(self.options))


def read_transcripts(spark: SparkSession, root: str | None = None, keep_all: bool = False, where: list[Test] = (),
                     files: str | None = None, pattern: str = ARCHIVE_PATTERN, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Runs and file statuses of the archives under ``root``, or of those listed in ``files``."""
    for column, how, _ in where:
        if column not in FILE_COLUMNS or how not in COMPARE:
            raise ValueError(f"files are tested by {FILE_COLUMNS} and {tuple(COMPARE)}, not by {column} {how}")
    spark.dataSource.register(Transcripts)
    given = {"where": json.dumps(list(where)), "keepAll": keep_all, "pattern": pattern, "groupBytes": group_bytes,
             "tasks": spark.sparkContext.defaultParallelism, **({"files": files} if files else {})}
    reader = spark.read.format("transcripts").options(**given)
    return reader.load(root) if root else reader.load()
