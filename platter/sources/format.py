"""Images as Spark tables: spark.read.format("platter").option("table", ...), and scan() over contents in a column.

Files are split like any other: small ones share a task, large ones are cut by block offsets or by sector numbers, and each
task reads the header and index itself and then only the parts that are its own. No payload is shuffled.
"""

from __future__ import annotations

import glob
import io
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from platter.sources.image import TABLES, WHOLE, Image, ImageError, rows

SPLIT_BYTES = 128 << 20
#: Rows and bytes of one Arrow batch.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20


def schema_of(table: str) -> str:
    return f"path string, {TABLES[table][1]}"


def _batches(found: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in found:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [[_nested(v) for v in c] for c in zip(*held)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _nested(value):
    return [{"first_lba": a, "last_lba": b} for a, b in value] if isinstance(value, list) else value


def scan(images: DataFrame, table: str) -> DataFrame:
    """A table of images whose bytes are in the columns path and content, as binaryFile gives them; null content is an empty file."""
    ddl = schema_of(table)
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                buffer = content.as_buffer() if content.is_valid else pa.py_buffer(b"")
                yield from _batches(rows(path.as_py(), io.BytesIO(buffer), table), schema)

    return images.select("path", "content").mapInArrow(read, ddl)


def open_file(path: str):
    """A seekable file of a local path or of any address that Arrow's file systems know."""
    if "://" not in path:
        return open(path, "rb")
    system, inner = pafs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def list_files(path: str) -> list[tuple[str, int]]:
    """Files and their sizes under a folder, or matching a local pattern."""
    if "://" in path:
        system, inner = pafs.FileSystem.from_uri(path)
        head = path[: len(path) - len(inner)]
        info = system.get_file_info(inner)
        found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(inner, recursive=True))
        return sorted((head + f.path, f.size) for f in found if f.type == pafs.FileType.File)
    names = [os.path.join(d, n) for p in glob.glob(path) for d, _, ns in (os.walk(p) if os.path.isdir(p) else [("", "", [p])]) for n in ns]
    return sorted((n, os.path.getsize(n)) for n in names if not os.path.basename(n).startswith((".", "_")))


class Split(InputPartition):
    """Pieces of files: path, which piece, of how many, file size."""

    def __init__(self, pieces: list[tuple[str, int, int, int]]) -> None:
        super().__init__(pieces)


class ImageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], table: str, schema: pa.Schema) -> None:
        self.path, self.table, self.arrow = options["path"], table, schema
        self.split_bytes = int(options["splitBytes"])
        self.low, self.high = WHOLE
        self.paths: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        """Bounds on lba and equal paths spare work; Spark tests all filters again."""
        for f in filters:
            column, value = ".".join(f.attribute) if hasattr(f, "attribute") else "", getattr(f, "value", None)
            if column == "path" and isinstance(f, (EqualTo, In)):
                named = {value} if isinstance(f, EqualTo) else set(value)
                self.paths = named if self.paths is None else self.paths & named
            elif column == "lba":
                if isinstance(f, (EqualTo, In)):
                    values = [value] if isinstance(f, EqualTo) else [v for v in value if v is not None]
                    self.low, self.high = max(self.low, min(values, default=0)), min(self.high, max(values, default=-1) + 1)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = min(self.high, value + isinstance(f, LessThanOrEqual))
            yield f

    def partitions(self) -> list[Split]:
        splits, held, size = [], [], 0
        for path, length in list_files(self.path):
            if self.paths is not None and path not in self.paths:
                continue
            n = 1 if TABLES[self.table][0] == "whole" else max(1, -(-length // self.split_bytes))
            for k in range(n):
                if held and size + length // n > self.split_bytes:
                    splits.append(Split(held))
                    held, size = [], 0
                held.append((path, k, n, length))
                size += length // n + 4096
        return splits + ([Split(held)] if held else [])

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        for path, k, n, length in partition.value:
            with open_file(path) as file:
                yield from _batches(rows(path, file, self.table, *self.bounds(file, k, n, length)), self.arrow)

    def bounds(self, file, k: int, n: int, length: int) -> tuple[int, int]:
        kind, end = TABLES[self.table][0], WHOLE[1]
        if kind == "whole":
            return WHOLE
        if kind == "sector" and n > 1:
            try:
                length = Image(file).sector_count()
            except ImageError:
                length = 0
        low, high = length * k // n, end if k == n - 1 else length * (k + 1) // n
        return (max(low, self.low), min(high, self.high)) if kind == "sector" else (low, high)


class ImageSource(DataSource):
    """Options: table, one of TABLES; path, a file, folder or pattern; splitBytes, of a task."""

    @classmethod
    def name(cls) -> str:
        return "platter"

    def schema(self) -> str:
        return schema_of(self.options.get("table", "images"))

    def reader(self, schema: StructType) -> ImageReader:
        return ImageReader({"path": self.options["path"], "splitBytes": self.options.get("splitBytes", str(SPLIT_BYTES))}, self.options.get("table", "images"), to_arrow_schema(schema))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImageSource)
