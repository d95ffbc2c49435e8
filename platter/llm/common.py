"""What the training-data operators share: checkpoints, Arrow batches, fixed patterns."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex of the white space between words: U+0020 and U+0009 to U+000D.
SPACES = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a local session that names none gets a folder of its own; a cluster without one is an error, as executors do not
    see a folder that is local to the driver.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="platter-checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, stored in the shared checkpoint folder, so that no lost executor makes its lineage run again."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: With it, the shuffles of a finished query leave the executors' disks at once, not when the driver's collector finds them.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables that one operator stores in the shared folder while it runs, compressed; drop() deletes them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.n = spark, f"{checkpoint_folder(spark)}/scratch-{uuid4()}", 0

    def keep(self, df: DataFrame, **options: str) -> DataFrame:
        self.n += 1
        before = self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.options(**options).parquet(f"{self.folder}/{self.n}")
        finally:
            self.spark.conf.set(_CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")

    def by_size(self, df: DataFrame, most: int) -> DataFrame:
        """df, stored, and broadcast where its counted rows are at most so many."""
        df = self.keep(df)
        return F.broadcast(df) if df.count() <= most else df

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def utf8(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def shards(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int, most_rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with at most most_rows rows and most_bytes bytes of column each (one longer row stands alone)."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(sizes) > start:
            yield batch.slice(start)


def words(text: Column) -> Column:
    """The words of a text, array<string>: maximal runs of characters other than white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def identity(*columns: str) -> Column:
    """128 bits of hash for the values of columns: struct(a, b)."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *[F.col(c) for c in columns]).alias("b"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def span_text(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of an array of spans, comma-joined in its order; kinds: only these."""
    if kinds is not None:
        spans = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def span_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")
