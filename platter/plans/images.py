"""Images made of table rows, as columns path and content: what the registered queries read."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from platter import layout as L
from platter.functions import codecs
from platter.sources.writer import Parts, build, cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(df: DataFrame, key: str, make: Callable[..., bytes], *columns: Column) -> DataFrame:
    """One image per row: make gets the key and the columns' values."""

    @pandas_udf("binary")
    def content(*values: pd.Series) -> pd.Series:
        return pd.Series([make(*row) for row in zip(*values)], dtype=object)

    return df.select(F.col(key).cast("string").alias("path"), content(F.col(key), *columns).alias("content"))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode()


def plain(key: int, text: str | None) -> bytes:
    """Sectors of 512 bytes; every other document is compressed."""
    kind = codecs.LZMA if key % 2 else codecs.NONE
    return build(Parts(cut(_bytes(text), 512), compression=kind, table_compression=kind))


def gaps(key: int, text: str | None) -> bytes:
    """As plain, without every third sector."""
    return build(Parts([None if k % 3 == 2 else s for k, s in enumerate(cut(_bytes(text), 512))]))


def damaged(key: int, text: str | None) -> bytes:
    """As plain; where the key ends in 0, the last stored byte of the first block, if any, is changed."""
    whole = bytearray(plain(key, text))
    if key % 10 == 0 and text:
        stored = L.BLOCK_HEADER.unpack_from(whole, L.HEADER.size)[4]
        whole[L.HEADER.size + L.BLOCK_HEADER.size + stored - 1] ^= 1
    return bytes(whole)


def tagged(key: int, text: str | None) -> bytes:
    """Sectors of 512 bytes with tags of 12: the address in decimals."""
    sectors = cut(_bytes(text), 512)
    tags = b"".join(b"%012d" % k for k in range(len(sectors)))
    return build(Parts(sectors, media_type=184, blobs=[(73, tags, codecs.LZMA)]))


def _compact(sectors: list[bytes], prefix_cells: list[int], suffix_cells: list[int], prefixes: bytes, suffixes: bytes) -> bytes:
    blobs = [(L.PREFIX_FIXED, prefixes, codecs.NONE), (L.SUFFIX_FIXED, suffixes, codecs.NONE)]
    tracks = [(1, 2, 0, max(len(sectors) - 1, 0), 0, 1, "", 4)]
    return build(Parts(sectors, 2048, media_type=15, compression=codecs.LZMA, blobs=blobs, tracks=tracks, prefix_cells=prefix_cells, suffix_cells=suffix_cells))


def compact(key: int, text: str | None) -> bytes:
    """Mode 1 sectors of 2,048 bytes, all codes to be made anew; where the key ends in 0, the first suffix is kept as zero bytes."""
    sectors = cut(_bytes(text), 2048)
    suffixes = [1 if key % 10 == 0 and k == 0 else L.CORRECT for k in range(len(sectors))]
    return _compact(sectors, [L.CORRECT] * len(sectors), suffixes, bytes(16), bytes(288))


def disc(key: int, turns) -> bytes:
    """A track per turn, of 2,048-byte sectors."""
    sectors, tracks = [], []
    for turn in turns:
        own = cut(_bytes(turn["text"]) or b"\0", 2048)
        tracks.append((int(turn["turn"]) + 1, 1, len(sectors), len(sectors) + len(own) - 1, 0, 1, "", 4))
        sectors += own
    return build(Parts(sectors, 2048, media_type=10, tracks=tracks))


def tags(key: int, text: str | None) -> bytes:
    """A tag of each of three types; that of the first type is written twice."""
    data = _bytes(text)
    return build(Parts(media_type=10, blobs=[(2, b"old", codecs.NONE), (2, data, codecs.LZMA), (8, data[::-1], codecs.NONE), (79, b"end", codecs.NONE)]))


def described(key: int, name: str, balance: float) -> bytes:
    return build(Parts(metadata={"creator": name, "media_title": f"{name} / title", "drive_model": "model"}, cicm=f"<disc><name>{name}</name></disc>", geometry=(80, 2, 18), checksums=[(1, bytes(16)), (4, b"3:a:b")]))


def dumped(key: int, name: str, segment: str) -> bytes:
    """Two drives; their extents go by the key."""
    first = [(key % 7, key % 7 + 10), (key % 7 + 20, key % 7 + 30)]
    return build(Parts(hardware=[(["maker", name, "", "", str(key), "platter", "1", ""], first), (["other", segment] + [""] * 6, [(100, 200)])]))


def documents(spark: SparkSession, sf_dir: str, make: Callable[..., bytes] = plain) -> DataFrame:
    return made(table(spark, sf_dir, "documents"), "doc_id", make, F.col("text"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A disc per conversation; an image is one file, so its turns meet in one row."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    return made(turns, "conv_id", disc, F.col("turns"))
