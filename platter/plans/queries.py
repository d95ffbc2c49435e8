"""The registered queries: each makes images of a whole table, reads them through the engine, and reports what it finds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platter.functions import codecs, convert
from platter.functions.cdrom import bcd, edc_hex, lba_to_msf
from platter.functions.checksums import crc64_hex, spamsum_text
from platter.operators import access, verify
from platter.plans import images as I
from platter.plans.images import table
from platter.sources.format import scan
from platter.streaming import windows


def key(name: str = "doc_id") -> Column:
    """The row that an image was made of."""
    return F.col("path").cast("bigint").alias(name)


def _utf8(name: str) -> Column:
    return F.encode(F.coalesce(F.col(name), F.lit("")), "UTF-8")


def _sha(name: str = "data") -> Column:
    return F.sha2(F.col(name), 256)


def identify(spark: SparkSession, d: str) -> DataFrame:
    docs = I.documents(spark, d).select(F.lit("image").alias("kind"), key("id"), convert.identify(F.col("content")).alias("confidence"))
    pages = table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), convert.identify(_utf8("html")).alias("confidence"))
    return docs.unionByName(pages)


def image_info(spark: SparkSession, d: str) -> DataFrame:
    return scan(I.documents(spark, d), "images").select(key(), "status", "application", "media_type", "media_class", "sectors", "sector_size", "cylinders", "heads", "sectors_per_track")


def image_index(spark: SparkSession, d: str) -> DataFrame:
    found = scan(I.documents(spark, d), "image_index")
    return found.groupBy(key()).agg(F.count_if(F.col("block_type") == "DBLK").alias("data_blocks"), F.count_if(F.col("block_type") == "DDT*").alias("tables"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    found = scan(I.documents(spark, d), "blocks")
    return found.groupBy(key(), "compression").agg(F.count(F.lit(1)).alias("blocks"), F.sum("length").alias("bytes"), F.bool_and("crc_ok").alias("intact"))


def ddt_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = scan(I.documents(spark, d), "ddt")
    return found.groupBy(key()).agg(F.count(F.lit(1)).alias("sectors"), F.countDistinct("block_offset", "sector_in_block").alias("distinct_sectors"))


def read_sector(spark: SparkSession, d: str) -> DataFrame:
    return scan(I.documents(spark, d), "sectors").select(key(), "lba", "status", _sha().alias("sha256"))


def read_sector_point(spark: SparkSession, d: str) -> DataFrame:
    """The first sector of every image, and one far outside it."""
    images = I.documents(spark, d)
    asked = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.explode(F.array(F.lit(0).cast("bigint"), F.lit(10**9).cast("bigint"))).alias("lba"))
    return access.read_sectors(scan(images, "sectors"), asked).select(key(), "lba", "status", F.hex("data").alias("data"))


def not_dumped(spark: SparkSession, d: str) -> DataFrame:
    return scan(I.documents(spark, d, I.gaps), "sectors").select(key(), "lba", "status", _sha().alias("sha256"))


def read_track_sector(spark: SparkSession, d: str) -> DataFrame:
    """The first sector of every track, and of one that no disc has."""
    discs = I.conversations(spark, d)
    turns = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("path"), (F.col("turn") + 1).cast("int").alias("track"))
    asked = turns.unionByName(turns.select("path", F.lit(99).alias("track")).distinct()).withColumn("relative", F.lit(0).cast("bigint"))
    found = access.read_track_sectors(scan(discs, "images"), scan(discs, "tracks"), scan(discs, "sectors"), asked)
    return found.select(key("conv_id"), "track", "status", _sha().alias("sha256"))


def track_range_join(spark: SparkSession, d: str) -> DataFrame:
    discs = I.conversations(spark, d)
    found = access.sectors_with_track(scan(discs, "sectors"), scan(discs, "tracks"))
    return found.groupBy(key("conv_id"), "track").agg(F.count(F.lit(1)).alias("sectors"))


def read_sector_long_tags(spark: SparkSession, d: str) -> DataFrame:
    return scan(I.documents(spark, d, I.tagged), "sectors_long").select(key(), "lba", "status", _sha().alias("sha256"))


def read_sector_long_cd(spark: SparkSession, d: str) -> DataFrame:
    found = scan(I.documents(spark, d, I.compact), "sectors_long")
    part = lambda at, n: F.substring("data", at + 1, n)
    return found.select(key(), "lba", "status", F.octet_length("data").cast("bigint").alias("bytes"), F.hex(part(0, 16)).alias("prefix"), F.sha2(part(16, 2048), 256).alias("user_sha256"))


def read_media_tag(spark: SparkSession, d: str) -> DataFrame:
    """Three tag types that every image has, one of them written twice, and one that none has."""
    items = table(spark, d, "documents")
    asked = items.select(F.col("doc_id").cast("string").alias("path"), F.explode(F.array(*map(F.lit, (0, 7, 68, 30)))).alias("tag_type"))
    found = access.read_media_tags(scan(I.documents(spark, d, I.tags), "media_tags"), asked)
    return found.select(key(), "tag_type", "status", F.when(F.col("tag_type") != 7, _sha()).alias("sha256"), F.octet_length("data").cast("bigint").alias("bytes"))


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return I.made(table(spark, d, "supplier"), "s_suppkey", I.described, F.col("s_name"), F.col("s_acctbal"))


def metadata_strings(spark: SparkSession, d: str) -> DataFrame:
    return scan(_suppliers(spark, d), "image_metadata").select(key("s_suppkey"), "creator", "media_title", "drive_model", "comments")


def sidecars(spark: SparkSession, d: str) -> DataFrame:
    return scan(_suppliers(spark, d), "cicm").select(key("s_suppkey"), F.xpath_string("xml", F.lit("/disc/name")).alias("name"))


def stored_checksums(spark: SparkSession, d: str) -> DataFrame:
    return scan(_suppliers(spark, d), "image_checksums").select(key("s_suppkey"), "algorithm", "digest")


def _drives(spark: SparkSession, d: str) -> DataFrame:
    images = I.made(table(spark, d, "customer"), "c_custkey", I.dumped, F.col("c_name"), F.col("c_mktsegment"))
    return scan(images, "dump_hardware").withColumn("c_custkey", F.col("path").cast("bigint"))


def dump_hardware(spark: SparkSession, d: str) -> DataFrame:
    return _drives(spark, d).select("c_custkey", "position", "manufacturer", "model", "serial", F.size("extents").cast("bigint").alias("extents"))


def extents_explode(spark: SparkSession, d: str) -> DataFrame:
    return _drives(spark, d).select("c_custkey", "position", F.explode("extents").alias("e")).select("c_custkey", "position", "e.first_lba", "e.last_lba")


def extent_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that no extent covers, before each extent."""
    order = Window.partitionBy("c_custkey").orderBy("first_lba", "last_lba")
    reached = F.max("last_lba").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return extents_explode(spark, d).select("c_custkey", "first_lba", (F.col("first_lba") - F.coalesce(reached, F.lit(-1)) - 1).alias("gap")).filter("gap > 0")


def crc64(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", crc64_hex(_utf8("p_name")).alias("crc64"))


def edc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", edc_hex(_utf8("p_name")).alias("edc"))


def spamsum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", spamsum_text(_utf8("text")).alias("spamsum"))


def _roundtrip(spark: SparkSession, d: str, function: Callable[[bytes], bytes]) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(codecs.transformed(_utf8("text"), function), 256).alias("sha256"))


def cst_transform(spark: SparkSession, d: str) -> DataFrame:
    """The first bit plane of names filled up to 32 bytes."""
    filled = F.encode(F.rpad("p_name", 32, " "), "UTF-8")
    return table(spark, d, "part").select("p_partkey", F.hex(F.substring(codecs.transformed(F.substring(filled, 1, 32), codecs.planes), 1, 4)).alias("plane"))


def cst_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    def turned(x: bytes) -> bytes:
        return codecs.unplanes(codecs.planes(x.ljust(-(-len(x) // 8) * 8, b"\0")))[: len(x)]

    return _roundtrip(spark, d, turned)


def lzma_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _roundtrip(spark, d, lambda x: codecs.lzma_decode(codecs.lzma_encode(x), len(x)))


def flac_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _roundtrip(spark, d, lambda x: codecs.flac_decode(codecs.flac_encode(x.ljust(-(-len(x) // 4) * 4, b"\0")), len(x)))


def digests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(_utf8("text")).alias("md5"), F.sha1(_utf8("text")).alias("sha1"), F.sha2(_utf8("text"), 256).alias("sha256"))


def crc32(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.crc32(_utf8("p_name")).alias("crc32"))


def msf(spark: SparkSession, d: str) -> DataFrame:
    at = lba_to_msf(F.col("o_orderkey"))
    found = table(spark, d, "orders").select("o_orderkey", at.alias("at"))
    return found.select("o_orderkey", "at.minute", "at.second", "at.frame", bcd(F.col("at.frame")).alias("frame_bcd"))


def filetime(spark: SparkSession, d: str) -> DataFrame:
    ticks = F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 10 + convert.EPOCH_TICKS
    return table(spark, d, "orders").select("o_orderkey", ticks.alias("ticks"), F.unix_micros(convert.filetime(ticks)).alias("micros"))


def media_type_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", convert.media_class(F.col("p_partkey") % 760).alias("media_class"))


def data_type_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", convert.media_tag_type(F.col("p_partkey") % 85).alias("tag_type"))


def hexdump(spark: SparkSession, d: str) -> DataFrame:
    return convert.hexdump(table(spark, d, "part").select("p_partkey", _utf8("p_name").alias("name")), "name")


def verify_image(spark: SparkSession, d: str) -> DataFrame:
    return verify.verify_images(scan(I.documents(spark, d, I.damaged), "verification")).select(key(), "status", "failed", "hardware_failed")


def verify_sectors(spark: SparkSession, d: str) -> DataFrame:
    images = I.documents(spark, d, I.compact)
    return verify.verify_sectors(scan(images, "images"), scan(images, "sectors_long")).select(key(), "sectors", "errors", "unknown", "unreadable")


def duplicate_sectors(spark: SparkSession, d: str) -> DataFrame:
    found = scan(I.documents(spark, d), "sectors").groupBy(_sha().alias("sha256"))
    return found.agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("path").alias("images")).filter("copies > 1")


def size_rollup(spark: SparkSession, d: str) -> DataFrame:
    sizes = scan(I.documents(spark, d), "images").select(key(), "sectors")
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return docs.join(sizes, "doc_id").rollup("lang", "source").agg(F.sum("sectors").alias("sectors"), F.max("sectors").alias("largest"))


def size_rank(spark: SparkSession, d: str) -> DataFrame:
    sizes = scan(I.documents(spark, d), "images").select(key(), "sectors")
    docs = table(spark, d, "documents").select("doc_id", "source")
    return docs.join(sizes, "doc_id").withColumn("rank", F.rank().over(Window.partitionBy("source").orderBy(F.desc("sectors"), "doc_id")))


def uncovered_sectors(spark: SparkSession, d: str) -> DataFrame:
    """Sectors beyond the first track, by an anti join on its range within each image."""
    discs = I.conversations(spark, d)
    tracks = access.data_tracks(scan(discs, "tracks")).filter("sequence = 1")
    return scan(discs, "sectors").alias("s").join(tracks.alias("t"), (F.col("s.path") == F.col("t.path")) & F.col("s.lba").between(F.col("t.first_lba"), F.col("t.last_lba")), "left_anti").groupBy(key("conv_id")).agg(F.count(F.lit(1)).alias("beyond_first_track"))


def tag_pivot(spark: SparkSession, d: str) -> DataFrame:
    found = scan(I.documents(spark, d, I.tags), "media_tags").groupBy(key()).pivot("tag_type", [0, 7, 68]).agg(F.sum(F.octet_length("data")).cast("bigint"))
    return found.select("doc_id", *[F.col(str(k)).alias(f"tag_{k}") for k in (0, 7, 68)])


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.tumbling(table(spark, d, "events"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(table(spark, d, "events"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    identify, image_info, image_index, blocks, ddt_dedup, read_sector, read_sector_point, not_dumped, read_track_sector, track_range_join,
    read_sector_long_tags, read_sector_long_cd, read_media_tag, metadata_strings, sidecars, stored_checksums, dump_hardware, extents_explode,
    extent_gaps, crc64, edc, spamsum, cst_transform, cst_roundtrip, lzma_roundtrip, flac_roundtrip, digests, crc32, msf, filetime, media_type_map,
    data_type_map, hexdump, verify_image, verify_sectors, duplicate_sectors, size_rollup, size_rank, uncovered_sectors, tag_pivot, event_windows, event_sessions,
)}
