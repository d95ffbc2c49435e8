"""Lookups of sectors, track sectors and media tags; each answers every request, with a status where there is nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platter import layout as L


def read_sectors(sectors: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (path, lba) with data and status; addresses outside the image: out of bounds."""
    found = requests.join(sectors.select("path", "lba", "data", "status"), ["path", "lba"], "left")
    return found.withColumn("status", F.coalesce("status", F.lit(L.OUT_OF_BOUNDS)))


def data_tracks(tracks: DataFrame) -> DataFrame:
    """Tracks 1 to 99 of intact track lists; of equal sequences the first."""
    good = tracks.filter(F.col("sequence").between(1, 99) & F.col("crc_ok"))
    first = good.groupBy("path", "sequence").agg(F.min_by(F.struct("first_lba", "last_lba", "type"), "position").alias("t"))
    return first.select("path", "sequence", "t.*")


def read_track_sectors(images: DataFrame, tracks: DataFrame, sectors: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (path, track, relative) with data, status and whether the address lies past the track's end."""
    media = images.select("path", (F.col("media_class") == "optical disc").alias("optical"))
    named = data_tracks(tracks).withColumnRenamed("sequence", "track").drop("type")
    asked = requests.join(media, "path", "left").join(named, ["path", "track"], "left")
    asked = asked.withColumn("lba", F.col("first_lba") + F.col("relative"))
    found = asked.join(sectors.select("path", "lba", "data", F.col("status").alias("read")), ["path", "lba"], "left")
    status = F.when(~F.coalesce("optical", F.lit(False)), L.WRONG_MEDIA).when(F.col("first_lba").isNull(), L.NO_TRACK).otherwise(F.coalesce("read", F.lit(L.OUT_OF_BOUNDS)))
    return found.select("path", "track", "relative", "lba", F.when(status >= 0, F.col("data")).alias("data"), status.alias("status"), (F.col("lba") > F.col("last_lba")).alias("past_end"))


def sectors_with_track(sectors: DataFrame, tracks: DataFrame) -> DataFrame:
    """Each sector with the first track that covers it; path is the key, so a range never meets other images' tracks."""
    spans = data_tracks(tracks).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("sequence", "first_lba", "last_lba", "type"))).alias("spans"))
    found = sectors.join(spans, "path", "left")
    covering = F.get(F.filter("spans", lambda t: F.col("lba").between(t["first_lba"], t["last_lba"])), F.lit(0))
    return found.withColumn("track", covering["sequence"]).drop("spans")


def read_media_tags(tags: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (path, tag_type) with data and status."""
    found = requests.join(tags.select("path", "tag_type", "data", "status"), ["path", "tag_type"], "left")
    return found.withColumn("status", F.coalesce("status", F.lit(L.NO_TAG)))
