"""URL filters by a temporal list join, in DataFrame operations only.

A list is a log of dated changes (list, entry, action add or remove, at). Consecutive changes of an entry become validity
intervals, and a capture is judged by the entries that were active when it was fetched. Entries are URL prefixes
(host/segment/...), hosts or parent domains; a capture asks for its own keys by equality, which are all parent domains of
its host and as many path segments as the longest entry has. Both sides also carry a time
bucket of BUCKET_DAYS days, into which intervals are split: a key with a long history then meets only the intervals of the
same weeks, and the captures of a frequent host are dealt over the buckets.

The most specific active entry decides (longer prefix, then longer host, then parent domains); of one entry on several lists the blocking
one does. Changes at the same time apply in the order add, remove. An interval includes its start and excludes its end.

Defined results: captures with a null URL, no host or a null time match nothing and are not blocked; entries or times
that are null are ignored; adding an active entry or removing an absent one changes nothing; repeated captures are returned
each; empty lists block nothing; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platter.llm.common import checkpointed

BUCKET_DAYS = 32
BROADCAST_ROWS = 200_000


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def keys(url: Column, segments: int | None = None) -> Column:
    """The entries that match a URL, the most specific first: path prefixes (of up to so many segments), the host, its parents."""
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    parts = parts if segments is None else F.slice(parts, 1, segments)
    labels = F.split(host(url), "\\.")
    prefixes = F.reverse(F.transform(parts, lambda part, i: F.when(part != "", F.concat(host(url), F.lit("/"), F.array_join(F.slice(parts, 1, i + 1), "/")))))
    parents = F.transform(labels, lambda _, i: F.when(F.size(labels) - i >= 2, F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    return F.when(host(url) != "", F.array_compact(F.concat(prefixes, parents)))


def _bucket(at: Column) -> Column:
    return F.floor(F.unix_seconds(at) / (86400 * BUCKET_DAYS)).cast("bigint")


def intervals(changes: DataFrame) -> DataFrame:
    """(list, entry, blocks, since, until) of active times; until is null while the entry stays. changes: list, entry, blocks, action, at."""
    log = changes.filter("entry IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')").select("list", F.lower("entry").alias("entry"), "blocks", "action", "at")
    order = Window.partitionBy("list", "entry").orderBy("at", "action")
    turns = log.withColumn("before", F.lag("action").over(order)).filter("before IS NULL OR before <> action")
    ended = turns.withColumn("until", F.lead("at").over(order))
    return ended.filter("action = 'add' AND (until IS NULL OR until > at)").select("list", "entry", "blocks", F.col("at").alias("since"), "until")


def judge(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """captures: id, url, at. Returns id, url, at, blocked, and of the deciding entry: list, entry, since."""
    last = F.lit(captures.agg(F.max("at").alias("last")).first()["last"]).cast("timestamp")
    active = intervals(changes).filter(F.col("since") <= last)
    ends = F.least(F.coalesce(F.col("until"), last), last)
    split = checkpointed(active.select("*", F.explode(F.sequence(_bucket(F.col("since")), F.greatest(_bucket(F.col("since")), _bucket(ends)))).alias("in_bucket")))
    # A key of n segments has n slashes, so more segments than that are in no entry.
    size = split.agg(F.count("*").alias("n"), F.max(F.size(F.split("entry", "/")) - 1).alias("segments")).first()
    if size["n"] <= BROADCAST_ROWS:
        split = F.broadcast(split)
    counted = captures.groupBy("id", "url", "at").agg(F.count("*").cast("int").alias("copies"))
    asked = counted.select("*", F.posexplode_outer(F.when(F.col("at").isNotNull(), keys(F.col("url"), size["segments"] or 0))).alias("rank", "key")).withColumn("bucket", _bucket(F.col("at")))
    on = (F.col("key") == F.col("entry")) & (F.col("bucket") == F.col("in_bucket")) & (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    met = asked.join(split, on, "left")
    # The first by rank; where one entry is on several lists, blocking before not blocking, then by the list's name.
    best = F.min(F.when(F.col("list").isNotNull(), F.struct("rank", (~F.col("blocks")).alias("allows"), "list", "entry", "since"))).alias("best")
    judged = met.groupBy("id", "url", "at", "copies").agg(best)
    judged = judged.select("id", "url", "at", F.coalesce(~F.col("best.allows"), F.lit(False)).alias("blocked"), "best.list", "best.entry", "best.since", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return judged.drop("copy")
