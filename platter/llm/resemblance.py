"""Pairs of texts whose sets of word shingles have a Jaccard similarity of at least a threshold: an exact join.

1. A text is the set of the hashes of its shingles (lower-cased words; a text of fewer words is one shingle, one without
   words has no set and no pairs). Equal texts are one row.
2. Sets are ordered by (common, hash), where common holds hashes that are frequent in a sample. Any total order is right;
   this one keeps frequent shingles out of the prefixes. A prefix is what any match must share one shingle of; it becomes postings.
3. Postings of a shingle are first compared with the smallest set and with the one before, which is linear in a group of
   copies. The pairs that pass the length, position and bitmap filters are compared by sketches of 1,024 parities, which
   cannot differ in more bits than the sets do in shingles, then by wider ones, and those that pass are verified on the whole sets.
4. What is linked so far makes classes. Of each shingle that more than one class has, the postings outside its main class
   meet all the others of other classes, so every pair that could join two classes is verified, and only those.

The edges thus connect what all pairs at the threshold connect, though pairs within a class may be missing among them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platter.llm.common import Scratch, checkpointed, utf8
from platter.llm.components import connected

#: Texts of the sample, and how many of them share a shingle that counts as common; at most so many are sent to the tasks.
SAMPLE, COMMON, MOST_COMMON = 10_000, 8, 200_000
BROADCAST_ROWS = 1_000_000
SEED = 42
#: Bits of a sketch, and of the one that pairs are compared by which this lets pass.
SKETCH, WIDE_SKETCH = 1 << 10, 1 << 14

_PARTS = ("sid", "size", "pos", "bits")


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """The different hashes of a text's shingles, in order."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64)
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[i : i + n] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n).view(np.int64))


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(sid, items) of rows (sid, text) that have words."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = pa.array([shingles(t, shingle) for t in utf8(part.column("text"))], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("sid"), sets], ["sid", "items"])

    return rows.select("sid", "text").mapInArrow(found, "sid bigint, items array<bigint>").filter(F.size("items") > 0)


def _common(rows: DataFrame, shingle: int) -> np.ndarray:
    n = rows.count()
    some = rows.filter(F.pmod(F.xxhash64("sid"), F.lit(1_000_000)) < max(1, min(1_000_000, 1_000_000 * SAMPLE // max(1, n))))
    counts = _sets(some, shingle).select(F.explode("items").alias("word")).groupBy("word").count().filter(F.col("count") >= COMMON)
    return np.sort(np.array([r.word for r in counts.orderBy(F.desc("count"), "word").limit(MOST_COMMON).collect()], np.int64))


def postings(rows: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(word, sid, size, pos, bits) of the prefixes of the rows' sets."""
    shared = rows.sparkSession.sparkContext.broadcast(_common(rows, shingle))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words, sizes, bits = [], [], []
                for text in utf8(part.column("text")):
                    items = shingles(text, shingle)
                    size = len(items)
                    if len(common):
                        late = common[np.minimum(np.searchsorted(common, items), len(common) - 1)] == items
                        items = np.concatenate([items[~late], items[late]])
                    words.append(items[: size - (size * percent + 99) // 100 + 1] if size else items)
                    sizes.append(size)
                    bits.append(int(np.bitwise_xor.reduce(np.uint64(1) << (items.view(np.uint64) & np.uint64(63)), initial=np.uint64(0)).view(np.int64)))
                n = np.array([len(w) for w in words], np.int64)
                each = lambda values: pa.array(np.repeat(np.asarray(values, np.int64), n))  # noqa: B023, E731
                pos = np.concatenate([np.arange(k) for k in n])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(words)), each(part.column("sid").to_numpy()), each(sizes), pa.array(pos), each(bits)], ["word", *_PARTS])

    return rows.select("sid", "text").mapInArrow(found, "word bigint, sid bigint, size bigint, pos bigint, bits bigint")


def _may_match(a: dict[str, Column], b: dict[str, Column], percent: int) -> Column:
    """The length, positional and bitmap filters, for two postings of one shingle."""
    total = a["size"] + b["size"]
    return (
        (a["size"] * 100 >= b["size"] * percent)
        & (b["size"] * 100 >= a["size"] * percent)
        & (F.least(a["size"] - a["pos"], b["size"] - b["pos"]) * (100 + percent) >= total * percent)
        & (F.bit_count(a["bits"].bitwiseXOR(b["bits"])) * (100 + percent) <= total * (100 - percent))
    )


def _sketches(rows: DataFrame, shingle: int, bits: int) -> DataFrame:
    """(sid, n, sketch) of rows (sid, text): the size of the set, and the parities of so many classes of its shingles."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t, shingle) for t in utf8(part.column("text"))]
                made = [np.packbits(np.bincount((x >> 6) & (bits - 1), minlength=bits) & 1).view(np.int64) for x in sets]
                yield pa.RecordBatch.from_arrays([part.column("sid"), pa.array([len(x) for x in sets], pa.int64()), pa.array(made, pa.list_(pa.int64()))], ["sid", "n", "sketch"])

    return rows.select("sid", "text").mapInArrow(found, "sid bigint, n bigint, sketch array<bigint>")


def _differ(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)


def _close(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (sid, other) whose sketches differ in no more bits than the sets of a match in shingles."""
    theirs = sketches.select(F.col("sid").alias("other"), F.col("n").alias("other_n"), F.col("sketch").alias("other_sketch"))
    close = _differ("sketch", "other_sketch") * (100 + percent) <= (F.col("n") + F.col("other_n")) * (100 - percent)
    return pairs.join(sketches, "sid").join(theirs, "other").filter(close).select("sid", "other")


def _verified(scratch: Scratch, pairs: DataFrame, rows: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs (sid, other) that reach the threshold."""

    def texts(pairs: DataFrame) -> DataFrame:
        need = scratch.by_size(pairs.select(F.explode(F.array("sid", "other")).alias("need")).distinct(), BROADCAST_ROWS)
        return rows.join(need, F.col("sid") == F.col("need"), "left_semi")

    # Long texts fill a small sketch; a wide one is still far smaller than their sets.
    pairs = scratch.keep(_close(pairs, scratch.keep(_sketches(texts(pairs), shingle, WIDE_SKETCH)), percent))
    sets = scratch.keep(_sets(texts(pairs), shingle))
    mine = sets.select("sid", F.col("items").alias("x"))
    theirs = sets.select(F.col("sid").alias("other"), F.col("items").alias("y"))
    alike = F.size(F.array_intersect("x", "y")) * (100 + percent) >= (F.size("x") + F.size("y")) * percent
    return scratch.keep(pairs.join(mine, "sid").join(theirs, "other").filter(alike).select("sid", "other"))


def links(docs: DataFrame, percent: int, shingle: int, text_col: str = "text") -> DataFrame:
    """Edges (a, b) between the hashes (xxhash64) of texts that are alike."""
    scratch = Scratch(docs.sparkSession)
    every = docs.filter(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("sid"), F.col(text_col).alias("text"))
    # Only texts that occur again are dealt to become one row each.
    again = scratch.by_size(every.groupBy("sid").count().filter("count > 1").select("sid"), BROADCAST_ROWS)
    rows = every.join(again, "sid", "left_anti").unionByName(every.join(again, "sid", "left_semi").dropDuplicates(["sid"]))
    posts = postings(rows, percent, shingle)
    by_size = Window.partitionBy("word").orderBy("size", "sid")
    here, me = F.struct(*_PARTS), {p: F.col(p) for p in _PARTS}
    first = F.first(here).over(by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Most shingles are in one text; the postings of the others are what is stored.
    near = posts.select("word", *_PARTS, first.alias("x0"), F.lag(here).over(by_size).alias("x1"), F.lead("sid").over(by_size).alias("next")).filter("x1 IS NOT NULL OR next IS NOT NULL")
    near = scratch.keep(near)
    asked = [near.filter(F.col(x).isNotNull() & (F.col(f"{x}.sid") != F.col("sid")) & _may_match(me, {p: F.col(f"{x}.{p}") for p in _PARTS}, percent)).select("sid", F.col(f"{x}.sid").alias("other")) for x in ("x0", "x1")]
    ordered = lambda pairs: pairs.select(F.greatest("sid", "other").alias("sid"), F.least("sid", "other").alias("other")).distinct()
    tried = scratch.keep(ordered(asked[0].unionByName(asked[1])))
    texts = scratch.by_size(near.select(F.col("sid").alias("need")).distinct(), BROADCAST_ROWS)
    sketches = scratch.keep(_sketches(rows.join(texts, F.col("sid") == F.col("need"), "left_semi"), shingle, SKETCH))
    tried = scratch.keep(_close(tried, sketches, percent))
    found = _verified(scratch, tried, rows, percent, shingle)

    roots = connected(found.select(F.col("sid").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("sid"), "root")
    named = scratch.keep(near.select("word", *_PARTS).join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid")))
    mixed = scratch.keep(named.groupBy("word").agg(F.mode("root").alias("main"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("word", "main"))
    # Here pairs of different classes meet, most of which share no more than a passage; the sketch stops them within the join.
    named = named.join(sketches.select("sid", "sketch"), "sid").join(mixed, "word")
    asking = named.filter("root <> main").alias("a")
    mine, theirs = ({p: F.col(f"{s}.{p}") for p in _PARTS} for s in "ab")
    close = _differ("a.sketch", "b.sketch") * (100 + percent) <= (mine["size"] + theirs["size"]) * (100 - percent)
    met = asking.join(named.alias("b"), (F.col("a.word") == F.col("b.word")) & (F.col("a.root") != F.col("b.root")) & _may_match(mine, theirs, percent) & close)
    rest = scratch.keep(ordered(met.select(F.col("a.sid").alias("sid"), F.col("b.sid").alias("other"))).join(tried, ["sid", "other"], "left_anti"))
    found = checkpointed(found.unionByName(_verified(scratch, rest, rows, percent, shingle)).select(F.col("sid").alias("a"), F.col("other").alias("b")))
    scratch.drop()
    return found
