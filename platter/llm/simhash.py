"""SimHash near-duplicates: 64-bit fingerprints that differ in at most 3 bits are linked; classes are what links connect.

Candidates come from Golay-code fuzzy hashing. A fingerprint is cut into three segments of 22, 21 and 21 bits. By the
pigeonhole principle 3 errors leave one of two patterns:

* a segment i without errors whose successor j has at most 2: the key (i, bits of i, index of j), with every index near j;
* one error in each segment: the key (indices of all three). One side gives the own index of segments 1 and 3 and the near
  ones of 2, the other side the near ones of 1 and 3 and the own one of 2; each row gives both, so either order is found.

That is about 50 keys of 34 bits or more for a fingerprint, so the candidates per key stay few however many rows there are.
Rows meet by key in sorted runs that are read as a stream. A run's pairs are verified by population count, and only edges
that connect its classes leave it. A run of more than MAX_RUN different fingerprints is not compared pair by pair: its members are
linked exactly through the words at distance 1 and 2 around them (if x is within 1 and y within 2 of a word, they are
within 3 of each other, and every linked pair has such a word), which is linear in the members. Nothing is dropped.

Rows with equal fingerprints become one before any key is made, so groups of copies of any size cost one fingerprint.

Defined results: a text without words (null, empty, blank) has fingerprint zero and links like any other; fewer words than
a shingle make one shingle; rows with a null id are fingerprinted and linked, but never name a class unless all its ids are
null (then component_id is null); repeated rows are returned once each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platter.llm import golay
from platter.llm.common import checkpointed, fresh, identity, utf8
from platter.llm.components import connected

RADIUS = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Different fingerprints of one key that are compared pair by pair in one task.
MAX_RUN = 8192
#: Runs of up to so many are compared together, in one vectorised pass for each distance between their rows.
_SHORT = 12
SEED = 42
#: Row keys that are broadcast at most; beyond, the same join is done by a shuffle.
BROADCAST_ROWS = 500_000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.lower().split()
    if not words:
        return 0
    n = len(words) - shingle + 1
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if n > 0 else [b" ".join(words)]
    n = max(1, n)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(shingle: int = 3):
    """Column function: a text's fingerprint as a signed 64-bit integer."""

    @F.arrow_udf(T.LongType())
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, shingle) for t in utf8(texts)], np.uint64).view(np.int64))

    return simhash


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    return [(prints >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of all keys of the fingerprints."""
    parts = _segments(prints)
    own = [golay.index(p).astype(np.int64) for p in parts]
    near = [golay.near(p, bits) for p, (_, bits) in zip(parts, SEGMENTS, strict=True)]
    keys, rows = [], []
    for i in range(3):
        found, new = near[(i + 1) % 3]
        row, column = np.nonzero(new)
        keys.append(np.int64(i) << 60 | parts[i][row] << 12 | found[row, column])
        rows.append(row)
    tag = np.int64(3) << 60
    row, column = np.nonzero(near[1][1])
    keys.append(tag | own[0][row] << 24 | near[1][0][row, column].astype(np.int64) << 12 | own[2][row])
    rows.append(row)
    row, first, last = np.nonzero(near[0][1][:, :, None] & near[2][1][:, None, :])
    keys.append(tag | near[0][0][row, first].astype(np.int64) << 24 | own[1][row] << 12 | near[2][0][row, last])
    rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy()
        for at in range(0, len(prints), 2048):
            part = prints[at : at + 2048]
            key, row = keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], ["key", "fp"])


def _forest(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member of a run to the least member of its class, within the run."""
    n, label = len(run), np.arange(len(run))
    step = max(1, (1 << 22) // n)
    while True:
        old = label.copy()
        for at in range(0, n, step):
            linked = np.bitwise_count(run[at : at + step, None] ^ run) <= RADIUS
            label[at : at + step] = np.where(linked, label, n).min(axis=1)
        label = np.minimum(label, label[label])
        if (label == old).all():
            return run[label != np.arange(n)], run[label[label != np.arange(n)]]


def _short_runs(prints: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All linked pairs of short runs."""
    end_of = np.repeat(ends, ends - starts)
    at = np.concatenate([np.arange(s, e) for s, e in zip(starts, ends, strict=True)])
    for d in range(1, int((ends - starts).max())):
        near = at[at + d < end_of]
        linked = near[np.bitwise_count(prints[near] ^ prints[near + d]) <= RADIUS]
        if len(linked):
            yield prints[linked], prints[linked + d]


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Edges (wide false: a, b) of the runs of (key, fp), sorted by both; of longer runs the members (wide true)."""

    def edges(a: np.ndarray, b: np.ndarray, wide: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), wide)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["wide", "a", "b"])

    def done(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        sizes = np.diff(cuts)
        short = (sizes > 1) & (sizes <= _SHORT)
        if short.any():
            for a, b in _short_runs(fp, cuts[:-1][short], cuts[1:][short]):
                yield edges(a, b, False)
        for i in np.flatnonzero(sizes > _SHORT):
            a, b = _forest(fp[cuts[i] : cuts[i + 1]])
            if len(a):
                yield edges(a, b, False)

    key = np.empty(0, np.int64)
    fp = np.empty(0, np.uint64)
    over: int | None = None  # the key of a run that was found too long
    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy()])
        fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
        key, fp = key[new], fp[new]
        if over is not None:
            more = key == over
            if more.any():
                yield edges(fp[more], fp[more], True)
            key, fp = key[~more], fp[~more]
            if not len(key):
                continue
            over = None
        last = np.searchsorted(key, key[-1])
        if last:
            yield from done(key[:last], fp[:last])
        key, fp = key[last:], fp[last:]
        if len(key) > most:
            over = int(key[0])
            yield edges(fp, fp, True)
            key, fp = key[:0], fp[:0]
    if len(key):
        yield from done(key, fp)


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, far, fp): the words at distance 1 and less (far false) and 2 of each fingerprint."""
    ones = [0, *(1 << i for i in range(64))]
    masks = np.array([*ones, *(a | b for a, b in combinations(ones[1:], 2))], np.uint64)
    far = np.arange(len(masks)) > 64
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(prints), 16):
            part = prints[at : at + 16]
            yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ masks).ravel().view(np.int64)), pa.array(np.tile(far, len(part))), pa.array(np.repeat(part, len(masks)).view(np.int64))], ["word", "far", "fp"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to the first fingerprint of each word that lies within 1 of it; rows are sorted by (word, far)."""
    word = centre = None
    for batch in batches:
        words, fars, prints = (batch.column(i).to_pylist() for i in range(3))
        a, b = [], []
        for w, far, fp in zip(words, fars, prints, strict=True):
            if w != word:
                word, centre = w, None if far else fp
            elif centre is not None and fp != centre:
                a.append(fp)
                b.append(centre)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) whose connected components are those of all links among the different fingerprints of column fp."""
    most = MAX_RUN
    found = checkpointed(
        prints.select("fp").mapInArrow(_emit_keys, "key bigint, fp bigint").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lambda b: _runs(b, most), "wide boolean, a bigint, b bigint").distinct()
    )
    edges = found.filter("NOT wide").select("a", "b")
    wide = found.filter("wide").select(F.col("a").alias("fp"))
    if wide.isEmpty():
        return edges
    stars = wide.distinct().mapInArrow(_balls, "word bigint, far boolean, fp bigint").repartition("word").sortWithinPartitions("word", "far").mapInArrow(_stars, "a bigint, b bigint")
    return edges.unionByName(stars.distinct())


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, alike: DataFrame | None = None) -> DataFrame:
    """One row a document: doc_id, row_key, fp, component_id (least id of its class) and first_key, the row_key of the
    class's first row by (id, row_key), null ids last. alike: further links (a, b) between hashes (xxhash64) of texts."""
    own = [F.xxhash64(text_col).alias("sid")] if alike is not None else []
    rows = checkpointed(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), identity(id_col, text_col).alias("row_key"), fingerprints(shingle)(F.col(text_col)).alias("fp"), *own))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    groups = rows.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n"))
    edges = links(groups)
    if alike is not None:
        prints = [rows.select(F.col("sid").alias(x), F.col("fp").alias(f"{x}_fp")).distinct() for x in ("a", "b")]
        edges = edges.unionByName(alike.join(prints[0], "a").join(prints[1], "b").select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")).filter("a <> b"))
    linked = checkpointed(connected(edges))  # node, root
    heads = linked.join(groups.select(F.col("fp").alias("node"), "first"), "node")
    heads = linked.join(heads.groupBy("root").agg(F.min("first").alias("head")), "root").select(F.col("node").alias("fp"), "head")
    # Fingerprints of one row without links head themselves, so only the others are joined back; a fingerprint with a third
    # of all rows is one row here, and the join's skewed side is split by adaptive execution.
    named = groups.join(heads, "fp", "left").filter("n > 1 OR head IS NOT NULL").select("fp", F.coalesce("head", "first").alias("head"))
    return rows.join(named, "fp", "left").select("doc_id", "row_key", "fp", F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"), F.coalesce("head.row_key", "row_key").alias("first_key"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, alike: DataFrame | None = None) -> DataFrame:
    """docs with one row of each class, that of the least id; repeated rows count as members of their class. alike: see classes.

    Of rows that share id and text the least by the JSON of all columns stays. Only keys are joined and counted; texts are
    dealt only where such rows are more than one.
    """
    key, other = fresh(docs, "row_key"), fresh(docs, "other_key")
    rows = checkpointed(classes(docs, id_col, text_col, shingle, alike).select(F.col("row_key").alias(other), (F.col("row_key") == F.col("first_key")).alias("first")))
    gone = _by_size(rows.filter("NOT first").select(other).distinct())
    several = _by_size(rows.filter("first").groupBy(other).count().filter("count > 1").select(other))
    own = docs.withColumn(key, identity(id_col, text_col)).join(gone, F.col(key) == F.col(other), "left_anti")
    whole = F.struct(*[F.col(c) for c in docs.columns])
    least = own.join(several, F.col(key) == F.col(other), "left_semi").groupBy(key).agg(F.min_by(whole, F.to_json(whole)).alias(other)).select(f"{other}.*")
    return own.join(several, F.col(key) == F.col(other), "left_anti").drop(key).unionByName(least)


def _by_size(df: DataFrame) -> DataFrame:
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
