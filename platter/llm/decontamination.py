"""Benchmark decontamination by a positional inverted index over the training documents.

The index is partitioned by document: each shard (a bounded run of documents) is one row that holds, for every distinct
token of the shard, the list of its positions. Building it moves no text between executors, and it does not depend on any
benchmark, so one stored index serves many. A search sends the windows of the benchmark, in blocks of bounded size, to
every shard; there the position lists of a window's tokens are shifted by their offsets and intersected, the shortest
(rarest) first, until no start is left. What is left are exact phrase matches.

A search with a slop finds proximity matches as well: places of a document at which every token of a window stands at most
slop words from where the window has it, so that words were put in, left out or moved. They never count as hits, and places
within slop words of an exact match of the same window are none.

Defined results: null or empty text has no words and is never contaminated; a row with null id is searched and returned
with null id; repeated rows are returned once each; an item with null id or without words has no windows; repeated item
ids count as one item; an empty benchmark or document table gives no hits or no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platter.llm.common import checkpointed, fresh, shards, utf8

#: Keys of contaminated rows that are broadcast at most; beyond, the same join is done by a shuffle.
BROADCAST_ROWS = 500_000

#: Bytes of text and rows in a shard at most; bounds a task's memory.
SHARD_BYTES, SHARD_ROWS = 16 << 20, 8192
#: Windows that are sent to the executors at once; a larger benchmark goes in several blocks.
BLOCK_WINDOWS = 200_000

#: Lower-cases A-Z and makes every ASCII character but digits and letters a blank.
_TO_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

INDEX_SCHEMA = "ids array<bigint>, keys array<bigint>, lengths binary, terms binary, counts binary, postings binary"
MATCH_SCHEMA = "doc_id bigint, row_key bigint, n_words bigint, n_hit bigint, items array<string>, near_items array<string>, matches array<struct<item_id:string,kind:string,start:bigint,end:bigint>>"


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def _pack(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True) if raw else b""


def _unpack(packed: bytes, dtype) -> np.ndarray:
    if not packed:
        return np.empty(0, dtype)
    return np.frombuffer(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True), dtype)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("lengths", pa.binary()), ("terms", pa.binary()), ("counts", pa.binary()), ("postings", pa.binary())])
    for shard in shards(batches, "text", SHARD_BYTES, SHARD_ROWS):
        number = count()
        local: dict[bytes, int] = {}
        parts, lengths = [], []
        for text in utf8(shard.column("text")):
            found = tokens(text)
            for word in set(found).difference(local):
                local[word] = next(number)
            lengths.append(len(found))
            parts.append(np.fromiter(map(local.__getitem__, found), np.int32, len(found)))
            parts.append(np.array([-1], np.int32))  # no window reaches into the next document
        stream = np.concatenate(parts)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in local), np.uint64, len(local))
        by_hash = np.argsort(hashes)
        rank = np.empty(len(local), np.int32)
        rank[by_hash] = np.arange(len(local), dtype=np.int32)
        at = np.flatnonzero(stream >= 0).astype(np.int32)
        term = rank[stream[at]]
        at = at[np.argsort(term, kind="stable")]
        counts = np.bincount(term, minlength=len(local)).astype(np.int32)
        steps = np.diff(at, prepend=np.int32(0))  # small within a list, and a negative step back where the next one starts
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([shard.column("row_key").to_pylist()], pa.list_(pa.int64())), pa.array([_pack(np.array(lengths, np.int32))], pa.binary()), pa.array([_pack(hashes[by_hash])], pa.binary()), pa.array([_pack(counts)], pa.binary()), pa.array([_pack(steps)], pa.binary())],
            schema=schema,
        )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: one row a shard. row_key identifies a row by its id and text."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    return checkpointed(rows.mapInArrow(_index, INDEX_SCHEMA))


def compile_windows(items: list[tuple[str, str]], window: int) -> dict[int, tuple[np.ndarray, list[list[str]]]]:
    """By window length: the distinct windows as rows of token hashes, and the items that have each."""
    found: dict[int, dict[tuple[int, ...], set[str]]] = {}
    for item, text in items:
        hashed = [xxhash.xxh64_intdigest(w) for w in tokens((text or "").encode())]
        n = min(window, len(hashed))
        for i in range(len(hashed) - n + 1 if n else 0):
            found.setdefault(n, {}).setdefault(tuple(hashed[i : i + n]), set()).add(item)
    return {n: (np.array(list(w), np.uint64), [sorted(x) for x in w.values()]) for n, w in found.items()}


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[dict]:
    """Compiled windows, in blocks; the items are read one after the other, so the driver holds one block of them."""
    held, n = [], 0
    for item, text in benchmark.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        held.append((item, text))
        n += max(1, len(text or "") // 4)
        if n >= BLOCK_WINDOWS:
            yield compile_windows(held, window)
            held, n = [], 0
    yield compile_windows(held, window)


class _Shard:
    """The lists of one shard, decoded as they are asked for."""

    def __init__(self, terms: bytes, counts: bytes, postings: bytes):
        self.terms = _unpack(terms, np.uint64)
        self.counts = _unpack(counts, np.int32)
        self.ends = np.cumsum(self.counts, dtype=np.int64)
        self.at = np.cumsum(_unpack(postings, np.int32), dtype=np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each term, -1 where the shard lacks it."""
        if not len(self.terms):
            return np.full(hashes.shape, -1)
        i = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[i] == hashes, i, -1)

    def positions(self, term: int) -> np.ndarray:
        return self.at[self.ends[term] - self.counts[term] : self.ends[term]]


def _near(places: np.ndarray, have: np.ndarray, slop: int, least: np.ndarray | int = 0, most: np.ndarray | int = np.iinfo(np.int64).max) -> np.ndarray:
    """Which places have an element of have, from least and to most, at a distance of at most slop."""
    i = np.searchsorted(have, np.maximum(places - slop, least))
    return (i < len(have)) & (have[np.minimum(i, len(have) - 1)] <= np.minimum(places + slop, most))


def _phrases(shard: _Shard, windows: np.ndarray, begins: np.ndarray, lengths: np.ndarray, slop: int | None) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
    """(window, kind, starts, documents) of the windows that occur; starts of proximity matches may lie outside of the document."""
    numbers = shard.find(windows)
    for w in np.flatnonzero((numbers >= 0).all(axis=1)):
        row = numbers[w]
        order = np.argsort(shard.counts[row], kind="stable")
        rare = shard.positions(row[order[0]])
        # Of two tokens that are each at most slop words from their places, one is at most twice as far from the other's.
        starts = rare - order[0]
        for offset in order[1:]:
            if not len(starts):
                break
            starts = starts[_near(starts + offset, shard.positions(row[offset]), 2 * (slop or 0))]
        if not len(starts):
            continue
        around = starts
        for offset in order[1:] if slop else ():
            starts = starts[_near(starts + offset, shard.positions(row[offset]), 0)]
        if len(starts):
            yield w, "exact", starts, np.searchsorted(begins, starts, "right") - 1
        if slop is None:
            continue
        docs = np.repeat(np.searchsorted(begins, around + order[0], "right") - 1, 2 * slop + 1)
        near = (around[:, None] + np.arange(-slop, slop + 1)).ravel()
        for offset in order:
            if not len(near):
                break
            least = begins[docs]
            held = _near(near + offset, shard.positions(row[offset]), slop, least, least + lengths[docs] - 1)
            near, docs = near[held], docs[held]
        if len(starts) and len(near):
            least = begins[docs]
            apart = ~_near(near, starts, slop, least, least + lengths[docs] - 1)
            near, docs = near[apart], docs[apart]
        if len(near):
            found = np.unique(np.stack([docs, near]), axis=1)
            yield w, "proximity", found[1], found[0]


def search(index: DataFrame, benchmark: DataFrame, window: int = 10, slop: int | None = None, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row a document: its number of words, the words inside exact matches, the items matched exactly, and all matches.

    slop: if given, proximity matches are returned too, and near_items are the items that have one in the document but no
    exact match there. matches: item, kind, first word, word after the last.
    """
    sc = index.sparkSession.sparkContext
    blocks = [sc.broadcast(b) for b in _blocks(benchmark, item_col, item_text_col, window)]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("item_id", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string())), ("matches", kinds)])
        for batch in batches:
            for row in batch.to_pylist():
                lengths = _unpack(row["lengths"], np.int32).astype(np.int64)
                begins = np.cumsum(lengths + 1) - lengths - 1
                shard = _Shard(row["terms"], row["counts"], row["postings"])
                hit = np.zeros(int((lengths + 1).sum()), bool)
                items: dict[str, dict[int, set[str]]] = {"exact": {}, "proximity": {}}
                matches: dict[int, list] = {}
                for block in blocks:
                    for n, (windows, owners) in block.value.items():
                        for w, kind, starts, docs in _phrases(shard, windows, begins, lengths, slop):
                            if kind == "exact":
                                hit[(starts[:, None] + np.arange(n)).ravel()] = True
                            for start, doc in zip(starts.tolist(), docs.tolist(), strict=True):
                                items[kind].setdefault(doc, set()).update(owners[w])
                                first = start - int(begins[doc])
                                matches.setdefault(doc, []).extend({"item_id": x, "kind": kind, "start": max(0, first), "end": min(first + n, int(lengths[doc]))} for x in owners[w])
                    if len(blocks) > 1:
                        vars(block).pop("_value", None)  # the next block takes its place in this worker's memory
                hits = np.add.reduceat(hit, begins) if len(begins) else np.empty(0, np.int64)
                order = range(len(lengths))
                exact = [items["exact"].get(i, set()) for i in order]
                near = [items["proximity"].get(i, set()) - exact[i] for i in order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(row["keys"], pa.int64()), pa.array(lengths), pa.array(hits.astype(np.int64)), pa.array([sorted(x) for x in exact], pa.list_(pa.string())), pa.array([sorted(x) for x in near], pa.list_(pa.string())), pa.array([matches.get(i, []) for i in order], kinds)],
                    schema=schema,
                )

    return index.mapInArrow(match, MATCH_SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int | None = None) -> DataFrame:
    """search() over a new index of docs."""
    return search(build_index(docs), benchmark, window, slop)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of the benchmark. Rows are told apart by id and text."""
    bad_key, bad_id, key = (fresh(docs, x) for x in ("bad_key", "bad_id", "row_key"))
    bad = checkpointed(decontaminate(docs, benchmark, window).filter("n_hit > 0").select(F.col("row_key").alias(bad_key), F.col("doc_id").alias(bad_id)).distinct())
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    same = (F.col(key) == F.col(bad_key)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(bad_id))
    return docs.withColumn(key, F.xxhash64("doc_id", "text")).join(bad, same, "left_anti").drop(key)
