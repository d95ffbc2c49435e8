"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the text's likelihood under byte-trigram models, the declared markup language and
the address suffix by how often each is seen with each language, and a prior of the host, smoothed towards that of its
domain and this towards that of the whole corpus. The text models are trained on a bounded sample of the rows that declare
each language (MAX_TRAIN of each, by a hash of the id), and a longer text counts as one of TEXT_MASS trigrams; everything else is counted over all rows by grouped aggregation, taking a row's
language from its text. Trigrams overlap, so their logarithms are tempered.

Languages are all declared ones with at least MIN_ROWS labelled rows, whatever their share. The joins carry a few numbers a row, never texts;
count tables of more than BROADCAST_ROWS rows are joined by a shuffle, whose hot host is split by adaptive execution.

Defined results: a null or empty text and one without letters has no text evidence and is rejected; a null or
empty declaration, suffix or host counts as no evidence of its kind; a row is rejected too if its best language has a
posterior below MIN_POSTERIOR; without any declared language nothing is known and all rows are rejected; repeated rows are
returned each; rows with a null id are judged like others; of languages that are as likely the first by name is taken; an
empty table gives an empty one; texts of any length are read whole; other columns, whatever their names, are kept by
keep_identified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.llm.common import checkpointed, fresh, identity, utf8

MAX_TRAIN = 20_000
#: Trigrams that a text counts as at most in training, so that no long text speaks for its language; a trigram is UNIT counts.
TEXT_MASS, UNIT = 2_000, 1 << 10
#: Labelled rows from which a language is one; fewer are taken for slips of the declaration.
MIN_ROWS = 3
#: Languages whose counts a task holds before it passes them on.
HELD_LANGUAGES = 256
MIN_POSTERIOR = 0.5
PLACES = 1 << 15
TEMPER = 0.15
#: Pseudo-counts of the smoothing.
PRIOR_WEIGHT, DECLARED_WEIGHT = 10.0, 1.0
BROADCAST_ROWS = 100_000

#: ASCII letters in lower case, all other ASCII as blanks: words in any script, without marks and digits.
_LETTERS = np.array([b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def trigrams(text: bytes) -> np.ndarray:
    """Places of the byte trigrams of a text's words, each word with a blank before and after."""
    if not text:
        return np.empty(0, np.int64)
    b = np.concatenate([[32], _LETTERS[np.frombuffer(text, np.uint8)], [32]]).astype(np.uint32)
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]
    mixed = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return (mixed >> np.uint32(17)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("declared").to_pylist(), utf8(batch.column("text")), strict=True):
            if lang not in total and len(total) >= HELD_LANGUAGES:
                yield from _flush(total, rows)
            total.setdefault(lang, np.zeros(PLACES, np.int64))
            at = trigrams(text)
            counts = np.bincount(at, minlength=PLACES)
            total[lang] += np.rint(counts * (UNIT * min(1.0, TEXT_MASS / max(1, len(at))))).astype(np.int64)
            rows[lang] = rows.get(lang, 0) + 1
    yield from _flush(total, rows)


def _flush(total: dict[str, np.ndarray], rows: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1)), pa.array(np.append(counts[at], rows[lang]))], ["lang", "place", "n"])
    total.clear()
    rows.clear()


def train(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood of each place under each). rows: id, text, declared."""
    labelled = rows.filter("declared IS NOT NULL AND declared <> '' AND text IS NOT NULL").select("id", "declared", "text")
    seen = checkpointed(labelled.groupBy("declared").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_ROWS))
    languages = sorted(r.declared for r in seen.collect())
    rates = _by_size(seen.select(F.col("declared").alias("named"), (F.lit(1_000_000 * MAX_TRAIN) / F.col("n")).alias("rate")))
    labelled = labelled.join(rates, F.col("declared") == F.col("named")).filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < F.greatest(F.lit(1.0), F.col("rate")))
    counted = checkpointed(labelled.select("declared", "text").mapInArrow(_counts, "lang string, place bigint, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n")))
    # PLACES numbers of each language reach the driver.
    model = np.zeros((len(languages), PLACES))
    number = {x: i for i, x in enumerate(languages)}
    for r in counted.filter("place >= 0").toLocalIterator():
        model[number[r.lang], r.place] = r.n / UNIT
    model += 0.5
    return languages, np.log(model / model.sum(axis=1, keepdims=True)) if len(languages) else model


def text_evidence(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """rows without text, with n_trigrams and the tempered log-likelihoods (the best is zero)."""
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.T.astype(np.float32)))
    kept = [c for c in rows.columns if c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likely, n = [], []
            for text in utf8(batch.column("text")):
                at = trigrams(text)
                at = at if len(at) > 1 or text.strip() else at[:0]
                total = np.zeros(shared.value.shape[1])
                for i in range(0, len(at), 1 << 20):
                    total += shared.value[at[i : i + (1 << 20)]].sum(axis=0, dtype=float)
                likely.append((total - total.max(initial=-np.inf)) * TEMPER if len(total) else total)
                n.append(len(at) if any(b >= 128 or 65 <= b & 0xDF <= 90 for b in text[:4096]) or any(b >= 128 or 65 <= b & 0xDF <= 90 for b in text[4096:]) else 0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(n, pa.int64()), pa.array(likely, pa.list_(pa.float64()))], [*kept, "n_trigrams", "likely"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "text")
    return rows.mapInArrow(score, f"{schema}, n_trigrams bigint, likely array<double>")


def _by_size(df: DataFrame) -> DataFrame:
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def identify(rows: DataFrame) -> DataFrame:
    """rows: id, row_key, text, declared, suffix, host. Returns id, row_key, language, posterior, text_language, kept."""
    clean = [F.when(F.trim(c) != "", F.lower(F.trim(c))).alias(c) for c in ("declared", "suffix", "host")]
    rows = rows.select("id", "row_key", "text", *clean)
    languages, model = train(rows)
    if not languages:
        return rows.select("id", "row_key", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_language"), F.lit(False).alias("kept"))
    scored = checkpointed(text_evidence(rows, model).withColumn("best", F.when(F.col("n_trigrams") > 0, F.array_position("likely", F.array_max("likely")).cast("int") - 1)))
    scored = scored.withColumn("domain", F.regexp_extract(F.coalesce("host", F.lit("")), "([^.]+(\\.[^.]+)?)$", 1))
    size = range(len(languages))
    counts = [F.count_if(F.col("best") == i).cast("double").alias(f"n{i}") for i in size]

    def given(kind: str) -> DataFrame:
        """log P(value | language), from how often it is seen with each."""
        seen = scored.filter(F.col(kind).isNotNull() & F.col("best").isNotNull()).groupBy(kind).agg(*counts)
        all_seen = seen.agg(*[F.sum(f"n{i}").alias(f"t{i}") for i in size], F.count("*").alias("values")).first()
        logs = [F.log((F.col(f"n{i}") + DECLARED_WEIGHT) / F.lit(float((all_seen[i] or 0) + DECLARED_WEIGHT * (all_seen["values"] + 1)))) for i in size]
        return _by_size(seen.select(F.col(kind).alias(f"{kind}_value"), F.array(*logs).alias(f"{kind}_log")))

    by_host = checkpointed(scored.filter("best IS NOT NULL").groupBy("domain", "host").agg(*counts))
    total = by_host.agg(*[F.sum(f"n{i}") for i in size]).first()
    corpus = [(x or 0) + 1.0 for x in total]
    corpus = [x / sum(corpus) for x in corpus]

    def smoothed(above: list[Column]) -> list[Column]:
        n = reduce(Column.__add__, [F.col(f"n{i}") for i in size])
        return [(F.col(f"n{i}") + PRIOR_WEIGHT * a) / (n + PRIOR_WEIGHT) for i, a in zip(size, above, strict=True)]

    domains = by_host.groupBy("domain").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in size]).select("domain", F.array(*smoothed([F.lit(c) for c in corpus])).alias("above"))
    hosts = by_host.filter("host IS NOT NULL").join(_by_size(domains), "domain").select(F.col("host").alias("host_value"), F.transform(F.array(*smoothed([F.get("above", F.lit(i)) for i in size])), lambda p: F.log(p)).alias("host_log"))
    joined = scored
    for kind, table in (("declared", given("declared")), ("suffix", given("suffix")), ("host", _by_size(hosts))):
        joined = joined.join(table, F.col(kind) == F.col(f"{kind}_value"), "left")

    def evidence(i: int) -> Column:
        parts = [F.when(F.col("n_trigrams") > 0, F.get("likely", F.lit(i))).otherwise(0.0)]
        parts += [F.coalesce(F.get(f"{kind}_log", F.lit(i)), F.lit(0.0)) for kind in ("declared", "suffix")]
        parts.append(F.coalesce(F.get("host_log", F.lit(i)), F.lit(float(np.log(corpus[i])))))
        return reduce(Column.__add__, parts)

    fused = joined.select("id", "row_key", "n_trigrams", "best", F.array(*[evidence(i) for i in size]).alias("e"))
    fused = fused.withColumn("top", F.array_max("e"))
    whole = F.aggregate("e", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    names = F.array(*[F.lit(x) for x in languages])
    posterior = 1.0 / whole
    return fused.select("id", "row_key", F.get(names, F.array_position("e", F.col("top")).cast("int") - 1).alias("language"), posterior.alias("posterior"), F.get(names, F.col("best")).alias("text_language"), ((F.col("n_trigrams") > 0) & (posterior >= MIN_POSTERIOR)).alias("kept"))


def document_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """documents as rows for identify: lang is the declaration, source stands for the host; there is no address."""
    return docs.select(F.col(id_col).cast("bigint").alias("id"), identity(id_col, text_col, declared_col, host_col).alias("row_key"), F.col(text_col).alias("text"), F.col(declared_col).alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col(host_col).alias("host"))


def page_rows(pages: DataFrame) -> DataFrame:
    """pages as rows for identify: the lang attribute, the last label of the host, and the text between tags."""
    from platter.llm.urlfilter import host

    text = F.regexp_replace(F.regexp_replace("html", "(?is)<(script|style)[^>]*>.*?</\\1>", " "), "<[^>]*>|&[#A-Za-z0-9]+;", " ")
    return pages.select(F.col("page_id").cast("bigint").alias("id"), identity("page_id", "url", "html").alias("row_key"), text.alias("text"), F.regexp_extract("html", "(?i)<html[^>]*\\blang=[\"']?([A-Za-z]+)", 1).alias("declared"), F.regexp_extract(host(F.col("url")), "\\.([a-z]+)$", 1).alias("suffix"), host(F.col("url")).alias("host"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """documents, with all their columns, whose language was found."""
    key, bad = fresh(docs, "row_key"), fresh(docs, "rejected_key")
    rejected = checkpointed(identify(document_rows(docs)).filter("NOT kept").select(F.col("row_key").alias(bad)).distinct())
    rejected = F.broadcast(rejected) if rejected.count() <= BROADCAST_ROWS else rejected
    return docs.withColumn(key, identity("doc_id", "text", "lang", "source")).join(rejected, F.col(key) == F.col(bad), "left_anti").drop(key)
