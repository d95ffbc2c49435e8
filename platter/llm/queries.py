"""The registered training-data queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platter.llm import decontamination, language, linededup, mixing, pii, quality, rules, secrets, simhash, urlfilter
from platter.llm.common import span_count, span_text, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels of two thirds of the ids."""
    docs = table(spark, sf_dir, "documents")
    held = quality.held_out(F.col("doc_id"))
    weights = quality.train(docs, table(spark, sf_dir, "labels").filter(~held))
    scored = docs.select("doc_id", held.alias("held_out"), quality.scorer(spark, weights)("text").alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that an earlier line resembles."""
    docs = table(spark, sf_dir, "documents")
    found = linededup.dedup(docs.select("doc_id", "text", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("bigint").alias("n_lines")), percent=80, min_chars=1)
    return found.select("doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"), F.sha2("text", 256).alias("kept_sha256"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; lang is the declaration, source stands for the host."""
    return language.identify(language.document_rows(table(spark, sf_dir, "documents"))).select(F.col("id").alias("doc_id"), "language", F.round("posterior", 6).alias("posterior"), "text_language", "kept")


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page, from its text, lang attribute, address suffix and host."""
    return language.identify(language.page_rows(table(spark, sf_dir, "pages"))).select(F.col("id").alias("page_id"), "language", F.round("posterior", 6).alias("posterior"), "text_language", "kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the learned decision list on every document."""
    labels = table(spark, sf_dir, "labels").filter(~quality.held_out(F.col("doc_id")))
    return rules.judge(table(spark, sf_dir, "documents"), labels)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = table(spark, sf_dir, "documents").select("doc_id", pii.pii_spans("text").alias("found"))
    return found.select("doc_id", *[span_count(F.col("found"), k).alias(f"n_{k}") for k in pii.BASE_KINDS], F.sha2(span_text(F.col("found"), pii.BASE_KINDS), 256).alias("base_sha256"), span_text(F.col("found")).alias("spans"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as captures. The table has no fetch time, so the page's number gives it: an hour within the year 2024."""
    hour = F.pmod(F.col("page_id") * 7919, F.lit(8760))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.timestamp_seconds(1704067200 + 3600 * hour).alias("at"))


def list_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dated lists over the hosts of pages, made from digests of the entries, as no list comes with the tables.

    Of a digest's hexadecimal digits, the first says whether there is an entry, the next what it does, and pairs of the
    others are days of the first half year: it is added, removed after as many days, and perhaps added again.
    """
    host = urlfilter.host(F.col("url"))
    hosts = table(spark, sf_dir, "pages").select(host.alias("host")).filter("host <> ''").distinct()
    names = F.array(F.col("host"), F.regexp_extract("host", "([^.]+\\.[^.]+\\.[^.]+)$", 1), *[F.concat("host", F.lit(f"/{x}")) for x in ("en", "fr")])
    entries = hosts.select(F.explode(names).alias("entry")).filter("entry <> ''").distinct()
    entries = entries.select("entry", F.explode(F.array(F.lit("blocked"), F.lit("exempt"))).alias("list"))
    entries = entries.withColumn("digest", F.md5(F.concat("list", F.lit(":"), "entry").cast("binary")))
    number = lambda start, length: F.conv(F.substring("digest", start, length), 16, 10).cast("int")
    entries = entries.filter((number(1, 1) < 6) | (F.col("list") == "blocked") & (number(1, 1) < 12))
    first, second, third = number(2, 2) % 180, number(4, 2), number(6, 2)
    days = F.array(F.struct(F.lit("add").alias("action"), first.alias("day")), F.struct(F.lit("remove").alias("action"), (first + second).alias("day")), F.struct(F.lit("add").alias("action"), F.when(third < 128, first + second + third).alias("day")))
    dated = entries.select("list", "entry", (F.col("list") == "blocked").alias("blocks"), F.explode(days).alias("x")).filter("x.day IS NOT NULL")
    return dated.select("list", "entry", "blocks", "x.action", F.timestamp_seconds(1704067200 + 86400 * F.col("x.day").cast("bigint")).alias("at"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's capture against the list entries that were active when it was fetched."""
    judged = urlfilter.judge(captures(spark, sf_dir), list_changes(spark, sf_dir))
    return judged.select(F.col("id").alias("page_id"), "url", F.col("at").alias("fetched_at"), "blocked", "list", "entry", "since")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-word passages of benchmark items in every document, and items of which words were put in, left out or moved."""
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, slop=2)
    near = (F.size("near_items").cast("bigint").alias("n_near_items"), F.array_join(F.array_sort("near_items"), ",").alias("near_items"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), *near)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    found = simhash.classes(table(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Targets: tokens to these powers, so that large sources and languages are damped and forms are even; three tenths of all tokens.
MIX_TARGETS, MIX_SHARE = {"source": 0.5, "lang": 0.5, "topic": 0.0}, 0.3


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling probability and fate of every document under the raked mix."""
    found = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), MIX_TARGETS, MIX_SHARE)
    return found.select("doc_id", "source", "lang", "mix.topic", F.col("mix.tokens").alias("n_tokens"), F.round("mix.probability", 6).alias("probability"), "mix.kept")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[span_count(F.col("spans"), k).alias(f"n_{k}") for k in secrets.BASE_KINDS], F.sha2(span_text(F.col("spans"), secrets.BASE_KINDS), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_language": op3_language,
    "op4_quality_rules": op4_quality_rules,
    "op5_pii": op5_pii,
    "op6_url_filter": op6_url_filter,
    "op7_decontamination": op7_decontamination,
    "op8_simhash": op8_simhash,
    "op9_mixing": op9_mixing,
    "op10_secrets": op10_secrets,
    "pages_language": pages_language,
}
