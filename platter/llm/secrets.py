"""Secret scans through a trigram inverted index, in DataFrame operations only.

Each rule's regular expression gives a Boolean query over trigrams. The index holds the postings (trigram, document) of the
trigrams that the queries name, lower-cased; other lists could never be asked for. Intersecting the lists of each
alternative yields the candidate documents of each rule, and only there does the rule's expression run, over the whole
text. Rules without mandatory trigrams run over every document.

A document's postings come from one row, so they are combined before the shuffle to one bit set a document, and no list of
a frequent trigram is ever gathered. Candidates are stored and counted; up to BROADCAST_ROWS of them (16 bytes each) are
broadcast to the scan, more are joined by a shuffle.

Matches are placed without user code: the lengths of the matches and of the gaps between them give every offset.

Defined results: null and empty texts have no spans; spans are in code points, end exclusive, ordered by start and then by
kind in the order of RULES; rows are told apart by id and text, repeated rows are returned once each; null ids are kept;
other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.llm import trigrams
from platter.llm.common import checkpointed

BROADCAST_ROWS = 2_000_000


@dataclass(frozen=True)
class Rule:
    """kind; pattern, in the syntax that Java, RE2 and Python share; if a match's group 2 is shorter than least, it is dropped."""

    kind: str
    pattern: str
    least: int = 0


BASE_KINDS = ("assign", "access", "hex")
#: A run that is dropped for its length holds no other match, so access and hex state the length in the pattern.
RULES = (
    Rule("assign", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12),
    Rule("access", "AKIA[A-Z0-9]{14,}"),
    Rule("hex", "[0-9a-f]{16,}"),
    Rule("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY( BLOCK)?-----"),
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("map_key", "AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", "[rs]k_live_[A-Za-z0-9]{16,}"),
)


def _bits(names: list[str], chosen: frozenset[str]) -> list[int]:
    """A set of trigrams as 63-bit words."""
    return [sum(1 << i for i, n in enumerate(names[at : at + 63]) if n in chosen) for at in range(0, len(names), 63)]


def postings(docs: DataFrame, names: list[str]) -> DataFrame:
    """The inverted index of the named trigrams: (trigram, row_key), trigram being its number in names."""
    low = docs.select("row_key", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(n)), F.lit(i)) for i, n in enumerate(names)]))
    return low.select(F.explode(found).alias("trigram"), "row_key")


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row_key, rules): for each document that some indexed rule may match, the bit set of these rules."""
    queries = [trigrams.query(r.pattern) for r in rules]
    names = sorted({t for q in queries for one in q for t in one})
    lists = postings(docs, names)
    n_words = len(_bits(names, frozenset()))
    word = [F.expr(f"bit_or(CASE WHEN trigram DIV 63 = {w} THEN shiftleft(1L, trigram % 63) ELSE 0L END)").alias(f"w{w}") for w in range(n_words)]
    have = lists.groupBy("row_key").agg(*word)

    def holds(query: trigrams.Query) -> Column:
        every = [reduce(Column.__and__, [F.col(f"w{w}").bitwiseAND(F.lit(m)) == m for w, m in enumerate(_bits(names, one))]) for one in query]
        return reduce(Column.__or__, every)

    mask = reduce(Column.bitwiseOR, [F.when(holds(q), 1 << i).otherwise(0) for i, q in enumerate(queries)])
    return have.select("row_key", mask.cast("int").alias("rules")).filter("rules <> 0")


def _spans(rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, kind, end>> of a rule's matches in the column text."""
    hits = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    gaps = F.split("text", rule.pattern, -1)

    def piece(hit: Column, gap: Column) -> Column:
        # The last gap has no match after it.
        ok = hit.isNotNull() if not rule.least else F.length(F.regexp_extract(hit, rule.pattern, 2)) >= rule.least
        return F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(hit), F.lit(0)).alias("hit"), ok.alias("ok"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (start + x["hit"]).alias("end"))
        return F.struct((start + x["hit"]).alias("at"), F.when(x["ok"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.expr(_NONE).alias("spans"))
    return F.aggregate(F.zip_with(hits, gaps, piece), empty, step, lambda s: s["spans"])


_NONE = "cast(array() AS array<struct<start:int,rank:int,kind:string,end:int>>)"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): spans is array<struct<start, rank, kind, end>>."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("row_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    indexed = tuple(r for r in rules if frozenset() not in trigrams.query(r.pattern))
    if indexed:
        found = checkpointed(candidates(rows, indexed))
        few = found.count() <= BROADCAST_ROWS
        rows = rows.join(F.broadcast(found) if few else found, "row_key", "left")
    spans = []
    for rank, rule in enumerate(rules):
        here = _spans(rule, rank)
        if rule in indexed:
            here = F.when(F.col("rules").bitwiseAND(1 << indexed.index(rule)) != 0, here).otherwise(F.expr(_NONE))
        spans.append(here)
    return rows.select("doc_id", F.sort_array(F.concat(*spans)).alias("spans"))
