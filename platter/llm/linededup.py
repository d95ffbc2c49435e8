"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line is the set of its lower-cased words. It is removed if some earlier line, in the order of (id, line number), has a
Jaccard similarity of at least the threshold with it; so the first of any group of alike lines stays.

1. Texts are cut into lines and words once; lines are stored as arrays of word hashes, which all later steps read.
2. Equal lines are found by 128 bits of hash; only the first of them goes on, so a line that a third of all documents share
   is one row.
3. Lines that share one of four keys (their first or last words, or those of least or of greatest hash) with an earlier line
   are compared with the first of them. What this removes is removed for certain; in large groups of near copies it is all but a few lines, which
   is why the join that follows doesn't meet such groups pair by pair. It decides nothing else.
4. The corpus frequency of words is counted in a table of fixed size (2^16 buckets), whose logarithms fit in a literal. A
   word's rank is (class of its bucket, hash): a total order with rare words first, the same for all lines.
5. A line's words are ordered by rank, and its prefix (the rarest ones, enough to share one with any match) becomes
   postings (word, line). Postings of a word meet, unless both lines are removed already; both sides of that join read one
   shuffle. Length, position and a parity bitmap of the words (it cannot differ in more bits than the sets
   differ in words) reject pairs before they leave the join.
6. Candidates are verified on the whole sets.

Lines of so few words that only an equal set can reach the threshold (up to three at 80 %) have one posting, the hash of
the set, so that short lines of common words do not meet all others of a word.

Defined results: lines of fewer than min_chars characters (blanks at the ends not counted) are never removed and remove
none (with 1, as the registered query and the pipeline's stage have it, these are the lines without a word); null text has no lines and stays null; a text whose lines all go becomes empty; rows with a null id come after all
others, and rows that share an id are ordered by line number first; rows with equal id and text are one row to the join and
all get its result; an empty table gives an empty one; a text of any length is cut whole, and its lines meet others one by
one; other columns are kept untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.llm.common import Scratch, checkpointed, fresh

BUCKETS = 1 << 16
#: Rows of a few integers that are broadcast at most; beyond, the same join is done by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Words in a key of step 3.
KEY_WORDS = 3

#: Words are known by so many bits of their hash, which leaves a byte of a rank for the class.
_HASH = (1 << 56) - 1
LAST_ID = (1 << 63) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """128 bits for a row's id and text."""
    return [F.xxhash64(id_col, text_col), F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col))]


def _lines(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, k1, k2, line_no, s1, s2, line, ends, words, bits, more_bits) of the lines that count; line is a number of its own.

    s1 and s2 are hashes of the lower-cased line without blanks at its ends, ends of its first and its last words. Blanks
    stand for the other white space within lines, which is rare. words are the hashes of the different words, in order; bits
    and more_bits the parities of 128 classes of them, which cannot differ in more bits than two sets do in words.
    """
    doc, (k1, k2) = F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID)), _row_key(id_col, text_col)
    plain = F.col(text_col)
    odd = [F.contains(plain, F.lit(c)) for c in "\t\v\f\r"]
    plain = F.when(odd[0] | odd[1] | odd[2] | odd[3], F.regexp_replace(plain, "[\\t\\x0B-\\r]", " ")).otherwise(plain)
    found = docs.select(doc.alias("doc"), k1.alias("k1"), k2.alias("k2"), plain.alias("plain"))
    found = found.select("doc", "k1", "k2", F.posexplode(F.split("plain", "\n")).alias("line_no", "text")).withColumn("text", F.trim(F.lower("text")))
    # What is used more than once is a column first, so that it is computed once, and in compiled code where there is some.
    hashes = F.transform(F.array_remove(F.split("text", " "), ""), lambda w: F.xxhash64(w).bitwiseAND(F.lit(_HASH)))
    counts = F.length("text") >= min_chars if min_chars > 1 else F.col("text") != ""
    place = ("doc", "k1", "k2", "line_no", "s1", "s2", "line")
    found = found.select(*place[:4], F.xxhash64("text").alias("s1"), F.xxhash64(F.lit(1), F.col("text")).alias("s2"), F.monotonically_increasing_id().alias("line"), hashes.alias("hashes"), counts.alias("counts")).filter("counts")
    found = found.select(*place, _ends(F.col("hashes"), 0).alias("ends"), F.sort_array(F.array_distinct("hashes")).alias("words"))
    ones = [1 << i if i < 63 else -(1 << 63) for i in range(64)]

    def parity(ones: list[int]) -> Column:
        table, last = F.lit(ones), F.lit(len(ones) - 1)
        return F.aggregate("words", F.lit(0).cast("bigint"), lambda acc, h: acc.bitwiseXOR(F.get(table, h.bitwiseAND(last).cast("int"))))

    return found.select(*place, "ends", "words", parity(ones + [0] * 64).alias("bits"), parity([0] * 64 + ones).alias("more_bits"))


def _ends(words: Column, salt: int) -> Column:
    """Keys of the first and of the last words."""
    n = F.least(F.size(words), F.lit(KEY_WORDS))
    return F.array(F.xxhash64(F.lit(salt), F.slice(words, 1, n)), F.xxhash64(F.lit(salt + 1), F.slice(words, F.size(words) - n + 1, n)))


def word_classes(lines: DataFrame) -> Column:
    """For each bucket of word hashes the class of its corpus frequency, from 1 to 127 (four steps for each doubling)."""
    words = lines.select(F.explode("words").alias("w"))
    counts = words.groupBy(F.col("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket")).count()
    classes = [1] * BUCKETS
    for bucket, c in counts.select("bucket", F.least(F.lit(127), 1 + F.floor(F.log2("count") * 4)).cast("int")).collect():
        classes[bucket] = c
    return F.split(F.lit(",".join(map(str, classes))), ",").cast("array<bigint>")  # a constant to the optimizer


_PARTS = ("line", "place", "bits", "more_bits")
_UNDER = (1 << 32) - 1


def postings(lines: DataFrame, classes: Column, percent: int) -> DataFrame:
    """(word, line, place, bits, more_bits) of the prefixes of the lines.

    place holds a line's size, its words from the posting's on, and in the lowest bit whether it asks.
    """

    def rank(h: Column) -> Column:
        return F.shiftleft(F.get(classes, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), 56).bitwiseOR(h)

    size = F.size("ranks")
    overlap = F.floor((size * percent + 99) / 100).cast("int")  # the least one with any match
    # No set of one word more or less, nor another one of as many, can reach the threshold.
    alone = ((size + 1) * percent > size * 100) & ((size - 1) * 100 < size * percent) & ((size - 1) * (100 + percent) < size * 2 * percent)
    prefix = F.when(alone, F.array(F.xxhash64("ranks"))).otherwise(F.slice("ranks", 1, size - overlap + 1))
    found = lines.select("line", "asks", "bits", "more_bits", F.sort_array(F.transform("words", rank)).alias("ranks"))
    found = found.select("line", "asks", size.cast("bigint").alias("size"), "bits", "more_bits", F.posexplode(prefix).alias("pos", "word"))
    place = F.shiftleft("size", 32).bitwiseOR(F.shiftleft(F.col("size") - F.col("pos"), 1)).bitwiseOR(F.col("asks").cast("bigint"))
    found = found.withColumn("place", place).select("word", *_PARTS)
    # Both sides of the join read one shuffle only if no null tests are planned for one of them.
    return found.select(*[F.coalesce(c.name, F.lit(0).cast(c.dataType)).alias(c.name) for c in found.schema])


def _may_match(a: dict[str, Column], b: dict[str, Column], percent: int) -> Column:
    """The length and bitmap filters, for two lines of column size."""
    # An overlap o is enough if 100 o >= percent (total - o); sets of that overlap differ in total - 2 o words.
    total = a["size"] + b["size"]
    differ = F.bit_count(a["bits"].bitwiseXOR(b["bits"])) + F.bit_count(a["more_bits"].bitwiseXOR(b["more_bits"]))
    return (b["size"] * 100 >= a["size"] * percent) & (a["size"] * 100 >= b["size"] * percent) & (differ * (100 + percent) <= total * (100 - percent))


def candidates(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs (line, other) of which one asks.

    The generated code of the join must stay under 8,000 bytes a method, beyond which the virtual machine doesn't compile
    it; and nothing may be computed or filtered on one side alone, or each side has a shuffle of its own.
    """
    a, b = posts.alias("a"), posts.alias("b")
    mine, theirs = ({p: F.col(f"{s}.{p}") for p in _PARTS} | {"size": F.shiftright(f"{s}.place", 32), "rest": F.shiftright(F.col(f"{s}.place").bitwiseAND(F.lit(_UNDER)), 1)} for s in "ab")
    asked = (mine["line"] > theirs["line"]) & (mine["place"].bitwiseOR(theirs["place"]).bitwiseAND(F.lit(1)) == 1)
    placed = F.least(mine["rest"], theirs["rest"]) * (100 + percent) >= (mine["size"] + theirs["size"]) * percent
    met = a.join(b, (F.col("a.word") == F.col("b.word")) & asked & _may_match(mine, theirs, percent) & placed)
    return met.select(mine["line"].alias("line"), theirs["line"].alias("other")).distinct()


def _reached(scratch: Scratch, pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """(line, k1, k2, line_no) of the later line of each pair (line, other) that reaches the threshold."""
    named = scratch.by_size(pairs.select(F.explode(F.array("line", "other")).alias("line")).distinct(), BROADCAST_ROWS)
    whole = scratch.keep(lines.join(named, "line", "left_semi").select(F.struct("doc", "line_no", "k1", "k2", "line").alias("at"), "words"))
    mine, theirs = (whole.select(F.col("at.line").alias(x), F.col("at").alias(f"{x}_at"), F.col("words").alias(f"{x}_words")) for x in ("line", "other"))
    sizes = F.size("line_words") + F.size("other_words")
    met = pairs.join(mine, "line").join(theirs, "other").filter(F.size(F.array_intersect("line_words", "other_words")) * (100 + percent) >= sizes * percent)
    # Lines of one place are of two equal rows, or the same.
    met = met.filter(F.col("line_at").dropFields("line") != F.col("other_at").dropFields("line"))
    return scratch.keep(met.select(F.greatest("line_at", "other_at").alias("x")).select("x.line", "x.k1", "x.k2", "x.line_no").distinct())


def _first_lines(scratch: Scratch, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of which each differs from all others, and (k1, k2, line_no) of the repeats."""
    again = scratch.by_size(lines.groupBy("s1", "s2").count().filter("count > 1").select("s1", "s2"), BROADCAST_ROWS)
    # Rows that are equal altogether share a place; one of their lines goes on.
    places = scratch.keep(lines.join(again, ["s1", "s2"]).select("s1", "s2", F.struct("doc", "line_no", "k1", "k2").alias("at"), "line"))
    firsts = scratch.by_size(places.groupBy("s1", "s2").agg(F.min(F.struct("at", "line")).alias("x")).select("s1", "s2", F.col("x.at").alias("first"), F.col("x.line").alias("first_line")), BROADCAST_ROWS)
    repeats = scratch.keep(places.join(firsts, ["s1", "s2"]).filter("at <> first").select("at.k1", "at.k2", "at.line_no").distinct())
    return lines.join(firsts.select("s1", "s2", "first_line"), ["s1", "s2"], "left").filter("first_line IS NULL OR line = first_line").drop("first_line"), repeats


def _near_first(scratch: Scratch, lines: DataFrame, percent: int) -> DataFrame:
    """Pairs (line, other) of lines that share a key, each line with the first one of its keys."""
    keyed = lines.select("line", "doc", F.size("words").alias("size"), "bits", "more_bits", F.explode(F.concat("ends", _ends(F.col("words"), 2))).alias("key"))
    shared = scratch.by_size(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("first")).filter("n > 1").select("key", "first"), BROADCAST_ROWS)
    keyed = scratch.keep(keyed.join(shared, "key"))
    heads = scratch.by_size(keyed.filter("doc = first").groupBy("key").agg(F.min(F.struct("line", "size", "bits", "more_bits")).alias("b")), BROADCAST_ROWS)
    mine, theirs = ({p: F.col(f"{s}{p}") for p in ("line", "size", "bits", "more_bits")} for s in ("", "b."))
    met = keyed.join(heads, "key").filter((mine["line"] != theirs["line"]) & _may_match(mine, theirs, percent))
    return scratch.keep(met.select("line", theirs["line"].alias("other")).distinct())


def removed_lines(docs: DataFrame, percent: int = 80, min_chars: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, removed): the numbers, from 0, of the lines that each row loses; only rows that lose some."""
    scratch = Scratch(docs.sparkSession)
    every = scratch.keep(_lines(docs, min_chars, id_col, text_col), compression="zstd")
    lines, repeats = _first_lines(scratch, every)
    passing = Scratch(docs.sparkSession)
    near = scratch.keep(_reached(passing, _near_first(passing, lines, percent), every, percent))
    passing.drop()
    done = near.select("line", F.lit(True).alias("done"))
    done = F.broadcast(done) if near.count() <= BROADCAST_ROWS else done
    asking = lines.join(done, "line", "left").withColumn("asks", F.col("done").isNull())
    pairs = scratch.keep(candidates(postings(asking, word_classes(every), percent), percent))
    later = near.unionByName(_reached(scratch, pairs, every, percent))
    gone = repeats.unionByName(later.select("k1", "k2", "line_no")).groupBy("k1", "k2")
    gone = checkpointed(gone.agg(F.array_sort(F.collect_set("line_no")).alias("removed")))
    scratch.drop()
    return gone


def dedup(docs: DataFrame, percent: int = 80, min_chars: int = 25, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "removed") -> DataFrame:
    """docs with the kept lines as text, and the column removed_col: the numbers of the lines that went, in order."""
    k1, k2, lost = (fresh(docs, x) for x in ("k1", "k2", "lost_lines"))
    gone = removed_lines(docs, percent, min_chars, id_col, text_col).toDF(k1, k2, lost)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    keys = dict(zip((k1, k2), _row_key(id_col, text_col), strict=True))
    joined = docs.withColumns(keys).join(gone, [k1, k2], "left")

    def without(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(let(F.split(text_col, "\n"), without))
    removed = F.coalesce(F.col(lost), F.expr("cast(array() AS array<int>)"))
    kept = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(*kept, removed.alias(removed_col))
