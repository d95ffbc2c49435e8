"""Quality rules as a learned decision list, in DataFrame operations only.

Numbers are measured on each text with built-in functions. Sequential covering then learns what marks low quality: a rule
starts empty and grows by the threshold condition with the largest information gain on the growing rows, then loses the
last conditions for as long as that does not hurt on the pruning rows; what it covers is taken out, and the next rule is
learned from the rest, until a rule no longer pays. All that reaches the driver are counts of (feature, bin, label). The list becomes one Spark
CASE expression.

Defined results: null text has no words and base_failed is true; repeated rows are returned each; rows with a null id are
judged but never learned from; labels that are null, or of no document, are not used; a document labelled twice counts with its
lower label; without labels of both kinds no rule is learned, and kept is the opposite of base_failed; rows that the base
rejects are not learned from; of conditions with equal gain the first by feature and threshold is taken; an empty table gives
an empty one; texts of any length are measured whole, those of more than 2^24 words by a slower sort; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.llm.common import checkpointed, words
from platter.llm.linededup import let

BINS = 24
MAX_RULES, MAX_CONDITIONS = 8, 3
MIN_COVERED = 10
#: A rule stays if at least this share of the pruning rows that it covers is of low quality.
MIN_PRECISION = 0.8
#: Bits of a window's hash that are sorted with its position; two different cuts of the hash must agree.
_POSITION_BITS = 24

FEATURES = ("n_words", "mean_word", "symbol_rate", "repeat_rate", "dup_line_rate", "capital_rate", "mark_rate", "digit_rate", "words_per_line")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


Rule = tuple[Condition, ...]


def n_repeat_words(found: Column) -> Column:
    """Words in five-word windows that occur twice or more in the array of words found."""

    def of_hashes(h: Column) -> Column:
        mask = F.lit((1 << _POSITION_BITS) - 1)

        def positions(cut: Column) -> Column:
            """Positions of windows whose cut hash occurs again: equal ones are neighbours once sorted."""
            packed = F.sort_array(F.transform(cut, lambda x, i: x.bitwiseAND(F.lit(~((1 << _POSITION_BITS) - 1))).bitwiseOR(i.cast("bigint"))))

            def paired(s: Column) -> Column:
                high = F.transform(s, lambda x: F.shiftright(x, _POSITION_BITS))
                after = F.zip_with(high, F.slice(high, 2, F.size(high)), lambda a, b: a == b)  # null at the end
                before = F.concat(F.array(F.lit(False)), F.slice(after, 1, F.size(after) - 1))
                return F.filter(F.zip_with(s, F.zip_with(after, before, lambda a, b: F.coalesce(a, F.lit(False)) | b), lambda x, same: F.when(same, x.bitwiseAND(mask).cast("int"))), lambda x: x.isNotNull())

            return let(packed, paired)

        def far_positions(h: Column) -> Column:
            """The same for windows too many to be numbered beside a hash: hash and position are sorted as two numbers."""

            def paired(s: Column) -> Column:
                after = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
                before = F.concat(F.array(F.lit(False)), F.slice(after, 1, F.size(after) - 1))
                return F.filter(F.zip_with(s, F.zip_with(after, before, lambda a, b: a | b), lambda x, same: F.when(same, x["i"])), lambda x: x.isNotNull())

            return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), paired)

        both = F.array_intersect(positions(h), positions(F.transform(h, lambda x: F.shiftleft(x, 40).bitwiseOR(F.shiftrightunsigned(x, 24)))))

        def covered(p: Column) -> Column:
            gaps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(5)), F.lit(5)))
            return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(F.array_sort(F.when(F.size(h) <= 1 << _POSITION_BITS, both).otherwise(far_positions(h))), covered))

    windows = let(found, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)])))
    return F.when(F.size(found) < 5, 0).otherwise(let(windows, of_hashes)).cast("bigint")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base numbers and the features of every text."""
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select("doc_id", "_text", words(text).alias("_words"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit("[^ \\t-\\r]")))
    n_dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    count = lambda pattern: F.length(F.regexp_replace("_text", pattern, "")).cast("bigint")
    rows = rows.select(
        "doc_id",
        F.size("_words").cast("bigint").alias("n_words"),
        count("[ \\t-\\r]+").alias("word_chars"),
        count("[^#*$%&|<>]+").alias("n_symbols"),
        n_dup.cast("bigint").alias("n_dup_lines"),
        n_repeat_words(F.col("_words")).alias("n_repeat_words"),
        count("[^A-Z]+").alias("_capitals"),
        count("[^!?;:]+").alias("_marks"),
        count("[^0-9]+").alias("_digits"),
        (F.length("_text") - count("\\n+") + 1).alias("_lines"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1))
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    per_word = {"mean_word": "word_chars", "symbol_rate": "n_symbols", "repeat_rate": "n_repeat_words", "capital_rate": "_capitals", "mark_rate": "_marks", "digit_rate": "_digits"}
    rates = [(F.col(c) / n).alias(f) for f, c in per_word.items()]
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), *rates, (F.col("n_dup_lines") / F.col("_lines")).alias("dup_line_rate"), (F.col("n_words") / F.col("_lines")).alias("words_per_line"))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's gain of a condition that leaves p of p0 and n of n0."""
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> list[tuple[Condition, int, int]]:
    """Conditions, each the best after the ones before."""
    rule: list[tuple[Condition, int, int]] = []
    while len(rule) < MAX_CONDITIONS:
        tally: dict[tuple[int, int], list[int]] = {}
        for r in rows.select(F.posexplode("bins").alias("feature", "bin"), "bad").groupBy("feature", "bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect():
            tally[r.feature, r.bin] = [r.p, r.n]
        p0 = sum(p for (f, _), (p, _) in tally.items() if f == 0)
        n0 = sum(n for (f, _), (_, n) in tally.items() if f == 0)
        if p0 < MIN_COVERED or n0 == 0:
            break
        best = (0.0, None, 0, 0)
        for f, name in enumerate(FEATURES):
            p = n = 0
            for i, cut in enumerate(cuts[name]):
                dp, dn = tally.get((f, i), (0, 0))
                p, n = p + dp, n + dn
                for above, (x, y) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    if x >= MIN_COVERED and (g := _gain(x, y, p0, n0)) > best[0] + 1e-9:
                        best = (g, Condition(name, above, cut), x, y)
        if best[1] is None:
            break
        rule.append(best[1:])
        rows = rows.filter(best[1].column())
    return rule


def learn(rows: DataFrame) -> list[Rule]:
    """The decision list. rows: doc_id, the features, bad (boolean)."""
    cuts: dict[str, list[float]] = {}
    shares = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in FEATURES], *[F.percentile_approx(F.when(F.col("bad"), F.col(f)), shares, 10_000).alias(f"{f}_bad") for f in FEATURES]).first()
    for f in FEATURES:
        cuts[f] = sorted({float(x) for x in [*(found[f] or []), *(found[f"{f}_bad"] or [])]})
    bins = F.array(*[sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)) for f in FEATURES])
    rows = checkpointed(rows.select("bad", *FEATURES, bins.alias("bins"), (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3)) == 0).alias("prune")))
    rules: list[Rule] = []
    left = rows
    while len(rules) < MAX_RULES:
        grown = [c for c, _, _ in _grow(left.filter("NOT prune"), cuts)]
        if not grown:
            break
        # One pass over the pruning rows: what each beginning of the rule covers.
        sums, covers = [], F.lit(True)
        for i, c in enumerate(grown):
            covers = covers & c.column()
            sums += [F.count_if(covers & F.col("bad")).alias(f"p{i}"), F.count_if(covers & ~F.col("bad")).alias(f"n{i}")]
        tally = left.filter("prune").agg(*sums).first()
        worth = [(tally[f"p{i}"] - tally[f"n{i}"]) / max(1, tally[f"p{i}"] + tally[f"n{i}"]) for i in range(len(grown))]
        end = worth.index(max(worth))
        p, n = tally[f"p{end}"], tally[f"n{end}"]
        if p == 0 or p / (p + n) < MIN_PRECISION:
            break
        rule = tuple(grown[: end + 1])
        rules.append(rule)
        left = left.filter(~_covers(rule))
    return rules


def _covers(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def fired(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = F.lit(0)
    for i in reversed(range(len(rules))):
        out = F.when(_covers(rules[i]), i + 1).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base numbers, base_failed, kept, and rule: the number of the rule that rejects, or 0."""
    rows = checkpointed(measured(docs, id_col, text_col))
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label")).filter("_label IN (0, 1)")
    # What the base rejects needs no rule.
    learned = learn(rows.filter(~F.col("base_failed")).join(known, F.col("doc_id") == F.col("_id")).select("doc_id", *FEATURES, (F.col("_label") == 0).alias("bad")))
    rule = fired(learned)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (rule == 0)).alias("kept"), rule.alias("rule"))
