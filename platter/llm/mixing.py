"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted as tokens in cells (source, language, topic). Raking scales the cells' weights to one marginal after
the other until all three hold. The ratio of a cell's weight to its tokens, times one factor, is the probability of its documents; the
factor is solved so that the expected tokens are the wanted share of all, with no probability above one. A document stays
if a number that its id fixes, uniform in [0, 1), is below its cell's probability.

Only cell totals leave the scan, combined before the shuffle, so a source of any size costs one row a task. Up to
LOCAL_CELLS cells the raking runs on the driver; more of them are raked as a table, in the same steps.

Defined results: null source, language or topic is a value of its own; null text has no tokens; a document of no tokens
stays with its cell's probability, one of a cell without tokens never; target values without cells are left out and
the others scaled to one; cells of a value without a target get weight zero; repeated rows share their fate; rows with a
null id are sampled by their text; other columns are kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.llm.common import SPACES, checkpointed, fresh

LOCAL_CELLS = 100_000
SWEEPS, ROUNDS = 30, 20
DIMENSIONS = ("source", "lang", "topic")


def n_tokens(text: Column) -> Column:
    """Words of a text."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")).cast("bigint")


def form(text: Column, tokens: Column) -> Column:
    """A stand-in for a topic where none is given: the form of a text."""
    return F.when(F.contains(text, F.lit(" | ")), "table").when(tokens < 100, "short").when(tokens < 1000, "prose").otherwise("long")


def cells(docs: DataFrame) -> DataFrame:
    """docs has the three dimensions and tokens. Null is told from every text by a sign before the others."""
    keys = [F.when(F.col(d).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(d).cast("string"))).alias(d) for d in DIMENSIONS]
    return docs.select(*keys, "tokens").groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))


def _shares(totals: dict[str, float], target: dict[str, float] | float) -> dict[str, float]:
    """Target shares of the values; a number t stands for tokens to the power t."""
    raw = {v: float(x) ** target if x else 0.0 for v, x in totals.items()} if not isinstance(target, dict) else {v: float(target.get(v[1:] if v != "-" else None, 0.0)) for v in totals}
    whole = sum(raw[v] for v, x in totals.items() if x)
    return {v: raw[v] / whole if x and whole else 0.0 for v, x in totals.items()}


def _rake_local(rows: list, targets: dict, share: float) -> list[tuple]:
    if not rows:
        return []
    tokens = np.array([float(r.tokens) for r in rows])
    total = tokens.sum()
    weight = tokens / total if total else tokens
    codes, goals = {}, {}
    for d in DIMENSIONS:
        values = sorted({r[d] for r in rows})
        number = {v: i for i, v in enumerate(values)}
        codes[d] = np.array([number[r[d]] for r in rows])
        sums = np.bincount(codes[d], tokens, len(values))
        shares = _shares(dict(zip(values, sums.tolist(), strict=True)), targets[d])
        goals[d] = np.array([shares[v] for v in values])
    for _ in range(SWEEPS):
        for d in DIMENSIONS:
            sums = np.bincount(codes[d], weight, len(goals[d]))
            weight = weight * np.divide(goals[d], sums, out=np.zeros_like(sums), where=sums > 0)[codes[d]]
    ratio = np.divide(weight, tokens, out=np.zeros_like(tokens), where=tokens > 0)
    factor = share * total
    for _ in range(ROUNDS):
        full = ratio * factor >= 1
        rest = (ratio * tokens)[~full].sum()
        factor = (share * total - tokens[full].sum()) / rest if rest > 0 else factor
    p = np.minimum(1.0, ratio * factor)
    return [(*(r[d] for d in DIMENSIONS), float(x)) for r, x in zip(rows, p, strict=True)]


def _rake_table(found: DataFrame, targets: dict, share: float) -> DataFrame:
    """The steps of _rake_local over a table of cells."""
    total = found.agg(F.sum("tokens")).first()[0] or 0
    table = found.withColumn("weight", F.col("tokens") / F.lit(float(total or 1)))
    for d in DIMENSIONS:
        sums = found.groupBy(d).agg(F.sum("tokens").alias("sum"))
        if isinstance(targets[d], dict):
            given = found.sparkSession.createDataFrame([("-" if k is None else f"+{k}", float(v)) for k, v in targets[d].items()], f"{d} string, raw double")
            raw = sums.join(given, d, "left").select(d, F.when(F.col("sum") > 0, F.coalesce("raw", F.lit(0.0))).otherwise(0.0).alias("raw"))
        else:
            raw = sums.select(d, F.when(F.col("sum") > 0, F.pow(F.col("sum").cast("double"), F.lit(float(targets[d])))).otherwise(0.0).alias("raw"))
        whole = raw.agg(F.sum("raw")).first()[0] or 1.0
        table = table.join(raw.select(d, (F.col("raw") / whole).alias(f"goal_{d}")), d)
    table = checkpointed(table)
    for _ in range(SWEEPS):
        for d in DIMENSIONS:
            sums = table.groupBy(d).agg(F.sum("weight").alias("sum"))
            table = table.join(sums, d).withColumn("weight", F.when(F.col("sum") > 0, F.col("weight") * F.col(f"goal_{d}") / F.col("sum")).otherwise(0.0)).drop("sum")
        table = checkpointed(table)
    table = table.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    factor = share * total
    for _ in range(ROUNDS):
        full = F.col("ratio") * factor >= 1
        rest, capped = table.agg(F.sum(F.when(~full, F.col("ratio") * F.col("tokens"))), F.sum(F.when(full, F.col("tokens")))).first()
        new = (share * total - (capped or 0)) / rest if rest else factor
        if new == factor:
            break
        factor = new
    return table.select(*DIMENSIONS, F.least(F.lit(1.0), F.col("ratio") * factor).alias("probability"))


def probabilities(found: DataFrame, targets: dict, share: float) -> DataFrame:
    """(source, lang, topic, probability) of all cells."""
    found = checkpointed(found)
    if found.count() > LOCAL_CELLS:
        return _rake_table(found, targets, share)
    rows = _rake_local(found.collect(), targets, share)
    return F.broadcast(found.sparkSession.createDataFrame(rows, ", ".join(f"{d} string" for d in DIMENSIONS) + ", probability double"))


def uniform(id_column: Column, text: Column) -> Column:
    """48 bits of a digest of the id, as a number in [0, 1)."""
    digest = F.md5(F.coalesce(id_column.cast("string"), text, F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def mix(docs: DataFrame, targets: dict[str, dict | float], share: float, source: Column | None = None, lang: Column | None = None, topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text", out_col: str = "mix") -> DataFrame:
    """docs with the column out_col, a name that docs do not have: struct(source, lang, topic, tokens, probability, kept)."""
    tokens = n_tokens(F.col(text_col))
    dims = {"source": F.col("source") if source is None else source, "lang": F.col("lang") if lang is None else lang, "topic": form(F.col(text_col), tokens) if topic is None else topic}
    counted = docs.select(*[c.cast("string").alias(d) for d, c in dims.items()], tokens.alias("tokens"))
    found = probabilities(cells(counted), targets, share)
    made = {d: fresh(docs, f"mix_{d}") for d in (*DIMENSIONS, "tokens", "probability")}
    own, theirs = ({d: fresh(docs, f"mix_{d}_{x}") for d in DIMENSIONS} for x in ("own", "key"))
    columns = docs.columns
    docs = docs.select("*", *[c.cast("string").alias(made[d]) for d, c in dims.items()], tokens.alias(made["tokens"]))
    key = {d: F.when(F.col(made[d]).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(made[d]))) for d in DIMENSIONS}
    found = found.select(*[F.col(d).alias(theirs[d]) for d in DIMENSIONS], F.col("probability").alias(made["probability"]))
    joined = docs
    for d in DIMENSIONS:
        joined = joined.withColumn(own[d], key[d])
    joined = joined.join(found, [F.col(own[d]) == F.col(theirs[d]) for d in DIMENSIONS], "left")
    p = F.coalesce(F.col(made["probability"]), F.lit(0.0))
    kept = uniform(F.col(id_col), F.col(text_col)) < p
    return joined.select(*columns, F.struct(*[F.col(made[d]).alias(d) for d in DIMENSIONS], F.col(made["tokens"]).alias("tokens"), p.alias("probability"), kept.alias("kept")).alias(out_col))
