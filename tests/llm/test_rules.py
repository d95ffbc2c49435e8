import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from platter.llm import rules
from platter.llm.queries import op4_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    hit = set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    out = []
    for i in range(250):
        words = [r.choice(["a", "b", "é", "𝔸x", "c#", "<d>", "E!", "7"] if i % 2 else [f"w{k}" for k in range(300)]) for _ in range(r.randint(0, 60))]
        out.append("".join(w + r.choice([" ", "  ", "\n", "\t", "\x0b", "\r\n", "\x0c", " ", "\n\n"]) for w in words))
    phrase = "one two three four five six "
    return [*out, None, "", " \n\t", "a", "a b c d e", phrase * 2, phrase + "x " + phrase, "same line here\n" * 3 + " \n", phrase * 20_000, " ".join(f"u{k}" for k in range(120_000))]


def test_base_numbers(spark, texts):
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: tuple(r)[1:7] for r in rules.measured(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t and t[:80]


def labelled(n=900):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        words = [f"{r.choice('abcdefgh')}{r.randint(0, 999)}x" for _ in range(r.randint(15, 60))]
        bad = i % 3 == 0
        if bad:
            words = [w + "##" for w in words] if i % 2 else [w.upper() + "!" for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad)))
    return docs, labels


def test_texts_of_more_words_than_fit_beside_a_hash(spark, texts, monkeypatch):
    monkeypatch.setattr(rules, "_POSITION_BITS", 3)
    test_base_numbers(spark, texts)


def test_learned_list_holds_on_other_rows(spark, tmp_path):
    docs, labels = labelled()
    spark.createDataFrame([*docs, (None, None), (5, docs[5][1])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1), (10_000, 0), (7, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op4_quality_rules(spark, str(tmp_path))
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = got.collect()
    assert len(rows) == len(docs) + 2
    truth = dict(labels)
    import zlib

    held = [r for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.kept == bool(truth[r.doc_id]) for r in held]) > 0.97
    assert all(not r.kept for r in rows if r.base_failed)


def test_conditions_are_ordered_and_pruned(spark):
    docs, labels = labelled()
    bad = {i for i, q in labels if not q}
    rows = rules.measured(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("bad", F.col("doc_id").isin(list(bad)))
    learned = rules.learn(rows)
    assert 1 <= len(learned) <= rules.MAX_RULES and all(1 <= len(r) <= rules.MAX_CONDITIONS for r in learned)
    first = rows.withColumn("rule", rules.fired(learned)).groupBy("rule", "bad").count().collect()
    assert {(r.rule > 0) == r.bad for r in first} == {True}


def test_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(i, "word " * 4 + " ".join(f"x{i}{k}" for k in range(20))) for i in range(30)], "doc_id long, text string")
    for labels in ([], [(i, 1) for i in range(30)]):
        got = rules.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert all(r.kept and r.rule == 0 for r in got)
    assert rules.judge(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")).count() == 0
