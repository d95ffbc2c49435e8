import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from platter.llm import language
from platter.llm.queries import op3_language, pages_language

SYLLABLES = {"aa": ["ka", "ti", "mo", "ru"], "bb": ["sch", "ein", "ung", "zt"], "cc": ["çé", "eau", "oi", "ñu"]}


def prose(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    out = []
    for i in range(300):
        lang = r.choice(sorted(SYLLABLES))
        out.append((i, prose(r, lang, 30), lang if r.random() < 0.9 else r.choice(sorted(SYLLABLES)), lang[0], f"h{i % 3}.{lang}.example", lang))
    return out


SCHEMA = "id long, row_key long, text string, declared string, suffix string, host string"


def found(spark, rows):
    return {r.id: r for r in language.identify(spark.createDataFrame([(i, i, t, d, s, h) for i, t, d, s, h in rows], SCHEMA)).collect()}


def test_text_decides_and_wrong_declarations_lose(spark, rows):
    got = found(spark, [x[:5] for x in rows])
    assert all(got[i].language == lang and got[i].kept for i, *_, lang in rows)


def test_other_evidence_decides_where_text_is_mute(spark, rows):
    more = [(1000, "k", None, None, "new.aa.example"), (1001, "k", "BB ", None, None), (1002, "k", None, "c", None), (1003, "", "aa", "a", "h0.aa.example"), (1004, None, None, None, None), (1005, "12 !", "aa", None, None), (None, prose(random.Random(3), "cc", 20), None, None, None)]
    got = found(spark, [*[x[:5] for x in rows], *more])
    assert (got[1000].language, got[1001].language, got[1002].language) == ("aa", "bb", "cc")
    assert not any(got[i].kept for i in (1003, 1004, 1005)) and got[None].language == "cc"


def test_equals_brute_force(spark, rows):
    """All of the fusion again in plain Python, given the text evidence."""
    frame = spark.createDataFrame([(i, i, t, d, s, h) for i, t, d, s, h, _ in rows], SCHEMA)
    names, model = language.train(frame)
    assert names == ["aa", "bb", "cc"]
    k, likely = len(names), {}
    for i, t, *_ in rows:
        ll = model[:, language.trigrams(t.encode())].astype(np.float32).sum(axis=1, dtype=float) * language.TEMPER
        likely[i] = ll - ll.max()
    best = {i: int(np.argmax(v)) for i, v in likely.items()}

    def counts(key):
        out = {}
        for x in rows:
            out.setdefault(key(x), np.zeros(k))[best[x[0]]] += 1
        return out

    declared, suffix = counts(lambda x: x[2]), counts(lambda x: x[3])
    host, domain = counts(lambda x: x[4]), counts(lambda x: ".".join(x[4].split(".")[-2:]))
    corpus = sum(host.values()) + 1
    corpus = corpus / corpus.sum()
    up = lambda n, above: (n + 10 * above) / (n.sum() + 10)
    got = found(spark, [x[:5] for x in rows])
    for i, _, d, s, h, _ in rows:
        e = likely[i] + np.log(up(host[h], up(domain[".".join(h.split(".")[-2:])], corpus)))
        e += np.log((declared[d] + 1) / (sum(declared.values()) + len(declared) + 1)) + np.log((suffix[s] + 1) / (sum(suffix.values()) + len(suffix) + 1))
        p = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        assert got[i].language == names[int(np.argmax(e))] and abs(got[i].posterior - p.max()) < 1e-4


def test_shuffled_tables_and_bounded_sample(spark, rows, monkeypatch):
    monkeypatch.setattr(language, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(language, "MAX_TRAIN", 100)
    got = found(spark, [x[:5] for x in rows])
    assert np.mean([got[i].language == lang for i, *_, lang in rows]) > 0.98


def test_empty_and_undeclared(spark):
    assert found(spark, []) == {}
    assert [(r.language, r.kept) for r in found(spark, [(1, "some text", None, None, None)]).values()] == [(None, False)]


def test_long_text(spark, rows):
    got = found(spark, [*[x[:5] for x in rows], (5000, "einungzt " * 300_000, "aa", "a", "h0.aa.example")])
    assert got[5000].language == "bb"


def test_queries_and_filter(spark, rows, tmp_path):
    docs = spark.createDataFrame([(i, t, d, h, 1, "x") for i, t, d, _, h, _ in rows] + [(7, rows[7][1], rows[7][2], rows[7][4], 1, "x"), (900, "!!", None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, row_key string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert op3_language(spark, str(tmp_path)).count() == docs.count()
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    html = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://user@www.Shop.example:80/x?y"), "doc_id").alias("url"), F.concat(F.lit("<!DOCTYPE html>\n<html class='a' lang='"), "lang", F.lit("'><script>var x = 1</script><p>"), "text").alias("html"))
    html.write.parquet(f"{tmp_path}/pages.parquet")
    got = pages_language(spark, str(tmp_path)).filter("page_id < 900").collect()
    truth = {x[0]: x[5] for x in rows}
    assert all(r.language == truth[r.page_id] for r in got)


def test_small_and_many_languages(spark, rows, monkeypatch):
    """Languages of five rows each, far under one in two hundred, and more than 64 of them."""
    r = random.Random(7)
    own = {f"l{k:02}": [chr(0x400 + 4 * k + j) * 2 for j in range(4)] for k in range(70)}
    word = lambda lang: "".join(r.choice(own[lang]) for _ in range(3))
    small = [(10_000 + 10 * k + i, " ".join(word(lang) for _ in range(30)), lang, None, None) for k, lang in enumerate(own) for i in range(5)]
    large = [(x[0] + 300 * k, *x[1:5]) for x in rows for k in range(10)]
    few = [(20_000 + i, small[0][1], "slip", None, None) for i in range(2)]
    monkeypatch.setattr(language, "MAX_TRAIN", 500)
    names, _ = language.train(spark.createDataFrame([(i, i, t, d, s, h) for i, t, d, s, h in [*large, *small, *few]], SCHEMA))
    assert names == sorted([*SYLLABLES, *own])
    one = [x for x in small if x[2] == "l07"]
    got = found(spark, [*large, *one, (30_000, one[0][1], None, None, None)])
    assert all(got[x[0]].language == "l07" and got[x[0]].kept for x in one) and got[30_000].language == "l07"
