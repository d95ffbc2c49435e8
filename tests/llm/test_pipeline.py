"""The pipeline against the brute-force versions of its stages."""

import random

import pytest
from test_decontamination import brute as contaminated
from test_linededup import brute as removed
from test_resemblance import alike, brute_set, classes
from test_simhash import brute_print

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables():
    r = random.Random(8)
    vocabulary = [a + b for a in ("tor", "mel", "shan", "del", "qui") for b in ("a", "en", "ith", "ou", "er", "ing")]

    def prose(lines):
        return "\n".join(" ".join(r.choice(vocabulary) + r.choice(["", "s", "ed"]) for _ in range(r.randint(8, 40))) for _ in range(lines))

    items = [(i, " ".join(r.choice(vocabulary) for _ in range(14))) for i in range(5)]
    docs = []
    for i in range(60):
        text = prose(r.randint(1, 6))
        if i % 9 == 4:
            text += "\n" + r.choice(docs)[1]
        if i % 11 == 5:
            text = docs[i - 1][1]
        if i % 10 == 7:
            text += " and " + r.choice(items)[1].upper()
        docs.append((i, text, "en" if i % 3 else "fr", f"src{i % 4}", len(text)))
    # Copies of one-line texts, a word changed, cut into lines of which none is like the original's: line dedup leaves them.
    for i in range(70, 76):
        words = [r.choice(vocabulary) + r.choice(["", "s", "ed"]) for _ in range(120)]
        docs.append((i, " ".join(words), "en", "src0", len(" ".join(words))))
        words[r.randrange(40)] = "changed"
        text = "\n".join(" ".join(words[at : at + 40]) for at in (0, 40, 80))
        docs.append((i + 10, text, "en", "src1", len(text)))
    return [*docs, (60, "1234 !!", "en", "src0", 7), (61, None, "en", None, None), (62, "", None, "src1", 0), (63, docs[3][1], "fr", "src9", 1)], items


def write(spark, path, docs, items):
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_equal_brute_force(spark, tables, tmp_path):
    docs, items = tables
    write(spark, tmp_path, docs, items)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    have = {d[0]: d for d in docs}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        if name != "mixing":
            assert out.columns == frame.columns
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        frame = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        rows = [(i, have[i][1]) for i in sorted(have)]
        if name == "language ID":
            want = {i: t for i, t in rows if t and any(c.isalpha() for c in t)}
        elif name == "line dedup":
            cut = [(i, t, lost) for (i, t), lost in zip(rows, removed(rows, min_chars=1), strict=True)]
            want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost) for i, t, lost in cut}
            want = {i: t for i, t in want.items() if t.strip()}
        elif name == "near dedup":
            prints, sets = [brute_print(t) for _, t in rows], [brute_set(t) for _, t in rows]
            near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3 or alike(sets[a], sets[b])  # noqa: B023, E731
            want = {rows[k][0]: rows[k][1] for k in set(classes(len(rows), near))}
        elif name == "decontamination":
            want = {i: have[i][1] for i, _, n_hit, _ in contaminated(rows, items) if not n_hit}
        else:
            assert {r.doc_id: r.text for r in frame.collect()}.items() <= {i: d[1] for i, d in have.items()}.items()
            assert 0 < frame.count() < len(have)
            continue
        got = {r.doc_id: r for r in frame.collect()}
        assert {i: r.text for i, r in got.items()} == want, name
        assert len(want) < len(have), f"{name} had nothing to do"
        assert all(r.n_chars == len(r.text) for i, r in got.items() if i != 63)
        have = {i: tuple(got[i]) for i in got}


def test_run_and_empty_table(spark, tables, tmp_path):
    write(spark, f"{tmp_path}/some", *tables)
    assert corpus_pipeline.run(spark, f"{tmp_path}/some").count() > 0
    write(spark, f"{tmp_path}/none", [], tables[1])
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_equal_rows_of_one_class_have_an_order(spark, tables):
    text = tables[0][0][1]
    docs = [(1, text, "en", x, 5) for x in ("b", "a", "c")] + [(2, text, "en", "a", 5), (3, "quite another text", "en", "a", 5)]
    for k in (1, 3):
        got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, SCHEMA).repartition(k), "").collect()
        assert sorted((r.doc_id, r.source) for r in got) == [(1, "a"), (3, "a")]


def test_five_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "near dedup", "decontamination", "mixing"]


def test_nulls_repeats_and_further_columns(spark, tables, tmp_path):
    docs = [(*d, "x") for d in tables[0][:12]] + [(*tables[0][2], "x"), (None, tables[0][1][1], None, None, None, None), (None, None, None, None, None, None)]
    frame = spark.createDataFrame(docs, SCHEMA + ", row_key string")
    write(spark, tmp_path, tables[0], tables[1])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        out.collect()
        if name != "mixing":
            assert out.columns == frame.columns
