import random

import pytest

from platter.llm import linededup


def brute(rows, percent=80, min_chars=25):
    """row -> removed line numbers; every pair of lines is compared."""
    lines = []
    for n, (doc, text) in enumerate(rows):
        for i, line in enumerate((text or "").split("\n") if text is not None else []):
            low = line.lower().strip(" ")
            if len(low) >= min_chars:
                lines.append((doc if doc is not None else 1 << 62, i, n, low, frozenset(low.split())))
    lines.sort(key=lambda x: x[:3])
    removed = {n: set() for n in range(len(rows))}
    for k, (_, i, n, low, words) in enumerate(lines):
        for *_, other, have in lines[:k]:
            common = len(words & have)
            if other == low or common * 100 >= percent * (len(words) + len(have) - common):
                removed[n].add(i)
                break
    return [sorted(removed[n]) for n in range(len(rows))]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    vocabulary = [f"word{i}" for i in range(400)]

    def line(n):
        return " ".join(vocabulary[min(399, int(r.expovariate(0.02)))] for _ in range(n))

    base = [line(r.choice([3, 5, 8, 9, 10, 20, 40, 90])) for _ in range(40)]

    def near(text):
        words = text.split()
        for _ in range(r.randint(0, max(1, len(words) // 7))):
            words[r.randrange(len(words))] = r.choice([*vocabulary, "New", "É"])
        r.random() < 0.2 and r.shuffle(words)
        return r.choice([" ", "  ", "\t"]).join(words)

    out = []
    for i in range(60):
        lines = [r.choice([near(r.choice(base)), r.choice(base), line(12), "", "short", r.choice(base).upper()]) for _ in range(r.randint(0, 8))]
        out.append((i, "\n".join(lines)))
    return [*out, (70, None), (71, ""), (72, "\n\n"), (73, base[0] + "\n" + base[0] + " \n" + "x" * 60), (None, near(base[3]) + "\n" + line(15))]


@pytest.mark.parametrize("few, bound", [(0, 1_000_000), (3, 1_000_000), (3, 0)])
def test_equals_brute_force(spark, rows, monkeypatch, few, bound):
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(linededup, "KEY_WORDS", max(1, few))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row_key string")
    got = linededup.dedup(docs, removed_col="went")
    assert got.columns == ["doc_id", "text", "row_key", "went"]
    want = {i: (cut, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut)) for (i, t), cut in zip(rows, brute(rows), strict=True)}
    assert {r.doc_id: (r.went, r.text) for r in got.collect()} == want
    assert any(cut for cut, _ in want.values())


def test_groups_of_near_lines(spark):
    """Lines that are near their group's first, or only near others of it."""
    r = random.Random(1)
    rows = []
    for g in range(30):
        words = [f"g{g}w{i}" for i in range(30)]
        for k in range(6):
            cut = r.sample(range(30), 5)
            rows.append((g * 10 + k, " ".join(w if i not in cut else f"{w}x{k % 3}" for i, w in enumerate(words))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.removed for x in linededup.dedup(docs).collect()}
    assert got == {i: cut for (i, _), cut in zip(rows, brute(rows), strict=True)}


def test_repeated_rows_share_their_result(spark):
    text = "one line that is long enough to count here\nanother line that is long enough to count"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.removed) for r in linededup.dedup(docs).collect()) == [(1, []), (1, []), (2, [0, 1])]


def test_empty_table_and_no_python(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    got = linededup.dedup(docs)
    assert got.count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_short_lines_take_part_in_query_and_stage(spark, tmp_path):
    """Lines of every length, down to one letter, against brute force; lines without a word stay."""
    import corpus_pipeline
    from platter.llm.queries import op2_line_dedup

    r = random.Random(4)
    words = ["all", "rights", "reserved.", "Menu", "a", "é", "next", "page"]
    rows = [(i, "\n".join(" ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6]))) for _ in range(6))) for i in range(40)]
    rows += [(50, "All rights reserved.\n \n\n reserved. all  rights"), (51, "Menu\nonly here\n\nMENU ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: cut for (i, _), cut in zip(rows, brute(rows, min_chars=1), strict=True)}
    assert 3 in want[50] and 3 in want[51]
    assert {x.doc_id: x.removed_lines for x in op2_line_dedup(spark, str(tmp_path)).collect()} == {i: ",".join(map(str, cut)) for i, cut in want.items()}
    texts = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) for i, t in rows}
    got = {x.doc_id: x.text for x in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {i: t for i, t in texts.items() if not want[i] or t.strip()}


def test_very_long_text_and_repeated_rows_of_an_id(spark):
    long = "\n".join(f"w{i} x{i} y{i} z{i}" for i in range(100_000)) + "\nw7 x7 y7 z7"
    rows = [(1, long), (2, "w9 x9 y9 z9\nnew words here"), (2, "new words here\nw9 x9 y9 z9"), (2, "new words here\nw9 x9 y9 z9")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, k1 int, lost_lines int")
    got = linededup.dedup(docs, min_chars=1)
    assert got.columns == ["doc_id", "text", "k1", "lost_lines", "removed"]
    assert sorted((r.doc_id, r.removed) for r in got.collect()) == [(1, [100_000]), (2, [0, 1]), (2, [1]), (2, [1])] or sorted((r.doc_id, r.removed) for r in got.collect()) == [(1, [100_000]), (2, [0]), (2, [0, 1]), (2, [0, 1])]
