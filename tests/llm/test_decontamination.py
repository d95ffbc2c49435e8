import random
import re

import duckdb
import pyarrow as pa
import pytest

from platter.llm import decontamination as dc
from platter.llm.sql import DECONTAMINATION

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for doc, text in docs:
        have, hit, found = words(text), set(), set()
        for item, passage in items:
            want = words(passage)
            n = min(window, len(want))
            for i in range(len(want) - n + 1 if n else 0):
                for j in range(len(have) - n + 1):
                    if have[j : j + n] == want[i : i + n]:
                        hit.update(range(j, j + n))
                        found.add(str(item))
        out.append((doc, len(have), len(hit), sorted(found)))
    return out


def brute_near(docs, items, slop, window=10):
    """The items of each document that a place holds whose words are at most slop words from theirs, but no exact window."""
    exact, out = [x[3] for x in brute(docs, items, window)], []
    for (doc, text), without in zip(docs, exact, strict=True):
        have, found = words(text), set()
        for item, passage in items:
            want = words(passage)
            n = min(window, len(want))
            for i in range(len(want) - n + 1 if n else 0):
                for s in range(-n, len(have) + n):
                    if all(want[i + k] in have[max(0, s + k - slop) : max(0, s + k + slop + 1)] for k in range(n)):
                        found.add(str(item))
        out.append((doc, sorted(found - set(without))))
    return out


def make(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "ñu", "𝔸b"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)] + [(3, "again an item of that number " * 3), (90, None), (91, ""), (92, " .,- ")]
    docs = []
    for i in range(80):
        parts = [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(parts))
            parts[at:at] = words(r.choice(items)[1])
        docs.append((i, "".join(w + r.choice([" ", "\n", ", ", "--"]) for w in parts).upper() if i % 3 else " ".join(parts)))
    return [*docs, (80, None), (81, ""), (82, "w1"), (5, docs[5][1]), (None, docs[4][1])], items


@pytest.mark.parametrize("block", [dc.BLOCK_WINDOWS, 5])
def test_equals_brute_force(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_WINDOWS", block)
    docs, items = make(spark, *corpus)
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in dc.decontaminate(docs.repartition(3), items).collect()]
    key = lambda x: (x[0] is None, x)
    assert sorted(got, key=key) == sorted(brute(*corpus), key=key)
    assert any(x[2] for x in got)


def test_matches_and_proximity(spark):
    item = "one two three four five six seven eight nine ten"
    docs, items = make(spark, [(1, f"zero {item} end"), (2, item.replace("five", "five odd")), (3, "one two three")], [(7, item)])
    rows = {r.doc_id: r for r in dc.decontaminate(docs, items, slop=2).collect()}
    assert [tuple(m) for m in rows[1].matches] == [("7", "exact", 1, 11)]
    assert rows[2].n_hit == 0 and {m.kind for m in rows[2].matches} == {"proximity"}
    assert rows[3].matches == []


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_proximity_equals_brute_force(spark, corpus, slop):
    r = random.Random(slop)
    docs, items = corpus
    moved = []
    for i, (_, passage) in enumerate(items):
        have = words(passage)
        for _ in range(2 if have else 0):
            have.insert(r.randint(0, len(have)), "odd")
            j = r.randrange(len(have))
            have[j:j + 2] = have[j:j + 2][::-1]
        moved.append((200 + i, " ".join(["before", *have, "after"])))
    # The start of a passage at the end of one document and its rest at the start of the next are no match.
    head, rest = words(items[-5][1])[:5], words(items[-5][1])[5:]
    docs = [*docs, *moved, (300, " ".join(head)), (301, " ".join(rest)), (302, "")]
    frames = make(spark, docs, items)
    got = [(x.doc_id, x.near_items) for x in dc.decontaminate(frames[0].coalesce(1), frames[1], slop=slop).collect()]
    key = lambda x: (x[0] is None, x)
    want = brute_near(docs, items, slop)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(x[1] for x in want) == (slop > 0)


def test_remove_keeps_columns_and_clean_rows(spark):
    item = " ".join(f"t{i}" for i in range(12))
    docs = spark.createDataFrame([(1, item, "a", 1), (2, "clean", "b", 2), (None, None, None, None), (1, "clean too", "a", 3)], "doc_id long, text string, row_key string, bad_key int")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = dc.remove_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.text or "" for r in kept.collect()) == ["", "clean", "clean too"]


def test_empty_tables(spark):
    docs, items = make(spark, [], [])
    assert dc.decontaminate(docs, items).count() == 0
    some, _ = make(spark, [(1, "a b")], [])
    assert [(r.n_words, r.n_hit) for r in dc.decontaminate(some, items).collect()] == [(2, 0)]


def test_long_text(spark):
    item = " ".join(f"t{i}" for i in range(10))
    docs, items = make(spark, [(1, "word " * 400_000 + item)], [(1, item)])
    assert [(r.n_words, r.n_hit) for r in dc.decontaminate(docs, items).collect()] == [(400_010, 10)]


def test_sql_finds_the_same_proximity_matches(spark, corpus):
    r = random.Random(11)
    items = [(i, t) for i, t in corpus[1][:12] if t]
    docs = [(i, t) for i, t in corpus[0] if i is not None and i != 5]
    for i, (_, passage) in enumerate(items):
        have = words(passage)
        have.insert(r.randint(0, len(have)), "odd")
        docs.append((200 + i, " ".join(["before", *have, "after"])))
    frames = make(spark, docs, items)
    got = {x.doc_id: ",".join(x.near_items) for x in dc.decontaminate(*frames, slop=2).collect()}
    with duckdb.connect() as db:
        db.register("documents", pa.table({"doc_id": [d for d, _ in docs], "text": pa.array([t for _, t in docs], pa.string())}))
        db.register("benchmark", pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}))
        want = dict(db.execute(f"SELECT doc_id, near_items FROM ({DECONTAMINATION})").fetchall())
    assert got == want
    assert any(want.values())
