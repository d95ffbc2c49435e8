import random

import pytest
from test_simhash import brute_print

import corpus_pipeline
from platter.llm import resemblance
from platter.llm.components import connected


def brute_set(text, shingle=5):
    words = text.lower().split()
    return {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def alike(x, y):
    return bool(x and y) and len(x & y) * 100 >= 80 * len(x | y)


def classes(n, linked):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    common = " ".join(vocabulary[:30])
    out = ["", " \n", "one two", "One  TWO", "a b c d e", "a b c d f"]
    for k in range(14):
        words = [r.choice(vocabulary) for _ in range(r.choice([8, 40, 120, 300]))] + (common.split() if k % 2 else [])
        out.append(" ".join(words))
        for _ in range(r.choice([1, 4, 9])):
            changed = list(words)
            for _ in range(r.randint(1, max(1, len(words) // 30))):
                changed[r.randrange(len(words))] = r.choice([*vocabulary, "new"])
            out.append(" ".join(changed))
            words = changed if r.random() < 0.4 else words
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("common, bound", [(8, 1_000_000), (2, 0), (10**9, 1_000_000)])
def test_links_equal_brute_force(spark, texts, monkeypatch, common, bound):
    """Any order of the shingles gives the same classes: with few, many or none of them put last."""
    monkeypatch.setattr(resemblance, "COMMON", common)
    monkeypatch.setattr(resemblance, "BROADCAST_ROWS", bound)
    docs = spark.createDataFrame([(t,) for t in [*texts, texts[8], None]], "text string").repartition(3)
    keys = {r.text: r.k for r in docs.selectExpr("text", "xxhash64(text) AS k").collect()}
    roots = {r.node: r.root for r in connected(resemblance.links(docs, 80, 5)).collect()}
    sets = [brute_set(t) for t in texts]
    want = classes(len(texts), lambda i, j: alike(sets[i], sets[j]))
    got = [roots.get(keys[t], keys[t]) for t in texts]
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(texts)) for j in range(i))
    assert len(set(want)) < len(want)


def test_stage_removes_copies_beyond_three_bits(spark, texts):
    prints, sets = [brute_print(t) for t in texts], [brute_set(t) for t in texts]
    near = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3
    want = classes(len(texts), lambda i, j: near(i, j) or alike(sets[i], sets[j]))
    assert len(set(want)) < len(set(classes(len(texts), near)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(set(want))
