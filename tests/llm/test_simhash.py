import random

import numpy as np
import pytest
import xxhash

from platter.llm import golay, simhash


def brute_print(text, shingle=3):
    words = []
    for w in (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" "):
        if w:
            words.append("".join(c.lower() if "A" <= c <= "Z" else c for c in w))
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    """(id, print) -> least id reachable."""
    n = len(rows)
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [min(rows[j][0] for j in range(n) if root(j) == root(i)) for i in range(n)]


def test_golay_is_perfect():
    words = np.arange(1 << 23, dtype=np.int32)
    codes = np.unique(words[golay.index(words) == words >> 11][:0])
    checks, errors = golay._tables()
    assert len(np.unique(errors)) == 2048 and max(int(e).bit_count() for e in errors) == 3
    codes = (np.arange(4096) << 11 | checks).astype(np.int64)
    assert min(int(c).bit_count() for c in codes[1:]) == 7


def test_near_indices_meet():
    r = np.random.default_rng(1)
    words = r.integers(0, 1 << 22, 300)
    for distance in (0, 1, 2):
        other = words.copy()
        for i in range(len(words)):
            for b in r.choice(22, distance, replace=False):
                other[i] ^= 1 << b
        a, b = golay.near(words, 22)[0], golay.near(other, 22)[0]
        assert all(set(x) & set(y) for x, y in zip(a, b, strict=True))
        if distance < 2:
            assert all(i in set(y) for i, y in zip(golay.index(words), b, strict=True))


def test_keys_meet_at_every_error_pattern():
    r = np.random.default_rng(2)
    prints = r.integers(0, 1 << 64, 400, dtype=np.uint64)
    for distance in range(4):
        for _ in range(6):
            other = prints.copy()
            for i in range(len(prints)):
                for b in r.choice(64, distance, replace=False):
                    other[i] ^= np.uint64(1) << np.uint64(b)
            (ka, ra), (kb, rb) = simhash.keys(prints), simhash.keys(other)
            have = [set(ka[ra == i]) & set(kb[rb == i]) for i in range(len(prints))]
            assert all(have)


@pytest.mark.parametrize("text", ["", None, " \n", "a", "A b", "a b c", "É Über the\x0bQuick\tbrown fox  JUMPS\r\nover", "x " * 500, "    a b"])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == brute_print(text)


def test_long_text():
    text = " ".join(f"w{i % 7919}" for i in range(200_000))
    assert simhash.fingerprint(text.encode()) == brute_print(text)


@pytest.fixture(scope="module")
def prints():
    r = random.Random(3)
    out = []
    for _ in range(60):
        p = r.getrandbits(64)
        out.append(p)
        for _ in range(r.choice([0, 0, 1, 3, 25])):
            q = p
            for b in r.sample(range(64), r.randint(0, 4)):
                q ^= 1 << b
            out.append(q)
            if r.random() < 0.5:
                p = q
    return out


@pytest.mark.parametrize("most", [8192, 8])
def test_classes_equal_brute_force(spark, prints, monkeypatch, most):
    """most = 8 sends the long runs to the words around their members."""
    from platter.llm.components import connected

    monkeypatch.setattr(simhash, "MAX_RUN", most)
    signed = sorted({int(np.uint64(p).view(np.int64)) for p in prints})
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3))
    roots = {r.node: r.root for r in connected(edges).collect()}
    unsigned = [(p, int(np.int64(p).view(np.uint64))) for p in signed]
    assert [roots.get(p, p) for p in signed] == brute_classes(unsigned)


def docs_of(spark):
    r = random.Random(9)
    base = [" ".join(r.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(r.randint(0, 50)) for _ in range(120)) for _ in range(12)]
    rows = []
    for i, b in enumerate(base):
        rows.append((i * 10, b, "a"))
        words = b.split()
        for k in range(i % 4):
            words[r.randrange(120)] = f"new{k}"
            rows.append((i * 10 + k + 1, " ".join(words), None))
    rows += [(900, None, None), (901, "", "x"), (902, "  ", "x"), (5, base[0], "again"), (10, base[1], "a"), (None, base[2], None), (None, "only here without an id", None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, row_key string")


def test_documents(spark):
    rows, docs = docs_of(spark)
    got = simhash.classes(docs).collect()
    assert len(got) == len(rows)
    with_id = [(i, brute_print(t)) for i, t, _ in rows if i is not None]
    want = sorted(zip([i for i, _ in with_id], [p for _, p in with_id], brute_classes(with_id), strict=True))
    assert sorted((g.doc_id, int(np.int64(g.fp).view(np.uint64)), g.component_id) for g in got if g.doc_id is not None) == want
    assert {g.component_id for g in got if g.doc_id is None} == {20, None}


def test_one_row_of_each_class_stays(spark):
    rows, docs = docs_of(spark)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    with_id = [(i, brute_print(t)) for i, t, _ in rows if i is not None]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(brute_classes(with_id)))
    assert kept.filter("doc_id IS NULL").count() == 1


def test_empty_table(spark):
    assert simhash.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
