import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from platter.llm import secrets, trigrams

BASE = {
    "assign": (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
}


def brute(text):
    """The base kinds by their contract's patterns; the others by their own."""
    spans = [(m.start(), i, k, m.end()) for i, (k, (p, ok)) in enumerate(BASE.items()) for m in p.finditer(text or "") if ok(m)]
    for i, rule in enumerate(secrets.RULES[3:], 3):
        spans += [(m.start(), i, rule.kind, m.end()) for m in re.finditer(rule.pattern, text or "")]
    return sorted(spans)


PIECES = ["password", "PassWd", "secret", "token", "api_key", "apikey", "api-key", '"', "'", " ", "=", ":", "abc", "Zz9+/_.=-", "0123456789ab", "deadbeefdeadbeef", "0123456789abcdef0123", "AKIA", "AKIAAKIA", "ABCDEFGH12345678", "é", "𝔸", "\n", "ſecret", "K",
          "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-1234567890", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM", "AIza" + "x" * 35, "sk_live_" + "9" * 16, "|", "0", "f"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    made = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 30))) for _ in range(400)]
    return [*made, None, "", "plain words only", "password: token: ABCDEFGHIJKLMNOP", "token=" + "x" * 50_000, "filler " * 150_000 + "secret = abcdefghijklmnop"]


def test_equals_brute_force(spark, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], None), (0, texts[0], "again")]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, rules string")).collect()
    assert len(got) == len(rows)
    want = sorted([(-1 if i is None else i, brute(t)) for i, t, _ in rows])
    assert sorted([(-1 if r.doc_id is None else r.doc_id, [tuple(s) for s in r.spans]) for r in got]) == want
    assert {s[2] for _, x in want for s in x} == {r.kind for r in secrets.RULES}


def test_shuffled_candidates(spark, texts, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = sorted((r.doc_id, str(r.spans)) for r in secrets.scan(docs).collect())
    monkeypatch.setattr(secrets, "BROADCAST_ROWS", 0)
    assert sorted((r.doc_id, str(r.spans)) for r in secrets.scan(docs).collect()) == near


def test_no_python_in_the_plan(spark, texts):
    plan = secrets.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_queries_are_necessary(rule, texts):
    query = trigrams.query(rule.pattern)
    for text in texts:
        if re.search(rule.pattern, text or ""):
            low = text.lower()
            assert any(all(t in low for t in one) for one in query)


def test_queries():
    assert trigrams.query("[0-9a-f]+") == trigrams.ANY
    assert trigrams.query("abcd") == [frozenset({"abc", "bcd"})]
    assert sorted(map(sorted, trigrams.query("(abc|xyz)+[0-9]*"))) == [["abc"], ["xyz"]]
    assert trigrams.query("(abc)?") == trigrams.ANY
    assert trigrams.query("ab.cd") == trigrams.ANY


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.sampled_from(["a", "b", "abc", "[ab]", "[a-z]", "."]), lambda x: st.one_of(st.tuples(x, x).map("".join), st.tuples(x, x).map(lambda p: f"({p[0]}|{p[1]})"), x.map(lambda p: f"({p})?"), x.map(lambda p: f"({p})+"), x.map(lambda p: f"({p}){{2}}")), max_leaves=8), st.text(alphabet="abcx", max_size=14))
def test_any_match_satisfies_the_query(pattern, text):
    if found := re.fullmatch(pattern, text):
        assert any(all(t in found[0] for t in one) for one in trigrams.query(pattern))
