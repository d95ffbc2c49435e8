import datetime as dt
import random
from urllib.parse import urlsplit

import pytest

from platter.llm import urlfilter

DAY = dt.datetime(2024, 1, 1)


def brute_keys(url):
    host = (urlsplit(url).hostname or "") if url and "://" in url else ""
    if not host:
        return []
    parts = urlsplit(url).path.removeprefix("/").split("/")
    out = [host + "/" + "/".join(parts[:n]) for n in (2, 1) if len(parts) >= n and parts[n - 1]]
    labels = host.split(".")
    return out + [".".join(labels[i:]) for i in range(6) if len(labels) - i >= 2]


def brute(captures, changes):
    out = []
    for ident, url, at in captures:
        verdict = (False, None, None, None)
        found = []
        for rank, key in enumerate(brute_keys(url)) if at else []:
            for name, blocks in sorted({(c[0], c[2]) for c in changes}):
                active, since = False, None
                for _, _, _, action, when in sorted((c for c in changes if c[0] == name and c[1] and c[1].lower() == key and c[4] and c[3] in ("add", "remove") and c[4] <= at), key=lambda c: (c[4], c[3])):
                    since = when if action == "add" and not active else since
                    active = action == "add"
                if active:
                    found.append((rank, not blocks, name, key, since))
        if found:
            _, allows, name, key, since = min(found)
            verdict = (not allows, name, key, since)
        out.append((ident, url, at, *verdict))
    return out


@pytest.fixture(scope="module")
def case():
    r = random.Random(2)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "x.test.org", "test.org"]
    captures = [(i, f"http{'s' * (i % 2)}://{r.choice(['', 'me@'])}{r.choice(hosts).upper() if i % 5 == 0 else r.choice(hosts)}{r.choice(['', ':80'])}{r.choice(['', '/', '/en', '/en/1', '/fr/2?x=/en', '#t', '//en'])}", DAY + dt.timedelta(hours=r.randint(0, 4000))) for i in range(300)]
    captures += [(400, None, DAY), (401, "no address", DAY), (402, "http://example.com/", None), (None, "http://example.com/", DAY + dt.timedelta(90)), (3, *captures[3][1:]), (404, "http:///x", DAY)]
    changes = []
    for entry in [*hosts, "a.example.com/en", "x.test.org/fr/2", "Example.com/EN"]:
        for name, blocks in (("bad", True), ("good", False), ("worse", True)):
            for _ in range(r.randint(0, 5)):
                changes.append((name, entry, blocks, r.choice(["add", "remove", "add"]), DAY + dt.timedelta(days=r.randint(0, 150))))
    changes += [("bad", None, True, "add", DAY), ("bad", "test.org", True, "add", None), ("bad", "test.org", True, "odd", DAY)]
    return captures, changes


SCHEMAS = "id long, url string, at timestamp", "list string, entry string, blocks boolean, action string, at timestamp"


@pytest.mark.parametrize("few", [200_000, 0])
def test_equals_brute_force(spark, case, monkeypatch, few):
    monkeypatch.setattr(urlfilter, "BROADCAST_ROWS", few)
    captures, changes = (spark.createDataFrame(x, s) for x, s in zip(case, SCHEMAS, strict=True))
    judged = urlfilter.judge(captures.withColumnsRenamed({}).selectExpr("*", "1 AS entry", "'x' AS list"), changes)
    key = lambda x: (x[0] is None, str(x))
    got = sorted((tuple(r) for r in judged.collect()), key=key)
    assert got == sorted(brute(*case), key=key)
    assert any(r[3] for r in got) and any(r[4] == "good" for r in got)
    plan = judged._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_bounds_of_an_interval(spark):
    changes = spark.createDataFrame([("l", "e.org", True, "add", DAY), ("l", "e.org", True, "remove", DAY + dt.timedelta(days=100))], SCHEMAS[1])
    at = [DAY - dt.timedelta(seconds=1), DAY, DAY + dt.timedelta(days=100, seconds=-1), DAY + dt.timedelta(days=100)]
    got = urlfilter.judge(spark.createDataFrame([(i, "http://e.org/", t) for i, t in enumerate(at)], SCHEMAS[0]), changes)
    assert [r.blocked for r in got.orderBy("id").collect()] == [False, True, True, False]


def test_empty(spark, case):
    none = [spark.createDataFrame([], s) for s in SCHEMAS]
    assert urlfilter.judge(none[0], spark.createDataFrame(case[1], SCHEMAS[1])).count() == 0
    assert not any(r.blocked for r in urlfilter.judge(spark.createDataFrame(case[0], SCHEMAS[0]), none[1]).collect())


@pytest.mark.parametrize("few", [200_000, 0])
def test_deep_paths_and_hosts_of_many_labels(spark, monkeypatch, few):
    monkeypatch.setattr(urlfilter, "BROADCAST_ROWS", few)
    host = "a.b.c.d.e.f.g.h.example.com"
    entries = ["x.org/a/b/c", "x.org/a/b", "y.org/" + "/".join("pqrstuvw"), "h.example.com", "example.net"]
    changes = spark.createDataFrame([("l", e, True, "add", DAY) for e in entries], SCHEMAS[1])
    urls = ["http://x.org/a/b/c/d?q", "http://x.org/a/b/x", "http://x.org/a", "http://y.org/p/q/r/s/t/u/v/w", "http://y.org/p/q/r/s/t/u/v/", f"http://{host}/", "http://" + "z." * 70 + "example.net/a/b/c/d"]
    got = urlfilter.judge(spark.createDataFrame([(i, u, DAY) for i, u in enumerate(urls)], SCHEMAS[0]), changes)
    assert [r.entry for r in got.orderBy("id").collect()] == [entries[0], entries[1], None, entries[2], None, entries[3], entries[4]]
