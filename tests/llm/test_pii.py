import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from platter.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    """The base patterns, by the regex engine."""
    def digits(s):
        return re.sub(r"[^0-9]", "", s)

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(digits(m[0])[::-1])) % 10 == 0]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


PIECES = st.sampled_from(["@", ".", "a", "b-", "x.y@", "é", "\n", " ", "+", "(", ")", "-", "1", "25", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 010-9999", "00000000", "mailto:", "https://", "iban ", "Account no: ", "DE89370400440532013000", "%", "_", "𝔸"])


@settings(max_examples=600, deadline=None)
@given(st.lists(PIECES, max_size=24).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert [s for s in pii.find(text) if s[0] in pii.BASE_KINDS] == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="@.+-() 0123456789ab%", max_size=80))
def test_base_spans_on_dense_anchors(text):
    assert [s for s in pii.find(text) if s[0] in pii.BASE_KINDS] == brute(text)


@pytest.mark.parametrize(
    "text, span",
    [
        ("IBAN: DE89 3704 0044 0532 0130 00 bitte", ("account", 6, 33)),
        ("account no 12345678.", ("account", 11, 19)),
        ("see https://joe:pw@host.example/x, now", ("address", 4, 33)),
        ("mailto:jöe@host.example", ("address", 0, 23)),
    ],
)
def test_added_kinds(text, span):
    assert span in pii.find(text)


def test_plain_text_has_none():
    assert pii.find("An account of iban and konto, see https://host.example/a?b=1 in 2024.") == []
    assert pii.find(None) == pii.find("") == []


def test_whole_long_text():
    text = "word " * 300_000 + "me@host.example"
    assert pii.find(text) == [("email", 1_500_000, 1_500_015)]


def test_query(spark, tmp_path):
    from platter.llm.queries import op5_pii

    rows = [(1, "me@host.example 1.2.3.4", "x"), (2, None, None), (3, "", "x"), (1, "me@host.example 1.2.3.4", "x"), (None, "+1 555 010 9999", None)]
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op5_pii(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_phone, r.spans) for r in got.collect()) == [(0, 0, 0, 1, "phone:0:15"), (1, 1, 1, 0, "email:0:15,ip:16:23"), (1, 1, 1, 0, "email:0:15,ip:16:23"), (2, 0, 0, 0, ""), (3, 0, 0, 0, "")]
    assert got.filter(F.col("base_sha256") == F.sha2(F.lit("").cast("binary"), 256)).count() == 2
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op5_pii(spark, f"{tmp_path}/none").count() == 0
