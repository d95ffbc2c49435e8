"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds its anchors: at-signs, plus-signs, digits, address schemes and words that announce
an account. From each anchor a small deterministic parser grows the boundaries to the left and right and validates what it
has (labels of a mail domain, parts of an IP address, Luhn and mod-97 check digits, digit counts). No regular expression
runs over the text, and text without anchors costs the automaton's pass only.

Kinds: email, ip, card and phone have the exact extent of their published patterns, leftmost and without overlap per kind;
a candidate that fails its validation is dropped whole and not tried again from a later start. Added by the method: account
(an announced account number or IBAN) and address (a mailto: address, or a URL that carries user information).

Defined results: null and empty texts have no spans; texts are scanned whole; spans are in code points, end exclusive,
ordered by start, then by kind in the order of KINDS. Other columns are not read.
"""

from __future__ import annotations

from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "address")
_RANK = {k: i for i, k in enumerate(KINDS)}

_SCHEMES = ("http://", "https://", "ftp://", "mailto:")
_CUES = ("account", "acct", "iban", "konto", "kontonummer", "cuenta", "compte")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_DIGITS = frozenset("0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_URL_END = frozenset(" \t\n\r\v\f\"'<>|")

SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in _DIGITS:
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for word in _SCHEMES:
        found.add_word(word, ("scheme", len(word)))
    for word in _CUES:
        for form in (word, word.upper(), word.capitalize()):
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def _run(text: str, start: int, allowed: frozenset[str]) -> int:
    """The end of the run of allowed characters at start."""
    n = len(text)
    while start < n and text[start] in allowed:
        start += 1
    return start


def _domain(text: str, start: int) -> int:
    """The end of a domain of two labels or more at start; start if there is none."""
    end = _run(text, start, _LABEL)
    if end == start:
        return start
    labels = 1
    while end < len(text) and text[end] == ".":
        after = _run(text, end + 1, _LABEL)
        if after == end + 1:
            break
        end, labels = after, labels + 1
    return end if labels > 1 else start


def _emails(text: str, signs: list[int]) -> list[tuple[str, int, int]]:
    out, floor = [], 0
    for at in signs:
        if at < floor:
            continue
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        end = _domain(text, at + 1)
        if start < at and end > at + 1:
            out.append(("email", start, end))
            floor = end
    return out


def _ips(text: str, runs: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    out, i = [], 0
    while i + 3 < len(runs):
        group = runs[i : i + 4]
        if all(b[0] == a[1] + 1 and text[a[1]] == "." for a, b in zip(group, group[1:], strict=False)):
            if all(len(digits := text[s:e].lstrip("0")) <= 3 and int(digits or "0") <= 255 for s, e in group):
                out.append(("ip", group[0][0], group[3][1]))
            i += 4
        else:
            i += 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _cards(text: str, runs: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    out, i = [], 0
    while i < len(runs):
        first = i
        while i + 1 < len(runs) and runs[i + 1][0] == runs[i][1] + 1 and text[runs[i][1]] in " -":
            i += 1
        n = sum(e - s for s, e in runs[first : i + 1])
        if 12 <= n <= 19 and luhn("".join(text[s:e] for s, e in runs[first : i + 1])):
            out.append(("card", runs[first][0], runs[i][1]))
        i += 1
    return out


def _phones(text: str, signs: list[int]) -> list[tuple[str, int, int]]:
    out = []
    for plus in signs:
        if plus + 1 < len(text) and text[plus + 1] in _DIGITS:
            end = _run(text, plus + 2, _PHONE)
            while end > plus + 3 and text[end - 1] not in _DIGITS:
                end -= 1
            if end > plus + 3 and 9 <= sum(c in _DIGITS for c in text[plus:end]) <= 15:
                out.append(("phone", plus, end))
    return out


def _iban(compact: str) -> bool:
    if not (15 <= len(compact) <= 34 and compact[:2].isalpha() and compact[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _accounts(text: str, cues: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The number that follows a cue: an IBAN with right check digits, or 6 to 18 digits."""
    out, floor = [], 0
    for start, end in cues:
        if start < floor or start and text[start - 1] in _ALNUM:
            continue
        at = end
        while at < len(text) and at - end < 8 and text[at] in " :#=.-" or text[at : at + 2].lower() in ("no", "nr") and at - end < 8:
            at += 2 if text[at : at + 2].lower() in ("no", "nr") else 1
        if at == end or at >= len(text):
            continue
        stop = at
        while stop < len(text) and (text[stop] in _ALNUM or text[stop] in " -" and stop + 1 < len(text) and text[stop + 1] in _ALNUM) and stop - at < 48:
            stop += 1
        groups, cut = text[at:stop].split(" "), at
        best = None
        compact = ""
        for group in groups:
            cut += len(group)
            compact += group.replace("-", "")
            if _iban(compact.upper()) or compact.isascii() and compact.isdigit() and 6 <= len(compact) <= 18:
                best = cut
            cut += 1
        if best is not None:
            out.append(("account", at, best))
            floor = best
    return out


def _addresses(text: str, schemes: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    out, floor = [], 0
    for start, end in schemes:
        if start < floor:
            continue
        stop = end
        while stop < len(text) and text[stop] not in _URL_END:
            stop += 1
        while stop > end and text[stop - 1] in ".,;:!?)":
            stop -= 1
        authority = text[end:stop].split("/")[0] if text[end - 1] == "/" else text[end:stop]
        user, at, host = authority.rpartition("@")
        if at and user and "." in host:
            out.append(("address", start, stop))
            floor = stop
    return out


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text."""
    if not text:
        return []
    signs: list[int] = []
    plus: list[int] = []
    runs: list[tuple[int, int]] = []
    cues: list[tuple[int, int]] = []
    schemes: list[tuple[int, int]] = []
    first = last = -2
    for end, (what, n) in _automaton().iter(text):
        if what == "digit":
            if end != last + 1:
                if first >= 0:
                    runs.append((first, last + 1))
                first = end
            last = end
        elif what == "at":
            signs.append(end)
        elif what == "plus":
            plus.append(end)
        else:
            (cues if what == "cue" else schemes).append((end + 1 - n, end + 1))
    if first >= 0:
        runs.append((first, last + 1))
    spans = [*_emails(text, signs), *_ips(text, runs), *_cards(text, runs), *_phones(text, plus)] if signs or runs else []
    if cues:
        spans += _accounts(text, cues)
    if schemes:
        spans += _addresses(text, sorted(schemes))
    return sorted(spans, key=lambda s: (s[1], _RANK[s[0]]))


@F.arrow_udf(SPANS)
def pii_spans(texts: pa.Array) -> pa.Array:
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in (x.as_py() for x in texts)], _ARROW)
