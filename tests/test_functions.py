import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from platter.functions import cdrom, checksums, codecs


def test_crc64_vector():
    assert checksums.crc64(b"123456789") == 0x995DC9BBDF1939FA
    assert checksums.crc64(b"") == 0


def bytewise(data):
    state = checksums.ONES
    for x in data:
        state ^= x
        for _ in range(8):
            state = state >> 1 ^ (checksums.POLY if state & 1 else 0)
    return state ^ checksums.ONES


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=6), st.integers(0, 300))
def test_crc64_of_many_and_of_parts(values, at):
    assert [int(c) for c in checksums.crc64_many(values)] == [bytewise(v) for v in values]
    for v in values:
        assert checksums.Crc64().update(v[:at]).update(v[at:]).value == bytewise(v)


def plain_spamsum(data):
    """The hash by full 32-bit states, a byte and a size at a time."""
    window, h1, h2, h3, n = [0] * 7, 0, 0, 0, 0
    states = [{"h": checksums.SEED, "half": checksums.SEED, "digest": "", "next": "", "tail": ""}]
    for c in data:
        h2 = (h2 + 7 * c - h1) % 2**32
        h1 = (h1 + c - window[n % 7]) % 2**32
        window[n % 7] = c
        n += 1
        h3 = (h3 << 5) % 2**32 ^ c
        roll = (h1 + h2 + h3) % 2**32
        for s in states:
            s["h"] = s["h"] * checksums.PRIME % 2**32 ^ c
            s["half"] = s["half"] * checksums.PRIME % 2**32 ^ c
        i = 0
        while i < len(states) and roll % (3 << i) == (3 << i) - 1:
            s = states[i]
            if not s["digest"] and i + 1 == len(states) and len(states) < 31:
                states.append({**s, "digest": "", "next": "", "tail": ""})
            mark = checksums.DIGITS[s["h"] % 64]
            s["tail"] = checksums.DIGITS[s["half"] % 64]
            if len(s["digest"]) < 63:
                s["digest"] += mark
                s["h"] = checksums.SEED
                if len(s["digest"]) < 32:
                    s["half"], s["tail"] = checksums.SEED, ""
            else:
                s["next"] = mark
            i += 1
    i = 0
    while (3 << i) * 64 < len(data):
        i += 1
    while i >= len(states) or i > 0 and len(states[i]["digest"]) < 32:
        i -= 1
    roll = (h1 + h2 + h3) % 2**32

    def ended(text, tail):
        return text if len(text) >= 3 and tail and text.endswith(tail * 3) else text + tail

    first = ended(states[i]["digest"], checksums.DIGITS[states[i]["h"] % 64] if roll else states[i]["next"])
    if i + 1 < len(states):
        second = ended(states[i + 1]["digest"], checksums.DIGITS[states[i + 1]["half"] % 64] if roll else states[i + 1]["tail"])
    else:
        second = checksums.DIGITS[states[i]["h"] % 64] if roll else ""
    return f"{3 << i}:{first}:{second}"


@pytest.mark.parametrize("size", [0, 1, 6, 7, 15, 31, 63, 500, 2352, 20000])
@pytest.mark.parametrize("letters", [256, 2, 1])
def test_spamsum(size, letters):
    data = bytes(random.Random(size + letters).choices(range(letters), k=size))
    assert checksums.spamsum(data) == plain_spamsum(data)


def test_edc():
    for width in (0, 1, 63, 64, 65, 2064):
        data = np.frombuffer(os.urandom(3 * width), np.uint8).reshape(3, width)
        for row, got in zip(data, cdrom.edc(data)):
            state = 0
            for x in row:
                state ^= int(x)
                for _ in range(8):
                    state = state >> 1 ^ (cdrom.EDC_POLY if state & 1 else 0)
            assert state == got


@pytest.mark.parametrize(("kind", "mode", "submode"), [("mode1", 1, 0), ("form1", 2, 0), ("form2", 2, 0x20)])
def test_codes(kind, mode, submode):
    data = np.frombuffer(os.urandom(4 * cdrom.SECTOR), np.uint8).reshape(4, -1).copy()
    data[:, :12], data[:, 15], data[:, 0x12] = np.frombuffer(cdrom.SYNC, np.uint8), mode, submode
    good = cdrom.write_codes(data, kind)
    assert not cdrom.check([r.tobytes() for r in good]).failed.any()
    for at in (40, 0x700, cdrom.EDC_SPAN[kind][1]):
        bad = good.copy()
        bad[:, at] ^= 1
        assert cdrom.check([r.tobytes() for r in bad]).failed.all()
    if kind != "form2":
        seen = cdrom.addressed(good, kind)
        for places, at in ((cdrom.P_PLACES, cdrom.P_AT), (cdrom.Q_PLACES, cdrom.Q_AT)):
            words = np.concatenate([seen[:, 12:][:, places], seen[:, at : at + len(places)][..., None], seen[:, at + len(places) : at + 2 * len(places)][..., None]], axis=2)
            assert not np.bitwise_xor.reduce(words, axis=2).any()
            weighted = np.zeros(words.shape[:2], np.uint8)
            for k in range(words.shape[2]):
                weighted = cdrom.DOUBLE[weighted] ^ words[..., k]
            assert not weighted.any()


def test_unknown_sectors():
    found = cdrom.check([None, b"", bytes(cdrom.SECTOR), cdrom.SYNC + bytes(cdrom.SECTOR - 12)])
    assert found.known.tolist() == [False, False, False, True] and not found.failed.any()


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs(data):
    for kind in (codecs.NONE, codecs.LZMA):
        assert codecs.decode(kind, codecs.encode(kind, data), len(data)) == data
    whole = data[: len(data) // 8 * 8]
    for kind in (codecs.FLAC, codecs.LZMA_PLANES):
        assert codecs.decode(kind, codecs.encode(kind, whole), len(whole)) == whole
    assert codecs.planes(bytes([0x80] * 8)) == b"\xff" + bytes(7)


def test_planes_need_whole_groups():
    with pytest.raises(ValueError):
        codecs.planes(b"123")


def test_addresses():
    assert cdrom.msf(0) == bytes([0, 2, 0]) and cdrom.msf(4500 * 10 - 150 + 59 * 75 + 74) == bytes([0x10, 0x59, 0x74])


def test_crc64_of_one_value_is_that_of_many():
    values = [bytes(range(256)) * 300, *(bytes((7 * k + n) % 256 for k in range(n)) for n in (0, 1, 7, 8, 9, 64, 511, 4097, checksums.FEW_BYTES - 1, checksums.FEW_BYTES))]
    assert [checksums.crc64(v) for v in values] == checksums.crc64_many(values).tolist()
