"""Compact-disc sectors: addresses, error detection and correction codes, on many sectors at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from platter.functions.checksums import reflected_table

#: Sector size, sync bytes, polynomial of the detection code, field polynomial of the correction code.
SECTOR, SYNC, EDC_POLY, FIELD = 2352, b"\0" + b"\xff" * 10 + b"\0", 0xD8018001, 0x11D
MODE1, MODE2, FORM1, FORM2 = "mode1", "mode2", "form1", "form2"
#: Fixed values per kind: where the detected bytes start and end; the code follows them.
EDC_SPAN = {MODE1: (0, 0x810), FORM1: (0x10, 0x818), FORM2: (0x10, 0x92C)}
EDC_TABLE = reflected_table(EDC_POLY, np.uint32)


def _field() -> tuple[np.ndarray, np.ndarray]:
    """Doubling in the field, and the inverse of multiplication by three."""
    i = np.arange(256)
    double = (i << 1) ^ np.where(i & 0x80, FIELD, 0)
    third = np.zeros(256, np.uint8)
    third[i ^ double] = i
    return double.astype(np.uint8), third


DOUBLE, THIRD = _field()


def _places(majors: int, minors: int, factor: int, step: int) -> np.ndarray:
    """Which byte, counted from the address, each step of each codeword takes."""
    major, minor = np.arange(majors)[:, None], np.arange(minors)[None, :]
    return ((major >> 1) * factor + (major & 1) + minor * step) % (majors * minors)


P_PLACES, Q_PLACES = _places(86, 24, 2, 86), _places(52, 43, 86, 88)
P_AT, Q_AT = 0x81C, 0x8C8


#: Pieces of a row that are coded side by side, as a power of two.
FOLDS = 6


def _moved(lookups: np.ndarray, state: np.ndarray) -> np.ndarray:
    return lookups[0][state & 255] ^ lookups[1][state >> 8 & 255] ^ lookups[2][state >> 16 & 255] ^ lookups[3][state >> 24]


@lru_cache(maxsize=64)
def _moves(size: int) -> list[np.ndarray]:
    """Maps of a code's state over size, 2 size, 4 size ... zero bytes, as 4 x 256 lookups."""
    columns, found = np.uint32(1) << np.arange(32, dtype=np.uint32), []
    for _ in range(size):
        columns = EDC_TABLE[columns & 255] ^ (columns >> np.uint32(8))
    for _ in range(FOLDS):
        bits = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(bool)
        found.append(np.stack([np.bitwise_xor.reduce(np.where(bits, columns[8 * k : 8 * k + 8], np.uint32(0)), axis=1) for k in range(4)]))
        columns = _moved(found[-1], columns)
    return found


def edc(data: np.ndarray) -> np.ndarray:
    """Detection code of each row of bytes: pieces of the rows side by side, then folded pairwise; leading zeros do not count."""
    n, width = data.shape
    size = -(-width // (1 << FOLDS)) or 1
    filled = np.zeros((n, size << FOLDS), np.uint8)
    if width:
        filled[:, -width:] = data
    pieces, state = filled.reshape(-1, size), np.zeros(n << FOLDS, np.uint32)
    for k in range(size):
        state = EDC_TABLE[state.astype(np.uint8) ^ pieces[:, k]] ^ (state >> np.uint32(8))
    state = state.reshape(n, -1)
    for lookups in _moves(size):
        state = _moved(lookups, state[:, 0::2]) ^ state[:, 1::2]
    return state[:, 0]


def _parity(sectors: np.ndarray, places: np.ndarray) -> np.ndarray:
    body = sectors[:, 0x0C:]
    a = np.zeros((len(sectors), len(places)), np.uint8)
    b = np.zeros_like(a)
    for k in range(places.shape[1]):
        t = body[:, places[:, k]]
        a, b = DOUBLE[a ^ t], b ^ t
    a = THIRD[DOUBLE[a] ^ b]
    return np.concatenate([a, a ^ b], axis=1)


def p_parity(sectors: np.ndarray) -> np.ndarray:
    return _parity(sectors, P_PLACES)


def q_parity(sectors: np.ndarray) -> np.ndarray:
    return _parity(sectors, Q_PLACES)


def stored_edc(sectors: np.ndarray, kind: str) -> np.ndarray:
    end = EDC_SPAN[kind][1]
    return np.ascontiguousarray(sectors[:, end : end + 4]).view("<u4")[:, 0]


def computed_edc(sectors: np.ndarray, kind: str) -> np.ndarray:
    start, end = EDC_SPAN[kind]
    return edc(sectors[:, start:end])


def addressed(sectors: np.ndarray, kind: str) -> np.ndarray:
    """The sectors as the correction code sees them: form 1 with a zero address."""
    if kind == FORM1:
        sectors = sectors.copy()
        sectors[:, 0x0C:0x10] = 0
    return sectors


def write_codes(sectors: np.ndarray, kind: str) -> np.ndarray:
    """The sectors with their detection code and, but for form 2, their correction code made anew."""
    out = sectors.copy()
    end = EDC_SPAN[kind][1]
    out[:, end : end + 4] = computed_edc(out, kind).astype("<u4")[:, None].view(np.uint8)
    if kind == FORM2:
        return out
    if kind == MODE1:
        out[:, 0x814:P_AT] = 0
    seen = addressed(out, kind)
    seen[:, P_AT:Q_AT] = p_parity(seen)
    out[:, P_AT:Q_AT] = seen[:, P_AT:Q_AT]
    out[:, Q_AT:] = q_parity(seen)
    return out


def msf(lba: int) -> bytes:
    """Address of a block in binary-coded decimals: minute, second, frame."""
    n = lba + 150
    return bytes((x // 10 << 4 | x % 10) & 255 for x in (n // 75 // 60, n // 75 % 60, n % 75))


def prefix(lba: int, mode: int) -> bytes:
    return SYNC + msf(lba) + bytes([mode])


FLAGS = ("known", "failed", "has_edc", "edc_ok", "has_ecc_p", "ecc_p_ok", "has_ecc_q", "ecc_q_ok")


def check(values: list[bytes | None]) -> pd.DataFrame:
    """What the codes of each raw sector say; no sync, or another size: not known."""
    found = np.zeros((len(values), len(FLAGS)), bool)
    rows = [i for i, v in enumerate(values) if v is not None and len(v) == SECTOR and v[:12] == SYNC]
    if rows:
        data = np.frombuffer(b"".join(values[i] for i in rows), np.uint8).reshape(-1, SECTOR)
        mode, flags = data[:, 15] & 3, np.zeros((len(rows), len(FLAGS)), bool)
        flags[:, 0] = True
        flags[:, 1] = (mode == 3) | (mode == 0) & data[:, 0x10:0x930].any(axis=1) | (mode == 1) & data[:, 0x814:P_AT].any(axis=1)
        second = (data[:, 0x12] & 0x20) > 0
        for kind, of in ((MODE1, (mode == 1) & ~flags[:, 1]), (FORM1, (mode == 2) & ~second), (FORM2, (mode == 2) & second)):
            if not of.any():
                continue
            some = data[of]
            want, seen = stored_edc(some, kind), addressed(some, kind)
            none = np.zeros(len(some), bool)
            has = want != 0 if kind == FORM2 else ~none
            edc_ok = has & (computed_edc(some, kind) == want)
            p = none if kind == FORM2 else (p_parity(seen) == some[:, P_AT:Q_AT]).all(axis=1)
            q = none if kind == FORM2 else (q_parity(seen) == some[:, Q_AT:]).all(axis=1)
            codes = np.full(len(some), kind != FORM2)
            failed = has & ~edc_ok | codes & ~(p & q)
            flags[of] = np.stack([~none, failed, has, edc_ok, codes, p, codes, q], axis=1)
        found[rows] = flags
    return pd.DataFrame(found, columns=list(FLAGS))


def sector_check(column: Column) -> Column:
    """struct of FLAGS for a column of raw sectors."""

    @pandas_udf(", ".join(f"{f} boolean" for f in FLAGS))
    def checked(values: pd.Series) -> pd.DataFrame:
        return check(values.tolist())

    return checked(column)


def suffix_ok(column: Column) -> Column:
    """Whether all codes of a raw sector hold."""
    found = sector_check(column)
    return found.getField("known") & ~found.getField("failed")


def edc_hex(column: Column) -> Column:
    """Detection code of a whole binary value, 8 upper-case digits; null stays null."""

    @pandas_udf("string")
    def coded(values: pd.Series) -> pd.Series:
        # Leading zeros do not change the code, so values are padded in front to a common size, alike sizes together.
        items, out = values.tolist(), [None] * len(values)
        order = sorted((i for i, v in enumerate(items) if v is not None), key=lambda i: len(items[i]))
        while order:
            width = max(64, 2 * len(items[order[0]]))
            part = [i for i in order if len(items[i]) <= width][: max(1, (32 << 20) // width)]
            order = order[len(part) :]
            width = len(items[part[-1]])
            data = np.frombuffer(b"".join(items[i].rjust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
            for i, c in zip(part, edc(data)):
                out[i] = f"{int(c):08X}"
        return pd.Series(out, dtype=object)

    return coded(column)


def lba_to_msf(lba: Column) -> Column:
    """struct of minute, second and frame."""
    n = lba.cast("bigint") + 150
    seconds = F.floor(n / 75)
    return F.struct(F.floor(seconds / 60).alias("minute"), F.pmod(seconds, F.lit(60)).alias("second"), F.pmod(n, F.lit(75)).alias("frame"))


def bcd(x: Column) -> Column:
    """Two decimal digits in one byte's two halves."""
    return F.floor(x / 10) * 16 + F.pmod(x, F.lit(10))
