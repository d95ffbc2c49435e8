"""CRC-64 and the context-triggered piecewise hash, as plain functions on many values and as column functions."""

from __future__ import annotations

from struct import unpack_from

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: Reversed ECMA-182 polynomial, all-ones seed and final xor.
POLY, ONES = 0xC96C5795D7870F42, 0xFFFFFFFFFFFFFFFF
CHUNK_LOG, CHUNK = 6, 64


def reflected_table(poly: int, dtype: type) -> np.ndarray:
    """Byte table of a reflected CRC."""
    value = np.arange(256, dtype=dtype)
    for _ in range(8):
        value = np.where(value & dtype(1), (value >> dtype(1)) ^ dtype(poly), value >> dtype(1))
    return value


TABLE = reflected_table(POLY, np.uint64)


def _spread(columns: np.ndarray) -> np.ndarray:
    """8 x 256 lookups of the linear map whose image of bit i is columns[i]."""
    out = np.zeros((8, 256), np.uint64)
    for byte in range(8):
        for bit in range(8):
            out[byte, (np.arange(256) >> bit & 1) == 1] ^= columns[8 * byte + bit]
    return out


def _apply(lookups: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = np.zeros_like(value)
    for byte in range(8):
        out ^= lookups[byte][(value >> np.uint64(8 * byte)).astype(np.uint8)]
    return out


def _advances(levels: int) -> list[np.ndarray]:
    """Maps that move a CRC state over 2**k zero bytes, for each k."""
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    columns, found = TABLE[(bits & np.uint64(255)).astype(int)] ^ (bits >> np.uint64(8)), []
    for _ in range(levels):
        found.append(_spread(columns))
        columns = _apply(found[-1], columns)
    return found


ADVANCE = _advances(40)


def crc64_many(values: list[bytes]) -> np.ndarray:
    """CRC-64 of each value.

    The state without seed is linear and blind to leading zeros, so values are padded in front to a power of two of
    64-byte chunks; chunks of all values of a size are hashed side by side and folded pairwise. The seed, moved over the
    value's length, is added at the end.
    """
    sizes = np.array([len(v) for v in values], np.int64)
    out = np.zeros(len(values), np.uint64)
    levels = np.ceil(np.log2(np.maximum((sizes + CHUNK - 1) // CHUNK, 1))).astype(int)
    for level in np.unique(levels):
        rows, width = np.flatnonzero(levels == level), CHUNK << int(level)
        step = max(1, (32 << 20) // width)
        for part in (rows[i : i + step] for i in range(0, len(rows), step)):
            data = np.frombuffer(b"".join(values[i].rjust(width, b"\0") for i in part), np.uint8).reshape(-1, CHUNK)
            state = np.zeros(len(data), np.uint64)
            for k in range(CHUNK):
                state = TABLE[(state.astype(np.uint8) ^ data[:, k])] ^ (state >> np.uint64(8))
            state = state.reshape(len(part), -1)
            for fold in range(int(level)):
                state = _apply(ADVANCE[CHUNK_LOG + fold], state[:, 0::2]) ^ state[:, 1::2]
            out[part] = state[:, 0]
    seed = np.full(len(values), ONES, np.uint64)
    for k in range(int(sizes.max(initial=0)).bit_length()):
        moved = (sizes >> k & 1) == 1
        seed[moved] = _apply(ADVANCE[k], seed[moved])
    return out ^ seed ^ np.uint64(ONES)


#: A value of fewer bytes is hashed word by word; a longer one has enough chunks to be hashed side by side.
FEW_BYTES = 1 << 15
_BYTES = TABLE.tolist()
_pairs = np.arange(1 << 16)
#: The map that moves a state over eight bytes, as lookups of two bytes of the state at a time.
_WORDS = [(ADVANCE[3][2 * k][_pairs & 255] ^ ADVANCE[3][2 * k + 1][_pairs >> 8]).tolist() for k in range(4)]


def crc64(value: bytes) -> int:
    """CRC-64 of one value."""
    if len(value) >= FEW_BYTES:
        return int(crc64_many([value])[0])
    a, b, c, d = _WORDS
    n, state = len(value) // 8, ONES
    for word in unpack_from(f"<{n}Q", value):
        state ^= word
        state = a[state & 0xFFFF] ^ b[state >> 16 & 0xFFFF] ^ c[state >> 32 & 0xFFFF] ^ d[state >> 48]
    for byte in value[8 * n :]:
        state = _BYTES[(state ^ byte) & 255] ^ state >> 8
    return state ^ ONES


def crc64_combine(first: int, second: int, second_size: int) -> int:
    """CRC-64 of two parts laid end to end, from theirs: parts of a large value can be hashed apart."""
    state = np.array([first], np.uint64)
    for k in range(second_size.bit_length()):
        if second_size >> k & 1:
            state = _apply(ADVANCE[k], state)
    return int(state[0]) ^ second


class Crc64:
    """Incremental form: update with chunks in order, then read value."""

    def __init__(self) -> None:
        self.value = 0

    def update(self, chunk: bytes) -> Crc64:
        self.value = crc64_combine(self.value, crc64(chunk), len(chunk))
        return self


def _hex(values: list[bytes | None]) -> list[str | None]:
    found = crc64_many([v or b"" for v in values])
    return [None if v is None else f"{int(c):016X}" for v, c in zip(values, found)]


def crc64_hex(column: Column) -> Column:
    """CRC-64 of a binary column as 16 upper-case digits; null stays null."""

    @pandas_udf("string")
    def crc(values: pd.Series) -> pd.Series:
        return pd.Series(_hex(values.tolist()), dtype=object)

    return crc(column)


#: Fixed values of the piecewise hash: digits, hash seed and prime, least block size, window, digest length, most sizes.
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SEED, PRIME, LEAST, WINDOW, LONGEST, SIZES = 0x28021967, 0x01000193, 3, 7, 64, 31


def rolling(value: bytes) -> np.ndarray:
    """Rolling hash after each byte, modulo 2**32: sum of the last seven, their sum weighted by age, and a shift-xor."""
    c = np.frombuffer(value, np.uint8).astype(np.uint64)
    padded = np.concatenate([np.zeros(WINDOW, np.uint64), c])
    last = [padded[WINDOW - k : len(padded) - k] for k in range(WINDOW)]
    plain, weighted = sum(last), sum((np.uint64(WINDOW - k) * x for k, x in enumerate(last)))
    shifted = np.zeros(len(c), np.uint64)
    for k, x in enumerate(last):
        shifted ^= x << np.uint64(5 * k)
    return (plain + weighted + (shifted & np.uint64(0xFFFFFFFF))) & np.uint64(0xFFFFFFFF)


def _without_fourth(text: str, tail: str) -> str:
    return text if len(text) >= 3 and text[-3:] == tail * 3 else text + tail


def spamsum(value: bytes) -> str:
    """Context-triggered piecewise hash, size:digest:digest of twice the size.

    Only the low six bits of a piece's hash are ever printed, and they depend on the low six bits alone.
    """
    seed, prime, roll = SEED % 64, PRIME % 64, rolling(value)
    sizes = [LEAST << i for i in range(SIZES)]
    ends = {int(k): int(r) + 1 for k, r in zip(np.flatnonzero(roll % np.uint64(LEAST) == LEAST - 1), roll[roll % np.uint64(LEAST) == LEAST - 1])}
    full, half, digest, pending, half_digest = [seed], [seed], [""], [""], [""]
    for k, c in enumerate(value):
        full = [(h * prime ^ c) & 63 for h in full]
        half = [(h * prime ^ c) & 63 for h in half]
        if k not in ends:
            continue
        i = 0
        while i < len(full) and ends[k] % sizes[i] == 0:
            if not digest[i] and i == len(full) - 1 and len(full) < SIZES:
                full.append(full[i]), half.append(half[i])
                digest.append(""), pending.append(""), half_digest.append("")
            mark, half_digest[i] = DIGITS[full[i]], DIGITS[half[i]]
            if len(digest[i]) < LONGEST - 1:
                digest[i] += mark
                full[i] = seed
                if len(digest[i]) < LONGEST // 2:
                    half[i], half_digest[i] = seed, ""
            else:
                pending[i] = mark
            i += 1
    i = 0
    while i < SIZES - 1 and sizes[i] * LONGEST < len(value):
        i += 1
    i = min(i, len(full) - 1)
    while i > 0 and len(digest[i]) < LONGEST // 2:
        i -= 1
    rest = len(value) > 0 and int(roll[-1]) != 0
    first = _without_fourth(digest[i], DIGITS[full[i]] if rest else pending[i])
    if i + 1 < len(full):
        second = _without_fourth(digest[i + 1], DIGITS[half[i + 1]] if rest else half_digest[i + 1])
    else:
        second = DIGITS[full[i]] if rest else ""
    return f"{sizes[i]}:{first}:{second}"


def spamsum_text(column: Column) -> Column:
    """Piecewise hash of a binary column; null stays null."""

    @pandas_udf("string")
    def hashed(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else spamsum(v) for v in values], dtype=object)

    return hashed(column)
