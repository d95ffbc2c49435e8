"""Payload codecs: LZMA without container, the subchannel bit-plane transform, 16-bit stereo FLAC."""

from __future__ import annotations

import lzma
import sys
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: Fixed value: bytes of LZMA properties ahead of the stream.
PROPERTIES = 5


def lzma_decode(data: bytes, size: int) -> bytes:
    """The stream after its five property bytes; size is that of the result."""
    first = data[0]
    filters = [{"id": lzma.FILTER_LZMA1, "lc": first % 9, "lp": first // 9 % 5, "pb": first // 45, "dict_size": max(4096, int.from_bytes(data[1:PROPERTIES], "little"))}]
    return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters).decompress(data[PROPERTIES:], max_length=size)


def lzma_encode(data: bytes, preset: int = 6) -> bytes:
    packed = lzma.compress(data, lzma.FORMAT_ALONE, preset=preset)
    return packed[:PROPERTIES] + packed[PROPERTIES + 8 :]


def planes(data: bytes) -> bytes:
    """Subchannel bytes as eight bit planes, first all highest bits; the size must be a multiple of eight."""
    if len(data) % 8:
        raise ValueError(f"{len(data)} bytes are no whole bit planes")
    return np.packbits(np.unpackbits(np.frombuffer(data, np.uint8)).reshape(-1, 8).T).tobytes()


def unplanes(data: bytes) -> bytes:
    """Inverse of planes."""
    if len(data) % 8:
        raise ValueError(f"{len(data)} bytes are no whole bit planes")
    return np.packbits(np.unpackbits(np.frombuffer(data, np.uint8)).reshape(8, -1).T).tobytes()


class Bits:
    """Reader of a big-endian bit string."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at * 8

    def read(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if last > len(self.data):
            raise EOFError("the stream ends early")
        word = int.from_bytes(self.data[first:last], "big") >> (last * 8 - self.at - n)
        self.at += n
        return word & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        x = self.read(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        """Zeros up to the next one, which is passed over too."""
        n = 0
        while True:
            left = min(64 - (self.at & 7), len(self.data) * 8 - self.at)
            if left <= 0:
                raise EOFError("the stream ends early")
            word = self.read(left)
            if word:
                zeros = left - word.bit_length()
                self.at -= left - zeros - 1
                return n + zeros
            n += left

    def align(self) -> None:
        self.at = (self.at + 7) & ~7


#: Coefficients of the fixed predictors of orders 0 to 4, and block sizes by their frame code.
PREDICTORS = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
BLOCKS = {1: 192, **{2 + k: 576 << k for k in range(4)}, **{8 + k: 256 << k for k in range(8)}}


def _residual(bits: Bits, size: int, order: int) -> list[int]:
    width = 4 if bits.read(2) == 0 else 5
    parts, out = 1 << bits.read(4), []
    for part in range(parts):
        n, rice = size // parts - (order if part == 0 else 0), bits.read(width)
        if rice == (1 << width) - 1:
            raw = bits.read(5)
            out += [bits.signed(raw) for _ in range(n)]
            continue
        for _ in range(n):
            x = bits.unary() << rice | bits.read(rice)
            out.append(x >> 1 ^ -(x & 1))
    return out


def _subframe(bits: Bits, size: int, depth: int) -> list[int]:
    head = bits.read(8)
    kind, wasted = head >> 1 & 63, bits.unary() + 1 if head & 1 else 0
    depth -= wasted
    if kind == 0:
        out = [bits.signed(depth)] * size
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [bits.signed(depth) for _ in range(order)]
        weights, shift = PREDICTORS[order] if kind < 32 else (), 0
        if kind >= 32:
            precision, shift = bits.read(4) + 1, bits.signed(5)
            weights = tuple(bits.signed(precision) for _ in range(order))
        for r in _residual(bits, size, order):
            out.append(r + (sum(c * out[-1 - k] for k, c in enumerate(weights)) >> shift))
    else:
        raise ValueError(f"subframe type {kind} is reserved")
    return [x << wasted for x in out]


def _frame_number(bits: Bits) -> None:
    """Passes over a number in the extended UTF-8 form."""
    first = bits.read(8)
    for _ in range(max(0, 8 - (first ^ 0xFF).bit_length() - 1)):
        bits.read(8)


def flac_decode(data: bytes, size: int) -> bytes:
    """Interleaved little-endian 16-bit stereo samples of a stream; at most size bytes."""
    if data[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last = 4, False
    while not last:
        last, length = data[at] >> 7 == 1, int.from_bytes(data[at + 1 : at + 4], "big")
        at += 4 + length
    bits, out, got = Bits(data, at), [], 0
    while got < size and bits.at < len(data) * 8:
        if bits.read(14) != 0x3FFE:
            raise ValueError("no frame where one should start")
        bits.read(2)
        block, rate, channels = bits.read(4), bits.read(4), bits.read(4)
        bits.read(4)
        _frame_number(bits)
        n = bits.read(8) + 1 if block == 6 else bits.read(16) + 1 if block == 7 else BLOCKS[block]
        bits.read({12: 8, 13: 16, 14: 16}.get(rate, 0))
        bits.read(8)
        if channels not in (1, 8, 9, 10):
            raise ValueError("not two channels")
        left = _subframe(bits, n, 17 if channels == 9 else 16)
        right = _subframe(bits, n, 17 if channels in (8, 10) else 16)
        a, b = np.array(left, np.int64), np.array(right, np.int64)
        if channels == 8:
            b = a - b
        elif channels == 9:
            a = a + b
        elif channels == 10:
            middle = a * 2 + (b & 1)
            a, b = (middle + b) >> 1, (middle - b) >> 1
        bits.align()
        bits.read(16)
        out.append(np.stack([a, b], axis=1).astype("<i2").tobytes())
        got += 4 * n
    return b"".join(out)[:size]


class BitWriter:
    def __init__(self) -> None:
        self.parts: list[str] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.parts.append(format(value & ((1 << n) - 1), f"0{n}b"))

    def bytes(self) -> bytes:
        text = "".join(self.parts)
        text += "0" * (-len(text) % 8)
        return int("1" + text, 2).to_bytes(len(text) // 8 + 1, "big")[1:]


def _crc(data: bytes, poly: int, width: int) -> int:
    state = 0
    for x in data:
        state ^= x << (width - 8)
        for _ in range(8):
            state = (state << 1 ^ (poly if state >> (width - 1) else 0)) & ((1 << width) - 1)
    return state


def flac_encode(data: bytes, block: int = 4096) -> bytes:
    """A stream of second-order fixed-predictor frames; data are whole 16-bit stereo samples."""
    samples = array("h", data)
    if sys.byteorder == "big":
        samples.byteswap()
    total = len(samples) // 2
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | 1 << 41 | 15 << 36 | total).to_bytes(8, "big") + bytes(16)
    out = [b"fLaC", bytes([0x80, 0, 0, len(info)]), info]
    for number, start in enumerate(range(0, total, block)):
        n = min(block, total - start)
        w = BitWriter()
        w.put(0x3FFE, 14), w.put(0, 2), w.put(7, 4), w.put(9, 4), w.put(1, 4), w.put(4, 3), w.put(0, 1)
        for x in chr(number).encode("utf-8", "surrogatepass"):
            w.put(x, 8)
        w.put(n - 1, 16)
        w.put(_crc(w.bytes(), 0x07, 8), 8)
        for channel in (0, 1):
            x = samples[2 * start + channel : 2 * (start + n) : 2]
            if n < 3:
                w.put(1 << 1, 8)
                for s in x:
                    w.put(s, 16)
                continue
            w.put((8 + 2) << 1, 8), w.put(x[0], 16), w.put(x[1], 16)
            rest = [x[i] - 2 * x[i - 1] + x[i - 2] for i in range(2, n)]
            folded = [r << 1 if r >= 0 else (-r << 1) - 1 for r in rest]
            rice = min(14, max(0, (sum(folded) // len(folded)).bit_length() - 1))
            w.put(0, 2), w.put(0, 4), w.put(rice, 4)
            for f in folded:
                w.put(1, (f >> rice) + 1), w.put(f, rice)
        frame = w.bytes()
        out += [frame, _crc(frame, 0x8005, 16).to_bytes(2, "big")]
    return b"".join(out)


#: Fixed values of the compression field.
NONE, LZMA, FLAC, LZMA_PLANES = 0, 1, 2, 3


def decode(compression: int, payload: bytes, size: int) -> bytes:
    """A stored payload's bytes; a value that the format does not have raises KeyError, damaged payloads other errors."""
    plain = {NONE: lambda x: x[:size], LZMA: lambda x: lzma_decode(x, size), FLAC: lambda x: flac_decode(x, size), LZMA_PLANES: lambda x: unplanes(lzma_decode(x, size))}
    return plain[compression](payload)


def encode(compression: int, data: bytes) -> bytes:
    return {NONE: lambda x: x, LZMA: lzma_encode, FLAC: flac_encode, LZMA_PLANES: lambda x: lzma_encode(planes(x))}[compression](data)


def transformed(column: Column, function) -> Column:
    """A bytes function over a binary column, in Arrow batches; null stays null."""

    @pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else function(v) for v in values], dtype=object)

    return run(column)
