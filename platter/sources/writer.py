"""Containers from their parts: for tests, and for queries that make images of table rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from platter import layout as L
from platter.functions import codecs
from platter.functions.checksums import crc64


def _crc(data: bytes) -> bytes:
    return crc64(data).to_bytes(8, "big")


@dataclass
class Parts:
    """What an image holds; a sector of None was not dumped."""

    sectors: list[bytes | None] = field(default_factory=list)
    sector_size: int = 512
    shift: int = 5
    compression: int = codecs.NONE
    table_compression: int = codecs.NONE
    media_type: int = 2
    application: str = "platter"
    created: int = 0
    #: (data type, bytes, compression): media tags and arrays that go with sectors.
    blobs: list[tuple[int, bytes, int]] = field(default_factory=list)
    #: (sequence, type, first, last, pregap, session, isrc, flags)
    tracks: list[tuple] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)
    #: (strings in the order of HARDWARE_NAMES, extents)
    hardware: list[tuple[list[str], list[tuple[int, int]]]] = field(default_factory=list)
    checksums: list[tuple[int, bytes]] = field(default_factory=list)
    cicm: str = ""
    geometry: tuple[int, int, int] | None = None
    #: Cells of the repaired prefixes and suffixes.
    prefix_cells: list[int] = field(default_factory=list)
    suffix_cells: list[int] = field(default_factory=list)


def build(parts: Parts) -> bytes:
    """The image's bytes. Equal sectors are stored once; equal parts give equal bytes."""
    out, index = bytearray(L.HEADER.size), []

    def add(kind: bytes, data_type: int, raw: bytes) -> int:
        out.extend(bytes(-len(out) % 8))
        index.append((kind, data_type, len(out)))
        out.extend(raw)
        return index[-1][2]

    def block(data_type: int, data: bytes, size: int, compression: int) -> int:
        stored = codecs.encode(compression, data)
        return add(L.DATA, data_type, L.BLOCK_HEADER.pack(L.DATA, data_type, compression, size, len(stored), len(data), _crc(stored), _crc(data)) + stored)

    def table(data_type: int, cells: list[int], width: int) -> None:
        data = b"".join(c.to_bytes(width, "little") for c in cells)
        stored = codecs.encode(parts.table_compression, data)
        add(L.DDT, data_type, L.DDT_HEADER.pack(L.DDT, data_type, parts.table_compression, parts.shift, len(cells), len(stored), len(data), _crc(stored), _crc(data)) + stored)

    distinct = list(dict.fromkeys(s for s in parts.sectors if s is not None))
    per, cell_of = 1 << parts.shift, {}
    for start in range(0, len(distinct), per):
        run = distinct[start : start + per]
        at = block(L.USER_DATA, b"".join(run), parts.sector_size, parts.compression)
        cell_of |= {s: at << parts.shift | k for k, s in enumerate(run)}
    for data_type, data, compression in parts.blobs:
        block(data_type, data, L.STRIDES.get(data_type, 0), compression)
    table(L.USER_DATA, [0 if s is None else cell_of[s] for s in parts.sectors], 8)
    for data_type, cells in ((L.PREFIX_FIXED, parts.prefix_cells), (L.SUFFIX_FIXED, parts.suffix_cells)):
        if cells:
            table(data_type, cells, 4)
    if parts.geometry:
        add(L.GEOM, 0, L.GEOMETRY.pack(L.GEOM, *parts.geometry))
    if parts.metadata:
        spans, text = [], b""
        for name in L.METADATA_NAMES:
            raw = (parts.metadata[name] + "\0").encode("utf-16-le") if name in parts.metadata else b""
            spans += [L.METADATA.size + len(text), len(raw)]
            text += raw
        add(L.META, 0, L.METADATA.pack(L.META, L.METADATA.size + len(text), 0, 0, *spans) + text)
    if parts.tracks:
        raw = b"".join(L.TRACK.pack(*t[:6], t[6].encode(), t[7]) for t in parts.tracks)
        add(L.TRKS, 0, L.TRACKS_HEADER.pack(L.TRKS, len(parts.tracks), _crc(raw)) + raw)
    if parts.cicm:
        raw = parts.cicm.encode()
        add(L.CICM_ID, 0, L.CICM.pack(L.CICM_ID, len(raw)) + raw)
    if parts.hardware:
        raw = b""
        for strings, extents in parts.hardware:
            encoded = [s.encode() for s in strings]
            raw += L.HARDWARE.pack(*map(len, encoded), len(extents)) + b"".join(encoded) + b"".join(L.EXTENT.pack(*e) for e in extents)
        add(L.DUMP, 0, L.HARDWARE_HEADER.pack(L.DUMP, len(parts.hardware), len(raw), _crc(raw)) + raw)
    if parts.checksums:
        raw = b"".join(L.CHECKSUM.pack(kind, len(digest)) + digest for kind, digest in parts.checksums)
        add(L.CKSM, 0, L.CHECKSUM_HEADER.pack(L.CKSM, len(raw), len(parts.checksums)) + raw)
    raw = b"".join(L.INDEX_ENTRY.pack(*e) for e in index)
    out.extend(bytes(-len(out) % 8))
    at = len(out)
    out.extend(L.INDEX_HEADER.pack(L.INDEX, len(index), _crc(raw)) + raw)
    L.HEADER.pack_into(out, 0, L.MAGICS[1], parts.application.encode("utf-16-le")[:64], 1, 0, 1, 0, parts.media_type, at, parts.created, parts.created)
    return bytes(out)


def cut(data: bytes, size: int) -> list[bytes]:
    """Sectors of a value, the last filled up with zero bytes."""
    return [data[k : k + size].ljust(size, b"\0") for k in range(0, len(data), size)]
