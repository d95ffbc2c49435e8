"""One image as rows: a seekable file is read piecemeal, and each table takes only what it needs."""

from __future__ import annotations

import io
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np

from platter import layout as L
from platter.functions import cdrom, codecs
from platter.functions.checksums import Crc64, crc64

#: Bytes of decoded blocks that one reader keeps, and bytes hashed at a time.
CACHE_BYTES, PIECE = 64 << 20, 1 << 20
#: Sectors located, decoded and assembled together.
RUN = 256


class ImageError(Exception):
    def __init__(self, status: int) -> None:
        super().__init__(status)
        self.status = status


def _crc_hex(stored: bytes) -> str:
    """Checksums stand in the file with their highest byte first."""
    return stored.hex().upper()


def _text(raw: bytes, charset: str) -> str | None:
    return raw.decode(charset, "replace").rstrip("\0") if raw else None


class Image:
    """Access to one image; raises ImageError where it cannot be opened."""

    def __init__(self, file: BinaryIO) -> None:
        self.file = file
        self.size = file.seek(0, io.SEEK_END)
        raw = self.at(0, L.HEADER.size)
        if len(raw) < L.HEADER.size:
            raise ImageError(L.TOO_SMALL)
        magic, application, self.major, self.minor, self.app_major, self.app_minor, self.media_type, self.index_offset, self.created, self.written = L.HEADER.unpack(raw)
        if magic not in L.MAGICS:
            raise ImageError(L.BAD_MAGIC)
        if self.major > L.NEWEST_MAJOR:
            raise ImageError(L.BAD_VERSION)
        self.application = _text(application, "utf-16-le")
        raw = self.at(self.index_offset, L.INDEX_HEADER.size)
        if len(raw) < L.INDEX_HEADER.size or raw[:4] != L.INDEX:
            raise ImageError(L.BAD_INDEX)
        _, n, self.index_crc = L.INDEX_HEADER.unpack(raw)
        raw = self.at(self.index_offset + L.INDEX_HEADER.size, n * L.INDEX_ENTRY.size)
        if len(raw) < n * L.INDEX_ENTRY.size:
            raise ImageError(L.BAD_INDEX)
        self.index = list(L.INDEX_ENTRY.iter_unpack(raw))
        self.cache: OrderedDict[int, tuple[int, int, bytes]] = OrderedDict()
        self.cached = 0
        self.arrays: dict[int, bytes | None] = {}
        self.cells: dict[int, np.ndarray | None] = {}

    def at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def entries(self, kind: bytes) -> Iterator[tuple[int, int, int]]:
        """Position, data type and offset of the blocks of a kind."""
        return ((k, data_type, offset) for k, (found, data_type, offset) in enumerate(self.index) if found == kind)

    def struct(self, layout, kind: bytes, offset: int) -> tuple:
        raw = self.at(offset, layout.size)
        if len(raw) < layout.size or raw[:4] != kind:
            raise ImageError(L.BAD_BLOCK)
        return layout.unpack(raw)

    def block(self, offset: int) -> tuple[int, int, bytes]:
        """Status, sector size and decoded bytes of a data block."""
        if offset in self.cache:
            self.cache.move_to_end(offset)
            return self.cache[offset]
        found = self._block(offset)
        self.cache[offset] = found
        self.cached += len(found[2])
        while self.cached > CACHE_BYTES and len(self.cache) > 1:
            self.cached -= len(self.cache.popitem(last=False)[1][2])
        return found

    def _block(self, offset: int) -> tuple[int, int, bytes]:
        try:
            _, _, compression, sector_size, stored, length, _, _ = self.struct(L.BLOCK_HEADER, L.DATA, offset)
        except ImageError as e:
            return e.status, 0, b""
        payload = self.at(offset + L.BLOCK_HEADER.size, stored)
        if len(payload) < stored:
            return L.BAD_BLOCK, sector_size, b""
        return (*self._decoded(compression, payload, length, sector_size),)

    @staticmethod
    def _decoded(compression: int, payload: bytes, length: int, sector_size: int) -> tuple[int, int, bytes]:
        if compression not in (codecs.NONE, codecs.LZMA, codecs.FLAC, codecs.LZMA_PLANES):
            return L.BAD_COMPRESSION, sector_size, b""
        try:
            data = codecs.decode(compression, payload, length)
        except Exception:  # whatever a damaged payload makes a codec raise
            return L.BAD_PAYLOAD, sector_size, b""
        return (L.OK if len(data) == length else L.BAD_PAYLOAD), sector_size, data

    def table_of(self, data_type: int) -> np.ndarray | None:
        """Cells of the deduplication table of a data type; the last one in the index counts."""
        if data_type not in self.cells:
            self.cells[data_type] = None
            for _, of, offset in self.entries(L.DDT):
                if of != data_type:
                    continue
                _, _, compression, shift, n, stored, length, _, _ = self.struct(L.DDT_HEADER, L.DDT, offset)
                status, _, raw = self._decoded(compression, self.at(offset + L.DDT_HEADER.size, stored), length, 0)
                width = 8 if data_type == L.USER_DATA else 4
                if status or len(raw) < n * width:
                    raise ImageError(status or L.BAD_BLOCK)
                self.cells[data_type] = np.frombuffer(raw, f"<u{width}", n)
                if data_type == L.USER_DATA:
                    self.shift = shift
        return self.cells[data_type]

    def sector_count(self) -> int:
        """From the table's header alone."""
        found = [self.struct(L.DDT_HEADER, L.DDT, offset)[4] for _, of, offset in self.entries(L.DDT) if of == L.USER_DATA]
        return found[-1] if found else 0

    def sector_size(self) -> int:
        """Largest of the user data blocks' sector sizes."""
        if not hasattr(self, "_sector_size"):
            self._sector_size = max((self.struct(L.BLOCK_HEADER, L.DATA, offset)[3] for _, of, offset in self.entries(L.DATA) if of == L.USER_DATA), default=0)
        return self._sector_size

    def image_size(self) -> int:
        total = 0
        for kind, _, offset in self.index:
            if kind == L.DATA:
                total += self.struct(L.BLOCK_HEADER, kind, offset)[4]
            elif kind == L.DDT:
                total += self.struct(L.DDT_HEADER, kind, offset)[5]
            elif kind == L.META:
                total += self.struct(L.METADATA, kind, offset)[1]
            elif kind == L.TRKS:
                total += self.struct(L.TRACKS_HEADER, kind, offset)[1] * L.TRACK.size
            elif kind == L.CICM_ID:
                total += self.struct(L.CICM, kind, offset)[1]
        return total

    def geometry(self) -> tuple[int, int, int]:
        """Cylinders, heads and sectors per track; without a record, 16 heads of 63."""
        found = [self.struct(L.GEOMETRY, L.GEOM, offset)[1:] for _, _, offset in self.entries(L.GEOM)]
        return found[-1] if found else (self.sector_count() // 16 // 63, 16, 63)

    def array(self, data_type: int) -> bytes | None:
        """Decoded bytes of the last block of a data type that can be decoded."""
        if data_type not in self.arrays:
            good = [data for _, of, offset in self.entries(L.DATA) if of == data_type for status, _, data in [self._block(offset)] if status == L.OK]
            self.arrays[data_type] = good[-1] if good else None
        return self.arrays[data_type]

    def tracks(self) -> list[tuple]:
        found = []
        for _, _, offset in self.entries(L.TRKS):
            _, n, crc = self.struct(L.TRACKS_HEADER, L.TRKS, offset)
            raw = self.at(offset + L.TRACKS_HEADER.size, n * L.TRACK.size)
            ok = crc64(raw) == int.from_bytes(crc, "big")
            whole = raw[: len(raw) // L.TRACK.size * L.TRACK.size]
            found += [(*t[:6], _text(t[6].split(b"\0")[0], "ascii"), t[7], ok) for t in L.TRACK.iter_unpack(whole)]
        return found

    def sectors(self, low: int, high: int) -> Iterator[tuple[int, bytes | None, int]]:
        """Address, bytes and status of sectors low to high - 1; each run visits its blocks in turn, so each is decoded once."""
        cells = self.table_of(L.USER_DATA)
        if cells is None:
            return
        for start in range(max(low, 0), min(high, len(cells)), RUN):
            run = cells[start : min(start + RUN, high)]
            found: list[tuple[bytes | None, int]] = [(None, L.OK)] * len(run)
            for k in np.argsort(run, kind="stable"):
                cell = int(run[k])
                if cell == 0:
                    found[k] = bytes(self.sector_size()), L.NOT_DUMPED
                    continue
                status, size, data = self.block(cell >> self.shift)
                first = (cell & ((1 << self.shift) - 1)) * size
                if status == L.OK and first + size > len(data):
                    status = L.BAD_BLOCK
                found[k] = (data[first : first + size] if status == L.OK else None), status
            for k, (data, status) in enumerate(found):
                yield start + k, data, status

    def long_sectors(self, low: int, high: int) -> Iterator[tuple[int, bytes | None, int]]:
        """As sectors, with what surrounds the user data: raw disc sectors, or the tag after it."""
        if L.is_optical(self.media_type):
            stored = self.array(L.PREFIX) is not None and self.array(L.SUFFIX) is not None
            fixed = self.array(L.PREFIX_FIXED) is not None and self.array(L.SUFFIX_FIXED) is not None
            if stored or fixed:
                yield from self._raw(low, high)
                return
        tags, width = self.array(L.SUBCHANNEL) or self.array(72) or self.array(73) or self.array(74), L.TAG_BYTES.get(self.media_type)
        for lba, data, status in self.sectors(low, high):
            if width and tags is not None and data is not None:
                data = data[:512].ljust(512, b"\0") + tags[lba * width : (lba + 1) * width].ljust(width, b"\0")
            yield lba, data, status

    def _raw(self, low: int, high: int) -> Iterator[tuple[int, bytes | None, int]]:
        tracks = [t for t in self.tracks() if t[8] and 1 <= t[0] <= 99]
        run: list[list] = []
        for lba, data, status in self.sectors(low, high):
            row, kind = self._assembled(lba, data, status, tracks)
            run.append([lba, *row, kind])
            if len(run) == RUN:
                yield from self._with_codes(run)
                run = []
        yield from self._with_codes(run)

    @staticmethod
    def _with_codes(run: list[list]) -> Iterator[tuple[int, bytes | None, int]]:
        for kind in cdrom.EDC_SPAN:
            of = [r for r in run if r[3] == kind]
            if of:
                made = cdrom.write_codes(np.frombuffer(b"".join(r[1] for r in of), np.uint8).reshape(-1, cdrom.SECTOR), kind)
                for r, sector in zip(of, made):
                    r[1] = sector.tobytes()
        return ((lba, data, status) for lba, data, status, _ in run)

    def _side(self, lba: int, stored: int, fixed: int, width: int) -> tuple[int, bytes | None, int]:
        """Flag, bytes and status of a sector's prefix or suffix; no bytes: to be made."""
        whole = self.array(stored)
        if whole is not None:
            return 0, whole[lba * width : (lba + 1) * width], L.OK
        cells, copies = self.table_of(fixed), self.array(fixed)
        if cells is None or lba >= len(cells):
            return 0, None, L.UNREACHABLE
        flag, place = int(cells[lba]) & 0xFF000000, int(cells[lba]) & 0x00FFFFFF
        if flag in (L.CORRECT, L.FORM1_OK, L.FORM2_OK, L.FORM2_NO_CRC):
            return flag, None, L.OK
        if flag == L.NOT_DUMPED_FIX:
            return flag, None, L.NOT_DUMPED
        if not place or copies is None:
            return flag, None, L.UNREACHABLE
        return flag, copies[(place - 1) * width : place * width], L.OK

    def _assembled(self, lba: int, user: bytes | None, status: int, tracks: list[tuple]) -> tuple[tuple[bytes | None, int], str | None]:
        if status < 0 or user is None:
            return (None, status), None
        track = next((t for t in tracks if t[2] <= lba <= t[3]), None)
        if track is None:
            return (None, L.NO_TRACK), None
        kind, out = track[1], bytearray(cdrom.SECTOR)
        if kind in (0, 1):
            out[: len(user)] = user
            return (bytes(out[: cdrom.SECTOR]), status), None
        if kind not in (2, 3, 4, 5):
            return (None, L.BAD_TRACK), None
        flag, found, status = self._side(lba, L.PREFIX, L.PREFIX_FIXED, 16)
        if flag == L.CORRECT:
            found = cdrom.prefix(lba, 1 if kind == 2 else 2)
        if found is not None:
            out[: len(found)] = found
        if kind == 2:
            out[16 : 16 + 2048] = user[:2048].ljust(2048, b"\0")
            if status:
                return (bytes(out), status), None
            flag, found, status = self._side(lba, L.SUFFIX, L.SUFFIX_FIXED, 288)
            if found is not None:
                out[2064 : 2064 + len(found)] = found
            return (bytes(out), status), cdrom.MODE1 if flag == L.CORRECT else None
        heads, cells = self.array(L.SUBHEADER), self.table_of(L.SUFFIX_FIXED)
        if heads is None:
            out[16:] = user[:2336].ljust(2336, b"\0")
            return (bytes(out), status), None
        out[16:24] = heads[lba * 8 : lba * 8 + 8].ljust(8, b"\0")
        flag = None if cells is None else int(cells[lba]) & 0xFF000000 if lba < len(cells) else L.NOT_DUMPED_FIX
        if status == L.OK and flag == L.NOT_DUMPED_FIX:
            return (bytes(out), L.NOT_DUMPED), None
        size = {L.FORM1_OK: 2048, L.FORM2_OK: 2324, L.FORM2_NO_CRC: 2324}.get(flag, 2328)
        out[24 : 24 + size] = user[:size].ljust(size, b"\0")
        made = {L.FORM1_OK: cdrom.FORM1, L.FORM2_OK: cdrom.FORM2}.get(flag) if status == L.OK else None
        return (bytes(out), status), made


Rows = Iterator[tuple]


def _index(image: Image, low: int, high: int) -> Rows:
    return ((k, kind.decode("latin-1"), data_type, offset) for k, (kind, data_type, offset) in enumerate(image.index))


def _images(image: Image, low: int, high: int) -> Rows:
    kind = "optical disc" if L.is_optical(image.media_type) else "block media"
    head = (L.OK, image.application, image.major, image.minor, image.app_major, image.app_minor, image.media_type, kind, image.index_offset, image.created, image.written)
    try:
        yield (*head, len(image.index), image.sector_count(), image.sector_size(), image.image_size(), *image.geometry())
    except ImageError as e:
        yield (e.status, *head[1:], len(image.index), *[None] * 6)


def _blocks(image: Image, low: int, high: int) -> Rows:
    """Blocks whose header starts in [low, high)."""
    for k, data_type, offset in image.entries(L.DATA):
        if data_type == L.NO_DATA or not low <= offset < high:
            continue
        try:
            _, _, compression, size, stored, length, stored_crc, crc = image.struct(L.BLOCK_HEADER, L.DATA, offset)
        except ImageError as e:
            yield k, data_type, offset, *[None] * 6, e.status, None, None
            continue
        status, _, data = image._block(offset)
        yield k, data_type, offset, compression, size, stored, length, _crc_hex(stored_crc), _crc_hex(crc), status, (crc64(data) == int.from_bytes(crc, "big") if status == L.OK else None), data if status == L.OK else None


def _ddt(image: Image, low: int, high: int) -> Rows:
    cells = image.table_of(L.USER_DATA)
    for lba in range(max(low, 0), min(high, 0 if cells is None else len(cells))):
        cell = int(cells[lba])
        yield lba, cell >> image.shift, cell & ((1 << image.shift) - 1), cell != 0


def _fixes(image: Image, low: int, high: int) -> Rows:
    for name, data_type in (("prefix", L.PREFIX_FIXED), ("suffix", L.SUFFIX_FIXED)):
        cells = image.table_of(data_type)
        for lba in range(max(low, 0), min(high, 0 if cells is None else len(cells))):
            yield lba, name, int(cells[lba]) >> 28, int(cells[lba]) & 0x00FFFFFF


def _media_tags(image: Image, low: int, high: int) -> Rows:
    """The last block of a tag type counts."""
    last = {L.media_tag_type(t): (k, t, offset) for k, t, offset in image.entries(L.DATA) if L.media_tag_type(t) >= 0}
    for tag, (k, data_type, offset) in sorted(last.items()):
        status, _, data = image._block(offset)
        yield tag, data_type, data if status == L.OK else None, status


def _sector_tags(image: Image, low: int, high: int) -> Rows:
    for data_type, width in L.STRIDES.items():
        data = image.array(data_type) or b""
        for lba in range(max(low, 0), min(high, len(data) // width)):
            yield lba, data_type, data[lba * width : (lba + 1) * width]


def _tracks(image: Image, low: int, high: int) -> Rows:
    return ((k, *t) for k, t in enumerate(image.tracks()))


def _metadata(image: Image, low: int, high: int) -> Rows:
    for _, _, offset in image.entries(L.META):
        _, size, sequence, last, *spans = image.struct(L.METADATA, L.META, offset)
        raw = image.at(offset, size)
        strings = [raw[at : at + n] if n and at + n <= len(raw) else b"" for at, n in zip(spans[::2], spans[1::2])]
        yield sequence, last, *[_text(s, "utf-16-le") for s in strings]


def _hardware(image: Image, low: int, high: int) -> Rows:
    for _, _, offset in image.entries(L.DUMP):
        _, n, length, crc = image.struct(L.HARDWARE_HEADER, L.DUMP, offset)
        raw, at = image.at(offset + L.HARDWARE_HEADER.size, length), 0
        if crc64(raw) != int.from_bytes(crc, "big"):
            continue
        for k in range(n):
            if at + L.HARDWARE.size > len(raw):
                break
            *sizes, extents = L.HARDWARE.unpack_from(raw, at)
            at += L.HARDWARE.size
            strings = []
            for size in sizes:
                strings.append(_text(raw[at : at + size], "utf-8"))
                at += size
            spans = list(L.EXTENT.iter_unpack(raw[at : at + extents * L.EXTENT.size]))
            at += extents * L.EXTENT.size
            yield k, *strings, sorted(spans)


def _checksums(image: Image, low: int, high: int) -> Rows:
    for _, _, offset in image.entries(L.CKSM):
        _, _, n = image.struct(L.CHECKSUM_HEADER, L.CKSM, offset)
        at = offset + L.CHECKSUM_HEADER.size
        for _ in range(n):
            kind, size = L.CHECKSUM.unpack(image.at(at, L.CHECKSUM.size))
            data = image.at(at + L.CHECKSUM.size, size)
            at += L.CHECKSUM.size + size
            yield L.CHECKSUM_NAMES.get(kind, "unknown"), data.rstrip(b"\0").decode("ascii", "replace") if kind == 4 else data.hex()


def _cicm(image: Image, low: int, high: int) -> Rows:
    for _, _, offset in image.entries(L.CICM_ID):
        _, size = image.struct(L.CICM, L.CICM_ID, offset)
        yield (_text(image.at(offset + L.CICM.size, size), "utf-8"),)


def _verification(image: Image, low: int, high: int) -> Rows:
    """Stored and computed checksum of every part that has one and starts in [low, high); the index stands first, at position -1."""
    parts = [(-1, L.INDEX, image.index_offset)] + [(k, kind, offset) for k, (kind, _, offset) in enumerate(image.index) if kind in (L.DATA, L.DDT, L.TRKS, L.DUMP)]
    for k, kind, offset in parts:
        if not low <= offset < high:
            continue
        try:
            if kind == L.INDEX:
                crc, at, size = image.index_crc, L.INDEX_HEADER.size, len(image.index) * L.INDEX_ENTRY.size
            elif kind == L.DATA:
                head = image.struct(L.BLOCK_HEADER, kind, offset)
                crc, at, size = head[6], L.BLOCK_HEADER.size, head[4]
            elif kind == L.DDT:
                head = image.struct(L.DDT_HEADER, kind, offset)
                crc, at, size = head[7], L.DDT_HEADER.size, head[5]
            elif kind == L.TRKS:
                head = image.struct(L.TRACKS_HEADER, kind, offset)
                crc, at, size = head[2], L.TRACKS_HEADER.size, head[1] * L.TRACK.size
            else:
                head = image.struct(L.HARDWARE_HEADER, kind, offset)
                crc, at, size = head[3], L.HARDWARE_HEADER.size, head[2]
        except ImageError as e:
            yield k, kind.decode("latin-1"), offset, None, None, e.status
            continue
        state, done = Crc64(), 0
        while done < size and (piece := image.at(offset + at + done, min(PIECE, size - done))):
            state.update(piece)
            done += len(piece)
        got = f"{state.value:016X}"
        yield k, kind.decode("latin-1"), offset, _crc_hex(crc), got, L.BAD_BLOCK if done < size else L.OK if got == _crc_hex(crc) else L.BAD_CRC


def _sectors(image: Image, low: int, high: int) -> Rows:
    return image.sectors(low, high)


def _long(image: Image, low: int, high: int) -> Rows:
    return image.long_sectors(low, high)


#: Per table: how an image is split (whole, by the offsets of blocks, by sector), columns after path, and its rows.
TABLES: dict[str, tuple[str, str, Callable[[Image, int, int], Rows]]] = {
    "images": ("whole", "status int, application string, major int, minor int, application_major int, application_minor int, media_type bigint, media_class string, index_offset bigint, creation_time bigint, last_written_time bigint, index_entries int, sectors bigint, sector_size bigint, image_size bigint, cylinders bigint, heads bigint, sectors_per_track bigint", _images),
    "image_index": ("whole", "position int, block_type string, data_type int, block_offset bigint", _index),
    "blocks": ("offset", "position int, data_type int, block_offset bigint, compression int, sector_size bigint, stored_length bigint, length bigint, stored_crc64 string, crc64 string, status int, crc_ok boolean, payload binary", _blocks),
    "ddt": ("sector", "lba bigint, block_offset bigint, sector_in_block bigint, dumped boolean", _ddt),
    "cd_fix": ("sector", "lba bigint, kind string, flag int, position bigint", _fixes),
    "media_tags": ("whole", "tag_type int, data_type int, data binary, status int", _media_tags),
    "sector_tags": ("sector", "lba bigint, data_type int, data binary", _sector_tags),
    "tracks": ("whole", "position int, sequence int, type int, first_lba bigint, last_lba bigint, pregap bigint, session int, isrc string, flags int, crc_ok boolean", _tracks),
    "image_metadata": ("whole", "media_sequence int, last_media_sequence int, " + ", ".join(f"{n} string" for n in L.METADATA_NAMES), _metadata),
    "dump_hardware": ("whole", "position int, " + ", ".join(f"{n} string" for n in L.HARDWARE_NAMES) + ", extents array<struct<first_lba: bigint, last_lba: bigint>>", _hardware),
    "image_checksums": ("whole", "algorithm string, digest string", _checksums),
    "cicm": ("whole", "xml string", _cicm),
    "verification": ("offset", "position int, block_type string, block_offset bigint, expected string, actual string, status int", _verification),
    "sectors": ("sector", "lba bigint, data binary, status int", _sectors),
    "sectors_long": ("sector", "lba bigint, data binary, status int", _long),
}
WHOLE = (0, 1 << 63)


def rows(path: str, file: BinaryIO, table: str, low: int = WHOLE[0], high: int = WHOLE[1]) -> Rows:
    """Rows of one image. What cannot be opened has one row in images and verification, with its status, and none elsewhere."""
    try:
        image = Image(file)
        for row in TABLES[table][2](image, low, high):
            yield path, *row
    except ImageError as e:
        width = TABLES[table][1].count(",")
        if low == 0 and table == "images":
            yield path, e.status, *[None] * width
        elif low == 0 and table == "verification":
            yield path, -1, *[None] * 4, e.status
