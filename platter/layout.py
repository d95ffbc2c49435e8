"""The container format: structures, codes and status values. All are fixed values of the format."""

from __future__ import annotations

import struct

MAGICS = (b"DICMFRMT", b"AARUFRMT")
NEWEST_MAJOR = 1

HEADER = struct.Struct("<8s64s4BIQqq")
DDT_HEADER = struct.Struct("<4sHHBQQQ8s8s")
INDEX_HEADER = struct.Struct("<4sH8s")
INDEX_ENTRY = struct.Struct("<4sHQ")
BLOCK_HEADER = struct.Struct("<4sHHIII8s8s")
GEOMETRY = struct.Struct("<4s3I")
METADATA = struct.Struct("<4sIii24I")
TRACKS_HEADER = struct.Struct("<4sH8s")
TRACK = struct.Struct("<BBqqqB13sB")
CICM = struct.Struct("<4sI")
HARDWARE_HEADER = struct.Struct("<4sHI8s")
HARDWARE = struct.Struct("<9I")
EXTENT = struct.Struct("<QQ")
CHECKSUM_HEADER = struct.Struct("<4sIB")
CHECKSUM = struct.Struct("<BI")

#: Block kinds as their four bytes in the file.
DATA, DDT, INDEX, GEOM, META, TRKS, CICM_ID, CKSM, DUMP = b"DBLK", b"DDT*", b"INDX", b"GEOM", b"META", b"TRKS", b"CICM", b"CKSM", b"DMP*"

NO_DATA, USER_DATA = 0, 1
PREFIX, SUFFIX, SUBCHANNEL, PREFIX_FIXED, SUFFIX_FIXED, SUBHEADER = 69, 70, 71, 76, 77, 78
#: Bytes per sector of the arrays that go with sectors; Apple profile 20, Apple Sony 12, Priam 24.
STRIDES = {PREFIX: 16, SUFFIX: 288, SUBCHANNEL: 96, 72: 20, 73: 12, 74: 24, SUBHEADER: 8}
#: Per media type: bytes of the tag that follows each 512-byte sector.
TAG_BYTES = {184: 12, 185: 12, 186: 20, 690: 20, 691: 20, 693: 24}

#: Data type to media tag type: runs of (first data type, last, first tag type); all others have none.
TAG_RUNS = ((2, 7, 0), (8, 68, 7), (75, 75, 6), (79, 79, 68))
#: Media types that are optical discs; all others are block media.
OPTICAL_RUNS = ((10, 31), (34, 35), (40, 56), (60, 64), (70, 77), (80, 84), (112, 118), (130, 133), (150, 153), (155, 155), (171, 179), (453, 453), (463, 464), (694, 694), (740, 742))

CHECKSUM_NAMES = {0: "invalid", 1: "md5", 2: "sha1", 3: "sha256", 4: "spamsum"}
#: Flags of repaired sectors, in the cell's top byte.
NOT_DUMPED_FIX, CORRECT, FORM1_OK, FORM2_OK, FORM2_NO_CRC = (k << 28 for k in range(1, 6))

OK, NOT_DUMPED = 0, 1
BAD_MAGIC, TOO_SMALL, BAD_VERSION, BAD_INDEX, OUT_OF_BOUNDS, BAD_HEADER, BAD_BLOCK, BAD_COMPRESSION = range(-1, -9, -1)
NO_TAG, WRONG_MEDIA, NO_TRACK, UNREACHABLE, BAD_TRACK, NO_SECTOR_TAG, BAD_PAYLOAD, BAD_CRC = range(-11, -19, -1)

METADATA_NAMES = ("creator", "comments", "media_title", "media_manufacturer", "media_model", "media_serial_number", "media_barcode", "media_part_number", "drive_manufacturer", "drive_model", "drive_serial_number", "drive_firmware_revision")
HARDWARE_NAMES = ("manufacturer", "model", "revision", "firmware", "serial", "software_name", "software_version", "software_operating_system")


def media_tag_type(data_type: int) -> int:
    return next((tag + data_type - first for first, last, tag in TAG_RUNS if first <= data_type <= last), -1)


def is_optical(media_type: int) -> bool:
    return any(first <= media_type <= last for first, last in OPTICAL_RUNS)
