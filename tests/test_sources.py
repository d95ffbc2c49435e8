import io

import pytest
from pyspark.sql import functions as F

from platter import layout as L
from platter.functions import cdrom, codecs
from platter.functions.checksums import crc64
from platter.operators import access, verify
from platter.sources.format import register, scan
from platter.sources.image import Image, ImageError, rows
from platter.sources.writer import Parts, build


def read(data, table):
    return [r[1:] for r in rows("x", io.BytesIO(data), table)]


def sectors(n, size=512):
    return [b"%d" % k + bytes(size - len(b"%d" % k)) for k in range(n)]


@pytest.mark.parametrize("kind", [codecs.NONE, codecs.LZMA, codecs.FLAC, codecs.LZMA_PLANES])
def test_sectors_of_all_codecs(kind):
    held = sectors(70) + sectors(3) + [None]
    data = build(Parts(held, compression=kind, table_compression=codecs.LZMA))
    assert read(data, "sectors") == [(k, s or bytes(512), int(s is None)) for k, s in enumerate(held)]
    assert len({r[1:3] for r in read(data, "ddt") if r[3]}) == 70
    assert all(r[5] == 0 for r in read(data, "verification"))


def test_files_that_cannot_be_opened():
    good = build(Parts(sectors(1)))
    newer = bytearray(good)
    newer[72] = 2
    for data, status in ((b"", L.TOO_SMALL), (good[:103], L.TOO_SMALL), (b"x" * 200, L.BAD_MAGIC), (bytes(newer), L.BAD_VERSION), (good[:-30], L.BAD_INDEX)):
        with pytest.raises(ImageError) as e:
            Image(io.BytesIO(data))
        assert e.value.status == status
        assert [r[0] for r in read(data, "images")] == [status] and not read(data, "sectors")
        assert [r[5] for r in read(data, "verification")] == [status]


def test_typed_by_hand():
    """A header and an index of one entry, written digit by digit."""
    entry = b"DBLK" + bytes.fromhex("0000" + "6800000000000000")
    head = b"DICMFRMT" + "é".encode("utf-16-le").ljust(64, b"\0") + bytes.fromhex("01000203" + "0a000000" + "6800000000000000" + "0100000000000000" * 2)
    data = head + b"INDX" + bytes.fromhex("0100") + crc64(entry).to_bytes(8, "big") + entry
    image = Image(io.BytesIO(data))
    assert (image.application, image.media_type, image.app_major, image.app_minor, image.created) == ("é", 10, 2, 3, 1)
    assert read(data, "image_index") == [(0, "DBLK", 0, 104)]
    assert read(data, "verification")[0][5] == 0


def test_damage():
    data = bytearray(build(Parts(sectors(40), compression=codecs.LZMA)))
    data[L.HEADER.size + L.BLOCK_HEADER.size] = 0xFF
    assert {r[2] for r in read(bytes(data), "sectors")} == {L.BAD_PAYLOAD, 0}
    data[L.HEADER.size + 6] = 9
    assert {r[2] for r in read(bytes(data), "sectors")} == {L.BAD_COMPRESSION, 0}
    assert [r[5] for r in read(bytes(data), "verification")].count(L.BAD_CRC) == 1


def test_records():
    parts = Parts(sectors(3), metadata={"creator": "ann", "drive_firmware_revision": "1.0"}, hardware=[(["a", "", "c", "", "", "", "", "d"], [(5, 9), (0, 3)])], checksums=[(2, b"\1\2"), (4, b"3:a:b")], cicm="<a/>", geometry=(7, 8, 9), tracks=[(1, 1, 0, 2, 0, 1, "ISRC", 4)])
    data = build(parts)
    assert read(data, "image_metadata")[0][2] == "ann" and read(data, "image_metadata")[0][-1] == "1.0"
    assert read(data, "dump_hardware") == [(0, "a", None, "c", None, None, None, None, "d", [(0, 3), (5, 9)])]
    assert read(data, "image_checksums") == [("sha1", "0102"), ("spamsum", "3:a:b")]
    assert read(data, "cicm") == [("<a/>",)] and read(data, "images")[0][-3:] == (7, 8, 9)
    assert read(data, "tracks") == [(0, 1, 1, 0, 2, 0, 1, "ISRC", 4, True)]


def mode2(flag):
    users = [bytes([k]) * 2328 for k in (1, 2)]
    heads = bytes([0, 0, 0x20 if flag == L.FORM2_OK else 0, 0] * 2) * 2
    blobs = [(L.PREFIX_FIXED, bytes(16), 0), (L.SUFFIX_FIXED, bytes(288), 0), (L.SUBHEADER, heads, 0)]
    return build(Parts(users, 2328, media_type=15, blobs=blobs, tracks=[(1, 5, 0, 1, 0, 1, "", 4)], prefix_cells=[L.CORRECT] * 2, suffix_cells=[flag] * 2))


@pytest.mark.parametrize(("flag", "size", "status"), [(L.FORM1_OK, 2048, 0), (L.FORM2_OK, 2324, 0), (L.FORM2_NO_CRC, 2324, 0), (L.NOT_DUMPED_FIX, 0, 1), (0, 2328, 0)])
def test_mode_2(flag, size, status):
    for lba, data, got in read(mode2(flag), "sectors_long"):
        assert got == status and len(data) == cdrom.SECTOR and data[:16] == cdrom.prefix(lba, 2)
        assert data[24 : 24 + size] == bytes([lba + 1]) * size
        if flag in (L.FORM1_OK, L.FORM2_OK):
            assert not cdrom.check([data]).failed.any()


def test_stored_prefix_and_missing_track():
    users = sectors(2, 2048)
    blobs = [(L.PREFIX, b"P" * 32, 0), (L.SUFFIX, b"S" * 576, 0)]
    data = build(Parts(users, 2048, media_type=15, blobs=blobs, tracks=[(1, 2, 0, 0, 0, 1, "", 4)]))
    first, second = read(data, "sectors_long")
    assert first == (0, b"P" * 16 + users[0] + b"S" * 288, 0) and second == (1, None, L.NO_TRACK)


def test_files(spark, tmp_path):
    """Cut files give the rows of whole ones, with filters pushed down or not."""
    register(spark)
    held = {"a": sectors(300), "b": sectors(5), "c": [None]}
    for name, s in held.items():
        (tmp_path / name).write_bytes(build(Parts(s)))
    (tmp_path / "d").write_bytes(b"no image")
    load = lambda table: spark.read.format("platter").option("table", table).option("splitBytes", 20000).load(str(tmp_path))
    assert load("sectors").rdd.getNumPartitions() > 3
    found = {(r.path[-1], r.lba): bytes(r.data) for r in load("sectors").collect()}
    assert found == {(n, k): x or bytes(0) for n, s in held.items() for k, x in enumerate(s)}
    assert {r.path[-1] for r in load("sectors").filter("lba = 4").collect()} == {"a", "b"}
    assert load("sectors").filter("lba >= 290 AND lba < 295").count() == 5
    assert {r.path[-1]: r.status for r in load("images").collect()} == {"a": 0, "b": 0, "c": 0, "d": L.TOO_SMALL}
    verdict = {r.path[-1]: r.status for r in verify.verify_images(load("verification")).collect()}
    assert verdict == {"a": 0, "b": 0, "c": 0, "d": L.TOO_SMALL}
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert scan(files, "sectors").count() == 306
    assert load("blocks").select(F.sum("length")).head()[0] == 305 * 512


def test_lookups(spark):
    data = build(Parts(sectors(6, 2048), 2048, media_type=10, tracks=[(1, 1, 0, 1, 0, 1, "", 0), (2, 1, 2, 3, 0, 1, "", 0), (100, 1, 0, 5, 0, 1, "", 0)]))
    images = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(build(Parts(sectors(1)))))], "path string, content binary")
    asked = spark.createDataFrame([("a", 1, 1), ("a", 2, 3), ("a", 2, 9), ("a", 3, 0), ("b", 1, 0), ("z", 1, 0)], "path string, track int, relative bigint")
    found = access.read_track_sectors(scan(images, "images"), scan(images, "tracks"), scan(images, "sectors"), asked).collect()
    assert {(r.path, r.track, r.relative): (r.status, r.past_end) for r in found} == {("a", 1, 1): (0, False), ("a", 2, 3): (0, True), ("a", 2, 9): (L.OUT_OF_BOUNDS, True), ("a", 3, 0): (L.NO_TRACK, None), ("b", 1, 0): (L.WRONG_MEDIA, None), ("z", 1, 0): (L.WRONG_MEDIA, None)}
    track = {r.lba: r.track for r in access.sectors_with_track(scan(images, "sectors"), scan(images, "tracks")).filter("path = 'a'").collect()}
    assert track == {0: 1, 1: 1, 2: 2, 3: 2, 4: None, 5: None}
