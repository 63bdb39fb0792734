import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import jpeg_media as j


class Bits:
    def __init__(self):
        self.bits = ""

    def put(self, code, n):
        self.bits += f"{int(code):0{n}b}" if n else ""

    def value(self, v):
        n = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << n) - 1, n)

    def raw(self):
        b = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(b[k : k + 8], 2) for k in range(0, len(b), 8)).replace(b"\xff", b"\xff\x00")


def colour_file(width, height, planes, restart):
    """A plain writer, a value at a time: three components, the first sampled twice each way, one scan."""
    dc, ac = j.codes(j.DC_TABLE), j.codes(j.AC_TABLE)
    across, down = -(-width // 16), -(-height // 16)
    out, bits, last, n = b"", Bits(), [0, 0, 0], 0
    for m in range(across * down):
        if restart and m and m % restart == 0:
            out += bits.raw() + bytes([0xFF, 0xD0 + n % 8])
            bits, last, n = Bits(), [0, 0, 0], n + 1
        for c, size in enumerate((2, 1, 1)):
            for y in range(size):
                for x in range(size):
                    block = planes[c][(m // across * size + y) * across * size + m % across * size + x]
                    diff = int(block[0]) - last[c]
                    last[c] = int(block[0])
                    k = abs(diff).bit_length()
                    bits.put(dc[0][k], dc[1][k])
                    bits.value(diff)
                    run = 0
                    for v in map(int, block[1:]):
                        if not v:
                            run += 1
                            continue
                        while run > 15:
                            bits.put(ac[0][0xF0], ac[1][0xF0])
                            run -= 16
                        s = run << 4 | abs(v).bit_length()
                        bits.put(ac[0][s], ac[1][s])
                        bits.value(v)
                        run = 0
                    if run:
                        bits.put(ac[0][0], ac[1][0])
    seg = lambda m, b: struct.pack(">BBH", 255, m, len(b) + 2) + b
    frame = struct.pack(">BHHB", 8, height, width, 3) + b"\x01\x22\x00\x02\x11\x01\x03\x11\x01"
    tables = b"\x00" + b"".join(j.DC_TABLE) + b"\x10" + b"".join(j.AC_TABLE)
    head = b"\xff\xd8" + seg(0xDB, b"\x00" + bytes([8] * 64) + b"\x01" + bytes([3] * 64)) + seg(0xC0, frame) + seg(0xC4, tables) + seg(0xDD, struct.pack(">H", restart))
    return head + seg(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00") + out + bits.raw() + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1, 2])
def test_colour_images_of_a_plain_writer(restart):
    r = np.random.Generator(np.random.PCG64(restart))
    files, want = [], []
    for width, height in [(16, 16), (40, 17), (5, 50)]:
        n = -(-width // 16) * -(-height // 16)
        planes = [np.where(r.random((n * k, 64)) < 0.2, r.integers(-300, 300, (n * k, 64)), 0) for k in (4, 1, 1)]
        files.append(colour_file(width, height, planes, restart))
        want.append((width, height, planes))
    for image, (width, height, planes) in zip(j.decode(files), want, strict=True):
        assert (image.width, image.height) == (width, height)
        assert all((a == b).all() for a, b in zip(image.planes, planes, strict=True))
        thumb = image.thumbnail()
        assert thumb.shape == (-(-height // 8), -(-width // 8))
        assert thumb[0, 0] == min(255, max(0, round(planes[0][0, 0] * 8 / 8 + 128)))


def test_payloads_come_back():
    r = random.Random(1)
    made = [bytes(r.choice([0, 128, 128, 128, 255, 127, 129]) if r.random() < 0.9 else r.randrange(256) for _ in range(64 * n)) for n in (1, 2, 3, 4, 5, 16, 17, 99)]
    made += [b"\x80" * 192, b"\xff" * 640, bytes(64)]
    assert [j.payload_of(x) for x in j.decode(j.encode(made))] == made


def test_broken_files():
    file = j.encode([bytes(range(64)) * 9])[0]
    for bad in (b"", file[1:], file[: len(file) // 2], file.replace(b"\xff\xc0", b"\xff\xc2"), file.replace(b"\xff\xd0", b"")):
        with pytest.raises(ValueError):
            j.decode([bad])


def test_media_of_documents(spark):
    rows = [(1, "abc"), (2, ""), (3, None), (4, "é日😀\x00 " * 900), (5, "x" * 64), (5, "x" * 64), (None, "abc")]
    got = j.media(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as width")).collect()
    want = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        want[(i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    a, b = (r for r in got if r.doc_id in (1, None))
    assert tuple(a)[4:] == tuple(b)[4:] and a.width == a.height == 8
    assert j.media(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_column_of_files(spark, tmp_path):
    """Files of a written table, some null, broken or none of ours, with columns of clashing names."""
    good, other = j.encode([bytes(range(64)) * 40]), j.encode([b"a" * 64])[0]
    files = [good[0], None, b"", b"no image", good[0][:200], other, good[0][:-30]]
    rows = spark.createDataFrame(list(enumerate(files)), "width long, file binary")
    rows.write.parquet(str(tmp_path / "files"))
    got = j.decoded(spark.read.parquet(str(tmp_path / "files")).withColumnRenamed("width", "id"), "file", ("id",)).orderBy("id").collect()
    image = j.decode(good)[0]
    assert (got[0].width, got[0].height, bytes(got[0].thumbnail)) == (image.width, image.height, image.thumbnail().tobytes()) and got[0].error is None
    assert [r.error is None for r in got] == [True, False, False, False, False, True, False] and all(r.width is None for r in got if r.error)


def test_very_long_texts(spark):
    rows = [(1, "word é " * 60_000), (2, "x" * 300_000)]
    got = {r.doc_id: r for r in j.media(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        raw = t.encode()
        raw += bytes(-len(raw) % 64)
        assert (got[i].payload_bytes, got[i].payload_sha256) == (len(raw), j.hashlib.sha256(raw).hexdigest())
