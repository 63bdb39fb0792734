"""Baseline JPEG: bytes stored as coefficients, scans decoded in lock step, thumbnails from DC values.

encode() stores a payload as the quantised coefficients of a grey image, 64 bytes a block in zigzag order, each byte less 128;
the entropy coding is lossless, so decoding gives the bytes back. The image is about square; blocks that fill up the last row
are zero, and a comment holds the payload's length. Restart markers every few blocks cut the scan into many short segments.

decode() reads any baseline JPEG (8 bits, up to four components, one or several scans, any sampling). It parses the markers,
removes stuffing, and advances all segments of a whole batch of images together, one Huffman symbol of each at every step, with
numpy. Luminance is the first component: a DC value times its quantiser over 8, plus 128, is the mean of a block, which is a
pixel of the thumbnail. No inverse transform is done.

Null text counts as empty: one block of zero bytes. Repeated rows are stored each. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, texts_of, with_columns

#: Annex K: how many codes of each length, and the symbols in order of code.
DC_TABLE = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12)))
AC_TABLE = (
    bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 0x7D]),
    bytes.fromhex(
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
        "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
        "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
    ),
)
RESTART = 4
SIZE_OF = np.array([int(v).bit_length() for v in range(4096)], np.int64)


def codes(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol, length 0 where it has none."""
    code, length, at, k = np.zeros(256, np.uint64), np.zeros(256, np.int64), 0, 0
    for bits, n in enumerate(table[0], 1):
        for symbol in table[1][k : k + n]:
            code[symbol], length[symbol] = at, bits
            at += 1
        at, k = at << 1, k + n
    return code, length


@lru_cache(4)
def tokens(table: tuple[bytes, bytes]) -> np.ndarray:
    """For each value from -2047 up that follows no zero: code and value's bits << 5 | their number; 0 where it has none."""
    code, length = codes(table)
    v = np.arange(-2047, 2048)
    size = np.minimum(SIZE_OF[np.abs(v)], 15)
    bits = np.where(v < 0, v + (1 << size) - 1, v)
    out = (code[size].astype(np.int64) << size | bits) << 5 | (length[size] + size)
    out[length[size] == 0] = 0
    if len(table[1]) > 16:
        out[2047] = 0  # a zero among the others is part of a run
    return out


def _with_runs(values, zero, code, length):
    """Put the runs of zeros before the values that follow them, and the ends of blocks."""
    ac_code, ac_length = codes(AC_TABLE)
    late = np.flatnonzero(~zero[:, 1:].ravel() & zero[:, :-1].ravel())
    block, at = late // 63, late % 63 + 1
    before = np.maximum.accumulate(np.where(zero, 0, np.arange(64)), axis=1)[block, at - 1]
    run, value = at - before - 1, values[block, at].astype(np.int64)
    size = SIZE_OF[np.abs(value)]
    symbol = (run & 15) << 4 | size
    of, n = ac_code[symbol], ac_length[symbol]
    for k in range(3):
        long = run >> 4 > k
        of[long] |= ac_code[0xF0] << n[long].astype(np.uint64)
        n[long] += ac_length[0xF0]
    code[block, at] = of << size.astype(np.uint64) | np.where(value < 0, value + (1 << size) - 1, value).astype(np.uint64)
    length[block, at] = n + size
    ends = zero[:, 63]
    code[ends, 63], length[ends, 63] = ac_code[0], ac_length[0]
    return code, length


#: Bits looked up at once. A symbol whose code and value take more is put together apart.
PEEK = 18


@lru_cache(64)
def lookup(table: tuple[bytes, bytes], is_dc: bool) -> np.ndarray:
    """For each PEEK bits: value << 16 | zeros before it << 5 | bits used. Zeros 64: the end of the block. 0: not of these."""
    code, length = codes(table)
    out = np.zeros(1 << PEEK, np.int32)
    for symbol in table[1]:
        size, n = symbol & 15, int(length[symbol])
        run = 0 if is_dc else 64 if symbol < 0xF0 and not size else symbol >> 4
        if n + size <= PEEK:
            extra = np.arange(1 << size)
            value = np.where(extra >> max(size - 1, 0), extra, extra - (1 << size) + 1) if size else extra * 0
            words = value << 16 | run << 5 | (n + size)
            rest = PEEK - n - size
            out[int(code[symbol]) << (PEEK - n) : (int(code[symbol]) + 1) << (PEEK - n)] = np.repeat(words, 1 << rest)
    return out


def _by_bits(data: np.ndarray, bit: int, table: tuple[bytes, bytes], is_dc: bool) -> tuple[int, int, int]:
    """Value, zeros before it and bits used of the symbol at a bit."""
    code, length = codes(table)
    ahead = int.from_bytes(data[bit >> 3 : (bit >> 3) + 8].tobytes(), "big") << (bit & 7) & (1 << 64) - 1
    for symbol in table[1]:
        n, size = int(length[symbol]), symbol & 15
        if ahead >> (64 - n) == int(code[symbol]):
            extra = ahead >> (64 - n - size) & ((1 << size) - 1)
            value = extra if size and extra >> (size - 1) else extra - (1 << size) + 1 if size else 0
            return value, 0 if is_dc else 64 if symbol < 0xF0 and not size else symbol >> 4, n + size
    raise ValueError("a code that no table has")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def shape_of(blocks: int) -> tuple[int, int]:
    """Blocks across and down of the image for so many blocks."""
    across = int(np.ceil(np.sqrt(blocks)))
    return across, -(-blocks // across)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload, whose length is a positive multiple of 64."""
    if any(len(p) % 64 or not p for p in payloads):
        raise ValueError("a payload's length is a positive multiple of 64")
    shapes = [shape_of(len(p) // 64) for p in payloads]
    total = np.array([a * d for a, d in shapes])
    values = np.zeros((int(total.sum()), 64), np.int16)
    firsts = np.r_[0, np.cumsum(total)]
    for p, first in zip(payloads, firsts, strict=False):
        values[first : first + len(p) // 64] = np.frombuffer(p, np.uint8).reshape(-1, 64).astype(np.int16) - 128
    nth = np.arange(len(values)) - np.repeat(firsts[:-1], total)
    opens = nth % RESTART == 0
    values[1:, 0] -= np.where(opens[1:], 0, values[:-1, 0].copy())

    dc_token, ac_token = tokens(DC_TABLE), tokens(AC_TABLE)
    made = ac_token[values + 2047]
    made[:, 0] = dc_token[values[:, 0] + 2047]
    length, code = (made & 31).astype(np.int64), made >> 5
    zero = values == 0
    zero[:, 0] = False
    if zero.any():
        code, length = _with_runs(values, zero, code.astype(np.uint64), length)
    code = code.astype(np.uint64)

    bits = length.sum(1)
    starts = np.flatnonzero(opens)
    seg_bits = np.add.reduceat(bits, starts)
    seg_bytes = -(-seg_bits // 8)
    seg_at = np.r_[0, np.cumsum(seg_bytes)]
    code, length = code.ravel(), length.ravel()
    at = np.cumsum(length) - length
    at += np.repeat(seg_at[:-1] * 8 - (np.cumsum(seg_bits) - seg_bits), np.diff(np.r_[starts, len(values)]) * 64)
    if (length == 0).any():
        has = length > 0
        code, length, at = code[has], length[has], at[has]
    words = np.zeros(seg_at[-1] // 8 + 2, np.uint64)
    code <<= (64 - length).astype(np.uint64)
    word, off = at >> 6, (at & 63).astype(np.uint64)
    cut = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words[word[cut]] = np.add.reduceat(code >> off, cut)
    over = np.flatnonzero((at & 63) + length > 64)
    words[word[over] + 1] |= code[over] << (np.uint64(64) - off[over])
    scan = words.byteswap().view(np.uint8)[: seg_at[-1]]
    scan[seg_at[1:] - 1] |= ((1 << (seg_bytes * 8 - seg_bits)) - 1).astype(np.uint8)

    stuffed = scan == 0xFF
    moved = np.cumsum(stuffed) - stuffed
    seg_nth = nth[starts] // RESTART
    marks = np.cumsum(seg_nth > 0)
    to = np.arange(len(scan)) + moved + 2 * np.repeat(marks, seg_bytes)
    out = np.zeros(len(scan) + int(stuffed.sum()) + 2 * int(marks[-1]), np.uint8)
    out[to] = scan
    inner = np.flatnonzero(seg_nth > 0)
    out[to[seg_at[inner]] - 2] = 0xFF
    out[to[seg_at[inner]] - 1] = 0xD0 + (seg_nth[inner] - 1) % 8
    heads = to[seg_at[np.flatnonzero(seg_nth == 0)]]
    raw = out.tobytes()
    tables = _segment(0xC4, b"\x00" + b"".join(DC_TABLE)) + _segment(0xC4, b"\x10" + b"".join(AC_TABLE)) + _segment(0xDD, struct.pack(">H", RESTART)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    quantiser = _segment(0xDB, b"\x00" + b"\x01" * 64)
    files = []
    for p, (across, down), first, last in zip(payloads, shapes, heads.tolist(), [*heads[1:].tolist(), len(raw)], strict=True):
        if max(across, down) > 8191:
            raise ValueError("more than a JPEG's 65,535 rows")
        frame = _segment(0xC0, struct.pack(">BHHB", 8, down * 8, across * 8, 1) + b"\x01\x11\x00")
        files.append(b"\xff\xd8" + _segment(0xFE, b"payload %d" % len(p)) + quantiser + frame + tables + raw[first:last] + b"\xff\xd9")
    return files


@dataclass
class Image:
    width: int = 0
    height: int = 0
    #: Of each component: id, horizontal and vertical sampling, quantiser's number.
    components: list[tuple[int, int, int, int]] = field(default_factory=list)
    quantisers: dict[int, tuple[int, ...]] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)
    #: Of each component: blocks across and down, and the coefficients in zigzag order, as decoded.
    shapes: list[tuple[int, int]] = field(default_factory=list)
    planes: list[np.ndarray] = field(default_factory=list)

    def thumbnail(self) -> np.ndarray:
        """Luminance, a pixel for each block that the image covers."""
        (across, down), (_, h, v, q) = self.shapes[0], self.components[0]
        dc = self.planes[0][:, 0].reshape(down, across)
        hs, vs = max(c[1] for c in self.components), max(c[2] for c in self.components)
        dc = dc[: -(-self.height * v // (8 * vs)), : -(-self.width * h // (8 * hs))]
        return np.clip(np.round(dc * self.quantisers[q][0] / 8 + 128), 0, 255).astype(np.uint8)


def _parse(data: bytes, image: Image, streams: list) -> None:
    """Read the markers; put each segment of each scan on streams, with the block places it fills."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    at, interval, tables = 2, 0, {}
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quantisers[body[0] & 15] = struct.unpack(">64H" if wide else ">64B", body[1 : 129 if wide else 65])
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xFE:
            image.comments.append(body)
        elif marker in (0xC0, 0xC1):
            bits, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8:
                raise ValueError("not 8 bits")
            image.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            hs, vs = max(c[1] for c in image.components), max(c[2] for c in image.components)
            mcus = (-(-image.width // (8 * hs)), -(-image.height // (8 * vs)))
            image.shapes = [(mcus[0] * h, mcus[1] * v) for _, h, v, _ in image.components]
            image.planes = [np.zeros((a * d, 64), np.int32) for a, d in image.shapes]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDA:
            at = _scan(data, at, body, image, interval, tables, streams)


def _scan(data: bytes, at: int, body: bytes, image: Image, interval: int, tables: dict, streams: list) -> int:
    ids = [c[0] for c in image.components]
    parts = [(ids.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
    raw = np.frombuffer(data, np.uint8, offset=at)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    follows = raw[ff + 1]
    inside = (follows == 0) | (follows >> 3 == 0xD0 >> 3)
    stops = np.flatnonzero(~inside & (follows != 0xFF))
    if not len(stops):
        raise ValueError("the scan has no end")
    end = int(ff[stops[0]])
    ff, follows = ff[: stops[0]], follows[: stops[0]]
    drop, marks = ff[follows == 0] + 1, ff[follows >> 3 == 0xD0 >> 3]
    keep = np.ones(end, bool)
    keep[drop] = False
    keep[marks] = False
    keep[marks + 1] = False
    clean = raw[:end][keep]
    starts = [0, *(marks - np.searchsorted(drop, marks) - 2 * np.arange(len(marks))).tolist()]
    # the order of blocks: of each MCU, of each component
    hs, vs = max(c[1] for c in image.components), max(c[2] for c in image.components)
    if len(parts) == 1:
        c = parts[0][0]
        _, h, v, _ = image.components[c]
        across = -(-image.width * h // (8 * hs))
        down = -(-image.height * v // (8 * vs))
        places = (np.arange(down)[:, None] * image.shapes[c][0] + np.arange(across)).ravel()
        pattern = [0]
    else:
        across, down = image.shapes[0][0] // image.components[0][1], image.shapes[0][1] // image.components[0][2]
        pattern, columns = [], []
        for k, (c, _, _) in enumerate(parts):
            _, h, v, _ = image.components[c]
            for y in range(v):
                for x in range(h):
                    pattern.append(k)
                    columns.append((((np.arange(down) * v + y) * image.shapes[c][0])[:, None] + np.arange(across) * h + x).ravel())
        places = np.stack(columns, 1).ravel()
    each = (interval * len(pattern)) or len(places)
    for k, first in enumerate(range(0, len(places), each)):
        if k >= len(starts):
            raise ValueError("a segment of the scan is missing")
        streams.append((clean[starts[k] : starts[k + 1] if k + 1 < len(starts) else len(clean)], image, [p[0] for p in parts], pattern, places[first : first + each], tuple((tables[p[1]], tables[16 | p[2]]) for p in parts)))
    return at + end


def decode(files: list[bytes]) -> list[Image]:
    """The images with all their coefficients."""
    images, streams = [Image() for _ in files], []
    for data, image in zip(files, images, strict=True):
        _parse(data, image, streams)
    if streams:
        _in_step(streams)
    return images


def _in_step(streams: list) -> None:
    """Decode all segments together, a symbol of each at every step; DC differences are summed up at the end."""
    sets: dict = {}
    for s in streams:
        for dc, ac in s[5]:
            sets.setdefault((dc, True), len(sets))
            sets.setdefault((ac, False), len(sets))
    table, known = np.concatenate([lookup(*t) for t in sets]), list(sets)
    lengths = np.array([len(s[0]) for s in streams])
    data = np.concatenate([x for s in streams for x in (s[0], np.full(8, 0xFF, np.uint8))])
    four = np.zeros(len(data), np.uint32)
    for k in range(4):
        four[: len(data) - k] |= data[k:].astype(np.uint32) << np.uint32(24 - 8 * k)
    bit = (np.cumsum(lengths + 8) - lengths - 8) * 8
    stop = bit + lengths * 8
    # planes lie one behind another; a block's place is its row there
    planes, base, rows = [], {}, 0
    for s in streams:
        for p in s[1].planes:
            if id(p) not in base:
                base[id(p)] = rows
                rows += len(p)
                planes.append(p)
    out = np.zeros(rows * 64, np.int32)
    blocks = np.array([len(s[4]) for s in streams])
    block = np.r_[0, np.cumsum(blocks)[:-1]]
    end = block + blocks
    rows_of, kinds_of, tables_of = [], [], []
    for _, image, parts, pattern, places, pairs in streams:
        bases = np.array([base[id(image.planes[c])] for c in parts])
        kinds = np.resize(np.array(pattern), len(places))
        rows_of.append((places + bases[kinds]) * 64)
        kinds_of.append(kinds)
        tables_of.append(np.array([(sets[dc, True], sets[ac, False]) for dc, ac in pairs])[kinds])
    kinds_of, tables_of = np.concatenate(kinds_of), np.concatenate(tables_of) << PEEK
    rows_of = np.concatenate(rows_of)
    one = len(sets) == 2
    starts = np.full(64, tables_of[0, 1])
    starts[0] = tables_of[0, 0]
    k, place, stop = np.zeros(len(bit), np.int64), rows_of[block], stop.copy()
    down, mask = np.uint32(32 - PEEK), (1 << PEEK) - 1
    while len(k):
        which = starts[k] if one else tables_of[block, (k > 0).view(np.int8)]
        ahead = four[bit >> 3] >> (down - (bit & 7).astype(np.uint32))
        found = table[(ahead & mask) + which]
        used, run, value = found & 31, found >> 5 & 127, found >> 16
        if not used.all():
            for j in np.flatnonzero(used == 0).tolist():
                value[j], run[j], used[j] = _by_bits(data, int(bit[j]), *known[int(which[j]) >> PEEK])
        k += run
        if k.max() > 63:
            over = k > 63
            if (run[over] != 64).any() and (k[over & (run != 64)] > 63).any():
                raise ValueError("a run beyond its block")
            k[over] = 63
        out[place + k] = value
        bit += used
        k += 1
        done = k == 64
        if done.any():
            k[done] = 0
            block += done
            over = block == end
            if over.any():
                if (bit[over] > stop[over]).any():
                    raise ValueError("a segment is too short")
                stay = ~over
                block, k, bit, end, stop = block[stay], k[stay], bit[stay], end[stay], stop[stay]
            place = rows_of[block]
    # each component's differences add up from the start of its segment
    first = np.repeat(np.cumsum(blocks) - blocks, blocks)
    for kind in range(int(kinds_of.max()) + 1):
        diff = np.where(kinds_of == kind, out[rows_of], 0)
        total = np.cumsum(diff, dtype=np.int64)
        of = np.flatnonzero(kinds_of == kind)
        out[rows_of[of]] = total[of] - np.r_[0, total][first[of]]
    at = 0
    for p in planes:
        p[:] = out[at * 64 : (at + len(p)) * 64].reshape(-1, 64)
        at += len(p)


def average_hash(thumbnail: np.ndarray) -> str:
    """64 bits: which of 8 x 8 samples of the thumbnail exceed their mean."""
    y, x = ((np.arange(8) * 2 + 1) * n // 16 for n in thumbnail.shape)
    few = thumbnail[np.ix_(y, x)].astype(np.int64)
    return np.packbits(few * 64 > few.sum()).tobytes().hex()


def payload_of(image: Image) -> bytes:
    n = next(int(c.split()[1]) for c in image.comments if c.startswith(b"payload "))
    return (image.planes[0].reshape(-1)[:n] + 128).astype(np.uint8).tobytes()


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media: each text as a JPEG file, padded to a positive multiple of 64 bytes."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024, most=1 << 20):
            texts = [t.encode("utf-8", "surrogatepass") for t in texts_of(batch)]
            files = encode([t + bytes(-len(t) % 64 if t else 64) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return with_columns(docs, {"doc_id": "long", "text": "string"}).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def _images(files: list[bytes | None]) -> list[Image | str]:
    """Each file's image, or why it can't be read. Files are decoded together; where one is broken, all of the batch one by one."""
    there = [f for f in files if f is not None]
    try:
        found: list[Image | str] = list(decode(there)) if there else []
    except (ValueError, IndexError, KeyError, struct.error):
        found = []
        for f in there:
            try:
                found += decode([f])
            except (ValueError, IndexError, KeyError, struct.error) as e:
                found.append(str(e) or type(e).__name__)
    left = iter(found)
    return ["no file" if f is None else next(left) for f in files]


def decoded(df: DataFrame, column: str = "media", keep: tuple[str, ...] = (), payload: bool = False) -> DataFrame:
    """The columns of keep, and of a binary column of JPEG files, from any writer: width, height, thumbnail (its bytes, row by row,
    a byte for each block of luminance), thumbnail_hash (64 bits as hex), thumbnail_crc32, error.

    A null, broken or progressive file is a row with error and nothing else; it fails no task. payload: also payload_bytes,
    payload_sha256 and tail_crc32 of what encode() stored.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in keep}
    columns = {"width": pa.int32(), "height": pa.int32(), "thumbnail": pa.binary(), "thumbnail_hash": pa.string(), "thumbnail_crc32": pa.int64(), "error": pa.string()}
    columns |= {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64()} if payload else {}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024, column, most=1 << 20):
            rows: dict[str, list] = {c: [] for c in columns}
            for image in _images(batch.column(column).to_pylist()):
                good = not isinstance(image, str)
                thumb = image.thumbnail() if good else None
                values = [image.width, image.height, thumb.tobytes(), average_hash(thumb), zlib.crc32(thumb.tobytes()), None] if good else [None] * 5 + [image]
                if payload:
                    raw = payload_of(image) if good and any(c.startswith(b"payload ") for c in image.comments) else None
                    values += [len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:])] if raw is not None else [None] * 3
                for c, v in zip(columns, values, strict=True):
                    rows[c].append(v)
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), *(pa.array(rows[c], k) for c, k in columns.items())], [*keep, *columns])

    names = {"int32": "int", "int64": "long", "binary": "binary", "string": "string"}
    schema = ", ".join([f"`{c}` {k}" for c, k in kinds.items()] + [f"{c} {names[str(k)]}" for c, k in columns.items()])
    return df.select(*keep, column).mapInArrow(read, schema)


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height.

    Texts are stored as a column of files, which decoded() reads back. feature: the image's size, the thumbnail's average hash and
    its crc32. There is no shuffle; memory is bounded by a few megabytes of texts, or by one text. An empty table gives no rows.
    """
    files = stored(docs).withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    found = decoded(files, "media", ("doc_id", "n_bytes", "media_bytes", "media_sha256"), payload=True)
    feature = F.concat(F.col("width"), F.lit("x"), F.col("height"), F.lit(":"), F.col("thumbnail_hash"), F.lit(":"), F.lower(F.lpad(F.hex("thumbnail_crc32"), 8, "0")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "width", "height")
