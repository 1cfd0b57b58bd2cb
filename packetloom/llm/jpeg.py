"""Baseline JPEG as a media column: parse, Huffman-decode, thumbnails, hashes.

A payload of whole 64-byte units is stored losslessly as the quantised
coefficients of 8 x 8 blocks, the format's own unit: a byte is a signed
coefficient. DC coefficients are written as differences, AC coefficients as
zero runs and magnitude categories, a few blocks to a restart interval.

The decoder reads any baseline file. Restart intervals are independent, so those
of many pictures with the same tables are decoded together: every lane reads its
next code, value and place in one numpy step. Pictures of few intervals are read
code by code.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from packetloom.llm.textkit import chunks, column_bytes

UNIT = 64
#: Widest picture that a frame header can hold, in blocks.
MAX_BLOCKS = 65535 // 8
#: The DC quantiser spreads stored DC values over all luminances.
DC_QUANTISER = 8
#: Blocks of a restart interval that is written.
INTERVAL = 4
#: Fewer lanes than this are read code by code.
LEAST_LANES = 24
END, SIXTEEN_ZEROS = 0x00, 0xF0


def _code_lengths() -> tuple[dict[int, int], dict[int, int]]:
    """Lengths of the DC and AC codes that are written, by symbol: short ones for the categories of letters and spaces."""
    short = {0x07: 1, 0x06: 2, 0x08: 4, 0x05: 4, 0x04: 5, END: 5}
    rest = [run << 4 | size for run in range(16) for size in range(1, 9)] + [SIXTEEN_ZEROS]
    return {size: 4 for size in range(10)}, short | {x: 11 for x in rest if x not in short}


def _table(lengths: dict[int, int]) -> tuple[bytes, bytes]:
    """Code lengths as a table segment has them: how many codes of 1 to 16 bits, and the symbols in the order of their codes."""
    symbols = sorted(lengths, key=lambda x: (lengths[x], x))
    return bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)), bytes(symbols)


def _codes(table: tuple[bytes, bytes]) -> Iterator[tuple[int, int, int]]:
    """(symbol, code, length) of a table."""
    code = at = 0
    for length in range(1, 17):
        for _ in range(table[0][length - 1]):
            yield table[1][at], code, length
            code, at = code + 1, at + 1
        code <<= 1


DC_TABLE, AC_TABLE = map(_table, _code_lengths())


class JpegError(ValueError):
    """A file that is cut, broken or not baseline."""


# ---- writing -----------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def grid(n_blocks: int) -> tuple[int, int]:
    """Columns and rows of blocks of a nearly square picture."""
    columns = min(int(np.ceil(np.sqrt(n_blocks))), MAX_BLOCKS)
    rows = -(-n_blocks // columns)
    if rows > MAX_BLOCKS:
        raise JpegError("the payload is too long for one picture")
    return columns, rows


def encode_payload(payload: bytes) -> bytes:
    """A grey baseline JPEG whose coefficients, in zigzag order, are the payload."""
    return encode_payloads([payload])[0]


def encode_payloads(payloads: Sequence[bytes]) -> list[bytes]:
    """``encode_payload`` of many at once."""
    shapes, coefficients = [], []
    for payload in payloads:
        n = len(payload) // UNIT
        if not n or len(payload) % UNIT:
            raise JpegError("a payload is a positive number of 64-byte units")
        columns, rows = grid(n)
        shapes.append((columns, rows))
        coefficients += [np.frombuffer(payload, dtype=np.int8).reshape(n, UNIT), np.zeros((columns * rows - n, UNIT), dtype=np.int8)]
    if not shapes:
        return []
    n_blocks = [c * r for c, r in shapes]
    scans = _write_scans(np.concatenate(coefficients).astype(np.int32), n_blocks)
    return [_head(len(p), *shape) + scan + b"\xff\xd9" for p, shape, scan in zip(payloads, shapes, scans)]


def _head(n_bytes: int, columns: int, rows: int) -> bytes:
    return b"".join([
        b"\xff\xd8", _segment(0xFE, b"payload %d" % n_bytes), _segment(0xDB, bytes([0, DC_QUANTISER, *[1] * 63])),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, columns * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + b"".join(DC_TABLE)), _segment(0xC4, b"\x10" + b"".join(AC_TABLE)), _segment(0xDD, struct.pack(">H", INTERVAL)), _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ])


#: Bits of the magnitudes of differences of signed bytes.
_CATEGORY = np.array([abs(v).bit_length() for v in range(-255, 256)], dtype=np.int64)


def _categories(values: np.ndarray) -> np.ndarray:
    return _CATEGORY[values + 255]


def _words(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by symbol."""
    code, length = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
    for symbol, c, n in _codes(table):
        code[symbol], length[symbol] = c, n
    return code, length


def _with_value(symbols: np.ndarray, values: np.ndarray, sizes: np.ndarray, words: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes with their values' bits behind them, and the lengths of both."""
    bits = values + np.where(values < 0, (1 << sizes) - 1, 0)
    return words[0][symbols] << sizes | bits, words[1][symbols] + sizes


def _write_scans(blocks: np.ndarray, n_blocks: list[int]) -> list[bytes]:
    """Huffman-coded scans of pictures whose ``blocks`` follow one another."""
    n, first_of_picture = len(blocks), np.cumsum(n_blocks) - np.array(n_blocks)
    within = np.arange(n) - np.repeat(first_of_picture, n_blocks)
    restarts = within % INTERVAL == 0
    dc = blocks[:, 0] - np.where(restarts, 0, np.concatenate([[0], blocks[:-1, 0]]))
    row, column = np.nonzero(blocks[:, 1:])
    column, value = column + 1, blocks[row, column + 1]
    before = np.where(np.concatenate([[-1], row[:-1]]) == row, np.concatenate([[0], column[:-1]]), 0)
    run = column - before - 1
    last = np.zeros(n, dtype=np.int64)
    last[row] = column  # the last of a row is written last
    sixteens = np.repeat(np.arange(len(row)), run // 16)
    nth = np.arange(len(sixteens)) - np.repeat(np.cumsum(run // 16) - run // 16, run // 16)
    open_rows = np.flatnonzero(last < 63)
    dc_sizes, ac_sizes = _categories(dc), _categories(value)
    ac_words = _words(AC_TABLE)
    # Every token has a place in its row: the difference, then for each value its runs of sixteen and itself, then the end.
    tokens = [
        (np.arange(n) * 512, *_with_value(dc_sizes, dc, dc_sizes, _words(DC_TABLE))),
        (row[sixteens] * 512 + column[sixteens] * 6 + nth, np.full(len(sixteens), ac_words[0][SIXTEEN_ZEROS]), np.full(len(sixteens), ac_words[1][SIXTEEN_ZEROS])),
        (row * 512 + column * 6 + 5, *_with_value(run % 16 << 4 | ac_sizes, value, ac_sizes, ac_words)),
        (open_rows * 512 + 510, np.full(len(open_rows), ac_words[0][END]), np.full(len(open_rows), ac_words[1][END])),
    ]
    places, codes, lengths = (np.concatenate(x) for x in zip(*tokens))
    interval = np.cumsum(restarts) - 1
    bits = np.bincount(interval[places // 512], weights=lengths).astype(np.int64)
    # Ones fill an interval's last byte.
    fill, final = -bits % 8, np.append(np.flatnonzero(restarts)[1:], n) - 1
    places, codes, lengths = np.concatenate([places, final * 512 + 511]), np.concatenate([codes, (1 << fill) - 1]), np.concatenate([lengths, fill])
    order = np.argsort(places, kind="stable")
    codes, lengths = codes[order], lengths[order]
    starts = np.cumsum(lengths) - lengths
    shifted, at = codes << (40 - (starts & 7) - lengths), starts >> 3
    sizes = (bits + fill) // 8
    # Tokens that begin in one byte share no bits, so their sum is all of them.
    heads = np.flatnonzero(np.diff(at, prepend=-1))
    merged, at = np.add.reduceat(shifted, heads), at[heads]
    data = np.zeros(int(sizes.sum()) + 5, dtype=np.uint8)
    for j in range(5):
        data[at + j] |= (merged >> (32 - 8 * j) & 0xFF).astype(np.uint8)
    data = data[:-5]
    # A byte goes to its place plus all that is put in before it: 00 after each FF, a marker after each interval but a picture's last.
    full, ends = data == 0xFF, np.cumsum(sizes)
    picture = np.repeat(np.arange(len(n_blocks)), n_blocks)[np.flatnonzero(restarts)]
    marked = np.append(picture[1:] == picture[:-1], False)
    extra = np.cumsum(full) - full + np.repeat(2 * (np.cumsum(marked) - marked), sizes)
    to = np.arange(len(data)) + extra
    out = np.zeros(len(data) + int(full.sum()) + 2 * int(marked.sum()), dtype=np.uint8)
    out[to] = data
    after = to[ends - 1] + full[ends - 1] + 1
    out[after[marked]] = 0xFF
    out[after[marked] + 1] = 0xD0 + (within[np.flatnonzero(restarts)][marked] // INTERVAL) % 8
    bounds = after[~marked]
    return [out[b:e].tobytes() for b, e in zip([0, *bounds[:-1]], bounds)]


# ---- reading -----------------------------------------------------------------------------------


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quantiser: int
    dc: int = 0
    ac: int = 0
    columns: int = 0
    rows: int = 0
    #: (rows, columns, 64) quantised coefficients in zigzag order
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), dtype=np.int16))


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    #: (class, id) -> (lengths of codes 1..16, symbols)
    tables: dict[tuple[int, int], tuple[bytes, bytes]] = field(default_factory=dict)
    restart: int = 0
    comments: list[bytes] = field(default_factory=list)
    scan: bytes = b""


def parse(data: bytes) -> Picture:
    """Read all marker segments up to the scan of a baseline file."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    picture, at = Picture(), 2
    try:
        while True:
            if data[at] != 0xFF:
                raise JpegError(f"no marker at byte {at}")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            size = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if at > len(data) or size < 2:
                raise JpegError("a cut segment")
            if marker == 0xFE:
                picture.comments.append(body)
            elif marker == 0xDB:
                _quantisers(picture, body)
            elif marker in (0xC0, 0xC1):
                _frame(picture, body)
            elif marker == 0xC4:
                _huffman(picture, body)
            elif marker == 0xDD:
                picture.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                _scan_header(picture, body)
                end = data.rfind(b"\xff\xd9")
                if end < at:
                    raise JpegError("no end of image")
                picture.scan = data[at:end]
                return picture
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
                raise JpegError("not a baseline frame")
    except (IndexError, struct.error) as error:
        raise JpegError("a cut file") from error


def _quantisers(picture: Picture, body: bytes) -> None:
    while body:
        wide, size = body[0] >> 4, 64 * (1 + (body[0] >> 4))
        picture.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + size], dtype=">u2" if wide else np.uint8).astype(np.int32)
        body = body[1 + size :]


def _frame(picture: Picture, body: bytes) -> None:
    depth, picture.height, picture.width, n = struct.unpack_from(">BHHB", body)
    if depth != 8 or not picture.height or not picture.width:
        raise JpegError("not 8 bits a sample, or no size")
    picture.components = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]


def _huffman(picture: Picture, body: bytes) -> None:
    while body:
        n = sum(body[1:17])
        picture.tables[body[0] >> 4, body[0] & 15] = body[1:17], body[17 : 17 + n]
        body = body[17 + n :]


def _scan_header(picture: Picture, body: bytes) -> None:
    if not picture.components or body[0] != len(picture.components):
        raise JpegError("a scan without its frame, or of some components only")
    for i, c in enumerate(picture.components):
        if body[1 + 2 * i] != c.ident:
            raise JpegError("a scan of unknown components")
        c.dc, c.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15


@lru_cache(maxsize=64)
def _lookup(table: tuple[bytes, bytes]) -> np.ndarray:
    """Code length << 8 | symbol for every next 16 bits; 0 where no code begins."""
    out = np.zeros(65536, dtype=np.int32)
    for symbol, code, length in _codes(table):
        first = code << 16 - length
        out[first : first + (1 << 16 - length)] = length << 8 | symbol
    return out


def decode(data: bytes) -> Picture:
    """Parse a file and Huffman-decode its scan into ``blocks``."""
    return decode_many([data])[0]


def decode_many(files: Sequence[bytes]) -> list[Picture]:
    """Decode many files; the restart intervals of those with the same tables and components are read side by side."""
    pictures, groups = [parse(f) for f in files], {}
    for picture in pictures:
        groups.setdefault(_layout(picture), []).append(picture)
    for (tables, pattern), members in groups.items():
        intervals = [list(_intervals(p.scan)) for p in members]
        counts = [_blocks_of_intervals(p, len(found), len(pattern)) for p, found in zip(members, intervals)]
        read = _read_side_by_side if sum(map(len, intervals)) >= LEAST_LANES else _read_one_by_one
        coefficients, at = read([x for found in intervals for x in found], [n for c in counts for n in c], np.stack([_lookup(t) for t in tables]), np.array(pattern)), 0
        for picture, count in zip(members, counts):
            _place(picture, coefficients[at : at + sum(count)])
            at += sum(count)
    return pictures


def _layout(picture: Picture) -> tuple[tuple, tuple[int, ...]]:
    """DC and AC tables of all components in turn, and the components of the blocks of a group (MCU)."""
    try:
        tables = tuple(t for c in picture.components for t in (picture.tables[0, c.dc], picture.tables[1, c.ac]))
    except KeyError as error:
        raise JpegError("a scan without its Huffman tables") from error
    if len(picture.components) == 1:
        return tables, (0,)  # blocks of a single component are not grouped
    return tables, tuple(i for i, c in enumerate(picture.components) for _ in range(c.h * c.v))


def _size(picture: Picture) -> tuple[int, int]:
    """Groups of blocks across and down."""
    if len(picture.components) == 1:
        return -(-picture.width // 8), -(-picture.height // 8)
    h, v = max(c.h for c in picture.components), max(c.v for c in picture.components)
    return -(-picture.width // (8 * h)), -(-picture.height // (8 * v))


def _blocks_of_intervals(picture: Picture, n_intervals: int, per_group: int) -> list[int]:
    across, down = _size(picture)
    step = picture.restart or across * down
    groups = [min(step, across * down - k) for k in range(0, across * down, step)]
    if len(groups) != n_intervals:
        raise JpegError("the scan does not have as many intervals as the picture's size asks for")
    return [n * per_group for n in groups]


def _place(picture: Picture, coefficients: np.ndarray) -> None:
    """Blocks in the order of the scan into rows and columns of their components."""
    across, down = _size(picture)
    if len(picture.components) == 1:
        only = picture.components[0]
        only.columns, only.rows, only.blocks = across, down, coefficients.reshape(down, across, 64)
        return
    groups, at = coefficients.reshape(down, across, -1, 64), 0
    for c in picture.components:
        part = groups[:, :, at : at + c.h * c.v].reshape(down, across, c.v, c.h, 64)
        c.columns, c.rows, at = across * c.h, down * c.v, at + c.h * c.v
        c.blocks = np.ascontiguousarray(part.transpose(0, 2, 1, 3, 4)).reshape(c.rows, c.columns, 64)


def _read_side_by_side(intervals: list[bytes], n_blocks: list[int], tables: np.ndarray, pattern: np.ndarray) -> np.ndarray:
    """All blocks of all intervals, in order; each interval is a lane that reads one code a step."""
    sizes = np.array([len(x) + 8 for x in intervals], dtype=np.int64)
    data = np.frombuffer(b"".join(x + b"\xff" * 8 for x in intervals), dtype=np.uint8).astype(np.int64)
    window = data[: len(data) - 4].copy()
    for j in range(1, 5):
        window = window << 8 | data[j : len(data) - 4 + j]
    begins = np.cumsum(sizes) - sizes
    at, stop = begins * 8, (begins + sizes - 8) * 8
    block, left = np.cumsum(n_blocks) - np.array(n_blocks), np.array(n_blocks)
    first, k = block.copy(), np.zeros(len(block), dtype=np.int64)
    out = np.zeros((int(sum(n_blocks)), 64), dtype=np.int16)
    last, flat = np.zeros((len(block), int(pattern.max()) + 1), dtype=np.int64), tables.reshape(-1)
    while len(at):
        of = pattern[(block - first) % len(pattern)]
        found = flat[(2 * of + (k > 0)) * 65536 + (window[at >> 3] >> (24 - (at & 7)) & 0xFFFF)].astype(np.int64)
        length, symbol = found >> 8, found & 0xFF
        if not length.all():
            raise JpegError("a code that the table does not have")
        at += length
        size, run = symbol & 15, np.where(k > 0, symbol >> 4, 0)
        value = window[at >> 3] >> (40 - (at & 7) - size) & (1 << size) - 1
        value -= np.where((size > 0) & (value < 1 << np.maximum(size - 1, 0)), (1 << size) - 1, 0)
        at += size
        if (at > stop).any():
            raise JpegError("a cut scan")
        is_dc = k == 0
        if is_dc.any():
            lanes = np.flatnonzero(is_dc)
            last[lanes, of[lanes]] += value[lanes]
            value[lanes] = last[lanes, of[lanes]]
        put = k + run
        writes = is_dc | (size > 0)
        if (put[writes] > 63).any():
            raise JpegError("a run beyond its block")
        out[block[writes], put[writes]] = value[writes]
        k = np.where(writes, put + 1, np.where(run == 15, k + 16, 64))
        done = k > 63
        if done.any():
            block, left, k = block + done, left - done, np.where(done, 0, k)
            if not left.all():
                keep = left > 0
                at, stop, block, left, first, k, last = at[keep], stop[keep], block[keep], left[keep], first[keep], k[keep], last[keep]
    return out


def _read_one_by_one(intervals: list[bytes], n_blocks: list[int], tables: np.ndarray, pattern: np.ndarray) -> np.ndarray:
    """The same, code by code; the work is linear in the length of an interval."""
    out, block = np.zeros((sum(n_blocks), 64), dtype=np.int16), 0
    lists = [t.tolist() for t in tables]
    for data, n in zip(intervals, n_blocks):
        padded, at, stop, last = data + b"\xff" * 8, 0, len(data) * 8, [0] * (int(pattern.max()) + 1)
        for i in range(n):
            of, k = int(pattern[i % len(pattern)]), 0
            while k < 64:
                found = lists[2 * of + (k > 0)][int.from_bytes(padded[at >> 3 : (at >> 3) + 3], "big") >> (8 - (at & 7)) & 0xFFFF]
                if not found:
                    raise JpegError("a code that the table does not have")
                at += found >> 8
                size, run = found & 15, found >> 4 & 15 if k else 0
                value = int.from_bytes(padded[at >> 3 : (at >> 3) + 3], "big") >> (24 - (at & 7) - size) & (1 << size) - 1
                at += size
                if at > stop:
                    raise JpegError("a cut scan")
                if size and value < 1 << size - 1:
                    value -= (1 << size) - 1
                if not k:
                    last[of] += value
                    out[block, 0] = last[of]
                    k = 1
                elif size:
                    if k + run > 63:
                        raise JpegError("a run beyond its block")
                    out[block, k + run] = value
                    k += run + 1
                else:
                    k = k + 16 if run == 15 else 64
            block += 1
    return out


def _intervals(scan: bytes) -> Iterator[bytes]:
    """Restart intervals without their markers and stuffed bytes."""
    begin = at = 0
    while (at := scan.find(b"\xff", at)) >= 0 and at + 1 < len(scan):
        if 0xD0 <= scan[at + 1] <= 0xD7:
            yield scan[begin:at].replace(b"\xff\x00", b"\xff")
            begin = at + 2
        elif scan[at + 1]:
            raise JpegError("an unknown marker in the scan")
        at += 2
    yield scan[begin:].replace(b"\xff\x00", b"\xff")


def stored_payload(picture: Picture) -> bytes:
    """The payload that ``encode_payload`` stored."""
    length = next((int(c.split()[1]) for c in picture.comments if c.startswith(b"payload ")), None)
    if length is None:
        raise JpegError("no payload in this file")
    return picture.components[0].blocks.astype(np.int8).tobytes()[:length]


def thumbnail(picture: Picture) -> np.ndarray:
    """Luminance of each block from its DC coefficient alone, one pixel a block."""
    c = picture.components[0]
    quantiser = int(picture.quantisers[c.quantiser][0])
    return np.clip(c.blocks[:, :, 0].astype(np.int32) * quantiser // 8 + 128, 0, 255).astype(np.uint8)


def _means(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means over a grid of areas that cover a picture; a small picture's pixels serve for several."""
    sums = np.pad(pixels.astype(np.int64).cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))

    def edges(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        begin = np.arange(parts) * n // parts
        return begin, np.maximum(begin + 1, (np.arange(parts) + 1) * n // parts)

    (top, bottom), (left, right) = edges(pixels.shape[0], rows), edges(pixels.shape[1], columns)
    total = sums[np.ix_(bottom, right)] - sums[np.ix_(top, right)] - sums[np.ix_(bottom, left)] + sums[np.ix_(top, left)]
    return total / ((bottom - top)[:, None] * (right - left)[None, :])


def thumbnail_hashes(pixels: np.ndarray) -> tuple[str, str]:
    """Average hash and difference hash, 64 bits each, of 8 x 9 areas of a whole thumbnail."""
    small = _means(pixels, 8, 9)
    average = small[:, :8] > small[:, :8].mean()
    return np.packbits(average).tobytes().hex(), np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def feature(picture: Picture) -> str:
    return ":".join([f"{picture.width}x{picture.height}", *thumbnail_hashes(thumbnail(picture))])


def pad(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT if text else UNIT)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def store_texts(documents: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text) as doc_id and a JPEG column ``media`` that holds the padded text losslessly."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column_bytes(batch.column(1))
            for begin, end in chunks(texts):
                files = pa.array(encode_payloads([pad(t) for t in texts[begin:end]]), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), files, pa.array(map(len, texts[begin:end]), pa.int64())], ["doc_id", "media", "n_bytes"])

    return documents.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(write, "doc_id long, media binary, n_bytes long")


def media_features(stored: DataFrame) -> DataFrame:
    """Decode the JPEG column of ``store_texts`` and compute each row's digests, dimensions and thumbnail hashes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, files = (batch.column(k).to_pylist() for k in ("doc_id", "n_bytes", "media"))
            rows = []
            for begin, end in chunks(files):
                for doc_id, n_bytes, data, picture in zip(ids[begin:end], lengths[begin:end], files[begin:end], decode_many(files[begin:end])):
                    payload = stored_payload(picture)
                    rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(picture)))
            columns = zip(*rows) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (3, 6, 7) else pa.int64()) for i, c in enumerate(columns)], _NAMES)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(read, SCHEMA)


def round_trip(documents: DataFrame) -> DataFrame:
    """Store every text as a picture, read it back, and describe it; a row per row.

    A null or empty text is one unit of zeros. Null and repeated doc_ids pass
    through, other columns are left out, an empty table gives no rows. Both
    steps are narrow; texts go through in chunks of a megabyte, a longer one
    alone, with temporaries of some 200 times its bytes. A picture holds 4 GB,
    more than a text of Spark.
    """
    return media_features(store_texts(documents))
