"""Media columns as baseline JPEG: payload bytes as the DC levels of 8x8 luminance blocks, and the way back.

One block carries one byte: with a DC quantiser of 8 the coefficient ``byte - 128`` makes a flat block of exactly
that sample value, and every AC coefficient is zero. The decoder parses markers, undoes byte stuffing, cuts the
scan at its restart markers and decodes all restart intervals of a batch side by side in numpy, one Huffman symbol
a step, keeping DC values only: an eighth-size luminance thumbnail. It reads other baseline files too (several
components, chroma subsampling, AC coefficients, no restart markers).

Defined cases: a null text counts as empty, whose payload is one row of 192 spaces. A text beyond one image
(192 * 42 * 8191 bytes) continues in further images of the same value, one after the other. Rows are kept one for
one, repeated or not; columns beside doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from vacancia.llm.common import ranges, slices, utf8

INTERVAL = 192  # blocks between restart markers, and the unit to which payloads are padded
MAX_SIDE = 8191  # blocks: 65,535 samples at most
MOST_COLUMNS = MAX_SIDE // INTERVAL * INTERVAL
QUANT = 8

# Code lengths of this encoder's Huffman tables. DC sizes 0 to 8; the only AC symbol is end of block.
DC_COUNTS = (0, 0, 6, 3) + (0,) * 12
DC_SYMBOLS = (2, 3, 4, 5, 6, 7, 0, 1, 8)
AC_COUNTS = (1,) + (0,) * 15
AC_SYMBOLS = (0,)


def codes(counts: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """Canonical code and length of each symbol."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            out[symbol] = (code, length)
            code += 1
        at, code = at + n, code << 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(columns: int, rows: int) -> bytes:
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
            _segment(0xDB, b"\0" + bytes([QUANT] + [1] * 63)),
            _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, columns * 8, 1, 1, 0x11, 0)),
            _segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS)),
            _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS)),
            _segment(0xDD, struct.pack(">H", INTERVAL)),
            _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
        )
    )


_DC = codes(DC_COUNTS, DC_SYMBOLS)
_CODE = np.array([_DC[k][0] for k in range(9)], dtype=np.uint64)
_LENGTH = np.array([_DC[k][1] for k in range(9)], dtype=np.int64)
_SIZE = np.array([abs(k - 255).bit_length() for k in range(511)], dtype=np.int64)  # of a difference from -255 to 255


def pad(data: bytes) -> bytes:
    """``data`` and spaces up to a positive multiple of 192 bytes."""
    return data + b" " * (-len(data) % INTERVAL or (INTERVAL if not data else 0))


def _scans(lines: np.ndarray, last: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded data of many intervals in turn, and where each ends. ``last``: no restart marker follows."""
    n = len(lines)
    level = lines.astype(np.int64) - 128
    diff = np.diff(level, axis=1, prepend=0)
    size = _SIZE[diff + 255]
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff).astype(np.uint64)
    length = np.empty((n, INTERVAL + 1), dtype=np.int64)
    value = np.empty((n, INTERVAL + 1), dtype=np.uint64)
    length[:, :-1] = _LENGTH[size] + size + 1  # the end-of-block code is one zero bit
    value[:, :-1] = ((_CODE[size] << size.astype(np.uint64)) | extra) << np.uint64(1)
    bits = length[:, :-1].sum(1)
    length[:, -1] = -bits % 8
    value[:, -1] = (1 << length[:, -1]) - 1
    length, value = length.ravel(), value.ravel()
    at = np.cumsum(length) - length
    word, shift = at >> 5, (64 - (at & 31) - length).astype(np.uint64)
    placed = value << shift
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    words = np.zeros(int(word[-1]) + 2, dtype=np.uint64)
    words[word[starts]] += np.add.reduceat(placed >> np.uint64(32), starts)
    words[word[starts] + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), starts)
    row_bytes = (bits + 7) // 8
    ends = np.cumsum(row_bytes)
    raw = words.astype(">u4").view(np.uint8)[: ends[-1]]
    width = 1 + (raw == 0xFF).astype(np.int64)
    width[ends[~last] - 1] += 2
    stop = np.cumsum(width)
    out = np.zeros(int(stop[-1]), dtype=np.uint8)
    out[stop - width] = raw
    marker = stop[ends[~last] - 1]
    out[marker - 2] = 0xFF
    out[marker - 1] = 0xD0 + number[~last] % 8
    return out.tobytes(), stop[ends - 1]


def encode(payloads: list[bytes]) -> list[bytes]:
    """Baseline JPEG of each padded payload; several images in turn where one is too small."""
    shapes: list[tuple[int, int, int]] = []  # payload, columns, rows
    for i, data in enumerate(payloads):
        blocks = len(data)
        while blocks:
            part = min(blocks, MOST_COLUMNS * MAX_SIDE)
            columns = next(c for c in range(INTERVAL, MOST_COLUMNS + 1, INTERVAL) if part % c == 0 and part // c <= MAX_SIDE or c == MOST_COLUMNS)
            rows = min(part // columns, MAX_SIDE)
            shapes.append((i, columns, rows))
            blocks -= columns * rows
    if not shapes:
        return [b"" for _ in payloads]
    lines = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, INTERVAL)
    each = np.array([c * r // INTERVAL for _, c, r in shapes])
    ends = np.cumsum(each)
    last = np.zeros(len(lines), dtype=bool)
    last[ends - 1] = True
    data, stops = _scans(lines, last, ranges(np.zeros(len(each)), each))
    out: list[list[bytes]] = [[] for _ in payloads]
    begin = 0
    for (i, columns, rows), end in zip(shapes, stops[ends - 1].tolist(), strict=True):
        out[i] += [_header(columns, rows), data[begin:end], b"\xff\xd9"]
        begin = end
    return [b"".join(x) for x in out]


@dataclass
class Scan:
    """One image's scan: what the headers say, and its entropy-coded data cut at restart markers."""

    width: int
    height: int
    components: tuple[tuple[int, int, int, int, int], ...]  # h, v, quantiser of DC, DC table, AC table
    tables: tuple[tuple[int, bytes], ...]
    interval: int
    parts: list[bytes]

    @property
    def grid(self) -> tuple[int, int]:
        """MCUs across and down."""
        h, v = max(c[0] for c in self.components), max(c[1] for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes) -> list[Scan]:
    """Every image in ``data``. Raises ValueError for anything but baseline with one interleaved scan."""
    images, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        quant: dict[int, int] = {}
        tables: dict[int, bytes] = {}
        interval, frame, scan = 0, None, None
        while scan is None:
            while data[at + 1] == 0xFF:
                at += 1
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    tables[body[0]] = bytes(body[1:n])
                    body = body[n:]
            elif marker == 0xC0:
                precision, height, width, n = struct.unpack_from(">BHHB", body)
                if precision != 8:
                    raise ValueError("only 8-bit samples are baseline")
                frame = height, width, {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline image")
            elif marker == 0xDD:
                interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
        if frame is None or len(scan) != len(frame[2]):
            raise ValueError("the scan doesn't hold every component")
        begin, parts = at, []
        while True:
            at = data.index(b"\xff", at)
            following = data[at + 1]
            if following == 0:
                at += 2
            elif 0xD0 <= following <= 0xD7:
                parts.append(data[begin:at].replace(b"\xff\x00", b"\xff"))
                at = begin = at + 2
            else:
                parts.append(data[begin:at].replace(b"\xff\x00", b"\xff"))
                break
        if following != 0xD9:
            raise ValueError("no end of image after the scan")
        at += 2
        sampled = [(*frame[2][c][:2], quant[frame[2][c][2]], dc, ac) for c, dc, ac in scan]
        if len(sampled) == 1:
            sampled = [(1, 1, *sampled[0][2:])]
        images.append(Scan(frame[1], frame[0], tuple(sampled), tuple(sorted(tables.items())), interval, parts))
    return images


def _lookup(table: bytes) -> np.ndarray:
    """length << 8 | symbol for each 16 bits that come next; 0 where no code begins."""
    out, code, at = np.zeros(1 << 16, dtype=np.int64), 0, 16
    for length in range(1, 17):
        for symbol in table[at : at + table[length - 1]]:
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
            code += 1
        at, code = at + table[length - 1], code << 1
    return out


def _levels(scans: list[Scan]) -> list[list[np.ndarray]]:
    """DC levels of scans that have tables and components in common: for each scan, each interval's blocks in order."""
    components = scans[0].components
    lookups = {k: _lookup(t) for k, t in scans[0].tables}
    pattern = [k for k, (h, v, *_) in enumerate(components) for _ in range(h * v)]
    parts, mcus = [], []
    for s in scans:
        total = s.grid[0] * s.grid[1]
        parts += s.parts
        mcus += [min(s.interval or total, total - k * s.interval) for k in range(len(s.parts))]
    blocks = np.array(mcus, dtype=np.int64) * len(pattern)
    order = np.argsort(-blocks, kind="stable")
    sizes = np.array([len(p) for p in parts], dtype=np.int64) + 8  # a margin of ones, so that no step reads beyond
    raw = np.frombuffer(b"".join(p + b"\xff" * 8 for p in parts) + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
    word = (raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]).astype(np.int64)
    pos = ((np.cumsum(sizes) - sizes) * 8)[order]
    most, count = int(blocks.max(initial=0)), blocks[order]
    out = np.zeros((len(parts), most), dtype=np.int32)
    previous = np.zeros((len(components), len(parts)), dtype=np.int64)

    def symbol(p: np.ndarray, lookup: np.ndarray) -> np.ndarray:
        return lookup[(word[p >> 3] >> (16 - (p & 7))) & 0xFFFF]

    for j in range(most):
        live = int(np.searchsorted(-count, -j, side="left"))  # intervals that have a block j: a prefix, as they are sorted
        which = pattern[j % len(pattern)]
        _, _, _, dc, ac = components[which]
        p = pos[:live]
        got = symbol(p, lookups[dc])
        size = got & 255
        p = p + (got >> 8)
        value = (word[p >> 3] >> (32 - (p & 7) - size)) & ((1 << size) - 1)
        value = np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)
        previous[which, :live] += value
        out[:live, j] = previous[which, :live]
        p = p + size
        k, rest = np.ones(live, dtype=np.int64), np.arange(live)
        while len(rest):
            got = symbol(p[rest], lookups[16 | ac])
            run, size = (got >> 4) & 15, got & 15
            p[rest] += (got >> 8) + size
            k[rest] = np.where((got & 255) == 0, 64, k[rest] + run + 1)
            rest = rest[k[rest] < 64]
        pos[:live] = p
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    found, at = [], 0
    for s in scans:
        found.append([out[back[i], : blocks[i]] for i in range(at, at + len(s.parts))])
        at += len(s.parts)
    return found


def thumbnails(files: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """Width, height and DC-only luminance (a sample a block) of every image of every file."""
    parsed = [parse(f) for f in files]
    groups: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    for i, images in enumerate(parsed):
        for k, s in enumerate(images):
            groups[s.tables, s.components].append((i, k))
    out: list[list] = [[None] * len(images) for images in parsed]
    for (_, components), members in groups.items():
        h, v, quant, *_ = components[0]
        each = sum(c[0] * c[1] for c in components)
        for (i, k), levels in zip(members, _levels([parsed[i][k] for i, k in members]), strict=True):
            s = parsed[i][k]
            across, down = s.grid
            luma = np.concatenate(levels).reshape(down, across, each)[:, :, : h * v]
            luma = luma.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            luma = luma[: -(-s.height // 8), : -(-s.width // 8)]
            samples = np.clip(np.floor_divide(luma * quant + 4, 8) + 128, 0, 255).astype(np.uint8)
            out[i][k] = s.width, s.height, samples
    return out


#: What reading a file raises that isn't a baseline JPEG, or is cut short.
MALFORMED = (ValueError, IndexError, KeyError, struct.error, ZeroDivisionError)


def readable_thumbnails(files: list[bytes]) -> list[list[tuple[int, int, np.ndarray]] | None]:
    """As ``thumbnails``, with None for files that can't be read: a batch that holds one is halved until it stands alone."""
    try:
        return thumbnails(files)
    except MALFORMED:
        if len(files) == 1:
            return [None]
        return readable_thumbnails(files[: len(files) // 2]) + readable_thumbnails(files[len(files) // 2 :])


def feature(images: list[tuple[int, int, np.ndarray]]) -> str:
    """Dimensions of the first image, a 64-bit average hash of its thumbnail, and XXH64 of all thumbnails' samples."""
    width, height, first = images[0]
    flat = first.ravel().astype(np.int64)
    means = np.add.reduceat(flat, np.arange(64) * len(flat) // 64) / (len(flat) / 64)
    average = int.from_bytes(np.packbits(means > means.mean()).tobytes(), "big")
    whole = xxhash.xxh64()
    for _, _, samples in images:
        whole.update(samples.tobytes())
    return f"{width}x{height}:{average:016x}:{whole.hexdigest()}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's padded payload as baseline JPEG."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 128 << 10):
            data = [utf8(t) for t in batch.column("text").to_pylist()]
            media = encode([pad(d) for d in data])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, data)), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """What the stored bytes hold: payload and media digests, and the thumbnail feature.

    Media that aren't a baseline JPEG, or are null, give their own size and digest and nulls for what can't be read."""
    key = stored.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 3 << 20):
            media = [m or b"" for m in batch.column("media").to_pylist()]
            rows = []
            for data, images in zip(media, readable_thumbnails(media), strict=True):
                if not images:
                    rows.append((None, None, None, len(data), hashlib.sha256(data).hexdigest(), None))
                    continue
                payload = b"".join(samples.tobytes() for *_, samples in images)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(images)))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(
        run, f"doc_id {key}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
