"""Media columns: baseline JPEG with whole-byte payloads, decoded with numpy.

The decoder reads any baseline (sequential, 8-bit, Huffman) JPEG: it parses the markers, takes the byte stuffing
out, decodes all restart intervals of many images side by side, one symbol of each at a time, and gives the
quantised coefficients. From the DC coefficients of the first component alone it makes the luminance thumbnail
(one pixel per 8 x 8 block) and a 64-bit hash of it.

The encoder stores 64 payload bytes as the 64 quantised coefficients of a block, byte + 1 each, so that no zero
runs occur, with all quantisers 1 and a restart marker after each block. A comment segment holds the length before
padding. Reading the coefficients gives the payload back without loss.

Null and empty texts give a payload of 64 zero bytes. Equal texts give equal files. Every row gives one row;
rows that repeat, null doc_id and further columns change nothing. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newslink.llm.common import pick, raw_texts, releasing, slices

BLOCK = 64
#: Blocks that are decoded side by side at most, unless one image has more.
LANES = 16_384
#: Code lengths of the coefficient sizes in the encoder's Huffman tables (sizes 1 to 9).
CODE_LENGTHS = {7: 1, 6: 2, 8: 4, 1: 5, 4: 5, 2: 6, 3: 6, 5: 6, 9: 6}
_U = np.uint64


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length), codes in order of length, then of the given order."""
    out, code, before = {}, 0, 0
    for symbol, length in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= length - before
        out[symbol], before = (code, length), length
        code += 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


@lru_cache(1)
def _encoder_tables() -> tuple[np.ndarray, np.ndarray, bytes]:
    """Bits and bit count of each byte value, and the table segments. A coefficient is positive, so its bits are its value."""
    codes = _canonical(CODE_LENGTHS)
    bits, counts = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for byte in range(256):
        size = (byte + 1).bit_length()
        code, length = codes[size]
        bits[byte], counts[byte] = code << size | byte + 1, length + size
    by_length = [[s for s, n in CODE_LENGTHS.items() if n == length] for length in range(1, 17)]
    table = bytes(map(len, by_length)) + bytes(s for symbols in by_length for s in symbols)
    head = _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _segment(0xC4, b"\x00" + table + b"\x10" + table) + _segment(0xDD, b"\x00\x01")
    return bits, counts, head


def shape_of(blocks: int) -> tuple[int, int]:
    """Blocks across and down of an image with room for so many blocks, nearly square."""
    across = int(np.ceil(np.sqrt(blocks)))
    return across, -(-blocks // across)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A grey JPEG for each payload (zero bytes fill it to a positive multiple of 64)."""
    bits, counts, tables = _encoder_tables()
    need = [max(1, -(-len(p) // BLOCK)) for p in payloads]
    shapes = [shape_of(n) for n in need]
    room = np.array([a * d for a, d in shapes], dtype=np.int64)
    flat = np.frombuffer(b"".join(p.ljust(int(r) * BLOCK, b"\0") for p, r in zip(payloads, room, strict=True)), np.uint8).reshape(-1, BLOCK)
    ends = np.cumsum(room)
    lane = np.arange(len(flat)) - np.repeat(ends - room, room)  # within its image
    final = np.zeros(len(flat), bool)
    final[ends - 1] = True
    scans, sizes = [], np.zeros(len(flat), np.int64)
    for k in range(0, len(flat), LANES):
        part = slice(k, k + LANES)
        data, sizes[part] = _lanes(flat[part], bits, counts, lane[part], final[part])
        scans.append(data)
    scan = b"".join(scans)
    cuts = np.append(0, np.cumsum(sizes)[ends - 1]).tolist()
    out = []
    for i, (across, down) in enumerate(shapes):
        size = (down * 8).to_bytes(2, "big") + (across * 8).to_bytes(2, "big")
        note = _segment(0xFE, b"payload=%d;stored=%d" % (len(payloads[i]), need[i] * BLOCK))
        head = b"\xff\xd8" + note + tables + _segment(0xC0, b"\x08" + size + b"\x01\x01\x11\x00") + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
        out.append(head + scan[cuts[i] : cuts[i + 1]] + b"\xff\xd9")
    return out


def _lanes(blocks: np.ndarray, bits: np.ndarray, counts: np.ndarray, lane: np.ndarray, final: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded bytes of blocks, each with its restart marker unless final, and how many bytes each takes."""
    code, length = bits[blocks], counts[blocks]
    for _ in range(2):  # join neighbours twice: four coefficients have 60 bits at most
        code = (code[:, ::2] << length[:, 1::2].astype(_U)) | code[:, 1::2]
        length = length[:, ::2] + length[:, 1::2]
    at = np.cumsum(length, axis=1)
    total, at = at[:, -1], at - length
    code = code << (64 - length).astype(_U)
    words, rows = np.zeros((len(blocks), 17), np.uint64), np.arange(len(blocks))
    for g in range(code.shape[1]):
        word, shift = at[:, g] >> 6, (at[:, g] & 63).astype(_U)
        words[rows, word] |= code[:, g] >> shift
        words[rows, word + 1] |= (code[:, g] << _U(1)) << (_U(63) - shift)
    data = words.astype(">u8").view(np.uint8).reshape(len(blocks), -1)
    n = (total + 7) >> 3
    data[rows, n - 1] |= ((1 << (n * 8 - total)) - 1).astype(np.uint8)
    data[rows, n], data[rows, n + 1] = 0xFF, 0xD0 + (lane & 7)
    width = n + np.where(final, 0, 2)
    column = np.arange(data.shape[1])
    inside = column < width[:, None]
    flat = data[inside]
    stuffed = (flat == 0xFF) & (np.broadcast_to(column, data.shape)[inside] != np.repeat(n, width))
    out = np.repeat(flat, 1 + stuffed)
    where = np.flatnonzero(stuffed)
    out[where + 1 + np.arange(len(where))] = 0
    starts = np.cumsum(width) - width
    return out.tobytes(), width + np.add.reduceat(stuffed.astype(np.int64), starts)


@dataclass
class Header:
    width: int
    height: int
    components: tuple  # (id, horizontal, vertical, quantiser) of each
    scan: tuple  # (component index, DC table, AC table) of each in the scan
    huffman: dict  # (class, id) to (counts, symbols)
    quantisers: dict
    interval: int
    comment: bytes
    begin: int  # where the entropy-coded bytes begin


def parse(data: bytes) -> Header:
    """The markers up to the scan. Raises ValueError for what is not a baseline JPEG of one scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG: the start marker is missing")
    at, huffman, quantisers, frame, interval, comment = 2, {}, {}, None, 0, b""
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is expected")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                quantisers[body[0] & 15], body = values, body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0] >> 4, body[0] & 15], body = (body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xC0:
            parts = tuple((body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5]))
            frame = (int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), parts)
        elif 0xC1 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("only baseline frames are read")
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("the scan comes before the frame")
            ids = [c[0] for c in frame[2]]
            scan = tuple((ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0]))
            if len(scan) != len(ids):
                raise ValueError("only images of one scan are read")
            return Header(*frame, scan, huffman, quantisers, interval, comment, at)


@lru_cache(64)
def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits that may come: code length * 256 + symbol (length 0: no such code)."""
    out, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _layout(h: Header) -> tuple[int, list[int], int, int]:
    """MCUs, the component of each block in an MCU, MCUs across, MCUs down. A lone component is not interleaved."""
    tall, wide = max(c[2] for c in h.components), max(c[1] for c in h.components)
    if len(h.components) == 1:
        across, down, blocks = -(-h.width // 8), -(-h.height // 8), [0]
    else:
        across, down = -(-h.width // (8 * wide)), -(-h.height // (8 * tall))
        blocks = [c for c, _, _ in h.scan for _ in range(h.components[c][1] * h.components[c][2])]
    return across * down, blocks, across, down


def coefficients(images: list[bytes]) -> list[tuple[Header, np.ndarray]]:
    """Header and quantised coefficients (blocks in scan order x 64 in zigzag order) of each image."""
    headers = [parse(x) for x in images]
    alike: dict = {}
    for i, h in enumerate(headers):
        alike.setdefault((h.scan, h.components, tuple(sorted(h.huffman.items()))), []).append(i)
    out: list = [None] * len(images)
    for members in alike.values():
        for i, values in zip(members, _decode([images[i] for i in members], [headers[i] for i in members]), strict=True):
            out[i] = (headers[i], values)
    return out


def _decode(images: list[bytes], headers: list[Header]) -> list[np.ndarray]:
    """Images with the same tables: all their restart intervals are lanes of one loop over symbols."""
    first = headers[0]
    layout = [_layout(h) for h in headers]
    order = layout[0][1]
    tables = np.concatenate([_lookup(*first.huffman[kind, t]) for c in range(len(first.components)) for kind, t in ((0, next(d for i, d, _ in first.scan if i == c)), (1, next(a for i, _, a in first.scan if i == c)))])
    raw = np.frombuffer(b"".join(x[h.begin :] for x, h in zip(images, headers, strict=True)) + bytes(16), np.uint8)
    sizes = np.array([len(x) - h.begin for x, h in zip(images, headers, strict=True)], np.int64)
    begins = np.cumsum(sizes) - sizes
    marks = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[marks + 1]
    keep = np.ones(len(raw), bool)
    keep[marks[after == 0] + 1] = False
    restart = marks[(after & 0xF8) == 0xD0]
    keep[restart] = keep[restart + 1] = False
    place = np.cumsum(keep) - keep  # of each raw byte among those kept
    data = np.append(raw[keep], np.zeros(16, np.uint8))
    wide = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    lane_at, blocks, base = [], [], []
    total = 0
    for i, h in enumerate(headers):
        mcus = layout[i][0]
        step = h.interval or mcus
        lanes = -(-mcus // step)
        own = restart[np.searchsorted(restart, begins[i]) : np.searchsorted(restart, begins[i] + sizes[i])][: lanes - 1]
        if len(own) != lanes - 1:
            raise ValueError("restart markers are missing")
        lane_at.append(np.append(place[begins[i]], place[own + 1] + keep[own + 1]))
        blocks.append(np.minimum(step, mcus - step * np.arange(lanes)) * len(order))
        base.append(total + step * np.arange(lanes) * len(order))
        total += mcus * len(order)
    values = np.zeros((total, 64), np.int16)
    lane_at, blocks, base = map(np.concatenate, (lane_at, blocks, base))
    for k in range(0, len(lane_at), LANES):
        part = slice(k, k + LANES)
        _symbols(wide, lane_at[part] * 8, blocks[part], base[part], np.array(order), tables, values, len(first.components))
    cuts = np.cumsum([m * len(order) for m, *_ in layout])[:-1]
    return np.split(values, cuts)


def _symbols(wide, bit, blocks, base, order, tables, values, components) -> None:
    """Decode one symbol of every lane at a time until all lanes have their blocks."""
    k, block = np.zeros(len(bit), np.int64), np.zeros(len(bit), np.int64)
    before, lane = np.zeros((len(bit), components), np.int64), np.arange(len(bit))
    flat = values.reshape(-1)
    end = len(wide) - 1
    plain = len(order) == 1
    while len(bit):
        part = 0 if plain else order[block % len(order)]
        word = wide[np.minimum(bit >> 3, end)].astype(np.uint64) << (bit & 7).astype(_U)
        entry = tables[((part * 2 + (k > 0)) << 16) + (word >> _U(48)).astype(np.int64)]
        length, size, run = entry >> 8, entry & 15, (entry >> 4) & 15
        if not length.all():
            raise ValueError("the scan has bits that are no code")
        value = (((word << length.astype(_U)) >> _U(1)) >> (63 - size).astype(_U)).astype(np.int64)
        value -= np.where(value < (1 << np.maximum(size - 1, 0)), (1 << size) - 1, 0) * (size > 0)
        bit = bit + length + size
        dc = k == 0
        if dc.any():
            rows = np.flatnonzero(dc)
            of = np.zeros(len(rows), np.int64) if plain else part[rows]
            before[lane[rows], of] += value[rows]
            value[rows] = before[lane[rows], of]
        at = np.where(dc, 0, k + run)
        stop = ~dc & (size == 0) & (run != 15)
        write = ~stop & ((size > 0) | dc)
        if (at[write] > 63).any():
            raise ValueError("a block has more than 64 coefficients")
        spot = (base + block) * 64 + at
        if write.all():
            flat[spot] = value
        else:
            flat[spot[write]] = value[write]
        k = np.where(stop, 64, at + 1)
        full = k >= 64
        if full.any():
            block = block + full
            k = np.where(full, 0, k)
            left = block < blocks
            if not left.all():
                bit, k, block, blocks, base, lane = (x[left] for x in (bit, k, block, blocks, base, lane))


def thumbnail(h: Header, values: np.ndarray) -> np.ndarray:
    """Luminance of each 8 x 8 block from its DC coefficient alone, 0 to 255."""
    mcus, order, across, down = _layout(h)
    dc = values[:, 0].reshape(mcus, len(order)).astype(np.int64)
    _, wide, tall, quantiser = h.components[0]
    if len(order) == 1:
        wide = tall = 1
    own = dc[:, np.flatnonzero(np.array(order) == 0)].reshape(down, across, tall, wide)
    pixels = own.transpose(0, 2, 1, 3).reshape(down * tall, across * wide)
    pixels = pixels[: -(-h.height // 8), : -(-h.width // 8)]
    return np.clip((pixels * int(h.quantisers[quantiser][0])) // 8 + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits in hex: the thumbnail sampled at 8 x 8 places, each against the mean."""
    rows = np.arange(8) * pixels.shape[0] // 8
    columns = np.arange(8) * pixels.shape[1] // 8
    small = pixels[np.ix_(rows, columns)].astype(np.int64)
    return np.packbits(small * 64 > small.sum()).tobytes().hex()


def payload_of(h: Header, values: np.ndarray) -> tuple[bytes, int] | None:
    """The stored payload and its length before padding, or None for an image that was not made here."""
    if not h.comment.startswith(b"payload="):
        return None
    length, stored = (int(x.split(b"=")[1]) for x in h.comment.split(b";"))
    return (values.reshape(-1)[:stored] - 1).astype(np.uint8).tobytes(), length


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id and the JPEG that holds the text's UTF-8 bytes."""

    @releasing
    def store(batches):
        for batch in slices(batches, "text", LANES * BLOCK):
            files = encode(raw_texts(batch.column("text")))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "media": pa.array(files, pa.binary())})

    return pick(docs, doc_id="bigint", text="string").mapInArrow(store, "doc_id bigint, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Dimensions, thumbnail hash, payload digests of each JPEG in column `media`."""
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, width bigint, height bigint, thumb_hash string"
    names = [x.split()[0] for x in schema.split(", ")]

    @releasing
    def features(batches):
        for batch in slices(batches, "media", LANES * BLOCK):
            rows = []
            files = batch.column("media").to_pylist()
            for file, (h, values) in zip(files, coefficients(files), strict=True):
                code = thumbnail_hash(thumbnail(h, values))
                payload, length = payload_of(h, values) or (b"", None)
                rows.append((length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(file), hashlib.sha256(file).hexdigest(), f"{h.width}x{h.height}:{code}", h.width, h.height, code))
            columns = [batch.column("doc_id"), *map(list, zip(*rows, strict=True))]
            yield pa.record_batch([x if i == 0 else pa.array(x, pa.string() if isinstance(x[0], str) else pa.int64()) for i, x in enumerate(columns)], names=names)

    return media.mapInArrow(features, schema)
