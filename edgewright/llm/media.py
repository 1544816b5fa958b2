"""AVI motion JPEG columns: a writer that keeps bytes exactly, a RIFF reader, an intra frame decoder and shot detection.

Bytes are kept as the format's unit, quantised DCT coefficients: 64 bytes are the 64 coefficients of one 8 x 8
block in zigzag order, each a signed byte, with quantiser 1. Entropy coding is exact, so the coefficients,
and with them the bytes, come back unchanged.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.llm import kernels as K

#: Frames are BLOCKS_WIDE blocks wide and at most BLOCKS_HIGH high; a restart interval is one row of blocks.
BLOCKS_WIDE, BLOCKS_HIGH, RATE = 8, 8, 25
PER_FRAME = BLOCKS_WIDE * BLOCKS_HIGH
#: A shot starts where the histogram difference exceeds LEAST and MEAN + SPREAD deviations of the last WINDOW differences of the present shot.
BINS, WINDOW, SPREAD, LEAST = 32, 8, 3.0, 0.12

ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _huffman(lengths: dict[int, int]) -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    """Counts by length, symbols in order, and (code, length) by symbol of the canonical code with these lengths."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    code, before, codes = 0, 0, {}
    for s in symbols:
        code <<= lengths[s] - before
        codes[s], before = (code, lengths[s]), lengths[s]
        code += 1
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    return counts, bytes(symbols), codes


#: Letters are coefficients of 7 bits, other printable bytes of 5 and 6; the rare rest shares one length.
_DC = _huffman({s: 4 for s in range(12)})
_AC = _huffman({r << 4 | s: 11 for r in range(16) for s in range(1, 11)} | {0xF0: 11, 0: 4} | {7: 1, 6: 3, 5: 4, 8: 4, 4: 6, 3: 6, 2: 6, 1: 6})


def _table(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (c, n) in codes.items():
        code[s], length[s] = c, n
    return code, length


_DC_CODE, _DC_LENGTH = _table(_DC[2])
_AC_CODE, _AC_LENGTH = _table(_AC[2])
_BITS = np.array([0, *(int(v).bit_length() for v in range(1, 2048))])


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def _header(rows: int) -> bytes:
    """Everything of a grey frame before its entropy-coded data."""
    return b"".join(
        [
            b"\xff\xd8",
            _marker(0xDB, b"\x00" + b"\x01" * 64),
            _marker(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, BLOCKS_WIDE * 8, 1, 1, 0x11, 0)),
            _marker(0xC4, b"\x00" + _DC[0] + _DC[1]),
            _marker(0xC4, b"\x10" + _AC[0] + _AC[1]),
            _marker(0xDD, struct.pack(">H", BLOCKS_WIDE)),
            _marker(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
        ]
    )


_HEADERS = [_header(rows) for rows in range(BLOCKS_HIGH + 1)]


def _coded(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number of a coefficient of one signed byte, by (zeros before it << 8 | the byte)."""
    value, bits = np.zeros(16 << 8, np.int32), np.zeros(16 << 8, np.int32)
    for run in range(16):
        for byte in range(1, 256):
            v = byte - 256 if byte > 127 else byte
            size = abs(v).bit_length()
            code, length = codes[run << 4 | size]
            value[run << 8 | byte] = code << size | (v if v > 0 else v + (1 << size) - 1)
            bits[run << 8 | byte] = length + size
    return value, bits


_AC_VALUE, _AC_BITS = _coded(_AC[2])


def _entropy(coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stuffed entropy-coded bytes of all restart intervals (BLOCKS_WIDE blocks each) and the places where they begin."""
    blocks = len(coefficients)
    dc = coefficients[:, 0].astype(np.int32)
    diff = dc.copy()
    inner = np.arange(blocks) % BLOCKS_WIDE != 0
    diff[inner] -= dc[np.flatnonzero(inner) - 1]
    other = coefficients != 0
    other[:, 0] = False
    found = np.flatnonzero(other).astype(np.int32)
    row, k = found >> 6, found & 63
    first = np.searchsorted(found, np.arange(blocks + 1) << 6)
    run = k - 1
    same = np.flatnonzero(row[1:] == row[:-1]) + 1
    run[same] = k[same] - k[same - 1] - 1
    long_runs = run >> 4
    end = np.zeros(blocks, np.int32)
    some = first[1:] > first[:-1]
    end[some] = k[first[1:][some] - 1]
    ends = end < 63
    skipped = np.concatenate([[0], np.cumsum(long_runs)])
    counts = 1 + np.diff(first) + np.diff(skipped[first]) + ends
    begins = np.concatenate([[0], np.cumsum(counts)])

    value, bits = np.full(begins[-1], _AC_CODE[0xF0], np.int32), np.full(begins[-1], _AC_LENGTH[0xF0], np.int32)
    size = _BITS[np.abs(diff)]
    value[begins[:-1]] = (_DC_CODE[size] << size) | np.where(diff < 0, diff + (1 << size) - 1, diff)
    bits[begins[:-1]] = _DC_LENGTH[size] + size
    kind = (run & 15) << 8 | coefficients.reshape(-1).view(np.uint8)[found]
    place = np.arange(len(row)) + (begins[:-1] + 1 - first[:-1] - skipped[first[:-1]])[row] + skipped[1:]
    value[place], bits[place] = _AC_VALUE[kind], _AC_BITS[kind]
    last = begins[1:][ends] - 1
    value[last], bits[last] = _AC_CODE[0], _AC_LENGTH[0]

    ahead = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
    edges = begins[np.append(np.arange(0, blocks, BLOCKS_WIDE), blocks)]
    heads = ahead[edges]
    used = np.diff(heads)
    whole = (used + 7) >> 3
    starts = np.concatenate([[0], np.cumsum(whole)])
    bit = ahead[:-1] + np.repeat(starts[:-1] * 8 - heads[:-1], np.diff(edges))
    byte = bit >> 3
    shifted = value.astype(np.int64) << (40 - bits - (bit & 7))
    # The bits that fall to one byte never overlap; of each item at most 28 bits, so four bytes take part.
    out = np.zeros(starts[-1] + 4)
    for b in range(4):
        out += np.bincount(byte + b, weights=(shifted >> (32 - 8 * b)) & 255, minlength=len(out))
    data = out[: starts[-1]].astype(np.uint8)
    data[starts[1:] - 1] |= ((1 << (whole * 8 - used)) - 1).astype(np.uint8)
    full = np.flatnonzero(data == 255)
    return np.insert(data, full + 1, 0), starts + np.searchsorted(full, starts)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _avi(frames: list[bytes], rows: int, blocks: int) -> bytes:
    wide, high = BLOCKS_WIDE * 8, rows * 8
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, wide, high, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, wide, high)
    strf = struct.pack("<IiiHH4sIiiII", 40, wide, high, 1, 24, b"MJPG", wide * high * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"blocks=%d\0" % blocks))
    body, index, place = [], [], 4
    for f in frames:
        body.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, place, len(f)))
        place += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + hdrl + info + _chunk(b"LIST", b"movi" + b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def write_avi(payloads: list[bytes]) -> list[bytes]:
    """An AVI of grey motion JPEG for each payload; their lengths are positive multiples of 64."""
    counts = [len(p) // 64 for p in payloads]
    padded = [-(-n // PER_FRAME) * PER_FRAME if n > PER_FRAME else -(-n // BLOCKS_WIDE) * BLOCKS_WIDE for n in counts]
    data = np.frombuffer(b"".join(p.ljust(64 * n, b"\0") for p, n in zip(payloads, padded, strict=True)), np.int8).reshape(-1, 64)
    coded, begins = _entropy(data)
    raw, at, out = coded.tobytes(), begins.tolist(), []
    interval = 0
    for n, blocks in zip(padded, counts, strict=True):
        rows = min(BLOCKS_HIGH, n // BLOCKS_WIDE)
        frames = []
        for _ in range(n // (rows * BLOCKS_WIDE)):
            parts = [_HEADERS[rows]]
            for r in range(rows):
                parts += [raw[at[interval] : at[interval + 1]], bytes([0xFF, 0xD0 + r % 8])]
                interval += 1
            frames.append(b"".join(parts[:-1]) + b"\xff\xd9")
        out.append(_avi(frames, rows, blocks))
    return out


class Movie(NamedTuple):
    """Of an AVI: byte ranges of its frames, seconds a frame, and its comment."""

    frames: list[tuple[int, int]]
    seconds: float
    comment: str


def parse_avi(data: bytes) -> Movie:
    """Read a RIFF file's lists; frames come from its index, or from the movi list where there is no index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    seconds, comment, index, movi, walked = 1 / RATE, "", None, 0, []
    todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if name == b"LIST":
                kind = data[body : body + 4]
                if kind == b"movi":
                    movi = body
                    place = body + 4
                    while place + 8 <= body + size:
                        n = struct.unpack_from("<I", data, place + 4)[0]
                        if data[place + 2 : place + 4] in (b"dc", b"db"):
                            walked.append((place + 8, place + 8 + n))
                        place += 8 + n + (n & 1)
                else:
                    todo.append((body + 4, body + size))
            elif name == b"avih":
                seconds = struct.unpack_from("<I", data, body)[0] / 1e6
            elif name == b"ICMT":
                comment = data[body : body + size].rstrip(b"\0").decode("latin-1")
            elif name == b"idx1":
                index = [struct.unpack_from("<4sIII", data, body + 16 * k) for k in range(size // 16)]
            at = body + size + (size & 1)
    if not index:
        return Movie(walked, seconds, comment)
    base = movi if all(data[movi + o : movi + o + 4] == n for n, _, o, _ in index[:1]) else 0
    return Movie([(base + o + 8, base + o + 8 + n) for name, _, o, n in index if name[2:] in (b"dc", b"db")], seconds, comment)


class Layout(NamedTuple):
    """What a baseline frame's header says: blocks of an MCU by component, MCUs, restart interval, code tables, luma quantiser.

    Frames of one ``kind`` differ in their number of MCUs at most.
    """

    owner: np.ndarray
    mcus: int
    interval: int
    codes: np.ndarray
    quantiser: np.ndarray
    size: int
    kind: bytes


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """By the next 16 bits: code length, size and run of the symbol, and its coefficient where all its bits are among the 16.

    Packed as (coefficient + 32768) << 20 | bits to skip << 12 | run << 8 | size << 4 | whether the coefficient is there;
    else the bits to skip are the code's.
    """
    out, code, at = np.zeros(1 << 16, np.int64), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            symbol, run, size = symbols[at], symbols[at] >> 4, symbols[at] & 15
            peek = np.arange(code << (16 - length), (code + 1) << (16 - length))
            if length + size <= 16:
                extra = (peek >> (16 - length - size)) & ((1 << size) - 1)
                value = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
                out[peek] = (value + 32768) << 20 | (length + size) << 12 | symbol >> 4 << 8 | size << 4 | 1
            else:
                out[peek] = 32768 << 20 | length << 12 | run << 8 | size << 4
            code, at = code + 1, at + 1
        code <<= 1
    return out


_layouts: dict[bytes, Layout] = {}


def _layout(data: bytes, start: int, end: int) -> Layout:
    """Parse a frame's header up to its scan; equal headers are parsed once."""
    at = start + 2
    while data[at + 1] != 0xDA:
        at += 2 + struct.unpack_from(">H", data, at + 2)[0]
        if at + 4 > end or data[at] != 0xFF:
            raise ValueError("a frame has no scan")
    stop = at + 2 + struct.unpack_from(">H", data, at + 2)[0]
    head = data[start:stop]
    if head in _layouts:
        return _layouts[head]
    quantisers, tables, parts, interval, frame = {}, {}, [], 0, None
    at = 2
    while at < len(head):
        code, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        if code == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[1 + n :]
        elif code == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif code in (0xC0, 0xC1):
            frame = struct.unpack_from(">BHHB", body)
            parts = [tuple(body[6 + 3 * k : 9 + 3 * k]) for k in range(frame[3])]
        elif 0xC2 <= code <= 0xCF:
            raise ValueError("only baseline frames are decoded")
        elif code == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif code == 0xDA:
            chosen = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
        at += 2 + size
    sampling = [(p[1] >> 4, p[1] & 15) if len(parts) > 1 else (1, 1) for p in parts]
    across, down = max(s[0] for s in sampling), max(s[1] for s in sampling)
    mcus = -(-frame[2] // (8 * across)) * -(-frame[1] // (8 * down))
    owner = np.repeat(np.arange(len(parts)), [a * b for a, b in sampling])
    codes = np.concatenate([t for p in parts for t in (tables[chosen[p[0]] >> 4], tables[0x10 | chosen[p[0]] & 15])])
    quantiser = quantisers[parts[0][2]]
    kind = hashlib.sha256(b"|".join(x.tobytes() for x in (owner, codes, quantiser)) + b"%d" % (interval or -mcus)).digest()
    out = Layout(owner, mcus, interval or mcus, codes, quantiser, len(head), kind)
    if len(_layouts) > 64:
        _layouts.clear()
    _layouts[head] = out
    return out


def decode_frames(data: bytes, frames: list[tuple[int, int]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Luma coefficients (zigzag order, quantised) and pixels (both blocks x 64) of each baseline frame.

    All restart intervals of all frames of one layout are decoded side by side, a symbol of each at a time.
    """
    coefficients: list[np.ndarray] = [np.zeros((0, 64), np.int16)] * len(frames)
    pixels: list[np.ndarray] = [np.zeros((0, 64), np.uint8)] * len(frames)
    groups: dict[bytes, list[int]] = {}
    layouts = [_layout(data, a, b) for a, b in frames]
    for i, layout in enumerate(layouts):
        groups.setdefault(layout.kind, []).append(i)
    source = np.frombuffer(data, np.uint8)
    for members in groups.values():
        layout = layouts[members[0]]
        begins = np.array([frames[i][0] + layouts[i].size for i in members])
        lengths = np.array([frames[i][1] for i in members]) - begins
        scan = np.concatenate([K.ragged(source, begins, lengths), np.zeros(1, np.uint8)])
        heads = np.cumsum(lengths) - lengths
        full = np.flatnonzero(scan[:-1] == 255)
        mark = full[(scan[full + 1] >= 0xD0) & (scan[full + 1] <= 0xD7)]
        stuffed = full[scan[full + 1] == 0] + 1
        keep = np.ones(len(scan), bool)
        keep[stuffed] = False
        starts = np.sort(np.concatenate([heads, mark + 2]))
        starts -= np.searchsorted(stuffed, starts)
        mcus = np.array([layouts[i].mcus for i in members])
        per_frame = -(-mcus // layout.interval)
        if len(starts) != per_frame.sum():
            raise ValueError("restart markers are missing")
        units = np.full(len(starts), layout.interval)
        ends = np.cumsum(per_frame) - 1
        units[ends] = mcus - layout.interval * (per_frame - 1)
        every = _lockstep(np.append(scan[keep], np.zeros(8, np.uint8)), starts, units * len(layout.owner), layout)
        luma = every if len(layout.owner) == 1 else every[np.tile(layout.owner == 0, int(mcus.sum()))]
        shown = _pixels(luma, layout.quantiser)
        cuts = np.cumsum(mcus * int((layout.owner == 0).sum()))[:-1]
        for i, c, p in zip(members, np.split(luma, cuts), np.split(shown, cuts), strict=True):
            coefficients[i], pixels[i] = c, p
    return coefficients, pixels


def _lockstep(data: np.ndarray, starts: np.ndarray, blocks: np.ndarray, layout: Layout) -> np.ndarray:
    """Coefficients of all blocks, in order; ``starts``: first bytes of the intervals, ``blocks``: blocks of each."""
    wide = data.astype(np.int64)
    words = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    limit = len(words) - 1
    parts = int(layout.owner.max()) + 1
    out = np.zeros((int(blocks.sum()), 64), np.int16)
    flat = out.reshape(-1)
    base = np.cumsum(blocks) - blocks
    place, stop = base * 64, (base + blocks) * 64  # of the next coefficient, and behind the last
    bit = starts.astype(np.int64) * 8
    prior = np.zeros((len(starts), parts), np.int64)
    while len(place):
        k = place & 63
        table = (k > 0) << 16
        if parts > 1:
            owner = layout.owner[((place >> 6) - base) % len(layout.owner)]
            table += owner << 17
        peek = (words[bit >> 3] >> (16 - (bit & 7))) & 0xFFFF
        found = layout.codes[table + peek]
        bit += (found >> 12) & 255
        value, size = (found >> 20) - 32768, (found >> 4) & 15
        if not (found & 1).all():
            at = np.flatnonzero((found & 1) == 0)
            n = size[at]
            extra = (words[bit[at] >> 3] >> (32 - (bit[at] & 7) - n)) & ((1 << n) - 1)
            value[at] = np.where(extra < (1 << n) >> 1, extra - (1 << n) + 1, extra)
            bit[at] += n
        at = np.flatnonzero(k == 0)
        if len(at):
            who = owner[at] if parts > 1 else 0
            prior[at, who] += value[at]
            value[at] = prior[at, who]
            found[at] = 0x10
            size[at] = 1
        step = (found >> 8) & 15
        end = (size == 0) & (step != 15)
        place += step
        if end.any():
            some = np.flatnonzero((size > 0) & ((place & 63) >= k) & (place < stop))
            flat[place[some]] = value[some]
            place += 1
            place[end] = (place[end] - 1 | 63) + 1
        else:
            flat[np.minimum(place, stop - 1)] = value
            place += 1
        if (over := place >= stop).any():
            on = ~over
            place, stop, base, bit, prior = place[on], stop[on], base[on], bit[on], prior[on]
        if len(bit) and bit.max() >> 3 > limit:
            raise ValueError("a scan ends early")
    return out


def _inverse() -> np.ndarray:
    """64 coefficients in zigzag order -> 64 pixels."""
    x = np.arange(8)
    basis = np.cos((2 * x[:, None] + 1) * x[None] * np.pi / 16) * np.where(x == 0, np.sqrt(0.125), 0.5)[None]
    return np.kron(basis, basis)[:, ZIGZAG].T


_INVERSE = _inverse()


def _pixels(coefficients: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    # In double precision, so that a pixel does not depend on what else is in the batch.
    shown = (coefficients * quantiser).astype(np.float64) @ _INVERSE
    return np.clip(np.rint(shown + 128), 0, 255).astype(np.uint8)


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) frame of each shot of a movie, from its frames' normalised histograms."""
    if not len(histograms):
        return []
    change = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    found, first, recent = [], 0, []
    for i, d in enumerate(change.tolist(), 1):
        past = np.array(recent[-WINDOW:])
        if d > LEAST and (not len(past) or d > past.mean() + SPREAD * past.std()) and len(past) >= 2:
            found.append((first, i - 1))
            first, recent = i, []
        else:
            recent.append(d)
    return [*found, (first, len(histograms) - 1)]


def analyse(movies: list[bytes]) -> list[tuple[bytes, list[tuple[int, int]], float, int]]:
    """Of each AVI: the bytes kept in its luma coefficients, its shots, seconds a frame, frames."""
    parsed, data, frames, base = [], b"".join(movies), [], 0
    for m in movies:
        p = parse_avi(m)
        parsed.append(p)
        frames += [(base + a, base + b) for a, b in p.frames]
        base += len(m)
    coefficients, pixels = decode_frames(data, frames)
    out, at = [], 0
    for p in parsed:
        n = len(p.frames)
        histograms = np.array([np.bincount(x.ravel() >> 3, minlength=BINS) / max(1, x.size) for x in pixels[at : at + n]]).round(9)
        kept = np.concatenate([c.astype(np.int8).ravel() for c in coefficients[at : at + n]] or [np.zeros(0, np.int8)]).tobytes()
        if p.comment.startswith("blocks="):
            kept = kept[: 64 * int(p.comment[7:])]
        out.append((kept, shots(histograms), p.seconds, n))
        at += n
    return out


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offs in K.chunks(batch.column(1)):
            raw, at = buf.tobytes(), offs.tolist()
            sizes = np.diff(offs)
            padded = np.maximum(-(-sizes // 64), 1) * 64
            media = write_avi([raw[at[i] : at[i + 1]].ljust(n, b"\0") for i, n in enumerate(padded.tolist())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(sizes.astype(np.int64)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"]
            )


def store_as_avi(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text's UTF-8 bytes (null: none), padded with zeros to a positive multiple of 64, as AVI.

    Texts of any length are stored whole, repeated rows each; an empty table gives an empty one, other columns are left out, whatever their names.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(_store, f"doc_id {kind}, n_bytes long, media binary")


def _groups(column: pa.Array, limit: int = K.CHUNK_BYTES) -> Iterator[tuple[int, list[bytes | None]]]:
    values, first, held, size = column.to_pylist(), 0, [], 0
    for i, v in enumerate(values):
        held.append(v)
        size += len(v or b"")
        if size >= limit:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


#: What reading a broken or foreign movie raises.
_BROKEN = (ArithmeticError, AssertionError, LookupError, ValueError, struct.error)


def _analysed(media: list[bytes | None]) -> list[tuple[tuple | None, str | None]]:
    """What analyse finds in each movie, or why nothing can be found. A broken movie spoils no other."""
    known = [m for m in media if m is not None]
    try:
        found = iter([(f, None) for f in analyse(known)])
    except _BROKEN:
        found = iter([_alone(m) for m in known])
    return [(None, "no media") if m is None else next(found) for m in media]


def _alone(movie: bytes) -> tuple[tuple | None, str | None]:
    try:
        return analyse([movie])[0], None
    except _BROKEN as e:
        return None, f"{type(e).__name__}: {e}"


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for first, media in _groups(batch.column(1)):
            rows = {k: [] for k in ("doc_id", "clip", "first_frame", "last_frame", "start_s", "end_s")}
            for i, (movie, _) in enumerate(_analysed(media), first):
                for c, (a, b) in enumerate(movie[1] if movie else ()):
                    for k, v in zip(rows, (ids[i], c, a, b, a * movie[2], (b + 1) * movie[2]), strict=True):
                        rows[k].append(v)
            kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], names=list(rows))


def clips(movies: DataFrame) -> DataFrame:
    """Timed clip rows (doc_id, clip, first_frame, last_frame, start_s, end_s) of rows (doc_id, media); null and broken media have none."""
    kind = movies.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, clip long, first_frame long, last_frame long, start_s double, end_s double"
    return movies.select("doc_id", "media").mapInArrow(_clips, schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, media in _groups(batch.column(2)):
            found = _analysed(media)
            feature = [f and f"frames={f[3]};clips=" + "|".join(f"{a}-{b}@{a * f[2]:.2f}-{(b + 1) * f[2]:.2f}" for a, b in f[1]) for f, _ in found]
            kept = [f and f[0] for f, _ in found]
            of = lambda make, values: [None if v is None else make(v) for v in values]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, len(media)),
                    batch.column(1).slice(first, len(media)),
                    pa.array(of(len, kept), pa.int64()),
                    pa.array(of(lambda k: hashlib.sha256(k).hexdigest(), kept), pa.string()),
                    pa.array(of(lambda k: zlib.crc32(k[-64:]), kept), pa.int64()),
                    pa.array(of(len, media), pa.int64()),
                    pa.array(of(lambda m: hashlib.sha256(m).hexdigest(), media), pa.string()),
                    pa.array(feature, pa.string()),
                    pa.array([e for _, e in found], pa.string()),
                ],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"],
            )


def media_digests(movies: DataFrame) -> DataFrame:
    """Read back each movie of store_as_avi: digests of the kept bytes and of the stored form, and its clips as text.

    Null, torn and foreign media keep their row: what cannot be told is null and ``error`` says why. Repeated rows repeat, an empty
    table gives an empty one, other columns are left out.
    """
    kind = movies.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string, error string"
    )
    return movies.select("doc_id", "n_bytes", "media").mapInArrow(_digests, schema)
