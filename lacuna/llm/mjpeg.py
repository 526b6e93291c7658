"""AVI files of motion-JPEG intra frames: a writer, a RIFF parser, and baseline decoding.

The writer stores one 8-bit sample in each 8x8 block of a grey baseline JPEG: a
block with only a DC coefficient is a flat square, and with a DC quantiser of 8
the coefficient is the sample less 128, so samples survive exactly.  A frame
holds 16 x 12 samples (128 x 96 pixels).  Writing and reading go through many
frames at once: the bits of one block (DC code, magnitude, end of block) are at
most 14, so one table look-up decodes a block in every frame in step.  Frames
with other headers take the general baseline decoder.
"""

from __future__ import annotations

import struct

import numpy as np

WIDE, HIGH = 16, 12
SAMPLES = WIDE * HIGH
FPS = 25

#: Fixed code lengths of the DC magnitude categories 0 to 8; magnitudes of 16 to 63 are the usual ones in text.
_DC_LENGTHS = {5: 2, 6: 2, 4: 3, 7: 3, 3: 4, 0: 5, 1: 5, 2: 5, 8: 5}


def _codes(lengths: dict[int, int]) -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    """Canonical Huffman codes: counts by length, symbols in order, and (code, length) by symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts, codes, code, last = [0] * 16, {}, 0, 0
    for s in order:
        n = lengths[s]
        code <<= n - last if last else 0
        last = n
        codes[s] = (code, n)
        code += 1
        counts[n - 1] += 1
    return bytes(counts), bytes(order), codes


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_COUNTS, _ORDER, _DC = _codes(_DC_LENGTHS)
HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0]) + bytes([8] + [1] * 63))
    + _segment(0xC0, struct.pack(">BHHB", 8, HIGH * 8, WIDE * 8, 1) + bytes([1, 0x11, 0]))
    + _segment(0xC4, bytes([0x00]) + _COUNTS + _ORDER)
    + _segment(0xC4, bytes([0x10, 1]) + bytes(15) + bytes([0]))
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)

#: By difference + 255: the bits of a block (DC code, magnitude bits, the one-bit end of block) and their number.
_BITS, _LEN = np.zeros(511, np.uint32), np.zeros(511, np.int64)
#: By the next 16 bits: the difference and the bits used.
_DIFF, _USED = np.zeros(65536, np.int32), np.zeros(65536, np.int64)
for _d in range(-255, 256):
    _cat = abs(_d).bit_length()
    _code, _n = _DC[_cat]
    _word = (_code << _cat | (_d if _d >= 0 else _d + (1 << _cat) - 1)) << 1
    _BITS[_d + 255], _LEN[_d + 255] = _word, _n + _cat + 1
    _lo = _word << 16 - (_n + _cat + 1)
    _DIFF[_lo : _lo + (1 << 16 - (_n + _cat + 1))] = _d
    _USED[_lo : _lo + (1 << 16 - (_n + _cat + 1))] = _n + _cat + 1


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """A JPEG for each row of 192 samples."""
    n = len(samples)
    d = samples.astype(np.int16)
    d[:, 1:] -= samples[:, :-1]
    d[:, 0] -= 128
    d += 255
    bits, lens = np.empty((n, SAMPLES + 1), np.uint32), np.empty((n, SAMPLES + 1), np.int64)
    bits[:, :-1], lens[:, :-1] = _BITS[d], _LEN[d]
    pad = -lens[:, :-1].sum(axis=1) % 8
    bits[:, -1], lens[:, -1] = (1 << pad) - 1, pad
    sizes = lens.sum(axis=1) // 8
    bits, lens = bits.ravel(), lens.ravel()
    after = np.cumsum(lens)
    shift = np.repeat(after, lens)
    shift -= np.arange(1, len(shift) + 1)
    packed = np.packbits((np.repeat(bits, lens) >> shift.astype(np.uint32)).astype(np.uint8) & 1)
    full = np.flatnonzero(packed == 0xFF)
    ends = np.cumsum(sizes)
    ends = ends + np.searchsorted(full, ends)
    raw = np.insert(packed, full + 1, 0).tobytes()
    out, a = [], 0
    for b in ends.tolist():
        out.append(HEADER + raw[a:b] + b"\xff\xd9")
        a = b
    return out


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int = WIDE * 8, height: int = HIGH * 8, fps: int = FPS) -> bytes:
    """An AVI 1.0 file with an index."""
    sizes = np.array([len(f) for f in frames], np.int64)
    index = np.zeros((len(frames), 4), "<u4")
    index[:, 0], index[:, 1] = int.from_bytes(b"00dc", "little"), 0x10
    index[:, 2] = 4 + np.concatenate(([0], np.cumsum(8 + sizes + (sizes & 1))[:-1]))
    index[:, 3] = sizes
    largest = int(sizes.max(initial=0))
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIiI4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, -1, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    movi = _chunk(b"LIST", b"movi" + b"".join([_chunk(b"00dc", f) for f in frames]))
    return _chunk(b"RIFF", b"AVI " + head + movi + _chunk(b"idx1", index.tobytes()))


def read_avi(data: bytes) -> tuple[list[tuple[int, int]], float]:
    """(offset, size) of every video chunk, by the index or, without one, by walking ``movi``; and frames a second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi = end = at = None
    fps, found, index = float(FPS), [], None
    stack = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if kind == b"LIST":
                what = data[at + 8 : at + 12]
                if what == b"movi":
                    movi = (at + 8, at + 8 + size)
                else:
                    stack.append((at + 12, at + 8 + size))
            elif kind == b"strh" and data[at + 8 : at + 12] == b"vids":
                scale, rate = struct.unpack_from("<II", data, at + 28)
                fps = rate / scale if scale else fps
            elif kind == b"idx1":
                index = np.frombuffer(data, "<u4", size // 16 * 4, at + 8).reshape(-1, 4)
            at += 8 + size + (size & 1)
    if movi is None:
        return [], fps
    if index is not None:
        ids = np.frombuffer(index[:, 0].tobytes(), np.uint8).reshape(-1, 4)
        video = index[(ids[:, 2] == ord("d")) & ((ids[:, 3] == ord("c")) | (ids[:, 3] == ord("b")))]
        base = movi[0] if len(video) == 0 or data[movi[0] + int(video[0, 2]) :][:2].isdigit() else 0
        return [(base + int(o) + 8, int(n)) for o, n in video[:, 2:].tolist()], fps
    at = movi[0] + 4
    while at + 8 <= movi[1]:
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at + 2 : at + 4] in (b"dc", b"db"):
            found.append((at + 8, size))
        at += 8 + size + (size & 1)
    return found, fps


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Samples (n, 192) of frames with this module's header, all frames in step."""
    n = len(frames)
    if not n:
        return np.zeros((0, SAMPLES), np.uint8)
    h = len(HEADER)
    raw = np.frombuffer(b"".join([f[h:-2] for f in frames]), np.uint8)
    ends = np.cumsum([len(f) - h - 2 for f in frames])
    stuffed = np.flatnonzero((raw[1:] == 0) & (raw[:-1] == 0xFF)) + 1
    starts = np.concatenate(([0], ends[:-1]))
    starts = starts - np.searchsorted(stuffed, starts)
    b = np.append(np.delete(raw, stuffed), np.zeros(3, np.uint8)).astype(np.uint32)
    window = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    at = starts.astype(np.int64) * 8
    diffs = np.empty((SAMPLES, n), np.int32)
    for k in range(SAMPLES):
        w = window[at >> 3] >> (8 - (at & 7)).astype(np.uint32) & np.uint32(0xFFFF)
        diffs[k] = _DIFF[w]
        at += _USED[w]
    out = np.cumsum(diffs, axis=0, out=diffs)
    out += 128
    return np.ascontiguousarray(out.T).astype(np.uint8)


_ZIGZAG = sorted(range(64), key=lambda i: ((i // 8) + (i % 8), (i // 8) if ((i // 8) + (i % 8)) % 2 else (i % 8)))
_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


def decode_jpeg(data: bytes) -> np.ndarray:
    """Luma of any baseline Huffman JPEG (8 bits, up to four components, restart intervals), as (height, width) uint8."""
    quant: dict[int, np.ndarray] = {}
    tables: dict[int, dict[tuple[int, int], int]] = {}
    parts: list[list[int]] = []
    high = wide = interval = 0
    at = 2
    while True:
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                code, k, table = 0, 17, {}
                for length in range(1, 17):
                    for _ in range(body[length]):
                        table[length, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0]] = table
                body = body[k:]
        elif marker in (0xC0, 0xC1):
            high, wide, n = struct.unpack_from(">HHB", body, 1)
            parts = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i], 0, 0] for i in range(n)]
        elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            for i in range(body[0]):
                for p in parts:
                    if p[0] == body[1 + 2 * i]:
                        p[4], p[5] = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            break
    bits, left = 0, 0

    def take(n: int) -> int:
        nonlocal bits, left, at
        while left < n:
            byte = data[at] if at < len(data) else 0
            if byte == 0xFF and at + 1 < len(data) and data[at + 1] == 0:
                at += 1
            elif byte == 0xFF:
                byte, at = 0, at - 1  # a marker: feed zeros and stay
            at += 1
            bits, left = (bits << 8 | byte) & 0xFFFFFFFFFF, left + 8
        left -= n
        return bits >> left & ((1 << n) - 1)

    def symbol(table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")

    def signed(n: int) -> int:
        v = take(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    if len(parts) == 1:
        parts[0][1] = parts[0][2] = 1
    hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-wide // (8 * hmax)), -(-high // (8 * vmax))
    luma = np.zeros((down * 8 * parts[0][2], across * 8 * parts[0][1]))
    dc = [0] * len(parts)
    for m in range(across * down):
        if interval and m and m % interval == 0:
            bits = left = 0
            while not (data[at] == 0xFF and 0xD0 <= data[at + 1] <= 0xD7):
                at += 1
            at += 2
            dc = [0] * len(parts)
        for c, (_, h, v, q, td, ta) in enumerate(parts):
            for y in range(v):
                for x in range(h):
                    block = np.zeros(64)
                    dc[c] += signed(symbol(tables[td]))
                    block[0] = dc[c] * quant[q][0]
                    k = 1
                    while k < 64:
                        rs = symbol(tables[0x10 | ta])
                        if rs == 0:
                            break
                        k += rs >> 4
                        if rs & 15 and k < 64:
                            block[_ZIGZAG[k]] = signed(rs & 15) * quant[q][k]
                        k += 1
                    if c == 0:
                        top, side = (m // across * v + y) * 8, (m % across * h + x) * 8
                        luma[top : top + 8, side : side + 8] = _COS @ block.reshape(8, 8) @ _COS.T + 128
    full = luma[: -(-high * parts[0][2] // vmax), : -(-wide * parts[0][1] // hmax)]
    return np.clip(np.rint(full), 0, 255).astype(np.uint8)


def cuts(histograms: np.ndarray, window: int = 8, factor: float = 3.0, floor: float = 0.12) -> np.ndarray:
    """Frames that begin a new shot.

    The distance of neighbouring histograms (half the L1 distance of their
    shares, 0 to 1) must pass ``floor`` and the mean plus ``factor`` standard
    deviations of the distances in up to ``window`` frames before; the first
    distance is held against those after it, or the floor alone if it is the only one.
    """
    if len(histograms) < 2:
        return np.zeros(0, np.int64)
    share = histograms / np.maximum(histograms.sum(axis=1, keepdims=True), 1)
    d = np.abs(np.diff(share, axis=0)).sum(axis=1) / 2
    s1, s2 = np.concatenate(([0.0], np.cumsum(d))), np.concatenate(([0.0], np.cumsum(d * d)))
    i = np.arange(len(d))
    a = np.maximum(0, i - window)
    b = i.copy()
    a[0], b[0] = min(1, len(d)), min(1 + window, len(d))
    n = np.maximum(b - a, 1)
    mean = (s1[b] - s1[a]) / n
    std = np.sqrt(np.maximum((s2[b] - s2[a]) / n - mean * mean, 0))
    return np.flatnonzero((d > floor) & (d > mean + factor * std)) + 1
