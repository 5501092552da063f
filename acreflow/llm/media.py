"""AVI motion-JPEG columns: container and index, intra frames, shots.

``write_avi`` stores a payload losslessly: each run of 64 bytes is one 8x8
block, each byte the magnitude bits of one quantised coefficient of size
category 8, whose 256 values are exactly the bytes.  Frames are baseline grey
JPEGs with a restart marker after each block.  ``read_avi`` parses the RIFF
tree and its ``idx1`` index, ``decode_frames`` decodes the entropy-coded data
of many frames at once, one lane for each restart interval, and gives the
coefficients (the payload) and the pixels.  ``shots`` finds cuts where the
histogram difference of two frames passes a threshold adapted to the
differences before it.

Defined results: a null text is empty and gives one block of zeros; equal
texts give equal results; every row gives a row, repeated rows and null ids
too; a text of any length is stored and read whole; an empty table gives an
empty table; other columns are ignored, whatever their names.  ``clip_rows``
takes grey and colour baseline frames, with or without code tables of their
own; it gives no row for a null or empty file, and for a damaged or foreign one
a row with nulls and an ``error``.  Frames that tie in difference cut alike.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import buffers, pieces

BLOCK, SIDE, RATE = 64, 32, 25  # bytes a block, pixels a frame's side, frames a second
TOGETHER = 64  # frames of a foreign file that are decoded together
SLICE = 512  # frames of own files that are decoded together
BINS, SPAN, FACTOR, FLOOR = 16, 8, 2.0, 0.1  # histogram bins; differences that adapt the threshold; its factor and least value

#: The zigzag order of an 8x8 block, by its rule: diagonals, walked up and down in turn.
ZIGZAG = np.array([y * 8 + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])


def _basis() -> np.ndarray:
    """[coefficient in zigzag order, pixel], scaled by 2**13 to integers, so sums in float64 are exact."""
    n = np.arange(8)
    c = np.cos((2 * n[None, :] + 1) * n[:, None] * np.pi / 16) * np.where(n[:, None] == 0, np.sqrt(0.125), 0.5)
    return np.rint(np.einsum("vy,ux->vuyx", c, c).reshape(64, 64)[ZIGZAG] * 8192)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, length: int, symbols: bytes) -> bytes:
    return bytes([kind]) + bytes(len(symbols) if i == length else 0 for i in range(1, 17)) + symbols


def jpeg_header(width: int, height: int) -> bytes:
    """Up to the scan: all quantisers 1; one 8-bit code for (no zeros before, category 8)."""
    return b"".join((
        b"\xff\xd8", _segment(0xDB, b"\0" + b"\1" * 64), _segment(0xC0, struct.pack(">BHHB3B", 8, height, width, 1, 1, 0x11, 0)),
        _segment(0xC4, _table(0x00, 8, b"\x08") + _table(0x10, 8, b"\x08")), _segment(0xDD, struct.pack(">H", 1)), _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ))


def encode_blocks(payload: np.ndarray) -> np.ndarray:
    """[blocks, 130] entropy-coded blocks with their restart markers; the payload may hold no 0xFF (UTF-8 never does)."""
    blocks = payload.reshape(-1, BLOCK)
    out = np.zeros((len(blocks), 2 * BLOCK + 2), np.uint8)
    out[:, 1:128:2] = blocks
    out[:, 128] = 0xFF
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes, side: int = SIDE, rate: int = RATE) -> bytes:
    """An AVI file of the payload, a positive multiple of 64 bytes, without the byte 0xFF."""
    if not payload or len(payload) % BLOCK or b"\xff" in payload:
        raise ValueError("a positive multiple of 64 bytes without 0xFF")
    each = (side // 8) ** 2
    blocks = encode_blocks(np.frombuffer(payload, np.uint8))
    n = -(-len(blocks) // each)
    if short := n * each - len(blocks):
        blocks = np.concatenate([blocks, encode_blocks(np.zeros(short * BLOCK, np.uint8))])
    blocks = blocks.reshape(n, each, -1)
    blocks[:, :, 129] = 0xD0 + np.arange(each) % 8
    blocks[:, -1, 129] = 0xD9  # the end of the image
    head, body = jpeg_header(side, side), blocks.reshape(n, -1)
    size = len(head) + body.shape[1]
    frames = [head + row.tobytes() for row in body]
    avih = struct.pack("<14I", 1_000_000 // rate, size * rate, 0, 0x10, n, 0, 1, size, side, side, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, rate, 0, n, size, 10_000, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % len(payload)))
    movi, index, at = [b"movi"], [], 4
    for frame in frames:
        index.append(b"00dc" + struct.pack("<3I", 0x10, at, len(frame)))
        movi.append(_chunk(b"00dc", frame))
        at += len(movi[-1])
    return _chunk(b"RIFF", b"AVI " + header + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _movies(file: bytes):
    """(name, body, end) of the chunks of all RIFF lists of a file, lists opened, cut ones ending with the file."""
    todo, at = [], 0
    while at + 12 <= len(file) and file[at : at + 4] == b"RIFF":
        end = at + 8 + struct.unpack_from("<I", file, at + 4)[0]
        todo.append((at + 12, min(end, len(file))))
        at = end + end % 2
    todo.reverse()
    while todo:
        at, end = todo.pop()
        if at + 8 > end:
            continue
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        body, last = at + 8, min(end, at + 8 + size)
        todo.append((at + 8 + size + size % 2, end))
        if name == b"LIST" and body + 4 <= last:
            yield file[body : body + 4], body, last
            todo.append((body + 4, last))
        else:
            yield name, body, last


def read_avi(file: bytes) -> dict:
    """rate, payload (None if the file doesn't say) and frames: (start, end) of each in the file.

    Frames are those of the index and, behind it, of further RIFF lists; all
    are found by walking the lists if there is no index or it does not fit.
    """
    if file[:4] != b"RIFF" or file[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found: dict = {"rate": 0.0, "payload": None, "frames": []}
    movi, walked, index = 0, [], []
    for name, body, end in _movies(file):
        if name == b"movi":
            movi = movi or body
        elif name == b"avih" and end - body >= 4:
            found["rate"] = 1e6 / (struct.unpack_from("<I", file, body)[0] or 40_000)
        elif name == b"ICMT" and file[body : body + 8] == b"payload=" and (told := file[body + 8 : end].rstrip(b"\0")).isdigit():
            found["payload"] = int(told)
        elif name == b"idx1" and not index:
            index = [struct.unpack_from("<4s3I", file, i) for i in range(body, end - 15, 16)]
        elif name[2:] in (b"dc", b"db") and name[:2].isdigit():
            walked.append((body, end))
    index = [(kind, offset, length) for kind, _, offset, length in index if kind[2:] in (b"dc", b"db")]
    if index:
        # offsets count from ``movi`` or from the file's start
        base = movi if file[movi + index[0][1] : movi + index[0][1] + 4] == index[0][0] else 0
        indexed = [(base + offset + 8, base + offset + 8 + length) for _, offset, length in index]
        if set(indexed) <= set(walked):
            found["frames"] = indexed + [x for x in walked if x[0] > max(indexed)[0]]
    found["frames"] = [(a, b) for a, b in found["frames"] or walked if b > a]  # an empty chunk repeats the frame before
    return found


#: The code tables that motion-JPEG frames without tables of their own use (ITU-T T.81, annex K.3):
#: codes of each length from 1 to 16, and symbols in order of their codes.
DEFAULT_CODES = {
    0x00: ("00010501010101010100000000000000", "000102030405060708090a0b"),
    0x01: ("00030101010101010101010000000000", "000102030405060708090a0b"),
    0x10: (
        "0002010303020403050504040000017d",
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a"
        "535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7"
        "c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    ),
    0x11: (
        "00020102040403040705040400010277",
        "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a43444546474849"
        "4a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5"
        "c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
    ),
}


def jpeg_head(frame: bytes) -> bytes:
    """All that stands before the scan's data."""
    at = 2
    while True:
        while frame[at : at + 2] == b"\xff\xff":  # fill bytes
            at += 1
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("a frame without a scan")
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        at += 2 + size
        if marker == 0xDA:
            return frame[:at]


def code_table(counts: bytes, symbols: bytes) -> np.ndarray:
    """Code length and symbol by the next 16 bits; 0 where no code begins so."""
    look, code, k = np.zeros(1 << 16, np.int64), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            look[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return look


@functools.lru_cache(64)
def jpeg_tables(head: bytes) -> dict:
    """Size, parts (sampling factors, quantiser, code tables of each component), restart interval and where the scan's data begin."""
    out: dict = {"scan": len(head), "restart": 0}
    quant: dict[int, np.ndarray] = {}
    codes = {k: code_table(bytes.fromhex(c), bytes.fromhex(v)) for k, (c, v) in DEFAULT_CODES.items()}
    at, parts, scan = 2, {}, None
    while at < len(head):
        while head[at : at + 2] == b"\xff\xff":
            at += 1
        marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4  # 16-bit quantisers
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC0:
            _, out["height"], out["width"], n = struct.unpack_from(">BHHB", body)
            parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
        elif marker == 0xDD:
            out["restart"] = struct.unpack_from(">H", body)[0]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = code_table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only baseline frames")
        elif marker == 0xDA:
            scan = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
        at += 2 + size
    if not parts or scan is None or len(scan) != len(parts) or not out["height"] * out["width"]:
        raise ValueError("only frames of one scan that holds all components")
    alone = len(parts) == 1
    out["parts"] = [((1, 1) if alone else parts[c][:2], quant[parts[c][2]], codes[t >> 4], codes[0x10 | t & 15]) for c, t in scan]
    return out


def _values(window: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed values of ``size`` magnitude bits at the top of 64-bit windows."""
    raw = ((window >> np.uint64(1)) >> (np.uint64(63) - size)).astype(np.int64)
    half = np.int64(1) << size.astype(np.int64)
    return np.where(2 * raw < half, raw - half + 1, raw) * (half > 1)


def decode_lanes(data: np.ndarray, start: np.ndarray, blocks: np.ndarray, plan: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """[lanes, most blocks, 64] coefficients of entropy-coded runs that begin at byte ``start``; stuffing is gone from ``data``.

    plan: component and code tables of each block of a unit, in turn.
    """
    data = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(data.view(np.uint8)[:8].view("<u8"), (len(data) - 8,), (1,))
    bit, most, last = start.astype(np.uint64) * np.uint64(8), int(blocks.max()), np.uint64(8 * (len(data) - 16))
    out = np.zeros((len(start), most, 64), np.int16)
    flat, before = out.reshape(-1), np.zeros((1 + max(c for c, _, _ in plan), len(start)), np.int64)

    def take(at: np.ndarray, look: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at each place, and the 64-bit windows behind their codes."""
        if at.max() > last:
            raise ValueError("a frame's data end too soon")
        window = eight[(at >> np.uint64(3)).astype(np.int64)].byteswap() << (at & np.uint64(7))
        code = look[(window >> np.uint64(48)).astype(np.int64)]
        if code.min() < 256:
            raise ValueError("a code that no table has")
        length = (code >> 8).astype(np.uint64)
        at += length
        return code & 255, window << length

    for m in range(most):
        component, dc, ac = plan[m % len(plan)]
        lane = np.flatnonzero(blocks > m)
        at = bit[lane]
        symbol, window = take(at, dc)
        if symbol.max() > 15:
            raise ValueError("a size that no coefficient has")
        before[component, lane] += _values(window, symbol.astype(np.uint64))
        at += symbol.astype(np.uint64)
        out[lane, m, 0] = before[component, lane]
        place = (lane * most + m) * 64
        k, end = place + 1, place + 64
        while len(lane):
            symbol, window = take(at, ac)
            size = (symbol & 15).astype(np.uint64)
            k += symbol >> 4
            put = size > 0
            if put.all() and (k < end).all():
                flat[k] = _values(window, size)
            else:
                put &= k < end
                flat[k[put]] = _values(window[put], size[put])
                k[symbol == 0] = 1 << 60  # the end of a block
            at += size
            k += 1
            if not (go := k < end).all():
                bit[lane[~go]] = at[~go]
                lane, k, end, at = lane[go], k[go], end[go], at[go]
    return out


def decode_frames(file: np.ndarray, frames: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients [frames, blocks, 64] of the first component (grey or brightness) in zigzag order, rows of blocks
    from the top, and its pixels [frames, height, width], of frames of one size; frames of one header are decoded together."""
    heads: dict[bytes, list[int]] = {}
    for i, (a, b) in enumerate(frames):
        heads.setdefault(_head_of(file, a, b), []).append(i)
    done: list = [None] * len(frames)
    for head, which in heads.items():
        coefficients, pixels = _decode_alike(file, [frames[i] for i in which], jpeg_tables(head))
        if len(heads) == 1:
            return coefficients, pixels
        for i, c, p in zip(which, coefficients, pixels, strict=True):
            done[i] = (c, p)
    if len({p.shape for _, p in done}) > 1:
        raise ValueError("frames of different sizes")
    return np.stack([c for c, _ in done]), np.stack([p for _, p in done])


def _head_of(file: np.ndarray, a: int, b: int) -> bytes:
    try:
        return jpeg_head(file[a : min(b, a + 2048)].tobytes())
    except ValueError:  # a header that is longer than most
        return jpeg_head(file[a:b].tobytes())


def _decode_alike(file: np.ndarray, frames: list[tuple[int, int]], head: dict) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and pixels of frames of one header."""
    (across, down), quant = head["parts"][0][:2]
    most_across, most_down = (max(part[0][i] for part in head["parts"]) for i in (0, 1))
    wide, tall = -(-head["width"] // (8 * most_across)), -(-head["height"] // (8 * most_down))
    plan = [(c, dc, ac) for c, ((h, v), _, dc, ac) in enumerate(head["parts"]) for _ in range(h * v)]
    units, n = wide * tall, len(frames)
    each = head["restart"] or units
    body = np.concatenate([file[a + head["scan"] : b] for a, b in frames])
    ends = np.cumsum([b - a - head["scan"] for a, b in frames])
    ff = body == 0xFF
    after = np.r_[body[1:], np.uint8(0)]
    marks = np.flatnonzero(ff & (after >= 0xD0) & (after <= 0xD7))
    stuffed = np.r_[False, (ff & (after == 0))[:-1]]
    shift = np.cumsum(stuffed)
    lanes = np.sort(np.r_[0, ends[:-1], marks + 2])
    per = -(-units // each)
    if len(lanes) != per * n:
        raise ValueError("restart markers are missing")
    blocks = np.tile(np.minimum(each, units - np.arange(per) * each), n) * len(plan)
    coded = decode_lanes(body[~stuffed], lanes - shift[lanes], blocks, plan)
    own = across * down  # blocks of the first component lead each unit
    first = coded.reshape(n, per * each, len(plan), 64)[:, :units, :own]
    grid = first.reshape(n, tall, wide, down, across, 64).swapaxes(2, 3).reshape(n, tall * down, wide * across, 64)
    # a component of a frame may end inside a unit
    rows, columns = (-(-(-(-head[side] * f // m)) // 8) for side, f, m in (("height", down, most_down), ("width", across, most_across)))
    coefficients = grid[:, :rows, :columns].reshape(n, rows * columns, 64)
    real = (coefficients * quant).astype(np.float64).reshape(-1, 64) @ _BASIS
    pixels = np.clip(((real + (128 * 8192 + 4096)) // 8192), 0, 255).astype(np.uint8)
    pixels = pixels.reshape(n, rows, columns, 8, 8).swapaxes(2, 3).reshape(n, rows * 8, columns * 8)
    return coefficients, pixels[:, : -(-head["height"] * down // most_down), : -(-head["width"] * across // most_across)]


_BASIS = _basis()


def histograms(pixels: np.ndarray, bins: int = BINS) -> np.ndarray:
    n = len(pixels)
    at = (pixels.reshape(n, -1).astype(np.int64) * bins >> 8) + np.arange(n)[:, None] * bins
    return np.bincount(at.ravel(), minlength=n * bins).reshape(n, bins)


def shots(hist: np.ndarray, span: int = SPAN, factor: float = FACTOR, floor: float = FLOOR) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot.

    A cut lies where the difference, half the sum of absolute histogram
    changes over the pixels, is over ``floor`` and ``factor`` times the mean
    of up to ``span`` differences since the cut before.
    """
    size = hist[0].sum() * 2
    change = np.abs(np.diff(hist, axis=0)).sum(axis=1)
    cuts, since = [0], 0
    for i, x in enumerate(change.tolist()):
        near = change[max(since, i - span) : i]
        mean = int(near.sum()) / len(near) if len(near) else 0.0
        if x > floor * size and x > factor * mean and (len(near) or x > 2 * floor * size):
            cuts.append(i + 1)
            since = i + 1
    return list(zip(cuts, [*cuts[1:], len(hist)], strict=True))


def payload_of(coefficients: np.ndarray, size: int) -> bytes:
    """The bytes that ``write_avi`` stored."""
    flat = coefficients.reshape(-1)[:size].astype(np.int64)
    return np.where(flat < 0, flat + 255, flat).astype(np.uint8).tobytes()


FEATURES = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def _describe(rate: float, hist: np.ndarray) -> str:
    clips = "|".join(f"{a / rate:.2f}-{b / rate:.2f}" for a, b in shots(hist))
    total = hist.sum(axis=0)
    return f"frames={len(hist)};rate={rate:g};clips={clips};histogram={','.join(map(str, total.tolist()))}"


def _text_features(part: np.ndarray, off: np.ndarray):
    """The features of each text of a piece: written as AVI and read back; the frames of all are decoded ``SLICE`` at a time."""
    files, plain = [], np.diff(off)
    for i in range(len(plain)):
        raw = part[off[i] : off[i + 1]].tobytes()
        files.append(write_avi(raw + b"\0" * (-len(raw) % BLOCK if raw else BLOCK)))
    parsed = [read_avi(f) for f in files]
    stored = [(len(f), hashlib.sha256(f).hexdigest()) for f in files]
    base = np.cumsum([0, *map(len, files)])
    frames = [(a + int(o), b + int(o)) for x, o in zip(parsed, base, strict=False) for a, b in x["frames"]]
    data = np.frombuffer(files[0] if len(files) == 1 else b"".join(files), np.uint8)
    ends = np.cumsum([len(x["frames"]) for x in parsed])
    text, left, digest, tail, hist = 0, parsed[0]["payload"] if parsed else 0, hashlib.sha256(), b"", []
    for begin in range(0, len(frames), SLICE):
        coefficients, pixels = decode_frames(data, frames[begin : begin + SLICE])
        counted, at = histograms(pixels), 0
        while at < len(counted):
            to = min(int(ends[text]) - begin, len(counted))
            payload = payload_of(coefficients[at:to], left)
            left -= len(payload)
            digest.update(payload)
            tail = (tail + payload)[-BLOCK:]
            hist.append(counted[at:to])
            at = to
            if begin + to == ends[text]:
                size, sha = stored[text]
                yield int(plain[text]), parsed[text]["payload"] - left, digest.hexdigest(), zlib.crc32(tail), size, sha, _describe(parsed[text]["rate"], np.concatenate(hist))
                text += 1
                left, digest, tail, hist = parsed[text]["payload"] if text < len(parsed) else 0, hashlib.sha256(), b"", []


def feature_batches(batches):
    """mapInArrow: id, text -> id and FEATURES"""
    for batch in batches:
        data, at = buffers(batch.column(1))
        for i, j in pieces(at, 1 << 19):
            rows = list(_text_features(data[at[i] : at[j]], at[i : j + 1] - at[i]))
            columns = [pa.array(x, kind) for x, (_, kind) in zip(zip(*rows, strict=True), FEATURES, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=["doc_id", *(n for n, _ in FEATURES)])


def media_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    plain = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kinds = ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in FEATURES)
    return plain.mapInArrow(feature_batches, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, {kinds}")


CLIPS = [("shot", pa.int32()), ("first_frame", pa.int64()), ("end_frame", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("error", pa.string())]


def _clips(file: bytes) -> list[tuple]:
    """A row for each shot of a file, or one that says what is wrong with it.  Frames are decoded a few at a time."""
    try:
        found = read_avi(file)
        frames, data = found["frames"], np.frombuffer(file, np.uint8)
        if not frames or not found["rate"]:
            raise ValueError("no frames" if not frames else "no frame rate")
        parts = [decode_frames(data, frames[i : i + TOGETHER])[1] for i in range(0, len(frames), TOGETHER)]
        if len({p.shape[1:] for p in parts}) > 1:
            raise ValueError("frames of different sizes")
        hist = np.concatenate([histograms(p) for p in parts])
        return [(k, a, b, a / found["rate"], b / found["rate"], None) for k, (a, b) in enumerate(shots(hist))]
    except (ValueError, IndexError, KeyError, struct.error) as wrong:
        return [(None, None, None, None, None, f"{type(wrong).__name__}: {wrong}")]


def clip_batches(batches):
    """mapInArrow: id, AVI file -> one row for each shot"""
    for batch in batches:
        for i, file in enumerate(batch.column(1)):
            if rows := _clips(file.as_py()) if file.is_valid and len(file.as_buffer()) else []:
                keys = batch.column(0).take(pa.array([i] * len(rows)))
                columns = [pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), CLIPS, strict=True)]
                yield pa.RecordBatch.from_arrays([keys, *columns], names=["media_id", *(n for n, _ in CLIPS)])


def clip_rows(files: DataFrame, key: str = "media_id", media: str = "media") -> DataFrame:
    """media_id, shot, first_frame, end_frame, start_s, end_s, error of each shot of AVI motion-JPEG files."""
    plain = files.select(F.col(key).alias("media_id"), F.col(media).cast("binary").alias("media"))
    kind = plain.schema["media_id"].dataType.simpleString()
    return plain.mapInArrow(clip_batches, f"media_id {kind}, shot int, first_frame long, end_frame long, start_s double, end_s double, error string")
