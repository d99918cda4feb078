"""AVI motion-JPEG columns: bytes stored as losslessly coded grey frames, read back through the RIFF index.

A frame is a lossless sequential JPEG (SOF3, predictor 1, 8 bits). Its Huffman table is chosen so that the
code of category s has 9 - s bits, so that a difference takes 9 bits whatever its size: a standard stream
that can be packed and unpacked as arrays. Frames of other writers with other tables go bit by bit.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from tapeworks.llm.common import appended

WIDTH, HEIGHT, FPS = 16, 12, 25
FRAME = WIDTH * HEIGHT
_BITS = bytes([1] * 9 + [0] * 7)
_CATEGORIES = bytes(range(8, -1, -1))


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """9-bit words by difference + 255, and differences by 9-bit word."""
    enc, dec = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << s) - 1
        enc[d + 255] = ((((1 << (8 - s)) - 1) << 1) << s) | extra
        dec[enc[d + 255]] = d
    return enc, dec


_ENC, _DEC = _codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_HEAD = (
    b"\xff\xd8"
    + _segment(0xC4, b"\x00" + _BITS + _CATEGORIES)
    + _segment(0xC3, struct.pack(">BHHB", 8, HEIGHT, WIDTH, 1) + b"\x01\x11\x00")
    + _segment(0xDA, b"\x01\x01\x00\x01\x00\x00")
)


def _packed(words: np.ndarray) -> np.ndarray:
    """9-bit words, 8 in 9 bytes."""
    w = words.reshape(len(words), -1, 8).astype(np.uint16)
    out = np.empty((*w.shape[:2], 9), np.uint8)
    out[..., 0] = w[..., 0] >> 1
    for k in range(1, 8):
        out[..., k] = ((w[..., k - 1] << (8 - k)) | (w[..., k] >> (k + 1))) & 0xFF
    out[..., 8] = w[..., 7] & 0xFF
    return out.reshape(len(words), -1)


def _unpacked(raw: np.ndarray) -> np.ndarray:
    b = raw.reshape(len(raw), -1, 9).astype(np.uint16)
    out = np.empty((*b.shape[:2], 8), np.uint16)
    for k in range(8):
        out[..., k] = ((b[..., k] << (k + 1)) | (b[..., k + 1] >> (7 - k))) & 0x1FF
    return out.reshape(len(raw), -1)


def encode(payload: bytes) -> bytes:
    """An AVI of grey 16 x 12 frames; the payload's length must be a positive multiple of 192."""
    frames = np.frombuffer(payload, np.uint8).reshape(-1, HEIGHT, WIDTH).astype(np.int16)
    diff = frames.copy()
    diff[:, :, 1:] -= frames[:, :, :-1]
    diff[:, 1:, 0] -= frames[:, :-1, 0]
    diff[:, 0, 0] -= 128
    raw = _packed(_ENC[diff.reshape(len(frames), -1) + 255]).tobytes()
    step = FRAME * 9 // 8
    chunks, index, at = [], [], 4
    for k in range(0, len(raw), step):
        jpeg = _HEAD + raw[k : k + step].replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
        chunks.append(b"00dc" + struct.pack("<I", len(jpeg)) + jpeg + b"\x00" * (len(jpeg) % 2))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(jpeg)))
        at += len(chunks[-1])
    n, biggest = len(chunks), max(map(len, chunks))
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body
    avih = struct.pack("<14I", 1_000_000 // FPS, biggest * FPS, 0, 0x10, n, 0, 1, biggest, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, biggest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl)
    return chunk(b"RIFF", b"AVI " + hdrl + chunk(b"LIST", b"movi" + b"".join(chunks)) + chunk(b"idx1", b"".join(index)))


def _index(avi: bytes) -> tuple[list[tuple[int, int]], float]:
    """(offset, size) of each video frame by the RIFF index, and frames per second."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index, k = float(FPS), 0, None, 12
    while k + 8 <= len(avi):
        name, size = avi[k : k + 4], struct.unpack_from("<I", avi, k + 4)[0]
        if name == b"LIST" and avi[k + 8 : k + 12] == b"movi":
            movi = k + 8
        elif name == b"LIST" and avi[k + 8 : k + 12] == b"hdrl":
            if (a := avi.find(b"avih", k, k + 8 + size)) > 0 and (us := struct.unpack_from("<I", avi, a + 8)[0]):
                fps = 1e6 / us
        elif name == b"idx1":
            index = (k + 8, size)
        k += 8 + size + size % 2
    if index is None or not movi:
        raise ValueError("no index")
    entries = [e for e in struct.iter_unpack("<4sIII", avi[index[0] : index[0] + index[1]]) if e[0][2:] in (b"dc", b"db")]
    base = movi if not entries or avi[movi + entries[0][2] : movi + entries[0][2] + 4] == entries[0][0] else 0
    return [(base + at + 8, size) for _, _, at, size in entries], fps


def decode_frame(jpeg: bytes) -> np.ndarray:
    """One lossless JPEG frame of one 8-bit component with any Huffman table, predictor 1 to 7."""
    k, table, shape = 2, {}, None
    while True:
        marker, size = jpeg[k + 1], struct.unpack_from(">H", jpeg, k + 2)[0]
        body = jpeg[k + 4 : k + 2 + size]
        if marker == 0xC4:
            code, j = 0, 17
            for length, n in enumerate(body[1:17], 1):
                for _ in range(n):
                    table[length, code] = body[j]
                    code, j = code + 1, j + 1
                code <<= 1
        elif marker == 0xC3:
            precision, height, width, parts = struct.unpack_from(">BHHB", body)
            if precision != 8 or parts != 1:
                raise ValueError("only 8-bit frames of one component")
            shape = height, width
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a lossless sequential JPEG")
        k += 2 + size
        if marker == 0xDA:
            select = body[3]
            break
    bits = np.unpackbits(np.frombuffer(jpeg[k : jpeg.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff"), np.uint8))
    out, p = np.zeros(shape, np.int32), 0
    for y in range(shape[0]):
        for x in range(shape[1]):
            code = length = 0
            while (length, code) not in table:
                code, length, p = code << 1 | int(bits[p]), length + 1, p + 1
            s = table[length, code]
            extra = int("".join(map(str, bits[p : p + s])) or "0", 2)
            p += s
            d = extra if not s or extra >> (s - 1) else extra - (1 << s) + 1
            a, b, c = (int(out[y, x - 1]) if x else 0), (int(out[y - 1, x]) if y else 0), (int(out[y - 1, x - 1]) if x and y else 0)
            pred = 128 if not x and not y else a if not y else b if not x else (a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[(0, 0, 1, 2, 3, 4, 5, 6)[select]]
            out[y, x] = (pred + d) & 0xFF
    return out.astype(np.uint8)


def decode(avi: bytes) -> tuple[np.ndarray, float]:
    """All intra frames (n, height, width) and frames per second."""
    entries, fps = _index(avi)
    step, head = FRAME * 9 // 8, len(_HEAD)
    raw = [avi[a + head : a + n - 2].replace(b"\xff\x00", b"\xff") if avi[a : a + head] == _HEAD else b"" for a, n in entries]
    if not all(len(x) == step for x in raw):
        return np.stack([decode_frame(avi[a : a + n]) for a, n in entries]), fps
    d = _DEC[_unpacked(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, step))].reshape(-1, HEIGHT, WIDTH).astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return np.cumsum(d, axis=2).astype(np.uint8), fps


def readable(avi: bytes | None) -> tuple[np.ndarray, float] | None:
    """decode(), or None for null media and for what it can't read: other codings than lossless grey frames, damaged files."""
    try:
        return decode(avi) if avi is not None else None
    except (ValueError, IndexError, KeyError, struct.error):
        return None


def cuts(frames: np.ndarray, bins: int = 16, reach: int = 6, factor: float = 2.0, least: float = 0.2) -> np.ndarray:
    """First frames of shots after the first.

    A cut is where the histogram difference to the frame before (0 to 1) is at least least and exceeds factor
    standard deviations over the mean of the differences within reach on either side.
    """
    n = len(frames)
    if n < 2:
        return np.zeros(0, np.int64)
    flat = frames.reshape(n, -1).astype(np.int64) * bins // 256
    hist = np.bincount((flat + np.arange(n)[:, None] * bins).ravel(), minlength=n * bins).reshape(n, bins)
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * flat.shape[1])
    total, square = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    k = np.arange(len(d))
    lo, hi = np.maximum(0, k - reach), np.minimum(len(d), k + reach + 1)
    m = np.maximum(1, hi - lo - 1)
    mean = (total[hi] - total[lo] - d) / m
    var = np.maximum(0, (square[hi] - square[lo] - d * d) / m - mean * mean)
    return k[(d >= least) & (d > mean + factor * np.sqrt(var))] + 1


def payload_of(text: str | None) -> tuple[int, bytes]:
    """A text's length in UTF-8 and its bytes, padded by blanks to a positive multiple of a frame."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME)


def with_media(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs with n_bytes and media, the whole text (null: empty) stored as an AVI; columns of those names give way."""

    def make():
        import pyarrow as pa

        def run(b):
            pairs = [payload_of(t) for t in b.column("text").to_pylist()]
            return [pa.array([n for n, _ in pairs], pa.int64()), pa.array([encode(p) for _, p in pairs], pa.binary())]

        return run

    return appended(docs, make, "n_bytes long, media binary", ["text"], keep, rows=500)


def with_features(media: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """A media table with what its stored bytes say: sizes, hashes and a feature string.

    Null media: nulls. Media that can't be read (the reader takes its own lossless grey frames, not the lossy colour
    frames of cameras; damaged files) have their size and hash, and nulls for the rest. Equal media, equal values;
    repeated rows stay separate rows, an empty table gives no rows.
    """

    def make():
        import pyarrow as pa

        def row(avi):
            if avi is None:
                return None, None, None, None, None, None
            if (found := readable(avi)) is None:
                return None, None, None, len(avi), hashlib.sha256(avi).hexdigest(), None
            frames = found[0]
            data, at = frames.tobytes(), [0, *cuts(frames).tolist(), len(frames)]
            feature = f"frames={len(frames)};shots={len(at) - 1};longest={int(np.diff(at).max())};sum={int(frames.sum(dtype=np.int64))};cuts={zlib.crc32(repr(at).encode())}"
            return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(avi), hashlib.sha256(avi).hexdigest(), feature

        def run(b):
            rows = [row(x.as_py()) for x in b.column("media")]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]

        return run

    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return appended(media, make, added, ["media"], keep, rows=500)


def clips(media: DataFrame, key: str) -> DataFrame:
    """Timed clip rows of a media table: key, clip, start_s, end_s, n_frames. Null or unreadable media: no rows."""
    from pyspark.sql import functions as F

    def make():
        import pyarrow as pa

        kind = pa.list_(pa.struct([("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("n_frames", pa.int32())]))

        def row(avi):
            if (found := readable(avi)) is None:
                return []
            frames, fps = found
            at = [0, *cuts(frames).tolist(), len(frames)]
            return [{"clip": k, "start_s": a / fps, "end_s": b / fps, "n_frames": b - a} for k, (a, b) in enumerate(zip(at, at[1:], strict=False))]

        return lambda b: [pa.array([row(x.as_py()) for x in b.column("media")], kind)]

    found = appended(media, make, "__clips array<struct<clip:int,start_s:double,end_s:double,n_frames:int>>", ["media"], [key], rows=500)
    return found.select(key, F.inline("__clips"))
