"""Media columns: AVI with motion JPEG. Bytes are stored in frames, read back through the RIFF index, and cut into clips.

Storing   Bytes, padded with 255 to a positive multiple of 576, become gray baseline-JPEG frames of 24 x 24 pixels: each
          byte less 128 is one quantised DCT coefficient (JPEG's stored unit), 64 in zigzag order to a block and nine
          blocks to a frame, so storing loses nothing. Frames use the standard Huffman tables, which motion-JPEG frames
          leave out, and a quantiser of ones.
Reading   The idx1 index gives the frames (a file without one has its movi list walked). Intra frames of one header are
          decoded in lockstep: one step takes the next Huffman symbol of every frame, in numpy, so the cost of a step is
          shared by thousands of frames. The inverse DCT gives pixels.
Shots     d(t) is half the sum of absolute differences of the 32-bin histograms of frames t - 1 and t, 0 to 1. A shot ends
          before t if d(t) is over FLOOR and over mean + SPREAD x deviation of up to WINDOW differences before it.
          Each shot is a clip row with its times.

Read are gray baseline frames of any size, with own or standard tables; anything else gives a row with `error` set and no
clips. Edge cases: null and empty media have the error "empty"; for storing, a null text counts as empty; equal texts give
equal media; an empty table gives an empty result; other columns are ignored. Batches hold about CHUNK frames, a longer
medium by itself, so memory grows with the longest medium only.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import prepare, text_of, worker_cache

SIDE, FRAME, FPS = 24, 576, 25
#: Frames encoded, and decoded, at once.
ENCODED, CHUNK = 512, 2048
BINS, WINDOW, FLOOR, SPREAD = 32, 12, 0.12, 3.0
# The typical luminance Huffman tables of ITU-T T.81, annex K (codes of each length, then symbols).
DC_BITS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = bytes(range(12))
AC_BITS = [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]
AC_SYMBOLS = bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
    "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
)
EOB, ZRL = 0x00, 0xF0
FAR = 63


def codes(bits: list[int], symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each of 256 symbols (length 0: none)."""
    code, at, out, size = 0, 0, np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for length, n in enumerate(bits, 1):
        for s in symbols[at : at + n]:
            out[s], size[s] = code, length
            code += 1
        at, code = at + n, code << 1
    return out, size


def lookup(bits: list[int], symbols: bytes) -> np.ndarray:
    """For 16 bits ahead: symbol x 32 + length; 0 where no code begins so."""
    table = np.zeros(1 << 16, np.int32)
    code, size = codes(bits, symbols)
    for s in symbols:
        a = int(code[s]) << (16 - int(size[s]))
        table[a : a + (1 << (16 - int(size[s])))] = s * 32 + size[s]
    return table


def zigzag() -> np.ndarray:
    """Place in a row-major block of each coefficient in zigzag order."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


def tables() -> dict:
    cache = worker_cache("avi_clips")
    if "jpeg" not in cache:
        k, x = np.arange(8)[:, None], np.arange(8)[None, :]
        basis = np.where(k == 0, np.sqrt(0.125), 0.5 * np.cos((2 * x + 1) * k * np.pi / 16))
        cache["jpeg"] = {
            "dc": codes(DC_BITS, DC_SYMBOLS), "ac": codes(AC_BITS, AC_SYMBOLS), "dc_look": lookup(DC_BITS, DC_SYMBOLS), "ac_look": lookup(AC_BITS, AC_SYMBOLS),
            "idct": np.einsum("vy,ux->vuyx", basis, basis).reshape(64, 64)[zigzag()].astype(np.float32), "headers": {},
        }
    return cache["jpeg"]


def coded(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for zeros x 4096 + value + 2048: code of zeros (under 16) and size, then the value's bits."""
    t = tables()
    if f"{kind}_all" not in t:
        v = np.arange(-2048, 2048)
        size = np.ceil(np.log2(np.abs(v) + 1.0)).astype(np.int64)
        bits = np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)
        symbol = (np.arange(16)[:, None] << 4 | np.minimum(size, 15)).ravel() if kind == "ac" else size
        size, bits = np.tile(size, len(symbol) // 4096), np.tile(bits, len(symbol) // 4096)
        code, length = t[kind]
        t[f"{kind}_all"] = (code[symbol] << size.astype(np.uint64)) | bits, length[symbol] + size
    return t[f"{kind}_all"]


def encode_scans(coefficients: np.ndarray) -> list[bytes]:
    """(frames, blocks, 64) in zigzag order -> entropy-coded data of each frame, with stuffed bytes."""
    t, (frames, blocks, _) = tables(), coefficients.shape
    c = coefficients.astype(np.int32)
    (ac_code, ac_len), (dc_bits, dc_n), (ac_bits, ac_n) = t["ac"], coded("dc"), coded("ac")
    value, length = np.zeros((frames, blocks, 65), np.uint64), np.zeros((frames, blocks, 65), np.int64)
    key = np.diff(c[:, :, 0], axis=1, prepend=0) + 2048
    value[:, :, 0], length[:, :, 0] = dc_bits[key], dc_n[key]
    there = c[:, :, 1:] != 0
    last = np.maximum.accumulate(np.where(c != 0, np.arange(64, dtype=np.int32), 0), axis=2)
    run = np.arange(63, dtype=np.int32) - last[:, :, :-1]
    key = (run & 15) << 12 | c[:, :, 1:] + 2048
    value[:, :, 1:64], length[:, :, 1:64] = ac_bits[key], ac_n[key]
    many = np.nonzero(there & (run > 15))
    for f, b, k in zip(*many):  # runs of 16 zeros and more: rare in stored text
        for _ in range(run[f, b, k] >> 4):
            value[f, b, k + 1] |= ac_code[ZRL] << np.uint64(length[f, b, k + 1])
            length[f, b, k + 1] += ac_len[ZRL]
    length[:, :, 1:64][~there] = 0
    open_end = last[:, :, -1] < 63
    value[:, :, 64], length[:, :, 64] = np.where(open_end, ac_code[EOB], 0), np.where(open_end, ac_len[EOB], 0)

    value, length = value.reshape(frames, -1), length.reshape(frames, -1)
    total = length.sum(1)
    n_bytes = (total + 7) // 8
    first = np.cumsum(n_bytes) - n_bytes
    at = (np.cumsum(length, axis=1) - length + 8 * first[:, None]).ravel()
    value, length = value.ravel(), length.ravel()
    use = length > 0
    value, length, at = value[use], length[use], at[use]
    pad = 8 * n_bytes - total  # the last byte is filled with ones
    value = np.concatenate([value, ((np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1))])
    at, length = np.concatenate([at, 8 * first + total]), np.concatenate([length, pad])
    # Each code falls on up to three words of 32 bits; codes don't overlap, so sums are unions.
    words, inside = at >> 5, (at & 31) + length
    n_words = int(n_bytes.sum()) // 4 + 4
    out = np.zeros(n_words)
    for k in range(3):
        shift = inside - 32 * (k + 1)
        part = np.where(shift > 0, value >> np.maximum(shift, 0).astype(np.uint64), value << np.minimum(np.maximum(-shift, 0), 63).astype(np.uint64))
        part = np.where(shift <= -32, 0, part & np.uint64(0xFFFFFFFF))
        keep = part > 0
        if k and not keep.any():
            break
        out += np.bincount(words[keep] + k, part[keep].astype(np.float64), n_words)
    raw = out.astype(">u4").view(np.uint8)[: int(n_bytes.sum())]
    full = np.nonzero(raw == 0xFF)[0]
    stuffed = np.insert(raw, full + 1, 0).tobytes()
    ends = np.cumsum(n_bytes)
    ends = ends + np.searchsorted(full, ends)
    return [stuffed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def header(width: int, height: int) -> bytes:
    quantiser = b"\xff\xdb" + struct.pack(">HB", 67, 0) + b"\1" * 64
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, height, width, 1) + bytes([1, 0x11, 0])
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"AVI1" + bytes(10) + quantiser + frame + b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0, 0, 63, 0])


def chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS) -> bytes:
    """RIFF AVI with one MJPG stream and an idx1 index."""
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(chunk(b"00dc", f))
        at += len(movi[-1])
    return chunk(b"RIFF", b"AVI " + chunk(b"LIST", hdrl) + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """(frames, frames a second) of the first video stream, by the idx1 index if there is one."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not AVI")
    at, movi, end, index, fps = 12, None, 0, None, 0.0
    while at + 8 <= len(data):
        kind, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            a = data.find(b"avih", at, at + 8 + n)
            if a >= 0:
                fps = 1e6 / max(1, struct.unpack_from("<I", data, a + 8)[0])
        elif kind == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi, end = at + 8, at + 8 + n
        elif kind == b"idx1":
            index = np.frombuffer(data, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("n", "<u4")]), n // 16, at + 8)
        at += 8 + n + n % 2
    if movi is None:
        raise ValueError("no movi list")
    if index is not None and len(index):
        video = index[(index["id"] == b"00dc") | (index["id"] == b"00db")]
        # Places count from the list's type or from the file's start.
        base = movi if not len(video) or data[movi + int(video["at"][0]) :][:4] in (b"00dc", b"00db") else 0
        return [data[base + a + 8 : base + a + 8 + n] for a, n in zip(video["at"].tolist(), video["n"].tolist())], fps
    frames, at = [], movi + 4
    while at + 8 <= end:
        n = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] in (b"00dc", b"00db"):
            frames.append(data[at + 8 : at + 8 + n])
        at += 8 + n + n % 2
    return frames, fps


def parse_header(frame: bytes) -> dict:
    """Markers up to the scan of a gray baseline frame."""
    t = tables()
    out = {"quant": np.ones(64, np.float32), "dc": t["dc_look"], "ac": t["ac_look"]}
    quants, looks, at = {}, {}, 2
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not JPEG")
    while True:
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("torn JPEG")
        kind, n = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + n]
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.float32)
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                bits = list(body[1:17])
                looks[body[0]] = lookup(bits, body[17 : 17 + sum(bits)])
                body = body[17 + sum(bits) :]
        elif kind == 0xC0:
            depth, out["height"], out["width"], parts = struct.unpack_from(">BHHB", body)
            if parts != 1 or depth != 8:
                raise ValueError("not gray")
            tq = body[8]
        elif 0xC1 <= kind <= 0xCF and kind != 0xC8 or kind == 0xDD and struct.unpack(">H", body[:2])[0]:
            raise ValueError("not baseline")
        at += 2 + n
        if kind == 0xDA:
            if "width" not in out:
                raise ValueError("torn JPEG")
            dc, ac = body[2] >> 4, 0x10 | body[2] & 15
            return out | {"quant": quants.get(tq, out["quant"]), "dc": looks.get(dc, out["dc"]), "ac": looks.get(ac, out["ac"]), "scan": at, "blocks": -(-out["width"] // 8) * -(-out["height"] // 8)}


def head_of(frame: bytes) -> tuple[bytes, dict]:
    known = tables()["headers"]
    at = frame.find(b"\xff\xda")
    key = frame[: at + 2 + struct.unpack_from(">H", frame, at + 2)[0]] if at >= 0 and at + 4 <= len(frame) else frame
    if key not in known:
        if len(known) > 256:
            known.clear()
        known[key] = parse_header(frame)
    return key, known[key]


def steps(look: np.ndarray, dc: bool) -> np.ndarray:
    """For 16 bits ahead: value x 2^13 + zeros before it x 2^6 + bits of code and value together; FAR in the low bits if
    they are more than 16 or no code begins so; zeros of 64 and more end the block."""
    length, symbol = look & 31, look >> 5
    size, run = symbol & 15, np.zeros_like(symbol) if dc else symbol >> 4
    total = length + size
    bits = (np.arange(1 << 16) >> np.maximum(16 - total, 0)) & ((1 << size) - 1)
    value = np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)
    if not dc:
        run = np.where(symbol == EOB, 64, run)
    return np.where((length == 0) | (total > 16), FAR, value << 13 | run << 6 | total).astype(np.int32)


def decode_scans(scans: list[bytes], head: dict) -> np.ndarray:
    """Entropy-coded data of frames of one header -> (frames, blocks, 64) quantised coefficients in zigzag order."""
    n, end = len(scans), 64 * head["blocks"]
    sizes = np.fromiter(map(len, scans), np.int64, n)
    raw = np.frombuffer(b"".join(scans), np.uint8)
    stuffed = np.nonzero((raw[:-1] == 0xFF) & (raw[1:] == 0))[0] + 1
    ends = np.cumsum(sizes)
    ends = ends - np.searchsorted(stuffed, ends)
    raw = np.concatenate([np.delete(raw, stuffed), np.full(16, 0xFF, np.uint8)])
    ahead = (raw[:-2].astype(np.int32) << 16) | (raw[1:-1].astype(np.int32) << 8) | raw[2:]
    if "steps" not in head:
        head["steps"] = np.concatenate([steps(head["dc"], True), steps(head["ac"], False)])
    table, look = head["steps"], np.concatenate([head["dc"], head["ac"]])
    out = np.zeros((end + 80) * n, np.int16)  # by place, then by frame: frames go on at the same place mostly
    lane, last = np.arange(n), np.zeros(n, np.int64)
    bit, place = 8 * np.concatenate([[0], ends[:-1]]), np.zeros(n, np.int64)
    while len(lane):
        kind = np.where(place & 63, 1 << 16, 0)
        step = table[((ahead[bit >> 3] >> (8 - (bit & 7))) & 0xFFFF) + kind]
        run, total, value = (step >> 6) & 127, step & 63, step >> 13
        far = np.nonzero(total == FAR)[0]
        if len(far):
            at, v = bit[far] >> 3, np.zeros(len(far), np.int64)
            for k in range(5):
                v = v << 8 | raw[at + k]
            v = (v << (bit[far] & 7)) & ((1 << 40) - 1)
            hit = look[(v >> 24) + kind[far]]
            length, symbol = hit & 31, hit >> 5
            if not length.all():
                raise ValueError("torn scan")
            size = symbol & 15
            bits = (v >> (40 - length - size)) & ((1 << size) - 1)
            value[far] = np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)
            run[far], total[far] = np.where(kind[far] > 0, symbol >> 4, 0), length + size
        bit += total
        place += run
        over = np.nonzero(run >= 64)[0]
        if len(over):
            place[over] = (place[over] - 64) | 63
        out[place * n + lane] = value
        place += 1
        if place.max() >= end or bit.max() > 8 * ends[-1]:
            if (bit > 8 * ends[lane]).any():
                raise ValueError("torn scan")
            go = place < end
            last[lane[~go]] = bit[~go]
            lane, bit, place = lane[go], bit[go], place[go]
    if (8 * ends - last >= 8).any():
        raise ValueError("torn scan")
    out = np.ascontiguousarray(out[: end * n].reshape(end, n).T).reshape(n, -1, 64)
    out[:, :, 0] = np.cumsum(out[:, :, 0], axis=1)
    return out


def histograms(coefficients: np.ndarray, head: dict) -> np.ndarray:
    """(frames, BINS) shares of pixel values, edge blocks whole."""
    n = len(coefficients)
    pixels = (coefficients.astype(np.float32) * head["quant"]).reshape(-1, 64) @ tables()["idct"]
    pixels += 128.5
    bins = np.clip(pixels, 0, 255, out=pixels).astype(np.uint8).reshape(n, -1) // (256 // BINS)
    flat = np.bincount((bins + BINS * np.arange(n, dtype=np.int32)[:, None]).ravel(), minlength=n * BINS)
    return flat.reshape(n, BINS) / bins.shape[1]


def shot_starts(hist: np.ndarray) -> tuple[list[int], np.ndarray]:
    """First frames of shots, and the differences."""
    if len(hist) < 2:
        return [0], np.zeros(0)
    d = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    sums, squares = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    to = np.arange(len(d))
    since = np.maximum(0, to - WINDOW)
    n = np.maximum(1, to - since)
    mean = (sums[to] - sums[since]) / n
    deviation = np.sqrt(np.maximum(0, (squares[to] - squares[since]) / n - mean**2))
    cut = (d > FLOOR) & (d > mean + SPREAD * deviation) & (to > 0)
    return [0, *(np.nonzero(cut)[0] + 1).tolist()], d


def decoded(media: list[bytes | None]) -> Iterator[tuple]:
    """For each medium, in order: (coefficients, histograms, fps, error). Frames of many media are decoded together."""
    opened, found = [], []
    for m in media:
        try:
            if not m:
                raise ValueError("empty")
            frames, fps = read_avi(m)
            if not frames:
                raise ValueError("no frames")
            heads = [head_of(f) for f in frames]
            if any(k != heads[0][0] for k, _ in heads):
                raise ValueError("mixed headers")
            opened.append((heads[0][0], heads[0][1], frames, fps, ""))
        except (ValueError, struct.error, IndexError) as e:
            opened.append((None, None, [], 0.0, str(e) or "torn"))
    groups: dict[bytes, list[int]] = {}
    for i, o in enumerate(opened):
        if o[0] is not None:
            groups.setdefault(o[0], []).append(i)
    found = [None] * len(media)

    def scans(i):
        at = opened[i][1]["scan"]
        return [f[at : f.rfind(b"\xff\xd9")] for f in opened[i][2]]

    for own in groups.values():
        head = opened[own[0]][1]
        part: list[int] = []
        held = 0
        for i in [*own, None]:
            if part and (i is None or held + len(opened[i][2]) > CHUNK):
                try:
                    data = decode_scans([s for j in part for s in scans(j)], head)
                    hist = np.concatenate([histograms(data[k : k + CHUNK], head) for k in range(0, len(data), CHUNK)])
                    at = 0
                    for j in part:
                        n = len(opened[j][2])
                        found[j] = data[at : at + n], hist[at : at + n], opened[j][3], ""
                        at += n
                except ValueError as e:
                    if len(part) == 1:
                        found[part[0]] = None, None, 0.0, str(e)
                    else:
                        for j in part:  # one torn medium doesn't spoil the others
                            found[j] = next(decoded([media[j]]))
                part, held = [], 0
            if i is not None:
                part.append(i)
                held += len(opened[i][2])
    for o, f in zip(opened, found):
        yield f if f is not None else (None, None, 0.0, o[4])


def store(payload: bytes) -> bytes:
    """Bytes -> AVI; padded to whole frames."""
    return store_all([payload])[0]


def store_all(payloads: list[bytes]) -> list[bytes]:
    padded = [p + b"\xff" * (max(FRAME, -(-len(p) // FRAME) * FRAME) - len(p)) for p in payloads]
    flat = np.frombuffer(b"".join(padded), np.uint8).astype(np.int16).reshape(-1, 9, 64) - 128
    scans = [s for i in range(0, len(flat), ENCODED) for s in encode_scans(flat[i : i + ENCODED])]
    head, out, at = header(SIDE, SIDE), [], 0
    for p in padded:
        n = len(p) // FRAME
        out.append(write_avi([head + s + b"\xff\xd9" for s in scans[at : at + n]], SIDE, SIDE))
        at += n
    return out


def parts(sizes: list[int], most: int) -> Iterator[slice]:
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def media_column(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the text of each row of docs as AVI."""
    prepare(spark)

    def run(batches):
        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for s in parts([len(t) for t in texts], 4 * ENCODED * FRAME):
                own = texts[s]
                yield pa.RecordBatch.from_arrays([batch.column(0)[s.start : s.stop], pa.array([len(t) for t in own], pa.int64()), pa.array(store_all(own), pa.binary())], names=["doc_id", "n_bytes", "media"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def clips(spark: SparkSession, media: DataFrame) -> DataFrame:
    """media(doc_id, media) -> (doc_id, clip, first_frame, frames, start_s, end_s, error): a row for each shot."""
    prepare(spark)

    def run(batches):
        for batch in batches:
            ids, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s in parts([len(m or b"") for m in data], CHUNK * FRAME):
                rows = []
                for d, (_, hist, fps, error) in zip(ids[s], decoded(data[s])):
                    if error:
                        rows.append((d, None, None, None, None, None, error))
                        continue
                    starts, _ = shot_starts(hist)
                    rows += [(d, i, a, b - a, a / fps, b / fps, None) for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(hist)]))]
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "clip", "first_frame", "frames", "start_s", "end_s", "error"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip int, first_frame long, frames long, start_s double, end_s double, error string")


def media_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Stores each text as AVI, reads the stored bytes back and digests both:
    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)."""

    def run(batches):
        for batch in batches:
            ids, sizes, data = (c.to_pylist() for c in batch.columns)
            for s in parts([len(m) for m in data], CHUNK * FRAME):
                rows = []
                for d, n, m, (coefficients, hist, fps, error) in zip(ids[s], sizes[s], data[s], decoded(data[s])):
                    if error:
                        raise ValueError(f"stored medium can't be read: {error}")
                    payload = (coefficients + 128).astype(np.uint8).tobytes()
                    starts, diff = shot_starts(hist)
                    feature = f"frames={len(hist)};fps={fps:g};clips={','.join(map(str, starts))};difference={diff.mean() if len(diff) else 0:.4f}"
                    rows.append((d, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media_column(spark, docs).mapInArrow(run, schema)
