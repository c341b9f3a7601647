"""FLAC media columns: encode, decode with all checks, and PCM blocks with seekable sample offsets.

All frames of a block of rows are worked on at once: predictors, Rice codes and checksums are numpy
operations across frames. Streams made here have one 8-bit channel in blocks of 576 samples, and a seek point
for every frame, so a reader can start at any block. Those of other encoders are read frame by frame.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factorloom.llm.common import Scratch, id_and_text, rows_to_batch, text_blocks

BLOCK = 576
RATE = 8000
FRAMES_AT_ONCE = 1024
MOST_RICE = 14
# Fixed values of the format: sync and fixed blocking; 576 samples at 8 kHz; mono of 8 bits.
HEAD = np.array([0xFF, 0xF8, 0x24, 0x02], np.uint8)
# Fixed values of the format: subframe types, before the shift by one bit.
CONSTANT, VERBATIM, FIXED, LPC = 0x00, 0x01, 0x08, 0x20


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for value in range(256):
        value <<= bits - 8
        for _ in range(8):
            value = value << 1 ^ (poly if value >> (bits - 1) else 0)
            value &= (1 << bits) - 1
        out.append(value)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of the first lengths[i] bytes of each row."""
    crc = np.zeros(len(rows), np.uint16)
    for j in range(int(lengths.max(initial=0))):
        crc = np.where(j < lengths, _CRC8[crc ^ rows[:, j]], crc)
    return crc.astype(np.uint8)


def crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of the bytes data[starts[i] : starts[i] + lengths[i]] of each frame."""
    order = np.argsort(-lengths, kind="stable")
    at, sizes = starts[order], lengths[order]
    crc = np.zeros(len(order), np.uint16)
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # frames longer than j come first
    for j in range(longest):
        n = alive[j]
        now = crc[:n]
        crc[:n] = _CRC16[(now >> 8) ^ data[at[:n] + j]] ^ (now << 8)
    out = np.empty_like(crc)
    out[order] = crc
    return out


def coded_numbers(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's UTF-8 manner: rows of up to 5 bytes, and how many count."""
    rows, sizes = np.zeros((len(numbers), 5), np.uint8), np.ones(len(numbers), np.int64)
    for size, limit in ((2, 1 << 7), (3, 1 << 11), (4, 1 << 16), (5, 1 << 21)):
        sizes[numbers >= limit] = size
    small = sizes == 1
    rows[small, 0] = numbers[small]
    for size in range(2, 6):
        at = np.flatnonzero(sizes == size)
        if len(at):
            n = numbers[at]
            rows[at, 0] = (0xFF << (8 - size) & 0xFF) | (n >> 6 * (size - 1))
            for j in range(1, size):
                rows[at, j] = 0x80 | (n >> 6 * (size - 1 - j) & 0x3F)
    return rows, sizes


def headers(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame headers with their CRC-8, as rows, and their lengths."""
    coded, sizes = coded_numbers(numbers)
    rows = np.zeros((len(numbers), 10), np.uint8)
    rows[:, :4] = HEAD
    rows[:, 4:9] = coded
    lengths = sizes + 4
    rows[np.arange(len(rows)), lengths] = crc8(rows, lengths)
    return rows, lengths + 1


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of int32 rows of BLOCK samples: all bytes, and each frame's first byte and the end."""
    count = len(samples)
    residuals = [samples]
    for _ in range(4):
        residuals.append(np.diff(residuals[-1], axis=1))
    sums = np.stack([np.abs(r[:, r.shape[1] - (BLOCK - 4) :]).sum(axis=1, dtype=np.int64) for r in residuals], axis=1)
    orders = np.argmin(sums, axis=1)
    kinds = FIXED + orders
    rice, bits = np.zeros(count, np.int64), np.zeros(count, np.int64)
    coded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for order in range(5):
        at = np.flatnonzero(orders == order)
        if not len(at):
            continue
        r = residuals[order][at]
        u = (r << 1) ^ (r >> 31)
        totals = u.sum(axis=1, dtype=np.int64)
        guess = np.clip(np.floor(np.log2(np.maximum(totals * 0.6931 / r.shape[1], 1))).astype(np.int64), 0, MOST_RICE - 1)
        costs = [(u >> (guess + d)[:, None]).sum(axis=1, dtype=np.int64) + r.shape[1] * (1 + guess + d) for d in (0, 1)]
        more = costs[1] < costs[0]
        rice[at], bits[at] = guess + more, np.where(more, costs[1], costs[0]) + 10 + 8 * order
        coded[order] = (at, u)
    still = (samples == samples[:, :1]).all(axis=1)
    kinds[bits >= 8 * BLOCK] = VERBATIM
    kinds[still] = CONSTANT
    bits[kinds == VERBATIM], bits[kinds == CONSTANT] = 8 * BLOCK, 8
    head, head_sizes = headers(numbers)
    sizes = head_sizes + 1 + (bits + 7) // 8 + 2
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flags = np.zeros(8 * int(starts[-1]), np.uint8)
    for order, (at, u) in coded.items():
        for k in np.unique(rice[at]):
            here = np.flatnonzero((rice[at] == k) & (kinds[at] == FIXED + order))
            if not len(here):
                continue
            rows, codes = at[here], u[here]
            first = 8 * (starts[rows] + head_sizes[rows] + 1 + order)
            for j in range(4):
                flags[first + 6 + j] = k >> (3 - j) & 1
            quotients = codes >> k
            spans = np.cumsum(quotients + (1 + k), axis=1)
            ones = (first + 10)[:, None] + spans - (1 + k)
            flags[ones] = 1
            for j in range(k):
                flags[ones + (1 + j)] = codes >> (k - 1 - j) & 1
    data = np.packbits(flags)
    for j in range(10):
        at = np.flatnonzero(j < head_sizes)
        data[starts[at] + j] = head[at, j]
    bodies = starts[:-1] + head_sizes
    data[bodies] = kinds << 1
    as_bytes = samples.astype(np.int8).view(np.uint8)
    at = np.flatnonzero(kinds == CONSTANT)
    data[bodies[at] + 1] = as_bytes[at, 0]
    at = np.flatnonzero(kinds == VERBATIM)
    if len(at):
        data[(bodies[at] + 1)[:, None] + np.arange(BLOCK)] = as_bytes[at]
    for order in range(1, 5):
        at = np.flatnonzero(kinds == FIXED + order)
        for j in range(order):
            data[bodies[at] + 1 + j] = as_bytes[at, j]
    check = crc16(data, starts[:-1], sizes - 2)
    data[starts[1:] - 2], data[starts[1:] - 1] = check >> 8, check & 0xFF
    return data, starts


class Damaged(ValueError):
    """A stream whose marks, checksums or lengths are wrong."""


def decode_frames(data: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Rows of BLOCK samples of the frames data[starts[i]:starts[i+1]]; headers and checksums are verified."""
    count = len(numbers)
    head, head_sizes = headers(numbers)
    for j in range(10):
        at = np.flatnonzero(j < head_sizes)
        if (data[starts[at] + j] != head[at, j]).any():
            raise Damaged("frame header")
    sizes = np.diff(starts)
    check = crc16(data, starts[:-1], sizes - 2)
    if ((data[starts[1:] - 2].astype(np.uint16) << 8 | data[starts[1:] - 1]) != check).any():
        raise Damaged("frame checksum")
    bodies = starts[:-1] + head_sizes
    kinds = data[bodies] >> 1
    out = np.empty((count, BLOCK), np.int32)
    signed = data.view(np.int8)
    at = np.flatnonzero(kinds == CONSTANT)
    out[at] = signed[bodies[at] + 1][:, None]
    at = np.flatnonzero(kinds == VERBATIM)
    if len(at):
        out[at] = signed[(bodies[at] + 1)[:, None] + np.arange(BLOCK)]
    rest = np.flatnonzero((kinds >= FIXED) & (kinds <= FIXED + 4) | (kinds >= LPC))
    if len(rest) + (kinds <= VERBATIM).sum() != count:
        raise Damaged("subframe type")
    if not len(rest):
        return out
    flags = np.unpackbits(data)
    before = np.cumsum(flags, dtype=np.int32)
    before -= flags
    ones = np.append(np.flatnonzero(flags), len(flags)).astype(np.int64)
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int64)
    windows = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
    for kind in np.unique(kinds[rest]):
        rows = np.flatnonzero(kinds == kind)
        linear = kind >= LPC
        order = int(kind - LPC + 1 if linear else kind - FIXED)
        first = 8 * (bodies[rows] + 1 + order)
        warm = signed[(bodies[rows] + 1)[:, None] + np.arange(order)].astype(np.int32)
        if linear:
            taps, shift, first = _coefficients(flags, first, order)
        ends = 8 * starts[rows + 1]
        if flags[first[:, None] + np.arange(6)].any():
            raise Damaged("residual layout")  # one partition with 4-bit parameters is all that is read
        k = flags[first[:, None] + 6 + np.arange(4)] @ np.array([8, 4, 2, 1])
        if (k == 15).any():
            raise Damaged("escaped residual")
        n = BLOCK - order
        marks = np.empty((n, len(rows)), np.int64)
        froms = np.empty((n, len(rows)), np.int64)
        p = first + 10
        for i in range(n):
            froms[i] = p
            q = ones[before[p]]
            marks[i] = q
            p = np.minimum(q + 1 + k, ends - 1)
        if (marks + k >= ends).any():
            raise Damaged("residual runs past its frame")
        after = marks + 1
        low = windows[after >> 3] >> (32 - (after & 7) - k) & ((1 << k) - 1)
        u = ((marks - froms) << k | low).T
        r = (u >> 1 ^ -(u & 1)).astype(np.int32)
        out[rows] = _restore_linear(warm, r, taps, shift) if linear else _restore_fixed(warm, r)
    return out


def _coefficients(flags: np.ndarray, first: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predictor coefficients, shifts, and the bit after them, of frames with linear prediction."""

    def number(at: np.ndarray, width: int) -> np.ndarray:
        return flags[at[:, None] + np.arange(width)].astype(np.int64) @ (1 << np.arange(width)[::-1])

    precision = number(first, 4) + 1
    shift = number(first + 4, 5)
    taps = np.zeros((len(first), order), np.int64)
    for width in np.unique(precision):
        at = np.flatnonzero(precision == width)
        for j in range(order):
            value = number(first[at] + 9 + j * width, int(width))
            taps[at, j] = np.where(value >> (width - 1), value - (1 << width), value)
    return taps, shift, first + 9 + order * precision


def _restore_fixed(warm: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Undo as many differences as there are warm-up samples."""
    order, kind = warm.shape[1], r.dtype
    firsts = []
    level = warm
    for _ in range(order):
        firsts.append(level[:, :1])
        level = np.diff(level, axis=1)
    for first in reversed(firsts):
        r = np.cumsum(np.hstack([first, r]), axis=1, dtype=kind)
    return r


def _restore_linear(warm: np.ndarray, r: np.ndarray, taps: np.ndarray, shift: np.ndarray) -> np.ndarray:
    order = warm.shape[1]
    block = order + r.shape[1]
    out = np.empty((len(r), block), np.int64)
    out[:, :order] = warm
    for i in range(order, block):
        out[:, i] = r[:, i - order] + ((out[:, i - order : i][:, ::-1] * taps).sum(axis=1) >> shift)
    return out.astype(r.dtype)


def encode_linear_frame(samples: np.ndarray, number: int, taps: list[int], shift: int, rice: int, precision: int = 12) -> np.ndarray:
    """One frame with the given linear predictor, for streams that other encoders would write."""
    order, values = len(taps), samples.astype(np.int64)
    guess = np.array([int((values[i - order : i][::-1] * taps).sum()) >> shift for i in range(order, BLOCK)])
    r = values[order:] - guess
    text = "".join(f"{int(v) & 0xFF:08b}" for v in values[:order]) + f"{precision - 1:04b}{shift:05b}" + "".join(f"{t & (1 << precision) - 1:0{precision}b}" for t in taps) + f"000000{rice:04b}"
    for v in r:
        u = int(v) << 1 if v >= 0 else (-int(v) << 1) - 1
        text += "0" * (u >> rice) + "1" + (f"{u & (1 << rice) - 1:0{rice}b}" if rice else "")
    head, size = headers(np.array([number]))
    body = np.packbits(np.array([*map(int, text)], np.uint8))
    data = np.concatenate([head[0, : size[0]], np.array([(LPC + order - 1) << 1], np.uint8), body, np.zeros(2, np.uint8)])
    check = int(crc16(data, np.array([0]), np.array([len(data) - 2]))[0])
    data[-2:] = check >> 8, check & 0xFF
    return data


def _metadata(pcm: bytes, sizes: np.ndarray) -> bytes:
    """The mark, STREAMINFO and SEEKTABLE of a stream whose frames have the given sizes."""
    samples, frames = len(pcm), len(sizes)
    packed = RATE << 44 | 0 << 41 | 7 << 36 | samples
    info = BLOCK.to_bytes(2) * 2 + int(sizes.min()).to_bytes(3) + int(sizes.max()).to_bytes(3) + packed.to_bytes(8) + hashlib.md5(pcm, usedforsecurity=False).digest()
    points = np.zeros(frames, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]))
    points["sample"], points["offset"], points["count"] = np.arange(frames) * BLOCK, np.cumsum(sizes) - sizes, BLOCK
    table = points.tobytes()
    return b"fLaC" + (0).to_bytes(1) + len(info).to_bytes(3) + info + (0x83).to_bytes(1) + len(table).to_bytes(3) + table


#: A SEEKTABLE block's length has 24 bits; longer streams are read by scanning.
MOST_POINTS = ((1 << 24) - 1) // 18


def payload_of(data: bytes) -> bytes:
    """The bytes and 255s up to a positive multiple of BLOCK."""
    return data + b"\xff" * ((-len(data)) % BLOCK if data else BLOCK)


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload, whose bytes are the samples plus 128."""
    counts = np.array([len(p) // BLOCK for p in payloads])
    numbers = np.concatenate([np.arange(c) for c in counts]) if len(counts) else np.empty(0, np.int64)
    whole = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    pieces, sizes = [], []
    for at in range(0, len(whole), FRAMES_AT_ONCE):
        data, starts = encode_frames(whole[at : at + FRAMES_AT_ONCE].astype(np.int32) - 128, numbers[at : at + FRAMES_AT_ONCE])
        pieces.append(data.tobytes())
        sizes.append(np.diff(starts))
    frames, sizes = b"".join(pieces), np.concatenate(sizes) if sizes else np.empty(0, np.int64)
    ends, out, first, byte = np.cumsum(sizes), [], 0, 0
    for payload, count in zip(payloads, counts, strict=True):
        last = int(ends[first + count - 1])
        pcm = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        if count > MOST_POINTS:
            raise ValueError("stream too long for its seek table; split it")
        out.append(_metadata(pcm, sizes[first : first + count]) + frames[byte:last])
        first, byte = first + int(count), last
    return out


def read_metadata(stream: bytes) -> tuple[int, bytes, np.ndarray | None, int]:
    """Total samples, MD5 of the PCM bytes, frame offsets by the seek table or None, and the first frame's place."""
    if stream[:4] != b"fLaC":
        raise Damaged("not a stream")
    at, total, digest, offsets = 4, 0, b"", None
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4])
        body = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if kind & 0x7F == 0:
            packed = int.from_bytes(body[10:18])
            total, digest = packed & (1 << 36) - 1, body[18:34]
            if body[:4] != BLOCK.to_bytes(2) * 2 or packed >> 36 & 0x1F != 7 or packed >> 41 & 7:
                raise Damaged("only mono of 8 bits in blocks of 576 is read")
        elif kind & 0x7F == 3:
            points = np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]))
            if len(points) * BLOCK == total and (points["sample"] == np.arange(len(points)) * BLOCK).all():
                offsets = points["offset"].astype(np.int64)
        if kind & 0x80:
            return total, digest, offsets, at


def scan_frames(stream: bytes, first: int, frames: int) -> np.ndarray:
    """Frame offsets of a stream without a full seek table: each next header whose frame checksum holds."""
    data, at, out = np.frombuffer(stream, np.uint8), first, []
    for number in range(frames):
        out.append(at - first)
        if number + 1 == frames:
            break
        head, size = headers(np.array([number + 1]))
        mark, nxt = head[0, : size[0]].tobytes(), at
        while True:
            nxt = stream.find(mark, nxt + 1)
            if nxt < 0:
                raise Damaged("frame not found")
            if int(crc16(data, np.array([at]), np.array([nxt - at - 2]))[0]) == int.from_bytes(stream[nxt - 2 : nxt]):
                break
        at = nxt
    return np.array(out, np.int64)


def decode_many(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream; marks, lengths, frame checksums and the MD5 of the samples are verified."""
    known, datas, starts, numbers = [], [], [], []
    base = 0
    for stream in streams:
        total, digest, offsets, first = read_metadata(stream)
        if total % BLOCK:
            raise Damaged("length")
        if offsets is None:
            offsets = scan_frames(stream, first, total // BLOCK)
        known.append((total, digest))
        datas.append(stream[first:])
        starts.append(offsets + base)
        numbers.append(np.arange(len(offsets)))
        base += len(stream) - first
    if not streams:
        return []
    data = np.frombuffer(b"".join(datas), np.uint8)
    edges, order = np.append(np.concatenate(starts), base), np.concatenate(numbers)
    parts = []
    for at in range(0, len(order), FRAMES_AT_ONCE):
        bounds = edges[at : at + FRAMES_AT_ONCE + 1]
        block = data[bounds[0] : bounds[-1]]
        parts.append((decode_frames(block, bounds - bounds[0], order[at : at + FRAMES_AT_ONCE]) + 128).astype(np.uint8))
    whole, out, at = np.concatenate(parts).ravel() if parts else np.empty(0, np.uint8), [], 0
    for total, digest in known:
        payload = whole[at : at + total]
        if hashlib.md5((payload ^ 0x80).tobytes(), usedforsecurity=False).digest() != digest:
            raise Damaged("digest of the samples")
        out.append(payload.tobytes())
        at += total
    return out


# --- streams of other encoders, frame by frame ---


@dataclass
class Pcm:
    """What STREAMINFO says of a stream: total 0 and a digest of zeros mean unknown."""

    rate: int
    channels: int
    bits: int
    total: int
    digest: bytes
    first: int  # the first frame's place
    points: list[tuple[int, int]]  # samples and offsets of the seek table


def stream_info(stream: bytes) -> Pcm:
    if stream[:4] != b"fLaC":
        raise Damaged("not a stream")
    at, out, points = 4, None, []
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4])
        body = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if kind & 0x7F == 0:
            packed = int.from_bytes(body[10:18])
            out = Pcm(packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, body[18:34], 0, points)
        elif kind & 0x7F == 3:
            table = np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]))
            points += [(int(p["sample"]), int(p["offset"])) for p in table if p["count"]]
        if kind & 0x80:
            if out is None:
                raise Damaged("no stream information")
            out.first = at
            return out


class CutShort(Damaged):
    """The bytes end before the frame does."""


class Bits:
    """A reader of one frame's bits."""

    def __init__(self, data: np.ndarray):
        self.flags = np.unpackbits(data)
        self.ones, self.at = np.flatnonzero(self.flags), 0

    def number(self, width: int, negative: bool = False) -> int:
        if self.at + width > len(self.flags):
            raise CutShort("frame cut short")
        value = int("".join(map(str, self.flags[self.at : self.at + width].tolist())) or "0", 2)
        self.at += width
        return value - (1 << width) if negative and width and value >> (width - 1) else value

    def zeros(self) -> int:
        """The length of a run of zeros that a one ends."""
        k = int(np.searchsorted(self.ones, self.at))
        if k == len(self.ones):
            raise CutShort("frame cut short")
        count = int(self.ones[k]) - self.at
        self.at += count + 1
        return count


# Fixed values of the format: block sizes and sample sizes of header codes; 0 is read elsewhere.
_BLOCKS = (0, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768)
_SIZES = (0, 8, 12, 0, 16, 20, 24, 32)
#: Bytes of a sample that nearly all frames stay within.
_USUAL_SAMPLE = 4


def read_frame(stream: bytes, at: int, info: Pcm) -> tuple[np.ndarray, int, int]:
    """(samples by channel, first sample's number or the frame's, next frame's place) of the frame at a place; both checksums are verified.

    The number is that of a sample if the stream's blocks vary, else the frame's times its block size.
    """
    if at + 6 > len(stream) or int.from_bytes(stream[at : at + 2]) >> 1 != 0x7FFC:
        raise Damaged("frame header")
    varying, code, rate, layout, width = stream[at + 1] & 1, stream[at + 2] >> 4, stream[at + 2] & 15, stream[at + 3] >> 4, stream[at + 3] >> 1 & 7
    lead = next((k for k in range(8) if not stream[at + 4] >> (7 - k) & 1), 8)
    extra = max(lead - 1, 0)
    if lead in (1, 8) or layout > 10 or width == 3 or code == 0:
        raise Damaged("frame header")
    number = stream[at + 4] & (0x7F >> lead)
    for b in stream[at + 5 : at + 5 + extra]:
        number = number << 6 | b & 0x3F
    end = at + 5 + extra
    block = _BLOCKS[code]
    if code in (6, 7):
        block = int.from_bytes(stream[end : end + code - 5]) + 1
        end += code - 5
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    head = np.frombuffer(stream[at : end + 1], np.uint8)
    if end >= len(stream) or int(crc8(head[None, :-1], np.array([len(head) - 1]))[0]) != head[-1]:
        raise Damaged("frame header")
    bits = _SIZES[width] or info.bits
    channels = layout + 1 if layout < 8 else 2
    most = channels * (block * _USUAL_SAMPLE + 64)
    side = {8: 1, 9: 0, 10: 1}.get(layout)
    while True:  # a frame has no stated size, and runs of zeros may be long
        reader = Bits(np.frombuffer(stream[end + 1 : end + 1 + most], np.uint8))
        try:
            rows = np.stack([_subframe(reader, block, bits + (c == side)) for c in range(channels)])
            break
        except CutShort:
            if end + 1 + most >= len(stream):
                raise
            most *= 4
    if layout == 8:
        rows[1] = rows[0] - rows[1]
    elif layout == 9:
        rows[0] += rows[1]
    elif layout == 10:
        middle = rows[0] << 1 | rows[1] & 1
        rows = np.stack([(middle + rows[1]) >> 1, (middle - rows[1]) >> 1])
    after = end + 1 + (reader.at + 7) // 8
    frame = np.frombuffer(stream[at:after], np.uint8)
    if after + 2 > len(stream) or int(crc16(frame, np.array([0]), np.array([len(frame)]))[0]) != int.from_bytes(stream[after : after + 2]):
        raise Damaged("frame checksum")
    return rows, number if varying else number * block, after + 2


def _subframe(reader: Bits, block: int, bits: int) -> np.ndarray:
    if reader.number(1):
        raise Damaged("subframe")
    kind = reader.number(6)
    wasted = reader.zeros() + 1 if reader.number(1) else 0
    bits -= wasted
    if kind == CONSTANT:
        out = np.full(block, reader.number(bits, True), np.int64)
    elif kind == VERBATIM:
        out = np.array([reader.number(bits, True) for _ in range(block)], np.int64)
    elif FIXED <= kind <= FIXED + 4 or kind >= LPC:
        order = kind - FIXED if kind < LPC else kind - LPC + 1
        if order > block:
            raise Damaged("predictor order")
        warm = np.array([[reader.number(bits, True) for _ in range(order)]], np.int64)
        if kind < LPC:
            out = _restore_fixed(warm, _residual(reader, block, order)[None, :])[0]
        else:
            precision, shift = reader.number(4) + 1, reader.number(5, True)
            if precision == 16 or shift < 0:
                raise Damaged("predictor")
            taps = np.array([[reader.number(precision, True) for _ in range(order)]], np.int64)
            out = _restore_linear(warm, _residual(reader, block, order)[None, :], taps, np.array([shift]))[0]
    else:
        raise Damaged("subframe type")
    return out.astype(np.int64) << wasted


def _residual(reader: Bits, block: int, order: int) -> np.ndarray:
    """Rice codes in 2 ** k partitions, each with a parameter of 4 or 5 bits, or plain numbers after the escape."""
    method, parts = reader.number(2), 1 << reader.number(4)
    if method > 1 or block % parts or block // parts < order:
        raise Damaged("residual layout")
    width, out = 4 + method, []
    for p in range(parts):
        count, k = block // parts - (order if p == 0 else 0), reader.number(width)
        if k == (1 << width) - 1:
            plain = reader.number(5)
            out += [reader.number(plain, True) for _ in range(count)]
            continue
        for _ in range(count):
            u = reader.zeros() << k
            u |= reader.number(k)
            out.append(u >> 1 ^ -(u & 1))
    return np.array(out, np.int64)


def pcm_bytes(rows: np.ndarray, bits: int) -> bytes:
    """Interleaved signed samples, little-endian, in whole bytes: what the stream's digest is taken of."""
    size = (bits + 7) // 8
    return np.ascontiguousarray(rows.T).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def decode_blocks(stream: bytes, start: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(sample offset, samples by channel) of each frame from the last seek point at or before `start`.

    Read from the start, length and digest of the samples are verified as well, where the stream states them.
    """
    info = stream_info(stream)
    sample, offset = max(((s, o) for s, o in info.points if s <= start), default=(0, 0))
    at, seen, digest = info.first + offset, sample, hashlib.md5(usedforsecurity=False)
    while at < len(stream):
        rows, _, at = read_frame(stream, at, info)
        yield seen, rows
        seen += rows.shape[1]
        if not sample:
            digest.update(pcm_bytes(rows, info.bits))
    if info.total and seen != info.total:
        raise Damaged("length")
    if not sample and any(info.digest) and digest.digest() != info.digest:
        raise Damaged("digest of the samples")


def is_own(stream: bytes) -> bool:
    """Whether encode_many() could have made the stream: then all its frames are decoded at once."""
    try:
        read_metadata(stream)
    except Damaged:
        return False
    return True


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every row's text as a FLAC stream; null and empty texts are one padded block."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches, size=1 << 20):
            yield rows_to_batch(list(zip(ids, map(len, texts), encode_many([payload_of(t) for t in texts]), strict=True)), schema)

    return id_and_text(docs, id_col, text_col, binary=True).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(table: DataFrame, frames: int = 64) -> DataFrame:
    """(doc_id, sample_offset, samples, channels, bits, rate, pcm) of table(doc_id, media), in blocks of whole frames.

    sample_offset is the first sample of a block, so a reader finds any sample by doc_id and offset. Blocks of
    own streams are the bytes they were made of; those of others are interleaved samples, little-endian. A damaged
    stream raises Damaged; null media give no blocks.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("sample_offset", "samples", "channels", "bits", "rate")), ("pcm", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, streams in text_blocks(batches, size=1 << 20):
            own = [k for k, x in enumerate(streams) if is_own(x)]
            payloads = dict(zip(own, decode_many([streams[k] for k in own]), strict=True))
            step = frames * BLOCK
            for k, i in enumerate(ids):
                if k in payloads:
                    payload = payloads[k]
                    yield rows_to_batch([(i, at, len(payload[at : at + step]), 1, 8, RATE, payload[at : at + step]) for at in range(0, len(payload), step)], schema)
                    continue
                info, held = stream_info(streams[k]), []
                for offset, rows in decode_blocks(streams[k]):
                    held.append((offset, rows))
                    if len(held) == frames:
                        yield rows_to_batch([_block_row(i, held, info)], schema)
                        held = []
                if held:
                    yield rows_to_batch([_block_row(i, held, info)], schema)

    return table.where("media is not null").select("doc_id", "media").mapInArrow(run, "doc_id long, sample_offset long, samples long, channels long, bits long, rate long, pcm binary")


def _block_row(doc_id: int, held: list[tuple[int, np.ndarray]], info: Pcm) -> tuple:
    rows = np.concatenate([r for _, r in held], axis=1)
    return doc_id, held[0][0], rows.shape[1], info.channels, info.bits, info.rate, pcm_bytes(rows, info.bits)


def describe(payload: bytes) -> str:
    """Energy, mean, zero crossings and peak of the samples, as whole numbers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"samples={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings};peak={int(np.abs(x).max())}"


def digests(table: DataFrame) -> DataFrame:
    """Read table(doc_id, n_bytes, media) back and describe it.

    One row for every row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature. A damaged stream raises Damaged.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = dict(enumerate(batch.column(1).to_pylist()))
            at = 0
            for ids, streams in text_blocks(iter([batch.select(["doc_id", "media"])]), size=1 << 20):
                rows = []
                for i, stream, payload in zip(ids, streams, decode_many(streams), strict=True):
                    rows.append((i, sizes[at], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), describe(payload)))
                    at += 1
                yield rows_to_batch(rows, schema)

    return table.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8(docs: DataFrame) -> DataFrame:
    """The contract's digests of every text's FLAC form, stored as a table and read back.

    One row for every row; null and empty texts are one padded block; repeated rows give equal rows; a null doc_id stays
    null; an empty table gives no rows; extra columns are ignored.
    """
    return digests(Scratch(docs.sparkSession, "media").write(media(docs), "media"))
