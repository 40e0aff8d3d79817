"""FLAC media columns: 8-bit mono streams written and read by Spark tasks, all frames of a slice in step.

Encoding turns the frames of a slice into one matrix of samples, tries the linear predictors on all of them at once, and
packs the Rice codes of the best one. Decoding finds the frames by their sync codes, header checksums and numbers,
verifies the checksum of every frame, and then reads one residual of every frame per step: a step is a few array
operations over all frames, so the serial part is a block's length, not the stream's.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_slices, small_batches

BLOCK, SEEK_EVERY, RATE, PRECISION, SHIFT = 1024, 8, 8000, 12, 9
#: Fixed values of the format: coefficients of the fixed predictors.
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, dtype=np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8).tolist(), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8[c ^ b]
    return c


@lru_cache(maxsize=1)
def _crc16_by_distance(n: int) -> np.ndarray:
    """What a byte adds to the checksum of a frame, by its distance from the frame's end (the checksum is linear)."""
    out = np.empty((n, 256), dtype=np.uint16)
    out[0] = CRC16
    for d in range(1, n):
        out[d] = (out[d - 1] << 8) ^ CRC16[out[d - 1] >> 8]
    return out


def crc16(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Checksums of consecutive non-empty spans of data: [start, stop), in order and without gaps."""
    lengths = stop - start
    table = _crc16_by_distance(1 << int(lengths.max()).bit_length())
    distance = np.repeat(stop - 1, lengths) - np.arange(start[0], stop[-1])
    return np.bitwise_xor.reduceat(table[distance, data[start[0] : stop[-1]]], start - start[0])


@lru_cache(maxsize=1 << 16)
def frame_header(number: int, size: int) -> bytes:
    """Header of a fixed-block-size frame of 8-bit mono samples: number in the UTF-8-like code, size - 1 in 16 bits."""
    if number < 0x80:
        coded = bytes([number])
    else:
        n, tail = 1, []
        while number >> (6 * n) >= 1 << (6 - n):
            n += 1
        tail = [0x80 | (number >> (6 * i)) & 0x3F for i in reversed(range(n))]
        coded = bytes([(0xFF << (7 - n)) & 0xFF | number >> (6 * n), *tail])
    head = b"\xff\xf8\x70\x02" + coded + (size - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


def _read_header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(number, block size, header length) of a frame header at a place, None where there is none."""
    if len(data) < at + 8 or data[at + 2] >> 4 != 7 or data[at + 3] != 2:
        return None
    first = data[at + 4]
    more = 0 if first < 0x80 else 7 - (first ^ 0xFF).bit_length()
    if first == 0xFF or first >= 0x80 and more < 1:
        return None
    number = first if first < 0x80 else first & ((1 << (6 - more)) - 1)
    for b in data[at + 5 : at + 5 + more]:
        number = number << 6 | b & 0x3F
    end = at + 5 + more + 2
    if end >= len(data) or crc8(data[at:end]) != data[end]:
        return None
    return number, int.from_bytes(data[end - 2 : end], "big") + 1, end + 1 - at


def _pack(values: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bit fields (high bits beyond the value are 0) as bytes, each row from a whole byte on; and the rows' bytes."""
    row_bits = widths.sum(axis=1)
    row_bytes = (row_bits + 7) >> 3
    starts = np.concatenate(([0], np.cumsum(row_bytes)[:-1])) * 8
    ends = (starts[:, None] + np.cumsum(widths, axis=1))[widths > 0]
    values = values[widths > 0]
    bits = np.zeros(int(row_bytes.sum()) * 8, dtype=np.uint8)
    while len(values):
        ends -= 1
        bits[ends] = values & 1
        values >>= 1
        if not values.all():
            keep = values > 0
            values, ends = values[keep], ends[keep]
    return np.packbits(bits), row_bytes


def _residuals(x: np.ndarray, order: int, coefs, shift: int = 0) -> np.ndarray:
    """Residuals of rows of samples under a predictor; the first `order` columns are 0 (warm-up)."""
    out = np.zeros_like(x)
    guess = np.zeros_like(x[:, order:])
    for j in range(order):
        c = coefs[j]
        guess += (c[:, None] if isinstance(c, np.ndarray) else c) * x[:, order - 1 - j : x.shape[1] - 1 - j]
    out[:, order:] = x[:, order:] - (guess >> shift)
    return out


def encode_frames(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subframes of rows of samples (rows padded with 0 beyond their size): their bytes, and the bytes of each."""
    n = x.shape[1]
    inside = np.arange(n) < sizes[:, None]
    f = x.astype(np.float64)
    r0, r1, r2 = (f * f).sum(1), (f[:, 1:] * f[:, :-1]).sum(1), (f[:, 2:] * f[:, :-2]).sum(1)
    det = np.maximum(r0 * r0 - r1 * r1, 1e-9)
    limit = (1 << (PRECISION - 1)) - 1
    a = [np.clip(np.rint(v / det * (1 << SHIFT)), -limit - 1, limit).astype(np.int32) for v in (r1 * (r0 - r2), r0 * r2 - r1 * r1)]
    ways = [(8 + o, o, _residuals(x, o, FIXED[o])) for o in (0, 1, 2)] + [(32 + 1, 2, _residuals(x, 2, a, SHIFT))]
    cost, folded, rice = [], [], []
    for kind, order, r in ways:
        used = inside & (np.arange(n) >= order)
        u = np.where(used, (r << 1) ^ (r >> 31), 0)
        count = np.maximum(sizes - order, 1)
        k = np.clip(np.floor(np.log2(np.maximum(u.sum(1) / count * 0.7, 1))), 0, 14).astype(np.int32)
        k = np.maximum(k, np.maximum(np.ceil(np.log2(u.max(1) / 48 + 1e-9)), 0).astype(np.int32))  # short unary parts
        cost.append((u >> k[:, None]).sum(1) + count * (1 + k) + 8 * order + 18 + (9 + 2 * PRECISION) * (kind >= 32))
        folded.append(u)
        rice.append(k)
    verbatim, constant = 8 + 8 * sizes, np.where((np.where(inside, x, x[:, :1]) == x[:, :1]).all(1), 16, 1 << 30)
    best = np.argmin(np.stack([*cost, verbatim, constant]), axis=0)
    prefix = 10
    values, widths = (np.zeros((len(x), prefix + n), dtype=np.int32) for _ in range(2))

    def put(rows, column, value, width):
        values[rows, column], widths[rows, column] = value, width

    for way, (kind, order, _) in enumerate(ways):
        rows = np.flatnonzero(best == way)
        if not len(rows):
            continue
        put(rows, 0, kind << 1, 8)
        for j in range(order):
            put(rows, 1 + j, x[rows, j] & 0xFF, 8)
        if kind >= 32:
            put(rows, 3, PRECISION - 1, 4)
            put(rows, 4, SHIFT, 5)
            for j in range(order):
                put(rows, 5 + j, a[j][rows] & ((1 << PRECISION) - 1), PRECISION)
        k, u = rice[way][rows], folded[way][rows]
        put(rows, 9, k, 10)  # residual method 0, partition order 0, Rice parameter
        width = np.where(inside[rows] & (np.arange(n) >= order), (u >> k[:, None]) + 1 + k[:, None], 0)
        values[rows, prefix:] = np.where(width > 0, 1 << k[:, None] | u & ((1 << k[:, None]) - 1), 0)
        widths[rows, prefix:] = width
    rows = np.flatnonzero(best == len(ways))
    put(rows, 0, 1 << 1, 8)
    values[rows, prefix:], widths[rows, prefix:] = np.where(inside[rows], x[rows] & 0xFF, 0), np.where(inside[rows], 8, 0)
    rows = np.flatnonzero(best == len(ways) + 1)
    put(rows, 0, 0, 8)
    put(rows, 1, x[rows, 0] & 0xFF, 8)
    return _pack(values, widths)


def encode_streams(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """A stream for each payload (not empty): stream info with the samples' MD5, a seek table, the frames."""
    out = []
    counts = [-(-len(p) // block) for p in payloads]
    sizes = np.array([min(block, len(p) - i * block) for p, c in zip(payloads, counts) for i in range(c)], dtype=np.int64)
    width = int(sizes.max(initial=0))
    x = np.zeros((len(sizes), width), dtype=np.int32)
    flat = np.frombuffer(b"".join(payloads), dtype=np.uint8).astype(np.int32) - 128
    x[np.arange(width) < sizes[:, None]] = flat
    packed, row_bytes = encode_frames(x, sizes)
    heads = [frame_header(i, min(block, len(p) - i * block)) for p, c in zip(payloads, counts) for i in range(c)]
    ends = np.cumsum(row_bytes).tolist()
    body = packed.tobytes()
    frames = [h + body[e - n : e] for h, e, n in zip(heads, ends, row_bytes.tolist())]
    lengths = np.array([len(b) for b in frames])
    stops = np.cumsum(lengths)
    checks = crc16(np.frombuffer(b"".join(frames), dtype=np.uint8), stops - lengths, stops)
    frames = [b + int(c).to_bytes(2, "big") for b, c in zip(frames, checks)]
    at = 0
    for p, c in zip(payloads, counts):
        own = frames[at : at + c]
        at += c
        offset, points = 0, []
        for i, b in enumerate(own):
            if i % SEEK_EVERY == 0:
                points.append((i * block).to_bytes(8, "big") + offset.to_bytes(8, "big") + min(block, len(p) - i * block).to_bytes(2, "big"))
            offset += len(b)
        signed = (np.frombuffer(p, dtype=np.uint8) ^ 0x80).tobytes()
        least, most = min(map(len, own)), max(map(len, own))
        info = block.to_bytes(2, "big") * 2 + least.to_bytes(3, "big") + most.to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        table = b"".join(points)
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own))
    return out


class _Bits:
    """Bit reader of many places at once."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)]).astype(np.uint64)
        self.windows = np.zeros(len(padded) - 7, dtype=np.uint64)
        for i in range(8):
            self.windows |= padded[i : len(padded) - 7 + i] << np.uint64(56 - 8 * i)
        self.zeros = np.full(1 << 16, 16, dtype=np.int64)
        for bit in range(16):
            self.zeros[1 << bit : 1 << (bit + 1)] = 15 - bit

    def window(self, at: np.ndarray) -> np.ndarray:
        return self.windows[at >> 3] << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, n) -> np.ndarray:
        """n bits (0 to 57) from each place."""
        n = np.asarray(n, dtype=np.uint64)
        return np.where(n == 0, 0, (self.window(at) >> (np.uint64(64) - np.maximum(n, 1))).astype(np.int64))

    def run(self, at: np.ndarray) -> np.ndarray:
        """Zeros before the next one."""
        found = self.zeros[self.window(at) >> np.uint64(48)]
        more = np.flatnonzero(found == 16)
        while len(more):
            step = self.zeros[self.window(at[more] + found[more]) >> np.uint64(48)]
            found[more] += step
            more = more[step == 16]
            if len(more) and int((at[more] + found[more]).max()) >> 3 > len(self.windows) - 8:
                raise ValueError("FLAC: a unary code runs past the end")
        return found


def _signed(v: np.ndarray, bits) -> np.ndarray:
    return np.where(v >> (bits - 1) & 1, v - (1 << bits), v)


def decode_frames(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (a row per frame) of subframes that start at the given bytes, and the bit at which each ends."""
    bits, count, longest = _Bits(data), len(at), int(sizes.max())
    order_of_rows = np.argsort(-sizes, kind="stable")
    at, sizes = at[order_of_rows] * 8, sizes[order_of_rows]
    head = bits.read(at, 8)
    if (head & 0x81).any():
        raise ValueError("FLAC: unsupported subframe")
    kind, at = head >> 1, at + 8
    order = np.where(kind >= 32, kind - 31, np.where((kind >= 8) & (kind <= 12), kind - 8, 0))
    if not np.isin(kind, [0, 1, 8, 9, 10, 11, 12, *range(32, 64)]).all():
        raise ValueError("FLAC: reserved subframe type")
    out = np.zeros((longest, count), dtype=np.int64)
    most = int(order.max())
    for j in range(most):
        rows = np.flatnonzero(order > j)
        out[j, rows] = _signed(bits.read(at[rows], 8), 8)
        at[rows] += 8
    coefs, shift = np.zeros((most, count), dtype=np.int64), np.zeros(count, dtype=np.int64)
    for o, fixed in FIXED.items():
        for j, c in enumerate(fixed[:most]):
            coefs[j, kind == 8 + o] = c
    rows = np.flatnonzero(kind >= 32)
    if len(rows):
        precision, shift[rows] = bits.read(at[rows], 4) + 1, bits.read(at[rows] + 4, 5)
        at[rows] += 9
        for j in range(int(order[rows].max())):
            own = order[rows] > j
            some = rows[own]
            coefs[j, some] = _signed(bits.read(at[some], precision[own]), precision[own])
            at[some] += precision[own]
    for rows in (np.flatnonzero(kind == 0),):
        out[:, rows] = _signed(bits.read(at[rows], 8), 8)
        at[rows] += 8
    coded = kind >= 8
    method, split = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
    method[coded], split[coded] = bits.read(at[coded], 2), bits.read(at[coded] + 2, 4)
    at[coded] += 6
    parameter_bits, part = np.where(method == 1, 5, 4), sizes >> split
    k, raw, due = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=bool), np.where(coded, order, 1 << 40)
    plain = kind == 1
    every_coded, any_raw = bool(coded.all()), False
    for n in range(longest):
        active = int(np.searchsorted(-sizes, -n, side="left"))  # rows with more than n samples come first
        rows: slice | np.ndarray = slice(0, active)
        if not every_coded or n < most:
            rows = np.flatnonzero(coded[:active] & (order[:active] <= n))
            own = np.flatnonzero(plain[:active])
            if len(own):
                out[n, own] = _signed(bits.read(at[own], 8), 8)
                at[own] += 8
            if not len(rows):
                continue
        starts = np.flatnonzero(due[:active] == n)
        if len(starts):
            k[starts] = bits.read(at[starts], parameter_bits[starts])
            at[starts] += parameter_bits[starts]
            raw[starts] = k[starts] == (1 << parameter_bits[starts]) - 1
            due[starts] = (n // part[starts] + 1) * part[starts]
            escaped = starts[raw[starts]]
            any_raw = bool(raw.any())
            k[escaped] = bits.read(at[escaped], 5)
            at[escaped] += 5
        place, width = at[rows], k[rows]
        zeros = bits.run(place) if not any_raw else np.where(raw[rows], 0, bits.run(place))
        low = place + zeros + (1 if not any_raw else ~raw[rows])
        u = zeros << width | bits.read(low, width)
        value = u >> 1 ^ -(u & 1)
        if any_raw:
            value = np.where(raw[rows], np.where(width > 0, _signed(bits.read(place, width), np.maximum(width, 1)), 0), value)
        at[rows] = low + width
        if most:
            guess = coefs[0, rows] * out[n - 1, rows] if n else 0
            for j in range(1, min(most, n)):
                guess = guess + coefs[j, rows] * out[n - 1 - j, rows]
            value = value + (guess >> shift[rows] if n else 0)
        out[n, rows] = value
    back = np.empty(count, dtype=np.int64)
    back[order_of_rows] = np.arange(count)
    return out.T[back], at[back]


def _frames(data: bytes, at: int, checked: bool) -> list[tuple[int, tuple[int, int, int]]]:
    """(start, header) of each frame. A frame's samples may hold what looks like the next header; where `checked`, a
    header counts only if the checksum of the frame before it fits what lies between."""
    found, raw = [], np.frombuffer(data, dtype=np.uint8)
    while at >= 0:
        head = _read_header(data, at)
        if head and head[0] == len(found):
            start = found[-1][0] if found else None
            if not checked or start is None or (at - start > 2 and int(crc16(raw[start : at - 2], np.array([0]), np.array([at - 2 - start]))[0]) == int(raw[at - 2]) << 8 | int(raw[at - 1])):
                found.append((at, head))
        elif not found:
            break
        at = data.find(b"\xff\xf8", at + 2)
    if not found:
        raise ValueError("FLAC: no frame")
    return found


def decode_streams(streams: list[bytes], doubtful: frozenset[int] = frozenset()) -> list[tuple[bytes, list[int]]]:
    """(bytes, sample offsets of the blocks) of each stream; a failing checksum, count or MD5 is a ValueError.

    Streams in which a frame's checksum fails are read once more, as `doubtful`, with frames told by their checksums.
    """
    places, sizes, owners, frame_starts, frame_stops, totals, sums = [], [], [], [], [], [], []
    base = 0
    for number, data in enumerate(streams):
        if data[:4] != b"fLaC":
            raise ValueError("FLAC: no stream marker")
        at, last = 4, False
        total, md5 = 0, b""
        while not last:
            last, kind, n = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            if kind == 0:
                info = data[at + 4 : at + 4 + n]
                total, md5 = int.from_bytes(info[13:18], "big") & 0xFFFFFFFFF, info[18:34]
            at += 4 + n
        totals.append(total)
        sums.append(md5)
        found = _frames(data, at, checked=number in doubtful)
        stops = [f[0] for f in found[1:]] + [len(data)]
        for (start, (_, size, head_bytes)), stop in zip(found, stops):
            frame_starts.append(base + start)
            frame_stops.append(base + stop)
            places.append(base + start + head_bytes)
            sizes.append(size)
            owners.append(number)
        base += len(data)
    buffer = np.frombuffer(b"".join(streams), dtype=np.uint8)
    starts, stops = np.array(frame_starts), np.array(frame_stops)
    body = np.concatenate([buffer[a : b - 2] for a, b in zip(frame_starts, frame_stops)])
    ends = np.cumsum(stops - 2 - starts)
    checks = crc16(body, ends - (stops - 2 - starts), ends)
    wrong = checks != (buffer[stops - 2].astype(np.uint16) << 8 | buffer[stops - 1])
    if wrong.any():
        again = frozenset(np.array(owners)[wrong].tolist())
        if again <= doubtful:
            raise ValueError("FLAC: a frame's checksum is wrong")
        return decode_streams(streams, doubtful | again)
    size = np.array(sizes)
    samples, reached = decode_frames(buffer, np.array(places), size)
    if ((reached + 7 >> 3) != stops - 2).any():
        raise ValueError("FLAC: a frame doesn't end where its samples do")
    pcm = samples.astype(np.int8)
    out = []
    firsts = np.searchsorted(np.array(owners), np.arange(len(streams) + 1))
    for i, data in enumerate(streams):
        a, b = int(firsts[i]), int(firsts[i + 1])
        joined = b"".join(pcm[j, : size[j]].tobytes() for j in range(a, b))
        if len(joined) != totals[i] or hashlib.md5(joined).digest() != sums[i]:
            raise ValueError("FLAC: the samples differ from the stream's MD5")
        offsets = np.concatenate(([0], np.cumsum(size[a:b])[:-1])).tolist()
        out.append(((np.frombuffer(joined, dtype=np.uint8) ^ 0x80).tobytes(), offsets))
    return out


def features(payload: bytes) -> str:
    """Sum, energy, sign changes around the mean, and the eight-band histogram of the samples."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    above = x * len(x) > x.sum()
    bands = np.bincount((x + 128) >> 5, minlength=8)
    return f"sum={x.sum()};energy={(x * x).sum()};crossings={(above[1:] != above[:-1]).sum()};bands={','.join(map(str, bands))}"


def padded_payload(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) with bytes 0 appended up to a positive multiple of 64."""
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.greatest(F.lit(64), F.ceil(F.octet_length(data) / 64) * 64).cast("int")
    return F.rpad(data, size, F.unhex(F.lit("00")))


def encode(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(id, media): the payload of each row as a FLAC stream of 8-bit samples; null or empty payloads give null.

    Repeated rows and null ids stay rows of their own, equal payloads give equal streams, very long ones are whole streams
    of many frames; other columns aren't carried and may have any name. An empty table gives no rows.
    """
    small_batches(df.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.column(1).to_pylist()
        own = [i for i, p in enumerate(rows) if p]
        out: list[bytes | None] = [None] * len(rows)
        for i, s in zip(own, encode_streams([rows[i] for i in own]) if own else []):
            out[i] = s
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "media"])

    source = df.select(F.col(id_col).alias("id"), F.col(payload_col).alias("payload"))
    return map_slices(source, run, "payload", f"id {dict(source.dtypes)['id']}, media binary")


def decode(df: DataFrame) -> DataFrame:
    """(id, media, pcm, offsets, feature) of (id, media): bytes read back, sample offset of each block, and features.

    A null stream gives nulls, a damaged one is an error. Repeated rows stay; other columns aren't carried.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.column(1).to_pylist()
        own = [i for i, p in enumerate(rows) if p]
        pcm, offsets, feature = [None] * len(rows), [None] * len(rows), [None] * len(rows)
        for i, (data, at) in zip(own, decode_streams([rows[i] for i in own]) if own else []):
            pcm[i], offsets[i], feature[i] = data, at, features(data)
        columns = [batch.column(0), batch.column(1), pa.array(pcm, pa.binary()), pa.array(offsets, pa.list_(pa.int64())), pa.array(feature, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["id", "media", "pcm", "offsets", "feature"])

    source = df.select("id", "media")
    return map_slices(source, run, "media", f"id {dict(source.dtypes)['id']}, media binary, pcm binary, offsets array<bigint>, feature string")


def pcm_blocks(decoded: DataFrame) -> DataFrame:
    """(id, block, sample_offset, pcm): a row for each block, to be written as a table in which a sample is found by offset."""
    blocks = decoded.select("id", "pcm", "offsets", F.posexplode("offsets").alias("block", "sample_offset"))
    following = F.coalesce(F.try_element_at("offsets", F.col("block") + 2), F.octet_length("pcm"))
    return blocks.select("id", "block", "sample_offset", F.substring("pcm", F.col("sample_offset") + 1, following - F.col("sample_offset")).alias("pcm"))
