"""Media columns: progressive JPEG files, written and read in numpy.

The reader takes any Huffman-coded progressive file of 8-bit samples with one or three components: it accumulates the
scans (spectral bands, first and refining passes) into coefficient arrays, dequantises and inverse-transforms all
blocks at once, upsamples chroma and gives an RGB tensor of the full resolution. The writer stores bytes losslessly in
the coefficients: a byte b is the coefficient 256 + b, 48 to a block, the six blocks of two 4:2:0 units to 576 bytes.
Their upper bits go into two spectral bands of first passes, the lowest bit into refining passes. All coefficients
being of one width, both directions run on whole arrays; scans of other files take the general path, symbol by symbol.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty, trim

# Bytes of a unit, coefficients used of a block, the bands, and limits of the format.
UNIT, USED, BANDS, MAX_ROWS, MAX_RUN = 576, 48, ((1, 24), (25, 48)), 4095, 32767
#: Texts that one step turns into files at a time.
ROWS = 64


def zigzag() -> np.ndarray:
    """Natural position of each coefficient in the order of the scans."""
    order = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
    return np.array(order)


ZIGZAG = zigzag()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(table: int, widths: dict[int, list[int]]) -> bytes:
    return bytes([table, *[len(widths.get(n, ())) for n in range(1, 17)]]) + bytes(s for n in sorted(widths) for s in widths[n])


def _scan(components: list[int], tables: int, band: tuple[int, int], high: int, low: int, bits: np.ndarray) -> bytes:
    pad = -len(bits) % 8
    data = np.packbits(np.concatenate([bits, np.ones(pad, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")
    head = bytes([len(components), *[x for c in components for x in (c, tables)], *band, high << 4 | low])
    return _segment(0xDA, head) + data


def write(payload: bytes) -> bytes:
    """A progressive JPEG file that holds the payload, of a positive multiple of 576 bytes."""
    units = len(payload) // UNIT
    if units < 1 or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 576 bytes")
    cols = -(-units // MAX_ROWS)
    rows = -(-units // cols)
    data = np.frombuffer(payload, np.uint8)
    if cols * rows > units:
        data = np.concatenate([data, np.full((cols * rows - units) * UNIT, 255, np.uint8)])
    mcus = 2 * cols * rows
    parts = np.split(data, [4 * mcus * USED, 5 * mcus * USED])
    out = [b"\xff\xd8", _segment(0xFE, b"bytes %d" % len(payload)), _segment(0xDB, bytes([0, *[1] * 64]))]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * rows, 32 * cols, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    # one-symbol tables for the first passes; for the refining ones the lengths of runs of ended blocks
    out.append(_segment(0xC4, _huffman(0x00, {1: [0]}) + _huffman(0x10, {1: [0x08]}) + _huffman(0x11, {4: [n << 4 for n in range(15)]})))
    zero = np.zeros(6 * mcus, np.uint8)
    out.append(_scan([1, 2, 3], 0x00, (0, 0), 0, 1, zero))
    out.append(_scan([1, 2, 3], 0x00, (0, 0), 1, 0, zero))
    for c, part in enumerate(parts, 1):
        blocks = part.reshape(-1, USED)
        for lo, hi in BANDS:
            top = np.ascontiguousarray(blocks[:, lo - 1 : hi] >> 1 | 0x80).reshape(-1, 1)
            bits = np.zeros((len(top), 9), np.uint8)
            bits[:, 1:] = np.unpackbits(top, axis=1)
            out.append(_scan([c], 0x00, (lo, hi), 0, 1, bits.reshape(-1)))
    for c, part in enumerate(parts, 1):
        blocks = part.reshape(-1, USED)
        for lo, hi in BANDS:
            low = blocks[:, lo - 1 : hi] & 1
            bits = []
            for at in range(0, len(low), MAX_RUN):
                run = low[at : at + MAX_RUN]
                n = len(run).bit_length() - 1
                head = f"{n:04b}" + (f"{len(run) - (1 << n):0{n}b}" if n else "")
                bits += [np.frombuffer(head.encode(), np.uint8) - 48, run.reshape(-1)]
            out.append(_scan([c], 0x01, (lo, hi), 1, 0, np.concatenate(bits)))
    return b"".join([*out, b"\xff\xd9"])


class _Table:
    """A Huffman table as a lookup of the next 16 bits; single: its only symbol and that one's width."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.width, self.symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code, k = 0, 0
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                lo, hi = code << (16 - n), (code + 1) << (16 - n)
                self.width[lo:hi], self.symbol[lo:hi] = n, symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.single = (symbols[0], int(self.width[0])) if k == 1 else None


@lru_cache(maxsize=64)
def _table(counts: bytes, symbols: bytes) -> _Table:
    return _Table(counts, symbols)


class _Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.bytes = data + b"\xff\xff\xff"
        self.at = 0

    def peek(self) -> int:
        k, s = self.at >> 3, self.at & 7
        return (int.from_bytes(self.bytes[k : k + 3], "big") >> (8 - s)) & 0xFFFF

    def code(self, t: _Table) -> int:
        x = self.peek()
        if not t.width[x]:
            raise ValueError("no such code")
        self.at += int(t.width[x])
        return int(t.symbol[x])

    def take(self, n: int) -> int:
        if not n:
            return 0
        x = self.peek() >> (16 - n)
        self.at += n
        return x

    def many(self, n: int) -> np.ndarray:
        self.at += n
        if self.at > len(self.bits):
            raise ValueError("the scan ends early")
        return self.bits[self.at - n : self.at]


def _extend(x: int, n: int) -> int:
    return x if not n or x >> (n - 1) else x - (1 << n) + 1


def _dc_first(bits: _Bits, blocks: list[tuple[int, np.ndarray, np.ndarray]], tables: dict, low: int) -> None:
    """blocks: for each component its number, its coefficients and the blocks in order, (units, blocks a unit)."""
    if all(tables[c].single and tables[c].single[0] == 0 for c, _, _ in blocks):
        bits.at += sum(order.size * tables[c].single[1] for c, _, order in blocks)
        return
    last = {c: 0 for c, _, _ in blocks}
    for u in range(len(blocks[0][2])):
        for c, coef, order in blocks:
            for b in order[u]:
                n = bits.code(tables[c])
                last[c] += _extend(bits.take(n), n)
                coef[b, 0] = last[c] << low


def _dc_refine(bits: _Bits, blocks: list[tuple[int, np.ndarray, np.ndarray]], low: int) -> None:
    units, each = len(blocks[0][2]), [order.shape[1] for _, _, order in blocks]
    got = bits.many(units * sum(each)).reshape(units, -1)
    at = 0
    for (_, coef, order), n in zip(blocks, each, strict=True):
        coef[order.reshape(-1), 0] |= got[:, at : at + n].reshape(-1).astype(coef.dtype) << low
        at += n


def _ac_first(bits: _Bits, coef: np.ndarray, order: np.ndarray, lo: int, hi: int, t: _Table, low: int) -> None:
    if t.single and t.single[0] >> 4 == 0 and t.single[0] & 15:
        n, w = t.single[0] & 15, t.single[1]
        got = bits.many(order.size * (hi - lo + 1) * (w + n)).reshape(-1, w + n)[:, w:]
        if n == 8:
            x = np.packbits(got, axis=1)[:, 0].astype(np.int32)
        else:
            x = got.astype(np.int32) @ (1 << np.arange(n - 1, -1, -1, dtype=np.int32))
        x = np.where(x >> (n - 1), x, x - (1 << n) + 1) << low
        coef[order, lo : hi + 1] = x.reshape(len(order), -1)
        return
    run = 0
    for b in order:
        if run:
            run -= 1
            continue
        k = lo
        while k <= hi:
            s = bits.code(t)
            r, n = s >> 4, s & 15
            if n:
                k += r
                coef[b, k] = _extend(bits.take(n), n) * (1 << low)
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + bits.take(r) - 1
                break


def _correct(coef: np.ndarray, rows: np.ndarray, lo: int, hi: int, bits: _Bits, step: int) -> None:
    """Refine what is not zero in whole blocks, in order."""
    band = coef[rows, lo : hi + 1]
    there = band != 0
    got = bits.many(int(there.sum())).astype(coef.dtype) * step
    band[there] += np.where(band[there] > 0, got, -got)
    coef[rows, lo : hi + 1] = band


def _ac_refine(bits: _Bits, coef: np.ndarray, order: np.ndarray, lo: int, hi: int, t: _Table, low: int) -> None:
    step, i = 1 << low, 0
    while i < len(order):
        b, k = order[i], lo
        while k <= hi:
            s = bits.code(t)
            r, n = s >> 4, s & 15
            if not n and r < 15:
                run = (1 << r) + bits.take(r)
                if k > lo:
                    _correct(coef, order[i : i + 1], k, hi, bits, step)
                    i, run = i + 1, run - 1
                _correct(coef, order[i : i + run], lo, hi, bits, step)
                i += run - 1
                break
            new = 0
            if n:
                new = step if bits.take(1) else -step
            while k <= hi:
                if coef[b, k]:
                    if bits.take(1):
                        coef[b, k] += step if coef[b, k] > 0 else -step
                elif r:
                    r -= 1
                else:
                    coef[b, k] = new
                    k += 1
                    break
                k += 1
        i += 1


class Image:
    """The frame of a file and the coefficients of its components in scan order, (blocks, 64)."""

    def __init__(self, data: bytes):
        self.comment = b""
        self.quant: dict[int, np.ndarray] = {}
        tables: dict[int, _Table] = {}
        interval, at = 0, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while True:
            marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if marker == 0xD9:
                break
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    m = sum(body[1:17])
                    tables[body[0]] = _table(body[1:17], body[17 : 17 + m])
                    body = body[17 + m :]
            elif marker == 0xDD:
                interval = int.from_bytes(body, "big")
            elif marker == 0xC2:
                self._frame(body)
            elif marker in (0xC0, 0xC1):
                raise ValueError("not a progressive file")
            elif marker == 0xDA:
                end = at
                while True:
                    end = data.index(b"\xff", end)
                    if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                        end += 2
                        continue
                    break
                self._scan(body, data[at:end], tables, interval)
                at = end

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        parts = [body[6 + 3 * k : 9 + 3 * k] for k in range(n)]
        self.sampling = {p[0]: (p[1] >> 4, p[1] & 15) for p in parts}
        self.table_of = {p[0]: p[2] for p in parts}
        self.most = tuple(max(s[k] for s in self.sampling.values()) for k in (0, 1))
        self.mcus = (-(-self.width // (8 * self.most[0])), -(-self.height // (8 * self.most[1])))
        self.coef = {c: np.zeros((self.mcus[0] * h * self.mcus[1] * v, 64), np.int32) for c, (h, v) in self.sampling.items()}

    def _order(self, c: int, alone: bool) -> np.ndarray:
        """The blocks of a component: in rows as far as the picture goes, or by the units of all components."""
        h, v = self.sampling[c]
        grid = np.arange(len(self.coef[c])).reshape(self.mcus[1] * v, self.mcus[0] * h)
        if alone:
            wide, tall = -(-self.width * h // (8 * self.most[0])), -(-self.height * v // (8 * self.most[1]))
            return grid[:tall, :wide].reshape(-1, 1)
        return grid.reshape(self.mcus[1], v, self.mcus[0], h).transpose(0, 2, 1, 3).reshape(-1, h * v)

    def _scan(self, head: bytes, data: bytes, tables: dict[int, _Table], interval: int) -> None:
        n = head[0]
        chosen = [(head[1 + 2 * k], head[2 + 2 * k]) for k in range(n)]
        lo, hi, approx = head[1 + 2 * n : 4 + 2 * n]
        high, low = approx >> 4, approx & 15
        orders = {c: self._order(c, n == 1) for c, _ in chosen}
        units = len(orders[chosen[0][0]])
        pieces = [data]
        if interval:
            pieces, start, at = [], 0, 0
            while (at := data.find(b"\xff", at)) >= 0:
                if 0xD0 <= data[at + 1] <= 0xD7:
                    pieces.append(data[start:at])
                    start = at + 2
                at += 2
            pieces.append(data[start:])
        for k, piece in enumerate(pieces):
            bits = _Bits(piece.replace(b"\xff\x00", b"\xff"))
            part = slice(k * interval, (k + 1) * interval) if interval else slice(0, units)
            blocks = [(c, self.coef[c], orders[c][part]) for c, _ in chosen]
            if lo == 0:
                if high:
                    _dc_refine(bits, blocks, low)
                else:
                    _dc_first(bits, blocks, {c: tables[t >> 4] for c, t in chosen}, low)
            else:
                c, coef, order = blocks[0]
                table = tables[0x10 | chosen[0][1] & 15]
                (_ac_refine if high else _ac_first)(bits, coef, order.reshape(-1), lo, hi, table, low)

    def rgb(self) -> np.ndarray:
        """uint8 (height, width, 3)."""
        planes = []
        for c, (h, v) in self.sampling.items():
            blocks = np.empty((len(self.coef[c]), 64), np.float32)
            blocks[:, ZIGZAG] = self.coef[c] * self.quant[self.table_of[c]]
            wide, tall = self.mcus[0] * h, self.mcus[1] * v
            plane = (blocks @ _inverse()).reshape(tall, wide, 8, 8).transpose(0, 2, 1, 3).reshape(tall * 8, wide * 8) + np.float32(128)
            plane = np.clip(np.rint(plane), 0, 255)
            plane = plane.repeat(self.most[1] // v, 0).repeat(self.most[0] // h, 1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            return np.stack([planes[0].astype(np.uint8)] * 3, -1)
        y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
        f = np.float32
        out = np.empty((*y.shape, 3), np.uint8)
        for k, channel in enumerate((y + f(1.402) * cr, y - f(0.344136) * cb - f(0.714136) * cr, y + f(1.772) * cb)):
            out[..., k] = np.clip(np.rint(channel), 0, 255)
        return out

    def payload(self) -> bytes:
        """The bytes that write() has stored."""
        n = int(self.comment.split()[-1])
        return np.concatenate([(c[:, 1 : USED + 1] - 256).astype(np.uint8).reshape(-1) for c in self.coef.values()]).tobytes()[:n]


@lru_cache(maxsize=1)
def _inverse() -> np.ndarray:
    """(64, 64): natural-order coefficients of a block to its samples."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    a = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)
    return np.einsum("ux,vy->uvxy", a, a).reshape(64, 64).astype(np.float32)


def padded(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (UNIT - len(raw) if len(raw) < UNIT else -len(raw) % UNIT)


def store(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, media: each whole text as a progressive JPEG file.

    A null or empty text is stored as one unit of filling. Equal texts give equal files. An empty table gives an
    empty one; other columns are left out.
    """
    small_batches(df.sparkSession)
    source = df.select(F.col(f"`{key}`").alias(key), text_or_empty(f"`{text}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = batch.column(1).to_pylist()
                media = pa.array([write(padded(t)) for t in texts], pa.binary())
                n = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), n, media], names=[key, "n_bytes", "media"])

    return source.mapInArrow(run, f"`{key}` {source.dtypes[0][1]}, n_bytes bigint, media binary")


def read(df: DataFrame, key: str = "doc_id", tensors: bool = True) -> DataFrame:
    """df's key, n_bytes and media with payload, height, width, rgb (row by row; null without tensors), rgb_sha256 (of
    the tensor, either way) and feature.

    feature: width, height, and each channel's mean and standard deviation over the tensor. A null medium, or bytes
    that are no progressive JPEG file, raise: a stored form that cannot be read is lost data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                rows = []
                for medium in batch.column(2).to_pylist():
                    image = Image(medium)
                    rgb = image.rgb()
                    flat = rgb.reshape(-1, 3)
                    # sums of whole numbers, so that the feature is the same on every machine
                    n, total = len(flat), flat.sum(0, dtype=np.int64)
                    squares = np.array([np.dot(np.bincount(flat[:, c], minlength=256), np.arange(256) ** 2) for c in range(3)])
                    mean, var = total / n, np.maximum(0, squares / n - (total / n) ** 2)
                    feature = f"{image.width}x{image.height};" + ",".join(f"{m:.3f}" for m in mean) + ";" + ",".join(f"{v:.3f}" for v in np.sqrt(var))
                    rows.append((image.payload() if image.comment.startswith(b"bytes ") else None, image.height, image.width, rgb.tobytes() if tensors else None, hashlib.sha256(rgb).hexdigest(), feature))
                cols = list(zip(*rows, strict=True))
                extra = [pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], *extra], names=[key, "n_bytes", "media", "payload", "height", "width", "rgb", "rgb_sha256", "feature"])
        trim()

    source = df.select(key, "n_bytes", "media")
    return source.mapInArrow(run, f"`{key}` {source.dtypes[0][1]}, n_bytes bigint, media binary, payload binary, height int, width int, rgb binary, rgb_sha256 string, feature string")


def report(media: DataFrame, key: str = "doc_id") -> DataFrame:
    return media.select(
        key,
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, length(payload) - 31, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "height",
        "width",
        "rgb_sha256",
    )
