"""Media columns: progressive JPEG as a lossless store, and RGB tensors from it.

The format's unit is the DCT coefficient. Byte b of the payload is coefficient
b + 256 of some 8x8 block, so each coefficient has nine bits and is positive. A
picture has 4:2:0 components (of six blocks four Y, one Cb, one Cr; the last
picture blocks may be filler, a comment holds the payload's length) and all
quantisers are 1. It is sent progressively:

* DC by successive approximation: one scan at bit 8, then a scan for each lower bit
* AC by spectral selection, coefficients 1-5 and 6-63, down to bit 1
* AC 1-63 refined by bit 0

The reader accumulates any scans of a Huffman-coded progressive JPEG into
coefficient arrays. Scans in which each coefficient takes equally many bits, as
above, are read whole by numpy; others bit by bit. Coefficients are then
dequantised, inverse-transformed by one matrix product, chroma is upsampled and
full-resolution RGB follows, one row of MCUs at a time.

Defined results: a null text is an empty one, whose payload is 192 spaces; texts
of any length are stored whole in one picture (4,095 units of 384 bytes each way,
beyond what a value holds); repeated rows are all returned and equal texts give
equal values; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from .common import small_batches, table

UNIT, BLOCK, MCU, WIDEST = 192, 64, 6, 4095
BIAS, TOP = 256, 8
BANDS = ((1, 5), (6, 63))
SAMPLING = ((1, 2, 2), (2, 1, 1), (3, 1, 1))


def zigzag() -> np.ndarray:
    """Row-major position of each coefficient in zigzag order."""
    cells = sorted(((r + c, r if (r + c) % 2 else c, r, c) for r in range(8) for c in range(8)))
    return np.array([r * 8 + c for *_, r, c in cells])


@lru_cache(1)
def _inverse() -> np.ndarray:
    """(64, 64): zigzag coefficients to row-major samples."""
    x = np.arange(8)
    basis = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    return np.kron(basis, basis)[zigzag()].astype(np.float32)


@lru_cache(64)
def _order(wide: int, high: int) -> np.ndarray:
    """Blocks (Y, Cb, Cr in turn, each row by row) in the order of interleaved MCUs."""
    m = wide * high
    r, c = np.divmod(np.arange(m), wide)
    y = [(2 * r + i) * 2 * wide + 2 * c + j for i in (0, 1) for j in (0, 1)]
    return np.stack([*y, 4 * m + np.arange(m), 5 * m + np.arange(m)], axis=1).ravel()


def _nine(v: np.ndarray) -> bytes:
    """Nine-bit values in a row, filled up with ones."""
    v = np.concatenate((v.ravel(), np.full(-v.size % 8, 511, np.uint16))).reshape(-1, 8)
    out = np.empty((len(v), 9), np.uint8)
    out[:, 0] = v[:, 0] >> 1
    for j in range(1, 8):
        out[:, j] = (v[:, j - 1] << (8 - j)) & 255 | v[:, j] >> (j + 1)
    out[:, 8] = v[:, 7] & 255
    return out.tobytes()


def _unnine(raw: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(raw + bytes(-len(raw) % 9), np.uint8).reshape(-1, 9).astype(np.uint16)
    out = np.empty((len(raw), 8), np.uint16)
    for j in range(8):
        out[:, j] = ((raw[:, j] << (j + 1)) | raw[:, j + 1] >> (7 - j)) & 511
    return out.ravel()[:n]


def _bits(bits: np.ndarray) -> bytes:
    return np.packbits(np.concatenate((bits, np.ones(-len(bits) % 8, np.uint8)))).tobytes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, lengths: list[int], symbols: list[int]) -> bytes:
    return _segment(0xC4, bytes([kind, *lengths, *[0] * (16 - len(lengths)), *symbols]))


def _scan(parts: list[int], first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(parts), *(x for p in parts for x in (p, 0)), first, last, high << 4 | low])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


@lru_cache(256)
def _dc_start(wide: int, high: int) -> bytes:
    """First DC scan of a picture whose DC coefficients all start with bit 8: each component's first difference is 1, all others 0."""
    m = wide * high
    new = np.isin(_order(wide, high), (0, 4 * m, 5 * m))
    bits = np.repeat(np.zeros(len(new), np.uint8), np.where(new, 3, 1))
    at = np.cumsum(np.where(new, 3, 1)) - np.where(new, 3, 1)
    bits[at[new]] = 1
    bits[at[new] + 2] = 1
    return _bits(bits)


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload, a positive multiple of 192 bytes."""
    m = -(-len(payload) // (MCU * BLOCK))
    wide = min(m, WIDEST)
    high = -(-m // wide)
    m = wide * high
    v = np.frombuffer(payload + b" " * (m * MCU * BLOCK - len(payload)), np.uint8).reshape(-1, BLOCK)
    frame = struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes(x for k, h, w in SAMPLING for x in (k, h << 4 | w, 0))
    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload))), _segment(0xDB, bytes([0] + [1] * 64)), _segment(0xC2, frame)]
    out += [_table(0x00, [1, 1], [0, 1]), _scan([1, 2, 3], 0, 0, 0, TOP, _dc_start(wide, high))]
    dc = v[_order(wide, high), 0]
    out += [_scan([1, 2, 3], 0, 0, b + 1, b, _bits(dc >> b & 1)) for b in range(TOP - 1, -1, -1)]
    ends = (0, 4 * m, 5 * m, 6 * m)
    each = [v[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]
    out.append(_table(0x10, [1], [TOP]))
    for first, last in BANDS:
        out += [_scan([k + 1], first, last, 0, 1, _nine((BIAS + x[:, first : last + 1].astype(np.uint16)) >> 1)) for k, x in enumerate(each)]
    out.append(_table(0x10, [1], [0]))
    low = v & 1
    low[:, 0] = 0  # the code of "no new coefficient in this block" stands before its 63 bits
    out += [_scan([k + 1], 1, 63, 1, 0, np.packbits(low[a:z], axis=1).tobytes()) for k, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
    return b"".join([*out, b"\xff\xd9"])


class _Reader:
    """Bits and Huffman codes of one scan."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0

    def get(self, n: int) -> int:
        v = 0
        for b in self.bits[self.at : self.at + n]:
            v = v << 1 | b
        self.at += n
        return v

    def signed(self, n: int) -> int:
        v = self.get(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.get(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such Huffman code")


class Picture:
    """Coefficient arrays of a progressive JPEG, filled scan by scan."""

    def __init__(self, media: bytes, fast: bool = True):
        self.fast, self.codes, self.tables, self.note = fast, {}, {}, b""
        at = 2
        while True:
            marker, size = media[at + 1], struct.unpack_from(">H", media, at + 2)[0] if media[at + 1] != 0xD9 else 0
            body, at = media[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xD9:
                return
            if marker == 0xDA:
                end = at
                while (end := media.index(b"\xff", end)) >= 0 and media[end + 1] == 0:
                    end += 2
                self._take(body, media[at:end].replace(b"\xff\x00", b"\xff"))
                at = end
            elif marker == 0xC2:
                self._frame(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xDB:
                for k in range(0, len(body), 65):
                    if body[k] >> 4:
                        raise ValueError("16-bit quantisers are not for 8-bit samples")
                    self.tables[body[k] & 15] = np.frombuffer(body[k + 1 : k + 65], np.uint8).astype(np.float32)
            elif marker == 0xFE:
                self.note = body
            elif 0xC0 <= marker <= 0xCF or marker == 0xDD:
                raise ValueError(f"marker {marker:#x} is not of a progressive Huffman JPEG without restarts")

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        self.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        self.top_h, self.top_v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        self.wide, self.high = -(-self.width // (8 * self.top_h)), -(-self.height // (8 * self.top_v))
        # whole MCUs; a scan of one component may skip blocks past its own edge
        self.starts, total = [], 0
        for _, h, v, _ in self.parts:
            self.starts.append(total)
            total += self.wide * h * self.high * v
        self.coef = np.zeros((total, BLOCK), np.int32)

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            lengths, code, k, out = body[at + 1 : at + 17], 0, at + 17, {}
            for n, count in enumerate(lengths, 1):
                for _ in range(count):
                    out[n, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            self.codes[body[at]] = out
            at = k

    def _blocks(self, parts: list[int]) -> np.ndarray:
        """The scan's blocks in order."""
        if len(parts) > 1:
            out = []
            for row in range(self.high):
                for p in parts:
                    _, h, v, _ = self.parts[p]
                    r, c = np.divmod(np.arange(h * v), h)
                    out.append(self.starts[p] + (row * v + r)[None, :] * self.wide * h + np.arange(self.wide)[:, None] * h + c[None, :])
            each = len(parts)
            return np.concatenate([np.concatenate(out[i : i + each], axis=1).ravel() for i in range(0, len(out), each)])
        _, h, v, _ = self.parts[parts[0]]
        wide, high = -(-self.width * h // (8 * self.top_h)), -(-self.height * v // (8 * self.top_v))
        return (self.starts[parts[0]] + np.arange(high)[:, None] * self.wide * h + np.arange(wide)[None, :]).ravel()

    def _take(self, head: bytes, data: bytes) -> None:
        n = head[0]
        names = [p[0] for p in self.parts]
        parts = [names.index(head[1 + 2 * k]) for k in range(n)]
        dc = {p: self.codes.get(head[2 + 2 * k] >> 4) for k, p in enumerate(parts)}
        ac = self.codes.get(0x10 | head[2] & 15)
        first, last, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
        ours = parts == [0, 1, 2] and self.fast and [p[:3] for p in self.parts] == list(SAMPLING)
        blocks = _order(self.wide, self.high) if ours else self._blocks(parts)
        if not first:
            if high:
                self.coef[blocks, 0] |= np.unpackbits(np.frombuffer(data, np.uint8), count=len(blocks)).astype(np.int32) << low
            elif ours and low == TOP and dc[0] == {(1, 0): 0, (2, 2): 1} and data == _dc_start(self.wide, self.high):
                self.coef[:, 0] = 1 << low
            else:
                self._dc(blocks, parts, dc, low, _Reader(data))
            return
        band = last - first + 1
        one = next(iter(ac.values())) if self.fast and len(ac) == 1 and (1, 0) in ac else None
        if not high and one == 8:
            got = _unnine(data, len(blocks) * band)
            if (got >> 7 == 1).all():  # code 0, then a first bit that says positive
                self._put(blocks, first, last, got.reshape(-1, band).astype(np.int32) << low)
                return
        if high and one == 0:
            bits = np.unpackbits(np.frombuffer(data, np.uint8), count=len(blocks) * (band + 1)).reshape(-1, band + 1)
            old = self.coef[blocks, first : last + 1]
            if (old != 0).all():
                self._put(blocks, first, last, old + np.sign(old) * (bits[:, 1:].astype(np.int32) << low))
                return
        (self._ac_more if high else self._ac)(blocks, ac, first, last, low, _Reader(data))

    def _put(self, blocks: np.ndarray, first: int, last: int, values: np.ndarray) -> None:
        if blocks[-1] - blocks[0] == len(blocks) - 1:
            self.coef[blocks[0] : blocks[-1] + 1, first : last + 1] = values
        else:
            self.coef[blocks, first : last + 1] = values

    def _dc(self, blocks, parts, codes, low, r: _Reader) -> None:
        owner = np.searchsorted(self.starts, blocks, "right") - 1
        before = dict.fromkeys(parts, 0)
        for b, p in zip(blocks.tolist(), owner.tolist(), strict=True):
            before[p] += r.signed(r.symbol(codes[p]))
            self.coef[b, 0] = before[p] << low

    def _ac(self, blocks, codes, first, last, low, r: _Reader) -> None:
        idle = 0
        for b in blocks.tolist():
            k = first
            if idle:
                idle -= 1
                continue
            while k <= last:
                run, size = divmod(r.symbol(codes), 16)
                if size:
                    k += run
                    self.coef[b, k] = r.signed(size) * (1 << low)
                elif run < 15:
                    idle = (1 << run) + r.get(run) - 1
                    break
                else:
                    k += 15
                k += 1

    def _ac_more(self, blocks, codes, first, last, low, r: _Reader) -> None:
        idle, bit = 0, 1 << low
        for b in blocks.tolist():
            c, k = self.coef[b], first
            if not idle:
                while k <= last:
                    run, size = divmod(r.symbol(codes), 16)
                    new = (bit if r.get(1) else -bit) if size else 0
                    if not size and run < 15:
                        idle = (1 << run) + r.get(run)
                        break
                    while k <= last:
                        if c[k]:
                            if r.get(1):
                                c[k] += bit if c[k] > 0 else -bit
                        elif not run:
                            break
                        else:
                            run -= 1
                        k += 1
                    if new and k <= last:
                        c[k] = new
                    k += 1
            if idle:
                for j in range(k, last + 1):
                    if c[j] and r.get(1):
                        c[j] += bit if c[j] > 0 else -bit
                idle -= 1

    def payload(self) -> bytes:
        """What :func:`encode` was given."""
        return (self.coef - BIAS).astype(np.uint8).tobytes()[: struct.unpack(">Q", self.note)[0]]

    def rows(self) -> Iterator[np.ndarray]:
        """uint8 RGB of full resolution, one row of MCUs at a time."""
        for row in range(self.high):
            planes = []
            for start, (_, h, v, q) in zip(self.starts, self.parts, strict=True):
                n = self.wide * h
                part = self.coef[start + row * v * n : start + (row + 1) * v * n] * self.tables[q]
                samples = np.clip(part.astype(np.float32) @ _inverse() + 128, 0, 255)
                plane = samples.reshape(v, n, 8, 8).transpose(0, 2, 1, 3).reshape(8 * v, 8 * n)
                planes.append(plane.repeat(self.top_v // v, axis=0).repeat(self.top_h // h, axis=1))
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            rgb = np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), axis=-1)
            yield np.rint(np.clip(rgb, 0, 255)).astype(np.uint8)[: self.height - row * 8 * self.top_v, : self.width]

    def tensor(self) -> np.ndarray:
        return np.concatenate(list(self.rows()))


def feature(picture: Picture) -> str:
    """Size, mean colour and a histogram of green in eight bins, in whole numbers."""
    total, bins, n = np.zeros(3, np.int64), np.zeros(8, np.int64), 0
    for rgb in picture.rows():
        total += rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
        bins += np.bincount((rgb[..., 1] >> 5).ravel(), minlength=8)
        n += rgb.shape[0] * rgb.shape[1]
    return f"{picture.height}x{picture.width} " + ",".join(map(str, (total // n).tolist())) + " " + ",".join(map(str, bins.tolist()))


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "replace")
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return raw + b" " * (size - len(raw)), len(raw)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                got = [(encode(p), n) for p, n in (padded(t.as_py()) for t in b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for _, n in got], pa.int64()), pa.array([m for m, _ in got], pa.binary())], ["id", "n_bytes", "media"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def tensors(media: DataFrame) -> DataFrame:
    """Column ``media`` to height, width and rgb (row-major bytes), other columns kept."""
    names, at = media.columns, media.columns.index("media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a picture at a time: tensors are large
                one = b.slice(i, 1)
                rgb = Picture(one.column(at)[0].as_py()).tensor()
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([rgb.shape[0]], pa.int32()), pa.array([rgb.shape[1]], pa.int32()), pa.array([rgb.tobytes()], pa.binary())], [*names, "height", "width", "rgb"])

    more = [StructField("height", IntegerType()), StructField("width", IntegerType()), StructField("rgb", BinaryType())]
    return media.mapInArrow(run, StructType([*media.schema.fields, *more]))


def digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From the stored bytes alone (and n_bytes): payload and features."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(2):
                raw = m.as_py()
                picture = Picture(raw)
                p = picture.payload()
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(picture)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "n_bytes", *DIGESTS])

    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select(id_col, "n_bytes", "media").mapInArrow(run, schema).withColumnRenamed("id", id_col)


DIGESTS = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(stored(table(spark, sf_dir, "documents")))
