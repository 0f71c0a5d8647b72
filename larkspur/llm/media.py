"""Media columns as progressive JPEG.

``encode`` stores bytes as the coefficients of a three-component 4:2:0 image: each 64 bytes are one
8 x 8 block, byte v is the coefficient 256 + v, so every coefficient has the same bit length. Scans
use spectral selection (DC, low and high AC bands) and successive approximation (the last bit of every
coefficient comes in refinement scans). ``decode`` reads any progressive 8-bit JPEG with Huffman
coding: it accumulates scans into coefficient arrays, inverse-transforms them in numpy, upsamples
chroma and returns a full-resolution RGB tensor. Scans in which all codes have one length, such as
those of ``encode``, are read as arrays; others go symbol by symbol.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import as_bytes, prepare, tidy

#: Payload bytes of one image; a longer payload is stored as several images in a row.
FRAME = 1 << 20
BASE = 256
RUN = 32767


def zigzag() -> np.ndarray:
    """The natural (row-major) place of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag()


def inverse_dct() -> np.ndarray:
    """coefficients in zigzag order (64) @ this = samples in row-major order (64)."""
    x = np.arange(8)
    a = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) / 2
    a[0] /= np.sqrt(2)
    return np.einsum("ux,vy->uvxy", a, a).reshape(64, 64)[ZIGZAG].astype(np.float32)


IDCT = inverse_dct()


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def huffman(cls: int, slot: int, lengths: dict[int, list[int]]) -> bytes:
    counts = bytes(len(lengths.get(n, ())) for n in range(1, 17))
    return segment(0xC4, bytes([cls << 4 | slot]) + counts + bytes(s for n in sorted(lengths) for s in lengths[n]))


def stuffed(data: np.ndarray) -> bytes:
    """Entropy-coded bytes, with a zero after each 0xFF."""
    at = np.flatnonzero(data == 0xFF)
    return np.insert(data, at + 1, 0).tobytes() if len(at) else data.tobytes()


def packed(bits: np.ndarray) -> np.ndarray:
    """Bits to bytes; the last byte is filled with ones."""
    if len(bits) % 8:
        bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])
    return np.packbits(bits)


def scan(components: list[int], ss: int, se: int, ah: int, al: int, tables: int, data: bytes) -> bytes:
    head = bytes([len(components)]) + b"".join(bytes([c, tables]) for c in components) + bytes([ss, se, ah << 4 | al])
    return segment(0xDA, head) + data


def coded(high: np.ndarray) -> np.ndarray:
    """The one-bit code 0 and eight value bits of each entry, which are 128 to 255."""
    bits = np.zeros((*high.shape, 9), np.uint8)
    bits[..., 1:] = np.unpackbits(high[..., None], axis=-1)
    return bits


def encode_frame(payload: bytes) -> bytes:
    """One image that holds ``payload``, whose length is a multiple of 64."""
    n = len(payload) // 64
    mcus = max(1, -(-n // 6))
    wide = int(np.ceil(np.sqrt(mcus)))
    high = -(-mcus // wide)
    blocks = np.zeros((6 * wide * high, 64), np.uint8)
    blocks[:n] = np.frombuffer(payload, np.uint8).reshape(n, 64)
    count = 4 * wide * high
    planes = {1: blocks[:count], 2: blocks[count : count + wide * high], 3: blocks[count + wide * high :]}
    frame = bytes([8]) + (16 * high).to_bytes(2, "big") + (16 * wide).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [
        b"\xff\xd8", segment(0xFE, b"payload " + str(len(payload)).encode()), segment(0xDB, bytes([0]) + bytes([1]) * 64), segment(0xC2, frame),
        huffman(0, 0, {1: [8]}), huffman(1, 0, {1: [0x08]}), huffman(1, 1, {4: [k << 4 for k in range(15)]}),
        segment(0xDD, (1).to_bytes(2, "big")),
    ]
    for c, b in planes.items():
        # A restart after each block, so that the DC coefficient itself is coded. 9 bits, 7 ones.
        body = coded(128 + (b[:, 0] >> 1))
        two = np.packbits(np.concatenate([body, np.ones((len(b), 7), np.uint8)], axis=1), axis=1)
        rows = np.zeros((len(b), 6), np.uint8)
        rows[:, [0, 2]], rows[:, 4] = two, 0xFF
        rows[:, 5] = 0xD0 + np.arange(len(b)) % 8
        keep = np.ones((len(b), 6), bool)
        keep[:, 1], keep[:, 3] = two[:, 0] == 0xFF, two[:, 1] == 0xFF
        keep[-1, 4:] = False
        out.append(scan([c], 0, 0, 0, 1, 0x00, rows[keep].tobytes()))
    out.append(segment(0xDD, (0).to_bytes(2, "big")))
    for c, b in planes.items():
        for ss, se in ((1, 5), (6, 63)) if c == 1 else ((1, 63),):
            out.append(scan([c], ss, se, 0, 1, 0x00, stuffed(packed(coded(128 + (b[:, ss : se + 1] >> 1)).reshape(-1)))))
    for c, b in planes.items():
        parts = []
        for lo in range(0, len(b), RUN):
            some = b[lo : lo + RUN]
            k = len(some).bit_length() - 1
            parts.append(np.array([int(x) for x in f"{k:04b}" + (f"{len(some) - (1 << k):0{k}b}" if k else "")], np.uint8))
            parts.append((some[:, 1:] & 1).reshape(-1))
        out.append(scan([c], 1, 63, 1, 0, 0x01, stuffed(packed(np.concatenate(parts)))))
    for c, b in planes.items():
        out.append(scan([c], 0, 0, 1, 0, 0x00, stuffed(packed(b[:, 0] & 1))))
    return b"".join([*out, b"\xff\xd9"])


def encode(payload: bytes) -> bytes:
    """Images, one after the other, that hold ``payload``; its length is a positive multiple of 64."""
    return b"".join(encode_frame(payload[at : at + FRAME]) for at in range(0, len(payload), FRAME))


@dataclass
class Bits:
    """A reader over one restart interval's bits."""

    bits: np.ndarray
    at: int = 0

    def take(self, n: int) -> int:
        v = 0
        for b in self.bits[self.at : self.at + n].tolist():
            v = v << 1 | b
        v <<= max(0, self.at + n - len(self.bits))
        self.at += n
        return v

    def many(self, n: int) -> np.ndarray:
        got = self.bits[self.at : self.at + n]
        self.at += n
        return got if len(got) == n else np.concatenate([got, np.zeros(n - len(got), np.uint8)])

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | (int(self.bits[self.at]) if self.at < len(self.bits) else 1)
            self.at += 1
            if (s := table.get((n, code))) is not None:
                return s
        raise ValueError("bad Huffman code")


@dataclass
class Component:
    h: int
    v: int
    quant: int
    wide: int = 0
    high: int = 0
    own_wide: int = 0
    own_high: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


def extend(v: int, n: int) -> int:
    return v if not n or v >> (n - 1) else v - (1 << n) + 1


def canonical(body: bytes) -> Iterator[tuple[int, dict[tuple[int, int], int]]]:
    at = 0
    while at < len(body):
        counts, code, k, table = body[at + 1 : at + 17], 0, at + 17, {}
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                table[n, code] = body[k]
                code, k = code + 1, k + 1
            code <<= 1
        yield body[at], table
        at = k


class Decoder:
    """Accumulates the scans of one progressive image."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.raw = data, np.frombuffer(data, np.uint8)
        self.ff = np.flatnonzero(self.raw[:-1] == 0xFF)
        self.after = self.raw[self.ff + 1]
        self.stops = self.ff[(self.after != 0) & (self.after != 0xFF) & ((self.after < 0xD0) | (self.after > 0xD7))]
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[int, dict] = {}
        self.parts: dict[int, Component] = {}
        self.comment, self.restart = b"", 0
        self.end = self.read(at)

    def read(self, at: int) -> int:
        if self.data[at : at + 2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        at += 2
        while True:
            while self.data[at + 1] == 0xFF:
                at += 1
            marker = self.data[at + 1]
            if marker == 0xD9:
                return at + 2
            size = int.from_bytes(self.data[at + 2 : at + 4], "big")
            body = self.data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    self.quant[body[k] & 15] = np.frombuffer(body[k + 1 : k + 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.float32)
                    k += 1 + 64 * (1 + wide)
            elif marker == 0xC4:
                self.tables.update(canonical(body))
            elif marker == 0xC2:
                self.frame(body)
            elif marker == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                at = self.scan(body, at)
            elif 0xC0 <= marker <= 0xCF:
                raise ValueError(f"only progressive Huffman JPEG is read, not SOF {marker:#x}")

    def frame(self, body: bytes) -> None:
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        for k in range(body[5]):
            i, hv, q = body[6 + 3 * k : 9 + 3 * k]
            self.parts[i] = Component(hv >> 4, hv & 15, q)
        self.h, self.v = max(c.h for c in self.parts.values()), max(c.v for c in self.parts.values())
        self.mcu_wide, self.mcu_high = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c in self.parts.values():
            c.wide, c.high = self.mcu_wide * c.h, self.mcu_high * c.v
            c.own_wide, c.own_high = -(-(-(-self.width * c.h // self.h)) // 8), -(-(-(-self.height * c.v // self.v)) // 8)
            c.coefficients = np.zeros((c.wide * c.high, 64), np.int32)

    def intervals(self, at: int) -> tuple[list[tuple[int, int]], np.ndarray, int]:
        """Restart intervals as ranges of the scan's bytes without stuffing and markers; the scan's end."""
        d, k = self.raw, np.searchsorted(self.stops, at)
        end = int(self.stops[k]) if k < len(self.stops) else len(d)
        lo, hi = np.searchsorted(self.ff, (at, end))
        if lo == hi:
            return [(0, end - at)], d[at:end], end
        ff, after = self.ff[lo:hi], self.after[lo:hi]
        keep = np.ones(end - at, bool)
        keep[ff[after == 0] + 1 - at] = False
        marks = ff[(after >= 0xD0) & (after <= 0xD7)] - at
        keep[marks] = keep[marks + 1] = False
        place = np.cumsum(keep)
        cuts = [0, *(place[marks]).tolist(), int(place[-1]) if len(place) else 0]
        return list(zip(cuts[:-1], cuts[1:], strict=True)), d[at:end][keep], end

    def order(self, ids: list[int]) -> tuple[list[tuple[int, np.ndarray]], int]:
        """For one component its blocks in raster order; for several those of each MCU. And how many MCUs."""
        if len(ids) == 1:
            c = self.parts[ids[0]]
            return [(ids[0], (np.arange(c.own_high)[:, None] * c.wide + np.arange(c.own_wide)).reshape(-1, 1))], c.own_high * c.own_wide
        out = []
        for i in ids:
            c = self.parts[i]
            y, x = np.arange(self.mcu_high)[:, None] * c.v, np.arange(self.mcu_wide)[None, :] * c.h
            inside = (np.arange(c.v)[:, None] * c.wide + np.arange(c.h)).reshape(-1)
            out.append((i, (y * c.wide + x).reshape(-1, 1) + inside))
        return out, self.mcu_wide * self.mcu_high

    def scan(self, body: bytes, at: int) -> int:
        n = body[0]
        ids = [body[1 + 2 * k] for k in range(n)]
        slots = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(n)}
        ss, se, al, ah = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] & 15, body[3 + 2 * n] >> 4
        ranges, data, end = self.intervals(at)
        order, mcus = self.order(ids)
        every = self.restart or mcus
        if ss == 0 and ah:
            for k, (a, b) in enumerate(ranges):
                blocks = np.concatenate([o[k * every : (k + 1) * every] + 0 for _, o in order], axis=1) if n == 1 else None
                self.dc_refine(order, k * every, (k + 1) * every, blocks, np.unpackbits(data[a:b]), al)
        elif ss == 0:
            self.dc_first(order, slots, ranges, data, every, al)
        else:
            blocks, c = order[0][1][:, 0], self.parts[ids[0]]
            table = self.tables[0x10 | slots[ids[0]] & 15]
            for k, (a, b) in enumerate(ranges):
                bits = Bits(np.unpackbits(data[a:b]))
                (self.ac_refine if ah else self.ac_first)(c.coefficients, blocks[k * every : (k + 1) * every], ss, se, al, table, bits)
        return end

    def dc_refine(self, order: list, lo: int, hi: int, blocks: np.ndarray | None, bits: np.ndarray, al: int) -> None:
        at = 0
        if blocks is not None:
            own = blocks[:, 0]
            self.parts[order[0][0]].coefficients[own, 0] |= bits[: len(own)].astype(np.int32) << al
            return
        for m in range(lo, min(hi, len(order[0][1]))):
            for i, o in order:
                for b in o[m]:
                    self.parts[i].coefficients[b, 0] |= int(bits[at]) << al
                    at += 1

    def dc_first(self, order: list, slots: dict, ranges: list, data: np.ndarray, every: int, al: int) -> None:
        i, blocks = order[0]
        table = self.tables[slots[i] >> 4]
        if len(order) == 1 and every == 1 and list(table) == [(1, 0)] and len(ranges) == len(blocks):
            size, (first, last) = table[1, 0], ranges[0]
            if all(b - a == last - first for a, b in ranges) and 8 * (last - first) > size:
                bits = np.unpackbits(data.reshape(len(ranges), last - first), axis=1)[:, 1 : 1 + size]
                self.parts[i].coefficients[blocks[:, 0], 0] = self.values(bits) << al
                return
        for k, (a, b) in enumerate(ranges):
            bits, last = Bits(np.unpackbits(data[a:b])), {}
            for m in range(k * every, min((k + 1) * every, len(blocks))):
                for i, o in order:
                    for block in o[m]:
                        n = bits.symbol(self.tables[slots[i] >> 4])
                        last[i] = last.get(i, 0) + extend(bits.take(n), n)
                        self.parts[i].coefficients[block, 0] = last[i] << al

    @staticmethod
    def values(bits: np.ndarray) -> np.ndarray:
        """Signed values of equally long bit fields in the last axis."""
        n = bits.shape[-1]
        if n <= 8:
            v = (np.packbits(bits, axis=-1)[..., 0] >> (8 - n)).astype(np.int32)
        else:
            v = np.zeros(bits.shape[:-1], np.int32)
            for k in range(n):
                v = v << 1 | bits[..., k]
        return np.where(v >> (n - 1), v, v - (1 << n) + 1)

    def ac_first(self, out: np.ndarray, blocks: np.ndarray, ss: int, se: int, al: int, table: dict, bits: Bits) -> None:
        if list(table) == [(1, 0)] and 0 < (size := table[1, 0]) < 16:
            shape = (len(blocks), se - ss + 1, 1 + size)
            if len(bits.bits) >= (n := shape[0] * shape[1] * shape[2]) and not (b := bits.bits[:n].reshape(shape))[..., 0].any():
                out[blocks, ss : se + 1] = self.values(b[..., 1:]) << al
                return
        run = 0
        for block in blocks.tolist():
            if run:
                run -= 1
                continue
            k = ss
            while k <= se:
                rs = bits.symbol(table)
                r, n = rs >> 4, rs & 15
                if n:
                    k += r
                    out[block, k] = extend(bits.take(n), n) * (1 << al)
                    k += 1
                elif r == 15:
                    k += 16
                else:
                    run = (1 << r) + (bits.take(r) if r else 0) - 1
                    break

    def ac_refine(self, out: np.ndarray, blocks: np.ndarray, ss: int, se: int, al: int, table: dict, bits: Bits) -> None:
        one, at = 1 << al, 0

        def correct(rows: np.ndarray, lo: int) -> None:
            """A bit for each coefficient from place ``lo`` on that has a value already, in order."""
            got = out[rows, lo : se + 1]
            set_ = got != 0
            fix = np.zeros(got.shape, np.int32)
            fix[set_] = bits.many(int(np.count_nonzero(set_)))
            out[rows, lo : se + 1] = got + np.sign(got) * (fix << al)

        while at < len(blocks):
            row, k = blocks[at], ss
            while k <= se:
                rs = bits.symbol(table)
                r, n = rs >> 4, rs & 15
                if not n and r < 15:
                    run = (1 << r) + (bits.take(r) if r else 0)
                    correct(blocks[at : at + 1], k)
                    correct(blocks[at + 1 : at + run], ss)
                    at += run - 1
                    break
                new = (one if bits.take(1) else -one) if n else 0
                while k <= se:
                    if out[row, k]:
                        if bits.take(1):
                            out[row, k] += one if out[row, k] > 0 else -one
                    elif r == 0:
                        out[row, k] = new
                        k += 1
                        break
                    else:
                        r -= 1
                    k += 1
            at += 1

    def plane(self, c: Component) -> np.ndarray:
        """Samples of a component, 0 to 255."""
        s = (c.coefficients * self.quant[c.quant]).astype(np.float32) @ IDCT + 128.0
        s = np.clip(np.rint(s), 0, 255).reshape(c.high, c.wide, 8, 8)
        return s.swapaxes(1, 2).reshape(8 * c.high, 8 * c.wide)

    def rgb(self) -> np.ndarray:
        """The image as height x width x 3 bytes, chroma upsampled by repetition."""
        planes = []
        for c in self.parts.values():
            p = self.plane(c)
            p = p if c.v == self.v else np.repeat(p, self.v // c.v, axis=0)
            p = p if c.h == self.h else np.repeat(p, self.h // c.h, axis=1)
            planes.append(p[: self.height, : self.width])
        if len(planes) == 1:
            planes *= 3
            return np.stack(planes, axis=-1).astype(np.uint8)
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        channels = (y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)
        return np.stack([np.clip(np.rint(x), 0, 255) for x in channels], axis=-1).astype(np.uint8)

    def payload(self) -> bytes:
        n = int(self.comment.removeprefix(b"payload "))
        return np.concatenate([c.coefficients for c in self.parts.values()]).reshape(-1)[:n].__sub__(BASE).astype(np.uint8).tobytes()


def frames(media: bytes) -> Iterator[Decoder]:
    at = 0
    while at < len(media):
        d = Decoder(media, at)
        at = d.end
        yield d


def feature(tensors: Iterator[np.ndarray]) -> str:
    """Size and mean colour of each image: heightxwidth:red,green,blue in thousandths."""
    means = lambda t: ",".join(str(int(x) * 1000 // (t.shape[0] * t.shape[1])) for x in t.reshape(-1, 3).sum(axis=0, dtype=np.int64))
    return ";".join(f"{t.shape[0]}x{t.shape[1]}:{means(t)}" for t in tensors)


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def media_columns(docs: DataFrame, tensors: bool = True) -> DataFrame:
    """doc_id, n_bytes, media, payload, feature and tensors (an array of height, width, RGB bytes).

    A text's UTF-8 bytes (null: none) are padded with zeros to a positive multiple of 64 and stored;
    payload, feature and tensors come from the stored bytes. A row's result depends on its text alone, so
    there are no ties and repeated rows, shared or null ids give repeated results; a text of any length
    is stored, over FRAME bytes as several images. Other columns are ignored, an empty table gives an
    empty result. Without ``tensors`` their column is left out.
    """
    prepare(docs.sparkSession)
    cell = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])
    schema = "doc_id bigint, n_bytes bigint, media binary, payload binary, feature string"
    schema += ", tensors array<struct<height: int, width: int, rgb: binary>>" if tensors else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                media = encode(padded(text))
                read = list(frames(media))
                images = [d.rgb() for d in read]
                payload = b"".join(d.payload() for d in read)
                row = [doc_id, len(text), media, payload, feature(images)]
                if tensors:
                    row.append([{"height": t.shape[0], "width": t.shape[1], "rgb": t.tobytes()} for t in images])
                rows.append(row)
                size += len(media) + len(payload) + sum(t.nbytes for t in images) * tensors
                if size > 4 << 20:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    def made(rows: list) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.list_(cell)]
        names = ["doc_id", "n_bytes", "media", "payload", "feature", "tensors"][: 5 + tensors]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types)], names)  # noqa: B905

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), schema)
