"""Media columns as baseline JPEG: a text's bytes stored in quantised coefficients, parsed back and summarised.

The writer makes a real one-component baseline JPEG. Its unit is the quantised coefficient: the 64 bytes of a
block are 64 coefficients of 256 + byte, all of size category 9, so each Huffman code table has one symbol and
a block is 640 bits. Every block is a restart interval, which lets the reader decode all blocks of many images
side by side. A comment segment keeps the number of payload bytes, as blocks may pad the last row of tiles.

The reader is general: it parses the markers, builds the code tables of the file, and Huffman-decodes the scan
(several interleaved components, subsampling, restart intervals) in lock step over all restart intervals of a batch,
one numpy step for each coefficient. From the DC values alone it makes the luminance thumbnail, its dimensions
and two hashes. Progressive, arithmetic and 12-bit files are refused.

Defined cases: a null text is empty; the empty text has one unit of padding; equal texts give equal files and
features; a payload over MAX_PAYLOAD is refused (an image has 65535 pixels a side at most); broken files raise
ValueError; repeated rows are stored one by one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.llm.common import table

#: A tile is 24 x 24 pixels: 9 blocks of 64 coefficients.
UNIT = 576
PAD = 255
SHIFT = 256
MAX_TILES = 65535 // 24
MAX_PAYLOAD = MAX_TILES * MAX_TILES * UNIT
#: Payload bytes that are decoded together.
BATCH_BYTES = 3 << 20
#: Texts that are written together.
TEXTS = 512

#: Zigzag: the place (row * 8 + column) of the n-th coefficient of a block, along the anti-diagonals by turns.
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))])


def payload(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes([PAD]) * (UNIT * max(1, -(-len(data) // UNIT)) - len(data))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(data: bytes) -> bytes:
    """A baseline JPEG that holds data (a positive multiple of UNIT bytes)."""
    tiles = len(data) // UNIT
    if not tiles or len(data) % UNIT or len(data) > MAX_PAYLOAD:
        raise ValueError(f"a payload has {UNIT} to {MAX_PAYLOAD} bytes in steps of {UNIT}")
    wide = -(-tiles // MAX_TILES)
    high = -(-tiles // wide)
    raw = np.frombuffer(data, dtype=np.uint8)
    blocks = np.full((wide * high * 9, 64), PAD, dtype=np.uint8)
    blocks.reshape(-1)[: len(raw)] = raw
    # each coefficient is code 0, then 1 and the byte: 10 bits, four of them in five bytes
    bits = (blocks.astype(np.uint64) | np.uint64(256)).reshape(len(blocks), 16, 4)
    packed = (bits[..., 0] << np.uint64(30)) | (bits[..., 1] << np.uint64(20)) | (bits[..., 2] << np.uint64(10)) | bits[..., 3]
    body = packed.astype(">u8").view(np.uint8).reshape(len(blocks), 16, 8)[..., 3:].reshape(len(blocks), 80)
    # a restart marker behind each block but the last, and a zero behind each 255 of the scan
    marks = np.stack([np.full(len(blocks), 0xFF), 0xD0 + np.arange(len(blocks)) % 8], axis=1).astype(np.uint8)
    scan = np.concatenate([body, marks], axis=1)
    flat, is_data = scan.reshape(-1)[:-2], np.tile(np.arange(82) < 80, len(blocks))[:-2]
    stuff = np.flatnonzero((flat == 0xFF) & is_data)
    if len(stuff):
        flat = np.insert(flat, stuff + 1, 0)
    one_code = lambda kind, symbol: bytes([kind, 1, *[0] * 15, symbol])
    head = b"".join([
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"),
        _segment(0xFE, struct.pack(">Q", len(data))),
        _segment(0xDB, bytes([0]) + b"\x01" * 64),
        _segment(0xC0, struct.pack(">BHHB", 8, 24 * high, 24 * wide, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, one_code(0x00, 9)),
        _segment(0xC4, one_code(0x10, 9)),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])
    return head + flat.tobytes() + b"\xff\xd9"


@dataclass
class Component:
    id: int
    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Image:
    width: int = 0
    height: int = 0
    restart: int = 0
    comment: bytes = b""
    scan: bytes = b""
    components: list[Component] = field(default_factory=list)
    quants: dict[int, tuple[int, ...]] = field(default_factory=dict)
    codes: dict[int, bytes] = field(default_factory=dict)

    @property
    def mcus(self) -> tuple[int, int]:
        """Rows and columns of the units that the scan holds."""
        if len(self.components) == 1:
            return -(-self.height // 8), -(-self.width // 8)
        h, v = max(c.h for c in self.components), max(c.v for c in self.components)
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))

    @property
    def layout(self) -> list[int]:
        """The component of each block of a unit."""
        return [0] if len(self.components) == 1 else [i for i, c in enumerate(self.components) for _ in range(c.h * c.v)]


def parse(data: bytes) -> Image:
    """The segments of a baseline file with one scan."""
    image, at = Image(), 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    try:
        while True:
            if data[at] != 0xFF:
                raise ValueError(f"no marker at byte {at}")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if marker == 0xD9:
                raise ValueError("no scan")
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    image.quants[body[0] & 15] = struct.unpack(f">64{'H' if wide == 2 else 'B'}", body[1 : 1 + 64 * wide])
                    body = body[1 + 64 * wide :]
            elif marker == 0xC0 or marker == 0xC1:
                bits, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
                if bits != 8:
                    raise ValueError(f"{bits} bits a sample")
                image.components = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError(f"not a baseline file: marker {marker:#x}")
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    image.codes[body[0]] = body[1:n]
                    body = body[n:]
            elif marker == 0xDD:
                image.restart = int.from_bytes(body, "big")
            elif marker == 0xFE:
                image.comment = body
            elif marker == 0xDA:
                if body[0] != len(image.components) or not image.components:
                    raise ValueError("several scans")
                by_id = {c.id: c for c in image.components}
                for i in range(body[0]):
                    c = by_id[body[1 + 2 * i]]
                    c.dc, c.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
                end = data.rfind(b"\xff\xd9")
                image.scan = data[at : end if end >= at else len(data)]
                return image
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError(f"broken file: {e!r}") from e


def code_table(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit prefix the length of its code (0: none) and its symbol."""
    lengths, symbols = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
    code, k = 0, 16
    for n in range(1, 17):
        for _ in range(spec[n - 1]):
            at = code << (16 - n)
            lengths[at : at + (1 << (16 - n))] = n
            symbols[at : at + (1 << (16 - n))] = spec[k]
            code, k = code + 1, k + 1
        code <<= 1
    return lengths, symbols


class _Bits:
    """Bit readers at many places of one buffer."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
        # the 32 bits from each byte on
        self.window = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
        self.at = starts * 8
        self.end = ends * 8

    def peek16(self, who: np.ndarray) -> np.ndarray:
        at = self.at[who]
        return ((self.window[at >> 3] >> (16 - (at & 7)).astype(np.uint32)) & 0xFFFF).astype(np.int64)

    def symbols(self, who: np.ndarray, codes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        prefix = self.peek16(who)
        n = codes[0][prefix]
        if (n == 0).any():
            raise ValueError("broken scan: no such code")
        self.at[who] += n
        return codes[1][prefix]

    def values(self, who: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of the given size categories (0: nothing is read)."""
        bits = self.peek16(who) >> (16 - size)
        self.at[who] += size
        if (self.at[who] > self.end[who]).any():
            raise ValueError("broken scan: it ends early")
        return np.where(bits >> np.maximum(size - 1, 0), bits, bits - (1 << size) + 1)


def decode_scans(images: list[Image]) -> list[np.ndarray]:
    """Quantised coefficients (blocks x 64, in the order of the scan) of images with equal tables and layout."""
    first = images[0]
    dc = [code_table(first.codes[c.dc]) for c in first.components]
    ac = [code_table(first.codes[0x10 | c.ac]) for c in first.components]
    layout = first.layout
    data = np.frombuffer(b"".join(i.scan for i in images), dtype=np.uint8)
    bounds = np.cumsum([0, *(len(i.scan) for i in images)])
    # markers end intervals, and a zero behind 255 is dropped
    full = np.flatnonzero(data[:-1] == 0xFF) if len(data) else np.zeros(0, np.int64)
    marks = full[(data[full + 1] >= 0xD0) & (data[full + 1] <= 0xD7)]
    keep = np.ones(len(data), dtype=bool)
    keep[full[data[full + 1] == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    kept = np.concatenate([[0], np.cumsum(keep)])
    starts, counts, block_of, total = [], [], [], 0
    totals = []
    for k, image in enumerate(images):
        own = marks[np.searchsorted(marks, bounds[k]) : np.searchsorted(marks, bounds[k + 1])]
        rows, cols = image.mcus
        units = rows * cols
        step = image.restart or units
        n = -(-units // step)
        if len(own) != n - 1:
            raise ValueError(f"broken scan: {len(own) + 1} intervals of {n}")
        starts.append(np.concatenate([[bounds[k]], own + 2]))
        counts.append(np.minimum(step, units - step * np.arange(n)))
        block_of.append(total + step * np.arange(n) * len(layout))
        totals.append(total)
        total += units * len(layout)
    begin = kept[np.concatenate(starts)]
    bits = _Bits(data[keep], begin, np.append(begin[1:], kept[-1]))
    count, block = np.concatenate(counts), np.concatenate(block_of)
    out = np.zeros((total, 64), dtype=np.int16)
    previous = np.zeros((len(count), len(first.components)), dtype=np.int64)
    for unit in range(int(count.max())):
        live = np.flatnonzero(count > unit)
        for place, c in enumerate(layout):
            row = block[live] + unit * len(layout) + place
            size = bits.symbols(live, dc[c])
            previous[live, c] += bits.values(live, size)
            out[row, 0] = previous[live, c]
            who, to, at = live, row, np.ones(len(live), dtype=np.int64)
            while len(who):
                symbol = bits.symbols(who, ac[c])
                run, size = symbol >> 4, symbol & 15
                stop = symbol == 0
                at = np.where(stop, 64, at + run)
                value = bits.values(who, size)
                put = size > 0
                if (at[put] > 63).any():
                    raise ValueError("broken scan: a block has over 64 values")
                out[to[put], at[put]] = value[put]
                at += 1
                go = at < 64
                if not go.all():
                    who, to, at = who[go], to[go], at[go]
    return [out[a:b] for a, b in zip(totals, [*totals[1:], total], strict=True)]


def decode(images: list[Image]) -> list[np.ndarray]:
    """As decode_scans, of any images: those with equal tables go together."""
    groups: dict[tuple, list[int]] = defaultdict(list)
    for k, i in enumerate(images):
        groups[(tuple(sorted(i.codes.items())), tuple((c.h, c.v, c.dc, c.ac) for c in i.components))].append(k)
    out: list[np.ndarray] = [np.zeros(0)] * len(images)
    for members in groups.values():
        for k, blocks in zip(members, decode_scans([images[k] for k in members]), strict=True):
            out[k] = blocks
    return out


def thumbnail(image: Image, blocks: np.ndarray) -> np.ndarray:
    """Luminance of each 8 x 8 block from its DC value, as rows of bytes."""
    luma = image.components[0]
    step = image.quants[luma.quant][0]
    rows, cols = image.mcus
    h, v = (1, 1) if len(image.components) == 1 else (luma.h, luma.v)
    dc = blocks[:, 0].astype(np.int64).reshape(rows, cols, -1)[:, :, : h * v].reshape(rows, cols, v, h)
    grey = np.clip((dc * step + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    return grey.transpose(0, 2, 1, 3).reshape(rows * v, cols * h)[: -(-image.height // 8), : -(-image.width // 8)]


def hashes(thumb: np.ndarray) -> tuple[int, int]:
    """Average hash and difference hash, 64 bits each, of the thumbnail brought to 8 x 9 by area."""

    def area(n: int, m: int) -> np.ndarray:
        """n means over m values."""
        edge = np.linspace(0, m, n + 1)
        low, high = edge[:-1, None], edge[1:, None]
        return np.clip(np.minimum(high, np.arange(m) + 1) - np.maximum(low, np.arange(m)), 0, None) * n / m

    small = np.round(area(8, thumb.shape[0]) @ thumb.astype(float) @ area(9, thumb.shape[1]).T, 6)
    bits = lambda x: int("".join("1" if b else "0" for b in x.ravel()), 2)
    return bits(small[:, :8] > small[:, :8].mean().round(6)), bits(small[:, 1:] > small[:, :-1])


def unpack(image: Image, blocks: np.ndarray) -> bytes:
    """The payload that `encode` stored."""
    n = int.from_bytes(image.comment, "big")
    return (blocks.reshape(-1)[:n] - SHIFT).astype(np.uint8).tobytes()


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media of every row of docs (doc_id, text)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                texts = part.column("text").to_pylist()
                sizes = pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, pa.array([encode(payload(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    # Arrow keeps a null and an id over 2^53 apart in one batch, which a pandas column of floats does not
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, "doc_id long, n_bytes long, media binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, feature string"


def read(media: DataFrame) -> DataFrame:
    """media (with a binary column media): its features and the digests of what it holds."""

    @F.pandas_udf(FEATURES)
    def features(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows, held, size = [], [], 0
            for m in part:
                held.append(bytes(m))
                size += len(m)
                if size > BATCH_BYTES:
                    rows += _summaries(held)
                    held, size = [], 0
            rows += _summaries(held) if held else []
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])

    return media.withColumn("_f", features("media")).select(*[c for c in media.columns if c != "media"], "_f.*")


def _summaries(files: list[bytes]) -> list[tuple]:
    images = [parse(f) for f in files]
    rows = []
    for f, image, blocks in zip(files, images, decode(images), strict=True):
        data, thumb = unpack(image, blocks), thumbnail(image, blocks)
        average, difference = hashes(thumb)
        feature = f"{image.width}x{image.height} thumb {thumb.shape[1]}x{thumb.shape[0]} a{average:016x} d{difference:016x} s{hashlib.sha256(thumb.tobytes()).hexdigest()[:16]}"
        rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(f), hashlib.sha256(f).hexdigest(), image.width, image.height, feature))
    return rows


def op5_media_columns(spark, sf_dir: str) -> DataFrame:
    out = read(store(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
