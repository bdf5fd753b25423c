import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from semblance.llm import media as M


@given(st.lists(st.binary(max_size=2000), min_size=1, max_size=5))
@settings(max_examples=30, deadline=None)
def test_round_trip(parts):
    data = [p + b"\xff" * (-len(p) % 576 or (576 if not p else 0)) for p in parts]
    images = [M.parse(M.encode(d)) for d in data]
    assert [M.unpack(i, b) for i, b in zip(images, M.decode(images), strict=True)] == data


class Bits:
    def __init__(self):
        self.s = ""

    def put(self, value, n):
        self.s += format(value, f"0{n}b") if n else ""

    def bytes(self):
        s = self.s + "1" * (-len(self.s) % 8)
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\x00")


def amplitude(v):
    n = abs(v).bit_length()
    return (v if v >= 0 else v + (1 << n) - 1), n


def test_a_file_of_three_components_with_runs_and_restarts():
    """Written block by block from the format's definition: 4:2:0 sampling, end-of-block and long zero runs."""
    rng = np.random.default_rng(3)
    symbols = [0x00, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 8)]
    spec = lambda sym, n: bytes([0] * (n - 1) + [len(sym)] + [0] * (16 - n)) + bytes(sym)
    dc, ac = spec(list(range(12)), 4), spec(symbols, 7)
    parts = [(1, 2, 2, 0), (2, 1, 1, 1), (3, 1, 1, 1)]
    layout, want, scan, rst = [0, 0, 0, 0, 1, 2], [], b"", 0
    for start in range(0, 6, 2):  # two units in each restart interval
        bits, previous = Bits(), [0, 0, 0]
        for _ in range(2):
            for c in layout:
                block = np.zeros(64, dtype=int)
                block[0] = rng.integers(-100, 100)
                at = rng.choice(np.arange(1, 64), rng.integers(0, 6), replace=False)
                block[at] = rng.integers(1, 100, len(at)) * rng.choice([-1, 1], len(at))
                want.append(block)
                value, n = amplitude(int(block[0]) - previous[c])
                previous[c] = int(block[0])
                bits.put(n, 4)
                bits.put(value, n)
                run = 0
                for k in range(1, 64):
                    if block[k] == 0:
                        run += 1
                        continue
                    while run > 15:
                        bits.put(symbols.index(0xF0), 7)
                        run -= 16
                    value, n = amplitude(int(block[k]))
                    bits.put(symbols.index(run << 4 | n), 7)
                    bits.put(value, n)
                    run = 0
                if run:
                    bits.put(0, 7)
        scan += bits.bytes() + (bytes([0xFF, 0xD0 + rst]) if start < 4 else b"")
        rst += 1
    seg = M._segment
    file = b"".join([
        b"\xff\xd8", seg(0xDB, bytes([0]) + bytes([3] * 64) + bytes([1]) + bytes([5] * 64)), seg(0xC0, struct.pack(">BHHB", 8, 30, 44, 3) + b"".join(bytes([i, h << 4 | v, q]) for i, h, v, q in parts)),
        seg(0xC4, bytes([0x00]) + dc + bytes([0x10]) + ac), seg(0xDD, struct.pack(">H", 2)), seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])), scan, b"\xff\xd9"])
    image = M.parse(file)
    assert image.mcus == (2, 3)
    (blocks,) = M.decode([image])
    assert (blocks == np.array(want)).all()
    grey = M.thumbnail(image, blocks)
    assert grey.shape == (4, 6)
    first = [want[i][0] for i in range(4)]  # the four luminance blocks of the first unit
    level = lambda d: min(255, max(0, (d * 3 + 4 >> 3) + 128))
    assert grey[0, 0] == level(first[0]) and grey[0, 1] == level(first[1]) and grey[1, 0] == level(first[2])


def test_table(spark, odd):
    got = M.read(M.store(odd)).collect()
    assert len(got) == odd.count()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in got:
        data = M.payload(texts[r["doc_id"]])
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        assert r["n_bytes"] == len((texts[r["doc_id"]] or "").encode())
    by = {}
    for r in got:
        by.setdefault(texts[r["doc_id"]] or "", set()).add((r["feature"], r["media_sha256"]))
    assert all(len(x) == 1 for x in by.values())
    assert M.read(M.store(odd.limit(0))).count() == 0


def test_broken_files():
    good = M.encode(M.payload("x"))
    for bad in (b"", b"\xff\xd8", good[:100], good[:2] + b"\xff\xc2" + good[4:], good[:-40] + b"\xff\xd9"):
        with pytest.raises(ValueError):
            M.decode([M.parse(bad)])
    with pytest.raises(ValueError):
        M.encode(b"x")


def test_zigzag():
    assert M.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and M.ZIGZAG[-1] == 63
