import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.llm import jpeg


def test_round_trip():
    rng = random.Random(1)
    payloads = [jpeg.pad(rng.randbytes(n)) for n in (0, 1, 63, 64, 65, 300, 9000)] + [b"\xff" * 640, jpeg.pad(b"\x00\xff" * 3000)]
    payloads.append(jpeg.pad(rng.randbytes(700_000)))  # wider than one column of blocks
    assert [jpeg.payload_of(x) for x in jpeg.decode(jpeg.encode(payloads))] == payloads


class Bits:
    """A plain writer of Huffman codes, for images the encoder doesn't make."""

    def __init__(self):
        self.s = ""

    def put(self, code, n):
        self.s += format(code, f"0{n}b") if n else ""

    def done(self):
        s = self.s + "1" * (-len(self.s) % 8)
        return bytes(int(s[k : k + 8], 2) for k in range(0, len(s), 8)).replace(b"\xff", b"\xff\x00")


def test_colour_image_with_ac_terms():
    """4:2:0 colour with AC terms and restarts, against the DC terms that went in."""
    rng = random.Random(5)
    dc_table, ac_table = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))), ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 0, 0), (1, 2, 3, 0, 4, 17, 5, 18, 33, 49, 65, 6, 19, 81, 97, 7, 34, 113, 20, 50, 129, 145, 161, 8, 35, 66, 177, 193, 21, 82, 209, 240, 36, 51, 98, 114))
    dc, ac = jpeg._codes(*dc_table), jpeg._codes(*ac_table)
    across, down = 3, 2
    want, scan = np.zeros((down * 2, across * 2), int), b""
    for unit in range(across * down):
        if unit % 3 == 0:
            bits, pred = Bits(), [0, 0, 0]
            scan += b"\xff" + bytes([0xD0 + (unit // 3 - 1) % 8]) if unit else b""
        for c, n in ((0, 4), (1, 1), (2, 1)):
            for b in range(n):
                value = rng.randrange(-100, 100)
                if c == 0:
                    want[unit // across * 2 + b // 2, unit % across * 2 + b % 2] = value
                d, pred[c] = value - pred[c], value
                cat = abs(d).bit_length()
                bits.put(*dc[cat])
                bits.put(d if d > 0 else d + (1 << cat) - 1, cat)
                k = 1
                while k < 64 and rng.random() < 0.7:
                    run = rng.choice([0, 0, 1, 2, 15])
                    if run == 15:
                        bits.put(*ac[240])
                        k += 16
                        continue
                    v = rng.choice([-1, 1])
                    if k + run > 62:
                        break
                    bits.put(*ac[run << 4 | 1])
                    bits.put(1 if v > 0 else 0, 1)
                    k += run + 1
                if k < 64:
                    bits.put(*ac[0])
        if unit % 3 == 2:
            scan += bits.done()
    seg = jpeg._segment
    data = b"\xff\xd8" + seg(0xDB, b"\x00" + b"\x10" + b"\x01" * 63) + seg(0xC0, b"\x08" + (down * 16).to_bytes(2, "big") + (across * 16).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00")
    data += seg(0xC4, b"\x00" + bytes(dc_table[0]) + bytes(dc_table[1])) + seg(0xC4, b"\x10" + bytes(ac_table[0]) + bytes(ac_table[1])) + seg(0xDD, (3).to_bytes(2, "big")) + seg(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00") + scan + b"\xff\xd9"
    ((image, thumb),) = jpeg.decode([data])[0]
    assert (image.width, image.height) == (48, 32)
    assert (thumb == np.clip((want * 16 + 1028) // 8, 0, 255)).all()
    with pytest.raises(ValueError):
        jpeg.Image(data.replace(b"\xff\xc0", b"\xff\xc2"))


def test_query_columns(spark):
    texts = ["", None, "x" * 64, "x" * 64, "é" * 1000, "ab\n" * 70_000]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] + [(None, "q", "c")], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in jpeg.features(jpeg.store(docs)).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + bytes(64 if not raw else -len(raw) % 64)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[2][1:] == got[3][1:] and got[0][1:] == got[1][1:] and None in got
    assert jpeg.features(jpeg.store(docs.filter(F.lit(False)))).count() == 0


def test_long_payloads_take_little_memory():
    import tracemalloc

    payload = np.random.default_rng(5).integers(32, 127, 16 << 20, dtype=np.uint8).tobytes()
    tracemalloc.start()
    try:
        stored = jpeg.encode([payload, payload[:64]])
        assert [jpeg.payload_of(x) for x in jpeg.decode(stored)] == [payload, payload[:64]]
        assert tracemalloc.get_traced_memory()[1] < 300 << 20
    finally:
        tracemalloc.stop()
