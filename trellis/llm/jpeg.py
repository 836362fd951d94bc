"""Media columns in baseline JPEG (operator 3).

Decoder: markers are parsed, the scan is Huffman-decoded in numpy for all restart
intervals of a batch at once, and the DC terms of the luminance give a thumbnail of one
sample a block. Encoder: bytes become flat 8x8 blocks whose DC term is the byte, so that
the thumbnail of the stored image is the payload again, without loss; every row of blocks
is a restart interval.

Defined cases: a null text is an empty one, which is stored as 64 bytes 0. Texts above
FRAME bytes are stored as several images in a row, of which few are coded at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, MAX_ROWS, FRAME = 64, 8191, 1 << 20
BATCH = 512 << 10
#: Number of Huffman codes of each length 1 to 16, and the categories in order of their codes, of the encoder's DC table; its AC table has the end of block only.
DC_COUNTS = (0, 1, 4, 3, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = (7, 2, 3, 4, 5, 0, 1, 6, 8)
AC_COUNTS = (1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
AC_SYMBOLS = (0,)


def _codes(counts: tuple, symbols: tuple) -> dict[int, tuple[int, int]]:
    """symbol: (code, length), codes in canonical order."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _lookup(counts: tuple, symbols: tuple) -> np.ndarray:
    """By the next 16 bits: length * 256 + symbol; 0 for no code."""
    table = np.zeros(65536, np.int32)
    for s, (code, length) in _codes(counts, symbols).items():
        table[code << (16 - length) : (code + 1) << (16 - length)] = length * 256 + s
    return table


def _diff_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a block whose DC differs by -255..255 (index + 255), with its end of block."""
    dc, (eob, eob_len) = _codes(DC_COUNTS, DC_SYMBOLS), _codes(AC_COUNTS, AC_SYMBOLS)[0]
    bits, lens = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        code, n = dc[cat]
        bits[d + 255] = ((code << cat | (d if d >= 0 else d + (1 << cat) - 1)) << eob_len) | eob
        lens[d + 255] = n + cat + eob_len
    return bits, lens


_BITS, _LENS = _diff_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _header(width: int, rows: int, size: int) -> bytes:
    """Up to the scan; sizes in blocks. A comment keeps the number of payload bytes."""
    out = b"\xff\xd8" + _segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00") + _segment(0xFE, b"payload=%d" % size)
    out += _segment(0xDB, b"\x00" + b"\x08" + b"\x01" * 63)
    out += _segment(0xC0, b"\x08" + (rows * 8).to_bytes(2, "big") + (width * 8).to_bytes(2, "big") + b"\x01\x01\x11\x00")
    out += _segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS)) + _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS))
    return out + _segment(0xDD, width.to_bytes(2, "big")) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def _rows_to_scan(v: np.ndarray, last: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scan bytes of all rows of blocks one after the other, and each row's number of bytes.

    v: samples (rows, width); last: ends its image; turn: number of the row in its image, for the restart marker.
    """
    n, width = v.shape
    dc = v.astype(np.int16)
    diff = np.empty_like(dc)
    diff[:, 0] = dc[:, 0] - 128
    np.subtract(dc[:, 1:], dc[:, :-1], out=diff[:, 1:])
    at = diff.astype(np.int64) + 255
    lens = np.empty((n, width + 1), np.int64)
    lens[:, :width] = _LENS[at]
    total = lens[:, :width].sum(1)
    lens[:, width] = -total % 8  # filled up with ones
    bits = np.empty((n, width + 1), np.uint64)
    bits[:, :width] = _BITS[at]
    bits[:, width] = (1 << lens[:, width]) - 1
    nbytes = (total + lens[:, width]) // 8
    stride = (14 * width + 7) // 32 + 2
    pos = np.cumsum(lens, 1) - lens
    word = (np.arange(n)[:, None] * stride + (pos >> 5)).ravel()
    value = (bits << (64 - (pos & 31) - lens).astype(np.uint64)).ravel()
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    sums = np.add.reduceat(value, starts)
    words = np.zeros(n * stride + 1, np.uint64)
    words[word[starts]] += sums >> np.uint64(32)
    words[word[starts] + 1] += sums & np.uint64(0xFFFFFFFF)
    grid = np.zeros((n, stride * 4 + 2), np.uint8)
    grid[:, : stride * 4] = words[:-1].astype(">u4").view(np.uint8).reshape(n, stride * 4)
    r = np.arange(n)
    grid[r, nbytes] = 0xFF
    grid[r, nbytes + 1] = np.where(last, 0xD9, 0xD0 + turn % 8)
    cols = np.arange(grid.shape[1])
    flat = grid[cols < (nbytes + 2)[:, None]]
    ends = np.cumsum(nbytes + 2)
    stuff = flat == 0xFF
    stuff[ends - 2] = False
    moved = np.arange(flat.size) + np.cumsum(stuff) - stuff
    out = np.zeros(flat.size + int(stuff.sum()), np.uint8)
    out[moved] = flat
    row_bytes = nbytes + 2 + np.add.reduceat(stuff, np.concatenate(([0], ends[:-1])), dtype=np.int64)
    return out, row_bytes


def _portions(items: list, size: Callable[[object], int]) -> Iterator[list]:
    """items in order, in runs of one at least whose sizes add up to FRAME at most."""
    run, total = [], 0
    for x in items:
        if run and total + size(x) > FRAME:
            yield run
            run, total = [], 0
        run.append(x)
        total += size(x)
    if run:
        yield run


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stored form for each payload, whose lengths are positive multiples of 64."""
    frames = [(i, p[k : k + FRAME]) for i, p in enumerate(payloads) for k in range(0, len(p), FRAME)]
    out: list[list[bytes]] = [[] for _ in payloads]
    by_width: dict[int, list[int]] = {}
    for k, (_, p) in enumerate(frames):
        by_width.setdefault(WIDTH * -(-len(p) // (WIDTH * MAX_ROWS)), []).append(k)
    done: dict[int, bytes] = {}
    for width, ks in ((width, ks) for width, of in by_width.items() for ks in _portions(of, lambda k: len(frames[k][1]))):
        padded = [frames[k][1] + bytes(-len(frames[k][1]) % width) for k in ks]
        rows = np.array([len(p) // width for p in padded])
        first = np.cumsum(rows) - rows
        v = np.frombuffer(b"".join(padded), np.uint8).reshape(-1, width)
        turn = np.arange(len(v)) - np.repeat(first, rows)
        scan, row_bytes = _rows_to_scan(v, turn == np.repeat(rows, rows) - 1, turn)
        ends = np.concatenate(([0], np.cumsum(row_bytes)))
        for j, k in enumerate(ks):
            done[k] = _header(width, int(rows[j]), len(frames[k][1])) + scan[ends[first[j]] : ends[first[j] + rows[j]]].tobytes()
    for k, (i, _) in enumerate(frames):
        out[i].append(done[k])
    return [b"".join(x) for x in out]


class Image:
    """The headers of one baseline image, from its first marker to its scan."""

    def __init__(self, data: bytes, at: int = 0):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        self.quant, self.tables, self.interval, self.comment, at = {}, {}, 0, b"", at + 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("no marker")
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide, k = body[0] >> 4, body[0] & 15
                    self.quant[k] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker == 0xC0:
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.parts = [tuple(body[6 + 3 * k : 9 + 3 * k]) for k in range(body[5])]
            elif marker in range(0xC1, 0xD0) and marker != 0xC8 and marker != 0xCC:
                raise ValueError("not a baseline image")
            elif marker == 0xDD:
                self.interval = int.from_bytes(body, "big")
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                chosen = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
                break
        self.scan = at
        hs, vs = max(p[1] >> 4 for p in self.parts), max(p[1] & 15 for p in self.parts)
        if len(self.parts) == 1:  # one component isn't interleaved: a block is a unit
            self.parts, hs, vs = [(self.parts[0][0], 0x11, self.parts[0][2])], 1, 1
        self.across, self.down = -(-self.width // (8 * hs)), -(-self.height // (8 * vs))
        self.units = self.across * self.down
        #: For each block of a unit: component, DC table, AC table.
        self.pattern = [(k, chosen[c] >> 4, 0x10 | chosen[c] & 15) for k, (c, hv, _) in enumerate(self.parts) for _ in range((hv >> 4) * (hv & 15))]
        self.luma = (self.parts[0][1] >> 4, self.parts[0][1] & 15)
        self.key = (tuple(self.pattern), self.luma, tuple(sorted(self.tables.items())), len(self.parts))


def _scan_ends(arr: np.ndarray, starts: list[int]) -> np.ndarray:
    """Where the end-of-image marker of each scan is."""
    ends = np.flatnonzero((arr[:-1] == 0xFF) & (arr[1:] == 0xD9))
    return ends[np.searchsorted(ends, starts)]


def _symbol(lut: np.ndarray, index: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits used by a DC code with its value, and the value."""
    got = lut.take(index)
    if not got.all():
        raise ValueError("no such code")
    length, n = (got >> 8).astype(np.int64), (got & 255).astype(np.int64)
    used = length + n
    raw = ((w >> (40 - used).astype(np.uint64)).astype(np.int64)) & ((1 << n) - 1)
    return used, raw - np.where(raw < (1 << n) >> 1, (1 << n) - 1, 0)


def _dc_terms(images: list[Image], arr: np.ndarray, spans: list[tuple[int, int]]) -> list[np.ndarray]:
    """For each image the DC terms of its luminance in order of decoding; all have one key.

    Each restart interval is a lane; a step decodes one Huffman symbol of every lane.
    """
    first = images[0]
    names = sorted(first.tables)
    lut = np.concatenate([_lookup(*first.tables[t]) for t in names])
    row = {t: names.index(t) << 16 for t in names}
    dc_row = np.array([row[p[1]] for p in first.pattern])
    ac_row = np.array([row[p[2]] for p in first.pattern])
    comp = np.array([p[0] for p in first.pattern])
    data = np.concatenate([arr[a:b] for a, b in spans] + [np.full(8, 0xFF, np.uint8)])
    edges = np.cumsum([0] + [b - a for a, b in spans])
    after_ff = np.zeros(data.size, bool)
    after_ff[1:] = data[:-1] == 0xFF
    after_ff[edges[:-1]] = False
    restart = after_ff & (data >= 0xD0) & (data <= 0xD7)
    drop = after_ff & (data == 0) | restart
    drop[:-1] |= restart[1:]
    new = np.cumsum(~drop) - ~drop  # a byte's place once markers and stuffing are gone
    clean = data[~drop]
    marks = np.flatnonzero(restart)
    begin = np.sort(np.concatenate((edges[:-1], marks + 1)))
    image_of = np.searchsorted(edges, begin, side="right") - 1
    units = np.array([im.units for im in images])
    per = np.array([im.interval or im.units for im in images])
    turn = np.arange(len(begin)) - np.searchsorted(image_of, image_of)
    size = np.minimum(per[image_of], units[image_of] - turn * per[image_of]) * len(first.pattern)
    if (size < 0).any() or (np.bincount(image_of, size, len(images)) != units * len(first.pattern)).any():
        raise ValueError("restart intervals don't fit the image")
    padded = np.concatenate((clean, np.full(8, 0xFF, np.uint8))).astype(np.uint64)
    window = padded[:-4] << np.uint64(32)
    for k in range(1, 5):
        window |= padded[k : padded.size - 4 + k] << np.uint64(32 - 8 * k)
    out_at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.int32)
    lanes = np.flatnonzero(size > 0)
    p, at, end, k = new[begin][lanes] * 8, out_at[lanes], (out_at + size)[lanes], np.zeros(lanes.size, np.int64)
    begin_at, n_pattern = at.copy(), len(first.pattern)
    pred = np.zeros((len(first.parts), lanes.size), np.int64)
    while at.size:
        w = window.take(p >> 3) << (p & 7).astype(np.uint64)  # 40 bits and up to 7 above them
        where = (at - begin_at) % n_pattern if n_pattern > 1 else 0
        peek = ((w >> np.uint64(24)) & np.uint64(0xFFFF)).astype(np.int64)
        at_dc = k == 0
        if at_dc.all():
            used, value = _symbol(lut, dc_row[where] + peek, w)
            moved = used
            # most often the block ends at once: look one code further if its bits are here
            room = np.minimum(used, 24)
            nxt = lut.take(ac_row[where] + ((w >> (24 - room).astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.int64))
            ends = (nxt & 255 == 0) & (nxt > 0) & (used <= 24)
            moved = used + np.where(ends, nxt >> 8, 0)
            if n_pattern > 1:
                c, lane = comp[where], np.arange(at.size)
                pred[c, lane] += value
                out[at] = pred[c, lane]
            else:
                pred[0] += value
                out[at] = pred[0]
            p = p + moved
            k = np.where(ends, 0, 1)
            at = at + ends
        else:
            got = lut.take(np.where(at_dc, dc_row[where], ac_row[where]) + peek)
            if not got.all():
                raise ValueError("no such code")
            symbol = got & 255
            stay = np.flatnonzero(at_dc)  # they wait for the lanes inside a block
            step = (got >> 8) + (symbol & 15)
            # AC: run, then a value; 0 ends the block, 240 is sixteen zeros
            nk = np.where(symbol == 0, 64, k + (symbol >> 4) + 1)
            step[stay], nk[stay] = 0, 0
            over = nk >= 64
            p, k, at = p + step, np.where(over, 0, nk), at + over
        if (at >= end).any():
            keep = (at < end) | (k > 0)
            p, k, at, end, begin_at, pred = p[keep], k[keep], at[keep], end[keep], begin_at[keep], pred[:, keep]
    lum = np.tile(comp == 0, int(units.sum()))
    borders = np.cumsum(units * int((comp == 0).sum()))[:-1]
    return np.split(out[lum], borders)


def thumbnail(image: Image, dc: np.ndarray) -> np.ndarray:
    """Samples (rows, columns), one a luminance block: the block's mean."""
    h, v = image.luma
    q = image.quant[image.parts[0][2]]
    value = np.clip((dc.astype(np.int64) * q + 1028) >> 3, 0, 255).astype(np.uint8)
    grid = value.reshape(image.down, image.across, v, h).transpose(0, 2, 1, 3).reshape(image.down * v, image.across * h)
    full = np.array([p[1] for p in image.parts])
    hs, vs = (full >> 4).max(), (full & 15).max()
    return grid[: -(-image.height * v // (8 * vs)), : -(-image.width * h // (8 * hs))]


def decode(stored: list[bytes]) -> list[list[tuple[Image, np.ndarray]]]:
    """For each stored form its images with their thumbnails."""
    data, groups, out = b"".join(stored), {}, [[] for _ in stored]
    arr, base = np.frombuffer(data, np.uint8), 0
    for i, s in enumerate(stored):
        at = base
        while at < base + len(s):
            im = Image(data, at)
            end = int(_scan_ends(arr[im.scan : base + len(s)], [0])[0]) + im.scan
            groups.setdefault(im.key, []).append((i, len(out[i]), im, (im.scan, end)))
            out[i].append(None)
            at = end + 2
        base += len(s)
    for group in (run for of in groups.values() for run in _portions(of, lambda g: g[3][1] - g[3][0])):
        for (i, k, im, _), dc in zip(group, _dc_terms([g[2] for g in group], arr, [g[3] for g in group]), strict=True):
            out[i][k] = (im, thumbnail(im, dc))
    return out


def payload_of(images: list[tuple[Image, np.ndarray]]) -> bytes:
    return b"".join(t.tobytes()[: int(im.comment[8:])] for im, t in images)


def hashes(images: list[tuple[Image, np.ndarray]]) -> str:
    """Size in pixels, mean hash and difference hash of the thumbnails, joined by a plus."""

    def one(im: Image, t: np.ndarray) -> str:
        rows, cols = np.linspace(0, t.shape[0], 9).astype(int)[:-1], np.linspace(0, t.shape[1], 10).astype(int)[:-1]
        sums = np.add.reduceat(np.add.reduceat(t.astype(np.int64), np.minimum(rows, t.shape[0] - 1), 0), np.minimum(cols, t.shape[1] - 1), 1)
        mean = np.packbits(sums[:, :8] * 64 > sums[:, :8].sum()).tobytes().hex()
        return f"{im.width}x{im.height}:{mean}:{np.packbits(sums[:, 1:] > sums[:, :-1]).tobytes().hex()}"

    return "+".join(one(*x) for x in images)


def pad(data: bytes) -> bytes:
    return data + bytes(64 if not data else -len(data) % 64)


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        at = 0
        while at < b.num_rows:
            took, size = [], 0
            while at + len(took) < b.num_rows and (not took or size < BATCH):
                took.append((texts[at + len(took)].as_py() or "").encode())
                size += len(took[-1])
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(took)), pa.array([len(x) for x in took], pa.int64()), pa.array(encode([pad(x) for x in took]), pa.binary())], ["doc_id", "n_bytes", "media"])
            at += len(took)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, mean int"


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, media = 0, b.column(2)
        while at < b.num_rows:
            took, size = [], 0
            while at + len(took) < b.num_rows and (not took or size < BATCH):
                took.append(media[at + len(took)].as_py())
                size += len(took[-1])
            rows = []
            for m, images in zip(took, decode(took), strict=True):
                p = payload_of(images)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), hashes(images), images[0][0].width, images[0][0].height, int(np.frombuffer(p, np.uint8).mean())))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(took)), b.column(1).slice(at, len(took)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], [x.split()[0] for x in FEATURES.split(", ")])
            at += len(took)


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a baseline JPEG."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encode_batches, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """FEATURES of a media column (doc_id, n_bytes, media), from the stored bytes alone."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_feature_batches, FEATURES)
