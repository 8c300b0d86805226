"""Media columns of baseline JPEG images.

The reader parses markers, Huffman-decodes all restart intervals of a batch of images in lockstep
(one numpy lane per interval), and reconstructs the DC-only luminance thumbnail: one sample for
each 8x8 block. It reads any baseline image of one to four components and any sampling.

The writer stores bytes losslessly as grey images whose blocks are constant: the sample v of a
block is its quantised DC coefficient v - 128 (the DC step is 8, so the inverse transform is
exact), and every AC coefficient is 0. The format's unit is thus the block; its thumbnail has the
stored bytes. A row has 64 blocks and is a restart interval; over ``MAX_ROWS`` rows go on in a
further image of the same value.

Defined results: a null text is empty; an empty payload is one row of zeros; values that are no
image, or cut short or damaged, have null features; rows are independent; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = 64
MAX_ROWS = 8128
GROUP_BYTES = 1 << 20
#: Code lengths (counts of 1 to 16 bits) and symbols of the standard table for luminance DC.
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)
#: The only AC symbol the writer needs is the end of a block, as the code 0.
AC_COUNTS, AC_SYMBOLS = (1, *(0,) * 15), (0,)


def codes(counts, symbols) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a canonical Huffman table."""
    out, code, at = [], 0, 0
    for bits, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out.append((s, code, bits))
            code += 1
        at += n
        code <<= 1
    return out


def _lookup(counts, symbols) -> np.ndarray:
    """For each 16 bits: symbol * 32 + code length; 0 where no code fits."""
    table = np.zeros(1 << 16, np.int32)
    for s, code, bits in codes(counts, symbols):
        table[code << (16 - bits) : (code + 1) << (16 - bits)] = s * 32 + bits
    return table


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each DC difference from -255 (first) to 255, with the end of the block."""
    by = {s: (code, bits) for s, code, bits in codes(DC_COUNTS, DC_SYMBOLS)}
    value, length = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, bits = by[size]
        low = d if d >= 0 else d + (1 << size) - 1
        value[d + 255], length[d + 255] = ((code << size) | low) << 1, bits + size + 1
    return value, length


_VALUE, _LENGTH = _difference_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    quant = bytes([0, 8, *(1,) * 63])
    frame = struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0])
    dc, ac = bytes([0x00, *DC_COUNTS, *DC_SYMBOLS]), bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])
    scan = bytes([1, 1, 0x00, 0, 63, 0])
    return b"\xff\xd8" + _segment(0xDB, quant) + _segment(0xC0, frame) + _segment(0xC4, dc) + _segment(0xC4, ac) + _segment(0xDD, struct.pack(">H", ROW)) + _segment(0xDA, scan)


def _intervals(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stuffed entropy-coded bytes of each row of samples (rows, 64), and where each row begins (and the end)."""
    wide = samples.astype(np.int16) - 128
    diff = np.diff(wide, axis=1, prepend=np.zeros((len(wide), 1), np.int16)).astype(np.int64) + 255
    value, length = _VALUE[diff], _LENGTH[diff]
    ends = np.cumsum(length, axis=1)
    n_bytes = (ends[:, -1] + 7) // 8
    begin = np.concatenate([[0], np.cumsum(n_bytes)])
    at = (begin[:-1, None] * 8 + ends - length).ravel()
    bits = value.ravel() << (24 - (at & 7) - length.ravel())
    first, total = at >> 3, int(begin[-1]) + 2
    packed = np.zeros(total, np.float64)
    for k in range(3):
        packed += np.bincount(first + k, (bits >> (16 - 8 * k)) & 255, total)[:total]
    packed[begin[1:] - 1] += (1 << (n_bytes * 8 - ends[:, -1])) - 1  # ones up to the byte's end
    packed = packed[:-2].astype(np.uint8)
    full = packed == 255
    shift = np.cumsum(full) - full
    out = np.zeros(len(packed) + int(full.sum()), np.uint8)
    out[np.arange(len(packed)) + shift] = packed
    stuffed = np.concatenate([[0], np.cumsum(full)])
    return out, begin + stuffed[begin]


def padded(data: bytes) -> bytes:
    """``data`` with zeros up to a positive multiple of 64."""
    return data + bytes(-len(data) % ROW or (0 if data else ROW))


def write_many(payloads: list[bytes]) -> list[bytes]:
    """The images of payloads (positive multiples of 64 bytes)."""
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW)
    coded, begin = _intervals(rows)
    raw, out, at = coded.tobytes(), [], 0
    restart = [bytes([0xFF, 0xD0 + i]) for i in range(8)]
    for p in payloads:
        parts = []
        for low in range(0, len(p) // ROW, MAX_ROWS):
            n = min(MAX_ROWS, len(p) // ROW - low)
            parts.append(_header(n))
            for r in range(n):
                if r:
                    parts.append(restart[(r - 1) & 7])
                parts.append(raw[begin[at + r] : begin[at + r + 1]])
            parts.append(b"\xff\xd9")
            at += n
        out.append(b"".join(parts))
    return out


class Image:
    """What the markers of one image say, and where its entropy-coded intervals lie."""

    __slots__ = ("ac", "components", "data", "dc", "height", "interval", "intervals", "order", "quant", "width")

    def __init__(self, data: bytes):
        self.data, self.quant, self.dc, self.ac, self.interval, self.intervals = data, {}, {}, {}, 0, []
        self.height = self.width = 0
        self.components: list[tuple[int, int, int, int]] = []
        self.order: list[tuple[int, int, int]] = []

    def key(self):
        """Images of one key are decoded together."""
        return tuple(self.components), tuple(self.order), tuple(sorted(self.dc.items())), tuple(sorted(self.ac.items()))

    def grid(self) -> tuple[int, int]:
        """Rows and columns of minimal coded units."""
        if len(self.order) == 1:
            return -(-self.height // 8), -(-self.width // 8)
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))


def parse(data: bytes) -> list[Image]:
    """The images in ``data``, one after the other. ValueError for what is no baseline image."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        image = Image(data)
        while True:
            while data[at + 1 : at + 2] == b"\xff":  # fill bytes
                at += 1
            if at + 2 > len(data) or data[at] != 0xFF:
                raise ValueError("no marker where one must be")
            marker = data[at + 1]
            at += 2
            if marker == 0xD9:
                break
            size = int.from_bytes(data[at : at + 2], "big")
            body = data[at + 2 : at + size]
            if size < 2 or len(body) < size - 2:
                raise ValueError("a segment is cut short")
            at += size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    if wide > 1 or len(body) < 1 + 64 * (1 + wide):
                        raise ValueError("a quantisation table is cut short or of other numbers")
                    image.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    (image.ac if body[0] >> 4 else image.dc)[body[0] & 15] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif marker == 0xC0:
                if body[0] != 8:
                    raise ValueError("samples are not of 8 bits")
                image.height, image.width = struct.unpack(">HH", body[1:5])
                image.components = [(c, s >> 4, s & 15, q) for c, s, q in zip(body[6::3], body[7::3], body[8::3], strict=False)][: body[5]]
            elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("not a baseline image")
            elif marker == 0xDD:
                image.interval = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                by = {c[0]: i for i, c in enumerate(image.components)}
                image.order = [(by[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                at = _scan(image, at)
        if not image.intervals or len(image.order) != len(image.components):
            raise ValueError("no scan of all components")
        _validate(image)
        out.append(image)
    if not out:
        raise ValueError("no image")
    return out


def _validate(image: Image) -> None:
    """ValueError for sizes, sampling factors and table numbers that no baseline image has, and for tables that are missing or overfull."""
    if not (image.height and image.width):
        raise ValueError("an image without rows or columns")
    if not 1 <= len(image.components) <= 4 or len({c[0] for c in image.components}) < len(image.components):
        raise ValueError("components are missing or named twice")
    if any(not (1 <= h <= 4 and 1 <= v <= 4) for _, h, v, _ in image.components) or sum(h * v for _, h, v, _ in image.components) > 10:
        raise ValueError("sampling factors are out of range")
    if any(q not in image.quant for *_, q in image.components):
        raise ValueError("a quantisation table is missing")
    if len({c for c, _, _ in image.order}) < len(image.order) or any(d not in image.dc or a not in image.ac for _, d, a in image.order):
        raise ValueError("a component is coded twice, or its code table is missing")
    for counts, symbols in (*image.dc.values(), *image.ac.values()):
        if len(counts) != 16 or sum(counts) != len(symbols) or sum(n << (16 - bits) for bits, n in enumerate(counts, 1)) > 1 << 16:
            raise ValueError("a code table is cut short or has more codes than fit")


def _scan(image: Image, at: int) -> int:
    """Find the intervals of the scan that begins at ``at``; where it ends."""
    left = np.frombuffer(image.data, np.uint8, offset=at)
    full = np.flatnonzero(left[:-1] == 255)
    after = left[full + 1]
    marks = full[after != 0]
    kinds = left[marks + 1]
    stop = np.flatnonzero((kinds < 0xD0) | (kinds > 0xD7))
    if not len(stop):
        raise ValueError("the scan has no end")
    edges = marks[: stop[0] + 1]
    starts = np.concatenate([[0], edges[:-1] + 2])
    image.intervals = list(zip((starts + at).tolist(), (edges + at).tolist(), strict=True))
    return at + int(edges[-1])


def _decode(images: list[Image]) -> list[list[np.ndarray]]:
    """Quantised DC values by image and component, in scan order; images must share a key."""
    first = images[0]
    blocks: list[tuple[int, int, int]] = []  # component, DC table, AC table of each block of a unit
    for c, dc, ac in first.order:
        _, h, v, _ = first.components[c]
        blocks += [(c, dc, ac)] * (1 if len(first.order) == 1 else h * v)
    tables = {("dc", i): _lookup(*t) for i, t in first.dc.items()} | {("ac", i): _lookup(*t) for i, t in first.ac.items()}
    names = list(tables)
    stack = np.concatenate([tables[n] for n in names])
    dc_of = np.array([names.index(("dc", b[1])) for b in blocks]) << 16
    ac_of = np.array([names.index(("ac", b[2])) for b in blocks]) << 16
    component = np.array([b[0] for b in blocks])
    chunks, lanes, counts, owner = [], [], [], []
    base = 0
    for i, image in enumerate(images):
        rows, columns = image.grid()
        units, step = rows * columns, image.interval or rows * columns
        if len(image.intervals) != -(-units // step):
            raise ValueError("intervals are missing")
        for k, (a, b) in enumerate(image.intervals):
            raw = image.data[a:b].replace(b"\xff\x00", b"\xff")
            chunks.append(raw)
            lanes.append(base)
            base += len(raw)
            counts.append(min(step, units - k * step) * len(blocks))
            if counts[-1] > 4 * len(raw):  # a block has two codes of a bit at least
                raise ValueError("an interval is cut short")
            owner.append(i)
    flat = np.frombuffer(b"".join(chunks) + b"\xff" * 8, np.uint8).astype(np.int32)
    window = (flat[:-3] << 16) | (flat[1:-2] << 8) | flat[2:-1]
    n = np.array(counts)
    begin = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(begin[-1]), np.int32)
    lane = np.arange(len(n))
    limit = (np.array(lanes) + np.array([len(c) for c in chunks])) * 8
    bit = np.array(lanes) * 8
    block = np.zeros(len(n), np.int64)
    k = np.zeros(len(n), np.int32)
    last = np.zeros((len(n), len(first.components)), np.int32)
    per = len(blocks)

    def peek(bit):
        return (window[np.minimum(bit >> 3, len(window) - 1)] >> (8 - (bit & 7))) & 0xFFFF

    while len(lane):
        unit = block % per if per > 1 else np.zeros(len(lane), np.int64)
        is_dc = k == 0
        all_dc, no_dc = is_dc.all(), not is_dc.any()
        offset = dc_of[unit] if all_dc else ac_of[unit] if no_dc else np.where(is_dc, dc_of[unit], ac_of[unit])
        hit = stack[offset + peek(bit)]
        if not hit.all():
            raise ValueError("a code is not in the table")
        bit = bit + (hit & 31)
        symbol = hit >> 5
        size = symbol if all_dc else symbol & 15
        if size.any():
            value = peek(bit) >> (16 - size)
            value = np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)
            bit = bit + size
        else:
            value = size
        if (bit > limit).any():
            raise ValueError("an interval is cut short")
        if not no_dc:
            at = np.flatnonzero(is_dc)
            c = component[unit[at]]
            last[at, c] += value[at]
            out[begin[lane[at]] + block[at]] = last[at, c]
        if all_dc:
            k = np.ones_like(k)
            continue
        run = symbol >> 4
        step = np.where(size > 0, run + 1, np.where(run == 15, 16, 64))
        k = np.where(is_dc, 1, k + step)
        over = k >= 64
        block += over
        k = np.where(over, 0, k)
        done = block >= n[lane]
        if done.any():
            stay = ~done
            lane, bit, limit, block, k, last = lane[stay], bit[stay], limit[stay], block[stay], k[stay], last[stay]
    result: list[list[np.ndarray]] = []
    ends = np.flatnonzero(np.diff(np.array([*owner, -1]))) + 1
    low = 0
    for high in ends:
        part = out[begin[low] : begin[high]].reshape(-1, per)
        result.append([part[:, component == c] for c in range(len(first.components))])
        low = high
    return result


def thumbnails(values: list[bytes | None]) -> list[np.ndarray | None]:
    """The DC-only luminance thumbnail of each value (its images one below the other); None if it is no image."""
    out: list = [None] * len(values)
    groups: dict = {}
    parsed: dict[int, list] = {}
    for i, data in enumerate(values):
        try:
            images = parse(data) if data else []
        except (ValueError, IndexError, KeyError, struct.error):
            continue
        parsed[i] = [None] * len(images)
        for j, image in enumerate(images):
            groups.setdefault(image.key(), []).append((i, j, image))
    for members in groups.values():
        try:
            decoded = _decode([m[2] for m in members])
        except (ValueError, IndexError, KeyError):
            decoded = []
            for m in members:  # one damaged image must not take the others with it
                try:
                    decoded += _decode([m[2]])
                except (ValueError, IndexError, KeyError):
                    decoded.append(None)
        for (i, j, image), dc in zip(members, decoded, strict=True):
            if dc is not None:
                try:
                    parsed[i][j] = _luminance(image, dc[0])
                except (ValueError, IndexError, KeyError):  # a table that the file doesn't have
                    pass
    for i, parts in parsed.items():
        if parts and all(p is not None for p in parts) and len({p.shape[1] for p in parts}) == 1:
            out[i] = np.concatenate(parts)
    return out


def _luminance(image: Image, dc: np.ndarray) -> np.ndarray:
    rows, columns = image.grid()
    _, h, v, q = image.components[0]
    h, v = (1, 1) if len(image.order) == 1 else (h, v)
    plane = dc.reshape(rows, columns, v, h).transpose(0, 2, 1, 3).reshape(rows * v, columns * h)
    wide, high = max(c[1] for c in image.components), max(c[2] for c in image.components)
    size = -(-image.height * v // (8 * high)), -(-image.width * h // (8 * wide))
    size = (-(-image.height // 8), -(-image.width // 8)) if len(image.order) == 1 else size
    samples = (plane[: size[0], : size[1]].astype(np.int64) * image.quant[q] + 1024 + 4) >> 3
    return np.clip(samples, 0, 255).astype(np.uint8)


def feature(thumb: np.ndarray) -> str:
    """Dimensions in pixels, average hash and difference hash of a thumbnail."""
    rows, columns = thumb.shape
    down, across = np.arange(8) * rows // 8, np.arange(9) * columns // 9
    cells = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), down, axis=0), across, axis=1)
    area = np.diff(np.append(down, rows)).clip(1)[:, None] * np.diff(np.append(across, columns)).clip(1)[None, :]
    mean = cells / area
    bits = lambda m: int.from_bytes(np.packbits(m).tobytes(), "big")
    return f"{columns * 8}x{rows * 8}:{bits(mean[:, :8] > mean[:, :8].mean()):016x}:{bits(mean[:, 1:] > mean[:, :-1]):016x}"


def _groups(sizes: list[int]) -> Iterator[slice]:
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= GROUP_BYTES:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


@F.pandas_udf(T.BinaryType())
def stored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The images of texts: their UTF-8 bytes, padded with zeros."""
    for batch in batches:
        payloads = [padded((t or "").encode()) for t in batch]
        yield pd.Series([m for s in _groups([len(p) for p in payloads]) for m in write_many(payloads[s])], dtype=object)


#: Columns read from a media value.
FEATURES = (
    ("width", T.IntegerType()), ("height", T.IntegerType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()),
    ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()),
)


@F.pandas_udf(T.StructType([T.StructField(*f) for f in FEATURES]))
def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Dimensions, hashes and feature of media values, from their thumbnails alone."""
    names = [f[0] for f in FEATURES]
    for batch in batches:
        values, rows = list(batch), []
        for s in _groups([len(v or b"") for v in values]):
            for media, thumb in zip(values[s], thumbnails(values[s]), strict=True):
                if thumb is None:
                    rows.append((None,) * len(names))
                    continue
                data = thumb.tobytes()
                rows.append((thumb.shape[1] * 8, thumb.shape[0] * 8, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature(thumb)))
        out = pd.DataFrame(rows, columns=names, dtype=object)
        for c in ("width", "height", "payload_bytes", "tail_crc32", "media_bytes"):
            out[c] = out[c].astype("Int32" if c in ("width", "height") else "Int64")
        yield out


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column of every text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), stored(F.col("text")).alias("media"))


def read_media(media: DataFrame) -> DataFrame:
    """The features of a media column, read from its bytes; other columns are passed on."""
    keep = [c for c in media.columns if c != "media"]
    return media.select(*keep, features("media").alias("__f")).select(*keep, "__f.*")


def report(docs: DataFrame) -> DataFrame:
    return read_media(store_texts(docs))
