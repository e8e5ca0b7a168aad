"""Media columns: baseline JPEG, read without an image library.

The reader parses markers, Huffman-decodes the scans of baseline frames (any sampling, restart intervals,
several scans) and keeps only what a DC-only luminance thumbnail needs: one sample per 8x8 luminance
block. All restart segments of a chunk of images that share their tables are decoded side by side, one
symbol at a time, in numpy; the work per step is an array operation over the segments.

The writer stores a byte payload losslessly as 8-bit samples: every byte is a flat 8x8 block (DC
quantiser 8, so that the DC level is the sample minus 128), 576 blocks to a restart interval. The
thumbnail of such an image is its payload. Payloads beyond one image's 65,535 rows of samples go on in
further images, end to end in the same stored bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, chunks, table, utf8

UNIT = 576
"""Payloads are padded to a multiple of this; it is also the restart interval of stored payloads."""
PAD = 255
MOST_BLOCKS = 8191
"""8x8 blocks along one side of an image (65,535 samples)."""
CHUNK = 2 << 20

#: The public standard's typical luminance DC table (codes by length, then symbols).
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: Of the AC symbols a payload needs the end of a block alone.
AC_LENGTHS = (1,) + (0,) * 15
AC_SYMBOLS = (0,)


class Unreadable(ValueError):
    """Not a baseline JPEG that this reader knows."""


def huffman_codes(lengths, symbols) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a canonical table."""
    out, code, k = [], 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            if k >= len(symbols) or code >> n:
                raise Unreadable("bad Huffman table")
            out.append((symbols[k], code, n))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(lengths, symbols) -> np.ndarray:
    """By the next 16 bits: symbol + 256 * length; 0 where no code begins."""
    out = np.zeros(1 << 16, np.int64)
    for symbol, code, n in huffman_codes(lengths, symbols):
        out[code << (16 - n) : (code + 1) << (16 - n)] = symbol + 256 * n
    return out


# --- writing --------------------------------------------------------------------------------------

def _writer_tables() -> tuple[np.ndarray, np.ndarray]:
    codes = {s: (c, n) for s, c, n in huffman_codes(DC_LENGTHS, DC_SYMBOLS)}
    value, bits = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        value[d + 255], bits[d + 255] = ((code << size) | extra) << 1, n + size + 1  # the end of the block is the bit 0
    return value, bits


_VALUE, _BITS = _writer_tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def shape(n: int) -> list[tuple[int, int]]:
    """Images for a payload of n bytes (a multiple of 576): (columns, rows) of blocks. All but the last are full."""
    out = []
    while n:
        part = min(n, UNIT * MOST_BLOCKS)
        columns = 24 if part <= 24 * MOST_BLOCKS else UNIT
        out.append((columns, part // columns))
        n -= part
    return out


def header(columns: int, rows: int) -> bytes:
    return b"".join((
        b"\xff\xd8",
        _segment(0xDB, b"\x00" + bytes([8] + [1] * 63)),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, columns * 8, 1) + b"\x01\x11\x00"),
        _segment(0xC4, b"\x00" + bytes(DC_LENGTHS) + bytes(DC_SYMBOLS)),
        _segment(0xC4, b"\x10" + bytes(AC_LENGTHS) + bytes(AC_SYMBOLS)),
        _segment(0xDD, struct.pack(">H", UNIT)),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


def write_payloads(payload: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """JPEG bytes of payloads that lie end to end (each a positive multiple of 576 bytes)."""
    images = [(i, *s) for i, n in enumerate(sizes.tolist()) for s in shape(n)]
    done, start, first = [b""] * len(sizes), 0, 0
    while first < len(images):  # a very long payload goes in groups of its images
        last, stop = first, start
        while last < len(images) and (last == first or stop + images[last][1] * images[last][2] - start <= 2 * CHUNK):
            stop += images[last][1] * images[last][2]
            last += 1
        for (i, columns, rows), body in zip(images[first:last], _entropy_coded(payload[start:stop], images[first:last]), strict=True):
            done[i] += header(columns, rows) + body
        first, start = last, stop
    return done


def _entropy_coded(payload: np.ndarray, images: list[tuple[int, int, int]]) -> list[bytes]:
    """By image its scan's bytes and the end marker."""
    blocks = payload.reshape(-1, UNIT).astype(np.int64)
    index = np.diff(blocks, axis=1, prepend=128) + 255
    bits, value = _BITS[index], _VALUE[index]
    total = bits.sum(axis=1)
    bytes_each = (total + 7) // 8
    first = np.concatenate(([0], np.cumsum(bytes_each)))
    at = (np.cumsum(bits, axis=1) - bits + 8 * first[:-1, None]).ravel()
    bits, value = bits.ravel(), value.ravel()
    word = at >> 5
    wide = value << (64 - (at & 31) - bits).astype(np.uint64)
    new = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    packed = np.zeros(int(word[-1]) + 2, np.uint64)
    packed[word[new]] += np.add.reduceat(wide >> np.uint64(32), new)
    packed[word[new] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), new)
    data = packed.astype(">u4").view(np.uint8)[: first[-1]].copy()
    data[first[1:] - 1] |= ((1 << (-total % 8)) - 1).astype(np.uint8)  # ones up to the next byte
    # Zeros after 0xFF bytes, and after each segment two bytes for its marker.
    full = data == 0xFF
    segment = np.repeat(np.arange(len(total)), bytes_each)
    to = np.arange(len(data)) + np.cumsum(full) - full + 2 * segment
    out = np.zeros(len(data) + int(full.sum()) + 2 * len(total), np.uint8)
    out[to] = data
    ends = to[first[1:] - 1] + full[first[1:] - 1]  # the last byte of each segment
    per_image = np.array([c * r // UNIT for _, c, r in images])
    last = np.cumsum(per_image) - 1
    number = np.arange(len(total)) - np.repeat(last - per_image + 1, per_image)
    out[ends + 1] = 0xFF
    out[ends + 2] = 0xD0 + number % 8
    out[ends[last] + 2] = 0xD9
    stops = ends[last] + 3
    raw = out.tobytes()
    return [raw[x:y] for x, y in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every whole text (null: empty) as UTF-8, padded and stored as baseline JPEG."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in chunks(batches, "text", CHUNK):
            n = np.diff(at)
            size = np.maximum(1, -(-n // UNIT)) * UNIT
            payload = np.full(int(size.sum()), PAD, np.uint8)
            payload[np.arange(len(data)) + np.repeat(np.cumsum(size) - size - at[:-1], n)] = data
            yield batch_of(doc_id=batch.column(0), n_bytes=n, media=pa.array(write_payloads(payload, size), pa.binary()))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(store, "doc_id long, n_bytes long, media binary")


# --- reading --------------------------------------------------------------------------------------

class Frame:
    """What one image's markers say."""

    def __init__(self):
        self.quant: dict[int, int] = {}
        self.tables: dict[int, tuple] = {}
        self.size = (0, 0)
        self.components: list[tuple[int, int, int, int]] = []  # id, horizontal, vertical, quantiser
        self.restart = 0
        self.scans: list[tuple[tuple, tuple, int, int]] = []  # blocks of an MCU, tables, begin and end in the data


def _markers(data: bytes) -> tuple[list[Frame], np.ndarray, np.ndarray]:
    """Frames of concatenated images; positions and kinds of the markers inside entropy-coded data."""
    raw = np.frombuffer(data, np.uint8)
    full = np.flatnonzero(raw[:-1] == 0xFF)
    kind = raw[full + 1]
    inside = (kind != 0) & (kind != 0xFF)
    marks, kinds = full[inside], kind[inside]
    real = marks[(kinds & 0xF8) != 0xD0]  # no restarts
    frames, at, n = [], 0, len(data)
    while at < n:
        if data[at : at + 2] != b"\xff\xd8":
            raise Unreadable("no start of an image")
        at, frame = at + 2, Frame()
        while True:
            if at + 2 > n or data[at] != 0xFF:
                raise Unreadable("marker expected")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if marker == 0xD9:
                at += 2
                break
            if at + 4 > n:
                raise Unreadable("cut off")
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            if size < 2 or len(body) != size - 2:
                raise Unreadable("cut off")
            at += 2 + size
            if marker == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    frame.quant[body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                    k += 1 + 64 * (1 + wide)
            elif marker in (0xC0, 0xC1):
                if body[0] != 8:
                    raise Unreadable("samples of other than 8 bits")
                frame.size = (int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"))
                frame.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif 0xC0 <= marker <= 0xCF and marker != 0xC4:
                raise Unreadable("not a baseline frame")
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    lengths = tuple(body[k + 1 : k + 17])
                    frame.tables[body[k]] = (lengths, tuple(body[k + 17 : k + 17 + sum(lengths)]))
                    k += 17 + sum(lengths)
            elif marker == 0xDD:
                frame.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                if not frame.components or not all(frame.size):
                    raise Unreadable("a scan before its frame")
                parts = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
                blocks, tables, known = [], [], {c[0]: c for c in frame.components}
                for i, t in parts:
                    if i not in known or (t >> 4) not in frame.tables or (16 + (t & 15)) not in frame.tables:
                        raise Unreadable("a scan without its tables")
                    blocks += [len(tables)] * (known[i][1] * known[i][2] if len(parts) > 1 else 1)
                    tables.append((frame.tables[t >> 4], frame.tables[16 + (t & 15)]))
                k = np.searchsorted(real, at)
                end = int(real[k]) if k < len(real) else n
                frame.scans.append((tuple(blocks), tuple(tables), at, end, tuple(i for i, _ in parts)))
                at = end
        if not frame.scans:
            raise Unreadable("no scan")
        frames.append(frame)
    return frames, marks, kinds


def _decode(data: np.ndarray, begin: np.ndarray, end: np.ndarray, mcus: np.ndarray, blocks: tuple, tables: tuple) -> tuple[np.ndarray, np.ndarray]:
    """DC levels (segments x blocks) of entropy-coded segments [begin, end) of unstuffed bytes, and which of them are sound."""
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    wide = np.zeros(len(padded) - 7, np.uint64)
    for i in range(8):
        wide |= padded[i : len(wide) + i].astype(np.uint64) << np.uint64(56 - 8 * i)
    dc = [lookup(*t[0]) for t in tables]
    ac = [lookup(*t[1]) for t in tables]
    order = np.argsort(-mcus, kind="stable")
    pos, left, limit = begin[order].astype(np.int64) * 8, mcus[order], end[order].astype(np.int64) * 8
    per = len(blocks)
    out = np.zeros((len(order), int(mcus.max(initial=0)) * per), np.int32)
    sound = np.ones(len(order), bool)
    last = np.zeros((len(tables), len(order)), np.int64)
    most = np.uint64((len(wide) - 1) * 8)
    three, seven, top = np.uint64(3), np.uint64(7), np.uint64(48)

    def view(p: np.ndarray) -> np.ndarray:
        q = np.minimum(p.astype(np.uint64), most)
        return wide[q >> three] << (q & seven)

    for step in range(out.shape[1]):
        live = int(np.searchsorted(-left, -(step // per), side="left"))
        t = blocks[step % per]
        p = pos[:live]
        x = view(p)
        code = dc[t][x >> top]
        n, size = code >> 8, code & 255
        odd = (n == 0) | (size > 11)
        size = np.where(odd, 0, size)
        x = x << n.astype(np.uint64)
        extra = ((x >> np.uint64(1)) >> (63 - size).astype(np.uint64)).astype(np.int64)
        diff = np.where((extra >> np.maximum(size - 1, 0)) & 1, extra, extra - (1 << size) + 1)
        last[t, :live] += np.where(size, diff, 0)
        out[:live, step] = last[t, :live]
        code = ac[t][(x << size.astype(np.uint64)) >> top]
        p += n + size + (code >> 8)
        odd |= code == 0
        run = code & 255
        if (more := np.flatnonzero((run != 0) & ~odd)).size:
            at = np.ones(len(more), np.int64)
            run = run[more]
            while more.size:
                p[more] += run & 15
                at += np.where(run == 0xF0, 16, (run >> 4) + 1)
                odd[more[at > 64]] = True
                go = at < 64
                more, at = more[go], at[go]
                if not more.size:
                    break
                code = ac[t][view(p[more]) >> top]
                p[more] += code >> 8
                odd[more[code == 0]] = True
                run = code & 255
                go = (run != 0) & (code != 0)
                more, at, run = more[go], at[go], run[go]
        sound[:live] &= ~odd
    sound &= pos <= limit
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[back], sound[back]


class Image:
    def __init__(self, width: int, height: int, thumbnail: np.ndarray, components: int):
        self.width, self.height, self.thumbnail, self.components = width, height, thumbnail, components


def read_images(stored: list[bytes | None]) -> list[list[Image] | str]:
    """Of each stored value its images, or why it can't be read; null and empty values can't."""
    out: list = [None] * len(stored)
    work: dict[tuple, list] = defaultdict(list)
    parsed: dict[int, list[Frame]] = {}
    for i, data in enumerate(stored):
        try:
            if not data:
                raise Unreadable("empty")
            frames, marks, kinds = _markers(data)
            parsed[i] = frames
            for f, frame in enumerate(frames):
                luminance = frame.components[0]
                scan = next((s for s in frame.scans if luminance[0] in s[4]), None)
                if scan is None or luminance[3] not in frame.quant:
                    raise Unreadable("no luminance")
                blocks, tables, a, b, ids = scan
                hmax, vmax = max(c[1] for c in frame.components), max(c[2] for c in frame.components)
                width, height = frame.size
                if len(ids) > 1:
                    columns, rows = -(-width // (8 * hmax)), -(-height // (8 * vmax))
                else:
                    columns, rows = -(-(-(-width * luminance[1] // hmax)) // 8), -(-(-(-height * luminance[2] // vmax)) // 8)
                mcus = columns * rows
                inside = (marks >= a) & (marks < b) & ((kinds & 0xF8) == 0xD0)
                cut = np.concatenate(([a], marks[inside] + 2)), np.concatenate((marks[inside], [b]))
                each = frame.restart or mcus
                counts = [min(each, mcus - s) for s in range(0, mcus, each)]
                if len(counts) != len(cut[0]):
                    raise Unreadable("restart markers are missing")
                raw = np.frombuffer(data, np.uint8)
                work[blocks, tables].append((i, f, raw, *cut, np.array(counts), columns, rows, ids.index(luminance[0]), luminance, (hmax, vmax), len(ids)))
        except (Unreadable, IndexError) as e:
            out[i] = str(e) or "cut off"
    images: dict[int, dict[int, Image]] = defaultdict(dict)
    for (blocks, tables), items in _bounded(work):
        items = [x for x in items if out[x[0]] is None]
        # Stuffed zeros go; positions move down by as many as stand before them.
        data, begin, end, base = [], [], [], 0
        for _, _, raw, a, b, *_ in items:
            part = raw[a[0] : b[-1]]
            keep = np.ones(len(part), bool)
            keep[1:] = ~((part[1:] == 0) & (part[:-1] == 0xFF))
            down = np.concatenate(([0], np.cumsum(keep)))
            data.append(part[keep])
            begin.append(base + down[a - a[0]])
            end.append(base + down[b - a[0]])
            base += len(data[-1])
        if not items:
            continue
        mcus = np.concatenate([x[5] for x in items])
        try:
            levels, sound = _decode(np.concatenate(data), np.concatenate(begin), np.concatenate(end), mcus, blocks, tables)
        except Unreadable as e:
            for x in items:
                out[x[0]] = str(e)
            continue
        s = 0
        for i, f, _, a, _, counts, columns, rows, which, (_, h, v, q), (hmax, vmax), parts in items:
            own, s = slice(s, s + len(counts)), s + len(counts)
            if not sound[own].all():
                out[i] = "bad entropy-coded data"
                continue
            frame = parsed[i][f]
            per = len(blocks)
            flat = np.concatenate([levels[own][k, : n * per] for k, n in enumerate(counts.tolist())]) if len(set(counts.tolist())) > 1 else levels[own][:, : int(counts[0]) * per].ravel()
            flat = flat.reshape(-1, per)[:, np.array(blocks) == which]
            if parts > 1:
                flat = flat.reshape(rows, columns, v, h).transpose(0, 2, 1, 3).reshape(rows * v, columns * h)
                flat = flat[: -(-(-(-frame.size[1] * v // vmax)) // 8), : -(-(-(-frame.size[0] * h // hmax)) // 8)]
            else:
                flat = flat.reshape(rows, columns)
            thumb = np.clip((flat * frame.quant[q] + 4 >> 3) + 128, 0, 255).astype(np.uint8)
            images[i][f] = Image(*frame.size, thumb, len(frame.components))
    return [out[i] if out[i] is not None else [images[i][f] for f in range(len(parsed[i]))] for i in range(len(stored))]


def _bounded(work: dict[tuple, list]) -> Iterator[tuple[tuple, list]]:
    """Images that share their tables, in groups of about 2 CHUNK entropy-coded bytes."""
    for key, items in work.items():
        group, size = [], 0
        for x in items:
            n = int(x[4][-1] - x[3][0])
            if group and size + n > 2 * CHUNK:
                yield key, group
                group, size = [], 0
            group.append(x)
            size += n
        if group:
            yield key, group


def average_grid(thumb: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means over a grid of cells; small thumbnails repeat their samples."""
    a = thumb.astype(np.float64)
    for axis, n in ((0, rows), (1, columns)):
        if a.shape[axis] < n:
            a = np.take(a, np.arange(n) * a.shape[axis] // n, axis=axis)
        else:
            edge = np.arange(n) * a.shape[axis] // n
            a = np.add.reduceat(a, edge, axis=axis) / np.diff(np.append(edge, a.shape[axis])).reshape((-1, 1) if axis == 0 else (1, -1))
    return a


def _hex(bits: np.ndarray) -> str:
    return np.packbits(bits.ravel()).tobytes().hex()


def thumbnail_hash(thumb: np.ndarray) -> str:
    """Average hash and gradient hash of a thumbnail, 64 bits each."""
    grid = average_grid(thumb, 8, 8)
    slope = average_grid(thumb, 8, 9)
    return f"{_hex(grid > grid.mean())}:{_hex(slope[:, 1:] > slope[:, :-1])}"


def feature(images: list[Image]) -> str:
    """Dimensions and thumbnail hashes of all images of a row, whose samples lie end to end in rows of the first one's."""
    width, height, thumb = images[0].width, images[0].height, images[0].thumbnail
    if len(images) > 1:
        samples = np.concatenate([i.thumbnail.ravel() for i in images])
        columns = thumb.shape[1]
        thumb = np.pad(samples, (0, -len(samples) % columns), "edge").reshape(-1, columns)
        height = height * len(thumb) // len(images[0].thumbnail)
    return f"{width}x{height}:{thumbnail_hash(thumb)}"


def jpeg_columns(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Per row: id, width, height, images, thumbnail (samples, row by row), thumbnail_hash, error.

    Dimensions, thumbnail size and hash are the first image's; `thumbnail` goes through all images. Null,
    empty, damaged and non-baseline values get an error and nulls. Repeated rows stay.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in chunks(batches, "media", CHUNK):
            stored = batch.column(1).to_pylist()
            found = read_images(stored)
            ok = [x if isinstance(x, list) else None for x in found]
            yield batch_of(
                id=batch.column(0),
                width=pa.array([x and x[0].width for x in ok], pa.int32()),
                height=pa.array([x and x[0].height for x in ok], pa.int32()),
                images=pa.array([x and len(x) for x in ok], pa.int32()),
                thumbnail=pa.array([x and b"".join(i.thumbnail.tobytes() for i in x) for x in ok], pa.binary()),
                thumbnail_hash=pa.array([x and thumbnail_hash(x[0].thumbnail) for x in ok], pa.string()),
                error=pa.array([x if isinstance(x, str) else None for x in found], pa.string()),
            )

    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(read, f"id {media.schema[id_col].dataType.simpleString()}, width int, height int, images int, thumbnail binary, thumbnail_hash string, error string")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_payloads(table(spark, sf_dir, "documents"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in chunks(batches, "media", CHUNK):
            media = batch.column(2).to_pylist()
            found = read_images(media)
            if bad := [x for x in found if isinstance(x, str)]:
                raise Unreadable(f"a stored payload can't be read back: {bad[0]}")
            payload = [b"".join(i.thumbnail.tobytes() for i in x) for x in found]
            yield batch_of(
                doc_id=batch.column(0),
                n_bytes=batch.column(1),
                payload_bytes=pa.array([len(p) for p in payload], pa.int64()),
                payload_sha256=[hashlib.sha256(p).hexdigest() for p in payload],
                tail_crc32=pa.array([zlib.crc32(p[-32:]) for p in payload], pa.int64()),
                media_bytes=pa.array([len(m) for m in media], pa.int64()),
                media_sha256=[hashlib.sha256(m).hexdigest() for m in media],
                feature=[feature(x) for x in found],
            )

    return stored.mapInArrow(digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
