"""Media columns in TIFF: write payloads as images, walk image directories, one row per page.

The reader takes both byte orders, strips and tiles, chunky and planar samples of 1, 2, 4, 8,
16 or 32 bits (small ones come back as bytes), numbers with a point, no compression, PackBits,
LZW and deflate, and undoes horizontal and floating-point differencing. It trusts no offset
and no size: a directory that was seen before ends the walk, and no array is made for a page
that its stored bytes can't fill.

Defined results: null media, bytes that are no TIFF and files without a whole first directory
give one row with page null and ``error`` set; a page that can't be decoded (also one of no
width, height or tile size) keeps its header fields, with ``samples`` null and ``error`` set;
a chain that breaks off later ends with such a row; an empty payload is stored as 64 zero bytes; repeated rows give repeated
rows. Other columns pass through; one named like a result column is replaced.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lyraflux.llm.common import SLICE_ROWS, arrow_map

#: Fixed values of the format: tags, sizes of field types, compression schemes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES_PER_PIXEL, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
SAMPLE_FORMAT, POINT = 339, 3
#: Bytes that one stored byte can become at most: a run of PackBits, the longest LZW entry, deflate's bound.
GROWTH = {1: 1, 5: 4096, 8: 1032, 32946: 1032, 32773: 64}
TYPE_FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
SCHEMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
CLEAR, END, FIRST_FREE, MAX_CODES = 256, 257, 258, 4094

PAYLOAD_UNIT = 64
RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits_encode(row: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(a: int, b: int) -> None:
        for k in range(a, b, 128):
            part = row[k : min(k + 128, b)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in RUN.finditer(row):
        literal(at, m.start())
        out.append(257 - (m.end() - m.start()))
        out.extend(m[1])
        at = m.end()
    literal(at, len(row))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n and len(out) < size:
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        elif head > 128:
            out += data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    codes: list[int] = []
    widths: list[int] = []
    table: dict[int, int] = {}
    free, width = FIRST_FREE, 9
    codes.append(CLEAR)
    widths.append(9)
    word = -1
    for byte in data:
        if word < 0:
            word = byte
            continue
        key = word << 8 | byte
        known = table.get(key)
        if known is not None:
            word = known
            continue
        codes.append(word)
        widths.append(width)
        table[key] = free
        free += 1
        if free == MAX_CODES:
            codes.append(CLEAR)
            widths.append(width)
            table.clear()
            free, width = FIRST_FREE, 9
        elif free + 1 > 1 << width:
            width += 1
        word = byte
    if word >= 0:
        codes.append(word)
        widths.append(width)
        if free + 2 > 1 << width and width < 12:
            width += 1
    codes.append(END)
    widths.append(width)
    return _packed(codes, widths)


def _packed(codes: list[int], widths: list[int]) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first."""
    c, w = np.array(codes, np.uint16), np.array(widths)
    bits = np.unpackbits(c.astype(">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) >= (16 - w)[:, None]]).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out = list(base), []
    width, held, bits, made = 9, 0, 0, 0
    last = None
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == END:
            break
        if code == CLEAR:
            table, width, last = list(base), 9, None
            continue
        if last is None:
            entry = table[code]
        elif code < len(table):
            entry = table[code]
            table.append(last + entry[:1])
        elif code == len(table):
            entry = last + last[:1]
            table.append(entry)
        else:
            raise ValueError("LZW code out of range")
        out.append(entry)
        made += len(entry)
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)[:size]


def unpack(data: bytes, scheme: int, size: int) -> bytes:
    if scheme == NONE:
        out = data
    elif scheme == PACKBITS:
        out = packbits_decode(data, size)
    elif scheme == LZW:
        out = lzw_decode(data, size)
    elif scheme in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    else:
        raise ValueError(f"compression {scheme} is not supported")
    if len(out) < size:
        raise ValueError(f"{len(out)} of {size} bytes")
    return out[:size]


def pack(data: bytes, scheme: int, width: int) -> bytes:
    if scheme == PACKBITS:  # row by row, as the format asks
        return b"".join(packbits_encode(data[k : k + width]) for k in range(0, len(data), width))
    if scheme == LZW:
        return lzw_encode(data)
    return zlib.compress(data, 6) if scheme == DEFLATE else data


def write_tiff(
    images: list[np.ndarray], scheme: int = DEFLATE, predictor: int = 1, tile: int = 0, rows_per_strip: int = 64
) -> bytes:
    """A little-endian file of 8-bit grey images, a page each; ``tile`` > 0 stores square tiles."""
    body = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image in images:
        height, width = image.shape
        blocks = []
        if tile:
            padded = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), np.uint8)
            padded[:height, :width] = image
            for y in range(0, padded.shape[0], tile):
                blocks += [padded[y : y + tile, x : x + tile] for x in range(0, padded.shape[1], tile)]
        else:
            blocks = [image[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            data = pack(np.ascontiguousarray(block).tobytes(), scheme, block.shape[1])
            offsets.append(len(body))
            counts.append(len(data))
            body += data
        fields = {WIDTH: [width], LENGTH: [height], BITS: [8], COMPRESSION: [scheme], PHOTOMETRIC: [1], SAMPLES_PER_PIXEL: [1], PREDICTOR: [predictor]}
        if tile:
            fields |= {TILE_WIDTH: [tile], TILE_LENGTH: [tile], TILE_OFFSETS: offsets, TILE_BYTES: counts}
        else:
            fields |= {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [rows_per_strip], STRIP_BYTES: counts}
        entries = bytearray()
        for tag, values in sorted(fields.items()):
            entries += struct.pack("<HHI", tag, 4, len(values))
            if len(values) == 1:
                entries += struct.pack("<I", values[0])
            else:
                body += b"\0" * (len(body) % 2)
                entries += struct.pack("<I", len(body))
                body += struct.pack(f"<{len(values)}I", *values)
        body += b"\0" * (len(body) % 2)
        struct.pack_into("<I", body, link, len(body))
        body += struct.pack("<H", len(fields)) + entries
        link = len(body)
        body += b"\0\0\0\0"
    return bytes(body)


def directories(data: bytes) -> Iterator[dict[int, list[int]]]:
    """The fields of each image directory, along the chain of links; ValueError where the chain leaves the file."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    if at == 0:
        raise ValueError("no image directory")
    while at and at not in seen:
        if at + 2 > len(data):
            raise ValueError(f"directory at {at} of {len(data)} bytes")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        if n == 0 or at + 2 + 12 * n > len(data):
            raise ValueError(f"directory at {at} is empty or cut off")
        fields: dict[int, list[int]] = {}
        for k in range(n):
            place = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", data, place)
            form = TYPE_FORMATS.get(kind)
            if form is None:
                continue
            length = struct.calcsize(form) * count
            start = place + 8 if length <= 4 else struct.unpack_from(order + "I", data, place + 8)[0]
            if count and start + length <= len(data):
                fields[tag] = list(struct.unpack_from(f"{order}{count}{form}", data, start))
        fields[0] = [order == ">"]
        yield fields
        link = at + 2 + 12 * n
        at = struct.unpack_from(order + "I", data, link)[0] if link + 4 <= len(data) else 0


def undone(block: np.ndarray, raw: bytes, predictor: int, point: bool) -> np.ndarray:
    """Samples (rows, columns, samples of a pixel) with the predictor undone."""
    if predictor == 2:
        whole = block.view(f"u{block.itemsize}")  # differences are those of the bits as whole numbers
        return np.cumsum(whole, axis=1, dtype=whole.dtype).view(block.dtype)
    if predictor == 3:
        if not point:
            raise ValueError("predictor 3 is for numbers with a point")
        rows, wide, inner = block.shape
        # bytes differ from those ``inner`` before; the highest bytes of a row come first
        steps = np.frombuffer(raw, np.uint8).reshape(rows, -1, inner)
        planes = np.cumsum(steps, axis=1, dtype=np.uint8).reshape(rows, block.itemsize, wide * inner)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(block.dtype.newbyteorder(">")).reshape(rows, wide, inner).astype(block.dtype)
    return block


def read_page(data: bytes, fields: dict[int, list[int]]) -> np.ndarray:
    """Samples of a page, (rows, columns, samples of a pixel); ValueError or KeyError for what can't be a page."""
    width, height = fields[WIDTH][0], fields[LENGTH][0]
    depth, spp = fields.get(BITS, [1])[0], fields.get(SAMPLES_PER_PIXEL, [1])[0]
    scheme, predictor = fields.get(COMPRESSION, [NONE])[0], fields.get(PREDICTOR, [1])[0]
    planar, point = fields.get(PLANAR, [1])[0] == 2, fields.get(SAMPLE_FORMAT, [1])[0] == POINT
    if depth not in (1, 2, 4, 8, 16, 32):
        raise ValueError(f"{depth} bits a sample are not supported")
    if predictor not in (1, 2, 3) or (predictor == 2 and depth < 8):
        raise ValueError(f"predictor {predictor} of {depth} bits is not supported")
    if scheme not in GROWTH:
        raise ValueError(f"compression {scheme} is not supported")
    if point and depth < 16:
        raise ValueError(f"numbers with a point of {depth} bits are not supported")
    kind = np.dtype(f"{'f' if point else 'u'}{max(depth, 8) // 8}")
    stored = kind.newbyteorder(">" if fields[0][0] else "<")
    inner = 1 if planar else spp
    tiled = TILE_OFFSETS in fields
    wide = fields[TILE_WIDTH][0] if tiled else width
    tall = fields[TILE_LENGTH][0] if tiled else min(fields.get(ROWS_PER_STRIP, [height])[0], height)
    if min(width, height, spp, wide, tall) < 1:
        raise ValueError(f"a page of {width} x {height} x {spp} in blocks of {wide} x {tall}")
    offsets, counts = (fields[TILE_OFFSETS], fields[TILE_BYTES]) if tiled else (fields[STRIP_OFFSETS], fields[STRIP_BYTES])
    across, down = -(-width // wide), -(-height // tall)
    if len(offsets) != len(counts) or len(offsets) < across * down * (spp if planar else 1):
        raise ValueError(f"{len(offsets)} blocks of {across * down * (spp if planar else 1)}")
    line = -(-wide * inner * depth // 8)  # every row begins with a new byte
    if line * height > GROWTH[scheme] * sum(counts) or sum(counts) > len(offsets) * len(data):
        raise ValueError(f"{sum(counts)} stored bytes can't be {width} x {height} x {spp} samples")
    out = np.zeros((height, width, spp), kind)
    for k, (start, length) in enumerate(zip(offsets, counts, strict=True)):
        plane, place = divmod(k, across * down)
        y, x = place // across * tall, place % across * wide
        rows = tall if tiled else min(tall, height - y)
        if plane >= (spp if planar else 1):
            break
        if line * rows > GROWTH[scheme] * max(length, 0):
            raise ValueError(f"{length} stored bytes can't be a block of {wide} x {rows}")
        raw = unpack(data[start : start + length], scheme, rows * line)
        if depth < 8:
            bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, line), axis=1)[:, : wide * inner * depth]
            block = (bits.reshape(rows, wide, inner, depth) << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=3).astype(np.uint8)
        else:
            block = np.frombuffer(raw, stored).reshape(rows, wide, inner).astype(kind)
        block = undone(block, raw, predictor, point)
        part = block[: height - y, : width - x]
        to = slice(plane, plane + 1) if planar else slice(0, spp)
        out[y : y + part.shape[0], x : x + part.shape[1], to] = part
    return out


def page_feature(samples: np.ndarray) -> str:
    """Size, mean, spread, entropy of the sample values, and a 64-bit difference hash, as text."""
    flat = samples.reshape(-1)
    low = flat.view(np.dtype(f"u{flat.itemsize}")) & 255
    share = np.bincount(low.astype(np.uint8), minlength=256) / max(flat.size, 1)
    some = share[share > 0]
    entropy = float(-(some * np.log2(some)).sum())
    rows = np.array_split(np.arange(samples.shape[0]), 8)
    bars = np.array([samples[r].mean() if r.size else 0.0 for r in rows])
    columns = samples.mean(axis=(0, 2)) if flat.size else np.zeros(1)
    coarse = np.array([c.mean() if c.size else 0.0 for c in np.array_split(columns, 9)])
    grid = bars[:, None] + coarse[None, :]
    bits = np.packbits(np.diff(grid, axis=1) > 0).tobytes().hex()
    mean, spread = (float(flat.mean()), float(flat.std())) if flat.size else (0.0, 0.0)
    return f"{samples.shape[1]}x{samples.shape[0]}x{samples.shape[2]}:{mean:.4f}:{spread:.4f}:{entropy:.4f}:{bits}"


PAGE_FIELDS = T.StructType(
    [
        T.StructField("page", T.IntegerType()),
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("samples_per_pixel", T.IntegerType()),
        T.StructField("bits", T.IntegerType()),
        T.StructField("compression", T.StringType()),
        T.StructField("predictor", T.IntegerType()),
        T.StructField("tiled", T.BooleanType()),
        T.StructField("samples", T.BinaryType()),
        T.StructField("feature", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def pages_of(data: bytes | None) -> Iterator[tuple]:
    if data is None:
        yield (None,) * 10 + ("no media",)
        return
    try:
        for page, fields in enumerate(directories(data)):
            first = lambda tag, default: fields.get(tag, [default])[0]  # noqa: B023, E731
            scheme = first(COMPRESSION, NONE)
            head = (page, first(WIDTH, None), first(LENGTH, None), first(SAMPLES_PER_PIXEL, 1), first(BITS, 1), SCHEMES.get(scheme, str(scheme)), first(PREDICTOR, 1), TILE_OFFSETS in fields)
            try:
                samples = read_page(data, fields)
                made = (*head, samples.tobytes(), page_feature(samples), None)
            except (KeyError, ValueError, IndexError, ArithmeticError, MemoryError, TypeError, zlib.error, struct.error) as e:
                made = (*head, None, None, f"{type(e).__name__}: {e}"[:200])
            yield made
    except (ValueError, struct.error) as e:
        yield (None,) * 10 + (f"{type(e).__name__}: {e}"[:200],)


def payload(text: Column) -> Column:
    """UTF-8 bytes of a text (null: empty), then bytes 0 up to a positive multiple of 64."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(raw)
    pad = F.greatest(F.ceil(size / PAYLOAD_UNIT) * PAYLOAD_UNIT, F.lit(PAYLOAD_UNIT)) - size
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), pad.cast("int"))))


def _store(data: bytes) -> bytes:
    """Scheme, predictor and layout follow from the payload, so equal payloads are stored alike."""
    pick = zlib.crc32(data)
    scheme = (PACKBITS, LZW, DEFLATE, DEFLATE)[pick % 4]
    predictor = 2 if scheme != PACKBITS and pick // 4 % 2 else 1
    image = np.frombuffer(data, np.uint8).reshape(-1, PAYLOAD_UNIT)
    return write_tiff([image], scheme, predictor, tile=64 if pick // 8 % 2 else 0)


def store_payloads(df: DataFrame, column: str = "payload", out: str = "media") -> DataFrame:
    """``df`` with each payload (a positive multiple of 64 bytes) stored as a TIFF file, 64 samples a row."""
    kept = [c for c in df.columns if c not in (column, out)]
    places, at = [df.columns.index(c) for c in kept], df.columns.index(column)
    schema = T.StructType([*(df.schema[i] for i in places), T.StructField(out, T.BinaryType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                media = pa.array([None if p is None else _store(p) for p in part.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), media], schema=arrow)

    return arrow_map(df, run, schema)


def tiff_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row for each page of each file: the other columns of ``df`` and the fields of PAGE_FIELDS."""
    kept = [c for c in df.columns if c != media and c not in PAGE_FIELDS.names]
    places, at = [df.columns.index(c) for c in kept], df.columns.index(media)
    schema = T.StructType([*(df.schema[i] for i in places), *PAGE_FIELDS.fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                rows, of = [], []
                for i, data in enumerate(part.column(at).to_pylist()):
                    made = list(pages_of(data))
                    rows += made
                    of += [i] * len(made)
                lead = part.take(pa.array(of, pa.int64()))
                own = [pa.array([r[k] for r in rows], arrow.field(f.name).type) for k, f in enumerate(PAGE_FIELDS)]
                yield pa.RecordBatch.from_arrays([*(lead.column(i) for i in places), *own], schema=arrow)

    return arrow_map(df, run, schema)
