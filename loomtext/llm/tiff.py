"""TIFF media columns: a reader that yields one row per page, and a writer for 8-bit grey pages.

The reader walks the image directories of classic and big TIFF files in either byte order, decodes strips or tiles
(none, PackBits, LZW, deflate), undoes the horizontal and the floating-point predictor and joins planes. Null or
empty files give no rows; a file or page that can't be decoded gives one row with `error` set and null pixels; a
directory that occurs twice ends the walk. Samples keep their width; pixels are rows of interleaved samples in
little-endian order. Bit depths under 8 stay packed, so that each row ends at a byte. A page that claims more pixels than
its blocks can hold, or tags of other kinds than the format names, is undecodable; no block is inflated beyond its size.

Repeated rows give their pages each, in no order among them; an empty table gives none. Very long texts are one page of
many strips. Of other columns only those asked for are carried along, and these must not be named as a page's columns.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from loomtext.llm._arrays import binary_column, slices
from loomtext.llm._held import release
from loomtext.runtime import ship

# Fixed values of the format: tags, field types' sizes and codes, compressions.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILES, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
FIELDS = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {RAW: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}

#: Bytes that one byte of a block can stand for, at most, by compression.
EXPANSION = {RAW: 1, PACKBITS: 64, LZW: 2600, DEFLATE: 1040, OLD_DEFLATE: 1040}

#: Samples in a row and rows in a strip of written pages; bytes of text handled at a time.
ROW, STRIP = 64, 256
PIECE_BYTES = 1 << 20


def packbits_decode(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        elif n > 128:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
        else:
            at += 1
    return b"".join(out)


def packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        end = at + 1
        while end < len(data) and end - at < 128 and not (end + 1 < len(data) and data[end] == data[end + 1]):
            end += 1
        out.append(end - at - 1)
        out += data[at:end]
        at = end
    return bytes(out)


def lzw_decode(data: bytes, size: int | None = None) -> bytes:
    """The format's LZW: codes from the high bit on, 9 to 12 bits, 256 clears, 257 ends; widths grow one code early.
    Stops once `size` bytes are there."""
    out, bits, held, width, last, at = [], 0, 0, 9, None, 0
    fresh = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, made = fresh[:], 0
    while size is None or made < size:
        while held < width:
            if at >= len(data):
                return b"".join(out)
            bits, held, at = bits << 8 | data[at], held + 8, at + 1
        held -= width
        code, bits = bits >> held, bits & ((1 << held) - 1)
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, width, last = fresh[:], 9, None
            continue
        if code < len(table):
            word = table[code]
        elif code == len(table) and last is not None:
            word = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out.append(word)
        made += len(word)
        if last is not None and len(table) < 4096:
            table.append(last + word[:1])
            width = min(12, max(9, (len(table) + 1).bit_length()))
        last = word
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    table = {bytes((i,)): i for i in range(256)}
    size, width, bits, held, out, word = 258, 9, 256, 9, bytearray(), b""

    def put(code):
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1

    while held >= 8:
        held -= 8
        out.append(bits >> held & 255)
    bits &= (1 << held) - 1
    for b in data:
        longer = word + bytes((b,))
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = size
        size += 1
        if size == 4094:
            put(256)
            table, size, width = {bytes((i,)): i for i in range(256)}, 258, 9
        else:
            width = max(9, (size).bit_length())
        word = bytes((b,))
    if word:
        put(table[word])
        size += 1
        width = min(12, max(9, size.bit_length()))
    put(257)
    if held:
        out.append(bits << (8 - held) & 255)
    return bytes(out)


def inflate(data: bytes, compression: int, size: int) -> bytes:
    """The block's bytes, `size` of them at most where it was compressed."""
    if compression == RAW:
        return bytes(data)
    if compression == PACKBITS:
        return packbits_decode(data)
    if compression == LZW:
        return lzw_decode(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, max(1, size))
    raise ValueError(f"compression {compression} isn't supported")


def directories(data: bytes):
    """The tags of each image directory: {tag: list of values}."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8:
        raise ValueError("no TIFF file")
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic not in (42, 43):
        raise ValueError("no TIFF file")
    big = magic == 43
    number, count, entry, inline = ("Q", "Q", 20, 8) if big else ("I", "H", 12, 4)
    at, seen = struct.unpack_from(order + number, data, 8 if big else 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + count, data, at)[0]
        first, tags = at + (8 if big else 2), {}
        for i in range(n):
            tag, kind, many = struct.unpack_from(order + "HH" + number, data, first + i * entry)
            size, code = FIELDS.get(kind, (0, ""))
            if not size:
                continue
            value = first + i * entry + entry - inline
            if size * many > inline:
                value = struct.unpack_from(order + number, data, value)[0]
            if value + size * many > len(data):
                raise ValueError("a tag's values end past the file")
            tags[tag] = list(struct.unpack_from(f"{order}{many}{code}", data, value))
        yield order, tags
        at = struct.unpack_from(order + number, data, first + n * entry)[0]


def _block(raw: bytes, order: str, rows: int, width: int, samples: int, bits: int, predictor: int) -> np.ndarray:
    """Rows of one strip or tile as bytes in little-endian order."""
    size = (width * samples * bits + 7) // 8
    flat = np.frombuffer(raw[: rows * size].ljust(rows * size, b"\0"), np.uint8).reshape(rows, size)
    if predictor == 3:
        deep = bits // 8
        flat = np.cumsum(flat.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, deep, width * samples)
        return np.ascontiguousarray(flat[:, ::-1].transpose(0, 2, 1)).reshape(rows, size)
    if bits in (16, 32, 64):
        kind = f"u{bits // 8}"
        wide = flat.view(order + kind).astype("<" + kind)
        if predictor == 2:
            wide = np.cumsum(wide.reshape(rows, width, samples), axis=1, dtype=wide.dtype).reshape(rows, -1)
        return np.ascontiguousarray(wide).view(np.uint8).reshape(rows, size)
    if predictor == 2:
        if bits != 8:
            raise ValueError("predictor 2 needs whole bytes")
        return np.cumsum(flat.reshape(rows, width, samples), axis=1, dtype=np.uint8).reshape(rows, size)
    return flat


def read_page(data: bytes, order: str, tags: dict) -> dict:
    used = (WIDTH, LENGTH, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILES, TILE_BYTES)
    if any(not isinstance(v, int) or v < 0 for tag in used for v in tags.get(tag, ())):
        raise ValueError("a tag that isn't a whole number")
    one = lambda tag, default: (tags.get(tag) or [default])[0]
    width, height, samples, bits = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1), one(BITS, 1)
    if not 1 <= samples <= 65535 or not 1 <= bits <= 64:
        raise ValueError("no samples, or of a width that isn't supported")
    compression, predictor, planes = one(COMPRESSION, RAW), one(PREDICTOR, 1), samples if one(PLANAR, 1) == 2 else 1
    if predictor not in (1, 2, 3) or (predictor == 3 and bits not in (16, 32, 64)):
        raise ValueError(f"predictor {predictor} isn't supported for {bits} bits")
    if compression not in EXPANSION:
        raise ValueError(f"compression {compression} isn't supported")
    within = samples // planes
    if len(set(tags.get(BITS, [1]))) > 1 or (bits < 8 and planes * within > 1 and planes > 1):
        raise ValueError("samples of unlike widths")
    if TILES in tags:
        wide, high, places, sizes = one(TILE_WIDTH, width), one(TILE_LENGTH, height), tags[TILES], tags[TILE_BYTES]
    else:
        wide, high = width, min(one(STRIP_ROWS, height), height) or 1
        places, sizes = tags[STRIPS], tags.get(STRIP_BYTES) or [len(data)]
    if TILES in tags and not (wide and high):
        raise ValueError("tiles without width or height")
    across, down = max(1, -(-width // wide)) if wide else 1, max(1, -(-height // high))
    if bits < 8 and across > 1 and wide * within * bits % 8:
        raise ValueError("tiles that end within a byte")
    row_bytes, block_bytes = (width * within * bits + 7) // 8, (wide * within * bits + 7) // 8
    held = sum(max(0, min(place + size, len(data)) - place) for place, size in zip(places, sizes, strict=False))
    if max(planes * height * row_bytes, high * block_bytes) > EXPANSION[compression] * min(held, len(data)) + 4096:
        raise ValueError("more pixels than the blocks can hold")
    out = np.zeros((planes, height, row_bytes), np.uint8)
    for i, (place, size) in enumerate(zip(places, sizes, strict=False)):
        plane, j = divmod(i, across * down)
        if plane >= planes:
            break
        y, x = j // across * high, j % across * block_bytes
        rows = high if TILES in tags else min(high, height - y)
        got = _block(inflate(data[place : place + size], compression, rows * block_bytes), order, rows, wide, within, bits, predictor)
        got = got[: height - y, : row_bytes - x]
        out[plane, y : y + got.shape[0], x : x + got.shape[1]] = got
    if planes > 1:
        out = out.reshape(planes, height, width, bits // 8).transpose(1, 2, 0, 3)
    return {"width": width, "height": height, "samples": samples, "bits": bits, "compression": NAMES[compression], "predictor": predictor, "tiled": TILES in tags, "pixels": out.tobytes()}


def feature_of(pixels: bytes) -> str:
    """A page's histogram over 16 equal ranges of byte values, in 1/65535 of all bytes, as 4 hex digits each."""
    counts = np.bincount(np.frombuffer(pixels, np.uint8) >> 4, minlength=16)
    return (counts * 65535 // max(1, counts.sum())).astype(">u2").tobytes().hex()


def write_tiff(payloads: list[bytes], row: int = ROW, strip: int = STRIP, compression: int = DEFLATE, predictor: int = 2, level: int = 1) -> bytes:
    """A little-endian file with one grey 8-bit page per payload; each payload is whole rows of `row` samples."""
    packed = {RAW: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, level)}[compression]
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for payload in payloads:
        image = np.frombuffer(payload, np.uint8).reshape(-1, row)
        if predictor == 2:
            image = np.diff(image, axis=1, prepend=np.uint8(0))
        places, sizes = [], []
        for y in range(0, len(image), strip):
            block = packed(image[y : y + strip].tobytes())
            places.append(len(out))
            sizes.append(len(block))
            out += block
        out += b"\0" * (len(out) % 2)
        lists = []
        for values in (places, sizes):
            lists.append(len(out) if len(values) > 1 else values[0])
            if len(values) > 1:
                out += struct.pack(f"<{len(values)}I", *values)
        struct.pack_into("<I", out, link, len(out))
        n = len(places)
        tags = [(WIDTH, 4, 1, row), (LENGTH, 4, 1, len(image)), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 1), (STRIPS, 4, n, lists[0]), (SAMPLES, 3, 1, 1), (STRIP_ROWS, 4, 1, strip), (STRIP_BYTES, 4, n, lists[1]), (PLANAR, 3, 1, 1), (PREDICTOR, 3, 1, predictor)]
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def padded(payload: bytes, unit: int = ROW) -> bytes:
    """The payload with bytes 0 up to a positive multiple of `unit`."""
    return payload.ljust(max(1, -(-len(payload) // unit)) * unit, b"\0")


def _encode(key: str, batches):
    for batch in batches:
        for piece in slices(batch, batch.schema.names[1], PIECE_BYTES):
            texts = piece.column(1)
            media = [write_tiff([padded((t.as_py() or "").encode())]) for t in texts]
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column(0), sizes, binary_column(media)], names=[key, "n_bytes", "media"])


_PAGE = [("page", pa.int32()), ("width", pa.int64()), ("height", pa.int64()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.string()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("feature", pa.string()), ("error", pa.string())]
PAGE = "page int, width bigint, height bigint, samples int, bits int, compression string, predictor int, tiled boolean, pixels binary, feature string, error string"


def read_tiff(data: bytes):
    """One dict per page; an undecodable page, or the rest of a broken file, is a dict with `error`."""
    number = 0
    try:
        for number, (order, tags) in enumerate(directories(data)):  # noqa: B007
            try:
                page = read_page(data, order, tags)
                yield {"page": number, "error": None, "feature": feature_of(page["pixels"]), **page}
            except (ValueError, KeyError, IndexError, TypeError, OverflowError, struct.error, zlib.error) as e:
                yield {"page": number, "error": f"{type(e).__name__}: {e}"}
    except (ValueError, OverflowError, struct.error) as e:
        yield {"page": number, "error": f"{type(e).__name__}: {e}"}


def _pages(column: str, batches):
    release()
    for batch in batches:
        schema = pa.schema([*batch.schema, *_PAGE])
        media = batch.schema.get_field_index(column)
        for piece in slices(batch, column, PIECE_BYTES):
            rows, pages = [], []
            for i, data in enumerate(piece.column(media)):
                for page in read_tiff(data.as_py()) if data.as_py() else ():
                    rows.append(i)
                    pages.append(page)
            kept = piece.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([p.get(n) for p in pages], t) for n, t in _PAGE)], schema=schema)


_DIGESTS = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
DIGESTS = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _digests(key: str, batches):
    release()
    for batch in _encode(key, batches):
        rows = []
        for size, media in zip(batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
            media = media.as_py()
            for page in read_tiff(media):
                pixels = page["pixels"]
                rows.append((size, len(pixels), hashlib.sha256(pixels).hexdigest(), zlib.crc32(pixels[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), page["feature"]))
        columns = zip(*rows, strict=True) if rows else [()] * len(_DIGESTS)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, _DIGESTS, strict=True))], names=[key, *(n for n, _ in _DIGESTS)])


def text_digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, columns of DIGESTS): each text written as by encode_texts, read back as by pages, and hashed, in one
    worker, so that neither files nor pixels are moved."""
    ship(df.sparkSession)
    return df.select(key, text).mapInArrow(partial(_digests, key), f"`{key}` {df.schema[key].dataType.simpleString()}, {DIGESTS}")


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_bytes, media): each text's UTF-8 bytes as the samples of one page; null counts as empty."""
    ship(df.sparkSession)
    return df.select(key, text).mapInArrow(partial(_encode, key), f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes bigint, media binary")


def pages(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per page: the columns in `keep`, the media column, and those of PAGE."""
    ship(df.sparkSession)
    held = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (*keep, media))
    return df.select(*keep, media).mapInArrow(partial(_pages, media), f"{held}, {PAGE}")
