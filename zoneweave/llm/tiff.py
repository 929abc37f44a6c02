"""Media columns: TIFF files, one row a page; a small writer for stored payloads."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, table, texts_of

#: Fixed values of the format: tag numbers, field sizes, compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_OFFSETS, TILE_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
FIELD = {1: "B", 3: "H", 4: "I", 16: "Q"}
RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


def pack_bits(data: bytes) -> bytes:
    """PackBits of one row: runs of three and more equal bytes, else literals."""
    out, at = bytearray(), 0

    def literal(part: bytes) -> None:
        for i in range(0, len(part), 128):
            out.append(len(part[i : i + 128]) - 1)
            out.extend(part[i : i + 128])

    for m in re.finditer(rb"(?s)(.)\1{2,127}", data):
        literal(data[at : m.start()])
        out += bytes([257 - (m.end() - m.start()), data[m.start()]])
        at = m.end()
    literal(data[at:])
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at, end = bytearray(), 0, len(data)
    while at < end and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw_widths(n: int) -> np.ndarray:
    """Bits of each of the n codes that follow a clear code: one more from the entry of all ones on, 12 at most."""
    entry = 258 + np.arange(n)
    return 9 + (entry >= 512) + (entry >= 1024) + (entry >= 2048)


def lzw_encode(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, high bit first; a code width ends with the entry of all ones."""
    codes, clears = [256], [0]
    book: dict[int, int] = {}  # (code, byte) -> code
    find, put, nxt, rest = book.get, codes.append, 258, iter(data)
    cur = next(rest, -1)
    for byte in rest:
        key = cur << 8 | byte
        got = find(key)
        if got is not None:
            cur = got
            continue
        put(cur)
        cur = byte
        book[key] = nxt
        nxt += 1
        if nxt == 4095:
            clears.append(len(codes))
            put(256)
            book.clear()
            nxt = 258
    if cur >= 0:
        put(cur)
    codes.append(257)
    ends = [*clears[1:], len(codes)]
    width = np.concatenate([[9], *(lzw_widths(e - s) for s, e in zip(clears, ends, strict=True))])[: len(codes)]
    value, shift = np.array(codes, np.int64), np.arange(11, -1, -1)
    bits = ((value[:, None] >> shift) & 1).astype(np.uint8)
    return np.packbits(bits[shift[None, :] < width[:, None]]).tobytes()


#: Widths of the codes after a clear code, which must follow before a table of 4,096 entries is full.
_WIDTHS = lzw_widths(4096)


def lzw_table(code: np.ndarray) -> np.ndarray:
    """Bytes of the codes of one table. Entry 258 + i repeats what code i wrote and one byte more, so each byte of a code
    is a copy of an earlier output byte or a literal: lengths and sources are found by doubling steps along these chains."""
    n = len(code)
    literal = code < 256
    of = np.where(literal, -1, code - 258)
    if (of >= np.arange(n)).any():
        raise ValueError("LZW code beyond its table")
    size, up = np.ones(n, np.int64), of
    while (up >= 0).any():
        size = size + np.where(up >= 0, size[up], 0)
        up = np.where(up >= 0, up[up], -1)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(n), size)
    place = np.arange(len(owner))
    source = np.where(literal[owner], place, start[of[owner]] + place - start[owner])
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    return code[owner[source]].astype(np.uint8)


def lzw_decode(data: bytes, size: int) -> bytes:
    """At least `size` bytes of an LZW stream, or what there is: the codes up to the next clear code at once."""
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    at, have, out = 0, 0, []
    while have < size:
        count = (8 * len(data) - at) // 9
        width = _WIDTHS if count >= len(_WIDTHS) else lzw_widths(count)
        ends = at + np.cumsum(width)
        width = width[: int(np.searchsorted(ends, 8 * len(data), "right"))]
        first = ends[: len(width)] - width
        byte = first >> 3
        code = (raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (24 - (first & 7) - width) & ((1 << width) - 1)
        stop = np.flatnonzero((code == 256) | (code == 257))
        n = int(stop[0]) if len(stop) else len(code)
        if n:
            out.append(lzw_table(code[:n]))
            have += len(out[-1])
        if not len(stop) or code[n] == 257:
            break
        at = int(ends[n])
    return b"".join(x.tobytes() for x in out)


def inflate(kind: int, data: bytes, rows: int, row_bytes: int) -> bytes:
    size = rows * row_bytes
    if kind == RAW:
        out = data
    elif kind == PACKBITS:
        out = unpack_bits(data, size)
    elif kind == LZW:
        out = lzw_decode(data, size)
    elif kind in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    else:
        raise ValueError(f"compression {kind}")
    if len(out) < size:
        raise ValueError(f"{len(out)} bytes of a segment's {size}")
    return out[:size]


def deflate(kind: int, x: np.ndarray) -> bytes:
    """A segment (rows, columns, samples) in its stored form."""
    if kind == PACKBITS:
        return b"".join(pack_bits(r.tobytes()) for r in x)
    data = x.tobytes()
    return lzw_encode(data) if kind == LZW else zlib.compress(data, 6) if kind == DEFLATE else data


def write_tiff(image: np.ndarray, kind: int, predictor: int = 1, tile: int = 0, rows: int = 64) -> bytes:
    """One page of 8-bit samples (height, width, samples), little-endian, in strips or square tiles."""
    h, w, n = image.shape
    if tile:
        padded = np.pad(image, ((0, -h % tile), (0, -w % tile), (0, 0)))
        segments = [padded[y : y + tile, x : x + tile] for y in range(0, h, tile) for x in range(0, w, tile)]
    else:
        segments = [image[y : y + rows] for y in range(0, h, rows)]
    if predictor == 2:
        segments = [np.concatenate([s[:, :1], np.diff(s, axis=1)], axis=1) for s in segments]
    data = [deflate(kind, np.ascontiguousarray(s)) for s in segments]
    at = 8 + np.concatenate([[0], np.cumsum([len(d) for d in data])])
    offsets, counts, end = at[:-1].tolist(), [len(d) for d in data], int(at[-1])
    blank = b"\0" * (end % 2)
    end += len(blank)
    fields = {WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [8] * n), COMPRESSION: (3, [kind]), PHOTOMETRIC: (3, [2 if n == 3 else 1]), SAMPLES: (3, [n]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
    fields |= {TILE_W: (4, [tile]), TILE_H: (4, [tile]), TILE_OFFSETS: (4, offsets), TILE_COUNTS: (4, counts)} if tile else {OFFSETS: (4, offsets), ROWS: (4, [rows]), COUNTS: (4, counts)}
    entries, tail = b"", b""
    free = end + 2 + 12 * len(fields) + 4
    for tag, (ft, values) in sorted(fields.items()):
        raw = struct.pack(f"<{len(values)}{FIELD[ft]}", *values)
        if len(raw) > 4:
            entries += struct.pack("<HHII", tag, ft, len(values), free + len(tail))
            tail += raw + b"\0" * (len(raw) % 2)
        else:
            entries += struct.pack("<HHI", tag, ft, len(values)) + raw.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, end) + b"".join(data) + blank + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + tail


def directories(data: bytes):
    """Tags of each image directory in file order: tag -> values. A chain that turns back is an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        n, tags = struct.unpack_from(order + "H", data, at)[0], {}
        for i in range(n):
            tag, ft, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if ft not in FIELD:
                continue
            size = struct.calcsize(order + FIELD[ft]) * count
            where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            try:
                tags[tag] = struct.unpack_from(f"{order}{count}{FIELD[ft]}", data, where)
            except struct.error:  # values outside the file: an error of the page that needs them, not of the chain
                tags[tag] = ()
        yield order, tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def read_page(data: bytes, order: str, tags: dict) -> tuple[np.ndarray, dict]:
    """Samples (height, width, samples) of a page of 8- or 16-bit samples, and how it was stored."""
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    w, h, n, kind, predictor = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(COMPRESSION, RAW), one(PREDICTOR, 1)
    bits = one(BITS, 1)
    if not w or not h or bits not in (8, 16) or len(set(tags.get(BITS, (1,)))) > 1 or predictor not in (1, 2):
        raise ValueError(f"unsupported page: {w} x {h}, {tags.get(BITS)} bits, predictor {predictor}")
    tiled, planes = TILE_OFFSETS in tags, n if one(PLANAR, 1) == 2 else 1
    sw, sh = (one(TILE_W), one(TILE_H)) if tiled else (w, min(one(ROWS, h), h))
    offsets = tags[TILE_OFFSETS if tiled else OFFSETS]
    counts = tags[TILE_COUNTS if tiled else COUNTS]
    across, down, per = -(-w // sw), -(-h // sh), n // planes
    if len(offsets) < across * down * planes or len(counts) < len(offsets):
        raise ValueError("missing segments")
    kind_of = np.dtype(np.uint8 if bits == 8 else order + "u2")
    out = np.zeros((h, w, n), kind_of.newbyteorder("="))
    for k in range(across * down * planes):
        plane, place = divmod(k, across * down)
        y, x = place // across * sh, place % across * sw
        rows = sh if tiled else min(sh, h - y)
        raw = data[offsets[k] : offsets[k] + counts[k]]
        s = np.frombuffer(inflate(kind, raw, rows, sw * per * kind_of.itemsize), kind_of).reshape(rows, sw, per).astype(out.dtype)
        if predictor == 2:
            s = np.cumsum(s, axis=1, dtype=out.dtype)
        s = s[: h - y, : w - x]
        out[y : y + s.shape[0], x : x + s.shape[1], plane * per : plane * per + per] = s
    return out, {"compression": kind, "predictor": predictor, "layout": "tiles" if tiled else "strips", "bits": bits, "segments": across * down * planes}


PAGE = "page int, width int, height int, samples int, bits int, compression int, predictor int, layout string, segments int, pixels binary, error string"


def _pages(media: str, keep: list[str], schema: pa.Schema):
    def rows_of(data: bytes | None):
        if data is None:
            return [(None,) * 10 + ("null",)]
        out, bad = [], (ValueError, KeyError, IndexError, struct.error, zlib.error, OverflowError, MemoryError)
        fail = lambda e: out.append((len(out), *(None,) * 9, f"{type(e).__name__}: {e}"[:200]))
        try:
            for i, (order, tags) in enumerate(directories(data)):
                try:
                    x, how = read_page(data, order, tags)
                    out.append((i, x.shape[1], x.shape[0], x.shape[2], how["bits"], how["compression"], how["predictor"], how["layout"], how["segments"], x.tobytes(), None))
                except bad as e:  # this page only; the next directory is found without it
                    fail(e)
        except bad as e:
            fail(e)
        return out or [(None,) * 10 + ("no page",)]

    def run(batches):
        for b in batches:
            rows, at = [], []
            for i, data in enumerate(b.column(media)):
                got = rows_of(data.as_py())
                rows += got
                at += [i] * len(got)
            cols = list(zip(*rows, strict=True)) if rows else [()] * 11
            kept = [b.column(c).take(pa.array(at, pa.int64())) for c in keep]
            pages = schema.names[len(keep) :]
            yield pa.record_batch([*kept, *(pa.array(c, schema.field(n).type) for c, n in zip(cols, pages, strict=True))], names=[*keep, *pages])

    return run


def tiff_pages(files: DataFrame, media_col: str, keep: list[str]) -> DataFrame:
    """One row a page of each TIFF file in a binary column: keep columns, then page (from 0), width, height,
    samples, bits, compression, predictor, layout, segments, pixels (row by row, native byte order), error.

    Both byte orders; 8- and 16-bit samples; raw, PackBits, LZW and deflate; strips and tiles; chunky and
    planar; predictor 2. A page that is damaged or unsupported gives a row with error set and the next pages
    follow; where the directories themselves end in damage, one such row is the last. So no file fails a job. Rows stream in batches bounded by bytes, without a shuffle; each file
    is decoded alone. Repeated rows repeat; an empty table gives an empty result. A keep column named like
    an output column comes back as kept_<name>; other columns are not read.
    """
    bound_batches(files.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    page = StructType.fromDDL(PAGE)
    names = [f"kept_{c}" if c in page.names else c for c in keep]
    files = files.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(media_col).alias("_media"))
    schema = StructType([*files.select(*names).schema.fields, *page.fields])
    return files.mapInArrow(_pages("_media", names, to_arrow_schema(schema)), schema)


#: Samples of a stored row: 64 pixels of three samples.
ROW = 192
#: Stored forms, picked by the payload's crc32: compression, predictor.
FORMS = ((PACKBITS, 1), (LZW, 2), (DEFLATE, 2))


def store(payload: bytes) -> bytes:
    """The TIFF form of a payload whose length is a multiple of ROW; equal payloads, equal files."""
    c = zlib.crc32(payload)
    kind, predictor = FORMS[c % len(FORMS)]
    return write_tiff(np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3), kind, predictor, tile=32 if c // 3 % 2 else 0)


def _store(id_col: str, text_col: str):
    def run(batches):
        for b in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in texts_of(b, text_col)]
            media = [store(t.ljust(max(1, -(-len(t) // ROW)) * ROW)) for t in raw]
            yield pa.record_batch([b.column(id_col), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return run


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (of the UTF-8 text; null: 0) and media, a one-page TIFF of the text padded with spaces
    to a positive multiple of 192 bytes. Row by row: repeats, ties and null ids pass; other columns are not read."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_store(id_col, text_col), f"`{id_col}` {kind}, n_bytes long, media binary")


def op7(spark, sf_dir):
    files = store_texts(table(spark, sf_dir, "documents")).withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    pages = tiff_pages(files, "media", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    feature = F.concat_ws(":", "width", "height", "samples", "compression", "predictor", "layout", "segments", F.crc32("pixels"), "error")
    return pages.select(
        "doc_id", "n_bytes", F.octet_length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"),
    )
