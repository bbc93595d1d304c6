"""TIFF in media columns: walk image directories, decode strips or tiles, undo predictors, one row per page.

Both byte orders and the 64-bit variant; compression none, PackBits, LZW or deflate; predictors none, horizontal (8, 16
and 32 bits) and floating point; samples side by side or in planes.  A page that can't be read gives a row with its
error instead of pixels, and the pages before and after it are still read; a file without a readable directory gives
one row with page null.  A directory that was met before ends the walk.

``store`` writes bytes as 8-bit grey samples, ``WIDTH`` to a row and ``PAGE_ROWS`` rows to a page, so that long payloads
have several pages.  The pages take the ``LAYOUTS`` - codec, predictor, strips or tiles - in turn, beginning with one that
a checksum of the payload names: equal payloads, equal files, and every layout gets payloads of all sizes.

A strip or tile is decoded no further than its pixels, and a page that claims more pixels than the file's bytes can hold,
or more than a value of Spark can (``MOST_BYTES``), is a row with an error.  Null media are rows with an error.  Null texts are empty.  Repeated rows give equal values.  A file is one row and one
task's work; pages are made one by one.  No shuffle.  Other columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import for_workers

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, PAGE_ROWS = 64, 1024
STRIP_ROWS, TILE = 256, 64
#: Compression, predictor and tile size (0: strips) of stored pages, in turn.
LAYOUTS = ((LZW, 1, 0), (PACKBITS, 1, 0), (DEFLATE, 2, 0), (LZW, 2, TILE), (DEFLATE, 2, TILE))
#: A page of more bytes of pixels than this is an error, not an allocation: it is one binary value.
MOST_BYTES = 1 << 30
#: No codec here makes more bytes than this of one.
MOST_RATIO = 4096

#: Field type -> size and format.
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


@dataclass
class Page:
    page: int
    width: int = 0
    height: int = 0
    samples: int = 0
    bits: int = 0
    compression: int = 0
    predictor: int = 0
    pixels: bytes | None = None
    error: str | None = None


def unpackbits(data: bytes, limit: int) -> bytes:
    out, at, size, made = [], 0, len(data), 0
    while at < size and made < limit:
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += n + 2
        elif n > 128:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
        else:
            at += 1
            continue
        made += len(out[-1])
    return b"".join(out)[:limit]


RUN = re.compile(rb"(.)\1{2,127}", re.S)


def packbits(data: bytes) -> bytes:
    out, at = [], 0

    def plain(part: bytes) -> None:
        out.extend(bytes([len(part[k : k + 128]) - 1]) + part[k : k + 128] for k in range(0, len(part), 128))

    for m in RUN.finditer(data):
        plain(data[at : m.start()])
        out.append(bytes([257 - (m.end() - m.start())]) + m[1])
        at = m.end()
    plain(data[at:])
    return b"".join(out)


_SINGLE = [bytes([k]) for k in range(256)]
CLEAR, STOP, FIRST = 256, 257, 258
#: Codes of a table from its clear code on: the last one makes it as full as 12 bits allow.
EPOCH = 4096 - FIRST
#: Bits of the k-th code after a clear code as a reader sees it, and where it begins.
_WIDTHS = np.select([np.arange(EPOCH) < n - FIRST + 1 for n in (511, 1023, 2047)], [9, 10, 11], 12)
_STARTS = np.concatenate([[0], np.cumsum(_WIDTHS)])


def unlzw(data: bytes, limit: int) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first; 256 starts a new table, 257 ends.

    All codes up to the next clear code have known places, so they are cut out at once.
    """
    out: list[bytes] = []
    made, at, bits = 0, 0, 8 * len(data)
    wide = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    wide = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]  # three bytes from each place on
    while made < limit:
        n = int(np.searchsorted(_STARTS, bits - at, side="right")) - 1
        begins = at + _STARTS[:n]
        codes = (wide[begins >> 3] >> (24 - (begins & 7) - _WIDTHS[:n]) & (1 << _WIDTHS[:n]) - 1).tolist()
        table: list[bytes] = [*_SINGLE, b"", b""]
        before = b""
        again = False
        for k, code in enumerate(codes):
            if code == CLEAR:
                at += int(_STARTS[k + 1])
                again = True
                break
            if code == STOP:
                break
            if code < len(table):
                entry = table[code]
            elif code == len(table) and before:
                entry = before + before[:1]
            else:
                raise ValueError("a code that isn't in the table")
            if before:
                table.append(before + entry[:1])
            out.append(entry)
            before = entry
            made += len(entry)
            if made >= limit:
                break
        else:
            if n == EPOCH:
                raise ValueError("a table without end")
        if not again:
            break
    return b"".join(out)[:limit]


def lzw(data: bytes) -> bytes:
    codes, widths = [CLEAR], [9]
    table: dict[int, int] = {}  # code of a word and a byte after it -> code of both
    following, width, word = FIRST, 9, -1
    for byte in data:
        if word < 0:
            word = byte
            continue
        longer = word << 8 | byte
        if (found := table.get(longer)) is not None:
            word = found
            continue
        codes.append(word)
        widths.append(width)
        table[longer] = following
        following += 1
        if following in (512, 1024, 2048):
            width += 1
        elif following == 4094:
            codes.append(CLEAR)
            widths.append(width)
            table = {}
            following, width = FIRST, 9
        word = byte
    if word >= 0:
        codes.append(word)
        widths.append(width)
        width += following + 1 in (512, 1024, 2048)
    codes.append(STOP)
    widths.append(width)
    n = np.array(widths)
    place = np.arange(12)
    bits = np.array(codes)[:, None] >> (11 - place) & 1
    return np.packbits(bits[place >= 12 - n[:, None]].astype(np.uint8)).tobytes()


def inflated(data: bytes, limit: int) -> bytes:
    return zlib.decompressobj().decompress(data, limit)


DECODERS = {NONE: lambda data, limit: data[:limit], LZW: unlzw, DEFLATE: inflated, OLD_DEFLATE: inflated, PACKBITS: unpackbits}
ENCODERS = {NONE: bytes, LZW: lzw, DEFLATE: lambda data: zlib.compress(data, 1), PACKBITS: packbits}


def unpredicted(data: bytes, rows: int, columns: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """Bytes of a strip or tile as (rows, bytes of a row), with the predictor undone."""
    if predictor == 2 and bits in (8, 16, 32):
        kind = np.dtype(f"{order}u{bits // 8}")
        x = np.frombuffer(data, kind, rows * columns * samples).reshape(rows, columns, samples)
        return np.cumsum(x, axis=1, dtype=kind.newbyteorder("=")).astype(kind).view(np.uint8).reshape(rows, -1)
    if predictor == 3 and bits in (16, 32, 64):
        size = bits // 8
        x = np.frombuffer(data, np.uint8, rows * columns * samples * size).reshape(rows, -1, samples)
        x = np.cumsum(x, axis=1, dtype=np.uint8).reshape(rows, size, columns * samples)
        x = x.transpose(0, 2, 1)  # planes of bytes, the highest first, back to numbers
        return (x if order == ">" else x[:, :, ::-1]).reshape(rows, -1)
    if predictor != 1:
        raise ValueError(f"predictor {predictor} with {bits} bits")
    wide = (columns * samples * bits + 7) // 8
    return np.frombuffer(data, np.uint8, rows * wide).reshape(rows, wide)


#: What reading a page whose fields or data are wrong can raise.
BROKEN = (ValueError, KeyError, IndexError, TypeError, ArithmeticError, MemoryError, struct.error, zlib.error)


class File:
    def __init__(self, data: bytes):
        self.data = data
        self.order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]), "")
        if not self.order:
            raise ValueError("not a TIFF")
        magic = self._take("H", 2)
        if magic not in (42, 43):
            raise ValueError("not a TIFF")
        self.big = magic == 43
        self.first = self._take("Q", 8) if self.big else self._take("I", 4)

    def _take(self, kind: str, at: int) -> int:
        return struct.unpack_from(self.order + kind, self.data, at)[0]

    def directories(self) -> Iterator[dict[int, tuple[str, int, int]]]:
        """The fields of each directory as (format, number, place): values are read when a page needs them, so that a
        field that points nowhere spoils its own page only."""
        met, at = set(), self.first
        while at and at not in met:
            met.add(at)
            count = self._take("Q" if self.big else "H", at)
            at += 8 if self.big else 2
            step = 20 if self.big else 12
            fields = {}
            for k in range(count):
                entry = at + k * step
                tag, kind = self._take("H", entry), self._take("H", entry + 2)
                n = self._take("Q" if self.big else "I", entry + 4)
                form = TYPES.get(kind)
                if form is None:
                    continue
                place = entry + (12 if self.big else 8)
                if struct.calcsize(form) * n > (8 if self.big else 4):
                    place = self._take("Q" if self.big else "I", place)
                fields[tag] = form, n, place
            at += count * step
            yield fields
            at = self._take("Q" if self.big else "I", at)

    def pages(self) -> Iterator[Page]:
        number = 0
        walk = self.directories()
        while True:
            try:
                fields = next(walk)
            except StopIteration:
                return
            except struct.error as e:
                yield Page(number, error=f"directory: {e}")
                return
            page = Page(number)
            try:
                self._read(page, Fields(self, fields))
            except BROKEN as e:
                page.pixels, page.error = None, f"{type(e).__name__}: {e}"
            yield page
            number += 1

    def _read(self, page: Page, fields: Fields) -> None:
        one = lambda tag, default: fields.get(tag, (default,))[0]
        page.width, page.height = fields[256][0], fields[257][0]
        page.samples, page.bits = one(277, 1), one(258, 1)
        page.compression, page.predictor = one(259, NONE), one(317, 1)
        planes = page.samples if one(284, 1) == 2 else 1
        sizes = [page.width, page.height, page.samples, page.bits, one(278, 1), *fields.get(322, (1,)), *fields.get(323, (1,))]
        if not all(isinstance(n, int) and n > 0 for n in sizes):
            raise ValueError("sizes that aren't positive whole numbers")
        if page.compression not in DECODERS:
            raise ValueError(f"compression {page.compression}")
        if len(set(fields.get(258, (1,)))) > 1:
            raise ValueError("samples of different sizes")
        decode = DECODERS[page.compression]
        tiled = 322 in fields
        columns, rows = (fields[322][0], fields[323][0]) if tiled else (page.width, min(one(278, page.height), page.height) or 1)
        starts, sizes = (fields[324], fields[325]) if tiled else (fields[273], fields[279])
        across, down = -(-page.width // columns), -(-page.height // rows)
        each = page.samples // planes
        if page.bits % 8 and (tiled or planes > 1):
            raise ValueError("tiles or planes of part bytes")
        wide = (page.width * each * page.bits + 7) // 8
        if wide * page.height * planes > min(MOST_BYTES, MOST_RATIO * len(self.data)):
            raise ValueError("too large")
        if tiled and columns * rows * each * page.bits // 8 > MOST_RATIO * len(self.data):
            raise ValueError("tiles that are too large")
        full = (columns * each * page.bits + 7) // 8
        if len(starts) < across * down * planes or len(sizes) < len(starts):
            raise ValueError("strips or tiles are missing")
        out = np.zeros((planes, page.height, wide), dtype=np.uint8)
        for k in range(across * down * planes):
            plane, rest = divmod(k, across * down)
            y, x = divmod(rest, across)
            top, left = y * rows, x * columns
            high = rows if tiled else min(rows, page.height - top)
            data = decode(self.data[starts[k] : starts[k] + sizes[k]], high * full)
            block = unpredicted(data, high, columns, each, page.bits, page.predictor, self.order)
            begin = left * each * page.bits // 8
            high, broad = min(high, page.height - top), min(block.shape[1], wide - begin)
            out[plane, top : top + high, begin : begin + broad] = block[:high, :broad]
        if planes > 1:  # planes go side by side, as in other files
            size = page.bits // 8
            out = out.reshape(planes, page.height, page.width, size).transpose(1, 2, 0, 3)
        page.pixels = out.tobytes()


class Fields:
    """A directory's values by tag, read from the file when they are asked for."""

    def __init__(self, file: File, places: dict[int, tuple[str, int, int]]):
        self.file, self.places = file, places

    def __contains__(self, tag: int) -> bool:
        return tag in self.places

    def __getitem__(self, tag: int) -> tuple:
        form, n, place = self.places[tag]
        if struct.calcsize(form) * n > len(self.file.data):
            raise ValueError(f"field {tag} is longer than the file")
        return struct.unpack_from(f"{self.file.order}{n}{form}", self.file.data, place)

    def get(self, tag: int, default: tuple) -> tuple:
        return self[tag] if tag in self.places else default


def pages_of(data: bytes | None) -> Iterator[Page]:
    try:
        file = File(data or b"")
    except (ValueError, struct.error) as e:
        yield Page(None, error=str(e))
        return
    yield from file.pages()


def write(images: list[np.ndarray], layouts: list[tuple[int, int, int]], strip_rows: int = STRIP_ROWS, order: str = "<") -> bytes:
    """A file with one page for each image of (rows, columns[, samples]) unsigned numbers, in its layout each."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image, (compression, predictor, tile) in zip(images, layouts, strict=True):
        rows, columns = image.shape[:2]
        samples = image.shape[2] if image.ndim == 3 else 1
        kind = image.dtype.newbyteorder(order)
        cube = image.reshape(rows, columns, samples)
        blocks = []
        if tile:
            for top in range(0, rows, tile):
                for left in range(0, columns, tile):
                    block = np.zeros((tile, tile, samples), dtype=image.dtype)
                    part = cube[top : top + tile, left : left + tile]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block)
        else:
            blocks = [cube[top : top + strip_rows] for top in range(0, rows, strip_rows)]
        starts, sizes = [], []
        for block in blocks:
            if predictor == 2:
                first = np.zeros_like(block)
                first[:, 1:] = block[:, :-1]
                block = block - first
            data = ENCODERS[compression](block.astype(kind).tobytes())
            starts.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        bits = image.dtype.itemsize * 8
        fields = [(256, 4, [columns]), (257, 4, [rows]), (258, 3, [bits] * samples), (259, 3, [compression]), (262, 3, [2 if samples == 3 else 1]), (277, 3, [samples]), (317, 3, [predictor])]
        fields += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, starts), (325, 4, sizes)] if tile else [(273, 4, starts), (278, 4, [strip_rows]), (279, 4, sizes)]
        entries = []
        for tag, form, values in sorted(fields):
            raw = struct.pack(f"{order}{len(values)}{TYPES[form]}", *values)
            if len(raw) > 4:
                place = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack(order + "I", place)
            entries.append(struct.pack(order + "HHI", tag, form, len(values)) + raw.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def store(payload: bytes) -> bytes:
    """A file whose pages' samples are the payload, a positive multiple of ``WIDTH`` bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    images = [rows[k : k + PAGE_ROWS] for k in range(0, len(rows), PAGE_ROWS)]
    turn = zlib.crc32(payload)
    return write(images, [LAYOUTS[(turn + k) % len(LAYOUTS)] for k in range(len(images))])


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * ((-len(raw) % WIDTH) if raw else WIDTH)


def feature(pages: list[Page]) -> str:
    """Pages, rows, mean, mean step between neighbours (in thousandths) and an average hash of the stacked pages."""
    x = np.frombuffer(b"".join(p.pixels for p in pages), np.uint8).reshape(-1, pages[0].width)
    total = int(x.sum(dtype=np.int64))
    steps = int(np.abs(np.diff(x.astype(np.int16), axis=1)).sum(dtype=np.int64))
    cuts = np.arange(8) * len(x) // 8
    sums = np.add.reduceat(x.sum(axis=1, dtype=np.int64), cuts)
    counts = np.maximum(np.diff(np.append(cuts, len(x))), 1)
    mean = total / x.size
    bits = "".join("1" if s > mean * n * x.shape[1] else "0" for s, n in zip(sums.tolist(), counts.tolist(), strict=True))
    return f"pages={len(pages)};rows={len(x)};mean={total * 1000 // x.size};step={steps * 1000 // x.size};bands={bits}"


PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"


def page_rows(media: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """One row per page of every file in a binary column."""
    for_workers(media.sparkSession)
    rows = media.select(media[id_column].alias("id"), media[media_column].alias("media"))
    kind = rows.schema["id"].dataType.simpleString()
    types = (pa.int32(),) * 7 + (pa.binary(), pa.string())
    names = [part.split()[0] for part in PAGE_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in enumerate(batch.column("media").to_pylist()):
                for p in pages_of(data):  # one page at a time: pixels can be large
                    columns = [pa.array([getattr(p, n)], t) for n, t in zip(names, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(k, 1), *columns], names=[id_column, *names])

    return rows.mapInArrow(run, f"`{id_column}` {kind}, {PAGE_SCHEMA}")


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: every text as a file."""
    for_workers(docs.sparkSession)
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, files = [], []
            for text in batch.column("text").to_pylist():
                n, payload = padded(text)
                sizes.append(n)
                files.append(store(payload))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


DIGEST_SCHEMA = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, layouts string"


def digests(docs: DataFrame) -> DataFrame:
    """Stores every text as a file, reads the file's pages and returns digests of what they hold, in one pass.

    ``layouts``: compression and predictor of each page, as read.
    """
    for_workers(docs.sparkSession)
    rows = docs.select("doc_id", "text")

    def one(text: str | None) -> tuple:
        n, payload = padded(text)
        media = store(payload)
        del payload
        pages = list(pages_of(media))
        if bad := next((p.error for p in pages if p.error), None):
            raise ValueError(bad)
        whole = hashlib.sha256()
        for p in pages:
            whole.update(p.pixels)
        return n, sum(len(p.pixels) for p in pages), whole.hexdigest(), zlib.crc32(pages[-1].pixels[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(pages), ",".join(f"{p.compression}/{p.predictor}" for p in pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        names = [part.split()[0] for part in DIGEST_SCHEMA.split(", ")]
        for batch in batches:
            columns = list(zip(*map(one, batch.column("text").to_pylist()), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {DIGEST_SCHEMA}")
