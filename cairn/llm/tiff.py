"""TIFF pages out of a binary column.

``decode`` walks the chain of image directories of a classic or big TIFF of either byte order,
reads strips or tiles without compression or with PackBits, LZW or deflate, undoes the
horizontal and the floating-point predictor, joins tiles and separate planes, and gives one record
for each page.  Samples come out row by row, all samples of a pixel together, in little-endian byte
order (bits below 8: packed from the highest bit on, rows padded to whole bytes); bytes in reverse bit order are turned.

Defined results: a null value gives no rows; an empty one or one without a readable directory gives one
row with ``page`` 0 and the reason in ``error``.  A page that can't be decoded has such a row under its own number, and
the pages after it follow; only a chain that can't be walked on ends with one.  A directory that was seen before ends the
chain.  Pages are decoded one at a time, whatever their size; a block that claims more pixels than its coding can expand to is
damage.  Repeated rows are decoded each, null ids stay null, other columns are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
NAMES = {1: "none", 5: "lzw", 8: "deflate", 32773: "packbits", 32946: "deflate"}
FIELDS = ["page", "width", "height", "samples", "bits", "compression", "predictor", "tiled", "pixels", "error"]


class Damaged(ValueError):
    pass


def unpack_bits(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        k = data[i]
        if k < 128:
            out.append(data[i + 1 : i + 2 + k])
            i += 2 + k
        elif k > 128:
            out.append(data[i + 1 : i + 2] * (257 - k))
            i += 2
        else:
            i += 1
    return b"".join(out)


def _code_ends(early: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths and last bits of the codes that follow a clear code, as far as a table can fill up."""
    # After the k-th code the table has 257 + k entries (the first one makes none).
    widths = np.clip(np.ceil(np.log2(np.arange(257, 257 + 3840) + early + 1)).astype(np.int64), 9, 12)
    widths[0] = 9
    return widths, np.cumsum(widths)


_ENDS = {early: _code_ends(early) for early in (0, 1)}
_BASE = [bytes([i]) for i in range(256)] + [b"", b""]


def _codes(data: bytes, at: int, early: int, most: int) -> np.ndarray:
    """Up to ``most`` codes from bit ``at`` on, as if none of them cleared the table."""
    widths, ends = _ENDS[early]
    most = min(most, len(widths))
    n = min(int(np.searchsorted(ends, len(data) * 8 - at, side="right")), most)
    ends, widths = ends[:n] + at, widths[:n]
    if n == len(_ENDS[early][0]) == most:  # a table that is never cleared goes on with 12 bits
        more = at + int(_ENDS[early][1][-1]) + 12 * np.arange(1, (len(data) * 8 - at - int(_ENDS[early][1][-1])) // 12 + 1)
        ends, widths = np.concatenate((ends, more)), np.concatenate((widths, np.full(len(more), 12)))
    first = ends - widths
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    byte = first >> 3
    if early:
        window = raw[byte] << 16
        window |= np.where(byte + 1 < len(raw), raw[np.minimum(byte + 1, len(raw) - 1)], 0) << 8
        window |= np.where(byte + 2 < len(raw), raw[np.minimum(byte + 2, len(raw) - 1)], 0)
        return window >> (24 - (first & 7) - widths) & ((1 << widths) - 1)
    window = raw[byte] | np.where(byte + 1 < len(raw), raw[np.minimum(byte + 1, len(raw) - 1)], 0) << 8
    window |= np.where(byte + 2 < len(raw), raw[np.minimum(byte + 2, len(raw) - 1)], 0) << 16
    return window >> (first & 7) & ((1 << widths) - 1)


def unpack_lzw(data: bytes, need: int | None = None) -> bytes:
    """Codes of 9 to 12 bits, high bits first (low bits first where the stream begins like the old variant).

    The widths of codes depend only on how many came since the table was cleared, so a stretch of codes
    is cut out of the bits at once.  Decoding stops after ``need`` bytes.
    """
    if not data:
        return b""
    early = 0 if data[0] == 0 and len(data) > 1 and data[1] & 1 else 1
    widths, ends = _ENDS[early]
    out: list[bytes] = []
    push = out.append
    at, size, left = 0, 0, len(data) * 8
    guess = 1 << 9  # codes looked at: enough for a small block, more when they don't do
    while at + 9 <= left:
        codes = _codes(data, at, early, guess)
        special = np.flatnonzero((codes == 256) | (codes == 257))
        n = int(special[0]) if len(special) else len(codes)
        if not len(special) and guess < len(widths) and n == guess:
            guess = len(widths)
            continue
        run = codes[:n].tolist()
        if run:
            table = _BASE.copy()
            add = table.append
            if run[0] > 257:
                raise Damaged("LZW code before its entry")
            prev = table[run[0]]
            push(prev)
            try:
                for code in run[1:]:
                    if code < len(table):
                        entry = table[code]
                        add(prev + entry[:1])
                    else:
                        entry = prev + prev[:1]
                        add(entry)
                        if table[code] is not entry:
                            raise IndexError
                    push(entry)
                    prev = entry
            except IndexError:
                raise Damaged("LZW code before its entry") from None
        if n == len(codes) or codes[n] == 257:
            break
        at += int(ends[n]) if n < len(ends) else int(ends[-1]) + 12 * (n + 1 - len(ends))
        if need is not None:
            size = sum(map(len, out))
            if size >= need:
                break
    return b"".join(out)


def _inflate(data: bytes, need: int) -> bytes:
    return zlib.decompressobj().decompress(data, need)


CODECS = {1: lambda data, need: data, 5: unpack_lzw, 8: _inflate, 32946: _inflate, 32773: lambda data, need: unpack_bits(data)}
#: Bytes that a byte of a coding can become at most: an LZW code of 9 to 12 bits stands for 3839 bytes at most, a PackBits pair for 128.
LARGEST = {1: 1, 5: 3413, 8: 1032, 32946: 1032, 32773: 64}
MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class Reader:
    def __init__(self, data: bytes):
        self.data = data
        if len(data) < 8 or data[:2] not in (b"II", b"MM"):
            raise Damaged("no TIFF header")
        self.order = "<" if data[:2] == b"II" else ">"
        magic = self.number("H", 2)
        if magic not in (42, 43):
            raise Damaged("no TIFF header")
        self.big = magic == 43
        self.first = self.number("Q", 8) if self.big else self.number("I", 4)

    def number(self, kind: str, at: int) -> int:
        try:
            return struct.unpack_from(self.order + kind, self.data, at)[0]
        except struct.error:
            raise Damaged("directory past the end") from None

    def directories(self) -> Iterator[dict[int, tuple] | Damaged]:
        """Each page's tags, or what is wrong with them where the chain itself goes on."""
        at, seen = self.first, set()
        count, entry, word = ("Q", 20, "Q") if self.big else ("H", 12, "I")
        while at and at not in seen:
            seen.add(at)
            n = self.number(count, at)
            at += 8 if self.big else 2
            if at + n * entry > len(self.data):
                raise Damaged("directory past the end")
            try:
                tags = dict(self.entry(at + i * entry) for i in range(n))
            except Damaged as e:
                tags = e
            yield tags
            at = self.number(word, at + n * entry)

    def entry(self, at: int) -> tuple[int, tuple]:
        tag, kind = self.number("H", at), self.number("H", at + 2)
        n = self.number("Q" if self.big else "I", at + 4)
        if kind not in TYPES:
            return tag, ()
        code = TYPES[kind]
        size = struct.calcsize("<" + code) * n
        where = at + (12 if self.big else 8)
        if size > (8 if self.big else 4):
            where = self.number("Q" if self.big else "I", where)
        if where + size > len(self.data):
            raise Damaged(f"tag {tag} past the end")
        if code == "s":
            return tag, (self.data[where : where + n],)
        return tag, struct.unpack_from(f"{self.order}{n * len(code)}{code[0]}", self.data, where)


def _undo(block: bytearray | bytes, rows: int, width: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """A strip's or tile's rows as little-endian bytes, its predictor undone."""
    stride = (width * samples * bits + 7) // 8
    raw = np.frombuffer(bytes(block[: rows * stride]).ljust(rows * stride, b"\0"), np.uint8).reshape(rows, stride)
    size = bits // 8
    if predictor == 3:  # bytes of one significance together, highest first, each less its neighbour
        if bits not in (16, 32, 64):
            raise Damaged(f"floating-point predictor with {bits} bits")
        planes = np.add.accumulate(raw.reshape(rows, width * size, samples), axis=1, dtype=np.uint8).reshape(rows, size, width * samples)
        return np.ascontiguousarray(planes[:, ::-1].transpose(0, 2, 1)).reshape(rows, stride)
    if bits in (16, 32, 64):
        values = raw.view(np.dtype(f"{order}u{size}")).astype(f"<u{size}")
    elif bits == 8:
        values = raw
    elif predictor == 2:
        raise Damaged(f"predictor with {bits} bits")
    else:
        return raw
    if predictor == 2:
        values = np.add.accumulate(values.reshape(rows, width, samples), axis=1, dtype=values.dtype)
    return np.ascontiguousarray(values).reshape(rows, width * samples).view(np.uint8).reshape(rows, stride)


def _page(r: Reader, tags: dict[int, tuple]) -> dict:
    def one(tag: int, default: int | None = None) -> int:
        if tags.get(tag):
            return tags[tag][0]
        if default is None:
            raise Damaged(f"tag {tag} is missing")
        return default

    width, height = one(256), one(257)
    samples, compression, predictor, planar = one(277, 1), one(259, 1), one(317, 1), one(284, 1)
    depth = set(tags.get(258) or (1,))
    if len(depth) > 1:
        raise Damaged("samples of different depth")
    bits = depth.pop()
    if compression not in CODECS:
        raise Damaged(f"compression {compression}")
    if predictor not in (1, 2, 3):
        raise Damaged(f"predictor {predictor}")
    if bits not in (1, 2, 4, 8, 16, 32, 64):
        raise Damaged(f"{bits} bits a sample")
    tiled = 322 in tags
    if not width or not height:
        raise Damaged("no pixels")
    per = 1 if planar == 2 else samples
    planes = samples if planar == 2 else 1
    if tiled:
        tw, th = one(322), one(323)
        offsets, counts = tags.get(324, ()), tags.get(325, ())
    else:
        tw, th = width, min(one(278, height), height)
        offsets, counts = tags.get(273, ()), tags.get(279, ())
        if len(offsets) == 1 and not counts:
            counts = (len(r.data) - offsets[0],)
    if not tw or not th or (tiled and tw * per * bits % 8):
        raise Damaged("block size")
    across, down = -(-width // tw), -(-height // th)
    if len(offsets) < across * down * planes or len(counts) < len(offsets):
        raise Damaged("missing blocks")
    stride = (width * per * bits + 7) // 8
    line = (tw * per * bits + 7) // 8
    blocks = across * down
    for at in range(blocks * planes):
        rows = th if tiled else min(th, height - at % blocks // across * th)
        if offsets[at] + counts[at] > len(r.data):
            raise Damaged("block past the end")
        if line * rows > LARGEST[compression] * counts[at]:
            raise Damaged("block too short")
    mirrored = one(266, 1) == 2
    image = np.zeros((planes, down * th, across * line), np.uint8)
    for plane in range(planes):
        for k in range(across * down):
            at = plane * across * down + k
            y, x = divmod(k, across)
            rows = th if tiled else min(th, height - y * th)
            block = r.data[offsets[at] : offsets[at] + counts[at]]
            try:
                block = CODECS[compression](block.translate(MIRROR) if mirrored else block, line * rows)
            except zlib.error as e:
                raise Damaged(f"deflate: {e}") from None
            if len(block) < line * rows:
                raise Damaged("block too short")
            undone = _undo(block, rows, tw, per, bits, predictor, r.order)
            image[plane, y * th : y * th + rows, x * undone.shape[1] : (x + 1) * undone.shape[1]] = undone
    image = image[:, :height, :stride]
    if planes > 1 and bits >= 8:
        image = image.reshape(planes, height, width, bits // 8).transpose(1, 2, 0, 3)
    elif planes > 1:
        single = np.unpackbits(image, axis=2)[:, :, : width * bits].reshape(planes, height, width, bits)
        image = np.packbits(single.transpose(1, 2, 0, 3).reshape(height, -1), axis=1)
    return {"width": width, "height": height, "samples": samples, "bits": bits, "compression": NAMES[compression], "predictor": predictor, "tiled": tiled, "pixels": np.ascontiguousarray(image).tobytes(), "error": None}


def decode(data: bytes) -> Iterator[dict]:
    blank = dict.fromkeys(FIELDS)
    page = 0
    try:
        reader = Reader(data)
        for tags in reader.directories():
            try:
                row = _page(reader, tags) if isinstance(tags, dict) else blank | {"error": str(tags)}
            except (Damaged, MemoryError, OverflowError) as e:
                row = blank | {"error": str(e) or "too large"}
            yield row | {"page": page}
            page += 1
        if not page:
            raise Damaged("no directory")
    except (Damaged, MemoryError, OverflowError) as e:
        yield blank | {"page": page, "error": str(e) or "too large"}


def tiff_pages(media: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """One row for each page of each value: the id, then FIELDS."""
    kind = dict(media.dtypes)[id_col]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]

    def run(batches):
        for b in batches:
            ids, rows, size = [], [], 0
            for i, data in zip(b.column(0).to_pylist(), b.column(1)):
                if not data.is_valid:
                    continue
                for row in decode(data.as_py()):
                    ids.append(i)
                    rows.append(row)
                    size += len(row["pixels"] or b"")
                    if size > 1 << 26:
                        yield pa.record_batch([pa.array(ids, b.column(0).type), *(pa.array([r[f] for r in rows], t) for f, t in zip(FIELDS, types))], [id_col, *FIELDS])
                        ids, rows, size = [], [], 0
            if rows:
                yield pa.record_batch([pa.array(ids, b.column(0).type), *(pa.array([r[f] for r in rows], t) for f, t in zip(FIELDS, types))], [id_col, *FIELDS])

    fields = "page int, width int, height int, samples int, bits int, compression string, predictor int, tiled boolean, pixels binary, error string"
    return media.select(id_col, data_col).mapInArrow(run, f"`{id_col}` {kind}, {fields}")


# ---------------------------------------------------------------------------- writing, for tables without media


def pack_bits(data: bytes) -> bytes:
    """Runs of three and more as such, what lies between them as it is."""
    raw = np.frombuffer(data, np.uint8)
    cuts = np.flatnonzero(np.diff(raw)) + 1
    starts = np.concatenate(([0], cuts)) if len(raw) else np.zeros(0, np.int64)
    lengths = np.diff(np.concatenate((starts, [len(raw)]))) if len(raw) else starts
    out, at = [], 0

    def literal(end: int) -> None:
        for k in range(at, end, 128):
            out.append(bytes((min(128, end - k) - 1,)) + data[k : min(end, k + 128)])

    long = lengths > 2
    for a, n in zip(starts[long].tolist(), lengths[long].tolist()):
        literal(a)
        at = a + n
        for k in range(0, n, 128):
            out.append(bytes((257 - min(128, n - k), data[a])) if n - k > 1 else bytes((0, data[a])))
    literal(len(data))
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    runs, codes, table, size = [], [], {}, 258
    find, push = table.get, codes.append
    prefix = data[0] if data else -1
    for c in memoryview(data)[1:]:
        key = prefix << 8 | c
        if (code := find(key)) is not None:
            prefix = code
            continue
        push(prefix)
        table[key] = size
        size += 1
        if size == 4094:
            runs.append(codes)
            codes, table, size = [], {}, 258
            find, push = table.get, codes.append
        prefix = c
    if prefix >= 0:
        push(prefix)
    runs.append(codes)
    widths = _ENDS[1][0]
    values = np.concatenate([np.array([256, *r]) for r in runs] + [np.array([257])])
    # A clear code is as wide as a code in its place would be.
    n = np.concatenate([[9], *(x for k, r in enumerate(runs) for x in (widths[: len(r)], [widths[len(r)]]))])
    ends = np.cumsum(n)
    bits = np.zeros(int(ends[-1]), np.uint8)
    for b in range(12):
        ok = n > b
        bits[ends[ok] - 1 - b] = values[ok] >> b & 1
    return np.packbits(bits).tobytes()


ENCODERS = {1: bytes, 5: pack_lzw, 8: zlib.compress, 32773: pack_bits}


def encode(pages: list[dict]) -> bytes:
    """A TIFF of pages given as {pixels: array (height, width, samples), compression, predictor, block: (rows,) or (rows, columns)}; the keys ``order`` and ``big`` of the first page hold for the file."""
    order, big = pages[0].get("order", "<"), pages[0].get("big", False)
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + ("HHHQ" if big else "HI"), *((43, 8, 0, 16) if big else (42, 8))))
    link = 8 if big else 4
    for p in pages:
        a = p["pixels"]
        h, w, s = a.shape
        size = a.dtype.itemsize
        predictor, block = p.get("predictor", 1), p["block"]
        tiled = len(block) == 2
        th, tw = (block[0], block[1]) if tiled else (min(block[0], h), w)
        blocks = []
        for y in range(0, h, th):
            for x in range(0, w, tw):
                cell = a[y : y + th, x : x + tw]
                if tiled:
                    cell = np.pad(cell, ((0, th - cell.shape[0]), (0, tw - cell.shape[1]), (0, 0)))
                if predictor == 2:
                    u = cell.view(f"u{size}")
                    cell = np.concatenate((u[:, :1], u[:, 1:] - u[:, :-1]), axis=1)
                if predictor == 3:
                    n = cell.shape[0]
                    planes = cell.astype(cell.dtype.newbyteorder(">")).reshape(n, -1, 1).view(np.uint8).reshape(n, -1, size).transpose(0, 2, 1).reshape(n, -1, s)
                    raw = np.concatenate((planes[:, :1], planes[:, 1:] - planes[:, :-1]), axis=1).tobytes()
                else:
                    raw = cell.astype(cell.dtype.newbyteorder(order)).tobytes()
                blocks.append(ENCODERS[p.get("compression", 1)](raw))
        at = []
        for b in blocks:
            at.append(len(out))
            out += b
        word = "Q" if big else "I"
        tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [size * 8] * s), (259, "H", [p.get("compression", 1)]), (262, "H", [2 if s == 3 else 1]), (277, "H", [s]), (317, "H", [predictor])]
        tags += [(322, "I", [tw]), (323, "I", [th]), (324, word, at), (325, word, [len(b) for b in blocks])] if tiled else [(273, word, at), (278, "I", [th]), (279, word, [len(b) for b in blocks])]
        if a.dtype.kind == "f":
            tags.append((339, "H", [3] * s))
        entries = b""
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"{order}{len(values)}{kind}", *values)
            if len(raw) > (8 if big else 4):
                where = len(out)
                out += raw
                raw = struct.pack(order + word, where)
            entries += struct.pack(order + ("HHQ" if big else "HHI"), tag, {"H": 3, "I": 4, "Q": 16}[kind], len(values)) + raw.ljust(8 if big else 4, b"\0")
        struct.pack_into(order + word, out, link, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(tags)) + entries
        link = len(out)
        out += bytes(8 if big else 4)
    return bytes(out)
