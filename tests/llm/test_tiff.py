import itertools
import random

import numpy as np
import pytest

from cairn.llm import tiff as T


def image(h, w, s, dtype, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 250, (h, w, s)) // 7 * 7
    return (a / 3).astype(dtype) if np.dtype(dtype).kind == "f" else a.astype(dtype)


CASES = [c for c in itertools.product("<>", (False, True), (1, 5, 8, 32773), (1, 2, 3), ((7,), (16, 32)), ("u1", "u2", "u4", "f4", "f8"), (1, 3)) if (c[3] == 3) <= (c[5][0] == "f") and not (c[3] == 2 and c[5][0] == "f")]


@pytest.mark.parametrize("case", random.Random(0).sample(CASES, 120))
def test_round_trip(case):
    order, big, compression, predictor, block, dtype, samples = case
    a = image(21, 37, samples, dtype)
    b = image(5, 3, 1, "u1", 1)
    data = T.encode([{"pixels": a, "order": order, "big": big, "compression": compression, "predictor": predictor, "block": block}, {"pixels": b, "block": (2,)}])
    pages = list(T.decode(data))
    assert [p["page"] for p in pages] == [0, 1] and all(p["error"] is None for p in pages)
    assert pages[0]["pixels"] == a.astype(a.dtype.newbyteorder("<")).tobytes() and pages[1]["pixels"] == b.tobytes()
    assert (pages[0]["width"], pages[0]["height"], pages[0]["samples"], pages[0]["bits"], pages[0]["tiled"]) == (37, 21, samples, a.dtype.itemsize * 8, len(block) == 2)


def test_packbits_and_lzw_streams():
    assert T.unpack_bits(bytes([254, 170, 2, 128, 0, 42, 253, 170, 128, 3, 1, 2, 3, 4, 247, 170])) == bytes([170] * 3 + [128, 0, 42] + [170] * 4 + [1, 2, 3, 4] + [170] * 10)
    rng = random.Random(1)
    for n in (0, 1, 2, 300, 5000, 70_000):
        data = bytes(rng.choices(b"abcab", k=n))
        assert T.unpack_lzw(T.pack_lzw(data)) == data and T.unpack_bits(T.pack_bits(data)) == data
    noise = rng.randbytes(30_000)
    assert T.unpack_lzw(T.pack_lzw(noise)) == noise


def test_damage_is_reported():
    good = T.encode([{"pixels": image(4, 4, 1, "u1"), "block": (2,)}])
    for bad in (b"", b"II", b"hello world", good[:20], good[:-30], b"II*\0\xff\xff\xff\x7f"):
        rows = list(T.decode(bad))
        assert rows[-1]["error"] and rows[-1]["pixels"] is None
    for k in range(0, len(good), 3):  # whatever byte is changed, nothing is raised
        list(T.decode(good[:k] + bytes([good[k] ^ 255]) + good[k + 1 :]))


def test_pages_after_a_damaged_one_are_read(monkeypatch):
    a, b, c = (image(9, 8, 1, "u1", k) for k in range(3))
    monkeypatch.setitem(T.ENCODERS, 7, bytes)  # no decoder knows it
    for first, reason in (({"compression": 7}, "compression 7"), ({"compression": 8}, "deflate")):
        data = bytearray(T.encode([{"pixels": x, "block": (9,), **(first if k == 1 else {"compression": 5})} for k, x in enumerate((a, b, c))]))
        if reason == "deflate":
            at = bytes(data).index(T.zlib.compress(b.tobytes()))
            data[at : at + 2] = b"\xff\xff"
        rows = list(T.decode(bytes(data)))
        assert [r["page"] for r in rows] == [0, 1, 2] and reason in rows[1]["error"] and rows[1]["pixels"] is None
        assert rows[0]["pixels"] == a.tobytes() and rows[2]["pixels"] == c.tobytes() and rows[0]["error"] is rows[2]["error"] is None
    data = bytearray(T.encode([{"pixels": x, "block": (9,)} for x in (a, b)]))
    reader = T.Reader(bytes(data))
    entry = reader.first + 2
    data[entry + 4 : entry + 8] = b"\xff\xff\xff\x0f"  # a tag that points past the end, in a chain that goes on
    rows = list(T.decode(bytes(data)))
    assert [r["page"] for r in rows] == [0, 1] and "past the end" in rows[0]["error"] and rows[1]["pixels"] == b.tobytes()


def test_directory_cycles_end():
    data = bytearray(T.encode([{"pixels": image(4, 4, 1, "u1"), "block": (4,)}]))
    data[-4:] = data[4:8]
    assert len(list(T.decode(bytes(data)))) == 1


def test_frames(spark):
    data = T.encode([{"pixels": image(4, 4, 1, "u1"), "block": (2,)}] * 3)
    rows = [(1, data, 0), (1, data, 0), (None, data, 1), (2, None, 2), (3, b"", 3)]
    df = spark.createDataFrame([(a, bytearray(b) if b is not None else None, c) for a, b, c in rows], "id long, page binary, width int")
    out = T.tiff_pages(df, "id", "page").collect()
    assert sorted((r["id"] or 0, r["page"]) for r in out) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 0), (1, 1), (1, 1), (1, 2), (1, 2), (3, 0)]
    assert T.tiff_pages(df.limit(0), "id", "page").count() == 0


@pytest.mark.parametrize("coding", [None, "LZW", "ZLib", "Deflate", "PackBits"])
@pytest.mark.parametrize("tiled", [False, True])
def test_files_of_another_encoder(spark, tmp_path, coding, tiled):
    """The JVM's own TIFF writer: grey, colour, 16-bit and bilevel pages in one file."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    io, image = jvm.javax.imageio, jvm.java.awt.image.BufferedImage
    rng = np.random.default_rng(3)
    h, w = 37, 53
    grey = (rng.integers(0, 40, (h, w)) // 9 * 9).astype("u1")
    colour = (rng.integers(0, 200, (h, w, 3)) // 50 * 50).astype("u1")
    deep = (rng.integers(0, 60000, (h, w)) // 9000 * 9000).astype("u2")
    line = rng.integers(0, 2, (h, w)).astype("u1")
    pages = []
    for kind, a in ((image.TYPE_BYTE_GRAY, grey), (image.TYPE_3BYTE_BGR, colour), (image.TYPE_USHORT_GRAY, deep), (image.TYPE_BYTE_BINARY, line)):
        page = image(w, h, kind)
        if a is deep:
            data = gateway.new_array(jvm.short, h * w)
            jvm.java.nio.ByteBuffer.wrap(bytearray(a.astype(">u2").tobytes())).asShortBuffer().get(data)
        else:
            data = bytearray(a.tobytes())
        page.getRaster().setDataElements(0, 0, w, h, data)
        pages.append(page)
    writer = io.ImageIO.getImageWritersByFormatName("tiff").next()
    how = writer.getDefaultWriteParam()
    if coding:
        how.setCompressionMode(2)  # explicit
        how.setCompressionType(coding)
    if tiled:
        how.setTilingMode(2)
        how.setTiling(16, 32, 0, 0)
    out = io.ImageIO.createImageOutputStream(jvm.java.io.File(str(tmp_path / "a.tif")))
    writer.setOutput(out)
    writer.prepareWriteSequence(None)
    for page in pages:
        writer.writeToSequence(io.IIOImage(page, None, None), how)
    writer.endWriteSequence()
    out.close()
    got = list(T.decode((tmp_path / "a.tif").read_bytes()))
    assert [g["error"] for g in got] == [None] * 4
    assert got[0]["pixels"] == grey.tobytes() and got[1]["pixels"] == colour.tobytes() and got[2]["pixels"] == deep.astype("<u2").tobytes()
    assert got[3]["bits"] == 1 and got[3]["pixels"] == np.packbits(line, axis=1).tobytes()
    assert {g["tiled"] for g in got} == {tiled}


def test_the_stream_of_the_specification():
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8))
    assert T.unpack_lzw(data) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and T.pack_lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == data


def test_reverse_bit_order(monkeypatch):
    a = image(9, 8, 1, "u1")
    for k in (1, 5, 8, 32773):
        plain = T.ENCODERS[k]
        monkeypatch.setitem(T.ENCODERS, k, lambda raw, plain=plain: plain(raw).translate(T.MIRROR))
        data = T.encode([{"pixels": a, "block": (4,), "compression": k}])
        # The tag of the bit order takes the place of the photometric one, which decoding doesn't need.
        at = data.index((262).to_bytes(2, "little") + b"\3\0")
        data = data[:at] + (266).to_bytes(2, "little") + data[at + 2 : at + 8] + b"\2\0" + data[at + 10 :]
        row = next(T.decode(data))
        assert row["error"] is None and row["pixels"] == a.tobytes()


def test_a_page_of_any_size_and_one_that_claims_too_much():
    blank = np.zeros((6000, 4000, 1), np.uint8)
    for k, block in ((8, (6000,)), (5, (500,)), (32773, (6000,))):
        data = T.encode([{"pixels": blank, "block": block, "compression": k}])
        assert next(T.decode(data))["pixels"] == blank.tobytes()
    data = bytearray(T.encode([{"pixels": image(4, 4, 1, "u1"), "block": (4,)}]))
    at = data.index((257).to_bytes(2, "little") + b"\4\0")
    data[at + 8 : at + 12] = (1 << 30).to_bytes(4, "little")
    at = data.index((278).to_bytes(2, "little") + b"\4\0")
    data[at + 8 : at + 12] = (1 << 30).to_bytes(4, "little")
    assert next(T.decode(bytes(data)))["error"] == "block too short"


def test_planes_of_few_bits_are_joined():
    planes = np.random.default_rng(1).integers(0, 2, (3, 5, 11)).astype("u1")
    raw = [np.packbits(p, axis=1).tobytes() for p in planes]
    head = T.encode([{"pixels": image(5, 11, 1, "u1"), "block": (5,)}])
    tags = {256: 11, 257: 5, 258: 1, 259: 1, 277: 3, 284: 2, 278: 5}
    body = b"".join(raw)
    at = 8 + len(body)
    entries = {**tags, 273: None, 279: None}
    extra = at + 2 + 12 * len(entries) + 4
    out = head[:4] + at.to_bytes(4, "little") + body + len(entries).to_bytes(2, "little")
    for k in sorted(entries):
        n, v = (1, tags[k]) if k in tags else (3, extra + (12 if k == 279 else 0))
        out += k.to_bytes(2, "little") + b"\4\0" + n.to_bytes(4, "little") + v.to_bytes(4, "little")
    out += bytes(4) + b"".join((8 + 10 * k).to_bytes(4, "little") for k in range(3)) + b"".join((10).to_bytes(4, "little") for _ in range(3))
    row = next(T.decode(out))
    assert row["error"] is None and row["pixels"] == np.packbits(planes.transpose(1, 2, 0).reshape(5, -1), axis=1).tobytes()
