import random

import pytest

from cairn.llm import warc as W


def record(kind, payload, number, end=b"\r\n", extra=b""):
    return b"WARC/1.0" + end + b"WARC-Type: " + kind + end + b"WARC-Record-ID: <urn:%d>" % number + end + extra + b"Content-Length: %d" % len(payload) + end + end + payload + b"\r\n\r\n"


def archive(n, seed):
    """Records of all sizes whose payloads quote records, whole and in parts."""
    rng = random.Random(seed)
    out, want = b"", []
    for i in range(n):
        payload = rng.randbytes(rng.choice([0, 3, 200, 3000]))
        if rng.random() < 0.6:
            payload += record(b"response", b"inner" * rng.randint(0, 300), 10_000 + i) + b"WARC/1.0\r\nContent-Length: 7\r\n\r\n"
        if rng.random() < 0.2:
            payload = b"WARC/1.0\r\n" + payload
        want.append((len(out), i, payload))
        out += record(b"resource", payload, i, extra=b"X: " + b"y" * rng.choice([0, 10, 3000]) + b"\r\n")
    return out, want


@pytest.mark.parametrize("block", [64, 1000, 1 << 20])
def test_only_reachable_records_are_read(spark, tmp_path, block):
    want = []
    for k in range(3):
        data, rows = archive(40, k)
        (tmp_path / f"a{k}.warc").write_bytes(data)
        want += rows
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "other.warc").write_bytes(b"junk" + data)
    got = W.read_warc(spark, "file://" + str(tmp_path), block).collect()
    assert sorted((r["offset"], r["record_id"], bytes(r["payload"])) for r in got) == sorted((o, f"<urn:{i}>", p) for o, i, p in want)
    assert not any(r["truncated"] for r in got)


def test_sequential_reading_agrees(spark, tmp_path):
    data, want = archive(60, 9)
    at, seen = 0, []
    import io

    while at < len(data):
        start, length, _ = W._header(io.BytesIO(data), len(data), at, data[at : at + 100], at)
        seen.append((at, data[start : start + length]))
        at = start + length + 4
    assert seen == [(o, p) for o, _, p in want]


def test_damage(spark, tmp_path):
    a, b = record(b"x", b"one", 1), record(b"x", b"two", 2)
    (tmp_path / "cut.warc").write_bytes(a + b[:-6])
    (tmp_path / "broken.warc").write_bytes(a + b"garbage" + b)
    (tmp_path / "lf.warc").write_bytes(record(b"x", b"three", 3, b"\n"))
    got = {(r["path"].rsplit("/", 1)[1], r["record_id"], bytes(r["payload"]), r["truncated"]) for r in W.read_warc(spark, "file://" + str(tmp_path), 50).collect()}
    assert got == {("cut.warc", "<urn:1>", b"one", False), ("cut.warc", "<urn:2>", b"t", True), ("broken.warc", "<urn:1>", b"one", False), ("lf.warc", "<urn:3>", b"three", False)}


def test_written_pages_come_back(spark, tmp_path):
    rows = [(1, "http://a", "<p>x</p>"), (2, None, None), (None, "http://b", "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc"), (3, "http://é", "é" * 10_000), (3, "http://é", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("x", "x")
    W.write_pages(pages, f"file://{tmp_path}/out")
    got = W.read_warc(spark, f"file://{tmp_path}/out").collect()
    assert len(got) == 2 * len(rows) and not any(r["truncated"] for r in got)
    bodies = sorted(bytes(r["payload"]).split(b"\r\n\r\n", 1)[1].decode() for r in got if r["type"] == "response")
    assert bodies == sorted(h or "" for _, _, h in rows)


def test_empty_input(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert W.read_warc(spark, f"file://{tmp_path}/none").count() == 0
    W.write_pages(spark.createDataFrame([], "page_id long, url string, html string, value string"), f"file://{tmp_path}/out")
    assert W.read_warc(spark, f"file://{tmp_path}/out").count() == 0


def test_blocks_are_spread_over_tasks(spark, tmp_path):
    data, _ = archive(60, 3)
    (tmp_path / "a.warc").write_bytes(data)
    assert W.read_warc(spark, f"file://{tmp_path}", 8000).rdd.getNumPartitions() == min(-(-len(data) // 8000), 2 * spark.sparkContext.defaultParallelism) > 4
