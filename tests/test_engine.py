import json
import os
import time

import pytest
from pyspark.sql import functions as F

from cairn.embedding.base import HashEmbedder
from cairn.embedding.services import RERANKERS, SERVICES, ServiceEmbedder, ServiceError, ServiceReranker, dig, from_settings, with_retries
from cairn.model import ContextOptions, RepoMapOptions, SearchOptions
from cairn.operators.store import DimensionMismatch, GraphStore, IndexStore, Snapshots, VectorStore, open_store
from cairn.plans.indexer import Busy, Indexer, NotInitialised
from cairn.streaming.lock import IndexLock, SharedLock
from cairn.streaming.watch import FolderChanges, _Listing, latest_per_burst

FILES = {
    "utils.ts": "export function formatDate(d: Date): string {\n  return d.toISOString();\n}\nexport function parseDate(s: string): Date {\n  return new Date(s);\n}\n",
    "user.ts": "import { formatDate } from './utils';\n\nexport interface User { id: string }\n\nexport class UserService {\n  getCreatedAt(u: User): string {\n    return formatDate(u.created);\n  }\n}\n",
    "service.ts": "import { UserService } from './user';\n\nexport function buildService(): UserService {\n  return new UserService();\n}\n",
    "docs/guide.md": "# Guide\nHow to authenticate a user.\n## Setup\nInstall it.\n",
    "node_modules/x/index.js": "function hidden() {}\n",
    "build.log": "noise\n",
    ".gitignore": "*.log\n",
}


@pytest.fixture
def project(tmp_path):
    for name, text in FILES.items():
        (tmp_path / "p" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / name).write_text(text)
    return tmp_path / "p"


def test_life_of_an_index(spark, project):
    events = []
    with pytest.raises(NotInitialised):
        Indexer(spark, str(project)).stats()
    ix = Indexer(spark, str(project), embedder=HashEmbedder(64), on_event=events.append, buckets=4)
    ix.initialize()
    assert ix.is_leader
    stats = ix.index_project()
    assert ix.list_files() == ["docs/guide.md", "service.ts", "user.ts", "utils.ts"] and stats["total_files"] == 4
    assert {e["file_path"] for e in events} == set(ix.list_files()) and {e["reason"] for e in events} == {"new"}
    assert [r["file_path"] for r in ix.dependents("user.ts").select("file_path").distinct().collect()] == ["service.ts"]
    assert [r["file_path"] for r in ix.dependencies("user.ts").select("file_path").distinct().collect()] == ["utils.ts"]
    get = ix.store.chunks.where("name = 'getCreatedAt'").first()["id"]
    assert [r["name"] for r in ix.related(get, "callees").collect()] == ["formatDate"]
    fmt = ix.store.chunks.where("name = 'formatDate'").first()["id"]
    assert [r["name"] for r in ix.related(fmt, "callers").collect()] == ["getCreatedAt"]
    assert {r["chunk_name"] for r in ix.neighbourhood(fmt).collect()} >= {"getCreatedAt"}
    assert ix.edges_from(get, ("CALLS",)).count() == 1 and ix.edges_to(fmt).count() >= 1

    hits = ix.search("format date", SearchOptions(limit=3)).orderBy("rank").collect()
    assert hits[0]["match_type"] == "hybrid" and "formatDate" in {h["name"] for h in hits} and [h["rank"] for h in hits] == [0, 1, 2]
    assert {h["language"] for h in ix.search("user", SearchOptions(language="markdown")).collect()} == {"markdown"}
    assert ix.search("user", SearchOptions(language=())).count() == 0
    assert ix.search_lexical("authenticate").first()["file_path"] == "docs/guide.md"
    assert ix.search_semantic("build service", SearchOptions(limit=2)).count() == 2
    assert ix.search_with_context("zzz parsedate", ContextOptions(limit=50)).count() >= 1
    text = ix.repo_map(RepoMapOptions())
    assert text.index("service.ts") < text.index("user.ts") and "  class UserService (5-9)" in text
    assert json.loads(ix.repo_map(RepoMapOptions(format="json", max_files=1)))[0]["file"] == "user.ts"

    events.clear()
    ix.index_project()
    assert events == []
    (project / "user.ts").write_text(FILES["user.ts"].replace("getCreatedAt", "createdOn"))
    (project / "service.ts").unlink()
    ix.index_project()
    assert {(e["type"], e["file_path"]) for e in events} == {("indexed", "user.ts"), ("removed", "service.ts")}
    assert ix.list_files() == ["docs/guide.md", "user.ts", "utils.ts"] and ix.store.chunks.where("name = 'createdOn'").count() == 1
    assert ix.dependents("user.ts").count() == 0 and ix.store.vectors.count() == ix.store.count()
    assert [e["type"] for e in ix.remove_file("utils.ts")] == ["removed"] and ix.remove_file("utils.ts") == []
    evaluation = spark.createDataFrame([("created on", "user.ts", "createdOn"), ("nothing of the kind", "x.ts", None)], "query string, expectedFile string, expectedSymbol string")
    assert {r["k"]: r["recall"] for r in ix.evaluate(evaluation, (1, 5)).collect()}[5] == 0.5

    other = Indexer(spark, str(project), embedder=HashEmbedder(32), buckets=4)
    ix.close()
    other.initialize()
    assert other.store.count() == 0  # another embedder starts afresh
    other.close()


def test_one_writer(tmp_path):
    a, b = IndexLock(str(tmp_path)), IndexLock(str(tmp_path))
    assert a.acquire() and a.acquire()
    assert not b.acquire()
    a.release()
    assert b.acquire()
    b.release()
    (tmp_path / "index.lock").write_text(json.dumps({"pid": 2**22 + 5, "host": os.uname().nodename}))
    assert a.acquire()


def chunk(spark, *rows):
    from cairn.model import CHUNKS

    return spark.createDataFrame([(i, "p", f, "typescript", "function", f"fn_{i}", t, t, 1, 10, "{}", t, n) for n, (i, f, t) in enumerate(rows)], CHUNKS)


def test_store(spark, tmp_path):
    s = IndexStore(Snapshots(spark, str(tmp_path / "s"), 4), 2, "m")
    assert s.count() == 0 and s.list_files().count() == 0
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    s.upsert(chunk(spark, ("a", "x.ts", "alpha"), ("b", "y.ts", "beta")), vectors)
    assert [r["id"] for r in s.search_vector([1.0, 0.1], 1).collect()] == ["a"]
    s.upsert(chunk(spark, ("a", "x.ts", "gamma")))
    assert s.count() == 2 and s.search_text("gamma").first()["id"] == "a" and s.search_text("alpha").count() == 0
    assert s.search_text("beta", file_path="x*").count() == 0 and s.search_text("()").count() == 0
    s.upsert_edges(spark.createDataFrame([("e", "p", "a", "x.ts", "b", "CALLS", "{}")], "id string, project_id string, source_chunk_id string, source_file_path string, target_chunk_id string, type string, metadata string"))
    assert s.count_edges() == 1 and s.outgoing("a").count() == 1 and s.incoming("a").count() == 0
    s.delete_edges_by_target(["b"])
    assert s.count_edges() == 0
    s.delete_by_file("y.ts")
    assert [r[0] for r in s.list_files().collect()] == ["x.ts"]
    s.delete(["a"])
    s.optimize()
    assert s.count() == 0
    with pytest.raises(DimensionMismatch):
        IndexStore(Snapshots(spark, str(tmp_path / "s"), 4), 3)
    s.snapshots.clear()


def test_readers_keep_their_snapshot(spark, tmp_path):
    s = IndexStore(Snapshots(spark, str(tmp_path / "s"), 2))
    s.upsert(chunk(spark, ("a", "x.ts", "alpha")))
    before = s.chunks
    s.upsert(chunk(spark, ("b", "y.ts", "beta")))
    assert before.count() == 1 and s.count() == 2


def test_stream_of_changes(spark, tmp_path):
    root = tmp_path / "w"
    root.mkdir()
    (root / "old.txt").write_text("o")
    spark.dataSource.register(FolderChanges)
    seen = []
    query = spark.readStream.format("cairn_changes").option("states", str(tmp_path / "states")).load(str(root)).writeStream.foreachBatch(lambda df, _: seen.extend((r["path"], r["event"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()

    def wait(what):
        end = time.time() + 60
        while what not in seen and time.time() < end:
            time.sleep(0.2)
        assert what in seen

    try:
        query.processAllAvailable()
        (root / "a.txt").write_text("1")
        wait(("a.txt", "add"))
        (root / "a.txt").write_text("22")
        wait(("a.txt", "change"))
        (root / "a.txt").unlink()
        wait(("a.txt", "unlink"))
        assert not any(p == "old.txt" for p, _ in seen)
    finally:
        query.stop()


def test_bursts(spark):
    rows = [("a", 0.0, "add"), ("a", 0.3, "change"), ("a", 0.6, "unlink"), ("a", 2.0, "add"), ("b", 0.1, "add")]
    df = spark.createDataFrame(rows, "path string, t double, event string").withColumn("ts", F.timestamp_millis((F.col("t") * 1000).cast("long"))).drop("t")
    got = sorted((r["path"], r["event"], r["events"]) for r in latest_per_burst(df, "path", "ts").collect())
    assert got == [("a", "add", 1), ("a", "unlink", 3), ("b", "add", 1)]


# ------------------------------------------------------------------ services


def fake(calls, size=4):
    def send(url, headers, body):
        calls.append((url, headers, body))
        texts = body.get("input") or body.get("texts") or body.get("text") or body.get("requests") or body.get("instances")
        vs = [[float(i + 1)] * size for i in range(len(texts))]
        if "requests" in body:
            return {"embeddings": [{"values": v} for v in vs]}
        if "instances" in body:
            return {"predictions": [{"embeddings": {"values": v}} for v in vs]}
        if "texts" in body:
            return {"embeddings": {"float": vs}}
        if "text" in body:
            return {"result": {"data": vs}}
        if "ollama" in url or ":11434" in url:
            return {"embeddings": vs}
        return {"data": [{"index": i, "embedding": v} for i, v in reversed(list(enumerate(vs)))]}

    return send


@pytest.mark.parametrize("name", sorted(SERVICES))
def test_services_batch_split_and_normalise(name):
    calls = []
    e = ServiceEmbedder(name, "m", 4, "key", transport=fake(calls))
    got = e.generate(["a", "b" * 60_000, "c"])
    assert len(got) == 3 and all(len(v) == 4 for v in got) and got[0] == [1.0] * 4
    assert len(e.embed_query("q")) == 4
    s = SERVICES[name]
    if s.modes:
        assert s.modes[1] in json.dumps(calls[-1][2])
    if s.per_text and s.split:
        assert sum(len(x) for c in calls[:-1] for x in [c[2].get("input") or c[2].get("texts") or c[2].get("text") or c[2].get("requests") or c[2].get("instances")]) > 3
    short = ServiceEmbedder(name, "m", 4, "key", native=8, transport=fake([]))
    assert short.generate(["x"])[0] == pytest.approx([0.5] * 4)


def test_keys_and_names_are_checked():
    with pytest.raises(ValueError):
        ServiceEmbedder("openai", "m", 4)
    with pytest.raises(ValueError):
        ServiceEmbedder("nobody", "m", 4, "k")
    assert from_settings({"embedding": {"provider": "hash", "dimensions": 8}, "reranking": False})[0].dimensions == 8
    assert from_settings({"embedding": False}) == (None, None)


def test_retries():
    waits, answers = [], [ServiceError(503), ServiceError(429, 7.0), "ok"]

    def send():
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert with_retries(send, sleep=waits.append) == "ok" and waits[1] == 7.0 and 0.2 <= waits[0] <= 0.5
    answers[:] = [ServiceError(400)]
    with pytest.raises(ServiceError):
        with_retries(send, sleep=waits.append)
    assert dig({"a": [{"index": 1, "b": 2}, {"index": 0, "b": 1}]}, "a.b") == [1, 2]


@pytest.mark.parametrize("name", sorted(RERANKERS))
def test_rerankers_map_scores_to_their_texts(name):
    s = RERANKERS[name]

    def send(url, headers, body):
        if name == "gemini":
            return {"candidates": [{"content": {"parts": [{"text": "[0.1, 0.9]"}]}}]}
        rows = [{"index": 1, "id": "1", s.score: 0.9}, {"index": 0, "id": "0", s.score: 0.1}]
        out = rows
        for step in reversed(s.results.split(".")):
            out = {step: out}
        return out

    assert ServiceReranker(name, "m", "k", transport=send)("q", ["a", "b" * 50_000]) == [0.1, 0.9]


# ------------------------------------------------------------------ leading, watching, back ends


def test_a_lease_on_shared_storage(spark, tmp_path):
    a, b = (SharedLock(spark, f"file://{tmp_path}/s", lease=2.0) for _ in range(2))
    assert a.acquire() and a.acquire() and not b.acquire()
    time.sleep(3)
    assert not b.acquire()  # it was renewed
    a._stop.set()  # a holder that has gone
    time.sleep(4)
    assert b.acquire() and b.held
    a.release()
    assert b._content() == b.owner
    b.release()
    assert a.acquire()
    a.release()


def test_a_follower_takes_over(spark, tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    (root / "a.py").write_text("def one():\n    return 1\n")
    lead, follow = (Indexer(spark, str(root), f"file://{tmp_path}/index", buckets=2, poll_seconds=0.3) for _ in range(2))
    lead.initialize()
    follow.initialize()
    assert lead.is_leader and not follow.is_leader and follow.index_project()["total_chunks"] == 0 and follow.start_watching(str(tmp_path / "c")) is None
    with lead._indexing, pytest.raises(Busy):
        lead.index_project()
    follow._wanted = None
    lead.close()
    end = time.time() + 60
    while time.time() < end and not (follow.is_leader and follow.store.count()):
        time.sleep(0.3)
    assert follow.is_leader and follow.list_files() == ["a.py"]
    follow.close()


def test_offsets_are_small_and_files_settle(tmp_path):
    root = tmp_path / "w"
    root.mkdir()
    for i in range(50):
        (root / f"{i}.txt").write_text("x")
    reader = _Listing({"path": str(root), "states": str(tmp_path / "states"), "stable": "400"})
    start = reader.initialOffset()
    assert len(json.dumps(start)) < 100
    (root / "new.txt").write_text("1")
    rows, after = reader.read(start)
    assert list(rows) == [] and after == start  # written a moment ago
    time.sleep(0.5)
    rows, after = reader.read(start)
    assert [r[:2] for r in rows] == [("new.txt", "add")] and after["number"] == 1
    assert [r[:2] for r in reader.readBetweenOffsets(start, after)] == [("new.txt", "add")]
    at = after
    for i in range(5):
        (root / f"{i}.txt").unlink()
        rows, at = reader.read(at)
        assert [r[:2] for r in rows] == [(f"{i}.txt", "unlink")]
        reader.commit(at)
    assert len(os.listdir(tmp_path / "states")) <= 4 and list(reader.read(at)[0]) == []


def test_back_ends(spark, tmp_path):
    s = open_store(spark, str(tmp_path / "s"), buckets=4, dimensions=2, model_id="m")
    assert isinstance(s, VectorStore) and isinstance(s, GraphStore)
    with pytest.raises(ValueError):
        open_store(spark, str(tmp_path), "other")


def test_the_inverted_file_is_used_while_it_holds(spark, tmp_path):
    import random

    rng = random.Random(1)
    s = IndexStore(Snapshots(spark, str(tmp_path / "s"), 4), 8, "m")
    rows = [(f"c{i}", f"f{i % 7}.ts", f"text {i}") for i in range(300)]
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) + 5 * (n % 3) for _ in range(8)]) for n, (i, _, _) in enumerate(rows)], "chunk_id string, embedding array<float>")
    s.upsert(chunk(spark, *rows), vectors)
    s.optimize(ann_rows=1)
    ann = s.snapshots.read_json("ANN")
    q = [5.0] * 8
    want = [(r["id"], r["rank"]) for r in s.search_vector(q, 9).collect()]
    s.snapshots.write_json("ANN", {})
    assert want == [(r["id"], r["rank"]) for r in s.search_vector(q, 9).collect()]
    s.snapshots.write_json("ANN", ann)
    s.delete([want[0][0]])  # the vectors are others now
    assert [r["id"] for r in s.search_vector(q, 8).collect()] == [i for i, _ in want[1:]]
    before = {b: f for b, f in s.snapshots._list("chunks").items()}
    s.delete(["c5"])
    changed = {b for b, f in s.snapshots._list("chunks").items() if before.get(b) != f}
    assert len(changed) == 1
    s.optimize()
    assert not s.snapshots.read_json("ANN")
