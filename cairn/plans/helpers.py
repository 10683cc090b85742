"""Queries of what surrounds the engine: text helpers over all documents, requests to services, settings.

No service is called: a recorder takes its place and answers with fixed vectors and scores.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..chunking.absorb import absorb
from ..embedding.services import RERANKERS, SERVICES, ServiceEmbedder, ServiceError, ServiceReranker, from_settings, with_retries
from ..functions import text as T
from ..sources import ignore, settings
from . import fixtures as X
from .catalogue import query
from .indexed import listed

_TRIMMED = "CASE WHEN length(text) <= 1924 THEN text ELSE substr(text, 1, 1024) || chr(10) || '...' || chr(10) || right(text, 900) END"


@query(f"SELECT doc_id, md5({_TRIMMED}) AS reranked, 'd' || doc_id || ':1-' || len(string_split(text, chr(10))) AS location, upper(substr(lang, 1, 1)) || substr(lang, 2) AS label FROM documents")
def text_helpers(spark, sf_dir):
    """What a reranker with a short window is given of each document, its location, and a capitalised label."""
    short = F.pandas_udf(lambda s: s.map(T.head_and_tail), "string")
    d = X.table(spark, sf_dir, "documents").withColumn("lines", F.size(F.split("text", "\n", -1)))
    return d.select("doc_id", F.md5(short("text")).alias("reranked"), T.location(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit(1), "lines").alias("location"), T.capitalise("lang").alias("label"))


@query(r"""WITH p AS (SELECT p_partkey, p_name || ' ' || replace(p_brand, '#', '_') AS whole FROM part), w AS (SELECT p_partkey, whole, unnest(regexp_extract_all(whole, '[A-Za-z][A-Za-z0-9_]*[A-Za-z0-9]')) AS t FROM p),
    s AS (SELECT p_partkey, whole, t, list_distinct(list_filter(string_split(lower(replace(regexp_replace(regexp_replace(t, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '_', ' ')), ' '), lambda x: x <> '')) AS ps FROM w),
    terms AS (SELECT p_partkey, t FROM s WHERE t = lower(t) UNION ALL SELECT p_partkey, unnest(ps) FROM s WHERE len(ps) > 1)
    SELECT p_partkey, len(regexp_extract_all(any_value(whole), '[A-Za-z0-9]+')) + count(t) AS words, string_agg(t, ' ' ORDER BY t) AS added FROM p JOIN terms USING (p_partkey) GROUP BY p_partkey""")
def search_content(spark, sf_dir):
    """What is indexed of a part's name and brand: the text itself and the words of its identifiers."""
    p = X.table(spark, sf_dir, "part").withColumn("brand", F.regexp_replace("p_brand", "#", "_"))
    made = p.select("p_partkey", T.search_content(F.col("p_name"), F.col("brand")).alias("s"), F.concat_ws(" ", "p_name", "brand").alias("whole"))
    added = F.filter(F.split(F.expr("substr(s, length(whole) + 2)"), " "), lambda x: x != "")
    return made.select("p_partkey", (F.regexp_count("whole", F.lit("[A-Za-z0-9]+")) + F.size(added)).cast("long").alias("words"), F.array_join(F.array_sort(added), " ").alias("added"))


# ------------------------------------------------------------------ services


def _recorder(calls: list, size: int = 4):
    def send(url, headers, body):
        texts = body.get("input") or body.get("texts") or body.get("text") or body.get("requests") or body.get("instances")
        calls.append((url, headers, body, len(texts)))
        vectors = [[1.0] * size for _ in texts]
        if "requests" in body:
            return {"embeddings": [{"values": v} for v in vectors]}
        if "instances" in body:
            return {"predictions": [{"embeddings": {"values": v}} for v in vectors]}
        if "texts" in body:
            return {"embeddings": {"float": vectors}}
        if "text" in body:
            return {"result": {"data": vectors}}
        if ":11434" in url:
            return {"embeddings": vectors}
        return {"data": [{"index": i, "embedding": v} for i, v in enumerate(vectors)]}

    return send


@query(listed("service vectors calls parts largest query_mode host auth", [
    ("cloudflare", 301, 35, 305, 10, None, "api.cloudflare.com", "Authorization"), ("cohere", 301, 4, 314, 96, "search_document", "api.cohere.com", "Authorization"),
    ("gemini", 301, 3, 303, 250, "CODE_RETRIEVAL_QUERY", "generativelanguage.googleapis.com", "x-goog-api-key"), ("jina", 301, 3, 301, 128, "retrieval.query", "api.jina.ai", "Authorization"),
    ("lmstudio", 301, 10, 301, 32, None, "127.0.0.1:1234", "Authorization"), ("mistral", 301, 3, 301, 128, None, "api.mistral.ai", "Authorization"), ("ollama", 301, 10, 301, 32, None, "127.0.0.1:11434", "Authorization"),
    ("openai", 301, 1, 301, 301, None, "api.openai.com", "Authorization"), ("vertex", 301, 3, 310, 250, "CODE_RETRIEVAL_QUERY", "-aiplatform.googleapis.com", "Authorization"), ("voyage", 301, 3, 301, 128, "query", "api.voyageai.com", "Authorization"),
]))
def embed_requests(spark, sf_dir):
    """For each service: how 300 short texts and one of 20,000 characters are cut and batched, and what marks a query."""
    rows = []
    for name in sorted(SERVICES):
        calls: list = []
        e = ServiceEmbedder(name, "m", 4, "key", transport=_recorder(calls))
        got = e.generate(["ab"] * 300 + ["c" * 20_000])
        sizes = [c[3] for c in calls]
        e.embed_query("q")
        mode = SERVICES[name].modes[1] if SERVICES[name].modes and SERVICES[name].modes[1] in json.dumps(calls[-1][2]) else None
        rows.append((name, len(got), len(sizes), sum(sizes), max(sizes), mode, calls[0][0].split("/")[2], sorted(calls[0][1])[0] if calls[0][1] else None))
    return spark.createDataFrame(rows, "service string, vectors int, calls int, parts int, largest int, query_mode string, host string, auth string")


@query(listed("service calls scores total longest", [("cloudflare", 1, 1500, 750, 1929), ("cohere", 2, 1500, 750, 16000), ("gemini", 1, 1500, 750, 4000), ("jina", 1, 1500, 750, 8000), ("vertex", 8, 1500, 750, 4000), ("voyage", 2, 1500, 750, 16000)], "total:DOUBLE"))
def rerank_requests(spark, sf_dir):
    """For each reranker: 1500 texts, the last of 30,000 characters; scores come back to their texts."""
    rows = []
    for name in sorted(RERANKERS):
        s, longest, calls = RERANKERS[name], [0], [0]

        def send(url, headers, body, s=s, name=name, longest=longest, calls=calls):
            calls[0] += 1
            if name == "gemini":
                n = int(body["contents"][0]["parts"][0]["text"].split("JSON list of ")[1].split(" ")[0])
                longest[0] = max(len(x) for x in body["contents"][0]["parts"][0]["text"].split("\n\n"))
                return {"candidates": [{"content": {"parts": [{"text": json.dumps([0.5] * n)}]}}]}
            items = body[s.texts_field]
            longest[0] = max([longest[0], *(len(i[s.wrap] if s.wrap else i) for i in items)])
            answer = [{"index": i, "id": str(i), s.score: 0.5} for i in range(len(items))]
            for step in reversed(s.results.split(".")):
                answer = {step: answer}
            return answer

        scores = ServiceReranker(name, "m", "k", transport=send)("q", ["a"] * 1499 + ["b" * 30_000])
        rows.append((name, calls[0], len(scores), float(sum(scores)), longest[0] - (len("[1499]\n") if name == "gemini" else 0)))
    return spark.createDataFrame(rows, "service string, calls int, scores int, total double, longest int")


@query(listed("\"case\" answer waits", [("busy twice", "ok", 2), ("asked to wait", "ok", 1), ("refused", "the service answered 400", 0), ("always busy", "the service answered 503", 3), ("too few scores", "the model didn't return one number for each passage", 0)]).replace('""', '"'))
def service_errors(spark, sf_dir):
    rows = []
    cases = {"busy twice": [503, 429, None], "asked to wait": [(429, 7.0), None], "refused": [400], "always busy": [503] * 9}
    for name, answers in cases.items():
        left, waits = list(answers), []

        def send(left=left):
            a = left.pop(0)
            if a is None:
                return "ok"
            raise ServiceError(*(a if isinstance(a, tuple) else (a,)))

        try:
            got = with_retries(send, sleep=waits.append)
        except ServiceError as e:
            got = str(e)
        rows.append((name, got, len(waits)))
    bad = ServiceReranker("gemini", "m", "k", transport=lambda *_: {"candidates": [{"content": {"parts": [{"text": "[0.5]"}]}}]})
    try:
        bad("q", ["a", "b"])
    except ValueError as e:
        rows.append(("too few scores", str(e), 0))
    return spark.createDataFrame(rows, "case string, answer string, waits int")


@query(listed("what value", [
    ("hash", "HashEmbedder 8"), ("service", "jina m 4"), ("reranker", "voyage r"), ("off", "None None"), ("no key", "openai needs a key"), ("no such service", "unknown service nobody"),
    ("comments", '{"a": "// kept", "b": [1, 2]}'), ("rule build/", "**/build/**"), ("rule *.log", "**/*.log"), ("rule /only", "only"), ("rule a/b", "a/b"), ("comment lines above", "1"),
]))
def settings_and_rules(spark, sf_dir):
    """Settings to embedders and rerankers, JSON with comments, ignore rules, comments that belong to a declaration."""
    e, r = from_settings({"embedding": {"provider": "jina", "model": "m", "dimensions": 4, "key": "k"}, "reranking": {"provider": "voyage", "model": "r", "key": "k"}})
    rows = [("hash", f"HashEmbedder {from_settings({'embedding': {'provider': 'hash', 'dimensions': 8}})[0].dimensions}"), ("service", f"{e.name} {e.model} {e.dimensions}"), ("reranker", f"{r.name} {r.model}")]
    rows.append(("off", " ".join(map(str, from_settings({"embedding": False})))))
    for what, make in (("no key", lambda: ServiceEmbedder("openai", "m", 4)), ("no such service", lambda: ServiceEmbedder("nobody", "m", 4, "k"))):
        try:
            make()
        except ValueError as error:
            rows.append((what, str(error)))
    rows.append(("comments", json.dumps(json.loads(settings.strip_comments('{"a": "// kept", /* gone */ "b": [1, 2,], // gone\n}')))))
    rows += [(f"rule {x}", ignore.ignore_rules(x, "")[0]) for x in ("build/", "*.log", "/only", "a/b")]
    rows.append(("comment lines above", str(absorb(["x", "// a", "// b", "f()"], 3, "go"))))
    return spark.createDataFrame(rows, "what string, value string")
