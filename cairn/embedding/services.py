"""Clients of hosted embedders and rerankers, by table.

A service is a record of its limits and the shape of its requests; batching, cutting, averaging, normalising and
retrying are the same code for all.  ``transport`` sends a request and is replaced in tests.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from ..functions.text import head_and_tail, pieces, truncate_text
from ..functions.vectors import mean, normalise

Transport = Callable[[str, dict[str, str], dict[str, Any]], Any]


class ServiceError(RuntimeError):
    def __init__(self, status: int, retry_after: float | None = None):
        super().__init__(f"the service answered {status}")
        self.status, self.retry_after = status, retry_after


def post(url: str, headers: dict[str, str], body: dict[str, Any]) -> Any:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=60) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        after = e.headers.get("Retry-After")
        raise ServiceError(e.code, float(after) if after and after.replace(".", "", 1).isdigit() else None) from None


def with_retries(send: Callable[[], Any], tries: int = 3, base: float = 0.5, cap: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Repeats on 429 and 5xx: after what the service asks for, or exponentially longer with jitter."""
    for n in range(tries + 1):
        try:
            return send()
        except ServiceError as e:
            if n == tries or e.status != 429 and e.status < 500:
                raise
            sleep(min(cap, e.retry_after if e.retry_after is not None else base * 2**n * (0.5 + random.random() / 2)))
    raise AssertionError


def budget(texts: list[str], max_chars: int | None, max_items: int) -> Iterator[list[str]]:
    """Greedy batches within a budget of characters and items."""
    batch: list[str] = []
    size = 0
    for t in texts:
        if batch and (len(batch) >= max_items or max_chars is not None and size + len(t) > max_chars):
            yield batch
            batch, size = [], 0
        batch.append(t)
        size += len(t)
    if batch:
        yield batch


@dataclass(frozen=True)
class Service:
    url: str
    items: int
    per_text: int | None = None
    per_batch: int | None = None
    split: bool = False  # long texts in pieces whose vectors are averaged; else cut in the middle
    concurrency: int = 1
    modes: tuple[str, str] | None = None  # of documents and queries
    mode_field: str = "input_type"
    size_field: str = "dimensions"
    input_field: str = "input"
    auth: str = "Bearer {key}"
    auth_header: str = "Authorization"
    read: str = "data.embedding"
    extra: dict[str, Any] = field(default_factory=dict)


SERVICES = {
    "cloudflare": Service("https://api.cloudflare.com/client/v4/accounts/{account}/ai/run/{model}", 10, 4500, 4500, True, input_field="text", read="result.data"),
    "cohere": Service("https://api.cohere.com/v2/embed", 96, 1500, None, True, modes=("search_document", "search_document"), input_field="texts", size_field="output_dimension", read="embeddings.float", extra={"embedding_types": ["float"]}),
    "gemini": Service("https://generativelanguage.googleapis.com/v1beta/models/{model}:batchEmbedContents", 250, 8000, 18000, True, 3, ("RETRIEVAL_DOCUMENT", "CODE_RETRIEVAL_QUERY"), "taskType", "outputDimensionality", "requests", "{key}", "x-goog-api-key", "embeddings.values"),
    "jina": Service("https://api.jina.ai/v1/embeddings", 128, 32000, None, modes=("retrieval.passage", "retrieval.query"), mode_field="task"),
    "lmstudio": Service("http://127.0.0.1:1234/v1/embeddings", 32),
    "mistral": Service("https://api.mistral.ai/v1/embeddings", 128, 24000, 45000, True, size_field="output_dimension"),
    "ollama": Service("http://127.0.0.1:11434/api/embed", 32, read="embeddings"),
    "openai": Service("https://api.openai.com/v1/embeddings", 2048),
    "vertex": Service("https://{location}-aiplatform.googleapis.com/v1/projects/{project}/locations/{location}/publishers/google/models/{model}:predict", 250, 2000, 18000, True, 1, ("RETRIEVAL_DOCUMENT", "CODE_RETRIEVAL_QUERY"), "task_type", "outputDimensionality", "instances", read="predictions.embeddings.values"),
    "voyage": Service("https://api.voyageai.com/v1/embeddings", 128, modes=("document", "query"), size_field="output_dimension"),
}
LOCAL = {"lmstudio", "ollama"}


def dig(answer: Any, path: str) -> list[Any]:
    """The vectors or scores in an answer; lists whose entries carry an index are put in its order."""
    head, _, rest = path.partition(".")
    if isinstance(answer, list):
        rows = sorted(answer, key=lambda r: r["index"]) if answer and isinstance(answer[0], dict) and "index" in answer[0] else answer
        return [dig(r, path) for r in rows]
    return dig(answer[head], rest) if rest else answer[head]


@dataclass
class ServiceEmbedder:
    """``native``: the model's own dimensions; with fewer asked for, vectors are normalised again."""

    name: str
    model: str
    dimensions: int
    key: str = ""
    native: int | None = None
    transport: Transport = post
    parameters: dict[str, str] = field(default_factory=dict)
    tries: int = 3

    def __post_init__(self):
        if self.name not in SERVICES:
            raise ValueError(f"unknown service {self.name}")
        if not self.key and self.name not in LOCAL:
            raise ValueError(f"{self.name} needs a key")
        self.model_id = self.model

    def generate(self, texts: list[str]) -> list[list[float]]:
        return self._embed(texts, 0)

    def embed_query(self, text: str) -> list[float]:
        got = self._embed([text], 1)
        return got[0] if got else []

    def _body(self, s: Service, batch: list[str], mode: int) -> dict[str, Any]:
        task = {s.mode_field: s.modes[mode]} if s.modes else {}
        short = {s.size_field: self.dimensions} if self.native and self.dimensions < self.native else {}
        if s.input_field == "requests":
            return {"requests": [{"model": f"models/{self.model}", "content": {"parts": [{"text": t}]}, **task, **short} for t in batch]}
        if s.input_field == "instances":
            return {"instances": [{"content": t, **task} for t in batch], "parameters": short}
        return {"model": self.model, s.input_field: batch, **task, **short, **s.extra}

    def _embed(self, texts: list[str], mode: int) -> list[list[float]]:
        s = SERVICES[self.name]
        parts, ranges = [], []
        for t in texts:
            own = [t] if s.per_text is None else pieces(t, s.per_text) if s.split else [truncate_text(t, s.per_text)]
            ranges.append((len(parts), len(parts) + len(own)))
            parts += own
        url = s.url.format(model=self.model, **{"account": "", "location": "", "project": "", **self.parameters})
        headers = {s.auth_header: s.auth.format(key=self.key)} if self.key else {}

        def send(batch: list[str]) -> list[list[float]]:
            return dig(with_retries(lambda: self.transport(url, headers, self._body(s, batch, mode)), self.tries), s.read)

        batches = list(budget(parts, s.per_batch, s.items))
        if s.concurrency > 1:
            with ThreadPoolExecutor(s.concurrency) as pool:
                answers = list(pool.map(send, batches))
        else:
            answers = list(map(send, batches))
        flat = [v for a in answers for v in a]
        out = [flat[a] if b - a == 1 else mean(flat[a:b]) for a, b in ranges]
        return [normalise(v) for v in out] if self.native and self.dimensions < self.native else out


@dataclass(frozen=True)
class RerankService:
    url: str
    batch: int = 1 << 30
    head_tail: bool = False
    limit: int | None = None
    texts_field: str = "documents"
    results: str = "results"
    score: str = "relevance_score"
    auth: str = "Bearer {key}"
    auth_header: str = "Authorization"
    wrap: str | None = None


RERANKERS = {
    "cloudflare": RerankService("https://api.cloudflare.com/client/v4/accounts/{account}/ai/run/{model}", head_tail=True, texts_field="contexts", results="result.response", score="score", wrap="text"),
    "cohere": RerankService("https://api.cohere.com/v2/rerank", 1000, limit=16000),
    "gemini": RerankService("https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent", limit=4000, auth="{key}", auth_header="x-goog-api-key"),
    "jina": RerankService("https://api.jina.ai/v1/rerank", limit=8000),
    "vertex": RerankService("https://discoveryengine.googleapis.com/v1/projects/{project}/locations/global/rankingConfigs/default_ranking_config:rank", 200, limit=4000, texts_field="records", results="records", score="score", wrap="content"),
    "voyage": RerankService("https://api.voyageai.com/v1/rerank", 1000, limit=16000, results="data"),
}


@dataclass
class ServiceReranker:
    name: str
    model: str
    key: str
    transport: Transport = post
    parameters: dict[str, str] = field(default_factory=dict)
    tries: int = 3

    def __call__(self, query: str, texts: list[str]) -> list[float]:
        """One score for each text, in the order of the texts; 0 where the service gives none."""
        s = RERANKERS[self.name]
        url = s.url.format(model=self.model, **{"account": "", "project": "", **self.parameters})
        headers = {s.auth_header: s.auth.format(key=self.key)}
        cut = [head_and_tail(t) if s.head_tail else truncate_text(t, s.limit) if s.limit else t for t in texts]
        out = [0.0] * len(texts)
        for a in range(0, len(cut), s.batch):
            part = cut[a : a + s.batch]
            if self.name == "gemini":
                for i, x in enumerate(self._asked(url, headers, query, part)):
                    out[a + i] = x
                continue
            items: list[Any] = [{"id": str(i), s.wrap: t} if s.wrap == "content" else {s.wrap: t} for i, t in enumerate(part)] if s.wrap else part
            answer = with_retries(lambda: self.transport(url, headers, {"model": self.model, "query": query, s.texts_field: items}), self.tries)
            rows = answer
            for step in s.results.split("."):
                rows = rows[step]
            for row in rows:
                i = int(row.get("index", row.get("id", -1)))
                if 0 <= i < len(part):
                    out[a + i] = float(row.get(s.score) or 0.0)
        return out

    def _asked(self, url: str, headers: dict[str, str], query: str, texts: list[str]) -> list[float]:
        """A language model that is asked for a list of numbers; any other answer is an error."""
        listed = "\n\n".join(f"[{i}]\n{t}" for i, t in enumerate(texts))
        prompt = f"Rate from 0 to 1 how well each passage answers the query. Reply with a JSON list of {len(texts)} numbers.\nQuery: {query}\n\n{listed}"
        answer = with_retries(lambda: self.transport(url, headers, {"contents": [{"parts": [{"text": prompt}]}], "generationConfig": {"responseMimeType": "application/json"}}), self.tries)
        got = json.loads(answer["candidates"][0]["content"]["parts"][0]["text"])
        if not isinstance(got, list) or len(got) != len(texts) or not all(isinstance(x, int | float) for x in got):
            raise ValueError("the model didn't return one number for each passage")
        return [float(x) for x in got]


def from_settings(settings: dict[str, Any]) -> tuple[Any, Any]:
    """(embedder, reranker) of a settings file; False opts out, nothing leaves it out."""
    from .base import HashEmbedder

    e, r = settings.get("embedding"), settings.get("reranking")
    embedder = None
    if e:
        embedder = HashEmbedder(e.get("dimensions", 256)) if e["provider"] == "hash" else ServiceEmbedder(e["provider"], e["model"], e["dimensions"], e.get("key", ""), e.get("native"), parameters=e.get("parameters", {}))
    return embedder, ServiceReranker(r["provider"], r["model"], r["key"], parameters=r.get("parameters", {})) if r else None
