"""Toxicity: a character n-gram linear classifier with naive Bayes log-count ratios as feature scales.

A text is lower-cased and cut into passages of ``PASSAGE`` characters (an n-gram belongs to the
passage it starts in, so none is lost at a cut).  A passage's features are the distinct n-grams of
3 to 6 characters in it, hashed into ``2**BITS`` buckets.  From labelled passages come the log
ratios r = log(share in toxic / share in clean) of each bucket; a logistic regression with ridge
penalty is fitted on the features times r.  A toxic text need not be toxic throughout, so fitting is
repeated with the passages of toxic texts that the last model held clean left out.  A text scores
as its highest passage; the limit is put between the held-out toxic and clean texts.

Fitting uses at most ``MAX_LABELLED`` labelled texts (half toxic, half clean, as far as there are
such, picked by a hash of id and text), whole.  Scoring covers every row and every character.

Null and empty texts have one passage without features, thus the lowest score there is, and aren't
toxic.  Without labelled texts of both kinds there is no model: scores are null and nothing is
toxic.  A kind with fewer than five texts is not held out from: its own texts then set the limit, which is only as good as
so few can make it.  Labels that are null, or rows of ``labels`` whose id is null or unknown, are left out; of
several labels for an id the highest counts.  Repeated rows are scored each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling as R
from .common import slices, texts

BITS, LENGTHS, PASSAGE = 20, (3, 4, 5, 6), 512
MAX_LABELLED = 2400
#: Buckets in fewer labelled passages (or than there are of the rarer kind), or whose ratio is nearer to 0, have no weight.
MIN_COUNT, MIN_RATIO = 6, 1.5
SLICE_CHARS = 1 << 18


@dataclass
class Model:
    weights: np.ndarray  # of each bucket: coefficient times ratio
    bias: float
    limit: float


def features(values: list[str], used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (passage, bucket) pairs, sorted, and the number of passages of each text.

    ``used`` leaves out buckets before the sort; it changes no sum over the buckets in it.
    """
    parts = [R.codes(v.lower()) for v in values]
    sizes = np.array([len(p) for p in parts], np.int64)
    passages = np.maximum(1, -(-sizes // PASSAGE))
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), passages
    c = R.mix(np.concatenate(parts), 11)
    begin = np.cumsum(sizes) - sizes
    first = np.cumsum(passages) - passages
    at = np.arange(len(c)) - np.repeat(begin, sizes)
    passage = np.repeat(first, sizes) + at // PASSAGE
    left = np.repeat(sizes, sizes) - at
    keys, h = [], c
    for n in range(2, max(LENGTHS) + 1):
        h = h[: len(c) - n + 1] * R.U(R.BASE) + c[n - 1 :]
        if n not in LENGTHS or not len(h):
            continue
        bucket = ((h * R.U(R.WORD_BASE + 2 * n)) >> R.U(64 - BITS)).astype(np.int64)
        ok = left[: len(h)] >= n
        if used is not None:
            ok &= used[bucket]
        keys.append((passage[: len(h)][ok] << BITS) | bucket[ok])
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key >> BITS, key & ((1 << BITS) - 1), passages


def scores(model: Model, values: list[str]) -> np.ndarray:
    """The log odds of each text's highest passage."""
    used, out = model.weights != 0, []
    for a, b in slices(values, SLICE_CHARS):
        passage, bucket, passages = features(values[a:b], used)
        logit = model.bias + np.bincount(passage, model.weights[bucket], int(passages.sum()))
        out.append(np.maximum.reduceat(logit, np.cumsum(passages) - passages))
    return np.concatenate(out) if out else np.zeros(0)


def _logistic(rows: np.ndarray, cols: np.ndarray, x: np.ndarray, y: np.ndarray, width: int, ridge: float = 1e-4, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weighted so that both classes count alike; Adam over the whole data, hence deterministic."""
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols] * x, len(y)) + w[-1], -30, 30)))
        e = (p - y) * share
        g = np.append(np.bincount(cols, e[rows] * x, width) + ridge * w[:-1], e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w[:-1], float(w[-1])


def _sliced(values: list[str], used: np.ndarray | None = None):
    """``features`` of a few texts at a time, so that only what is used is ever held for all."""
    done = 0
    for a, b in slices(values, SLICE_CHARS):
        passage, bucket, passages = features(values[a:b], used)
        yield passage + done, bucket, passages
        done += int(passages.sum())


def _ratios(values: list[str], y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Of each bucket, from the buckets of the passages in use and their labels; 0 where it has no weight."""
    least = min(MIN_COUNT, max(1, min(int((use & (y == k)).sum()) for k in (0, 1))))
    p, q = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for passage, bucket, _ in _sliced(values):
        for count, k in ((p, 1), (q, 0)):
            count += np.bincount(bucket[use[passage] & (y[passage] == k)], minlength=1 << BITS)
    r = np.log(((p + 1) / (p.sum() + len(p))) / ((q + 1) / (q.sum() + len(q))))
    r[(p + q < least) | (np.abs(r) < MIN_RATIO)] = 0
    return r


def fit(values: list[str], toxic: list[int], rounds: int = 3) -> Model | None:
    """A model of labelled texts, of which every fifth of a class is held out for the limit."""
    label = np.array(toxic, np.int64)
    if len(set(toxic)) < 2:
        return None
    held, test = np.zeros(len(label), bool), np.zeros(len(label), bool)
    for k in (0, 1):
        own = np.flatnonzero(label == k)
        if len(own) >= 5:
            held[own[::5]] = True
        test[own[::5] if len(own) >= 5 else own] = True
    train = [v for v, h in zip(values, held) if not h]
    passages = np.array([max(1, -(-len(v.lower()) // PASSAGE)) for v in train])
    y = np.repeat(label[~held], passages)
    use = np.ones(len(y), bool)
    model = None
    for _ in range(rounds):
        r = _ratios(train, y, use)
        parts = [(passage.astype(np.int32), bucket.astype(np.int32)) for passage, bucket, _ in _sliced(train, r != 0)]
        passage, bucket = (np.concatenate(x) for x in zip(*parts))
        kept = np.flatnonzero(r)
        col = np.searchsorted(kept, bucket).astype(np.int32)
        mine = use[passage]
        row = (np.cumsum(use) - 1).astype(np.int32)
        w, bias = _logistic(row[passage[mine]], col[mine], r[kept][col[mine]].astype(np.float32), y[use], len(kept))
        weights = np.zeros(1 << BITS)
        weights[kept] = w * r[kept]
        model = Model(weights, bias, 0.0)
        logit = bias + np.bincount(passage, weights[bucket], len(y))
        top = np.maximum.reduceat(logit, np.cumsum(passages) - passages)
        # Of a toxic text stay the passages held toxic, and the highest one in any case.
        use = (y == 0) | (logit > 0) | (logit >= np.repeat(top, passages))
    s = scores(model, [v for v, h in zip(values, test) if h])
    model.limit = _limit(s[label[test] == 1], s[label[test] == 0])
    return model


def _limit(toxic: np.ndarray, clean: np.ndarray) -> float:
    """Where fewest held-out texts are on the wrong side, a clean one counting four times; of equals the middle."""
    at = np.unique(np.concatenate((toxic, clean)))
    cuts = np.concatenate((at[:1] - 1, (at[1:] + at[:-1]) / 2, at[-1:] + 1))
    wrong = np.array([(toxic <= c).sum() + 4 * (clean > c).sum() for c in cuts])
    best = np.flatnonzero(wrong == wrong.min())
    low, high = cuts[best[0]], cuts[best[-1]]
    return float((low + high) / 2)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fits on the labelled rows of ``docs``; only the bounded sample reaches the driver."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(id_col).agg((F.max("toxic") > 0).cast("int").alias("_toxic"))
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null")
    # Ids first: the sample is picked without moving any text.
    ids = own.select("_id").join(known.withColumnRenamed(id_col, "_id"), "_id").distinct().withColumn("_order", F.xxhash64("_id"))
    picked = ids.where("_toxic = 1").orderBy("_order", "_id").limit(max_labelled // 2).unionAll(ids.where("_toxic = 0").orderBy("_order", "_id").limit(max_labelled - max_labelled // 2)).collect()
    if not picked:
        return None
    label = {r["_id"]: r["_toxic"] for r in picked}
    sample = docs.sparkSession.createDataFrame([(k,) for k in label], own.select("_id").schema)
    rows = own.join(F.broadcast(sample), "_id").toArrow()  # the sample's size is bounded by the parameter
    order = sorted(zip(rows.column("_id").to_pylist(), rows.column("_text").to_pylist()))
    return fit([t for _, t in order], [label[i] for i, _ in order])


def _score_batches(spark: SparkSession, model: Model | None):
    shared = spark.sparkContext.broadcast(model and Model(model.weights.astype(np.float32), model.bias, model.limit))

    def score(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        m = shared.value
        if m is None:
            return np.full(len(values), np.nan), np.zeros(len(values), bool)
        s = scores(m, values)
        return s, s > m.limit

    return score


def score_toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ``toxicity`` (probability) and ``toxic``."""
    score = _score_batches(docs.sparkSession, model)

    def run(batches):
        for b in batches:
            s, toxic = score(texts(b.column(1)))
            p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            yield pa.record_batch([b.column(0), pa.array(p, from_pandas=True), pa.array(toxic)], [id_col, "toxicity", "toxic"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, toxicity double, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the model doesn't hold toxic; no shuffle."""
    score = _score_batches(docs.sparkSession, model)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(~score(texts(b.column(text_col)))[1]))

    return docs.mapInArrow(run, docs.schema)
