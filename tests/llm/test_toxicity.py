import random

import numpy as np

from cairn.llm import toxicity as T


def corpus(n=240, seed=5):
    from conftest import texts

    rng = random.Random(seed)
    bad = ["you filthy scumbag", "i hate you vermin", "go die worthless trash", "shut up disgusting idiot"]
    out, label = [], []
    for i, t in enumerate(texts(n, seed=seed)):
        toxic = i % 4 == 0
        if toxic:
            words = t.split()
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
            t = " ".join(words)
        out.append(t)
        label.append(int(toxic))
    return out, label


def brute_features(text):
    """(passage, n-gram) pairs by slicing."""
    low = text.lower()
    return {(i // T.PASSAGE, low[i : i + n]) for n in T.LENGTHS for i in range(len(low) - n + 1)}


def test_features_count_every_ngram_once_a_passage():
    values = ["Hello hello HELLO", "", "ab", "x" * 1500]
    passage, bucket, passages = T.features(values)
    assert passages.tolist() == [1, 1, 1, 3]
    first = np.cumsum(passages) - passages
    for k, v in enumerate(values):
        mine = (passage >= first[k]) & (passage < first[k] + passages[k])
        assert mine.sum() == len(brute_features(v))


def test_held_out_accuracy():
    values, label = corpus()
    model = T.fit(values, label)
    unseen, truth = corpus(seed=9)
    got = T.scores(model, unseen) > model.limit
    truth = np.array(truth, bool)
    assert (got & truth).sum() >= 0.95 * truth.sum() and (got & ~truth).sum() <= 0.02 * (~truth).sum()


def test_the_whole_of_a_long_text_is_scored():
    values, label = corpus()
    model = T.fit(values, label)
    clean = " ".join(v for v, y in zip(values, label) if not y)
    assert T.scores(model, [clean])[0] <= model.limit
    assert T.scores(model, [clean * 3 + " i hate you vermin go die worthless trash shut up disgusting idiot you filthy scumbag " + clean])[0] > model.limit


def test_ratios_scale_the_features():
    """The ratios are those of counts taken one by one; halving a ratio halves what its feature can weigh."""
    values, label = corpus(60)
    values = [v[:400] for v in values]
    y = np.array(label)
    count = {k: np.zeros(1 << T.BITS, np.int64) for k in (0, 1)}
    for v, k in zip(values, label):
        for b in T.features([v])[1].tolist():
            count[k][b] += 1
    p, q = count[1], count[0]
    want = np.log(((p + 1) / (p.sum() + len(p))) / ((q + 1) / (q.sum() + len(q))))
    got = T._ratios(values, y, np.ones(len(y), bool))
    used = got != 0
    assert used.any() and np.allclose(got[used], want[used])
    assert ((p + q >= T.MIN_COUNT) & (np.abs(want) >= T.MIN_RATIO) == used).all()
    # A bucket that only toxic texts have pushes a score up, one that only clean texts have pushes it down.
    model = T.fit(values, label, rounds=1)
    on = model.weights != 0
    assert (np.sign(model.weights[on & (q == 0)]) >= 0).mean() > 0.95 and (np.sign(model.weights[on & (p == 0)]) <= 0).mean() > 0.95


def test_few_labels_still_make_a_model():
    values, label = corpus(200)
    toxic = [v for v, y in zip(values, label) if y][:4]
    clean = [v for v, y in zip(values, label) if not y][:36]
    model = T.fit(toxic + clean, [1] * 4 + [0] * 36)
    assert model is not None and (T.scores(model, toxic) > model.limit).all() and (T.scores(model, clean) > model.limit).sum() == 0
    assert T.fit(clean, [0] * 36) is None
    assert T.fit(toxic[:1] + clean[:1], [1, 0]) is not None


def test_frames(spark, docs_of, odd_rows):
    values, label = corpus()
    rows = [*odd_rows, *((100 + i, v) for i, v in enumerate(values))]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(100 + i, None, y) for i, y in enumerate(label)] + [(None, 1, 1), (100, 1, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    model = T.train(docs, labels)
    scored = T.score_toxicity(docs, model).collect()
    assert len(scored) == len(rows)
    toxic = {r["doc_id"] for r in scored if r["toxic"]}
    assert toxic == {100 + i for i, y in enumerate(label) if y}
    kept = T.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - sum(label)
    empty = docs_of([])
    assert T.train(empty, labels) is None
    assert T.score_toxicity(docs, None).where("toxicity is not null or toxic").count() == 0
    assert T.drop_toxic(empty, model).count() == 0
