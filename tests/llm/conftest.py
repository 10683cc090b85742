import random

import pytest

#: Columns whose names operators use inside, beside those of ``documents``.
CLASHES = "id long, key long, tree int, n int, bits string, grams string, length int, kind int, v int, head long, context long, start int, _id long, _text string, _order long, _gone long, p string, doc long, rep long, member long, piece int, toxic int, rejected string, r_x double"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=True):
        """Documents from (doc_id, text) pairs, with columns of clashing names."""
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        data = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        if extra:
            schema += ", " + CLASHES
            data = [(*r, *[None if k % 3 == 0 else (float(k) if "double" in c else str(k) if "string" in c else k) for k, c in enumerate(CLASHES.split(", "))]) for r in data]
        return spark.createDataFrame(data, schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty and blank ones, ties, repeated rows, a very long text."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    long = " ".join(rng.choices(words, k=60_000))
    return [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (5, "one two"), (None, "one two three four"), (None, None), (6, long), (7, long), (8, "😀".encode("utf-16", "surrogatepass").decode("utf-16") + " smile"), (9, "x" * 5000)]


def texts(n, seed=3, low=20, high=120, vocabulary=500):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(vocabulary)]
    return [" ".join(rng.choices(words, k=rng.randint(low, high))) for _ in range(n)]
