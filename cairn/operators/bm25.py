"""BM25: scoring straight from texts, and from a table of postings.

From texts, a query costs two scans and no shuffle of rows: one aggregates the corpus figures
(number of texts, mean length, document frequency of each phrase) map-side, the other scores every row by
expressions and keeps the best k of each partition.  From postings, only the query's terms are read.
A query is an OR of phrases; the words of a phrase must stand side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _count(lowered: Column, phrase: tuple[str, ...]) -> Column:
    """How often a phrase occurs as whole words with no letter or digit between them, in a lower-case text; its words hold letters and digits only.

    All but the first letter is looked ahead at, so that overlapping occurrences count.
    """
    gap, edge = r"[^\p{L}\p{N}]+", r"(?![\p{L}\p{N}])"
    return F.regexp_count(lowered, F.lit(rf"(?<![\p{{L}}\p{{N}}]){phrase[0]}(?={''.join(gap + w for w in phrase[1:])}{edge})"))


def _idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def _weight(tf: Column, dl: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def score_texts(rows: DataFrame, query: str, id_col: str = "id", text_col: str = "search_content", where: Column | None = None) -> DataFrame:
    """(id, score) of every row that has one of the query's phrases; figures are those of all rows, scores of the rows that ``where`` admits.

    A null text has no words.  A query without words gives no rows.  Repeated ids are scored each.
    """
    phrases = T.query_phrases(query)
    if not phrases:
        return rows.select(F.col(id_col), F.lit(0.0).alias("score")).limit(0)
    names = [f"_tf{i}" for i in range(len(phrases))]

    def counted(df: DataFrame) -> DataFrame:
        low = df.select(F.col(id_col).alias("_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_low"))
        return low.select("_id", F.regexp_count("_low", F.lit(T.WORD)).alias("_dl"), *[_count(F.col("_low"), p).alias(n) for n, p in zip(names, phrases)])

    figures = counted(rows).agg(F.count("*").alias("_n"), F.avg("_dl").alias("_mean"), *[F.count_if(F.col(n) > 0).alias(f"{n}_df") for n in names])
    found = counted(rows if where is None else rows.where(where)).where(" or ".join(f"{n} > 0" for n in names))
    score = sum((_idf(F.col("_n"), F.col(f"{n}_df")) * _weight(F.col(n), F.col("_dl"), F.col("_mean")) for n in names), start=F.lit(0.0))
    # The figures are one row whatever the corpus.
    return found.crossJoin(F.broadcast(figures)).select(F.col("_id").alias(id_col), score.alias("score"))


def top_k(scored: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """The best k, ties by id, with their rank from 0."""
    return ranked(scored.orderBy(F.desc("score"), id_col).limit(k), [F.desc("score"), F.col(id_col)])


def ranked(few: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Numbers the rows of a result list that a limit has bounded."""
    from pyspark.sql import Window

    return few.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


#: Words that are grouped at a time.
WORDS = 1 << 20


def build_postings(rows: DataFrame, id_col: str = "id", text_col: str = "search_content", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(term, chunk_id, tf, positions) and (chunk_id, dl), with further columns ``keep``: the index that a store keeps.

    All words of a row are in that row, so they are grouped there, by a sort of numbers, and nothing is shuffled.  Rows with one id have postings each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lengths = rows.select(F.col(id_col).alias("chunk_id"), F.regexp_count(F.lower(text), F.lit(T.WORD)).alias("dl"), *keep)
    words = rows.select(F.col(id_col).alias("chunk_id"), T.tokens(text).alias("words"), *keep)
    kinds = dict(words.dtypes)
    names = ["term", "chunk_id", "tf", "positions", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(b.column(1).value_lengths().to_numpy())
            a = 0
            while a < len(b):
                n = max(1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + WORDS, "right")) - a)
                yield _grouped(b.slice(a, n), names)
                a += n

    kept = "".join(f", `{k}` {kinds[k]}" for k in keep)
    return words.mapInArrow(run, f"term string, chunk_id {kinds['chunk_id']}, tf int, positions array<int>{kept}"), lengths


def _grouped(b: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    sizes, flat = b.column(1).value_lengths().to_numpy(), b.column(1).flatten()
    coded = flat.dictionary_encode()
    row = np.repeat(np.arange(len(b)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # A word's number and its place in the batch, which tells row and position: one number, so a plain sort does.
    bits = len(flat).bit_length()
    key = np.sort((coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) << bits) + np.arange(len(flat)))
    order, code = key & ((1 << bits) - 1), key >> bits
    of = row[order]
    first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
    at = pa.array(of[first])
    tf = np.diff(first, append=len(key)).astype(np.int32)
    positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
    terms = coded.dictionary.take(pa.array(code[first]))
    return pa.record_batch([terms, b.column(0).take(at), pa.array(tf), positions, *[c.take(at) for c in b.columns[2:]]], names)


def score_postings(postings: DataFrame, lengths: DataFrame, query: str, admitted: DataFrame | None = None) -> DataFrame:
    """(chunk_id, score), equal to ``score_texts``; ``admitted`` holds the chunk ids that may be returned."""
    phrases = T.query_phrases(query)
    spark = postings.sparkSession
    if not phrases:
        return spark.createDataFrame([], "chunk_id string, score double")
    wanted = [(i, k, len(p), w) for i, p in enumerate(phrases) for k, w in enumerate(p)]
    spots = spark.createDataFrame(wanted, "phrase int, place int, words int, term string")
    hits = postings.where(F.col("term").isin(*{w[3] for w in wanted})).join(F.broadcast(spots), "term")
    # A phrase begins where each of its words stands at its place.
    begins = hits.select("phrase", "words", "chunk_id", F.explode("positions").alias("p"), "place").groupBy("phrase", "words", "chunk_id", (F.col("p") - F.col("place")).alias("at")).agg(F.count("*").alias("n")).where("n = words")
    tf = begins.groupBy("phrase", "chunk_id").agg(F.count("*").alias("tf"))
    df = tf.groupBy("phrase").agg(F.count("*").alias("df"))
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
    if admitted is not None:
        tf = tf.join(admitted.select("chunk_id"), "chunk_id", "left_semi")
    scored = tf.join(F.broadcast(df), "phrase").join(lengths, "chunk_id").crossJoin(F.broadcast(corpus))
    return scored.groupBy("chunk_id").agg(F.sum(_idf(F.col("n"), F.col("df")) * _weight(F.col("tf"), F.col("dl"), F.col("mean"))).alias("score"))


def like_search(rows: DataFrame, query: str, k: int, id_col: str = "id", text_col: str = "search_content") -> DataFrame:
    """Rows that hold the query literally, by id: what remains when a query has no word to look up."""
    found = rows.where(F.lower(F.col(text_col)).contains(query.lower())).select(id_col).orderBy(id_col).limit(k)
    return ranked(found, [F.col(id_col)])
