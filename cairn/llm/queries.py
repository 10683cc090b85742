"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard, licenses, packing, pii, repetition, sentencepiece_bpe, tiff, toxicity, warc
from .common import map_arrow, shared_dir, table

#: Where the tokenizer's model is read; the driver alone reads it.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
COMPRESSIONS = (1, 32773, 5, 8)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogate_pii(table(spark, sf_dir, "documents"), pii.key_of(spark))


def scanned(number: int, html: str, url: str) -> bytes:
    """A page's bytes as a two-page TIFF: html 64 samples wide, url 16 wide, spaces up to whole rows.

    Layout, byte order and coding vary with the page's number.
    """

    def grid(text: str, width: int) -> np.ndarray:
        raw = text.encode()
        return np.frombuffer(raw.ljust(max(1, -(-len(raw) // width)) * width), np.uint8).reshape(-1, width, 1)

    coding = {"compression": COMPRESSIONS[number % 4], "predictor": 1 + number // 4 % 2, "block": (32, 48) if number // 8 % 2 else (40,)}
    return tiff.encode([{"pixels": grid(html, 64), "order": "<>"[number // 16 % 2], "big": bool(number // 32 % 2), **coding}, {"pixels": grid(url, 16), **coding}])


def _scan(batch: pa.RecordBatch) -> pa.RecordBatch:
    images = [scanned(n or 0, html or "", url or "") for n, html, url in zip(*(c.to_pylist() for c in batch.columns))]
    return pa.record_batch([batch.column(0), pa.array(images, pa.binary())], ["page_id", "image"])


def op3_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has images: every page is first scanned into one."""
    media = map_arrow(table(spark, sf_dir, "pages").select("page_id", "html", "url"), _scan, "page_id long, image binary")
    pages = tiff.tiff_pages(media, "page_id", "image")
    return pages.select("page_id", "page", "width", "height", "samples", "bits", "compression", "predictor", "tiled", F.md5("pixels").alias("pixels_md5"), "error")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_texts(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan_licenses(docs, licenses.train_on(docs))


def op6_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_report(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op9_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has archives: the pages are first written as WARC files, each with a quoted record in a payload."""
    path = shared_dir(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), path)
    records = warc.read_warc(spark, path)
    return records.select(F.regexp_extract("record_id", r"urn:page:(-?\d*)", 1).cast("long").alias("page_id"), "type", "uri", "date", "length", "truncated", F.md5("payload").alias("payload_md5"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_classes(table(spark, sf_dir, "documents"))


_SPACE = r"[ \t\n\x0b\f\r]"
_LINE = rf"regexp_replace(l, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_TOP = ", ".join(f"coalesce(max(t) filter (n = {n}), 0) / greatest(any_value(total), 1) AS r_top_{n}" for n in repetition.TOP)
_DUP = ", ".join(f"coalesce(max(d) filter (n = {n}), 0) / greatest(any_value(total), 1) AS r_dup_{n}" for n in repetition.COVERED)
_OVER = " OR ".join(f"r_{name} > {limit}" for name, limit in zip(repetition.FIGURES, repetition.LIMITS))

_LEADS = ", ".join(f"lead(w, {k}) OVER o AS w{k}" for k in range(1, 10))
_GRAMS = " UNION ALL ".join(f"SELECT doc_id, {n} AS n, i, concat_ws(' ', {', '.join(f'w{k}' for k in range(n))}) AS g FROM ahead WHERE w{n - 1} IS NOT NULL" for n in range(2, 11))
_HTTP = "'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')"
_QUOTE = f"""replace('WARC/1.0~WARC-Type: response~WARC-Target-URI: ' || coalesce(url, '') || '~WARC-Date: 2024-01-01T00:00:00Z~WARC-Record-ID: <urn:page:' || page_id || ':r>~Content-Type: application/http; msgtype=response~Content-Length: ' || octet_length(encode(body)) || '~~quoted', '~', chr(13) || chr(10))"""
_NAMES = ("none", "packbits", "lzw", "deflate")

ORACLES = {
    "op3_tiff_pages": f"""
        WITH raw AS (SELECT page_id, 0 AS page, 64 AS width, coalesce(html, '') AS t FROM pages UNION ALL SELECT page_id, 1, 16, coalesce(url, '') FROM pages),
        sized AS (SELECT *, octet_length(encode(t)) AS n, greatest(1, (octet_length(encode(t)) + width - 1) // width) AS height FROM raw)
        SELECT page_id, page, width, height, 1 AS samples, 8 AS bits, list_extract({list(_NAMES)}, page_id % 4 + 1) AS compression, 1 + page_id // 4 % 2 AS predictor,
            page_id // 8 % 2 = 1 AS tiled, md5(t || repeat(' ', (width * height - n)::INT)) AS pixels_md5, NULL::VARCHAR AS error FROM sized""",
    "op8_chat_round_trip": r"""
        WITH turn AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                regexp_matches(coalesce(text, ''), '<\|im_(start|end)\|>|<\\+\|') OR regexp_matches(coalesce(role, ''), '<\|im_(start|end)\|>|\\|\n') AS conflict
            FROM conversations WHERE conv_id IS NOT NULL),
        safe AS (
            SELECT conv_id, turn, role, text, conflict,
                CASE WHEN conflict THEN replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<|', '<\e|') ELSE role END AS r,
                CASE WHEN conflict THEN regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') ELSE text END AS t FROM turn)
        SELECT conv_id, string_agg('<|im_start|>' || r || chr(10) || t || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS chat,
            count(*) AS turns, count(*) FILTER (conflict) AS escaped, true AS exact FROM safe GROUP BY conv_id""",
    "op9_warc_records": f"""
        WITH http AS (SELECT page_id, url, {_HTTP} AS body FROM pages),
        record AS (SELECT page_id, url, 'response' AS type, body AS payload FROM http UNION ALL SELECT page_id, url, 'metadata', {_QUOTE} FROM http)
        SELECT page_id, type, url AS uri, '2024-01-01T00:00:00Z' AS date, octet_length(encode(payload)) AS length, false AS truncated, md5(payload) AS payload_md5 FROM record""",
    "op6_repetition": rf"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\f\r]+') AS ws FROM documents),
        total AS (SELECT doc_id, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::DOUBLE AS total FROM docs),
        word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM docs),
        ahead AS (SELECT doc_id, i, w AS w0, {_LEADS} FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        gram AS ({_GRAMS}),
        seen AS (SELECT doc_id, n, g, list(i) AS places, count(*) AS c FROM gram GROUP BY doc_id, n, g HAVING count(*) > 1),
        top AS (SELECT doc_id, n, max(c * (length(g) - n + 1)) AS t FROM seen WHERE c >= {repetition.TOP_TIMES} AND n < 5 GROUP BY doc_id, n),
        later AS (SELECT doc_id, n, unnest(list_sort(places)[2:]) AS i FROM seen WHERE n >= 5),
        inside AS (SELECT DISTINCT doc_id, n, i + k AS i FROM later, (SELECT unnest(range(0, 10)) AS k) WHERE k < n),
        dup AS (SELECT doc_id, n, sum(length(w)) AS d FROM inside JOIN word USING (doc_id, i) GROUP BY doc_id, n),
        line AS (SELECT doc_id, pos, {_LINE} AS l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM docs)),
        again AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id, l ORDER BY pos) > 1 AS again FROM line WHERE l <> ''),
        lines AS (SELECT doc_id, count(*) FILTER (again) / count(*) AS r_dup_lines, coalesce(sum(length(l)) FILTER (again), 0) / sum(length(l)) AS r_dup_line_chars FROM again GROUP BY doc_id),
        figures AS (
            SELECT doc_id, {_TOP}, {_DUP}, coalesce(any_value(r_dup_lines), 0) AS r_dup_lines, coalesce(any_value(r_dup_line_chars), 0) AS r_dup_line_chars
            FROM total LEFT JOIN (SELECT doc_id, n, t, NULL AS d FROM top UNION ALL SELECT doc_id, n, NULL, d FROM dup) USING (doc_id) LEFT JOIN lines USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, {", ".join(f"round(r_{x}::DOUBLE, 6) AS {x}" for x in repetition.FIGURES)}, ({_OVER}) AS rejected FROM figures""",
    "op10_ngram_jaccard": r"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        word AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM words),
        ahead AS (SELECT doc_id, n, i, w, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        gram AS (SELECT DISTINCT doc_id, concat_ws(' ', w, w1, w2) AS g FROM ahead WHERE w2 IS NOT NULL OR (n < 3 AND i = 1)),
        size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= 0.5),
        reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
        SELECT doc_id, least(doc_id, (SELECT min(b) FROM reach WHERE a = doc_id)) AS class_id, (SELECT count(*) FROM link WHERE a = doc_id) AS links FROM documents""",
}

_ALL = (
    op1_toxicity, op2_pii_surrogates, op3_tiff_pages, op4_sentencepiece, op5_license_scan,
    op6_repetition, op7_best_fit_packing, op8_chat_round_trip, op9_warc_records, op10_ngram_jaccard,
)
QUERIES = {f.__name__: f for f in _ALL}
