"""The benchmark tables read as a project: documents are files, keys are edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import edge_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one chunk: its source is its folder, its first word its name, its length its type."""
    kind = F.when(F.col("n_chars") < 400, "const").when(F.col("n_chars") < 1500, "function").when(F.col("n_chars") < 4000, "class").otherwise("file")
    lines = F.size(F.split("text", "\n", -1))
    return table(spark, sf_dir, "documents").select(
        F.format_string("d%08d", "doc_id").alias("id"), F.lit("corpus").alias("project_id"), F.concat_ws("/", F.col("source"), F.col("lang")).alias("file_path"), F.col("lang").alias("language"),
        kind.alias("type"), F.nullif(F.regexp_extract("text", r"^([A-Za-z]+)", 1), F.lit("")).alias("name"), F.col("text").alias("search_content"),
        F.col("doc_id").cast("int").alias("start_line"), (F.col("doc_id") + lines - 1).cast("int").alias("end_line"), F.col("doc_id").cast("int").alias("ord"),
    )


CHUNKS = r"""
    chunks AS (
        SELECT format('d{:08d}', doc_id) AS id, 'corpus' AS project_id, concat_ws('/', source, lang) AS file_path, lang AS language,
            CASE WHEN n_chars < 400 THEN 'const' WHEN n_chars < 1500 THEN 'function' WHEN n_chars < 4000 THEN 'class' ELSE 'file' END AS type,
            nullif(regexp_extract(text, '^([A-Za-z]+)', 1), '') AS name, text AS search_content, doc_id::INT AS start_line,
            (doc_id + len(string_split(text, chr(10))) - 1)::INT AS end_line, doc_id::INT AS ord
        FROM documents)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, type) of the rows that keys lead to."""
    parts = [
        table(spark, sf_dir, t).select(F.concat(F.lit(t[0] + ":"), F.col(k).cast("string")).alias("id"), F.col(n).alias("name"), F.lit(t).alias("type"))
        for t, k, n in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("orders", "o_orderkey", "o_orderpriority"))
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys as edges: nation EXTENDS region, customer and supplier IMPLEMENTS nation, order CALLS customer, order USES part."""

    def of(t: str, src: tuple[str, str], dst: tuple[str, str], kind: str, repeated: bool = False) -> DataFrame:
        end = lambda e: F.concat(F.lit(e[0]), F.col(e[1]).cast("string"))
        keys = table(spark, sf_dir, t).select(src[1], dst[1])
        # The keys are made distinct, not the six columns of text that are made of them.
        return (keys.distinct() if repeated else keys).select(F.lit("keys").alias("project_id"), end(src).alias("source_chunk_id"), F.lit(t).alias("source_file_path"), end(dst).alias("target_chunk_id"), F.lit(kind).alias("type"), F.lit("{}").alias("metadata"))

    parts = [
        of("nation", ("n:", "n_nationkey"), ("r:", "n_regionkey"), "EXTENDS"), of("customer", ("c:", "c_custkey"), ("n:", "c_nationkey"), "IMPLEMENTS"), of("supplier", ("s:", "s_suppkey"), ("n:", "s_nationkey"), "IMPLEMENTS"),
        of("orders", ("o:", "o_orderkey"), ("c:", "o_custkey"), "CALLS"), of("lineitem", ("o:", "l_orderkey"), ("p:", "l_partkey"), "USES", True),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.select(edge_id("project_id", "source_chunk_id", "target_chunk_id", "type").alias("id"), "*")


EDGES = """
    entities AS (
        SELECT 'r:' || r_regionkey AS id, r_name AS name, 'region' AS type FROM region UNION ALL SELECT 'n:' || n_nationkey, n_name, 'nation' FROM nation UNION ALL SELECT 'c:' || c_custkey, c_name, 'customer' FROM customer
        UNION ALL SELECT 's:' || s_suppkey, s_name, 'supplier' FROM supplier UNION ALL SELECT 'p:' || p_partkey, p_name, 'part' FROM part UNION ALL SELECT 'o:' || o_orderkey, o_orderpriority, 'orders' FROM orders),
    pairs AS (
        SELECT 'n:' || n_nationkey AS source_chunk_id, 'nation' AS source_file_path, 'r:' || n_regionkey AS target_chunk_id, 'EXTENDS' AS type FROM nation
        UNION ALL SELECT 'c:' || c_custkey, 'customer', 'n:' || c_nationkey, 'IMPLEMENTS' FROM customer UNION ALL SELECT 's:' || s_suppkey, 'supplier', 'n:' || s_nationkey, 'IMPLEMENTS' FROM supplier
        UNION ALL SELECT 'o:' || o_orderkey, 'orders', 'c:' || o_custkey, 'CALLS' FROM orders UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'lineitem', 'p:' || l_partkey, 'USES' FROM lineitem),
    edges AS (SELECT substr(sha1(concat_ws(':', 'keys', source_chunk_id, target_chunk_id, type)), 1, 16) AS id, 'keys' AS project_id, *, '{}' AS metadata FROM pairs)"""


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a TypeScript-like project: a file for each nation and customer, an index for each region."""
    name = lambda c: F.regexp_replace(c, " ", "_")
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("src/nation/"), name("n_name"), F.lit(".ts")).alias("file_path"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("src/region/"), name("r_name"), F.lit("/index.ts")))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("src/customer/"), F.lower("c_mktsegment"), F.lit("/c"), F.col("c_custkey").cast("string"), F.lit(".tsx")))
    return n.unionAll(r).unionAll(c)


def project_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from_file, specifier): customers import their nation by a compiled name, a region by an alias, a missing file and a package."""
    name = lambda c: F.regexp_replace(c, " ", "_")
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey")).join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    file = F.concat(F.lit("src/customer/"), F.lower("c_mktsegment"), F.lit("/c"), F.col("c_custkey").cast("string"), F.lit(".tsx"))
    four = F.array(F.concat(F.lit("../../nation/"), name("n_name"), F.lit(".js")), F.concat(F.lit("@region/"), name("r_name")), F.lit("./missing"), F.lit("react"))
    return c.select(file.alias("from_file"), F.explode(four).alias("specifier"))


ALIASES = [("@region/*", ["src/region/*"]), ("@config", ["src/config.ts"])]
PROJECT = """
    project AS (
        SELECT 'src/nation/' || replace(n_name, ' ', '_') || '.ts' AS file_path FROM nation UNION ALL SELECT 'src/region/' || replace(r_name, ' ', '_') || '/index.ts' FROM region
        UNION ALL SELECT 'src/customer/' || lower(c_mktsegment) || '/c' || c_custkey || '.tsx' FROM customer),
    own AS (SELECT 'src/customer/' || lower(c_mktsegment) || '/c' || c_custkey || '.tsx' AS from_file, replace(n_name, ' ', '_') AS n, replace(r_name, ' ', '_') AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    imports AS (SELECT from_file, unnest(['../../nation/' || n || '.js', '@region/' || r, './missing', 'react']) AS specifier FROM own)"""


def texts_of_customers(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(file_path, text): every customer as a small JSON, YAML, TOML or Markdown file."""
    s = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    k, n, seg, nat = F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    text = {
        "json": s('{\n  "key": ', k, ',\n  "name": "', n, '",\n  "nested": {\n    "segment": "', seg, '"\n  },\n  "nation": ', nat, "\n}"),
        "yaml": s("key: ", k, "\nname: ", n, "\nnested:\n  segment: ", seg, "\n---\nnation: ", nat),
        "toml": s("top = 1\n[key]\nk = ", k, "\n[name]\nn = '", n, "'\n[[segment]]\ns = '", seg, "'\n[nation.id]\nn = ", nat),
        "markdown": s("intro\n# ", seg, "\nx\n## ", n, "\n### nation ", nat, "\ny\n### again\n## other\n# last ", k),
    }[kind]
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), k, F.lit("." + kind)).alias("file_path"), text.alias("text"))


def texts_sql(kind: str) -> str:
    text = {
        "json": """'{~  "key": ' || c_custkey || ',~  "name": "' || c_name || '",~  "nested": {~    "segment": "' || c_mktsegment || '"~  },~  "nation": ' || c_nationkey || '~}'""",
        "yaml": """'key: ' || c_custkey || '~name: ' || c_name || '~nested:~  segment: ' || c_mktsegment || '~---~nation: ' || c_nationkey""",
        "toml": """'top = 1~[key]~k = ' || c_custkey || '~[name]~n = ''' || c_name || '''~[[segment]]~s = ''' || c_mktsegment || '''~[nation.id]~n = ' || c_nationkey""",
        "markdown": """'intro~# ' || c_mktsegment || '~x~## ' || c_name || '~### nation ' || c_nationkey || '~y~### again~## other~# last ' || c_custkey""",
    }[kind]
    return f"""
    files AS (SELECT 'c' || c_custkey || '.{kind}' AS file_path, replace({text}, '~', chr(10)) AS text FROM customer),
    split AS (SELECT file_path, string_split(text, chr(10)) AS ls FROM files),
    line AS (SELECT file_path, len(ls) AS n, unnest(range(1, len(ls) + 1))::INT AS line, unnest(ls) AS v, ls FROM split)"""
