"""Queries that exercise merge, text and profiling operators on the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.functions import text
from lodeweave.operators import merge, recipes
from lodeweave.operators.graph import Graph, latest
from lodeweave.plans.graph_queries import _CATALOG, _CLEAN, _CODE, catalog, code
from lodeweave.plans.graph_queries import SQL as GRAPH_SQL
from lodeweave.query.pattern import compile_query
from lodeweave.runtime import read_table
from lodeweave.sources.catalog import profile
from lodeweave.sources.structure import structures
from lodeweave.sources.tree import modules_by_longest_prefix


# -- orders as commits, parts as files, order lines as changes -----------------
def shop_history(spark: SparkSession, d: str) -> Graph:
    """The history part of the graph from the order tables: who ordered what is who changed which file."""
    g = Graph()
    g.nodes["Author"] = read_table(spark, d, "customer").select(F.lower("c_name").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("key"))
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("authored_at"))
    g.nodes["Commit"] = o.select("id", "authored_at")
    g.rels["AUTHORED"] = o.join(g.nodes["Author"].select("key", F.col("id").alias("src")), "key").select("src", F.col("id").alias("dst"))
    g.nodes["File"] = read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.col("p_type"), F.lit("/"), F.col("p_brand"), F.lit("/"), F.col("p_name"), F.lit("#"), F.col("p_partkey")).alias("path"), F.col("p_brand").alias("repo"))
    line = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").cast("bigint").alias("insertions"), F.col("l_linenumber").cast("bigint").alias("deletions"), "l_suppkey", "l_shipdate", "l_extendedprice")
    g.rels["CHANGED"] = latest(line, ["src", "dst"], ["deletions", "l_suppkey", "l_shipdate", "l_extendedprice", "insertions"])
    return g


_SHOP = """WITH ch AS (SELECT * FROM (SELECT l_orderkey AS src, l_partkey AS dst, CAST(l_quantity AS BIGINT) AS ins, l_linenumber AS del, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber DESC, l_suppkey DESC, l_shipdate DESC, l_extendedprice DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1),
au AS (SELECT o.o_orderkey AS k, c.c_custkey AS a, c.c_name AS name, strftime(o.o_orderdate, '%Y-%m-%dT%H:%M:%S') AS day FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey),
fl AS (SELECT p_partkey AS id, p_type || '/' || p_brand || '/' || p_name || '#' || p_partkey AS path, p_brand AS repo FROM part)"""


# -- merge ---------------------------------------------------------------------
_ASSIGNS = {"message": None, "insertions": None, "authored_at": None}


def _feed(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "commits").where("repo is not null and commit_hash is not null")
    return c.select(F.concat_ws("@", "repo", "commit_hash").alias("id"), "message", "insertions", "authored_at", "recorded_at", F.lit("commit").alias("kind"))


_ORDER = ["recorded_at", "message", "insertions", "authored_at"]


def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return merge.fold(_feed(spark, d), ["id"], _ORDER, _ASSIGNS).select("id", *_ASSIGNS)


def incremental_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The feed folded in two batches, split by time, gives what one batch gives."""
    f = _feed(spark, d)
    mark = f.agg(F.percentile_approx(F.unix_micros(F.col("recorded_at").cast("timestamp")), 0.5)).first()[0]
    early = F.unix_micros(F.col("recorded_at").cast("timestamp")) <= F.lit(mark)
    first = merge.fold(f.where(early), ["id"], _ORDER, _ASSIGNS).select("id", *_ASSIGNS)
    return merge.upsert(first, merge.fold(f.where(~early), ["id"], _ORDER, _ASSIGNS), ["id"])


def edge_endpoint_filter(spark: SparkSession, d: str) -> DataFrame:
    """Foreign keys as written, kept only where both tables exist under exactly that name."""
    t = catalog(spark, d).nodes["Table"].select(F.concat_ws("/", "database", "name").alias("id")).distinct()
    e = read_table(spark, d, "foreign_keys").select(F.concat_ws("/", "database_name", "from_table").alias("src"), F.concat_ws("/", "database_name", "to_table").alias("dst"), "fk_id")
    return merge.edges_with_ends(e, t, t)


def replace_repo(spark: SparkSession, d: str) -> DataFrame:
    """Containment after one repository was cleared."""
    g = code(spark, d)
    gone = g.nodes["File"].where("repo = 'atlas-core'").select("id").union(g.nodes["Class"].where("repo = 'atlas-core'").select("id"))
    return merge.detached(g.rels["CONTAINS_CLASS"], gone)


def replace_database(spark: SparkSession, d: str) -> DataFrame:
    g = catalog(spark, d)
    one = g.nodes["Database"].agg(F.min("id")).first()[0] or ""
    return merge.without_database(g.nodes["Table"], one).select("id", "name")


def dry_run_counts(spark: SparkSession, d: str) -> DataFrame:
    g = code(spark, d)
    nodes = g.all_nodes().groupBy("label").agg(F.count("*").alias("n")).select(F.concat(F.lit("node "), "label").alias("kind"), "n")
    return nodes.union(g.all_rels().groupBy("type").agg(F.count("*").alias("n")).select(F.concat(F.lit("rel "), "type"), "n"))


# -- text ----------------------------------------------------------------------
def _lines(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "scanned_files").select("file_id", "file_extension", F.inline("code_lines"))


def classify_line(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("file_id", "line_no", text.line_kind("line_text", "file_extension").alias("kind"))


def next_line_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = F.lead("line_no").over(Window.partitionBy("file_id").orderBy("line_no"))
    return _lines(spark, d).select("file_id", F.col("line_no").alias("src"), n.alias("dst")).where("dst is not null")


def line_explode(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("number"), F.md5("line").alias("line_md5"))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    body = F.array_join(F.transform("code_lines", lambda x: F.coalesce(x["line_text"], F.lit(""))), "\n")
    return read_table(spark, d, "scanned_files").select("file_id", F.md5(body).alias("hash"))


def file_type(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "scanned_files").select("file_id", text.file_type("file_name").alias("type"))


def module_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    f = read_table(spark, d, "scanned_files").select("file_id", "repo", "relpath")
    m = read_table(spark, d, "scanned_files").where("module_key <> ''").select("repo", F.col("module_key").alias("root")).distinct()
    return modules_by_longest_prefix(f, m).select("file_id", "root")


def strip_url_credentials(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "repositories").select("repo_id", text.strip_credentials("url").alias("url"))


def table_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile({t: read_table(spark, d, t) for t in ("customer", "part", "supplier", "nation")})


def _profile_sql() -> str:
    cols = {"customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "supplier": "s_suppkey s_name s_nationkey s_acctbal", "nation": "n_nationkey n_name n_regionkey"}
    return " UNION ALL ".join(f"""SELECT '{t}' AS "table", '{c}' AS "column", count(*) AS "rows", count(DISTINCT {c}) AS distinct_values FROM {t}""" for t, cs in cols.items() for c in cs.split())


def parsed_structure(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, kind, name, line) of what the parsers declare in every file."""
    s = structures(read_table(spark, d, "scanned_files").withColumn("texts", F.transform("code_lines", lambda x: x["line_text"])), "file_id", "file_type", "texts")
    types = s.select("file_id", F.explode("types").alias("t")).select("file_id", F.col("t.kind").alias("kind"), F.col("t.name").alias("name"), F.col("t.line").alias("line"))
    return types.union(s.select("file_id", F.explode("methods").alias("m")).select("file_id", F.lit("method"), "m.name", "m.line"))


def _pattern(make, query: str, **params):
    return lambda spark, d: compile_query(make(spark, d), query, params)


_AUTHORS = "MATCH (a:Author)-[:AUTHORED]->(:Commit)-[:CHANGED]->(f:File) RETURN a.name AS name, count(DISTINCT f) AS files ORDER BY files DESC, name LIMIT 20"
_CHURN = "MATCH (:Commit)-[ch:CHANGED]->(f:File) RETURN f.repo AS repo, f.path AS path, sum(ch.insertions + ch.deletions) AS churn, sum(ch.insertions) AS inserted, sum(ch.deletions) AS deleted, count(*) AS commits ORDER BY churn DESC, repo, path LIMIT 20"
_HOTSPOTS = "MATCH (t:Table)<-[:REFERENCES]-(other:Table) RETURN t.database AS database, t.schema AS schema, t.name AS table, count(DISTINCT other) AS incoming_tables, collect(DISTINCT other.name)[0..10] AS referenced_by ORDER BY incoming_tables DESC, database, schema, table LIMIT 20"
_UNUSED = "MATCH (t:Table) OPTIONAL MATCH (t)<-[:REFERENCES]-(o:Table) WITH t, count(o) AS n WHERE n = 0 RETURN t.database AS database, t.name AS table"


def _shop(op, **kw):
    return lambda s, d: op(shop_history(s, d), **kw)


_FIRST_BRAND = "(SELECT min(p_brand) FROM part)"
QUERIES = {
    "top_authors_by_files": _shop(recipes.top_authors), "highest_churn_files": _shop(recipes.churn), "churn_with_authors": _shop(recipes.churn, authors=True), "recent_churn": _shop(recipes.churn, since="1998-01-01"),
    "repo_top_authors": lambda s, d: recipes.top_authors(shop_history(s, d), 20, read_table(s, d, "part").agg(F.min("p_brand")).first()[0] or ""),
    "dir_owners": lambda s, d: recipes.owners_of_directory(shop_history(s, d), (read_table(s, d, "part").agg(F.min("p_type")).first()[0] or "") + "/"),
    "upsert_last_wins": upsert_last_wins, "incremental_upsert": incremental_upsert, "edge_endpoint_filter": edge_endpoint_filter, "replace_repo": replace_repo, "replace_database": replace_database, "dry_run_counts": dry_run_counts,
    "classify_line": classify_line, "next_line_pairs": next_line_pairs, "line_explode": line_explode, "content_hash": content_hash, "file_type": file_type, "module_longest_prefix": module_longest_prefix, "strip_url_credentials": strip_url_credentials, "table_profile": table_profile,
    "parsed_structure": parsed_structure, "pattern_top_authors": _pattern(shop_history, _AUTHORS), "pattern_churn": _pattern(shop_history, _CHURN), "pattern_fk_hotspots": _pattern(catalog, _HOTSPOTS), "pattern_unreferenced_tables": _pattern(catalog, _UNUSED),
}
_FOLD = "SELECT id, message, insertions, authored_at FROM (SELECT repo || '@' || commit_hash AS id, *, row_number() OVER (PARTITION BY repo, commit_hash ORDER BY recorded_at DESC NULLS LAST, message DESC NULLS LAST, insertions DESC NULLS LAST, authored_at DESC NULLS LAST) AS rn FROM commits WHERE repo IS NOT NULL AND commit_hash IS NOT NULL) WHERE rn = 1"
SQL = {
    "top_authors_by_files": f"{_SHOP} SELECT name, count(DISTINCT dst) AS files FROM ch JOIN au ON au.k = ch.src JOIN fl ON fl.id = ch.dst GROUP BY a, name ORDER BY files DESC, name LIMIT 20",
    "highest_churn_files": f"{_SHOP} SELECT repo, path, CAST(sum(ins + del) AS BIGINT) AS churn, CAST(sum(ins) AS BIGINT) AS inserted, CAST(sum(del) AS BIGINT) AS deleted, count(*) AS commits FROM ch JOIN fl ON fl.id = ch.dst GROUP BY repo, path ORDER BY churn DESC, repo, path LIMIT 20",
    "churn_with_authors": f"{_SHOP} SELECT repo, path, CAST(sum(ins + del) AS BIGINT) AS churn, CAST(sum(ins) AS BIGINT) AS inserted, CAST(sum(del) AS BIGINT) AS deleted, count(*) AS commits, count(DISTINCT a) AS authors FROM ch JOIN fl ON fl.id = ch.dst LEFT JOIN au ON au.k = ch.src GROUP BY repo, path ORDER BY churn DESC, repo, path LIMIT 20",
    "recent_churn": f"{_SHOP} SELECT repo, path, CAST(sum(ins + del) AS BIGINT) AS churn, CAST(sum(ins) AS BIGINT) AS inserted, CAST(sum(del) AS BIGINT) AS deleted, count(*) AS commits FROM ch JOIN fl ON fl.id = ch.dst JOIN orders o ON o.o_orderkey = ch.src WHERE strftime(o.o_orderdate, '%Y-%m-%dT%H:%M:%S') >= '1998-01-01' GROUP BY repo, path ORDER BY churn DESC, repo, path LIMIT 20",
    "repo_top_authors": f"{_SHOP} SELECT name, count(DISTINCT dst) AS files FROM ch JOIN au ON au.k = ch.src JOIN fl ON fl.id = ch.dst WHERE repo = {_FIRST_BRAND} GROUP BY a, name ORDER BY files DESC, name LIMIT 20",
    "dir_owners": f"{_SHOP} SELECT name, count(DISTINCT dst) AS files, max(day) AS last_touch FROM ch JOIN au ON au.k = ch.src JOIN fl ON fl.id = ch.dst WHERE starts_with(path, (SELECT min(p_type) FROM part) || '/') GROUP BY a, name",
    "upsert_last_wins": _FOLD, "incremental_upsert": _FOLD,
    "edge_endpoint_filter": f"WITH {_CATALOG}, tn AS (SELECT DISTINCT database || '/' || name AS id FROM tables) SELECT database_name || '/' || from_table AS src, database_name || '/' || to_table AS dst, fk_id FROM foreign_keys WHERE database_name || '/' || from_table IN (SELECT id FROM tn) AND database_name || '/' || to_table IN (SELECT id FROM tn)",
    "replace_repo": f"{_CODE}, gone AS (SELECT id FROM f WHERE repo = 'atlas-core' UNION SELECT id FROM cls WHERE repo = 'atlas-core') SELECT src, dst FROM contains WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)",
    "replace_database": f"WITH {_CATALOG} SELECT DISTINCT tid AS id, table_name AS name FROM live WHERE did <> (SELECT min(did) FROM base)",
    "dry_run_counts": f"{_CODE} SELECT 'node Repository' AS kind, (SELECT count(DISTINCT repo) FROM repositories) AS n UNION ALL SELECT 'node File', (SELECT count(*) FROM f) UNION ALL SELECT 'node Class', (SELECT count(*) FROM cls) UNION ALL SELECT 'node Method', (SELECT count(*) FROM method) UNION ALL SELECT 'rel CONTAINS_FILE', (SELECT count(*) FROM f) UNION ALL SELECT 'rel CONTAINS_CLASS', (SELECT count(*) FROM contains) UNION ALL SELECT 'rel IMPORTS', (SELECT count(*) FROM imports) UNION ALL SELECT 'rel HAS_METHOD', (SELECT count(*) FROM has_method)",
    # the feed's own line types say code for comments of style sheets
    "classify_line": "SELECT file_id, l.line_no AS line_no, CASE WHEN file_extension = '.css' AND starts_with(trim(l.line_text), '/*') THEN 'comment' ELSE l.line_type END AS kind FROM (SELECT file_id, file_extension, unnest(code_lines) AS l FROM scanned_files)",
    "next_line_pairs": "SELECT * FROM (SELECT file_id, l.line_no AS src, lead(l.line_no) OVER (PARTITION BY file_id ORDER BY l.line_no) AS dst FROM (SELECT file_id, unnest(code_lines) AS l FROM scanned_files)) WHERE dst IS NOT NULL",
    "line_explode": "SELECT doc_id, CAST(i AS INTEGER) AS number, md5(parts[i]) AS line_md5 FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))",
    "content_hash": "SELECT file_id, content_hash AS hash FROM scanned_files", "file_type": "SELECT file_id, file_type AS type FROM scanned_files",
    "module_longest_prefix": "SELECT s.file_id, m.root FROM scanned_files s LEFT JOIN (SELECT s2.file_id, arg_max(m.root, length(m.root)) AS root FROM scanned_files s2 JOIN (SELECT DISTINCT repo, module_key AS root FROM scanned_files WHERE module_key <> '') m ON m.repo = s2.repo AND starts_with(s2.relpath, m.root || '/') GROUP BY s2.file_id) m ON m.file_id = s.file_id",
    "strip_url_credentials": f"SELECT repo_id, {_CLEAN} AS url FROM repositories",
    "table_profile": _profile_sql(),
}
SQL |= {
    "pattern_top_authors": SQL["top_authors_by_files"], "pattern_churn": SQL["highest_churn_files"], "pattern_fk_hotspots": GRAPH_SQL["fk_hotspots"],
    "pattern_unreferenced_tables": f'WITH {_CATALOG} SELECT database, name AS "table" FROM tables WHERE id NOT IN (SELECT dst FROM refs)',
}
