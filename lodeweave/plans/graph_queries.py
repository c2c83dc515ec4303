"""Queries over the metadata graph of the code, history and catalog tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions.text import SEPARATORS
from lodeweave.operators import impact, link, recipes, search
from lodeweave.operators.graph import Graph, catalog_graph, code_graph, history_graph, merged
from lodeweave.plans.data_quality import _ident
from lodeweave.runtime import read_table, written

COLUMN, TEXT, FIND = "street_address", "item", "status"
CUTOFF = "2023-03-01"


def _as_is(df: DataFrame) -> DataFrame:
    return df


def catalog(spark: SparkSession, d: str, keep: Callable[[DataFrame], DataFrame] = _as_is) -> Graph:
    procs = read_table(spark, d, "stored_procedures").withColumn("seq", F.col("procedure_id"))
    views = read_table(spark, d, "vds_rows").select("database_name", F.concat_ws("_", "servicename", "vds_id").alias("view_name"), F.col("query_text").alias("definition"), F.col("vds_id").alias("seq"))
    columns = read_table(spark, d, "catalog_columns")
    return catalog_graph(columns, read_table(spark, d, "foreign_keys"), procs, views, indexes_of(columns), keep=keep)


def indexes_of(columns: DataFrame) -> DataFrame:
    """The indexes that the keys of live columns tell of: the primary key of a table, and one index for every other key column."""
    live = columns.where("dropped_at is null and column_key in ('PRI', 'UNI', 'MUL')").select("db_engine", "database_name", "schema_name", "table_name", "column_name", "ordinal_no", "column_key").distinct()
    name = F.when(F.col("column_key") == "PRI", "PRIMARY").otherwise(F.concat(F.lit("ix_"), "column_name"))
    of = live.groupBy("db_engine", "database_name", "schema_name", "table_name", name.alias("index_name")).agg(F.array_sort(F.collect_set(F.struct(F.coalesce("ordinal_no", F.lit(0)), "column_name"))).alias("c"), F.max(F.col("column_key") != "MUL").alias("is_unique"))
    return of.select("*", F.array_distinct(F.transform("c", lambda x: x["column_name"])).alias("columns"), F.lit("BTREE").alias("index_type")).drop("c")


def code(spark: SparkSession, d: str, keep: Callable[[DataFrame], DataFrame] = _as_is) -> Graph:
    return code_graph(read_table(spark, d, "repositories"), read_table(spark, d, "scanned_files"), read_table(spark, d, "classes"), keep)


def both(spark: SparkSession, d: str, keep: Callable[[DataFrame], DataFrame] = _as_is) -> Graph:
    return merged(code(spark, d, keep), catalog(spark, d, keep))


def linked(spark: SparkSession, d: str, keep: Callable[[DataFrame], DataFrame] = _as_is) -> Graph:
    g = both(spark, d, keep)
    # The test classes name no table but themselves, so the declared name of a record class stands in.
    named = g.nodes["Class"].withColumn("mapped_table", F.coalesce("mapped_table", "name"))
    for name, rel in zip(link.PASSES, ("MAPS_TO", "BASED_ON", "USES_TABLE", "CROSS_DB_REFERENCE")):
        g.rels[rel] = link.run([name], named, g.nodes["View"], g.nodes["StoredProcedure"], g.nodes["Table"])[name]
    return g


# -- SQL fragments -----------------------------------------------------------
_FILES = """f AS (SELECT repo || '/' || relpath AS id, * FROM (SELECT *, row_number() OVER (PARTITION BY repo, relpath ORDER BY scanned_at DESC NULLS LAST, file_id DESC) AS rn FROM scanned_files WHERE repo IS NOT NULL AND relpath IS NOT NULL) WHERE rn = 1),
inside AS (SELECT id, repo, sp || '.' || c.class_name AS fqn, c.class_name AS name, c.line_no AS line_no FROM (SELECT id, repo, coalesce(nullif(structure.package, ''), replace(regexp_replace(relpath, '\\.[^./]*$', ''), '/', '.')) AS sp, unnest(structure.classes) AS c FROM f)),
imp AS (SELECT id, repo, i.fqn AS fqn FROM (SELECT id, repo, unnest(structure.imports) AS i FROM f) WHERE i.fqn IS NOT NULL),
cls AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, tie DESC, line_no DESC NULLS LAST) AS rn FROM (
  SELECT repo || '/' || fqn AS id, name, fqn, repo, NULL AS stereotype, NULL AS mapped_table, line_no, false AS external, 0 AS seq, 0 AS tie FROM inside
  UNION ALL SELECT repo || '/' || fqn, class_name, fqn, repo, nullif(stereotype, ''), mapped_table, line_no, false, 1, class_id FROM classes WHERE repo IS NOT NULL AND fqn IS NOT NULL
  UNION ALL SELECT DISTINCT 'ext/' || fqn, string_split(fqn, '.')[-1], fqn, NULL, NULL, NULL, NULL, true, 0, 0 FROM imp)) WHERE rn = 1),
contains AS (SELECT DISTINCT id AS src, repo || '/' || fqn AS dst FROM inside),
imports AS (SELECT DISTINCT i.repo || '/' || i.fqn AS src, 'ext/' || m.fqn AS dst FROM inside i JOIN imp m ON i.id = m.id),
mm AS (SELECT repo, fqn, class_id, unnest(methods) AS m FROM classes WHERE repo IS NOT NULL AND fqn IS NOT NULL),
method AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY class_id DESC, line_no DESC NULLS LAST) AS rn FROM (SELECT repo || '/' || fqn || '#' || m.method_name AS id, m.method_name AS name, fqn AS owner, repo, class_id, m.line_no AS line_no FROM mm) WHERE id IS NOT NULL) WHERE rn = 1),
has_method AS (SELECT DISTINCT repo || '/' || fqn AS src, repo || '/' || fqn || '#' || m.method_name AS dst FROM mm WHERE m.method_name IS NOT NULL)"""
_CATALOG = f"""eng AS (SELECT database_name AS dn, min(coalesce(db_engine, '') || '://' || '' || '/' || database_name) AS did FROM catalog_columns WHERE database_name IS NOT NULL AND table_name IS NOT NULL AND column_name IS NOT NULL GROUP BY 1),
base AS (SELECT * FROM (SELECT *, coalesce(db_engine, '') || ':///' || database_name AS did, did || '/' || coalesce(schema_name, '') AS schema_id, did || '/' || coalesce(schema_name, '') || '/' || table_name AS tid,
    did || '/' || coalesce(schema_name, '') || '/' || table_name || '#' || column_name AS id, row_number() OVER (PARTITION BY db_engine, database_name, schema_name, table_name, column_name ORDER BY column_id) AS rn
  FROM catalog_columns WHERE dropped_at IS NULL AND database_name IS NOT NULL AND table_name IS NOT NULL AND column_name IS NOT NULL) WHERE rn = 1),
ends AS (SELECT did AS db, {_ident("table_name")} AS t, {_ident("column_name")} AS c, * FROM base),
fkx AS (SELECT coalesce(eng.did, ':///' || database_name) AS db, {_ident("from_table")} AS ft, {_ident("from_column")} AS fc, {_ident("to_table")} AS tt, {_ident("to_column")} AS tc, constraint_name FROM foreign_keys LEFT JOIN eng ON eng.dn = database_name),
fkany AS (SELECT a.id AS src, a.tid AS st, a.db_engine, a.database_name, a.schema_name, a.schema_id, a.db, k.tt, k.tc, b.id AS hit, b.tid AS hit_table,
    a.schema_id || '/' || coalesce((SELECT min(e.table_name) FROM ends e WHERE e.db = a.db AND e.schema_id = a.schema_id AND e.t = k.tt), k.tt) AS own
  FROM fkx k JOIN ends a ON k.db = a.db AND k.ft = a.t AND k.fc = a.c LEFT JOIN ends b ON k.db = b.db AND k.tt = b.t AND k.tc = b.c WHERE k.tt IS NOT NULL AND k.tc IS NOT NULL),
fkall AS (SELECT src, coalesce(hit, own || '#' || tc) AS dst, st, coalesce(hit_table, own) AS dt FROM fkany),
stub AS (SELECT DISTINCT db_engine, database_name, schema_name, schema_id, db, own AS tid, substr(own, length(schema_id) + 2) AS table_name, tc AS column_name, own || '#' || tc AS id FROM fkany WHERE hit IS NULL),
live AS (SELECT database_name, schema_name, schema_id, did, tid, table_name, column_name, id, ordinal_no, data_type, is_nullable FROM base UNION ALL SELECT database_name, schema_name, schema_id, db, tid, table_name, column_name, id, NULL, NULL, NULL FROM stub),
tables AS (SELECT DISTINCT tid AS id, table_name AS name, schema_name AS schema, database_name AS database FROM live),
proc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM (SELECT coalesce(eng.did, ':///' || database_name) || '/' || coalesce(schema_name, '') || '/proc/' || procedure_name AS id, procedure_name AS name, database_name AS database, definition, parameters, procedure_id AS seq FROM stored_procedures LEFT JOIN eng ON eng.dn = database_name WHERE database_name IS NOT NULL AND procedure_name IS NOT NULL)) WHERE rn = 1),
view AS (SELECT coalesce(eng.did, ':///' || database_name) || '//view/' || concat_ws('_', servicename, vds_id) AS id, concat_ws('_', servicename, vds_id) AS name, database_name AS database, query_text AS definition FROM vds_rows LEFT JOIN eng ON eng.dn = database_name WHERE database_name IS NOT NULL),
ix AS (SELECT did || '/' || coalesce(schema_name, '') || '/' || table_name AS tid, tid || '!' || iname AS id, iname AS name, table_name, database_name, max(column_key) <> 'MUL' AS is_unique, list(column_name ORDER BY o, column_name) AS columns
  FROM (SELECT *, coalesce(db_engine, '') || ':///' || database_name AS did, CASE WHEN column_key = 'PRI' THEN 'PRIMARY' ELSE 'ix_' || column_name END AS iname FROM (SELECT db_engine, database_name, schema_name, table_name, column_name, column_key, min(coalesce(ordinal_no, 0)) AS o FROM catalog_columns WHERE dropped_at IS NULL AND column_key IN ('PRI', 'UNI', 'MUL') GROUP BY ALL)) GROUP BY did, schema_name, table_name, database_name, iname),
fk AS (SELECT DISTINCT src, dst FROM fkall), refs AS (SELECT DISTINCT st AS src, dt AS dst FROM fkall)"""


def _text(s: str) -> str:
    """A SQL expression for a text with quotes and control characters."""
    return "('" + s.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '").replace("\t", "' || chr(9) || '") + "')"


_SEPS = _text(SEPARATORS)


def _tok(c: str) -> str:
    return f"(' ' || translate(lower({c}), {_SEPS}, '{' ' * len(SEPARATORS)}') || ' ')"


_BARE = f"translate(lower(t.name), {_text(SEPARATORS.replace(" ", ""))}, '') = lower(t.name)"


def _contain(x: str, op: str) -> str:
    return f"SELECT DISTINCT d.id AS src, t.id AS dst FROM {x} d JOIN tables t ON d.database {op} t.database AND length(t.name) >= 4 AND {_BARE} AND contains({_tok('d.definition')}, ' ' || lower(t.name) || ' ')"


_LINKS = f"""maps_to AS (SELECT DISTINCT c.id AS src, t.id AS dst FROM cls c JOIN tables t ON lower(coalesce(c.mapped_table, c.name)) = lower(t.name) WHERE coalesce(c.mapped_table, c.name) <> ''),
based_on AS ({_contain("view", "=")}), uses_table AS ({_contain("proc", "=")})"""
_CODE, _CAT = f"WITH {_FILES}", f"WITH {_CATALOG}"
_ALL = f"WITH {_FILES}, {_CATALOG}, {_LINKS}"
_COMMITS = """k AS (SELECT repo || '@' || commit_hash AS id, * FROM (SELECT *, row_number() OVER (PARTITION BY repo, commit_hash ORDER BY recorded_at DESC NULLS LAST, message DESC NULLS LAST, authored_at DESC NULLS LAST) AS rn FROM commits WHERE repo IS NOT NULL AND commit_hash IS NOT NULL) WHERE rn = 1)"""
_UNION_NODES = """nodes AS (SELECT 'File' AS label, id, file_name AS name, relpath AS path, NULL AS fqn, repo, NULL AS definition, NULL AS owner FROM f UNION ALL SELECT 'Class', id, name, NULL, fqn, repo, NULL, NULL FROM cls UNION ALL SELECT 'Method', id, name, NULL, NULL, repo, NULL, owner FROM method
UNION ALL SELECT 'Table', id, name, NULL, NULL, NULL, NULL, NULL FROM tables UNION ALL SELECT 'Column', id, column_name, NULL, NULL, NULL, NULL, NULL FROM live UNION ALL SELECT 'StoredProcedure', id, name, NULL, NULL, NULL, definition, NULL FROM proc)"""
_CODE_HIT = f"(label IN ('File', 'Class', 'Method') AND (contains(lower(name), '{TEXT}') OR contains(lower(fqn), '{TEXT}') OR contains(lower(path), '{TEXT}')))"
_SCHEMA_HIT = f"(label IN ('Table', 'Column', 'StoredProcedure') AND (contains(lower(name), '{TEXT}') OR contains(lower(definition), '{TEXT}')))"
_REF = "SELECT label, id, name, coalesce(fqn, path, nullif(owner, ''), id) AS ref FROM nodes WHERE"
_NODES = f"WITH {_FILES}, {_CATALOG}, {_UNION_NODES}"


def _impact_sql(col: str, fk: str, body: str, index: str) -> str:
    return f"""{_LINKED} SELECT 'column' AS bucket, database_name AS database, table_name AS "table", column_name AS name, data_type AS detail FROM live WHERE {col}
UNION ALL SELECT 'foreign_key', a.database_name, a.table_name, a.column_name, b.table_name || '.' || b.column_name FROM fk JOIN live a ON a.id = fk.src JOIN live b ON b.id = fk.dst WHERE {fk}
UNION ALL SELECT 'index', database_name, table_name, name, array_to_string(columns, ',') FROM ix WHERE tid IN (SELECT tid FROM base) AND ({index})
UNION ALL SELECT 'procedure', database, NULL, name, 'definition' FROM proc WHERE {body} UNION ALL SELECT 'view', database, NULL, name, 'definition' FROM view WHERE {body}"""


def _g(make, op, *a, **kw):
    return lambda spark, d: op(make(spark, d), *a, **kw)


def kept(make):
    """The graph with what its frames share written once, for queries that join many of them."""
    return lambda spark, d: make(spark, d, written)


def _degree(spark: SparkSession, d: str) -> DataFrame:
    return search.degrees(merged(code(spark, d), catalog(spark, d)), "CONTAINS_CLASS", "IMPORTS", "REFERENCES")


def _neighbors(spark: SparkSession, d: str) -> DataFrame:
    return search.neighbors(code(spark, d), "ext/java.util.List")


def _by_name(op, keep=_as_is):
    """An operator on the links of one table: the least name that a view or procedure uses, so that the query means the same on any data."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        g = linked(spark, d, keep)
        for rel in ("USES_TABLE", "BASED_ON"):  # read for the name and again for the result
            g.rels[rel] = keep(g.rels[rel])
        used = g.rels["USES_TABLE"].union(g.rels["BASED_ON"]).select(F.col("dst").alias("id")).distinct()
        return op(g, g.nodes["Table"].join(used, "id", "left_semi").agg(F.min(F.lower("name"))).first()[0] or "")

    return run


def _links(rel: str):
    return lambda spark, d: linked(spark, d).rels[rel]


def _page_totals(spark: SparkSession, d: str) -> DataFrame:
    g = catalog(spark, d)
    return search.page(search.find_table(g, FIND), 25, 5)


def _blast(spark: SparkSession, d: str) -> DataFrame:
    g = code(spark, d)
    path = g.nodes["File"].where("type = 'java'").agg(F.min("id")).first()[0] or ""
    return impact.blast_radius(g, path)


# told by where things stand, not by the pattern of the operator
_AFTER = "substr(url, strpos(url, '://') + 3)"
_AUTH = f"string_split({_AFTER}, '/')[1]"
_CLEAN = f"""CASE WHEN NOT contains(url, '://') THEN CASE WHEN contains(string_split(url, '@')[1], ':') AND contains(url, '@') THEN string_split(url, ':')[1] || substr(url, strpos(url, '@')) ELSE url END WHEN NOT contains({_AUTH}, '@') THEN url
 WHEN starts_with(url, 'ssh') THEN split_part(url, '://', 1) || '://' || string_split(string_split({_AUTH}, '@')[1], ':')[1] || '@' || string_split({_AUTH}, '@')[-1] || substr({_AFTER}, length({_AUTH}) + 1)
 ELSE split_part(url, '://', 1) || '://' || string_split({_AUTH}, '@')[-1] || substr({_AFTER}, length({_AUTH}) + 1) END"""
_ONE = "(SELECT min(lower(name)) FROM tables WHERE id IN (SELECT dst FROM uses_table UNION SELECT dst FROM based_on))"
_LINKED = f"{_CAT}, based_on AS ({_contain('view', '=')}), uses_table AS ({_contain('proc', '=')})"
_BLAST_FILE = "(SELECT min(id) FROM f WHERE file_type = 'java')"
QUERIES = {
    "label_counts": _g(lambda s, d: merged(code(s, d), catalog(s, d)), search.label_counts),
    "rel_counts": _g(kept(both), search.rel_counts, "CONTAINS_FILE", "CONTAINS_CLASS", "IMPORTS", "HAS_METHOD", "HAS_TABLE", "HAS_COLUMN", "FOREIGN_KEY", "REFERENCES"),
    "search_nodes": lambda s, d: search.search_nodes(code(s, d), "File", "path", "web/").select("id", "path", "repo"),
    "search_code": _g(code, search.search_codebase, TEXT, "code"), "search_schema": _g(catalog, search.search_codebase, TEXT, "schema"),
    "search_all": _g(lambda s, d: merged(code(s, d), catalog(s, d)), search.search_codebase, TEXT), "search_repo": _g(lambda s, d: merged(code(s, d), catalog(s, d)), search.search_codebase, TEXT, "all", "atlas-core"),
    "find_table": _g(catalog, search.find_table, FIND), "find_table_page": _page_totals, "find_procedure": _g(catalog, search.find_procedure, FIND), "node_neighbors": _neighbors, "degree": _degree,
    "search_any": lambda s, d: search.search_any(merged(code(s, d), catalog(s, d)), FIND), "label_sample": lambda s, d: search.label_sample(catalog(s, d), "Schema", 25), "database_table_counts": _g(catalog, search.database_table_counts),
    "graph_sample": lambda s, d: search.sample(code(s, d), 120, "CONTAINS_CLASS", "IMPORTS")[0],
    "repository_status": lambda s, d: code(s, d).nodes["Repository"].select("name", "url", "default_branch", "status", "commits", "last_commit", "last_ingested_at"),
    "fk_hotspots": _g(catalog, recipes.fk_hotspots), "fk_hotspot_columns": _g(catalog, recipes.fk_hotspot_columns), "orphan_tables": _g(kept(linked), recipes.orphan_tables), "entity_table_map": _g(linked, recipes.entity_table_map),
    "tables_without_entity": _g(linked, recipes.tables_without_entity), "entities_without_table": _g(linked, recipes.entities_without_table), "who_touches_table": _by_name(recipes.who_touches_table, written), "columns_of_table": _by_name(recipes.columns_of_table),
    "column_blast_radius": _g(kept(linked), impact.column_blast_radius, COLUMN), "impact_of_column": _g(catalog, impact.impact_of_column, COLUMN), "impact_of_table": _by_name(impact.impact_of_table), "explain_impact": _by_name(impact.explain_impact, written),
    "link_maps_to": _links("MAPS_TO"), "link_based_on": _links("BASED_ON"), "link_uses_table": _links("USES_TABLE"), "link_cross_db": _links("CROSS_DB_REFERENCE"),
    "blast_radius_file": _blast,
    "authors_of_commits": lambda s, d: history_graph(read_table(s, d, "commits")).rels["AUTHORED"].groupBy("src").agg(F.count("*").alias("commits")).withColumnRenamed("src", "author"),
    "commit_parents": lambda s, d: history_graph(read_table(s, d, "commits")).rels["PARENT"],
}
SQL = {
    "label_counts": f"WITH {_FILES}, {_CATALOG} SELECT 'Repository' AS label, (SELECT count(DISTINCT repo) FROM repositories) AS n UNION ALL SELECT 'File', (SELECT count(*) FROM f) UNION ALL SELECT 'Class', (SELECT count(*) FROM cls) UNION ALL SELECT 'Method', (SELECT count(*) FROM method) UNION ALL SELECT 'Database', (SELECT count(DISTINCT did) FROM live) UNION ALL SELECT 'Schema', (SELECT count(DISTINCT schema_id) FROM live) UNION ALL SELECT 'Table', (SELECT count(*) FROM tables) UNION ALL SELECT 'Column', (SELECT count(*) FROM live) UNION ALL SELECT 'StoredProcedure', (SELECT count(*) FROM proc) UNION ALL SELECT 'View', (SELECT count(*) FROM view) UNION ALL SELECT 'Index', (SELECT count(*) FROM ix)",
    "rel_counts": f"WITH {_FILES}, {_CATALOG} SELECT 'CONTAINS_FILE' AS type, (SELECT count(*) FROM f) AS n UNION ALL SELECT 'CONTAINS_CLASS', (SELECT count(*) FROM contains) UNION ALL SELECT 'IMPORTS', (SELECT count(*) FROM imports) UNION ALL SELECT 'HAS_METHOD', (SELECT count(*) FROM has_method) UNION ALL SELECT 'HAS_TABLE', (SELECT count(DISTINCT tid) FROM base) UNION ALL SELECT 'HAS_COLUMN', (SELECT count(*) FROM base) UNION ALL SELECT 'FOREIGN_KEY', (SELECT count(*) FROM fk) UNION ALL SELECT 'REFERENCES', (SELECT count(*) FROM refs)",
    "search_nodes": f"{_CODE} SELECT id, relpath AS path, repo FROM f WHERE contains(relpath, 'web/')",
    "search_code": f"{_NODES} {_REF} {_CODE_HIT}", "search_schema": f"{_NODES} {_REF} {_SCHEMA_HIT}", "search_all": f"{_NODES} {_REF} ({_CODE_HIT} OR {_SCHEMA_HIT})", "search_repo": f"{_NODES} {_REF} ({_CODE_HIT} OR {_SCHEMA_HIT}) AND repo = 'atlas-core'",
    "find_table": f"{_NODES} SELECT label, id, name FROM nodes WHERE label IN ('Table', 'Column') AND contains(name, '{FIND}')",
    "find_table_page": f"{_NODES} SELECT label, id, name FROM nodes WHERE label IN ('Table', 'Column') AND contains(name, '{FIND}') ORDER BY id, label LIMIT 25 OFFSET 5",
    "find_procedure": f"{_CAT} SELECT id, name, database FROM proc WHERE contains(name, '{FIND}') OR contains(definition, '{FIND}')",
    "node_neighbors": f"{_CODE} SELECT 'IMPORTS' AS rel, src AS from_id, 'Class' AS neighbor_label, src AS neighbor_id FROM imports WHERE dst = 'ext/java.util.List'",
    "degree": f"WITH {_FILES}, {_CATALOG} SELECT label, id, count(*) AS degree FROM (SELECT 'File' AS label, src AS id FROM contains UNION ALL SELECT 'Class', dst FROM contains UNION ALL SELECT 'Class', src FROM imports UNION ALL SELECT 'Class', dst FROM imports UNION ALL SELECT 'Table', src FROM refs UNION ALL SELECT 'Table', dst FROM refs) GROUP BY ALL",
    "search_any": f"""WITH {_FILES}, {_CATALOG} SELECT label, id, name FROM (SELECT 'Repository' AS label, repo AS id, repo AS name, min_by(root_path, -repo_id) AS path FROM repositories WHERE repo IS NOT NULL GROUP BY repo UNION ALL SELECT 'File', id, file_name, relpath FROM f UNION ALL SELECT 'Class', id, name, NULL FROM cls UNION ALL SELECT 'Method', id, name, NULL FROM method
UNION ALL SELECT DISTINCT 'Database', did, database_name, NULL FROM base UNION ALL SELECT DISTINCT 'Schema', schema_id, schema_name, NULL FROM base UNION ALL SELECT 'Table', id, name, NULL FROM tables UNION ALL SELECT 'Column', id, column_name, NULL FROM live UNION ALL SELECT 'Index', id, name, NULL FROM ix WHERE tid IN (SELECT tid FROM base) UNION ALL SELECT 'StoredProcedure', id, name, NULL FROM proc UNION ALL SELECT 'View', id, name, NULL FROM view)
WHERE contains(name, '{FIND}') OR contains(id, '{FIND}') OR contains(path, '{FIND}')""",
    "label_sample": f"""{_CAT} SELECT DISTINCT schema_id AS id, '{{"name":"' || schema_name || '","database":"' || database_name || '"}}' AS properties FROM base ORDER BY id LIMIT 25""",
    "explain_impact": f"""{_ALL}, t1 AS (SELECT * FROM tables WHERE lower(name) = {_ONE}), own AS (SELECT 'column' AS bucket, database_name AS database, table_name AS "table", column_name AS name, data_type AS detail FROM live WHERE lower(table_name) = {_ONE}
 UNION ALL SELECT 'foreign_key', a.database_name, a.table_name, a.column_name, b.table_name || '.' || b.column_name FROM fk JOIN live a ON a.id = fk.src JOIN live b ON b.id = fk.dst WHERE lower(a.table_name) = {_ONE} OR lower(b.table_name) = {_ONE}
 UNION ALL SELECT 'index', database_name, table_name, name, array_to_string(columns, ',') FROM ix WHERE tid IN (SELECT tid FROM base) AND lower(table_name) = {_ONE}),
hit AS (SELECT id, name FROM tables WHERE lower(name) IN (SELECT lower("table") FROM own UNION SELECT lower(name) FROM t1)),
ev AS (SELECT 'procedure' AS bucket, database, name, 'definition' AS via FROM proc WHERE contains(lower(definition), {_ONE}) UNION SELECT 'view', database, name, 'definition' FROM view WHERE contains(lower(definition), {_ONE})
 UNION SELECT 'procedure', p.database, p.name, 'link' FROM uses_table u JOIN hit ON hit.id = u.dst JOIN proc p ON p.id = u.src UNION SELECT 'view', v.database, v.name, 'link' FROM based_on b JOIN hit ON hit.id = b.dst JOIN view v ON v.id = b.src)
SELECT bucket, database, "table", name, detail, 'definition' AS via, 'direct' AS severity FROM own UNION ALL SELECT bucket, database, NULL, name, NULL, string_agg(via, ',' ORDER BY via), 'transitive' FROM ev GROUP BY bucket, database, name
UNION ALL SELECT DISTINCT 'entity', c.repo, hit.name, c.fqn, NULL, 'MAPS_TO', 'direct' FROM maps_to m JOIN hit ON hit.id = m.dst JOIN cls c ON c.id = m.src""",
    "database_table_counts": f"{_CAT} SELECT database_name AS database, count(DISTINCT tid) AS tables FROM base GROUP BY did, database_name",
    "graph_sample": f"""{_CODE}, links AS (SELECT * FROM (SELECT 'CONTAINS_CLASS' AS type, 'File' AS sl, src, dst FROM contains UNION ALL SELECT 'IMPORTS', 'Class', src, dst FROM imports) ORDER BY type, src, dst LIMIT 120),
deg AS (SELECT label, id, count(*) AS degree FROM (SELECT sl AS label, src AS id FROM links UNION ALL SELECT 'Class', dst FROM links) GROUP BY ALL), n AS (SELECT 'File' AS label, id, file_name AS name FROM f UNION ALL SELECT 'Class', id, name FROM cls)
SELECT d.label, d.id, coalesce(nullif(n.name, ''), nullif(regexp_extract(d.id, '[^#/\\\\:]+$'), ''), d.id) AS caption, d.degree FROM deg d JOIN n ON n.label = d.label AND n.id = d.id""",
    "repository_status": f"SELECT repo AS name, {_CLEAN} AS url, default_branch, ingest_status AS status, n_commits AS commits, nullif(last_commit, '') AS last_commit, last_ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY repo_id DESC) AS rn FROM repositories WHERE repo IS NOT NULL) WHERE rn = 1",
    "fk_hotspots": f"""{_CAT} SELECT t.database, t.schema, t.name AS "table", count(DISTINCT r.src) AS incoming_tables, list_sort(list(DISTINCT o.name))[1:10] AS referenced_by FROM refs r JOIN tables t ON t.id = r.dst JOIN tables o ON o.id = r.src GROUP BY ALL ORDER BY incoming_tables DESC, t.database, t.schema, t.name LIMIT 20""",
    "fk_hotspot_columns": f"""{_CAT} SELECT l.database_name AS database, l.table_name AS "table", l.column_name AS "column", count(*) AS incoming FROM fk JOIN live l ON l.id = fk.dst GROUP BY l.id, ALL""".replace("GROUP BY l.id, ALL", "GROUP BY l.id, l.database_name, l.table_name, l.column_name"),
    "orphan_tables": f"""{_ALL} SELECT database, name AS "table" FROM tables t WHERE NOT EXISTS (SELECT 1 FROM refs WHERE src = t.id OR dst = t.id) AND NOT EXISTS (SELECT 1 FROM maps_to WHERE dst = t.id)""",
    "entity_table_map": f"""{_ALL} SELECT c.fqn AS entity, f.relpath AS path, t.database, t.name AS "table" FROM maps_to m JOIN cls c ON c.id = m.src JOIN tables t ON t.id = m.dst LEFT JOIN (SELECT contains.dst, f.relpath FROM contains JOIN f ON f.id = contains.src) f ON f.dst = m.src""",
    "tables_without_entity": f"""{_ALL} SELECT database, name AS "table" FROM tables t WHERE NOT EXISTS (SELECT 1 FROM maps_to WHERE dst = t.id)""",
    "entities_without_table": f"{_ALL} SELECT repo, fqn AS entity FROM cls c WHERE stereotype = 'Entity' AND NOT EXISTS (SELECT 1 FROM maps_to WHERE src = c.id)",
    "who_touches_table": f"{_ALL}, one AS (SELECT * FROM tables WHERE lower(name) = {_ONE}) SELECT DISTINCT 'class' AS kind, c.fqn AS name, o.database FROM maps_to m JOIN one o ON o.id = m.dst JOIN cls c ON c.id = m.src UNION SELECT 'view', v.name, o.database FROM based_on b JOIN one o ON o.id = b.dst JOIN view v ON v.id = b.src UNION SELECT 'procedure', p.name, o.database FROM uses_table u JOIN one o ON o.id = u.dst JOIN proc p ON p.id = u.src",
    "columns_of_table": f"""{_LINKED} SELECT database_name AS database, table_name AS "table", column_name AS "column", ordinal_no AS ordinal, data_type, upper(is_nullable) IN ('YES', 'Y', 'TRUE', 'T', '1') AS is_nullable FROM live WHERE lower(table_name) = {_ONE}""",
    "column_blast_radius": f"""{_ALL}, c AS (SELECT * FROM live WHERE lower(column_name) = '{COLUMN}'), pairs AS (SELECT src AS id, dst AS other FROM fk UNION ALL SELECT dst, src FROM fk)
SELECT c.database_name AS database, c.schema_name AS schema, c.table_name AS "table", c.data_type, upper(c.is_nullable) IN ('YES', 'Y', 'TRUE', 'T', '1') AS is_nullable,
 coalesce((SELECT list_sort(list(DISTINCT o.table_name || '.' || o.column_name)) FROM pairs b JOIN live o ON o.id = b.other WHERE b.id = c.id), []) AS partners,
 coalesce((SELECT list_sort(list(DISTINCT name)) FROM ix WHERE ix.tid = c.tid AND list_contains(ix.columns, c.column_name) AND c.tid IN (SELECT tid FROM base)), []) AS indexes,
 coalesce((SELECT list_sort(list(DISTINCT n)) FROM (SELECT p.name AS n, u.dst FROM uses_table u JOIN proc p ON p.id = u.src UNION ALL SELECT v.name, b.dst FROM based_on b JOIN view v ON v.id = b.src) x WHERE x.dst = c.tid), []) AS users FROM c""",
    "impact_of_column": _impact_sql(f"contains(lower(column_name), '{COLUMN}')", f"contains(lower(a.column_name), '{COLUMN}') OR contains(lower(b.column_name), '{COLUMN}')", f"contains(lower(definition), '{COLUMN}')", f"len(list_filter(columns, lambda c: contains(lower(c), '{COLUMN}'))) > 0"),
    "impact_of_table": _impact_sql(f"lower(table_name) = {_ONE}", f"lower(a.table_name) = {_ONE} OR lower(b.table_name) = {_ONE}", f"contains(lower(definition), {_ONE})", f"lower(table_name) = {_ONE}"),
    "link_maps_to": f"{_ALL} SELECT src, dst FROM maps_to", "link_based_on": f"{_ALL} SELECT src, dst FROM based_on", "link_uses_table": f"{_ALL} SELECT src, dst FROM uses_table", "link_cross_db": f"{_CAT} {_contain('view', '<>')}",
    "blast_radius_file": f"""{_CODE} SELECT f.repo, f.relpath AS path, c.fqn AS "class", coalesce((SELECT list_sort(list(DISTINCT m.name)) FROM has_method h JOIN method m ON m.id = h.dst WHERE h.src = c.id), []) AS methods, (SELECT count(*) FROM has_method h WHERE h.src = c.id) AS n_methods,
 coalesce((SELECT list_sort(list(DISTINCT k.src)) FROM imports i JOIN cls x ON x.id = i.dst JOIN contains k ON k.dst = i.src WHERE x.fqn = c.fqn AND k.src <> f.id), []) AS callers FROM f JOIN contains o ON o.src = f.id JOIN cls c ON c.id = o.dst WHERE f.id = {_BLAST_FILE}""",
    "authors_of_commits": f"WITH {_COMMITS} SELECT lower(coalesce(nullif(author_email, ''), author_name)) AS author, count(*) AS commits FROM k WHERE lower(coalesce(nullif(author_email, ''), author_name)) IS NOT NULL GROUP BY 1",
    "commit_parents": f"WITH {_COMMITS} SELECT DISTINCT id AS src, repo || '@' || p AS dst FROM (SELECT id, repo, unnest(parents) AS p FROM k)",
}
