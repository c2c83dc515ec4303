"""Queries written in the pattern language, and what the guard says of others, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import text
from lodeweave.operators import ingest, merge
from lodeweave.plans import graph_queries as gq
from lodeweave.plans import ingest_queries as iq
from lodeweave.plans.operator_queries import _SHOP, shop_history
from lodeweave.query.guard import denial
from lodeweave.query.pattern import compile_query
from lodeweave.runtime import read_table


def _ask(make, query: str, **params):
    return lambda spark, d: compile_query(make(spark, d), query, params)


_BLAST = """MATCH (c:Column) WHERE toLower(c.name) = toLower($column)
OPTIONAL MATCH (c)-[:FOREIGN_KEY]-(fk:Column) OPTIONAL MATCH (t:Table)-[:HAS_COLUMN]->(c) OPTIONAL MATCH (t)-[:HAS_INDEX]->(ix:Index) WHERE c.name IN ix.columns OPTIONAL MATCH (t)<-[:USES_TABLE|BASED_ON]-(user)
RETURN c.database AS database, c.schema AS schema, c.table AS table, c.data_type AS data_type, c.is_nullable AS is_nullable, collect(DISTINCT fk.table + '.' + fk.name) AS partners, collect(DISTINCT ix.name) AS indexes, collect(DISTINCT user.name) AS users ORDER BY database, schema, table"""
_DEAD = """MATCH (f:File) OPTIONAL MATCH (c:Commit)-[:CHANGED]->(f) WITH f, max(substring(coalesce(c.authored_at, c.committed_at, ''), 0, 10)) AS last WHERE last IS NULL OR last = '' OR last < $cutoff
OPTIONAL MATCH (f)-[:CONTAINS_CLASS]->(cls:Class) OPTIONAL MATCH (importer:File)-[:CONTAINS_CLASS]->(:Class)-[:IMPORTS]->(ref:Class) WHERE ref.fqn = cls.fqn AND importer.repo = f.repo AND importer <> f
WITH f, last, count(DISTINCT importer) AS importers WHERE importers = 0 RETURN f.repo AS repo, f.path AS path, CASE WHEN last = '' THEN NULL ELSE last END AS last_changed"""
#: Queries and the reason the guard gives; None is allowed.
ASKED = [
    ("MATCH (n) RETURN n LIMIT 500", None), ("MATCH (n) RETURN n LIMIT 501", "LIMIT over 500"), ("", "empty query"), ("MATCH (a) SET a.x = 1 RETURN a", "SET is not allowed"), ("CREATE (a) RETURN a", "CREATE is not allowed"), ("MATCH (a) RETURN 1; RETURN 2", "multi-statement"),
    ("CALL db.labels() YIELD label RETURN label", None), ("CALL tools.wait(9) YIELD x RETURN x", "procedure tools.wait is not allowed"), ("RETURN tools.join('x') AS x", "function tools.join is not allowed"), ("RETURN date.truncate('day', date()) AS d", None), ("LOAD CSV FROM 'f' AS r RETURN r", "LOAD CSV is not allowed"), ("USE other MATCH (n) RETURN n", "USE is not allowed"),
    ("MATCH (n:Set) WHERE n.delete = 'DROP' RETURN n", None), ("MATCH (n) RETURN n LIMIT 0x10", "LIMIT must be a plain number"), ("MATCH (n) WHERE n.x = 'open RETURN n", "unterminated string"), ("MATCH (n) WHERE EXISTS { MATCH (n)-[:T]->() } RETURN n", None),
]


def guard_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, denial(q)) for i, (q, _) in enumerate(ASKED)], "n int, reason string")


def framework_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the listed classes with a stereotype, added to what they had."""
    c = read_table(spark, d, "classes").select(F.col("class_id").alias("id"), "stereotype").where("class_id is not null")
    nodes = c.select("id", F.array(F.lit("Class")).alias("labels")).distinct()
    for s in ("Entity", "Service", "Controller", "Component"):
        nodes = merge.add_label(nodes, c.where(F.col("stereotype") == s), s)
    return nodes.select("id", F.array_sort("labels").alias("labels"))


def key_violations(spark: SparkSession, d: str) -> DataFrame:
    """What a uniqueness constraint on the delivered commits would refuse."""
    return merge.duplicates(read_table(spark, d, "commits").where("repo is not null"), ["repo", "commit_hash"])


def text_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Whether a routine's definition names a table: for the tables it is linked to, and for the last one of its database."""
    g = gq.linked(spark, d)
    p, t = g.nodes["StoredProcedure"], g.nodes["Table"]
    last = p.select(F.col("id").alias("src"), "database").join(t.groupBy("database").agg(F.max("id").alias("dst")), "database").select("src", "dst")
    both = g.rels["USES_TABLE"].select("src", "dst").union(last).distinct()
    j = both.join(p.select(F.col("id").alias("src"), "definition"), "src").join(t.select(F.col("id").alias("dst"), "name"), "dst")
    return j.select("src", "dst", text.matches_table("definition", "name").alias("hit"))


QUERIES = {
    "pattern_entity_table_map": _ask(gq.linked, "MATCH (e:Class)-[:MAPS_TO]->(t:Table) OPTIONAL MATCH (f:File)-[:CONTAINS_CLASS]->(e) RETURN e.fqn AS entity, f.path AS path, t.database AS database, t.name AS table ORDER BY table, entity"),
    "pattern_orphan_tables": _ask(gq.linked, "MATCH (t:Table) WHERE NOT (t)-[:REFERENCES]->() AND NOT (t)<-[:REFERENCES]-() AND NOT (t)<-[:MAPS_TO]-(:Class) RETURN t.database AS database, t.name AS table"),
    "pattern_tables_without_entity": _ask(gq.linked, "MATCH (t:Table) WHERE NOT (t)<-[:MAPS_TO]-() RETURN t.database AS database, t.name AS table"), "pattern_entities": _ask(gq.linked, "MATCH (e:Entity) WHERE NOT EXISTS { MATCH (e)-[:MAPS_TO]->(:Table) } RETURN e.repo AS repo, e.fqn AS entity"),
    "pattern_column_blast_radius": _ask(gq.kept(gq.linked), _BLAST, column=gq.COLUMN), "pattern_dead_files": _ask(iq.whole, _DEAD, cutoff=gq.CUTOFF),
    "pattern_lone_files": _ask(iq.whole, "MATCH (f:File) WHERE NOT EXISTS { MATCH (:Package)-[:CONTAINS_FILE]->(f) } AND EXISTS { MATCH (:Commit)-[r:CHANGED]->(f) WHERE r.insertions > 30 } RETURN f.id AS id"),
    "pattern_index_columns": _ask(gq.catalog, "MATCH (i:Index) WHERE any(c IN i.columns WHERE toLower(c) CONTAINS $text) RETURN i.id AS id, reduce(all = '', c IN i.columns | all + c + ',') AS names, size(i.columns) AS n, [c IN i.columns WHERE c <> 'id' | toUpper(c)] AS others, head(i.columns) AS first", text="name"),
    "pattern_labels": _ask(gq.catalog, "CALL db.labels() YIELD label RETURN label"), "pattern_types": _ask(gq.catalog, "CALL db.relationshipTypes() YIELD relationshipType AS t RETURN t"), "pattern_unwind": _ask(gq.catalog, "MATCH (i:Index) UNWIND i.columns AS c RETURN c, count(*) AS n"),
    "pattern_any_user": _ask(gq.linked, "MATCH (p)-[r:USES_TABLE|BASED_ON]-(t:Table) RETURN type(r) AS type, startNode(r).id AS start, elementId(t) AS table, head(labels(p)) AS label"),
    "pattern_two_labels": _ask(gq.catalog, "MATCH (n) WHERE (n:Table OR n:Index) AND n.name CONTAINS '_' AND NOT n.name STARTS WITH 't' RETURN labels(n)[0] AS label, n.id AS id"),
    "pattern_value_join": _ask(gq.catalog, "MATCH (a:Column), (b:Column) WHERE a.name = b.name AND a.database = b.database AND a.table < b.table AND a.data_type <> b.data_type RETURN a.id AS a, b.id AS b"),
    "pattern_case": _ask(gq.catalog, "MATCH (c:Column) RETURN CASE WHEN c.ordinal IS NULL THEN 'none' WHEN c.ordinal <= 3 THEN 'front' ELSE 'back' END AS place, count(*) AS n, max(c.ordinal) AS last, avg(c.ordinal) AS mean"),
    "pattern_nothing": _ask(gq.catalog, "MATCH (t:Table {name: 'no such table'}) RETURN count(t) AS n, max(t.name) AS m"), "pattern_by_key": _ask(gq.catalog, "MATCH (i:Index {name: 'PRIMARY'}) WHERE i.table IN $tables OR i.is_unique RETURN i.id AS id", tables=["orders"]),
    "pattern_maps": _ask(gq.catalog, "MATCH (t:Table)-[:HAS_INDEX]->(i:Index) WITH t, collect(DISTINCT {name: i.name, is_unique: i.is_unique}) AS ix RETURN t.id AS id, size(ix) AS n, ix[0].name AS first"),
    "pattern_union": _ask(gq.catalog, "MATCH (t:Table) RETURN t.name AS name UNION MATCH (i:Index) RETURN i.table AS name"), "pattern_union_all": _ask(gq.catalog, "MATCH (t:Table) RETURN t.name AS name UNION ALL MATCH (i:Index) RETURN i.table AS name"),
    "pattern_shared_parent": _ask(gq.catalog, "MATCH (a:Table)-[:REFERENCES]->(p:Table)<-[:REFERENCES]-(b:Table) WHERE a <> b AND a.id < b.id RETURN p.id AS parent, count(*) AS pairs"), "pattern_neighbors": _ask(gq.kept(gq.catalog), "MATCH (t:Table) RETURN t.id AS id, COUNT { (t)-[:REFERENCES]-(:Table) } AS n, COUNT { (t)-[:HAS_COLUMN]->(c:Column) WHERE c.is_nullable } AS nullable"),
    "pattern_dates": _ask(shop_history, "MATCH (c:Commit) WHERE date(c.authored_at) >= date($from) RETURN date.truncate('month', date(c.authored_at)) AS month, count(*) AS n", **{"from": "1998-01-01"}),
    "guard_verdicts": guard_verdicts, "framework_labels": framework_labels, "key_violations": key_violations, "text_mentions": text_mentions,
}
_C = f"WITH {gq._CATALOG}, ixx AS (SELECT * FROM ix WHERE tid IN (SELECT tid FROM base)), cols AS (SELECT id, column_name AS name, table_name, database_name, data_type, ordinal_no, upper(is_nullable) IN ('YES', 'Y', 'TRUE', 'T', '1') AS nullable FROM live)"
SQL = {
    "pattern_entity_table_map": gq.SQL["entity_table_map"], "pattern_orphan_tables": gq.SQL["orphan_tables"], "pattern_tables_without_entity": gq.SQL["tables_without_entity"], "pattern_entities": gq.SQL["entities_without_table"], "pattern_column_blast_radius": gq.SQL["column_blast_radius"], "pattern_dead_files": iq.SQL["dead_code_files"],
    "pattern_lone_files": f"{iq._LOG}, src AS (SELECT repo, relpath, file_type, i, code_lines[i].line_text AS raw FROM (SELECT *, unnest(range(1, len(code_lines) + 1)) AS i FROM f)) SELECT id FROM f WHERE id IN (SELECT repo || '/' || path FROM ch WHERE ins > 30) AND id NOT IN (SELECT repo || '/' || relpath FROM {iq._JAVA_PACKAGE})",
    "pattern_index_columns": f"{_C} SELECT id, array_to_string(columns, ',') || ',' AS names, len(columns) AS n, list_transform(list_filter(columns, lambda c: c <> 'id'), lambda c: upper(c)) AS others, columns[1] AS first FROM ixx WHERE len(list_filter(columns, lambda c: contains(lower(c), 'name'))) > 0",
    "pattern_labels": "SELECT unnest(['Database', 'Schema', 'Table', 'Column', 'Index', 'StoredProcedure', 'View']) AS label", "pattern_types": "SELECT unnest(['HAS_SCHEMA', 'HAS_TABLE', 'HAS_COLUMN', 'FOREIGN_KEY', 'REFERENCES', 'HAS_INDEX', 'HAS_PROCEDURE', 'HAS_VIEW']) AS t", "pattern_unwind": f"{_C} SELECT c, count(*) AS n FROM (SELECT unnest(columns) AS c FROM ixx) GROUP BY c",
    "pattern_any_user": f"""{gq._LINKED} SELECT 'USES_TABLE' AS type, src AS start, dst AS "table", 'StoredProcedure' AS label FROM uses_table UNION ALL SELECT 'BASED_ON', src, dst, 'View' FROM based_on""",
    "pattern_two_labels": f"{_C} SELECT 'Table' AS label, id FROM tables WHERE contains(name, '_') AND NOT starts_with(name, 't') UNION ALL SELECT 'Index', id FROM ixx WHERE contains(name, '_') AND NOT starts_with(name, 't')",
    "pattern_value_join": f"{_C} SELECT a.id AS a, b.id AS b FROM cols a JOIN cols b ON a.name = b.name AND a.database_name = b.database_name AND a.table_name < b.table_name AND a.data_type <> b.data_type",
    "pattern_case": f"{_C} SELECT CASE WHEN ordinal_no IS NULL THEN 'none' WHEN ordinal_no <= 3 THEN 'front' ELSE 'back' END AS place, count(*) AS n, max(ordinal_no) AS last, avg(ordinal_no) AS mean FROM cols GROUP BY 1",
    "pattern_nothing": "SELECT 0 AS n, NULL AS m", "pattern_by_key": f"{_C} SELECT id FROM ixx WHERE name = 'PRIMARY' AND (table_name = 'orders' OR is_unique)",
    "pattern_maps": f"{_C} SELECT tid AS id, count(DISTINCT (name, is_unique)) AS n, min(name) AS first FROM ixx GROUP BY tid",
    "pattern_union": f"{_C} SELECT name FROM tables UNION SELECT table_name FROM ixx", "pattern_union_all": f"{_C} SELECT name FROM tables UNION ALL SELECT table_name FROM ixx",
    "pattern_shared_parent": f"{_C} SELECT a.dst AS parent, count(*) AS pairs FROM refs a JOIN refs b ON a.dst = b.dst AND a.src < b.src GROUP BY 1",
    "pattern_neighbors": f"{_C} SELECT t.id, (SELECT count(*) FROM refs r WHERE r.src = t.id) + (SELECT count(*) FROM refs r WHERE r.dst = t.id AND r.src <> t.id) AS n, (SELECT count(*) FROM base b WHERE b.tid = t.id AND upper(b.is_nullable) IN ('YES', 'Y', 'TRUE', 'T', '1')) AS nullable FROM tables t",
    "pattern_dates": "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1998-01-01' GROUP BY 1",
    "guard_verdicts": "SELECT * FROM (VALUES " + ", ".join(f"({i}, " + (f"'{why}'" if why else "CAST(NULL AS VARCHAR)") + ")" for i, (_, why) in enumerate(ASKED)) + ") v(n, reason)",
    "framework_labels": "SELECT id, list_sort(list_distinct(flatten(list(l)))) AS labels FROM (SELECT class_id AS id, CASE WHEN stereotype IN ('Entity', 'Service', 'Controller', 'Component') THEN ['Class', stereotype] ELSE ['Class'] END AS l FROM classes WHERE class_id IS NOT NULL) GROUP BY id",
    "key_violations": "SELECT repo, commit_hash, count(*) AS n FROM commits WHERE repo IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "text_mentions": f"{gq._LINKED} SELECT DISTINCT x.src, x.dst, regexp_matches(lower(p.definition), '(^|[^a-z0-9_$])' || lower(t.name) || '($|[^a-z0-9_$])') AS hit FROM (SELECT src, dst FROM uses_table UNION SELECT p.id, m.dst FROM proc p JOIN (SELECT database, max(id) AS dst FROM tables GROUP BY 1) m ON m.database = p.database) x JOIN proc p ON p.id = x.src JOIN tables t ON t.id = x.dst",
}
