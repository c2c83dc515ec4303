"""Queries on references and on incremental processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators import incremental, orphans
from lodeweave.runtime import read_table


def _tracked(spark: SparkSession, d: str, months: int = 6) -> orphans.OrphanStore:
    refs = orphans.references(read_table(spark, d, "foreign_keys"), read_table(spark, d, "vds_rows"))
    return orphans.by_period(refs, orphans.parents(read_table(spark, d, "catalog_columns")), months)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """References that found no live target in the index of parents when they were made."""
    return _tracked(spark, d).references().where("is_orphan").select("source_table", "record_id")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per target and month made: references and orphans among them."""
    return orphans.snapshot_counts(_tracked(spark, d).references())


def p4_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Per target: how many references waited at the end of every month that changed their number."""
    month = F.format_string("%04d-%02d", F.floor(F.col("batch") / 12).cast("int"), (F.col("batch") % 12 + 1).cast("int"))
    return _tracked(spark, d, months=1).snapshots().select("db", "tab", month.alias("month"), "n_open")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.commits_to_process(read_table(spark, d, "commits"), read_table(spark, d, "history_runs"))


def _ident(c: str) -> str:
    """The comparable identifier in SQL."""
    q = "'^((`[^`]*`|\"[^\"]*\"|\\[[^\\]]*\\]|[^.`\"\\[\\]]*)\\s*\\.\\s*)+(\\S)'"
    return f"nullif(trim(translate(regexp_replace(trim(regexp_replace(lower({c}), '\\s+', ' ', 'g')), {q}, '\\3'), '`\"[]', '    ')), '')"


_REFS = f"""
SELECT 'foreign_keys' AS source_table, fk_id AS record_id, database_name AS db, {_ident("to_table")} AS tab, {_ident("to_column")} AS col, collected_at AS t FROM foreign_keys
UNION ALL SELECT 'vds_rows', vds_id, database_name, {_ident("coretable")}, NULL, collected_at FROM vds_rows"""
_CATALOG = f"SELECT database_name AS db, {_ident('table_name')} AS tab, {_ident('column_name')} AS col, first_seen_at AS born, dropped_at AS gone FROM catalog_columns"
_PROBED = f"""
WITH refs AS ({_REFS}), cat AS ({_CATALOG}),
probed AS (SELECT r.*, NOT EXISTS (SELECT 1 FROM cat c WHERE c.db = r.db AND c.tab = r.tab AND (r.col IS NULL OR c.col = r.col)
  AND (c.born IS NULL OR c.born <= r.t) AND (c.gone IS NULL OR r.t < c.gone)) AS is_orphan FROM refs r WHERE r.tab IS NOT NULL)"""

_CONTENT = "repo, commit_hash, short_hash, author_name, author_email, authored_at, committer_name, committer_email, committed_at, parents, message, insertions, deletions, files_changed"
_TO_PROCESS = f"""
WITH RECURSIVE c AS (SELECT DISTINCT repo, commit_hash AS h FROM commits WHERE repo IS NOT NULL AND trim(commit_hash) <> ''),
e AS (SELECT DISTINCT repo, commit_hash AS h, unnest(parents) AS p FROM commits),
r AS (SELECT repo, head_hash AS head, since_hash AS since, started_at FROM history_runs WHERE run_status = 'succeeded'),
ends AS (SELECT DISTINCT c.* FROM c JOIN (SELECT repo, head AS h FROM r UNION SELECT repo, since FROM r) x ON x.repo = c.repo AND x.h = c.h),
reach AS (SELECT repo, h AS root, h AS x FROM ends UNION SELECT reach.repo, reach.root, e.p FROM reach JOIN e ON e.repo = reach.repo AND e.h = reach.x),
covered AS (SELECT a.repo, a.x, max(r.started_at) AS until FROM r JOIN reach a ON a.repo = r.repo AND a.root = r.head
  WHERE NOT EXISTS (SELECT 1 FROM reach b WHERE b.repo = r.repo AND b.root = r.since AND b.x = a.x) GROUP BY a.repo, a.x),
versions AS (SELECT repo, commit_hash, min(recorded_at) AS rec FROM commits GROUP BY {_CONTENT}),
last AS (SELECT repo, commit_hash, max(rec) AS rec FROM versions GROUP BY repo, commit_hash)
SELECT l.repo, l.commit_hash FROM last l JOIN c ON c.repo = l.repo AND c.h = l.commit_hash LEFT JOIN covered v ON v.repo = l.repo AND v.x = l.commit_hash WHERE v.until IS NULL OR l.rec > v.until"""

_SNAPSHOTS = f"""
WITH refs AS (SELECT * FROM ({_REFS}) WHERE tab IS NOT NULL), cat AS ({_CATALOG}),
ends AS (SELECT unnest(generate_series(date_trunc('month', least((SELECT min(t) FROM refs), (SELECT min(born) FROM cat))), date_trunc('month', greatest((SELECT max(t) FROM refs), (SELECT max(born) FROM cat), (SELECT max(gone) FROM cat))), INTERVAL 1 MONTH)) AS m),
waits AS (SELECT r.db, r.tab, e.m FROM refs r JOIN ends e ON r.t IS NULL OR r.t < e.m + INTERVAL 1 MONTH WHERE NOT EXISTS (SELECT 1 FROM cat c WHERE c.db = r.db AND c.tab = r.tab AND (r.col IS NULL OR c.col = r.col)
  AND (c.gone IS NULL OR c.born IS NULL OR c.gone > c.born) AND (c.born IS NULL OR c.born < e.m + INTERVAL 1 MONTH) AND (c.gone IS NULL OR c.gone >= e.m + INTERVAL 1 MONTH))),
counted AS (SELECT t.db, t.tab, e.m, count(w.m) AS n FROM (SELECT DISTINCT db, tab FROM refs) t CROSS JOIN ends e LEFT JOIN waits w ON w.db IS NOT DISTINCT FROM t.db AND w.tab = t.tab AND w.m = e.m GROUP BY ALL)
SELECT db, tab, strftime(m, '%Y-%m') AS month, n AS n_open FROM (SELECT *, lag(n, 1, 0) OVER (PARTITION BY db, tab ORDER BY m) AS before FROM counted) WHERE n <> before"""

QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts, "p4_snapshots": p4_snapshots, "p6_found": p6_found}
SQL = {
    "p6_found": _TO_PROCESS,
    "p4_found": f"{_PROBED} SELECT source_table, record_id FROM probed WHERE is_orphan",
    "p4_snapshots": _SNAPSHOTS,
    "p4_counts": f"{_PROBED} SELECT db, tab, strftime(t, '%Y-%m') AS month, count(*) AS n_references, count(*) FILTER (WHERE is_orphan) AS n_orphans FROM probed GROUP BY ALL",
}
