"""A git working copy, or a database's information schema, as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators import ingest
from lodeweave.operators.graph import Graph, catalog_graph
from lodeweave.sources import catalog, history
from lodeweave.sources.structure import poms, structures
from lodeweave.sources.tree import find_modules, scan_tree


def graph_of(spark: SparkSession, path: str, repo: str, url: str = "", since: str = "", with_lines: bool = False, log_limit: int = 0) -> Graph:
    """The graph of a working copy: its tree, modules, structure, log, branches and tags.

    With ``since`` only files and commits after that commit are read; a commit that is not known reads everything.
    """
    since = since if since and history.commit_exists(path, since) else ""
    only = history.changed_paths(spark, path, since) if since else None
    files = scan_tree(spark, path, repo, only)
    keyed = structures(files, "relpath", "type", "lines").withColumn("repo", F.lit(repo))
    built = find_modules(files if only is None else scan_tree(spark, path, repo))
    named = poms(files.where("name = 'pom.xml'").select("repo", F.regexp_replace("relpath", r"/?[^/]*$", "").alias("root"), F.array_join("lines", "\n").alias("text")))
    descriptors = built.join(named, ["repo", "root"], "left").select("repo", "root", "pom")
    repositories = spark.createDataFrame([(repo, url, None, "completed")], "repo string, url string, default_branch string, ingest_status string")
    code = ingest.code(repositories, files, keyed, descriptors, with_lines)
    stat, status = (history.log_rows(history.read_log(spark, path, mode, since, log_limit)) for mode in ("numstat", "name-status"))
    changed = history.changed_files(history.numstat(stat), history.name_status(status)).withColumn("repo", F.lit(repo))
    commits = history.commits(stat, changed.drop("repo")).withColumn("repo", F.lit(repo))
    refs = history.refs(history.ref_lines(spark, path)).withColumn("repo", F.lit(repo))
    g = ingest.joined(code, ingest.history(commits, changed, refs, code.nodes["File"].select("id")))
    g.nodes["Repository"] = g.nodes["Repository"].withColumn("last_commit", F.lit(history.head_commit(path)))
    return g


def schema_graph(engine: str, host: str, database: str, tables: DataFrame, columns: DataFrame, routines: DataFrame, views: DataFrame, foreign_keys: DataFrame, indexes: DataFrame | None = None) -> Graph:
    """The graph of one database from the rows of its information schema, as the mappers of ``catalog`` give them.

    Columns of views have no table to hang on and are left out.
    """
    own = lambda df: df.withColumns({"db_engine": F.lit(engine), "db_host": F.lit(host), "database_name": F.lit(database)})
    c = columns.join(tables.select("schema", F.col("name").alias("table")), ["schema", "table"], "left_semi")
    c = own(c).select("db_engine", "db_host", "database_name", F.col("schema").alias("schema_name"), F.col("table").alias("table_name"), F.col("name").alias("column_name"), F.lit(0).cast("bigint").alias("column_id"), F.lit(None).cast("timestamp").alias("dropped_at"), F.col("ordinal").alias("ordinal_no"), "data_type", F.when(F.col("is_nullable"), "YES").otherwise("NO").alias("is_nullable"), F.col("default").alias("column_default"), "column_key")
    p = own(routines).select("db_engine", "db_host", "database_name", F.col("schema").alias("schema_name"), F.col("name").alias("procedure_name"), F.col("type").alias("routine_type"), "definition", "parameters", F.lit(0).alias("seq"))
    v = own(views).select("db_engine", "db_host", "database_name", F.col("schema").alias("schema_name"), F.col("name").alias("view_name"), "definition", F.lit(0).alias("seq"))
    x = None if indexes is None else own(indexes).select("db_engine", "db_host", "database_name", F.col("schema").alias("schema_name"), F.col("table").alias("table_name"), F.col("name").alias("index_name"), "columns", "is_unique", "index_type")
    return catalog_graph(c, own(foreign_keys), p, v, x)


def read_database(spark: SparkSession, url: str, schemas: list[str] | None = None) -> Graph:
    """The graph of the databases that an address names, over JDBC; one after the other, as each is a connection of its own."""
    made, parts = [], catalog.parse_db_url(url)
    for name in parts["databases"]:
        one = url.rsplit("/", 1)[0] + f"/{name}"
        info = lambda t: catalog.read_information_schema(spark, one, t, schemas)  # noqa: B023, E731
        keys = catalog.foreign_keys_of(info("key_column_usage"), info("referential_constraints"))
        made.append(schema_graph(parts["engine"], parts["host"], name, catalog.tables_of(info("tables")), catalog.columns_of(info("columns")), catalog.routines_of(info("routines"), info("parameters")), catalog.views_of(info("views")), keys))
    first, *rest = made
    for g in rest:
        first = Graph({k: df.unionByName(g.nodes[k], allowMissingColumns=True) for k, df in first.nodes.items()}, {k: df.unionByName(g.rels[k]) for k, df in first.rels.items()})
    return first
