"""Ownership, churn and schema recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.operators.graph import Graph


def _by_author(g: Graph) -> DataFrame:
    """(author id, commit, file) of every change; a change that brings its author along needs no join."""
    ch = g.rels["CHANGED"].withColumnsRenamed({"src": "commit", "dst": "file"})
    if "author" in ch.columns:
        return ch.where("author is not null").select("commit", "file", "insertions", "deletions", "author")
    return ch.select("commit", "file", "insertions", "deletions").join(g.rels["AUTHORED"].select(F.col("src").alias("author"), F.col("dst").alias("commit")), "commit")


def _touches(g: Graph) -> DataFrame:
    """(author id, commit, file) of every change, with file and commit properties."""
    return _by_author(g).join(g.nodes["File"].select(F.col("id").alias("file"), "repo", "path"), "file")


def top_authors(g: Graph, limit: int | None = 20, repo: str | None = None) -> DataFrame:
    """(author, files): authors by distinct files they changed."""
    of = g.nodes["File"].select(F.col("id").alias("file"), "repo")
    t = _by_author(g).select("author", "file").distinct().join(of if repo is None else of.where(F.col("repo") == repo), "file")
    per = t.groupBy("author").agg(F.countDistinct("file").alias("files")).join(g.nodes["Author"].select(F.col("id").alias("author"), "name"), "author")
    out = per.select("name", "files").orderBy(F.desc("files"), "name")
    return out.limit(limit) if limit else out


def owners_of_directory(g: Graph, prefix: str) -> DataFrame:
    """(name, files, last_touch): who changed files below a path, and when last."""
    t = _touches(g).where(F.col("path").startswith(prefix)).join(g.nodes["Commit"].select(F.col("id").alias("commit"), "authored_at"), "commit")
    per = t.groupBy("author").agg(F.countDistinct("file").alias("files"), F.max("authored_at").alias("last_touch"))
    return per.join(g.nodes["Author"].select(F.col("id").alias("author"), "name"), "author").select("name", "files", "last_touch")


def churn(g: Graph, limit: int | None = 20, since: str | None = None, authors: bool = False) -> DataFrame:
    """(repo, path, churn, inserted, deleted, commits[, authors]): files by changed lines; ``since`` compares dates as text."""
    ch = g.rels["CHANGED"]
    if since is not None:
        ch = ch.join(g.nodes["Commit"].where(F.col("authored_at") >= F.lit(since)).select(F.col("id").alias("src")), "src", "left_semi")
    aggs = [F.sum(F.col("insertions") + F.col("deletions")).alias("churn"), F.sum("insertions").alias("inserted"), F.sum("deletions").alias("deleted"), F.count("*").alias("commits")]
    per = g.per_file.drop("day") if g.per_file is not None and since is None else ch.groupBy("dst").agg(*aggs)
    if authors:
        who = ch.select("src", "dst").join(g.rels["AUTHORED"].select(F.col("dst").alias("src"), F.col("src").alias("author")), "src").groupBy("dst").agg(F.countDistinct("author").alias("authors"))
        per = per.join(who, "dst", "left")
    out = per.join(g.nodes["File"].select(F.col("id").alias("dst"), "repo", "path"), "dst").drop("dst").orderBy(F.desc("churn"), "repo", "path")
    return out.limit(limit) if limit else out


def fk_hotspots(g: Graph, limit: int | None = 20, shown: int = 10) -> DataFrame:
    """Tables by how many tables refer to them, with the first names of those."""
    t = g.nodes["Table"]
    r = g.rels["REFERENCES"].join(t.select(F.col("id").alias("src"), F.col("name").alias("other")), "src")
    per = r.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("incoming_tables"), F.slice(F.sort_array(F.collect_set("other")), 1, shown).alias("referenced_by"))
    out = per.join(t, "id").select("database", "schema", F.col("name").alias("table"), "incoming_tables", "referenced_by").orderBy(F.desc("incoming_tables"), "database", "schema", "table")
    return out.limit(limit) if limit else out


def fk_hotspot_columns(g: Graph) -> DataFrame:
    """(database, table, column, incoming): columns by foreign keys that point to them."""
    per = g.rels["FOREIGN_KEY"].groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("incoming"))
    return per.join(g.nodes["Column"], "id").select("database", "table", F.col("name").alias("column"), "incoming")


def orphan_tables(g: Graph) -> DataFrame:
    """(database, table): tables without foreign keys either way and without a class."""
    t = g.nodes["Table"]
    r = g.rels["REFERENCES"]
    for used in (r.select(F.col("src").alias("id")), r.select(F.col("dst").alias("id")), g.rels["MAPS_TO"].select(F.col("dst").alias("id"))):
        t = t.join(used, "id", "left_anti")
    return t.select("database", F.col("name").alias("table"))


def entity_table_map(g: Graph) -> DataFrame:
    """(entity, path, database, table): classes mapped to tables, with the file that declares them if known."""
    m = g.rels["MAPS_TO"].join(g.nodes["Class"].select(F.col("id").alias("src"), "fqn"), "src").join(g.nodes["Table"].select(F.col("id").alias("dst"), "name", "database"), "dst")
    own = g.rels["CONTAINS_CLASS"].select(F.col("dst").alias("src"), F.col("src").alias("file")).join(g.nodes["File"].select(F.col("id").alias("file"), "path"), "file")
    return m.join(own, "src", "left").select(F.col("fqn").alias("entity"), "path", "database", F.col("name").alias("table"))


def tables_without_entity(g: Graph) -> DataFrame:
    return g.nodes["Table"].join(g.rels["MAPS_TO"].select(F.col("dst").alias("id")), "id", "left_anti").select("database", F.col("name").alias("table"))


def entities_without_table(g: Graph) -> DataFrame:
    c = g.nodes["Class"].where("stereotype = 'Entity'")
    return c.join(g.rels["MAPS_TO"].select(F.col("src").alias("id")), "id", "left_anti").select("repo", F.col("fqn").alias("entity"))


def who_touches_table(g: Graph, table: str) -> DataFrame:
    """(kind, name, database): classes, views and procedures that a table of this name is linked with."""
    t = g.nodes["Table"].where(F.lower("name") == F.lit(table.lower())).select(F.col("id").alias("dst"), "database")
    out = None
    for rel, label, kind, col in (("MAPS_TO", "Class", "class", "fqn"), ("BASED_ON", "View", "view", "name"), ("USES_TABLE", "StoredProcedure", "procedure", "name")):
        one = g.rels[rel].join(t, "dst").join(g.nodes[label].select(F.col("id").alias("src"), F.col(col).alias("n")), "src").select(F.lit(kind).alias("kind"), F.col("n").alias("name"), "database")
        out = one if out is None else out.union(one)
    return out.distinct()


def columns_of_table(g: Graph, table: str) -> DataFrame:
    """Columns of a table by ordinal, null ordinals last."""
    c = g.nodes["Column"].where(F.lower("table") == F.lit(table.lower()))
    return c.orderBy("database", F.col("ordinal").asc_nulls_last(), "name").select("database", "table", F.col("name").alias("column"), "ordinal", "data_type", "is_nullable")
