"""The metadata graph: one DataFrame per node label and per relationship type.

Ids are unique per label. Every relationship frame has ``src`` and ``dst`` (ids) and its own properties;
``RELATIONSHIPS`` names the labels at both ends. Absent and null are the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions.text import author_id, strip_credentials
from lodeweave.operators.orphans import identifier

RELATIONSHIPS = {
    "HAS_MODULE": ("Repository", "Module"), "DEPENDS_ON": ("Module", "Dependency"), "HAS_PACKAGE": ("Module", "Package"),
    "CONTAINS_FILE": ("Repository", "File"), "CONTAINS_CLASS": ("File", "Class"), "CONTAINS_METHOD": ("File", "Method"), "EXTENDS": ("Class", "Class"), "IMPLEMENTS": ("Class", "Class"), "IMPORTS": ("Class", "Class"), "HAS_METHOD": ("Class", "Method"),
    "CONTAINS_LINE": ("File", "Line"), "NEXT_LINE": ("Line", "Line"),
    "HAS_COMMIT": ("Repository", "Commit"), "AUTHORED": ("Author", "Commit"), "PARENT": ("Commit", "Commit"), "CHANGED": ("Commit", "File"),
    "HAS_BRANCH": ("Repository", "Branch"), "HAS_TAG": ("Repository", "Tag"), "POINTS_TO": ("Branch", "Commit"), "TAGS": ("Tag", "Commit"),
    "HAS_SCHEMA": ("Database", "Schema"), "HAS_TABLE": ("Schema", "Table"), "HAS_COLUMN": ("Table", "Column"), "HAS_INDEX": ("Table", "Index"), "HAS_PROCEDURE": ("Schema", "StoredProcedure"), "HAS_VIEW": ("Schema", "View"),
    "FOREIGN_KEY": ("Column", "Column"), "REFERENCES": ("Table", "Table"), "MAPS_TO": ("Class", "Table"), "BASED_ON": ("View", "Table"), "USES_TABLE": ("StoredProcedure", "Table"), "CROSS_DB_REFERENCE": ("View", "Table"),
    "HAS_QUERY": ("VDSService", "VDSQuery"), "HAS_WHERE_FIELD": ("VDSService", "VDSWhereField"), "VDS_USES_TABLE": ("VDSQuery", "Table"), "REFERENCES_TABLE": ("VDSWhereField", "Table"),
}
#: What the label-agnostic views show of every node.
COMMON = ["name", "path", "fqn", "repo", "database", "table", "definition", "owner"]


@dataclass
class Graph:
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    rels: dict[str, DataFrame] = field(default_factory=dict)
    #: What CHANGED comes to by file (dst, churn, inserted, deleted, commits, day), where it is kept.
    per_file: DataFrame | None = None

    def all_nodes(self, *labels: str) -> DataFrame:
        """Union of the labels (all if none is given): label, id and the common properties; only these labels are read."""
        parts = []
        for label in labels or self.nodes:
            if label not in self.nodes:
                continue
            n = self.nodes[label]
            parts.append(n.select(F.lit(label).alias("label"), "id", *[(F.col(c) if c in n.columns else F.lit(None)).cast("string").alias(c) for c in COMMON]))
        if not parts:
            return SparkSession.getActiveSession().createDataFrame([], ", ".join(f"`{c}` string" for c in ["label", "id", *COMMON]))
        return reduce(DataFrame.unionByName, parts)

    def all_rels(self, *types: str) -> DataFrame:
        """Union of relationship types: type, src_label, src, dst_label, dst; a type whose sources differ in label has src_label itself."""
        of = lambda t: F.col("src_label") if "src_label" in self.rels[t].columns else F.lit(RELATIONSHIPS[t][0]).alias("src_label")
        parts = [self.rels[t].select(F.lit(t).alias("type"), of(t), "src", F.lit(RELATIONSHIPS[t][1]).alias("dst_label"), "dst") for t in types or self.rels]
        return reduce(DataFrame.unionByName, parts)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of every key that comes last in ``order``; pre-aggregated, so a hot key costs no window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def code_graph(repositories: DataFrame, files: DataFrame, classes: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Graph:
    """Repository, File, Class and Method nodes with containment and imports.

    A file scanned again is one node, with the properties of its last scan. Classes come from the
    structure of files (owned by a file) and from the class list; imports also name classes that no
    repository holds (``external``). ``keep`` (``written``) materialises the last scans, which nearly all frames read.
    """
    g = Graph()
    g.nodes["Repository"] = latest(
        repositories.where("repo is not null").select(F.col("repo").alias("id"), F.col("repo").alias("name"), strip_credentials("url").alias("url"), F.col("root_path").alias("path"), "default_branch", F.col("ingest_status").alias("status"), F.col("n_commits").alias("commits"), F.nullif("last_commit", F.lit("")).alias("last_commit"), "last_ingested_at", "repo_id"), ["id"], ["repo_id"]
    )
    last = latest(files.where("repo is not null and relpath is not null").select("repo", "relpath", "file_name", "file_type", "file_extension", "total_lines", "content_hash", "module_key", "structure", "scanned_at", "file_id"), ["repo", "relpath"], ["scanned_at", "file_id"])
    f = keep(last).withColumn("id", F.concat_ws("/", "repo", "relpath"))
    g.nodes["File"] = f.select("id", F.col("relpath").alias("path"), F.col("file_name").alias("name"), "repo", F.col("module_key").alias("module"), F.col("file_type").alias("type"), F.col("file_extension").alias("extension"), "total_lines", F.col("content_hash").alias("hash"))
    g.rels["CONTAINS_FILE"] = f.select(F.col("repo").alias("src"), F.col("id").alias("dst"))
    space = F.coalesce(F.nullif("structure.package", F.lit("")), F.regexp_replace(F.regexp_replace("relpath", r"\.[^./]*$", ""), "/", "."))
    inside = f.select("id", "repo", space.alias("space"), F.explode("structure.classes").alias("c")).select("id", "repo", F.concat_ws(".", "space", "c.class_name").alias("fqn"), F.col("c.class_name").alias("name"), F.col("c.line_no").cast("int").alias("line_no"))
    listed = classes.where("repo is not null and fqn is not null")
    cid = F.concat_ws("/", "repo", "fqn").alias("id")
    ext = f.select("repo", F.explode("structure.imports").alias("i")).select(F.col("i.fqn").alias("fqn")).where("fqn is not null").distinct()
    own = inside.select(cid, "name", "fqn", "repo", F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("stereotype"), F.lit(None).cast("string").alias("mapped_table"), "line_no", F.lit(False).alias("external"), F.lit(0).alias("seq"), F.lit(0).cast("bigint").alias("tie"))
    more = listed.select(cid, F.col("class_name").alias("name"), "fqn", "repo", F.col("class_language").alias("language"), F.nullif("stereotype", F.lit("")).alias("stereotype"), "mapped_table", F.col("line_no").cast("int"), F.lit(False).alias("external"), F.lit(1).alias("seq"), F.col("class_id").alias("tie"))
    stub = ext.select(F.concat(F.lit("ext/"), "fqn").alias("id"), F.element_at(F.split("fqn", r"\."), -1).alias("name"), "fqn", *[F.lit(None).cast("string").alias(c) for c in ("repo", "language", "stereotype", "mapped_table")], F.lit(None).cast("int").alias("line_no"), F.lit(True).alias("external"), F.lit(0).alias("seq"), F.lit(0).cast("bigint").alias("tie"))
    g.nodes["Class"] = latest(own.unionByName(more).unionByName(stub), ["id"], ["seq", "tie", "line_no"]).drop("seq", "tie")
    g.rels["CONTAINS_CLASS"] = inside.select(F.col("id").alias("src"), F.concat_ws("/", "repo", "fqn").alias("dst")).distinct()
    imports = f.select("id", F.explode("structure.imports").alias("i")).where("i.fqn is not null").select("id", F.concat(F.lit("ext/"), "i.fqn").alias("dst")).distinct()
    g.rels["IMPORTS"] = imports.join(inside.select("id", F.concat_ws("/", "repo", "fqn").alias("src")), "id").select("src", "dst").distinct()
    m = listed.select("repo", "fqn", "class_id", F.explode("methods").alias("m"))
    mid = F.concat(F.concat_ws("/", "repo", "fqn"), F.lit("#"), F.col("m.method_name"))
    g.nodes["Method"] = latest(m.select(mid.alias("id"), F.col("m.method_name").alias("name"), F.col("fqn").alias("owner"), "repo", F.col("m.return_type").alias("return_type"), F.col("m.visibility").alias("visibility"), F.col("m.line_no").cast("int").alias("line_no"), "class_id").where("id is not null"), ["id"], ["class_id", "line_no"]).drop("class_id")
    g.rels["HAS_METHOD"] = m.select(F.concat_ws("/", "repo", "fqn").alias("src"), mid.alias("dst")).where("dst is not null").distinct()
    return g


def history_graph(commits: DataFrame) -> Graph:
    """Author and Commit nodes with AUTHORED, HAS_COMMIT and PARENT; committers are authors as well."""
    g = Graph()
    c = latest(commits.where("repo is not null and commit_hash is not null").select("repo", "commit_hash", "short_hash", "author_name", "author_email", "authored_at", "committer_name", "committer_email", "committed_at", "parents", "message", "insertions", "deletions", "files_changed", "recorded_at"), ["repo", "commit_hash"], ["recorded_at", "message", "authored_at"])
    c = c.withColumn("id", F.concat_ws("@", "repo", "commit_hash"))
    g.nodes["Commit"] = c.select("id", F.col("commit_hash").alias("hash"), F.col("short_hash").alias("short"), "message", "authored_at", "committed_at", "insertions", "deletions", "files_changed", F.size("parents").alias("parent_count"))
    one = lambda n, e, p: c.select(author_id(e, n).alias("id"), F.col(n).alias("name"), F.col(e).alias("email"), F.lit(p).alias("p"), "authored_at")
    g.nodes["Author"] = latest(one("author_name", "author_email", 1).union(one("committer_name", "committer_email", 0)).where("id is not null"), ["id"], ["p", "name", "email"]).drop("p", "authored_at")
    g.rels["AUTHORED"] = c.select(author_id("author_email", "author_name").alias("src"), F.col("id").alias("dst")).where("src is not null")
    g.rels["HAS_COMMIT"] = c.select(F.col("repo").alias("src"), F.col("id").alias("dst"))
    g.rels["PARENT"] = c.select(F.col("id").alias("src"), "repo", F.explode("parents").alias("p")).select("src", F.concat_ws("@", "repo", "p").alias("dst")).distinct()
    return g


def database_id(engine: str = "db_engine", host: str = "db_host", name: str = "database_name") -> Column:
    """engine://host/name: databases of one name on two servers are two."""
    return F.concat(F.coalesce(engine, F.lit("")), F.lit("://"), F.coalesce(host, F.lit("")), F.lit("/"), F.col(name))


def catalog_graph(columns: DataFrame, foreign_keys: DataFrame, procedures: DataFrame, views: DataFrame, indexes: DataFrame | None = None, definition_cut: int | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Graph:
    """Database, Schema, Table, Column, Index, StoredProcedure and View nodes with containment and foreign keys.

    Every frame may carry db_engine and db_host; where one does not, its database is the one of that name in
    ``columns`` (the least id if there are several). Columns that were dropped are left out, repeated rows count
    once (least column_id). A foreign key names its ends in any case, with quotes or a schema; its source must be
    in the catalog, a target that is not becomes a table and column with nothing but their names, in the source's
    schema. ``indexes`` (database_name, schema_name, table_name, index_name, columns, is_unique, index_type).
    Definitions are whole unless ``definition_cut`` says how many characters to keep. ``keep`` (``written``) materialises
    the live columns and the ends of foreign keys: frames are read from those, and plans that join several of them
    do not hold the whole catalog once for every frame.
    """
    g = Graph()
    with_server = lambda df: df.select("*", *[F.lit(None).cast("string").alias(c) for c in ("db_engine", "db_host", "schema_name") if c not in df.columns])
    raw = with_server(columns).where("database_name is not null and table_name is not null and column_name is not null")
    servers = raw.groupBy("database_name").agg(F.min(database_id()).alias("named"))

    def placed(df: DataFrame) -> DataFrame:
        """With the ids of database and schema."""
        here = df.where("database_name is not null")
        if "db_engine" in df.columns:
            here = with_server(here).withColumn("db_id", database_id())
        else:
            here = with_server(here.join(servers, "database_name", "left")).withColumn("db_id", F.coalesce("named", F.concat(F.lit(":///"), F.col("database_name")))).drop("named")
        return here.withColumn("schema_id", F.concat("db_id", F.lit("/"), F.coalesce("schema_name", F.lit(""))))

    live = placed(raw.where("dropped_at is null")).select("db_id", "schema_id", "database_name", "schema_name", "table_name", "column_name", "db_engine", "db_host", "column_id", "ordinal_no", "data_type", "is_nullable", "column_default", "column_key", (-F.col("column_id")).alias("o"))
    live = keep(latest(live, ["db_id", "schema_id", "table_name", "column_name"], ["o"]))
    live = live.withColumn("table_id", F.concat("schema_id", F.lit("/"), "table_name")).withColumn("id", F.concat("table_id", F.lit("#"), "column_name"))

    key = foreign_keys.withColumns({"ft": identifier("from_table"), "fc": identifier("from_column"), "tt": identifier("to_table"), "tc": identifier("to_column")})
    key = placed(key.where("ft is not null and fc is not null and tt is not null and tc is not null")).select("db_id", "ft", "fc", "tt", "tc", "constraint_name")
    ends = live.select("db_id", identifier("table_name").alias("t"), identifier("column_name").alias("c"), "id", "table_id", "schema_id", "database_name", "schema_name", "db_engine", "db_host", "table_name")
    a = ends.select("db_id", F.col("t").alias("ft"), F.col("c").alias("fc"), F.col("id").alias("src"), F.col("table_id").alias("src_table"), "schema_id", "database_name", "schema_name", "db_engine", "db_host")
    b = ends.select("db_id", F.col("t").alias("tt"), F.col("c").alias("tc"), F.col("id").alias("dst"), F.col("table_id").alias("dst_table"))
    there = key.join(a, ["db_id", "ft", "fc"])
    both = keep(there.join(b, ["db_id", "tt", "tc"], "left"))
    named = ends.groupBy("db_id", "schema_id", F.col("t").alias("tt")).agg(F.min("table_name").alias("known"))  # a table that lacks only the column
    lost = keep(both.where("dst is null").join(named, ["db_id", "schema_id", "tt"], "left").withColumn("tn", F.coalesce("known", "tt")).drop("dst", "dst_table"))
    lost = lost.withColumn("dst_table", F.concat("schema_id", F.lit("/"), "tn")).withColumn("dst", F.concat("dst_table", F.lit("#"), "tc"))
    stub = lost.select("db_id", "schema_id", F.col("tn").alias("table_name"), F.col("tc").alias("column_name"), "database_name", "schema_name", "db_engine", "db_host", F.col("dst_table").alias("table_id"), F.col("dst").alias("id")).distinct()
    every = live.unionByName(stub, allowMissingColumns=True)

    g.nodes["Database"] = live.groupBy(F.col("db_id").alias("id")).agg(F.max("database_name").alias("name"), F.max("db_engine").alias("engine"), F.max("db_host").alias("host"))
    g.nodes["Schema"] = live.select(F.col("schema_id").alias("id"), F.col("schema_name").alias("name"), F.col("database_name").alias("database")).distinct()
    g.nodes["Table"] = every.select(F.col("table_id").alias("id"), F.col("table_name").alias("name"), F.col("schema_name").alias("schema"), F.col("database_name").alias("database")).distinct()
    g.nodes["Column"] = every.select("id", F.col("column_name").alias("name"), F.col("table_name").alias("table"), F.col("schema_name").alias("schema"), F.col("database_name").alias("database"), "data_type", F.col("ordinal_no").alias("ordinal"), (F.upper("is_nullable").isin("YES", "Y", "TRUE", "T", "1")).alias("is_nullable"), "column_default", "column_key")
    g.rels["HAS_SCHEMA"] = live.select(F.col("db_id").alias("src"), F.col("schema_id").alias("dst")).distinct()
    g.rels["HAS_TABLE"] = live.select(F.col("schema_id").alias("src"), F.col("table_id").alias("dst")).distinct()
    g.rels["HAS_COLUMN"] = live.select(F.col("table_id").alias("src"), F.col("id").alias("dst"))
    g.rels["FOREIGN_KEY"] = both.where("dst is not null").select("src", "dst", "constraint_name").unionByName(lost.select("src", "dst", "constraint_name")).groupBy("src", "dst").agg(F.max("constraint_name").alias("constraint_name"))
    g.rels["REFERENCES"] = both.where("dst is not null").select("src_table", "dst_table").unionByName(lost.select("src_table", "dst_table")).select(F.col("src_table").alias("src"), F.col("dst_table").alias("dst")).distinct()
    if indexes is not None:
        ix = placed(indexes.where("table_name is not null and index_name is not null")).withColumn("tid", F.concat("schema_id", F.lit("/"), "table_name"))
        ix = latest(ix.select(F.concat("tid", F.lit("!"), "index_name").alias("id"), F.col("index_name").alias("name"), F.col("table_name").alias("table"), F.col("database_name").alias("database"), "is_unique", "index_type", "columns", "tid"), ["id"], ["columns"])
        ix = ix.join(g.rels["HAS_TABLE"].select(F.col("dst").alias("tid")), "tid", "left_semi")
        g.nodes["Index"] = ix.drop("tid")
        g.rels["HAS_INDEX"] = ix.select(F.col("tid").alias("src"), F.col("id").alias("dst"))
    text = F.col("definition") if definition_cut is None else F.substring("definition", 1, definition_cut)
    for label, part, df, name, rel in (("StoredProcedure", "proc", procedures, "procedure_name", "HAS_PROCEDURE"), ("View", "view", views, "view_name", "HAS_VIEW")):
        more = [F.coalesce("routine_type", F.lit("PROCEDURE")).alias("type"), F.coalesce("parameters", F.array().cast("array<string>")).alias("parameters")] if label == "StoredProcedure" else []
        n = placed(df.where(f"{name} is not null")).select(F.concat("schema_id", F.lit(f"/{part}/"), F.col(name)).alias("id"), F.col(name).alias("name"), F.col("database_name").alias("database"), *more, text.alias("definition"), "schema_id", "seq")
        n = latest(n, ["id"], ["seq"])
        g.nodes[label] = n.drop("seq", "schema_id")
        g.rels[rel] = n.select(F.col("schema_id").alias("src"), F.col("id").alias("dst")).join(g.nodes["Schema"].select(F.col("id").alias("src")), "src", "left_semi")
    return g


def merged(*graphs: Graph) -> Graph:
    return Graph({k: v for g in graphs for k, v in g.nodes.items()}, {k: v for g in graphs for k, v in g.rels.items()})
