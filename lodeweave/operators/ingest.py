"""From sources to the graph: scanned trees, logs and references, and service catalogs as nodes and relationships.

Inputs are what the sources give: files (repo, relpath, name, type, extension, hash, total_lines, lines) of
``scan_tree``, their ``structures``, commits and changed files of ``history``, rows of a service catalog. Every
mapping is a projection, an explosion or an equi-join on (repo, relpath); nothing is ordered across files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.text import author_id, file_type, line_kind, strip_credentials
from lodeweave.operators.graph import Graph, latest
from lodeweave.sources.structure import namespace
from lodeweave.sources.tree import modules_by_longest_prefix


def _id(*parts: str | Column, by: str = "/") -> Column:
    """Parts joined to an id; null if any is null."""
    out = []
    for p in parts:
        out += [F.lit(by)] * bool(out) + [F.col(p) if isinstance(p, str) else p]
    return F.concat(*out)


def module_id(repo: str | Column, key: str | Column) -> Column:
    """repo/key, or repo/. for the root module."""
    key = F.col(key) if isinstance(key, str) else key
    return _id(repo, F.coalesce(F.nullif(key, F.lit("")), F.lit(".")))


def modules(descriptors: DataFrame) -> Graph:
    """Module and Dependency nodes with HAS_MODULE and DEPENDS_ON.

    ``descriptors`` (repo, root, pom struct or null): pom as ``parse_pom`` gives it. A module is named by its
    artifact, else its folder, else its repository. Dependencies without an artifact name nothing.
    """
    g = Graph()
    named = F.coalesce(F.nullif("pom.artifact_id", F.lit("")), F.nullif(F.element_at(F.split("root", "/"), -1), F.lit("")), F.col("repo"))
    m = descriptors.where("repo is not null and root is not null").select(module_id("repo", "root").alias("id"), named.alias("name"), F.col("root").alias("key"), "repo", "pom")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    g.nodes["Module"] = m.select("id", "name", "key", "repo", blank("pom.group_id").alias("group_id"), F.coalesce("pom.artifact_id", "name").alias("artifact_id"), blank("pom.version").alias("version"), blank("pom.packaging").alias("packaging"), blank("pom.description").alias("description"))
    g.rels["HAS_MODULE"] = m.select(F.col("repo").alias("src"), F.col("id").alias("dst"))
    d = m.select(F.col("id").alias("src"), F.explode("pom.dependencies").alias("d")).where("d.artifact_id <> ''")
    did = _id(blank("d.group_id"), "d.artifact_id", blank("d.version"), by=":")
    g.nodes["Dependency"] = d.select(did.alias("id"), F.col("d.artifact_id").alias("name"), blank("d.group_id").alias("group_id"), F.col("d.artifact_id").alias("artifact_id"), blank("d.version").alias("version")).distinct()
    g.rels["DEPENDS_ON"] = d.groupBy("src", did.alias("dst")).agg(F.max(F.coalesce("d.scope", F.lit("compile"))).alias("scope"))
    return g


def in_modules(files: DataFrame, mods: DataFrame) -> DataFrame:
    """Files with ``root``: the deepest module that holds them, else the first of their repository, '' without any."""
    first = mods.groupBy("repo").agg(F.min("root").alias("first"))
    found = modules_by_longest_prefix(files, mods).join(first, "repo", "left")
    return found.withColumn("root", F.coalesce("root", "first", F.lit(""))).drop("first")


def _declared(files: DataFrame, structure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with their structure, and their types: (repo, relpath, fid, type, at, t, fqn), at counting classes, interfaces, enums."""
    s = files.join(structure, ["repo", "relpath"])
    space = namespace(F.col("relpath"), F.col("type"), F.col("package"))
    kind = lambda *k: F.filter("types", lambda t: t["kind"].isin(*k))
    ordered = F.concat(F.filter("types", lambda t: ~t["kind"].isin("interface", "enum")), kind("interface"), kind("enum"))
    one = s.select("repo", "relpath", _id("repo", "relpath").alias("fid"), "type", "root", space.alias("space"), F.posexplode(ordered).alias("at", "t"))
    return s, one.withColumn("fqn", F.when(F.coalesce("space", F.lit("")) == "", F.col("t.name")).otherwise(_id("space", "t.name", by=".")))


def code(repositories: DataFrame, files: DataFrame, structure: DataFrame, descriptors: DataFrame, with_lines: bool = False) -> Graph:
    """The code side of the graph.

    Files lie in their module, Java files with a package in the package. Types give classes; what
    they extend, implement and import is a class outside (``ext/<name>``). A method belongs to the first type
    of its file that has its owner's name; Java methods to the first type of the file, and to nothing without one;
    other methods without an owner belong to the file. With ``with_lines`` every line is a node and points to the
    next. Files and structures that occur twice count once, with the last name; empty tables give empty frames.
    """
    g = modules(descriptors)
    g.nodes["Repository"] = latest(repositories.where("repo is not null").select(F.col("repo").alias("id"), F.col("repo").alias("name"), strip_credentials("url").alias("url"), "default_branch", F.col("ingest_status").alias("status")), ["id"], ["url"])
    f = in_modules(files.where("repo is not null and relpath is not null"), descriptors.where("root is not null").select("repo", "root").distinct())
    fid = _id("repo", "relpath")
    g.nodes["File"] = f.select(fid.alias("id"), F.col("relpath").alias("path"), "name", "repo", F.col("root").alias("module"), "type", "extension", "total_lines", "hash")
    s, t = _declared(f, structure)

    in_package = F.coalesce((F.col("type") == "java") & (F.col("package") != ""), F.lit(False))
    pid = F.concat(_id("repo", F.col("root")), F.lit("/"), F.col("package"))
    placed = f.join(structure.select("repo", "relpath", "package"), ["repo", "relpath"], "left")
    pack = placed.where(in_package).select(pid.alias("id"), F.col("package").alias("name"), F.col("root").alias("module"), "repo", F.element_at(F.split("package", r"\."), -1).alias("short_name")).distinct()
    g.nodes["Package"] = pack
    g.rels["HAS_PACKAGE"] = pack.select(module_id("repo", "module").alias("src"), F.col("id").alias("dst"))
    g.rels["CONTAINS_FILE"] = placed.select(F.when(in_package, pid).otherwise(module_id("repo", "root")).alias("src"), fid.alias("dst"), F.when(in_package, "Package").otherwise("Module").alias("src_label"))

    cid = _id("repo", "fqn")
    own = t.select(cid.alias("id"), F.col("t.name").alias("name"), "fqn", "repo", F.col("root").alias("module"), F.col("t.kind").alias("type"), F.coalesce("t.visibility", F.lit("public")).alias("visibility"), F.coalesce("t.is_abstract", F.lit(False)).alias("is_abstract"), F.coalesce("t.is_final", F.lit(False)).alias("is_final"),
                   F.col("t.line").cast("int").alias("line_no"), F.lit(False).alias("external"), F.col("type").alias("language"), F.coalesce("t.stereotype", F.lit("")).alias("stereotype"), F.coalesce("t.mapped_table", F.lit("")).alias("mapped_table"), "relpath", "at")
    own = latest(own, ["id"], ["relpath", "at"]).drop("relpath", "at")
    extends = t.where("t.extends <> ''").select(cid.alias("src"), F.col("t.extends").alias("fqn")).distinct()
    implements = t.select(cid.alias("src"), F.explode("t.implements").alias("fqn")).where("fqn <> ''").distinct()
    imported = s.select("repo", "relpath", F.explode("imports").alias("i")).select("repo", "relpath", F.col("i.fqn").alias("fqn")).where("fqn <> ''").distinct()
    outside = F.concat(F.lit("ext/"), "fqn")
    stub = extends.select("fqn").union(implements.select("fqn")).union(imported.select("fqn")).distinct().select(outside.alias("id"), F.element_at(F.split("fqn", r"\."), -1).alias("name"), "fqn", F.lit(True).alias("external"))
    g.nodes["Class"] = own.unionByName(stub, allowMissingColumns=True)
    g.rels["CONTAINS_CLASS"] = t.select(F.col("fid").alias("src"), cid.alias("dst")).distinct()
    for name, df in (("EXTENDS", extends), ("IMPLEMENTS", implements)):
        g.rels[name] = df.select("src", outside.alias("dst"))
    g.rels["IMPORTS"] = t.select("repo", "relpath", cid.alias("src")).distinct().join(imported, ["repo", "relpath"]).select("src", outside.alias("dst")).distinct()

    first = t.groupBy("repo", "relpath", F.col("t.name").alias("owner_name")).agg(F.min_by("fqn", "at").alias("by_name"))
    top = t.groupBy("repo", "relpath").agg(F.min_by("fqn", "at").alias("first_type"))
    m = s.select("repo", "relpath", "type", F.posexplode("methods").alias("at", "m")).withColumn("owner_name", F.coalesce("m.owner", F.lit("")))
    m = m.join(first, ["repo", "relpath", "owner_name"], "left").join(top, ["repo", "relpath"], "left")
    m = m.withColumn("owner", F.coalesce("by_name", F.when(F.col("type") == "java", F.col("first_type")))).where("owner is not null or type <> 'java'")
    mid = F.concat(_id("repo", F.coalesce("owner", "relpath")), F.lit("#"), F.col("m.name"))
    g.nodes["Method"] = latest(m.select(mid.alias("id"), F.col("m.name").alias("name"), F.coalesce("owner", F.lit("")).alias("owner"), "repo", F.coalesce("m.return_type", F.lit("")).alias("return_type"), F.coalesce("m.visibility", F.lit("public")).alias("visibility"), F.col("m.line").cast("int").alias("line_no"), F.col("type").alias("language"), "relpath", "at"), ["id"], ["relpath", "at"]).drop("relpath", "at")
    g.rels["HAS_METHOD"] = m.where("owner is not null").select(_id("repo", "owner").alias("src"), mid.alias("dst")).distinct()
    g.rels["CONTAINS_METHOD"] = m.where("owner is null").select(fid.alias("src"), mid.alias("dst")).distinct()
    if with_lines:
        line = f.select("repo", fid.alias("fid"), "extension", F.size("lines").alias("n"), F.posexplode("lines").alias("k", "content"))
        lid = lambda k: F.concat("fid", F.lit(":"), k.cast("string"))
        g.nodes["Line"] = line.select(lid(F.col("k") + 1).alias("id"), F.col("fid").alias("file_id"), (F.col("k") + 1).alias("number"), "content", line_kind("content", "extension").alias("type"), "repo")
        g.rels["CONTAINS_LINE"] = line.select(F.col("fid").alias("src"), lid(F.col("k") + 1).alias("dst"))
        g.rels["NEXT_LINE"] = line.where("k + 1 < n").select(lid(F.col("k") + 1).alias("src"), lid(F.col("k") + 2).alias("dst"))
    return g


def labelled(g: Graph) -> DataFrame:
    """(id, labels): the classes with the labels that their frameworks give them, behind their own."""
    c = g.nodes["Class"]
    return c.select("id", F.when(F.coalesce("stereotype", F.lit("")) != "", F.array(F.lit("Class"), F.col("stereotype"))).otherwise(F.array(F.lit("Class"))).alias("labels"))


def history(commits: DataFrame, changed: DataFrame, refs: DataFrame, files: DataFrame | None = None, once: bool = False, keep: Callable[[DataFrame], DataFrame] | None = None) -> Graph:
    """Authors, commits, their parents and changed files, branches and tags.

    ``commits`` (repo, hash, short, author_name, ..., parents, message, insertions, deletions, files_changed),
    ``changed`` (repo, hash, path, change_type, insertions, deletions), ``refs`` (repo, kind, name, commit).
    Parents and targets of references that the log does not hold are commits with nothing but an id, changed
    paths that no scan (``files``: id) holds are files with a path, a name and a type. With ``once`` both frames hold
    every key once and changes are of the commits given, as those of ``parsed_entries`` are: then nothing is gathered
    by key, and CHANGED also has the author if ``changed`` brings the header's fields along. ``keep`` (``written``) then has
    the sums by file kept, so that all changes are gone through once and not for every reading of files.
    """
    g = Graph()
    c = commits.where("repo is not null and hash is not null").select("repo", "hash", "short", "author_name", "author_email", "authored_at", "committer_name", "committer_email", "committed_at", "parents", "message", "insertions", "deletions", "files_changed")
    c = c if once else latest(c, ["repo", "hash"], ["authored_at", "message"])
    cid = _id("repo", "hash", by="@")
    g.rels["PARENT"] = c.select(cid.alias("src"), "repo", F.explode("parents").alias("p")).where("p <> ''").select("src", _id("repo", "p", by="@").alias("dst")).distinct()
    r = refs.where("repo is not null and name <> ''").withColumn("rid", F.concat("repo", F.lit("#"), "kind", F.lit("/"), "name")).withColumn("target", _id("repo", "commit", by="@"))
    known = c.select(cid.alias("id"), "hash", "short", "message", "authored_at", "committed_at", "insertions", "deletions", "files_changed", F.size("parents").alias("parent_count"), F.lit(False).alias("stub"))
    named = g.rels["PARENT"].select(F.col("dst").alias("id")).union(r.select("target")).where("id is not null").distinct()
    g.nodes["Commit"] = known.unionByName(named.join(known.select("id"), "id", "left_anti").withColumn("stub", F.lit(True)), allowMissingColumns=True)
    one = lambda n, e, p: c.select(author_id(e, n).alias("id"), F.col(n).alias("name"), F.col(e).alias("email"), F.lit(p).alias("p"), "authored_at")
    g.nodes["Author"] = latest(one("author_name", "author_email", 1).union(one("committer_name", "committer_email", 0)).where("id is not null"), ["id"], ["p", "authored_at", "name", "email"]).drop("p", "authored_at")
    g.rels["AUTHORED"] = c.select(author_id("author_email", "author_name").alias("src"), cid.alias("dst")).where("src is not null")
    g.rels["HAS_COMMIT"] = c.select(F.col("repo").alias("src"), cid.alias("dst"))
    ch = changed.where("repo is not null and hash is not null and path is not null")
    also = [author_id("author_email", "author_name").alias("author")] if once and "author_email" in ch.columns else []
    if not once:
        ch = latest(ch.select("repo", "hash", "path", "change_type", "insertions", "deletions"), ["repo", "hash", "path"], ["change_type", "insertions", "deletions"])
        ch = ch.join(c.select("repo", "hash"), ["repo", "hash"], "left_semi")
    g.rels["CHANGED"] = ch.select(cid.alias("src"), _id("repo", "path").alias("dst"), "change_type", "insertions", "deletions", *also)
    name = F.element_at(F.split("path", "/"), -1)
    if also and keep:
        day = F.substring(F.coalesce("authored_at", "committed_at", F.lit("")), 1, 10)
        per = keep(ch.groupBy("repo", "path").agg(F.sum(F.col("insertions") + F.col("deletions")).alias("churn"), F.sum("insertions").alias("inserted"), F.sum("deletions").alias("deleted"), F.count("*").alias("commits"), F.max(day).alias("day")))
        g.per_file = per.select(_id("repo", "path").alias("dst"), "churn", "inserted", "deleted", "commits", "day")
        ch = per
    touched = ch.select("repo", "path").distinct().select(_id("repo", "path").alias("id"), "path", name.alias("name"), "repo", file_type(name).alias("type"))
    g.nodes["File"] = touched if files is None else touched.join(files.select("id"), "id", "left_anti")
    for label, kind, has, to in (("Branch", "branch", "HAS_BRANCH", "POINTS_TO"), ("Tag", "tag", "HAS_TAG", "TAGS")):
        mine = r.where(F.col("kind") == kind)
        g.nodes[label] = mine.select(F.col("rid").alias("id"), "name", "repo").distinct()
        g.rels[has] = mine.select(F.col("repo").alias("src"), F.col("rid").alias("dst")).distinct()
        g.rels[to] = mine.where("target is not null").select(F.col("rid").alias("src"), F.col("target").alias("dst")).distinct()
    return g


def joined(code_side: Graph, history_side: Graph) -> Graph:
    """Both sides as one graph; files that only the log knows join the scanned ones."""
    nodes = {**code_side.nodes, **history_side.nodes}
    both = code_side.nodes["File"]
    nodes["File"] = both.unionByName(history_side.nodes["File"].join(both.select("id"), "id", "left_anti"), allowMissingColumns=True)
    return Graph(nodes, {**code_side.rels, **history_side.rels}, history_side.per_file)


def services(rows: DataFrame, tables: DataFrame) -> Graph:
    """A catalog of data services: VDSService, VDSQuery and VDSWhereField with what they use.

    ``rows`` (dbid, database, sid, service, query, core_table, group_by, order_by, where_table, where_column,
    where_field, seq): of rows with one id the first (least seq) counts, one without a sid names no service, one
    without a query text no query. ``tables`` (id, database, name): a table is named in any case, in its own database.
    """
    g = Graph()
    r = rows.where("sid is not null and dbid is not null").withColumn("sid", F.col("sid").cast("string")).withColumn("svc", F.concat(F.lit("vds://"), _id("dbid", "sid")))
    first = lambda df: latest(df.withColumn("o", -F.col("seq")).drop("seq"), ["id"], ["o"]).drop("o")
    g.nodes["VDSService"] = first(r.select(F.col("svc").alias("id"), "sid", F.coalesce("service", F.lit("")).alias("name"), "database", "seq"))
    q = first(r.where("query <> ''").select(F.concat(F.lit("vdsq://"), _id("dbid", "sid")).alias("id"), "sid", "query", "core_table", "group_by", "order_by", "database", "svc", "seq"))
    g.nodes["VDSQuery"] = q.drop("svc")
    g.rels["HAS_QUERY"] = q.select(F.col("svc").alias("src"), F.col("id").alias("dst"))
    none = lambda c: F.coalesce(F.col(c), F.lit("None"))
    w = first(r.where("where_table <> '' and where_column <> ''").select(F.concat(F.lit("vdsw://"), F.col("dbid"), F.lit("/"), _id("sid", "where_table", "where_column", none("where_field"), by="_")).alias("id"), "sid", F.col("where_table").alias("table"), F.col("where_column").alias("name"), F.col("where_field").alias("field"), "database", "svc", "seq"))
    g.nodes["VDSWhereField"] = w.drop("svc")
    g.rels["HAS_WHERE_FIELD"] = w.select(F.col("svc").alias("src"), F.col("id").alias("dst"))
    t = tables.select(F.col("id").alias("dst"), "database", F.lower("name").alias("n"))
    for rel, df, c in (("VDS_USES_TABLE", q, "core_table"), ("REFERENCES_TABLE", w, "table")):
        g.rels[rel] = df.select(F.col("id").alias("src"), "database", F.lower(c).alias("n")).where("n <> ''").join(t, ["database", "n"]).select("src", "dst").distinct()
    return g
